"""Near-duplicate documents by improved consistent weighted sampling.

Documents are weighted sets of five-word shingles: a shingle's weight is its count in
the document times its inverse document frequency, a level of 8 to 16 that follows
the mean frequency of its words over all documents.  (The document frequency of the
shingle itself is the size of the very group of copies that is looked for: weighting
by it would make copies in large groups dissimilar.)

1.  Consistent weighted samples (Ioffe 2010) of every document; two documents agree
    in a sample with the probability of their weighted Jaccard similarity.
2.  Sixteen bands of five samples; documents that agree in a band are candidates.
    Documents with the same weighted set are one node from here on.
3.  The members of a band's bucket are compared in units of bounded size.  Those of a
    large bucket meet its pivots first, block by block.  Members that are then in one
    component need no comparison: those outside the bucket's largest component meet each
    other and all of its blocks.  So no bucket meets in one task, none is cut, and a group
    of copies costs in proportion to its size.  Buckets with the same members are compared
    once.
4.  Candidates are linked if their weighted Jaccard similarity, computed from whole
    texts, is at least the threshold.  A unit passes on a spanning forest of its links.
5.  Classes are the connected components of the links (large-star, small-star).
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import storage
from .bpe import ragged
from .textkernel import Words, mix, release, slices

SHINGLE = 5
THRESHOLD = 0.8
BANDS, BAND_ROWS = 16, 5
#: Word document frequencies are kept in so many hashed counters, which bounds what is broadcast.
WORD_BUCKETS = 1 << 20
#: Members of a block of a large bucket; a unit holds two blocks at most.
BLOCK = 128
#: Members of a large bucket that all its others meet first (as expected; hashes choose them).
PIVOTS = 48
#: How the members of a unit are compared: all of them; those of two blocks; or members
#: with pivots, and pivots with each other.
ALL, CROSS, PIVOT = 0, 1, 2
UNIT = "struct<band int, key bigint, kind int, lo string, hi string>"
#: Candidate keys up to which they are broadcast to pick texts (about 40 bytes each).
BROADCAST_KEYS = 400_000
COLUMNS = 2048

_rng = np.random.default_rng(20_100)
_SEEDS = _rng.integers(1, 2**63, BANDS * BAND_ROWS, dtype=np.uint64)


def _gamma_quantiles(n: int) -> np.ndarray:
    """Quantiles of Gamma(2, 1) at the middles of ``n`` equal steps, by bisection."""
    p = (np.arange(n) + 0.5) / n
    low, high = np.zeros(n), np.full(n, 60.0)
    for _ in range(60):
        mid = (low + high) / 2
        below = 1 - np.exp(-mid) * (1 + mid) < p
        low, high = np.where(below, mid, low), np.where(below, high, mid)
    return (low + high) / 2


_R = _gamma_quantiles(1 << 12).astype(np.float32)
_LOG_C = np.log(_gamma_quantiles(1 << 16)).astype(np.float32)


def word_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """(documents that hold a word of each hashed counter, documents)."""

    def run(batches):
        seen, n = np.zeros(WORD_BUCKETS, np.int64), 0
        for batch in batches:
            for part in slices(batch, "text"):
                w = Words(part.column("text"))
                pair = np.unique(w.doc * WORD_BUCKETS + (w.hash >> np.uint64(44)).astype(np.int64))
                seen += np.bincount(pair % WORD_BUCKETS, minlength=WORD_BUCKETS)
                n += part.num_rows
        at = np.flatnonzero(seen)
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(np.append(at, -1), pa.int32()), "n": pa.array(np.append(seen[at], n))})

    got = docs.select("text").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()  # WORD_BUCKETS + 1 rows at most
    bucket, n = got.column("bucket").to_numpy(), got.column("n").to_numpy()
    out = np.zeros(WORD_BUCKETS, np.int64)
    out[bucket[bucket >= 0]] = n[bucket >= 0]
    return out, int(n[bucket < 0].sum())


def word_idf(frequencies: np.ndarray, documents: int) -> np.ndarray:
    """Inverse document frequencies, from 0 (in all documents) to 1."""
    return (np.log((documents + 1) / (frequencies + 1)) / np.log(documents + 2)).clip(0, 1).astype(np.float32)


class Shingles:
    """The weighted shingle sets of a slice: arrays ``doc``, ``key``, ``times``, ``idf``
    (integer level), sorted by document and key.  A text of one to four words has one
    shingle of all of them; one without words has none."""

    def __init__(self, arr: pa.Array, idf: np.ndarray):
        w = Words(arr)
        n = len(w.counts)
        of_word = idf[(w.hash >> np.uint64(44)).astype(np.int64)] if len(w.hash) else np.zeros(0, np.float32)
        total = np.concatenate([[0], np.cumsum(of_word, dtype=np.float64)])
        at, key = w.windows(SHINGLE)
        mean = (total[at + SHINGLE] - total[at]) / SHINGLE
        doc = w.doc[at]
        short = np.flatnonzero((w.counts > 0) & (w.counts < SHINGLE))
        if len(short):
            h = np.zeros(len(short), np.uint64)
            for j in range(SHINGLE - 1):
                has = w.counts[short] > j
                h[has] = mix(h[has] * np.uint64(0xD6E8FEB86659FD93) + w.hash[w.first[short[has]] + j] + np.uint64(j + 1))
            doc, key = np.concatenate([doc, short]), np.concatenate([key, h])
            mean = np.concatenate([mean, (total[w.first[short + 1]] - total[w.first[short]]) / w.counts[short]])
        order = np.lexsort((key, doc))
        doc, key, mean = doc[order], key[order], mean[order]
        new = np.ones(len(key), bool)
        new[1:] = (key[1:] != key[:-1]) | (doc[1:] != doc[:-1])
        first = np.flatnonzero(new)
        self.doc, self.key, self.times = doc[first], key[first], np.diff(np.append(first, len(key)))
        self.idf = np.rint(8 + 8 * mean[first]).astype(np.int64)
        self.offsets = np.searchsorted(self.doc, np.arange(n + 1))

    def digests(self) -> list[bytes]:
        """16 bytes of each weighted set."""
        a = mix(self.key + self.times.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        b = mix(a ^ np.uint64(0x5851F42D4C957F2D))
        out = np.zeros((len(self.offsets) - 1, 2), np.uint64)
        for i, x in enumerate((a, b)):
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(x, dtype=np.uint64)])
            out[:, i] = total[self.offsets[1:]] - total[self.offsets[:-1]]
        return [r.tobytes() for r in out]

    def samples(self) -> np.ndarray:
        """(documents with shingles, samples): the sampled shingle and its step, hashed."""
        full = np.flatnonzero(np.diff(self.offsets))
        starts = self.offsets[full]
        out = np.empty((len(full), len(_SEEDS)), np.uint32)
        log_w = np.log(self.times * self.idf).astype(np.float32)
        ident = self.key & np.uint64(0xFFFFFFFF)
        for k, seed in enumerate(_SEEDS):
            x = (self.key ^ seed) * np.uint64(0xBF58476D1CE4E5B9)
            x ^= x >> np.uint64(32)
            x *= np.uint64(0x94D049BB133111EB)
            r = _R[(x >> np.uint64(52)).astype(np.int64)]
            beta = ((x >> np.uint64(12)) & np.uint64(0xFFFFFF)).astype(np.float32) * np.float32(2**-24)
            step = np.floor(log_w / r + beta)
            a = _LOG_C[((x >> np.uint64(36)) & np.uint64(0xFFFF)).astype(np.int64)] - r * (step - beta + 1)
            bits = a.view(np.uint32)
            bits ^= np.where(bits >> np.uint32(31), np.uint32(0xFFFFFFFF), np.uint32(0x80000000))
            code = (ident + step.astype(np.int64).astype(np.uint64) * np.uint64(0x9E3779B1)) & np.uint64(0xFFFFFFFF)
            out[:, k] = np.minimum.reduceat((bits.astype(np.uint64) << np.uint64(32)) | code, starts).astype(np.uint32) if len(full) else 0
        return out

    def bands(self) -> tuple[np.ndarray, np.ndarray]:
        """(documents with shingles, their band keys)."""
        s = self.samples().astype(np.uint64).reshape(-1, BANDS, BAND_ROWS)
        h = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), s.shape[:2]).copy()
        for j in range(BAND_ROWS):
            h = mix(h * np.uint64(0x9E3779B97F4A7C15) + s[:, :, j])
        return np.flatnonzero(np.diff(self.offsets)), h

    def vectors(self) -> list[tuple[bytes, bytes]]:
        """(elements, weights) of each document: a shingle found n times is n elements."""
        n = np.repeat(np.arange(len(self.key)), self.times)
        turn = ragged(np.zeros(len(self.times), np.int64), self.times).astype(np.uint64)
        element = (mix(self.key[n] + turn * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(16)).astype("<u8")
        weight = self.idf[n].astype(np.uint8)
        cut = np.concatenate([[0], np.cumsum(self.times)])[self.offsets]
        return [(element[a:b].tobytes(), weight[a:b].tobytes()) for a, b in zip(cut[:-1], cut[1:], strict=True)]


def similarities(elements: list[np.ndarray], weights: list[np.ndarray]) -> np.ndarray:
    """Weighted Jaccard similarities of each two sets."""
    n = len(elements)
    total = np.array([w.sum(dtype=np.int64) for w in weights], float)
    every, owner = np.concatenate(elements), np.repeat(np.arange(n), [len(e) for e in elements])
    weight = np.concatenate(weights).astype(np.float32)
    order = np.argsort(every, kind="stable")
    every, owner, weight = every[order], owner[order], weight[order]
    shared = np.zeros(len(every), bool)
    same = every[1:] == every[:-1]
    shared[1:] |= same
    shared[:-1] |= same
    every, owner, weight = every[shared], owner[shared], weight[shared]
    common = np.zeros((n, n), np.float64)
    if len(every):
        column = np.cumsum(np.concatenate([[0], every[1:] != every[:-1]]))
        for a in range(0, int(column[-1]) + 1, COLUMNS):
            lo, hi = np.searchsorted(column, (a, a + COLUMNS))
            m = np.zeros((n, COLUMNS), np.float32)
            m[owner[lo:hi], column[lo:hi] - a] = np.sqrt(weight[lo:hi])
            common += m @ m.T
    np.fill_diagonal(common, total)
    union = total[:, None] + total[None, :] - common
    return np.where(union > 0, common / np.maximum(union, 1e-9), 1.0)


def _forest(links: np.ndarray, n: int) -> list[tuple[int, int]]:
    """A spanning forest of the links, as (smaller, larger)."""
    root = list(range(n))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    out = []
    for a, b in links.tolist():
        x, y = find(a), find(b)
        if x != y:
            root[max(x, y)] = min(x, y)
            out.append((a, b))
    return out


def _plain(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).withColumn("md5", F.unhex(F.md5("text")))


def sign(docs: DataFrame, idf: np.ndarray) -> DataFrame:
    """doc_id, md5 of the text, digest of the weighted set, and band keys of each row."""
    shared = docs.sparkSession.sparkContext.broadcast(idf)

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                s = Shingles(part.column("text"), shared.value)
                full, bands = s.bands()
                lists = np.zeros(part.num_rows + 1, np.int64)
                lists[full + 1] = BANDS
                yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id"), "md5": part.column("md5"), "node": pa.array(s.digests(), pa.binary()), "bands": pa.ListArray.from_arrays(pa.array(np.cumsum(lists), pa.int32()), pa.array(bands.ravel().view(np.int64)))})

    return _plain(docs).mapInArrow(run, "doc_id long, md5 binary, node binary, bands array<long>")


def _set_hash(*columns) -> Column:
    """A hash of a set of distinct rows, in any order; unlike a sum it has no size it overflows at."""
    return F.bit_xor(F.xxhash64(*columns))


def _buckets(members: DataFrame) -> DataFrame:
    """(band, key, n, a, b) of each bucket of two or more: the same n, a and b tell the same members."""
    return members.groupBy("band", "key").agg(F.count(F.lit(1)).alias("n"), _set_hash("node").alias("a"), _set_hash("node", F.lit(1)).alias("b")).where("n > 1")


def members_of(nodes: DataFrame) -> DataFrame:
    """(band, key, n, node, doc_id, md5): the members of each bucket of two or more, once
    for all buckets with the same members."""
    members = nodes.select("node", "doc_id", "md5", F.posexplode("bands").alias("band", "key"))
    once = _buckets(members).groupBy("n", "a", "b").agg(F.min(F.struct("band", "key")).alias("u")).select("n", "u.band", "u.key")
    return members.join(once, ["band", "key"])


def _unit(kind: int, lo: Column, hi: Column) -> Column:
    return F.struct("band", "key", F.lit(kind).alias("kind"), lo.cast("string").alias("lo"), hi.cast("string").alias("hi")).alias("unit")


def first_units(members: DataFrame) -> DataFrame:
    """(unit, side, node, doc_id, md5): buckets of one block whole, and each block of the
    larger ones with the bucket's pivots (side 1)."""
    blocks = F.ceil(F.col("n") / F.lit(BLOCK)).cast("int")
    spread = lambda salt: F.pmod(F.xxhash64("node", F.lit(salt)), F.col("n"))
    row = ("node", "doc_id", "md5")
    none = F.lit("")
    small = members.where(F.col("n") <= BLOCK).select(_unit(ALL, none, none), F.lit(0).alias("side"), *row)
    large = members.where(F.col("n") > BLOCK).withColumns({"blocks": blocks, "pivot": spread(3) < PIVOTS})
    mine = large.where(~F.col("pivot")).select(_unit(PIVOT, F.pmod(F.xxhash64("node", F.lit(2)), F.col("blocks")), none), F.lit(0).alias("side"), *row)
    all_blocks = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")
    pivots = large.where("pivot").select("band", "key", *row, all_blocks).select(_unit(PIVOT, F.col("block"), none), F.lit(1).alias("side"), *row)
    return small.unionByName(mine).unionByName(pivots)


def second_units(members: DataFrame, roots: DataFrame) -> DataFrame:
    """As ``first_units``, for what is open in larger buckets: ``roots`` (node, root) are the
    components of the links found so far.

    Members of the bucket's largest component need no comparison with each other; the
    others, in blocks, meet each other and each block of that component."""
    found = members.where(F.col("n") > BLOCK).join(roots, "node", "left")
    sizes = found.where("root is not null").groupBy("band", "key", "root").agg(F.count(F.lit(1)).alias("size"))
    main = sizes.groupBy("band", "key").agg(F.max(F.struct("size", "root")).alias("m")).select("band", "key", F.col("m.size").alias("size"), F.col("m.root").alias("main"))
    of = found.join(main, ["band", "key"], "left").withColumns({"size": F.coalesce("size", F.lit(0)), "in_main": F.coalesce(F.col("root") == F.col("main"), F.lit(False))}).where("size < n")
    count = lambda size: F.ceil(size / F.lit(BLOCK)).cast("int")
    of = of.withColumns({"rests": count(F.col("n") - F.col("size")), "mains": count(F.col("size"))})
    of = of.withColumn("mine", F.pmod(F.xxhash64("node", F.lit(4)), F.when(F.col("in_main"), F.col("mains")).otherwise(F.col("rests"))).cast("int"))
    each = lambda n, column: F.explode(F.sequence(F.lit(0), F.col(n) - 1)).alias(column)
    row = ("node", "doc_id", "md5")
    rest, inside = of.where("not in_main").select("band", "key", *row, "mine", "rests", "mains"), of.where("in_main").select("band", "key", *row, "mine", "rests")
    pair = rest.select("band", "key", *row, "mine", each("rests", "other"))
    lo, hi = F.least("mine", "other"), F.greatest("mine", "other")
    kind = F.when(lo == hi, ALL).otherwise(CROSS)
    both = pair.select(F.struct("band", "key", kind.alias("kind"), lo.cast("string").alias("lo"), hi.cast("string").alias("hi")).alias("unit"), (F.col("mine") != lo).cast("int").alias("side"), *row)
    label = lambda column: F.concat(F.lit("m"), column.cast("string"))
    outer = rest.where("mains > 0").select("band", "key", *row, "mine", each("mains", "other")).select(_unit(CROSS, F.col("mine"), label(F.col("other"))), F.lit(0).alias("side"), *row)
    inner = inside.select("band", "key", *row, "mine", each("rests", "other")).select(_unit(CROSS, F.col("other"), label(F.col("mine"))), F.lit(1).alias("side"), *row)
    return both.unionByName(outer).unionByName(inner)


def _allowed(kind: int, side: np.ndarray) -> np.ndarray | bool:
    """Which members of a unit are compared."""
    if kind == ALL:
        return True
    cross = side[:, None] != side[None, :]
    return cross if kind == CROSS else cross | (side[:, None] + side[None, :] == 2)


def links(docs: DataFrame, units: DataFrame, idf: np.ndarray, threshold: float) -> DataFrame:
    """(a, b) nodes whose whole texts' weighted Jaccard similarity reaches the threshold:
    a spanning forest of each unit's."""
    shared = docs.sparkSession.sparkContext.broadcast(idf)
    wanted = units.select("doc_id", "md5").distinct()
    if wanted.count() <= BROADCAST_KEYS:
        wanted = F.broadcast(wanted)
    plain = _plain(docs)
    texts = plain.join(wanted.withColumnsRenamed({"doc_id": "d", "md5": "m"}), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("md5") == F.col("m")), "left_semi")

    def vectors(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                got = Shingles(part.column("text"), shared.value).vectors()
                yield pa.RecordBatch.from_pydict({"md5": part.column("md5"), "elements": pa.array([g[0] for g in got], pa.binary()), "weights": pa.array([g[1] for g in got], pa.binary())})

    def compare(batches):
        for number, rows in enumerate(_groups(batches)):
            if number % 16 == 0:
                release()
            node, first = np.unique(np.array([x.hex() for x in rows.column("node").to_pylist()]), return_index=True)
            unit = json.loads(rows.column("unit")[0].as_py())
            pick = pa.array(first)
            side = rows.column("side").to_numpy()[first]
            e = [np.frombuffer(x, "<u8") for x in rows.column("elements").take(pick).to_pylist()]
            w = [np.frombuffer(x, np.uint8) for x in rows.column("weights").take(pick).to_pylist()]
            near = (similarities(e, w) >= threshold - 1e-9) & _allowed(unit["kind"], side)
            found = _forest(np.argwhere(np.triu(near, 1)), len(node))
            if found:
                yield pa.RecordBatch.from_pydict({"a": pa.array([bytes.fromhex(node[i]) for i, _ in found], pa.binary()), "b": pa.array([bytes.fromhex(node[j]) for _, j in found], pa.binary())})
        release()

    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    joined = units.drop("doc_id").join(texts.select("md5", "text").mapInArrow(vectors, "md5 binary, elements binary, weights binary"), "md5")
    dealt = joined.select(F.col("unit"), "side", "node", "elements", "weights").repartition(parts, "unit").sortWithinPartitions("unit")
    flat = dealt.select(F.to_json("unit").alias("unit"), "side", "node", "elements", "weights")
    return flat.mapInArrow(compare, "a binary, b binary").distinct()


def _groups(batches):
    """The rows of one unit after the other; they come sorted."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        unit = np.asarray(batch.column("unit").dictionary_encode().indices)
        at = 0
        for to in [*(np.flatnonzero(np.diff(unit)) + 1).tolist(), len(unit)]:
            if to == at:
                continue
            if held and held[0].column("unit")[0] != batch.column("unit")[at]:
                yield pa.Table.from_batches(held).combine_chunks()
                held = []
            held.append(batch.slice(at, to - at))
            at = to
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of the edges (a, b): root is its component's least node.

    Large-star and small-star (Kiveris et al. 2014) in turn until nothing changes; each
    round is written to the shared folder.
    """
    state, before, spark = None, None, edges.sparkSession
    while True:
        edges, path = storage.table(edges, "edges")
        if before:
            storage.delete(spark, before)
        before = path
        seen = edges.agg(F.count(F.lit(1)).alias("n"), _set_hash("a", "b").alias("h")).first()
        if seen == state:
            return edges.select(F.col("b").alias("node"), F.col("a").alias("root")).union(edges.select("a", "a").distinct())
        state = seen
        both = edges.union(edges.select("b", "a"))
        least = both.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, both["a"] == least["u"]).where("b > u").select(F.col("m").alias("a"), "b").distinct()
        least = large.groupBy(F.col("b").alias("u")).agg(F.min("a").alias("m"))
        edges = large.join(least, large["b"] == least["u"]).select(F.explode(F.array(F.struct(F.col("m").alias("a"), F.col("u").alias("b")), F.struct(F.col("m").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.a", "e.b").where("a < b").distinct()


def _joined(roots: DataFrame, more: DataFrame) -> DataFrame:
    """``roots`` after more links: only components that a link joins are looked at again."""
    of = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root"))
    ends = [F.coalesce(F.col(f"{c}_root"), F.col(c)) for c in "ab"]
    new = more.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.least(*ends).alias("a"), F.greatest(*ends).alias("b")).where("a <> b").distinct()
    new = storage.materialize(new, "joins")
    if new.isEmpty():
        return roots
    over = components(new).select(F.col("node").alias("root"), F.col("root").alias("top"))
    known = roots.join(over, "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    single = over.select(F.col("root").alias("node"), F.col("top").alias("root")).join(roots.select("node"), "node", "left_anti")
    return known.unionByName(single)


def classes(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, md5 (of the text), class_id and class_md5 of each row: a class is named
    by its least (doc_id, md5).

    Null text is empty; texts without words are all copies of each other; texts of one
    to four words are near only if their words are the same; repeated rows are in one
    class; other columns are ignored; an empty table gives no rows.
    """
    plain = docs.select("doc_id", "text")
    idf = word_idf(*word_frequencies(plain.select(F.col("text").cast("string").alias("text"))))
    signed = storage.materialize(sign(plain, idf), "signed")
    nodes = storage.materialize(signed.groupBy("node").agg(F.min(F.struct("doc_id", "md5", "bands")).alias("s")).select("node", "s.doc_id", "s.md5", "s.bands"), "nodes")
    members = storage.materialize(members_of(nodes), "members")
    roots = components(links(plain, storage.materialize(first_units(members), "units"), idf, threshold))
    rest, path = storage.table(second_units(members, roots), "units")
    if rest.isEmpty():
        storage.delete(docs.sparkSession, path)
    else:
        roots = _joined(roots, links(plain, rest, idf, threshold))
    by_node = nodes.select("node", "doc_id", "md5").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = by_node.groupBy("root").agg(F.min(F.struct("doc_id", "md5")).alias("first"))
    of_node = by_node.join(least, "root").select("node", F.col("first.doc_id").alias("class_id"), F.col("first.md5").alias("class_md5"))
    return signed.select("doc_id", "md5", "node").join(of_node, "node").select("doc_id", "md5", "class_id", "class_md5")


def _unused(name: str, columns: list[str]) -> str:
    """The name, with as many underscores as it takes to be no column's."""
    taken = {c.lower() for c in columns}
    while name in taken:
        name = "_" + name
    return name


def keep_one(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with one row of each class, its least (doc_id, md5); all columns stay,
    whatever their names.

    Null and empty texts, and texts without words, are one class; of repeated rows one
    stays; an empty table gives no rows.
    """
    key_id, key_md5 = (_unused(name, docs.columns) for name in ("key_id", "key_md5"))
    found = storage.materialize(classes(docs, threshold), "classes")
    first = F.col("doc_id").eqNullSafe(F.col("class_id")) & (F.col("md5") == F.col("class_md5"))
    text = F.unhex(F.md5(F.coalesce(docs["text"].cast("string"), F.lit(""))))
    is_row = lambda k: docs["doc_id"].cast("long").eqNullSafe(k[key_id]) & (text == k[key_md5])

    def keyed(rows: DataFrame) -> DataFrame:
        rows = rows.select(F.col("doc_id").alias(key_id), F.col("md5").alias(key_md5))
        return F.broadcast(rows) if rows.count() <= BROADCAST_KEYS else rows

    gone = keyed(found.where(~first).select("doc_id", "md5").distinct())
    kept = docs.join(gone, is_row(gone), "left_anti")
    again = found.where(first).groupBy("doc_id", "md5").count().where("count > 1")
    if again.isEmpty():
        return kept
    again = keyed(again)  # rows that are there more than once
    once = docs.join(again, is_row(again), "inner").dropDuplicates([key_id, key_md5]).drop(key_id, key_md5)
    return kept.join(again, is_row(again), "left_anti").unionByName(once)


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of each document: class_id and class_md5 are its least row's doc_id and text digest.

    Null and empty texts, and texts without words, are one class; repeated rows are in one
    class; an empty table gives no rows.
    """
    return classes(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "class_id", F.lower(F.hex("class_md5")).alias("class_md5"))
