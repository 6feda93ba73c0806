"""Language-model scoring: a hashed maximum-entropy model with class-factored softmax.

A token's probability is P(class | history) * P(slot | class, history) * P(token | slot).
Its class is a hash of its last bytes, so the class of a token that was never seen is
known too.  The most frequent tokens of a class have slots of their own; the last slot
is for all others, and only in there is a token told by its (smoothed) relative
frequency.  Both softmaxes read hashed n-gram and skip features (for slots joined with
the class), whose number grows with the counted vocabulary, and both are trained by
rounds of distributed gradient updates: each task runs minibatch steps on its own
training documents and the parameters are averaged.

Token counts cover all training documents.  Frequent tokens (a bounded table) are
looked up in memory; the others go through a join on the token's key.  A token of the
join holds less than 1.1 / HEAD of all tokens, or it would be in memory, so there is no
hot key.  A token is identified by a 64-bit key (59 bits of hash and its class) and its
first eight bytes: tokens of up to eight bytes never meet, and of 10^11 longer ones two
meet with a chance of one in thousands at most if they also begin alike.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import storage
from .bpe import ragged
from .docstats import crc_mod
from .textkernel import MASKS, Words, bytes_from, first_bytes, mix, slices

FOLDS, HELD_OUT = 10, 0
CLASSES = 64
#: Slots of a class: its most frequent tokens and, last, all others.
SLOTS = 64
REST = SLOTS - 1
#: Tokens in the in-memory table; the bound of what is broadcast (20 bytes each).
HEAD = 1 << 18
#: Tokens a counting task holds before it passes their counts on.
HELD_TOKENS = 1 << 22
ALPHA = 0.1
#: A hashed table has a row for so many distinct tokens, from 2^10 rows up to 2^13: the weights are 12 MB at most.
TOKENS_A_ROW, LEAST_BITS, MOST_BITS = 16, 10, 13
NONE = CLASSES  # the class before the first token
PAIRS = (CLASSES + 1) ** 2
ROUNDS = 2
#: One in so many positions of every training document trains, in one of the rounds.
THIN = 1
#: Training tokens for each task's update (as large as the weights): fewer, and small partitions train together.
TASK_TOKENS = 1 << 22
BLOCKS = 64
#: Updates that are added up together at first, so that no task adds up those of all tasks.
SALT = 64
MINIBATCH = 4096
RATE = 0.15
UNUSED, MOST_LOGIT = -30.0, 60.0
AT_ONCE = 4
END = np.uint64(0xE0D0E0D0E0D0E0C0)
#: Bytes of text at once: what numpy makes of them stays in a core's cache.
SLICE_BYTES = 1 << 18


def token_keys(arr: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(keys, first bytes, offsets) of each text's tokens: lower-cased words, then one end."""
    w = Words(arr, lower=True)
    n = len(w.counts)
    keys, spelling = np.empty(len(w.hash) + n, np.uint64), np.zeros(len(w.hash) + n, np.uint64)
    offsets = w.first + np.arange(n + 1)
    begin = first_bytes(w.data, w.starts, w.ends)
    size = np.minimum(w.ends - w.starts, 3)
    last = (bytes_from(w.data)[w.ends] & MASKS[3]) >> (8 * (3 - size)).astype(np.uint64)
    place = np.ones(len(keys), bool)
    place[offsets[1:] - 1] = False
    keys[place] = (w.hash & ~np.uint64(CLASSES - 1)) | (mix(last) % np.uint64(CLASSES))
    spelling[place] = begin
    keys[~place] = END
    return keys, spelling, offsets


def class_of(keys: np.ndarray) -> np.ndarray:
    return (keys & np.uint64(CLASSES - 1)).astype(np.int64)


def _counted(keys: np.ndarray, spelling: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Counts of tokens; one may come twice if another shares its key, which sums later mend."""
    order = np.argsort(keys)
    keys, spelling = keys[order], spelling[order]
    new = np.ones(len(keys), bool)
    new[1:] = (keys[1:] != keys[:-1]) | (spelling[1:] != spelling[:-1])
    at = np.flatnonzero(new)
    return keys[at], spelling[at], np.diff(np.append(at, len(keys)))


def count_tokens(docs: DataFrame) -> DataFrame:
    """(key, spelling, n) over all texts; tasks add up before they shuffle."""

    def run(batches):
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def out():
            keys, spelling, n = _counted(*(np.concatenate(x) for x in zip(*held, strict=True)))
            held.clear()
            return pa.RecordBatch.from_pydict({"key": keys.view(np.int64), "spelling": spelling.view(np.int64), "n": n})

        for batch in batches:
            for part in slices(batch, "text", SLICE_BYTES):
                held.append(token_keys(part.column("text"))[:2])
                if sum(len(k) for k, _ in held) > HELD_TOKENS:
                    yield out()
        if held:
            yield out()

    return docs.select("text").mapInArrow(run, "key long, spelling long, n long").groupBy("key", "spelling").agg(F.sum("n").alias("n"))


class Vocabulary:
    """What scoring holds in memory: totals, slots, and the frequent tokens."""

    def __init__(self, keys: np.ndarray, spelling: np.ndarray, counts: np.ndarray, class_tokens: np.ndarray, class_types: np.ndarray):
        order = np.lexsort((spelling, keys))
        self.keys, self.spelling, self.counts = keys[order], spelling[order], counts[order]
        self.tokens, self.types = int(class_tokens.sum()), int(class_types.sum())
        classes = class_of(self.keys)
        ranked = np.lexsort((self.spelling, self.keys, -self.counts, classes))
        first = np.searchsorted(classes[ranked], np.arange(CLASSES))
        self.slot = np.empty(len(ranked), np.int64)
        self.slot[ranked] = np.minimum(np.arange(len(ranked)) - first[classes[ranked]], REST)
        own = self.slot < REST
        slots = np.bincount(classes[own] * SLOTS + self.slot[own], self.counts[own], CLASSES * SLOTS).reshape(CLASSES, SLOTS).astype(float)
        rest_tokens = class_tokens - slots.sum(1)
        rest_types = class_types - np.bincount(classes[own], minlength=CLASSES)
        self.rest_log = np.log10(rest_tokens + ALPHA * (rest_types + 1))
        slots[:, REST] = rest_tokens + ALPHA * (rest_types + 1)
        with np.errstate(divide="ignore"):
            self.slot_bias = np.maximum(np.log(slots / slots.sum(1, keepdims=True)), UNUSED).astype(np.float32)
        prior = class_tokens + 1.0
        self.class_bias = np.log(prior / prior.sum()).astype(np.float32)
        self.base_log = math.log10(self.tokens + ALPHA * (self.types + 1))
        count_log = np.log10(self.counts + ALPHA)
        self.base = count_log - self.base_log
        self.within = np.where(own, 0.0, count_log - self.rest_log[classes])
        bits = 20
        self.shift = np.uint64(64 - bits)
        self.first = np.searchsorted(self.keys, np.arange(1 << bits, dtype=np.uint64) << self.shift).astype(np.int32)
        rows = max(self.types // TOKENS_A_ROW, 1)
        self.hashed = 1 << min(max(rows.bit_length(), LEAST_BITS), MOST_BITS)

    def find(self, keys: np.ndarray, spelling: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in the table, is it there) of each token."""
        if not len(self.keys):
            return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
        at = self.first[(keys >> self.shift).astype(np.int64)].astype(np.int64)
        last = len(self.keys) - 1
        np.minimum(at, last, out=at)
        behind = lambda i, k, s: (self.keys[i] < k) | ((self.keys[i] == k) & (self.spelling[i] < s))
        todo = np.flatnonzero(behind(at, keys, spelling))
        while len(todo):
            at[todo] += 1
            todo = todo[at[todo] <= last]
            todo = todo[behind(at[todo], keys[todo], spelling[todo])]
        np.minimum(at, last, out=at)
        return at, (self.keys[at] == keys) & (self.spelling[at] == spelling)

    def slots_of(self, place: np.ndarray, known: np.ndarray) -> np.ndarray:
        return np.where(known, self.slot[place], REST) if len(self.slot) else np.full(len(place), REST)

    @property
    def rows(self) -> int:
        """Rows of the weight table: hashed words one and two back, the same joined with the
        class; pairs of classes one and two and three and four back; the class before joined
        with the class."""
        return 4 * self.hashed + 2 * PAIRS + (CLASSES + 1) * CLASSES

    def weights(self) -> np.ndarray:
        """What a position has at first: the frequencies of classes and of their slots."""
        out = np.zeros((self.rows, CLASSES), np.float32)
        pairs = 4 * self.hashed
        out[pairs : pairs + PAIRS] = self.class_bias
        out[pairs + 2 * PAIRS :] = np.tile(self.slot_bias, (CLASSES + 1, 1))
        return out


def learn_vocabulary(counts: DataFrame, head: int = HEAD) -> tuple[Vocabulary, int]:
    """The vocabulary of a written (key, spelling, n) table, and the count level from which
    a token is in memory: the least at which at most ``head`` tokens are."""
    level = F.floor(F.log2("n") * 8).cast("int")
    by_level = {r["level"]: r["types"] for r in counts.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("types")).collect()}
    least, held = 1 << 20, 0
    for k in sorted(by_level, reverse=True):
        if held + by_level[k] > head:
            break
        held, least = held + by_level[k], k
    frequent = counts.where(level >= least).toArrow()  # at most ``head`` rows
    each = {r["c"]: r for r in counts.groupBy(F.col("key").bitwiseAND(F.lit(CLASSES - 1)).alias("c")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("types")).collect()}
    tokens = np.array([each[c]["n"] if c in each else 0 for c in range(CLASSES)], float)
    types = np.array([each[c]["types"] if c in each else 0 for c in range(CLASSES)], float)
    column = lambda c: frequent.column(c).to_numpy().astype(np.int64)
    return Vocabulary(column("key").view(np.uint64), column("spelling").view(np.uint64), column("n"), tokens, types), least


def features(keys: np.ndarray, classes: np.ndarray, start: np.ndarray, at: np.ndarray, hashed: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of the weight table that positions ``at`` read for their class and their slot;
    ``start``: where each position's document begins."""
    begin = start[at]
    back, word = [], []
    for j in range(1, 5):
        place = at - j
        inside = place >= begin
        place = np.maximum(place, 0)
        back.append(np.where(inside, classes[place], NONE))
        if j < 3:
            word.append(np.where(inside, keys[place] >> np.uint64(16), np.uint64(0)))
    mask, c = np.uint64(hashed - 1), classes[at]
    outer, inner = np.empty((4, len(at)), np.int32), np.empty((3, len(at)), np.int32)
    outer[0], outer[1] = word[0] & mask, hashed + (word[1] >> np.uint64(8) & mask).astype(np.int64)
    outer[2] = 4 * hashed + back[0] * (CLASSES + 1) + back[1]
    outer[3] = 4 * hashed + PAIRS + back[2] * (CLASSES + 1) + back[3]
    salt = c.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for j in range(2):
        inner[j] = (2 + j) * hashed + ((word[j] ^ salt) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(40) & mask).astype(np.int64)
    inner[2] = 4 * hashed + 2 * PAIRS + back[0] * CLASSES + c
    return outer, inner


def _logits(weights: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Sums of each column's rows, kept where float32 can hold their exponentials."""
    out = weights.take(rows[0], axis=0)
    for r in rows[1:]:
        out += weights.take(r, axis=0)
    return np.clip(out, -MOST_LOGIT, MOST_LOGIT, out=out)


def _row_sums(x: np.ndarray) -> np.ndarray:
    return np.einsum("ij->i", x)


def _row_gradients(row: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct rows, the sum of ``p`` over each one's positions).

    The first few positions of all rows add up together; the rest is for frequent rows."""
    # A feature's rows span less than 2^16, so 16 bits tell them apart (and sort by radix).
    order = np.argsort(row.astype(np.uint16), kind="stable")
    sorted_row = row[order]
    first = np.flatnonzero(np.concatenate([[True], sorted_row[1:] != sorted_row[:-1]]))
    size = np.diff(np.append(first, len(row)))
    g = p.take(order[first], axis=0)
    some, begin = np.flatnonzero(size > 1), first
    for j in range(1, AT_ONCE):
        g[some] += p.take(order[begin[some] + j], axis=0)
        some = some[size[some] > j + 1]
    if len(some):
        rest = size[some] - AT_ONCE
        at = ragged(begin[some] + AT_ONCE, rest)
        # Pairs of columns add up as complex numbers, in half the steps.
        g[some] += np.add.reduceat(p.take(order[at], axis=0).view(np.complex64), np.cumsum(rest) - rest, axis=0).view(np.float32)
    return sorted_row[first], g


def _steps(weights: np.ndarray, scale: np.ndarray, rows: np.ndarray, target: np.ndarray) -> None:
    """Adagrad minibatch steps of a softmax, in place; a position counts the same in a short last one."""
    share = np.float32(1 / MINIBATCH)
    for a in range(0, rows.shape[1], MINIBATCH):
        r, y = rows[:, a : a + MINIBATCH], target[a : a + MINIBATCH]
        p = _logits(weights, r)
        np.exp(p, out=p)
        p *= (share / _row_sums(p))[:, None]
        p[np.arange(len(y)), y] -= share
        for row in r:
            hit, g = _row_gradients(row, p)
            s = scale[hit] + np.einsum("ij,ij->i", g, g) / CLASSES
            scale[hit] = s
            g *= (RATE / np.sqrt(s))[:, None]
            weights[hit] -= g


def trained_at(keys: np.ndarray, offsets: np.ndarray, number: int, rounds: int, thin: int) -> np.ndarray:
    """Positions that train in a round: by token and place in the document, so that a
    document's rounds are disjoint and, unless thinned, cover it in whatever order rows come."""
    place = np.arange(len(keys)) - np.repeat(offsets[:-1], np.diff(offsets))
    pick = mix(keys ^ (place.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))) % np.uint64(thin * rounds)
    return np.flatnonzero(pick == np.uint64(number))


def _added(batches, group: tuple[str, ...]):
    """Sums of updates by ``group``.  A task's update is half floats, not yet times the
    positions that touched each row; sums of them are doubles."""
    sums: dict[tuple, tuple[np.ndarray, np.ndarray]] = {}
    for batch in batches:
        for row in batch.to_pylist():
            moved, touched = np.frombuffer(row["moved"], row["kind"]).astype(float), np.frombuffer(row["touched"], np.int64)
            if row["kind"] == "f2":
                moved = (moved.reshape(-1, CLASSES) * touched[:, None]).ravel()
            before = sums.get(key := tuple(row[g] for g in group))
            sums[key] = (moved, touched) if before is None else (before[0] + moved, before[1] + touched)
    for key, (moved, touched) in sums.items():
        yield _update(key[0], 0, moved, touched)


def _averaged(batches):
    """(block, step): the mean update of each row by positions."""
    for part in _added(batches, ("block",)):
        touched = np.frombuffer(part.column("touched")[0].as_py(), np.int64)
        step = np.frombuffer(part.column("moved")[0].as_py(), "f8").reshape(-1, CLASSES) / np.maximum(touched, 1)[:, None]
        yield pa.RecordBatch.from_pydict({"block": part.column("block"), "step": pa.array([step.astype("<f4").tobytes()], pa.binary())})


def _update(block: int, salt: int, moved: np.ndarray, touched: np.ndarray) -> pa.RecordBatch:
    kind = "f2" if moved.dtype == np.float16 else "f8"
    return pa.RecordBatch.from_pydict({"block": pa.array([block], pa.int32()), "salt": pa.array([salt], pa.int32()), "kind": [kind], "moved": pa.array([moved.tobytes()], pa.binary()), "touched": pa.array([touched.tobytes()], pa.binary())})


def train_weights(docs: DataFrame, vocabulary: Vocabulary, rounds: int = ROUNDS, thin: int = THIN) -> np.ndarray:
    """Parameter mixing: in each round every task starts from the shared weights, steps
    through its share of its documents' positions, and the results are averaged by positions seen.

    A task's update is as large as the weights (6 MB at most, as half floats), so small
    partitions train together; updates are added up by block of rows in two levels, in
    tasks that stream them."""
    spark = docs.sparkSession
    tasks = max(2 * spark.sparkContext.defaultParallelism, vocabulary.tokens // TASK_TOKENS)
    weights = vocabulary.weights()
    shared_vocabulary = spark.sparkContext.broadcast(vocabulary)
    size = -(-len(weights) // BLOCKS)
    kind = "block int, salt int, kind string, moved binary, touched binary"
    for number in range(rounds):
        shared = spark.sparkContext.broadcast(weights)

        def run(batches, number=number, shared=shared):
            v, start = shared_vocabulary.value, shared.value
            w, scale = start.copy(), np.full(len(start), 1e-7, np.float32)
            touched = np.zeros(len(start), np.int64)
            for batch in batches:
                for part in slices(batch, "text", SLICE_BYTES):
                    keys, spelling, offsets = token_keys(part.column("text"))
                    slot, classes = v.slots_of(*v.find(keys, spelling)), class_of(keys)
                    at = trained_at(keys, offsets, number, rounds, thin)
                    begin = np.repeat(offsets[:-1], np.diff(offsets))
                    for a in range(0, len(at), 1 << 17):
                        now = at[a : a + (1 << 17)]
                        outer, inner = features(keys, classes, begin, now, v.hashed)
                        _steps(w, scale, outer, classes[now])
                        _steps(w, scale, inner, slot[now])
                        for rows in (outer, inner):
                            touched += np.bincount(rows.ravel(), minlength=len(touched))
            moved, salt = (w - start).astype(np.float16), TaskContext.get().partitionId() // SALT
            for b in range(BLOCKS):
                rows = slice(b * size, (b + 1) * size)
                yield _update(b, salt, moved[rows], touched[rows])

        parts = docs.select("text").coalesce(tasks).mapInArrow(run, kind).repartition(BLOCKS * -(-tasks // SALT), "block", "salt")
        summed = parts.mapInArrow(lambda b: _added(b, ("block", "salt")), kind).repartition(BLOCKS, "block")
        for r in summed.mapInArrow(_averaged, "block int, step binary").collect():  # BLOCKS rows
            step = np.frombuffer(r["step"], "<f4").reshape(-1, CLASSES)
            weights[r["block"] * size : r["block"] * size + len(step)] += step
        shared.unpersist()
    return weights


def _model_scores(weights: np.ndarray, hashed: int, keys: np.ndarray, classes: np.ndarray, slot: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """log10 P(class | history) + log10 P(slot | class, history) of each token."""
    out = np.empty(len(keys))
    begin = np.repeat(offsets[:-1], np.diff(offsets))
    for a in range(0, len(keys), MINIBATCH):
        at = np.arange(a, min(a + MINIBATCH, len(keys)))
        total = np.zeros(len(at))
        for rows, target in zip(features(keys, classes, begin, at, hashed), (classes, slot), strict=True):
            z = _logits(weights, rows)
            picked = z[np.arange(len(at)), target[at]]
            np.exp(z, out=z)
            total += picked - np.log(_row_sums(z))
        out[at] = total
    return out / math.log(10)


def score_known(docs: DataFrame, vocabulary: Vocabulary, weights: np.ndarray) -> DataFrame:
    """A row for each document: what the in-memory table can tell, and its other tokens
    with their counts, which ``finish`` looks up."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((vocabulary, weights))

    def run(batches):
        v, w = shared.value
        part, row = TaskContext.get().partitionId(), 0
        for batch in batches:
            for piece in slices(batch, "text", SLICE_BYTES):
                keys, spelling, offsets = token_keys(piece.column("text"))
                n = piece.num_rows
                place, known = v.find(keys, spelling)
                total = lambda x, offsets=offsets: np.add.reduceat(x, offsets[:-1]) if len(offsets) > 1 else x[:0]
                of = lambda x, place=place, known=known: np.where(known, x[place], 0.0) if len(x) else np.zeros(len(known))
                lm = _model_scores(w, v.hashed, keys, class_of(keys), v.slots_of(place, known), offsets) + of(v.within)
                doc = np.repeat(np.arange(n), np.diff(offsets))[~known]
                rare, spelled = keys[~known], spelling[~known]
                order = np.lexsort((rare, doc))
                doc, rare, spelled = doc[order], rare[order], spelled[order]
                new = np.ones(len(rare), bool)
                new[1:] = (doc[1:] != doc[:-1]) | (rare[1:] != rare[:-1]) | (spelled[1:] != spelled[:-1])
                at = np.flatnonzero(new)
                times = np.diff(np.append(at, len(rare)))
                lists = pa.array(np.searchsorted(doc[at], np.arange(n + 1)), pa.int32())
                listed = lambda x, kind, lists=lists: pa.ListArray.from_arrays(lists, pa.array(x, kind))
                yield pa.RecordBatch.from_pydict({
                    "row": pa.array((np.int64(part) << 40) + np.arange(row, row + n)), "doc_id": piece.column("doc_id"), "n_tokens": pa.array(np.diff(offsets)),
                    "n_known": pa.array(total(known.astype(np.int64))), "base": pa.array(total(of(v.base))), "lm": pa.array(total(lm)),
                    "rare": listed(rare[at].view(np.int64), pa.int64()), "spelling": listed(spelled[at].view(np.int64), pa.int64()), "times": listed(times, pa.int32()),
                })
                row += n

    kind = "row long, doc_id long, n_tokens long, n_known long, base double, lm double, rare array<long>, spelling array<long>, times array<int>"
    return docs.select("doc_id", "text").mapInArrow(run, kind)


def finish(scored: DataFrame, counts: DataFrame, vocabulary: Vocabulary, least: int) -> DataFrame:
    """Add the tokens that aren't in memory, by a join on their keys."""
    rare = scored.select("row", F.explode(F.arrays_zip("rare", "spelling", "times")).alias("t")).select("row", F.col("t.rare").alias("key"), F.col("t.spelling").alias("spelling"), F.col("t.times").alias("times"))
    tail = counts.where(F.floor(F.log2("n") * 8).cast("int") < least)
    n = F.coalesce(F.col("n"), F.lit(0))
    log = F.log10(n + F.lit(ALPHA))
    rest_log = F.array(*(F.lit(float(x)) for x in vocabulary.rest_log))
    within = log - F.element_at(rest_log, F.col("key").bitwiseAND(F.lit(CLASSES - 1)).cast("int") + 1)
    looked_up = rare.join(tail, ["key", "spelling"], "left").select("row", (F.col("times") * (log - F.lit(vocabulary.base_log))).alias("base"), (F.col("times") * within).alias("lm"), F.when(n > 0, F.col("times")).otherwise(0).alias("known"))
    added = looked_up.groupBy("row").agg(F.sum("base").alias("more_base"), F.sum("lm").alias("more_lm"), F.sum("known").alias("more_known"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return scored.select("row", "doc_id", "n_tokens", "n_known", "base", "lm").join(added, "row", "left").select(
        "doc_id", "n_tokens", (F.col("n_known") + zero("more_known")).cast("long").alias("n_known"), F.lit(vocabulary.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + zero("more_base")).alias("base_score"), (F.col("lm") + zero("more_lm")).alias("score"),
    )


def score(docs: DataFrame, training: DataFrame) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score and score of each row of ``docs``.

    Null text is empty: it has the end token alone.  Repeated rows are scored each;
    columns other than doc_id and text are ignored; without training texts all tokens
    are unknown.
    """
    plain = lambda d: d.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    docs, training = plain(docs), plain(training)
    counts = storage.materialize(count_tokens(training), "counts")
    vocabulary, least = learn_vocabulary(counts)
    weights = train_weights(training, vocabulary)
    scored = storage.materialize(score_known(docs, vocabulary, weights), "scored")
    return finish(scored, counts, vocabulary, least)


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The score of each document by a model of those outside the held-out tenth.

    Null and empty texts have the end token alone; a null doc_id is in no training fold
    and not held out (held_out is null); repeated rows are scored each; an empty table
    gives no rows.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    got = score(docs, docs.where(crc_mod("doc_id", FOLDS) != HELD_OUT))
    return got.select("doc_id", (crc_mod("doc_id", FOLDS) == HELD_OUT).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
