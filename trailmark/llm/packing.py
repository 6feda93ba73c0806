"""Mixture-controlled packing by deficit round-robin over source queues.

Every source is a queue of tokens (its documents one after the other).  The output
is cut into segments; segment ``j`` takes of queue ``q`` the tokens from ``b_q(j)`` to
``b_q(j + 1)``, where ``b_q(j)`` is ``rate_q * j`` rounded down to a multiple of
``min_serve``, and the rates of all queues add up to a segment in the target
proportions; a queue's last segment takes its rest.  What a queue is owed at a
segment's border, ``rate_q * j - b_q(j)``, is its carried deficit, known in closed
form, so segments are packed independently.  Inside a segment every window
(a sequence) adds its share of the window to each queue's deficit and serves queues
in turn as far as their deficits go, in turns of ``min_serve`` tokens at least; what
a queue is owed, or has had beyond its share, goes to the next window.

Nothing is dropped: a queue that runs empty leaves its part to the others.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import bpe, storage
from .textkernel import release, slices

SEQUENCE_TOKENS = 1024
SEGMENT_SEQUENCES = 1024
MIN_SERVE = 128
#: With more distinct sources than this, half of the queues go to the largest sources (and
#: one more to each that has a weight); the small ones share the others by hash, which
#: bounds the plan's size.
MAX_QUEUES = 4096
#: Rows of the table of queue offsets up to which it is broadcast (about 40 bytes each).
BROADCAST_ROWS = 500_000


def _own_queue(source: str | None) -> str | None:
    """The name of a source's own queue; shared ones are '#' and a number."""
    return None if source is None else "=" + source


def with_queue(docs: DataFrame, named: Iterable[str | None] = ()) -> DataFrame:
    """``docs`` with its sources' queues.  Null and the ``named`` sources have their own."""
    source = F.col("source")
    own = F.concat(F.lit("="), source)
    if docs.select("source").distinct().count() <= MAX_QUEUES:
        return docs.withColumn("queue", own)
    size = F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 1)
    largest = docs.where(source.isNotNull()).groupBy("source").agg(size.alias("size")).orderBy(F.desc("size"), "source").limit(MAX_QUEUES // 2)
    alone = sorted({r["source"] for r in largest.collect()} | {s for s in named if s is not None})
    shared = F.concat(F.lit("#"), F.pmod(F.xxhash64("source"), F.lit(MAX_QUEUES - MAX_QUEUES // 2)).cast("string"))
    return docs.withColumn("queue", F.when(source.isNull() | source.isin(alone), own).otherwise(shared))


def tokenize(docs: DataFrame, vocabulary: str, end: int, named: Iterable[str | None] = ()) -> DataFrame:
    """doc_id, source, ids of each document and where it stands in its task's part
    of its queue.  Null texts are empty; a null source is a source of its own."""

    def run(batches):
        coder = bpe.encoder(vocabulary)
        part, row, at = TaskContext.get().partitionId(), 0, {}
        for batch in batches:
            for piece in slices(batch, "text", bpe.SLICE_BYTES):
                ids, offsets = coder.encode(piece.column("text"), end)
                n = piece.num_rows
                queues, sizes = piece.column("queue").to_pylist(), np.diff(offsets)
                starts = np.empty(n, np.int64)
                for i, (s, size) in enumerate(zip(queues, sizes.tolist(), strict=True)):
                    starts[i] = at.get(s, 0)
                    at[s] = int(starts[i]) + size
                ids = ids.astype("<u4") if ids.dtype != np.uint16 else ids
                data = pa.LargeBinaryArray.from_buffers(pa.large_binary(), n, [None, pa.py_buffer((offsets * ids.itemsize).astype(np.int64)), pa.py_buffer(ids)]).cast(pa.binary())
                yield pa.RecordBatch.from_pydict({"part": pa.array(np.full(n, part, np.int32)), "row": pa.array(np.arange(row, row + n)), "doc_id": piece.column("doc_id"), "source": piece.column("source"), "queue": piece.column("queue"), "n": pa.array(sizes), "start": pa.array(starts), "width": pa.array(np.full(n, ids.itemsize, np.int32)), "ids": data})
                row += n

    kind = "part int, row long, doc_id long, source string, queue string, n long, start long, width int, ids binary"
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text"))
    return with_queue(docs, named).mapInArrow(run, kind)


def pack(docs: DataFrame, weights: dict[str | None, float] | None = None, vocabulary: str | None = None, end: int = 0, sequence_tokens: int = SEQUENCE_TOKENS, segment_sequences: int = SEGMENT_SEQUENCES, min_serve: int = MIN_SERVE, with_ids: bool = True) -> DataFrame:
    """Pack all documents into sequences of ``sequence_tokens``.

    ``weights``: target token proportions by source (a source that isn't named has
    its natural share); by default all have their shares of the corpus, which every
    window then keeps to the end.  A sequence that ends a segment may be shorter.

    Returns a row for each piece: doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset, source and, if wanted, ids.  Repeated documents are packed
    each; an empty table gives no rows; a document with a null id is packed too.
    """
    spark = docs.sparkSession
    vocabulary = vocabulary or bpe.vocabulary_path()
    rows = storage.materialize(tokenize(docs, vocabulary, end, weights or ()), "tokens")
    totals = {r["queue"]: r["n"] for r in rows.groupBy("queue").agg(F.sum("n").alias("n")).collect()}  # MAX_QUEUES + 1 rows and the named sources at most
    names = sorted(totals, key=lambda s: (s is not None, s or ""))
    number = {s: i for i, s in enumerate(names)}
    grand = sum(totals.values()) or 1
    wanted = {_own_queue(s): x for s, x in (weights or {}).items()}
    share = np.array([wanted.get(s, totals[s] / grand) for s in names], float)  # a shared queue: the sum of its sources' natural shares
    segment = sequence_tokens * segment_sequences
    rates = np.maximum(share / (share.sum() or 1) * segment, 1e-3)
    last = np.maximum(np.ceil(np.array([totals[s] for s in names]) / rates).astype(np.int64) - 1, 0)
    ids_per_segment = segment_sequences + 2 + -(-2 * len(names) * min_serve // sequence_tokens)

    known = [x for s in names if s is not None for x in (F.lit(s), F.lit(number[s]))]
    code = F.create_map(*known)[F.col("queue")] if known else F.lit(None)
    rows = rows.withColumn("queue", F.coalesce(code, F.lit(number.get(None, 0))).cast("int"))
    offsets = rows.groupBy("part", "queue").agg(F.sum("n").alias("n"))
    before = Window.partitionBy("queue").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = storage.materialize(offsets.select("part", "queue", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")), "offsets")
    small = offsets.count() <= BROADCAST_ROWS
    placed = rows.join(F.broadcast(offsets) if small else offsets, ["part", "queue"])

    def place(batches):
        bpe.forget()
        for batch in batches:
            yield from _place(batch, rates, last, min_serve)
            release()

    kind = "segment long, queue int, at long, doc_id long, start long, n long, doc_tokens long, width int, source string, ids binary"
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = placed.select("queue", "base", "start", "doc_id", "n", "width", "source", "ids").mapInArrow(place, kind).repartition(parts, "segment").sortWithinPartitions("segment", "queue", "at")

    def fill(batches):
        for j, rows in _segments(batches):
            yield from _fill(j, rows, rates, last, sequence_tokens, min_serve, ids_per_segment, with_ids)
            release()

    out = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, source string" + ", ids binary" * with_ids
    return dealt.mapInArrow(fill, out)


def _border(j: np.ndarray, rate: np.ndarray, step: int) -> np.ndarray:
    """Tokens that a queue has given before segment ``j``, short of its last one."""
    return np.floor(rate * j / step).astype(np.int64) * step


def _segment_of(at: np.ndarray, rate: np.ndarray, last: np.ndarray, step: int) -> np.ndarray:
    """The segment that takes the token ``at`` of a queue."""
    j = np.ceil((at // step + 1) * step / rate).astype(np.int64) - 1
    j -= _border(j, rate, step) > at  # rounding of the division
    j += _border(j + 1, rate, step) <= at
    return np.minimum(j, last)


def _place(batch: pa.RecordBatch, rates: np.ndarray, lasts: np.ndarray, step: int) -> Iterator[pa.RecordBatch]:
    """Cut documents where segments end."""
    if not batch.num_rows:
        return
    col = lambda c: batch.column(c).to_numpy(zero_copy_only=False)
    queue, n, width = col("queue"), col("n"), col("width")
    at = col("base") + col("start")
    rate, end = rates[queue], lasts[queue]
    first, last = _segment_of(at, rate, end, step), _segment_of(at + n - 1, rate, end, step)
    cut = np.flatnonzero(first != last)
    row, lo, hi, seg = [np.flatnonzero(first == last)], [], [], []
    lo.append(np.zeros(len(row[0]), np.int64))
    hi.append(n[row[0]])
    seg.append(first[row[0]])
    for i in cut:
        chunk = np.unique(np.concatenate([at[i : i + 1], np.arange(-(-at[i] // step), -(-(at[i] + n[i]) // step)) * step]))  # a segment begins at a multiple of the step
        j, begin = np.unique(_segment_of(chunk, np.full(len(chunk), rate[i]), end[i], step), return_index=True)
        starts = chunk[begin] - at[i]
        for to, x in ((row, np.full(len(j), i)), (lo, starts), (hi, np.append(starts[1:], n[i])), (seg, j)):
            to.append(x)
    row, lo, hi, seg = (np.concatenate(x) for x in (row, lo, hi, seg))
    order = np.lexsort((lo, row))
    row, lo, hi, seg = row[order], lo[order], hi[order], seg[order]
    # In this order the pieces fill the batch's ids without a gap, so the ids stay where they are.
    data = batch.column("ids").cast(pa.large_binary())
    offsets = np.frombuffer(data.buffers()[1], np.int64)[data.offset : data.offset + len(data) + 1]
    bounds = np.append(offsets[row] + lo * width[row], offsets[-1])
    ids = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(row), [None, pa.py_buffer(bounds), data.buffers()[2]]).cast(pa.binary())
    pick = pa.array(row)
    yield pa.RecordBatch.from_pydict({"segment": pa.array(seg), "queue": pa.array(queue[row], pa.int32()), "at": pa.array(at[row] + lo), "doc_id": batch.column("doc_id").take(pick), "start": pa.array(lo), "n": pa.array(hi - lo), "doc_tokens": pa.array(n[row]), "width": pa.array(width[row], pa.int32()), "source": batch.column("source").take(pick), "ids": ids})


def _segments(batches) -> Iterator[tuple[int, pa.Table]]:
    """The rows of one segment after the other; they come sorted."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        seg = batch.column("segment").to_numpy(zero_copy_only=False)
        at = 0
        for to in [*(np.flatnonzero(np.diff(seg)) + 1).tolist(), len(seg)]:
            if to == at:
                continue
            if held and held[0].column("segment")[0].as_py() != seg[at]:
                yield held[0].column("segment")[0].as_py(), pa.Table.from_batches(held).combine_chunks()
                held = []
            held.append(batch.slice(at, to - at))
            at = to
    if held:
        yield held[0].column("segment")[0].as_py(), pa.Table.from_batches(held).combine_chunks()


def schedule(sizes: np.ndarray, owed: np.ndarray, window: int, min_serve: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Deficit round-robin: (queue, tokens, window) of each turn, in output order.

    ``sizes``: tokens of each queue; each gets ``window * size / total`` a window.
    """
    left, deficit = sizes.tolist(), owed.tolist()
    total = sum(left)
    quantum = [window * s / total for s in left] if total else []
    queues, turn, out, w = [q for q, s in enumerate(left) if s], 0, [], 0
    while queues:
        room = window
        for q in queues:
            deficit[q] += quantum[q]
        k = len(queues)
        for i in range(k):  # in turn, as far as deficits go
            q = queues[(turn + i) % k]
            give = min(int(deficit[q]), left[q], room)
            if give > 0 and (give >= min_serve or give == left[q]):
                out.append((q, give, w))
                left[q] -= give
                deficit[q] -= give
                room -= give
        while room:  # the rest to those who are owed most, beyond their shares if need be
            q = max((x for x in queues if left[x]), key=lambda x: deficit[x], default=None)
            if q is None:
                break
            give = min(room, left[q], max(min_serve, int(deficit[q])))
            out.append((q, give, w))
            left[q] -= give
            deficit[q] -= give
            room -= give
        turn += 1
        w += 1
        if any(not left[q] for q in queues):
            queues = [q for q in queues if left[q]]
    return tuple(np.array([x[i] for x in out], np.int64) for i in range(3))


def _fill(j: int, rows: pa.Table, rates: np.ndarray, lasts: np.ndarray, window: int, min_serve: int, per_segment: int, with_ids: bool) -> Iterator[pa.RecordBatch]:
    rows = rows.combine_chunks()
    col = lambda c: rows.column(c).to_numpy()
    queue, n, start, width = col("queue"), col("n"), col("start"), col("width")
    names, local = np.unique(queue, return_inverse=True)
    sizes = np.bincount(local, n, len(names)).astype(np.int64)
    owed = np.where(j <= lasts[names], rates[names] * j - _border(j, rates[names], min_serve), 0.0)
    q, give, w = schedule(sizes, owed, window, min_serve)
    # Positions count through the segment's queues, one after the other.
    base = np.cumsum(sizes) - sizes
    order = np.argsort(q, kind="stable")
    turn_at = np.empty(len(q), np.int64)
    turn_at[order] = np.cumsum(give[order]) - give[order]
    filled = np.cumsum(give) - give
    first = np.searchsorted(w, w)
    offset = filled - filled[first]
    by_place = np.argsort(turn_at)
    row_at = np.cumsum(n) - n
    cuts = np.union1d(turn_at, row_at)
    ends = np.append(cuts[1:], base[-1] + sizes[-1])
    row = np.searchsorted(row_at, cuts, "right") - 1
    turn = by_place[np.searchsorted(turn_at[by_place], cuts, "right") - 1]
    data = rows.column("ids").combine_chunks()
    raw = b"".join(data.to_pylist())
    ids = np.frombuffer(raw, "<u2" if width[0] == 2 else "<u4").astype("<u4")
    view = memoryview(ids).cast("B")
    crc = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(cuts.tolist(), ends.tolist(), strict=True)]
    pick = pa.array(row)
    columns = {
        "doc_id": rows.column("doc_id").combine_chunks().take(pick),
        "start": pa.array(start[row] + cuts - row_at[row]),
        "length": pa.array(ends - cuts),
        "ids_crc32": pa.array(crc, pa.int64()),
        "doc_tokens": rows.column("doc_tokens").combine_chunks().take(pick),
        "sequence_id": pa.array(j * per_segment + w[turn]),
        "offset": pa.array(offset[turn] + cuts - turn_at[turn]),
        "source": rows.column("source").combine_chunks().take(pick),
    }
    if with_ids:
        columns["ids"] = pa.array([bytes(view[4 * a : 4 * b]) for a, b in zip(cuts.tolist(), ends.tolist(), strict=True)], pa.binary())
    yield pa.RecordBatch.from_pydict(columns)


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed at their sources' natural proportions; the contract's columns.

    Null and empty texts have the end token alone; a null source is a source of its own;
    repeated rows are packed each; an empty table gives no rows.
    """
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), with_ids=False).drop("source")
