"""Token ids in sorted-string-table shards.

A shard holds documents in ascending key order::

    block*  index  bloom  footer

* key: 8 big-endian bytes of the identifier with its sign bit flipped (a missing
  identifier: no bytes, so it sorts first);
* block: zstd of entries ``varint shared, varint unshared, varint bytes, key tail,
  ids`` (ids little-endian, 2 or 4 bytes each), keys prefix-compressed against the
  entry before, the first of a block whole; then the CRC-32 of the compressed bytes;
* index: for each block its last key, offset and size, so a key is found by binary
  search;
* bloom: ten bits a key, seven probes;
* footer (fixed size): offsets, counts, id width, magic.

A dataset is a folder of shards and a ``MANIFEST.json`` that names, in key order,
the shards that count.  Every attempt of a task writes a file of its own name, so
files of lost or repeated attempts are never read.
"""

from __future__ import annotations

import bisect
import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, storage
from .textkernel import slices

MAGIC = b"TMSST01\n"
BLOCK_BYTES = 1 << 18
BLOOM_BITS, BLOOM_PROBES = 10, 7
_FOOTER = struct.Struct("<QQQQQQB7x8s")


def key_of(doc_id: int | None) -> bytes:
    return b"" if doc_id is None else struct.pack(">Q", (doc_id + (1 << 63)) & (1 << 64) - 1)


def id_of(key: bytes) -> int | None:
    return struct.unpack(">Q", key)[0] - (1 << 63) if key else None


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 127) << shift
        if byte < 128:
            return value, at
        shift += 7


def _probes(key: bytes, bits: int) -> list[int]:
    h = xxhash.xxh3_128_intdigest(key)
    a, b = h & (1 << 64) - 1, h >> 64 | 1
    return [(a + i * b) % bits for i in range(BLOOM_PROBES)]


class Writer:
    """Writes one shard; keys must come in ascending order, repeated keys are kept."""

    def __init__(self, sink, width: int):
        self.sink, self.width = sink, width
        self.block, self.last, self.at, self.index, self.keys = bytearray(), b"", 0, [], []
        self.n = self.ids = 0
        self.zstd = zstandard.ZstdCompressor(level=1)

    def add(self, key: bytes, ids: np.ndarray) -> None:
        if self.n and key < self.last:
            raise ValueError("keys must ascend")
        shared = 0
        if self.block:
            most = min(len(key), len(self.last))
            while shared < most and key[shared] == self.last[shared]:
                shared += 1
        value = ids.astype(f"<u{self.width}", copy=False).tobytes()
        self.block += _varint(shared) + _varint(len(key) - shared) + _varint(len(value)) + key[shared:] + value
        self.last = key
        self.keys.append(key)
        self.n += 1
        self.ids += len(ids)
        if len(self.block) >= BLOCK_BYTES:
            self._flush()

    def _write(self, data: bytes) -> None:
        self.sink.write(data)
        self.at += len(data)

    def _flush(self) -> None:
        if self.block:
            packed = self.zstd.compress(bytes(self.block))
            self.index.append((self.last, self.at, len(packed)))
            self._write(packed + struct.pack("<I", zlib.crc32(packed)))
            self.block = bytearray()

    def close(self) -> None:
        self._flush()
        index_at = self.at
        for key, at, size in self.index:
            self._write(_varint(len(key)) + key + _varint(at) + _varint(size))
        bloom_at = self.at
        bits = max(64, -(-self.n * BLOOM_BITS // 8) * 8)
        bloom = np.zeros(bits // 8, np.uint8)
        for key in self.keys:
            for p in _probes(key, bits):
                bloom[p >> 3] |= 1 << (p & 7)
        self._write(bloom.tobytes())
        self._write(_FOOTER.pack(index_at, len(self.index), bloom_at, bits, self.n, self.ids, self.width, MAGIC))


class Reader:
    """Reads a shard from a seekable file: ``get(key)`` or in order."""

    def __init__(self, source):
        self.source = source
        size = source.size()
        footer = source.read_at(_FOOTER.size, size - _FOOTER.size)
        self.index_at, blocks, bloom_at, self.bits, self.n, self.ids, self.width, magic = _FOOTER.unpack(footer)
        if magic != MAGIC:
            raise ValueError("not a complete shard")
        data = source.read_at(bloom_at - self.index_at, self.index_at)
        self.bloom = source.read_at(self.bits // 8, bloom_at)
        self.last, self.blocks, at = [], [], 0
        for _ in range(blocks):
            n, at = _read_varint(data, at)
            self.last.append(data[at : at + n])
            offset, at = _read_varint(data, at + n)
            length, at = _read_varint(data, at)
            self.blocks.append((offset, length))
        self.zstd = zstandard.ZstdDecompressor()

    def _block(self, i: int) -> Iterator[tuple[bytes, np.ndarray]]:
        offset, length = self.blocks[i]
        packed = self.source.read_at(length + 4, offset)
        if zlib.crc32(packed[:length]) != struct.unpack("<I", packed[length:])[0]:
            raise ValueError("damaged block")
        data, at, key = self.zstd.decompress(packed[:length]), 0, b""
        while at < len(data):
            shared, at = _read_varint(data, at)
            tail, at = _read_varint(data, at)
            size, at = _read_varint(data, at)
            key = key[:shared] + data[at : at + tail]
            at += tail
            yield key, np.frombuffer(data, f"<u{self.width}", size // self.width, at)
            at += size

    def __iter__(self) -> Iterator[tuple[bytes, np.ndarray]]:
        for i in range(len(self.blocks)):
            yield from self._block(i)

    def may_hold(self, key: bytes) -> bool:
        return all(self.bloom[p >> 3] >> (p & 7) & 1 for p in _probes(key, self.bits))

    def get(self, key: bytes) -> list[np.ndarray]:
        """The ids stored under the key: one array for each document that has it."""
        out: list[np.ndarray] = []
        if not self.may_hold(key):
            return out
        for i in range(bisect.bisect_left(self.last, key), len(self.blocks)):
            for k, ids in self._block(i):
                if k == key:
                    out.append(ids)
                elif k > key:
                    return out
        return out


def _open(uri: str):
    files, path = pafs.FileSystem.from_uri(uri)
    return files, path


def write(docs: DataFrame, path: str, vocabulary: str | None = None, end: int = 2, partitions: int | None = None) -> list[dict]:
    """Encode ``docs`` (doc_id, text; null text is empty, other columns are ignored)
    and write them below ``path`` in ascending doc_id order; return the manifest.

    Documents with the same doc_id are all kept, in the order of their texts' hashes (and
    texts), so that many of one identifier, or of none, spread over shards; a null doc_id
    comes first.  An empty table makes a manifest without shards.
    """
    vocabulary = vocabulary or bpe.vocabulary_path()
    spark = docs.sparkSession
    partitions = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    files, base = _open(path)
    files.create_dir(base, recursive=True)

    def shard(batches):
        coder = bpe.encoder(vocabulary)
        width = np.dtype(coder.dtype).itemsize
        out, name, ends = None, "", [None, None]
        for batch in batches:
            for part in slices(batch, "text", bpe.SLICE_BYTES):
                if out is None:
                    name = f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.sst"
                    target, at = _open(path)
                    sink = target.open_output_stream(f"{at}/{name}")
                    out = Writer(sink, width)
                ids, offsets = coder.encode(part.column("text"), end)
                for i, doc in enumerate(part.column("doc_id").to_pylist()):
                    out.add(key_of(doc), ids[offsets[i] : offsets[i + 1]])
                    ends = [doc if out.n == 1 else ends[0], doc]
        if out is not None:
            out.close()
            sink.close()
            yield pa.RecordBatch.from_pydict({"shard": [TaskContext.get().partitionId()], "name": [name], "first": [ends[0]], "last": [ends[1]], "docs": [out.n], "ids": [out.ids], "bytes": [out.at]}, schema=_manifest_schema)

    rows = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        .withColumn("hash", F.xxhash64("text"))
        .repartitionByRange(partitions, "doc_id", "hash")
        .sortWithinPartitions("doc_id", "hash", "text")
        .drop("hash")
        .mapInArrow(shard, "shard int, name string, first long, last long, docs long, ids long, bytes long")
        .collect()  # a row for each shard
    )
    manifest, start = [], 0
    for r in sorted(rows, key=lambda r: r["shard"]):
        manifest.append(r.asDict() | {"start": start})
        start += r["ids"]
    with files.open_output_stream(f"{base}/MANIFEST.json") as sink:
        sink.write(json.dumps({"shards": manifest, "end": end, "vocabulary": vocabulary.rsplit("/", 1)[-1]}).encode())
    return manifest


_manifest_schema = pa.schema([("shard", pa.int32()), ("name", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("docs", pa.int64()), ("ids", pa.int64()), ("bytes", pa.int64())])


def manifest(path: str) -> list[dict]:
    files, base = _open(path)
    with files.open_input_stream(f"{base}/MANIFEST.json") as source:
        return json.loads(source.read())["shards"]


def lookup(path: str, doc_id: int | None) -> list[np.ndarray]:
    """The ids of the documents with this identifier, by binary search over shards and blocks."""
    files, base = _open(path)
    low = (lambda x: -(1 << 63) - 1 if x is None else x)
    out: list[np.ndarray] = []
    shards = manifest(path)
    at = bisect.bisect_left([low(s["last"]) for s in shards], low(doc_id))
    for s in shards[at:]:
        if low(s["first"]) > low(doc_id):
            break
        with files.open_input_file(f"{base}/{s['name']}") as source:
            out += Reader(source).get(key_of(doc_id))
    return out


def read(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """The dataset's documents in key order within shards: doc_id, start (ids of all
    documents before it), n_tokens, ids_crc32 and, if wanted, ids."""
    shards = [(f"{path}/{s['name']}", s["start"]) for s in manifest(path)]
    kind = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids
    if not shards:
        return spark.createDataFrame([], kind)

    def scan(batches):
        for batch in batches:
            for uri, start in zip(*(batch.column(c).to_pylist() for c in ("uri", "start")), strict=True):
                files, at = _open(uri)
                with files.open_input_file(at) as source:
                    rows, held = [], 0
                    for key, ids in Reader(source):
                        rows.append((id_of(key), start, len(ids), bpe.crc(ids), ids if with_ids else None))
                        start += len(ids)
                        held += len(ids) if with_ids else 1
                        if held > 50_000:
                            yield _batch(rows, with_ids)
                            rows, held = [], 0
                    if rows:
                        yield _batch(rows, with_ids)

    tasks = spark.createDataFrame(shards, "uri string, start long").repartition(len(shards))
    return tasks.mapInArrow(scan, kind)


def _batch(rows: list[tuple], with_ids: bool) -> pa.RecordBatch:
    columns = dict(zip(("doc_id", "start", "n_tokens", "ids_crc32"), (pa.array(c, pa.int64()) for c in list(zip(*rows, strict=True))[:4]), strict=True))
    if with_ids:
        columns["ids"] = pa.array([r[4].astype(np.int64) for r in rows], pa.list_(pa.int64()))
    return pa.RecordBatch.from_pydict(columns)


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode, write and read back all documents; the columns of the contract.

    Null text is empty (the end id alone); repeated identifiers are all kept; a null
    doc_id comes first; an empty table gives no rows.
    """
    path = storage.new_path(spark, "sstable")
    write(spark.read.parquet(f"{sf_dir}/documents.parquet"), path)
    return read(spark, path, with_ids=False)
