"""Media columns: Netpbm and BMP images, area resizing, NPY tiles, difference hashes.

Images are numpy arrays of shape (height, width) or (height, width, 3).  Resizing
averages exact areas: the integral image is read at fractional places by linear
interpolation, which is exact for pixels of constant value.
"""

from __future__ import annotations

import hashlib
import io
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import storage
from .textkernel import slices

ROW_BYTES = 64
TILE = 16

_TOKEN = re.compile(rb"(?:\s|#[^\n]*\n)*([^\s#]+)")


def encode_pgm(image: np.ndarray) -> bytes:
    """Binary grey map of an 8-bit image."""
    return b"P5\n%d %d\n255\n" % (image.shape[1], image.shape[0]) + np.ascontiguousarray(image, np.uint8).tobytes()


def encode_ppm(image: np.ndarray) -> bytes:
    return b"P6\n%d %d\n255\n" % (image.shape[1], image.shape[0]) + np.ascontiguousarray(image, np.uint8).tobytes()


def encode_bmp(image: np.ndarray) -> bytes:
    """Uncompressed bitmap: grey with a palette, or 24-bit colour."""
    h, w = image.shape[:2]
    grey = image.ndim == 2
    stride = -(-w * (1 if grey else 3) // 4) * 4
    rows = np.zeros((h, stride), np.uint8)
    rows[:, : w * (1 if grey else 3)] = (image if grey else image[:, :, ::-1].reshape(h, -1))[::-1]
    palette = np.repeat(np.arange(256, dtype=np.uint8)[:, None], 4, 1) * np.array([1, 1, 1, 0], np.uint8) if grey else np.zeros(0, np.uint8)
    at = 54 + palette.size
    head = struct.pack("<2sIHHI", b"BM", at + rows.size, 0, 0, at) + struct.pack("<IiiHHIIiiII", 40, w, h, 1, 8 if grey else 24, 0, rows.size, 2835, 2835, 256 if grey else 0, 0)
    return head + palette.tobytes() + rows.tobytes()


def decode(data: bytes) -> np.ndarray:
    """An image of Netpbm (P1 to P6, up to 16 bits) or uncompressed BMP bytes."""
    if data[:2] == b"BM":
        return _decode_bmp(data)
    kind = data[:2]
    if kind not in (b"P1", b"P2", b"P3", b"P4", b"P5", b"P6"):
        raise ValueError("neither Netpbm nor BMP")
    try:
        return _decode_netpbm(data, kind)
    except (OverflowError, TypeError) as e:
        raise ValueError("not a whole Netpbm image") from e


def _decode_netpbm(data: bytes, kind: bytes) -> np.ndarray:
    at, head = 2, []
    for _ in range(2 if kind in (b"P1", b"P4") else 3):
        m = _TOKEN.match(data, at)
        if not m:
            raise ValueError("cut off header")
        head.append(int(m[1]))
        at = m.end()
    w, h = head[:2]
    most = head[2] if len(head) > 2 else 1
    if w < 1 or h < 1 or not 1 <= most < 1 << 16:
        raise ValueError("an image without samples, or a depth out of range")
    deep = 3 if kind in (b"P3", b"P6") else 1
    if kind == b"P1":
        digits = re.sub(rb"#[^\n]*\n?|\s", b"", data[at:])
        flat = np.frombuffer(digits, np.uint8)[: w * h]
        if ((flat != 48) & (flat != 49)).any():
            raise ValueError("a sample that is no bit")
        flat = 49 - flat
    elif kind in (b"P2", b"P3"):
        flat = np.array(re.sub(rb"#[^\n]*\n?", b" ", data[at:]).split()[: w * h * deep], int)
    elif kind == b"P4":
        bits = np.unpackbits(np.frombuffer(data, np.uint8, h * -(-w // 8), at + 1).reshape(h, -1), axis=1)[:, :w]
        flat = 1 - bits.ravel()
    else:
        flat = np.frombuffer(data, ">u2" if most > 255 else np.uint8, w * h * deep, at + 1)
    if len(flat) != w * h * deep:
        raise ValueError("cut off samples")
    if most != 255:
        flat = (flat.astype(np.int64) * 255 + most // 2) // most
    image = flat.astype(np.uint8, copy=False)
    return image.reshape((h, w, 3) if deep == 3 else (h, w))


def _decode_bmp(data: bytes) -> np.ndarray:
    if len(data) < 54:
        raise ValueError("cut off header")
    at, size, w, h, _, bits, packed = struct.unpack_from("<IIiiHHI", data, 10)
    if packed or bits not in (1, 4, 8, 24, 32):
        raise ValueError("a kind of bitmap that isn't read")
    flip, h = h > 0, abs(h)
    if w < 1 or h < 1:
        raise ValueError("an image without samples")
    stride = -(-w * bits // 32) * 4
    rows = np.frombuffer(data, np.uint8, stride * h, at).reshape(h, stride)
    rows = rows[::-1] if flip else rows
    if bits >= 24:
        return rows[:, : w * bits // 8].reshape(h, w, bits // 8)[:, :, 2::-1]
    if bits < 8:
        rows = np.unpackbits(rows, axis=1).reshape(h, -1, bits)
        rows = (rows << np.arange(bits - 1, -1, -1, dtype=np.uint8)).sum(2, dtype=np.uint8)
    used = struct.unpack_from("<I", data, 46)[0] or 1 << bits
    palette = np.zeros((256, 3), np.uint8)
    palette[:used] = np.frombuffer(data, np.uint8, used * 4, 14 + size).reshape(used, 4)[:, 2::-1]
    image = rows[:, :w]
    grey = (palette == palette[:, :1]).all()
    return palette[image, 0] if grey else palette[image]


def area_resize(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Mean of each target cell's area, as float."""
    h, w = image.shape[:2]
    ys, xs = np.linspace(0, h, height + 1), np.linspace(0, w, width + 1)
    table = np.zeros((h + 1, w + 1, *image.shape[2:]), np.int64)
    np.cumsum(image, axis=0, dtype=np.int64, out=table[1:, 1:])
    np.cumsum(table[1:, 1:], axis=1, out=table[1:, 1:])
    y, x = np.minimum(ys.astype(int), h - 1), np.minimum(xs.astype(int), w - 1)
    fy, fx = ys - y, xs - x
    rows = table[y] * (1 - fy).reshape(-1, *[1] * (image.ndim - 1)) + table[y + 1] * fy.reshape(-1, *[1] * (image.ndim - 1))
    shape = (1, -1, *[1] * (image.ndim - 2))
    at = rows[:, x] * (1 - fx).reshape(shape) + rows[:, x + 1] * fx.reshape(shape)
    area = (h / height) * (w / width)
    return (at[1:, 1:] - at[:-1, 1:] - at[1:, :-1] + at[:-1, :-1]) / area


def npy(array: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.lib.format.write_array(out, np.ascontiguousarray(array), version=(1, 0), allow_pickle=False)
    return out.getvalue()


def tile(image: np.ndarray, size: int = TILE) -> bytes:
    """NPY bytes of the image resized to ``size`` x ``size``, 8-bit."""
    return npy(np.rint(area_resize(image, size, size)).clip(0, 255).astype(np.uint8))


def difference_hash(image: np.ndarray) -> str:
    """64 bits, in hexadecimal: is a cell of 8 x 9 brighter than the one to its left?"""
    grey = image if image.ndim == 2 else image @ np.array([0.299, 0.587, 0.114])
    small = np.rint(area_resize(grey if grey.dtype == np.uint8 else np.rint(grey).astype(np.uint8), 8, 9) * 256)
    return np.packbits(small[:, 1:] > small[:, :-1]).tobytes().hex()


def store(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and media (a grey map, 64 samples a row) of each text.

    Null text is empty; every payload has one row of samples at least; repeated rows
    are stored each; other columns are ignored.
    """

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text", 1 << 22):
                n, media = [], []
                for text in part.column("text").cast(pa.large_binary()).to_pylist():
                    raw = text or b""
                    n.append(len(raw))
                    padded = raw + bytes(-len(raw) % ROW_BYTES or (0 if raw else ROW_BYTES))
                    media.append(encode_pgm(np.frombuffer(padded, np.uint8).reshape(-1, ROW_BYTES)))
                yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id"), "n_bytes": pa.array(n, pa.int64()), "media": pa.array(media, pa.binary())})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def features(media: DataFrame) -> DataFrame:
    """Decode a table of (doc_id, n_bytes, media): the payload's digests, the stored
    form's, the difference hash and the NPY tile.

    Media that is null or no image that can be read has nulls in all these columns;
    repeated rows are decoded each; other columns are ignored; an empty table gives no rows.
    """

    def run(batches):
        for batch in batches:
            for part in slices(batch, "media", 1 << 22):
                rows = [_measured(data) for data in part.column("media").to_pylist()]
                columns = {k: pa.array(c, t) for (k, t), c in zip(_KINDS.items(), zip(*rows, strict=True), strict=True)}
                yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id"), "n_bytes": part.column("n_bytes")} | columns)

    kind = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, tile binary"
    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, kind)


_KINDS = {"payload_bytes": pa.int64(), "payload_sha256": pa.string(), "tail_crc32": pa.int64(), "media_bytes": pa.int64(), "media_sha256": pa.string(), "feature": pa.string(), "tile": pa.binary()}


def _measured(data: bytes | None) -> tuple:
    try:
        image = decode(data or b"")
    except ValueError:
        return (None,) * len(_KINDS)
    payload = image.tobytes()
    return len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-ROW_BYTES:]), len(data), hashlib.sha256(data).hexdigest(), difference_hash(image), tile(image)


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Store every text as an image table, read it back, write the tiles and features, and
    derive the contract's columns (and the stored tile's CRC-32) from what is stored.

    Null and empty texts have one row of zeros; repeated rows are stored each; an empty
    table gives no rows.
    """
    media = storage.materialize(store(spark.read.parquet(f"{sf_dir}/documents.parquet")), "media")
    stored = storage.materialize(features(media), "tiles")
    return stored.withColumn("tile_crc32", F.crc32("tile")).drop("tile")
