import hashlib
import io
import zlib

import numpy as np
import pytest

from trailmark.llm import media

from odd_texts import TEXTS

rng = np.random.default_rng(2)


@pytest.mark.parametrize("shape", [(1, 1), (3, 5), (64, 64), (7, 9, 3), (1, 4, 3)])
def test_formats_round_trip(shape):
    image = rng.integers(0, 256, shape, dtype=np.uint8)
    encoders = [media.encode_bmp] + ([media.encode_pgm] if image.ndim == 2 else [media.encode_ppm])
    for encode in encoders:
        assert (media.decode(encode(image)) == image).all()


def test_text_netpbm_and_comments():
    assert media.decode(b"P2 # a\n2 2\n10\n0 5 10 10\n").tolist() == [[0, 128], [255, 255]]
    assert media.decode(b"P1\n3 1\n1 0 1\n").tolist() == [[0, 255, 0]]
    assert media.decode(b"P4\n3 1\n" + bytes([0b10100000])).tolist() == [[0, 255, 0]]
    assert media.decode(b"P3 1 1 255 1 2 3").tolist() == [[[1, 2, 3]]]
    assert media.decode(b"P5 1 1 65535\n" + b"\xff\xff").tolist() == [[255]]
    whole = media.encode_bmp(rng.integers(0, 256, (5, 6), dtype=np.uint8))
    for bad in (b"", b"GIF89a", b"P5 2 2 255\nab", b"P5 2", b"P1 2 1\n7 1", b"P5 0 3 255\n", b"P5 2 2 0\nabcd", b"P2 2 1 9\nx y", b"BM", whole[:40], whole[:100], whole[:-1]):
        with pytest.raises(ValueError):
            media.decode(bad)


def test_area_resize_is_exact():
    image = rng.integers(0, 256, (37, 64), dtype=np.uint8)
    big = np.kron(image, np.ones((16, 16)))  # 592 x 1024: 16 x 16 cells of 37 x 64
    want = big.reshape(16, 37, 16, 64).mean((1, 3))
    assert np.allclose(media.area_resize(image, 16, 16), want)
    assert np.allclose(media.area_resize(image, 37, 64), image)


def test_tiles_and_hashes():
    ramp = np.tile(np.arange(0, 252, 4, dtype=np.uint8), (8, 1))
    assert media.difference_hash(ramp) == "f" * 16 and media.difference_hash(ramp[:, ::-1]) == "0" * 16
    assert media.difference_hash(np.stack([ramp] * 3, 2)) == "f" * 16
    tile = np.load(io.BytesIO(media.tile(ramp)))
    assert tile.shape == (16, 16) and tile.dtype == np.uint8


def test_stored_texts(odd, none):
    rows = media.features(media.store(odd)).collect()
    assert len(rows) == len(TEXTS) and media.features(media.store(none)).count() == 0
    by = {(t or "").encode(): d for d, t in TEXTS}
    left = sorted((r["payload_sha256"], r["n_bytes"]) for r in rows)
    want = []
    for _, t in TEXTS:
        raw = (t or "").encode()
        payload = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        want.append((hashlib.sha256(payload).hexdigest(), len(raw)))
    assert left == sorted(want) and by
    for r in rows:
        assert r["payload_bytes"] % 64 == 0 and r["payload_bytes"] > 0 and len(r["feature"]) == 16
        assert np.load(io.BytesIO(r["tile"])).shape == (16, 16)
    same = [r for r in rows if r["doc_id"] == 1]
    assert same[0].asDict() == same[1].asDict()


def test_media_that_cannot_be_read(spark):
    """Null and broken media have nulls; the rows stay."""
    good = media.encode_bmp(rng.integers(0, 256, (9, 11, 3), dtype=np.uint8))
    rows = [(1, 4, good, "x"), (2, 0, None, "x"), (3, 5, b"GIF89a", "x"), (1, 4, good, "x")]
    got = media.features(spark.createDataFrame(rows, "doc_id long, n_bytes long, media binary, feature string")).orderBy("doc_id").collect()
    assert [r["doc_id"] for r in got] == [1, 1, 2, 3] and got[0] == got[1]
    assert got[0]["media_bytes"] == len(good) and got[0]["payload_bytes"] == 9 * 11 * 3
    assert all(r["feature"] is None and r["tile"] is None and r["payload_sha256"] is None for r in got[2:])


def test_query_through_the_stored_tables(spark, sf_dir):
    """All columns against brute force on the texts; equal texts have equal values."""
    docs = {r["doc_id"]: (r["text"] or "").encode() for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = media.op9(spark, sf_dir).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(docs)
    for r in got:
        payload = docs[r["doc_id"]] + bytes(-len(docs[r["doc_id"]]) % 64 or (0 if docs[r["doc_id"]] else 64))
        stored = b"P5\n64 %d\n255\n" % (len(payload) // 64) + payload
        assert (r["n_bytes"], r["payload_bytes"], r["media_bytes"]) == (len(docs[r["doc_id"]]), len(payload), len(stored))
        assert (r["payload_sha256"], r["media_sha256"]) == (hashlib.sha256(payload).hexdigest(), hashlib.sha256(stored).hexdigest())
        image = np.frombuffer(payload, np.uint8).reshape(-1, 64)
        assert r["tail_crc32"] == zlib.crc32(payload[-64:]) and r["tile_crc32"] == zlib.crc32(media.tile(image))
