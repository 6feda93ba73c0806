import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from trailmark.llm import bpe, packing, sentencepiece_model, sstable

from odd_texts import TEXTS


def ids_of(text, end):
    e = bpe.encoder(bpe.vocabulary_path())
    return [*e.tokenizer.encode(text or "", add_special_tokens=False).ids, end]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_pieces_give_the_library_s_ids():
    rng = random.Random(3)
    bits = ["a", "b ", " ", "\n", "\t", "é", "'s", "12", "!!", "the ", "　", "\r\n", " ", "x,", ".\n"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 40))) for _ in range(1500)] + [t for _, t in TEXTS[:9]]
    e = bpe.Encoder(bpe.vocabulary_path())
    for _ in range(2):  # from the library, then from the memo
        ids, at = e.encode(pa.array(texts, pa.string()), end=2)
        for i, t in enumerate(texts):
            assert ids[at[i] : at[i + 1]].tolist() == [*e.tokenizer.encode(t or "", add_special_tokens=False).ids, 2]


def test_added_tokens_are_those_of_the_plain_call():
    from tokenizers import Tokenizer

    texts = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|>y  z <|endoftext|>", "<|endoftext |> none", "plain text"]
    path = bpe.vocabulary_path()
    ids, offsets = bpe.Encoder(path).encode(pa.array(texts))
    want = [e.ids for e in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    assert [ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:], strict=True)] == want and 50256 in want[0]


def test_memo_shrinks(monkeypatch):
    monkeypatch.setattr(bpe, "MEMO_PIECES", 10)
    e = bpe.Encoder(bpe.vocabulary_path())
    for k in range(5):
        texts = [f"w{k}{i} common words" for i in range(20)]
        ids, at = e.encode(pa.array(texts))
        assert ids.tolist() == [x for t in texts for x in e.tokenizer.encode(t, add_special_tokens=False).ids]


def test_sstable_round_trip(spark, odd, tmp_path):
    path = f"file://{tmp_path}/table"
    manifest = sstable.write(odd, path, partitions=3)
    rows = sstable.read(spark, path).collect()
    want = sorted(TEXTS, key=lambda r: (r[0] is not None, r[0] or 0))
    rows.sort(key=lambda r: r["start"])
    start = 0
    for r, (doc, text) in zip(rows, want, strict=True):
        ids = ids_of(text, 2)
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids"], r["ids_crc32"]) == (doc, start, len(ids), ids, crc(ids))
        start += len(ids)
    assert sum(m["docs"] for m in manifest) == len(TEXTS)
    for doc in (None, -9, 7, 8):
        assert [x.tolist() for x in sstable.lookup(path, doc)] == [ids_of(t, 2) for d, t in TEXTS if d == doc]
    assert len(sstable.lookup(path, 1)) == 2
    assert sstable.lookup(path, 12345) == []


def test_sstable_spreads_equal_identifiers(spark, tmp_path):
    """Documents without an identifier fill several shards, and are all found."""
    path = f"file://{tmp_path}/equal"
    docs = spark.createDataFrame([(None, f"text number {i}") for i in range(400)] + [(5, f"five {i}") for i in range(400)], "doc_id long, text string")
    manifest = sstable.write(docs, path, partitions=4)
    assert len(manifest) > 2 and max(m["docs"] for m in manifest) < 400
    assert len(sstable.lookup(path, None)) == len(sstable.lookup(path, 5)) == 400
    starts = [r["start"] for r in sstable.read(spark, path, with_ids=False).orderBy("start").collect()]
    assert starts[0] == 0 and len(set(starts)) == 800


def test_sstable_empty(spark, none, tmp_path):
    path = f"file://{tmp_path}/empty"
    assert sstable.write(none, path, partitions=2) == []
    assert sstable.read(spark, path).count() == 0


def test_sstable_finds_damage(tmp_path):
    from pyarrow import fs

    local = fs.LocalFileSystem()
    with local.open_output_stream(f"{tmp_path}/x.sst") as sink:
        w = sstable.Writer(sink, 2)
        for i in range(3000):
            w.add(sstable.key_of(i * 3), np.arange(i % 200, dtype=np.uint16))
        w.close()
    r = sstable.Reader(local.open_input_file(f"{tmp_path}/x.sst"))
    assert [sstable.id_of(k) for k, _ in r] == [i * 3 for i in range(3000)]
    assert len(r.blocks) > 1 and r.get(sstable.key_of(300))[0].tolist() == list(range(100)) and r.get(sstable.key_of(301)) == []
    assert sum(r.may_hold(sstable.key_of(i * 3 + 1)) for i in range(3000)) < 120
    data = bytearray(open(f"{tmp_path}/x.sst", "rb").read())
    data[50] ^= 1
    open(f"{tmp_path}/y.sst", "wb").write(data)
    with pytest.raises(ValueError):
        list(sstable.Reader(local.open_input_file(f"{tmp_path}/y.sst")))


def whole(rows, texts, end, window):
    """Every id lies in exactly one piece; sequences are gapless and within the window."""
    docs, seqs = {}, {}
    for r in rows:
        docs.setdefault(r["doc_id"], []).append(r)
        seqs.setdefault(r["sequence_id"], []).append(r)
    for doc, pieces in docs.items():
        wanted = [ids_of(t, end) for d, t in texts if d == doc]
        assert sum(p["length"] for p in pieces) == sum(map(len, wanted))
        for p in pieces:
            assert p["length"] > 0 and any(p["doc_tokens"] == len(w) and crc(w[p["start"] : p["start"] + p["length"]]) == p["ids_crc32"] for w in wanted)
    for pieces in seqs.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= window
    assert set(docs) == {d for d, _ in texts}


def test_packing_keeps_every_token(odd):
    rows = packing.pack(odd, segment_sequences=8).collect()
    whole(rows, TEXTS, 0, 1024)
    for r in rows:
        assert crc(np.frombuffer(r["ids"], "<u4")) == r["ids_crc32"]


def test_packing_empty(none):
    assert packing.pack(none).count() == 0


def test_packing_with_weights_and_hashed_queues(odd, monkeypatch):
    whole(packing.pack(odd, weights={"s0": 8.0, "s1": 1.0, "s2": 1.0}, segment_sequences=4, sequence_tokens=256, with_ids=False).collect(), TEXTS, 0, 256)
    monkeypatch.setattr(packing, "MAX_QUEUES", 1)
    monkeypatch.setattr(packing, "BROADCAST_ROWS", 0)
    whole(packing.pack(odd, segment_sequences=4, with_ids=False).collect(), TEXTS, 0, 1024)


def test_many_sources_keep_weights_and_large_queues(spark, monkeypatch):
    """With more sources than queues, named and large ones aren't mixed with others."""
    monkeypatch.setattr(packing, "MAX_QUEUES", 4)
    small = [f"s{k}" for k in range(12)]
    rows = [(i, "some words of a small source " * 8, small[i % 12]) for i in range(240)] + [(1000 + i, "words of the large one in this corpus " * 8, "large") for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").coalesce(1)

    def shares(weights, source):
        pieces = packing.pack(docs, weights=weights, segment_sequences=4, sequence_tokens=256, with_ids=False).collect()
        assert sum(p["length"] for p in pieces) == sum({p["doc_id"]: p["doc_tokens"] for p in pieces}.values())
        windows = sorted({p["sequence_id"] for p in pieces})[:8]
        first = [p for p in pieces if p["sequence_id"] in windows]
        return sum(p["length"] for p in first if p["source"] == source) / sum(p["length"] for p in first)

    assert 0.25 < shares(None, "large") < 0.5
    assert shares({"s5": 4.0}, "s5") > 0.4
    assert shares({"large": 0.05}, "large") < 0.15


def test_placing_takes_no_index_for_each_byte():
    """A batch of 64 MB may reach a worker; what is made beside it must not be a multiple."""
    import tracemalloc

    rng = np.random.default_rng(0)
    n = rng.integers(1, 8000, 1000)
    ids, cut = rng.integers(0, 50_000, n.sum()).astype("<u2"), np.concatenate([[0], np.cumsum(n)])
    queue = np.arange(1000, dtype=np.int32) % 2
    start = np.concatenate([[0], np.cumsum(np.where(queue == 0, n, 0))])[:-1] * (queue == 0) + np.concatenate([[0], np.cumsum(np.where(queue == 1, n, 0))])[:-1] * (queue == 1)
    columns = {"queue": queue, "base": np.zeros(1000, np.int64), "start": start, "doc_id": np.arange(1000), "n": n, "width": np.full(1000, 2, np.int32)}
    batch = pa.RecordBatch.from_pydict({k: pa.array(v) for k, v in columns.items()} | {"source": pa.array(["s"] * 1000), "ids": pa.array([ids[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:])], pa.binary())})
    rates, last = np.array([20_000.0, 30_000.5]), np.array([10_000, 10_000])
    tracemalloc.start()
    (out,) = packing._place(batch, rates, last, 128)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert out.num_rows > 1000 and most < ids.nbytes
    for rows, placed in ((batch, out), (batch.slice(300, 400), *packing._place(batch.slice(300, 400), rates, last, 128))):
        found = {d: [] for d in rows.column("doc_id").to_pylist()}
        for r in sorted(placed.to_pylist(), key=lambda r: (r["doc_id"], r["start"])):
            assert r["start"] == sum(len(x) for x in found[r["doc_id"]]) // 2 and len(r["ids"]) == 2 * r["n"]
            found[r["doc_id"]].append(r["ids"])
        assert all(b"".join(x) == ids[cut[d] : cut[d + 1]].tobytes() for d, x in found.items())
    assert list(packing._place(batch.slice(0, 0), rates, last, 128)) == []


def test_windows_hold_target_proportions():
    sizes = np.array([50_000, 30_000, 15_000, 5_000])
    q, give, w = packing.schedule(sizes, np.zeros(4), 1024, 128)
    assert np.bincount(q, give).tolist() == sizes.tolist()
    fill = np.bincount(w, give)
    assert (fill[:-1] == 1024).all()
    taken = np.zeros((w.max() + 1, 4))
    np.add.at(taken, (w, q), give)
    owed = np.cumsum(fill)[:, None] * sizes / sizes.sum() - taken.cumsum(0)
    assert np.abs(owed).max() <= 256  # deficits are carried, not lost


def test_sentencepiece_parity_and_decoding(spark, odd):
    import sentencepiece

    reference = sentencepiece.SentencePieceProcessor(model_file=bpe.vocabulary_path("piece_bpe_32k.model"))
    encoded = sentencepiece_model.encode(odd)
    rows = encoded.collect()
    assert len(rows) == len(TEXTS) and all(r["parity"] for r in rows)
    want = sorted((reference.encode(t or "") for _, t in TEXTS), key=str)
    assert sorted((r["ids"] for r in rows), key=str) == want
    assert [r["round_trip"] for r in rows if r["doc_id"] not in (7,)] == [True] * (len(TEXTS) - 1)
    back = {r["doc_id"]: r["text"] for r in sentencepiece_model.decode(encoded.where("doc_id in (1, 6, 8)")).collect()}
    assert back == {d: t for d, t in TEXTS if d in (1, 6, 8)}


def varint(n):
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def message(*fields):
    """A protobuf message of (number, int or bytes) fields."""
    return b"".join(varint(n << 3) + varint(v) if isinstance(v, int) else varint(n << 3 | 2) + varint(len(v)) + v for n, v in fields)


def model_file(path, pieces, kind, **normalizer):
    """A model file of (piece, score, type) rows, made by hand."""
    import struct

    piece = lambda text, score, type_: message((1, text.encode())) + bytes([2 << 3 | 5]) + struct.pack("<f", score) + message((3, type_))
    data = b"".join(message((1, piece(*p))) for p in pieces) + message((2, message((3, kind))), (3, message((3, 1), (4, 1), (5, 1))))
    path.write_bytes(data)
    return str(path)


SPECIAL = [("<unk>", 0, 2), ("<s>", 0, 3), ("</s>", 0, 3), ("<sep>", 0, 4)]
LETTERS = [(c, -6.0 - k / 8, 1) for k, c in enumerate("▁abcdes</>p")]


@pytest.mark.parametrize("kind", [1, 2])
def test_sentencepiece_symbols_and_control_names(tmp_path, kind):
    """User-defined symbols stand for themselves; the names of control pieces in a text are text."""
    words = [("▁a", -1.0, 1), ("ab", -1.5, 1), ("▁ab", -2.0, 1), ("cd", -2.25, 1)]
    path = model_file(tmp_path / "m.model", [*SPECIAL, *LETTERS, *words], kind)
    coder = sentencepiece_model.PieceEncoder(path)
    texts = ["ab cd", "ab<sep>cd ab", "<sep>", "a <sep> a", "<s>ab</s>", "abcd  a<sep><sep>b", "", "a", "zzz ab"]
    ids, offsets, parity = coder.encode_verified(pa.array(texts))
    assert parity.all()
    for t, a, b in zip(texts, offsets[:-1], offsets[1:], strict=True):
        assert ids[a:b].tolist() == coder.reference.encode(t), t
    assert coder.decode([coder.reference.encode("ab<sep>cd"), [1, *coder.reference.encode("ab"), 2]]) == ["ab<sep>cd", "ab"]


def test_memo_tells_pieces_apart():
    """Pieces with one hash, one place in the table, or both."""
    rng = np.random.default_rng(0)
    keys = rng.integers(0, 2**63, 3000, dtype=np.uint64) >> np.uint64(50)
    begins = np.arange(3000, dtype=np.uint64)
    memo = bpe.Memo(13)
    memo.add(keys[:2000], begins[:2000], np.arange(2000, dtype=np.int32))
    assert memo.find(keys, begins).tolist() == [*range(2000), *[-1] * 1000]
    memo.add(keys[2000:], begins[2000:], np.arange(2000, 3000, dtype=np.int32))
    assert memo.find(keys, begins).tolist() == list(range(3000))


def test_sentencepiece_unigram_rebuilds():
    from tokenizers import Tokenizer

    import struct

    def piece(text, score, kind):
        return message((1, text.encode())) + bytes([2 << 3 | 5]) + struct.pack("<f", score) + message((3, kind))

    data = b"".join(message((1, piece(*p))) for p in [("<unk>", 0, 2), ("▁", -3, 1), ("▁ab", -1, 1), ("a", -4, 1), ("b", -4, 1), ("c", -5, 1)])
    data += message((2, message((3, 1))), (3, message((3, 1), (4, 1), (5, 1))))
    m = sentencepiece_model.parse_model(data)
    assert (m.kind, m.pieces[2], m.unk_id, m.remove_extra_whitespaces) == (1, "▁ab", 0, True)
    t = sentencepiece_model.build(m)
    assert isinstance(t, Tokenizer) and t.encode("  ab   c ").tokens == ["▁ab", "▁", "c"]
