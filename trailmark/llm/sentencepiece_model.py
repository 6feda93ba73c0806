"""SentencePiece encoding and decoding on the tokenizers library.

The model's protobuf is parsed here (no protobuf runtime), and the normaliser, the
metaspace marker, the pieces' scores (unigram) or merges (BPE models) and byte
fallback are rebuilt as a ``tokenizers.Tokenizer``.  Texts are encoded by distinct
blank-delimited pieces, as in ``bpe``, where no vocabulary entry spans a word's end;
parity with the sentencepiece library is verified on every distinct piece when a
worker first meets it.
"""

from __future__ import annotations

import re
import struct
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe
from .bpe import Encoder, join, ragged
from .textkernel import slices, text_bytes

MARK = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = range(1, 7)
UNIGRAM, BPE = 1, 2
#: New pieces in each text of a batch.
AT_ONCE = 512


@dataclass
class Model:
    pieces: list[str] = field(default_factory=list)
    scores: list[float] = field(default_factory=list)
    types: list[int] = field(default_factory=list)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    charsmap: bytes = b""
    add_dummy_prefix: bool = True
    remove_extra_whitespaces: bool = True
    escape_whitespaces: bool = True
    unk_id: int = 0


def _fields(data: bytes):
    """(number, value) of a protobuf message: int, 4 or 8 raw bytes, or bytes."""
    at, n = 0, len(data)

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7

    while at < n:
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        elif kind == 2:
            size = varint()
            yield tag >> 3, data[at : at + size]
            at += size
        elif kind in (1, 5):
            size = 8 if kind == 1 else 4
            yield tag >> 3, data[at : at + size]
            at += size
        else:
            raise ValueError("not a protobuf message")


def parse_model(data: bytes) -> Model:
    m = Model()
    for number, value in _fields(data):
        if number == 1:
            piece, score, kind = "", 0.0, NORMAL
            for k, v in _fields(value):
                if k == 1:
                    piece = v.decode()
                elif k == 2:
                    score = struct.unpack("<f", v)[0]
                elif k == 3:
                    kind = v
            if kind == UNKNOWN:
                m.unk_id = len(m.pieces)
            m.pieces.append(piece)
            m.scores.append(score)
            m.types.append(kind)
        elif number == 2:
            for k, v in _fields(value):
                if k == 3:
                    m.kind = v
                elif k == 35:
                    m.byte_fallback = bool(v)
        elif number == 3:
            for k, v in _fields(value):
                if k == 2:
                    m.charsmap = v
                elif k == 3:
                    m.add_dummy_prefix = bool(v)
                elif k == 4:
                    m.remove_extra_whitespaces = bool(v)
                elif k == 5:
                    m.escape_whitespaces = bool(v)
    return m


def merges(m: Model) -> list[tuple[str, str]]:
    """Merges that make the pieces of a BPE model, best score first."""
    ids = {p: i for i, (p, t) in enumerate(zip(m.pieces, m.types, strict=True)) if t in (NORMAL, USER)}
    out = []
    for piece, i in ids.items():
        for cut in range(1, len(piece)):
            a, b = ids.get(piece[:cut]), ids.get(piece[cut:])
            if a is not None and b is not None:
                out.append((-m.scores[i], i, a, b, piece[:cut], piece[cut:]))
    out.sort()
    return [(a, b) for *_, a, b in out]


def build(m: Model, split: bool = False):
    """The model as a ``tokenizers.Tokenizer``.  ``split``: cut at each marker first,
    which is right for texts without runs of blanks."""
    from tokenizers import Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

    # Only normal, user-defined and byte pieces may come from text; the others keep their ids under names no text has.
    names = [p if t in (NORMAL, USER, BYTE) else f"\U000F0000{i}\U000F0000" for i, (p, t) in enumerate(zip(m.pieces, m.types, strict=True))]
    if m.kind == UNIGRAM:
        model = models.Unigram(list(zip(names, m.scores, strict=True)), m.unk_id, m.byte_fallback)
    elif m.kind == BPE:
        model = models.BPE({p: i for i, p in enumerate(names)}, merges(m), unk_token=names[m.unk_id], fuse_unk=True, byte_fallback=m.byte_fallback)
    else:
        raise ValueError("word and character models are not rebuilt")
    t = Tokenizer(model)
    steps = [normalizers.Precompiled(m.charsmap)] if m.charsmap else []
    if m.remove_extra_whitespaces:
        steps += [normalizers.Replace(Regex("^ +| +$"), ""), normalizers.Replace(Regex(" {2,}"), " ")]
    if m.add_dummy_prefix:
        steps.append(normalizers.Prepend(MARK))
    if m.escape_whitespaces:
        steps.append(normalizers.Replace(" ", MARK))
    if steps:
        t.normalizer = normalizers.Sequence(steps)
    if split:
        t.pre_tokenizer = pre_tokenizers.Split(MARK, "merged_with_next")
    t.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(), *([decoders.Strip(" ", 1, 0)] if m.add_dummy_prefix else [])])
    return t


class PieceEncoder(Encoder):
    """``bpe.Encoder`` for a SentencePiece model: every piece, a text's first one
    too, begins with the marker, and runs of blanks make a text be encoded whole.

    The library encodes batches of texts (new pieces are dealt into some), which it
    does with as many threads as it is given (``RAYON_NUM_THREADS``)."""

    def __init__(self, path: str):
        import sentencepiece

        with open(path, "rb") as source:
            self.model = parse_model(source.read())
        m = self.model
        self.whole, self.split = build(m), build(m, True)
        self.reference = sentencepiece.SentencePieceProcessor(model_file=path)
        self.dtype = np.uint16 if len(m.pieces) <= 1 << 16 else np.uint32
        self.blank = np.array([p.startswith(MARK) for p in m.pieces])
        self.symbols = {p: i for i, (p, t) in enumerate(zip(m.pieces, m.types, strict=True)) if t == USER}
        self.symbol = re.compile("|".join(re.escape(p) for p in sorted(self.symbols, key=len, reverse=True))) if self.symbols else None
        #: Entries that span a word's end, user-defined symbols, or a normaliser that moves blanks, forbid pieces.
        self.by_piece = m.add_dummy_prefix and m.escape_whitespaces and not m.charsmap and not self.symbols and not any(MARK in p.lstrip(MARK) for p in m.pieces)
        self.bytes = [self._bytes(i) for i in range(len(m.pieces))]
        self.byte_size = np.array([len(b) for b in self.bytes])
        self.byte_pool = np.frombuffer(b"".join(self.bytes), np.uint8)
        self.byte_start = np.cumsum(self.byte_size) - self.byte_size
        self._reset()

    def _bytes(self, i: int) -> bytes:
        piece, kind = self.model.pieces[i], self.model.types[i]
        if kind == BYTE:
            return bytes([int(piece[3:5], 16)])
        return b"" if kind == CONTROL else b" \xe2\x81\x87 " if kind == UNKNOWN else piece.replace(MARK, " ").encode()

    def _check(self, texts: list[str], got: list[np.ndarray]) -> np.ndarray:
        """True where the ids are those of the sentencepiece library."""
        want = self.reference.encode(texts)
        return np.array([len(g) == len(w) and (g == np.array(w, g.dtype)).all() for g, w in zip(got, want, strict=True)], bool)

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        if self.symbol is not None:
            return [self._with_symbols(t) for t in texts]
        return [np.array(e.ids, self.dtype) for e in self.whole.encode_batch_fast(texts, add_special_tokens=False)]

    def _with_symbols(self, text: str) -> np.ndarray:
        """User-defined symbols stand for themselves, the longest first; the model sees what is between."""
        text = self.whole.normalizer.normalize_str(text) if self.whole.normalizer is not None else text
        out, at = [], 0
        for m in [*self.symbol.finditer(text), None]:
            between = text[at : m.start() if m else len(text)]
            if between:
                out += [t.id for t in self.whole.model.tokenize(between)]
            if m:
                out.append(self.symbols[m[0]])
                at = m.end()
        return np.array(out, self.dtype)

    def _reset(self) -> None:
        super()._reset()
        self.same = np.zeros(0, bool)

    def _shrink(self) -> None:
        self._reset()

    def _learn(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, size of each piece).  The pieces go to the library as a batch of texts of
        ``AT_ONCE`` pieces, each checked against the sentencepiece library (and piece by
        piece where they differ)."""
        cuts = range(0, len(starts), AT_ONCE)
        texts = [join(data, starts[a : a + AT_ONCE], ends[a : a + AT_ONCE])[1:] for a in cuts]
        got = [np.array(e.ids, self.dtype) for e in self.split.encode_batch_fast(texts, add_special_tokens=False)]
        same = np.ones(len(starts), bool)
        size = [np.diff(np.append(np.flatnonzero(self.blank[ids]), len(ids))) for ids in got]
        for a, ids, n, right in zip(cuts, got, size, self._check(texts, got), strict=True):
            if not right:
                pieces = [data[x:y].tobytes().decode() for x, y in zip(starts[a : a + AT_ONCE], ends[a : a + AT_ONCE], strict=True)]
                same[a : a + AT_ONCE] = self._check(pieces, np.split(ids, np.cumsum(n)[:-1]))
        self.same = np.concatenate([self.same, same])
        return np.concatenate(got), np.concatenate(size)

    def encode_verified(self, arr: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(ids, offsets, parity of each text); null is empty."""
        if len(self.keys) > bpe.MEMO_PIECES:
            self._shrink()
        arr = pc.fill_null(arr.cast(pa.large_string()), "")
        odd = pc.or_(pc.match_substring_regex(arr, f"^ |  | $|{MARK}"), pc.equal(arr, "")).to_numpy(zero_copy_only=False) if self.by_piece else np.ones(len(arr), bool)
        data, offsets = text_bytes(arr.filter(pa.array(~odd)))
        blank = np.flatnonzero(data == 32)
        starts = np.sort(np.concatenate([offsets[:-1], blank + 1]))
        ends = np.sort(np.concatenate([blank, offsets[1:]]))
        first = np.searchsorted(starts, offsets)
        code = self._codes(data, starts, ends) if len(starts) else np.zeros(0, np.int64)
        length = self.size[code]
        ids = self.pool[ragged(self.start[code], length)]
        tokens, parity = np.zeros(len(arr), np.int64), np.ones(len(arr), bool)
        tokens[~odd] = np.diff(np.concatenate([[0], np.cumsum(length)])[first])
        wrong = np.concatenate([[0], np.cumsum(~self.same[code])])[first]
        parity[~odd] = np.diff(wrong) == 0
        at = np.flatnonzero(odd)
        texts = arr.take(pa.array(at)).to_pylist()
        whole = self._whole(texts) if texts else []
        if texts:
            parity[at] = self._check(texts, whole)
        if not len(at):
            return ids, np.concatenate([[0], np.cumsum(tokens)]), parity
        out, offsets = bpe._insert(ids, tokens, dict(zip(at.tolist(), whole, strict=True)), None, self.dtype)
        return out, offsets, parity

    def decode_bytes(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """UTF-8 bytes and offsets of id sequences; the dummy prefix's blank goes."""
        size = self.byte_size[ids]
        data = self.byte_pool[ragged(self.byte_start[ids], size)]
        at = np.concatenate([[0], np.cumsum(size)])[offsets]
        if self.model.add_dummy_prefix:
            lead = at[:-1][(at[1:] > at[:-1])]
            lead = lead[data[lead] == 32]
            data = np.delete(data, lead)
            at = at - np.searchsorted(lead, at)
        return data, at

    def decode(self, ids: list[list[int]]) -> list[str]:
        """Texts of id lists by the tokenizers library; control ids have no text."""
        types, unknown = self.model.types, self.model.unk_id
        kept = [[i for i in x if types[i] != CONTROL] for x in ids]
        if any(unknown in x for x in kept):  # the library has no name for an unknown piece
            return [b"".join(self.bytes[i] for i in x).decode(errors="replace")[self.model.add_dummy_prefix and len(x) > 0 :] for x in kept]
        return self.whole.decode_batch(kept, skip_special_tokens=False)


_encoders: dict[str, PieceEncoder] = {}


def encoder(path: str) -> PieceEncoder:
    if path not in _encoders:
        _encoders[path] = PieceEncoder(path)
    return _encoders[path]


def encode(docs: DataFrame, path: str | None = None, with_ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids_crc32, parity (ids are those of the sentencepiece library),
    round_trip (decoding gives the text back) and, if wanted, ids of each row.

    Null text is empty and has no ids; repeated rows are encoded each; other columns
    are ignored; an empty table gives no rows.
    """
    path = path or bpe.vocabulary_path("piece_bpe_32k.model")

    def run(batches):
        coder = encoder(path)
        for batch in batches:
            for part in slices(batch, "text", bpe.SLICE_BYTES):
                texts = part.column("text")
                ids, offsets, parity = coder.encode_verified(texts)
                data, at = coder.decode_bytes(ids, offsets)
                raw, raw_at = text_bytes(texts)
                round_trip = np.diff(at) == np.diff(raw_at)
                if round_trip.all():
                    wrong = np.concatenate([[0], np.cumsum(data != raw)])
                    round_trip = np.diff(wrong[at]) == 0
                else:
                    round_trip = np.array([data[a:b].tobytes() == raw[c:d].tobytes() for a, b, c, d in zip(at[:-1], at[1:], raw_at[:-1], raw_at[1:], strict=True)], bool)
                wide = ids.astype("<u4")
                columns = {"doc_id": part.column("doc_id"), "n_tokens": pa.array(np.diff(offsets)), "ids_crc32": pa.array([bpe.crc(wide[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)], pa.int64()), "parity": pa.array(parity), "round_trip": pa.array(round_trip)}
                if with_ids:
                    columns["ids"] = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids.astype(np.int32)))
                yield pa.RecordBatch.from_pydict(columns)

    kind = "doc_id long, n_tokens long, ids_crc32 long, parity boolean, round_trip boolean" + ", ids array<int>" * with_ids
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, kind)


def decode(rows: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and text of rows of (doc_id, ids); null ids are an empty text."""
    path = path or bpe.vocabulary_path("piece_bpe_32k.model")

    def run(batches):
        coder = encoder(path)
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "text": pa.array(coder.decode([x or [] for x in batch.column("ids").to_pylist()]), pa.string())})

    return rows.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts, digests, parity and round trip of every document.

    Null and empty texts have no tokens; repeated rows are encoded each; a null doc_id
    stays null; an empty table gives no rows.
    """
    return encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), with_ids=False)
