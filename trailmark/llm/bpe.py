"""Byte-level BPE through the tokenizers library, memoised by piece of text.

The vocabulary's pre-tokeniser never joins a non-space character with white space
that follows it, so a text may be cut before each blank that follows a non-space
character, and each piece encoded on its own: the ids are those of the whole text.
Pieces repeat far more often than texts, so the library sees each distinct piece of
a slice once, and pieces that recur across slices once per worker; they are found in
numpy, by their hashes.  Texts in which a blank follows two or more white-space characters are
encoded whole, since a run of white space is one unit there, and so are texts that hold an added token.
"""

from __future__ import annotations

import json
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .textkernel import first_bytes, prefix_hash, span_hash, text_bytes

#: Most pieces kept per worker (about 90 bytes each); beyond it those used least are dropped.
MEMO_PIECES = 600_000
MEMO_BITS = 20
#: Bytes of text encoded at once: each distinct piece among them is looked up once.
SLICE_BYTES = 1 << 20
#: ASCII that Python's ``isspace`` takes for white space.
_SPACE = np.zeros(256, bool)
_SPACE[[*range(9, 14), *range(28, 33)]] = True
_RUN = r"[\s\pZ\x{85}\x{1c}-\x{1f}][\s\pZ\x{85}\x{1c}-\x{1f}] "


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _uncached(model: dict):
    """The library's BPE model without its own cache, which new pieces only slow down;
    None for a model of another kind."""
    from tokenizers import models

    if model["type"] != "BPE":
        return None
    merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    options = {k: model[k] for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges") if model.get(k) not in (None, "")}
    return models.BPE(vocab=model["vocab"], merges=merges, cache_capacity=0, **options)


class Memo:
    """Numbers of pieces of text, by open addressing over their hashes and first bytes.

    A piece is told by 64 bits of hash and its first eight bytes, so pieces of up to
    eight bytes never meet."""

    def __init__(self, bits: int):
        self.mask, self.shift = np.int64((1 << bits) - 1), np.uint64(64 - bits)
        self.keys, self.begins = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.uint64)
        self.codes = np.full(1 << bits, -1, np.int32)
        self.claim = np.zeros(1 << bits, np.int32)

    def find(self, keys: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """The number of each piece, -1 where it isn't known."""
        slot = (keys >> self.shift).astype(np.int64)
        out = self.codes[slot]
        other = np.flatnonzero((out >= 0) & ((self.keys[slot] != keys) | (self.begins[slot] != begins)))
        while len(other):
            slot[other] = (slot[other] + 1) & self.mask
            at = slot[other]
            out[other] = self.codes[at]
            other = other[(out[other] >= 0) & ((self.keys[at] != keys[other]) | (self.begins[at] != begins[other]))]
        return out

    def add(self, keys: np.ndarray, begins: np.ndarray, codes: np.ndarray) -> None:
        """Distinct pieces that aren't known."""
        slot, todo = (keys >> self.shift).astype(np.int64), np.arange(len(keys))
        while len(todo):
            free = todo[self.codes[slot[todo]] < 0]
            self.claim[slot[free]] = free
            won = free[self.claim[slot[free]] == free]
            at = slot[won]
            self.keys[at], self.begins[at], self.codes[at] = keys[won], begins[won], codes[won]
            placed = np.zeros(len(keys), bool)
            placed[won] = True
            todo = todo[~placed[todo]]
            slot[todo] = (slot[todo] + 1) & self.mask


class Encoder:
    """Encodes Arrow string arrays to a flat id array and offsets.

    A piece of the memo stands for a blank and the piece.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as source:
            self.tokenizer.model = _uncached(json.load(source)["model"]) or self.tokenizer.model
        added = sorted(t.content for t in self.tokenizer.get_added_tokens_decoder().values())
        self.whole = "|".join([_RUN, *(re.escape(t) for t in added if t)])
        vocab = self.tokenizer.get_vocab()
        self.dtype = np.uint16 if max(vocab.values()) < 1 << 16 else np.uint32
        self.blank = np.zeros(max(vocab.values()) + 1, bool)
        self.blank[[i for t, i in vocab.items() if t.startswith("Ġ")]] = True
        self._reset()

    def _reset(self) -> None:
        self.memo = Memo(MEMO_BITS)
        self.keys, self.begins = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        self.pool = np.zeros(0, self.dtype)
        self.start, self.size, self.uses = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, self.dtype) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _add(self, keys: np.ndarray, begins: np.ndarray, ids: np.ndarray, size: np.ndarray) -> None:
        self.memo.add(keys, begins, np.arange(len(self.keys), len(self.keys) + len(keys), dtype=np.int32))
        self.keys, self.begins = np.concatenate([self.keys, keys]), np.concatenate([self.begins, begins])
        self.start = np.concatenate([self.start, len(self.pool) + np.cumsum(size) - size])
        self.size = np.concatenate([self.size, size])
        self.uses = np.concatenate([self.uses, np.zeros(len(keys), np.int64)])
        self.pool = np.concatenate([self.pool, ids])

    def _shrink(self) -> None:
        """Keep the pieces that were used most, half the memo at most."""
        keep = np.argsort(-self.uses, kind="stable")[: MEMO_PIECES // 2]
        keep = keep[self.uses[keep] > 1]
        kept = self.keys[keep], self.begins[keep], self.pool[ragged(self.start[keep], self.size[keep])], self.size[keep]
        uses = self.uses[keep] // 2
        self._reset()
        self._add(*kept)
        self.uses[:] = uses

    def _learn(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, size of each piece).  Those that don't end in white space are joined to one
        text and told apart again by the blank, which only a piece's first token holds."""
        last = np.where(ends > starts, data[np.maximum(ends - 1, 0)], 32)
        alone = _SPACE[last]
        for i in np.flatnonzero(last > 127):  # the last character may be white space beyond ASCII
            alone[i] = data[starts[i] : ends[i]].tobytes().decode()[-1].isspace()
        (joined,) = self._ids([join(data, starts[~alone], ends[~alone])])
        bounds = np.append(np.flatnonzero(self.blank[joined]), len(joined))
        if not alone.any():
            return joined, np.diff(bounds)
        got = self._ids([" " + data[a:b].tobytes().decode() for a, b in zip(starts[alone], ends[alone], strict=True)])
        size, begin = np.empty(len(starts), np.int64), np.empty(len(starts), np.int64)
        size[~alone], begin[~alone] = np.diff(bounds), bounds[:-1]
        size[alone] = [len(g) for g in got]
        begin[alone] = len(joined) + np.cumsum(size[alone]) - size[alone]
        return np.concatenate([joined, *got])[ragged(begin, size)], size

    def _codes(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The memo's numbers of pieces; new ones are learned."""
        keys, begins = span_hash(prefix_hash(data), starts, ends), first_bytes(data, starts, ends)
        codes = self.memo.find(keys, begins)
        unknown = np.flatnonzero(codes < 0)
        if len(unknown):
            order = unknown[np.lexsort((begins[unknown], keys[unknown]))]
            k, s = keys[order], begins[order]
            new = order[np.concatenate([[True], (k[1:] != k[:-1]) | (s[1:] != s[:-1])])]
            self._add(keys[new], begins[new], *self._learn(data, starts[new], ends[new]))
            codes[unknown] = self.memo.find(keys[unknown], begins[unknown])
        self.uses += np.bincount(codes, minlength=len(self.uses))
        return codes

    def encode(self, arr: pa.Array, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets): the ids of text i are ``ids[offsets[i]:offsets[i+1]]``; null is empty."""
        if len(self.keys) > MEMO_PIECES:
            self._shrink()
        arr = pc.fill_null(arr.cast(pa.large_string()), "")
        n = len(arr)
        runs = pc.match_substring_regex(arr, self.whole)
        whole = np.flatnonzero(runs.to_numpy(zero_copy_only=False))
        data, offsets = text_bytes(pc.if_else(runs, "", arr) if len(whole) else arr)
        blank = np.flatnonzero(data == 32)
        before = np.searchsorted(blank, offsets)  # blanks before each text
        close = np.minimum(np.append(blank[1:], len(data)), np.repeat(offsets[1:], np.diff(before)))
        # A text's first part has no blank before it.
        head_end = np.minimum(np.append(blank, len(data))[before[:-1]], offsets[1:])
        raw = data.tobytes()
        heads = self._ids([raw[a:b].decode() for a, b in zip(offsets[:-1].tolist(), head_end.tolist(), strict=True)])
        lead = np.zeros(n + len(blank), bool)
        lead[before[:-1] + np.arange(n)] = True
        length, start = np.empty(len(lead), np.int64), np.empty(len(lead), np.int64)
        if len(blank):
            code = self._codes(data, blank + 1, close)
            length[~lead], start[~lead] = self.size[code], self.start[code]
        length[lead] = size = np.array([len(h) for h in heads], np.int64)
        start[lead] = len(self.pool) + np.cumsum(size) - size
        tokens = np.diff(np.concatenate([[0], np.cumsum(length)])[before + np.arange(n + 1)])
        ids = np.concatenate([self.pool, *heads])[ragged(start, length)]
        extra = {int(i): self._ids([arr[int(i)].as_py()])[0] for i in whole}
        if not extra and end is None:
            return ids, np.concatenate([[0], np.cumsum(tokens)])
        return _insert(ids, tokens, extra, end, self.dtype)


def join(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> str:
    """The pieces with a blank before each."""
    size = ends - starts
    out = np.full(int(size.sum()) + len(size), 32, np.uint8)
    out[ragged(np.cumsum(size) - size + np.arange(1, len(size) + 1), size)] = data[ragged(starts, size)]
    return out.tobytes().decode()


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of the concatenated ranges [start, start + length)."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total) + np.repeat(starts - (ends - lengths), lengths)


def _insert(ids, tokens, extra, end, dtype):
    """Put in the texts that were encoded whole, and the end id after each text."""
    step = int(end is not None)
    final = tokens.copy()
    for i, e in extra.items():
        final[i] = len(e)
    offsets = np.concatenate([[0], np.cumsum(final + step)])
    out = np.empty(offsets[-1], dtype)
    out[ragged(offsets[:-1], tokens)] = ids
    for i, e in extra.items():
        out[offsets[i] : offsets[i] + len(e)] = e
    if step:
        out[offsets[1:] - 1] = end
    return out, offsets


def crc(ids: np.ndarray) -> int:
    """Unsigned CRC-32 of the ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(ids.astype("<u4").tobytes())


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder of this vocabulary; its memo lasts over tasks."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def forget() -> None:
    """Free the worker's encoders: once texts are encoded, later tasks need their memory."""
    _encoders.clear()
