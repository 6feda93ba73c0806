import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from trailmark.llm import language_model as lm

from odd_texts import TEXTS

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def tokens(text):
    return [*WORD.findall((text or "").translate(LOW)), "\n"]


def base(texts, training):
    c = Counter(x for t in training for x in tokens(t))
    n, v = sum(c.values()), len(c)
    for t in texts:
        k = tokens(t)
        yield len(k), sum(c[x] > 0 for x in k), sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in k)


@pytest.mark.parametrize("head", [lm.HEAD, 8])
def test_base_matches_brute_force(spark, odd, monkeypatch, head):
    """With all tokens in memory, and with nearly all looked up by the join."""
    monkeypatch.setattr(lm.learn_vocabulary, "__defaults__", (head,))
    training = odd.where("doc_id <> 7")
    rows = lm.score(odd, training).collect()
    want = sorted(base([t for _, t in TEXTS], [t for d, t in TEXTS if d is not None and d != 7]))
    got = sorted((r["n_tokens"], r["n_known"], r["base_score"]) for r in rows)
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert np.allclose([g[2] for g in got], [w[2] for w in want])
    assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in rows)
    assert len({r["train_tokens"] for r in rows}) == 1


def softmax(weights, rows):
    """Plain sums of rows, one history at a time."""
    z = sum(weights[r].astype(float) for r in rows)
    return np.exp(z - z.max()) / np.exp(z - z.max()).sum()


def test_probabilities_add_up_to_one(spark, odd):
    """Over all known tokens and one unknown token of each class, after any history."""
    plain = odd.select("doc_id", "text")
    v, _ = lm.learn_vocabulary(lm.count_tokens(plain))
    weights = lm.train_weights(plain, v)
    history = np.array([1, 2, 3], np.uint64)
    total = 0.0
    for c in range(lm.CLASSES):
        outer, inner = lm.features(history, np.array([3, 1, c]), np.zeros(3, np.int64), np.array([2]), v.hashed)
        p_class, p_slot = softmax(weights, outer[:, 0])[c], softmax(weights, inner[:, 0])
        mine = lm.class_of(v.keys) == c
        inside = (p_slot[v.slot[mine]] * 10 ** v.within[mine]).sum() + p_slot[lm.REST] * 10 ** (math.log10(lm.ALPHA) - v.rest_log[c])
        total += p_class * inside
    assert abs(total - 1) < 1e-3


@pytest.mark.parametrize("head", [lm.HEAD, 8])
def test_score_matches_a_walk_over_tokens(spark, odd, head):
    """The stored score against one token at a time, rare tokens' counts from a dictionary."""
    plain = odd.select("doc_id", "text")
    counts = lm.count_tokens(plain)
    v, least = lm.learn_vocabulary(counts, head)
    weights = lm.train_weights(plain, v)
    got = sorted((r["n_tokens"], r["score"]) for r in lm.finish(lm.score_known(plain, v, weights), counts, v, least).collect())
    c = Counter(x for _, t in TEXTS for x in tokens(t))
    want = []
    for _, t in TEXTS:
        names = tokens(t)
        keys, spelling, offsets = lm.token_keys(pa.array([t or ""]))
        classes, total = lm.class_of(keys), 0.0
        place, known = v.find(keys, spelling)
        slots = v.slots_of(place, known)
        walk = range(len(names)) if len(names) < 500 else []
        for i in walk:
            outer, inner = lm.features(keys, classes, np.zeros(len(keys), np.int64), np.array([i]), v.hashed)
            total += math.log10(softmax(weights, outer[:, 0])[classes[i]]) + math.log10(softmax(weights, inner[:, 0])[slots[i]])
            if slots[i] == lm.REST:
                total += math.log10(c[names[i]] + lm.ALPHA) - v.rest_log[classes[i]]
        if walk:
            want.append((len(names), total))
    got = [g for g in got if g[0] < 500]
    assert [g[0] for g in got] == [w[0] for w in sorted(want)]
    assert np.allclose([g[1] for g in got], [w[1] for w in sorted(want)], atol=1e-3)


def test_chunks_give_the_same_scores():
    rng = np.random.default_rng(3)
    n, hashed = 9000, 1024
    keys, slot = rng.integers(0, 2**63, n, dtype=np.uint64), rng.integers(0, lm.SLOTS, n)
    classes, offsets = lm.class_of(keys), np.array([0, 10, 4095, 4097, 4098, 8800, n])
    w = rng.normal(size=(4 * hashed + 2 * lm.PAIRS + (lm.CLASSES + 1) * lm.CLASSES, lm.CLASSES)).astype(np.float32)
    whole = lm._model_scores(w, hashed, keys, classes, slot, offsets)
    each = np.concatenate([lm._model_scores(w, hashed, keys[a:b], classes[a:b], slot[a:b], np.array([0, b - a])) for a, b in zip(offsets[:-1], offsets[1:], strict=True)])
    assert np.allclose(whole, each, atol=1e-4)


def test_tokens_that_share_a_key_are_told_apart():
    keys, spelling = np.array([7, 7, 7, 9], np.uint64), np.array([1, 2, 1, 1], np.uint64)
    k, s, n = lm._counted(keys, spelling)
    assert sum(n) == 4 and {(a, b) for a, b in zip(k.tolist(), s.tolist(), strict=True)} == {(7, 1), (7, 2), (9, 1)}
    v = lm.Vocabulary(np.array([7, 7], np.uint64), np.array([1, 2], np.uint64), np.array([5, 3]), np.full(lm.CLASSES, 8.0), np.full(lm.CLASSES, 2.0))
    place, known = v.find(keys, spelling)
    assert known.tolist() == [True, True, True, False] and v.counts[place[:3]].tolist() == [5, 3, 5]


def test_updates_add_up_in_any_order():
    rng = np.random.default_rng(1)
    made = [(b, rng.normal(size=(5, lm.CLASSES)).astype(np.float16), rng.integers(0, 9, 5)) for b in (0, 1, 0, 0)]
    batches = [lm._update(b, k % 2, m, t) for k, (b, m, t) in enumerate(made)]
    once = {r.column("block")[0].as_py(): r.column("moved")[0].as_py() for r in lm._added(batches, ("block",))}
    twice = {r.column("block")[0].as_py(): r.column("moved")[0].as_py() for r in lm._added(list(lm._added(batches[::-1], ("block", "salt"))), ("block",))}
    assert once == twice
    want = sum(m.astype(float) * t[:, None] for b, m, t in made if b == 0)
    assert np.allclose(np.frombuffer(once[0], "f8").reshape(-1, lm.CLASSES), want)


def test_nothing_to_learn_from(spark, odd, none):
    rows = lm.score(odd, none).collect()
    assert len(rows) == len(TEXTS) and all(r["n_known"] == 0 and r["train_tokens"] == 0 and math.isfinite(r["score"]) for r in rows)
    assert lm.score(none, odd).count() == 0


def test_better_than_frequencies_on_held_out(spark):
    d = "/root/testdata/sf0.01"
    rows = lm.op10(spark, d).where("held_out").collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 10 == 0) for r in rows)
    assert sum(r["score"] for r in rows) > sum(r["base_score"] for r in rows)


def test_every_position_trains(spark, odd):
    """The context rows of every position of every document have moved."""
    plain = odd.select("doc_id", "text")
    v, _ = lm.learn_vocabulary(lm.count_tokens(plain))
    weights = lm.train_weights(plain, v)
    keys, spelling, offsets = lm.token_keys(pa.array([t or "" for _, t in TEXTS]))
    assert v.find(keys, spelling)[1].all()
    begin = np.repeat(offsets[:-1], np.diff(offsets))
    for rows in lm.features(keys, lm.class_of(keys), begin, np.arange(len(keys)), v.hashed):
        assert (np.abs(weights[rows]).sum(2) > 0).all()


@pytest.mark.parametrize("rounds", [1, 2, 3])
def test_rounds_share_the_positions(rounds):
    keys, _, offsets = lm.token_keys(pa.array(["a b c d e f g h " * 50, "", "a b c"]))
    got = np.concatenate([lm.trained_at(keys, offsets, k, rounds, lm.THIN) for k in range(rounds)])
    assert sorted(got) == list(range(len(keys)))
