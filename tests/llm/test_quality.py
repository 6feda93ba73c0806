import numpy as np
import pyarrow as pa
import pytest

from trailmark.llm import docstats, quality_gam, quality_rules, toxicity

from odd_texts import TEXTS


def brute(text):
    import re

    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines, seen, dup = text.split("\n"), set(), 0
    for x in lines:
        if re.search(r"[^\x20\x09-\x0D]", x):
            dup += x in seen
            seen.add(x)
    grams = {}
    for i in range(len(words) - 4):
        grams.setdefault(tuple(words[i : i + 5]), []).append(i)
    covered = {j for at in grams.values() if len(at) > 1 for i in at for j in range(i, i + 5)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def test_base_counts_match_brute_force():
    texts = [t for _, t in TEXTS] + ["a b c d e a b c d e f", "x\nx\ny\n\n\nx", "# * & | < > $ % #", "a a a a a a a", "l1 \nl1\nl1 \n"]
    base, x = docstats.statistics(pa.array(texts, pa.string()))
    got = list(zip(*(base[c].tolist() for c in docstats.BASE), strict=True))
    assert got == [brute(t) for t in texts]
    assert x.shape == (len(texts), len(docstats.FEATURES)) and np.isfinite(x).all()
    assert docstats.statistics(pa.array([], pa.string()))[1].shape == (0, len(docstats.FEATURES))


def sample(n=2000):
    rng = np.random.default_rng(5)
    x = rng.random((n, len(docstats.FEATURES)))
    y = ((x[:, 2] < 0.4) & (x[:, 4] < 0.7) | (x[:, 0] * x[:, 1] > 0.8)).astype(int)
    return x, y


def test_trees_learn_and_keep_monotone():
    x, y = sample()
    m = quality_rules.fit(x[:1500], y[:1500])
    assert ((m.probability(x[1500:]) >= 0.5) == y[1500:]).mean() > 0.92
    for f, sign in quality_rules.MONOTONE.items():
        k = docstats.FEATURES.index(f)
        lo, hi = x[:300].copy(), x[:300].copy()
        lo[:, k], hi[:, k] = 0.1, 0.9
        assert (sign * (m.margin(hi) - m.margin(lo)) >= -1e-9).all()


@pytest.mark.parametrize("fit", [quality_rules.fit, quality_gam.fit])
def test_models_without_rows_or_with_one_class(fit):
    x, _ = sample(50)
    assert np.allclose(fit(x[:0], np.zeros(0, int)).probability(x), 0.5)
    assert (fit(x, np.ones(50, int)).probability(x) > 0.9).all()
    assert (fit(x, np.zeros(50, int)).probability(x) < 0.1).all()


def test_gam_tables_add_up_and_find_interactions():
    rng = np.random.default_rng(6)
    x = rng.random((3000, 6))
    y = ((x[:, 0] > 0.5) ^ (x[:, 3] > 0.5)).astype(int)
    m = quality_gam.fit(x[:2000], y[:2000])
    assert (0, 3) in m.pairs
    assert ((m.probability(x[2000:]) >= 0.5) == y[2000:]).mean() > 0.95
    by_hand = m.intercept + sum(t[np.searchsorted(e, x[7, f])] for f, (e, t) in enumerate(zip(m.edges, m.tables, strict=True)))
    by_hand += sum(t[np.searchsorted(m.coarse[a], x[7, a]), np.searchsorted(m.coarse[b], x[7, b])] for (a, b), t in zip(m.pairs, m.pair_tables, strict=True))
    assert m.margin(x[7:8])[0] == pytest.approx(by_hand)


def test_odd_documents(spark, odd, none, sf_dir):
    rules, gam, tox = quality_rules.train(spark, sf_dir), quality_gam.train(spark, sf_dir), toxicity.train(spark, sf_dir)
    for got, empty in ((quality_rules.annotate(odd, rules), quality_rules.annotate(none, rules)), (quality_gam.score(odd, gam), quality_gam.score(none, gam)), (toxicity.score(odd, tox), toxicity.score(none, tox))):
        rows = got.collect()
        assert len(rows) == len(TEXTS) and empty.count() == 0
        assert all(0 <= r["score"] <= 1 for r in rows)
    rows = quality_rules.annotate(odd, rules).collect()
    assert all(not r["kept"] for r in rows if r["n_words"] < 10)
    kept = odd.where(quality_rules.kept(odd["text"], rules))
    assert kept.columns == odd.columns and kept.count() == sum(r["kept"] for r in rows)
    assert odd.where(quality_gam.accepted(odd["text"], gam)).count() == quality_gam.score(odd, gam).where("predicted = 1").count()


def test_held_out_quality(spark):
    d = "/root/testdata/sf0.01"
    labels = spark.read.parquet(f"{d}/labels.parquet")
    q = quality_gam.op6(spark, d).join(labels, "doc_id").where("held_out").collect()
    assert np.mean([r["predicted"] == r["quality"] for r in q]) > 0.95
    t = toxicity.op7(spark, d).join(labels, "doc_id").where("held_out").collect()
    assert np.mean([r["predicted"] == r["toxic"] for r in t]) > 0.9
    assert sum(r["predicted"] > r["toxic"] for r in t) <= 0.03 * len(t)
    k = quality_rules.op5(spark, d).join(labels, "doc_id").collect()
    assert np.mean([r["kept"] for r in k if r["quality"] == 1 and not r["base_failed"]]) > 0.98
    assert np.mean([r["kept"] for r in k if r["quality"] == 0]) < 0.05


def test_pu_risk_is_corrected():
    rng = np.random.default_rng(9)
    n_p, n_u, pi = 300, 3000, 0.2
    hidden = rng.random(n_u) < pi
    doc, bucket = [], []
    for d in range(n_p + n_u):
        is_positive = d < n_p or hidden[d - n_p]
        for b in range(20):
            if rng.random() < (0.7 if is_positive and b < 5 else 0.1):
                doc.append(d)
                bucket.append(1000 + b)
    m = toxicity.fit(np.array(doc), np.array(bucket), np.arange(n_p + n_u) < n_p, pi)
    g = m.bias + np.bincount(doc, m.weights[bucket], n_p + n_u)
    assert ((g[n_p:] > 0) == hidden).mean() > 0.93  # though no negative was ever seen
    empty = toxicity.fit(np.zeros(0, int), np.zeros(0, int), np.zeros(0, bool), 0.3)
    assert empty.probability(pa.array(["a", None])).tolist() == pytest.approx([0.3, 0.3])


def test_flat_trees_equal_a_walk_from_node_to_node():
    x, y = sample(400)
    m = quality_rules.fit(x, y, trees=12)

    def walk(row):
        total = m.bias
        for node in m.roots:
            while m.left[node] != node:
                node = m.left[node] if row[m.feature[node]] <= m.threshold[node] else m.right[node]
            total += m.value[node]
        return total

    assert m.margin(x[:60]) == pytest.approx([walk(r) for r in x[:60]])


def test_rules_on_documents_they_were_not_fitted_on(spark):
    d = "/root/testdata/sf0.01"
    fold = docstats.crc_mod("doc_id", 3) != 1
    model = quality_rules.fit(*docstats.fit_features(docstats.labelled(spark, d, "quality", fold)))
    docs = spark.read.parquet(f"{d}/documents.parquet")
    got = quality_rules.annotate(docs, model).where(~fold).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("not base_failed").collect()
    good, bad = [r["kept"] for r in got if r["quality"] == 1], [r["kept"] for r in got if r["quality"] == 0]
    assert len(got) > 100 and np.mean(good) > 0.97
    assert not bad or np.mean(bad) < 0.1


def test_training_without_labels_or_documents(spark, tmp_path):
    for t in ("documents", "labels"):
        spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet").where("false").write.parquet(f"{tmp_path}/{t}.parquet")
    for op in (quality_rules.op5, quality_gam.op6, toxicity.op7):
        assert op(spark, str(tmp_path)).count() == 0


def test_words_of_texts_equal_plain_sets():
    texts = ["Bad, bad WORDS!", "", None, "words bad", "other (words)"]
    doc, bucket = toxicity.word_buckets(pa.array(texts))
    got = [set(bucket[doc == i].tolist()) for i in range(len(texts))]
    assert [len(g) for g in got] == [2, 0, 0, 2, 2]
    assert got[0] == got[3] and len(got[0] & got[4]) == 1


def test_fitted_weights_do_not_raise_the_risk_by_a_step_in_any_direction():
    """The learned point is near a minimum of the corrected risk, written out plainly."""
    rng = np.random.default_rng(4)
    n_p, n_u, pi = 200, 1500, 0.25
    hidden = np.append(np.ones(n_p, bool), rng.random(n_u) < pi)
    words = rng.random((n_p + n_u, 6)) < np.where(hidden[:, None] & (np.arange(6) < 3), 0.6, 0.15)
    doc, bucket = np.nonzero(words)
    positive = np.arange(n_p + n_u) < n_p
    m = toxicity.fit(doc, bucket, positive, pi)
    w = m.weights[:6].astype(float)

    def risk(w, b):
        g = words @ w + b
        of = lambda v, rows: np.mean(np.logaddexp(0, v[rows]))
        return pi * of(-g, positive) + max(0.0, of(g, ~positive) - pi * of(g, positive)) + 1e-4 / 2 * (w @ w)

    used = np.flatnonzero(w)
    assert set(used) >= {0, 1, 2}
    here = risk(w, m.bias)
    assert here < risk(np.zeros(6), np.log(pi / (1 - pi))) - 0.02
    for k in used:
        for step in (-0.3, 0.3):
            assert risk(w + step * (np.arange(6) == k), m.bias) > here - 1e-4
