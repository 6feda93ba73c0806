import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from trailmark.llm import near_dedup

from odd_texts import TEXTS


def words(rng, n):
    return [f"w{rng.randrange(5000)}" for _ in range(n)]


def edit(rng, ws, k):
    ws = list(ws)
    for _ in range(k):
        ws[rng.randrange(len(ws))] = f"e{rng.randrange(10**6)}"
    return ws


@pytest.fixture(scope="module")
def corpus():
    """A large group of near copies, exact copies, a shared passage, and clean texts."""
    rng = random.Random(4)
    base, passage = words(rng, 300), words(rng, 90)
    texts = [" ".join(edit(rng, base, rng.choice([0, 1, 3, 6, 12, 20]))) for _ in range(220)]
    texts += [" ".join(words(rng, 60))] * 40
    texts += [" ".join(words(rng, 150) + passage) for _ in range(120)]
    texts += [" ".join(words(rng, rng.randint(5, 200))) for _ in range(150)]
    for _ in range(60):
        t = words(rng, 200)
        texts += [" ".join(t), " ".join(edit(rng, t, rng.choice([1, 2, 4, 8])))]
    rng.shuffle(texts)
    return [(i, t) for i, t in enumerate(texts)]


def brute_classes(rows, idf, threshold=0.8):
    s = near_dedup.Shingles(pa.array([t for _, t in rows], pa.string()), idf)
    v = s.vectors()
    e, w = [np.frombuffer(x[0], "<u8") for x in v], [np.frombuffer(x[1], np.uint8) for x in v]
    near = near_dedup.similarities(e, w) >= threshold - 1e-9
    for i in range(0, len(rows), 17):  # the matrix against plain sets
        for j in range(len(rows)):
            common = np.intersect1d(e[i], e[j], return_indices=True)[1]
            total = w[i].sum(dtype=int) + w[j].sum(dtype=int) - w[i][common].sum(dtype=int)
            assert near[i, j] == (total == 0 or w[i][common].sum(dtype=int) / total >= threshold - 1e-9)
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in np.argwhere(near):
        a, b = find(i), find(j)
        root[max(a, b)] = min(a, b)
    return {rows[i][0]: rows[find(i)][0] for i in range(len(rows))}


@pytest.mark.parametrize(("block", "pivots"), [(128, 48), (16, 4), (16, 0)])
def test_classes_match_brute_force(spark, corpus, monkeypatch, block, pivots):
    """With one comparison of each pair's blocks, with few pivots, and with none."""
    monkeypatch.setattr(near_dedup, "BLOCK", block)
    monkeypatch.setattr(near_dedup, "PIVOTS", pivots)
    df = spark.createDataFrame(corpus, "doc_id long, text string")
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.classes(df).collect()}
    idf = near_dedup.word_idf(*near_dedup.word_frequencies(df))
    want = brute_classes(corpus, idf)
    wrong = [d for d in want if got[d] != want[d]]
    assert len(got) == len(corpus) and len(wrong) <= 2  # a link near 0.8 is missed once in hundreds
    assert all(want[d] == want[got[d]] for d in got)  # and none is made up


def test_samples_agree_as_often_as_sets_are_similar():
    idf = np.random.default_rng(1).random(near_dedup.WORD_BUCKETS).astype(np.float32)
    rng = random.Random(8)
    base = words(rng, 400)
    texts = [" ".join(base)] + [" ".join(edit(rng, base, k)) for k in (2, 5, 10, 20, 40)]
    s = near_dedup.Shingles(pa.array(texts), idf)
    v = s.vectors()
    j = near_dedup.similarities([np.frombuffer(x[0], "<u8") for x in v], [np.frombuffer(x[1], np.uint8) for x in v])
    m = s.samples()
    for i in range(1, len(texts)):
        assert abs((m[0] == m[i]).mean() - j[0, i]) < 0.17


def test_odd_documents(spark, odd, none):
    got = {(r["doc_id"], r["class_id"]) for r in near_dedup.classes(odd).collect()}
    assert got == {(1, 1), (2, 2), (3, 2), (4, 2), (None, None), (5, 5), (6, 6), (7, 7), (8, 8), (-9, -9)}
    kept = near_dedup.keep_one(odd)
    assert kept.columns == odd.columns
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0) for r in kept.collect()) == [(False, 0), (True, -9), (True, 1), (True, 2), (True, 5), (True, 6), (True, 7), (True, 8)]
    assert near_dedup.classes(none).count() == 0 and near_dedup.keep_one(none).count() == 0


def test_components_of_long_chains(spark):
    n = 60
    edges = spark.createDataFrame([(bytes([i]), bytes([i + 1])) for i in range(n) if i not in (20, 40)], "a binary, b binary")
    got = {r["node"][0]: r["root"][0] for r in near_dedup.components(edges).collect()}
    assert got == {i: 0 if i <= 20 else 21 if i <= 40 else 41 for i in range(n + 1)}
    assert len(TEXTS) == 11


MILLIONS = 1_200_000  # over 2^20


def test_components_of_over_a_million_edges(spark):
    """A node and two neighbours each, so that no component is large."""
    node = lambda k: F.encode(F.lpad((F.col("id") * 3 + k).cast("string"), 9, "0"), "utf-8")
    edges = spark.range(MILLIONS // 2).select(F.explode(F.array(*(F.struct(node(k).alias("a"), node(k + 1).alias("b")) for k in (0, 1)))).alias("e")).select("e.*")
    got = near_dedup.components(edges).agg(F.count(F.lit(1)), F.count_distinct("root")).first()
    assert tuple(got) == (MILLIONS // 2 * 3, MILLIONS // 2)


def test_buckets_of_over_a_million_members(spark):
    """Two bands with the same members are the same bucket; one with another member isn't."""
    node = lambda c: F.encode(F.col(c).cast("string"), "utf-8").alias("node")
    ids = spark.range(MILLIONS)
    other = ids.select(F.when(F.col("id") == 0, MILLIONS).otherwise(F.col("id")).alias("id"))
    members = ids.select(F.lit(0).alias("band"), F.lit(5).alias("key"), node("id")).union(ids.select(F.lit(1), F.lit(6), node("id"))).union(other.select(F.lit(2), F.lit(7), node("id")))
    same, also, not_same = near_dedup._buckets(members).orderBy("band").collect()
    assert same["n"] == not_same["n"] == MILLIONS
    assert (same["a"], same["b"]) == (also["a"], also["b"]) and same["a"] != not_same["a"] and same["b"] != not_same["b"]


def test_clashing_names_and_repeated_rows(spark):
    text = "one two three four five six seven eight"
    docs = spark.createDataFrame([(1, text, 7, "a"), (1, text, 7, "a"), (2, text + " nine", 8, "b"), (3, None, 9, "c")], "doc_id long, text string, key_id int, _key_md5 string")
    kept = near_dedup.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"], r["key_id"]) for r in kept.collect()) == [(1, 7), (2, 8), (3, 9)]


def test_blocks_meet_what_pivots_leave_open(spark, monkeypatch):
    """Every two members that aren't both in the largest component meet in some unit."""
    monkeypatch.setattr(near_dedup, "BLOCK", 8)
    n = 100
    group = lambda i: b"000" if i < 60 else b"060" if i < 80 else None
    name = lambda i: b"%03d" % i
    members = spark.createDataFrame([(0, 7, n, name(i), i, name(i)) for i in range(n)], "band int, key bigint, n bigint, node binary, doc_id long, md5 binary")
    roots = lambda f: spark.createDataFrame([(name(i), f(i)) for i in range(n) if f(i)], "node binary, root binary")

    def met(roots):
        units = {}
        for r in near_dedup.second_units(members, roots).collect():
            units.setdefault(tuple(r["unit"]), []).append((int(r["node"]), r["side"]))
        assert max((len(rows) for rows in units.values()), default=0) < 60
        return {(min(a, b), max(a, b)) for u, rows in units.items() for a, s in rows for b, t in rows if a != b and (u[2] == near_dedup.ALL or s != t)}

    assert met(roots(group)) == {(a, b) for a in range(n) for b in range(a + 1, n) if b >= 60}
    assert met(roots(lambda i: b"000")) == set()
    assert met(roots(lambda i: None)) == {(a, b) for a in range(n) for b in range(a + 1, n)}


def test_a_large_group_of_near_copies_costs_in_proportion(spark):
    """Five thousand different near copies: one class, and few rows to compare."""
    rng = random.Random(3)
    base = words(rng, 240)
    texts = [(i, " ".join(edit(rng, base, rng.choice([1, 2, 3])))) for i in range(5000)] + [(5000 + i, " ".join(words(rng, 60))) for i in range(50)]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(4)
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.classes(docs).collect()}
    assert sum(got[i] == 0 for i in range(5000)) >= 0.99 * 5000 and all(got[i] == i for i in range(5000, 5050))
    idf = near_dedup.word_idf(*near_dedup.word_frequencies(docs))
    nodes = near_dedup.sign(docs, idf).groupBy("node").agg(F.min(F.struct("doc_id", "md5", "bands")).alias("s")).select("node", "s.*")
    members = near_dedup.members_of(nodes).cache()
    rows = near_dedup.first_units(members).count()
    assert rows <= members.count() * (1 + 2 * near_dedup.PIVOTS / near_dedup.BLOCK)


def test_components_joined_by_more_links(spark):
    """Against components of all links at once."""
    rng = random.Random(5)
    pairs = lambda n: [tuple(sorted(rng.sample(range(60), 2))) for _ in range(n)]
    frame = lambda rows: spark.createDataFrame([(b"%02d" % a, b"%02d" % b) for a, b in rows], "a binary, b binary")
    first, more = pairs(20), pairs(20)
    want = {(r["node"], r["root"]) for r in near_dedup.components(frame(sorted({*first, *more}))).collect()}
    got = {(r["node"], r["root"]) for r in near_dedup._joined(near_dedup.components(frame(sorted(set(first)))), frame(sorted(set(more)))).collect()}
    assert got == want
    roots = near_dedup.components(frame(sorted(set(first))))
    assert near_dedup._joined(roots, frame(first[:3])).count() == roots.count()
