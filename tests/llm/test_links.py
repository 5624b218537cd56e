"""Near duplicates, vector links, top-k and components against brute force."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from stationcast.llm import minhash, topk, vectors
from stationcast.llm.components import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def groups(nodes, links):
    root = {n: n for n in nodes}

    def top(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in links:
        p, q = top(a), top(b)
        root[max(p, q)] = min(p, q)
    return {n: top(n) for n in nodes}


def test_components_equal_union_find(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(20)] + [(7, None), (3, 3)]
    df = spark.createDataFrame(edges, "a long, b long")
    real = [(a, b) for a, b in edges if b is not None and a != b]
    want = groups({n for e in real for n in e}, real)
    assert {r.node: r.component for r in components(spark, df).collect()} == want
    assert components(spark, df.limit(0)).count() == 0


def shingles(text, n):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


@pytest.mark.parametrize("n", [4, 5])
def test_near_duplicates_equal_brute_force(spark, n):
    rng = random.Random(n)
    vocab = [f"w{i}" for i in range(400)]
    texts = []
    for _ in range(12):
        base = [rng.choice(vocab) for _ in range(rng.randrange(5, 120))]
        for edits in (0, 0, 1, 2, 4, 8):
            words = list(base)
            for _ in range(edits):
                words[rng.randrange(len(words))] = rng.choice(vocab)
            texts.append(" ".join(words))
    # One large group of near copies around the threshold.
    base = [rng.choice(vocab) for _ in range(90)]
    for _ in range(40):
        words = list(base)
        for at in rng.sample(range(90), 2):
            words[at] = rng.choice(vocab)
        texts.append("  ".join(words).upper())
    texts += [None, "", " \n", "one", "One", "a b c", "a  b\tc", "Émile É", "émile é"]
    df = spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(texts)] + [(None, texts[0], None, None, None)], DOCS)
    found = minhash.near_duplicates(spark, df.withColumn("component_id", F.lit("clash")), words=n).collect()
    sets = [shingles(t, n) for t in texts]
    links = [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    want = groups(range(len(texts)), links)
    assert len(found) == len(texts) + 1
    for r in found:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), want[r.doc_id], want[r.doc_id] == r.doc_id)


def test_near_duplicates_of_repeated_ids_and_empty_tables(spark):
    a, b = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    df = spark.createDataFrame([(i, t, None, None, None) for i, t in ((5, a), (5, b), (7, a), (8, b), (9, b + " c"))], DOCS)
    assert {r.doc_id: r.component_id for r in minhash.near_duplicates(spark, df).collect()} == {5: 5, 7: 5, 8: 5, 9: 5}
    assert minhash.near_duplicates(spark, df.limit(0)).count() == 0


def test_vector_links_equal_brute_force(spark):
    rng = np.random.default_rng(7)
    m = rng.normal(size=(600, 16))
    m[100:140] = m[0] + 0.25 * rng.normal(size=(40, 16))
    m[200:204] = m[5]
    data = [(i, v.tolist(), 0) for i, v in enumerate(m)]
    odd = [None, [0.0] * 16, [float("nan")] + [1.0] * 15, [None] + [1.0] * 15, [1.0, 2.0], [2.0, 4.0], [], [1e-200] * 16]
    df = spark.createDataFrame(data + [(1000 + i, v, 0) for i, v in enumerate(odd)] + data[:3], "vec_id long, embedding array<double>, n_links int")
    found = {r.vec_id: r for r in vectors.link_vectors(spark, df, leaf=64).collect()}
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    near = u @ u.T >= 0.9
    np.fill_diagonal(near, False)
    links = list(zip(*np.nonzero(near)))
    want = groups(range(600), links)
    assert len(found) == 600 + len(odd)
    missed = sum(int(near[i].sum()) - found[i].n_links for i in range(600))
    assert all(found[i].n_links <= near[i].sum() for i in range(600)) and missed <= 0.02 * near.sum()
    assert all(found[i].component_id == want[i] for i in range(600))
    assert [found[1000 + i].n_links for i in range(7)] == [0, 0, 0, 0, 1, 1, 0]
    assert found[1005].component_id == 1004 and not found[1005].kept
    assert vectors.link_vectors(spark, df.limit(0)).count() == 0


def test_links_of_a_hot_group_survive_deep_trees():
    rng = np.random.default_rng(9)
    m, k = rng.normal(size=(9000, 64)), 3000
    centre = rng.normal(size=64)
    m[:k] = centre / np.linalg.norm(centre) + rng.normal(size=(k, 64)) / 24
    m = vectors.unit(m)
    # As deep as for a million rows or as the sample allows.
    forest = vectors.grow_forest(m, 1_000_000)
    assert len(forest[0]["directions"]) == 9
    leaves = [set(x) for x in vectors.leaves_of(forest, m[:400])]
    i, j = np.nonzero(np.triu(m[:400] @ m[:400].T >= 0.9, 1))
    assert len(i) > 1000
    missed = sum(not leaves[a] & leaves[b] for a, b in zip(i.tolist(), j.tolist()))
    assert missed <= 0.002 * len(i)


def test_top_k_equals_brute_force_with_ties(spark):
    rng = np.random.default_rng(8)
    m = rng.integers(-2, 3, (300, 6)) / 4.0
    data = [(i, v.tolist()) for i, v in enumerate(m)]
    odd = [(1000, None), (1001, [None] + [1.0] * 5), (1002, [float("inf")] * 6), (1020, [1.0, 1.0]), (1021, [1.0, 0.5])]
    df = spark.createDataFrame(data + odd + data[:2], "vec_id long, embedding array<double>").withColumn("score", F.lit("clash"))
    found = topk.top_k(df, F.col("id") % 20 == 0, k=20).collect()
    v = np.floor(64 * m).astype(int)
    for q in range(0, 300, 20):
        best = sorted(((-int(v[q] @ v[i]), i) for i in range(300) if i != q))[:20]
        assert [(r.vec_id, r.score) for r in sorted((r for r in found if r.query_id == q), key=lambda r: r.rank)] == [(i, -s) for s, i in best]
    assert [(r.vec_id, r.score, r.rank) for r in found if r.query_id == 1020] == [(1021, 64 * 64 + 64 * 32, 1)]
    assert topk.top_k(df.limit(0), F.col("id") % 20 == 0).count() == 0


def test_top_k_over_many_cells_shares_thresholds_and_keeps_ties(spark, monkeypatch):
    monkeypatch.setattr(topk, "ROW_BLOCK", 60)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 7)
    rng = np.random.default_rng(10)
    # A third of the rows are one vector, so that scores tie across cells; ids repeat with another vector.
    m = np.round(rng.normal(size=(400, 64)), 1)
    m[::3] = m[0]
    data = [(i, v.tolist()) for i, v in enumerate(m)]
    found = topk.top_k(spark.createDataFrame(data, "vec_id long, embedding array<double>"), F.col("id") % 20 == 0, k=20).collect()
    v = np.floor(64 * m).astype(int)
    for q in range(0, 400, 20):
        best = sorted(((-int(v[q] @ v[i]), i) for i in range(400) if i != q))[:20]
        assert [(r.vec_id, r.score) for r in sorted((r for r in found if r.query_id == q), key=lambda r: r.rank)] == [(i, -s) for s, i in best]


def test_large_integers_are_multiplied_exactly():
    rng = np.random.default_rng(11)
    q, r = rng.integers(-(2**28), 2**28, (4, 8)), rng.integers(-(2**28), 2**28, (30, 8))
    qi, ri, score = topk.best_in_block(q, np.arange(4) + 100, r, np.arange(30), 5)
    for i in range(4):
        best = sorted(((-int(sum(int(a) * int(b) for a, b in zip(q[i], x))), j) for j, x in enumerate(r)))[:5]
        assert [(int(ri[n]), int(score[n])) for n in np.flatnonzero(qi == i)] == [(j, -s) for s, j in best]
