import math

import numpy as np
from pyspark.sql import functions as F

from quillspark.llm import quantised_search, tree_forest
from quillspark.llm.quantised_search import cosines, search
from quillspark.llm.tree_forest import near_vectors

SCHEMA = "vec_id long, embedding array<float>, key string"
ODD = [(None, [1.0, 2.0], "n"), (900, None, "n"), (901, [0.0, 0.0], "n"), (902, [1.0, None], "n"), (903, [float("nan"), 1.0], "n"), (904, [], "n"), (905, [float("inf"), 1.0], "n"), (906, [1.0, 2.0], None), (907, [2.0, 4.0], None)]


def clusters(rng, n, dims):
    out = []
    for i in range(n):
        if out and rng.random() < 0.5:
            v = np.array(out[rng.integers(len(out))][1]) + (0 if rng.random() < 0.3 else rng.standard_normal(dims) * rng.choice([0.02, 0.25, 0.4]) / math.sqrt(dims) * 3)
        else:
            v = rng.standard_normal(dims)
        out.append((i, [float(np.float32(x)) for x in v], "k"))
    return out


def all_links(rows, least=0.9):
    x = np.array([v for _, v, _ in rows])
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    links = x @ x.T >= least
    np.fill_diagonal(links, False)
    return links


def test_links_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(tree_forest, "LEAF", 60)
    monkeypatch.setattr(tree_forest, "BLOCK", 40)
    rows = clusters(np.random.default_rng(1), 900, 32)
    got = {r.vec_id: r for r in near_vectors(spark.createDataFrame(rows + ODD, SCHEMA)).collect()}
    links = all_links(rows)
    found = sum(got[i].n_links for i, _, _ in rows)
    assert all(got[i].n_links <= links[i].sum() for i, _, _ in rows)
    assert found >= 0.97 * links.sum() > 0
    assert all(got[i].component_id <= i and got[i].kept == (got[i].component_id == i) for i, _, _ in rows)
    for i in (900, 901, 902, 903, 904, 905):
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True)
    assert (got[None].n_links, got[None].component_id, got[None].kept) == (0, None, False)
    assert got[906].n_links == got[907].n_links == 1 and got[907].component_id == 906


def test_deep_trees_keep_the_links_of_a_cluster():
    """Each level loses some links of a loose cluster, so more trees are needed the deeper they are."""
    rng = np.random.default_rng(5)
    centre = rng.standard_normal(64)
    hot = centre / np.linalg.norm(centre) + rng.standard_normal((1500, 64)) * math.sqrt(0.1 / 64)
    hot /= np.linalg.norm(hot, axis=1, keepdims=True)
    forest = tree_forest.Forest([*hot, *rng.standard_normal((3000, 64))], 10)
    want, found = hot @ hot.T >= 0.9, np.zeros((1500, 1500), bool)
    for tree in range(forest.trees):
        for _, rows in forest.leaves(hot, tree):
            found[np.ix_(rows, rows)] = True
    assert (found & want).sum() >= 0.985 * want.sum()


def test_a_leaf_that_cannot_be_split_is_compared_whole(spark, monkeypatch):
    monkeypatch.setattr(tree_forest, "LEAF", 10_000)
    monkeypatch.setattr(tree_forest, "BLOCK", 16)
    rows = clusters(np.random.default_rng(2), 150, 8)
    got = {r.vec_id: r.n_links for r in near_vectors(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == dict(enumerate(all_links(rows).sum(1)))


def test_vectors_that_share_an_id(spark):
    """Two vectors whose smallest ids are the same stay two classes."""
    u, v, w = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 1.0, 0.05]
    df = spark.createDataFrame([(1, u, "k"), (1, v, "k"), (2, v, "k"), (4, w, "k"), (3, u, "k"), (3, u, "k")], SCHEMA)
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in near_vectors(df).collect())
    assert got == [(1, 2, 1), (1, 2, 1), (2, 2, 1), (3, 2, 1), (3, 2, 1), (4, 2, 1)]


def nearest(rows, query, k=5):
    """By exact cosines in order of components, ties to the smaller id."""
    q = np.array(next(v for i, v, *_ in rows if i == query), float)
    others = [(i, np.array(v, float)) for i, v, *_ in rows if i != query and len(v) == len(q)]
    found = zip(cosines(q, np.array([v for _, v in others])) if others else [], (i for i, _ in others))
    return sorted(((-s, i) for s, i in found))[:k]


def answers(got):
    out = {}
    for r in sorted(got, key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((-r.score, r.vec_id))
    return out


def test_search_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(quantised_search, "DATA_BLOCK", 700)
    monkeypatch.setattr(quantised_search, "WAVE", 5000)
    rows = clusters(np.random.default_rng(3), 3000, 30)
    got = search(spark.createDataFrame(rows, SCHEMA).repartition(3), F.col("id") % 50 == 0).collect()
    found, right = answers(got), 0
    for q in range(0, 3000, 50):
        want = nearest(rows, q)
        assert [r["rank"] for r in sorted((r for r in got if r.query_id == q), key=lambda r: r["rank"])] == [1, 2, 3, 4, 5]
        right += len(set(want) & set(found[q]))
    assert right >= 0.99 * 300


def test_ties_go_to_the_smaller_id(spark):
    """More copies than candidates, and near copies with the same codes."""
    rng = np.random.default_rng(4)
    v = rng.standard_normal(16)
    rows = [(i, [float(np.float32(x)) for x in v], "k") for i in range(1000)]
    rows += [(i, [float(np.float32(x)) for x in v + rng.standard_normal(16) * 1e-4], "k") for i in range(1000, 2000)]
    rng.shuffle(rows)
    rows = [(int(i), v, k) for i, v, k in rows]
    found = answers(search(spark.createDataFrame(rows, SCHEMA), F.col("id") % 50 == 0).collect())
    assert [i for _, i in found[500]] == [0, 1, 2, 3, 4] and [i for _, i in found[0]] == [1, 2, 3, 4, 5]
    assert all(found[q] == nearest(rows, q) for q in (0, 500, 1050, 1950))


def test_several_lengths_and_repeated_ids(spark):
    rng = np.random.default_rng(6)
    rows = [(i, [float(np.float32(x)) for x in rng.standard_normal(7 if i % 9 == 0 else 20 if i % 2 else 32)], "k") for i in range(600)]
    found = answers(search(spark.createDataFrame(rows + rows[:50], SCHEMA), F.col("id") % 50 == 0).collect())
    assert sorted(found) == list(range(0, 600, 50)) and all(found[q] == nearest(rows, q) for q in found)
    twice = [(0, [1.0, 0.0], "a"), (0, [0.0, 1.0], "a"), (1, [1.0, 0.1], "a")]
    assert [i for _, i in answers(search(spark.createDataFrame(twice, SCHEMA), F.col("id") % 50 == 0).collect())[0]] == [1]


def test_small_and_odd_tables(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0], "a"), (50, [1.0, 1.0], "b"), (3, [2.0, 0.0], "c"), (4, [-1.0, 0.1], None)] + ODD[:7], SCHEMA)
    got = [tuple(r)[:3] for r in search(df, F.col("id") % 50 == 0).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 3), (0, 2, 50), (0, 3, 4), (50, 1, 0), (50, 2, 3), (50, 3, 4)]
    assert search(df.limit(0), F.col("id") % 50 == 0).count() == 0
    assert search(df, F.col("id") < 0).count() == 0
    assert near_vectors(df.limit(0)).count() == 0
