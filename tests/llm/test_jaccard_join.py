import random

import numpy as np
import pytest

from quillspark.llm import jaccard_join
from quillspark.llm.jaccard_join import Allocation, id_filter, jaccard_components, passes, signatures


def shingles(text, width=3):
    words = [w for w in (text or "").encode().lower().replace(b"\x0b", b" ").split()]
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1)))


def brute(rows, percent=90, width=3):
    """Components of (id, text) rows by all pairs."""
    sets, parent = [(i, shingles(t, width)) for i, t in rows], {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, (i, x) in enumerate(sets):
        for j, y in sets[:a]:
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = sorted((find(i), find(j)))
                parent[q] = p
    return sorted((i, len(x), find(i)) for i, x in sets)


def corpus(rng, n):
    vocabulary = [f"w{k}" for k in range(400)] + ["É", "ß"]
    rows, bases = [], []
    for i in range(n):
        if bases and rng.random() < 0.6:
            words = list(rng.choice(bases))
            for _ in range(rng.randrange(0, 1 + max(1, len(words) // 30))):
                k, kind = rng.randrange(len(words)), rng.randrange(3)
                words[k : k + (kind > 0)] = [rng.choice(vocabulary)] if kind < 2 else []
        else:
            words = rng.choices(vocabulary, k=rng.choice([1, 2, 5, 12, 14, 20, 40, 90, 200, 500]))
            bases.append(words)
        text = "".join(w.upper() if rng.random() < 0.1 and w.isascii() else w + rng.choice([" ", "  ", "\n", "\t", "\x0b"]) for w in words)
        rows.append((i, text))
    return rows


@pytest.mark.parametrize("block", [3, 512])
def test_against_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    rows = corpus(random.Random(block), 350) + [(1000, None), (1001, ""), (1002, " \n")]
    got = jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got)) == brute(rows)


@pytest.mark.parametrize("parts", [1, 3])
def test_copies_in_falling_id_order(spark, parts):
    """Tasks meet other copies of a text before the one with the smallest id."""
    rng = random.Random(11)
    texts = [[f"v{rng.randrange(300)}" for _ in range(120)] for _ in range(6)]
    rows = []
    for k, words in enumerate(texts):
        near = [*words[:-1], "changed"]
        rows += [(900 - 10 * k, " ".join(words)), (500 - 10 * k, " ".join(words)), (100 - 10 * k, " ".join(words)), (1000 + k, " ".join(near))]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = jaccard_components(df if parts == 1 else df.repartition(parts)).collect()
    assert sorted(map(tuple, got)) == brute(rows)


def test_a_chain_of_near_copies(spark, monkeypatch):
    """Ends of the chain aren't similar, and all share most signatures with some."""
    monkeypatch.setattr(jaccard_join, "BLOCK", 7)
    words = [f"w{k}" for k in range(120)]
    rows = []
    for i in range(40):
        words[3 * i % 120] = f"x{i}"
        rows.append((40 - i, " ".join(words)))
    got = jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got)) == brute(rows)


@pytest.mark.parametrize("percent", [80, 90])
@pytest.mark.parametrize("sets", [0, 10**5, 10**9])
def test_partners_share_a_signature(percent, sets):
    """Small sets, where segments are often empty, under the allocations for few and for many sets."""
    rng = np.random.default_rng(3)
    plan = Allocation(percent, 60, dict.fromkeys(range(60), sets))
    tried = 0
    for _ in range(1500):
        n = int(rng.integers(5, 45))
        x = rng.integers(0, 2**63, n).astype(np.uint64)
        y = np.concatenate([x[int(rng.integers(0, 2 + n // 8)) :], rng.integers(0, 2**63, int(rng.integers(0, 2 + n // 12))).astype(np.uint64)])
        both = len(np.intersect1d(x, y))
        if 100 * both < percent * (len(x) + len(y) - both) or both == len(x) == len(y):
            continue
        elements, bounds = np.concatenate([np.sort(x), np.sort(y)]), np.array([0, len(x), len(x) + len(y)])
        sig, of = signatures(elements, bounds, plan)
        assert set(sig[of == 0]) & set(sig[of == 1])
        tried += 1
    assert tried > 200


def test_more_sets_cost_more_signatures():
    """So that fewer sets meet by empty segments."""
    few, many = Allocation(80, 200, {}), Allocation(80, 200, dict.fromkeys(range(60), 10**6))
    assert (many.segments != few.segments).any() and many.ones.any() and not few.ones.any()


def test_filter_passes_all_its_ids(spark):
    words = id_filter(spark.range(0, 5000, 7).select("id"))
    ids = np.arange(5000)
    found = passes(words, ids)
    assert found[::7].all() and found.sum() < 760


@pytest.mark.parametrize("seed", [1, 2])
def test_other_widths_thresholds_and_orders(spark, monkeypatch, seed):
    monkeypatch.setattr(jaccard_join, "ELEMENTS", 300)
    monkeypatch.setattr(jaccard_join, "_COMBINED", 50)
    monkeypatch.setattr(jaccard_join, "_SEEN", 20)
    monkeypatch.setattr(jaccard_join, "_OFTEN", 2 * seed)
    monkeypatch.setattr(jaccard_join, "_WHOLE", 4 * seed)
    monkeypatch.setattr(jaccard_join, "_COUNTS", ((16, 30 * seed), (64, 100), (256, 1 << 62)))
    rng = random.Random(seed)
    rows = corpus(rng, 250)
    rows.append((2000, " ".join(f"long{k}" for k in range(30_000))))
    rows.append((2001, " ".join(f"long{k}" for k in range(500, 30_000))))
    rng.shuffle(rows)
    got = jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), width=5, percent=80).collect()
    assert sorted(map(tuple, got)) == brute(rows, 80, 5)


def test_two_texts_under_one_id(spark):
    words = [f"w{k}" for k in range(60)]
    a, b, c = " ".join(words), " ".join(["x", *words[1:]]), " ".join(f"y{k}" for k in range(60))
    near = c + " more"
    rows = [(5, a), (5, c), (7, b), (3, near), (9, "alone here")]
    got = sorted(map(tuple, jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    assert got == [(3, 59, 3), (5, 58, 3), (5, 58, 3), (7, 58, 3), (9, 1, 9)]


def test_odd_rows(spark):
    rows = [(1, "a b c d", "p"), (1, "a b c d", "q"), (None, "a b c d", None), (3, "A B C D", "r"), (4, "a b", "s"), (5, "A  b", "t"), (6, "b a", "u")]
    df = spark.createDataFrame(rows, "doc_id long, text string, component_id string")
    got = sorted(map(str, map(tuple, jaccard_components(df).collect())))
    assert got == sorted(map(str, [(1, 2, 1), (1, 2, 1), (None, 2, None), (3, 2, 1), (4, 1, 4), (5, 1, 4), (6, 1, 6)]))
    assert jaccard_components(df.limit(0)).count() == 0
