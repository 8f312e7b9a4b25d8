import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.llm import suffix_tree
from quillspark.llm.suffix_tree import BOS, END, OTHER, long_states, score, train


def tokens(text):
    return [*(text or "").encode().lower().split(), None]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    words, out = ["Alpha", "beta", "gamma", "delta", "é", "zeta"], []
    for i in range(300):
        w = ["alpha"]
        for _ in range(rng.randrange(0, 30)):
            w.append(words[(words.index(w[-1]) + 1) % 6] if w[-1] in words and rng.random() < 0.7 else rng.choice([*words, f"r{rng.randrange(500)}"]))
        out.append((i, " ".join(w)))
    return out + [(900, None), (901, ""), (902, "never seen"), (903, "beta\x0bBETA\n")]


def test_base_scores_are_exact_and_the_model_is_better(spark, rows, monkeypatch):
    monkeypatch.setattr(suffix_tree, "KNOWN", 0.002)
    monkeypatch.setattr(suffix_tree, "SYMBOL", 0.01)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    tree, counts, _ = train(df.where("doc_id < 200"))
    seen = Counter(t for i, x in rows if i < 200 for t in tokens(x))
    n, v = sum(seen.values()), len(seen)
    got = {r.doc_id: r for r in score(df, tree, counts).collect()}
    assert len(got) == len(rows)
    for i, x in rows:
        r = got[i]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(tokens(x)), sum(seen[t] > 0 for t in tokens(x)), n)
        assert math.isclose(r.base_score, sum(math.log10((seen[t] + 1) / (n + v + 1)) for t in tokens(x)), abs_tol=1e-9)
    out = [got[i] for i, _ in rows if 200 <= i < 900]
    assert sum(r.score for r in out) > 0.85 * sum(r.base_score for r in out)
    assert any(state.any() for state, *_ in tree.orders[:1]) and len(tree.orders) > 2
    symbols = np.arange(len(tree.words.base_of_symbol))
    for a in (BOS, OTHER, 3, 4):
        for b in (BOS, OTHER, 3, 5):
            p = tree.probability([np.full(len(symbols), x) for x in (b, a, 3, 4)], symbols)
            assert math.isclose(p.sum(), 1, abs_tol=1e-9) and (p[symbols != BOS] > 0).all()


def brute_scores(train_texts, texts, with_long=True):
    """The tree with dictionaries: counts of every context, states by divergence, each token from the longest state."""
    least_share, entry, orders, discount = suffix_tree.CONTEXT, suffix_tree.ENTRY, suffix_tree.ORDERS, suffix_tree.DISCOUNT
    seen = Counter(t for x in train_texts for t in tokens(x))
    n, v = sum(seen.values()), len(seen)
    share = lambda c: (c + 1) / (n + v + 1)
    alphabet = {w for w, c in seen.items() if w is not None and c >= max(2, suffix_tree.SYMBOL * n, suffix_tree.KNOWN * n)}
    symbol = lambda t: "END" if t is None else t if t in alphabet else "OTHER"
    base = {w: share(seen[w]) for w in alphabet} | {"END": share(seen[None])}
    base["OTHER"] = 1 - sum(base.values())
    least = max(2.0, least_share * n)
    sequence = lambda x: ["BOS"] * orders + [symbol(t) for t in tokens(x)]
    corpus = [sequence(x) for x in train_texts]
    frequent = [{(w,) for w, p in (base | {"BOS": base["END"]}).items() if w != "END" and p * n >= least}]
    model = []

    def probability(history, w, depth):
        p = base[w]
        for k in range(1, depth + 1):
            context = tuple(history[-k:])
            if context not in frequent[k - 1]:
                break
            if context in model[k - 1]:
                weight, own = model[k - 1][context]
                p = own.get(w, 0) + weight * p
        return p

    for order in range(1, orders + 1):
        follow = defaultdict(Counter)
        for seq in corpus:
            for i in range(orders, len(seq)):
                if (context := tuple(seq[i - order : i])) in frequent[order - 1]:
                    follow[context][seq[i]] += 1
        states, longer = {}, set()
        for context, counts in follow.items():
            total = sum(counts.values())
            own = {w: (c - discount) / total for w, c in counts.items() if c >= max(2.0, entry * n)}
            weight = 1 - sum(own.values())
            before = {w: probability(context[1:], w, order - 1) for w in own}
            now = {w: own[w] + weight * before[w] for w in own}
            rest = [max(1e-12, 1 - sum(x.values())) for x in (now, before)]
            if sum(now[w] * math.log(now[w] / before[w]) for w in own) + rest[0] * math.log(rest[0] / rest[1]) >= suffix_tree.DIVERGENCE:
                states[context] = weight, own
            longer |= {(*context, w) for w, c in counts.items() if c >= least and w != "END" and (*context[1:], w) in frequent[order - 1]}
        model.append(states)
        frequent.append(longer)
    long = defaultdict(Counter)
    for x, seq in zip(train_texts, corpus):
        own = tokens(x)
        for i in range(suffix_tree.LONG, len(own)):
            long[tuple(seq[orders + i - suffix_tree.LONG : orders + i])][tuple(seq[i : i + orders]), seq[i + orders]] += 1
    factors = {}
    for context, counts in long.items():
        total, kept = sum(counts.values()), {k: c for k, c in counts.items() if c >= suffix_tree.SUPPORT}
        if kept:
            left = 1 - sum(c - discount for c in kept.values()) / total
            before = {k: probability(k[0], k[1], orders) for k in kept}
            now = {k: (c - discount) / total + left * before[k] for k, c in kept.items()}
            if sum(now[k] * math.log(now[k] / before[k]) for k in kept) + left * (1 - sum(before.values())) * math.log(left) >= suffix_tree.DIVERGENCE:
                factors[context] = left, {k[1]: now[k] / before[k] for k in kept}
    out = []
    for x in texts:
        seq, total = sequence(x), 0.0
        own = tokens(x)
        for i, t in enumerate(own):
            total += math.log10(probability(seq[: i + orders], seq[i + orders], orders))
            if with_long and i >= suffix_tree.LONG and (found := factors.get(tuple(seq[orders + i - suffix_tree.LONG : orders + i]))):
                total += math.log10(found[1].get(seq[i + orders], found[0]))
            if seq[i + orders] == "OTHER":
                total += math.log10(share(seen[t]) / base["OTHER"])
        out.append(total)
    return out, sum(len(m) for m in model[2:]), len(factors)


def test_scores_against_a_plain_tree(spark, rows, monkeypatch):
    monkeypatch.setattr(suffix_tree, "KNOWN", 0.002)
    monkeypatch.setattr(suffix_tree, "SYMBOL", 0.01)
    monkeypatch.setattr(suffix_tree, "CONTEXT", 0.004)
    monkeypatch.setattr(suffix_tree, "ENTRY", 0.001)
    monkeypatch.setattr(suffix_tree, "LONG", 6)
    monkeypatch.setattr(suffix_tree, "SPREAD", 1)
    more = rows + [(1000 + i, "alpha beta " * 40 + "gamma") for i in range(2)] + [(950, "alpha beta gamma delta " * 3000)]
    df = spark.createDataFrame(more, "doc_id long, text string")
    learned = df.where("doc_id < 250")
    tree, counts, symbols = train(learned)
    for long in (None, long_states(symbols, tree)):
        got = {}
        for r in score(df, tree, counts, long).collect():
            got.setdefault(r.doc_id, []).append(r.score)
        want, deep, states = brute_scores([x for i, x in more if i < 250], [x for _, x in more], long is not None)
        assert deep > 3 and states > 20
        for (i, _), w in zip(more, want, strict=True):
            assert any(math.isclose(g, w, rel_tol=1e-9, abs_tol=1e-7) for g in got[i]), (i, long)


def test_texts_that_occur_twice_score_higher(spark, monkeypatch):
    """A text among others like it, once or twice: only the second time is it known word for word."""
    monkeypatch.setattr(suffix_tree, "SPREAD", 4)
    rng = random.Random(8)
    texts = [" ".join(f"w{rng.randrange(300)}" for _ in range(120)) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts + texts[:20])), "doc_id long, text string")
    tree, counts, symbols = train(df)
    got = {r.doc_id: r.score for r in score(df, tree, counts, long_states(symbols, tree)).collect()}
    assert min(got[i] for i in range(20)) > max(got[i] for i in range(20, 60)) + 10


@pytest.mark.parametrize("chunk", [None, 50])
def test_long_contexts_are_counted_and_scored_at_every_place(spark, monkeypatch, chunk):
    """Short texts, some of them twice, against dictionaries: no place may be left out. Those scored may be those learned."""
    monkeypatch.setattr(suffix_tree, "CONTEXT", 0.004)
    if chunk:
        monkeypatch.setattr(suffix_tree, "CHUNK", chunk)
        monkeypatch.setattr(suffix_tree, "BUCKETS", 3)
    rng = random.Random(5)
    texts = [" ".join(f"w{rng.randrange(60)}" for _ in range(rng.randrange(8, 30))) for _ in range(80)]
    texts += [*texts[:30], "one " * 50, "one " * 50 + "two", "one two " * 30, *(" ".join(f"rare{i * 20 + k}" for k in range(20)) for i in range(5)), " ".join(texts[:3]), "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    learned = F.col("doc_id") % 7 != 2
    tree, counts, symbols = train(df.where(learned))
    want, _, states = brute_scores([x for i, x in enumerate(texts) if i % 7 != 2], texts)
    plain, _, _ = brute_scores([x for i, x in enumerate(texts) if i % 7 != 2], texts, with_long=False)
    assert states > 100 and sum(abs(a - b) > 1e-3 for a, b in zip(want, plain)) > 40
    for how in ({"long": long_states(symbols, tree)}, {"learned": learned}):
        got = {r.doc_id: r.score for r in score(df, tree, counts, **how).collect()}
        assert len(got) == len(texts)
        for i, w in enumerate(want):
            assert math.isclose(got[i], w, rel_tol=1e-9, abs_tol=1e-7), (i, list(how))


def test_empty_tables(spark, rows):
    df = spark.createDataFrame(rows[:3] + [(None, "a")], "doc_id long, text string").selectExpr("doc_id", "text", "1 score", "2 word")
    tree, counts, none = train(df.limit(0))
    got = score(df, tree, counts).collect()
    assert len(got) == 4 and all(r.n_known == 0 and r.train_tokens == 0 for r in got)
    assert len(score(df, tree, counts, long_states(none, tree)).collect()) == 4
    tree, counts, symbols = train(df)
    assert score(df.limit(0), tree, counts, long_states(symbols, tree)).count() == 0
