import random
from collections import Counter

import numpy as np

from quillspark.llm.language import Filters, ngrams, pieces, predict, train
from quillspark.llm import language

SYLLABLES = {"aa": ["the", "ing", "er", "ou", "sh"], "bb": ["ção", "lha", "que", "os", "mi"], "cc": ["sch", "ung", "ei", "der", "ßt"]}


def text_of(rng, lang, n=40):
    return " ".join("".join(rng.choices(SYLLABLES[lang], k=rng.randrange(1, 4))) for _ in range(n))


def test_accuracy_and_odd_rows(spark):
    rng = random.Random(2)
    rows = [(i, text_of(rng, lang), lang) for i in range(300) for lang in [rng.choice(list(SYLLABLES))]]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    filters = train(df.where("doc_id < 200").unionAll(spark.createDataFrame([(1, None, "aa"), (2, "zz zz", None)], df.schema)))
    out = {r.doc_id: r for r in predict(df.where("doc_id >= 200"), filters, keep=("lang",)).collect()}
    assert all(r.lang_pred == r.lang and 0 <= r.score <= 1 for r in out.values())
    odd = spark.createDataFrame([(None, None, 1), (1, "", 1), (2, "12 34 !", 1), (3, "日本語", 2), (4, "der ungei " * 20, 2), (4, "der ungei " * 20, 2)], "doc_id long, text string, score int")
    got = sorted([(str(r.doc_id), r.lang_pred, r.score == 0) for r in predict(odd, filters).collect()])
    assert got == [("1", "und", True), ("2", "und", True), ("3", max(SYLLABLES, key=lambda x: sum(len(t) for i, t, lang in rows if lang == x and i < 200)), True), ("4", "cc", False), ("4", "cc", False), ("None", "und", True)]
    empty = train(df.limit(0))
    assert predict(df.limit(0), filters).count() == 0
    assert {r.lang_pred for r in predict(df.limit(3), empty).collect()} == {"und"}


def plain_grams(text):
    """3- and 4-grams of words with their edges, by hand."""
    out, words = [], "".join(c.lower() if c.isalpha() else " " for c in text).split()
    for word in words:
        edged = f" {word} "
        out += [edged[i : i + n] for n in (3, 4) for i in range(len(edged) - n + 1)]
    return out


def test_predictions_against_plain_sets(spark):
    """Languages that share words, and texts of two languages: the largest number of n-grams that a language's set holds."""
    rng = random.Random(7)
    SYLLABLES["dd"] = [*SYLLABLES["aa"][:3], "lha", "ung"]
    try:
        rows = [(i, text_of(rng, lang), lang) for i in range(400) for lang in [rng.choice(list(SYLLABLES))]]
        df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
        share = 0.002
        held = {}
        for lang in SYLLABLES:
            counts = Counter(g for _, t, own in rows[:300] if own == lang for g in plain_grams(t))
            held[lang] = {g for g, n in counts.items() if n >= share * sum(counts.values())}
        assert held["aa"] & held["dd"]
        texts = [t for _, t, _ in rows[300:]] + [text_of(rng, a, k) + " " + text_of(rng, b, 60 - k) for a, b, k in [("aa", "dd", 20), ("bb", "cc", 25), ("dd", "bb", 40)] * 10]
        made = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        got = {r.doc_id: r for r in predict(made, train(df.where("doc_id < 300"), share=share)).collect()}
        for i, text in enumerate(texts):
            grams = plain_grams(text)
            found = sorted(((sum(g in held[lang] for g in grams), lang) for lang in held), reverse=True)
            if found[0][0] > found[1][0] + 0.02 * len(grams):  # beyond what false positives may change
                assert got[i].lang_pred == found[0][1]
                assert abs(got[i].score - found[0][0] / (found[0][0] + found[1][0])) < 0.03
                assert abs(got[i].known_share - found[0][0] / len(grams)) < 0.03
    finally:
        del SYLLABLES["dd"]


def test_ngrams_are_those_of_words(monkeypatch):
    text = "Ab cde, f!"
    want = {3: {" ab", "ab ", " cd", "cde", "de ", " f "}, 4: {" ab ", " cde", "cde "}}
    for codes, _, _, starts in pieces([text]):
        got = {n: set() for n in want}
        for n, (h, valid) in zip(want, ngrams(codes, starts)):
            for k in np.flatnonzero(valid):
                got[n].add("".join(chr(c) if c else " " for c in codes[k : k + n]))
        assert got == want


def test_parts_of_a_long_text_count_as_one(monkeypatch):
    text = text_of(random.Random(1), "bb", 500)
    filters = Filters(["x", "y"], [(0, int(g)) for c, _, _, s in pieces([text]) for h, v in ngrams(c, s) for g in set(h[v][::3].view(np.int64))], [2, 1])
    whole = filters.hits([text, "a"])
    monkeypatch.setattr(language, "_PIECE", 97)
    for a, b in zip(whole, filters.hits([text, "a"])):
        assert np.array_equal(a, b)


def test_filters_hold_what_was_put_in():
    rng = np.random.default_rng(1)
    grams = rng.integers(-(2**62), 2**62, 3000)
    filters = Filters([f"l{k}" for k in range(70)], [(k % 70, int(g)) for k, g in enumerate(grams)], [1] * 70)
    h = grams.view(np.uint64)
    bits = [np.bitwise_and.reduce([t[p] for p in filters.places(h)]) for t in filters.table]
    assert all((bits[k % 70 // 64][k] >> np.uint64(k % 70 % 64)) & np.uint64(1) for k in range(3000))
