import random
import re

from quillspark.llm.bpe import load
from quillspark.llm.personal import base_spans

from .test_jaccard_join import brute

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    rng, rows = random.Random(9), []
    syllables = {"en": ["the", "ing", "er", "sh", "ou"], "fr": ["ée", "eau", "que", "oi", "les"]}
    for i in range(240):
        lang = rng.choice(["en", "fr"])
        words = ["".join(rng.choices(syllables[lang], k=rng.randrange(1, 4))) for _ in range(rng.randrange(30, 120))]
        if i % 5 == 0 and rows:
            words = rng.choice(rows)[1].split(" ")
            if i % 10 == 0:
                for _ in range(rng.randrange(1, 4)):
                    words[rng.randrange(len(words))] = "new"
        if i % 7 == 0:
            words.insert(rng.randrange(len(words)), f"user{i}@mail.example.com")
        rows.append((i, " ".join(words), lang if i % 11 else None, "s", 0))
    return rows + [(500, None, "en", "s", 0), (501, "123 !!", "en", "s", 0), (502, "日本語" * 30, None, None, None), (3, rows[3][1], rows[3][2], "s", 0)]


def test_stages_against_brute_force(spark, tmp_path):
    import corpus_pipeline

    rows = corpus()
    docs = spark.createDataFrame(rows, SCHEMA)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    made = []
    for _, f in corpus_pipeline.STAGES:
        docs = f(spark, docs, str(tmp_path)).cache()
        made.append(docs.collect())
    kept = [tuple(r) for r in made[0]]
    assert sorted(r[0] for r in kept) == sorted(r[0] for r in rows if r[0] < 500)
    assert all(r[2] in ("en", "fr") for r in kept)
    ids = {}
    for i, text, *_ in kept:
        ids[i] = text
    want = {c for _, _, c in brute(list(ids.items()), 80, 5)}
    assert sorted(r.doc_id for r in made[1]) == sorted(want) and len(want) < len(ids)
    for r in made[2]:
        text = ids[r.doc_id]
        for kind, a, b in sorted(base_spans(text), key=lambda s: -s[1]):
            text = text[:a] + f"[{kind.upper()}]" + text[b:]
        assert r.text == text and r.n_chars == len(text) and not re.search("@mail", r.text)
    tokens = {r.doc_id: len(load().encode(r.text, add_special_tokens=False).ids) + 1 for r in made[2]}
    total = {}
    for r in made[3]:
        total[r.doc_id] = total.get(r.doc_id, 0) + r.length
    assert total == tokens
    assert sorted(map(str, corpus_pipeline.run(spark, str(tmp_path)).drop("sequence_id", "offset").collect())) == sorted(str(r) for r in docs.drop("sequence_id", "offset").collect())


def test_extra_columns_with_clashing_names(spark, tmp_path):
    """Every stage but the last hands on the columns that it was given, whatever their names and types."""
    import corpus_pipeline

    more = ["id", "lang_pred", "score", "spans", "kind", "row", "component_id", "n_shingles", "piece", "length", "in_0", "keep_0"]
    docs = spark.createDataFrame(corpus()[:60] + corpus()[-4:], SCHEMA)
    docs = docs.selectExpr("*", *(f"concat('{c}', doc_id) AS {c}" for c in more), "map('a', doc_id) AS m", "array(lang) AS links")
    columns, kept = docs.columns, {r.doc_id: r for r in docs.collect()}
    for name, f in corpus_pipeline.STAGES[:-1]:
        docs = f(spark, docs, str(tmp_path)).cache()
        assert docs.columns == columns, name
        for r in docs.collect():
            assert all(r[c] == f"{c}{r.doc_id}" for c in more) and r.m == {"a": r.doc_id}, name
    assert 0 < docs.count() < len(kept)
    assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() >= docs.count()


def test_empty(spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
