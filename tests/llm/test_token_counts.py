from quillspark.llm.bpe import load
from quillspark.llm.token_counts import longest_fit, token_counts, tokens_at

ROWS = [(1, "hello world", "x"), (2, None, "x"), (3, "", "y"), (3, "", "y"), (None, "it's\n\n  we'll", "z"), (5, "é ß <|endoftext|> " * 30, "z"), (6, "word" * 5000, "q")]


def test_rows(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, n_tokens string")
    tok = load()
    brute = lambda t: len(tok.encode(t or "", add_special_tokens=False).ids)
    rows = token_counts(df, limit=10).collect()
    want = sorted((str(i), len((t or "").encode()), brute(t), brute(t) > 10) for i, t, _ in ROWS)
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in rows) == want


def test_prefixes_answer_budgets(spark):
    df = spark.createDataFrame(ROWS[:5], "doc_id long, text string, x string")
    out = token_counts(df, prefixes=True)
    tok = load()
    for r in out.select("*", tokens_at("prefix_counts", 4).alias("at4"), longest_fit("prefix_counts", 2).alias("fit2")).collect():
        text = next(t for i, t, _ in ROWS if i == r.doc_id) or ""
        brute = [len(tok.encode(text[:i], add_special_tokens=False).ids) for i in range(len(text) + 1)]
        assert r.prefix_counts == brute
        assert r.at4 == brute[min(4, len(text))]
        assert r.fit2 == max(i for i, c in enumerate(brute) if c <= 2)


def test_empty(spark):
    assert token_counts(spark.createDataFrame([], "doc_id long, text string")).count() == 0
