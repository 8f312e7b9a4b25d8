import math
import re

import pytest
from pyspark.sql import functions as F

from quillspark.functions.stemmer import stem
from quillspark.functions.text import country_from_affiliation, institution_from_affiliation, keyword_id, orcid, snippet
from quillspark.operators import analytics as A
from quillspark.operators import assistant, profiler, retrieval
from quillspark.operators import concepts as C
from quillspark.schema import SCHEMAS
from quillspark.store import Store


def table(spark, name, rows):
    fields = SCHEMAS[name].names
    return spark.createDataFrame([tuple(dict(zip(fields, r)).get(f) for f in fields) if not isinstance(r, dict) else tuple(r.get(f) for f in fields) for r in rows], SCHEMAS[name])


@pytest.fixture(scope="module")
def store(spark):
    tables = {n: [] for n in SCHEMAS if n not in ("docmeta", "vectors")}
    tables["articles"] = [dict(pmid=str(i), nlm_id="N1" if i < 5 else None, title=f"Article {i}", abstract="x" * 400 if i == 1 else None, pub_year=[2020, 2021, 2021, 2022, 2028, None][i - 1]) for i in range(1, 7)]
    tables["journals"] = [dict(nlm_id="N1", medline_ta="J One", title="Journal One", country="Chile")]
    tables["mesh_tree"] = [("P", "C04", "Parent"), ("K", "C04.1", "Kid"), ("T", "C045", "Trap"), ("D000000001", "C04.1.2", "Grandkid")]
    tables["mesh_headings"] = [("1", "P", "Parent", True, None), ("2", "K", "Kid", True, None), ("3", "T", "Trap", True, None), ("4", "D000000001", "Grandkid", True, None)]
    tables["substances"] = [("1", "C1", "Water", "0"), ("2", "C2", "Iron", "7439"), ("2", "C1", "Water", "0"), ("4", "C2", "Iron", "7439")]
    tables["keywords"] = [("5", " Gene X"), ("6", "gene x "), ("5", "ab"), ("6", "ab")]
    tables["authors"] = [dict(author_key="a", display_name="Ann", is_group=False), dict(author_key="g", display_name="Group", is_group=True), dict(author_key="b", display_name="Bob", orcid="0", is_group=False)]
    tables["authorships"] = [
        dict(pmid="1", author_key="a", position=1, is_first=True, is_last=False, affiliation="Y Hospital, Oslo", country="Norway"),
        dict(pmid="2", author_key="a", position=2, is_first=False, is_last=True, affiliation="Dept, Z Universit%, Lima", country="Peru"),
        dict(pmid="2", author_key="g", position=1, is_first=True, is_last=False, country="Peru"),
        dict(pmid="4", author_key="a", position=3, is_first=False, is_last=True, country="Peru"),
        dict(pmid="4", author_key="b", position=1, is_first=True, is_last=False, country="Iran (x)"),
    ]
    tables["citations"] = [("1", "2"), ("3", "2"), ("2", "1"), ("4", "99")]
    tables["publication_types"] = [("1", "D1", "Review"), ("2", "D1", "Review"), ("2", "D2", "Trial")]
    tables["databank_links"] = [("2", "CT", "N2"), ("6", "CT", "N6")]
    tables["synonyms"] = [("ovarian cancers", "K", "Kid"), ("absent", "ZZ", "Zed")]
    tables["vocabulary"] = []
    s = Store.of(spark, {n: table(spark, n, rows) for n, rows in tables.items()})
    return s.with_tables(vocabulary=C.build_vocabulary(s))


def ids(df):
    return sorted(r[0] for r in df.collect())


def test_taxonomy_and_scopes(store):
    assert ids(C.descendants(store, "P")) == ["D000000001", "K", "P"]
    assert ids(C.descendants(store, "none")) == ["none"]
    assert ids(C.scope_pmids(store, "P")) == ["1", "2", "4"] and ids(C.scope_pmids(store, "P", False)) == ["1"]
    assert ids(C.scope_pmids(store, "kw:gene x")) == ["5", "6"] and ids(C.scope_pmids(store, "C2")) == ["2", "4"]
    assert tuple(C.scope_summary(store, "P").first()) == (True, 3)
    assert ids(C.scoped_articles(store, None, 2021).select("pmid")) == ["2", "3", "4", "5"]
    assert C.scoped_articles(store, "nothing").count() == 0


def test_counts(store):
    out = A.list_journals(store, "P").collect()
    assert (out["total_journals"], out["total_papers"], out["expanded"]) == (1, 3, True)
    assert out["results"] == [{"medline_ta": "J One", "country": "Chile", "n_papers": 3, "title": "Journal One"}]
    assert {r.medline_ta: r.n_papers for r in A.list_journals(store).rows.collect()} == {"J One": 4, None: 2}
    assert [(r.substance_name, r.n_papers) for r in A.list_drugs(store).rows.collect()] == [("Iron", 2)]
    assert [r.substance_name for r in A.list_drugs(store, "C2", named_only=False).rows.collect()] == ["Water"]
    assert [(r.country, r.n_papers) for r in A.list_countries(store).rows.collect()] == [("Peru", 2), ("Iran (x)", 1), ("Norway", 1)]
    assert sorted(r.institution for r in A.list_institutions(store).rows.collect()) == ["Y Hospital", "Z Universit%"]
    assert [(r.pub_year, r.n_papers) for r in A.trend_by_year(store).rows.collect()] == [(2020, 1), (2021, 2), (2022, 1), (2028, 1)]
    assert [(r.pmid, r.cited_by) for r in A.top_cited(store).rows.collect()] == [("2", 2), ("1", 1)]
    assert [(r.type_name, r.n_papers) for r in A.list_study_types(store, "P").rows.collect()] == [("Review", 2), ("Trial", 1)]
    assert [r.accession for r in A.find_trials(store).rows.collect()] == ["N6", "N2"]
    papers = A.list_papers(store).rows.collect()
    assert [r.pmid for r in papers] == ["6", "5", "4", "2", "3", "1"] and papers[-1].snippet == "x" * 300 + "…"
    assert [r.pmid for r in A.list_papers(store, journal="J One", substance_ui="C2", author_key="b").rows.collect()] == ["4"]
    assert A.list_papers(store, limit=0).rows.count() == 0
    assert ids(A.articles_by_id(store, ["1", "no"])) == ["1"]


def test_people(store):
    out = A.rank_authors(store, recent_since=2022).collect()
    assert [(r["author_key"], r["score"]) for r in out["results"]] == [("a", 3 + 1.5 + 4 + 1), ("b", 1 + 1.5 + 1)]
    assert out["results"][0]["main_country"] == "Peru" and out["total_authors"] == 2 and out["caveat"]
    assert [r.author_key for r in A.rank_authors(store, country="IRAN (", recent_since=2022).rows.collect()] == ["b"]


def test_recency_isn_t_moved_by_mistyped_years(spark):
    years = spark.createDataFrame([(2020,)] * 300 + [(2028,)] * 2 + [(None,)], "pub_year int")
    assert A.year_quantile(years, 0.99).first().year == 2020
    assert A.year_quantile(years.limit(0), 0.99).first().year is None


def test_records_and_stats(store):
    one = A.article_record(store, "2").first()
    assert one.title == "Article 2" and len(one.authors) == 2 and (one.references_total, one.references_in_corpus, one.cited_by_in_corpus) == (1, 1, 2)
    assert A.article_record(store, "4").first().references_in_corpus == 0 and A.article_record(store, "none").first() is None
    stats = A.corpus_stats(store).first()
    assert (stats.articles, stats.with_abstract, stats.first_year, stats.last_year) == (6, 1, 2020, 2028)
    both = A.compare_concepts(store, "P", "C2").first()
    assert tuple(both) == (3, 2, 2, 66.7, 100.0)


def names(spark, rows):
    return Store.of(spark, {"vocabulary": table(spark, "vocabulary", [dict(concept_id=i, concept_name=n, name_lc=n, kind=k, n_papers=c) for i, n, k, c in rows if k != "syn"]), "synonyms": table(spark, "synonyms", [(n, i, n) for i, n, k, c in rows if k == "syn"]), "mesh_tree": table(spark, "mesh_tree", [])})


def test_resolution(spark):
    s = names(spark, [("kw:ovarian cancer", "ovarian cancer", "keyword", 316), ("D010051", "ovarian neoplasms", "mesh", 452), ("D010051", "ovarian cancer", "syn", 0), ("kw:heart attack", "heart attack", "keyword", 5), ("D009203", "myocardial infarction", "mesh", 614), ("D009203", "heart attacks", "syn", 0), ("D010300", "parkinson disease", "mesh", 666), ("kw:parkinsons", "parkinsons", "keyword", 3), ("D000544", "alzheimer disease", "mesh", 1351), ("kw:alzheimer", "alzheimer", "keyword", 31)])
    found = lambda t: [r.concept_id for r in C.resolve(s, t).collect()]
    assert found("Ovarian cancer") == ["D010051", "kw:ovarian cancer"]
    assert found("heart attack") == ["D009203", "kw:heart attack"]
    assert found("parkinsons")[0] == "D010300" and found("parkinson’s")[0] == "D010300"
    assert found("a%b") == [] and found("  ") == []
    assert [r.concept_id for r in C.spot(s, "Top people for alzheimer in ovarian cancer").collect()] == ["D010051", "kw:alzheimer"]
    assert [r.concept_id for r in C.resolve_all(s, "alzheimer").collect()][0] == "D000544"
    assert C.interpret(s, "D010051").concept_id == "D010051" and C.interpret(s, "D99999").error and C.interpret(s, None) == C.Scope()
    assert "Interpreted" in C.interpret(s, "heart attack").note and C.interpret(s, "no such thing").error


def test_column_functions(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(country_from_affiliation(F.lit("Dept, Univ, 12345 Chile. Electronic address: a@b.c"))) == "Chile"
    assert one(country_from_affiliation(F.lit("X, Peru "))) == "Peru" and one(country_from_affiliation(F.lit(""))) == ""
    assert one(institution_from_affiliation(F.lit("Dept X, Univ Y"))) is None and one(institution_from_affiliation(F.lit("Dept, Y Hospital, Oslo"))) == "Y Hospital"
    assert one(orcid(F.lit("0000-0001"))) is None and one(keyword_id(F.lit("\t Ab C"))) == "kw:ab c" and one(snippet(F.lit("é" * 300))) == "é" * 300


def test_search(spark, store):
    docs = spark.createDataFrame([("1", "the cat sat on the mat"), ("2", "cats and a dog running"), ("3", "no match")], "pmid string, text string")
    index = retrieval.postings(docs)
    assert [r.doc for r in retrieval.bm25(index, "the cat")  .collect()] == ["1"]
    assert [r.doc for r in retrieval.bm25(retrieval.postings(docs, stemmed=True), "cat runs", stemmed=True).collect()] == ["2", "1"]
    pool = lambda rows: spark.createDataFrame(rows, "doc string, score double")
    fused = {r.doc: r.score for r in retrieval.fuse([pool([("p1", 9.0), ("p2", 1.0)]), pool([("p2", 0.2), ("p3", 0.1)])]).collect()}
    assert fused == pytest.approx({"p2": 1 / 62 + 1 / 61, "p1": 1 / 61, "p3": 1 / 62})
    encode = retrieval.hashed_encoder(16)
    vectors = spark.createDataFrame([(r.pmid, encode(r.text)) for r in docs.collect()], "pmid string, vector array<float>")
    out = retrieval.search(store, index, "cat mat", 2, vectors=vectors, encode=encode)
    assert out["retrievers"] == ["bm25", "vector"] and out["rows"].first().pmid == "1"
    assert [r.pmid for r in retrieval.search(store, index, "cat dog", 2, since_year=2021)["rows"].collect()] == ["2"]


def test_vectors_are_made_once_for_each_text(spark, tmp_path):
    docs = spark.createDataFrame([("1", "a cat"), ("2", "a dog")], "pmid string, text string")
    one = retrieval.hashed_encoder(4)
    encode = lambda texts: [one(t) for t in texts]
    done = retrieval.build_vectors(docs, None, encode, str(tmp_path / "v"))
    assert done.count() == 2
    again = docs.withColumn("text", F.when(F.col("pmid") == "2", "another dog").otherwise(F.col("text")))
    assert retrieval.build_vectors(again, done, encode, str(tmp_path / "v")).count() == 3


@pytest.mark.parametrize("word, root", [("running", "run"), ("caresses", "caress"), ("ponies", "poni"), ("ties", "tie"), ("hopping", "hop"), ("hoping", "hope"), ("relational", "relat"), ("generously", "generous"), ("national", "nation"), ("electrical", "electr"), ("adjustment", "adjust"), ("skies", "sky"), ("happy", "happi"), ("say", "say"), ("consolingly", "consol"), ("knightly", "knight"), ("kneading", "knead")])
def test_stems(word, root):
    assert stem(word) == root


def test_profiles(spark):
    xml = '<a xmlns:x="u"><Title>T{0}</Title><Author><LastName>L</LastName></Author><Author><LastName>M</LastName></Author><e k="v" id="1" UI="2"/></a>'
    rows = spark.createDataFrame([(i, xml.format(i)) for i in range(26)], "id int, text string")
    paths = [r.asDict() for r in profiler.profile(rows, "id", "text", stride=13).collect()]
    by = {p["path"]: p for p in paths}
    assert by["Title"]["records"] == 2 and by["Title"]["coverage"] == 100.0 and by["Author"]["repeats"] == 100.0 and {"e@k", "e@id"} <= set(by) and "e@UI" not in by and by["Author"]["most"] == 2 and by["Author/LastName"]["samples"] == ["L"] and by["Title"]["samples"] == ["T0", "T13"]
    mapping = profiler.propose(paths)
    assert mapping["document.title"]["path"] == "Title" and mapping["person.name"]["repeating"] and mapping["document.id"]["path"] == "e@id"
    assert profiler.fingerprint(paths) == profiler.fingerprint(paths[::-1]) and len(profiler.fingerprint(paths)) == 16
    about = profiler.detect('<?xml version="1.0"?><!DOCTYPE set PUBLIC "-//X" "y"><set xmlns="http://n"><r/></set>')
    assert about == {"doctype": "set", "public_id": "-//X", "root": "set", "namespace": "http://n"}
    assert profiler.record_tag(b"<s><h/><r><x/></r><r/></s>") == "r"
    text = profiler.to_yaml(about, mapping, paths)
    assert 'path: "Title"' in text and '- "e@k"' in text
    assert profiler.profile(rows, "id", "text", max_records=5).where("path = 'Title'").first().records == 5
    pages = spark.createDataFrame([(1, "<html><body><p>a<br>b<p>c</body>"), (2, None)], "id int, html string")
    assert {r.path for r in profiler.profile_pages(pages, "id", "html").collect()} >= {"html/body/p", "html/body/p/br"}


def test_assistant(store):
    assert assistant.unseen_numbers("12 papers", ["312"]) == ["12"] and assistant.unseen_numbers("12 papers", ["312"], strict=False) == []
    assert assistant.unseen_numbers("1,234 in 5", ['{"n": 1234}']) == ["5"]
    assert "available" in assistant.call(store, "nope", {}) and "takes no" in assistant.call(store, "list_journals", {"x": 1})["error"]
    assert assistant.call(store, "list_journals", {"concept_id": "D123456"})["error"]
    script = iter([{"tool": "list_countries", "args": {"concept_id": "D000000001"}}, {"answer": "77 papers"}, {"answer": "Peru has 1 paper."}])
    out = assistant.ask(store, "where?", lambda m, t: next(script))
    assert not out.refused and out.text.startswith("Peru has 1 paper.") and "Scope: Grandkid" in out.text and "Countries are read" in out.text
    assert assistant.ask(store, "?", lambda m, t: {"answer": "42"}).refused
    assert assistant.ask(store, "?", lambda m, t: {"tool": "corpus_stats"}).steps == 6
    assistant.register("mine", lambda s, **a: {"results": [1]})
    assert assistant.call(store, "mine", {})["results"] == [1]
    assert set(assistant.dry_run(store, "Which iron?")) == {"note", "list_journals", "rank_authors", "trend_by_year"}


def test_store(spark, store, tmp_path):
    store.write(str(tmp_path), ["journals", "articles"])
    back = Store.read(spark, str(tmp_path))
    assert back["articles"].count() == 6 and back["articles"].schema == SCHEMAS["articles"]
    assert {r.table: r.n_rows for r in store.listing().collect()}["citations"] == 4
    store.export_csv("journals", str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).first().medline_ta == "J One"


def test_plans(store):
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert "LeftSemi" in plan(A.list_countries(store, "P").rows)
    assert "TakeOrderedAndProject" in A.list_countries(store).rows._jdf.queryExecution().executedPlan().toString()


def test_a_store_is_built_once(spark, tmp_path):
    made = []

    def make():
        made.append(1)
        return spark.createDataFrame([("2", "b"), ("1", "a")], "pmid string, term string")

    for _ in range(2):
        store = Store(spark, {"keywords": make}).kept(str(tmp_path), {"keywords": "term"})
        assert sorted(map(tuple, store["keywords"].collect())) == [("1", "a"), ("2", "b")]
    assert made == [1]
    assert Store(spark, {"keywords": make}).kept("elsewhere")["keywords"].count() == 2 and made == [1, 1]
    store.write(str(tmp_path / "s"))
    assert [(r.table, r.n_files > 0, r.mb >= 0) for r in store.sizes(str(tmp_path / "s")).collect()] == [("keywords", True, True)]
    assert "term" in store.show("keywords") and "-RECORD 0" in store.show("keywords", wide=True)


def test_recent_since_zero_and_affiliations(spark):
    tables = {
        "articles": spark.createDataFrame([("1", 2001), ("2", 2003)], "pmid string, pub_year int"),
        "authors": spark.createDataFrame([("a", "A", None, False)], "author_key string, display_name string, orcid string, is_group boolean"),
        "authorships": spark.createDataFrame([("1", "a", True, False, "Lab", "X"), ("2", "a", False, True, None, "X")], "pmid string, author_key string, is_first boolean, is_last boolean, affiliation string, country string"),
    }
    row = A.rank_authors(Store.of(spark, tables), recent_since=0).rows.first()
    assert (row.n_recent, row.affiliation, row.score) == (2, "Lab", 2 + 1.5 + 2 + 2)
    assert "caveat" in A.rank_authors(Store.of(spark, tables)).collect()
    tables["authors"] = tables["authors"].withColumn("orcid", F.lit("0000-0000-0000-0001"))
    assert "caveat" not in A.rank_authors(Store.of(spark, tables)).collect()


def test_search_is_a_tool(spark):
    store = Store.of(spark, {
        "articles": spark.createDataFrame([(str(i), f"T{i}", 2000 + i, "J", None, t) for i, t in enumerate(["heart attack", "heart", "lung"])], "pmid string, title string, pub_year int, nlm_id string, doi string, abstract string"),
        "journals": spark.createDataFrame([("J", "J One")], "nlm_id string, medline_ta string"),
    })
    index = retrieval.postings(store["articles"].withColumnRenamed("abstract", "text"), stemmed=True)
    assistant.register_search(index, stemmed=True)
    try:
        out = assistant.call(store, "search_literature", {"query": "hearts", "k": 5})
        assert {r["pmid"] for r in out["results"]} == {"0", "1"} and out["retrievers"] == ["bm25"] and not out["exact"]
        assert [r["pmid"] for r in assistant.call(store, "search_literature", {"query": "heart", "since_year": 2001})["results"]] == ["1"]
        assert "search_literature" in {t["name"] for t in assistant.tool_schemas()}
    finally:
        del assistant.REGISTRY["search_literature"]


def test_stemmed_search_against_plain_sums(spark):
    """BM25 over stems by dictionaries."""
    texts = {"a": "Hearts and heart failure, failing hearts", "b": "the heart", "c": "failures of national relations", "d": "Élan vital du cœur", "e": ""}
    docs = spark.createDataFrame([*texts.items(), ("f", None)], "pmid string, text string")
    stems = {d: [stem(w) for w in re.findall(r"\b\w\w+\b", t.lower()) if w not in retrieval.STOP_WORDS] for d, t in texts.items()}
    stems = {d: own for d, own in stems.items() if own}
    mean = sum(map(len, stems.values())) / len(stems)
    terms, want = {stem(w) for w in ("heart", "failing", "nations")}, {}
    for d, own in stems.items():
        for t in terms & set(own):
            df = sum(t in x for x in stems.values())
            part = own.count(t) / (own.count(t) + retrieval.K1 * (1 - retrieval.B + retrieval.B * len(own) / mean))
            want[d] = want.get(d, 0) + math.log(1 + (len(stems) - df + 0.5) / (df + 0.5)) * part
    index = retrieval.postings(docs, stemmed=True)
    for sizes in (None, retrieval.lengths(index)):
        got = [(r.doc, round(r.score, 9)) for r in retrieval.bm25(index, "Heart failing nations the", 10, stemmed=True, sizes=sizes).collect()]
        assert got == [(d, round(s, 9)) for d, s in sorted(want.items(), key=lambda x: (-x[1], x[0]))] and len(got) == 3


def test_page_profiles_by_hand(spark):
    pages = [(1, "<html><body><p>one</p><p>two!</p><a href='x'>l</a></body></html>"), (2, "<html><body><p></p><div><p class='k'>three</p></div>"), (3, None)]
    rows = profiler.profile_pages(spark.createDataFrame(pages, "id int, html string"), "id", "html").collect()
    got = {r.path: (r.records, r.coverage, r.repeats, r.most, r.mean_length, r.samples) for r in rows}
    assert got["html/body/p"] == (2, 66.7, 50.0, 2, 3.5, ["one"])
    assert got["html/body/a@href"] == (1, 33.3, 0.0, 1, 1.0, ["x"]) and got["html/body/div/p"][5] == ["three"]
    assert set(got) == {"html", "html/body", "html/body/p", "html/body/a", "html/body/a@href", "html/body/div", "html/body/div/p"}


def test_texts_are_counted_within_their_rows(spark):
    """Against plain counts, for words and stems; counting sends nothing."""
    texts = {"a": "Cats and cats, a cat; the running runner runs É été Été", "b": "", "c": None, "d": "of the", "e": "x y zz " * 50}
    docs = spark.createDataFrame([*texts.items()], "pmid string, text string")
    for stemmed in (False, True):
        counts = retrieval.term_counts(docs, stemmed=stemmed)
        assert "Exchange" not in counts._jdf.queryExecution().executedPlan().toString()
        want = {}
        for d, t in texts.items():
            for w in re.findall(r"\b\w\w+\b", (t or "").lower()):
                if w not in retrieval.STOP_WORDS:
                    key = d, stem(w) if stemmed else w
                    want[key] = want.get(key, 0) + 1
        for rows in (retrieval.postings_of(counts), retrieval.postings(docs, stemmed=stemmed)):
            assert sorted(map(tuple, rows.collect())) == sorted((d, t, n) for (d, t), n in want.items())
        assert sorted(map(tuple, retrieval.lengths_of(counts).collect())) == [("a", 10 - 2), ("e", 50)]
    again = docs.unionAll(docs)
    assert {r.tf for r in retrieval.postings(again).where("doc = 'e'").collect()} == {100}


def test_a_lazy_store_writes_only_what_is_made_of_other_tables(spark, tmp_path):
    made = []
    views = Store(spark, {"keywords": lambda: made.append(1) or spark.createDataFrame([("2", "b"), ("1", "a")], "pmid string, term string")})
    lazy = views.kept(str(tmp_path), lazy=True)
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "FileScan" not in plan(lazy["keywords"]) and lazy["keywords"].count() == 2
    more = lazy.adding({"_step": lambda: lazy["keywords"].select("term"), "n_terms": lambda: lazy["keywords"].groupBy("term").count()})
    kept = more.kept(str(tmp_path), names=["_step", "n_terms"])
    assert kept.names() == ["keywords", "n_terms"]
    assert {r.table: r.n_rows for r in kept.listing().collect()} == {"keywords": 2, "n_terms": 2}
    assert "FileScan" not in plan(kept.definition("n_terms")) and "FileScan" in plan(kept["n_terms"]) and "FileScan" in plan(kept.definition("n_terms"))
    views.kept(str(tmp_path))["keywords"]  # once it is written, it is read
    assert "FileScan" in plan(views.kept(str(tmp_path), lazy=True)["keywords"])


def test_an_id_is_looked_up_without_a_vocabulary(spark, store, tmp_path):
    made = []
    kept = store.adding({"vocabulary": lambda: made.append(1) or C.build_vocabulary(store)}).kept(str(tmp_path), names=["vocabulary"])
    assert C.interpret(kept, "D000000001").note == "Scope: Grandkid (D000000001)." and C.interpret(kept, "D99999").error
    assert made and "vocabulary" not in kept._made  # defined, not written
