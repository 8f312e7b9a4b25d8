"""The registry of queries over the driver's tables, with their DuckDB counterparts."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import cache

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..adapter import driver_records, driver_store, driver_table, parsed_records, records_text
from ..functions.text import country_from_affiliation
from ..operators import analytics as A
from ..operators import concepts as C
from ..operators import profiler, refine, retrieval, sqlforms
from ..sources.records import tables_of
from ..store import shared_dir
from ..streaming import events, incremental
from . import oracles, routes

Query = Callable[[SparkSession, str], DataFrame]
#: The concept, its narrower nation, the people, papers and texts that the registered queries ask for.
TOPIC, OTHER_TOPIC, AUTHOR, JOURNAL, PMID = "D000001", "kw:economy", "48", "J38", "558"
IDS = ["1", "5", "77", "558", "999999999"]
TEXT, SENTENCE, SEARCH = "nation_1s", "which people publish about economy or medium and small anvil in standard papers", "whst them retion"


def _store(f) -> Query:
    return lambda spark, sf_dir: f(driver_store(spark, sf_dir))


def _rounded(df: DataFrame, *columns: str, places: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, places) for c in columns})


def _vector(spark: SparkSession, sf_dir: str) -> list[float]:
    return driver_table(spark, sf_dir, "embeddings").where("vec_id = 0").first()["embedding"]


def _bm25(spark: SparkSession, sf_dir: str, k: int, stemmed: bool = False) -> DataFrame:
    store = driver_store(spark, sf_dir)
    if stemmed:
        counts = store["_document_stems"]
        return retrieval.bm25(retrieval.postings_of(counts), SEARCH, k, stemmed=True, sizes=retrieval.lengths_of(counts))
    return retrieval.bm25(store["document_postings"], SEARCH, k, sizes=store["document_lengths"])


def _hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = retrieval.nearest_vectors(driver_store(spark, sf_dir)["vectors"], _vector(spark, sf_dir), 40)
    return _rounded(retrieval.fuse([_bm25(spark, sf_dir, 40), near], 20), "score", places=8)


def _literature(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search over the articles' texts and the vectors, as the tool gives it."""
    store = driver_store(spark, sf_dir)
    found = retrieval.search(store, store["postings"], SEARCH, vectors=store["vectors"], encode=lambda _: _vector(spark, sf_dir), sizes=store["lengths"])
    return _rounded(found["rows"].drop("snippet"), "score", places=8)


def _ingested(table: str, *columns: str) -> Query:
    """A table of the store that the XML records give: files are parsed, the newest versions win, deletions are applied."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = parsed_records(spark, sf_dir)
        return refine.refine(tables_of(rows), spark)[table].select(*columns)

    return run


def _landed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The articles of the same files, by way of the stream that lands new ones."""
    source = driver_records(spark, sf_dir)
    landed, checkpoint = f"{source}-landed", f"{source}-stream"
    incremental.start(spark, source, landed, checkpoint, "*.gz").awaitTermination()
    return incremental.store_of(spark, landed)["articles"].select(*ARTICLE)


def _shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keywords written as header-less CSV shards and read back."""
    path = f"{shared_dir(spark).rstrip('/')}/shards-{uuid.uuid4().hex}"
    store = driver_store(spark, sf_dir)
    store["keywords"].select("pmid", "term", F.when(F.col("is_major"), "1").otherwise("0").alias("is_major")).write.option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    back = {"keywords": refine.read_csv_shards(spark, path, "keywords"), "articles": store["articles"].select("pmid", "date_revised")}
    return refine.refine(back, spark)["keywords"]


def _answered(path: str, **params) -> Query:
    """The rows that a request's answer holds."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        answer = routes.handle(driver_store(spark, sf_dir), path, params)
        return spark.createDataFrame([(k, str(v)) for k, v in sorted(answer.items()) if k not in ("ms", "results")] + [(f"row {i}", ", ".join(f"{k}={v}" for k, v in sorted(r.items()))) for i, r in enumerate(answer.get("results", []))], "name string, value string")

    return run


def _joined(**shown) -> list[Column]:
    """Arrays of structs as text, in their order."""
    return [F.array_join(F.transform(name, f), "; ").alias(name) for name, f in shown.items()]


#: Columns of an ingested article that the files set.
ARTICLE = ("pmid", "nlm_id", "title", "abstract", "pub_year", "pub_month", "language", "status", "date_revised")


@cache
def queries() -> dict[str, Query]:
    return {
        "kol_rank": _store(lambda s: A.rank_authors(s, TOPIC, since_year=1997, recent_since=2000).rows),
        "kol_rank_country": _store(lambda s: A.rank_authors(s, country="nation_1", recent_since=2000).rows),
        "journal_counts": _store(lambda s: A.list_journals(s).rows),
        "journal_counts_topic": _store(lambda s: A.list_journals(s, TOPIC, 1997).rows),
        "journal_totals": _store(lambda s: A.list_journals(s, TOPIC).totals),
        "drug_counts": _store(lambda s: A.list_drugs(s, TOPIC).rows),
        "drug_counts_all": _store(lambda s: A.list_drugs(s, named_only=False, limit=40).rows),
        "country_counts": _store(lambda s: A.list_countries(s).rows),
        "institution_counts": _store(lambda s: A.list_institutions(s, TOPIC).rows),
        "study_type_counts": _store(lambda s: A.list_study_types(s, TOPIC).rows),
        "year_trend": _store(lambda s: A.trend_by_year(s, TOPIC).rows),
        "corpus_profile": _store(lambda s: A.corpus_stats(s)),
        "core_years": _store(lambda s: A.year_quantile(s["articles"], 0.99)),
        "papers_drilldown": _store(lambda s: A.list_papers(s, TOPIC, journal=JOURNAL).rows),
        "papers_of_author": _store(lambda s: A.list_papers(s, TOPIC, author_key=AUTHOR, since_year=1998).rows),
        "papers_by_ids": _store(lambda s: A.articles_by_id(s, IDS)),
        "trial_links": _store(lambda s: A.find_trials(s, TOPIC).rows),
        "top_cited": _store(lambda s: A.top_cited(s).rows),
        "topic_overlap": _store(lambda s: A.compare_concepts(s, TOPIC, OTHER_TOPIC)),
        "article_record": _store(lambda s: A.article_record(s, PMID).select("pmid", "title", "medline_ta", *_joined(authors=lambda a: F.concat_ws("|", a["position"], a["author_key"], a["display_name"], a["orcid"], a["affiliation"]), headings=lambda h: h["descriptor_name"], substances=lambda x: F.concat_ws("|", x["substance_ui"], x["substance_name"], x["registry_number"]), keywords=lambda k: k["term"], types=lambda x: x["type_name"]), "references_total", "references_in_corpus", "cited_by_in_corpus")),
        "taxonomy_descendants": _store(lambda s: C.descendants(s, TOPIC)),
        "scope_pmids": _store(lambda s: C.scope_pmids(s, TOPIC)),
        "scope_summary": _store(lambda s: C.scope_summary(s, TOPIC)),
        "vocabulary": _store(lambda s: s["vocabulary"]),
        "lookup": _store(lambda s: C.lookup(s)),
        "resolve_terms": _store(lambda s: C.resolve(s, TEXT, 10)),
        "spot_terms": _store(lambda s: C.spot(s, SENTENCE, 10)),
        "resolve_merge": _store(lambda s: C.resolve_all(s, TEXT)),
        "dedup_latest": lambda spark, d: refine.latest(driver_table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_quantity", "l_extendedprice").distinct(), ("l_orderkey", "l_linenumber"), "l_suppkey", "l_quantity", "l_extendedprice"),
        "apply_deletes": _store(lambda s: s["articles"].join(s["deleted_pmids"], "pmid", "left_anti").select("pmid", "pub_year")),
        "country_parse": _store(lambda s: s["authorships"].select("pmid", "position", country_from_affiliation(F.col("affiliation")).alias("parsed"))),
        "sql_journals": _store(lambda s: sqlforms.run(s, "journals_of_substance", name="new widget")),
        "sql_drugs": _store(lambda s: sqlforms.run(s, "drugs_of_substance", name="new widget")),
        "sql_kol": _store(lambda s: sqlforms.run(s, "leading_authors", name="new widget", recent=2000)),
        "sql_ambiguity": _store(lambda s: sqlforms.run(s, "ambiguous_authors", more=sqlforms.MORE)),
        "sql_topic": _store(lambda s: sqlforms.run(s, "topic_papers", concept=TOPIC)),
        "doc_text": _store(lambda s: retrieval.document_text(s).select("pmid", "text")),
        "store_listing": _store(lambda s: s.listing()),
        "store_keys": _store(lambda s: refine.build_report(s)),
        "bm25_topk": lambda spark, d: _rounded(_bm25(spark, d, 20), "score"),
        "bm25_stemmed": lambda spark, d: _rounded(_bm25(spark, d, 20, stemmed=True), "score"),
        "literature_search": _literature,
        "xml_articles": _ingested("articles", *ARTICLE),
        "xml_authorships": _ingested("authorships", "pmid", "author_key", "position", "is_first", "is_last", "n_authors"),
        "xml_journals": _ingested("journals", "nlm_id", "medline_ta", "title"),
        "xml_incremental": _landed,
        "xml_profile": lambda spark, d: profiler.profile(records_text(spark, d), "id", "text").where("path like 'MedlineCitation/%'").select("path", "records", "coverage", "repeats", "most"),
        "csv_shards": _shards,
        "route_trend": _answered("/api/trend", concept_id=TOPIC),
        "route_countries": _answered("/api/countries", limit="5"),
        "route_unknown": _answered("/api/nothing"),
        "vector_topk": lambda spark, d: _rounded(retrieval.nearest_vectors(driver_store(spark, d)["vectors"], _vector(spark, d), 20), "score"),
        "hybrid_rrf": _hybrid,
        "html_profile": lambda spark, d: profiler.profile_pages(driver_table(spark, d, "pages"), "page_id", "html"),
        "sample_stride": lambda spark, d: profiler.profile(records_text(spark, d), "id", "text", stride=profiler.STRIDE).agg(F.max("records").alias("records")),
        "event_tumbling": lambda spark, d: events.tumbling(driver_table(spark, d, "events")),
        "event_sessions": lambda spark, d: events.sessions(driver_table(spark, d, "events")).select("user_id", "session", "n_events"),
    }


def oracle_sql() -> dict[str, str]:
    return oracles.all_of(TOPIC, OTHER_TOPIC, AUTHOR, JOURNAL, PMID, IDS, TEXT, SENTENCE, SEARCH)
