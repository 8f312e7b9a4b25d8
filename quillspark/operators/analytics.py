"""Counting operators over a store. Each gives a Result: the rows, totals of the unlimited answer, and remarks."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import institution_from_affiliation, snippet
from ..store import Store
from .concepts import scope_summary, scoped_articles

#: The year taken where no article has one, and the weights of first, last and recent papers.
UNKNOWN_YEAR = 2026
W_FIRST, W_LAST, W_RECENT = 1.5, 2.0, 1.0
CAVEATS = {
    "authors": "People are told apart by ORCID where one is given, else by surname and first initial, so that namesakes may be counted as one.",
    "countries": "Countries are read from the end of affiliations and are not checked.",
    "institutions": "Institutions are the first part of an affiliation that names one; spellings are not merged.",
    "citations": "Citations are those within this corpus, of the records that list references.",
    "trials": "Few records carry links to registries; a paper without one may still report a trial.",
}


@dataclass
class Result:
    """Rows are lazy; ``collect`` runs them with the totals."""

    rows: DataFrame
    totals: DataFrame | None = None
    scope: DataFrame | None = None
    caveat: str | None = None
    #: A column of the rows; the caveat is given only if one of them lacks it.
    lacking: str | None = None
    note: str | None = None
    extra: dict = field(default_factory=dict)

    def collect(self) -> dict:
        out = dict(self.extra)
        for frame in (self.totals, self.scope):
            if frame is not None:
                out |= frame.first().asDict()
        rows = [r.asDict(recursive=True) for r in self.rows.collect()]
        caveat = self.caveat if self.lacking is None or any(not r[self.lacking] for r in rows) else None
        out |= {k: v for k, v in (("note", self.note), ("caveat", caveat)) if v}
        return out | {"results": rows}


def _scope(store: Store, concept_id: str | None, expand: bool) -> DataFrame | None:
    return scope_summary(store, concept_id, expand) if concept_id else None


def _journals(store: Store) -> DataFrame:
    """Journals under names that no other table has."""
    return store["journals"].select("nlm_id", "medline_ta", F.col("title").alias("journal_title"), F.col("country").alias("journal_country"))


def _of(scope: DataFrame, table: DataFrame, key: str = "pmid") -> DataFrame:
    return table.join(scope.select(F.col("pmid").alias(key)), key, "left_semi")


def list_journals(store: Store, concept_id=None, since_year=None, limit: int = 25, expand: bool = True) -> Result:
    """Papers by journal; articles without one are a group of their own. pmid is unique in articles and the join is
    on the journals' key, so papers are counted plainly."""
    scope = scoped_articles(store, concept_id, since_year, expand)
    grouped = scope.select("nlm_id").join(_journals(store), "nlm_id", "left").groupBy("medline_ta", F.col("journal_country").alias("country"))
    counts = grouped.agg(F.count("*").alias("n_papers"), F.min("journal_title").alias("title"))
    totals = counts.agg(F.count("*").alias("total_journals"), F.coalesce(F.sum("n_papers"), F.lit(0)).alias("total_papers"))
    return Result(counts.orderBy(F.desc("n_papers"), F.asc_nulls_first("medline_ta"), F.asc_nulls_first("country")).limit(limit), totals, _scope(store, concept_id, expand))


def list_drugs(store: Store, concept_id=None, since_year=None, limit: int = 25, named_only: bool = True, expand: bool = True) -> Result:
    """Papers by substance other than the concept itself; named_only leaves out those without a registry number."""
    rows = store["substances"]
    if named_only:
        rows = rows.where("registry_number is not null and registry_number != '0'")
    if concept_id:
        rows = rows.where(F.col("substance_ui") != concept_id)
    rows = _of(scoped_articles(store, concept_id, since_year, expand), rows)
    counts = rows.groupBy("substance_name", "registry_number", "substance_ui").agg(F.countDistinct("pmid").alias("n_papers"))
    totals = counts.agg(F.count("*").alias("total_drugs"))
    return Result(counts.orderBy(F.desc("n_papers"), "substance_ui", "substance_name").limit(limit), totals, _scope(store, concept_id, expand))


def year_quantile(years: DataFrame, q: float) -> DataFrame:
    """The nearest-rank quantile of pub_year: from a histogram with a row a year, so one small window."""
    histogram = years.where("pub_year is not null").groupBy("pub_year").agg(F.count("*").alias("n"))
    running = histogram.select("pub_year", F.sum("n").over(Window.orderBy("pub_year")).alias("upto"), F.sum("n").over(Window.partitionBy()).alias("all"))
    return running.where(F.col("upto") > F.floor((F.col("all") - 1) * q + 0.5)).agg(F.min("pub_year").alias("year"))


def recent_cutoff(store: Store, recent_since: int | None = None) -> int:
    """The first recent year: the one before the 99th percentile, which a few mistyped years don't move."""
    if recent_since is not None:
        return recent_since
    year = year_quantile(store["articles"], 0.99).first()["year"]
    return (UNKNOWN_YEAR if year is None else year) - 1


def rank_authors(store: Store, concept_id=None, country=None, since_year=None, limit: int = 20, w_first: float = W_FIRST, w_last: float = W_LAST, w_recent: float = W_RECENT, expand: bool = True, recent_since: int | None = None) -> Result:
    """Leading people of a scope by papers, with more for first, last and recent ones; groups are left out. The
    affiliation is the newest that is given.

    country is taken literally, as a part of the country's name, whatever the case. pmid and position are the key of
    authorships, but a person may have two positions on a paper, so papers are counted distinct."""
    scope = scoped_articles(store, concept_id, since_year, expand).select("pmid", "pub_year")
    people = store["authors"].where(~F.col("is_group")).select("author_key", "display_name", "orcid")
    rows = store["authorships"]
    if country:
        rows = rows.where(F.contains(F.lower("country"), F.lit(country.strip().lower())))
    rows = rows.select("pmid", "author_key", "is_first", "is_last", "affiliation", "country").join(scope, "pmid").join(people, "author_key")
    since = recent_cutoff(store, recent_since)
    counts = rows.groupBy("author_key").agg(
        F.max("display_name").alias("display_name"),
        F.max("orcid").alias("orcid"),
        F.countDistinct("pmid").alias("n_papers"),
        F.count_if("is_first").alias("n_first"),
        F.count_if("is_last").alias("n_last"),
        F.max("pub_year").alias("latest_year"),
        F.mode("country", True).alias("main_country"),
        F.max_by("affiliation", F.when(F.col("affiliation").isNotNull(), F.struct("pub_year", "pmid", "affiliation"))).alias("affiliation"),
        F.count_if(F.col("pub_year") >= since).alias("n_recent"),
    )
    score = F.col("n_papers") + w_first * F.col("n_first") + w_last * F.col("n_last") + w_recent * F.col("n_recent")
    ranked = counts.withColumn("score", score)
    totals = ranked.agg(F.count("*").alias("total_authors"))
    top = ranked.orderBy(F.desc("score"), F.desc("n_papers"), "author_key").limit(limit)
    return Result(top, totals, _scope(store, concept_id, expand), CAVEATS["authors"], "orcid", extra={"recent_since": since})


def list_papers(store: Store, concept_id=None, journal=None, substance_ui=None, author_key=None, since_year=None, limit: int = 50, expand: bool = True) -> Result:
    """The papers behind a count: newest first, unknown years before them."""
    rows = scoped_articles(store, concept_id, since_year, expand).join(_journals(store), "nlm_id", "left")
    if journal:
        rows = rows.where(F.col("medline_ta") == journal)
    if substance_ui:
        rows = _of(store["substances"].where(F.col("substance_ui") == substance_ui), rows)
    if author_key:
        rows = _of(store["authorships"].where(F.col("author_key") == author_key), rows)
    totals = rows.agg(F.count("*").alias("total_papers"))
    shown = rows.select("pmid", "title", "pub_year", "medline_ta", "doi", "pmcid", snippet(F.col("abstract")).alias("snippet"))
    return Result(shown.orderBy(F.desc_nulls_first("pub_year"), "pmid").limit(limit), totals, _scope(store, concept_id, expand))


def article_record(store: Store, pmid: str) -> DataFrame:
    """One article with everything that belongs to it, as arrays; no row if there is none. Every table is filtered to
    the article before anything is gathered."""

    def gathered(table: str, name: str, *fields: str, key: str = "pmid") -> DataFrame:
        return store[table].where(F.col(key) == pmid).agg(F.array_sort(F.collect_list(F.struct(*fields))).alias(name)).withColumn("one", F.lit(1))

    people = store["authorships"].where(F.col("pmid") == pmid).join(store["authors"].select("author_key", "display_name", "orcid"), "author_key", "left")
    out = store["articles"].where(F.col("pmid") == pmid).join(_journals(store), "nlm_id", "left").withColumn("one", F.lit(1))
    out = out.join(people.agg(F.array_sort(F.collect_list(F.struct("position", "author_key", "display_name", "orcid", "is_first", "is_last", "affiliation", "country"))).alias("authors")).withColumn("one", F.lit(1)), "one")
    for part in (
        gathered("mesh_headings", "headings", "descriptor_ui", "descriptor_name", "is_major"),
        gathered("substances", "substances", "substance_ui", "substance_name", "registry_number"),
        gathered("keywords", "keywords", "term"),
        gathered("publication_types", "types", "type_ui", "type_name"),
        gathered("databank_links", "links", "databank", "accession"),
    ):
        out = out.join(part, "one")
    cites = store["citations"].where(F.col("citing_pmid") == pmid).select(F.col("cited_pmid").alias("pmid"))
    total = cites.agg(F.count("*").alias("references_total")).withColumn("one", F.lit(1))
    inside = store["articles"].select("pmid").join(cites, "pmid", "left_semi").agg(F.count("*").alias("references_in_corpus")).withColumn("one", F.lit(1))
    cited = store["citations"].where(F.col("cited_pmid") == pmid).agg(F.count("*").alias("cited_by_in_corpus")).withColumn("one", F.lit(1))
    return out.join(total, "one").join(inside, "one").join(cited, "one").drop("one")


def corpus_stats(store: Store) -> DataFrame:
    """One row: sizes of the tables and the range of years, whole and of the core 95 %.

    Articles are read once, for a histogram with a row a year; other tables give only their counts."""
    years = store["articles"].groupBy("pub_year").agg(F.count("*").alias("n"), F.count("abstract").alias("a"))
    everyone, upto = Window.partitionBy(), Window.orderBy(F.asc_nulls_last("pub_year"))
    known = F.when(F.col("pub_year").isNotNull(), F.col("n"))
    ranked = years.select("pub_year", "n", "a", F.sum(known).over(upto).alias("upto"), F.sum(known).over(everyone).alias("all"))  # a row a year
    core = lambda q: F.min(F.when(F.col("pub_year").isNotNull() & (F.col("upto") > F.floor((F.col("all") - 1) * q + 0.5)), F.col("pub_year")))
    whole = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    out = ranked.agg(whole("n").alias("articles"), whole("a").alias("with_abstract"), F.min("pub_year").alias("first_year"), F.max("pub_year").alias("last_year"), core(0.025).alias("core_first_year"), core(0.975).alias("core_last_year"))
    sizes = [("journals", "journals"), ("authors", "authors"), ("authorships", "authorships"), ("citations", "citations"), ("substances", "substance_rows")]
    counts = [store[table].agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for table, name in sizes]
    words = store["vocabulary"].agg(F.count("*").alias("concepts"), F.countDistinct("concept_id").alias("distinct_concepts"))
    every = reduce(DataFrame.unionAll, counts).agg(*(F.max(F.when(F.col("name") == name, F.col("n"))).alias(name) for _, name in sizes))
    return out.join(F.broadcast(every)).join(F.broadcast(words))  # one row each


def articles_by_id(store: Store, pmids: list[str]) -> DataFrame:
    rows = store["articles"].where(F.col("pmid").isin(list(pmids)))
    return rows.join(_journals(store), "nlm_id", "left").select("pmid", "title", "pub_year", "medline_ta", "doi", "pmcid", "abstract")


def trend_by_year(store: Store, concept_id=None, since_year=None) -> Result:
    rows = scoped_articles(store, concept_id, since_year).where("pub_year is not null").groupBy("pub_year").agg(F.count("*").alias("n_papers"))
    return Result(rows.orderBy("pub_year"), rows.agg(F.coalesce(F.sum("n_papers"), F.lit(0)).alias("total_papers")), _scope(store, concept_id, True))


def _by_place(store: Store, concept_id, since_year, limit: int, place: Column, name: str, caveat: str) -> Result:
    rows = _of(scoped_articles(store, concept_id, since_year), store["authorships"].select("pmid", place.alias(name)))
    counts = rows.where((F.col(name).isNotNull()) & (F.col(name) != "")).groupBy(name).agg(F.countDistinct("pmid").alias("n_papers"))
    return Result(counts.orderBy(F.desc("n_papers"), name).limit(limit), counts.agg(F.count("*").alias("total")), _scope(store, concept_id, True), CAVEATS[caveat])


def list_countries(store: Store, concept_id=None, since_year=None, limit: int = 25) -> Result:
    return _by_place(store, concept_id, since_year, limit, F.col("country"), "country", "countries")


def list_institutions(store: Store, concept_id=None, since_year=None, limit: int = 25) -> Result:
    return _by_place(store, concept_id, since_year, limit, institution_from_affiliation(F.col("affiliation")), "institution", "institutions")


def top_cited(store: Store, concept_id=None, since_year=None, limit: int = 20) -> Result:
    """Papers of a scope by citations within the corpus; details are joined to the few that are shown."""
    scope = scoped_articles(store, concept_id, since_year)
    counts = _of(scope, store["citations"], "cited_pmid").groupBy(F.col("cited_pmid").alias("pmid")).agg(F.count("*").alias("cited_by"))
    top = counts.orderBy(F.desc("cited_by"), "pmid").limit(limit)
    shown = store["articles"].select("pmid", "title", "pub_year", "nlm_id").join(F.broadcast(top), "pmid")  # at most ``limit`` rows
    rows = shown.join(_journals(store), "nlm_id", "left").select("pmid", "cited_by", "title", "pub_year", "medline_ta")
    return Result(rows.orderBy(F.desc("cited_by"), "pmid"), None, _scope(store, concept_id, True), CAVEATS["citations"])


def list_study_types(store: Store, concept_id=None, since_year=None, limit: int = 20) -> Result:
    counts = _of(scoped_articles(store, concept_id, since_year), store["publication_types"]).groupBy("type_name").agg(F.countDistinct("pmid").alias("n_papers"))
    return Result(counts.orderBy(F.desc("n_papers"), "type_name").limit(limit), counts.agg(F.count("*").alias("total_types")), _scope(store, concept_id, True))


def find_trials(store: Store, concept_id=None, since_year=None, limit: int = 25) -> Result:
    scope = scoped_articles(store, concept_id, since_year).select("pmid", "title", "pub_year")
    rows = store["databank_links"].join(scope, "pmid").select("pmid", "databank", "accession", "title", "pub_year")
    return Result(rows.orderBy(F.desc_nulls_first("pub_year"), "accession", "pmid").limit(limit), rows.agg(F.count("*").alias("total_links")), _scope(store, concept_id, True), CAVEATS["trials"])


def compare_concepts(store: Store, a: str, b: str, since_year=None) -> DataFrame:
    """One row: papers of either concept and of both, and shares of each in per cent."""
    sides = [scoped_articles(store, c, since_year).select("pmid", F.lit(k == 0).alias("a"), F.lit(k == 1).alias("b")) for k, c in enumerate((a, b))]
    papers = sides[0].unionAll(sides[1]).groupBy("pmid").agg(F.bool_or("a").alias("a"), F.bool_or("b").alias("b"))
    sums = papers.agg(F.count_if("a").alias("papers_a"), F.count_if("b").alias("papers_b"), F.count_if(F.col("a") & F.col("b")).alias("both"))
    share = lambda n: F.when(F.col(n) > 0, F.round(100.0 * F.col("both") / F.col(n), 1)).otherwise(0.0)
    return sums.select("*", share("papers_a").alias("share_of_a"), share("papers_b").alias("share_of_b"))
