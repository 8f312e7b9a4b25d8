"""Concepts: the vocabulary, resolution of free text, the taxonomy and the papers of a concept."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import keyword_id, strip
from ..store import Store

#: Weights of an exact, a leading and any other match, and of a spelling that isn't the one given.
EXACT, LEADING, INSIDE, VARIANT = 1.0, 0.6, 0.3, 0.85
#: Words that name no concept on their own.
STOP_WORDS = frozenset(
    "the a an of for in on and or to with which what who list top how many me are is publish publishes publishing journals drugs papers studies about show give find".split()
)
ID_SHAPE = re.compile(r"^(?:kw:.+|[A-Z]\d{4,12})$")
_LOOKUP = ("concept_id", "concept_name", "kind", "code", "n_papers", "name_lc")


def build_vocabulary(store: Store) -> DataFrame:
    """Headings, substances and keywords (of three characters and two papers at least) with their distinct papers.

    Headings and substances have one row for each paper and id (the tables' keys), so their papers are plain counts."""

    def one(table: str, ui: str, name: str, kind: str, code):
        by = store[table].groupBy(F.col(ui).alias("concept_id"), F.col(name).alias("concept_name")).agg(F.countDistinct("pmid").alias("n_papers"), F.min(code).alias("code"))
        return by.select("concept_id", "concept_name", F.lit(kind).alias("kind"), "code", "n_papers", F.lower("concept_name").alias("name_lc"))

    none = F.lit(None).cast("string")
    keyword = store["keywords"].select("pmid", keyword_id(F.col("term")).alias("concept_id"), F.lower(strip(F.col("term"))).alias("name")).where(F.char_length("name") > 2)
    counted = keyword.groupBy("concept_id", "name").agg(F.countDistinct("pmid").alias("n_papers")).where("n_papers >= 2")
    keywords = counted.select("concept_id", F.col("name").alias("concept_name"), F.lit("keyword").alias("kind"), none.alias("code"), "n_papers", F.col("name").alias("name_lc"))
    registry = F.when(F.col("registry_number") != "0", F.col("registry_number"))
    return one("mesh_headings", "descriptor_ui", "descriptor_name", "mesh", none).unionByName(one("substances", "substance_ui", "substance_name", "substance", registry)).unionByName(keywords)


def lookup(store: Store) -> DataFrame:
    """The vocabulary with the synonyms of headings that the corpus has; a name may stand for several concepts."""
    own = store["vocabulary"].select(*_LOOKUP)
    if "synonyms" not in store:
        return own
    present = own.where("kind = 'mesh'").groupBy("concept_id").agg(F.max("n_papers").alias("n_papers"))
    synonyms = store["synonyms"].groupBy(F.col("synonym").alias("name_lc"), "concept_id").agg(F.min("concept_name").alias("concept_name"))
    extra = synonyms.join(present, "concept_id").select("concept_id", "concept_name", F.lit("mesh-synonym").alias("kind"), F.lit(None).cast("string").alias("code"), "n_papers", "name_lc")
    return own.unionByName(extra)


def spellings(text: str) -> list[str]:
    """The text as given, without apostrophes, and either without a plural s."""
    first = text.strip().lower()
    out = [first]
    if (bare := first.replace("’", "").replace("'", "")) != first:
        out.append(bare)
    out += [t[:-1] for t in out if len(t) > 4 and t.endswith("s")]
    return [t for t in dict.fromkeys(out) if t]


def resolve(store: Store, text: str, limit: int = 5) -> DataFrame:
    """Concepts for a text: names that contain a spelling of it, by papers weighted by how well they match; the best
    name of each concept. Ties go to the smaller id."""
    names, frames = lookup(store), None
    for k, spelling in enumerate(spellings(text)):
        weight = F.when(F.col("name_lc") == spelling, EXACT).when(F.col("name_lc").startswith(spelling), LEADING).otherwise(INSIDE)
        hit = names.where(F.col("name_lc").contains(spelling)).withColumn("score", F.coalesce("n_papers", F.lit(0)) * weight * (1.0 if k == 0 else VARIANT))
        frames = hit if frames is None else frames.unionByName(hit)
    if frames is None:
        return names.limit(0).withColumn("score", F.lit(0.0)).drop("name_lc")
    best = Window.partitionBy("concept_id").orderBy(F.desc("score"), "kind", "name_lc", "concept_name")
    one = frames.withColumn("k", F.row_number().over(best)).where("k = 1")
    return one.orderBy(F.desc("score"), "concept_id").limit(limit).select("concept_id", "concept_name", "kind", "code", "n_papers", "score")


def name_index(store: Store) -> DataFrame:
    """One concept for each name: that with the most papers, then the smallest id."""
    by = Window.partitionBy("name_lc").orderBy(F.desc_nulls_last("n_papers"), "concept_id", "kind")
    return lookup(store).withColumn("k", F.row_number().over(by)).where("k = 1").drop("k")


def _grams(text: str) -> list[tuple[str, int, int]]:
    """Runs of one to four words with their lengths and places; a single word counts if it is long enough and no stop word."""
    words = re.findall(r"[a-z0-9\-]+", text.lower())
    runs = ((words[i : i + n], n, i) for i in range(len(words)) for n in range(1, min(4, len(words) - i) + 1))
    return [(" ".join(run), n, i) for run, n, i in runs if n > 1 or len(run[0]) > 3 and run[0] not in STOP_WORDS]


def spot(store: Store, text: str, limit: int = 5) -> DataFrame:
    """Concepts named in a sentence by runs of up to four words, longest first."""
    grams = store.spark.createDataFrame(_grams(text), "matched string, words int, place int")
    hits = name_index(store).join(F.broadcast(grams), F.col("name_lc") == F.col("matched"))  # at most four rows a word of the sentence
    first = Window.partitionBy("concept_id").orderBy(F.desc("words"), "place")
    one = hits.withColumn("k", F.row_number().over(first)).where("k = 1")
    return one.orderBy(F.desc("words"), F.desc("n_papers"), "concept_id").limit(limit).select("concept_id", "concept_name", "kind", "code", "n_papers", "matched", "words")


def resolve_all(store: Store, text: str, limit: int = 8) -> DataFrame:
    """What a sentence names and what the whole text resolves to, in one list: two words or more first."""
    named = spot(store, text, limit).select("concept_id", "concept_name", "kind", "code", "n_papers", F.least("words", F.lit(2)).alias("weight"), F.lit(0).alias("from"))
    whole = resolve(store, text, limit).select("concept_id", "concept_name", "kind", "code", "n_papers", F.lit(1).alias("weight"), F.lit(1).alias("from"))
    first = Window.partitionBy("concept_id").orderBy("from")
    one = named.unionByName(whole).withColumn("k", F.row_number().over(first)).where("k = 1")
    return one.orderBy(F.desc("weight"), F.desc("n_papers"), "concept_id").limit(limit).drop("k", "from")


def descendants(store: Store, concept_id: str) -> DataFrame:
    """A concept and all below it in the taxonomy: ids with a tree number equal to one of its own or after it and a dot.

    Keywords and concepts without a tree number have only themselves."""
    own = store.spark.createDataFrame([(concept_id,)], "concept_id string")
    if concept_id.startswith("kw:"):
        return own
    tree = store["mesh_tree"]
    roots = tree.where(F.col("concept_id") == concept_id).select(F.col("tree_number").alias("root")).distinct()  # the positions of one concept
    below = tree.join(F.broadcast(roots), (F.col("tree_number") == F.col("root")) | F.col("tree_number").startswith(F.concat("root", F.lit("."))), "left_semi")
    return below.select("concept_id").union(own).distinct()


def scope_pmids(store: Store, concept_id: str, expand: bool = True) -> DataFrame:
    """The distinct papers of a concept, with its narrower ones unless told otherwise."""
    if concept_id.startswith("kw:"):
        return store["keywords"].where(keyword_id(F.col("term")) == concept_id).select("pmid").distinct()
    if expand:
        ids = descendants(store, concept_id).toDF("ui")
        has = lambda df, ui: df.join(ids, F.col(ui) == F.col("ui"), "left_semi")
    else:
        has = lambda df, ui: df.where(F.col(ui) == concept_id)
    return has(store["mesh_headings"], "descriptor_ui").select("pmid").union(has(store["substances"], "substance_ui").select("pmid")).distinct()


def scope_summary(store: Store, concept_id: str, expand: bool = True) -> DataFrame:
    """expanded, descriptors_included: how many concepts a scope takes in."""
    if not expand:
        return store.spark.createDataFrame([(False, 1)], "expanded boolean, descriptors_included long")
    return descendants(store, concept_id).agg((F.count("*") > 1).alias("expanded"), F.count("*").alias("descriptors_included"))


def scoped_articles(store: Store, concept_id: str | None = None, since_year: int | None = None, expand: bool = True) -> DataFrame:
    """Articles of a concept since a year; an argument that is empty or 0 asks for nothing."""
    articles = store["articles"]
    if since_year:
        articles = articles.where(F.col("pub_year") >= since_year)
    return articles.join(scope_pmids(store, concept_id, expand), "pmid", "left_semi") if concept_id else articles


@dataclass(frozen=True)
class Scope:
    """A concept argument after interpretation: its id, what to tell the reader, or why there is none."""

    concept_id: str | None = None
    note: str | None = None
    error: str | None = None


def interpret(store: Store, concept: str | None) -> Scope:
    """An id that the corpus has, or the best concept for a text. An unknown id is an error, never an empty answer."""
    if not concept:
        return Scope()
    concept = concept.strip()
    if ID_SHAPE.match(concept):
        # one id is asked for: where no vocabulary is written, none is made for that
        known = store.definition("vocabulary").where(F.col("concept_id") == concept).select("concept_name").unionByName(store["mesh_tree"].where(F.col("concept_id") == concept).select("concept_name")).first()
        if known is None:
            return Scope(error=f"No concept has the id {concept}.")
        return Scope(concept, f"Scope: {known['concept_name']} ({concept}).")
    found = resolve(store, concept, 1).first()
    if found is None:
        return Scope(error=f"Nothing in the vocabulary matches '{concept}'.")
    return Scope(found["concept_id"], f"Interpreted '{concept}' as {found['concept_name']} ({found['concept_id']}).")
