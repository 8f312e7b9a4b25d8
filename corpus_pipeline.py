"""The training-data pipeline: language, near-duplicates, personal data, packing.

Every stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last return the columns
of ``documents``. Null ids and repeated rows are allowed; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm import jaccard_join, language, packing, personal
from quillspark.llm.tables import Staged, documents

#: The near-duplicate stage: words in a shingle, and least similarity in per cent.
NEAR_WORDS, NEAR_PERCENT = 5, 80
#: A text of which the chosen language knows less than this share of n-grams is in none of the learned languages.
LEAST_KNOWN = 0.1


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the labelled ones teach; a missing label is filled in. Texts that are null or have
    no letter go, as do those in no learned language."""
    columns = docs.columns
    found = language.predict(docs, language.train(docs), keep=tuple(columns))
    found = found.toDF("own_id", "lang_pred", "score", "known_share", *(f"in_{k}" for k in range(len(columns))))
    kept = found.where((F.col("lang_pred") != language.UNKNOWN) & (F.col("known_share") >= LEAST_KNOWN))
    at = columns.index("lang")
    return kept.select(*(F.coalesce(f"in_{k}", "lang_pred").alias(c) if k == at else F.col(f"in_{k}").alias(c) for k, c in enumerate(columns)))


def keep_one_of_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates, the document with the smallest id. Documents without an id all stay; of rows
    that share an id, one does."""
    rows = jaccard_join.jaccard_components(docs, width=NEAR_WORDS, percent=NEAR_PERCENT).where("doc_id is not null")
    ids = rows.where("doc_id = component_id").groupBy("doc_id").agg(F.count("*").alias("times"))
    ids = Staged(spark, "near").write(ids, "ids")
    # by a shuffle at every size, as the ids grow with the input
    kept = docs.join(ids.where("times = 1").select("doc_id").hint("merge"), "doc_id", "left_semi")
    if not (repeated := ids.where("times > 1")).isEmpty():
        # by the order of all columns as text, so that a repeated run keeps the same row whatever the columns' types
        again = docs.join(repeated.select("doc_id").hint("merge"), "doc_id", "left_semi")
        row = F.struct(*(c for c in docs.columns if c != "doc_id"))
        least = again.groupBy("doc_id").agg(F.min_by(row, F.to_json(row)).alias("row"))
        kept = kept.unionByName(least.select("doc_id", "row.*"))
    return kept.select(docs.columns).unionByName(docs.where("doc_id is null"))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data in the texts replaced by its kind; n_chars follows the text."""
    masked = personal.redact(docs)
    return masked.withColumn("n_chars", F.char_length("text").cast("long")).select(docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of 2048 tokens."""
    return packing.pack(docs)


STAGES = [("language", keep_languages), ("near_duplicates", keep_one_of_near), ("personal_data", mask_personal_data), ("packing", pack_sequences)]
#: Tokens, Bloom filters and bootstrapped patterns are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, stage = documents(spark, sf_dir), Staged(spark, "pipeline")
    for name, f in STAGES:
        docs = stage.write(f(spark, docs, sf_dir), name)
    return docs
