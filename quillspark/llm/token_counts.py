"""Exact token counts of texts and of all their prefixes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrow import slices, texts_of, trimmed
from .bpe import prefix_counter
from .tables import documents

VOCABULARY = "byte_bpe_50k.json"


def token_counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = 512, vocabulary: str = VOCABULARY, prefixes: bool = False) -> DataFrame:
    """One row per row: id, n_bytes, n_tokens, over_limit, and fit_chars, the length of the longest prefix within the limit.

    With ``prefixes``, prefix_counts holds the token count of each prefix by length in characters, from 0, so that any
    truncation or budget is answered without encoding again. A null text counts as empty (0 tokens); a null id is
    kept; repeated rows give repeated rows; other columns are not read. An empty table gives no rows. No shuffle.
    """
    schema = f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, n_tokens long, fit_chars long, n_bytes long" + ", prefix_counts array<int>" * prefixes

    def count(batches):
        counter = prefix_counter(vocabulary)
        for batch in batches:
            for part in slices(batch, "text"):
                texts = texts_of(part, "text")
                n, fit = counter.count(texts, limit)
                columns = [part.column("id"), pa.array(n), pa.array(fit), part.column("n_bytes")]
                if prefixes:
                    columns.append(pa.array([counter.prefixes(t) for t in texts.to_pylist()], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, names=[id_col, "n_tokens", "fit_chars", "n_bytes", "prefix_counts"][: len(columns)])

    read = df.select(df[id_col].alias("id"), df[text_col].alias("text"), F.coalesce(F.octet_length(df[text_col]), F.lit(0)).cast("long").alias("n_bytes"))
    out = read.mapInArrow(trimmed(count), schema)
    return out.select(id_col, "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"), "fit_chars", *["prefix_counts"] * prefixes)


def tokens_at(prefix_counts, n_chars):
    """The tokens of a text cut after n_chars characters, from its prefix counts."""
    return F.get(prefix_counts, F.least(F.lit(n_chars), F.size(prefix_counts) - 1))


def longest_fit(prefix_counts, budget):
    """The length of the longest prefix of at most budget tokens, from prefix counts."""
    within = F.transform(prefix_counts, lambda c, i: F.when(c <= budget, i).otherwise(-1))
    return F.array_max(within)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document, for a limit of 512."""
    return token_counts(documents(spark, sf_dir))
