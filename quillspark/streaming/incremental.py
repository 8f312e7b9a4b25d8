"""Daily files into a store: each micro-batch of nested rows is merged, the latest version of an article wins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.refine import refine
from ..sources.records import RECORD, parsed, tables_of
from ..store import Store


def start(spark: SparkSession, source: str, landed: str, checkpoint: str, pattern: str = "*.xml*") -> StreamingQuery:
    """Parses files that haven't been seen and appends their rows to the landing table; stops when none are left.

    Spark's checkpoint remembers the files, so a restart goes on where it stopped."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", pattern).load(source)

    def land(batch: DataFrame, number: int) -> None:
        # a batch that is run again replaces its own rows
        batch.write.mode("overwrite").option("compression", "zstd").parquet(f"{landed}/batch={number}")

    rows = files.select("path", "content").mapInArrow(parsed, RECORD)
    return rows.writeStream.foreachBatch(land).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def store_of(spark: SparkSession, landed: str, **options) -> Store:
    """The store of all landed rows; deletes are applied, and revised articles replace earlier ones."""
    return refine(tables_of(spark.read.schema(RECORD).parquet(f"{landed}/batch=*")), spark, **options)
