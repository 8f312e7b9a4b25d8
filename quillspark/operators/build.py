"""From files to a store and its index in one call that can be repeated, and tools to watch it.

Everything but vectors is made anew from all files, so that nothing is counted twice; vectors are made only for texts that
have none. A marker says that the index is complete, and is taken away while it isn't.
"""

from __future__ import annotations

import os
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.records import landed, read_records, read_taxonomy, tables_of
from ..store import Store, shared_dir
from . import retrieval
from .refine import build_report, refine

#: Texts that an encoder gets at once.
BATCH = 64
_MARKER = "vectors_complete"


def add_files(spark: SparkSession, source: str, out: str, pattern: str = "*.xml*", taxonomy: str | None = None, encode: Callable[[list[str]], list[list[float]]] | None = None, model: str = "", stemmed: bool = True) -> DataFrame:
    """Reads all files of a folder and writes out/store and out/index. Gives table, n_rows, n_keys of what was written."""
    # files are parsed once, and every table is made of the rows that were landed
    rows = f"{shared_dir(spark).rstrip('/')}/rows-{uuid.uuid4().hex}"
    tables = tables_of(landed(read_records(spark, source, pattern), rows))
    if taxonomy:
        tables |= read_taxonomy(spark, taxonomy)
    store = refine(tables, spark)
    # every table is written before the vocabulary, which is made from those that were
    store.write(f"{out}/store", [n for n in store.names() if n != "vocabulary"])
    written = Store.read(spark, f"{out}/store")
    from .concepts import build_vocabulary

    _remove(spark, rows)
    build_vocabulary(written).write.mode("overwrite").option("compression", "zstd").parquet(f"{out}/store/vocabulary.parquet")
    write_index(written, f"{out}/index", stemmed)
    if encode is not None:
        write_vectors(written, f"{out}/index", encode, model)
    return build_report(written)


def write_index(store: Store, path: str, stemmed: bool = True) -> None:
    """postings in order of the term, lengths, and what a result shows of a text (docmeta)."""
    spark, texts = store.spark, retrieval.document_text(store)
    save = lambda df, name: df.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/{name}.parquet")
    # texts are counted once, for both tables
    at = f"{shared_dir(spark).rstrip('/')}/counts-{uuid.uuid4().hex}"
    retrieval.term_counts(texts, stemmed=stemmed).write.option("compression", "zstd").parquet(at)
    counts = spark.read.parquet(at)
    save(retrieval.postings_of(counts).repartition("term").sortWithinPartitions("term"), "postings")
    save(retrieval.lengths_of(counts), "lengths")
    _remove(spark, at)
    save(texts.select("pmid", "title", "pub_year", "medline_ta"), "docmeta")


@dataclass
class Index:
    """A written index; vectors only once the marker says that they are complete."""

    spark: SparkSession
    path: str
    marker: dict | None = field(default=None)

    def __post_init__(self):
        self.marker = marker(self.spark, self.path)

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}.parquet")

    def search(self, store: Store, query: str, k: int = 8, since_year: int | None = None, encode: Callable[[list[str]], list[list[float]]] | None = None, stemmed: bool = True) -> dict:
        """Search of both kinds where there are vectors and an encoder, else by words alone."""
        vectors = self.table("vectors") if self.marker and encode else None
        one = (lambda text: encode([text])[0]) if encode else None
        return retrieval.search(store, self.table("postings"), query, k, since_year, vectors, one, stemmed=stemmed, sizes=self.table("lengths"))


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def _remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def marker(spark: SparkSession, path: str) -> dict | None:
    """model, docs, made of a complete set of vectors; None while there is none."""
    at = f"{path}/{_MARKER}.json"
    return spark.read.schema("model string, docs long, made string").json(at).first().asDict() if _exists(spark, at) else None


def write_vectors(store: Store, path: str, encode: Callable[[list[str]], list[list[float]]], model: str, batch: int = BATCH, truncate: int | None = 2000) -> int:
    """Adds vectors of the texts that have none or have changed, and marks the index as complete. Gives how many it has.

    Texts are cut for the encoder alone; the index of words holds them whole."""
    spark, at = store.spark, f"{path}/vectors.parquet"
    _remove(spark, f"{path}/{_MARKER}.json")
    done = spark.read.parquet(at) if _exists(spark, at) else None
    texts = retrieval.document_text(store, truncate=truncate).select("pmid", "text")
    have = retrieval.build_vectors(texts, done, encode, at, batch).count()
    made = time.strftime("%Y-%m-%dT%H:%M:%SZ", time.gmtime())
    spark.createDataFrame([(model, have, made)], "model string, docs long, made string").coalesce(1).write.mode("overwrite").json(f"{path}/{_MARKER}.json")
    return have


def progress(store: Store, path: str, docs_a_second: float | None = None) -> dict:
    """How many texts have vectors, of how many, and the hours left at a rate."""
    spark, at = store.spark, f"{path}/vectors.parquet"
    total = store["articles"].where("abstract is not null").count()
    done = spark.read.parquet(at).select("pmid").distinct().count() if _exists(spark, at) else 0
    out = {"complete": marker(spark, path) is not None, "done": done, "total": total, "percent": round(100 * done / total, 1) if total else 0.0}
    return out | ({"hours_left": round((total - done) / docs_a_second / 3600, 2)} if docs_a_second else {})


def encoder_rate(texts: DataFrame, encode: Callable[[list[str]], list[list[float]]], n: int = 300, batch: int = BATCH) -> dict:
    """Texts a second of an encoder in this process, over the first n by id."""
    some = [r["text"] for r in texts.orderBy("pmid").limit(n).select("text").collect()]
    start = time.perf_counter()
    for at in range(0, len(some), batch):
        encode(some[at : at + batch])
    seconds = time.perf_counter() - start
    return {"docs": len(some), "seconds": seconds, "docs_a_second": len(some) / seconds if seconds else 0.0}


def restarting(step: Callable[[], object], times: int = 20, wait: float = 30.0, log: Callable[[str], None] = print):
    """Runs a step that goes on where it stopped, again after each failure; the last failure is raised."""
    for k in range(1, times + 1):
        try:
            return step()
        except Exception as e:
            if k == times:
                raise
            log(f"{time.strftime('%H:%M:%S')} stopped ({e}); start {k + 1} of {times} in {wait:g} s")
            time.sleep(wait)


def read_env(path: str) -> dict[str, str]:
    """KEY=value lines into the environment; what is set already stays, as do lines without a key or with a hash sign."""
    found = {}
    for line in Path(path).read_text().splitlines() if os.path.exists(path) else []:
        key, sign, value = line.strip().partition("=")
        if sign and key.strip() and not key.startswith("#"):
            found[key.strip()] = value.strip().strip("\"'")
            os.environ.setdefault(key.strip(), found[key.strip()])
    return found


def write_shards(store: Store, name: str, path: str) -> None:
    """A table as header-less CSV shards, flags as 1 and 0, as ``read_csv_shards`` takes them."""
    df = store[name]
    flat = [F.when(F.col(f.name), "1").when(~F.col(f.name), "0").alias(f.name) if f.dataType.typeName() == "boolean" else F.col(f.name).cast("string") for f in df.schema if not (name == "authorships" and f.name == "country")]
    df.select(*flat).write.mode("overwrite").option("escape", '"').option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
