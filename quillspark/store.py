"""A store: tables by name, from Parquet or from any DataFrames."""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession

from .schema import SCHEMAS


_SET = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a temporary one is set only where a local session names none."""
    found = spark.conf.get(_SET, None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError(f"{_SET} names no folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="quillspark-"))
        found = spark.sparkContext.getCheckpointDir()
    return found


#: Schemas of the tables that this process has built, by path.
_BUILT: dict = {}


class Store:
    """Tables by name. A table is made when it is first asked for, so that a plan reads only what it uses."""

    def __init__(self, spark: SparkSession, makers: Mapping[str, Callable[[], DataFrame]]):
        self.spark, self._makers, self._made, self._definitions = spark, dict(makers), {}, {}

    @classmethod
    def of(cls, spark: SparkSession, tables: Mapping[str, DataFrame]) -> Store:
        return cls(spark, {name: (lambda df=df: df) for name, df in tables.items()})

    @classmethod
    def read(cls, spark: SparkSession, path: str) -> Store:
        """The store under a path, with fixed schemas; nothing is inferred."""
        return cls(spark, {name: (lambda name=name: spark.read.schema(SCHEMAS[name]).parquet(f"{path}/{name}.parquet")) for name in SCHEMAS})

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._made:
            self._made[name] = self._makers[name]()
        return self._made[name]

    def __contains__(self, name: str) -> bool:
        return name in self._makers

    def names(self) -> list[str]:
        """Names of the tables; those that begin with an underscore are steps on the way to others."""
        return sorted(name for name in self._makers if not name.startswith("_"))

    def definition(self, name: str) -> DataFrame:
        """The table as it is written, or else the rows that would be written: for a query that reads it once and needs
        few of its columns."""
        return self._definitions[name]() if name in self._definitions else self[name]

    def kept(self, source: str, sorted_by: Mapping[str, str] | None = None, names: Iterable[str] | None = None, lazy: bool = False) -> Store:
        """The same store, of tables built once: one is written to the shared folder when it is first asked for, in order
        of a column if one is named for it, and read from there by every later query of the application on this source.

        Names say which tables are kept so, else all are. A lazy store reads the tables that were written, and is made of
        definitions where they weren't."""
        root = f"{shared_dir(self.spark).rstrip('/')}/store-{self.spark.sparkContext.applicationId}-{hashlib.md5(source.encode()).hexdigest()[:12]}"
        read = lambda path: self.spark.read.schema(_BUILT[path]).parquet(path)

        def of(name: str) -> Callable[[], DataFrame]:
            def make() -> DataFrame:
                path = f"{root}/{name}.parquet"
                if path not in _BUILT:
                    df = self[name]
                    by = (sorted_by or {}).get(name)
                    df = df.repartition(by).sortWithinPartitions(by) if by else df
                    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
                    _BUILT[path] = df.schema
                return read(path)

            return make

        def written_or_defined(name: str) -> Callable[[], DataFrame]:
            return lambda: read(path) if (path := f"{root}/{name}.parquet") in _BUILT else self.definition(name)

        chosen = list(self._makers if names is None else names)
        out = Store(self.spark, self._makers | {name: (written_or_defined if lazy else of)(name) for name in chosen})
        out._definitions = self._definitions | {name: written_or_defined(name) for name in chosen}
        return out

    def keys(self) -> set[str]:
        """Names of the tables and of the steps on the way to them."""
        return set(self._makers)

    def adding(self, makers: Mapping[str, Callable[[], DataFrame]]) -> Store:
        """The store with tables that are made when they are asked for."""
        out = Store(self.spark, self._makers | dict(makers))
        out._definitions = dict(self._definitions)
        return out

    def with_tables(self, **tables: DataFrame) -> Store:
        return Store(self.spark, self._makers | {name: (lambda df=df: df) for name, df in tables.items()})

    def write(self, path: str, names: list[str] | None = None, mode: str = "overwrite") -> None:
        for name in names or self.names():
            self[name].write.mode(mode).option("compression", "zstd").parquet(f"{path}/{name}.parquet")

    def listing(self) -> DataFrame:
        """table, n_rows of every table, counted in one job; none is written for that."""
        from functools import reduce

        from pyspark.sql import functions as F

        counts = [self.definition(n).agg(F.count("*").alias("n_rows")).select(F.lit(n).alias("table"), "n_rows") for n in self.names()]
        return reduce(DataFrame.unionAll, counts)

    def sizes(self, path: str) -> DataFrame:
        """table, n_files, mb of the Parquet files of a store that is written under a path."""
        from pyspark.sql import functions as F

        files = self.spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(path).select("path", "length")
        table = F.regexp_extract("path", r"/(\w+)\.parquet(?:/|\z)", 1)
        return files.groupBy(table.alias("table")).agg(F.count("*").alias("n_files"), F.round(F.sum("length") / 1e6, 1).alias("mb"))

    def show(self, name: str, rows: int = 20, wide: bool = False) -> str:
        """The first rows of a table as text: a grid, or with ``wide`` a line for each column."""
        return self[name]._jdf.showString(rows, 0 if wide else 40, wide)

    def export_csv(self, name: str, path: str) -> None:
        """One table as CSV with a header, for spreadsheets; arrays are joined by commas."""
        from pyspark.sql import functions as F
        from pyspark.sql.types import ArrayType

        df = self[name]
        flat = [F.array_join(F.col(f.name).cast("array<string>"), ",").alias(f.name) if isinstance(f.dataType, ArrayType) else F.col(f.name) for f in df.schema]
        df.select(*flat).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
