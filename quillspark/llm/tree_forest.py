"""Near-duplicate embeddings by a forest of random-projection trees.

A node splits its vectors by their projection on a random direction, at the median of a bounded sample's projections;
vectors within SPILL of it (times the projections' spread) go to both sides. Where no sample is left, nodes split at the projection of the last
sample's mean. Leaves are compared whole: a leaf of more than BLOCK vectors is dealt into blocks and compared by pairs
of blocks, so that no task holds more than two of them. Each comparison gives only edges that join what is linked; the
union over all trees is the components. Links are then counted within each component, by pairs of blocks again, which
also finds those that no leaf holds; no pair is ever sent.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrow import trimmed
from .components import components, forest
from .tables import Staged, embeddings
from .vectors import classes, doubles, matrix

LEAST = 0.9
#: Least trees; vectors aimed at in a leaf; the share of the spread that spills over; vectors in a block; and the sample.
TREES, LEAF, SPILL, BLOCK, SAMPLE = 6, 256, 0.25, 1024, 20_000
#: Share of the links in a cluster that a level of a tree keeps, and share that all trees together may lose; trees are added with depth.
LEVEL_KEEPS, LOST = 0.9, 0.002


def trees_for(depth: int) -> int:
    """Trees that hold the share of lost links whatever the depth."""
    return max(TREES, math.ceil(math.log(LOST) / math.log1p(-(LEVEL_KEEPS**depth)))) if depth else TREES


def _direction(dims: int, seed: str) -> np.ndarray:
    d = np.random.default_rng(zlib.crc32(seed.encode())).standard_normal(dims)
    return d / np.linalg.norm(d)


class Forest:
    """Trees by length of vector; a tree is a dictionary of nodes by path."""

    def __init__(self, sample: list[np.ndarray], depth: int, trees: int | None = None):
        trees = trees_for(depth) if trees is None else trees
        self.depth, self.trees, self.nodes = depth, trees, {}
        by: dict[int, list] = {}
        for v in sample:
            by.setdefault(len(v), []).append(v / np.linalg.norm(v))
        for dims, rows in by.items():
            for tree in range(trees):
                self._grow(dims, tree, "", np.stack(rows))

    def _grow(self, dims: int, tree: int, path: str, rows: np.ndarray) -> None:
        if len(path) >= self.depth or len(rows) < 2:
            return
        along = rows @ _direction(dims, f"{dims}/{tree}/{path}")
        self.nodes[dims, tree, path] = float(np.median(along)), float(along.std()), rows.mean(0)
        for side, at in (("0", along <= np.median(along)), ("1", along > np.median(along))):
            self._grow(dims, tree, path + side, rows[at])

    def leaves(self, unit: np.ndarray, tree: int):
        """(path, rows) of the leaves that unit vectors of one length come to."""
        dims = unit.shape[1]
        todo = [("", np.arange(len(unit)), None)]
        while todo:
            path, rows, last = todo.pop()
            if len(path) == self.depth or not len(rows):
                if len(rows):
                    yield path, rows
                continue
            direction = _direction(dims, f"{dims}/{tree}/{path}")
            along = unit[rows] @ direction
            node = self.nodes.get((dims, tree, path))
            if node:
                cut, spread, last = node[0], node[1], (node[2], node[1])
            else:
                mean, spread = last if last is not None else (np.zeros(dims), 1 / math.sqrt(dims))
                cut = float(mean @ direction)
            todo.append((path + "0", rows[along <= cut + SPILL * spread], last))
            todo.append((path + "1", rows[along > cut - SPILL * spread], last))


def _assign(forest):
    def run(batches):
        for batch in batches:
            sizes = np.array([len(v) // 8 for v in batch.column("vector").to_pylist()])
            for dims in np.unique(sizes):
                own = np.flatnonzero(sizes == dims)
                part = batch.take(pa.array(own))
                x = matrix(part.column("vector"))
                unit = x / np.linalg.norm(x, axis=1, keepdims=True)
                for tree in range(forest.value.trees):
                    for path, rows in forest.value.leaves(unit, tree):
                        leaf = f"{dims}/{tree}/{path}"
                        yield pa.RecordBatch.from_arrays([pa.array([leaf] * len(rows)), part.column("node").take(pa.array(rows))], names=["leaf", "node"])

    return run


def _near(table: pa.Table, i: int, j: int, least: float):
    """Rows of the two blocks, and a matrix for every 256 of the first: whether they are near those of the second."""
    block, x = table.column("block").to_numpy(), matrix(table.column("vector"))
    norms = np.linalg.norm(x, axis=1)
    first, second = np.flatnonzero(block == i), np.flatnonzero(block == j)

    def parts():
        for start in range(0, len(first), 256):
            rows = first[start : start + 256]
            yield rows, ((x[rows] @ x[second].T) / np.outer(norms[rows], norms[second]) >= least) & (rows[:, None] != second[None])

    return first, second, parts()


def _edges(least: float):
    def run(key, table):
        nodes = table.column("node").to_numpy()
        first, second, parts = _near(table, key[1].as_py(), key[2].as_py(), least)
        links = np.concatenate([part for _, part in parts]) if len(first) else np.zeros((0, len(second)), bool)
        u, v = forest(links, first, second, len(nodes)) if links.any() else (np.zeros(0, np.int64),) * 2
        return pa.table({"u": pa.array(nodes[u], pa.int64()), "v": pa.array(nodes[v], pa.int64())})

    return run


def _counts(least: float):
    """node, links of each vector with the rows of the other block, or of its own."""

    def run(key, table):
        nodes, copies = table.column("node").to_numpy(), table.column("copies").to_numpy()
        links = np.zeros(len(nodes), np.int64)
        first, second, parts = _near(table, key[1].as_py(), key[2].as_py(), least)
        for rows, part in parts:
            links[rows] += part @ copies[second]
            if key[1] != key[2]:
                links[second] += copies[rows] @ part
        return pa.table({"node": pa.array(nodes), "links": pa.array(links)})

    return run


def _paired(rows: DataFrame, group: str, vectors: DataFrame) -> DataFrame:
    """The rows (group, node) with their vectors, dealt into blocks of each group and grouped by pairs of blocks."""
    blocks = rows.groupBy(group).agg(F.count("*").alias("size")).where("size > 1").select(group, F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks"))
    dealt = rows.join(blocks, group).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    # a row of block k meets every block: as the first of a pair or as the second
    other = dealt.select(group, "node", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    paired = other.select(group, "node", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    return paired.join(vectors, "node").groupBy(group, "i", "j")


def near_vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", least: float = LEAST) -> DataFrame:
    """One row per row: id, n_links (other rows linked directly), component_id (smallest id reachable), kept.

    Ids are integers. Equal vectors are one class, whose rows are linked with each other; rows that share an id but not
    the vector are told apart. A null id links nothing and gets a null component; vectors that are null, empty or zero
    or hold null or non-finite components aren't linked, nor are vectors of different lengths. Repeated rows are rows
    of their own. An empty table gives no rows; other columns aren't read.
    """
    spark = df.sparkSession
    stage = Staged(spark, "forest")
    rows = stage.write(doubles(df, id_col, vector_col), "rows")
    reps = stage.write(classes(rows), "classes")
    n = reps.count()
    sample = [np.frombuffer(r["vector"], np.float64) for r in reps.orderBy(F.xxhash64("node")).limit(SAMPLE).select("vector").collect()]
    forest = spark.sparkContext.broadcast(Forest(sample, max(0, math.ceil(math.log2(max(1, n / LEAF))))))
    leaves = stage.write(reps.select("node", "vector").mapInArrow(trimmed(_assign(forest)), "leaf string, node long"), "leaves")
    edges = _paired(leaves, "leaf", reps.select("node", "vector")).applyInArrow(lambda key, table: _edges(least)(key, table), "u long, v long")
    edges = stage.write(edges.distinct(), "edges")
    stage.drop("leaves")
    labels = stage.write(components(edges, stage).toDF("node", "component"), "labels")
    counted = _paired(labels, "component", reps.select("node", "vector", "copies")).applyInArrow(lambda key, table: _counts(least)(key, table), "node long, links long")
    links = counted.groupBy("node").agg(F.sum("links").alias("links"))
    found = reps.select("key", "node", "id", "copies").join(links, "node", "left").join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
    found = stage.write(found.drop("node"), "found")
    smallest = stage.write(found.groupBy("component").agg(F.min("id").alias("component_id")), "smallest")
    table = stage.write(found.join(smallest, "component").select("key", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id"), "table")
    stage.drop("classes", "edges", "labels", "found", "smallest")
    own = F.when(F.col("id").isNotNull(), F.coalesce("component_id", "id"))
    out = rows.select("id", "key").join(table, "key", "left")
    return out.select(F.col("id").alias(id_col), F.when(F.col("id").isNull(), 0).otherwise(F.coalesce("n_links", F.lit(0))).cast("long").alias("n_links"), own.alias("component_id"), F.coalesce(F.col("id") == own, F.lit(False)).alias("kept"))


def op9_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicates among all embeddings."""
    return near_vectors(embeddings(spark, sf_dir))
