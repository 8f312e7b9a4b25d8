"""Nearest neighbours by score-aware quantisation, four-bit table scans and exact reranking.

Cosine is the inner product of unit vectors. A vector is cut into pieces of two dimensions, each coded by one of 16
centres. Codebooks and codes minimise the anisotropic loss |r|^2 + (ETA - 1) (x . r)^2 of the residual r, in which
the part parallel to the vector, which moves large inner products most, weighs ETA times as much as the rest. A scan
adds up entries of a query's tables of 16 inner products a piece (taken two pieces at a time, so that a byte is one
look-up); the best of each block are compared exactly, ties at the cut included. Where the quantisation error seen
there leaves room for a better one beyond the cut, the block is compared exactly as a whole.

Equal vectors are one class, searched and found once. Coded classes stay where they are; queries come to them in waves
of bounded size, and a task gives each query's best of all its blocks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .arrow import trimmed
from .tables import Staged, embeddings
from .vectors import doubles, matrix

#: Rows that the codebooks are fitted on; the score from which the loss is derived; and rounds of fitting.
SAMPLE, THRESHOLD, ROUNDS = 10_000, 0.2, 6
#: Candidates in a block that are reranked for each neighbour asked for; vectors in a block; bytes of a wave of queries.
RERANK, DATA_BLOCK, WAVE = 40, 16_384, 16 << 20
#: More than rounding may change a cosine.
_EPS = 1e-9


class Quantiser:
    """Codebooks: centres[piece, code] of two dimensions each."""

    def __init__(self, sample: np.ndarray, rounds: int = ROUNDS):
        x = self.cut(sample)
        n, pieces, _ = x.shape
        d = sample.shape[1] if sample.size else 2
        self.eta = max(1.0, (d - 1) * THRESHOLD**2 / (1 - THRESHOLD**2))
        rng = np.random.default_rng(7)
        self.centres = np.zeros((pieces, 16, 2))
        if n:
            for j in range(pieces):
                self.centres[j] = x[rng.choice(n, 16, replace=n < 16), j]
        for _ in range(rounds if n else 0):
            codes = self.encode(sample)
            chosen = self.centres[np.arange(pieces), codes]
            along = np.einsum("npk,npk->np", x, x - chosen)
            rest = along.sum(1)
            for j in range(pieces):
                y, s = x[:, j], rest - along[:, j] + np.einsum("nk,nk->n", x[:, j], x[:, j])
                for c in range(16):
                    own = codes[:, j] == c
                    if own.any():
                        z = y[own]
                        left = len(z) * np.eye(2) + (self.eta - 1) * z.T @ z
                        self.centres[j, c] = np.linalg.solve(left, z.sum(0) + (self.eta - 1) * (s[own] @ z))
                    else:
                        self.centres[j, c] = y[rng.integers(n)]

    @staticmethod
    def cut(unit: np.ndarray) -> np.ndarray:
        """Pieces of two dimensions; an even number of pieces, the last filled with zeros."""
        width = -(-max(1, unit.shape[1]) // 4) * 4
        return np.pad(unit, ((0, 0), (0, width - unit.shape[1]))).reshape(len(unit), width // 2, 2)

    def encode(self, unit: np.ndarray) -> np.ndarray:
        """Codes by coordinate descent on the loss, from the nearest centres."""
        x = self.cut(unit)
        pieces = x.shape[1]
        own = np.einsum("npk,npk->np", x, x)
        dots = np.einsum("npk,pck->npc", x, self.centres)
        far = own[:, :, None] - 2 * dots + np.einsum("pck,pck->pc", self.centres, self.centres)
        along = own[:, :, None] - dots
        codes = far.argmin(2)
        rows = np.arange(len(x))
        parallel = along[rows[:, None], np.arange(pieces), codes]
        total = parallel.sum(1)
        for _ in range(2):
            for j in range(pieces):
                rest = total - parallel[:, j]
                codes[:, j] = (far[:, j] + (self.eta - 1) * (rest[:, None] + along[:, j]) ** 2).argmin(1)
                parallel[:, j] = along[rows, j, codes[:, j]]
                total = rest + parallel[:, j]
        return codes

    def pack(self, codes: np.ndarray) -> np.ndarray:
        """Two codes a byte."""
        return (codes[:, ::2] << 4 | codes[:, 1::2]).astype(np.uint8)

    def tables(self, queries: np.ndarray) -> np.ndarray:
        """For each query and byte, the inner products of the 256 pairs of centres."""
        single = np.einsum("qpk,pck->qpc", self.cut(queries), self.centres).astype(np.float32)
        return (single[:, ::2, :, None] + single[:, 1::2, None, :]).reshape(len(queries), -1, 256)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def cosines(q: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Exact cosines of one vector with others, summed in order of the components."""
    total = lambda x: np.cumsum(x, axis=1)[:, -1] if len(x) else np.zeros(0)
    return np.clip(total(q * rows) / np.sqrt(total(q[None] * q) * total(rows * rows)), -1, 1)


def _coded(quantisers):
    """rep, vector, codes; vectors of a length that the sample lacks have no codes."""

    def run(batches):
        for batch in batches:
            vectors = batch.column("vector").to_pylist()
            codes: list[bytes | None] = [None] * len(vectors)
            sizes = np.array([len(v) // 8 for v in vectors])
            for dims in np.unique(sizes):
                if quantiser := quantisers.value.get(int(dims)):
                    own = np.flatnonzero(sizes == dims)
                    packed = quantiser.pack(quantiser.encode(_unit(matrix(batch.column("vector").take(pa.array(own))))))
                    for k, row in zip(own, packed):
                        codes[k] = row.tobytes()
            yield pa.RecordBatch.from_arrays([batch.column("rep"), batch.column("vector"), pa.array(codes, pa.binary())], names=["rep", "vector", "codes"])

    return run


class _Best:
    """The best of each query so far, by score, then id."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.ids, self.scores = np.zeros((queries, k), np.int64), np.full((queries, k), -np.inf)

    def add(self, query: int, ids: np.ndarray, scores: np.ndarray) -> None:
        ids, scores = np.concatenate([self.ids[query], ids]), np.concatenate([self.scores[query], scores])
        order = np.lexsort((ids, -scores))[: self.k]
        self.ids[query], self.scores[query] = ids[order], scores[order]


def _block(best: _Best, queries: np.ndarray, tables, ids: np.ndarray, x: np.ndarray, codes: np.ndarray | None, keep: int) -> None:
    """Adds the best of a block of vectors of one length to those of each query of that length."""
    unit = _unit(x)
    columns = None if codes is None else codes.T.copy()
    for query, q in enumerate(queries):
        if columns is not None and len(ids) > keep:
            scores = np.zeros(len(ids), np.float32)
            for byte, code in zip(tables[query], columns, strict=True):
                scores += byte[code]
            cut = np.partition(scores, len(ids) - keep)[len(ids) - keep]
            near = np.flatnonzero(scores >= cut)
            exact = cosines(q, x[near])
            best.add(query, ids[near], exact)
            if cut + np.abs(scores[near] - exact).max() < best.scores[query, -1]:
                continue
        # the error leaves room for better ones, or there is nothing to choose from
        near = np.flatnonzero(unit @ (q / np.linalg.norm(q)) >= best.scores[query, -1] - _EPS)
        near = near[~np.isin(ids[near], best.ids[query][best.scores[query] > -np.inf])]
        best.add(query, ids[near], cosines(q, x[near]))


def _scan(quantisers, wave, k: int, keep: int):
    """asked, rep, score: of each query of the wave the k best classes that the task has met."""

    def run(batches):
        asked = {dims: (ids, x, quantisers.value[dims].tables(_unit(x)) if dims in quantisers.value else None) for dims, (ids, x) in wave.value.items()}
        best = {dims: _Best(len(ids), k) for dims, (ids, _, _) in asked.items()}

        def block(table: pa.Table) -> None:
            sizes = pc.binary_length(table.column("vector")).to_numpy() // 8
            for dims in np.unique(sizes):
                if int(dims) in asked:
                    own = pa.array(np.flatnonzero(sizes == dims))
                    _, x, tables = asked[int(dims)]
                    codes = None
                    if tables is not None:
                        codes = np.frombuffer(b"".join(table.column("codes").take(own).to_pylist()), np.uint8).reshape(len(own), -1)
                    _block(best[int(dims)], x, tables, table.column("rep").take(own).to_numpy(), matrix(table.column("vector").take(own)), codes, keep)

        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= DATA_BLOCK:
                block(pa.Table.from_batches(held))
                held, size = [], 0
        if size:
            block(pa.Table.from_batches(held))
        for dims, found in best.items():
            real = found.scores > -np.inf
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(asked[dims][0], real.sum(1))), pa.array(found.ids[real]), pa.array(found.scores[real])], names=["asked", "rep", "score"])

    return run


def _by_length(table: pa.Table) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    sizes, out = pc.binary_length(table.column("vector")).to_numpy() // 8, {}
    for dims in np.unique(sizes):
        own = pa.array(np.flatnonzero(sizes == dims))
        out[int(dims)] = table.column("rep").take(own).to_numpy(), matrix(table.column("vector").take(own))
    return out


def search(df: DataFrame, queries, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", rerank: int = RERANK) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest by cosine of each row for which ``queries`` (a condition on the
    column id) holds, among all other rows of vectors as long; ties go to the smaller id.

    Vectors that are null, empty or zero or hold null or non-finite components, and null ids take no part; of rows that
    share an id, the one whose vector's hash is smallest does; repeated rows count once. Vectors of several lengths are
    searched each among its own. A table without queries, or an empty one, gives no rows; other columns aren't read.
    Every class of equal vectors is coded and scanned by every class of queries: time grows with their product, while
    what is shuffled grows with the queries times the tasks.
    """
    spark = df.sparkSession
    stage = Staged(spark, "search")
    rows = stage.write(doubles(df, id_col, vector_col).where("vector is not null and id is not null"), "rows")
    keyed = stage.write(rows.groupBy("id").agg(F.min("key").alias("key")), "keyed")
    # of a class, as many ids as one answer can show besides the query's own; each task sends no more either
    first = keyed.withColumn("n", F.row_number().over(Window.partitionBy("key").orderBy("id"))).where(F.col("n") <= k + 1)
    members = first.groupBy("key").agg(F.sort_array(F.collect_list("id")).alias("ids")).withColumn("rep", F.col("ids")[0])
    members = stage.write(members, "members")
    vectors = rows.groupBy("key").agg(F.any_value("vector").alias("vector"))
    classes = stage.write(vectors.join(members.select("key", "rep"), "key").select("rep", "key", "vector"), "classes")
    asked = stage.write(keyed.where(queries).join(members.select("key", "rep"), "key").select("id", "rep"), "asked")
    by = stage.write(asked.select("rep").distinct().join(classes.select("rep", "vector"), "rep"), "queries")
    sample: dict[int, list[bytes]] = {}
    for r in classes.orderBy(F.xxhash64("rep")).limit(SAMPLE).select("vector").collect():
        sample.setdefault(len(r["vector"]) // 8, []).append(r["vector"])
    fitted = {dims: Quantiser(_unit(np.frombuffer(b"".join(v), np.float64).reshape(-1, dims))) for dims, v in sample.items() if len(v) >= 16}
    quantisers = spark.sparkContext.broadcast(fitted)  # no more than the sample has lengths
    sizes = classes.agg(F.count("*").alias("n"), F.sum(F.octet_length("vector")).alias("b")).first()
    coded = classes.select("rep", "vector").coalesce(max(1, -(-sizes["n"] // DATA_BLOCK)))  # full blocks
    coded = stage.write(coded.mapInArrow(trimmed(_coded(quantisers)), "rep long, vector binary, codes binary"), "coded")
    waves = -(-(by.agg(F.sum(F.octet_length("vector") + 8)).first()[0] or 0) // WAVE)
    near = spark.createDataFrame([], "asked long, rep long, score double")
    for w in range(waves):
        part = by.where(F.pmod(F.xxhash64("rep"), F.lit(waves)) == w).toArrow()  # about WAVE bytes
        wave = spark.sparkContext.broadcast(_by_length(part))
        found = coded.mapInArrow(trimmed(_scan(quantisers, wave, k + 1, rerank * k)), "asked long, rep long, score double")
        near = near.unionAll(stage.write(found, f"near-{w}"))
        wave.unpersist()
    top = near.withColumn("n", F.row_number().over(Window.partitionBy("asked").orderBy(F.desc("score"), "rep"))).where(F.col("n") <= k + 1)
    each = top.join(members.select("rep", "ids"), "rep").select("asked", F.explode("ids").alias("vec_id"), "score")
    lists = each.groupBy("asked").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("far"), "vec_id"))), 1, k + 1).alias("all"))
    lists = stage.write(lists, "lists")  # at most (k + 1) ** 2 entries before they are cut
    stage.drop("rows", "keyed", "classes", "queries", "coded", "members", *(f"near-{w}" for w in range(waves)))
    own = F.slice(F.filter("all", lambda x: x["vec_id"] != F.col("id")), 1, k)
    out = asked.join(lists.withColumnRenamed("asked", "rep"), "rep").select(F.col("id").alias("query_id"), F.posexplode(own).alias("at", "x"))
    return out.select("query_id", (F.col("at") + 1).alias("rank"), F.col("x.vec_id").alias("vec_id"), (-F.col("x.far")).alias("score"))


def op10_quantised_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest of every fiftieth embedding."""
    return search(embeddings(spark, sf_dir), F.col("id") % 50 == 0)
