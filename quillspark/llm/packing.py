"""Best-fit packing of token sequences, planned on counts of lengths.

The histogram of piece lengths has at most one row for each length up to the capacity, whatever the corpus. On it the
driver plans best fit by decreasing length, a group of equal sequences at a time; each length gets ranges of ranks
with the slots that they take. A piece then finds its slot by a join on its rank among the pieces of its length.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .arrow import slices, texts_of, trimmed
from .bpe import id_encoder
from .tables import Staged, documents

VOCABULARY = "byte_bpe_50k.json"
CAPACITY = 2048


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best fit by decreasing length over counts: (length, first rank, end rank, first sequence, per sequence, offset).

    Rank r of a range sits in sequence first + (r - rank) // per, at offset + (r - rank) % per * length. Sequences of
    equal room are kept as runs (first, count); each is left by at most one range and a remainder, so that the plan's
    size depends on the capacity alone.
    """
    room: dict[int, list[tuple[int, int]]] = {}
    open_rooms: list[int] = []
    slots, sequences = [], 0

    def put(left: int, first: int, count: int) -> None:
        if left and count:
            if left not in room:
                room[left] = []
                insort(open_rooms, left)
            room[left].append((first, count))

    for length in sorted(histogram, reverse=True):
        n, rank = histogram[length], 0
        while rank < n:
            at = bisect_left(open_rooms, length)
            if at == len(open_rooms):
                per = capacity // length
                left, first, count = capacity, sequences, -(-(n - rank) // per)
                sequences += count
            else:
                left = open_rooms[at]
                first, count = room[left].pop()
                if not room[left]:
                    del room[left], open_rooms[at]
                per = left // length
            full = min(count, (n - rank) // per)
            offset = capacity - left
            if full:
                slots.append((length, rank, rank + full * per, first, per, offset))
                rank += full * per
                put(left - per * length, first, full)
            if rank < n and full < count:
                rest = n - rank  # fewer than a sequence takes
                slots.append((length, rank, n, first + full, per, offset))
                put(left - rest * length, first + full, 1)
                full, rank = full + 1, n
            put(left, first + full, count - full)
    return slots


def pieces(df: DataFrame, id_col: str, text_col: str, capacity: int, vocabulary: str) -> DataFrame:
    """Every text's pieces: the first holds what the others, of full capacity, leave. part and local_rank number the
    pieces of a length within the task that made them; they are fixed once this is written."""
    schema = f"id {df.schema[id_col].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long, part int, local_rank long"

    def cut(batches):
        encoder, part, seen = id_encoder(vocabulary), TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            for rows in slices(batch, "text"):
                which, piece, start, length, crc, rank = [], [], [], [], [], []
                for i, ids in enumerate(encoder.encode(texts_of(rows, "text"))):
                    data, n = ids.astype("<u4").tobytes() + b"\0\0\0\0", len(ids) + 1
                    at, k, end = 0, 0, (n - 1) % capacity + 1
                    while at < n:
                        which.append(i), piece.append(k), start.append(at), length.append(end - at)
                        crc.append(zlib.crc32(data[4 * at : 4 * end]))
                        rank.append(seen[end - at])
                        seen[end - at] += 1
                        at, end, k = end, end + capacity, k + 1
                yield pa.RecordBatch.from_arrays(
                    [rows.column("id").take(pa.array(which, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array([part] * len(which), pa.int32()), pa.array(rank, pa.int64())],
                    names=["id", "piece", "start", "length", "ids_crc32", "part", "local_rank"],
                )

    return df.select(df[id_col].alias("id"), df[text_col].alias("text")).mapInArrow(trimmed(cut), schema)


def pack(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, vocabulary: str = VOCABULARY) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text is one piece, the end token alone; a null id is kept; repeated rows are packed one by one;
    ties of length go by the order of the rows; other columns are not read. An empty table gives no rows.

    The pieces (about 40 bytes each) are written once; the histogram and the ranks come from that table. A rank is the
    place within the task plus the counts of earlier tasks, so that no length, however common, meets in one task.
    """
    spark = df.sparkSession
    table = Staged(spark, "packing").write(pieces(df, id_col, text_col, capacity, vocabulary), "pieces")
    counts = table.groupBy("part", "length").agg(F.count("*").alias("n"))
    histogram = {r["length"]: r["n"] for r in table.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most ``capacity`` rows
    slots = plan(histogram, capacity)
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))).drop("n")
    ranked = table.join(before, ["part", "length"]).withColumn("rank", F.col("before") + F.col("local_rank"))
    # the plan's rows depend on the capacity alone
    taken = F.broadcast(spark.createDataFrame(slots, "length long, first_rank long, end_rank long, first long, per long, place long"))
    within = F.col("rank") - F.col("first_rank")
    placed = ranked.join(taken, "length").where((F.col("rank") >= F.col("first_rank")) & (F.col("rank") < F.col("end_rank")))
    return placed.select(F.col("id").alias(id_col), "piece", "start", "length", "ids_crc32", (F.col("first") + F.floor(within / F.col("per"))).alias("sequence_id"), (F.col("place") + F.pmod(within, "per") * F.col("length")).alias("offset"))


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 2048 tokens."""
    return pack(documents(spark, sf_dir))
