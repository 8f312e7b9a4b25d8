import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from quillspark.llm.bpe import load
from quillspark.llm.packing import pack, plan


def best_fit(lengths, capacity):
    """Plain best fit by decreasing length: the number of sequences."""
    room = []
    for n in sorted(lengths, reverse=True):
        fits = [r for r in room if r >= n]
        if fits:
            room.remove(min(fits))
            room.append(min(fits) - n)
        else:
            room.append(capacity - n)
    return len(room)


@pytest.mark.parametrize("seed", range(30))
def test_plan_is_plain_best_fit(seed):
    rng = random.Random(seed)
    capacity = rng.choice([7, 20, 64])
    lengths = [rng.randint(1, capacity) for _ in range(rng.randrange(1, 300))]
    histogram = {n: lengths.count(n) for n in set(lengths)}
    slots = plan(histogram, capacity)
    used, taken = defaultdict(list), defaultdict(list)
    for length, rank, end, first, per, offset in slots:
        for r in range(rank, end):
            taken[length].append(r)
            used[first + (r - rank) // per].append((offset + (r - rank) % per * length, length))
    assert {n: sorted(ranks) for n, ranks in taken.items()} == {n: list(range(count)) for n, count in histogram.items()}
    assert len(used) == best_fit(lengths, capacity)
    for spans in used.values():
        at = 0
        for o, n in sorted(spans):
            assert o == at
            at += n
        assert at <= capacity


def test_plan_does_not_grow_with_counts():
    rng = random.Random(5)
    base = {n: rng.randint(1, 50) for n in range(1, 2049)}
    assert len(plan({n: 1000 * c for n, c in base.items()}, 2048)) < 3 * len(plan(base, 2048)) + 5000


ROWS = [(1, "hello world", "x"), (2, None, "x"), (3, "", "y"), (3, "", "y"), (4, "a b c d e f g h i j k l m n o p q r s t", None), (None, "null id", "z"), (5, "é ß <|endoftext|> " * 30, "z"), (6, "w " * 500, "q")]


def test_rows(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, length string").withColumn("part", F.lit(1))
    rows = pack(df, capacity=16).collect()
    tok, by = load(), defaultdict(list)
    for r in rows:
        by[r.doc_id].append(r)
    for key in (1, 2, 4, None, 5, 6):
        text = next(t for i, t, _ in ROWS if i == key) or ""
        ids, at = tok.encode(text, add_special_tokens=False).ids + [0], 0
        for k, r in enumerate(sorted(by[key], key=lambda r: r.piece)):
            assert (r.piece, r.start) == (k, at)
            assert k == 0 or r.length == 16
            assert r.ids_crc32 == zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids[at : at + r.length]))
            at += r.length
        assert at == len(ids)
    assert len(by[3]) == 2
    spans = defaultdict(list)
    for r in rows:
        spans[r.sequence_id].append((r.offset, r.length))
    for s in spans.values():
        at = 0
        for o, n in sorted(s):
            assert o == at
            at += n
        assert at <= 16
    assert len(spans) == best_fit([r.length for r in rows], 16)


def test_empty(spark):
    assert pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0
