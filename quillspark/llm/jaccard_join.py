"""Exact Jaccard self-join of shingle sets, by partitioning the universe.

Two sets of sizes r <= s with a Jaccard similarity of at least t percent differ in at most H = (r + s)(100 - t) /
(100 + t) elements. Sizes are cut into bands so that partners lie in the same or in neighbouring bands; a group is a
band with the next one, and has the largest H of its pairs. The universe of shingles is dealt by hash into segments.
Signatures are hashes of (group, segment, the set's elements there); sets of one signature are candidates, and
candidates are verified on their whole sets. The list of an empty segment would hold a share of all sets of the group,
so that each group takes one of two ways to find all partners:

* m = H + 1 + Z segments: partners agree on the whole of Z + 1 at least. A set with at most Z empty segments leaves
  these out, as one of those that agree isn't empty; only a set with more publishes them, and two such sets agree on
  published segments alone.
* m from (H + 1) / 2 to H + 1 segments, k = H + 1 - m of which have a threshold of one: by the pigeonhole principle
  partners differ in some segment by no more than its threshold. There a set publishes its elements without each one as
  well; the fewer and larger segments of small sets are seldom empty, and are all published.

Sets of a bucket become candidates of each other only if counts of their elements by hash differ by H at most, as the
sum of such differences is no larger than that of the sets; so sets that share a passage or an empty segment and little
else aren't led into one group, and groups stay near what is linked.

Allocation by cost: the way and the m with the least sum of signatures and of expected partners by empty segments, from
the number of sets in the group's bands.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrow import slices, texts_of, trimmed
from .components import components, forest
from .shingles import mix, shingle_sets
from .tables import Staged, documents

WIDTH, PERCENT = 3, 90
#: Sets, and elements, in a block of a group that is compared by pairs of blocks; text bytes hashed at once by a task;
#: signatures that a task combines before it sends them, and a signature's sets from which on it does; sets that it
#: remembers having met; rows of a bucket from which on all its sets are candidates, whatever their counts.
BLOCK, ELEMENTS = 1024, 1 << 19
_SLICE, _COMBINED, _OFTEN, _SEEN, _WHOLE = 2 << 20, 1_000_000, 4096, 200_000, 1 << 16
#: Stands among a bucket's sets for the word that it is whole.
_MARK = np.int64(-(2**63))
#: Counts of a set's elements by hash, of one byte each, up to sets of so many elements.
_COUNTS = ((64, 300), (256, 4000), (1024, 1 << 62))
#: What an expected partner by chance costs, in signatures: partners join whole groups, so that there should be far fewer
#: than one a set.
_PARTNER = 1000
#: Bits of the filter that keeps sets out of the exact join which no candidate group holds.
_FILTER_BITS = 26
_GROUP, _SEGMENT = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def band_starts(percent: int, largest: int) -> np.ndarray:
    starts = [1]
    while starts[-1] <= largest:
        starts.append(100 * starts[-1] // percent + 1)
    starts.append(100 * starts[-1] // percent + 1)
    return np.array(starts, np.int64)


def _beyond(mean: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Chances that a Poisson number of these means is larger than ``most``; 1 where that is well below the mean."""
    out = np.ones(len(mean))
    for i, (mu, z) in enumerate(zip(mean.tolist(), most.tolist())):
        if 0 < mu <= z + 1:
            first = math.exp((z + 1) * math.log(mu) - mu - math.lgamma(z + 2))
            out[i] = min(1.0, first * (1 + float(np.cumprod(mu / (z + 2 + np.arange(200))).sum())))
        elif mu == 0:
            out[i] = 0.0
    return out


class Allocation:
    """Size bands, and of each group the segments, how many of them have a threshold of one, and how many empty ones a
    set may leave out (-1: none); no segments where partners can only be equal. counts: sets by band, as far as known."""

    def __init__(self, percent: int, largest: int, counts: dict[int, int] | None = None):
        self.starts = band_starts(percent, largest)
        rows = []
        for k in range(len(self.starts) - 2):
            r = int(self.starts[k + 1]) - 1
            s = min(int(self.starts[k + 2]) - 1, 100 * r // percent)
            most = (r + s) * (100 - percent) // (100 + percent)
            sets = sum((counts or {}).get(band, 0) for band in (k, k + 1))
            rows.append(self._cheapest(most, int(self.starts[k]), sets) if most else (0, 0, -1))
        self.segments, self.ones, self.slack = np.array(rows, np.int64).reshape(-1, 3).T

    @staticmethod
    def _cheapest(most: int, size: int, sets: int) -> tuple[int, int, int]:
        empty = lambda m: (1 - 1 / m) ** size
        exact = np.unique(np.linspace(most + 1, 2 * most + 8, 60).astype(np.int64)).astype(float)
        p, slack = empty(exact), exact - most - 1
        left = _beyond(exact * p, slack)
        first = exact * (1 - p) + _PARTNER * sets * exact * (p * left) ** 2
        fewer = np.arange(-(-(most + 1) // 2), most + 1, dtype=float)
        second = fewer + (most + 1 - fewer) * size / fewer + _PARTNER * sets * fewer * empty(fewer) ** 2
        if len(fewer) and second.min() < first.min():
            m = int(fewer[np.argmin(second)])
            return m, most + 1 - m, -1
        m = int(exact[np.argmin(first)])
        return m, 0, m - most - 1

    def of(self, sizes: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, sizes, "right") - 1


def signatures(elements: np.ndarray, bounds: np.ndarray, plan: Allocation) -> tuple[np.ndarray, np.ndarray]:
    """Signatures of the sets, and the set that each is of."""
    sizes = np.diff(bounds)
    band, owner = plan.of(sizes), np.repeat(np.arange(len(sizes)), sizes)
    mixed, out, owners = mix(elements + _SEGMENT), [], []
    for group in (band - 1, band):
        there = (group >= 0) & (sizes > 0)
        m = np.where(there, plan.segments[np.clip(group, 0, None)], 0)
        ones, slack = (np.where(there, x[np.clip(group, 0, None)], 0) for x in (plan.ones, plan.slack))
        at = m[owner] > 0
        doc, own = owner[at], mixed[at]
        base = np.cumsum(m) - m
        segment = (elements[at] % m[doc].astype(np.uint64)).astype(np.int64)
        place = base[doc] + segment
        sums = np.zeros(int(m.sum()), np.uint64)
        np.add.at(sums, place, own)
        of = np.repeat(np.arange(len(sizes)), m)
        salt = mix(group[of].astype(np.uint64) * _GROUP + (np.arange(len(sums)) - base[of]).astype(np.uint64) * _SEGMENT + np.uint64(1))
        empty = np.bincount(place, minlength=len(sums)) == 0
        publish = ~empty | (np.bincount(of[empty], minlength=len(sizes)) > slack)[of]
        out.append(mix(sums + salt)[publish])
        owners.append(of[publish])
        near = segment < ones[doc]
        if near.any():
            out.append(mix(sums[place[near]] - own[near] + salt[place[near]]))
            owners.append(doc[near])
    return np.concatenate(out), np.concatenate(owners)


def _combined(held: list[tuple[np.ndarray, np.ndarray]], most: int) -> pa.RecordBatch:
    """A task's signatures with their sets. One that many sets of the task have is sent once, with a mark that its bucket
    is whole; these sets follow as pairs with the first under signatures of their own, marked too. So a signature has a bounded number of rows from each
    task, however frequent it is."""
    sig, cls = (np.concatenate(x) for x in zip(*held))
    order = np.lexsort((cls, sig))
    sig, cls = sig[order], cls[order]
    first = np.concatenate([[True], sig[1:] != sig[:-1]])
    starts = np.flatnonzero(first)
    sizes = np.diff(np.append(starts, len(sig)))
    often = np.repeat(sizes > most, sizes)
    centre = np.repeat(cls[starts], sizes)
    other = often & (centre != cls)
    pairs = np.unique(np.stack([centre[other], cls[other]]), axis=1)
    own = mix(pairs[0].view(np.uint64) * _GROUP + mix(pairs[1].view(np.uint64)))
    sent = ~often | first
    marked = np.concatenate([sig[often & first], own])
    sig = np.concatenate([sig[sent], own, own, marked]).view(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(sig), pa.array(np.concatenate([cls[sent], *pairs, np.full(len(marked), _MARK)]))], names=["sig", "cls"])


def _buckets(batches, columns: tuple[str, ...], most: int):
    """Over rows in order of (sig, cls), a table at a time: whole buckets, the places where each starts, and whether they
    are parts of one. The last of a table goes on in the next one, but a bucket of ``most`` rows is cut, and each part but
    the first starts with the first rows of all."""
    held, carried = None, False

    def found(table):
        sig = table.column("sig").to_numpy()
        starts = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]]))
        part = np.zeros(len(starts), bool)
        part[0] = carried
        return starts, part

    for batch in batches:
        table = pa.Table.from_batches([batch]).select(list(columns))
        held = table if held is None else pa.concat_tables([held, table]).combine_chunks()
        if not held.num_rows:
            continue
        starts, part = found(held)
        if len(starts) > 1:
            yield held.slice(0, int(starts[-1])), starts[:-1], part[:-1]
            held, carried = held.slice(int(starts[-1])), False
        if held.num_rows > most:
            yield held, np.array([0]), np.array([True])
            held, carried = held.slice(0, 2), True
    if held is not None and held.num_rows:
        yield held, *found(held)


def _shared():
    """The buckets of several sets, by what they hold rather than by signature: partners share many buckets, which often
    hold the same sets. Of a bucket that is cut, each part is one of its own."""

    def run(batches):
        for table, starts, cut in _buckets(batches, ("sig", "cls"), _WHOLE):
            cls = table.column("cls").to_numpy()
            # rows are in order of cls, so that repeats of a set stand together, and a mark comes first
            new = np.concatenate([[True], cls[1:] != cls[:-1]])
            new[starts] = True
            whole = (cls[starts] == _MARK) | cut
            new &= cls != _MARK
            sizes = np.diff(np.append(starts, len(cls)))
            held = np.add.reduceat(np.where(new, mix(cls.view(np.uint64) + _SEGMENT), np.uint64(0)), starts)
            held = mix(held + np.where(whole, _GROUP, np.uint64(0))).view(np.int64)
            keep = np.repeat(np.add.reduceat(new.astype(np.int64), starts) > 1, sizes) & new
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(held, sizes)[keep]), pa.array(cls[keep]), pa.array(np.repeat(whole, sizes)[keep])], names=["sig", "cls", "whole"])

    return run


def _alike(counts: np.ndarray, sizes: np.ndarray, percent: int) -> np.ndarray:
    """Of one bucket: the first set of the component that each is in by small enough differences of counts."""
    root, left = np.arange(len(sizes)), np.arange(len(sizes))
    while len(left):
        seed, left = left[0], left[1:]
        front = np.array([seed])
        while len(front) and len(left):
            hit = np.zeros(len(left), bool)
            step = max(1, (1 << 22) // (counts.shape[1] * len(left)))
            for at in range(0, len(front), step):
                some = front[at : at + step]
                apart = np.abs(counts[some][:, None] - counts[left][None]).sum(2, dtype=np.int64)
                hit |= (apart * (100 + percent) <= (sizes[some][:, None] + sizes[left][None]) * (100 - percent)).any(0)
            front, left = left[hit], left[~hit]
            root[front] = seed
    return root


class _Counts:
    """Counts of the rows of a table at a width: those with more are folded."""

    def __init__(self, column):
        self.rows = column.to_pylist()
        self.widths = np.fromiter(map(len, self.rows), np.int64, len(self.rows))
        self.made: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def at(self, rows: np.ndarray, width: int) -> np.ndarray:
        if width not in self.made:
            place, parts = np.full(len(self.rows), -1), []
            for own in np.unique(self.widths[self.widths >= width]):
                chosen = np.flatnonzero(self.widths == own)
                place[chosen] = np.arange(len(chosen)) + sum(map(len, parts))
                counts = np.frombuffer(b"".join(self.rows[k] for k in chosen.tolist()), np.uint8)
                parts.append(counts.reshape(len(chosen), -1, width).sum(1, dtype=np.int32))
            self.made[width] = place, np.concatenate(parts)
        place, counts = self.made[width]
        return counts[place[rows]]


def _candidates(percent: int):
    """Over rows (sig, cls, whole, n, counts) in order of (sig, cls): edges that join each bucket's candidates."""

    def run(batches):
        for table, starts, cut in _buckets(batches, ("sig", "cls", "whole", "n", "counts"), _WHOLE):
            cls, whole, sizes = (table.column(c).to_numpy() for c in ("cls", "whole", "n"))
            counts = _Counts(table.column("counts"))
            ends = np.append(starts[1:], len(cls))
            whole = whole | np.repeat(cut, ends - starts)
            pair = ends - starts == 2
            width = np.minimum.reduceat(counts.widths, starts)
            u, v = [], []
            for w in np.unique(width[pair]).tolist():
                a = starts[pair & (width == w)]
                apart = np.abs(counts.at(a, w) - counts.at(a + 1, w)).sum(1, dtype=np.int64)
                near = whole[a] | whole[a + 1] | (apart * (100 + percent) <= (sizes[a] + sizes[a + 1]) * (100 - percent))
                u.append(cls[a[near]]), v.append(cls[a[near] + 1])
            for a, b, w in zip(starts[~pair].tolist(), ends[~pair].tolist(), width[~pair].tolist()):
                root = np.zeros(b - a, np.int64) if whole[a:b].any() else _alike(counts.at(np.arange(a, b), w), sizes[a:b], percent)
                own = root != np.arange(b - a)
                u.append(cls[a + root[own]]), v.append(cls[a:b][own])
            if u:
                found = np.unique(np.stack([np.concatenate(u), np.concatenate(v)]), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(found[0]), pa.array(found[1])], names=["u", "v"])

    return run


def _links(sets: list[np.ndarray], first: np.ndarray, second: np.ndarray, percent: int) -> np.ndarray:
    """Whether each of the first sets is as similar as asked to each of the second, by exact counts."""
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    both = np.zeros((len(first), len(second)), np.float32)
    _, at, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(len(sets)), sizes)
    shared = counts[at] > 1  # what one set alone has is in no intersection
    column = np.cumsum(counts > 1)[at[shared]] - 1
    owner = owner[shared]
    order = np.argsort(column, kind="stable")
    column, owner = column[order], owner[order]
    for start in range(0, int(column[-1]) + 1 if len(column) else 0, 1024):
        lo, hi = np.searchsorted(column, [start, start + 1024])
        part = np.zeros((len(sets), min(1024, int(column[-1]) + 1 - start)), np.float32)
        part[owner[lo:hi], column[lo:hi] - start] = 1
        both += part[first] @ part[second].T
    linked = np.zeros(both.shape, bool)
    for at in range(0, len(first), 128):  # whole numbers, a few rows at a time
        rows = slice(at, at + 128)
        linked[rows] = (100 + percent) * both[rows].astype(np.int64) >= percent * (sizes[first[rows]][:, None] + sizes[second][None, :])
    return linked


def _compared(percent: int):
    """Over rows in order of (grp, i, j), each group of which holds two blocks at most: edges of linked sets."""

    def edges(table):
        ids, block = table.column("id").to_numpy(), table.column("block").to_numpy()
        sets = [np.frombuffer(e, np.uint64) for e in table.column("elements").to_pylist()]
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        first, second = np.flatnonzero(block == i), np.flatnonzero(block == j)
        if not len(first) or not len(second):
            return None
        u, v = forest(_links(sets, first, second, percent), first, second, len(sets))
        return pa.RecordBatch.from_arrays([pa.array(ids[u]), pa.array(ids[v])], names=["u", "v"]) if len(u) else None

    def run(batches):
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            if not held.num_rows:
                continue
            key = [held.column(c).to_numpy() for c in ("grp", "i", "j")]
            starts = np.flatnonzero(np.concatenate([[True], np.logical_or.reduce([k[1:] != k[:-1] for k in key])]))
            for a, b in zip(starts[:-1], starts[1:]):
                if (found := edges(held.slice(a, b - a))) is not None:
                    yield found
            held = held.slice(starts[-1])
        if held is not None and held.num_rows and (found := edges(held)) is not None:
            yield found

    return run


def _linked(groups: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Edges that join all linked sets of each group (columns id, set_hash, grp, n of groups; id, set_hash, elements of
    sets).

    A group of up to BLOCK sets and ELEMENTS elements is compared by one task. In a larger one, sets of a size band are
    dealt into blocks of about so many, and only blocks of the same or neighbouring bands meet, in pairs.
    """
    bands = band_starts(percent, 1 << 40).tolist()
    band = F.array_size(F.filter(F.array(*map(F.lit, bands)), lambda s: s <= F.col("n"))).cast("int")
    sized = groups.withColumn("band", band)
    counts = sized.groupBy("grp", "band").agg(F.count("*").alias("size"), F.sum("n").alias("elements"))
    parts = F.ceil(F.greatest(F.col("size") / BLOCK, F.col("elements") / ELEMENTS)).cast("int")
    blocks = counts.groupBy("grp").agg(F.sum("size").alias("all"), F.sum("elements").alias("wide"), F.map_from_entries(F.collect_list(F.struct("band", parts))).alias("blocks"))
    dealt = sized.join(blocks.where("all > 1"), "grp")
    whole = (F.col("all") <= BLOCK) & (F.col("wide") <= ELEMENTS)
    zero = F.lit(0).cast("long")
    small = dealt.where(whole).select("id", "set_hash", "grp", zero.alias("block"), zero.alias("i"), zero.alias("j"))
    large = dealt.where(~whole).withColumn("part", F.pmod(F.xxhash64("set_hash"), F.try_element_at("blocks", "band")).cast("int"))
    number = lambda band, part: band.cast("long") * (1 << 32) + part

    def of_band(near: int):
        band = F.col("band") + near
        numbers = F.transform(F.sequence(F.lit(0), F.try_element_at("blocks", band) - 1), lambda k: number(band, k))
        return F.coalesce(numbers, F.expr("cast(array() as array<bigint>)"))

    others = F.concat(*map(of_band, (-1, 0, 1)))
    own = number(F.col("band"), F.col("part"))
    large = large.select("id", "set_hash", "grp", own.alias("block"), F.explode(others).alias("other"))
    large = large.select("id", "set_hash", "grp", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    rows = small.unionAll(large).join(sets, ["id", "set_hash"]).select("grp", "i", "j", "id", "block", "elements")
    rows = rows.repartition("grp", "i", "j").sortWithinPartitions("grp", "i", "j")
    return rows.mapInArrow(trimmed(_compared(percent)), "u long, v long")


def _digests(elements: np.ndarray, bounds: np.ndarray) -> list[bytes | None]:
    """A set's hash; none for an empty one."""
    return [xxhash.xxh3_128_digest(elements[a:b].tobytes()) if b > a else None for a, b in zip(bounds[:-1], bounds[1:])]


def _counts(elements: np.ndarray, widths: tuple) -> bytes:
    width = next(w for w, most in widths if len(elements) <= most)
    found = np.bincount((elements >> np.uint64(40)).astype(np.int64) & (width - 1), minlength=width)
    return np.minimum(found, 255).astype(np.uint8).tobytes()


def _base(width: int):
    """Of each text its set's size, hash, the first half of the hash, and counts of elements by hash (255 at most)."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text", _SLICE):
                elements, bounds = shingle_sets(texts_of(part, "text"), width)
                digests = _digests(elements, bounds)
                halves = pa.array([None if d is None else int.from_bytes(d[:8], "little", signed=True) for d in digests], pa.int64())
                sizes = np.diff(bounds)
                counts = [_counts(elements[a:b], _COUNTS) for a, b in zip(bounds[:-1], bounds[1:])]
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(sizes), pa.array(digests, pa.binary()), halves, pa.array(counts, pa.binary())], names=["id", "n_shingles", "set_hash", "cls", "counts"])

    return run


def _signed(plan: Allocation, width: int):
    """Rows (sig, cls) of all sets, cls being the first half of the set's hash."""

    def run(batches):
        # sets that the task has met are left out; forgetting them now and then only repeats their signatures
        seen: set[bytes | None] = {None}
        held, size = [], 0
        for batch in batches:
            for part in slices(batch, "text", _SLICE):
                elements, bounds = shingle_sets(texts_of(part, "text"), width)
                if len(seen) > _SEEN:
                    seen = {None}
                digests = _digests(elements, bounds)
                new = [k for k, d in enumerate(digests) if d not in seen and not seen.add(d)]
                if not new:
                    continue
                elements = np.concatenate([elements[bounds[k] : bounds[k + 1]] for k in new])
                bounds = np.concatenate([[0], np.cumsum(np.diff(bounds)[new])])
                sig, of = signatures(elements, bounds, plan)
                if len(sig):
                    held.append((sig, np.frombuffer(b"".join(digests[k][:8] for k in new), np.int64)[of]))
                    size += len(sig)
                if size >= _COMBINED:
                    yield _combined(held, _OFTEN)
                    held, size = [], 0
        if held:
            yield _combined(held, _OFTEN)

    return run


def _in_groups(width: int, wanted):
    """Whole sets of the texts whose ids pass the filter; a task gives each once."""

    def run(batches):
        seen: set[tuple] = set()
        for batch in batches:
            batch = batch.filter(pa.array(passes(wanted.value, batch.column("id").to_numpy())))
            for part in slices(batch, "text", _SLICE):
                elements, bounds = shingle_sets(texts_of(part, "text"), width)
                if len(seen) > _SEEN:
                    seen = set()
                keys = list(zip(part.column("id").to_pylist(), _digests(elements, bounds), strict=True))
                new = [k for k, key in enumerate(keys) if key[1] and key not in seen and not seen.add(key)]
                ids, digests = [keys[k][0] for k in new], [keys[k][1] for k in new]
                each = [elements[bounds[k] : bounds[k + 1]].tobytes() for k in new]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(digests, pa.binary()), pa.array(each, pa.binary())], names=["id", "set_hash", "elements"])

    return run


def _bits(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    h = mix(ids.view(np.uint64) + np.uint64(1))
    mask = np.uint64((1 << _FILTER_BITS) - 1)
    return h & mask, (h >> np.uint64(32)) & mask


def passes(words: np.ndarray, ids: np.ndarray) -> np.ndarray:
    found = np.ones(len(ids), bool)
    for at in _bits(ids):
        found &= (words[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) > 0
    return found


def id_filter(ids: DataFrame) -> np.ndarray:
    """A Bloom filter of a long column id. Its size is fixed, and so is what reaches the driver; the more ids, the more
    others pass it, which the join after it takes out."""

    def run(batches):
        for batch in batches:
            at = np.concatenate(_bits(batch.column("id").to_numpy()))
            word, order = np.unique(at >> np.uint64(6), return_inverse=True)
            bits = np.zeros(len(word), np.uint64)
            np.bitwise_or.at(bits, order, np.uint64(1) << (at & np.uint64(63)))
            yield pa.RecordBatch.from_arrays([pa.array(word.astype(np.int64)), pa.array(bits.view(np.int64))], names=["word", "bits"])

    table = ids.mapInArrow(run, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toArrow()
    words = np.zeros((1 << _FILTER_BITS) // 64, np.uint64)
    words[table.column("word").to_numpy()] = table.column("bits").to_numpy().view(np.uint64)
    return words


def jaccard_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """One row per row: id, n_shingles, component_id, the smallest id reachable by links of the given similarity.

    Ids are integers; rows that share an id share a component. A null id gives a null component and links nothing; a
    null or empty text has no shingles and is linked with nothing. Repeated rows are kept, and the order of rows has no
    effect; a very long text is one set like any other; other columns aren't read; an empty table gives no rows.
    Shingles are compared by 64-bit hashes.

    Rows with equal sets become one class. A task publishes a frequent signature once, with the first class that has it,
    and edges from it to the others, so that no signature is frequent in the shuffle. Buckets are read in order of
    signature, in a stream. Each gives edges that join its candidates, whose components are the groups. A
    group's sets are compared by whole blocks, of which only edges that join what is linked come back: a group of near
    copies costs as many rows as it has members (times its blocks), not pairs, and no link between components is lost.
    """
    spark = df.sparkSession
    stage = Staged(spark, "jaccard")
    read = df.select(df[id_col].cast("long").alias("id"), df[text_col].alias("text"))
    base = stage.write(read.mapInArrow(trimmed(_base(width)), "id long, n_shingles long, set_hash binary, cls long, counts binary"), "base")
    classes = stage.write(base.where("set_hash is not null and id is not null").groupBy("set_hash").agg(F.min("id").alias("rep"), F.any_value("n_shingles").alias("n"), F.any_value("cls").alias("cls"), F.any_value("counts").alias("counts")), "classes")
    largest = classes.agg(F.max("n")).first()[0] or 1
    starts = band_starts(percent, largest).tolist()
    bands = classes.select((F.array_size(F.filter(F.array(*map(F.lit, starts)), lambda s: s <= F.col("n"))) - 1).alias("band"))
    counts = {r["band"]: r["sets"] for r in bands.groupBy("band").agg(F.count("*").alias("sets")).collect()}  # one row a band
    plan = Allocation(percent, largest, counts)
    dealt = read.where("id is not null").mapInArrow(trimmed(_signed(plan, width)), "sig long, cls long").repartition("sig").sortWithinPartitions("sig", "cls")
    shared = stage.write(dealt.mapInArrow(_shared(), "sig long, cls long, whole boolean").distinct(), "shared")
    counted = shared.join(classes.select("cls", "n", "counts"), "cls").select("sig", "cls", "whole", "n", "counts")
    near = counted.repartition("sig").sortWithinPartitions("sig", "cls").mapInArrow(trimmed(_candidates(percent)), "u long, v long")
    stars = stage.write(near, "stars")
    stage.drop("shared")
    found = components(stars, stage, "groups").toDF("cls", "grp")
    groups = stage.write(classes.join(found, "cls").select(F.col("rep").alias("id"), "set_hash", "grp", "n"), "groups")
    wanted = spark.sparkContext.broadcast(id_filter(groups.select("id")))  # of fixed size
    sets = read.where("id is not null").mapInArrow(trimmed(_in_groups(width, wanted)), "id long, set_hash binary, elements binary")
    edges = stage.write(_linked(groups, sets, percent), "edges")
    stage.drop("stars", "groups")
    labels = components(edges, stage, "components")
    stage.drop("edges")
    out = base.join(classes.select("set_hash", "rep"), "set_hash", "left").join(labels.select(F.col("node").alias("rep"), "component"), "rep", "left")
    return out.select(F.col("id").alias(id_col), "n_shingles", F.when(F.col("id").isNotNull(), F.coalesce("component", "rep", "id")).alias("component_id"))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents by three-word shingles and a similarity of 0.9."""
    return jaccard_components(documents(spark, sf_dir))
