"""A probabilistic suffix tree over words, and scores of texts under it.

States are contexts of one word or more, up to ORDERS. A context is a state if it is frequent and its next-symbol
distribution diverges from that of its longest suffix in the tree; the next symbol is predicted from the longest suffix
that is a state. Distributions are smoothed by absolute discounting: what the kept counts give up goes to the suffix's,
down to add-one counts of all words. The alphabet is the frequent words, the edges of a text, and one symbol for all
other words, which are told apart by their add-one counts; so a state's probabilities sum to one over all words.

Beyond ORDERS there are contexts of LONG symbols, at every place of a text that has so many before it. They are the
model's part that grows with the corpus: all of them are counted, and those that occur twice and diverge from their
suffix in the tree are states. As a state's probability of a symbol is that of its suffix times a factor that depends on
the two alone, a text's score is the tree's plus the factors' logarithms.

Long contexts are dealt by the rarest word in them, and what follows it. As neighbours mostly share these, texts are
sent as runs of a few contexts, as symbols, to the bucket that counts them, decides on states and scores the places.

A context is known by the place of its suffix among the frequent contexts one word shorter, and the word before that; a
context is frequent only if its suffix is, so that looking one up walks from the last word backwards and ends early.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrow import slices, texts_of, trimmed, words_of
from .language import held_out
from .shingles import mix
from .tables import Staged, documents

#: Least shares of the training tokens: of a word whose count is sent to all tasks (so at most 1 / KNOWN of them), of a
#: symbol of the alphabet, of a context, and of a context's next symbol that is kept. They bound the model's size.
KNOWN, SYMBOL, CONTEXT, ENTRY = 5e-7, 1e-5, 2e-5, 1e-6
#: Words in a context at most, a bound on the passes over the texts.
ORDERS = 4
#: Symbols in a long context (ORDERS at least), one in how many of them is used (every one; others are for tests), and how
#: often it and a successor must occur.
LONG, SPREAD, SUPPORT = 8, 1, 2
#: Buckets of long contexts at least, the training tokens of each beyond that, and the contexts counted at once.
BUCKETS, BUCKET_TOKENS, CHUNK = 256, 1 << 19, 1 << 20
#: Least divergence of a state from its suffix, in nats a symbol; the discount of a kept count.
DIVERGENCE, DISCOUNT = 0.1, 0.8
OTHER, BOS, END = 0, 1, 2
_SHIFT = np.int64(17)
#: The hash that stands for the end of a text; no word hashes to it but by chance of 2 ** -64.
_END_HASH = 0x454E44
_END_SYMBOL = np.int32(END).tobytes()
_RUNS = pa.schema([("bucket", pa.int32()), ("runs", pa.int32()), ("size", pa.int32()), ("data", pa.binary())])


def _coded(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of words, the hash of each distinct word, and the texts' places among the codes."""
    codes, items, offsets = words_of(texts)
    digest = xxhash.xxh3_64_intdigest
    return codes, np.fromiter((digest(w) for w in items.cast(pa.binary()).to_pylist()), np.uint64, len(items)).view(np.int64), offsets


def _count_words(batches):
    for batch in batches:
        for part in slices(batch, "text"):
            codes, hashes, offsets = _coded(texts_of(part, "text"))
            counts = np.bincount(codes, minlength=len(hashes))
            used = counts > 0
            yield pa.RecordBatch.from_arrays([pa.array(np.append(hashes[used], _END_HASH)), pa.array(np.append(counts[used], len(offsets) - 1))], names=["word", "n"])


class Words:
    """Counts of the frequent words, and symbols of the most frequent ones."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, tokens: int, distinct: int, symbol: float):
        order = np.argsort(hashes)
        self.hashes, self.counts = hashes[order], counts[order]
        self.tokens, self.distinct = tokens, distinct
        self.symbols = np.zeros(len(order), np.int64)
        chosen = np.flatnonzero((self.counts >= max(2, symbol * tokens)) & (self.hashes != _END_HASH))
        chosen = chosen[np.argsort(-self.counts[chosen], kind="stable")]
        self.symbols[chosen] = np.arange(3, 3 + len(chosen))
        # add-one probabilities by symbol; what is left is that of all other words, the unknown one included
        p = np.zeros(3 + len(chosen))
        p[3:] = self.base(self.counts[chosen])
        end = self.counts[self.hashes == _END_HASH]
        p[END] = self.base(end[0] if len(end) else 0)
        p[OTHER] = max(1e-300, 1 - p.sum())
        self.base_of_symbol = p

    def base(self, counts):
        return (counts + 1) / (self.tokens + self.distinct + 1)

    def look_up(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols, and counts, -1 where the word isn't among the frequent ones."""
        if not len(self.hashes):
            return np.zeros(len(hashes), np.int64), np.full(len(hashes), -1, np.int64)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        found = self.hashes[at] == hashes
        return np.where(found, self.symbols[at], OTHER), np.where(found, self.counts[at], -1)


def _sequence(tokens: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The texts' symbols with ORDERS starts before and an end after each; the places of tokens, words and ends."""
    n, pad = len(offsets) - 1, ORDERS + 1
    seq = np.full(len(tokens) + pad * n, BOS, np.int64)
    words = np.arange(len(tokens)) + ORDERS + pad * np.repeat(np.arange(n), np.diff(offsets))
    seq[words] = tokens
    ends = offsets[1:] + pad * np.arange(n) + ORDERS
    seq[ends] = END
    token = np.zeros(len(seq), bool)
    token[words] = token[ends] = True
    return seq, np.flatnonzero(token), words, ends


def _as_symbols(tokens: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Each text as the symbols of its words, four bytes each: what all later passes over the texts read."""
    data = tokens.astype(np.int32).tobytes()
    return pa.array([data[4 * a : 4 * b] for a, b in zip(offsets[:-1], offsets[1:])], pa.binary())


def _symbols(words):
    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                codes, hashes, offsets = _coded(texts_of(part, "text"))
                yield pa.RecordBatch.from_arrays([_as_symbols(words.value.look_up(hashes)[0].astype(np.int32)[codes], offsets)], names=["symbols"])

    return run


def _tokens(batch: pa.RecordBatch):
    """A batch in bounded parts, the symbols of each part's texts, and the texts' places among them."""
    for part in slices(batch, "symbols", 4 << 20):
        rows = part.column("symbols").to_pylist()
        offsets = np.concatenate([[0], np.cumsum([len(r) // 4 for r in rows])]).astype(np.int64)
        yield part, np.frombuffer(b"".join(rows), np.int32).astype(np.int64), offsets


def _in(sorted_keys: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places among the sorted keys, and whether each is there."""
    if not len(sorted_keys):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.minimum(np.searchsorted(sorted_keys, keys), len(sorted_keys) - 1)
    return at, sorted_keys[at] == keys


def _count_next(contexts):
    """Counts of (place of the context among the longest frequent ones, next symbol)."""

    def run(batches):
        for batch in batches:
            for _, tokens, offsets in _tokens(batch):
                seq, at, _, _ = _sequence(tokens, offsets)
                key, at = contexts.value.places(seq, at)
                pairs, counts = np.unique(key << _SHIFT | seq[at], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(pairs), pa.array(counts.astype(np.int64))], names=["pair", "n"])

    return run


class Contexts:
    """The frequent contexts of each order, as sorted keys."""

    def __init__(self):
        self.keys: list[np.ndarray] = []

    def step(self, order: int, place: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of contexts one word longer than those at ``place``, by the word before, and whether they are there."""
        return _in(self.keys[order], place << _SHIFT | symbol)

    def places(self, seq: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The places of the longest contexts before each token that has one, and those tokens."""
        place = np.zeros(len(at), np.int64)
        for order in range(len(self.keys)):
            place, there = self.step(order, place, seq[at - 1 - order])
            place, at = place[there], at[there]
        return place, at

    def of(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Keys of contexts given as rows of symbols, oldest first, and whether their suffixes are frequent."""
        place, alive = np.zeros(len(rows), np.int64), np.ones(len(rows), bool)
        for order in range(rows.shape[1] - 1):
            place, there = self.step(order, place, rows[:, -1 - order])
            alive &= there
        return place << _SHIFT | rows[:, 0], alive


class Tree:
    """The states of each order, by place among the frequent contexts, with their weights of the suffix, and the
    discounted probabilities of kept pairs."""

    def __init__(self, words: Words):
        self.words, self.contexts = words, Contexts()
        self.rows: list[np.ndarray] = []  # each order's contexts as symbols, only while the tree is made
        self.orders: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []

    def grow(self, rows: np.ndarray) -> bool:
        """Takes the frequent contexts of the next order; false if there are none."""
        keys, alive = self.contexts.of(rows)
        order = np.argsort(keys[alive])
        self.contexts.keys.append(keys[alive][order])
        self.rows.append(rows[alive][order])
        return len(order) > 0

    def add(self, places: np.ndarray, totals: np.ndarray, pairs: np.ndarray, counts: np.ndarray) -> None:
        """States of the order that was grown last: its contexts' tokens that follow, and the kept pairs (sorted)."""
        rows = self.rows[-1]
        total = np.zeros(len(rows))
        total[places] = totals
        of, symbol = pairs >> _SHIFT, pairs & ((1 << 17) - 1)
        p = (counts - DISCOUNT) / total[of] if len(of) else np.zeros(0)
        weight = 1 - np.bincount(of, p, len(rows))
        before = self.probability([rows[of, k] for k in range(rows.shape[1] - 1, 0, -1)], symbol)
        now = p + weight[of] * before
        gain = np.bincount(of, now * np.log(now / before), len(rows))
        lost = 1 - np.bincount(of, now, len(rows)), 1 - np.bincount(of, before, len(rows))
        rest = np.clip(lost[0], 1e-12, None) * np.log(np.clip(lost[0], 1e-12, None) / np.clip(lost[1], 1e-12, None))
        state = (gain + rest >= DIVERGENCE) & (total > 0)
        own = state[of]
        self.orders.append((state, weight, pairs[own], p[own]))

    def probability(self, history: list[np.ndarray], symbol: np.ndarray) -> np.ndarray:
        """That of a symbol after others, the last one first, from the longest suffix that is a state."""
        p = self.words.base_of_symbol[symbol]
        place, alive = np.zeros(len(p), np.int64), np.arange(len(p))
        for order, (before, (state, weight, pairs, own)) in enumerate(zip(history, self.orders)):
            place, there = self.contexts.step(order, place, before[alive])
            place, alive = place[there], alive[there]
            rows = np.flatnonzero(state[place])
            if len(rows):
                at, of = alive[rows], place[rows]
                pair, kept = _in(pairs, of << _SHIFT | symbol[at])
                p[at] = np.where(kept, own[pair] if len(own) else 0, 0) + weight[of] * p[at]
        return p


def _arrays(df: DataFrame, *columns: str) -> list[np.ndarray]:
    table = df.toArrow().sort_by(columns[0])
    return [table.column(c).to_numpy() for c in columns]


def train(df: DataFrame, text_col: str = "text", stage: Staged | None = None) -> tuple[Tree, DataFrame, DataFrame]:
    """The tree of all texts, the table of all words' counts (word, c), words as 64-bit hashes, and the texts as symbols.

    All counts are made over the whole corpus. Only those above the shares of the module's constants, whose number
    these bound, reach the driver and the tasks.
    """
    spark = df.sparkSession
    stage = stage or Staged(spark, "suffix-tree")
    read = df.select(df[text_col].alias("text"))
    words, counts = _words(read, stage)
    symbols = stage.write(read.mapInArrow(trimmed(_symbols(spark.sparkContext.broadcast(words))), "symbols binary"), "symbols")
    return _grown(symbols, words, stage), counts, symbols


def _words(read: DataFrame, stage: Staged) -> tuple[Words, DataFrame]:
    """The frequent words, and the table of all."""
    counts = stage.write(read.mapInArrow(_count_words, "word long, n long").groupBy("word").agg(F.sum("n").alias("c")).where("c > 0"), "words")
    total = counts.agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    tokens, distinct = total["n"] or 0, total["v"]
    known = _arrays(counts.where(F.col("c") >= KNOWN * tokens), "word", "c")
    return Words(*known, tokens, distinct, SYMBOL), counts


def _grown(symbols: DataFrame, words: Words, stage: Staged) -> Tree:
    """The tree of texts given as symbols."""
    spark, tokens, tree = symbols.sparkSession, words.tokens, Tree(words)
    least = max(2.0, CONTEXT * tokens)
    # single words by their add-one shares; a start is as frequent as an end
    share = np.maximum(words.base_of_symbol, (np.arange(len(words.base_of_symbol)) == BOS) * words.base_of_symbol[END])
    first = np.flatnonzero((share * tokens >= least) & (np.arange(len(share)) != END))
    rows = first[:, None]
    for order in range(1, ORDERS + 1):
        if not tree.grow(rows):
            break
        known = spark.sparkContext.broadcast(tree.contexts)
        pairs = symbols.mapInArrow(trimmed(_count_next(known)), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
        pairs = stage.write(pairs, f"pairs-{order}")
        follow = pairs.groupBy(F.shiftright("pair", int(_SHIFT)).alias("context")).agg(F.sum("n").alias("total"))
        tree.add(*_arrays(follow, "context", "total"), *_arrays(pairs.where(F.col("n") >= max(2.0, ENTRY * tokens)), "pair", "n"))
        longer = _arrays(pairs.where(F.col("n") >= least), "pair")[0]
        longer = longer[(longer & ((1 << 17) - 1)) != END]
        rows = np.concatenate([tree.rows[-1][longer >> _SHIFT], (longer & ((1 << 17) - 1))[:, None]], axis=1)
        stage.drop(f"pairs-{order}")
        known.unpersist()
    tree.rows = []
    return tree


def _sliding(join, x: np.ndarray, width: int) -> np.ndarray:
    """What ``join`` makes of each ``width`` neighbours."""
    done = 1
    while done < width:
        step = min(done, width - done)
        x, done = join(x[:-step], x[step:]), done + step
    return x


def _bytes_of(x: np.ndarray) -> bytes:
    """The numbers' first bytes, then their second ones, and so on, as these compress well."""
    return x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()


def _numbers_of(data, kind, at: int, n: int) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.frombuffer(data, np.uint8, n * size, at).reshape(size, n).T.copy().view(kind).ravel()


def _runs(buckets: int, long: int):
    """Runs of long contexts with the token after each, by bucket: for each its row and whether it counts, its number of
    contexts, and its symbols. A run over one symbol only is one context, and minus the times that it occurs."""

    def run(batches):
        for batch in batches:
            for part in slices(batch, "symbols", 4 << 20):
                texts = part.column("symbols").to_pylist()
                keys = np.where(part.column("row").is_null(), -1, part.column("row").fill_null(0).to_numpy() * 2 + part.column("learned").to_numpy(zero_copy_only=False))
                seq = np.frombuffer(b"".join(x + _END_SYMBOL for x in texts), np.int32)
                ends = np.cumsum([len(x) // 4 + 1 for x in texts])
                owner = np.repeat(np.arange(len(texts)), np.diff(ends, prepend=0))[: max(0, len(seq) - long)]
                at = np.flatnonzero(np.arange(len(owner)) + long < ends[owner])
                if not len(at):
                    continue
                rarest = _sliding(np.maximum, seq[:-1].astype(np.int64) << _SHIFT | seq[1:], long - 1)
                bucket = (mix(rarest.astype(np.uint64)) % np.uint64(buckets)).astype(np.int32)[at]
                same = _sliding(np.logical_and, seq[1:] == seq[:-1], long)[at]
                first = np.flatnonzero(np.concatenate([[True], (np.diff(at) != 1) | (np.diff(bucket) != 0) | (same[1:] != same[:-1])]))
                size = np.diff(np.append(first, len(at))).astype(np.int32)
                size = np.where(same[first], -size, size)
                order = np.argsort(bucket[first], kind="stable")
                first, size = first[order], size[order]
                begin, bucket = at[first], bucket[first]
                length = np.maximum(size, 1) + long
                stop = np.cumsum(length)
                symbols = seq[np.repeat(begin - stop + length, length) + np.arange(stop[-1])]
                row = keys[owner[begin]]
                found = np.flatnonzero(np.concatenate([[True], np.diff(bucket) != 0]))
                out = []
                for a, b in zip(found, np.append(found[1:], len(bucket))):
                    data = _bytes_of(np.diff(row[a:b], prepend=0)) + _bytes_of(size[a:b]) + _bytes_of(symbols[stop[a] - length[a] : stop[b - 1]])
                    out.append((int(bucket[a]), int(b - a), len(data), pa.compress(data, "zstd", asbytes=True)))
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out), _RUNS.types)], schema=_RUNS)

    return run


def _read_runs(chunk: list[tuple[int, int, bytes]], long: int, spread: int) -> tuple[np.ndarray, ...]:
    """The contexts of runs: their rows, whether they count, how often they occur there, their hashes, the places of the
    tokens after them, and the symbols."""
    rows, sizes, symbols = [], [], []
    for runs, size, data in chunk:
        data = pa.decompress(data, size, "zstd")
        rows.append(np.cumsum(_numbers_of(data, np.int64, 0, runs)))
        sizes.append(_numbers_of(data, np.int32, 8 * runs, runs))
        symbols.append(_numbers_of(data, np.int32, 12 * runs, (size - 12 * runs) // 4))
    rows, sizes, symbols = np.concatenate(rows), np.concatenate(sizes).astype(np.int64), np.concatenate(symbols)
    number = np.maximum(sizes, 1)
    stop = np.cumsum(number)
    at = np.arange(stop[-1]) + np.repeat(np.arange(len(number)) * long, number)
    mixed = mix(symbols.astype(np.uint64) + np.uint64(1))
    rolled = np.zeros(len(at), np.uint64)
    for k in range(long):
        rolled += mixed[at + k] * np.uint64(0x9E3779B97F4A7C15 + 2 * k * 0x2545F4914F6CDD1D & (1 << 64) - 1)
    rolled = mix(rolled)
    rows, times = np.repeat(rows, number), np.repeat(np.maximum(-sizes, 1), number)
    used = rolled % np.uint64(spread) == 0 if spread > 1 else slice(None)
    rows = rows[used]
    return rows >> 1, (rows & 1).astype(bool), times[used], rolled[used], at[used] + long, symbols


def _grouped(context: np.ndarray, symbol: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Equal pairs of a context and a symbol: the pair of each item, and for each pair an item, its context's number and its count."""
    order = np.argsort(context)
    sorted_ = context[order]
    pair = np.cumsum(np.concatenate([[False], sorted_[1:] != sorted_[:-1]])[: len(order)]) << _SHIFT | symbol[order]
    again = np.argsort(pair)
    order, pair = order[again], pair[again]
    new = np.diff(pair, prepend=-1) != 0
    of = np.empty(len(order), np.int64)
    of[order] = np.cumsum(new) - 1
    return of, order[new], pair[new] >> _SHIFT, np.bincount(of, n)


def _factors(tree: Tree, context: np.ndarray, n: np.ndarray, history: np.ndarray, symbol: np.ndarray) -> np.ndarray:
    """The logarithm of each pair's factor, zero where its context is no state; contexts are numbered in order."""
    total = np.bincount(context, n)
    kept = np.flatnonzero(n >= SUPPORT)
    of, n = context[kept], n[kept]
    left = 1 - np.bincount(of, n - DISCOUNT, len(total)) / np.maximum(total, 1)
    p = tree.probability(list(history[kept].T), symbol[kept])
    now = (n - DISCOUNT) / total[of] + left[of] * p
    gain = np.log(now / p)
    apart = np.bincount(of, now * gain, len(total)) + left * (1 - np.bincount(of, p, len(total))) * np.log(left)
    state = (apart >= DIVERGENCE) & (np.bincount(of, minlength=len(total)) > 0)
    factor = np.log(left)[context]
    factor[kept] = gain
    return np.where(state[context], factor, 0) / np.log(10)


def _bucket_gains(tree: Tree, blobs: list[tuple[int, int, bytes]], long: int, spread: int, chunk_size: int) -> pa.RecordBatch:
    """What a bucket's contexts add to the scores of rows; if there are more than about ``chunk_size``, they are counted in
    turns, and read again once all are."""
    chunks, held = [[]], 0
    for blob in blobs:
        if held and held + blob[1] > 12 * chunk_size:
            chunks, held = [*chunks, []], 0
        chunks[-1].append(blob)
        held += blob[1]

    def counted(chunk):
        rows, counts, times, context, after, symbols = _read_runs(chunk, long, spread)
        pair, item, number, n = _grouped(context, symbols[after], times * counts)
        return rows, times, pair, (context[item], symbols[after[item]], n, symbols[after[item][:, None] - np.arange(1, ORDERS + 1)], number)

    kept = [counted(chunk) for chunk in chunks] if len(chunks) == 1 else None
    if kept:
        _, symbol, n, history, number = kept[0][3]
        pairs = [np.arange(len(n))]
    else:
        distinct = [counted(chunk)[3] for chunk in chunks]
        context, symbol, n, history = (np.concatenate([x[k] for x in distinct]) for k in range(4))
        pair, item, number, n = _grouped(context, symbol, n)
        symbol, history = symbol[item], history[item]
        pairs = np.split(pair, np.cumsum([len(x[1]) for x in distinct])[:-1])
    factor = _factors(tree, number, n, history, symbol)
    out = []
    for k, own in enumerate(pairs):
        rows, times, pair, _ = kept[k] if kept else counted(chunks[k])
        gained = factor[own[pair]] * times
        used = np.flatnonzero((gained != 0) & (rows >= 0))
        row, of = np.unique(rows[used], return_inverse=True)
        out.append((row, np.bincount(of, gained[used], len(row))))
    row, gained = (np.concatenate(x) for x in zip(*out))
    return pa.RecordBatch.from_arrays([pa.array(row), pa.array(gained, pa.float64())], names=["row", "gained"])


def _gains(tree, long: int, spread: int, chunk_size: int):
    def run(batches):
        bucket, blobs = None, []
        for batch in batches:
            for own, *blob in zip(*(batch.column(name).to_pylist() for name in _RUNS.names)):
                if own != bucket and blobs:
                    yield _bucket_gains(tree.value, blobs, long, spread, chunk_size)
                    blobs = []
                bucket = own
                blobs.append(blob)
        if blobs:
            yield _bucket_gains(tree.value, blobs, long, spread, chunk_size)

    return run


def long_states(symbols: DataFrame, tree: Tree) -> DataFrame:
    """The training texts, as ``train`` gives these in symbols, as those whose long contexts ``score`` counts."""
    return symbols.select(F.lit(None).cast("long").alias("row"), "symbols", F.lit(True).alias("learned"))


def _long_gains(texts: DataFrame, tree: Tree) -> DataFrame:
    """(row, gained): what long contexts add to the scores of texts (row, symbols, learned), those learned being counted."""
    spark = texts.sparkSession
    sent, buckets = spark.sparkContext.broadcast(tree), max(BUCKETS, tree.words.tokens // BUCKET_TOKENS)
    runs = texts.mapInArrow(trimmed(_runs(buckets, LONG)), "bucket int, runs int, size int, data binary")
    # as many buckets in each task, which a hash of their numbers wouldn't give
    tasks = min(buckets, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = runs.repartitionById(tasks, F.col("bucket") % tasks).sortWithinPartitions("bucket")
    return dealt.mapInArrow(trimmed(_gains(sent, LONG, SPREAD, CHUNK)), "row long, gained double").groupBy("row").agg(F.sum("gained").alias("gained"))


def _read(words):
    """Of each text all that the words alone decide, and the text as symbols."""

    def run(batches):
        part, row = TaskContext.get().partitionId(), 0
        for batch in batches:
            for rows in slices(batch, "text"):
                w = words.value
                codes, hashes, offsets = _coded(texts_of(rows, "text"))
                symbols, counts = w.look_up(hashes)
                tokens, count = symbols[codes], counts[codes]
                n = len(offsets) - 1
                owner = np.repeat(np.arange(n), np.diff(offsets))
                base = np.where(counts >= 0, np.log10(w.base(np.maximum(counts, 0))), 0)[codes]
                # a word outside the alphabet: its share of the symbol for all of them
                other = np.where(tokens == OTHER, base - np.log10(w.base_of_symbol[OTHER]), 0)
                known = np.bincount(owner[count >= 0], minlength=n) + int(w.base_of_symbol[END] > w.base(0))
                # words that aren't among the frequent ones are left to a join, once for each text
                rare = np.flatnonzero(count < 0)
                keys, times = np.unique(owner[rare] * np.int64(len(hashes) + 1) + codes[rare], return_counts=True)
                of, code = keys // (len(hashes) + 1), keys % (len(hashes) + 1)
                at_list = np.searchsorted(of, np.arange(len(offsets)))
                rare_lists = pa.ListArray.from_arrays(pa.array(at_list.astype(np.int32)), pa.StructArray.from_arrays([pa.array(hashes[code]), pa.array(times.astype(np.int64))], names=["word", "times"]))
                ids = pa.array((np.int64(part) << np.int64(40)) + row + np.arange(n))
                row += n
                sums = [pa.array(np.bincount(owner, x, n) + end, pa.float64()) for x, end in ((base, np.log10(w.base_of_symbol[END])), (other, 0))]
                yield pa.RecordBatch.from_arrays(
                    [rows.column("id"), rows.column("learned"), ids, pa.array(np.diff(offsets) + 1), pa.array(known.astype(np.int64)), *sums, rare_lists, _as_symbols(tokens, offsets)], names=["id", "learned", "row", "n_tokens", "n_known", "base", "other", "rare", "symbols"]
                )

    return run


def _scores(tree):
    """The tree's score of each text's symbols, in their place."""

    def run(batches):
        for batch in batches:
            for part, tokens, offsets in _tokens(batch):
                seq, at, _, ends = _sequence(tokens, offsets)
                model = np.zeros(len(seq))
                model[at] = np.log10(tree.value.probability([seq[at - k] for k in range(1, ORDERS + 1)], seq[at]))
                sums = np.add.reduceat(model, np.concatenate([[0], ends[:-1] + 1]))
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(sums)], names=[*part.schema.names[:-1], "model"])

    return run


def score(df: DataFrame, tree: Tree, counts: DataFrame, long: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", stage: Staged | None = None, learned: Column | None = None) -> DataFrame:
    """One row per row: id, n_tokens, n_known, train_tokens, base_score, score (both log10).

    A null text counts as empty: its one token is the end. Null ids and repeated rows are kept; other columns aren't
    read; very long texts are read whole; an empty table gives no rows, and an empty training table gives all words the
    same share. Ties between counts have no effect, as thresholds take all of them or none.

    Frequent words are scored in the task; the others' counts come by a join on the word, of which no key is frequent.
    Long contexts are counted in the texts of ``long`` (from ``long_states``) and in the rows where ``learned`` holds, so
    that training texts which are scored too are sent once; without either the tree alone is asked.
    """
    stage = stage or Staged(df.sparkSession, "scores")
    counted = F.lit(False) if learned is None else F.coalesce(learned, F.lit(False))
    texts = _texts(df.select(df[id_col].alias("id"), df[text_col].alias("text"), counted.alias("learned")), tree.words, stage)
    deep = None if long is None and learned is None else texts.select("row", "symbols", "learned")
    return _scored(texts, tree, counts, deep if long is None else deep.unionByName(long), id_col)


def _texts(read: DataFrame, words: Words, stage: Staged) -> DataFrame:
    """Texts (id, text, learned) as ``_read`` gives them."""
    id_type = read.schema["id"].dataType.simpleString()
    schema = f"id {id_type}, learned boolean, row long, n_tokens long, n_known long, base double, other double, rare array<struct<word:bigint,times:bigint>>, symbols binary"
    return stage.write(read.mapInArrow(trimmed(_read(read.sparkSession.sparkContext.broadcast(words))), schema), "texts")


def _scored(texts: DataFrame, tree: Tree, counts: DataFrame, deep: DataFrame | None, id_col: str) -> DataFrame:
    """The rows of ``score`` for texts as ``_texts`` gives them; ``deep`` are these and others for long contexts, or none."""
    w = tree.words
    rare = texts.select("row", F.explode("rare").alias("r")).select("row", "r.word", "r.times")
    joined = rare.join(counts, "word", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    rest = joined.groupBy("row").agg(F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("more"), F.sum(F.col("times") * F.log10((F.col("c") + 1) / F.lit(float(w.tokens + w.distinct + 1)))).alias("log"), F.sum("times").alias("times"))
    read = texts.select("id", "row", "n_tokens", "n_known", "base", "other", "symbols")
    schema = ", ".join(f"{c} {kind}" for c, kind in read.dtypes[:-1]) + ", model double"
    out = read.mapInArrow(trimmed(_scores(texts.sparkSession.sparkContext.broadcast(tree))), schema)
    out = out.join(rest, "row", "left").withColumn("log", F.coalesce("log", F.lit(0.0)))
    gained = F.lit(0.0)
    if deep is not None:
        out, gained = out.join(_long_gains(deep, tree), "row", "left"), F.coalesce("gained", F.lit(0.0))
    return out.select(
        F.col("id").alias(id_col),
        "n_tokens",
        (F.col("n_known") + F.coalesce("more", F.lit(0))).alias("n_known"),
        F.lit(int(w.tokens)).cast("long").alias("train_tokens"),
        (F.col("base") + F.col("log")).alias("base_score"),
        (F.col("model") + F.col("other") + F.col("log") + gained).alias("score"),
    )


def op4_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents under a tree of six sevenths of them."""
    docs = documents(spark, sf_dir)
    learned = ~held_out(F.col("doc_id"), 7, 2)
    stage = Staged(spark, "suffix-tree")
    words, counts = _words(docs.where(learned).select("text"), stage)
    # each text is read once for the training and the scores
    texts = _texts(docs.select(F.col("doc_id").alias("id"), "text", F.coalesce(learned, F.lit(False)).alias("learned")), words, stage)
    tree = _grown(texts.where("learned").select("symbols"), words, stage)
    out = _scored(texts, tree, counts, texts.select("row", "symbols", "learned"), "doc_id")
    out = out.withColumn("held_out", F.coalesce(held_out(F.col("doc_id"), 7, 2), F.lit(False)))
    gain = (F.col("score") - F.col("base_score")) / F.col("n_tokens")
    return out.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", gain.alias("gain_per_token"))
