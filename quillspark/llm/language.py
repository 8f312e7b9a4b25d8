"""Language identification with bit-sliced Bloom filters of character n-grams.

Each language's n-grams are put into a Bloom filter; the filters share their hash functions and are
stored slice by slice, so that a position of the table holds one bit per language, and the conjunction of an n-gram's
positions is the set of all languages that may contain it. A text's popcounts per language, less the false positives
that each filter's fill predicts, decide.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrow import only, slices, texts_of, trimmed
from .shingles import mix
from .tables import Staged, documents

#: n-gram lengths, and the least share of a language's n-grams that one needs to be in its filter: rarer ones are noise
#: (names, slips, words of other languages), and at most 1 / SHARE stay for each language.
ORDERS, SHARE = (3, 4), 1e-5
#: Hash functions, and bits of a filter for each n-gram of the language with the most.
HASHES, BITS = 3, 12
UNKNOWN = "und"
#: Code points handled at once.
_PIECE = 1 << 20
_SLICE = 2 << 20


def _letters() -> np.ndarray:
    """The lower-case form of each letter's code point, 0 for all others."""
    return only(("letters",), _letter_table)


def _letter_table() -> np.ndarray:
    table = np.zeros(0x110000, np.uint32)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            low = c.lower()
            table[i] = ord(low) if len(low) == 1 else i
    return table


def pieces(texts: list[str]):
    """Arrays of letters with 0 for anything else and around each text, with the bounds of the texts or text parts in
    them, whose texts they are, and how many n-grams may start there."""
    table, group, owners, size = _letters(), [], [], 0
    edge = np.zeros(1, np.uint32)
    for k, text in enumerate(texts):
        codes = np.concatenate([edge, table[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)], edge])
        if len(codes) > _PIECE:
            for start in range(0, len(codes), _PIECE):
                part = codes[start : start + _PIECE + max(ORDERS) - 1]
                yield part, np.array([0]), [k], min(_PIECE, len(codes) - start)
            continue
        group.append(codes)
        owners.append(k)
        size += len(codes)
        if size > _PIECE:
            yield _joined(group, owners)
            group, owners, size = [], [], 0
    if group:
        yield _joined(group, owners)


def _joined(group, owners):
    sizes = np.fromiter(map(len, group), np.int64, len(group))
    return np.concatenate(group), np.cumsum(sizes) - sizes, owners, int(sizes.sum())


def ngrams(codes: np.ndarray, starts: int):
    """For each order: the hashes of the n-grams by place, and which are ones, namely letters with at most an edge of
    the word at either end."""
    wide, letter = codes.astype(np.uint64), codes > 0
    for n in ORDERS:
        m = min(starts, len(codes) - n + 1)
        if m <= 0:
            continue
        h = np.full(m, n, np.uint64)
        for k in range(n):
            h = h * np.uint64(0x9E3779B97F4A7C15) + wide[k : k + m]
        valid = letter[1 : 1 + m].copy()
        for k in range(2, n - 1):
            valid &= letter[k : k + m]
        yield mix(h), valid


def _counted(batches):
    """Rows (lang, gram, n) of a task, counted in the task."""
    held: dict[str, list] = {}
    size = 0

    def merged(parts):
        grams, counts = (np.concatenate(x) for x in zip(*parts))
        order = np.argsort(grams, kind="stable")
        grams, counts = grams[order], counts[order]
        first = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]]))
        return grams[first], np.add.reduceat(counts, first)

    def rows():
        for lang, parts in held.items():
            grams, counts = merged(parts)
            for a in range(0, len(grams), 1 << 16):
                g, c = grams[a : a + (1 << 16)], counts[a : a + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(g)), pa.array(g.view(np.int64)), pa.array(c)], names=["lang", "gram", "n"])

    for batch in batches:
        for part in slices(batch, "text", _SLICE):
            by: dict[str, list[str]] = {}
            for text, lang in zip(texts_of(part, "text").to_pylist(), part.column("lang").to_pylist(), strict=True):
                by.setdefault(lang, []).append(text)
            for lang, texts in by.items():
                for codes, _, _, starts in pieces(texts):
                    for h, valid in ngrams(codes, starts):
                        grams, counts = np.unique(h[valid], return_counts=True)
                        if len(grams):
                            held.setdefault(lang, []).append((grams, counts.astype(np.int64)))
                            size += len(grams)
                if lang in held and len(held[lang]) > 16:
                    size -= sum(len(g) for g, _ in held[lang])
                    held[lang] = [merged(held[lang])]
                    size += len(held[lang][0][0])
        if size > 3_000_000:
            yield from rows()
            held, size = {}, 0
    yield from rows()


class Filters:
    """The bit-sliced table: words of 64 languages per position."""

    def __init__(self, languages: list[str], grams: list[tuple[int, int]], prior: list[int]):
        """grams: (language's number, n-gram)."""
        self.languages = languages
        of = np.array([g for g, _ in grams], np.int64)
        h = np.array([g for _, g in grams], np.int64).view(np.uint64)
        most = int(np.bincount(of, minlength=1).max()) if len(of) else 1
        self.mask = np.uint64((1 << max(10, (BITS * most - 1).bit_length())) - 1)
        self.table = np.zeros((max(1, -(-len(languages) // 64)), int(self.mask) + 1), np.uint64)
        for place in self.places(h):
            for word in range(len(self.table)):
                own = of // 64 == word
                np.bitwise_or.at(self.table[word], place[own], np.uint64(1) << (of[own] % 64).astype(np.uint64))
        fill = np.array([np.mean((self.table[k // 64] >> np.uint64(k % 64)) & np.uint64(1)) for k in range(len(languages))])
        self.false = np.minimum(fill**HASHES, 0.99)
        self.likeliest = max(range(len(languages)), key=lambda k: (prior[k], -k), default=None)

    def places(self, h: np.ndarray):
        step = (h >> np.uint64(33)) | np.uint64(1)
        for k in range(HASHES):
            yield ((h + np.uint64(k) * step) & self.mask).astype(np.int64)

    def hits(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each text: n-grams, those that each language's filter holds, and whether it has a letter."""
        total, hits, lettered = np.zeros(len(texts)), np.zeros((len(texts), len(self.languages))), np.zeros(len(texts), bool)
        for codes, bounds, owners, starts in pieces(texts):
            np.logical_or.at(lettered, owners, np.add.reduceat((codes[:starts] > 0).astype(np.int64), bounds) > 0)
            for h, valid in ngrams(codes, starts):
                first = np.searchsorted(np.flatnonzero(valid), np.minimum(bounds, len(valid)))
                h = h[valid]
                ends = np.concatenate([first[1:], [len(h)]])
                np.add.at(total, owners, ends - first)
                for word, table in enumerate(self.table):
                    bits = ~np.uint64(0)
                    for place in self.places(h):
                        bits = bits & table[place]
                    for k in range(64 * word, min(64 * word + 64, len(self.languages))):
                        sums = np.concatenate([[0], np.cumsum((bits >> np.uint64(k % 64)) & np.uint64(1), dtype=np.int64)]) if len(h) else np.zeros(1, np.int64)
                        np.add.at(hits[:, k], owners, sums[ends] - sums[first])
        return total, hits, lettered

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Languages, scores, and the share of n-grams that the language holds."""
        total, hits, lettered = self.hits(texts)
        names, scores, shares = [], np.zeros(len(texts)), np.zeros(len(texts))
        true = np.clip((hits - total[:, None] * self.false) / (1 - self.false), 0, None)
        for i in range(len(texts)):
            if not lettered[i] or not self.languages:
                names.append(UNKNOWN)
                continue
            ranked = np.argsort(-true[i], kind="stable")
            best = ranked[0] if true[i, ranked[0]] > 0 else self.likeliest
            names.append(self.languages[best])
            if true[i, best] > 0:
                second = true[i, ranked[1]] if len(ranked) > 1 else 0.0
                scores[i] = true[i, best] / (true[i, best] + second)
                shares[i] = min(1.0, true[i, best] / total[i])
        return names, scores, shares


def train(df: DataFrame, text_col: str = "text", lang_col: str = "lang", share: float = SHARE) -> Filters:
    """Filters of all rows with a language: an n-gram's counts are summed over the cluster; those with at least ``share``
    of a language's n-grams (so at most 1 / share for each language) reach the driver and go into its filter, whatever
    other languages have them too."""
    read = df.where(df[lang_col].isNotNull() & df[text_col].isNotNull()).select(df[text_col].alias("text"), df[lang_col].cast("string").alias("lang"))
    stage = Staged(df.sparkSession, "language")
    counts = read.mapInArrow(trimmed(_counted), "lang string, gram long, n long").groupBy("gram", "lang").agg(F.sum("n").alias("n"))
    counts = stage.write(counts, "counts")
    totals = {r["lang"]: r["total"] for r in counts.groupBy("lang").agg(F.sum("n").alias("total")).collect()}
    languages = sorted(totals)
    if not languages:
        stage.drop()
        return Filters([], [], [])
    kept = counts.join(F.broadcast(df.sparkSession.createDataFrame(list(totals.items()), "lang string, total long")), "lang").where(F.col("n") >= share * F.col("total"))
    number = {lang: k for k, lang in enumerate(languages)}
    grams = [(number[r["lang"]], r["gram"]) for r in kept.select("lang", "gram").toLocalIterator()]
    stage.drop()
    return Filters(languages, grams, [totals[lang] for lang in languages])


def predict(df: DataFrame, filters: Filters, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per row: id, lang_pred, score, known_share, then the columns of ``keep``.

    A null text or one without letters is ``und``, with a score of 0; a text with letters but no known n-gram gets the
    language most seen in training, with 0. Ties go to the first name. score is the best popcount as a part of the two
    best. Null ids and repeated rows are kept; an empty table gives no rows.
    """
    model = df.sparkSession.sparkContext.broadcast(filters)  # of bounded size: see SHARE
    carried = {f"keep_{k}": c for k, c in enumerate(keep)}
    read = df.select(df[id_col].alias("id"), df[text_col].alias("text"), *(df[c].alias(k) for k, c in carried.items()))
    schema = "lang_pred string, score double, known_share double" + "".join(f", {k} {read.schema[k].dataType.simpleString()}" for k in ["id", *carried])

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text", _SLICE):
                names, scores, shares = model.value.predict(texts_of(part, "text").to_pylist())
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(scores), pa.array(shares), *(part.column(c) for c in ["id", *carried])], names=["lang_pred", "score", "known_share", "id", *carried])

    out = read.mapInArrow(trimmed(run), schema)
    return out.select(F.col("id").alias(id_col), "lang_pred", "score", "known_share", *(F.col(k).alias(c) for k, c in carried.items()))


def held_out(id_col, folds: int = 3, fold: int = 1):
    """Whether crc32 of the id as text has the remainder; a null id has none."""
    return F.crc32(id_col.cast("string").cast("binary")) % folds == fold


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages of all documents, learned from two thirds of them."""
    docs = documents(spark, sf_dir)
    out = predict(docs, train(docs.where(~held_out(F.col("doc_id")))))
    return out.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "lang_pred", "score", "known_share")
