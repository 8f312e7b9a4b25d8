"""SentencePiece encoding and decoding by a weighted finite-state transducer.

Three transducers over characters are compiled from a model and composed with each input: the normaliser (a space
becomes the mark, a mark is put before a text, runs of spaces are thinned if the model says so); the pieces, an arc for
each with its weight; and the fallback of characters that no piece has, a path through their bytes' pieces. The shortest
path in the tropical semiring (minimum, plus) gives the pieces.

In a unigram model an arc weighs the piece's negative log probability. A merging model has no such weights: a
segmentation is its own just if each pair of adjacent pieces is left as it is when merged alone. Its transducer's states
remember the last piece; an arc weighs one, or infinity if its piece can't follow. Of the states at a place one at most
has a finite distance, so that relaxing it may end with the first arc of finite weight.

Decoding is the inverse transducer. Inputs are composed chunk by chunk where no piece has a mark after another
character, as no path is cut before a mark that follows one; and each distinct chunk is composed once.
"""

from __future__ import annotations

import math
import re
import struct
import zlib
from array import array

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from .arrow import coded, only, slices, texts_of, trimmed
from .bpe import KEY_LIMIT, NEWLINE, START, Cache
from .tables import documents

MODEL = "piece_bpe_32k.model"
SPACE = "▁"
#: Runs of marks with what follows them.
_PARTS = re.compile(r"▁+[^▁]*|[^▁]+").findall
#: Kinds of pieces in a model file.
NORMAL, UNKNOWN, CONTROL, UNUSED, BYTE = 1, 2, 3, 5, 6
UNIGRAM, MERGING = 1, 2
#: How much worse than the worst piece a unigram model takes an unknown character to be, and what decoding
#: gives for the unknown piece and for a byte of no character.
UNKNOWN_PENALTY, UNKNOWN_SURFACE, REPLACEMENT = 10.0, " ⁇ ", "\ufffd"


def _fields(data: bytes):
    """(number, value) of a serialised message's fields."""
    at = 0

    def number() -> int:
        nonlocal at
        out = shift = 0
        while True:
            byte = data[at]
            at += 1
            out |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return out

    while at < len(data):
        key = number()
        if key & 7 == 0:
            yield key >> 3, number()
        else:
            size = number() if key & 7 == 2 else {1: 8, 5: 4}[key & 7]
            yield key >> 3, data[at : at + size]
            at += size


class Model:
    """Pieces with scores and kinds, and the normaliser's switches. Unigram and merging models with the identity
    normaliser are compiled; tables of character replacements and user-defined pieces aren't."""

    def __init__(self, path: str):
        self.pieces: list[tuple[str, float, int]] = []
        with open(path, "rb") as f:
            data = f.read()
        trainer, normaliser = {}, {}
        for number, value in _fields(data):
            if number == 1:
                piece = dict(_fields(value))
                self.pieces.append((piece[1].decode(), struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0, piece.get(3, NORMAL)))
            elif number == 2:
                trainer = dict(_fields(value))
            elif number == 3:
                normaliser = dict(_fields(value))
        self.kind, self.bytes = trainer.get(3, UNIGRAM), bool(trainer.get(35))
        self.prefix, self.thin = bool(normaliser.get(3, 1)), bool(normaliser.get(4, 1))
        if self.kind not in (UNIGRAM, MERGING) or normaliser.get(2) or not normaliser.get(5, 1) or any(k not in (NORMAL, UNKNOWN, CONTROL, UNUSED, BYTE) for _, _, k in self.pieces):
            raise ValueError("only unigram and merging models with the identity normaliser and no user-defined pieces can be compiled")


class Normaliser:
    """Arcs (state, is a space) -> (output before the character, keep the character, next state). States: before any
    character, after one, and in spaces that may end the text."""

    def __init__(self, prefix: bool, thin: bool):
        self.first = SPACE if prefix else ""
        self.arcs = {(0, True): ("", False, 0), (0, False): ("", True, 1), (1, True): ("", False, 2), (1, False): ("", True, 1), (2, True): ("", False, 2), (2, False): (SPACE, True, 1)}
        if not thin:
            self.arcs = {(state, space): (SPACE if space else "", not space, 1) for state in range(3) for space in (False, True)}
        self.thin = thin

    def compose(self, text: str) -> str:
        if not self.thin:  # every state has the same arcs
            return self.first + text.replace(" ", SPACE) if text else ""
        out, state = [], 0
        for c in text:
            before, kept, state = self.arcs[state, c == " "]
            out += (before, c) if kept else (before,)
        # marks that stand in a text itself aren't thinned, but go at its end
        return (self.first + "".join(out)).rstrip(SPACE) if any(out) else ""


class Transducer:
    """Pieces and fallback, as arcs by the characters that they read; in a merging model states remember the last
    piece."""

    def __init__(self, model: Model):
        self.merging, self.thin, self.prefix = model.kind == MERGING, model.thin, model.prefix
        self.normaliser = Normaliser(model.prefix, model.thin)
        self.ids = {p: i for i, (p, _, kind) in enumerate(model.pieces) if kind == NORMAL}
        self.scores = {p: s for p, s, kind in model.pieces if kind == NORMAL}
        self.unknown = next((i for i, (_, _, k) in enumerate(model.pieces) if k == UNKNOWN), None)
        self.byte_ids = [next(i for i, (p, _, k) in enumerate(model.pieces) if k == BYTE and p == f"<0x{b:02X}>") for b in range(256)] if model.bytes else None
        self.characters = {c for p in self.ids for c in p}
        self.cuts_marks = not any(SPACE in p.lstrip(SPACE) for p in self.ids)
        self.longest = max(map(len, self.ids), default=1)
        self.worst = min(self.scores.values(), default=0.0) - UNKNOWN_PENALTY
        # the length of the longest piece that ends with two characters
        self.reach: dict[str, int] = {}
        for p in self.ids:
            self.reach[p[-2:]] = max(len(p), self.reach.get(p[-2:], 1))
        self.fits: dict[tuple[str, str], bool] = {}
        self.last: dict[str, str] = {}
        # output labels of the inverse
        self.labels = [p.replace(SPACE, " ") if k in (NORMAL, UNUSED) else "" for p, _, k in model.pieces]
        self.marked = np.array([k not in (NORMAL, UNUSED) for _, _, k in model.pieces])
        self.bytes = {i: int(p[3:5], 16) for i, (p, _, k) in enumerate(model.pieces) if k == BYTE}
        self.chunked = self.merging and self.cuts_marks and not self.thin and self.prefix and self.byte_ids is not None
        self.cuts_newlines = "\n" not in self.characters
        self.known = Cache(self._unit, 400_000)

    def _merged(self, text: str) -> list[str]:
        """Merges alone: always the adjacent pair whose piece has the best score, the leftmost of equal ones."""
        parts, get = list(text), self.scores.get
        while len(parts) > 1:
            scores = [get(a + b, -math.inf) for a, b in zip(parts, parts[1:])]
            best = max(scores)
            if best == -math.inf:
                break
            k = scores.index(best)
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return parts

    def _follows(self, before: str, piece: str) -> bool:
        found = self.fits.get((before, piece))
        if found is None:
            if len(self.fits) > 1_000_000:
                self.fits.clear()
            found = self.fits[before, piece] = self._merged(before + piece) == ([before, piece] if before else [piece])
        return found

    def path(self, text: str) -> list[str]:
        """The shortest path over a normalised text: pieces, or single characters that none has."""
        return self._merging_path(text) if self.merging else self._unigram_path(text)

    def _unigram_path(self, text: str) -> list[str]:
        """Sums are of 32 bits, as the model's own; of equal ones the arc from the farthest place counts."""
        one, n = np.float32, len(text)
        distance, arc = [one(0)] + [one(math.inf)] * n, [""] * (n + 1)
        for start in range(n):
            here, single = distance[start], False
            for end in range(start + 1, min(n, start + self.longest) + 1):
                piece = text[start:end]
                if (score := self.scores.get(piece)) is not None:
                    single |= end == start + 1
                    if (total := here - one(score)) < distance[end]:
                        distance[end], arc[end] = total, piece
            if not single and (total := here - one(self.worst)) < distance[start + 1]:
                distance[start + 1], arc[start + 1] = total, text[start]
        return self._back(n, arc.__getitem__)

    @staticmethod
    def _back(end: int, arc) -> list[str]:
        out = []
        while end:
            out.append(arc(end))
            end -= len(out[-1])
        return out[::-1]

    def _merging_path(self, text: str) -> list[str]:
        """At each place one state has a finite distance, the number of pieces so far: which one is all that is kept. The
        states of short prefixes stay known, as other texts begin with them."""
        n, kept, ids, fits, reach = len(text), self.last, self.ids, self.fits, self.reach
        if len(kept) > 1_000_000:
            kept.clear()
        known = min(n, KEY_LIMIT)
        while known and text[:known] not in kept:
            known -= 1
        new: dict[int, str] = {0: ""}
        for end in range(known + 1, n + 1):
            for start in range(max(0, end - reach.get(text[max(0, end - 2) : end], 1)), end):
                piece = text[start:end]
                if piece in ids or end - start == 1:
                    before = kept[text[:start]] if 0 < start <= known else new[start]
                    fit = fits.get((before, piece))
                    if fit or fit is None and self._follows(before, piece):
                        new[end] = piece  # every other sum at this place is infinite
                        if end <= KEY_LIMIT:
                            kept[text[:end]] = piece
                        break
        out, end = [], n
        while end:
            piece = kept[text[:end]] if end <= known else new[end]
            out.append(piece)
            end -= len(piece)
        return out[::-1]

    def _ids(self, text: str) -> list[int]:
        """Of a normalised text."""
        out: list[int] = []
        for part in _PARTS(text) if self.cuts_marks and self.merging and SPACE in text[1:] else (text,):
            was_unknown = False
            for piece in self.path(part):
                if piece in self.ids:
                    out.append(self.ids[piece])
                elif self.byte_ids is not None:
                    out.extend(self.byte_ids[b] for b in piece.encode())
                elif not was_unknown:  # a run of unknown characters is one piece
                    out.append(self.unknown)
                was_unknown = piece not in self.ids
        return out

    def _unit(self, unit: str) -> bytes:
        text = "\n" + unit[1:] if unit[:1] == NEWLINE else SPACE + (unit[1:] if unit[:1] == START else unit)
        return array("I", self._ids(text)).tobytes()

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text."""
        if not self.chunked:
            return [np.array(self._ids(self.normaliser.compose(t)), np.uint32) for t in texts.to_pylist()]
        whole = pc.match_substring(texts, pattern="  ")
        for other in (pc.starts_with(texts, pattern=" "), *(pc.match_substring(texts, pattern=c) for c in (START, NEWLINE, SPACE)), pc.equal(texts, "")):
            whole = pc.or_(whole, other)
        cut = pc.invert(whole)
        chosen = pc.filter(texts, cut)
        if self.cuts_newlines:
            chosen = pc.replace_substring(chosen, pattern="\n", replacement=" " + NEWLINE)
        codes, units, offsets = coded(pc.split_pattern(pc.binary_join_element_wise(START, chosen, ""), pattern=" "))
        known = [self.known[u] for u in units.to_pylist()]
        lengths = np.fromiter(map(len, known), np.int64, len(known)) // 4
        flat = np.frombuffer(b"".join(known), np.uint32)
        starts, n = (np.cumsum(lengths) - lengths)[codes], lengths[codes]
        ends = np.concatenate([[0], np.cumsum(n)])
        ids = flat[np.repeat(starts - ends[:-1], n) + np.arange(ends[-1])]
        bounds, out, k = ends[offsets], [], 0
        for i, simple in enumerate(cut.to_pylist()):
            if simple:
                out.append(ids[bounds[k] : bounds[k + 1]])
                k += 1
            else:
                out.append(np.array(self._ids(self.normaliser.compose(texts[i].as_py())), np.uint32))
        return out

    def decode(self, ids) -> str:
        """The inverse: pieces' characters, marks as spaces, without the mark of the first piece if that begins with one;
        runs of bytes as the characters that they are, any other byte as a replacement character."""
        ids = np.asarray(ids, np.int64)
        n = len(ids)
        ends = np.flatnonzero(self.marked[ids]).tolist() if n else []
        if not ends and not self.thin:
            text = "".join(map(self.labels.__getitem__, ids.tolist()))
            return text.removeprefix(" ") if self.prefix else text
        out: list[str] = []
        starting, at = True, 0
        ends.append(n)
        for end in ends:
            if end > at:
                text = "".join(map(self.labels.__getitem__, ids[at:end].tolist()))
                if starting and not any(out) and (self.prefix or self.thin):
                    text = self._without_first(text, ids[at:end])
                out.append(text)
                starting = self.thin and not any(out)
            at = end + 1
            if end == n:
                break
            if ids[end] in self.bytes:
                if out and isinstance(out[-1], bytearray):
                    out[-1].append(self.bytes[ids[end]])
                else:
                    out.append(bytearray([self.bytes[ids[end]]]))
            else:
                out.append(UNKNOWN_SURFACE if ids[end] == self.unknown else "")
        return "".join(_characters(x) if isinstance(x, bytearray) else x for x in out)

    def _without_first(self, text: str, ids: np.ndarray) -> str:
        if not self.thin:
            return text.removeprefix(" ")
        for i in ids.tolist():  # every piece loses its mark until one leaves something
            label = self.labels[i]
            text = text.removeprefix(" ")
            if label.removeprefix(" "):
                break
        return text


def _characters(data: bytearray) -> str:
    out, at = [], 0
    while at < len(data):
        for size in (1, 2, 3, 4):
            try:
                out.append(data[at : at + size].decode())
            except UnicodeDecodeError:
                continue
            at += size
            break
        else:
            out.append(REPLACEMENT)
            at += 1
    return "".join(out)


def transducer(name: str) -> Transducer:
    """By a name among the public tokenizers, or by the path of a model file."""
    return only(("pieces", name), lambda: Transducer(Model(name if "/" in name else public_tokenizers.path(name))))


def encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = MODEL, ids: bool = False) -> DataFrame:
    """One row per row: id, n_pieces, ids_crc32 (of unsigned little-endian 32-bit ids), n_bytes (of the decoded text),
    round_trip (decoding gives the text back), and with ``ids`` the ids themselves.

    A null or empty text has no pieces and comes back empty; a text that holds the mark itself comes back with spaces
    there, so that round_trip is false. Null ids and repeated rows are kept; other columns aren't read; an empty table
    gives no rows. No shuffle.
    """
    schema = f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, n_pieces long, ids_crc32 long, n_bytes long, round_trip boolean" + ", ids array<long>" * ids

    def run(batches):
        machine = transducer(model)
        for batch in batches:
            for part in slices(batch, "text"):
                texts = texts_of(part, "text")
                found = machine.encode(texts)
                back = [machine.decode(x) for x in found]
                columns = [
                    part.column("id"),
                    pa.array([len(x) for x in found], pa.int64()),
                    pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in found], pa.int64()),
                    pa.array([len(t.encode()) for t in back], pa.int64()),
                    pa.array([a == b for a, b in zip(back, texts.to_pylist(), strict=True)], pa.bool_()),
                ]
                if ids:
                    columns.append(pa.array([x.astype(np.int64) for x in found], pa.list_(pa.int64())))
                yield pa.RecordBatch.from_arrays(columns, names=[id_col, "n_pieces", "ids_crc32", "n_bytes", "round_trip", "ids"][: len(columns)])

    return df.select(df[id_col].alias("id"), df[text_col].alias("text")).mapInArrow(trimmed(run), schema)


def decode(df: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", model: str = MODEL) -> DataFrame:
    """id, text of each row's ids; null ids give a null text."""
    schema = f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, text string"

    def run(batches):
        machine = transducer(model)
        for batch in batches:
            texts = [None if x is None else machine.decode(x) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(texts, pa.string())], names=[id_col, "text"])

    return df.select(df[id_col].alias("id"), df[ids_col].alias("ids")).mapInArrow(run, schema)


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded and decoded again."""
    return encode(documents(spark, sf_dir))
