"""Byte-level BPE by chunks: a text is cut where no token can cross, and each distinct chunk is encoded once.

A cut before a single space or a newline is exact for the pre-tokeniser of the byte-level vocabularies as long as no
run of white space is longer than two, and none of two ends the text: there a run gives one pre-token for every
character but the last, which joins the next word. Texts outside that rule, or with a special token's string or one
of the marks below, are encoded as a whole.
"""

from __future__ import annotations

import base64
import json
import os
import re
from array import array

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
import tiktoken
from tokenizers import Tokenizer

from .arrow import coded, only

#: In a unit, what stands before it: nothing at the start of a text, a newline; else it was a space.
START, NEWLINE = "\x01", "\x00"
#: Entries of each of a cache's two generations, a bound on a worker's memory.
CACHE_LIMIT = 200_000
#: Longer keys are not kept.
KEY_LIMIT = 64
_WIDE = re.compile(r"[^\x00-\xff]")
_WORDS = regex.compile(public_tokenizers.PATTERN)
_NEVER = 1 << 30
#: The code points with the Unicode property White_Space.
WHITE_SPACE = frozenset(map(chr, [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
_SPACE_CLASS = "[" + "".join(f"\\x{{{ord(c):x}}}" for c in sorted(WHITE_SPACE)) + "]"


def load(name: str = "byte_bpe_50k.json") -> Tokenizer:
    return Tokenizer.from_file(public_tokenizers.path(name))


class Cache(dict):
    """A dictionary of bounded size: when the young generation is full, it replaces the old one."""

    def __init__(self, make, limit: int = CACHE_LIMIT):
        super().__init__()
        self.make, self.limit, self.old = make, limit, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
            if len(key) > KEY_LIMIT:
                return value
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


def chunk(unit: str) -> str:
    """The characters that a unit stands for."""
    if unit[:1] == START:
        return unit[1:]
    return "\n" + unit[1:] if unit[:1] == NEWLINE else " " + unit


def split(texts: pa.Array, specials: list[str]) -> tuple[np.ndarray, np.ndarray, pa.Array, np.ndarray]:
    """Whether each text can be cut, then the units of those that can, as ``coded`` gives them."""
    whole = pc.match_substring_regex(texts, pattern=rf"{_SPACE_CLASS}{{2}}(?:{_SPACE_CLASS}|\z)")
    for mark in (START, NEWLINE, *specials):
        whole = pc.or_(whole, pc.match_substring(texts, pattern=mark))
    cut = pc.invert(whole)
    marked = pc.binary_join_element_wise(START, pc.replace_substring(pc.filter(texts, cut), pattern="\n", replacement=" " + NEWLINE), "")
    return cut.to_numpy(zero_copy_only=False), *coded(pc.split_pattern(marked, pattern=" "))


class IdEncoder:
    """Token ids of texts. Chunks of the first 256 code points, on whose classes all Unicode versions agree, go to
    the faster library that holds the same vocabulary as ranks; all others to the one that defines the ids."""

    def __init__(self, name: str = "byte_bpe_50k.json"):
        self.tokenizer = load(name)
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.fast, ranks = None, public_tokenizers.path(name.replace(".json", ".tiktoken"))
        if os.path.exists(ranks):
            with open(ranks, "rb") as f:
                table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})._core_bpe.encode_ordinary
        self.known = Cache(self._ids)

    def _ids(self, unit: str) -> bytes:
        text = chunk(unit)
        if self.fast is None or _WIDE.search(text):
            return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        return array("I", self.fast(text)).tobytes()

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text, as unsigned 32-bit numbers."""
        cut, codes, units, offsets = split(texts, self.specials)
        known = [self.known[u] for u in units.to_pylist()]
        lengths = np.fromiter(map(len, known), np.int64, len(known)) // 4
        flat = np.frombuffer(b"".join(known), np.uint32)
        starts, n = (np.cumsum(lengths) - lengths)[codes], lengths[codes]
        ends = np.concatenate([[0], np.cumsum(n)])
        ids = flat[np.repeat(starts - ends[:-1], n) + np.arange(ends[-1])]
        bounds, out, k = ends[offsets], [], 0
        for i, simple in enumerate(cut):
            if simple:
                out.append(ids[bounds[k] : bounds[k + 1]])
                k += 1
            else:
                out.append(np.array(self.tokenizer.encode(texts[i].as_py(), add_special_tokens=False).ids, np.uint32))
        return out


def _alphabet() -> dict[str, int]:
    """The byte of each character of a byte-level vocabulary: printable bytes stand for themselves, the others
    follow from 256 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(rest)}


class PrefixCounter:
    """Exact token counts of every prefix, by dynamic programming over the last token of each prefix.

    The encoding of a pre-token's prefix ends in exactly one token t, namely the one that encodes as itself after the
    last token of what stands before it: a sequence of tokens is an encoding just if each adjacent pair encodes as
    itself. So count(prefix) = count(prefix without t) + 1, and no prefix is encoded anew.
    """

    def __init__(self, name: str = "byte_bpe_50k.json"):
        self.tokenizer = load(name)
        self.specials = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        with open(public_tokenizers.path(name)) as f:
            model = json.load(f)["model"]
        self.byte = _alphabet()
        raw = {t: bytes(map(self.byte.__getitem__, t)) for t in model["vocab"] if t not in self.specials}
        self.vocab = frozenset(raw.values())
        self.longest = max(map(len, self.vocab))
        pairs = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        self.rank = {(raw[a], raw[b]): i for i, (a, b) in enumerate(pairs)}
        self.last: dict[bytes, tuple[int, bytes]] = {}
        self.fits: dict[tuple[bytes, bytes], bool] = {}
        self.known = Cache(self._chunk_count, 300_000)

    def _merged(self, data: bytes) -> list[bytes]:
        parts, get = [data[i : i + 1] for i in range(len(data))], self.rank.get
        while len(parts) > 1:
            ranks = [get(pair, _NEVER) for pair in zip(parts, parts[1:])]
            best = min(ranks)
            if best == _NEVER:
                break
            at = ranks.index(best)
            a, b = parts[at], parts[at + 1]
            out, i = parts[:at], at
            while i < len(parts):
                if i + 1 < len(parts) and parts[i] == a and parts[i + 1] == b:
                    out.append(a + b)
                    i += 2
                else:
                    out.append(parts[i])
                    i += 1
            parts = out
        return parts

    def _follows(self, before: bytes, token: bytes) -> bool:
        """Whether the two encode as themselves; before may be empty."""
        found = self.fits.get((before, token))
        if found is None:
            if len(self.fits) > 900_000:
                self.fits.clear()
            found = self.fits[before, token] = self._merged(before + token) == ([before, token] if before else [token])
        return found

    def state(self, word: bytes) -> tuple[int, bytes]:
        """Count and last token of a pre-token; those of its prefixes are kept, as other words begin with them."""
        last, vocab, fits = self.last, self.vocab, self.fits
        found = last.get(word)
        if found is not None:
            return found
        n = len(word)
        if n > KEY_LIMIT:
            return self.states(word)[-1]
        if len(last) > 1_200_000:
            last.clear()
        k = n - 1
        while k and word[:k] not in last:
            k -= 1
        for i in range(k + 1, n + 1):
            for j in range(i):
                token = word[j:i]
                if token in vocab:
                    count, before = last[word[:j]] if j else (0, b"")
                    ok = fits.get((before, token))
                    if ok or ok is None and self._follows(before, token):
                        found = last[word[:i]] = count + 1, token
                        break
        return found

    def states(self, word: bytes) -> list[tuple[int, bytes]]:
        """Count and last token of each prefix of a pre-token, the empty one first."""
        out, last = [(0, b"")], self.last
        for i in range(1, len(word) + 1):
            prefix = word[:i] if i <= KEY_LIMIT else None
            state = last.get(prefix) if prefix else None
            if state is None:
                for j in range(max(0, i - self.longest), i):
                    token = word[j:i]
                    if token in self.vocab and self._follows(out[j][1], token):
                        state = out[j][0] + 1, token
                        break
                if prefix:
                    if len(last) > 1_200_000:
                        last.clear()
                    last[prefix] = state
            out.append(state)
        return out

    def _pretokens(self, text: str) -> list[bytes]:
        if not _WIDE.search(text):
            return [w.encode() for w in _WORDS.findall(text)]
        return [bytes(map(self.byte.__getitem__, w)) for w, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(text)]

    def _chunk_count(self, unit: str) -> int:
        if unit.isalpha() and not _WIDE.search(unit):
            return self.state(b" " + unit.encode())[0]
        return sum(self.state(w)[0] for w in self._pretokens(chunk(unit)))

    def prefixes(self, text: str) -> list[int]:
        """The token count of text[:i], for each i from 0 to len(text)."""
        counts, base = [0], 0
        parts = re.split("(" + "|".join(map(re.escape, self.specials)) + ")", text) if self.specials else [text]
        for k, part in enumerate(parts):
            if k % 2:  # a special token; a part of its string is ordinary text
                for n in range(1, len(part)):
                    counts.append(before + len(self.tokenizer.encode(parts[k - 1] + part[:n], add_special_tokens=False).ids))
                base += 1
                counts.append(base)
                continue
            before, run, run_base = base, b"", base
            for word in self._pretokens(part):
                states, at = self.states(word), 0
                for c in word.decode():
                    at += len(c.encode())
                    if c in WHITE_SPACE:  # at the end of a text, a whole run of white space is one pre-token
                        if not run:
                            run_base = base + states[at - len(c.encode())][0]
                        run += c.encode()
                        counts.append(run_base + self.states(run)[-1][0])
                    else:
                        run = b""
                        counts.append(base + (2 if at == 2 and word in (b"'re", b"'ve", b"'ll") else states[at][0]))
                base += states[-1][0]
        return counts

    def count(self, texts: pa.Array, limit: int) -> tuple[np.ndarray, np.ndarray]:
        """The token count of each text, and the length in characters of its longest prefix of at most ``limit``."""
        cut, codes, units, offsets = split(texts, self.specials)
        names = units.to_pylist()
        each = np.fromiter((self.known[u] for u in names), np.int64, len(names))[codes]
        widths = np.fromiter((len(u) + (u[:1] not in (START, NEWLINE)) - (u[:1] == START) for u in names), np.int64, len(names))[codes]
        ends, places = np.concatenate([[0], np.cumsum(each)]), np.concatenate([[0], np.cumsum(widths)])
        totals, fit, k = np.zeros(len(cut), np.int64), np.zeros(len(cut), np.int64), 0
        for i, simple in enumerate(cut):
            if not simple:
                counts = self.prefixes(texts[i].as_py())
                totals[i], fit[i] = counts[-1], max(n for n, c in enumerate(counts) if c <= limit)
                continue
            a, b = offsets[k], offsets[k + 1]
            k += 1
            totals[i] = ends[b] - ends[a]
            if totals[i] <= limit:
                fit[i] = places[b] - places[a]
                continue
            at = int(np.searchsorted(ends[a : b + 1], ends[a] + limit, "right")) - 1 + a  # the unit that passes the limit
            first = max(a, at - 1)  # white space before it may be its run's start
            counts = self.prefixes("".join(chunk(names[codes[j]]) for j in range(first, at + 1)))
            room = limit - (ends[first] - ends[a])
            fit[i] = places[first] - places[a] + max(n for n, c in enumerate(counts) if c <= room)
        return totals, fit


def id_encoder(name: str) -> IdEncoder:
    return only(("ids", name), lambda: IdEncoder(name))


def prefix_counter(name: str) -> PrefixCounter:
    return only(("prefixes", name), lambda: PrefixCounter(name))
