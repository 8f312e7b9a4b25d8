import random
import struct
import zlib

import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece

from quillspark.llm.piece_transducer import MODEL, decode, encode, transducer


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(MODEL))


@pytest.fixture(scope="module")
def made():
    rng = random.Random(5)
    bits = ["the", "ing", "er", "ou", "é", "ß", " ", " ", "  ", "\n", "▁", "日本", "🙂", "a", "t", "1", "12", ".", "</s>", "<unk>", "\t", "\x00", "\x01", "Th", "zq", "wh"]
    return ["", " ", "a  b", " a", "a ", "\n", "<s> hi", "<0x41>", "a" * 400, " " * 50 + "x", "aaaa aaaa", "▁▁x"] + ["".join(rng.choices(bits, k=rng.randrange(1, 25))) for _ in range(3000)]


def test_ids_and_texts_are_the_librarys(made, library):
    machine = transducer(MODEL)
    for text, ids in zip(made, machine.encode(pa.array(made)), strict=True):
        assert ids.tolist() == library.encode(text), repr(text)
        assert machine.decode(ids.tolist()) == library.decode(ids.tolist()), repr(text)


def test_any_ids_decode_as_the_librarys(library):
    rng, machine = random.Random(8), transducer(MODEL)
    size = library.get_piece_size()
    marks = [i for i in range(size) if library.id_to_piece(i).startswith("▁")][:40]
    few = [0, 1, 2, *range(3, 259), library.piece_to_id("▁"), *marks]
    fixed = [[3 + b for b in data] for data in (b"\xe2\x82", b"\xf0\x9f\x98", b"\xed\xa0\x80", b"\xef\xbf\xbd", b"\xc0\x80", b"\x20", b"\xf4\x90\x80\x80")]
    for k in range(6000):
        ids = fixed[k] if k < len(fixed) else [rng.choice(few) if rng.random() < 0.8 else rng.randrange(size) for _ in range(rng.randrange(0, 12))]
        assert machine.decode(ids) == library.decode(ids), ids


def model_file(path, pieces, kind, fallback=True, prefix=True, thin=False):
    """A model as its format asks: pieces of (text, score, type), the trainer's and the normaliser's switches."""

    def number(x):
        out = b""
        while x > 127:
            out, x = out + bytes([x & 127 | 128]), x >> 7
        return out + bytes([x])

    text = lambda field, data: number(field << 3 | 2) + number(len(data)) + data
    flag = lambda field, value: number(field << 3) + number(int(value))
    data = b"".join(text(1, text(1, p.encode()) + number(2 << 3 | 5) + struct.pack("<f", s) + flag(3, k)) for p, s, k in pieces)
    data += text(2, flag(3, kind) + flag(35, fallback)) + text(3, text(1, b"identity") + flag(3, prefix) + flag(4, thin) + flag(5, True))
    path.write_bytes(data)
    return str(path)


@pytest.mark.parametrize("kind,fallback,prefix,thin", [(1, True, True, False), (1, False, True, True), (1, True, False, True), (2, True, True, True), (2, True, False, False), (2, False, True, False)])
def test_other_models(tmp_path, kind, fallback, prefix, thin):
    """A unigram model weighs its arcs; so many hundred random texts and ids are those of the library."""
    rng = random.Random(kind + 2 * fallback + 4 * prefix)
    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)] + [(f"<0x{b:02X}>", 0.0, 6) for b in range(256)] * fallback
    letters = ["a", "b", "c", "é", "▁"]
    words = {c for c in letters if c != "é"}
    while len(words) < 60:
        words.add(rng.choice(["", "▁"]) + "".join(rng.choices(letters[:4], k=rng.randrange(1, 6))))
    order = sorted(words, key=lambda w: (len(w), w))
    scores = {w: -float(k) for k, w in enumerate(order)} if kind == 2 else {w: -rng.randrange(1, 40) / 4 for w in order}
    name = model_file(tmp_path / "m.model", pieces + [(w, scores[w], 1) for w in order], kind, fallback, prefix, thin)
    library, machine = sentencepiece.SentencePieceProcessor(model_file=name), transducer(name)
    texts = ["", " ", "  a", "a  b ", "日本"] + ["".join(rng.choices(["a", "b", "c", "é", " ", " ", "日", "▁"], k=rng.randrange(1, 30))) for _ in range(800)]
    for text, ids in zip(texts, machine.encode(pa.array(texts)), strict=True):
        assert ids.tolist() == library.encode(text), repr(text)
        assert machine.decode(ids) == library.decode(ids.tolist()), repr(text)
    for _ in range(500):
        ids = [rng.randrange(library.get_piece_size()) for _ in range(rng.randrange(0, 9))]
        assert machine.decode(ids) == library.decode(ids), ids


def test_rows(spark, made, library):
    rows = [(1, "hello world", "x"), (None, "null id", "y"), (2, None, None), (3, "é\n" * 100, "z"), (3, "é\n" * 100, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    out = encode(df, ids=True)
    got = sorted((str(r.doc_id), r.n_pieces, r.ids_crc32, r.n_bytes, r.round_trip) for r in out.collect())
    want = []
    for i, t, _ in rows:
        ids = library.encode(t or "")
        want.append((str(i), len(ids), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids)), len((t or "").encode()), True))
    assert got == sorted(want)
    assert sorted(str(r.text) for r in decode(out).collect()) == sorted(t or "" for _, t, _ in rows)
    assert encode(df.limit(0)).count() == 0
