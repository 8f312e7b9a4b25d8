import random

import pyarrow as pa
import pytest

from quillspark.llm.bpe import IdEncoder, PrefixCounter

TRICKY = ["", "a", "\n\n", "a  b", " a", " \nb", "a \n b", "a\n\nb", "x   y", "x\n\n\ny", "<|endoftext|>a", "b <|endoftext|>", "a\tb \tc", "it's  we'll 'll '", "we'll've're", "\xa0\xa0x", "a　b\n c", "é ß\n ñ  x ", "a\x00b", "a\x01 b", "  a", "\n a", "a\n", " \n", "a \n", "日本語 テキスト", "🙂🙂 👍🏽", "a" * 300, "1234567890 12.5%", "x!!'ll!!", "ﬁne ǅ ⅷ ²"]


@pytest.fixture(scope="module")
def made():
    rng = random.Random(1)
    alphabet = ["a", "the", "ing", "é", "ß", " ", " ", "\n", "'", "ll", "re", ".", "1", "!", "\t", "日", " ", "Zq"]
    return TRICKY + ["".join(rng.choices(alphabet, k=rng.randrange(1, 40))) for _ in range(400)]


def test_ids_are_the_librarys(made):
    encoder = IdEncoder()
    for text, ids in zip(made, encoder.encode(pa.array(made)), strict=True):
        assert ids.tolist() == encoder.tokenizer.encode(text, add_special_tokens=False).ids, text


def test_counts_and_fits_are_the_librarys(made):
    counter = PrefixCounter()
    brute = lambda t: len(counter.tokenizer.encode(t, add_special_tokens=False).ids)
    totals, fit = counter.count(pa.array(made), 5)
    for text, n, f in zip(made, totals, fit, strict=True):
        all_prefixes = [brute(text[:i]) for i in range(len(text) + 1)]
        assert n == all_prefixes[-1], text
        assert f == max(i for i, c in enumerate(all_prefixes) if c <= 5), text


def test_every_prefix(made):
    counter = PrefixCounter()
    for text in made:
        assert counter.prefixes(text) == [len(counter.tokenizer.encode(text[:i], add_special_tokens=False).ids) for i in range(len(text) + 1)], text
