import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import pytest

from quillspark.llm.personal import KINDS, base_spans, bootstrap, candidates, find_personal, joined, luhn, redact
from quillspark.llm.tables import Staged

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain(text):
    out = []
    for kind in KINDS:
        for m in re.finditer(PLAIN[kind], text):
            digits = re.sub(r"[^0-9]", "", m[0])
            ok = kind == "email" or kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")) or kind == "card" and 13 <= len(digits) <= 19 and luhn(digits) or kind == "phone" and 9 <= len(digits) <= 15
            if ok:
                out.append((kind, *m.span()))
    return out


def test_forms_are_the_plain_patterns():
    rng = random.Random(4)
    bits = ["a", "x.y", "@", "@", ".", "com", "-", "+", "1", "25", "255.", "4111111111111111", " ", "(", ")", "é", "+49 ", "00", "%", "_", "300.1.2.3", "٣", "\n"]
    for _ in range(6000):
        text = "".join(rng.choices(bits, k=rng.randrange(1, 14)))
        assert base_spans(text) == plain(text), text


def test_long_runs_take_little_time():
    for text in ("a" * 300_000, "1" * 300_000, "1." * 150_000, "a@" * 150_000, "+1 " * 100_000, "a.b@c" * 60_000):
        base_spans(text)


def rows_of(df, **options):
    return find_personal(df, **options).collect()


def test_long_texts_have_few_steps():
    for text in ("1_" * 150_000, "= " * 150_000, "token=" * 50_000, "a1 " * 100_000, '"' * 300_000 + "1"):
        for _, a, b in candidates(text, [])[:2000]:
            assert text[a:b]


def test_contexts_find_new_identifiers(spark):
    rows = [(i, f"Thanks, reach me under mail{i}@mail.example.com for more {i}") for i in range(12)]
    rows += [(50, "You may reach me under anna(at)example0099 for more"), (51, "It cost 12345 for more"), (52, None), (53, ""), (53, "")]
    got = {r.doc_id: r for r in rows_of(spark.createDataFrame(rows, "doc_id long, text string, spans string"[:-14]))}
    text = dict(rows)[50]
    at = text.index("anna")
    assert got[50].spans == f"email:{at}:{at + len('anna(at)example0099')}" and got[50].n_email == 0 and got[50].n_added == 1
    assert got[51].spans == "" and got[52].spans == "" and got[52].base_sha256 == hashlib.sha256(b"").hexdigest()
    for i in range(12):
        assert got[i].spans == joined(plain(dict(rows)[i])) and got[i].n_email == 1 and got[i].n_added == 0


def test_what_is_discovered_induces_patterns(spark):
    """Seeds teach "reach under _"; what it finds teaches "ring up _", which no seed stands beside."""
    rows = [(i, f"please reach under mail{i}@mail.example.com today") for i in range(60)]
    rows += [(100 + i, f"please reach under id_{i}x today") for i in range(12)]
    rows += [(200 + i, f"they ring up id_{i}x often") for i in range(12)]
    rows += [(300, "they ring up id_99y often"), (301, "they saw id_98y twice")]
    got = {r.doc_id: r.spans for r in rows_of(spark.createDataFrame(rows, "doc_id long, text string"))}
    assert all(got[100 + i].startswith("email:") and got[200 + i].startswith("email:") for i in range(12))
    assert got[300] == "email:13:19" and got[301] == ""


def test_secrets_by_name(spark):
    key = "04dbebab91ab85687d33eeaaf9ac699e1188f962"
    rows = [(1, f'of it token = "{key}" and'), (2, f"API_KEY={key}."), (3, f"commit {key} fixed it"), (4, "password: correcthorsebattery"), (5, "token = 12345"), (6, f"the token {key}")]
    got = {r.doc_id: r for r in rows_of(spark.createDataFrame(rows, "doc_id long, text string"))}
    assert got[1].spans == "secret:15:55" and got[2].spans == "secret:8:48" and got[1].n_added == 1
    assert [got[i].spans for i in (4, 5)] == ["", ""] and got[3].spans == "secret:7:47"  # the same value again


def brute_bootstrap(edges, seeds, confidence):
    """The rounds in plain Python."""
    known = {i: [(k, 1.0) for k in kinds] for i, kinds in seeds.items()}
    size = Counter(p for _, p in edges)
    while True:
        mass = defaultdict(float)
        for i, p in edges:
            for k, s in known.get(i, []):
                mass[p, k] += s
        sure = {(p, k): m / (size[p] + 1) for (p, k), m in mass.items()}
        new = {}
        for i in {i for i, _ in edges} - set(known):
            own = [p for j, p in edges if j == i]
            best = []
            for k in {k for _, k in sure}:
                if any(sure.get((p, k), 0) >= confidence for p in own):
                    score = 1 - math.prod(max(1 - sure[p, k], 1e-9) for p in own if (p, k) in sure)
                    if score >= confidence:
                        best.append((-score, k))
            if best:
                new[i] = [(min(best)[1], -min(best)[0])]
        if not new:
            return {i: [k for k, _ in v] for i, v in known.items()}
        known |= new


@pytest.mark.parametrize("seed", range(3))
def test_graph_against_plain_rounds(spark, seed):
    rng = random.Random(seed)
    edges = sorted({(f"i{rng.randrange(60)}".encode(), f"p{rng.randrange(8)}") for _ in range(180)})
    seeds = {f"i{k}".encode(): [rng.choice(["email", "phone"])] if k % 5 else ["email", "phone"] for k in range(40)}
    seeds |= {f"i{k}".encode(): ["email"] for k in range(40, 60) if rng.random() < 0.5}
    made = bootstrap(spark.createDataFrame(edges, "instance binary, pattern string"), spark.createDataFrame([(i, k) for i, ks in seeds.items() for k in ks], "instance binary, kind string"), Staged(spark, "test"), 0.5)
    got = defaultdict(list)
    for r in made.collect():
        got[bytes(r.instance)].append(r.kind)
    want = brute_bootstrap(edges, seeds, 0.5)
    assert {i: sorted(v) for i, v in got.items()} == {i: sorted(v) for i, v in want.items()} and len(want) > len(seeds)


def test_a_very_long_text(spark):
    text = "word " * 200_000 + "x@y.org" + " word" * 200_000 + ' token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"'
    got = rows_of(spark.createDataFrame([(1, text), (2, "no data")], "doc_id long, text string"))
    assert {r.doc_id: r.spans for r in got} == {1: f"email:1000000:1000007,secret:{len(text) - 41}:{len(text) - 1}", 2: ""}


def test_redaction(spark):
    df = spark.createDataFrame([(1, "a é x@y.org, +49 (30) 1234567!", "p"), (2, None, "q"), (None, "none", None)], "doc_id long, text string, spans string")
    assert sorted(map(str, map(tuple, redact(df).collect()))) == sorted(map(str, [(1, "a é [EMAIL], [PHONE]!", "p"), (2, None, "q"), (None, "none", None)]))
    assert redact(df).columns == df.columns
    assert redact(df.limit(0)).count() == 0
