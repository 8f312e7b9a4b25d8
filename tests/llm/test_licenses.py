import math
import random

from quillspark.llm.licenses import CONTAINMENT, PHRASES, TEMPLATES, license_scan, words_of


def plain(text):
    words = words_of(text or "")
    starts, labels = [], set()
    for phrase, label in PHRASES.items():
        p = phrase.split()
        at = [i for i in range(len(words)) if words[i : i + len(p)] == p]
        starts += at
        if at:
            labels.add(label)
    more, best = set(labels), 1.0 if labels else 0.0
    for label, template, must in TEMPLATES:
        t, needed = set(words_of(template)), set(words_of(must))
        size = math.ceil(len(words_of(template)) / CONTAINMENT - 1e-9)
        for i in range(max(1, len(words) - size + 1)):
            block = set(words[i : i + size])
            if needed <= block and len(t & block) >= math.ceil(CONTAINMENT * len(t) - 1e-9):
                more.add(label)
                best = max(best, len(t & block) / len(t))
    return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels)), ",".join(sorted(more)), best


def test_against_a_plain_scan(spark):
    rng = random.Random(6)
    rows = [(0, None), (1, ""), (2, "cc by cc by CC-BY"), (3, "acc by"), (4, "ccé by éby"), (5, " ..!\n"), (6, "All rights. Reserved\ncc\nby"), (7, "general public license " * 400)]
    pool = [w for _, t, _ in TEMPLATES for w in t.split()] + ["the", "lorem", "é", "ĳ", "cc", "by", "all", "rights", "reserved", "\n", "\n", "\x7f", "İ"]
    for i in range(8, 300):
        text = " ".join(rng.choices(pool, k=rng.randrange(1, 40)))
        for _ in range(rng.randrange(3)):
            t = rng.choice(TEMPLATES)[1].split()
            for _ in range(rng.randrange(3)):
                t[rng.randrange(len(t))] = rng.choice(pool)
            text += rng.choice([" ", "\n"]) + "".join(w + rng.choice([" ", " ", "\n", "\n * "]) for w in t).upper()
        rows.append((i, text))
    got = {r[0]: tuple(r)[1:] for r in license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, text in rows:
        assert got[i] == plain(text), repr(text)
    assert len({v[5] for v in got.values()}) > 10


def test_wrapped_notices_and_labels_that_differ_by_a_word(spark):
    wrapped = "/* Permission is hereby granted, free of charge, to any person obtaining a copy\n * of this software and associated documentation\n * files (the Software) */"
    rows = {1: wrapped, 2: "Licensed under the Apache License, Version 2.0.", 3: "This work is licensed under the GNU General Public License, version 3.", 4: "Licensed under CC BY-NC 4.0."}
    rows |= {5: "under the terms of the GNU General Public License as published by the Free Software Foundation", 6: "released under the license of the city", 7: "word " * 50_000 + wrapped + " word" * 50_000, 8: "mit " * 100_000}
    got = {r.doc_id: r.labels for r in license_scan(spark.createDataFrame(list(rows.items()), "doc_id long, text string")).collect()}
    assert got == {1: "mit", 2: "apache-2.0", 3: "gpl", 4: "cc-by,cc-by-nc", 5: "gpl", 6: "", 7: "mit", 8: ""}


def test_odd_rows(spark):
    df = spark.createDataFrame([(None, "Released under the MIT license!", 1), (1, "x", 2), (1, "x", 2)], "doc_id long, text string, row int")
    got = sorted((str(r.doc_id), r.labels) for r in license_scan(df).collect())
    assert got == [("1", ""), ("1", ""), ("None", "mit")]
    assert license_scan(df.limit(0)).count() == 0
    plan = license_scan(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
