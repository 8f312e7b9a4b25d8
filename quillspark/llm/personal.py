"""Personal data: fixed forms first, then contexts bootstrapped from them.

What the fixed forms find are the seeds, and so are values that a name like token or password is given. The words
around seeds are lexical patterns; tokens that look like identifiers (with a digit, an at sign or an underscore, or
after a colon or an equals sign) and that no form matched are candidate instances. Patterns and instances make a
bipartite graph that Spark scores in rounds: a pattern's confidence for a kind is the mass of its instances known to be
of that kind by its distinct instances and one more, so that few don't make it sure; a candidate's score is one less
the product of its patterns' doubts. A candidate that a sure pattern holds and whose score is high becomes known, and
with it the patterns of all its other places gain, so that the next round finds what no seed stands beside. Rounds end
when nothing new is found.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .arrow import slices, texts_of, trimmed
from .tables import Staged, documents

#: Kinds of the fixed forms, and all kinds, in the order of spans.
KINDS = ("email", "ip", "card", "phone")
ALL = (*KINDS, "secret")
#: What patterns and instances must be sure of.
CONFIDENCE = 0.8
#: Least length of a secret that its name tells; characters in which the name is looked for; a longer word of a pattern
#: stands as its hash.
SECRET_LENGTH, _NAME, _WORD = 16, 48, 64

_BEFORE = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a match can't start inside a run of digits whose start failed, as the rest is the same
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_TOKEN = re.compile(r"\S+")
_SIGN = re.compile(r"[0-9@_]|[=:](?=\s)")
_LETTER = re.compile(r"[A-Za-z]")
_SECRET = re.compile(r"(?i)(?:token|secret|password|passwd|pwd|api[_-]?key|access[_-]?key|private[_-]?key|credential)s?[\"']?\s*+[:=]\s*+[\"']?([A-Za-z0-9_+/.=-]+)")
_EDGE = "\"'`()[]{}<>,;:.!?|#$%&*="


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        v = int(c) * (1 + k % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def _emails(text: str):
    """Leftmost matches, in time proportional to the text: each at sign takes the run before it."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _BEFORE:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            end = m.end()
        at = text.find("@", max(at + 1, end))


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the fixed forms, by kind as listed, then start. Matches that fail their kind's rule are dropped."""
    found = [("email", a, b) for a, b in _emails(text)] if "@" in text else []
    if not _DIGIT.search(text):
        return found
    found += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(p) < 4 and int(p or 0) < 256 for p in (q.lstrip("0") for q in m[0].split(".")))]
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            found.append(("card", *m.span()))
    if "+" in text:
        found += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_DIGIT.findall(m[0])) <= 15]
    return found


def joined(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def _word(word: str) -> str:
    """A word of a pattern: lower-cased, digits as one sign, without marks at its edges unless it is nothing else."""
    word = re.sub(r"[0-9]", "0", (word.strip(_EDGE) or word).lower())
    return word if len(word) <= _WORD else hashlib.md5(word.encode()).hexdigest()


def _before(text: str, at: int) -> tuple[str, int]:
    """The word that ends before a place, and its start; empty at the start of a text."""
    while at > 0 and text[at - 1].isspace():
        at -= 1
    end = at
    while at > 0 and not text[at - 1].isspace():
        at -= 1
    return text[at:end], at


def patterns(text: str, start: int, end: int) -> list[str]:
    """Two words to the left; one to the left and one to the right. Marks that touch the span belong to it."""
    while start > 0 and text[start - 1] in _EDGE:
        start -= 1
    while end < len(text) and text[end] in _EDGE:
        end += 1
    near, at = _before(text, start)
    if not near:
        return []
    far, right = _before(text, at)[0], _TOKEN.search(text, end)
    out = [f"{_word(far)} {_word(near)} _"] if far else []
    return [*out, f"{_word(near)} _ {_word(right[0])}"] if right else out


def candidates(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str | None, int, int]]:
    """Tokens that look like identifiers and touch no base span; those that their name tells are secrets."""
    taken, out = sorted((a, b) for _, a, b in base), []
    k = at = 0
    # each sign leads to its token, or to the one after it; other tokens are never looked at
    while m := _SIGN.search(text, at):
        start = m.start()
        if m[0] in "=:":
            if not (following := _TOKEN.search(text, m.end())):
                break
            start = following.start()
        while start > at and not text[start - 1].isspace():
            start -= 1
        end = at = _TOKEN.match(text, max(start, m.start() if m[0] not in "=:" else start)).end()
        while start < end and text[start] in _EDGE:
            start += 1
        while end > start and text[end - 1] in _EDGE:
            end -= 1
        while k < len(taken) and taken[k][1] <= start:
            k += 1
        if end == start or k < len(taken) and taken[k][0] < end:
            continue
        kind = None
        if end - start >= SECRET_LENGTH and (found := _SECRET.search(text, max(0, start - _NAME), end)) and found.end() == end:
            value = found[1]
            if len(value) >= SECRET_LENGTH and _DIGIT.search(value) and _LETTER.search(value):
                kind, start = "secret", found.start(1)
        out.append((kind, start, end))
    return out


_FOUND = "row long, n_email long, n_ip long, n_card long, n_phone long, base string, links array<struct<kind:string,start:int,end:int,instance:binary,patterns:array<string>>>"


def _scan(batches):
    part, row = TaskContext.get().partitionId(), 0
    for batch in batches:
        for rows in slices(batch, "text"):
            counts, base = {k: [] for k in KINDS}, []
            ends, kinds, starts, stops, instances, held, near = [0], [], [], [], [], [0], []
            for text in texts_of(rows, "text").to_pylist():
                spans = base_spans(text)
                for kind in KINDS:
                    counts[kind].append(sum(s[0] == kind for s in spans))
                base.append(joined(spans))
                for kind, a, b in [*spans, *candidates(text, spans)]:
                    kinds.append(kind), starts.append(a), stops.append(b)
                    instances.append(hashlib.md5(text[a:b].encode()).digest())
                    near += patterns(text, a, b)
                    held.append(len(near))
                ends.append(len(kinds))
            n = rows.num_rows
            each = pa.StructArray.from_arrays(
                [pa.array(kinds, pa.string()), pa.array(starts, pa.int32()), pa.array(stops, pa.int32()), pa.array(instances, pa.binary()), pa.ListArray.from_arrays(pa.array(held, pa.int32()), pa.array(near, pa.string()))],
                names=["kind", "start", "end", "instance", "patterns"],
            )
            names = [c for c in rows.schema.names if c != "text"]
            yield pa.RecordBatch.from_arrays(
                [pa.array((np.int64(part) << np.int64(40)) + row + np.arange(n)), *(pa.array(counts[k], pa.int64()) for k in KINDS), pa.array(base), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), each), *(rows.column(c) for c in names)],
                names=["row", "n_email", "n_ip", "n_card", "n_phone", "base", "links", *names],
            )
            row += n


def bootstrap(edges: DataFrame, seeds: DataFrame, stage: Staged, confidence: float = CONFIDENCE) -> DataFrame:
    """instance, kind, score of all known instances, from distinct (instance, pattern) and the seeds' (instance, kind).

    Each round's tables are written, so that plans stay short and the joins' hot keys can be split."""
    size = stage.write(edges.groupBy("pattern").agg(F.count("*").alias("size")), "sizes")
    known = stage.write(seeds.distinct().withColumn("score", F.lit(1.0)), "known-0")
    first, k = Window.partitionBy("instance").orderBy(F.desc("score"), "kind"), 0
    while True:
        k += 1
        mass = stage.write(edges.join(known, "instance").groupBy("pattern", "kind").agg(F.sum("score").alias("mass")), f"mass-{k}")
        sure = stage.write(mass.join(size, "pattern").select("pattern", "kind", (F.col("mass") / (F.col("size") + 1)).alias("sure")), f"sure-{k}")
        # only instances that a sure pattern holds can become known; their other patterns add to the score
        held = edges.join(sure.where(F.col("sure") >= confidence), "pattern").select("instance", "kind").distinct()
        new = stage.write(held.join(known.select("instance").distinct(), "instance", "left_anti"), f"held-{k}")
        doubt = F.sum(F.log(F.greatest(1 - F.col("sure"), F.lit(1e-9))))
        scored = stage.write(edges.join(new, "instance").join(sure, ["pattern", "kind"]).groupBy("instance", "kind").agg((1 - F.exp(doubt)).alias("score")), f"scored-{k}")
        best = scored.where(F.col("score") >= confidence).withColumn("n", F.row_number().over(first)).where("n = 1").drop("n")
        after = stage.write(known.unionByName(best), f"known-{k}")
        if after.count() == known.count():
            return after
        known = after


def discovered(found: DataFrame, stage: Staged, confidence: float = CONFIDENCE) -> DataFrame:
    """instance, kind of all that the pattern-instance graph is sure of, seeds included: a secret that its name tells in
    one place is one in others too."""
    link = stage.write(found.select(F.explode("links").alias("l")).select("l.instance", "l.kind", "l.patterns").distinct(), "links")
    edges = stage.write(link.select("instance", F.explode("patterns").alias("pattern")).distinct(), "edges")
    seeds = link.where("kind is not null").select("instance", "kind")
    every = bootstrap(edges, seeds, stage, confidence)
    return every.groupBy("instance").agg(F.min_by("kind", F.struct(-F.col("score"), "kind")).alias("new_kind"))


_SPANS = "array<struct<k:int,a:int,b:int>>"


def find_personal(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), confidence: float = CONFIDENCE) -> DataFrame:
    """One row per row: id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added, then the columns of ``keep``.

    base_sha256 and the counts are of the fixed forms; spans (kind:start:end in code points, end exclusive) are theirs
    and those that names and contexts add, by kind in the order of ALL, then start; n_added counts the latter. A null
    text counts as empty; null ids and repeated rows are kept; very long texts are read whole; ties between kinds go to
    the first by name; an empty table gives no rows; columns other than ``keep`` aren't read, and names may clash with
    those of the result.
    """
    stage = Staged(df.sparkSession, "personal")
    graph = Staged(df.sparkSession, "patterns")
    carried = {f"keep_{k}": c for k, c in enumerate(keep)}
    read = df.select(df[id_col].alias("id"), df[text_col].alias("text"), *(df[c].alias(k) for k, c in carried.items()))
    types = "".join(f", {k} {read.schema[k].dataType.simpleString()}" for k in ["id", *carried])
    found = stage.write(read.mapInArrow(trimmed(_scan), _FOUND + types), "found")
    new = stage.write(discovered(found, graph, confidence), "discovered")
    graph.drop()
    place = lambda kind: F.array_position(F.array(*map(F.lit, ALL)), kind).cast("int")
    cand = found.select("row", F.explode("links").alias("l")).where("l.kind is null").select("row", "l.start", "l.end", "l.instance")
    added = cand.join(new, "instance").groupBy("row").agg(F.collect_list(F.struct(place(F.col("new_kind")).alias("k"), F.col("start").alias("a"), F.col("end").alias("b"))).alias("added"))
    # only rows with candidates meet the discoveries; the others, and their texts, aren't shuffled
    any_left, none = F.exists("links", lambda x: x["kind"].isNull()), F.lit(None).cast(_SPANS)
    rows = found.where(~any_left).withColumn("added", none).unionByName(found.where(any_left).join(stage.write(added, "added"), "row", "left"))
    known = F.transform(F.filter("links", lambda x: x["kind"].isNotNull()), lambda x: F.struct(place(x["kind"]).alias("k"), x["start"].alias("a"), x["end"].alias("b")))
    every = F.array_sort(F.concat(known, F.coalesce("added", F.array().cast(_SPANS))))
    named = F.transform(every, lambda s: F.concat_ws(":", F.element_at(F.array(*map(F.lit, ALL)), s["k"]), s["a"], s["b"]))
    return rows.select(
        F.col("id").alias(id_col),
        "n_email",
        "n_ip",
        "n_card",
        "n_phone",
        F.sha2("base", 256).alias("base_sha256"),
        F.array_join(named, ",").alias("spans"),
        (F.size(every) - F.col("n_email") - F.col("n_ip") - F.col("n_card") - F.col("n_phone")).cast("long").alias("n_added"),
        *(F.col(k).alias(c) for k, c in carried.items()),
    )


def _masked(text: str | None, spans: str) -> str | None:
    """The text with each span, or run of overlapping spans, replaced by its first kind in brackets."""
    if not spans or text is None:
        return text
    out, at, until = [], 0, -1
    for a, b, kind in sorted((int(a), int(b), k) for k, a, b in (s.split(":") for s in spans.split(","))):
        if a >= until:
            out.append(text[at:a] if a >= at else "")
            out.append(f"[{kind.upper()}]")
        until = at = max(until, b)
    out.append(text[at:])
    return "".join(out)


def redact(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The table with personal data in texts replaced by the kinds' names; other columns are kept as they are.

    A null text stays null. Rows, null ids and repeats are kept."""
    columns = df.columns
    marked = find_personal(df.toDF(*(f"in_{k}" for k in range(len(columns)))), f"in_{columns.index(id_col)}", f"in_{columns.index(text_col)}", tuple(f"in_{k}" for k in range(len(columns)) if columns[k] != id_col))
    at = f"in_{columns.index(text_col)}"

    def mask(batches):
        for batch in batches:
            texts = [_masked(t, s) for t, s in zip(batch.column(at).to_pylist(), batch.column("spans").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if n == at else batch.column(n) for n in names], names=names)

    names = [f"in_{k}" for k in range(len(columns))]
    schema = ", ".join(f"in_{k} {f.dataType.simpleString()}" for k, f in enumerate(df.schema))
    return marked.select(*names, "spans").mapInArrow(mask, schema).toDF(*columns)


def op8_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in all documents."""
    return find_personal(documents(spark, sf_dir))
