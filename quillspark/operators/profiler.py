"""Profiles of unknown markup: paths, coverage, repetition, and a proposed mapping to canonical slots."""

from __future__ import annotations

import hashlib
import io
import re
import xml.etree.ElementTree as ET
from collections import Counter
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Every STRIDE-th record is profiled by default in other tools; here stride is an argument of ``profile``.
STRIDE = 13
#: Attributes that say nothing of content, and the canonical slots with the names under which they are
#: usually found, best first.
SKIPPED_ATTRIBUTES = frozenset({"UI", "Version", "ValidYN", "CompleteYN", "MajorTopicYN"})
SLOTS = {
    "document.id": ["pmid", "id", "nct_id", "accession", "docid", "identifier"],
    "document.title": ["articletitle", "title", "brief_title", "official_title", "name"],
    "document.text": ["abstracttext", "abstract", "brief_summary", "description", "detailed_description", "textblock", "summary"],
    "document.date": ["pubdate", "start_date", "date", "completion_date", "date_revised", "effective_time"],
    "document.language": ["language", "lang"],
    "document.type": ["publicationtype", "study_type", "doc_type", "type"],
    "person.name": ["lastname", "forename", "author", "last_name", "first_name", "investigator", "overall_official", "collectivename"],
    "person.identifier": ["orcid", "identifier"],
    "org.name": ["affiliation", "agency", "sponsor", "facility", "institution", "labeler", "manufacturer"],
    "org.country": ["country", "nation"],
    "substance.name": ["nameofsubstance", "intervention_name", "drug", "substance", "activeingredient", "genericname", "brandname"],
    "substance.code": ["registrynumber", "unii", "rxcui", "cas", "ndc"],
    "condition.name": ["descriptorname", "condition", "indication", "mesh_term", "keyword"],
    "venue.name": ["journal", "title", "medlineta", "source", "registry"],
}
#: Attributes of pages that only lay them out.
LAYOUT_ATTRIBUTES = frozenset({"class", "style", "id", "lang", "dir"})


def detect(head: str) -> dict:
    """Document type, public id, root element and default namespace from the beginning of a file."""
    head = head[:200_000]
    doctype = re.search(r"<!DOCTYPE\s+([\w:.-]+)(?:\s+PUBLIC\s+[\"']([^\"']*)[\"'])?", head)
    body = re.sub(r"(?s)<\?.*?\?>|<!--.*?-->|<!DOCTYPE[^>\[]*(?:\[.*?\])?[^>]*>", "", head)
    root = re.search(r"<([\w:.-]+)([^>]*)>", body)
    space = re.search(r"\bxmlns=[\"']([^\"']*)[\"']", root[2]) if root else None
    return {"doctype": doctype[1] if doctype else None, "public_id": doctype[2] if doctype else None, "root": root[1] if root else None, "namespace": space[1] if space else None}


def record_tag(xml: bytes, starts: int = 20_000) -> str | None:
    """The commonest element just below the root."""
    depth, seen, found = 0, 0, Counter()
    for event, el in ET.iterparse(io.BytesIO(xml), events=("start", "end")):
        if event == "start":
            depth += 1
            seen += 1
            if depth == 2:
                found[el.tag.rpartition("}")[2]] += 1
            if seen >= starts:
                break
        else:
            depth -= 1
    return min(found, key=lambda t: (-found[t], t)) if found else None


class _Paths(HTMLParser):
    """Paths of elements and attributes of one record, with the text found right below each."""

    _EMPTY = frozenset("area base br col embed hr img input link meta source track wbr".split())

    def __init__(self):
        super().__init__()
        self.stack, self.found = [], []

    def handle_starttag(self, tag, attrs):
        path = "/".join([*self.stack, tag])
        self.found.append([path, ""])
        self.found += [[f"{path}@{k}", v or ""] for k, v in attrs if k not in LAYOUT_ATTRIBUTES]
        if tag not in self._EMPTY:
            self.stack.append(tag)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in self._EMPTY:
            self.stack.pop()

    def handle_endtag(self, tag):
        if tag in self.stack:
            while self.stack.pop() != tag:
                pass

    def handle_data(self, data):
        path = "/".join(self.stack)
        for item in reversed(self.found):
            if item[0] == path:
                item[1] += data
                break


def _html_paths(text: str | None) -> list[tuple[str, str]]:
    parser = _Paths()
    parser.feed(text or "")
    parser.close()
    return [(p, t.strip()) for p, t in parser.found]


def _xml_paths(text: str) -> list[tuple[str, str]]:
    out = []

    def walk(el, path):
        out.append((path, (el.text or "").strip()))
        out.extend((f"{path}@{k.rpartition('}')[2]}", v) for k, v in el.attrib.items() if k not in SKIPPED_ATTRIBUTES)
        for child in el:
            walk(child, f"{path}/{child.tag.rpartition('}')[2]}" if path else child.tag.rpartition("}")[2])

    walk(ET.fromstring(text), "")
    return [(p, t) for p, t in out if p]


def profile(df: DataFrame, id_col: str, text_col: str, kind: str = "xml", stride: int = 1, max_records: int | None = None) -> DataFrame:
    """path, records, coverage (per cent of records), repeats (per cent of those with the path more than once), most (the
    largest number in a record), mean_length of non-empty texts, samples (up to three texts, the first in order): one
    row for each path. stride profiles every so many records by id, max_records only so many of these, the first by id."""
    parse = {"xml": _xml_paths, "html": _html_paths}[kind]
    rows = df.where(F.col(id_col) % stride == 0) if stride > 1 else df
    rows = rows.orderBy(id_col).limit(max_records) if max_records else rows

    def run(batches):
        for batch in batches:
            ids, paths, n, texts, lengths = [], [], [], [], []
            for record, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                by: dict[str, list[str]] = {}
                for path, found in parse(text):
                    by.setdefault(path, []).append(found)
                for path, found in by.items():
                    full = [t for t in found if t]
                    ids.append(record), paths.append(path), n.append(len(found))
                    texts.append(min(full)[:80] if full else None), lengths.append(sum(map(len, full)) / len(full) if full else None)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.string()), pa.array(paths, pa.string()), pa.array(n, pa.int64()), pa.array(texts, pa.string()), pa.array(lengths, pa.float64())], names=["id", "path", "n", "sample", "length"])

    found = rows.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, "id string, path string, n long, sample string, length double")
    counts = found.groupBy("path").agg(F.count("*").alias("records"), F.round(100.0 * F.count_if(F.col("n") > 1) / F.count("*"), 1).alias("repeats"), F.max("n").alias("most"), F.round(F.avg("length"), 1).alias("mean_length"))
    first = Window.partitionBy("path").orderBy("sample")
    few = found.where("sample is not null").select("path", "sample").distinct().withColumn("k", F.row_number().over(first)).where("k <= 3")
    samples = few.groupBy("path").agg(F.array_sort(F.collect_list("sample")).alias("samples"))  # three at most
    total = rows.agg(F.count("*").alias("total"))
    out = counts.join(samples, "path", "left").join(F.broadcast(total))
    return out.select("path", "records", F.round(100.0 * F.col("records") / F.col("total"), 1).alias("coverage"), "repeats", "most", "mean_length", F.coalesce("samples", F.array().cast("array<string>")).alias("samples"))


def profile_pages(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return profile(df, id_col, text_col, "html")


def fingerprint(paths: list[dict]) -> str:
    """16 hex digits that stay the same for files of one layout: the first 40 of the common paths, sorted."""
    common = sorted(p["path"] for p in paths if p["coverage"] > 50)[:40]
    return hashlib.sha1("\n".join(common).encode()).hexdigest()[:16]


def propose(paths: list[dict], least: float = 2.0) -> dict[str, dict]:
    """The best path for each slot: by the rank of the name that its last element matches, then by coverage."""
    used, out = set(), {}
    for slot, names in SLOTS.items():
        best = None
        for p in paths:
            leaf = re.split(r"[/@]", p["path"])[-1].lower()
            if p["path"] in used or p["coverage"] < least:
                continue
            exact = names.index(leaf) if leaf in names else None
            inside = next((k + 6 for k, name in enumerate(names) if len(name) > 5 and name in leaf), None)
            rank = exact if exact is not None else inside
            if rank is not None and (score := (100 - 12 * rank + p["coverage"] / 10, p["path"])) > (best or (0, ""))[:2]:
                best = (*score, p)
        if best and best[0] > 0:
            used.add(best[2]["path"])
            out[slot] = {"path": best[2]["path"], "coverage": best[2]["coverage"], "repeating": best[2]["repeats"] > 5, "score": round(best[0], 1)}
    return out


def to_yaml(about: dict, mapping: dict[str, dict], paths: list[dict], least: float = 20.0) -> str:
    """The proposal as YAML, with paths of some coverage that no slot took."""
    quote = lambda s: '"' + str(s).replace("\\", "\\\\").replace('"', '\\"') + '"'
    lines = ["source:"] + [f"  {k}: {quote(v) if v is not None else 'null'}" for k, v in about.items()] + ["mapping:"]
    for slot, m in mapping.items():
        lines += [f"  {slot}:", f"    path: {quote(m['path'])}", f"    coverage: {m['coverage']}", f"    repeating: {str(m['repeating']).lower()}"]
    taken = {m["path"] for m in mapping.values()}
    rest = sorted((p for p in paths if p["path"] not in taken and p["coverage"] >= least), key=lambda p: (-p["coverage"], p["path"]))
    return "\n".join(lines + ["unmapped:"] + [f"  - {quote(p['path'])}" for p in rest]) + "\n"
