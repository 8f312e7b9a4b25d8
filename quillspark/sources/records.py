"""Citation records in XML: one nested row for each article, from which all tables are selected.

Mixed content (markup inside titles and abstracts) is beyond Spark's own XML reader, so files are parsed by the standard
library, an element at a time, with memory for one record; a file is a task, and everything after it is plain columns.
"""

from __future__ import annotations

import gc
import gzip
import io
import xml.etree.ElementTree as ET
from collections.abc import Iterable, Iterator
from itertools import accumulate, chain, islice

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from ..functions.text import author_key, country_from_affiliation, orcid, publication_month, publication_year

_LISTS = {
    "abstract": ("label", "body"),
    "authors": ("last", "fore", "initials", "collective", "orcid", "affiliation", "position"),
    "headings": ("ui", "name", "major", "qualifiers"),
    "substances": ("ui", "name", "registry"),
    "keywords": ("term", "major"),
    "types": ("ui", "name"),
    "grants": ("id", "agency", "country"),
    "links": ("databank", "accession"),
    "cites": ("pmid",),
}
_PLAIN = ("kind", "source_file", "pmid", "status", "date_revised", "nlm_id", "medline_ta", "issn_linking", "journal_country", "journal_title", "iso_abbrev", "title", "language", "volume", "issue", "year", "month", "medline_date", "article_year", "doi", "pmcid")
RECORD = StructType(
    [StructField(n, StringType()) for n in _PLAIN]
    + [StructField("ordinal", IntegerType())]
    + [StructField(n, ArrayType(StructType([StructField(f, StringType()) for f in fields]))) for n, fields in _LISTS.items()]
)


def _whole(found: ET.Element | None) -> str | None:
    """All text below an element, stripped; null if there is none."""
    if found is None:
        return None
    # most elements hold nothing but their text
    return ("".join(found.itertext()) if len(found) else found.text or "").strip() or None


def _text(node: ET.Element | None, tag: str) -> str | None:
    """The text of the first element with a tag; single tags are looked up by the parser's own code."""
    return None if node is None else _whole(node.find(tag))


def _every(nodes: Iterable[ET.Element], *path: str) -> list[ET.Element]:
    """All elements at the end of a path of tags."""
    for tag in path:
        nodes = [found for node in nodes for found in node.findall(tag)]
    return nodes


def _among(nodes: list[ET.Element], tag: str) -> str | None:
    """The text of the first element with a tag below any of the nodes."""
    for node in nodes:
        if (found := node.find(tag)) is not None:
            return _whole(found)
    return None


def article(node: ET.Element) -> dict | None:
    """The nested row of an article; null without an id. An article's own identifiers are those of its own list, not of
    the works that it cites."""
    cite = node.find("MedlineCitation")
    pmid = _text(cite, "PMID")
    if pmid is None:
        return None
    art, journal, data = cite.find("Article"), cite.find("MedlineJournalInfo"), node.findall("PubmedData")
    arts = [art] if art is not None else []
    journals = _every(arts, "Journal")
    issues = _every(journals, "JournalIssue")
    dates = _every(issues, "PubDate")
    own = {i.get("IdType"): _whole(i) for i in _every(data, "ArticleIdList", "ArticleId")}
    # the place in the list counts people who can't be told by a key as well
    authors = []
    for k, a in enumerate(_every(arts, "AuthorList", "Author"), 1):
        iD = next((_whole(i) for i in a.findall("Identifier") if i.get("Source") == "ORCID"), None)
        authors.append({"last": _text(a, "LastName"), "fore": _text(a, "ForeName"), "initials": _text(a, "Initials"), "collective": _text(a, "CollectiveName"), "orcid": iD, "affiliation": _among(a.findall("AffiliationInfo"), "Affiliation"), "position": str(k)})
    each = lambda *path: _every([cite], *path)
    cited = [_whole(i) for d in data for i in d.findall("ReferenceList//Reference/ArticleIdList/ArticleId") if i.get("IdType") == "pubmed"]
    return {
        "kind": "article",
        "pmid": pmid,
        "status": cite.get("Status"),
        "date_revised": _among(cite.findall("DateRevised"), "Year"),
        "nlm_id": _text(journal, "NlmUniqueID"),
        "medline_ta": _text(journal, "MedlineTA"),
        "issn_linking": _text(journal, "ISSNLinking"),
        "journal_country": _text(journal, "Country"),
        "journal_title": _among(journals, "Title"),
        "iso_abbrev": _among(journals, "ISOAbbreviation"),
        "title": _text(art, "ArticleTitle"),
        "language": _text(art, "Language"),
        "volume": _among(issues, "Volume"),
        "issue": _among(issues, "Issue"),
        "year": _among(dates, "Year"),
        "month": _among(dates, "Month"),
        "medline_date": _among(dates, "MedlineDate"),
        "article_year": _among(_every(arts, "ArticleDate"), "Year"),
        "doi": own.get("doi"),
        "pmcid": own.get("pmc"),
        "abstract": [{"label": t.get("Label"), "body": _whole(t)} for t in _every(arts, "Abstract", "AbstractText")],
        "authors": authors,
        "headings": [{"ui": d.get("UI"), "name": _whole(d), "major": "1" if d.get("MajorTopicYN") == "Y" else "0", "qualifiers": "|".join(q.get("UI") or "" for q in h.findall("QualifierName")) or None} for h in each("MeshHeadingList", "MeshHeading") for d in h.findall("DescriptorName")[:1]],
        "substances": [{"ui": n.get("UI"), "name": _whole(n), "registry": _text(c, "RegistryNumber")} for c in each("ChemicalList", "Chemical") for n in c.findall("NameOfSubstance")[:1]],
        "keywords": [{"term": _whole(k), "major": "1" if k.get("MajorTopicYN") == "Y" else "0"} for k in each("KeywordList", "Keyword") if _whole(k)],
        "types": [{"ui": t.get("UI"), "name": _whole(t)} for t in _every(arts, "PublicationTypeList", "PublicationType")],
        "grants": [{"id": _text(g, "GrantID"), "agency": _text(g, "Agency"), "country": _text(g, "Country")} for g in _every(arts, "GrantList", "Grant")],
        "links": [{"databank": _text(d, "DataBankName"), "accession": _whole(x)} for d in _every(arts, "DataBankList", "DataBank") for x in _every([d], "AccessionNumberList", "AccessionNumber")],
        "cites": [{"pmid": c} for c in dict.fromkeys(cited) if c],
    }


def _elements(data: bytes, tags: set[str]) -> Iterator[ET.Element]:
    """Elements with one of the tags, each emptied once it has been used."""
    stream = io.BytesIO(data)
    opened = gzip.open(stream) if data[:2] == b"\x1f\x8b" else stream
    parser = ET.XMLPullParser(("end",))
    while chunk := opened.read(1 << 16):
        parser.feed(chunk)
        for _, el in parser.read_events():
            if el.tag in tags:
                yield el
                el.clear()
    parser.close()


def records(path: str, data: bytes) -> Iterator[dict]:
    """Rows of a file; what a row doesn't name is null, or an empty list."""
    name, ordinal = path.rsplit("/", 1)[-1], 0
    for el in _elements(data, {"PubmedArticle", "DeleteCitation"}):
        rows = [article(el)] if el.tag == "PubmedArticle" else [{"kind": "delete", "pmid": _whole(p)} for p in el.findall("PMID")]
        for row in filter(None, rows):
            ordinal += 1
            yield row | {"source_file": name, "ordinal": ordinal}


def _batch(rows: list[dict]) -> pa.RecordBatch:
    """Rows as columns; a list's elements are laid end to end, field by field."""
    strings = lambda values: pa.array(values, pa.string())
    columns = [strings([r.get(n) for r in rows]) for n in _PLAIN] + [pa.array([r["ordinal"] for r in rows], pa.int32())]
    for name, fields in _LISTS.items():
        lists = [r.get(name, ()) for r in rows]
        ends, flat = pa.array(accumulate(map(len, lists), initial=0), pa.int32()), list(chain.from_iterable(lists))
        whole = pa.StructArray.from_arrays([strings([x[f] for x in flat]) for f in fields], names=fields)
        columns.append(pa.ListArray.from_arrays(ends, whole))
    return pa.RecordBatch.from_arrays(columns, names=RECORD.names)


def parsed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of nested rows from batches of path and content."""
    gc.disable()  # elements and rows hold no cycles, and looking for some takes a quarter of the time
    try:
        for batch in batches:
            for path, content in zip(batch.column("path"), batch.column("content"), strict=True):
                rows = records(path.as_py(), content.as_py())
                while held := list(islice(rows, 500)):
                    yield _batch(held)
    finally:
        gc.enable()


def read_records(spark: SparkSession, path: str, pattern: str = "*.xml*", parts: int | None = None) -> DataFrame:
    """Nested rows of all files, dealt out after parsing, as a compressed file can't be split."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path).select("path", "content")
    rows = files.mapInArrow(parsed, RECORD)
    return rows.repartition(parts) if parts else rows


def landed(rows: DataFrame, path: str) -> DataFrame:
    """The same rows, written once: tables that are made of them read the columns they need and parse no file again."""
    rows.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return rows.sparkSession.read.schema(RECORD).parquet(path)


def tables_of(rows: DataFrame) -> dict[str, DataFrame]:
    """The tables of the nested rows; each keeps source_file and ordinal, which order versions."""
    order = ["source_file", "ordinal"]
    art = rows.where("kind = 'article'")
    body = F.transform(F.filter("abstract", lambda p: p["body"].isNotNull()), lambda p: F.when(p["label"].isNotNull(), F.concat(p["label"], F.lit(": "), p["body"])).otherwise(p["body"]))

    def each(name: str, *columns) -> DataFrame:
        return art.select("pmid", F.explode(name).alias("x"), *order).select(*columns, *order)

    x = lambda f: F.col(f"x.{f}")
    who = art.select("pmid", F.size("authors").alias("n"), F.explode("authors").alias("x"), *order)
    key = author_key(orcid(x("orcid")), x("last"), x("initials"), x("fore"))
    group = x("collective").isNotNull() & x("last").isNull()
    who = who.withColumns({"key": F.when(group, F.concat(F.lit("group:"), F.lower(x("collective")))).otherwise(key), "group": group, "place": x("position").cast("int")}).where("key is not null")
    shown = F.array_join(F.array_compact(F.array(F.coalesce(F.nullif(x("fore"), F.lit("")), F.nullif(x("initials"), F.lit(""))), F.nullif(x("last"), F.lit("")))), " ")
    return {
        "articles": art.select("pmid", "nlm_id", "title", F.nullif(F.array_join(body, " "), F.lit("")).alias("abstract"), publication_year(F.col("year"), F.col("medline_date"), F.col("article_year")).alias("pub_year"), publication_month(F.col("month")).alias("pub_month"), "volume", "issue", "language", "doi", "pmcid", "status", F.col("date_revised").try_cast("int").alias("date_revised"), *order),
        "journals": art.where("nlm_id is not null").select("nlm_id", "medline_ta", F.col("journal_title").alias("title"), "iso_abbrev", "issn_linking", F.col("journal_country").alias("country"), *order),
        "authors": who.select(F.col("key").alias("author_key"), F.when(F.col("group"), x("collective")).otherwise(shown).alias("display_name"), x("last").alias("last_name"), x("fore").alias("fore_name"), x("initials").alias("initials"), orcid(x("orcid")).alias("orcid"), F.col("group").alias("is_group"), *order),
        "authorships": who.select("pmid", F.col("key").alias("author_key"), F.col("place").alias("position"), (F.col("place") == 1).alias("is_first"), ((F.col("n") > 1) & (F.col("place") == F.col("n"))).alias("is_last"), F.col("n").alias("n_authors"), x("affiliation").alias("affiliation"), country_from_affiliation(x("affiliation")).alias("country"), *order),
        "mesh_headings": each("headings", "pmid", x("ui").alias("descriptor_ui"), x("name").alias("descriptor_name"), (x("major") == "1").alias("is_major"), x("qualifiers").alias("qualifier_uis")),
        "substances": each("substances", "pmid", x("ui").alias("substance_ui"), x("name").alias("substance_name"), x("registry").alias("registry_number")),
        "keywords": each("keywords", "pmid", x("term").alias("term"), (x("major") == "1").alias("is_major")),
        "citations": each("cites", F.col("pmid").alias("citing_pmid"), x("pmid").alias("cited_pmid")),
        "publication_types": each("types", "pmid", x("ui").alias("type_ui"), x("name").alias("type_name")),
        "grants": each("grants", "pmid", x("id").alias("grant_id"), x("agency").alias("agency"), x("country").alias("country")),
        "databank_links": each("links", "pmid", x("databank").alias("databank"), x("accession").alias("accession")),
        "deleted_pmids": rows.where("kind = 'delete'").select("pmid", *order),
    }


def _concepts(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = ["concept_id", "concept_name", "terms", "trees"]
    for frame in frames:
        for content in frame["content"]:
            held = []
            for el in _elements(bytes(content), {"DescriptorRecord"}):
                terms = [t for t in dict.fromkeys((_whole(t) or "").lower() for t in el.findall(".//Term/String")) if t]
                held.append((_text(el, "DescriptorUI"), _among(el.findall("DescriptorName"), "String"), terms, [_whole(t) for t in el.findall("TreeNumberList/TreeNumber")]))
                if len(held) == 500:
                    yield pd.DataFrame(held, columns=columns)
                    held = []
            if held:
                yield pd.DataFrame(held, columns=columns)


def read_taxonomy(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """synonyms and mesh_tree of a descriptor file, compressed or not."""
    files = spark.read.format("binaryFile").load(path).select("content")
    rows = files.mapInPandas(_concepts, "concept_id string, concept_name string, terms array<string>, trees array<string>").where("concept_id is not null")
    return {
        "synonyms": rows.select(F.explode("terms").alias("synonym"), "concept_id", "concept_name"),
        "mesh_tree": rows.select("concept_id", F.explode("trees").alias("tree_number"), "concept_name"),
    }
