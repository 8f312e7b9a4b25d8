"""Tables of a literature store: column order is the contract."""

from __future__ import annotations

from pyspark.sql.types import ArrayType, BooleanType, FloatType, IntegerType, LongType, StringType, StructField, StructType

#: Columns that aren't strings.
_TYPES = {
    "pub_year": IntegerType(),
    "pub_month": IntegerType(),
    "date_revised": IntegerType(),
    "position": IntegerType(),
    "n_authors": IntegerType(),
    "is_group": BooleanType(),
    "is_first": BooleanType(),
    "is_last": BooleanType(),
    "is_major": BooleanType(),
    "n_papers": LongType(),
    "vector": ArrayType(FloatType()),
}

COLUMNS = {
    "articles": "pmid nlm_id title abstract pub_year pub_month volume issue language doi pmcid status date_revised",
    "journals": "nlm_id medline_ta title iso_abbrev issn_linking country",
    "authors": "author_key display_name last_name fore_name initials orcid is_group",
    "authorships": "pmid author_key position is_first is_last n_authors affiliation country",
    "mesh_headings": "pmid descriptor_ui descriptor_name is_major qualifier_uis",
    "substances": "pmid substance_ui substance_name registry_number",
    "keywords": "pmid term is_major",
    "citations": "citing_pmid cited_pmid",
    "publication_types": "pmid type_ui type_name",
    "grants": "pmid grant_id agency country",
    "databank_links": "pmid databank accession",
    "deleted_pmids": "pmid",
    "vocabulary": "concept_id concept_name kind code n_papers name_lc",
    "synonyms": "synonym concept_id concept_name",
    "mesh_tree": "concept_id tree_number concept_name",
    "docmeta": "pmid title pub_year medline_ta",
    "vectors": "pmid vector",
}
SCHEMAS = {name: StructType([StructField(c, _TYPES.get(c, StringType())) for c in columns.split()]) for name, columns in COLUMNS.items()}

#: What makes a row of a table one row; tables that aren't here are kept as they come, without exact repeats.
KEYS = {
    "articles": ("pmid",),
    "journals": ("nlm_id",),
    "authors": ("author_key",),
    "authorships": ("pmid", "position"),
    "mesh_headings": ("pmid", "descriptor_ui"),
    "substances": ("pmid", "substance_ui"),
    "keywords": ("pmid", "term"),
    "citations": ("citing_pmid", "cited_pmid"),
    "publication_types": ("pmid", "type_ui"),
    "deleted_pmids": ("pmid",),
}
#: The column by which a table's rows belong to an article.
ARTICLE_KEY = {"authorships": "pmid", "mesh_headings": "pmid", "substances": "pmid", "keywords": "pmid", "citations": "citing_pmid", "publication_types": "pmid", "grants": "pmid", "databank_links": "pmid"}
