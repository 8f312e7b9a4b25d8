"""DuckDB SQL for the registered queries, over the same views."""

from __future__ import annotations

import re

from ..adapter import VIEWS
from ..operators.analytics import CAVEATS
from ..operators.concepts import EXACT, INSIDE, LEADING, VARIANT, _grams, spellings
from ..operators.retrieval import B, K1, RRF
from ..operators.retrieval import STOP_WORDS as STOP
from ..operators.sqlforms import MORE, SQL
from ..schema import KEYS
from .routes import routes

_EXTRA = {
    "vocabulary": """
        SELECT descriptor_ui AS concept_id, descriptor_name AS concept_name, 'mesh' AS kind, CAST(NULL AS VARCHAR) AS code, count(DISTINCT pmid) AS n_papers, lower(descriptor_name) AS name_lc FROM mesh_headings GROUP BY 1, 2
        UNION ALL
        SELECT substance_ui, substance_name, 'substance', min(nullif(registry_number, '0')), count(DISTINCT pmid), lower(substance_name) FROM substances GROUP BY 1, 2
        UNION ALL
        SELECT concat('kw:', lower(trim(term))), lower(trim(term)), 'keyword', NULL, count(DISTINCT pmid), lower(trim(term)) FROM keywords WHERE length(trim(term)) > 2 GROUP BY lower(trim(term)) HAVING count(DISTINCT pmid) >= 2""",
    "lookup": """
        SELECT * FROM vocabulary
        UNION ALL
        SELECT s.concept_id, min(s.concept_name), 'mesh-synonym', NULL, max(v.n_papers), s.synonym FROM synonyms s
        JOIN (SELECT concept_id, max(n_papers) AS n_papers FROM vocabulary WHERE kind = 'mesh' GROUP BY 1) v ON s.concept_id = v.concept_id GROUP BY s.concept_id, s.synonym""",
}


def _with(body: str, **more: str) -> str:
    """The query with the views it uses, and what those use, as common table expressions."""
    known, need, todo = VIEWS | _EXTRA | more, [], [body]
    while todo:
        text = todo.pop()
        for name in known:
            if name not in need and re.search(rf"\b(?:FROM|JOIN)\s+\(?{name}\b", text):
                need.append(name)
                todo.append(known[name])
    order = [n for n in known if n in need]
    clause = ", ".join(f"{n} AS ({known[n]})" for n in order)
    return f"WITH {clause} {body}" if clause else body


def all_of(topic, other, author, journal, pmid, ids, text, sentence, search) -> dict[str, str]:
    below = f"""SELECT DISTINCT b.concept_id FROM mesh_tree r JOIN mesh_tree b ON b.tree_number = r.tree_number OR starts_with(b.tree_number, concat(r.tree_number, '.')) WHERE r.concept_id = '{topic}'"""
    scope = "SELECT pmid FROM mesh_headings WHERE descriptor_ui IN (SELECT concept_id FROM below) UNION SELECT pmid FROM substances WHERE substance_ui IN (SELECT concept_id FROM below)"
    keyword = f"SELECT DISTINCT pmid FROM keywords WHERE concat('kw:', lower(trim(term))) = '{other}'"
    scoped = "SELECT * FROM articles WHERE pmid IN (SELECT pmid FROM scope)"
    base = {"below": below, "scope": scope, "scoped": scoped, "second": keyword}
    jr = "(SELECT nlm_id, medline_ta, title AS journal_title, country AS journal_country FROM journals)"
    q = lambda body, **more: _with(body, **(base | more))

    def people(source: str, where: str, and_country: str = "TRUE") -> str:
        return q(
            f"""SELECT *, CAST(n_papers + 1.5e0 * n_first + 2e0 * n_last + 1e0 * n_recent AS DOUBLE) AS score FROM (
            SELECT s.author_key, max(p.display_name) AS display_name, max(p.orcid) AS orcid, count(DISTINCT s.pmid) AS n_papers,
                   count(*) FILTER (WHERE is_first) AS n_first, count(*) FILTER (WHERE is_last) AS n_last, max(a.pub_year) AS latest_year,
                   max(s.country) AS main_country, arg_max(s.affiliation, concat(CAST(a.pub_year AS VARCHAR), s.pmid, s.affiliation)) AS affiliation,
                   count(*) FILTER (WHERE a.pub_year >= 2000) AS n_recent
            FROM authorships s JOIN (SELECT pmid, pub_year FROM {source} WHERE {where}) a ON s.pmid = a.pmid JOIN authors p ON s.author_key = p.author_key
            WHERE NOT p.is_group AND {and_country} GROUP BY s.author_key) ORDER BY score DESC, n_papers DESC, author_key LIMIT 20"""
        )

    def journals(source: str) -> str:
        return f"SELECT j.medline_ta, j.journal_country AS country, count(*) AS n_papers, min(j.journal_title) AS title FROM {source} a LEFT JOIN {jr} j ON a.nlm_id = j.nlm_id GROUP BY 1, 2"

    def drugs(source: str, where: str, limit: int) -> str:
        return q(f"SELECT substance_name, registry_number, substance_ui, count(DISTINCT pmid) AS n_papers FROM substances WHERE {where} AND pmid IN (SELECT pmid FROM {source}) GROUP BY 1, 2, 3 ORDER BY n_papers DESC, substance_ui, substance_name LIMIT {limit}")

    snippet = "CASE WHEN length(a.abstract) > 300 THEN concat(substring(a.abstract, 1, 300), '…') ELSE a.abstract END AS snippet"

    def papers(where: str) -> str:
        return q(f"SELECT a.pmid, a.title, a.pub_year, j.medline_ta, a.doi, a.pmcid, {snippet} FROM scoped a LEFT JOIN {jr} j ON a.nlm_id = j.nlm_id WHERE {where} ORDER BY a.pub_year DESC NULLS FIRST, a.pmid LIMIT 50")

    def quantile(share: float) -> str:
        return f"SELECT min(pub_year) FROM (SELECT pub_year, sum(count(*)) OVER (ORDER BY pub_year) AS upto, sum(count(*)) OVER () AS n FROM articles WHERE pub_year IS NOT NULL GROUP BY pub_year) WHERE upto > floor((n - 1) * {share}e0 + 0.5e0)"

    def resolved(limit: int) -> str:
        hits = " UNION ALL ".join(
            f"SELECT *, n_papers * CASE WHEN name_lc = '{s}' THEN {EXACT}e0 WHEN starts_with(name_lc, '{s}') THEN {LEADING}e0 ELSE {INSIDE}e0 END * {1.0 if k == 0 else VARIANT}e0 AS score FROM lookup WHERE contains(name_lc, '{s}')" for k, s in enumerate(spellings(text))
        )
        return f"SELECT concept_id, concept_name, kind, code, n_papers, score FROM (SELECT *, row_number() OVER (PARTITION BY concept_id ORDER BY score DESC, kind, name_lc, concept_name) AS k FROM ({hits})) WHERE k = 1 ORDER BY score DESC, concept_id LIMIT {limit}"

    def spotted(sentence: str, limit: int) -> str:
        rows = ", ".join(f"('{g}', {n}, {i})" for g, n, i in _grams(sentence)) or "(NULL, 0, 0)"
        index = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY name_lc ORDER BY n_papers DESC NULLS LAST, concept_id, kind) AS k FROM lookup) WHERE k = 1"
        return f"SELECT concept_id, concept_name, kind, code, n_papers, matched, words FROM (SELECT i.* EXCLUDE (k), g.matched, g.words, row_number() OVER (PARTITION BY concept_id ORDER BY words DESC, place) AS k FROM ({index}) i JOIN (SELECT CAST(a AS VARCHAR) AS matched, CAST(b AS INT) AS words, c AS place FROM (VALUES {rows}) t(a, b, c)) g ON i.name_lc = g.matched) WHERE k = 1 ORDER BY words DESC, n_papers DESC, concept_id LIMIT {limit}"

    terms = ", ".join(f"'{w}'" for w in search.split())
    stop = ", ".join(f"'{w}'" for w in STOP)
    indexed = lambda doc, table: f"SELECT doc, term, count(*) AS tf FROM (SELECT {doc} AS doc, unnest(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]{{2,}}')) AS term FROM {table}) WHERE term NOT IN ({stop}) GROUP BY 1, 2"
    words = indexed("CAST(doc_id AS VARCHAR)", "documents")
    bm25 = f"""SELECT w.doc, sum(ln(1 + (c.n - d.df + 0.5e0) / (d.df + 0.5e0)) * w.tf / (w.tf + {K1}e0 * (1 - {B}e0 + {B}e0 * l.dl / c.avgdl))) AS score
        FROM words w JOIN (SELECT term, count(*) AS df FROM words GROUP BY 1) d ON w.term = d.term JOIN (SELECT doc, sum(tf) AS dl FROM words GROUP BY 1) l ON w.doc = l.doc,
             (SELECT count(*) AS n, avg(dl) AS avgdl FROM (SELECT sum(tf) AS dl FROM words GROUP BY doc)) c
        WHERE w.term IN ({terms}) GROUP BY w.doc ORDER BY score DESC, w.doc"""
    near = "SELECT CAST(e.vec_id AS VARCHAR) AS doc, list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(z.embedding AS DOUBLE[])) AS score FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) z ORDER BY score DESC, doc"
    fused = lambda n: f"""SELECT doc, round(sum(part), 8) AS score FROM (
        SELECT doc, 1e0 / ({RRF} + row_number() OVER (ORDER BY score DESC, doc)) AS part FROM (SELECT * FROM ({bm25}) LIMIT 40)
        UNION ALL SELECT doc, 1e0 / ({RRF} + row_number() OVER (ORDER BY score DESC, doc)) FROM (SELECT * FROM ({near}) LIMIT 40)) GROUP BY doc ORDER BY sum(part) DESC, doc LIMIT {n}"""  # noqa: E731
    whole = """SELECT a.pmid, concat(coalesce(j.medline_ta, ''), ' (', coalesce(CAST(a.pub_year AS VARCHAR), 'n.d.'), '). ', coalesce(a.title, ''), chr(10), coalesce(m.names, ''), ' ', coalesce(s.names, ''), chr(10), a.abstract) AS text
            FROM articles a LEFT JOIN journals j ON a.nlm_id = j.nlm_id LEFT JOIN (SELECT pmid, string_agg(descriptor_name, '; ' ORDER BY descriptor_name) AS names FROM mesh_headings GROUP BY 1) m ON a.pmid = m.pmid
            LEFT JOIN (SELECT pmid, string_agg(substance_name, '; ' ORDER BY substance_name) AS names FROM substances GROUP BY 1) s ON a.pmid = s.pmid WHERE a.abstract IS NOT NULL"""
    # the records of the generated files: newest versions, without the deleted ones
    kept = "SELECT *, o_orderkey % 50 = 0 AS newer FROM orders WHERE o_orderkey % 101 <> 0"
    tables = ("articles", "journals", "authors", "authorships", "mesh_tree", "mesh_headings", "substances", "keywords", "citations", "publication_types", "grants", "databank_links", "synonyms", "deleted_pmids", "vectors", "vocabulary")
    listed = " UNION ALL ".join(f"SELECT '{t}' AS \"table\", count(*) AS n_rows FROM {t}" for t in tables)
    listed += " UNION ALL SELECT 'document_texts', count(*) FROM documents UNION ALL SELECT 'document_postings', count(*) FROM words UNION ALL SELECT 'document_lengths', count(DISTINCT doc) FROM words UNION ALL SELECT 'postings', count(*) FROM own_words UNION ALL SELECT 'lengths', count(DISTINCT doc) FROM own_words"
    keyed = " UNION ALL ".join(f"SELECT '{t}' AS \"table\", count(*) AS n_rows, count(DISTINCT ({', '.join(k)},)) AS n_keys FROM {t}" for t, k in KEYS.items())
    path = "MedlineCitation"
    leaves = {p: 1 for p in ("PMID", "DateRevised", "DateRevised/Year", "Article", "Article/Journal", "Article/Journal/JournalIssue", "Article/Journal/JournalIssue/PubDate", "Article/Journal/JournalIssue/PubDate/Year", "Article/Journal/JournalIssue/PubDate/Month", "Article/Journal/Title", "Article/ArticleTitle", "Article/ArticleTitle/i", "Article/Abstract", "Article/Abstract/AbstractText", "Article/Abstract/AbstractText@Label", "Article/AuthorList", "Article/AuthorList/Author/LastName", "Article/AuthorList/Author/ForeName", "Article/AuthorList/Author/CollectiveName", "Article/Language", "MedlineJournalInfo", "MedlineJournalInfo/MedlineTA", "MedlineJournalInfo/NlmUniqueID")} | {"Article/AuthorList/Author": 2}
    profiled = ", ".join(f"('{path}/{p}', {n})" for p, n in leaves.items())
    in_ids = ", ".join(f"'{i}'" for i in ids)
    count = lambda t, of="*": f"(SELECT count({of}) FROM {t})"
    return {
        "kol_rank": people("scoped", "pub_year >= 1997"),
        "kol_rank_country": people("articles", "TRUE", "contains(lower(s.country), 'nation_1')"),
        "journal_counts": q(journals("articles") + " ORDER BY n_papers DESC, 1 NULLS FIRST, 2 NULLS FIRST LIMIT 25"),
        "journal_counts_topic": q(journals("(SELECT * FROM scoped WHERE pub_year >= 1997)") + " ORDER BY n_papers DESC, 1 NULLS FIRST, 2 NULLS FIRST LIMIT 25"),
        "journal_totals": q(f"SELECT count(*) AS total_journals, CAST(coalesce(sum(n_papers), 0) AS BIGINT) AS total_papers FROM ({journals('scoped')})"),
        "drug_counts": drugs("scoped", f"registry_number IS NOT NULL AND registry_number <> '0' AND substance_ui <> '{topic}'", 25),
        "drug_counts_all": drugs("articles", "TRUE", 40),
        "country_counts": q("SELECT country, count(DISTINCT pmid) AS n_papers FROM authorships WHERE country <> '' AND pmid IN (SELECT pmid FROM articles) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 25"),
        "institution_counts": q("SELECT institution, count(DISTINCT pmid) AS n_papers FROM (SELECT pmid, trim(list_filter(string_split(affiliation, ','), lambda x: regexp_matches(x, '(?i)University|Universit|Institut|Hospital|College|Center|Centre|School|Clinic'))[1]) AS institution FROM authorships) WHERE institution <> '' AND pmid IN (SELECT pmid FROM scope) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 25"),
        "study_type_counts": q("SELECT type_name, count(DISTINCT pmid) AS n_papers FROM publication_types WHERE pmid IN (SELECT pmid FROM scoped) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20"),
        "year_trend": q("SELECT pub_year, count(*) AS n_papers FROM scoped WHERE pub_year IS NOT NULL GROUP BY 1 ORDER BY 1"),
        "corpus_profile": q(f"""SELECT count(*) AS articles, count(abstract) AS with_abstract, min(pub_year) AS first_year, max(pub_year) AS last_year, ({quantile(0.025)}) AS core_first_year, ({quantile(0.975)}) AS core_last_year,
            {count('journals')} AS journals, {count('authors')} AS authors, {count('authorships')} AS authorships, {count('citations')} AS citations, {count('substances')} AS substance_rows, {count('vocabulary')} AS concepts, {count('vocabulary', 'DISTINCT concept_id')} AS distinct_concepts FROM articles"""),
        "core_years": q(quantile(0.99).replace("min(pub_year)", "min(pub_year) AS year", 1)),
        "papers_drilldown": papers(f"j.medline_ta = '{journal}'"),
        "papers_of_author": papers(f"a.pub_year >= 1998 AND a.pmid IN (SELECT pmid FROM authorships WHERE author_key = '{author}')"),
        "papers_by_ids": q(f"SELECT a.pmid, a.title, a.pub_year, j.medline_ta, a.doi, a.pmcid, a.abstract FROM articles a LEFT JOIN {jr} j ON a.nlm_id = j.nlm_id WHERE a.pmid IN ({in_ids})"),
        "trial_links": q("SELECT d.pmid, d.databank, d.accession, a.title, a.pub_year FROM databank_links d JOIN scoped a ON d.pmid = a.pmid ORDER BY a.pub_year DESC NULLS FIRST, d.accession, d.pmid LIMIT 25"),
        "top_cited": q(f"SELECT c.pmid, c.cited_by, a.title, a.pub_year, j.medline_ta FROM (SELECT cited_pmid AS pmid, count(*) AS cited_by FROM citations WHERE cited_pmid IN (SELECT pmid FROM articles) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20) c JOIN articles a ON a.pmid = c.pmid LEFT JOIN {jr} j ON a.nlm_id = j.nlm_id"),
        "topic_overlap": q("""SELECT papers_a, papers_b, "both", round(100e0 * "both" / papers_a, 1) AS share_of_a, round(100e0 * "both" / papers_b, 1) AS share_of_b FROM (
            SELECT (SELECT count(*) FROM scoped) AS papers_a, (SELECT count(*) FROM articles WHERE pmid IN (SELECT pmid FROM second)) AS papers_b, (SELECT count(*) FROM scoped WHERE pmid IN (SELECT pmid FROM second)) AS "both")"""),
        "article_record": q(f"""SELECT a.pmid, a.title, j.medline_ta,
            (SELECT coalesce(string_agg(concat_ws('|', s.position, s.author_key, p.display_name, p.orcid, s.affiliation), '; ' ORDER BY s.position), '') FROM authorships s LEFT JOIN authors p ON s.author_key = p.author_key WHERE s.pmid = '{pmid}') AS authors,
            (SELECT coalesce(string_agg(descriptor_name, '; ' ORDER BY descriptor_ui), '') FROM mesh_headings WHERE pmid = '{pmid}') AS headings,
            (SELECT coalesce(string_agg(concat_ws('|', substance_ui, substance_name, registry_number), '; ' ORDER BY substance_ui), '') FROM substances WHERE pmid = '{pmid}') AS substances,
            (SELECT coalesce(string_agg(term, '; ' ORDER BY term), '') FROM keywords WHERE pmid = '{pmid}') AS keywords, (SELECT coalesce(string_agg(type_name, '; ' ORDER BY type_ui), '') FROM publication_types WHERE pmid = '{pmid}') AS types,
            {count(f"citations WHERE citing_pmid = '{pmid}'")} AS references_total, {count(f"citations WHERE citing_pmid = '{pmid}' AND cited_pmid IN (SELECT pmid FROM articles)")} AS references_in_corpus, {count(f"citations WHERE cited_pmid = '{pmid}'")} AS cited_by_in_corpus
            FROM articles a LEFT JOIN {jr} j ON a.nlm_id = j.nlm_id WHERE a.pmid = '{pmid}'"""),
        "taxonomy_descendants": q("SELECT concept_id FROM below"),
        "scope_pmids": q("SELECT pmid FROM scope"),
        "scope_summary": q("SELECT count(*) > 1 AS expanded, count(*) AS descriptors_included FROM below"),
        "vocabulary": q("SELECT * FROM vocabulary"),
        "lookup": q("SELECT * FROM lookup"),
        "resolve_terms": q(resolved(10)),
        "spot_terms": q(spotted(sentence, 10)),
        "resolve_merge": q(f"""SELECT concept_id, concept_name, kind, code, n_papers, weight FROM (SELECT *, row_number() OVER (PARTITION BY concept_id ORDER BY src) AS k FROM (
            SELECT concept_id, concept_name, kind, code, n_papers, least(words, 2) AS weight, 0 AS src FROM ({spotted(text, 8)}) UNION ALL SELECT concept_id, concept_name, kind, code, n_papers, 1, 1 FROM ({resolved(8)}))) WHERE k = 1 ORDER BY weight DESC, n_papers DESC, concept_id LIMIT 8"""),
        "dedup_latest": "SELECT l_orderkey, l_linenumber, l_suppkey, l_quantity, l_extendedprice FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_suppkey DESC, l_quantity DESC, l_extendedprice DESC) AS k FROM lineitem) WHERE k = 1",
        "apply_deletes": q("SELECT pmid, pub_year FROM articles WHERE pmid NOT IN (SELECT pmid FROM deleted_pmids)"),
        "country_parse": q("SELECT pmid, position, country AS parsed FROM authorships"),
        "sql_journals": q(SQL["journals_of_substance"].format(name="new widget")),
        "sql_drugs": _nested(SQL["drugs_of_substance"].format(name="new widget"), q),
        "sql_kol": _nested(SQL["leading_authors"].format(name="new widget", recent=2000), q),
        "sql_ambiguity": q(SQL["ambiguous_authors"].format(more=MORE)),
        "sql_topic": q(SQL["topic_papers"].format(concept=topic)),
        "doc_text": q(whole),
        "store_listing": q(listed, words=words, own_words=indexed("pmid", f"({whole})")),
        "store_keys": q(keyed),
        "bm25_topk": _with(f"SELECT doc, round(score, 6) AS score FROM ({bm25} LIMIT 20)", words=words),
        "literature_search": q(f"SELECT a.pmid, f.score, a.title, a.pub_year, j.medline_ta, a.doi FROM (SELECT * FROM ({fused(24)}) ORDER BY score DESC, doc LIMIT 8) f JOIN articles a ON a.pmid = f.doc LEFT JOIN {jr} j ON a.nlm_id = j.nlm_id", words=indexed("pmid", f"({whole})")),
        "xml_articles": _xml(kept),
        "xml_incremental": _xml(kept),
        "xml_authorships": f"SELECT CAST(o_orderkey AS VARCHAR) AS pmid, unnest([concat('name:buyer', o_custkey, '|a'), concat('group:group ', o_custkey % 5)]) AS author_key, unnest([CAST(1 AS INT), 2]) AS position, unnest([TRUE, FALSE]) AS is_first, unnest([FALSE, TRUE]) AS is_last, CAST(2 AS INT) AS n_authors FROM ({kept})",
        "xml_journals": "SELECT DISTINCT CAST(o_custkey % 97 AS VARCHAR) AS nlm_id, concat('J', o_custkey % 97) AS medline_ta, concat('Journal ', o_custkey % 97) AS title FROM orders",
        "xml_profile": f"SELECT path, (SELECT count(*) FROM orders) AS records, 100e0 AS coverage, CASE WHEN most > 1 THEN 100e0 ELSE 0e0 END AS repeats, CAST(most AS BIGINT) AS most FROM (VALUES {profiled}) t(path, most)",
        "sample_stride": "SELECT count(*) AS records FROM orders WHERE o_orderkey % 13 = 0",
        "csv_shards": q("SELECT k.pmid, k.term, k.is_major FROM keywords k WHERE k.pmid IN (SELECT pmid FROM articles)"),
        "route_trend": q("""SELECT name, value FROM (SELECT concat('row ', row_number() OVER (ORDER BY pub_year) - 1) AS name, concat('n_papers=', count(*), ', pub_year=', pub_year) AS value FROM scoped WHERE pub_year IS NOT NULL GROUP BY pub_year)
            UNION ALL SELECT 'total_papers', CAST(count(*) AS VARCHAR) FROM scoped WHERE pub_year IS NOT NULL UNION ALL SELECT 'exact', 'True' UNION ALL SELECT 'expanded', CASE WHEN count(*) > 1 THEN 'True' ELSE 'False' END FROM below
            UNION ALL SELECT 'descriptors_included', CAST(count(*) AS VARCHAR) FROM below UNION ALL SELECT 'note', concat('Scope: ', min(concept_name), ' (', min(concept_id), ').') FROM mesh_tree WHERE concept_id = '"""+topic+"""'"""),
        "route_countries": _nested(f"""WITH c AS (SELECT country, count(DISTINCT pmid) AS n FROM authorships WHERE country <> '' AND pmid IN (SELECT pmid FROM articles) GROUP BY 1)
            SELECT name, value FROM (SELECT concat('row ', row_number() OVER (ORDER BY n DESC, country) - 1) AS name, concat('country=', country, ', n_papers=', n) AS value FROM (SELECT * FROM c ORDER BY n DESC, country LIMIT 5))
            UNION ALL SELECT 'total', CAST(count(*) AS VARCHAR) FROM c UNION ALL SELECT 'exact', 'True' UNION ALL SELECT 'caveat', '{CAVEATS["countries"]}'""", q),
        "route_unknown": f"SELECT * FROM (VALUES ('error', 'There is no path /api/nothing.'), ('available', '{str(sorted(routes())).replace(chr(39), chr(39) * 2)}')) t(name, value)",
        "vector_topk": f"SELECT doc, round(score, 6) AS score FROM ({near} LIMIT 20)",
        "hybrid_rrf": _with(fused(20), words=words),
        "event_tumbling": "SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n_events, round(sum(value), 2) AS total_value FROM events GROUP BY 1, 2",
        "event_sessions": """SELECT user_id, session, count(*) AS n_events FROM (SELECT user_id, CAST(sum("new") OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS session FROM (
            SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR epoch_us(ts) - epoch_us(lag(ts) OVER w) >= 1800000000 THEN 1 ELSE 0 END AS "new" FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))) GROUP BY 1, 2""",
    }


def _xml(kept: str) -> str:
    return f"""SELECT CAST(o_orderkey AS VARCHAR) AS pmid, CAST(o_custkey % 97 AS VARCHAR) AS nlm_id, concat(CASE WHEN newer THEN 'Newer' ELSE 'First' END, ' of ', o_orderpriority) AS title, 'AIM: to sell' AS abstract,
        CAST(year(o_orderdate) AS INT) AS pub_year, CAST(month(o_orderdate) AS INT) AS pub_month, 'eng' AS language, o_orderstatus AS status, CAST(CASE WHEN newer THEN 2001 ELSE 2000 END AS INT) AS date_revised FROM ({kept})"""


def _nested(sql: str, q) -> str:
    """A form that has common table expressions of its own, as a subquery."""
    return q(f"SELECT * FROM ({sql})")
