"""The same questions as plain SQL over a store's tables."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

from ..store import Store

#: Topics are substances by name; drugs count rows, not papers; recency is an argument; a name is ambiguous that stands
#: beside more than MORE institutions.
MORE = 50
SQL = {
    "journals_of_substance": """
        SELECT j.medline_ta, j.country, count(DISTINCT a.pmid) AS n_papers
        FROM substances s JOIN articles a USING (pmid) JOIN journals j USING (nlm_id)
        WHERE s.substance_name = '{name}' GROUP BY j.medline_ta, j.country ORDER BY n_papers DESC, j.medline_ta, j.country""",
    "drugs_of_substance": """
        WITH scope AS (SELECT pmid FROM substances WHERE substance_name = '{name}')
        SELECT s.substance_name, s.registry_number, count(*) AS n_rows
        FROM scope JOIN substances s USING (pmid) WHERE s.substance_name <> '{name}' AND s.registry_number <> '0'
        GROUP BY s.substance_name, s.registry_number ORDER BY n_rows DESC, s.substance_name, s.registry_number""",
    "leading_authors": """
        WITH scope AS (SELECT DISTINCT pmid FROM substances WHERE substance_name = '{name}'),
        counted AS (
          SELECT s.author_key, count(DISTINCT s.pmid) AS n_papers, count(*) FILTER (WHERE s.is_first) AS n_first,
                 count(*) FILTER (WHERE s.is_last) AS n_last, count(*) FILTER (WHERE a.pub_year >= {recent}) AS n_recent, max(a.pub_year) AS latest_year
          FROM scope JOIN authorships s USING (pmid) JOIN articles a USING (pmid) GROUP BY s.author_key)
        SELECT c.author_key, p.display_name, p.orcid, c.n_papers, c.n_first, c.n_last, c.latest_year,
               CAST(round(c.n_papers + 1.5 * c.n_first + 2 * c.n_last + c.n_recent, 1) AS DOUBLE) AS score
        FROM counted c JOIN authors p USING (author_key) WHERE NOT p.is_group ORDER BY score DESC, c.author_key LIMIT 20""",
    "ambiguous_authors": """
        SELECT p.display_name, count(DISTINCT s.pmid) AS n_papers, count(DISTINCT split_part(s.affiliation, ',', 1)) AS n_institutions
        FROM authorships s JOIN authors p USING (author_key) WHERE NOT p.is_group GROUP BY p.display_name
        HAVING count(DISTINCT split_part(s.affiliation, ',', 1)) > {more}
        ORDER BY n_papers DESC, p.display_name LIMIT 20""",
    "topic_papers": """
        SELECT count(DISTINCT h.pmid) AS n_papers
        FROM mesh_tree root JOIN mesh_tree below ON below.tree_number = root.tree_number OR below.tree_number LIKE concat(root.tree_number, '.%')
        JOIN mesh_headings h ON h.descriptor_ui = below.concept_id
        WHERE root.concept_id = '{concept}'""",
}


def run(store: Store, form: str, **values) -> DataFrame:
    """One of the forms; values are quoted."""
    sql = SQL[form].format(**{k: v.replace("'", "''") if isinstance(v, str) else int(v) for k, v in values.items()})
    used = {t for t in re.findall(r"\b(?:FROM|JOIN) (\w+)", sql) if t in store}
    text = re.sub(rf"\b(FROM|JOIN) ({'|'.join(used)})\b", r"\1 {\2}", sql)
    return store.spark.sql(text, **{t: store[t] for t in used})
