"""DuckDB SQL of the queries that SQL can express over whole tables."""

from __future__ import annotations

import math
import string

from .licenses import TEMPLATES, words_of
from .tree_forest import LEAST

_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def license_scan() -> str:
    """Phrases by place, and every block of every text against each template."""
    found = []
    for phrase, label in (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")):
        words = phrase.split()
        same = " AND ".join(f"words[i + {k}] = '{w}'" for k, w in enumerate(words))
        found.append((label, f"list_filter(range(1, len(words) - {len(words)} + 2), lambda i: {same})"))
    places = ", ".join(f"{f} AS p{k}" for k, (_, f) in enumerate(found))
    every = "list_concat(list_concat(p0, p1), p2)"
    base = "list_sort(list_filter([" + ", ".join(f"CASE WHEN len(p{k}) > 0 THEN '{label}' END" for k, (label, _) in enumerate(found)) + "], lambda x: x IS NOT NULL))"
    rows = []
    for label, text, must in TEMPLATES:
        every_word = words_of(text)
        words, needed = ([f"'{w}'" for w in sorted(set(x))] for x in (every_word, words_of(must)))
        rows.append(f"('{label}', [{', '.join(words)}], {math.ceil(0.8 * len(words) - 1e-9)}, {math.ceil(len(every_word) / 0.8 - 1e-9)}, [{', '.join(needed)}])")
    low = f"translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
    return f"""WITH d AS (SELECT row_number() OVER () AS r, doc_id, {low} AS low FROM documents),
      w AS (SELECT r, doc_id, regexp_extract_all(low, '{_WORD}') AS words FROM d),
      p AS (SELECT r, doc_id, len(words) AS n_words, {places} FROM w),
      b AS (SELECT r, doc_id, n_words, {every} AS places, {base} AS base FROM p),
      t(label, words, need, block, must) AS (VALUES {', '.join(rows)}),
      c AS (SELECT w.r, w.words AS own, t.* FROM w, t WHERE len(list_intersect(list_distinct(w.words), t.words)) >= t.need AND len(list_intersect(list_distinct(w.words), t.must)) = len(t.must)),
      k AS (SELECT r, own, label, words, need, block, must, unnest(range(1, greatest(len(own) - block + 1, 1) + 1)) AS i FROM c),
      l AS (SELECT r, label, words, need, must, list_distinct(own[i:i + block - 1]) AS part FROM k),
      m AS (SELECT r, label, len(list_intersect(part, words)) AS common, len(words) AS size, need FROM l WHERE len(list_intersect(part, must)) = len(must)),
      g AS (SELECT r, list(DISTINCT label) AS labels, max(common / size) AS contained FROM m WHERE common >= need GROUP BY r)
    SELECT doc_id, n_words, len(places) AS n_base, list_min(places) - 1 AS first_word, list_max(places) - 1 AS last_word, array_to_string(base, ',') AS base_labels,
      array_to_string(list_sort(list_distinct(list_concat(base, coalesce(labels, CAST([] AS VARCHAR[]))))), ',') AS labels,
      CAST(CASE WHEN len(base) > 0 THEN 1 ELSE coalesce(contained, 0) END AS DOUBLE) AS score
    FROM b LEFT JOIN g ON b.r = g.r"""


def near_vectors() -> str:
    """All pairs, and the smallest id reachable by a recursive query."""
    return f"""WITH RECURSIVE v AS MATERIALIZED (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
        WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(embedding, lambda c: c <> 0)) > 0),
      l AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x) WHERE list_cosine_similarity(a.x, b.x) >= {LEAST}e0),
      r(a, b) AS (SELECT vec_id, vec_id FROM v UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
      c AS (SELECT a, min(b) AS component FROM r GROUP BY a), n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
    SELECT e.vec_id, coalesce(n.n, 0) AS n_links, coalesce(c.component, e.vec_id) AS component_id, coalesce(c.component, e.vec_id) = e.vec_id AS kept
    FROM embeddings e LEFT JOIN c ON c.a = e.vec_id LEFT JOIN n ON n.a = e.vec_id"""


def nearest_vectors() -> str:
    """All candidates of each query."""
    return """WITH v AS MATERIALIZED (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
        WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(embedding, lambda c: c <> 0)) > 0),
      s AS (SELECT q.vec_id AS query_id, c.vec_id, list_cosine_similarity(q.x, c.x) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.x) = len(c.x) WHERE q.vec_id % 50 = 0),
      r AS (SELECT query_id, vec_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM s)
    SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM r WHERE n <= 5"""


def jaccard_join() -> str:
    """Sets by text, intersections counted over shared shingles, and the smallest id reachable by a recursive query."""
    low = f"translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
    return f"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({low}, '[^\\x20\\x09-\\x0D]+') AS words FROM documents),
      s AS MATERIALIZED (SELECT doc_id, CASE WHEN len(words) = 0 THEN CAST([] AS VARCHAR[]) ELSE list_distinct(list_transform(range(1, greatest(len(words) - 1, 2)), lambda i: array_to_string(words[i:i + 2], ' '))) END AS shingles FROM w),
      k AS MATERIALIZED (SELECT min(doc_id) AS rep, len(any_value(shingles)) AS size, list_sort(shingles) AS shingles FROM s WHERE len(shingles) > 0 GROUP BY list_sort(shingles)),
      e AS MATERIALIZED (SELECT rep, size, unnest(shingles) AS shingle FROM k),
      l AS MATERIALIZED (SELECT a.rep AS a, b.rep AS b FROM e a JOIN e b ON a.shingle = b.shingle AND a.rep <> b.rep AND 100 * least(a.size, b.size) >= 90 * greatest(a.size, b.size)
        GROUP BY a.rep, b.rep, a.size, b.size HAVING 100 * count(*) >= 90 * (a.size + b.size - count(*))),
      r(a, b) AS (SELECT rep, rep FROM k UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
      c AS (SELECT a, min(b) AS component FROM r GROUP BY a)
    SELECT s.doc_id, CAST(len(s.shingles) AS BIGINT) AS n_shingles, coalesce(c.component, s.doc_id) AS component_id
    FROM s LEFT JOIN k ON list_sort(s.shingles) = k.shingles LEFT JOIN c ON c.a = k.rep"""
