"""DuckDB SQL that gives the rows of those queries that SQL can express, by brute force."""

from __future__ import annotations

from weftline.llm.url_filter import ORACLE as URL_FILTER

_REACH = """
sym AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
counts AS (SELECT a AS id, CAST({count} AS BIGINT) AS n FROM sym GROUP BY a),
reach(id, r) AS (SELECT id, id FROM ids UNION SELECT reach.id, sym.b FROM reach JOIN sym ON sym.a = reach.r),
lowest AS (SELECT id, min(r) AS component_id FROM reach GROUP BY id)"""

NEAR_VECTORS = f"""
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND list_sum(list_transform(embedding, lambda x: abs(x))) > 0
), ids AS (SELECT vec_id AS id FROM embeddings),
links AS (SELECT p.vec_id AS a, q.vec_id AS b FROM v p JOIN v q ON p.vec_id < q.vec_id AND list_cosine_similarity(p.e, q.e) >= 0.9),
{_REACH.format(count="count(*)")}
SELECT id AS vec_id, coalesce(n, 0) AS n_links, component_id, id = component_id AS kept FROM ids JOIN lowest USING (id) LEFT JOIN counts USING (id)
"""

NGRAM_JOIN = rf"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), sets AS (
  SELECT doc_id AS id, CASE WHEN len(w) >= 5 THEN list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS s FROM words
), ids AS (SELECT id, len(s) AS size FROM sets),
flat AS (SELECT id, unnest(s) AS x FROM sets),
met AS (SELECT p.id AS a, q.id AS b, count(*) AS shared FROM flat p JOIN flat q ON p.x = q.x AND p.id < q.id GROUP BY ALL),
links AS (SELECT a, b FROM met JOIN ids p ON p.id = a JOIN ids q ON q.id = b WHERE 100 * shared >= 90 * (p.size + q.size - shared)),
{_REACH.format(count="count(*)")}
SELECT id AS doc_id, CAST(size AS BIGINT) AS n_shingles, coalesce(n, 0) AS n_similar, component_id FROM ids JOIN lowest USING (id) LEFT JOIN counts USING (id)
"""


def _print(name: str, source: str, text: str) -> str:
    """CTEs that end in `name` (doc_id, fp, nodes): the fingerprint of column `text` of `source`."""
    return rf"""
{name}1 AS (SELECT doc_id, list_transform(string_split({text}, chr(10)), lambda p: list_transform(regexp_extract_all(p, '(?s)\s*(?:\S{{1,64}}\s*){{1,4}}|\s+'), lambda x: sha256(x))) AS leaves FROM {source}),
{name}2 AS (SELECT doc_id, leaves, list_transform(leaves, lambda l: sha256(coalesce(array_to_string(l, ''), ''))) AS pd FROM {name}1),
{name}3 AS (SELECT doc_id, regexp_split_to_array(rtrim(array_to_string(list_transform(range(1, len(pd) + 1), lambda i: pd[i] || coalesce(array_to_string(list_transform(leaves[i], lambda x: '.' || x[1:8]), ''), '') || CASE WHEN pd[i][1:8] < '4' THEN ';' ELSE '' END), ','), ';'), ';,?') AS secs FROM {name}2),
{name}4 AS (SELECT doc_id, secs, list_transform(secs, lambda s: sha256(regexp_replace(s, '\.[0-9a-f]{{8}}', '', 'g'))) AS sd FROM {name}3),
{name}5 AS (SELECT doc_id, sha256(array_to_string(sd, '')) || ':' || array_to_string(list_transform(range(1, len(sd) + 1), lambda i: sd[i][1:8] || '=' || regexp_replace(secs[i], '([0-9a-f]{{8}})[0-9a-f]{{56}}', '\1', 'g')), ';') AS fp FROM {name}4),
{name} AS (SELECT doc_id, fp, list_distinct(regexp_split_to_array(fp, '[:=.,;]')) AS nodes FROM {name}5)"""


_LIKE = "CAST(2 * len(list_intersect({a}, {b})) AS DOUBLE) / (len({a}) + len({b}))"

FINGERPRINTS = f"""
WITH docs AS (
  SELECT doc_id, coalesce(text, '') AS t, coalesce(lead(doc_id) OVER (ORDER BY doc_id), first_value(doc_id) OVER (ORDER BY doc_id)) AS next_id FROM documents
), edits AS (
  SELECT d.doc_id, d.t, d.next_id, left(d.t, length(d.t) - length(d.t) // 2) || left(n.t, length(d.t) // 2) AS e FROM docs d JOIN docs n ON n.doc_id = d.next_id
),{_print("own", "edits", "t")},{_print("edited", "edits", "e")}
SELECT edits.doc_id, length(t) AS n_chars, sha256(e) AS edited_sha256, own.fp AS fingerprint, edited.fp AS edited_fingerprint,
       {_LIKE.format(a="own.nodes", b="edited.nodes")} AS near_edited, {_LIKE.format(a="own.nodes", b="follows.nodes")} AS near_next
FROM edits JOIN own USING (doc_id) JOIN edited USING (doc_id) JOIN own follows ON follows.doc_id = edits.next_id
"""

ORACLES = {
    "op2_embedding_near_dedup": NEAR_VECTORS,
    "op3_url_filters": URL_FILTER,
    "op7_ngram_jaccard_join": NGRAM_JOIN,
    "op10_document_fingerprints": FINGERPRINTS,
}
