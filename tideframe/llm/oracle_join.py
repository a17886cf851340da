"""DuckDB SQL of the n-gram Jaccard join: all pairs that share a shingle, and a walk over the links."""

from __future__ import annotations


def op7_sql(size: int = 3, percent: int = 90) -> str:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return rf"""WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= {size} THEN list_transform(range(1, len(ws) - {size - 2}), lambda i: ws[i:i + {size - 1}]) WHEN len(ws) > 0 THEN [ws] ELSE [] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= {percent} * (x.n + y.n - k)),
reached AS (SELECT doc_id, doc_id AS r FROM documents UNION SELECT doc_id, b FROM reached JOIN links ON r = a)
SELECT d.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(r) AS component_id FROM documents d JOIN reached ON d.doc_id = reached.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id"""
