"""DuckDB SQL of the quality rules, written apart from the operator; ladders and rates are its parameters."""

from __future__ import annotations

from .quality_rules import ERROR, LADDERS, RISK

MEASURED = r"""
w AS (SELECT doc_id, lang, coalesce(text, '') AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
grams AS (SELECT doc_id, i, ws[i:i + 4] AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w)),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM grams) WHERE n > 1),
covered AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 5)) AS p FROM twice) GROUP BY doc_id),
lines AS (SELECT doc_id, count(*) - count(DISTINCT l) AS n FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM w) WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY doc_id),
m AS (SELECT w.doc_id, lang, len(ws)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
  length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols, coalesce(lines.n, 0)::BIGINT AS n_dup_lines, coalesce(covered.n, 0)::BIGINT AS n_repeat_words,
  length(regexp_replace(t, '[^A-Z]+', '', 'g'))::BIGINT AS n_upper, len(list_filter(range(2, len(ws) + 1), lambda i: ws[i] = ws[i - 1]))::BIGINT AS n_stutters
  FROM w LEFT JOIN lines USING (doc_id) LEFT JOIN covered USING (doc_id)),
f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  1000 * n_symbols // greatest(n_words, 1) AS symbols, 1000 * n_upper // greatest(word_chars, 1) AS upper_letters, 1000 * n_stutters // greatest(n_words, 1) AS stutters, 1000 * word_chars // greatest(n_words, 1) AS chars FROM m)"""

#: Column and direction of each rule.
COLUMNS = {"symbols": ("symbols", ">"), "upper": ("upper_letters", ">"), "stutters": ("stutters", ">"), "long_words": ("chars", ">"), "-short_words": ("chars", "<")}


def kept_sql(risk: float = RISK, error: float = ERROR) -> str:
    ladder = ", ".join(f"('{r}', {i}, {c})" for r, steps in LADDERS.items() for i, c in enumerate(steps))
    dropped = " OR ".join(f"(rule = '{r}' AND {x} {sign} cutoff)" for r, (x, sign) in COLUMNS.items())
    p = risk / len(LADDERS)
    return f"""WITH {MEASURED},
ladder(rule, i, cutoff) AS (VALUES {ladder}),
held AS (SELECT f.*, quality = 1 AS good FROM f JOIN labels USING (doc_id) WHERE NOT base_failed AND quality IS NOT NULL),
counted AS (SELECT lang, rule, i, cutoff, count(*) FILTER (good) AS n, count(*) FILTER (good AND ({dropped})) AS k, count(*) FILTER (NOT good AND ({dropped})) AS bad FROM held, ladder GROUP BY ALL),
tested AS (SELECT *, CASE WHEN k >= n * {p} THEN 1.0 ELSE list_sum(list_transform(range(0, k + 1), lambda j: exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln({p}) + (n - j) * ln(1 - {p})))) END AS p_value FROM counted),
safe AS (SELECT *, max((p_value > {error} / ((SELECT count(DISTINCT coalesce(lang, '-')) FROM held) * {len(LADDERS)}))::INT) OVER (PARTITION BY lang, rule ORDER BY i) AS stopped FROM tested),
cutoffs AS (SELECT lang, rule, arg_max(cutoff, bad * 1000 - i) AS cutoff FROM safe WHERE stopped = 0 AND bad > 0 GROUP BY ALL),
hit AS (SELECT DISTINCT doc_id FROM f JOIN cutoffs ON f.lang IS NOT DISTINCT FROM cutoffs.lang WHERE {dropped})
"""


def op1_sql() -> str:
    return kept_sql() + "SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND doc_id NOT IN (SELECT doc_id FROM hit) AS kept FROM f"
