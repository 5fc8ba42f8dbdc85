"""DuckDB SQL for the queries that SQL can express, over whole tables."""

from __future__ import annotations

_WORDS = r"regexp_extract_all({t}, '[^\x20\x09-\x0D]+')"


def op5() -> str:
    """Measures by lists; a beta prior from the variance between and within hosts, by rule in long form."""
    return rf"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(source, '') AS host, coalesce(text, '') AS t FROM documents),
 w AS (SELECT *, {_WORDS.format(t="t")} AS w, list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS l FROM d),
 g AS (SELECT rid, i, array_to_string(w[i:i + 4], ' ') AS gram FROM (SELECT rid, w, unnest(range(1, len(w) - 3)) AS i FROM w)),
 c AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, gram) AS c FROM g),
 r AS (SELECT rid, count(DISTINCT i + j) AS n FROM c, (SELECT unnest(range(5)) AS j) WHERE c > 1 GROUP BY rid),
 m AS (SELECT w.rid, doc_id, host, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
  CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(l) AS BIGINT) AS n_lines, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
  CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words FROM w LEFT JOIN r ON w.rid = r.rid),
 f AS (SELECT rid, host, unnest(['few words', 'said again', 'signs', 'same lines', 'odd words']) AS rule,
  unnest([n_words < 10, n_repeat_words / n_words > 0.2 AND n_words > 0, n_symbols / greatest(n_words, 0.5) > 0.1, n_dup_lines / greatest(n_lines, 1) > 0.3, n_words > 0 AND (word_chars / n_words < 3 OR word_chars / n_words > 12)]) AS bad FROM m),
 h AS (SELECT host, rule, CAST(count(*) AS DOUBLE) AS n, avg(CASE WHEN bad THEN 1.0 ELSE 0.0 END) AS p FROM f GROUP BY host, rule),
 s AS (SELECT rule, count(*) - 1 AS free, sum(n) AS docs, sum(n * p) / sum(n) AS mean, sum(n) - sum(n * n) / sum(n) AS reach FROM h GROUP BY rule),
 v AS (SELECT h.rule, sum(n * (p - mean) * (p - mean)) AS between_hosts FROM h JOIN s ON h.rule = s.rule GROUP BY h.rule),
 k AS (SELECT s.rule, mean, CASE WHEN mean > 0 AND mean < 1 AND reach > free THEN least(0.99, greatest(0.0001, (between_hosts / (mean * (1 - mean)) - free) / (reach - free))) ELSE 0.0001 END AS alike FROM s JOIN v ON s.rule = v.rule),
 a AS (SELECT host, k.rule, mean, (n * p * alike + mean * (1 - alike)) / (n * alike + 1 - alike) AS shrunk FROM h JOIN k ON h.rule = k.rule),
 x AS (SELECT f.rid, bool_or(bad) AS habit FROM f JOIN a ON f.host = a.host AND f.rule = a.rule WHERE shrunk > 0.01 AND shrunk > mean / 2 GROUP BY f.rid),
 b AS (SELECT m.*, n_words < 10 OR n_repeat_words / n_words > 0.2 AS base_failed, coalesce(x.habit, false) AS habit FROM m LEFT JOIN x ON m.rid = x.rid)
 SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, habit AND NOT base_failed AS by_host, NOT base_failed AND NOT habit AS kept FROM b"""


def op8(size: int = 3, percent: int = 85) -> str:
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return rf"""WITH RECURSIVE w AS (SELECT doc_id, {_WORDS.format(t=f"translate(coalesce(text, ''), '{upper}', '{lower}')")} AS w FROM documents),
 l AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {size} THEN [array_to_string(w, ' ')]
  ELSE list_distinct(list_transform(range(1, len(w) - {size - 2}), lambda i: array_to_string(w[i:i + {size - 1}], ' '))) END AS l FROM w),
 s AS (SELECT doc_id, CAST(len(l) AS BIGINT) AS n, unnest(l) AS g FROM l),
 i AS (SELECT a.doc_id AS u, b.doc_id AS v, a.n AS p, b.n AS q, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
 e AS (SELECT u, v FROM i WHERE 100 * c >= {percent} * (p + q - c)),
 both_ways AS (SELECT u, v FROM e UNION ALL SELECT v, u FROM e),
 reach(doc_id, other) AS (SELECT doc_id, doc_id FROM l UNION SELECT r.doc_id, b.v FROM reach r JOIN both_ways b ON r.other = b.u),
 least AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
 SELECT l.doc_id, CAST(len(l) AS BIGINT) AS n_shingles, component_id, l.doc_id = component_id AS kept FROM l JOIN least ON l.doc_id = least.doc_id"""
