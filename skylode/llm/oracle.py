"""DuckDB SQL for those queries of this folder that SQL can express."""

from skylode.llm import quality_rules

_CELLS = ", ".join(f"('{rule}', {cut})" for rule, cuts in quality_rules.RULES.items() for cut in cuts)
_TOPS = {"symbols": "n_symbols / greatest(n_words, 1)", "repeats": "n_repeat_words / greatest(n_words, 1)", "lines": "n_dup_lines / greatest(n_lines, 1)", "capitals": "n_capitals / greatest(word_chars, 1)"}
_SCORE = "CASE rule " + " ".join(f"WHEN '{r}' THEN {t}" for r, t in _TOPS.items()) + " END"
_LIMIT = quality_rules.RISK / len(quality_rules.RULES)

#: CTEs over documents d (doc_id, text, lang), as quality_rules.judge computes them.
QUALITY_CTES = rf"""
q_words AS (
  SELECT doc_id, coalesce(lang, '(null)') AS stratum, lang, row_number() OVER () AS r, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM d),
q_windows AS (SELECT r, unnest(range(1, len(w) - 1)) AS i, w FROM q_words WHERE len(w) >= 3),
q_repeated AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, w[i], w[i + 1], w[i + 2]) AS n FROM q_windows) WHERE n > 1),
q_covered AS (SELECT r, count(DISTINCT i + j) AS n FROM q_repeated, (SELECT unnest([0, 1, 2]) AS j) GROUP BY r),
q_counts AS (
  SELECT q_words.r, doc_id, stratum, lang, text, len(w)::BIGINT AS n_words,
         coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
         len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
         (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(q_covered.n, 0)::BIGINT AS n_repeat_words,
         len(l) AS n_lines, len(regexp_extract_all(text, '\p{{Lu}}')) AS n_capitals
  FROM q_words LEFT JOIN q_covered USING (r)),
q_base AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM q_counts),
q_trials AS (
  SELECT * FROM (SELECT q_base.*, md5(text) AS h FROM q_base WHERE NOT base_failed) JOIN
    (SELECT doc_id, min(quality) AS quality FROM labels WHERE quality IS NOT NULL GROUP BY doc_id) USING (doc_id)
  QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY h, stratum) = 1),
q_held AS (SELECT * FROM q_trials QUALIFY row_number() OVER (PARTITION BY stratum, h ORDER BY quality) = 1),
q_cells AS (SELECT * FROM (VALUES {_CELLS}) t(rule, cut)),
q_tested AS (
  SELECT stratum, rule, cut, count(*) FILTER (quality >= 1) AS n, count(*) FILTER (quality >= 1 AND {_SCORE} > cut) AS good,
         count(*) FILTER (quality < 1 AND {_SCORE} > cut) AS bad
  FROM q_held, q_cells GROUP BY ALL),
q_sure AS (
  SELECT * FROM q_tested WHERE n > 0 AND good < {_LIMIT} * n AND
    list_sum(list_transform(range(0, good + 1), lambda j: exp(lgamma(n + 1) - lgamma(j + 1) - lgamma(n - j + 1) + j * ln({_LIMIT}) + (n - j) * ln(1 - {_LIMIT}))))
      <= {quality_rules.DELTA} / ({len(quality_rules.RULES)} * (SELECT count(DISTINCT stratum) FROM q_tested WHERE n > 0))),
q_cuts AS (SELECT stratum, rule, cut FROM q_sure QUALIFY row_number() OVER (PARTITION BY stratum, rule ORDER BY bad - good DESC, cut DESC) = 1),
q_rejected AS (SELECT DISTINCT r FROM q_base JOIN q_cuts USING (stratum) WHERE {_SCORE} > cut),
q_judged AS (SELECT *, NOT base_failed AND r NOT IN (SELECT r FROM q_rejected) AS kept FROM q_base)
"""

_QUALITY = f"""
WITH d AS (SELECT * FROM documents), {QUALITY_CTES}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept FROM q_judged
"""


_TOP_K = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.v::DOUBLE[], c.v::DOUBLE[])::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_quality_rules": _QUALITY, "op4_pivot_top_k": _TOP_K}
