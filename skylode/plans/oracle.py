"""DuckDB SQL that the registered queries are compared with."""

from __future__ import annotations

_L2 = "list_sum(list_transform(list_zip({a}, {b}), lambda z: (z[1]::DOUBLE - z[2]::DOUBLE) * (z[1]::DOUBLE - z[2]::DOUBLE)))"
_DOT = "list_sum(list_transform(list_zip({a}, {b}), lambda z: z[1]::DOUBLE * z[2]::DOUBLE))"


def _l2(a: str, b: str) -> str:
    return _L2.format(a=a, b=b)


def _cos(a: str, b: str) -> str:
    return f"{_DOT.format(a=a, b=b)} / (sqrt({_DOT.format(a=a, b=a)}) * sqrt({_DOT.format(a=b, b=b)}))"


_V = "v AS (SELECT vec_id AS id, embedding AS vector FROM embeddings)"
_TOKENS = r"list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '')"


def _bm25(rows: str, terms: list[str], name: str = "bm", exact: bool = False) -> str:
    """CTEs that end in ``name`` (id, score) over the table expression ``rows``."""
    digits = 15 if exact else 6
    many = ", ".join(f"'{t}'" for t in terms)
    return f"""
{name}_t AS (SELECT id, {_TOKENS} AS t FROM ({rows}) WHERE text IS NOT NULL),
{name}_s AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM {name}_t),
{name}_p AS (
  SELECT id, len(t) AS dl, term, len(list_filter(t, lambda x: x = term)) AS tf
  FROM {name}_t, (SELECT unnest([{many}]) AS term)),
{name}_d AS (SELECT term, count(*) AS df FROM {name}_p WHERE tf > 0 GROUP BY term),
{name} AS (
  SELECT id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), {digits}) AS score
  FROM {name}_p JOIN {name}_d USING (term), {name}_s WHERE tf > 0 GROUP BY id)"""


def _rrf(first: str, first_order: str, second: str, second_order: str) -> str:
    return f"""
ra AS (SELECT id, row_number() OVER (ORDER BY {first_order}, id) AS r FROM {first} QUALIFY r <= 100),
rb AS (SELECT id, row_number() OVER (ORDER BY {second_order}, id) AS r FROM {second} QUALIFY r <= 100),
f AS (SELECT id, round(sum(1.0::DOUBLE / (60 + r)), 6) AS score FROM (SELECT * FROM ra UNION ALL SELECT * FROM rb) GROUP BY id)
SELECT id, score FROM f ORDER BY score DESC, id LIMIT 10"""


_BAGS = "b AS (SELECT id // 5 AS id, list(vector ORDER BY id) AS vectors FROM v GROUP BY ALL)"
_MAXSIM = f"""
ms AS (
  SELECT id, round(sum(best), 6) AS score FROM (
    SELECT b.id, q.id AS qid, list_max(list_transform(vectors, lambda d: {_cos("q.vector", "d")})) AS best
    FROM b, (SELECT * FROM v WHERE id < 4) q) GROUP BY id)"""
_EVENTS = "SELECT event_id AS id, epoch_us(ts) AS ingested_at_micros FROM events"
_SECOND = """
again AS (SELECT event_id AS id, event_type || '-v2' AS text FROM events WHERE event_id % 10 = 0),
batch AS (SELECT * FROM again UNION ALL SELECT id + 10000000, 'new' FROM again)"""
_CENTRES = "c AS (SELECT id AS part, vector AS centre FROM v WHERE id < 16)"
_ASSIGNED = f"""
{_CENTRES},
near AS (SELECT v.id, vector, part, {_l2("vector", "centre")} AS d FROM v, c),
a AS (SELECT id, vector, part::INTEGER AS part FROM near QUALIFY row_number() OVER (PARTITION BY id ORDER BY d, part) = 1)"""
_CODES = f"""
sub AS (SELECT unnest(range(4)) AS j),
code AS (
  SELECT v.id, j, c.id::INTEGER AS code
  FROM v, sub, (SELECT * FROM v WHERE id < 16) c
  QUALIFY row_number() OVER (PARTITION BY v.id, j ORDER BY {_l2("v.vector[16 * j + 1:16 * j + 16]", "c.vector[16 * j + 1:16 * j + 16]")}, c.id) = 1)"""


def _batch(rows: str, name: str) -> str:
    return f"""
{name}_s AS (SELECT q.id AS query_id, r.id, round({_l2("r.vector", "q.vector")}, 6) AS score FROM ({rows}) r, (SELECT * FROM v WHERE id % 20 = 0) q),
{name} AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score, id)::INTEGER AS rank FROM {name}_s QUALIFY rank <= 10)"""


#: The rows of the table queries: h, its changed rows c, what an upsert leaves (u).
_TABLE = f"""{_V}, h AS (SELECT v.id, vector, text FROM v JOIN documents ON doc_id = v.id),
again AS (SELECT id, vector, 'the second ' || coalesce(text, '') AS text FROM h WHERE id % 10 = 0),
c AS (SELECT * FROM again UNION ALL SELECT id + 10000000, vector, 'the new one' FROM again),
u AS (SELECT * FROM h WHERE id NOT IN (SELECT id FROM c) UNION ALL SELECT * FROM c),
twice AS (SELECT * FROM h UNION ALL SELECT id, vector, 'the copy and the other' FROM h WHERE id % 7 = 0),
s AS (SELECT row_number() OVER () AS id, id AS rid, vector, text FROM (SELECT * FROM twice WHERE id NOT IN (SELECT id FROM c) UNION ALL SELECT * FROM c))"""


def _modes() -> str:
    """Vector, text and hybrid hits over s; copies of an id are rows of their own."""
    near = f"near AS (SELECT s.id, rid, {_l2('vector', 'q')} AS score FROM s, (SELECT vector AS q FROM v WHERE id = 0))"
    return f"""WITH {_TABLE}, {near}, {_bm25("SELECT id, text FROM s", ["the", "and"], exact=True)},
text AS (SELECT bm.id, rid, score FROM bm JOIN s USING (id)),
ra AS (SELECT id, rid, row_number() OVER (ORDER BY score, rid) AS r FROM near QUALIFY r <= 50),
rb AS (SELECT id, rid, row_number() OVER (ORDER BY score DESC, rid) AS r FROM text QUALIFY r <= 50),
f AS (SELECT rid, sum(1.0::DOUBLE / (60 + r)) AS score FROM (SELECT * FROM ra UNION ALL SELECT * FROM rb) GROUP BY id, rid)
SELECT * FROM (SELECT 'vector' AS mode, rid AS id, round(score, 6) AS score FROM near ORDER BY near.score, rid LIMIT 5)
UNION ALL SELECT * FROM (SELECT 'fts', rid, round(score, 6) FROM text ORDER BY text.score DESC, rid LIMIT 5)
UNION ALL SELECT * FROM (SELECT 'hybrid', rid, round(score, 6) FROM f ORDER BY f.score DESC, rid LIMIT 5)"""


def oracle_sql() -> dict[str, str]:
    q0 = "(SELECT vector AS q FROM v WHERE id = 0)"
    texts = "SELECT doc_id AS id, text FROM documents"
    near = f"round({_l2('vector', 'q')}, 6) AS score"
    joined = "SELECT v.id, vector, text FROM v JOIN documents ON doc_id = v.id"
    page = "ORDER BY ingested_at_micros {o}, id {o} LIMIT {n}"
    out = {
        "knn_l2_exact": f"WITH {_V} SELECT id, {near} FROM v, {q0} ORDER BY score, id LIMIT 10",
        "knn_cosine_exact": f"WITH {_V} SELECT id, round(1 - {_cos('vector', 'q')}, 6) + 0.0::DOUBLE AS score FROM v, {q0} ORDER BY score, id LIMIT 10",
        "knn_batch_topk": f"WITH {_V}, {_batch('SELECT * FROM v', 'k')} SELECT query_id, rank, id, score FROM k",
        "maxsim_topk": f"WITH {_V}, {_BAGS}, {_MAXSIM} SELECT id, score FROM ms ORDER BY score DESC, id LIMIT 10",
        "bm25_topk": f"WITH {_bm25(texts, ['the'])} SELECT id, score FROM bm ORDER BY score DESC, id LIMIT 20",
        "bm25_multi_term": f"WITH {_bm25(texts, ['the', 'and', 'que'])} SELECT id, score FROM bm ORDER BY score DESC, id LIMIT 20",
        "hybrid_rrf": f"WITH {_V}, h AS ({joined}), n AS (SELECT id, {near} FROM h, {q0}), {_bm25('SELECT id, text FROM h', ['the', 'and'])}, {_rrf('n', 'score', 'bm', 'score DESC')}",
        "hybrid_multivector_rrf": f"WITH {_V}, {_BAGS}, {_MAXSIM}, {_bm25('SELECT doc_id AS id, text FROM documents WHERE doc_id IN (SELECT id FROM b)', ['the', 'and'])}, {_rrf('ms', 'score DESC', 'bm', 'score DESC')}",
        "query_without_vector": f"WITH {_V}, h AS ({joined}) SELECT id, {near}, text FROM h, (SELECT vector AS q FROM v WHERE id = 3) ORDER BY score, id LIMIT 10",
        "list_desc_page1": f"{_EVENTS} {page.format(o='DESC', n=50)}",
        "list_desc_cursor_page": f"{_EVENTS} {page.format(o='DESC', n='50 OFFSET 50')}",
        "list_asc_cursor_page": f"{_EVENTS} {page.format(o='ASC', n='50 OFFSET 50')}",
        "upsert_latest_wins": f"WITH {_SECOND} SELECT event_id AS id, event_type AS text FROM events WHERE event_id NOT IN (SELECT id FROM batch) UNION ALL SELECT * FROM batch",
        "import_append_keeps_duplicates": f"WITH {_SECOND} SELECT id, count(*) AS copies FROM (SELECT event_id AS id FROM events UNION ALL SELECT id FROM batch) GROUP BY id",
        "duplicate_id_detection": "SELECT id, count(*) AS copies FROM (SELECT doc_id AS id FROM labels UNION ALL SELECT vec_id FROM embeddings) GROUP BY id HAVING count(*) > 1",
        "invalid_rows_filter": """SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN 'null vector' WHEN vec_id % 5 = 0 THEN 'wrong dimension' ELSE 'null component' END AS fault
FROM embeddings WHERE vec_id % 7 = 0 OR vec_id % 5 = 0 OR vec_id % 3 = 0""",
        "namespace_info": "SELECT count(*) AS row_count, max(len(embedding)) AS vector_dim, min(vec_id) AS id_min, max(vec_id) AS id_max FROM embeddings",
        "postings_stats": f"""WITH t AS (SELECT doc_id, {_TOKENS} AS t FROM documents WHERE text IS NOT NULL), s AS (SELECT count(*) AS n, round(avg(len(t)), 6) AS avgdl FROM t),
p AS (SELECT doc_id, unnest(t) AS term FROM t)
SELECT term, count(DISTINCT doc_id) AS df, count(*) AS cf, any_value(n) AS n, any_value(avgdl) AS avgdl FROM p, s GROUP BY term""",
        "ivf_assign": f"WITH {_V}, {_ASSIGNED} SELECT id, part FROM a",
        "ivf_probe_topk": f"""WITH {_V}, {_ASSIGNED}, q AS (SELECT vector AS q FROM v WHERE id = 20),
p AS (SELECT part FROM c, q ORDER BY {_l2("centre", "q")}, part LIMIT 4)
SELECT id, part, {near} FROM a, q WHERE part IN (SELECT part FROM p) ORDER BY score, id LIMIT 10""",
        "pq_encode": f"WITH {_V}, {_CODES} SELECT id, " + ", ".join(f"max(code) FILTER (j = {j}) AS code{j}" for j in range(4)) + " FROM code GROUP BY id",
        "adc_topk": f"""WITH {_V}, {_CODES}, q AS (SELECT vector AS q FROM v WHERE id = 20)
SELECT code.id, round(sum({_l2("q[16 * j + 1:16 * j + 16]", "c.vector[16 * j + 1:16 * j + 16]")}), 6) AS score
FROM code JOIN v c ON c.id = code, q GROUP BY code.id ORDER BY score, code.id LIMIT 10""",
        "semantic_cache_lookup": f"""WITH {_V}, s AS (
  SELECT p.id, e.id AS entry_id, round({_cos("p.vector", "e.vector")}, 6) AS similarity
  FROM (SELECT * FROM v WHERE id >= 50) p, (SELECT * FROM v WHERE id < 50) e
  QUALIFY row_number() OVER (PARTITION BY p.id ORDER BY similarity DESC, e.id) = 1)
SELECT id, CASE WHEN similarity >= 0.3 THEN entry_id ELSE -1 END AS entry_id, similarity FROM s""",
        "recall_at_k": f"""WITH {_V}, {_batch("SELECT * FROM v", "e")}, {_batch("SELECT * FROM v WHERE id % 2 = 0", "h")}
SELECT query_id, count(h.id) / count(*) AS recall FROM e LEFT JOIN h USING (query_id, id) GROUP BY query_id""",
        "ndcg_at_k": f"""WITH {_bm25(texts, ["the", "and"])}, r AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS r FROM bm QUALIFY r <= 10),
i AS (SELECT quality, row_number() OVER (ORDER BY quality DESC, doc_id) AS r FROM labels QUALIFY r <= 10)
SELECT round(coalesce((SELECT sum(quality / log2(r + 1)) FROM r JOIN labels ON doc_id = id), 0) / (SELECT sum(quality / log2(r + 1)) FROM i), 6) AS ndcg""",
        "bench_percentiles": """WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events)
SELECT event_type, max(value) FILTER (i = n * 50 // 100) AS p50, max(value) FILTER (i = n * 95 // 100) AS p95, max(value) FILTER (i = n * 99 // 100) AS p99 FROM r GROUP BY event_type""",
        "topk_overlap": f"""WITH {_V}, a AS (SELECT id, {near} FROM v, {q0} ORDER BY score, id LIMIT 50),
b AS (SELECT id, {near} FROM v, (SELECT vector AS q FROM v WHERE id = 1) ORDER BY score, id LIMIT 50)
SELECT count(*) AS overlap FROM a WHERE id IN (SELECT id FROM b)""",
        "semantic_cache_answers": f"""WITH {_V}, s AS (
  SELECT p.id, e.id AS entry_id, {_cos("p.vector", "e.vector")} AS similarity
  FROM (SELECT * FROM v WHERE id >= 50 AND id < 1074) p, (SELECT * FROM v WHERE id < 50) e
  QUALIFY row_number() OVER (PARTITION BY p.id ORDER BY similarity DESC, e.id) = 1)
SELECT id, CASE WHEN similarity >= 0.3 THEN entry_id ELSE -1 END AS entry_id FROM s""",
        "map_at_k": "WITH "
        + ", ".join(_bm25(texts, [t], f"b{t}") + f", r{t} AS (SELECT '{t}' AS q, id, row_number() OVER (ORDER BY score DESC, id) AS r FROM b{t} QUALIFY r <= 100)" for t in ("the", "and", "que"))
        + """, r AS (SELECT * FROM rthe UNION ALL SELECT * FROM rand UNION ALL SELECT * FROM rque), g AS (SELECT doc_id AS id FROM labels WHERE quality = 1),
hit AS (SELECT q, r, row_number() OVER (PARTITION BY q ORDER BY r) AS n FROM r JOIN g USING (id))
SELECT round((SELECT coalesce(sum(n / r), 0) FROM hit) / (SELECT least(count(*), 100) FROM g) / (SELECT count(DISTINCT q) FROM r), 6) AS map""",
        "table_import": f"WITH {_TABLE} SELECT id, count(*) AS copies, max(len(vector))::INTEGER AS dim FROM (SELECT * FROM h UNION ALL SELECT * FROM c) GROUP BY id",
        "table_upsert": f"WITH {_TABLE} SELECT id, text FROM u",
        "table_info": f"WITH {_TABLE} SELECT count(*) AS row_count, max(len(vector)) AS vector_dim, 'single' AS kind, 4::BIGINT AS table_version, true AS has_scalar_index, true AS has_fts_index, true AS has_vector_index FROM u",
        "table_list": f"WITH {_TABLE} SELECT row_number() OVER (ORDER BY n DESC, id DESC) AS place, id FROM (SELECT 1 AS n, id FROM h UNION ALL SELECT 2, id FROM c)",
        "table_text_search": f"WITH {_TABLE}, {_bm25('SELECT id, text FROM s', ['the', 'and'], exact=True)} SELECT rid AS id, text, round(score, 6) AS score FROM bm JOIN s USING (id) ORDER BY bm.score DESC, rid LIMIT 50",
        "table_query_modes": _modes(),
        "compact_roundtrip": f"WITH {_TABLE} SELECT id, text, len(vector)::INTEGER AS dim, true AS fewer FROM h",
        "generation_changes": "SELECT n::INTEGER AS write, (n + 1)::BIGINT AS version, true AS changed FROM (SELECT unnest(range(3)) AS n)",
    }
    return out
