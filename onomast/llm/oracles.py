"""SQL (DuckDB) for the queries that SQL can express over whole tables."""

from __future__ import annotations

from onomast.llm.chat import Template

_WORDS = r"'[^\x20\x09-\x0D]+'"

OP1 = f"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), {_WORDS})) AS BIGINT) AS size,
         md5('mix|' || coalesce(CAST(doc_id AS VARCHAR), '') || '|' || md5(coalesce(text, ''))) AS o
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (
  SELECT *, CAST([5, 2, 1][1 + (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3] AS DOUBLE) AS weight,
         2.0 * source_size AS cap, 1.5 * (SELECT sum(source_size) FROM s) AS budget
  FROM s),
f AS (
  SELECT *, (budget - coalesce(sum(cap) OVER (q ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) * weight
            / sum(weight) OVER (q ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) > cap AS capped
  FROM w WINDOW q AS (ORDER BY cap / weight, source IS NULL, source)),
t AS (
  SELECT source, source_size,
         CASE WHEN capped THEN cap ELSE (budget - (SELECT coalesce(sum(cap), 0) FROM f WHERE capped)) * weight
              / (SELECT sum(weight) FROM f WHERE NOT capped) END AS target
  FROM f),
e AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM t),
x AS (
  SELECT d.doc_id, d.o, d.size, e.source_size, e.target, e.whole, e.target - e.whole * e.source_size AS rest,
         sum(d.size) OVER (PARTITION BY d.source ORDER BY d.o, d.size ROWS UNBOUNDED PRECEDING) - d.size / 2.0 AS mid
  FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, size, source_size, target, CAST((whole + CASE WHEN mid <= rest THEN 1 ELSE 0 END) * size AS BIGINT) AS taken FROM x
"""

OP6 = """
WITH p AS (
  SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
f AS (
  SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) END AS first FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM f
"""


def _op7(t: Template = Template()) -> str:
    pattern = t.pattern.replace("'", "''")
    fixed = len(t.begin + t.role_begin + t.role_end + t.end)
    chars = lambda c: f"length(regexp_replace({c}, '{pattern}', '\\1\\\\\\2\\3', 'g'))"
    loss = ", ".join(f"'{r}'" for r in t.loss_roles)
    return f"""
WITH r AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
g AS (
  SELECT conv_id, count(*) AS n_turns,
         string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS lines,
         coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role IN ({loss})), '') AS loss,
         CAST(sum({fixed} + {chars("role")} + {chars("text")}) AS BIGINT) AS formatted_chars
  FROM r GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(lines) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars FROM g
"""


OP8 = r"""
WITH words AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item, n, array_to_string(w[i : i + n - 1], ' ') AS s
  FROM (SELECT item, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM items WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM windows),
places AS (SELECT rid, n, unnest(range(1, len(w) - n + 2)) AS i, w FROM words JOIN sizes ON len(w) >= n),
found AS (SELECT rid, p.n, i, item FROM places p JOIN windows v ON p.n = v.n AND array_to_string(p.w[i : i + p.n - 1], ' ') = v.s),
marked AS (SELECT rid, count(DISTINCT k) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS k FROM found) GROUP BY rid),
named AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT rid, item FROM found WHERE item IS NOT NULL) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM words LEFT JOIN marked USING (rid) LEFT JOIN named USING (rid)
"""

SHARDS = """
SELECT count(*) AS n_rows, CAST(coalesce(sum(strlen(coalesce(text, ''))), 0) AS BIGINT) AS bytes, CAST(0 AS BIGINT) AS too_large,
       CAST(0 AS BIGINT) AS split_for_nothing, CAST(0 AS BIGINT) AS sizes_differ
FROM documents
"""

ORACLES: dict[str, str] = {"op1_mix_sources": OP1, "op6_warc": OP6, "op7_chat": _op7(), "op8_decontaminate": OP8, "shard_invariants": SHARDS}
