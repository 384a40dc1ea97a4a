"""Nested exports as flat tables, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from millrace.operators import nested
from millrace.plans.runtime import spread, table


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return nested.export_links(spread(table(spark, d, "raw_export").select("export_id", "payload")))


def _ref(doc: str, key: str) -> str:
    """A scalar key as text, null where there is none."""
    return f"CASE WHEN json_type({doc}, '$.{key}') = 'VARCHAR' THEN nullif({doc} ->> '{key}', '') WHEN json_type({doc}, '$.{key}') NOT IN ('NULL', 'ARRAY', 'OBJECT') THEN ({doc} -> '{key}')::VARCHAR END"


_BLANK = "'\ufeff' || ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13) || chr(160) || chr(12288)"
_EXPORT_LINKS = f"""
WITH RECURSIVE ex AS (SELECT DISTINCT ON (export_id) export_id, ltrim(payload, {_BLANK}) AS p FROM raw_export WHERE payload <> ''),
lines AS (SELECT export_id, unnest(range(len(l))) AS i, unnest(l) AS line FROM (SELECT export_id, list_filter(string_split(p, chr(10)), lambda x: trim(x, {_BLANK}) <> '') AS l FROM ex WHERE NOT json_valid(p)) WHERE len(list_filter(l, lambda x: NOT json_valid(ltrim(x, {_BLANK})))) = 0),
nodes(export_id, path, j, opened) AS (
  SELECT export_id, []::BIGINT[], p::JSON, true FROM ex WHERE json_valid(p)
  UNION ALL SELECT export_id, [i::BIGINT], ltrim(line, {_BLANK})::JSON, true FROM lines
  UNION ALL SELECT export_id, list_append(path, i), c, opened FROM (
    SELECT export_id, path, unnest(range(len(cs))) AS i, unnest(cs) AS c, opened FROM (
      SELECT export_id, path, NOT own AS opened, CASE
        WHEN json_type(j) = 'ARRAY' THEN from_json(j, '["JSON"]')
        WHEN json_type(j) = 'OBJECT' THEN list_transform(list_filter(json_keys(j), lambda k: NOT own OR k NOT IN ('chat_messages', 'mapping', 'per_image')), lambda k: json_extract(j, '$."' || k || '"'))
        WHEN json_type(j) = 'VARCHAR' AND opened AND left(ltrim(j ->> '$', {_BLANK}), 1) IN ('{{', '[', '"') AND json_valid(ltrim(j ->> '$', {_BLANK})) THEN [ltrim(j ->> '$', {_BLANK})::JSON] ELSE [] END AS cs
      FROM (SELECT *, json_type(j) = 'OBJECT' AND list_has_any(json_keys(j), ['chat_messages', 'mapping', 'per_image']) AS own FROM nodes)))),
recs AS (SELECT export_id, j, row_number() OVER (PARTITION BY export_id ORDER BY path) - 1 AS pos FROM nodes WHERE json_type(j) = 'OBJECT' AND list_has_any(json_keys(j), ['chat_messages', 'mapping', 'per_image'])),
conv AS (SELECT export_id, j, coalesce({_ref("j", "uuid")}, {_ref("j", "id")}, '@' || pos) AS ref FROM recs WHERE list_has_any(json_keys(j), ['chat_messages', 'mapping'])),
listed AS (SELECT export_id, ref AS up, unnest(range(len(ms))) AS pos, unnest(ms) AS m FROM (SELECT *, CASE WHEN json_type(j, '$.chat_messages') = 'ARRAY' THEN from_json(j -> 'chat_messages', '["JSON"]') ELSE [] END AS ms FROM conv)),
mapped AS (SELECT export_id, ref AS up, k, pos, json_extract(j, '$.mapping."' || k || '".message') AS m FROM (SELECT *, unnest(ks) AS k, unnest(range(len(ks))) AS pos FROM (SELECT *, CASE WHEN json_type(j, '$.mapping') = 'OBJECT' THEN json_keys(j, '$.mapping') ELSE [] END AS ks FROM conv))),
msg AS (SELECT export_id, up, coalesce({_ref("m", "uuid")}, up || '/@' || pos) AS ref, m FROM listed UNION ALL SELECT export_id, up, coalesce(nullif(k, ''), {_ref("m", "uuid")}, up || '/@' || pos), m FROM mapped WHERE json_type(m) <> 'NULL'),
bodies AS (SELECT export_id, ref, m -> 'text' AS body FROM msg UNION ALL SELECT export_id, ref, m -> 'content' -> 'parts' FROM msg WHERE json_type(m, '$.content') = 'OBJECT'),
pieces AS (SELECT export_id, ref, unnest(range(len(ps))) AS pos, unnest(ps) AS p FROM (SELECT *, CASE WHEN json_type(body) = 'ARRAY' THEN from_json(body, '["JSON"]') ELSE [body] END AS ps FROM bodies WHERE body IS NOT NULL)),
imgs AS (SELECT export_id, k, json_extract(j, '$.per_image."' || k || '"') AS f FROM (SELECT export_id, j, unnest(json_keys(j, '$.per_image')) AS k FROM recs WHERE json_type(j, '$.per_image') = 'OBJECT'))
SELECT DISTINCT * FROM (
  SELECT export_id, 'conversation' AS level_name, '' AS parent_ref, ref AS child_ref FROM conv
  UNION ALL SELECT export_id, 'message', up, ref FROM msg
  UNION ALL SELECT export_id, 'part', ref, pos::VARCHAR FROM pieces WHERE json_type(p) <> 'NULL' AND p::VARCHAR NOT IN ('""', '[]', '{{}}')
  UNION ALL SELECT export_id, 'image', '', k FROM imgs
  UNION ALL SELECT export_id, 'detector', k, d FROM imgs, (VALUES ('face'), ('eyes'), ('hands')) t(d) WHERE json_type(f, '$.' || d) <> 'NULL')
"""
QUERIES = {"p6_found": p6_found}
SQL = {"p6_found": _EXPORT_LINKS}
