"""Registered queries of the core and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lekhya.operators import nested, orphans, units
from lekhya.plans import reference_queries

Query = Callable[[SparkSession, str], DataFrame]

_RUNS = """
lived AS (
  SELECT c.*, (SELECT min(d.deleted_at) FROM chunk_deletions d WHERE d.chunk_id = c.id AND d.deleted_at >= c.loaded_at) AS gone_at
  FROM (SELECT chunk_row_id, act_slug, id, type, hierarchy.ch AS ch, hierarchy.sec AS sec, hierarchy.sub AS sub,
               hierarchy.clause AS clause, loaded_at FROM chunks) c),
refs AS (
  SELECT chunk_row_id, loaded_at AS ref_at, hierarchy.sec AS sec, i - 1 AS ref_pos, refs[i].id AS rid
  FROM chunks, unnest(range(1, len(refs) + 1)) AS u(i) WHERE refs[i].id IS NOT NULL),
parsed AS (
  SELECT r.*, a.act_slug AS owner, regexp_extract(rid, '^(.*)-(sec|ch|sub|cl)([^-]+)$', 2) AS kind,
         regexp_extract(rid, '^(.*)-(sec|ch|sub|cl)([^-]+)$', 3) AS tail
  FROM refs r LEFT JOIN acts a
    ON regexp_extract(rid, '^(.*)-(sec|ch|sub|cl)([^-]+)$', 1) = a.act_slug || '-' || coalesce(CAST(a.bs_year AS VARCHAR), 'None')),
all_refs AS (
  SELECT 'chunks' AS src_table, chunk_row_id AS src_id, ref_pos, ref_at, EXISTS (
      SELECT 1 FROM lived l WHERE l.act_slug = p.owner AND l.loaded_at <= p.ref_at AND (l.gone_at IS NULL OR l.gone_at > p.ref_at)
        AND CASE p.kind WHEN 'sec' THEN l.sec = try_cast(p.tail AS INT)
                        WHEN 'ch' THEN l.ch = try_cast(p.tail AS INT) AND NOT starts_with(l.type, 'anusuchi')
                        WHEN 'sub' THEN l.sub = try_cast(p.tail AS INT) AND l.sec IS NOT DISTINCT FROM p.sec
                        WHEN 'cl' THEN l.clause = p.tail AND l.sec IS NOT DISTINCT FROM p.sec END) AS alive
, EXISTS (
      SELECT 1 FROM lived l WHERE l.act_slug = p.owner
        AND CASE p.kind WHEN 'sec' THEN l.sec = try_cast(p.tail AS INT)
                        WHEN 'ch' THEN l.ch = try_cast(p.tail AS INT) AND NOT starts_with(l.type, 'anusuchi')
                        WHEN 'sub' THEN l.sub = try_cast(p.tail AS INT) AND l.sec IS NOT DISTINCT FROM p.sec
                        WHEN 'cl' THEN l.clause = p.tail AND l.sec IS NOT DISTINCT FROM p.sec END) AS ever
  FROM parsed p
  UNION ALL
  SELECT 'entities', entity_id, 0, extracted_at, EXISTS (
      SELECT 1 FROM lived l WHERE l.id = e.chunk_id AND l.loaded_at <= e.extracted_at AND (l.gone_at IS NULL OR l.gone_at > e.extracted_at)),
    EXISTS (SELECT 1 FROM lived l WHERE l.id = e.chunk_id)
  FROM entities e WHERE chunk_id IS NOT NULL)
"""

_FEES = r"""
raw AS (SELECT result_id, regexp_extract(payload, '(?s)\{.*\}') AS j FROM ner_results WHERE payload IS NOT NULL),
good AS (SELECT result_id, CAST(j AS JSON) AS j FROM raw WHERE json_valid(j)),
w0 AS (SELECT result_id, j->'$.workflows' AS w FROM good),
w1 AS (SELECT result_id, CASE json_type(w) WHEN 'OBJECT' THEN json_array(w) WHEN 'VARCHAR' THEN CAST(w->>'$' AS JSON) ELSE w END AS w FROM w0),
flows AS (SELECT result_id, i AS pos1, json_extract(w, '$[' || i || ']') AS f FROM w1, unnest(range(0, coalesce(json_array_length(w), 0)::BIGINT)) AS u(i)),
f0 AS (SELECT result_id, pos1, f->'$.all_fees' AS a FROM flows),
f1 AS (SELECT result_id, pos1, CASE json_type(a) WHEN 'OBJECT' THEN json_array(a) WHEN 'VARCHAR' THEN CAST(a->>'$' AS JSON) ELSE a END AS a FROM f0),
fees AS (SELECT result_id, pos1, k AS pos2, json_extract(a, '$[' || k || ']') AS fee FROM f1, unnest(range(0, coalesce(json_array_length(a), 0)::BIGINT)) AS v(k))
"""

_P2 = f"""
WITH {_FEES}
SELECT 'hierarchy' AS child, chunk_row_id AS root_id, p AS pos1, 0 AS pos2
FROM chunks, (VALUES (1), (2), (3), (4)) AS l(p)
WHERE CASE p WHEN 1 THEN hierarchy.ch IS NOT NULL WHEN 2 THEN hierarchy.sec IS NOT NULL
             WHEN 3 THEN hierarchy.sub IS NOT NULL ELSE hierarchy.clause IS NOT NULL END
UNION ALL
SELECT 'refs', chunk_row_id, CAST(i - 1 AS INT), 0 FROM chunks, unnest(range(1, len(refs) + 1)) AS u(i) WHERE refs[i] IS NOT NULL
UNION ALL
SELECT 'all_fees', result_id, CAST(pos1 AS INT), CAST(pos2 AS INT) FROM fees WHERE json_type(fee) <> 'NULL'
"""


def queries() -> dict[str, Query]:
    return {
        "p2_found": nested.p2_found,
        "p2_bridge": nested.p2_bridge,
        "p2_objects": nested.p2_objects,
        "p2_levels": nested.p2_levels,
        "p2_fees": nested.p2_fees,
        "p2_refs": nested.p2_refs,
        "p3_found": orphans.p3_found,
        "p3_report": orphans.p3_report,
        "p6_found": units.p6_found,
        "p6_report": units.p6_report,
        **reference_queries.queries(),
    }


def oracle_sql() -> dict[str, str]:
    return {
        "p2_found": _P2,
        "p2_refs": """SELECT chunk_row_id, CAST(i - 1 AS INT) AS ref_pos, refs[i].type AS ref_type, refs[i].id AS ref_id, refs[i].text AS ref_text
            FROM chunks, unnest(range(1, len(refs) + 1)) AS u(i) WHERE refs[i] IS NOT NULL""",
        "p2_levels": " UNION ALL ".join(
            f"SELECT chunk_row_id, {i} AS level_pos, '{name}' AS level, CAST(hierarchy.{name} AS VARCHAR) AS level_no, {f'hierarchy.{title}' if title else 'NULL'} AS title FROM chunks WHERE hierarchy.{name} IS NOT NULL"
            for i, (name, title) in enumerate(nested.LEVELS, 1)
        ),
        "p2_fees": f"""WITH {_FEES} SELECT result_id, CAST(pos1 AS INT) AS flow_pos, CAST(pos2 AS INT) AS fee_pos, fee->>'type' AS fee_type, fee->>'amount_raw' AS amount_raw,
            fee->>'amount_npr' AS amount_npr FROM fees WHERE json_type(fee) <> 'NULL'""",
        "p3_found": f"WITH {_RUNS} SELECT src_table, src_id, CAST(ref_pos AS INT) AS ref_pos FROM all_refs WHERE NOT alive",
        "p3_report": f"""WITH {_RUNS} SELECT src_table, strftime(ref_at, '%Y-%m') AS month, CASE WHEN ever THEN 'dead' ELSE 'never' END AS reason, count(*) AS n_orphans
            FROM all_refs WHERE NOT alive GROUP BY ALL""",
        **reference_queries.oracle_sql(),
    }
