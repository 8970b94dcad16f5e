"""Queries of the general data problems (timestamps, snapshot changes) and their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tindra.operators import snapshots, timestamps
from tindra.tables import load

#: table, key, fields, zone of values without one
_STAMPED = (
    ("jobs", "job_id", ["published_at", "deadline"], "Europe/Oslo"),
    ("activities", "activity_id", ["activity_date"], "Europe/Oslo"),
    ("evidence", "evidence_id", ["retrieved_at"], "UTC"),
)


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    parts = [
        timestamps.rewritten(load(spark, folder, table), key, fields, zone).select(F.lit(table).alias("source_table"), "record_id", "field", "normal_form")
        for table, key, fields, zone in _STAMPED
    ]
    return reduce(DataFrame.unionByName, parts)


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return snapshots.profile_changes(load(spark, folder, "snapshots"))


QUERIES = {"p3_found": p3_found, "p4_found": p4_found}

_P4_SQL = """
WITH latest AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY delivery_no, organisation_number ORDER BY captured_at DESC, snapshot_id DESC) AS rn FROM snapshots) WHERE rn = 1),
companies AS (SELECT delivery_no, organisation_number FROM latest),
deliveries AS (SELECT delivery_no, lag(delivery_no) OVER (ORDER BY delivery_no) AS before FROM (SELECT DISTINCT delivery_no FROM latest)),
claim_rows AS (
  SELECT delivery_no, organisation_number, 'claim' AS entity_type, e.key AS entity_key, e.value AS content
  FROM (SELECT delivery_no, organisation_number, unnest(map_entries(claims)) AS e FROM latest)
  WHERE e.value IS NOT NULL AND e.key NOT IN ('retrieved_at', 'captured_at', 'query_time')),
job_rows AS (
  SELECT DISTINCT delivery_no, organisation_number, 'job' AS entity_type, j.job_id AS entity_key,
    concat_ws('|', coalesce('t' || j.title, 'n'), coalesce('t' || j.source_url, 'n'), coalesce('t' || j.posted_date, 'n')) AS content
  FROM (SELECT delivery_no, organisation_number, unnest(jobs) AS j FROM latest) WHERE j.job_id IS NOT NULL),
activity_rows AS (
  SELECT DISTINCT delivery_no, organisation_number, 'activity' AS entity_type, a.activity_id AS entity_key,
    concat_ws('|', coalesce('t' || a.activity_type, 'n'), coalesce('t' || a.title, 'n'), coalesce('t' || a.activity_date, 'n'), coalesce('t' || a.source_url, 'n')) AS content
  FROM (SELECT delivery_no, organisation_number, unnest(activities) AS a FROM latest) WHERE a.activity_id IS NOT NULL),
entities AS (
  SELECT delivery_no, organisation_number, entity_type, entity_key, string_agg(content, '#' ORDER BY content) AS content
  FROM (SELECT * FROM claim_rows UNION ALL SELECT * FROM job_rows UNION ALL SELECT * FROM activity_rows) GROUP BY ALL),
now_e AS (SELECT e.*, d.delivery_no AS pair FROM entities e JOIN deliveries d ON e.delivery_no = d.delivery_no WHERE d.before IS NOT NULL),
old_e AS (SELECT e.*, d.delivery_no AS pair FROM entities e JOIN deliveries d ON e.delivery_no = d.before),
now_c AS (SELECT d.delivery_no AS pair, c.organisation_number FROM companies c JOIN deliveries d ON c.delivery_no = d.delivery_no WHERE d.before IS NOT NULL),
old_c AS (SELECT d.delivery_no AS pair, c.organisation_number FROM companies c JOIN deliveries d ON c.delivery_no = d.before),
kept AS (SELECT pair, organisation_number FROM now_c INTERSECT SELECT pair, organisation_number FROM old_c)
SELECT pair AS delivery_no, organisation_number, 'company' AS entity_type, organisation_number AS entity_key,
  CASE WHEN o.pair IS NULL THEN 'ADDED' ELSE 'REMOVED' END AS change_type
FROM (SELECT pair, organisation_number FROM now_c EXCEPT SELECT pair, organisation_number FROM kept
      UNION ALL SELECT pair, organisation_number FROM old_c EXCEPT SELECT pair, organisation_number FROM kept)
LEFT JOIN old_c o USING (pair, organisation_number)
UNION ALL
SELECT pair AS delivery_no, organisation_number, entity_type, entity_key,
  CASE WHEN o.content IS NULL THEN 'ADDED' WHEN n.content IS NULL THEN 'REMOVED' ELSE 'CHANGED' END AS change_type
FROM now_e n FULL OUTER JOIN old_e o USING (pair, organisation_number, entity_type, entity_key)
JOIN kept USING (pair, organisation_number)
WHERE n.content IS DISTINCT FROM o.content
"""

SQL = {"p4_found": _P4_SQL}
