"""Queries of problem 2: only the papers that the next run of a harvest must process."""

from __future__ import annotations

from quillspark.operators.incremental import changed_records, resume_points
from quillspark.storage import table


def p2_found(spark, d):
    return changed_records(table(spark, d, "harvest_records"), table(spark, d, "harvest_states")).select("harvest_id", "base_id")


def p2_resume_points(spark, d):
    return resume_points(table(spark, d, "harvest_records"), table(spark, d, "harvest_states"))


QUERIES = {"p2_found": p2_found, "p2_resume_points": p2_resume_points}

_POINTS = """
scopes AS (SELECT DISTINCT harvest_id, set_spec, metadata_prefix FROM harvest_records),
saved AS (
  SELECT *, row_number() OVER w AS k, lead(rows_written) OVER w AS before
  FROM (SELECT DISTINCT harvest_id, set_spec, metadata_prefix, saved_at, state_id, CAST(rows_written AS BIGINT) AS rows_written FROM harvest_states WHERE rows_written IS NOT NULL)
  WINDOW w AS (PARTITION BY harvest_id, set_spec, metadata_prefix ORDER BY saved_at DESC NULLS LAST, state_id DESC NULLS LAST)),
points AS (
  SELECT s.harvest_id, s.set_spec, s.metadata_prefix, coalesce(rows_written, 0) AS done, least(coalesce(before, 0), coalesce(rows_written, 0)) AS reread_from
  FROM scopes s LEFT JOIN (SELECT * FROM saved WHERE k = 1) v
    ON s.harvest_id IS NOT DISTINCT FROM v.harvest_id AND s.set_spec IS NOT DISTINCT FROM v.set_spec AND s.metadata_prefix IS NOT DISTINCT FROM v.metadata_prefix)
"""

SQL = {
    "p2_resume_points": f"WITH {_POINTS} SELECT * FROM points",
    "p2_found": f"""
WITH {_POINTS},
rows AS (
  SELECT r.*, p.done, trim(regexp_replace(title, '\\s+', ' ', 'g')) AS t, trim(regexp_replace(abstract, '\\s+', ' ', 'g')) AS a
  FROM harvest_records r JOIN points p ON r.harvest_id = p.harvest_id AND r.set_spec IS NOT DISTINCT FROM p.set_spec AND r.metadata_prefix IS NOT DISTINCT FROM p.metadata_prefix),
pending AS (SELECT *, row_number() OVER (PARTITION BY harvest_id, base_id ORDER BY feed_pos DESC) AS k FROM rows WHERE feed_pos > done),
written AS (SELECT *, row_number() OVER (PARTITION BY harvest_id, base_id ORDER BY feed_pos DESC) AS k FROM rows WHERE feed_pos <= done)
SELECT p.harvest_id, p.base_id
FROM (SELECT * FROM pending WHERE k = 1) p LEFT JOIN (SELECT * FROM written WHERE k = 1) w ON p.harvest_id = w.harvest_id AND p.base_id = w.base_id
WHERE w.base_id IS NULL OR p.status IS DISTINCT FROM w.status OR p.version IS DISTINCT FROM w.version OR p.t IS DISTINCT FROM w.t OR p.a IS DISTINCT FROM w.a
   OR p.authors IS DISTINCT FROM w.authors OR p.categories IS DISTINCT FROM w.categories OR p.license IS DISTINCT FROM w.license OR p.doi IS DISTINCT FROM w.doi
""",
}
