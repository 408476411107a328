"""Queries of the core problems: p1 to p4."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.functions.timestamps import normalise
from tracewell.operators.feed_parse import unusable, usable_commands, usable_sockets
from tracewell.operators.log_entries import log_entries
from tracewell.operators.snapshot_diff import diff_snapshots, listener_records, section_records, unit_records
from tracewell.session import table


def p1_found(spark: SparkSession, data: str) -> DataFrame:
    return unusable(table(spark, data, "feed_rows"))


def p1_sockets(spark: SparkSession, data: str) -> DataFrame:
    return usable_sockets(table(spark, data, "feed_rows"))


def p1_commands(spark: SparkSession, data: str) -> DataFrame:
    return usable_commands(table(spark, data, "feed_rows"))


def p2_found(spark: SparkSession, data: str) -> DataFrame:
    rows = listener_records(table(spark, data, "sockets")).unionByName(unit_records(table(spark, data, "compile_units"))).unionByName(section_records(table(spark, data, "bundle_entries")))
    return diff_snapshots(rows)


def p2_units(spark: SparkSession, data: str) -> DataFrame:
    return diff_snapshots(unit_records(table(spark, data, "compile_units")))


def p2_sections(spark: SparkSession, data: str) -> DataFrame:
    return diff_snapshots(section_records(table(spark, data, "bundle_entries")))


def p3_found(spark: SparkSession, data: str) -> DataFrame:
    records = table(spark, data, "log_records").select(F.lit("log_records").alias("tbl"), F.col("record_id").alias("row_id"), "file", F.col("stamp").alias("written"))
    buckets = table(spark, data, "log_buckets").select(F.lit("log_buckets").alias("tbl"), F.col("bucket_id").alias("row_id"), "file", F.col("bucket_start").alias("written"))
    known = normalise(records.unionByName(buckets), "written", table(spark, data, "log_sources"))
    return known.where("ts_ms IS NOT NULL AND row_id IS NOT NULL").groupBy("tbl", "row_id").agg(F.min("ts_ms").alias("ts_ms"))


def p4_found(spark: SparkSession, data: str) -> DataFrame:
    return log_entries(table(spark, data, "log_lines"), table(spark, data, "log_sources")).drop("layout")


QUERIES = {f.__name__: f for f in (p1_found, p1_sockets, p1_commands, p2_found, p2_units, p2_sections, p3_found, p4_found)}


def _diff_sql(tbl: str, scope: str, records: str) -> str:
    """Neighbouring snapshots of each scope, joined by key; records gives scope, snapshot_no, k and v."""
    return f"""WITH n AS (SELECT scope, snapshot_no, lag(snapshot_no) OVER (PARTITION BY scope ORDER BY snapshot_no) AS before FROM (SELECT DISTINCT {scope} AS scope, snapshot_no FROM {tbl})), e AS ({records}),
    a AS (SELECT n.scope, n.snapshot_no, e.k, e.v FROM n JOIN e ON e.scope = n.scope AND e.snapshot_no = n.snapshot_no WHERE before IS NOT NULL), b AS (SELECT n.scope, n.snapshot_no, e.k, e.v FROM n JOIN e ON e.scope = n.scope AND e.snapshot_no = n.before)
    SELECT * FROM (SELECT '{tbl}' AS tbl, coalesce(a.scope, b.scope) AS scope, CAST(coalesce(a.snapshot_no, b.snapshot_no) AS BIGINT) AS snapshot_no, coalesce(a.k, b.k) AS record_key, CASE WHEN b.k IS NULL THEN 'added' WHEN a.k IS NULL THEN 'removed' WHEN a.v IS DISTINCT FROM b.v THEN 'changed' END AS change
    FROM a FULL JOIN b ON a.scope = b.scope AND a.snapshot_no = b.snapshot_no AND a.k = b.k) WHERE change IS NOT NULL"""


_SET = "list_sort(list_distinct(coalesce({0}, []::VARCHAR[])))"
_UNITS = f"SELECT project AS scope, snapshot_no, file AS k, max(coalesce(compiler, '') || '|' || coalesce(standard, '-') || '|' || CAST({_SET.format('includes')} AS VARCHAR) || CAST({_SET.format('defines')} AS VARCHAR) || CAST({_SET.format('flags')} AS VARCHAR) || CAST(coalesce(forced_includes, []::VARCHAR[]) AS VARCHAR)) AS v FROM compile_units GROUP BY 1, 2, 3"
_SECTIONS = r"SELECT host AS scope, snapshot_no, regexp_replace(trim(name), '^(\./)+', '') AS k, max(lower(trim(sha256))) AS v FROM bundle_entries WHERE regexp_matches(trim(name), '^(\./)*reports/[^/]+\.json$') GROUP BY 1, 2, 3"
# groups of an address without a dotted tail: both sides of '::', filled up with zeros, leading zeros off; the longest run of zeros folds
_IPV6 = r"""(SELECT host, snapshot_no, kind, local_port, CASE WHEN kind = 'tcp' THEN a WHEN z = '' THEN array_to_string(g, ':') ELSE array_to_string(g[:(strpos(f, z) - 1)], ':') || '::' || array_to_string(g[(strpos(f, z) + length(z)):], ':') END AS address
    FROM (SELECT *, coalesce(CASE WHEN f LIKE '%00000000%' THEN '00000000' WHEN f LIKE '%0000000%' THEN '0000000' WHEN f LIKE '%000000%' THEN '000000' WHEN f LIKE '%00000%' THEN '00000' WHEN f LIKE '%0000%' THEN '0000' WHEN f LIKE '%000%' THEN '000' WHEN f LIKE '%00%' THEN '00' END, '') AS z
    FROM (SELECT *, array_to_string(list_transform(g, lambda x: CASE WHEN x = '0' THEN '0' ELSE '1' END), '') AS f
    FROM (SELECT *, list_transform(list_filter(string_split(l, ':'), lambda x: x <> '') || list_transform(range(CASE WHEN contains(a, '::') THEN 8 - len(list_filter(string_split(l, ':'), lambda x: x <> '')) - len(list_filter(string_split(r, ':'), lambda x: x <> '')) ELSE 0 END), lambda x: '0') || list_filter(string_split(r, ':'), lambda x: x <> ''), lambda x: coalesce(nullif(ltrim(x, '0'), ''), '0')) AS g
    FROM (SELECT host, snapshot_no, lower(trim(kind)) AS kind, local_port, lower(trim(local_address)) AS a, split_part(lower(trim(local_address)), '::', 1) AS l, split_part(lower(trim(local_address)), '::', 2) AS r FROM sockets WHERE lower(trim(kind)) IN ('tcp', 'tcp6') AND upper(trim(state)) = 'LISTEN')))))"""
_LISTENERS = f"SELECT DISTINCT host AS scope, snapshot_no, kind || '|' || address || '|' || local_port AS k, '' AS v FROM {_IPV6}"
ORACLES = {
    "p2_found": " UNION ALL ".join(f"(SELECT * FROM ({_diff_sql(*x)}))" for x in (("sockets", "host", _LISTENERS), ("compile_units", "project", _UNITS), ("bundle_entries", "host", _SECTIONS))),
    "p2_units": _diff_sql("compile_units", "project", _UNITS),
    "p2_sections": _diff_sql("bundle_entries", "host", _SECTIONS),
}
