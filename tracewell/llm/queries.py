"""Queries of the training-text problems: p5 to p8."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tracewell.llm.eval_leaks import eval_leaks, removal_spans
from tracewell.llm.event_runs import collapse_runs
from tracewell.llm.sentences import sentence_units
from tracewell.llm.source_mix import Mix, mix_sources


def _table(spark: SparkSession, data: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{data}/{name}.parquet")


def p5_found(spark: SparkSession, data: str) -> DataFrame:
    return collapse_runs(_table(spark, data, "trace_events"))


def p6_found(spark: SparkSession, data: str) -> DataFrame:
    return eval_leaks(_table(spark, data, "documents"), _table(spark, data, "eval_items"), spans=False).select("doc_id", "item_id")


def p6_removal_spans(spark: SparkSession, data: str) -> DataFrame:
    return removal_spans(_table(spark, data, "documents"), _table(spark, data, "eval_items"))


def _mix(spark: SparkSession, data: str) -> Mix:
    return mix_sources(_table(spark, data, "documents"), _table(spark, data, "mix_targets"), of_pool=1.0)


def p7_mix_selection(spark: SparkSession, data: str) -> DataFrame:
    return _mix(spark, data).selection


def p7_mix_shares(spark: SparkSession, data: str) -> DataFrame:
    return _mix(spark, data).report


def p7_mix_marginals(spark: SparkSession, data: str) -> DataFrame:
    return _mix(spark, data).marginals


def p8_found(spark: SparkSession, data: str) -> DataFrame:
    return sentence_units(_table(spark, data, "documents"))


QUERIES = {f.__name__: f for f in (p5_found, p6_found, p6_removal_spans, p7_mix_selection, p7_mix_shares, p7_mix_marginals, p8_found)}
ORACLES: dict[str, str] = {
    "p5_found": r"""WITH c AS (SELECT trace_id, tid, seq, min(syscall) AS syscall, min(error) AS error, min(arguments) AS arguments, min(ts) AS ts FROM trace_events GROUP BY trace_id, tid, seq),
    k AS (SELECT *, regexp_replace(array_to_string(list_transform(regexp_extract_all(arguments, '"(?:[^"\\]|\\.)*"(?:\.\.\.)?|[^"]+|"'), lambda t: CASE WHEN length(t) > 1 AND t LIKE '"%' AND t NOT LIKE '"/%' THEN '""' ELSE t END), ''), '0x[0-9a-fA-F]+|[0-9]+', '0', 'g') AS canon,
    CAST(rpad(CASE WHEN contains(ts, '.') THEN split_part(ts, '.', 2) ELSE '' END, 6, '0') AS BIGINT) + 1000000 * CASE WHEN contains(ts, ':') THEN CAST(split_part(ts, ':', 1) AS BIGINT) * 3600 + CAST(split_part(ts, ':', 2) AS BIGINT) * 60 + CAST(split_part(split_part(ts, ':', 3), '.', 1) AS BIGINT) ELSE CAST(split_part(ts, '.', 1) AS BIGINT) END AS us FROM c),
    i AS (SELECT *, row_number() OVER (PARTITION BY trace_id, tid ORDER BY seq) - row_number() OVER (PARTITION BY trace_id, tid, syscall, error, canon ORDER BY seq) AS island FROM k),
    r AS (SELECT trace_id, tid, min(seq) AS first_seq, max(seq) AS last_seq, count(*) AS n_calls, count(us) AS known, arg_max(us, seq) FILTER (WHERE us IS NOT NULL) - arg_min(us, seq) FILTER (WHERE us IS NOT NULL) AS d FROM i GROUP BY trace_id, tid, syscall, error, canon, island HAVING count(*) >= 3)
    SELECT trace_id, tid, first_seq, last_seq, n_calls, CASE WHEN known < 2 THEN 0 WHEN d < 0 THEN d + 86400000000 ELSE d END AS span_us FROM r""",
}
