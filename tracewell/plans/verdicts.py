"""Findings of each domain, from its result tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracewell.report import findings


def _text(*parts: str | Column) -> Column:
    """Columns by name, and literals marked by ``=``, as one text."""
    return F.concat(*[F.lit(p[1:]) if isinstance(p, str) and p.startswith("=") else F.coalesce(F.col(p).cast("string"), F.lit("")) if isinstance(p, str) else p for p in parts])


def trace(leaks: DataFrame) -> DataFrame:
    return findings(leaks, "fail", "trace.fd_leak", _text("=descriptor ", "fd", "= of ", "tid", "= was never closed"))


def trace_diff(stats: DataFrame, new_errors: DataFrame) -> DataFrame:
    shifts = findings(stats.where("latency_percent IS NOT NULL"), "warn", "trace.latency_shift", _text("syscall", "= is slower by ", "latency_percent", "= percent"))
    return shifts.unionByName(findings(new_errors, "fail", "trace.new_error", _text("error_key")))


def tests(summary: DataFrame) -> DataFrame:
    bad = summary.where("failed + errors > 0")
    return findings(bad, "warn", "test.failures", _text((F.col("failed") + F.col("errors")).cast("string"), "= cases failed"))


def test_diff(changes: DataFrame) -> DataFrame:
    rows = changes.where(F.col("change").isin("regression", "new_failure", "removed"))
    severity = F.when(F.col("change") == "removed", "warn").otherwise("fail")
    return findings(rows, severity, F.concat(F.lit("test."), F.col("change")), _text("identity"))


def disk(groups: DataFrame) -> DataFrame:
    return findings(groups, "info", "disk.duplicates", _text("copies", "= copies of ", "size", "= bytes"))


def net(sockets: DataFrame) -> DataFrame:
    return findings(sockets.where("owner_state = 'orphan'"), "warn", "net.orphan", _text("kind", "= ", "local_address", "=:", "local_port"))


def net_diff(changes: DataFrame) -> DataFrame:
    code = F.when(F.col("change") == "new_listener", "net.new_listener").when(F.col("change") == "closed_listener", "net.closed_listeners").otherwise("net.connection_delta")
    return findings(changes, F.when(F.col("change") == "new_listener", "fail").otherwise("info"), code, _text("kind", "= ", "local_address", "=:", "local_port"))


def units(cycles: DataFrame, diagnostics: DataFrame) -> DataFrame:
    """cycles: members; diagnostics: unit, diagnostic."""
    return findings(cycles, "fail", "sys.cycle", F.array_join("members", " -> ")).unionByName(findings(diagnostics.where("diagnostic IS NOT NULL"), "warn", "sys.diagnostic", _text("unit", "=: ", "diagnostic")))


def unit_diff(changes: DataFrame, new_cycles: DataFrame, resolved: DataFrame) -> DataFrame:
    out = findings(changes.select("unit", "change").distinct(), "info", "sys.unit_changes", _text("unit", "= ", "change"))
    return out.unionByName(findings(new_cycles, "fail", "sys.new_cycle", F.array_join("members", " -> "))).unionByName(findings(resolved, "info", "sys.resolved_cycles", F.array_join("members", " -> ")))


def environment(states: DataFrame, shadows: DataFrame) -> DataFrame:
    severity = F.when(F.col("state") == "unevaluated", "info").otherwise("fail")
    out = findings(states, severity, F.concat(F.lit("env."), F.col("state")), _text("package", "= needs ", "requirement"))
    return out.unionByName(findings(shadows, "warn", "env.shadowing", _text("module", "= hides ", "shadows")))


def environment_diff(changes: DataFrame) -> DataFrame:
    return findings(changes, "info", "env.package_changes", _text("norm_name", "= ", "change"))


def build(not_in_graph: DataFrame, incomplete: DataFrame) -> DataFrame:
    """not_in_graph: path; incomplete: path of units whose includes could not all be read."""
    return findings(not_in_graph, "warn", "build.not_in_graph", _text("path")).unionByName(findings(incomplete, "warn", "build.incomplete_graph", _text("path")))


def build_diff(changes: DataFrame) -> DataFrame:
    return findings(changes, "info", "build.unit_changes", _text("file", "= ", "change"))


def abi(verdicts: DataFrame) -> DataFrame:
    """verdicts: what, verdict. Uncertain evidence fails as well."""
    return findings(verdicts.where("verdict <> 'compatible'"), "fail", F.concat(F.lit("abi."), F.col("verdict")), _text("what"))


def bundle(verdicts: DataFrame) -> DataFrame:
    return findings(verdicts.where("verdict <> 'ok'"), "fail", "bundle.integrity", _text("bundle", "=: ", "name", "= ", "verdict"))


def bundle_diff(changes: DataFrame) -> DataFrame:
    only = changes.where(F.col("change").isin("only_in_baseline", "only_in_candidate"))
    return findings(only, "info", F.concat(F.lit("bundle."), F.col("change")), _text("name"))


def health(checks: DataFrame) -> DataFrame:
    bad = checks.where(F.col("status").isin("warn", "fail"))
    return findings(bad, F.col("status"), F.concat(F.lit("doctor."), F.col("category")), _text("name"))


def health_diff(changes: DataFrame) -> DataFrame:
    severity = F.when(F.col("change") == "regressed", F.col("after_status")).otherwise("info")
    return findings(changes, severity, F.concat(F.lit("doctor."), F.col("change")), _text("category", "=/", "name"))
