"""Findings, verdicts and deterministic output."""

from __future__ import annotations

import json
import math
from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.errors import InvalidInput, LimitExceeded

SEVERITIES = ["info", "warn", "fail"]
FINDINGS = "severity string, code string, message string"
SHOWN = 20


@dataclass
class Report:
    """What an operation found, and whether its evidence was complete."""

    findings: DataFrame
    complete: bool = True
    diagnostics: list[str] = field(default_factory=list)

    def is_actionable(self, threshold: str = "warn") -> bool:
        """Missing evidence is always actionable; otherwise any finding at the threshold is."""
        return not self.complete or not self.findings.where(severity_rank(F.col("severity")) >= SEVERITIES.index(threshold)).isEmpty()

    def exit_code(self, threshold: str = "fail") -> int:
        """0 clean, 1 findings; errors, 2, are raised instead."""
        return int(self.is_actionable(threshold))


def severity_rank(severity: Column) -> Column:
    return F.array_position(F.array(*[F.lit(s) for s in SEVERITIES]), severity).cast("int") - 1


def findings(df: DataFrame, severity: str | Column, code: str | Column, message: Column) -> DataFrame:
    """Findings with one row per row of a table."""
    as_column = lambda x: F.lit(x) if isinstance(x, str) else x
    return df.select(as_column(severity).alias("severity"), as_column(code).alias("code"), message.alias("message"))


def no_findings(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], FINDINGS)


def render_findings(found: DataFrame, most: int = SHOWN) -> list[str]:
    """Lines of a text report: failures first, then warnings, at most ``most``; information is not shown."""
    rows = found.where(F.col("severity") != "info").orderBy(severity_rank(F.col("severity")).desc(), "code", "message").limit(most + 1).collect()
    out = [f"{r['severity'].upper()} {r['code']}: {r['message']}" for r in rows[:most]]
    return [*out, "... and more"] if len(rows) > most else out


def to_json(value: object, pretty: bool = False, most_bytes: int | None = None) -> str:
    """JSON with sorted keys; beyond ``most_bytes`` an error instead of a cut text."""
    text = json.dumps(value, sort_keys=True, ensure_ascii=False, indent=2 if pretty else None, separators=None if pretty else (",", ":"), default=str)
    if most_bytes is not None and len(text.encode()) > most_bytes:
        raise LimitExceeded(f"output is longer than {most_bytes} bytes")
    return text


def rows_as_json(df: DataFrame, order: Iterable[str]) -> DataFrame:
    """Each row as one JSON text with sorted keys, in a total order: the text column ``value``."""
    return df.orderBy(*order).select(F.to_json(F.struct(*[F.col(c) for c in sorted(df.columns)])).alias("value"))


def check_schema(document: dict, schema: str, version: int | None = None) -> dict:
    """The document if it says that it has the expected schema; an error otherwise."""
    if document.get("schema") != schema or version is not None and document.get("schema_version") != version:
        raise InvalidInput(f"expected schema {schema}, found {document.get('schema')}")
    return document


def paginate(value: object, limit: int = 200, offset: int = 0, page_path: str | None = None) -> object:
    """A document whose arrays are cut to ``limit`` items, that at ``page_path`` from ``offset`` on, with totals under
    ``_pagination`` by path; items of arrays of arrays share the path ``x[]``."""
    totals: dict[str, dict[str, int]] = {}

    def walk(v: object, path: str) -> object:
        if isinstance(v, dict):
            return {k: walk(x, f"{path}.{k}" if path else k) for k, x in v.items()}
        if isinstance(v, list):
            start = offset if path == (page_path or "") and page_path is not None else 0
            kept = v[start : start + limit]
            t = totals.setdefault(path, {"total": 0, "returned": 0, "offset": start})
            t["total"] += len(v)
            t["returned"] += len(kept)
            return [walk(x, path + "[]") for x in kept]
        return v

    out = walk(value, "")
    if any(t["returned"] < t["total"] for t in totals.values()) and isinstance(out, dict):
        out["_pagination"] = {p: t for p, t in sorted(totals.items()) if t["returned"] < t["total"]}
    return out


def within_budget(value: dict, most_bytes: int = 65536, smaller: int = 25) -> str:
    """JSON of a document within a byte budget: whole, else with short arrays, else without its data."""
    for candidate in (value, paginate(value, smaller)):
        text = to_json(candidate)
        if len(text.encode()) <= most_bytes:
            return text
    return to_json({"_data_omitted": True, "bytes": len(to_json(value).encode())})


def human_bytes(n: int) -> str:
    """A size in binary units."""
    units = ["B", "KiB", "MiB", "GiB", "TiB"]
    i = min(int(math.log(n, 1024)) if n >= 1024 else 0, len(units) - 1)
    return f"{n} B" if i == 0 else f"{n / 1024**i:.1f} {units[i]}"


def bounded(df: DataFrame, order: list[str], most: int) -> tuple[DataFrame, bool]:
    """The first rows of a total order for a report that holds so many, and whether there are more."""
    first = df.orderBy(*order).limit(most + 1)
    return first.limit(most), first.count() > most
