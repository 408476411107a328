"""The test-report domain: cases from XML, run summaries, merging, comparison."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Statuses, mildest first.
STATUSES = ["skipped", "passed", "failed", "error"]
# What a status counts as in a run's digest.
STATUS_BYTES = ["passed", "failed", "error", "skipped"]


def severity(status: Column) -> Column:
    return F.coalesce(F.array_position(F.array(*[F.lit(s) for s in STATUSES]), status), F.lit(0))


def identity(suite: Column, classname: Column, name: Column) -> Column:
    """``suite::classname::name`` without empty parts."""
    return F.concat_ws("::", *[F.nullif(c, F.lit("")) for c in (suite, classname, name)])


class _Reader:
    """Collects cases and properties from one document; a broken document keeps what came before and is incomplete."""

    def __init__(self) -> None:
        self.cases: list[dict] = []
        self.properties: dict[str, str] = {}
        self.open: list[str] = []
        self.suites: list[str] = []
        self.case: dict | None = None
        self.text: list[str] = []
        self.root: str | None = None

    def start(self, tag: str, a: dict[str, str]) -> None:
        self.root = self.root or tag
        self.open.append(tag)
        self.text = []
        if tag == "testsuite":
            self.suites.append(a.get("name", ""))
        elif tag == "testcase":
            try:
                seconds = float(a.get("time", "0") or 0)
            except ValueError:
                seconds = 0.0
            self.case = {"suite": self.suites[-1] if self.suites else "", "classname": a.get("classname", ""), "name": a.get("name", ""), "status": "passed", "duration_sec": seconds if math.isfinite(seconds) and seconds >= 0 else 0.0, "message": None, "output": None}
        elif self.case is not None and tag in ("failure", "error", "skipped"):
            status = {"failure": "failed", "error": "error", "skipped": "skipped"}[tag]
            if not (status == "skipped" and self.case["status"] in ("failed", "error")):
                self.case["status"] = status
            if a.get("message"):
                self.case["message"] = a["message"]
        elif tag == "property" and "name" in a:
            self.properties[a["name"]] = a.get("value", "")

    def data(self, text: str) -> None:
        self.text.append(text)

    def end(self, tag: str) -> None:
        self.open.pop()
        body = "".join(self.text).strip()
        self.text = []
        if self.case is not None:
            if tag in ("failure", "error", "skipped") and body and not self.case["message"]:
                self.case["message"] = body
            elif tag in ("system-out", "system-err") and body:
                self.case["output"] = body if self.case["output"] is None else self.case["output"] + "\n" + body
        if tag == "testcase" and self.case is not None:
            self.cases.append(self.case)
            self.case = None
        elif tag == "testsuite":
            self.suites.pop()


def read_document(content: bytes) -> tuple[list[dict], dict[str, str], bool, str | None]:
    """(cases, properties, complete, error) of one report; an error where it has no report at its root."""
    reader = _Reader()
    parser = expat.ParserCreate()
    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = reader.start, reader.end, reader.data
    complete = True
    try:
        parser.Parse(content, True)
    except expat.ExpatError:
        complete = False
    if reader.root not in ("testsuites", "testsuite"):
        return [], {}, False, "no test report"
    return reader.cases, reader.properties, complete, None


_CASES = "run_id string, path string, seq bigint, suite string, classname string, name string, status string, duration_sec double, message string, output string, complete boolean, error string, properties map<string,string>"


def parse_reports(files: DataFrame) -> DataFrame:
    """Cases of report files (run_id, path, content); a file without cases, or that is no report, has one row with a
    null name, so its completeness and error are not lost."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for run, path, content in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                cases, properties, complete, error = read_document(content or b"")
                common = {"run_id": run, "path": path, "complete": complete, "error": error, "properties": list(properties.items())}
                rows += [common | {"seq": i} | c for i, c in enumerate(cases)] or [common | {"seq": -1}]
            names = [f.split()[0] for f in _CASES.replace("map<string,string>", "map").split(", ")]
            kinds = {"seq": pa.int64(), "duration_sec": pa.float64(), "complete": pa.bool_(), "properties": pa.map_(pa.string(), pa.string())}
            yield pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], kinds.get(n, pa.string())) for n in names], names=names)

    return files.select("run_id", "path", "content").mapInArrow(over, _CASES).withColumn("identity", F.when(F.col("name").isNotNull(), identity(F.col("suite"), F.col("classname"), F.col("name"))))


def unique_cases(cases: DataFrame, keys: tuple[str, ...] = ("run_id",)) -> DataFrame:
    """One case an identity: the gravest; of equal ones the first that has a message, else the first."""
    w = Window.partitionBy(*keys, "identity").orderBy(severity(F.col("status")).desc(), F.col("message").isNull(), "path", "seq")
    return cases.where("identity IS NOT NULL").withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def summary(cases: DataFrame, keys: tuple[str, ...] = ("run_id",)) -> DataFrame:
    """Per run: total, passed, failed, errors, skipped and seconds, and whether every report was complete."""
    is_case = F.col("name").isNotNull()
    counts = [F.count_if(is_case & (F.col("status") == s)).alias(n) for s, n in (("passed", "passed"), ("failed", "failed"), ("error", "errors"), ("skipped", "skipped"))]
    return cases.groupBy(*keys).agg(F.count_if(is_case).alias("total"), *counts, F.coalesce(F.sum("duration_sec"), F.lit(0.0)).alias("duration_sec"), F.bool_and("complete").alias("complete"))


def run_digest(cases: DataFrame, project: str, keys: tuple[str, ...] = ("run_id",)) -> DataFrame:
    """keys and digest_id: a run's name from its content, the project and the first twelve hex digits of the digest of the
    project's name, then each case's identity and a byte for its status, in order of path and place.

    The digest is one over the whole run, so a run is read in order by one task, case by case; none is gathered.
    """
    codes = F.create_map(*[F.lit(x) for i, s in enumerate(STATUS_BYTES) for x in (s, i)])
    ordered = cases.where("identity IS NOT NULL").select(F.to_json(F.struct(*keys)).alias("run"), "path", "seq", "identity", F.coalesce(codes[F.col("status")], F.lit(0)).alias("code")).repartition("run").sortWithinPartitions("run", "path", "seq")

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest = None, hashlib.sha256()
        told = lambda: pa.RecordBatch.from_arrays([pa.array([now]), pa.array([f"{project}-{digest.hexdigest()[:12]}"])], names=["run", "digest_id"])
        for b in batches:
            for run, name, code in zip(*(b.column(i).to_pylist() for i in (0, 3, 4)), strict=True):
                if run != now:
                    if now is not None:
                        yield told()
                    now, digest = run, hashlib.sha256(project.encode())
                digest.update(name.encode() + bytes([code]))
        if now is not None:
            yield told()

    kinds = ", ".join(f"`{k}` {cases.schema[k].dataType.simpleString()}" for k in keys)
    return ordered.mapInArrow(over, "run string, digest_id string").select(*[F.from_json("run", kinds)[k].alias(k) for k in keys], "digest_id")


def merge_runs(cases: DataFrame, project: str) -> DataFrame:
    """One row: the union of all runs as a run of its own. Counts and seconds are summed up, it is complete if all are, of
    properties of one name the last by path holds, and its id is the digest of all cases in order."""
    whole = cases.withColumn("run_id", F.lit(project))
    held = whole.select(F.explode("properties").alias("name", "value"), "path").groupBy("name").agg(F.max_by("value", "path").alias("value"))
    properties = held.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("name", "value")))).alias("properties"))  # the distinct names of one report
    return summary(whole).join(run_digest(whole, project), "run_id", "left").crossJoin(properties)  # one row each


def summary_delta(before: DataFrame, after: DataFrame, keys: tuple[str, ...] = ("run_id",)) -> DataFrame:
    """keys and what changed between two summaries: failed_delta (failed and errors), passed_delta and duration_delta_sec;
    a run that one side lacks counts as empty."""
    side = lambda df, p: df.select(*keys, (F.col("failed") + F.col("errors")).alias(f"{p}_bad"), F.col("passed").alias(f"{p}_passed"), F.col("duration_sec").alias(f"{p}_sec"))
    sides = [side(before, "b").withColumn("__", F.lit(0)), side(after, "a").withColumn("__", F.lit(0))]
    j = sides[0].join(sides[1], [*keys, "__"], "full_outer").fillna(0, ["b_bad", "a_bad", "b_passed", "a_passed", "b_sec", "a_sec"])
    return j.select(*keys, (F.col("a_bad") - F.col("b_bad")).alias("failed_delta"), (F.col("a_passed") - F.col("b_passed")).alias("passed_delta"), (F.col("a_sec") - F.col("b_sec")).alias("duration_delta_sec"))


def diff_runs(before: DataFrame, after: DataFrame) -> DataFrame:
    """(identity, before_status, after_status, change): regression, fix, new_failure, removed or skipped_change; what
    is none of these, such as failed to error, is left out."""
    a, b = before.select("identity", F.col("status").alias("before_status")), after.select("identity", F.col("status").alias("after_status"))
    x, y = F.col("before_status"), F.col("after_status")
    bad = lambda c: c.isin("failed", "error")
    change = (
        F.when(y.isNull(), "removed").when(x.isNull() & bad(y), "new_failure").when(x.isNull(), F.lit(None).cast("string"))
        .when((x == y) | (bad(x) & bad(y)), F.lit(None).cast("string")).when((x == "skipped") | (y == "skipped"), "skipped_change").when((x == "passed") & bad(y), "regression").when(bad(x) & (y == "passed"), "fix")
    )
    return a.join(b, "identity", "full_outer").withColumn("change", change).where("change IS NOT NULL")
