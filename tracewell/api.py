"""One entry per kind of input: look at a path, compare two, take a snapshot of a host as a bundle."""

from __future__ import annotations

import json
import os
import platform
import re
import time
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracewell.errors import Unsupported
from tracewell.operators import build, bundle, disk, elf, graph, health, junit, logs, net, pyenv, trace, units
from tracewell.sources import files
from tracewell.report import to_json

#: Kinds of input that can be compared.
COMPARABLE = {"venv", "systemd", "junit", "junit_file", "elf", "bundle", "compile_db", "strace"}


def utc_now() -> str:
    return datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")


def host_facts() -> dict:
    """Where and when evidence was taken."""
    u = platform.uname()
    return {"hostname": u.node, "kernel": u.release, "os": u.system, "machine": u.machine, "python": platform.python_version(), "taken_at": utc_now(), "unix_seconds": int(time.time())}


def snapshot_name(host: str | None = None) -> str:
    safe = re.sub(r"[^A-Za-z0-9.-]", "-", host or platform.node() or "host")
    return f"{safe}-{datetime.now(UTC):%Y%m%dT%H%M%SZ}.tar.gz"


def _binary(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    return files.whole_files(spark, path, pattern, recursive=False)


def _trace(spark: SparkSession, path: str) -> DataFrame:
    lines = files.read_logs(spark, [path]).select(F.col("file").alias("trace_id"), F.col("line_no").alias("seq"), "raw")
    return trace.stitch(trace.require_trace(trace.parse_lines(lines)))


def _commands(spark: SparkSession, path: str) -> DataFrame:
    return build.parse_commands(spark.read.option("multiLine", True).json(path)).withColumn("seq", F.monotonically_increasing_id())


def _packages(spark: SparkSession, path: str) -> DataFrame:
    return pyenv.parse_metadata(files.read_venv(spark, path)[0])


def _units(spark: SparkSession, path: str) -> DataFrame:
    return units.expand_specifiers(units.effective(units.parse_units(units.pick_providers(files.read_unit_dirs(spark, path.split(":"))[0]))))


def _cases(spark: SparkSession, path: str) -> DataFrame:
    return junit.parse_reports(_binary(spark, path, "*.xml").withColumn("run_id", F.lit(path)))


def inspect(spark: SparkSession, path: str) -> tuple[str, DataFrame]:
    """(kind, main table) of an input, by what :func:`tracewell.sources.files.detect` says it is."""
    kind = files.detect(path)
    if kind == "venv":
        return kind, pyenv.check_dependencies(_packages(spark, path), pyenv.MarkerEnv.for_python(platform.python_version()))
    if kind in ("systemd", "unit"):
        return kind, _units(spark, path if kind == "systemd" else os.path.dirname(path))
    if kind in ("junit", "junit_file"):
        return kind, junit.unique_cases(_cases(spark, path))
    if kind == "elf":
        return kind, elf.inspect(_binary(spark, path))
    if kind == "bundle":
        return kind, bundle.verify(bundle.scan(_binary(spark, path)))
    if kind == "compile_db":
        return kind, _commands(spark, path)
    if kind == "strace":
        return kind, trace.syscall_stats(_trace(spark, path).where("kind = 'call'"))
    if kind == "directory":
        return kind, disk.rollup(disk.own_sizes(files.read_tree(spark, path)))
    return kind, logs.parse_records(files.read_logs(spark, [path]), logs.default_year())


def compare(spark: SparkSession, before: str, after: str) -> tuple[str, DataFrame]:
    """(kind, changes) of two inputs of one kind; logs and folders cannot be compared."""
    kinds = files.detect(before), files.detect(after)
    if kinds[0] != kinds[1] or kinds[0] not in COMPARABLE:
        raise Unsupported(f"cannot compare {kinds[0]} with {kinds[1]}")
    kind = kinds[0]
    both = lambda read: (read(spark, before), read(spark, after))
    if kind == "venv":
        return kind, pyenv.diff_environments(*both(_packages))
    if kind == "systemd":
        return kind, units.diff_units(*both(_units))
    if kind in ("junit", "junit_file"):
        return kind, junit.diff_runs(*(junit.unique_cases(x) for x in both(_cases)))
    if kind == "elf":
        reports = [elf.inspect(x) for x in both(_binary)]
        headers = elf.diff_headers(*reports).select("what", F.lit("header").alias("change"), "before_value", "after_value", "verdict")
        symbols = elf.diff_symbols(*(elf.symbol_table(r) for r in reports))
        none = F.lit(None).cast("string")
        return kind, headers.unionByName(symbols.select(F.col("identity").alias("what"), "change", none.alias("before_value"), F.nullif(F.array_join("what", ","), F.lit("")).alias("after_value"), "verdict"))
    if kind == "bundle":
        scanned = [bundle.scan(x, contents=True) for x in both(_binary)]
        names = bundle.diff_names(*scanned).select(F.lit("entry").alias("section"), F.col("name").alias("row_key"), "change")
        return kind, names.unionByName(bundle.diff_sections(*(bundle.section_rows(x.withColumn("content", F.decode("content", "UTF-8"))) for x in scanned)))
    if kind == "compile_db":
        return kind, build.diff_units(*both(_commands))
    return kind, trace.diff_stats(*(trace.syscall_sums(x.where("kind = 'call'")) for x in both(_trace)))


def compare_reports(spark: SparkSession, section: str, before: str, after: str) -> DataFrame:
    """(section, row_key, change) of two report documents of one section of :data:`bundle.SECTIONS`, written on their own."""
    if section not in bundle.SECTIONS:
        raise Unsupported(f"no such section: {section}")
    name = F.lit(f"reports/{bundle.SECTIONS[section]}.json").alias("name")
    read = lambda path: bundle.section_rows(spark.read.text(path, wholetext=True).select(F.lit("").alias("bundle"), name, F.col("value").alias("content")))
    return bundle.diff_sections(read(before), read(after))


def host_snapshot(spark: SparkSession, path: str, log: str | None = None, proc: str = "/proc", unit_dirs: str = "/etc/systemd/system:/run/systemd/system:/usr/lib/systemd/system:/lib/systemd/system") -> dict:
    """Writes a bundle of a host's sockets, ordering cycles, capacities and the end of a log; what cannot be collected is
    a diagnostic. Each part is one host's report, so it is gathered on the driver."""

    def sockets() -> bytes:
        parts = [net.parse_inet(spark.read.text(f"{proc}/net/{k}").withColumnRenamed("value", "raw"), F.lit(k)) for k in ("tcp", "tcp6", "udp", "udp6") if os.path.exists(f"{proc}/net/{k}")]
        table = parts[0]
        for p in parts[1:]:
            table = table.unionByName(p)
        owners, unreadable = files.process_sockets(spark, proc)
        return to_json([r.asDict() for r in net.with_owners(table, owners, unreadable).orderBy(*net.total_order()).collect()]).encode()

    def services() -> bytes:
        edges = graph.bounded_edges(units.ordering_edges(units.references(_units(spark, unit_dirs))))
        return to_json({"cycles": [graph.cycle_path(edges, c) for c in graph.components(edges)]}).encode()

    def storage() -> bytes:
        mounts = [r.mount_point for r in health.parse_mounts(spark.read.text(f"{proc}/self/mounts").withColumnRenamed("value", "raw")).collect()]
        return to_json({m: files.free_space(m) for m in sorted({"/", *mounts}) if os.path.isdir(m)}).encode()

    def tail() -> bytes:
        with files.StableFile(log) as f:
            return bundle.tail_on_line(f.read())

    found, diagnostics = bundle.collect({"reports/net_report.json": sockets, "reports/sys_snapshot.json": services, "reports/doctor.json": storage, "reports/host.json": lambda: json.dumps(host_facts(), sort_keys=True).encode()} | ({f"logs/{os.path.basename(log)}": tail} if log else {}))
    return bundle.create(path, found, host_facts(), diagnostics, redact=True, force=True)
