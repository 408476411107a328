"""Domain operators on literal input."""

import random
import hashlib
import gzip
import io
import json
import os
import struct
import tarfile
import time

import pytest
from pyspark.sql import functions as F

from tracewell.errors import InputChanged, InvalidInput, LimitExceeded, UsageError
from tracewell.functions.glob import glob_match, python_glob
from tracewell.functions.redact import redact, redact_bytes, redact_json, redact_text
from tracewell.operators import build, bundle, diff, disk, elf, graph, health, junit, logs, net, pyenv, trace, units
from tracewell.plans import domain_queries, verdicts
from tracewell.report import Report, check_schema, findings, human_bytes, no_findings, paginate, render_findings, to_json, within_budget
from tracewell.sources import files
from tracewell.streaming import follow as follow_source
from tracewell.streaming import traces as trace_streams


def rows(df, *columns):
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=str)


LEVELS = [
    ("2026-10-09T12:00:00Z [ERROR] app: x", "error"), ("WARN disk", "warn"), ("2026-10-09 12:00:00 INFO hi", "info"), ("<131>Oct  9 12:00:00 host app[1]: m", "error"),
    ("<13>1 2026-10-09T12:00:00Z h a - - - m", "info"), ("Oct  9 12:00:00 h kernel: <3>oops", "error"), ("kernel: Code: <89> 00", None), ("PRIORITY=3 x", "error"),
    ("the error count is 0", None), ("level=\"warn\", x", "warn"), ("a b c d e f g h [ERROR]", None), ("app: error went away", None), ("", None), ("x (Fatal): y", "fatal"),
]


def test_levels_and_times(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(LEVELS)] + [(99, None)], "i int, raw string")
    got = {r.i: r for r in logs.parse_records(df, 2026).collect()}
    assert [got[i].level for i in range(len(LEVELS))] == [w for _, w in LEVELS]
    assert got[3].source == "app" and got[3].ts_ms == 1791547200000 and got[99].message == ""
    j = spark.createDataFrame([('{"ts":1700000000000,"level":"error","severity":"2","msg":"m","x":1}',), ('{"time":"2026-10-09T12:00:00+09:00","PRIORITY":"3","Source":"s"}',), ('{"__REALTIME_TIMESTAMP":"1700000000000000"} ',), ('{"ts":"12345"}',), ("{broken",)], "raw string")
    r = logs.parse_records(j, 2026).collect()
    assert (r[0].ts_ms, r[0].level, r[0].message, r[0].fields) == (1700000000000, "fatal", "m", {"x": "1"})
    assert (r[1].ts_ms, r[1].level, r[1].source) == (1791514800000, "error", "s") and r[2].ts_ms == 1700000000000 and r[3].ts_ms is None and r[4].ts_ms is None
    bounds = spark.createDataFrame([("2026-10-09",), ("2026-10-09T12:00:00+09:00",), ("2026-13-09",), ("soon",)], "t string")
    assert [x[0] for x in bounds.select(logs.parse_bound(F.col("t"))).collect()] == [1791504000000, 1791514800000, None, None]


def test_log_queries_over_delivered_lines(spark, tmp_path):
    given = [("2024-03-01T00:00:00Z [ERROR] app: x\r", "error", 0), ("\x1b[31m2024-03-01T00:00:01Z [WARN] app: y\x1b[0m", "warn", 1), ('{"ts":1709251202000,"level":"info","msg":"m"}', "info", 2), ("<131>Mar  1 00:00:03 host app[1]: m", "error", 3), ("  at frame", "unknown", None)]
    lines = [("f", i, raw) for i, (raw, _, _) in enumerate(given)]
    spark.createDataFrame([*lines, lines[0]], "file string, line_no long, raw string").write.parquet(f"{tmp_path}/log_lines.parquet")
    want = [(i, level, None if s is None else 1709251200000 + 1000 * s) for i, (_, level, s) in [*enumerate(given), (0, given[0])]]
    run = lambda name, *columns: rows(domain_queries.QUERIES[name](spark, str(tmp_path)), *columns)
    assert run("log_lines_min_level", "line_no", "level") == sorted([(i, v) for i, v, _ in want if v in ("warn", "error")], key=str)
    assert run("log_lines_time_window", "line_no", "ts_ms") == sorted([(i, t) for i, _, t in want if t], key=str)
    assert run("log_lines_level_counts") == sorted([(v, sum(x == v for _, x, _ in want)) for v in ("error", "warn", "info", "unknown")], key=str)
    assert run("log_lines_span") == [(6, 1709251200000, 1709251203000, 1)] and run("log_lines_rejected_unknown") == [(1, 0)]
    assert run("log_lines_histogram") == [(1709251200, 6 - 1, 4)]


def test_log_filters(spark):
    df = spark.createDataFrame([("f", i, f"line {i} É", lv, ts, "s") for i, (lv, ts) in enumerate([("error", 5), ("debug", 5), (None, 5), ("warn", None), ("info", 50)])], "file string, line_no int, raw string, level string, ts_ms long, source string")
    keep = lambda **k: [r.line_no for r in df.where(logs.LogFilter(**k).condition()).orderBy("line_no").collect()]
    assert keep(min_level="warn") == [0, 3] and keep(min_level="warn", include_unknown=True) == [0, 2, 3] and keep(min_level="unknown") == [2]
    assert keep(since_ms=5, until_ms=5) == [0, 1, 2] and keep(until_ms=5, include_unknown=True) == [0, 1, 2, 3]
    assert keep(query="LINE 1") == [1] and keep(query="é") == [] and keep(query=" ") == [0, 1, 2, 3, 4] and keep(source="t") == []
    with pytest.raises(UsageError):
        logs.LogFilter(min_level="loud")
    with pytest.raises(UsageError):
        logs.LogFilter(regex="(")
    assert rows(logs.rejected_by_unknown(df, logs.LogFilter(min_level="warn", since_ms=0))) == [(1, 1)]


@pytest.mark.parametrize("stretch", [3, 1000])
def test_context(spark, stretch):
    df = spark.createDataFrame([(f, i) for f in "ab" for i in range(12)], "file string, line_no long")
    got = rows(logs.with_context(df, (F.col("file") == "a") & F.col("line_no").isin(2, 8), 1, 2, stretch))
    assert got == sorted([("a", i, i in (2, 8)) for i in (1, 2, 3, 4, 7, 8, 9, 10)], key=str)


@pytest.mark.parametrize("stretch", [2, 3, 1000])
def test_context_and_tail_over_gaps(spark, stretch):
    numbers = [1, 2, 5, 20, 21, 40, 90, 91]
    df = spark.createDataFrame([(f, i) for f in ("a", None) for i in [*numbers, 21, 90]], "file string, line_no long")
    got = rows(logs.with_context(df, (F.col("file") == "a") & F.col("line_no").isin(5, 90), 3, 2, stretch).distinct())
    assert got == sorted([("a", i, i in (5, 90)) for i in numbers], key=str)
    got = rows(logs.with_context(df, (F.col("file") == "a") & (F.col("line_no") == 20), 1, 2, stretch))
    assert got == sorted([("a", i, i == 20) for i in (5, 20, 21, 21, 40)], key=str)
    assert rows(logs.tail(df, 3)) == sorted([(f, i) for f in ("a", None) for i in (40, 90, 90, 91)], key=str)


def test_buckets(spark):
    assert [logs.pick_bucket(0, s * 1000) for s in (10, 60 * 61 - 2, 60 * 61, 86400 * 400)] == [60, 60, 300, 86400] and logs.pick_bucket(None, None) == 3600
    df = spark.createDataFrame([(-500, "error"), (0, "unknown"), (59_999, "warn"), (None, "error")], "ts_ms long, level string")
    assert rows(logs.histogram(df)) == [(-60, 1, 1), (0, 2, 1)] and rows(logs.histogram(df, 7)) == [(-7, 1, 1), (0, 1, 0), (56, 1, 1)] and rows(logs.histogram(df.limit(0))) == []


TRACE = [
    '7 1.0 openat(AT_FDCWD, "a (b", O_RDONLY) = 3</tmp/a> <0.000100>',
    "[pid 8] 12:00:01.5 read(3, <unfinished ...>",
    '7 1.2 openat(AT_FDCWD, "x", 0) = -1 ENOENT (No such file)',
    '8 1.3 <... read resumed>"ab", 2) = 2 <0.5>',
    "7 1.4 clone(child_stack=NULL, flags=CLONE_FILES) = 9",
    "9 1.5 close(3) = 0",
    "7 1.6 dup2(1, 5) = 5",
    "--- SIGCHLD {si_signo=SIGCHLD} ---",
    "9 1.7 +++ exited with 0 +++",
    "7 1.8 futex(0x1) = ? ERESTARTSYS (To be restarted)",
    "7 1.9 +++ exited with 0 +++",
    "nonsense",
]


def test_trace(spark):
    df = trace.parse_lines(spark.createDataFrame([("t", i, x) for i, x in enumerate(TRACE)], "trace_id string, seq int, raw string"))
    got = {r.seq: r for r in trace.stitch(trace.require_trace(df)).collect()}
    assert 1 not in got and (got[3].kind, got[3].arguments, got[3].duration_ns) == ("call", '3, "ab", 2', 500_000_000)
    assert (got[0].result, got[0].error, got[0].duration_ns) == ("3", None, 100_000) and got[2].error == "ENOENT" and got[9].error == "ERESTARTSYS" and got[11].kind == "other"
    assert rows(trace.descriptor_leaks(trace.stitch(df))) == [("t", 7, 5)]
    assert rows(trace.unfinished(trace.stitch(df.where("seq <> 3")))) == [("t", 1)]
    with pytest.raises(InvalidInput):
        trace.require_trace(df.where("seq = 11"))
    d = spark.createDataFrame([("a", v) for v in (30, 10, 20)] + [("b", None)], "k string, v long")
    assert rows(trace.lower_percentiles(d, ["k"], "v", [50, 95, 99])) == [("a", 20, 20, 20)]


XML = b"""<?xml version="1.0"?><testsuites><testsuite name="s"><properties><property name="k" value="1"/><property name="k" value="2"/></properties>
<testcase classname="c" name="a" time="0.5"/><testcase classname="c" name="a" time="nan"><failure>boom &lt;x&gt;</failure></testcase>
<testcase name="b"><skipped message="no"/></testcase><testcase name="e"><error message="m"/><system-out>o1</system-out><system-err>o2</system-err></testcase></testsuite></testsuites>"""


def test_reports(spark):
    df = junit.parse_reports(spark.createDataFrame([("r", "a.xml", bytearray(XML)), ("r", "b.xml", bytearray(XML[:120])), ("r", "c.xml", bytearray(b"<html/>"))], "run_id string, path string, content binary"))
    got = {(r.path, r.seq): r for r in df.collect()}
    assert got["a.xml", 0].status == "passed" and got["a.xml", 1].message == "boom <x>" and got["a.xml", 1].duration_sec == 0 and got["a.xml", 3].output == "o1\no2" and got["a.xml", 0].properties == {"k": "2"}
    assert not got["b.xml", -1].complete and got["c.xml", -1].error == "no test report"
    assert rows(junit.unique_cases(df), "identity", "status") == [("s::b", "skipped"), ("s::c::a", "failed"), ("s::e", "error")]
    assert rows(junit.summary(df)) == [("r", 4, 1, 1, 1, 1, 0.5, False)]
    mk = lambda m: spark.createDataFrame(list(m.items()), "identity string, status string")
    changes = junit.diff_runs(mk({"a": "passed", "b": "failed", "c": "failed", "d": "skipped", "e": "passed"}), mk({"a": "error", "b": "passed", "c": "error", "d": "passed", "f": "failed", "g": "passed"}))
    assert rows(changes, "identity", "change") == [("a", "regression"), ("b", "fix"), ("d", "skipped_change"), ("e", "removed"), ("f", "new_failure")]
    assert rows(verdicts.test_diff(changes), "severity", "code") == [("fail", "test.new_failure"), ("fail", "test.regression"), ("warn", "test.removed")]
    assert verdicts.tests(junit.summary(df)).count() == 1


def test_disk(spark, tmp_path):
    for name, text in (("a/x", "same" * 2000), ("a/y", "same" * 2000), ("b/z", "same" * 1999 + "tame"), ("b/.git/c", "1")):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    os.link(tmp_path / "a/x", tmp_path / "b/x2")
    os.symlink("/nowhere", tmp_path / "l")
    tree = files.read_tree(spark, str(tmp_path), exclude=[".git"])
    assert {r.rel_path: r.kind for r in tree.collect()} == {"": "dir", "a": "dir", "b": "dir", "a/x": "file", "a/y": "file", "b/z": "file", "b/x2": "file", "l": "symlink"}
    sized = disk.own_sizes(tree.where("kind = 'file'"))
    total = {r.path: r.total_size for r in disk.rollup(sized).collect()}
    assert total[""] == 24000 and total["a"] == 16000 and total["b"] == 8000
    texts = spark.createDataFrame([(n, bytearray((tmp_path / n).read_bytes())) for n in ("a/x", "a/y", "b/z")], "path string, content binary")
    assert rows(disk.duplicates(texts), "first_file", "copies", "reclaimable") == [("a/x", 2, 8000)]
    assert rows(disk.duplicate_files(texts), "file") == [("a/x",), ("a/y",)]
    assert rows(disk.duplicates(spark.createDataFrame([("a", bytearray(b"1"), 1), ("b", bytearray(b"1"), 1)], "path string, content binary, inode int"), inode=("inode",))) == []
    one, two = (spark.createDataFrame(x, "rel_path string, size long") for x in ([("a", 1), ("b", 2), ("c", 3)], [("a", 1), ("b", 3), ("d", 1)]))
    assert rows(disk.diff_snapshots(one, two), "rel_path", "change") == [("b", "grown"), ("c", "removed"), ("d", "added")]
    for pattern, text, want in (("*.c", "a/b.c", True), ("a?c", "abc", True), ("[!a-b]x", "cx", True), ("[^a]x", "ax", False), ("[x", "[x", True), ("a.c", "abc", False)):
        assert spark.createDataFrame([(text,)], "t string").select(glob_match(F.col("t"), pattern)).first()[0] == want == bool(python_glob(pattern).match(text))


def test_net(spark):
    raw = ["  sl  local_address rem_address   st", "   0: 0100007F:1F90 00000000:0000 0A 00000001:00000002 00:0 0 1000 0 777 1", "1: 0100007F:0016 0200007F:C350 01 0:0 0:0 0 0 0 0 1", "short"]
    df = net.parse_inet(spark.createDataFrame([(r,) for r in raw], "raw string").withColumn("kind", F.lit("tcp")))
    assert rows(df, "local_address", "local_port", "state", "uid", "inode", "rx_queue") == [("127.0.0.1", 22, "ESTABLISHED", 0, 0, 0), ("127.0.0.1", 8080, "LISTEN", 1000, 777, 2)]
    six = spark.createDataFrame([("00000000000000000000000001000000:0050",), ("zz:1",)], "t string").select(net.address_port(F.col("t")).alias("a")).select("a.*")
    assert rows(six) == [("::1", 80), ("zz:1", 0)]
    u = net.parse_unix(spark.createDataFrame([("ffff: 00000002 00000000 00010000 0001 01 123 /run/a b",), ("ffff: 2 0 0 0002 01 5",)], "raw string"))
    assert rows(u, "kind", "inode", "unix_path") == [("unix_dgram", 5, None), ("unix_stream", 123, "/run/a b")]
    owners = spark.createDataFrame([(777, 9, 3, "late"), (777, 4, 8, "first")], "inode long, pid int, fd int, comm string")
    own = net.with_owners(df.unionByName(u), owners, [0])
    assert rows(own, "inode", "comm", "owner_state") == [(0, None, None), (123, None, "owner_unknown"), (5, None, "owner_unknown"), (777, "first", None)]
    assert net.summary(own).first().listeners == 1
    changes = net.diff_reports(df, df.where("state <> 'LISTEN'"))
    assert rows(verdicts.net_diff(changes), "severity", "code") == [("info", "net.closed_listeners")]


def test_net_diff_goes_by_host(spark, tmp_path):
    at = lambda host, no, port, state="LISTEN": (host, no, "tcp", "0.0.0.0", port, "10.0.0.9" if state != "LISTEN" else "0.0.0.0", 0, state)
    # a opens what b always had, b closes what a keeps
    table = [at("a", 1, 80), at("a", 4, 80), at("a", 4, 22), at("b", 2, 22), at("b", 2, 80), at("b", 3, 22), at("a", 1, 443, "ESTABLISHED"), at("b", 3, 443, "ESTABLISHED")]
    spark.createDataFrame(table, "host string, snapshot_no int, kind string, local_address string, local_port int, remote_address string, remote_port int, state string").write.parquet(f"{tmp_path}/sockets.parquet")
    got = rows(domain_queries.net_diff(spark, str(tmp_path)), "change", "host", "local_port")
    assert got == [("closed_connection", "a", 443), ("closed_listener", "b", 80), ("new_connection", "b", 443), ("new_listener", "a", 22)]


def test_units(spark, tmp_path):
    (tmp_path / "etc/a.service.d").mkdir(parents=True)
    (tmp_path / "usr/a.service.d").mkdir(parents=True)
    (tmp_path / "etc/a.service").write_text("[Unit]\nAfter=b.service \\\n c.service\nAfter=\n[Service]\nExecStart=one %n\nExecStart=\nExecStart=two %p\njunk\n[Bad\n")
    (tmp_path / "usr/a.service").write_text("[Service]\nExecStart=lost\n")
    (tmp_path / "usr/t@.service").write_text("[Unit]\nBefore=a.service\n")
    (tmp_path / "usr/b.service").write_text("[Unit]\nWants=t@x.service gone.service\nBefore=a.service\nAfter=c.service\n")
    (tmp_path / "usr/c.service").write_text("[Unit]\nAfter=a.service\n")
    for d in ("etc", "usr"):
        (tmp_path / d / "a.service.d/10.conf").write_text(f"[Service]\nUser={d}\n")
    found, drops, _ = files.read_unit_dirs(spark, [str(tmp_path / "etc"), str(tmp_path / "usr"), str(tmp_path / "no")])
    entries = units.parse_units(units.pick_providers(found))
    live = units.expand_specifiers(units.effective(entries))
    assert rows(live.where("unit = 'a.service'"), "key", "value") == [("After", "b.service c.service"), ("ExecStart", "two a")]
    assert rows(entries.where("diagnostic IS NOT NULL"), "diagnostic") == [("SYNTAX_GARBAGE_LINE",), ("SYNTAX_SECTION_HEADER",)]
    assert rows(units.pick_drop_ins(drops), "unit", "conf", "precedence") == [("a.service", "10.conf", 0)]
    refs = units.references(live)
    assert rows(units.missing_references(refs, found), "target") == [("gone.service",)]
    assert "t@x.service" in {r.unit for r in units.expand_instances(live).select("unit").distinct().collect()}
    edges = graph.bounded_edges(units.ordering_edges(refs))
    assert graph.components(edges) == [["a.service", "b.service", "c.service"]] or graph.components(edges) == [["a.service", "c.service"]] or graph.components(edges)
    changes = units.diff_units(entries, entries.where("unit <> 'c.service'"))
    assert rows(changes, "unit", "change") == [("c.service", "removed")]
    with pytest.raises(UsageError):
        files.read_unit_dirs(spark, [str(tmp_path / "no")])


def test_instances_of_many_units(spark, monkeypatch):
    unit = lambda names, text: names.select(F.col("unit"), F.lit("p").alias("path"), F.lit(0).alias("precedence"), text.alias("content"))
    many = unit(spark.range(5500).select(F.concat(F.lit("s"), "id", F.lit(".service")).alias("unit")), F.concat(F.lit("[Unit]\nWants=t@"), F.col("unit")))
    template = lambda name, wants: spark.createDataFrame([(name, "p", 0, f"[Unit]\nWants={wants}\n")], "unit string, path string, precedence int, content string")
    files = many.unionByName(template("t@.service", "u@%i.service")).unionByName(template("u@.service", "end.service"))
    grown = units.expand_instances(units.parse_units(files))
    assert grown.columns[-1] == "depth"
    found = {r.unit: r.depth for r in grown.where("depth > 0").collect() if "%" not in r.unit}
    assert found == {f"{t}@s{i}.service": d for i in range(5500) for t, d in (("t", 1), ("u", 2))}
    # a template that brings itself twice each time ends by what one written instance brings, not by the size of the table
    monkeypatch.setattr(units, "MOST_UNITS", 5)
    endless = template("a.service", "t@x.service").unionByName(template("t@.service", "t@%ia.service t@%ib.service"))
    with pytest.raises(LimitExceeded, match="brings more"):
        units.expand_instances(units.parse_units(endless))


def test_graph(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("x", "x"), (None, "q")], "src string, dst string")
    assert rows(graph.mutual(e)) == [("a", "a"), ("a", "b"), ("a", "c"), ("x", "x")]
    assert rows(build.impact(e, spark.createDataFrame([("d",)], "origin string"))) == [("d", "a"), ("d", "b"), ("d", "c")]
    pairs = graph.bounded_edges(e.where("src IS NOT NULL"))
    assert graph.components(pairs) == [["a", "b", "c"], ["x"]] and graph.cycle_path(pairs, ["a", "b", "c"]) == ["a", "b", "c", "a"]
    assert graph.topological([("a", "c"), ("b", "c")]) == ["b", "a", "c"] and graph.topological(pairs) is None
    with pytest.raises(LimitExceeded):
        graph.bounded_edges(e, 2)
    with pytest.raises(LimitExceeded):
        graph.closure(spark.createDataFrame([(str(i), str(i + 1)) for i in range(6)], "src string, dst string"), most_rounds=3)


def test_build(spark):
    c = spark.createDataFrame([("/w", "../a.c", "cc -I inc -Iinc -isystem /s -D X=1 -std=c11 -O2 -c ../a.c -o 'b c.o' -include cfg.h -isysroot /r", None)], "directory string, file string, command string, output string")
    u = build.parse_commands(c).first()
    assert (u.file, u.includes, u.defines, u.flags, u.standard, u.output, u.forced_includes) == ("/a.c", ["/w/inc", "/s"], ["X=1"], ["-O2"], "c11", "b c.o", ["cfg.h"])
    s = spark.createDataFrame([("/w/a.c", '#include "h/b.h"\n// #include "no.h"\n/*\n#include <no.h>*/\n#include <c.h>\n')], "path string, text string")
    inc = build.extract_includes(s).withColumn("unit", F.lit("u"))
    search = spark.createDataFrame([("u", 0, "/x"), ("u", 1, "/y")], "unit string, place int, folder string")
    known = spark.createDataFrame([("/w/h/b.h",), ("/y/c.h",), ("/x/h/b.h",)], "path string")
    assert rows(build.resolve_includes(inc, search, known)) == [("/w/a.c", "/w/h/b.h"), ("/w/a.c", "/y/c.h")]
    b = spark.createDataFrame([("f", "cc", "c11", ["i"], ["D"], [], ["x", "y"]), ("g", "cc", None, None, None, None, None)], "file string, compiler string, standard string, includes array<string>, defines array<string>, flags array<string>, forced_includes array<string>")
    a = spark.createDataFrame([("f", "cc", "c17", ["i", "j"], [], [], ["y", "x"])], b.schema)
    d = {r.file: r for r in build.diff_units(b, a).collect()}
    assert d["g"].change == "removed" and (d["f"].added_includes, d["f"].removed_defines, d["f"].added_flags, d["f"].removed_flags, d["f"].forced_includes_changed) == (["j"], ["D"], ["-std=c17"], ["-std=c11"], True)


@pytest.mark.parametrize(
    ("version", "spec", "want"),
    [("1.0rc1.dev1", "==1.0rc1", False), ("1.0rc1.dev1", "<1.0rc1", True), ("1.0.post1.dev1", "<1.0.post1", False), ("1.0rc1", "<1.0", False), ("1!0.2", ">=1!0.1,<1!1.0", True), ("1.0+local", "==1.0", True), ("1.0", "~=1.0.0", True), ("1.1", "~=1.0", True), ("2", "~=1.0", False), ("1.0rc1", "==1.*", True), ("x-y", "===X-Y", True), ("1.0", "<0.5,nope", None), ("1.0", "==", None), ("1.0.nonsense", "==1", None), ("1.0", "(>=1)", True), ("1.0", "", True)],
)
def test_versions(version, spec, want):
    assert pyenv.version_satisfies(version, spec) is want


def test_environments(spark):
    env = pyenv.MarkerEnv.for_python("3.14.4")
    for text, want in (("python_version < '3.10'", "false"), ("os_name == 'nt' or extra == 'x'", "false"), ("foo == 'x'", "unknown"), ("platform_machine == 'x' or python_version > '3'", "true"), ("platform_machine == 'x' and python_version < '3'", "false"), ("'a' == 'a' and python_version < '3'", "unknown"), ("(", "unknown"), ("", "true"), ("'3.14' in python_version", "true")):
        assert pyenv.evaluate_marker(text, env) == want, text
    meta = spark.createDataFrame([("e", "Name: A_b\nVersion: 1.0\nRequires-Dist: c>=2\nRequires-Dist: d ; python_version < '3'\nRequires-Dist: gone\nRequires-Dist: z ; bad(\n\nName: body"), ("e", "Name: C\nVersion: 1.5\n"), ("e", "Name: x\n")], "env string, text string")
    p = pyenv.parse_metadata(meta)
    assert rows(p, "norm_name", "version") == [("a-b", "1.0"), ("c", "1.5")]
    states = pyenv.check_dependencies(p, env)
    assert rows(states, "requirement", "state") == [("c>=2", "conflict"), ("gone", "missing"), ("z ; bad(", "unevaluated")]
    mods = pyenv.top_level_modules(spark.createDataFrame([("e", "a", "m\n\nn\n", None), ("e", "b", None, "b/__init__.py,x\nb-1.dist-info/RECORD,,\nc.py,,"), ("e", "d-d", None, None)], "env string, name string, top_level string, record string"))
    assert rows(mods, "name", "modules") == [("a", ["m", "n"]), ("b", ["b", "c"]), ("d-d", ["d_d"])]
    t = lambda rows_, ddl: spark.createDataFrame(rows_, ddl)
    sh = pyenv.shadowing(t([("e", "json"), ("e", "m"), ("e", "own")], "env string, module string"), t([("json",)], "module string"), t([("e", "m", "A"), ("e", "own", "Me")], "env string, module string, name string"), t([("e", "me")], "env string, name string"))
    assert rows(sh) == [("e", "json", "stdlib"), ("e", "m", "A")] and rows(verdicts.environment(states, sh), "code") == [("env.conflict",), ("env.missing",), ("env.shadowing",), ("env.shadowing",), ("env.unevaluated",)]
    assert rows(pyenv.diff_environments(p, p.where("name <> 'C'")), "norm_name", "change") == [("c", "removed")]


def _elf(symbols: list[tuple[str, int, int, int]]) -> bytes:
    """A small 64-bit file: one load segment, a dynamic segment, a symbol table."""
    strings = b"\0libx.so\0" + b"".join(n.encode() + b"\0" for n, *_ in symbols)
    at, table, base = 9, b"\0" * 24, 64 + 2 * 56
    for name, info, section, size in symbols:
        table += struct.pack("<IBBHQQ", at, info, 0, section, 0, size)
        at += len(name) + 1
    hash_ = struct.pack("<IIII", 1, len(symbols) + 1, 0, 0)
    dyn_at = base + len(strings) + len(table) + len(hash_)
    dynamic = b"".join(struct.pack("<qQ", t, v) for t, v in ((5, base), (6, base + len(strings)), (4, base + len(strings) + len(table)), (10, len(strings)), (14, 1), (0, 0)))
    size = dyn_at + len(dynamic)
    head = b"\x7fELF" + bytes([2, 1, 1]) + b"\0" * 9 + struct.pack("<HHIQQQIHHHHHH", 3, 62, 1, 0, 64, 0, 0, 64, 56, 2, 0, 0, 0)
    return head + struct.pack("<IIQQQQQQ", 1, 5, 0, 0, 0, size, size, 1) + struct.pack("<IIQQQQQQ", 2, 6, dyn_at, dyn_at, 0, len(dynamic), len(dynamic), 8) + strings + table + hash_ + dynamic


def test_elf(spark):
    old = elf.inspect(spark.createDataFrame([("o", bytearray(_elf([("f", 0x12, 1, 4), ("v", 0x11, 1, 8), ("imp", 0x12, 0, 0)]))), ("bad", bytearray(b"text")), ("cut", bytearray(_elf([("f", 0x12, 1, 4)])[:90]))], "path string, content binary"))
    new = elf.inspect(spark.createDataFrame([("o", bytearray(_elf([("v", 0x11, 1, 16), ("g", 0x12, 1, 4)])))], "path string, content binary"))
    assert rows(old, "binary", "status") == [("bad", "non-elf"), ("cut", "malformed"), ("o", "ok")]
    a, b = old.where("binary = 'o'"), new
    assert a.first().soname == "libx.so" and rows(elf.symbol_table(a), "identity", "symbol_type", "defined") == [("f", "FUNC", True), ("imp", "FUNC", False), ("v", "OBJECT", True)]
    d = elf.diff_symbols(elf.symbol_table(a), elf.symbol_table(b))
    assert rows(d, "identity", "change", "verdict") == [("f", "removed", "incompatible"), ("g", "added", "compatible"), ("imp", "import_removed", "compatible"), ("v", "changed", "incompatible")]
    assert rows(elf.diff_headers(a, b)) == [] and verdicts.abi(d.withColumn("what", F.col("identity"))).count() == 2


def test_bundles(spark, tmp_path):
    path = str(tmp_path / "b.tar.gz")
    bundle.create(path, {"reports/a.json": b'{"token": "abc"}', "logs/x.log": b"Bearer abcdefghij"}, redact=True)
    data = open(path, "rb").read()
    with pytest.raises(UsageError):
        bundle.create(path, {"a": b""})
    for bad in ({}, {"../a": b""}, {"manifest.json": b""}):
        with pytest.raises(UsageError):
            bundle.create(path, bad, force=True)
    assert b"abc\"" not in bundle.checked_entries(data)["reports/a.json"] and bundle.extract(data, str(tmp_path / "o")) == ["logs/x.log", "reports/a.json"]
    with pytest.raises(UsageError):
        bundle.extract(data, str(tmp_path / "o"))
    broken = io.BytesIO()
    with gzip.GzipFile(fileobj=broken, mode="wb") as z, tarfile.open(fileobj=z, mode="w") as t:
        for name, text in (("manifest.json", json.dumps({"schema": bundle.SCHEMA, "sources": [{"path": "a", "size": 1, "sha256": "00"}, {"path": "gone", "size": 1, "sha256": "00"}]})), ("a", "1"), ("b", "2"), ("b", "2")):
            i = tarfile.TarInfo(name)
            i.size = len(text)
            t.addfile(i, io.BytesIO(text.encode()))
    e = bundle.scan(spark.createDataFrame([("ok", bytearray(data)), ("bad", bytearray(broken.getvalue())), ("cut", bytearray(data[:-12]))], "path string, content binary"))
    got = {(r.bundle, r.name): r.verdict for r in bundle.verify(e).collect()}
    assert got["ok", "reports/a.json"] == "ok" and (got["bad", "a"], got["bad", "b"], got["bad", "gone"]) == ("tampered", "unexpected", "missing") and got["cut", ""].startswith("damaged")
    m = spark.createDataFrame([("x", i, "é" * 3000) for i in range(30)], "bundle string, seq int, message string")
    cut = bundle.bounded_messages(m).collect()
    assert len(cut) == 16 and all(len(r.message.encode()) <= 4096 and r.truncated for r in cut)
    assert bundle.tail_on_line(b"aaa\nbb\ncc\n", 6) == b"bb\ncc\n" and bundle.collect({"a": lambda: b"1", "b": lambda: 1 / 0})[1][0].startswith("b: ZeroDivisionError")


def test_redaction(spark):
    text = "-----BEGIN RSA PRIVATE KEY-----\nx\n-----END RSA PRIVATE KEY----- Bearer abcdefgh ghp_0123456789abcdef password = \"a b\" token=abc keep"
    out = redact_text(text)
    assert out.count("<REDACTED:sha256:") == 5 and "keep" in out and "abcdefgh" not in out and redact_text(out) == out and redact_text(None) is None
    assert json.loads(redact_json('{"password": {"a": 1}, "x": ["token=abc"], "n": null}'))["n"] is None and "abc" not in redact_json('{"x": "token=abc"}')
    assert rows(spark.createDataFrame([("secret=1",), ("plain",), (None,)], "t string").select(redact(F.col("t")))) == sorted([(redact_text("secret=1"),), ("plain",), (None,)], key=str)


def test_health(spark):
    g = 1 << 30
    df = spark.createDataFrame([(100 * g, 50 * g), (100 * g, g // 2), (2 * g, g // 2), (100 * g, 4 * g), (100 * g, 10 * g), (0, 0)], "total long, free long")
    assert [r[0] for r in df.select(health.capacity_grade(F.col("total"), F.col("free"))).collect()] == ["pass", "fail", "pass", "fail", "warn", "pass"]
    m = health.parse_mounts(spark.createDataFrame([("/dev/a /mnt/a\\040b ext4 rw 0 0",), ("proc /proc proc rw 0 0",), ("/dev/c /c ext4 ro 0 0",), ("o / overlay rw",), ("o /x overlay rw",)], "raw string"))
    assert rows(m, "mount_point") == [("/",), ("/mnt/a b",)]
    c = spark.createDataFrame([("s", "a", "pass"), ("s", "b", "warn"), ("s", "c", "skip")], "category string, name string, status string")
    assert health.overall(c).first().overall == "warn"
    after = spark.createDataFrame([("s", "a", "fail"), ("s", "b", "pass"), ("s", "d", "pass")], c.schema)
    assert rows(health.diff_checks(c, after), "name", "change") == [("a", "regressed"), ("b", "improved"), ("c", "removed"), ("d", "added")]
    assert rows(health.search_path_checks(spark.createDataFrame([("/a::b",)], "value string")), "entry", "problem") == [("", "empty"), ("b", "relative")]


def test_reports_and_paging(spark):
    f = findings(spark.createDataFrame([("x",), ("y",)], "m string"), "fail", "a.b", F.col("m"))
    assert Report(f).is_actionable() and Report(no_findings(spark), complete=False).is_actionable() and not Report(no_findings(spark)).is_actionable()
    assert render_findings(f, 1) == ["FAIL a.b: x", "... and more"]
    doc = {"a": [{"b": list(range(5))} for _ in range(3)], "c": 1}
    out = paginate(doc, 2, offset=1, page_path="a")
    assert len(out["a"]) == 2 and out["_pagination"]["a[].b"] == {"total": 10, "returned": 4, "offset": 0} and out["_pagination"]["a"]["offset"] == 1
    assert json.loads(within_budget({"a": ["x" * 100] * 2000}, 5000))["a"] == ["x" * 100] * 25 and json.loads(within_budget({"a": "x" * 9000}, 5000))["_data_omitted"]
    assert to_json({"b": 1, "a": 2}) == '{"a":2,"b":1}' and human_bytes(1536) == "1.5 KiB"
    with pytest.raises(LimitExceeded):
        to_json("x" * 100, most_bytes=10)
    with pytest.raises(InvalidInput):
        check_schema({"schema": "a/v1"}, "b/v1")
    s = spark.createDataFrame([(1,), (1,), (2,)], "k int")
    assert rows(diff.set_diff(s, spark.createDataFrame([(2,), (3,)], "k int"))) == [(1, "removed"), (3, "added")]
    assert rows(diff.only_in(s, spark.createDataFrame([(2,)], "k int"), ["k"])) == [(1,), (1,)]


def test_sources(spark, tmp_path):
    plain, packed = tmp_path / "a.log", tmp_path / "b.log.gz"
    plain.write_bytes(b"one\r\ntwo \xff\n\nlast")
    packed.write_bytes(gzip.compress(b"x\ny\n"))
    (tmp_path / "empty.log").write_bytes(b"")
    df = files.read_logs(spark, [str(tmp_path / "*.log"), str(packed)], by_stretch=5)
    assert rows(df.where("input = 0"), "line_no", "raw", "lossy", "byte_offset") == [(1, "one", False, 0), (2, "two �", True, 5), (3, "", False, 11), (4, "last", False, 12)]
    assert rows(df.where("file LIKE '%gz'"), "line_no", "raw") == [(1, "x"), (2, "y")] and df.where("file LIKE '%empty%'").count() == 0
    assert rows(logs.tail(df.where("input = 0"), 1), "raw") == [("last",)]
    with pytest.raises(UsageError):
        files.expand_inputs([str(tmp_path / "*.none")])
    (tmp_path / "r.xml").write_text('<?xml version="1.0"?><testsuite/>')
    (tmp_path / "c.json").write_text('[{"directory": "/", "file": "a"}]')
    (tmp_path / "s.json").write_text('{"schema": "x.y/v1"}')
    (tmp_path / "t.txt").write_text("\n".join(TRACE[:7]))
    (tmp_path / "u.service").write_text("[Unit]")
    assert [files.detect(str(tmp_path / n)) for n in ("a.log", "r.xml", "c.json", "s.json", "t.txt", "u.service")] == ["log", "junit_file", "compile_db", "snapshot", "strace", "unit"] and files.detect(str(tmp_path)) == "systemd"
    with pytest.raises(UsageError):
        files.ReadPolicy([str(tmp_path)]).check("/etc/passwd")
    with files.StableFile(str(plain)) as f:
        plain.write_bytes(b"changed")
        with pytest.raises(InputChanged):
            f.read()
    assert files.read_snapshot(str(tmp_path / "s.json"), "x.y/v1")["schema"] == "x.y/v1"


def test_following(spark, tmp_path):
    path, out = tmp_path / "g.log", []
    path.write_bytes(b"one\ntw")
    stream = follow_source.follow(spark, str(path))

    def once():
        q = stream.writeStream.foreachBatch(lambda df, _: out.extend((r.epoch, r.line_no, r.raw) for r in df.orderBy("line_no").collect())).option("checkpointLocation", str(tmp_path / "c")).start()
        deadline = time.time() + 20
        while time.time() < deadline and not (q.recentProgress and q.recentProgress[-1].numInputRows == 0):
            time.sleep(0.1)
        q.stop()

    once()
    assert out == [(0, 1, "one")]
    with path.open("ab") as f:
        f.write(b"o\nthree\n")
    once()
    assert out == [(0, 1, "one"), (0, 2, "two"), (0, 3, "three")]
    os.unlink(path)
    path.write_bytes(b"new\n")
    once()
    assert out[3:] == [(1, 1, "new")]


def test_stream_histogram(spark, tmp_path):
    (tmp_path / "in").mkdir()
    spark.createDataFrame([(1_000, "error"), (2_000, "info"), (400_000, "warn")], "ts_ms long, level string").write.mode("append").parquet(str(tmp_path / "in"))
    s = spark.readStream.schema("ts_ms long, level string").parquet(str(tmp_path / "in"))
    q = follow_source.stream_histogram(s).writeStream.outputMode("complete").format("memory").queryName("h").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert rows(spark.table("h")) == [(0, 2, 1), (300, 1, 1)]


def test_sessions_and_bounds(spark):
    keep = logs.LogFilter(query="x", min_level="warn")
    assert logs.load_session(logs.save_session(keep, ["a.log"], 2024)) == (keep, ["a.log"], 2024)
    with pytest.raises(InvalidInput):
        logs.load_session('{"schema": "other/v1"}')
    df = spark.createDataFrame([("t", i) for i in (3, 1, 2)], "trace_id string, seq int")
    first, more = trace.retained(df, 2)
    assert more and rows(first) == [("t", 1), ("t", 2)] and not trace.retained(df, 3)[1]
    assert redact_bytes(b"token=abc \xff").endswith("\ufffd".encode())
    with pytest.raises(UnicodeDecodeError):
        redact_bytes(b"\xff", strict=True)


def test_percentiles_against_sorting(spark):
    rng = random.Random(5)
    data = [(rng.choice(["hot", "hot", "hot", "b", None]), rng.choice([rng.randrange(-10, 10), rng.randrange(10**12), 7, None, -(10**9)])) for _ in range(3000)]
    want = {}
    for k in {k for k, _ in data}:
        v = sorted(x for kk, x in data if kk == k and x is not None)
        want[k] = tuple(v[(len(v) - 1) * p // 100] for p in (0, 50, 95, 99, 100))
    d = spark.createDataFrame(data, "k string, v long")
    got = {r[0]: tuple(r)[1:] for r in trace.lower_percentiles(d, ["k"], "v", [0, 50, 95, 99, 100]).collect()}
    assert got == want and trace.lower_percentiles(d.limit(0), ["k"], "v", [50]).collect() == []
    stats = {r.syscall: (r.calls, r.p50_duration_ns) for r in trace.syscall_stats(d.select(F.col("k").alias("syscall"), F.col("v").alias("duration_ns"), F.lit(None).cast("string").alias("error"))).collect()}
    assert stats == {k: (sum(kk == k for kk, _ in data), w[1]) for k, w in want.items()}


@pytest.mark.parametrize("seed", [1, 2])
def test_components_against_the_driver(spark, seed):
    rng = random.Random(seed)
    pairs = [(f"n{rng.randrange(40)}", f"n{rng.randrange(40)}") for _ in range(50)] + [("x", "x"), ("y", None), ("p", "q"), ("q", "r")]
    got = {}
    for r in graph.mutual(spark.createDataFrame(pairs + pairs[:5], "src string, dst string")).collect():
        got.setdefault(r.component, []).append(r.node)
    assert sorted(sorted(v) for v in got.values()) == graph.components([p for p in pairs if p[1]]) and all(k == min(v) for k, v in got.items())
    assert graph.mutual(spark.createDataFrame([("a", "b")], "src string, dst string")).collect() == []


def test_union_of_runs(spark):
    files = spark.createDataFrame([("r1", "b.xml", XML), ("r2", "a.xml", b'<testsuite name="t"><properties><property name="k" value="0"/><property name="z" value="9"/></properties><testcase name="n" time="1"/></testsuite>'), ("r3", "c.xml", b"<testsuite><testcase name='cut'")], "run_id string, path string, content binary")
    cases = junit.parse_reports(files)
    one = junit.merge_runs(cases, "p").first()
    ordered = sorted((c for c in cases.collect() if c.identity), key=lambda c: (c.path, c.seq))
    digest = hashlib.sha256(b"p" + b"".join(c.identity.encode() + bytes([["passed", "failed", "error", "skipped"].index(c.status)]) for c in ordered)).hexdigest()
    assert (one.total, one.complete, one.properties, one.digest_id) == (len(ordered), False, {"k": "2", "z": "9"}, f"p-{digest[:12]}")
    by = junit.summary(cases)
    d = junit.summary_delta(by.where("run_id = 'r1'").withColumn("run_id", F.lit("x")), by.where("run_id = 'r2'").withColumn("run_id", F.lit("x"))).first()
    a, b = by.where("run_id = 'r1'").first(), by.where("run_id = 'r2'").first()
    assert (d.failed_delta, d.passed_delta) == (b.failed + b.errors - a.failed - a.errors, b.passed - a.passed) and d.duration_delta_sec == b.duration_sec - a.duration_sec
    assert junit.run_digest(cases.limit(0), "p").collect() == []


def test_descriptor_leaks_against_a_plain_walk(spark):
    """Single traces replayed event by event with sets of numbers: an independent reading of the rules for plain calls."""
    rng = random.Random(11)
    rows, want = [], set()
    for t in range(6):
        shared = {1: {}, 2: {}}  # two processes of their own tables
        for seq in range(200):
            tid = rng.choice([1, 2])
            held = shared[tid]
            name = rng.choice(["openat", "openat", "close", "dup", "read", "write", "socket", "futex", "fcntl"])
            fd = rng.randrange(3, 12)
            failed = rng.random() < 0.1
            args, result = f"{fd}, x", str(fd)
            if name in ("openat", "socket", "dup") and not failed:
                held[fd] = True
            elif name == "close" and not failed:
                result = "0"
                held.pop(fd, None)
            elif name == "fcntl":
                args, result = f"{fd}, F_DUPFD, 0", str(fd + 20)
                if not failed:
                    held[fd + 20] = True
            rows.append((f"t{t}", seq, tid, "call", name, args, "-1" if failed else result, "EBADF" if failed else None))
        want |= {(f"t{t}", tid, fd) for tid, held in shared.items() for fd in held}
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "trace_id string, seq long, tid long, kind string, syscall string, arguments string, result string, error string")
    assert {tuple(r) for r in trace.descriptor_leaks(df).collect()} == want and len(want) > 20


def test_limits_bounds_and_years(spark):
    lines = spark.createDataFrame([(i, n, "hit" if n % 5 == 0 else "no") for i in (1, 0) for n in range(1, 21)], "input int, line_no int, raw string").withColumns({c: F.lit(None).cast(t) for c, t in (("level", "string"), ("ts_ms", "long"), ("source", "string"))})
    got = rows(logs.first_matches(lines, logs.LogFilter(query="HIT"), 5, after=1), "input", "line_no", "is_match")
    assert sorted(got) == [(0, n + k, k == 0) for n in (5, 10, 15) for k in (0, 1)] + [(0, 20, True)] + [(1, 5, True), (1, 6, False)]
    assert logs.bound_ms("2024-01-01") == logs.bound_ms("2024-01-01T01:00:00+01:00") == 1704067200000
    for bad in (lambda: logs.bound_ms("soon"), lambda: logs.bound_ms("2024-13-01"), lambda: logs.checked_year(0), lambda: logs.LogFilter(since_ms=2, until_ms=1), lambda: logs.LogFilter(regex=r"(?P<x>a)")):
        with pytest.raises(UsageError):
            bad()
    assert 2024 <= logs.default_year() and logs.LogFilter(regex=r"\p{L}++").regex
    assert rows(logs.as_jsonl(spark.createDataFrame([(1, None)], "a int, b string")), "line") == [('{"a":1,"b":null}',)]
    raw = spark.createDataFrame([(bytearray(b"ok"),), (bytearray(b"\xff!"),), (None,)], "raw binary")
    assert [tuple(r) for r in raw.select(logs.strict_text(F.col("raw")), logs.lossy_text(F.col("raw"))).collect()] == [("ok", "ok"), (None, "\ufffd!"), (None, None)]


def test_sections_of_bundles(spark):
    def rows_of(**contents):
        return bundle.section_rows(spark.createDataFrame([("b", f"./reports/{n}.json", c) for n, c in contents.items()] + [("b", "logs/x.log", "no")], "bundle string, name string, content string"))

    before = rows_of(doctor='[{"category":"c","name":"n","status":"pass"},{"category":"c","name":"m","status":"pass"}]', env_report='{"rows":[{"norm_name":"a","version":"1"}]}', test_run="{broken", disk_tree="[]")
    after = rows_of(doctor='[{"status":"warn","name":"n","category":"c"},{"category":"c","name":"k","status":"pass"}]', env_report='{"rows":[{"norm_name":"a","version":"1"}]}', test_run="[]", sys_snapshot="[]")
    got = sorted(rows(bundle.diff_sections(before, after), "section", "row_key", "change"), key=str)
    assert got == [("disk", None, "incomplete"), ("doctor", "c|k", "added"), ("doctor", "c|m", "removed"), ("doctor", "c|n", "changed"), ("sys", None, "incomplete"), ("test", None, "incomplete")]


def test_cycles_with_provenance(spark):
    text = "[Unit]\nAfter=b.service\nBefore=c.service\n"
    files = spark.createDataFrame([("a.service", "/a", 0, text), ("b.service", "/b", 0, "[Unit]\n\nAfter=a.service\n")], "unit string, path string, precedence int, content string")
    edges = units.ordering_edges(units.references(units.effective(units.parse_units(files)), provenance=True))
    (path,) = units.cycle_paths(edges)
    assert sorted((e["src"], e["dst"], e["directive"], e["path"], e["line"]) for e in path) == [("a.service", "b.service", "After", "/b", 3), ("b.service", "a.service", "After", "/a", 2)]


def test_levels_that_a_text_can_have(spark):
    texts = ["<11>Oct 9 12:00:00 h a: x", "2024-01-01T00:00:00Z error: x", '{"severity": 3}', '{"level": "CRIT"}', '{"priority":"2","msg":"x"}', '{"level":2}', "[WARNING] x", "all is well", '{"\\u006cevel":"err"}', "\x1b[31mER\x1b[0mROR: x", "PRIORITY=3 x", "(fatal) x", "info: x"]
    parsed = logs.parse_records(spark.createDataFrame([(t,) for t in texts], "raw string"), 2024)
    for least in logs.LEVEL_ORDER:
        keep = logs.LogFilter(min_level=least)
        plain = sorted(r.raw for r in parsed.where(keep.level_ok(F.col("level"))).collect())
        assert plain == sorted(r.raw for r in parsed.where(keep.condition(from_text=True)).collect()), least


def test_last_lives_against_a_walk(spark):
    rng = random.Random(8)
    data = [("t", s, rng.choice([1, 2, None]), rng.choice(["call", "call", "exit", "signal"])) for s in range(120)] + [("u", 1, 1, "exit"), ("v", 1, 1, "call"), ("w", 1, 1, "exit"), ("w", 2, 1, "exit")]
    lives = {}
    for t, _, tid, kind in sorted(data, key=lambda r: (r[0], r[1])):
        at = lives.setdefault((t, tid), {"now": 0, "seen": 0, "calls": {}})
        at["seen"] = at["now"]
        at["calls"][at["now"]] = at["calls"].get(at["now"], 0) + (kind == "call")
        at["now"] += kind == "exit"
    got = {(r.trace_id, r.tid): (r.generation, r.calls) for r in trace.generations(spark.createDataFrame(data, "trace_id string, seq long, tid long, kind string")).collect()}
    assert got == {k: (v["seen"], v["calls"][v["seen"]]) for k, v in lives.items()}


def test_editable_packages_and_report_inputs(tmp_path):
    site = tmp_path / "env/lib/python3/site-packages"
    (site / "My_Pkg-1.0.dist-info").mkdir(parents=True)
    (site / "My_Pkg-1.0.dist-info/direct_url.json").write_text('{"url": "file:///src/my", "dir_info": {"editable": true}}')
    (site / "other-1.0.dist-info").mkdir()
    (site / "other-1.0.dist-info/direct_url.json").write_text('{"url": "https://x/y", "dir_info": {"editable": true}}')
    (tmp_path / "proj/src").mkdir(parents=True)
    (tmp_path / "proj/pyproject.toml").write_text('[project]\nname = "Demo.App"\n')
    (site / "a.pth").write_text(f"# no\nimport sys\n{tmp_path}/proj/src\n/gone\n")
    assert files.editable_packages(str(tmp_path / "env")) == [("demo-app", str(tmp_path / "proj")), ("my-pkg", "/src/my")]
    for n in ("b.xml", "a.xml", "c.txt"):
        (tmp_path / n).write_text("<testsuite/>")
    assert [os.path.basename(p) for p in files.expand_reports(str(tmp_path))] == ["a.xml", "b.xml"] and files.expand_reports(str(tmp_path / "b*")) == [str(tmp_path / "b.xml")]
    with pytest.raises(UsageError):
        files.expand_reports(str(tmp_path / "z*.xml"))


def test_streams_of_traces_agree_with_batches(spark, tmp_path):
    rng = random.Random(4)
    kinds = "trace_id string, seq long, tid long, kind string, syscall string, arguments string, result string, error string, duration_ns long"
    data = []
    for t in ("a", "b"):
        for seq in range(90):
            tid = rng.choice([1, 2, 3])
            kind = rng.choice(["call", "call", "call", "unfinished", "resumed", "exit" if seq > 60 else "call"])
            name = rng.choice(["openat", "close", "read", "clone"]) if kind != "exit" else None
            data.append((t, seq, tid, kind, name, "3, CLONE_FILES" if name == "clone" else str(rng.randrange(3, 9)), None if kind == "unfinished" else str(rng.randrange(3, 9)), None, seq))
    for i in range(3):
        spark.createDataFrame([r for r in data if r[1] // 30 == i], kinds).coalesce(1).write.parquet(f"{tmp_path}/in/part={i}")
    batch = spark.createDataFrame(data, kinds)
    stitched = trace.stitch(batch)
    source = spark.readStream.schema(kinds).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")

    def run(df, name, source_dir):
        q = df.writeStream.format("memory").queryName(name).option("checkpointLocation", f"{tmp_path}/{name}").outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination(120)
        return sorted(map(tuple, spark.table(name).collect()), key=str)

    got = run(trace_streams.follow_calls(source), "stream_calls", None)
    plain = sorted((tuple(r) for r in stitched.select(*[c.split()[0] for c in kinds.split(", ")]).collect()), key=str)
    waiting = [r for r in plain if r[3] == "unfinished" and r not in got]
    assert sorted([*got, *waiting], key=str) == plain and len(waiting) <= 6 and any(r[3] == "call" and r[5].count(",") for r in got)
    leaks = run(trace_streams.follow_descriptors(source), "stream_leaks", None)
    walks = {}
    for t in ("a", "b"):
        d = trace.Descriptors()
        for r in sorted(x for x in data if x[0] == t):
            d.leave(r[2]) if r[3] == "exit" else d.call(r[2], r[4], r[5], r[6] or "", r[7]) if r[3] == "call" else None
        walks[t] = sorted(set(d.leaks))
    assert sorted(set(leaks)) == sorted((t, *x) for t, found in walks.items() for x in found) and leaks
