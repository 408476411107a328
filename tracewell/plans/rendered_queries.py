"""Queries whose inputs are written out from the driver's tables in the forms that programs and kernels write, then read
back by the operators: the SQL reads the tables alone and never sees a parser."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewell.functions.addresses import _grouped
from tracewell.functions.redact import redact
from tracewell.operators import build, bundle, disk, graph, health, junit, logs, net, pyenv, trace, units
from tracewell.plans import verdicts
from tracewell.plans.domain_queries import _neighbours
from tracewell.plans.problems import _IPV6
from tracewell.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


def _text(*parts: str | Column) -> Column:
    """Columns by name, and literals marked by ``=``, as one text."""
    return F.concat(*[F.lit(p[1:]) if isinstance(p, str) and p.startswith("=") else F.col(p).cast("string") if isinstance(p, str) else p.cast("string") for p in parts])


# ---- log lines in six layouts: each event is written in one ----

_FORM = "event_id % 6"
_LEVEL = "CASE event_type WHEN 'error' THEN 'error' WHEN 'purchase' THEN 'warn' WHEN 'signup' THEN 'info' WHEN 'click' THEN 'debug' ELSE 'info' END"
_MILLIS = "(epoch_us(ts) // 1000)"
_RECORDS_SQL = f"""SELECT event_id AS line_no, CASE {_FORM} WHEN 0 THEN {_MILLIS} // 1000 * 1000 WHEN 3 THEN {_MILLIS} ELSE {_MILLIS} END AS ts_ms, {_LEVEL} AS level, CASE WHEN {_FORM} IN (4, 5) THEN NULL ELSE 'app' || user_id END AS source,
    CASE WHEN {_FORM} IN (1, 2, 3) THEN 'did ' || event_type END AS message, CAST({_FORM} AS INT) AS form FROM events"""


def _layouts(spark: SparkSession, data: str) -> DataFrame:
    e = table(spark, data, "events").withColumn("ts", F.col("ts").cast("timestamp_ntz")).withColumn("ms", F.unix_millis(F.col("ts").cast("timestamp")))
    severity = F.when(F.col("event_type") == "error", 3).when(F.col("event_type") == "purchase", 4).when(F.col("event_type") == "signup", 6).when(F.col("event_type") == "click", 7).otherwise(5)
    name = F.when(severity == 3, "ERROR").when(severity == 4, "WARN").when(severity == 7, "DEBUG").otherwise("INFO")
    fmt = lambda f: F.date_format("ts", f)
    forms = [
        _text("=<", severity + 16 * 8, "=>", fmt("MMM"), "= ", F.lpad(fmt("d"), 2, " "), "= ", fmt("HH:mm:ss"), "= host1 app", "user_id", "=[77]: did ", "event_type"),
        _text('={"timestamp": "', fmt("yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"), '=", "LEVEL": "', F.lower(name), '=", "source": "app', "user_id", '=", "msg": "did ', "event_type", '="}'),
        _text('={"severity": "', severity, '=", "level": "none", "ts": ', "ms", '=, "logger": "app', "user_id", '=", "message": "did ', "event_type", '=", "n": 5}'),
        _text('={"__REALTIME_TIMESTAMP": "', F.col("ms") * 1000, '=", "PRIORITY": "', severity, '=", "SYSLOG_IDENTIFIER": "app', "user_id", '=", "MESSAGE": "did ', "event_type", '="}'),
        _text(fmt("yyyy-MM-dd HH:mm:ss,SSS"), "= [", name, "=] user did ", "event_type"),
        _text(F.date_format(F.col("ts") + F.expr("INTERVAL 2 HOURS"), "yyyy-MM-dd'T'HH:mm:ss.SSS"), "=+02:00 ", name, "= user did ", "event_type"),
    ]
    form = F.pmod("event_id", F.lit(6)).cast("int")
    raw = F.get(F.array(*forms), form)
    return e.select(F.lit("events").alias("file"), F.col("event_id").alias("line_no"), form.alias("form"), raw.alias("raw"))


def _parsed(spark: SparkSession, data: str) -> DataFrame:
    rows = logs.parse_records(_layouts(spark, data), 2024)
    return rows.withColumn("message", F.when(F.col("form").isin(1, 2, 3), F.col("message")))


@query(_RECORDS_SQL)
def log_layouts(spark, data):
    return _parsed(spark, data).select("line_no", "ts_ms", "level", "source", "message", "form")


@query(f"SELECT line_no FROM ({_RECORDS_SQL}) r JOIN events ON event_id = line_no WHERE source = 'app7' OR source = 'app11'")
def log_source_filter(spark, data):
    r = _parsed(spark, data)
    return r.where(logs.LogFilter(source="app7").condition() | logs.LogFilter(source="app11").condition()).select("line_no")


@query(f"SELECT line_no FROM ({_RECORDS_SQL}) r JOIN events ON event_id = line_no WHERE level IN ('warn', 'error') AND source LIKE 'app%' AND length(source) = 5 AND event_type = 'error' AND r.ts_ms >= 1704672000000")
def log_conjunction(spark, data):
    keep = logs.LogFilter(query="DID ERROR", min_level="warn", since_ms=1704672000000, regex=r"(?i)app\d{2}\b")
    return _parsed(spark, data).where(keep.condition(from_text=True)).select("line_no")


@query(f"SELECT line_no, strftime(make_timestamp(ts_ms * 1000), '%Y-%m-%dT%H:%M:%SZ') AS at FROM ({_RECORDS_SQL})")
def log_rfc3339(spark, data):
    return _parsed(spark, data).select("line_no", logs.rfc3339(F.col("ts_ms")).alias("at"))


@query("SELECT event_id AS line_no, epoch_us(ts) // 1000 // 60000 * 60000 AS bound FROM events")
def log_bounds(spark, data):
    e = table(spark, data, "events")
    written = F.when(F.pmod("event_id", F.lit(2)) == 0, F.date_format(F.col("ts").cast("timestamp_ntz"), "yyyy-MM-dd HH:mm")).otherwise(F.date_format(F.col("ts").cast("timestamp_ntz"), "yyyy-MM-dd'T'HH:mm:00'Z'"))
    return e.select(F.col("event_id").alias("line_no"), logs.parse_bound(written).alias("bound"))


@query(
    f"""WITH r AS (SELECT user_id % 4 AS input, line_no, event_type = 'error' AS hit FROM ({_RECORDS_SQL}) JOIN events ON event_id = line_no), h AS (SELECT input, line_no FROM r WHERE hit ORDER BY input, line_no LIMIT 500)
    SELECT r.input, r.line_no, max(r.line_no = h.line_no) AS is_match FROM r JOIN h ON h.input = r.input AND r.line_no BETWEEN h.line_no AND h.line_no + 3 GROUP BY 1, 2"""
)
def log_global_limit(spark, data):
    e = table(spark, data, "events").select(F.col("event_id").alias("line_no"), F.pmod("user_id", F.lit(4)).alias("input"))
    rows = _layouts(spark, data).join(e, "line_no")
    return logs.first_matches(rows, logs.LogFilter(query="did error"), 500, after=3).select("input", "line_no", "is_match")


@query("SELECT doc_id, text AS strict, length(text) AS lossy_length FROM documents WHERE doc_id IS NOT NULL")
def log_strict_text(spark, data):
    raw = F.encode("text", "UTF-8")
    return table(spark, data, "documents").where("doc_id IS NOT NULL").select("doc_id", logs.strict_text(raw).alias("strict"), F.length(logs.lossy_text(raw)).alias("lossy_length"))


@query("""SELECT '{"record_id":' || record_id || ',"level":' || CASE WHEN level IS NULL THEN 'null' ELSE '"' || level || '"' END || '}' AS line FROM log_records""")
def log_jsonl(spark, data):
    return logs.as_jsonl(table(spark, data, "log_records").select("record_id", "level"))


# ---- tracer lines ----

_ONCE_SQL = "(SELECT trace_id, seq, min(tid) AS tid, min(syscall) AS syscall, min(arguments) AS arguments, min(result) AS result, min(error) AS error, min(duration_ns) AS duration_ns FROM trace_events GROUP BY trace_id, seq)"


def _calls(spark: SparkSession, data: str) -> DataFrame:
    t = table(spark, data, "trace_events")
    return t.groupBy("trace_id", "seq").agg(*[F.min(c).alias(c) for c in ("tid", "syscall", "arguments", "result", "error", "duration_ns")])


def _rendered(spark: SparkSession, data: str, halves: bool = False) -> DataFrame:
    """Calls as tracer lines; with halves every call is cut into an unfinished line and a resumed one."""
    done = _text("= = ", F.coalesce("result", F.lit("?")), F.coalesce(F.concat(F.lit(" "), "error", F.lit(" (what it means)")), F.lit("")), F.coalesce(F.format_string(" <%d.%09d>", F.floor(F.col("duration_ns") / 1_000_000_000).cast("long"), F.pmod("duration_ns", F.lit(1_000_000_000))), F.lit("")))
    head = _text("=[pid ", "tid", "=] 12:00:00.000001 ")
    calls = _calls(spark, data)
    if not halves:
        return calls.select("trace_id", "seq", F.concat(head, _text("syscall", "=(", F.coalesce("arguments", F.lit("")), "=)"), done).alias("raw"))
    first = _text("syscall", "=(", F.coalesce("arguments", F.lit("")), "= <unfinished ...>")
    second = F.concat(_text("=<... ", "syscall", "= resumed>)"), done)
    return calls.select("trace_id", F.inline(F.array(F.struct((F.col("seq") * 2).alias("seq"), F.concat(head, first).alias("raw")), F.struct((F.col("seq") * 2 + 1).alias("seq"), F.concat(head, second).alias("raw")))))


@query(f"SELECT trace_id, seq, tid, 'call' AS kind, syscall, coalesce(arguments, '') AS arguments, coalesce(result, '?') AS result, CASE WHEN coalesce(result, '?') IN ('-1', '?') THEN coalesce(error, CASE WHEN result = '-1' THEN 'UNKNOWN_ERROR' END) END AS error, duration_ns FROM {_ONCE_SQL}")
def trace_lines(spark, data):
    return trace.parse_lines(_rendered(spark, data)).drop("ts")


@query(f"SELECT trace_id, seq * 2 + 1 AS seq, tid, syscall, coalesce(arguments, '') AS arguments, coalesce(result, '?') AS result, duration_ns FROM {_ONCE_SQL}")
def trace_stitched(spark, data):
    return trace.stitch(trace.parse_lines(_rendered(spark, data, halves=True))).where("kind = 'call'").select("trace_id", "seq", "tid", "syscall", "arguments", "result", "duration_ns")


@query(f"SELECT trace_id, seq, syscall FROM {_ONCE_SQL} ORDER BY trace_id, seq LIMIT 1000")
def trace_retained(spark, data):
    return trace.retained(_calls(spark, data), 1000)[0].select("trace_id", "seq", "syscall")


# ---- reports of tests ----


@query(
    """SELECT 'r' || user_id % 5 AS run_id, 's' || user_id AS suite, 'e<' || event_id AS name, CASE event_type WHEN 'error' THEN 'error' WHEN 'purchase' THEN 'failed' WHEN 'view' THEN 'skipped' ELSE 'passed' END AS status,
    CASE WHEN event_type IN ('error', 'purchase', 'view') THEN 'because & ' || event_type END AS message, CASE WHEN event_type = 'click' THEN 'out ' || user_id END AS output, floor(value) / 8 AS duration_sec, event_type <> 'signup' AS complete, CAST(event_id AS VARCHAR) AS build, 's' || user_id || '::c::e<' || event_id AS identity FROM events"""
)
def test_reports(spark, data):
    e = table(spark, data, "events")
    kind = F.col("event_type")
    inner = F.when(kind == "error", '<error message="because &amp; error"/>').when(kind == "purchase", '<failure message="because &amp; purchase">at line 5</failure>').when(kind == "view", '<skipped message="because &amp; view"/>').when(kind == "click", _text("=<system-out>out ", "user_id", "=</system-out>")).otherwise("")
    xml = _text('=<testsuites><testsuite name="s', "user_id", '="><properties><property name="build" value="0"/><property name="build" value="', "event_id", '="/></properties><testcase classname="c" name="e&lt;', "event_id", '=" time="', (F.floor("value") / 8).cast("decimal(12,3)"), '=">', inner, "=</testcase></testsuite>", F.when(kind == "signup", "").otherwise("</testsuites>"))
    files = e.select(_text("=r", F.pmod("user_id", F.lit(5))).alias("run_id"), F.col("event_id").cast("string").alias("path"), F.encode(xml, "UTF-8").alias("content"))
    cases = junit.parse_reports(files)
    return cases.select("run_id", "suite", "name", "status", "message", "output", "duration_sec", "complete", F.col("properties")["build"].alias("build"), "identity")


_RUN_SQL = "CASE WHEN ts < TIMESTAMP '2024-01-16' THEN 'a' ELSE 'b' END"
_STATUS_SQL = "CASE event_type WHEN 'error' THEN 'error' WHEN 'purchase' THEN 'failed' WHEN 'view' THEN 'skipped' ELSE 'passed' END"


def _cases(spark: SparkSession, data: str) -> DataFrame:
    e = table(spark, data, "events")
    status = F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "purchase", "failed").when(F.col("event_type") == "view", "skipped").otherwise("passed")
    run = F.when(F.col("ts").cast("timestamp_ntz") < F.lit("2024-01-16").cast("timestamp_ntz"), "a").otherwise("b")
    return e.select(run.alias("run_id"), F.col("user_id").cast("string").alias("path"), F.col("event_id").alias("seq"), status.alias("status"), F.lit("s").alias("suite"), F.lit("").alias("classname"), F.col("event_id").cast("string").alias("name"), F.lit(0.5).alias("duration_sec"), (F.col("event_type") != "signup").alias("complete"), F.create_map(F.lit("host"), F.col("user_id").cast("string")).alias("properties"), _text("=s::", "event_id").alias("identity"))


@query(
    f"""SELECT 'all' AS run_id, count(*) AS total, count(*) FILTER (WHERE {_STATUS_SQL} = 'passed') AS passed, count(*) FILTER (WHERE {_STATUS_SQL} = 'failed') AS failed, count(*) FILTER (WHERE {_STATUS_SQL} = 'error') AS errors, count(*) FILTER (WHERE {_STATUS_SQL} = 'skipped') AS skipped, sum(0.5::DOUBLE) AS duration_sec, bool_and(event_type <> 'signup') AS complete,
    'all-' || substring(sha256('all' || string_agg('s::' || event_id || chr(CASE {_STATUS_SQL} WHEN 'passed' THEN 0 WHEN 'failed' THEN 1 WHEN 'error' THEN 2 ELSE 3 END), '' ORDER BY CAST(user_id AS VARCHAR), event_id)), 1, 12) AS digest_id, max(CAST(user_id AS VARCHAR)) AS host FROM events"""
)
def test_union(spark, data):
    return junit.merge_runs(_cases(spark, data), "all").withColumn("host", F.col("properties")["host"]).drop("properties")


@query(
    f"""WITH s AS (SELECT {_RUN_SQL} AS run, count(*) FILTER (WHERE {_STATUS_SQL} IN ('failed', 'error')) AS bad, count(*) FILTER (WHERE {_STATUS_SQL} = 'passed') AS good, sum(0.5::DOUBLE) AS sec FROM events GROUP BY 1)
    SELECT b.bad - a.bad AS failed_delta, b.good - a.good AS passed_delta, b.sec - a.sec AS duration_delta_sec FROM s a, s b WHERE a.run = 'a' AND b.run = 'b'"""
)
def test_summary_delta(spark, data):
    s = junit.summary(_cases(spark, data))
    return junit.summary_delta(s.where("run_id = 'a'"), s.where("run_id = 'b'"), ())


@query(f"SELECT 'fail' AS severity, 'test.' || CASE WHEN {_STATUS_SQL} = 'error' THEN 'regression' ELSE 'new_failure' END AS code, count(*) AS n FROM events WHERE event_type IN ('error', 'purchase') GROUP BY 1, 2")
def test_verdict(spark, data):
    c = _cases(spark, data)
    before = c.where("status <> 'failed'").withColumn("status", F.when(F.col("status") == "error", "passed").otherwise(F.col("status")))
    found = verdicts.test_diff(junit.diff_runs(before, c))
    return found.groupBy("severity", "code").agg(F.count(F.lit(1)).alias("n"))


# ---- disk ----


@query("SELECT p_partkey, (p_size > 25 AND row_number() OVER (PARTITION BY p_size > 25, p_size ORDER BY p_partkey) = 1 OR p_size <= 25) AS counted, CASE WHEN p_size > 25 AND row_number() OVER (PARTITION BY p_size > 25, p_size ORDER BY p_partkey) > 1 THEN 0 ELSE CAST(floor(p_retailprice) AS BIGINT) END AS own_size FROM part")
def disk_hard_links(spark, data):
    n = table(spark, data, "part").select("p_partkey", F.col("p_partkey").alias("node_id"), F.lit(1).alias("device"), F.col("p_size").alias("inode"), F.when(F.col("p_size") > 25, 2).otherwise(1).alias("nlink"), F.floor("p_retailprice").cast("bigint").alias("size"), F.lit(0).cast("bigint").alias("allocated"))
    return disk.own_sizes(n).select("p_partkey", "counted", "own_size")


@query("SELECT n_nationkey AS node_id, n_regionkey AS parent_id FROM nation WHERE n_regionkey = 2")
def disk_children(spark, data):
    n = table(spark, data, "nation").select(F.col("n_nationkey").alias("node_id"), F.col("n_regionkey").alias("parent_id"))
    return disk.children(n, 2)


@query("SELECT s_suppkey, hex(encode(s_name)) AS name_hex, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_name) AS place FROM (SELECT s_suppkey, s_nationkey, s_name FROM supplier)")
def disk_snapshot_rows(spark, data):
    n = table(spark, data, "supplier").select("s_suppkey", F.col("s_nationkey").alias("parent_id"), F.col("s_name").alias("name"), F.col("s_name").alias("rel_path"))
    return disk.snapshot_rows(n).select("s_suppkey", F.upper("name_hex").alias("name_hex"), F.col("place").cast("bigint").alias("place"))


# ---- sockets ----

def _word(g: Column, w: int) -> Column:
    """Two groups of an IPv6 address as a little-endian word."""
    both = F.concat(F.lpad(F.get(g, F.lit(2 * w)), 4, "0"), F.lpad(F.get(g, F.lit(2 * w + 1)), 4, "0"))
    return F.concat(*[F.substring(both, i, 2) for i in (7, 5, 3, 1)])


def _kernel_lines(spark: SparkSession, data: str) -> DataFrame:
    """Inet sockets as lines of the kernel's tables."""
    s = table(spark, data, "sockets").where("lower(trim(kind)) IN ('tcp', 'tcp6', 'udp', 'udp6') AND local_address IS NOT NULL AND local_port IS NOT NULL").select(F.lower(F.trim("kind")).alias("kind"), F.lower(F.trim("local_address")).alias("local_address"), "local_port", F.upper(F.trim("state")).alias("state"), "inode", "uid", "tx_queue", "rx_queue")
    g = F.when(F.contains("local_address", F.lit(":")), _grouped(F.col("local_address")))
    octets = F.transform(F.split("local_address", r"\."), lambda x: F.lpad(F.hex(x.try_cast("bigint")), 2, "0"))
    host = F.when(g.isNotNull(), F.concat(*[_word(g, w) for w in range(4)])).otherwise(F.concat(*[F.get(octets, F.lit(i)) for i in (3, 2, 1, 0)]))
    code = F.lpad(F.hex(F.array_position(F.array(*[F.lit(x) for x in net.TCP_STATES]), F.col("state"))), 2, "0")
    none = F.when(g.isNotNull(), "0" * 32).otherwise("0" * 8)
    number = lambda c: F.lpad(F.hex(F.coalesce(c, F.lit(0)).cast("bigint")), 8, "0")
    raw = F.concat_ws(" ", F.lit("  12:"), F.concat(F.upper(host), F.lit(":"), F.lpad(F.hex("local_port"), 4, "0")), F.concat(none, F.lit(":0000")), code, F.concat(number(F.col("tx_queue")), F.lit(":"), number(F.col("rx_queue"))), F.lit("00:00000000 00000000"), F.coalesce("uid", F.lit(0)).cast("string"), F.lit("0"), F.coalesce("inode", F.lit(0)).cast("string"), F.lit("2 0000 100 0"))
    return s.select("kind", raw.alias("raw"))


_INET = _IPV6.replace("kind, local_port, CASE", "kind, local_port, state, inode, uid, tx_queue, rx_queue, CASE").replace("lower(trim(kind)) AS kind, local_port, lower", "lower(trim(kind)) AS kind, local_port, upper(trim(state)) AS state, coalesce(inode, 0) AS inode, coalesce(uid, 0) AS uid, coalesce(tx_queue, 0) AS tx_queue, coalesce(rx_queue, 0) AS rx_queue, lower").replace("WHERE lower(trim(kind)) IN ('tcp', 'tcp6') AND upper(trim(state)) = 'LISTEN'", "WHERE lower(trim(kind)) IN ('tcp', 'tcp6', 'udp', 'udp6') AND local_address IS NOT NULL AND local_port IS NOT NULL").replace("WHEN kind = 'tcp' THEN a", "WHEN kind IN ('tcp', 'udp') THEN a")


@query(f"SELECT kind, address AS local_address, local_port, CASE WHEN kind LIKE 'udp%' AND state = '' THEN 'UNKNOWN' ELSE state END AS state, inode, uid, tx_queue, rx_queue FROM {_INET}")
def net_kernel_tables(spark, data):
    return net.parse_inet(_kernel_lines(spark, data)).select("kind", "local_address", "local_port", "state", "inode", "uid", "tx_queue", "rx_queue")


def _owned(spark: SparkSession, data: str) -> DataFrame:
    """Sockets with owners: inodes that 3 divides have one, users up to 50 could not be read."""
    s = table(spark, data, "sockets")
    owners = s.where("inode > 0 AND inode % 3 = 0").select("inode").distinct().select("inode", (F.col("inode") + 1).alias("pid"), F.lit(3).alias("fd"), F.lit("p").alias("comm"))
    unread = s.where("uid <= 50").select("uid").distinct()
    known = net.with_owners(s.join(unread.withColumn("__x", F.lit(True)), "uid", "left"), owners)
    return known.withColumn("owner_state", F.when((F.col("owner_state") == "orphan") & F.col("__x"), "owner_unknown").otherwise(F.col("owner_state"))).drop("__x")


_STATE_SQL = "CASE WHEN coalesce(inode, 0) <> 0 AND NOT (inode > 0 AND inode % 3 = 0) THEN CASE WHEN uid <= 50 THEN 'owner_unknown' ELSE 'orphan' END END"
_LISTEN_SQL = "coalesce((state = 'LISTEN' AND kind NOT LIKE 'unix%') OR (kind IN ('udp', 'udp6') AND (remote_port = 0 OR remote_address IN ('0.0.0.0', '::', '*')) AND local_port <> 0), false)"


@query(f"SELECT host, count(*) FILTER (WHERE o = 'orphan') AS orphans, count(*) FILTER (WHERE o = 'owner_unknown') AS owner_unknown FROM (SELECT host, {_STATE_SQL} AS o FROM sockets) GROUP BY host")
def net_owner_states(spark, data):
    return net.summary(_owned(spark, data), ("host",)).select("host", "orphans", "owner_unknown")


@query(
    f"""WITH p AS (SELECT *, local_address IN ('0.0.0.0', '::', '*', '') AND {_LISTEN_SQL} AND local_port % 50 = 0 AS open, {_STATE_SQL} AS o FROM sockets), h AS (SELECT host, count(*) AS total, count(*) FILTER (WHERE open OR {_LISTEN_SQL}) AS listeners, count(*) FILTER (WHERE open) AS exposed, count(*) FILTER (WHERE o = 'orphan') AS orphans FROM p GROUP BY host)
    SELECT host, 'overview' AS name, 'pass' AS status FROM h UNION ALL SELECT host, 'exposed_listeners', CASE WHEN exposed > 0 THEN 'warn' ELSE 'pass' END FROM h UNION ALL SELECT host, 'orphans', CASE WHEN orphans > 0 THEN 'warn' ELSE 'pass' END FROM h"""
)
def net_checks(spark, data):
    # ports that 50 divides stand for a sensitive one
    moved = _owned(spark, data).withColumn("local_port", F.when(F.col("local_port") % 50 == 0, 6379).otherwise(F.when(F.col("local_port").isin(net.SENSITIVE_PORTS), 1).otherwise(F.col("local_port"))))
    return net.checks(moved, ("host",)).select("host", "name", "status")


@query("SELECT host, count(*) AS total, count(*) FILTER (WHERE state = 'TIME_WAIT') AS time_wait FROM sockets WHERE kind IS NULL OR kind NOT LIKE 'unix%' GROUP BY host")
def net_without_unix(spark, data):
    return net.summary(net.without_unix(table(spark, data, "sockets")), ("host",)).select("host", "total", "time_wait")


@query("SELECT host, count(*) FILTER (WHERE snapshot_no % 2 = 0) - count(*) FILTER (WHERE snapshot_no % 2 = 1) AS time_wait_delta FROM sockets WHERE state = 'TIME_WAIT' GROUP BY host")
def net_waiting_delta(spark, data):
    s = table(spark, data, "sockets")
    return net.waiting_delta(s.where("snapshot_no % 2 = 1"), s.where("snapshot_no % 2 = 0"), ("host",))


# ---- units ----


def _unit_files(spark: SparkSession, data: str) -> DataFrame:
    """A unit file for each supplier: it starts after its nation's unit and wants an instance of a template."""
    s = table(spark, data, "supplier")
    text = _text("=# comment\n[Unit]\nDescription=S %n\nAfter=n", "s_nationkey", "=.service \\\n  x", "s_suppkey", "=.service\nWants=t@", "s_suppkey", "=.service\n\n[Service]\nExecStart=/bin/run %p\nExecStart=\nExecStart=/bin/run \"", "s_nationkey", "=\"\nnonsense\n")
    return s.select(_text("=s", "s_suppkey", "=.service").alias("unit"), _text("=/etc/s", "s_suppkey").alias("path"), F.lit(0).alias("precedence"), text.alias("content"))


_UNITS_SQL = """(SELECT 's' || s_suppkey || '.service' AS unit, u.* FROM supplier, LATERAL (VALUES ('Unit', 'Description', 'S s' || s_suppkey || '.service'), ('Unit', 'After', 'n' || s_nationkey || '.service x' || s_suppkey || '.service'), ('Unit', 'Wants', 't@' || s_suppkey || '.service'), ('Service', 'ExecStart', '/bin/run "' || s_nationkey || '"')) u(section, key, value))"""


def _held(spark: SparkSession, data: str) -> DataFrame:
    return units.expand_specifiers(units.effective(units.parse_units(_unit_files(spark, data))))


@query(f"SELECT unit, section, key, value FROM {_UNITS_SQL}")
def unit_files(spark, data):
    return _held(spark, data).select("unit", "section", "key", F.regexp_replace("value", r"\s+", " ").alias("value"))


@query("SELECT 's' || s_suppkey || '.service' AS unit, 'SYNTAX_GARBAGE_LINE' AS diagnostic FROM supplier")
def unit_diagnostics(spark, data):
    return units.parse_units(_unit_files(spark, data)).where("diagnostic IS NOT NULL").select("unit", "diagnostic")


_REFS_SQL = "SELECT 's' || s_suppkey || '.service' AS unit, u.* FROM supplier, LATERAL (VALUES ('After', 'n' || s_nationkey || '.service'), ('After', 'x' || s_suppkey || '.service'), ('Wants', 't@' || s_suppkey || '.service')) u(key, target)"


@query(f"SELECT unit, key, target FROM ({_REFS_SQL}) WHERE target LIKE 'x%'")
def unit_missing_references(spark, data):
    refs = units.references(_held(spark, data))
    known = table(spark, data, "nation").select(_text("=n", "n_nationkey", "=.service").alias("unit")).union(spark.createDataFrame([("t@.service",)], "unit string"))
    return units.missing_references(refs, known)


@query(f"SELECT target AS src, unit AS dst, 'After' AS directive, '/etc/s' || substring(unit, 2, length(unit) - 9) AS path FROM ({_REFS_SQL}) WHERE key = 'After'")
def unit_ordering(spark, data):
    return units.ordering_edges(units.references(_held(spark, data), provenance=True)).select("src", "dst", "directive", "path")


@query("""SELECT 't@' || s_suppkey || '.service' AS unit, 't@.service' AS template, '/run/' || s_suppkey || ' t' AS value FROM supplier""")
def unit_instances(spark, data):
    template = spark.createDataFrame([("t@.service", "/etc/t", 0, "[Service]\nExecStart=/run/%i %p\n")], "unit string, path string, precedence int, content string")
    entries = units.effective(units.parse_units(_unit_files(spark, data).unionByName(template)))
    grown = units.expand_instances(entries)
    return grown.where(units.template_of(F.col("unit")).isNotNull()).select("unit", units.template_of(F.col("unit")).alias("template"), "value")


@query("SELECT 's' || s_suppkey AS unit, f.* FROM supplier, LATERAL (VALUES ('masked', 'false', 'true'), ('wants', '[\"a\"]', '[\"a\",\"b\"]')) f(field, before, after) WHERE s_acctbal < 0 OR field = 'wants' AND s_nationkey = 3")
def unit_meta_diff(spark, data):
    s = table(spark, data, "supplier")
    low, third = F.col("s_acctbal") < 0, F.col("s_nationkey") == 3
    row = lambda masked, wants: s.select(_text("=s", "s_suppkey").alias("unit"), masked.alias("masked"), F.lit(None).cast("string").alias("alias_of"), F.array(F.lit("x.conf")).alias("drop_ins"), wants.alias("wants"), F.array().cast("array<string>").alias("requires"))
    one, two = F.array(F.lit("a")), F.array(F.lit("b"), F.lit("a"), F.lit("b"))
    return units.diff_meta(row(F.lit(False), one), row(low, F.when(low | third, two).otherwise(one)))


@query("SELECT CAST(n_nationkey AS VARCHAR) AS host, 'ordering_cycles' AS name, CASE WHEN n_regionkey = 0 THEN 'skip' WHEN n_regionkey = 1 THEN 'fail' ELSE 'pass' END AS status FROM nation UNION ALL SELECT CAST(n_nationkey AS VARCHAR), 'unit_files', CASE WHEN n_regionkey = 0 THEN 'skip' WHEN n_regionkey = 2 THEN 'warn' ELSE 'pass' END FROM nation")
def unit_checks(spark, data):
    n = table(spark, data, "nation").select(F.col("n_nationkey").cast("string").alias("host"), F.when(F.col("n_regionkey") != 0, F.col("n_name")).alias("unit"), "n_regionkey")
    found = health.service_checks(n, n.where("n_regionkey = 1"), n.where("n_regionkey = 2").withColumn("diagnostic", F.lit("SYNTAX_GARBAGE_LINE")))
    return found.select("host", "name", "status")


# ---- builds ----


@query("SELECT p_partkey, '/w/src' AS directory, 'src' || p_size || '/a b.c' AS file, 'cc' AS compiler, 'c' || p_size % 3 || '1' AS standard, 'inc/' || p_size || '|/abs' AS includes, 'A=' || p_brand || '|N=\"x\"' AS defines FROM part")
def build_commands(spark, data):
    p = table(spark, data, "part")
    command = _text("=cc -Iinc/", "p_size", "= -I /abs -DA='", "p_brand", "=' -D 'N=\"x\"' -std=c", F.pmod("p_size", F.lit(3)), "=1 -O2 -c 'src", "p_size", "=/a b.c'")
    rows = p.select(_text("=src", "p_size", "=/a b.c").alias("file"), F.lit("/w/src").alias("directory"), command.alias("command"), F.lit(None).cast("string").alias("output"), "p_partkey")
    key = _text("p_partkey")
    parsed = build.parse_commands(rows.withColumn("directory", F.concat(F.lit("/w/src/../k"), key, F.lit("/../src"))).withColumn("output", key))
    return parsed.select(F.col("output").cast("bigint").alias("p_partkey"), F.lit("/w/src").alias("directory"), F.regexp_extract("file", r"(src\d+/a b\.c)\z", 1).alias("file"), "compiler", "standard", F.array_join(F.transform("includes", lambda i: F.regexp_replace(i, r"\A.*/inc/", "inc/")), "|").alias("includes"), F.array_join("defines", "|").alias("defines"))


@query("SELECT 'f' || p_partkey AS path, CAST(i AS INT) AS seq, CASE i WHEN 0 THEN 'h' || p_size || '.h' ELSE 'sys/' || p_brand END AS name, i = 0 AS quoted FROM part, range(2) r(i)")
def build_includes(spark, data):
    text = _text('=// #include "no.h"\n#include "h', "p_size", '=.h" // yes\n/* #include <not.h>\n*/ char *s = "x /* ";\n  #  include <sys/', "p_brand", "=>\n")
    return build.extract_includes(table(spark, data, "part").select(_text("=f", "p_partkey").alias("path"), text.alias("text")))


# ---- environments ----

_SPECS = [">=1.10", "~=1.10.2", "==1.20.*", "!=1.20.*", "==1.5.0", "<1.10,>1.2", "~=1.10", "===1.7.3", ">1.49.1"]
_SPEC_SQL = "CASE i WHEN 0 THEN s >= 10 WHEN 1 THEN s = 10 AND k >= 2 WHEN 2 THEN s = 20 WHEN 3 THEN s <> 20 WHEN 4 THEN s = 5 AND k = 0 WHEN 5 THEN s < 10 AND (s > 2 OR s = 2 AND k > 0) WHEN 6 THEN s >= 10 WHEN 7 THEN s = 7 AND k = 3 ELSE s > 49 OR s = 49 AND k > 1 END"


@query(f"SELECT p_partkey, CAST(i AS INT) AS i, {_SPEC_SQL} AS met FROM (SELECT p_partkey, p_size AS s, p_partkey % 4 AS k FROM part), range({len(_SPECS)}) r(i)")
def env_version_matrix(spark, data):
    version = _text("=1.", "p_size", "=.", F.pmod("p_partkey", F.lit(4)))
    specs = F.posexplode(F.array(*[F.lit(s) for s in _SPECS])).alias("i", "spec")
    return table(spark, data, "part").select("p_partkey", version.alias("v"), specs).select("p_partkey", "i", pyenv.satisfies(F.col("v"), F.col("spec")).alias("met"))


@query("SELECT p_partkey, lower(regexp_replace(p_name || '__' || p_brand, '[-_.]+', '-', 'g')) AS name FROM part")
def env_names(spark, data):
    return table(spark, data, "part").select("p_partkey", pyenv.name_normalised(F.concat_ws("__", "p_name", "p_brand")).alias("name"))


_ENV_SQL = "(SELECT 'e' || p_size % 5 AS env, 'Pkg.' || p_partkey AS name, '1.' || p_size AS version, p_partkey FROM part)"


def _packages(spark: SparkSession, data: str) -> DataFrame:
    """METADATA of a package for each part: it needs another one, a version, and something for another platform."""
    p = table(spark, data, "part")
    text = _text("=Metadata-Version: 2.1\nName: Pkg.", "p_partkey", "=\nVersion: 1.", "p_size", "=\nSummary: s\nRequires-Dist: pkg_", F.col("p_partkey") + 1, "= (>=1.25)\nRequires-Dist: gone; sys_platform == 'win32'\nRequires-Dist: lost[x] ; python_version >= '3'\n\nName: body")
    return pyenv.parse_metadata(p.select(_text("=e", F.pmod("p_size", F.lit(5))).alias("env"), text.alias("text")))


@query(f"SELECT env, name, lower(replace(name, '.', '-')) AS norm_name, version, 's' AS summary, CAST(3 AS INT) AS needs FROM {_ENV_SQL}")
def env_metadata(spark, data):
    return _packages(spark, data).withColumn("needs", F.size("requires_dist")).drop("requires_dist")


@query(
    f"""WITH p AS {_ENV_SQL}, n AS (SELECT a.env, a.name AS package, 'pkg_' || a.partkey || ' (>=1.25)' AS requirement, b.version FROM (SELECT env, name, p_partkey + 1 AS partkey FROM p) a LEFT JOIN p b ON b.env = a.env AND b.p_partkey = a.partkey)
    SELECT env, package, requirement, CASE WHEN version IS NULL THEN 'missing' ELSE 'conflict' END AS state FROM n WHERE version IS NULL OR CAST(substring(version, 3) AS INT) < 25
    UNION ALL SELECT env, name, 'lost[x] ; python_version >= ''3''', 'missing' FROM p"""
)
def env_dependencies(spark, data):
    return pyenv.check_dependencies(_packages(spark, data), pyenv.MarkerEnv.for_python("3.12.1"))


@query("WITH b AS (SELECT p_brand AS norm_name, '1.' || max(p_size) AS v FROM part WHERE p_size <= 30 GROUP BY 1), a AS (SELECT p_brand AS norm_name, '1.' || min(p_size) AS v FROM part WHERE p_size > 20 GROUP BY 1) SELECT * FROM (SELECT coalesce(b.norm_name, a.norm_name) AS norm_name, b.v AS before_version, a.v AS after_version, CASE WHEN b.v IS NULL THEN 'added' WHEN a.v IS NULL THEN 'removed' WHEN a.v <> b.v THEN 'changed' END AS change FROM b FULL JOIN a ON a.norm_name = b.norm_name) WHERE change IS NOT NULL")
def env_diff(spark, data):
    p = table(spark, data, "part")
    side = lambda cond, f: p.where(cond).groupBy(F.col("p_brand").alias("norm_name")).agg(_text("=1.", f("p_size")).alias("version"))
    return pyenv.diff_environments(side("p_size <= 30", F.max), side("p_size > 20", F.min))


# ---- bundles, secrets, health ----


@query(
    """WITH r AS (SELECT host, snapshot_no, kind || '|' || local_address || '|' || local_port || '|' || remote_address || '|' || remote_port AS k FROM (SELECT host, snapshot_no, coalesce(kind, '') AS kind, coalesce(local_address, '') AS local_address, coalesce(CAST(local_port AS VARCHAR), '') AS local_port, coalesce(remote_address, '') AS remote_address, coalesce(CAST(remote_port AS VARCHAR), '') AS remote_port FROM sockets) GROUP BY ALL),
    n AS (SELECT host, snapshot_no, lag(snapshot_no) OVER w AS prev, lead(snapshot_no) OVER w AS next FROM (SELECT DISTINCT host, snapshot_no FROM sockets) WINDOW w AS (PARTITION BY host ORDER BY snapshot_no)),
    b AS (SELECT r.host, next AS pair, k FROM r JOIN n USING (host, snapshot_no) WHERE next IS NOT NULL), a AS (SELECT r.host, snapshot_no AS pair, k FROM r JOIN n USING (host, snapshot_no) WHERE prev IS NOT NULL)
    SELECT coalesce(b.host, a.host) AS host, 'net' AS section, CASE WHEN b.k IS NULL THEN 'added' ELSE 'removed' END AS change, count(*) AS n FROM b FULL JOIN a ON a.host = b.host AND a.pair = b.pair AND a.k = b.k WHERE b.k IS NULL OR a.k IS NULL GROUP BY ALL"""
)
def bundle_sections(spark, data):
    cols = ["kind", "local_address", "local_port", "remote_address", "remote_port", "state", "inode"]
    rows = table(spark, data, "sockets").select("host", "snapshot_no", F.struct(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in cols]).alias("r"))
    # a document is the report of one snapshot of a host
    documents = rows.groupBy("host", "snapshot_no").agg(F.to_json(F.collect_list("r")).alias("content")).withColumn("name", F.lit("./reports/net_report.json"))
    before, after = (df.withColumn("pair", F.col("pair").cast("bigint")) for df in _neighbours(documents, "host"))
    found = bundle.diff_sections(bundle.section_rows(before, ("host", "pair")), bundle.section_rows(after, ("host", "pair")), keys=("host", "pair"))
    return found.where("change <> 'changed'").groupBy("host", "section", "change").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT bundle, row_number() OVER (PARTITION BY bundle ORDER BY doc_id) AS seq, length(text) AS n FROM (SELECT 'b' || doc_id % 97 AS bundle, doc_id, substring(text, 1, 90) AS text FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL) QUALIFY seq <= 128 AND sum(octet_length(encode(text))) OVER (PARTITION BY bundle ORDER BY doc_id) <= 65536")
def bundle_messages(spark, data):
    d = table(spark, data, "documents").where("doc_id IS NOT NULL AND text IS NOT NULL").select(_text("=b", F.pmod("doc_id", F.lit(97))).alias("bundle"), F.col("doc_id").alias("seq"), F.substring("text", 1, 90).alias("message"))
    kept = bundle.bounded_messages(d)
    return kept.select("bundle", F.row_number().over(Window.partitionBy("bundle").orderBy("seq")).cast("bigint").alias("seq"), F.length("message").cast("bigint").alias("n"))


_TOKEN = "'<REDACTED:sha256:' || substring(sha256({0}), 1, 8) || '>'"


@query(f"SELECT p_partkey, 'password: ' || {_TOKEN.format(chr(39) + 'pw' + chr(39) + ' || p_partkey')} || ' x Bearer ' || {_TOKEN.format(chr(39) + 'abcdefgh' + chr(39) + ' || p_partkey')} || ' y ' || {_TOKEN.format(chr(39) + 'ghp_0123456789abcdef' + chr(39) + ' || p_partkey')} || ' apikey=\"' || {_TOKEN.format('p_brand')} || '\" ' || p_name AS text FROM part")
def redact_secrets(spark, data):
    text = _text("=password: pw", "p_partkey", "= x Bearer abcdefgh", "p_partkey", "= y ghp_0123456789abcdef", "p_partkey", '= apikey="', "p_brand", '=" ', "p_name")
    return table(spark, data, "part").select("p_partkey", redact(text).alias("text"))


@query(
    """SELECT o_orderkey, CASE WHEN f * 100 / t < 5 OR t >= 10737418240 AND f < 1073741824 OR i * 100 / 1000 < 5 THEN 'fail' WHEN f * 100 / t < 15 OR t >= 34359738368 AND f < 5368709120 OR i * 100 / 1000 < 15 THEN 'warn' ELSE 'pass' END AS grade
    FROM (SELECT o_orderkey, CAST(round(o_totalprice) AS BIGINT) * 200000 AS t, CAST(round(o_totalprice) AS BIGINT) * 2000 * (o_custkey % 100) AS f, o_orderkey % 1000 AS i FROM orders)"""
)
def health_volumes(spark, data):
    price = F.round("o_totalprice").cast("bigint")
    return table(spark, data, "orders").select("o_orderkey", health.capacity_grade(price * 200000, price * 2000 * F.pmod("o_custkey", F.lit(100)), F.lit(1000), F.pmod("o_orderkey", F.lit(1000))).alias("grade"))


@query("SELECT '/mnt/a b' || s_suppkey AS mount_point, '/dev/d' || s_nationkey AS device, 'ext4' AS fs_type FROM supplier WHERE s_acctbal >= 0 QUALIFY row_number() OVER (PARTITION BY s_nationkey ORDER BY '/mnt/a b' || s_suppkey) = 1")
def health_mounts(spark, data):
    s = table(spark, data, "supplier")
    lines = s.select(_text("=/dev/d", "s_nationkey", "= /mnt/a\\040b", "s_suppkey", "= ext4 ", F.when(F.col("s_acctbal") < 0, "ro").otherwise("rw,noatime"), "= 0 0").alias("raw")).union(s.select(_text("=proc /proc", "s_suppkey", "= proc rw 0 0")))
    return health.one_per_volume(health.parse_mounts(lines), "device").select("mount_point", "device", "fs_type")


@query("SELECT 'h' || p_partkey AS host, CAST(i AS INT) AS place, CASE i WHEN 0 THEN '' WHEN 1 THEN 'rel' || p_size ELSE '/w' || p_size END AS entry, CASE i WHEN 0 THEN 'current_folder' WHEN 1 THEN 'relative' ELSE 'world_writable' END AS problem FROM part, range(4) r(i) WHERE i < 2 OR i = 3 AND p_size % 2 = 1")
def health_paths(spark, data):
    p = table(spark, data, "part").select(_text("=h", "p_partkey").alias("host"), "p_size")
    paths = p.select("host", _text("=:rel", "p_size", "=:/usr/bin:/w", "p_size").alias("value"))
    folders = p.select("host", _text("=/w", "p_size").alias("path"), F.when(F.col("p_size") % 2 == 1, 0o777).otherwise(0o755).alias("mode")).union(p.select("host", F.lit("/usr/bin"), F.lit(0o755)))
    return health.path_checks(paths, folders)


@query("SELECT 'n' || n_nationkey AS host, CASE WHEN n_regionkey > 2 THEN 'warn' ELSE 'pass' END AS status FROM nation")
def health_preload(spark, data):
    n = table(spark, data, "nation").withColumn("host", _text("=n", "n_nationkey"))
    lines = n.select("host", F.explode(F.array(F.lit("# none"), F.lit(" "), F.when(F.col("n_regionkey") > 2, _text("= /lib/x", "n_nationkey", "=.so")).otherwise(""))).alias("line"))
    return health.preload_checks(lines, n).select("host", "status")


@query(
    """WITH b AS (SELECT 'n' || s_nationkey AS c, s_suppkey % 10 AS n, max(CASE WHEN s_acctbal < 0 THEN 4 WHEN s_acctbal < 5000 THEN 3 ELSE 2 END) AS g FROM supplier GROUP BY 1, 2), a AS (SELECT 'n' || c_nationkey AS c, c_custkey % 12 AS n, max(CASE WHEN c_acctbal < 2000 THEN 3 WHEN c_acctbal < 8000 THEN 2 ELSE 1 END) AS g FROM customer GROUP BY 1, 2)
    SELECT * FROM (SELECT coalesce(b.c, a.c) AS category, CAST(coalesce(b.n, a.n) AS VARCHAR) AS name, CASE WHEN b.g IS NULL THEN 'added' WHEN a.g IS NULL THEN 'removed' WHEN greatest(a.g, 2) > greatest(b.g, 2) THEN 'regressed' WHEN greatest(a.g, 2) < greatest(b.g, 2) THEN 'improved' END AS change FROM b FULL JOIN a ON a.c = b.c AND a.n = b.n) WHERE change IS NOT NULL"""
)
def health_diff(spark, data):
    # several suppliers or customers are one check, graded by the worst of them
    low = lambda p: F.col(f"{p}_acctbal")
    b = table(spark, data, "supplier").select(_text("=n", "s_nationkey").alias("category"), _text(F.pmod("s_suppkey", F.lit(10))).alias("name"), F.when(low("s") < 0, "fail").when(low("s") < 5000, "warn").otherwise("pass").alias("status"))
    a = table(spark, data, "customer").select(_text("=n", "c_nationkey").alias("category"), _text(F.pmod("c_custkey", F.lit(12))).alias("name"), F.when(low("c") < 2000, "warn").when(low("c") < 8000, "pass").otherwise("skip").alias("status"))
    return health.diff_checks(b, a).select("category", "name", "change")


# ---- order of a graph without cycles: every edge goes from an earlier place to a later one ----


@query("SELECT count(*) AS edges, CAST(0 AS BIGINT) AS against FROM (SELECT 's' || s_suppkey AS a, 'n' || s_nationkey AS b FROM supplier UNION SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation)")
def graph_order_holds(spark, data):
    n, s = table(spark, data, "nation"), table(spark, data, "supplier")
    edges = s.select(_text("=s", "s_suppkey").alias("src"), _text("=n", "s_nationkey").alias("dst")).union(n.select(_text("=n", "n_nationkey"), _text("=r", "n_regionkey"))).distinct()
    placed = spark.createDataFrame(list(enumerate(graph.topological(graph.bounded_edges(edges)))), "place int, node string")
    j = edges.join(placed.select(F.col("node").alias("src"), F.col("place").alias("x")), "src").join(placed.select(F.col("node").alias("dst"), F.col("place").alias("y")), "dst")
    return j.agg(F.count(F.lit(1)).alias("edges"), F.count_if(F.col("x") >= F.col("y")).alias("against"))


# ---- markers, requirements, modules ----

_MARKERS = [
    "python_version >= '3.{s}'", "sys_platform == 'win32' and python_version > '3.{s}'", "os_name == 'posix' or extra == 'x'", "'linux' in sys_platform and python_version < '3.{s}'",
    "(sys_platform == 'darwin' or python_full_version == '3.{s}.1') and implementation_name != 'pypy'", "nonsense_variable == '1' or python_version >= '3.{s}'",
]
# the environment is 3.12.1; s is the part's size
_MARKER_SQL = "CASE i WHEN 0 THEN 12 >= s WHEN 1 THEN false WHEN 2 THEN true WHEN 3 THEN 12 < s ELSE s = 12 END"


@query(f"SELECT p_partkey, CAST(i AS INT) AS i FROM (SELECT p_partkey, p_size AS s FROM part), range(5) r(i) WHERE {_MARKER_SQL}")
def env_markers(spark, data):
    """A requirement of a package that no environment has is missing where its marker holds."""
    p = table(spark, data, "part").where("p_partkey IS NOT NULL")
    texts = F.array(*[F.concat(F.lit(f"absent-{i} ; "), F.replace(F.lit(m), F.lit("{s}"), F.col("p_size").cast("string"))) for i, m in enumerate(_MARKERS[:5])])
    packages = p.select(F.lit("e").alias("env"), F.col("p_partkey").cast("string").alias("name"), F.col("p_partkey").cast("string").alias("norm_name"), F.lit("1").alias("version"), texts.alias("requires_dist"))
    states = pyenv.check_dependencies(packages, pyenv.MarkerEnv.for_python("3.12.1")).where("state = 'missing'")
    return states.select(F.col("package").cast("bigint").alias("p_partkey"), F.regexp_extract("requirement", r"\Aabsent-(\d)", 1).cast("int").alias("i"))


@query("SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'a|b' || p_size WHEN 1 THEN 'mod' || p_size || '|pkg' ELSE 'my_pkg_' || p_partkey END AS modules FROM part")
def env_modules(spark, data):
    p = table(spark, data, "part")
    third = F.pmod("p_size", F.lit(3))
    dists = p.select("p_partkey", F.col("p_partkey").cast("string").alias("env"), _text("=My-Pkg.", "p_partkey").alias("name"), F.when(third == 0, _text("=b", "p_size", "=\na\n")).alias("top_level"), F.when(third == 1, _text("=pkg/__init__.py,x,1\nmod", "p_size", "=.py,,\nMy-1.dist-info/RECORD,,\n../bin/x,,\n__pycache__/y.pyc,,\n")).alias("record"))
    return pyenv.top_level_modules(dists).select(F.col("env").cast("bigint").alias("p_partkey"), F.array_join("modules", "|").alias("modules"))


@query("SELECT 'e' || p_partkey % 7 AS env, 'm' || p_size AS module, CASE WHEN p_size <= 10 THEN 'stdlib' ELSE min('dist' || p_size) END AS shadows FROM part WHERE p_size <= 10 OR p_size > 10 AND p_size <= 30 AND p_size <> 20 GROUP BY 1, 2, p_size")
def env_shadowing(spark, data):
    p = table(spark, data, "part").select(_text("=e", F.pmod("p_partkey", F.lit(7))).alias("env"), _text("=m", "p_size").alias("module"), "p_size")
    local = p.select("env", "module")
    stdlib = spark.range(1, 11).select(_text("=m", "id").alias("module"))
    installed = p.select("env").distinct().crossJoin(spark.range(1, 31)).select("env", _text("=m", "id").alias("module"), _text("=dist", "id").alias("name"))  # seven environments
    own = p.select("env").distinct().withColumn("name", F.lit("Dist20"))
    return pyenv.shadowing(local, stdlib, installed, own)


# ---- paths and includes of builds ----


@query("SELECT p_partkey, '/w/' || p_size || '/c.h' AS path FROM part")
def build_paths(spark, data):
    return table(spark, data, "part").select("p_partkey", build.path_normalised(_text("=/w/./x/../", "p_size", "=//y/../../", "p_size", "=/c.h")).alias("path"))


@query("SELECT DISTINCT 's' || p_size || '/u.c' AS src, CASE WHEN p_size % 2 = 0 THEN 's' || p_size || '/h.h' WHEN p_size % 3 = 0 THEN 'inc/h.h' ELSE 'sys/h.h' END AS dst FROM part")
def build_resolved_includes(spark, data):
    """Even sizes have the header beside the source, those that 3 divides in the first folder, all in the last."""
    sizes = table(spark, data, "part").select("p_size").distinct()
    unit = _text("=s", "p_size", "=/u.c")
    includes = sizes.select(unit.alias("unit"), unit.alias("path"), F.lit("h.h").alias("name"), F.lit(True).alias("quoted"))
    search = sizes.select(unit.alias("unit"), F.explode(F.array(F.struct(F.lit(0).alias("place"), F.when(F.pmod("p_size", F.lit(3)) == 0, "inc").otherwise("none").alias("folder")), F.struct(F.lit(1).alias("place"), F.lit("sys").alias("folder")))).alias("x")).select("unit", "x.*")
    files = sizes.where("p_size % 2 = 0").select(_text("=s", "p_size", "=/h.h").alias("path")).union(spark.createDataFrame([("inc/h.h",), ("sys/h.h",)], "path string"))
    return build.resolve_includes(includes, search, files)


@query("SELECT DISTINCT unnest([file] || coalesce(includes, []::VARCHAR[]) || list_transform(coalesce(forced_includes, []::VARCHAR[]), lambda p: CASE WHEN p LIKE '/%' THEN p ELSE directory || '/' || p END)) AS path FROM compile_units")
def build_referenced_paths(spark, data):
    return build.referenced_paths(table(spark, data, "compile_units"))


# ---- order of a report of sockets ----


@query("SELECT host, snapshot_no, inode, row_number() OVER (PARTITION BY host, snapshot_no ORDER BY CASE kind WHEN 'tcp' THEN 1 WHEN 'tcp6' THEN 2 WHEN 'udp' THEN 3 WHEN 'udp6' THEN 4 WHEN 'unix_stream' THEN 5 WHEN 'unix_dgram' THEN 6 ELSE 99 END, local_address, local_port, remote_address, remote_port, unix_path NULLS FIRST, inode) AS place FROM (SELECT DISTINCT host, snapshot_no, kind, local_address, local_port, remote_address, remote_port, unix_path, inode FROM sockets)")
def net_order(spark, data):
    rows = table(spark, data, "sockets").select("host", "snapshot_no", "kind", "local_address", "local_port", "remote_address", "remote_port", "unix_path", "inode").distinct()
    placed = rows.withColumn("place", F.row_number().over(Window.partitionBy("host", "snapshot_no").orderBy(*net.total_order())))  # a report is one snapshot of a host
    return placed.select("host", "snapshot_no", "inode", F.col("place").cast("bigint").alias("place"))


# ---- verdicts: findings of each domain, counted ----


def _counted(found: DataFrame) -> DataFrame:
    return found.groupBy("severity", "code").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT 'warn' AS severity, 'net.orphan' AS code, count(*) AS n FROM sockets WHERE {_STATE_SQL} = 'orphan'")
def net_verdict(spark, data):
    return _counted(verdicts.net(_owned(spark, data)))


@query("SELECT 'info' AS severity, 'disk.duplicates' AS code, count(*) AS n FROM (SELECT text FROM documents WHERE text IS NOT NULL GROUP BY text HAVING count(*) > 1)")
def disk_verdict(spark, data):
    return _counted(verdicts.disk(disk.duplicates(table(spark, data, "documents"), key="doc_id", content="text")))


@query(f"""WITH p AS {_ENV_SQL}, n AS (SELECT b.version FROM (SELECT env, p_partkey + 1 AS partkey FROM p) a LEFT JOIN p b ON b.env = a.env AND b.p_partkey = a.partkey)
    SELECT 'fail' AS severity, 'env.missing' AS code, count(*) FILTER (WHERE version IS NULL) + (SELECT count(*) FROM p) AS n FROM n UNION ALL SELECT 'fail', 'env.conflict', count(*) FILTER (WHERE CAST(substring(version, 3) AS INT) < 25) FROM n""")
def env_verdict(spark, data):
    states = pyenv.check_dependencies(_packages(spark, data), pyenv.MarkerEnv.for_python("3.12.1"))
    return _counted(verdicts.environment(states, spark.createDataFrame([], "module string, shadows string")))


@query("SELECT 'fail' AS severity, 'sys.cycle' AS code, CAST(1 AS BIGINT) AS n UNION ALL SELECT 'warn', 'sys.diagnostic', count(*) FROM supplier")
def unit_verdict(spark, data):
    text = spark.createDataFrame([("x.service", "/x", 0, "[Unit]\nAfter=y.service\n"), ("y.service", "/y", 0, "[Unit]\nAfter=x.service\n")], "unit string, path string, precedence int, content string")
    entries = units.parse_units(_unit_files(spark, data).unionByName(text))
    edges = graph.bounded_edges(units.ordering_edges(units.references(units.effective(entries))))
    cycles = spark.createDataFrame([(c,) for c in graph.components(edges)], "members array<string>")
    return _counted(verdicts.units(cycles, entries))


@query("SELECT g AS severity, 'doctor.c' || r AS code, count(*) AS n FROM (SELECT CASE WHEN s_acctbal < 0 THEN 'fail' ELSE 'warn' END AS g, s_nationkey % 3 AS r FROM supplier WHERE s_acctbal < 5000) GROUP BY 1, 2")
def health_verdict(spark, data):
    s = table(spark, data, "supplier")
    checks = s.select(_text("=c", F.pmod("s_nationkey", F.lit(3))).alias("category"), F.col("s_name").alias("name"), F.when(F.col("s_acctbal") < 0, "fail").when(F.col("s_acctbal") < 5000, "warn").otherwise("pass").alias("status"))
    return _counted(verdicts.health(checks))


@query("SELECT 'fail' AS severity, 'trace.fd_leak' AS code, count(*) AS n FROM supplier")
def trace_verdict(spark, data):
    """A trace for each supplier: four is opened twice and closed once by a number of its own, five is never closed."""
    calls = [("openat", '"/a"', "4"), ("close", "4", "0"), ("openat", '"/b"', "5"), ("dup", "5", "6"), ("close", "6", "0"), ("close", "9", "0")]
    steps = F.array(*[F.struct(F.lit(i).cast("bigint").alias("seq"), F.lit(1).cast("bigint").alias("tid"), F.lit("call").alias("kind"), F.lit(n).alias("syscall"), F.lit(a).alias("arguments"), F.lit(r).alias("result"), F.lit(None).cast("string").alias("error")) for i, (n, a, r) in enumerate(calls)])
    events = table(spark, data, "supplier").select(F.col("s_suppkey").cast("string").alias("trace_id"), F.inline(steps))
    return _counted(verdicts.trace(trace.descriptor_leaks(events)))
