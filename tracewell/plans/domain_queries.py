"""One query per operator family over the driver's tables, each with SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewell.functions.glob import excluded, glob_match
from tracewell.functions.redact import redact
from tracewell.operators import build, bundle, diff, disk, graph, health, junit, logs, net, pyenv, trace, units
from tracewell.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
YEAR = 2024


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


# ---- logs: events rendered as lines and parsed back, so the oracle never sees the parser ----

_LEVEL_SQL = "CASE event_type WHEN 'error' THEN 'error' WHEN 'purchase' THEN 'warn' WHEN 'signup' THEN 'info' WHEN 'click' THEN 'debug' END"


def _lines(spark: SparkSession, data: str) -> DataFrame:
    """Events as log lines: views state no level."""
    e = table(spark, data, "events")
    mark = F.when(F.col("event_type") == "error", "[ERROR] ").when(F.col("event_type") == "purchase", "WARNING ").when(F.col("event_type") == "signup", "level=info ").when(F.col("event_type") == "click", "<DEBUG> ").otherwise("")
    raw = F.concat(F.date_format(F.col("ts").cast("timestamp_ntz"), "yyyy-MM-dd'T'HH:mm:ss.SSS'Z' "), mark, F.lit("app: user "), F.col("user_id").cast("string"), F.lit(" did "), F.col("event_type"))
    return logs.once(e, raw=raw).select(F.lit("events").alias("file"), F.col("event_id").alias("line_no"), "raw")


def _records(spark: SparkSession, data: str, *columns: str) -> DataFrame:
    return logs.parse_records(_lines(spark, data), YEAR, columns=columns)


@query(f"SELECT coalesce({_LEVEL_SQL}, 'unknown') AS level, count(*) AS lines FROM events GROUP BY 1")
def log_level_counts(spark, data):
    return logs.level_counts(_records(spark, data, "level"))


@query(f"SELECT event_id AS line_no, {_LEVEL_SQL} AS level FROM events WHERE event_type IN ('error', 'purchase')")
def log_min_level(spark, data):
    keep = logs.LogFilter(min_level="warn")
    return _records(spark, data, "level").where(keep.condition(from_text=True)).select("line_no", "level")


@query("SELECT event_id AS line_no FROM events WHERE event_type IN ('error', 'purchase', 'view')")
def log_min_level_or_unknown(spark, data):
    return _records(spark, data, "level").where(logs.LogFilter(min_level="warn", include_unknown=True).condition()).select("line_no")


@query("SELECT event_id AS line_no, (epoch_us(ts) // 1000) AS ts_ms FROM events WHERE (epoch_us(ts) // 1000) BETWEEN 1704672000000 AND 1705708799999")
def log_time_window(spark, data):
    return _records(spark, data, "ts_ms").where(logs.LogFilter(since_ms=1704672000000, until_ms=1705708799999).condition()).select("line_no", "ts_ms")


@query(
    f"""WITH b AS (SELECT (max((epoch_us(ts) // 1000)) - min((epoch_us(ts) // 1000))) // 1000 + 1 AS s FROM events),
    w AS (SELECT CASE WHEN s // 60 <= 60 THEN 60 WHEN s // 300 <= 60 THEN 300 WHEN s // 900 <= 60 THEN 900 WHEN s // 3600 <= 60 THEN 3600 ELSE 86400 END AS w FROM b)
    SELECT CAST((epoch_us(ts) // 1000) // 1000 // w * w AS BIGINT) AS bucket_start, count(*) AS total, count(*) FILTER (WHERE {_LEVEL_SQL} IN ('warn', 'error')) AS warn_or_higher FROM events, w GROUP BY 1"""
)
def log_histogram(spark, data):
    return logs.histogram(_records(spark, data, "ts_ms", "level"))


@query("SELECT count(*) AS total, min((epoch_us(ts) // 1000)) AS first_ms, max((epoch_us(ts) // 1000)) AS last_ms, CAST(0 AS BIGINT) AS unknown_ts FROM events")
def log_span(spark, data):
    return logs.span(_records(spark, data, "ts_ms"))


@query("SELECT count(*) FILTER (WHERE event_type = 'view') AS unknown_level, CAST(0 AS BIGINT) AS unknown_timestamp FROM events")
def log_rejected_unknown(spark, data):
    return logs.rejected_by_unknown(_records(spark, data, "ts_ms", "level", "source"), logs.LogFilter(min_level="warn"))


# the same operators over the lines as they were delivered; no SQL reads these


def _given(spark: SparkSession, data: str, *columns: str) -> DataFrame:
    return logs.parse_records(table(spark, data, "log_lines").select("file", "line_no", "raw"), YEAR, columns=columns)


@query()
def log_lines_level_counts(spark, data):
    return logs.level_counts(_given(spark, data, "level"))


@query()
def log_lines_min_level(spark, data):
    return _given(spark, data, "level").where(logs.LogFilter(min_level="warn").condition(from_text=True)).select("file", "line_no", "level")


@query()
def log_lines_time_window(spark, data):
    return _given(spark, data, "ts_ms").where(logs.LogFilter(since_ms=1704672000000, until_ms=1735689599999).condition()).select("file", "line_no", "ts_ms")


@query()
def log_lines_histogram(spark, data):
    return logs.histogram(_given(spark, data, "ts_ms", "level"))


@query()
def log_lines_span(spark, data):
    return logs.span(_given(spark, data, "ts_ms"))


@query()
def log_lines_rejected_unknown(spark, data):
    return logs.rejected_by_unknown(_given(spark, data, "ts_ms", "level", "source"), logs.LogFilter(min_level="warn"))


@query("SELECT doc_id FROM documents WHERE contains(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), 'inode')")
def log_substring(spark, data):
    return table(spark, data, "documents").where(logs.contains_insensitive(F.col("text"), "iNode")).select("doc_id")


@query("SELECT doc_id FROM documents WHERE regexp_matches(text, '[0-9]+[.,][0-9]+ ?%')")
def log_regex(spark, data):
    return table(spark, data, "documents").where(logs.LogFilter(regex="[0-9]+[.,][0-9]+ ?%").text_ok(F.col("text"))).select("doc_id")


@query(
    """SELECT line_no, is_match FROM (SELECT event_id AS line_no, value > 95 AS is_match,
    max(CASE WHEN value > 95 THEN 1 ELSE 0 END) OVER (ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING) AS near FROM events) WHERE near = 1"""
)
def log_context(spark, data):
    e = table(spark, data, "events").select(F.lit("events").alias("file"), F.col("event_id").alias("line_no"), "value")
    return logs.with_context(e, F.col("value") > 95, before=1, after=2).select("line_no", "is_match")


@query("SELECT event_id, (epoch_us(ts) // 1000) AS ts_ms FROM events ORDER BY ts, event_id LIMIT 50 OFFSET 100")
def log_page(spark, data):
    e = table(spark, data, "events").select("event_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("ts_ms"))
    return logs.page(e, ["ts_ms", "event_id"], 100, 50)


@query("SELECT file, count(*) AS total_lines, count(*) FILTER (WHERE lossy) AS lossy_lines FROM log_lines GROUP BY file")
def log_inspect(spark, data):
    return logs.inspect(table(spark, data, "log_lines"))


@query("SELECT file, line_no FROM (SELECT DISTINCT file, line_no FROM log_lines WHERE line_no IS NOT NULL) QUALIFY row_number() OVER (PARTITION BY file ORDER BY line_no DESC) <= 20")
def log_last_lines(spark, data):
    return logs.tail(table(spark, data, "log_lines"), 20).select("file", "line_no").distinct()


@query(
    """WITH l AS (SELECT file, line_no, max(CASE WHEN contains(raw, 'ERROR') THEN 1 ELSE 0 END) = 1 AS is_match FROM log_lines WHERE line_no IS NOT NULL GROUP BY file, line_no)
    SELECT file, line_no, is_match FROM (SELECT *, bool_or(is_match) OVER (PARTITION BY file ORDER BY line_no ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING) AS near FROM l) WHERE near"""
)
def log_context_lines(spark, data):
    found = logs.with_context(table(spark, data, "log_lines").select("file", "line_no", "raw"), F.contains("raw", F.lit("ERROR")), before=1, after=2)
    return found.groupBy("file", "line_no").agg(F.max("is_match").alias("is_match"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_fields(spark, data):
    return table(spark, data, "events").select("event_id", logs.field(logs.json_object(F.col("props")), "K").cast("bigint").alias("k"))


# ---- traces ----


def _calls(spark: SparkSession, data: str) -> DataFrame:
    t = table(spark, data, "trace_events")
    return t.groupBy("trace_id", "seq").agg(*[F.min(c).alias(c) for c in ("tid", "syscall", "arguments", "result", "error", "duration_ns")]).withColumn("kind", F.lit(trace.CALL))


_CALLS_SQL = "(SELECT trace_id, seq, min(tid) AS tid, min(syscall) AS syscall, min(arguments) AS arguments, min(result) AS result, min(error) AS error, min(duration_ns) AS duration_ns FROM trace_events GROUP BY trace_id, seq)"


@query(
    f"""WITH c AS {_CALLS_SQL}, s AS (SELECT syscall, count(*) AS calls, count(error) AS errors, count(duration_ns) AS known_duration, CAST(coalesce(sum(duration_ns), 0) AS BIGINT) AS total_ns, max(duration_ns) AS max_ns,
    list_sort(list(duration_ns) FILTER (WHERE duration_ns IS NOT NULL)) AS l FROM c GROUP BY syscall)
    SELECT syscall, calls, errors, known_duration, total_ns, max_ns, l[(known_duration - 1) * 50 // 100 + 1] AS p50_duration_ns, l[(known_duration - 1) * 95 // 100 + 1] AS p95_duration_ns, l[(known_duration - 1) * 99 // 100 + 1] AS p99_duration_ns FROM s"""
)
def trace_syscall_stats(spark, data):
    return trace.syscall_stats(_calls(spark, data))


@query(f"SELECT syscall || ':' || error AS error_key, count(*) AS occurrences, arg_min(arguments, struct_pack(t := trace_id, s := seq)) AS sample FROM {_CALLS_SQL} WHERE error IS NOT NULL GROUP BY 1")
def trace_error_counts(spark, data):
    return trace.error_counts(_calls(spark, data))


@query(
    f"""SELECT trace_id, CAST(coalesce(sum(greatest(TRY_CAST(result AS BIGINT), 0)) FILTER (WHERE syscall IN ('read', 'pread64', 'recvfrom', 'recvmsg')), 0) AS BIGINT) AS read_bytes,
    CAST(coalesce(sum(greatest(TRY_CAST(result AS BIGINT), 0)) FILTER (WHERE syscall IN ('write', 'pwrite64', 'sendto', 'sendmsg')), 0) AS BIGINT) AS written_bytes FROM {_CALLS_SQL} GROUP BY trace_id"""
)
def trace_io_bytes(spark, data):
    return trace.io_bytes(_calls(spark, data))


@query(
    f"""WITH c AS {_CALLS_SQL}, b AS (SELECT syscall, count(*) AS n, count(error) AS e, count(duration_ns) AS k, CAST(coalesce(sum(duration_ns), 0) AS BIGINT) AS t FROM c WHERE error IS NOT NULL OR seq <= 200 GROUP BY syscall),
    a AS (SELECT syscall, count(*) AS n, count(error) AS e, count(duration_ns) AS k, CAST(coalesce(sum(duration_ns), 0) AS BIGINT) AS t FROM c WHERE NOT (error IS NOT NULL OR seq <= 200) GROUP BY syscall),
    j AS (SELECT coalesce(b.syscall, a.syscall) AS syscall, coalesce(b.n, 0) AS bn, coalesce(a.n, 0) AS an, coalesce(b.e, 0) AS be, coalesce(a.e, 0) AS ae, CASE WHEN b.k > 0 THEN b.t // b.k END AS bm, CASE WHEN a.k > 0 THEN a.t // a.k END AS am FROM b FULL JOIN a ON a.syscall = b.syscall)
    SELECT syscall, bn AS before_calls, an AS after_calls, an - bn AS calls_delta, be AS before_errors, ae AS after_errors, ae - be AS errors_delta,
    CASE WHEN bm >= 1000 AND CAST(floor((am - bm) * 100.0 / bm) AS BIGINT) >= 50 THEN CAST(floor((am - bm) * 100.0 / bm) AS BIGINT) END AS latency_percent FROM j"""
)
def trace_diff(spark, data):
    c = _calls(spark, data)
    first = F.col("error").isNotNull() | (F.col("seq") <= 200)
    return trace.diff_stats(trace.syscall_sums(c.where(first)), trace.syscall_sums(c.where(~first)))


def _halves(spark: SparkSession, data: str) -> DataFrame:
    """Events as a trace: a user is a thread, views begin a call that clicks end, sign-ups end a life."""
    e = table(spark, data, "events")
    kind = F.when(F.col("event_type") == "view", trace.UNFINISHED).when(F.col("event_type") == "click", trace.RESUMED).when(F.col("event_type") == "signup", trace.EXIT).otherwise(trace.CALL)
    none = F.lit(None).cast("string")
    return e.select(F.lit("t").alias("trace_id"), F.col("event_id").alias("seq"), F.col("user_id").alias("tid"), none.alias("ts"), kind.alias("kind"), F.lit("read").alias("syscall"), F.lit("").alias("arguments"), none.alias("result"), none.alias("error"), F.lit(None).cast("bigint").alias("duration_ns"))


@query(
    """WITH m AS (SELECT event_type, lag(event_type) OVER w AS before, lead(event_type) OVER w AS after FROM events WHERE event_type IN ('view', 'click', 'signup') WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
    SELECT 't' AS trace_id, count(*) FILTER (WHERE (event_type = 'view' AND after IS DISTINCT FROM 'click') OR (event_type = 'click' AND before IS DISTINCT FROM 'view')) AS unfinished_calls FROM m"""
)
def trace_pending(spark, data):
    return trace.unfinished(trace.stitch(_halves(spark, data)))


@query(
    """WITH g AS (SELECT user_id AS tid, event_type, coalesce(sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS generation FROM events),
    c AS (SELECT tid, generation, count(*) FILTER (WHERE event_type IN ('purchase', 'error')) AS calls FROM g GROUP BY tid, generation)
    SELECT 't' AS trace_id, tid, CAST(max(generation) AS BIGINT) AS generation, arg_max(calls, generation) AS calls FROM c GROUP BY tid"""
)
def trace_generations(spark, data):
    return trace.generations(_halves(spark, data))


@query()
def trace_fd_leaks(spark, data):
    return trace.descriptor_leaks(_calls(spark, data))


# ---- tests ----


def _cases(spark: SparkSession, data: str) -> DataFrame:
    e = table(spark, data, "events")
    status = F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "purchase", "failed").when(F.col("event_type") == "view", "skipped").otherwise("passed")
    return e.select(F.when(F.col("ts").cast("timestamp_ntz") < F.lit("2024-01-16").cast("timestamp_ntz"), "a").otherwise("b").alias("run_id"), F.lit("").alias("path"), F.col("event_id").alias("seq"), status.alias("status"), F.lit("s").alias("suite"), F.lit("").alias("classname"), F.concat_ws(":", F.col("user_id").cast("string"), F.floor("value").cast("string")).alias("name"), F.lit(0.5).alias("duration_sec"), F.when(F.col("event_type") == "error", F.col("props")).alias("message"), F.lit(True).alias("complete")).withColumn("identity", junit.identity(F.col("suite"), F.col("classname"), F.col("name")))


_STATUS_SQL = "CASE event_type WHEN 'error' THEN 'error' WHEN 'purchase' THEN 'failed' WHEN 'view' THEN 'skipped' ELSE 'passed' END"
_RANK_SQL = "CASE event_type WHEN 'error' THEN 4 WHEN 'purchase' THEN 3 WHEN 'view' THEN 1 ELSE 2 END"
_UNIQUE_SQL = f"(SELECT CASE WHEN ts < TIMESTAMP '2024-01-16' THEN 'a' ELSE 'b' END AS run_id, 's::' || user_id || ':' || CAST(floor(value) AS BIGINT) AS identity, event_id AS seq, {_STATUS_SQL} AS status FROM events QUALIFY row_number() OVER (PARTITION BY ts < TIMESTAMP '2024-01-16', user_id, floor(value) ORDER BY {_RANK_SQL} DESC, event_type <> 'error', event_id) = 1)"


@query(f"SELECT run_id, identity, seq, status FROM {_UNIQUE_SQL}")
def test_unique_cases(spark, data):
    return junit.unique_cases(_cases(spark, data)).select("run_id", "identity", "seq", "status")


@query(
    f"""SELECT CASE WHEN ts < TIMESTAMP '2024-01-16' THEN 'a' ELSE 'b' END AS run_id, count(*) AS total, count(*) FILTER (WHERE {_STATUS_SQL} = 'passed') AS passed, count(*) FILTER (WHERE {_STATUS_SQL} = 'failed') AS failed,
    count(*) FILTER (WHERE {_STATUS_SQL} = 'error') AS errors, count(*) FILTER (WHERE {_STATUS_SQL} = 'skipped') AS skipped, sum(0.5::DOUBLE) AS duration_sec, true AS complete FROM events GROUP BY 1"""
)
def test_summary(spark, data):
    return junit.summary(_cases(spark, data))


@query(
    f"""WITH u AS {_UNIQUE_SQL}, j AS (SELECT coalesce(a.identity, b.identity) AS identity, a.status AS x, b.status AS y FROM (SELECT * FROM u WHERE run_id = 'a') a FULL JOIN (SELECT * FROM u WHERE run_id = 'b') b ON a.identity = b.identity)
    SELECT * FROM (SELECT identity, x AS before_status, y AS after_status, CASE WHEN y IS NULL THEN 'removed' WHEN x IS NULL AND y IN ('failed', 'error') THEN 'new_failure' WHEN x IS NULL THEN NULL WHEN x = y OR (x IN ('failed', 'error') AND y IN ('failed', 'error')) THEN NULL
    WHEN x = 'skipped' OR y = 'skipped' THEN 'skipped_change' WHEN x = 'passed' AND y IN ('failed', 'error') THEN 'regression' WHEN x IN ('failed', 'error') AND y = 'passed' THEN 'fix' END AS change FROM j) WHERE change IS NOT NULL"""
)
def test_run_diff(spark, data):
    u = junit.unique_cases(_cases(spark, data))
    return junit.diff_runs(u.where("run_id = 'a'"), u.where("run_id = 'b'"))


@query(
    f"""SELECT CASE WHEN ts < TIMESTAMP '2024-01-16' THEN 'a' ELSE 'b' END AS run_id, 'demo-' || substring(sha256('demo' || string_agg('s::' || user_id || ':' || CAST(floor(value) AS BIGINT) || chr(CASE {_STATUS_SQL} WHEN 'passed' THEN 0 WHEN 'failed' THEN 1 WHEN 'error' THEN 2 ELSE 3 END), '' ORDER BY event_id)), 1, 12) AS digest_id FROM events GROUP BY 1"""
)
def test_run_digest(spark, data):
    return junit.run_digest(_cases(spark, data), "demo")


# ---- disk ----


def _geo(spark: SparkSession, data: str) -> DataFrame:
    c, n, r = (table(spark, data, t) for t in ("customer", "nation", "region"))
    path = F.concat_ws("/", F.trim("r_name"), F.trim("n_name"), F.col("c_custkey").cast("string"))
    return c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey).select(path.alias("rel_path"), F.round(F.col("c_acctbal") * 100).cast("bigint").alias("size"))


_GEO_SQL = "(SELECT trim(r_name) AS r, trim(n_name) AS n, CAST(c_custkey AS VARCHAR) AS c, CAST(round(c_acctbal * 100) AS BIGINT) AS size FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"
_ROLLUP_SQL = f"""SELECT path, CAST(sum(size) AS BIGINT) AS total_size, count(*) AS entries FROM (SELECT unnest(['', r, r || '/' || n, r || '/' || n || '/' || c]) AS path, size FROM {_GEO_SQL}) GROUP BY path"""


@query(_ROLLUP_SQL)
def disk_rollup(spark, data):
    return disk.rollup(_geo(spark, data), size="size")


@query(f"SELECT * FROM ({_ROLLUP_SQL}) ORDER BY total_size DESC, path LIMIT 10")
def disk_largest(spark, data):
    return disk.largest(disk.rollup(_geo(spark, data), size="size"), 10)


_COPIES_SQL = "SELECT doc_id, CAST(length(text) AS INT) AS size, sha256(text) AS sha256 FROM documents"


@query(f"SELECT size, sha256, min(doc_id) AS first_file, count(*) AS copies, (count(*) - 1) * size AS reclaimable FROM ({_COPIES_SQL}) GROUP BY size, sha256 HAVING count(*) > 1")
def disk_duplicates(spark, data):
    return disk.duplicates(table(spark, data, "documents"), key="doc_id", content="text")


@query(f"SELECT size, sha256, doc_id AS file FROM (SELECT *, count(*) OVER (PARTITION BY size, sha256) AS n FROM ({_COPIES_SQL})) WHERE n > 1")
def disk_duplicate_files(spark, data):
    return disk.duplicate_files(table(spark, data, "documents"), key="doc_id", content="text")


@query("SELECT p_partkey FROM part WHERE regexp_full_match(p_name, '.*r.ng') OR regexp_full_match(p_name, '[a-m].*')")
def disk_glob(spark, data):
    return table(spark, data, "part").where(glob_match(F.col("p_name"), "*r?ng") | glob_match(F.col("p_name"), "[!n-z]*") & glob_match(F.col("p_name"), "[a-m]*")).select("p_partkey")


@query("SELECT name, size FROM bundle_entries WHERE NOT (name = 'manifest.json' OR regexp_full_match(name, 'logs/.*') OR regexp_full_match(regexp_extract(name, '[^/]*$'), 'd.*'))")
def disk_exclude(spark, data):
    b = table(spark, data, "bundle_entries")
    return b.where(~excluded(F.col("name"), F.regexp_extract("name", r"[^/]*\z", 0), ["logs/*", "d*", "manifest.json"]) | F.col("name").isNull()).select("name", "size")


_NEIGHBOURS = "(SELECT * FROM {t} JOIN (SELECT {k}, snapshot_no, lag(snapshot_no) OVER w AS prev, lead(snapshot_no) OVER w AS next FROM (SELECT DISTINCT {k}, snapshot_no FROM {t}) WINDOW w AS (PARTITION BY {k} ORDER BY snapshot_no)) USING ({k}, snapshot_no))"


def _neighbours(df: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Rows before and after, by the number (``pair``) of the later snapshot of each two that follow each other."""
    w = Window.partitionBy(key).orderBy("snapshot_no")  # one row a snapshot
    numbers = df.select(key, "snapshot_no").distinct().withColumn("prev", F.lag("snapshot_no").over(w)).withColumn("next", F.lead("snapshot_no").over(w))
    j = df.join(numbers, [key, "snapshot_no"])
    return j.where("next IS NOT NULL").withColumn("pair", F.col("next")), j.where("prev IS NOT NULL").withColumn("pair", F.col("snapshot_no"))


@query(
    f"""WITH s AS {_NEIGHBOURS.format(k='host', t='bundle_entries')}, b AS (SELECT host || '/' || next || '/' || name AS rel_path, max(size) AS size FROM s WHERE next IS NOT NULL GROUP BY 1), a AS (SELECT host || '/' || snapshot_no || '/' || name AS rel_path, max(size) AS size FROM s WHERE prev IS NOT NULL GROUP BY 1)
    SELECT * FROM (SELECT coalesce(b.rel_path, a.rel_path) AS rel_path, b.size AS before_size, a.size AS after_size, CASE WHEN b.size IS NULL THEN 'added' WHEN a.size IS NULL THEN 'removed' WHEN a.size > b.size THEN 'grown' WHEN a.size < b.size THEN 'shrunk' END AS change FROM b FULL JOIN a ON a.rel_path = b.rel_path) WHERE change IS NOT NULL"""
)
def disk_snapshot_diff(spark, data):
    b, a = _neighbours(table(spark, data, "bundle_entries"), "host")
    sizes = lambda df: df.groupBy(F.concat_ws("/", "host", "pair", "name").alias("rel_path")).agg(F.max("size").alias("size"))
    return disk.diff_snapshots(sizes(b), sizes(a))


# ---- sockets ----

_LISTEN_SQL = "((state = 'LISTEN' AND kind NOT LIKE 'unix%') OR (kind IN ('udp', 'udp6') AND (remote_port = 0 OR remote_address IN ('0.0.0.0', '::', '*')) AND local_port <> 0))"


@query(
    f"""SELECT host, snapshot_no, count(*) AS total, count(*) FILTER (WHERE {_LISTEN_SQL}) AS listeners, count(*) FILTER (WHERE kind IN ('tcp', 'tcp6') AND state = 'ESTABLISHED') AS established, count(*) FILTER (WHERE state = 'TIME_WAIT') AS time_wait,
    CAST(0 AS BIGINT) AS orphans, CAST(0 AS BIGINT) AS owner_unknown, count(*) FILTER (WHERE kind LIKE 'unix%') AS unix_sockets FROM sockets GROUP BY host, snapshot_no"""
)
def net_summary(spark, data):
    return net.summary(table(spark, data, "sockets"), ("host", "snapshot_no"))


@query(
    f"""WITH s AS {_NEIGHBOURS.format(k='host', t='sockets')}, r AS (SELECT 'listener' AS what, 0 AS side, next AS pair, host, kind, local_address, local_port, '' AS remote_address, 0 AS remote_port FROM s WHERE {_LISTEN_SQL} AND next IS NOT NULL
    UNION ALL SELECT 'listener', 1, snapshot_no, host, kind, local_address, local_port, '', 0 FROM s WHERE {_LISTEN_SQL} AND prev IS NOT NULL
    UNION ALL SELECT 'connection', 0, next, host, kind, local_address, local_port, remote_address, remote_port FROM s WHERE state = 'ESTABLISHED' AND next IS NOT NULL
    UNION ALL SELECT 'connection', 1, snapshot_no, host, kind, local_address, local_port, remote_address, remote_port FROM s WHERE state = 'ESTABLISHED' AND prev IS NOT NULL),
    k AS (SELECT *, min(side) OVER w AS first, max(side) OVER w AS last FROM r WINDOW w AS (PARTITION BY what, pair, host, kind, local_address, local_port, remote_address, remote_port))
    SELECT CASE WHEN side = 1 THEN 'new_' ELSE 'closed_' END || what AS change, host, pair, kind, local_address, local_port, remote_address, remote_port FROM k WHERE first = last"""
)
def net_diff(spark, data):
    b, a = _neighbours(table(spark, data, "sockets"), "host")
    return net.diff_reports(b, a, ("host", "pair"))


@query(f"SELECT host, snapshot_no, local_address, local_port FROM sockets WHERE {_LISTEN_SQL} AND local_address IN ('0.0.0.0', '::', '*') AND local_port % 50 = 0")
def net_exposed(spark, data):
    # ports that 50 divides stand for a sensitive one, the others are kept
    moved = table(spark, data, "sockets").withColumn("kept", F.col("local_port")).withColumn("local_port", F.when(F.col("local_port") % 50 == 0, 6379).when(F.col("local_port").isin(net.SENSITIVE_PORTS), 1).otherwise(F.col("local_port")))
    return net.exposed(moved).select("host", "snapshot_no", "local_address", F.col("kept").alias("local_port"))


@query(
    """SELECT o_orderkey, c_custkey AS pid, CASE WHEN c_custkey IS NULL AND o_orderkey <> 0 THEN CASE WHEN o_custkey % 3 = 0 THEN 'owner_unknown' ELSE 'orphan' END END AS owner_state
    FROM orders LEFT JOIN customer ON o_orderkey = c_custkey AND o_orderkey <> 0"""
)
def net_owner_join(spark, data):
    owners = table(spark, data, "customer").select(F.col("c_custkey").alias("inode"), F.col("c_custkey").alias("pid"), F.lit(1).alias("fd"), F.col("c_name").alias("comm"))
    sockets = table(spark, data, "orders").select("o_orderkey", F.col("o_orderkey").alias("inode"), F.when(F.col("o_custkey") % 3 == 0, 7).otherwise(8).alias("uid"))
    return net.with_owners(sockets, owners, [7]).select("o_orderkey", "pid", "owner_state")


# ---- keyed diffs, sets, verdicts ----


@query(
    """WITH b AS (SELECT user_id, event_type, count(*) AS n FROM events WHERE ts < TIMESTAMP '2024-01-16' GROUP BY ALL), a AS (SELECT user_id, event_type, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-16' GROUP BY ALL)
    SELECT coalesce(b.user_id, a.user_id) AS user_id, coalesce(b.event_type, a.event_type) AS event_type, b.n AS before_n, a.n AS after_n, CASE WHEN b.n IS NULL THEN 'added' WHEN a.n IS NULL THEN 'removed' WHEN a.n = b.n THEN 'same' ELSE 'changed' END AS change
    FROM b FULL JOIN a ON a.user_id = b.user_id AND a.event_type = b.event_type"""
)
def diff_keyed(spark, data):
    e = table(spark, data, "events")
    half = lambda cond: e.where(cond).groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    cut = F.lit("2024-01-16").cast("timestamp_ntz")
    return diff.diff(half(F.col("ts").cast("timestamp_ntz") < cut), half(F.col("ts").cast("timestamp_ntz") >= cut), ["user_id", "event_type"], ["n"])


@query("WITH s AS (SELECT DISTINCT s_nationkey * 1000 + CAST(floor(s_acctbal / 100) AS INT) AS v FROM supplier), c AS (SELECT DISTINCT c_nationkey * 1000 + CAST(floor(c_acctbal / 100) AS INT) AS v FROM customer) SELECT v, 'removed' AS change FROM s WHERE v NOT IN (SELECT v FROM c) UNION ALL SELECT v, 'added' FROM c WHERE v NOT IN (SELECT v FROM s)")
def diff_sets(spark, data):
    value = lambda t, p: table(spark, data, t).select((F.col(f"{p}_nationkey") * 1000 + F.floor(F.col(f"{p}_acctbal") / 100).cast("int")).alias("v"))
    return diff.set_diff(value("supplier", "s"), value("customer", "c"))


@query("SELECT s_nationkey, CASE max(CASE WHEN s_acctbal < 0 THEN 3 WHEN s_acctbal < 5000 THEN 2 ELSE 1 END) WHEN 3 THEN 'incompatible' WHEN 2 THEN 'uncertain' ELSE 'compatible' END AS verdict FROM supplier GROUP BY s_nationkey")
def diff_worst_verdict(spark, data):
    v = F.when(F.col("s_acctbal") < 0, "incompatible").when(F.col("s_acctbal") < 5000, "uncertain").otherwise("compatible")
    return table(spark, data, "supplier").groupBy("s_nationkey").agg(diff.worst(v).alias("verdict"))


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM part WHERE p_partkey = l_partkey AND p_size > 25)")
def diff_missing_references(spark, data):
    known = table(spark, data, "part").where("p_size > 25").select(F.col("p_partkey").alias("l_partkey"))
    return diff.only_in(table(spark, data, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), known, ["l_partkey"])


# ---- graphs ----

_EDGES_SQL = "(SELECT 'n' || n_nationkey AS src, 'r' || n_regionkey AS dst FROM nation UNION SELECT 'r' || n_regionkey, 'n' || min(n_nationkey) FROM nation GROUP BY n_regionkey UNION SELECT 's' || s_suppkey, 'n' || s_nationkey FROM supplier)"


def _edges(spark: SparkSession, data: str) -> DataFrame:
    n, s = table(spark, data, "nation"), table(spark, data, "supplier")
    name = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    a = n.select(name("n", "n_nationkey").alias("src"), name("r", "n_regionkey").alias("dst"))
    b = n.groupBy("n_regionkey").agg(F.min("n_nationkey").alias("m")).select(name("r", "n_regionkey").alias("src"), name("n", "m").alias("dst"))
    return a.unionByName(b).unionByName(s.select(name("s", "s_suppkey").alias("src"), name("n", "s_nationkey").alias("dst"))).distinct()


@query(f"WITH RECURSIVE e AS {_EDGES_SQL}, c(origin, node) AS (SELECT src, dst FROM e UNION SELECT c.origin, e.dst FROM c JOIN e ON c.node = e.src) SELECT origin, node FROM c")
def graph_closure(spark, data):
    return graph.closure(_edges(spark, data))


@query(f"WITH RECURSIVE e AS {_EDGES_SQL}, c(origin, node) AS (SELECT dst, src FROM e UNION SELECT c.origin, e.src FROM c JOIN e ON c.node = e.dst) SELECT origin, node FROM c")
def graph_impact_all(spark, data):
    return build.impact(_edges(spark, data))


@query(f"WITH RECURSIVE e AS {_EDGES_SQL}, c(origin, node) AS (SELECT src, dst FROM e UNION SELECT c.origin, e.dst FROM c JOIN e ON c.node = e.src) SELECT min(a.node) AS component, a.origin AS node FROM c a JOIN c b ON a.origin = b.node AND a.node = b.origin GROUP BY a.origin")
def graph_cycles(spark, data):
    return graph.mutual(_edges(spark, data))


# ---- units, builds, environments, bundles, health ----


def _assignments(spark: SparkSession, data: str) -> DataFrame:
    e = table(spark, data, "events")
    return e.select(F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit(".service")).alias("unit"), F.lit("Service").alias("section"), F.lit("ExecStart").alias("key"), F.when(F.col("event_type") == "signup", "").otherwise(F.col("event_type")).alias("value"), F.col("event_id").alias("seq"))


@query(
    """SELECT 'u' || user_id || '.service' AS unit, event_id AS seq, event_type AS value FROM (SELECT *, max(CASE WHEN event_type = 'signup' THEN event_id END) OVER (PARTITION BY user_id) AS r FROM events) WHERE event_type <> 'signup' AND (r IS NULL OR event_id > r)"""
)
def unit_effective(spark, data):
    return units.effective(_assignments(spark, data)).select("unit", "seq", "value")


@query("SELECT 'u' || user_id AS unit, event_id AS path FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY CASE event_type WHEN 'error' THEN 0 WHEN 'purchase' THEN 1 ELSE 2 END, event_id) = 1")
def unit_providers(spark, data):
    p = F.when(F.col("event_type") == "error", 0).when(F.col("event_type") == "purchase", 1).otherwise(2)
    files = table(spark, data, "events").select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("unit"), F.col("event_id").alias("path"), p.alias("precedence"))
    return units.pick_providers(files).select("unit", "path")


_L = "coalesce({p}.{c}, []::VARCHAR[])"


def _build_sql() -> str:
    side = lambda n, has: f"(SELECT project || '/' || {n} || '/' || file AS file, min(compiler) AS compiler, min(standard) AS standard, any_value(includes) AS includes, any_value(defines) AS defines, any_value(flags) AS flags, any_value(forced_includes) AS forced_includes FROM s WHERE {has} IS NOT NULL GROUP BY 1)"
    gone = lambda c, x, y: f"list_sort(list_distinct(list_filter({_L.format(p=x, c=c)}, lambda z: NOT list_contains({_L.format(p=y, c=c)}, z))))"
    extra = lambda x: f"(CASE WHEN b.file IS NOT NULL AND a.file IS NOT NULL AND b.standard IS DISTINCT FROM a.standard AND {x}.standard IS NOT NULL THEN ['-std=' || {x}.standard] ELSE []::VARCHAR[] END || CASE WHEN b.file IS NOT NULL AND a.file IS NOT NULL AND b.compiler IS DISTINCT FROM a.compiler AND {x}.compiler IS NOT NULL THEN ['compiler=' || {x}.compiler] ELSE []::VARCHAR[] END)"
    flags = lambda x, y: f"list_sort(list_distinct(list_filter({_L.format(p=x, c='flags')} || {extra(x)}, lambda z: NOT list_contains({_L.format(p=y, c='flags')} || {extra(y)}, z))))"
    return f"""WITH s AS {_NEIGHBOURS.format(k='project', t='compile_units')}, b AS {side('next', 'next')}, a AS {side('snapshot_no', 'prev')},
    j AS (SELECT coalesce(b.file, a.file) AS file, CASE WHEN b.file IS NULL THEN 'added' WHEN a.file IS NULL THEN 'removed' ELSE 'modified' END AS change, {gone('includes', 'a', 'b')} AS added_includes, {gone('includes', 'b', 'a')} AS removed_includes, {gone('defines', 'a', 'b')} AS added_defines, {gone('defines', 'b', 'a')} AS removed_defines,
    {flags('a', 'b')} AS added_flags, {flags('b', 'a')} AS removed_flags, {_L.format(p='a', c='forced_includes')} <> {_L.format(p='b', c='forced_includes')} AS forced_includes_changed FROM b FULL JOIN a ON a.file = b.file)
    SELECT file, change, array_to_string(added_includes, ',') AS added_includes, array_to_string(removed_includes, ',') AS removed_includes, array_to_string(added_defines, ',') AS added_defines, array_to_string(removed_defines, ',') AS removed_defines, array_to_string(added_flags, ',') AS added_flags, array_to_string(removed_flags, ',') AS removed_flags, forced_includes_changed FROM j
    WHERE change <> 'modified' OR forced_includes_changed OR len(added_includes) + len(removed_includes) + len(added_defines) + len(removed_defines) + len(added_flags) + len(removed_flags) > 0"""


@query(_build_sql())
def build_diff(spark, data):
    b, a = (df.withColumn("file", F.concat_ws("/", "project", "pair", "file")) for df in _neighbours(table(spark, data, "compile_units"), "project"))
    out = build.diff_units(b, a)
    return out.select("file", "change", *[F.array_join(c, ",").alias(c) for c in out.columns if c.startswith(("added_", "removed_"))], "forced_includes_changed")


@query()
def build_parse_commands(spark, data):
    from tracewell.operators.feed_parse import usable_commands

    return build.parse_commands(usable_commands(table(spark, data, "feed_rows")))


@query("SELECT p_partkey, (p_size >= 10 AND (p_size < 30 OR (p_size = 30 AND length(p_name) < 12))) AS met FROM part")
def env_version_match(spark, data):
    version = F.concat_ws(".", F.col("p_size").cast("string"), F.length("p_name").cast("string"))
    return table(spark, data, "part").select("p_partkey", pyenv.satisfies(version, F.lit(">=10,<30.12")).alias("met"))


@query(
    f"""WITH s AS {_NEIGHBOURS.format(k='host', t='bundle_entries')}, b AS (SELECT host || '/' || next || '/' || name AS name, min(lower(sha256)) AS h FROM s WHERE next IS NOT NULL GROUP BY 1), a AS (SELECT host || '/' || snapshot_no || '/' || name AS name, min(lower(sha256)) AS h FROM s WHERE prev IS NOT NULL GROUP BY 1)
    SELECT * FROM (SELECT coalesce(b.name, a.name) AS name, CASE WHEN b.h IS NULL THEN 'only_in_candidate' WHEN a.h IS NULL THEN 'only_in_baseline' WHEN a.h <> b.h THEN 'changed' END AS change FROM b FULL JOIN a ON a.name = b.name) WHERE change IS NOT NULL"""
)
def bundle_diff(spark, data):
    b, a = (df.withColumn("name", F.concat_ws("/", "host", "pair", "name")) for df in _neighbours(table(spark, data, "bundle_entries"), "host"))
    return bundle.diff_names(b, a)


@query(
    """WITH m AS (SELECT DISTINCT project AS bundle, sha256(text) AS name, length(text) AS size, sha256(CASE WHEN length(text) > 2000 THEN upper(lang) || text ELSE text END) AS sha256 FROM documents WHERE length(text) <> 800 AND project IS NOT NULL AND (length(text) <= 2000 OR lang IS NOT NULL)),
    e AS (SELECT project AS bundle, sha256(text) AS name, count(*) AS n, sha256(any_value(text)) AS h, length(any_value(text)) AS size FROM documents WHERE length(text) <> 700 AND project IS NOT NULL GROUP BY 1, 2), u AS (SELECT bundle, name, min(size) AS size, min(sha256) AS sha256 FROM m GROUP BY 1, 2)
    SELECT coalesce(e.bundle, u.bundle) AS bundle, coalesce(e.name, u.name) AS name, CASE WHEN u.name IS NULL THEN 'unexpected' WHEN e.name IS NULL THEN 'missing' WHEN e.n > 1 THEN 'duplicate' WHEN e.size = u.size AND e.h = u.sha256 THEN 'ok' ELSE 'tampered' END AS verdict FROM e FULL JOIN u ON e.bundle = u.bundle AND e.name = u.name"""
)
def bundle_verify(spark, data):
    d = table(spark, data, "documents").where("project IS NOT NULL").select(F.col("project").alias("bundle"), F.sha2("text", 256).alias("name"), F.length("text").alias("size"), F.col("text"), "lang")
    entries = d.where("size <> 700").withColumn("sha256", F.sha2("text", 256))
    said = d.where("size <> 800 AND (size <= 2000 OR lang IS NOT NULL)").withColumn("sha256", F.sha2(F.when(F.col("size") > 2000, F.concat(F.upper("lang"), "text")).otherwise(F.col("text")), 256))
    manifest = said.groupBy("bundle", "name").agg(F.min("size").alias("size"), F.min("sha256").alias("sha256"))
    return bundle.verify_rows(entries, manifest)


@query()
def redact_documents(spark, data):
    d = table(spark, data, "documents")
    secret = F.concat(F.col("text"), F.lit("\npassword = hunter"), F.col("doc_id").cast("string"), F.lit("\nAuthorization: Bearer abcdefgh"), F.col("doc_id").cast("string"))
    return d.select("doc_id", redact(secret).alias("text"))


@query(
    """SELECT s_suppkey, CASE WHEN p < 5 THEN 'fail' WHEN p < 15 THEN 'warn' ELSE 'pass' END AS grade FROM (SELECT s_suppkey, greatest(s_acctbal, 0) * 100 / 10000 AS p FROM supplier)"""
)
def health_capacity(spark, data):
    return table(spark, data, "supplier").select("s_suppkey", health.capacity_grade(F.lit(10000.0), F.greatest(F.col("s_acctbal"), F.lit(0.0))).alias("grade"))


@query(
    """SELECT s_nationkey, count(*) FILTER (WHERE g = 1) AS skip_count, count(*) FILTER (WHERE g = 2) AS pass_count, count(*) FILTER (WHERE g = 3) AS warn_count, count(*) FILTER (WHERE g = 4) AS fail_count, ['skip', 'pass', 'warn', 'fail'][max(g)] AS overall
    FROM (SELECT s_nationkey, CASE WHEN s_acctbal < 0 THEN 4 WHEN s_acctbal < 1000 THEN 3 WHEN s_acctbal < 9000 THEN 2 ELSE 1 END AS g FROM supplier) GROUP BY s_nationkey"""
)
def health_overall(spark, data):
    status = F.when(F.col("s_acctbal") < 0, "fail").when(F.col("s_acctbal") < 1000, "warn").when(F.col("s_acctbal") < 9000, "pass").otherwise("skip")
    return health.overall(table(spark, data, "supplier").withColumn("status", status), ("s_nationkey",))
