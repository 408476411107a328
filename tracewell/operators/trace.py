"""The system-call domain: parsing tracer lines, pending calls, aggregates, processes, descriptors, comparison."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.errors import InvalidInput
from tracewell.report import bounded

CALL, UNFINISHED, RESUMED, SIGNAL, EXIT, OTHER = "call", "unfinished", "resumed", "signal", "exit", "other"
# Calls that read, write, open and share descriptors.
READS, WRITES = ["read", "pread64", "recvfrom", "recvmsg"], ["write", "pwrite64", "sendto", "sendmsg"]
OPENERS = ["open", "openat", "openat2", "creat", "socket", "accept", "accept4", "epoll_create", "epoll_create1", "eventfd", "eventfd2", "timerfd_create", "signalfd", "signalfd4", "inotify_init", "inotify_init1", "memfd_create", "pidfd_open"]
FORKS = ["fork", "vfork", "clone", "clone3"]
TABLE_CALLS = [*OPENERS, *FORKS, "pipe", "pipe2", "socketpair", "dup", "dup2", "dup3", "fcntl", "close", "close_range", "execve", "execveat"]
LEAST_SHIFT_NS, LEAST_SHIFT_PERCENT = 1000, 50

_HEAD = re.compile(r"\s*(?:\[pid\s+(\d+)\]\s+|(\d+)\s+)?(?:([\d:.]+)\s+)?(.*)", re.S)
_NAME = re.compile(r"([A-Za-z0-9_]+)\(")
_RESUMED = re.compile(r"<\.\.\.\s+([A-Za-z0-9_]+)\s+resumed>\s?,?\s?(.*)", re.S)
_SECONDS = re.compile(r"\s*<(\d+(?:\.\d+)?)>\s*\Z")
_RETURN = re.compile(r"(0x[0-9a-fA-F]+|-?\d+|\?)(?:<[^>]*>)?(?:\s+([A-Z][A-Z0-9_]+))?")


def closing_paren(text: str, start: int) -> int:
    """Where the bracket opened at ``start`` closes, quotes and escapes aside; -1 where it never does."""
    depth, i, quoted = 0, start, False
    while i < len(text):
        c = text[i]
        if quoted:
            if c == "\\":
                i += 1
            elif c == '"':
                quoted = False
        elif c == '"':
            quoted = True
        elif c in "([{":
            depth += 1
        elif c in ")]}":
            depth -= 1
            if depth == 0:
                return i
        i += 1
    return -1


def parse_result(text: str) -> tuple[str, str | None, int | None]:
    """(result, error, duration in ns) of what follows ``=``."""
    duration = None
    if m := _SECONDS.search(text):
        seconds, _, rest = m[1].partition(".")
        duration = int(seconds) * 1_000_000_000 + int(rest.ljust(9, "0")[:9])
        text = text[: m.start()]
    m = _RETURN.match(text.strip())
    if not m:
        return text.strip(), None, duration
    error = m[2]
    if m[1] == "-1" and not error:
        error = "UNKNOWN_ERROR"
    if m[1] not in ("-1", "?"):
        error = None
    return m[1], error, duration


def parse_line(raw: str) -> dict:
    """One tracer line: its kind and parts; kind ``other`` for a line that is none."""
    m = _HEAD.match(raw or "")
    out = {"tid": int(m[1] or m[2]) if m[1] or m[2] else None, "ts": m[3], "kind": OTHER, "syscall": None, "arguments": None, "result": None, "error": None, "duration_ns": None}
    body = m[4].strip()
    if body.startswith("+++"):
        return out | {"kind": EXIT, "arguments": body.strip("+ ")}
    if body.startswith("---"):
        return out | {"kind": SIGNAL, "arguments": body.strip("- ")}
    if r := _RESUMED.match(body):
        tail = r[2]
        cut = tail.rfind(") =")
        cut = cut if cut >= 0 else tail.rfind(")")
        if cut < 0 or "=" not in tail[cut:]:
            return out
        result, error, ns = parse_result(tail[cut:].split("=", 1)[1])
        return out | {"kind": RESUMED, "syscall": r[1], "arguments": tail[:cut].strip(), "result": result, "error": error, "duration_ns": ns}
    n = _NAME.match(body)
    if not n:
        return out
    if body.endswith("<unfinished ...>"):
        return out | {"kind": UNFINISHED, "syscall": n[1], "arguments": body[n.end() : -len("<unfinished ...>")].rstrip(" ,")}
    close = closing_paren(body, n.end() - 1)
    if close < 0 or not body[close + 1 :].lstrip().startswith("="):
        return out
    result, error, ns = parse_result(body[close + 1 :].lstrip()[1:])
    return out | {"kind": CALL, "syscall": n[1], "arguments": body[n.end() : close], "result": result, "error": error, "duration_ns": ns}


_PARSED = "trace_id string, seq bigint, tid bigint, ts string, kind string, syscall string, arguments string, result string, error string, duration_ns bigint"


def parse_lines(lines: DataFrame) -> DataFrame:
    """Tracer lines (trace_id, seq, raw) as events; lines that are none keep kind ``other`` and are counted, not lost."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parsed = [parse_line(r) for r in b.column(2).to_pylist()]
            columns = [b.column(0), b.column(1)] + [pa.array([p[k] for p in parsed], t) for k, t in (("tid", pa.int64()), ("ts", pa.string()), ("kind", pa.string()), ("syscall", pa.string()), ("arguments", pa.string()), ("result", pa.string()), ("error", pa.string()), ("duration_ns", pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["trace_id", "seq", "tid", "ts", "kind", "syscall", "arguments", "result", "error", "duration_ns"])

    return lines.select("trace_id", F.col("seq").cast("bigint").alias("seq"), "raw").mapInArrow(over, _PARSED)


def require_trace(events: DataFrame) -> DataFrame:
    """The events, unless none is recognised or most are not: then the input is no trace."""
    n = events.agg(F.count_if(F.col("kind") != OTHER).alias("good"), F.count_if(F.col("kind") == OTHER).alias("bad")).first()
    if n["good"] == 0 or n["bad"] > n["good"]:
        raise InvalidInput(f"not a system-call trace: {n['good']} of {n['good'] + n['bad']} lines recognised")
    return events


def stitch(events: DataFrame) -> DataFrame:
    """Events with unfinished and resumed halves made one call, at the place of the second half; halves without a
    partner keep their kind. A partner is the thread's last unfinished call, if its name is the same."""
    w = Window.partitionBy("trace_id", "tid").orderBy("seq")
    half = F.col("kind").isin(UNFINISHED, RESUMED, EXIT)
    marks = events.where(half)
    before = F.lag(F.struct("kind", "syscall", "arguments", "seq")).over(w)
    after = F.lead(F.struct("kind", "syscall")).over(w)
    paired = marks.withColumn("__b", before).withColumn("__a", after)
    fits = (F.col("kind") == RESUMED) & (F.col("__b.kind") == UNFINISHED) & (F.col("__b.syscall") == F.col("syscall"))
    taken = (F.col("kind") == UNFINISHED) & (F.col("__a.kind") == RESUMED) & (F.col("__a.syscall") == F.col("syscall"))
    whole = paired.where(~F.coalesce(taken, F.lit(False))).withColumn("arguments", F.when(fits, F.concat_ws(", ", F.nullif(F.col("__b.arguments"), F.lit("")), F.nullif(F.col("arguments"), F.lit("")))).otherwise(F.col("arguments"))).withColumn("kind", F.when(fits, CALL).otherwise(F.col("kind")))
    return events.where(~half).unionByName(whole.drop("__a", "__b"))


def unfinished(stitched: DataFrame) -> DataFrame:
    """(trace_id, unfinished_calls): halves without a partner."""
    return stitched.groupBy("trace_id").agg(F.count_if(F.col("kind").isin(UNFINISHED, RESUMED)).alias("unfinished_calls"))


def _bin(value: Column) -> Column:
    """A number for a whole number that grows with it: its length in bits and its first ten bits after the highest."""
    size = F.length(F.bin(F.abs(value)))
    head = F.call_function("shiftright", F.abs(value), F.greatest(size - 11, F.lit(0)))
    return F.when(value < 0, -(size * 4096 + head)).otherwise(size * 4096 + head).cast("int")


def lower_percentiles(df: DataFrame, keys: list[str], value: str, ps: list[int]) -> DataFrame:
    """keys and p{p}_{value}: the value at place floor((n-1) p / 100) of each group's sorted whole numbers; exact, never
    interpolated. Null values do not count.

    No group is ever in one task: values are counted in at most 2**18 bins a group, before the shuffle; the bin of each
    place is found from these counts, and only values of such bins, each bin apart, are ranked themselves.
    """
    known = df.where(F.col(value).isNotNull()).select(*keys, F.col(value).alias("__v"), _bin(F.col(value)).alias("__bin"))
    group = F.struct(*keys) if keys else F.struct(F.lit(0))
    counted = known.withColumn("__g", group).groupBy("__g", "__bin").agg(F.count(F.lit(1)).alias("__n"))
    w = Window.partitionBy("__g")
    run = counted.withColumn("__upto", F.sum("__n").over(w.orderBy("__bin"))).withColumn("__all", F.sum("__n").over(w))
    places = F.array(*[F.struct(F.lit(p).alias("p"), F.floor((F.col("__all") - 1) * p / 100).alias("at")) for p in ps])
    wanted = run.select("__g", "__bin", (F.col("__upto") - F.col("__n")).alias("__below"), F.explode(F.filter(places, lambda x: (x["at"] < F.col("__upto")) & (x["at"] >= F.col("__upto") - F.col("__n")))).alias("__p"))
    bins = wanted.select(F.col("__g").alias("__wg"), F.col("__bin").alias("__wb"))
    here = F.col("__g").eqNullSafe(F.col("__wg")) & (F.col("__bin") == F.col("__wb"))
    within = known.withColumn("__g", group).join(bins, here, "left_semi").groupBy("__g", "__bin", "__v").agg(F.count(F.lit(1)).alias("__n"))
    ranked = within.withColumn("__upto", F.sum("__n").over(Window.partitionBy("__g", "__bin").orderBy("__v")))
    found = ranked.join(wanted.select(F.col("__g").alias("__wg"), F.col("__bin").alias("__wb"), "__below", "__p"), here).where(F.col("__below") + F.col("__upto") > F.col("__p.at"))
    return found.groupBy("__g").agg(*[F.min(F.when(F.col("__p.p") == p, F.col("__v"))).alias(f"p{p}_{value}") for p in ps]).select(*[F.col(f"__g.{k}").alias(k) for k in keys], *[f"p{p}_{value}" for p in ps])


def syscall_sums(calls: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Per syscall: calls, errors, known durations, total and longest; all that a comparison needs."""
    return calls.groupBy(*keys, "syscall").agg(
        F.count(F.lit(1)).alias("calls"), F.count("error").alias("errors"), F.count("duration_ns").alias("known_duration"),
        F.coalesce(F.sum("duration_ns"), F.lit(0)).alias("total_ns"), F.max("duration_ns").alias("max_ns"),
    )


def syscall_stats(calls: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """:func:`syscall_sums` with the lower 50th, 95th and 99th percentile of durations."""
    by = [*keys, "syscall"]
    sums = syscall_sums(calls, keys)
    at = lower_percentiles(calls, by, "duration_ns", [50, 95, 99]).withColumnsRenamed({k: f"__{k}" for k in by})
    same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in by]
    return sums.join(at, same, "left").drop(*[f"__{k}" for k in by])


def error_counts(calls: DataFrame) -> DataFrame:
    """(error_key, occurrences, sample): errors by call, with the arguments of the first."""
    return calls.where("error IS NOT NULL").groupBy(F.concat_ws(":", "syscall", "error").alias("error_key")).agg(F.count(F.lit(1)).alias("occurrences"), F.min_by("arguments", F.struct("trace_id", "seq")).alias("sample"))


def generations(events: DataFrame) -> DataFrame:
    """(trace_id, tid, generation, calls): calls of each thread id's last life; a new one begins after an exit.

    The last life begins after the last exit, or after the one before where an exit is the thread's last event; exits are
    few, so only they are ranked, and calls are counted by partial sums."""
    same = lambda p: F.col("trace_id").eqNullSafe(F.col(f"{p}_trace")) & F.col("tid").eqNullSafe(F.col(f"{p}_tid"))
    w = Window.partitionBy("trace_id", "tid").orderBy(F.desc("seq"))
    exits = events.where(F.col("kind") == EXIT).select("trace_id", "tid", "seq").withColumn("n", F.row_number().over(w)).groupBy(F.col("trace_id").alias("x_trace"), F.col("tid").alias("x_tid")).agg(F.count(F.lit(1)).alias("exits"), F.max(F.when(F.col("n") == 1, F.col("seq"))).alias("last"), F.max(F.when(F.col("n") == 2, F.col("seq"))).alias("earlier"))
    call = F.col("kind") == CALL
    counted = events.join(exits, same("x"), "left").groupBy("trace_id", "tid").agg(
        F.max("seq").alias("end"), F.max("exits").alias("exits"), F.max("last").alias("last"),
        F.count_if(call & (F.col("last").isNull() | (F.col("seq") > F.col("last")))).alias("after_last"), F.count_if(call & (F.col("earlier").isNull() | (F.col("seq") > F.col("earlier")))).alias("after_earlier"),
    )
    ended = F.col("end") == F.col("last")
    return counted.select("trace_id", "tid", (F.coalesce("exits", F.lit(0)) - F.when(ended, 1).otherwise(0)).alias("generation"), F.when(ended, F.col("after_earlier")).otherwise(F.col("after_last")).alias("calls"))


def io_bytes(calls: DataFrame) -> DataFrame:
    """(trace_id, read_bytes, written_bytes): sums of the results of reading and writing calls that are counts."""
    n = F.greatest(F.col("result").try_cast("bigint"), F.lit(0))
    total = lambda names: F.coalesce(F.sum(F.when(F.col("syscall").isin(names), n)), F.lit(0))
    return calls.groupBy("trace_id").agg(total(READS).alias("read_bytes"), total(WRITES).alias("written_bytes"))


def _fd(text: str, at: int = 0) -> int | None:
    parts = text.split(",")
    m = re.match(r"\s*(-?\d+)", parts[at]) if at < len(parts) else None
    return int(m[1]) if m else None


class Descriptors:
    """Descriptor tables of one trace's processes: shared or copied at a clone, dropped at an exec, leaked at an exit."""

    def __init__(self) -> None:
        self.tables: dict[int, dict[int, bool]] = {}  # fd -> closes at exec
        self.leaks: list[tuple[int, int]] = []
        self.last = 0

    def table(self, tid: int) -> dict[int, bool]:
        return self.tables.setdefault(tid, {})

    def leave(self, tid: int) -> None:
        gone = self.tables.pop(tid, None)
        if gone is not None and not any(t is gone for t in self.tables.values()):
            self.leaks += [(tid, fd) for fd in sorted(gone) if fd > 2]

    def call(self, tid: int, name: str, args: str, result: str, error: str | None) -> None:
        self.last = tid
        mine = self.table(tid)
        number = int(result, 0) if re.fullmatch(r"-?\d+|0x[0-9a-fA-F]+", result or "") else None
        if error or number is None or number < 0:
            return
        cloexec = "CLOEXEC" in args
        if name in OPENERS:
            mine[number] = cloexec
        elif name in ("pipe", "pipe2", "socketpair"):
            if m := re.search(r"\[(\d+),\s*(\d+)\]", args):
                mine[int(m[1])] = mine[int(m[2])] = cloexec
        elif name in ("dup", "dup2", "dup3"):
            mine[number] = name == "dup3" and cloexec
        elif name == "fcntl":
            if "F_DUPFD" in args:
                mine[number] = "F_DUPFD_CLOEXEC" in args
            elif "F_SETFD" in args and (fd := _fd(args)) in mine:
                mine[fd] = "FD_CLOEXEC" in args
        elif name == "close":
            mine.pop(_fd(args), None)
        elif name == "close_range":
            low, high = _fd(args), _fd(args, 1)
            high = high if high is not None and high >= 0 else 1 << 32
            if "UNSHARE" in args:
                mine = self.tables[tid] = dict(mine)
            for fd in [f for f in mine if low is not None and low <= f <= high]:
                if cloexec:
                    mine[fd] = True
                else:
                    del mine[fd]
        elif name in FORKS and number:
            self.tables[number] = mine if "CLONE_FILES" in args else dict(mine)
        elif name in ("execve", "execveat"):
            self.tables[tid] = {f: c for f, c in mine.items() if not c}

    def end(self) -> list[tuple[int, int]]:
        for tid in sorted(self.tables):
            self.leave(tid)
        return sorted(set(self.leaks))


def descriptor_leaks(events: DataFrame) -> DataFrame:
    """(trace_id, tid, fd): descriptors above 2 that nobody closed when the last user of their table ended.

    Threads of a trace share tables, so a trace is the smallest unit; it is read in order and in batches, and only
    the tables are kept, whose size is bounded by the open descriptors, not by the events. Calls that open, close or share
    no descriptor, the bulk of a trace, are left out before the shuffle, and so are failed ones.
    """
    counts = (F.col("kind") == EXIT) | (F.col("kind") == CALL) & F.col("syscall").isin(TABLE_CALLS) & F.col("error").isNull()
    rows = events.where(counts).select("trace_id", "seq", "tid", "kind", "syscall", "arguments", "result", "error").repartition("trace_id").sortWithinPartitions("trace_id", "seq")

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, begun = None, Descriptors(), False

        def out(trace: object, found: list[tuple[int, int]]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([trace] * len(found), pa.string()), pa.array([t for t, _ in found], pa.int64()), pa.array([f for _, f in found], pa.int64())], names=["trace_id", "tid", "fd"])

        for b in batches:
            for trace, _, tid, kind, name, args, result, error in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if begun and trace != now:
                    yield out(now, state.end())
                    state = Descriptors()
                now, begun, tid = trace, True, tid or 0
                if kind == EXIT:
                    state.leave(tid)
                elif kind == CALL and name:
                    state.call(tid, name, args or "", result or "", error)
        if begun:
            yield out(now, state.end())

    return rows.mapInArrow(over, "trace_id string, tid bigint, fd bigint")


def diff_stats(before: DataFrame, after: DataFrame) -> DataFrame:
    """Per syscall of either (:func:`syscall_sums`): calls and errors before and after, their differences, and ``latency_percent`` where the
    integer mean grew by half or more from at least a microsecond."""
    side = lambda df, p: df.select("syscall", *[F.col(c).alias(f"{p}_{c}") for c in ("calls", "errors", "known_duration", "total_ns")])
    j = side(before, "before").join(side(after, "after"), "syscall", "full_outer").fillna(0)
    mean = lambda p: F.when(F.col(f"{p}_known_duration") > 0, F.floor(F.col(f"{p}_total_ns") / F.col(f"{p}_known_duration")))
    percent = F.floor((mean("after") - mean("before")) * 100 / mean("before"))
    shift = F.when((mean("before") >= LEAST_SHIFT_NS) & (percent >= LEAST_SHIFT_PERCENT), percent)
    return j.select("syscall", "before_calls", "after_calls", (F.col("after_calls") - F.col("before_calls")).alias("calls_delta"), "before_errors", "after_errors", (F.col("after_errors") - F.col("before_errors")).alias("errors_delta"), shift.alias("latency_percent"))


def retained(events: DataFrame, most: int = 10_000) -> tuple[DataFrame, bool]:
    """The events that a report keeps, the first by trace and number, and whether there are more."""
    return bounded(events, ["trace_id", "seq"], most)
