"""Runs of like consecutive events, each collapsed into one row.

Per thread and stretch of sequence numbers, every event's canonical form gets a Unicode code point, the code points
make one string, and a regular expression with a backreference finds the repetitions; their spans lead back to the
events' numbers and times. A thread is cut into stretches of ``stretch`` sequence numbers, so a hot thread never
meets one task; runs that touch the end of a stretch are emitted with their canonical form and joined with their
neighbours afterwards.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

STRETCH = 50_000
DAY_US = 86_400_000_000

_TEXT = re.compile(r'"((?:[^"\\]|\\.)*)"(?:\.\.\.)?', re.S)
_NUMBER = re.compile(r"0x[0-9a-fA-F]+|[0-9]+")
_RUN = re.compile(r"(.)\1*", re.S)
_REPEATED = re.compile(r"(.)\1{2,}", re.S)
_EPOCH = re.compile(r"\s*(\d{6,})(?:\.(\d{1,9}))?\s*")
_CLOCK = re.compile(r"\s*(\d{1,2}):(\d\d):(\d\d)(?:\.(\d{1,9}))?\s*")

_OUT = pa.schema(
    [
        ("trace_id", pa.string()), ("tid", pa.int64()), ("stretch", pa.int64()), ("first_seq", pa.int64()), ("last_seq", pa.int64()), ("n_calls", pa.int64()),
        ("head", pa.bool_()), ("tail", pa.bool_()), ("canon", pa.string()), ("known", pa.int64()),
        ("from_us", pa.int64()), ("from_clock", pa.bool_()), ("to_us", pa.int64()), ("to_clock", pa.bool_()),
    ]
)
_SCHEMA = "trace_id string, tid bigint, stretch bigint, first_seq bigint, last_seq bigint, n_calls bigint, head boolean, tail boolean, canon string, known bigint, from_us bigint, from_clock boolean, to_us bigint, to_clock boolean"


def canonical_arguments(arguments: str | None) -> str | None:
    """Arguments with all numbers taken as one and all quoted texts as one, except that paths are kept, numbers aside."""
    if arguments is None:
        return None
    if '"' in arguments:
        arguments = _TEXT.sub(lambda m: m[0] if m[1].startswith("/") else '""', arguments)
    return _NUMBER.sub("0", arguments)


def time_us(ts: str | None) -> tuple[int, bool] | None:
    """(microseconds, whether it is only a time of day); None where the text is no time of the tracer."""
    if ts is None:
        return None
    if m := _EPOCH.fullmatch(ts):
        return int(m[1]) * 1_000_000 + int((m[2] or "").ljust(6, "0")[:6]), False
    if (m := _CLOCK.fullmatch(ts)) and int(m[1]) < 24 and int(m[2]) < 60 and int(m[3]) < 61:
        return (int(m[1]) * 3600 + int(m[2]) * 60 + int(m[3])) * 1_000_000 + int((m[4] or "").ljust(6, "0")[:6]), True
    return None


def _symbol(code: int) -> str:
    return chr(code + 1 if code < 0xD7FF else code + 0x801)  # no surrogates


def _runs(string: str, least: int) -> Iterator[tuple[int, int, bool, bool]]:
    """(start, end, touches the start, touches the end) of each repetition, and of the runs at either end."""
    first = _RUN.match(string).end()
    last = len(string.rstrip(string[-1]))
    yield 0, first, True, first == len(string)
    if last:
        for m in (_REPEATED if least == 3 else re.compile(rf"(.)\1{{{max(0, least - 1)},}}", re.S)).finditer(string, first, last):
            yield m.start(), m.end(), False, False
        yield last, len(string), False, True


def _collapse(least: int):
    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str | None, str | None] = {}

        def settle(table: pa.Table) -> Iterator[pa.RecordBatch]:
            code = lambda c: table[c].combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
            seq = table["seq"].to_numpy()
            group = np.stack([code("trace_id"), code("tid"), table["stretch"].to_numpy()])
            new = np.r_[True, (group[:, 1:] != group[:, :-1]).any(axis=0)]
            keep = np.flatnonzero(new | np.r_[True, seq[1:] != seq[:-1]])  # each number once
            edges = [*np.flatnonzero(new[keep]).tolist(), len(keep)]
            table, seq = table.take(pa.array(keep)), seq[keep]
            names = list(zip(table["syscall"].to_pylist(), table["error"].to_pylist(), table["arguments"].to_pylist(), strict=True))
            stamps, traces, tids, stretches = table["ts"].to_pylist(), table["trace_id"].to_pylist(), table["tid"].to_pylist(), table["stretch"].to_pylist()
            out: list[tuple] = []
            for a, b in zip(edges, edges[1:], strict=False):
                codes: dict[tuple, str] = {}
                symbols = []
                for syscall, error, arguments in names[a:b]:
                    if arguments not in memo:
                        if len(memo) > 100_000:
                            memo.clear()
                        memo[arguments] = canonical_arguments(arguments)
                    event = (syscall, error, memo[arguments])
                    if event not in codes:
                        codes[event] = _symbol(len(codes))
                    symbols.append(codes[event])
                for start, end, head, tail in _runs("".join(symbols), least):
                    times = [t for t in map(time_us, stamps[a + start : a + end]) if t]
                    lo, hi = (times[0], times[-1]) if times else ((None, None), (None, None))
                    canon = repr((names[a + start][0], names[a + start][1], memo_of(names[a + start][2]))) if head or tail else None
                    out.append((traces[a], tids[a], stretches[a], int(seq[a + start]), int(seq[a + end - 1]), end - start, head, tail, canon, len(times), *lo, *hi))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _OUT, strict=True)], schema=_OUT)

        def memo_of(arguments: str | None) -> str | None:
            return memo[arguments] if arguments in memo else canonical_arguments(arguments)

        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            last = [batch.column(c)[batch.num_rows - 1].as_py() for c in range(3)]
            high, low = batch.num_rows, 0
            while low < high:  # where the last group of the batch begins; it may go on in the next
                mid = (low + high) // 2
                high, low = (mid, low) if all(batch.column(c)[mid].as_py() == last[c] for c in range(3)) else (high, mid + 1)
            if low:
                yield from settle(pa.Table.from_batches([*held[:-1], batch.slice(0, low)]))
                held = [batch.slice(low)]
        if held:
            yield from settle(pa.Table.from_batches(held))

    return over


def collapse_runs(events: DataFrame, least: int = 3, stretch: int = STRETCH) -> DataFrame:
    """(trace_id, tid, first_seq, last_seq, n_calls, span_us): each longest run of at least ``least`` like calls.

    events: trace_id, seq, tid, ts, syscall, arguments, error; further columns are ignored. Calls are ordered by seq,
    and each seq of a thread counts once (copies are the same call). Null fields equal one another; null ids make a
    thread of their own; rows without seq have no place in the order and are left out. Times that cannot be read are
    unknown. span_us runs from the first to the last known time, over midnight at most once where times lack a date,
    and is 0 with fewer than two known. An empty table gives an empty one.
    """
    rows = events.where("seq IS NOT NULL").select("trace_id", F.col("tid").cast("bigint").alias("tid"), F.floor(F.col("seq") / F.lit(stretch)).cast("bigint").alias("stretch"), F.col("seq").cast("bigint").alias("seq"), "ts", "syscall", "arguments", "error")
    placed = rows.repartition("trace_id", "tid", "stretch").sortWithinPartitions("trace_id", "tid", "stretch", "seq")
    runs = placed.mapInArrow(_collapse(least), _SCHEMA)
    # Runs inside a stretch are done; only those at its ends meet their neighbours, two a stretch and thread.
    slot = F.when(F.col("head") | F.col("tail"), F.lit(-1)).otherwise(F.col("stretch"))
    order = Window.partitionBy("trace_id", "tid", "slot").orderBy("first_seq")
    goes_on = F.coalesce(F.col("head") & F.lag("tail").over(order) & (F.lag("canon").over(order) == F.col("canon")), F.lit(False))
    marked = runs.withColumn("slot", slot).withColumn("starts", F.when(goes_on, 0).otherwise(1)).withColumn("run", F.sum("starts").over(order))
    known = F.col("known") > 0
    whole = marked.groupBy("trace_id", "tid", "slot", "run").agg(
        F.min("first_seq").alias("first_seq"), F.max("last_seq").alias("last_seq"), F.sum("n_calls").alias("n_calls"), F.sum("known").alias("known"),
        F.min_by(F.when(known, F.struct("from_us", "from_clock")), F.when(known, F.col("first_seq"))).alias("lo"),
        F.max_by(F.when(known, F.struct("to_us", "to_clock")), F.when(known, F.col("first_seq"))).alias("hi"),
    )
    span = F.when(~F.col("lo.from_clock") & ~F.col("hi.to_clock"), F.col("hi.to_us") - F.col("lo.from_us")).otherwise(F.pmod(F.col("hi.to_us") - F.col("lo.from_us"), F.lit(DAY_US)))
    return whole.where(F.col("n_calls") >= least).select("trace_id", "tid", "first_seq", "last_seq", "n_calls", F.when(F.col("known") >= 2, span).otherwise(F.lit(0)).cast("bigint").alias("span_us"))
