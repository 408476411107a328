"""Traces as streams: unfinished calls put together and descriptors followed while a trace is still being written.

State is kept per trace and survives restarts in the query's checkpoint. Events of a trace must arrive in order of their
numbers, batch by batch; inside a batch they are put in order. A trace's state is what is open (halves of calls, tables of
descriptors), never its events.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tracewell.operators.trace import CALL, EXIT, RESUMED, TABLE_CALLS, UNFINISHED, Descriptors

_CALL = "trace_id string, seq bigint, tid bigint, kind string, syscall string, arguments string, result string, error string, duration_ns bigint"
_LEAK = "trace_id string, tid bigint, fd bigint"
_COLUMNS = [c.split()[0] for c in _CALL.split(", ")]


def _whole(value: object) -> int | None:
    return None if pd.isna(value) else int(value)


def _text(value: object) -> str | None:
    return value if isinstance(value, str) else None


def follow_calls(events: DataFrame) -> DataFrame:
    """A stream of events with the halves of calls made one, as :func:`tracewell.operators.trace.stitch` does: a resumed half
    takes the thread's last unfinished one if its name is the same, at its own place; a half that is followed by another or
    by the thread's end is let go as it is. Halves that still wait at the end of the stream are not told."""

    def over(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        waiting: dict[int | None, dict] = pickle.loads(state.get[0]) if state.exists else {}
        out = []
        for row in pd.concat(list(batches)).sort_values("seq", kind="stable")[_COLUMNS].to_dict("records"):
            row |= {c: _whole(row[c]) for c in ("seq", "tid", "duration_ns")} | {c: _text(row[c]) for c in ("kind", "syscall", "arguments", "result", "error")}
            if row["kind"] in (UNFINISHED, RESUMED, EXIT):
                half = waiting.pop(row["tid"], None)
                if row["kind"] == RESUMED and half and half["syscall"] == row["syscall"]:
                    row |= {"kind": CALL, "arguments": ", ".join(a for a in (half["arguments"], row["arguments"]) if a)}
                elif half:
                    out.append(half)
                if row["kind"] == UNFINISHED:
                    waiting[row["tid"]] = row
                    continue
            out.append(row)
        state.update((pickle.dumps(waiting),))
        frame = pd.DataFrame(out, columns=_COLUMNS)
        yield frame.assign(trace_id=key[0]).astype({c: "Int64" for c in ("seq", "tid", "duration_ns")})

    return events.select(*_COLUMNS).groupBy("trace_id").applyInPandasWithState(over, _CALL, "waiting binary", "append", GroupStateTimeout.NoTimeout)


def follow_descriptors(calls: DataFrame) -> DataFrame:
    """A stream of (trace_id, tid, fd): descriptors above 2 that nobody closed, told when the last user of their table ends.

    calls: whole calls and ends of threads, as from :func:`follow_calls`. Threads that never end tell nothing."""

    def over(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tables: Descriptors = pickle.loads(state.get[0]) if state.exists else Descriptors()
        for row in pd.concat(list(batches)).sort_values("seq", kind="stable").to_dict("records"):
            tid = _whole(row["tid"]) or 0
            if row["kind"] == EXIT:
                tables.leave(tid)
            else:
                tables.call(tid, row["syscall"], _text(row["arguments"]) or "", _text(row["result"]) or "", _text(row["error"]))
        found, tables.leaks = sorted(set(tables.leaks)), []
        state.update((pickle.dumps(tables),))  # one pickle, so tables that threads share stay shared
        yield pd.DataFrame({"trace_id": [key[0]] * len(found), "tid": [t for t, _ in found], "fd": [f for _, f in found]}).astype({"trace_id": "object", "tid": "int64", "fd": "int64"})

    kept = calls.where((calls["kind"] == EXIT) | (calls["kind"] == CALL) & calls["syscall"].isin(TABLE_CALLS))
    return kept.select(*_COLUMNS).groupBy("trace_id").applyInPandasWithState(over, _LEAK, "tables binary", "append", GroupStateTimeout.NoTimeout)
