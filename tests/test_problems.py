"""Operators of the core problems against literal cases, brute force and odd input."""

import datetime as dt
import ipaddress
import random
import shlex
from zoneinfo import ZoneInfo

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tracewell.functions.addresses import is_ipv4, is_ipv6, shortest_ipv6
from tracewell.functions.shell import splits_into_words
from tracewell.functions.timestamps import LocalPolicy, normalise
from tracewell.operators.bitmaps import OrdinalBitmap
from tracewell.operators.earley import Grammar
from tracewell.operators.feed_parse import classify, unusable, usable_commands, usable_sockets
from tracewell.operators.log_entries import LineParser, log_entries, parse_lines
from tracewell.operators.snapshot_diff import diff_snapshots, key_ordinals, listener_records, section_records, unit_records

S = "tcp,0.0.0.0,80,0.0.0.0,0,LISTEN,1,0,0,0,"
FEED = [
    ("sockets", S, None),
    ("sockets", ' "tcp" , "0.0.0.0",80,0.0.0.0,0, LISTEN ,1,0,0,0,"a, ""b""\nc"\r', None),
    ("sockets", S.replace("80", '8"0'), "broken_quoting"),
    ("sockets", S.replace("80", '"80"x'), "broken_quoting"),
    ("sockets", '"' + S, "broken_quoting"),
    ("sockets", S + ",", "column_count"),
    ("sockets", "", "column_count"),
    ("sockets", None, "column_count"),
    ("sockets", S.replace("0.0.0.0,80", "0.0.0.00,80"), "invalid_local_address"),
    ("sockets", S.replace("0.0.0.0,80", "256.0.0.0,80"), "invalid_local_address"),
    ("sockets", S.replace("tcp,0.0.0.0", "tcp6,[::1]"), "invalid_local_address"),
    ("sockets", S.replace("tcp,0.0.0.0", "tcp6,fe80::1%eth0"), "invalid_local_address"),
    ("sockets", S.replace("tcp,0.0.0.0", "tcp6,::ffff:1.2.3.4"), None),
    ("sockets", S.replace("tcp,0.0.0.0", "unix_dgram,unix"), None),
    ("sockets", S.replace("tcp,0.0.0.0", "unix_dgram,UNIX"), "invalid_local_address"),
    ("sockets", S.replace("LISTEN", "Listen"), "invalid_state"),
    ("sockets", S.replace("80", "many"), None),
    ("compile_commands", '/w,a.c,"cc -DX=\'a, b\' -c a.c",', None),
    ("compile_commands", "/w,a.c,cc -c 'a.c,", "invalid_command"),
    ("compile_commands", "/w,a.c,cc -c a.c \\,", "invalid_command"),
    ("compile_commands", "/w,a.c,-c a.c,", "invalid_command"),
    ("compile_commands", "/w,a.c, ,", "invalid_command"),
    ("compile_commands", "/w,a.c,cc\x00,", "invalid_command"),
    ("compile_commands", '/w,a.c,"cc \\\n -c a.c",', None),
    ("compile_commands", "/w,a.c,cc," + "x" * 200_000, None),
    ("compile_commands", "/w,a.c,cc " + "'a' " * 20_000 + ",", None),
    (None, "anything", None),
]


def test_feed_reasons(spark):
    df = spark.createDataFrame([(i, f, r, "kept") for i, (f, r, _) in enumerate(FEED)], "row_id int, feed string, raw string, reason string")
    got = {r.row_id: r.reason for r in classify(df).select("row_id", "reason").collect()}
    assert got == {i: want for i, (_, _, want) in enumerate(FEED)}


def test_feed_records(spark):
    df = spark.createDataFrame([(1, "sockets", FEED[1][1]), (1, "sockets", FEED[1][1]), (2, "compile_commands", FEED[17][1])], "row_id int, feed string, raw string")
    s = usable_sockets(df).collect()
    assert len(s) == 2 and s[0].local_port == 80 and s[0].unix_path == 'a, "b"\nc' and s[0].state == "LISTEN"
    assert usable_commands(df).first().command == "cc -DX='a, b' -c a.c"
    assert unusable(df.limit(0)).collect() == []
    bad = spark.createDataFrame([(7, "sockets", "x"), (7, "sockets", "x")], "row_id int, feed string, raw string")
    assert [tuple(r) for r in unusable(bad).collect()] == [(7, "column_count")]


def test_shell_words_agree_with_shlex(spark):
    rng = random.Random(1)
    texts = ["".join(rng.choice("ab'\" \\\n") for _ in range(rng.randrange(12))) for _ in range(600)]

    def fine(t):
        try:
            shlex.split(t)
            return True
        except ValueError:
            return False

    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", splits_into_words(F.col("t")).alias("ok")).collect()
    assert all(r.ok == fine(r.t) for r in rows)


def test_addresses_agree_with_ipaddress(spark):
    rng = random.Random(2)
    texts = [":".join(rng.choice(["0", "1", "ab", "00ff", "", "12345", "1.2.3.4"]) for _ in range(rng.randrange(1, 10))) for _ in range(800)] + ["::", "::1", "1::", "1:0:0:2::", "1.2.3.4", "01.2.3.4"]

    def valid(t, kind):
        try:
            return bool(kind(t))
        except ValueError:
            return False

    for r in spark.createDataFrame([(t,) for t in texts], "t string").select("t", is_ipv4(F.col("t")).alias("v4"), is_ipv6(F.col("t")).alias("v6"), shortest_ipv6(F.col("t")).alias("s")).collect():
        assert r.v4 == valid(r.t, ipaddress.IPv4Address), r.t
        assert r.v6 == valid(r.t, ipaddress.IPv6Address), r.t
        if r.v6:
            assert r.s == str(ipaddress.IPv6Address(r.t))


@settings(max_examples=40, deadline=None)
@given(st.sets(st.integers(0, 200_000), max_size=60), st.sets(st.integers(0, 200_000), max_size=60), st.booleans())
def test_bitmaps(a, b, dense):
    if dense:
        a, b = a | set(range(1000, 9000)), b | set(range(4000, 12000))
    x, y = OrdinalBitmap.of(np.array(sorted(a), int)), OrdinalBitmap.of(np.array(sorted(b), int))
    assert x.ordinals().tolist() == sorted(a) and len(x) == len(a)
    assert x.and_not(y).ordinals().tolist() == sorted(a - b)
    assert x.and_(y).ordinals().tolist() == sorted(a & b)


def _brute(rows):
    out, scopes = set(), {}
    for tbl, scope, n, key, value in rows:
        if None not in (tbl, scope, n):
            m = scopes.setdefault((tbl, scope), {}).setdefault(n, {})
            if key is not None:
                m[key] = max([v for v in (m.get(key), value) if v is not None], default=None)
    for (tbl, scope), snaps in scopes.items():
        for p, n in zip(sorted(snaps), sorted(snaps)[1:], strict=False):
            a, b = snaps[p], snaps[n]
            out |= {(tbl, scope, n, k, "added") for k in b.keys() - a.keys()} | {(tbl, scope, n, k, "removed") for k in a.keys() - b.keys()} | {(tbl, scope, n, k, "changed") for k in a.keys() & b.keys() if a[k] != b[k]}
    return out


@pytest.mark.parametrize("part", [3, 100_000])
def test_snapshot_differences(spark, part):
    rng = random.Random(part)
    rows = [("t", rng.choice(["a", "a", "a", "b"]), rng.choice([1, 2, 4, 7]), rng.choice([None, "k1", "k2", "k3", "k4", ""]), rng.choice([None, "x", "y"])) for _ in range(120)] + [("t", None, 1, "k", "v"), ("t", "c", None, "k", "v"), ("t", "d", 1, "k", "v"), ("t", "d", 3, None, None)]
    df = spark.createDataFrame(rows + rows[:20], "tbl string, scope string, snapshot_no int, record_key string, value string")
    got = [tuple(r) for r in diff_snapshots(df, part).collect()]
    assert len(got) == len(set(got)) and set(got) == _brute(rows)
    assert diff_snapshots(df.limit(0), part).collect() == []


def test_snapshot_records(spark):
    s = spark.createDataFrame([("h", 1, "tcp6", "2001:DB8:0::1", 80, " listen"), ("h", 1, "udp", "0.0.0.0", 1, "LISTEN"), ("h", 2, None, None, None, None)], "host string, snapshot_no int, kind string, local_address string, local_port int, state string")
    assert [r.record_key for r in listener_records(s).collect()] == ["tcp6|2001:db8::1|80", None, None]
    u = spark.createDataFrame([("p", 1, "f", "cc", None, ["b", "a", "a"], None, [], ["x"]), ("p", 2, "f", "cc", None, ["a", "b"], [], None, ["x"])], "project string, snapshot_no int, file string, compiler string, standard string, includes array<string>, defines array<string>, flags array<string>, forced_includes array<string>")
    assert diff_snapshots(unit_records(u)).collect() == []
    b = spark.createDataFrame([("h", 1, "./reports/a.json", "AB"), ("h", 2, "reports/a.json", "ab"), ("h", 2, "reports/b.json", "cd"), ("h", 2, "logs/x.log", "ef")], "host string, snapshot_no int, name string, sha256 string")
    assert [tuple(r) for r in diff_snapshots(section_records(b)).collect()] == [("bundle_entries", "h", 2, "reports/b.json", "added")]


def test_kept_ordinals(spark):
    columns = "tbl string, scope string, snapshot_no int, record_key string, value string"
    first = spark.createDataFrame([("t", "a", 2, k, "x") for k in "bcd"], columns)
    # a later delivery with an earlier snapshot and new keys renumbers nothing
    late = spark.createDataFrame([("t", "a", 1, k, "x") for k in "abc"] + [("t", "a", 3, k, "y") for k in "ce"] + [("t", "n", 1, None, None), ("t", "n", 2, "k", "v")], columns)
    kept = key_ordinals(first, rows_per_part=2)
    both = key_ordinals(late, kept, rows_per_part=1)
    was, now = {(r.scope, r.record_key): (r.parts, r.part, r.ordinal) for r in kept.collect()}, {(r.scope, r.record_key): (r.parts, r.part, r.ordinal) for r in both.collect()}
    assert len(now) == both.count() == 6 and all(now[k] == v for k, v in was.items())
    assert len({(s, *v[1:]) for (s, _), v in now.items()}) == 6
    rows = first.unionByName(late)
    got = [tuple(r) for r in diff_snapshots(rows, ordinals=both).collect()]
    assert len(got) == len(set(got)) and set(got) == _brute([tuple(r) for r in rows.collect()]) == {tuple(r) for r in diff_snapshots(rows).collect()}


def _ms(*a, tz="UTC", fold=0):
    return int(dt.datetime(*a, tzinfo=ZoneInfo(tz), fold=fold).timestamp() * 1000)


STAMPS = [
    ("2024-03-31 02:30:00", "b", _ms(2024, 3, 31, 1, 30)),  # never occurs: moved forward by the gap
    ("2024-10-27 02:30:00", "b", _ms(2024, 10, 27, 0, 30)),  # occurs twice: the earlier
    ("2024-10-27 02:30:00 CET", "b", _ms(2024, 10, 27, 1, 30)),
    ("2024-10-27 02:30:00 CEST", "b", _ms(2024, 10, 27, 0, 30)),
    ("2024-01-01 00:00:00 IST", "k", _ms(2023, 12, 31, 18, 30)),
    ("2024-01-01 00:00:00 JST", "b", None),
    ("2024-01-01 00:00:00 GMT", "k", _ms(2024, 1, 1)),
    ("Oct  9 12:00:00", "b", _ms(2023, 10, 9, 10)),
    ("Feb 29 12:00:00", "b", None),
    ("2024-02-29", "u", _ms(2024, 2, 29)),
    ("2024-02-30", "u", None),
    ('["2024-02-29 10:11"]', "u", _ms(2024, 2, 29, 10, 11)),
    ("27.06.2024 03:18:09", "u", _ms(2024, 6, 27, 3, 18, 9)),
    ("20240911T162419Z", "b", _ms(2024, 9, 11, 16, 24, 19)),
    ("2024-09-11T16:24:19.123987654+0530", "b", _ms(2024, 9, 11, 10, 54, 19) + 123),
    ("2022-11-06T01:38:03-06:00[America/Denver]", "b", _ms(2022, 11, 6, 7, 38, 3)),
    ("[2024-01-01T00:00:00[Europe/Berlin]]", "u", _ms(2023, 12, 31, 23)),
    ("Sun, 26 Oct 2025 02:22:30 +0200", "u", _ms(2025, 10, 26, 0, 22, 30)),
    ("05/Sep/2022:19:34:12 +0300", "u", _ms(2022, 9, 5, 16, 34, 12)),
    ("Sun Oct 30 04:55:19 2022", "u", _ms(2022, 10, 30, 4, 55, 19)),
    ("1645178757.7809", "b", 1645178757780),
    ("1697711106569", "b", 1697711106569),
    ("1730002426147204", "b", 1730002426147),
    ("1752562708165213234", "b", 1752562708165),
    ("12345", "b", None),
    ("2024-01-01T24:00:00Z", "u", None),
    ("2024-01-01T10:60:00Z", "u", None),
    ("yesterday", "u", None),
    ("", "u", None),
    (None, "u", None),
    ("2024-01-01 10:00:00", "nowhere", _ms(2024, 1, 1, 10)),
    ("2024-01-01 10:00:00", None, _ms(2024, 1, 1, 10)),
]


def test_timestamps(spark):
    src = spark.createDataFrame([("b", "Europe/Berlin", 2023), ("k", "Asia/Kolkata", 2024), ("u", None, 2024), ("x", "No/Where", 2024)], "file string, tz_name string, log_year int")
    df = spark.createDataFrame([(i, s, f, 5) for i, (s, f, _) in enumerate(STAMPS)], "i int, stamp string, file string, ts_ms int")
    got = {r.i: r.ts_ms for r in normalise(df, "stamp", src).collect()}
    assert got == {i: w for i, (_, _, w) in enumerate(STAMPS)}
    assert normalise(df.limit(0), "stamp", src).collect() == []
    assert normalise(spark.createDataFrame([("x", "2024-01-01 10:00:00"), ("x", "2024-01-01T10:00:00Z")], "file string, stamp string"), "stamp", src).select("ts_ms").collect() == [(None,), (_ms(2024, 1, 1, 10),)]


def test_local_policies_and_zones_of_no_source(spark):
    src = spark.createDataFrame([("b", "Europe/Berlin", 2023)], "file string, tz_name string, log_year int")
    rows = spark.createDataFrame([(i, t, "b") for i, t in enumerate(["2024-10-27 02:30:00", "2024-03-31 02:30:00", "2024-10-27 03:30:00", "2024-06-01 02:30:00", "2024-01-01 10:00:00[Asia/Tokyo]", "2024-01-01 10:00:00[No/Where]"])], "i int, stamp string, file string")
    read = lambda **policy: [r.ts_ms for r in normalise(rows, "stamp", src, policy=LocalPolicy(**policy)).orderBy("i").collect()]
    rest = [_ms(2024, 10, 27, 2, 30), _ms(2024, 6, 1, 0, 30), _ms(2024, 1, 1, 1), None]
    assert read() == [_ms(2024, 10, 27, 0, 30), _ms(2024, 3, 31, 1, 30), *rest]
    assert read(twice="later") == [_ms(2024, 10, 27, 1, 30), _ms(2024, 3, 31, 1, 30), *rest]
    assert read(twice="none", never="none") == [None, None, *rest]
    with pytest.raises(ValueError):
        LocalPolicy(twice="both")


LINES = [
    "lost before any entry",
    '<131>Oct  9 12:00:00 host app::x[1]: error',
    "\tat a.b(C.java:1)",
    "",
    "Traceback (most recent call last):",
    '<36>1 2022-01-02T00:19:33.617Z h quilld 51834 - [m@1 a="b c"] listener',
    "2022-01-02 00:25:30,805 - orbitd - WARNING - fatal flag",
    "    2024-05-01T16:06:51Z [INFO] orbitd: quoted",
    "2022-01-02 00:20:25,435 INFO  [io-2] unitgraph - error count",
    "2022-01-02T09:46:37.342+09:00 [TRACE] nek.tam: lease",
    "\x1b[2m2022-01-02T00:05:48.113412Z\x1b[0m \x1b[31;1mFATAL\x1b[0m \x1b[2msetisk\x1b[0m: x",
    "[Mon Jan 02 02:08:27.665000 2023] [a::b:trace] [pid 1] header",
    "W0102 01:00:28.011000  45375 relay_core.cc:571] queue",
    'time=2022-01-02T00:06:31.120Z pid=7 lvl=crit component=q msg="level=info"',
    "<7>[28761.297157] kern::m: dropped",
    "2022-01-02 00:06:05 error count is 5\r",
    '{"Level": "err", "ts": 1641082266968, "service": "s", "msg": "x"}',
    "{",
    '  "__REALTIME_TIMESTAMP": "1641082784368916",',
    '  "severity": "4",',
    '  "SYSLOG_IDENTIFIER": "jin.t"',
    "}",
    '  "level": "fatal"',
    "(end of report)",
]
ENTRIES = [
    (2, 5, _ms(2024, 10, 9, 12), "error", "app::x"),
    (6, 6, _ms(2022, 1, 2, 0, 19, 33) + 617, "warn", "quilld"),
    (7, 8, _ms(2022, 1, 2, 0, 25, 30) + 805, "warn", "orbitd"),
    (9, 9, _ms(2022, 1, 2, 0, 20, 25) + 435, "info", "unitgraph"),
    (10, 10, _ms(2022, 1, 2, 0, 46, 37) + 342, "trace", "nek.tam"),
    (11, 11, _ms(2022, 1, 2, 0, 5, 48) + 113, "fatal", "setisk"),
    (12, 12, _ms(2023, 1, 2, 2, 8, 27) + 665, "trace", "a::b"),
    (13, 13, _ms(2024, 1, 2, 1, 0, 28) + 11, "warn", "relay_core.cc"),
    (14, 14, _ms(2022, 1, 2, 0, 6, 31) + 120, "fatal", "q"),
    (15, 15, 0, "debug", "kern::m"),
    (16, 16, _ms(2022, 1, 2, 0, 6, 5), "unknown", ""),
    (17, 17, 1641082266968, "error", "s"),
    (18, 24, 1641082784368, "warn", "jin.t"),
]


@pytest.mark.parametrize("stretch", [2, 5, 10_000])
def test_log_entries(spark, stretch):
    src = spark.createDataFrame([("f", 2024)], "file string, log_year int")
    rows = [("f", i + 1, t, "x") for i, t in enumerate(LINES)]
    df = spark.createDataFrame(rows + rows[3:9] + [("g", 1, None, "x"), (None, 1, LINES[6], "x"), ("f", None, LINES[6], "x")], "file string, line_no int, raw string, level string")
    out = log_entries(df, src, stretch).collect()
    assert sorted(tuple(r)[1:6] for r in out if r.file == "f") == ENTRIES
    assert [tuple(r)[:3] for r in out if r.file != "f"] == [(None, 1, 1)]
    assert log_entries(df.limit(0), src, stretch).collect() == []


def test_log_spans(spark):
    df = spark.createDataFrame([("f", 1, "2022-01-02 00:20:25,435 INFO  worker unitgraph - go")], "file string, line_no int, raw string")
    r = parse_lines(df).first()
    assert (r.layout, r.level, r.source) == ("LINE_THREAD", "info", "unitgraph") and [(s.start, s.end) for s in r.unparsed] == [(30, 36)]


def test_earley_keeps_the_best_parse():
    g = Grammar("S -> A\nS -> B @-1\nA -> x=a y=W @-3\nB -> x=a y=W\nW -> w W\nW -> w\nSKIP -> q", "S")
    p = g.parse(("a", "w", "w"))
    assert p.layout == "B" and p.score == -1 and p.captured["x"] == 0
    assert g.parse(("w",)) is None and g.parse(()) is None


def test_line_parser_survives_anything():
    p = LineParser({})
    rng = random.Random(3)
    for _ in range(2000):
        p.line("".join(rng.choice('2024-01T:{}[]<>"= \\\x1b\tINFOab') for _ in range(rng.randrange(40))), None)
    p.line("x " * 100_000, None)


def test_pairs_are_read_whole():
    p = LineParser({})
    fields = " ".join(f"k{i}=v{i}" for i in range(14))
    at = "ts=2024-01-01T00:00:00Z"
    for line, level, source in [
        (f'{at} {fields} level=error component=db msg="a b" x=1', "error", "db"),
        (f'{at} msg="disk full level=debug" level=error logger=db', "error", "db"),
        (f"level=warn {at} msg=hello world level=error", "warn", None),
        (f"{at} msg=up {fields} level=info", "info", None),
    ]:
        role, layout, ts, *found = p.line(line, "f")[:5]
        assert (role, layout, ts, found) == (1, "LINE_PAIRS", 1704067200000, [level, source]), line
    assert p.line("a=b level=info", "f")[0] == 0


def test_grammar_describes_objects_and_continuations():
    read = LineParser({})
    assert [read.shape(k)[0] for k in [("INDENT", "TEXT"), ("NAME", "TEXT"), ("BRACE", "FLDO", "FLDT", "ECARB"), ("INDENT", "FLDL"), ("BRACE",), ("ECARB",)]] == ["LINE_CONTINUED", "LINE_CONTINUED", "LINE_OBJECT", "LINE_MEMBER", "LINE_OPEN", "LINE_CLOSE"]
    many = ", ".join(f'"k{i}": [{i}, {{"a": "b"}}]' for i in range(40))
    role, layout, ts, level, source, _, _ = read.line('{"severity": "odd", ' + many + ', "msg": "level: fatal", "logger": "q", "source": null, "level": "warn", "time": "2022-01-02T00:00:00Z"}', "f")
    assert (role, layout, ts, level, source) == (1, "LINE_OBJECT", _ms(2022, 1, 2), "warn", None)
    assert read.line('{"a": 1', "f")[0] == read.line("}, 5", "f")[0] == read.line("   ", "f")[0] == 0
