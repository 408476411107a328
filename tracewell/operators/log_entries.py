"""Log lines of many programs, parsed into entries with time, level, component and message.

A lexer names the kinds of a line's leading tokens, and a weighted context-free grammar over these kinds describes
headers, fields, objects in one line or several, and continuations, the least likely reading of any line. An Earley parser
keeps the highest-scoring parse; lines of one shape share it, so each task parses a shape once. Tokens that only a
skipping rule can account for, and lines that go on with an entry, are exposed as unparsed spans.

Entries are put together per file and stretch of line numbers, so a hot file never meets one task; only the last
entry of a stretch and the lines before the first one of the next are joined across the border.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from datetime import date, timedelta

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tracewell.operators.earley import Grammar

STRETCH = 16_384
#: Tokens of a line that the grammar sees: no rule has a header of more than eight, what follows is message. Lines of
#: pairs and objects are read whole.
HEADER_TOKENS = 12

# The names, short forms and initials of levels, and the numeric severities of syslog.
LEVELS = {
    "trace": "trace", "trc": "trace", "t": "trace", "verbose": "trace",
    "debug": "debug", "dbg": "debug", "d": "debug",
    "info": "info", "inf": "info", "i": "info", "information": "info", "informational": "info", "notice": "info", "note": "info", "n": "info",
    "warn": "warn", "warning": "warn", "wrn": "warn", "w": "warn",
    "error": "error", "err": "error", "e": "error", "severe": "error",
    "fatal": "fatal", "ftl": "fatal", "f": "fatal", "critical": "fatal", "crit": "fatal", "c": "fatal", "panic": "fatal", "emerg": "fatal", "emergency": "fatal", "alert": "fatal",
}
SEVERITIES = ["fatal", "fatal", "fatal", "error", "warn", "info", "info", "debug"]
TIME_KEYS = ("ts", "time", "timestamp", "__realtime_timestamp", "@timestamp")
LEVEL_KEYS = ("level", "lvl", "severity", "priority")
SOURCE_KEYS = ("source", "logger", "component", "service", "syslog_identifier", "_comm", "program", "module")
MESSAGE_KEYS = ("msg", "message")

_WORDS = "|".join(sorted((w for w in LEVELS if len(w) > 1), key=len, reverse=True))
_UPPER_WORDS = _WORDS.upper()
_WORDS = f"(?:{_WORDS}|{_WORDS.upper()}|{'|'.join(w.capitalize() for w in LEVELS if len(w) > 1)})"
_DATE = r"\d{4}-\d\d-\d\d"
_MON = r"(?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)"
_NAME = r"[A-Za-z_][\w.:/@+-]*?"
#: Token kinds in order of precedence; the first that fits at a place and ends before a blank or the line's end holds.
TOKENS = [
    ("ISO", rf"{_DATE}[T ]\d\d:\d\d:\d\d(?:[.,]\d+)?(?:Z|[+-]\d\d:?\d\d)?(?=\s|$)"),
    ("SYS", rf"{_MON} [ \d]\d \d\d:\d\d:\d\d(?:\.\d+)?(?=\s|$)"),
    ("APT", rf"\[[A-Z][a-z]{{2}} {_MON} [ \d]\d \d\d:\d\d:\d\d(?:\.\d+)? \d{{4}}\](?=\s|$)"),
    ("GLT", r"[A-Z]\d{4} \d\d:\d\d:\d\d(?:\.\d+)?(?=\s)"),
    ("PRIV", r"<\d{1,3}>\d{1,2}(?=\s)"),
    ("PRI", r"<\d{1,3}>"),
    ("UPT", r"\[\s*\d+\.\d+\](?=\s)"),
    ("SDATA", r"(?:\[[\w.-]+@\d+(?:\s+[\w.-]+=\"(?:[^\"\\]|\\.)*\")*\])+(?=\s|$)"),
    ("LVLB", rf"\[\s*(?:{_WORDS}|[TDIWEFCN])\s*\]:?(?=\s|$)"),
    ("MODLVL", rf"\[[\w.:/@+-]+:{_WORDS}\](?=\s|$)"),
    ("PIDB", r"\[(?:pid|tid|client)\s[^\]]*\](?=\s|$)"),
    ("KVT", rf"(?:{'|'.join(TIME_KEYS)})=\S+(?=\s|$)"),
    ("KVL", rf"(?:{'|'.join(LEVEL_KEYS)})=\"?[\w]+\"?(?=\s|$)"),
    ("KVS", rf"(?:{'|'.join(SOURCE_KEYS)})=(?:\"(?:[^\"\\]|\\.)*\"|\S+)(?=\s|$)"),
    ("KVM", rf"(?:{'|'.join(MESSAGE_KEYS)})="),
    ("KVO", r"[\w.]+=(?:\"(?:[^\"\\]|\\.)*\"|\S*)(?=\s|$)"),
    ("LOC", r"[\w./+-]+:\d+\](?=\s|$)"),
    ("TAGPID", rf"{_NAME}\[\d+\]:(?=\s|$)"),
    ("LVLU", rf"(?:{_UPPER_WORDS}|[TDIWEFC])(?=\s|$)"),
    ("LVL", rf"{_WORDS}(?=\s|$)"),
    ("TAG", rf"{_NAME}:(?=\s|$)"),
    ("BR", r"\[[^\]\s]*\](?=\s|$)"),
    ("DASH", r"-(?=\s|$)"),
    ("NUM", r"\d+(?=\s|$)"),
    ("NAME", r"[A-Za-z_][\w.:/@+-]*(?=\s|$)"),
    ("OTHER", r"\S+"),
]
_LEX = re.compile(r"\s*(?:" + "|".join(f"(?P<{k}>{p})" for k, p in TOKENS) + ")")
_ANY = " ".join(k for k, _ in TOKENS)

#: Layouts of entries; the message is whatever the header leaves over. Weights prefer a layout that explains more.
GRAMMAR_TEXT = f"""
LINE -> LINE_DASHED
LINE -> LINE_THREAD
LINE -> LINE_BRACKET
LINE -> LINE_SPAN
LINE -> LINE_MODULE
LINE -> LINE_SYSLOG
LINE -> LINE_SYSLOG5
LINE -> LINE_KERNEL
LINE -> LINE_GLOG
LINE -> LINE_PAIRS
LINE -> LINE_OBJECT
LINE -> LINE_OPEN
LINE -> LINE_MEMBER
LINE -> LINE_CLOSE
LINE -> LINE_PLAIN @-20
LINE -> LINE_CONTINUED @-50
LINE_CONTINUED -> INDENT
LINE_CONTINUED -> INDENT body=TEXT
LINE_CONTINUED -> REST
LINE_DASHED -> ts=ISO DASH WHO DASH LEVEL DASH BODY
LINE_DASHED -> ts=ISO DASH WHO DASH LEVEL DASH
LINE_THREAD -> ts=ISO LEVEL BR WHO DASH BODY
LINE_THREAD -> ts=ISO LEVEL BR WHO DASH
LINE_THREAD -> ts=ISO LEVEL SKIP WHO DASH BODY @-4
LINE_BRACKET -> ts=ISO lvl=LVLB src=TAG BODY
LINE_BRACKET -> ts=ISO lvl=LVLB src=TAG
LINE_BRACKET -> ts=ISO lvl=LVLB src=TAGPID BODY
LINE_BRACKET -> ts=ISO lvl=LVLB BODY @-4
LINE_SPAN -> ts=ISO LEVEL src=TAG BODY
LINE_SPAN -> ts=ISO LEVEL src=TAG
LINE_SPAN -> ts=ISO lvl=LVLU BODY @-5
LINE_MODULE -> ts=APT modlvl=MODLVL BODY @-1
LINE_MODULE -> ts=APT modlvl=MODLVL PIDB BODY @-0.5
LINE_MODULE -> ts=APT modlvl=MODLVL PIDB PIDB BODY
LINE_MODULE -> ts=APT modlvl=MODLVL PIDB
LINE_MODULE -> ts=APT lvl=LVLB BODY @-1
LINE_MODULE -> ts=APT lvl=LVLB PIDB BODY
LINE_SYSLOG -> SYSHEAD
LINE_SYSLOG -> SYSHEAD BODY
LINE_SYSLOG -> pri=PRI SYSHEAD
LINE_SYSLOG -> pri=PRI SYSHEAD BODY
SYSHEAD -> ts=SYS HOST src=TAGPID
SYSHEAD -> ts=SYS HOST src=TAG
SYSHEAD -> ts=ISO HOST src=TAGPID
SYSHEAD -> ts=ISO HOST src=TAG @-8
LINE_SYSLOG5 -> pri=PRIV ts=ISO HOST APP PROC ID SD BODY
LINE_SYSLOG5 -> pri=PRIV ts=ISO HOST APP PROC ID SD
LINE_SYSLOG5 -> pri=PRIV DASH HOST APP PROC ID SD BODY
LINE_KERNEL -> pri=PRI UPT src=TAG BODY
LINE_KERNEL -> pri=PRI UPT src=TAGPID BODY
LINE_KERNEL -> pri=PRI UPT BODY @-4
LINE_KERNEL -> UPT src=TAG BODY @-2
LINE_KERNEL -> UPT BODY @-5
LINE_GLOG -> ts=GLT NUM loc=LOC BODY
LINE_GLOG -> ts=GLT NUM loc=LOC
LINE_PAIRS -> PAIRS
LINE_PAIRS -> PAIRS body=TEXT @-1
PAIRS -> PAIR
PAIRS -> PAIR PAIRS
PAIR -> ts=KVT
PAIR -> lvl=KVL
PAIR -> src=KVS
PAIR -> KVO @-1
PAIR -> KVM @-1
LINE_OBJECT -> BRACE FIELDS ECARB
LINE_OBJECT -> BRACE ECARB
LINE_OPEN -> BRACE
LINE_MEMBER -> INDENT FIELD
LINE_CLOSE -> ECARB
FIELDS -> FIELD
FIELDS -> FIELD FIELDS
FIELD -> ts=FLDT
FIELD -> lvl=FLDL
FIELD -> src=FLDS
FIELD -> FLDO @-1
LINE_PLAIN -> ts=ISO BODY
LINE_PLAIN -> ts=SYS BODY @-2
LEVEL -> lvl=LVL
LEVEL -> lvl=LVLU
WHO -> src=NAME
WHO -> src=TAG @-3
WHO -> src=LVL @-3
WHO -> src=LVLU @-3
WHO -> src=OTHER @-4
HOST -> NAME
HOST -> OTHER @-1
HOST -> NUM @-1
HOST -> LVL @-3
HOST -> LVLU @-3
APP -> src=NAME
APP -> src=OTHER @-1
APP -> src=LVL @-1
APP -> src=LVLU @-1
APP -> src=NUM @-1
APP -> DASH @-1
PROC -> NUM
PROC -> NAME @-1
PROC -> OTHER @-1
PROC -> DASH
ID -> NAME
ID -> LVL
ID -> LVLU
ID -> NUM
ID -> OTHER @-1
ID -> DASH
SD -> SDATA
SD -> DASH
BODY -> body=FIRST
BODY -> body=FIRST REST
REST -> FIRST
REST -> FIRST REST
{chr(10).join(f"SKIP -> {k}" for k in _ANY.split())}
{chr(10).join(f"FIRST -> {k}" for k in ["TEXT", *_ANY.split()])}
"""
GRAMMAR = Grammar(GRAMMAR_TEXT, "LINE")

_ANSI = re.compile(r"\x1b\[[0-9;]*[A-Za-z]")
_MEMBER = re.compile(r'\s+"([^"\\]+)"\s*:\s*(?:"((?:[^"\\]|\\.)*)"|(-?\d+(?:\.\d+)?))\s*,?\s*')
_RUN = re.compile(r"\s*(\S+)")
_ISO = re.compile(TOKENS[0][1])
_PAIR = re.compile("|".join(f"(?P<{k}>{p})" for k, p in TOKENS if k.startswith("KV")))
_NEXT_PAIR = re.compile(rf"\s*(?:{_PAIR.pattern}|(?P<KV_>[^\s=\"]+=(?:\"(?:[^\"\\]|\\.)*\"|\S*)(?=\s|$)))")
_QUOTED = re.compile(r'"(?:[^"\\]|\\.)*"(?=\s|$)')
_UNBROKEN = re.compile(r"\S*")
_REST_OF_PAIRS = re.compile(r'(?:\s+[^\s="]+=(?:"(?:[^"\\]|\\.)*"|[^\s"]\S*|)(?=\s|$))+\s*')
#: No header goes on after these, nor after a dash once a header has said as much, nor after a structured header's seven fields.
_LAST = frozenset({"TAG", "TAGPID", "LOC", "PIDB", "SDATA"})
_BIND = re.compile(r"[A-Z]\d{4}\Z|\[[^\]]*\Z|<")
_MONTHS = {m: i + 1 for i, m in enumerate("Jan Feb Mar Apr May Jun Jul Aug Sep Oct Nov Dec".split())}
_EPOCH_DAY = date(1970, 1, 1).toordinal()
_TAIL = re.compile(r"(?:[.,](\d+))?\s*(?:[Zz]|([+-])(\d\d):?(\d\d)?)?")

#: What a field says by its name, and the names' order where several say the same.
_ROLES = {name: (role, i) for role, names in (("ts", TIME_KEYS), ("level", LEVEL_KEYS), ("source", SOURCE_KEYS)) for i, name in enumerate(names)}
_BARE_NUMBER = re.compile(r"-?\d+(?:\.\d+)?")

HEAD, MORE, OPEN, MEMBER, CLOSE = 1, 0, 2, 3, 4
_LINE_ROLES = {"LINE_OPEN": OPEN, "LINE_MEMBER": MEMBER, "LINE_CLOSE": CLOSE}
_FIELD_KINDS = {"ts": "FLDT", "level": "FLDL", "source": "FLDS"}


def _level(word: object) -> str:
    """The level a word or a numeric severity names."""
    known = LEVELS.get(word) if isinstance(word, str) else None
    if known:
        return known
    text = str(word).strip().strip('"').lower()
    return SEVERITIES[int(text)] if len(text) == 1 and text in "01234567" else LEVELS.get(text, "unknown")


class LineParser:
    """Parses one line after another; shapes and dates that came before are remembered."""

    def __init__(self, years: dict[str, int], shapes: int = 50_000) -> None:
        self.years, self.most = years, shapes
        self.shapes: dict[tuple[str, ...], tuple | None] = {}
        self.days: dict[str, int | None] = {}
        self.starts: dict[tuple, int | None] = {}
        self.clocks: dict[str, int | None] = {}
        self.tails: dict[str, int | None] = {}
        self.kinds: dict[str, str] = {}

    def _day(self, year: int, month: int, day: int) -> int | None:
        try:
            return (date(year, month, day).toordinal() - _EPOCH_DAY) * 86_400_000
        except ValueError:
            return None

    def iso(self, text: str) -> int | None:
        """Epoch milliseconds of a full date and time, UTC where no offset is given; its three parts are remembered."""
        date_part, clock, tail = text[:10], text[11:19], text[19:]
        day = self.days.get(date_part, 0)
        if day == 0:
            m = re.fullmatch(r"(\d{4})-(\d\d)-(\d\d)", date_part)
            day = self.days[date_part] = self._day(int(m[1]), int(m[2]), int(m[3])) if m else None
        time = self.clocks.get(clock, -1)
        if time == -1:
            m = re.fullmatch(r"([01]\d|2[0-3]):([0-5]\d):([0-5]\d)", clock)
            time = self.clocks[clock] = (int(m[1]) * 3600 + int(m[2]) * 60 + int(m[3])) * 1000 if m else None
        rest = self.tails.get(tail, -1 << 60)
        if rest == -1 << 60:
            if len(self.tails) > self.most:
                self.tails.clear()
            m = _TAIL.fullmatch(tail)
            rest = self.tails[tail] = (int((m[1] or "0").ljust(3, "0")[:3]) - (1 if m[2] == "+" else -1) * (int(m[3] or 0) * 60 + int(m[4] or 0)) * 60_000) if m else None
        return None if day is None or time is None or rest is None else day + time + rest

    def _clock(self, year: int | None, month: int, day: int, clock: str) -> int | None:
        start = self.starts.get((year, month, day), 0)
        if start == 0:
            start = self.starts[(year, month, day)] = self._day(year, month, day) if year else None
        within = self.iso("1970-01-01T" + clock) if start is not None else None
        return None if within is None else start + within

    def time(self, kind: str, text: str, file: str | None) -> int | None:
        """Epoch milliseconds of a time token of a kind; the file's year stands in for a missing one."""
        if kind == "ISO":
            return self.iso(text)
        if kind == "SYS":
            return self._clock(self.years.get(file), _MONTHS[text[:3]], int(text[4:6]), text[7:])
        if kind == "APT":
            parts = text[1:-1].split()
            return self._clock(int(parts[4]), _MONTHS[parts[1]], int(parts[2]), parts[3])
        if kind == "GLT":
            return self._clock(self.years.get(file), int(text[1:3]), int(text[3:5]), text[6:]) if 1 <= int(text[1:3]) <= 12 else None
        return self.value_time(*text.split("=", 1))

    def value_time(self, key: str, value: object) -> int | None:
        """Epoch milliseconds of a field: a bare number of milliseconds, microseconds under the journal's key, or a date."""
        text = str(value).strip().strip('"')
        if _BARE_NUMBER.fullmatch(text):
            number = int(float(text)) if "." in text else int(text)
            if key.lower() == "__realtime_timestamp":
                return number // 1000
            for scale, least in ((1_000_000, 10**17), (1000, 10**14)):
                if abs(number) >= least:
                    return number // scale
            return number if abs(number) >= 10**11 else int(float(text) * 1000)
        return self.iso(text) if isinstance(value, str) else None

    def object(self, pairs: list[tuple[str, object]]) -> list[str]:
        """The kinds of an object's fields, keys in any case: of those that tell the same, by the order of their names the
        first one (of levels the first known) is it, all others are other fields."""
        best: dict[str, tuple[int, int]] = {}
        for i, (key, value) in enumerate(pairs):
            role = _ROLES.get(key) or _ROLES.get(key.lower())
            if role and (role[0] not in best or role[1] < best[role[0]][0]) and (role[0] != "level" or _level(value) != "unknown"):
                best[role[0]] = (role[1], i)
        kinds = ["FLDO"] * len(pairs)
        for role, (_, i) in best.items():
            kinds[i] = _FIELD_KINDS[role]
        return kinds

    def tokens(self, text: str) -> tuple[tuple[str, ...], list[tuple[int, int]], list[tuple[str, object]]]:
        """Kinds and places of a line's tokens, and the pairs of an object's fields; those of its other fields that follow
        each other are one token."""
        if text[0].isspace():
            indent = len(text) - len(text.lstrip())
            if text[indent : indent + 1] == '"' and (m := _MEMBER.fullmatch(text)):
                pairs = [(m[1], m[2] if m[2] is not None else m[3])]
                return ("INDENT", *self.object(pairs)), [(0, indent), (indent, len(text))], [("", None), *pairs]
            return (("INDENT",), [(0, len(text))], []) if indent == len(text) else (("INDENT", "TEXT"), [(0, indent), (indent, len(text))], [])
        if text[0] not in "{}":
            return *self.lex(text), []
        bare = text.rstrip()
        if bare in "{}":
            return ("BRACE" if bare == "{" else "ECARB",), [(0, 1)], []
        try:
            pairs = json.loads(text, object_pairs_hook=list) if text[0] == "{" else None
        except ValueError:
            pairs = None
        if not isinstance(pairs, list) or not all(isinstance(p, tuple) for p in pairs):
            return ("TEXT",), [(0, len(text))], []
        kinds, kept = ["BRACE"], [("", None)]
        for kind, pair in zip(self.object(pairs), pairs, strict=True):
            if kind != "FLDO" or kinds[-1] != "FLDO":
                kinds.append(kind), kept.append(pair)
        return (*kinds, "ECARB"), [(0, len(text))] * (len(kinds) + 1), kept

    def lex(self, text: str) -> tuple[tuple[str, ...], list[tuple[int, int]]]:
        """Kinds and places of a line's leading tokens; plain running words and what follows are one TEXT.

        What a run of non-blanks is depends on that run alone, unless it may begin a token with blanks inside; so
        its kind is remembered.
        """
        kinds: list[str] = []
        spans: list[tuple[int, int]] = []
        kept, at, plain = self.kinds, 0, False
        most = 7 if text[0] == "<" else HEADER_TOKENS
        while len(kinds) < most:
            if kinds and (kinds[-1] in _LAST and len(kinds) > 1 or kinds[-1] == "DASH" and len(kinds) > 4 and kinds[0] == "ISO"):
                break
            run = _RUN.match(text, at)
            if run is None:
                return tuple(kinds), spans
            token = run[1]
            kind = kept.get(token)
            if kind is None:
                start = run.start(1)
                m = _ISO.match(text, start) if token[0].isdigit() else None
                if m:
                    kind, end = "ISO", m.end()
                elif "=" in token and not kinds and _NEXT_PAIR.match(text, start):
                    return self.pairs(text)
                elif "=" in token and (m := _PAIR.match(text, start)):
                    kind, end = m.lastgroup, m.end()
                else:
                    m = _LEX.match(text, start)
                    kind, end = m.lastgroup, m.end()
                    if end == run.end() and not token[0].isdigit() and token not in _MONTHS and not _BIND.match(token):
                        if len(kept) > self.most:
                            kept.clear()
                        kept[token] = kind
                kinds.append(kind), spans.append((start, end))
                at = end
                if kind == "KVM":
                    break
                plain = kind == "NAME" and token.isalpha() and token.islower()
                continue
            word = kind == "NAME" and token.isalpha() and token.islower()
            if word and plain and len(kinds) > 1 and kinds[0] != "PRIV":
                kinds[-1], spans[-1] = "TEXT", (spans[-1][0], len(text))
                return tuple(kinds), spans
            plain = word
            kinds.append(kind), spans.append(run.span(1))
            at = run.end()
        if run := _RUN.match(text, at):
            kinds.append("TEXT"), spans.append((run.start(1), len(text)))
        return tuple(kinds), spans

    def pairs(self, text: str) -> tuple[tuple[str, ...], list[tuple[int, int]]]:
        """Kinds and places of a line of key=value pairs, however many; all but the first of a role are other pairs.

        A run of other pairs is one, so that lines of many fields share shapes. A message without quotes goes to the
        line's end unless nothing but pairs follows its first word. Text that is no pair is message, with all after it.
        A line begins an entry by its time, or by a level beside a message; else it has no shape.
        """
        kinds: list[str] = []
        spans: list[tuple[int, int]] = []
        at = 0
        while m := _NEXT_PAIR.match(text, at):
            kind, start, end = m.lastgroup, m.start(m.lastgroup), m.end()
            if kind == "KVM":
                quoted = _QUOTED.match(text, end)
                end = (quoted or _UNBROKEN.match(text, end)).end()
                if not quoted and not _REST_OF_PAIRS.fullmatch(text, end):
                    end = len(text)
            if kind == "KV_" or kind in kinds:
                kind = "KVO"
            if kind == "KVO" and kinds and kinds[-1] == "KVO":
                spans[-1] = (spans[-1][0], end)
            else:
                kinds.append(kind), spans.append((start, end))
            at = end
        if not ("KVT" in kinds or "KVL" in kinds and "KVM" in kinds):
            return ("TEXT",), [(0, len(text))]
        if run := _RUN.match(text, at):
            kinds.append("TEXT"), spans.append((run.start(1), len(text)))
        return tuple(kinds), spans

    def shape(self, kinds: tuple[str, ...]) -> tuple:
        """What the best parse of these kinds says: (layout, captured places, skipped places); parsed once. Every line has
        one, as a continuation if nothing else."""
        if kinds not in self.shapes:
            if len(self.shapes) >= self.most:
                self.shapes.clear()
            best = GRAMMAR.parse(kinds)
            self.shapes[kinds] = best and (best.layout, tuple(best.captured.items()), best.skipped)
        return self.shapes[kinds]

    def line(self, raw: str, file: str | None) -> tuple[int, str | None, int | None, str | None, str | None, int | None, list[tuple[int, int]]]:
        """(role, layout, time, level, source, where the message begins, unparsed spans), all by the text without colours."""
        text = raw[:-1] if raw.endswith("\r") else raw
        if "\x1b" in text:
            text = _ANSI.sub("", text)
        if not text:
            return MORE, None, None, None, None, None, []
        kinds, spans, pairs = self.tokens(text)
        layout, captured, skipped = self.shape(kinds)
        if layout == "LINE_CONTINUED":
            return MORE, None, None, None, None, None, [(0, len(text))]
        ts = level = source = None
        body = len(text)
        for name, i in captured:
            if pairs:
                key, value = pairs[i]
                if name == "ts":
                    ts = self.value_time(key, value)
                elif name == "lvl":
                    level = _level(value)
                else:
                    source = value if isinstance(value, str) else None
                continue
            a, b = spans[i]
            token = text[a:b]
            if name == "ts":
                ts = self.time(kinds[i], token, file)
                if kinds[i] == "GLT":
                    level = _level(token[0])
            elif name == "lvl":
                level = _level(token.strip("[]: ").split("=", 1)[-1])
            elif name == "pri":
                level = SEVERITIES[int(token[1 : token.index(">")]) & 7]
            elif name == "modlvl":
                module, _, word = token[1:-1].rpartition(":")
                level, source = _level(word), module
            elif name == "body":
                body = a
            elif name == "loc":
                source = token.rpartition(":")[0]
            elif name == "src":
                source = token.split("=", 1)[1].strip('"') if kinds[i] == "KVS" else token[:-1] if kinds[i] == "TAG" else token[: token.rindex("[")] if kinds[i] == "TAGPID" else token
        role = _LINE_ROLES.get(layout, HEAD)
        return role, layout, ts, None if level == "unknown" else level, source, None if role != HEAD or pairs else body, [spans[i] for i in skipped]


_PARSED = "file string, line_no bigint, role int, layout string, ts_ms bigint, level string, source string, body int, unparsed array<struct<start:int,end:int>>"
_ARROW = pa.schema(
    [("file", pa.string()), ("line_no", pa.int64()), ("role", pa.int32()), ("layout", pa.string()), ("ts_ms", pa.int64()), ("level", pa.string()), ("source", pa.string()), ("body", pa.int32()), ("unparsed", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))]
)


def _parser(years: dict[str, int], spans: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parser = LineParser(years)
        line = parser.line
        for batch in batches:
            files = batch.column(0).to_pylist()
            parsed = [line(raw or "", file) for raw, file in zip(batch.column(2).to_pylist(), files, strict=True)]
            columns = list(zip(*parsed, strict=True)) or [[]] * 7
            gaps = [[{"start": a, "end": b} for a, b in g] for g in columns[6]] if spans else None
            lasts = pa.array(gaps, _ARROW.field("unparsed").type) if spans else pa.nulls(len(files), _ARROW.field("unparsed").type)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array(c, f.type) for c, f in zip(columns[:6], list(_ARROW)[2:8], strict=True)], lasts], schema=_ARROW)

    return over


#: More files than this mean that the lookup is not one of sources.
MOST_FILES = 1_000_000


def parse_lines(lines: DataFrame, sources: DataFrame | None = None, spans: bool = True) -> DataFrame:
    """Each line's role (1 begins an entry, 2 opens an object of several lines, 3 a member and 4 the end of one, 0 goes on),
    layout, time, level, source, place of its message and unparsed spans. A narrow pass: no shuffle.

    lines: file, line_no, raw; a null raw is an empty line. sources: file, log_year, for times without a year;
    it is one small row a file, held by every task, and more than ``MOST_FILES`` rows are refused.
    """
    years: dict[str, int] = {}
    if sources is not None:
        rows = sources.where("file IS NOT NULL AND log_year IS NOT NULL").groupBy("file").agg(F.min("log_year").alias("y")).limit(MOST_FILES + 1).collect()
        if len(rows) > MOST_FILES:
            raise ValueError(f"sources has more than {MOST_FILES} files")
        years = {r[0]: r[1] for r in rows}
    return lines.select("file", F.col("line_no").cast("bigint").alias("line_no"), "raw").mapInArrow(_parser(years, spans), _PARSED)


def log_entries(lines: DataFrame, sources: DataFrame | None = None, stretch: int = STRETCH) -> DataFrame:
    """(file, line_no, last_line_no, ts_ms, level, source, layout): one row per entry.

    lines: file, line_no, raw; further columns are ignored. A line delivered several times counts once. ts_ms is 0 and
    level ``unknown`` and source empty where the entry states none outside its message. Lines before a file's first
    entry belong to none and are left out; so are rows without line_no. A null file is a file of its own. An empty
    table gives an empty one.
    """
    parsed = parse_lines(lines.where("line_no IS NOT NULL"), sources, spans=False).drop("body", "unparsed")
    block = F.floor(F.col("line_no") / F.lit(stretch)).cast("bigint")
    # text is not shuffled, only what was read from it
    placed = parsed.withColumn("block", block).repartition("file", "block")
    within = Window.partitionBy("file", "block").orderBy("line_no", F.col("role").desc())
    begins = F.col("role").isin(HEAD, OPEN)
    once = placed.withColumn("again", F.lag("line_no").over(within) == F.col("line_no")).where("again IS NULL OR NOT again").drop("again")
    marked = once.withColumn("start", F.last(F.when(begins, F.col("line_no")), True).over(within)).withColumn("closed", F.min(F.when(F.col("role") == CLOSE, F.col("line_no"))).over(Window.partitionBy("file", "block", "start")))
    # members count in an object's own lines, up to its end
    inside = (F.col("role") == MEMBER) & (F.coalesce(F.col("closed"), F.col("line_no")) >= F.col("line_no"))
    first = lambda c, cond: F.min_by(F.when(cond & F.col(c).isNotNull(), F.col(c)), F.when(cond & F.col(c).isNotNull(), F.col("line_no")))
    groups = marked.groupBy("file", "block", "start").agg(
        F.max("line_no").alias("last"), F.max(F.when(begins, F.col("role"))).alias("kind"), F.min("closed").alias("closed"), F.max(F.when(begins, F.col("layout"))).alias("layout"),
        *[first(c, begins).alias(f"h_{c}") for c in ("ts_ms", "level", "source")],
        *[first(c, inside).alias(f"m_{c}") for c in ("ts_ms", "level", "source")],
    )
    # the last entry of a stretch may go on in the next ones; those edges, two a stretch at most, meet by file
    edge = F.col("start").isNull() | (F.col("start") == F.max("start").over(Window.partitionBy("file", "block")))
    slotted = groups.withColumn("slot", F.when(edge, F.lit(-1)).otherwise(F.col("block")))
    by_file = Window.partitionBy("file", "slot").orderBy("block", F.col("start").asc_nulls_first())
    owned = slotted.withColumn("line_no", F.when(F.col("slot") >= 0, F.col("start")).otherwise(F.last("start", True).over(by_file)))
    begun = F.col("start").isNotNull()
    open_object = lambda c: F.when(F.max(F.when(begun, F.col("kind"))) == OPEN, F.min_by(c, F.when(F.col(c).isNotNull(), F.col("block"))))
    joined = owned.where("line_no IS NOT NULL").groupBy("file", "slot", "line_no").agg(
        F.max("last").alias("last_line_no"), F.max("layout").alias("layout"),
        *[F.coalesce(F.max(f"h_{c}"), open_object(f"m_{c}")).alias(c) for c in ("ts_ms", "level", "source")],
    )
    return joined.select("file", "line_no", "last_line_no", F.coalesce("ts_ms", F.lit(0)).cast("bigint").alias("ts_ms"), F.coalesce("level", F.lit("unknown")).alias("level"), F.coalesce("source", F.lit("")).alias("source"), "layout")
