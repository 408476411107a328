"""The Python-environment domain: versions, markers, requirements, missing and conflicting packages, shadowing."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

_VERSION = re.compile(
    r"\s*v?(?:(?P<epoch>\d+)!)?(?P<release>\d+(?:\.\d+)*)(?:[-_.]?(?P<pre>a|b|c|rc|alpha|beta|pre|preview)[-_.]?(?P<pre_n>\d+)?)?"
    r"(?P<post>-(?P<post_1>\d+)|[-_.]?(?:post|rev|r)[-_.]?(?P<post_2>\d+)?)?(?P<dev>[-_.]?dev[-_.]?(?P<dev_n>\d+)?)?(?:\+(?P<local>[a-z0-9]+(?:[-_.][a-z0-9]+)*))?\s*",
    re.I,
)
_PRE = {"alpha": "a", "beta": "b", "c": "rc", "pre": "rc", "preview": "rc"}


@dataclass(frozen=True)
class Version:
    """A version by PEP 440."""

    epoch: int
    release: tuple[int, ...]
    pre: tuple[str, int] | None
    post: int | None
    dev: int | None
    local: tuple

    @classmethod
    def parse(cls, text: str) -> "Version | None":
        m = _VERSION.fullmatch(text)
        if not m:
            return None
        pre = m["pre"] and (_PRE.get(m["pre"].lower(), m["pre"].lower()), int(m["pre_n"] or 0))
        local = tuple((1, int(p), "") if p.isdigit() else (0, 0, p.lower()) for p in re.split(r"[-_.]", m["local"])) if m["local"] else ()
        return cls(int(m["epoch"] or 0), tuple(map(int, m["release"].split("."))), pre, int(m["post_1"] or m["post_2"] or 0) if m["post"] else None, int(m["dev_n"] or 0) if m["dev"] else None, local)

    def key(self, local: bool = True) -> tuple:
        """What versions are ordered by."""
        release = self.release
        while release and release[-1] == 0:
            release = release[:-1]
        pre = (-1, "", 0) if self.pre is None and self.post is None and self.dev is not None else (1, "", 0) if self.pre is None else (0, *self.pre)
        return self.epoch, release, pre, -1 if self.post is None else self.post, float("inf") if self.dev is None else self.dev, self.local if local else ()

    @property
    def is_pre(self) -> bool:
        return self.pre is not None or self.dev is not None

    def part(self, n: int) -> tuple:
        return self.epoch, *(self.release + (0,) * n)[:n]


def _bare(spec: str) -> str | None:
    spec = spec.strip()
    if spec.startswith("(") or spec.endswith(")"):
        return spec[1:-1].strip() if spec.startswith("(") and spec.endswith(")") and len(spec) > 1 else None
    return spec


def _holds(version: Version, op: str, text: str) -> bool | None:
    star = text.endswith(".*")
    bound = Version.parse(text[:-2] if star else text)
    if bound is None or star and (op not in ("==", "!=") or bound.is_pre or bound.post is not None or bound.local) or op == "~=" and len(bound.release) < 2 or bound.local and op not in ("==", "!="):
        return None
    if star:
        same = version.part(len(bound.release)) == bound.part(len(bound.release))
        return same if op == "==" else not same
    have, want = version.key(bool(bound.local)), bound.key()
    longest = max(len(version.release), len(bound.release))
    same_base = version.part(longest) == bound.part(longest)
    if op == "~=":
        return have >= want and version.part(len(bound.release) - 1) == bound.part(len(bound.release) - 1)
    if op == "<":
        return have < want and not (not bound.is_pre and version.is_pre and same_base)
    if op == ">":
        return have > want and not (bound.post is None and version.post is not None and same_base) and not (version.local and same_base)
    return {"==": have == want, "!=": have != want, "<=": have <= want, ">=": have >= want}[op]


def version_satisfies(installed: str, spec: str) -> bool | None:
    """Whether a version meets every clause of a specifier; None if any clause cannot be judged, even after a miss."""
    bare = _bare(spec)
    if bare is None:
        return None
    if not bare:
        return True
    version, met = Version.parse(installed), True
    for clause in bare.split(","):
        m = re.fullmatch(r"(===|==|!=|~=|>=|<=|>|<|(?=\d))\s*(\S.*)", clause.strip(), re.S)
        if not m:
            return None
        op, text = m[1] or "==", m[2].strip()
        ok = installed.lower() == text.lower() if op == "===" else _holds(version, op, text) if version else None
        if ok is None:
            return None
        met = met and ok
    return met


# Variables of markers, and those of them that hold versions.
MARKER_VARIABLES = "python_version python_full_version os_name sys_platform platform_system platform_machine platform_version platform_release platform_python_implementation implementation_name implementation_version extra".split()
VERSION_VARIABLES = "python_version python_full_version implementation_version platform_version platform_release".split()
_FLIP = {"<": ">", "<=": ">=", ">": "<", ">=": "<=", "in": "contains", "not in": "not contains"}
TRUE, FALSE, UNKNOWN, ERROR = "true", "false", "unknown", "error"
_MARKER_TOKEN = re.compile(r"\s*(?:(\()|(\))|('[^']*'|\"[^\"]*\")|(===|==|~=|!=|<=|>=|<|>)|(not\s+in\b|in\b)|(and\b|or\b)|([A-Za-z_.][A-Za-z0-9_.]*))")


@dataclass(frozen=True)
class MarkerEnv:
    """The variables of an environment that are known, and the extras asked for."""

    values: dict[str, str] = field(default_factory=dict)
    extras: tuple[str, ...] = ()

    @classmethod
    def for_python(cls, version: str, extras: tuple[str, ...] = ()) -> "MarkerEnv":
        short = ".".join(version.split(".")[:2])
        return cls({"python_version": short, "python_full_version": version, "os_name": "posix", "sys_platform": "linux", "platform_system": "Linux", "platform_python_implementation": "CPython", "implementation_name": "cpython", "implementation_version": version}, tuple(normal_name(e) for e in extras))


def _both(a: str, b: str, and_: bool) -> str:
    if ERROR in (a, b):
        return ERROR
    decides = FALSE if and_ else TRUE
    if decides in (a, b):
        return decides
    return UNKNOWN if UNKNOWN in (a, b) else (TRUE if and_ else FALSE)


def _compare(actual: str, op: str, expected: str, version: bool) -> str:
    tri = lambda b: UNKNOWN if b is None else TRUE if b else FALSE
    if op in ("in", "not in"):
        return tri((actual in expected) == (op == "in"))
    if op in ("contains", "not contains"):
        return tri((expected in actual) == (op == "contains"))
    if version or op == "~=":
        return tri(version_satisfies(actual, op + expected))
    return tri({"==": actual == expected, "===": actual == expected, "!=": actual != expected, "<": actual < expected, "<=": actual <= expected, ">": actual > expected, ">=": actual >= expected}[op])


def _term(left: tuple[bool, str], op: str, right: tuple[bool, str], env: MarkerEnv) -> str:
    if left[0] and right[0]:
        return TRUE if left[1] == right[1] and op in ("==", "===") else UNKNOWN
    if not left[0] and not right[0]:
        return ERROR
    (name, value), op = ((left[1], right[1]), op) if left[0] else ((right[1], left[1]), _FLIP.get(op, op))
    if name not in MARKER_VARIABLES:
        return ERROR
    if name == "extra":
        found = [_compare(e, op, normal_name(value), False) for e in env.extras or ("",)]
        return TRUE if TRUE in found else UNKNOWN if UNKNOWN in found else FALSE
    return UNKNOWN if name not in env.values else _compare(env.values[name], op, value, name in VERSION_VARIABLES)


def evaluate_marker(text: str, env: MarkerEnv) -> str:
    """true, false or unknown, the last also for what cannot be parsed. An error inside outweighs all else; otherwise
    false and unknown is false, true or unknown is true."""
    tokens, at = [], 0
    while at < len(text.rstrip()):
        m = _MARKER_TOKEN.match(text, at)
        if not m:
            return UNKNOWN
        tokens.append((m.lastindex, re.sub(r"\s+", " ", m[m.lastindex])))
        at = m.end()
    if not tokens:
        return TRUE
    place = 0

    def peek(kind: int, word: str | None = None) -> bool:
        return place < len(tokens) and tokens[place][0] == kind and (word is None or tokens[place][1] == word)

    def atom() -> str:
        nonlocal place
        if peek(1):
            place += 1
            value = either()
            if not peek(2):
                raise ValueError
            place += 1
            return value
        parts = []
        for kinds in ((3, 7), (4, 5), (3, 7)):
            if place >= len(tokens) or tokens[place][0] not in kinds:
                raise ValueError
            parts.append(tokens[place])
            place += 1
        side = lambda t: (t[0] == 7, t[1] if t[0] == 7 else t[1][1:-1])
        return _term(side(parts[0]), parts[1][1], side(parts[2]), env)

    def all_() -> str:
        nonlocal place
        value = atom()
        while peek(6, "and"):
            place += 1
            value = _both(value, atom(), True)
        return value

    def either() -> str:
        nonlocal place
        value = all_()
        while peek(6, "or"):
            place += 1
            value = _both(value, all_(), False)
        return value

    try:
        value = either()
    except ValueError:
        return UNKNOWN
    return UNKNOWN if place != len(tokens) or value == ERROR else value


def normal_name(name: str) -> str:
    return re.sub(r"[-_.]+", "-", name).lower()


def name_normalised(name: Column) -> Column:
    return F.lower(F.regexp_replace(name, r"[-_.]+", "-"))


def read_requirement(text: str, env: MarkerEnv) -> tuple[str, str | None, str | None]:
    """(state, name, specifier): inactive, active or unevaluated."""
    m = re.match(r"""((?:[^;"']|"[^"]*"|'[^']*')*)(?:;(.*))?\Z""", text, re.S)
    head, marker = (m[1], m[2]) if m else (text, None)
    if marker is not None:
        value = evaluate_marker(marker.strip(), env)
        if value != TRUE:
            return ("inactive" if value == FALSE else "unevaluated"), None, None
    m = re.match(r"\s*([\w.-]+)\s*(\[[^\]]*\]?)?(.*)\Z", head, re.S)
    if not m or m[2] and not m[2].endswith("]"):
        return "unevaluated", None, None
    spec = _bare(m[3])
    return ("unevaluated", None, None) if spec is None else ("active", normal_name(m[1]), spec)


@F.pandas_udf(BooleanType())
def _satisfies(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    memo: dict[tuple[str, str], bool | None] = {}
    for versions, specs in batches:
        out = []
        for pair in zip(versions, specs, strict=True):
            if pair not in memo:
                memo[pair] = None if None in pair else version_satisfies(*pair)
            out.append(memo[pair])
        yield pd.Series(out, dtype=object)


def satisfies(version: Column, spec: Column) -> Column:
    """PEP 440 matching of columns; null where it cannot be judged."""
    return _satisfies(version, spec)


def parse_metadata(files: DataFrame) -> DataFrame:
    """(env, name, norm_name, version, summary, requires_dist) of METADATA texts (env, text): the headers up to the first
    blank line; files without a name and a version describe no package and are left out."""
    head = F.regexp_replace(F.substring_index(F.regexp_replace("text", r"\r\n", "\n"), "\n\n", 1), r"\n[ \t]+", " ")
    df = files.withColumn("__h", head)
    one = lambda k: F.nullif(F.trim(F.regexp_extract("__h", rf"(?im)^{k}:[ \t]*(.*)$", 1)), F.lit(""))
    every = F.transform(F.regexp_extract_all("__h", F.lit(r"(?im)^Requires-Dist:[ \t]*(.*)$"), F.lit(1)), lambda x: F.trim(x))
    return df.select("env", one("Name").alias("name"), name_normalised(one("Name")).alias("norm_name"), one("Version").alias("version"), one("Summary").alias("summary"), every.alias("requires_dist")).where("name IS NOT NULL AND version IS NOT NULL")


def check_dependencies(packages: DataFrame, env: MarkerEnv) -> DataFrame:
    """(env, package, requirement, state): missing, conflict or unevaluated requirements, each once.

    packages: env, name, norm_name, version, requires_dist."""
    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, tuple] = {}
        for b in batches:
            texts = b.column(2).to_pylist()
            for t in texts:
                if t not in memo:
                    memo[t] = read_requirement(t, env)
            yield pa.RecordBatch.from_arrays([*b.columns, *[pa.array([memo[t][i] for t in texts], pa.string()) for i in range(3)]], names=["env", "package", "requirement", "__s", "__n", "__v"])

    wanted = packages.select("env", F.col("name").alias("package"), F.explode("requires_dist").alias("requirement")).where("requirement IS NOT NULL").distinct().mapInArrow(over, "env string, package string, requirement string, __s string, __n string, __v string")
    have = packages.groupBy("env", F.col("norm_name").alias("__n")).agg(F.max("version").alias("version"))
    j = wanted.where("__s <> 'inactive'").join(have, ["env", "__n"], "left")
    ok = F.when(F.col("version").isNotNull() & (F.col("__v") != ""), satisfies(F.col("version"), F.col("__v"))).otherwise(F.lit(True))
    j = j.withColumn("__ok", ok)
    state = F.when(F.col("__s") == "unevaluated", "unevaluated").when(F.col("version").isNull(), "missing").when(F.col("__ok").isNull(), "unevaluated").when(~F.col("__ok"), "conflict")
    return j.withColumn("state", state).where("state IS NOT NULL").select("env", "package", "requirement", "state")


def top_level_modules(dists: DataFrame) -> DataFrame:
    """(env, name, modules): from top_level.txt, else the first parts of RECORD's paths, else the name itself.

    dists: env, name, top_level (text or null), record (text or null)."""
    listed = F.filter(F.transform(F.split(F.coalesce("top_level", F.lit("")), "\n"), lambda x: F.trim(x)), lambda x: x != "")
    parts = F.transform(F.split(F.coalesce("record", F.lit("")), "\n"), lambda x: F.regexp_replace(F.substring_index(F.substring_index(x, ",", 1), "/", 1), r"\.py\z", ""))
    recorded = F.array_distinct(F.filter(parts, lambda x: (x != "") & ~x.rlike(r"\.(?:dist-info|data|pth|egg-info)\z|\A(?:\.\.|__pycache__)\z")))
    own = F.array(F.regexp_replace(F.lower("name"), "[-.]", "_"))
    return dists.select("env", "name", F.array_sort(F.when(F.size(listed) > 0, listed).when(F.size(recorded) > 0, recorded).otherwise(own)).alias("modules"))


def shadowing(local: DataFrame, stdlib: DataFrame, installed: DataFrame, own: DataFrame) -> DataFrame:
    """(env, module, shadows): local modules that hide a standard one, else an installed one; those of the project's own
    packages do not count. local: env, module; stdlib: module; installed: env, module, name; own: env, name."""
    std = local.join(stdlib.select("module").distinct(), "module", "left_semi").select("env", "module", F.lit("stdlib").alias("shadows"))
    others = installed.join(own.select("env", name_normalised(F.col("name")).alias("__o")).distinct().withColumnRenamed("env", "__e"), (F.col("env") == F.col("__e")) & (name_normalised(F.col("name")) == F.col("__o")), "left_anti")
    rest = local.join(std.select("env", "module"), ["env", "module"], "left_anti").join(others.groupBy("env", "module").agg(F.min("name").alias("shadows")), ["env", "module"]).select("env", "module", "shadows")
    return std.unionByName(rest).distinct()


def diff_environments(before: DataFrame, after: DataFrame) -> DataFrame:
    """(norm_name, before_version, after_version, change): versions compare as text."""
    side = lambda df, p: df.groupBy("norm_name").agg(F.max("version").alias(f"{p}_version"))
    j = side(before, "before").join(side(after, "after"), "norm_name", "full_outer")
    change = F.when(F.col("before_version").isNull(), "added").when(F.col("after_version").isNull(), "removed").when(F.col("before_version") != F.col("after_version"), "changed")
    return j.withColumn("change", change).where("change IS NOT NULL")
