"""The build domain: compile commands into units, includes and their impact, comparison."""

from __future__ import annotations

import json
import posixpath
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.operators.graph import closure

_UNIT = "file string, directory string, compiler string, includes array<string>, defines array<string>, flags array<string>, forced_includes array<string>, standard string, output string"


def split_command(command: str) -> list[str]:
    """Words of a recorded command: a backslash takes the next character as it is, inside quotes of either kind too."""
    piece = re.compile(r"""\\(.?)|([\"'])((?:\\.|(?!\2).)*)(?:\2|\Z)|(\s+)|([^\s\\"']+)""", re.S)
    words: list[str] = []
    word: str | None = None
    for m in piece.finditer(command):
        if m[4] is not None:
            if word is not None:
                words.append(word)
            word = None
        elif m[2]:
            word = (word or "") + re.sub(r"\\(.)", r"\1", m[3], flags=re.S)
        else:
            word = (word or "") + (m[5] if m[5] is not None else m[1])
    return words if word is None else [*words, word]


def normal_path(path: str, directory: str = "") -> str:
    """``.`` and ``..`` taken out of a path, which a directory goes before unless it is absolute; never above the root."""
    whole = path if path.startswith("/") or not directory else posixpath.join(directory, path)
    out: list[str] = []
    for part in whole.split("/"):
        if part in ("", "."):
            continue
        if part == ".." and out and out[-1] != "..":
            out.pop()
        elif part != ".." or not whole.startswith("/"):
            out.append(part)
    return ("/" if whole.startswith("/") else "") + "/".join(out)


def path_normalised(path: Column) -> Column:
    """The same for a column of whole paths, inside the JVM."""
    absolute = F.startswith(path, F.lit("/"))
    step = lambda acc, p: F.when(p.isin("", "."), acc).when((p == "..") & (F.size(acc) > 0) & (F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit("")) != ".."), F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0)))).when((p == "..") & absolute, acc).otherwise(F.concat(acc, F.array(p)))
    return F.concat(F.when(absolute, "/").otherwise(""), F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/"))


def parse_entry(file: str, directory: str, arguments: list[str], output: str | None) -> dict:
    """A compile command's parts; include folders keep their order, defines and flags are sorted sets."""
    unit = {"file": normal_path(file, directory), "directory": directory, "compiler": arguments[0] if arguments else "", "includes": [], "defines": set(), "flags": set(), "forced_includes": [], "standard": None, "output": output}
    include = lambda v: unit["includes"].append(normal_path(v, directory))
    with_value = {"-isystem": include, "-iquote": include, "-idirafter": include, "-include": unit["forced_includes"].append, "-imacros": unit["forced_includes"].append, "-isysroot": lambda v: None, "-I": include, "-D": unit["defines"].add, "-o": lambda v: unit.update(output=v)}
    rest = iter(arguments[1:])
    for word in rest:
        option = next((o for o in with_value if word.startswith(o)), None)
        if word.startswith("-std="):
            unit["standard"] = word[5:]
        elif option:
            value = word[len(option) :] or next(rest, None)
            if value is not None:
                with_value[option](value)
        elif word.startswith("-") and word != "-c":
            unit["flags"].add(word)
    unit["includes"] = list(dict.fromkeys(unit["includes"]))
    unit["defines"], unit["flags"] = sorted(unit["defines"]), sorted(unit["flags"])
    return unit


def parse_commands(entries: DataFrame) -> DataFrame:
    """Units of compile-command entries (directory, file, command or arguments, output); nulls are empty."""
    has = set(entries.columns)
    rows = entries.select("directory", "file", "command" if "command" in has else F.lit(None).cast("string").alias("command"), F.to_json("arguments").alias("arguments") if "arguments" in has else F.lit(None).cast("string").alias("arguments"), "output" if "output" in has else F.lit(None).cast("string").alias("output"))

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        strings = pa.list_(pa.string())
        kinds = {"includes": strings, "defines": strings, "flags": strings, "forced_includes": strings}
        names = re.findall(r"(\w+) (?:string|array)", _UNIT)
        for b in batches:
            units = [parse_entry(f or "", d or "", json.loads(a) if a else split_command(c or ""), o or None) for d, f, c, a, o in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([u[n] for u in units], kinds.get(n, pa.string())) for n in names], names=names)

    return rows.mapInArrow(over, _UNIT)


_INCLUDE = re.compile(r"^[ \t]*#[ \t]*include(?:_next)?[ \t]*(?:\"([^\"\n]+)\"|<([^>\n]+)>)", re.M)
_CODE = re.compile(r'//[^\n]*|/\*.*?(?:\*/|\Z)|"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])*\'', re.S)


def includes_of(source: str) -> list[tuple[str, bool]]:
    """(name, quoted) of each include of a source text, comments aside; one inside a string is none."""
    clean = _CODE.sub(lambda m: m[0] if m[0][0] in "\"'" else re.sub(r"[^\n]", " ", m[0]), source)
    return [(m[1] or m[2], m[1] is not None) for m in _INCLUDE.finditer(clean)]


def extract_includes(sources: DataFrame) -> DataFrame:
    """(path, seq, name, quoted) of source texts (path, text)."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(p, i, n, q) for p, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for i, (n, q) in enumerate(includes_of(t or ""))]
            c = list(zip(*rows, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c[0], pa.string()), pa.array(c[1], pa.int32()), pa.array(c[2], pa.string()), pa.array(c[3], pa.bool_())], names=["path", "seq", "name", "quoted"])

    return sources.select("path", "text").mapInArrow(over, "path string, seq int, name string, quoted boolean")


def resolve_includes(includes: DataFrame, search: DataFrame, files: DataFrame) -> DataFrame:
    """(src, dst): the file each include means: beside the including file if quoted, else the first folder that has it.

    includes: path, name, quoted, unit; search: unit, place, folder; files: path."""
    beside = includes.where("quoted").select("unit", "path", "name", F.lit(-1).alias("place"), path_normalised(F.concat(F.regexp_replace("path", r"[^/]*\z", ""), F.col("name"))).alias("dst"))
    there = includes.join(search, "unit").select("unit", "path", "name", "place", path_normalised(F.concat_ws("/", "folder", "name")).alias("dst"))
    known = beside.unionByName(there).join(files.select(F.col("path").alias("dst")).distinct(), "dst", "left_semi")
    return known.groupBy("unit", "path", "name").agg(F.min_by("dst", "place").alias("dst")).select(F.col("path").alias("src"), "dst").distinct()


def impact(edges: DataFrame, headers: DataFrame | None = None) -> DataFrame:
    """(origin, node): what is rebuilt when a header changes, along reversed include edges; for all headers unless given."""
    return closure(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")), headers)


def header_hints(files: DataFrame, name: str, most: int = 5) -> DataFrame:
    """At most five known headers with the same last name; a hint, not a result."""
    return files.where(F.element_at(F.split("path", "/"), -1) == name.rsplit("/", 1)[-1]).select("path").orderBy("path").limit(most)


def referenced_paths(units: DataFrame) -> DataFrame:
    """(path): every path that reading a compilation database makes a reader look at."""
    all_ = F.concat(F.array("file"), F.coalesce("includes", F.array().cast("array<string>")), F.transform(F.coalesce("forced_includes", F.array().cast("array<string>")), lambda p: F.when(F.startswith(p, F.lit("/")), p).otherwise(F.concat_ws("/", "directory", p))))
    return units.select(F.explode(all_).alias("path")).where("path IS NOT NULL").select(path_normalised(F.col("path")).alias("path")).distinct()


def diff_units(before: DataFrame, after: DataFrame, order: str = "seq") -> DataFrame:
    """Per file: change, and what was added to and removed from includes, defines and flags (compiler and standard
    count as flags where they differ), and whether the list of forced includes changed. Of several entries for one
    file the last by ``order`` holds."""
    last = lambda df: df.withColumn("__n", F.row_number().over(Window.partitionBy("file").orderBy(F.desc(order)))).where("__n = 1") if order in df.columns else df.dropDuplicates(["file"])
    empty = F.array().cast("array<string>")
    side = lambda df, p: last(df).select("file", *[F.coalesce(c, empty).alias(f"{p}_{c}") for c in ("includes", "defines", "flags", "forced_includes")], F.col("compiler").alias(f"{p}_compiler"), F.col("standard").alias(f"{p}_standard"), F.lit(True).alias(f"__{p}"))
    j = side(before, "b").join(side(after, "a"), "file", "full_outer")
    for c in ("includes", "defines", "flags", "forced_includes"):
        j = j.withColumn(f"b_{c}", F.coalesce(f"b_{c}", empty)).withColumn(f"a_{c}", F.coalesce(f"a_{c}", empty))
    differs = lambda c: ~F.col(f"b_{c}").eqNullSafe(F.col(f"a_{c}"))
    folded = lambda p, prefix, c: F.when(F.col("__b") & F.col("__a") & differs(c) & F.col(f"{p}_{c}").isNotNull(), F.array(F.concat(F.lit(prefix), F.col(f"{p}_{c}")))).otherwise(empty)
    for p in ("b", "a"):
        j = j.withColumn(f"{p}_all", F.concat(f"{p}_flags", folded(p, "-std=", "standard"), folded(p, "compiler=", "compiler")))
    sets = [F.array_sort(F.array_except(f"{y}_{c}", f"{x}_{c}")).alias(f"{n}_{m}") for c, m in (("includes", "includes"), ("defines", "defines"), ("all", "flags")) for n, x, y in (("added", "b", "a"), ("removed", "a", "b"))]
    out = j.select("file", F.when(F.col("__b").isNull(), "added").when(F.col("__a").isNull(), "removed").otherwise("modified").alias("change"), *sets, differs("forced_includes").alias("forced_includes_changed"))
    same = F.lit(True)
    for m in ("includes", "defines", "flags"):
        same = same & (F.size(f"added_{m}") == 0) & (F.size(f"removed_{m}") == 0)
    return out.where((F.col("change") != "modified") | ~same | F.col("forced_includes_changed"))
