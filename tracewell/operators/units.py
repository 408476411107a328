"""The service-unit domain: files into ordered assignments, drop-ins, references, ordering graph, comparison.

The long table of assignments (unit, path, precedence, seq, line, section, key, value) is the model everywhere.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tracewell.errors import LimitExceeded
from tracewell.operators.graph import DRIVER_EDGES, components, cycle_path
from tracewell.session import cut_lineage

# Suffixes of unit files, keys that an empty value does not reset, keys whose values are references.
SUFFIXES = [".service", ".socket", ".target", ".timer", ".mount", ".automount", ".swap", ".path", ".slice", ".scope"]
DEPENDENCY_KEYS = ["Wants", "Requires", "Before", "After", "Requisite", "BindsTo", "PartOf", "Conflicts", "Upholds"]
REFERENCE_KEYS = ["Wants", "Requires", "Before", "After"]
CHECKED_SUFFIXES = [".service", ".socket", ".target", ".timer", ".mount"]
MOST_UNITS, MOST_DEPTH, LONGEST_NAME = 10_000, 32, 255

_ENTRIES = "unit string, path string, precedence int, seq bigint, line int, section string, key string, value string, diagnostic string"


def read_unit(content: str) -> list[tuple[int, int, str | None, str | None, str | None, str | None]]:
    """(seq, line, section, key, value, diagnostic) of each logical line that is an assignment or is malformed."""
    logical: list[tuple[int, str]] = []
    held, began = "", 0
    for number, physical in enumerate(content.split("\n"), 1):
        text = physical.strip()
        if text[:1] in ("#", ";"):
            continue
        more = text.endswith("\\")
        part = text[:-1].rstrip() if more else text
        if held:
            held += " " + part
        elif more:
            held, began = part, number
        elif text:
            logical.append((number, text))
        if held and not more:
            logical.append((began, held))
            held = ""
    if held:
        logical.append((began, held))
    out, section = [], ""
    for seq, (line, text) in enumerate(logical):
        text = text.strip()
        if text.startswith("["):
            inner = text[1:-1].strip()
            if not text.endswith("]") or not inner or "[" in inner or "]" in inner:
                out.append((seq, line, None, None, text, "SYNTAX_SECTION_HEADER"))
            else:
                section = inner
        elif "=" not in text:
            out.append((seq, line, section or None, None, text, "SYNTAX_GARBAGE_LINE"))
        else:
            key, _, value = (x.strip() for x in text.partition("="))
            out.append((seq, line, section or None, key, value, None if section else "SYNTAX_KEY_BEFORE_SECTION"))
    return out


def parse_units(files: DataFrame) -> DataFrame:
    """Assignments of unit files (unit, path, precedence, content); malformed lines carry a diagnostic code."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(u, p, q, *e) for u, p, q, c in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True) for e in read_unit(c or "")]
            kinds = [pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.string()]
            columns = list(zip(*rows, strict=True)) or [[]] * 9
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[f.split()[0] for f in _ENTRIES.split(", ")])

    return files.select("unit", "path", F.col("precedence").cast("int"), "content").mapInArrow(over, _ENTRIES)


def pick_providers(files: DataFrame) -> DataFrame:
    """Of the files for one unit only that of the highest precedence (the smallest number), ties by path."""
    w = Window.partitionBy("unit").orderBy("precedence", "path")
    return files.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def pick_drop_ins(drop_ins: DataFrame) -> DataFrame:
    """Drop-ins (unit, conf, precedence, path, ...) that apply: the highest precedence of each file name, in the order
    of names; one that points to ``/dev/null`` masks its name and applies nothing."""
    w = Window.partitionBy("unit", "conf").orderBy("precedence", "path")
    best = drop_ins.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
    return best.where("NOT masked").withColumn("place", F.row_number().over(Window.partitionBy("unit").orderBy("conf")))


def effective(entries: DataFrame) -> DataFrame:
    """Assignments that hold: an empty value clears what came before for its key, but for dependencies in ``Unit``.

    entries: unit, section, key, value and a total order ``seq`` within the unit, drop-ins after the main file.
    """
    resets = (F.col("value") == "") & ~((F.col("section") == "Unit") & F.col("key").isin(DEPENDENCY_KEYS))
    w = Window.partitionBy("unit", "section", "key").orderBy("seq")
    last = F.max(F.when(resets, F.col("seq"))).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    good = entries.where("diagnostic IS NULL") if "diagnostic" in entries.columns else entries
    return good.withColumn("__r", last).where((F.col("value") != "") & (F.col("__r").isNull() | (F.col("seq") > F.col("__r")))).drop("__r")


def expand_text(value: str, unit: str) -> str:
    """Specifiers of a value, left to right; unknown ones stay, and so does all of a template's."""
    stem = unit.rpartition(".")[0] or unit
    prefix, at, instance = stem.partition("@")
    if at and not instance:
        return value
    known = {"n": unit, "N": stem, "p": prefix, "P": prefix.replace("-", "/"), "i": instance, "I": instance.replace("-", "/"), "u": "root", "h": "/root", "%": "%"}
    return re.sub("%(.)", lambda m: known.get(m[1], m[0]), value)


@F.pandas_udf(StringType())
def _expanded(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
    for df in batches:
        yield pd.Series([None if v is None else expand_text(v, u or "") for v, u in zip(df["value"], df["unit"], strict=True)])


def expand_specifiers(entries: DataFrame) -> DataFrame:
    """Values with specifiers expanded; only those that hold a percent sign leave the JVM."""
    return entries.withColumn("value", F.when(F.contains("value", F.lit("%")), _expanded(F.struct("value", "unit"))).otherwise(F.col("value")))


def template_of(unit: Column) -> Column:
    """The template of an instance, null for any other name."""
    return F.when(unit.rlike(r"\A[^@]+@.+\.[a-z]+\z"), F.regexp_replace(unit, r"\A([^@]+@).+(\.[a-z]+)\z", "$1$2"))


def is_template(unit: Column) -> Column:
    return unit.rlike(r"\A[^@]+@\.[a-z]+\z")


def references(entries: DataFrame, provenance: bool = False) -> DataFrame:
    """(unit, key, target): each unit that another names, once; with provenance also path and line of the first place."""
    named = entries.where((F.col("section") == "Unit") & F.col("key").isin(REFERENCE_KEYS))
    refs = named.select("unit", "key", F.explode(F.split(F.trim("value"), r"\s+")).alias("target"), *(["path", "line"] if provenance else [])).where("target <> ''")
    if not provenance:
        return refs.distinct()
    return refs.groupBy("unit", "key", "target").agg(F.min(F.struct("path", "line")).alias("__at")).select("unit", "key", "target", "__at.path", "__at.line")


def missing_references(refs: DataFrame, units: DataFrame) -> DataFrame:
    """(unit, key, target) whose target is neither a unit nor an instance of a template that exists."""
    suffix = F.lit(False)
    for s in CHECKED_SUFFIXES:
        suffix = suffix | F.endswith("target", F.lit(s))
    names = units.select(F.col("unit").alias("__u")).distinct()
    lost = refs.where(suffix).join(names, F.col("target") == F.col("__u"), "left_anti")
    return lost.join(names, template_of(F.col("target")) == F.col("__u"), "left_anti")


def expand_instances(entries: DataFrame) -> DataFrame:
    """Assignments, with those of every instance that is referred to and whose template exists, to the end.

    Each round adds the instances that the last one brought. There is no limit on how many units or references the entries
    hold; templates that go on without end raise, by depth, by the length of names, and where one instance that is written
    out brings by itself more than MOST_UNITS others."""
    columns = [*entries.columns, "depth"]
    known = entries.withColumn("depth", F.lit(0)).withColumn("__root", F.lit(None).cast("string"))
    templates = entries.where(is_template(F.col("unit"))).withColumnRenamed("unit", "__t")
    fresh = known
    for depth in range(1, MOST_DEPTH + 1):
        # the first round brings all that is written out, so later ones only names made by specifiers
        named = references(fresh.withColumn("unit", F.coalesce("__root", "unit"))).where(template_of(F.col("target")).isNotNull())
        wanted = named.groupBy(F.col("target").alias("unit")).agg(F.min("target" if depth == 1 else "unit").alias("__root")).join(known.select("unit").distinct(), "unit", "left_anti")
        grown = wanted.withColumn("__t", template_of(F.col("unit"))).join(templates, "__t").drop("__t").withColumn("depth", F.lit(depth))
        fresh = cut_lineage(expand_specifiers(grown).select(*known.columns), eager=True)
        if fresh.isEmpty():
            return known.select(*columns)
        if fresh.where(F.length("unit") > LONGEST_NAME).limit(1).count():
            raise LimitExceeded(f"a name of an instance is longer than {LONGEST_NAME}")
        known = known.unionByName(fresh)
        if depth > 1 and known.where("depth > 1").groupBy("__root").agg(F.countDistinct("unit").alias("n")).where(F.col("n") > MOST_UNITS).limit(1).count():
            raise LimitExceeded(f"one instance brings more than {MOST_UNITS} others")
    raise LimitExceeded(f"instances nest deeper than {MOST_DEPTH}")


def ordering_edges(refs: DataFrame, aliases: DataFrame | None = None, inactive: DataFrame | None = None) -> DataFrame:
    """(src, dst, directive): src starts before dst. ``After`` is turned round; aliases are followed once; templates,
    masked units and other ``inactive`` ones take no part. References with path and line give one row an edge, with the
    first of its directives, paths and lines."""
    pairs = refs.where(F.col("key").isin("Before", "After"))
    if aliases is not None:
        a = aliases.groupBy("alias").agg(F.min("unit").alias("__to"))
        for c in ("unit", "target"):
            pairs = pairs.join(a, F.col(c) == F.col("alias"), "left").withColumn(c, F.coalesce("__to", c)).drop("alias", "__to")
    if inactive is not None:
        off = inactive.select(F.col("unit").alias("__off")).distinct()
        for c in ("unit", "target"):
            pairs = pairs.join(off, F.col(c) == F.col("__off"), "left_anti")
    pairs = pairs.where(~is_template(F.col("unit")) & ~is_template(F.col("target")))
    after = F.col("key") == "After"
    told = ["path", "line"] if "line" in refs.columns else []
    edges = pairs.select(F.when(after, F.col("target")).otherwise(F.col("unit")).alias("src"), F.when(after, F.col("unit")).otherwise(F.col("target")).alias("dst"), F.col("key").alias("directive"), *told)
    return edges.groupBy("src", "dst").agg(F.min(F.struct("directive", *told)).alias("__at")).select("src", "dst", "__at.*") if told else edges.distinct()


def cycle_paths(edges: DataFrame) -> list[list[dict]]:
    """One path round each cycle of a bounded graph, as its edges with directive, path and line."""
    rows = {(r["src"], r["dst"]): r.asDict() for r in edges.limit(DRIVER_EDGES + 1).collect()}
    if len(rows) > DRIVER_EDGES:
        raise LimitExceeded(f"more than {DRIVER_EDGES} edges")
    pairs = sorted(rows)
    around = [cycle_path(pairs, members) for members in components(pairs)]
    return [[rows[a, b] for a, b in zip(p, p[1:], strict=False)] for p in around]


def diff_meta(before: DataFrame, after: DataFrame) -> DataFrame:
    """(unit, field, before, after): what differs between units of both sides beside their assignments: masked, alias_of,
    drop_ins (in order), and the effective wants and requires (as sets), each as text.

    before and after: unit, masked, alias_of, drop_ins, wants, requires; one row a unit."""
    empty = F.array().cast("array<string>")
    as_set = lambda c: F.to_json(F.array_sort(F.array_distinct(F.coalesce(F.col(c), empty))))
    fields = {"masked": F.coalesce(F.col("masked"), F.lit(False)).cast("string"), "alias_of": F.col("alias_of"), "drop_ins": F.to_json(F.coalesce(F.col("drop_ins"), empty)), "wants": as_set("wants"), "requires": as_set("requires")}
    side = lambda df, p: df.select("unit", F.posexplode(F.array(*fields.values())).alias("place", p))
    j = side(before, "before").join(side(after, "after"), ["unit", "place"]).where(~F.col("before").eqNullSafe(F.col("after")))
    return j.select("unit", F.get(F.array(*[F.lit(f) for f in fields]), F.col("place")).alias("field"), "before", "after")


def diff_units(before: DataFrame, after: DataFrame) -> DataFrame:
    """(unit, section, key, before_values, after_values, change) of units and keys that differ; values keep their order."""
    def side(df: DataFrame, p: str) -> DataFrame:
        values = F.transform(F.array_sort(F.collect_list(F.struct("seq", "value"))), lambda x: x["value"])
        return df.groupBy("unit", "section", "key").agg(values.alias(f"{p}_values"))

    j = side(effective(before), "before").join(side(effective(after), "after"), ["unit", "section", "key"], "full_outer")
    names = before.select("unit").distinct().withColumn("__b", F.lit(1)).join(after.select("unit").distinct().withColumn("__a", F.lit(1)), "unit", "full_outer")
    change = F.when(F.col("__b").isNull(), "added").when(F.col("__a").isNull(), "removed").otherwise("modified")
    return j.where(~F.col("before_values").eqNullSafe(F.col("after_values"))).join(names, "unit").withColumn("change", change).drop("__a", "__b")
