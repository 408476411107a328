"""One diff kernel for every domain: two keyed tables, one full outer join, one classification."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def diff(before: DataFrame, after: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """keys, ``before_v`` and ``after_v`` of each value, and ``change``: added, removed, changed or same.

    Keys and values compare null-safe: null is a key like any other and equals itself. Repeated keys on a side meet
    every row of the other side with that key, so sides should have one row a key where that is not wanted.
    """
    side = lambda df, name: df.select(*keys, *[F.col(v).alias(f"{name}_{v}") for v in values], F.lit(True).alias(f"__{name}"))
    a, b = side(before, "before").alias("a"), side(after, "after").alias("b")
    on = None
    for k in keys:
        term = F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}"))
        on = term if on is None else on & term
    joined = a.join(b, on, "full_outer")
    same = F.lit(True)
    for v in values:
        same = same & F.col(f"before_{v}").eqNullSafe(F.col(f"after_{v}"))
    change = F.when(F.col("__before").isNull(), "added").when(F.col("__after").isNull(), "removed").when(same, "same").otherwise("changed")
    return joined.select(*[F.coalesce(F.col(f"a.{k}"), F.col(f"b.{k}")).alias(k) for k in keys], *[f"before_{v}" for v in values], *[f"after_{v}" for v in values], change.alias("change"))


def only_in(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of left whose keys right lacks; repeated rows stay. Null keys equal one another."""
    r = right.select(*[F.col(k).alias(f"__{k}") for k in keys]).distinct()
    on = None
    for k in keys:
        term = F.col(k).eqNullSafe(F.col(f"__{k}"))
        on = term if on is None else on & term
    return left.join(r, on, "left_anti")


def set_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """The columns of both, and ``change``: each distinct row that only one side has, added or removed."""
    one_way = lambda x, y, change: x.select(*before.columns).subtract(y.select(*before.columns)).withColumn("change", F.lit(change))
    return one_way(after, before, "added").unionByName(one_way(before, after, "removed"))


# Verdicts on compatibility, mildest first.
COMPATIBILITY = ["compatible", "uncertain", "incompatible"]


def worst(verdict: Column) -> Column:
    """The worst of a group's verdicts; compatible where there is none."""
    rank = F.array_position(F.array(*[F.lit(v) for v in COMPATIBILITY]), verdict)
    return F.element_at(F.array(*[F.lit(v) for v in COMPATIBILITY]), F.coalesce(F.nullif(F.max(rank), F.lit(0)), F.lit(1)).cast("int"))
