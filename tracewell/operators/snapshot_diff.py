"""What changed between full snapshots: added, removed and changed records of each pair of neighbouring snapshots.

Each record's key is mapped to an ordinal that it keeps in all snapshots of its scope. :func:`key_ordinals` gives the
table of ordinals that is stored between deliveries, so a later or late one never renumbers; without a stored table
keys are numbered by first appearance. A snapshot is a compressed bitmap of ordinals: AND-NOT of
neighbours gives additions and removals. The compared values are vectors aligned by ordinal, and what differs
among common ordinals has changed.

A scope with more rows than ``rows_per_part`` is split by a hash of the key into as many parts as that takes, so
no task ever holds a hot scope whole; snapshot numbers, which decide what neighbours are, are known to every part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.functions.addresses import shortest_ipv6
from tracewell.operators.bitmaps import OrdinalBitmap

RESULT = "tbl string, scope string, snapshot_no bigint, record_key string, change string"
ROWS_PER_PART = 200_000


def _differences(snapshots: np.ndarray, ordinals: np.ndarray, values: np.ndarray, named: np.ndarray) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For one part of a scope: (snapshot_no, place of the key's name, change) of each difference.

    Rows come ordered by snapshot, key and value; values are codes, named says which rows are records (the others only
    say that their snapshot exists). Of several values for one key in one snapshot the last holds.
    """
    numbers = np.unique(snapshots)
    records = np.flatnonzero(named)
    if len(numbers) < 2 or not len(records):
        return []
    # vectors are aligned by ordinal: slot i of each belongs to the i-th ordinal that this part has
    aligned, name, slot = np.unique(ordinals[records], return_index=True, return_inverse=True)
    name = records[name]
    bounds = np.searchsorted(snapshots[records], numbers, side="left").tolist() + [len(records)]
    out = []
    before, vector_before = None, None
    for i, number in enumerate(numbers):
        mine = slice(bounds[i], bounds[i + 1])
        now, vector = OrdinalBitmap.of(aligned[slot[mine]]), np.zeros(len(aligned), np.int64)
        vector[slot[mine]] = values[records[mine]]
        if before is not None:
            common = np.searchsorted(aligned, now.and_(before).ordinals())
            for change, which in (("added", np.searchsorted(aligned, now.and_not(before).ordinals())), ("removed", np.searchsorted(aligned, before.and_not(now).ordinals())), ("changed", common[vector[common] != vector_before[common]])):
                if len(which):
                    out.append((np.full(len(which), number), name[which], np.full(len(which), change, dtype=object)))
        before, vector_before = now, vector
    return out


def _by_appearance(keys: np.ndarray) -> np.ndarray:
    """Ordinals of the keys of one part in the order of first appearance."""
    _, first, code = np.unique(keys, return_index=True, return_inverse=True)
    ordinal = np.empty(len(first), np.int64)
    ordinal[np.argsort(first, kind="stable")] = np.arange(len(first))
    return ordinal[code]


def _codes(column: pa.ChunkedArray) -> np.ndarray:
    """Equal values get equal codes; null gets -1."""
    indices = column.combine_chunks().dictionary_encode().indices
    return indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by part and, in a part, by snapshot and key; a part may reach over several batches."""
    held: list[pa.RecordBatch] = []

    def settle(table: pa.Table) -> Iterator[pa.RecordBatch]:
        if not table.num_rows:
            return
        part = np.stack([_codes(table["tbl"]), _codes(table["scope"]), table["part"].to_numpy()])
        edges = [0, *(np.flatnonzero((part[:, 1:] != part[:, :-1]).any(axis=0)) + 1).tolist(), table.num_rows]
        snapshots, named = table["snapshot_no"].to_numpy(), table["record_key"].is_valid().to_numpy()
        keys, values = _codes(table["record_key"]), _codes(table["value"])
        kept = table["ordinal"].combine_chunks().fill_null(-1).to_numpy(zero_copy_only=False)
        numbers, rows, changes = [], [], []
        for a, b in zip(edges, edges[1:], strict=False):
            # all records of a part have a kept ordinal or none has
            ordinals = kept[a:b] if (kept[a:b] >= 0).any() else _by_appearance(keys[a:b])
            for number, row, change in _differences(snapshots[a:b], ordinals, values[a:b], named[a:b]):
                numbers.append(number), rows.append(row + a), changes.append(change)
        if rows:
            found = table.take(pa.array(np.concatenate(rows)))
            yield pa.RecordBatch.from_arrays(
                [found["tbl"].combine_chunks(), found["scope"].combine_chunks(), pa.array(np.concatenate(numbers), pa.int64()), found["record_key"].combine_chunks(), pa.array(np.concatenate(changes), pa.string())],
                names=["tbl", "scope", "snapshot_no", "record_key", "change"],
            )

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        # the last part of the batch may go on in the next one
        last = [batch.column(c)[batch.num_rows - 1] for c in range(3)]
        at, low = batch.num_rows, 0
        while low < at:
            mid = (low + at) // 2
            same = all(batch.column(c)[mid].as_py() == last[c].as_py() for c in range(3))
            at, low = (mid, low) if same else (at, mid + 1)
        whole = pa.Table.from_batches([*held[:-1], batch.slice(0, low)]) if low else None
        if whole is not None:
            yield from settle(whole)
            held = [batch.slice(low)]
    if held:
        yield from settle(pa.Table.from_batches(held))


_SCOPE = ["tbl", "scope"]


def _known(rows: DataFrame) -> DataFrame:
    return rows.where("tbl IS NOT NULL AND scope IS NOT NULL AND snapshot_no IS NOT NULL").withColumn("snapshot_no", F.col("snapshot_no").cast("bigint"))


def _part(parts: Column) -> Column:
    return F.pmod(F.xxhash64("record_key"), F.coalesce(parts, F.lit(1))).cast("int")


def key_ordinals(rows: DataFrame, kept: DataFrame | None = None, rows_per_part: int = ROWS_PER_PART) -> DataFrame:
    """(tbl, scope, parts, part, record_key, ordinal): a persistent ordinal for every key, to be stored with the delivery.

    rows as in :func:`diff_snapshots`. kept is the table of earlier deliveries: its keys keep their ordinals and its
    scopes their number of parts, whatever is delivered later or late; new keys get the numbers after the greatest of
    their part, by first snapshot and key. Ordinals count from 0 in each part of a scope.
    """
    known = _known(rows)
    keys = known.where("record_key IS NOT NULL").groupBy("tbl", "scope", "record_key").agg(F.min("snapshot_no").alias("seen"))
    sized = known.groupBy(*_SCOPE).agg(F.ceil(F.count(F.lit(1)) / F.lit(rows_per_part)).cast("int").alias("parts"))
    if kept is None:
        fresh, top = keys.join(sized, _SCOPE), None
    else:
        stored = kept.groupBy(*_SCOPE).agg(F.max("parts").alias("stored"))
        fresh = keys.join(kept.select("tbl", "scope", "record_key"), ["tbl", "scope", "record_key"], "left_anti").join(sized.join(stored, _SCOPE, "left").select(*_SCOPE, F.coalesce("stored", "parts").alias("parts")), _SCOPE)
        top = kept.groupBy(*_SCOPE, "part").agg((F.max("ordinal") + 1).alias("top"))
    placed = fresh.withColumn("part", _part(F.col("parts")))
    numbered = placed.withColumn("n", F.row_number().over(Window.partitionBy(*_SCOPE, "part").orderBy("seen", "record_key")).cast("bigint") - 1)
    if top is None:
        return numbered.select(*_SCOPE, "parts", "part", "record_key", F.col("n").alias("ordinal"))
    new = numbered.join(top, [*_SCOPE, "part"], "left").select(*_SCOPE, "parts", "part", "record_key", (F.col("n") + F.coalesce("top", F.lit(0))).alias("ordinal"))
    return kept.select(new.columns).unionByName(new)


def diff_snapshots(rows: DataFrame, rows_per_part: int = ROWS_PER_PART, ordinals: DataFrame | None = None) -> DataFrame:
    """Differences between each snapshot and the next existing one of the same scope.

    rows: tbl, scope, snapshot_no, record_key, value; a null record_key says that the snapshot exists and adds no
    record. Further columns are ignored. Repeated rows count once; of several values for one key in one snapshot the
    greatest holds, null being the least. Rows with a null tbl, scope or snapshot_no belong to no snapshot and are left
    out. The first snapshot of a scope yields nothing; an empty table gives an empty result.

    ordinals: the stored table of :func:`key_ordinals` with all keys of rows; without it keys are numbered here, by
    first appearance.
    """
    known = _known(rows)
    # which snapshots exist, and how large scopes are: a scan of their numbers alone, summed up before its small shuffle
    exist = known.groupBy("tbl", "scope", "snapshot_no").agg(F.count(F.lit(1)).alias("n"))
    records = known.where("record_key IS NOT NULL").select("tbl", "scope", "snapshot_no", "record_key", "value")
    if ordinals is None:
        scopes = exist.groupBy(*_SCOPE).agg(F.collect_list("snapshot_no").alias("numbers"), F.ceil(F.sum("n") / F.lit(rows_per_part)).cast("int").alias("parts"))
        # few scopes are large; the list of those is joined by whatever way its size suggests to the optimizer
        placed = records.join(scopes.where("parts > 1").select(*_SCOPE, "parts"), _SCOPE, "left").withColumn("part", _part(F.col("parts"))).withColumn("ordinal", F.lit(None).cast("bigint"))
    else:
        stored = ordinals.groupBy(*_SCOPE).agg(F.max("parts").alias("parts"))
        scopes = exist.groupBy(*_SCOPE).agg(F.collect_list("snapshot_no").alias("numbers")).join(stored, _SCOPE)
        placed = records.join(ordinals.select(*_SCOPE, "record_key", "part", "ordinal"), ["tbl", "scope", "record_key"])
    nothing = F.lit(None).cast("string")
    columns = ["tbl", "scope", "part", "snapshot_no", "record_key", "value", "ordinal"]
    known_to = scopes.select(*_SCOPE, F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "numbers").select(*_SCOPE, "part", F.explode("numbers").alias("snapshot_no"), nothing.alias("record_key"), nothing.alias("value"), F.lit(None).cast("bigint").alias("ordinal"))
    dealt = placed.select(columns).unionByName(known_to).repartition("tbl", "scope", "part").sortWithinPartitions(*columns[:-1])
    return dealt.mapInArrow(_parts, RESULT)


def listener_records(sockets: DataFrame) -> DataFrame:
    """Listeners as ``kind|address|port``; rows of any other kind or state only say that the snapshot exists."""
    kind, state = F.lower(F.trim("kind")), F.upper(F.trim("state"))
    address = F.when(kind == "tcp6", shortest_ipv6(F.col("local_address"))).otherwise(F.trim("local_address"))
    listening = F.coalesce(kind.isin("tcp", "tcp6") & (state == "LISTEN"), F.lit(False))
    key = F.when(listening, F.concat_ws("|", kind, F.coalesce(address, F.lit("")), F.coalesce(F.col("local_port").cast("string"), F.lit(""))))
    return sockets.select(F.lit("sockets").alias("tbl"), F.col("host").alias("scope"), "snapshot_no", key.alias("record_key"), F.lit(None).cast("string").alias("value"))


def unit_records(units: DataFrame) -> DataFrame:
    """Build units by file; compiler, standard, the sets of includes, defines and flags and the list of forced includes are compared."""
    as_set = lambda c: F.array_sort(F.array_distinct(F.coalesce(F.col(c), F.array().cast("array<string>"))))
    value = F.to_json(F.struct(F.col("compiler").alias("c"), F.col("standard").alias("s"), as_set("includes").alias("i"), as_set("defines").alias("d"), as_set("flags").alias("f"), F.coalesce("forced_includes", F.array().cast("array<string>")).alias("o")))
    # a digest of what is compared: it is what gets shuffled
    return units.select(F.lit("compile_units").alias("tbl"), F.col("project").alias("scope"), "snapshot_no", F.col("file").alias("record_key"), F.md5(value).alias("value"))


def section_records(entries: DataFrame) -> DataFrame:
    """Report sections of bundles: the entries ``reports/<name>.json`` by their name, a leading ``./`` aside; other
    entries only say that the bundle exists."""
    name = F.regexp_replace(F.trim("name"), r"\A(?:\./)+", "")
    return entries.select(F.lit("bundle_entries").alias("tbl"), F.col("host").alias("scope"), "snapshot_no", F.when(name.rlike(r"\Areports/[^/]+\.json\z"), name).alias("record_key"), F.lower(F.trim("sha256")).alias("value"))
