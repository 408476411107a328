"""Mixing sources to target weights: raked token weights, calibrated sampling, shares as reached.

Sizes are tokens of a public tokenizer. The corpus is summed up into cells of source, language and topic. For each
recipe, iterative proportional fitting rakes the cells' token weights to the source targets and to the language and
topic shares of the recipe's own pool, within the cap on repeats. A document's expected number of copies is its
cell's weight over the cell's tokens; whole copies are certain, the remainder is drawn by a hash, and one threshold a
source, read from a histogram of bounded size, calibrates the draw. Documents that stand next to the threshold, a bounded
number a source, are then taken one by one where they still fit, so a long one at the cut does not miss the target.

Topics come from the texts: centres of clusters of hashed token counts, less the mean of the text's language, fitted on all
documents in passes over their kept counts; every document goes to the nearest one. Only sums per cell, centre and language,
histograms of fixed size and the documents next to thresholds come to the driver. Tokens are counted once and kept by a
checkpoint.
"""

from __future__ import annotations

import base64
import os
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracewell.session import cut_lineage

TOKENIZER_DIR = "/opt/tokenizers"
RANKS = "byte_bpe_multi_50k.tiktoken"
# Fixed value: the pattern that splits text before the merges of the rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Topics are clusters of the texts, so many that the number of cells does not grow with the corpus.
TOPICS = 16
#: Token counts are hashed into so many places to tell topics.
PLACES = 512
#: Vectors are summed up in whole parts of this, so sums do not depend on how rows are dealt out.
PARTS = 1 << 30
#: The languages with the most tokens keep cells and a mean of their own, all others share one.
MOST_LANGUAGES = 64
MOST_SOURCES = 2000
BINS = 1024
#: Documents next to a threshold that are taken one by one, for each source of a recipe.
MOST_NEAR = 500


def _encoding(tokenizer_dir: str, ranks: str) -> bytes:
    with open(os.path.join(tokenizer_dir, ranks), "rb") as f:
        return f.read()


def _tokenizer(vocabulary: bytes) -> object:
    import tiktoken

    merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=merges, special_tokens={})


def _hashed(tokens: list[list[int]]) -> np.ndarray:
    """Hashed token counts of texts."""
    own = np.repeat(np.arange(len(tokens)), [len(t) for t in tokens])
    ids = np.fromiter(chain.from_iterable(tokens), np.int64, len(own))
    return np.bincount(own * PLACES + ids * 2654435761 % PLACES, minlength=len(tokens) * PLACES).reshape(-1, PLACES)


def _damped(counts: np.ndarray) -> np.ndarray:
    """Counts damped and of length 1."""
    return np.sqrt(counts) * _scale(counts.sum(axis=1))[:, None]


def _scale(sizes: np.ndarray) -> np.ndarray:
    """What makes damped counts of texts of so many tokens of length 1."""
    return 1 / np.sqrt(np.maximum(sizes, 1))


def _of_length_1(rows: np.ndarray) -> np.ndarray:
    return rows * (1 / np.maximum(np.sqrt(np.einsum("ij,ij->i", rows, rows)), 1e-9))[:, None]


def _coded(languages: pa.Array, codes: dict[str, int]) -> np.ndarray:
    """The code of each language, for those without one the number of codes."""
    one = languages.dictionary_encode()
    return np.array([codes.get(lang, len(codes)) for lang in one.dictionary.to_pylist()], int)[one.indices.to_numpy()]


@dataclass
class Topics:
    """Centres of topics, and the mean of each language's texts, which is taken off first."""

    centres: np.ndarray
    means: dict[str, np.ndarray]
    rest: np.ndarray

    def apart(self, damped: np.ndarray, languages: pa.Array) -> np.ndarray:
        means = np.vstack([*self.means.values(), self.rest])[_coded(languages, {lang: i for i, lang in enumerate(self.means)})]
        return np.subtract(damped, means, out=means)

    def nearest(self, damped: np.ndarray, languages: pa.Array) -> np.ndarray:
        return np.argmax(self.apart(damped, languages) @ self.centres.T, axis=1)

    def of(self, tokens: list[list[int]], languages: list[str]) -> list[int]:
        """The nearest centre of each text; 0 for a text without tokens."""
        if not tokens or not len(self.centres):
            return [0] * len(tokens)
        return self.nearest(_damped(_hashed(tokens)), pa.array(languages, pa.string())).tolist()


def _sums(rows: np.ndarray, own: np.ndarray, groups: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums of rows by group in parts, and rows of each group. Floats hold whole numbers of this size exactly."""
    parts = rows * PARTS
    return (np.eye(groups)[own].T @ np.rint(parts, out=parts)).astype(np.int64), np.bincount(own, minlength=groups)


def _farthest(topics: Topics, damped: np.ndarray, languages: pa.Array, ids: np.ndarray) -> tuple[int, int, bytes]:
    """(nearness, id, row) of the text least near to all centres, ties by id and row."""
    rows = _of_length_1(topics.apart(damped, languages))
    near = np.rint((rows @ topics.centres.T).max(axis=1) * 1e9).astype(np.int64) if len(topics.centres) else np.zeros(len(rows), np.int64)
    last = np.flatnonzero(near == near.min())
    last = last[ids[last] == ids[last].min()]
    return int(near[last[0]]), int(ids[last[0]]), min(rows[i].tobytes() for i in last)


def _fitted(sizes: dict[str, int], summed: Callable, farthest: Callable, topics: int, rounds: int) -> Topics:
    """Spherical k-means over texts less their language's mean, begun with texts far from each other.

    sizes: texts of each language. ``summed(f, groups)`` gives sums over all texts of the rows that f makes, and their
    number, by the groups it gives; ``farthest(topics)`` the row of :func:`_farthest` over all texts."""
    whole = sum(sizes.values())
    found = Topics(np.empty((0, PLACES)), {}, np.zeros(PLACES))
    if not whole:
        return found
    names = [lang for lang, n in sorted(sizes.items(), key=lambda x: (-x[1], x[0]))[:MOST_LANGUAGES] if n >= 10]
    group = {lang: i for i, lang in enumerate(names)}
    sums, _ = summed(lambda damped, languages: (damped, _coded(languages, group)), len(names) + 1)
    found = Topics(found.centres, {lang: sums[i] / PARTS / sizes[lang] for lang, i in group.items()}, sums.sum(axis=0) / PARTS / whole)
    while len(found.centres) < min(topics, whole):
        found = replace(found, centres=np.vstack([found.centres, farthest(found)]))
    for _ in range(rounds):
        now = found

        def owned(damped: np.ndarray, languages: pa.Array, now: Topics = now) -> tuple[np.ndarray, np.ndarray]:
            rows = _of_length_1(now.apart(damped, languages))
            return rows, np.argmax(rows @ now.centres.T, axis=1)

        sums, sizes_ = summed(owned, len(now.centres))
        found = replace(now, centres=_of_length_1(np.where(sizes_[:, None] > 0, sums / PARTS, now.centres)))
        if np.array_equal(found.centres, now.centres):
            break
    return found


def fit_topics(tokens: list[list[int]], languages: list[str], topics: int = TOPICS, rounds: int = 20) -> Topics:
    """Topics of texts in memory; :func:`topics_of` gives the same over a table."""
    rows = [i for i, t in enumerate(tokens) if t]
    damped, langs = _damped(_hashed([tokens[i] for i in rows])), pa.array([languages[i] for i in rows], pa.string())
    sizes = Counter(langs.to_pylist())
    return _fitted(sizes, lambda f, groups: _sums(*f(damped, langs), groups), lambda t: np.frombuffer(_farthest(t, damped, langs, np.array(rows))[2]), topics, rounds)


def _classed(documents: DataFrame) -> DataFrame:
    lang = F.regexp_extract(F.lower(F.trim("lang")), r"\A([a-z]{2,3})(?:[-_].*)?\z", 1)
    return documents.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("bigint").alias("doc_id"), _source("source").alias("source"), F.coalesce(F.nullif(lang, F.lit("")), F.lit("und")).alias("lang"), "text")


_COUNTED = "doc_id bigint, source string, lang string, n_tokens bigint, places binary, counts binary, more binary"


def _binary(data: np.ndarray, lengths: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.binary(), len(lengths), [None, pa.py_buffer(np.r_[0, np.cumsum(lengths)].astype(np.int32)), pa.py_buffer(np.ascontiguousarray(data))])


def _packed(counts: np.ndarray) -> list[pa.Array]:
    """Hashed counts as bits of the places that have any, a byte each, and four more bytes for those of 255 or more."""
    any_, many = counts > 0, counts >= 255
    return [_binary(np.packbits(any_, axis=1), np.full(len(counts), PLACES // 8)), _binary(np.minimum(counts[any_], 255).astype(np.uint8), any_.sum(axis=1)), _binary(counts[many].astype("<u4"), many.sum(axis=1) * 4)]


def _joined(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all values, and how many each has."""
    column = column.cast(pa.binary())
    _, ends, data = column.buffers()
    ends = np.frombuffer(ends, np.int32)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(data or b"", np.uint8)[ends[0] : ends[-1]], np.diff(ends)


def _unpacked(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Parts of a batch of counted documents, small enough for a core's cache, with their damped counts."""
    for at in range(0, batch.num_rows, 250):
        part = batch.slice(at, 250)
        counts, lengths = _joined(part.column("counts"))
        more = _joined(part.column("more"))[0]
        values = counts.astype(float)
        if len(more):
            values[counts == 255] = np.frombuffer(more.tobytes(), "<u4")
        out = np.zeros((part.num_rows, PLACES))
        out.ravel()[np.flatnonzero(np.unpackbits(_joined(part.column("places"))[0]).view(bool))] = np.sqrt(values) * np.repeat(_scale(part.column("n_tokens").to_numpy()), lengths)
        yield part, out


def with_counts(documents: DataFrame, tokenizer_dir: str = TOKENIZER_DIR, ranks: str = RANKS) -> DataFrame:
    """(doc_id, source, lang, n_tokens, places, counts, more): each document's classes in one spelling, the size of its whole
    text, and its hashed token counts, packed.

    The vocabulary is read on the driver and sent to the tasks; it is about one megabyte."""
    vocabulary = _encoding(tokenizer_dir, ranks)

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _tokenizer(vocabulary).encode_ordinary
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                tokens = [encode(t) if t else [] for t in part.column(3).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(list(map(len, tokens)), pa.int64()), *_packed(_hashed(tokens))], names=[c.split()[0] for c in _COUNTED.split(", ")])

    return _classed(documents).mapInArrow(over, _COUNTED)


def topics_of(counted: DataFrame, topics: int = TOPICS, rounds: int = 20) -> Topics:
    """Topics fitted on all documents of :func:`with_counts` that have tokens, in ``topics + rounds + 1`` passes.

    Each task sums up its documents; by centre or language these sums are added on executors, so the driver gets one
    row of PLACES numbers for each."""
    rows = counted.where("n_tokens > 0").select("doc_id", "lang", "n_tokens", "places", "counts", "more")
    sizes = {r[0]: r[1] for r in rows.groupBy("lang").count().collect()}  # names have two or three letters

    def summed(f: Callable, groups: int) -> tuple[np.ndarray, np.ndarray]:
        kind = "k int, n bigint, sums binary"

        def told(sums: dict[int, np.ndarray], n: dict[int, int]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([int(n[k]) for k in sums], pa.int64()), pa.array([sums[k].tobytes() for k in sums], pa.binary())], names=["k", "n", "sums"])

        def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums, n = np.zeros((groups, PLACES), np.int64), np.zeros(groups, np.int64)
            for batch in batches:
                for part, damped in _unpacked(batch):
                    more = _sums(*f(damped, part.column("lang")), groups)
                    sums += more[0]
                    n += more[1]
            have = np.flatnonzero(n).tolist()
            yield told({k: sums[k] for k in have}, dict(enumerate(n)))

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[int, np.ndarray] = {}
            n: dict[int, int] = defaultdict(int)
            for batch in batches:
                for k, more, own in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                    sums[k] = sums.get(k, 0) + np.frombuffer(own, np.int64)
                    n[k] += more
            yield told(sums, n)

        sums, n = np.zeros((groups, PLACES), np.int64), np.zeros(groups, np.int64)
        for r in rows.mapInArrow(over, kind).repartition("k").mapInArrow(add, kind).collect():
            sums[r["k"]], n[r["k"]] = np.frombuffer(r["sums"], np.int64), r["n"]
        return sums, n

    def farthest(found: Topics) -> np.ndarray:
        def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best = None
            for batch in batches:
                for part, damped in _unpacked(batch):
                    one = _farthest(found, damped, part.column("lang"), part.column("doc_id").to_numpy())
                    best = one if best is None else min(best, one)
            if best is not None:
                yield pa.RecordBatch.from_arrays([pa.array([best[0]], pa.int64()), pa.array([best[1]], pa.int64()), pa.array([best[2]], pa.binary())], names=["near", "doc_id", "row"])

        return np.frombuffer(rows.mapInArrow(over, "near bigint, doc_id bigint, row binary").orderBy("near", "doc_id", "row").limit(1).collect()[0]["row"])

    return _fitted(sizes, summed, farthest, topics, rounds)


def with_topics(counted: DataFrame, topics: Topics | None = None) -> DataFrame:
    """(doc_id, source, lang, topic, n_tokens) of :func:`with_counts`; without topics all documents have topic 0, and so have
    those without tokens."""
    if topics is None or not len(topics.centres):
        return counted.select("doc_id", "source", "lang", F.lit(0).alias("topic"), "n_tokens")

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, damped in _unpacked(batch):
                sizes = part.column("n_tokens").to_numpy()
                own = np.where(sizes > 0, topics.nearest(damped, part.column("lang")), 0)
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(own, pa.int32()), part.column("n_tokens")], names=["doc_id", "source", "lang", "topic", "n_tokens"])

    return counted.mapInArrow(over, "doc_id bigint, source string, lang string, topic int, n_tokens bigint")


def with_tokens(documents: DataFrame, tokenizer_dir: str = TOKENIZER_DIR, ranks: str = RANKS, topics: Topics | None = None) -> DataFrame:
    """(doc_id, source, lang, topic, n_tokens): size of each document's whole text, and its classes in one spelling.

    documents: doc_id, text, source, lang; further columns are ignored. A null source is the empty one, a null or
    unreadable language ``und``. Null and empty texts have no tokens; without topics all documents have topic 0.
    """
    return with_topics(with_counts(documents, tokenizer_dir, ranks), topics)


def _source(name: str) -> Column:
    return F.coalesce(F.lower(F.trim(name)), F.lit(""))


def rake(tokens: np.ndarray, caps: np.ndarray, source: np.ndarray, others: list[np.ndarray], wanted: np.ndarray, rounds: int = 50, close: float = 1e-9) -> np.ndarray:
    """Token weights of cells, between 0 and tokens * caps, whose sums by source are ``wanted`` (which must be possible),
    and whose shares in each of the other classifications come as near to those of the pool as the caps allow."""
    total, most = wanted.sum(), tokens * caps
    if total <= 0:
        return np.zeros(len(tokens))
    weights = tokens.astype(float)
    pools = [np.bincount(o, tokens) / tokens.sum() * total for o in others]
    for _ in range(rounds):
        before = weights
        for codes, pool in ((source, wanted), *zip(others, pools, strict=True)):
            sums = np.bincount(codes, weights, len(pool))
            weights = np.minimum(most, weights * np.divide(pool, sums, out=np.zeros(len(pool)), where=sums > 0)[codes])
        if np.abs(weights - before).max() <= close * total:
            break
    for s in np.flatnonzero(wanted > 0):  # sources come last and exactly: scale below the caps
        mine = np.flatnonzero(source == s)
        seed, top = np.where(weights[mine] > 0, weights[mine], 1e-9 * most[mine]), most[mine]
        low, high = 0.0, 1.0
        while np.minimum(top, high * seed).sum() < wanted[s] * (1 - 1e-12) and high < 1e18:
            low, high = high, high * 2
        for _ in range(200):
            mid = (low + high) / 2
            low, high = (mid, high) if np.minimum(top, mid * seed).sum() < wanted[s] else (low, mid)
        weights[mine] = np.minimum(top, high * seed)
    weights[wanted[source] <= 0] = 0
    return weights


def attainable(tokens: dict[str, float], targets: dict[str, tuple[float, int]], total: float | None) -> dict[str, float]:
    """Tokens wanted of each source. Sources without text get none, their share going to the others by weight.

    With no total, it is the largest at which every source that has text can meet its share. With a larger total than
    that, a source gives what its cap allows and the rest is spread over the others by weight.
    """
    open_ = {s: w for s, (w, cap) in targets.items() if w > 0 and cap > 0 and tokens.get(s, 0) > 0}
    most = {s: tokens[s] * targets[s][1] for s in open_}
    if not open_:
        return {}
    rest = min(most[s] / (w / sum(open_.values())) for s, w in open_.items()) if total is None else min(total, sum(most.values()))
    wanted: dict[str, float] = {}
    while open_:
        whole = sum(open_.values())
        full = [s for s, w in open_.items() if rest * w / whole >= most[s]]
        if not full:
            return wanted | {s: rest * w / whole for s, w in open_.items()}
        for s in full:
            wanted[s] = most[s]
            open_.pop(s)
        rest -= sum(most[s] for s in full)
    return wanted


def pool(tokens: dict[str, float], targets: dict[str, tuple[float, int]]) -> float:
    """Tokens of all sources that a recipe may take from."""
    return sum(tokens.get(s, 0) for s, (w, cap) in targets.items() if w > 0 and cap > 0)


class Mix(NamedTuple):
    """What :func:`mix_sources` gives."""

    selection: DataFrame
    report: DataFrame
    marginals: DataFrame


def mix_sources(documents: DataFrame, targets: DataFrame, total_tokens: float | None = None, tokenizer_dir: str = TOKENIZER_DIR, seed: int = 42, of_pool: float | None = None) -> Mix:
    """(selection, report, marginals).

    selection: recipe, doc_id, source, n_tokens, copies - each document of a recipe's selection with how often it is
    used, at least once and at most max_repeats times. report: recipe, source, target_share, reached_share, tokens,
    documents, most_copies, pool_tokens, left_out_tokens, capped - one row for each source of each recipe, with a share
    of 0 for sources without text; capped says that the source gives all that its cap allows and falls short of its
    share, left_out_tokens how much of its text no copy uses. marginals: recipe, dimension (``lang`` or ``topic``), value,
    pool_share, reached_share - what the raking held and what came out.

    documents as in :func:`with_tokens`; targets: recipe, source, target_weight, max_repeats, the weights relative
    within a recipe. Repeated target rows count once; of conflicting ones the largest weight and smallest cap hold.
    ``of_pool`` gives the total of each recipe as a multiple of its pool's tokens, in place of ``total_tokens``.
    Null or negative weights and null caps count as 0. Documents of other sources, and those without tokens, are not
    selected. Repeated document rows are separate pieces of text. The same seed gives the same selection.
    """
    spark = documents.sparkSession
    rows = targets.where("recipe IS NOT NULL").groupBy("recipe", _source("source").alias("source")).agg(F.max("target_weight").alias("w"), F.min("max_repeats").alias("cap")).limit(MOST_SOURCES + 1).collect()
    if len(rows) > MOST_SOURCES:
        raise ValueError(f"more than {MOST_SOURCES} recipe sources")
    recipes: dict[str, dict[str, tuple[float, int]]] = defaultdict(dict)
    for r in rows:
        recipes[r["recipe"]][r["source"]] = (max(0.0, r["w"] or 0.0), max(0, r["cap"] or 0))
    names = sorted({s for r in recipes.values() for s in r})
    wanted_rows = documents.where(_source("source").isin(names))
    counted = cut_lineage(with_counts(wanted_rows, tokenizer_dir).where("n_tokens > 0"), eager=True)
    sized = cut_lineage(with_topics(counted, topics_of(counted)), eager=True)
    languages = [r[0] for r in sized.groupBy("lang").agg(F.sum("n_tokens").alias("n")).orderBy(F.desc("n"), "lang").limit(MOST_LANGUAGES - 1).collect()]
    classed = sized.withColumn("lang", F.when(F.col("lang").isin(languages), F.col("lang")).otherwise("rest"))
    cells = classed.groupBy("source", "lang", "topic").agg(F.sum("n_tokens").alias("n")).collect()  # at most sources x 64 x 16
    by_source: dict[str, float] = defaultdict(float)
    for c in cells:
        by_source[c["source"]] += c["n"]
    plan: list[tuple] = []
    goals: dict[tuple[str, str], float] = {}
    for recipe, wants in sorted(recipes.items()):
        wanted = attainable(by_source, wants, total_tokens if of_pool is None else of_pool * pool(by_source, wants))
        goals |= {(recipe, s): n for s, n in wanted.items()}
        mine = [c for c in cells if wanted.get(c["source"], 0) > 0]
        if not mine:
            continue
        order = sorted(wanted)
        code = lambda key: np.unique([c[key] for c in mine], return_inverse=True)[1]  # noqa: E731, B023
        tokens, caps = np.array([c["n"] for c in mine], float), np.array([wants[c["source"]][1] for c in mine], float)
        weights = rake(tokens, caps, np.array([order.index(c["source"]) for c in mine]), [code("lang"), code("topic")], np.array([wanted[s] for s in order]))
        plan += [(c["source"], c["lang"], c["topic"], recipe, float(min(w / t, k)), int(k)) for c, w, t, k in zip(mine, weights, tokens, caps, strict=True)]
    rates = spark.createDataFrame(plan, "source string, lang string, topic int, recipe string, rate double, cap int")
    drawn = (F.pmod(F.xxhash64("doc_id", "recipe", F.lit(seed)), F.lit(1 << 30)) + 0.5) / float(1 << 30)
    # the table of rates has at most recipe sources x 64 x 16 rows, so each task may hold it
    offered = classed.join(F.broadcast(rates), ["source", "lang", "topic"]).withColumn("sure", F.floor("rate").cast("int")).withColumn("v", drawn - (F.col("rate") - F.col("sure"))).withColumn("open", F.col("sure") < F.col("cap"))
    bin_ = F.when(F.col("open"), F.least(F.floor((F.col("v") + 1) / 2 * BINS), F.lit(BINS - 1)).cast("int"))
    sums = offered.groupBy("recipe", "source", bin_.alias("bin")).agg(F.sum("n_tokens").alias("n"), F.count(F.lit(1)).alias("d"), F.sum(F.col("n_tokens") * F.col("sure")).alias("kept")).collect()  # at most recipe sources x 1025
    kept: dict[tuple[str, str], float] = defaultdict(float)
    bins: dict[tuple[str, str], np.ndarray] = defaultdict(lambda: np.zeros((2, BINS)))
    for r in sums:
        key = (r["recipe"], r["source"])
        kept[key] += r["kept"]
        if r["bin"] is not None:
            bins[key][:, r["bin"]] += r["n"], r["d"]
    cuts, missing = [], {}
    for key, goal in sorted(goals.items()):
        run = np.r_[0.0, np.cumsum(bins[key][0])] + kept[key]
        cut = max(int(np.searchsorted(run, goal, side="right")) - 1, 0)
        # from the cut on, bins are taken one by one as long as few enough documents stand in them
        reach = cut + int(np.searchsorted(np.cumsum(bins[key][1][cut:]), MOST_NEAR, side="right"))
        missing[key] = goal - run[cut]
        cuts.append((*key, cut / BINS * 2 - 1, reach / BINS * 2 - 1))
    limits = spark.createDataFrame(cuts, "recipe string, source string, cut double, reach double")
    limited = offered.join(F.broadcast(limits), ["recipe", "source"])
    near = limited.where("open AND v >= cut AND v < reach").groupBy("recipe", "source", "doc_id", "v").agg(F.sum("n_tokens").alias("n")).collect()  # at most recipe sources x 500
    picked = []
    for r in sorted(near, key=lambda r: (r["recipe"], r["source"], r["v"], r["doc_id"])):
        # what is nearer to the goal with than without
        if r["n"] <= 2 * missing[r["recipe"], r["source"]]:
            missing[r["recipe"], r["source"]] -= r["n"]
            picked.append((r["recipe"], r["doc_id"], r["v"], True))
    extra = spark.createDataFrame(picked, "recipe string, doc_id bigint, v double, picked boolean")
    chosen = limited.join(F.broadcast(extra), ["recipe", "doc_id", "v"], "left").withColumn("copies", F.col("sure") + F.when(F.col("open") & ((F.col("v") < F.col("cut")) | F.col("picked")), 1).otherwise(0))
    taken = chosen.where("copies > 0").select("recipe", "doc_id", "source", "lang", "topic", "n_tokens", "copies")
    selection = taken.select("recipe", "doc_id", "source", "n_tokens", "copies")
    whole = {r: sum(w for w, _ in t.values()) for r, t in recipes.items()}
    asked = [(r, s, w / whole[r] if whole[r] else 0.0, int(by_source.get(s, 0)), bool(0 < goals.get((r, s), 0) >= by_source[s] * cap * (1 - 1e-9) and goals[r, s] < w / whole[r] * sum(goals.get((r, x), 0) for x in t) * (1 - 1e-9))) for r, t in sorted(recipes.items()) for s, (w, cap) in sorted(t.items())]
    asked = spark.createDataFrame(asked, "recipe string, source string, target_share double, pool_tokens bigint, capped boolean")
    used = taken.groupBy("recipe", "source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens"), F.sum("n_tokens").alias("once"), F.count(F.lit(1)).alias("documents"), F.max("copies").alias("most_copies"))
    totals = used.groupBy("recipe").agg(F.sum("tokens").alias("all_tokens"))
    zero = F.lit(0)
    report = asked.join(used, ["recipe", "source"], "left").join(totals, "recipe", "left").select(
        "recipe", "source", "target_share", (F.coalesce(F.col("tokens") / F.col("all_tokens"), F.lit(0.0))).alias("reached_share"), F.coalesce("tokens", zero).alias("tokens"), F.coalesce("documents", zero).alias("documents"), F.coalesce("most_copies", zero).alias("most_copies"),
        "pool_tokens", (F.col("pool_tokens") - F.coalesce("once", zero)).alias("left_out_tokens"), "capped",
    )
    pools = [(recipe, dimension, str(c[dimension]), float(c["n"])) for recipe, wants in sorted(recipes.items()) for dimension in ("lang", "topic") for c in cells if goals.get((recipe, c["source"]), 0) > 0]
    parts = lambda df, n: df.groupBy("recipe", "dimension", "value").agg(F.sum(n).alias(n)).withColumn(n, F.col(n) / F.sum(n).over(Window.partitionBy("recipe", "dimension")))  # noqa: E731 - sums of cells
    reached = taken.select("recipe", F.inline(F.array(F.struct(F.lit("lang").alias("dimension"), F.col("lang").alias("value")), F.struct(F.lit("topic").alias("dimension"), F.col("topic").cast("string").alias("value")))), (F.col("n_tokens") * F.col("copies")).cast("double").alias("reached_share"))
    held = parts(spark.createDataFrame(pools, "recipe string, dimension string, value string, pool_share double"), "pool_share")
    marginals = held.join(parts(reached, "reached_share"), ["recipe", "dimension", "value"], "left").fillna(0.0, ["reached_share"])
    return Mix(selection, report, marginals)
