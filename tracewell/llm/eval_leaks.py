"""Evaluation items that leaked into training text, found in an FM-index of each shard.

Texts are reduced to what counts (case, marks, compatible forms, spacing and invisible characters do not). A shard's
documents become one text over the alphabet of the items: a word that no item has, or a run of such words, is one
separator, which no phrase contains. Every phrase of ``least`` consecutive words of an item is searched backwards
through ranks in a wavelet matrix, occurrences are located by sampled suffix positions, and overlapping ones merge
into removal spans. Items of languages without word spaces are searched letter by letter in an index of their own.
A shard is at most ``shard_symbols`` long, so memory does not grow with the corpus; items are a fixed set whose phrases
are built once a worker (about 5 kB an item of a hundred words), and more than ``most_items`` are refused. One narrow
pass: no shuffle but for repeated results.
"""

from __future__ import annotations

import hashlib
import re
import sys
import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.llm.fm_index import FmIndex

LEAST_WORDS, LEAST_LETTERS = 12, 24
LETTER_LANGUAGES = ("zh",)
SHARD_SYMBOLS = 2_000_000
#: With their spans, texts are held until their shard is searched, at most so many characters.
SHARD_CHARACTERS = 64_000_000
MOST_ITEMS = 50_000
SEPARATOR = 1

_WORD = re.compile(r"[^\W_]+")
_ASCII_WORD = re.compile(r"[a-z0-9]+")


@cache
def _uncounted() -> tuple[re.Pattern[str], re.Pattern[str]]:
    """Marks and invisible characters (combining marks, format characters, fillers that show nothing), of the basic plane
    and beyond it. Apart, since a class of the basic plane alone is matched by a table."""
    gone = [c for c in range(sys.maxunicode + 1) if not 0xD800 <= c < 0xE000 and unicodedata.category(chr(c)) in ("Mn", "Mc", "Me", "Cf")]
    gone += [0x115F, 0x1160, 0x3164, 0xFFA0]

    def pattern(codes: list[int]) -> re.Pattern[str]:
        ranges: list[list[int]] = []
        for c in sorted(codes):
            if ranges and c == ranges[-1][1] + 1:
                ranges[-1][1] = c
            else:
                ranges.append([c, c])
        return re.compile("[" + "".join(f"{re.escape(chr(a))}-{re.escape(chr(b))}" for a, b in ranges) + "]+")

    return pattern([c for c in gone if c < 0x10000]), pattern([c for c in gone if c >= 0x10000])


_BEYOND = re.compile("[\U00010000-\U0010ffff]")


def _counted(text: str) -> str:
    basic, beyond = _uncounted()
    text = basic.sub("", text)
    return beyond.sub("", text) if _BEYOND.search(text) else text


def reduced(text: str) -> str:
    """A text with compatible forms made the same, in one case, without marks and invisible characters."""
    if text.isascii():
        return text.lower()
    return unicodedata.normalize("NFKD", _counted(unicodedata.normalize("NFKD", text)).casefold())


def words(text: str) -> list[str]:
    """The longest runs of letters and digits of a text, reduced."""
    return _ASCII_WORD.findall(text.lower()) if text.isascii() else _WORD.findall(reduced(text))


def letters(text: str) -> str:
    """The letters and digits of a text, reduced, and nothing between them."""
    return "".join(words(text))


def counted_places(text: str, by_letter: bool) -> tuple[list[str], list[tuple[int, int]]]:
    """The units (words, or letters) of a text and where each stands in it, in code points of the original."""
    units: list[str] = []
    places: list[tuple[int, int]] = []
    joined = False
    for i, c in enumerate(text):
        piece = reduced(c)
        if not piece:
            continue
        for p in piece:
            if not p.isalnum():
                joined = False
            elif joined and not by_letter:
                units[-1] += p
                places[-1] = (places[-1][0], i + 1)
            else:
                units.append(p), places.append((i, i + 1))
                joined = not by_letter
    return units, places


class _Phrases:
    """The phrases of a set of items over their own alphabet."""

    def __init__(self, items: list[tuple[int, list[str] | str]], least: int) -> None:
        known = sorted({u for _, units in items for u in units})
        self.codes = {u: i + 2 for i, u in enumerate(known)}
        self.sigma, self.least = len(known) + 2, least
        rows = [(n, i) for n, (_, units) in enumerate(items) for i in range(len(units) - least + 1)]
        coded = [np.array([self.codes[u] for u in units], np.int32) for _, units in items]
        grid = np.array([coded[n][i : i + least] for n, i in rows], np.int32).reshape(-1, least)
        # a phrase that several items share is searched once
        self.grid, self.same = np.unique(grid, axis=0, return_inverse=True) if len(grid) else (grid, np.empty(0, int))
        self.item = np.array([items[n][0] for n, _ in rows], np.int64)
        by = np.argsort(self.same.ravel(), kind="stable")
        self.owners, self.from_ = by, np.searchsorted(self.same.ravel()[by], np.arange(len(self.grid) + 1))

    def encode(self, units: list[str] | str) -> np.ndarray:
        """Codes of units; each run of unknown ones is one separator."""
        coded = self._coded(units)
        return coded[self._kept(coded)]

    def _coded(self, units: list[str] | str) -> np.ndarray:
        get = self.codes.get
        return np.fromiter((get(u, SEPARATOR) for u in units), np.int32, len(units))

    def _kept(self, coded: np.ndarray) -> np.ndarray:
        return (coded != SEPARATOR) | np.r_[True, coded[:-1] != SEPARATOR][: len(coded)]

    def spans(self, offsets: np.ndarray, units: list[str], places: list[tuple[int, int]]) -> list[tuple[int, int]]:
        """Code points of phrases that begin at offsets of the encoded units, in which runs of separators have collapsed."""
        first = np.flatnonzero(self._kept(self._coded(units)))[offsets]  # a phrase holds no separator, so its units stand together
        return [(places[i][0], places[i + self.least - 1][1]) for i in first.tolist()]

    def located(self, texts: list[np.ndarray]) -> np.ndarray:
        """Rows of the number of the text, the phrase, and the offset in the text, of all phrases that occur in the texts."""
        apart = np.array([SEPARATOR], np.int32)
        starts = np.cumsum([0, *(len(t) + 1 for t in texts)])
        index = FmIndex(np.concatenate([x for t in texts for x in (t, apart)]), self.sigma)
        which, low, high = index.search(self.grid)
        if not len(which):
            return np.empty((3, 0), np.int64)
        sizes = high - low
        rows = np.repeat(low - np.r_[0, np.cumsum(sizes)[:-1]], sizes) + np.arange(sizes.sum())
        at = index.locate(rows)
        text = np.searchsorted(starts, at, side="right") - 1
        return np.stack([text, np.repeat(which, sizes), at - starts[text]])

    def found(self, texts: list[np.ndarray], offsets: bool = False) -> np.ndarray:
        """Rows of the number of the text, the item and, if asked for, the offset, once each, of the phrases that occur in the texts."""
        hits = self.located(texts)
        hits = hits if offsets else np.unique(hits[:2], axis=1)
        shared = self.from_[hits[1] + 1] - self.from_[hits[1]]
        owner = self.owners[np.repeat(self.from_[hits[1]] - np.r_[0, np.cumsum(shared)[:-1]], shared) + np.arange(shared.sum())] if hits.size else np.empty(0, np.int64)
        return np.unique(np.stack([np.repeat(hits[0], shared), self.item[owner], *(np.repeat(h, shared) for h in hits[2:])]), axis=1)


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans in order, those that meet as one."""
    out: list[tuple[int, int]] = []
    for start, end in sorted(spans):
        if out and start <= out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((start, end))
    return out


#: Phrases of the items that this worker built last, so that its next task need not.
_BUILT: dict[str, list[tuple["_Phrases", bool, re.Pattern[str] | None]]] = {}


def _kinds(by_words: list[tuple[int, list[str]]], by_letters: list[tuple[int, str]], least_words: int, least_letters: int, name: str) -> list[tuple["_Phrases", bool, re.Pattern[str] | None]]:
    """(phrases, whether they are letters, a pattern without which no text holds one) of both kinds of items."""
    if name not in _BUILT:
        kinds: list[tuple[_Phrases, bool, re.Pattern[str] | None]] = []
        if by_words:
            kinds.append((_Phrases(by_words, least_words), False, None))
        if by_letters:
            # a phrase has no longer stretch without one of these characters; reduced text without them cannot hold one
            rare = {c for _, t in by_letters for c in t if ord(c) > 0x2E7F}
            gap = max((len(m) for _, t in by_letters for m in re.split("[" + re.escape("".join(rare)) + "]", t)), default=0) if rare else 0
            kinds.append((_Phrases(by_letters, least_letters), True, re.compile("[" + re.escape("".join(sorted(rare))) + "]") if rare and gap < least_letters else None))
        _BUILT.clear()
        _BUILT[name] = kinds
    return _BUILT[name]


def eval_leaks(documents: DataFrame, items: DataFrame, least_words: int = LEAST_WORDS, least_letters: int = LEAST_LETTERS, shard_symbols: int = SHARD_SYMBOLS, most_items: int = MOST_ITEMS, spans: bool = True, by_document: bool = False) -> DataFrame:
    """(doc_id, item_id, spans): documents in which at least ``least_words`` consecutive words of an item stand
    consecutively, or ``least_letters`` letters and digits for items of a language in ``LETTER_LANGUAGES``.

    documents: doc_id, text; items: item_id, lang, text; further columns are ignored. spans (merged, in code points
    of the text) is empty unless asked for. With ``by_document`` there is one row a document: item_id is null and the spans
    of all its items are merged. Null and empty texts hold nothing; an item shorter than a phrase can leak no phrase.
    Texts that occur under several ids are reported under each; repeated rows once. Null ids are left out.
    """
    rows = items.where("item_id IS NOT NULL AND text IS NOT NULL").select("item_id", "lang", "text").limit(most_items + 1).collect()
    if len(rows) > most_items:
        raise ValueError(f"more than {most_items} items")
    is_letter = lambda lang: (lang or "").lower().replace("_", "-").split("-")[0].strip() in LETTER_LANGUAGES
    by_words = sorted((r[0], words(r[2])) for r in rows if not is_letter(r[1]))
    by_letters = sorted((r[0], letters(r[2])) for r in rows if is_letter(r[1]))
    name = hashlib.sha256(repr((by_words, by_letters, least_words, least_letters)).encode()).hexdigest()
    spans = spans or by_document

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = _kinds(by_words, by_letters, least_words, least_letters, name)

        def settle(shard: list[tuple[int, str]], coded: list[list[tuple[int, np.ndarray]]]) -> Iterator[pa.RecordBatch]:
            pairs: dict[tuple[int, int | None], list[tuple[int, int]]] = defaultdict(list)
            for (phrases, by_letter, _), texts_of in zip(kinds, coded, strict=True):
                if texts_of and len(phrases.grid):
                    hits = phrases.found([t for _, t in texts_of], spans)
                    if not hits.size:
                        continue
                    if not spans:
                        pairs |= {(texts_of[n][0], i): [] for n, i in hits.T.tolist()}
                        continue
                    # ordered by text and item; each text that holds a phrase is walked once for the places of its units
                    at, read = np.flatnonzero(np.any(np.diff(hits[:2], axis=1, prepend=-1) != 0, axis=0)), None
                    for a, b in zip(at.tolist(), [*at[1:].tolist(), hits.shape[1]], strict=True):
                        n = texts_of[hits[0, a]][0]
                        if read is None or read[0] != n:
                            read = (n, *counted_places(shard[n][1], by_letter))
                        pairs[n, None if by_document else int(hits[1, a])] += phrases.spans(hits[2, a:b], *read[1:])
            found = list(pairs)
            where = [[{"start": a, "end": b} for a, b in merged(pairs[key])] for key in found]
            ids = [shard[n][0] for n, _ in found]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([i for _, i in found], pa.int64()), pa.array(where, _SPANS)], names=["doc_id", "item_id", "spans"])

        shard: list[tuple[int, str]] = []
        coded: list[list[tuple[int, np.ndarray]]] = [[] for _ in kinds]
        size = held = 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = words(text)
                for (phrases, by_letter, rare), own in zip(kinds, coded, strict=True):
                    units = "".join(found) if by_letter else found
                    if rare is None or rare.search(units):
                        code = phrases.encode(units)
                        if len(code) >= phrases.least:
                            own.append((len(shard), code))
                            size += len(code)
                shard.append((doc_id, text if spans else ""))
                held += len(text) if spans else 1
                if size >= shard_symbols or held >= SHARD_CHARACTERS:
                    yield from settle(shard, coded)
                    shard, coded, size, held = [], [[] for _ in kinds], 0, 0
        if shard:
            yield from settle(shard, coded)

    whole = documents.where("doc_id IS NOT NULL AND text IS NOT NULL AND text <> ''").selectExpr("CAST(doc_id AS bigint) AS doc_id", "text")
    found = whole.mapInArrow(over, "doc_id bigint, item_id bigint, spans array<struct<start:int,end:int>>")
    return found.dropDuplicates() if by_document else found.dropDuplicates(["doc_id", "item_id"])


def removal_spans(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, span_start, span_end): what to cut out of each document, in code points, from the located positions of
    phrases; spans of all items that overlap or meet are one. Else as :func:`eval_leaks`; different texts under one id
    keep the spans of each."""
    found = eval_leaks(documents, items, by_document=True)
    return found.select("doc_id", F.explode("spans").alias("s")).select("doc_id", F.col("s.start").alias("span_start"), F.col("s.end").alias("span_end")).distinct()


_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
