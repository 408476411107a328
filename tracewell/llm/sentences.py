"""Sentence units of texts in many languages and scripts.

Characters are tagged as boundary or inside by a linear-chain conditional random field and decoded with Viterbi's
algorithm. Only characters that can end a sentence (end marks with what closes after them, blanks between letters of a
script without end marks) have a choice; all others are inside. Block structure (blank lines, headings, list items,
fenced blocks) and quotation marks fix tags beforehand.

No rule and no list of abbreviations says which marks are boundaries; the texts do. Neighbouring paragraphs are joined,
for scripts without end marks after punctuation is stripped, and a paragraph's end becomes one candidate among the
others. Where paragraphs end, a sentence ends; elsewhere tags are unknown. A sure boundary is a paragraph's end at a
rate read from the texts, so a context that is common and never stands there (a title before a name, a number sign
before a number) is no boundary. The field is fitted to that evidence with the tags as hidden variables, when the query
runs, on a bounded sample. Words that open sentences in lower case, such as names of services, are counted over all
documents, each distinct text once.
"""

from __future__ import annotations

import pickle
import re
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.session import cut_lineage

#: At most so many documents are fitted on, none longer than so many characters; everything else reads every document whole.
SAMPLE_DOCUMENTS = 6000
SAMPLE_LONGEST = 20_000
SAMPLE_TASKS = 32
#: A candidate this close to the one before it has transitions of its own.
NEAR = 12
#: Of a longer run of characters before a full stop the model sees so many.
LONGEST_WORD = 80
#: Sequences are cut into stretches of so many candidates for fitting.
STRETCH = 64
#: Rates of paragraph ends are told apart for so many first candidates of a paragraph.
PLACES = 6
#: Features of single words count from so many cases on, with a stronger prior than the others.
LEAST_CASES = 10
PRIOR, WORD_PRIOR, CHAIN_PRIOR = 0.5, 1.5, 3000.0
FIRST_STEPS, STEPS = 100, 40
#: Where the prior expects weights that are not 0: without evidence a mark divides before what may open a sentence.
EXPECTED = {("opens", "opens"): 1.0, ("opens", "lower"): -1.0, ("opens", "point"): -1.0, ("opens", "other"): -1.0}
#: A word opens sentences in lower case if it does so in at least so many texts and in this share of all.
LEAST_OPENED, SHARE_OPENED = 3, 0.003

# Quotation marks in pairs.
QUOTES = {"“": "”", "„": "“", "«": "»", "‹": "›", "「": "」", "『": "』", "《": "》", "‘": "’", "‚": "‘", '"': '"'}

#: End marks; not those that lower-case letters or digits follow at once, as in names of files and addresses.
_MARKS = r"[.!?…]*+[。！？｡।॥؟۔][.!?…。！？｡।॥؟۔]*+|[.!?…]++(?![a-z0-9_/])|[;\u037e](?=\s)"
_END = re.compile(_MARKS)
#: Letters of scripts that divide sentences by blanks: Thai and Lao.
_BARE = "[ก-ฺเ-๎ກ-ຽເ-ໝ]"
_END_OR_BLANK = re.compile(_MARKS + rf"|(?<={_BARE}) +(?={_BARE})")
_UNMARKED = re.compile(_BARE)
_CJK = re.compile(r"[぀-ヿ㐀-鿿가-힣豈-﫿ｦ-ﾟ]")
_EMOJI = re.compile(r"[ \t]*((?:[\U0001F000-\U0001FAFF☀-➿⬀-⯿←-⇿](?:[️‍\U0001F3FB-\U0001F3FF])*)+)")
_GAP = re.compile(r"(?:\s|(?<=\n)>+)*")
_QUOTE_MARK = re.compile(r"[“”„«»‹›「」『』《》‘’‚\"']")
_APOSTROPHED = re.compile(r"(?<!\w)'(?=\S)[^'\n]*(?:(?<=\w)'(?=\w)[^'\n]*)*(?<=\S)'(?!\w)")
_APART = frozenset(" \t\n\r\f\v\xa0　([{（「『“„«‹\"'`/¿¡,;:")
_NAME_WORD = re.compile(r"[\w-]+")
_OPENERS = "([{（「『“„«‹\"'`¿¡‘*_"
_CLOSERS = ")]}）】］"
_FENCE = re.compile(r"[ \t]{0,3}(?:```|~~~)")
_HEADING = re.compile(r"[ \t]{0,3}#{1,6}[ \t]")
_BULLET = re.compile(r"[ \t]*[-*+•‣◦][ \t]+")
_NUMBERED = re.compile(r"[ \t]*(?:\d{1,4}|[a-zA-Z])[.)][ \t]+")
_MAILED = re.compile(r"[ \t]{0,3}>")
_LETTER = re.compile(r"[^\W\d_]")
_OPENING = re.compile(r"(?:\A|\n[ \t]*\n|(?<=[^\W\d_]{7})\.[ \t]+|[?][ \t]+)([a-zа-яα-ω][\w-]*)(?= )")
#: Kinds of the commonest marks.
_KINDS = {".": "stop", "!": "call", "?": "question", "。": "wide", "！": "wide", "？": "wide", "।": "own", "؟": "own", "…": "pause", "...": "pause"}
#: What a unit's end may look like before a bracket opens the next one.
_ENDERS = frozenset(".!?…。！？｡।॥؟۔:" + _CLOSERS + "".join(QUOTES.values()))
#: Kinds of what follows a mark that may open a sentence, seen together as well as apart.
_OPENS = frozenset(("upper", "starter", "digit", "letter", "open"))
#: The same for the JVM.
_OPENING_JVM = r"(?:\A|\n[ \t]*\n|(?<=\p{L}{7})\.[ \t]+|[?][ \t]+)([a-zа-яα-ω][\p{L}\p{N}_-]*)(?= )"

#: Mark, what follows, scripts before and after the gap; then shape and word before a full stop, and words beside a number.
Context = tuple[str, ...]
#: Contexts, which end a paragraph, their numbers in it, which stand close to the one before.
Sequence = tuple[list[Context], list[bool], list[int], list[bool]]


@cache
def _script(c: str) -> str:
    """The script of a letter; '' for anything else."""
    return unicodedata.name(c, "").partition(" ")[0].partition("-")[0] if c.isalpha() else ""


def _kind(mark: str) -> str:
    """The kind of a run of end marks."""
    if mark in ";\u037e":
        return "greek"
    if any(c in mark for c in "。！？｡"):
        return "wide"
    if mark[0] in "।॥؟۔":
        return "own"
    return "question" if "?" in mark else "call" if "!" in mark else "pause" if "…" in mark or len(mark) > 1 else "stop"


def _quote_pairs(text: str) -> list[tuple[int, int]]:
    """Spans of quotation marks that are closed in the same block, outermost ones."""
    pairs: list[tuple[int, int]] = []
    taken = [m.span() for m in _APOSTROPHED.finditer(text)] if "'" in text else []
    opened = -1
    closing = ""
    for m in _QUOTE_MARK.finditer(text):
        c, i = m[0], m.start()
        if opened >= 0:
            if c == closing:
                pairs.append((opened, i + 1))
                opened = -1
        elif c in QUOTES and not (c == "‘" and i and text[i - 1].isalnum()):
            if QUOTES[c] in text[i + 1 :]:
                opened, closing = i, QUOTES[c]
    return sorted(pairs + [(a, b) for a, b in taken if not any(p[0] <= a < p[1] for p in pairs)])


class Segmenter:
    """Finds candidates and their contexts, and decodes them under a model's weights.

    weights: by feature (see :func:`features`), and by ("tags", near, before, now) for neighbouring tags.
    """

    def __init__(self, weights: dict | None = None, starters: frozenset[str] = frozenset()) -> None:
        self.weights, self.starters = {} if weights is None else weights, starters
        self.scores: dict[Context, float] = {}
        self.tags = [[[self.weights.get(("tags", near, a, b), 0.0) for b in (0, 1)] for a in (0, 1)] for near in (0, 1)]

    def _after(self, text: str, at: int, end: int) -> tuple[str, int]:
        """The kind of what follows a gap, and where it stands."""
        start = at + 1 if at + 1 < end and text[at] == " " and not text[at + 1].isspace() else _GAP.match(text, at, end).end()
        i = start
        while i < end and text[i] in _OPENERS:
            i += 1
        if i >= end:
            return "other", start
        c = text[i]
        if c.isdigit():
            return "digit", start
        if c.isalpha():
            if c.isupper() or c.istitle():
                return "upper", start
            if c.islower():
                word = _NAME_WORD.match(text, i, end)[0]
                return ("starter" if word in self.starters else "lower"), start
            return "letter", start
        return ("open" if i > start else "point"), start

    def _word(self, text: str, start: int, mark: int, place: int, end: int) -> tuple[str, str, str, str]:
        """The shape of the word before a full stop, the word itself, and for a number the words before and after it."""
        begin, least = mark, max(start, mark - LONGEST_WORD)
        while begin > least and text[begin - 1] not in _APART:
            begin -= 1
        token = text[begin:mark].rstrip(")]}）")
        if not token:
            return "none", "", "", ""
        earlier = (text[max(start, begin - 40) : begin].split() or [""])[-1]
        if token.isdigit():
            follows = _NAME_WORD.search(text, place, min(end, place + 40))
            return "number" if len(token) > 2 else "small number", "", earlier.lower(), follows[0].lower() if follows else ""
        counted = " counted" if earlier[:1].isdigit() or earlier[:1] == "~" else ""
        if len(token) == 1:
            return f"{'upper' if token.isupper() else 'lower' if token.islower() else 'letter'} one{counted}", token, "", ""
        if "." in token:
            shape = "dotted"
        elif not token.isalpha() and not all(c.isalpha() or unicodedata.category(c)[0] == "M" for c in token):
            shape = "mixed"
        else:
            shape = f"{'upper' if token.isupper() else 'title' if token[0].isupper() else 'lower'} {min(5, len(token))}"
        return shape + counted, token.lower(), "", ""

    def candidates(self, text: str, start: int, end: int) -> list[tuple[int, Context]]:
        """(where a unit would end, context) of each character that may be a boundary in a block of running text."""
        while end > start and text[end - 1].isspace():
            end -= 1
        block = text[start:end]
        quotes = [(a + start, b + start) for a, b in _quote_pairs(block)] if _QUOTE_MARK.search(block) else []
        closes = {b - 1 for _, b in quotes}
        out: list[tuple[int, Context]] = []
        last, q = start, 0
        for m in (_END_OR_BLANK if _UNMARKED.search(block) else _END).finditer(text, start, end):
            at, stop = m.span()
            if at < last:
                continue
            mark = m[0]
            while q < len(quotes) and quotes[q][1] <= at:
                q += 1
            inside = q < len(quotes) and quotes[q][0] < at
            if mark[0] == " ":
                if not inside:
                    out.append((at, ("blank", "letter", _script(text[at - 1]), "", "", "", "", "")))
                continue
            reach = stop
            while reach < end and (text[reach] in _CLOSERS or reach in closes):
                reach += 1
            quoted = inside and reach >= quotes[q][1]
            if inside and not quoted:
                continue
            # no emoji comes before the arrows
            near = text[reach : reach + 1] if text[reach : reach + 1] not in (" ", "\t") else text[reach : reach + 8].lstrip(" \t")[:1] or " "
            emoji = _EMOJI.match(text, reach, end) if near >= "←" or near == " " else None
            if emoji:
                reach = emoji.end()
            if reach >= end:
                break
            gap = text[reach].isspace()
            kind = _KINDS.get(mark) or _kind(mark)
            if kind == "greek":
                letters = _LETTER.findall(text[max(start, at - 40) : at])
                if not gap or not letters or not "Ͱ" <= letters[-1] <= "Ͽ":
                    continue
            nxt, place = self._after(text, reach, end)
            if not gap and kind in ("stop", "call", "question") and not emoji:
                # a blank is missing between two sentences, or this is inside a name
                before, after = text[at - 1 : at], text[reach : reach + 1]
                joined = (before.islower() or before.isdigit() or before in _CLOSERS or reach > stop) and (nxt == "upper" and (text[reach + 1 : reach + 2].islower() or text[reach + 1 : reach + 2].isspace() or after in _OPENERS))
                joined = joined or (nxt == "letter" and before.isalpha() and not before.islower() and not before.isupper() and not _CJK.match(before))
                if not joined:
                    continue
            if kind == "pause" and (mark.startswith("……") or _CJK.match(text, at - 1)) and nxt == "letter":
                kind = "widepause"
            word = self._word(text, start, at, place, end) if kind == "stop" else ("", "", "", "")
            if quoted:
                kind = "quoted"
            elif reach > stop and text[stop] in _CLOSERS and kind == "stop":
                opened = text.rfind("(", start, at) if text[stop] == ")" else -1
                ahead = opened
                while ahead > start and text[ahead - 1] in " \t\r\n>":
                    ahead -= 1
                kind = "aside" if opened >= 0 and (ahead == start or text[ahead - 1] in _ENDERS) else "stop"
            opened = place
            while opened < end and text[opened] in _OPENERS:
                opened += 1
            out.append((reach, (kind, nxt, _script(text[at - 1 : at]), _script(text[opened : opened + 1]), *word)))
            last = reach
        return out

    def score(self, context: Context) -> float:
        """How much a boundary is preferred in a context."""
        known = self.scores.get(context)
        if known is None:
            if len(self.scores) > 100_000:
                self.scores.clear()
            get = self.weights.get
            known = self.scores[context] = sum(get(f, 0.0) for f in features(context))
        return known

    def decode(self, contexts: list[Context], near: list[bool]) -> list[bool]:
        """The best sequence of tags, by Viterbi's algorithm; near says which candidates stand close to the one before."""
        if len(contexts) == 1:
            return [self.score(contexts[0]) > 0]
        inside, boundary = 0.0, float("-inf")
        back: list[tuple[int, int]] = []
        for c, close in zip(contexts, near, strict=True):
            s = self.score(c)
            if not back:
                boundary = s
                back.append((0, 0))
                continue
            (t00, t01), (t10, t11) = self.tags[close]
            a0, a1 = inside + t00, boundary + t10
            b0, b1 = inside + t01, boundary + t11
            back.append((int(a1 > a0), int(b1 > b0)))
            inside, boundary = max(a0, a1), max(b0, b1) + s
        tags = [False] * len(contexts)
        tag = int(boundary > inside)
        for i in range(len(contexts) - 1, -1, -1):
            tags[i] = bool(tag)
            tag = back[i][tag]
        return tags

    def blocks(self, text: str) -> Iterator[tuple[int, int, int]]:
        """(start, where running text begins, end) of each block; lines of fenced blocks begin at their end."""
        open_, kind, fenced, listed, at = -1, "", False, False, 0
        body = 0
        n = len(text)
        while at < n:
            stop = text.find("\n", at)
            stop = n if stop < 0 else stop
            line = text[at:stop]
            bare = line.strip()
            own = ""
            if fenced or _FENCE.match(line):
                if open_ >= 0:
                    yield open_, body, at
                    open_ = -1
                if _FENCE.match(line):
                    fenced = not fenced
                if bare:
                    yield at, stop, stop
                listed = False
            elif not bare or not bare.strip(">"):
                if open_ >= 0:
                    yield open_, body, at
                    open_ = -1
                if bare:
                    yield at, stop, stop
                listed = False
            else:
                mark = _HEADING.match(line)
                item = None if mark else _BULLET.match(line) or (_NUMBERED.match(line) if open_ < 0 or listed else None)
                if mark or item:
                    if open_ >= 0:
                        yield open_, body, at
                        open_ = -1
                    yield at, at + (mark or item).end(), stop
                    listed = bool(item)
                else:
                    own = "mail" if _MAILED.match(line) else "text"
                    if open_ >= 0 and own != kind:
                        yield open_, body, at
                        open_ = -1
                    if open_ < 0:
                        open_, kind, body = at, own, at
                    listed = False
            at = stop + 1
        if open_ >= 0:
            yield open_, body, n

    def units(self, text: str) -> list[tuple[int, int]]:
        """(start, end) of each sentence unit, in code points; no white space at either end."""
        out: list[tuple[int, int]] = []
        for start, body, end in self.blocks(text):
            ends = [end]
            if body < end:
                found = self.candidates(text, body, end)
                if found:
                    ends = [e for (e, _), tag in zip(found, self.decode([c for _, c in found], closeness([e for e, _ in found])), strict=True) if tag] + ends
            a = start
            for e in ends:
                left, right = a, e
                while left < right and text[left].isspace():
                    left += 1
                while left < right and text[right - 1].isspace():
                    right -= 1
                if left < right:
                    out.append((left, right))
                a = e
        return out


def closeness(places: list[int]) -> list[bool]:
    """Which of ascending places stand close to the one before."""
    return [False, *(b - a <= NEAR for a, b in zip(places, places[1:], strict=False))][: len(places)]


def features(context: Context) -> list[tuple]:
    """What the model sees of a context: its parts alone and together, and single words."""
    mark, nxt, before, first, shape, word, earlier, later = context
    opens = "opens" if nxt in _OPENS else nxt
    out: list[tuple] = [("any",), ("mark", mark), ("next", nxt), ("opens", opens), ("mark next", mark, nxt), ("mark opens", mark, opens), ("before", mark, before), ("before next", mark, before, nxt), ("scripts", mark, before, first)]
    if shape:
        out += [("shape", mark, shape), ("shape next", mark, shape, nxt), ("shape opens", mark, shape, opens)]
    if word:
        out += [("word", word), ("word next", word, nxt)]
    if earlier:
        out.append(("word earlier", shape, earlier, nxt))
    if later:
        out.append(("word later", shape, later))
    return out


def opening_words(text: str) -> set[str]:
    """Words that open paragraphs in lower case, or follow a question or a full stop after a word too long for a short form."""
    return set(_OPENING.findall(text))


def learn_starters(texts: Iterable[str]) -> frozenset[str]:
    """Words that open sentences in lower case in several of the texts, and in a share of them."""
    seen: Counter[str] = Counter()
    distinct = set(texts)
    for text in distinct:
        seen.update(opening_words(text))
    return frozenset(w for w, n in seen.items() if n >= max(LEAST_OPENED, SHARE_OPENED * len(distinct)))


def evidence(texts: Iterable[str], starters: frozenset[str]) -> list[Sequence]:
    """One sequence a text: contexts, which of them end a paragraph that another follows, their number in the paragraph,
    and which stand close to the one before. Between letters of scripts without end marks, punctuation is stripped."""
    reader = Segmenter({}, starters)
    out = []
    for text in texts:
        contexts, ended, number, near = [], [], [], []
        bodies = [text[b:e].strip() for _, b, e in reader.blocks(text) if b < e]
        for one, two in zip(bodies, [*bodies[1:], ""], strict=True):
            if one and two and _UNMARKED.match(one[-1]) and _UNMARKED.match(two[0]):
                one, two = (re.sub(r"[^\w\s\u0e00-\u0eff]", "", x).strip() for x in (one, two))
            found = reader.candidates(one + " " + two[:80] if two else one, 0, len(one) + min(81, len(two) + 1) if two else len(one))
            found = [(p, c) for p, c in found if p <= len(one)]
            contexts += [c for _, c in found]
            ended += [p == len(one) for p, _ in found]
            number += range(len(found))
            near += closeness([p for p, _ in found])
        if contexts:
            out.append((contexts, ended, number, near))
    return out


class _Field:
    """Sequences as arrays, longest first, and sums over all taggings of them."""

    def __init__(self, sequences: list[Sequence]) -> None:
        pieces = [tuple(x[i : i + STRETCH] for x in q) for q in sequences for i in range(0, len(q[0]), STRETCH)]
        pieces.sort(key=lambda p: -len(p[0]))
        codes: dict[Context, int] = {}
        flat = [codes.setdefault(c, len(codes)) for p in pieces for c in p[0]]
        self.contexts = list(codes)
        lengths = np.array([len(p[0]) for p in pieces])
        rows, columns = np.concatenate([np.arange(n) for n in lengths]), np.repeat(np.arange(len(pieces)), lengths)
        self.at = (rows, columns)
        shape = (int(lengths[0]), len(pieces))
        self.code = np.array(flat)
        self.ended = np.concatenate([np.array(p[1], bool) for p in pieces])
        self.place = np.minimum(np.concatenate([np.array(p[2]) for p in pieces]), PLACES - 1)
        self.near = np.zeros(shape, np.int64)
        self.near[self.at] = np.concatenate([np.array(p[3], int) for p in pieces])
        self.live = [int((lengths > t).sum()) for t in range(shape[0])]

    def expect(self, scores: np.ndarray, tags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The probability of a boundary at each candidate and the expected counts of neighbouring tags, by forward and
        backward sums; scores by candidate, tags by (near, before, now)."""
        odds = np.ones(self.near.shape)
        odds[self.at] = np.exp(np.clip(scores, -30, 30))
        step = np.exp(tags)[self.near]
        in_, out = np.ones(odds.shape), np.zeros(odds.shape)
        in_[0], out[0] = 1 / (1 + odds[0]), odds[0] / (1 + odds[0])
        for t in range(1, len(odds)):
            k = self.live[t]
            a, b, s = in_[t - 1, :k], out[t - 1, :k], step[t, :k]
            x, y = a * s[:, 0, 0] + b * s[:, 1, 0], (a * s[:, 0, 1] + b * s[:, 1, 1]) * odds[t, :k]
            in_[t, :k], out[t, :k] = x / (x + y), y / (x + y)
        boundary, pairs = np.zeros(odds.shape), np.zeros(tags.shape)
        r0, r1 = np.ones(odds.shape[1]), np.ones(odds.shape[1])
        for t in range(len(odds) - 1, -1, -1):
            k, q = self.live[t], self.live[t + 1] if t + 1 < len(odds) else 0
            if q:
                s, m0, m1 = step[t + 1, :q], r0[:q], r1[:q] * odds[t + 1, :q]
                a, b = in_[t, :q], out[t, :q]
                z0, z1 = s[:, 0, 0] * m0 + s[:, 0, 1] * m1, s[:, 1, 0] * m0 + s[:, 1, 1] * m1
                all_ = a * z0 + b * z1
                for near in (0, 1):
                    w = (self.near[t + 1, :q] == near) / all_
                    pairs[near] += [[(w * a * s[:, 0, 0] * m0).sum(), (w * a * s[:, 0, 1] * m1).sum()], [(w * b * s[:, 1, 0] * m0).sum(), (w * b * s[:, 1, 1] * m1).sum()]]
                r0[:q], r1[:q] = z0 / (z0 + z1), z1 / (z0 + z1)
            r0[q:k], r1[q:k] = 1, 1
            x, y = in_[t, :k] * r0[:k], out[t, :k] * r1[:k]
            boundary[t, :k] = y / (x + y)
        return boundary[self.at], pairs


class _Climb:
    """Steps of Adam's method for one array of parameters."""

    def __init__(self, start: np.ndarray) -> None:
        self.now, self.mean, self.square, self.n = start, np.zeros_like(start), np.zeros_like(start), 0

    def step(self, gradient: np.ndarray, rate: float) -> None:
        self.n += 1
        self.mean = 0.9 * self.mean + 0.1 * gradient
        self.square = 0.99 * self.square + 0.01 * gradient**2
        self.now = self.now + rate * self.mean / (1 - 0.9**self.n) / (np.sqrt(self.square / (1 - 0.99**self.n)) + 1e-8)


def fit(texts: Iterable[str], starters: frozenset[str] | None = None, first_steps: int = FIRST_STEPS, steps: int = STEPS) -> Segmenter:
    """A model fitted on texts; starters are learned from them unless given. Without any paragraph's end there is nothing
    to learn from, and the prior decides.

    First the rate of paragraph ends is fitted for each context alone, which is convex, and stopped early, before it tells
    rare words apart; half the rate of a sure boundary is where tags change. From there the linear chain is fitted by gradients of the evidence, the sums over all taggings
    that agree with it against the sums over all.
    """
    texts = list(dict.fromkeys(texts))
    starters = learn_starters(texts) if starters is None else starters
    return fit_evidence(evidence(texts, starters), starters, first_steps, steps)


def fit_evidence(sequences: list[Sequence], starters: frozenset[str], first_steps: int = FIRST_STEPS, steps: int = STEPS) -> Segmenter:
    """:func:`fit` on what :func:`evidence` gives."""
    if not any(any(q[1]) for q in sequences):
        return Segmenter(dict(EXPECTED), starters)
    field = _Field(sequences)
    cases = np.bincount(field.code, minlength=len(field.contexts))
    named: Counter[tuple] = Counter()
    for c, n in zip(field.contexts, cases.tolist(), strict=True):
        for f in features(c):
            named[f] += n
    codes = {f: i for i, f in enumerate(f for f, n in named.items() if n >= LEAST_CASES or not f[0].startswith("word"))}
    rows, columns = np.array([(i, codes[f]) for i, c in enumerate(field.contexts) for f in features(c) if f in codes]).T
    prior = np.array([WORD_PRIOR if f[0].startswith("word") else PRIOR for f in codes])
    rates = _rates(field)
    per_place = np.bincount(field.code * PLACES + field.place, minlength=len(cases) * PLACES).reshape(-1, PLACES)
    ended = np.bincount(field.code[field.ended], minlength=len(cases))
    score = lambda w: np.bincount(rows, w[columns], len(cases))
    expected = np.array([EXPECTED.get(f, 0.0) for f in codes])
    slope = lambda by_context, w: np.bincount(columns, by_context[rows], len(codes)) - prior * (w - expected)
    weights = _Climb(expected)
    odds = np.log(rates / (1 - rates))
    for i in range(first_steps):
        rate = 1 / (1 + np.exp(-np.clip(score(weights.now)[:, None] + odds, -30, 30)))
        weights.step(slope(ended - (per_place * rate).sum(axis=1), weights.now), 0.2 * (1 - i / first_steps))
    start = weights.now.copy()
    start[codes[("any",)]] += np.log(2)  # until here 0 is the rate of a sure boundary
    weights, tags = _Climb(start), _Climb(np.zeros((2, 2, 2)))
    agree = np.where(field.ended, 30.0, np.log(1 - rates[field.place]))
    for _ in range(steps):
        scores = score(weights.now)[field.code]
        (any_, any_pairs), (known, known_pairs) = field.expect(scores, tags.now), field.expect(scores + agree, tags.now)
        gradient = slope(np.bincount(field.code, known - any_, len(cases)), weights.now)
        tags.step(known_pairs - any_pairs - CHAIN_PRIOR * tags.now, 0.05)
        weights.step(gradient, 0.05)
    chain = {("tags", n, a, b): float(tags.now[n, a, b]) for n in (0, 1) for a in (0, 1) for b in (0, 1)}
    return Segmenter(EXPECTED | {f: float(weights.now[i]) for f, i in codes.items()} | chain, starters)


def _rates(field: _Field) -> np.ndarray:
    """How often a sure boundary ends a paragraph, by its number there.

    Over all, it is the rate of the contexts that paragraph ends have, each weighed by its ends (those never seen at an
    end do not count); then the rate at each number among contexts with at least half of that.
    """
    kinds: dict[tuple, int] = {}
    kind = np.array([kinds.setdefault(c[:2], len(kinds)) for c in field.contexts])[field.code]
    n, ends = np.bincount(kind), np.bincount(kind[field.ended], minlength=len(kinds))
    sure = (ends / n >= (ends**2 / n).sum() / ends.sum() / 2)[kind]
    counts = np.bincount(field.place[sure], minlength=PLACES)
    whole = field.ended[sure].sum() / sure.sum()
    return np.clip((np.bincount(field.place[sure & field.ended], minlength=PLACES) + 5 * whole) / (counts + 5), 1e-3, 0.999)


def sentence_units(documents: DataFrame, sample_documents: int = SAMPLE_DOCUMENTS, sample_longest: int = SAMPLE_LONGEST) -> DataFrame:
    """(doc_id, sent_start, sent_end): every sentence unit of every document, offsets in code points from 0.

    documents: doc_id, text; further columns are ignored. The model is fitted on at most ``sample_documents`` distinct
    texts, those with the smallest hashes, if not longer than ``sample_longest`` code points. Every document is read
    whole twice in narrow passes: one in the JVM lists the words that open its sentences in lower case, one gives its units.
    Null, empty and blank texts have no units; repeated rows yield repeated units; null ids stay null.
    """
    whole = documents.where("text IS NOT NULL AND text <> ''").selectExpr("CAST(doc_id AS bigint) AS doc_id", "text")

    # each distinct text once, under the empty word and under each word that opens its sentences; texts are read once for all answers
    words = F.array_union(F.array(F.lit("")), F.regexp_extract_all("text", F.lit(_OPENING_JVM), F.lit(1)))
    told = whole.select("doc_id", F.xxhash64("text").alias("hash"), F.explode(words).alias("word"))
    told = cut_lineage(told.groupBy("word", "hash").agg(F.min("doc_id").alias("doc_id")), eager=True)
    distinct = told.where("word = ''")
    least = max(LEAST_OPENED, SHARE_OPENED * distinct.count())
    # a share of all texts, so their number is bounded by what a text opens on average
    starters = frozenset(r[0] for r in told.where("word <> ''").groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).select("word").collect())
    ids = [r[0] for r in distinct.where("doc_id IS NOT NULL").orderBy("hash").limit(sample_documents).select("doc_id").collect()]

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [pickle.dumps(evidence([text], starters)) for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], names=["hash", "seen"])

    # the sample is bounded, so it is read off in a fixed number of tasks; contexts come to the driver, not texts
    sample = whole.where(F.col("doc_id").isin(ids) & (F.length("text") <= sample_longest)).select(F.xxhash64("text").alias("hash"), "text").distinct().repartition(SAMPLE_TASKS)
    told_by = sorted((r["hash"], r["seen"]) for r in sample.mapInArrow(seen, "hash bigint, seen binary").collect())[:sample_documents] if ids else []
    model = fit_evidence([q for _, own in told_by for q in pickle.loads(own)], starters)
    weights = model.weights

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segmenter = Segmenter(weights, starters)
        for batch in batches:
            ids, starts, ends = [], [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                units = segmenter.units(text)
                ids += [doc_id] * len(units)
                starts += [a for a, _ in units]
                ends += [b for _, b in units]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], names=["doc_id", "sent_start", "sent_end"])

    return whole.mapInArrow(over, "doc_id bigint, sent_start int, sent_end int")
