"""POSIX shell words as column expressions, and a Python splitter for what needs the words themselves."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_BARE, _SINGLE, _DOUBLE, _BARE_ESCAPE, _DOUBLE_ESCAPE = range(5)


def splits_into_words(command: Column) -> Column:
    """True where every quote is closed and no backslash ends the text.

    The text is cut into quotes, backslashes and what lies between, and the pieces are folded through the five
    states of the shell's quoting, so the length of the text never meets a recursion limit.
    """
    pieces = F.regexp_extract_all(command, F.lit(r"""(?s)['"\\]|[^'"\\]+"""), F.lit(0))

    def step(state: Column, piece: Column) -> Column:
        single, double, slash = piece == "'", piece == '"', piece == "\\"
        bare = F.when(single, _SINGLE).when(double, _DOUBLE).when(slash, _BARE_ESCAPE).otherwise(_BARE)
        inside = F.when(double, _BARE).when(slash, _DOUBLE_ESCAPE).otherwise(_DOUBLE)
        return F.when(state == _BARE, bare).when(state == _SINGLE, F.when(single, _BARE).otherwise(_SINGLE)).when(state == _DOUBLE, inside).when(state == _BARE_ESCAPE, _BARE).otherwise(_DOUBLE)

    return ~command.rlike(r"""['"\\]""") | (F.aggregate(pieces, F.lit(_BARE), step) == _BARE)


def first_word_is_option(command: Column) -> Column:
    """True where the first word, quotes aside, begins with a hyphen."""
    return command.rlike(r"""\A\s*(?:""|'')*(?:["'\\])?-""")


_WORD_PIECE = re.compile(r"""\s+|\\(.?)|'([^']*)(')?|"((?:[^"\\]|\\.)*)(")?|([^\s\\'"]+)""", re.S)


def split_words(command: str) -> list[str] | None:
    """The words of a command under POSIX quoting; None where a quote or a backslash is left open."""
    words: list[str] = []
    word: str | None = None
    for m in _WORD_PIECE.finditer(command):
        text = m[0]
        if text[0].isspace():
            if word is not None:
                words.append(word)
            word = None
        elif text[0] == "\\":
            if not m[1]:
                return None
            word = (word or "") + ("" if m[1] == "\n" else m[1])
        elif text[0] == "'":
            if not m[3]:
                return None
            word = (word or "") + m[2]
        elif text[0] == '"':
            if not m[5]:
                return None
            word = (word or "") + re.sub(r'\\([\\"$`\n])', lambda e: "" if e[1] == "\n" else e[1], m[4])
        else:
            word = (word or "") + text
    if word is not None:
        words.append(word)
    return words
