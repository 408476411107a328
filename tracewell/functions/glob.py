"""Glob patterns as anchored regular expressions that both Java and Python read alike."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def glob_regex(pattern: str) -> str:
    """``*`` any run (slashes too), ``?`` one character, ``[abc]``, ``[!a-z]`` and ``[^...]`` classes; an unclosed
    bracket is itself."""
    out, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif c == "[" and (end := pattern.find("]", i + (3 if pattern[i + 1 : i + 2] in ("!", "^") else 2))) > 0:
            body = pattern[i + 1 : end]
            no = body[:1] in ("!", "^")
            body = re.sub(r"([\\\[\]&^~])", r"\\\1", body[1:] if no else body)
            out.append(f"[{'^' if no else ''}{body}]")
            i = end
        else:
            out.append(re.escape(c))
        i += 1
    return r"(?s)\A" + "".join(out) + r"\z"


def glob_match(text: Column, pattern: str) -> Column:
    return text.rlike(glob_regex(pattern))


def excluded(rel_path: Column, name: Column, patterns: list[str]) -> Column:
    """Whether an entry is excluded: a pattern with a slash is matched with the path, one with ``*`` or ``?`` with the
    name, any other is a name."""
    out = F.lit(False)
    for p in patterns:
        out = out | (glob_match(rel_path, p) if "/" in p else glob_match(name, p) if "*" in p or "?" in p else name == p)
    return out


def python_glob(pattern: str) -> re.Pattern[str]:
    """The same pattern for paths on the driver."""
    return re.compile(glob_regex(pattern).replace(r"\z", r"\Z"))
