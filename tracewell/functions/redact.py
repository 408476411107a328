"""Secrets in texts and documents, replaced by a token that tells equal ones apart from others."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Key prefixes, and names whose values are secret.
PREFIXES = ["sk-", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "AKIA", "AIza"]
SECRET_NAMES = ["password", "passwd", "secret", "token", "api_key", "apikey", "access_key", "private_key", "client_secret"]

_PEM = re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----.*?(?:-----END [A-Z ]*PRIVATE KEY-----|\Z)", re.S)
_BEARER = re.compile(r"(Bearer\s+)([A-Za-z0-9._~+/=-]{8,})", re.I)
_KEY = re.compile(r"(?<![A-Za-z0-9])(?:" + "|".join(map(re.escape, PREFIXES)) + r")[A-Za-z0-9_-]{16,}")
_PAIR = re.compile(r"(?i)(?<![A-Za-z0-9])((?:" + "|".join(SECRET_NAMES) + r")[\"']?\s*[=:]\s*)(\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*'|[^\s,;&}\]]+)")


def token_for(secret: str) -> str:
    return f"<REDACTED:sha256:{hashlib.sha256(secret.encode()).hexdigest()[:8]}>"


def redact_text(text: str | None) -> str | None:
    """Private keys, bearer tokens, keys by prefix and ``secret = value`` pairs."""
    if text is None:
        return None
    text = _PEM.sub(lambda m: token_for(m[0]), text)
    text = _BEARER.sub(lambda m: m[1] + token_for(m[2]), text)
    text = _KEY.sub(lambda m: token_for(m[0]), text)

    def pair(m: re.Match[str]) -> str:
        value = m[2]
        quote = value[0] if value[0] in "\"'" else ""
        inner = value[1:-1] if quote else value
        return m[1] + quote + token_for(inner) + quote if inner and not inner.startswith("<REDACTED:") else m[0]

    return _PAIR.sub(pair, text)


def redact_value(value: object) -> object:
    """A JSON value: whole subtrees under secret names, and secrets inside other strings."""
    if isinstance(value, dict):
        return {k: token_for(v if isinstance(v, str) else json.dumps(v, sort_keys=True)) if k.lower() in SECRET_NAMES and v is not None else redact_value(v) for k, v in value.items()}
    if isinstance(value, list):
        return [redact_value(v) for v in value]
    return redact_text(value) if isinstance(value, str) else value


def redact_json(text: str | None) -> str | None:
    """A JSON text with secrets masked and keys sorted; a text that is no JSON is treated as text."""
    if text is None:
        return None
    try:
        return json.dumps(redact_value(json.loads(text)), sort_keys=True, ensure_ascii=False)
    except ValueError:
        return redact_text(text)


@F.pandas_udf(StringType())
def _redact(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in batches:
        yield s.map(redact_text, na_action="ignore")


def redact(text: Column) -> Column:
    """Texts without secrets. Only texts that can hold one go through Python; the test is a scan in the JVM."""
    suspect = text.rlike("(?i)PRIVATE KEY|bearer|" + "|".join([re.escape(p) for p in PREFIXES] + SECRET_NAMES))
    return F.when(suspect, _redact(text)).otherwise(text)


def redact_bytes(data: bytes, strict: bool = False) -> bytes:
    """Redacted bytes of a text; what is no UTF-8 becomes replacement characters, or is an error if strict."""
    return redact_text(data.decode("utf-8", "strict" if strict else "replace")).encode()
