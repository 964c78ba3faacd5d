"""Personal-data and secret removal. The confirming checks need code per match, so these run as Arrow UDFs."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lorekeep.functions.text import SPACE

PLACEHOLDER = "[removed]"
# What counts as an address, an e-mail, a card number and a phone number.
URL = re.compile(f"https?://[^{SPACE}]+", re.I)
EMAIL = re.compile(rf"[^{SPACE}<>@]+@[^{SPACE}<>@]+\.[a-z]{{2,}}", re.I)
CARD = re.compile(r"(?<![A-Za-z0-9_])(?:[0-9][ -]?){12,18}[0-9](?![A-Za-z0-9_])")
PHONE = re.compile(
    rf"\+[0-9][0-9{SPACE}-]{{7,15}}[0-9]|(?<![A-Za-z0-9_])0[0-9][0-9{SPACE}-]{{7,11}}[0-9](?![A-Za-z0-9_])"
)
# Key names that hold secrets.
SENSITIVE = re.compile(
    r"(api[-_]?key|access[-_]?key|token(?!s)|secret|password|passwd|credential|authorization|auth|cookie"
    r"|session[-_]?id|bearer|signature)",
    re.I,
)
MAX_DEPTH = 6
# A text without one of these cannot hold personal data, so it never travels to Python.
MAY_HOLD = rf"@|[0-9](?:[{SPACE}-]{{0,15}}[0-9]){{8}}"

REDACTION = T.StructType(
    [T.StructField("text", T.StringType()), T.StructField("removed", T.ArrayType(T.StringType()))]
)


def _luhn(digits: str) -> bool:
    doubled = "0246813579"
    total = sum(int(d) for d in digits[-1::-2]) + sum(int(doubled[int(d)]) for d in digits[-2::-2])
    return total % 10 == 0


def _is_card(found: str) -> bool:
    return _luhn(re.sub("[ -]", "", found))


def _is_phone(found: str) -> bool:
    return 10 <= len(re.sub("[^0-9]", "", found)) <= 15


RULES = (("email", EMAIL, None), ("payment card", CARD, _is_card), ("phone number", PHONE, _is_phone))
CATEGORIES = tuple(label for label, _, _ in RULES)


def redact_text(text: str) -> tuple[str, list[str]]:
    found: dict[str, None] = {}

    def clean(span: str) -> str:
        for label, pattern, confirmed in RULES:

            def swap(match: re.Match) -> str:
                if confirmed is not None and not confirmed(match[0]):
                    return match[0]
                found[label] = None
                return PLACEHOLDER

            span = pattern.sub(swap, span)
        return span

    addresses = URL.findall(text)
    spans = [clean(span) for span in URL.split(text)]
    whole = spans[0] + "".join(a + s for a, s in zip(addresses, spans[1:]))
    return whole, list(found)


@F.pandas_udf(REDACTION)
def _redact(texts: pd.Series) -> pd.DataFrame:
    rows = [(None, None) if t is None else redact_text(t) for t in texts]
    return pd.DataFrame(rows, columns=["text", "removed"])


def redact(col) -> Column:
    """struct(text, removed): the cleaned text and the categories that were found in it."""
    col = F.col(col) if isinstance(col, str) else col
    suspect = col.rlike(MAY_HOLD)
    cleaned = _redact(F.when(suspect, col))
    return F.struct(
        F.coalesce(cleaned["text"], col).alias("text"),
        F.coalesce(cleaned["removed"], F.array().cast("array<string>")).alias("removed"),
    )


def _mask(value, depth: int):
    if not isinstance(value, (dict, list)):
        return value
    if depth >= MAX_DEPTH:
        return "[truncated]"
    if isinstance(value, list):
        return [_mask(item, depth + 1) for item in value]
    return {k: "[redacted]" if SENSITIVE.search(k) else _mask(v, depth + 1) for k, v in value.items()}


@F.pandas_udf(T.StringType())
def _mask_json(values: pd.Series) -> pd.Series:
    def one(text):
        if text is None:
            return None
        try:
            return json.dumps(_mask(json.loads(text), 0), ensure_ascii=False, separators=(",", ":"))
        except ValueError:
            return None

    return values.map(one)


def redact_keys(col) -> Column:
    """JSON text with secret fields masked at any depth; text that is not JSON is a plain value and passes through."""
    col = F.col(col) if isinstance(col, str) else col
    return F.coalesce(_mask_json(col), col)


def redact_flat(col: Column) -> Column:
    """The same rule for a flat map column, in the JVM."""
    pattern = "(?i)" + SENSITIVE.pattern
    return F.transform_values(col, lambda k, v: F.when(k.rlike(pattern), F.lit("[redacted]")).otherwise(v))
