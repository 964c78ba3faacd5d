"""Column expressions over text. Whitespace means the Unicode set that JavaScript trims, unless stated."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lorekeep.functions.binding import bind
from lorekeep.scale import small_runs

# The whitespace set of String.prototype.trim and of \s, as a Java character class body.
SPACE = r"\t\n\x0B\f\r \u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF"
# Characters deleted or folded when text is scrubbed.
DELETED = r"[\u00AD\u200B\u200C\u200D\uFEFF\x00-\x08\x0B-\x1F\x7F]"
FOLDED = r"[\u00A0\u1680\u2000-\u200A\u202F\u205F\u3000]"
# Everything below U+0300 is already composed, so only text with a later character can change under NFC.
MAY_DECOMPOSE = r"[^\x00-\u02FF]"
# The price wording that retrieved text must not repeat, and what replaces it.
PRICE = r"(?iu)(?:\bfrom[" + SPACE + r"]+)?\$[" + SPACE + r"]?[0-9][0-9,]*(?:\.[0-9]{2})?"
PRICE_MARKER = "[price not shown]"
# Secret shapes masked in upstream messages.
SECRETS = (
    r"\b(?:sk|pk|rk)[_-][A-Za-z0-9_-]{8,}",
    r"(?i)\bBearer[" + SPACE + r"]+[A-Za-z0-9._-]{8,}",
)
REDACTED = "[redacted]"


def js_trim(col) -> Column:
    return F.regexp_replace(col, f"^[{SPACE}]+|[{SPACE}]+$", "")


def blank_to_null(col) -> Column:
    """Trimmed text, or NULL where nothing is left."""
    return bind(js_trim(col), lambda trimmed: F.when(trimmed != "", trimmed))


@F.arrow_udf(T.StringType())
def _compose(values: pa.Array) -> pa.Array:
    runs = [values.slice(start, length).to_pylist() for start, length in small_runs(values)]
    return pa.concat_arrays([pa.array([], pa.string()), *(pa.array([None if v is None else unicodedata.normalize("NFC", v) for v in run], pa.string()) for run in runs)])


def nfc(col: Column) -> Column:
    """Canonical composition. Only rows that can change travel to Python; the rest are sent as NULL."""
    changes = col.rlike(MAY_DECOMPOSE)
    return F.coalesce(_compose(F.when(changes, col)), col)


def scrub(col: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(col, DELETED, ""), FOLDED, " ")


def _tidy(col: Column) -> Column:
    # CR is itself a control character, so it is gone before this point and needs no rule of its own.
    spaced = F.regexp_replace(F.regexp_replace(scrub(col), r"[ \t]+", " "), " *\n *", "\n")
    return js_trim(F.regexp_replace(spaced, "\n{3,}", "\n\n"))


def normalize_text(col, compose: bool = True) -> Column:
    """Composed, scrubbed text with single spaces and at most one blank line in a row; NULL gives ''."""
    col = F.col(col) if isinstance(col, str) else col
    return F.coalesce(_tidy(nfc(col) if compose else col), F.lit(""))


def normalize_line(col, compose: bool = True) -> Column:
    return js_trim(F.regexp_replace(normalize_text(col, compose), "\n+", " "))


def truncate_text(col: Column, limit: int) -> Column:
    """Cut to ``limit`` characters, moved back to the last blank line if that is past the middle."""
    clipped = F.substring(col, 1, limit)
    # locate on the reversed text finds the last blank line in one pass
    tail = F.locate("\n\n", F.reverse(clipped))
    break_at = F.length(clipped) - tail - 1
    cut = F.when((tail > 0) & (break_at > F.lit(limit / 2)), clipped.substr(F.lit(1), break_at)).otherwise(clipped)
    return F.when(F.length(col) <= limit, col).otherwise(cut)


def render_template(template: Column, values: dict[str, Column]) -> Column:
    """Replace ``{{ key }}`` by the given columns in one left-to-right pass; unknown keys stay as written.

    The template is cut at its placeholders, so text that a value brings in is never rendered again.
    """
    pattern = r"\{\{[" + SPACE + r"]*([A-Za-z][A-Za-z0-9_]*)[" + SPACE + r"]*\}\}"
    literals = F.split(template, pattern)
    marks = F.regexp_extract_all(template, F.lit(pattern), F.lit(0))
    keys = F.regexp_extract_all(template, F.lit(pattern), F.lit(1))
    known = F.create_map(*[part for k, v in values.items() for part in (F.lit(k), v)]) if values else None

    def fill(mark: Column, index: Column) -> Column:
        if known is None:
            return mark
        return F.coalesce(F.try_element_at(known, F.get(keys, index)), mark)

    filled = F.transform(marks, fill)
    pieces = F.transform(
        literals, lambda text, i: F.concat(text, F.coalesce(F.get(filled, i), F.lit("")))
    )
    return F.array_join(pieces, "")


def mask_price(col: Column) -> Column:
    return F.regexp_replace(col, PRICE, PRICE_MARKER)


def has_price(col: Column) -> Column:
    return F.coalesce(col.rlike(PRICE), F.lit(False))


def mask_secrets(col: Column, secret: str | None = None, limit: int = 500) -> Column:
    """One-line upstream text without keys or bearer tokens, cut to ``limit`` characters."""
    text = js_trim(F.regexp_replace(col, f"[{SPACE}]+", " "))
    if secret is not None and len(secret) >= 8:
        text = F.replace(text, F.lit(secret), F.lit(REDACTED))
    for pattern in SECRETS:
        text = F.regexp_replace(text, pattern, REDACTED)
    cut = F.when(F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit("…"))).otherwise(text)
    return F.coalesce(cut, F.lit(""))
