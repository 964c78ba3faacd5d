"""Identities: every id is a function of its content, so a re-run gives the same rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the namespace that store ids are derived under.
NAMESPACE_HEX = "f7a1c6d29b3e4a588d1f6e2b0c4a7d93"
_UUID = r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"


def document_id(site: Column, source: Column, reference: Column) -> Column:
    joined = F.concat_ws("\u0000", site, source, reference)
    return F.concat(F.lit("doc_"), F.substring(F.sha2(joined, 256), 1, 32))


def content_hash(*parts: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(F.concat_ws("\u0000", *parts), 256))


def store_id(col) -> Column:
    """Lower-cased UUID, or the version 5 UUID of the id under a fixed namespace."""
    col = F.col(col) if isinstance(col, str) else col
    digest = F.sha1(F.concat(F.unhex(F.lit(NAMESPACE_HEX)), F.encode(col, "UTF-8")))
    # the variant digit keeps its two low bits and sets the high ones to 10
    low_bits = F.conv(F.substring(digest, 17, 1), 16, 10).cast("int").bitwiseAND(F.lit(3))
    variant = F.substring(F.lit("89ab"), 1, 4).substr(low_bits + 1, F.lit(1))
    derived = F.concat_ws(
        "-",
        F.substring(digest, 1, 8),
        F.substring(digest, 9, 4),
        F.concat(F.lit("5"), F.substring(digest, 14, 3)),
        F.concat(variant, F.substring(digest, 18, 3)),
        F.substring(digest, 21, 12),
    )
    return F.when(col.rlike(_UUID), F.lower(col)).otherwise(derived)


def idempotency_key(proposal: Column, prefix: str) -> Column:
    return F.substring(F.sha2(F.concat(F.lit(prefix + ":"), proposal), 256), 1, 32)
