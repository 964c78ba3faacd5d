"""URL expressions. Everything runs in the JVM, relative references included."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lorekeep.functions.binding import bind

# Query parameters that only track a visitor.
TRACKING = r"(?i)^(utm_.*|gclid|gbraid|wbraid|fbclid|msclkid|mc_cid|mc_eid|_ga|ref)$"
_ABSOLUTE = r"(?i)^(https?):[/\\]*([^/\\?#]+)([^?#]*)(\?[^#]*)?(#.*)?$"
_SCHEME = r"(?i)^[a-z][a-z0-9+.-]*:"


def _clean(col: Column) -> Column:
    edges = F.regexp_replace(col, r"^[\x00-\x20]+|[\x00-\x20]+$", "")
    return F.regexp_replace(edges, r"[\t\n\r]", "")


def resolve(col: Column, base: Column) -> Column:
    """An absolute address for a reference found on page ``base`` (itself absolute)."""
    return bind(_clean(col), lambda ref: _resolve(ref, base))


def _resolve(ref: Column, base: Column) -> Column:
    scheme = F.regexp_extract(base, r"^(https?):", 1)
    origin = F.regexp_extract(base, r"^(https?://[^/?#]+)", 1)
    no_fragment = F.regexp_replace(base, r"#.*$", "")
    no_query = F.regexp_replace(no_fragment, r"\?.*$", "")
    folder = F.when(
        no_query.rlike(r"^https?://[^/]+/"), F.regexp_replace(no_query, r"[^/]*$", "")
    ).otherwise(F.concat(no_query, F.lit("/")))
    # "https:path" with the base's own scheme is relative too
    same = ref.rlike(r"(?i)^https?:(?![/\\])") & (F.lower(F.regexp_extract(ref, r"^([A-Za-z]+):", 1)) == scheme)
    return (
        F.when(same, F.concat(folder, F.regexp_replace(ref, _SCHEME, "")))
        .when(ref.rlike(_SCHEME), ref)
        .when(ref == "", no_fragment)
        .when(ref.rlike(r"^[/\\]{2}"), F.concat(scheme, F.lit(":"), ref))
        .when(ref.rlike(r"^[/\\]"), F.concat(origin, ref))
        .when(ref.startswith("?"), F.concat(no_query, ref))
        .when(ref.startswith("#"), F.concat(no_fragment, ref))
        .otherwise(F.concat(folder, ref))
    )


def _path(raw: Column) -> Column:
    """Resolve dot segments, encode what a path may not hold, drop trailing slashes except the root's."""
    return bind(_encoded_path(raw), _finished_path)


def _encoded_path(raw: Column) -> Column:
    slashes = F.replace(raw, F.lit("\\"), F.lit("/"))
    needs_encoding = slashes.rlike(r"[^\x21-\x7E]|[\"<>`{}^]")
    return F.when(
        needs_encoding,
        F.array_join(
            F.transform(
                F.split(slashes, ""),
                lambda c: F.when(c == " ", F.lit("%20"))
                .when(c.rlike(r"[^\x21-\x7E]|[\"<>`{}^]"), F.url_encode(c))
                .otherwise(c),
            ),
            "",
        ),
    ).otherwise(slashes)


def _finished_path(encoded: Column) -> Column:
    one = r"(?i)^(\.|%2e)$"
    two = r"(?i)^(\.|%2e){2}$"

    def step(kept: Column, part: Column) -> Column:
        return (
            F.when(part.rlike(two), F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(0))))
            .when(part.rlike(one), kept)
            .otherwise(F.array_append(kept, part))
        )

    pieces = F.split(encoded, "/")
    parts = F.slice(pieces, F.lit(2), F.size(pieces))
    resolved = F.concat(
        F.lit("/"), F.array_join(F.aggregate(parts, F.lit([]).cast("array<string>"), step), "/")
    )
    dotted = encoded.rlike(r"(?i)/(\.|%2e){1,2}(/|$)")
    path = F.when(encoded == "", F.lit("/")).when(dotted, resolved).otherwise(encoded)
    stripped = F.regexp_replace(path, r"/+$", "")
    return F.when(stripped == "", F.when(F.length(path) > 1, F.lit("/")).otherwise(path)).otherwise(stripped)


def _query(raw: Column) -> Column:
    """Drop tracking parameters, sort by key (stable), write back as form encoding; '' when nothing is left."""

    def decode(text: Column) -> Column:
        stray = F.regexp_replace(text, r"%(?![0-9A-Fa-f]{2})", "%25")
        return F.coalesce(F.try_url_decode(stray), text)

    def pair(part: Column, index: Column) -> Column:
        equals = F.locate("=", part)
        name = F.when(equals > 0, part.substr(F.lit(1), equals - 1)).otherwise(part)
        value = F.when(equals > 0, part.substr(equals + 1, F.length(part))).otherwise(F.lit(""))
        return F.struct(decode(name).alias("name"), index.alias("at"), decode(value).alias("value"))

    parts = F.filter(F.split(F.regexp_replace(raw, r"^\?", ""), "&"), lambda p: p != "")
    kept = F.filter(F.transform(parts, pair), lambda p: ~p["name"].rlike(TRACKING))
    text = F.array_join(
        F.transform(
            F.array_sort(kept), lambda p: F.concat(F.url_encode(p["name"]), F.lit("="), F.url_encode(p["value"]))
        ),
        "&",
    )
    return F.when(F.length(raw) <= 1, F.lit("")).when(text == "", F.lit("")).otherwise(F.concat(F.lit("?"), text))


_WITH_HOST = re.compile(r"(?is)^(\s*(?:https?:)?[/\\]{2,})([^/\\?#]*)(.*)$")


def punycode_url(url: str | None) -> str | None:
    """The address with an international host in its ASCII form; all others as they are."""
    found = None if url is None or url.isascii() else _WITH_HOST.match(url)
    if not found or found[2].isascii():
        return url
    account, at, host = found[2].rpartition("@")
    labels = unicodedata.normalize("NFKC", host.lower()).replace("\u3002", ".").split(".")
    ascii_labels = [label if label.isascii() else "xn--" + label.encode("punycode").decode() for label in labels]
    return found[1] + account + at + ".".join(ascii_labels) + found[3]


@F.pandas_udf(T.StringType())
def ascii_host(urls: pd.Series) -> pd.Series:
    """International hosts in their ASCII form. Put it before ``normalize_url`` where such hosts can come."""
    return urls.map(punycode_url)


def normalize_url(col, base=None) -> Column:
    """One spelling per address, or NULL where it is not an http(s) address.

    Hosts must be written in ASCII: links that ``extract_pages`` gives are, ``ascii_host`` converts others.
    """
    col = F.col(col) if isinstance(col, str) else col
    base = F.col(base) if isinstance(base, str) else base
    url = _clean(col) if base is None else resolve(col, base)
    return bind(url, lambda u: F.when(u.rlike(_ABSOLUTE), bind(_authority(u), lambda a: _assemble(u, a))))


def _authority(url: Column) -> Column:
    """Host and port in lower case, without the scheme's default port."""
    scheme = F.lower(F.regexp_extract(url, _ABSOLUTE, 1))
    raw = F.lower(F.regexp_replace(F.regexp_extract(url, _ABSOLUTE, 2), r"^.*@", ""))
    tidy = F.regexp_replace(F.regexp_replace(raw, r":0+(?=\d)", ":"), r":$", "")
    return F.when(scheme == "https", F.regexp_replace(tidy, ":443$", "")).otherwise(F.regexp_replace(tidy, ":80$", ""))


def _assemble(url: Column, authority: Column) -> Column:
    good_host = authority.rlike(r"^(\[[0-9a-f:.]+\]|[a-z0-9._~!$&'()*+,;=-]+)(:\d{1,5})?$")
    port = F.coalesce(F.regexp_extract(authority, r":(\d{1,5})$", 1).try_cast("int"), F.lit(0))
    user = F.regexp_extract(F.regexp_extract(url, _ABSOLUTE, 2), r"^(.*@)", 1)
    full = F.concat(
        F.lower(F.regexp_extract(url, _ABSOLUTE, 1)),
        F.lit("://"),
        F.regexp_replace(user, r":?@$", "@"),
        authority,
        _path(F.regexp_extract(url, _ABSOLUTE, 3)),
        _query(F.regexp_extract(url, _ABSOLUTE, 4)),
    )
    return F.when(good_host & (port <= 65535), full)


def url_host(url: Column) -> Column:
    """Host of an already normalised address."""
    return F.regexp_extract(url, r"^https?://(?:[^/?#@]*@)?(\[[^\]]+\]|[^/?#:]+)", 1)


def url_path(url: Column) -> Column:
    return F.regexp_extract(url, r"^https?://[^/?#]+([^?#]*)", 1)


def url_origin(url: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(url, r"^(https?://[^/?#]+)", 1), r"//[^@]*@", "//")


def is_http(col: Column) -> Column:
    """True for anything that parses as an http(s) address."""
    return F.coalesce(_clean(col).rlike(r"(?i)^https?:[/\\]*[^/\\?#\s]+"), F.lit(False))
