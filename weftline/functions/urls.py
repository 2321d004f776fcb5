"""Addresses: normal form, host, scope and query parameters, as column expressions.

Built-in URL functions reject addresses with odd hosts or spaces that occur in real pages, so parts are cut out
by patterns. Only joining (RFC 3986) is an Arrow UDF.
"""

from __future__ import annotations

from urllib.parse import urljoin, urlsplit, urlunsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Query parameters that only track where a visitor came from.
TRACKING = ("utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content", "fbclid", "gclid", "msclkid")

_AUTHORITY = r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)"
_SCHEME = r"^([A-Za-z][A-Za-z0-9+.-]*):"


def scheme(url: Column) -> Column:
    """Lower-case scheme, empty without any."""
    return F.lower(F.regexp_extract(url, _SCHEME, 1))


def authority(url: Column) -> Column:
    """Host with user and port as written, empty without any."""
    return F.regexp_extract(url, _AUTHORITY, 1)


def host(url: Column) -> Column:
    """Lower-case host without user and port; null for addresses without."""
    return F.lower(F.nullif(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/:?#]*)", 1), F.lit("")))


def path(url: Column) -> Column:
    return F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)", 1)


def query(url: Column) -> Column:
    """Text between ``?`` and ``#``."""
    return F.regexp_extract(url, r"^[^#?]*\?([^#]*)", 1)


def fragment(url: Column) -> Column:
    return F.regexp_extract(url, r"^[^#]*#(.*)$", 1)


def _encode(c: Column) -> Column:
    # the JVM's encoder and the usual form encoder differ in two characters
    return F.replace(F.replace(F.url_encode(c), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def _decode(c: Column) -> Column:
    return F.coalesce(F.try_url_decode(c), c)


def _key(pair: Column) -> Column:
    return _decode(F.substring_index(pair, "=", 1))


def _pair(pair: Column) -> Column:
    value = F.when(pair.contains("="), F.regexp_extract(pair, r"(?s)^[^=]*=(.*)$", 1)).otherwise(F.lit(""))
    return F.concat(_encode(_key(pair)), F.lit("="), _encode(_decode(value)))


def pairs(text: Column, keep) -> Column:
    """Query text of the pairs whose decoded key satisfies ``keep``, encoded anew; blank values stay."""
    found = F.filter(F.split(text, "&"), lambda p: (p != "") & keep(_key(p)))
    return F.array_join(F.transform(found, _pair), "&")


def build(scheme_: Column, authority_: Column, path_: Column, query_: Column, fragment_: Column | None = None) -> Column:
    """Put an address together; empty parts leave no separator."""
    parts = [F.when(scheme_ != "", F.concat(scheme_, F.lit(":"))).otherwise(""), F.when(authority_ != "", F.concat(F.lit("//"), authority_)).otherwise(""), path_, F.when(query_ != "", F.concat(F.lit("?"), query_)).otherwise("")]
    if fragment_ is not None:
        parts.append(F.when(fragment_ != "", F.concat(F.lit("#"), fragment_)).otherwise(""))
    return F.concat(*parts)


def normalize(url: Column, remove_fragment: bool = True, remove_tracking: bool = True, tracking: tuple[str, ...] = TRACKING) -> Column:
    """Lower-case scheme and authority, no fragment, no tracking parameters; what remains keeps its order."""
    q = query(url)
    if remove_tracking:
        drop = [t.lower() for t in tracking]
        q = F.when(q != "", pairs(q, lambda k: ~F.lower(k).isin(drop))).otherwise("")
    return build(scheme(url), F.lower(authority(url)), path(url), q, None if remove_fragment else fragment(url))


def strip_query(url: Column) -> Column:
    """Without query and fragment."""
    return build(scheme(url), authority(url), path(url), F.lit(""))


def keep_query(url: Column, keys: list[str]) -> Column:
    """Only the named parameters, all if none is named; no fragment."""
    u = F.trim(url)
    q = pairs(query(u), lambda k: k.isin([str(x) for x in keys])) if keys else query(u)
    return build(scheme(u), authority(u), path(u), q)


def drop_query(url: Column, keys: list[str]) -> Column:
    """Without the named parameters; the fragment stays."""
    return build(scheme(url), authority(url), path(url), pairs(query(url), lambda k: ~k.isin(list(keys))), fragment(url))


def add_params(url: Column, params: Column) -> Column:
    """Append a map of parameters; those in the address are never replaced."""
    text = F.array_join(F.transform(F.map_entries(params), lambda e: F.concat(_encode(e["key"]), F.lit("="), _encode(e["value"]))), "&")
    return F.when(params.isNull() | (F.size(params) == 0), url).otherwise(F.concat(url, F.when(url.contains("?"), F.lit("&")).otherwise(F.lit("?")), text))


def int_param(url: Column, name: str) -> Column:
    """Whole number in a query parameter, null if there is none."""
    found = F.filter(F.split(query(url), "&"), lambda p: _key(p) == name)
    return F.regexp_extract(F.element_at(F.concat(found, F.array(F.lit(""))), 1), r"^[^=]*=([+-]?\d+)$", 1).try_cast("bigint")


def ensure_scheme(url: Column, name: str = "https") -> Column:
    """Scheme in front of addresses that have none."""
    u = F.trim(url)
    return F.when(u.startswith("//"), F.concat(F.lit(f"{name}:"), u)).when(u.rlike(_SCHEME), u).otherwise(F.concat(F.lit(f"{name}://"), u))


def domain_matches(name: Column, domain: Column | str) -> Column:
    """Whether a host is a domain or lies below it."""
    d = F.lit(domain) if isinstance(domain, str) else domain
    return (name == d) | F.endswith(name, F.concat(F.lit("."), d))


def clean_domain(text: Column) -> Column:
    """Host of a domain written as host, ``*.host`` or address."""
    t = F.lower(F.trim(text))
    bare = F.coalesce(host(t), F.regexp_extract(t, r"^([^/:?#]*)", 1))
    return F.regexp_replace(bare, r"^(?:\*\.|\.)+|\.$", "")


def rate_key(url: Column, per_domain: bool = True) -> Column:
    """What a rate limit counts by: authority, else the first path segment, else ``local``."""
    if not per_domain:
        return F.lit("global")
    return F.coalesce(F.nullif(authority(url), F.lit("")), F.nullif(F.regexp_extract(path(url), r"^/*([^/]*)", 1), F.lit("")), F.lit("local"))


@F.pandas_udf(T.StringType())
def join(base: pd.Series, url: pd.Series) -> pd.Series:
    """Absolute address of a reference on a page."""
    return pd.Series([None if u is None else urljoin(b or "", u) for b, u in zip(base, url)])


@F.pandas_udf(T.ArrayType(T.StringType()))
def join_each(base: pd.Series, found: pd.Series) -> pd.Series:
    """:func:`join` of every reference of an array."""
    return pd.Series([None if xs is None else [None if x is None else urljoin(b or "", x) for x in xs] for b, xs in zip(base, found)])


def canonical_text(u: str) -> str:
    """Lower-case scheme and host, dot segments resolved, no fragment; the query stays."""
    p = urlsplit(u.strip())
    return urlunsplit((p.scheme.lower(), p.netloc.lower(), urljoin("/", p.path or "/"), p.query, ""))


@F.pandas_udf(T.StringType())
def canonical(url: pd.Series) -> pd.Series:
    """:func:`canonical_text` of a column."""
    return url.map(lambda u: None if u is None else canonical_text(u))
