"""The transform vocabulary of field rules as column expressions.

A transform is ``name`` or ``{"type": name, ...options}``. :func:`apply_chain` folds a chain over a column; on
arrays every transform works element by element except those in :data:`WHOLE`. All of it stays in the JVM except
``title``, ``html_to_text``, ``urljoin`` and ``canonical_url``, which are Arrow UDFs because no built-in has their
meaning. Unknown names are ignored, as the vocabulary is closed by configuration checks; :func:`register` opens it.

A transform that cannot read its value (``int`` of ``12.5``, ``float`` of ``n/a``) raises, like a cast in ANSI mode;
``strict=False`` gives null instead, which the caller turns into the rule's default.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.functions import urls

#: Transforms that take a whole array.
WHOLE = frozenset(("join", "split", "first", "last", "list_index"))
_SPACE = r"[\s\x1c-\x1f]"  # white space in Python's sense, with (?U)
_NUMBER = r"-?\d+(?:\.\d+)?"

# Unit signs of numbers with their factors.
UNITS_ANYWHERE = (("亿", 1e8), ("万", 1e4))
UNITS_AT_END = (("k", 1e3), ("m", 1e6), ("b", 1e9))

Transform = Callable[[Column, dict], Column]


def strip(c: Column) -> Column:
    """Without leading and trailing white space of any script."""
    return F.regexp_replace(c, rf"(?U)^{_SPACE}+|{_SPACE}+$", "")


def normalize_space(c: Column) -> Column:
    """White space runs as one space, none at the ends."""
    return F.trim(F.regexp_replace(c, rf"(?U){_SPACE}+", " "))


def is_missing(c: Column, kind: str = "string") -> Column:
    """Null, the empty text and the empty array are missing; 0, false and empty objects are not."""
    return c.isNull() | ((c == "") if kind == "string" else (F.size(c) == 0) if kind == "array" else F.lit(False))


def present(c: Column) -> Column:
    """Null for the empty text."""
    return F.nullif(c, F.lit(""))


def number_text(c: Column) -> Column:
    """The first number of a text, thousands separators removed; null without any."""
    return present(F.regexp_extract(F.replace(c, F.lit(","), F.lit("")), _NUMBER, 0))


def number_parse(c: Column) -> Column:
    """First number times its unit: 亿 and 万 anywhere, k, m and b at the end of the text."""
    text = strip(F.replace(c, F.lit(","), F.lit("")))
    low = F.lower(text)
    unit = F.lit(1.0)
    for sign, factor in reversed(UNITS_AT_END):
        unit = F.when(low.endswith(sign), factor).otherwise(unit)
    for sign, factor in reversed(UNITS_ANYWHERE):
        unit = F.when(text.contains(sign), factor).otherwise(unit)
    return number_text(text).cast("double") * unit


def currency_parse(c: Column) -> Column:
    """:func:`number_parse` without currency signs."""
    return number_parse(F.translate(c, "$￥¥", ""))


def to_bool(c: Column) -> Column:
    """True for 1, true, yes, y and on, otherwise false."""
    return F.lower(strip(c)).isin("1", "true", "yes", "y", "on")


def java_pattern(pattern: str) -> str:
    """A Python regular expression for the JVM: named groups, end of text, Unicode classes, dots over lines."""
    return "(?sU)" + re.sub(r"\(\?P=(\w+)\)", r"\\k<\1>", pattern.replace("(?P<", "(?<").replace(r"\Z", r"\z"))


def regex_extract(c: Column, pattern: str, group: int | str | None = None, default: str = "") -> Column:
    """The first match: ``group`` by number or name, else group 1 if there is any; ``default`` without match."""
    compiled = re.compile(pattern, re.S)
    n = (1 if compiled.groups else 0) if group is None else int(group) if str(group).isdigit() else compiled.groupindex[str(group)]
    java = java_pattern(pattern)
    return F.when(c.rlike(java), F.regexp_extract(c, java, n)).when(c.isNotNull(), F.lit(default))


def regex_all(c: Column, pattern: str) -> Column:
    """All matches of a pattern, of group 1 if there is any."""
    return F.regexp_extract_all(c, F.lit(java_pattern(pattern)), F.lit(1 if re.compile(pattern).groups else 0))


def replace_pattern(c: Column, pattern: str, replacement: str = "") -> Column:
    """Regular expression replacement with ``\\1`` or ``\\g<1>`` for groups."""
    java = re.sub(r"\\g<(\w+)>|\\(\d)", lambda m: f"${m[1] or m[2]}", replacement.replace("$", r"\$"))
    return F.regexp_replace(c, java_pattern(pattern), java)


def split_text(c: Column, separator: str = ",") -> Column:
    """Stripped parts between a literal separator, blank ones left out."""
    return F.filter(F.transform(F.split(c, re.escape(separator).replace(r"\ ", " ")), strip), lambda x: x != "")


def join_items(c: Column, separator: str, null: str) -> Column:
    """Items of an array in one text; ``null`` stands for null items."""
    return F.array_join(F.transform(c, lambda x: x.cast("string")), separator, null)


def safe_name(c: Column) -> Column:
    """A text as file name: other characters as ``-``, none of ``.`` and ``-`` at the ends, ``item`` if nothing is left."""
    bare = F.regexp_replace(F.regexp_replace(c, r"[^A-Za-z0-9._-]+", "-"), r"^[.-]+|[.-]+$", "")
    return F.when(c.isNotNull(), F.coalesce(present(bare), F.lit("item")))


def remove_prefix(c: Column, prefix: str) -> Column:
    return F.when(F.startswith(c, F.lit(prefix)), F.substring(c, len(prefix) + 1, 1 << 30)).otherwise(c) if prefix else c


def remove_suffix(c: Column, suffix: str) -> Column:
    return F.when(F.endswith(c, F.lit(suffix)), F.substring(c, F.lit(1), F.length(c) - len(suffix))).otherwise(c) if suffix else c


def item(c: Column, index: int, default: object = "") -> Column:
    """Element of an array, from the end if negative; ``default`` beyond it."""
    found = F.try_element_at(c, F.lit(index + 1 if index >= 0 else index))
    return F.when((F.size(c) > index) if index >= 0 else (F.size(c) >= -index), found).otherwise(F.lit(default))


@F.pandas_udf(T.StringType())
def title_case(s: pd.Series) -> pd.Series:
    """Capital after every character that is no letter; the JVM's initcap knows spaces only."""
    return s.str.title()


@F.pandas_udf(T.StringType())
def html_to_text(s: pd.Series) -> pd.Series:
    """Text of an HTML fragment as the page query language sees it."""
    from weftline.functions.htmlquery import Page

    return s.map(lambda x: Page(x).text(0) if isinstance(x, str) else None)


def _each(one: Callable[[str], str]) -> Callable[[Column], Column]:
    """An Arrow UDF that maps the texts of an array; null items and null arrays stay."""

    @F.pandas_udf(T.ArrayType(T.StringType()))
    def mapped(s: pd.Series) -> pd.Series:
        return s.map(lambda xs: None if xs is None else [None if x is None else one(x) for x in xs])

    return mapped


def _text_of(fragment: str) -> str:
    from weftline.functions.htmlquery import Page

    return Page(fragment).text(0)


def _int(c: Column, o: dict) -> Column:
    n = number_text(c)
    return n.try_cast("bigint") if o.get("strict") is False else n.cast("bigint")


def _float(c: Column, o: dict) -> Column:
    n = number_text(c)
    return n.cast("double") if o.get("strict") is False else F.when(c.isNotNull() & n.isNull(), F.raise_error(F.concat(F.lit("not numeric: "), c)).cast("double")).otherwise(n.cast("double"))


_REGISTRY: dict[str, Transform] = {
    "strip": lambda c, o: strip(c),
    "normalize_space": lambda c, o: normalize_space(c),
    "lower": lambda c, o: F.lower(c),
    "upper": lambda c, o: F.upper(c),
    "title": lambda c, o: title_case(c),
    "int": _int,
    "float": _float,
    "number_parse": lambda c, o: number_parse(c),
    "currency_parse": lambda c, o: currency_parse(c),
    "bool": lambda c, o: to_bool(c),
    "json": lambda c, o: F.try_parse_json(c) if o.get("strict") is False else F.parse_json(c),
    "html_to_text": lambda c, o: html_to_text(c),
    "regex_extract": lambda c, o: regex_extract(c, str(o.get("pattern", "")), o.get("group"), o.get("default", "")),
    "default_if_empty": lambda c, o: F.coalesce(present(c), F.lit(o.get("value", o.get("default")))),
    "urljoin": lambda c, o: urls.join(F.lit(o["base_url"]) if o.get("base_url") else o["source_url"], c) if o.get("base_url") or o.get("source_url") is not None else c,
    "canonical_url": lambda c, o: urls.canonical(c),
    "strip_query": lambda c, o: urls.strip_query(c),
    "keep_query": lambda c, o: urls.keep_query(c, o.get("keys") if isinstance(o.get("keys"), list) else [o["keys"]] if o.get("keys") else []),
    "ensure_scheme": lambda c, o: urls.ensure_scheme(c, str(o.get("scheme", "https")).rstrip(":")),
    "length": lambda c, o: F.length(c),
    "replace": lambda c, o: replace_pattern(c, str(o.get("pattern", "")), str(o.get("replacement", ""))),
    "prefix": lambda c, o: F.concat(F.lit(str(o.get("value", ""))), c),
    "suffix": lambda c, o: F.concat(c, F.lit(str(o.get("value", "")))),
    "remove_prefix": lambda c, o: remove_prefix(c, str(o.get("value", ""))),
    "remove_suffix": lambda c, o: remove_suffix(c, str(o.get("value", ""))),
    "split": lambda c, o: split_text(c, str(o.get("value", ","))),
    "join": lambda c, o: join_items(c, str(o.get("value", o.get("join_with") or "")), "None"),
    "first": lambda c, o: item(c, 0, o.get("default", "")),
    "last": lambda c, o: item(c, -1, o.get("default", "")),
    "list_index": lambda c, o: item(c, int(o.get("index", o.get("value", 0))), o.get("default", "")),
}
#: The transforms that are Arrow UDFs, as they work on arrays; lambdas of the JVM cannot call them.
_LISTED: dict[str, Transform] = {
    "title": lambda c, o: _each(str.title)(c),
    "html_to_text": lambda c, o: _each(_text_of)(c),
    "urljoin": lambda c, o: urls.join_each(F.lit(o["base_url"]) if o.get("base_url") else o["source_url"], c) if o.get("base_url") or o.get("source_url") is not None else c,
    "canonical_url": lambda c, o: _each(urls.canonical_text)(c),
}


def register(name: str, transform: Transform) -> None:
    """Add a transform: ``(column, options) → column``."""
    _REGISTRY[name] = transform


def outside_jvm(chain: list) -> bool:
    """Whether a chain holds a transform that the JVM cannot call inside an array."""
    return any((step if isinstance(step, str) else step.get("type")) in _LISTED for step in chain)


def names() -> list[str]:
    """Known transforms."""
    return sorted(_REGISTRY)


def apply_chain(c: Column, chain: list, is_array: bool = False, source_url: Column | None = None, join_with: str | None = None, strict: bool = True) -> tuple[Column, bool]:
    """The column after all transforms, and whether it is an array then."""
    for step in chain:
        name, options = (step, {}) if isinstance(step, str) else (step.get("type"), dict(step))
        transform = _REGISTRY.get(name)
        if transform is None:
            continue
        options |= {"source_url": source_url, "join_with": join_with, "strict": strict}
        if name in ("first", "last", "list_index", "join"):
            if is_array:
                c, is_array = transform(c, options), False
        elif name == "split":
            c, is_array = (F.flatten(F.transform(c, lambda x: transform(x, options))) if is_array else transform(c, options)), True
        elif is_array and name in _LISTED:
            c = _LISTED[name](c, options)
        elif is_array:
            c = F.transform(c, lambda x: transform(x, options))  # noqa: B023  called at once
        else:
            c = transform(c, options)
    return (F.array_join(c, join_with, ""), False) if is_array and join_with is not None else (c, is_array)
