"""Records as they leave: metadata, flattening, selection, aliases, redaction, paging."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.functions.hashing import json_text

# Parts of secret names, whole secret names, names of keys to interfaces, and what stands for a value.
SECRET_PARTS = ("password", "secret", "token", "authorization", "cookie")
SECRET_NAMES = ("session_id", "sessionid", "sid")
API_KEYS = ("api_key", "apikey")
MASK = "***REDACTED***"


def _pattern(api: bool = False) -> str:
    """The pattern of secret names, made from the lists above."""
    return "(?i)" + "|".join([*SECRET_PARTS, *(f"^{n}$" for n in SECRET_NAMES), *(API_KEYS if api else ())])


def is_secret(name: Column) -> Column:
    """Whether a key names something that must not leave."""
    return name.rlike(_pattern())


def _secret(name: str, api: bool) -> bool:
    return any(re.search(_pattern(api), part) for part in re.split(r"[.\[]", name))


def flatten(df: DataFrame, separator: str = "_", lists: str = "json", list_separator: str = ", ") -> DataFrame:
    """Nested structs as ``a_b`` columns; lists as JSON text or joined (nested items as JSON, nulls empty); maps
    as JSON text. Struct columns without fields vanish."""

    def walk(c: Column, kind: T.DataType, name: str) -> list[Column]:
        if isinstance(kind, T.StructType):
            return [x for f in kind.fields for x in walk(c.getField(f.name), f.dataType, f"{name}{separator}{f.name}")]
        if isinstance(kind, T.ArrayType):
            if lists == "json":
                return [json_text(c, kind).alias(name)]
            nested = isinstance(kind.elementType, (T.StructType, T.ArrayType))
            text = F.transform(c, lambda x: json_text(x, kind.elementType) if nested else x.cast("string"))
            return [F.array_join(text, list_separator, "").alias(name)]
        return [F.to_json(c).alias(name)] if isinstance(kind, T.MapType) else [c.alias(name)]

    return df.select(*[x for f in df.schema.fields for x in walk(F.col(f"`{f.name}`"), f.dataType, f.name)])


def redact(df: DataFrame, api: bool = False) -> DataFrame:
    """Values under secret keys masked, at any depth of structs, arrays of structs and maps."""

    def walk(c: Column, kind: T.DataType, name: str) -> Column:
        if name and _secret(name, api):
            return F.when(c.isNotNull(), F.lit(MASK))
        if isinstance(kind, T.StructType):
            return F.when(c.isNotNull(), F.struct(*[walk(c.getField(f.name), f.dataType, f.name).alias(f.name) for f in kind.fields]))
        if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, (T.StructType, T.MapType)):
            return F.transform(c, lambda x: walk(x, kind.elementType, ""))
        if isinstance(kind, T.MapType) and isinstance(kind.valueType, T.StringType):
            return F.transform_values(c, lambda k, v: F.when(k.rlike(_pattern(api)) & v.isNotNull(), F.lit(MASK)).otherwise(v))
        return c

    return df.select(*[walk(F.col(f"`{f.name}`"), f.dataType, f.name).alias(f.name) for f in df.schema.fields])


def select_fields(df: DataFrame, include: list[str] = (), exclude: list[str] = (), aliases: dict[str, str] | None = None, metadata: bool = True) -> DataFrame:
    """Included columns in the given order (missing ones empty), then exclusion, then new names. Columns that
    start with ``_`` only leave with ``metadata``."""
    cols = list(include) or [c for c in df.columns if metadata or not c.startswith("_")]
    have = set(df.columns)
    out = df.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) if include and c in have else F.col(f"`{c}`") if c in have else F.lit("").alias(c) for c in cols if c not in set(exclude)])
    return out.withColumnsRenamed({k: v for k, v in (aliases or {}).items() if k in out.columns})


def page(df: DataFrame, sort_by: str, descending: bool = False, limit: int = 50, offset: int = 0, tie: str | None = None) -> DataFrame:
    """One page of a sorted collection; nulls sort as the empty text."""
    order = [F.desc_nulls_last(sort_by) if descending else F.asc_nulls_first(sort_by)] + ([F.asc(tie)] if tie else [])
    return df.orderBy(*order).offset(offset).limit(limit)


def page_info(df: DataFrame, limit: int, offset: int) -> DataFrame:
    """``total, limit, offset, has_more`` of a page."""
    total = df.agg(F.count("*").alias("total"))
    return total.select("total", F.lit(limit).alias("limit"), F.lit(offset).alias("offset"), (F.lit(offset + limit) < F.col("total")).alias("has_more"))


def matches(df: DataFrame, equal: dict[str, str], created_after: str | None = None, created_before: str | None = None) -> DataFrame:
    """Rows of a collection that fit all filters; times compare as text, inclusive, created before started."""
    for k, v in equal.items():
        df = df.where(F.col(k) == v)
    have = [F.col(c) for c in ("created_at", "started_at") if c in df.columns]
    when = F.coalesce(*have, F.lit("")) if have else F.lit("")
    if created_after:
        df = df.where(when >= created_after)
    return df.where(when <= created_before) if created_before else df


def enrich(df: DataFrame, **columns: Column) -> DataFrame:
    """Columns added on saving; they replace extracted ones of the same name."""
    return df.withColumns(columns)
