"""Identity hashes of records and deterministic jitter."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def json_text(c: Column, kind: T.DataType) -> Column:
    """A value as JSON text with keys sorted and one space after ``:`` and ``,``; null as ``null``.

    Text, whole numbers, booleans and structures of them are equal to the usual text of other writers;
    fractions are written by the JVM and may differ in notation.
    """
    if isinstance(kind, T.StructType):
        fields = sorted(kind.fields, key=lambda f: f.name)
        parts = [F.concat(F.lit(f'"{f.name}": '), json_text(c.getField(f.name), f.dataType)) for f in fields]
        body = F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}")) if parts else F.lit("{}")
    elif isinstance(kind, T.ArrayType):
        body = F.concat(F.lit("["), F.array_join(F.transform(c, lambda x: json_text(x, kind.elementType)), ", "), F.lit("]"))
    elif isinstance(kind, T.StringType):
        body = F.get(F.split(F.to_json(F.struct(c.alias("v"))), r'^\{"v":'), F.lit(1))
        body = F.substring(body, F.lit(1), F.length(body) - 1)
    else:
        body = c.cast("string")
    return F.when(c.isNull(), F.lit("null")).otherwise(body)


def record_hash(columns: dict[str, tuple[Column, T.DataType]], method: str = "sha256") -> Column:
    """Hash of named values as sorted JSON; ``method`` is sha256 or md5."""
    parts = [F.concat(F.lit(f'"{n}": '), json_text(c, kind)) for n, (c, kind) in sorted(columns.items())]
    text = F.concat(F.lit("{"), F.concat_ws(", ", *parts), F.lit("}"))
    if method not in ("sha256", "md5"):
        raise ValueError(f"unknown hash method {method}")
    return F.sha2(text, 256) if method == "sha256" else F.md5(text)


def jitter_seconds(key: Column, instant: Column, most: int) -> Column:
    """Seconds from 0 to ``most``, always the same for a key and an instant."""
    if most <= 0:
        return F.lit(0).cast("bigint")
    iso = F.date_format(instant, "yyyy-MM-dd'T'HH:mm:ss'+00:00'")
    return F.conv(F.substring(F.sha2(F.concat(key, F.lit(":"), iso), 256), 1, 8), 16, 10).cast("bigint") % (most + 1)
