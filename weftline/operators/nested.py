"""Deeply nested records as flat tables that keep parent and position.

Shared inlining: the schema graph of the input is analysed (:func:`schema_graph`), descendants that occur once
per parent are inlined as dotted columns, and every repeated, shared or recursive element becomes a table of
its own (:func:`shred`) whose rows hold the key of the record, their own positions and those of their parent.

Elements are addressed by ``path`` (keys from the root to the array, without indices, joined with dots) and
``pos`` (positions of the element and of the elements around it, outermost first). ``(record_key, path, pos)``
is the key of an element row and ``(record_key, parent_path, parent_pos)`` its foreign key; the parent of an
outermost element is the record (``parent_path`` and ``parent_pos`` are empty).

Defined results: null elements and scalars are no rows but count as positions; empty objects are rows; arrays
in arrays add a position but no key; null, empty or unreadable payloads have no rows; a record that occurs
repeatedly is counted once; keys that hold dots stay as they are, and of values whose dotted paths are equal one counts;
an empty table gives empty tables.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.functions.payloads import read_payload


def _elements(root: object) -> Iterator[tuple[str, str, str, str, dict]]:
    """(path, pos, parent path, parent pos, object) of every object in an array, without recursion."""
    stack = [(root, "", "", "", "")]
    while stack:
        value, path, pos, up, up_pos = stack.pop()
        if isinstance(value, dict):
            for k, v in value.items():
                if isinstance(v, (dict, list)):
                    stack.append((v, f"{path}.{k}" if path else k, pos, up, up_pos))
        elif isinstance(value, list):
            for i, v in enumerate(value):
                at = f"{pos}.{i}" if pos else str(i)
                if isinstance(v, dict):
                    yield path, at, up, up_pos, v
                    stack.append((v, path, at, path, at))
                elif isinstance(v, list):
                    stack.append((v, path, at, up, up_pos))


def _scalars(value: dict) -> dict[str, str]:
    """Singleton descendants of an object by dotted path; values as JSON text, strings as they are."""
    out: dict[str, str] = {}
    stack = [(value, "")]
    while stack:
        v, path = stack.pop()
        for k, x in v.items():
            p = f"{path}.{k}" if path else k
            if isinstance(x, dict):
                stack.append((x, p))
            elif not isinstance(x, list) and x is not None:
                out[p] = x if isinstance(x, str) else json.dumps(x, ensure_ascii=False)
    return out


def json_elements(df: DataFrame, key: Column | str, payload: Column | str, fields: bool = True) -> DataFrame:
    """Element rows of a JSON column: ``record_key, path, pos`` and, with ``fields``, the foreign key and the
    inlined values (``parent_path, parent_pos, fields map<string,string>``).

    One pass in Arrow batches; a record's elements travel as one array so that repeated records can be dropped
    before the rows are multiplied.
    """
    as_col = lambda c: F.col(c) if isinstance(c, str) else c
    # a few rows each time, for payloads may be long; the record's key and elements alone are shuffled
    rows = df.select(as_col(key).cast("string").alias("record_key"), as_col(payload).alias("payload"))
    return _read(_read_elements(rows, fields).distinct())


def _read(found: DataFrame) -> DataFrame:
    """Element rows of what :func:`_read_elements` found."""
    flat = found.select("record_key", F.explode("e").alias("e")).select("record_key", "e.*")
    return flat.withColumn("fields", F.from_json("fields", "map<string,string>")) if "fields" in flat.columns else flat


def _read_elements(rows: DataFrame, fields: bool) -> DataFrame:
    """``record_key, e``: the elements of each row of (key, JSON text) as one array."""
    cols = [("path", pa.string()), ("pos", pa.string())] + ([("parent_path", pa.string()), ("parent_pos", pa.string())] if fields else [])
    ddl = "path string, pos string" + (", parent_path string, parent_pos string, fields string" if fields else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, offsets = [], [0]
            out: list[list] = [[] for _ in range(5 if fields else 2)]
            for k, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if not text or "[" not in text:
                    continue
                for path, pos, up, up_pos, obj in _elements(read_payload(text)):
                    out[0].append(path)
                    out[1].append(pos)
                    if fields:
                        out[2].append(up)
                        out[3].append(up_pos)
                        out[4].append(json.dumps(_scalars(obj), ensure_ascii=False, sort_keys=True))
                if len(out[0]) > offsets[-1]:
                    keys.append(k)
                    offsets.append(len(out[0]))
            names = [n for n, _ in cols] + (["fields"] if fields else [])
            struct = pa.StructArray.from_arrays([pa.array(x, pa.string()) for x in out], names)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), struct)], ["record_key", "e"])

    return rows.mapInArrow(run, f"record_key string, e array<struct<{ddl.replace(' string', ':string')}>>")


def _within(kind: T.DataType) -> list[T.DataType]:
    """The types directly below a type."""
    if isinstance(kind, T.StructType):
        return [f.dataType for f in kind.fields]
    return [kind.valueType] if isinstance(kind, T.MapType) else [kind.elementType] if isinstance(kind, T.ArrayType) else []


def _holds(kind: T.DataType, *sought: type) -> bool:
    return isinstance(kind, sought) or any(_holds(x, *sought) for x in _within(kind))


def _has_rows(kind: T.DataType) -> bool:
    """Whether objects (structs, maps) are elements of an array somewhere in the type."""
    return isinstance(kind, T.ArrayType) and isinstance(kind.elementType, _OBJECTS) or any(map(_has_rows, _within(kind)))


_OBJECTS = (T.StructType, T.MapType)
_AT = "array<struct<path:string,pos:string>>"
_PAIRS = "array<struct<key:string,value:string>>"


def _text(x: Column | str) -> Column:
    return F.lit(x) if isinstance(x, str) else x


def _joined(path: Column | str, key: Column | str) -> Column | str:
    """Path and key with a dot; a text as long as no key of a map is part of it."""
    if isinstance(path, str):
        if isinstance(key, str) or not path:
            return f"{path}.{key}" if path else key
        return F.concat(F.lit(f"{path}."), key)
    return F.when(path == "", _text(key)).otherwise(F.concat(path, F.lit("."), _text(key)))


def _spread(values: Column, below: Callable[[Column, Column], Column], kind: str) -> Column:
    """The arrays that ``below`` makes of the elements of an array and their positions, as one; none for nulls."""
    none = F.array().cast(kind)
    return F.coalesce(F.flatten(F.transform(values, lambda x, i: F.coalesce(below(x, i), none))), none)


def _pairs(c: Column, kind: T.DataType, path: Column | str) -> Column:
    """Array of (dotted path, value) of the singleton descendants of an object; of paths that are equal the first counts."""
    none = F.array().cast(_PAIRS)
    pair = lambda k, v: F.struct(_text(k).alias("key"), v.cast("string").alias("value"))
    if isinstance(kind, T.MapType):
        at = lambda e: _joined(path, e["key"].cast("string"))
        if isinstance(kind.valueType, _OBJECTS):
            return _spread(F.map_entries(c), lambda e, _: _pairs(e["value"], kind.valueType, at(e)), _PAIRS)
        return none if isinstance(kind.valueType, T.ArrayType) else F.coalesce(F.transform(F.map_entries(c), lambda e: pair(at(e), e["value"])), none)
    inner = [_pairs(c.getField(f.name), f.dataType, _joined(path, f.name)) for f in kind.fields if isinstance(f.dataType, _OBJECTS)]
    own = [pair(_joined(path, f.name), c.getField(f.name)) for f in kind.fields if not isinstance(f.dataType, (*_OBJECTS, T.ArrayType))]
    return F.concat(none, *inner, F.array(*own).cast(_PAIRS))


def _inline(schema: T.StructType, c: Column, path: str = "") -> Iterator[tuple[str, Column]]:
    for f in schema.fields:
        at, x = _joined(path, f.name), c.getField(f.name)
        if isinstance(f.dataType, T.StructType):
            yield from _inline(f.dataType, x, at)
        elif not isinstance(f.dataType, T.ArrayType):
            yield at, x


def _values(c: Column, kind: T.DataType) -> Column:
    """The inlined values of an object, as :func:`_scalars`."""
    if not _keys_vary(kind):
        found = list(_inline(kind, c))
        if len({name for name, _ in found}) == len(found):
            pairs = [x for name, v in found for x in (F.lit(name), v.cast("string"))]
            return F.map_filter(F.create_map(*pairs), lambda k, v: v.isNotNull()) if pairs else F.expr("cast(map() as map<string,string>)")
    pairs = F.filter(_pairs(c, kind, ""), lambda e: e["value"].isNotNull())
    keys = F.transform(pairs, lambda e: e["key"])
    first = F.filter(pairs, lambda e, i: F.array_position(keys, e["key"]) == i + 1)
    return F.when(F.size(F.array_distinct(keys)) == F.size(keys), F.map_from_entries(pairs)).otherwise(F.map_from_entries(first))


def _keys_vary(kind: T.DataType) -> bool:
    """Whether a map is among an object and its singleton descendants."""
    return isinstance(kind, T.MapType) or isinstance(kind, T.StructType) and any(_keys_vary(f.dataType) for f in kind.fields)


def _positions(c: Column, kind: T.DataType, path: Column | str, around: Column | None = None) -> Column:
    """Array of (path, pos) of the objects in the arrays of a value."""
    none = F.array().cast(_AT)
    if not _has_rows(kind):
        return none
    if isinstance(kind, T.StructType):
        return F.concat(none, *[_positions(c.getField(f.name), f.dataType, _joined(path, f.name), around) for f in kind.fields if _has_rows(f.dataType)])
    if isinstance(kind, T.MapType):
        return _spread(F.map_entries(c), lambda e, _: _positions(e["value"], kind.valueType, _joined(path, e["key"].cast("string")), around), _AT)
    at = lambda i: i.cast("string") if around is None else F.concat(around, F.lit("."), i.cast("string"))
    parts = []
    if isinstance(kind.elementType, _OBJECTS):
        own = F.transform(c, lambda x, i: F.when(x.isNotNull(), F.struct(_text(path).alias("path"), at(i).alias("pos"))))
        parts.append(F.coalesce(F.filter(own, lambda e: e.isNotNull()), none))
    if _has_rows(kind.elementType):
        parts.append(_spread(c, lambda x, i: _positions(x, kind.elementType, path, at(i)), _AT))
    return F.concat(none, *parts)


def struct_elements(df: DataFrame, key: str, fields: bool = True) -> DataFrame:
    """Element rows of the typed columns of ``df``, as :func:`json_elements`; all in the JVM.

    The schema is the graph: each array of objects below it is one chain of ``posexplode``. Structs and maps are
    objects, the keys of a map (as text) being keys like any other. Only the columns that hold arrays are read;
    what a column with variants holds no schema tells, so it is read as JSON.
    """
    parts: list[DataFrame] = []

    def walk(rows: DataFrame, c: Column, path: Column | str, kind: T.DataType) -> None:
        """``rows`` has the key of the record, the positions so far and the element (or record) around value ``c``."""
        if not _has_rows(kind):
            return
        if isinstance(kind, T.StructType):
            for f in kind.fields:
                walk(rows, c.getField(f.name), _joined(path, f.name), f.dataType)
            return
        held = ["record_key", "pos", "parent_path", "parent_pos", _text(path).alias("path")]
        own = path if isinstance(path, str) else F.col("path")
        if isinstance(kind, T.MapType):
            walk(rows.select(*held, F.explode(c).alias("k", "v")), F.col("v"), _joined(own, F.col("k").cast("string")), kind.valueType)
            return
        rows = rows.select(*held, F.posexplode(c).alias("i", "v"))
        rows = rows.withColumn("pos", F.when(F.col("pos") == "", F.col("i").cast("string")).otherwise(F.concat_ws(".", "pos", "i")))
        if isinstance(kind.elementType, _OBJECTS):
            rows = rows.where(F.col("v").isNotNull())
            parts.append(rows.select("record_key", _text(own).alias("path"), "pos", "parent_path", "parent_pos", _values(F.col("v"), kind.elementType).alias("fields")))
            rows = rows.select("record_key", "pos", "path", _text(own).alias("parent_path"), F.col("pos").alias("parent_pos"), "v")
        walk(rows, F.col("v"), own, kind.elementType)

    unknown = [f.name for f in df.schema.fields if _holds(f.dataType, T.VariantType)]
    found = [f for f in df.schema.fields if _holds(f.dataType, T.ArrayType) and f.name not in unknown]
    if found or unknown:
        # the columns travel in one struct, so none of them can clash with the columns made here
        source = [F.struct(*[F.col(f"`{f.name}`") for f in found]).alias("source")] if found else []
        text = [F.to_json(F.struct(*[F.col(f"`{c}`") for c in unknown]), {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}).alias("text")] if unknown else []
        base = df.select(F.col(f"`{key}`").cast("string").alias("record_key"), *source, *text)
        base = base.groupBy(*base.columns).agg(F.count("*").alias("n")).drop("n") if any(_holds(f.dataType, T.MapType) for f in found) else base.distinct()
        if unknown:
            parts.append(_read(_read_elements(base.select("record_key", "text"), fields)))
        kind = T.StructType(found)
        if not fields and _has_rows(kind):  # one scan, one shuffle, one explode for all arrays
            parts.append(base.select("record_key", F.explode(_positions(F.col("source"), kind, "")).alias("e")).select("record_key", "e.path", "e.pos"))
        elif found:
            walk(base.select("record_key", "source", *[F.lit("").alias(c) for c in ("pos", "parent_path", "parent_pos")]), F.col("source"), "", kind)
    if not parts:
        extra = ", parent_path string, parent_pos string, fields map<string,string>" if fields else ""
        return df.sparkSession.createDataFrame([], f"record_key string, path string, pos string{extra}")
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out


def schema_graph(elements: DataFrame) -> DataFrame:
    """The tables that :func:`shred` makes: ``table_path, parent_path, columns, recursive, n_rows``.

    A path that repeats one of its own keys (replies to replies) is recursive: all its levels share the table
    of the shortest such path, and the foreign key points into the same table.
    """
    return (
        elements.withColumn("table_path", shared_path(F.col("path")))
        .groupBy("table_path")
        .agg(
            F.min(shared_path(F.col("parent_path"))).alias("parent_path"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_set(F.map_keys("fields"))))).alias("columns"),
            F.max(F.col("path") != F.col("table_path")).alias("recursive"),
            F.count("*").alias("n_rows"),
        )
    )


def shared_path(path: Column) -> Column:
    """``a.b.c.b.c`` → ``a.b.c``: runs of repeated keys are cut, so recursive levels share a table."""
    return F.regexp_replace(path, r"(^|\.)([^.]+(?:\.[^.]+)*?)(?:\.\2)+(?=\.|$)", "$1$2")


def shred(elements: DataFrame, max_tables: int = 500) -> dict[str, DataFrame]:
    """One flat table per repeated element with ``record_key, pos, parent_path, parent_pos`` and a column per
    inlined value. The list of tables and columns is a schema, not data: at most ``max_tables`` rows of it."""
    graph = schema_graph(elements).limit(max_tables + 1).collect()
    if len(graph) > max_tables:
        raise ValueError(f"more than {max_tables} repeated elements; raise max_tables")
    rows = elements.withColumn("table_path", shared_path(F.col("path")))
    taken = ("record_key", "path", "pos", "parent_path", "parent_pos")
    return {
        g.table_path: rows.where(F.col("table_path") == g.table_path).select(
            *taken, *[F.col("fields").getItem(c).alias(f"{c}_value" if c in taken else c) for c in g.columns]
        )
        for g in graph
    }
