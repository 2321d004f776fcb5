"""Schemas that drift between files: what changed from file to file, and one consistent table of all of them.

Versioned fingerprints with explicit migration steps:

1. :func:`observe` reads every document once. Its *fingerprint* is the set of (dotted path, type) of its
   non-null scalars and arrays. Documents leave only a hash of the fingerprint; values leave mergeable profiles
   per (file, path): counts, lengths, character classes, numeric moments, keys of array elements and a
   sketch of the values (smallest hash per bucket). Nothing else of the payload is shuffled.
2. :func:`file_fields` counts types per file and field from the fingerprints.
3. :func:`changes` compares each file with the one before: added, removed, retyped, and renamed where the
   profile of a removed path goes on under an added path.
4. :func:`migration_rules` chains these changes into cast, remove, rename and default steps per file;
   :func:`unify` routes every document through the steps of its file. What is removed or cannot be cast is kept
   aside. Casts take the notation of the file that brought the type: words of truth values, separators of joined
   lists, instants as text or as seconds or milliseconds since 1970.

Paths go through objects and end at a scalar or array. A file is (origin, spider_id, file_no); a file without
a readable document is no file. Whole-row repeats count once where documents are counted; value profiles, which only
compare shares and shapes, see them as often as they occur, as telling them apart would shuffle all payloads. Types: string, number, boolean, array; in a tie
the type that comes first in that list holds. Documents that are null, empty, unreadable or no objects are
skipped. Keys that hold dots are not told apart from nested keys. Empty tables give empty results.
"""

from __future__ import annotations

import json
import math
import re
from collections.abc import Iterator
from datetime import datetime, timezone
from hashlib import blake2b
from zlib import crc32

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.functions.payloads import read_payload
from weftline.shared import discard, materialize

FILE = ("origin", "spider_id", "file_no")
TYPES = ("string", "number", "boolean", "array")
#: Buckets of a value sketch; each keeps the smallest hash of the values that fall into it.
SKETCH = 48
#: Profiles held by a task before it passes them on; only the number of partial rows depends on it.
HELD = 40_000
_CLASSES = str.maketrans({**{chr(c): "A" for c in range(65, 91)}, **{chr(c): "a" for c in range(97, 123)}, **{chr(c): "9" for c in range(48, 58)}})
_SUMS = ("n", "n_true", "length", "length2", "lower", "upper", "digit", "space", "other", "x", "x2", "whole", "size", "objects", "iso", "zulu", "bar", "semicolon", "comma", "spaced", "listed")
#: Words for true and false that casts read and write.
WORDS = (("true", "false"), ("True", "False"), ("TRUE", "FALSE"), ("yes", "no"), ("Yes", "No"), ("on", "off"), ("1", "0"), ("y", "n"), ("t", "f"))
_TRUTH = {w.lower(): not i for pair in WORDS for i, w in enumerate(pair)}
#: Order of the steps of one file.
KINDS = ("cast", "removed", "renamed", "retyped", "added")


def leaves(document: dict) -> Iterator[tuple[str, object]]:
    """(dotted path, value) of the scalars and arrays of an object, nulls left out."""
    stack = [("", document)]
    while stack:
        prefix, obj = stack.pop()
        for k, v in obj.items():
            path = f"{prefix}.{k}" if prefix else k
            if isinstance(v, dict):
                stack.append((path, v))
            elif v is not None:
                yield path, v


def type_of(value: object) -> str:
    """One of :data:`TYPES`."""
    if isinstance(value, str):
        return "string"
    if isinstance(value, bool):
        return "boolean"
    return "array" if isinstance(value, list) else "number"


class _Profile:
    """Mergeable statistics of the values under one path of one file."""

    __slots__ = ("first", "keys", "sums", "top")

    def __init__(self) -> None:
        self.sums = [0.0] * len(_SUMS)
        self.top: list[int | None] = [None] * SKETCH
        self.keys: set[str] = set()

    def add(self, v: object) -> None:
        s = self.sums
        s[0] += 1
        if isinstance(v, str):
            shape = v.translate(_CLASSES)
            n = len(v)
            a, u, d, b = shape.count("a"), shape.count("A"), shape.count("9"), shape.count(" ")
            s[2] += n
            s[3] += n * n
            s[4] += a
            s[5] += u
            s[6] += d
            s[7] += b
            s[8] += n - a - u - d - b
            if shape[:10] == "9999-99-99":
                s[14] += 1
                s[15] += v[-1] == "Z"
            if "|" in v:
                s[16] += 1
            if ";" in v:
                s[17] += 1
            if "," in v:
                s[18] += 1
                s[19] += ", " in v
            s[20] += v[:1] == "["
            h = crc32(v.encode("utf-8", "surrogatepass"))
        elif v is True or v is False:
            s[1] += v
            h = int(v)
        elif isinstance(v, list):
            s[12] += len(v)
            for x in v:
                if isinstance(x, dict):
                    s[13] += 1
                    self.keys.update(x)
            h = crc32(json.dumps(v, sort_keys=True).encode()) if v else 2
        else:
            y = math.copysign(math.log1p(abs(v)), v) if v == v and abs(v) != math.inf else 0.0
            s[9] += y
            s[10] += y * y
            s[11] += v == int(v) if abs(v) < 1e300 and v == v else 0
            h = crc32(repr(float(v)).encode()) if abs(v) < 1e300 else 3
        low = self.top[h % SKETCH]
        if low is None or h < low:
            self.top[h % SKETCH] = h


def _fingerprint(document: dict) -> list[tuple[str, object, str]]:
    return sorted(((p, v, type_of(v)) for p, v in leaves(document)), key=lambda x: x[0])


_OBSERVED = "origin string, spider_id string, file_no long, row_hash long, print long, fields array<struct<path:string,type:string>>, path string, type string, sums array<double>, top array<long>, keys array<string>"
_OBSERVED_ARROW = pa.schema(
    [("origin", pa.string()), ("spider_id", pa.string()), ("file_no", pa.int64()), ("row_hash", pa.int64()), ("print", pa.int64()), ("fields", pa.list_(pa.struct([("path", pa.string()), ("type", pa.string())]))), ("path", pa.string()), ("type", pa.string()), ("sums", pa.list_(pa.float64())), ("top", pa.list_(pa.int64())), ("keys", pa.list_(pa.string()))]
)


_RENAMED_ARROW = pa.schema([("origin", pa.string()), ("spider_id", pa.string()), ("old_no", pa.int64()), ("file_no", pa.int64()), ("old_path", pa.string()), ("new_path", pa.string())])


def observe(df: DataFrame, origin: str, spider_id: str, file_no: str, document: str) -> DataFrame:
    """Fingerprints (rows with ``print``) and partial value profiles (rows with ``path``) of all documents."""
    rows = df.select(
        F.lit(origin).alias("origin"), F.col(spider_id).cast("string").alias("spider_id"), F.col(file_no).cast("bigint").alias("file_no"), F.xxhash64(*[F.to_json(c) if "<" in kind else F.col(f"`{c}`") for c, kind in df.dtypes]).alias("row_hash"), F.col(document).alias("document")
    ).where("spider_id is not null and file_no is not null and document is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, _Profile] = {}
        told: set[tuple] = set()

        def flush() -> Iterator[pa.RecordBatch]:
            out = [
                {"origin": k[0], "spider_id": k[1], "file_no": k[2], "path": k[3], "type": k[4], "sums": p.sums, "top": p.top, "keys": sorted(p.keys)}
                for k, p in held.items()
            ]
            held.clear()
            if out:
                yield pa.RecordBatch.from_pylist(out, _OBSERVED_ARROW)

        for batch in batches:
            out = {k: [] for k in ("origin", "spider_id", "file_no", "row_hash", "print", "fields")}
            for o, s, f, h, text in zip(*(c.to_pylist() for c in batch.columns)):
                document = read_payload(text)
                if not isinstance(document, dict):
                    continue
                prints = _fingerprint(document)
                key = hash_of(prints)
                for p, v, t in prints:
                    at = (o, s, f, p, t)
                    if (found := held.get(at)) is None:
                        found = held[at] = _Profile()
                    found.add(v)
                fields = None
                if (s, f, key) not in told:
                    if len(told) > HELD:
                        told.clear()
                    told.add((s, f, key))
                    fields = [{"path": p, "type": t} for p, _, t in prints]
                for k, x in zip(out, (o, s, f, h, key, fields)):
                    out[k].append(x)
            n = len(out["origin"])
            empty = {"path": pa.nulls(n, pa.string()), "type": pa.nulls(n, pa.string()), "sums": pa.nulls(n, _OBSERVED_ARROW.field("sums").type), "top": pa.nulls(n, _OBSERVED_ARROW.field("top").type), "keys": pa.nulls(n, _OBSERVED_ARROW.field("keys").type)}
            yield pa.RecordBatch.from_arrays([pa.array(out[x.name], x.type) if x.name in out else empty[x.name] for x in _OBSERVED_ARROW], schema=_OBSERVED_ARROW)
            if len(held) > HELD:
                yield from flush()
        yield from flush()

    return rows.mapInArrow(run, _OBSERVED)


def hash_of(prints: list[tuple[str, object, str]]) -> int:
    """64 bits of a fingerprint."""
    text = "\x1f".join([f"{p}\x1e{t}" for p, _, t in prints]).encode("utf-8", "surrogatepass")
    return int.from_bytes(blake2b(text, digest_size=8).digest(), "big", signed=True)


def file_fields(observed: DataFrame) -> DataFrame:
    """``origin, spider_id, file_no, path, type, n_docs, n_types, n_file``: the fields of each file with their main type.

    Repeated rows are dropped by row hash before anything is counted.
    """
    docs = observed.where("print is not null").groupBy(*FILE, "print", "row_hash").agg(F.max("fields").alias("fields"))
    prints = docs.groupBy(*FILE, "print").agg(F.count("*").alias("n"), F.max("fields").alias("fields"))
    # one row per (file, fingerprint): few, however many documents there are
    total = prints.groupBy(*FILE).agg(F.sum("n").alias("n_file"))
    rank = F.array_position(F.array(*[F.lit(t) for t in TYPES]), F.col("type"))
    per_type = prints.select(*FILE, "n", F.explode("fields").alias("x")).groupBy(*FILE, F.col("x.path").alias("path"), F.col("x.type").alias("type")).agg(F.sum("n").alias("n"))
    best = per_type.groupBy(*FILE, "path").agg(F.max_by("type", F.struct("n", -rank)).alias("type"), F.sum("n").alias("n_docs"), F.count("*").alias("n_types"))
    return best.join(total, list(FILE))


def profiles(observed: DataFrame) -> DataFrame:
    """Merged profiles per file, path and type."""
    rows = observed.where("path is not null")
    sums = [F.sum(F.col("sums")[i]).alias(name) for i, name in enumerate(_SUMS)]
    top = F.array(*[F.min(F.get("top", F.lit(i))) for i in range(SKETCH)]).alias("top")
    # equal key lists of partial profiles count once, so what is gathered is the variety of keys, not of tasks
    return rows.groupBy(*FILE, "path", "type").agg(*sums, top, F.array_sort(F.array_distinct(F.flatten(F.collect_set("keys")))).alias("keys"))


def transitions(fields: DataFrame) -> DataFrame:
    """``origin, spider_id, old_no, file_no``: each file and the one before it of the same spider."""
    files = fields.select(*FILE).distinct()
    w = Window.partitionBy("origin", "spider_id").orderBy("file_no")
    return files.select("origin", "spider_id", F.lag("file_no").over(w).alias("old_no"), "file_no").where("old_no is not null")


def _words(path: str) -> set[str]:
    return {w.lower().rstrip("s") for w in re.findall(r"[A-Z]?[a-z0-9]+|[A-Z]+(?![a-z])", path.replace("_", " ").replace(".", " "))}


def _shape_distance(o: dict, n: dict) -> float:
    """Between 0 (alike) and about 1: how differently the values under two paths look."""
    if o["type"] != n["type"]:
        return 1.0
    a, b = max(1.0, o["n"]), max(1.0, n["n"])
    if o["type"] == "string":
        la, lb = max(1.0, o["length"]), max(1.0, n["length"])
        mix = sum(abs(o[c] / la - n[c] / lb) for c in ("lower", "upper", "digit", "space", "other")) / 2
        ma, mb = o["length"] / a, n["length"] / b
        spread = math.sqrt(max(0.0, o["length2"] / a - ma * ma)) + math.sqrt(max(0.0, n["length2"] / b - mb * mb))
        return min(1.0, 2.5 * mix + 0.5 * max(0.0, abs(ma - mb) - 0.6 * spread - 1) / (1 + max(ma, mb)) * 2)
    if o["type"] == "number":
        ma, mb = o["x"] / a, n["x"] / b
        sa, sb = (math.sqrt(max(0.0, q / c - m * m)) for q, c, m in ((o["x2"], a, ma), (n["x2"], b, mb)))
        return min(1.0, max(0.0, abs(ma - mb) - 0.8 * (sa + sb)) / 1.5 + abs(o["whole"] / a - n["whole"] / b) + min(0.3, abs(sa - sb) / (0.2 + sa + sb) * 0.4))
    if o["type"] == "array":
        ka, kb = set(o["keys"]), set(n["keys"])
        alike = len(ka & kb) / len(ka | kb) if ka and kb else 0.75 if not ka and not kb else 0.0
        if min(o["objects"], n["objects"]) <= 2 and (ka or kb):
            alike = max(alike, 0.62)  # too few objects to tell
        return min(1.0, 1 - alike + 0.1 * min(1.0, abs(o["size"] / a - n["size"] / b)))
    return 0.35 + 0.3 * abs(o["n_true"] / a - n["n_true"] / b)


def score(old: dict, new: dict, support: float) -> float:
    """How surely ``new`` carries on the values of ``old``; above 0 it is called renamed.

    ``old`` and ``new`` hold ``path, type, rate`` (share of documents that have the field), ``n_file``
    (documents of the file) and the profile; ``support`` is the share of removals of the old path, in all
    spiders, that came with this new path. With one document a file, such as a saved configuration, the value
    must be the same; with more, alike in shape, size and rate.
    """
    if old["type"] != new["type"]:
        return -1.0
    both = [(a, b) for a, b in zip(old["top"], new["top"]) if a is not None or b is not None]
    same = sum(a == b for a, b in both) / max(1, len(both))
    distinct = min(sum(a is not None for a, _ in both), sum(b is not None for _, b in both))
    wa, wb = _words(old["path"]), _words(new["path"])
    name = len(wa & wb) / max(1, min(len(wa), len(wb)))
    apart = _shape_distance(old, new)
    rate = abs(old["rate"] - new["rate"])
    value = 0.0
    if old["n_file"] == 1 and new["n_file"] == 1:
        return 0.35 * name + 1.2 * support - 0.2 if same == 1 else -1.0
    if distinct >= 4 and same > 0:
        value = min(1.0, 3 * same)
    elif distinct < 4:
        value = 0.4 * same
    return 0.8 * (1 - apart) + 0.9 * value + 0.45 * name + 0.5 * min(1.0, support) - 0.8 * rate - (0.35 if apart > 0.45 else 0) - 0.27


def _notation() -> Column:
    """How the values of a profile are written, for casts into (or, for arrays, out of) that notation."""
    words = F.coalesce(*[F.when(F.exists("top", lambda h: h.isin([crc32(w.encode()) for w in pair])), F.lit(i)) for i, pair in enumerate(WORDS)])
    joiner = F.when(F.col("listed") * 2 > F.col("n"), "[").when(F.col("bar") > 0, "|").when(F.col("semicolon") > 0, ";").when(F.col("spaced") * 2 > F.col("comma"), ", ").when(F.col("comma") > 0, ",")
    size = F.col("x") / F.col("n")
    instant = F.when(F.col("type") == "number", F.when(size > 25, "ms").when(size > 18.4, "s")).when(F.col("iso") * 2 > F.col("n"), F.when(F.col("zulu") * 2 > F.col("n"), "Z").otherwise("+00:00"))
    return F.struct(words.alias("words"), joiner.alias("joiner"), instant.alias("instant"))


def changes(observed: DataFrame, detailed: bool = False) -> DataFrame:
    """``origin, spider_id, file_no, change_kind, field, old_field`` of every file against the one before, ``old_no``.

    ``detailed`` is what migration needs: ``to_type`` and ``notation`` of retyped fields, and rows of the kind
    ``cast`` for the fields that hold values of more than one type within a file.

    ``observed`` is read several times and should be a table (see :func:`drift`).
    """
    fields = materialize(file_fields(observed), "drift-fields")
    steps = transitions(fields)
    new = fields.join(steps, list(FILE)).select("origin", "spider_id", "old_no", "file_no", "path", F.col("type").alias("new_type"), (F.col("n_docs") / F.col("n_file")).alias("new_rate"), F.col("n_file").alias("new_files"))
    old = fields.withColumnRenamed("file_no", "old_no").join(steps, ["origin", "spider_id", "old_no"]).select("origin", "spider_id", "old_no", "file_no", "path", F.col("type").alias("old_type"), (F.col("n_docs") / F.col("n_file")).alias("old_rate"), F.col("n_file").alias("old_files"))
    both = materialize(new.join(old, ["origin", "spider_id", "old_no", "file_no", "path"], "full").where("not (new_type <=> old_type)"), "drift-diff")
    added, removed = both.where("old_type is null"), both.where("new_type is null")
    retyped = both.where("old_type is not null and new_type is not null")

    prof = profiles(observed)
    at = ["origin", "spider_id", "old_no", "file_no"]
    side = lambda d, t, r, no: d.join(
        prof.withColumnRenamed("file_no", no), ["origin", "spider_id", no, "path"]
    ).where(F.col("type") == F.col(t)).select(*at, F.struct("path", "type", F.col(r).alias("rate"), F.col(f"{t[:3]}_files").alias("n_file"), *_SUMS, "top", "keys").alias(t[:3]))
    # pairs within one step of one spider, of the fields that came with those that went: some tens at most
    pairs = materialize(side(removed, "old_type", "old_rate", "old_no").join(side(added, "new_type", "new_rate", "file_no"), at).where("old.type = new.type"), "drift-pairs")
    gone = removed.groupBy("origin", F.col("path").alias("old_path")).agg(F.count("*").alias("n_gone"))
    alike = pairs.where("old.n > 1 or old.top = new.top").groupBy("origin", F.col("old.path").alias("old_path"), F.col("new.path").alias("new_path")).agg(F.count("*").alias("n_pair"))
    support = alike.join(gone, ["origin", "old_path"]).select("origin", "old_path", "new_path", (F.col("n_pair") / (F.col("n_gone") + 3)).alias("support"))
    judged = pairs.withColumns({"old_path": F.col("old.path"), "new_path": F.col("new.path")}).join(support, ["origin", "old_path", "new_path"], "left")
    judged = judged.select(*at, "support", F.to_json("old").alias("old"), F.to_json("new").alias("new"))

    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[dict] = []
            for row in batch.to_pylist():
                read = ((json.loads(c["old"]), json.loads(c["new"]), c["support"] or 0.0) for c in row.pop("candidates"))
                used_old, used_new = set(), set()
                for s, o, n in sorted(((score(o, n, s), o["path"], n["path"]) for o, n, s in read), key=lambda x: (-x[0], x[1], x[2])):
                    if s > 0 and o not in used_old and n not in used_new:
                        used_old.add(o)
                        used_new.add(n)
                        out.append(row | {"old_path": o, "new_path": n})
            yield pa.RecordBatch.from_pylist(out, _RENAMED_ARROW)

    steps_pairs = judged.groupBy(*at).agg(F.collect_list(F.struct("support", "old", "new")).alias("candidates"))
    renamed = materialize(steps_pairs.mapInArrow(match, "origin string, spider_id string, old_no long, file_no long, old_path string, new_path string"), "drift-renamed")
    if detailed:
        # arrays are made of text in the notation of the file before, everything else is written as in the new file
        turned = retyped.select(*FILE, "old_no", "path", F.col("new_type").alias("to_type"), F.lit("retyped").alias("change_kind"))
        several = fields.where("n_types > 1").select(*FILE, F.col("file_no").alias("old_no"), "path", F.col("type").alias("to_type"), F.lit("cast").alias("change_kind"))
        target = turned.unionByName(several).withColumn("_no", F.when(F.col("to_type") == "array", F.col("old_no")).otherwise(F.col("file_no"))).withColumn("_type", F.when(F.col("to_type") == "array", "string").otherwise(F.col("to_type")))
        written = prof.select("origin", "spider_id", F.col("file_no").alias("_no"), "path", F.col("type").alias("_type"), _notation().alias("notation"))
        casts = materialize(target.join(written, ["origin", "spider_id", "_no", "path", "_type"], "left").select(*FILE, "old_no", "path", "to_type", "change_kind", "notation"), "drift-casts")
    discard(fields, pairs)
    cols = lambda kind, field, old_field: [*FILE, F.lit(kind).alias("change_kind"), field.alias("field"), old_field.alias("old_field"), "old_no"]
    new_in, old_in = renamed.select(*at, F.col("new_path").alias("path")), renamed.select(*at, F.col("old_path").alias("path"))
    none = F.lit("")
    out = (
        added.join(new_in, [*at, "path"], "left_anti").select(*cols("added", F.col("path"), none))
        .unionByName(removed.join(old_in, [*at, "path"], "left_anti").select(*cols("removed", F.col("path"), none)))
        .unionByName(renamed.select(*cols("renamed", F.col("new_path"), F.col("old_path"))))
    )
    if detailed:
        return out.unionByName(casts.select(*FILE, "change_kind", F.col("path").alias("field"), none.alias("old_field"), "old_no", "to_type", "notation"), allowMissingColumns=True)
    return out.unionByName(retyped.select(*cols("retyped", F.col("path"), none)))


def drift(*observed: DataFrame, detailed: bool = False) -> DataFrame:
    """:func:`changes` of one or more observations, each document read once."""
    every = observed[0]
    for x in observed[1:]:
        every = every.unionByName(x)
    observed = materialize(every, "drift-observed")
    out = changes(observed, detailed)
    discard(observed)  # all that is left to read are the differences
    return out


def versions(fields: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """``origin, spider_id, file_no, fingerprint, n_fields, version`` of the files of :func:`file_fields`.

    A file starts a new version of its spider's schema where its fields or their types differ from those of the file
    before. ``known`` are versions that an earlier run stored: their files stay as they are, and later files go on
    from them. Files of a spider come in the order of their number.
    """
    kind = F.concat_ws("\x1e", "path", "type")
    now = fields.groupBy(*FILE).agg(F.xxhash64(F.array_sort(F.collect_set(kind))).alias("fingerprint"), F.count("*").alias("n_fields"))
    if known is not None:
        now = now.join(known.select(*FILE), list(FILE), "left_anti").unionByName(known.select(*now.columns))
    w = Window.partitionBy("origin", "spider_id").orderBy("file_no")
    begins = F.when(F.lag("fingerprint").over(w) == F.col("fingerprint"), 0).otherwise(1)
    return now.withColumn("_begins", begins).withColumn("version", F.sum("_begins").over(w)).drop("_begins")


def migration_rules(found: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """Steps that bring a document of ``file_no`` to its spider's newest schema: ``origin, spider_id, file_no,
    steps`` in the order in which they apply, those of later files last. ``files`` (``origin, spider_id, file_no``)
    are the files to route; without them those that a change stands between. Casts need ``detailed`` changes."""
    if "to_type" not in found.columns:
        missing = F.when(F.col("change_kind") == "retyped", F.raise_error(F.lit("casts need drift(..., detailed=True)")).cast("string"))
        found = found.withColumns({"to_type": missing, "notation": F.lit(None).cast("struct<words:int,joiner:string,instant:string>")})
    rank = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("change_kind"))
    later = found.select("origin", "spider_id", F.struct(F.col("file_no").alias("at"), rank.alias("rank"), "change_kind", "field", "old_field", "to_type", "notation").alias("step"))
    # the steps of one spider are a handful of schema changes, not data
    chain = later.groupBy("origin", "spider_id").agg(F.array_sort(F.collect_list("step")).alias("chain"))
    if files is None:
        files = found.select("origin", "spider_id", F.explode(F.array("old_no", "file_no")).alias("file_no")).distinct()
    ahead = F.expr("filter(chain, s -> if(s.change_kind = 'cast', s.at = file_no, s.at > file_no))")
    return files.join(chain, ["origin", "spider_id"]).select("origin", "spider_id", "file_no", ahead.alias("steps"))


def cast(v: object, to: str, notation: dict | None = None) -> object:
    """A value as ``to``, one of :data:`TYPES`, written as ``notation`` says; ValueError where that cannot be done."""
    how = notation or {}
    kind = type_of(v)
    if kind == to:
        return v
    if to == "array":
        if kind == "string":
            if v.lstrip()[:1] == "[" and isinstance(found := read_payload(v), list):
                return found
            if (by := how.get("joiner")) and by != "[" and by in v:
                return [x.strip() for x in v.split(by)]
        return [v]
    if to == "string":
        if kind == "boolean":
            return WORDS[how.get("words") or 0][not v]
        if kind == "number":
            if how.get("instant") and abs(v) >= 1e8:
                text = datetime.fromtimestamp(v / 1000 if abs(v) >= 1e11 else v, timezone.utc).isoformat()
                return text.replace("+00:00", how["instant"])
            return json.dumps(v)
        by = how.get("joiner")
        if all(isinstance(x, str) for x in v) and by != "[" and (len(v) == 1 or by and not any(by in x for x in v)):
            return (by or "").join(v)
        return json.dumps(v, ensure_ascii=False)
    if kind == "array":
        if len(v) != 1 or v[0] is None or isinstance(v[0], dict | list):
            raise ValueError
        return cast(v[0], to, notation)
    if to == "boolean":
        word = v.strip().lower() if kind == "string" else str(int(v)) if v in (0, 1) else ""
        if word not in _TRUTH:
            raise ValueError
        return _TRUTH[word]
    if kind == "boolean":
        return int(v)
    text = v.strip()
    if re.fullmatch(r"[+-]?[0-9]+", text):
        return int(text)
    if re.fullmatch(r"[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?", text) and math.isfinite(x := float(text)):
        return x
    if not how.get("instant"):
        raise ValueError
    at = datetime.fromisoformat(text)
    x = (at if at.tzinfo else at.replace(tzinfo=timezone.utc)).timestamp() * (1000 if how["instant"] == "ms" else 1)
    return int(x) if x.is_integer() else x


def _text(v: object) -> str:
    """Text of a value; equal numbers have equal texts."""
    if isinstance(v, str):
        return v
    return json.dumps(int(v) if isinstance(v, float) and v.is_integer() and abs(v) < 1 << 53 else v, ensure_ascii=False)


def _migrate(values: dict, steps: list) -> tuple[dict, list]:
    """Values after the steps, and what was put aside as (file_no, field, reason, value)."""
    aside: list[tuple] = []
    for s in steps:
        kind, field = s["change_kind"], s["field"]
        if kind == "added":
            values.setdefault(field, None)
            continue
        old = s["old_field"] if kind == "renamed" else field
        v = values.pop(old, None)
        if v is None:  # absent, or a default
            if kind != "removed" and (kind == "renamed" or old in values):
                values.setdefault(field, None)
        elif kind == "removed":
            aside.append((s["at"], field, "removed", _text(v)))
        elif kind == "renamed":
            if values.get(field) is not None:
                aside.append((s["at"], field, "replaced", _text(values[field])))
            values[field] = v
        else:
            try:
                values[field] = cast(v, s["to_type"], s.get("notation"))
            except (ValueError, OverflowError, OSError):
                values[field] = None
                aside.append((s["at"], field, "uncast", _text(v)))
    return values, aside


_ASIDE_SPARK = T.ArrayType(T.StructType().add("file_no", "long").add("field", "string").add("reason", "string").add("value", "string"))
_ASIDE = pa.list_(pa.struct([("file_no", pa.int64()), ("field", pa.string()), ("reason", pa.string()), ("value", pa.string())]))


def unify(df: DataFrame, found: DataFrame, origin: str, spider_id: str, file_no: str, document: str, keep: tuple[str, ...] = ("id",)) -> DataFrame:
    """All documents in one table: ``keep`` columns, ``spider_id, file_no``, ``fields map<string,string>`` under the
    newest names and ``aside``, a list of (file_no, field, reason, value) of what a step removed or could not cast.

    Every document takes the steps of :func:`migration_rules` for its file; ``found`` are ``detailed`` changes where
    fields are retyped. Fields that are added later have the default null. Values are text: strings as they are,
    everything else as JSON. Rows that repeat are kept; unreadable documents have null ``fields``."""
    rows = df.select(*keep, F.col(spider_id).cast("string").alias("spider_id"), F.col(file_no).cast("bigint").alias("file_no"), F.col(document).alias("document"))
    files = rows.select(F.lit(origin).alias("origin"), "spider_id", "file_no").where("file_no is not null").distinct()
    rules = migration_rules(found.where(F.col("origin") == origin), files).where("size(steps) > 0").select("spider_id", "file_no", F.to_json("steps").alias("steps"))
    rows = rows.join(rules, ["spider_id", "file_no"], "left").select(*keep, "spider_id", "file_no", "document", "steps")
    out = T.StructType([f for f in rows.schema if f.name not in ("document", "steps")]).add("fields", T.MapType(T.StringType(), T.StringType())).add("aside", _ASIDE_SPARK)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chains: dict[str | None, list] = {None: []}
        for batch in batches:
            fields, aside = [], []
            for text, steps in zip(batch.column("document").to_pylist(), batch.column("steps").to_pylist()):
                d = read_payload(text)
                if not isinstance(d, dict):
                    fields.append(None)
                    aside.append(None)
                    continue
                if steps not in chains:
                    if len(chains) > HELD:
                        chains = {None: []}
                    chains[steps] = json.loads(steps)
                values, left = _migrate(dict(leaves(d)), chains[steps])
                fields.append([(k, None if v is None else _text(v)) for k, v in values.items()])
                aside.append([dict(zip(("file_no", "field", "reason", "value"), x)) for x in left])
            kept = [batch.column(n) for n in batch.schema.names if n not in ("document", "steps")]
            made = [pa.array(fields, pa.map_(pa.string(), pa.string())), pa.array(aside, _ASIDE)]
            yield pa.RecordBatch.from_arrays([*kept, *made], names=out.names)

    return rows.mapInArrow(run, out)


def field_column(name: str) -> Column:
    """A field of :func:`unify`'s table."""
    return F.col("fields").getItem(name)
