"""Repeats of stored items in later batches, found without going through the whole history again.

Incremental record linkage. The state lies in a folder (:class:`Linker`) that outlives the session: a later one goes on
with :meth:`Linker.open`. A batch only adds to its tables; nothing that was accepted is parsed, normalised, linked or
written again:

* ``features``: record → *class*. Records of a source with the same words are one class from the start, so
  copies of a text, however many, cost one row each and nothing more.
* ``classes``: class → its words (hashed).
* ``keys``: blocking key → class with a 64-bit sketch, its number of words and a hash of its title. Keys are bands of
  min-hashes over the words of title and text (:data:`BANDS` bands of :data:`ROWS`).
* ``exact``: hash of the record and title → class.
* ``links``: every pair that was compared or linked by a key, with its share of common words and its weight.
* ``parents``: the representative of each class that is linked; the newest row of a class counts. A batch adds rows for
  new members, and for the members of a cluster that loses its representative to another one.

Sources (``spider_id``) are never compared with each other, so the tables are bucketed by *slot*, a hash of the source;
a source with more rows than a slot should hold is spread over several (:meth:`Linker._spread`). A batch reads the
buckets of its own sources only, and what is read is joined where it lies, without a shuffle of history.

:meth:`Linker.accept` normalises the rows of the batch, takes the classes that are new, probes ``keys`` and ``exact``
with them alone, and scores each candidate pair field by field with weights learned from the pairs compared so far
(:class:`Weights`; sketch, title, number of words). Pairs whose score is one that linked pairs hardly ever have
(:data:`MISSES`) are no links; the others are checked exactly (share of common words). Linked clusters are joined by
union-find over their representatives.

What counts as a repeat: the same hash (letter case aside), or title and long text with at least
:data:`SIMILARITY` of their words in common (Jaccard; characters in Chinese), or, where a text is missing, the
same title. Case, accents, markup, punctuation and spacing do not count. A record without text is linked to all
accepted ones of its title, whichever came first.

A pair with exactly the required similarity shares a band with probability 0.996, one with 0.83 with 0.999, one
with 0.87 or more with 0.9999; candidates and buckets have no cap. Buckets of more than :data:`CROWD` classes, as a
large group of slightly different copies makes in every band, are thinned out first: their members are compared
with pivots, and pairs of members only where the triangle inequality leaves a link possible
(:meth:`Linker._crowded`). What is left of a bucket, and every other one, is paired off by sketches alone, and
only pairs of similar sketches leave the join. Both ways give the same clusters.

Defined results: payloads that are null, broken or no objects are left out; records without title and text are
linked by hash only; a null source is left out; missing hashes match nothing; repeated rows count once; extra
columns are ignored; an empty batch changes nothing; a batch that died half way leaves nothing that counts.
"""

from __future__ import annotations

import html
import json
import re
import unicodedata
import uuid
from collections import Counter
from collections.abc import Iterator
from itertools import product
from math import log

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions.payloads import read_payload
from weftline.operators.components import components
from weftline.shared import discard, materialize, remove, scratch

SIMILARITY = 0.8
BANDS, ROWS = 18, 6
#: Differing sketch bits up to which a pair is a candidate; 0.8 gives 6 on average, 18 is five deviations off.
SKETCH_BITS = 18
#: Classes of a key beyond which groups of near copies are first thinned out, and rows of a file of the tables.
CROWD, ROWS_PER_FILE = 2000, 4_000_000
#: Slots of a bucket; the share of linked pairs that scoring may turn away; parts of a key whose pairs are many.
SLOTS, MISSES, SALTS = 16, 1e-4, 16

# Names of fields that hold a title or a long text, and of objects whose names are not titles.
TITLES = frozenset("title name subject headline product_name video_name item_name label heading caption".split())
TEXTS = frozenset("body description text message content summary truncateddescription abstract article details fulltext".split())
PEOPLE = frozenset("author user seller vendor channel account owner publisher creator privacy meta language category".split())

_TAG = re.compile(r"<[^<>]*>")
_MARKS = re.compile("[̀-ͯ᪰-᫿᷀-᷿⃐-⃿]")
_ASCII = re.compile(r"[a-z0-9]+")
_WORD = re.compile(r"[㐀-䶿一-鿿]|[^\W_㐀-䶿一-鿿]+")
_NO_TEXT = re.compile(r"^(?:[a-z][a-z0-9+.-]*://\S*|/\S*|[0-9TZ:.,+ /-]*|\S*)$", re.I)


def words(text: str) -> list[str]:
    """Words without case, accents, markup and punctuation; Chinese characters one by one."""
    if "<" in text:
        text = _TAG.sub(" ", text)
    if "&" in text:
        text = html.unescape(text)
        if "<" in text:
            text = _TAG.sub(" ", text)
    text = text.lower()
    if text.isascii():
        return _ASCII.findall(text)
    return _WORD.findall(_MARKS.sub("", unicodedata.normalize("NFKD", text.casefold())))


def title_and_text(document: dict) -> tuple[str | None, str | None]:
    """Title and long text of an item, under whatever names: by name first, then by what the values look like."""
    title = text = None
    rest: list[str] = []
    stack = [(document, "")]
    while stack:
        obj, parent = stack.pop()
        for key, v in obj.items():
            if isinstance(v, dict):
                stack.append((v, key.lower()))
                continue
            if isinstance(v, list) and v and all(isinstance(x, str) for x in v) and key.lower() in TEXTS:
                v = " ".join(v)
            if not isinstance(v, str) or len(v) < 2:
                continue
            low = key.lower()
            if low in TEXTS and (text is None or len(v) > len(text)):
                text = v
            elif low in TITLES and parent not in PEOPLE and (title is None or len(v) > len(title)):
                title = v
            elif len(v) >= 12 and not _NO_TEXT.match(v):
                rest.append(v)
    if text is None and rest:
        long = max(rest, key=len)
        if len(long) >= 120 or title is not None and len(long) > 1.5 * len(title):
            text = long
            rest.remove(long)
    if title is None and rest:
        best = max(rest, key=len)
        title = best if len(best.split()) >= 4 or not best.isascii() else None
    return title or None, text or None


_FEATURES = "id string, spider_id string, batch_no long, cls binary, hkey long, tkey long, has_text boolean, words array<int>"
_ARROW = pa.schema([("id", pa.string()), ("spider_id", pa.string()), ("batch_no", pa.int64()), ("cls", pa.binary()), ("hkey", pa.int64()), ("tkey", pa.int64()), ("has_text", pa.bool_()), ("words", pa.list_(pa.int32()))])


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def features(records: DataFrame) -> DataFrame:
    """Normalised rows of a batch: class (a hash of 128 bits), exact keys and the hashed words of title and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        h64, h32, h128 = xxhash.xxh3_64_intdigest, xxhash.xxh32_intdigest, xxhash.xxh3_128_digest
        for batch in batches:
            out: list[list] = [[] for _ in range(7)]
            values: list[np.ndarray] = []
            offsets = [0]
            for rid, spider, no, digest, payload in zip(*(c.to_pylist() for c in batch.columns)):
                document = read_payload(payload)
                if not isinstance(document, dict):
                    continue
                title, text = title_and_text(document)
                tw, xw = words(title) if title else [], words(text) if text else []
                found = set(tw)
                found.update(xw)
                ids = []
                for w in found:
                    i = known.get(w)
                    if i is None:
                        if len(known) > 1_000_000:
                            known.clear()
                        i = known[w] = h32(w.encode("utf-8", "surrogatepass"))
                    ids.append(i)
                seed = h64(spider.encode())
                arr = np.array(ids, np.uint32)
                arr.sort()
                kind = b"x" if xw else b"t" if tw else b"i" + rid.encode()
                cls = h128(kind + (arr.tobytes() if xw else " ".join(tw).encode("utf-8", "surrogatepass")), seed)
                digest = (digest or "").strip().lower()
                out[0].append(rid)
                out[1].append(spider)
                out[2].append(no)
                out[3].append(cls)
                out[4].append(_signed(h64(b"h" + digest.encode(), seed)) if digest else None)
                out[5].append(_signed(h64(b"t" + " ".join(tw).encode("utf-8", "surrogatepass"), seed)) if tw else None)
                out[6].append(bool(xw))
                if xw:
                    values.append(arr.view(np.int32))
                    offsets.append(offsets[-1] + len(arr))
                else:
                    offsets.append(offsets[-1])
            flat = np.concatenate(values) if values else np.zeros(0, np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(flat, pa.int32()))
            yield pa.RecordBatch.from_arrays([*[pa.array(c, f.type) for c, f in zip(out, _ARROW)], lists.cast(_ARROW.field("words").type)], schema=_ARROW)

    rows = records.where("id is not null and spider_id is not null and payload_json is not null")
    return rows.select("id", "spider_id", F.col("batch_no").cast("bigint"), "unique_hash", "payload_json").mapInArrow(run, _FEATURES)


_PRIME = np.uint64(0x9E3779B97F4A7C15)


def _min_hashes(flat: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """``n`` min-hashes of each list of words, one row per list."""
    rng = np.random.default_rng(20240229)
    a = rng.integers(1, 1 << 63, n, np.uint64) * np.uint64(2) + np.uint64(1)
    c = rng.integers(0, 1 << 63, n, np.uint64)
    x = flat.astype(np.uint64) * _PRIME
    out = np.empty((len(starts), n), np.uint32)
    for p in range(n):
        out[:, p] = np.minimum.reduceat(((x * a[p] + c[p]) >> np.uint64(32)).astype(np.uint32), starts)
    return out


def block_keys(classes: DataFrame) -> DataFrame:
    """``key, src, cls, sketch, n, title``: the bands of every class with text."""
    schema = "key long, src long, cls binary, sketch long, n int, title int"
    arrow = pa.schema([("key", pa.int64()), ("src", pa.int64()), ("cls", pa.binary()), ("sketch", pa.int64()), ("n", pa.int32()), ("title", pa.int32())])
    n = max(64, BANDS * ROWS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            if len(lists) == 0:
                continue
            sizes = np.diff(lists.offsets.to_numpy())
            starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
            flat = lists.flatten().to_numpy().view(np.uint32)
            mins = _min_hashes(flat, starts, n)
            seed = batch.column(0).to_numpy().view(np.uint64)
            bits = (mins[:, :64] & np.uint32(1)).astype(np.uint64)
            sketch = (bits << np.arange(64, dtype=np.uint64)).sum(1, dtype=np.uint64).view(np.int64)
            keys = np.empty((len(lists), BANDS), np.uint64)
            for b in range(BANDS):
                k = seed ^ np.uint64((b + 1) * int(_PRIME) % (1 << 64))
                for r in range(ROWS):
                    k = (k ^ mins[:, b * ROWS + r]) * _PRIME
                    k ^= k >> np.uint64(29)
                keys[:, b] = k
            every = pa.array(np.repeat(np.arange(len(lists)), BANDS))
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys.ravel().view(np.int64)), batch.column(0).take(every), batch.column(1).take(every), pa.array(np.repeat(sketch, BANDS)), pa.array(np.repeat(sizes.astype(np.int32), BANDS)), batch.column(2).take(every)], schema=arrow
            )

    return classes.where(F.size("words") > 0).select("src", "cls", "title", "words").mapInArrow(run, schema)


class Weights:
    """Log weights of agreement per field (Fellegi and Sunter), learned from the pairs compared so far: how often a
    level of a field occurs among those that proved linked and among the others, each level counted once more."""

    #: Fields of a comparison and the number of their levels; a higher level is more alike.
    FIELDS = {"c_sketch": 5, "c_title": 3, "c_size": 5}

    def __init__(self, counts: Counter | None = None) -> None:
        """``counts``: (levels of a pair, whether linked) → pairs."""
        self.counts = Counter(counts or {})

    def _shares(self, linked: bool) -> list[list[float]]:
        out = []
        for f, levels in enumerate(self.FIELDS.values()):
            n = [1.0] * levels
            for (pattern, is_link), pairs in self.counts.items():
                if is_link == linked:
                    n[pattern[f]] += pairs
            out.append([x / sum(n) for x in n])
        return out

    def tables(self) -> list[list[float]]:
        """The weight of each level of each field."""
        return [[log(a / b) for a, b in zip(m, u)] for m, u in zip(self._shares(True), self._shares(False))]

    def prior(self) -> float:
        """Log odds of a candidate before its fields are looked at."""
        linked = sum(n for (_, is_link), n in self.counts.items() if is_link)
        return log((linked + 1) / (sum(self.counts.values()) - linked + 1))

    def bar(self, misses: float = MISSES) -> float:
        """The score below which linked pairs have a probability of at most ``misses``.

        Fields depend on each other, so this probability comes from whole patterns: each is counted once more than it
        occurred among linked pairs, so that only many linked pairs can say that a pattern never occurs.
        """
        tables, patterns = self.tables(), list(product(*map(range, self.FIELDS.values())))
        linked = {p: 1 + self.counts.get((p, True), 0) for p in patterns}
        total, below = sum(linked.values()), 0
        scored = sorted((sum(t[v] for t, v in zip(tables, p)), linked[p]) for p in patterns)
        for score, n in scored:
            below += n
            if below > misses * total:
                break
        return score - 1e-9 + self.prior()

    def column(self) -> Column:
        """Log odds of a pair."""
        total = F.lit(self.prior())
        for name, t in zip(self.FIELDS, self.tables()):
            value = F.lit(t[0])
            for v, w in enumerate(t[1:], 1):
                value = F.when(F.col(name) == v, F.lit(w)).otherwise(value)
            total = total + value
        return total

    def dump(self) -> list:
        return sorted([list(p), linked, n] for (p, linked), n in self.counts.items())

    @staticmethod
    def load(rows: list) -> Weights:
        return Weights(Counter({(tuple(p), linked): n for p, linked, n in rows}))


_TABLES = {
    "classes": "slot int, src long, cls binary, title int, words array<int>, step int",
    "keys": "slot int, key long, src long, cls binary, sketch long, n int, title int, step int",
    "exact": "slot int, key long, src long, cls binary, titled boolean, bare boolean, step int",
    "parents": "slot int, src long, node binary, parent binary, step int",
    "apart": "slot int, key long, cls binary, pivot binary, d double, step int",
}
_LINKS = "src long, a binary, b binary, via string, share double, weight double, linked boolean, c_sketch int, c_title int, c_size int, step int"
_ONE_WAY = "spark.sql.requireAllClusterKeysForCoPartition"
_WRITERS = "spark.sql.maxConcurrentOutputFileWriters"


class Linker:
    """State of an incremental linkage in a folder that all executors share."""

    def __init__(self, spark: SparkSession, expected_rows: int = 1_000_000, home: str | None = None) -> None:
        """A new state. ``expected_rows`` sets the number of buckets, which stays as it is."""
        buckets = max(8, min(4096, -(-expected_rows * BANDS // ROWS_PER_FILE)))
        self._begin(spark, home or scratch(spark, "linkage"), {"buckets": buckets, "slot_rows": max(1000, expected_rows // (buckets * SLOTS)), "last": 0, "steps": [], "features": [], "spread": [], "weights": []})
        self._save()

    @classmethod
    def open(cls, spark: SparkSession, home: str) -> Linker:
        """Go on with the state that an earlier session left in ``home``."""
        path = f"{home}/state"
        files = [(int(f.getPath().getName().split(".")[0]), f.getPath().toString()) for f in _fs(spark, path).listStatus(_path(spark, path)) if f.getPath().getName().endswith(".json")]
        text = "".join(r.value for r in spark.read.text(max(files)[1]).collect())  # one small file
        self = cls.__new__(cls)
        self._begin(spark, home, json.loads(text))
        return self

    def _begin(self, spark: SparkSession, home: str, state: dict) -> None:
        self.spark, self.home, self.state, self.tag = spark, home.rstrip("/"), state, uuid.uuid4().hex[:10]
        self.step = state["last"]
        self.weights = Weights.load(state["weights"])
        for name, columns in _TABLES.items():
            spark.sql(f"create table {self._name(name)} ({columns}) using parquet clustered by (slot) into {state['buckets']} buckets location '{self.home}/{name}'")

    def _save(self) -> None:
        """Write the state beside the earlier ones; the newest counts, so a step is there as a whole or not at all."""
        self.state["weights"] = self.weights.dump()
        n = self.state["version"] = self.state.get("version", 0) + 1
        fs = _fs(self.spark, self.home)
        part, whole = (_path(self.spark, f"{self.home}/state/{n:09d}.{end}") for end in ("part", "json"))
        out = fs.create(part, True)
        out.write(bytearray(json.dumps(self.state).encode()))
        out.close()
        fs.rename(part, whole)

    # tables ------------------------------------------------------------------------------------------------
    def _name(self, name: str) -> str:
        return f"weftline_{name}_{self.tag}"

    def _append(self, df: DataFrame, name: str) -> None:
        """Add rows of this step to a table, one file a bucket."""
        columns = [c.split()[0] for c in _TABLES[name].split(", ")]
        before = self.spark.conf.get(_WRITERS, "0")
        self.spark.conf.set(_WRITERS, "1")  # a task has one bucket, so its rows need not be sorted by bucket
        try:
            df.withColumn("step", F.lit(self.step)).select(*columns).repartition(self.state["buckets"], "slot").write.insertInto(self._name(name))
        finally:
            self.spark.conf.set(_WRITERS, before)

    def _read(self, name: str) -> DataFrame:
        """Rows of steps that were finished, and of the present one; only slots of the present batch during one."""
        rows = self.spark.table(self._name(name))
        if dead := sorted(set(range(1, self.state["last"] + 1)) - {*self.state["steps"], self._working}):
            rows = rows.where(~F.col("step").isin(dead))
        return rows.where(F.col("slot").isin(self._touched)) if self._touched is not None else rows

    #: Slots of the sources of the batch in work; None for all.
    _touched: list[int] | None = None
    #: Number of the batch in work.
    _working: int | None = None

    def _ways(self) -> str:
        """Over how many slots the source of a row was spread, first to last, as SQL."""
        groups: dict[tuple, list[int]] = {}
        for src, ways in self.state["spread"]:  # sources with more rows than a slot should hold, at most one per slot filled
            groups.setdefault(tuple(ways), []).append(src)
        cases = " ".join(f"when src in ({', '.join(f'{x}L' for x in found)}) then array({', '.join(map(str, ways))})" for ways, found in groups.items())
        return f"case {cases} else array(1) end" if cases else "array(1)"

    def _slot(self, name: str, ways: str) -> str:
        """Slot of a row by its source and, where the source is spread, by column ``name``."""
        return f"cast(pmod(xxhash64(src, pmod(xxhash64({name}), {ways})), {self.state['buckets'] * SLOTS}) as int)"

    def _placed(self, df: DataFrame, name: str) -> DataFrame:
        """Rows with the slot in which they are written."""
        return df.withColumn("slot", F.expr(self._slot(name, f"element_at({self._ways()}, -1)")))

    def _sought(self, df: DataFrame, name: str) -> DataFrame:
        """Rows with every slot in which an earlier step may have written the like; mostly one."""
        if all(len(ways) == 1 for _, ways in self.state["spread"]):
            return self._placed(df, name)
        return df.withColumn("slot", F.expr(f"explode(array_distinct(transform({self._ways()}, w -> {self._slot(name, 'w')})))"))

    def _counted(self) -> DataFrame:
        """``src, n, step``: rows of each source in the finished steps and the present one."""
        return self.spark.read.schema("src long, n long, step int").parquet(f"{self.home}/sources").where(F.col("step").isin([*self.state["steps"], self.step]))

    def _spread(self, rows: DataFrame) -> None:
        """Count the sources of the batch, spread those that outgrew their slots, and note which slots the batch needs."""
        rows.groupBy("src").agg(F.count("*").alias("n")).write.parquet(f"{self.home}/sources/step={self.step}")
        counted = self._counted()
        known = {src: ways for src, ways in self.state["spread"]}
        slots = self.state["buckets"] * SLOTS
        # a source is listed here only once it fills more than a slot
        for r in counted.groupBy("src").agg(F.sum("n").alias("n"), F.max("step").alias("step")).where((F.col("n") > self.state["slot_rows"]) & (F.col("step") == self.step)).collect():
            ways = known.setdefault(r.src, [] if self.step == 1 else [1])
            need = 1 << min(slots.bit_length() - 1, (r.n // self.state["slot_rows"]).bit_length())
            if not ways or need > ways[-1]:
                ways.append(need)
        self.state["spread"] = sorted([src, ways] for src, ways in known.items())
        every = f"explode(flatten(transform({self._ways()}, w -> transform(sequence(0L, w - 1L), i -> cast(pmod(xxhash64(src, i), {slots}) as int))))) as slot"
        touched = sorted(r[0] for r in counted.where(F.col("step") == self.step).selectExpr(every).distinct().collect())  # at most all slots
        self._touched = touched if len(touched) <= slots // 2 else None

    def members(self) -> DataFrame:
        """``id, spider_id, batch_no, cls`` of all accepted records."""
        paths = [f"{self.home}/{p}" for p in self.state["features"]]
        rows = self.spark.read.schema(_FEATURES).parquet(*paths) if paths else self.spark.createDataFrame([], _FEATURES)
        return rows.select("id", "spider_id", "batch_no", "cls").distinct()

    def links(self) -> DataFrame:
        """``a, b, via, share, weight``: links between classes. ``via`` is ``hash``, ``title`` or ``words``; links by
        words have their share of common words and the log odds of their fields. Within a group of near copies these
        are stars: each member with the group's pivot."""
        path = f"{self.home}/links"
        if not self.state["steps"]:
            return self.spark.createDataFrame([], _LINKS).select("a", "b", "via", "share", "weight")
        rows = self.spark.read.schema(_LINKS).parquet(path).where(F.col("step").isin(self.state["steps"]) & F.col("linked"))
        return rows.select("a", "b", "via", "share", "weight")

    def close(self, delete: bool = False) -> None:
        """Forget the tables of this session. The files stay for :meth:`open` unless they are to be deleted."""
        for name in _TABLES:
            self.spark.sql(f"drop table if exists {self._name(name)}")
        if delete:
            remove(self.spark, self.home)

    # a batch -----------------------------------------------------------------------------------------------
    def accept(self, records: DataFrame) -> None:
        """Link the rows of a batch with each other and with everything accepted before."""
        folder = f"features/{uuid.uuid4().hex}"
        features(records).write.parquet(f"{self.home}/{folder}")
        self.accept_features(folder)

    def accept_features(self, folder: str) -> None:
        """:meth:`accept` of rows that :func:`features` normalised and wrote to ``folder`` below the home."""
        self.step = self._working = self.state["last"] = self.state["last"] + 1
        self._save()  # whatever a session that dies leaves of this step will not count
        rows = self.spark.read.schema(_FEATURES).parquet(f"{self.home}/{folder}").withColumn("src", F.xxhash64("spider_id"))
        before = self.spark.conf.get(_ONE_WAY, "true")
        self.spark.conf.set(_ONE_WAY, "false")  # tables bucketed by slot are joined by slot and key where they lie
        try:
            self._spread(rows)
            fresh = rows.groupBy("src", "cls").agg(F.first("words").alias("words"), F.max("tkey").alias("tkey")).withColumn("title", F.expr("cast(tkey & 2147483647 as int)"))
            if self.state["steps"]:
                # the classes of the batch alone are sought in the table
                names = self._sought(rows.select("src", "cls"), "cls").select("slot", "cls")
                known = self._read("classes").select("slot", "src", "cls").join(names.hint("shuffle_hash"), ["slot", "cls"], "left_semi")
                fresh = fresh.join(known.select("src", "cls").distinct(), ["src", "cls"], "left_anti")
            self._append(self._placed(fresh, "cls"), "classes")
            own = self._read("classes").where(F.col("step") == self.step)
            self._append(self._placed(block_keys(own), "key"), "keys")
            kinds = F.array(F.struct(F.col("hkey").alias("key"), F.lit(False).alias("titled")), F.struct(F.col("tkey").alias("key"), F.lit(True).alias("titled")))
            exact = rows.select("src", "cls", (~F.col("has_text")).alias("bare"), F.explode(kinds).alias("k")).select("src", "k.key", "k.titled", "cls", "bare").where("key is not null").distinct()
            self._append(self._placed(exact, "key"), "exact")
            path = f"{self.home}/links/step={self.step}"
            empty = [F.lit(None).cast(t).alias(n) for n, t in (("share", "double"), ("weight", "double"))]
            same = self._same_key().select("src", "a", "b", "via", *empty, F.lit(True).alias("linked"), *[F.lit(None).cast("int").alias(c) for c in Weights.FIELDS])
            same.unionByName(self._similar().withColumn("via", F.lit("words"))).write.parquet(path)
            links = self.spark.read.schema(_LINKS).parquet(path)
            # counts per pattern: at most 5 * 3 * 5, linked or not
            for r in links.where("c_size is not null").groupBy("linked", *Weights.FIELDS).count().collect():
                self.weights.counts[(tuple(r[f] for f in Weights.FIELDS), r.linked)] += r["count"]
            self._join(links.where("linked").select("src", "a", "b"))
            self.state["steps"].append(self.step)
            self.state["features"].append(folder)
            self._save()
        finally:
            self._touched = self._working = None
            self.spark.conf.set(_ONE_WAY, before)

    def _same_key(self) -> DataFrame:
        """``src, a, b, via``: links of this step by equal hash, each to the first class of its hash, and by equal
        title, each between a class and the one class of that title without text."""
        new = F.col("step") == self.step
        mine = self._read("exact").where(new)
        touched = self._sought(mine.select("src", "key"), "key").select("slot", "key").hint("shuffle_hash")
        every = self._read("exact").join(touched, ["slot", "key"], "left_semi") if self.state["steps"] else mine
        first = every.groupBy("key", "titled").agg(F.min(F.struct("step", "cls")).alias("first"), F.min(F.when(F.col("titled") & F.col("bare"), F.struct("step", "cls"))).alias("none"))
        rows = every.select("src", "key", "titled", "cls", "step").join(first, ["key", "titled"])
        to = F.when(F.col("titled"), F.when(new | (F.col("none.step") == self.step), F.col("none.cls"))).otherwise(F.when(new, F.col("first.cls")))
        return rows.select("src", F.col("cls").alias("a"), to.alias("b"), F.when(F.col("titled"), "title").otherwise("hash").alias("via")).where("b is not null and a <> b").distinct()

    def _similar(self) -> DataFrame:
        """Compared pairs of the classes of this step by their words."""
        keys = self._read("keys")
        probe = keys.where(F.col("step") == self.step)
        sought = self._sought(probe.drop("slot"), "key") if self.state["spread"] and self.state["steps"] else probe
        # a key of a source that was spread later has rows in several slots
        levels = max((len(ways) for _, ways in self.state["spread"]), default=1)
        # a key has no more classes than its source has rows
        large = self._counted().groupBy("src").agg(F.sum("n").alias("n")).where(F.col("n") > CROWD // levels).select("src")
        touched = sought.join(materialize(large, "large-sources"), "src", "left_semi")
        if self.state["steps"]:
            # not made distinct before: their shuffle would count as the wider one, and all of history would follow it
            touched = keys.join(touched.select("slot", "key").hint("shuffle_hash"), ["slot", "key"], "left_semi")
        # counted where the rows lie
        full = touched.groupBy("slot", "key").agg(F.count("*").alias("n"), F.max("src").alias("src")).where(F.col("n") > CROWD // levels)
        full = materialize(full.select("src", "key").distinct(), "crowded")
        if full.isEmpty():
            return self._compared(self._near(sought, keys))
        at = self._sought(full, "key").select("slot", "key")
        known, rest = self._crowded(materialize(keys.join(at, ["slot", "key"], "left_semi"), "crowd"))
        pairs = self._near(sought.join(full.select("key"), "key", "left_anti"), keys)
        apart = self._near(rest.where(F.col("step") == self.step), rest, SALTS)
        pairs = materialize(pairs.unionByName(apart).distinct().join(known.select("a", "b"), ["a", "b"], "left_anti"), "pairs")
        return self._compared(pairs).unionByName(known)

    def _near(self, probe: DataFrame, keys: DataFrame, salts: int = 0) -> DataFrame:
        """Pairs of a key with similar sketches and a score above the bar, one of them new. The probing side is this
        batch alone; history streams past it, bucket by bucket, without a shuffle. With ``salts`` the pairs of a key
        are formed in as many parts, for keys with many classes."""
        p = probe.select("slot", "key", "src", F.col("cls").alias("a"), F.col("sketch").alias("s"), F.col("n").alias("na"), F.col("title").alias("ta"))
        q = keys.select("slot", "key", F.col("cls").alias("b"), F.col("sketch").alias("t"), F.col("n").alias("nb"), F.col("title").alias("tb"), F.col("step").alias("since"))
        on = ["slot", "key"]
        if salts:
            p = p.drop("slot").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
            q = q.drop("slot").withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(salts)).cast("int"))
            on = ["key", "salt"]
        bits = F.bit_count(F.col("s").bitwiseXOR(F.col("t")))
        near = (bits <= SKETCH_BITS) & (F.col("a") != F.col("b")) & ((F.col("since") < self.step) | (F.col("a") < F.col("b")))
        return self._scored(q.join(p.hint("shuffle_hash"), on).where(near)).distinct()

    def _scored(self, pairs: DataFrame) -> DataFrame:
        """``src, a, b, weight`` and the levels of the fields, of pairs that may be linked: the numbers of words
        allow it, and the weight lies above the bar."""
        possible = pairs.where(F.least("na", "nb") / F.greatest("na", "nb") >= SIMILARITY)
        return self._levelled(possible).where(F.col("weight") >= self.weights.bar())

    def _levelled(self, pairs: DataFrame, *more: str) -> DataFrame:
        """:meth:`_scored` without turning any pair away."""
        bits = F.bit_count(F.col("s").bitwiseXOR(F.col("t")))
        ratio = F.least("na", "nb") / F.greatest("na", "nb")
        title = F.when(F.col("ta").isNull() | F.col("tb").isNull(), 1).when(F.col("ta") == F.col("tb"), 2).otherwise(0)
        sketch = F.greatest(F.lit(0), F.floor((SKETCH_BITS - bits) / 4)).cast("int")
        size = F.greatest(F.lit(0), F.least(F.lit(4), F.floor((ratio - SIMILARITY) * 4.999 / (1 - SIMILARITY)))).cast("int")
        levels = pairs.select("src", "a", "b", *more, sketch.alias("c_sketch"), title.alias("c_title"), size.alias("c_size"))
        return levels.withColumn("weight", self.weights.column())

    def _shares(self, pairs: DataFrame) -> DataFrame:
        """``pairs`` with ``share``, the share of common words of their classes ``a`` and ``b``."""
        c = self._read("classes")
        for end in ("a", "b"):
            side = c.select("slot", F.col("cls").alias(end), F.col("words").alias(f"w{end}"))
            pairs = self._sought(pairs, end).join(side, ["slot", end]).drop("slot")
        common = F.size(F.array_intersect("wa", "wb"))
        return pairs.withColumn("share", common / (F.size("wa") + F.size("wb") - common)).drop("wa", "wb")

    def _compared(self, pairs: DataFrame) -> DataFrame:
        """Scored pairs with their share of common words and whether they are linked."""
        return self._shares(pairs).withColumn("linked", F.col("share") >= SIMILARITY)

    def _crowded(self, crowd: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Compared pairs inside keys with too many classes to pair them off, and what is left of these keys.

        Each round takes the earliest class of a key as pivot and compares the others with it; what an earlier step
        compared is read (``apart``). 1 - Jaccard is a metric, so x and y can only be linked if their distances to a
        common pivot differ by at most 1 - :data:`SIMILARITY`. Members linked to the pivot leave the key; those left
        that come within twice the distance are compared with the leavers the pivot allows, where one of both is new.
        A key goes on while a round takes out a tenth of it; after that it holds no large group of near copies.
        """
        columns = ["src", "a", "b", "weight", *Weights.FIELDS, "share", "linked"]
        found: DataFrame | None = None
        rest = self.spark.createDataFrame([], crowd.schema)
        limit, new = 1 - SIMILARITY + 1e-9, F.col("step") == self.step
        side = lambda df, x: df.select("src", "key", "step", "d", F.col("cls").alias("a" if x == "s" else "b"), F.col("sketch").alias(x), F.col("n").alias("na" if x == "s" else "nb"), F.col("title").alias("ta" if x == "s" else "tb"))
        while not crowd.isEmpty():
            pivots = crowd.groupBy("key").agg(F.min(F.struct("step", "cls", "sketch", "n", "title")).alias("p"), F.count("*").alias("total"))
            others = crowd.join(pivots, "key").where("cls <> p.cls")
            others = others.withColumn("pivot", F.col("p.cls"))
            apart = self._read("apart").select("slot", "key", "cls", "pivot", "d")
            seen = others.join(apart, ["slot", "key", "cls", "pivot"], "left") if self.state["steps"] else others.withColumn("d", F.lit(None).cast("double"))
            fresh = self._shares(seen.where("d is null").select("src", F.col("cls").alias("a"), F.col("pivot").alias("b")).distinct()).select(F.col("a").alias("cls"), F.col("b").alias("pivot"), (1 - F.col("share")).alias("_d"))
            seen = seen.withColumn("known", F.col("d").isNotNull()).join(fresh, ["cls", "pivot"], "left")
            others = materialize(seen.withColumn("d", F.coalesce("d", "_d")).drop("_d"), "crowd-apart")
            self._append(others.where("not known").select("slot", "key", "cls", "pivot", "d"), "apart")
            near, far = others.where(F.col("d") <= limit), others.where(F.col("d") > limit)
            star = near.where(new).select("src", F.col("cls").alias("a"), F.col("p.cls").alias("b"), F.col("sketch").alias("s"), F.col("p.sketch").alias("t"), F.col("n").alias("na"), F.col("p.n").alias("nb"), F.col("title").alias("ta"), F.col("p.title").alias("tb"), (1 - F.col("d")).alias("share"))
            star = self._levelled(star, "share").withColumn("linked", F.lit(True))
            left_, right = side(near, "s").withColumn("salt", F.pmod(F.xxhash64("a"), F.lit(SALTS)).cast("int")), side(far.where(F.col("d") <= 2 * limit), "t").withColumnRenamed("d", "e").withColumnRenamed("step", "since").drop("src")
            right = right.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
            bridge = left_.join(right, ["key", "salt"]).where((F.abs(F.col("d") - F.col("e")) <= limit) & (new | (F.col("since") == self.step)))
            round_ = star.select(*columns).unionByName(self._compared(self._levelled(bridge).distinct()).select(*columns))
            found = materialize((found.unionByName(round_) if found is not None else round_).dropDuplicates(["a", "b"]), "crowd-found")
            left = far.groupBy("key").agg(F.count("*").alias("m"), F.first("total").alias("n")).where((F.col("m") > CROWD) & (F.col("m") < 0.9 * F.col("n"))).select("key")
            rest = materialize(rest.unionByName(far.join(left, "key", "left_anti").select(*rest.columns)), "crowd-rest")
            crowd = materialize(far.join(left, "key", "left_semi").select(*rest.columns), "crowd")
        return found, rest

    def _join(self, links: DataFrame) -> None:
        """Union-find: links become links of representatives, and joined clusters get one representative. Rows are
        written for new members and for the members of clusters that lose their own; of clusters that are joined, the
        smallest representative that had members stays."""
        known = self._read("parents").select("slot", "src", "node", "parent", "step")
        old = None
        if self.state["steps"]:
            ends = links.select("src", F.explode(F.array("a", "b")).alias("node")).distinct()
            old = materialize(self._sought(ends, "node").join(known.drop("src"), ["slot", "node"]).groupBy("node").agg(F.max_by("parent", "step").alias("root")), "roots")
            for end in ("a", "b"):
                links = links.join(old.select(F.col("node").alias(end), F.col("root").alias(f"r{end}")), end, "left").withColumn(end, F.coalesce(f"r{end}", end)).drop(f"r{end}")
        links = materialize(links.where("a <> b").distinct(), "root-links")
        source = links.select("src", F.explode(F.array("a", "b")).alias("node")).distinct()
        found = components(links.select("a", "b")).join(source, "node")
        if old is None:
            moved = found.select("src", "node", F.col("root").alias("parent"))
        else:
            found = found.join(old.select(F.col("root").alias("node"), F.lit(True).alias("had")).distinct(), "node", "left").withColumn("alone", F.col("had").isNull())
            best = found.groupBy("root").agg(F.min(F.struct("alone", "node"))["node"].alias("parent"))
            found = materialize(found.join(best, "root").select("src", "node", "parent", "alone"), "moved")
            lost = found.where("not alone and node <> parent").select(F.col("node").alias("root"), F.col("parent").alias("to"))
            latest = known.groupBy("slot", "src", "node").agg(F.max_by("parent", "step").alias("root"))
            members = latest.join(lost, "root").select("src", "node", F.col("to").alias("parent"))
            moved = found.where("alone or node <> parent").select("src", "node", "parent").unionByName(members).distinct()
        self._append(self._placed(moved, "node"), "parents")

    # results -----------------------------------------------------------------------------------------------
    def representatives(self) -> DataFrame:
        """``cls, root`` of all classes in clusters of several."""
        return self._read("parents").groupBy(F.col("node").alias("cls")).agg(F.max_by("parent", "step").alias("root"))

    def clusters(self) -> DataFrame:
        """``id, spider_id, batch_no, cluster`` of all accepted records."""
        return self.members().join(self.representatives(), "cls", "left").select("id", "spider_id", "batch_no", F.coalesce("root", "cls").alias("cluster"))

    def repeats(self) -> DataFrame:
        """``id_a, id_b``: every record that repeats an earlier one, with the earliest of its item. Ids grow in
        the order of acceptance within a source."""
        c = self.clusters()
        first = c.groupBy("cluster").agg(F.min("id").alias("id_a"), F.count("*").alias("n")).where("n > 1").select("cluster", "id_a")
        return c.join(first, "cluster").where(F.col("id") != F.col("id_a")).select("id_a", F.col("id").alias("id_b")).distinct()


def _path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _fs(spark: SparkSession, path: str):
    return _path(spark, path).getFileSystem(spark._jsc.hadoopConfiguration())


def link_batches(records: DataFrame) -> DataFrame:
    """``id_a, id_b`` of a table of batches: history (batch 0) first, then every further batch in the order of its
    number. The table is read and normalised once; every batch is then accepted on its own."""
    spark = records.sparkSession
    linker = Linker(spark, records.count())
    try:
        features(records.where("batch_no is not null")).withColumn("batch", F.col("batch_no")).write.partitionBy("batch").parquet(f"{linker.home}/features")
        # the numbers of the batches, one each
        for n in sorted(r[0] for r in spark.read.schema(_FEATURES + ", batch long").parquet(f"{linker.home}/features").select("batch").distinct().collect()):
            linker.accept_features(f"features/batch={n}")
        return materialize(linker.repeats(), "repeats")
    finally:
        linker.close(delete=True)
