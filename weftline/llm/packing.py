"""Texts in containers of fixed capacity with little unused room.

Bound-certified repacking: items (whole texts, or pieces of a text that is longer than a container) are dealt
into partitions, and each partition packs its own by best-fit decreasing. Dual feasible functions give a lower bound
of the number of containers, of every partition and, from the counts of all sizes, of the whole corpus
(:func:`lower_bound`). A capacity whose containers are as many as its bound is certified and left alone. Otherwise
partitions with more containers than their own bound (all, where there is none) give the items of their badly filled
containers away: some such partitions at a time form a group, whose items are packed again by best-fit decreasing, and
each group for itself keeps the new filling if it takes fewer containers. This goes on until the bound is reached
or no group gains anything. :func:`report` gives containers, bound and unused room. Only sizes and ids are shuffled,
never texts, and a partition holds :data:`ITEMS` items on average however large the corpus is.

Defined results: a text longer than the capacity is cut into pieces of exactly the capacity and a rest; null
and empty texts are items of size 0, which take no room and lie in some container; every text is assigned once
per capacity; a capacity below 1 is an error. Ties are broken by size, id and piece, so results are repeatable.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.shared import discard, materialize

#: Items of a partition on average, and partitions that exchange items with each other.
ITEMS, GROUP = 20_000, 8
#: Containers with more unused room than this share give their items away in an exchange.
SLACK = 0.02


def lower_bound(sizes: np.ndarray, capacity: int, counts: np.ndarray | None = None) -> int:
    """The largest bound on the number of containers from three families of dual feasible functions, of items or of
    the counts of different sizes."""
    keep = sizes > 0
    if counts is None:
        values, counts = np.unique(sizes[keep].astype(np.int64), return_counts=True)
    else:
        order = np.argsort(sizes[keep])
        values, counts = sizes[keep].astype(np.int64)[order], counts[keep].astype(np.int64)[order]
    if not len(values):
        return 0
    best = -(-int((values * counts).sum()) // capacity)
    # items above capacity - e count as a whole container, those below e as nothing; every different e is tried
    number, room = np.concatenate([[0], np.cumsum(counts)]), np.concatenate([[0], np.cumsum(values * counts)])
    e = np.concatenate([[1], values[values * 2 <= capacity]])
    high, low = np.searchsorted(values, capacity - e, "right"), np.searchsorted(values, e, "left")
    f = (number[-1] - number[high]) * capacity + np.maximum(0, room[high] - room[low])
    best = max(best, -(-int(f.max()) // capacity))
    for k in range(1, 21):  # in units of 1 / (k * capacity)
        y = (k + 1) * values
        f = np.where(y % capacity == 0, values * k, (y // capacity) * capacity)
        best = max(best, -(-int((f * counts).sum()) // (k * capacity)))
    return best


def best_fit(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Container number of each item; the items come in decreasing order of size."""
    out = np.empty(len(sizes), np.int64)
    rooms: list[int] = []  # different amounts of free room, ascending
    with_room: dict[int, list[int]] = {}
    n = 0
    for i, size in enumerate(sizes.tolist()):
        k = bisect_left(rooms, size)
        if k < len(rooms):
            room = rooms[k]
            bins = with_room[room]
            b = bins.pop()
            if not bins:
                del with_room[room]
                rooms.pop(k)
        else:
            b, room = n, capacity
            n += 1
        out[i] = b
        left = room - size
        if (bins := with_room.get(left)) is None:
            with_room[left] = [b]
            insort(rooms, left)
        else:
            bins.append(b)
    return out


def pieces(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """``pack_id, capacity, doc_id, piece_no, start_token, size``: every text for every capacity."""
    t = targets.where("pack_id is not null and capacity_tokens is not null").select("pack_id", F.col("capacity_tokens").cast("bigint").alias("capacity")).distinct()
    bad = t.where("capacity < 1").limit(1).count()
    if bad:
        raise ValueError("a container must hold at least one token")
    n = F.greatest(F.lit(1), F.ceil(F.col("n_tokens") / F.col("capacity")))
    # the list of capacities is a parameter table of a few rows; each text is repeated once per capacity
    caps = [r.asDict() for r in t.limit(1001).collect()]
    if len(caps) > 1000:
        raise ValueError("more than 1000 capacities")
    every = F.array(*[F.struct(F.lit(c["pack_id"]).alias("pack_id"), F.lit(c["capacity"]).cast("bigint").alias("capacity")) for c in caps])
    if not caps:
        every = F.expr("cast(array() as array<struct<pack_id:int,capacity:bigint>>)")
    rows = sizes.select("doc_id", F.coalesce("n_tokens", F.lit(0)).cast("bigint").alias("n_tokens"), F.explode(every).alias("c")).select("doc_id", "n_tokens", "c.*")
    rows = rows.withColumn("piece_no", F.explode(F.sequence(F.lit(0).cast("bigint"), n.cast("bigint") - 1)))
    start = F.col("piece_no") * F.col("capacity")
    return rows.select("pack_id", "capacity", "doc_id", "piece_no", start.alias("start_token"), F.least(F.col("capacity"), F.col("n_tokens") - start).alias("size"))


_PACKED = "pack_id int, capacity long, part long, bin long, bins long, bound long, fill long, doc_id long, piece_no long, start_token long, size long"
_PACKED_ARROW = pa.schema([(x.split()[0], pa.int32() if x.endswith(" int") else pa.int64()) for x in _PACKED.split(", ")])


def _pack(items: DataFrame) -> DataFrame:
    """Best-fit decreasing in each (pack_id, part)."""

    def run(table: pa.Table) -> pa.Table:
        x = {n: table.column(n).to_numpy() for n in ("doc_id", "piece_no", "size", "start_token")}
        order = np.lexsort((x["piece_no"], x["doc_id"], -x["size"]))
        x = {k: v[order] for k, v in x.items()}
        capacity = int(table.column("capacity")[0].as_py())
        bins = best_fit(x["size"], capacity)
        n = int(bins.max()) + 1
        fill = np.bincount(bins, x["size"], n).astype(np.int64)[bins]
        same = {"pack_id": table.column("pack_id")[0].as_py(), "capacity": capacity, "part": table.column("part")[0].as_py(), "bins": n, "bound": lower_bound(x["size"], capacity)}
        cols = {**{k: np.full(len(bins), v) for k, v in same.items()}, "bin": bins, "fill": fill, **x}
        return pa.table([pa.array(cols[f.name], f.type) for f in _PACKED_ARROW], schema=_PACKED_ARROW)

    return items.groupBy("pack_id", "part").applyInArrow(run, _PACKED)


def _dealt(items: DataFrame, counts: dict[int, int], salt: int) -> DataFrame:
    """Items with ``part``: of every capacity as many partitions as its items need. Pieces that fill a
    container are packed where they are."""
    parts = F.lit(1)
    for pack_id, n in counts.items():
        parts = F.when(F.col("pack_id") == pack_id, F.lit(max(1, -(-n // ITEMS)))).otherwise(parts)
    return items.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece_no", F.lit(salt)), parts).cast("bigint") + F.lit(salt * 10**9))


def bounds(items: DataFrame) -> DataFrame:
    """``pack_id, capacity, bound``: the least number of containers that all items need, by :func:`lower_bound` over
    the counts of their sizes (at most ``capacity`` rows each)."""

    def run(table: pa.Table) -> pa.Table:
        capacity = table.column("capacity")[0].as_py()
        bound = lower_bound(table.column("size").to_numpy(), capacity, table.column("n").to_numpy())
        return pa.table({"pack_id": pa.array([table.column("pack_id")[0].as_py()], pa.int32()), "capacity": pa.array([capacity], pa.int64()), "bound": pa.array([bound], pa.int64())})

    counted = items.groupBy("pack_id", "capacity", "size").agg(F.count("*").alias("n"))
    return counted.groupBy("pack_id").applyInArrow(run, "pack_id int, capacity long, bound long")


def pack(sizes: DataFrame, targets: DataFrame, log: list[dict] | None = None) -> DataFrame:
    """``pack_id, container_id, doc_id, piece_no, start_token, n_tokens``; ``container_id`` is unique per pack. ``log``
    takes a row per round: capacities not certified, groups that exchanged, groups that gained."""
    items = materialize(pieces(sizes, targets), "pack-items")
    # one number per capacity each
    counts = {r.pack_id: r.n for r in items.groupBy("pack_id").agg(F.count("*").alias("n")).collect()}
    least = {r.pack_id: r.bound for r in bounds(items).collect()}
    state = materialize(_pack(_dealt(items, counts, 0)), "packed")
    salt = 0
    while True:
        salt += 1
        parts = state.groupBy("pack_id", "part").agg(F.count_distinct("bin").alias("now"), F.max(F.col("bins") > F.col("bound")).alias("gap"), F.max(_loose()).alias("gives"))
        totals = parts.groupBy("pack_id").agg(F.sum("now").alias("n"), F.count_if(F.col("gap") & F.col("gives")).alias("gaps"), F.count_if("gives").alias("givers")).collect()
        open_ = [r for r in totals if r.n > least[r.pack_id] and r.givers > 1]
        if not open_:
            break
        # two partitions at least exchange; where only certified ones are left, what they leave unused together may hold a container
        strict = [r.pack_id for r in open_ if r.gaps > 1]
        chosen = F.col("gives") & F.col("pack_id").isin([r.pack_id for r in open_]) & (F.col("gap") | ~F.col("pack_id").isin(strict))
        groups = F.lit(1)
        for r in open_:
            groups = F.when(F.col("pack_id") == r.pack_id, F.lit(-(-(r.gaps if r.pack_id in strict else r.givers) // GROUP))).otherwise(groups)
        group = (F.pmod(F.xxhash64("part", F.lit(salt)), groups) + F.lit(salt * 10**9)).cast("bigint")
        givers = parts.where(chosen).select("pack_id", "part", group.alias("to"))
        pool = materialize(state.where(_loose()).join(givers, ["pack_id", "part"]), "pack-pool")
        again = materialize(_pack(pool.withColumnsRenamed({"part": "from", "to": "part"}).select(*items.columns, "part")), "packed-again")
        before = pool.groupBy("pack_id", "to").agg(F.count_distinct("part", "bin").alias("before"))
        after = again.groupBy("pack_id", F.col("part").alias("to")).agg(F.max("bins").alias("after"))
        tried = materialize(before.join(after, ["pack_id", "to"]), "pack-tried")
        gained = tried.where("after < before").select("pack_id", "to")
        n_tried, n_gained = tried.agg(F.count("*"), F.count_if(F.col("after") < F.col("before"))).first()
        if log is not None:
            log.append({"open": sorted(r.pack_id for r in open_), "groups": n_tried, "gained": n_gained})
        if not n_gained:
            break
        moved = givers.join(gained, ["pack_id", "to"], "left_semi").select("pack_id", "part", F.lit(True).alias("_moved"))
        kept = state.join(moved, ["pack_id", "part"], "left").where(~_loose() | F.col("_moved").isNull()).drop("_moved")
        taken = again.join(gained.withColumnRenamed("to", "part"), ["pack_id", "part"], "left_semi")
        old, state = state, materialize(kept.unionByName(taken.select(*kept.columns)), "packed")
        discard(old, again, pool, tried)
    return state.select("pack_id", (F.col("part") * 10**7 + F.col("bin")).alias("container_id"), "doc_id", "piece_no", "start_token", F.col("size").alias("n_tokens"))


def _loose() -> Column:
    """Whether an item lies in a badly filled container."""
    return (F.col("capacity") - F.col("fill")) > SLACK * F.col("capacity")


def report(packed: DataFrame, targets: DataFrame) -> DataFrame:
    """Per capacity: containers, the least number that any filling needs, whether both are equal (which proves the
    filling the best one), and the share of unused room."""
    used = packed.groupBy("pack_id").agg(F.count_distinct("container_id").alias("containers"), F.sum("n_tokens").alias("tokens"))
    t = targets.select("pack_id", F.col("capacity_tokens").cast("bigint").alias("capacity")).distinct()
    items = packed.join(t, "pack_id").select("pack_id", "capacity", F.col("n_tokens").alias("size"))
    out = used.join(bounds(items), "pack_id")
    return out.select("pack_id", "capacity", "containers", "bound", (F.col("containers") == F.col("bound")).alias("certified"), (1 - F.col("tokens") / (F.col("containers") * F.col("capacity"))).alias("unused"))
