"""Replay of a change feed of inserts, updates and deletes into the present state of its targets.

Commit-ordered transactional replay:

1. *Assemble.* All deliveries of one ``event_id`` are one transaction. The first readable delivery (by
   ``feed_no``) stands for it, so a transaction is applied once however often it arrives.
2. *Order.* Transactions commit in the order of their instant, then ``event_id``; arrival order plays no part.
3. *Hold.* Transactions up to the contiguous watermark of ``feed_no`` are committed; what came after a gap is held until
   the gap is filled. An open feed exposes what is committed; closing the feed releases what is held, as the missing
   numbers will not come any more.
4. *Replay in parallel.* Targets do not conflict with each other. For one target the state follows from two
   values that combine in any order: its last insert or delete, and its last update with a status. Both are
   maxima over the commit order, so they are aggregated before the shuffle (a target that holds a third of all
   events sends one row per task) and later batches merge into a stored state in the same way.

Defined results: an event without readable instant, target type or target id is not applied; an event without
``event_id`` counts as a transaction of its own per distinct row; events of unknown type are updates; an empty
feed gives an empty state. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.functions.instants import parse_instant

INSERTS = ("created", "enqueued")
DELETES = ("deleted", "purged")
KEY = ("target_type", "target_id")


def _clean(status: Column) -> Column:
    return F.lower(F.regexp_replace(status, r"^\s+|\s+$", ""))


def assemble(feed: DataFrame) -> DataFrame:
    """One row per transaction: ``event_id, feed_no, instant, target_type, target_id, op, status``.

    ``feed_no`` is that of the delivery that stands for the transaction.
    """
    kind = _clean(F.col("event_type"))
    op = F.when(kind.isin(*INSERTS), F.lit("insert")).when(kind.isin(*DELETES), F.lit("delete")).otherwise(F.lit("update"))
    rows = feed.select(
        F.coalesce(F.col("event_id"), F.concat(F.lit("\x00"), F.col("feed_no").cast("string"))).alias("event_id"),
        F.col("feed_no").cast("bigint").alias("feed_no"),
        parse_instant(F.col("created_at")).alias("instant"),
        "target_type",
        "target_id",
        op.alias("op"),
        _clean(F.col("to_status")).alias("status"),
    )
    rows = rows.where(F.col("instant").isNotNull() & F.col("target_type").isNotNull() & F.col("target_id").isNotNull())
    first = F.min(F.struct("feed_no", "instant", "target_type", "target_id", "op", "status"))
    return rows.groupBy("event_id").agg(first.alias("d")).select("event_id", "d.*")


def contiguous_watermark(feed: DataFrame, start: int | None = None, block: int = 100_000) -> int | None:
    """The largest ``n`` such that every number from ``start`` to ``n`` has arrived; null for an empty feed.

    Numbers are counted in blocks, then one block (``block`` numbers at most) is looked at closely, so no
    task ever holds the whole feed.
    """
    numbers = feed.select(F.col("feed_no").cast("bigint").alias("n")).where("n is not null")
    if start is not None:
        numbers = numbers.where(F.col("n") >= start)
    blocked = numbers.groupBy(F.floor(F.col("n") / block).alias("b")).agg(F.count_distinct("n").alias("c"), F.min("n").alias("low"), F.max("n").alias("high"))
    low, high, found = blocked.agg(F.min("low"), F.max("high"), F.sum("c")).first()
    if low is None or start is not None and low > start:
        return None
    start = low
    if found == high - low + 1:
        return high  # no gap anywhere
    numbers = numbers.distinct()
    at = F.floor((F.col("n") - F.lit(start)) / block)
    blocks = numbers.groupBy(at.alias("b")).agg(F.count("*").alias("c"))
    # blocks are few: one row per `block` numbers; the first that is missing or not full ends the prefix
    full = blocks.where(F.col("c") == block).select("b")
    nxt = full.select((F.col("b") + 1).alias("b"))
    gap = nxt.join(full, "b", "left_anti").agg(F.min("b")).first()[0]
    has_zero = full.where("b = 0").limit(1).count() > 0
    edge = start + block * (int(gap) if has_zero else 0)
    inside = numbers.where((F.col("n") >= edge) & (F.col("n") < edge + block)).select("n", (F.col("n") + 1).alias("m"))
    ends = inside.select(F.col("m").alias("n")).join(inside.select("n"), "n", "left_anti").agg(F.min("n")).first()[0]
    if inside.where(F.col("n") == edge).limit(1).count() == 0:
        return edge - 1 if edge > start else None
    return int(ends) - 1


def fold(transactions: DataFrame, *apart: str) -> DataFrame:
    """Per target (and per value of the columns ``apart``) the two maxima that decide its state; :func:`merge` combines
    such rows."""
    order = ("instant", "event_id")
    structural = F.when(F.col("op") != "update", F.struct(*order, "op", "status"))
    update = F.when((F.col("op") == "update") & F.col("status").isNotNull(), F.struct(*order, "status"))
    return transactions.groupBy(*KEY, *apart).agg(F.max(structural).alias("base"), F.max(update).alias("last"))


def merge(*folds: DataFrame) -> DataFrame:
    """Combine folded states, such as a stored one and that of a new batch."""
    every = folds[0]
    for x in folds[1:]:
        every = every.unionByName(x)
    return every.groupBy(*KEY).agg(F.max("base").alias("base"), F.max("last").alias("last"))


def present(folded: DataFrame) -> DataFrame:
    """The living targets of a folded state: ``target_type, target_id, to_status``."""
    later = F.struct(F.col("last.instant"), F.col("last.event_id")) > F.struct(F.col("base.instant"), F.col("base.event_id"))
    return folded.where(F.col("base.op") == "insert").select(
        *KEY, F.when(F.col("last").isNotNull() & later, F.col("last.status")).otherwise(F.col("base.status")).alias("to_status")
    )


def replay(feed: DataFrame, closed: bool = True, start: int | None = None) -> DataFrame:
    """Present state of a feed: the committed transactions and, if it is closed, those that were held at a gap.

    Both are folded in one pass, each target's committed and held events apart, and then merged.
    """
    mark = contiguous_watermark(feed, start)
    held = ~F.coalesce(F.col("feed_no") <= F.lit(mark).cast("bigint"), F.lit(False))
    transactions = assemble(feed).withColumn("held", held)
    if not closed:
        return present(fold(transactions.where("not held")))
    return present(merge(fold(transactions, "held").drop("held")))
