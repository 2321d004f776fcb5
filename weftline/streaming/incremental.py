"""Streams of records into state, and time windows over metrics.

Each micro-batch is a run with its batch number: results, new hashes and the mark are staged under it and become
visible by one commit, so a batch that is played again after a failure replaces itself.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators import changefeed, incremental
from weftline.shared import materialize
from weftline.sinks.state import State


def dedup_batches(spark: SparkSession, home: str, key: list[str], order: list[str], value: Column | None = None, strategy: str = "max", value_type: str = "string") -> Callable[[DataFrame, int], None]:
    """A function for ``foreachBatch`` that keeps the first row of every key and what lies beyond the mark."""
    state = State(spark, home)

    def batch(df: DataFrame, number: int) -> None:
        if number in state.commits():
            return
        schema = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in key)
        index = state.read("hashes", schema).drop("run")
        bound = None
        if value is not None:
            marks = state.read("marks", f"value {value_type}").agg((F.max if strategy == "max" else F.min)("value")).first()
            bound = marks[0]
        rows = df.where(incremental.newer(value, bound, strategy)) if value is not None else df
        kept = materialize(incremental.new_rows(rows, key, order, index), "batch")
        state.stage(number, "results", kept)
        state.stage(number, "hashes", kept.select(*key))
        if value is not None:
            state.stage(number, "marks", kept.agg((F.max if strategy == "max" else F.min)(value).cast(value_type).alias("value")))
        state.commit(number)

    return batch


FOLDED = "target_type string, target_id string, base struct<instant:timestamp,event_id:string,op:string,status:string>, last struct<instant:timestamp,event_id:string,status:string>"


_TRANSACTIONS = "event_id string, feed_no long, instant timestamp, target_type string, target_id string, op string, status string"


def _last(frame: DataFrame, run: int | None) -> DataFrame:
    return frame.where(F.col("run") == F.lit(run)).drop("run")


def changefeed_batches(spark: SparkSession, home: str, start: int | None = None) -> Callable[[DataFrame, int], None]:
    """A function for ``foreachBatch`` that replays a change feed: transactions up to the contiguous watermark of all
    batches are folded into a stored state, later ones are held until the numbers before them have come.

    An ``event_id`` that an earlier batch brought is a repeated delivery, whatever it says. ``start`` is the first
    number of the feed; without it that is the smallest number of the first batch.
    """
    state = State(spark, home)

    def batch(df: DataFrame, number: int) -> None:
        done = state.commits()
        if number in done:
            return
        last = max(done, default=None)
        mark = state.read("marks", "value long").agg(F.max("value")).first()[0]
        arrived = df.select(F.col("feed_no").cast("bigint").alias("feed_no"))
        waiting = materialize(arrived.unionByName(_last(state.read("waiting", "feed_no long"), last)), "waiting")
        begin = mark + 1 if mark is not None else start
        reached = changefeed.contiguous_watermark(waiting, begin)
        mark = reached if reached is not None else mark
        fresh = changefeed.assemble(df).join(state.read("ids", "event_id string").select("event_id"), "event_id", "left_anti")
        fresh = materialize(fresh, "fresh")
        pending = fresh.unionByName(_last(state.read("held", _TRANSACTIONS), last))
        committed = F.coalesce(F.col("feed_no") <= F.lit(mark).cast("bigint"), F.lit(False))
        state.stage(number, "folds", changefeed.fold(pending.where(committed)))
        state.stage(number, "held", pending.where(~committed))
        state.stage(number, "ids", fresh.select("event_id"))
        state.stage(number, "waiting", waiting.where(~committed))
        state.stage(number, "marks", spark.range(1).select(F.lit(mark).cast("bigint").alias("value")))
        state.commit(number)

    return batch


def changefeed_state(spark: SparkSession, home: str, closed: bool = False) -> DataFrame:
    """The present targets of what :func:`changefeed_batches` committed; ``closed`` adds what is still held."""
    state = State(spark, home)
    folds = state.read("folds", FOLDED).drop("run")
    if closed:
        folds = folds.unionByName(changefeed.fold(_last(state.read("held", _TRANSACTIONS), max(state.commits(), default=None))))
    return changefeed.present(changefeed.merge(folds))


def windows(events: DataFrame, at: str, width: str, keys: list[str], value: str, late: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """Counts and sums per time window; a stream drops events later than ``late``."""
    rows = events.withColumn("_at", F.col(at).cast("timestamp")).withWatermark("_at", late)
    return rows.groupBy(F.window("_at", width, slide) if slide else F.window("_at", width), *keys).agg(F.count("*").alias("n"), F.sum(F.col(value).cast("decimal(28,6)")).cast("double").alias("total")).select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *keys, "n", "total")


def first_within(events: DataFrame, at: str, keys: list[str], late: str = "10 minutes") -> DataFrame:
    """Repeated deliveries of a stream dropped within the time they may be late."""
    return events.withColumn("_at", F.col(at).cast("timestamp")).withWatermark("_at", late).dropDuplicatesWithinWatermark(keys).drop("_at")
