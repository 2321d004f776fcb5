"""Calculus of polite fetching: waiting times, rotation, back-off, concurrency, attempts.

What runs along the rows of a key (waiting times, the value before, failures in a row, requests under way) does not put a
key into one task: rows are cut into ranges of key and order (:func:`_ranges`), every range is worked on for itself, and
what a range must know of those before it is carried over from one row per key and range (:func:`_carried`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def _ranges(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Rows with ``_part``, the number of their range of key and order; a key with many rows spans several."""
    return df.repartitionByRange(*[F.col(c) for c in (*key, *order)]).withColumn("_part", F.spark_partition_id())


def _carried(rows: DataFrame, parts: DataFrame, key: list[str]) -> DataFrame:
    """``rows`` with the further columns of ``parts`` (one row per key and range)."""
    at = parts.withColumnsRenamed({c: f"_at_{n}" for n, c in enumerate(("_part", *key))})
    same = F.lit(True)
    for n, c in enumerate(("_part", *key)):
        same = same & F.col(c).eqNullSafe(F.col(f"_at_{n}"))
    return rows.join(at, same, "left").drop(*[f"_at_{n}" for n in range(len(key) + 1)])


def _parts_before(key: list[str]) -> WindowSpec:
    """The ranges of a key before one: as many as there are tasks at most."""
    return Window.partitionBy(*key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)


def rate_limit(df: DataFrame, key: list[str], at: str, interval_us: int, order: str) -> DataFrame:
    """``wait_us`` before each request so that requests of a key start ``interval_us`` apart.

    A request starts at max(arrival, start before + interval). Unrolled, that is a running maximum, so no state
    is carried from row to row: wait = max over j ≤ i of (t_j − j·I) + i·I − t_i.
    """
    w = Window.partitionBy("_part", *key).orderBy(at, order)
    rows = _ranges(df.withColumn("_t", F.unix_micros(F.col(at).cast("timestamp"))), key, [at, order])
    rows = rows.withColumn("_i", (F.row_number().over(w) - 1).cast("bigint")).withColumn("_lead", F.col("_t") - F.col("_i") * interval_us)
    parts = rows.groupBy("_part", *key).agg(F.count("*").alias("_n"), F.max("_lead").alias("_most"))
    parts = parts.withColumn("_before", F.coalesce(F.sum("_n").over(_parts_before(key)), F.lit(0)))
    parts = parts.withColumn("_carry", F.max(F.col("_most") - F.col("_before") * interval_us).over(_parts_before(key))).drop("_n", "_most")
    here = F.max("_lead").over(w.rowsBetween(Window.unboundedPreceding, 0))
    out = _carried(rows.withColumn("_here", here), parts, key)
    lead = F.greatest(F.col("_here") - F.col("_before") * interval_us, F.col("_carry"))
    wait = lead + (F.col("_i") + F.col("_before")) * interval_us - F.col("_t")
    return out.withColumn("wait_us", F.greatest(F.lit(0).cast("bigint"), wait)).drop("_t", "_i", "_lead", "_part", "_before", "_carry", "_here")


def rotate(df: DataFrame, pool: list[str], order: list[str], name: str, key: list[str] = ()) -> DataFrame:
    """The pool's entries in turn."""
    if not key:
        from weftline.operators.policy import ranked

        return ranked(df, order, "_n", 0).withColumn(name, F.element_at(F.array(*map(F.lit, pool)), (F.col("_n") % len(pool) + 1).cast("int"))).drop("_n")
    n = F.row_number().over(Window.partitionBy(*key).orderBy(*order)) - 1
    return df.withColumn(name, F.element_at(F.array(*map(F.lit, pool)), (n % len(pool) + 1).cast("int")))


def previous(df: DataFrame, key: list[str], order: list[str], value: Column, name: str) -> DataFrame:
    """The last non-null value of the rows before, such as the address fetched last."""
    rows = _ranges(df.withColumn("_v", value), key, order)
    w = Window.partitionBy("_part", *key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.groupBy("_part", *key).agg(F.max_by("_v", F.when(F.col("_v").isNotNull(), F.struct(*order))).alias("_last"))
    parts = parts.withColumn("_carry", F.last("_last", ignorenulls=True).over(_parts_before(key))).drop("_last")
    out = _carried(rows.withColumn("_here", F.last("_v", ignorenulls=True).over(w)), parts, key)
    return out.withColumn(name, F.coalesce("_here", "_carry")).drop("_v", "_part", "_here", "_carry")


def concurrency_peak(df: DataFrame, key: list[str], start: Column, end: Column, tie: str) -> DataFrame:
    """Most requests of a key under way at once; one that ends frees its place for one that starts then."""
    ends = df.select(*key, F.col(tie).alias("_tie"), F.explode(F.array(F.struct(start.alias("t"), F.lit(1).alias("d")), F.struct(end.alias("t"), F.lit(-1).alias("d")))).alias("e"))
    rows = _ranges(ends.select(*key, F.col("e.t").alias("_t"), F.col("e.d").alias("_d"), "_tie"), key, ["_t", "_d", "_tie"])
    w = Window.partitionBy("_part", *key).orderBy("_t", "_d", "_tie").rowsBetween(Window.unboundedPreceding, 0)
    parts = rows.withColumn("_now", F.sum("_d").over(w)).groupBy("_part", *key).agg(F.max("_now").alias("_most"), F.sum("_d").alias("_net"))
    before = F.coalesce(F.sum("_net").over(_parts_before(key)), F.lit(0))
    return parts.withColumn("_peak", F.col("_most") + before).groupBy(*key).agg(F.max("_peak").cast("bigint").alias("peak"))


def backoff(attempt: Column, base: float, cap: float, kind: str = "exponential") -> Column:
    """Seconds before the next attempt: none, fixed, or doubled each time up to ``cap``."""
    if kind == "none":
        return F.lit(0.0)
    return F.least(F.lit(float(base)) * (F.pow(F.lit(2.0), attempt - 1) if kind == "exponential" else F.lit(1.0)), F.lit(float(cap)))


def succeeded(status: Column) -> Column:
    return status.between(200, 299)


def retryable(error: Column, status: Column, errors: list[str], codes: list[int]) -> Column:
    """Whether a failure may be tried again: its type is listed, and for HTTP errors its code too."""
    return F.coalesce(error.isin(errors) & ((error != "http_status") | status.isin(codes)), F.lit(False))


def outcomes(attempts: DataFrame, request: list[str], order: list[str], ok: Column) -> DataFrame:
    """Per request the number of attempts up to the first success (or all) and whether it succeeded."""
    w = Window.partitionBy(*request).orderBy(*order)
    rows = attempts.withColumn("_n", F.row_number().over(w)).withColumn("_ok", ok)
    first = F.min(F.when(F.col("_ok"), F.col("_n")))
    return rows.groupBy(*request).agg(F.coalesce(first, F.max("_n")).cast("bigint").alias("attempts"), F.max("_ok").alias("succeeded"))


def failure_runs(df: DataFrame, key: list[str], order: list[str], ok: Column, threshold: int) -> DataFrame:
    """Failures in a row up to each attempt, and whether they start a cooldown (a success resets them)."""
    rows = _ranges(df.withColumn("_ok", ok.cast("int")), key, order)
    w = Window.partitionBy("_part", *key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_run", F.coalesce(F.sum("_ok").over(w), F.lit(0)))
    in_run = Window.partitionBy("_part", *key, "_run").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_fails", F.coalesce(F.sum(1 - F.col("_ok")).over(in_run), F.lit(0)))
    # of each range: whether it has a success, and the failures at its end
    ends = rows.groupBy("_part", *key).agg(F.max("_run").alias("_runs"), F.max_by(F.col("_fails"), F.struct("_run", "_fails")).alias("_tail"))
    upto = Window.partitionBy(*key).orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)
    ends = ends.withColumn("_group", F.sum(F.when(F.col("_runs") > 0, 1).otherwise(0)).over(upto))
    ends = ends.withColumn("_sum", F.sum("_tail").over(Window.partitionBy(*key, "_group").orderBy("_part").rowsBetween(Window.unboundedPreceding, 0)))
    ends = ends.withColumn("_carry", F.lag("_sum").over(Window.partitionBy(*key).orderBy("_part"))).select("_part", *key, "_carry")
    out = _carried(rows, ends, key)
    fails = F.col("_fails") + F.when(F.col("_run") == 0, F.coalesce("_carry", F.lit(0))).otherwise(0)
    return out.withColumn("failures", fails.cast("bigint")).withColumn("cooldown", F.col("failures") >= threshold).drop("_ok", "_run", "_fails", "_carry", "_part")


def newest(df: DataFrame, key: list[str], order: list[str], n: int) -> DataFrame:
    """The last ``n`` rows of every key, such as the attempts that are kept."""
    w = Window.partitionBy(*key).orderBy(*[F.desc(c) for c in order])
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")


def waiting(df: DataFrame, key: list[str], wait: str) -> DataFrame:
    """How often and how long requests of a key waited."""
    return df.groupBy(*key).agg(F.count_if(F.col(wait) > 0).cast("bigint").alias("delays"), F.sum(wait).cast("bigint").alias("wait_total"))


def response_checks(status: Column, body: Column, codes: list[int] = (), contains: str | None = None, lacks: str | None = None) -> Column:
    """Whether an answer looks as it should: code, text in the body, text not in it."""
    out = F.lit(True)
    if codes:
        out = out & status.isin(list(codes))
    if contains:
        out = out & body.contains(contains)
    return F.coalesce(out & ~body.contains(lacks) if lacks else out, F.lit(False))
