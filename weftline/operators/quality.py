"""Profiles of extracted fields, metric roll-ups and run reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def field_quality(df: DataFrame, fields: list[str], required: list[str] = (), by: list[str] = (), samples: int = 0, order: list[str] = ()) -> DataFrame:
    """``by…, field, total, non_empty, empty, empty_rate, status[, samples]`` in one pass over the rows.

    Null, empty text and empty arrays are empty. A required field that is always empty failed, one that sometimes
    is, and an optional one that is in half the rows, give a warning; without rows the status is unknown.
    """
    kinds = dict(df.dtypes)

    def empty(c: str) -> Column:
        if kinds[c] == "string":
            return F.col(c).isNull() | (F.col(c) == "")
        return F.col(c).isNull() | (F.size(c) == 0) if kinds[c].startswith(("array", "map")) else F.col(c).isNull()

    aggs = [F.count("*").alias("total"), *[F.count_if(empty(f)).cast("bigint").alias(f"_e{i}") for i, f in enumerate(fields)]]
    one = df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)
    row = lambda i, f: F.struct(F.lit(f).alias("field"), F.lit(f in required).alias("req"), F.col(f"_e{i}").alias("empty"))
    long = one.select(*by, "total", F.explode(F.array(*[row(i, f) for i, f in enumerate(fields)])).alias("x"))
    rate = F.coalesce(F.round(F.col("x.empty") / F.nullif(F.col("total"), F.lit(0)), 4), F.lit(0.0))
    status = (
        F.when(F.col("total") == 0, "unknown").when(F.col("x.req") & (F.col("x.empty") == F.col("total")), "failed")
        .when((F.col("x.req") & (F.col("x.empty") > 0)) | (rate >= 0.5), "warning").otherwise("ok")
    )
    out = long.select(*by, F.col("x.field").alias("field"), "total", (F.col("total") - F.col("x.empty")).alias("non_empty"), F.col("x.empty").alias("empty"), rate.alias("empty_rate"), status.alias("status"))
    if not samples:
        return out
    # each task keeps its first few values of a field, so only those are shuffled
    rank = F.struct(*order) if order else F.struct(F.lit(0))
    values = df.select(*by, rank.alias("_o"), F.explode(F.array(*[F.struct(F.lit(f).alias("f"), F.when(~empty(f), F.col(f).cast("string")).alias("v")) for f in fields])).alias("_x")).where("_x.v is not null")
    w = Window.partitionBy(*by, "_x.f").orderBy("_o", "_x.v")
    first = values.withColumn("_n", F.dense_rank().over(w)).where(F.col("_n") <= samples).groupBy(*by, F.col("_x.f").alias("field"))
    first = first.agg(F.transform(F.array_sort(F.collect_set(F.struct("_n", "_x.v"))), lambda x: x["v"]).alias("samples"))
    named = first.withColumnsRenamed({c: f"_by_{n}" for n, c in enumerate((*by, "field"))})
    same = F.lit(True)
    for n, c in enumerate((*by, "field")):
        same = same & F.col(c).eqNullSafe(F.col(f"_by_{n}"))
    joined = out.join(named, same, "left").drop(*[f"_by_{n}" for n in range(len(by) + 1)])
    return joined.withColumn("samples", F.coalesce("samples", F.array().cast("array<string>")))


def overall_status(quality: DataFrame, errors: Column | None = None) -> DataFrame:
    """One row ``status``: unknown without fields, error if any failed, warning if any warns, else ok."""
    failed = F.bool_or(F.col("status") == "failed") | (errors if errors is not None else F.lit(False))
    return quality.agg(F.when(F.count("*") == 0, "unknown").when(failed, "error").when(F.bool_or(F.col("status") == "warning"), "warning").otherwise("ok").alias("status"))


def roll_up(metrics: DataFrame, name: str = "name", kind: str = "kind", value: str = "value", order: tuple[str, ...] = ("timestamp", "metric_id")) -> DataFrame:
    """Per metric: the sum of counters, the last of gauges, count, sum, least, most and mean of timers.

    Values are summed as decimals, so the sum does not depend on the order. Blank names are left out; unknown
    kinds are counters.
    """
    v = F.coalesce(F.col(value), F.lit(0.0))
    k = F.when(F.col(kind).isin("gauge", "timer"), F.col(kind)).otherwise("counter")
    total = F.sum(v.cast("decimal(28,6)"))
    g = metrics.where((F.col(name).isNotNull()) & (F.trim(F.col(name)) != "")).groupBy(k.alias("kind"), F.col(name).alias("name"))
    return g.agg(
        F.count("*").alias("n"), total.cast("double").alias("total"), F.min(v).alias("least"), F.max(v).alias("most"), (total / F.count("*")).cast("double").alias("mean"), F.max_by(v, F.struct(*order)).alias("last")
    )


def top_values(df: DataFrame, column: str, order: str, n: int = 5) -> DataFrame:
    """The ``n`` most frequent values; the one seen first wins ties."""
    return df.groupBy(column).agg(F.count("*").alias("n"), F.min(order).alias("first_seen")).orderBy(F.desc("n"), "first_seen").limit(n)


def count_by(df: DataFrame, column: str) -> DataFrame:
    """Rows per value, null as ``unknown``."""
    return df.groupBy(F.coalesce(F.col(column).cast("string"), F.lit("unknown")).alias(column)).agg(F.count("*").alias("n"))


def duplicate_rate(duplicates: Column, seen: Column) -> Column:
    """Share of repeated rows, four digits, 0 if nothing was seen."""
    return F.coalesce(F.round(duplicates / F.nullif(seen, F.lit(0)), 4), F.lit(0.0))


def duration_ms(start: Column, end: Column) -> Column:
    """Milliseconds between two instants as text, never negative; null if one cannot be read."""
    us = F.unix_micros(F.try_to_timestamp(end)) - F.unix_micros(F.try_to_timestamp(start))
    return F.when(us.isNotNull(), F.greatest(F.lit(0).cast("bigint"), F.floor(us / 1000).cast("bigint")))


def metric_rows(df: DataFrame, keep: list[str], counters: list[str]) -> DataFrame:
    """Counters of wide rows as ``keep…, metric, value``."""
    return df.select(*keep, *[F.col(c).cast("double").alias(c) for c in counters]).unpivot(keep, counters, "metric", "value")


def counters_wide(metrics: DataFrame, key: list[str], name: str, value: str, names: list[str]) -> DataFrame:
    """One row per key with the sum of each named counter, 0 where there is none."""
    one = lambda n: F.coalesce(F.sum(F.when(F.col(name) == n, F.col(value).cast("decimal(28,6)"))), F.lit(0)).cast("double")
    return metrics.groupBy(*key).agg(*[one(n).alias(n) for n in names])


def diagnose(raw: DataFrame, fields: list[str], order: tuple[str, ...] = ("url", "item_pos")) -> DataFrame:
    """Per field of raw values (arrays): scopes, matches, scopes without match, and the first match in ``order``."""
    aggs = [F.count("*").alias("scopes")]
    for i, f in enumerate(fields):
        n = F.coalesce(F.size(f), F.lit(0))
        aggs += [F.coalesce(F.sum(n), F.lit(0)).cast("bigint").alias(f"_n{i}"), F.count_if(n < 1).cast("bigint").alias(f"_m{i}"), F.min_by(F.get(f, F.lit(0)), F.when(F.get(f, F.lit(0)).isNotNull(), F.struct(*[c for c in order if c in raw.columns], F.get(f, F.lit(0))))).alias(f"_f{i}")]
    one = raw.agg(*aggs)
    rows = [F.struct(F.lit(f).alias("field"), F.col(f"_n{i}").alias("matches"), F.col(f"_m{i}").alias("missing"), F.col(f"_f{i}").cast("string").alias("first")) for i, f in enumerate(fields)]
    return one.select("scopes", F.explode(F.array(*rows)).alias("x")).select("x.field", "scopes", "x.matches", "x.missing", "x.first")


def run_report(records: DataFrame, rejects: DataFrame, decisions: DataFrame, fields: list[str], required: list[str]) -> DataFrame:
    """``measure, value`` of a run: rows, rejects, addresses checked and blocked, quality."""
    row = lambda df, name, value: df.agg(value.cast("string").alias("value")).select(F.lit(name).alias("measure"), "value")
    out = row(records, "saved_records", F.count("*"))
    for part in (row(rejects, "rejected", F.count("*")), row(decisions, "checked_urls", F.count("*")), row(decisions, "blocked_urls", F.count_if(~F.col("allowed")))):
        out = out.unionByName(part)
    return out.unionByName(overall_status(field_quality(records, fields, required)).select(F.lit("quality").alias("measure"), F.col("status").alias("value")))
