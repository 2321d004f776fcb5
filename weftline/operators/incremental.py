"""State between runs: which records were seen (hash index) and how far a source was read (high-water mark).

The order of the two tests matters and is kept: a row that the mark holds back registers no hash, and a repeated
row never reaches the mark. As the mark is fixed when a run begins, filtering by it first and keeping the first
row of each hash then gives the same rows as going through them one by one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_by(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """One row per key, the one that comes first in ``order``; null keys are a key too.

    One pass: rows meet before the shuffle, so a key that holds a third of all rows sends one row a task.
    """
    row = F.min_by(F.struct(*[F.col(f"`{c}`") for c in df.columns]), F.struct(*order)).alias("_row")
    return df.groupBy(*key).agg(row).select("_row.*")


def mark_repeats(df: DataFrame, key: list[str], order: list[str], index: DataFrame | None = None) -> DataFrame:
    """``df`` with ``is_duplicate``: the key is in ``index`` or on an earlier row."""
    first = df.groupBy(*key).agg(F.min(F.struct(*order)).alias("_first"))
    out = df.join(first, key).withColumn("is_duplicate", F.struct(*order) > F.col("_first")).drop("_first")
    if index is None:
        return out
    known = index.select(*key).distinct().withColumn("_known", F.lit(True))
    return out.join(known, key, "left").withColumn("is_duplicate", F.col("is_duplicate") | F.col("_known").isNotNull()).drop("_known")


def new_rows(df: DataFrame, key: list[str], order: list[str], index: DataFrame) -> DataFrame:
    """First rows of keys that the index does not hold; they are also what the index gains."""
    return first_by(df.join(index.select(*key), key, "left_anti"), key, order)


def index_delta(kept: DataFrame, key: list[str], index: DataFrame) -> DataFrame:
    """Keys to append to the index."""
    return kept.select(*key).distinct().join(index.select(*key), key, "left_anti")


def newer(value: Column, bound: object, strategy: str = "max") -> Column:
    """Strictly beyond the mark; rows without a value are kept, as is everything without a mark."""
    if bound is None:
        return F.lit(True)
    b = bound if isinstance(bound, Column) else F.lit(bound)
    return F.coalesce((value > b) if strategy == "max" else (value < b), F.lit(True))


def candidate(df: DataFrame, value: Column, raw: Column, strategy: str = "max") -> DataFrame:
    """One row ``watermark``: the raw value that becomes the mark if the run succeeds."""
    return df.agg((F.max_by if strategy == "max" else F.min_by)(raw, value).alias("watermark"))


def stop_prefix(df: DataFrame, source: str, page: str, old: Column) -> DataFrame:
    """Rows of the pages up to the first one (and with it) that holds an old row, per source.

    Pages are aggregated first, so the window runs over pages, not rows.
    """
    pages = df.groupBy(source, page).agg(F.max(old.cast("int")).alias("_old"))
    w = Window.partitionBy(source).orderBy(page).rowsBetween(Window.unboundedPreceding, -1)
    keep = pages.withColumn("_before", F.coalesce(F.max("_old").over(w), F.lit(0))).where("_before = 0").select(source, page)
    return df.join(keep, [source, page], "left_semi")


def process(df: DataFrame, key: list[str], order: list[str], index: DataFrame, value: Column | None = None, bound: object = None, strategy: str = "max", skip_existing: bool = True, missing: str = "error") -> DataFrame:
    """Rows to save of a run: repeated ones dropped (or marked), held back by the mark, first ones kept.

    ``missing`` is what happens to rows with a null key: ``error``, ``skip``, ``warn`` or ``allow_empty`` (kept, hashed
    with null).
    """
    absent = F.lit(False)
    for k in key:
        absent = absent | F.col(k).isNull()
    if missing == "skip":
        df = df.where(~absent)
    elif missing == "error":
        df = df.withColumn(key[0], F.when(absent, F.raise_error(F.lit("missing dedup key")).cast(df.schema[key[0]].dataType)).otherwise(F.col(key[0])))
    fresh = df.where(newer(value, bound, strategy)) if value is not None else df
    return new_rows(fresh, key, order, index) if skip_existing else mark_repeats(fresh, key, order, index)
