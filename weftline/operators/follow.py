"""Following links: detail pages merged into their records, and pages that name the next page.

A link is an equi-join on the address; a record whose page is missing survives (left join). Depth is a constant
of the job, so nested details are unrolled joins that Catalyst plans as one query. Pages that name their
successor need one join per hop: all sources advance together, each hop is written to the shared folder, and the
frontier shrinks to nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.shared import materialize


def follow(records: DataFrame, key: list[str], links: Column, pages: DataFrame, url: str, fields: list[str], strategy: str = "override", namespace: str = "detail") -> DataFrame:
    """Records with the fields of the pages their links lead to.

    ``links`` is an array of addresses per record; repeated and null ones count once, in order. ``strategy``:
    ``override`` — the last page found replaces equal columns, also by null; ``namespace`` — the pages' structs
    under ``namespace``; ``keep_list`` — as before, appended to a list of that name if there is one.
    """
    lk = records.select(*key, F.posexplode(F.array_distinct(F.filter(links, lambda u: u.isNotNull()))).alias("_pos", "_url"))
    page = pages.select(F.col(url).alias("_url"), F.struct(*fields).alias("_page"))
    if strategy == "override":
        last = lk.join(page, "_url").groupBy(*key).agg(F.max_by("_page", "_pos").alias("_page"))
        out = records.join(last, key, "left")
        hit = F.col("_page").isNotNull()
        return out.withColumns({f: F.when(hit, F.col("_page")[f]).otherwise(F.col(f) if f in records.columns else F.lit(None)) for f in fields}).drop("_page")
    found = lk.join(page, "_url").groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("_pos", "_page"))).alias("_found"))
    out = records.join(found.withColumn("_pages", F.transform("_found", lambda x: x["_page"])).drop("_found"), key, "left")
    empty = F.coalesce("_pages", F.array().cast(out.schema["_pages"].dataType))
    old = F.coalesce(F.col(namespace), F.array().cast(out.schema["_pages"].dataType)) if strategy == "keep_list" and namespace in records.columns else None
    return out.withColumn(namespace, F.concat(old, empty) if old is not None else empty).drop("_pages")


def follow_levels(records: DataFrame, key: list[str], levels: list[tuple[str, DataFrame, str, dict[str, str]]]) -> DataFrame:
    """Nested details: each level is (link column, pages, address column, {field: new name}); the link column of
    a level may be a field of the level before. A page visited before by the record is not visited again."""
    out = records.withColumn("_seen", F.array().cast("array<string>"))
    for link, pages, url, names in levels:
        kind = pages.schema[url].dataType
        fresh = F.when(~F.array_contains("_seen", F.concat(F.lit(f"{url}:"), F.col(link).cast("string"))), F.col(link)).cast(kind)
        right = pages.select(F.col(url).alias("_to"), *[F.col(a).alias(b) for a, b in names.items()])
        clash = [c for c in names.values() if c in out.columns]
        joined = out.withColumn("_go", fresh).join(right.withColumnsRenamed({c: f"_new_{c}" for c in clash}).withColumn("_hit", F.lit(True)), F.col("_go") == F.col("_to"), "left")
        joined = joined.withColumns({c: F.when(F.col("_hit"), F.col(f"_new_{c}")).otherwise(F.col(c)) for c in clash}) if clash else joined
        seen = F.when(F.col("_go").isNotNull(), F.concat("_seen", F.array(F.concat(F.lit(f"{url}:"), F.col("_go").cast("string"))))).otherwise(F.col("_seen"))
        out = joined.withColumn("_seen", seen).drop("_go", "_to", "_hit", *[f"_new_{c}" for c in clash])
    return out.drop("_seen")


def walk_pages(start: DataFrame, step: Callable[[DataFrame], DataFrame], max_pages: int) -> DataFrame:
    """``source, page_index, url`` of pages that name their successor, up to ``max_pages`` per source.

    ``start`` has ``source, url``; ``step`` maps such a frontier to the next one, leaving out what ends. Pages that
    a source visited before end it, so loops stop.
    """
    frontier = materialize(start.select("source", F.lit(1).alias("page_index"), "url"), "frontier")
    visited = frontier
    for _ in range(max_pages - 1):
        nxt = step(frontier).select("source", "url").where("url is not null")
        ahead = nxt.join(visited.select("source", "url"), ["source", "url"], "left_anti").join(frontier.select("source", (F.col("page_index") + 1).alias("page_index")), "source")
        frontier = materialize(ahead.select("source", "page_index", "url"), "frontier")
        if frontier.isEmpty():
            break
        visited = visited.unionByName(frontier)
    return visited


def numbered_pages(sources: DataFrame, rows_per_page: DataFrame, size: int, max_pages: int, max_records: int | None = None) -> DataFrame:
    """``source, page_index, offset, taken`` of offset pages: up to the first empty page, ``max_pages`` and the
    running limit of records. ``rows_per_page`` has ``source, page_index, n``."""
    from pyspark.sql import Window

    plan = sources.select("source", F.explode(F.sequence(F.lit(1), F.lit(max_pages))).alias("page_index"))
    got = plan.join(rows_per_page, ["source", "page_index"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    w = Window.partitionBy("source").orderBy("page_index")
    got = got.withColumn("_empty", F.coalesce(F.max(F.when(F.col("n") == 0, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    got = got.withColumn("_before", F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    got = got.where("_empty = 0")
    if max_records is not None:
        got = got.where((F.col("_before") < max_records) | (F.col("page_index") == 1))
        taken = F.greatest(F.lit(0), F.least(F.col("n"), F.lit(max_records) - F.col("_before")))
    else:
        taken = F.col("n")
    return got.select("source", "page_index", ((F.col("page_index") - 1) * size).alias("offset"), taken.cast("bigint").alias("taken"))
