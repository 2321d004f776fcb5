"""Small operators around a run: aliases of names, failures as rows, texts for search, proxies and cookies, copies of
targets that are to run again.

Defined results: nulls stay null; unknown names stay as they are; empty tables give empty tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions.transforms import strip

# Spellings of job states and of what an event or a report may be about.
JOB_STATES = {"canceled": "cancelled", "success": "succeeded", "error": "failed", "queued": "pending"}
TARGETS = {"tasks": "task", "jobs": "job", "schedules": "schedule", "schedulers": "schedule", "workers": "worker", "spiders": "spider", "runs": "run"}


def alias(name: Column, names: dict[str, str]) -> Column:
    """A name in its present spelling: lower case, without outer blanks, older spellings replaced."""
    clean = F.lower(strip(name))
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in names.items() for x in pair]), clean), clean) if names else clean


def failure(url: Column, kind: Column, message: Column) -> Column:
    """A failure as it stands among the warnings of a run."""
    return F.struct(url.alias("url"), kind.alias("error_type"), F.left(message, F.lit(300)).alias("message"))


def transform_failures(warnings: DataFrame, column: str, order: str, n: int = 5) -> DataFrame:
    """The first ``n`` warnings that speak of transforms, cut to 300 characters: a report, hence the limit."""
    found = warnings.where(F.lower(column).contains("transform"))
    return found.orderBy(order).limit(n).select(order, F.left(column, F.lit(300)).alias(column))


def run_failed(succeeded: Column, failed: Column, engine_error: Column, fail_fast: Column) -> Column:
    """Whether a run failed: nothing succeeded, the engine broke, or it was to stop at the first failure."""
    return (F.coalesce(succeeded, F.lit(0)) == 0) | F.coalesce(engine_error, F.lit(False)) | (F.coalesce(fail_fast, F.lit(False)) & (F.coalesce(failed, F.lit(0)) > 0))


def sticky_key(kind: str, url: Column, spider: Column, task: Column) -> Column:
    """By what requests keep their proxy: the host, the task, or else the spider."""
    from weftline.functions import urls

    return {"domain": F.coalesce(urls.host(url), F.lit("local")), "task": task}.get(kind, spider)


def search_text(df: DataFrame, name: str = "text") -> DataFrame:
    """``df`` with all its columns as one text to search in."""
    return df.withColumn(name, F.concat_ws(" ", *[F.to_json(c) if "<" in kind else F.col(f"`{c}`").cast("string") for c, kind in df.dtypes]))


def proxies(spark: SparkSession, inline: list[str] = (), path: str | None = None) -> DataFrame:
    """``proxy, pos``: proxies of a list, then those of a text file (a line each, ``#`` begins a remark), each once."""
    listed = spark.createDataFrame([(x, i) for i, x in enumerate(inline)], "proxy string, pos long")
    if path:
        lines = spark.read.text(path).select(F.col("value").alias("proxy"), (F.monotonically_increasing_id() + len(inline)).alias("pos"))
        listed = listed.unionByName(lines)
    clean = listed.select(strip(F.col("proxy")).alias("proxy"), "pos").where("proxy <> '' and not startswith(proxy, '#')")
    return clean.groupBy("proxy").agg(F.min("pos").alias("pos"))


def cookies(text: Column) -> Column:
    """A map of cookies from any of three notations: a JSON object, a JSON list of ``{name, value}``, or lines
    ``name=value``. Later ones of a name count."""
    as_object = F.map_entries(F.from_json(text, "map<string,string>"))
    as_list = F.transform(F.filter(F.from_json(text, "array<struct<name:string,value:string>>"), lambda x: x["name"].isNotNull()), lambda x: F.struct(x["name"].alias("key"), x["value"].alias("value")))
    lines = F.filter(F.split(text, "\\r?\\n|;"), lambda x: x.contains("=") & ~F.startswith(strip(x), F.lit("#")))
    as_lines = F.transform(lines, lambda x: F.struct(strip(F.substring_index(x, "=", 1)).alias("key"), strip(F.regexp_extract(x, "^[^=]*=(.*)$", 1)).alias("value")))
    first = F.substring(strip(text), 1, 1)
    return merged(F.when(first == "{", as_object).when(first == "[", as_list).otherwise(as_lines))


def merged(entries: Column) -> Column:
    """A map of entries of which the last of a key counts; keys stand in the order of their first entry."""
    keys = F.array_distinct(F.transform(entries, lambda e: e["key"]))
    last = lambda k: F.element_at(F.filter(entries, lambda e: e["key"] == k), -1)["value"]
    return F.map_from_arrays(keys, F.transform(keys, last))


def overlay(*maps: Column) -> Column:
    """Maps laid over each other: of a key in several the last map's value counts; null maps are empty."""
    entries = [F.coalesce(F.map_entries(m), F.array().cast("array<struct<key:string,value:string>>")) for m in maps]
    return merged(F.concat(*entries))


def trace_id(given: Column, existing: Column) -> Column:
    """The trace of a run: the one given, else the one it had, else a new one."""
    return F.coalesce(given, existing, F.uuid())


def page_hint(url: Column, offset_param: str = "offset", cursor_param: str = "cursor") -> Column:
    """Where a run stood, from the address of its next page: offset and cursor."""
    from weftline.functions import urls

    cursor = F.try_url_decode(F.nullif(F.regexp_extract(urls.query(url), rf"(?:^|&){cursor_param}=([^&]*)", 1), F.lit("")))
    return F.struct(urls.int_param(url, offset_param).alias("offset"), cursor.alias("cursor"))


def runs_again(targets: DataFrame, key: str, new_id: Column, **reset: Column) -> DataFrame:
    """Copies of targets that are to run again: under a new id, linked to their source, with columns set anew."""
    return targets.withColumn(f"source_{key}", F.col(key)).withColumns({key: new_id, **reset})


def running_counts(df: DataFrame, order: list[str], saved: Column) -> DataFrame:
    """``seen`` and ``records`` up to each row in ``order``: positions over all rows, without a single task."""
    from weftline.operators.policy import ranked

    rows = ranked(df, order, "seen").withColumn("_saved", saved)
    kept = ranked(rows.where("_saved"), ["seen"], "records").select("seen", "records")
    ahead = rows.drop("_saved").join(kept, "seen", "left")
    from weftline.operators.governance import previous

    return previous(ahead.withColumn("_all", F.lit(1)), ["_all"], ["seen"], F.col("records"), "_before").withColumn("records", F.coalesce("records", "_before", F.lit(0))).drop("_all", "_before")
