"""Addresses to start from: inline lists, tables, CSV and JSON files, sitemaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions.transforms import strip


def distinct_in_order(df: DataFrame, column: str, order: str) -> DataFrame:
    """Each value once, with the position at which it came first."""
    return df.groupBy(column).agg(F.min(order).alias(order))


def inline(spark: SparkSession, urls: list[str]) -> DataFrame:
    """``url, pos`` of a list; blanks are left out."""
    if any(not isinstance(u, str) for u in urls):
        raise ValueError("seed addresses must be text")
    return _clean(spark.createDataFrame([(u, i) for i, u in enumerate(urls)], "url string, pos long"))


def _clean(df: DataFrame) -> DataFrame:
    return distinct_in_order(df.select(strip(F.col("url")).alias("url"), "pos").where("url <> ''"), "url", "pos")


def of_table(df: DataFrame, column: str, order: str) -> DataFrame:
    """``url, pos`` of a column of a table, in the order of another column."""
    return _clean(df.select(F.col(column).alias("url"), F.col(order).cast("bigint").alias("pos")))


def _numbered(df: DataFrame, column: Column) -> DataFrame:
    # file and row together give the order of lines; the number only needs to be ordered, not dense
    return df.select(column.alias("url"), F.monotonically_increasing_id().alias("pos"))


def csv(spark: SparkSession, path: str, column: str = "url", header: bool = True, delimiter: str = ",") -> DataFrame:
    """Addresses of a column of a CSV file, or of its first column without header. Lines end records."""
    if len(delimiter) != 1:
        raise ValueError("a delimiter is one character")
    df = spark.read.csv(path, header=header, sep=delimiter, multiLine=False)
    name = column if header else df.columns[0]
    if name not in df.columns:
        raise ValueError(f"no column {name}")
    return _clean(_numbered(df, F.col(f"`{name}`")))


def json(spark: SparkSession, path: str, field: str = "url") -> DataFrame:
    """Addresses of a JSON list of texts or objects, or of such a list under ``field``, ``urls`` or ``seed``. Of an
    object, ``url`` goes before ``field``."""
    whole = spark.read.text(path, wholetext=True).select(F.parse_json("value").alias("v"))
    lists = F.coalesce(*[F.try_variant_get("v", p, "array<variant>") for p in ("$", f"$.{field}", "$.urls", "$.seed")])
    item = whole.select(F.posexplode(lists).alias("pos", "x"))
    url = F.coalesce(F.try_variant_get("x", "$.url", "string"), F.try_variant_get("x", f"$.{field}", "string"), F.when(F.schema_of_variant("x") == "STRING", F.try_variant_get("x", "$", "string")))
    return _clean(item.select(url.alias("url"), F.col("pos").cast("bigint").alias("pos")).where("url is not null"))


def sitemap(spark: SparkSession, path: str) -> DataFrame:
    """Every ``<loc>`` of a sitemap, in any namespace."""
    whole = spark.read.text(path, wholetext=True)
    locs = F.regexp_extract_all("value", F.lit(r"(?is)<(?:[\w-]+:)?loc\b[^>]*>\s*(?:<!\[CDATA\[)?\s*(.*?)\s*(?:\]\]>)?\s*</"), F.lit(1))
    plain = lambda c: F.replace(F.replace(c, F.lit("&amp;"), F.lit("&")), F.lit("&quot;"), F.lit('"'))
    return _clean(whole.select(F.posexplode(locs).alias("pos", "url")).select(plain(F.col("url")).alias("url"), F.col("pos").cast("bigint").alias("pos")))


#: Reader of each kind of seed, under all its names.
KINDS = {"url_list": "list", "urllist": "list", "list": "list", "sourcelist": "list", "sitemap": "sitemap", "csv": "csv", "json": "json"}


def read(spark: SparkSession, seed: list | dict, limit: int | None = None) -> DataFrame:
    """``url, pos`` of a seed: a list, or an object with ``type`` (or ``kind``) and its source."""
    if isinstance(seed, list):
        out = inline(spark, seed)
    else:
        kind = KINDS.get(str(seed.get("type") or seed.get("kind") or "").lower())
        source = next((seed[k] for k in ("source", "path", "url", "file", "uri") if seed.get(k)), None)
        if kind == "list":
            out = inline(spark, seed.get("urls") or seed.get("items") or [])
        elif kind == "csv":
            out = csv(spark, source, seed.get("column", "url"), seed.get("has_header", True), seed.get("delimiter", ","))
        elif kind == "json":
            out = json(spark, source, seed.get("field", "url"))
        elif kind == "sitemap":
            out = sitemap(spark, source)
        else:
            raise ValueError(f"unknown seed type {seed.get('type') or seed.get('kind')}")
    return out if limit is None else out.orderBy("pos").limit(limit)


def start_urls(spark: SparkSession, config: dict) -> DataFrame:
    """Start addresses of a job: its list, else its request's address, else its seed."""
    if config.get("start_urls"):
        return inline(spark, config["start_urls"])
    one = (config.get("request") or {}).get("url")
    return inline(spark, [one]) if one else read(spark, config.get("seed") or [])
