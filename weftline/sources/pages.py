"""Pages to extract from: tables, local files, scripted answers, and optional fetching.

Fetching is a join with a table of pages on the address: what a crawl stored is read, not asked again.
"""

from __future__ import annotations

import gzip
import zlib

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Content types by file suffix.
SUFFIXES = {"html": "text/html", "htm": "text/html", "json": "application/json", "txt": "text/plain"}


def content_type(path: Column) -> Column:
    """Content type by suffix."""
    out = F.lit("application/octet-stream")
    for suffix, kind in SUFFIXES.items():
        out = F.when(F.lower(path).endswith(f".{suffix}"), kind).otherwise(out)
    return out


def local_files(spark: SparkSession, path: str) -> DataFrame:
    """Files as pages with status 200."""
    files = spark.read.format("binaryFile").load(path)
    return files.select(F.col("path").alias("url"), F.lit(200).alias("status_code"), F.decode("content", "UTF-8").alias("body"), content_type(F.col("path")).alias("content_type"), F.col("path").alias("final_url"))


def fetch(requests: DataFrame, pages: DataFrame, url: str = "url") -> DataFrame:
    """Requests with the page of their address; without one, ``error_type`` says network."""
    found = pages.withColumnsRenamed({c: f"page_{c}" for c in pages.columns if c in requests.columns and c != url})
    key = f"page_{url}" if url in requests.columns and f"page_{url}" in found.columns else url
    right = found.withColumnRenamed(key, "_key").withColumn("_hit", F.lit(True))
    return requests.join(right, requests[url] == F.col("_key"), "left").withColumn("error_type", F.when(F.col("_hit").isNull(), F.lit("network"))).drop("_key", "_hit")


def scripted(requests: DataFrame, answers: DataFrame) -> DataFrame:
    """Attempt n of an address gets its nth answer, the last one again and again: ``answers`` has ``url, attempt`` and
    the answer, ``requests`` has ``url, attempt``."""
    most = answers.groupBy("url").agg(F.max("attempt").alias("_most"))
    asked = requests.join(most, "url", "left").withColumn("_n", F.least("attempt", "_most"))
    return asked.join(answers.withColumnRenamed("attempt", "_n"), ["url", "_n"], "left").drop("_n", "_most")


def numbered_attempts(requests: DataFrame, order: list[str]) -> DataFrame:
    """``attempt``: how often an address was asked so far."""
    return requests.withColumn("attempt", F.row_number().over(Window.partitionBy("url").orderBy(*order)))


def parse(body: Column, kind: str) -> Column:
    """Body as the job wants it: text and HTML as they are, JSON parsed (null if broken), binary never extracted."""
    if kind == "json":
        return F.try_parse_json(body)
    return F.lit(None).cast("string") if kind == "binary" else body


def sniff_json(body: Column) -> Column:
    """The body if it starts like JSON and is, else null."""
    return F.when(F.ltrim(body).rlike(r"^[\[{]") & F.try_parse_json(body).isNotNull(), body)


@F.pandas_udf(T.BinaryType())
def decompress(body: pd.Series, encoding: pd.Series) -> pd.Series:
    """Body without its content encoding: gzip, deflate with or without header; others as they are."""

    def one(data: bytes | None, kind: str | None) -> bytes | None:
        if data is None:
            return None
        kind = (kind or "").strip().lower()
        if kind == "gzip":
            return gzip.decompress(data)
        if kind == "deflate":
            try:
                return zlib.decompress(data)
            except zlib.error:
                return zlib.decompress(data, -zlib.MAX_WBITS)
        return data

    return pd.Series([one(d, k) for d, k in zip(body, encoding)], dtype=object)
