"""Queries of what stands around a run: logs, failures, durations, samples, proxies, copies; each beside its SQL.

They run over whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators import handling, incremental, policy, quality, shape
from weftline.shared import table
from weftline.sources import pages as page_sources
from weftline.sources import store

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str):
    """Register a query under its name with its SQL."""

    def keep(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return keep


@query("""
WITH l AS (SELECT event_id, CASE WHEN value < 20 THEN 'debug' WHEN value < 60 THEN 'INFO' WHEN value < 90 THEN 'Warning' WHEN value < 95 THEN 'odd' ELSE 'ERROR' END AS level, 'u' || user_id AS target FROM events)
SELECT event_id, level FROM l WHERE upper(level) IN ('WARNING', 'ERROR')""")
def log_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log rows of a level or above; unknown levels count as information."""
    v = F.col("value")
    level = F.when(v < 20, "debug").when(v < 60, "INFO").when(v < 90, "Warning").when(v < 95, "odd").otherwise("ERROR")
    return table(spark, sf_dir, "events").select("event_id", level.alias("level")).where(store.at_least("warning"))


@query("""
SELECT event_id FROM events WHERE 'u' || user_id = 'u7' OR event_type = 'u7'""")
def log_target(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log rows in which a target is any of the ids."""
    logs = table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("u"), "user_id").alias("task_id"), F.col("event_type").alias("job_id"))
    return store.scan_logs(logs, target="u7").select("event_id")


@query("""
SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber <> 3 THEN greatest(0, epoch_ms(l_shipdate) - epoch_ms(o_orderdate)) END AS ms
FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")
def durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Milliseconds between two instants as text; never negative, null where one cannot be read."""
    l, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    end = F.when(F.col("l_linenumber") == 3, "soon").otherwise(F.col("l_shipdate").cast("string"))
    return l.join(o, l.l_orderkey == o.o_orderkey).select("l_orderkey", "l_linenumber", quality.duration_ms(F.col("o_orderdate").cast("string"), end).alias("ms"))


@query("""
WITH v AS (SELECT p_brand, p_partkey, nullif(CASE WHEN p_size > 10 THEN p_type ELSE '' END, '') AS v FROM part),
first AS (SELECT * FROM v WHERE v IS NOT NULL QUALIFY row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) <= 3)
SELECT p_brand AS brand, string_agg(v, '|' ORDER BY p_partkey) AS samples FROM first GROUP BY ALL""")
def field_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three values of a field per group."""
    p = table(spark, sf_dir, "part").select("p_brand", "p_partkey", F.when(F.col("p_size") > 10, F.col("p_type")).otherwise("").alias("kind"))
    q = quality.field_quality(p, ["kind"], by=["p_brand"], samples=3, order=["p_partkey"])
    return q.where(F.size("samples") > 0).select(F.col("p_brand").alias("brand"), F.array_join("samples", "|").alias("samples"))


@query("""
SELECT p_partkey, upper(p_name) AS p_name, 'https://shop.example/' || p_partkey AS source_url, p_size FROM part""")
def enriched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns added on saving, one of which replaces an extracted one."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size")
    return shape.enrich(p, p_name=F.upper("p_name"), source_url=F.concat(F.lit("https://shop.example/"), "p_partkey"))


@query("""
SELECT DISTINCT unique_hash FROM records WHERE unique_hash IS NOT NULL AND batch_no > 0 AND unique_hash NOT IN (SELECT unique_hash FROM records WHERE unique_hash IS NOT NULL AND batch_no = 0)""")
def index_growth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hashes that new batches add to the index of accepted ones."""
    r = table(spark, sf_dir, "records").where("unique_hash is not null")
    return incremental.index_delta(r.where("batch_no > 0"), ["unique_hash"], r.where("batch_no = 0"))


@query("""
SELECT response_id, CASE WHEN lower(url) LIKE '%.html' OR lower(url) LIKE '%.htm' THEN 'text/html' WHEN lower(url) LIKE '%.json' THEN 'application/json' WHEN lower(url) LIKE '%.txt' THEN 'text/plain' ELSE 'application/octet-stream' END AS kind
FROM http_responses WHERE url IS NOT NULL""")
def types_by_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "http_responses").where("url is not null").select("response_id", page_sources.content_type(F.col("url")).alias("kind"))


@query("""
SELECT feed_no, CASE lower(trim(to_status)) WHEN 'canceled' THEN 'cancelled' WHEN 'success' THEN 'succeeded' WHEN 'error' THEN 'failed' WHEN 'queued' THEN 'pending' ELSE lower(trim(to_status)) END AS status,
  CASE lower(trim(target_type) || 's') WHEN 'tasks' THEN 'task' WHEN 'jobs' THEN 'job' ELSE lower(trim(target_type) || 's') END AS target FROM lifecycle_events""")
def present_spellings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """States and targets of events in their present spelling."""
    e = table(spark, sf_dir, "lifecycle_events")
    return e.select("feed_no", handling.alias(F.col("to_status"), handling.JOB_STATES).alias("status"), handling.alias(F.concat(F.trim("target_type"), F.lit("s")), handling.TARGETS).alias("target"))


@query("""
SELECT o_orderkey, o_orderkey % 7 = 0 OR o_orderkey % 5 = 0 OR (o_orderkey % 3 = 0 AND o_orderkey % 2 = 1) AS failed, CASE WHEN o_orderkey % 4 = 0 THEN 'host' || o_custkey || '.example' ELSE 'local' END AS sticky,
  coalesce('c' || o_custkey, 'x') || ';' || 'late' AS cookies, CASE WHEN o_orderkey % 4 = 0 THEN o_orderkey END AS at_offset FROM orders""")
def run_bookkeeping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a run failed, the key its proxy sticks to, laid-over cookies, and where its next page stands."""
    o, k = table(spark, sf_dir, "orders"), F.col("o_orderkey")
    failed = handling.run_failed(F.when(k % 7 != 0, 1), F.when(k % 2 == 1, 2), F.when(k % 5 == 0, True), k % 3 == 0)
    url = F.when(k % 4 == 0, F.concat(F.lit("https://Host"), "o_custkey", F.lit(".example/p?offset="), k, F.lit("&cursor=a"))).otherwise("/local/file.html")
    jar = handling.overlay(F.create_map(F.lit("id"), F.concat(F.lit("c"), F.col("o_custkey").cast("string")), F.lit("age"), F.lit("early")), F.lit(None).cast("map<string,string>"), F.create_map(F.lit("age"), F.lit("late")))
    return o.select("o_orderkey", failed.alias("failed"), handling.sticky_key("domain", url, F.lit("s"), F.lit("t")).alias("sticky"), F.concat_ws(";", jar["id"], jar["age"]).alias("cookies"), handling.page_hint(url)["offset"].alias("at_offset"))


@query("""
SELECT o_orderkey || '-again' AS order_id, o_orderkey AS source_order_id, 'pending' AS status, 0 AS attempt FROM orders WHERE o_orderstatus = 'F'""")
def copies_to_run_again(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies of what failed, linked to their source, with state and attempt set anew."""
    o = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("order_id"), F.col("o_orderstatus").alias("status"), F.lit(3).alias("attempt"))
    return handling.runs_again(o, "order_id", F.concat(F.col("order_id").cast("string"), F.lit("-again")), status=F.lit("pending"), attempt=F.lit(0))


@query("""
SELECT event_id, row_number() OVER (ORDER BY event_id) AS seen, count(*) FILTER (value > 50) OVER (ORDER BY event_id) AS records FROM events""")
def counters_along(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows seen and rows saved up to each row, over all rows."""
    return handling.running_counts(table(spark, sf_dir, "events").select("event_id", "value"), ["event_id"], F.col("value") > 50).select("event_id", "seen", "records")


@query("""
SELECT least(100, greatest(1, count(*)) * 3 + 7) AS requests FROM region""")
def request_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests that a job over all regions makes at most, its counter being one row."""
    n = table(spark, sf_dir, "region").count()
    return spark.range(1).select(F.lit(policy.estimate(n, 3, 7, True, policy.Policy())).cast("bigint").alias("requests"))
