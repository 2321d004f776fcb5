"""Queries of the record pipeline's own operators over the supplied tables, each beside the SQL it must equal.

They run over whole tables. Where a query ends in a page or a list of the most frequent, that is the operator.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.functions import hashing, jsonpath, transforms, urls
from weftline.operators import follow, governance, incremental, policy, quality, schedule, shape
from weftline.shared import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its name, with its SQL if it has one."""

    def keep(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return keep


# addresses -------------------------------------------------------------------------------------------------
_PART_URL = "concat('HTTP://Www.Shop', p_size, '.Example:8080/Items/', p_partkey, '?utm_source=feed&q=', replace(p_name, ' ', '+'), '&&Ref=a&UTM_MEDIUM=z&k#top')"


@query(f"""
WITH u AS (SELECT p_partkey, {_PART_URL} AS url FROM part),
parts AS (SELECT p_partkey, lower(regexp_extract(url, '^([^:]+://[^/?#]*)', 1)) AS head, regexp_extract(url, '^[^:]+://[^/?#]*([^?#]*)', 1) AS path,
  list_filter(string_split(regexp_extract(url, '^[^#?]*\\?([^#]*)', 1), '&'), lambda p: p <> '' AND lower(split_part(p, '=', 1)) NOT IN ('utm_source', 'utm_medium')) AS pairs FROM u)
SELECT p_partkey, head || path || '?' || list_aggregate(list_transform(pairs, lambda p: CASE WHEN contains(p, '=') THEN p ELSE p || '=' END), 'string_agg', '&') AS url FROM parts""")
def url_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", urls.normalize(F.expr(_PART_URL)).alias("url"))


@query(f"""
WITH u AS (SELECT p_partkey, {_PART_URL} AS url FROM part)
SELECT p_partkey, 'www.shop' || regexp_extract(url, 'Shop([0-9]+)', 1) || '.example' AS host, 'http://' || regexp_extract(url, '^[^:]+://([^?#]*)', 1) AS bare,
  'http://' || regexp_extract(url, '^[^:]+://([^?#]*)', 1) || '?q=' || regexp_extract(url, '&?q=([^&#]*)', 1) || '&k=' AS kept, regexp_extract(url, '^[^:]+://([^/?#]*)', 1) AS rate_key
FROM u""")
def url_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.expr(_PART_URL)
    return table(spark, sf_dir, "part").select("p_partkey", urls.host(u).alias("host"), urls.strip_query(u).alias("bare"), urls.keep_query(u, ["q", "k"]).alias("kept"), urls.rate_key(u).alias("rate_key"))


@query("""
SELECT response_id, lower(regexp_extract(url, '^[^:]+://([^/?#]*)', 1)) AS host,
  lower(regexp_extract(url, '^[^:]+://([^/?#]*)', 1)) LIKE 'shop.%' AS denied, NOT regexp_matches(url, '/[a-m][^/]*/[0-9]+$') AS unlisted
FROM http_responses WHERE url IS NOT NULL AND (lower(regexp_extract(url, '^[^:]+://([^/?#]*)', 1)) LIKE 'shop.%' OR NOT regexp_matches(url, '/[a-m][^/]*/[0-9]+$'))""")
def policy_blocked(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "http_responses").where("url is not null").select("response_id", "url")
    d = policy.decide(rows, "url", policy.Policy(max_requests=1 << 60, include=(r"/[a-m][^/]*/[0-9]+$",), exclude=(r"^https?://shop\.",)), ["response_id"])
    has = lambda text: F.exists("violations", lambda v: v.startswith(text))
    return d.where(~F.col("allowed")).select("response_id", "host", has("url matched exclude").alias("denied"), has("url did not match").alias("unlisted"))


@query("""
WITH n AS (SELECT response_id, row_number() OVER (ORDER BY response_id) AS k, lower(regexp_extract(url, '^[^:]+://([^/?#]*)', 1)) AS host FROM http_responses WHERE url IS NOT NULL)
SELECT count(*) AS policy_checked_urls, count(*) FILTER (k > 300 OR NOT (host LIKE '%.example')  OR host LIKE '%.grigri-galkada.example') AS policy_blocked_urls, 0::BIGINT AS policy_warnings, 0::BIGINT AS normalized_urls FROM n""")
def policy_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "http_responses").where("url is not null").select("response_id", "url")
    return policy.summary(policy.decide(rows, "url", policy.Policy(max_requests=300, allowed=("example",), denied=("grigri-galkada.example",)), ["response_id"]), "url")


# scalar transforms -------------------------------------------------------------------------------------------
@query("""
SELECT p_partkey, trim(regexp_replace(x, '\\s+', ' ', 'g')) AS tidy, CAST(regexp_extract(replace(price, ',', ''), '-?\\d+(\\.\\d+)?', 0) AS DOUBLE) * CASE WHEN p_size % 3 = 0 THEN 1000 WHEN p_size % 3 = 1 THEN 10000 ELSE 1 END AS parsed,
  p_size % 2 = 0 AS flag, 'Brand' || regexp_extract(p_brand, '([0-9]+)', 1) AS code, list_filter(list_transform(string_split(p_name || ', ,' || p_type, ','), lambda v: trim(v)), lambda v: v <> '') AS parts,
  CASE WHEN starts_with(p_type, 'PROMO') THEN substr(p_type, 6) ELSE p_type END AS cut
FROM (SELECT *, '  ' || p_name || chr(9) || ' ' || p_type || chr(10) AS x, 'USD ' || printf('%d', CAST(floor(p_retailprice) AS BIGINT)) || CASE WHEN p_size % 3 = 0 THEN 'k' WHEN p_size % 3 = 1 THEN '万' ELSE '' END AS price FROM part)""")
def transform_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    x = F.concat(F.lit("  "), "p_name", F.lit("\t "), "p_type", F.lit("\n"))
    price = F.concat(F.lit("USD "), F.floor("p_retailprice").cast("string"), F.when(F.col("p_size") % 3 == 0, "k").when(F.col("p_size") % 3 == 1, "万").otherwise(""))
    flag = F.when(F.col("p_size") % 2 == 0, F.lit(" Yes ")).otherwise("maybe")
    chain = lambda c, *steps: transforms.apply_chain(c, list(steps))[0]
    return p.select(
        "p_partkey", chain(x, "normalize_space").alias("tidy"), chain(price, "currency_parse").alias("parsed"), chain(flag, "bool").alias("flag"),
        chain(F.col("p_brand"), {"type": "regex_extract", "pattern": r"(?P<n>[0-9]+)", "group": "n"}, {"type": "prefix", "value": "Brand"}).alias("code"),
        chain(F.concat("p_name", F.lit(", ,"), "p_type"), "split").alias("parts"), chain(F.col("p_type"), {"type": "remove_prefix", "value": "PROMO"}).alias("cut"),
    )


_BLANK = r"[\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


@query(f"SELECT doc_id, md5(trim(regexp_replace(coalesce(text, ''), '{_BLANK}', ' ', 'g'))) AS digest FROM documents")
def normalize_space_md5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(transforms.normalize_space(F.coalesce("text", F.lit("")))).alias("digest"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def scalar_json_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", jsonpath.scalar(F.col("props"), "$.k").cast("bigint").alias("k"))


@query("""SELECT o_orderkey, sha256('{"k1": ' || o_orderkey || ', "k2": "' || o_orderstatus || '", "k3": null}') AS hash FROM orders""")
def canonical_json_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    cols = {"k2": (F.col("o_orderstatus"), T.StringType()), "k1": (F.col("o_orderkey"), T.LongType()), "k3": (F.lit(None).cast("string"), T.StringType())}
    return table(spark, sf_dir, "orders").select("o_orderkey", hashing.record_hash(cols).alias("hash"))


# repeats and marks -------------------------------------------------------------------------------------------
@query("SELECT min(doc_id) AS doc_id, md5(text) AS hash FROM documents WHERE text IS NOT NULL GROUP BY md5(text)")
def dedup_first_by_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.md5("text").alias("hash"))
    return incremental.first_by(d, ["hash"], ["doc_id"])


@query("""
SELECT doc_id, md5(coalesce(text, '')) AS hash, row_number() OVER (PARTITION BY md5(coalesce(text, '')) ORDER BY doc_id) > 1 OR md5(coalesce(text, '')) IN (SELECT md5(coalesce(text, '')) FROM documents WHERE kind = 'note') AS is_duplicate
FROM documents WHERE kind <> 'note'""")
def mark_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "kind", F.md5(F.coalesce("text", F.lit(""))).alias("hash"))
    return incremental.mark_repeats(d.where("kind <> 'note'").select("doc_id", "hash"), ["hash"], ["doc_id"], d.where("kind = 'note'").select("hash"))


@query("""
SELECT min(doc_id) AS doc_id, md5(text) AS hash FROM documents WHERE kind <> 'note' AND text IS NOT NULL AND md5(text) NOT IN (SELECT md5(text) FROM documents WHERE kind = 'note' AND text IS NOT NULL) GROUP BY md5(text)""")
def anti_join_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", "kind", F.md5("text").alias("hash"))
    return incremental.new_rows(d.where("kind <> 'note'").select("doc_id", "hash"), ["hash"], ["doc_id"], d.where("kind = 'note'").select("hash"))


@query("SELECT event_id, user_id FROM events WHERE ts > TIMESTAMP '2024-01-10 12:00:00'")
def high_water_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.where(incremental.newer(F.col("ts"), F.lit("2024-01-10 12:00:00").cast("timestamp_ntz"))).select("event_id", "user_id")


@query("SELECT strftime(max(ts), '%Y-%m-%d %H:%M:%S.%f') AS watermark FROM events WHERE ts > TIMESTAMP '2024-01-10 12:00:00'")
def watermark_candidate(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").where(incremental.newer(F.col("ts"), F.lit("2024-01-10 12:00:00").cast("timestamp_ntz")))
    return incremental.candidate(e, F.col("ts"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"))


_PAGES = "SELECT *, user_id AS source, CAST(floor((row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) - 1) / 10) AS BIGINT) + 1 AS page_index FROM events"


@query(f"""
WITH p AS ({_PAGES}), o AS (SELECT source, page_index, max(CASE WHEN ts <= TIMESTAMP '2024-01-10 12:00:00' THEN 1 ELSE 0 END) AS old FROM p GROUP BY ALL),
k AS (SELECT *, coalesce(max(old) OVER (PARTITION BY source ORDER BY page_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS stopped FROM o)
SELECT p.source, p.page_index, count(*) AS n FROM p JOIN k ON p.source = k.source AND p.page_index = k.page_index WHERE k.stopped = 0 GROUP BY ALL""")
def stop_page_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    table(spark, sf_dir, "events").createOrReplaceTempView("weftline_events")
    p = spark.sql(_PAGES.replace("FROM events", "FROM weftline_events"))
    kept = incremental.stop_prefix(p, "source", "page_index", F.col("ts") <= F.lit("2024-01-10 12:00:00").cast("timestamp_ntz"))
    return kept.groupBy("source", "page_index").agg(F.count("*").alias("n"))


@query("""
WITH n AS (SELECT o_custkey AS source, count(*) AS total FROM orders GROUP BY o_custkey), p AS (SELECT source, page_index, greatest(0, least(4, total - (page_index - 1) * 4)) AS n FROM n, range(1, 6) r(page_index)),
b AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY source ORDER BY page_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, coalesce(min(n) OVER (PARTITION BY source ORDER BY page_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1) AS least_before FROM p)
SELECT source, CAST(page_index AS INT) AS page_index, CAST((page_index - 1) * 4 AS INT) AS "offset", CAST(least(n, 10 - before) AS BIGINT) AS taken FROM b WHERE least_before > 0 AND before < 10""")
def offset_pages_limited(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("source")).agg(F.count("*").alias("total"))
    pages = n.select("source", "total", F.explode(F.sequence(F.lit(1), F.lit(5))).alias("page_index"))
    pages = pages.select("source", "page_index", F.greatest(F.lit(0), F.least(F.lit(4), F.col("total") - (F.col("page_index") - 1) * 4)).alias("n"))
    return follow.numbered_pages(n.select("source"), pages, 4, 5, 10)


# details -----------------------------------------------------------------------------------------------------
@query("""
SELECT l_orderkey, l_linenumber, o_orderstatus AS status, c_name, n_name FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey AND o_orderpriority <> '5-LOW'
LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = c_nationkey""")
def detail_override_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = lambda n: table(spark, sf_dir, n)
    levels = [
        ("l_orderkey", t("orders").where("o_orderpriority <> '5-LOW'"), "o_orderkey", {"o_orderstatus": "status", "o_custkey": "to_customer"}),
        ("to_customer", t("customer"), "c_custkey", {"c_name": "c_name", "c_nationkey": "to_nation"}),
        ("to_nation", t("nation"), "n_nationkey", {"n_name": "n_name"}),
    ]
    out = follow.follow_levels(t("lineitem").select("l_orderkey", "l_linenumber"), ["l_orderkey", "l_linenumber"], levels)
    return out.select("l_orderkey", "l_linenumber", "status", "c_name", "n_name")


@query("""
WITH l AS (SELECT o_custkey, list(o_orderkey ORDER BY o_orderkey DESC) AS links FROM orders GROUP BY o_custkey)
SELECT o_custkey, (SELECT list(l_suppkey || '/' || l_partkey ORDER BY pos, l_suppkey || '/' || l_partkey) FROM (SELECT unnest(links) AS k, generate_subscripts(links, 1) AS pos) JOIN lineitem ON l_orderkey = k WHERE l_linenumber = 1) AS first_lines FROM l""")
def detail_keep_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.sort_array(F.collect_list("o_orderkey"), asc=False).alias("links"))
    li = table(spark, sf_dir, "lineitem").where("l_linenumber = 1").select("l_orderkey", F.concat_ws("/", "l_suppkey", "l_partkey").alias("line"))
    got = follow.follow(o, ["o_custkey"], F.col("links"), li, "l_orderkey", ["line"], "namespace", "lines")
    return got.select("o_custkey", F.nullif(F.transform("lines", lambda x: x["line"]), F.array().cast("array<string>")).alias("first_lines"))


# aggregates --------------------------------------------------------------------------------------------------
@query("""
SELECT CASE event_type WHEN 'click' THEN 'gauge' WHEN 'view' THEN 'timer' ELSE 'counter' END AS kind, event_type AS name, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(28,6))) AS DOUBLE) AS total,
  min(value) AS least, max(value) AS most, round(CAST(sum(CAST(value AS DECIMAL(28,6))) AS DOUBLE) / count(*), 4) AS mean, arg_max(value, (ts, event_id)) AS last FROM events GROUP BY event_type""")
def metric_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("kind", F.when(F.col("event_type") == "click", "gauge").when(F.col("event_type") == "view", "timer").otherwise("other"))
    return quality.roll_up(e, "event_type", "kind", "value", ("ts", "event_id")).withColumn("mean", F.round("mean", 4))


@query("""
WITH l AS (SELECT kind, unnest([struct_pack(field := 'lang', empty := lang IS NULL OR lang = '', req := true), struct_pack(field := 'source', empty := source IS NULL OR source = '', req := false), struct_pack(field := 'text', empty := text IS NULL OR text = '', req := true)]) AS x FROM documents),
g AS (SELECT kind, x.field AS field, x.req AS req, count(*) AS total, count(*) FILTER (x.empty) AS empty FROM l GROUP BY ALL)
SELECT kind, field, total, total - empty AS non_empty, empty, round(empty / total, 4) AS empty_rate, CASE WHEN req AND empty = total THEN 'failed' WHEN (req AND empty > 0) OR round(empty / total, 4) >= 0.5 THEN 'warning' ELSE 'ok' END AS status FROM g""")
def field_quality_by_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.field_quality(table(spark, sf_dir, "documents"), ["lang", "source", "text"], ["lang", "text"], ["kind"])


@query("SELECT coalesce(source, 'none') AS source, count(*) AS n, min(doc_id) AS first_seen FROM documents GROUP BY ALL ORDER BY n DESC, first_seen LIMIT 5")
def top_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.top_values(table(spark, sf_dir, "documents").withColumn("source", F.coalesce("source", F.lit("none"))), "source", "doc_id")


@query("SELECT coalesce(content_type, 'unknown') AS content_type, count(*) AS n FROM http_responses GROUP BY ALL")
def count_by_content_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.count_by(table(spark, sf_dir, "http_responses"), "content_type")


@query("""
WITH w AS (SELECT user_id, CAST(count(*) AS DOUBLE) AS seen, CAST(count(*) FILTER (event_type = 'purchase') AS DOUBLE) AS bought FROM events GROUP BY user_id)
SELECT user_id, unnest(['seen', 'bought']) AS metric, unnest([seen, bought]) AS value FROM w""")
def metric_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("seen"), F.count_if(F.col("event_type") == "purchase").alias("bought"))
    return quality.metric_rows(w, ["user_id"], ["seen", "bought"])


# ordered calculus --------------------------------------------------------------------------------------------
@query("""
WITH n AS (SELECT event_id, user_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i FROM events)
SELECT event_id, user_id, CAST(greatest(0, max(t - i * 86400000000) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) + i * 86400000000 - t) AS BIGINT) AS wait_us FROM n""")
def rate_limit_wait(spark: SparkSession, sf_dir: str) -> DataFrame:
    return governance.rate_limit(table(spark, sf_dir, "events"), ["user_id"], "ts", 86_400_000_000, "event_id").select("event_id", "user_id", "wait_us")


@query("SELECT event_id, ['a', 'b', 'c'][CAST((row_number() OVER (ORDER BY event_id) - 1) % 3 + 1 AS INT)] AS proxy FROM events")
def round_robin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return governance.rotate(table(spark, sf_dir, "events").select("event_id"), ["a", "b", "c"], ["event_id"], "proxy")


@query("SELECT event_id, last_value(CASE WHEN event_type = 'view' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS referer FROM events")
def referer_before(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return governance.previous(e, ["user_id"], ["ts", "event_id"], F.when(F.col("event_type") == "view", F.col("event_id")), "referer").select("event_id", "referer")


@query("""
WITH x AS (SELECT event_type, event_id, ts AS t, 1 AS d FROM events UNION ALL SELECT event_type, event_id, ts + INTERVAL 1 HOUR, -1 FROM events),
r AS (SELECT event_type, sum(d) OVER (PARTITION BY event_type ORDER BY t, d, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS c FROM x)
SELECT event_type, CAST(max(c) AS BIGINT) AS peak FROM r GROUP BY event_type""")
def concurrency_peak(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return governance.concurrency_peak(e, ["event_type"], F.col("ts"), F.col("ts") + F.expr("interval 1 hour"), "event_id")


@query("SELECT event_id, round(least(0.5 * pow(2, event_id % 12), 30.0), 6) AS delay FROM events")
def backoff_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select("event_id", F.round(governance.backoff(F.col("event_id") % 12 + 1, 0.5, 30.0), 6).alias("delay"))


@query("""
WITH n AS (SELECT url, status_code BETWEEN 200 AND 299 AS ok, row_number() OVER (PARTITION BY url ORDER BY fetched_at, response_id) AS n FROM http_responses WHERE url IS NOT NULL)
SELECT url, coalesce(min(CASE WHEN ok THEN n END), max(n)) AS attempts, bool_or(ok) AS succeeded FROM n GROUP BY url""")
def attempt_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return governance.outcomes(table(spark, sf_dir, "http_responses").where("url is not null"), ["url"], ["fetched_at", "response_id"], governance.succeeded(F.col("status_code")))


@query("""
WITH r AS (SELECT *, sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS run FROM events)
SELECT event_id, CAST(sum(CASE WHEN event_type = 'purchase' THEN 0 ELSE 1 END) OVER (PARTITION BY user_id, run ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS failures FROM r""")
def failure_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return governance.failure_runs(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], F.col("event_type") == "purchase", 5).select("event_id", "failures")


@query("""
WITH t AS (SELECT event_id, ts AS t FROM events), c AS (SELECT event_id, t, unnest(generate_series(date_trunc('day', t), date_trunc('day', t) + INTERVAL 8 DAY, INTERVAL 1 DAY)) AS d FROM t),
m AS (SELECT event_id, t, d + to_minutes(x) AS due FROM c, (SELECT unnest([495, 525, 1215, 1245]) AS x) WHERE dayofweek(d) IN (1, 3, 5))
SELECT event_id, min(due) AS due FROM m WHERE due > date_trunc('minute', t) GROUP BY event_id""")
def cron_next_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("t"))
    return e.select("event_id", schedule.next_cron("15,45 8,20 * * 1,3,5", F.col("t")).cast("timestamp_ntz").alias("due"))


@query("""
SELECT o_orderkey, CAST(k AS BIGINT) AS run_no, o_orderdate + to_seconds(k * 3600 * (1 + o_orderkey % 5)) AS due FROM orders, range(1, 6) r(k)
WHERE k <= floor(epoch(TIMESTAMP '1998-08-02 00:00:00' - o_orderdate) / (3600 * (1 + o_orderkey % 5)))""")
def missed_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").withColumn("d", F.col("o_orderdate").cast("timestamp"))
    got = schedule.missed_runs(o, ["o_orderkey"], F.col("d"), F.lit("1998-08-02 00:00:00").cast("timestamp"), (3600 * (1 + F.col("o_orderkey") % 5)).cast("bigint"), 5)
    return got.withColumn("due", F.col("due").cast("timestamp_ntz"))


@query("""
SELECT o_orderkey AS job_id, o_custkey AS worker, row_number() OVER (PARTITION BY o_custkey ORDER BY CAST(left(o_orderpriority, 1) AS INT) DESC, CASE WHEN o_orderstatus = 'F' THEN NULL ELSE o_orderdate END NULLS FIRST, o_orderdate, o_orderkey) AS claim_no FROM orders
QUALIFY claim_no <= 3""")
def claim_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("job_id"), F.col("o_custkey").alias("worker"), F.substring("o_orderpriority", 1, 1).cast("int").alias("priority"), F.when(F.col("o_orderstatus") != "F", F.col("o_orderdate")).alias("run_after"), F.col("o_orderdate").alias("created_at"))
    return schedule.claim_order(o, F.lit("2999-01-01").cast("timestamp_ntz"), 3, ["worker"]).select("job_id", "worker", F.col("claim_no").cast("bigint").alias("claim_no"))


@query("""
SELECT s.status, count(o_orderkey) AS n, count(*) FILTER (o_orderdate <= TIMESTAMP '1995-01-01') AS due FROM (SELECT unnest(['F', 'O', 'P', 'X']) AS status) s LEFT JOIN orders ON o_orderstatus = s.status GROUP BY s.status""")
def queue_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("status"), F.col("o_orderdate").alias("run_after"))
    return schedule.queue_stats(o, ["F", "O", "P", "X"], F.lit("1995-01-01").cast("timestamp_ntz"))


# records as they leave ---------------------------------------------------------------------------------------
@query("""
SELECT c_custkey AS id, c_name AS person_name, '***REDACTED***' AS person_token, CAST(n_name AS VARCHAR) AS home_nation, '[' || c_nationkey || ', ' || n_regionkey || ']' AS codes FROM customer JOIN nation ON c_nationkey = n_nationkey""")
def export_flatten_redact(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    nested = c.select(
        F.col("c_custkey").alias("id"), F.struct(F.col("c_name").alias("name"), F.md5("c_name").alias("token")).alias("person"), F.struct(F.col("n_name").alias("nation")).alias("home"), F.array(F.col("c_nationkey"), F.col("n_regionkey")).alias("codes"), F.lit(1).alias("_dedup")
    )
    return shape.select_fields(shape.flatten(shape.redact(nested)), metadata=False)


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25 OFFSET 50")
def collection_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shape.page(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", True, 25, 50, "o_orderkey")


@query("SELECT count(*) AS total, 25 AS \"limit\", 50 AS \"offset\", 75 < count(*) AS has_more FROM orders")
def collection_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shape.page_info(table(spark, sf_dir, "orders"), 25, 50)


@query("""
SELECT id AS event_key, created FROM (SELECT event_id AS id, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS created, event_type FROM events) WHERE event_type = 'view' AND created >= '2024-01-05' AND created <= '2024-01-20T12:00:00'""")
def collection_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("event_key"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("created_at"), "event_type")
    return shape.matches(e, {"event_type": "view"}, "2024-01-05", "2024-01-20T12:00:00").select("event_key", F.col("created_at").alias("created"))


@query("""
WITH d AS (SELECT DISTINCT event_id, target_type, target_id, event_type, reason, feed_no FROM lifecycle_events)
SELECT target_type, count(*) AS deliveries, count(DISTINCT event_id) AS events, round((count(*) - count(DISTINCT event_id)) / count(*), 4) AS duplicate_rate FROM d GROUP BY target_type""")
def delivery_duplicate_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "lifecycle_events").select("event_id", "target_type", "target_id", "event_type", "reason", "feed_no").distinct()
    per = d.groupBy("target_type", "event_id").agg(F.count("*").alias("n")).groupBy("target_type").agg(F.sum("n").alias("deliveries"), F.count("*").alias("events"))
    return per.select("target_type", "deliveries", "events", quality.duplicate_rate(F.col("deliveries") - F.col("events"), F.col("deliveries")).alias("duplicate_rate"))


@query("""
WITH w AS (SELECT user_id, event_type, CAST(sum(CAST(value AS DECIMAL(28,6))) AS DOUBLE) AS v FROM events GROUP BY ALL)
SELECT user_id, coalesce(max(v) FILTER (event_type = 'view'), 0.0) AS "view", coalesce(max(v) FILTER (event_type = 'click'), 0.0) AS click, coalesce(max(v) FILTER (event_type = 'none'), 0.0) AS "none" FROM w GROUP BY user_id""")
def counters_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.counters_wide(table(spark, sf_dir, "events"), ["user_id"], "event_type", "value", ["view", "click", "none"])


@query("SELECT event_id, user_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 20")
def newest_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return governance.newest(table(spark, sf_dir, "events").select("event_id", "user_id", "ts"), ["user_id"], ["ts", "event_id"], 20).select("event_id", "user_id")


@query("""
WITH n AS (SELECT event_id, user_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i FROM events),
w AS (SELECT user_id, greatest(0, max(t - i * 3600000000) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) + i * 3600000000 - t) AS wait FROM n)
SELECT user_id, count(*) FILTER (wait > 0) AS delays, CAST(sum(wait) AS BIGINT) AS wait_total FROM w GROUP BY user_id""")
def rate_wait_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return governance.waiting(governance.rate_limit(table(spark, sf_dir, "events"), ["user_id"], "ts", 3_600_000_000, "event_id"), ["user_id"], "wait_us")


@query("""
SELECT o_orderkey AS job_id, CASE WHEN o_orderdate <= TIMESTAMP '1995-01-01' THEN CASE WHEN o_orderkey % 4 < 3 THEN 'queued' ELSE 'dead_letter' END ELSE 'leased' END AS status,
  CASE WHEN o_orderdate > TIMESTAMP '1995-01-01' THEN o_orderdate END AS lease_until FROM orders""")
def requeue_expired(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("job_id"), F.lit("leased").alias("status"), F.col("o_orderdate").alias("lease_until"), (F.col("o_orderkey") % 4).alias("attempt"), F.lit(3).alias("max_attempts"))
    return schedule.requeue(o, F.lit("1995-01-01").cast("timestamp_ntz")).select("job_id", "status", "lease_until")


@query("""SELECT o_orderkey, CAST('0x' || substr(sha256('job-' || o_custkey || ':' || strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S+00:00')), 1, 8) AS BIGINT) % 301 AS jitter FROM orders""")
def schedule_jitter(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.concat(F.lit("job-"), F.col("o_custkey").cast("string"))
    return table(spark, sf_dir, "orders").select("o_orderkey", hashing.jitter_seconds(key, F.col("o_orderdate").cast("timestamp"), 300).alias("jitter"))


@query("""
SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN o_orderdate + to_seconds(CAST(60 * (1 + o_orderkey % 7) AS BIGINT)) WHEN o_orderstatus = 'O' THEN o_orderdate ELSE TIMESTAMP '2000-01-01' + to_seconds(CAST(60 * (1 + o_orderkey % 7) AS BIGINT)) END AS due FROM orders""")
def interval_next_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("o_orderdate").cast("timestamp")
    due = schedule.next_interval(F.when(F.col("o_orderstatus") == "F", d), F.when(F.col("o_orderstatus") == "O", d), F.lit("2000-01-01").cast("timestamp"), 60 * (1 + F.col("o_orderkey") % 7))
    return table(spark, sf_dir, "orders").select("o_orderkey", due.cast("timestamp_ntz").alias("due"))


@query("""
SELECT doc_id, coalesce(nullif(regexp_replace(regexp_replace(coalesce(source, '') || '/' || kind || ' ' || doc_id, '[^A-Za-z0-9._-]+', '-', 'g'), '^[.-]+|[.-]+$', '', 'g'), ''), 'item') AS name FROM documents""")
def safe_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.coalesce("source", F.lit("")), F.lit("/"), "kind", F.lit(" "), F.col("doc_id").cast("string"))
    return table(spark, sf_dir, "documents").select("doc_id", transforms.safe_name(text).alias("name"))


@query("""
SELECT event_id, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS from_state, event_type AS to_state FROM events
QUALIFY from_state IS NOT NULL AND from_state <> to_state AND NOT (from_state = 'view' AND to_state IN ('click', 'purchase')) AND NOT (from_state = 'click' AND to_state = 'view')""")
def illegal_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = schedule.illegal_moves(table(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "event_type", {"view": ["click", "purchase"], "click": ["view"]})
    return got.select("event_id", "from_state", "to_state")


@query("""
SELECT response_id, status_code, CASE WHEN status_code IS NULL THEN 'network' WHEN status_code BETWEEN 200 AND 299 THEN NULL ELSE 'http_status' END AS error_type, coalesce(status_code IN (500, 503), false) AS retryable,
  coalesce(status_code = 200 AND contains(body, '<p>') AND NOT contains(body, 'Sign up'), false) AS as_it_should FROM http_responses""")
def response_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.col("status_code")
    error = F.when(status.isNull(), "network").when(~governance.succeeded(status), "http_status")
    checks = governance.response_checks(status, F.col("body"), [200], "<p>", "Sign up")
    return table(spark, sf_dir, "http_responses").select("response_id", "status_code", error.alias("error_type"), governance.retryable(error, status, ["http_status"], [500, 503]).alias("retryable"), checks.alias("as_it_should"))


@query("""
WITH u AS (SELECT url, min(pos) AS pos FROM (SELECT url, response_id AS pos FROM http_responses WHERE url IS NOT NULL UNION ALL SELECT url, 10000000 + doc_id FROM documents WHERE url IS NOT NULL) GROUP BY url)
SELECT url, pos FROM u""")
def seeds_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftline.sources import seeds

    a = table(spark, sf_dir, "http_responses").where("url is not null").select("url", F.col("response_id").alias("pos"))
    b = table(spark, sf_dir, "documents").where("url is not null").select("url", (F.col("doc_id") + 10_000_000).alias("pos"))
    return seeds.distinct_in_order(a.unionByName(b), "url", "pos")


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(28,6))) AS DOUBLE) AS total FROM events GROUP BY ALL")
def hourly_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from weftline.streaming import incremental as streams

    got = streams.windows(table(spark, sf_dir, "events"), "ts", "1 hour", ["event_type"], "value")
    return got.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total")


@query("""
WITH p AS (SELECT response_id, regexp_extract(body, '(?s)<title>(.*?)</title>', 1) AS title, len(regexp_extract_all(body, '<a href')) AS links FROM http_responses WHERE body IS NOT NULL)
SELECT response_id, title, links FROM p WHERE title <> ''""")
def title_and_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "http_responses").where("body is not null")
    title = transforms.regex_extract(F.col("body"), r"<title>(.*?)</title>")
    return r.select("response_id", title.alias("title"), F.size(transforms.regex_all(F.col("body"), "<a href")).cast("bigint").alias("links")).where("title <> ''")


@query()
def html_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headlines and link targets by selectors, every page parsed once; checked by tests."""
    from weftline.functions import htmlquery

    rules = {"headline": {"selector": "h1"}, "links": {"selector": "a", "attribute": "href"}, "cells": {"xpath": "//td"}}
    return htmlquery.extract(table(spark, sf_dir, "http_responses"), "response_id", "body", rules)


@query()
def json_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths with lists over all payloads; checked by tests."""
    return jsonpath.values(table(spark, sf_dir, "records"), ["id"], "payload_json", {"thumbs": "thumbnails[].fileUrl", "amounts": "offers[].prices[].amount", "author": "detail.author.name", "tag": "tags[0]"})


def _stored_job(spark: SparkSession, sf_dir: str):
    """Run of a whole job over the stored responses: every address of the table is a seed, in order of response_id.

    A page fetched again is a further attempt: the answer to an address is its earliest stored success with a body,
    else its earliest response. Answers stand under the normal form of their address, under which the job asks.
    """
    from weftline.plans import engine, job
    from weftline.sources import seeds

    config = job.load({
        "id": "stored", "seed": {"type": "table", "source": "http_responses"}, "fields": [{"name": "headline", "selector": "h1", "transforms": ["normalize_space"], "default": "none"}, {"name": "first_link", "type": "attribute", "selector": "a", "attribute": "href"}],
        "dedup": {"enabled": True, "keys": ["headline"]}, "crawl_policy": {"enabled": True, "max_requests": 1 << 60, "allowed_domains": ["example"]},
    })
    r = table(spark, sf_dir, "http_responses").where("url is not null")
    failed = ~F.coalesce(governance.succeeded(F.col("status_code")) & F.col("body").isNotNull(), F.lit(False))
    answers = r.select(urls.normalize(transforms.strip(F.col("url"))).alias("url"), "status_code", "body", "response_id", failed.alias("failed"))
    pages = incremental.first_by(answers, ["url"], ["failed", "response_id"]).select("url", "status_code", "body")
    return engine.run(spark, config, pages, starts=seeds.of_table(r, "url", "response_id"))


@query()
def job_over_stored_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of a whole job over the stored responses: seeds, scope, status, extraction, defaults, transforms,
    repeats. The job has no pagination and no details."""
    return _stored_job(spark, sf_dir).records.select("headline", "first_link", "source_url", "unique_hash")


@query("""
WITH r AS (SELECT url, status_code FROM http_responses WHERE url IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY url ORDER BY coalesce(status_code BETWEEN 200 AND 299 AND body IS NOT NULL, false) DESC, response_id) = 1)
SELECT url, CASE WHEN NOT regexp_matches(lower(url), '^[^:]+://([^/?#]*[.])?example(:[0-9]+)?([/?#]|$)') THEN 'policy' WHEN status_code IS NULL THEN 'network' ELSE 'http_status' END AS error_type
FROM r WHERE error_type = 'policy' OR status_code IS NULL OR status_code NOT BETWEEN 200 AND 299""")
def job_rejects_of_stored_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses of the same job that gave no record because of scope, status or a rule."""
    out = _stored_job(spark, sf_dir)
    blocked = out.decisions.where("not allowed").select(F.col("normalized_url").alias("url"), F.lit("policy").alias("error_type"))
    return blocked.unionByName(out.rejects)


# jobs over pages made of tables ------------------------------------------------------------------------------
def _order_pages(spark: SparkSession, sf_dir: str, link: str) -> tuple[DataFrame, DataFrame]:
    """Start addresses and answers of an interface that gives the orders of a customer four at a time.

    ``link`` says how an answer's address counts: ``page``, ``offset`` or ``cursor`` (which answers name themselves).
    """
    from pyspark.sql import Window

    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")  # a customer's orders, some tens
    numbered = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", F.floor((F.row_number().over(w) - 1) / 4).alias("no"))
    held = numbered.groupBy("o_custkey", "no").agg(F.array_sort(F.collect_list(F.struct(F.col("o_orderkey").alias("key"), F.col("o_orderstatus").alias("status")))).alias("items"))
    last = held.groupBy("o_custkey").agg(F.max("no").alias("last"))
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"))
    known = customers.join(last, "o_custkey", "left").select("o_custkey", F.coalesce("last", F.lit(-1)).alias("last"))
    # one page more than there are orders for: it is empty
    pages = known.select("o_custkey", "last", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("last") + 1)).alias("no")).join(held, ["o_custkey", "no"], "left")
    base = F.concat(F.lit("https://api.example/orders?cust="), F.col("o_custkey"))
    value = {"page": F.col("no") + 1, "offset": F.col("no") * 4, "cursor": F.concat(F.lit("c"), F.col("no"))}[link]
    url = F.when(F.col("no") == 0, base).otherwise(F.concat(base, F.lit(f"&{link}="), value.cast("string")))
    nxt = F.when(F.col("no") < F.col("last"), F.concat(F.lit("c"), F.col("no") + 1))
    body = F.to_json(F.struct(F.struct(F.coalesce("items", F.array()).alias("items")).alias("data"), nxt.alias("next")))
    return customers.select(F.concat(F.lit("https://api.example/orders?cust="), F.col("o_custkey")).alias("url"), F.col("o_custkey").alias("pos")), pages.select(url.alias("url"), F.lit(200).alias("status_code"), body.alias("body"))


def _paged_job(spark: SparkSession, sf_dir: str, kind: str, options: dict) -> DataFrame:
    from weftline.plans import engine, job

    starts, pages = _order_pages(spark, sf_dir, kind)
    config = job.load({
        "id": f"orders-{kind}", "type": "api", "start_urls": ["https://api.example/"], "items_json_path": "data.items", "pagination": {"type": kind, "max_pages": 3, **options},
        "fields": [{"name": "key", "type": "json_path", "json_path": "key", "transforms": ["int"]}, {"name": "status", "type": "json_path", "json_path": "status"}],
    })
    return engine.run(spark, config, pages, starts=starts).records.select(F.col("pos").alias("customer"), "page_index", "item_pos", "key", "status")


_PAGED_SQL = """
WITH n AS (SELECT o_custkey, o_orderkey, o_orderstatus, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS i FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer))
SELECT o_custkey AS customer, CAST(i // 4 + 1 AS INTEGER) AS page_index, CAST(i % 4 AS INTEGER) AS item_pos, o_orderkey AS key, o_orderstatus AS status FROM n WHERE i < 12"""


@query(_PAGED_SQL)
def job_numbered_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A job whose pages are numbered, up to three a start address."""
    return _paged_job(spark, sf_dir, "page", {"page_param": "page"})


@query(_PAGED_SQL)
def job_offset_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A job whose pages begin at an offset."""
    return _paged_job(spark, sf_dir, "offset", {"offset_param": "offset", "page_size": 4})


@query(_PAGED_SQL)
def job_cursor_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A job whose answers name the cursor of the next one."""
    return _paged_job(spark, sf_dir, "cursor", {"page_param": "cursor", "cursor_json_path": "next"})


@query("""
WITH v AS (SELECT DISTINCT id, name, playlists FROM peertube_public_videos WHERE id IS NOT NULL),
p AS (SELECT id, name, unnest(playlists) AS e, generate_subscripts(playlists, 1) - 1 AS i FROM v)
SELECT id, CAST(row_number() OVER (PARTITION BY id, name ORDER BY i) - 1 AS INTEGER) AS child_pos, upper(nullif(e.label, '')) AS label, len(list_filter(list_transform(coalesce(e.files, []), lambda f: f.height), lambda h: h IS NOT NULL)) AS heights
FROM p""")
def children_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Child records: the playlists of every video, each with its label and the heights of its files."""
    from weftline.plans import engine

    columns = ("id", "name", "playlists")
    videos = table(spark, sf_dir, "peertube_public_videos").where("id is not null").select(*columns).distinct()
    bodies = videos.select(F.monotonically_increasing_id().cast("string").alias("url"), F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).alias("body"))
    rules = [
        {"name": "id", "type": "json_path", "json_path": "id", "transforms": ["int"]},
        {"name": "playlists", "type": "json_path", "json_path": "playlists", "many": True, "children": [{"name": "label", "type": "json_path", "json_path": "label", "transforms": ["upper"]}, {"name": "heights", "type": "json_path", "json_path": "files[].height", "many": True}]},
    ]
    raw = engine.extract(bodies, {"fields": rules})
    got, _ = engine.project(raw, rules, ["url"], F.col("url"))
    flat = got.select("id", F.posexplode("playlists").alias("child_pos", "c"))
    return flat.select("id", "child_pos", F.col("c.label").alias("label"), F.coalesce(F.size("c.heights"), F.lit(0)).cast("bigint").alias("heights"))


@query("""
SELECT p_brand AS brand, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS INTEGER) AS n, 'https://shop.example/part/' || p_partkey AS link,
  array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1:1]) || lower(w[2:])), ' ') AS title FROM part""")
def many_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists of links made absolute, and of texts in title case: one page of parts per brand."""
    from weftline.plans import engine

    item = F.concat(F.lit('<li><a href="../part/'), F.col("p_partkey"), F.lit('">'), F.col("p_name"), F.lit("</a></li>"))
    pages = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.array_sort(F.collect_list(F.struct(F.col("p_partkey").alias("k"), item.alias("x")))).alias("xs"))
    pages = pages.select(F.concat(F.lit("https://shop.example/list/"), F.col("p_brand")).alias("url"), F.concat(F.lit("<ul>"), F.array_join(F.transform("xs", lambda e: e["x"]), ""), F.lit("</ul>")).alias("body"))
    rules = [{"name": "links", "type": "attribute", "selector": "li a", "attribute": "href", "many": True, "transforms": ["urljoin", "canonical_url"]}, {"name": "titles", "selector": "li a", "many": True, "transforms": ["title"]}]
    got, _ = engine.project(engine.extract(pages, {"fields": rules}), rules, ["url"], F.col("url"))
    return got.select(F.substring_index("url", "/", -1).alias("brand"), F.posexplode(F.arrays_zip("links", "titles")).alias("n", "x")).select("brand", "n", F.col("x.links").alias("link"), F.col("x.titles").alias("title"))


# the whole vocabulary of transforms --------------------------------------------------------------------------
_TEXT = "concat('  ', p_name, ', ', p_brand, ',, ', p_type, '\\t')"


@query("""
SELECT p_partkey, trim(p_name) AS stripped, lower(p_brand) AS low, upper(p_name) AS up, p_size AS whole, CAST(p_retailprice AS DOUBLE) AS number, length(p_name) AS n,
  CASE WHEN p_size > 25 THEN 'big' ELSE 'small' END AS filled, replace(p_name, ' ', '_') AS underscored, 'https://' || p_brand || '.example/a' AS schemed, CASE WHEN suffix(p_type, 'L') THEN p_type[:-2] ELSE p_type END AS shortened FROM part""")
def transform_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transforms of single values."""
    run = lambda c, *chain: transforms.apply_chain(c, list(chain))[0]
    p = table(spark, sf_dir, "part")
    return p.select(
        "p_partkey", run(F.concat(F.lit(" \t"), "p_name", F.lit("\n ")), "strip").alias("stripped"), run(F.col("p_brand"), "lower").alias("low"), run(F.col("p_name"), "upper").alias("up"), run(F.concat(F.lit("size "), "p_size", F.lit(" cm")), "int").cast("int").alias("whole"),
        run(F.concat(F.lit("USD "), F.col("p_retailprice").cast("string")), "float").alias("number"), run(F.col("p_name"), "length").cast("bigint").alias("n"), run(F.when(F.col("p_size") > 25, "big").otherwise(""), {"type": "default_if_empty", "value": "small"}).alias("filled"),
        run(F.col("p_name"), {"type": "replace", "pattern": " ", "replacement": "_"}).alias("underscored"), run(F.concat(F.lit("//"), "p_brand", F.lit(".example/a")), "ensure_scheme").alias("schemed"), run(F.col("p_type"), {"type": "remove_suffix", "value": "L"}).alias("shortened"),
    )


@query("""
SELECT p_partkey, p_name AS first, p_type AS last, p_brand AS second, p_brand AS before_last, 'none' AS beyond, p_name || '|' || p_brand || '|' || p_type AS joined, lower(p_name) || ';' || lower(p_brand) || ';' || lower(p_type) AS field_joined FROM part""")
def transform_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transforms of lists, and the joining that a field asks for."""
    run = lambda *chain, **more: transforms.apply_chain(F.expr(_TEXT), ["split", *chain], **more)[0]
    at = lambda i: {"type": "list_index", "index": i, "default": "none"}
    return table(spark, sf_dir, "part").select(
        "p_partkey", run("first").alias("first"), run("last").alias("last"), run(at(1)).alias("second"), run(at(-2)).alias("before_last"), run(at(9)).alias("beyond"), run({"type": "join", "value": "|"}).alias("joined"), run("lower", join_with=";").alias("field_joined")
    )


# targets and what may be done with them ----------------------------------------------------------------------
@query("""
WITH e AS (SELECT DISTINCT target_type, target_id, event_id, lower(trim(to_status)) AS status FROM lifecycle_events WHERE event_id IS NOT NULL AND target_id IS NOT NULL AND to_status IS NOT NULL)
SELECT target_type, target_id, count(DISTINCT event_id) AS n_events, count(DISTINCT event_id) FILTER (status IN ('failed', 'cancelled')) AS ended_badly, bool_or(status IN ('failed', 'cancelled')) AS may_retry FROM e GROUP BY ALL""")
def retry_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets with the number of events that ended badly: those a retry may start from."""
    status = F.lower(F.trim("to_status"))
    bad = status.isin("failed", "cancelled")
    e = table(spark, sf_dir, "lifecycle_events").where("event_id is not null and target_id is not null and to_status is not null")
    return e.groupBy("target_type", "target_id").agg(F.count_distinct("event_id").alias("n_events"), F.count_distinct(F.when(bad, F.col("event_id"))).alias("ended_badly"), F.bool_or(bad).alias("may_retry"))


@query("""
SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN 'skipped_local' WHEN p_size % 3 = 0 THEN 'unavailable' WHEN p_size % 2 = 0 THEN 'disallowed' ELSE 'allowed' END AS robots, p_size % 5 <> 0 AND p_size % 3 <> 0 AND p_size % 2 = 0 AS blocked FROM part""")
def robots_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Robots rules of two hosts against an address per part: local hosts are not asked, a host without rules is let through."""
    host = F.when(F.col("p_size") % 5 == 0, "localhost").when(F.col("p_size") % 3 == 0, "unknown.example").otherwise("shop.example")
    path = F.when(F.col("p_size") % 2 == 0, "/private/").otherwise("/open/")
    asked = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.lit("https://"), host, path, F.col("p_partkey").cast("string")).alias("url"))
    limits = policy.Policy(max_requests=1 << 60, cross_domain=True, robots={"shop.example": "User-agent: *\nDisallow: /private/", "other.example": "User-agent: *\nDisallow: /"}, robots_enabled=True, robots_block=True)
    return policy.decide(asked, "url", limits, ["p_partkey"]).select("p_partkey", "robots", (~F.col("allowed")).alias("blocked"))
