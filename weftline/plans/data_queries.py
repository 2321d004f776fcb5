"""Queries of the general data problems: change feed (p2), nested records (p4), drifting schemas (p5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators import changefeed, drift, nested
from weftline.shared import materialize, table


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feed of the table is closed: what a gap holds is released at its end."""
    return changefeed.replay(table(spark, sf_dir, "lifecycle_events"))


def p2_open(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same feed while it is open: targets after the events up to the first gap."""
    return changefeed.replay(table(spark, sf_dir, "lifecycle_events"), closed=False)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The keys of all element tables. The tables are written with foreign keys and inlined values first: of a plan that
    ends in the keys alone, Catalyst would leave out what makes the rest. Rows without a parent, which shared inlining
    never makes, would not be rows."""
    tables = materialize(_elements(spark, sf_dir), "elements")
    return tables.where("parent_path is not null").select("origin", "record_key", "path", "pos")


def _elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Element rows of both tables, with foreign keys and inlined values."""
    records = nested.json_elements(table(spark, sf_dir, "records"), "id", "payload_json")
    videos = nested.struct_elements(table(spark, sf_dir, "peertube_public_videos"), "id")
    return videos.select(F.lit("peertube_public_videos").alias("origin"), "*").unionByName(records.select(F.lit("records").alias("origin"), "*"))


def p4_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The schema graph of both tables: every table that shared inlining makes, its parent, columns and rows."""
    found = _elements(spark, sf_dir)
    parts = [nested.schema_graph(found.where(F.col("origin") == o).drop("origin")).select(F.lit(o).alias("origin"), "*") for o in ("peertube_public_videos", "records")]
    return parts[0].unionByName(parts[1])


def p4_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``origin, path, parent_path, n_rows, n_parents``: rows of each element table and the parents they point to."""
    found = _elements(spark, sf_dir)
    return found.groupBy("origin", "path", "parent_path").agg(F.count("*").alias("n_rows"), F.count_distinct("record_key", "parent_pos").alias("n_parents"))


def _drift(spark: SparkSession, sf_dir: str, detailed: bool = False) -> DataFrame:
    return drift.drift(
        drift.observe(table(spark, sf_dir, "records"), "records", "spider_id", "batch_no", "payload_json"),
        drift.observe(table(spark, sf_dir, "spiders"), "spiders", "id", "revision", "config_json"),
        detailed=detailed,
    )


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _drift(spark, sf_dir).select(*drift.FILE, "change_kind", "field", "old_field")


def p5_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The version of the schema that each file of a spider has."""
    every = drift.observe(table(spark, sf_dir, "records"), "records", "spider_id", "batch_no", "payload_json").unionByName(drift.observe(table(spark, sf_dir, "spiders"), "spiders", "id", "revision", "config_json"))
    return drift.versions(drift.file_fields(every.where("print is not null")))


def p5_unified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All records and configurations under the newest schema of their spider."""
    found = materialize(_drift(spark, sf_dir, detailed=True), "drift-found")
    records = drift.unify(table(spark, sf_dir, "records").withColumn("record_key", F.col("id").cast("string")), found, "records", "spider_id", "batch_no", "payload_json", ("record_key",))
    spiders = drift.unify(table(spark, sf_dir, "spiders").withColumn("record_key", F.col("id").cast("string")), found, "spiders", "id", "revision", "config_json", ("record_key",))
    return records.select(F.lit("records").alias("origin"), "*").unionByName(spiders.select(F.lit("spiders").alias("origin"), "*"))


QUERIES = {"p2_found": p2_found, "p2_open": p2_open, "p4_found": p4_found, "p4_graph": p4_graph, "p4_links": p4_links, "p5_found": p5_found, "p5_unified": p5_unified, "p5_versions": p5_versions}

_INSTANT = r"""CASE WHEN regexp_full_match(trim(created_at), '\d{1,15}') THEN make_timestamp(CAST(trim(created_at) AS BIGINT) * 1000)
  WHEN regexp_full_match(trim(created_at), '\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(\.\d+)?') THEN TRY_CAST(trim(created_at) AS TIMESTAMP)
  WHEN regexp_full_match(trim(created_at), '\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(\.\d+)?Z') THEN TRY_CAST(replace(trim(created_at), 'Z', '') AS TIMESTAMP)
  WHEN regexp_full_match(trim(created_at), '\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(\.\d+)?[+-]\d{2}:\d{2}') THEN
    TRY_CAST(left(trim(created_at), length(trim(created_at)) - 6) AS TIMESTAMP)
    - to_minutes(CAST(CASE WHEN substr(trim(created_at), length(trim(created_at)) - 5, 1) = '-' THEN -1 ELSE 1 END
      * (CAST(substr(trim(created_at), length(trim(created_at)) - 4, 2) AS INT) * 60 + CAST(right(trim(created_at), 2) AS INT)) AS BIGINT)) END"""

SQL = {
    "p2_found": f"""
WITH e AS (SELECT event_id, target_type, target_id, lower(trim(event_type)) AS kind, lower(trim(to_status)) AS status, {_INSTANT} AS instant, feed_no FROM lifecycle_events),
once AS (SELECT * FROM e WHERE instant IS NOT NULL AND target_type IS NOT NULL AND target_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY feed_no) = 1),
seq AS (SELECT *, row_number() OVER (PARTITION BY target_type, target_id ORDER BY instant, event_id) AS n FROM once),
base AS (SELECT target_type, target_id, max(n) AS n, arg_max(kind, n) AS kind, arg_max(coalesce(status, chr(0)), n) AS status FROM seq WHERE kind IN ('created', 'enqueued', 'deleted', 'purged') GROUP BY ALL),
later AS (SELECT b.target_type, b.target_id, arg_max(s.status, s.n) AS status FROM base b JOIN seq s ON s.target_type = b.target_type AND s.target_id = b.target_id
  WHERE s.n > b.n AND s.status IS NOT NULL AND s.kind NOT IN ('created', 'enqueued', 'deleted', 'purged') GROUP BY ALL)
SELECT b.target_type, b.target_id, coalesce(l.status, nullif(b.status, chr(0))) AS to_status
FROM base b LEFT JOIN later l ON l.target_type = b.target_type AND l.target_id = b.target_id
WHERE b.kind IN ('created', 'enqueued')""",
    "p4_links": r"""
WITH once AS (SELECT DISTINCT id, payload_json FROM records WHERE json_valid(payload_json)),
parsed AS (SELECT id AS rid, CASE WHEN json_type(payload_json) = 'VARCHAR' THEN json_extract_string(payload_json, '$') ELSE payload_json END AS j FROM once),
tree AS (SELECT rid, t.fullkey AS k, regexp_extract(t.fullkey, '^(.*\])[^\]]*\[\d+\]$', 1) AS up FROM parsed, json_tree(j) t WHERE json_valid(j) AND t.type = 'OBJECT' AND suffix(t.fullkey, ']')),
named AS (SELECT rid, regexp_replace(regexp_replace(k, '\[\d+\]', '', 'g'), '^\$\.?', '') AS path, regexp_replace(regexp_replace(up, '\[\d+\]', '', 'g'), '^\$\.?', '') AS parent_path, up FROM tree),
v AS (SELECT DISTINCT id, thumbnails, playlists FROM peertube_public_videos),
th AS (SELECT id, unnest(thumbnails) AS e FROM v), pl AS (SELECT id, unnest(playlists) AS e, generate_subscripts(playlists, 1) AS i FROM v),
fl AS (SELECT id, i, unnest(e.files) AS f FROM pl WHERE e IS NOT NULL)
SELECT 'records' AS origin, path, parent_path, count(*) AS n_rows, count(DISTINCT rid || ' ' || up) AS n_parents FROM named GROUP BY ALL
UNION ALL SELECT 'peertube_public_videos', 'thumbnails', '', count(*), count(DISTINCT id) FROM th WHERE e IS NOT NULL HAVING count(*) > 0
UNION ALL SELECT 'peertube_public_videos', 'playlists', '', count(*), count(DISTINCT id) FROM pl WHERE e IS NOT NULL HAVING count(*) > 0
UNION ALL SELECT 'peertube_public_videos', 'playlists.files', 'playlists', count(*), count(DISTINCT (id, i)) FROM fl WHERE f IS NOT NULL HAVING count(*) > 0""",
    "p4_found": r"""
WITH once AS (SELECT DISTINCT id, payload_json FROM records WHERE json_valid(payload_json)),
parsed AS (SELECT id AS rid, CASE WHEN json_type(payload_json) = 'VARCHAR' THEN json_extract_string(payload_json, '$') ELSE payload_json END AS j FROM once),
tree AS (SELECT rid, t.fullkey AS k FROM parsed, json_tree(j) t WHERE json_valid(j) AND t.type = 'OBJECT' AND suffix(t.fullkey, ']')),
v AS (SELECT DISTINCT id, thumbnails, playlists FROM peertube_public_videos),
th AS (SELECT id, unnest(thumbnails) AS e, generate_subscripts(thumbnails, 1) - 1 AS i FROM v),
pl AS (SELECT id, unnest(playlists) AS e, generate_subscripts(playlists, 1) - 1 AS i FROM v),
fl AS (SELECT id, i, unnest(e.files) AS f, generate_subscripts(e.files, 1) - 1 AS k FROM pl WHERE e IS NOT NULL)
SELECT 'records' AS origin, rid AS record_key, regexp_replace(regexp_replace(k, '\[\d+\]', '', 'g'), '^\$\.?', '') AS path, array_to_string(regexp_extract_all(k, '\[(\d+)\]', 1), '.') AS pos FROM tree
UNION ALL SELECT 'peertube_public_videos', CAST(id AS VARCHAR), 'thumbnails', CAST(i AS VARCHAR) FROM th WHERE e IS NOT NULL
UNION ALL SELECT 'peertube_public_videos', CAST(id AS VARCHAR), 'playlists', CAST(i AS VARCHAR) FROM pl WHERE e IS NOT NULL
UNION ALL SELECT 'peertube_public_videos', CAST(id AS VARCHAR), 'playlists.files', i || '.' || k FROM fl WHERE f IS NOT NULL""",
}

_FIRST_GAP = "(SELECT min(feed_no) FROM lifecycle_events a WHERE feed_no IS NOT NULL AND NOT EXISTS (SELECT 1 FROM lifecycle_events b WHERE b.feed_no = a.feed_no + 1))"
# the delivery that stands for a transaction is its first readable one, whether it is committed or held
SQL["p2_open"] = SQL["p2_found"].replace("BY feed_no) = 1),", f"BY feed_no) = 1 AND feed_no <= {_FIRST_GAP}),")
