"""Stored collections: JSON lines, logs, metrics, traces and their integrity."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Spellings of collection names.
SCOPES = {"tasks": "task", "jobs": "job", "workers": "worker", "worker_jobs": "job", "schedules": "schedule", "scheduler": "schedule", "scheduler_runs": "scheduler_run", "runs": "scheduler_run"}


def json_lines(spark: SparkSession, path: str, schema: str, strict: bool = True) -> DataFrame:
    """Records of JSON lines; corrupt lines raise an error, or are left out."""
    return spark.read.schema(schema).json(path, mode="FAILFAST" if strict else "DROPMALFORMED")


def corrupt_lines(spark: SparkSession, path: str) -> DataFrame:
    """``file, line`` of lines that are no JSON."""
    text = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("line"))
    return text.where((F.trim("line") != "") & F.try_parse_json("line").isNull())


def integrity(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """``entity, n_lines, n_corrupt`` of JSON-lines collections."""
    parts = [
        spark.read.text(p).where(F.trim("value") != "").agg(F.count("*").alias("n_lines"), F.count_if(F.try_parse_json("value").isNull()).alias("n_corrupt")).select(F.lit(name).alias("entity"), "n_lines", "n_corrupt")
        for name, p in paths.items()
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def scan_logs(logs: DataFrame, scope: str | None = None, target: str | None = None, level: str | None = None, ids: tuple[str, ...] = ("task_id", "job_id", "schedule_id", "scheduler_run_id", "spider_id")) -> DataFrame:
    """Log rows of a scope and target; without a scope the target may be any of the ids. A level is matched as it is."""
    if scope:
        logs = logs.where(F.col("scope") == SCOPES.get(scope, scope))
        logs = logs.where(F.col("target_id") == target) if target else logs
    elif target:
        logs = logs.where(F.array_contains(F.array(*[F.col(c) for c in ids if c in logs.columns]), target))
    return logs.where(F.col("level") == level.upper()) if level else logs


def at_least(level: str):
    """Predicate of rows of a level or above; unknown levels count as INFO."""
    rank = {"DEBUG": 10, "INFO": 20, "WARNING": 30, "ERROR": 40}
    col = F.lit(20)
    for name, r in rank.items():
        col = F.when(F.upper("level") == name, r).otherwise(col)
    return col >= rank.get(level.upper(), 20)


def page(df: DataFrame, order: list[str], limit: int | None = None, offset: int = 0) -> DataFrame:
    """Rows in order, from ``offset``, ``limit`` at most."""
    out = df.orderBy(*order).offset(offset)
    return out if limit is None else out.limit(limit)
