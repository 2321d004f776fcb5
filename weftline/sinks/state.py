"""State tables: hash index, high-water marks, checkpoints, reports; each change is a new version of a few rows.

A version is a folder; the newest row of a key counts. A run's results, hashes and mark are written under its
run number first and become visible by one small commit file, so a run that dies leaves nothing half done and a
repeated run replaces its own version.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


class State:
    """Versioned tables below a folder."""

    def __init__(self, spark: SparkSession, home: str) -> None:
        self.spark, self.home = spark, home.rstrip("/")

    def commits(self) -> list[int]:
        """Numbers of committed runs."""
        path = f"{self.home}/commits"
        if not _exists(self.spark, path):
            return []
        return sorted(json.loads(r.value)["run"] for r in self.spark.read.text(path).collect())  # one line a run

    def read(self, table: str, schema: str) -> DataFrame:
        """Rows of committed runs with ``run``."""
        done = self.commits()
        paths = [f"{self.home}/{table}/run={n}" for n in done if _exists(self.spark, f"{self.home}/{table}/run={n}")]
        if not paths:
            return self.spark.createDataFrame([], f"{schema}, run int")
        return self.spark.read.schema(f"{schema}, run int").option("basePath", f"{self.home}/{table}").parquet(*paths)

    def latest(self, table: str, schema: str, key: list[str]) -> DataFrame:
        """The newest row of each key."""
        rows = self.read(table, schema)
        rest = [c for c in rows.columns if c not in (*key, "run")]
        newest = F.max_by(F.struct(*rest), "run") if rest else F.max("run")
        return rows.groupBy(*key).agg(newest.alias("_row")).select(*key, *[F.col(f"_row.`{c}`").alias(c) for c in rest]).select(*[c for c in rows.columns if c != "run"])

    def stage(self, run: int, table: str, df: DataFrame) -> None:
        """Write the rows of a run; they count once it is committed."""
        df.write.mode("overwrite").parquet(f"{self.home}/{table}/run={run}")

    def commit(self, run: int, note: dict | None = None) -> None:
        """Make a run's rows visible, all at once; again is the same as once."""
        if run not in self.commits():
            line = json.dumps({"run": run, **(note or {})})
            self.spark.createDataFrame([(line,)], "value string").coalesce(1).write.mode("append").text(f"{self.home}/commits")
