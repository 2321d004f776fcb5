"""Where intermediate tables go, and how tables are read.

Every executor must see the folder, so it is the one named by ``spark.checkpoint.dir``; only a session in local mode
(tests) may leave it out and gets a temporary one. On a cluster that would be another folder on every machine, so it
is an error.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder of the session; sets one for a session without any."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir", None)
    current = sc._jsc.sc().getCheckpointDir()
    if found:
        if not current.isDefined():
            sc.setCheckpointDir(found)
        return found
    if current.isDefined():
        return current.get()
    if not sc.master.startswith("local[") and sc.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="weftline-")
    sc.setCheckpointDir(f"file://{folder}")
    return f"file://{folder}"


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/weftline/{name}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends in files that outlive executors."""
    path = scratch(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written_to = path
    return out


def discard(*frames: DataFrame) -> None:
    """Delete the files of frames made by :func:`materialize` that nothing will read again."""
    for df in frames:
        if path := getattr(df, "_written_to", None):
            remove(df.sparkSession, path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a path made by :func:`scratch`."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder: one Parquet file or a folder of part files."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
