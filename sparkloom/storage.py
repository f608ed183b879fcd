"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession

LOCAL_SHARED = "/tmp/checkpoints/sparkloom"
_written: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir; where it is unset a local master gets LOCAL_SHARED, and a cluster, whose machines share no folder of that name, an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return LOCAL_SHARED


def scratch(name: str) -> str:
    """A name that no other call has, for the tables of one loop."""
    return f"{name}-{uuid.uuid4().hex[:12]}"


def store(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: a lost executor costs a re-read, never a recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/sparkloom-{name}-{uuid.uuid4().hex}"
    _written.append((spark, path))  # a write that fails leaves files too
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_stored(name: str | None = None, but: DataFrame | None = None) -> None:
    """Delete what ``store`` has written (with ``name``: only that table's files; never those that ``but`` reads)."""
    kept = but.inputFiles() if but is not None else []
    for spark, path in list(_written):
        if name is not None and f"sparkloom-{name}-" not in path or any(path.rsplit("/", 1)[1] in f for f in kept):
            continue
        _written.remove((spark, path))
        try:
            at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # the session has ended already
            return


atexit.register(drop_stored)
