"""Session and checkpoint helpers."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import SparkSession


def build_session(master: str = "local[*]", shuffle_partitions: int = 8, app: str = "floodlens",
                  extra: dict | None = None) -> SparkSession:
    """A session with the settings every operator assumes (UTC, AQE on, UI off)."""
    b = (SparkSession.builder.master(master).appName(app)
         .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.sql.adaptive.enabled", "true")
         .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
         .config("spark.sql.adaptive.skewJoin.enabled", "true")
         .config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         .config("spark.sql.execution.arrow.pyspark.enabled", "true")
         .config("spark.driver.memory", "8g"))
    for k, v in (extra or {}).items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder the cluster names.  A temporary one is made
    only where the driver and the executors are one process; a cluster whose
    session names none is an error, as its machines would not see the files."""
    sc = spark.sparkContext
    d = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not d and not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
    if not d:
        d = tempfile.mkdtemp(prefix="floodlens-ckpt-", dir=os.environ.get("TMPDIR", "/tmp"))
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(d)
    return sc.getCheckpointDir() or d


def write_table(df, name: str, partition_by: tuple = ()) -> str:
    """Write ``df`` as parquet under the shared checkpoint folder; returns the path."""
    import uuid
    base = checkpoint_dir(df.sparkSession).rstrip("/")
    path = f"{base}/floodlens-tables/{name}-{uuid.uuid4().hex[:12]}"
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)
    return path


def materialize(df, name: str):
    """Cut lineage: write ``df`` as parquet under the shared checkpoint folder
    and read it back.  One computation; later stages read a small plan with
    column pruning and filter pushdown, and survive executor loss without
    recomputing the upstream stages."""
    return df.sparkSession.read.parquet(write_table(df, name))


def ensure_utc(spark: SparkSession) -> None:
    """Event time is epoch µs in UTC throughout the library, and naive text
    times are converted with an explicit zone (``tz`` arguments).  Casts and
    formats of timestamps follow the session zone, so it must be UTC."""
    if spark.conf.get("spark.sql.session.timeZone") not in ("UTC", "Etc/UTC", "Z", "+00:00"):
        spark.conf.set("spark.sql.session.timeZone", "UTC")
