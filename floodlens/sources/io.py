"""Scans and sinks of the text logs, feature files, reports and models
(S1-S3, S6, S7, S9).  Every read has an explicit schema; existence checks
go through the Hadoop file system of the path, so they work the same on a
local folder and on shared cluster storage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from floodlens.schemas import FLOW_FEATURES, MITIGATION_EVENT, TRAFFIC_EVENT


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(fs.exists(p)) or len(fs.globStatus(p) or []) > 0


def _csv(spark: SparkSession, path: str, schema) -> DataFrame:
    return (spark.read.schema(schema).option("header", True).option("mode", "PERMISSIVE")
            .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))


def read_event_log(spark: SparkSession, path: str, schema=TRAFFIC_EVENT) -> DataFrame:
    """Traffic event log (CSV with header).  A missing path is an empty
    table with the log's schema, not an error."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], schema)
    return _csv(spark, path, schema)


def read_mitigation_log(spark: SparkSession, path: str, schema=MITIGATION_EVENT) -> DataFrame:
    """Mitigation log, DROP_ICMP rows only (header skipped; missing -> empty)."""
    return read_event_log(spark, path, schema).filter(F.col("action").contains("DROP_ICMP"))


def read_feature_sessions(spark: SparkSession, normal_path: str, attack_path: str,
                          schema=FLOW_FEATURES) -> tuple[DataFrame, DataFrame]:
    """S3: the two session files of the feature collector; both are required
    (checked before any plan is built)."""
    for p in (normal_path, attack_path):
        if not path_exists(spark, p):
            raise FileNotFoundError(p)
    return _csv(spark, normal_path, schema), _csv(spark, attack_path, schema)


def append_log(df: DataFrame, path: str) -> None:
    """Append rows to a CSV log.  Every part file carries the header line,
    so a new log starts with its header and appends never repeat rows in
    between; readers skip each part's header."""
    df.write.mode("append").option("header", True).csv(path)


def write_dataset(df: DataFrame, path: str) -> None:
    """Overwrite the labeled dataset (CSV with header)."""
    df.write.mode("overwrite").option("header", True).csv(path)


def write_report_tables(tables: dict[str, DataFrame], directory: str) -> dict[str, str]:
    """Each published table is one result set, written as parquet under
    ``directory/<name>`` (overwrite: re-running a report replaces it)."""
    out = {}
    for name, df in tables.items():
        p = f"{directory.rstrip('/')}/{name}"
        df.write.mode("overwrite").parquet(p)
        out[name] = p
    return out
