"""The progress log: JSON lines of which the last for each identifier counts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "identifier string, status string, timestamp string, sha256 string, error string"


def latest(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """One row for each key: the last by ``order``. A partial aggregate, so a hot key needs no window."""
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.max_by(F.struct(*rows.columns), F.struct(*order)).alias("r")).select("r.*")


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """Last record of each identifier; blank and broken lines are left out. Lines count in the order of their files and places."""
    lines = spark.read.text(path).withColumn("_m", F.monotonically_increasing_id())
    rows = lines.select(F.from_json("value", SCHEMA).alias("j"), "_m").select("j.*", "_m").where("identifier is not null")
    return latest(rows, "identifier", ["_m"]).drop("_m")


def append_log(rows: DataFrame, path: str) -> None:
    """Append records (identifier, status, sha256?, error?) with the time of writing."""
    rows.withColumn("timestamp", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX")).write.mode("append").json(path)
