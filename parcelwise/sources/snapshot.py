"""Published-record snapshot: a JSON array of records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SCHEMA = (
    "prop_id string, situs_address_full string, owner_name string, assessed_value bigint, "
    "known_drift map<string,string>"
)


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(SCHEMA).option("multiLine", True).json(path)
