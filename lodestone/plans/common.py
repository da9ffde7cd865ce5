"""What the query modules share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def user_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, text) of every user turn; id is (conv_id, turn), in whose order the requests come."""
    turns = read(spark, sf_dir, "conversations").filter("role = 'user'")
    return turns.select(F.struct("conv_id", "turn").alias("id"), "text")
