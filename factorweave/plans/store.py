"""Tables that a run computes once and reads often, in a folder that the cluster shares."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; where that is unset a local one, and on a cluster an error."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir is unset: it must name a folder that all executors share")
        named = os.path.join(tempfile.gettempdir(), "factorweave-tables")
    return named.rstrip("/")


def kept(df: DataFrame, label: str) -> DataFrame:
    """``df``, computed once: written as Parquet and read back, so neither later queries nor a lost executor compute it again."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
