"""Intermediate tables in the folder that the cluster shares."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; where that is unset a local one, and on a cluster an error."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        master = spark.sparkContext.master
        if not master.startswith("local["):
            raise ValueError(f"spark.checkpoint.dir is unset: on {master} it must name a folder that all executors share")
        named = os.path.join(tempfile.gettempdir(), "factorweave-scratch")
    return named.rstrip("/")


def _write(df: DataFrame, label: str) -> tuple[DataFrame, str]:
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def written(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: a lost executor never recomputes past it.

    The table stays, as what is built on it is read later; its owner deletes the folder after the application.
    """
    return _write(df, label)[0]


class Scratch:
    """Tables that are needed only until a result is written; leaving the block deletes them."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.paths: dict[int, tuple[DataFrame, str]] = {}

    def __enter__(self) -> Scratch:
        return self

    def __exit__(self, *_: object) -> None:
        self.drop(*(df for df, _ in list(self.paths.values())))

    def written(self, df: DataFrame, label: str) -> DataFrame:
        out, path = _write(df, label)
        self.paths[id(out)] = (out, path)
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that no result still to be computed reads."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for table in tables:
            _, path = self.paths.pop(id(table))
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(conf).delete(at, True)
