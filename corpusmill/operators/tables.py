"""Tables that cut lineage, written to the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: The temporary folder of each local session without spark.checkpoint.dir.
_LOCAL: dict[str, str] = {}


def work_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; only a local session without it gets a temporary one, the same each time."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    session = spark.sparkContext.applicationId
    if session not in _LOCAL:
        _LOCAL[session] = tempfile.mkdtemp(prefix="corpusmill-")
    return _LOCAL[session]


def settled(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table: computed once, of a known size, and safe from lost executors."""
    spark = df.sparkSession
    path = f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
