"""Tables that several steps of a plan read, written once into the cluster's shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame


def settled(df: DataFrame) -> DataFrame:
    """A table that is written once into the shared folder that spark.checkpoint.dir names, and read from there.

    Where the setting is unset, as in tests, a folder of this machine takes its place.
    """
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None) or tempfile.gettempdir()
    path = f"{folder.rstrip('/')}/lexiloom-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
