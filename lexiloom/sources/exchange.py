"""Exchange CSV trees: listing, reading, writing, merging into one table and back; point updates of manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.operators import dedup


def read_tree(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of all CSV files below a folder (names that start with ``_`` are left out), with file and row_no.

    The byte order mark is dropped from the first header; quotes are doubled inside quotes, newlines may stand in them.
    """
    df = spark.read.option("header", True).option("recursiveFileLookup", True).option("pathGlobFilter", "[!_]*.csv").option("quote", '"').option("escape", '"').option("multiLine", True).option("encoding", "UTF-8").csv(folder)
    df = df.select(*[F.col(f"`{c}`").alias(c.lstrip("﻿")) for c in df.columns], F.col("_metadata.file_path").alias("file"))
    return df


def write_csv(df: DataFrame, path: str) -> None:
    """K3: exchange CSV; every value quoted, so ids keep their zeros."""
    df.write.mode("overwrite").option("header", True).option("quoteAll", True).option("escape", '"').option("lineSep", "\n").csv(path)


def merge(rows: DataFrame, order: str = "id") -> DataFrame:
    """The tree as one table with running merged ids."""
    return dedup.merge_tree(rows, "file", order)


def split(merged: DataFrame, results: DataFrame, text: str = "text") -> DataFrame:
    """Results back to the rows of their files."""
    return dedup.split_back(merged, results, text)


def point_update(rows: DataFrame, key: str, wanted: str, column: str, value: str) -> DataFrame:
    """One column of the rows with a key, whatever its case; a key that no row has is an error."""
    hit = F.lower(key) == F.lit(wanted.lower())
    if rows.where(hit).isEmpty():
        raise KeyError(wanted)
    return rows.withColumn(column, F.when(hit, F.lit(value)).otherwise(F.col(column)))
