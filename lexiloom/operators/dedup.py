"""Deduplication with exact fan-out, votes, chunks, buckets, merge and split, set checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiloom.functions import text as X


def unique_texts(rows: DataFrame, text: str, ord_: str) -> DataFrame:
    """One row per text: content id, occurrences, first occurrence."""
    return rows.where(F.col(text).isNotNull()).groupBy(F.col(text).alias("text")).agg(F.count(F.lit(1)).alias("uses"), F.min(ord_).alias("first_ord")).select(X.content_id(F.col("text")).alias("content_id"), "text", "uses", "first_ord")


def occurrences(rows: DataFrame, text: str, columns: list[str]) -> DataFrame:
    """The occurrence table beside it, one row per place: no list grows with a frequent text."""
    return rows.where(F.col(text).isNotNull()).select(X.content_id(F.col(text)).alias("content_id"), *columns)


def fan_out(occ: DataFrame, renderings: DataFrame) -> DataFrame:
    """Renderings by content id back to every occurrence; those without one keep a null."""
    return occ.join(renderings.select("content_id", "target"), "content_id", "left")


def map_distinct(df: DataFrame, column: str, fn, name: str) -> DataFrame:  # noqa: ANN001
    """Apply a costly function once per distinct value and join the results back, null-safe."""
    values = df.select(column).distinct()
    return df.join(fn(values, column, name).withColumnRenamed(column, "_v"), F.col(column).eqNullSafe(F.col("_v")), "left").drop("_v")


def majority(rows: DataFrame, key: str, value: str, tie: str = "text") -> DataFrame:
    """Most frequent value by key. Ties: ``text`` smallest, ``text_desc`` largest, ``first`` first seen (needs ord)."""
    aggs = [F.count(F.lit(1)).alias("n")] + ([F.min("ord").alias("o")] if tie == "first" else [])
    counts = rows.where(F.col(value).isNotNull()).groupBy(key, value).agg(*aggs)
    order = {"text": F.col(value).asc(), "text_desc": F.col(value).desc(), "first": F.col("o").asc() if tie == "first" else None}[tie]
    w = Window.partitionBy(key).orderBy(F.desc("n"), order)
    total = F.sum("n").over(Window.partitionBy(key))
    return counts.withColumn("total", total).withColumn("_rn", F.row_number().over(w)).where("_rn = 1").select(key, value, "n", "total")


def majority_share(rows: DataFrame, key: str, value: str, least: int = 3, share: float = 0.8) -> DataFrame:
    """The majority where it is frequent and clear enough."""
    return majority(rows, key, value).where((F.col("n") >= least) & (F.col("n") >= share * F.col("total")))


def duplicate_ids(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def chunk_sizes(rows: DataFrame, partition: str) -> DataFrame:
    return rows.groupBy(partition).agg(F.count(F.lit(1)).alias("n"))


def chunk(rows: DataFrame, partition: str, order: list[Column], size: int) -> DataFrame:
    """L3: numbered chunks of ``size`` rows, within a file."""
    w = Window.partitionBy(partition).orderBy(*order)
    return rows.withColumn("row_no", F.row_number().over(w)).withColumn("chunk_no", F.ceil(F.col("row_no") / F.lit(size)).cast("long"))


def first_appearance(rows: DataFrame, partition: str, value: str, order: str) -> DataFrame:
    """Numbers of values in the order of their first appearance in each file."""
    firsts = rows.groupBy(partition, value).agg(F.min(order).alias("first_ord"), F.count(F.lit(1)).alias("uses"))
    return firsts.withColumn("text_no", F.row_number().over(Window.partitionBy(partition).orderBy("first_ord", value)))


BUCKET_OVERHEAD = 32


def greedy_buckets(rows: DataFrame, file: str, order: str, text: str, row_limit: int = 25, char_limit: int = 3000) -> DataFrame:
    """Requests of at most ``row_limit`` rows and ``char_limit`` characters, one file each, in order; long rows alone.

    The fold is sequential by nature: files run in parallel, and in a file it only sees ids and lengths, batch by batch.
    """
    import pandas as pd

    narrow = rows.select(F.col(file).cast("string").alias("file"), F.col(order).alias("ord"), (F.length(X.text_or_empty(text)) + F.length(F.col(order).cast("string")) + BUCKET_OVERHEAD).alias("cost"))

    def fold(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("ord", kind="stable")
        bucket, n, chars, out = 0, 0, 0, []
        for cost in part["cost"].tolist():
            if n and (n >= row_limit or chars + cost > char_limit):
                bucket, n, chars = bucket + 1, 0, 0
            out.append(bucket)
            n, chars = n + 1, chars + cost
            if n >= row_limit or chars >= char_limit:
                bucket, n, chars = bucket + 1, 0, 0
        return part.assign(bucket=out)[["file", "ord", "bucket"]]

    return narrow.groupBy("file").applyInPandas(fold, "file string, ord long, bucket long")


# Sets (2.8).


def missing_ids(expected: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    return expected.select(key).distinct().join(actual.select(key).distinct(), key, "left_anti")


def id_coverage(expected: DataFrame, actual: DataFrame, key: str) -> DataFrame:
    """Sizes, common ids and the share of the expected ones that are there."""
    a = expected.select(key).distinct().withColumn("_a", F.lit(1))
    b = actual.select(key).distinct().withColumn("_b", F.lit(1))
    n = a.join(b, key, "full_outer").agg(F.count("_a").alias("n_expected"), F.count("_b").alias("n_actual"), F.count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull()).alias("n_common"))
    return n.withColumn("share", F.round(F.col("n_common") / F.greatest(F.lit(1), F.col("n_expected")), 4))


def merge_tree(rows: DataFrame, file: str, order: str) -> DataFrame:
    """One numbered list of all rows of a tree of files, and the way back in (file, row_no).

    Numbers are running counts over files: a window over the files' sizes only, and one within each file.
    """
    inner = rows.withColumn("row_no", F.row_number().over(Window.partitionBy(file).orderBy(order)))
    sizes = rows.groupBy(file).agg(F.count(F.lit(1)).alias("n"))
    before = sizes.withColumn("base", F.coalesce(F.sum("n").over(Window.orderBy(file).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select(file, "base")
    return inner.join(before, file).withColumn("merged_id", F.col("base") + F.col("row_no")).drop("base")


def split_back(merged: DataFrame, results: DataFrame, text: str) -> DataFrame:
    """Results by merged_id put back into the rows of their files; rows without one keep their text."""
    return merged.join(results.select("merged_id", F.col("target").alias("_t")), "merged_id", "left").withColumn(text, F.coalesce("_t", text)).drop("_t", "merged_id")


def multiset_difference(a: Column, b: Column) -> Column:
    """Elements of ``a`` left over when each of ``b`` takes out one."""

    def take(acc: Column, x: Column) -> Column:
        i = F.array_position(acc, x)
        return F.when(i == 0, acc).otherwise(F.concat(F.slice(acc, F.lit(1), i.cast("int") - 1), F.slice(acc, i.cast("int") + 1, F.size(acc))))

    return F.aggregate(b, a, take)
