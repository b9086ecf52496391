"""Helpers shared by the training-data operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.operators.shared import settled  # noqa: F401

#: Salts over which one hot key is spread. A key that holds a third of all rows then puts 1/192 of them into a task.
SALTS = 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """Give a costly Python stage at least as many partitions as there are cores.

    The input is left alone when its files already split well; a few files are dealt out round-robin, one shuffle of what is read.
    """
    want = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() * 2 > want else df.repartition(want)


#: Bytes of text in a slice of rows, unless one row alone has more.
SLICE_BYTES = 16 << 20


def slices(whole: pa.RecordBatch, rows: int, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """A batch in parts of at most ``rows`` rows and about ``size`` bytes of text."""
    weight = np.zeros(whole.num_rows, np.int64)
    for column in whole.columns:
        if pa.types.is_string(column.type) or pa.types.is_large_string(column.type):
            weight += pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    total, at = np.cumsum(weight), 0
    while at < whole.num_rows:
        end = int(np.searchsorted(total, (total[at - 1] if at else 0) + size, "right"))
        end = max(at + 1, min(at + rows, end))
        yield whole.slice(at, end - at)
        at = end


def map_columns(df: DataFrame, fn: Callable[..., dict[str, list]], schema: str, batch_rows: int = 2000) -> DataFrame:
    """mapInArrow with plain lists: ``fn(**columns) -> columns``, over slices of at most ``batch_rows`` rows.

    The slices bound a worker's memory whatever the Arrow batch size of the session is.
    """
    from pyspark.sql.types import _parse_datatype_string

    fields = _parse_datatype_string(schema)
    arrow = _arrow(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in slices(whole, batch_rows):
                out = fn(**{n: part.column(i).to_pylist() for i, n in enumerate(part.schema.names)})
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, fields)


def _arrow(fields) -> pa.Schema:  # noqa: ANN001
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(fields)


def salt_of(*cols: str, salts: int = SALTS) -> Column:
    return F.pmod(F.xxhash64(*cols), F.lit(salts)).cast("int")


def first_of_group(df: DataFrame, keys: list[str], id_col: str, salts: int = SALTS) -> DataFrame:
    """Each row of a group of two or more, with ``first_id`` and ``n_copies`` of its group.

    Groups are aggregated per (key, salt), then per key, and the answer goes back per (key, salt): no task ever
    holds a whole hot group, and a key is copied at most ``salts`` times.
    """
    rows = df.withColumn("_salt", salt_of(id_col, salts=salts))
    part = rows.groupBy(*keys, "_salt").agg(F.min(id_col).alias("_m"), F.count(F.lit(1)).alias("_n"))
    whole = (
        part.groupBy(*keys)
        .agg(F.min("_m").alias("first_id"), F.sum("_n").alias("n_copies"), F.collect_list("_salt").alias("_salts"))
        .where("n_copies > 1")
        .withColumn("_salt", F.explode("_salts"))
        .drop("_salts")
    )
    return rows.join(whole, [*keys, "_salt"]).drop("_salt")


def code_points(df: DataFrame, column: str) -> dict[str, int]:
    """How often every code point occurs in a column, ASCII included: counted by batches of texts, one row a code point and batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for part in slices(whole, 10_000):
                text = "".join(t for t in part.column(0).to_pylist() if t)
                n = np.bincount(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), minlength=1)
                seen = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), pa.array(n[seen], pa.int64())], names=["c", "n"])

    rows = df.select(column).mapInArrow(run, "c int, n bigint").groupBy("c").agg({"n": "sum"}).collect()
    return {chr(r[0]): r[1] for r in rows}
