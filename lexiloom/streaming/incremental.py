"""Incremental operators: edit-log replay, upserted state, resumable micro-batches, windows with late data, fix-points.

State is a table in versioned folders: batch ``n`` reads version ``n - 1`` and writes version ``n``, so a batch that runs
again after a failure gives the same version. Folders belong in storage that all executors share.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def replay_edits(edits: DataFrame) -> DataFrame:
    """Last value of each (id, field): by time of the edit, then its number. Repeated rows and late ones change nothing."""
    last = F.max(F.struct("edited_at", "edit_seq", F.struct("new_value").alias("v")))
    return edits.where("id is not null and field_name is not null").groupBy("id", "field_name").agg(last.alias("b"), F.countDistinct("edit_seq").alias("n_edits")).select("id", "field_name", F.col("b.v.new_value").alias("value"), F.col("b.edited_at").alias("edited_at"), F.col("b.edit_seq").alias("edit_seq"), "n_edits")


def apply_edits(records: DataFrame, edits: DataFrame, fields: tuple[str, ...] = ("original", "status", "note")) -> DataFrame:
    """Records with the replayed values; a changed text keeps its source and clears the review."""
    wide = replay_edits(edits).where(F.col("field_name").isin(*fields)).groupBy("id").pivot("field_name", list(fields)).agg(F.first(F.struct("value")))
    wide = wide.select("id", *[F.col(f).alias(f"_{f}") for f in fields])
    rows = records.join(wide, "id", "left")
    set_ = {f: F.when(F.col(f"_{f}").isNotNull(), F.col(f"_{f}.value")).otherwise(F.col(f)) for f in fields}
    changed = F.col("_original").isNotNull() & ~F.col("_original.value").eqNullSafe(F.col("original")) if "original" in fields else F.lit(False)
    review = {c: F.when(changed, F.lit(None)).otherwise(F.col(c)) for c in ("review_status", "review_signature", "reviewed_at") if c in records.columns}
    source = {"source_original": F.when(changed, F.coalesce("source_original", "original")).otherwise(F.col("source_original"))} if "source_original" in records.columns else {}
    return rows.withColumns(set_ | review | source).drop(*[f"_{f}" for f in fields])


class VersionedState:
    """A keyed table in folders ``v=0``, ``v=1``, ...; ``merge`` keeps the latest row of each key."""

    def __init__(self, spark: SparkSession, folder: str, schema: str, keys: list[str], order: list[str]) -> None:
        self.spark, self.folder, self.schema, self.keys, self.order = spark, folder, schema, keys, order

    def read(self, version: int) -> DataFrame:
        if version < 0:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.folder}/v={version}")

    def merge(self, changes: DataFrame, version: int) -> None:
        names = [f.name for f in self.spark.createDataFrame([], self.schema).schema]
        both = self.read(version - 1).unionByName(changes.select(*names))
        rest = [n for n in names if n not in self.keys]
        best = F.max(F.struct(*[F.col(o) for o in self.order], F.struct(*rest).alias("_row"))).alias("b")
        both.groupBy(*self.keys).agg(best).select(*self.keys, "b._row.*").select(*names).write.mode("overwrite").parquet(f"{self.folder}/v={version}")


def stream_edits(spark: SparkSession, source: str, folder: str, schema: str) -> int:
    """Run the edit log at ``source`` (a folder of parquet files) through to its end into a versioned state; gives the last version."""
    state = VersionedState(spark, f"{folder}/state", "id string, field_name string, edited_at timestamp, edit_seq bigint, new_value string", ["id", "field_name"], ["edited_at", "edit_seq"])
    last = {"v": -1}

    def step(batch: DataFrame, n: int) -> None:
        state.merge(batch.select("id", "field_name", "edited_at", "edit_seq", "new_value"), n)
        last["v"] = n

    query = spark.readStream.schema(schema).parquet(source).writeStream.foreachBatch(step).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return last["v"]


def pending(rows: DataFrame, done: DataFrame, key: list[str]) -> DataFrame:
    """Rows whose key (an id, a content hash, a file's fingerprint) is not done yet."""
    return rows.join(done.select(*key).distinct(), key, "left_anti")


def process_resumable(rows: DataFrame, key: str, fn: Callable[[DataFrame], DataFrame], folder: str, version: int) -> DataFrame:
    """Results of ``fn`` for the rows that earlier versions have not done; all results so far come out.

    ``fn`` gives (key, result). Rows without a result stay pending for the next version.
    """
    spark = rows.sparkSession
    schema = f"{key} string, result string"
    done = spark.read.schema(schema).parquet(*[f"{folder}/v={v}" for v in range(version)]) if version else spark.createDataFrame([], schema)
    todo = pending(rows, done, [key])
    fn(todo).where("result is not null").select(F.col(key).cast("string").alias(key), "result").write.mode("overwrite").parquet(f"{folder}/v={version}")
    return spark.read.schema(schema).parquet(*[f"{folder}/v={v}" for v in range(version + 1)])


def two_phase(rows: DataFrame, key: str, first: Callable[[DataFrame], DataFrame], second: Callable[[DataFrame], DataFrame], folder: str) -> DataFrame:
    """All rows in large requests, then the unresolved ones in small ones."""
    process_resumable(rows, key, first, folder, 0)
    return process_resumable(rows, key, second, folder, 1)


def completed_files(files: DataFrame, reports: DataFrame) -> DataFrame:
    """Files that have no report newer than they are. files(path, modified), reports(path, finished)."""
    latest = reports.groupBy("path").agg(F.max("finished").alias("finished"))
    return files.join(latest, "path", "left").where(F.col("finished").isNull() | (F.col("finished") < F.col("modified"))).drop("finished")


def fix_point(rows: DataFrame, rejected: Callable[[DataFrame], DataFrame], restore: Callable[[DataFrame, DataFrame], DataFrame], rounds: int = 10) -> tuple[DataFrame, int]:
    """Restore what a check rejects until nothing is. Lineage is cut by checkpoint in the cluster's shared folder."""
    spark = rows.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        import tempfile

        spark.sparkContext.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="lexiloom-"))
    for n in range(rounds):
        bad = rejected(rows).checkpoint()
        if bad.isEmpty():
            return rows, n
        rows = restore(rows, bad).checkpoint()
    return rows, rounds


def windowed_counts(stream: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Counts and sums of events by type and window, with a watermark for late ones; batch and stream alike."""
    marked = stream.withWatermark("ts", late) if stream.isStreaming else stream
    return marked.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def latest(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Newest row of each key, as a window: the batch form of the state above."""
    w = Window.partitionBy(key).orderBy(*[F.desc_nulls_last(o) for o in order])
    return rows.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")
