"""Translation memory: lookups, the queue and its states, learning, upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiloom.functions import patterns as P
from lexiloom.functions import text as X


def trusted_memory(tm: DataFrame, qualities: tuple[str, ...] = P.TRUSTED_QUALITIES) -> DataFrame:
    """One target per key: of the trusted entries the newest, then the largest tm_id.

    A max over structs aggregates on the map side, so a key that holds a third of the rows costs one row per task.
    """
    best = F.max(F.struct("updated_at", "tm_id", "target_text", "quality")).alias("b")
    rows = tm.where(F.col("quality").isin(*qualities) & F.col("target_text").isNotNull()).withColumn("key", X.normal_key(F.col("source_text")))
    return rows.where("key != ''").groupBy("key").agg(best).select("key", F.col("b.target_text").alias("tm_target"), F.col("b.quality").alias("tm_quality"))


def exact_glossary(glossary: DataFrame) -> DataFrame:
    rows = glossary.where((F.col("mode") == "exact") & (X.text_or_empty("target") != "")).withColumn("key", X.normal_key(F.col("source")))
    return rows.where("key != ''").groupBy("key").agg(F.min_by("target", "gloss_id").alias("gl_target"))


def lookup(rows: DataFrame, key: str, tm: DataFrame, glossary: DataFrame) -> DataFrame:
    """Adds (target, engine) to rows: the trusted memory first, then the glossary's exact terms.

    Both sides are joined by shuffle; Spark broadcasts one only if its measured size is under the session's threshold.
    """
    out = rows.join(trusted_memory(tm).withColumnRenamed("key", key), key, "left").join(exact_glossary(glossary).withColumnRenamed("key", key), key, "left")
    engine = F.when(F.col("tm_target").isNotNull(), F.concat(F.lit("tm:"), "tm_quality")).when(F.col("gl_target").isNotNull(), "glossary")
    return out.withColumn("target", F.coalesce("tm_target", "gl_target")).withColumn("engine", engine).drop("tm_target", "tm_quality", "gl_target")


def wrapped_core(c: Column) -> Column:
    """Struct of prefix, core and suffix: leading and trailing tokens are set aside."""
    token = f"(?:{P.TOKEN})"
    prefix = F.regexp_extract(c, rf"^((?:\s*{token})*\s*)", 1)
    rest = F.substr(c, F.length(prefix) + 1, F.length(c))
    suffix = F.regexp_extract(rest, rf"((?:\s*{token})*\s*)$", 1)
    return F.struct(prefix.alias("prefix"), F.substr(rest, F.lit(1), F.length(rest) - F.length(suffix)).alias("core"), suffix.alias("suffix"))


def lookup_wrapped(rows: DataFrame, text: str, tm: DataFrame, glossary: DataFrame) -> DataFrame:
    """Lookup of the whole text, else of its core with the wrappers put back."""
    parts = rows.withColumn("_p", wrapped_core(X.text_or_empty(text))).withColumn("_whole", X.normal_key(F.col(text))).withColumn("_core", X.normal_key(F.col("_p.core")))
    whole = lookup(parts, "_whole", tm, glossary).withColumnsRenamed({"target": "_wt", "engine": "_we"})
    both = lookup(whole, "_core", tm, glossary)
    target = F.coalesce("_wt", F.when(F.col("target").isNotNull(), F.concat("_p.prefix", "target", "_p.suffix")))
    return both.withColumn("target", target).withColumn("engine", F.coalesce("_we", "engine")).drop("_p", "_whole", "_core", "_wt", "_we")


def build_queue(records: DataFrame, tm: DataFrame, glossary: DataFrame) -> DataFrame:
    """Distinct strings of each archive with their counts and status.

    Expects pak, id, original, source_original, language. The first source is that of the smallest id.
    """
    source = F.coalesce("source_original", "original")
    rows = records.select("pak", "id", X.text_or_empty("original").alias("cur"), X.text_or_empty(source).alias("src"), "language").withColumn("source_key", X.normal_key(F.col("src"))).where("source_key != ''")
    groups = rows.groupBy("pak", "source_key").agg(
        F.count(F.lit(1)).alias("occurrence_count"),
        F.count_if(F.col("cur") != F.col("src")).alias("translated_count"),
        F.every(F.coalesce(F.col("language") == "zh", F.lit(False))).alias("all_zh"),
        F.min_by("src", F.struct("id", "src")).alias("source"),
    )
    found = lookup(groups, "source_key", tm, glossary)
    open_ = ~F.col("all_zh") & (F.col("translated_count") < F.col("occurrence_count"))
    ok = X.same_tokens(F.col("source"), F.col("target"))
    status = F.when(F.col("all_zh"), "source_zh").when(~open_, "completed").when(F.col("target").isNull(), "pending").when(ok, "tm_ready").otherwise("review")
    return found.select(
        "pak", "source_key", X.exchange_text(F.col("source")).alias("source_text"), status.alias("status"), "occurrence_count",
        F.when(open_, X.text_or_empty("target")).otherwise("").alias("target_text"), F.when(status == "tm_ready", X.text_or_empty("engine")).otherwise("").alias("engine"),
    )


def queue_stats(queue: DataFrame, pak: str = "pak_name") -> DataFrame:
    return queue.groupBy(pak, "status").agg(F.count(F.lit(1)).alias("n_unique"), F.coalesce(F.sum("occurrence_count"), F.lit(0)).alias("n_occurrences"))


def queue_totals(queue: DataFrame, pak: str = "pak_name") -> DataFrame:
    return queue.groupBy(pak).agg(
        F.count(F.lit(1)).alias("unique_total"),
        F.coalesce(F.sum("occurrence_count"), F.lit(0)).alias("occurrence_total"),
        F.count_if(F.col("status").isin("completed", "source_zh")).alias("completed_unique"),
        F.count_if(F.col("status").isin("pending", "tm_ready", "failed", "review")).alias("remaining_unique"),
    )


def queue_top(queue: DataFrame, n: int, status: str | None = None) -> DataFrame:
    rows = queue if status is None else queue.where(F.col("status") == status)
    return rows.orderBy(F.desc("occurrence_count"), "source_text", "pak_name", "source_key").limit(n)


def advance_queue(queue: DataFrame, tm: DataFrame, glossary: DataFrame) -> DataFrame:
    """One step of the queue's states: pending strings that the memory knows now become ready, or go to review."""
    found = lookup(queue.drop("engine").withColumnRenamed("target_text", "_old"), "source_key", tm, glossary)
    hit = (F.col("status") == "pending") & F.col("target").isNotNull()
    ok = X.same_tokens(F.col("source_text"), F.col("target"))
    return found.select(
        "pak_name", "source_key", "source_text", F.when(hit & ok, "tm_ready").when(hit, "review").otherwise(F.col("status")).alias("status"), "occurrence_count",
        F.when(hit, F.col("target")).otherwise(F.col("_old")).alias("target_text"), F.when(hit & ok, F.col("engine")).alias("engine"),
    )


def apply_ready(records: DataFrame, queue: DataFrame) -> DataFrame:
    """Records with the ready targets put in where the text is still the source; markers and newlines as they are stored."""
    ready = queue.where("status = 'tm_ready'").select(F.col("pak_name").alias("pak"), F.col("source_key").alias("_key"), F.col("target_text").alias("_target"), F.col("engine").alias("_engine"))
    source = F.coalesce("source_original", "original")
    rows = records.withColumn("_key", X.normal_key(source)).join(ready, ["pak", "_key"], "left")
    hit = F.col("_target").isNotNull() & (X.text_or_empty("original") == X.text_or_empty(source))
    return rows.withColumns(
        {"original": F.when(hit, X.internal_text(F.col("_target"), source)).otherwise(F.col("original")), "source_original": F.when(hit, source).otherwise(F.col("source_original")),
         "note": F.when(hit, F.concat(F.lit("local:"), X.text_or_empty("_engine"))).otherwise(F.col("note")), "status": F.when(hit, "tm").otherwise(F.col("status"))}
    ).drop("_key", "_target", "_engine")


def learnable(records: DataFrame) -> DataFrame:
    """Edited records by key: the first rendering, how many further ones, and whether they agree."""
    source = F.coalesce("source_original", "original")
    rows = records.where(X.exchange_text(F.col("original")) != X.exchange_text(source)).select("pak", "id", X.normal_key(source).alias("source_key"), "original", X.normal_key(F.col("original")).alias("_t"))
    return rows.where("source_key != ''").groupBy("pak", "source_key").agg(F.min_by("original", F.struct("id", "original")).alias("target"), (F.count(F.lit(1)) - 1).alias("n_more"), (F.min("_t") != F.max("_t")).alias("in_conflict"))


def acceptable(source: Column, target: Column) -> Column:
    """What an entry needs to be remembered: equal tokens, a key, a target that isn't the source."""
    return X.same_tokens(X.exchange_text(source), X.exchange_text(target)) & (X.normal_key(source) != "") & (X.normal_key(target) != X.normal_key(source))


def upsert(base: DataFrame, changes: DataFrame, key: str, order: str) -> DataFrame:
    """Latest row by key of base and changes; changes win a tie."""
    both = base.withColumn("_new", F.lit(0)).unionByName(changes.withColumn("_new", F.lit(1)))
    w = Window.partitionBy(key).orderBy(F.desc_nulls_last(order), F.desc("_new"))
    return both.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn", "_new")
