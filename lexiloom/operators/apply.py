"""Putting renderings into records (2.15): acceptance, duplicate and coverage gates, fan-out, segments, paths and wrappers, sinks."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexiloom.functions import patterns as P
from lexiloom.functions import templates
from lexiloom.functions import text as X
from lexiloom.operators import dedup

PATHS = rf"({P.RESOURCE_PATH})"


def refusal(source: Column, target: Column) -> Column:
    """V3-V5: first reason against a rendering, else null: empty, left-over markers, tags, paths, prefix, tokens."""
    s, t = X.text_or_empty(source), X.text_or_empty(target)

    def paths(c: Column) -> Column:
        return F.regexp_extract_all(c, F.lit(PATHS), F.lit(1))

    def lead(c: Column) -> Column:
        return F.regexp_extract(c, r"^\s*([$#=]?)", 1)

    return (
        F.when(F.trim(t) == "", "empty")
        .when(X.leaked_markers(t), "markers left")
        .when(X.structural_tags(s) != X.structural_tags(t), "tags changed")
        .when(paths(s) != paths(t), "paths changed")
        .when(lead(s) != lead(t), "prefix changed")
        .when(~X.same_tokens(s, t), "tokens changed")
    )


# Predicates on records.


def masked(c: Column) -> Column:
    return F.regexp_replace(X.text_or_empty(c), P.TOKEN, " ")


def residual_source(c: Column) -> Column:
    """Vietnamese left after masking tokens."""
    m = masked(c)
    return m.rlike(P.VIETNAMESE) | m.rlike(P.VIETNAMESE_WORD)


def incomplete(c: Column, allowed: tuple[str, ...] = ("NPC", "PK", "VIP", "BOSS", "GM", "HP", "MP", "EXP", "ID", "LV")) -> Column:
    """A word in Latin letters that isn't one of the usual abbreviations."""
    words = F.regexp_extract_all(masked(c), F.lit(r"([A-Za-z\x{00C0}-\x{024F}\x{1E00}-\x{1EFF}]+)"), F.lit(1))
    return F.exists(words, lambda w: ~F.upper(w).isin(*allowed))


def still_open(c: Column) -> Column:
    """P10: needs translation by its current text, whatever its status says; left-over markers count, too."""
    return X.leaked_markers(c) | (residual_source(c) & ~X.is_structural(c) & X.has_natural_text(c))


def likely_translatable(text: Column, lang: Column) -> Column:
    """P7."""
    s = X.text_or_empty(text)
    code = s.rlike(r"^[A-Za-z0-9_./\\:-]+$") & (lang == "other")
    return F.length(s).between(2, 2000) & ~s.rlike(P.NUMERIC_CELL) & ~code & (s.rlike(P.VIETNAMESE) | lang.isin("vi", "zh", "mixed"))


def player_visible(suffix: Column, header: Column, key: Column) -> Column:
    """By suffix: tables by their header, key files by their key, scripts and prose as they are."""
    from lexiloom.sources.units import INTERNAL_HEADER, VISIBLE_HEADER

    h = X.text_or_empty(header)
    return F.when(suffix.isin("tsv", "csv"), h.rlike(VISIBLE_HEADER) & ~h.rlike(INTERNAL_HEADER)).when(suffix == "ini", X.is_visible_key(key)).otherwise(suffix.isin("txt", "lua"))


def replaceable(current: Column, candidate: Column) -> Column:
    """A clean CJK text is never replaced; a candidate must be CJK without source language."""
    clean = X.contains_cjk(current) & ~residual_source(current)
    return ~clean & X.contains_cjk(candidate) & ~residual_source(candidate)


# Applying.


def apply_renderings(records: DataFrame, renderings: DataFrame, least_share: float | None = None) -> tuple[DataFrame, DataFrame]:
    """(records, report). renderings(content_id, target) go to every record with the source of that id.

    A content id that occurs twice is an error before anything is applied, as is a share of known ids below ``least_share``.
    Ids that no record has are reported as unknown, refused renderings with their reason; their records stay as they are.
    """
    twice = dedup.duplicate_ids(renderings, "content_id")
    if not twice.isEmpty():
        raise ValueError(f"content id more than once: {twice.first()['content_id']}")
    source = F.coalesce("source_original", "original")
    rows = records.withColumn("content_id", X.content_id(source))
    if least_share is not None:
        share = dedup.id_coverage(rows, renderings, "content_id").first()["share"]
        if share < least_share:
            raise ValueError(f"only {share:.0%} of the ids are there")
    joined = rows.join(renderings.select("content_id", F.col("target").alias("_t")), "content_id", "left").withColumn("_why", F.when(F.col("_t").isNotNull(), refusal(source, F.col("_t"))))
    good = F.col("_t").isNotNull() & F.col("_why").isNull() & (F.col("_t") != F.coalesce("original", F.lit("")))
    out = joined.withColumns({"source_original": F.when(good, source).otherwise(F.col("source_original")), "original": F.when(good, F.col("_t")).otherwise(F.col("original"))}).drop("content_id", "_t", "_why")
    refused = joined.where("_why is not null").groupBy("content_id", F.col("_why").alias("reason")).agg(F.count(F.lit(1)).alias("n_records"))
    unknown = renderings.join(rows.select("content_id").distinct(), "content_id", "left_anti").select("content_id", F.lit("unknown id").alias("reason"), F.lit(0).cast("long").alias("n_records"))
    return out, refused.unionByName(unknown)


def apply_segments(records: DataFrame, renderings: DataFrame, text: str = "original") -> DataFrame:
    """Texts rebuilt from the renderings of their segments (segment_id, target); refused segments keep their source.

    Adds n_rendered and n_refused. A record has as many segments as its text has, which bounds the lists.
    """
    pieces = records.select("id", F.posexplode(templates.skeleton_udf(text)).alias("pos", "p")).select("id", "pos", "p.kind", F.col("p.id").alias("segment_id"), "p.value")
    joined = pieces.join(renderings.select("segment_id", F.col("target").alias("t")).dropDuplicates(["segment_id"]), "segment_id", "left")
    lists = joined.groupBy("id").agg(F.array_sort(F.collect_set(F.struct("pos", "kind", "segment_id", "value", "t"))).alias("l"))
    schema = T.StructType([T.StructField("text", T.StringType()), T.StructField("rendered", T.LongType()), T.StructField("refused", T.LongType())])

    @F.pandas_udf(schema)
    def rebuild(l: pd.Series) -> pd.DataFrame:
        out = [templates.reassemble([(p["kind"], p["segment_id"], p["value"]) for p in x], {p["segment_id"]: p["t"] for p in x if p["t"]}) for x in l]
        return pd.DataFrame(out, columns=["text", "rendered", "refused"])

    done = lists.select("id", rebuild("l").alias("r"))
    return records.join(done, "id", "left").withColumns({text: F.coalesce("r.text", text), "n_rendered": F.coalesce("r.rendered", F.lit(0)), "n_refused": F.coalesce("r.refused", F.lit(0))}).drop("r")


def restore_paths(source: Column, target: Column) -> Column:
    """The target with its paths replaced by the source's, in order, where both have as many."""
    pattern = re.compile(PATHS)

    @F.pandas_udf(T.StringType())
    def run(s: pd.Series, t: pd.Series) -> pd.Series:
        def one(a: str | None, b: str | None) -> str | None:
            paths = [m[0] for m in pattern.finditer(a or "")]
            if b is None or len(paths) != len(pattern.findall(b)):
                return b
            it = iter(paths)
            return pattern.sub(lambda _: next(it), b)

        return pd.Series([one(a, b) for a, b in zip(s, t, strict=True)], dtype=object)

    return run(source, target)


def complete_wrapper(source: Column, target: Column) -> Column:
    """The source's outer tag pair around a target that lost it."""
    s, t = X.text_or_empty(source), X.text_or_empty(target)
    outer = r"(?s)^(<[A-Za-z][^<>]*>).*(</[A-Za-z][^<>]*>)$"
    first, last = F.regexp_extract(s, outer, 1), F.regexp_extract(s, outer, 2)
    return F.when((first != "") & ~t.contains("<") & (t != ""), F.concat(first, t, last)).otherwise(target)


def exclude_done(rows: DataFrame, done: DataFrame, key: str) -> DataFrame:
    return rows.join(done.select(key).distinct(), key, "left_anti")


def append_missing(records: DataFrame, extracted: DataFrame) -> DataFrame:
    """Extracted records at places that the table doesn't have yet, appended."""
    place = ["pak", "source_file", "line_no", "col_no"]
    new = extracted.join(records.select(*place).distinct(), place, "left_anti")
    return records.unionByName(new, allowMissingColumns=True)


def split_found(records: DataFrame, clean: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Records with the clean source of their place, and those without one."""
    place = ["pak", "source_file", "line_no", "col_no"]
    sources = clean.groupBy(*place).agg(F.min("original").alias("clean_source"))
    joined = records.join(sources, place, "left")
    return joined.where("clean_source is not null"), joined.where("clean_source is null").drop("clean_source")


def alternative_ids(updates: DataFrame) -> DataFrame:
    """An update also goes to the ids of columns 0 and 1 of its line."""
    cols = F.array_distinct(F.array("col_no", F.lit(0), F.lit(1)))
    return updates.withColumn("_c", F.explode(cols)).withColumn("alt_id", X.record_id(F.col("pak"), F.col("source_file"), F.col("line_no"), F.col("_c"), F.col("source_text"))).drop("_c")


def write_records(records: DataFrame, path: str) -> None:
    """K1: the record table by archive; Spark's commit protocol makes the change whole or not at all."""
    records.write.mode("overwrite").partitionBy("pak").parquet(path)


def reports(records: DataFrame, selected: DataFrame) -> dict[str, DataFrame]:
    """Rows by method, conflicts, and counts by method and archive."""
    rows = records.select("id", "pak", "source_file").join(selected, "id")
    return {"rows": rows, "conflicts": rows.where("n_targets > 1"), "methods": rows.groupBy("method", "pak").agg(F.count(F.lit(1)).alias("n"))}
