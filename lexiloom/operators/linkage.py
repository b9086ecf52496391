"""Linkage of two versions of a record set: candidate joins by method, priority selection with conflict stop, gap and ordinal joins.

Every operator takes frames with the columns id, pak, source_file, file_hash, line_no, col_no, key_name, original, and gives
candidates (id, method, target). All joins are equi-joins on aggregated keys; ratios and gates are HAVINGs on counts that are
taken before cells are joined. Nothing is collected, and no group of rows reaches one task as a list.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexiloom.functions import patterns as P
from lexiloom.functions import text as X
from lexiloom.operators.shared import settled

LOCATOR = ["file_hash", "line_no", "col_no"]


def one_value(rows: DataFrame, keys: list[str], value: str, name: str) -> DataFrame:
    """Keys with a single distinct value: min = max, which aggregates on the map side where a set would not."""
    return rows.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.min(value).alias(name), F.max(value).alias("_hi")).where(F.col(name) == F.col("_hi")).drop("_hi")


def unique_locator(left: DataFrame, right: DataFrame) -> DataFrame:
    """Same (hash, line, column), where the other version has one text there."""
    return left.select("id", *LOCATOR).join(one_value(right, LOCATOR, "original", "target"), LOCATOR).select("id", F.lit("hash_locator_unique").alias("method"), "target")


def first_wins_locator(left: DataFrame, right: DataFrame) -> DataFrame:
    """Same locator, first row of the other version that holds CJK text."""
    first = right.where(X.contains_cjk(F.col("original"))).groupBy(*LOCATOR).agg(F.min_by("original", F.struct("source_file", "id")).alias("target"))
    return left.select("id", *LOCATOR).join(first, LOCATOR, "left").select("id", F.lit("first_wins").alias("method"), "target")


def primary_keys(rows: DataFrame) -> DataFrame:
    """(file_hash, row_key) to line, for keys (the first column's text) that occur on one line of the file."""
    return one_value(rows.where((F.col("col_no") == 1) & (F.trim("original") != "")).select("file_hash", F.trim("original").alias("row_key"), "line_no"), ["file_hash", "row_key"], "line_no", "line_no")


def primary_key_join(left: DataFrame, right: DataFrame) -> DataFrame:
    """Files of one hash, rows joined by their unique first cell, cells by column."""
    lines = primary_keys(left).withColumnRenamed("line_no", "l_line").join(primary_keys(right).withColumnRenamed("line_no", "r_line"), ["file_hash", "row_key"]).select("file_hash", "l_line", "r_line")
    cells = one_value(right, LOCATOR, "original", "target").withColumnRenamed("line_no", "r_line")
    rows = left.select("id", "file_hash", F.col("line_no").alias("l_line"), "col_no").join(lines, ["file_hash", "l_line"])
    return rows.join(cells, ["file_hash", "r_line", "col_no"]).select("id", F.lit("tsv_primary_key").alias("method"), "target")


def stable_token(c: Column) -> Column:
    """Typed token of a cell that translation leaves alone: item codes, paths, numbers, ASCII codes."""
    s = F.trim(X.text_or_empty(c))
    return (
        F.when(s == "", None)
        .when(s.rlike(r"^\d+\.\d+\.\d+\.\d+$"), F.concat(F.lit("I:"), s))
        .when(s.rlike(r"^[\\/][A-Za-z0-9_./\\:-]+$"), F.concat(F.lit("P:"), F.lower(s)))
        .when(s.rlike(r"^[+-]?\d+(?:\.\d+)?[%‰]?$"), F.concat(F.lit("N:"), F.regexp_replace(s, r"^\++", "")))
        .when(s.rlike(r"^[A-Za-z0-9_./\\:-]{2,}$"), F.concat(F.lit("A:"), F.lower(s)))
    )


def row_signatures(rows: DataFrame, least: int) -> DataFrame:
    """(file_hash, line_no, signature) of rows with at least ``least`` stable cells, where the signature is the file's only one.

    A row has as many cells as its file has columns, which bounds the list.
    """
    cells = rows.withColumn("t", stable_token(F.col("original"))).where("t is not null and line_no > 1")
    sig = cells.groupBy("file_hash", "line_no").agg(F.array_sort(F.collect_list(F.struct("col_no", "t"))).alias("s")).where(F.size("s") >= least)
    sig = sig.select("file_hash", "line_no", F.md5(F.to_json("s")).alias("signature"))
    return one_value(sig, ["file_hash", "signature"], "line_no", "line_no")


def signature_join(left: DataFrame, right: DataFrame, least: int = 2) -> DataFrame:
    """Rows with the same unique signature; cells by column."""
    lines = row_signatures(left, least).withColumnRenamed("line_no", "l_line").join(row_signatures(right, least).withColumnRenamed("line_no", "r_line"), ["file_hash", "signature"]).select("file_hash", "l_line", "r_line")
    cells = one_value(right, LOCATOR, "original", "target").withColumnRenamed("line_no", "r_line")
    rows = left.select("id", "file_hash", F.col("line_no").alias("l_line"), "col_no").join(lines, ["file_hash", "l_line"])
    return rows.join(cells, ["file_hash", "r_line", "col_no"]).select("id", F.lit("tsv_row_signature").alias("method"), "target")


def overlap_pairs(left: DataFrame, right: DataFrame, key: str, least: int = 5, many: int = 20, share: float = 0.45, strong: float = 0.90) -> DataFrame:
    """Pairs of files that share enough unique keys: (l_file, r_file, common, rate)."""
    a = left.select(F.col("source_file").alias("l_file"), key).distinct()
    b = right.select(F.col("source_file").alias("r_file"), key).distinct()
    sizes = a.groupBy("l_file").agg(F.count(F.lit(1)).alias("n_l")), b.groupBy("r_file").agg(F.count(F.lit(1)).alias("n_r"))

    # A key counts for every pair of files that hold it. Keys held by the same files on both sides are counted together first, so
    # that a table stored under many paths gives each pair once and not once a key.
    def held(rows: DataFrame, file: str, side: str) -> DataFrame:
        marks = [F.bit_xor(F.xxhash64(file)).alias(f"{side}_x"), F.bit_xor(F.xxhash64(F.lit(side), file)).alias(f"{side}_y"), F.count(F.lit(1)).alias(f"{side}_k")]
        return rows.groupBy(key).agg(*marks)

    groups = held(a, "l_file", "l").join(held(b, "r_file", "r"), key).groupBy("l_x", "l_y", "l_k", "r_x", "r_y", "r_k").agg(F.min(key).alias(key), F.count(F.lit(1)).alias("_n"))
    pairs = groups.select(key, "_n").join(a, key).join(b, key).groupBy("l_file", "r_file").agg(F.sum("_n").alias("common"))
    rate = F.col("common") / F.least("n_l", "n_r")
    out = pairs.join(sizes[0], "l_file").join(sizes[1], "r_file").withColumn("rate", rate)
    return out.where((F.col("common") >= least) & (((F.col("common") >= many) & (F.col("rate") >= share)) | (F.col("rate") >= strong))).select("l_file", "r_file", "common", "rate")


def composite_key_join(left: DataFrame, right: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Rows joined on a composite key that is unique on both sides; gives the keys, the left and the right value."""
    a, b = one_value(left, keys, value, "l_value"), one_value(right, keys, value, "r_value")
    return a.join(b, keys)


def content_evidence(left: DataFrame, right: DataFrame, least_text: int = 2, strength: int = 4) -> DataFrame:
    """Pairs of files with common content anchors (CJK text without blanks) or resource paths, and a confidence."""

    def anchors(rows: DataFrame, name: str) -> DataFrame:
        t = F.trim(X.text_or_empty("original"))
        content = F.when((F.length(t) >= 2) & X.contains_cjk(t) & ~t.rlike(P.VIETNAMESE), F.regexp_replace(X.exchange_text(t), r"\s+", ""))
        path = F.lower(F.regexp_replace(t, "/", r"\\"))
        path = F.when(F.concat(F.lit(" "), path).rlike(r"(?i)(?:^|[=\s])(?:[A-Za-z]:)?[\\/](?:spr|script|ui|settings|maps?|resource)[\\/]"), path)
        both = rows.select(F.col("source_file").alias(name), F.explode(F.array(F.struct(F.lit("text").alias("k"), content.alias("a")), F.struct(F.lit("path").alias("k"), path.alias("a")))).alias("x"))
        return both.select(name, "x.k", "x.a").where("a is not null").distinct()

    a, b = anchors(left, "l_file"), anchors(right, "r_file")
    # An anchor in many files gives files x files pairs, bounded by the number of distinct files, not of rows.
    counts = a.join(b, ["k", "a"]).groupBy("l_file", "r_file").agg(F.count_if(F.col("k") == "text").alias("exact_text"), F.count_if(F.col("k") == "path").alias("resource_path"))
    power = F.col("exact_text") + F.col("resource_path") * 2
    out = counts.where((F.col("exact_text") >= least_text) | (F.col("resource_path") >= 1) | (power >= strength))
    return out.withColumn("confidence", F.round(F.least(F.lit(0.99), F.lit(0.93) + F.least(F.lit(0.04), power * 0.005)), 4))


def structure_join(left: DataFrame, right: DataFrame) -> DataFrame:
    """Equal locators in files whose whole layout (number of rows, places and keys) is the same."""

    def layout(rows: DataFrame) -> DataFrame:
        cell = F.xxhash64("line_no", "col_no", X.text_or_empty("key_name"))
        return rows.groupBy("file_hash").agg(F.countDistinct("line_no", "col_no").alias("n"), F.bit_xor(cell).alias("x"), F.max("line_no").alias("m"))

    same = layout(left.dropDuplicates(LOCATOR)).join(layout(right.dropDuplicates(LOCATOR)), ["file_hash", "n", "x", "m"]).select("file_hash")
    cells = one_value(right, LOCATOR, "original", "target").join(same, "file_hash", "left_semi")
    return left.select("id", *LOCATOR).join(cells, LOCATOR).select("id", F.lit("strict_locator").alias("method"), "target")


def soft_locator(left: DataFrame, right: DataFrame, least: float = 0.94) -> DataFrame:
    """Equal locators in files of one hash that share at least ``least`` of the smaller one's places."""
    a, b = left.select(*LOCATOR).distinct(), right.select(*LOCATOR).distinct()
    common = a.join(b, LOCATOR).groupBy("file_hash").agg(F.count(F.lit(1)).alias("c"))
    sizes = a.groupBy("file_hash").agg(F.count(F.lit(1)).alias("na")).join(b.groupBy("file_hash").agg(F.count(F.lit(1)).alias("nb")), "file_hash")
    good = common.join(sizes, "file_hash").where(F.col("c") / F.least("na", "nb") >= least).select("file_hash")
    cells = one_value(right, LOCATOR, "original", "target").join(good, "file_hash", "left_semi")
    return left.select("id", *LOCATOR).join(cells, LOCATOR).select("id", F.lit("same_hash_locator_soft").alias("method"), "target")


def ordinal_join(left: DataFrame, right: DataFrame) -> DataFrame:
    """Files of one hash with as many records: the n-th with the n-th."""
    w = Window.partitionBy("file_hash").orderBy("line_no", "col_no", "id")
    n = Window.partitionBy("file_hash")
    a = left.select("id", "file_hash", F.row_number().over(w).alias("nth"), F.count(F.lit(1)).over(n).alias("n"))
    b = right.select("file_hash", F.row_number().over(w).alias("nth"), F.count(F.lit(1)).over(n).alias("n"), F.col("original").alias("target"))
    return a.join(b, ["file_hash", "n", "nth"]).select("id", F.lit("same_hash_near_order").alias("method"), "target")


def section_lines(lines: DataFrame, partition: str = "source_file", order: str = "line_no", text: str = "line") -> DataFrame:
    """Every line with the section header above it."""
    header = F.regexp_extract(F.col(text), r"^\s*\[([^\]\r\n]+)\]\s*$", 1)
    w = Window.partitionBy(partition).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return lines.withColumn("section", F.last(F.when(header != "", header), ignorenulls=True).over(w))


def key_join(left: DataFrame, right: DataFrame) -> DataFrame:
    """Key of a file (with its section where there is one) that is unique on both sides."""
    keys = ["file_hash", *(["section"] if "section" in left.columns else []), "key_name"]
    named = right.where("key_name is not null and key_name != ''")
    once = left.where("key_name is not null and key_name != ''").groupBy(*keys).agg(F.min("id").alias("id"), F.max("id").alias("_hi")).where("id = _hi").drop("_hi")
    return once.join(one_value(named, keys, "original", "target"), keys).select("id", F.lit("ini_section_key").alias("method"), "target")


def key_occurrence_join(left: DataFrame, right: DataFrame) -> DataFrame:
    """The n-th occurrence of a key, where both files have it as often."""
    keys = ["file_hash", "key_name"]
    w, n = Window.partitionBy(*keys).orderBy("line_no", "col_no", "id"), Window.partitionBy(*keys)

    def nth(rows: DataFrame) -> DataFrame:
        return rows.where("key_name is not null and key_name != ''").withColumn("nth", F.row_number().over(w)).withColumn("n", F.count(F.lit(1)).over(n))

    return nth(left).select("id", *keys, "nth", "n").join(nth(right).select(*keys, "nth", "n", F.col("original").alias("target")), [*keys, "nth", "n"]).select("id", F.lit("ini_key_occurrence").alias("method"), "target")


def gap_join(anchors: DataFrame, left: DataFrame, right: DataFrame, longest: int = 12) -> DataFrame:
    """Rows between two neighbouring anchors whose gap is the same on both sides, paired by their offset.

    anchors: (file_hash, l_line, r_line). The gap bounds the rows that an anchor gives.
    """
    w = Window.partitionBy("file_hash").orderBy("l_line", "r_line")
    pairs = anchors.withColumn("l_next", F.lead("l_line").over(w)).withColumn("r_next", F.lead("r_line").over(w))
    gap = F.col("l_next") - F.col("l_line")
    pairs = pairs.where((gap > 1) & (gap <= longest) & (gap == F.col("r_next") - F.col("r_line")))
    lines = pairs.withColumn("k", F.explode(F.sequence(F.lit(1), (gap - 1).cast("int")))).select("file_hash", (F.col("l_line") + F.col("k")).alias("l_line"), (F.col("r_line") + F.col("k")).alias("r_line"))
    cells = one_value(right, LOCATOR, "original", "target").withColumnRenamed("line_no", "r_line")
    rows = left.select("id", "file_hash", F.col("line_no").alias("l_line"), "col_no").join(lines, ["file_hash", "l_line"])
    return rows.join(cells, ["file_hash", "r_line", "col_no"]).select("id", F.lit("context_sequence").alias("method"), "target")


def exact_memory(left: DataFrame, pairs: DataFrame) -> DataFrame:
    """Texts whose known renderings (source, target) agree."""
    memory = one_value(pairs.withColumn("_k", X.normal_key(F.col("source"))).where("_k != ''"), ["_k"], "target", "target")
    return left.select("id", X.normal_key(F.col("original")).alias("_k")).join(memory, "_k").select("id", F.lit("exact_text_memory").alias("method"), "target")


def block_join(left: DataFrame, right: DataFrame, blocks: DataFrame) -> DataFrame:
    """Listed blocks (l_hash, r_hash, l_start, r_start, n_rows) of two files, aligned by offset."""
    a = left.join(blocks, left.file_hash == blocks.l_hash).where((F.col("line_no") >= F.col("l_start")) & (F.col("line_no") < F.col("l_start") + F.col("n_rows")))
    a = a.select("id", "r_hash", (F.col("line_no") - F.col("l_start") + F.col("r_start")).alias("r_line"), "col_no")
    cells = one_value(right, LOCATOR, "original", "target").select(F.col("file_hash").alias("r_hash"), F.col("line_no").alias("r_line"), "col_no", "target")
    return a.join(cells, ["r_hash", "r_line", "col_no"]).select("id", F.lit("block").alias("method"), "target")


def keeps(original: Column, target: Column) -> Column:
    """Whether a rendering differs from its text, is CJK and keeps its tokens, whose comparison costs most and comes last."""
    return (target != original) & X.contains_cjk(target) & X.same_tokens(original, target)


def valid(candidates: DataFrame, left: DataFrame) -> DataFrame:
    """Candidates that keep the record's tokens, are CJK and differ from it; each once.

    Methods often agree, so a target is judged once for all that give it.
    """
    pairs = candidates.where(X.contains_cjk(F.col("target"))).groupBy("id", "target").agg(F.collect_set("method").alias("_m"))
    rows = pairs.join(left.select("id", F.col("original").alias("_o")).dropDuplicates(["id"]), "id")
    return rows.where(keeps(F.col("_o"), F.col("target"))).select("id", F.explode("_m").alias("method"), "target")


def select_candidates(candidates: DataFrame, methods: tuple[str, ...] = P.METHODS) -> DataFrame:
    """(id, method, target, n_targets): of each id the method of highest priority; several targets there are a conflict.

    A conflict has a null target: methods of lower priority are not asked.
    """
    rank = F.coalesce(*(F.when(F.col("method") == m, F.lit(i)) for i, m in enumerate(methods)), F.lit(len(methods)))
    per = candidates.withColumn("rank", rank).groupBy("id", "method", "rank").agg(F.countDistinct("target").alias("n_targets"), F.min("target").alias("target"))
    best = per.groupBy("id").agg(F.min_by(F.struct("method", "target", "n_targets"), "rank").alias("b"))
    return best.select("id", "b.method", F.when(F.col("b.n_targets") == 1, F.col("b.target")).alias("target"), "b.n_targets")


def migrate(left: DataFrame, right: DataFrame) -> DataFrame:
    """The methods within files of one hash together: candidates (J14 between primary keys), validation, selection.

    What is selected then is the memory (J15) for records without a rendering. The cell joins across files of different hashes
    (J6, J7, J16) are not part of it. Both versions and the selection are written once and read from there: each of the methods
    reads the versions several times, and the memory reads the selection several times, which in one plan is too much for a driver.
    """
    left, right = (settled(rows.select("id", *LOCATOR, "key_name", "original")) for rows in (left, right))
    methods = (unique_locator, primary_key_join, signature_join, key_join, structure_join, key_occurrence_join, ordinal_join, soft_locator)
    keys = [primary_keys(rows).withColumnRenamed("line_no", line) for rows, line in ((left, "l_line"), (right, "r_line"))]
    anchors = keys[0].join(keys[1], ["file_hash", "row_key"]).select("file_hash", "l_line", "r_line")
    found = reduce(DataFrame.unionByName, [*(m(left, right) for m in methods), gap_join(anchors, left, right)])
    chosen = settled(select_candidates(valid(found, left)))
    # Texts are dealt out by id once, for their distinct rows as for the join.
    known = left.select("id", "original").repartition("id").distinct().join(chosen.where("target is not null").select("id", "target"), "id", "left")
    memory = one_value(known.where("trim(original) != ''"), ["original"], "target", "target")
    more = known.where("target is null").drop("target").join(memory, "original").where(keeps(F.col("original"), F.col("target")))
    more = select_candidates(more.select("id", F.lit("exact_text_memory").alias("method"), "target"))
    return chosen.join(more.select("id"), "id", "left_anti").unionByName(more)


def apply_selected(records: DataFrame, selected: DataFrame) -> DataFrame:
    """M7: the records with the selected renderings put in, and the method in the note."""
    rows = records.join(selected.where("target is not null").select("id", F.col("target").alias("_t"), F.col("method").alias("_m")), "id", "left")
    return rows.withColumns({"source_original": F.when(F.col("_t").isNotNull(), F.coalesce("source_original", "original")).otherwise(F.col("source_original")), "original": F.coalesce("_t", "original"), "note": F.coalesce("_m", "note")}).drop("_t", "_m")


def inventory_diff(before: DataFrame, after: DataFrame, name: str, compared: list[str]) -> DataFrame:
    """Full outer comparison on a name: ``added``, ``removed`` or ``changed``; equal rows drop out."""
    a = before.select(name, *[F.col(c).alias(f"old_{c}") for c in compared], F.lit(True).alias("_a"))
    b = after.select(name, *[F.col(c).alias(f"new_{c}") for c in compared], F.lit(True).alias("_b"))
    differs = reduce(lambda x, y: x | y, (~F.col(f"old_{c}").eqNullSafe(F.col(f"new_{c}")) for c in compared))
    state = F.when(F.col("_a").isNull(), "added").when(F.col("_b").isNull(), "removed").when(differs, "changed")
    return a.join(b, name, "full_outer").withColumn("state", state).where("state is not null").drop("_a", "_b")


def file_relation(left: DataFrame, right: DataFrame) -> DataFrame:
    """Files of one hash, ranked by how alike their layouts are: same digest, same places, else share of common places."""

    def shape(rows: DataFrame, p: str) -> DataFrame:
        return rows.groupBy("file_hash").agg(F.bit_xor(F.xxhash64("line_no", "col_no", "original")).alias(f"{p}_digest"), F.countDistinct("line_no", "col_no").alias(f"{p}_n"))

    common = left.select(*LOCATOR).distinct().join(right.select(*LOCATOR).distinct(), LOCATOR).groupBy("file_hash").agg(F.count(F.lit(1)).alias("common"))
    rows = shape(left, "l").join(shape(right, "r"), "file_hash").join(common, "file_hash", "left").fillna(0, ["common"])
    share = F.col("common") / F.least("l_n", "r_n")
    score = F.when(F.col("l_digest") == F.col("r_digest"), 100).when((F.col("l_n") == F.col("r_n")) & (share == 1), 98).when(share >= 0.94, 95).when(share >= 0.8, 92).when(share >= 0.5, 85).otherwise(82)
    return rows.select("file_hash", "common", score.alias("score"))


def neighbourhood(rows: DataFrame, shape: Column) -> DataFrame:
    """Each row with a signature of the shapes two rows before and after it, by file."""
    w = Window.partitionBy("file_hash").orderBy("line_no", "col_no", "id")
    near = [F.coalesce(F.lag(shape, k).over(w) if k > 0 else F.lead(shape, -k).over(w), F.lit("")) for k in (2, 1, -1, -2)]
    return rows.withColumn("neighbourhood", F.concat_ws("\x1f", *near))
