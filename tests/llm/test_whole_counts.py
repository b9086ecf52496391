"""Usual lengths come from all pairs, not from a sample of them."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexiloom.llm import pair_defects


def test_usual_lengths_of_rare_kinds(spark, tmp_path):
    common = spark.range(26000).select("id", F.lit("Ngựa của Hổ Lang chạy nhanh gấp ba lần ngựa trạm Báo Tùng.").alias("s"), F.lit("虎狼的马比豹松驿站的马快三倍。").alias("t"), F.lit("zh-CN").alias("l"))
    rare = spark.range(26000, 26012).select("id", F.lit("虎狼的马比豹松驿站的马快三倍，明天一早就要出发。").alias("s"), F.lit("The horse of the tiger wolf is three times faster than the others.").alias("t"), F.lit("en").alias("l"))
    common.unionByName(rare).toDF("tm_id", "source_text", "target_text", "target_lang").write.parquet(f"{tmp_path}/translation_memory.parquet")
    spark.read.parquet("/root/testdata/sf0.001/protected_patterns.parquet").write.parquet(f"{tmp_path}/protected_patterns.parquet")
    usual = pair_defects.judge(spark, str(tmp_path)).usual
    assert ("zh", "en", "text") in usual and ("latin", "zh-CN", "text") in usual


def test_rare_kind_takes_the_coarser_length():
    pairs = [(f"Ngựa của Hổ Lang {w} chạy nhanh gấp {i} lần ngựa trạm Báo Tùng.", f"虎狼的马比豹松驿站的马快{i}倍。", "zh-CN") for i, w in enumerate(["x"] * 20)]
    judge = pair_defects.Judge(pairs, [])
    fields = "Tên: Ngựa Hổ Lang; Nơi: trạm Báo Tùng; Giá: tám mươi đồng bạc trắng"
    assert pair_defects.kind_of(fields) == "fields" and judge.truncated(fields, "名：虎", "zh-CN")
