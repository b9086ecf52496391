"""The words that decide TCVN3 repairs are counted over all values."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from lexiloom.llm import mojibake


def test_words_of_all_values(spark, tmp_path):
    # Every word stands in three values of 40,000, a few of which any sample leaves out.
    syllables = [a + "ường" for a in ("b", "c", "d", "g", "h", "l", "m", "n", "s", "t", "v", "x")]
    rare = [(w,) for w in syllables for _ in range(3)]
    rows = spark.range(40000).select(F.lit("Đã mở cổng").alias("v")).unionByName(spark.createDataFrame(rare, "v string")).coalesce(2).withColumn("k", F.monotonically_increasing_id())
    rows.select(F.col("k").alias("id"), F.col("v").alias("original")).write.parquet(f"{tmp_path}/text_records.parquet")
    rows.limit(10).select(F.col("k").alias("tm_id"), F.col("v").alias("source_text"), F.col("v").alias("target_text")).write.parquet(f"{tmp_path}/translation_memory.parquet")
    seen = []
    with pytest.MonkeyPatch.context() as m:
        real = mojibake.Repairer
        m.setattr(mojibake, "Repairer", lambda counts, words: seen.append(words) or real(counts, words))
        mojibake.repairer(spark, str(tmp_path))
    assert set(syllables) <= seen[-1]
