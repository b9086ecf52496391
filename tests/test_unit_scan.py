"""Documents with every kind of line end give cells."""

from __future__ import annotations

import re

from lexiloom.plans import texts


def test_line_ends(spark, tmp_path):
    docs = [(1, "a\tb\r\nc\td"), (2, "e\rf\tg"), (3, "h\ti\nj"), (4, "k\r\n\r\nl\tm\r\n")]
    spark.createDataFrame(docs, "doc_id int, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, texts.unit_scan_all_cells(spark, str(tmp_path)).collect()))
    want = [(i, n, m, c) for i, t in docs for n, line in enumerate(re.split("\r\n|\r|\n", t), 1) for m, c in enumerate(line.split("\t"), 1) if c.strip()]
    assert got == sorted(want)
