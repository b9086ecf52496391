"""Rows between anchors and texts known from other records get a rendering."""

from __future__ import annotations

from lexiloom.operators import linkage

RECORD = "id string, pak string, source_file string, file_hash string, line_no int, col_no int, key_name string, original string"


def test_gap_and_memory(spark):
    def rows(cells, h, first):
        return [(f"{first}{h}{line}-{col}", "p", h, h, line, col, "", text) for line, col, text in cells]

    left = rows([(2, 1, "k1"), (3, 2, "Ngựa"), (4, 1, "k2"), (9, 2, "Hổ")], "H", "") + rows([(7, 3, "Ngựa")], "J", "")
    right = rows([(12, 1, "k1"), (13, 2, "马"), (14, 1, "k2"), (15, 1, "k3")], "H", "r")
    got = linkage.migrate(spark.createDataFrame(left, RECORD), spark.createDataFrame([*right, *rows([(16, 1, "k4")], "H", "r")], RECORD))
    assert sorted((r.id, r.method, r.target) for r in got.collect()) == [("H3-2", "context_sequence", "马"), ("J7-3", "exact_text_memory", "马")]


def test_plan_is_small(spark):
    """What is selected is part of the last plan as a table, not as a copy of all methods for each time it is read."""
    row = ("1", "p", "f", "H", 2, 1, "", "Ngựa")
    df = spark.createDataFrame([row], RECORD)
    assert linkage.migrate(df, df)._jdf.queryExecution().optimizedPlan().toString().count("Join") <= 10
