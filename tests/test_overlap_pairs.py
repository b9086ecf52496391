"""Keys that several files of a side hold count for each of their pairs."""

from __future__ import annotations

from lexiloom.operators import linkage


def test_shared_keys_count(spark):
    left = [(f, f"k{i}") for f in ("a", "copy of a") for i in range(8)] + [("b", f"k{i}") for i in range(6, 16)]
    right = [("r", f"k{i}") for i in range(8)] + [("s", f"k{i}") for i in range(6, 16)]
    rows = [spark.createDataFrame(x, "source_file string, k string") for x in (left, right)]
    got = sorted(map(tuple, linkage.overlap_pairs(*rows, "k").collect()))
    assert got == [("a", "r", 8, 1.0), ("b", "s", 10, 1.0), ("copy of a", "r", 8, 1.0)]
