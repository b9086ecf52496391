"""Fuzzy matching: gram index with a margin (J18), shingle overlap."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexiloom.functions import text as X

# Least length, thresholds by length, margin over the runner-up, weight of the grams.
LEAST_LENGTH, MARGIN, GRAM_WEIGHT = 3, 0.06, 0.72
#: Least threshold less the margin: no lower score decides anything.
LEAST_SCORE = 0.82 - MARGIN
#: Bound on the left shingles that every task gets.
MOST_SHINGLES = 500_000
#: Places of a text that one piece of it gives.
PIECE = 128


def normal_form(c: Column) -> Column:
    s = F.regexp_replace(X.text_or_empty(c), r"<[^>]+>|◈\d+◈|#d\d*|%[-+0-9.]*[a-zA-Z]", "")
    return F.lower(F.regexp_replace(s, r"[\s#，。！？：:；;、（）()\[\]{}<>《》\-—·*'\"]+", ""))


def grams(c: Column) -> Column:
    """Distinct 3-grams of texts of six or more characters, else 2-grams."""
    n = F.when(F.length(c) >= 6, 3).otherwise(2)
    places = F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(c) - n + 1))
    return F.array_distinct(F.filter(F.transform(places, lambda i: F.substr(c, i, n)), lambda g: F.length(g) == n))


@F.pandas_udf(T.DoubleType())
def ratio(a: pd.Series, b: pd.Series, shared: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp similarity of pairs that share grams; 0 where neither it nor their share of grams reaches LEAST_SCORE."""

    def one(x: str, y: str, j: float) -> float:
        m = SequenceMatcher(None, x, y)
        return m.ratio() if j >= LEAST_SCORE or m.quick_ratio() >= LEAST_SCORE else 0.0

    return pd.Series([one(*p) for p in zip(a, b, shared, strict=True)], dtype="float64")


@F.pandas_udf(T.ArrayType(T.StringType()))
def letters(s: pd.Series) -> pd.Series:
    """Characters with their number of occurrence, so that a multiset becomes a set."""

    def numbered(text: str) -> list[str]:
        seen: Counter[str] = Counter()
        out = []
        for ch in text:
            seen[ch] += 1
            out.append(f"{ch}{seen[ch]}")
        return out

    return s.map(numbered)


def prefix_pairs(q: DataFrame, v: DataFrame, tokens: Callable[[Column], Column], share: float, lengths: float = 0.0) -> DataFrame:
    """(q, v) of all texts that can have ``share`` of either token set in common, with lengths of that ratio: they meet on a token of both rare prefixes."""
    a, b = q.select("q", F.explode(tokens(F.col("q"))).alias("g")), v.select("v", F.explode(tokens(F.col("v"))).alias("g"))
    df = b.groupBy("g").agg(F.count(F.lit(1)).alias("df"))

    def prefix(rows: DataFrame, text: str) -> DataFrame:
        w = Window.partitionBy(text).orderBy("df", "g")
        n = F.count(F.lit(1)).over(Window.partitionBy(text))
        keep = F.row_number().over(w) <= n - F.ceil(n * F.lit(share) - 1e-9) + 1
        return rows.join(df, "g", "left").fillna(0, ["df"]).withColumn("_k", keep).where("_k").select(text, "g")

    return prefix(a, "q").join(prefix(b, "v"), "g").where(F.least(F.length("q"), F.length("v")) >= F.greatest(F.length("q"), F.length("v")) * lengths).select("q", "v").distinct()


def marker(c: Column) -> Column:
    first = F.substring(c, 1, 1)
    return F.when(first.isin("$", "#", "="), first).otherwise("")


def gram_matches(queries: DataFrame, index: DataFrame) -> DataFrame:
    """(query, match, score) where the best candidate passes its threshold and leads by MARGIN.

    queries(query), index(value). Equal normal forms match first. Other candidates share a gram, and only those whose score can
    reach the least threshold less the margin matter, as best or as runner-up. Such a score needs that ratio among the
    characters in common (similarity or containment) or among the grams (the weighted mean); prefix filters on the rarest
    characters and grams lose no pair of either kind.
    """
    asked = queries.select(normal_form(F.col("query")).alias("q"), marker(F.col("query")).alias("m")).where(F.length("q") >= LEAST_LENGTH).distinct()
    values = index.select(normal_form(F.col("value")).alias("v"), F.col("value")).where((F.length("v") >= LEAST_LENGTH) & X.contains_cjk(F.col("v"))).distinct()
    v = values.select("v").distinct()
    exact = asked.select(F.col("q"), F.col("q").alias("v")).distinct().join(v, "v", "left_semi").select("q", "v", F.lit(1.0).alias("score"))
    q = asked.select("q").distinct().join(exact, "q", "left_anti")
    # common >= LEAST_SCORE * (a + b) / 2 and common <= b give common >= a * least, and the same for the lengths.
    least = LEAST_SCORE / (2 - LEAST_SCORE)
    near = prefix_pairs(q, v, letters, least, least - 1e-9).unionByName(prefix_pairs(q, v, grams, LEAST_SCORE)).distinct()
    near = near.withColumns({"gq": grams(F.col("q")), "gv": grams(F.col("v"))}).withColumn("c", F.size(F.array_intersect("gq", "gv"))).where("c > 0")
    near = near.select("q", "v", (F.col("c") / (F.size("gq") + F.size("gv") - F.col("c"))).alias("j"))
    inside = F.when(F.col("q").contains(F.col("v")) | F.col("v").contains(F.col("q")), F.least(F.length("q"), F.length("v")) / F.greatest(F.length("q"), F.length("v"))).otherwise(0.0)
    scored = near.withColumn("r", ratio("q", "v", "j")).withColumn("score", F.greatest(F.col("r"), F.col("j") * GRAM_WEIGHT + F.col("r") * (1 - GRAM_WEIGHT), inside))
    w = Window.partitionBy("q").orderBy(F.desc("score"), F.desc("v"))
    top = scored.withColumn("_rn", F.row_number().over(w)).withColumn("second", F.coalesce(F.lead("score").over(w), F.lit(0.0))).where("_rn = 1")
    threshold = F.when(F.length("q") < 7, 0.92).when(F.length("q") < 14, 0.86).otherwise(0.82)
    good = exact.unionByName(top.where((F.col("score") >= threshold) & (F.col("score") - F.col("second") >= MARGIN)).select("q", "v", "score"))
    # Of several texts with one normal form, the one with the query's marker.
    picks = values.groupBy("v", marker(F.col("value")).alias("m")).agg(F.min("value").alias("own"), F.count(F.lit(1)).alias("n"))
    alone = values.groupBy("v").agg(F.min("value").alias("only"), F.count(F.lit(1)).alias("n_all"))
    rows = good.join(asked, "q").join(picks, ["v", "m"], "left").join(alone, "v")
    match = F.when(F.col("n") == 1, F.col("own")).when(F.col("n_all") == 1, F.col("only"))
    return rows.select(F.col("q").alias("query"), match.alias("match"), F.round("score", 4).alias("score")).where("match is not null").distinct()


def shingle_votes(left: DataFrame, right: DataFrame, width: int = 8, least: int = 2) -> DataFrame:
    """Pairs of texts with at least ``least`` common character shingles; exact matches first, and not again.

    left(l_id, text), right(r_id, text). Every shingle votes for all right ids that hold it, and every right id with an equal
    text is an exact match. Right rows move once, by their id; left shingles go to every task up to MOST_SHINGLES of them,
    beyond which the join is Spark's own, with AQE's skew handling for frequent shingles.
    """

    def norm(rows: DataFrame, key: str) -> DataFrame:
        return rows.where(F.col(key).isNotNull()).select(key, normal_form(F.col("text")).alias("t")).where("t != ''")

    def cut(rows: DataFrame, *keys: str) -> DataFrame:
        # Places in UTF-8 are found from the start of a string, so long texts are cut into pieces first.
        starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.length("t") - width + 1), F.lit(PIECE))
        pieces = rows.select(*keys, F.explode(F.transform(starts, lambda i: F.substr(F.col("t"), i, F.lit(PIECE + width - 1)))).alias("p"))
        places = F.sequence(F.lit(1), F.greatest(F.lit(1), F.length("p") - width + 1))
        return pieces.select(*keys, F.explode(F.transform(places, lambda i: F.substr(F.col("p"), i, F.lit(width)))).alias("s"))

    a = norm(left, "l_id").withColumn("x", F.md5(F.col("t").cast("binary"))).distinct()
    b = norm(right, "r_id").repartition("r_id")
    exact = a.join(b.dropDuplicates(["r_id", "t"]), "t").select("l_id", "x", "r_id").distinct()
    asked = cut(a.join(exact.select("x").distinct(), "x", "left_anti").dropDuplicates(["x"]), "x").distinct()
    known = asked.select("s").distinct()
    if asked.limit(MOST_SHINGLES + 1).count() <= MOST_SHINGLES:
        asked, known = F.broadcast(asked), F.broadcast(known)
    held = cut(b, "r_id").join(known, "s", "left_semi").distinct()
    votes = held.join(asked, "s").groupBy("x", "r_id").agg(F.count(F.lit(1)).alias("votes")).where(F.col("votes") >= least)
    votes = votes.join(a.select("x", "l_id").distinct(), "x").groupBy("l_id", "r_id").agg(F.max("votes").alias("votes"))
    return exact.select("l_id", "r_id", F.lit(0).cast("long").alias("votes"), F.lit("exact").alias("how")).distinct().unionByName(votes.withColumn("how", F.lit("shingles")))
