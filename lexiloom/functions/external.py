"""User functions and models (2.13): scalar functions by name, batch models loaded once per worker, injected clients with bisection."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.operators import dedup


def register_scalar(spark: SparkSession, name: str, fn: Callable[[str | None], str | None]) -> None:
    """a Python function of one string, usable in SQL under ``name``; it runs on Arrow batches."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(fn)

    spark.udf.register(name, run)


def model_udf(load: Callable[[], Callable[[list[str]], list[str]]], batch: int = 32):  # noqa: ANN201
    """a model that ``load`` gives once per worker, called on batches of strings; nulls stay null."""

    @F.pandas_udf("string")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        for s in parts:
            there = s[s.notna()]
            out = pd.Series([None] * len(s), index=s.index, dtype=object)
            for i in range(0, len(there), batch):
                piece = there.iloc[i : i + batch]
                out.loc[piece.index] = model(piece.tolist())
            yield out

    return run


def model_on_distinct(df: DataFrame, column: str, name: str, load: Callable[[], Callable[[list[str]], list[str]]]) -> DataFrame:
    """A model called once per distinct value, the results joined back."""
    udf = model_udf(load)
    return dedup.map_distinct(df, column, lambda values, c, n: values.withColumn(n, udf(F.col(c))), name)


def bisect(texts: list[str], call: Callable[[list[str]], list[str] | None]) -> list[str | None]:
    """a batch that fails is halved until single rows fail, which come out null."""
    if not texts:
        return []
    try:
        got = call(texts)
    except Exception:  # noqa: BLE001
        got = None
    if got is not None and len(got) == len(texts):
        return list(got)
    if len(texts) == 1:
        return [None]
    half = len(texts) // 2
    return bisect(texts[:half], call) + bisect(texts[half:], call)


def client_map(df: DataFrame, key: str, text: str, client: Callable[[list[str]], list[str] | None], batch: int = 25) -> DataFrame:
    """rows through an injected client, in batches with bisection. The number of partitions sets the rate."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            out: list[str | None] = []
            texts = pdf[text].fillna("").tolist()
            for i in range(0, len(texts), batch):
                out += bisect(texts[i : i + batch], client)
            yield pd.DataFrame({key: pdf[key].astype(str), "result": out})

    return df.select(key, text).mapInPandas(run, f"{key} string, result string")
