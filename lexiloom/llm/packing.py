"""Problem 7: filling containers of a fixed capacity with texts, measured in tokens of a public tokenizer.

Method: bounded-space online best fit. A fixed number of bins is open; a bitset keyed by free space finds the fullest bin in
which an item fits; when a new bin is needed and none may be opened, the fullest open bin closes. Only texts longer than
the capacity are split, into full containers and one remainder that is packed like any item.

Texts are tokenized once; only (id, tokens) travels on, to one task per shard and capacity. A shard holds about SHARD_ITEMS
items, so a task's memory has a bound; the price is at most OPEN_BINS bins left partly empty per shard and capacity.

Defined results: null texts and texts without a token go into no container. Repeated ids are packed as often as they occur,
told apart by the order in their shard. A null or non-positive capacity has no result. Whole texts count, at any length.
"""

from __future__ import annotations

import base64
import math
from collections.abc import Iterator
from functools import cache

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.llm.common import map_columns, spread, table

#: Vocabulary of the tokenizer; a parameter of ``packed``.
TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
# Fixed value: the public pattern that splits text before the merges of byte-level BPE vocabularies.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
OPEN_BINS, SHARD_ITEMS = 64, 50_000


@cache
def tokenizer(path: str):  # noqa: ANN201
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


class BestFit:
    """Open bins in a bitset: bit ``f`` is set while a bin with ``f`` free tokens is open."""

    def __init__(self, capacity: int, open_bins: int = OPEN_BINS) -> None:
        self.capacity, self.limit = capacity, open_bins
        self.mask, self.count, self.next = 0, 0, 0
        self.bins: dict[int, list[int]] = {}

    def _open(self, free: int, name: int) -> None:
        if free:
            self.bins.setdefault(free, []).append(name)
            self.mask |= 1 << free
            self.count += 1

    def _take(self, free: int) -> int:
        names = self.bins[free]
        name = names.pop()
        if not names:
            del self.bins[free]
            self.mask &= ~(1 << free)
        self.count -= 1
        return name

    def add(self, size: int) -> tuple[int, int]:
        """The bin of an item of 1 to ``capacity`` tokens, and the place of its first token there."""
        fits = self.mask >> size
        if fits:
            free = size + (fits & -fits).bit_length() - 1
            name = self._take(free)
        else:
            if self.count >= self.limit:  # the fullest bin closes
                self._take((self.mask & -self.mask).bit_length() - 1)
            free, name = self.capacity, self.next
            self.next += 1
        self._open(free - size, name)
        return name, self.capacity - free

    def add_text(self, size: int) -> Iterator[tuple[int, int, int, int, int]]:
        """(part, first token of the text, tokens, bin, place) of every part of a text of any length."""
        whole, rest = divmod(size, self.capacity)
        if size <= self.capacity:
            whole, rest = 0, size
        for part in range(whole):
            self.next += 1
            yield part, part * self.capacity, self.capacity, self.next - 1, 0
        if rest:
            name, at = self.add(rest)
            yield whole, whole * self.capacity, rest, name, at


def sizes(docs: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """(doc_id, n_tokens) of every document with a token."""

    def run(doc_id: list, text: list) -> dict[str, list]:
        encode = tokenizer(path).encode_ordinary
        return {"doc_id": doc_id, "n_tokens": [len(encode(t)) if t else 0 for t in text]}

    return map_columns(spread(docs.select("doc_id", "text")), run, "doc_id bigint, n_tokens int").where("n_tokens > 0 and doc_id is not null")


SCHEMA = "limit_name string, capacity_tokens int, shard int, bin_no bigint, doc_id bigint, part_no int, first_token int, n_tokens int, place int"


def pack_shard(rows: pd.DataFrame) -> pd.DataFrame:
    name, capacity, shard = rows["limit_name"].iat[0], int(rows["capacity_tokens"].iat[0]), int(rows["shard"].iat[0])
    rows = rows.sort_values(["doc_id", "n_tokens"], kind="stable")
    bins = BestFit(capacity)
    out = [(doc, *part) for doc, n in zip(rows["doc_id"].tolist(), rows["n_tokens"].tolist(), strict=True) for part in bins.add_text(n)]
    doc, part, first, n, which, place = zip(*out, strict=True)
    return pd.DataFrame({"limit_name": name, "capacity_tokens": capacity, "shard": shard, "bin_no": which, "doc_id": doc, "part_no": part, "first_token": first, "n_tokens": n, "place": place})


def packed(docs: DataFrame, limits: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """One row per whole text, or per part of a text longer than the capacity, with its container (limit_name, shard, bin_no)."""
    shards = max(1, math.ceil(docs.count() / SHARD_ITEMS))
    capacities = sorted((r.limit_name, r.capacity_tokens) for r in limits.where("capacity_tokens > 0 and limit_name is not null").select("limit_name", "capacity_tokens").distinct().limit(1000).collect())
    if not capacities:
        return docs.sparkSession.createDataFrame([], SCHEMA)
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("limit_name"), F.lit(c).alias("capacity_tokens")) for n, c in capacities]))
    rows = sizes(docs, path).withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("int")).withColumn("limit", each)
    return rows.select("doc_id", "n_tokens", "shard", "limit.limit_name", "limit.capacity_tokens").groupBy("limit_name", "capacity_tokens", "shard").applyInPandas(pack_shard, SCHEMA)


def p7_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(table(spark, sf_dir, "documents"), table(spark, sf_dir, "pack_limits"))


def p7_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers, tokens and the share of space in use, of each capacity."""
    rows = p7_packed(spark, sf_dir)
    bins = rows.groupBy("limit_name", "capacity_tokens", "shard", "bin_no").agg(F.sum("n_tokens").alias("used"))
    return bins.groupBy("limit_name", "capacity_tokens").agg(
        F.count(F.lit(1)).alias("n_bins"), F.sum("used").alias("n_tokens"), F.round(F.sum("used") / (F.count(F.lit(1)) * F.col("capacity_tokens")), 4).alias("fill")
    )


QUERIES = {"p7_packed": p7_packed, "p7_fill": p7_fill}
