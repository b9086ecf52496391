"""Model replies (2.12): tolerant JSON, positional arrays, framed rows, streamed objects, request payloads."""

from __future__ import annotations

import ast
import json
import re
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Names under which replies carry an id and a text.
ID_NAMES = ("id", "ID", "mapping_id", "row_id", "编号")
TEXT_NAMES = ("text", "translation", "translated", "译文", "zh", "中文")
ITEMS = T.ArrayType(T.StructType([T.StructField("id", T.StringType()), T.StructField("text", T.StringType())]))


def items_of(values: list) -> list[tuple[str, str]]:
    out = []
    for v in values:
        if isinstance(v, dict):
            key, text = (next((v[n] for n in names if v.get(n)), None) for names in (ID_NAMES, TEXT_NAMES))
            if key is not None and text is not None:
                out.append((str(key), str(text)))
    return out


def objects(text: str) -> Iterator[str]:
    """Balanced ``{...}`` spans, strings respected; what is cut off at the end is left out."""
    depth, start, quoted, escaped = 0, 0, False, False
    for i, c in enumerate(text):
        if quoted:
            quoted, escaped = not (c == '"' and not escaped), c == "\\" and not escaped
        elif c == '"' and depth:
            quoted, escaped = True, False
        elif c == "{":
            start, depth = (i if depth == 0 else start), depth + 1
        elif c == "}" and depth:
            depth -= 1
            if depth == 0:
                yield text[start : i + 1]


def _load(text: str):  # noqa: ANN202
    bare_ids = re.sub(r'("id"\s*:\s*)(\d+)(?=\s*[,}])', r'\1"\2"', text)
    for variant in (text, text.replace('\\"', '"'), bare_ids, re.sub(r",\s*(?=[\]}])", "", text)):
        try:
            return json.loads(variant, strict=False)
        except ValueError:
            continue
    try:
        return ast.literal_eval(text)
    except (ValueError, SyntaxError, MemoryError, RecursionError):
        return None


def parse_items(reply: str | None) -> list[tuple[str, str]]:
    """(id, text) items of a reply: one object, an array (in a fence, damaged or with trailing commas), else all whole objects in it."""
    text = (reply or "").strip()
    fence = re.search(r"```(?:json)?\s*(.*?)(?:```|$)", text, re.S)
    for body in ([fence[1].strip()] if fence else []) + [text]:
        a, z = body.find("["), body.rfind("]")
        for chunk in (body, body[a : z + 1] if 0 <= a < z else ""):
            value = _load(chunk) if chunk else None
            found = items_of(value if isinstance(value, list) else [value])
            if found:
                return found
    return items_of([_load(o) for o in objects(text)])


def parse_positional(reply: str | None, n: int) -> list[str] | None:
    """The strings of an array of exactly ``n`` non-empty ones, else null."""
    value = _load((reply or "").strip())
    good = isinstance(value, list) and len(value) == n and all(isinstance(v, str) and v.strip() for v in value)
    return value if good else None


# Fixed value: the separator of framed rows.
FRAME = "ZXQROW{:06d}ZX"


def parse_framed(reply: str | None, n: int) -> list[str] | None:
    """Rows between numbered separators, if all n + 1 stand there once and in order, and no row is empty."""
    text = reply or ""
    if re.findall(r"ZXQROW\d{6}ZX", text) != [FRAME.format(i) for i in range(n + 1)]:
        return None
    rows = [r.strip() for r in re.split(r"ZXQROW\d{6}ZX", text)[1:-1]]
    return rows if all(rows) else None


@F.udf(ITEMS, useArrow=True)
def parse_items_udf(reply: str | None) -> list[tuple[str, str]]:
    return parse_items(reply)


def new_items(replies: DataFrame, reply: str, done: DataFrame) -> DataFrame:
    """Whole items of growing replies that have not come out before; per id the first of its reply."""
    rows = replies.select(F.posexplode(parse_items_udf(reply)).alias("pos", "item")).groupBy("item.id").agg(F.min_by("item.text", "pos").alias("text"))
    return rows.join(done.select("id"), "id", "left_anti")


def payload(rows: DataFrame, bucket: Column, key: str, text: str) -> DataFrame:
    """One request body per bucket. A bucket has a row limit, which bounds its list."""
    item = F.struct(F.col(key).cast("string").alias("id"), F.col(text).alias("text"))
    return rows.groupBy(bucket.alias("bucket")).agg(F.to_json(F.array_sort(F.collect_list(item))).alias("body"), F.count(F.lit(1)).alias("n"))
