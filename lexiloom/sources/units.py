"""Resource files to text records: lines and cells with their places, script literals, visibility, decoding, write-back.

Input is ``binaryFile`` rows (path, content). Splitting and cheap filters are native and come before any decoding.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexiloom.functions import codecs
from lexiloom.functions import text as X

# Resources with text, reports that aren't resources, header words that show text or structure.
TEXT_SUFFIXES = ("tsv", "ini", "txt", "lua")
REPORTS = ("_unpack_report.txt", "_quality_report.txt")
VISIBLE_WORDS = (
    "npc_?name name title text string intro caption tip des desc(?:ription)? content message msg label dialog talk say notice help story mission tutorial memo prefix quest(?:_?name|desc)? task(?:_?name|content|info|tips)? skill(?:_?name|desc)"
    " item_?name weapon_?name equip_?name map_?name drop_?name reward(?:name|description) right(?:name|desc) title_?name pack_?name duty(?:name|desc)"
).split()
VISIBLE_PARTS = "名称 名字 标题 说明文字 说明 描述 简介 内容 文本 对白 对话 提示 消息 任务名 技能名 物品名 装备名 地图名 备注".split()
INTERNAL_WORDS = (
    "id res(?:ource)? idx index code path file image icon spr anim(?:ation)? script function param value type kind genre detail particular level map width height price count weight quantity series option flag time lock trade drop x y z skill\\d+"
).split()
INTERNAL_PARTS = "资源 动画 文件 路径 索引 编号 种类 类别 类型 数值 最小值 最大值 属性 价格 等级 宽度 高度 负重 标记 时间 是否 装备id 套装id resid 技能\\d+".split()
# A word counts between underscores or the ends of a header, a part anywhere.
VISIBLE_HEADER, INTERNAL_HEADER = (rf"(?i)(?:^|_)(?:{'|'.join(words)})(?:$|_)|{'|'.join(parts)}" for words, parts in ((VISIBLE_WORDS, VISIBLE_PARTS), (INTERNAL_WORDS, INTERNAL_PARTS)))


def resources(spark: SparkSession, folder: str) -> DataFrame:
    """Text resources below a folder, without reports."""
    name = F.lower(F.element_at(F.split("path", "/"), -1))
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).where(F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1)).isin(*TEXT_SUFFIXES) & ~name.isin(*REPORTS))


def lua_strings(line: bytes) -> list[tuple[int, int, bytes]]:
    """(start, end, content) of quoted literals outside comments; escapes respected, an open one is none."""
    out, at = [], 0
    while at < len(line) and line[at : at + 2] != b"--":
        quote = line[at : at + 1]
        at += 1
        if quote in (b'"', b"'"):
            m = re.compile(rb"(?:\\.|[^\\" + quote + rb"])*", re.S).match(line, at)
            if line[m.end() : m.end() + 1] != quote:
                break
            out.append((at, m.end(), m[0]))
            at = m.end() + 1
    return out


def lua_parts(line: bytes) -> list[tuple[int, int, bytes]]:
    """The visible spans of the literals, between tags."""
    out = []
    for start, _, content in lua_strings(line):
        at = 0
        for m in [*re.finditer(rb"<[^<>\r\n]{1,512}>", content), None]:
            end = m.start() if m else len(content)
            if content[at:end].strip():
                out.append((start + at, start + end, content[at:end]))
            at = m.end() if m else at
    return out


def replace_lua(line: bytes, new: dict[int, bytes]) -> bytes:
    """K6: visible spans by their number replaced, from the right; quotes of the literal's kind are escaped."""
    for n, (start, end, _) in reversed(list(enumerate(lua_parts(line), 1))):
        if n in new:
            quote = next(line[s - 1 : s] for s, e, _ in lua_strings(line) if s <= start <= e)
            line = line[:start] + re.sub(rb"(?<!\\)" + quote, b"\\\\" + quote, new[n]) + line[end:]
    return line


def lua_skeleton(line: bytes) -> bytes:
    """The line without its visible text: equal skeletons mean that no code or tag changed."""
    for start, end, _ in reversed(lua_parts(line)):
        line = line[:start] + line[end:]
    return line


CELLS = T.ArrayType(T.StructType([T.StructField("line_no", T.IntegerType()), T.StructField("col_no", T.IntegerType()), T.StructField("key", T.BinaryType()), T.StructField("cell", T.BinaryType())]))


def cells_of(content: bytes, suffix: str) -> list[tuple[int, int, bytes, bytes]]:
    """(line, column, key, cell), 1-based, split at byte level so that encodings may mix."""
    out: list[tuple[int, int, bytes, bytes]] = []
    for n, line in enumerate(re.split(rb"\r\n|\r|\n", content), 1):
        if not line.strip():
            continue
        if suffix == "lua":
            out += [(n, k, b"lua", part) for k, (_, _, part) in enumerate(lua_parts(line), 1)]
        elif suffix == "ini":
            if line.lstrip()[:1] in (b";", b"#") or re.fullmatch(rb"\s*\[[^\]]+\]\s*", line):
                continue
            key, eq, value = line.partition(b"=")
            if not eq:
                out.append((n, 1, b"", line.strip()))
            elif value.strip():
                out.append((n, 1, key.strip(), value.strip()))
        elif suffix in ("tsv", "csv") or b"\t" in line:
            out += [(n, c, b"", cell) for c, cell in enumerate(line.split(b"," if suffix == "csv" else b"\t"), 1) if cell.strip()]
        else:
            out.append((n, 1, b"", line.strip()))
    return out


@F.udf(CELLS, useArrow=True)
def cells_udf(content: bytes | None, suffix: str) -> list[tuple[int, int, bytes, bytes]]:
    return cells_of(content or b"", suffix)


def units(files: DataFrame) -> DataFrame:
    """One row per cell of each file: (path, suffix, line_no, col_no, key, cell)."""
    suffix = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    rows = files.select("path", suffix.alias("suffix"), F.explode(cells_udf("content", suffix)).alias("c"))
    return rows.select("path", "suffix", "c.line_no", "c.col_no", "c.key", "c.cell")


def records(files: DataFrame, pak: str) -> DataFrame:
    """The record table of resource files: units, headers and keys, decoding of what is left, predicates, category, id."""
    cells = units(files)
    headers = cells.where("suffix = 'tsv' and line_no = 1").select("path", "col_no", codecs.decode_fallback_udf("cell").alias("header"))
    headers = headers.where(F.col("header").rlike(VISIBLE_HEADER) & ~F.col("header").rlike(INTERNAL_HEADER))
    rows = cells.where((F.length("cell") >= 2) & (F.length("cell") <= 32767)).join(headers, ["path", "col_no"], "left")
    rows = rows.where((F.col("suffix") != "tsv") | ((F.col("line_no") > 1) & F.col("header").isNotNull()))
    rows = rows.withColumn("key_name", F.decode("key", "ISO-8859-1")).where((F.col("suffix") != "ini") | X.is_visible_key(F.col("key_name")))
    rows = rows.withColumn("d", codecs.decode_best_udf("cell"))
    text = F.col("d.text")
    rows = rows.where(~X.is_structural(text) & ~X.is_junk(text) & ~X.is_resource_reference(text) & X.has_natural_text(text))
    name = F.element_at(F.split("path", "/"), -1)
    cat = X.category(F.col("key_name"), F.lit(""), text, F.concat(F.lit("."), "suffix"))
    return rows.select(
        X.record_id(F.lit(pak), name, F.col("line_no"), F.col("col_no"), text).alias("id"), cat.getField("category").alias("category"), cat.getField("subcategory").alias("subcategory"), F.lit(pak).alias("pak"),
        F.upper(F.regexp_extract(name, r"_([0-9A-Fa-f]{8})\.", 1)).alias("file_hash"), name.alias("source_file"), "line_no", "col_no", "key_name", F.col("d.encoding").alias("encoding"), F.col("d.language").alias("language"),
        F.col("d.score").alias("confidence_score"), text.alias("original"), F.lit(True).alias("is_player_visible"),
    )


def patch(content: bytes, suffix: str, updates: dict[tuple[int, int], bytes]) -> bytes:
    """K4: cells by (line, column) replaced; every other byte, the line ends and the terminal newline stay."""
    parts = re.split(rb"(\r\n|\r|\n)", content)
    by_line: dict[int, dict[int, bytes]] = {}
    for (line, col), data in updates.items():
        by_line.setdefault(line, {})[col] = data
    for n, new in by_line.items():
        at = 2 * (n - 1)
        if at >= len(parts):
            continue
        line = parts[at]
        if suffix == "lua":
            parts[at] = replace_lua(line, new)
        elif suffix == "ini":
            key, eq, value = line.partition(b"=")
            lead = value[: len(value) - len(value.lstrip())]
            parts[at] = key + eq + lead + new[1] if eq else new.get(1, line)
        elif suffix in ("tsv", "csv") or b"\t" in line:
            sep = b"," if suffix == "csv" else b"\t"
            cells = line.split(sep)
            for col, data in new.items():
                if col <= len(cells):
                    cells[col - 1] = data
            parts[at] = sep.join(cells)
        else:
            parts[at] = new.get(1, line)
    return b"".join(parts)


def write_back(files: DataFrame, updates: DataFrame) -> DataFrame:
    """K4, K5: (path, content) of the files that updates (path, line_no, col_no, text) change. A cogroup holds one file."""
    suffix = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    new_cells = updates.toDF(*[f"u_{c}" for c in updates.columns])
    wanted = new_cells.select(F.col("u_path").alias("path")).distinct()
    left = files.select("path", suffix.alias("suffix"), "content").join(wanted, "path", "left_semi")

    def run(f: pd.DataFrame, u: pd.DataFrame) -> pd.DataFrame:
        if f.empty or u.empty:
            return pd.DataFrame({"path": [], "content": []})
        new = {(int(r.u_line_no), int(r.u_col_no)): codecs.encode_source(r.u_text) for r in u.itertuples()}
        return pd.DataFrame({"path": [f["path"].iat[0]], "content": [patch(bytes(f["content"].iat[0]), f["suffix"].iat[0], new)]})

    return left.groupBy("path").cogroup(new_cells.select("u_path", "u_line_no", "u_col_no", "u_text").groupBy("u_path")).applyInPandas(run, "path string, content binary")


def structure_issues(before: DataFrame, after: DataFrame) -> DataFrame:
    """V7: files whose number of lines, or any of whose lines' number of cells, changed; the first such line is ``line_no``."""

    def shape(rows: DataFrame, n: str) -> DataFrame:
        lines = F.split(F.decode("content", "ISO-8859-1"), r"\r\n|\r|\n", -1)
        return rows.select("path", F.transform(lines, lambda x: F.length(x) - F.length(F.replace(x, F.lit("\t")))).alias(n))

    both = shape(before, "old").join(shape(after, "new"), "path")
    moved = F.transform(F.arrays_zip("old", "new"), lambda x: ~x.old.eqNullSafe(x.new))
    return both.select("path", F.size("old").alias("old_lines"), F.size("new").alias("new_lines"), F.array_position(moved, F.lit(True)).cast("int").alias("line_no")).where("line_no > 0")


def audit(files: DataFrame) -> DataFrame:
    """Lines by file that look like keys, tables, markup or prose, and the policy for its suffix."""
    suffix = F.lower(F.regexp_extract("path", r"\.([A-Za-z0-9]+)$", 1))
    lines = files.select("path", suffix.alias("suffix"), F.explode(F.split(F.decode("content", "ISO-8859-1"), r"\r\n|\r|\n")).alias("line")).where("trim(line) != ''")
    policy = F.when(F.col("suffix").isin(*TEXT_SUFFIXES), "translatable").otherwise("denied")
    return lines.groupBy("path", "suffix").agg(
        F.count(F.lit(1)).alias("n_lines"), F.count_if(F.col("line").rlike(r"^[^=\s]+\s*=")).alias("n_keys"), F.count_if(F.contains("line", F.lit("\t"))).alias("n_tables"), F.count_if(F.col("line").rlike("<[^>]+>")).alias("n_markup"),
    ).withColumn("policy", policy)
