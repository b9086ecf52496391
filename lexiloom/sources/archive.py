"""Game archives as a Spark data source: index scan, entry decoding, content sniffing, statistics, rebuild.

``spark.read.format("pak").load(path)`` gives a row per entry. Readers get ranges of entries and read only their bytes; an
entry that can't be decoded comes out as a row with its error and packed bytes.
"""

from __future__ import annotations

import glob
import json
import os
import re
import struct
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from lexiloom.sources import nrv2b

# Sizes and signatures of the format.
HEADER, ENTRY, SIGNATURES, MOST_ENTRIES = 32, 16, (b"PACK", b"PAK "), 10_000_000
SCHEMA = "archive string, index int, id_hash string, offset long, real_length long, packed_length long, method int, status string, ext string, kind string, content binary, packed binary, error string"


def parse_header(head: bytes, size: int) -> dict:
    if len(head) < HEADER:
        raise ValueError("shorter than a header")
    signature, count, index, data, crc = struct.unpack_from("<4sIIII", head)
    if signature not in SIGNATURES:
        raise ValueError(f"signature {signature!r}")
    if not 0 < count < MOST_ENTRIES:
        raise ValueError(f"{count} entries")
    if index < HEADER or index + count * ENTRY > size:
        raise ValueError("index outside the file")
    return {"count": count, "index_offset": index, "data_field": data, "crc32": crc}


def parse_entry(raw: bytes) -> tuple[int, int, int, int, int]:
    """(id, offset, real length, packed length, method)."""
    key, offset, real = struct.unpack_from("<III", raw)
    return key, offset, real, int.from_bytes(raw[12:15], "little"), raw[15]


def expand_sprite(data: bytes, size: int) -> bytes:
    """Method 17: a sprite whose frames are packed one by one; a frame with a negative length is stored as it is."""
    if len(data) < 40 or data[:4] != b"SPR\0":
        raise ValueError("no sprite header")
    frames, colors = struct.unpack_from("<HH", data, 12)
    (depth,) = struct.unpack_from("<H", data, 26)
    head = HEADER if depth == 32 else HEADER + 3 * colors
    body = head + 8 * frames
    if not frames or colors > 256 or body > len(data):
        raise ValueError("sprite tables outside the data")
    table = [struct.unpack_from("<Ii", data, head + 8 * i) for i in range(frames)]
    if any(p <= 0 or r == 0 for p, r in table) or body + sum(p for p, _ in table) != len(data):
        raise ValueError("sprite frames don't fill the data")
    out, offsets, at = [], [], body
    for packed, real in table:
        block = data[at : at + packed]
        at += packed
        if real < 0 and packed != -real:
            raise ValueError("size of a stored frame")
        offsets.append(struct.pack("<II", sum(map(len, out)), abs(real)))
        out.append(block if real < 0 else nrv2b.decompress(block, real))
    whole = data[:head] + b"".join(offsets) + b"".join(out)
    if len(whole) != size:
        raise ValueError(f"{len(whole)} bytes instead of {size}")
    return whole


def decode_entry(data: bytes, method: int, size: int) -> bytes:
    if method == 0:
        return data
    if method in (1, 16, 32):
        return nrv2b.decompress(data, size)
    if method == 17:
        return expand_sprite(data, size)
    raise ValueError(f"method {method}")


# Magic numbers.
MAGIC = ((b"\x89PNG\r\n\x1a\n", ".png"), (b"\xff\xd8\xff", ".jpg"), (b"GIF8", ".gif"), (b"BM", ".bmp"), (b"OggS", ".ogg"), (b"DDS ", ".dds"), (b"PK\x03\x04", ".zip"), (b"\x1bLua", ".luac"), (b"SPR", ".spr"))
LUA_WORDS = (b"function ", b"require(", b"local ", b" end", b"return ", b"--", b"gettask(", b"settask(")


def sniff(data: bytes) -> tuple[str, str]:
    """(extension, kind) by content: magic, then the shape of its bytes."""
    for magic, ext in MAGIC:
        if data.startswith(magic):
            return ext, "magic"
    if data[:4] == b"RIFF" and data[8:12] == b"WAVE":
        return ".wav", "magic"
    head = data[: 1 << 16]
    if not head or 0 in head or sum((b < 32 and b not in (9, 10, 13)) or b == 127 for b in head) >= 0.01 * len(head):
        return ".bin", "binary"
    low = data[: 1 << 17].lower()
    if sum(w in low for w in LUA_WORDS) >= 2 or low.lstrip().startswith((b"function ", b"require(")):
        return ".lua", "text"
    if re.search(rb"(?m)^\s*\[[^\]\r\n]{1,160}\]\s*$", low) and re.search(rb"(?m)^\s*[^;#\r\n=]{1,200}\s*=", low):
        return ".ini", "text"
    lines = [x for x in data[: 1 << 17].split(b"\n")[:30] if x.strip()]
    for sign, least, ext in ((b"\t", 1, ".tsv"), (b",", 2, ".csv")):
        counts = [x.count(sign) for x in lines]
        if len(lines) >= 2 and min(counts) >= least and max(counts) - min(counts) <= 2:
            return ext, "text"
    start = data.lstrip(b"\xef\xbb\xbf \t\r\n")
    if start[:1] in (b"{", b"["):
        try:
            json.loads(start)
        except ValueError:
            pass
        else:
            return ".json", "text"
    return (".xml", "text") if re.match(rb"<\?xml|<[-A-Za-z_:][^>]*>", start) else (".txt", "text")


class _Range(InputPartition):
    def __init__(self, path: str, first: int, last: int, index: int) -> None:
        self.path, self.first, self.last, self.index = path, first, last, index


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.step = options["path"], int(options.get("entriesPerPartition", 512))

    def partitions(self) -> list[_Range]:
        out = []
        for path in sorted(glob.glob(os.path.join(self.path, "*.pak")) if os.path.isdir(self.path) else glob.glob(self.path)):
            with open(path, "rb") as f:
                h = parse_header(f.read(HEADER), os.path.getsize(path))
            out += [_Range(path, i, min(i + self.step, h["count"]), h["index_offset"]) for i in range(0, h["count"], self.step)]
        return out

    def read(self, part: _Range) -> Iterator[tuple]:
        with open(part.path, "rb") as f:
            f.seek(part.index + ENTRY * part.first)
            table = f.read(ENTRY * (part.last - part.first))
            for i in range(part.first, part.last):
                at = ENTRY * (i - part.first)
                key, offset, real, packed, method = parse_entry(table[at : at + ENTRY])
                base = (os.path.basename(part.path), i, f"{key:08X}", offset, real, packed, method)
                raw = b""
                try:
                    if packed <= 0 or offset < HEADER or offset + packed > part.index:
                        raise ValueError("data outside its region")
                    f.seek(offset)
                    raw = f.read(packed)
                    data = decode_entry(raw, method, real)
                    yield (*base, "ok", *sniff(data), data, None, None)
                except ValueError as e:
                    yield (*base, "failed", None, None, None, raw, str(e))


class PakSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "pak"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> _Reader:  # noqa: ANN001
        return _Reader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PakSource)


def report(entries: DataFrame) -> DataFrame:
    """Entries by method, type and outcome."""
    return entries.groupBy("archive", "method", "ext", "status").agg(F.count(F.lit(1)).alias("n"), F.sum("real_length").alias("bytes"))


def layout(entries: DataFrame) -> DataFrame:
    """Entries in physical order with the gap to the one before; a negative gap overlaps it."""
    w = Window.partitionBy("archive").orderBy("offset", "index")
    end = F.lag(F.col("offset") + F.col("packed_length")).over(w)
    return entries.select("archive", "index", "offset", "packed_length").withColumn("gap", F.col("offset") - F.coalesce(end, F.lit(HEADER)))


def changed_entries(before: DataFrame, after: DataFrame) -> DataFrame:
    """Indexes whose content differs."""
    a, b = (x.select("index", F.sha2("content", 256).alias(n)) for x, n in ((before, "old"), (after, "new")))
    return a.join(b, "index", "full_outer").where(~F.col("old").eqNullSafe(F.col("new"))).select("index")


def rebuild(source: str, target: str, changes: dict[int, bytes]) -> dict:
    """K7: the archive with some entries replaced, in its physical order; untouched bytes, gaps and shared blocks stay.

    Only entries of method 1 can be replaced. The new file is verified entry by entry, then put in place in one step.
    """
    with open(source, "rb") as f:
        blob = f.read()
    h = parse_header(blob, len(blob))
    entries = [parse_entry(blob[h["index_offset"] + ENTRY * i : h["index_offset"] + ENTRY * (i + 1)]) for i in range(h["count"])]
    for i in changes:
        if entries[i][4] != 1:
            raise ValueError(f"entry {i} has method {entries[i][4]}")
    order = sorted(range(len(entries)), key=lambda i: (entries[i][1], i))
    out, end, moved, table = bytearray(blob[:HEADER]), HEADER, {}, {}
    for i in order:
        key, offset, real, packed, method = entries[i]
        if i not in changes and (offset, packed) in moved:  # the block is shared
            table[i] = (key, moved[offset, packed], real, packed, method)
            continue
        if offset < end and i not in changes and offset + packed > end:
            raise ValueError(f"entry {i} overlaps the one before")
        out += blob[end:offset] if offset > end else b""
        block, size = (nrv2b.compress(changes[i]), len(changes[i])) if i in changes else (blob[offset : offset + packed], real)
        if len(block) >= 1 << 24:
            raise ValueError(f"entry {i} is too large")
        table[i] = (key, len(out), size, len(block), method)
        if i not in changes:
            moved[offset, packed] = len(out)
        out += block
        end = max(end, offset + packed)
    out += blob[end : h["index_offset"]]
    struct.pack_into("<I", out, 8, len(out))
    for i in range(len(entries)):
        key, offset, real, packed, method = table[i]
        out += struct.pack("<III", key, offset, real) + packed.to_bytes(3, "little") + bytes([method])
    for i, data in changes.items():
        _, offset, real, packed, method = table[i]
        if decode_entry(bytes(out[offset : offset + packed]), method, real) != data:
            raise ValueError(f"entry {i} does not come back")
    with open(target + ".new", "wb") as f:
        f.write(out)
    os.replace(target + ".new", target)
    return {"entries": len(entries), "changed": len(changes), "size": len(out), "crc32": zlib.crc32(out)}
