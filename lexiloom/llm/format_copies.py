"""Problem 1: records that are copies of each other but for formatting or the order of their named fields.

Method: dictionary encoding. Every record is a bag of cells (a named field with its value, or the whole text as one
unnamed cell). Each distinct cell is canonicalised once, gets a 128-bit integer identifier, the record is rewritten as
the sorted tuple of its cells' identifiers, and the compact tuples are grouped.

Identifiers are two 64-bit integers hashed from the canonical cell, so that no counter has to be shared between
executors and a recomputed task gives the same numbers. With 10^10 distinct cells a collision has probability < 10^-18.

A record's cells are few (its fields), and names don't repeat in it.

Defined results: a null text, or one with no letter, digit or U+FFFD, is no record and has no copies. Repeated rows of one
id and text count once; the smallest id of a group is the first. Other columns of the input are ignored, whatever
their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.llm.common import first_of_group, salt_of, settled, table

#: What formatting may change: punctuation, symbols, blanks and control characters. U+FFFD stands for a lost letter.
NOISE = r"[\p{P}\p{S}\p{Z}\p{C}\s&&[^\x{FFFD}]]+"
#: Signs between two fields, and between a field's name and its value.
BETWEEN = r"[;；,，、|\n\r{}]+"
CELL = r"^[\s\p{P}\p{S}]*([\p{L}][\p{L}\s]{0,39}?)[\s\"”]*[:：=\-][\s\"“]*([^\s\"“].*)$"
#: Lines of dialogue ("speaker: sentence") are not named fields: most values are short, that is of so many characters and words at most,
#: and both of two, neither of which ends like a sentence. A field's name has 40 letters at most (CELL).
MAX_VALUE, MAX_WORDS, LEAST_FIELDS = 60, 8, 2
COLON = r"^[\s\p{P}\p{S}]*[\p{L}][\p{L}\s]{0,39}?[\s\"”]*[:：=]"
SENTENCE_END = r"[.!?…。！？][\s\p{Z}\p{Pf}\p{Pe}\"']*$"
#: Times a repeated cell may be in the dictionary, so that a hot one is looked up in as many tasks.
CELL_SALTS = 16


def canonical(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), NOISE, "")


def fields_of(text: Column) -> Column:
    """Array of (name, value) as stored, or null where the text isn't a list of named fields."""
    parts = F.filter(F.split(text, BETWEEN), lambda p: p.rlike(r"[\p{L}\p{N}\x{FFFD}]"))
    cells = F.transform(parts, lambda p: F.struct(F.regexp_extract(p, CELL, 1).alias("f"), F.regexp_extract(p, CELL, 2).alias("v")))
    ok = F.forall(cells, lambda c: F.length(c.f) > 0) & (2 * F.size(F.filter(cells, lambda c: (F.length(c.v) <= MAX_VALUE) & (F.size(F.split(F.trim(c.v), r"\s+")) <= MAX_WORDS))) > F.greatest(F.size(cells), F.lit(3)))
    # Two parts of a sentence with hyphens for commas look like two fields.
    ok = ok & ((F.size(cells) > 2) | (F.forall(cells, lambda c: ~c.v.rlike(SENTENCE_END)) & F.forall(parts, lambda p: p.rlike(COLON))))
    names = F.transform(cells, lambda c: canonical(c.f))
    first = text.rlike(r"^[\s\p{P}\p{S}]*[\p{L}][\p{L} \t]{0,39}?[\s\"”]*[:：=\-]")
    return F.when(first, F.when((F.size(cells) >= LEAST_FIELDS) & ok & (F.size(F.array_distinct(names)) == F.size(names)), cells))


def _ids(cell: Column) -> Column:
    return F.struct(F.xxhash64(cell).alias("a"), F.xxhash64(F.lit("second"), cell).alias("b"))


def encode(records: DataFrame) -> DataFrame:
    """(tbl, id, text) to (tbl, id, key): key stands for the sorted array of the record's integer cell identifiers, in 128 bits."""
    whole = F.array(F.struct(F.lit("").alias("f"), F.col("text").alias("v")))
    rows = records.where(F.col("text").rlike(r"[^\p{P}\p{S}\p{Z}\p{C}\s]|\x{FFFD}")).withColumn("cells", fields_of(F.col("text")))
    cells = (
        rows.select("tbl", "id", F.xxhash64("text").alias("rec"), F.explode(F.coalesce("cells", whole)).alias("c"))
        .select("tbl", "id", "rec", F.concat("c.f", F.lit("\x01"), "c.v").alias("cell"))
        .withColumn("salt", salt_of("tbl", "id", salts=CELL_SALTS))
    )
    # The dictionary: every distinct stored cell is canonicalised here, once (a repeated one at most CELL_SALTS times).
    book = cells.select("cell", "salt").distinct()
    name, value = F.substring_index("cell", "\x01", 1), F.expr("substr(cell, instr(cell, '\x01') + 1)")
    book = book.select(_ids(F.col("cell")).alias("raw"), "salt", _ids(F.concat(canonical(name), F.lit("\x01"), canonical(value))).alias("cid"))
    coded = cells.select("tbl", "id", "rec", "salt", _ids(F.col("cell")).alias("raw")).join(book, ["raw", "salt"])
    return coded.groupBy("tbl", "id", "rec").agg(F.sort_array(F.collect_set("cid")).alias("key")).select("tbl", "id", _ids(F.col("key")).alias("key"))


def copies(records: DataFrame) -> DataFrame:
    """Rows of (tbl, id, first_id, n_copies) for every record in a group of two or more. The narrow encoded table is written once, as it is read twice."""
    return first_of_group(settled(encode(records)), ["tbl", "key"], "id").select("tbl", "id", "first_id", "n_copies")


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, memory = table(spark, sf_dir, "documents"), table(spark, sf_dir, "translation_memory")
    return docs.select(F.lit("documents").alias("tbl"), F.col("doc_id").alias("id"), "text").unionByName(
        memory.select(F.lit("translation_memory").alias("tbl"), F.col("tm_id").alias("id"), F.col("source_text").alias("text"))
    )


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return copies(records(spark, sf_dir)).where("id > first_id").select("tbl", "first_id", F.col("id").alias("copy_id")).distinct()


def p1_collapsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per string with its number of copies."""
    return encode(records(spark, sf_dir)).groupBy("tbl", "key").agg(F.min("id").alias("first_id"), F.count(F.lit(1)).alias("n_copies")).select("tbl", "first_id", "n_copies")


QUERIES = {"p1_found": p1_found, "p1_collapsed": p1_collapsed}
