"""Queries over texts: normal forms, masking round trips, segments, glossary, requests, units, coverage of encodings."""

from __future__ import annotations

from pyspark.sql import functions as F

from lexiloom.functions import codecs, glossary, replies, templates
from lexiloom.functions import text as X
from lexiloom.operators import dedup
from lexiloom.plans.records import query, read
from lexiloom.sources import units


@query("select tm_id, nfc_normalize(source_text) as source_text from translation_memory")
def nfc_forms(spark, d):
    return read(spark, d, "translation_memory").select("tm_id", codecs.nfc("source_text").alias("source_text"))


@query("select tm_id, coalesce(source_text, '') as restored, '' as error from translation_memory")
def template_round_trip(spark, d):
    """Masking and restoring gives every source back."""
    rows = read(spark, d, "translation_memory").select("tm_id", X.text_or_empty("source_text").alias("s")).withColumn("t", templates.template_udf("s"))
    return rows.withColumn("r", templates.restore_udf(F.col("t.text"), F.col("t"))).select("tm_id", F.col("r.text").alias("restored"), F.col("r.error").alias("error"))


@query("select tm_id, coalesce(source_text, '') as joined from translation_memory")
def skeleton_round_trip(spark, d):
    """The pieces of a skeleton make up the text."""
    rows = read(spark, d, "translation_memory").select("tm_id", templates.skeleton_udf(X.text_or_empty("source_text")).alias("p"))
    return rows.select("tm_id", F.array_join(F.transform("p", lambda x: x["value"]), "").alias("joined"))


@query()
def segments(spark, d):
    """Distinct translatable segments with their uses and first record."""
    rows = read(spark, d, "text_records").select("id", "pak", F.posexplode(templates.skeleton_udf(F.coalesce("source_original", "original"))).alias("pos", "p")).where("p.kind = 't'")
    return rows.groupBy("p.id", "p.value").agg(F.count(F.lit(1)).alias("uses"), F.min("id").alias("first_record"), F.min_by("pak", "id").alias("first_pak")).withColumnRenamed("id", "segment_id")


@query("select id, case when encoding is null then 'unknown' else lower(encoding) end as encoding, octet_length(encode(original)) as n_bytes from text_records where original is not null")
def encoded_sizes(spark, d):
    r = read(spark, d, "text_records").where("original is not null")
    return r.select("id", F.lower(F.coalesce("encoding", F.lit("unknown"))).alias("encoding"), F.octet_length(F.encode("original", "UTF-8")).cast("long").alias("n_bytes"))


@query()
def decoded_records(spark, d):
    """Every original as bytes, decoded again: encoding, language and score by count."""
    r = read(spark, d, "text_records").withColumn("x", codecs.decode_best_udf(F.encode("original", "UTF-8")))
    return r.groupBy(F.col("x.encoding").alias("encoding"), F.col("x.language").alias("language")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("x.score"), 3).alias("score"))


@query()
def glossary_apply(spark, d):
    rows = read(spark, d, "translation_memory").select("tm_id", "source_text")
    return glossary.apply_glossary(rows, "source_text", read(spark, d, "glossary")).where("n_terms > 0").select("tm_id", "matched", "n_terms", "complete")


@query()
def glossary_term_counts(spark, d):
    return glossary.glossary_terms(read(spark, d, "text_records"), "original")


@query()
def request_payloads(spark, d):
    """Open strings of each archive in requests of bounded size, as JSON bodies."""
    q = read(spark, d, "translation_queue").where("status = 'pending'").withColumn("ord", F.xxhash64("source_key"))
    buckets = dedup.greedy_buckets(q, "pak_name", "ord", "source_text").withColumnRenamed("file", "pak_name")
    rows = q.join(buckets, ["pak_name", "ord"]).withColumn("b", F.concat_ws(":", "pak_name", F.col("bucket").cast("string")))
    return replies.payload(rows, F.col("b"), "source_key", "source_text")


@query("with l as (select doc_id, unnest(string_split(text, chr(10))) s, generate_subscripts(string_split(text, chr(10)), 1) i from documents where text is not null and not contains(text, chr(13))) select doc_id, i::integer as line_no, c::integer as col_no, cell from (select doc_id, i, unnest(string_split(s, chr(9))) cell, generate_subscripts(string_split(s, chr(9)), 1) c from l where regexp_replace(s, '[ \\t\\f\\v]+', '', 'g') <> '') where regexp_replace(cell, '[ \\t\\f\\v]+', '', 'g') <> ''")
def unit_scan_cells(spark, d):
    """Documents read as tab-separated resources: a row per cell."""
    docs = read(spark, d, "documents").where("text is not null and not contains(text, '\r')")
    rows = docs.select("doc_id", F.explode(units.cells_udf(F.encode("text", "UTF-8"), F.lit("tsv"))).alias("c"))
    return rows.select("doc_id", "c.line_no", "c.col_no", F.decode("c.cell", "UTF-8").alias("cell"))


@query()
def unit_scan_all_cells(spark, d):
    """The cells of every document, also of those with CR or CRLF line ends, which the SQL of ``unit_scan_cells`` leaves out."""
    docs = read(spark, d, "documents").where("text is not null")
    rows = docs.select("doc_id", F.explode(units.cells_udf(F.encode("text", "UTF-8"), F.lit("tsv"))).alias("c"))
    return rows.select("doc_id", "c.line_no", "c.col_no", F.decode("c.cell", "UTF-8").alias("cell"))
