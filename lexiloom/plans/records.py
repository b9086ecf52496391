"""Queries over the record tables, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lexiloom.functions import patterns as P
from lexiloom.functions import text as X
from lexiloom.operators import dedup, fuzzy, linkage, memory
from lexiloom.streaming import incremental

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Register a query under its function's name, with its SQL where there is one."""

    def add(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[fn.__name__] = fn
        if sql:
            SQL[fn.__name__] = sql
        return fn

    return add


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# SQL fragments. DuckDB's regular expressions have no lookaround, so only queries without it have SQL.


def s_exchange(c: str) -> str:
    return f"regexp_replace(regexp_replace(regexp_replace(coalesce({c},''), '\\r\\n|\\r', chr(10), 'g'), '^\\$', ''), '(?i)<\\\\n>', chr(10), 'g')"


#: What the blueprint calls a blank at the ends of a line, spelled out for the SQL.
S_BLANK = "\\t\\x0B\\f\\r\\x1C-\\x20\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}"


def s_key(c: str) -> str:
    lines = f"regexp_replace(regexp_replace(nfc_normalize({s_exchange(c)}), '[ \\t]+', ' ', 'g'), '(?m)^[{S_BLANK}]+|[{S_BLANK}]+$', '', 'g')"
    return f"regexp_replace({lines}, '^[\\n{S_BLANK}]+|[\\n{S_BLANK}]+$', '', 'g')"


S_CJK = "[\\x{3400}-\\x{9FFF}\\x{F900}-\\x{FAFF}]"
S_VI_WORD = P.VIETNAMESE_WORD.replace("(?iu)", "(?i)")


def s_bucket(c: str) -> str:
    han, vi = f"regexp_matches(coalesce({c},''), '{S_CJK}')", f"(regexp_matches(coalesce({c},''), '{P.VIETNAMESE}') or regexp_matches(coalesce({c},''), '{S_VI_WORD}'))"
    return f"case when {han} and {vi} then 'mixed' when {han} then 'zh' when {vi} then 'vi' else 'other' end"


S_SOURCE = "coalesce(source_original, original)"
#: Two versions of the records: as extracted, and as edited since.
S_LEFT = f"left_ as (select distinct id, pak, source_file, file_hash, line_no, col_no, key_name, {S_SOURCE} as original from text_records)"
S_RIGHT = "right_ as (select distinct id, pak, source_file, file_hash, line_no, col_no, key_name, original from text_records)"
COLUMNS = ["id", "pak", "source_file", "file_hash", "line_no", "col_no", "key_name"]


def versions(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    r = read(spark, d, "text_records")
    return r.select(*COLUMNS, F.coalesce("source_original", "original").alias("original")).distinct(), r.select(*COLUMNS, "original").distinct()


# Identity (1.4).


@query("select id, substr(sha1(coalesce(pak,'')||'|'||coalesce(source_file,'')||'|'||coalesce(line_no::varchar,'')||'|'||coalesce(col_no::varchar,'')||'|'||coalesce(original,'')),1,16) as record_id from text_records")
def record_ids(spark, d):
    return read(spark, d, "text_records").select("id", X.record_id(F.col("pak"), F.col("source_file"), F.col("line_no"), F.col("col_no"), F.col("original")).alias("record_id"))


@query("select tm_id, 'x'||substr(sha256(coalesce(source_text,'')),1,24) as content_id, 's'||substr(sha256(coalesce(target_text,'')),1,24) as segment_id from translation_memory")
def content_ids(spark, d):
    return read(spark, d, "translation_memory").select("tm_id", X.content_id(F.col("source_text")).alias("content_id"), X.segment_id(F.col("target_text")).alias("segment_id"))


@query(f"select tm_id, {s_key('source_text')} as source_key from translation_memory")
def memory_keys(spark, d):
    return read(spark, d, "translation_memory").select("tm_id", X.normal_key(F.col("source_text")).alias("source_key"))


@query(f"select id, substr(sha256({s_key(S_SOURCE)} || chr(0) || {s_key('original')}),1,24) as review_key from (select distinct id, source_original, original from text_records)")
def review_keys(spark, d):
    r = read(spark, d, "text_records").select("id", "source_original", "original").distinct()
    return r.select("id", X.review_key(F.coalesce("source_original", "original"), F.col("original")).alias("review_key"))


# Translation memory and queue.

S_TM = f"tm as (select {s_key('source_text')} as key, target_text, quality, row_number() over (partition by {s_key('source_text')} order by updated_at desc nulls last, tm_id desc) rn from translation_memory where quality in ('manual','reviewed','approved','seed') and target_text is not null), gl as (select {s_key('source')} as key, arg_min(target, gloss_id) as target from glossary where mode = 'exact' and coalesce(target,'') <> '' group by 1)"


@query(
    f"with {S_TM} select q.pak_name, q.source_key, coalesce(t.target_text, g.target) as target, case when t.target_text is not null then 'tm:'||t.quality when g.target is not null then 'glossary' end as engine from translation_queue q left join (select * from tm where rn = 1 and key <> '') t on t.key = q.source_key left join (select * from gl where key <> '') g on g.key = q.source_key"
)
def tm_lookup(spark, d):
    rows = read(spark, d, "translation_queue").select("pak_name", "source_key")
    return memory.lookup(rows, "source_key", read(spark, d, "translation_memory"), read(spark, d, "glossary"))


@query()
def tm_lookup_wrapped(spark, d):
    rows = read(spark, d, "text_records").select("id", F.coalesce("source_original", "original").alias("src")).distinct()
    return memory.lookup_wrapped(rows, "src", read(spark, d, "translation_memory"), read(spark, d, "glossary")).select("id", "target", "engine")


@query()
def tm_queue_build(spark, d):
    return memory.build_queue(read(spark, d, "text_records"), read(spark, d, "translation_memory"), read(spark, d, "glossary"))


@query(
    f"with r as (select pak, id, coalesce(original,'') cur, coalesce({S_SOURCE},'') src, language, {s_key(S_SOURCE)} source_key from text_records) select pak, source_key, count(*) as occurrence_count, count(*) filter (where cur <> src) as translated_count, bool_and(coalesce(language = 'zh', false)) as all_zh, arg_min(src, (id, src)) as source from r where source_key <> '' group by 1, 2"
)
def tm_queue_groups(spark, d):
    r = read(spark, d, "text_records").select("pak", "id", X.text_or_empty("original").alias("cur"), X.text_or_empty(F.coalesce("source_original", "original")).alias("src"), "language")
    r = r.withColumn("source_key", X.normal_key(F.col("src"))).where("source_key != ''")
    return r.groupBy("pak", "source_key").agg(F.count(F.lit(1)).alias("occurrence_count"), F.count_if(F.col("cur") != F.col("src")).alias("translated_count"), F.every(F.coalesce(F.col("language") == "zh", F.lit(False))).alias("all_zh"), F.min_by("src", F.struct("id", "src")).alias("source"))


@query("select pak_name, status, count(*) as n_unique, coalesce(sum(occurrence_count),0)::bigint as n_occurrences from translation_queue group by 1, 2")
def tm_queue_stats(spark, d):
    return memory.queue_stats(read(spark, d, "translation_queue"))


@query("select pak_name, count(*) as unique_total, coalesce(sum(occurrence_count),0)::bigint as occurrence_total, count(*) filter (where status in ('completed','source_zh')) as completed_unique, count(*) filter (where status in ('pending','tm_ready','failed','review')) as remaining_unique from translation_queue group by 1")
def tm_queue_totals(spark, d):
    return memory.queue_totals(read(spark, d, "translation_queue"))


@query("select pak_name, source_key, status, occurrence_count from translation_queue order by occurrence_count desc, source_text, pak_name, source_key limit 500")
def tm_queue_top(spark, d):
    return memory.queue_top(read(spark, d, "translation_queue"), 500).select("pak_name", "source_key", "status", "occurrence_count")


@query("select pak_name, source_key, occurrence_count from translation_queue where status = 'tm_ready' order by occurrence_count desc, source_text, pak_name, source_key limit 200")
def tm_queue_next_batch(spark, d):
    return memory.queue_top(read(spark, d, "translation_queue"), 200, "tm_ready").select("pak_name", "source_key", "occurrence_count")


@query()
def tm_queue_advance(spark, d):
    return memory.advance_queue(read(spark, d, "translation_queue"), read(spark, d, "translation_memory"), read(spark, d, "glossary"))


@query(
    f"with q as (select pak_name, source_key, any_value(target_text) t from translation_queue where status = 'tm_ready' group by 1, 2), r as (select distinct id, pak, original, source_original from text_records), x as (select r.id, r.original, {S_SOURCE} as src, q.t from r left join q on q.pak_name = r.pak and q.source_key = {s_key(S_SOURCE)}) select id, case when t is not null and coalesce(original,'') = coalesce(src,'') then case when left(coalesce(src,''),1) = '$' and left(replace(t, chr(10), '<\\n>'),1) <> '$' then '$' || replace(t, chr(10), '<\\n>') else replace(t, chr(10), '<\\n>') end else original end as original from x"
)
def tm_apply_ready(spark, d):
    r = read(spark, d, "text_records").select("id", "pak", "original", "source_original").distinct().withColumns({"note": F.lit(None).cast("string"), "status": F.lit(None).cast("string")})
    return memory.apply_ready(r, read(spark, d, "translation_queue")).select("id", "original")


@query(
    f"with r as (select pak, id, {s_key(S_SOURCE)} source_key, original, {s_key('original')} t from text_records where {s_exchange('original')} <> {s_exchange(S_SOURCE)}) select pak, source_key, arg_min(original, (id, original)) as target, count(*) - 1 as n_more, min(t) <> max(t) as in_conflict from r where source_key <> '' group by 1, 2"
)
def tm_learnable(spark, d):
    return memory.learnable(read(spark, d, "text_records"))


@query(f"select source_key, tm_id, target_text from (select *, row_number() over (partition by k order by updated_at desc nulls last, tm_id desc) rn from (select *, {s_key('source_text')} k from translation_memory)) where rn = 1")
def tm_upsert_latest(spark, d):
    tm = read(spark, d, "translation_memory").withColumn("k", X.normal_key(F.col("source_text")))
    return incremental.latest(tm, "k", ["updated_at", "tm_id"]).select("source_key", "tm_id", "target_text")


@query("select 'translation_memory' as tbl, count(*) as n from translation_memory union all select 'glossary', count(*) from glossary union all select 'translation_queue', count(*) from translation_queue")
def table_counts(spark, d):
    parts = [read(spark, d, t).agg(F.count(F.lit(1)).alias("n")).select(F.lit(t).alias("tbl"), "n") for t in ("translation_memory", "glossary", "translation_queue")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


# Predicates and classification (2.3, 2.11).


def s_category() -> str:
    z = "lower(concat_ws(' ', coalesce(key_name,''), coalesce(context,''), coalesce(original,'')))"
    cases = []
    for zh, name, words in P.CATEGORIES:
        hit = " or ".join(f"contains({z}, '{w.lower()}')" for w in words)
        if name == "ui":
            hit += " or lower(ext) = '.ini'"
        cases.append(f"when {hit} then '{zh}'")
    return f"case {' '.join(cases)} else '{P.OTHER_CATEGORY[0]}' end"


@query(f"select id, {s_category()} as category from (select distinct id, key_name, context, original, regexp_extract(source_file, '\\.[A-Za-z0-9]+$') as ext from text_records)")
def category_case(spark, d):
    r = read(spark, d, "text_records").select("id", "key_name", "context", "original", F.regexp_extract("source_file", r"\.[A-Za-z0-9]+$", 0).alias("ext")).distinct()
    return r.select("id", X.category(F.col("key_name"), F.col("context"), F.col("original"), F.col("ext")).getField("category").alias("category"))


@query(f"select id, {s_bucket('original')} as bucket from text_records")
def language_buckets(spark, d):
    return read(spark, d, "text_records").select("id", X.language_bucket(F.col("original")).alias("bucket"))


S_TRIM = "regexp_replace(regexp_replace(coalesce(original,''), '^[ \\t\\r\\n]+', ''), '[ \\t\\r\\n]+$', '')"


@query(
    f"select id from (select id, {S_TRIM} s from text_records) where length(s) between 2 and 32767 and not regexp_matches(s, '^[0-9\\s.,:+\\-*/%(){{}}\\[\\]_=<>\\\\/|]+$') and (regexp_matches(s, '[^\\x00-\\x7F]') or contains(s, ' ') or "
    + " or ".join(f"contains(lower(s), '{w}')" for w in P.KEY_HINTS)
    + ")"
)
def candidate_filter(spark, d):
    return read(spark, d, "text_records").where(X.is_candidate(F.col("original"))).select("id")


@query("select doc_id from documents where lower(trim(coalesce(text,''))) not in ('abc','test','测试','null','none','n/a')")
def junk_filter(spark, d):
    return read(spark, d, "documents").where(~X.is_junk(F.col("text"))).select("doc_id")


@query()
def structural_filter(spark, d):
    return read(spark, d, "documents").where(X.is_structural(F.col("text"))).select("doc_id")


@query("select id from text_records where coalesce(is_player_visible, true) and pak in ('ui.pak', 'settings.pak')")
def visible_scope(spark, d):
    return read(spark, d, "text_records").where(X.is_visible(F.col("is_player_visible")) & F.col("pak").isin("ui.pak", "settings.pak")).select("id")


@query("select id from text_records where lower(coalesce(language,'')) in ('vi','mixed')")
def needs_translation(spark, d):
    return read(spark, d, "text_records").where(X.needs_translation(F.col("language"))).select("id")


@query()
def cell_kinds(spark, d):
    return read(spark, d, "text_records").groupBy("col_no", X.cell_kind(F.col("original")).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query()
def natural_text_filter(spark, d):
    return read(spark, d, "text_records").where(X.has_natural_text(F.col("original")) & ~X.is_resource_reference(F.col("original"))).select("id")


@query(
    f"select id, case when review_status in ('risk','failed') then 'at risk' when review_status = 'passed' then 'reviewed' when original <> {S_SOURCE} then 'translated' when source_original is not null then 'untranslated' else status end as state from text_records"
)
def derived_status(spark, d):
    r = read(spark, d, "text_records")
    src = F.coalesce("source_original", "original")
    state = F.when(F.col("review_status").isin("risk", "failed"), "at risk").when(F.col("review_status") == "passed", "reviewed").when(F.col("original") != src, "translated").when(F.col("source_original").isNotNull(), "untranslated").otherwise(F.col("status"))
    return r.select("id", state.alias("state"))


@query(
    "select id, line_no from (select distinct id, pak, source_file, line_no, original, category from text_records) where category = '技能' and contains(lower(original), 'tâm') order by pak, source_file, line_no, id limit 50 offset 5"
)
def faceted_page(spark, d):
    r = read(spark, d, "text_records").select("id", "pak", "source_file", "line_no", "original", "category").distinct()
    return r.where((F.col("category") == "技能") & F.contains(F.lower("original"), F.lit("tâm"))).orderBy("pak", "source_file", "line_no", "id").offset(5).limit(50).select("id", "line_no")


# Aggregations (2.5).


@query(f"with b as (select pak, {s_bucket('original')} k from text_records) select pak, count(*) as total, count(*) filter (where k='zh') as zh, count(*) filter (where k='vi') as vi, count(*) filter (where k='mixed') as mixed, count(*) filter (where k='other') as other, round(100.0 * count(*) filter (where k='zh') / greatest(1, count(*)), 2) as percent from b group by 1")
def language_coverage(spark, d):
    b = read(spark, d, "text_records").select("pak", X.language_bucket(F.col("original")).alias("k"))
    n = {k: F.count_if(F.col("k") == k).alias(k) for k in ("zh", "vi", "mixed", "other")}
    return b.groupBy("pak").agg(F.count(F.lit(1)).alias("total"), *n.values()).withColumn("percent", F.round(F.lit(100.0) * F.col("zh") / F.greatest(F.lit(1), F.col("total")), 2))


@query(f"with b as (select pak, source_file, {s_bucket('original')} k, coalesce(is_player_visible, true) v from text_records) select pak, source_file, count(*) as n, count(*) filter (where k='zh') as zh, count(*) filter (where k in ('vi','mixed')) as open, round(100.0 * count(*) filter (where v and k='zh') / greatest(1, count(*) filter (where v)), 2) as done from b group by 1, 2")
def file_coverage(spark, d):
    b = read(spark, d, "text_records").select("pak", "source_file", X.language_bucket(F.col("original")).alias("k"), X.is_visible(F.col("is_player_visible")).alias("v"))
    return b.groupBy("pak", "source_file").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("k") == "zh").alias("zh"), F.count_if(F.col("k").isin("vi", "mixed")).alias("open"),
        F.round(F.lit(100.0) * F.count_if(F.col("v") & (F.col("k") == "zh")) / F.greatest(F.lit(1), F.count_if(F.col("v"))), 2).alias("done"),
    )


@query("select 'category' as facet, category as value, count(*) as n from text_records group by 2 union all select 'language', language, count(*) from text_records group by 2 union all select 'encoding', encoding, count(*) from text_records group by 2 union all select 'pak', pak, count(*) from text_records group by 2")
def facet_counts(spark, d):
    r = read(spark, d, "text_records")
    facets = F.array(*[F.struct(F.lit(c).alias("facet"), F.col(c).alias("value")) for c in ("category", "language", "encoding", "pak")])
    return r.select(F.explode(facets).alias("f")).groupBy("f.facet", "f.value").agg(F.count(F.lit(1)).alias("n"))


@query("select 'x'||substr(sha256(original),1,24) as content_id, original as text, count(*) as uses, min(id) as first_ord from text_records where original is not null group by original")
def dedup_unique_text(spark, d):
    return dedup.unique_texts(read(spark, d, "text_records"), "original", "id")


@query(f"with {S_TM} select t.id, r.target_text as target from (select distinct id, {S_SOURCE} as s from text_records where {S_SOURCE} is not null) t left join (select * from tm where rn = 1) r on r.key = {s_key('t.s')} and r.key <> ''")
def dedup_fanout(spark, d):
    rows = read(spark, d, "text_records").select("id", F.coalesce("source_original", "original").alias("s")).distinct()
    unique = dedup.unique_texts(rows, "s", "id").withColumn("key", X.normal_key(F.col("text")))
    found = unique.join(memory.trusted_memory(read(spark, d, "translation_memory")), "key").select("content_id", F.col("tm_target").alias("target"))
    return dedup.fan_out(dedup.occurrences(rows, "s", ["id"]), found).select("id", "target")


@query("select source_text, target_text, n, total from (select source_text, target_text, count(*) n, sum(count(*)) over (partition by source_text)::bigint total, row_number() over (partition by source_text order by count(*) desc, target_text) rn from translation_memory where target_text is not null group by 1, 2) where rn = 1")
def majority_vote(spark, d):
    return dedup.majority(read(spark, d, "translation_memory"), "source_text", "target_text")


@query("with c as (select source_file, encoding, count(*) n from text_records where encoding is not null group by 1, 2), r as (select *, sum(n) over (partition by source_file)::bigint total, row_number() over (partition by source_file order by n desc, encoding) rn from c) select source_file, encoding, n, total from r where rn = 1 and n >= 3 and n >= 0.5 * total")
def majority_share(spark, d):
    return dedup.majority_share(read(spark, d, "text_records"), "source_file", "encoding", 3, 0.5)


@query("select id, count(*) as n from text_records group by 1 having count(*) > 1")
def duplicate_ids(spark, d):
    return dedup.duplicate_ids(read(spark, d, "text_records"), "id")


@query("select engine, status, count(*) as n, sum(attempts)::bigint as attempts, count(error) as n_errors, count(distinct source_key) as n_keys from translation_queue group by 1, 2 order by n desc, engine, status limit 30")
def engine_report(spark, d):
    q = read(spark, d, "translation_queue")
    return q.groupBy("engine", "status").agg(F.count(F.lit(1)).alias("n"), F.sum("attempts").alias("attempts"), F.count("error").alias("n_errors"), F.countDistinct("source_key").alias("n_keys")).orderBy(F.desc("n"), "engine", "status").limit(30)


@query(f"with r as (select pak, {s_key('original')} k from text_records where {s_bucket('original')} in ('vi','mixed')) select pak, count(*) as n_records, count(distinct k) as n_texts from r group by 1")
def remaining_counts(spark, d):
    r = read(spark, d, "text_records").where(X.language_bucket(F.col("original")).isin("vi", "mixed")).select("pak", X.normal_key(F.col("original")).alias("k"))
    return r.groupBy("pak").agg(F.count(F.lit(1)).alias("n_records"), F.countDistinct("k").alias("n_texts"))


@query("select lower(trim(source)) as term, count(*) as n_rows, sum(uses)::bigint as uses, arg_max(source, (length(source), source)) as best from glossary where source is not null group by 1")
def glossary_terms(spark, d):
    g = read(spark, d, "glossary").where("source is not null")
    return g.groupBy(F.lower(F.trim("source")).alias("term")).agg(F.count(F.lit(1)).alias("n_rows"), F.sum("uses").alias("uses"), F.max_by("source", F.struct(F.length("source"), "source")).alias("best"))


@query("select source_file, col_no, count(*) filter (where confidence_score >= 40) as high, count(*) filter (where confidence_score >= 15 and confidence_score < 40) as middle, count(*) filter (where confidence_score < 15) as low, case when count(*) filter (where confidence_score >= 40) * 2 > count(*) then 'translatable' when count(*) filter (where confidence_score < 15) * 2 > count(*) then 'protected' else 'review' end as decision from text_records group by 1, 2")
def header_audit(spark, d):
    c = F.col("confidence_score")
    high, low = F.count_if(c >= 40), F.count_if(c < 15)
    decision = F.when(high * 2 > F.count(F.lit(1)), "translatable").when(low * 2 > F.count(F.lit(1)), "protected").otherwise("review")
    return read(spark, d, "text_records").groupBy("source_file", "col_no").agg(high.alias("high"), F.count_if((c >= 15) & (c < 40)).alias("middle"), low.alias("low"), decision.alias("decision"))


@query()
def review_risks(spark, d):
    tm = read(spark, d, "translation_memory")
    return tm.select("tm_id", F.concat_ws(",", X.review_risks(F.col("source_text"), F.col("target_text"))).alias("risks")).where("risks != ''")


@query()
def quality_gate(spark, d):
    tm = read(spark, d, "translation_memory")
    return tm.select("tm_id", X.validation_reason(F.col("source_text"), F.col("target_text")).alias("reason"))


# Joins (2.4).


@query(f"with {S_LEFT}, {S_RIGHT}, r as (select file_hash, line_no, col_no, min(original) target from right_ where original is not null group by 1, 2, 3 having min(original) = max(original)) select id, 'hash_locator_unique' as method, target from left_ join r using (file_hash, line_no, col_no)")
def link_unique_locator(spark, d):
    return linkage.unique_locator(*versions(spark, d))


@query(f"with {S_LEFT}, {S_RIGHT}, r as (select file_hash, line_no, col_no, arg_min(original, (source_file, id)) target from right_ where regexp_matches(original, '{S_CJK}') group by 1, 2, 3) select id, 'first_wins' as method, target from left_ left join r using (file_hash, line_no, col_no)")
def link_first_wins(spark, d):
    return linkage.first_wins_locator(*versions(spark, d))


S_CELLS = "cells as (select file_hash, line_no, col_no, min(original) target from right_ where original is not null group by 1, 2, 3 having min(original) = max(original))"


def s_primary(t: str) -> str:
    return f"(select file_hash, trim(original) row_key, min(line_no) line_no from {t} where col_no = 1 and trim(original) <> '' group by 1, 2 having min(line_no) = max(line_no))"


@query(f"with {S_LEFT}, {S_RIGHT}, {S_CELLS}, lines as (select a.file_hash, a.line_no l, b.line_no r from {s_primary('left_')} a join {s_primary('right_')} b using (file_hash, row_key)) select id, 'tsv_primary_key' as method, target from left_ x join lines on lines.file_hash = x.file_hash and lines.l = x.line_no join cells on cells.file_hash = x.file_hash and cells.line_no = lines.r and cells.col_no = x.col_no")
def link_primary_key(spark, d):
    return linkage.primary_key_join(*versions(spark, d))


@query()
def link_row_signature(spark, d):
    return linkage.signature_join(*versions(spark, d), least=1)


@query(f"with {S_LEFT}, {S_RIGHT}, a as (select file_hash, key_name, min(id) id from left_ where coalesce(key_name,'') <> '' group by 1, 2 having min(id) = max(id)), b as (select file_hash, key_name, min(original) target from right_ where coalesce(key_name,'') <> '' and original is not null group by 1, 2 having min(original) = max(original)) select id, 'ini_section_key' as method, target from a join b using (file_hash, key_name)")
def link_key(spark, d):
    return linkage.key_join(*versions(spark, d))


def s_nth(t: str, cols: str) -> str:
    return f"(select {cols}, id, original, row_number() over (partition by {cols} order by line_no, col_no, id) nth, count(*) over (partition by {cols}) n from {t})"


@query(f"with {S_LEFT}, {S_RIGHT} select a.id, 'ini_key_occurrence' as method, b.original as target from {s_nth('left_', 'file_hash, key_name')} a join {s_nth('right_', 'file_hash, key_name')} b using (file_hash, key_name, nth, n) where coalesce(key_name,'') <> ''")
def link_key_occurrence(spark, d):
    return linkage.key_occurrence_join(*versions(spark, d))


@query(f"with {S_LEFT}, {S_RIGHT} select a.id, 'same_hash_near_order' as method, b.original as target from {s_nth('left_', 'file_hash')} a join {s_nth('right_', 'file_hash')} b using (file_hash, nth, n)")
def link_ordinal(spark, d):
    return linkage.ordinal_join(*versions(spark, d))


@query(f"with {S_LEFT}, {S_RIGHT}, {S_CELLS}, p as (select a.file_hash, count(*) c from (select distinct file_hash, line_no, col_no from left_) a join (select distinct file_hash, line_no, col_no from right_) b using (file_hash, line_no, col_no) group by 1), good as (select p.file_hash from p join (select file_hash, count(distinct (line_no, col_no)) n from left_ group by 1) x using (file_hash) join (select file_hash, count(distinct (line_no, col_no)) n2 from right_ group by 1) y using (file_hash) where c / least(n, n2) >= 0.94) select id, 'same_hash_locator_soft' as method, target from left_ join cells using (file_hash, line_no, col_no) where file_hash in (select file_hash from good)")
def link_soft_locator(spark, d):
    return linkage.soft_locator(*versions(spark, d))


@query(f"with {S_LEFT}, {S_RIGHT}, {S_CELLS}, a as (select distinct file_hash, line_no l, line_no r from left_ where col_no = 1), p as (select *, lead(l) over w ln, lead(r) over w rn from a window w as (partition by file_hash order by l, r)), g as (select file_hash, l + k as l, r + k as r from (select *, unnest(range(1, (ln - l)::bigint)) k from p where ln - l > 1 and ln - l <= 12 and ln - l = rn - r)) select id, 'context_sequence' as method, target from left_ x join g on g.file_hash = x.file_hash and g.l = x.line_no join cells on cells.file_hash = g.file_hash and cells.line_no = g.r and cells.col_no = x.col_no")
def link_context_gap(spark, d):
    left, right = versions(spark, d)
    anchors = left.where("col_no = 1").select("file_hash", F.col("line_no").alias("l_line"), F.col("line_no").alias("r_line")).distinct()
    return linkage.gap_join(anchors, left, right)


@query(f"with {S_LEFT}, m as (select {s_key(S_SOURCE)} k, min(original) target from text_records where original <> {S_SOURCE} group by 1 having min(original) = max(original)) select id, 'exact_text_memory' as method, target from left_ join m on m.k = {s_key('left_.original')} and m.k <> ''")
def link_exact_memory(spark, d):
    left, _ = versions(spark, d)
    source = F.coalesce("source_original", "original")
    return linkage.exact_memory(left, read(spark, d, "text_records").where(F.col("original") != source).select(source.alias("source"), F.col("original").alias("target")))


@query()
def link_migrate(spark, d):
    return linkage.migrate(*versions(spark, d))


@query("with c as (select source_key id, case when quality = 'manual' then 'strict_locator' when quality = 'approved' then 'tsv_primary_key' else 'exact_text_memory' end as method, target_text target from translation_memory where target_text is not null), k as (select id, method, case method when 'tsv_primary_key' then 1 when 'strict_locator' then 8 else 13 end rk, count(distinct target) n_targets, min(target) target from c group by 1, 2), r as (select *, row_number() over (partition by id order by rk) rn from k) select id, method, case when n_targets = 1 then target end as target, n_targets from r where rn = 1")
def candidate_select(spark, d):
    method = F.when(F.col("quality") == "manual", "strict_locator").when(F.col("quality") == "approved", "tsv_primary_key").otherwise("exact_text_memory")
    tm = read(spark, d, "translation_memory").where("target_text is not null")
    return linkage.select_candidates(tm.select(F.col("source_key").alias("id"), method.alias("method"), F.col("target_text").alias("target")))


@query(f"with {S_LEFT}, {S_RIGHT}, a as (select pak, key_name, line_no, min(original) l_value from left_ where original is not null group by 1, 2, 3 having min(original) = max(original)), b as (select pak, key_name, line_no, min(original) r_value from right_ where original is not null group by 1, 2, 3 having min(original) = max(original)) select pak, key_name, line_no, l_value, r_value from a join b using (pak, key_name, line_no)")
def link_composite_key(spark, d):
    return linkage.composite_key_join(*versions(spark, d), ["pak", "key_name", "line_no"], "original")


@query(f"with {S_LEFT}, {S_RIGHT}, a as (select k, min(f) l_file from (select distinct {s_key('original')} k, source_file f from left_) where true group by 1 having min(f) = max(f)), b as (select k, min(f) r_file from (select distinct {s_key('original')} k, source_file f from right_) group by 1 having min(f) = max(f)), na as (select source_file l_file, count(distinct {s_key('original')}) n from left_ group by 1), nb as (select source_file r_file, count(distinct {s_key('original')}) n2 from right_ group by 1), p as (select l_file, r_file, count(*) common from a join b using (k) group by 1, 2) select l_file, r_file, common, common / least(n, n2) as rate from p join na using (l_file) join nb using (r_file) where common >= 5 and ((common >= 20 and common / least(n, n2) >= 0.45) or common / least(n, n2) >= 0.9)")
def link_overlap_pairs(spark, d):
    left, right = (v.withColumn("k", X.normal_key(F.col("original"))) for v in versions(spark, d))
    return linkage.overlap_pairs(left, right, "k")


@query()
def link_content_evidence(spark, d):
    return linkage.content_evidence(*versions(spark, d))


@query("with a as (select source_file as name, count(*) n, max(line_no) last_line from text_records where language = 'vi' group by 1), b as (select source_file as name, count(*) n, max(line_no) last_line from text_records where language = 'zh' group by 1), j as (select coalesce(a.name, b.name) as name, a.n old_n, a.last_line old_last_line, b.n new_n, b.last_line new_last_line, case when a.name is null then 'added' when b.name is null then 'removed' when a.n is distinct from b.n or a.last_line is distinct from b.last_line then 'changed' end as state from a full join b on a.name = b.name) select * from j where state is not null")
def inventory_diff(spark, d):
    """Files as the records of two languages show them."""
    r = read(spark, d, "text_records")
    files = [r.where(F.col("language") == lang).groupBy(F.col("source_file").alias("name")).agg(F.count(F.lit(1)).alias("n"), F.max("line_no").alias("last_line")) for lang in ("vi", "zh")]
    return linkage.inventory_diff(*files, "name", ["n", "last_line"])


@query("select distinct c_custkey from customer where c_custkey not in (select o_custkey from orders where o_custkey is not null)")
def refresh_anti_join(spark, d):
    return dedup.missing_ids(read(spark, d, "customer"), read(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


@query(f"select distinct pak_name, source_key from translation_queue q where not exists (select 1 from translation_memory t where {s_key('t.source_text')} = q.source_key)")
def completed_anti_join(spark, d):
    done = read(spark, d, "translation_memory").select(X.normal_key(F.col("source_text")).alias("source_key"))
    return incremental.pending(read(spark, d, "translation_queue"), done, ["source_key"]).select("pak_name", "source_key").distinct()


@query("with a as (select distinct id from record_edits), b as (select distinct id from text_records) select (select count(*) from a) as n_expected, (select count(*) from b) as n_actual, (select count(*) from a join b using (id)) as n_common, round((select count(*) from a join b using (id)) / greatest(1, (select count(*) from a)), 4) as share")
def id_coverage(spark, d):
    return dedup.id_coverage(read(spark, d, "record_edits").where("id is not null"), read(spark, d, "text_records"), "id")


# Order, chunks, set operations (2.6-2.8).


@query("select source, doc_id, row_no, merged_id from (select source, doc_id, row_number() over (partition by source order by doc_id) row_no, row_number() over (order by source, doc_id) merged_id from documents)")
def merge_tree(spark, d):
    return dedup.merge_tree(read(spark, d, "documents").select("source", "doc_id"), "source", "doc_id")


@query("select doc_id, coalesce(lang, 'und') as lang from documents")
def split_merged(spark, d):
    m = dedup.merge_tree(read(spark, d, "documents").select("source", "doc_id", "lang"), "source", "doc_id")
    return dedup.split_back(m, m.where("lang is null").select("merged_id", F.lit("und").alias("target")), "lang").select("doc_id", "lang")


@query("select source, doc_id, row_no, ceil(row_no / 100.0)::bigint as chunk_no from (select source, doc_id, row_number() over (partition by source order by doc_id) row_no from documents)")
def chunk_assign(spark, d):
    return dedup.chunk(read(spark, d, "documents").select("source", "doc_id"), "source", [F.col("doc_id")], 100)


@query("select source, category, first_ord, uses, row_number() over (partition by source order by first_ord, category) as text_no from (select source, category, min(doc_id) first_ord, count(*) uses from documents where category is not null group by 1, 2)")
def first_appearance(spark, d):
    return dedup.first_appearance(read(spark, d, "documents").where("category is not null"), "source", "category", "doc_id")


@query()
def bucket_pack(spark, d):
    return dedup.greedy_buckets(read(spark, d, "documents"), "source", "doc_id", "text")


@query(f"select source_file, count(*) filter (where {s_bucket('original')} in ('vi','mixed')) as open, row_number() over (order by case when count(*) filter (where {s_bucket('original')} in ('vi','mixed')) > 0 then 0 else 1 end, lower(source_file)) as place from text_records group by 1")
def queue_priority(spark, d):
    open_ = F.count_if(X.language_bucket(F.col("original")).isin("vi", "mixed"))
    files = read(spark, d, "text_records").groupBy("source_file").agg(open_.alias("open"))
    return files.withColumn("place", F.row_number().over(Window.orderBy(F.when(F.col("open") > 0, 0).otherwise(1), F.lower("source_file"))))


@query("with l as (select doc_id, i as line_no, s as line from (select doc_id, unnest(string_split(text, chr(10))) s, generate_subscripts(string_split(text, chr(10)), 1) i from documents where text is not null)) select doc_id, line_no, line from l where trim(line) <> ''")
def unit_scan_lines(spark, d):
    docs = read(spark, d, "documents").where("text is not null")
    return docs.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("p", "line")).where("trim(line) != ''").select("doc_id", (F.col("p") + 1).cast("long").alias("line_no"), "line")


@query("with l as (select doc_id, i, s from (select doc_id, unnest(string_split(text, chr(10))) s, generate_subscripts(string_split(text, chr(10)), 1) i from documents where text is not null)), h as (select doc_id, i as line_no, nullif(regexp_extract(s, '^\\s*\\[([^\\]\\r\\n]+)\\]', 1), '') sec from l) select doc_id, line_no, last_value(sec ignore nulls) over (partition by doc_id order by line_no rows between unbounded preceding and current row) as section from h")
def section_carry_forward(spark, d):
    docs = read(spark, d, "documents").where("text is not null")
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("p", "line")).select("doc_id", (F.col("p") + 1).cast("long").alias("line_no"), F.when(F.regexp_extract("line", r"^\s*\[([^\]\r\n]+)\]", 1) != "", F.concat(F.lit("["), F.regexp_extract("line", r"^\s*\[([^\]\r\n]+)\]", 1), F.lit("]"))).otherwise("").alias("line"))
    return linkage.section_lines(lines, "doc_id").select("doc_id", "line_no", "section")


@query("select source_file, count(*) as n, count(*) filter (where gap > 1) as n_gaps, max(gap) as longest from (select source_file, line_no - lag(line_no) over (partition by source_file order by line_no) gap from (select distinct source_file, line_no from text_records)) group by 1")
def offset_gaps(spark, d):
    w = Window.partitionBy("source_file").orderBy("line_no")
    rows = read(spark, d, "text_records").select("source_file", "line_no").distinct().withColumn("gap", F.col("line_no") - F.lag("line_no").over(w))
    return rows.groupBy("source_file").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("gap") > 1).alias("n_gaps"), F.max("gap").alias("longest"))


@query()
def protected_tokens(spark, d):
    return read(spark, d, "translation_memory").select("tm_id", F.concat_ws("\x1f", X.protected_tokens(F.col("source_text"))).alias("tokens")).where("tokens != ''")


@query()
def token_equality(spark, d):
    return read(spark, d, "translation_memory").where(~X.same_tokens(F.col("source_text"), F.col("target_text"))).select("tm_id")


@query("select tm_id, array_to_string(regexp_extract_all(coalesce(source_text,''), '(</?[A-Za-z][A-Za-z0-9_:-]*(?:=[^<>\\r\\n]*)?>)', 1), '') as tags from translation_memory where regexp_matches(coalesce(source_text,''), '</?[A-Za-z][A-Za-z0-9_:-]*(?:=[^<>\\r\\n]*)?>')")
def tag_skeleton(spark, d):
    return read(spark, d, "translation_memory").select("tm_id", F.array_join(X.structural_tags(F.col("source_text")), "").alias("tags")).where("tags != ''")


@query()
def gram_matches(spark, d):
    """Glossary terms against memory sources: the best near match that leads by a margin."""
    g = read(spark, d, "glossary").where(X.contains_cjk(F.col("target"))).select(F.col("target").alias("query"))
    tm = read(spark, d, "translation_memory").where(X.contains_cjk(F.col("target_text"))).select(F.col("target_text").alias("value"))
    return fuzzy.gram_matches(g, tm)


@query()
def shingle_overlap(spark, d):
    e = read(spark, d, "eval_items").select(F.col("item_id").alias("l_id"), "text")
    return fuzzy.shingle_votes(e, read(spark, d, "documents").select(F.col("doc_id").alias("r_id"), "text"))


# Incremental (2.14).


@query("with r as (select distinct id, field_name, new_value, edited_at, edit_seq from record_edits where id is not null and field_name is not null), x as (select *, row_number() over (partition by id, field_name order by edited_at desc, edit_seq desc) rn, count(distinct edit_seq) over (partition by id, field_name) n_edits from r) select id, field_name, new_value as value, edited_at, edit_seq, n_edits from x where rn = 1")
def edit_log_replay(spark, d):
    return incremental.replay_edits(read(spark, d, "record_edits"))


@query("with e as (select id, new_value, row_number() over (partition by id order by edited_at desc, edit_seq desc) rn from record_edits where field_name = 'original'), r as (select distinct id, original from text_records) select r.id, case when e.id is not null then e.new_value else r.original end as original from r left join (select * from e where rn = 1) e using (id)")
def edit_log_apply(spark, d):
    r = read(spark, d, "text_records").select("id", "original", "status", "note").dropDuplicates(["id", "original"])
    return incremental.apply_edits(r, read(spark, d, "record_edits")).select("id", "original")


@query("select date_trunc('hour', ts) as window_start, event_type, count(*) as n, round(sum(value), 4) as total from events group by 1, 2")
def windowed_events(spark, d):
    return incremental.windowed_counts(read(spark, d, "events"))


@query("select id, status, loaded_at from (select *, row_number() over (partition by id order by loaded_at desc nulls last) rn from text_records) where rn = 1")
def upsert_latest(spark, d):
    return incremental.latest(read(spark, d, "text_records"), "id", ["loaded_at"]).select("id", "status", "loaded_at")
