"""Problem 4: pairs whose answer is empty, cut off, a refusal, the source again or in another language.

Method: a pushdown parser reads tags, brackets, quotations, fences, list items, named fields, sentences and numbers of both sides. An
answer with fewer finished units than its source, with something left open, without the source's end or its last numbers is cut
off, unless it is nearly as long as renderings of its kind are. Only where the parser sees no difference does the length
alone decide, against a learned usual length. Greedy string tiling finds copies of the source, also altered ones; scripts and the
language classifiers of problem 6 check the language, and small grammars in four languages the refusals.

Defined results, in this order: an answer that is null or holds no letter or digit is `empty`; a refusal by its grammar, unless
the source fits the grammar too, `refusal`; the source again `copy`, unless it holds only numbers, codes and tokens;
letters of another language `language`; else `truncated`. A null source leaves copy and truncation undecided. Rows with
residue (problem 2) in the answer or garbled text (problem 5) on either side are never cases. Repeated rows give one.
"""

from __future__ import annotations

import re
import statistics
import unicodedata as ud
from collections import Counter, defaultdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.llm import languages, mojibake, residue
from lexiloom.llm.common import map_columns, spread, table
from lexiloom.llm.languages import Classifier
from lexiloom.llm.tiling import tiling

#: Least number of pairs of a kind for its own usual length; rarer kinds take that of their script and language.
LEAST_PAIRS = 8
#: An answer below SUSPECT of the usual length is truncated where the parser sees a sign of it, below CERTAIN where it sees two; below SHORT
#: without any sign.
SHORT, SUSPECT, CERTAIN = 0.5, 0.72, 0.9
#: Least length of a tile in letters, and least share of both sides that tiles must cover in a copy.
TILE, COVERED = 5, 0.9
#: Bound on the sample that the language classifiers are fitted on; least confidence that another language needs.
SAMPLE_ROWS, CONFIDENT = 8000, 0.7

# Refusal grammars, as declining phrase and its object in either order.
REFUSAL = [
    re.compile(p, re.I)
    for p in (
        r"\b(?:as an? (?:ai|language)(?: language)? model|as an ai)\b",
        r"\b(?:cannot|can't|can not|unable to|won't be able to|have to decline|must decline|decline to|not able to|refuse to)\b.{0,40}\b(?:translat\w*|render\w*|answer|request|passage|text|content)\b",
        r"作为(?:一个)?(?:语言|人工智能|AI)模型",
        r"(?:无法|不能|不便|没有办法|拒绝)(?:为您|给出|提供|处理|协助|完成|翻译|作答|回答|该|此|这|段|对)*(?:译文|翻译|请求|要求|作答|回答|内容|文本|文字)|拒绝作答",
        r"(?:là|với tư cách) (?:một )?mô hình ngôn ngữ",
        r"(?:không thể|không tiện|từ chối|chưa thể|không được phép|phải từ chối)[^.]{0,40}(?:\bdịch\b|bản dịch|yêu cầu này|nội dung này|đoạn văn|đoạn này|văn bản|trả lời|hỗ trợ yêu cầu)",
        r"sebagai model bahasa",
        r"(?:tidak (?:dapat|bisa|mampu)|menolak|harus menolak)[^.]{0,40}(?:menerjemahkan|terjemahan|permintaan|teks ini|konten|menjawab)",
    )
]
VIET = set(mojibake.VIETNAMESE)
#: Asides that renderings may leave out.
ASIDE = re.compile(r"\([^()\n]*\)|（[^（）\n]*）|“[^“”\n]*”|«[^«»\n]*»")
HAN = re.compile("[㐀-鿿]")
WORD = re.compile(r"[㐀-鿿]|[^\W\d_]+|\d+")
NOISE = re.compile(r"[\W_]+")
PAIRS = {"(": ")", "[": "]", "{": "}", "（": "）", "【": "】", "《": "》", "「": "」", "“": "”", "«": "»", "‘": "’"}
DANGLING = re.compile(r"(?:\.\.\.|…|[(\"“（])\s*$")
NUMBER = re.compile(r"(?<!\d)(?<![^\s\w(,:.;，：。；])\d+")
TAG = re.compile(r"<[^<>\n]*>")
CLOSERS = {v: k for k, v in PAIRS.items()}
ENDERS = ".!?。！？…"
STRUCTURE = re.compile(r"```|</?[A-Za-z][^<>]*>|[()\[\]{}（）【】《》「」“”«»\"]|[.!?。！？…]+|[;；\n|]|[^\W_]+", re.S)


def parse(text: str) -> dict[str, int]:
    """Pushdown reading: finished units (sentences, list items, fields), what is left open, whether the end is a sentence's."""
    stack: list[str] = []
    units, words, ended = 0, 0, True
    for m in STRUCTURE.finditer(text):
        t = m[0]
        if t == "```":
            stack.pop() if stack and stack[-1] == t else stack.append(t)
        elif t[0] == "<" and len(t) > 1:
            name = re.match(r"</?([A-Za-z]+)", t)[1].lower()
            if t[1] != "/":
                stack.append("<" + name)
            elif "<" + name in stack:
                del stack[len(stack) - 1 - stack[::-1].index("<" + name) :]
        elif t == '"':
            stack.pop() if stack and stack[-1] == t else stack.append(t)
        elif t in PAIRS:
            stack.append(t)
        elif t in CLOSERS:
            if CLOSERS[t] in stack:
                del stack[len(stack) - 1 - stack[::-1].index(CLOSERS[t]) :]
        elif t[0] in ENDERS or t in ";；\n|":
            if words:
                units += 1
                words, ended = 0, t[0] in ENDERS
        else:
            words += 1
    return {"units": units + (words > 0), "open": len(stack), "ended": int(words == 0 and ended)}


def canon(text: str) -> str:
    return NOISE.sub("", ud.normalize("NFKC", text).casefold())


def is_copy(source: str, target: str) -> bool:
    """Whether tiles of the source, once or more, cover all but a tenth of both sides, formatting aside."""
    s, t = canon(source), canon(target)
    if not s:
        return False
    times = max(1, round(len(t) / len(s)))
    if t == s * times:  # one tile
        return True
    need = COVERED * max(len(t), len(s) * times)
    # Letters that both sides hold are an upper bound of what tiles can cover.
    return sum((Counter(t) & Counter(s * times)).values()) >= need and tiling(t, s * times, TILE) >= need


def code_only(text: str) -> bool:
    """Numbers, codes and tokens: no word of letters alone of two or more, no Han."""
    return not HAN.search(text) and not re.search(r"(?<![\w%{<#@$.\-/])[^\W\d_]{3,}(?![\w@/]|-?\d)", text)


def language(text: str, wanted: str, classifier: Classifier | None) -> str | None:
    """The language of a text where it is surely another than wanted: by script, by marks, else by the classifiers."""
    want = wanted.split("-")[0].lower()
    letters = sum(c.isalpha() for c in text)
    han = len(HAN.findall(text))
    if letters < 3 and not han:
        return None
    if han > 0.4 * letters:
        return None if want == "zh" else "zh"
    words = [w.lower() for w in re.findall(r"[^\W\d_]+", text) if not HAN.search(w)]
    if not words:
        return None
    if sum(any(c in VIET for c in ud.normalize("NFC", w)) for w in words) > 0.25 * len(words):
        got = "vi"
    elif classifier:
        got, confidence, ambiguous = classifier.decode(words)
        got = "?" if ambiguous or confidence < CONFIDENT or got == "zh" else got
    else:
        got = "?"
    if want == "zh":
        return got if letters - han > 0.7 * letters and letters >= 4 else None
    return got if got not in (want, "?") else None


def letters(text: str) -> int:
    return sum(map(str.isalpha, ASIDE.sub(" ", text)))


def kind_of(source: str) -> str:
    names = re.findall(r"(?:^|[;；\n|])\W*[^\W\d_][^:：=;；\n|]{0,30}[:：=]", source)
    if len(names) >= 3:
        return "fields"
    return "text" if len(canon(source)) >= (16 if HAN.search(source) else 45) or re.search(r"[.!?。！？]\s*$", source) else "name"


class Judge:
    """``usual`` has the median ratio of letters by (script, language, kind), and by (script, language) for rare kinds; else pairs give it."""

    def __init__(self, pairs: list[tuple[str, str, str]], protected: list[str], usual: dict[tuple[str, ...], float] | None = None, classifier: Classifier | None = None) -> None:
        self.protected = re.compile("|".join(f"(?i:{p})" for p in protected)) if protected else None
        self.classifier = classifier
        ratios = defaultdict(list)
        for key, ratio in filter(None, (self.measure(*p) for p in pairs)):
            ratios[key].append(ratio)
            ratios[key[:2]].append(ratio)
        self.usual = {k: statistics.median(v) for k, v in ratios.items() if len(v) >= LEAST_PAIRS} if usual is None else usual

    def measure(self, source: str, target: str, lang: str) -> tuple[tuple[str, str, str], float] | None:
        """The kind of a pair and its ratio of letters, where it tells the usual length."""
        s, t = self.clean(source), self.clean(target)
        a, b = letters(s), letters(t)
        return (self._key(s, lang), b / a) if a > 3 and b and not language(t, lang, None) else None

    def clean(self, text: str) -> str:
        return self.protected.sub(" ", text) if self.protected else text

    @staticmethod
    def _key(source: str, lang: str) -> tuple[str, str, str]:
        return ("zh" if len(HAN.findall(source)) > 0.3 * max(1, sum(map(str.isalpha, source))) else "latin", lang, kind_of(source))

    def truncated(self, source: str, target: str, lang: str) -> str | None:
        """``parser`` or ``length``, by what an answer shows itself cut off, else null."""
        s, t = self.clean(ud.normalize("NFC", source)), self.clean(target)
        key = self._key(s, lang)
        usual = self.usual.get(key) or self.usual.get(key[:2])
        a, b = letters(s), letters(t)
        if not usual or a <= 3:
            return None
        share = b / a / usual
        if share >= CERTAIN:
            return None
        s, t = (ASIDE.sub(" ", TAG.sub(" ", ud.normalize("NFKC", x))) for x in (s, t))  # renderings may leave asides out
        p, q = parse(s), parse(t)
        signs = [q["units"] < p["units"], q["open"] > p["open"] or bool(DANGLING.search(t)) and not DANGLING.search(s), bool(p["ended"]) and not q["ended"], bool(Counter(NUMBER.findall(s)) - Counter(NUMBER.findall(t)))]
        if sum(signs) >= 2 or (any(signs) and share < SUSPECT):
            return "parser"
        return "length" if share < SHORT else None

    def __call__(self, source: str | None, target: str | None, lang: str | None) -> str | None:
        if target is None or not any(map(str.isalnum, target)):
            return "empty"
        refuses = any(r.search(target) for r in REFUSAL)
        if refuses and not (source and any(r.search(source) for r in REFUSAL)):
            return "refusal"
        bare = self.clean(source or "")
        if source and code_only(bare) and canon(source):
            return None
        if source and is_copy(source, target):
            return "copy"
        if lang and language(self.clean(target), lang, self.classifier):
            return "language"
        if source and lang and self.truncated(source, target, lang):
            return "truncated"
        return None


def judge(spark: SparkSession, sf_dir: str, classifier: Classifier | None = None) -> Judge:
    """The judge with the usual lengths of all pairs; medians come from a sketch whose error in rank is at most 1 in 10,000."""
    memory = table(spark, sf_dir, "translation_memory").where("source_text is not null and target_text is not null and target_lang is not null")
    protected = residue.protected_patterns(spark, sf_dir)
    bare = Judge([], protected)

    def run(source_text: list, target_text: list, target_lang: list) -> dict[str, list]:
        found = [x for x in map(bare.measure, source_text, target_text, target_lang) if x]
        return {"script": [k[0] for k, _ in found], "lang": [k[1] for k, _ in found], "kind": [k[2] for k, _ in found], "ratio": [r for _, r in found]}

    ratios = map_columns(spread(memory.select("source_text", "target_text", "target_lang")), run, "script string, lang string, kind string, ratio double")
    medians = ratios.rollup("script", "lang", "kind").agg(F.percentile_approx("ratio", 0.5, 10000).alias("usual"), F.count(F.lit(1)).alias("n"))
    rows = medians.where((F.col("n") >= LEAST_PAIRS) & F.col("lang").isNotNull()).collect()
    return Judge([], protected, {(r.script, r.lang, *([r.kind] if r.kind else [])): r.usual for r in rows}, classifier)


def fitted_classifier(spark: SparkSession, sf_dir: str) -> Classifier:
    """The classifiers of problem 6, fitted on a bounded sample of records, and of targets and sources by their languages."""
    memory = table(spark, sf_dir, "translation_memory")
    texts = memory.select("tm_id", F.explode(F.array(F.struct(F.col("target_text").alias("t"), F.col("target_lang").alias("l")), F.struct(F.col("source_text").alias("t"), F.col("source_lang").alias("l")))).alias("x"))
    picked = residue.sample(texts.where("x.t is not null and x.l is not null"), "tm_id", SAMPLE_ROWS).select("x.t", "x.l").collect()
    return languages.fitted([*languages.labelled_records(spark, sf_dir), *sorted((r.t, languages.base_label(r.l)) for r in picked)])


def defects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(tm_id, defect) of every defective pair."""
    shared = spark.sparkContext.broadcast((judge(spark, sf_dir, fitted_classifier(spark, sf_dir)), residue.model(spark, sf_dir), mojibake.repairer(spark, sf_dir)))
    memory = table(spark, sf_dir, "translation_memory").select("tm_id", "source_text", "target_text", "target_lang")

    def run(tm_id: list, source_text: list, target_text: list, target_lang: list) -> dict[str, list]:
        decide, left_over, repair = shared.value
        out: dict[str, list] = {"tm_id": [], "defect": []}
        for key, s, t, lang in zip(tm_id, source_text, target_text, target_lang, strict=True):
            found = decide(s, t, lang)
            if found and key is not None and not left_over.decide(t, s) and not repair(s)[0] and not repair(t)[0]:
                out["tm_id"].append(key)
                out["defect"].append(found)
        return out

    return map_columns(spread(memory), run, "tm_id bigint, defect string")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return defects(spark, sf_dir).groupBy("tm_id").agg(F.min("defect").alias("defect"))


QUERIES = {"p4_found": p4_found}
