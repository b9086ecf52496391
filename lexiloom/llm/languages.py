"""Problem 6: missing or wrong language labels, and the stretches of records in several languages.

Method: error-correcting output codes. Each language has a codeword of the exhaustive code (2^(k-1) - 1 bits for k languages);
one binary n-gram classifier a bit gives a margin, and loss-weighted decoding takes the codeword with the least loss. The
gap to the second codeword gives a confidence; a sentence with too small a gap is ambiguous and follows its neighbours.

The classifiers are fitted on a bounded sample of labelled records (their labels may be wrong: naive Bayes weights
bear that) and on the same Vietnamese texts without their marks. All records are classified, every one whole.

Defined results: records without a sentence (null, empty, only tokens, numbers or signs) have no language and are no cases;
nor are garbled ones. Bracketed or quoted asides, names and fragments of fewer than MIN_WORDS words that aren't short
sentences surely of another language belong to the sentence before them. Repeated rows give one case per id and segment.
"""

from __future__ import annotations

import itertools
import math
import re
import unicodedata as ud
from collections import Counter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.llm import mojibake, residue
from lexiloom.llm.common import map_columns, spread, table

LANGUAGES = ("vi", "zh", "en", "id")
#: Bound on the sample, longest n-gram, least count of an n-gram, least words (or Han characters) of a sentence.
SAMPLE_ROWS, LONGEST, LEAST_COUNT, MIN_WORDS, MIN_HAN = 12000, 4, 3, 3, 4
#: Confidence from which on a fragment of two words or more is a stretch of its own.
SURE = 0.95
#: Gap of mean losses under which a sentence is ambiguous; sharpness of the confidence.
AMBIGUOUS, SHARPNESS = 0.05, 6.0

ASIDE = re.compile(r"\([^()\n]*\)|（[^（）\n]*）|\[[^\[\]\n]*\]|【[^【】\n]*】|“[^“”\n]*”|«[^«»\n]*»|\"[^\"\n]*\"")
BREAK = re.compile(r"(?<=[。！？])|(?<=[.!?…])(?=\s|$)|\n+|\s[|/]\s")
WORD = re.compile(r"[㐀-鿿]|[^\W\d_]+")
ENDERS = ".!?…。！？"


def code(k: int) -> list[list[int]]:
    """The exhaustive code: all splits of k languages into two sides, as +1 and -1, a row for each language."""
    columns = [(1, *rest) for rest in itertools.product((1, -1), repeat=k - 1) if -1 in rest]
    return [[c[i] for c in columns] for i in range(k)]


def grams(word: str) -> list[str]:
    """Character n-grams of a word with its borders, and the word itself."""
    if "㐀" <= word <= "鿿":
        return ["han", word]
    w = f"^{word}$"
    return [w[i : i + n] for n in range(2, LONGEST + 1) for i in range(len(w) - n + 1)] + [w]


def plain(text: str) -> str:
    """Without tone marks and other marks."""
    return "".join(c for c in ud.normalize("NFD", text.replace("đ", "d").replace("Đ", "D")) if not ud.combining(c))


class Classifier:
    """The bits' classifiers, and decoding."""

    def __init__(self, labelled: list[tuple[str, str]]) -> None:
        counts = {lang: Counter() for lang in LANGUAGES}
        for text, lang in labelled:
            for w in WORD.findall(text.lower()):
                counts[lang].update(grams(w))
        every = sum(counts.values(), Counter())
        vocabulary = [g for g, n in every.items() if n >= LEAST_COUNT]
        self.code = code(len(LANGUAGES))
        bits = len(self.code[0])
        # Each language weighs the same within its side, however many records it has.
        rate = {}
        for lang in LANGUAGES:
            total = sum(counts[lang].values()) + len(vocabulary)
            rate[lang] = {g: (counts[lang][g] + 0.5) / total for g in vocabulary}
        self.weights: dict[str, tuple[float, ...]] = {}
        for g in vocabulary:
            row = []
            for b in range(bits):
                plus = [rate[lang][g] for i, lang in enumerate(LANGUAGES) if self.code[i][b] > 0]
                minus = [rate[lang][g] for i, lang in enumerate(LANGUAGES) if self.code[i][b] < 0]
                row.append(max(-6.0, min(6.0, math.log(sum(plus) / len(plus)) - math.log(sum(minus) / len(minus)))))
            self.weights[g] = tuple(row)
        self.bits = bits
        self.known: dict[str, tuple[list[float], int]] = {}

    def word(self, w: str) -> tuple[list[float], int]:
        if (got := self.known.get(w)) is None:
            rows = [r for g in grams(w) if (r := self.weights.get(g))]
            got = ([sum(c) for c in zip(*rows, strict=True)] if rows else [0.0] * self.bits, len(rows))
            if len(self.known) < 200_000:
                self.known[w] = got
        return got

    def margins(self, words: list[str]) -> list[float]:
        total, n = [0.0] * self.bits, 0
        for w in words:
            row, k = self.word(w)
            n += k
            for b in range(self.bits):
                total[b] += row[b]
        return [x / max(1, n) for x in total]

    def decode(self, words: list[str]) -> tuple[str, float, bool]:
        """Language, confidence, whether it is ambiguous."""
        f = self.margins(words)
        losses = sorted((sum(math.log1p(math.exp(-max(-20.0, min(20.0, m * z)))) for m, z in zip(row, f, strict=True)) / self.bits, lang) for row, lang in zip(self.code, LANGUAGES, strict=True))
        parts = [math.exp(-SHARPNESS * (loss - losses[0][0])) for loss, _ in losses]
        return losses[0][1], 1 / sum(parts), losses[1][0] - losses[0][0] < AMBIGUOUS

    def __getstate__(self) -> dict:
        return self.__dict__ | {"known": {}}


class Labeller:
    def __init__(self, classifier: Classifier, protected: list[str]) -> None:
        self.classifier = classifier
        self.protected = re.compile("|".join(f"(?:{p})" for p in protected)) if protected else None

    def sentences(self, text: str) -> list[tuple[list[str], bool]]:
        """Words of each sentence and fragment, and whether it ends like a sentence."""
        text = ASIDE.sub(" ", self.protected.sub(" ", text) if self.protected else text)
        return [(words, part.rstrip()[-1] in ENDERS) for part in BREAK.split(text) if (words := WORD.findall((part or "").lower()))]

    def __call__(self, text: str | None) -> tuple[str | None, float, list[tuple[str, float, bool]]]:
        """Language of the record (``mixed`` for several), its confidence, and its stretches with theirs and whether they are ambiguous."""
        found: list[tuple[str, float, bool, int]] = []
        loose: list[str] = []
        for words, ended in self.sentences(text) if text else ():
            han = sum("㐀" <= w <= "鿿" for w in words)
            got = self.classifier.decode(words)
            short = han < MIN_HAN and len(words) - han < MIN_WORDS
            # A fragment goes with the sentence before it, unless it ends like a sentence and is surely of another language.
            if short and not (found and ended and len(words) > 1 + (han > 0) and got[1] >= SURE and not got[2] and got[0] != found[-1][0]):
                if found:
                    continue
                loose += words
            else:
                if loose:
                    got, loose, words = self.classifier.decode(loose + words), [], loose + words
                found.append((*got, len(words)))
        if loose:
            found.append((*self.classifier.decode(loose), len(loose)))
        if not found:
            return None, 0.0, []
        sure = [x for x in found if not x[2]] or found
        main = Counter()
        for lang, confidence, _, n in sure:
            main[lang] += confidence * n
        last = max(main, key=lambda k: (main[k], k))
        runs: list[list] = []
        for lang, confidence, ambiguous, _ in found:
            if ambiguous:  # follows the sentence before it, or the record's main language
                lang = runs[-1][0] if runs else last
            if runs and runs[-1][0] == lang:
                runs[-1][1].append((confidence, ambiguous))
            else:
                runs.append([lang, [(confidence, ambiguous)]])
        stretches = [(lang, sum(c for c, _ in cs) / len(cs), all(a for _, a in cs)) for lang, cs in runs]
        whole = sum(c for _, c, _ in stretches) / len(stretches)
        return (stretches[0][0] if len(stretches) == 1 else "mixed"), whole, stretches


def base_label(label: str | None) -> str:
    """A label without region and case."""
    return re.split(r"[-_]", (label or "").strip().lower())[0]


def labelled_records(spark: SparkSession, sf_dir: str) -> list[tuple[str, str]]:
    """A bounded sample of records with their labels."""
    rows = table(spark, sf_dir, "text_records").select("id", "language", "original").where("original is not null and language is not null")
    picked = residue.sample(rows, "id", SAMPLE_ROWS).select("original", "language").collect()
    return sorted((r["original"], base_label(r["language"])) for r in picked)


def fitted(labelled: list[tuple[str, str]]) -> Classifier:
    """The classifiers of labelled texts, and of the same Vietnamese texts without their marks."""
    labelled = [(t, lang) for t, lang in labelled if lang in LANGUAGES]
    return Classifier(labelled + [(plain(t), lang) for t, lang in labelled if lang == "vi" and not t.isascii() and not re.search("[㐀-鿿]", t)])


def labeller(spark: SparkSession, sf_dir: str) -> Labeller:
    return Labeller(fitted(labelled_records(spark, sf_dir)), residue.protected_patterns(spark, sf_dir))


def languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, language, seg_no, lang, confidence, ambiguous, mixed, garbled): segment 0 is the record, 1, 2, ... its stretches.

    Every record has a segment 0; its lang is null where it holds no sentence. A garbled one is read as it can be restored.
    """
    shared = spark.sparkContext.broadcast((labeller(spark, sf_dir), mojibake.repairer(spark, sf_dir)))
    rows = table(spark, sf_dir, "text_records").select("id", "language", "original").where("id is not null")

    def run(id: list, language: list, original: list) -> dict[str, list]:
        label, repair = shared.value
        out: dict[str, list] = {"id": [], "language": [], "seg_no": [], "lang": [], "confidence": [], "ambiguous": [], "mixed": [], "garbled": []}
        for key, given, text in zip(id, language, original, strict=True):
            garbled, text = repair(text)
            whole, confidence, stretches = label(text)
            for n, (lang, c, unsure) in enumerate([(whole, confidence, all(s[2] for s in stretches)), *stretches]):
                for name, x in zip(out, (key, given, n, lang, round(c, 6), unsure, len(stretches) > 1, garbled), strict=True):
                    out[name].append(x)
        return out

    return map_columns(spread(rows), run, "id string, language string, seg_no int, lang string, confidence double, ambiguous boolean, mixed boolean, garbled boolean")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    every = languages(spark, sf_dir).where("lang is not null and not garbled")
    given = F.split(F.lower(F.trim(F.coalesce("language", F.lit("")))), "[-_]")[0]
    return every.where(((F.col("seg_no") == 0) & (given != F.col("lang"))) | ((F.col("seg_no") > 0) & F.col("mixed"))).select("id", "seg_no", "lang").distinct()


def p6_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record with its language and confidence."""
    return languages(spark, sf_dir).where("seg_no = 0").select("id", "lang", "confidence", "ambiguous", "garbled").distinct()


def p6_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stretch of every mixed record with its language and confidence."""
    return languages(spark, sf_dir).where("seg_no > 0 and mixed").select("id", "seg_no", "lang", "confidence", "ambiguous", "garbled").distinct()


QUERIES = {"p6_found": p6_found, "p6_labels": p6_labels, "p6_segments": p6_segments}
