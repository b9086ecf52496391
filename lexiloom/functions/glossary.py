"""Glossary matching and rule translation (2.11): leftmost-longest automaton, term extraction, dictionaries, polish chain."""

from __future__ import annotations

import re
import unicodedata as ud
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexiloom.functions import text as X


class LiteralMatcher:
    """Replaces glossary terms, the longest from the left, without overlap and regardless of case.

    Matching runs on a lower-cased copy of equal length, so places hold in the text itself.
    """

    def __init__(self, terms: dict[str, str]) -> None:
        self.terms = {self.fold(k): v for k, v in sorted(terms.items(), reverse=True) if k and v}
        self.automaton = None

    @staticmethod
    def fold(s: str) -> str:
        return "".join(low if len(low := c.lower()) == 1 else c for c in s)

    def _ready(self):  # noqa: ANN202
        if self.automaton is None:
            import ahocorasick

            self.automaton = ahocorasick.Automaton()
            for k, v in self.terms.items():
                self.automaton.add_word(k, (len(k), v))
            self.automaton.make_automaton()
        return self.automaton

    def __call__(self, text: str | None) -> tuple[str | None, int]:
        if not text or not self.terms:
            return text, 0
        low = self.fold(text)
        if low in self.terms:
            return self.terms[low], 1
        out, at, n = [], 0, 0
        for end, (size, target) in self._ready().iter_long(low):
            start = end + 1 - size
            # Words in letters must end where the term does.
            if low[start].isalpha() and not "㐀" <= low[start] <= "鿿" and ((start and low[start - 1].isalnum()) or (end + 1 < len(low) and low[end + 1].isalnum())):
                continue
            out += (text[at:start], target)
            at, n = end + 1, n + 1
        return "".join([*out, text[at:]]), n

    def __getstate__(self) -> dict:
        return {"terms": self.terms, "automaton": None}


def apply_glossary(rows: DataFrame, text: str, glossary: DataFrame, most_terms: int = 200_000) -> DataFrame:
    """Rows with ``matched`` text, the number of replaced terms, and ``complete`` where only CJK is left.

    The automaton is shared with the tasks only up to ``most_terms`` terms; a larger glossary is applied through whole-text
    equality by a join, and refused for parts of texts.
    """
    terms = glossary.where((X.text_or_empty("source") != "") & (X.text_or_empty("target") != "")).groupBy("source").agg(F.min("target").alias("target"))
    got = terms.limit(most_terms + 1).collect()
    if len(got) > most_terms:
        raise ValueError(f"glossary of more than {most_terms} terms: join it on whole texts, or split it by domain")
    shared = rows.sparkSession.sparkContext.broadcast(LiteralMatcher({r["source"]: r["target"] for r in got}))

    @F.pandas_udf("matched string, n_terms long")
    def match(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([shared.value(t) for t in texts], columns=["matched", "n_terms"])

    out = rows.withColumn("_m", match(F.col(text)))
    return out.withColumns({"matched": F.col("_m.matched"), "n_terms": F.col("_m.n_terms")}).withColumn("complete", (F.col("n_terms") > 0) & X.is_pure_cjk(F.col("matched"))).drop("_m")


def glossary_terms(rows: DataFrame, text: str, longest_cjk: int = 8) -> DataFrame:
    """Title phrases of two to eight words, words, and runs of CJK up to ``longest_cjk``; with uses and the best display form."""
    t = F.regexp_replace(X.text_or_empty(text), r"<[^<>\r\n]{1,160}>|%[-+#0]*\d*\.?\d*[a-zA-Z]|\{[^{}]*\}", " ")
    title = r"(\p{Lu}[\p{Ll}\p{M}]*(?:[ \t]+\p{Lu}[\p{Ll}\p{M}]*){1,7})"
    found = F.concat(*(F.regexp_extract_all(t, F.lit(p), F.lit(1)) for p in (title, r"([A-Za-z\x{00C0}-\x{024F}\x{1E00}-\x{1EFF}]+)", r"([\x{3400}-\x{9FFF}]+)")))
    terms = rows.select(F.explode(found).alias("term")).where((F.length("term") > 1) & ~F.col("term").rlike("^[A-Z]{1,3}$") & (~F.col("term").rlike(r"^[\x{3400}-\x{9FFF}]+$") | (F.length("term") <= longest_cjk)))
    upper = F.length("term") - F.length(F.regexp_replace("term", r"\p{Lu}", ""))
    return terms.groupBy(F.lower("term").alias("key")).agg(F.count(F.lit(1)).alias("uses"), F.max_by("term", F.struct(F.length("term"), upper, "term")).alias("term"))


def translate(text: str | None, phrases: dict[str, str], words: dict[str, str]) -> str | None:
    """Phrases first, the longest from the left, then single words; blanks between CJK close up."""
    if text is None:
        return None
    done, _ = LiteralMatcher(phrases)(ud.normalize("NFC", text))
    done = re.sub(r"[^\W\d_]+", lambda m: words.get(m[0].lower(), m[0]), done or "")
    return re.sub(r"(?<=[㐀-鿿])[ \t]+(?=[㐀-鿿])", "", done)


def polish(c: Column, steps: list[Callable[[Column], Column]]) -> Column:
    """A chain of rules, each a native expression; a rule that gives null leaves the text as it is."""
    for step in steps:
        c = F.coalesce(step(c), c)
    return c


def replacements(pairs: list[tuple[str, str]], ignore_case: bool = True) -> Callable[[Column], Column]:
    """A rule of literal replacements, longest first."""
    ordered = sorted(pairs, key=lambda p: (-len(p[0]), p[0]))

    def step(c: Column) -> Column:
        for old, new in ordered:
            c = F.regexp_replace(c, ("(?iu)" if ignore_case else "") + r"\Q" + old + r"\E", new.replace("\\", "\\\\").replace("$", "\\$"))
        return c

    return step
