"""Problem 3: text that looks the same on the screen but is stored with other characters.

Method: look-alike classes are the components of a union-find over strings and code points. Its edges come from the code
points that the texts hold: compatibility forms (full-width, radicals), every order of a letter's combining marks, blanks,
and the table of letters of other scripts. The member seen most often stands for its class, and texts are rewritten
greedily, longest match first, by an Aho-Corasick automaton over all members, until nothing changes.

Only distinct code points and their counts reach the driver: at most the 1.1 million of Unicode, in practice thousands.

Defined results: null texts have no form and no partner; an empty text's form is empty and pairs with no row. Invisible
code points (zero-width, soft hyphen, byte order marks) vanish; all blanks of one cell are the same, but their number
counts. Case, tone marks and other letters are kept. Repeated rows give each pair once. Other columns are ignored.
"""

from __future__ import annotations

import unicodedata as ud
from collections import Counter
from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.llm.common import code_points, map_columns, salt_of, spread, table

# Letters of other scripts that look like Latin ones, by Latin letter.
LETTERS = {
    "A": "АΑᎪ", "B": "ВΒᏴ", "C": "СᏟϹ", "D": "Ꭰ", "E": "ЕΕᎬ", "G": "ԌᏀ", "H": "НΗᎻ", "I": "ІΙӀ", "J": "ЈᎫ", "K": "КΚᏦ", "L": "Ꮮ", "M": "МΜᎷ", "N": "Ν", "O": "ОΟՕ",
    "P": "РΡᏢ", "Q": "Ԛ", "S": "ЅՏᏚ", "T": "ТΤᎢ", "U": "Ս", "V": "ѴᏙ", "W": "ԜᎳ", "X": "ХΧ", "Y": "ҮΥᎩ", "Z": "ΖᏃ", "Đ": "ÐƉ",
    "a": "аɑα", "c": "сϲ", "d": "ԁ", "e": "е", "g": "ɡ", "h": "һ", "i": "іι", "j": "јϳ", "k": "κ", "l": "ӏ", "n": "ո", "o": "оοօ", "p": "рρ", "q": "ԛ", "s": "ѕ", "u": "սυ", "v": "ѵν", "w": "ԝ", "x": "х", "y": "уү",
}
# Radicals without a compatibility form, with their characters.
RADICALS = "⺟母⻄西⻅见⻆角⻉贝⻋车⻑長⻓长⻔门⻘青⻙韦⻚页⻛风⻜飞⻝食⻢马⻣骨⻤鬼⻥鱼⻦鸟⻧卤⻨麦⻩黄⻪黾⻬齐⻭歯⻮齿⻯竜⻰龙⻲亀⻳龟"


class Classes:
    """Union-find over strings."""

    def __init__(self) -> None:
        self.parent: dict[str, str] = {}

    def find(self, x: str) -> str:
        self.parent.setdefault(x, x)
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def union(self, a: str, b: str) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)

    def members(self) -> dict[str, list[str]]:
        out: dict[str, list[str]] = {}
        for x in list(self.parent):
            out.setdefault(self.find(x), []).append(x)
        return out


def spellings(letter: str) -> set[str]:
    """A letter with marks, as any base (also one with some of the marks on it) followed by the other marks in any order."""
    full = ud.normalize("NFD", letter)
    base, marks = full[0], full[1:]
    out: set[str] = set()
    if marks and all(map(ud.combining, marks)):
        for order in permutations(marks):
            for k in range(len(order) + 1):
                head = ud.normalize("NFC", base + "".join(order[:k]))
                if len(head) == 1:
                    out.add(head + "".join(order[k:]))
    return out


def classes(counts: dict[str, int]) -> dict[str, str]:
    """Every member of a look-alike class with its representative, from the counts of code points."""
    uf = Classes()
    foreign = {x: latin for latin, others in LETTERS.items() for x in others}
    radicals = dict(zip(RADICALS[::2], RADICALS[1::2], strict=True))
    seen = set(counts) | {ud.normalize("NFC", latin) for latin in LETTERS}
    # Letters that marks in the texts could compose to count as seen, too.
    marks = [c for c in counts if ud.combining(c)]
    frontier = {c for c in seen if c.isalpha()} | set(LETTERS) | set(foreign)
    while frontier:
        frontier = {x for c in frontier for m in marks if len(x := ud.normalize("NFC", foreign.get(c, c) + m)) == 1} - seen
        seen |= frontier
    for c in seen:
        kind = ud.category(c)
        if kind == "Cf" or c == "͏":
            uf.union(c, "")
        elif kind == "Zs":
            uf.union(c, " ")
        elif c in radicals:
            uf.union(c, radicals[c])
        elif c in foreign:
            uf.union(c, foreign[c])
        else:
            plain = ud.normalize("NFKC", c)
            if len(plain) == 1 and plain != c and (kind[0] in "LN" or ud.east_asian_width(c) == "F" or kind == "So"):
                uf.union(c, plain)
        whole = ud.normalize("NFD", c)
        if len(whole) > 1 and whole[0] in foreign:  # a foreign letter with a mark on it
            plain = ud.normalize("NFC", foreign[whole[0]] + whole[1:])
            if len(plain) == 1:
                uf.union(c, plain)
        for s in spellings(c):
            uf.union(c, s)
    out = {}
    for group in uf.members().values():
        # The empty string stands for what can't be seen; else the member that occurs most, shorter and smaller ones first.
        best = "" if "" in group else " " if " " in group else min(group, key=lambda s: (-counts.get(s, 0), len(s), s))
        out |= {s: best for s in group if s != best}
    return out


class Rewriter:
    """Greedy longest-match rewriting of class members to their representatives."""

    def __init__(self, table_: dict[str, str]) -> None:
        self.table = table_
        self.automaton = None

    def __call__(self, text: str | None) -> str | None:
        if text is None or text.isascii():
            return text
        if self.automaton is None:
            import ahocorasick

            self.automaton = ahocorasick.Automaton()
            for s, to in self.table.items():
                if s:
                    self.automaton.add_word(s, (len(s), to))
            self.automaton.make_automaton()
        # One pass takes out invisible signs and foreign letters, the next composes what has come together, until nothing changes.
        before = {text}
        while True:
            out, at = [], 0
            for end, (n, to) in self.automaton.iter_long(text):
                out += (text[at : end + 1 - n], to)
                at = end + 1
            if not out:
                break
            out.append(text[at:])
            text = "".join(out)
            if text in before:
                break
            before.add(text)
        return text

    def __getstate__(self) -> dict:
        return {"table": self.table, "automaton": None}


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    glossary, memory = table(spark, sf_dir, "glossary"), table(spark, sf_dir, "translation_memory")
    return glossary.select(F.concat(F.lit("g:"), F.col("gloss_id").cast("string")).alias("key"), F.col("source").alias("text")).unionByName(
        memory.select(F.concat(F.lit("t:"), F.col("tm_id").cast("string")).alias("key"), F.col("source_text").alias("text"))
    )


def normalised(rows: DataFrame) -> DataFrame:
    """(key, text) with ``form``, in which visually identical texts are equal."""
    rewrite = Rewriter(classes(code_points(rows, "text")))
    shared = rows.sparkSession.sparkContext.broadcast(rewrite)

    def run(key: list, text: list) -> dict[str, list]:
        f = shared.value
        return {"key": key, "text": text, "form": [f(t) for t in text]}

    return map_columns(spread(rows), run, "key string, text string, form string")


def _id(text: Column) -> list[Column]:
    return [F.xxhash64(text).alias("a"), F.xxhash64(F.lit("second"), text).alias("b")]


#: Copies of a glossary row, each of which meets a part of the rows with its form.
COPIES = 64


def pairs(forms: DataFrame) -> DataFrame:
    """Pairs of a glossary row with any other row of the same form that is stored otherwise.

    Texts travel as pairs of 64-bit hashes. A form has few glossary rows (their sources are unique), so only the other
    side can be hot: its rows are dealt out over ``COPIES`` tasks, to each of which the glossary rows are copied.
    """
    narrow = forms.where("form is not null and form != ''").select("key", F.struct(*_id(F.col("form"))).alias("form"), F.struct(*_id(F.col("text"))).alias("text"))
    left = narrow.where("key like 'g:%'").select(F.col("key").alias("lk"), "form", F.col("text").alias("lt"), F.explode(F.sequence(F.lit(0), F.lit(COPIES - 1))).alias("salt"))
    right = narrow.withColumn("salt", salt_of("key", salts=COPIES))
    both = left.join(right, ["form", "salt"]).where("lt != text and (key like 't:%' or lk < key)")
    return both.select(F.least("lk", "key").alias("key_a"), F.greatest("lk", "key").alias("key_b")).distinct()


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs(normalised(texts(spark, sf_dir)))


def p3_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row whose text had to be rewritten, with its consistent form."""
    return normalised(texts(spark, sf_dir)).where("form != text").select("key", "form")


QUERIES = {"p3_found": p3_found, "p3_forms": p3_forms}
