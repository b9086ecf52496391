"""Problem 5: text that was decoded with the wrong character set.

Method: round-trip repair. Stretches of a text are encoded again in the character set they seem to have been read in,
decoded strictly in the one that was meant, and the result is kept if the garbling cost drops; this repeats while it
helps, for text that was garbled more than once. The garbling cost is the length of the text in bits under the
frequencies of code points in the whole corpus, counted natively; words garbled from the Vietnamese TCVN3 set are judged
by the words of the corpus.

Garbling leaves signs that can't be undone: U+FFFD, private-use code points and C1 controls. A value that has them is a
case, too, with whatever could be repaired.

Defined results: null and empty values are no cases. Repeated rows give one case per key and field. Values are read whole.
"""

from __future__ import annotations

import math
import re
import unicodedata as ud
from collections import Counter

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.functions import codecs
from lexiloom.llm.common import code_points, map_columns, spread, table

#: Least count of a Vietnamese word.
LEAST_WORD = 3
#: A Han character is known from this many per million code points on; bits of a code point that never occurs.
KNOWN_PER_MILLION, UNSEEN_BITS = 4.0, 24.0
#: Bits by which the cost must drop.
DROP = 4.0

VIETNAMESE = "àáâãèéêìíòóôõùúýăđĩũơưạảấầẩẫậắằẳẵặẹẻẽếềểễệỉịọỏốồổỗộớờởỡợụủứừửữựỳỵỷỹ"
VIETNAMESE += VIETNAMESE.upper()
MARKS = "\u0300\u0301\u0302\u0303\u0306\u0309\u031b\u0323"
def _single_bytes(*names: str) -> dict[str, int]:
    """Code point to byte of the upper half of single-byte character sets; undefined bytes stand for themselves."""
    out: dict[str, int] = {}
    for b in range(0x80, 0x100):
        for name in names:
            try:
                out.setdefault(bytes([b]).decode(name), b)
            except UnicodeDecodeError:
                out.setdefault(chr(b), b)
    return out


READ_AS = {"latin": _single_bytes("cp1252", "latin-1"), "mac": _single_bytes("mac_roman"), "dos437": _single_bytes("cp437"), "dos850": _single_bytes("cp850"), "viet1258": _single_bytes("cp1258")}
RUNS = {k: re.compile("[" + re.escape("".join(v)) + "]+") for k, v in READ_AS.items()}
GBK_RUN = re.compile(r"[^\x00-\x7F]+[A-Za-z]?(?:[^\x00-\x7F]+[A-Za-z]?)*|[^\x00-\x7F]+")
LATIN_WORD = re.compile(r"[A-Za-z\u0080-ÿ]+")
LOST = re.compile("[�\x80-\x9f-\U000f0000-\U000ffffd]")


def _tcvn3() -> dict[str, str]:
    return {chr(b): c for b, c in codecs.TCVN3.items()}


TCVN3_MAP = _tcvn3()
#: Signs of a TCVN3 word that no Vietnamese word has.
TCVN3_ONLY = re.compile("[" + re.escape("".join(c for c in TCVN3_MAP if c not in VIETNAMESE)) + "]")


def as_1258(text: str) -> str:
    """Composed letters as the letter of code page 1258 and its tone mark."""
    if text.isascii():
        return text
    out = []
    table_ = READ_AS["viet1258"]
    for ch in text:
        if ch not in table_ and len(d := ud.normalize("NFD", ch)) > 1:
            for k in range(len(d) - 1, 0, -1):
                for tone in range(1, len(d)):
                    base = ud.normalize("NFC", d[:tone] + d[tone + 1 :])
                    if base in table_ or base.isascii():
                        ch = base + d[tone]
                        break
                break
        out.append(ch)
    return "".join(out)


class Repairer:
    def __init__(self, counts: dict[str, int], words: set[str]) -> None:
        total = sum(counts.values()) or 1
        self.bits = {c: math.log2(total / n) for c, n in counts.items()}
        self.words = words
        least = KNOWN_PER_MILLION * total / 1e6
        han = "".join(c for c, n in counts.items() if "一" <= c <= "鿿" and n >= least)
        self.han = set(han)
        # What well-formed text consists of; any other code point makes a value worth a trial.
        plain = "\x00-\x7f" + VIETNAMESE + han + "　-〿！-～…–—“”‘’" + "̛̣̀́̂̃̆̉"
        self.odd = re.compile(f"[^{plain}]")
        self.fine = set(VIETNAMESE) | self.han | set("，。！？；：、（）【】《》“”‘’…—–•·")

    def cost(self, text: str) -> float:
        get = self.bits.get
        return sum(get(c, UNSEEN_BITS) for c in text)

    # One layer, one pair of character sets.

    def _from_single(self, text: str, name: str, meant: str) -> str:
        bytes_of = READ_AS[name]
        source = as_1258(text) if name == "viet1258" else text

        def undo(m: re.Match) -> str:
            raw = bytes(bytes_of[c] for c in m[0])
            if len(raw) < 2:
                return m[0]
            for a in (0, 1):  # a sign before or after the stretch may belong to the run by chance
                for z in (len(raw), len(raw) - 1):
                    if z - a < 2:
                        continue
                    try:
                        new = raw[a:z].decode(meant)
                    except UnicodeDecodeError:
                        continue
                    if self._plausible(new, meant):
                        return m[0][:a] + new + m[0][z:]
            return m[0]

        new = RUNS[name].sub(undo, source)
        return text if new == source else new

    def _plausible(self, new: str, meant: str, layered: bool = True) -> bool:
        """Whether a stretch may be what was meant: letters and signs of the corpus, or (``layered``) another layer of garbling."""
        if meant == "utf-8":
            return not new.isascii() and all(c.isascii() or c in self.fine or c in MARKS or "　" <= c <= "〿" or "＀" <= c <= "￯" or layered and (c in READ_AS["latin"] or c in READ_AS["viet1258"]) for c in new)
        return any(c in self.han for c in new) and all(c in self.han or c in self.fine or "　" <= c <= "〿" or "＀" <= c <= "￯" for c in new)

    def _from_gbk(self, text: str) -> str:
        """Stretches whose GBK bytes are UTF-8."""

        def undo(m: re.Match) -> str:
            try:
                raw = m[0].encode("gb18030")
                new = raw.decode("utf-8")
            except UnicodeError:
                return self._gbk_parts(m[0])
            return new if self._plausible(new, "utf-8", layered=False) else m[0]

        return GBK_RUN.sub(undo, text)

    def _gbk_parts(self, run: str) -> str:
        """The longest parts, from the left, whose GBK bytes are UTF-8."""
        raw, ends = bytearray(), [0]
        for c in run:
            raw += c.encode("gb18030", "replace")
            ends.append(len(raw))
        place = {byte: i for i, byte in enumerate(ends)}
        out, i = [], 0
        while i < len(run):
            # How far the bytes from here on are UTF-8; of the places there where a sign of the run ends too, the last.
            try:
                stop = len(raw) if bytes(raw[ends[i] :]).decode("utf-8") is not None else 0
            except UnicodeDecodeError as e:
                stop = ends[i] + e.start
            j = next((place[b] for b in range(stop, ends[i], -1) if b in place), i)
            new = bytes(raw[ends[i] : ends[j]]).decode("utf-8", "ignore")
            if j > i and not new.isascii() and len(new) < 2 * (j - i) and self._plausible(new, "utf-8", layered=False):
                out.append(new)
                i = j
            else:
                out.append(run[i])
                i += 1
        return "".join(out)

    def _from_tcvn3(self, text: str) -> str:
        """Words that only make sense in TCVN3, and their neighbours that make no less sense there."""
        if not TCVN3_ONLY.search(text):
            return text
        hits = 0
        new_of: dict[int, tuple[int, str]] = {}
        for m in LATIN_WORD.finditer(text):
            new = ud.normalize("NFC", "".join(TCVN3_MAP.get(c, c) for c in m[0]))
            if new == m[0]:
                continue
            known = new.lower() in self.words
            if known and TCVN3_ONLY.search(m[0]) and re.search("[A-Za-z]", m[0]):
                hits += 1 + (len(m[0]) >= 3)
                new_of[m.start()] = (m.end(), new)
            elif known and m[0].lower() not in self.words:
                new_of[m.start()] = (m.end(), new)
        if hits < 2:
            return text
        out, at = [], 0
        for start, (end, new) in sorted(new_of.items()):
            out += (text[at:start], new)
            at = end
        return "".join([*out, text[at:]])

    def layer(self, text: str) -> str:
        """The best of one layer's candidates, or the text itself."""
        before = self.cost(text)
        best, least = text, before - DROP
        trials = [("latin", "utf-8"), ("mac", "utf-8"), ("dos437", "utf-8"), ("dos850", "utf-8"), ("viet1258", "utf-8"), ("latin", "gbk"), ("viet1258", "gbk"), ("mac", "gbk")]
        for name, meant in trials:
            if RUNS[name].search(text):
                new = self._from_single(text, name, meant)
                if new != text and (c := self.cost(new)) < least:
                    best, least = new, c
        new = self._from_gbk(text)
        if new != text and (c := self.cost(new)) < least:
            best, least = new, c
        new = self._from_tcvn3(text)
        if new != text and self.cost(new) < before:
            if self.cost(new) < least:
                best = new
        return best

    def __call__(self, text: str | None) -> tuple[bool, str | None]:
        """Whether the value is garbled, and the value with what could be restored."""
        if not text or not self.odd.search(text):
            return False, text
        new = text
        while (step := self.layer(new)) != new:  # every layer lowers the cost, so this ends
            new = step
        return new != text or bool(LOST.search(text)), new


FIELDS = (("text_records", "original", "id"), ("translation_memory", "source_text", "tm_id"), ("translation_memory", "target_text", "tm_id"))


def values(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = None
    for tbl, field, key in FIELDS:
        one = table(spark, sf_dir, tbl).select(F.lit(tbl).alias("tbl"), F.lit(field).alias("field_name"), F.col(key).cast("string").alias("rec_key"), F.col(field).alias("value"))
        out = one if out is None else out.unionByName(one)
    return out


def repairer(spark: SparkSession, sf_dir: str) -> Repairer:
    rows = values(spark, sf_dir)
    # ASCII letters keep their places in any garbling: they count as one sum, shared out.
    counts = {c: n for c, n in code_points(rows, "value").items() if c > "\x7f"}
    everything = sum(counts.values()) or 1
    counts |= {chr(i): max(1, everything // 20) for i in range(128)}
    bare = Repairer(counts, set())

    def run(value: list) -> dict[str, list]:
        clean = (v.lower() for v in value if v and not bare.odd.search(v))
        seen = Counter(w for text in clean for w in re.findall(f"[a-z{VIETNAMESE}]+", text) if not w.isascii())
        return {"word": list(seen), "n": list(seen.values())}

    words = map_columns(spread(rows.select("value")), run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_WORD)
    return Repairer(counts, {r["word"] for r in words.select("word").collect()})


def repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(tbl, field_name, rec_key, restored) of every garbled value."""
    shared = spark.sparkContext.broadcast(repairer(spark, sf_dir))

    def run(tbl: list, field_name: list, rec_key: list, value: list) -> dict[str, list]:
        f = shared.value
        out: dict[str, list] = {"tbl": [], "field_name": [], "rec_key": [], "restored": []}
        for a, b, k, v in zip(tbl, field_name, rec_key, value, strict=True):
            garbled, new = f(v)
            if garbled and k is not None:
                for c, x in zip(out, (a, b, k, new), strict=True):
                    out[c].append(x)
        return out

    return map_columns(spread(values(spark, sf_dir)), run, "tbl string, field_name string, rec_key string, restored string")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repaired(spark, sf_dir).select("tbl", "field_name", "rec_key").distinct()


def p5_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repaired(spark, sf_dir).distinct()


QUERIES = {"p5_found": p5_found, "p5_restored": p5_restored}
