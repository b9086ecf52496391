"""Problem 2: unfilled slots, filler, error pages and demands for scripts in place of content.

Method: positive-unlabelled naive Bayes, fitted by expectation-maximisation from trusted residue (the short list below
and what its patterns find in a bounded sample) against everything else, unlabelled. Two such models score the
passages of a record: one its sentences, one its bracketed spans. The record's decision adds them up: it is residue if the model
takes a span for an unfilled slot, or if sentences of residue hold about half of its letters (SHARE). Patterns and phrases
label passages for the fit and decide nothing. Expectation-maximisation stops early (MOST_ROUNDS): run to its end, it takes
the most frequent kind of content, item cards, for residue.

Defined results: null and blank texts are no cases. A record of which residue holds less than SHARE is none. Runtime
tokens of protected_patterns are removed first and never count. A target that renders a source of the same nature is
none. Repeated rows give one case per key; whole texts are read, of any length (reading stops once the decision is
certain).
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexiloom.llm.common import map_columns, spread, table

#: Bound on the sample that the models are fitted on, in records of each table.
SAMPLE_RECORDS = 4000
#: Weight of a trusted passage against an unlabelled one, least log-odds, least share of a record's letters.
TRUST, MARGIN, SHARE = 4.0, 1.0, 0.4
#: Words of a span from which on only its signs and its length count.
WORDS = 12
#: Change of a posterior below which the fit has converged; rounds after which a fit that swings is taken as it is.
CONVERGED, MOST_ROUNDS = 1e-3, 4
#: Both classes are smoothed towards the words of all passages with so many counts; log-odds of a word never seen.
PRIOR, UNKNOWN = 60.0, -2.0
#: Sum of positive log-odds, and its share of all, from which a source counts as being about the same as a target of residue.
ALIKE, ALIKE_SHARE = 6.0, 0.3
# Trusted sentences of residue.
TRUSTED = """
404 Not Found. The page you asked for is gone or was moved.
Error 500: the gateway gave no answer in time. Reference hexid
Access denied. You lack permission to view this page on this server.
Session expired, please sign in again to go on
The service is down for maintenance, please come back later. Error code hexid
Please turn on JavaScript in your browser to read this page.
This site needs scripts and cookies to work. Reload after enabling them.
Your browser has scripts disabled, the page cannot be shown.
Warning: query failed on line 0: table is locked
Traceback: KeyError at request aborted
Checking that you are human before letting you in. This takes 0 seconds. id=hexid
Menu | Home | Login
footer
Lorem ipsum dolor sit amet
sample text sample text sample text
placeholder text placeholder text
your text goes here text goes here
dummy copy here dummy copy here
test test test test
asdf qwer asdf qwer
Lỗi 404: không tìm thấy trang
Quay về trang đầu.
Máy chủ không phản hồi sau 0 giây, tham chiếu hexid
Hệ thống đang nâng cấp, xin quay lại sau. Mã lỗi hexid
Hệ thống đang bảo trì, vui lòng quay lại sau.
Phiên làm việc đã hết hạn, đăng nhập lại
Bạn không có quyền truy cập. Mã yêu cầu hexid
Vui lòng bật JavaScript để xem nội dung này.
Trình duyệt của bạn đang tắt tập lệnh, trang không thể hiển thị.
Trang này cần cookie và tập lệnh để hoạt động.
nội dung mẫu nội dung mẫu
văn bản thử văn bản thử
thử thử thử thử
chữ giữ chỗ chữ giữ chỗ
404 页面不存在
您访问的页面已被删除或移动。
系统维护中，请稍后访问。错误码
登录已过期，请重新登录
没有权限访问，请求编号
网关超时，0 秒内未收到响应
请启用 JavaScript 后再浏览本页面
您的浏览器已禁用脚本，无法显示内容。
本站需要启用脚本和 cookie
这里是示例内容 这里是示例内容
占位文字 占位文字
测试文本 测试文本
示例文本 示例文本
Galat 404: halaman tidak ditemukan.
Server tidak menjawab dalam 0 detik.
Sesi telah berakhir, silakan masuk lagi.
Sistem sedang dalam pemeliharaan, silakan kembali nanti.
Aktifkan JavaScript untuk melihat isi halaman ini. Kode hexid
Anda tidak memiliki izin untuk mengakses halaman ini.
teks contoh teks contoh
isi teks di sini
Máy chủ đang bận, vui lòng thử lại sau
Kết nối đã hết hạn, hãy đăng nhập lại
Không tìm thấy trong danh sách
服务器繁忙，请稍后重试
连接已过期，请重新登录
在列表中找不到
The server is busy, please try again later
The connection has expired, please log in again
Server sedang sibuk, silakan coba lagi nanti
Koneksi telah berakhir, silakan masuk lagi
""".strip().splitlines()

# Words of filler text, and one phrase over and over, make a sentence trusted.
FILLER = re.compile(r"\b(?:lorem|ipsum)\b|^\W*(.{2,24}?)(?:[\s,，.。;；]*\1){2,}\W*$", re.I)

# Spans that are trusted to be slots, by form or by wording.
SLOT_FORM = re.compile(r"^(?:\{\{.*\}\}|\$\{.*\}|<%.*%>|<<.*>>|\[\[.*\]\]|%%.*%%|__[A-Za-z].*__|#[A-Z][A-Z_]{3,}#|@@.*@@|TODO|TBD|FIXME|X{4,}|x{3,}(?:_x{3,})+|_{4,}|STR_.*)$", re.S)
SLOT_WORDS = re.compile(
    r"\b(?:insert|your text|text here|goes here|item name|translate me|tbd|todo|placeholder|untranslated)\b|chèn .* tại đây|điền nội dung|nhập (?:ngày|tên|nội dung)|mô tả ở đây|tên vật phẩm|cần dịch|chưa dịch"
    r"|待填写|待翻译|待补|请输入|此处插入|占位|物品名称|未翻译|isi nama|masukkan|teks anda|nama barang|belum diterjemahkan|di sini",
    re.I,
)
# Spans that are trusted to be slots.
TRUSTED_SPANS = (
    "{{item_name}}", "${player}", "<%= date %>", "[[guild]]", "%%PRICE%%", "__SERVER__", "#REWARD#", "TODO", "TBD", "XXXX", "____", "{item_name}", "{user.nick}", "@@boss@@", "<<npc_name>>", "{{ very_long_name_of_a_slot }}",
    "<insert name here>", "[insert text]", "<your text>", "[your text here]", "[text goes here]", "<item name>", "[translate me]", "(placeholder)", "[untranslated]", "[chèn tên tại đây]", "[điền nội dung]", "<nhập tên>", "[mô tả ở đây]", "<tên vật phẩm>",
    "[cần dịch]", "[chưa dịch]", "【待填写】", "【待翻译】", "【待补】", "【请输入】", "【此处插入】", "【占位】", "<物品名称>", "【未翻译】", "[isi nama di sini]", "<masukkan nama>", "[teks anda]", "<nama barang>", "[belum diterjemahkan]",
)
SPANS = re.compile(
    r"\{\{[^{}]+\}\}|\$\{[^{}]+\}|\{[^{}]+\}|<%[^<>]+%>|<<[^<>]+>>|<[^<>{}\n]+>|\[\[[^\[\]]+\]\]|\[[^\[\]\n]+\]"
    r"|【[^【】\n]+】|《[^《》\n]+》|\([^()\n]+\)|（[^（）\n]+）|%%[A-Za-z][A-Za-z_.]{2,}%%|__[A-Za-z][A-Za-z_.]+__|#[A-Z][A-Z_.]{2,}#"
    r"|STR_[A-Z_]+_?\d*|(?<![A-Z])(?:TODO|TBD|FIXME)(?![A-Z])|(?<![A-Za-z])(?:X{4,}|x{3,}(?:_x{3,})+)(?![A-Za-z])|@@[A-Za-z][A-Za-z_. ]+@@|_{4,}"
)
#: Anything that SPANS can begin with: texts without it need no search.
SPAN_HINT = re.compile(r"[{<\[【《(（]|%%|__|@@|#[A-Z]|STR_|TODO|TBD|FIXME|XXXX|xxx_")
TOKEN = re.compile(r"[㐀-鿿]+|[^\W\d_]+|\d+")
HEXID = re.compile(r"(?<![0-9A-Za-z])(?=[0-9a-f]*\d)(?=[0-9a-f]*[a-f]|\d{9})[0-9a-f]{8,9}(?![0-9A-Za-z])")
PATH = re.compile(r"(?<!\w)/\w+/\w+")
SENTENCE = re.compile(r"[^\n.!?。！？]+[.!?。！？]*(?:\s+|$)?|[\n.!?。！？]+")


def tokens(passage: str) -> list[str]:
    """Words in lower case, pairs of CJK letters, and classes of numbers, hexadecimal ids and paths."""
    out = []
    text = passage.lower()
    if "/" in text:
        text = PATH.sub(" pathid ", text)
    for w in TOKEN.findall(HEXID.sub(" hexid ", text)):
        if "㐀" <= w[0] <= "鿿":
            out += [w[i : i + 2] for i in range(len(w) - 1)] or [w]
        elif w[0].isdigit():
            out.append("0" if len(w) != 3 or w[0] not in "45" else "4xx")
        else:
            out.append(w)
    return out


def span_tokens(span: str) -> list[str]:
    """The signs that open and close a span, the shape of what it holds, its words."""
    m = re.match(r"^(\W*|__|_+)(.*?)(\W*|_+)$", span, re.S)
    left, inner, right = (m[1], m[2], m[3]) if m else ("", span, "")
    out = ["<" + left.strip()[:3], ">" + right.strip()[-3:]]
    out.append("s:" + ("snake" if re.fullmatch(r"[a-z]+(?:[_.][a-z]+)+", inner) else "upper" if re.fullmatch(r"[A-Z]+(?:_[A-Z]+)+", inner) else "word" if re.fullmatch(r"[a-z]+", inner) else "number" if re.fullmatch(r"[\d\W]+", inner) else "text"))
    out += ["c:" + ch for ch in sorted(set(inner) & set('@":=;,%|/'))]
    words = tokens(inner.replace("_", " "))
    # Brackets around a whole record or sentence: its words are content and would drown those of slots.
    return out + (["w:" + w for w in words] if len(words) <= WORDS else ["s:long"])


def fit(trusted: Iterable[list[str]], unlabelled: Iterable[list[str]]) -> tuple[dict[str, float], float]:
    """Positive-unlabelled naive Bayes by EM: log-odds per token and the prior's log-odds.

    Unlabelled passages start as content; each round re-reads their posteriors as weights.
    """
    pos, un = [Counter(t) for t in trusted if t], Counter(tuple(sorted(t)) for t in unlabelled if t)
    kinds = [(Counter(k), n) for k, n in un.items()]
    weight = [0.0] * len(kinds)
    every: Counter = Counter()
    for c in pos:
        every.update(c)
    for c, n in kinds:
        for w, k in c.items():
            every[w] += n * k
    total = sum(every.values()) or 1
    words: dict[str, float] = {}
    prior = 0.0
    for _ in range(MOST_ROUNDS):
        one, zero, n1, n0 = Counter(), Counter(), 1.0, 1.0
        for c in pos:
            n1 += TRUST
            for w, k in c.items():
                one[w] += TRUST * k
        for (c, n), p in zip(kinds, weight, strict=True):
            n1, n0 = n1 + n * p, n0 + n * (1 - p)
            for w, k in c.items():
                if p > 1e-4:
                    one[w] += n * p * k
                zero[w] += n * (1 - p) * k
        t1, t0 = sum(one.values()), sum(zero.values())
        words = {w: math.log((one[w] + PRIOR * n / total) / (t1 + PRIOR)) - math.log((zero[w] + PRIOR * n / total) / (t0 + PRIOR)) for w, n in every.items()}
        words[""] = UNKNOWN
        prior = math.log(n1 / n0)
        before, weight = weight, []
        for c, _ in kinds:
            s = prior + sum(words[w] * k for w, k in c.items())
            weight.append(1 / (1 + math.exp(-max(-30.0, min(30.0, s)))))
        if max((abs(a - b) for a, b in zip(before, weight, strict=True)), default=0.0) < CONVERGED:
            break
    return words, prior


class Model:
    """Both fitted models and the decision about a record."""

    def __init__(self, texts: list[str], protected: list[str]) -> None:
        self.protected = re.compile("|".join(f"(?:{p})" for p in protected)) if protected else None
        pos, un, slot, span = [tokens(t) for t in TRUSTED], [], [], []
        known = {tuple(p) for p in pos}
        for text in texts:
            clean = self.clean(text)
            for s in self.spans(text):
                (slot if SLOT_FORM.match(s) or SLOT_WORDS.search(s) else span).append(span_tokens(s))
            for s in sentences(clean):
                t = tokens(s)
                (pos if tuple(t) in known or FILLER.search(s) else un).append(t)
            if FILLER.search(clean) and len(clean) < 400:
                pos.append(tokens(clean))
        slot += [span_tokens(s) for s in TRUSTED_SPANS]
        self.sentence, self.span = fit(pos, un), fit(slot, span)

    def clean(self, text: str) -> str:
        return self.protected.sub(" ", text) if self.protected else text

    def spans(self, text: str) -> list[str]:
        """Bracketed spans and markers of a text as stored, without those that are or only hold runtime tokens."""
        if not SPAN_HINT.search(text):
            return []
        found = SPANS.findall(text)
        for s in found:  # a slot may stand inside other brackets, also in the ruins of another slot
            if not SLOT_FORM.match(s) and SPAN_HINT.search(s[1:-1]):
                found.extend(SPANS.findall(s[1:-1]))
        return [s for s in found if SLOT_FORM.match(s) or any(map(str.isalnum, self.clean(s)))] if found else found

    @staticmethod
    def odds(fitted: tuple[dict[str, float], float], toks: list[str]) -> float:
        words, prior = fitted
        unknown = words.get("", 0.0)
        return prior + sum(words.get(w, unknown) for w in toks)

    def slot(self, text: str) -> bool:
        return any(self.odds(self.span, span_tokens(s)) > MARGIN for s in self.spans(text))

    def whole(self, clean: str) -> bool:
        """Whether residue holds more than SHARE of the letters; stops as soon as content holds the rest."""
        size = sum(map(str.isalnum, clean))
        bad = good = 0
        for s in sentences(clean):
            n = sum(map(str.isalnum, s))
            if self.odds(self.sentence, tokens(s)) > MARGIN:
                bad += n
            else:
                good += n
                if good >= (1 - SHARE) * size:
                    return False
        return bad > SHARE * size

    def decide(self, text: str | None, source: str | None = None) -> str | None:
        """``slot``, ``page`` or null."""
        if not text or not text.strip():
            return None
        clean = self.clean(text)
        if self.slot(text):
            if source and sorted(self.spans(source)) == sorted(self.spans(text)):
                return None
            return "slot"
        # An incident's id or filler in the target alone can't come from the source.
        own = any(bool(p.search(clean)) and not p.search(source or "") for p in (HEXID, FILLER))
        if self.whole(clean) and (own or not (source and source.strip() and self.alike(self.clean(source)))):
            return "page"
        return None

    def alike(self, clean: str) -> bool:
        """Whether a source speaks of the same things: its words for residue weigh a fair part of all, whatever names it holds."""
        words = self.sentence[0]
        weights = [words.get(w, 0.0) for w in set(tokens(clean))]
        up, down = sum(w for w in weights if w > 0), -sum(w for w in weights if w < 0)
        return self.whole(clean) or (up > ALIKE and up > ALIKE_SHARE * (up + down))


def sentences(text: str) -> Iterator[str]:
    for m in SENTENCE.finditer(text):
        s = m[0]
        if any(map(str.isalnum, s)):
            yield s


def sample(df: DataFrame, key: str, n: int) -> DataFrame:
    """About ``n`` rows (never many more) chosen by a hash of their key."""
    every = max(1, math.ceil(df.count() / n))
    return df.where(F.pmod(F.xxhash64(key), F.lit(every)) == 0).limit(2 * n)


def model(spark: SparkSession, sf_dir: str) -> Model:
    docs, memory = table(spark, sf_dir, "documents"), table(spark, sf_dir, "translation_memory")
    picked = sample(docs.select("doc_id", "text"), "doc_id", SAMPLE_RECORDS).select("text").unionByName(sample(memory.select("tm_id", "target_text"), "tm_id", SAMPLE_RECORDS).select(F.col("target_text").alias("text")))
    texts = sorted(r.text for r in picked.where("text is not null").collect())
    return Model(texts, protected_patterns(spark, sf_dir))


def protected_patterns(spark: SparkSession, sf_dir: str) -> list[str]:
    """The patterns of runtime tokens, without regard to case, as copies of a record may be written in capitals."""
    rows = table(spark, sf_dir, "protected_patterns").where("pattern is not null").orderBy("priority", "name").collect()
    return [f"(?i:{r.pattern})" for r in rows]


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(tbl, rec_key, text, residue) of every record; residue is null for content."""
    fitted = spark.sparkContext.broadcast(model(spark, sf_dir))
    docs, memory = table(spark, sf_dir, "documents"), table(spark, sf_dir, "translation_memory")
    rows = spread(docs.select(F.lit("documents").alias("tbl"), F.col("doc_id").cast("string").alias("rec_key"), "text", F.lit(None).cast("string").alias("source"))).unionByName(
        spread(memory.select(F.lit("translation_memory").alias("tbl"), F.col("tm_id").cast("string").alias("rec_key"), F.col("target_text").alias("text"), F.col("source_text").alias("source")))
    )

    def score(tbl: list, rec_key: list, text: list, source: list) -> dict[str, list]:
        decide = fitted.value.decide
        return {"tbl": tbl, "rec_key": rec_key, "text": text, "residue": [decide(t, s) for t, s in zip(text, source, strict=True)]}

    return map_columns(rows, score, "tbl string, rec_key string, text string, residue string")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decisions(spark, sf_dir).where("residue is not null and rec_key is not null").select("tbl", "rec_key").distinct()


def p2_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The records that are free of residue."""
    return decisions(spark, sf_dir).where("residue is null and rec_key is not null").select("tbl", "rec_key", "text")


QUERIES = {"p2_found": p2_found, "p2_clean": p2_clean}
