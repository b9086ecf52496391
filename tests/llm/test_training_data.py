"""The training-data operators: brute force, exact round trips, held-out accuracy, and odd input (nulls, empty tables, long texts, clashing columns)."""

from __future__ import annotations

import difflib
import random
import re
import time
import unicodedata as ud
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest

from lexiloom.functions import codecs
from lexiloom.llm import format_copies, languages, leaks, lookalikes, mojibake, packing, pair_defects, personal, queries, residue
from lexiloom.llm.boosting import Boosted

DATA = "/root/testdata/sf0.01"
needs_data = pytest.mark.skipif(not Path(DATA).is_dir(), reason="no test tables here")
SCHEMAS = {
    "documents": "doc_id long, text string, lang string, source string, n_chars long, category string, updated_at timestamp, salt int, cells string, key string, cell string",
    "translation_memory": "tm_id long, source_key string, source_text string, target_text string, source_lang string, target_lang string, quality string, usage_count long, created_at timestamp, updated_at timestamp, text string, id string",
    "text_records": "id string, language string, original string, text string, value string, lang string",
    "glossary": "gloss_id long, source string, target string, mode string, note string, pak string, uses long, key string, form string",
    "eval_items": "item_id long, text string, lang string, suite string, doc_id long",
    "pack_limits": "limit_name string, capacity_tokens int",
    "protected_patterns": "name string, pattern string, priority int",
}
LONG = "Trong hang có 43 sói xám canh giữ hài cốt của Ngưu Báo và Hồng Lôi. " * 3000


def make(spark, folder, **tables):
    """Small tables in a folder: rows are dicts, missing columns null, absent tables empty."""
    for name, schema in SCHEMAS.items():
        fields = [f.split()[0] for f in schema.split(", ")]
        rows = [tuple(r.get(f) for f in fields) for r in tables.get(name, ())]
        spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
    return str(folder)


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_empty_tables(spark, tmp_path, name):
    assert queries.QUERIES[name](spark, make(spark, tmp_path)).count() == 0


def odd_tables(spark, folder):
    docs = [{"doc_id": 1}, {"doc_id": 2, "text": ""}, {"doc_id": 3, "text": " \n\t"}, {"text": "no id"}, {"doc_id": 4, "text": LONG, "salt": 1, "cells": "x", "key": "k"}, {"doc_id": 4, "text": LONG}, {"doc_id": 5, "text": "x" * 200_000}, {"doc_id": 6, "text": "[[[[((({{{{" * 500}, {"doc_id": 7, "text": "1 " * 20_000}]
    tm = [{"tm_id": 1}, {"tm_id": 2, "source_text": "", "target_text": ""}, {"tm_id": 3, "source_text": LONG, "target_text": LONG, "target_lang": "zh-CN"}, {"source_text": "a", "target_text": "b"}, {"tm_id": 4, "source_text": "Ngựa chạy", "target_text": None, "target_lang": None}, {"tm_id": 3, "source_text": LONG, "target_text": LONG, "target_lang": "zh-CN"}]
    recs = [{"id": "a"}, {"id": "b", "original": ""}, {"id": "c", "original": LONG, "language": None}, {"original": "Ngựa của ta chạy nhanh"}, {"id": "c", "original": LONG}]
    gl = [{"gloss_id": 1}, {"gloss_id": 2, "source": ""}, {"source": "x"}, {"gloss_id": 3, "source": LONG}]
    ev = [{"item_id": 1}, {"item_id": 2, "text": ""}, {"item_id": 3, "text": "short"}, {"text": "x " * 50}, {"item_id": 4, "text": LONG[:800]}, {"item_id": 4, "text": LONG[:800]}]
    lim = [{"limit_name": "a", "capacity_tokens": 100}, {"limit_name": "z", "capacity_tokens": 0}, {"limit_name": "n"}, {"capacity_tokens": 5}, {"limit_name": "a", "capacity_tokens": 100}]
    pat = [{"name": "tag", "pattern": "</?[a-z]+(=[#a-z0-9]+)?>", "priority": 10}, {"name": "null"}]
    return make(spark, folder, documents=docs, translation_memory=tm, text_records=recs, glossary=gl, eval_items=ev, pack_limits=lim, protected_patterns=pat)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_odd_input(spark, tmp_path, name):
    got = queries.QUERIES[name](spark, odd_tables(spark, tmp_path)).collect()
    if name.endswith("_found"):
        assert len(set(got)) == len(got)
        assert all(v is not None for r in got for v in r)


# Problem 1.


def test_copies_equal_brute_force(spark, tmp_path):
    rnd = random.Random(5)
    base = ["Ngựa của Hổ Lang chạy nhanh gấp 3 lần!", "我是百暗，松信村的守门人。", "Tên: Đao Lam; Giá bán: 5; Độ bền: 70; Nội lực: 9", '{"Name": "Wan Bow", "Price": 5, "Attack": 50}', "A: câu một.\nB: câu hai.", "B: câu hai.\nA: câu một.", "Tên: Đao Lam; Giá bán: 70; Độ bền: 5; Nội lực: 9"]

    def noise(t):
        t = rnd.choice([str.upper, str.lower, lambda s: s, lambda s: s.replace(" ", "  "), lambda s: s.replace(".", "…").replace("。", "！"), lambda s: f"- {s}\n"])(t)
        if t.count(":") >= 3 and rnd.random() < 0.5 and "{" not in t:
            parts = [p.strip() for p in re.split(r"[;\n]", t.strip("- \n")) if p.strip()]
            rnd.shuffle(parts)
            t = rnd.choice(["; ", " | ", "\n"]).join(parts)
        return t

    truth = [(i, b) for i in range(120) for b in [rnd.randrange(len(base))]]
    d = make(spark, tmp_path, documents=[{"doc_id": i, "text": noise(base[b])} for i, b in truth], translation_memory=[{"tm_id": i, "source_text": base[0]} for i in (5, 9)])
    want, first = set(), {}
    for i, b in truth:
        first.setdefault(b, i)
        if first[b] != i:
            want.add(("documents", first[b], i))
    want.add(("translation_memory", 5, 9))
    assert set(rows(format_copies.p1_found(spark, d), "tbl", "first_id", "copy_id")) == want
    sizes = Counter(b for _, b in truth)
    assert sorted(n for t, _, n in rows(format_copies.p1_collapsed(spark, d), "tbl", "first_id", "n_copies") if t == "documents") == sorted(sizes.values())


def test_named_fields_of_any_number(spark, tmp_path):
    two = ["Name: Wan Bow; Price: 5", "Price: 5 | name: Wan Bow"]
    long = ["Tên: Đao Lam; Mô tả: do một thợ già rèn suốt mười hai năm; Giá: 5; Nội lực: 9", "Giá: 5\nNội lực: 9\nMô tả: do một thợ già rèn suốt mười hai năm\nTên: Đao Lam"]
    swapped = ["Tên: Đao; Giá: 5; Độ bền: 70", "Tên: Đao; Giá: 70; Độ bền: 5"]
    talk = ["An: hôm nay ta đi qua núi này để tìm Bình, rồi về.\nBình: ta đã chờ ngươi ở đây suốt mười năm trời.", "Bình: ta đã chờ ngươi ở đây suốt mười năm trời.\nAn: hôm nay ta đi qua núi này để tìm Bình, rồi về."]
    prose = ["Theo lệnh môn phái, ta là U Phật, người giữ cửa của Đài, ngươi từ đâu tới đây", "- Theo lệnh môn phái- ta là U Phật;\nngười giữ cửa của Đài- ngươi từ đâu tới đây"]
    docs = [{"doc_id": i, "text": t} for i, t in enumerate(two + long + swapped + talk + prose)]
    assert rows(format_copies.p1_found(spark, make(spark, tmp_path, documents=docs)), "first_id", "copy_id") == [(0, 1), (2, 3), (8, 9)]


# Problem 2.


@pytest.fixture(scope="module")
def residue_model():
    content = ["Trong hang có 43 sói xám canh giữ hài cốt.", "The horse of An Wan runs 3 times faster.", "闭关之前，松仁的马快3倍。", "[Nhiệm vụ] 870569", "Thông báo lỗi 403 từng hiện khi vào cửa hàng nay không còn nữa.", "(BOSS Di Bai)"]
    return residue.Model(content * 30, [r"</?[a-z]+(=[#a-z0-9]+)?>", r"%[0-9.]*[sdf%]", r"\{[0-9]+\}"])


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("404 Not Found\nThe page /a/b you asked for is gone.\n12ab34cd9", "page"), ("请启用 JavaScript 后再浏览本页面（12dcbe415）", "page"), ("Máy chủ không phản hồi sau 15 giây, tham chiếu 95f9d566c", "page"), ("asdf qwer asdf qwer asdf qwer asdf qwer", "page"),
        ("Lorem ipsum dolor sit amet ipsum", "page"), ("Dùng {{item_name}} để mở", "slot"), ("Nhận %%DATE%% ngay", "slot"), ("đến [điền nội dung] trước", "slot"), ("永TBD片", "slot"), ("@@boss_name@@", "slot"), ("<color=#ffcc00>Ngựa {0} chạy %s</color>", None),
        ("Trong hang có 43 sói xám. Thông báo lỗi 403 từng hiện khi vào cửa hàng nay không còn nữa. Ngựa chạy nhanh.", None), ("[Nhiệm vụ] 870569\nTrong hang có sói.", None), ("", None), (None, None), ("   ", None),
    ],
)
def test_residue(residue_model, text, want):
    assert residue_model.decide(text) == want


def test_residue_of_a_source_that_says_the_same(residue_model):
    assert residue_model.decide("Máy chủ đang bận, vui lòng thử lại sau", "服务器繁忙，请稍后重试") is None
    assert residue_model.decide("Máy chủ đang bận, vui lòng thử lại sau", "闭关之前，松仁的马快3倍。") == "page"


@pytest.mark.parametrize("text", ["Mở {{ " + "x" * 90 + " }} ngay", "Dùng ${phần thưởng} để mở", "@@quest_giver@@", "đến [chèn số tại đây]", "<your name>"])
def test_slots_by_the_model(residue_model, text):
    assert residue_model.decide(text) == "slot"


@pytest.mark.parametrize("text", ["[Nhiệm vụ] mở cổng", "(" + "Trong hang có sói. " * 20 + ")", "《三国》"])
def test_meant_brackets(residue_model, text):
    assert residue_model.decide(text * 2) is None


# Problem 3.


def test_lookalikes_equal_brute_force(spark, tmp_path):
    rnd = random.Random(3)
    base = ["Mộng Ngọc Thánh Kiếm", "Đao Cúc Liên Hoàng", "仙黑梦灵盔", "Trường Tấn 57%"]
    cyr = dict(zip("aeocpHTKM", "аеосрНТКМ", strict=True))

    def disguise(s):
        kind = rnd.randrange(6)
        if kind == 0:
            return ud.normalize("NFD", s)
        if kind == 1:
            return "".join(cyr.get(c, c) if rnd.random() < 0.7 else c for c in s)
        if kind == 2:
            return "".join(chr(ord(c) + 0xFEE0) if c.isascii() and c.isalnum() and rnd.random() < 0.5 else c for c in s)
        if kind == 3:
            return "".join(c + rnd.choice(["", "\u200b", "\u00ad", "\ufeff"]) for c in s)
        if kind == 4:
            return s.replace(" ", rnd.choice(["\u00a0", "\u2007", "\u202f"]))
        return s

    gl = [(i, b, disguise(base[b])) for i in range(12) for b in [rnd.randrange(4)]]
    gl = list({s: (i, b, s) for i, b, s in gl}.values()) + [(90, 8, "Mộng Ngóc Thánh Kiếm"), (91, 9, "mộng Ngọc Thánh Kiếm")]
    tm = [(i, b, disguise(base[b])) for i in range(40) for b in [rnd.randrange(4)]]
    d = make(spark, tmp_path, glossary=[{"gloss_id": i, "source": s} for i, _, s in gl], translation_memory=[{"tm_id": i, "source_text": s} for i, _, s in tm])
    every = [(f"g:{i}", b, s) for i, b, s in gl] + [(f"t:{i}", b, s) for i, b, s in tm]
    want = {tuple(sorted((x[0], y[0]))) for x in every for y in every if x[0] < y[0] and x[1] == y[1] and x[2] != y[2] and "g" in x[0][0] + y[0][0]}
    assert set(rows(lookalikes.p3_found(spark, d), "key_a", "key_b")) == want


def test_lookalike_classes_are_transitive():
    composed, apart, reordered = "\u1ed9", "o\u0323\u0302", "o\u0302\u0323"
    classes = lookalikes.classes({"A": 9, "o": 9, "\u0410": 1, "\uff21": 1, composed: 5, "\u043e": 2, "\u0302": 1, "\u0323": 1, "\u2007": 1, " ": 8, "\u200b": 1})
    assert classes["\u0410"] == classes["\uff21"] == "A" and classes[apart] == classes[reordered] == composed and classes["\u2007"] == " " and classes["\u200b"] == ""
    f = lookalikes.Rewriter(classes)
    assert f("\u043e\u0323\u0302 \u0410\u200b") == composed + " A" and f(None) is None and f("plain") == "plain"


def test_rewriting_reaches_a_fixed_point():
    f = lookalikes.Rewriter(lookalikes.classes({"\u0323": 4, "\u0302": 4, "\u0301": 4, "o": 9, "\u200b": 3, "\u043e": 2, "\u00f4": 5}))
    apart = "o\u200b\u0302\u200b\u0323\u200b x"
    assert f(apart) == "\u1ed9 x" and f(f(apart)) == f(apart) and f("\u043e\u0302") == "\u00f4"


# Problem 4.


@pytest.fixture(scope="module")
def judge():
    pairs = [(f"Ngựa của Hổ Lang {w} chạy nhanh gấp {i} lần ngựa trạm Báo Tùng.", f"虎狼的马比豹松驿站的马快{i}倍。", "zh-CN") for i, w in enumerate(["x"] * 20)]
    return pair_defects.Judge(pairs, [r"\{[0-9]+\}"])


SOURCE = "Ngựa của Hổ Lang chạy nhanh gấp 3 lần ngựa trạm Báo Tùng. Ngựa của Mai Vân chạy nhanh gấp 5 lần ngựa trạm Cúc Mai."


@pytest.mark.parametrize(
    ("target", "lang", "want"),
    [
        (None, "zh-CN", "empty"), (" \n", "zh-CN", "empty"), ("[]…", "zh-CN", "empty"), ("对不起，我无法翻译这段内容。", "zh-CN", "refusal"), ("As a language model, I can't translate this text.", "zh-CN", "refusal"), ("Xin lỗi, tôi không thể dịch đoạn này.", "zh-CN", "refusal"),
        (SOURCE.upper(), "zh-CN", "copy"), (f"{SOURCE}\n{SOURCE}", "zh-CN", "copy"), ("The horse of Hu Lang runs 3 times faster than those of the post. It is fast.", "zh-CN", "language"), ("虎狼的马比豹松驿站的马快3倍。梅", "zh-CN", "truncated"),
        ("虎狼的马比豹松驿站的马快3倍。梅云的马比菊梅驿站的马快5倍。", "zh-CN", None), ("虎狼的马比豹松驿站的马快3倍。梅云的马比菊梅驿站的马快5倍。", None, None),
    ],
)
def test_defects(judge, target, lang, want):
    assert judge(SOURCE, target, lang) == want


def test_defects_of_codes_and_characters(judge):
    assert judge("{0} 00000094-27", "{0} 00000094-27", "zh-CN") is None
    assert judge("Xin lỗi, ta không thể dịch đoạn văn này cho ngươi", "抱歉，我无法翻译这段文字给你", "zh-CN") != "refusal"
    assert judge(None, "虎", "zh-CN") is None


def test_parser_and_tiling():
    assert pair_defects.parse('<b>a. (b "c') == {"units": 2, "open": 3, "ended": 0}
    assert pair_defects.parse("a。b；c") == {"units": 3, "open": 0, "ended": 0}
    a, b = list("abcdefg"), list("xxabcyydefgzz")
    assert pair_defects.tiling(a, b, 3) == 7 and pair_defects.tiling(a, list("aabb"), 3) == 0


def test_tiling_equals_brute_force():
    def brute(a, b, least):
        used_a, used_b, covered = [False] * len(a), [False] * len(b), 0
        while True:
            best, tiles = 0, []
            for i in range(len(a)):
                for j in range(len(b)):
                    k = 0
                    while i + k < len(a) and j + k < len(b) and a[i + k] == b[j + k] and not used_a[i + k] and not used_b[j + k]:
                        k += 1
                    if k >= best:
                        best, tiles = k, [*(tiles if k == best else []), (i, j)]
            if best < least:
                return covered
            for i, j in tiles:
                if not any(used_a[i : i + best]) and not any(used_b[j : j + best]):
                    used_a[i : i + best] = used_b[j : j + best] = [True] * best
                    covered += best

    rnd = random.Random(1)
    same = 0
    for _ in range(150):
        a, b = (rnd.choices("abcdefghijkl"[: rnd.choice([3, 12])], k=rnd.randrange(30)) for _ in range(2))
        got, want = pair_defects.tiling(a, b, 2), brute(a, b, 2)
        assert abs(got - want) <= 4  # tiles of one length may be laid in another order
        same += got == want
    assert same >= 140


def test_tiling_of_a_chant_is_quick():
    start = time.time()
    assert pair_defects.tiling(["ha"] * 20_000, ["ha"] * 19_990) == 19_990
    assert pair_defects.tiling(["ha", "ho"] * 10_000, ["ha", "ho", "hi"] * 7000) >= 14_000
    assert time.time() - start < 5


def test_altered_copies(judge):
    changed = SOURCE.replace("nhanh gấp 5", "chậm 5")
    assert judge(SOURCE, changed, "zh-CN") == "copy" and judge(SOURCE, SOURCE[:60], "vi") != "copy"


def test_cut_answers_show_it(judge):
    whole = "虎狼的马比豹松驿站的马快3倍。梅云的马比菊梅驿站的马快5倍。"
    assert judge.truncated(SOURCE, whole, "zh-CN") is None
    assert judge.truncated(SOURCE, whole[:22], "zh-CN") == "parser" and judge.truncated(SOURCE, "虎狼的马（", "zh-CN") == "parser"
    assert judge.truncated(SOURCE + " (± 5%)", whole, "zh-CN") is None
    assert judge.truncated("Ngựa của Hổ Lang chạy rất nhanh trên đường núi xa xôi", "虎狼", "zh-CN") == "length"


# Problem 5.

CLEAN = ["Nghe tiếng chuông thứ ba, kẻ phản bội đã mở cổng Đài Hải Vũ cho hồ ly, phần thưởng sẽ gửi qua thư.", "从去年秋天起，叛徒勇勇为山贼打开了江白谷的大门，奖励将通过邮件发放。", "Để chuộc lại lỗi lầm, mỗi ngày Thủy Thiên chỉ bán 88 Dây chuyền tại chợ Lâm Tử Lam."]


@pytest.fixture(scope="module")
def repairer():
    counts = Counter(c for t in CLEAN for c in t * 2000)
    words = {w for t in CLEAN for w in re.findall(r"\w+", t.lower()) if not w.isascii()}
    return mojibake.Repairer(counts, words)


@pytest.mark.parametrize(("read_as", "i"), [("cp1252x", 0), ("latin-1", 0), ("mac_roman", 0), ("cp437", 0), ("cp850", 0), ("latin-1", 1), ("mac_roman", 1), ("gb18030", 2)])
def test_utf8_round_trips(repairer, read_as, i):
    raw = CLEAN[i].encode()
    garbled = "".join(bytes([b]).decode("cp1252", "replace") if bytes([b]).decode("cp1252", "replace") != "�" else chr(b) for b in raw) if read_as == "cp1252x" else raw.decode(read_as, "replace")
    found, restored = repairer(garbled)
    assert found
    if "�" not in garbled and read_as != "gb18030":
        assert restored == CLEAN[i]


def test_other_round_trips(repairer):
    assert repairer(CLEAN[1].encode("gbk").decode("latin-1")) == (True, CLEAN[1])
    twice = CLEAN[0].encode().decode("latin-1").encode().decode("latin-1")
    assert repairer(twice) == (True, CLEAN[0])
    back = {c: chr(b) for b, c in codecs.TCVN3.items()}
    tcvn = "".join(back.get(c, c) for c in CLEAN[2])
    assert repairer(tcvn)[0] and difflib.SequenceMatcher(None, repairer(tcvn)[1], CLEAN[2]).ratio() > 0.95
    half = CLEAN[0][:40] + CLEAN[0][40:].encode().decode("latin-1")
    assert repairer(half) == (True, CLEAN[0])


def test_capitals_with_tones_in_tcvn3(repairer):
    text = "Từ năm ngoái, ỨNG DỤNG Ồ Ế ấn Ằ: từng người chơi nhận thưởng. " + CLEAN[2]
    back = {c: chr(b) for b, c in codecs.TCVN3.items() if b > 0xA0}
    garbled = "".join(back.get(c, c) for c in text)
    repair = mojibake.Repairer(Counter(c for t in [*CLEAN, text] for c in t * 2000), repairer.words | {w for w in re.findall(r"\w+", text.lower()) if not w.isascii()})
    found, restored = repair(garbled)
    assert found and "Ồ Ế" not in garbled and difflib.SequenceMatcher(None, restored, text).ratio() > 0.9


def test_four_layers(repairer):
    garbled = CLEAN[0]
    for _ in range(4):
        garbled = garbled.encode().decode("latin-1")
    assert repairer(garbled) == (True, CLEAN[0])


def test_long_stretch_read_as_gbk(repairer):
    text = "".join(c for c in CLEAN[1] if "\u4e00" <= c <= "\u9fff") * 3
    text = text[: len(text) - len(text) % 2]
    assert repairer(text.encode().decode("gb18030", "replace"))[0]


@pytest.mark.parametrize("text", [*CLEAN, "Ngựa chạy nhanh. «Crème»", "xong “Señor Ñandú”", "(±5%) ½ §3 • µ ¥120 ©", "Số (Ø 3 ÷ 5)", "", None, "a​b", "服务器繁忙，请稍后重试"])
def test_meant_signs_are_no_garbling(repairer, text):
    assert repairer(text) == (False, text)


# Problem 6.


@needs_data
def test_languages_on_held_out_texts(spark):
    label = languages.labeller(spark, DATA)
    docs = spark.read.parquet(f"{DATA}/eval_items.parquet").select("text", "lang").collect()
    assert sum(label(r["text"])[0] == r["lang"] for r in docs) >= 0.99 * len(docs)
    vi = [r["text"] for r in docs if r["lang"] == "vi"]
    assert sum(label(languages.plain(t))[0] == "vi" for t in vi) >= 0.97 * len(vi)
    mixed = f"{vi[0]} / {next(r['text'] for r in docs if r['lang'] == 'zh')}\n{next(r['text'] for r in docs if r['lang'] == 'en')}"
    assert label(mixed)[0] == "mixed" and [x for x, *_ in label(mixed)[2]] == ["vi", "zh", "en"]
    assert label("Ngựa của Hổ Lang chạy nhanh lắm (新松) “Señor Ñandú”.")[0] == "vi"
    assert label("%d {0}")[0] is None and label(None)[0] is None


@needs_data
def test_short_sentences_are_stretches_and_names_are_not(spark):
    label = languages.labeller(spark, DATA)
    vi = "Ngựa của Hổ Lang chạy nhanh gấp ba lần ngựa trạm Báo Tùng."
    assert label(f"{vi} 峄山")[0] == "vi" and [x for x, *_ in label(f"{vi} 快来吧！")[2]] == ["vi", "zh"]


@needs_data
def test_every_record_gets_a_row(spark):
    labels = languages.p6_labels(spark, DATA)
    assert labels.select("id").distinct().count() == spark.read.parquet(f"{DATA}/text_records.parquet").where("id is not null").select("id").distinct().count()


def test_code_separates_languages():
    code = languages.code(4)
    assert len(code[0]) == 7 and all(sum(a != b for a, b in zip(code[i], code[j], strict=True)) >= 4 for i in range(4) for j in range(i))


# Problem 7.


def test_best_fit_packs_whole_texts():
    rnd = random.Random(2)
    bins = packing.BestFit(100, 8)
    used, parts = Counter(), defaultdict(int)
    sizes = [rnd.choice([3, 20, 45, 60, 99, 100, 101, 250, 400]) for _ in range(2000)]
    for n, size in enumerate(sizes):
        got = list(bins.add_text(size))
        assert sum(p[2] for p in got) == size and (size > 100 or len(got) == 1) and [p[1] for p in got] == [sum(q[2] for q in got[:i]) for i in range(len(got))]
        for _, _, tokens, which, place in got:
            assert place == used[which]
            used[which] += tokens
            parts[n] += 1
    assert max(used.values()) <= 100 and bins.count <= 8
    assert sum(used.values()) / (100 * len(used)) > 0.9


def test_packed_tables(spark, tmp_path):
    docs = [{"doc_id": i, "text": f"word {i} " * (i % 40 + 1)} for i in range(300)] + [{"doc_id": 999, "text": LONG[:20000]}]
    d = make(spark, tmp_path, documents=docs, pack_limits=[{"limit_name": "s", "capacity_tokens": 64}, {"limit_name": "l", "capacity_tokens": 512}])
    p = packing.p7_packed(spark, d).toPandas()
    assert (p.groupby(["limit_name", "shard", "bin_no"]).n_tokens.sum().reset_index().merge(p[["limit_name", "capacity_tokens"]].drop_duplicates()).eval("n_tokens <= capacity_tokens")).all()
    total = p.groupby("limit_name").n_tokens.sum()
    assert total["s"] == total["l"] and set(p[p.part_no > 0].doc_id) <= set(p[p.first_token > 0].doc_id)


# Problem 8.


def test_suffix_array_is_sorted():
    rnd = np.random.default_rng(1)
    t = rnd.integers(0, 4, 300)
    order = leaks.suffix_array(t)
    s = [tuple(t[i:].tolist()) for i in order]
    assert s == sorted(s) and leaks.suffix_array(np.array([], np.int64)).size == 0


def test_leaks_equal_brute_force(spark, tmp_path):
    rnd = random.Random(9)
    words = [f"{a}{b}" for a in "bcdfghklmn" for b in ("an", "o", "u", "i", "e")]
    items = [" ".join(rnd.choices(words, k=60)) for _ in range(6)]
    docs, want = [], set()
    for i in range(60):
        body = rnd.choices(words, k=150)
        if i % 2:
            n, item = rnd.randrange(6), None
            item = items[n].split()
            size = rnd.choice([10, 30, 60])
            at = rnd.randrange(60 - size + 1)
            part = item[at : at + size]
            for k in rnd.sample(range(len(part)), size // 20):
                part[k] = "changed"
            body[40:40] = [w.upper() + "," for w in part]
            if size >= 30:
                want.add((i, n))
        docs.append({"doc_id": i, "text": " ".join(body)})
    d = make(spark, tmp_path, documents=docs, eval_items=[{"item_id": n, "text": t} for n, t in enumerate(items)])
    assert set(rows(leaks.p8_found(spark, d), "doc_id", "item_id")) == want
    assert {r[0] for r in rows(leaks.p8_clean(spark, d), "doc_id")} == set(range(60)) - {i for i, _ in want}


# Problem 9.


def letter(rnd):
    first, last = ["Linnea", "Rowan", "Tessa", "Gideon"], ["Talwick", "Norrick", "Pellsby", "Ambrine"]
    lines = [
        (f"My name is {rnd.choice(first)} {rnd.choice(last)} and I lost my account.", "name"), (f"Người gửi: {rnd.choice(['Hứa', 'Kha', 'Phí'])} {rnd.choice(['Quốc', 'Nhật'])} {rnd.choice(['Thịnh', 'Ngân'])}", "name"), (f"我叫{rnd.choice('施褚麦')}{rnd.choice(['伟廷', '志航'])}，账号被盗了", "name"),
        (f"E-mail: {rnd.choice(last).lower()}{rnd.randrange(99)}@quillpost.test.", "email"), (f"write to {rnd.choice(first).lower()} [at] thuxa (dot) test when done", "email"), (f"call me on 390.555.{rnd.randrange(1000, 9999)} after work", "phone"), (f"SĐT: 0125-881-{rnd.randrange(1000, 9999)}", "phone"),
        (f"手机号12{rnd.randrange(10**8, 10**9)}已经停用", "phone"), (f"số căn cước của tôi là 098{rnd.randrange(10**8, 10**9)}", "id_number"), (f"SSN: 666-{rnd.randrange(10, 99)}-{rnd.randrange(1000, 9999)}", "id_number"), (f"身份证号：99{rnd.randrange(1000, 9999)}19830120{rnd.randrange(1000, 9999)}", "id_number"),
        (f"Address: {rnd.randrange(1, 9999)} Larkspur Bend Lane, Port Ellery", "address"), (f"Địa chỉ: {rnd.randrange(1, 400)}A phố Cầu Vải, Kỳ Lâm", "address"), (f"我住在宁渡市西岭区东篱街{rnd.randrange(1, 400)}号，快递还没到", "address"),
        (f"Mã đơn {rnd.randrange(10**11, 10**12)} đã khóa.", None), (f"gift code GT-{rnd.randrange(10**7, 10**8)}.", None), ("icon btn_28@2x.png looks blurred.", None), (f"build 3.30.195.{rnd.randrange(1000, 9999)}.", None), ("Ta là Hồng Lôi, người giữ cửa của Cốc Ngọc.", None), ("我是百暗，松信村的守门人。", None), (f"Order ref {rnd.randrange(10**11, 10**12)} is locked.", None),
    ]
    rnd.shuffle(lines)
    return "\n".join(t for t, _ in lines), Counter(k for _, k in lines if k)


@pytest.fixture(scope="module")
def finder():
    rnd = random.Random(4)
    return personal.Finder([letter(rnd)[0] for _ in range(160)])


def test_personal_information_held_out(finder):
    rnd = random.Random(5)
    test = [letter(rnd) for _ in range(40)]
    found = finder([t for t, _ in test])
    assert sum(Counter(k for k, _, _ in f) == want for f, (_, want) in zip(found, test, strict=True)) >= 38
    text = test[0][0]
    clean = personal.redact(text, found[0])
    assert "@quillpost" not in clean and "[EMAIL]" in clean and "btn_28@2x.png" in clean and clean.count("\n") == text.count("\n")
    assert finder([None, ""]) == [[], []]


@pytest.mark.parametrize(
    ("text", "kind", "part"),
    [
        ("“anh Hứa Quốc Thịnh”", "name", "Hứa Quốc Thịnh"), ("(Mr. Gideon Pellsby)", "name", "Gideon Pellsby"), ('"Mrs Tessa Norrick"', "name", "Tessa Norrick"), ("chị: Kha Nhật Ngân", "name", "Kha Nhật Ngân"),
        ("12 Larkspur Bend\tLane", "address", "12 Larkspur Bend\tLane"), ("số 5 Cầu Vải, Kỳ Lâm", "address", "số 5 Cầu Vải, Kỳ Lâm"), ("call 555-0142", "phone", "555-0142"), ("mail ann [a] box.test", "email", "ann [a] box.test"),
    ],
)
def test_candidates_are_not_filtered_before(text, kind, part):
    assert part in [text[s:e] for k, s, e in personal.candidates(text) if k == kind]


def test_names_that_nothing_announces(finder):
    found = finder(["Please give this to Linnea Talwick before noon.", "Rowan Ambrine plays well.", "Nhờ Hứa Quốc Thịnh giúp.", "Ta là Hồng Lôi, người giữ cửa."])
    assert [[k for k, _, _ in f] for f in found] == [["name"], ["name"], ["name"], []]


def test_announced_monsters_are_no_names():
    texts = [letter(random.Random(i))[0] + "\nHer granddaughter was taken by grey wolves." for i in range(80)]
    finder = personal.Finder(texts)
    text = "The old woman lost her granddaughter, taken by grey wolves. This ticket was taken by Linnea Talwick."
    assert [text[s:e] for k, s, e in finder([text])[0]] == ["Linnea Talwick"]


def test_boosting_learns_and_calibrates():
    rnd = np.random.default_rng(0)
    x = rnd.integers(0, 5, (600, 6)).astype(float)
    y = ((x[:, 0] > 2) ^ (x[:, 3] > 1)).astype(float)
    m = Boosted(trees=60).fit(x[:400], y[:400])
    assert np.mean((m.predict(x[400:]) >= m.threshold) == y[400:]) > 0.95
    assert Boosted().fit(np.zeros((0, 2)), np.zeros(0)).predict(np.zeros((1, 2)))[0] < 0.5


@needs_data
def test_counts_on_the_tables_are_stable(spark, tmp_path):
    """The same rows give the same answers, whatever their order and partitions."""
    a = spark.read.parquet(f"{DATA}/documents.parquet")
    folder = str(tmp_path)
    for name in SCHEMAS:
        df = spark.read.parquet(f"{DATA}/{name}.parquet")
        (df.repartition(7) if name in ("documents", "translation_memory") else df).write.parquet(f"{folder}/{name}.parquet")
    assert a.count() == spark.read.parquet(f"{folder}/documents.parquet").count()
    for name in ("p1_found", "p2_found", "p8_found"):
        cols = queries.QUERIES[name](spark, DATA).columns
        assert rows(queries.QUERIES[name](spark, DATA), *cols) == rows(queries.QUERIES[name](spark, folder), *cols)
