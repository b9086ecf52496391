"""Kernels without Spark: codecs, templates, replies, glossary matching, streams, units, workbooks."""

from __future__ import annotations

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lexiloom.functions import codecs, external, replies, templates
from lexiloom.functions.glossary import LiteralMatcher, translate
from lexiloom.sources import archive, nrv2b, units, workbook


@given(st.binary(max_size=2000))
@settings(max_examples=60, deadline=None)
def test_stream_round_trip(data):
    assert nrv2b.decompress(nrv2b.compress(data), len(data)) == data


@pytest.mark.parametrize("data", [b"", b"hello", bytes(range(256)) * 2, b"ab" * 4000, b"x" * 100_000])
def test_stream_vectors(data):
    packed = nrv2b.compress(data)
    assert nrv2b.decompress(packed, len(data)) == data
    if data:
        with pytest.raises(nrv2b.StreamError):
            nrv2b.decompress(packed, len(data) - 1)
        with pytest.raises(nrv2b.StreamError):
            nrv2b.decompress(packed[:-3], len(data))


def test_stream_far_match():
    filler = random.Random(1).randbytes(5000)
    data = b"needle in a stack" + filler + b"needle in a stack"
    assert nrv2b.decompress(nrv2b.compress(data), len(data)) == data


def test_tcvn3_round_trip():
    text = "nhiệm vụ của Đạo sĩ: đánh bại thủy quái ở Cốc Ngọc"
    data = codecs.encode_tcvn3(text)
    assert codecs.decode_tcvn3(data) == text
    assert codecs.encode_tcvn3("微") is None


def test_decode_best_prefers_valid_utf8_and_finds_legacy():
    assert codecs.decode_best("任务奖励".encode())[:3] == ("任务奖励", "utf-8", "zh")
    assert codecs.decode_best("微笑".encode("gb18030"))[:2] == ("微笑", "gb18030")
    assert codecs.decode_best(codecs.encode_tcvn3("nhiệm vụ trang bị của người chơi"))[0] == "nhiệm vụ trang bị của người chơi"
    assert codecs.decode_best("任务 quest".encode("utf-16"))[1].startswith("utf-16")
    assert codecs.decode_best(b"")[2] == "unknown"
    assert codecs.decode_best(None)[0] == ""


def test_to_utf8_keeps_line_ends():
    data = "任务".encode("gb18030") + b"\r\nplain\tcell\n" + "tên".encode() + b"\r"
    assert codecs.to_utf8(data).decode() == "任务\r\nplain\tcell\ntên\r"
    assert codecs.encode_source("a b") == b"a b"
    assert codecs.decode_fallback("任务".encode("gb18030")) == "任务"


TEXTS = ["<c=yellow>Tiến độ</c> 5/7", "%s nhận {0} và ${name}", "$Mở cửa #d1+", "không có gì", "", "100% {a}{b}", "Đến 2024-05-06 lúc 10:30 tại \\spr\\ui\\a.spr"]


@pytest.mark.parametrize("text", TEXTS)
def test_template_round_trip(text):
    masked, tokens, frame = templates.make_template(text)
    assert templates.restore_template(masked, tokens, frame) == (text, "")


@given(st.text(alphabet="aăbĐ◈{}P1 23<>%s$#@\n《》", max_size=40))
@settings(max_examples=150, deadline=None)
def test_skeleton_joins_to_the_text(text):
    assert "".join(v for _, _, v in templates.skeleton(text)) == text


def test_restore_damaged_markers():
    masked, tokens, frame = templates.make_template("Nhận %s rồi đưa {0} cho %d người")
    assert masked == "Nhận ◈1◈ rồi đưa ◈2◈ cho ◈3◈ người"
    for damaged in ("把 《P1》 给 (2) 和 【3】", "把 ◈ P 01 ◈ 给 {2} 和 ◈3", "把 {P1} 给 {P2}{P3}", "把 {P1P2} 给 {P3人}"):
        got, error = templates.restore_template(damaged, tokens, frame)
        assert error == "" and all(v in got for _, v in tokens), damaged
    assert templates.restore_template("把 ◈1◈", tokens, frame)[0] is None


def test_template_keeps_required_symbols_inside():
    assert templates.make_template("<b>Tên</b>")[2] == "{P1}{TEXT}{P2}"
    assert templates.make_template("@ Tên")[2] == "{TEXT}"


def test_reassemble_accepts_only_clean_segments():
    pieces = templates.skeleton("<b>Tên</b> của ta")
    ids = [i for k, i, _ in pieces if k == "t"]
    assert templates.reassemble(pieces, {ids[0]: "名字", ids[1]: "我的"})[0] == "<b>名字</b> 我的"
    assert templates.reassemble(pieces, {ids[0]: "名5字", ids[1]: "◈1◈"}) == ("<b>Tên</b> của ta", 0, 2)


def test_aliases_round_trip():
    masked, pairs = templates.alias("%s và {0} ♥")
    assert "%s" not in masked and templates.unalias(masked, pairs) == "%s và {0} ♥"
    assert templates.unalias("", pairs) is None


def test_validity_ignores_numbers():
    assert templates.is_valid("Cần 5 {0}", "需要六个 {0}")[0]
    assert not templates.is_valid("Cần {0}", "需要")[0]
    assert not templates.is_valid("12=Tên", "名字")[0]


def test_reply_parsers():
    want = [("1", "一"), ("2", "二")]
    for reply in (
        '[{"id":"1","text":"一"},{"id":"2","text":"二"}]', '```json\n[{"id":1,"translation":"一"},{"id":2,"译文":"二"},]\n```', '[{\\"id\\":\\"1\\",\\"text\\":\\"一\\"},{\\"id\\":\\"2\\",\\"text\\":\\"二\\"}]',
        "[{'id':'1','text':'一'},{'id':'2','text':'二'}]", 'thinking {"id":"1","text":"一"} then {"id":"2","text":"二"} and {"id":"3","te',
    ):
        assert replies.parse_items(reply) == want, reply
    assert replies.parse_items('{"id":"7","text":"{a}"}') == [("7", "{a}")]
    assert replies.parse_items(None) == [] and replies.parse_items("nothing") == []
    assert replies.parse_positional('["a","b"]', 2) == ["a", "b"] and replies.parse_positional('["a",""]', 2) is None and replies.parse_positional('["a"]', 2) is None
    framed = "ZXQROW000000ZX a ZXQROW000001ZX b ZXQROW000002ZX"
    assert replies.parse_framed(framed, 2) == ["a", "b"] and replies.parse_framed(framed, 3) is None


def test_literal_matcher_is_leftmost_longest():
    m = LiteralMatcher({"vũ khí": "武器", "vũ": "舞", "Nhiệm vụ": "任务", "khí": "气"})
    assert m("VŨ KHÍ mới, nhiệm vụ vũ")[0] == "武器 mới, 任务 舞"
    assert m("nhiệm vụ") == ("任务", 1)
    assert m("vụ") == ("vụ", 0) and m(None) == (None, 0) and m("vũkhí")[1] == 0
    assert translate("Nhận nhiệm vụ mới", {"nhiệm vụ": "任务"}, {"nhận": "领取"}) == "领取任务 mới"


def test_bisect_isolates_bad_rows():
    calls = []

    def call(texts):
        calls.append(len(texts))
        if "bad" in texts:
            raise RuntimeError
        return [t.upper() for t in texts]

    assert external.bisect(["a", "b", "bad", "c"], call) == ["A", "B", None, "C"] and max(calls) == 4
    assert external.bisect([], call) == []


def test_lua_spans_and_replacement():
    line = b'Say("Hi <c=red>there</c>", \'it\\\'s\') -- "no"'
    assert [c for _, _, c in units.lua_strings(line)] == [b"Hi <c=red>there</c>", b"it\\'s"]
    assert [c for _, _, c in units.lua_parts(line)] == [b"Hi ", b"there", b"it\\'s"]
    new = units.replace_lua(line, {2: b'a "b"'})
    assert new == b'Say("Hi <c=red>a \\"b\\"</c>", \'it\\\'s\') -- "no"' and units.lua_skeleton(new) == units.lua_skeleton(line)
    assert units.lua_strings(b'x = "open') == []


def test_cells_and_patch_keep_other_bytes():
    tsv = b"ID\tName\r\n1\tone\r\n\r\n2\ttwo"
    cells = units.cells_of(tsv, "tsv")
    assert (2, 2, b"", b"one") in cells and (4, 2, b"", b"two") in cells
    assert units.patch(tsv, "tsv", {(2, 2): b"ONE", (9, 1): b"x"}) == b"ID\tName\r\n1\tONE\r\n\r\n2\ttwo"
    ini = b"[A]\n; c\nTitle = x\n"
    assert units.cells_of(ini, "ini") == [(3, 1, b"Title", b"x")]
    assert units.patch(ini, "ini", {(3, 1): b"y"}) == b"[A]\n; c\nTitle = y\n"


def test_sniffing():
    for data, ext in ((b"\x89PNG\r\n\x1a\nxx", ".png"), (b"a\tb\nc\td\n", ".tsv"), (b"[S]\nk=v\n", ".ini"), (b"local a\nreturn function () end", ".lua"), (b'{"a": 1}', ".json"), (b"<?xml?>", ".xml"), (b"plain text", ".txt"), (b"\0\1\2", ".bin"), (b"", ".bin")):
        assert archive.sniff(data)[0] == ext, data


def test_workbook_rows(tmp_path):
    path = str(tmp_path / "a.xlsx")
    rows = [["id", "text"], ["1", "a <b> & 'c'"], ["2", None], ["", "中\x01文"]]
    workbook.write_rows(iter(rows), path)
    got = list(workbook.read_rows((tmp_path / "a.xlsx").read_bytes()))
    assert got == [["id", "text"], ["1", "a <b> & 'c'"], ["2", ""], ["", "中文"]]
    assert workbook.column_name(28) == "AB" and workbook.column_number("AB12") == 28
