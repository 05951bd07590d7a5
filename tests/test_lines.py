"""Line breaks, wrapping, width, markup and normalization."""

from __future__ import annotations

import random
import re
import time

import pytest

from khamkit.functions import linebreak as lb
from khamkit.functions.markup import markup_spans, without_markup
from khamkit.functions.normalize import Normalization, normalized
from khamkit.functions.segment import Lexicon, Model

FIXTURE = Model(Lexicon.of("สวัสดี ครับ สี ขาว ข้อความ ไทย ไป ไหม สิ วัน ที่ นะ เวลา ประเทศ สยาม เป็น เขา พูด ว่า แล้ว ดี มาก ภาษา ทดสอบ เด็ก เล่น ต่อ และ ถ้า".split()))


@pytest.fixture(scope="module")
def table(spark):
    return lb.icu_table()


def test_classes(table):
    expected = {"a": "AL", "1": "NU", " ": "SP", "-": "HY", "–": "BA", "(": "OP", ")": "CP", "}": "CL", "、": "CL", "/": "SY", ".": "IS", "!": "EX", '"': "QU", "“": "QI", "”": "QF", "$": "PR", "%": "PO", "ก": "SA", "ั": "SM", "๐": "NU", "中": "ID", "가": "H2", "א": "HL", "​": "ZW", "\xa0": "GL", "‍": "ZWJ", "́": "CM"}
    assert {c: table.value(c).rstrip("*+") for c in expected} == expected
    assert table.value("（").endswith("*") and not table.value("(").endswith("*")
    assert "+" in table.value("\U0001fffd") and "+" not in table.value("😀")


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("สวัสดีครับ", "สวัสดี|ครับ"),
        ("สี-ขาว", "สี-|ขาว"),
        ("ข้อความ–ข้อความ", "ข้อความ–|ข้อความ"),
        ("ISO/IEC 29110", "ISO/|IEC 29110"),
        ("เวลา 10:30 น.", "เวลา 10:30 น."),
        ("ราคา $(5) ลด 40%", "ราคา $(5) ลด 40%"),
        ("e.g.ไทย", "e.g.ไทย"),
        ("ราคา100บาท", "ราคา100บาท"),
        ("ประเทศไทย(สยาม)เป็น", "ประเทศ|ไทย(สยาม)เป็น"),
        ("เขาพูดว่า “สวัสดี” แล้ว", "เขา|พูด|ว่า “สวัสดี” แล้ว"),
        ("ไทย⁠ไทย", "ไทย⁠ไทย"),
        ("🇹🇭🇯🇵", "🇹🇭|🇯🇵"),
        ("ดี👍🏽มาก", "ดี|👍🏽|มาก"),
        ("A\\B", "A\\B"),
        ("state-of-the-art", "state-|of-|the-|art"),
        ("https://example.com/a-b?x=1", "https://|example.com/|a-|b?|x=1"),
        ("<b>ภาษาไทย</b>", "<b>ภาษา|ไทย</b>"),
        ("", ""),
    ],
)
def test_lines(table, text, expected):
    assert lb.lines(text, FIXTURE, table, "|") == expected


def test_scripts_without_a_lexicon_break_at_tokens(table):
    assert lb.lines("ລາວ", FIXTURE, table, "|") == "ລ|າ|ວ"


def test_contexts_decided_before_decide_alike(table):
    """Places decided from memory against the rules tried afresh."""
    pick = random.Random(12)
    pool = "aA1 .,-/()“”«»\"'!?%$\u200b\u200d\u0301กิๆฯ中（가א\u2060\xa0\n\r‐👍🏽🇹🇭😀…"
    for _ in range(1500):
        text = "".join(pick.choice(pool) for _ in range(pick.randrange(1, 14)))
        known = lb.break_actions(text, table)
        lb.compiled().seen.clear()
        assert lb.break_actions(text, table) == known


def test_mandatory_breaks(table):
    assert lb.break_actions("a\r\nb", table) == [0, 0, 0, 2, 2]


@pytest.mark.parametrize(
    ("text", "width", "expected"),
    [
        ("the quick brown fox jumps over the lazy dog", 10, ["the quick", "brown fox", "jumps over", "the lazy", "dog"]),
        ("state-of-the-art design", 10, ["state-of-", "the-art", "design"]),
        ("ทดสอบเด็กๆๆๆๆๆๆ", 5, ["ทดสอบ", "เด็กๆๆๆๆๆๆ"]),
        ("เด็ก ๆ เล่น", 4, ["เด็ก ๆ", "เล่น"]),
        ("ข้อความ ( ไทย ) ต่อ", 8, ["ข้อความ", "( ไทย )", "ต่อ"]),
        ("a\nb\n", 5, ["a", "b"]),
    ],
)
def test_wrap(table, text, width, expected):
    assert lb.wrap(text, width, FIXTURE, table).split("\n") == expected


def test_wrap_options(table):
    long = Model(Lexicon.of(["กรุงเทพมหานคร"]))
    assert lb.wrap("กรุงเทพมหานคร", 4, long, table, cut_long_words=True, separator="/") == "กรุง/เทพม/หานค/ร"
    assert lb.wrap("ab cd", 0, FIXTURE, table) == "ab cd"
    assert lb.wrap("<b>the quick</b> brown", 9, FIXTURE, table, is_html=True).replace("\n", " ") == "<b>the quick</b> brown"


def test_can_break_between(table):
    assert lb.can_break_between("ภาษา", "ไทย", table)
    assert not lb.can_break_between("เด็ก", "ๆ", table)
    assert not lb.can_break_between("a ", "b", table) and not lb.can_break_between("", "b", table)


def test_markers_come_out_again(table):
    pick = random.Random(8)
    pool = "กขคไปเาิ่ aB1-(),.​ 中é"
    for _ in range(200):
        text = "".join(pick.choice(pool) for _ in range(pick.randrange(25)))
        marked = lb.lines(text, FIXTURE, table, "\x01")
        assert marked.replace("\x01", "") == text
        assert not re.search(r"[\s​]\x01", marked)


def test_width():
    assert [lb.display_width(t) for t in ("ก็", "ภาษาไทย", "English", "中文", "😀")] == [1, 7, 7, 4, 1]


MARKUP = re.compile(r"(?si:<!--.*?-->|<script\b[^>]*>.*?</script>|<style\b[^>]*>.*?</style>|<[a-zA-Z/!?][^>]*>|&[a-zA-Z0-9#]+;)")


def test_markup_is_what_the_pattern_finds():
    pick = random.Random(9)
    parts = ["<!--", "-->", "<script", ">", "</script>", "<style>", "</style>", "<b", "</b>", "&amp;", "&", "a", " ", "<", "x1", ";", "<SCRIPT>", "<scripty>"]
    for _ in range(5000):
        text = "".join(pick.choice(parts) for _ in range(pick.randrange(12)))
        assert markup_spans(text) == [m.span() for m in MARKUP.finditer(text)], text
    assert without_markup("<p>a&amp;b</p>") == "ab"


def test_unterminated_markup_is_linear():
    began = time.perf_counter()
    markup_spans("<script>" * 40_000)
    markup_spans("<!--" * 40_000)
    assert time.perf_counter() - began < 5


@pytest.mark.parametrize(
    ("text", "expected"),
    [("เเปลก", "แปลก"), ("นํ้า", "น้ำ"), ("นำ้ตาล", "น้ำตาล"), ("นานาาา", "นานา"), ("มากๆๆๆ", "มากๆ"), ("คำ ่ที่สอง", "คำ ที่สอง"), ("ดีมากกกก", "ดีมาก"), ("", ""), ("plain​ text", "plain text")],
)
def test_normalize(text, expected):
    assert normalized(text) == expected


def test_normalize_options():
    lexicon = Lexicon.of(["มาก", "ดีมาก", "กก"])
    assert normalized("ดีมากก", lexicon=lexicon) == "ดีมาก"
    assert normalized("ต้นกก", lexicon=lexicon) == "ต้นกก"
    off = Normalization(**dict.fromkeys(Normalization.__dataclass_fields__, False))
    assert normalized("เเ​มากกกก", off) == "เเ​มากกกก"
