"""Line breaking by UAX #14 for Unicode 16, and what is built on it: segments, markers, wrapping.

Each character with its marks is one unit, written as one symbol for its class.
A rule of the standard is a pattern of what stands before and after a place;
rules are tried over the whole text in their order, and the first that speaks
on a place settles it. Inside runs of Thai and the other scripts without
blanks the word boundaries decide.

Classes come from the ICU data that Spark ships with; they are read once from
the driver's JVM and passed along with the model.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Callable
from dataclasses import dataclass
from functools import cache, cached_property

import regex

from khamkit.functions.chars import WHITE_SPACE
from khamkit.functions.clusters import cluster_edges
from khamkit.functions.markup import has_markup, markup_spans
from khamkit.functions.segment import Model, spans

NO, ALLOWED, MANDATORY = 0, 1, 2
ZWSP = "​"
#: The line break classes, by the short names of the Unicode property.
CLASSES = "AI AK AL AP AS B2 BA BB BK CB CJ CL CM CP CR EB EM EX GL H2 H3 HL HY ID IN IS JL JT JV LF NL NS NU OP PO PR QU RI SA SG SP SY VF VI WJ XX ZW ZWJ".split()
#: Classes that LB1 resolves to another.
RESOLVED = {"AI": "AL", "SG": "AL", "XX": "AL", "CJ": "NS"}


@dataclass(frozen=True)
class LineTable:
    """Sorted starts of ranges, and the class and flags of each."""

    starts: tuple[int, ...]
    values: tuple[str, ...]

    def value(self, char: str) -> str:
        """The class, with * for wide East Asian characters and + for unassigned pictographs."""
        return self.values[bisect_right(self.starts, ord(char)) - 1]

    @cached_property
    def symbols(self) -> Symbols:
        return Symbols(self)


@cache
def icu_table(jvm_key: int | None = None) -> LineTable:
    """The table from ICU4J in the JVM of the active session."""
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()
    unicode_set = spark._jvm.com.ibm.icu.text.UnicodeSet
    marks: dict[int, list[tuple[int, str]]] = {}

    def ranges(pattern: str) -> list[tuple[int, int]]:
        shown = unicode_set(pattern).complement().complement().toPattern(True)  # complemented, it lists its members
        if shown == "[]":
            return []
        out = []
        item = r"\\u[0-9A-Fa-f]{4}|\\U[0-9A-Fa-f]{8}|\\x[0-9A-Fa-f]{2}|\\x\{[0-9A-Fa-f]+\}|\\.|[^\\]"
        for m in re.finditer(rf"({item})(?:-({item}))?", shown[1:-1], re.DOTALL):
            low = code_point(m[1])
            out.append((low, code_point(m[2]) if m[2] else low))
        return out

    def code_point(shown: str) -> int:
        if shown[:2] in ("\\u", "\\U", "\\x"):
            return int(shown[2:].strip("{}"), 16)
        return ord(shown[-1])

    bounds: dict[int, str] = {}
    for name in CLASSES:
        for low, high in ranges(f"[:lb={name}:]"):
            bounds[low] = RESOLVED.get(name, name)
    for pattern, value in (("[[:lb=SA:]&[[:gc=Mn:][:gc=Mc:]]]", "SM"), ("[[:lb=QU:]&[:gc=Pi:]]", "QI"), ("[[:lb=QU:]&[:gc=Pf:]]", "QF")):
        for low, high in ranges(pattern):
            marks.setdefault(low, []).append((high, value))
    flags = [(low, high, "*") for low, high in ranges("[[:ea=F:][:ea=W:][:ea=H:]]")] + [(low, high, "+") for low, high in ranges("[[:ExtPict:]&[:gc=Cn:]]")]
    overrides = [(low, high, value) for low, own in marks.items() for high, value in own]
    cuts = sorted({0, *bounds, *(x for low, high, _ in (*flags, *overrides) for x in (low, high + 1))} - {0x110000})
    base_starts = sorted(bounds)
    lookups = {kind: sorted((low, high) for low, high, value in (*flags, *overrides) if value == kind) for kind in ("*", "+", "SM", "QI", "QF")}

    def inside(kind: str, at: int) -> bool:
        own = lookups[kind]
        k = bisect_right(own, (at, 0x110000)) - 1
        return k >= 0 and own[k][0] <= at <= own[k][1]

    starts: list[int] = []
    values: list[str] = []
    for at in cuts:
        base = bounds[base_starts[bisect_right(base_starts, at) - 1]]
        base = next((k for k in ("SM", "QI", "QF") if inside(k, at)), base)
        value = base + "*" * inside("*", at) + "+" * inside("+", at)
        if not values or values[-1] != value:
            starts.append(at)
            values.append(value)
    return LineTable(tuple(starts), tuple(values))


#: Characters that rules name by themselves.
NAMED = {"‐": "HYPHEN", "◌": "DOTTED", "ๆ": "REPEAT", "ฯ": "ABBREV"}
#: One symbol for each kind of unit: class, East Asian or not, unassigned pictograph or not, named character.
KINDS = [(c, ea, xp, name) for c in sorted({*CLASSES, "SM", "QI", "QF"} - {*RESOLVED, "SM"}) for ea in ("", "*") for xp in ("", "+") for name in ("", *NAMED.values())]
SYMBOL = {kind: chr(0x4E00 + i) for i, kind in enumerate(KINDS)}


BLANK = SYMBOL["SP", "", "", ""]


def symbols(test: Callable[[str, str, str, str], bool]) -> str:
    """A pattern of one unit whose kind passes."""
    return "[" + "".join(s for kind, s in SYMBOL.items() if test(*kind)) + "]"


def any_of(names: str) -> str:
    """A pattern of one unit of these classes; AL takes letters of the scripts without blanks too."""
    wanted = set(names.split())
    if "AL" in wanted:
        wanted.add("SA")
    return symbols(lambda c, ea, xp, name: c in wanted)


#: Places in the list of the rules that hold only after a joiner, or only where words are known.
JOINED_AT, TAILORED_AT = 6, 7


def rules() -> list[tuple[regex.Pattern, int]]:
    """The rules of UAX #14 from LB4 on as (place pattern, action), in order."""
    c = any_of
    narrow = lambda names: symbols(lambda k, ea, xp, name: k in names.split() and not ea)
    not_of = lambda names: symbols(lambda k, ea, xp, name: k not in names.split())
    letter, hangul, quote = c("AL HL"), c("JL JV JT H2 H3"), c("QU QI QF")
    aksara = symbols(lambda k, ea, xp, name: k in ("AK", "AS") or name == "DOTTED")
    ak_dotted = symbols(lambda k, ea, xp, name: k == "AK" or name == "DOTTED")
    picture = symbols(lambda k, ea, xp, name: bool(xp))
    sp, nu = c("SP"), c("NU")
    ends = "BK CR LF NL"
    hyphen = symbols(lambda k, ea, xp, name: k == "HY" or name == "HYPHEN")
    not_wide = f"(?:{symbols(lambda k, ea, xp, name: not ea)}|\\Z)"
    regional = c("RI")
    listed: list[tuple[str, str, int]] = [
        (c("BK"), "", MANDATORY),
        (c("CR"), c("LF"), NO),
        (c("CR LF NL"), "", MANDATORY),
        ("", c(ends), NO),
        ("", c("SP ZW"), NO),
        (f"{c('ZW')}{sp}*", "", ALLOWED),
        ("", "", NO),  # after a joiner only, see JOINED_AT
        ("", symbols(lambda k, ea, xp, name: name in ("REPEAT", "ABBREV")), NO),  # where words are known only, see TAILORED_AT
        (c("WJ"), "", NO),
        ("", c("WJ"), NO),
        (c("GL"), "", NO),
        (not_of("SP BA HY"), c("GL"), NO),
        ("", c("CL CP EX SY"), NO),
        (f"{c('OP')}{sp}*", "", NO),
        (f"(?:\\A|{c(ends + ' OP QU QI QF GL SP ZW')}){c('QI')}{sp}*", "", NO),
        ("", f"{c('QF')}(?:{c('SP GL WJ CL QU QI QF CP EX IS SY ZW ' + ends)}|\\Z)", NO),
        (sp, f"{c('IS')}{nu}", ALLOWED),
        ("", c("IS"), NO),
        (f"{c('CL CP')}{sp}*", c("NS"), NO),
        (f"{c('B2')}{sp}*", c("B2"), NO),
        (sp, "", ALLOWED),
        ("", c("QU QF"), NO),
        (c("QU QI"), "", NO),
        (symbols(lambda k, ea, xp, name: not ea), quote, NO),
        ("", f"{quote}{not_wide}", NO),
        (quote, symbols(lambda k, ea, xp, name: not ea), NO),
        (f"(?:\\A|{symbols(lambda k, ea, xp, name: not ea)}){quote}", "", NO),
        (c("CB"), "", ALLOWED),
        ("", c("CB"), ALLOWED),
        (f"(?:\\A|{c(ends + ' SP ZW CB GL')}){hyphen}", c("AL"), NO),
        ("", c("BA HY NS"), NO),
        (c("BB"), "", NO),
        (f"{c('HL')}(?:{c('HY')}|{narrow('BA')})", not_of("HL"), NO),
        (c("SY"), c("HL"), NO),
        ("", c("IN"), NO),
        (letter, nu, NO),
        (nu, letter, NO),
        (c("PR"), c("ID EB EM"), NO),
        (c("ID EB EM"), c("PO"), NO),
        (c("PR PO"), letter, NO),
        (letter, c("PR PO"), NO),
        (f"{nu}{c('SY IS')}*{c('CL CP')}?", c("PO PR"), NO),
        (c("PO PR"), f"{c('OP')}{c('IS')}?{nu}", NO),
        (c("PO PR HY IS"), nu, NO),
        (f"{nu}{c('SY IS')}*", nu, NO),
        (c("JL"), c("JL JV H2 H3"), NO),
        (c("JV H2"), c("JV JT"), NO),
        (c("JT H3"), c("JT"), NO),
        (hangul, c("PO"), NO),
        (c("PR"), hangul, NO),
        (letter, letter, NO),
        (c("AP"), aksara, NO),
        (aksara, c("VF VI"), NO),
        (f"{aksara}{c('VI')}", ak_dotted, NO),
        (aksara, f"{aksara}{c('VF')}", NO),
        (c("IS"), letter, NO),
        (c("AL HL NU"), narrow("OP"), NO),
        (narrow("CP"), c("AL HL NU"), NO),
        (f"(?<!{regional})(?:{regional}{regional})*{regional}", regional, NO),
        (f"(?:{c('EB')}|{picture})", c("EM"), NO),
    ]
    return [(regex.compile(f"(?<={before})(?={after})(?!\\Z)"), action) for before, after, action in listed]


#: Contexts that are kept, and the units before a place that one has at most; longer ones are decided each time.
MOST_SEEN, MOST_CONTEXT = 100_000, 32


class Rules:
    """The compiled rules, and what they said of contexts seen before.

    A rule looks back over a run of blanks, separators, closings or regional
    indicators and two units before it, and ahead over three units. Places
    with equal contexts of that extent are decided once.
    """

    def __init__(self) -> None:
        listed = rules()
        self.joined, self.tailored = listed[JOINED_AT][0], listed[TAILORED_AT][0]
        self.listed = listed
        #: Inside runs of these no line breaks; the scripts without blanks are not among them.
        plain = symbols(lambda k, ea, xp, name: k in ("AL", "HL", "NU") and not name)
        #: Between two such runs a single space is broken after, whatever stands around.
        self.token = re.compile(f"{plain}+(?:{BLANK}{plain}+)*|.", re.DOTALL)
        self.seen: dict[tuple, int] = {}

    def action(self, line: str, k: int, joined: bool, words: bool) -> int:
        run = k
        while run and line[run - 1] in RUNS:
            run -= 1
        left = max(run - 2, 0)
        if k - left > MOST_CONTEXT:
            return self.decided(line, k, joined, words)
        key = (line[left:k], line[k : k + 3], left == 0, k + 3 >= len(line), joined, words)
        found = self.seen.get(key)
        if found is None:
            if len(self.seen) > MOST_SEEN:
                self.seen.clear()
            found = self.seen[key] = self.decided(line, k, joined, words)
        return found

    def decided(self, line: str, k: int, joined: bool, words: bool) -> int:
        for pattern, action in self.listed:
            if (pattern is self.joined and not joined) or (pattern is self.tailored and not words):
                continue
            if pattern.match(line, k):
                return action
        return ALLOWED


@cache
def compiled() -> Rules:
    return Rules()


class Symbols(dict):
    """The symbol of each code point, found when first needed; marks have symbols of their own."""

    def __init__(self, table: LineTable) -> None:
        self.table = table

    def __missing__(self, code: int) -> str:
        char = chr(code)
        value = self.table.value(char)
        cls = value.rstrip("*+")
        if cls in MARKS:
            self[code] = MARKS[cls]
        else:
            self[code] = SYMBOL[cls, "*" if "*" in value else "", "+" if "+" in value else "", NAMED.get(char, "")]
        return self[code]


def units_of(text: str, table: LineTable, words: bool) -> tuple[str, list[int] | None, set[int]]:
    """One symbol a unit, the place of each unit if marks make units longer, and the units that end in a joiner."""
    line = text.translate(table.symbols)
    places, joined = None, set()
    if HAS_MARK.search(line):
        units: list[str] = []
        places = []
        for i, s in enumerate(line):
            if s in MARK_SYMBOLS:
                if units and units[-1] not in NO_BASE:
                    (joined.add if s == MARKS["ZWJ"] else joined.discard)(len(units) - 1)
                    continue
                if s == MARKS["ZWJ"]:
                    joined.add(len(units))
                value = table.value(text[i])
                s = SYMBOL["AL", "*" if "*" in value else "", "+" if "+" in value else "", NAMED.get(text[i], "")]
            units.append(s)
            places.append(i)
        line = "".join(units)
    return line if words else line.translate(SA_TO_AL), places, joined


def break_actions(text: str, table: LineTable, boundaries: list[bool] | None = None) -> list[int]:
    """For each place 0..len(text): no break, allowed, or mandatory.

    ``boundaries`` are the word boundaries; without them letters of the scripts
    without blanks are like any letters.
    """
    return list(actions_of(text, table, boundaries))


def actions_of(text: str, table: LineTable, boundaries: list[bool] | None) -> bytearray:
    n = len(text)
    actions = bytearray(n + 1)
    if not n:
        return actions
    actions[n] = MANDATORY
    engine, words = compiled(), boundaries is not None
    line, places, joined = units_of(text, table, words)
    decide = engine.action
    for m in engine.token.finditer(line):
        k, stop = m.span()
        if k:
            at = k if places is None else places[k]
            if line[k] in SA_SYMBOLS and line[k - 1] in SA_SYMBOLS and line[k] not in NEVER_FIRST and k - 1 not in joined:
                actions[at] = ALLOWED if boundaries[at] else NO
            else:
                actions[at] = decide(line, k, k - 1 in joined, words)
        if stop - k > 2:
            k = line.find(BLANK, k, stop) + 1
            while k:
                actions[k if places is None else places[k]] = ALLOWED
                k = line.find(BLANK, k, stop) + 1
    # Within a run of plain letters a joiner may end a unit too; the runs are unbroken either way.
    return actions


SA_SYMBOLS = {s for (c, *_), s in SYMBOL.items() if c == "SA"}
NEVER_FIRST = {s for (*_, name), s in SYMBOL.items() if name in ("REPEAT", "ABBREV")}
RUNS = {s for (c, *_), s in SYMBOL.items() if c in ("SP", "SY", "IS", "CL", "CP", "RI")}
NO_BASE = {s for (c, *_), s in SYMBOL.items() if c in ("BK", "CR", "LF", "NL", "SP", "ZW")}
MARKS = {"CM": chr(0x3FFD), "SM": chr(0x3FFE), "ZWJ": chr(0x3FFF)}
MARK_SYMBOLS = set(MARKS.values())
HAS_MARK = re.compile("[" + "".join(MARKS.values()) + "]")
HAS_SA = re.compile("[" + "".join([*SA_SYMBOLS, MARKS["SM"]]) + "]")
SA_TO_AL = {ord(s): SYMBOL["AL", ea, xp, name] for (c, ea, xp, name), s in SYMBOL.items() if c == "SA"}


def can_break_between(left: str, right: str, table: LineTable) -> bool:
    """Whether a line may break between two tokens."""
    if not left or not right or left[-1] in WHITE_SPACE or right[0] in WHITE_SPACE:
        return False
    boundaries = [k == len(left) for k in range(len(left) + len(right) + 1)]
    return break_actions(left + right, table, boundaries)[len(left)] == ALLOWED


def segments(text: str, model: Model, table: LineTable) -> list[str]:
    """Pieces a line may break between; blanks and line ends stay in the piece they follow."""
    if not text:
        return []
    boundaries = [False] * (len(text) + 1)
    # Without letters of the scripts without blanks nothing asks for the words.
    for s in spans(text, model) if not text.isascii() and HAS_SA.search(text.translate(table.symbols)) else ():
        boundaries[s.end] = True
    actions = actions_of(text, table, boundaries)
    out, last = [], 0
    at = actions.find(ALLOWED, 1)
    while at > 0:
        out.append(text[last:at])
        last = at
        at = actions.find(ALLOWED, at + 1)
    return [*out, text[last:]]


def marked(text: str, model: Model, table: LineTable, marker: str) -> str:
    """``marker`` between segments, but never after white space or a zero-width space."""
    pieces = segments(text, model, table)
    out = pieces[:1]
    for before, piece in zip(pieces, pieces[1:], strict=False):
        out += [piece] if before[-1] in WHITE_SPACE + ZWSP else [marker, piece]
    return "".join(out)


def lines(text: str, model: Model, table: LineTable, marker: str = ZWSP, is_html: bool = False) -> str:
    """``text`` with ``marker`` wherever a line may break; markup, if asked for or found, stays as it is."""
    marker = marker or ZWSP
    if not is_html and not has_markup(text):
        return marked(text, model, table, marker)
    out, last = [], 0
    for start, end in markup_spans(text):
        out += [marked(text[last:start], model, table, marker), text[start:end]]
        last = end
    return "".join([*out, marked(text[last:], model, table, marker)])


#: Characters without width, and the wide ranges.
NO_WIDTH = re.compile(r"[ัิ-ฺ็-๎​]")
WIDE = re.compile(r"[⺀-鿿가-힯豈-﫿]")


def display_width(text: str) -> int:
    """Columns of a text: marks take none, wide characters two."""
    return len(text) if text.isascii() else len(text) - len(NO_WIDTH.findall(text)) + len(WIDE.findall(text))


def paragraphs(text: str) -> list[str]:
    """Lines without their ends; an end after the last makes no further line."""
    out = text.split("\n")
    if out[-1] == "":
        out.pop()
    return [p.removesuffix("\r") if k < len(out) - 1 or text.endswith("\n") else p for k, p in enumerate(out)]


def filled(pieces: list[str], width: int) -> list[str]:
    """Pieces on as few lines as a greedy fill needs; blanks at a line's end may hang over."""
    out: list[list[str]] = [[]]
    used = 0
    for piece in pieces:
        size = display_width(piece)
        solid = display_width(piece.rstrip(WHITE_SPACE)) if piece and piece[-1] in WHITE_SPACE else size
        if out[-1] and used + solid > width:
            if not "".join(out[-1]).rstrip(WHITE_SPACE):
                out.pop()
            out.append([])
            used = 0
        out[-1].append(piece)
        used += size
    return ["".join(line).rstrip(WHITE_SPACE) for line in out if line]


HTML_UNIT = re.compile(f"[^{WHITE_SPACE}{ZWSP}]*[{WHITE_SPACE}]*(?:{ZWSP}|(?=[^{WHITE_SPACE}{ZWSP}])|\\Z)")


def html_units(broken: str) -> list[str]:
    """Pieces between markers and after runs of white space."""
    return [u.removesuffix(ZWSP) for u in HTML_UNIT.findall(broken) if u]


def cut_to_width(text: str, width: int, table: LineTable) -> list[str]:
    """Pieces of at most ``width`` columns, parted between clusters only."""
    edges = cluster_edges(text)
    tied = [table.value(c).rstrip("*+") for c in text]
    out: list[str] = []
    unit = ""
    for k, char in enumerate(text):
        if unit and edges[k] and tied[k] not in ("CM", "SM", "ZWJ") and tied[k - 1] != "ZWJ":
            out.append(unit)
            unit = ""
        unit += char
    out.append(unit)
    pieces = [""]
    for unit in out:
        if pieces[-1] and display_width(pieces[-1]) + display_width(unit) > width:
            pieces.append("")
        pieces[-1] += unit
    return pieces


def wrap(text: str, width: int, model: Model, table: LineTable, is_html: bool = False, cut_long_words: bool = False, separator: str = "\n") -> str:
    """``text`` on lines of at most ``width`` columns; width 0 leaves it as it is."""
    if not text or width <= 0:
        return text
    out = []
    for paragraph in paragraphs(text):
        pieces = html_units(lines(paragraph, model, table, ZWSP, True)) if is_html else segments(paragraph, model, table)
        if cut_long_words:
            pieces = [p for piece in pieces for p in (cut_to_width(piece, width, table) if display_width(piece.rstrip(WHITE_SPACE)) > width else [piece])]
        out.append(separator.join(filled(pieces, width)))
    return separator.join(out)
