"""The text functions as columns.

One Arrow-batched function segments a text into spans; tokens, boundaries and
joins follow from the spans by native expressions. Texts without Thai letters
need no lattice: tokens and normalization of such rows are native, and Python
sees a null for them. Null in, null out, for every function.
"""

from __future__ import annotations

import weakref
from collections.abc import Callable
from dataclasses import replace
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from khamkit.functions import clusters, linebreak, markup, normalize, segment
from khamkit.functions.linebreak import LineTable, icu_table
from khamkit.functions.segment import Bigrams, Lexicon, Model
from khamkit.functions.tokens import plain_tokens, plain_words

THAI_LETTER = r"[฀-๿]"
SPANS = "array<struct<start: int, end: int, token: string, is_oov: boolean>>"
SPAN_PAIRS = "array<struct<start: int, end: int>>"
WEIGHTED = "array<struct<word: string, weight: double>>"
#: The Arrow type of each kind of result.
ARROW = {
    "string": pa.string(),
    "boolean": pa.bool_(),
    "array<string>": pa.list_(pa.string()),
    "array<boolean>": pa.list_(pa.bool_()),
    "array<tinyint>": pa.list_(pa.int8()),
    "array<int>": pa.list_(pa.int32()),
    SPANS: pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("token", pa.string()), ("is_oov", pa.bool_())])),
    SPAN_PAIRS: pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])),
    WEIGHTED: pa.list_(pa.struct([("word", pa.string()), ("weight", pa.float64())])),
}
#: Rows that are Python objects at a time; the longest text that is remembered, and the most characters of such texts.
ROWS, SHORT, MOST_HELD = 64, 1_000, 500_000
UNITS: dict[str, Callable[[str], int]] = {"char": len, "byte": lambda t: len(t.encode()), "utf16": lambda t: len(t.encode("utf-16-le")) // 2}
#: Limits of a service that takes texts from strangers.
MOST_CHARS, MOST_MARKER, MOST_ITEMS = 500_000, 16, 1_000


def column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def batched(function: Callable, kind: str, arity: int = 1) -> Callable:
    """``function`` as an Arrow function of so many columns; a row with a null gives null.

    A batch is as large as Spark makes it (64 MB); only a few of its rows are
    Python objects at a time. Short texts that come again are done once.
    """
    arrow = ARROW[kind]
    done: dict = {}
    held = 0

    def value(row: tuple) -> object:
        nonlocal held
        if any(x is None for x in row):
            return None
        if row in done:
            return done[row]
        out = function(*row)
        size = sum(len(x) for x in row if isinstance(x, str))
        if size <= SHORT:
            if held > MOST_HELD:
                done.clear()
                held = 0
            # So that many very short texts are bounded too.
            held += size + 8
            done[row] = out
        return out

    def call(*parts: pa.Array) -> pa.Array:
        pieces = [pa.array([], arrow)]
        for at in range(0, len(parts[0]), ROWS):
            rows = zip(*(p.slice(at, ROWS).to_pylist() for p in parts), strict=True)
            pieces.append(pa.array([value(row) for row in rows], arrow))
        return pa.concat_arrays(pieces)

    # A fixed number of array arguments, as the declaration needs.
    wrapped = {1: lambda a: call(a), 2: lambda a, b: call(a, b)}[arity]
    wrapped.__annotations__ = dict.fromkeys(wrapped.__code__.co_varnames, pa.Array) | {"return": pa.Array}
    return F.arrow_udf(wrapped, kind)


def mapped(function: Callable, kind: str, *columns: Column | str) -> Column:
    """``function`` over Arrow batches of the columns."""
    return batched(function, kind, len(columns))(*map(column, columns))


def by_script(text: Column | str, native: Column, thai: Callable[[Column], Column]) -> Column:
    """``thai`` of texts with Thai letters, ``native`` of the others; the function behind ``thai`` is given null for those."""
    c = column(text)
    has = c.rlike(THAI_LETTER)
    return F.when(has, thai(F.when(has, c))).otherwise(native)


def sent(model: Model) -> Callable[[], Model]:
    """A way to the model on workers: broadcast once for each context, or along with the function where no session runs."""
    session = SparkSession.getActiveSession()
    if session is None:
        return lambda: model
    key = (session.sparkContext.applicationId, id(model))
    if key not in _SENT:
        _SENT[key] = session.sparkContext.broadcast(model)
        weakref.finalize(model, _SENT.pop, key, None)
    shared = _SENT[key]
    return lambda: shared.value


#: Broadcasts of models that are in use.
_SENT: dict[tuple[str, int], object] = {}


class TextFunctions:
    """Columns over one pair of lexicons: ``words`` for tokens, ``lines`` for line breaks (the same if not given)."""

    def __init__(self, words: Lexicon, lines: Lexicon | None = None, bigrams: Bigrams | None = None) -> None:
        self.model = Model(words, bigrams)
        self.line_model = Model(lines or words, bigrams)
        self._table: LineTable | None = None

    @property
    def table(self) -> LineTable:
        self._table = self._table or icu_table()
        return self._table

    def with_bigrams(self, bigrams: Bigrams | None) -> TextFunctions:
        out = TextFunctions(self.model.lexicon, self.line_model.lexicon, bigrams)
        out.model = replace(self.model, bigrams=bigrams)
        return out

    def spans(self, text: Column | str) -> Column:
        """All tokens with their places in code points, blanks included; is_oov tells guessed ones."""
        model = sent(self.model)

        def call(t: str) -> list[dict]:
            return [{"start": s.start, "end": s.end, "token": t[s.start : s.end], "is_oov": s.unknown} for s in segment.spans(t, model())]

        return mapped(call, SPANS, text)

    def tokens(self, text: Column | str, keep_whitespace: bool = False) -> Column:
        model = sent(self.model)
        native = plain_tokens(text, whole=True) if keep_whitespace else plain_words(text)
        return by_script(text, native, lambda c: mapped(lambda t: segment.words(t, model(), keep_whitespace), "array<string>", c))

    words = tokens

    def lattice_tokens(self, text: Column | str) -> Column:
        """Tokens by the lattice alone, also where it isn't needed; for tests and comparisons."""
        model = sent(self.model)
        return mapped(lambda t: [t[s.start : s.end] for s in segment.lattice_spans(t, model()) if not segment.blank(t[s.start : s.end])], "array<string>", text)

    def join(self, text: Column | str, separator: str = "|") -> Column:
        return F.array_join(self.tokens(text), separator)

    def boundaries(self, text: Column | str, unit: str = "char") -> Column:
        """Offsets of token boundaries from 0 to the text's length, in code points, bytes or UTF-16 units."""
        model, size = sent(self.model), UNITS[unit]

        def call(t: str) -> list[int]:
            return list(accumulate((size(t[s.start : s.end]) for s in segment.spans(t, model())), initial=0))

        return mapped(call, "array<int>", text)

    def html_words(self, text: Column | str, keep_whitespace: bool = False) -> Column:
        """Tokens of the text between markup."""
        model = sent(self.model)

        def call(t: str) -> list[str]:
            out, last = [], 0
            for start, end in [*markup.markup_spans(t), (len(t), len(t))]:
                out += segment.words(t[last:start], model(), keep_whitespace)
                last = end
            return out

        return mapped(call, "array<string>", text)

    def lines(self, text: Column | str, marker: str = linebreak.ZWSP, is_html: bool = False) -> Column:
        model, table = sent(self.line_model), self.table
        return mapped(lambda t: linebreak.lines(t, model(), table, marker, is_html), "string", text)

    def segments(self, text: Column | str) -> Column:
        model, table = sent(self.line_model), self.table
        return mapped(lambda t: linebreak.segments(t, model(), table), "array<string>", text)

    def break_actions(self, text: Column | str, dictionary: bool = True) -> Column:
        """The action before each place of a text: 0 none, 1 allowed, 2 mandatory."""
        model, table = sent(self.line_model), self.table

        def call(t: str) -> list[int]:
            ends = {s.end for s in segment.spans(t, model())} if dictionary else None
            return linebreak.break_actions(t, table, [k in ends for k in range(len(t) + 1)] if ends is not None else None)

        return mapped(call, "array<tinyint>", text)

    def line_classes(self, text: Column | str) -> Column:
        """The line break class of each character; * marks wide East Asian ones, + unassigned pictographs."""
        table = self.table
        return mapped(lambda t: [table.value(c) for c in t], "array<string>", text)

    def can_break_between(self, left: Column | str, right: Column | str) -> Column:
        table = self.table
        return mapped(lambda a, b: linebreak.can_break_between(a, b, table), "boolean", left, right)

    def wrap(self, text: Column | str, width: int = 80, is_html: bool = False, cut_long_words: bool = False, separator: str = "\n") -> Column:
        model, table = sent(self.line_model), self.table
        return mapped(lambda t: linebreak.wrap(t, width, model(), table, is_html, cut_long_words, separator), "string", text)

    def normalize(self, text: Column | str, check_lexicon: bool = False, **steps: bool) -> Column:
        options, model = normalize.Normalization(**steps), sent(self.model) if check_lexicon else None
        # Without Thai letters only characters without width can change.
        native = F.translate(text, normalize.ZERO_WIDTH, "") if options.remove_zero_width else column(text)
        return by_script(text, native, lambda c: mapped(lambda t: normalize.normalized(t, options, model().lexicon if model else None), "string", c))

    def prefixes(self, text: Column | str, start: int = 0, most: int = segment.LONGEST) -> Column:
        """Lexicon words that begin at ``start``, shortest first."""
        model = sent(self.model)
        return mapped(lambda t: [{"word": t[start:e], "weight": w} for e, w in model().lexicon.beginning(t, start, most)], WEIGHTED, text)

    def compare(self, df: DataFrame, text: str = "text") -> DataFrame:
        """``df`` with words and break opportunities side by side."""
        return df.withColumns({"words": self.join(text), "lines": self.lines(text, "|")})

    def process(self, df: DataFrame, mode: str = "words", text: str = "text", normalize_first: bool = False, marker: str = linebreak.ZWSP, width: int = 80, delimiter: str = "|", limited: bool = False) -> DataFrame:
        """``df`` with ``result``: words, lines, wrap or join of ``text``, normalized first if asked for."""
        if limited and max(len(marker), len(delimiter)) > MOST_MARKER:
            raise ValueError(f"a marker or delimiter has at most {MOST_MARKER} characters")
        if limited and df.limit(MOST_ITEMS + 1).count() > MOST_ITEMS:
            raise ValueError(f"a request has at most {MOST_ITEMS} items")
        source = F.col(text)
        if limited:
            source = F.when(F.length(text) > MOST_CHARS, F.raise_error(F.lit(f"a text has at most {MOST_CHARS} characters")).cast("string")).otherwise(source)
        if normalize_first:
            source = self.normalize(source)
        ways = {"words": self.tokens, "lines": lambda c: self.lines(c, marker), "wrap": lambda c: self.wrap(c, width), "join": lambda c: self.join(c, delimiter)}
        if mode not in ways:
            raise ValueError(f"no mode {mode!r}")
        return df.withColumn("result", ways[mode](source))

    def tokens_of(self, df: DataFrame, text: str = "text", into: str = "tokens") -> DataFrame:
        """``df``, read once, with the tokens of ``text``."""
        return df.withColumn(into, self.tokens(text))


def following(boundaries: Column, offset: Column | int) -> Column:
    """The first boundary after ``offset``; null if there is none."""
    return F.array_min(F.filter(boundaries, lambda b: b > offset))


def preceding(boundaries: Column, offset: Column | int) -> Column:
    """The last boundary before ``offset``; null if there is none."""
    return F.array_max(F.filter(boundaries, lambda b: b < offset))


def moved(boundaries: Column, at: Column | int, n: int) -> Column:
    """The boundary ``n`` places on from the boundary ``at``; null beyond the ends and where ``at`` is none."""
    here = F.array_position(boundaries, F.lit(at) if isinstance(at, int) else at)
    to = here + n
    return F.when((here > 0) & (to > 0) & (to <= F.size(boundaries)), F.get(boundaries, (to - 1).cast("int")))


def next_boundary(boundaries: Column, at: Column | int) -> Column:
    return moved(boundaries, at, 1)


def previous_boundary(boundaries: Column, at: Column | int) -> Column:
    return moved(boundaries, at, -1)


def current_boundary(boundaries: Column, at: Column | int) -> Column:
    """``at`` itself if it is a boundary."""
    return moved(boundaries, at, 0)


def is_boundary(boundaries: Column, offset: Column | int) -> Column:
    return F.array_contains(boundaries, offset)


def first(boundaries: Column) -> Column:
    return F.element_at(boundaries, 1)


def last(boundaries: Column) -> Column:
    return F.element_at(boundaries, -1)


def cluster_edges(text: Column | str) -> Column:
    """For each place of a text, whether a token may end there."""
    return mapped(clusters.cluster_edges, "array<boolean>", text)


def display_width(text: Column | str) -> Column:
    """Columns of a text: Thai marks and zero-width spaces take none, CJK and Hangul two."""
    seen = F.regexp_replace(column(text), r"[\x{0E31}\x{0E34}-\x{0E3A}\x{0E47}-\x{0E4E}\x{200B}]", "")
    return F.length(seen) + F.length(F.regexp_replace(seen, r"[^\x{2E80}-\x{9FFF}\x{AC00}-\x{D7AF}\x{F900}-\x{FAFF}]", ""))


def without_zero_width(text: Column | str) -> Column:
    return F.regexp_replace(column(text), r"[\x{200B}-\x{200F}\x{FEFF}]", "")


def is_markup(text: Column | str) -> Column:
    return column(text).rlike(r"<[a-zA-Z/!?][^>]*>")


def without_markup(text: Column | str) -> Column:
    return mapped(markup.without_markup, "string", text)


def markup_spans(text: Column | str) -> Column:
    """(start, end) of comments, scripts, styles, tags and character references."""
    return mapped(lambda t: [{"start": a, "end": b} for a, b in markup.markup_spans(t)], SPAN_PAIRS, text)


def escaped(text: Column | str) -> Column:
    """HTML with its special characters as references, ready for lines(is_html=True)."""
    out = column(text)
    for char, ref in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#039;")):
        out = F.replace(out, F.lit(char), F.lit(ref))
    return out


def wrapped_lines(df: DataFrame, wrapped: str, into: str = "line") -> DataFrame:
    """One row a line of a wrapped column."""
    return df.select("*", F.posexplode(F.split(wrapped, "\n")).alias("line_no", into)).drop(wrapped)


