"""HTML extraction by wrappers: union-free regular expressions of a host's pages.

A page is read as a stream of well-formed tags and texts. The streams of a few
pages of one host are aligned one after another: equal tags match, siblings of
one shape fold into a repeated group, what one side lacks becomes optional, and
texts that differ become slots. The result is a regular expression without
unions. Its slots decide what is main text: texts that all pages share are
template, and the article is the element that holds nearly all of what the
slots of the host's pages carry, whatever it is called.

Pages then go through their host's wrapper one by one. A page that has nothing
at the article's place, and pages of hosts with too few pages or without such
an element, are settled by the elements around each text.

A wrapper is fitted on at most ``PAGES`` different pages of a host, those with
the smallest hashes; every page is extracted whole. Nothing here recurses, so
pages may be nested to any depth.
"""

from __future__ import annotations

import heapq
import html
import json
import re
from collections import Counter
from collections.abc import Callable, Generator, Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from khamkit.llm.common import checkpointed
from khamkit.llm.urls import host

#: The most pages a wrapper is fitted on. Each batch offers as many of a host, so that batches and partitions don't matter.
PAGES = 12
#: A wrapper of fewer pages decides nothing; a text is template only if as many different pages all have it.
LEAST_PAGES = 5
#: The share of what slots carry that the article's element holds, and the share of links that makes a repeated group a menu.
HOLDS, LINKS = 0.7, 0.9
#: Cells of the table that aligns two lists of siblings; longer lists are aligned in pieces.
CELLS = 40_000
#: Wrappers are broadcast up to so many bytes, else joined.
BROADCAST_BYTES = 16_000_000

#: Fixed values of HTML: elements by how they are read.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg math noembed noframes xmp".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img br".split())
DROPPED = frozenset("nav header footer aside form button select option fieldset head dialog menu script style textarea title noscript template iframe svg math object canvas audio video map".split())
CLOSED_BY = {
    "p": frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul li dd dt td th tr body".split()),
    "li": frozenset(["li"]),
    "dt": frozenset(["dt", "dd"]),
    "dd": frozenset(["dt", "dd"]),
    "tr": frozenset(["tr", "tbody", "thead", "tfoot"]),
    "td": frozenset(["td", "th", "tr"]),
    "th": frozenset(["td", "th", "tr"]),
    "option": frozenset(["option", "optgroup"]),
}
#: What an open element of these can't be closed across by a sibling.
SCOPES = frozenset("table ul ol dl select article section div main".split())
#: Words of a class, id or role that name what isn't article text, outside a main part.
BOILER = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion nav navbar navigation menu menubar topbar breadcrumb breadcrumbs sidebar aside rail widget widgets footer header masthead "
    "cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe signup login search share sharing social related recommended trending comment comments commentlist reply replies discussion disqus responses "
    "pagination pager toolbar skip hidden copyright legal contentinfo complementary banner".split()
)
#: Of these the names that count inside a main part too. They say what goes by the task itself: reader comments, adverts,
#: sidebars, consent and sign-up notices, share bars. Words that can name a section of an article are not among them.
FOREIGN = frozenset("ad ads advert adverts advertisement advertising sponsored sidebar breadcrumb breadcrumbs pagination navbar cookie cookies consent gdpr newsletter signup share sharing comment comments commentlist disqus".split())
MAIN_WORDS = frozenset("article content main post entry story body text maincontent articlebody".split())
#: Elements that can be an article as a whole.
CONTAINERS = frozenset("html body main article section div center table tbody tr td".split())

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<![^>]*(?:>|\Z)|<\?[^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(>|\Z)|[^<]+|<", re.DOTALL)
ATTRIBUTE = re.compile(r"(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.IGNORECASE)
WORDS = re.compile(r"[a-z]+")


def signature(tag: str, attributes: str) -> str:
    """The tag with its class, id and role, without digits."""
    if not attributes or "=" not in attributes:
        return tag
    named = sorted((m[1].lower(), re.sub(r"\d+", "", (m[2] or m[3] or m[4] or "")).strip().lower()) for m in ATTRIBUTE.finditer(attributes))
    return tag + "".join(f"[{k}={' '.join(v.split())}]" for k, v in named if v)


@lru_cache(100_000)
def named(sign: str) -> tuple[bool, bool, bool]:
    """Whether an element is by its tag or names no article text, whether it is so inside an article too, whether it is a main part."""
    tag, _, rest = sign.partition("[")
    names = set(WORDS.findall(re.sub(r"\b(class|id|role)=", " ", rest)))
    dropped = tag in DROPPED
    main = tag in ("article", "main") or (tag in ("div", "section", "td") and not MAIN_WORDS.isdisjoint(names))
    return dropped or not BOILER.isdisjoint(names), dropped or not FOREIGN.isdisjoint(names), main


def foreign(sign: str) -> bool:
    """Whether an element is no article text wherever it stands."""
    return not sign.startswith(("html", "body")) and named(sign)[1]


def entered(state: int, sign: str) -> int:
    """What text in an element is, by the element around it: 0 no article text, wherever it stands; 2 in a main part; else 1."""
    if not state or sign.startswith(("html", "body")):
        return state
    outside, inside, main = named(sign)
    if state == 2:
        return 0 if inside else 2
    return 0 if outside else 2 if main else 1


def stream(page: str) -> Iterator[tuple[str, object]]:
    """('<', signature), ('>', signature) and ('t', (text, linked)): block elements balanced, one text a block's stretch.

    Missing end tags are supplied, stray ones dropped; a tag cut off at the
    page's end is dropped. Inline elements part no text.
    """
    open_: list[tuple[str, str]] = []
    counts: Counter[str] = Counter()
    #: Places in open_ of the elements that a sibling closes or that scope those.
    closable: list[int] = []
    held: list[str] = []
    links = linked = 0

    def closed() -> tuple[str, str]:
        tag, sign = open_.pop()
        counts[tag] -= 1
        if closable and closable[-1] == len(open_):
            closable.pop()
        return tag, sign

    def text() -> Iterator[tuple[str, object]]:
        nonlocal linked
        whole = " ".join(html.unescape("".join(held)).split())
        held.clear()
        if whole:
            yield "t", (whole, min(linked, len(whole)))
        linked = 0

    at = 0
    while at < len(page):
        m = TOKEN.match(page, at)
        at = m.end()
        tag = m[2]
        if tag is None:
            raw = m[0]
            if not raw.startswith("<!") and not raw.startswith("<?"):
                held.append(raw)
                linked += len(raw) if links else 0
            continue
        if not m[4]:
            continue
        tag = tag.lower()
        if m[1]:
            if tag in INLINE:
                links = max(0, links - (tag == "a"))
                continue
            if counts[tag]:
                yield from text()
                links = 0
                while open_:
                    t, sign = closed()
                    yield ">", sign
                    if t == tag:
                        break
            continue
        if tag in RAW:
            if not m[3].endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}\s*[^>]*(?:>|\Z)", re.IGNORECASE).search(page, at)
                at = end.end() if end else len(page)
            continue
        if tag in INLINE or tag in VOID:
            if tag in ("br", "hr", "img"):
                held.append(" ")
            links += tag == "a"
            if tag != "hr":
                continue
        yield from text()
        links = 0
        if tag in VOID:
            continue
        for k in reversed(closable):
            if tag in CLOSED_BY.get(open_[k][0], ()):
                while len(open_) > k:
                    yield ">", closed()[1]
                break
            if open_[k][0] in SCOPES:
                break
        if m[3].rstrip().endswith("/"):
            continue
        sign = signature(tag, m[3])
        if tag in SCOPES or tag in CLOSED_BY:
            closable.append(len(open_))
        open_.append((tag, sign))
        counts[tag] += 1
        yield "<", sign
    yield from text()
    while open_:
        yield ">", closed()[1]


# A wrapper is a list of nodes: ["t", {hash: length} of the texts that all pages so far have there, pages, characters,
# linked characters, whether texts differed] for texts, ["e", signature, children, optional, repeated] for an element.


def done(job: Generator) -> object:
    """What a generator returns that yields the generators whose results it asks for: recursion of any depth."""
    stack, value = [job], None
    while True:
        try:
            stack.append(stack[-1].send(value))
            value = None
        except StopIteration as end:
            stack.pop()
            value = end.value
            if not stack:
                return value


def tree(tokens: Iterator[tuple[str, object]]) -> list[list]:
    """The nodes of one page's stream, repeats folded."""
    path: list[list] = []
    now: list[list] = []
    for kind, value in tokens:
        if kind == "<":
            children: list[list] = []
            now.append(["e", value, children, False, False])
            path.append(now)
            now = children
        elif kind == ">":
            above = path.pop()
            above[-1][2] = done(folded(now))
            now = above
        else:
            now.append(["t", {str(xxhash.xxh3_64_intdigest(value[0].encode())): len(value[0])}, 1, len(value[0]), value[1], False])
    return done(folded(now))


def flat(nodes: list[list]) -> list:
    """The nodes as one list, an element's children between it and a null, for writing nodes of any depth as JSON."""
    out: list = []
    todo = [iter(nodes)]
    while todo:
        n = next(todo[-1], None)
        if n is None:
            todo.pop()
            out += [None] * bool(todo)
        elif n[0] == "t":
            out.append(n)
        else:
            out.append(["e", n[1], n[3], n[4]])
            todo.append(iter(n[2]))
    return out


def unflat(rows: list) -> list[list]:
    path: list[list] = [[]]
    for r in rows:
        if r is None:
            path.pop()
        elif r[0] == "t":
            path[-1].append(r)
        else:
            path[-1].append(["e", r[1], [], r[2], r[3]])
            path.append(path[-1][-1][2])
    return path[0]


def folded(nodes: list[list]) -> Generator:
    """Runs of adjacent groups of equal signatures become one repeated group."""
    out: list[list] = []
    for node in nodes:
        if out and node[0] == "e" and out[-1][0] == "e" and out[-1][1] == node[1]:
            out[-1] = yield merged(out[-1], node, True)
            out[-1][4] = True
        else:
            out.append(node)
        for period in (2, 3):
            if len(out) >= 2 * period and all(alike(a, b) for a, b in zip(out[-period:], out[-2 * period : -period], strict=True)):
                tail = out[-period:]
                del out[-period:]
                for k, x in enumerate(tail):
                    same = yield merged(out[k - period], x, True)
                    if same[0] == "e":
                        same[4] = True
                    out[k - period] = same
                break
    return out


def merged(a: list, b: list, one_page: bool = False) -> Generator:
    """Two nodes at one place of the wrapper: of one page (``a`` takes ``b`` in), or of others."""
    if a[0] == "e":
        return ["e", a[1], (yield aligned(a[2], b[2], one_page)), a[3] or b[3], a[4] or b[4]]
    differ = a[5] or b[5] or a[1].keys() != b[1].keys()
    if one_page:
        a[1].update(b[1])
        return ["t", a[1], max(a[2], b[2]), a[3] + b[3], a[4] + b[4], differ]
    return ["t", {h: n for h, n in a[1].items() if h in b[1]}, a[2] + b[2], a[3] + b[3], a[4] + b[4], differ]


def aligned(a: list[list], b: list[list], one_page: bool = False) -> Generator:
    """Both lists as one, by their longest common order; what one lacks becomes optional.

    Of long lists the equal beginning and end are aligned first and the rest
    piece by piece, each up to its last match; nothing is left out.
    """
    out: list[list] = []
    end: list[list] = []
    if len(a) * len(b) > CELLS:
        n = min(len(a), len(b))
        start = next((k for k in range(n) if not alike(a[k], b[k])), n)
        stop = next((k for k in range(n - start) if not alike(a[-1 - k], b[-1 - k])), n - start)
        for x, y in zip(a[:start], b[:start], strict=True):
            out.append((yield merged(x, y, one_page)))
        for x, y in zip(a[len(a) - stop :], b[len(b) - stop :], strict=True):
            end.append((yield merged(x, y, one_page)))
        a, b = a[start : len(a) - stop], b[start : len(b) - stop]
    while len(a) * len(b) > CELLS:
        short = min(len(a), len(b), int(CELLS**0.5))
        long = CELLS // short
        i, j = (short, long) if len(a) <= len(b) else (long, short)
        pairs = in_order(a[:i], b[:j])
        last = next((k for k in range(len(pairs) - 1, -1, -1) if None not in pairs[k]), None)
        if last is None:
            # No match: go on in the longer list.
            i, j = (0, min(j, len(b))) if len(a) <= len(b) else (min(i, len(a)), 0)
            out += [lacking(x) for x in (a[:i] or b[:j])]
        else:
            out += yield together(a, b, pairs[: last + 1], one_page)
            i, j = pairs[last][0] + 1, pairs[last][1] + 1
        a, b = a[i:], b[j:]
    out += yield together(a, b, in_order(a, b), one_page)
    return (yield folded(out + end))


def alike(x: list, y: list) -> bool:
    return x[0] == y[0] and (x[0] == "t" or x[1] == y[1])


def lacking(node: list) -> list:
    """A node that other pages lack."""
    return node if node[0] == "t" else [*node[:3], True, node[4]]


def in_order(a: list[list], b: list[list]) -> list[tuple[int | None, int | None]]:
    """Places of ``a`` and ``b`` in their longest common order: both, or one that the other lacks."""
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            best[i][j] = max(best[i + 1][j], best[i][j + 1], best[i + 1][j + 1] + 1 if alike(a[i], b[j]) else 0)
    out: list[tuple[int | None, int | None]] = []
    i = j = 0
    while i < len(a) or j < len(b):
        if i < len(a) and j < len(b) and alike(a[i], b[j]) and best[i][j] == best[i + 1][j + 1] + 1:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif j >= len(b) or (i < len(a) and best[i + 1][j] >= best[i][j + 1]):
            out.append((i, None))
            i += 1
        else:
            out.append((None, j))
            j += 1
    return out


def together(a: list[list], b: list[list], pairs: list[tuple[int | None, int | None]], one_page: bool) -> Generator:
    out = []
    for i, j in pairs:
        if i is None or j is None:
            out.append(lacking(b[j] if i is None else a[i]))
        else:
            out.append((yield merged(a[i], b[j], one_page)))
    return out


def joined(a: list[list], b: list[list]) -> list[list]:
    """The wrapper of two, or of a wrapper and a page's nodes."""
    return done(aligned(a, b))


def expression(nodes: list[list]) -> str:
    """The wrapper as a union-free regular expression, for people."""
    out: list[str] = []
    ends: list[str] = []
    first = True
    for n in flat(nodes):
        if n is None:
            out.append(ends.pop())
            first = False
            continue
        out.append("" if first else " ")
        first = n[0] == "e"
        if first:
            marks = "+" * n[3] + "?" * n[2]
            out.append(f"{'(' if marks else ''}<{n[1]}>")
            ends.append(f"</{n[1].partition('[')[0]}>{')' if marks else ''}{marks}")
        else:
            out.append("#text" if n[5] else "#constant")
    return "".join(out)


def inner(place: int, sign: str) -> int:
    """The name of an element's place in the wrapper: a hash of its path."""
    return xxhash.xxh3_64_intdigest(sign.encode(), place)


@dataclass
class Open:
    """An element of a wrapper while it is read: its place, what its slots carry, and what stands around it."""

    place: int
    foreign: bool = False
    repeated: bool = False
    heading: bool = False
    carried: int = 0
    headed: int = 0


def settled(wrapper: list[list], pages: int) -> dict:
    """What a wrapper decides: the article's place, its title's if that stands outside, menus in it, template texts.

    The article is the innermost element, once a page, that holds ``HOLDS`` of what
    the slots carry beside links. It is null, and pages are settled by their own
    elements, if the wrapper has too few pages or nothing smaller than the body
    holds so much. Menus are repeated groups that hold little but links. Pages
    that share more than half of their text are copies of one another; their
    common text is no template.
    """
    out: dict = {"article": None, "title": [], "menus": [], "template": []}
    if pages < LEAST_PAGES:
        return out
    carried: Counter[int] = Counter()
    headed: Counter[int] = Counter()
    signs: dict[int, str] = {}
    below: dict[int, list[int]] = {}
    often: set[int] = set()
    titles: set[int] = set()
    links: dict[int, list[int]] = {}
    template: dict[str, int] = {}
    whole = 0
    path = [Open(0)]
    for n in flat(wrapper):
        up = path[-1]
        if n is None:
            path.pop()
            carried[up.place] += up.carried
            headed[up.place] += up.headed
            if not up.foreign:
                path[-1].carried += up.carried
                path[-1].headed += up.headed
        elif n[0] == "e":
            place, tag = inner(up.place, n[1]), n[1].partition("[")[0]
            if place in signs or n[3]:
                often.add(place)
            else:
                below.setdefault(up.place, []).append(place)
            signs[place] = n[1]
            path.append(Open(place, up.foreign or foreign(n[1]), up.repeated or bool(n[3]), up.heading or tag == "h1"))
        else:
            common = n[1] if n[2] >= pages else {}
            varying = max(0, n[3] - pages * sum(common.values()) - n[4])
            up.carried += varying
            up.headed += varying if up.heading else 0
            if not up.foreign:
                whole += n[3]
                template |= {f"{up.place}#{h}": size for h, size in common.items()}
                if up.heading and not up.repeated and varying:
                    titles.add(up.place)
            if up.repeated:
                have = links.setdefault(up.place, [0, 0])
                have[0] += n[3]
                have[1] += n[4]
    if 2 * pages * sum(template.values()) <= whole:
        out["template"] = sorted(template)
    out["menus"] = sorted(p for p, (n, linked) in links.items() if linked >= LINKS * n)
    root = path[0]
    at = 0
    while True:
        own = [p for p in below.get(at, ()) if p not in often and signs[p].partition("[")[0] in CONTAINERS and not foreign(signs[p])]
        best = max(own, key=lambda p: carried[p], default=None)
        if best is None or not root.carried or carried[best] < HOLDS * root.carried:
            break
        at = best
    if at and not signs[at].startswith(("html", "body")):
        out["article"] = at
        out["title"] = [] if headed[at] else sorted(titles)
    return out


def extracted(page: str, wrapper: dict | None) -> tuple[str, bool]:
    """The main text, blocks in page order, one a line; and whether the wrapper decided it."""
    article, title, menus, template = (wrapper[k] for k in ("article", "title", "menus", "template")) if wrapper else (None, (), (), ())
    # Of each open element: its place, what its text is by the elements, and by the wrapper (0 outside the article).
    path: list[tuple[int, int, int]] = [(0, 1, 0)]
    by_element: list[tuple[int, str]] = []
    by_wrapper: list[str] = []
    seen = False
    for kind, value in stream(page):
        if kind == "<":
            place, own, inside = path[-1]
            place = inner(place, value) if wrapper else 0
            at_article = article is not None and place == article
            seen = seen or at_article
            path.append((place, entered(own, value), 2 if at_article else entered(inside, value)))
        elif kind == ">":
            path.pop()
        else:
            text, linked = value
            place, own, inside = path[-1]
            if template and f"{place}#{xxhash.xxh3_64_intdigest(text.encode())}" in template:
                continue
            if (inside and place not in menus) or place in title:
                by_wrapper.append(text)
            if own == 1 and 2 * linked > len(text):
                own = 0
            if own:
                by_element.append((own, text))
    if seen:
        return "\n".join(by_wrapper), True
    best = max((k for k, _ in by_element), default=0)
    return "\n".join(t for k, t in by_element if k == best), False


def offered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each host of a batch, the trees of its first pages by hash."""
    for batch in batches:
        first: dict[str, set[tuple[int, str]]] = {}
        for name, page in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if page:
                first.setdefault(name, set()).add((xxhash.xxh3_64_intdigest(page.encode()) >> 1, page))
        rows = [(name, h, json.dumps(flat(tree(stream(p))))) for name, own in first.items() for h, p in heapq.nsmallest(PAGES, own)]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.string())], names=["host", "order", "tree"])


def inferred(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The wrapper of each host, from rows sorted by host and hash."""
    name: str | None = None
    wrapper: list[list] = []
    pages = 0

    def out() -> pa.RecordBatch:
        verdicts = json.dumps(settled(wrapper, pages))
        return pa.RecordBatch.from_arrays([pa.array([name], pa.string()), pa.array([pages], pa.int32()), pa.array([expression(wrapper)], pa.string()), pa.array([verdicts], pa.string())], names=["host", "pages", "wrapper", "verdicts"])

    for batch in batches:
        for now, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            own = unflat(json.loads(data))
            if now != name:
                if pages:
                    yield out()
                name, wrapper, pages = now, own, 1
            else:
                wrapper = joined(wrapper, own)
                pages += 1
    if pages:
        yield out()


def wrappers(pages: DataFrame, url: str = "url", page: str = "html") -> DataFrame:
    """(host, pages, wrapper, verdicts) of every host that has a page; pages of no host are of many sites and get none.

    Equal pages meet by hash, however often they occur; then each partition
    sends at most ``PAGES`` trees of a host to the task that aligns them.
    """
    rows = pages.select(host(url).alias("host"), F.col(page).alias("html")).where("host <> ''").mapInArrow(offered, "host string, order long, tree string")
    rows = rows.groupBy("host", "order").agg(F.first("tree").alias("tree"))
    first = rows.withColumn("place", F.row_number().over(Window.partitionBy("host").orderBy("order"))).where(F.col("place") <= PAGES)
    return first.sortWithinPartitions("host", "order").select("host", "tree").mapInArrow(inferred, "host string, pages int, wrapper string, verdicts string")


def extract(n_columns: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def call(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read: dict[str | None, dict | None] = {None: None}
        for batch in batches:
            found = []
            for page, known in zip(batch.column(n_columns).to_pylist(), batch.column(n_columns + 1).to_pylist(), strict=True):
                if known not in read:
                    if len(read) > 2000:
                        read = {None: None}
                    read[known] = {k: frozenset(v) if isinstance(v, list) else v for k, v in json.loads(known).items()}
                found.append(extracted(page or "", read[known]))
            kept = [batch.column(k) for k in range(n_columns)]
            made = [pa.array([t for t, _ in found], pa.string()), pa.array([w for _, w in found], pa.bool_())]
            yield pa.RecordBatch.from_arrays([*kept, *made], names=[*batch.schema.names[:n_columns], "main_text", "decided"])

    return call


def main_text(pages: DataFrame, url: str = "url", page: str = "html") -> DataFrame:
    """``pages`` without the html, with ``text`` (the main text, empty if none), ``n_chars`` and ``by_wrapper``.

    ``by_wrapper`` tells whether the host's wrapper decided the text. Null html is
    an empty page; pages with null urls and urls without :// have no wrapper and
    are settled by their own elements. Pages may be of any length and nested to
    any depth. Columns named text, n_chars or by_wrapper are replaced. Repeated
    rows are extracted each; an empty table gives an empty result.
    """
    known = checkpointed(wrappers(pages, url, page).select(F.col("host").alias("own_host"), "verdicts"))
    size = known.agg(F.sum(F.length("own_host") + F.length("verdicts"))).first()[0] or 0
    # Broadcast only within the bound; a longer table of wrappers is joined, and a hot host's pages are split by AQE.
    known = F.broadcast(known) if size <= BROADCAST_BYTES else known.hint("merge")
    rest = [c for c in pages.columns if c not in (page, "text", "n_chars", "by_wrapper")]
    held = [F.col(c).alias(f"c{i}") for i, c in enumerate(rest)]
    rows = pages.select(*held, F.col(page).alias("html"), host(url).alias("host")).join(known, F.col("host") == F.col("own_host"), "left")
    kinds = dict(pages.dtypes)
    schema = "".join(f"c{i} {kinds[c]}, " for i, c in enumerate(rest)) + "main_text string, decided boolean"
    out = rows.select(*[f"c{i}" for i in range(len(rest))], "html", "verdicts").mapInArrow(extract(len(rest)), schema)
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(rest)], F.col("main_text").alias("text"), F.length("main_text").cast("long").alias("n_chars"), F.col("decided").alias("by_wrapper"))
