"""Spans of markup in a text, found in linear time."""

from __future__ import annotations

import re
from bisect import bisect_left

HAS_MARKUP = re.compile(r"<[a-zA-Z/!?][^>]*>")
#: What may begin markup, and what ends it.
BEGIN = re.compile(r"<!--|(?i:<script)\b|(?i:<style)\b|<[a-zA-Z/!?]|&[a-zA-Z0-9#]+;")
ENDS = {"<!--": re.compile("-->"), "<script": re.compile("(?i:</script>)"), "<style": re.compile("(?i:</style>)"), "<": re.compile(">")}


def has_markup(text: str) -> bool:
    return HAS_MARKUP.search(text) is not None


class Ends:
    """Where each kind of end stands; each kind is looked for once in a text."""

    def __init__(self, text: str) -> None:
        self.text = text
        self.found: dict[str, list[int]] = {}

    def after(self, kind: str, at: int) -> int | None:
        """The end of the first one that begins at ``at`` or later."""
        if kind not in self.found:
            self.found[kind] = [m.start() for m in ENDS[kind].finditer(self.text)]
        own = self.found[kind]
        k = bisect_left(own, at)
        return own[k] + {"<!--": 3, "<script": 9, "<style": 8, "<": 1}[kind] if k < len(own) else None


def markup_spans(text: str) -> list[tuple[int, int]]:
    """(start, end) of comments, scripts, styles, tags and character references, in order."""
    ends = Ends(text)
    out = []
    at = 0
    while m := BEGIN.search(text, at):
        start, kind = m.start(), m[0].lower()
        end = m.end() if kind[0] == "&" else None
        if kind == "<!--":
            end = ends.after(kind, m.end())
        elif kind in ("<script", "<style"):
            tag = ends.after("<", m.end())
            end = ends.after(kind, tag) if tag is not None else None
        if end is None:
            end = ends.after("<", start + 1)
        if end is None:
            at = start + 1
        else:
            out.append((start, end))
            at = end
    return out


def without_markup(text: str) -> str:
    out, last = [], 0
    for start, end in markup_spans(text):
        out.append(text[last:start])
        last = end
    return "".join([*out, text[last:]])
