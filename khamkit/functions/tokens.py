"""Tokens as native column expressions, for text without Thai letters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words, numbers, blanks, a line end, or one other character outside the Thai block.
PLAIN_TOKEN = (
    r"(?:[a-zA-Z]+(?:[-_'][a-zA-Z0-9]+)*|\p{Nd}+(?:,\p{Nd}+)*(?:\.\p{Nd}+)?%?"
    r"|[ \t]+|\r?\n|[^\x{0E00}-\x{0E7F}a-zA-Z0-9 \t\r\n])"
)


#: A token of white space alone.
BLANK = r"^\p{IsWhite_Space}*$"


def plain_tokens(text: Column | str, whole: bool = False) -> Column:
    """All tokens in order, blanks included; null text gives null. ``whole`` gives a lone carriage return too."""
    return F.regexp_extract_all(text, F.lit(PLAIN_TOKEN + r"|\r" if whole else PLAIN_TOKEN), F.lit(0))


def plain_words(text: Column | str) -> Column:
    """The tokens that hold anything but white space."""
    return F.filter(plain_tokens(text), lambda t: ~t.rlike(BLANK))
