"""Character classes shared by the text functions."""

from __future__ import annotations

#: Unicode White_Space. Python's own notion also holds U+001C to U+001F.
WHITE_SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
#: Regular expression classes (without brackets) of Thai characters by role.
THAI = r"฀-๿"
CONSONANT = r"ก-ฮ"
TONE = r"่-๋"
TONE_OR_SILENT = r"่-์"
ABOVE_OR_BELOW = r"ัิ-ู"
#: Marks that stand on a consonant.
MARK = r"ัิ-ฺ็-๎"
#: Vowels and marks that never start a cluster.
DEPENDENT = r"ะ-ฺๅ็-๎"


def blank(text: str) -> bool:
    """Whether ``text`` is empty or all white space."""
    return not text.strip(WHITE_SPACE)
