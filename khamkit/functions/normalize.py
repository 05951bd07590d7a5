"""Spelling normalization of Thai text, step by step in a fixed order."""

from __future__ import annotations

import re
from dataclasses import dataclass

from khamkit.functions.chars import ABOVE_OR_BELOW, CONSONANT, MARK, THAI, TONE, TONE_OR_SILENT, WHITE_SPACE
from khamkit.functions.segment import Lexicon


@dataclass(frozen=True)
class Normalization:
    """The steps; all are on unless switched off."""

    remove_zero_width: bool = True
    normalize_sara_ae: bool = True
    remove_spaces_before_marks: bool = True
    normalize_sara_am: bool = True
    reorder_vowels_tone: bool = True
    remove_dangling: bool = True
    remove_repeat_vowels: bool = True
    remove_repeat_consonants: bool = True


#: Characters without width that are dropped.
ZERO_WIDTH = "​‌‍﻿‎‏"
DROP_ZERO_WIDTH = dict.fromkeys(map(ord, ZERO_WIDTH))
SPACED_MARK = re.compile(f"(?<=[{CONSONANT}]) +(?=[{MARK}])")
#: Nikhahit with sara aa, the tone mark before, between or after them: tone and sara am.
SARA_AM = f"ํา[{TONE}]?|ํ[{TONE}]า|[{TONE}]ํา"
#: A tone or silent mark before a vowel above or below; a following vowel before a tone mark; an aa of the long form.
MISPLACED = f"[{TONE_OR_SILENT}][{ABOVE_OR_BELOW}]|[ะาำๅ][{TONE}]|(?<![ฤฦ])ๅ"
DANGLING = re.compile(f"(\\A|[{WHITE_SPACE}])[{MARK}]+")
REPEATED = re.compile(f"([ะ-ูเ-ไ็])\\1+|[{TONE_OR_SILENT}]*([{TONE_OR_SILENT}])|(ๆ)ๆ+")
REPEATED_CONSONANT = re.compile(f"([{CONSONANT}])\\1\\1+")
#: What may follow a word that ends in a doubled consonant.
DOUBLED = re.compile(f"([{CONSONANT}])\\1(?=\\Z|[{WHITE_SPACE}.,!?;:()\\[\\]{{}}'\"<>/|ๆฯ])")
THAI_TAIL = re.compile(f"[{THAI}]{{0,20}}\\Z")


def composed(m: re.Match) -> str:
    """What a match of the composing step becomes."""
    found = m[0]
    if "ํ" in found:
        return "".join(c for c in found if "่" <= c <= "๋") + "ำ"
    if len(found) == 1:
        return "า"
    return found[1] + ("า" if found[0] == "ๅ" else found[0])


def single_ending(text: str, lexicon: Lexicon) -> str:
    """Doubled last consonants made single where the lexicon has the word so, and not with both.

    Only a whole stretch of Thai up to the doubled letters is looked up with
    both, but any ending of it with one.
    """

    def once(m: re.Match) -> str:
        letter = m[1]
        head = THAI_TAIL.search(text, 0, m.start())[0]
        if head + letter * 2 in lexicon:
            return m[0]
        stem = head.rstrip(letter) if head else ""
        stem = stem or (head[:1] if head else "")
        ends = [stem[k:] + letter for k in range(len(stem))] if head else [letter + letter]
        return letter if any(e in lexicon for e in ends) else m[0]

    return DOUBLED.sub(once, text)


def normalized(text: str, options: Normalization = Normalization(), lexicon: Lexicon | None = None) -> str:
    if options.remove_zero_width:
        text = text.translate(DROP_ZERO_WIDTH)
    if options.remove_spaces_before_marks:
        text = SPACED_MARK.sub("", text)
    if options.normalize_sara_ae:
        text = text.replace("เเ", "แ")
    steps = [SARA_AM] * options.normalize_sara_am + [MISPLACED] * options.reorder_vowels_tone
    if steps:
        text = re.sub("|".join(steps), composed, text)
    if options.remove_dangling:
        text = DANGLING.sub(r"\1", text)
    if options.remove_repeat_vowels:
        text = REPEATED.sub(lambda m: m[1] or m[2] or m[3], text)
    if options.remove_repeat_consonants:
        text = REPEATED_CONSONANT.sub(r"\1", text)
        if lexicon is not None:
            text = single_ending(text, lexicon)
    return text
