"""Words, texts and clashing columns for the corpus tests."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = [a + b for a in "ba ke li mo nu ra se ti vo zu".split() for b in "ban del fir gos hum kat lor mis pen tul wex".split()]


def sentence(pick: random.Random, n: int) -> str:
    return " ".join(pick.choice(WORDS) for _ in range(n))


CLASHING = "n_words n_removed kept_text kept n_base labels score size target finish turn key fp fps node component_id salt place settled h1 part guest tie host path rule verdict may c0 c1 start ids sketch evidence held_out main_text html_text first copy range bucket sent ahead base_failed".split()


def clashed(df):
    """``df`` with further columns whose names operators use themselves."""
    have = {c.lower() for c in df.columns}
    return df.withColumns({c: F.lit("x") for c in CLASHING if c not in have})
