"""Romanisation of Indic scripts and of Latin letters with marks, as a column expression.

The Indic blocks of Unicode share one layout of 128 places, so one table by place serves Devanagari, Bengali, Gurmukhi, Gujarati, Odia,
Tamil, Telugu, Kannada and Malayalam. It is phonetic and has no inherent vowels: two spellings of a name become alike, which is all
that blocking needs.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FIRST, LAST = 0x0900, 0x0D7F


def _table() -> list[str]:
    out = [""] * 128
    vowels = ["a", "aa", "i", "ii", "u", "uu", "r", "l", "e", "e", "e", "ai", "o", "o", "o", "au"]
    out[0x01:0x04] = ["m", "n", "h"]
    out[0x04] = "a"
    out[0x05:0x15] = vowels
    rows = ["k kh g gh ng", "c ch j jh ny", "tt tth dd ddh nn", "t th d dh n", "n p ph b bh m", "y r rr l ll lll v", "sh ss s h"]
    out[0x15:0x3A] = [x for r in rows for x in r.split()][: 0x3A - 0x15]
    out[0x3E:0x4D] = vowels[1:6] + ["r", "r", "e", "e", "e", "ai", "o", "o", "o", "au"]
    out[0x50] = "om"
    out[0x58:0x60] = ["q", "khh", "ghh", "z", "dddh", "rh", "f", "yy"]
    out[0x60:0x64] = ["rr", "ll", "l", "ll"]
    out[0x64:0x66] = [".", "."]
    out[0x66:0x70] = [str(i) for i in range(10)]
    return out


TABLE = _table()
# Latin letters that lose their mark here before case is folded; lower case is in text.ACCENTS.
CAPITALS = dict(zip("ÁÀÂÄÃÅĀÉÈÊËĒÍÌÎÏĪÓÒÔÖÕØŌÚÙÛÜŪÝŸÑÇĐŁŠŽČŘŃ", "AAAAAAAEEEEEIIIIIOOOOOOOUUUUUYYNCDLSZCRN", strict=True))


def romanized(c: Column) -> Column:
    """c in ASCII as far as the tables go; ASCII text is not touched, null stays null."""
    from .text import ACCENTS

    single = {k: v for k, v in (ACCENTS | CAPITALS).items() if len(v) == 1}
    latin = F.translate(c, "".join(single), "".join(single.values()))
    for k, v in (("ß", "ss"), ("æ", "ae"), ("œ", "oe"), ("Æ", "AE"), ("Œ", "OE")):
        latin = F.replace(latin, F.lit(k), F.lit(v))
    table = F.array(*(F.lit(x) for x in TABLE))
    place = lambda x: F.ascii(x) % 128 + 1
    letters = F.transform(F.split(latin, ""), lambda x: F.when(F.ascii(x).between(FIRST, LAST), F.element_at(table, place(x))).otherwise(x))
    indic = latin.rlike(f"[{chr(FIRST)}-{chr(LAST)}]")
    return F.when(c.rlike(r"[^\x00-\x7F]"), F.when(indic, F.array_join(letters, "")).otherwise(latin)).otherwise(c)
