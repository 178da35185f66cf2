"""Problem 6: visually identical text with different characters.

``looks`` maps a spelling to one form: invisible characters go, kinds of spaces become one, width variants, contextual letter
shapes and ligatures are resolved, letters and digits of other scripts that look alike in their place are replaced, marks are
composed and ordered. SQL then groups the mapped values under an accent- and case-sensitive Unicode collation, picks one member
of each class and joins it back. The collation decides about letters and marks only: it also takes for equal what does show,
digits of several numeral systems, signs and the stretching stroke, so what is no letter or mark is a second key beside it.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.functions.cut import cut, sized_join

# Letters of other scripts that look like a Latin letter.
LATIN_TWINS = {
    "А": "A", "В": "B", "С": "C", "Е": "E", "Н": "H", "І": "I", "Ј": "J", "К": "K", "М": "M", "О": "O", "Р": "P", "Ԛ": "Q", "Ѕ": "S", "Т": "T",
    "Ԝ": "W", "Х": "X", "Ү": "Y", "Ԍ": "G", "а": "a", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "ӏ": "l", "о": "o", "р": "p",
    "ԛ": "q", "ѕ": "s", "ѵ": "v", "ԝ": "w", "х": "x", "у": "y", "У": "Y",
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "ο": "o", "ν": "v", "ϲ": "c", "ϳ": "j", "Ϲ": "C", "Ϳ": "J", "օ": "o", "ս": "u", "հ": "h", "ո": "n", "ց": "g", "ՙ": "ʿ",
    "α": "a", "ρ": "p", "Ꭺ": "A", "Ᏼ": "B", "Ꮯ": "C", "Ꭰ": "D", "Ꭼ": "E", "Ꮐ": "G", "Ꮋ": "H", "Ꭻ": "J", "Ꮶ": "K", "Ꮮ": "L", "Ꮇ": "M", "Ꮲ": "P", "Ꮪ": "S", "Ꭲ": "T",
    "Ꮩ": "V", "Ꮃ": "W", "Ꮓ": "Z", "Ⅰ": "I", "Ⅴ": "V", "Ⅹ": "X", "Ⅼ": "L", "Ⅽ": "C", "Ⅾ": "D", "Ⅿ": "M", "ⅰ": "i", "ⅴ": "v", "ⅹ": "x", "ⅼ": "l", "ⅽ": "c", "ⅾ": "d", "ⅿ": "m",
    "‐": "-", "‑": "-",
}
# Persian digits drawn as the Arabic-Indic digits of the same value (4, 5 and 6 have other shapes).
DIGIT_TWINS = {"۰": "٠", "۱": "١", "۲": "٢", "۳": "٣", "۷": "٧", "۸": "٨", "۹": "٩"}
# Invisible characters that are no format characters.
UNSEEN = "͏ᅟᅠ឴឵ㅤﾠ"
LIGATURES = "ĲĳǄǅǆǇǈǉǊǋǌǱǲǳ"
SHAPES = ("<initial>", "<medial>", "<final>", "<isolated>", "<wide>", "<narrow>", "<font>")
HAMZA_ABOVE = "ٔ"


def _table() -> dict[int, str | None]:
    out: dict[int, str | None] = {}
    for cp in range(0x20000):
        if 0xD800 <= cp < 0xE000:
            continue
        c = chr(cp)
        kind, parts = unicodedata.category(c), unicodedata.decomposition(c)
        if kind == "Cf" or c in UNSEEN or 0xFE00 <= cp <= 0xFE0F:
            out[cp] = None
        elif kind in ("Zs", "Zl", "Zp") or c in "\t\n\r\v\f\x85":
            out[cp] = " "
        elif kind == "Cc":
            out[cp] = None
        elif parts.startswith(SHAPES) or c in LIGATURES or 0xFB00 <= cp <= 0xFB17 and parts.startswith("<compat>"):
            out[cp] = unicodedata.normalize("NFKC", c)
    for cp in range(0xE0000, 0xE01F0):
        out[cp] = None
    return out


TABLE = _table()
TWINS = str.maketrans(LATIN_TWINS | DIGIT_TWINS)
_PLAIN = re.compile(r"(?:[!-~]+(?: [!-~]+)*)?\Z")
_IN_PLACE = re.compile("[یىکە]")


def _in_place(s: str) -> str:
    """Arabic letters that look alike only where they stand: Farsi yeh has dots only if a letter follows, keheh has the shape
    of kaf only then, and ae is heh only at the end."""
    out = list(s)
    for i, c in enumerate(s):
        if c not in "یىکە":
            continue
        j = i + 1
        while j < len(s) and unicodedata.category(s[j]) == "Mn":
            j += 1
        joined = j < len(s) and s[j] != "ء" and (s[j] == "ـ" or unicodedata.bidirectional(s[j]) == "AL" and unicodedata.category(s[j]) == "Lo")
        if c == "ی":
            out[i] = "ي" if joined or HAMZA_ABOVE in s[i + 1 : j] else "ى"
        elif c == "ى" and HAMZA_ABOVE in s[i + 1 : j]:
            out[i] = "ي"
        elif c == "ک" and joined:
            out[i] = "ك"
        elif c == "ە" and not joined:
            out[i] = "ه"
    return "".join(out)


def looks(s: str | None) -> str | None:
    """The one form of all spellings that look like ``s``; None for None."""
    if s is None or _PLAIN.match(s):
        return s
    s = unicodedata.normalize("NFD", s.translate(TABLE)).translate(TWINS)
    if _IN_PLACE.search(s):
        s = _in_place(s)
    return unicodedata.normalize("NFC", s).strip(" ")


def look(column) -> Column:
    """``looks`` over a string column."""

    def mapped(s: pd.Series) -> pd.Series:
        return s.map(looks, na_action="ignore")

    return F.pandas_udf(mapped, "string")(column)


_CLASS = ["collated", "rest"]
#: What the collation tells apart: letters, but not modifier letters such as the stretching stroke, and marks, but not the
#: annotation signs that it skips.
COLLATED = r"[\p{Lu}\p{Ll}\p{Lt}\p{Lo}]|[\p{M}&&[^\u0610-\u061A\u06D6-\u06ED]]"


def _spelled(tokens: DataFrame) -> DataFrame:
    """(surface, look, collated, rest) of each distinct surface, with how many tokens (n) are written so. The mapping is the one
    step in Python, so its result is written once and read by all that follows."""
    seen = tokens.groupBy("surface").agg(F.count("*").alias("n"))
    mapped = cut(seen.withColumn("look", look("surface")))
    return mapped.select("surface", "n", "look", F.collate("look", "UNICODE").alias("collated"), F.regexp_replace("look", COLLATED, "").alias("rest"))


def _classes(spelled: DataFrame) -> DataFrame:
    """Each class under the collation, with its canonical member and the number of its spellings."""
    return spelled.groupBy(*_CLASS).agg(F.min_by("surface", F.struct(-F.col("n"), F.col("surface"))).alias("canonical"), F.count("*").alias("spellings"))


def _tokens(definitions: DataFrame) -> DataFrame:
    return definitions.select("id", "surface").filter("surface is not null").distinct()


def canonical_surfaces(definitions: DataFrame) -> DataFrame:
    """(id, surface, look, canonical) of every distinct token with a surface.

    ``look`` is the consistent form; ``canonical`` is the member of the class that most tokens are written with, the smallest
    of them on a tie. Null surfaces are left out; an empty or all-invisible surface has the look ''. Repeated rows count once.
    """
    tokens = _tokens(definitions)
    spelled = _spelled(tokens)
    named = spelled.join(_classes(spelled), _CLASS).select("surface", "look", "canonical")
    return tokens.join(named, "surface").select("id", "surface", "look", "canonical")


def lookalike_pairs(definitions: DataFrame) -> DataFrame:
    """(id_a, id_b), id_a < id_b: token ids whose surfaces look the same but differ as strings. Null ids are no tokens."""
    tokens = _tokens(definitions).filter("id is not null")
    spelled = _spelled(tokens)
    several = spelled.join(_classes(spelled).filter("spellings > 1").select(*_CLASS, "canonical"), _CLASS).select("surface", "canonical")
    t = cut(sized_join(tokens, cut(several), "surface", "inner", row_bytes=160))
    a, b = (t.select("canonical", F.col("id").alias(f"id_{x}"), F.col("surface").alias(f"s_{x}")) for x in "ab")
    return a.join(b, "canonical").filter("id_a < id_b and s_a <> s_b").select("id_a", "id_b").distinct()
