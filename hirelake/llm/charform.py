"""Visually identical text with different characters (problem 4): one consistent form.

The form of a text: width and style variants and joined forms become their plain characters
(compatibility normalisation), default-ignorable characters go, every space other than the line
break becomes U+0020, letters with separate accents are composed, and look-alike letters inside a
Latin word become the Latin letter. Super- and subscripts, fractions, ellipses, quotes, dashes and
words wholly in another script stay. The key of a text is its form in full case folding.

The work is done once per distinct value of an Arrow batch, and a pattern evaluated in the JVM keeps
back all values that hold only characters already in form, so plain texts never reach Python.

Defined results: null stays null, "" stays ""; texts of any length are handled whole; the form of a
form is itself; repeated rows and keys are kept; extra columns pass through untouched.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Letters of other scripts, and phonetic letters, that look like a Latin one.
LOOK_ALIKES = {
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O",
    "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X", "α": "a", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p",
    "υ": "u", "χ": "x", "γ": "y", "ϲ": "c", "ϳ": "j",
    "А": "A", "В": "B", "Е": "E", "Ѕ": "S", "І": "I", "Ј": "J", "К": "K", "М": "M", "Н": "H", "О": "O",
    "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "Ү": "Y", "Ԛ": "Q", "Ԝ": "W", "а": "a", "в": "b",
    "е": "e", "ѕ": "s", "і": "i", "ј": "j", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c",
    "т": "t", "у": "y", "х": "x", "ү": "y", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "ӏ": "l", "Ӏ": "I",
    "ѵ": "v", "Ѵ": "V", "ɡ": "g", "ɑ": "a", "ɩ": "i", "ɪ": "I", "ʋ": "v", "ᴀ": "a", "ᴄ": "c", "ᴏ": "o",
    "ᴜ": "u", "ᴠ": "v", "ᴡ": "w", "ᴢ": "z", "օ": "o", "ս": "u", "հ": "h", "ո": "n", "ց": "g", "Տ": "S",
    "Օ": "O", "Ս": "U",
}

# Kinds of compatibility decomposition that are a variant of plain characters.
_VARIANTS = {"<wide>", "<narrow>", "<font>", "<circle>", "<square>", "<small>", "<compat>",
             "<initial>", "<medial>", "<final>", "<isolated>", "<vertical>"}
# Characters with such a decomposition that are right as they are.
_RIGHT = set("…‥․´¨¯¸˘˙˚˛˜˝µ‗′″‴⁗ℵ")
# Default-ignorable ranges (Unicode, DerivedCoreProperties).
_IGNORABLE = [(0x00AD, 0x00AD), (0x034F, 0x034F), (0x061C, 0x061C), (0x115F, 0x1160), (0x17B4, 0x17B5),
              (0x180B, 0x180F), (0x200B, 0x200F), (0x202A, 0x202E), (0x2060, 0x206F), (0x3164, 0x3164),
              (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF), (0xFFA0, 0xFFA0), (0xFFF0, 0xFFF8), (0x1BCA0, 0x1BCA3),
              (0x1D173, 0x1D17A), (0xE0000, 0xE0FFF)]

#: Characters that are in form wherever they stand; every other character gets a text examined.
PLAIN_CLASS = r"\n\r\x20-\x7e\xa1-\xac\xae-ıĴ-ľŁ-ňŊ-ž‐‒-‖‘-‣…‰-※←-⇿─-➿"
#: Characters whose full case folding is their lower case, whatever stands beside them.
_LOWERED = r"\n\r\t\x20-\x7e\xa0-\xb4\xb6-\xde\xe0-\xff‐-‧‰-⁞←-⇿─-➿"
_EXAMINE = re.compile(f"[^{PLAIN_CLASS}]")
_LETTERS = re.compile(r"[^\W\d_]+")
_LATIN = re.compile(r"[A-Za-zÀ-ɏ]")
_ALIKE = str.maketrans(LOOK_ALIKES)
_ALIKE_SET = frozenset(LOOK_ALIKES)


class _Forms(dict):
    """code point -> what it becomes on its own."""

    def __missing__(self, code: int):
        char = chr(code)
        kind = unicodedata.decomposition(char).partition(" ")[0]
        if any(low <= code <= high for low, high in _IGNORABLE):
            form = ""
        elif char == "\t" or unicodedata.category(char) == "Zs":
            form = " "
        elif kind in _VARIANTS and char not in _RIGHT:
            form = unicodedata.normalize("NFKC", char)
        else:
            form = char
        self[code] = form
        return form


_FORMS = _Forms()


def _latin_word(match: re.Match) -> str:
    word = match.group()
    if not _ALIKE_SET.isdisjoint(word) and _LATIN.search(word):
        return word.translate(_ALIKE)
    return word


def form(text: str) -> str:
    if text.isascii() and "\t" not in text or not _EXAMINE.search(text):
        return text
    text = unicodedata.normalize("NFC", text.translate(_FORMS))
    return text if text.isascii() else _LETTERS.sub(_latin_word, text)


def fold(text: str) -> str:
    return form(text).casefold()


@F.pandas_udf(T.StringType())
def _forms(values: pd.Series) -> pd.Series:
    codes, distinct = pd.factorize(values, use_na_sentinel=True)
    done = [form(v) for v in distinct]
    return pd.Series([None if c < 0 else done[c] for c in codes], dtype=object)


def examined(value: Column) -> Column:
    """True where a text holds a character that may have to change."""
    return value.rlike(f"[^{PLAIN_CLASS}]")


def form_of(value: Column) -> Column:
    """The form of a text column; null for null."""
    return F.coalesce(_forms(F.when(examined(value), value)), value)


@F.pandas_udf(T.StringType())
def _folded(values: pd.Series) -> pd.Series:
    codes, distinct = pd.factorize(values, use_na_sentinel=True)
    done = [v.casefold() for v in distinct]
    return pd.Series([None if c < 0 else done[c] for c in codes], dtype=object)


def key_of(formed: Column) -> Column:
    """Full case folding of a text already in form; lower case does it for texts in ASCII letters and common ones with accents."""
    return F.coalesce(_folded(F.when(formed.rlike(f"[^{_LOWERED}]"), formed)), F.lower(formed))


def normalise(df: DataFrame, columns: list[str]) -> DataFrame:
    """df with <column>_form, <column>_key and <column>_changed for each of the columns."""
    out = df.withColumns({f"{c}_form": form_of(F.col(c)) for c in columns})
    return out.withColumns(
        {f"{c}_key": key_of(F.col(f"{c}_form")) for c in columns}
        | {f"{c}_changed": F.coalesce(F.col(f"{c}_form") != F.col(c), F.lit(False)) for c in columns}
    )


def changed_fields(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """(key, field_name, form) of every field that isn't in form."""
    fields = F.array(*(F.struct(F.lit(c).alias("field_name"), F.col(c).alias("value")) for c in columns))
    long = df.select(key, F.inline(fields)).where(examined(F.col("value")))
    return (
        long.withColumn("form", _forms("value"))
        .where(F.col("form") != F.col("value"))
        .select(key, "field_name", "form")
    )
