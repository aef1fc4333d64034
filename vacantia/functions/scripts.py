"""Locations in other scripts, written in Latin letters.

Letters are read by small tables for alphabets, by their Unicode names for syllabaries and Indic letters (`KATAKANA LETTER
TO` is `to`), and by arithmetic for Hangul. Chinese characters have no reading of their own: `readings` gives those that
a user knows, and all others stay.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The scripts that are not Latin here.
OTHER = r"[\p{IsCyrillic}\p{IsGeorgian}\p{IsGreek}\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsHangul}\p{IsArabic}\p{IsHebrew}\p{IsDevanagari}\p{IsThai}]"

# Common romanizations of alphabets, letter by letter.
ALPHABETS: dict[str, str] = {
    "абвгдеёжзийклмнопрстуфхцчшщъыьэюяіїєґўјљњћђџѓќѕ": "a b v g d e yo zh z i y k l m n o p r s t u f kh ts ch sh shch _ y _ e yu ya i yi ye g u j lj nj c dj dz gj kj dz",
    "αβγδεζηθικλμνξοπρσςτυφχψω": "a b g d e z i th i k l m n x o p r s s t y f ch ps o",
    "აბგდევზთიკლმნოპჟრსტუფქღყშჩცძწჭხჯჰ": "a b g d e v z t i k l m n o p zh r s t u p k gh q sh ch ts dz ts ch kh j h",
    "אבגדהוזחטיכךלמםנןסעפףצץקרשת": "a b g d h v z kh t y k k l m m n n s _ p p ts ts k r sh t",
    "ابتثجحخدذرزسشصضطظعغفقكلمنهويىةءآأإؤئپچژگ": "a b t th j h kh d dh r z s sh s d t z _ gh f q k l m n h w y a h _ a a i u i p ch zh g",
}
LETTERS: dict[str, str] = {c: r.replace("_", "") for letters, read in ALPHABETS.items() for c, r in zip(letters, read.split(), strict=True)}
# The parts of a Hangul syllable, in the order Unicode counts them.
INITIALS = "g kk n d tt r m b pp s ss _ j jj ch k t p h".replace("_", "").split(" ")
VOWELS = "a ae ya yae eo e yeo ye o wa wae oe yo u wo we wi yu eu ui i".split()
FINALS = "_ k k k n n n t l k m l l l p l m p p t t ng t t k t p t".replace("_", "").split(" ")


def other_script(text: Column) -> Column:
    """Whether a text has letters of a script that isn't Latin."""
    return text.rlike(OTHER)


def _read(c: str, readings: dict[str, str]) -> str:
    if c in readings:
        return readings[c]
    low = c.lower()
    if low in LETTERS:
        return LETTERS[low].capitalize() if c != low else LETTERS[low]
    if "가" <= c <= "힣":
        n = ord(c) - ord("가")
        return INITIALS[n // 588] + VOWELS[n % 588 // 28] + FINALS[n % 28]
    parts = unicodedata.normalize("NFD", c)
    if len(parts) > 1 and parts[0].lower() in LETTERS:
        return _read(parts[0], readings)
    name = unicodedata.name(c, "")
    if m := re.fullmatch(r"(?:HIRAGANA|KATAKANA) LETTER (?:SMALL )?([A-Z]+)", name):
        return m[1].lower()
    if m := re.fullmatch(r"DEVANAGARI (?:LETTER|VOWEL SIGN) ([A-Z]+)", name):
        return m[1].lower()
    if m := re.fullmatch(r"THAI CHARACTER ([A-Z]+)O(?: [A-Z]+)+", name):
        return m[1].lower()
    if m := re.fullmatch(r"THAI CHARACTER SARA ([A-Z]+)(?: .*)?", name):
        return m[1].lower()
    if "SIGN VIRAMA" in name or unicodedata.category(c) == "Mn" and not name.startswith("COMBINING"):
        return ""
    return c


_ODD = re.compile("[Ͱ-᳿⺀-鿿가-퟿豈-﫿]")


def in_latin(text: str | None, readings: dict[str, str] | None = None) -> str | None:
    """A text in Latin letters, with capitals where words begin; texts that are Latin already and have no back-tick stay."""
    if not text:
        return text
    if _ODD.search(text):
        plain = "".join(_read(c, readings or {}) for c in text).strip()
    elif "`" in text:
        plain = text
    else:
        return text
    plain = plain.replace("`", "").replace("’", "'")
    # Apostrophes between letters are sounds, but for a possessive's.
    plain = re.sub(r"(?<=[A-Za-z])'(?!s\b)(?=[A-Za-z])", "", plain)
    plain = re.sub(r"\s{2,}", " ", plain).strip()
    return re.sub(r"(?:(?<=[\s,\-/&])|^)[a-z]", lambda m: m.group().upper(), plain)


def romanized(rows: DataFrame, column: str, to: str, readings: dict[str, str] | None = None) -> DataFrame:
    """`rows` with the column `to`: another column's texts in Latin letters. Meant for distinct texts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(**{to: [in_latin(t, readings) for t in batch[column]]})

    return rows.mapInPandas(run, rows.withColumn(to, F.col(column).cast("string")).schema)
