"""Text helpers that behave alike in Spark and in the SQL the queries are checked with.

Patterns are written once, with `\\b` as the edge of an ASCII word. Java's own `\\b` knows other letters too, so it is
spelled out for Spark.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_IN, _OUT = "[A-Za-z0-9_]", "[^A-Za-z0-9_]"
EDGE = rf"(?:(?<={_IN})(?!{_IN})|(?<!{_IN})(?={_IN}))"
SPACE = r"[\s\x{00A0}\x{FEFF}]"


def spelled(pattern: str) -> str:
    """A pattern for Spark."""
    return pattern.replace(r"\b", EDGE)


def has(text: Column, pattern: str) -> Column:
    """Whether a pattern occurs; null texts hold nothing."""
    return F.coalesce(text, F.lit("")).rlike(spelled(pattern))


def sql_has(text: str, pattern: str) -> str:
    """The same in SQL."""
    return f"regexp_matches(coalesce({text}, ''), '{quoted(pattern)}')"


def quoted(text: str) -> str:
    return text.replace("'", "''")


def replaced(text: Column, pattern: str, by: str = " ") -> Column:
    return F.regexp_replace(text, spelled(pattern), by)


def trimmed(text: Column) -> Column:
    """Without white space at either end, no-break spaces among it."""
    return F.regexp_replace(text, rf"^{SPACE}+|{SPACE}+$", "")


def sql_trimmed(text: str) -> str:
    return rf"regexp_replace({text}, '^{SPACE}+|{SPACE}+$', '', 'g')"


def without_tags(text: Column) -> Column:
    """Markup tags become spaces, and runs of white space one."""
    return trimmed(F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"<[^>]*>", " "), rf"{SPACE}+", " "))


def any_of(*words: str) -> str:
    """A pattern for any of these words or phrases, at word edges; a space stands for a run of white space."""
    return r"\b(?:" + "|".join(w.replace(" ", r"\s+") for w in words) + r")\b"


def words_found(text: Column, words: dict[str, tuple[str, ...]], edge: str = "a-z0-9") -> Column:
    """What the words in a text stand for, with repeats: one pass of one alternation, and a map from words to meanings.

    A word counts where no character of the class `edge` stands beside it. The longest word at a place is taken, and it
    stands for all that the words inside it stand for.
    """
    inside = lambda w, whole: re.search(rf"(?:^|[^a-z0-9]){literal(w)}(?:[^a-z0-9]|$)", whole)
    meaning = {whole: sorted({m for w, held in words.items() if inside(w, whole) for m in held}) for whole in words}
    longest_first = "|".join(literal(w) for w in sorted(words, key=lambda w: (-len(w), w)))
    pattern = rf"(?<![{edge}])(?=({longest_first})(?![{edge}]))"
    # One expression as text: hundreds of literals, one by one, take the driver seconds.
    table = F.expr("map(" + ", ".join(f"{sql_literal(w)}, array({', '.join(map(sql_literal, held))})" for w, held in meaning.items()) + ")")
    return F.flatten(F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), lambda w: F.element_at(table, w)))


def sql_literal(text: str) -> str:
    """A string literal of Spark SQL."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def literal(text: str) -> str:
    """A pattern for exactly this text."""
    return re.sub(r"([.^$*+?{}\[\]\\|()])", r"\\\1", text)
