"""Ordered rewrites of phrases, as a table: leftmost, longest match in a trie of tokens, phase after phase.

Rules are rows (phase, phrase, by, whole). A phrase is a run of tokens, words or single signs; white space between them, the
kind of dash and the case don't matter. `whole` ones match a text as a whole only. In each phase a text is read once from
left to right; what has been put in is not read again before the next phase. A text costs its own length times the longest
phrase that it begins to match, however many rules there are.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RULES = "phase int, phrase string, by string, whole boolean"
_TOKEN = re.compile(r"\w+|[^\w\s]")
_DASHES = str.maketrans("–—−‐‑", "-----")

Rule = tuple[int, str, str, bool]


def tokens_of(text: str) -> list[str]:
    return _TOKEN.findall(text.translate(_DASHES).lower())


class Phrases:
    """The tries of all phases. Of equal phrases of a phase the first counts."""

    def __init__(self, rules: Iterable[Rule]):
        phases: dict[int, list[Rule]] = {}
        for rule in rules:
            phases.setdefault(rule[0], []).append(rule)
        self.phases = [self._trie(phases[p]) for p in sorted(phases)]

    @staticmethod
    def _trie(rules: list[Rule]) -> dict:
        root: dict = {}
        for _, phrase, by, whole in rules:
            node = root
            for token in tokens_of(phrase):
                node = node.setdefault(token, {})
            if node is not root:
                node.setdefault(bool(whole), by)  # tokens are strings, ends are truth values
        return root

    def rewrite(self, text: str) -> str:
        for trie in self.phases:
            text = self._pass(trie, text)
        return text

    @staticmethod
    def _pass(trie: dict, text: str) -> str:
        # Dashes are single characters, so places stay; lower case may be longer and is taken token by token.
        found = [(m.group().lower(), m.start(), m.end()) for m in _TOKEN.finditer(text.translate(_DASHES))]
        out, kept, i = [], 0, 0
        while i < len(found):
            node, end, by = trie, 0, None
            for j in range(i, len(found)):
                node = node.get(found[j][0])
                if node is None:
                    break
                if False in node:
                    end, by = j + 1, node[False]
                if True in node and i == 0 and j + 1 == len(found):
                    end, by = j + 1, node[True]
            if end:
                out += [text[kept : found[i][1]], by]
                kept, i = found[end - 1][2], end
            else:
                i += 1
        return "".join(out) + text[kept:]


def rewriter(rules: Iterable[Rule]) -> Callable[[str | Column], Column]:
    """A function of string columns; null stays null. It belongs behind `distinct`, so that each string is read once."""
    phrases = Phrases(rules)

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(phrases.rewrite, na_action="ignore")

    return run


def rules_of(table: DataFrame) -> list[Rule]:
    """Rules from a table of the user's: a configuration, which goes to every task."""
    return [tuple(r) for r in table.select("phase", "phrase", "by", "whole").orderBy("phase", "phrase", "by").collect()]


def sql_rewrite(text: str, rules: Iterable[Rule]) -> str:
    """The same in DuckDB, one expression after the other, longer phrases first: equal where matches don't overlap."""
    for _, phrase, by, whole in sorted(rules, key=lambda r: (r[0], -len(tokens_of(r[1])))):
        pattern = ""
        before = ""
        for token in tokens_of(phrase):
            word = token[0].isalnum() or token[0] == "_"
            gap = r"\s+" if before and word and (before[0].isalnum() or before[0] == "_") else r"\s*" if before else ""
            pattern += gap + ("[-–—]" if token == "-" else re.escape(token).replace("\\&", "&").replace("\\ ", " "))
            before = token
        first, last = tokens_of(phrase)[0], before
        edge = lambda t: r"\b" if t[0].isalnum() else ""
        pattern = rf"^\s*{pattern}\s*$" if whole else edge(first) + pattern + edge(last)
        text = f"regexp_replace({text}, '(?i){pattern.replace(chr(39), chr(39) * 2)}', '{by.replace(chr(39), chr(39) * 2)}', 'g')"
    return text
