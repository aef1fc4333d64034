"""License scans by a positional index of rare words.

Templates are short license notices and fixed phrases. The documents' frequencies of the templates' words, counted over all
documents in one pass, give IDFs. The index holds postings, word -> (template, position), of each template's words of
highest IDF, its anchors: one for a phrase; for a notice as many as it takes that the others, with the heaviest anchor,
stay below LEAST_SHARE of its weight. So no text can reach that share without two anchors.

For each file its indexed words are looked up from the highest IDF down. A word at place p whose posting is (t, q) puts the
start of t at p - q. Postings are intersected by these starts:

* A phrase matches where all its words agree with a start; every match holds the phrase's anchor, so none is lost.
* A notice is a candidate at starts that two of its anchors propose, SHIFT words apart at most. Its score is the greatest
  IDF-weighted share of its words that agree with such a start. It is labelled where the score reaches LEAST_SHARE and one
  of its mandatory key phrases stands in the text.

What is sent to tasks has the size of the templates; the frequencies that reach the driver have at most one row for each
word of the index. Other templates can be given, or read from a table of at most MOST_TEMPLATES rows.

Defined cases: null texts count as empty; the words of one text are held by a task, whatever its length; equal rows are
scanned each; an empty table gives an empty result; other columns are left out. `score` is 1 where a base phrase matches,
else the best among the notices, 0 without a candidate.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import named

# The base phrases and their labels.
PHRASES: dict[str, str] = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

# Notices (their usual words) and the key phrases of which one must stand in the text.
NOTICES: dict[str, tuple[str, tuple[str, ...]]] = {
    "mit": (
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
        ("permission is hereby granted free of charge",),
    ),
    "apache-2": ("licensed under the apache license version 2 0 the license", ("apache license version 2", "apache license 2")),
    "gpl-3": ("this work is licensed under the gnu general public license version 3", ("gnu general public license version 3", "gpl version 3", "gpl v3")),
    "gpl-2": ("this work is licensed under the gnu general public license version 2", ("gnu general public license version 2", "gpl version 2", "gpl v2")),
    "lgpl": ("licensed under the gnu lesser general public license", ("gnu lesser general public license",)),
    "agpl-3": ("licensed under the gnu affero general public license version 3", ("gnu affero general public license",)),
    "mpl-2": ("this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    "bsd": (
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
        ("redistribution and use in source and binary forms",),
    ),
    "cc-by": ("licensed under a creative commons attribution 4 0 international license", ("creative commons attribution",)),
    "cc-by-nc": ("licensed under cc by nc 4 0", ("cc by nc",)),
    "cc-by-sa": ("licensed under cc by sa 4 0", ("cc by sa",)),
    "cc0": ("released into the public domain under cc0 1 0 universal", ("cc0 1 0 universal",)),
    "unlicense": ("this is free and unencumbered software released into the public domain", ("free and unencumbered software",)),
    "isc": ("permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("permission to use copy modify",)),
    "zlib": (
        "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software",
        ("in no event will the authors be held liable",),
    ),
    "boost": ("distributed under the boost software license version 1 0", ("boost software license",)),
    "epl-2": ("this program and the accompanying materials are made available under the terms of the eclipse public license 2 0", ("eclipse public license",)),
    "eupl": ("licensed under the european union public licence eupl", ("european union public licence",)),
    "ofl": ("this font software is licensed under the sil open font license version 1 1", ("sil open font license",)),
    "artistic-2": ("this program is free software you may use and redistribute it under the terms of the artistic license 2 0", ("artistic license 2", "artistic license version 2")),
    "wtfpl": ("do what the fuck you want to public license", ("do what the fuck you want to public license",)),
    "gfdl": ("permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license", ("gnu free documentation license",)),
    "cc-by-nc-sa": ("licensed under cc by nc sa 4 0", ("cc by nc sa",)),
    "cc-by-nd": ("licensed under cc by nd 4 0", ("cc by nd",)),
}
LEAST_SHARE = 0.6
#: Words by which parts of a notice may be shifted against each other.
SHIFT = 4
MOST_TEMPLATES = 10_000

#: Bytes that belong to no word become spaces, A-Z become a-z.
_TABLE = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))


def words(text: str | None) -> list[bytes]:
    """Words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` of the text with A-Z lower-cased."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()


@dataclass
class Template:
    """Words by number, their IDFs, the anchors' positions; `label` and, for a notice, its key phrases."""

    label: str
    ids: list[int]
    idf: list[float]
    base: bool
    anchors: list[int] = field(default_factory=list)
    keys: list[list[int]] = field(default_factory=list)

    def most(self, by: dict[int, np.ndarray]) -> float:
        """A bound of the share that a file with these words can have: all of them, wherever they stand."""
        return sum((w for x, w in zip(self.ids, self.idf, strict=True) if x in by), 0.0) / sum(self.idf)


def _anchors(idf: list[float], base: bool) -> list[int]:
    """Positions of the words of highest IDF: as many as the module's text says."""
    order = sorted(range(len(idf)), key=lambda q: (-idf[q], q))
    if base:
        return order[:1]
    n, left = 1, sum(idf) - idf[order[0]]
    while n < len(order) and left + idf[order[0]] >= LEAST_SHARE * sum(idf) - 1e-9:
        left -= idf[order[n]]
        n += 1
    return order[:n]


class Index:
    """Templates, and postings of their anchors: for each word the templates and positions where it stands."""

    def __init__(self, phrases: dict[str, str], notices: dict[str, tuple[str, tuple[str, ...]]], idf: dict[str, float] | None = None):
        self.number: dict[bytes, int] = {}
        weight = lambda w: (idf or {}).get(w.decode(), 1.0)
        of = lambda text: [self.number.setdefault(w, len(self.number)) for w in words(text)]
        self.templates: list[Template] = []
        postings: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for text, (label, keys, base) in [*((p, (x, (), True)) for p, x in phrases.items()), *((t, (x, k, False)) for x, (t, k) in notices.items())]:
            t = Template(label, of(text), [weight(w) for w in words(text)], base, keys=[of(k) for k in keys])
            t.anchors = _anchors(t.idf, base)
            for q in t.anchors:
                postings[t.ids[q]].append((len(self.templates), q))
            self.templates.append(t)
        self.postings = {w: np.array(x, np.int64) for w, x in postings.items()}
        spelled = {n: w for w, n in self.number.items()}
        self.rank = {w: (-weight(spelled[w]), w) for w in self.postings}

    def numbers(self, held: list[bytes]) -> np.ndarray:
        get = self.number.get
        return np.fromiter((get(w, -1) for w in held), np.int32, len(held))

    def proposed(self, by: dict[int, np.ndarray]) -> dict[int, list[tuple[np.ndarray, np.ndarray]]]:
        """For each template (starts, position of the anchor) that the file's indexed words propose, from the rarest word down:
        the templates come in the order of their rarest words, so those that the file is likely to hold come first."""
        out: dict[int, list[tuple[np.ndarray, np.ndarray]]] = defaultdict(list)
        for w in sorted(self.postings.keys() & by.keys(), key=self.rank.__getitem__):
            for t, q in self.postings[w].tolist():
                starts = by[w] - q
                out[t].append((starts, np.full(len(starts), q)))
        return out


def _places(ids: np.ndarray, starts: np.ndarray, phrase: list[int]) -> np.ndarray:
    """The starts at which all words of a phrase stand."""
    starts = starts[(starts >= 0) & (starts + len(phrase) <= len(ids))]
    for q, x in enumerate(phrase):
        starts = starts[ids[starts + q] == x]
    return starts


def _agreed(proposed: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Starts that two anchors propose, SHIFT words apart at most."""
    starts, anchors = (np.concatenate(x) for x in zip(*proposed, strict=True))
    order = np.lexsort((anchors, starts))
    starts, anchors = starts[order], anchors[order]
    good = np.zeros(len(starts), bool)
    # The nearest of another anchor on either side: runs of one anchor are skipped.
    run = np.concatenate([[0], np.cumsum(anchors[1:] != anchors[:-1])])
    first, last = np.searchsorted(run, run), np.searchsorted(run, run, side="right") - 1
    back, on = first > 0, last < len(starts) - 1
    good[back] |= starts[back] - starts[first[back] - 1] <= SHIFT
    good[on] |= starts[last[on] + 1] - starts[on] <= SHIFT
    return np.unique(starts[good])


def _share(by: dict[int, np.ndarray], t: Template, starts: np.ndarray) -> float:
    """Greatest IDF-weighted share of a notice's words around one of the starts."""
    if not len(starts):
        return 0.0
    total = np.zeros(len(starts))
    for q, x in enumerate(t.ids):
        if x in by:
            own = by[x] - q  # sorted, as places are
            at = np.searchsorted(own, starts - SHIFT)
            total += t.idf[q] * ((at < len(own)) & (own[np.minimum(at, len(own) - 1)] <= starts + SHIFT))
    return float(total.max() / sum(t.idf))


def scan_text(text: str | None, index: Index) -> tuple:
    """n_words, n_base, first_word, last_word, base_labels, labels, score."""
    held = words(text)
    ids = index.numbers(held)
    places = np.flatnonzero(ids >= 0)
    by: dict[int, np.ndarray] = {}
    if len(places):
        order = np.argsort(ids[places], kind="stable")
        numbers, cuts = np.unique(ids[places][order], return_index=True)
        by = dict(zip(numbers.tolist(), np.split(places[order], cuts[1:]), strict=True))
    n, first, last, base, more, score = 0, None, None, set(), set(), 0.0
    for at, proposed in index.proposed(by).items():
        t = index.templates[at]
        if t.base:
            if len(starts := _places(ids, proposed[0][0], t.ids)):
                n += len(starts)
                first = int(starts.min()) if first is None else min(first, int(starts.min()))
                last = int(starts.max()) if last is None else max(last, int(starts.max()))
                base.add(t.label)
                score = 1.0
        elif (bound := t.most(by)) <= score and bound < LEAST_SHARE:
            continue  # neither the score nor a label can come of it
        elif len(proposed) > 1 and (share := _share(by, t, _agreed(proposed))) > 0:
            score = max(score, share)
            if share >= LEAST_SHARE and any(len(_places(ids, by.get(k[0], np.zeros(0, np.int64)), k)) for k in t.keys):
                more.add(t.label)
    return len(held), n, first, last, ",".join(sorted(base)), ",".join(sorted(base | more)), min(score, 1.0)


def frequencies(docs: DataFrame, wanted: list[str], text: str = "text") -> DataFrame:
    """word and n: how many rows hold each of the wanted words, and how many rows there are under the empty word.

    Rows are summed in tasks first.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, counts = {w.encode() for w in wanted}, defaultdict(int)
        for batch in batches:
            counts[b""] += len(batch)
            for t in batch["_text"]:
                for w in known.intersection(words(t)):
                    counts[w] += 1
        yield pd.DataFrame({"word": pd.Series([w.decode() for w in counts], dtype=object), "n": np.fromiter(counts.values(), np.int64, len(counts))})

    return docs.select(named(text).cast("string").alias("_text")).mapInPandas(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def idf_weights(docs: DataFrame, wanted: list[str], text: str = "text") -> dict[str, float]:
    """IDF of each word of the index over all documents: at most one row for each word of the templates comes back."""
    found = {r["word"]: r["n"] for r in frequencies(docs, wanted, text).collect()}
    total = found.get("", 0)
    return {w: math.log((total + 1) / (found.get(w, 0) + 1)) + 1e-3 for w in wanted}


def read_notices(table: DataFrame) -> dict[str, tuple[str, tuple[str, ...]]]:
    """Notices from a table of label, text and keys (array of strings); a table of more than MOST_TEMPLATES rows is refused."""
    rows = table.select("label", "text", "keys").limit(MOST_TEMPLATES + 1).collect()
    if len(rows) > MOST_TEMPLATES:
        raise ValueError(f"more than {MOST_TEMPLATES} templates")
    return {r["label"]: (r["text"], tuple(r["keys"])) for r in rows if words(r["text"])}


def scan_licenses(docs: DataFrame, text: str = "text", phrases: dict[str, str] | None = None, notices: dict[str, tuple[str, tuple[str, ...]]] | None = None) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score of each row."""
    phrases, notices = phrases or PHRASES, notices or NOTICES
    idf = idf_weights(docs, sorted(w.decode() for w in Index(phrases, notices).number), text)
    index = Index(phrases, notices, idf)
    columns = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = pd.DataFrame([scan_text(t, index) for t in batch["_text"]], columns=columns)
            yield out.assign(doc_id=batch["_id"].astype("Int64"), first_word=out["first_word"].astype("Int64"), last_word=out["last_word"].astype("Int64"), score=out["score"].astype(float))[["doc_id", *columns]]

    rows = docs.select(F.col("doc_id").cast("long").alias("_id"), named(text).cast("string").alias("_text"))
    return rows.mapInPandas(run, "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")


def op9_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))
