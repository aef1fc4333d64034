"""Spelling variants by anagram hashing: words that one inserted, deleted or replaced letter parts, and their commonest forms.

Every letter has a value, the fifth power of its code point, and a word's key is the sum of its letters' values: the same
for all orders of the same letters. Adding or removing a letter moves the key by that letter's value, replacing one by the
difference of two. So instead of trying all values, each word is put under its own key and, for each of its letters c,
under its key less c's value: a word that has c more than another meets it there, and so do two words of which one has c
where the other has d. Equal integers are brought together by a shuffle and a sort, and the order of letters is verified
among the words of one key only: without the letter at place i both words of a replacement read alike, and so do the
longer word and the shorter one of an insertion. Links are counted by such a remainder, not listed: each word's number of
near words and the best of them come from the counts and the two best of those that share it.

A key holds the words that are made of the same letters (or one letter more or fewer), whatever the number of documents;
a word of L letters is shipped once for each distinct letter, 90 times at most.

Forms lead to words at least twice as frequent, so they end after log2(n) steps; roots are found by doubling steps.

Letters are A-Z, a-z and U+00C0 to U+00FF, all of Latin-1, so a byte is a letter here.

Defined cases: null, empty and letterless texts have no words; a null id is written as nothing before the colon; ids are
whole numbers; equal rows are counted each; ties between near words go to the first in code-point order; a very long run
of letters is a word like any other (its remainders are told apart by hashes and compared letter by letter where these
agree); an empty table gives an empty result; other columns are left out.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, named
from .importance import crc_sql

#: Lower-case A-Z, keep the other letters; all else parts runs.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 0xC0 else 32 for c in range(256))
#: One in so many runs of a document loses a letter.
NOISE = 97
#: A letter's part of a key.
POWERS = [c**5 for c in range(256)]
#: Words that a task counts before it hands the counts on.
MAX_HELD = 500_000
#: Remainders of longer words are told apart by hashes.
LONG = 256
_MOD, _BASE = (1 << 61) - 1, 911_382_323
#: Whole numbers of 64 bits.
_WRAP = (1 << 64) - 1


def runs_in(text: str | None) -> list[bytes]:
    """Maximal runs of letters, lower-cased, in Latin-1."""
    return text.encode("latin-1", "replace").translate(_FOLD).split() if text else []


def noised(doc: bytes, run: bytes, noise: int = NOISE) -> bytes:
    """The run, or what is left of it where the hash of document and run says that a letter goes."""
    h = crc32(run if run.isascii() else run.decode("latin-1").encode(), crc32(doc + b":"))
    if h % noise:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def word_counts(docs: DataFrame, least_letters: int, least_count: int, noise: int = NOISE) -> DataFrame:
    """(word, n): results of the runs of `docs` (doc_id, text)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: Counter[bytes] = Counter()

        def out() -> pd.DataFrame:
            frame = pd.DataFrame({"word": [w.decode("latin-1") for w in held], "n": np.fromiter(held.values(), np.int64, len(held))})
            held.clear()
            return frame

        for batch in batches:
            for doc_id, text in zip(batch["doc_id"].astype("Int64"), batch["text"], strict=True):
                doc = b"" if doc_id is pd.NA else b"%d" % doc_id
                for word, n in Counter(w for w in runs_in(text) if len(w) >= least_letters).items():
                    left = noised(doc, word, noise)
                    if len(left) >= least_letters:
                        held[left] += n
                if len(held) > MAX_HELD:
                    yield out()
        if held:
            yield out()

    return docs.mapInPandas(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def _signed(key: int) -> int:
    key &= _WRAP
    return key - (key >> 63 << 64)


def keyed(words: DataFrame) -> DataFrame:
    """(key, letter, word, n): each word under its own key (letter 0) and under its key less each of its letters."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), 5_000):
                keys, letters, found, counts = [], [], [], []
                for word, n in zip(batch["word"][at : at + 5_000], batch["n"][at : at + 5_000], strict=True):
                    held = word.encode("latin-1")
                    whole = sum(map(POWERS.__getitem__, held))
                    own = sorted(set(held))
                    keys.append(_signed(whole))
                    keys += [_signed(whole - POWERS[c]) for c in own]
                    letters.append(0)
                    letters += own
                    found += [word] * (len(own) + 1)
                    counts += [n] * (len(own) + 1)
                yield pd.DataFrame({"key": np.array(keys, np.int64), "letter": np.array(letters, np.int16), "word": found, "n": np.array(counts, np.int64)})

    return words.mapInPandas(run, "key long, letter short, word string, n long")


def remainders(word: str, letter: str) -> list[tuple[int, object]]:
    """(place, remainder) for each place of the letter: equal remainders stand for equal strings, by hash if long."""
    places = [i for i, c in enumerate(word) if c == letter]
    if len(word) <= LONG:
        return [(i, word[:i] + word[i + 1 :]) for i in places]
    # Hashes of all beginnings, from which that of any remainder follows: hash(ab) = hash(a) * base^len(b) + hash(b).
    before, power = [0], [1]
    for c in word:
        before.append((before[-1] * _BASE + ord(c)) % _MOD)
        power.append(power[-1] * _BASE % _MOD)
    n = len(word)
    out = []
    for i in places:
        after = (before[n] - before[i + 1] * power[n - i - 1]) % _MOD
        out.append((i, (n - 1, (before[i] * power[n - i - 1] + after) % _MOD)))
    return out


def _same(a: str, i: int, b: str, j: int | None) -> bool:
    """Whether a without place i is b without place j (or all of b)."""
    other = b if j is None else b[:j] + b[j + 1 :]
    return a[:i] + a[i + 1 :] == other


class Links:
    """Number of near words and the best of them, for the words of one key: `found[word]` is [number, -n, word]."""

    def __init__(self):
        self.found: dict[str, list] = {}

    def add(self, word: str, number: int, best: tuple[int, str]) -> None:
        held = self.found.get(word)
        if held is None:
            self.found[word] = [number, *best]
        else:
            held[0] += number
            if best < (held[1], held[2]):
                held[1:] = best


def _classes(members: list[tuple[str, int, int]]) -> list[list[tuple[str, int, int]]]:
    """Members (word, n, place) of one hash by their real remainders; short words have no collisions."""
    if len(members[0][0]) <= LONG:
        return [members]
    out: list[list[tuple[str, int, int]]] = []
    for m in members:
        for group in out:
            if _same(m[0], m[2], group[0][0], group[0][2]):
                group.append(m)
                break
        else:
            out.append([m])
    return out


def linked(letters: list[int], words: list[str], counts: list[int]) -> dict[str, list]:
    """The links among words of one key: those under their own key (letter 0) and those with one letter more."""
    links = Links()
    whole = {w: n for c, w, n in zip(letters, words, counts, strict=True) if c == 0}
    hashed = {remainders(w + "\0", "\0")[0][1]: w for w in whole} if any(len(w) >= LONG for w in whole) else {}
    by_rest: dict[tuple, list[tuple[str, int, int]]] = defaultdict(list)
    for c, word, n in zip(letters, words, counts, strict=True):
        if c == 0:
            continue
        met: set[str] = set()
        for place, rest in remainders(word, chr(c)):
            by_rest[place, rest].append((word, n, place))
            short = rest if isinstance(rest, str) else hashed.get(rest)
            if short in whole and short not in met and (isinstance(rest, str) or _same(word, place, short, None)):
                met.add(short)
                links.add(word, 1, (-whole[short], short))
                links.add(short, 1, (-n, word))
    for members in by_rest.values():
        if len(members) > 1:
            for group in _classes(members):
                if len(group) > 1:
                    first, second = sorted((-n, w) for w, n, _ in group)[:2]
                    for w, _, _ in group:
                        links.add(w, len(group) - 1, second if w == first[1] else first)
    return links.found


def near_words(rows: DataFrame) -> DataFrame:
    """(word, n_near, best as struct of -n and word) of all words that are near some other; `rows` as from `keyed`."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # Sorted by key: a key's rows stand together, and the last key of a batch may go on in the next.
        rest: pd.DataFrame | None = None
        for batch in batches:
            if batch.empty:
                continue
            batch = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
            keys = batch["key"].to_numpy()
            last = int(np.searchsorted(keys, keys[-1]))
            rest = batch[last:]
            yield from links_of(batch[:last])
        if rest is not None:
            yield from links_of(rest)

    def links_of(batch: pd.DataFrame) -> Iterator[pd.DataFrame]:
        if batch.empty:
            return
        keys = batch["key"].to_numpy()
        starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        ends = np.r_[starts[1:], len(keys)]
        several = ends - starts > 1
        letters, words, counts = batch["letter"].tolist(), batch["word"].tolist(), batch["n"].tolist()
        found = []
        for a, b in zip(starts[several].tolist(), ends[several].tolist(), strict=True):
            found += [(w, *held) for w, held in linked(letters[a:b], words[a:b], counts[a:b]).items()]
        if found:
            yield pd.DataFrame(found, columns=["word", "n_near", "less", "best"])

    sorted_rows = rows.repartition("key").sortWithinPartitions("key")
    pairs = sorted_rows.mapInPandas(run, "word string, n_near long, less long, best string")
    return pairs.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct("less", "best")).alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): the last word that forms (word, form) lead to. Each round doubles the steps that a row has gone."""
    rows = checkpointed(forms.select("word", F.col("form").alias("root")))
    while True:
        on = rows.select(F.col("word").alias("root"), F.col("root").alias("_on"))
        rows = checkpointed(rows.join(on, "root", "left").select("word", F.coalesce("_on", "root").alias("root"), F.col("_on").isNotNull().alias("_moved")))
        moved = rows.where("_moved").limit(1).count()
        rows = rows.drop("_moved")
        if not moved:
            return rows


def spelling_variants(docs: DataFrame, least_letters: int = 5, least_count: int = 3, noise: int = NOISE, id: str = "doc_id", text: str = "text") -> DataFrame:
    """word, form, root, n, n_near and form_n of every word of `docs`."""
    slim = docs.select(named(id).cast("long").alias("doc_id"), named(text).cast("string").alias("text"))
    words = checkpointed(word_counts(slim, least_letters, least_count, noise))
    near = near_words(keyed(words))
    likely = -F.col("best.less") >= 2 * F.col("n")
    rows = checkpointed(
        words.join(near, "word", "left").select(
            "word",
            F.when(likely, F.col("best.best")).alias("form"),
            "n",
            F.coalesce("n_near", F.lit(0)).alias("n_near"),
            F.when(likely, -F.col("best.less")).alias("form_n"),
        )
    )
    ends = roots(rows.where("form IS NOT NULL"))
    return rows.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP12_SQL = rf"""
WITH RECURSIVE runs AS (
  SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS d,
    unnest(regexp_extract_all(translate("text", 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{{00C0}}-\x{{00FF}}]+')) AS run
  FROM documents
), distinct_runs AS (SELECT d, run, count(*) AS n FROM runs WHERE length(run) >= 5 GROUP BY d, run),
hashed AS (SELECT run, n, {crc_sql("d || ':' || run")} AS h FROM distinct_runs),
results AS (
  SELECT n, CASE WHEN h % 97 = 0 THEN left(run, CAST(h % length(run) AS INT)) || substr(run, CAST(h % length(run) AS INT) + 2) ELSE run END AS word
  FROM hashed
), words AS (
  SELECT word, CAST(sum(n) AS BIGINT) AS n FROM results WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3
), cut AS (
  SELECT word, n, i, left(word, CAST(i AS INT) - 1) || substr(word, CAST(i AS INT) + 1) AS rest
  FROM (SELECT word, n, unnest(generate_series(1, length(word))) AS i FROM words)
), longer AS (SELECT DISTINCT c.word AS a, c.n AS an, w.word AS b, w.n AS bn FROM cut c JOIN words w ON w.word = c.rest),
near AS (
  SELECT a.word, b.word AS other, b.n FROM cut a JOIN cut b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION ALL SELECT a, b, bn FROM longer
  UNION ALL SELECT b, a, an FROM longer
), best AS (
  SELECT word, count(*) AS n_near, arg_min(other, (-n, other)) AS other, max(n) AS other_n FROM near GROUP BY word
), forms AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 2 * w.n THEN other END AS form, CASE WHEN other_n >= 2 * w.n THEN other_n END AS form_n
  FROM words w LEFT JOIN best USING (word)
), steps AS (
  SELECT word, word AS at FROM forms
  UNION ALL SELECT s.word, f.form FROM steps s JOIN forms f ON f.word = s.at WHERE f.form IS NOT NULL
), ends AS (SELECT s.word, s.at AS root FROM steps s JOIN forms f ON f.word = s.at WHERE f.form IS NULL)
SELECT word, form, root, n, n_near, form_n FROM forms JOIN ends USING (word)
"""
