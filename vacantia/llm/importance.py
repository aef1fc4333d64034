"""Target-distribution importance resampling: documents that look like a target corpus, by hashed word n-grams.

Two passes over the texts, each with word tries that live in one task. A trie's node stands for a run of words; it holds
the CRC-32 state of the run's bytes, which its children extend by one word, and a count (first pass) or the gain of the
state's bucket (second pass). Counts are added up by bucket whenever a trie has MAX_NODES nodes and at the end of the
task, so memory does not follow the vocabulary; Spark adds the tasks' buckets. The driver sees the two histograms, one
number a bucket, and makes of them a table of gains: the number of buckets is a parameter, whatever the input. The
second pass walks each document's runs through a trie whose nodes have their gains attached when they are made.

Documents are drawn without replacement by adding a Gumbel number, a hash of the seed and the id, to a document's weight
and taking the highest scores. Ranks come from a histogram of scores: whole numbers between two bounds (a thousand times
a logarithm of counts, so some 200,000 at most), and a window inside each score.

Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after A-Z are lower-cased; repeats count.

Defined cases: a null, empty or wordless text has no features and weight 0; a row without an id has a null score, is not
drawn and does not count among those that are drawn from; ids are whole numbers; equal rows are drawn each, in any order
among themselves; a very long text is one task's, its words held at once; an empty table, on either side, counts as no
features; columns other than those named are left out.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checkpointed, named

BUCKETS = 10_000
#: Nodes of one trie.
MAX_NODES = 1_000_000
#: ASCII but 0-9 and a-z parts words; A-Z become a-z.
_FOLD = bytes(c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


class Node(dict):
    """A run of words: its children by the next word, which are made when first asked for."""

    __slots__ = ("count", "gain", "state", "trie")

    def __init__(self, trie: Trie, state: int, gain: int):
        self.trie, self.state, self.gain, self.count = trie, state, gain, 0

    def __missing__(self, word: bytes) -> Node:
        self[word] = node = self.trie.child(self, word)
        return node


class Trie:
    """Runs of 1 to `longest` words, with what belongs to each run's bucket."""

    def __init__(self, longest: int, buckets: int, gains: list[int] | None = None):
        self.longest, self.buckets, self.gains = longest, buckets, gains
        self.totals = np.zeros(buckets, np.int64)
        self.clear()

    def clear(self) -> None:
        self.nodes: list[Node] = []
        self.root = Node(self, 0, 0)

    def child(self, parent: Node, word: bytes) -> Node:
        state = crc32(word) if parent is self.root else crc32(b" " + word, parent.state)
        node = Node(self, state, self.gains[state % self.buckets] if self.gains else 0)
        self.nodes.append(node)
        return node

    def runs(self, words: list[bytes]) -> Iterator[Node]:
        """The node of each run of these words."""
        if self.longest == 1:
            yield from map(self.root.__getitem__, words)
            return
        for at in range(len(words)):
            node = self.root
            for word in words[at : at + self.longest]:
                node = node[word]
                yield node

    def add(self, words: list[bytes]) -> None:
        for node in self.runs(words):
            node.count += 1
        if len(self.nodes) > MAX_NODES:
            self.merge()

    def merge(self) -> None:
        """Move all nodes' counts to their buckets."""
        for node in self.nodes:
            self.totals[node.state % self.buckets] += node.count
        self.clear()

    def gain_of(self, words: list[bytes]) -> int:
        total = sum(node.gain for node in self.runs(words))
        if len(self.nodes) > MAX_NODES:
            self.clear()
        return total


def words_in(text: bytes | None) -> list[bytes]:
    return text.translate(_FOLD).split() if text else []


def bucket_totals(texts: DataFrame, longest: int, buckets: int) -> DataFrame:
    """(corpus, bucket, n): the features of `texts` (corpus, _text as bytes)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tries: dict[int, Trie] = {}
        for batch in batches:
            for corpus, text in zip(batch["corpus"], batch["_text"], strict=True):
                if corpus not in tries:
                    tries[corpus] = Trie(longest, buckets)
                tries[corpus].add(words_in(text))
        for corpus, trie in tries.items():
            trie.merge()
            held = np.flatnonzero(trie.totals)
            yield pd.DataFrame({"corpus": np.full(len(held), corpus, np.int32), "bucket": held.astype(np.int32), "n": trie.totals[held]})

    return texts.mapInPandas(run, "corpus int, bucket int, n long").groupBy("corpus", "bucket").agg(F.sum("n").alias("n"))


def gains_of(raw: np.ndarray, target: np.ndarray) -> list[int]:
    """A thousand times the logarithm of how much likelier each bucket is in the target, with one more feature a bucket."""
    buckets = len(raw)
    all_raw, all_target = float(raw.sum() + buckets), float(target.sum() + buckets)
    return [math.floor(1000 * math.log(float(t + 1) * all_raw / (float(s + 1) * all_target))) for s, t in zip(raw.tolist(), target.tolist(), strict=True)]


def noise(seed: int, doc_id: int) -> int:
    """A Gumbel number of the seed and the id, in thousandths."""
    h = int(hashlib.sha256(f"{seed}:{doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def scored(docs: DataFrame, gains: list[int], longest: int, seed: int) -> DataFrame:
    """doc_id, n_words, n_features, weight and score of `docs` (doc_id, _text as bytes)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        trie = Trie(longest, len(gains), gains)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"].astype("Int64"), batch["_text"], strict=True):
                words = words_in(text)
                n = len(words)
                features = sum(n - k for k in range(min(longest, n)))
                weight = trie.gain_of(words) // features if features else 0
                rows.append((doc_id, n, features, weight, None if doc_id is pd.NA else weight + noise(seed, doc_id)))
            yield pd.DataFrame(rows, columns=["doc_id", "n_words", "n_features", "weight", "score"]).astype("Int64")

    return docs.mapInPandas(run, "doc_id long, n_words long, n_features long, weight long, score long")


def drawn(rows: DataFrame, share: int, least_words: int) -> DataFrame:
    """`rows` with their rank, from 1, among the floor(share * N / 100) of highest score; others have none."""
    may = F.col("score").isNotNull() & (F.col("n_words") >= least_words)
    counts = rows.where(may).groupBy("score").agg(F.count(F.lit(1)).alias("_n"))
    higher = Window.orderBy(F.desc("score"))
    before = counts.select("score", (F.sum("_n").over(higher) - F.col("_n")).alias("_before"), F.sum("_n").over(Window.partitionBy()).alias("_all"))
    most = F.floor(F.col("_all") * share / 100)
    wanted = before.select("score", "_before", most.alias("_most")).where("_before < _most")
    # Scores are whole numbers between fixed bounds, so this table is small whatever the input.
    near = rows.join(F.broadcast(wanted), "score", "left")
    inside = Window.partitionBy("score").orderBy("doc_id", "weight", "n_features")
    placed = near.where(may & F.col("_most").isNotNull()).withColumn("_rank", F.col("_before") + F.row_number().over(inside))
    rank = F.when(F.col("_rank") <= F.col("_most"), F.col("_rank"))
    rest = near.where(~(may & F.col("_most").isNotNull())).withColumn("_rank", F.lit(None).cast("long"))
    return placed.unionByName(rest).select(*rows.columns, rank.alias("rank"))


def resample(
    docs: DataFrame, target: DataFrame, share: int = 10, longest: int = 1, buckets: int = BUCKETS, seed: int = 2024, least_words: int = 20, id: str = "doc_id", text: str = "text", target_text: str = "text"
) -> DataFrame:
    """doc_id, n_words, n_features, weight, score and rank of every row of `docs`, drawn towards `target`.

    Features are the runs of 1 to `longest` words. `share` per cent of the documents of `least_words` words or more are drawn.
    """
    body = lambda name: named(name).cast("string").cast("binary").alias("_text")
    both = docs.select(F.lit(0).alias("corpus"), body(text)).union(target.select(F.lit(1).alias("corpus"), body(target_text)))
    counts = np.zeros((2, buckets), np.int64)
    for r in bucket_totals(both, longest, buckets).collect():  # two numbers a bucket
        counts[r.corpus, r.bucket] = r.n
    rows = scored(docs.select(named(id).cast("long").alias("doc_id"), body(text)), gains_of(*counts), longest, seed)
    # Slim rows, read three times below.
    return drawn(checkpointed(rows), share, least_words)


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, target = (spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in ("documents", "benchmark"))
    return resample(docs, target).select("doc_id", "n_features", "weight", "score", "rank")


_WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _crc_of(byte: int) -> int:
    for _ in range(8):
        byte = byte >> 1 ^ 0xEDB88320 * (byte & 1)
    return byte


_STEP = "xor(c >> 8, 0)"
for _bit in range(8):
    _STEP = f"xor({_STEP}, {_crc_of(1 << _bit)} * ((xor(c, x) >> {_bit}) & 1))"


def crc_sql(text: str) -> str:
    """CRC-32 of a DuckDB string's UTF-8, byte by byte."""
    numbers = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda h: CAST('0x' || h AS BIGINT))"
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {numbers}), lambda c, x: {_STEP}), 4294967295)"


OP13_SQL = rf"""
WITH texts AS (
  SELECT 0 AS corpus, row_number() OVER () AS rid, doc_id, "text" AS t FROM documents
  UNION ALL SELECT 1, row_number() OVER (), NULL, "text" FROM benchmark
), lists AS (
  SELECT corpus, rid, doc_id,
    regexp_extract_all(translate(coalesce(t, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORDS}') AS ws
  FROM texts
), words AS (SELECT corpus, rid, unnest(ws) AS w FROM lists),
buckets AS (SELECT w, {crc_sql("w")} % 10000 AS bucket FROM (SELECT DISTINCT w FROM words)),
hits AS (SELECT corpus, rid, bucket FROM words JOIN buckets USING (w)),
counts AS (
  SELECT bucket, CAST(count(*) FILTER (corpus = 0) AS DOUBLE) AS s, CAST(count(*) FILTER (corpus = 1) AS DOUBLE) AS t
  FROM hits GROUP BY bucket
), gains AS (
  SELECT bucket, CAST(floor(1000 * ln((t + 1) * (sum(s) OVER () + 10000) / ((s + 1) * (sum(t) OVER () + 10000)))) AS BIGINT) AS gain
  FROM counts
), weights AS (
  SELECT rid, CAST(floor(sum(gain) / CAST(count(*) AS DOUBLE)) AS BIGINT) AS weight FROM hits JOIN gains USING (bucket) WHERE corpus = 0 GROUP BY rid
), rows AS (
  SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight,
    CAST('0x' || left(sha256('2024:' || doc_id), 8) AS BIGINT) AS h
  FROM lists LEFT JOIN weights USING (rid) WHERE corpus = 0
), scores AS (
  SELECT doc_id, n_features, weight, weight + CAST(floor(-1000 * ln(-ln((h + 0.5) / 4294967296))) AS BIGINT) AS score FROM rows
), places AS (
  SELECT *, n_features >= 20 AND score IS NOT NULL AS may,
    row_number() OVER (PARTITION BY n_features >= 20 AND score IS NOT NULL ORDER BY score DESC, doc_id, weight, n_features) AS place,
    count(*) FILTER (n_features >= 20 AND score IS NOT NULL) OVER () AS n
  FROM scores
)
SELECT doc_id, n_features, weight, score, CASE WHEN may AND place <= 10 * n // 100 THEN place END AS rank FROM places
"""
