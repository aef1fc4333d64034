"""Packing by linear grouping: documents become pieces of at most `capacity` tokens, pieces become sequences.

1. Every text is tokenized once, in tasks; longer documents are cut into full pieces and a rest.
2. Only the histogram of piece lengths reaches the driver: at most `capacity` numbers, whatever the input.
3. Large lengths are sorted and divided into groups of equal cardinality, each rounded up to its largest length. For
   these few sizes, configurations of a sequence are optimised by column generation (a linear program whose columns are
   knapsacks); fractions left over are filled greedily.
4. The actual lengths take the places of the rounded ones, and small pieces go best-fit into the room that is left.
   All this is done on runs of equal sequences, so the plan's size depends on `capacity` alone.
5. Pieces are ranked within their length, in buckets, and look their place up in the plan, which is broadcast: a few
   thousand rows, bounded by MAX_PLAN, beyond which it is joined by a shuffle.

Defined cases: a null text is empty and gives one piece with the closing id alone; the strings of the tokenizer's special
tokens stand for these tokens, as its library has it by default; a very long text is tokenized in parts that end before
a space, or as a whole where it has none; repeated rows are packed each; an empty table gives an empty result; other
columns are left out.
"""

from __future__ import annotations

import bisect
import json
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bucket_bits, checkpointed, hash_bucket
from .merges import BytePairs, Memo
from .sharding import ranked

TOKENIZER = "word_bpe_49k.json"
CAPACITY = 2048
CLOSING_ID = 0
#: Lengths over capacity / SMALL_PART count as large.
SMALL_PART = 8
GROUPS = 64
MAX_PLAN = 200_000
#: Characters of text that a worker takes at once.
CHUNK = 1 << 21


# How the tokenizer cuts a word of Latin letters; its own normalizer only lowers their case.
PLAIN = re.compile(r"[!-~À-ÖØ-öø-ÿ]*")
CUTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+")


class WordTokenizer:
    """Ids of texts by a tokenizer whose pieces never cross white space: each distinct word is encoded once.

    Words of Latin letters and ASCII signs go through `merges`; any other word through the tokenizers library. A text is
    cut at its special tokens first, and what stands between them is encoded by itself.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            added = json.load(f)["added_tokens"]
        if any(a["normalized"] or a["lstrip"] or a["rstrip"] or a["single_word"] for a in added):
            raise ValueError("special tokens that take in what stands around them can't be cut out of a text")
        self.special = {a["content"]: np.array([a["id"]], np.uint32) for a in added}
        self.at_special = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) or "(?!)")
        self.pairs = BytePairs.from_word_ends(path)
        self.cuts = Memo(lambda parts: self.pairs.encode([p.encode() for p in parts]))
        self.words = Memo(self._encode_words)

    def _encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        plain = np.array([PLAIN.fullmatch(w) is not None for w in words], bool)
        parts = [CUTS.findall(w.lower()) for w, p in zip(words, plain, strict=True) if p]
        places = self.cuts.places([x for p in parts for x in p])
        number = np.fromiter(map(len, parts), np.int64, len(parts))
        held = np.concatenate([[0], np.cumsum(self.cuts.sizes[places])])
        bounds = np.concatenate([[0], np.cumsum(number)])
        sizes = np.zeros(len(words), np.int64)
        sizes[plain] = np.diff(held[bounds])
        if plain.all():
            return self.cuts.ids(places), sizes
        others = self.tokenizer.encode_batch([w for w, p in zip(words, plain, strict=True) if not p], add_special_tokens=False)
        sizes[~plain] = [len(e.ids) for e in others]
        out, own = np.zeros(sizes.sum(), np.int32), np.repeat(plain, sizes)
        out[own] = self.cuts.ids(places)
        out[~own] = np.array([i for e in others for i in e.ids], np.int32)
        return out, sizes

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """One array of ids for each text."""
        split = pc.ascii_split_whitespace(texts)
        words = split.flatten().dictionary_encode()
        places = self.words.places(words.dictionary.to_pylist())[words.indices.to_numpy(zero_copy_only=False)]
        ids = self.words.ids(places).view(np.uint32)
        ends = np.concatenate([[0], np.cumsum(self.words.sizes[places])])
        bounds = ends[np.asarray(split.offsets)[: len(texts) + 1] - split.offsets[0].as_py()]
        return [ids[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]

    def encode_bounded(self, texts: list[str]) -> Iterator[np.ndarray]:
        """The same for texts with special tokens, and with little at once: long texts are taken in parts that end before a space."""
        cuts = [self.at_special.split(t) for t in texts]
        plain = self._encode_parts([x for parts in cuts for x in parts])
        for text, parts in zip(texts, cuts, strict=True):
            out = [next(plain)]
            for special in self.at_special.findall(text) if len(parts) > 1 else ():
                out += [self.special[special], next(plain)]
            yield out[0] if len(out) == 1 else np.concatenate(out)

    def _encode_parts(self, texts: list[str]) -> Iterator[np.ndarray]:
        held: list[str] = []
        size = 0
        for text in texts:
            if len(text) > CHUNK:
                yield from self.encode(pa.array(held, pa.large_string())) if held else ()
                held, size, at, parts = [], 0, 0, []
                while at < len(text):
                    end = text.find(" ", at + CHUNK)
                    end = len(text) if end < 0 else end
                    parts += self.encode(pa.array([text[at:end]], pa.large_string()))
                    at = end
                yield np.concatenate(parts)
                continue
            held.append(text)
            size += len(text)
            if size > CHUNK:
                yield from self.encode(pa.array(held, pa.large_string()))
                held, size = [], 0
        yield from self.encode(pa.array(held, pa.large_string())) if held else ()


@lru_cache(2)
def word_tokenizer(path: str) -> WordTokenizer:
    """One for all tasks of a worker."""
    return WordTokenizer(path)


PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """A row for each piece of each document: doc_id, piece, start, length, ids_crc32 and, if wanted, ids.

    `tokenizer` is a path that workers can read; none stands for the public tokenizer, found where the worker has it.
    """

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        by = word_tokenizer(tokenizer or public_tokenizers.path(TOKENIZER))
        closing = np.array([CLOSING_ID], np.uint32)
        for batch in batches:
            texts = [t or "" for t in batch["_text"]]
            rows = []
            for doc, ids in zip(batch["_id"], by.encode_bounded(texts), strict=True):
                ids = np.concatenate([ids, closing]).astype("<u4")
                for k, at in enumerate(range(0, len(ids), capacity)):
                    part = ids[at : at + capacity]
                    rows.append((doc, k, at, len(part), zlib.crc32(part.tobytes()), *([part.astype(np.int32)] if with_ids else [])))
            yield pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]).astype({"doc_id": "Int64"})

    return docs.select(F.col("doc_id").cast("long").alias("_id"), F.col("text").cast("string").alias("_text")).mapInPandas(cut, PIECE_SCHEMA + (", ids array<int>" if with_ids else ""))


def _knapsack(sizes: np.ndarray, values: np.ndarray, most: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The configuration of greatest value."""
    best = np.zeros(capacity + 1)
    took = np.zeros((len(sizes), capacity + 1), np.int16)
    for j, (s, v) in enumerate(zip(sizes, values, strict=True)):
        if v <= 1e-12:
            continue
        base, out = best, best.copy()
        for n in range(1, min(int(most[j]), capacity // s) + 1):
            other = base[: capacity + 1 - n * s] + n * v
            better = other > out[n * s :] + 1e-12
            out[n * s :][better] = other[better]
            took[j, n * s :][better] = n
        best = out
    room, config = capacity, np.zeros(len(sizes), np.int64)
    for j in range(len(sizes) - 1, -1, -1):
        config[j] = took[j, room]
        room -= config[j] * sizes[j]
    return float(best[capacity]), config


def configurations(sizes: np.ndarray, counts: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """How often to use which configuration so that all counts are placed: column generation, then greedy for the rest."""
    m = len(sizes)
    if not m:
        return []
    fits = capacity // sizes
    columns = np.diag(np.minimum(fits, np.maximum(counts, 1))).astype(float)
    inverse, x = np.linalg.inv(columns), counts / np.diag(columns)
    for _ in range(6 * m):
        prices = inverse.sum(axis=0)
        value, config = _knapsack(sizes, prices, counts, capacity)
        if value <= 1 + 1e-7:
            break
        along = inverse @ config
        ratios = np.where(along > 1e-9, x / np.where(along > 1e-9, along, 1), np.inf)
        out = int(np.argmin(ratios))
        if not np.isfinite(ratios[out]):
            break
        step = ratios[out]
        x = x - step * along
        x[out] = step
        columns[:, out] = config
        inverse = np.linalg.inv(columns)
    rest, plan = counts.astype(np.int64).copy(), []
    for j in np.argsort(-x):
        config = np.rint(columns[:, j]).astype(np.int64)
        used = config > 0
        n = min(int(np.floor(x[j] + 1e-6)), int((rest[used] // config[used]).min())) if used.any() else 0
        if n > 0:
            plan.append((config, n))
            rest -= n * config
    while rest.any():
        # The fullest configuration of what is left, largest sizes first among equals.
        _, config = _knapsack(sizes, sizes * (1 + 1e-6 * sizes / capacity) * (rest > 0), rest, capacity)
        used = config > 0
        n = int((rest[used] // config[used]).min())
        plan.append((config, n))
        rest -= n * config
    return plan


class Plan:
    """Runs of equal sequences: each has a first number, how many there are, and what they hold so far."""

    def __init__(self, capacity: int):
        self.capacity, self.sequences = capacity, 0
        self.places: list[tuple[int, int, int, int, int]] = []  # length, first rank, how many, first sequence, offset
        self.room: dict[int, list[tuple[int, int]]] = {}  # room left: (first sequence, how many)
        self.rooms: list[int] = []

    def _leave(self, room: int, first: int, n: int) -> None:
        if n and room:
            if room not in self.room:
                self.room[room] = []
                bisect.insort(self.rooms, room)
            self.room[room].append((first, n))

    def open(self, held: list[tuple[int, int]], n: int) -> None:
        """n new sequences with the same lengths: (length, first rank) each."""
        offset = 0
        for length, rank in held:
            self.places.append((length, rank, n, self.sequences, offset))
            offset += length
        self._leave(self.capacity - offset, self.sequences, n)
        self.sequences += n

    def best_fit(self, length: int, count: int) -> None:
        """`count` pieces of one length into the least room that takes them; new sequences for the rest."""
        rank = 0
        while rank < count:
            at = bisect.bisect_left(self.rooms, length)
            if at == len(self.rooms):
                self._leave(self.capacity, self.sequences, n := -(-(count - rank) // (self.capacity // length)))
                self.sequences += n
                continue
            room = self.rooms[at]
            first, n = self.room[room].pop()
            if not self.room[room]:
                del self.room[room], self.rooms[at]
            each = room // length
            full = min(n, (count - rank) // each)
            for k in range(each if full else 0):
                self.places.append((length, rank, full, first, self.capacity - room + k * length))
                rank += full
            self._leave(room - each * length, first, full)
            if full < n and (rest := min(each, count - rank)):
                for k in range(rest):
                    self.places.append((length, rank, 1, first + full, self.capacity - room + k * length))
                    rank += 1
                self._leave(room - rest * length, first + full, 1)
                full += 1
            self._leave(room, first + full, n - full)


def plan_packing(histogram: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS, small_part: int = SMALL_PART) -> Plan:
    """The plan for a histogram of piece lengths."""
    plan = Plan(capacity)
    large = sorted(((s, n) for s, n in histogram.items() if s * small_part > capacity), reverse=True)
    total = sum(n for _, n in large)
    # Groups of equal cardinality over the lengths in falling order; a length may be in two groups.
    runs: list[list[list[int]]] = []  # for each group: [length, first rank, how many]
    left = 0
    for length, n in large:
        rank = 0
        while n:
            if not left:
                runs.append([])
                left = -(-total // groups)
            part = min(n, left)
            runs[-1].append([length, rank, part])
            rank, n, left = rank + part, n - part, left - part
    sizes = np.array([r[0][0] for r in runs], np.int64)
    merged: dict[int, list[list[int]]] = {}
    for s, r in zip(sizes.tolist(), runs, strict=True):
        merged.setdefault(s, []).extend(r)
    sizes, queues = np.array(list(merged), np.int64), [list(reversed(r)) for r in merged.values()]
    counts = np.array([sum(x[2] for x in q) for q in queues], np.int64)
    for config, n in configurations(sizes, counts, capacity):
        slots = [j for j, c in enumerate(config) for _ in range(c)]
        # Slots of one group take consecutive parts of it; sequences with the same actual lengths form a run.
        parts = []
        for j in slots:
            taken, need = [], n
            while need:
                run = queues[j][-1]
                part = min(need, run[2])
                taken.append((run[0], run[1], part))
                run[1], run[2], need = run[1] + part, run[2] - part, need - part
                if not run[2]:
                    queues[j].pop()
            parts.append(taken)
        cuts = sorted({0, n} | {int(c) for taken in parts for c in np.cumsum([p for _, _, p in taken])})
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            held = []
            for taken in parts:
                at = 0
                for length, rank, part in taken:
                    if at <= a < at + part:
                        held.append((length, rank + a - at))
                    at += part
            plan.open(held, b - a)
    for length, n in sorted(((s, n) for s, n in histogram.items() if s * small_part <= capacity), reverse=True):
        plan.best_fit(length, n)
    return plan


def pack(cut: DataFrame, capacity: int = CAPACITY, groups: int = GROUPS) -> DataFrame:
    """Adds sequence_id and offset to pieces. The histogram has at most `capacity` rows."""
    spark = cut.sparkSession
    histogram = {int(r["length"]): r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    plan = plan_packing(histogram, capacity, groups)
    places = spark.createDataFrame(plan.places, "_length long, _from long, _many long, _sequence long, offset long")
    bits = bucket_bits(sum(histogram.values()))
    rows = cut.withColumn("_hash", F.xxhash64("doc_id", "piece", "ids_crc32")).withColumn("_bucket", hash_bucket(F.col("_hash"), bits))
    rows = ranked(rows, ["length"], "_bucket", ["_hash", "doc_id", "piece", "ids_crc32"], "_rank")
    hit = (F.col("length") == F.col("_length")) & (F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_from") + F.col("_many"))
    joined = rows.join(F.broadcast(places) if len(plan.places) <= MAX_PLAN else places, hit)
    return joined.select(*cut.columns, (F.col("_sequence") + F.col("_rank") - F.col("_from")).alias("sequence_id"), "offset")


def sequences(packed: DataFrame) -> DataFrame:
    """The sequences themselves, from packed pieces with ids: sequence_id, ids, and where each document lies."""
    part = F.sort_array(F.collect_list(F.struct("offset", "doc_id", "piece", "length", "ids")))
    rows = packed.groupBy("sequence_id").agg(part.alias("_parts"))
    return rows.select("sequence_id", F.flatten("_parts.ids").alias("ids"), F.transform("_parts", lambda p: F.struct(p["doc_id"].alias("doc_id"), p["piece"].alias("piece"), p["offset"].alias("offset"), p["length"].alias("length"))).alias("documents"))


def pack_documents(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of `docs` with their places. Texts are tokenized once: the pieces are written, without text, and reread."""
    return pack(checkpointed(pieces(docs, tokenizer, capacity)), capacity)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage, the last: where each document's pieces lie."""
    return pack_documents(docs)


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
