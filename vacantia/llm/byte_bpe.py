"""Byte-level BPE: whole texts to ids and back, with the merges done in numpy matrices (see `merges`).

A text is cut into pre-tokens by the vocabulary's pattern. Each distinct pre-token is merged once in a worker, in
length-bucketed padded matrices; its ids, and how they are written, are then looked up. Long texts are taken in parts of
PART pre-tokens, so that memory doesn't follow their length.

Defined cases: a null text counts as empty and has no ids; a pre-token of any length is merged as a whole; equal rows are encoded each; an empty table gives an empty
result; other columns are left out by `encoded` and `decoded`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain, islice

import numpy as np
import pandas as pd
import public_tokenizers
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .merges import BytePairs

PART = 200_000
#: Distinct pre-tokens that a worker keeps.
MEMO = 500_000


class Encoder:
    """One vocabulary, with a memory of pre-tokens: ids, and the ids written in decimals."""

    def __init__(self, path: str, pattern: str):
        self.pairs = BytePairs.from_ranks(path)
        self.cut = regex.compile(pattern)
        self.digits = [str(i) for i in range(len(self.pairs.spelled))]
        self.known: dict[str, tuple[int, ...]] = {}

    def learn(self, tokens: list[str]) -> None:
        new = [t for t in dict.fromkeys(tokens) if t not in self.known]
        if not new:
            return
        if len(self.known) + len(new) > MEMO:
            self.known.clear()
            new = list(dict.fromkeys(tokens))
        ids, sizes = self.pairs.encode([t.encode("utf-8", "surrogatepass") for t in new])
        ids, at = ids.tolist(), 0
        for t, n in zip(new, sizes.tolist(), strict=True):
            self.known[t] = tuple(ids[at : at + n])
            at += n

    def parts(self, texts: Iterable[str]) -> Iterator[tuple[int, list[int]]]:
        """(number of the text, ids of its next part), in order; a text without ids gives none.

        Pre-tokens of many texts are learnt together, so that matrices are well filled.
        """
        held: list[tuple[int, list[str]]] = []
        size = 0
        for k, text in enumerate(texts):
            found = (m.group() for m in self.cut.finditer(text)) if len(text) > PART else iter(self.cut.findall(text))
            while tokens := list(islice(found, PART)):
                held.append((k, tokens))
                size += len(tokens)
                if size > PART:
                    yield from self._flush(held)
                    held, size = [], 0
        yield from self._flush(held)

    def _flush(self, held: list[tuple[int, list[str]]]) -> Iterator[tuple[int, list[int]]]:
        self.learn([t for _, tokens in held for t in tokens])
        known = self.known
        for k, tokens in held:
            yield k, list(chain.from_iterable(map(known.__getitem__, tokens)))

    def encode(self, texts: Iterable[str]) -> list[list[int]]:
        texts = list(texts)
        out: list[list[int]] = [[] for _ in texts]
        for k, ids in self.parts(texts):
            out[k] += ids
        return out

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.pairs.spelled.__getitem__, ids))


@lru_cache(2)
def encoder(path: str, pattern: str) -> Encoder:
    """One for all tasks of a worker."""
    return Encoder(path, pattern)


def default_ranks() -> str:
    """The public ranks, where the worker that asks has them."""
    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def encoded(docs: DataFrame, ranks: str | None = None, pattern: str | None = None, text: str = "text") -> DataFrame:
    """doc_id and ids of each row."""
    pattern = pattern or public_tokenizers.PATTERN

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        by = encoder(ranks or default_ranks(), pattern)
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["_id"].astype("Int64"), "ids": by.encode(t or "" for t in batch["_text"])})

    return docs.select(F.col("doc_id").cast("long").alias("_id"), F.col(text).cast("string").alias("_text")).mapInPandas(run, "doc_id long, ids array<int>")


def decoded(rows: DataFrame, ranks: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id and the bytes that each row's ids stand for; null ids give null."""
    pattern = pattern or public_tokenizers.PATTERN

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        by = encoder(ranks or default_ranks(), pattern)
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["_id"].astype("Int64"), "bytes": [None if x is None else by.decode(x) for x in batch["ids"]]})

    return rows.select(F.col("doc_id").cast("long").alias("_id"), "ids").mapInPandas(run, "doc_id long, bytes binary")


def digested(docs: DataFrame, ranks: str | None = None, pattern: str | None = None, text: str = "text") -> DataFrame:
    """doc_id, n_tokens, and SHA-256 of the written ids and of the bytes they decode to: no ids leave the task."""
    pattern = pattern or public_tokenizers.PATTERN

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        by = encoder(ranks or default_ranks(), pattern)
        for batch in batches:
            counts = np.zeros(len(batch), np.int64)
            hashes = [(hashlib.sha256(), hashlib.sha256()) for _ in range(len(batch))]
            for k, ids in by.parts(t or "" for t in batch["_text"]):
                written, spelled = hashes[k]
                written.update(((" " if counts[k] else "") + " ".join(map(by.digits.__getitem__, ids))).encode())
                spelled.update(by.decode(ids))
                counts[k] += len(ids)
            ids_hex, bytes_hex = ([h[j].hexdigest() for h in hashes] for j in (0, 1))
            yield pd.DataFrame({"doc_id": batch["_id"].astype("Int64"), "n_tokens": counts, "ids_sha256": ids_hex, "decoded_sha256": bytes_hex})

    return docs.select(F.col("doc_id").cast("long").alias("_id"), F.col(text).cast("string").alias("_text")).mapInPandas(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digested(spark.read.parquet(f"{sf_dir}/documents.parquet"))
