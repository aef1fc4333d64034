"""Token counts by a trie of pre-tokens, with unigram forward scores computed once for each shared prefix.

A pre-token is a word with the sign that marks its start; pieces never cross it. Distinct pre-tokens are inserted in a
trie in sorted order, so that each shares its longest common prefix with its predecessor. A node holds the best score of
any segmentation of its prefix and the number of tokens that one has; the value at a pre-token's last node is its count.
Both follow from the nodes above: best(node) = max over pieces that end there of best(node - piece) + score(piece).

Scores are the vocabulary file's own, as whole numbers (in millionths, unless they are whole already), so ties are exact;
among equal scores fewer tokens win. (The public
file is a BPE model: its scores are its pieces' ranks, negative. Other scores can be given.) A character that no piece
covers costs its UTF-8 bytes, each BYTE_PENALTY times as bad as the worst piece.

Defined cases: a null or blank text has no pre-tokens and count 0; the words of one text are held by a task, whatever its
length, and a very long word costs its length times that of the longest piece; equal rows are counted each; an empty
table gives an empty result; other columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MARK = "▁"
VOCABULARY = "piece_bpe_32k.model"
BYTE_PENALTY = 2
#: Distinct pre-tokens that a worker keeps.
MEMO = 300_000


def model_scores(path: str) -> dict[str, int]:
    """Score of each piece that is neither a control, a byte nor unused, as a whole number."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    plain = (i for i in range(model.get_piece_size()) if not (model.is_unknown(i) or model.is_control(i) or model.is_byte(i) or model.is_unused(i)))
    scores = {model.id_to_piece(i): model.get_score(i) for i in plain}
    unit = 1 if all(x.is_integer() for x in scores.values()) else 10**6
    return {piece: round(unit * x) for piece, x in scores.items()}


class Counter:
    """Counts of pre-tokens, each computed once."""

    def __init__(self, scores: dict[str, int]):
        self.scores = scores
        self.longest = max(map(len, scores), default=1)
        self.byte_score = BYTE_PENALTY * min(scores.values(), default=-1) - 1
        self.known: dict[str, int] = {}

    def count_sorted(self, tokens: list[str]) -> list[int]:
        """Counts of sorted distinct pre-tokens, walking their trie depth first: a stack holds the path's values."""
        get, longest = self.scores.get, self.longest
        best, number, before, out = [0], [0], "", []
        for token in tokens:
            shared, most = 0, min(len(token), len(before))
            while shared < most and token[shared] == before[shared]:
                shared += 1
            del best[shared + 1 :], number[shared + 1 :]
            for end in range(shared + 1, len(token) + 1):
                n_bytes = len(token[end - 1].encode("utf-8", "surrogatepass"))
                top, few = best[end - 1] + n_bytes * self.byte_score, number[end - 1] + n_bytes
                for start in range(max(0, end - longest), end):
                    score = get(token[start:end])
                    if score is not None:
                        score += best[start]
                        if score > top or score == top and number[start] + 1 < few:
                            top, few = score, number[start] + 1
                best.append(top)
                number.append(few)
            out.append(number[-1])
            before = token
        return out

    def totals(self, texts: list[list[str]]) -> list[int]:
        """The sum of counts of each list of words."""
        if len(self.known) > MEMO:
            self.known.clear()
        new = sorted({w for words in texts for w in words}.difference(self.known))
        self.known.update(zip(new, self.count_sorted([MARK + w for w in new]), strict=True))
        get = self.known.__getitem__
        return [sum(map(get, words)) for words in texts]


@lru_cache(2)
def counter(path: str) -> Counter:
    """One for all tasks of a worker."""
    return Counter(model_scores(path))


def split_words(text: str | None) -> list[str]:
    """Words `[^\\x20\\x09-\\x0D]+`."""
    return [w.decode("utf-8", "surrogatepass") for w in (text or "").encode("utf-8", "surrogatepass").split()]


def token_counts(docs: DataFrame, vocabulary: str | None = None, text: str = "text", scores: dict[str, int] | None = None) -> DataFrame:
    """doc_id, n_words (pre-tokens) and n_tokens of each row.

    `vocabulary` is a path that workers can read; none stands for the public model, found where the worker has it.
    `scores` (piece: whole number, none above 0), if given, stand in its place.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        by = Counter(scores) if scores is not None else counter(vocabulary or public_tokenizers.path(VOCABULARY))
        for batch in batches:
            # A few texts at once: words in memory don't follow the batch.
            n_words, n_tokens = [], []
            held: list[list[str]] = []
            size = 0
            for t in batch["_text"]:
                held.append(split_words(t))
                size += len(held[-1])
                if size > 300_000:
                    n_words += map(len, held)
                    n_tokens += by.totals(held)
                    held, size = [], 0
            n_words += map(len, held)
            n_tokens += by.totals(held)
            yield pd.DataFrame({"doc_id": batch["_id"].astype("Int64"), "n_words": np.array(n_words, np.int64), "n_tokens": np.array(n_tokens, np.int64)})

    return docs.select(F.col("doc_id").cast("long").alias("_id"), F.col(text).cast("string").alias("_text")).mapInPandas(run, "doc_id long, n_words long, n_tokens long")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
