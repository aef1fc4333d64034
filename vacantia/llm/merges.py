"""Byte-pair merging over length-bucketed, padded numpy matrices.

Distinct pre-tokens of like length form the rows of a matrix. In each round every row merges its leftmost pair of least
rank; the rest of the row moves one place to the left, only the two pairs beside the merge are looked up again, and rows
without a pair that merges leave the matrix (compaction). Pairs are found in an open-addressing hash table of numpy
arrays. Rows longer than LONG go through a heap over a linked list, with the same order of merges.
"""

from __future__ import annotations

import base64
import heapq
import json
from collections.abc import Callable
from itertools import repeat

import numpy as np

NONE = np.int32(2**31 - 1)
LONG = 256
CELLS = 1 << 17


class PairTable:
    """(left id, right id) -> (rank, id of the merged token)."""

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray, merged: np.ndarray):
        self.bits = max(8, int(len(left) * 3).bit_length())
        size = 1 << self.bits
        self.keys, self.ranks = np.full(size, -1, np.int64), np.full(size, NONE, np.int32)
        self.merged = np.zeros(int(rank.max()) + 1 if len(rank) else 1, np.int32)
        self.merged[rank] = merged
        keys = self._key(left.astype(np.int64), right.astype(np.int64))
        at, waiting = self._slot(keys), np.arange(len(keys))
        while len(waiting):
            free = self.keys[at[waiting]] < 0
            first = np.zeros(len(waiting), bool)
            first[np.unique(at[waiting], return_index=True)[1]] = True
            put = waiting[free & first]
            self.keys[at[put]], self.ranks[at[put]] = keys[put], rank[put]
            waiting = waiting[~(free & first)]
            at[waiting] = (at[waiting] + 1) & (size - 1)

    @staticmethod
    def _key(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return (left << 20) | right

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs; NONE where a pair doesn't merge or an id is negative (padding)."""
        keys = self._key(left.astype(np.int64), right.astype(np.int64))
        at = self._slot(keys)
        found, out = self.keys[at], np.full(len(keys), NONE, np.int32)
        hit = found == keys
        out[hit] = self.ranks[at[hit]]
        left_over = np.flatnonzero(~hit & (found >= 0) & (left >= 0) & (right >= 0))
        while len(left_over):
            at[left_over] = (at[left_over] + 1) & (len(self.keys) - 1)
            found = self.keys[at[left_over]]
            hit = found == keys[left_over]
            out[left_over[hit]] = self.ranks[at[left_over[hit]]]
            left_over = left_over[~hit & (found >= 0)]
        out[(left < 0) | (right < 0)] = NONE
        return out


def merge_rows(ids: np.ndarray, pairs: PairTable) -> np.ndarray:
    """Merge every row of a matrix padded with -1 at the right; rows come back padded likewise."""
    width = ids.shape[1]
    out, rows = np.full_like(ids, -1), np.arange(len(ids))
    if width == 1:
        return ids
    # Columns lie together in memory: each step runs over one place of all rows.
    work = np.full((width + 1, len(ids)), -1, np.int32)
    work[:width] = ids.T
    ranks = np.stack([pairs.rank(work[j], work[j + 1]) for j in range(width - 1)])
    while len(rows):
        least, at = ranks[0].copy(), np.zeros(len(rows), np.int32)
        for j in range(1, len(ranks)):
            less = ranks[j] < least
            np.copyto(least, ranks[j], where=less)
            at[less] = j
        done = least == NONE
        if done.any():
            out[rows[done]] = work[:width, done].T
            go = np.flatnonzero(~done)
            if not len(go):
                break
            work, ranks, rows, at, least = work[:, go], ranks[:, go], rows[go], at[go], least[go]
        # Everything right of the merged pair moves one place to the left.
        for j in range(1, width):
            np.copyto(work[j], work[j + 1], where=at < j)
        for j in range(1, len(ranks) - 1):
            np.copyto(ranks[j], ranks[j + 1], where=at < j)
        here = np.arange(len(rows))
        ranks[-1, at < len(ranks) - 1] = NONE
        work[at, here] = pairs.merged[least]
        ranks[at, here] = pairs.rank(work[at, here], work[at + 1, here])
        before = np.flatnonzero(at > 0)
        place = at[before] - 1
        ranks[place, before] = pairs.rank(work[place, before], work[place + 1, before])
    return out


def merge_long(ids: np.ndarray, pairs: PairTable) -> np.ndarray:
    """One long row: a heap of (rank, place) over a linked list."""
    ids = ids.tolist()
    n = len(ids)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    one = lambda a, b: int(pairs.rank(np.array([a]), np.array([b]))[0])
    known: dict[tuple[int, int], int] = {}

    def rank(a: int, b: int) -> int:
        if (r := known.get((a, b))) is None:
            r = known[a, b] = one(a, b)
        return r

    heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := rank(ids[i], ids[i + 1])) != NONE]
    heapq.heapify(heap)
    while heap:
        r, i, a, b = heapq.heappop(heap)
        j = after[i]
        if ids[i] != a or j >= n or ids[j] != b:
            continue
        ids[i], ids[j] = int(pairs.merged[r]), -1
        after[i] = after[j]
        if after[i] < n:
            before[after[i]] = i
        for x, y in ((before[i], i), (i, after[i])):
            if x >= 0 and y < n and (s := rank(ids[x], ids[y])) != NONE:
                heapq.heappush(heap, (s, x, ids[x], ids[y]))
    return np.array([x for x in ids if x >= 0], np.int32)


def gathered(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The parts of `flat` at `starts` with `sizes`, one after another."""
    ends = np.cumsum(sizes)
    return flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)]


def merge_all(ids: np.ndarray, sizes: np.ndarray, pairs: PairTable) -> tuple[np.ndarray, np.ndarray]:
    """Pre-tokens one after another, as the ids of their bytes: the ids after all merges, and how many each has."""
    starts = np.cumsum(sizes) - sizes
    counts = np.zeros(len(sizes), np.int64)
    done: list[tuple[np.ndarray, np.ndarray]] = []
    for i in np.flatnonzero(sizes > LONG):
        merged = merge_long(ids[starts[i] : starts[i] + sizes[i]], pairs)
        counts[i] = len(merged)
        done.append((np.array([i]), merged))
    order = np.argsort(sizes, kind="stable")
    order = order[(sizes[order] <= LONG) & (sizes[order] > 0)]
    at = 0
    while at < len(order):
        # A bucket: lengths up to a quarter more than its least, as many rows as CELLS allows.
        widest = max(4, int(sizes[order[at]]) * 5 // 4)
        end = min(int(np.searchsorted(sizes[order], widest, side="right")), at + max(1, CELLS // widest))
        part = order[at:end]
        held, width = sizes[part], int(sizes[part[-1]])
        matrix = np.full((len(part), width), -1, np.int32)
        matrix[np.arange(width)[None, :] < held[:, None]] = gathered(ids, starts[part], held)
        merged = merge_rows(matrix, pairs)
        kept = merged >= 0
        counts[part] = kept.sum(axis=1)
        done.append((part, merged[kept]))
        at = end
    out, places = np.zeros(counts.sum(), np.int32), np.cumsum(counts) - counts
    for part, merged in done:
        n = counts[part]
        out[np.arange(len(merged)) + np.repeat(places[part] - (np.cumsum(n) - n), n)] = merged
    return out, counts


class BytePairs:
    """A byte-level vocabulary: ids of single bytes, pairs that merge, and each id's bytes."""

    def __init__(self, byte_ids: np.ndarray, pairs: PairTable, spelled: list[bytes], ending: dict[int, int] | None = None):
        self.byte_ids, self.pairs, self.spelled = byte_ids, pairs, spelled
        #: For vocabularies with word ends: the id of a byte that ends its pre-token.
        self.end_ids = None if ending is None else np.array([ending[b] for b in range(256)], np.int32)

    def encode(self, tokens: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pre-tokens one after another, and how many each has."""
        sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
        raw = np.frombuffer(b"".join(tokens), np.uint8)
        ids = self.byte_ids[raw]
        if self.end_ids is not None:
            ends = np.cumsum(sizes)[sizes > 0] - 1
            ids[ends] = self.end_ids[raw[ends]]
        return merge_all(ids, sizes, self.pairs)

    @classmethod
    def from_ranks(cls, path: str) -> BytePairs:
        """A file of base64 tokens and ranks: any two neighbours whose bytes together are a token merge."""
        ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in open(path, "rb") if x.strip())}
        found = [(ranks[t[:i]], ranks[t[i:]], r) for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        left, right, rank = (np.array(x, np.int64) for x in zip(*found, strict=True))
        spelled = [b""] * (max(ranks.values()) + 1)
        for t, r in ranks.items():
            spelled[r] = t
        return cls(np.array([ranks[bytes([b])] for b in range(256)], np.int32), PairTable(left, right, rank, rank), spelled)

    @classmethod
    def from_word_ends(cls, path: str, suffix: str = "</w>") -> BytePairs:
        """A JSON tokenizer whose pre-tokens end in a marked byte: its listed merges, in order."""
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, merges = model["vocab"], [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        signs = byte_signs()
        left, right = (np.array([vocab[m[k]] for m in merges], np.int64) for k in (0, 1))
        merged = np.array([vocab[a + b] for a, b in merges], np.int64)
        spelled = [b""] * (max(vocab.values()) + 1)
        return cls(np.array([vocab[s] for s in signs], np.int32), PairTable(left, right, np.arange(len(merges)), merged), spelled, {b: vocab[s + suffix] for b, s in enumerate(signs)})


class Memo:
    """Ids of distinct strings, each encoded once; forgets all when it holds more than `limit` of them."""

    def __init__(self, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], limit: int = 400_000):
        self.encode, self.limit = encode, limit
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.flat, self.starts, self.sizes = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def places(self, strings: list[str]) -> np.ndarray:
        """Where each string's ids are; the numbers hold until the next call."""
        if len(self.known) > self.limit:
            self.forget()
        known = self.known
        out = np.fromiter(map(known.get, strings, repeat(-1)), np.int64, len(strings))
        missing = np.flatnonzero(out < 0)
        if len(missing):
            wanted = [strings[i] for i in missing]
            new = list(dict.fromkeys(wanted))
            flat, sizes = self.encode(new)
            first = len(known)
            known.update(zip(new, range(first, first + len(new)), strict=True))
            self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(sizes) - sizes])
            self.flat, self.sizes = np.concatenate([self.flat, flat]), np.concatenate([self.sizes, sizes])
            out[missing] = np.arange(first, first + len(new)) if len(new) == len(wanted) else np.fromiter(map(known.__getitem__, wanted), np.int64, len(wanted))
        return out

    def ids(self, places: np.ndarray) -> np.ndarray:
        """The ids of strings at `places`, one after another."""
        return gathered(self.flat, self.starts[places], self.sizes[places])


def byte_signs() -> list[str]:
    """The printable sign that stands for each byte: itself if it prints, else the next free one from U+0100 on."""
    prints = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = iter(range(0x100, 0x200))
    own = set(prints)
    return [chr(b) if b in own else chr(next(others)) for b in range(256)]
