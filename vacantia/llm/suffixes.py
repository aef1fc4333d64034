"""Repeated passages by suffix arrays: bytes of a text that a string of `length` bytes covers which also starts in a text of smaller id.

1. Texts are written once, in shards of a few megabytes, as a table bucketed by shard; later steps read it in place.
2. Of every window of `length` bytes the anchor is its ANCHOR-byte string of least hash. Equal windows have equal anchors at
   equal places, so windows need to be compared only where anchors are. Windows that follow each other and share an anchor
   are one run, some 20 windows on average, and the bytes of a run are its context. A shard asks by hash which of its anchors
   stand in another text; shards' lists of sorted hashes are merged by binary search. Only contexts of such anchors go on.
3. Equal contexts of a shard are one, with its smallest id: all larger ids lose them at once. What is left is dealt by
   anchor. Suffix arrays are built of all contexts whose anchor has several, MAX_SORTED bytes each: Larsson-Sadakane refinement (suffixes ordered by 8 bytes;
   groups that are not yet apart are sorted by their ranks 8, 16, 32 .. bytes on), then common prefixes of neighbours by
   Kasai's rule. Windows whose neighbours share `length` bytes or more are one group, whose smallest id keeps it.
4. An anchor's contexts beyond that make several suffix arrays, which are merged by binary search of their sorted distinct
   windows.
5. Windows that go come back to their shards as runs, and each text is cut.

An anchor with more than HOT contexts (a passage of a third of all texts differs at its edges in each) is dealt by the
hashes of its single windows instead, so no task has all of them; the windows inside the passage are few in each shard.

Ids are compared as they are: rows of equal id take nothing from each other, and a text takes nothing from itself.

Defined cases: a null text is empty; a null id is neither smaller nor larger than any, so such rows lose and take nothing;
ids are whole numbers; equal rows have equal results; texts shorter than `length` lose nothing; a very long text is one
task's, its windows taken in blocks; cuts may fall inside of a character, so kept bytes are binary; an empty table gives
an empty result; columns other than those named are left out.
"""

from __future__ import annotations

import math
import uuid
from functools import lru_cache
from zlib import crc32

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import named, shared_path, small_batches

LENGTH = 50
#: Bytes that are compared as one number.
GRAM = 8
#: Bytes of an anchor, two such numbers: shorter ones stand in too many texts by chance, longer ones make shorter runs.
ANCHOR = 2 * GRAM
#: Windows that are taken at once; places in a block have PLACE_BITS bits.
BLOCK, PLACE_BITS = 1 << 19, 20
#: Bytes of contexts that one suffix array has.
MAX_SORTED = 1 << 20
#: Contexts of one anchor beyond which its windows are dealt one by one.
HOT = 50_000
#: Text for one bucket of anchors, and for one task that reads shards, in bytes.
BUCKET_BYTES, TASK_BYTES, MAX_TASKS = 2 << 20, 8 << 20, 50_000
_MASK32 = np.uint64(0xFFFFFFFF)
_C1, _C2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def eights(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place of `data` on, as little-endian numbers; for all but the last 7."""
    return np.ascontiguousarray(np.ndarray(max(len(data) - 7, 0), "<u8", data.tobytes(), 0, (1,)) if len(data) > 7 else np.zeros(0, "<u8"))


@lru_cache(1)
def _powers() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Powers of an odd number, those of its inverse (modulo 2^64), and a random number for each byte."""
    n, odd = BLOCK + (1 << 16), 0x9E3779B97F4A7C15
    up = np.full(n, odd, np.uint64)
    down = np.full(n, pow(odd, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down), np.random.default_rng(7).integers(1, 1 << 63, 256, np.uint64)


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` values in a row."""
    have = 1
    while have * 2 <= width:
        values = np.minimum(values[:-have], values[have:])
        have *= 2
    return np.minimum(values[: have - width], values[width - have :]) if have < width else values


def runs_of(data: np.ndarray, offsets: np.ndarray, sizes: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchor hash, first window, number of windows and hash of the context of each run, over texts laid end to end."""
    enough = sizes >= length
    change = np.zeros(len(data) + 1, np.int32)
    np.add.at(change, offsets[enough], 1)
    np.add.at(change, offsets[enough] + sizes[enough] - length + 1, -1)
    valid = np.cumsum(change[:-1]) > 0
    up, down, letters = _powers()
    parts = []
    places = np.uint64((1 << PLACE_BITS) - 1)
    for a in range(0, len(data), BLOCK):
        starts = np.flatnonzero(valid[a : a + BLOCK])
        if not len(starts):
            continue
        body = data[a : a + BLOCK + length - 1]
        words = eights(body)
        mixed = words[:-GRAM] * _C1
        mixed ^= mixed >> np.uint64(29)
        mixed += words[GRAM:]
        mixed *= _C2
        mixed ^= mixed >> np.uint64(31)
        mixed *= _C1
        mixed ^= mixed >> np.uint64(32)
        anchor = _least(mixed & ~places | np.arange(len(mixed), dtype=np.uint64), length - ANCHOR + 1)[starts] & places
        first = np.r_[True, (starts[1:] - starts[:-1] != 1) | (anchor[1:] != anchor[:-1])]
        begin, end = starts[first], starts[np.r_[first[1:], True]]
        summed = np.zeros(len(body) + 1, np.uint64)
        np.cumsum(letters[body] * up[: len(body)], out=summed[1:])
        parts.append((mixed[anchor[first]], begin + a, end - begin + 1, (summed[end + length] - summed[begin]) * down[begin]))
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return tuple(np.concatenate(p) for p in zip(*parts, strict=True))


def suffix_order(words: np.ndarray) -> np.ndarray:
    """Places sorted by all bytes from there on; `words` are the 8 bytes from each place on, zeros beyond the end."""
    n = len(words)
    key = words.byteswap()
    order = np.argsort(key)
    key = key[order]
    new = np.r_[True, key[1:] != key[:-1]]
    at = np.arange(n)
    # A suffix's rank is the first place of its group, from 1; 0 is the rank beyond the end.
    rank = np.zeros(n + 1, np.int64)
    rank[order] = np.maximum.accumulate(np.where(new, at, 0)) + 1
    step = GRAM
    while True:
        open_ = np.flatnonzero(~(new & np.r_[new[1:], True]))
        if not len(open_):
            return order
        held = order[open_]
        key = rank[held] << 32 | rank[np.minimum(held + step, n)]
        by = np.argsort(key)
        held, key = held[by], key[by]
        apart = np.r_[True, key[1:] != key[:-1]]
        order[open_], new[open_] = held, apart
        rank[held] = open_[np.maximum.accumulate(np.where(apart, np.arange(len(held)), 0))] + 1
        step *= 2


def common_prefixes(words: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """Bytes that each suffix shares with the one before it in `order`, `most` or so at most.

    By Kasai's rule the suffix at the next place shares one byte less at least. Lanes of neighbouring places go forward
    side by side.
    """
    n = len(order)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    padded = np.r_[words, np.zeros(most + 2 * GRAM, np.uint64)]
    lane = max(16, min(512, n // 1024))
    at = np.arange(0, n, lane)
    shared, held = np.zeros(n, np.int64), np.zeros(len(at), np.int64)
    for _ in range(lane):
        here = before[at]
        np.maximum(held - 1, 0, out=held)
        held[here < 0] = 0
        go = np.flatnonzero((here >= 0) & (held < most))
        while len(go):
            i, j, h = at[go], here[go], held[go]
            differ = padded[i + h] ^ padded[j + h]
            # Bytes below the lowest bit that differs.
            same = np.bitwise_count((differ & -differ) - np.uint64(1)).astype(np.int64) >> 3
            held[go] = h + same
            go = go[(same == GRAM) & (h + same < most)]
        shared[at] = held
        at = at + 1
        if at[-1] >= n:
            at, held = at[:-1], held[:-1]
            if not len(at):
                break
    return shared[order]


class Sorted:
    """The suffix array of some contexts laid end to end: their windows in groups of equal ones."""

    def __init__(self, contexts: list[bytes], ids: np.ndarray, length: int):
        sizes = np.fromiter(map(len, contexts), np.int64, len(contexts))
        starts = np.cumsum(sizes) - sizes
        data = np.frombuffer(b"".join(contexts) + bytes(GRAM - 1), np.uint8)
        words = eights(data)
        windows = np.ones(len(words), bool)
        tails = (starts + sizes)[:, None] - np.arange(1, length)[None, :]
        windows[tails.ravel()] = False
        order = suffix_order(words)
        group = np.cumsum(common_prefixes(words, order, length) < length)
        kept = windows[order]
        self.places, group = order[kept], group[kept]
        self.owners = np.repeat(ids, sizes)
        first = np.r_[True, group[1:] != group[:-1]]
        heads = np.flatnonzero(first)
        self.group = np.cumsum(first) - 1
        self.least = np.minimum.reduceat(self.owners[self.places], heads)
        self.starts, self.sizes, self.data, self.heads, self.length = starts, sizes, data, heads, length

    def keys(self) -> np.ndarray:
        """The distinct windows, sorted."""
        at = self.places[self.heads]
        whole = np.lib.stride_tricks.sliding_window_view(self.data, self.length)[at]
        return np.ascontiguousarray(whole).view(f"S{self.length}").ravel()

    def repeated(self, least: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The runs of windows that a smaller id has, as context, first window and number; `least`: the smallest of each group."""
        goes = np.zeros(len(self.owners) + 1, np.int8)
        goes[self.places] = least[self.group] < self.owners[self.places]
        edge = np.flatnonzero(np.diff(goes, prepend=0))
        begin, end = edge[::2], edge[1::2]
        of = np.searchsorted(self.starts, begin, "right") - 1
        return of, begin - self.starts[of], end - begin


def merged(shards: list[Sorted]) -> list[np.ndarray]:
    """The smallest id of each shard's groups over all shards, by binary search among sorted distinct windows."""
    if len(shards) == 1:
        return [shards[0].least]
    lists = [s.keys() for s in shards]
    keys, least = lists[0], shards[0].least.copy()
    for shard, own in zip(shards[1:], lists[1:], strict=True):
        at = np.searchsorted(keys, own)
        found = keys[np.minimum(at, len(keys) - 1)] == own
        np.minimum.at(least, at[found], shard.least[found])
        keys, least = np.insert(keys, at[~found], own[~found]), np.insert(least, at[~found], shard.least[~found])
    return [least[np.searchsorted(keys, own)] for own in lists]


def sorted_shards(contexts: list[bytes], ids: np.ndarray, anchors: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The runs of windows that a context of smaller id has too: context, first window and number of each, by context.

    Contexts of different anchors share no window, so a suffix array has whole anchors, MAX_SORTED bytes together. One
    anchor's contexts that are more make several suffix arrays, which are merged.
    """
    if not contexts:
        return (np.zeros(0, np.int64),) * 3
    by = np.argsort(anchors, kind="stable")
    sizes = np.fromiter((len(contexts[n]) for n in by), np.int64, len(by))
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def solve(*parts: np.ndarray) -> None:
        shards = [Sorted([contexts[n] for n in part], ids[part], length) for part in parts]
        for part, shard, least in zip(parts, shards, merged(shards), strict=True):
            of, begin, size = shard.repeated(least)
            found.append((part[of], begin, size))

    held, size = 0, 0
    edges = np.flatnonzero(np.r_[True, np.diff(anchors[by]) != 0])
    for a, b in zip(edges.tolist(), [*edges[1:].tolist(), len(by)], strict=True):
        own = int(sizes[a:b].sum())
        if a > held and size + own > MAX_SORTED:
            solve(by[held:a])
            held, size = a, 0
        if own > MAX_SORTED:
            solve(*np.array_split(by[a:b], -(-own // MAX_SORTED)))
            held, size = b, 0
        else:
            size += own
    if held < len(by):
        solve(by[held:])
    of, begin, size = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.argsort(of, kind="stable")
    return of[order], begin[order], size[order]


class Shard:
    """A shard's texts end to end, in the order of their row numbers, and their runs."""

    def __init__(self, rows: pd.DataFrame, length: int, buckets: int):
        rows = rows.sort_values("uid", ignore_index=True)
        self.rows, self.ids = rows, rows["doc_id"].to_numpy(np.int64)
        self.bytes = b"".join(rows["body"])
        self.sizes = np.fromiter(map(len, rows["body"]), np.int64, len(rows))
        self.offsets = np.cumsum(self.sizes) - self.sizes
        hashed, self.first, self.windows, self.context = runs_of(np.frombuffer(self.bytes, np.uint8), self.offsets, self.sizes, length)
        # The bucket of an anchor, and 32 bits that tell it from others there; a collision costs a comparison.
        self.anchor = (hashed >> np.uint64(32)) % np.uint64(buckets) << np.uint64(32) | hashed & _MASK32
        self.row = np.searchsorted(self.offsets, self.first, "right") - 1


def _frame(rows: list[tuple], schema: str) -> pd.DataFrame:
    """Rows of a schema; none at all as a frame without columns, which has no types to mistake."""
    return pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")]) if rows else pd.DataFrame()


ASKED = "bucket int, shard int, keys binary, contexts binary, several binary"
ANSWERED = "shard int, bucket int, keys binary, hot binary"
CONTEXTS = "bucket int, shard int, anchors binary, ids binary, sizes binary, text binary, places binary, rows binary, starts binary, windows binary"
GONE = "shard int, rows binary, starts binary, windows binary"
RESULT = "doc_id long, n_bytes long, spans array<struct<start: long, end: long>>, kept binary"


def asked(texts: DataFrame, length: int, buckets: int) -> DataFrame:
    """(bucket, shard, keys, contexts, several): the anchors of each shard, sorted, with their number of different contexts
    and whether several ids have them there."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        shard = Shard(rows, length, buckets)
        by = np.lexsort((shard.context, shard.anchor))
        anchor, context, ids = shard.anchor[by], shard.context[by], shard.ids[shard.row[by]]
        out = []
        if len(anchor):
            first = np.r_[True, anchor[1:] != anchor[:-1]]
            heads = np.flatnonzero(first)
            number = np.minimum(np.add.reduceat((first | np.r_[True, context[1:] != context[:-1]]).astype(np.int64), heads), 65535).astype(np.uint16)
            several = np.minimum.reduceat(ids, heads) != np.maximum.reduceat(ids, heads)
            anchor = anchor[heads]
            of = (anchor >> np.uint64(32)).astype(np.int64)
            cuts = np.r_[np.flatnonzero(np.r_[True, of[1:] != of[:-1]]), len(of)]
            keys = (anchor & _MASK32).astype(np.uint32)
            out = [(of[a], rows["shard"].iloc[0], keys[a:b].tobytes(), number[a:b].tobytes(), several[a:b].tobytes()) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        return _frame(out, ASKED)

    return texts.groupBy("shard").applyInPandas(run, ASKED)


def answered(requests: DataFrame) -> DataFrame:
    """(shard, bucket, keys, hot): which anchors of each shard several texts have, and which of them are hot."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        lists = [np.frombuffer(k, np.uint32) for k in rows["keys"]]
        every = np.concatenate(lists)
        by = np.argsort(every, kind="stable")
        heads = np.flatnonzero(np.r_[True, every[by][1:] != every[by][:-1]])
        number = np.add.reduceat(np.concatenate([np.frombuffer(c, np.uint16) for c in rows["contexts"]])[by].astype(np.int64), heads)
        several = np.logical_or.reduceat(np.concatenate([np.frombuffer(s, bool) for s in rows["several"]])[by], heads)
        several |= np.diff(np.r_[heads, len(every)]) > 1
        shared, hot = every[by][heads][several], number[several] > HOT
        out = []
        if len(shared):
            for bucket, shard, own in zip(rows["bucket"], rows["shard"], lists, strict=True):
                at = np.minimum(np.searchsorted(shared, own), len(shared) - 1)
                found = shared[at] == own
                if found.any():
                    out.append((shard, bucket, own[found].tobytes(), hot[at[found]].tobytes()))
        return _frame(out, ANSWERED)

    return requests.groupBy("bucket").applyInPandas(run, ANSWERED)


def exported(texts: DataFrame, answers: DataFrame, length: int, buckets: int) -> DataFrame:
    """Contexts that other texts may have, one row for each shard and bucket; those of larger ids in the shard as runs that go.

    Of such a row, `anchors`, `ids`, `sizes`, `text` (compressed) and `places` (how many) are by context, and `rows` and `starts` by place. Rows
    without text are runs that go: `rows`, `starts` and `windows`.
    """

    def run(rows: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        if rows.empty or answers.empty:
            return pd.DataFrame()
        number = int(rows["shard"].iloc[0])
        shard = Shard(rows, length, buckets)
        answers = answers.sort_values("bucket")
        known = np.concatenate([np.frombuffer(k, np.uint32).astype(np.uint64) | np.uint64(b) << np.uint64(32) for b, k in zip(answers["bucket"].astype(int), answers["keys"], strict=True)])
        hot = np.concatenate([np.frombuffer(h, bool) for h in answers["hot"]])
        at = np.minimum(np.searchsorted(known, shard.anchor), len(known) - 1)
        hits = np.flatnonzero(known[at] == shard.anchor)
        single = hot[at[hits]]
        # Context: smallest id, the places where that has it, bucket and anchor there.
        held: dict[bytes, list] = {}
        gone: list[tuple[int, int, int]] = []

        def meet(text: bytes, anchor: int | None, doc: int, place: tuple[int, int]) -> None:
            own = held.get(text)
            if own is None:
                anchor = crc32(text) % buckets << 32 | crc32(text) if anchor is None else anchor
                held[text] = [doc, [place], anchor >> 32, anchor & 0xFFFFFFFF]
            elif doc > own[0]:
                gone.append((*place, len(text) - length + 1))
            elif doc == own[0]:
                own[1].append(place)
            else:
                gone.extend((*p, len(text) - length + 1) for p in own[1])
                own[:2] = doc, [place]

        many = shard.bytes
        row_of = shard.row[hits]
        found = (row_of, shard.ids[row_of], shard.anchor[hits], shard.first[hits], shard.first[hits] - shard.offsets[row_of], shard.windows[hits], single)
        for row, doc, anchor, first, start, n, alone in zip(*(x.tolist() for x in found), strict=True):
            if alone:
                for k in range(n):
                    meet(many[first + k : first + k + length], None, doc, (row, start + k))
            else:
                meet(many[first : first + n + length - 1], anchor, doc, (row, start))
        packed = zstandard.ZstdCompressor(3)
        by_bucket: dict[int, list[tuple[bytes, list]]] = {}
        for text, own in held.items():
            by_bucket.setdefault(own[2], []).append((text, own))
        out = []
        for bucket, own in by_bucket.items():
            places = np.array([p for _, c in own for p in c[1]], np.int32)
            out.append((
                bucket, number, np.array([c[3] for _, c in own], np.uint32).tobytes(), np.array([c[0] for _, c in own], np.int64).tobytes(), np.array([len(t) for t, _ in own], np.int32).tobytes(), packed.compress(b"".join(t for t, _ in own)),
                np.array([len(c[1]) for _, c in own], np.int32).tobytes(), places[:, 0].tobytes(), places[:, 1].tobytes(), None,
            ))
        if gone:
            cut = np.array(gone, np.int32)
            out.append((number % buckets, number, None, None, None, None, None, cut[:, 0].tobytes(), cut[:, 1].tobytes(), cut[:, 2].tobytes()))
        return _frame(out, CONTEXTS)

    return texts.groupBy("shard").cogroup(answers.groupBy("shard")).applyInPandas(run, CONTEXTS)


def decided(contexts: DataFrame, length: int) -> DataFrame:
    """(shard, rows, starts, windows): the runs of windows that go, by the suffix arrays of each bucket's contexts."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        out = [(r.shard, r.rows, r.starts, r.windows) for r in rows.itertuples(index=False) if r.text is None]
        # Each different context once, with its smallest id.
        unpacked = zstandard.ZstdDecompressor()
        found: dict[bytes, int] = {}
        own = []
        for r in rows.itertuples(index=False):
            if r.text is None:
                continue
            sizes, every = np.frombuffer(r.sizes, np.int32), unpacked.decompress(r.text)
            ends = np.cumsum(sizes, dtype=np.int64)
            numbers = [found.setdefault(every[a:b], len(found)) for a, b in zip((ends - sizes).tolist(), ends.tolist(), strict=True)]
            own.append((r.shard, np.array(numbers, np.int64), np.frombuffer(r.ids, np.int64), np.frombuffer(r.anchors, np.uint32), np.frombuffer(r.places, np.int32), np.frombuffer(r.rows, np.int32), np.frombuffer(r.starts, np.int32)))
        if found:
            texts = list(found)
            del found
            windows = np.fromiter(map(len, texts), np.int64, len(texts)) - (length - 1)
            least, anchors = np.full(len(texts), np.iinfo(np.int64).max), np.zeros(len(texts), np.int64)
            for _, numbers, ids, own_anchors, *_ in own:
                np.minimum.at(least, numbers, ids)
                anchors[numbers] = own_anchors
            # A context that is its anchor's only one shares no window with any other.
            _, of, number = np.unique(anchors, return_inverse=True, return_counts=True)
            met = np.flatnonzero(number[of] > 1)
            context, begin, size = sorted_shards([texts[n] for n in met], least[met], anchors[met], length)
            first = np.searchsorted(met[context], np.arange(len(texts) + 1))
            for shard, numbers, ids, _, places, in_rows, starts in own:
                # A larger id than the context's smallest loses all of its windows, in one run.
                larger = ids > least[numbers]
                each = np.where(larger, 1, first[numbers + 1] - first[numbers])
                to = np.repeat(np.arange(len(numbers)), places)
                runs = each[to]
                total = int(runs.sum())
                if total:
                    place = np.repeat(np.arange(len(to)), runs)
                    of_run = to[place]
                    whole = larger[of_run]
                    at = np.where(whole, 0, first[numbers[of_run]] + np.arange(total) - np.repeat(np.cumsum(runs) - runs, runs))
                    from_, long = (np.append(x, 0)[np.minimum(at, len(x))] for x in (begin, size))
                    out.append((shard, in_rows[place].astype(np.int32).tobytes(), (starts[place] + np.where(whole, 0, from_)).astype(np.int32).tobytes(), np.where(whole, windows[numbers[of_run]], long).astype(np.int32).tobytes()))
        return _frame(out, GONE)

    return contexts.groupBy("bucket").applyInPandas(run, GONE)


def cut_texts(texts: DataFrame, runs: DataFrame, length: int) -> DataFrame:
    """Each text with the spans that go, and what is kept."""

    def run(rows: pd.DataFrame, runs: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("uid", ignore_index=True)
        sizes = np.fromiter(map(len, rows["body"]), np.int64, len(rows))
        offsets = np.cumsum(sizes) - sizes
        change = np.zeros(int(sizes.sum()) + 1, np.int32)
        for r in runs.itertuples(index=False):
            begin = offsets[np.frombuffer(r.rows, np.int32)] + np.frombuffer(r.starts, np.int32)
            np.add.at(change, begin, 1)
            np.add.at(change, begin + np.frombuffer(r.windows, np.int32) + (length - 1), -1)
        goes = np.cumsum(change) > 0
        out = []
        for doc_id, body, a, n in zip(rows["doc_id"], rows["body"], offsets.tolist(), sizes.tolist(), strict=True):
            own = goes[a : a + n]
            edge = np.flatnonzero(np.diff(own, prepend=False, append=False)).tolist()
            kept = np.frombuffer(body, np.uint8)[~own].tobytes() if edge else body
            out.append((doc_id, n, [{"start": x, "end": y} for x, y in zip(edge[::2], edge[1::2], strict=True)], kept))
        return pd.DataFrame(out, columns=["doc_id", "n_bytes", "spans", "kept"]) if out else pd.DataFrame()

    return texts.groupBy("shard").cogroup(runs.groupBy("shard")).applyInPandas(run, RESULT)


def sharded(rows: DataFrame, total: int) -> DataFrame:
    """`rows` (doc_id, body) as a table in the shared folder, bucketed by shard, so that reading a shard moves nothing."""
    spark = rows.sparkSession
    size = min(16 << 20, max(1 << 20, 32 * math.isqrt(total)))
    shards, tasks = total // size + 1, min(MAX_TASKS, total // TASK_BYTES + 1)
    name = f"shards_{uuid.uuid4().hex}"
    dealt = rows.withColumn("uid", F.monotonically_increasing_id()).withColumn("shard", F.pmod(F.xxhash64("uid"), F.lit(shards)).cast("int"))
    with small_batches(spark):
        to = dealt.repartition(tasks, "shard").write.bucketBy(tasks, "shard").sortBy("shard", "uid")
        to.option("compression", "zstd").option("path", shared_path(spark, name)).saveAsTable(name)
    return spark.table(name)


def repeated_passages(docs: DataFrame, length: int = LENGTH, id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes, spans (start and end in bytes; what goes) and kept (bytes) of every row of `docs`."""
    if not ANCHOR <= length <= 1 << 15:
        raise ValueError(f"a length is {ANCHOR} to {1 << 15} bytes")
    rows = docs.select(named(id).cast("long").alias("doc_id"), F.coalesce(named(text).cast("string").cast("binary"), F.lit(b"")).alias("body"))
    alone = rows.where("doc_id IS NULL").select("doc_id", F.length("body").cast("long").alias("n_bytes"), F.array().cast("array<struct<start: long, end: long>>").alias("spans"), F.col("body").alias("kept"))
    rows = rows.where("doc_id IS NOT NULL")
    total = rows.agg(F.sum(F.length("body").cast("long"))).first()[0] or 0
    texts = sharded(rows, total)
    buckets = total // BUCKET_BYTES + 1
    answers = answered(asked(texts, length, buckets))
    runs = decided(exported(texts, answers, length, buckets), length)
    return cut_texts(texts, runs, length).union(alone)


def op11_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeated_passages(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


OP11_SQL = """
WITH bytes AS (SELECT row_number() OVER () AS rid, doc_id, encode(coalesce("text", '')) AS b FROM documents),
hexed AS (SELECT rid, doc_id, hex(b) AS h, octet_length(b) AS n FROM bytes),
windows AS (SELECT rid, doc_id, i, substr(h, CAST(2 * i + 1 AS INT), 100) AS w FROM (SELECT *, unnest(generate_series(0, n - 50)) AS i FROM hexed WHERE n >= 50)),
least AS (SELECT md5(w) AS k, min(doc_id) AS first FROM windows GROUP BY w),
gone AS (SELECT DISTINCT rid, i FROM windows JOIN least ON md5(w) = k WHERE doc_id > first),
steps AS (SELECT rid, i, i - coalesce(lag(i) OVER (PARTITION BY rid ORDER BY i), -100) AS gap FROM gone),
islands AS (SELECT rid, i, sum(CASE WHEN gap > 50 THEN 1 ELSE 0 END) OVER (PARTITION BY rid ORDER BY i) AS island FROM steps),
spans AS (SELECT rid, island, min(i) AS a, max(i) + 50 AS z FROM islands GROUP BY rid, island),
gaps AS (SELECT rid, a, z, lag(z, 1, 0) OVER (PARTITION BY rid ORDER BY a) AS before FROM spans),
cut AS (
  SELECT rid, sum(z - a) AS n_removed, count(*) AS n_spans, max(z) AS last,
    string_agg(substr(h, CAST(2 * before + 1 AS INT), CAST(2 * (a - before) AS INT)), '' ORDER BY a) AS kept
  FROM gaps JOIN hexed USING (rid) GROUP BY rid
)
SELECT doc_id, n AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
  sha256(unhex(CASE WHEN n_spans IS NULL THEN h ELSE kept || substr(h, CAST(2 * last + 1 AS INT)) END)) AS kept_sha256
FROM hexed LEFT JOIN cut USING (rid)
"""
