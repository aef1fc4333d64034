"""Near-duplicate groups by an LSH forest of sorted MinHash signatures.

1. Each text becomes the set of its word shingles. Equal sets form a class; only classes go on, so copies cost nothing.
2. A class has SIGNATURE minima of 16 bits. Order t of the forest sorts all classes by the signature rotated to its own
   part, TREES orders in all. The sort is a range partitioning: however many classes share a prefix, they are spread.
3. In each order a class meets its NEIGHBOURS next ones that share LEAST_DEPTH minima at least with it. Where few
   classes share a prefix, all of them meet; where many do, those with longer common prefixes stand nearer, so the depth
   at which classes meet grows with the density of their region.
4. Candidate pairs are merged over the orders, and those whose set sizes or whole signatures rule the wanted similarity
   out (by FAR_OFF standard deviations) leave.
5. The rest are confirmed on full sets made from the texts: first, in a few rounds, each class with its most similar
   partner of another component; then all pairs whose classes are still in different ones. Links inside a component
   change nothing.
6. Classes whose windows were full may have partners that no window showed. All classes of one prefix with full windows
   meet in blocks, however many there are; those that may be similar to one of another component meet once more in all
   orders, where sketches of SKETCH bits tell which pairs may still be links between components; those are confirmed too.
   So a link is missed by chance of hashing only (no common prefix in any order, or FAR_OFF deviations), not by density.
   Work in a region is quadratic in its classes of one prefix, and so are the rows that blocks ship, a BLOCK-th of it.
   `exact=True` leaves nothing to chance.

Components are named on classes; members then look their class up, which is broadcast where it is hot.

Defined cases: a text without words, or null, has an empty set and no link; fewer words than a shingle has make one
shingle; a very long text is held whole by a task, as its set of 8 bytes a shingle; equal rows are members of one class;
a null doc_id is a row of its own, and a component's id is its least doc_id that is not null; an empty table gives an
empty result; other columns are not read, and are kept by the stage. In the stage all texts without words stay.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checkpointed, looked_up, named, stored, words_of
from .components import components

TREES = 16
DEPTH = 16
LEAST_DEPTH = 3
NEIGHBOURS = 3
SIGNATURE = 96
FAR_OFF = 4.5
#: Before all remaining pairs are confirmed, so often each class tries its most similar partner of another component.
ROUNDS = 3
#: For dense regions: how many minima of one bit tell rows from each other.
SKETCH = 8192
#: All pairs of so many rows of one prefix are met by one task.
BLOCK = 1024
#: What tells rows apart: whether the id is null, the id (0 for null) and a hash of the text.
KEY = ["_none", "_id", "_hash"]
#: Hashes computed at once.
CELLS = 1 << 18
MEMO = 100_000

_rng = np.random.default_rng(20240229)
_ODD = (_rng.integers(0, 1 << 63, SIGNATURE, np.uint64) << np.uint64(1)) | np.uint64(1)
_ADD = _rng.integers(0, 1 << 63, SIGNATURE, np.uint64)
_ODD_32 = (_rng.integers(0, 1 << 31, SKETCH, np.uint32) << np.uint32(1)) | np.uint32(1)
_ADD_32 = _rng.integers(0, 1 << 32, SKETCH, np.uint32)
_MIX = np.uint64(0x9E3779B97F4A7C15)


class WordHashes(dict):
    """64-bit hashes of words, each computed once."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > MEMO:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


@lru_cache(1)
def word_hashes() -> WordHashes:
    """One memory for all tasks of a worker."""
    return WordHashes()


def shingles(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's word shingles; the whole sequence if it is shorter than one."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    one = np.fromiter(map(word_hashes().__getitem__, parts), np.uint64, len(parts))
    k = min(words, len(one))
    out = one[: len(one) - k + 1].copy()
    for j in range(1, k):
        out ^= out >> np.uint64(29)
        out *= _MIX
        out += one[j : len(one) - k + 1 + j]
    if k < words:
        out += np.uint64(k)
    return np.unique(out)


def signature(held: np.ndarray) -> bytes:
    """SIGNATURE minima of a set, mixed to 16 bits each, big-endian so that bytes sort as numbers do."""
    least = np.full(SIGNATURE, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(held), CELLS // SIGNATURE):
        part = held[k : k + CELLS // SIGNATURE]
        np.minimum(least, (_ODD[:, None] * (part ^ (part >> np.uint64(31)))[None, :] + _ADD[:, None]).min(axis=1), out=least)
    return ((least * _MIX) >> np.uint64(40)).astype(">u2").tobytes()


def sketch(held: np.ndarray) -> bytes:
    """SKETCH further minima of 32 bits, of which each gives one bit."""
    short = (held >> np.uint64(32)).astype(np.uint32)
    least = np.full(SKETCH, np.iinfo(np.uint32).max, np.uint32)
    for k in range(0, len(short), CELLS // SKETCH):
        part = short[k : k + CELLS // SKETCH]
        np.minimum(least, (_ODD_32[:, None] * part[None, :] + _ADD_32[:, None]).min(axis=1), out=least)
    least = (least ^ (least >> np.uint32(15))) * np.uint32(0x9E3779B1)
    return np.packbits((least >> np.uint32(20)).astype(np.uint8) & 1).tobytes()


def _signed(words: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            sizes, keys, signs = [], [], []
            for text in batch["_text"]:
                held = shingles(text, words)
                sizes.append(len(held))
                keys.append(xxhash.xxh3_128_digest(held.tobytes()) if len(held) else None)
                signs.append(signature(held) if len(held) else None)
            yield pd.DataFrame({"_none": batch["_none"], "_id": batch["_id"], "_hash": batch["_hash"], "n": np.array(sizes, np.int64), "node": keys, "sign": signs})

    return run


def _meet(width: int):
    """Rows in sorted order: pairs of rows at most `width` apart, and the rows at either end, which meet other partitions' rows."""
    columns = ["tree", "key", "node"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows, first, left = None, [], width
        for batch in batches:
            if not len(batch):
                continue
            if left:
                first.append(batch[:left])
                left -= len(first[-1])
            had = 0 if rows is None else len(rows)
            rows = batch if rows is None else pd.concat([rows, batch], ignore_index=True)
            trees, nodes = rows["tree"].to_numpy(), rows["node"].to_numpy(object)
            keys = np.frombuffer(b"".join(rows["key"]), ">u2").reshape(-1, DEPTH).astype(np.uint16)
            for j in range(1, width + 1):
                right = np.arange(max(j, had), len(rows))
                near = (keys[right, :LEAST_DEPTH] == keys[right - j, :LEAST_DEPTH]).all(axis=1) & (trees[right] == trees[right - j])
                right = right[near]
                if not len(right):
                    break  # rows further off share no more
                x, y = nodes[right], nodes[right - j]
                less = np.array([u < v for u, v in zip(x, y, strict=True)], bool)
                yield pd.DataFrame({"a": np.where(less, x, y), "b": np.where(less, y, x), "step": np.int32(j), **dict.fromkeys(columns), "tree": trees[right]})
            rows = rows[-width:].reset_index(drop=True)
        if rows is not None:
            ends = pd.concat([*first, rows]).drop_duplicates(["tree", "node"])
            yield ends.assign(a=None, b=None, step=np.int32(0))[["a", "b", "step", *columns]]

    return run


MEET = "a binary, b binary, step int, tree int, key binary, node binary"


def orders(classes: DataFrame, starts: list[int], width: int) -> DataFrame:
    """(a, b, step, tree): near rows of the orders that begin at these places of the signature."""
    order = F.explode(F.array(*[F.struct(F.lit(s).alias("tree"), F.substring(F.concat("sign", "sign"), 2 * s + 1, 2 * DEPTH).alias("key")) for s in starts]))
    rows = classes.select("node", order.alias("o")).select("o.tree", "o.key", "node")
    met = stored(rows.repartitionByRange("tree", "key", "node").sortWithinPartitions("tree", "key", "node").mapInPandas(_meet(width), MEET))
    # The two ends of each partition are filtered where they lie: a few rows for each partition go to one task.
    ends = met.where("a IS NULL").drop("a", "b", "step").repartition(1).sortWithinPartitions("tree", "key", "node").mapInPandas(_meet(width), MEET)
    return met.where("a IS NOT NULL").union(ends.where("a IS NOT NULL")).select("a", "b", "step", "tree")


def _bar(places: int, percent: int, chance: float = 0.0) -> float:
    """Fewest agreeing places, of so many, that sets of this similarity show but for FAR_OFF deviations; `chance`: that others agree."""
    share = percent / 100 + (1 - percent / 100) * chance
    return places * share - FAR_OFF * (places * share * (1 - share)) ** 0.5


def _likeness(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        x, y = (np.frombuffer(b"".join(batch[c]), np.uint16).reshape(-1, SIGNATURE) for c in ("sign_a", "sign_b"))
        yield pd.DataFrame({"a": batch["a"], "b": batch["b"], "alike": (x == y).sum(axis=1).astype(np.int32)})


def plausible(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs (a, b, alike) that may be similar enough by their sets' sizes and their signatures."""
    of = lambda end: classes.select(F.col("node").alias(end), F.col("n").alias(f"n_{end}"), F.col("sign").alias(f"sign_{end}"))
    rows = pairs.select("a", "b").distinct().join(of("a"), "a").join(of("b"), "b")
    rows = rows.where(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
    rows = rows.select("a", "b", "sign_a", "sign_b").mapInPandas(_likeness, "a binary, b binary, alike int")
    return rows.where(F.col("alike") >= _bar(SIGNATURE, percent))


def _groups(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sorted rows, a frame for each (tree, prefix, lo, hi)."""
    rows = None
    for batch in batches:
        rows = batch if rows is None or not len(rows) else pd.concat([rows, batch], ignore_index=True)
        if not len(rows):
            continue
        keys = [rows[c].to_numpy() for c in ("tree", "prefix", "lo", "hi")]
        new = np.zeros(len(rows) - 1, bool)
        for k in keys:
            new |= k[1:] != k[:-1]
        cuts = [0, *(np.flatnonzero(new) + 1)]
        for x, y in zip(cuts, cuts[1:], strict=False):
            yield rows[x:y]
        rows = rows[cuts[-1] :].reset_index(drop=True)
    if rows is not None and len(rows):
        yield rows


def _pairs(group: pd.DataFrame, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of all pairs of a block, or of two, that have different roots and may be similar enough by sizes and signatures."""
    n, own, root = group["n"].to_numpy(), group["own"].to_numpy(), pd.factorize(group["root"])[0]
    signs = np.frombuffer(b"".join(group["sign"]), np.uint16).reshape(-1, SIGNATURE)
    lo, hi = group["lo"].iat[0], group["hi"].iat[0]
    left, right = np.flatnonzero(own == lo), np.flatnonzero(own == hi)
    at = max(1, CELLS // max(1, len(right)))
    across = np.ascontiguousarray(signs[right].T)
    for k in range(0, len(left), at):
        x = left[k : k + at]
        good = (root[x][:, None] != root[right]) & (100 * np.minimum(n[x][:, None], n[right]) >= percent * np.maximum(n[x][:, None], n[right]))
        if lo == hi:
            good &= x[:, None] < right
        if good.any():
            alike = np.zeros(good.shape, np.uint8)
            for i in range(SIGNATURE):
                alike += signs[x, i][:, None] == across[i]
            u, v = np.nonzero(good & (alike >= _bar(SIGNATURE, percent)))
            if len(u):
                yield x[u], right[v]


def _crowded(percent: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group in _groups(batches):
            hit = np.zeros(len(group), bool)
            for x, y in _pairs(group, percent):
                hit[x] = hit[y] = True
            if hit.any():
                yield pd.DataFrame({"node": group["node"].to_numpy(object)[hit]})

    return run


def _linked(percent: int):
    """Pairs whose sketches agree too, each in the first order where its rows have one prefix."""
    part, bar = SIGNATURE // TREES, _bar(SKETCH, percent, 0.5)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group in _groups(batches):
            signs = np.frombuffer(b"".join(group["sign"]), np.uint16).reshape(-1, SIGNATURE)
            held = np.frombuffer(b"".join(group["sketch"]), np.uint64).reshape(len(group), -1)
            nodes, tree = group["node"].to_numpy(object), group["tree"].iat[0] // part
            for left, right in _pairs(group, percent):
                for k in range(0, len(left), 4096):
                    x, y = left[k : k + 4096], right[k : k + 4096]
                    first = (signs[x] == signs[y]).reshape(-1, TREES, part)[:, :, :LEAST_DEPTH].all(axis=2).argmax(axis=1) == tree
                    x, y = x[first], y[first]
                    good = SKETCH - np.bitwise_count(held[x] ^ held[y]).sum(axis=1, dtype=np.int64) >= bar
                    if good.any():
                        x, y = nodes[x[good]], nodes[y[good]]
                        less = np.array([u < v for u, v in zip(x, y, strict=True)], bool)
                        yield pd.DataFrame({"a": np.where(less, x, y), "b": np.where(less, y, x)})

    return run


def in_blocks(keyed: DataFrame, classes: DataFrame, block: int) -> DataFrame:
    """Rows of `classes` (node and others) dealt so that all pairs of a (tree, prefix) of `keyed` with more than one root meet.

    A group of many rows is cut into blocks of about `block`, of which any two meet in a task: no group is too large, and
    no pair is left out. `keyed` has tree, prefix, node and root.
    """
    sizes = keyed.groupBy("tree", "prefix").agg(F.count(F.lit(1)).alias("size"), F.min("root").alias("r0"), F.max("root").alias("r1"))
    sizes = sizes.where("r0 != r1").select("tree", "prefix", F.ceil(F.col("size") / block).cast("int").alias("blocks"))
    dealt = keyed.join(sizes, ["tree", "prefix"]).withColumn("own", F.expr("cast(pmod(xxhash64(node), blocks) AS int)"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    keys = ["tree", "prefix", "lo", "hi"]
    dealt = dealt.select("tree", "prefix", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "node", "root")
    return dealt.join(classes, "node").repartition(*keys).sortWithinPartitions(*keys)


def _prefix(tree: Column) -> Column:
    return F.substring(F.col("sign"), 2 * tree + 1, F.lit(2 * LEAST_DEPTH))


def crowded(full: DataFrame, classes: DataFrame, roots: DataFrame, percent: int, block: int) -> DataFrame:
    """Classes that may be similar enough to one of another component beside which they stand in an order, at whatever distance.

    A pair of one prefix that no window showed has more than NEIGHBOURS rows between its ends, so both are `full` there.
    """
    keyed = full.join(classes.select("node", "sign"), "node").join(roots, "node", "left")
    keyed = keyed.select("tree", _prefix(F.col("tree")).alias("prefix"), "node", F.coalesce("root", "node").alias("root"))
    return in_blocks(keyed, classes.select("node", "n", "sign"), block).mapInPandas(_crowded(percent), "node binary").distinct()


def linked(dense: DataFrame, percent: int, block: int) -> DataFrame:
    """(a, b): all pairs of different roots that have one prefix in some order and may be similar enough by sizes, signatures and sketches."""
    starts = F.explode(F.array(*[F.lit(t * (SIGNATURE // TREES)) for t in range(TREES)])).alias("tree")
    keyed = dense.select("node", "root", "sign", starts).select("tree", _prefix(F.col("tree")).alias("prefix"), "node", "root")
    return in_blocks(keyed, dense.drop("root"), block).mapInPandas(_linked(percent), "a binary, b binary")


def _sketched(words: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.drop(columns="text").assign(sketch=[sketch(shingles(t, words)) for t in batch["text"]])

    return run


def _confirm(words: int, percent: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            held: dict[bytes, np.ndarray] = {}
            good = []
            for a, b, x, y in zip(batch["a"], batch["b"], batch["text_a"], batch["text_b"], strict=True):
                for node, text in ((a, x), (b, y)):
                    if node not in held:
                        if len(held) > 2000:
                            held.clear()
                        held[node] = shingles(text, words)
                u, v = (held[n] if n in held else shingles(t, words) for n, t in ((a, x), (b, y)))
                both = len(np.intersect1d(u, v, assume_unique=True))
                good.append(100 * both >= percent * (len(u) + len(v) - both))
            yield batch.loc[np.array(good, bool), ["a", "b"]]

    return run


def confirmed(pairs: DataFrame, texts: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs whose full sets are similar enough. A class stands in few pairs, by the windows' width."""
    of = lambda end: texts.select(F.col("node").alias(end), F.col("text").alias(f"text_{end}"))
    rows = pairs.select("a", "b").join(of("a"), "a").join(of("b"), "b")
    return rows.mapInPandas(_confirm(words, percent), "a binary, b binary")


def _closest(pairs: DataFrame) -> DataFrame:
    """Each class's pair with the most alike of its partners."""
    ends = pairs.select("a", "b", "alike").union(pairs.select("b", "a", "alike").toDF("a", "b", "alike"))
    best = ends.groupBy("a").agg(F.max(F.struct("alike", "b")).alias("o"))
    return best.select(F.least("a", "o.b").alias("a"), F.greatest("a", "o.b").alias("b")).distinct()


def ends_of(pairs: DataFrame, *by: str) -> DataFrame:
    """Each node that is an end of some pair once (for each value of `by`): either side is made distinct before the two meet."""
    of = lambda end: pairs.select(F.col(end).alias("node"), *by).distinct()
    return of("a").union(of("b")).distinct()


def _apart(pairs: DataFrame, roots: DataFrame, full: DataFrame) -> DataFrame:
    """The pairs whose ends are not yet in one component, and whether both ends are among `full`."""
    known = roots.join(full.withColumn("full", F.lit(True)), "node", "full")
    rows = pairs
    for end in ("a", "b"):
        rows = rows.join(known.select(F.col("node").alias(end), F.col("root").alias(f"root_{end}"), F.col("full").alias(f"full_{end}")), end, "left")
    is_full = [F.coalesce(f"full_{end}", F.lit(False)) for end in ("a", "b")]
    rows = rows.withColumn("root_a", F.coalesce("root_a", "a")).withColumn("root_b", F.coalesce("root_b", "b"))
    return rows.where("root_a != root_b").select(*pairs.columns, "root_a", "root_b", (is_full[0] & is_full[1]).alias("both_full"))


def _identity(docs: DataFrame, text: str) -> list[Column]:
    id, body = F.col("doc_id").cast("long"), named(text).cast("string")
    return [id.isNull().alias("_none"), F.coalesce(id, F.lit(0)).cast("long").alias("_id"), F.xxhash64(body).alias("_hash"), body.alias("_text")]


def _texts(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """node and text: one text for each class. Rows that repeat an id and a text are alike."""
    reps = classes.select("node", *KEY)
    return stored(rows.join(reps, KEY).select("node", F.col("_text").alias("text")).dropDuplicates(["node"]))


def forest_roots(rows: DataFrame, classes: DataFrame, words: int, percent: int) -> DataFrame:
    """(node, root) by the forest; classes that are linked with none may be missing."""
    part = SIGNATURE // TREES
    met = orders(classes, [t * part for t in range(TREES)], NEIGHBOURS)
    likely = checkpointed(plausible(met, classes, percent))
    wanted = ends_of(likely)
    texts = _texts(rows, classes.join(wanted, "node", "left_semi"))

    # Pairs of which both ends had a full window somewhere wait for the second search; the others are confirmed at once.
    full = checkpointed(ends_of(met.where(F.col("step") == NEIGHBOURS), "tree"))
    full_nodes = full.select("node").distinct()
    roots = texts.select("node", F.col("node").alias("root"))
    apart = likely
    for _ in range(ROUNDS):
        picked = checkpointed(_closest(apart))
        roots = joined(roots, confirmed(picked, texts, words, percent))
        untried = apart.select("a", "b", "alike").join(picked, ["a", "b"], "left_anti")
        apart = checkpointed(_apart(untried, roots, full_nodes))
    roots = joined(roots, confirmed(apart.where("NOT both_full"), texts, words, percent))
    # Searched again is what had full windows, whether they showed a likely partner or not.
    waiting = ends_of(apart.where("both_full"))
    dense = checkpointed(crowded(full, classes, roots, percent, BLOCK).union(waiting).distinct())
    if dense.take(1):
        late = classes.join(dense, "node", "left_semi").join(wanted, "node", "left_anti")
        texts = texts.union(_texts(rows, late))
        dense = classes.select("node", "n", "sign").join(dense, "node").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")).join(texts, "node")
        dense = stored(dense.mapInPandas(_sketched(words), "node binary, n long, sign binary, root binary, sketch binary"))
        # Every pair of one prefix meets, and so does every pair that was put off.
        more = linked(dense, percent, BLOCK)
        roots = joined(roots, confirmed(more, texts, words, percent))
    return roots


def _shingled(words: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for node, text in zip(batch["node"], batch["text"], strict=True):
                held = shingles(text, words)
                for k in range(0, len(held), CELLS):
                    part = held[k : k + CELLS].view(np.int64)
                    yield pd.DataFrame({"node": [node] * len(part), "shingle": part, "n": np.full(len(part), len(held), np.int64)})

    return run


def _sized(percent: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for group in _groups(batches):
            nodes, n, own = group["node"].to_numpy(object), group["n"].to_numpy(), group["own"].to_numpy()
            lo, hi = group["lo"].iat[0], group["hi"].iat[0]
            right = np.flatnonzero(own == hi)
            for x in np.flatnonzero(own == lo):
                good = right[100 * np.minimum(n[x], n[right]) >= percent * np.maximum(n[x], n[right])]
                good = good[good > x] if lo == hi else good
                if len(good):
                    ends = [sorted((nodes[x], y)) for y in nodes[good]]
                    yield pd.DataFrame({"a": [e[0] for e in ends], "b": [e[1] for e in ends]})

    return run


def exact_roots(rows: DataFrame, classes: DataFrame, words: int, percent: int) -> DataFrame:
    """(node, root) without chance: two sets that are similar enough share one of their rarest shingles.

    With shingles in order of frequency, a set of n needs its first n - ceil(n * percent / 100) + 1 only. Classes that share
    such a shingle meet in blocks, however many they are; all pairs that sizes allow are confirmed. It costs far more than
    the forest where texts share much.
    """
    texts = _texts(rows, classes)
    held = checkpointed(texts.mapInPandas(_shingled(words), "node binary, shingle long, n long"))
    counts = held.groupBy("shingle").agg(F.count(F.lit(1)).alias("many"))
    total = held.count()
    met = looked_up(held, counts.withColumn("rows", F.col("many")), "shingle", "rows", total, nulls=False)
    place = F.row_number().over(Window.partitionBy("node").orderBy("many", "shingle"))
    prefix = met.withColumn("place", place).where(F.col("place") <= F.col("n") - F.ceil(F.col("n") * percent / 100) + 1)
    keyed = prefix.where("many > 1").select(F.lit(0).alias("tree"), F.col("shingle").alias("prefix"), "node", F.col("node").alias("root"))
    pairs = in_blocks(keyed, classes.select("node", "n"), BLOCK).mapInPandas(_sized(percent), "a binary, b binary").distinct()
    return joined(texts.select("node", F.col("node").alias("root")), confirmed(pairs, texts, words, percent))


def grouped(docs: DataFrame, words: int = 5, percent: int = 80, text: str = "text", exact: bool = False) -> DataFrame:
    """A row for each of `docs`: KEY, n (set size), component (least id; null where none has an id),
    and whether the row was chosen of its component: one id and text of each, or any row with an empty set.

    Documents are linked where 100 * intersection >= percent * union of their sets. With `exact`, candidates come from the
    rarest shingles, so that no link is missed, in place of the forest.
    """
    rows = docs.select(*_identity(docs, text))
    signed = checkpointed(rows.mapInPandas(_signed(words), "_none boolean, _id long, _hash long, n long, node binary, sign binary"))
    # A row without an id stands for its class only where no other does.
    least = F.min(F.struct(*KEY, "n", "sign")).alias("_least")
    members = F.count(F.lit(1)).alias("members")
    classes = checkpointed(signed.where("node IS NOT NULL").groupBy("node").agg(least, members).select("node", "members", "_least.*"))
    roots = (exact_roots if exact else forest_roots)(rows, classes, words, percent)

    # Named on classes: each component's least row, then each class's.
    rooted = classes.select("node", "members", F.struct(*KEY).alias("own")).join(roots, "node", "left")
    rooted = checkpointed(rooted.select("node", "members", "own", F.coalesce("root", "node").alias("root")))
    least = rooted.groupBy("root").agg(F.min("own").alias("least"), F.count(F.lit(1)).alias("classes"))
    of_class = checkpointed(looked_up(rooted.select("node", "members", "root"), least, "root", "classes", rooted.count()).select("node", "members", "least"))
    out = looked_up(signed.select(*KEY, "n", "node"), of_class, "node", "members", signed.count())
    own = F.struct(*KEY)
    named_by = F.coalesce("least", own)
    return out.select(*KEY, "n", F.when(~named_by["_none"], named_by["_id"]).alias("component"), (named_by == own).alias("chosen"))


def joined(roots: DataFrame, links: DataFrame) -> DataFrame:
    """The components of links on top of those there are."""
    links = checkpointed(links)
    return components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(links)) if links.take(1) else roots


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, text: str = "text", exact: bool = False) -> DataFrame:
    """doc_id, n_shingles, component_id and kept (the document is its component's least) for each row of `docs`."""
    doc_id = F.when(~F.col("_none"), F.col("_id"))
    rows = grouped(docs, words, percent, text, exact)
    return rows.select(doc_id.alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), doc_id.eqNullSafe(F.col("component")).alias("kept"))


def neardup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: one document of each group stays, with its own columns, and every one without words."""
    kept = grouped(docs).where("chosen AND n > 0").select(*KEY).distinct()
    empty = F.size(words_of(named("text").cast("string"))) == 0
    rows = docs.where(~empty).select(F.struct(*map(named, docs.columns)).alias("_row"), *_identity(docs, "text")[:3])
    # Rows without an id may be many of one text: they are few already when they are joined.
    rows = rows.where("NOT _none").union(rows.where("_none").dropDuplicates(KEY))
    # The join brings equal rows together; one of them stays.
    first = rows.join(kept, KEY).dropDuplicates(KEY)
    return first.select("_row.*").union(docs.where(empty))


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), words=2, percent=80)


#: By all shingles that two distinct sets share; components by spreading least ids. For small tables.
OP5_SQL = r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(translate(coalesce("text", ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
s AS (
  SELECT rid, doc_id, CASE len(w) WHEN 0 THEN [] WHEN 1 THEN [w[1]]
    ELSE list_sort(list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) END AS held FROM d),
sets AS (SELECT held, len(held) AS n, min(doc_id) AS c FROM s WHERE len(held) > 0 GROUP BY held),
x AS (SELECT c, n, unnest(held) AS shingle FROM sets),
links AS (
  SELECT a.c AS u, b.c AS v FROM x a JOIN x b ON a.shingle = b.shingle AND a.c < b.c AND 100 * a.n >= 80 * b.n AND 100 * b.n >= 80 * a.n
  GROUP BY a.c, b.c, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
ends AS (SELECT u, v FROM links UNION ALL SELECT v, u FROM links),
reach AS (SELECT c AS u, c AS root FROM sets UNION SELECT ends.v, reach.root FROM reach JOIN ends USING (u)),
named AS (SELECT u, min(root) AS root FROM reach GROUP BY u)
SELECT doc_id, CAST(len(s.held) AS BIGINT) AS n_shingles, coalesce(root, doc_id) AS component_id, doc_id = coalesce(root, doc_id) AS kept
FROM s LEFT JOIN sets USING (held) LEFT JOIN named ON named.u = sets.c
"""
