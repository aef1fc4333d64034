"""Approximate nearest neighbours: a hierarchical navigable small-world graph per shard, with the shards' results merged.

Vectors go to shards by a hash of their ids, so a hot label or vector is spread evenly; shards grow as the square root of
the table, up to SHARD_BYTES of vectors. A shard's graph is one row of a table: flat arrays of vectors, of each level's
nodes and of their neighbours. Within a shard equal vectors are one node, which lists its ids.

Building. Nodes come in seeded order, with geometric random levels, and are put in by searching what is there already:
down the upper levels greedily, then with a beam of BUILD_BEAM nodes on each level that the node has. Of the beam a node
keeps up to half the degree by the diversity rule (a candidate must be nearer to the node than to any kept one) and is
linked back; lists that grow too long are chosen anew by the same rule. Nodes are put in by batches, which grow with the
graph, so that numpy takes many searches in step. On the lowest level each node has also a link to the next one, so that
every node can be reached.

Searching. Queries walk greedily down the upper levels, then hold a beam of BEAM nodes on the lowest. A shard's row is
shipped once, followed by the queries, which stream past it in small batches: memory holds one shard and one batch.
Distances are computed from differences in double precision, on vectors scaled by a power of two, so that neither a
common offset nor the size of components matters; those reported are computed on the original vectors.

Defined cases: vectors that are null, zero, or hold null or non-finite components take no part; vectors of another
length than the query are no candidates; rows that repeat an id count once, with their least distance; rows with the
query's id are its own and never found; a null id takes no part; an empty table gives an empty result; other columns are
not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import checkpointed, named, stored

LEAST_SHARD_ROWS = 4096
SHARD_BYTES = 1 << 26
DEGREE = 16
BEAM = 128
BUILD_BEAM = 32
#: Nodes of a beam that are opened at once.
OPENED = 8
#: Queries that are searched in step, and nodes that are put in at once, at most.
BATCH = 512
#: Numbers that a step holds at once.
CELLS = 1 << 22


def valid(vector: Column) -> Column:
    """Neither null, nor zero, nor with null or non-finite components."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def scale_of(vectors: np.ndarray) -> float:
    """A power of two by which no square overflows."""
    most = float(np.abs(vectors).max(initial=0.0))
    return 2.0 ** -math.frexp(most)[1] if 0 < most and math.frexp(most)[1] > -1000 else 1.0


def _far(vectors: np.ndarray, asked: np.ndarray, near: np.ndarray) -> np.ndarray:
    """Squared distances of each row of `near` (ids, -1 for none: infinity) from its row of `asked`."""
    out = np.empty(near.shape)
    step = max(1, CELLS // max(1, near.shape[1] * vectors.shape[1]))
    for k in range(0, len(near), step):
        diff = vectors[near[k : k + step]]
        diff -= asked[k : k + step, None, :]
        out[k : k + step] = np.einsum("ijk,ijk->ij", diff, diff)
    out[near < 0] = np.inf
    return out


def _diverse(near: np.ndarray, dist: np.ndarray, vectors: np.ndarray, most: int) -> np.ndarray:
    """For each row of candidates (ids, -1 for none; sorted by dist): up to `most` by the diversity rule, then the nearest others."""
    chosen = np.empty((len(near), min(most, near.shape[1])), near.dtype)
    step = max(1, CELLS // max(1, near.shape[1] * max(near.shape[1], vectors.shape[1])))
    for k in range(0, len(near), step):
        part, far = near[k : k + step], dist[k : k + step]
        # Differences from the nearest candidate keep their precision; the rule compares them with one another.
        held = vectors[part] - vectors[part[:, :1]]
        square = np.einsum("ijk,ijk->ij", held, held)
        between = square[:, :, None] + square[:, None, :] - 2 * held @ held.transpose(0, 2, 1)
        kept = np.zeros(part.shape, bool)
        for c in range(part.shape[1]):
            hidden = (kept & (between[:, c, :] < far[:, c, None])).any(axis=1)
            kept[:, c] = (part[:, c] >= 0) & ~hidden & (kept.sum(axis=1) < most)
        # Kept ones first, then the rest, each by distance.
        order = np.argsort(np.where(part < 0, 2, np.where(kept, 0, 1)), axis=1, kind="stable")[:, :most]
        chosen[k : k + step] = np.take_along_axis(part, order, axis=1)
    return chosen


def _sorted(near: np.ndarray, dist: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(dist, axis=1, kind="stable")
    return np.take_along_axis(near, order, axis=1), np.take_along_axis(dist, order, axis=1)


class Graph:
    """Nodes by their place in the seeded order; `links[k]` has a row for each node, -1 for none, of use from its level down."""

    def __init__(self, vectors: np.ndarray, seed: int = 7):
        n = len(vectors)
        rng = np.random.default_rng(seed)
        self.order = rng.permutation(n)
        self.vectors = (vectors * scale_of(vectors))[self.order]
        self.level = np.floor(-np.log(1 - rng.random(n)) / math.log(DEGREE)).astype(np.int32)
        # The first node is the one where every search begins.
        self.level[:1] = self.level.max(initial=0)
        self.links = [np.full((n, 2 * DEGREE if k == 0 else DEGREE), -1, np.int32) for k in range(int(self.level.max(initial=0)) + 1)]
        self.links[0][:-1, -1] = np.arange(1, n)
        at = 1
        while at < n:
            end = min(n, at + min(BATCH, max(1, at // 4)))
            self._put(np.arange(at, end))
            at = end

    def _put(self, new: np.ndarray) -> None:
        """Link a batch of nodes with those before them."""
        here = np.zeros(len(new), np.int32)
        for k in range(len(self.links) - 1, -1, -1):
            going = self.level[new] >= k
            if not going.all():
                here[~going] = self.greedy(k, self.vectors[new[~going]], here[~going])
            if going.any():
                own = new[going]
                near, dist = self.beam(k, self.vectors[own], here[going], BUILD_BEAM, int(new[0]))
                here[going] = near[:, 0]
                self._link(k, own, near, dist)

    def _link(self, k: int, own: np.ndarray, near: np.ndarray, dist: np.ndarray) -> None:
        links, most = self.links[k], DEGREE
        chosen = _diverse(near, dist, self.vectors, most if k == 0 else most // 2)
        width = links.shape[1] - (1 if k == 0 else 0)
        links[own, : chosen.shape[1]] = chosen
        row, place = np.nonzero(chosen >= 0)
        back, other = chosen[row, place], own[row]
        # Lists of those linked to, with the new ones behind; the longest that fit stay as they are.
        by = np.argsort(back, kind="stable")
        back, other = back[by], other[by]
        nodes, first, count = np.unique(back, return_index=True, return_counts=True)
        wide = np.full((len(nodes), width + int(count.max(initial=0))), -1, np.int32)
        wide[:, :width] = links[nodes, :width]
        held = (wide >= 0).sum(axis=1)
        rank = np.arange(len(back)) - np.repeat(first, count)
        wide[np.repeat(np.arange(len(nodes)), count), np.repeat(held, count) + rank] = other
        full = held + count > width
        links[nodes[~full], :width] = wide[~full, :width]
        if full.any():
            wide, nodes = wide[full], nodes[full]
            links[nodes, :width] = _diverse(*_sorted(wide, _far(self.vectors, self.vectors[nodes], wide)), self.vectors, width)

    def greedy(self, k: int, asked: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The nearest node that steps to ever nearer neighbours lead to."""
        at = at.copy()
        now = _far(self.vectors, asked, at[:, None])[:, 0]
        going = np.arange(len(at))
        while len(going):
            near = self.links[k][at[going]]
            dist = _far(self.vectors, asked[going], near)
            best = dist.argmin(axis=1)
            least = dist[np.arange(len(going)), best]
            better = least < now[going]
            going = going[better]
            at[going], now[going] = near[better, best[better]], least[better]
        return at

    def beam(self, k: int, asked: np.ndarray, at: np.ndarray, width: int, below: int) -> tuple[np.ndarray, np.ndarray]:
        """For each query the nodes found before `below` and their squared distances, nearest first; -1 and infinity for none."""
        m = len(asked)
        width = min(width, below)
        held, dist, opened = np.full((m, width), -1, np.int32), np.full((m, width), np.inf), np.ones((m, width), bool)
        held[:, 0], dist[:, 0], opened[:, 0] = at, _far(self.vectors, asked, at[:, None])[:, 0], False
        seen = np.zeros((m, below), bool)
        seen[np.arange(m), at] = True
        going = np.arange(m)
        while len(going):
            wait = np.where(opened[going], np.inf, dist[going])
            take = np.argsort(wait, axis=1, kind="stable")[:, :OPENED]
            ready = np.isfinite(np.take_along_axis(wait, take, axis=1))
            more = ready.any(axis=1)
            going, take, ready = going[more], take[more], ready[more]
            if not len(going):
                break
            row = np.repeat(going, take.shape[1]).reshape(take.shape)
            opened[row[ready], take[ready]] = True
            near = np.where(ready[:, :, None], self.links[k][held[row, take]], -1).reshape(len(going), -1)
            near = np.where(near < below, near, -1)
            new = (near >= 0) & ~seen[going[:, None], near]
            # A node that two opened ones share counts once.
            ranked = np.sort(np.where(new, near, -1), axis=1)
            ranked[:, 1:][ranked[:, 1:] == ranked[:, :-1]] = -1
            many = int((ranked >= 0).sum(axis=1).max(initial=0))
            near = -np.sort(-ranked, axis=1)[:, :many]
            r, c = np.nonzero(near >= 0)
            seen[going[r], near[r, c]] = True
            all_held = np.concatenate([held[going], near], axis=1)
            all_dist = np.concatenate([dist[going], _far(self.vectors, asked[going], near)], axis=1)
            all_open = np.concatenate([opened[going], near < 0], axis=1)
            best = np.argsort(all_dist, axis=1, kind="stable")[:, :width]
            held[going], dist[going], opened[going] = (np.take_along_axis(x, best, axis=1) for x in (all_held, all_dist, all_open))
        return held, dist

    def search(self, queries: np.ndarray, scale: float, beam: int = BEAM) -> np.ndarray:
        """For each query the numbers of the vectors found (-1 for none), nearest first."""
        out = np.full((len(queries), min(beam, len(self.vectors))), -1, np.int64)
        for a in range(0, len(queries), BATCH):
            asked = np.clip(queries[a : a + BATCH] * scale, -1e150, 1e150)
            at = np.zeros(len(asked), np.int32)
            for k in range(len(self.links) - 1, 0, -1):
                at = self.greedy(k, asked, at)
            found, _ = self.beam(0, asked, at, beam, len(self.vectors))
            out[a : a + BATCH] = np.where(found >= 0, self.order[found], -1)
        return out


INDEX = "dim int, shard int, ids array<long>, id_ends array<int>, vectors array<double>, places array<int>, levels array<int>, neighbours array<int>"


def _build(rows: pd.DataFrame) -> pd.DataFrame:
    """One shard's index as one row. Upper levels list the neighbours of their own nodes only."""
    held = np.stack([np.asarray(v, np.float64) for v in rows["v"]]) + 0.0
    ids = rows["id"].to_numpy(np.int64)
    vectors, node = np.unique(held, axis=0, return_inverse=True)
    order = np.lexsort((ids, node.ravel()))
    ends = np.cumsum(np.bincount(node.ravel(), minlength=len(vectors)))
    graph = Graph(vectors)
    flat = np.concatenate([links[graph.level >= k].ravel() for k, links in enumerate(graph.links)])
    return pd.DataFrame(
        {
            "dim": [rows["dim"].iloc[0]], "shard": [rows["shard"].iloc[0]], "ids": [ids[order]], "id_ends": [ends.astype(np.int32)],
            "vectors": [vectors.ravel()], "places": [graph.order.astype(np.int32)], "levels": [graph.level], "neighbours": [flat],
        }
    )


class Shard:
    """A row of the index, ready to be searched."""

    def __init__(self, row):
        self.ids, self.ends = np.asarray(row.ids, np.int64), np.asarray(row.id_ends, np.int64)
        self.starts = np.concatenate([[0], self.ends[:-1]])
        self.vectors = np.asarray(row.vectors, np.float64).reshape(len(self.ends), -1)
        self.scale = scale_of(self.vectors)
        graph = self.graph = Graph.__new__(Graph)
        graph.order, graph.level = np.asarray(row.places, np.int64), np.asarray(row.levels, np.int32)
        graph.vectors = (self.vectors * self.scale)[graph.order]
        flat, graph.links, at = np.asarray(row.neighbours, np.int32), [], 0
        for k in range(int(graph.level.max()) + 1):
            width, here = 2 * DEGREE if k == 0 else DEGREE, graph.level >= k
            links = np.full((len(here), width), -1, np.int32)
            links[here] = flat[at : at + width * int(here.sum())].reshape(-1, width)
            graph.links.append(links)
            at += width * int(here.sum())

    def nearest(self, own: np.ndarray, queries: np.ndarray, k: int) -> pd.DataFrame:
        """query_id, vec_id and score of each query's k nearest found."""
        found = self.graph.search(queries, self.scale, max(BEAM, 2 * (k + 1)))
        out = []
        for query_id, query, nodes in zip(own, queries, found, strict=True):
            nodes = nodes[nodes >= 0]
            score = np.sqrt(((self.vectors[nodes] - query) ** 2).sum(axis=1))
            if not np.isfinite(score).all():
                half = np.ldexp(self.vectors[nodes], -600) - np.ldexp(query, -600)
                score = np.sqrt((half**2).sum(axis=1)) * 2.0**600
            # Of equal vectors the k + 1 least ids suffice: one may be the query's own.
            take = np.minimum(self.ends[nodes] - self.starts[nodes], k + 1)
            each = np.arange(take.sum()) - np.repeat(np.cumsum(take) - take, take)
            near, score = self.ids[np.repeat(self.starts[nodes], take) + each], np.repeat(score, take)
            other = near != query_id
            near, score = near[other], score[other]
            best = np.lexsort((near, score))[:k]
            out.append(pd.DataFrame({"query_id": query_id, "vec_id": near[best], "score": score[best]}))
        return pd.concat(out, ignore_index=True)


def _answered(k: int):
    """Rows sorted by shard, its index first: queries stream past it."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard, at = None, None
        for batch in batches:
            for key, rows in batch.groupby(["dim", "shard"], sort=True):
                if rows["query_id"].isna().any():
                    shard, at = Shard(rows[rows["query_id"].isna()].iloc[0]), key
                    rows = rows[rows["query_id"].notna()]
                if len(rows) and at == key:
                    yield shard.nearest(rows["query_id"].to_numpy(np.int64), np.stack([np.asarray(v, np.float64) for v in rows["v"]]), k)

    return run


def _vectors(df: DataFrame, id: str, vector: str) -> DataFrame:
    rows = df.select(named(id).cast("long").alias("id"), named(vector).cast("array<double>").alias("v"))
    return rows.where(F.col("id").isNotNull() & valid(F.col("v"))).withColumn("dim", F.size("v"))


def shard_count(rows: int, dim: int) -> int:
    """Shards of about 16 times the square root of the rows, within bounds of rows and bytes."""
    most = max(1, SHARD_BYTES // (8 * max(1, dim)))
    return max(1, math.ceil(rows / max(1, min(most, max(LEAST_SHARD_ROWS, 16 * math.isqrt(rows))))))


def build_index(df: DataFrame, id: str = "vec_id", vector: str = "embedding", shards: int | None = None) -> DataFrame:
    """The index as a table, a row for each shard."""
    rows = _vectors(df, id, vector)
    if shards is None:
        size = rows.agg(F.count(F.lit(1)).alias("n"), F.max("dim").alias("dim")).first()
        shards = shard_count(size["n"], size["dim"] or 1)
    rows = rows.withColumn("shard", F.pmod(F.xxhash64("id"), F.lit(shards)).cast("int"))
    return stored(rows.groupBy("dim", "shard").applyInPandas(_build, INDEX))


def search_index(index: DataFrame, queries: DataFrame, k: int = 10, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank from 1, vec_id and score (Euclidean distance) of each query's k nearest found, ties to smaller ids."""
    asked = _vectors(queries, id, vector).dropDuplicates(["id", "v"])
    shards = index.select("dim", "shard")
    # A query goes to every shard: numbers only, no vector of the index is copied.
    asked = asked.select(F.col("id").alias("query_id"), "v", "dim").join(shards, "dim")
    both = index.unionByName(asked, allowMissingColumns=True)
    keys = ["dim", "shard"]
    ordered = both.repartition(*keys).sortWithinPartitions(*keys, F.col("query_id").asc_nulls_first())
    found = checkpointed(ordered.mapInPandas(_answered(k), "query_id long, vec_id long, score double"), 256)
    once = found.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
    return once.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op1_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return search_index(build_index(vectors), vectors.where(F.col("vec_id") % 100 == 0))
