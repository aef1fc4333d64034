import math

import duckdb
import numpy as np
import pytest
from fixtures import TESTDATA, same

from vacantia.llm import hnsw

LARGER = "/root/testdata/sf0.1"
SCHEMA = "vec_id long, embedding array<float>, id string, v int, shard string"


def table(spark, rows):
    return spark.createDataFrame([(i, v, "x", 1, "y") for i, v in rows], SCHEMA)


def brute(rows, queries, k):
    good = [(i, np.asarray(v, np.float32).astype(float)) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = {}
    for q, w in good:
        if queries(q):
            near = sorted({(float(np.sqrt(((v - w) ** 2).sum())), i) for i, v in good if i != q and len(v) == len(w)})
            out[q] = near[:k]
    return out


def searched(spark, rows, queries, k=10, shards=None):
    df = table(spark, rows)
    got = hnsw.search_index(hnsw.build_index(df, shards=shards), df.where(queries), k).collect()
    out = {}
    for r in sorted(got, key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((r.score, r.vec_id))
        assert r["rank"] == len(out[r.query_id])
    return out


@pytest.mark.parametrize("shards", [None, 3, 11])
def test_recall_over_shards(spark, shards):
    """At production settings (one shard here), and with shards that each hold far more than a beam."""
    rows = duckdb.sql(f"SELECT vec_id, embedding FROM read_parquet('{LARGER}/embeddings.parquet')").fetchall()
    want = brute(rows, lambda i: i % 20 == 0, 10)
    got = searched(spark, rows, "vec_id % 20 = 0", shards=shards)
    assert set(got) == set(want)
    hits = sum(len({i for _, i in got[q]} & {i for _, i in want[q]}) for q in want)
    assert hits >= 0.97 * sum(map(len, want.values()))
    for q in list(got)[:10]:
        real = dict((i, s) for s, i in brute(rows, lambda i, q=q: i == q, len(rows))[q])
        assert all(abs(real[i] - s) < 1e-12 for s, i in got[q])


def test_the_registered_query(spark):
    rows = duckdb.sql(f"SELECT vec_id, embedding FROM read_parquet('{TESTDATA}/embeddings.parquet')").fetchall()
    want = brute(rows, lambda i: i % 100 == 0, 10)
    got = {}
    for r in sorted(hnsw.op1_hnsw(spark, TESTDATA).collect(), key=lambda r: (r.query_id, r["rank"])):
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert set(got) == set(want) and all(len(v) == 10 for v in got.values())
    assert sum(len(set(got[q]) & {i for _, i in want[q]}) for q in want) >= 0.97 * 10 * len(want)


def test_shards_grow_with_the_table():
    counts = [hnsw.shard_count(n, 64) for n in (0, 1, 4096, 50_000, 10**6, 10**9)]
    assert counts[:3] == [1, 1, 1] and counts == sorted(counts) and counts[-1] == -(-(10**9) // (hnsw.SHARD_BYTES // 512))


def test_copies_ties_and_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(i, [1.0, 2.0]) for i in range(200)] + [(300, [1.0, 3.0]), (301, [0.0, 0.0]), (302, None), (303, [nan, 1.0]), (304, [inf, 1.0]), (305, [None, 1.0]), (306, [1.0, 2.0, 3.0]), (307, [-0.0, 1.0]), (308, [0.0, 1.0]), (None, [1.0, 1.0]), (5, [1.0, 2.0]), (309, [])]
    got = searched(spark, rows, "vec_id >= 0", k=10, shards=7)
    want = brute(rows, lambda i: True, 10)
    assert set(got) == {q for q in want if want[q]}
    for q in got:
        same(got[q], want[q])
    assert searched(spark, [], "vec_id >= 0") == {}
    assert searched(spark, [(1, [1.0])], "vec_id >= 0") == {}


def recall(vectors, k=10):
    graph = hnsw.Graph(vectors)
    scale = hnsw.scale_of(vectors)
    asked = vectors[:: max(1, len(vectors) // 50)]
    far = (((vectors[None] - asked[:, None]) * scale) ** 2).sum(2)
    kth = np.sort(far, axis=1)[:, min(k, len(vectors)) - 1]
    found = graph.search(asked, scale)
    assert ((found >= 0).sum(axis=1) == min(hnsw.BEAM, len(vectors))).all()
    return np.mean([(far[i][f[:k]] <= kth[i] * (1 + 1e-9)).sum() / min(k, len(vectors)) for i, f in enumerate(found)])


@pytest.mark.parametrize("name", ["offset", "huge", "tiny", "two scales", "few", "line"])
def test_graph_alone(name):
    rng = np.random.default_rng(0)
    vectors = {
        "offset": lambda: 1e4 + rng.normal(size=(2000, 16)),
        "huge": lambda: 1e25 * rng.normal(size=(300, 16)),
        "tiny": lambda: 1e-160 * rng.normal(size=(300, 16)),
        "two scales": lambda: np.concatenate([rng.normal(size=(1500, 16)), 20 + 1e-6 * rng.normal(size=(700, 16))]),
        "few": lambda: rng.normal(size=(7, 3)),
        "line": lambda: np.arange(1.0, 900.0)[:, None],
    }[name]()
    assert recall(vectors) > 0.95


def test_nodes_are_linked_through_levels():
    graph = hnsw.Graph(np.random.default_rng(1).normal(size=(3000, 8)))
    assert len(graph.links) >= 3 and graph.level[0] == len(graph.links) - 1
    for k, links in enumerate(graph.links):
        linked = links[links >= 0]
        assert (graph.level[linked] >= k).all() and (links[graph.level < k] == -1).all()
    for row in graph.links[0]:
        held = row[:-1][row[:-1] >= 0]
        assert len(held) == len(set(held))


def test_odd_scales_through_spark(spark):
    rng = np.random.default_rng(2)
    for scale, shift in ((1e25, 0.0), (1e-30, 0.0), (1.0, 1e4)):
        rows = [(i, [float(np.float32(x)) for x in v]) for i, v in enumerate(scale * rng.normal(size=(300, 8)) + shift)]
        got, want = searched(spark, rows, "vec_id < 40", shards=2), brute(rows, lambda i: i < 40, 10)
        assert sum(len({i for _, i in got[q]} & {i for _, i in want[q]}) for q in want) >= 0.97 * 400
    few = [(i, [1.0 * i, 2.0]) for i in range(6)]
    assert {q: len(v) for q, v in searched(spark, few, "vec_id >= 0", shards=3).items()} == dict.fromkeys(range(6), 5)
