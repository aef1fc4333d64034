import random

import numpy as np
import pytest
from fixtures import driver_texts, no_docs, odd_docs, same
from hypothesis import given, settings
from hypothesis import strategies as st

from vacantia.llm import suffixes


def brute(rows, length):
    """doc_id, n_bytes, spans and kept bytes, by a dictionary of all windows."""
    least = {}
    for i, text in rows:
        body = (text or "").encode()
        for at in range(len(body) - length + 1 if i is not None else 0):
            w = body[at : at + length]
            least[w] = min(least.get(w, i), i)
    out = []
    for i, text in rows:
        body = (text or "").encode()
        goes = bytearray(len(body) + 2)
        for at in range(len(body) - length + 1 if i is not None else 0):
            if least[body[at : at + length]] < i:
                goes[at + 1 : at + 1 + length] = b"\1" * length
        spans = [(a, b) for a, b in zip((k for k in range(len(body) + 1) if goes[k + 1] > goes[k]), (k for k in range(len(body) + 1) if goes[k + 1] < goes[k]), strict=True)]
        out.append((i, len(body), spans, bytes(c for c, g in zip(body, goes[1:], strict=False) if not g)))
    return out


def plain(rows):
    return [(r.doc_id, r.n_bytes, [tuple(s) for s in r.spans], bytes(r.kept)) for r in rows]


def made_up(seed=3, n=160):
    """Copies, shared passages at any place, repeats inside a text, one passage in a third of all texts, periodic texts."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdeö", k=rng.randint(1, 9)))
    passages = [" ".join(word() for _ in range(rng.randint(8, 60))) for _ in range(12)]
    rows = []
    for i in range(n):
        parts = [" ".join(word() for _ in range(rng.randint(0, 30))) for _ in range(4)]
        if rng.random() < 0.5:
            parts.insert(rng.randint(0, 4), rng.choice(passages) * rng.randint(1, 2))
        if rng.random() < 0.4:
            parts.insert(rng.randint(0, 4), passages[0])
        rows.append((rng.randint(-50, 400), " ".join(parts)))
    rows += [(rng.randint(-500, 500), rng.choice(rows)[1]) for _ in range(40)]
    return rows + [(1, "ab" * 100), (2, "ab" * 90), (-1, "a" * 77), (0, "a" * 49), (7, "x" + "a" * 80 + "y"), (7, "a" * 60), (2**63 - 1, rows[0][1]), (-(2**63), rows[1][1])]


@pytest.mark.parametrize("limits", [{}, {"HOT": 2, "MAX_SORTED": 300, "BLOCK": 256}])
def test_made_up_texts(spark, monkeypatch, limits):
    """Also with hot anchors, several suffix arrays in a bucket, and small blocks."""
    rows = made_up()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for length in (50, 16):
        want = brute(rows, length)
        assert sum(len(r[2]) for r in want) > 100
        same(in_one_process(rows, length, monkeypatch, limits), want)
        if not limits:
            same(plain(suffixes.repeated_passages(docs, length).collect()), want)


def in_one_process(rows, length, monkeypatch, limits, shards=3, buckets=5):
    """The steps without Spark: patched limits don't reach its workers."""
    import pandas as pd

    suffixes._powers.cache_clear()
    for name, value in limits.items():
        monkeypatch.setattr(suffixes, name, value)

    class Frame:
        """Stands in for a DataFrame: a list of rows, grouped and handed to the functions of each step."""

        def __init__(self, df, key=None):
            self.df, self.key = df, key

        def groupBy(self, key):  # noqa: N802
            return Frame(self.df, key)

        def cogroup(self, other):
            return Pair(self, other)

        def of(self, k):
            return self.df[self.df[self.key] == k].reset_index(drop=True) if len(self.df) else self.df

        def keys(self):
            return set(self.df[self.key]) if len(self.df) else set()

        def applyInPandas(self, run, schema):  # noqa: N802
            return joined([run(self.of(k)) for k in sorted(self.keys())])

    class Pair:
        def __init__(self, a, b):
            self.a, self.b = a, b

        def applyInPandas(self, run, schema):  # noqa: N802
            return joined([run(self.a.of(k), self.b.of(k)) for k in sorted(self.a.keys() | self.b.keys())])

    def joined(parts):
        parts = [p for p in parts if len(p)]
        return Frame(pd.concat(parts, ignore_index=True) if parts else pd.DataFrame())

    texts = Frame(pd.DataFrame([(i, (t or "").encode(), n, n % shards) for n, (i, t) in enumerate(rows)], columns=["doc_id", "body", "uid", "shard"]))
    answers = suffixes.answered(suffixes.asked(texts, length, buckets))
    runs = suffixes.decided(suffixes.exported(texts, answers, length, buckets), length)
    cut = suffixes.cut_texts(texts, runs, length).df
    suffixes._powers.cache_clear()
    return [(r.doc_id, r.n_bytes, [(s["start"], s["end"]) for s in r.spans], r.kept) for r in cut.itertuples()]


def test_driver_texts(spark):
    texts = driver_texts()
    same(plain(suffixes.repeated_passages(spark.createDataFrame(texts, "doc_id long, text string")).collect()), brute(texts, 50))


def test_odd_rows(spark):
    docs = odd_docs(spark)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    same(plain(suffixes.repeated_passages(docs).collect()), brute(rows, 50))
    assert suffixes.repeated_passages(no_docs(spark)).collect() == []
    with pytest.raises(ValueError):
        suffixes.repeated_passages(docs, 10)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.text(st.sampled_from("ab"), min_size=1), st.integers(1, 5)), min_size=1, max_size=8), st.sampled_from([16, 50]))
def test_suffix_arrays(parts, depth):
    data = "".join(a * n for a, n in parts).encode() * 3
    words = suffixes.eights(np.frombuffer(data + bytes(7), np.uint8))
    order = suffixes.suffix_order(words)
    assert order.tolist() == sorted(range(len(data)), key=lambda i: data[i:])
    padded = data + bytes(depth)
    shared = suffixes.common_prefixes(words, order, depth)
    for k in range(1, len(data)):
        a, b = padded[order[k - 1] : order[k - 1] + depth], padded[order[k] : order[k] + depth]
        same_bytes = next((i for i in range(depth) if a[i] != b[i]), depth)
        assert min(shared[k], depth) == same_bytes


def test_long_texts_in_blocks(spark):
    """A text of many blocks, whose halves another text has."""
    rng = random.Random(1)
    long = "".join(rng.choices("abcdefgh ", k=700_000))
    rows = [(5, long), (3, long[100_000:300_000] + "|" + long[500_000:])]
    got = {r.doc_id: r for r in suffixes.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [tuple(s) for s in got[5].spans] == [(100_000, 300_000), (500_000, 700_000)] and got[3].spans == []
