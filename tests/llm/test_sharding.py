import hashlib
import zlib
from collections import Counter

from fixtures import driver_texts, no_docs, odd_docs, same

from vacantia.llm import sharding


def test_law_and_mixture(spark):
    rows = [(i, f"text {i}", "big" if i % 3 else f"s{i % 7}") for i in range(1003)]
    got = sharding.interleave(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    counts = Counter(r.shard for r in got)
    assert max(counts.values()) - min(counts.values()) <= 1 and set(counts) == set(range(8))
    for shard in range(8):
        assert sorted(r.slot for r in got if r.shard == shard) == list(range(counts[shard]))
    by = Counter((r.shard, r.source) for r in got)
    for source, n in Counter(r.source for r in got).items():
        assert all(abs(by[shard, source] - n / 8) <= 2 for shard in range(8))


def plain(rows, shards, seed=17):
    """doc_id, shard and slot by sorting everything in one place; rows are (doc_id, source, text)."""
    number = lambda digits, *parts: int(hashlib.md5("|".join(map(str, (seed, *parts))).encode()).hexdigest()[:digits], 16)
    strata = {}
    for i, source, text in rows:
        b = (text or "").encode()
        stratum = "null" if source is None else f"={source}"
        key = (len(b) + 1, zlib.crc32(b))
        strata.setdefault(stratum, []).append((number(15, stratum, "null" if i is None else i, *key), (i is not None, i or 0), *key, i))
    every = []
    for stratum, held in strata.items():
        for rank, row in enumerate(sorted(held)):
            every.append(((rank + number(13, stratum) / (1 << 52)) / len(held), stratum, *row))
    out, slots = [], Counter()
    for place, row in enumerate(sorted(every)):
        shard = place * shards // len(every)
        out.append((row[-1], shard, slots[shard]))
        slots[shard] += 1
    return out


def test_places_match_a_plain_sort(spark):
    texts = driver_texts(150)
    rows = [(i, None if i % 11 == 0 else "big" if i % 3 else f"s{i % 5}", t) for i, t in texts] + [(None, "big", None), (3, "big", texts[3][1]), (3, "big", texts[3][1])]
    got = sharding.interleave(spark.createDataFrame(rows, "doc_id long, source string, text string")).collect()
    same([(r.doc_id, r.shard, r.slot) for r in got], plain(rows, 8))


def test_sizes(spark):
    texts = driver_texts(100)
    docs = spark.createDataFrame([(i, t, "a") for i, t in texts], "doc_id long, text string, source string")
    same([(r.doc_id, r.size, r.text_crc32) for r in sharding.interleave(docs).collect()], [(i, len(t.encode()) + 1, zlib.crc32(t.encode())) for i, t in texts])


def test_odd_rows(spark):
    docs = odd_docs(spark)
    got = sharding.interleave(docs, shards=4).collect()
    assert len(got) == docs.count()
    assert next(r.size for r in got if r.doc_id == 2) == 1
    counts = Counter(r.shard for r in got)
    assert max(counts.values()) - min(counts.values()) <= 1
    assert sharding.interleave(no_docs(spark)).count() == 0
