import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from fixtures import driver_texts, no_docs, odd_docs
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from vacantia.llm import packing


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def checked(rows, texts, tokenizer, capacity):
    """Pieces are those of the tokenizer's ids, and sequences are full without gaps."""
    want = []
    for doc, text in texts:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        want += [(doc, k, at, len(p), zlib.crc32(p.tobytes())) for k, at in enumerate(range(0, len(ids), capacity)) for p in [ids[at : at + capacity]]]
    key = lambda r: tuple((v is None, v or 0) for v in r)
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows), key=key) == sorted(want, key=key)
    held = defaultdict(list)
    for r in rows:
        held[r.sequence_id].append((r.offset, r.length))
    for parts in held.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(held), sum(r.length for r in rows)


def test_driver_texts(spark, tokenizer):
    texts = driver_texts()
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    n, tokens = checked(packing.pack_documents(docs).collect(), texts, tokenizer, 2048)
    assert n <= -(-tokens // 2048) + 2


def test_odd_rows(spark, tokenizer):
    docs = odd_docs(spark)
    rows = packing.pack_documents(docs, capacity=256).collect()
    checked(rows, [(d.doc_id, d.text) for d in docs.collect()], tokenizer, 256)
    assert packing.pack_documents(no_docs(spark)).count() == 0


def test_sequences_hold_their_documents(spark):
    docs = spark.createDataFrame([(i, "some words " * (i % 9)) for i in range(50)], "doc_id long, text string")
    path = public_tokenizers.path("word_bpe_49k.json")
    made = packing.sequences(packing.pack(packing.pieces(docs, path, 16, with_ids=True).persist(), 16)).collect()
    for s in made:
        assert len(s.ids) == sum(d.length for d in s.documents) <= 16


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 40), max_size=20))
def test_plans_place_every_piece_once(histogram):
    plan = packing.plan_packing(histogram, 64, groups=6, small_part=8)
    ranks = defaultdict(list)
    used = defaultdict(list)
    for length, first, many, sequence, offset in plan.places:
        ranks[length] += range(first, first + many)
        for k in range(many):
            used[sequence + k].append((offset, length))
    assert {s: sorted(r) for s, r in ranks.items()} == {s: list(range(n)) for s, n in histogram.items()}
    for parts in used.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 64
    assert len(used) == plan.sequences
    total = sum(s * n for s, n in histogram.items())
    large = sum(n for s, n in histogram.items() if s > 32)
    assert plan.sequences <= max(-(-total // 64), large) * 1.7 + 2
