import base64
import hashlib

import public_tokenizers
import pytest
import tiktoken
from fixtures import driver_texts, no_docs, odd_docs, same
from hypothesis import given, settings
from hypothesis import strategies as st

from vacantia.llm import byte_bpe


@pytest.fixture(scope="module")
def oracle():
    with open(byte_bpe.default_ranks(), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def digest(oracle, text):
    ids = oracle.encode_ordinary(text or "")
    return len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()


def test_driver_texts(spark, oracle):
    texts = [*driver_texts(), (900, "a" * 3000), (901, " \n\n  x"), (902, "🎉" * 300), (903, "don't DON'T 12345   <|endoftext|>")]
    same(byte_bpe.digested(spark.createDataFrame(texts, "doc_id long, text string")).collect(), [(i, *digest(oracle, t)) for i, t in texts])


def test_odd_rows(spark, oracle):
    docs = odd_docs(spark)
    same(byte_bpe.digested(docs).collect(), [(d.doc_id, *digest(oracle, d.text)) for d in docs.collect()])
    assert byte_bpe.digested(no_docs(spark)).count() == 0


def test_round_trip_in_tables(spark):
    docs = odd_docs(spark)
    same(((r.doc_id, bytes(r.bytes).decode()) for r in byte_bpe.decoded(byte_bpe.encoded(docs)).collect()), [(d.doc_id, d.text or "") for d in docs.collect()])


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=400))
def test_any_text(oracle, text):
    text = text.encode("utf-8", "replace").decode()
    by = byte_bpe.encoder(byte_bpe.default_ranks(), public_tokenizers.PATTERN)
    assert by.encode([text]) == [oracle.encode_ordinary(text)]
    assert by.decode(by.encode([text])[0]) == text.encode()


def test_parts_of_long_texts(oracle, monkeypatch):
    monkeypatch.setattr(byte_bpe, "PART", 50)
    by = byte_bpe.Encoder(byte_bpe.default_ranks(), public_tokenizers.PATTERN)
    texts = ["some words and more words " * 40, "", "x"]
    assert by.encode(texts) == [oracle.encode_ordinary(t) for t in texts]
