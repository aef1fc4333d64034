"""The registered queries over the driver's smallest tables: against their SQL, or against plain Python."""

import base64
import hashlib
import sys
from pathlib import Path

import duckdb
import public_tokenizers
import pytest
import tiktoken
from fixtures import TESTDATA, driver_texts, same
from test_licenses import brute as license_base
from test_licenses import plain as license_labels
from test_packing import checked, tokenizer  # noqa: F401
from test_token_counts import expected as expected_counts

from vacantia.llm import licenses
from vacantia.llm.queries import ORACLE_SQL, QUERIES

sys.path.insert(0, str(Path(__file__).parents[2]))


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{TESTDATA}/{t}.parquet')")
    mine = QUERIES[name](spark, TESTDATA)
    theirs = con.execute(ORACLE_SQL[name])
    names = [c[0] for c in theirs.description]
    assert sorted(names) == sorted(mine.columns)
    same(mine.select(*names).collect(), theirs.fetchall())


def test_packing(spark, tokenizer):  # noqa: F811
    rows = QUERIES["op4_best_fit_packing"](spark, TESTDATA).collect()
    sequences, tokens = checked(rows, driver_texts(), tokenizer, 2048)
    assert sequences <= 1.03 * -(-tokens // 2048) + 1


def test_byte_bpe(spark):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = []
    for i, text in driver_texts():
        ids = library.encode_ordinary(text or "")
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((text or "").encode()).hexdigest()))
    same(QUERIES["op8_byte_bpe"](spark, TESTDATA).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect(), want)


def test_license_scans(spark):
    texts = driver_texts()
    words = sorted({w for t, keys in licenses.NOTICES.values() for x in (t, *keys) for w in x.split()} | {w for p in licenses.PHRASES for w in p.split()})
    idf = licenses.idf_weights(spark.createDataFrame(texts, "doc_id long, text string"), words)
    got = {r.doc_id: r for r in QUERIES["op9_license_scans"](spark, TESTDATA).collect()}
    assert {i: tuple(r[1:6]) for i, r in got.items()} == {i: license_base(t) for i, t in texts}
    for i, t in texts:
        labels, score = license_labels(t, idf)
        assert got[i].labels == labels and abs(got[i].score - score) < 1e-9


def test_token_counts(spark):
    same(QUERIES["op10_token_counts"](spark, TESTDATA).collect(), expected_counts(driver_texts()))


def test_pipeline_is_registered():
    import __spark_entry__
    import corpus_pipeline

    assert __spark_entry__.queries()["pipeline"] is corpus_pipeline.run and set(QUERIES) <= set(__spark_entry__.queries())
