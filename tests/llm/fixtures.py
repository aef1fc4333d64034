"""Small tables with the cases that every operator must survive, and the driver's own small tables."""

import duckdb
from pyspark.sql import SparkSession

TESTDATA = "/root/testdata/sf0.001"
#: Extra columns whose names operators use themselves.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, node string, words int, kept boolean, n int"


def odd_docs(spark: SparkSession):
    """Nulls, empty and blank texts, one very long text, repeated rows and repeated ids, clashing column names."""
    long_text = " ".join(f"word{i % 977} of{i}" for i in range(30_000))
    texts = [
        (1, "the quick brown fox jumps over the lazy dog and runs away from the big bad wolf in the woods at night"),
        (2, None),
        (3, ""),
        (4, " \t\r\n\x0b\x0c "),
        (5, "one"),
        (6, long_text),
        (7, "the quick brown fox jumps over the lazy dog and runs away from the big bad wolf in the woods at night"),
        (7, "the quick brown fox jumps over the lazy dog and runs away from the big bad wolf in the woods at night"),
        (8, "Ünïcode wörds ümlaut 日本語 🎉 naïve\x00 end"),
        (None, "a row without an id has a text too and it is as good as any other text of this little table"),
        (9, "a\n\na\na b\n"),
    ]
    rows = [(i, t, None if i == 8 else "en", None if i in (2, 5) else "s1", None, 1, "x", 2, None, 3) for i, t in texts]
    return spark.createDataFrame(rows, SCHEMA)


def no_docs(spark: SparkSession):
    return spark.createDataFrame([], SCHEMA)


def driver_texts(limit: int = 10_000) -> list[tuple[int, str]]:
    return duckdb.sql(f"SELECT doc_id, text FROM read_parquet('{TESTDATA}/documents.parquet') LIMIT {limit}").fetchall()


def same(mine: list, theirs: list) -> None:
    key = lambda row: tuple((v is None, str(v)) for v in row)
    assert sorted(map(tuple, mine), key=key) == sorted(map(tuple, theirs), key=key)
