import re

import duckdb
from fixtures import TESTDATA, driver_texts, no_docs, odd_docs, same

from vacantia.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    covered = {i + j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(8)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_counts_match_brute_force(spark):
    repeated = "a b c d e f g h i j k " * 3
    texts = [*driver_texts(40), (900, repeated), (901, "x " * 30), (902, "a b c d e f g h " * 2 + "z")]
    rows = quality.measure(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    got = [(r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in rows]
    same(got, [(i, *brute(t)) for i, t in texts])


def test_odd_rows(spark):
    docs = odd_docs(spark)
    rows = quality.apply_rules(docs).collect()
    same([(r.doc_id, r.n_words, r.n_dup_lines, r.base_failed) for r in rows], [(d.doc_id, *(b := brute(d.text))[:1], b[3], b[0] < 20 or 100 * b[4] > 30 * b[0]) for d in docs.collect()])
    assert all(not (r.kept and r.base_failed) for r in rows)
    assert quality.apply_rules(no_docs(spark)).count() == 0


def test_oracle_sql_agrees(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{TESTDATA}/documents.parquet')")
    query = quality.op3_quality_rules(spark, TESTDATA)
    names = ", ".join(query.columns)
    same(query.collect(), con.execute(f"SELECT {names} FROM ({quality.OP3_SQL})").fetchall())


def test_stage_keeps_columns_and_clean_rows(spark):
    docs = odd_docs(spark)
    kept = quality.quality_stage(spark, docs, "")
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {1, 7, None}
    assert kept.where("doc_id = 7").count() == 2
    assert quality.quality_stage(spark, no_docs(spark), "").count() == 0


def test_each_rule_can_reject(spark):
    texts = {
        "mean_word_chars>12": "pneumonoultramicroscopic the silicovolcanoconiosis " * 12,
        "symbol_ratio>0.1": " ".join(f"the w{i} #" for i in range(30)),
        "stop_word_ratio<0.02": " ".join(f"word{i}" for i in range(60)),
        "capital_ratio>0.3": " ".join(f"THE WORD{'ABCDEFGH'[i % 8]}{i}" for i in range(40)),
    }
    docs = spark.createDataFrame(list(enumerate(texts.values())), "doc_id long, text string")
    broken = {r.doc_id: r.broken_rules for r in quality.apply_rules(docs).collect()}
    for i, name in enumerate(texts):
        assert name in broken[i]
