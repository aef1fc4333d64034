import sys
from pathlib import Path

import pytest
from fixtures import TESTDATA, no_docs, odd_docs
from test_neardup import brute as near_brute
from test_packing import checked, tokenizer  # noqa: F401

sys.path.insert(0, str(Path(__file__).parents[2]))
import corpus_pipeline  # noqa: E402


def test_run_against_brute_force(spark, tokenizer):  # noqa: F811
    """Each stage's result from its predecessor's rows: verdicts, groups, redaction and places."""
    docs = spark.read.parquet(f"{TESTDATA}/documents.parquet")
    (_, quality), (_, dedup), (_, clean), (_, _) = corpus_pipeline.STAGES
    first = quality(spark, docs, TESTDATA)
    assert first.columns == docs.columns and 0 < first.count() < docs.count()
    kept = [(r.doc_id, r.text) for r in first.collect()]
    second = dedup(spark, first, TESTDATA)
    want = {i for i, _, _, chosen in near_brute(kept, 5, 80) if chosen}
    assert {r.doc_id for r in second.collect()} == want and second.count() == len(want)
    third = clean(spark, second, TESTDATA)
    assert third.columns == docs.columns
    texts = [(r.doc_id, r.text) for r in third.collect()]
    assert all(r.n_chars == len(r.text) for r in third.collect())
    checked(corpus_pipeline.run(spark, TESTDATA).collect(), texts, tokenizer, 2048)


def test_odd_rows_pass_all_stages(spark):
    for table in (odd_docs(spark), no_docs(spark)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, table, TESTDATA)
            assert out.columns == table.columns
            out.collect()
        corpus_pipeline.STAGES[-1][1](spark, table, TESTDATA).collect()




def test_finished_stages_are_not_run_again(spark, tmp_path, monkeypatch):
    ran = []

    def noted(name, stage):
        def run(*args):
            ran.append(name)
            return stage(*args)

        return name, run

    stages = [noted(*s) for s in corpus_pipeline.STAGES]
    monkeypatch.setattr(corpus_pipeline, "STAGES", [stages[0], noted("broken", lambda *a: 1 / 0), *stages[2:]])
    with pytest.raises(ZeroDivisionError):
        corpus_pipeline.run(spark, TESTDATA, str(tmp_path))
    monkeypatch.setattr(corpus_pipeline, "STAGES", [stages[0], stages[2], stages[3]])
    rows = corpus_pipeline.run(spark, TESTDATA, str(tmp_path)).count()
    assert ran == ["quality_rules", "broken", "secret_scans", "best_fit_packing"] and rows > 0


def test_another_input_is_run_anew(spark, tmp_path, monkeypatch):
    """A work folder of other documents, or of other code, is not resumed from."""
    monkeypatch.setattr(corpus_pipeline, "STAGES", [corpus_pipeline.STAGES[0], ("last", lambda spark, docs, sf_dir: docs.select("doc_id"))])
    texts = [" ".join(f"the word{k} of {i}" for k in range(30)) for i in range(6)]
    ids = lambda k: sorted(r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path / f"in{k}"), str(tmp_path / "work")).collect())
    for k, held in enumerate((texts[:2], texts[2:])):
        rows = [(10 * k + i, t, "en", "s", len(t)) for i, t in enumerate(held)]
        spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / f"in{k}" / "documents.parquet"))
    assert ids(0) == [0, 1] and ids(1) == [10, 11, 12, 13] and ids(0) == [0, 1]
    monkeypatch.setattr(corpus_pipeline, "CODE", corpus_pipeline.CODE[:1])
    ran = []
    stage = corpus_pipeline.STAGES[0][1]
    monkeypatch.setattr(corpus_pipeline, "STAGES", [("quality_rules", lambda *a: ran.append(1) or stage(*a)), corpus_pipeline.STAGES[1]])
    assert ids(0) == [0, 1] and ids(0) == [0, 1] and ran == [1]


def test_stages_leave_one_folder(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(corpus_pipeline, "shared_path", lambda spark, name: str(tmp_path / name))
    same = lambda spark, docs, sf_dir: docs
    monkeypatch.setattr(corpus_pipeline, "STAGES", [(n, same) for n in ("a", "b", "c", "d")])
    assert corpus_pipeline.run(spark, TESTDATA).count() > 0
    assert [p.name for p in tmp_path.iterdir()] == ["c"]
