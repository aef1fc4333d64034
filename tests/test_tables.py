import shutil

from vacantia.operators import tables


def test_stored_once_for_each_state_of_the_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tables, "shared_folder", lambda spark: str(tmp_path))
    made = []

    def held(n):
        spark.range(n).write.mode("overwrite").parquet(str(tmp_path / "in"))
        source = spark.read.parquet(str(tmp_path / "in"))
        rows = tables.stored_once(spark, "x", source, lambda: made.append(n) or source)
        assert tables.stored_once(spark, "x", source, lambda: 1 / 0).count() == n
        return rows.count()

    assert [held(3), held(5)] == [3, 5] and made == [3, 5]
    source = spark.read.parquet(str(tmp_path / "in"))
    for p in tmp_path.glob("x-*"):
        shutil.rmtree(p)
    assert tables.stored_once(spark, "x", source, lambda: source).count() == 5


def test_few_partitions_are_spread(spark):
    one, many = spark.range(10).coalesce(1), spark.range(0, 10, 1, 9)
    assert tables.spread(one).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism and tables.spread(many).rdd.getNumPartitions() == 9
