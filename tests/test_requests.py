"""The requests that read a board's site page by page."""

from pyspark.sql import functions as F

from vacantia.sources import boards


def test_large_sites_are_dealt_in_runs(spark):
    sites = spark.createDataFrame([("a b", None, 250_050), ("c", "eu", 200), ("d", " EU ", 99), ("e", None, 0)], "external_id string, api_region string, n long").coalesce(1)
    made = boards.page_requests(sites)
    assert made.rdd.getNumPartitions() > 1
    got = {(r.external_id, r.page): r.url for r in made.collect()}
    assert {k for k in got if k[0] != "a b"} == {("c", 0), ("c", 1), ("c", 2), ("d", 0), ("e", 0)} and sorted(p for s, p in got if s == "a b") == list(range(2501))
    assert got["a b", 1024] == "https://api.lever.co/v0/postings/a+b?mode=json&skip=102400&limit=100" and got["d", 0] == "https://api.eu.lever.co/v0/postings/d?mode=json&skip=0&limit=100"
    # No task makes all requests of the large site.
    assert made.where("external_id = 'a b'").groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0] <= 2 * boards.RUN_PAGES


def shuffled(plan):
    """Rows that an executed plan's shuffles wrote, each."""
    inner = plan.executedPlan() if plan.nodeName() == "AdaptiveSparkPlan" else plan.plan() if plan.nodeName().endswith("QueryStage") else None
    below = [inner] if inner else [plan.children().apply(k) for k in range(plan.children().size())]
    own = [plan.metrics().apply("shuffleRecordsWritten").value()] if plan.nodeName() == "Exchange" else []
    return own + [x for p in below for x in shuffled(p)]


def test_what_is_moved_grows_with_sites_not_with_pages(spark):
    sites = spark.createDataFrame([(s, None, 100_000_049) for s in "abc"] + [(f"s{k}", "eu", 100 * k) for k in range(47)], "external_id string, api_region string, n long")
    made = boards.page_requests(sites)
    told = made.groupBy(F.spark_partition_id()).agg(F.count("*"), F.sum((F.length("external_id") == 1).cast("long")), F.min("page"), F.max("page"))
    got = told.collect()
    assert sum(r[1] for r in got) == 3 * 1_000_001 + sum(range(1, 48)) and sum(r[2] for r in got) == 3 * 1_000_001
    assert (min(r[3] for r in got), max(r[4] for r in got)) == (0, 1_000_000)
    # 50 sites, of 3,050 runs of pages.
    assert 50 <= max(shuffled(told._jdf.queryExecution().executedPlan())) < 1000
    assert max(r[1] for r in got) <= 2 * 3_000_000 / (boards.REQUEST_TASKS * spark.sparkContext.defaultParallelism)
    # Offsets across the ends of runs and of spans.
    at = [0, 1, 999, 1000, 1001, 9999, 10_000, 123_456, 1_000_000]
    some = made.where((F.col("external_id") == "b") & F.col("page").isin(at)).collect()
    assert {r.page: r.url for r in some} == {p: f"https://api.lever.co/v0/postings/b?mode=json&skip={p * 100}&limit=100" for p in at} and len(some) == len(at)
    assert made.where(F.concat(F.lit("skip="), (F.col("page").cast("long") * 100).cast("string"), F.lit("&limit=100")) != F.regexp_extract("url", "skip=.*", 0)).count() == 0


def test_a_site_without_a_count_has_no_requests(spark):
    sites = spark.createDataFrame([("a", None, None), ("b", None, -300), ("c", None, 0)], "external_id string, api_region string, n long")
    assert [(r.external_id, r.page) for r in boards.page_requests(sites).collect()] == [("c", 0)]
