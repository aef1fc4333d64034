"""Audits of stored postings: recompute, compare, and count."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vacantia.functions import places, titles
from vacantia.operators.ingest import with_facets

# Places that name no place.
EMPTY_PLACES = ("remote", "hybrid", "anywhere", "unknown")


def _raw() -> Column:
    return F.trim(F.coalesce("location_raw", "location", F.lit("")))


def empty_geography(jobs: DataFrame) -> DataFrame:
    """Postings whose location looks like a place but gave neither country nor region, by location and id."""
    blank = (F.coalesce(F.size("location_countries"), F.lit(0)) <= 0) & (F.coalesce(F.size("location_regions"), F.lit(0)) <= 0)
    mode_only = F.col("is_remote") & _raw().rlike(r"(?i)^(remote|hybrid|anywhere|distributed|unknown|worldwide|global)\s*$")
    return jobs.where(blank & (F.length(_raw()) > 1) & ~F.lower(_raw()).isin(*EMPTY_PLACES) & ~mode_only).orderBy(F.asc_nulls_last("location_raw"), "id")


def scanned(jobs: DataFrame, provider: str | None = None, limit: int | None = None) -> DataFrame:
    """What a location audit reads: eleven columns, without locations that only say how work is done, by id.

    A limit is for looking at a few rows only.
    """
    rows = jobs if provider is None else jobs.where(F.col("provider") == provider)
    rows = rows.where(~F.lower(F.trim(F.coalesce("location_raw", F.lit("")))).isin("remote", "hybrid"))
    columns = ["id", "provider", "external_id", "title", "company", "location", "location_raw", "location_tokens", "location_countries", "location_regions", "is_remote"]
    rows = rows.select(*columns).orderBy("id")
    return rows if limit is None else rows.limit(limit)


def recomputed(jobs: DataFrame, terms: DataFrame) -> DataFrame:
    """`jobs` with a struct `expected` of the facets their location and title give now, the board's flag taken from is_remote."""
    rows = jobs.withColumn("_raw", F.coalesce("location_raw", "location", F.lit("")))
    found = with_facets(rows, terms, "_raw", F.coalesce("is_remote", F.lit(False)), tied_titles=False)
    return found.select(*jobs.columns, F.col("facets").alias("expected"))


def still_empty(jobs: DataFrame, terms: DataFrame) -> DataFrame:
    """Postings of `empty_geography` for which today's rules find neither country nor region either."""
    rows = recomputed(empty_geography(jobs), terms)
    return rows.where((F.size("expected.countries") == 0) & (F.size("expected.regions") == 0)).drop("expected")


def board_rows(jobs: DataFrame, provider: str = "lever") -> DataFrame:
    """What a board's audit reads: thirteen columns, by company and title."""
    columns = ["id", "external_id", "title", "company", "location", "location_raw", "location_tokens", "location_countries", "location_regions", "is_remote", "role", "stack", "seniorities"]
    return jobs.where(F.col("provider") == provider).select(*columns).orderBy("company", "title")


def looks_geographic(raw: Column) -> Column:
    return ~F.lower(F.trim(F.coalesce(raw, F.lit("")))).isin("", "unknown", "remote", "hybrid")


def forward_deployed(title: Column) -> Column:
    return title.rlike(r"(?i)forward[-\s]?(deployed|deployment)")


def stack_mismatch_kind(stored: Column, expected: Column) -> Column:
    """Why a stored stack differs from the title's: a description may have named more."""
    return F.when((F.size(stored) > 0) & (F.size(expected) == 0), "description_enriched").otherwise("true_drift")


def comparable_countries(countries: Column) -> Column:
    """Known countries under their stored names, sorted: two-letter codes that stand for none don't count."""
    names = F.transform(countries, places.country_hint)
    return F.array_sort(F.array_distinct(F.filter(names, lambda c: c.isin(*places.COUNTRIES))))


def comparable_regions(regions: Column) -> Column:
    names = F.transform(regions, places.country_hint)
    return F.array_sort(F.array_distinct(F.filter(names, lambda r: r.isin(*set(places.REGIONS.values())))))


def board_audit(jobs: DataFrame, terms: DataFrame, provider: str = "lever") -> DataFrame:
    """One board's postings with what today's rules expect, and a flag for each way in which the stored row differs."""
    rows = jobs.where(F.col("provider") == provider)
    rows = with_facets(rows.withColumn("_raw", F.coalesce("location_raw", "location", F.lit(""))), terms, "_raw", F.coalesce("is_remote", F.lit(False)))
    own = rows.withColumnsRenamed({"role": "stored_role", "seniorities": "stored_seniorities", "stack": "stored_stack"})
    now = titles.read(own)
    now = now.withColumn("expected_role", F.nullif("role", F.lit("other"))).withColumn("expected_stack", titles.shown_for(F.col("technologies"), F.coalesce("stored_role", "expected_role", F.lit("other"))))
    stack_differs = ~_same(F.col("stored_stack"), F.col("expected_stack"))
    same_places = (comparable_countries(F.col("location_countries")) == comparable_countries(F.col("facets.countries"))) & (comparable_regions(F.col("location_regions")) == comparable_regions(F.col("facets.regions")))
    blank = (F.size("location_countries") == 0) & (F.size("location_regions") == 0)
    return now.select(
        "id", "company", "title", "location_raw", "stored_role", "expected_role", "stored_seniorities", F.col("seniorities").alias("expected_seniorities"), "stored_stack", "expected_stack",
        F.col("facets.countries").alias("expected_countries"), F.col("facets.regions").alias("expected_regions"),
        (~F.col("stored_role").eqNullSafe(F.col("expected_role"))).alias("role_differs"),
        (~_same(F.col("stored_seniorities"), F.col("seniorities"))).alias("seniority_differs"),
        F.when(stack_differs, stack_mismatch_kind(F.col("stored_stack"), F.col("expected_stack"))).alias("stack_mismatch"),
        (~same_places).alias("facets_differ"),
        (blank & looks_geographic(F.col("location_raw"))).alias("empty_geography"),
        forward_deployed(F.col("title")).alias("forward_deployed"),
    )


def board_counts(audit: DataFrame) -> DataFrame:
    """All counts of a board's audit in one pass."""
    count = lambda test, name: F.count_if(test).alias(name)
    kind = F.col("stack_mismatch")
    return audit.agg(
        F.count(F.lit(1)).alias("scanned"), count(F.col("role_differs"), "role"), count(F.col("seniority_differs"), "seniority"), count(kind.isNotNull(), "stack"),
        count(kind == "description_enriched", "description_enriched"), count(kind == "true_drift", "true_drift"), count(F.col("facets_differ"), "facets"),
        count(F.col("empty_geography"), "empty_geography"), count(F.col("stored_role").isNull(), "no_role"), count(F.size("expected_seniorities") == 0, "no_seniority"),
        count(F.col("forward_deployed"), "forward_deployed"),
    )


#: How many rows of each kind a report shows.
SAMPLES = {"role_differs": 50, "seniority_differs": 30, "description_enriched": 20, "true_drift": 30, "facets_differ": 40, "empty_geography": 40}


def samples(audit: DataFrame) -> DataFrame:
    """The first rows of each kind of mismatch, by company, title and id: a top-k report.

    The largest bound is a constant, by which Spark limits each kind in every task before it shuffles; the kinds' own follow.
    """
    kinds = F.array_compact(F.array(*[F.when(F.col("stack_mismatch") == k if k in ("description_enriched", "true_drift") else F.col(k), F.lit(k)) for k in SAMPLES]))
    rows = audit.select(F.explode(kinds).alias("kind"), "company", "title", "id")
    place = F.row_number().over(Window.partitionBy("kind").orderBy("company", "title", "id"))
    most = F.element_at(F.create_map(*[F.lit(x) for kv in SAMPLES.items() for x in kv]), F.col("kind"))
    return rows.withColumn("place", place).where(F.col("place") <= max(SAMPLES.values())).where(F.col("place") <= most)


def write_report(audit: DataFrame, path: str) -> None:
    """A board's audit as JSON lines (`counts`, `roles`, `samples`), as plain text and as Markdown under `path`.

    Only the counts, a row for each role and the samples, all of bounded size, are rendered.
    """
    spark = audit.sparkSession
    counts = board_counts(audit).first().asDict()
    roles = [(r["role"], r["n"]) for r in role_counts(audit.withColumnRenamed("stored_role", "role")).orderBy(F.desc("n"), "role").collect()]
    board_counts(audit).write.mode("overwrite").json(f"{path}/counts")
    spark.createDataFrame(roles, "role string, n long").write.mode("overwrite").json(f"{path}/roles")
    samples(audit).write.mode("overwrite").json(f"{path}/samples")
    text = [*(f"{k}: {v}" for k, v in counts.items()), "", "roles", *(f"  {r}: {n}" for r, n in roles)]
    marked = ["| count | rows |", "| --- | --- |", *(f"| {k} | {v} |" for k, v in counts.items()), "", "| role | rows |", "| --- | --- |", *(f"| {r} | {n} |" for r, n in roles)]
    for name, lines in (("text", text), ("markdown", marked)):
        spark.createDataFrame([(k, x) for k, x in enumerate(lines)], "line int, value string").coalesce(1).sortWithinPartitions("line").select("value").write.mode("overwrite").text(f"{path}/{name}")


def _same(a: Column, b: Column) -> Column:
    key = lambda c: F.array_sort(F.transform(F.coalesce(c, F.array().cast("array<string>")), F.lower))
    return key(a) == key(b)


def mismatches(jobs: DataFrame, terms: DataFrame) -> DataFrame:
    """Postings whose stored facets differ from the recomputed ones, with the reason and a category."""
    rows = recomputed(jobs, terms)
    same = {k: _same(F.col(f"location_{k}"), F.col(f"expected.{k}")) for k in ("tokens", "countries", "regions")}
    reason = F.concat_ws("+", *[F.when(~s, F.lit(k)) for k, s in same.items()])
    stored, expected = F.size("location_countries"), F.size("expected.countries")
    remote_only = lambda c: (F.size(c) > 0) & F.forall(c, lambda t: F.lower(t).isin("remote", "anywhere", "distributed"))
    accepted = (F.size("location_regions") > 0) | (F.size("expected.regions") > 0) | (F.col("is_remote") & (remote_only(F.col("location_tokens")) | remote_only(F.col("expected.tokens"))))
    layout = same["regions"] & ~same["tokens"] & (((expected == 0) & (stored == 0)) | (same["countries"] & (stored <= expected)))
    gap = (expected == 0) & (stored == 0) & ~accepted
    category = F.when(layout, "layout_only").when(gap, "code_gap_candidate").otherwise("hint_delta_or_stale")
    return rows.where(~(same["tokens"] & same["countries"] & same["regions"])).withColumn("reason", reason).withColumn("category", category)


CATEGORIES = ("hint_delta_or_stale", "layout_only", "code_gap_candidate")


def category_counts(found: DataFrame) -> DataFrame:
    """How many mismatches each category has, none included."""
    every = found.sparkSession.createDataFrame([(c,) for c in CATEGORIES], "category string")
    counts = found.groupBy("category").agg(F.count(F.lit(1)).alias("n"))
    return every.join(counts, "category", "left").select("category", F.coalesce("n", F.lit(0)).alias("n"))


def top_places(jobs: DataFrame, k: int = 40) -> DataFrame:
    """The most frequent raw locations."""
    return jobs.groupBy(_raw().alias("place")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "place").limit(k)


def role_counts(jobs: DataFrame) -> DataFrame:
    return jobs.groupBy(F.coalesce("role", F.lit("(null)")).alias("role")).agg(F.count(F.lit(1)).alias("n"))


def conditional_counts(jobs: DataFrame) -> DataFrame:
    """One pass over all postings: what is missing, and what a recomputation would change."""
    now = titles.read(jobs.withColumnsRenamed({"role": "_role", "seniorities": "_levels"}).drop("technologies"))
    role, levels = F.nullif("role", F.lit("other")), F.col("seniorities")
    return now.agg(
        F.count(F.lit(1)).alias("scanned"),
        F.count_if(F.col("_role").isNull()).alias("no_role"),
        F.count_if(F.size("_levels") == 0).alias("no_seniority"),
        F.count_if(F.size("stack") == 0).alias("no_stack"),
        F.count_if(~role.eqNullSafe(F.col("_role"))).alias("role_differs"),
        F.count_if(~_same(levels, F.col("_levels"))).alias("seniority_differs"),
    )


def intent_by_source(jobs: DataFrame) -> DataFrame:
    """For each company: whether some title asks for a software engineer, which do (sorted), and how many titles there are."""
    hit = titles.software_intent(F.col("title"))
    # Distinct titles first, so that a company's rows are few when they meet.
    rows = jobs.select("provider", "company", F.trim(F.coalesce("title", F.lit(""))).alias("title")).distinct()
    found = F.array_sort(F.collect_list(F.when(hit, F.col("title"))))
    return rows.groupBy("provider", "company").agg(F.bool_or(hit).alias("has_intent"), found.alias("titles"), F.count_if(F.col("title") != "").alias("n_scanned"))
