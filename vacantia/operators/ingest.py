"""Ingest: ids and hashes, insert-only dedup, snapshot reconciliation, catalog upserts, polling order.

Joins are equi-joins on ids and hashes, and only keys go through them; the relation itself stays where it is.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vacantia.functions import places, scripts, titles
from vacantia.functions.distinct import VALUE, by_value, by_values
from vacantia.operators import tables


def iso_millis(at: Column) -> Column:
    return F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def content_hash(location: str = "location") -> Column:
    """SHA-256 of what makes a posting the same."""
    low = lambda c: F.lower(F.coalesce(F.col(c), F.lit("")))
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    return F.sha2(F.concat_ws("|", text("provider"), text("external_id"), low("title"), low("company"), low(location), text("url"), F.coalesce(iso_millis(F.col("posted_at")), F.lit(""))), 256)


def _no_strings() -> Column:
    return F.array().cast("array<string>")


def with_facets(rows: DataFrame, terms: DataFrame, raw: str, flagged: Column, hints: Column | None = None, tied_titles: bool = True, further: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """`rows` with `geo_raw` (the formatted location without the employer), `shown_location`, `bare_title` and `facets`
    (a struct of tokens, countries and regions).

    All of it hangs on a title, a location, a flag, hints, and the employer where the location names it: it is worked out once
    for each distinct combination of these and joined back; so is what `further` adds to the combinations (which have `title`,
    `_flagged` and the columns above). What titles, locations and places say alone is worked out once for each of them.
    Where facets have no country, those that the title mentions stand in; with `tied_titles`, also those that it ties remote
    work to.
    """

    def mentioned(values: DataFrame) -> DataFrame:
        said = places.country_mentions(F.col(VALUE))
        said = F.array_union(said, places.remote_countries(F.col(VALUE))) if tied_titles else said
        return values.withColumn("_said", said).withColumn("bare_title", titles.bare_title(F.trim(F.coalesce(VALUE, F.lit("")))))

    def formatted(values: DataFrame) -> DataFrame:
        return values.withColumn("_formatted", places.formatted(F.col(VALUE))).withColumn("_flat", places.flattened(F.col("_formatted")))

    def located(values: DataFrame) -> DataFrame:
        values = by_value(values, "title", mentioned)
        values = values.withColumn("geo_raw", places.without_employer(F.col("_formatted"), F.col("_employer")))
        values = values.withColumn("_place", F.when(F.lower("geo_raw") == "unknown", F.lit("")).otherwise(F.col("geo_raw")))
        found = places.facets(values, terms, "_place").withColumn("_own", F.struct("tokens", "countries", "regions"))
        geography = (F.size("countries") > 0) | (F.size("regions") > 0)
        shown = {f"_shown_{k}": places.resolved(F.col("_place"), geography, F.lit(k == 1)) for k in (0, 1)}
        values = values.join(tables.stored(found.withColumns(shown).select("_place", "_own", *shown)), "_place")
        values = values.withColumn("shown_location", F.when(F.col("_flagged"), F.col("_shown_1")).otherwise(F.col("_shown_0")))
        none = _no_strings()
        remote = F.struct(F.array(F.lit("remote")).alias("tokens"), none.alias("countries"), none.alias("regions"))
        facets = F.when(F.col("shown_location") == "Remote", remote).otherwise(F.col("_own"))
        values = values.withColumn("_facets", facets if hints is None else places.merged_with_hints(facets, F.col("_hints")))
        use = (F.size("_facets.countries") == 0) & (F.size("_said") > 0)
        own = F.col("_facets")
        by_title = F.struct(F.array_union(own["tokens"], F.col("_said")).alias("tokens"), F.col("_said").alias("countries"), own["regions"].alias("regions"))
        values = values.withColumn("facets", F.when(use, by_title).otherwise(own)).drop("_place", "_own", "_facets", "_said", *shown)
        return values if further is None else further(values)

    # A null flag shows a location as false does.
    given = {"_flagged": F.coalesce(flagged, F.lit(False))} | ({} if hints is None else {"_hints": hints})
    rows = by_value(rows.withColumns(given), raw, formatted)
    rows = rows.withColumn("_employer", places.employer_in(F.col("_formatted"), F.col("company"), F.col("_flat"))).drop("_flat")
    return by_values(rows, ["title", "_formatted", "_employer", *given], located).drop("_formatted", "_employer", *given)


def classified(rows: DataFrame, terms: DataFrame) -> DataFrame:
    """Raw postings with display location, facets, role, stack, seniorities and hash.

    `rows` has the columns of a posting as a board gives it; `location_hints` (array of strings) and `description` are
    optional. Postings without a date are dropped. Titles, too, are read once each, in every form that a location may leave.
    """
    flagged = F.coalesce(F.col("is_flagged_remote"), F.lit(False))
    hints = F.coalesce("location_hints", _no_strings()) if "location_hints" in rows.columns else None
    given = rows.columns

    def titled(values: DataFrame) -> DataFrame:
        values = values.withColumn("_title", titles.without_location(F.trim("title"), F.col("shown_location"), F.col("bare_title")))
        possible = values.select("title").distinct().select(F.explode(titles.possible_titles(F.col("title"))))
        return titles.read(values, "_title", possible).withColumn("_stack", titles.shown_for(F.col("technologies"), F.col("role")))

    rows = with_facets(rows.where(F.col("posted_at").isNotNull()), terms, "location_raw", flagged, hints, further=titled)
    rows = rows.withColumns(
        {
            "location_raw": F.col("geo_raw"),
            "location": F.col("shown_location"),
            "location_tokens": F.col("facets.tokens"),
            "location_countries": F.col("facets.countries"),
            "location_regions": F.col("facets.regions"),
            "is_remote": flagged | F.lower("geo_raw").contains("remote"),
            "title": F.col("_title"),
        }
    )
    stack = F.col("_stack")
    if "description" in rows.columns:
        named = F.array_union(F.col("technologies"), titles.stacks_named(F.lit(""), F.col("description")))
        rows = rows.withColumn("role", titles.role_with_description(F.col("title"), F.col("role"), F.col("description")))
        stack = titles.shown_for(named, F.col("role"))
    rows = rows.withColumn("stack", stack).withColumn("role", F.nullif("role", F.lit("other")))
    if "experience" in rows.columns:
        levels = F.when(F.size("seniorities") > 0, F.col("seniorities")).otherwise(titles.experience_levels(F.col("experience")))
        rows = rows.withColumn("seniorities", levels)
    rows = rows.withColumn("id", F.concat_ws(":", "provider", "external_id"))
    given = [c for c in given if c not in ("description", "location_hints", "experience", "is_flagged_remote")]
    derived = ("location", "location_tokens", "location_countries", "location_regions", "is_remote", "role", "seniorities", "stack", "id", "hash")
    return rows.withColumn("hash", content_hash()).select(*given, *(c for c in derived if c not in given))


def first_of_each(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The first row of each key; a null key is no key."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return rows.withColumn("_n", rank).where((F.col("_n") == 1) | F.col(key).isNull()).drop("_n")


def new_only(incoming: DataFrame, stored: DataFrame, order: list[str] | None = None) -> DataFrame:
    """Incoming postings whose id and hash are neither stored nor met before in the batch. Nothing stored is changed."""
    order = order or ["posted_at", "id"]
    fresh = incoming.join(stored.select("id").distinct(), "id", "left_anti").join(stored.select("hash").distinct(), "hash", "left_anti")
    return first_of_each(first_of_each(fresh, "id", order), "hash", order).select(*incoming.columns)


def reconciled(stored: DataFrame, scope: DataFrame, fetched: DataFrame) -> DataFrame:
    """`stored` without the postings of a fetched scope (provider, company) that its snapshot no longer holds.

    An empty snapshot removes all of its scope, so the scope comes as a table of its own. `fetched` has ids.
    """
    return stored.join(missing(stored, scope, fetched), "id", "left_anti").select(*stored.columns)


def missing(stored: DataFrame, scope: DataFrame, fetched: DataFrame) -> DataFrame:
    """Distinct ids of a fetched scope that its snapshot no longer holds."""
    gone = stored.join(scope.select("provider", "company").distinct(), ["provider", "company"], "left_semi").join(fetched.select("id").distinct(), "id", "left_anti")
    return gone.select("id").distinct()


def upserted(stored: DataFrame, incoming: DataFrame, keys: list[str], resets: dict[str, Column], order: str) -> DataFrame:
    """Stored rows replaced by incoming ones with the same keys, the last by `order`; columns in `resets` are set anew.

    Incoming rows of equal order are told apart by all their columns, so that the result doesn't hang on chance.
    """
    ties = F.xxhash64(*[c for c in incoming.columns if c != order])
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(order), ties))
    last = incoming.withColumn("_n", rank).where("_n = 1").drop("_n")
    last = last.withColumns(resets)
    untouched = stored.join(last.select(*keys), keys, "left_anti")
    return untouched.unionByName(last.select(*stored.columns))


def changed_only(stored: DataFrame, recomputed: DataFrame, columns: list[str]) -> DataFrame:
    """id and the new values of rows whose recomputed columns differ: what a backfill would write, or report in a dry run."""
    new = recomputed.select("id", *(F.col(c).alias(f"new_{c}") for c in columns))
    joined = stored.select("id", *columns).join(new, "id")
    differs = F.lit(False)
    for c in columns:
        differs = differs | ~F.col(c).eqNullSafe(F.col(f"new_{c}"))
    return joined.where(differs)


def updated(stored: DataFrame, changes: DataFrame, columns: list[str]) -> DataFrame:
    """`stored` with the changes of `changed_only` applied."""
    rows = stored.join(changes.select("id", F.lit(True).alias("_hit"), *(f"new_{c}" for c in columns)), "id", "left")
    picked = [F.when(F.col("_hit"), F.col(f"new_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in stored.columns]
    return rows.select(*picked)


def staggered(sources: DataFrame, step_ms: int = 400) -> DataFrame:
    """Active sources with the delay of their fetch: by name within a provider."""
    place = F.row_number().over(Window.partitionBy("provider").orderBy("name", "external_id"))
    return sources.where("is_active").withColumn("delay_ms", ((place - 1) * step_ms).cast("long"))


def source_by_id(sources: DataFrame, id: str, provider: str) -> DataFrame:
    """The active source of this id and provider, if there is one."""
    return sources.where((F.col("id") == id) & (F.col("provider") == provider) & F.col("is_active")).limit(1)


#: Providers are polled in this order.
PROVIDERS = ("ashby", "greenhouse", "workable", "lever")


def poll_messages(sources: DataFrame, open_circuits: tuple[str, ...] | DataFrame = (), step_ms: int = 400) -> DataFrame:
    """source_id, provider, provider_order and delay_ms of each fetch of a poll: active sources of providers whose circuit is closed.

    The open ones come as names or as a table with `provider`, such as `streaming.gate.open_circuits` makes.
    """
    order = F.array_position(F.array(*map(F.lit, PROVIDERS)), F.col("provider"))
    rows = sources.where(order > 0)
    if isinstance(open_circuits, DataFrame):
        rows = rows.join(open_circuits.select("provider").distinct(), "provider", "left_anti")
    elif open_circuits:
        rows = rows.where(~F.col("provider").isin(*open_circuits))
    return staggered(rows, step_ms).select(F.col("id").alias("source_id"), "provider", order.cast("int").alias("provider_order"), "delay_ms")


def met_sources(messages: DataFrame, sources: DataFrame) -> DataFrame:
    """Messages with their source's external_id and name; those whose source is gone, inactive or another provider's leave."""
    known = sources.where("is_active").select(F.col("id").alias("source_id"), "provider", "external_id", "name")
    return messages.join(known, ["source_id", "provider"])


def removed_counts(stored: DataFrame, kept: DataFrame) -> DataFrame:
    """How many postings each (provider, company) lost between two states of the relation; those that lost none aren't listed."""
    count = lambda rows, name: rows.groupBy("provider", "company").agg(F.count(F.lit(1)).alias(name))
    both = count(stored, "before").join(count(kept, "after"), ["provider", "company"], "left")
    lost = both.select("provider", "company", (F.col("before") - F.coalesce("after", F.lit(0))).alias("removed"))
    return lost.where("removed > 0")


def synced(sources: DataFrame, outcomes: DataFrame, at: Column) -> DataFrame:
    """Sources after a poll. `outcomes` has source_id and ok: success sets status and time, an error the status alone."""
    by = outcomes.groupBy(F.col("source_id").alias("id")).agg(F.bool_and("ok").alias("_ok"))
    rows = sources.join(by, "id", "left")
    status = F.when(F.col("_ok"), "success").when(~F.col("_ok"), "error").otherwise(F.col("sync_status"))
    last = F.when(F.col("_ok"), at).otherwise(F.col("last_synced_at"))
    return rows.withColumns({"sync_status": status, "last_synced_at": last}).select(*sources.columns)


def polled(jobs: DataFrame, sources: DataFrame, outcomes: DataFrame, fetched: DataFrame, at: Column) -> tuple[DataFrame, DataFrame]:
    """Jobs and sources after one poll. `fetched` has the postings (all columns of `jobs`) of the sources that answered.

    Each answer is a complete snapshot of its source: what is new comes in, what is missing goes. A source that failed
    keeps its postings and is marked. What comes and the ids that go are written: neither is worked out again where jobs are
    read, and no task holds the sorts of both.
    """
    answered = outcomes.where("ok").join(sources.withColumnRenamed("id", "source_id"), "source_id").select("provider", F.col("name").alias("company"))
    came = jobs.unionByName(tables.stored(new_only(fetched, jobs)))
    gone = tables.stored(missing(came, answered, fetched))
    return came.join(gone, "id", "left_anti").select(*jobs.columns), synced(sources, outcomes, at)


def recovered_hints() -> Column:
    """Hints that stored facets keep of a board's own: countries, and tokens that are two letters."""
    low = lambda c: F.transform(F.col(c), lambda x: F.lower(F.trim(x)))
    return F.array_distinct(F.concat(F.filter(low("location_countries"), lambda x: x != ""), F.filter(low("location_tokens"), lambda x: x.rlike("^[a-z]{2}$"))))


def facet_backfill(jobs: DataFrame, terms: DataFrame, provider: str = "lever") -> DataFrame:
    """id and new_location_* of one board's postings whose facets, made anew with the hints they keep, differ whatever their order."""
    rows = jobs.where(F.col("provider") == provider).withColumn("_raw", F.coalesce("location_raw", "location", F.lit(""))).withColumn("_hints", recovered_hints())
    found = with_facets(rows, terms, "_raw", F.col("is_remote"), F.col("_hints"))
    parts = ("tokens", "countries", "regions")
    key = lambda c: F.array_sort(F.transform(c, F.lower))
    differs = F.lit(False)
    for k in parts:
        differs = differs | (key(F.col(f"location_{k}")) != key(F.col(f"facets.{k}")))
    return found.where(differs).select("id", *(F.col(f"facets.{k}").alias(f"new_location_{k}") for k in parts))


def in_other_scripts(jobs: DataFrame) -> DataFrame:
    """Postings whose location, raw or shown, has letters of a script that isn't Latin, or a back-tick."""
    odd = lambda c: F.coalesce(scripts.other_script(F.col(c)) | F.col(c).contains("`"), F.lit(False))
    return jobs.where(odd("location") | odd("location_raw"))


def romanized_backfill(jobs: DataFrame) -> DataFrame:
    """id and new_location, new_location_raw of postings whose location in Latin letters is another text."""
    rows = in_other_scripts(jobs).select("id", "location", "location_raw")
    for c in ("location", "location_raw"):
        rows = by_value(rows, c, lambda values, c=c: scripts.romanized(values, VALUE, f"new_{c}"))
    return rows.where(~F.col("location").eqNullSafe(F.col("new_location")) | ~F.col("location_raw").eqNullSafe(F.col("new_location_raw"))).select("id", "new_location", "new_location_raw")


def source_lookup(sources: DataFrame, name: str) -> DataFrame:
    """The active source of that name or external id, white space and case aside; none for a blank name."""
    low = name.strip().lower()
    if not low:
        return sources.limit(0)
    hit = (F.lower("name") == low) | (F.lower("external_id") == low)
    return sources.where(F.col("is_active") & hit).orderBy("provider", "external_id").limit(1)
