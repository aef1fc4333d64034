"""The registered queries of this package, with the SQL that gives the same rows.

Arrays are shown sorted and joined by commas, times as ISO strings.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable
from dataclasses import replace
from functools import reduce
from itertools import islice

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vacantia.functions import places, titles
from vacantia.functions.text import sql_has, without_tags
from vacantia.operators import audits, ingest, search, versions
from vacantia.operators.feedstore import FeedStore
from vacantia.operators.relation import Relation
from vacantia.operators.tables import shared_folder, stored, stored_once
from vacantia.plans import classified_sql
from vacantia.plans.synthetic import POSTINGS_SQL, postings
from vacantia.sources import boards, companies, links
from vacantia.streaming import gate, state

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Register a query under its function's name."""

    def put(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


def shown(c: str | Column) -> Column:
    return F.array_join(F.sort_array(F.coalesce(F.col(c) if isinstance(c, str) else c, F.array().cast("array<string>"))), ",")


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classified postings, stored as ingest leaves them: searches and audits of one application read one relation."""
    rows = postings(spark, sf_dir)
    return stored_once(spark, "postings", rows, lambda: ingest.classified(rows, places.gazetteer(spark)))


def latest(rows: DataFrame) -> DataFrame:
    """A column _as_of: the newest posting's time, so that results don't hang on the clock."""
    return rows.crossJoin(F.broadcast(rows.agg(F.max("posted_at").alias("_as_of"))))


_ROLE, _LEVELS = titles.sql_role_of("title"), titles.sql_seniorities_of("title")
_ISO = "strftime(posted_at, '%Y-%m-%dT%H:%M:%S.%gZ')"
# Plain: postings with what their title says, without the location work.
_TITLED = f"(SELECT *, nullif({_ROLE}, 'other') AS role, {_LEVELS} AS seniorities FROM {POSTINGS_SQL})"


def titled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return titles.read(postings(spark, sf_dir)).withColumn("role", F.nullif("role", F.lit("other")))


@query(f"SELECT id, title, role FROM {_TITLED}")
def role_from_title(spark, sf_dir):
    return titled(spark, sf_dir).select("id", "title", "role")


@query(f"SELECT coalesce(role, '(null)') AS role, count(*) AS n FROM {_TITLED} GROUP BY 1")
def role_distribution(spark, sf_dir):
    return audits.role_counts(titled(spark, sf_dir))


@query(f"SELECT id, array_to_string(list_sort(string_split(seniorities, ',')), ',') AS seniorities FROM {_TITLED}")
def seniority_from_title(spark, sf_dir):
    return titled(spark, sf_dir).select("id", shown("seniorities").alias("seniorities"))


def _sql_stack(role: str) -> str:
    every = titles.sql_stack_lists("lower(coalesce(title, ''))")
    of = lambda group: "[" + ", ".join(f"'{s}'" for s in group) + "]"
    cases = " ".join(f"WHEN {role} = '{r}' THEN list_intersect({every}, {of(g)})" for r, g in titles.ROLE_STACKS.items())
    stackless = ", ".join(f"'{r}'" for r in titles.STACKLESS_ROLES)
    return f"CASE WHEN {role} IN ({stackless}) THEN [] {cases} ELSE {every} END"


@query(f"SELECT id, array_to_string(list_sort({_sql_stack('role')}), ',') AS stack FROM {_TITLED}")
def stack_from_text(spark, sf_dir):
    return titled(spark, sf_dir).select("id", shown(titles.shown_for(F.col("technologies"), F.col("role"))).alias("stack"))


@query(f"SELECT id FROM {_TITLED} WHERE list_has_any({_sql_stack('role')}, ['python', 'react'])")
def stack_overlap_filter(spark, sf_dir):
    stack = titles.shown_for(F.col("technologies"), F.col("role"))
    return titled(spark, sf_dir).where(F.arrays_overlap(stack, F.array(F.lit("python"), F.lit("react")))).select("id")


def _sql_role_matches(role: str) -> str:
    keywords = " OR ".join(titles.sql_title_keyword("title", k) for k in titles.ROLE_KEYWORDS[role])
    return f"(role = '{role}' OR (role IS NULL AND ({keywords})))"


@query(f"SELECT id, title, {_ISO} AS posted_at, epoch_ms((SELECT max(posted_at) FROM {POSTINGS_SQL})) - epoch_ms(posted_at) <= 86400000 AS is_new FROM {_TITLED} WHERE {_sql_role_matches('backend')} ORDER BY posted_at DESC, id LIMIT 50")
def feed_role_page(spark, sf_dir):
    """A page is a limit by its nature."""
    rows = latest(titled(spark, sf_dir)).where(search.role_matches("backend")).orderBy(F.desc("posted_at"), "id").limit(50)
    new = F.unix_millis("_as_of") - F.unix_millis("posted_at") <= search.DAY_MS
    return rows.select("id", "title", ingest.iso_millis(F.col("posted_at")).alias("posted_at"), new.alias("is_new"))


@query(f"SELECT CAST(1 AS INTEGER) AS page, CAST(50 AS INTEGER) AS page_size, count(*) AS total, CAST(greatest(1, ceil(count(*) / 50)) AS BIGINT) AS total_pages FROM {POSTINGS_SQL}")
def feed_total_pages(spark, sf_dir):
    return search.totals(postings(spark, sf_dir), search.Request())


@query(f"SELECT id, {' OR '.join(titles.sql_title_keyword('title', k) for k in titles.ROLE_KEYWORDS['ai'])} AS hit FROM {POSTINGS_SQL}")
def title_keyword_match(spark, sf_dir):
    hit = F.lit(False)
    for k in titles.ROLE_KEYWORDS["ai"]:
        hit = hit | titles.title_keyword(F.col("title"), k)
    return postings(spark, sf_dir).select("id", hit.alias("hit"))


@query(f"SELECT id, {titles.sql_without_location('title', 'location_raw')} AS title FROM {POSTINGS_SQL}")
def title_location_strip(spark, sf_dir):
    return postings(spark, sf_dir).select("id", titles.without_location(F.col("title"), F.col("location_raw")).alias("title"))


@query(f"SELECT id, {places.sql_formatted('location_raw')} AS location FROM {POSTINGS_SQL}")
def raw_location_format(spark, sf_dir):
    return postings(spark, sf_dir).select("id", places.formatted(F.col("location_raw")).alias("location"))


@query(f"SELECT id, array_to_string({places.sql_segments('location_raw')}, '#') AS segments FROM {POSTINGS_SQL}")
def location_segments(spark, sf_dir):
    return postings(spark, sf_dir).select("id", F.array_join(places.segments(F.col("location_raw")), "#").alias("segments"))


@query(places.sql_facets(POSTINGS_SQL))
def location_facets(spark, sf_dir):
    found = places.facets(postings(spark, sf_dir), places.gazetteer(spark))
    return found.select("location_raw", shown("tokens").alias("tokens"), shown("countries").alias("countries"), shown("regions").alias("regions"))


@query(f"SELECT id, {places.sql_country_hint('location_raw')} AS hint FROM {POSTINGS_SQL} WHERE location_raw IS NOT NULL")
def country_hint_canonical(spark, sf_dir):
    return postings(spark, sf_dir).where("location_raw IS NOT NULL").select("id", places.country_hint(F.col("location_raw")).alias("hint"))


@query(f"SELECT id, {sql_has('title', places._tied(places.REMOTE_REGIONS))} OR {sql_has('location_raw', places._tied(places.REMOTE_REGIONS))} AS tied FROM {POSTINGS_SQL}")
def geo_scoped_remote(spark, sf_dir):
    tied = places.tied_to_region(F.col("title")) | places.tied_to_region(F.col("location_raw"))
    return postings(spark, sf_dir).select("id", tied.alias("tied"))


@query(
    """SELECT id, CASE WHEN contains(raw, '|') AND len(bars) > 0 THEN bars[1] WHEN provider = 'ashby' AND len(commas) > len(geo) THEN CASE WHEN len(geo) > 0 THEN geo[1] || ', Remote' ELSE 'Remote' END
       WHEN provider = 'ashby' AND len(commas) > 0 THEN commas[1] ELSE title END AS first_place,
       array_to_string(CASE WHEN contains(raw, '|') AND len(bars) > 0 THEN bars[2:] WHEN provider = 'ashby' AND len(commas) > len(geo) THEN list_filter(geo, lambda x: x <> geo[1])
       WHEN provider = 'ashby' AND len(commas) > 0 THEN commas[2:] ELSE [] END, '#') AS other_places
     FROM (SELECT *, list_filter(commas, lambda x: lower(x) <> 'remote') AS geo FROM (
       SELECT *, trim(coalesce(location_raw, '')) AS raw, list_filter(list_transform(string_split(trim(coalesce(location_raw, '')), '|'), lambda x: trim(x)), lambda x: x <> '') AS bars,
              list_filter(list_transform(string_split(trim(coalesce(location_raw, '')), ','), lambda x: trim(x)), lambda x: x <> '') AS commas FROM """
    + POSTINGS_SQL
    + "))"
)
def display_location_parts(spark, sf_dir):
    parts = places.display_parts(F.col("location_raw"), F.col("title"), F.col("provider"))
    return postings(spark, sf_dir).select("id", parts["primary"].alias("first_place"), F.array_join(parts["others"], "#").alias("other_places"))


_HASH = f"sha256(concat_ws('|', provider, external_id, lower(title), lower(company), lower(coalesce(location_raw, '')), url, {_ISO}))"
_HASHED = f"(SELECT *, {_HASH} AS hash FROM {POSTINGS_SQL})"


def hashed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return postings(spark, sf_dir).withColumn("hash", ingest.content_hash("location_raw"))


@query(f"SELECT id, hash FROM {_HASHED}")
def posting_id_hash(spark, sf_dir):
    return hashed(spark, sf_dir).select("id", "hash")


@query(f"SELECT id FROM {_HASHED} WHERE CAST(external_id AS BIGINT) % 3 <> 0")
def ingest_new_only(spark, sf_dir):
    rows = hashed(spark, sf_dir)
    return ingest.new_only(rows.unionByName(rows.where("external_id % 5 = 0")), rows.where("external_id % 3 = 0")).select("id")


@query(f"SELECT id FROM {POSTINGS_SQL} WHERE NOT (provider = 'lever' AND CAST(external_id AS BIGINT) % 2 = 1 AND CAST(external_id AS BIGINT) % 7 = 0)")
def reconcile_snapshot(spark, sf_dir):
    rows = postings(spark, sf_dir)
    scope = rows.where("provider = 'lever'")
    return ingest.reconciled(rows, scope, scope.where("NOT (external_id % 2 = 1 AND external_id % 7 = 0)")).select("id")


@query(f"SELECT id FROM {POSTINGS_SQL} WHERE provider <> 'ashby'")
def reconcile_empty_snapshot(spark, sf_dir):
    rows = postings(spark, sf_dir)
    return ingest.reconciled(rows, rows.where("provider = 'ashby'"), rows.limit(0)).select("id")


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source catalog made of suppliers."""
    return spark.read.parquet(f"{sf_dir}/supplier.parquet").select(
        F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("id"), F.element_at(F.array(*map(F.lit, boards.EXTRACTORS)), (F.col("s_suppkey") % 4 + 1).cast("int")).alias("provider"), F.col("s_suppkey").cast("string").alias("external_id"), F.col("s_name").alias("name"),
        (F.col("s_acctbal") > 0).alias("is_active"), F.lit("success").alias("sync_status"),
    )


_SOURCES = """(SELECT 's' || s_suppkey AS id, ['ashby', 'greenhouse', 'workable', 'lever'][s_suppkey % 4 + 1] AS provider, CAST(s_suppkey AS VARCHAR) AS external_id, s_name AS name,
  s_acctbal > 0 AS is_active, 'success' AS sync_status FROM supplier)"""


@query(f"SELECT provider, external_id, (row_number() OVER (PARTITION BY provider ORDER BY name, external_id) - 1) * 400 AS delay_ms FROM {_SOURCES} WHERE is_active")
def poll_stagger(spark, sf_dir):
    return ingest.staggered(sources(spark, sf_dir)).select("provider", "external_id", "delay_ms")


@query(f"SELECT provider, external_id, name FROM {_SOURCES} WHERE is_active AND (lower(name) = '7' OR lower(external_id) = '7') LIMIT 1")
def source_lookup(spark, sf_dir):
    return ingest.source_lookup(sources(spark, sf_dir), " 7 ").select("provider", "external_id", "name")


@query(f"SELECT provider, external_id, CASE WHEN CAST(external_id AS BIGINT) % 3 = 0 THEN name || ' new' ELSE name END AS name, CASE WHEN CAST(external_id AS BIGINT) % 3 = 0 THEN true ELSE is_active END AS is_active, CASE WHEN CAST(external_id AS BIGINT) % 3 = 0 THEN 'idle' ELSE sync_status END AS sync_status FROM {_SOURCES}")
def catalog_upsert(spark, sf_dir):
    stored = sources(spark, sf_dir).drop("id")
    old = stored.where("external_id % 3 = 0").withColumn("seq", F.lit(1))
    new = old.withColumn("name", F.concat("name", F.lit(" new"))).withColumn("seq", F.lit(2))
    return ingest.upserted(stored, old.unionByName(new), ["provider", "external_id"], {"is_active": F.lit(True), "sync_status": F.lit("idle")}, "seq")


@query(f"SELECT trim(coalesce(location_raw, '')) AS place, count(*) AS n FROM {POSTINGS_SQL} GROUP BY 1 ORDER BY n DESC, place LIMIT 40")
def audit_top_raw(spark, sf_dir):
    """A top-k report."""
    return audits.top_places(postings(spark, sf_dir).withColumn("location", F.lit(None).cast("string")))


@query(f"""SELECT count(*) AS scanned, count(*) FILTER (role IS NULL) AS no_role, count(*) FILTER (seniorities = '') AS no_seniority, count(*) FILTER (len(stack) = 0) AS no_stack
  FROM (SELECT *, {_sql_stack('role')} AS stack FROM {_TITLED})""")
def audit_conditional_counts(spark, sf_dir):
    rows = titled(spark, sf_dir).withColumn("stack", titles.shown_for(F.col("technologies"), F.col("role")))
    return audits.conditional_counts(rows).select("scanned", "no_role", "no_seniority", "no_stack")


_SOFT = sql_has("lower(title)", titles.SOFTWARE)


@query(
    f"""SELECT provider, company, coalesce(bool_or({_SOFT}), false) AS has_intent,
      coalesce(array_to_string(list_sort(list(DISTINCT trim(title)) FILTER ({_SOFT})), '|'), '') AS titles, count(DISTINCT nullif(trim(title), '')) AS n_scanned FROM {POSTINGS_SQL} GROUP BY 1, 2"""
)
def swe_intent_by_source(spark, sf_dir):
    return audits.intent_by_source(postings(spark, sf_dir)).withColumn("titles", F.array_join("titles", "|"))


@query(classified_sql.FEED)
def feed_preset_filtered(spark, sf_dir):
    """A whole request over classified postings, location filter included."""
    rows = latest(jobs(spark, sf_dir))
    request = search.Request.of(role="backend", stack=["python", "java"], seniority="senior", location=["Germany", "fully-remote"], limit=200)
    page = search.feed(rows, request, F.col("_as_of"))
    return page.withColumn("location_secondary", shown("location_secondary")).withColumn("stack", shown("stack")).withColumn("seniorities", shown("seniorities"))


@query(classified_sql.PREVIEW)
def preview_ranked_by_country(spark, sf_dir):
    rows = latest(jobs(spark, sf_dir))
    return search.preview(rows, "DE", F.col("_as_of")).withColumn("location_secondary", shown("location_secondary"))


@query(f"SELECT count(*) AS total FROM {POSTINGS_SQL}")
def preview_total(spark, sf_dir):
    return postings(spark, sf_dir).agg(F.count(F.lit(1)).alias("total"))


@query(classified_sql.FULLY_REMOTE)
def fully_remote(spark, sf_dir):
    return jobs(spark, sf_dir).where(search.fully_remote()).select("id", "location", "location_raw")


@query(classified_sql.HINTED)
def facet_hint_merge(spark, sf_dir):
    rows = postings(spark, sf_dir).withColumn("location_hints", F.when(F.col("external_id") % 2 == 0, F.array(F.lit("US | EU"), F.lit("emea"))))
    return ingest.classified(rows, places.gazetteer(spark)).select("id", shown("location_tokens").alias("tokens"), shown("location_countries").alias("countries"), shown("location_regions").alias("regions"))


@query(classified_sql.CLASSIFIED)
def classified_postings(spark, sf_dir):
    """Everything that ingest derives."""
    arrays = ("location_tokens", "location_countries", "location_regions", "stack", "seniorities")
    return jobs(spark, sf_dir).withColumns({c: shown(c) for c in arrays} | {"posted_at": ingest.iso_millis(F.col("posted_at"))})


@query(classified_sql.EMPTY_GEOGRAPHY)
def audit_empty_geo(spark, sf_dir):
    return audits.empty_geography(jobs(spark, sf_dir)).select("id", "location_raw")


@query(classified_sql.MISMATCHES)
def audit_mismatch_categories(spark, sf_dir):
    """Stored facets of every fifth posting are disturbed first."""
    odd = F.col("external_id") % 5 == 0
    rows = jobs(spark, sf_dir).withColumn("location_tokens", F.when(odd, F.array(F.lit("x"))).otherwise(F.col("location_tokens")))
    return audits.category_counts(audits.mismatches(rows, places.gazetteer(spark)))


_HREFS = r"""(SELECT page_id, generate_subscripts(h, 1) AS position, regexp_replace(trim(unnest(h)), ',+$', '') AS href
  FROM (SELECT page_id, regexp_extract_all(coalesce(html, ''), '(?is)<a\b[^>]*?\bhref\s*=\s*["'']([^"'']*)["'']', 1) AS h FROM pages))"""


@query(f"SELECT page_id, CAST(position AS BIGINT) AS position, href FROM {_HREFS}")
def page_links(spark, sf_dir):
    return links.links(spark.read.parquet(f"{sf_dir}/pages.parquet"))


@query(f"SELECT page_id, CAST(min(position) AS BIGINT) AS position, href FROM {_HREFS} GROUP BY page_id, href")
def page_first_links(spark, sf_dir):
    return links.first_links(spark.read.parquet(f"{sf_dir}/pages.parquet")).select("page_id", "position", "href")


@query("SELECT lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)', 1)) AS host, count(*) AS n FROM pages GROUP BY 1")
def page_link_hosts(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/pages.parquet").groupBy(links.host(F.col("url")).alias("host")).agg(F.count(F.lit(1)).alias("n"))


@query(r"SELECT page_id, trim(regexp_replace(regexp_replace(coalesce(html, ''), '<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS text FROM pages")
def html_strip(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", without_tags(F.col("html")).alias("text"))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    return rows.withColumn("at_ms", F.unix_millis(F.col("ts").cast("timestamp")))


@query(
    "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_ms(ts) RANGE BETWEEN 3599999 PRECEDING AND CURRENT ROW) AS n_recent FROM events WHERE event_type = 'error'"
)
def timeout_window_count(spark, sf_dir):
    return state.recent_counts(events(spark, sf_dir).where("event_type = 'error'"), "user_id", "at_ms", 3_600_000).select("event_id", "n_recent")


@query(classified_sql.BREAKER)
def breaker_opens(spark, sf_dir):
    machine = state.Breaker(window=6 * 3_600_000, threshold=3, cooldown=12 * 3_600_000)
    return state.folded(events(spark, sf_dir).where("event_type = 'error'"), machine, "user_id", "at_ms", "event_id").where("opens")


@query(classified_sql.LIMITER)
def limiter_decisions(spark, sf_dir):
    machine = state.Limiter(limit=5, ttl=6 * 3_600_000, block=3_600_000)
    return state.folded(events(spark, sf_dir), machine, "user_id", "at_ms", "event_id")


def landed(spark: SparkSession, sf_dir: str, provider: str) -> DataFrame:
    """Payloads of one board made of the synthetic postings: a response for each company and about a hundred of its postings."""
    rows = postings(spark, sf_dir).where(F.col("provider") == provider)
    counts = rows.groupBy("company").agg(F.ceil(F.count(F.lit(1)) / boards.PAGE_ROWS).alias("_pages"))
    rows = rows.join(counts, "company").withColumn("_page", F.pmod(F.xxhash64("external_id"), "_pages"))
    ms = F.unix_millis("posted_at")
    at = ingest.iso_millis(F.col("posted_at"))
    shape = {
        "ashby": F.struct(F.col("external_id").alias("id"), "title", F.col("location_raw").alias("location"), F.col("is_flagged_remote").alias("isRemote"), at.alias("publishedAt"), F.col("url").alias("jobUrl")),
        "greenhouse": F.struct(F.col("external_id").cast("long").alias("id"), "title", F.struct(F.col("location_raw").alias("name")).alias("location"), at.alias("updated_at"), F.col("url").alias("absolute_url")),
        "workable": F.struct(F.col("external_id").alias("id"), "title", F.struct(F.col("location_raw").alias("location_str"), F.col("is_flagged_remote").alias("telecommuting")).alias("location"), at.alias("created_at"), "url"),
        "lever": F.struct(F.col("external_id").alias("id"), F.col("title").alias("text"), F.struct(F.col("location_raw").alias("location")).alias("categories"), F.when(F.col("is_flagged_remote"), "remote").alias("workplaceType"), ms.alias("createdAt"), F.col("url").alias("hostedUrl")),
    }[provider]
    grouped = rows.groupBy("company", "_page").agg(F.collect_list(shape).alias("jobs"))
    whole = F.to_json(F.struct("jobs")) if provider in boards.WRAPPED else F.to_json("jobs")
    return grouped.select(F.col("company").alias("slug"), "company", whole.alias("payload"))


def _extracted(provider: str) -> None:
    flagged = {"greenhouse": "(contains(lower(coalesce(location_raw, '')), 'remote') OR contains(lower(coalesce(location_raw, '')), 'anywhere'))"}.get(provider, "is_flagged_remote")
    sql = f"""SELECT external_id, trim(title) AS title, company, coalesce(nullif(trim(coalesce(location_raw, '')), ''), 'Unknown') AS location_raw, {_ISO} AS posted_at, {flagged} AS is_flagged_remote, url
      FROM {POSTINGS_SQL} WHERE provider = '{provider}' AND {"trim(title)" if provider == "lever" else "title"} <> ''"""

    def run(spark, sf_dir):
        rows = boards.extract(landed(spark, sf_dir, provider), provider, F.lit("2000-01-01").cast("timestamp"))
        return rows.select("external_id", "title", "company", "location_raw", ingest.iso_millis(F.col("posted_at")).alias("posted_at"), "is_flagged_remote", "url")

    run.__name__ = f"extract_{provider}"
    query(sql)(run)


for _provider in boards.EXTRACTORS:
    _extracted(_provider)


# Sources, polls and snapshots.


@query(
    f"""SELECT id AS source_id, provider, CASE provider WHEN 'ashby' THEN 1 WHEN 'greenhouse' THEN 2 WHEN 'workable' THEN 3 ELSE 4 END AS provider_order,
      (row_number() OVER (PARTITION BY provider ORDER BY name, external_id) - 1) * 400 AS delay_ms FROM {_SOURCES} WHERE is_active AND provider <> 'workable'"""
)
def poll_messages(spark, sf_dir):
    """A poll while Workable's circuit is open."""
    return ingest.poll_messages(sources(spark, sf_dir), ("workable",))


@query(f"SELECT id, provider, external_id, name FROM {_SOURCES} WHERE id = 's7' AND provider = 'lever' AND is_active")
def source_by_id(spark, sf_dir):
    return ingest.source_by_id(sources(spark, sf_dir), "s7", "lever").select("id", "provider", "external_id", "name")


@query(f"SELECT id AS source_id, provider, external_id, name FROM {_SOURCES} WHERE is_active AND CAST(external_id AS BIGINT) % 3 <> 0")
def messages_with_sources(spark, sf_dir):
    """Every third message names a provider that isn't its source's."""
    wrong = F.col("external_id") % 3 == 0
    messages = sources(spark, sf_dir).select(F.col("id").alias("source_id"), F.when(wrong, "none").otherwise(F.col("provider")).alias("provider"))
    return ingest.met_sources(messages, sources(spark, sf_dir)).select("source_id", "provider", "external_id", "name")


def _outcomes(rows: DataFrame) -> DataFrame:
    """Sources by number: multiples of 3 answer, others that leave 1 fail, the rest isn't polled."""
    number = F.col("external_id").cast("long")
    return rows.where(number % 3 < 2).select(F.col("id").alias("source_id"), (number % 3 == 0).alias("ok"))


@query(
    f"""SELECT id, CASE CAST(external_id AS BIGINT) % 3 WHEN 0 THEN 'success' WHEN 1 THEN 'error' ELSE sync_status END AS sync_status,
      CASE CAST(external_id AS BIGINT) % 3 WHEN 0 THEN '2024-02-01' ELSE '2024-01-01' END AS last_synced FROM {_SOURCES}"""
)
def source_sync_status(spark, sf_dir):
    rows = sources(spark, sf_dir).withColumn("last_synced_at", F.lit("2024-01-01").cast("timestamp"))
    after = ingest.synced(rows, _outcomes(rows), F.lit("2024-02-01").cast("timestamp"))
    return after.select("id", "sync_status", F.date_format("last_synced_at", "yyyy-MM-dd").alias("last_synced"))


def _poll(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Stored are postings that are no multiple of 4; companies that are multiples of 3 answer with what is no multiple of 5, others fail."""
    source = postings(spark, sf_dir)
    rows = stored_once(spark, "hashed", source, lambda: hashed(spark, sf_dir))
    companies = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").cast("string").alias("n"), F.col("c_name").alias("name"))
    known = companies.select("n", "name", F.explode(F.array(*map(F.lit, ingest.PROVIDERS))).alias("provider"))
    known = known.select(F.concat_ws(":", "n", "provider").alias("id"), "provider", F.col("n").alias("external_id"), "name", F.lit(True).alias("is_active"), F.lit("idle").alias("sync_status"), F.lit(None).cast("timestamp").alias("last_synced_at"))
    outcomes = known.select(F.col("id").alias("source_id"), (F.col("external_id") % 3 == 0).alias("ok"))
    answering = known.where("external_id % 3 = 0").select("provider", F.col("name").alias("company"))
    fetched = stored(rows.where("external_id % 5 <> 0").join(answering, ["provider", "company"]).select(*rows.columns))
    return ingest.polled(rows.where("external_id % 4 <> 0"), known, outcomes, fetched, F.lit("2024-02-01").cast("timestamp")) + (rows.where("external_id % 4 <> 0"),)


@query(
    f"""SELECT p.id FROM {POSTINGS_SQL} p JOIN customer c ON c.c_name = p.company
      WHERE CASE WHEN c_custkey % 3 = 0 THEN CAST(external_id AS BIGINT) % 5 <> 0 ELSE CAST(external_id AS BIGINT) % 4 <> 0 END"""
)
def poll_with_snapshots(spark, sf_dir):
    return _poll(spark, sf_dir)[0].select("id")


@query(
    f"""SELECT provider, company, count(*) AS removed FROM {POSTINGS_SQL} p JOIN customer c ON c.c_name = p.company
      WHERE c_custkey % 3 = 0 AND CAST(external_id AS BIGINT) % 4 <> 0 AND CAST(external_id AS BIGINT) % 5 = 0 GROUP BY 1, 2"""
)
def poll_removed_counts(spark, sf_dir):
    after, _, before = _poll(spark, sf_dir)
    kept = stored(after.select("id"))
    return ingest.removed_counts(before, before.join(kept, "id", "left_semi"))


# Companies behind links.


def company_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page for each supplier that links to its board, in one of six ways."""
    n = F.col("s_suppkey")
    url = F.concat(F.element_at(F.array(F.lit("https://boards.greenhouse.io/Co"), F.lit("https://jobs.ashbyhq.com/Co%20"), F.lit("https://apply.workable.com/Co")), (n % 3 + 1).cast("int")), n.cast("string"), F.lit("/jobs,"))
    name = F.col("s_name")
    a = lambda attrs, inside: F.concat(F.lit("<a href='"), url, F.lit(f"' {attrs}>"), inside, F.lit("</a>"))
    ways = [
        a("", F.concat(F.lit("<img alt=' "), name, F.lit(" '>Apply"))),
        F.concat(F.lit("<a href='"), url, F.lit("' aria-label=\""), name, F.lit("\">Jobs</a>")),
        a("", F.concat(F.lit("<b>"), name, F.lit("</b>"))),
        F.concat(F.lit("<ul><li><h3>"), name, F.lit("</h3> "), a("", F.lit("Apply now")), F.lit("</li></ul>")),
        F.concat(F.lit("<div class='company-row'>"), name, F.lit(" "), a("title='here'", F.lit("View jobs")), F.lit("</div>")),
        a("", F.lit("Careers")),
    ]
    html = F.concat(F.lit("<html><body><a href='#top'>Top</a>"), F.element_at(F.array(*ways), (n % 6 + 1).cast("int")), F.lit("<a href='https://example.org/'>Else</a></body></html>"))
    return spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").alias("page_id"), html.alias("html"))


@query(
    """SELECT ['greenhouse', 'ashby', 'workable'][s_suppkey % 3 + 1] AS provider, ['co', 'co ', 'co'][s_suppkey % 3 + 1] || s_suppkey AS external_id,
      CASE WHEN s_suppkey % 6 <> 5 THEN s_name END AS name FROM supplier"""
)
def page_companies(spark, sf_dir):
    return companies.page_companies(company_pages(spark, sf_dir))


@query("SELECT ['greenhouse', 'ashby', 'workable'][s_suppkey % 3 + 1] AS provider, count(*) AS n FROM supplier GROUP BY 1")
def companies_by_provider(spark, sf_dir):
    return companies.by_provider(companies.page_companies(company_pages(spark, sf_dir)))


@query(
    """SELECT s_suppkey AS n, CASE s_suppkey % 5 WHEN 0 THEN 'https://boards-api.greenhouse.io/v1/boards/' || slug || '/jobs?content=true'
      WHEN 1 THEN 'https://api.ashbyhq.com/posting-api/job-board/' || slug WHEN 2 THEN 'https://www.workable.com/api/accounts/' || slug || '?details=true'
      WHEN 3 THEN CASE WHEN s_suppkey % 2 = 0 THEN 'https://api.eu.lever.co/v0/postings/' ELSE 'https://api.lever.co/v0/postings/' END || slug || '?mode=json&limit=1' END AS url
      FROM (SELECT s_suppkey, 'a%20(%C3%A9)''%26' || s_suppkey AS slug FROM supplier)"""
)
def source_urls(spark, sf_dir):
    n = F.col("s_suppkey")
    provider = F.element_at(F.array(*map(F.lit, ("greenhouse", "ashby", "workable", "lever", "other"))), (n % 5 + 1).cast("int"))
    rows = spark.read.parquet(f"{sf_dir}/supplier.parquet")
    return rows.select(n.alias("n"), companies.api_url(provider, F.concat(F.lit("a (é)'&"), n.cast("string")), F.when(n % 2 == 0, " EU ")).alias("url"))


@query(
    """SELECT provider, external_id, name, url, CASE WHEN n % 4 = 0 THEN 'invalid' WHEN n % 4 = 1 THEN 'ok' WHEN n % 4 = 2 THEN 'warn' ELSE 'error' END AS result FROM (
      SELECT s_suppkey AS n, 'greenhouse' AS provider, CAST(s_suppkey AS VARCHAR) AS external_id, s_name AS name, 'https://boards-api.greenhouse.io/v1/boards/' || s_suppkey || '/jobs?content=true' AS url FROM supplier)"""
)
def probed_sources(spark, sf_dir):
    rows = sources(spark, sf_dir).withColumn("provider", F.lit("greenhouse")).withColumn("api_region", F.lit(None).cast("string"))
    status = F.element_at(F.array(F.lit(404), F.lit(204), F.lit(500), F.lit(None).cast("int")), (F.col("external_id") % 4 + 1).cast("int"))
    return companies.probed(rows, rows.select("provider", "external_id", status.alias("status"), (F.col("external_id") % 8 == 3).alias("failed")))


def _payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One payload for each even supplier, with titles at two depths; multiples of 10 are broken JSON."""
    n = F.col("external_id").cast("long")
    title = F.when(n % 4 == 0, "Senior Software Engineer").otherwise("Accountant")
    good = F.to_json(F.struct(F.lit(" ").alias("company_name"), F.concat(F.lit("W "), F.col("name")).alias("name"), F.array(F.struct(title.alias("title"), F.struct(F.lit("SWE, Tools").alias("TITLE"), F.concat(F.lit(" G "), F.col("name")).alias("company_name")).alias("inner")), F.struct(F.lit(" SWE, Tools ").alias("title"), F.struct(F.lit("Cook").alias("TITLE"), F.lit("").alias("company_name")).alias("inner"))).alias("jobs")))
    return sources(spark, sf_dir).where(n % 2 == 0).select("provider", "external_id", F.when(n % 10 == 0, "{broken").otherwise(good).alias("payload"))


@query(
    f"""SELECT provider, external_id, CASE provider WHEN 'greenhouse' THEN 'G ' || name WHEN 'workable' THEN 'W ' || name ELSE name END AS name,
      CASE WHEN n % 4 = 0 THEN 'SWE, Tools|Senior Software Engineer' ELSE 'SWE, Tools' END AS titles, CAST(3 AS BIGINT) AS n_scanned
      FROM (SELECT *, CAST(external_id AS BIGINT) AS n FROM {_SOURCES}) WHERE n % 2 = 0 AND n % 10 <> 0"""
)
def verified_companies(spark, sf_dir):
    entries = sources(spark, sf_dir).select("provider", "external_id", "name")
    return companies.verified(entries, _payloads(spark, sf_dir)).withColumn("titles", F.array_join("titles", "|"))


@query(f"SELECT external_id, CASE WHEN n % 10 = 0 THEN '' WHEN n % 4 = 0 THEN 'Senior Software Engineer|SWE, Tools| SWE, Tools |Cook' ELSE 'Accountant|SWE, Tools| SWE, Tools |Cook' END AS found FROM (SELECT *, CAST(external_id AS BIGINT) AS n FROM {_SOURCES}) WHERE n % 2 = 0")
def payload_fields(spark, sf_dir):
    return companies.fields_named(_payloads(spark, sf_dir), ("title",)).select("external_id", F.array_join("values", "|").alias("found"))


@query(f"SELECT provider, external_id, name FROM {_SOURCES} WHERE provider <> 'lever' AND CAST(external_id AS BIGINT) % 7 <> 0")
def valid_catalog_entries(spark, sf_dir):
    rows = sources(spark, sf_dir).withColumn("external_id", F.when(F.col("external_id") % 7 != 0, F.col("external_id")))
    return companies.valid_entries(rows).select("provider", "external_id", "name")


@query(
    f"""SELECT provider, external_id, name FROM (SELECT *, row_number() OVER (PARTITION BY provider, lower(external_id) ORDER BY run DESC) AS r FROM (
      SELECT 0 AS run, provider, 'co' || external_id AS external_id, name FROM {_SOURCES}
      UNION ALL SELECT 1, provider, 'CO' || external_id, 'new ' || name FROM {_SOURCES} WHERE CAST(external_id AS BIGINT) % 3 = 0)) WHERE r = 1"""
)
def catalog_merge(spark, sf_dir):
    rows = sources(spark, sf_dir)
    old = rows.select("provider", F.concat(F.lit("co"), "external_id").alias("external_id"), "name")
    new = rows.where("external_id % 3 = 0").select("provider", F.concat(F.lit("CO"), "external_id").alias("external_id"), F.concat(F.lit("new "), "name").alias("name"))
    return links.merged_catalog(old, new)


@query(
    """SELECT s_suppkey AS n, CAST(page AS INTEGER) AS page, CASE WHEN s_suppkey % 2 = 0 THEN 'https://api.eu.lever.co/v0/postings/' ELSE 'https://api.lever.co/v0/postings/' END
      || s_suppkey || '?mode=json&skip=' || page * 100 || '&limit=100' AS url FROM (SELECT s_suppkey, unnest(range(s_suppkey * 50 // 100 + 1)) AS page FROM supplier)"""
)
def lever_page_requests(spark, sf_dir):
    n = F.col("s_suppkey")
    rows = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(n.alias("key"), n.cast("string").alias("external_id"), F.when(n % 2 == 0, "eu").alias("api_region"), (n * 50).alias("n"))
    return boards.page_requests(rows, ("key",)).select(F.col("key").alias("n"), "page", "url")


@query("SELECT s_suppkey AS n, CAST(page AS INTEGER) AS page FROM (SELECT s_suppkey, unnest(range(5)) AS page FROM supplier) WHERE page <= s_suppkey % 7")
def lever_pages_read(spark, sf_dir):
    """Of five landed pages, those up to the first that isn't full; here full is two, and page n % 7 holds one posting."""
    rows = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").cast("string").alias("slug"), F.explode(F.sequence(F.lit(0), F.lit(4))).alias("page"))
    payload = F.when(F.col("page") == F.col("slug").cast("long") % 7, "[{}]").otherwise("[{},{}]")
    return boards.whole_pages(rows.withColumn("payload", payload), 2).select(F.col("slug").cast("long").alias("n"), "page")


# Board audits over postings whose places are plain, so that what is expected can be said in SQL.


def plain_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titled postings in one of six places, with stored facets that are right, out of date, or empty by turns."""
    n = F.col("external_id").cast("long")
    pick = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), (n % 6 + 1).cast("int"))
    rows = postings(spark, sf_dir)
    stored = F.when(n % 5 == 0, F.array()).when(n % 5 == 1, F.array(F.lit("de"), F.lit("zz"))).otherwise(F.filter(F.array(pick(("germany", "france", None, "united states", None, "spain"))), lambda c: c.isNotNull()))
    return rows.withColumns(
        {
            "title": F.when(n % 13 == 0, "Forward-Deployed Engineer").otherwise(F.lit("Backend Engineer (Python)")),
            "role": F.when(n % 7 == 0, F.lit(None).cast("string")).when(n % 7 == 1, "data").otherwise("backend"),
            "seniorities": F.when(n % 3 == 0, F.array(F.lit("senior"))).otherwise(F.array().cast("array<string>")),
            "stack": F.when(n % 4 == 0, F.array(F.lit("python"))).when(n % 4 == 1, F.array(F.lit("rust"))).otherwise(F.array().cast("array<string>")),
            "location_raw": pick(("Berlin, Germany", "Paris", "Remote", "United States", "Nowhereland", "Madrid, Spain")),
            "location": pick(("Berlin, Germany", "Paris", "Remote", "United States", "Nowhereland", "Madrid, Spain")),
            "location_countries": stored.cast("array<string>"),
            "location_tokens": stored.cast("array<string>"),
            "location_regions": F.array().cast("array<string>"),
            "is_remote": n % 6 == 2,
        }
    )


#: What the audit must find, by hand: the title says backend and Python, or forward deployed (solutions, which has no stack).
_PLAIN = f"""(SELECT *, CASE WHEN n % 13 = 0 THEN 'solutions' ELSE 'backend' END AS now_role,
    CASE WHEN n % 7 = 0 THEN NULL WHEN n % 7 = 1 THEN 'data' ELSE 'backend' END AS then_role,
    CASE WHEN n % 5 = 0 THEN '' WHEN n % 5 = 1 THEN 'germany' ELSE coalesce(['germany', 'france', NULL, 'united states', NULL, 'spain'][n % 6 + 1], '') END AS then_country,
    coalesce(['germany', 'france', NULL, 'united states', NULL, 'spain'][n % 6 + 1], '') AS now_country,
    CASE WHEN n % 4 = 0 THEN 'python' WHEN n % 4 = 1 THEN 'rust' ELSE '' END AS then_stack
  FROM (SELECT *, CAST(external_id AS BIGINT) AS n FROM {POSTINGS_SQL} WHERE provider = '{{provider}}'))"""
_AUDITED = f"""(SELECT id, n, then_role IS DISTINCT FROM now_role AS role_differs, n % 3 = 0 AS seniority_differs,
    CASE WHEN then_stack = now_stack THEN NULL WHEN now_stack = '' THEN 'description_enriched' ELSE 'true_drift' END AS stack_mismatch,
    then_country <> now_country AS facets_differ, n % 5 = 0 AND n % 6 <> 2 AS empty_geography, n % 13 = 0 AS forward_deployed, then_role
  FROM (SELECT *, CASE WHEN n % 13 <> 0 AND coalesce(then_role, now_role) <> 'data' THEN 'python' ELSE '' END AS now_stack FROM {_PLAIN}))"""
for _board in ("greenhouse", "lever"):
    _AUDITED_AT = _AUDITED.replace("{provider}", _board)

    def _flags(spark, sf_dir, board=_board):
        rows = audits.board_audit(plain_jobs(spark, sf_dir), places.gazetteer(spark), board)
        return rows.select("id", "role_differs", "seniority_differs", "stack_mismatch", "facets_differ", "empty_geography", "forward_deployed")

    def _counts(spark, sf_dir, board=_board):
        return audits.board_counts(audits.board_audit(plain_jobs(spark, sf_dir), places.gazetteer(spark), board))

    _flags.__name__, _counts.__name__ = f"board_audit_{_board}", f"board_counts_{_board}"
    query(f"SELECT id, role_differs, seniority_differs, stack_mismatch, facets_differ, empty_geography, forward_deployed FROM {_AUDITED_AT}")(_flags)
    query(
        f"""SELECT count(*) AS scanned, count(*) FILTER (role_differs) AS role, count(*) FILTER (seniority_differs) AS seniority, count(stack_mismatch) AS stack,
          count(*) FILTER (stack_mismatch = 'description_enriched') AS description_enriched, count(*) FILTER (stack_mismatch = 'true_drift') AS true_drift, count(*) FILTER (facets_differ) AS facets,
          count(*) FILTER (empty_geography) AS empty_geography, count(*) FILTER (then_role IS NULL) AS no_role, count(*) AS no_seniority, count(*) FILTER (forward_deployed) AS forward_deployed FROM {_AUDITED_AT}"""
    )(_counts)


@query(
    f"""SELECT kind, id, place FROM (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY company, title, id) AS place FROM (
      SELECT a.id, company, CASE WHEN n % 13 = 0 THEN 'Forward-Deployed Engineer' ELSE 'Backend Engineer (Python)' END AS title,
        unnest(list_filter([CASE WHEN role_differs THEN 'role_differs' END, CASE WHEN seniority_differs THEN 'seniority_differs' END, stack_mismatch,
          CASE WHEN facets_differ THEN 'facets_differ' END, CASE WHEN empty_geography THEN 'empty_geography' END], lambda x: x IS NOT NULL)) AS kind
      FROM {_AUDITED.replace("{provider}", "lever")} a JOIN {POSTINGS_SQL} p USING (id)))
      WHERE place <= CASE kind WHEN 'role_differs' THEN 50 WHEN 'seniority_differs' THEN 30 WHEN 'description_enriched' THEN 20 WHEN 'true_drift' THEN 30 ELSE 40 END"""
)
def board_samples(spark, sf_dir):
    """A top-k report."""
    return audits.samples(audits.board_audit(plain_jobs(spark, sf_dir), places.gazetteer(spark))).select("kind", "id", "place")


@query(f"SELECT id, company FROM {POSTINGS_SQL} WHERE provider = 'lever' ORDER BY company")
def board_scan(spark, sf_dir):
    return audits.board_rows(plain_jobs(spark, sf_dir)).select("id", "company")


@query(f"SELECT id, company FROM {POSTINGS_SQL} WHERE CAST(external_id AS BIGINT) % 6 <> 2")
def audit_scan(spark, sf_dir):
    return audits.scanned(plain_jobs(spark, sf_dir)).select("id", "company")


@query(f"SELECT id FROM {POSTINGS_SQL} WHERE provider = 'ashby' AND CAST(external_id AS BIGINT) % 6 <> 2 ORDER BY id LIMIT 25")
def audit_scan_head(spark, sf_dir):
    """The first rows by id, as an audit's `limit` asks."""
    return audits.scanned(plain_jobs(spark, sf_dir), "ashby", 25).select("id")


@query(f"SELECT id FROM {POSTINGS_SQL} WHERE CAST(external_id AS BIGINT) % 5 <> 1 AND CAST(external_id AS BIGINT) % 6 = 4")
def audit_still_empty(spark, sf_dir):
    """Of the places whose stored facets are empty, one is still unknown today."""
    return audits.still_empty(plain_jobs(spark, sf_dir), places.gazetteer(spark)).select("id")


@query(
    f"""SELECT id, array_to_string(list_sort(list_distinct(list_concat(CASE WHEN n % 5 = 1 THEN ['germany'] ELSE [] END, CASE WHEN now_country <> '' THEN [now_country] ELSE [] END))), ',') AS countries
      FROM {_PLAIN.replace("{provider}", "lever")} WHERE n % 5 < 2"""
)
def facet_backfill(spark, sf_dir):
    """Stored facets that are out of date or empty are made anew, with the country a two-letter hint stands for."""
    rows = plain_jobs(spark, sf_dir).withColumn("location_tokens", F.when(F.col("external_id") % 5 > 1, F.array_sort(F.array_union(_expected_tokens(), F.col("location_countries")))).otherwise(F.col("location_tokens")))
    return ingest.facet_backfill(rows, places.gazetteer(spark)).select("id", shown("new_location_countries").alias("countries"))


def _expected_tokens() -> Column:
    cities = {"Berlin, Germany": "berlin", "Paris": "paris", "Remote": "remote", "Nowhereland": "nowhereland", "Madrid, Spain": "madrid"}
    return F.coalesce(*[F.when(F.col("location_raw") == raw, F.array(F.lit(t))) for raw, t in cities.items()], F.array().cast("array<string>"))


#: Places and the countries and regions they must give, said by hand.
PLACE_CASES: tuple[tuple[str, str, str], ...] = (
    ("Remote U.S. | Remote - Canada", "canada,united states", ""), ("Remote U.S.", "united states", ""), ("Czech Republic | Italy", "czechia,italy", ""), ("CZE - Prague | IND - Pune | IRL - Cork", "czechia,india,ireland", ""),
    ("Bosnia and Herzegovina | Bosnia & Herzegovina", "bosnia & herzegovina", ""), ("EU", "", "european union"), ("LATAM | Latin America", "", "latin america"), ("Central America", "", "central america"),
    ("NAMER", "", "north america"), ("Istanbul | Porto", "portugal,turkey", ""), ("Seattle Metro", "united states", ""), ("Denver TX", "united states", ""), ("Oklahoma", "united states", ""),
    ("Miami Area", "united states", ""), ("San Francisco Bay Area", "united states", ""), ("Washington D.C.", "united states", ""), ("Hamburg, DE", "germany", ""), ("Dover, DE", "united states", ""),
    ("Utrecht, NL", "netherlands", ""), ("Gander, NL", "canada", ""), ("Boston, Georgia", "united states", ""), ("Tbilisi, Georgia", "georgia", ""), ("Calgary & Ottawa", "canada", ""),
    ("United States & Canada (Remote)", "canada,united states", ""), ("Remote - US & Mexico", "mexico,united states", ""), ("Austin TX, Atlanta GA, Salem OR", "united states", ""), ("Pune India", "india", ""),
    ("Oxford UK, Basel CH", "switzerland,united kingdom", ""), ("US West Coast", "", "west coast"), ("Rome | Remote | Utrecht l Remote", "italy,netherlands", ""), ("México", "mexico", ""),
    ("Viet Nam | Vietnam2", "vietnam", ""), ("Remote, Europe (CET +/- 2h)", "", "europe"), ("US Full-time", "united states", ""), ("Canada-based", "canada", ""), ("Poland Team", "poland", ""),
    ("Any Location | Chile | Peru", "chile,peru", ""), ("France & EMEA", "france", "emea"), ("Orange County", "united states", ""), ("Queensland", "australia", ""), ("South Australia", "australia", ""),
    ("Anywhere in Asia and South America", "", "asia,south america"), ("Durban Warehouse", "south africa", ""), ("VIRTUAL UK", "united kingdom", ""), ("Sweden | Nordics | APAC", "sweden", "apac,nordics"),
    ("Oran | Singapoor", "algeria,singapore", ""), ("Congo Brazzaville", "congo - brazzaville", ""), ("Remote - Philipines", "philippines", ""), ("Denver, Colorado | Cayman", "cayman islands,united states", ""),
    ("Fully Remote", "", "worldwide"), ("Global Remote", "", "worldwide"), ("Remote (World)", "", "worldwide"), ("No location", "", ""), ("Talent pool", "", ""), ("Greater Munich Area", "germany", ""),
    ("Spain-Remote, Portugal", "portugal,spain", ""), ("NY-New York", "united states", ""), ("remote-nordics", "", "nordics"), ("Acme Robotics Lyon", "france", ""), ("East London", "", ""), ("Bay of Plenty", "new zealand", ""),
    ("Dar es Salaam", "tanzania", ""), ("Remote (Germany or Europe)", "germany", "europe"), ("Berlin + Paris", "france,germany", ""), ("Milan (Hybrid)", "italy", ""), ("Jakarta", "", ""),
)


def _values(rows: tuple[tuple[str, ...], ...]) -> str:
    return ", ".join("(" + ", ".join("'" + x.replace("'", "''") + "'" for x in r) + ")" for r in rows)


def _said_by_customers(spark: SparkSession, sf_dir: str, cases: tuple[tuple[str, ...], ...], column: str) -> DataFrame:
    """One of the cases for each customer, in turn."""
    case = F.element_at(F.array(*[F.lit(r[0]) for r in cases]), (F.col("c_custkey") % len(cases) + 1).cast("int"))
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", case.alias(column))


def _said_sql(cases: tuple[tuple[str, ...], ...], columns: str) -> str:
    values = ", ".join(f"({k}, {v[1:]}" for k, v in enumerate(_values((r,)) for r in cases))
    return f"SELECT c_custkey, {columns} FROM customer JOIN (VALUES {values}) t(n, {columns}) ON n = c_custkey % {len(cases)}"


@query(_said_sql(PLACE_CASES, "location_raw, countries, regions"))
def place_cases(spark, sf_dir):
    """Places of every kind of spelling, as customers might say them, against what they must give."""
    rows = _said_by_customers(spark, sf_dir, PLACE_CASES, "location_raw")
    found = places.facets(rows, places.gazetteer(spark))
    return rows.join(found, "location_raw").select("c_custkey", "location_raw", shown("countries").alias("countries"), shown("regions").alias("regions"))


#: Titles and the roles they must give, said by hand.
ROLE_CASES: tuple[tuple[str, str], ...] = (
    ("Senior Python Engineer", "engineer"), ("Python Developer", "backend"), ("React Developer", "frontend"), ("React and Go Developer", "fullstack"), ("Full Stack Engineer", "fullstack"), ("iOS Engineer", "mobile"),
    ("Kotlin Developer", "mobile"), ("QA Engineer", "qa"), ("SRE", "devops"), ("Data Platform Engineer", "data"), ("Platform Engineer", "devops"), ("Machine Learning Engineer", "ai"), ("Research Scientist", "ai"),
    ("Growth Data Scientist", "data"), ("Security Engineer", "security"), ("Pentester, Red Team", "security"), ("Solutions Architect", "solutions"), ("Technical Recruiter", "recruiter"), ("UX Designer", "designer"),
    ("Head of Engineering", "management"), ("Product Manager", "management"), ("HR Business Partner", "other"), ("HR Systems Engineer", "engineer"), ("WPF C# Developer", "fullstack"), ("API Developer", "backend"),
    ("UI Engineer", "frontend"), ("Backend/Frontend Engineer", "backend"), ("Accountant", "other"), ("COBOL Programmer", "other"), ("Rust Programmer", "backend"), ("Member of Technical Staff", "engineer"), ("", "other"),
)


@query(_said_sql(ROLE_CASES, "title, role"))
def role_cases(spark, sf_dir):
    """Titles of every role, as customers might say them, against what they must give."""
    return titles.read(_said_by_customers(spark, sf_dir, ROLE_CASES, "title")).select("c_custkey", "title", "role")


@query(
    """SELECT c_custkey, ['germany', 'france', 'norway', 'united states', 'japan'][c_custkey % 5 + 1] AS countries,
      ['germany,munich', 'france,lyon', 'norway,oslo', 'oregon,portland,united states', 'japan,tokyo'][c_custkey % 5 + 1] AS tokens FROM customer"""
)
def employers_before_places(spark, sf_dir):
    """Employers named after a place, glued to the place they are in, in front of it or behind it: only the latter counts."""
    employer = F.concat(F.lit("Boston "), F.col("c_name"), F.lit(" of Paris"))
    place = F.element_at(F.array(*map(F.lit, ("Munich", "Lyon", "Oslo", "Portland", "Tokyo"))), (F.col("c_custkey") % 5 + 1).cast("int"))
    glued = F.when(F.col("c_custkey") % 2 == 0, F.concat_ws(" ", employer, place)).otherwise(F.concat(place, F.lit(", "), F.upper(employer)))
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", employer.alias("company"), glued.alias("location_raw"))
    found = places.facets(rows, places.gazetteer(spark), employers=rows.select("company"))
    return rows.join(found, "location_raw").select("c_custkey", shown("countries").alias("countries"), shown("tokens").alias("tokens"))


_FOREIGN = ("Москва, Россия", "Αθήνα", "თბილისი", "T`bilisi", "Łódź", "Berlin", "서울")


@query(f"SELECT id, ['Moskva, Rossiya', 'Athina', 'Tbilisi', 'Tbilisi', NULL, NULL, 'Seoul'][CAST(external_id AS BIGINT) % 7 + 1] AS new_location FROM {POSTINGS_SQL} WHERE CAST(external_id AS BIGINT) % 7 NOT IN (4, 5)")
def romanized_backfill(spark, sf_dir):
    place = F.element_at(F.array(*map(F.lit, _FOREIGN)), (F.col("external_id") % 7 + 1).cast("int"))
    return ingest.romanized_backfill(postings(spark, sf_dir).select("id", place.alias("location"), F.lit(None).cast("string").alias("location_raw"))).select("id", "new_location")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Postings in, a filtered and ordered feed page out."""
    return feed_preset_filtered(spark, sf_dir)


# Relations that grow by batches, and circuits that hold polls back.


@query(
    f"""SELECT p.id, hash FROM {_HASHED} p JOIN customer c ON c.c_name = p.company
      WHERE CASE WHEN c_custkey % 6 = 0 THEN false WHEN c_custkey % 3 = 0 THEN CAST(external_id AS BIGINT) % 5 <> 0
                 WHEN c_custkey % 3 = 1 THEN CAST(external_id AS BIGINT) % 7 <> 0 ELSE CAST(external_id AS BIGINT) % 4 <> 0 END"""
)
def polled_relation(spark, sf_dir):
    """A relation after three polls, the second of which comes twice; it is compacted in between, and read at the end."""
    source = postings(spark, sf_dir)
    rows = stored_once(spark, "hashed", source, lambda: hashed(spark, sf_dir))
    companies = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("n"), F.col("c_name").alias("company"))
    companies = companies.crossJoin(F.broadcast(spark.createDataFrame([(p,) for p in ingest.PROVIDERS], "provider string")))
    number = F.col("external_id").cast("long")
    jobs = Relation(spark, f"{shared_folder(spark)}/polled-{uuid.uuid4().hex}", rows.schema)
    jobs.commit(0, rows.where(number % 4 != 0), None)
    for version, answering, held in ((1, "n % 3 = 0", number % 5 != 0), (2, "n % 3 = 1", number % 7 != 0), (2, "n % 3 = 1", number % 7 == 0), (3, "n % 6 = 0", F.lit(False))):
        scope = companies.where(answering).select("provider", "company")
        jobs.poll(version, scope, rows.where(held).join(scope, ["provider", "company"], "left_semi").select(*rows.columns))
        if version == 2:
            jobs.compact()
    jobs.expire(1)
    return jobs.read().select("id", "hash")


@query(classified_sql.GATED)
def gated_polls(spark, sf_dir):
    """Every event asks for a fetch of one of 20 providers, whose answer comes up to an hour later; errors are timeouts.

    Fetches that an open circuit holds back have no outcome.
    """
    rows = events(spark, sf_dir).select(
        F.concat(F.lit("p"), (F.col("user_id") % 20).cast("string")).alias("provider"),
        "at_ms",
        F.col("event_id").alias("fetch_id"),
        (F.col("at_ms") + F.col("event_id") % 7 * 600_000).alias("done_ms"),
        F.when(F.col("event_type") == "error", F.lit(gate.TIMEOUTS[0])).alias("code"),
    )
    return gate.gated(rows, state.Breaker(window=6 * 3_600_000, threshold=3, cooldown=12 * 3_600_000)).select("fetch_id", "provider", "sent", "open_until")


@query(classified_sql.FEED)
def feed_by_keyset(spark, sf_dir):
    """The same request as `feed_preset_filtered`, a page of seven after the other, from the feed's own layout."""
    rows = jobs(spark, sf_dir)
    store = FeedStore(spark, f"{shared_folder(spark)}/feed-{uuid.uuid4().hex}")
    store.write(rows)
    request = search.Request.of(role="backend", stack=["python", "java"], seniority="senior", location=["Germany", "fully-remote"], limit=7)
    whole = replace(request, limit=200)
    # The request asks for the 200 newest postings, and pages come newest first: those that hold them are read, and no others.
    pages = [page.select(*rows.columns) for page in islice(store.pages(request), math.ceil(whole.limit / request.limit))]
    found = reduce(DataFrame.union, pages) if pages else rows.limit(0)
    as_of = rows.agg(F.max("posted_at").alias("_as_of"))
    page = search.feed(found.crossJoin(F.broadcast(as_of)), whole, F.col("_as_of"))
    return page.withColumn("location_secondary", shown("location_secondary")).withColumn("stack", shown("stack")).withColumn("seniorities", shown("seniorities"))


@query(
    f"""SELECT id, CASE WHEN seniorities = '' THEN NULL ELSE string_split(seniorities, ',')[1] END AS level_then, coalesce(CASE WHEN seniorities = '' THEN '' ELSE string_split(seniorities, ',')[1] END, '') AS levels_now,
      CAST(NULL AS VARCHAR) AS api_region FROM {_TITLED}"""
)
def schema_versions(spark, sf_dir):
    """Postings written with one level each (version 1), read as version 3, written so, and read back as version 1."""
    levels = F.when(F.size("seniorities") > 0, F.get("seniorities", F.lit(0)))
    then = titled(spark, sf_dir).select("id", "title", levels.alias("seniority"))
    steps, path = versions.posting_migrations(), f"{shared_folder(spark)}/versions-{uuid.uuid4().hex}"
    versions.write_at(then, f"{path}/1", steps, 1)
    versions.rewritten_at(spark, f"{path}/1", f"{path}/3", steps, 3)
    now = versions.read_at(spark, f"{path}/1", steps)
    back = versions.read_at(spark, f"{path}/3", steps, 1)
    return back.select("id", F.col("seniority").alias("level_then")).join(now.select("id", shown("seniorities").alias("levels_now"), "api_region"), "id")


@query(f"SELECT id, {_ISO} AS posted_at FROM {POSTINGS_SQL} ORDER BY posted_at DESC, id LIMIT 20 OFFSET 40")
def feed_third_page(spark, sf_dir):
    """A page by its number: twenty rows behind the first forty."""
    return search.feed(latest(jobs(spark, sf_dir)), search.Request.of(page=3, limit=20), F.col("_as_of")).select("id", "posted_at")


@query(classified_sql.MISMATCH_REASONS)
def audit_mismatch_reasons(spark, sf_dir):
    """Which facets differ, where every fifth posting's tokens are disturbed first."""
    odd = F.col("external_id") % 5 == 0
    rows = jobs(spark, sf_dir).withColumn("location_tokens", F.when(odd, F.array(F.lit("x"))).otherwise(F.col("location_tokens")))
    found = audits.mismatches(rows, places.gazetteer(spark))
    return found.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def _supplied(spark: SparkSession, sf_dir: str, provider: str, job: Column) -> DataFrame:
    """One posting of each supplier's board, extracted from its payload."""
    whole = F.to_json(F.struct(F.array(job).alias("jobs"))) if provider in boards.WRAPPED else F.to_json(F.array(job))
    rows = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").cast("string").alias("slug"), F.col("s_name").alias("company"), whole.alias("payload"))
    return boards.extract(rows, provider, F.lit("2000-01-01").cast("timestamp"))


@query(
    """SELECT CAST(s_suppkey AS VARCHAR) AS external_id, CASE WHEN s_suppkey % 3 = 0 THEN 'Berlin | Paris | Remote, Spain' ELSE 'Berlin' END AS location_raw,
      CASE WHEN s_suppkey % 3 = 0 THEN 'Germany,France,Spain' ELSE 'Germany' END AS hints FROM supplier"""
)
def ashby_other_places(spark, sf_dir):
    """Secondary places and their countries: each once, whatever its case; a bare `Remote` gets its country."""
    n = F.col("s_suppkey")
    at = lambda place, country: F.struct(F.lit(place).alias("location"), F.struct(F.struct(F.lit(country).alias("addressCountry")).alias("postalAddress")).alias("address"))
    others = F.when(n % 3 == 0, F.array(at("Paris", "France"), at("PARIS ", "france"), at("Remote", "Spain"), at(" ", " ")))
    own = at("Berlin", "Germany")
    job = F.struct(n.cast("string").alias("id"), F.lit("Engineer").alias("title"), own["location"].alias("location"), own["address"].alias("address"), others.alias("secondaryLocations"), F.lit("u").alias("jobUrl"))
    return _supplied(spark, sf_dir, "ashby", job).select("external_id", "location_raw", F.array_join("location_hints", ",").alias("hints"))


@query("SELECT CAST(s_suppkey AS VARCHAR) AS external_id, ['junior', 'mid,senior', 'staff', '', 'mid', 'senior'][s_suppkey % 6 + 1] AS levels FROM supplier")
def workable_experience(spark, sf_dir):
    """Levels from the board's own experience labels."""
    n = F.col("s_suppkey")
    label = F.element_at(F.array(*map(F.lit, ("Entry level", "Mid-Senior level", "Director", "Not Applicable", "Associate", "Senior"))), (n % 6 + 1).cast("int"))
    job = F.struct(n.cast("string").alias("id"), F.lit("Engineer").alias("title"), F.lit("u").alias("url"), label.alias("experience"))
    return _supplied(spark, sf_dir, "workable", job).select("external_id", F.array_join(titles.experience_levels(F.col("experience")), ",").alias("levels"))


@query(
    """SELECT CAST(s_suppkey AS VARCHAR) AS external_id, CASE WHEN s_suppkey % 2 = 0 THEN 'Oslo | Bergen' ELSE 'Oslo' END AS location_raw,
      CASE WHEN s_suppkey % 2 = 0 THEN 'We build.' || chr(10) || chr(10) || 'Needs' || chr(10) || 'Go and SQL' ELSE 'We build.' END AS description FROM supplier"""
)
def lever_lists(spark, sf_dir):
    """All places of a posting, each once, and a description put together from its plain parts and its lists."""
    n = F.col("s_suppkey")
    more = n % 2 == 0
    lists = F.when(more, F.array(F.struct(F.lit("Needs").alias("text"), F.lit("<li>Go <b>and</b> SQL</li>").alias("content")), F.struct(F.lit("").alias("text"), F.lit("<p></p>").alias("content"))))
    places_of = F.struct(F.lit("Oslo").alias("location"), F.when(more, F.array(F.lit("oslo"), F.lit("Bergen"), F.lit(" "))).alias("allLocations"))
    job = F.struct(n.cast("string").alias("id"), F.lit("Engineer").alias("text"), F.lit("u").alias("hostedUrl"), places_of.alias("categories"), lists.alias("lists"), F.lit("We build.").alias("descriptionPlain"))
    return _supplied(spark, sf_dir, "lever", job).select("external_id", "location_raw", "description")
