"""Four job boards: the schema of each landed payload, and its extraction into one shape of posting.

Payloads are landed as JSON; live fetching is out of this package's reach. Every field is optional. `extract` gives the
columns that `operators.ingest.classified` reads. `as_of` stands in for missing dates.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vacantia.functions.text import trimmed, without_tags

_ADDRESS = "struct<postalAddress:struct<addressCountry:string,addressRegion:string,addressLocality:string>>"
_WORKABLE_PLACE = "struct<location_str:string,telecommuting:boolean,workplace_type:string,city:string,country:string,country_name:string,region:string,state_code:string>"
SCHEMAS: dict[str, str] = {
    "ashby": f"id string, title string, location string, address {_ADDRESS}, secondaryLocations array<struct<location:string,address:{_ADDRESS}>>, isRemote boolean, workplaceType string, publishedAt string, jobUrl string, applyUrl string, descriptionPlain string, isListed boolean",
    "greenhouse": "id long, title string, location struct<name:string>, metadata array<struct<id:long,name:string,value:string,value_type:string>>, updated_at string, first_published string, absolute_url string, content string",
    "workable": f"id string, title string, shortcode string, url string, shortlink string, experience string, description string, full_description string, location {_WORKABLE_PLACE}, locations array<{_WORKABLE_PLACE}>, created_at string, published_on string, state string",
    "lever": "id string, text string, hostedUrl string, applyUrl string, createdAt long, country string, workplaceType string, categories struct<location:string,allLocations:array<string>,team:string,commitment:string>, descriptionPlain string, openingPlain string, descriptionBodyPlain string, additionalPlain string, lists array<struct<text:string,content:string>>",
}
#: Boards whose payload is an object with a list of jobs; the others are a list.
WRAPPED = ("ashby", "greenhouse", "workable")
POSTING = ["provider", "external_id", "title", "company", "location_raw", "posted_at", "is_flagged_remote", "url", "description", "location_hints", "experience"]
# Phrases by which a description says that work is remote.
REMOTE_PHRASES = ("remote-first", "remote first", "remote work", "work remotely", "fully remote", "full remote", "100% remote", "distributed team", "work from home", "wfh")
# Locations that only say how work is done.
WORK_MODES = ("remote", "hybrid", "onsite", "distributed", "worldwide", "global", "anywhere", "unknown", "tbd", "multiple locations", "multi-location", "various", "flexible")


def _text(c: str | Column) -> Column:
    return trimmed(F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit("")))


def _or(*columns: Column) -> Column:
    """The first that isn't blank; null if none is."""
    return F.coalesce(*[F.when(_text(c) != "", _text(c)) for c in columns])


def _date(c: str) -> Column:
    return F.try_to_timestamp(F.col(c))


def once(values: Column) -> Column:
    """Values that aren't blank, each once whatever its case, in order."""
    kept = F.filter(F.transform(values, lambda v: trimmed(F.coalesce(v, F.lit("")))), lambda v: v != "")
    return F.filter(kept, lambda v, i: F.array_position(F.transform(kept, F.lower), F.lower(v)) == i + 1)


def _joined(parts: Column, between: str) -> Column:
    return F.when(F.size(parts) > 0, F.array_join(parts, between)).otherwise(F.lit("Unknown"))


def _strings(*columns: Column) -> Column:
    return F.array(*columns).cast("array<string>")


def ashby(jobs: DataFrame, as_of: Column) -> DataFrame:
    country = lambda c: F.when(F.lower(F.regexp_replace(_text(c), r"\s+", " ")) != "european union", _or(c))
    generic = lambda place, c: F.when(place.rlike(r"(?i)^(remote|anywhere|distributed|hybrid|on[-\s]?site|onsite)$") & c.isNotNull() & ~F.lower(place).contains(F.lower(c)), F.concat_ws(", ", place, c)).otherwise(place)
    own = country(F.col("address.postalAddress.addressCountry"))
    primary = F.coalesce(generic(_or(F.col("location")), own), F.lit("Unknown"))
    more = F.coalesce("secondaryLocations", F.array().cast(f"array<struct<location:string,address:{_ADDRESS}>>"))
    others = once(F.transform(more, lambda x: generic(_or(x["location"]), country(x["address"]["postalAddress"]["addressCountry"]))))
    hints = once(F.concat(_strings(own), F.transform(more, lambda x: country(x["address"]["postalAddress"]["addressCountry"]))))
    place = F.array_join(F.concat(F.array(primary), others), " | ")
    flagged = F.coalesce("isRemote", F.lit(False)) | (F.lower(F.coalesce("workplaceType", F.lit(""))) == "remote")
    listed = jobs.where(F.coalesce("isListed", F.lit(True)) & (F.coalesce("title", F.lit("")) != ""))
    return listed.select(
        F.coalesce(F.nullif("id", F.lit("")), F.concat_ws(":", "slug", _text("title"), "publishedAt")).alias("external_id"), _text("title").alias("title"), "company", place.alias("location_raw"),
        F.coalesce(_date("publishedAt"), as_of).alias("posted_at"), flagged.alias("is_flagged_remote"), F.coalesce(F.nullif("jobUrl", F.lit("")), "applyUrl", F.lit("")).alias("url"),
        F.col("descriptionPlain").alias("description"), hints.alias("location_hints"), F.lit(None).cast("string").alias("experience"),
    )


def greenhouse(jobs: DataFrame, as_of: Column) -> DataFrame:
    primary = _text(F.col("location.name"))
    item = F.get(F.filter(F.coalesce("metadata", F.array().cast("array<struct<id:long,name:string,value:string,value_type:string>>")), lambda m: F.trim(m["name"]) == "Job Posting Location"), F.lit(0))["value"]
    listed = F.array_join(F.filter(F.transform(F.from_json(item, "array<string>"), lambda x: F.trim(x)), lambda v: v != ""), ", ")
    stated = _or(F.when(item.startswith("["), listed).otherwise(item))
    pieces = F.filter(F.transform(F.split(primary, r"(?i)\s*[;|/]\s*|\s+-\s+|\s+or\s+|\s+and\s+"), lambda x: F.trim(x)), lambda s: s != "")
    mode = lambda s: F.lower(s).isin(*WORK_MODES) | s.rlike(r"(?i)^(in[\s-]?office|on[\s-]?site)$")
    no_place = (primary == "") | (~primary.contains(",") & F.forall(pieces, mode))
    place = F.when(stated.isNotNull() & no_place, stated).otherwise(_or(primary))
    low = F.concat_ws(" ", F.lower(primary), F.lower(F.coalesce(place, F.lit(""))))
    flagged = low.contains("remote") | low.contains("anywhere")
    whole = jobs.where(F.coalesce("id", F.lit(0)) != 0).where((F.coalesce("title", F.lit("")) != "") & (F.coalesce("absolute_url", F.lit("")) != ""))
    return whole.select(
        F.col("id").cast("string").alias("external_id"), _text("title").alias("title"), "company", F.coalesce(place, F.lit("Unknown")).alias("location_raw"),
        F.coalesce(_date("updated_at"), _date("first_published"), as_of).alias("posted_at"), flagged.alias("is_flagged_remote"), F.col("absolute_url").alias("url"),
        F.col("content").alias("description"), F.array().cast("array<string>").alias("location_hints"), F.lit(None).cast("string").alias("experience"),
    )


def workable(jobs: DataFrame, as_of: Column) -> DataFrame:
    entries = F.coalesce("locations", F.array().cast(f"array<{_WORKABLE_PLACE}>"))
    remote = lambda x: F.coalesce(x["telecommuting"], F.lit(False)) | (F.lower(F.coalesce(x["workplace_type"], F.lit(""))) == "remote")

    def written(x: Column) -> Column:
        city, state, country = _or(x["city"]), _or(x["state_code"], x["region"]), _or(x["country_name"], x["country"])
        return F.when(city.isNotNull() & country.isNotNull(), F.concat_ws(", ", city, state, country)).otherwise(F.coalesce(country, city, F.lit("")))

    place = F.coalesce(_or(F.col("location.location_str")), _joined(F.filter(F.transform(entries, written), lambda s: s != ""), " / "))
    text = F.concat_ws(" ", F.coalesce("description", F.lit("")), F.coalesce("full_description", F.lit("")))
    low = F.lower(F.regexp_replace(text, "<[^>]*>", " "))
    said = F.exists(F.array(*map(F.lit, REMOTE_PHRASES)), lambda p: F.contains(low, p))
    flagged = remote(F.col("location")) | F.exists(entries, remote) | said
    published = (_text("published_on") != "") | F.coalesce(F.col("state").isin("", "published"), F.lit(True))
    url = F.coalesce(F.nullif("url", F.lit("")), F.nullif("shortlink", F.lit("")))
    return jobs.where((F.coalesce("title", F.lit("")) != "") & url.isNotNull() & published).select(
        F.coalesce(F.nullif("id", F.lit("")), "shortcode").alias("external_id"), _text("title").alias("title"), "company", place.alias("location_raw"),
        F.coalesce(_date("created_at"), _date("published_on"), as_of).alias("posted_at"), F.coalesce(flagged, F.lit(False)).alias("is_flagged_remote"), url.alias("url"),
        text.alias("description"), F.array().cast("array<string>").alias("location_hints"), "experience",
    )


def lever(jobs: DataFrame, as_of: Column) -> DataFrame:
    primary = _or(F.col("categories.location"))
    all_places = F.coalesce("categories.allLocations", F.array().cast("array<string>"))
    place = _joined(once(F.concat(_strings(primary), all_places)), " | ")
    lists = F.coalesce("lists", F.array().cast("array<struct<text:string,content:string>>"))
    told = F.transform(lists, lambda x: F.concat_ws("\n", _or(x["text"]), _or(without_tags(x["content"]))))
    fields = _strings(*[_or(F.col(c)) for c in ("descriptionPlain", "openingPlain", "descriptionBodyPlain", "additionalPlain")])
    description = F.array_join(F.filter(F.concat(fields, told), lambda s: F.coalesce(s, F.lit("")) != ""), "\n\n")
    url = F.trim(F.coalesce(F.nullif("hostedUrl", F.lit("")), "applyUrl", F.lit("")))
    return jobs.where(_text("text") != "").select(
        F.coalesce(F.nullif("id", F.lit("")), F.concat_ws(":", "slug", _text("text"), F.col("createdAt").cast("string"))).alias("external_id"), _text("text").alias("title"), "company", place.alias("location_raw"),
        F.coalesce(F.timestamp_millis("createdAt"), as_of).alias("posted_at"), (F.lower(_text("workplaceType")) == "remote").alias("is_flagged_remote"), url.alias("url"),
        description.alias("description"), once(_strings(F.col("country"))).alias("location_hints"), F.lit(None).cast("string").alias("experience"),
    )


#: The one extension point: a board's name, its schema above, and how its rows become postings.
EXTRACTORS: dict[str, Callable[[DataFrame, Column], DataFrame]] = {"ashby": ashby, "greenhouse": greenhouse, "workable": workable, "lever": lever}


def parse(landed: DataFrame, provider: str) -> DataFrame:
    """Landed payloads (slug, company, payload: a whole response as JSON) as a row for each job; broken JSON gives none."""
    job = ",".join(f"{n}:{t}" for n, t in (f.strip().split(" ", 1) for f in _fields(SCHEMAS[provider])))
    kind = f"struct<jobs:array<struct<{job}>>>" if provider in WRAPPED else f"array<struct<{job}>>"
    jobs = F.from_json("payload", kind)
    return landed.select("slug", "company", F.explode(jobs["jobs"] if provider in WRAPPED else jobs).alias("j")).select("slug", "company", "j.*")


def _fields(schema: str) -> list[str]:
    """The schema's fields, cut at commas outside of brackets."""
    out, depth = [""], 0
    for c in schema:
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append("")
        else:
            out[-1] += c
    return out


def extract(landed: DataFrame, provider: str, as_of: Column) -> DataFrame:
    """Postings of landed payloads; those without a URL are dropped."""
    rows = EXTRACTORS[provider](parse(landed, provider), as_of)
    return rows.where(F.col("url") != "").withColumn("provider", F.lit(provider)).select(*POSTING)


#: Lever gives so many postings a page.
PAGE_ROWS = 100


#: Requests are made in runs of so many pages of a site at most. A power of ten, as PAGE_ROWS is: of a run's offsets only the
#: last digits differ, and those are the same in all runs but a site's first, which has no leading zeros.
RUN_PAGES = 1000
#: Sites are dealt to so many tasks a core, large ones in spans of whole runs: so many spans a task, whatever their size.
REQUEST_TASKS = 8
TASK_SPANS = 16


def page_requests(sites: DataFrame, kept: tuple[str, ...] = ("external_id",)) -> DataFrame:
    """The requests that read sites (external_id, api_region, n postings): a page at a time, until one isn't full.

    A full last page is followed by one more request, which finds nothing; each request has its site's `kept` columns. There
    are as many requests as pages, so nothing that grows with pages is moved: sites are counted, then dealt in spans whose
    length follows the number of all pages, at most a span for each site and TASK_SPANS for each task. Large sites share no
    task by chance. Runs and pages are made where a span lands; what a run's requests have in common is made once.
    """
    last = (F.col("n") / PAGE_ROWS).cast("long")
    stem = F.concat(api_host(F.col("api_region")), F.lit("/"), F.url_encode("external_id"), F.lit("?mode=json&skip="))
    held = sites.select(*kept, stem.alias("_stem"), last.alias("_last")).where("_last >= 0")
    tasks = REQUEST_TASKS * sites.sparkSession.sparkContext.defaultParallelism
    share = held.agg(F.sum(F.col("_last") + 1)).scalar() / (tasks * TASK_SPANS)
    spans = held.withColumn("_span", F.greatest(F.ceil(share / RUN_PAGES), F.lit(1).cast("long")) * RUN_PAGES)
    spans = spans.withColumn("_from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_last"), F.col("_span"))))
    spans = spans.select(*kept, "_stem", "_from", F.least("_last", F.col("_from") + F.col("_span") - 1).alias("_to")).repartition(tasks)

    runs = spans.select(*kept, "_stem", "_to", F.explode(F.sequence("_from", "_to", F.lit(RUN_PAGES).cast("long"))).alias("_from"))
    first, pages = F.col("_from") == 0, F.least(F.col("_to") - F.col("_from") + 1, F.lit(RUN_PAGES)).cast("int")
    lead = F.when(first, F.col("_stem")).otherwise(F.concat("_stem", (F.col("_from") / RUN_PAGES).cast("long").cast("string")))
    width = len(str(RUN_PAGES * PAGE_ROWS)) - 1
    ends = [F.lit([f"{page * PAGE_ROWS:0{digits}d}&limit={PAGE_ROWS}" for page in range(RUN_PAGES)]) for digits in (1, width)]
    runs = runs.select(*kept, "_from", lead.alias("_lead"), F.slice(F.when(first, ends[0]).otherwise(ends[1]), 1, pages).alias("_ends"))
    rows = runs.select(*kept, "_from", "_lead", F.posexplode("_ends").alias("_at", "_end"))
    return rows.select(*kept, (F.col("_from") + F.col("_at")).cast("int").alias("page"), F.concat("_lead", "_end").alias("url"))


def whole_pages(landed: DataFrame, full: int = PAGE_ROWS) -> DataFrame:
    """Landed pages (slug, company, page from 0, payload) up to the first that isn't full: what reading page by page would give."""
    size = F.coalesce(F.json_array_length("payload"), F.lit(0))
    short = F.min(F.when(size < full, F.col("page"))).over(Window.partitionBy("slug"))
    return landed.withColumn("_short", short).where(F.col("_short").isNull() | (F.col("page") <= F.col("_short"))).drop("_short")


def read_landed(spark: SparkSession, path: str) -> DataFrame:
    """Landed files: JSON lines of slug, company and payload."""
    return spark.read.schema("slug string, company string, payload string").json(path)


def api_host(region: Column) -> Column:
    """The host of a board that serves Europe apart."""
    return F.when(F.lower(F.trim(region)) == "eu", F.lit("https://api.eu.lever.co/v0/postings")).otherwise(F.lit("https://api.lever.co/v0/postings"))


def probe_result(status: Column, failed: Column) -> Column:
    """What a probe of a source's page says: `invalid` for 404, `error` for no answer, `ok` below 400, else `warn`."""
    return F.when(failed, "error").when(status == 404, "invalid").when(status < 400, "ok").otherwise("warn")
