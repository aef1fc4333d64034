"""Links of HTML pages, and the job boards they lead to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HREF = r"""(?is)<a\b[^>]*?\bhref\s*=\s*["']([^"']*)["']"""


def links(pages: DataFrame) -> DataFrame:
    """page_id, position from 1 and href of every anchor, in document order; null pages have none."""
    found = F.regexp_extract_all(F.coalesce("html", F.lit("")), F.lit(HREF), F.lit(1))
    return pages.select("page_id", F.posexplode(found).alias("position", "href")).select("page_id", (F.col("position") + 1).cast("long").alias("position"), F.regexp_replace(F.trim("href"), ",+$", "").alias("href"))


def first_links(pages: DataFrame) -> DataFrame:
    """The first place of each href on a page."""
    rank = F.row_number().over(Window.partitionBy("page_id", "href").orderBy("position"))
    return links(pages).withColumn("_n", rank).where("_n = 1").drop("_n")


def host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]*)", 1))


def board_of(href: Column) -> Column:
    """A struct of provider and slug that a link leads to; null for others. Ashby's slugs are URL-decoded where they can be."""
    name = host(href)
    segment = F.regexp_extract(href, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*/+([^/?#]+)", 1)
    first = F.lower(segment)
    # A plus sign is no space in a path.
    plain = F.lower(F.trim(F.coalesce(F.try_url_decode(F.replace(segment, F.lit("+"), F.lit("%2B"))), segment)))
    sub = F.regexp_extract(name, r"^(.+)\.workable\.com$", 1)
    of = lambda provider, slug: F.struct(F.lit(provider).alias("provider"), slug.alias("slug"))
    return (
        F.when(name.isin("boards.greenhouse.io", "job-boards.greenhouse.io") & ~first.isin("", "embed"), of("greenhouse", first))
        .when(name.isin("jobs.ashbyhq.com", "www.ashbyhq.com", "ashbyhq.com") & (first != ""), of("ashby", plain))
        .when((name == "apply.workable.com") & (first != ""), of("workable", first))
        .when(~sub.isin("", "apply", "www"), of("workable", sub))
    )


def merged_catalog(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """Catalog entries of both, the later of a (provider, external id) winning whatever its case, by provider and id."""
    rows = existing.withColumn("_run", F.lit(0)).unionByName(incoming.withColumn("_run", F.lit(1)))
    key = ["provider", F.lower("external_id")]
    last = rows.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("_run"), "external_id"))).where("_n = 1")
    order = F.array_position(F.array(*[F.lit(p) for p in ("ashby", "greenhouse", "workable", "lever")]), F.col("provider"))
    return last.drop("_run", "_n").orderBy(order, "external_id")
