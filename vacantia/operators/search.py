"""Searching stored postings: a request becomes one predicate, then a count and an ordered page.

All filters are columns and run before paging; a page is a TakeOrderedAndProject.
"""

from __future__ import annotations

import math
from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vacantia.functions import places, titles
from vacantia.functions.text import has
from vacantia.operators.ingest import iso_millis

DAY_MS = 86_400_000
PREVIEW_ROWS = 5


def as_strings(value: object) -> tuple[str, ...] | None:
    """A request's value or values as strings; blank or none of them is None."""
    values = value if isinstance(value, (list, tuple, set)) else [value]
    texts = [str(v).lower() if isinstance(v, bool) else str(v) for v in values if isinstance(v, (str, int, float, bool))]
    kept = tuple(t.strip() for t in texts if t.strip())
    return kept or None


@dataclass(frozen=True)
class Request:
    """A checked feed request."""

    role: str | None = None
    stack: tuple[str, ...] = ()
    seniority: str | None = None
    locations: tuple[str, ...] = ()
    page: int = 1
    limit: int = 50

    def __post_init__(self) -> None:
        if self.role is not None:
            if self.role not in titles.ROLE_KEYWORDS:
                raise ValueError(f"no such role: {self.role}")
            if self.role not in titles.STACKLESS_ROLES and not self.stack:
                raise ValueError("this role needs a stack")
            if not self.seniority or not self.locations:
                raise ValueError("a role needs a seniority and locations")
        if self.seniority is not None and self.seniority not in titles.SENIORITIES:
            raise ValueError(f"no such seniority: {self.seniority}")
        unknown = set(self.stack) - (set(titles.STACKS) - {"c", "objc"})
        if unknown:
            raise ValueError(f"no such stack: {sorted(unknown)}")

    @classmethod
    def of(cls, **given: object) -> Request:
        """From raw request values; unknown names are rejected, pages and limits clamped."""
        extra = set(given) - {"role", "stack", "seniority", "location", "page", "limit"}
        if extra:
            raise ValueError(f"unknown parameters: {sorted(extra)}")
        page, limit = int(given.get("page") or 1), int(given.get("limit") or 50)
        return cls(given.get("role"), as_strings(given.get("stack")) or (), given.get("seniority"), as_strings(given.get("location")) or (), max(1, page), min(200, max(1, limit)))


def role_matches(role: str) -> Column:
    """Stored under the role, or stored under none with a title that holds one of its keywords."""
    keywords = reduce(lambda a, b: a | b, [titles.title_keyword(F.col("title"), k) for k in titles.ROLE_KEYWORDS[role]])
    return (F.col("role") == role) | (F.col("role").isNull() & keywords)


def geographic(title: str = "title") -> Column:
    """Whether a posting is tied to a place, by its facets, its raw location or its title."""
    raw = F.coalesce("location_raw", "location")
    tied = lambda t: (F.size(places.remote_countries(t)) > 0) | places.tied_to_region(t)
    return (F.size("location_countries") > 0) | (F.size("location_regions") > 0) | tied(F.col(title)) | tied(raw) | (F.size(places.country_mentions(F.col(title))) > 0)


def fully_remote() -> Column:
    raw = F.lower(F.coalesce("location_raw", "location"))
    return F.coalesce(F.col("is_remote") & (F.lower(F.trim("location")) == "remote") & ~geographic() & ~has(raw, r"\bhybrid\b"), F.lit(False))


def in_countries(countries: Iterable[str]) -> Column:
    """Stored facets, title mentions (only without a stored country) or the location's text name one of the countries."""
    raw, location = F.lower(F.coalesce("location_raw", "location")), F.lower("location")
    low = lambda c: F.transform(F.col(c), F.lower)
    from_title = F.when(F.size("location_countries") == 0, places.country_mentions(F.col("title"))).otherwise(F.array().cast("array<string>"))
    known = F.array_union(F.array_union(low("location_countries"), from_title), F.array_union(low("location_tokens"), low("location_regions")))
    tests = []
    for c in countries:
        test = F.array_contains(known, c) | location.contains(c) | raw.contains(c)
        tests.append(test | has(raw, places.SHORT_NAMES[c]) if c in places.SHORT_NAMES else test)
    return F.coalesce(reduce(lambda a, b: a | b, tests), F.lit(False))


def location_matches(selected: Iterable[str]) -> Column:
    chosen = [t for t in map(places.country_token, selected) if t]
    countries = [t for t in chosen if t not in ("remote", "fully-remote")]
    if not chosen:
        return F.lit(True)
    if countries:
        return in_countries(countries) | fully_remote() if "fully-remote" in chosen else in_countries(countries)
    return F.col("is_remote") if "remote" in chosen else fully_remote()


def matches(request: Request) -> Column:
    """The whole request as one predicate."""
    if request.role is None:
        return F.lit(True)
    tests = [role_matches(request.role), location_matches(request.locations)]
    if request.seniority:
        tests.append((F.size("seniorities") == 0) | F.array_contains("seniorities", request.seniority))
    if request.stack and request.role not in titles.STACKLESS_ROLES:
        tests.append(F.arrays_overlap("stack", F.array(*map(F.lit, request.stack))))
    return reduce(lambda a, b: a & b, tests)


def _shown(as_of: Column) -> list[Column]:
    parts = places.display_parts(F.col("location_raw"), F.col("location"), F.col("provider"))
    fresh = F.unix_millis(as_of) - F.unix_millis("posted_at") <= DAY_MS
    return [F.col("id"), F.col("title"), F.col("company"), F.col("location"), parts["primary"].alias("location_primary"), parts["others"].alias("location_secondary"), F.col("is_remote"), iso_millis(F.col("posted_at")).alias("posted_at"), fresh.alias("is_new")]


def feed(jobs: DataFrame, request: Request, as_of: Column) -> DataFrame:
    """One page of matching postings, newest first, ties by id."""
    hits = jobs.where(matches(request)).orderBy(F.desc("posted_at"), "id")
    return hits.offset((request.page - 1) * request.limit).limit(request.limit).select(*_shown(as_of), "url", "stack", "seniorities")


def totals(jobs: DataFrame, request: Request) -> DataFrame:
    """page, limit, total and total_pages of a request: one row."""
    rows = jobs.where(matches(request)).agg(F.count(F.lit(1)).alias("total"))
    pages = F.greatest(F.lit(1), F.ceil(F.col("total") / request.limit)).cast("long")
    return rows.select(F.lit(request.page).alias("page"), F.lit(request.limit).alias("page_size"), "total", pages.alias("total_pages"))


def total_pages(total: int, limit: int) -> int:
    return max(1, math.ceil(total / limit))


def preview_country(value: str | None) -> str | None:
    """A requested country as stored: two letters are an ISO code, anything else a name."""
    raw = (value or "").strip()
    if not raw:
        return None
    if len(raw) == 2 and raw.isascii() and raw.isalpha():
        return places.ISO2.get(raw.lower()) or places.OTHER_ISO2.get(raw.lower())
    return places.country_token(raw)


def preview(jobs: DataFrame, country: str | None, as_of: Column, rows: int = PREVIEW_ROWS) -> DataFrame:
    """The newest classified postings, those of the country before remote ones."""
    hits = jobs.where(F.length(F.trim("role")) > 0)
    name = preview_country(country)
    if name is None:
        return hits.orderBy(F.desc("posted_at"), "id").limit(rows).select(*_shown(as_of))
    like = f"%{name}%"
    inside = F.array_contains("location_countries", name) | F.lower(F.coalesce("location_raw", F.lit(""))).like(like) | F.lower("location").like(like)
    rank = F.when(inside, 0).when(F.col("is_remote"), 1).otherwise(2)
    return hits.where(inside | F.col("is_remote")).orderBy(rank, F.desc("posted_at"), "id").limit(rows).select(*_shown(as_of))
