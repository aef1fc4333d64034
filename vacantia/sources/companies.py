"""Companies behind links: which board a link leads to, what the company is called, and whether its board seeks engineers."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vacantia.functions.titles import software_intent
from vacantia.sources.boards import probe_result
from vacantia.sources.links import board_of, merged_catalog

# Link texts that are no company's name.
GENERIC_NAMES = (
    "apply", "apply now", "careers", "career", "jobs", "open jobs", "open roles", "view jobs", "view roles", "see jobs", "see roles", "greenhouse", "ashby", "workable", "click here", "here",
    "website", "link",
)
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6", "strong", "span"}
_CELLS = {"td", "li", "tr"}


def _tidy(text: str | None) -> str:
    return re.sub(r"\s+", " ", text or "").strip()


def _named(text: str | None) -> str | None:
    text = _tidy(text)
    return text if text and text.lower() not in GENERIC_NAMES else None


class _Node:
    """An element: its tag, attributes, parent, and what it holds in document order (elements and texts)."""

    def __init__(self, tag: str, attrs: dict[str, str], parent: _Node | None):
        self.tag, self.attrs, self.parent, self.held = tag, attrs, parent, []

    def below(self) -> Iterator[_Node]:
        for x in self.held:
            if isinstance(x, _Node):
                yield x
                yield from x.below()

    def text(self, without: str | None = None) -> str:
        return "".join(x if isinstance(x, str) else "" if x.tag == without else x.text(without) for x in self.held)


class _Tree(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = _Node("", {}, None)
        self.anchors: list[_Node] = []

    def handle_starttag(self, tag, attrs):
        node = _Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.held.append(node)
        if tag == "a" and "href" in node.attrs:
            self.anchors.append(node)
        if tag not in _VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        self.handle_endtag(tag)

    def handle_endtag(self, tag):
        node = self.at
        while node.parent is not None and node.tag != tag:
            node = node.parent
        if node.parent is not None:
            self.at = node.parent

    def handle_data(self, data):
        self.at.held.append(data)


def _picture(node: _Node) -> str | None:
    return next((_named(x.attrs["alt"]) for x in node.below() if x.tag == "img" and "alt" in x.attrs), None)


def name_at(anchor: _Node) -> str | None:
    """A company's name as a page gives it with a link: by a picture, a label, the link's text, or what surrounds it."""
    label = anchor.attrs.get("aria-label", anchor.attrs.get("title"))
    if own := _picture(anchor) or _named(label) or _named(anchor.text()):
        return own
    around = anchor
    while around is not None and not (around.tag in _CELLS or "company" in around.attrs.get("class", "")):
        around = around.parent
    if around is None:
        return None

    def titled(x: _Node) -> bool:
        classes = x.attrs.get("class", "")
        return x.tag in _HEADINGS or "company-name" in classes or not {"name", "title"}.isdisjoint(classes.split())

    inside = (_named(x.text()) for x in around.below() if titled(x))
    return _picture(around) or next(filter(None, inside), None) or _named(around.text(without="a"))


def anchor_names(pages: DataFrame) -> DataFrame:
    """page_id, position (from 1), href and name of each link of a page; one page is one task's row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for page, html in zip(batch["page_id"], batch["html"], strict=True):
                tree = _Tree()
                tree.feed(html or "")
                tree.close()
                rows += [(page, k, re.sub(",+$", "", a.attrs["href"].strip()), name_at(a)) for k, a in enumerate(tree.anchors, 1)]
            yield pd.DataFrame(rows, columns=["page_id", "position", "href", "name"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "html").mapInPandas(run, "page_id long, position long, href string, name string")


def page_companies(pages: DataFrame) -> DataFrame:
    """provider, external_id and name of the boards that pages link to; the first link to a board names it."""
    rows = anchor_names(pages).withColumn("board", board_of(F.col("href"))).where("board IS NOT NULL")
    first = F.min_by("name", F.struct("page_id", "position"))
    return rows.groupBy("board.provider", F.col("board.slug").alias("external_id")).agg(first.alias("name"))


def encoded(text: Column) -> Column:
    """A path segment as browsers encode it."""
    out = F.replace(F.url_encode(text), F.lit("+"), F.lit("%20"))
    for sign in "!'()~":
        out = F.replace(out, F.lit(f"%{ord(sign):02X}"), F.lit(sign))
    return out


# Where boards publish their postings.
API_URLS = {
    "greenhouse": ("https://boards-api.greenhouse.io/v1/boards/", "/jobs?content=true"),
    "ashby": ("https://api.ashbyhq.com/posting-api/job-board/", ""),
    "workable": ("https://www.workable.com/api/accounts/", "?details=true"),
}


def api_url(provider: Column, external_id: Column, region: Column) -> Column:
    """Where a source's postings are found; null for an unknown provider."""
    slug = encoded(external_id)
    lever = F.when(F.lower(F.trim(region)) == "eu", "https://api.eu.lever.co/v0/postings/").otherwise("https://api.lever.co/v0/postings/")
    url = F.when(provider == "lever", F.concat(lever, slug, F.lit("?mode=json&limit=1")))
    for name, (before, after) in API_URLS.items():
        url = url.when(provider == name, F.concat(F.lit(before), slug, F.lit(after)))
    return url


def fields_named(payloads: DataFrame, keys: dict[str, tuple[str, ...]] | tuple[str, ...], payload: str = "payload") -> DataFrame:
    """`payloads` with all strings under some keys (whatever their case) at any depth of a JSON text, in the text's order.

    `keys` has the keys of each new column; a tuple alone is for one named `values`. A text is parsed once for all of them.
    Broken or null JSON has none. (VARIANT columns sort an object's keys, so the order would be lost in them.)
    """
    wanted = keys if isinstance(keys, dict) else {"values": keys}
    columns = {key: tuple(c for c, own in wanted.items() if key in own) for own in wanted.values() for key in own}

    def walk(value: object, out: dict[str, list[str]]) -> None:
        for item in value if isinstance(value, list) else ():
            walk(item, out)
        for k, v in value.items() if isinstance(value, dict) else ():
            if isinstance(v, str):
                for column in columns.get(k.lower(), ()):
                    out[column].append(v)
            walk(v, out)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = []
            for text in batch[payload]:
                out: dict[str, list[str]] = {c: [] for c in wanted}
                try:
                    walk(json.loads(text or "null"), out)
                except ValueError:
                    out = {c: [] for c in wanted}
                found.append(out)
            yield batch.assign(**{c: [f[c] for f in found] for c in wanted})

    schema = payloads.withColumns({c: F.array().cast("array<string>") for c in wanted}).schema
    return payloads.mapInPandas(run, schema)


def display_name(provider: Column, payload: Column, company_names: Column) -> Column:
    """What a board's payload calls its company: Greenhouse's own field or the first one inside, Workable's name, else null."""
    clean = lambda c: F.when(F.trim(c) != "", F.trim(c))
    inside = F.get(F.filter(F.transform(company_names, lambda x: F.trim(x)), lambda x: x != ""), F.lit(0))
    greenhouse = F.coalesce(clean(F.get_json_object(payload, "$.company_name")), inside)
    return F.when(provider == "greenhouse", greenhouse).when(provider == "workable", clean(F.get_json_object(payload, "$.name")))


def verified(entries: DataFrame, payloads: DataFrame) -> DataFrame:
    """Entries whose board seeks software engineers, with the board's own name where it has one.

    `payloads` (provider, external_id, payload) is what has been fetched already: entries without one are left out.
    Adds titles (those that match, sorted) and n_scanned (distinct titles).
    """
    met = entries.join(payloads, ["provider", "external_id"])
    met = fields_named(met, {"_titles": ("title",), "_names": ("company_name",)})
    every = F.array_distinct(F.filter(F.transform("_titles", lambda t: F.trim(t)), lambda t: t != ""))
    rows = met.withColumn("_every", every).withColumn("titles", F.array_sort(F.filter("_every", software_intent)))
    name = F.coalesce(display_name(F.col("provider"), F.col("payload"), F.col("_names")), F.col("name"))
    return rows.where(F.size("titles") > 0).select("provider", "external_id", name.alias("name"), "titles", F.size("_every").cast("long").alias("n_scanned"))


def read_catalog(spark: SparkSession, path: str, providers: tuple[str, ...] = ("greenhouse", "ashby", "workable", "lever")) -> DataFrame:
    """Entries of catalog files, each a JSON array or JSON lines; entries without a known provider or a string id are left out."""
    rows = spark.read.schema("provider string, externalId string, name string, apiRegion string, _bad string").option("columnNameOfCorruptRecord", "_bad").option("multiLine", True).json(path)
    return valid_entries(rows.where("_bad IS NULL").select("provider", F.col("externalId").alias("external_id"), "name", F.col("apiRegion").alias("api_region")), providers)


def valid_entries(rows: DataFrame, providers: tuple[str, ...] = ("greenhouse", "ashby", "workable")) -> DataFrame:
    return rows.where(F.col("provider").isin(*providers) & F.col("external_id").isNotNull())


def write_catalog(existing: DataFrame, incoming: DataFrame, path: str) -> None:
    """Write the merged catalog as JSON lines, sorted over its files. `path` must not be what `existing` is read from."""
    merged_catalog(existing, incoming).write.mode("overwrite").option("ignoreNullFields", False).json(path)


def by_provider(entries: DataFrame) -> DataFrame:
    return entries.groupBy("provider").agg(F.count(F.lit(1)).alias("n"))


def probed(sources: DataFrame, statuses: DataFrame) -> DataFrame:
    """Each source with its URL and what the probe of it says; `statuses` (provider, external_id, status, failed) is landed."""
    rows = sources.join(statuses, ["provider", "external_id"], "left").withColumn("url", api_url(F.col("provider"), F.col("external_id"), F.col("api_region")))
    failed = F.coalesce("failed", F.lit(False)) | F.col("status").isNull()
    return rows.select("provider", "external_id", "name", "url", probe_result(F.col("status"), failed).alias("result"))


