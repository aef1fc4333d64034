from pyspark.sql import functions as F

from vacantia.functions import places
from vacantia.operators.search import preview_country

FACETS = {
    "Berlin, DE": ({"germany"}, set()), "Wilmington, DE": ({"united states"}, set()), "Amsterdam, NL": ({"netherlands"}, set()), "St. John's, NL": ({"canada"}, set()),
    "Tbilisi, Georgia": ({"georgia"}, set()), "Atlanta, Georgia": ({"united states"}, set()), "Georgia, United States": ({"united states"}, set()), "London UK": ({"united kingdom"}, set()),
    "Remote - EMEA": (set(), {"emea"}), "Remote (U.S. or Europe)": ({"united states"}, {"europe"}), "SF / NYC": ({"united states"}, set()), "Mumbai India": ({"india"}, set()), "Denver Colorado": ({"united states"}, set()),
    "Poland + Romania": ({"poland", "romania"}, set()), "Hybrid": (set(), set()), "": (set(), set()), None: (set(), set()), "Office in France": ({"france"}, set()), "Toronto, ON": ({"canada"}, set()),
}


def ran(spark, texts, column):
    rows = spark.createDataFrame([(t,) for t in texts], "raw string")
    return {r[0]: r[1] for r in rows.select("raw", column).collect()}


def test_facets(spark):
    rows = spark.createDataFrame([(t,) for t in FACETS] * 2, "location_raw string")
    got = {r.location_raw: (set(r.countries), set(r.regions)) for r in places.facets(rows, places.gazetteer(spark)).collect()}
    assert got == FACETS
    more = places.gazetteer(spark, {"ulm": "germany"})
    (row,) = places.facets(spark.createDataFrame([("Ulm",)], "location_raw string"), more).collect()
    assert row.tokens == ["germany", "ulm"]


def test_formatting(spark):
    want = {"a;b": "a, b", "a,, b": "a, b", "Berlin ( () )": "Berlin", "  ": "Unknown", None: "Unknown", "a   b": "a b"}
    assert ran(spark, want, places.formatted(F.col("raw"))) == want


def test_company_leaves_the_location(spark):
    rows = [("Acme - Berlin", "Acme", "Berlin"), ("acme", "Acme", "Unknown"), ("X1 Berlin", "X1", "X1 Berlin"), ("Acme Corp Paris", "acme  corp", "Paris"), ("Berlin", None, "Berlin"), ("A+B (x) Rome", "A+B (x)", "A+B (x) Rome"), ("", "Acme", "")]
    df = spark.createDataFrame(rows, "raw string, company string, want string")
    got = df.select(places.without_company(F.col("raw"), F.col("company")).alias("got"), "want").collect()
    assert [r.got for r in got] == [r.want for r in got]


def test_display_location(spark):
    want = {"Boston or Remote": "Boston", "Remote, United States": "United States", "UK, London, United Kingdom": "United Kingdom, London", "remote": "Unknown", "In-Office, Rome": "In-Office, Rome", "Paris | Paris / Lyon": "Paris, Lyon"}
    assert ran(spark, want, places.without_remote(F.col("raw"))) == want
    geography = F.col("raw").contains("Spain")
    want = {"Remote, Spain": "Spain", "Remote": "Remote", "": "Remote", "Distributed": "Remote", "Somewhere": "Somewhere"}
    assert ran(spark, want, places.resolved(F.col("raw"), geography, F.lit(True))) == want


def test_segments_and_parts(spark):
    want = {"a / b | c; d": ["a", "b", "c", "d"], "a - b-c": ["a", "b-c"], "x (a, b)": ["x", "a, b"], "x or y + z": ["x", "y", "z"], None: []}
    assert ran(spark, want, places.segments(F.col("raw"))) == want
    parts = places.display_parts(F.col("raw"), F.lit("Shown"), F.lit("ashby"))
    got = {k: (v.primary, v.others) for k, v in ran(spark, ["a | b|c", "Paris, Remote, Lyon", "Remote", "Rome, Milan", "", None], parts).items()}
    assert got == {"a | b|c": ("a", ["b", "c"]), "Paris, Remote, Lyon": ("Paris, Remote", ["Lyon"]), "Remote": ("Remote", []), "Rome, Milan": ("Rome", ["Milan"]), "": ("Shown", []), None: ("Shown", [])}


def test_hints(spark):
    want = {"USA": "united states", "es": "spain", "CA": "canada", "EMEA": "emea", "latam": "latin america", " x ": "x"}
    assert ran(spark, want, places.country_hint(F.col("raw"))) == want
    assert ran(spark, ["US | EU, us"], places.split_hints(F.array("raw"))) == {"US | EU, us": ["united states", "european union"]}


def test_titles_and_remote(spark):
    want = {"US Remote Engineer": ["united states"], "Engineer, remote - Germany": ["germany"], "Tell us": [], "u.k. remote": ["united kingdom"], None: []}
    assert ran(spark, want, places.remote_countries(F.col("raw"))) == want
    want = {"Engineer Germany": ["germany"], "Indiana": [], "Sales (UK)": ["united kingdom"], "trust us": [], "Zürich (CH)": ["switzerland"], None: []}
    assert ran(spark, want, places.country_mentions(F.col("raw"))) == want
    assert ran(spark, ["EMEA Remote", "remote: dach", "emea"], places.tied_to_region(F.col("raw"))) == {"EMEA Remote": True, "remote: dach": True, "emea": False}


def test_all_known_countries(spark):
    assert len(places.COUNTRIES) == len(set(places.COUNTRIES)) and set(places.ISO2.values()) <= set(places.COUNTRIES)
    # Hong Kong is shown as `Hong Kong SAR China`, which the reference does not know.
    assert set(places.COUNTRIES) - set(places.ISO2.values()) == {"hong kong"}
    want = {"KE": "kenya", "cn": "china", "BY": "belarus", "Ecuador": "ecuador", "CI": "côte d’ivoire", "bosnia": "bosnia & herzegovina", "lao pdr": "laos", "HK": "hk"}
    assert ran(spark, want, places.country_hint(F.col("raw"))) == want
    assert len(places.ISO2) + len(places.OTHER_ISO2) == 250 and not set(places.ISO2) & set(places.OTHER_ISO2)  # 249 and Kosovo's
    assert [preview_country(c) for c in ("KE", "fj", "zz")] == ["kenya", "fiji", None]
    none = F.array().cast("array<string>")
    found = F.struct(none.alias("tokens"), none.alias("countries"), none.alias("regions"))
    got = ran(spark, ["KE", "Ecuador"], places.merged_with_hints(found, F.array("raw")).getField("countries"))
    assert got == {"KE": ["kenya"], "Ecuador": ["ecuador"]}
