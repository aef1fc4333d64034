import json

from pyspark.sql import functions as F

from vacantia.functions import scripts
from vacantia.sources import boards, companies, links


def test_names_on_pages(spark):
    pages = [
        (1, "<a href='https://jobs.ashbyhq.com/Big%20Co%2B/1'><img alt='  Big \n Co '></a><a href='https://jobs.ashbyhq.com/big%20co+'>Second</a>"),
        (2, "<table><tr><td><span>Jobs</span><span class='x'>Tiny</span> <a href='https://apply.workable.com/Tiny/'>Apply</a></td></tr></table>"),
        (3, "<p>No cell <a href='https://team.workable.com/'>here</a></p>"),
        (4, "<li>Plain <b>Text</b> <a href='http://job-boards.greenhouse.io/Plain'>link</a><a href='#x'>y</a>"),
        (5, None),
        (6, "<a href='https://boards.greenhouse.io/embed/x'>Embed</a><a>none</a></div></td><a href=https://ashbyhq.com/loose title=Loose>website</a>"),
    ]
    got = companies.page_companies(spark.createDataFrame(pages, "page_id long, html string")).collect()
    assert {tuple(r) for r in got} == {
        ("ashby", "big co+", "Big Co"), ("workable", "tiny", "Tiny"), ("workable", "team", None), ("greenhouse", "plain", "Plain Text"), ("ashby", "loose", "Loose"),
    }


def test_catalog_files(spark, tmp_path):
    array = [{"provider": "ashby", "externalId": "A", "name": "x"}, {"provider": "other", "externalId": "B", "name": "y"}, {"provider": "lever", "name": "z"}, {"provider": "lever", "externalId": "c", "name": None, "apiRegion": "eu"}]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text(json.dumps(array))
    (tmp_path / "in" / "b.json").write_text("{broken")
    rows = companies.read_catalog(spark, str(tmp_path / "in"))
    assert {tuple(r) for r in rows.collect()} == {("ashby", "A", "x", None), ("lever", "c", None, "eu")}
    new = spark.createDataFrame([("ashby", "a", "newer"), ("greenhouse", "g", None)], "provider string, external_id string, name string")
    companies.write_catalog(rows.drop("api_region"), new, str(tmp_path / "out"))
    lines = [json.loads(x) for p in sorted((tmp_path / "out").glob("part-*")) for x in p.read_text().splitlines()]
    assert lines == [{"provider": p, "external_id": e, "name": n} for p, e, n in (("ashby", "a", "newer"), ("greenhouse", "g", None), ("lever", "c", None))]


def test_fields_and_links(spark):
    rows = spark.createDataFrame([(1, '{"a": [{"Title": "x"}, {"title": 3}], "title": "y"}'), (2, "[[]"), (3, None)], "id int, payload string")
    assert {r.id: r["values"] for r in companies.fields_named(rows, ("title",)).collect()} == {1: ["x", "y"], 2: [], 3: []}
    hrefs = ["https://jobs.ashbyhq.com/%zz", "https://jobs.ashbyhq.com/a%20b", "https://www.workable.com/x", "mailto:x", None]
    df = spark.createDataFrame([(i, h) for i, h in enumerate(hrefs)], "i int, href string")
    got = {r.i: r.b for r in df.select("i", links.board_of(F.col("href")).alias("b")).collect()}
    assert got[0].slug == "%zz" and got[1].slug == "a b" and not any(got[i] for i in (2, 3, 4))


def test_pages_are_read_until_one_is_short(spark):
    rows = [("s", 0, 2), ("s", 1, 1), ("s", 2, 2), ("t", 0, 2), ("t", 1, 2), ("u", 0, 0)]
    landed = spark.createDataFrame([(s, p, json.dumps([{}] * n)) for s, p, n in rows], "slug string, page int, payload string")
    assert {(r.slug, r.page) for r in boards.whole_pages(landed, 2).collect()} == {("s", 0), ("s", 1), ("t", 0), ("t", 1), ("u", 0)}


def test_other_scripts(spark):
    cases = {
        "Москва, Россия": "Moskva, Rossiya", "Αθήνα": "Athina", "თბილისი": "Tbilisi", "서울": "Seoul", "とうきょう": "Toukiyou", "T`bilisi": "Tbilisi", "київ-львів": "Kiyiv-Lviv",
        "Łódź": "Łódź", "Queen's": "Queen's", "Queen's`": "Queen's", "東京": "東京", "": "", None: None,
    }
    assert {t: scripts.in_latin(t) for t in cases} == cases
    assert scripts.in_latin("東京, 日本", {"東": "tou", "京": "kyou"}) == "Toukyou, 日本"
    df = spark.createDataFrame([(t,) for t in cases], "t string")
    assert {r.t: r.u for r in scripts.romanized(df, "t", "u").collect()} == cases
    odd = {r.t for r in df.where(scripts.other_script(F.col("t"))).collect()}
    assert odd == {"Москва, Россия", "Αθήνα", "თბილისი", "서울", "とうきょう", "київ-львів", "東京"}
