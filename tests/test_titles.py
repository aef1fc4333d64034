import pytest
from pyspark.sql import functions as F

from vacantia.functions import titles

ROLES = {
    "Senior Backend Engineer": "backend", "UI QA Automation Engineer": "qa", "C# WinUI Developer": "fullstack", "React Developer": "frontend", "Kotlin Developer": "mobile",
    "Data Platform Engineer": "data", "Cloud Data Platform Engineer": "data", "Platform Engineer": "devops", "AI Data Engineer": "ai", "Marketing Data Scientist": "data", "Consumer Data Scientist": "ai",
    "HR Business Partner": "other", "HR Systems Engineer": "engineer", "Director of Engineering": "management", "Director of Product": "other", "VP of Product": "management",
    "Product & Engineering Manager": "management", "AI Solutions Engineer": "solutions", "Forward-Deployed ML Engineer": "solutions", "UX Researcher": "designer", "Design Engineer": "frontend",
    "Rust Programmer": "backend", "COBOL Programmer": "other", "Computer Programmer": "engineer", "Expert in Python": "engineer", "Security Tester": "qa", "Threat Engineer": "security",
    "Full Stack Developer (Go, React)": "fullstack", "Go Developer": "backend", "Member of Technical Staff": "engineer", "Systems Architect": "engineer", "IMLC Coordinator": "other", "": "other", None: "other",
}
LEVELS = {
    "Software Engineering Intern": ["intern"], "Internal Auditor": [], "Graduate Engineer": ["junior"], "Mid-Senior Developer": ["mid", "senior"], "Senior/Lead Engineer": ["senior", "staff"],
    "Manager, Mid-Senior": ["mid", "senior"], "Staff Engineer": ["staff"], "Technical Staff": [], "Lead the Way": [], "Leadership Coach": ["staff"], "Engineer, L5": ["senior"], "Engineer L7": ["staff"],
    "Software Engineer II - IV": ["mid", "senior", "staff"], "Software Engineer, Level 3": ["senior"], "Developer I": ["junior"], "Sr. Developer": ["senior"], "Intermediate Developer": ["mid"], "Developer": [], "": [], None: [],
}
STACKS = {
    "C++ / Rust Developer": {"c", "rust"}, "C# Developer": {".net"}, "Node.js Developer": {"node.js", "javascript"}, "Java Script Developer": {"java", "javascript"}, "Embedded C, Go": {"c", "golang"},
    "Go to Market Lead": set(), "Go Live Manager": set(), "Objective-C Developer": {"objc"}, "React Native Dev": {"react", "react native"}, "Javanese Teacher": set(), None: set(),
}


def ran(spark, texts, column):
    rows = spark.createDataFrame([(t,) for t in texts], "title string")
    return {r[0]: r[1] for r in rows.select("title", column).collect()}


def test_roles(spark):
    assert ran(spark, ROLES, titles.role_of(F.col("title"))) == ROLES


def test_levels(spark):
    assert ran(spark, LEVELS, titles.seniorities_of(F.col("title"))) == LEVELS


def test_stacks(spark):
    assert {t: set(s) for t, s in ran(spark, STACKS, titles.stacks_named(F.col("title"))).items()} == STACKS
    both = titles.stacks_named(F.col("title"), F.lit("<b>Django</b> and go developer, go"))
    assert ran(spark, ["Rust Developer"], both) == {"Rust Developer": ["rust", "python", "golang"]}


@pytest.mark.parametrize(("role", "want"), [("frontend", ["react"]), ("backend", ["python"]), ("qa", []), ("fullstack", ["python", "react"]), (None, ["python", "react", "kotlin"])])
def test_stacks_by_role(spark, role, want):
    got = ran(spark, ["Python, React, Kotlin"], titles.stack_of(F.col("title"), F.lit(role).cast("string")))
    assert got["Python, React, Kotlin"] == want


def test_keywords(spark):
    assert ran(spark, ["ML Engineer", "IMLC", "x-ml", None], titles.title_keyword(F.col("title"), "ml")) == {"ML Engineer": True, "IMLC": False, "x-ml": True, None: False}
    assert ran(spark, ["Backenders"], titles.title_keyword(F.col("title"), "Backend")) == {"Backenders": True}


def test_location_leaves_the_title(spark):
    rows = [("Engineer - Berlin, Germany", "berlin, germany", "Engineer"), ("Engineer - Chicago, IL, USA", "x", "Engineer"), ("Engineer (Portugal)", None, "Engineer"), ("Engineer (C3)", "Unknown", "Engineer (C3)"), ("Engineer - Platform", "", "Engineer - Platform"), (None, "x", "")]
    df = spark.createDataFrame(rows, "title string, location string, want string")
    assert all(r[0] == r.want for r in df.select(titles.without_location(F.col("title"), F.col("location")), "want").collect())


def test_experience(spark):
    want = {"Mid-Senior level": ["mid", "senior"], "Director": ["staff"], "Entry level": ["junior"], "Associate": ["mid"], None: [], "x": []}
    assert ran(spark, want, titles.experience_levels(F.col("title"))) == want
