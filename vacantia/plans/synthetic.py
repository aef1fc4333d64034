"""Postings derived from the driver's tables: one for each row of orders, titles and locations from our own lists.

`postings` and `POSTINGS_SQL` make the same rows, in Spark and in SQL; everything that is then derived from them is
computed separately on either side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vacantia.functions.text import quoted
from vacantia.operators.tables import spread

TITLES: tuple[str, ...] = (
    "Senior Backend Engineer", "Backend Engineer (Python)", "Frontend Developer - React", "Full-Stack Engineer II", "Full Stack Developer", "iOS Engineer", "Android Developer (Kotlin)",
    "React Native Developer", "QA Automation Engineer", "SDET III", "DevOps Engineer", "Site Reliability Engineer, L5", "Platform Engineer", "Data Platform Engineer", "Cloud Engineer",
    "Data Engineer", "Analytics Engineer", "Marketing Data Scientist", "Data Scientist", "Machine Learning Engineer", "AI Engineer - Agents", "LLM Research Scientist", "Security Engineer",
    "Application Security Architect", "Penetration Tester", "Solutions Architect", "Sales Engineer, EMEA", "Forward Deployed Software Engineer", "GTM Engineer", "Technical Recruiter",
    "Talent Acquisition Partner", "Product Designer", "UX Researcher", "UI/UX Lead", "Head of Design", "Engineering Manager", "Director of Engineering", "VP of Product", "Product Owner",
    "Technical Program Manager", "Tech Lead, Payments", "HR Business Partner", "People Operations Manager", "Software Engineer", "Software Engineer II - IV", "Software Engineer, Level 3",
    "Member of Technical Staff", "Staff Software Engineer", "Senior Staff Engineer", "Principal Engineer", "Junior Developer", "Graduate Software Engineer", "Software Engineering Intern",
    "Mid-Senior Java Developer", "Senior/Lead Rust Engineer", "C++ Developer", "C# WinUI Developer", "Go Developer", "Golang Programmer", "Embedded C Programmer", "PHP Developer",
    "Node.js Developer", "TypeScript Developer", "Flutter Developer", "Unity Gameplay Programmer", "Systems Architect", "Expert Python Consultant", "Computer Programmer", "COBOL Programmer",
    "Accountant", "Office Manager", "Customer Success Manager", "Lead the Way Coordinator", "Technical Staff Assistant", "API Engineer", "Server-Side Developer", "UI Artist", "UX Engineer",
    "Software Engineer - Berlin, DE", "Backend Engineer - Chicago, IL, USA", "Data Analyst (Portugal)", "US Remote Software Engineer", "Software Engineer, Remote - Germany", "Engineer, Go to Market",
    "Vue.js Frontend Engineer", "Next.js Developer", "Objective-C Developer", "Swift Engineer", "Infrastructure Engineer", "Threat Detection Engineer", "Business Intelligence Analyst", "", "  ",
)
LOCATIONS: tuple[str | None, ...] = (
    "Berlin, Germany", "Berlin, DE", "Munich", "Paris, France", "London, UK", "London UK", "Manchester, England", "Amsterdam, NL", "Rotterdam, Netherlands", "Madrid; Barcelona", "Lisbon, Portugal",
    "Dublin", "Zürich, CH", "Vienna, Austria", "Warsaw | Kraków", "Prague, Czech Republic", "Tbilisi, Georgia", "Atlanta, Georgia", "Georgia, United States", "Bangalore, India", "Mumbai India",
    "Tokyo, Japan", "Toronto, ON", "Vancouver, BC, Canada", "St. John's, NL", "San Francisco, CA", "SF", "NYC", "New York, NY, USA", "Austin TX", "Denver Colorado", "Seattle, WA or Remote",
    "Boston, MA / New York, NY", "Wilmington, DE", "São Paulo, Brasil", "Mexico City, México", "Sydney, Australia", "Singapore", "Remote", "Remote - US", "Remote, Germany", "US Remote", "Remote (USA)",
    "Remote (UK, Germany)", "Remote (U.S. or Europe)", "EMEA", "Remote - EMEA", "LATAM", "APAC", "Europe", "Worldwide", "Anywhere", "Hybrid", "Hybrid - London", "Berlin (Hybrid)", "On-site, Paris",
    "Berlin, HQ", "Headquarters", "Unknown", "", "  ", None, "Remote | Berlin | Paris", "Paris, Remote, Lyon", "Remote;  Spain", "Madrid,, Spain", "Berlin ( )", "Poland + Romania", "Spain or Portugal",
    "USA", "United States of America", "United Kingdom", "UAE", "Dubai, UAE", "South Korea", "Seoul, Republic of Korea", "Canada: Select locations", "Remote, Remote", "Indiana", "Bucharest, Romania",
    "Office in France", "Anywhere in Spain", "Lima, Peru - Remote", "Distributed", "Customer#000000001 Berlin", "Washington, DC",
)
BOARDS = ("ashby", "greenhouse", "workable", "lever")
BASE_URL = "https://jobs.example.com/"


def _pick(values: tuple, at: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (at + 1).cast("int"))


def postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, provider, external_id, title, company, location_raw, posted_at, is_flagged_remote and url."""
    orders = spread(spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey", "o_orderdate"))
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_name")
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    rows = orders.join(customers, cust == F.col("c_custkey")).select(
        _pick(BOARDS, key % len(BOARDS)).alias("provider"),
        key.cast("string").alias("external_id"),
        _pick(TITLES, (key * 7 + cust) % len(TITLES)).alias("title"),
        F.col("c_name").alias("company"),
        _pick(LOCATIONS, (key * 13 + cust) % len(LOCATIONS)).alias("location_raw"),
        F.col("o_orderdate").cast("timestamp").alias("posted_at"),
        (key % 11 == 0).alias("is_flagged_remote"),
        F.concat(F.lit(BASE_URL), key.cast("string")).alias("url"),
    )
    return rows.select(F.concat_ws(":", "provider", "external_id").alias("id"), "*")


def _sql_list(values: tuple) -> str:
    return "[" + ", ".join("NULL" if v is None else f"'{quoted(v)}'" for v in values) + "]"


POSTINGS_SQL = f"""(
  SELECT provider || ':' || external_id AS id, * FROM (
    SELECT {_sql_list(BOARDS)}[o_orderkey % {len(BOARDS)} + 1] AS provider, CAST(o_orderkey AS VARCHAR) AS external_id,
           {_sql_list(TITLES)}[(o_orderkey * 7 + o_custkey) % {len(TITLES)} + 1] AS title, c_name AS company,
           {_sql_list(LOCATIONS)}[(o_orderkey * 13 + o_custkey) % {len(LOCATIONS)} + 1] AS location_raw, o_orderdate AS posted_at,
           o_orderkey % 11 = 0 AS is_flagged_remote, '{BASE_URL}' || CAST(o_orderkey AS VARCHAR) AS url
    FROM orders JOIN customer ON o_custkey = c_custkey
  )
)"""
