"""Scalar functions against expected values."""

import pytest
from pyspark.sql import functions as F

from accordis.functions import similarity as sim
from accordis.functions import text as t
from accordis.functions import values as v


def one(spark, values, fn, *more):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(values)], "i int, x string")
    return [r.y for r in df.select("i", fn(F.col("x"), *more).alias("y")).orderBy("i").collect()]


def test_text(spark):
    assert one(spark, ["  a \t b\n", "x", None], t.normalize_whitespace) == ["a b", "x", None]
    assert one(spark, ["john mcDonald o'neil", "JANE", "McDonald  x"], t.to_title_case) == ["John mcDonald O'neil", "Jane", "McDonald X"]
    assert one(spark, ["C++", "C#", "Node.js", "Crème Brûlée", "a_b  c-d"], t.slugify) == ["c", "c", "nodejs", "creme-brulee", "a-b-c-d"]
    assert one(spark, [" https://x.y// "], t.clean_url) == ["https://x.y"]
    assert one(spark, ["", " ", "[]", "{}", None, "0"], t.is_empty) == [True] * 5 + [False]
    assert one(spark, ["3-5 years of", "over 7 years", "none", "2.5+ yrs, 4 year"], t.years_of_experience) == [5.0, 7.0, None, 4.0]
    r = spark.sql("select array('a','B','A','b','c') x").select(t.distinct_ignoring_case(F.col("x")).alias("y")).first().y
    assert r == ["a", "B", "c"]


@pytest.mark.parametrize(
    ("raw", "region", "phone", "conf"),
    [("+1-650-555-0192", None, "+16505550192", 1.0), ("9876543210", "IN", "+919876543210", 1.0), ("+44 20 7946 0958", None, "+442079460958", 1.0), ("not-a-phone", None, "not-a-phone", 0.2), ("", None, "", 0.2), ("(650) 555-0192", None, "+16505550192", 1.0), ("09876543210", "IN", "+919876543210", 1.0), ("123", "US", "123", 0.2)],
)
def test_phone(spark, raw, region, phone, conf):
    r = spark.createDataFrame([(raw, region)], "x string, r string").select(v.normalize_phone(F.col("x"), F.col("r")).alias("y")).first().y
    assert (r.phone, r.confidence) == (phone, conf)


def test_dates(spark):
    raw = ["January 2024", "Jan 2024", "01/2024", "2024-01", "2024-01-15", "Present", "current", "2019", "", "Sept 2021", "2024-13", "March 3, 2020", "soon", None]
    got = one(spark, raw, v.normalize_date)
    assert [r.date for r in got] == ["2024-01"] * 5 + ["Present", "Present", "2019-01", "", "2021-09", "2024-13", "2020-03", "soon", None]
    assert [r.valid for r in got] == [True] * 8 + [False, True, False, True, False, False]


def test_places(spark):
    got = one(spark, ["San Francisco, CA, United States", "Bangalore, India", "London, UK", "Berlin, DE", "", None, "Pune", "San Francisco, CA"], v.normalize_location)
    assert [(r.city, r.state, r.country) for r in got] == [("San Francisco", "CA", "US"), ("Bangalore", None, "IN"), ("London", None, "GB"), ("Berlin", None, "DE"), (None, None, None), (None, None, None), ("Pune", None, None), ("San Francisco", None, "CA")]


def test_emails(spark):
    got = one(spark, ["Test@Example.COM", "nope", "user+tag@example.com", "a@b.ccom", "x@gmaiil.con", " ", "a..b@c.de", "a@-b.com"], v.normalize_email)
    assert [(r.email, r.valid, r.confidence) for r in got] == [("test@example.com", True, 1.0), ("nope", False, 0.2), ("user+tag@example.com", True, 1.0), ("a@b.com", True, 1.0), ("x@gmail.com", True, 1.0), (" ", False, 0.2), ("a..b@c.de", False, 0.2), ("a@-b.com", False, 0.2)]


def test_names(spark):
    got = one(spark, ["john doe", "JANE SMITH", "  alice   wonderland  ", "McDonald", "A", "", "x 9", "Zoë O'Neil"], v.normalize_name)
    assert [r.name for r in got][:4] == ["John Doe", "Jane Smith", "Alice Wonderland", "McDonald"] and got[7].name == "Zoë O'Neil"
    assert [r.valid for r in got] == [True] * 4 + [False] * 3 + [True]


def test_validators(spark):
    ok = lambda values, fn: [r.ok for r in one(spark, values, fn)]
    assert ok(["2024-01", "Present", "2024-13", "Jan 2024", None], v.validate_date) == [True, True, False, False, False]
    assert ok(["US", "IN", "ZZ", None], v.validate_country) == [True, True, False, False]
    assert ok(["https://a.b/c", "a.b", "ftp://x"], v.validate_url) == [True, False, False]
    assert ok(["https://github.com/user/", "https://github.com/user/repo", "https://www.github.com/u-1", None], v.validate_github_url) == [True, False, True, False]
    assert ok(["a@b.co", "x"], v.validate_email) == [True, False] and ok(["+16505550192", "x"], v.validate_phone) == [True, False]
    df = spark.sql("select map('company','x') a, map('title','') b, map('institution','U') c")
    r = df.select(v.validate_experience(F.col("a")).ok, v.validate_experience(F.col("b")).ok, v.validate_education(F.col("c")).ok, v.validate_education(F.col("a")).ok).first()
    assert list(r) == [True, False, True, False]
    assert one(spark, ["https://github.com/torvalds", "https://github.com/torvalds/", "github.com/torvalds", "https://notgithub.com/user", "x"], v.github_username) == ["torvalds"] * 3 + [None, None]


def test_similarity(spark):
    assert round(sim.ratio("pythn", "python3"), 1) == 83.3 and sim.ratio("", "") == 100 and sim.ratio("a", "") == 0
    assert sim.token_sort_ratio("b a", "a b") == 100 and sim.token_set_ratio("software engineer", "senior software engineer") == 100 and sim.token_set_ratio("", "x") == 0
    pairs = [("pythn", "python3"), ("new york city", "york new"), ("", "a"), ("kitten", "sitting"), ("", "")]
    df = spark.createDataFrame(pairs, "a string, b string")
    got = [round(r.y, 6) for r in df.select(sim.token_sort_column(F.col("a"), F.col("b")).alias("y")).collect()]
    assert got == [round(sim.token_sort_ratio(a, b), 6) for a, b in pairs]
