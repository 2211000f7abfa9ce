"""Sources, merging and profiles on small candidates, with the traps of their rules."""

import itertools
import json
import time

import pytest
from pyspark.sql import functions as F

from accordis import reference as ref
from accordis.operators import entries, merge, skills
from accordis.plans import pipeline, project, report
from accordis.sources import ats, github, resume
from accordis.sources.observed import COLUMNS

SAMPLE = {
    "candidateName": "john doe", "emailAddress": "John.Doe@Example.com", "contact_phone": "+1-650-555-0192", "current_location": "San Francisco, California, United States", "jobTitle": "Senior Software Engineer",
    "yearsOfExperience": 6, "technical_skills": ["Python", "JS", "React.js", "node", "PostgreSQL", "Docker", "Git"], "linkedin_url": "https://linkedin.com/in/johndoe", "github_url": "https://github.com/johndoe/",
    "work_experience": [{"company": "Google LLC", "title": "Software Engineer II", "start": "January 2021", "end": "Present"}, {"company": "Startup Inc.", "title": "Junior Developer", "start": "June 2019", "to": "December 2020"}],
    "education": [{"school": "UC Berkeley", "degree": "BSc", "major": "Computer Science", "start": "2015-08", "graduation_date": "2019-05", "cgpa": 3.8}],
}
RESUME = """Jane Q Public
Pune, India
5550192000 jane.public@example.com github.com/janepub
Summary
Backend engineer with 3-5 years of experience. Likes SQL
Technical Skills
Python, Java | SQL
Experience
Engineer at Acme Corp
March 2021 - Present
Built services.
Education
Example University
B.Tech 2019, CGPA: 8.5"""


def observations(spark, rows):
    """rows: (key, field, source, value)."""
    n = itertools.count()
    data = [(k, f, s, next(n), v, None, v, ref.BASE_CONFIDENCE[s], ref.METHODS[s]) for k, f, s, v in rows]
    from accordis.schemas import OBSERVATION

    return spark.createDataFrame(data, OBSERVATION)


def test_ats_profile(spark):
    docs = spark.createDataFrame([("1", json.dumps(SAMPLE)), ("2", "{}"), ("3", "not json"), ("4", None)], "candidate_key string, doc string")
    p = {r.candidate_key: r for r in pipeline.transform(ats=docs).canonical.collect()}
    r = p["1"]
    assert r.full_name == "John Doe" and r.headline == "Software Engineer II" and r.years_experience == 6.0
    assert (r.location.city, r.location.state, r.location.country) == ("San Francisco", "California", "US")
    assert r.emails == ["john.doe@example.com"] and r.phones == ["+16505550192"]
    assert [s.name for s in r.skills] == ["Docker", "Git", "JavaScript", "Node.js", "PostgreSQL", "Python", "React"] and {s.confidence for s in r.skills} == {0.95}
    assert [s.aliases_found for s in r.skills][2] == ["JS"]
    assert [(e.company, e.start_date, e.end_date) for e in r.experience] == [("Google LLC", "2021-01", "Present"), ("Startup Inc.", "2019-06", "2020-12")]
    e = r.education[0]
    assert (e.institution, e.degree, e.field_of_study, e.start_date, e.end_date, e.gpa) == ("UC Berkeley", "BSc", "Computer Science", "2015-08", "2019-05", 3.8)
    assert (r.links.linkedin, r.links.github, r.links.portfolio) == ("https://linkedin.com/in/johndoe", "https://github.com/johndoe", None)
    assert len(r.confidence_scores) == 5 and {s.score for s in r.confidence_scores.values()} == {0.95} and r.overall_confidence == 0.95
    assert all(p[k].full_name is None and p[k].emails == [] and p[k].overall_confidence == 0.0 for k in "234")


def test_alias_order(spark):
    docs = [
        {"p": {"a": {"title": "X"}, "title": "Y"}},  # an object's own key before what is below an earlier one
        {"headline": "", "work": {"headline": "deep"}, "title": "T"},  # an empty root value ends an alias
        {"a": {"headline": None, "b": {"headline": "below null"}}, "role": "R"},
        {"jobTitle": "root", "jobs": [{"title": "nested first"}]},
    ]
    df = spark.createDataFrame([(str(i), json.dumps(d)) for i, d in enumerate(docs)], "candidate_key string, doc string")
    got = {r.candidate_key: r.value for r in ats.resolve_aliases(df).where("canonical = 'headline'").collect()}
    assert got == {"0": "Y", "1": "T", "2": "R", "3": "nested first"}


def test_resume(spark):
    obs, status = resume.resume_observations(spark.createDataFrame([("1", RESUME), ("2", " "), ("3", None)], "candidate_key string, text string"))
    rows = obs.collect()
    assert obs.columns == COLUMNS
    get = lambda f: [r.value for r in sorted(rows, key=lambda r: r.item_ord) if r.field == f]
    assert get("full_name") == ["Jane Q Public"] and get("location") == ["Pune, India"] and get("years_experience") == ["5.0"]
    assert get("headline") == ["Backend engineer with 3-5 years of experience"] and get("skills") == ["Python", "Java", "SQL"]
    assert get("emails") == ["jane.public@example.com"] and get("phones") == ["5550192000"]
    jobs = [r.entry for r in sorted(rows, key=lambda r: r.item_ord) if r.field == "experience"]
    assert (jobs[0]["title"], jobs[0]["company"]) == ("Engineer", "Acme Corp") and "start_date" not in jobs[0]
    assert (jobs[1]["title"], jobs[1]["company"], jobs[1]["start_date"], jobs[1]["end_date"]) == ("March 2021", "Present", "March 2021", "Present")
    edu = [r.entry for r in rows if r.field == "education"]
    assert edu == [{"institution": "Example University", "degree": "B.Tech", "end_date": "2019", "gpa": "8.5"}]
    assert [r.entry for r in rows if r.field == "links"] == [{"github": "https://github.com/janepub"}]
    assert {(r.candidate_key, r.available) for r in status.collect()} == {("1", True), ("2", False), ("3", False)}


def test_sections(spark):
    text = "pre\nSkills:\nold\nUnknown\nstays\nSKILLS\nnew\nEducation\nschool"
    m = spark.createDataFrame([(text,)], "t string").select(resume.sections(F.col("t")).alias("m")).first().m
    assert m == {"_preamble": "pre", "skills": "new", "education": "school"}
    u = "see https://linkedin.com/in/joehttps://github.com/joe"
    r = spark.createDataFrame([(u,)], "t string").select(resume.profile_url(F.col("t"), r"linkedin\.com/in/").alias("a"), resume.profile_url(F.col("t"), r"github\.com/").alias("b")).first()
    assert (r.a, r.b) == ("https://linkedin.com/in/joe", "https://github.com/joe")


def test_github(spark):
    users = spark.createDataFrame([("1", "u", "N", "bio", "e@x.yz", "Pune", "b.io", "https://github.com/u"), ("2", "v", None, None, None, None, None, None)], "candidate_key string, username string, name string, bio string, email string, location string, blog string, html_url string")
    repos = spark.createDataFrame([("1", x) for x in ("C", "Python", "C", None)], "candidate_key string, language string")
    obs, status = github.github_observations(users, repos)
    assert [(r.value, r.raw) for r in obs.where("field = 'skills'").orderBy("item_ord").collect()] == [("C", "C (2 repos)"), ("Python", "Python (1 repos)")]
    assert {(r.candidate_key, r.available, *r.parse_errors) for r in status.collect()} == {("1", True), ("2", False, "profile not found")}


@pytest.mark.parametrize(
    ("rows", "value", "score"),
    [
        ([("ATS", "Google")], "Google", 0.95), ([("ATS", "Google"), ("Resume", " google")], "Google", 0.98), ([("ATS", "Google"), ("Resume", "Amazon")], "Google", 0.95),
        ([("Resume", "x"), ("GitHub", "x"), ("ATS", "y")], "y", 0.95), ([("Resume", "x"), ("GitHub", "X")], "x", 0.93), ([("ATS", "a"), ("Resume", "A"), ("GitHub", "a ")], "a", 1.0),
    ],
)
def test_vote(spark, rows, value, score):
    r = merge.vote(observations(spark, [("1", "f", s, v) for s, v in rows])).first()
    assert (r.value, r.score) == (value, score)
    assert merge.vote(observations(spark, [("1", "f", "ATS", " ")])).count() == 0


def test_reasoning(spark):
    r = merge.vote(observations(spark, [("1", "f", "ATS", "a"), ("1", "f", "Resume", "a"), ("1", "f", "GitHub", "b")])).first()
    assert r.reasoning == "Agreement between ATS, Resume. Agreement bonus applied: 0.98. Disagreeing source(s): GitHub overridden."


def test_lists_and_links(spark):
    o = observations(spark, [("1", "emails", "GitHub", "A@x.yz"), ("1", "emails", "ATS", "b@x.yz"), ("1", "emails", "Resume", "a@x.yz "), ("1", "emails", "ATS", "B@X.yz")])
    assert [r["values"] for r in merge.string_lists(o).collect()] == [["b@x.yz", "a@x.yz"]]
    log = merge.list_log(merge.dedup_by_priority(o)).first()
    assert (log.total, log.distinct_values) == (4, 2) and log.avg_confidence > 1
    m = spark.sql("select map('a','','b','x') h, map('a','1','b','2','c','3') l").select(merge.coalesce_fill(F.col("h"), F.col("l")).alias("m")).first().m
    assert m == {"a": "1", "b": "x", "c": "3"}


def test_skills(spark):
    o = observations(spark, [("1", "skills", s, v) for s, v in (("ATS", "JS"), ("Resume", "javascript"), ("GitHub", "JavaScript"), ("ATS", "C++"), ("GitHub", "C"), ("ATS", "pythn"), ("ATS", "Pythn"), ("ATS", "QuantumML"))])
    known = skills.normalize(o)
    by = {r.value: (r.canonical, r.match) for r in known.collect()}
    assert by["JS"] == ("JavaScript", "exact") and by["pythn"] == ("Python", "fuzzy") and by["Pythn"] == ("Pythn", "passthrough") and by["QuantumML"][1] == "passthrough"
    got = {r.name: r for r in merge.merge_skills(known).collect()}
    assert got["JavaScript"].confidence == 1.0 and got["JavaScript"].aliases == ["JS"] and got["JavaScript"].sources == ["ATS", "Resume", "GitHub"]
    assert got["C++"].sources == ["ATS", "GitHub"] and "C" not in got and "C" in {r.name for r in merge.merge_skills(known, strict=True).collect()}


def test_entries(spark):
    rows = [
        ("Resume", 0, {"company": "Google", "title": "Engineer", "description": "kept"}), ("ATS", 0, {"company": "Google LLC", "title": "Software Engineer II", "start_date": "2021"}), ("ATS", 1, {"company": "Google LLC", "title": "Software Engineer"}),
        ("ATS", 2, {"company": "", "title": "Software Engineer II"}), ("ATS", 3, {"company": "Other", "title": "Cook", "start_date": "sometime"}), ("ATS", 4, {"company": "", "title": ""}),
    ]
    from accordis.schemas import OBSERVATION

    o = spark.createDataFrame([("1", "experience", s, i, None, e, None, ref.BASE_CONFIDENCE[s], "m") for s, i, e in rows], OBSERVATION)
    c = entries.cluster(o, "experience")
    assert c.count() == 5 and c.where("not merged").count() == 2
    x = entries.experiences(c).first().experience
    assert len(x) == 1 and (x[0].company, x[0].start_date, x[0].description) == ("Google LLC", "2021-01", "kept")


def test_projection(spark):
    df = spark.createDataFrame([("i", None, ["a"], 0.5)], "candidate_id string, full_name string, emails array<string>, overall_confidence double")
    cfg = {"fields": ["full_name", "emails"], "rename": {"emails": "mail", "candidate_id": "no"}, "missing_field_policy": "null", "_x": 1}
    assert json.loads(project.project_json(df, cfg).first().json) == {"candidate_id": "i", "full_name": None, "mail": ["a"]}
    assert json.loads(project.project_json(df, cfg | {"missing_field_policy": "omit"}).first().json) == {"candidate_id": "i", "mail": ["a"]}
    with pytest.raises(Exception, match="missing field"):
        project.project(df, cfg | {"missing_field_policy": "error"}).collect()
    assert project.Projection.of({"missing_field_policy": "?"}).missing_field_policy == "null" and project.Projection.of(None).fields[0] == "candidate_id"


def test_reports(spark):
    df = spark.createDataFrame([("1", "f", "ATS", 0.95, "Selected"), ("1", "f", "Resume", 0.85, "Selected"), ("1", "g", "ATS", 0.2, "Selected"), ("2", "f", "ATS", 0.9, "Selected"), ("2", "f", "GitHub", 0.8, "Rejected — x")], "candidate_key string, field string, source string, confidence double, notes string")
    got = {(r.candidate_key, r.field): (r.agreement, r.reason) for r in report.explain(df).collect()}
    assert got == {("1", "f"): ("Two-Source Agreement", "Source agreement after normalization"), ("1", "g"): ("Single Source", "Invalid value rejected / Low confidence"), ("2", "f"): ("Single Source", "Highest source confidence")}
    bands = spark.createDataFrame([(0.9,), (0.7,), (0.1,)], "x double").select(report.band(F.col("x"))).collect()
    assert [r[0] for r in bands] == ["high", "medium", "low"]


def test_batch(spark):
    slots = spark.createDataFrame([(0, json.dumps(SAMPLE), RESUME, "https://github.com/u"), (1, json.dumps({"name": "Al"}), None, " "), (2, None, RESUME, "x")], "index int, ats_data string, resume_text string, github_url string")
    got = {r["index"]: r for r in pipeline.run_batch(slots).collect()}
    assert (got[0].status, got[1].status, got[2].status) == ("ok", "skipped", "skipped")
    assert got[1].error_msg == "Missing: Resume PDF, GitHub Profile URL" and got[1].label == "#2 · Al (Skipped)" and got[2].label == "#3 · Candidate 3 (Skipped)"
    assert got[0].full_name == "John Doe" and {s.name for s in got[0].skills} >= {"Java", "SQL"}
    d = report.dashboard(pipeline.run_batch(slots)).first()
    assert (d.total, d.ok, d.skipped) == (3, 1, 2)


def test_partitions_do_not_matter(spark):
    rows = [(str(i % 7), f, s, f"v{(i * 31 + j) % 3}") for i in range(60) for j, (f, s) in enumerate((("a", "ATS"), ("a", "Resume"), ("b", "GitHub")))]
    o = observations(spark, rows)
    results = set()
    for n in (1, 4, 50):
        spark.conf.set("spark.sql.shuffle.partitions", str(n))
        results.add(str(sorted(map(str, merge.vote(o.repartition(n)).collect())) + sorted(map(str, merge.string_lists(o.repartition(n)).collect()))))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert len(results) == 1


def test_stream(spark, tmp_path):
    from accordis.schemas import OBSERVATION
    from accordis.streaming.incremental import consolidate_stream, latest

    src = str(tmp_path / "in")
    for part in ([("1", "f", "ATS", "a"), ("2", "f", "Resume", "b")], [("1", "f", "Resume", "a")]):
        observations(spark, part).coalesce(1).write.mode("append").parquet(src)
        s = spark.readStream.schema(OBSERVATION).parquet(src)
        consolidate_stream(s, str(tmp_path / "store"), merge.vote, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    now = latest(spark.read.parquet(str(tmp_path / "out")), ["candidate_key", "field"])
    assert {(r.candidate_key, r.score) for r in now.collect()} == {("1", 0.98), ("2", 0.85)}


def test_long_section(spark):
    """Lines are split and searched once: of an expression that a lambda repeats, a long section would never end."""
    jobs = [f"Title {i} at Firm {i}\nx\n{2000 + i % 20} - Present\nmore {i}" for i in range(600)]
    blocks = resume.split_entries(F.col("t"))
    df = spark.createDataFrame([("\n".join(jobs),), ("one ",), ("",), (None,)], "t string")
    began = time.time()
    got = [r.b for r in df.select(blocks.alias("b")).collect()]
    assert time.time() - began < 60
    assert len(got[0]) == 601 and got[0][0] == "Title 0 at Firm 0\nx" and got[0][1] == "2000 - Present\nmore 0\nTitle 1 at Firm 1\nx" and got[1:] == [["one"], [], None]
    entries_of = [r.e for r in df.select(F.transform(blocks, resume.experience_entry).alias("e")).collect()]
    assert entries_of[0][0] == {"title": "Title 0", "company": "Firm 0", "description": ""} and entries_of[0][1]["start_date"] == "2000" and entries_of[1:] == [[{"title": "one", "company": "", "description": ""}], [], None]


def test_entry_split_plan(spark):
    from accordis.plans import queries

    plan = queries.entry_split(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RLIKE") == 1 and plan.count("regexp_extract_all") == 1
