"""Résumé text: sections, contact data, skills and entries by rules, all inside a row (no shuffle, no Python)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from accordis import reference as ref
from accordis.functions.text import bound, normalize_whitespace, years_of_experience
from accordis.sources import observed as ob

MONTH = "Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec|" + "|".join(m for m in ref.MONTHS if m != "May")


def heading(line: Column) -> Column:
    """The section that a line is the heading of, else null."""
    out = F
    for name, patterns in ref.SECTION_PATTERNS.items():
        out = out.when(F.regexp_like(F.trim(line), F.lit(rf"(?i)^(?:{'|'.join(f'(?:{p})' for p in patterns)})\s*:?\s*$")), F.lit(name))
    return out.otherwise(F.lit(None))


def sections(text: Column) -> Column:
    """Map of section to body. Lines before the first heading are _preamble; of a repeated heading the last counts."""
    lines = F.split(text, "\n", -1)
    heads = F.filter(F.transform(lines, lambda x, i: F.struct(heading(x).alias("name"), i.alias("at"))), lambda h: h["name"].isNotNull())
    ends = F.concat(F.slice(F.transform(heads, lambda h: h.at), 2, F.greatest(F.size(heads), F.lit(1))), F.array(F.size(lines)))
    bodies = F.transform(heads, lambda h, i: F.struct(h["name"].alias("name"), F.array_join(F.slice(lines, h.at + 2, F.greatest(F.get(ends, i) - h.at - 1, F.lit(0))), "\n").alias("body")))
    last = F.filter(bodies, lambda b, i: ~F.exists(F.slice(bodies, i + 2, F.greatest(F.size(bodies) - i - 1, F.lit(0))), lambda c: c["name"] == b["name"]))
    pre = F.array_join(F.slice(lines, 1, F.coalesce(F.get(heads, F.lit(0)).at, F.size(lines))), "\n")
    return F.map_from_entries(F.concat(F.array(F.struct(F.lit("_preamble").alias("name"), pre.alias("body"))), last))


def emails(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"({ref.EMAIL_PATTERN})"), F.lit(1)))


def phones(text: Column) -> Column:
    found = F.regexp_extract_all(text, F.lit(f"({ref.PHONE_PATTERN})"), F.lit(1))
    return F.array_distinct(F.transform(F.filter(found, lambda p: F.length(F.regexp_replace(p, r"\D", "")).between(7, 15)), lambda p: F.trim(p)))


def person_name(text: Column) -> Column:
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    ok = lambda x: F.regexp_like(x, F.lit(r"(?U)^[A-Za-z][\w\s'\-.]{1,50}$")) & (F.size(F.split(x, r"\s+")) <= 5) & ~F.regexp_like(x, F.lit(r"@|http|www|\d{5}"))
    return F.get(F.filter(F.slice(lines, 1, 5), ok), F.lit(0))


def profile_url(text: Column, site: str) -> Column:
    """First address of a site; what runs into the next address is cut off, and a scheme is added."""
    url = F.regexp_extract(text, rf"(?i)((?:https?://)?(?:www\.)?{site}[\w\-./]+)", 1)
    glued = F.regexp_extract(text, rf"(?i)((?:https?://)?(?:www\.)?{site}[\w\-./]*?)https?://", 1)
    best = F.when((glued != "") & F.regexp_like(url, F.lit(r"(?i)https?$")), glued).otherwise(url)
    return F.when(best != "", F.when(F.lower(best).startswith("http"), best).otherwise(F.concat(F.lit("https://"), best)))


def place(text: Column) -> Column:
    named = F.trim(F.regexp_extract(text, ref.LOCATION_PATTERN, 1))
    known = F.get(F.filter(F.split(text, "\n"), lambda x: F.regexp_like(x, F.lit(ref.CITY_PATTERN)) & ~F.regexp_like(x, F.lit(ref.NOT_A_PLACE)) & (F.length(F.trim(x)) < 50)), F.lit(0))
    return F.when(F.regexp_like(text, F.lit(ref.LOCATION_PATTERN)), named).otherwise(F.trim(known))


def headline(summary: Column) -> Column:
    return F.substring(F.trim(F.get(F.split(F.trim(summary), r"[.\n]"), F.lit(0))), 1, 300)


def skills(section: Column) -> Column:
    parts = F.transform(F.split(F.trim(section), r"[,•|·\n\t]+"), lambda s: normalize_whitespace(F.regexp_replace(s, r"^[ \-–—•]+|[ \-–—•]+$", "")))
    return F.array_distinct(F.filter(parts, lambda s: F.length(s).between(2, 60)))


def split_entries(text: Column) -> Column:
    """Blocks of a section: a line of under 150 characters with a month or a four-digit number starts a new one."""
    starts = lambda x: F.regexp_like(x, F.lit(rf"(?i)\b({MONTH}|\d{{4}})\b")) & (F.length(F.trim(x)) < 150)
    # Lines and starts are bound: used inside a lambda, they would be computed again for each line and block.
    cuts = lambda lines: F.filter(F.transform(lines, lambda x, i: F.when((i == 0) | starts(x), i)), lambda i: i.isNotNull())
    cut = lambda lines, at: F.transform(at, lambda i, k: F.trim(F.array_join(F.slice(lines, i + 1, F.coalesce(F.get(at, k + 1), F.size(lines)) - i), "\n")))
    blocks = bound(F.split(text, "\n"), lambda lines: bound(cuts(lines), lambda at: cut(lines, at)))
    return F.filter(blocks, lambda b: b != "")


def experience_entry(block: Column) -> Column:
    """Map of title, company, dates and description of a block; null without a title."""

    def fields(lines: Column, head: Column, dates: Column) -> Column:
        at, dash = F.lower(head).contains(" at "), head.contains(" - ") | head.contains(" – ")
        part = lambda p, i: F.trim(F.get(F.split(head, p, 2), F.lit(i)))
        title = F.when(at, part(r"(?i)\s+at\s+", 0)).when(dash, part(r"\s+[-–]\s+", 0)).otherwise(head)
        company = F.when(at, part(r"(?i)\s+at\s+", 1)).when(dash, part(r"\s+[-–]\s+", 1)).otherwise(F.get(lines, F.lit(1)))
        return F.map_from_arrays(F.array(*map(F.lit, ("title", "company", "description", "start_date", "end_date"))), F.array(title, F.coalesce(company, F.lit("")), normalize_whitespace(F.array_join(F.slice(lines, 3, 1 << 20), " ")), F.get(dates, F.lit(0)), F.get(dates, F.lit(1))))

    dates = lambda lines: F.regexp_extract_all(F.array_join(F.slice(lines, 1, 3), "\n"), F.lit(rf"(?i)((?:{MONTH})?\s*\d{{4}}|Present)"), F.lit(1))
    lines = F.filter(F.transform(F.split(block, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    got = bound(lines, lambda x: bound(F.get(x, F.lit(0)), lambda head: bound(dates(x), lambda y: fields(x, head, y))))
    return bound(got, lambda m: F.when(m["title"] != "", F.map_filter(m, lambda k, v: v.isNotNull())))


def education_entry(block: Column) -> Column:
    lines = F.filter(F.transform(F.split(block, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    second = F.get(lines, F.lit(1))
    some = lambda x: F.when(x != "", x)
    gpa = F.coalesce(some(F.regexp_extract(block, ref.GPA_LABEL, 1)), some(F.regexp_extract(block, ref.GPA_SUFFIX, 1))).try_cast("double").cast("string")
    got = F.map_from_arrays(F.array(*map(F.lit, ("institution", "degree", "end_date", "gpa"))), F.array(F.get(lines, F.lit(0)), some(F.regexp_extract(second, ref.DEGREE_PATTERN, 1)), some(F.regexp_extract(second, r"\b(\d{4})\b", 1)), gpa))
    return F.when(F.size(lines) > 0, F.map_filter(got, lambda k, v: v.isNotNull()))


def resume_observations(texts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Observations and status of résumé texts (candidate_key, text); empty text makes the source unavailable."""
    t = texts.select("candidate_key", "text").withColumn("ok", F.coalesce(F.trim(F.regexp_replace("text", r"\s+", " ")) != "", F.lit(False)))
    d = t.where("ok").withColumn("s", sections(F.col("text")))
    get = lambda k: F.coalesce(F.element_at("s", F.lit(k)), F.lit(""))
    contact = F.concat(get("contact"), F.lit("\n"), F.array_join(F.slice(F.split("text", "\n"), 1, 20), "\n"))
    d = d.withColumn("contact", contact)
    # The text is cut once; all its values are one array, so that a pass over the texts gives all rows.
    d = d.select("candidate_key", "text", "contact", *[get(x).alias(x) for x in ("summary", "skills", "experience", "education")])
    c = F.col
    years = years_of_experience(F.concat(c("summary"), F.lit("\n"), F.substring("text", 1, 500)))
    single = lambda field, x, raw=None: F.array(ob.row(field, F.lit(0), x, raw=raw))
    many = lambda field, xs, fix=lambda x: x: F.transform(xs, lambda x, i: ob.row(field, i, fix(x), raw=x))
    nested = lambda field, xs: F.transform(xs, lambda x, i: ob.row(field, i, entry=x))
    links = F.map_filter(F.map_from_arrays(F.array(F.lit("linkedin"), F.lit("github")), F.array(profile_url(c("contact"), r"linkedin\.com/in/"), profile_url(c("contact"), r"github\.com/"))), lambda k, v: v.isNotNull())
    blocks = F.filter(F.transform(F.split(F.trim(c("education")), "\n\n"), lambda b: F.trim(b)), lambda b: b != "")
    values = F.concat(
        single("full_name", person_name(c("text"))), single("location", place(c("contact"))), single("headline", headline(c("summary"))), single("years_experience", years, F.concat(years.cast("string"), F.lit(" years"))),
        many("emails", emails(c("contact")), F.lower), many("phones", phones(c("contact"))), many("skills", skills(c("skills"))),
        nested("experience", F.transform(split_entries(F.trim(c("experience"))), experience_entry)), nested("education", F.transform(blocks, education_entry)),
        F.array(ob.row("links", F.lit(0), entry=F.when(F.size(links) > 0, links))),
    )
    out = ob.exploded(d, "Resume", values)
    return out, ob.status(t, "Resume", F.col("ok"), F.array(F.when(~F.col("ok"), F.lit("no text could be read"))))
