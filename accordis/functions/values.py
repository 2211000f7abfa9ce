"""Normalisers of names, e-mails, phones, dates, places, years and grades; Column to Column or struct."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

from accordis import reference as ref
from accordis.functions.text import bound, normalize_whitespace, to_title_case


def normalize_name(x: Column) -> Column:
    """struct(name, valid): odd characters become spaces, words are capitalised; valid with 2 to 100 characters, no
    digit and at most 7 words."""
    clean = normalize_whitespace(F.regexp_replace(x, r"(?U)[^\w\s'\-.]", " "))
    short = clean.isNull() | (F.length(clean) < 2)
    name = F.when(short, clean).otherwise(to_title_case(clean))
    valid = ~short & F.length(name).between(2, 100) & ~F.regexp_like(name, F.lit(r"\d")) & (F.size(F.split(name, " ")) <= 7)
    return F.struct(name.alias("name"), F.coalesce(valid, F.lit(False)).alias("valid"))


def email_valid(x: Column) -> Column:
    """A usual address: one @, a local part of at most 64 characters without leading, trailing or double dots, and a
    domain of dotted labels."""
    ok = F.regexp_like(x, F.lit(r"^[A-Za-z0-9!#$%&'*+/=?^_`{|}~-]+(\.[A-Za-z0-9!#$%&'*+/=?^_`{|}~-]+)*@([A-Za-z0-9]([A-Za-z0-9-]{0,61}[A-Za-z0-9])?\.)+[A-Za-z][A-Za-z0-9-]*[A-Za-z0-9]$"))
    return F.coalesce(ok & (F.instr(x, "@") <= 65) & (F.length(x) <= 254), F.lit(False))


def normalize_email(x: Column, fixes: list[tuple[str, str]] | None = None) -> Column:
    """struct(email, valid, confidence): recognition errors mended by rules, valid ones lower-cased; invalid ones are
    kept with little confidence."""
    clean = F.trim(x)
    for pattern, new in ref.EMAIL_FIXES if fixes is None else fixes:
        clean = F.regexp_replace(clean, pattern, new)
    ok = email_valid(clean)
    blank = x.isNull() | (F.trim(x) == "")
    return F.struct(F.when(blank, x).when(ok, F.lower(clean)).otherwise(clean).alias("email"), (ok & ~blank).alias("valid"), F.when(ok & ~blank, F.lit(1.0)).otherwise(ref.INVALID_CONFIDENCE).alias("confidence"))


def normalize_phone(x: Column, region: Column | None = None) -> Column:
    """struct(phone, confidence): E.164 for numbers of the known regions, with their code or in the hinted region
    (default US); others stay as they are with little confidence."""
    hint = F.coalesce(region, F.lit("US")) if region is not None else F.lit("US")
    t, digits = F.trim(x), F.regexp_replace(x, r"\D", "")
    bare = F.when(t.startswith("00"), F.substring(digits, 3, 100)).otherwise(digits)
    # The regions are one constant array that a lambda searches, so that the expression stays small.
    regions = F.array(*[F.struct(*map(F.lit, (n, *v))) for n, v in ref.PHONE_REGIONS.items()])
    fits = lambda national, r: F.length(national).between(r["col3"], r["col4"]) & F.regexp_like(national, F.concat(F.lit("^"), r["col5"]))

    def national(r: Column) -> Column:
        coded = (F.length(digits) == F.length(r["col2"]) + r["col4"]) & digits.startswith(r["col2"])
        return F.when(coded, F.substr(digits, F.length(r["col2"]) + 1)).when(r["col1"] == "IT", digits).otherwise(F.regexp_replace(digits, "^0", ""))

    abroad = F.exists(regions, lambda r: bare.startswith(r["col2"]) & fits(F.substr(bare, F.length(r["col2"]) + 1), r))
    home = F.get(F.transform(F.filter(regions, lambda r: (r["col1"] == hint) & fits(national(r), r)), lambda r: F.concat(F.lit("+"), r["col2"], national(r))), F.lit(0))
    found = F.when(F.regexp_like(x, F.lit(r"[^0-9\s()+./\-]")), F.lit(None)).when(F.regexp_like(t, F.lit(r"^(\+|00)")), F.when(abroad, F.concat(F.lit("+"), bare))).otherwise(home)
    return F.struct(F.coalesce(found, x).alias("phone"), F.when(found.isNotNull(), F.lit(1.0)).otherwise(ref.INVALID_CONFIDENCE).alias("confidence"))


#: Shapes of dates, as year|month of what their groups hold. No two fit the same text.
_SHAPES = [
    (r"(\d{4})[-/](\d{1,2})", 1, 2), (r"(\d{1,2})[-/](\d{4})", 2, 1), (r"(\d{4})-(\d{2})-\d{2}", 1, 2), (r"(\d{4})()", 1, 2),
    (r"(?:\d{1,2}(?:st|nd|rd|th)?\s+)?([A-Za-z]{3,9})[.,]?\s+(?:\d{1,2}(?:st|nd|rd|th)?,?\s+)?(\d{4})", 2, 1), (r"(\d{4}),?\s+([A-Za-z]{3,9})", 1, 2),
    (r"(\d{1,2})/(?:[1-9]|0[1-9]|[12]\d|3[01])/(\d{4})", 2, 1), (r"(\d{4})[/.](\d{1,2})[/.](?:[1-9]|0[1-9]|[12]\d|3[01])", 1, 2), (r"([A-Za-z]{3,9})[-/](\d{4})", 2, 1),
]
_DATE = "^(?:" + "|".join(p for p, _, _ in _SHAPES) + ")$"
_YEAR_MONTH = "".join(f"${2 * i + y}" for i, (_, y, _) in enumerate(_SHAPES)) + "|" + "".join(f"${2 * i + m}" for i, (_, _, m) in enumerate(_SHAPES))
_AGO = r"(?i)^(?:(\d{1,3})|an?)\s+(day|week|month|year)s?\s+ago$"


def normalize_date(x: Column, today: Column | None = None) -> Column:
    """struct(date, valid): YYYY-MM or Present; a date that is not understood stays as it is.

    All shapes are alternatives of one pattern, which one pass rewrites as year|month. "3 months ago", "yesterday" and
    the like count from `today` (default: the current date)."""
    # Months by a constant map: parsing by formats, and casts of what is no number, cost an exception for each that fails.
    months = {k: f"{i + 1:02d}" for i, n in enumerate(ref.MONTHS) for k in (n[:3].lower(), n.lower(), str(i + 1), f"{i + 1:02d}")} | {"sept": "09", "": "01"}
    now = F.current_date() if today is None else today
    shown = lambda d: F.date_format(d, "yyyy-MM")

    def ago(t: Column) -> Column:
        n = F.coalesce(F.regexp_extract(t, _AGO, 1).try_cast("int"), F.lit(1))
        unit = F.lower(F.regexp_extract(t, _AGO, 2))
        return shown(F.when(unit == "day", F.date_sub(now, n)).when(unit == "week", F.date_sub(now, n * 7)).when(unit == "month", F.add_months(now, -n)).otherwise(F.add_months(now, -12 * n)))

    def found(t: Column, r: Column) -> Column:
        year, month = F.substring_index(r, "|", 1), F.element_at(_table(months), F.lower(F.substring_index(r, "|", -1)))
        dated = F.when(year.between("1900", "2100"), F.concat(year, F.lit("-"), month))
        low = F.lower(t)
        return F.when(r.contains("|") & ~t.contains("|"), dated).when(low.isin(ref.PRESENT), F.lit("Present")).when(low == "yesterday", shown(F.date_sub(now, 1))).when(F.regexp_like(t, F.lit(_AGO)), ago(t))

    def whole(x: Column) -> Column:
        date = bound(F.trim(x), lambda t: bound(F.regexp_replace(t, _DATE, _YEAR_MONTH), lambda r: found(t, r)))
        return bound(date, lambda d: F.struct(F.coalesce(d, x).alias("date"), d.isNotNull().alias("valid")))

    return bound(x, whole)


def _table(d: dict[str, str]) -> Column:
    """A constant map: one literal in the plan, folded once."""
    return F.from_json(F.lit(json.dumps(d)), "map<string,string>")


def resolve_country(x: Column) -> Column:
    """Two-letter code of a country's code (of two or three letters) or English name, else null. Codes of two letters go
    first: "CA" is Canada; then the usual names, then all others."""
    codes = {c.lower(): c for c in ref.ALPHA2.split()}
    every = _table(ref.country_table() | ref.COUNTRIES | codes)
    return F.element_at(every, F.lower(F.trim(x)))


def normalize_location(x: Column) -> Column:
    """struct(city, state, country, raw) of "city, state, country"; the last part that is a country is one. A JSON object,
    or a Python dict's printed form, gives its city, state and country."""

    def parsed(t: Column) -> Column:
        parts = F.filter(F.transform(F.split(t, ","), lambda p: F.trim(p)), lambda p: p != "")
        return bound(F.transform(parts, lambda p: F.struct(p.alias("p"), resolve_country(p).alias("c"))), lambda ps: bound(F.size(ps), lambda n: split(t, ps, n)))

    def split(t: Column, ps: Column, n: Column) -> Column:
        last = F.get(ps, n - 1)["c"]
        rest = F.when(last.isNotNull(), F.slice(ps, 1, F.greatest(n - 1, F.lit(0)))).otherwise(ps)
        inner = F.get(F.filter(ps, lambda p: p["c"].isNotNull()), F.lit(0))["c"]
        return F.struct(F.get(rest, F.lit(0))["p"].alias("city"), F.when(F.size(rest) > 1, F.get(rest, F.lit(1))["p"]).alias("state"), F.coalesce(last, inner).alias("country"), t.alias("raw"))

    def item(t: Column, key: str) -> Column:
        v = F.trim(F.regexp_extract(t, rf"""["']{key}["']\s*:\s*(?:"([^"]*)"|'([^']*)')""", 1))
        w = F.trim(F.regexp_extract(t, rf"""["']{key}["']\s*:\s*(?:"([^"]*)"|'([^']*)')""", 2))
        return F.coalesce(F.when(v != "", v), F.when(w != "", w))

    def of_object(t: Column) -> Column:
        return location_of_struct(item(t, "city"), item(t, "state"), item(t, "country"))

    kind = "struct<city:string,state:string,country:string,raw:string>"
    blank = x.isNull() | (F.trim(x) == "")
    return F.when(blank, F.from_json(F.lit("{}"), kind)).when(F.regexp_like(x, F.lit(r"^\s*\{.*\}\s*$")), of_object(x).cast(kind)).otherwise(parsed(x).cast(kind))


def location_of_struct(city: Column, state: Column, country: Column) -> Column:
    return F.struct(city.alias("city"), state.alias("state"), resolve_country(country).alias("country"), F.array_join(F.array(city, state, country), ", ").alias("raw"))


def years_number(x: Column) -> Column:
    """Years as a number with one decimal; what is no number counts as 0."""
    return F.bround(F.coalesce(x.try_cast("double"), F.lit(0.0)), 1)


def gpa_number(x: Column) -> Column:
    return F.coalesce(x.try_cast("double"), F.regexp_extract(x, r"(\d+(?:\.\d+)?)", 1).try_cast("double"))


def github_username(url: Column) -> Column:
    """Account of a profile address (at most 39 characters), else null."""
    name = F.regexp_extract(F.trim(url), r"(?i)^(?:https?://)?(?:www\.)?github\.com/([A-Za-z0-9_-]+)", 1)
    return F.when((name != "") & (F.length(name) <= 39) & ~F.lower(name).contains("http"), name)


# Validators: struct(ok, reason); they never fail.
def _verdict(ok: Column, reason: str) -> Column:
    ok = F.coalesce(ok, F.lit(False))
    return F.struct(ok.alias("ok"), F.when(ok, F.lit("")).otherwise(F.lit(reason)).alias("reason"))


def validate_email(x: Column) -> Column:
    return _verdict(email_valid(F.trim(x)), "not an e-mail address")


def validate_phone(x: Column, region: Column | None = None) -> Column:
    return _verdict(normalize_phone(x, region)["confidence"] == 1.0, "not a phone number of the region")


def validate_date(x: Column) -> Column:
    t = F.trim(x)
    ok = F.lower(t).isin("present", "current", "now") | (F.regexp_like(t, F.lit(r"^\d{4}-\d{2}$")) & F.substring(t, 1, 4).try_cast("int").between(1900, 2100) & F.substring(t, 6, 2).try_cast("int").between(1, 12))
    return _verdict(ok, "neither YYYY-MM nor Present")


def validate_country(x: Column) -> Column:
    return _verdict(x.isin(ref.ALPHA2.split()), "not a two-letter country code")


def validate_url(x: Column) -> Column:
    t = F.trim(x)
    return _verdict(F.regexp_like(t, F.lit(r"^(?i)https?://[^/?#\s]+")), "no http address")


def validate_github_url(x: Column) -> Column:
    return _verdict(F.regexp_like(F.regexp_replace(F.trim(x), "/+$", ""), F.lit(r"^(?i)https?://(www\.)?github\.com/[A-Za-z0-9_-]+$")), "not a profile address")


def validate_experience(entry: Column) -> Column:
    """entry: map of strings."""
    has = lambda k: F.length(F.trim(F.coalesce(entry[k], F.lit("")))) > 0
    return _verdict(has("company") | has("title"), "neither company nor title")


def validate_education(entry: Column) -> Column:
    return _verdict(F.length(F.trim(F.coalesce(entry["institution"], F.lit("")))) > 0, "no institution")
