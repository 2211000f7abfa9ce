"""Queries that apply the operators to whole tables of a scale-factor folder, and the SQL that gives the same rows.

Three sources that describe a customer are derived from the customer table by expressions that both dialects know.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from accordis import reference as ref
from accordis.functions import similarity as sim
from accordis.functions import text as tx
from accordis.functions import values as v
from accordis.operators import entries, merge, skills
from accordis.plans import pipeline, project, report
from accordis.sources import ats, files, github, resume
from accordis.sources import observed as ob
from accordis.storage import shared_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE_SQL[fn.__name__] = sql
        return fn

    return add


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


# --- Derived observations ---------------------------------------------------------------------------------------------
_SEG = {
    "ATS": ("c_custkey % 5 <> 0", "c_mktsegment"),
    "Resume": ("c_custkey % 3 <> 0", "case when c_custkey % 7 in (0, 1) then 'OTHER' else lower(c_mktsegment) end"),
    "GitHub": ("c_custkey % 4 <> 0", "case when c_custkey % 7 in (0, 2) then 'OTHER' else concat(' ', c_mktsegment, ' ') end"),
}
_MAIL = {
    "ATS": ("c_custkey % 5 <> 0", "lower(concat(replace(c_name, '#', '.'), '@example.com'))"),
    "Resume": ("c_custkey % 3 <> 0", "concat(replace(c_name, '#', '.'), '@Example.com')"),
    "GitHub": ("c_custkey % 4 <> 0", "case when c_custkey % 7 = 0 then concat('alt', cast(c_custkey as varchar(20)), '@example.com') else upper(concat(replace(c_name, '#', '.'), '@example.com')) end"),
}
_NAME = {"ATS": ("c_custkey % 2 = 0", "c_name"), "Resume": ("c_custkey % 3 = 0", "c_name")}


def _obs_sql(parts: dict[str, tuple[str, str]], field: str) -> str:
    return " union all ".join(f"select c_custkey as k, '{field}' as field, '{s}' as s, {ref.BIT[s]} as bit, {ref.PRIORITY[s]} as pr, {expr} as v from customer where {cond}" for s, (cond, expr) in parts.items())


SEGMENTS = f"obs as ({_obs_sql(_SEG, 'headline')})"
SCORE = "cast(case mask " + " ".join(f"when {m} then {x}" for m, x in ref.AGREEMENT.items()) + " else 0 end as double)"
NAMES = "concat_ws(', ', case when mask & 4 > 0 then 'ATS' end, case when mask & 1 > 0 then 'GitHub' end, case when mask & 2 > 0 then 'Resume' end)"
WON = f"""{SEGMENTS}, g as (select k, lower(trim(v)) as gk, cast(sum(distinct bit) as integer) as mask, arg_max(trim(v), pr) as val, max(pr) as pr from obs group by k, lower(trim(v))),
s as (select *, {SCORE} as score from g), w as (select * from (select *, row_number() over (partition by k order by score desc, pr desc) as rn from s) where rn = 1)"""


def _observed(spark: SparkSession, d: str, parts: dict[str, tuple[str, str]], field: str) -> DataFrame:
    """One pass over the table: a row a customer and source."""
    c = _t(spark, d, "customer").withColumn("candidate_key", F.col("c_custkey").cast("string"))
    items = [F.when(F.expr(cond), F.struct(F.lit(s).alias("source"), F.expr(expr.replace("varchar(20)", "string")).alias("value"), F.lit(ref.BASE_CONFIDENCE[s]).alias("confidence"), F.lit(ref.METHODS[s]).alias("method"))) for s, (cond, expr) in parts.items()]
    x = c.select("candidate_key", F.explode(F.array(*items)).alias("x")).where("x is not null").select("candidate_key", "x.*")
    return x.select("candidate_key", F.lit(field).alias("field"), "source", F.lit(0).alias("item_ord"), "value", F.lit(None).cast("map<string,string>").alias("entry"), F.col("value").alias("raw"), "confidence", "method")


def _segments(spark: SparkSession, d: str) -> DataFrame:
    return _observed(spark, d, _SEG, "headline")


def _key():
    return F.col("candidate_key").cast("long").alias("c_custkey")


# --- Votes and confidence ---------------------------------------------------------------------------------------------
@query(f"with {WON} select k as c_custkey, val as value, mask, score from w")
def vote_scalar(spark: SparkSession, d: str) -> DataFrame:
    return merge.vote(_segments(spark, d), F.trim).select(_key(), "value", "mask", "score")


@query(f"with {SEGMENTS}, g as (select k, cast(sum(bit) as integer) as mask from obs group by k) select k as c_custkey, mask, {SCORE} as score, {NAMES} as sources from g")
def agreement_score(spark: SparkSession, d: str) -> DataFrame:
    return merge.agreement_scores(_segments(spark, d), ["candidate_key"]).select(_key(), "mask", "score", F.array_join("sources", ", ").alias("sources"))


_PRESENCE = f"obs as ({_obs_sql(_SEG, 'headline')} union all {_obs_sql(_NAME, 'full_name')}), p as (select k, field, cast(sum(bit) as integer) as mask from obs group by k, field), ps as (select k, field, mask, {SCORE} as score from p)"


@query(f"with {_PRESENCE} select k as c_custkey, field, score, {NAMES} as sources from ps")
def presence_confidence(spark: SparkSession, d: str) -> DataFrame:
    o = _segments(spark, d).unionByName(_observed(spark, d, _NAME, "full_name"))
    return merge.presence_confidence(o).select(_key(), "field", "score", F.array_join("sources", ", ").alias("sources"))


@query(f"with {_PRESENCE} select k as c_custkey, round(avg(score), 4) as overall_confidence from ps group by k")
def overall_confidence(spark: SparkSession, d: str) -> DataFrame:
    o = _segments(spark, d).unionByName(_observed(spark, d, _NAME, "full_name"))
    return merge.overall_confidence(merge.presence_confidence(o)).select(_key(), "overall_confidence")


# --- Lists, links, skills ---------------------------------------------------------------------------------------------
_DEDUP = f"""obs as ({_obs_sql(_MAIL, 'emails')}), r as (select *, row_number() over (partition by k, lower(v) order by pr desc) as rn from obs),
n as (select *, sum(case when rn = 1 then 1 else 0 end) over (partition by k order by pr desc) as place from r)"""


@query(f"""with {_DEDUP} select k as c_custkey, v as value, s as source, rn = 1 as kept, cast(case when rn = 1 then place end as bigint) as place,
case when rn = 1 then 'Selected' else 'Rejected — duplicate of value from higher-priority source' end as notes from n""")
def dedup_priority(spark: SparkSession, d: str) -> DataFrame:
    return merge.dedup_by_priority(_observed(spark, d, _MAIL, "emails")).select(_key(), "value", "source", "kept", F.col("position").cast("long").alias("place"), "notes")


@query(f"with {_DEDUP} select k as c_custkey, string_agg(v, ' ' order by pr desc) as \"values\" from n where rn = 1 group by k")
def string_list(spark: SparkSession, d: str) -> DataFrame:
    return merge.string_lists(_observed(spark, d, _MAIL, "emails")).select(_key(), F.array_join("values", " ").alias("values"))


@query(f"with {_DEDUP} select k as c_custkey, count(*) as total, sum(case when rn = 1 then 1 else 0 end)::bigint as distinct_values, round(sum(case s when 'ATS' then 0.95 when 'Resume' then 0.85 else 0.8 end::double) / sum(case when rn = 1 then 1 else 0 end), 4) as avg_confidence from n group by k")
def list_log(spark: SparkSession, d: str) -> DataFrame:
    return merge.list_log(merge.dedup_by_priority(_observed(spark, d, _MAIL, "emails"))).select(_key(), "total", "distinct_values", "avg_confidence")


@query("""select c_custkey, case when c_custkey % 2 = 0 then 'https://github.com/a' || c_custkey when c_custkey % 3 = 0 then 'https://github.com/r' || c_custkey when c_custkey % 5 = 0 then 'https://github.com/g' || c_custkey end as github,
case when c_custkey % 3 = 0 then 'https://linkedin.com/in/r' || c_custkey end as linkedin, case when c_custkey % 5 = 0 then 'b' || c_custkey || '.io' end as portfolio from customer where c_custkey % 2 = 0 or c_custkey % 3 = 0 or c_custkey % 5 = 0""")
def links_coalesce(spark: SparkSession, d: str) -> DataFrame:
    c = _t(spark, d, "customer").withColumn("candidate_key", F.col("c_custkey").cast("string"))
    url = lambda p, end="": F.concat(F.lit(p), F.col("candidate_key"), F.lit(end))
    per = {"ATS": (2, {"github": url("https://github.com/a", "/")}), "Resume": (3, {"github": url("https://github.com/r"), "linkedin": url("https://linkedin.com/in/r")}), "GitHub": (5, {"github": url("https://github.com/g"), "portfolio": url("b", ".io")})}
    items = [F.when(F.col("c_custkey") % m == 0, F.struct(F.lit(s).alias("source"), F.create_map(*[y for k, x in links.items() for y in (F.lit(k), x)]).alias("entry"))) for s, (m, links) in per.items()]
    o = c.select("candidate_key", F.explode(F.array(*items)).alias("x")).where("x is not null").select("candidate_key", "x.*")
    return merge.merge_links(o).select(_key(), "github", "linkedin", "portfolio")


_EVENT_SOURCE = "case event_id % 3 when 0 then 'ATS' when 1 then 'Resume' else 'GitHub' end"


@query(f"""with e as (select user_id, event_type, cast(bit_or(case event_id % 3 when 0 then 4 when 1 then 2 else 1 end) as integer) as mask from events group by user_id, event_type)
select user_id, event_type as name, {SCORE} as confidence, concat_ws(',', case when mask & 4 > 0 then 'ATS' end, case when mask & 2 > 0 then 'Resume' end, case when mask & 1 > 0 then 'GitHub' end) as sources from e""")
def skills_merge(spark: SparkSession, d: str) -> DataFrame:
    e = _t(spark, d, "events").select(F.col("user_id").cast("string").alias("candidate_key"), F.expr(_EVENT_SOURCE).alias("source"), F.lit(0).alias("item_ord"), F.col("event_type").alias("value"), F.col("event_type").alias("canonical"))
    return merge.merge_skills(e).select(F.col("candidate_key").cast("long").alias("user_id"), "name", "confidence", F.array_join("sources", ",").alias("sources"))


WORDS = {"Small": ["small", "tiny"], "Widget": ["widget"], "Cold": ["cold", "icy"], "Hot": ["hot"], "Red": ["red"], "Large": ["large", "big"]}


def _words(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "part").select("p_partkey", F.explode(F.split("p_name", " ")).alias("value"))


_WORD_TABLE = ", ".join(f"('{a}', '{c}')" for c, names in WORDS.items() for a in dict.fromkeys([*names, c.lower()]))


@query(f"with a(alias, canonical) as (values {_WORD_TABLE}), w as (select p_partkey, unnest(string_split(p_name, ' ')) as value from part) select p_partkey, value, canonical from w left join a on lower(value) = alias")
def skill_exact_alias(spark: SparkSession, d: str) -> DataFrame:
    return skills.exact(_words(spark, d), skills.alias_table(spark, WORDS)).select("p_partkey", "value", "canonical")


@query(f"with a(alias, canonical) as (values {_WORD_TABLE}), w as (select distinct unnest(string_split(p_name, ' ')) as value from part) select value from w where not exists (select 1 from a where alias = lower(value))")
def unmatched_skill_anti(spark: SparkSession, d: str) -> DataFrame:
    table = skills.alias_table(spark, WORDS)
    return _words(spark, d).select("value").distinct().join(F.broadcast(table.select("alias")), F.lower("value") == F.col("alias"), "left_anti")


#: A letter too many still finds the alias of three letters or more (ratio 200 n / (2 n + 1)).
@query(f"with a(alias, canonical) as (values {_WORD_TABLE}), w as (select unnest(string_split(p_name, ' ')) as word from part) select word || 't' as value, coalesce(canonical, word || 't') as canonical, case when canonical is null then 'passthrough' else 'fuzzy' end as match, count(*) as n from w left join a on word = alias group by all")
def skill_fuzzy(spark: SparkSession, d: str) -> DataFrame:
    return skills.normalize(_words(spark, d).withColumn("value", F.expr("concat(value, 't')")), WORDS).groupBy("value", "canonical", "match").agg(F.count("*").alias("n"))


@query("""with c as (select user_id, event_type, count(*) as n from events group by user_id, event_type)
select user_id, event_type, n as n_repos, cast(row_number() over (partition by user_id order by n desc, event_type) as integer) as rank from c""")
def language_rank(spark: SparkSession, d: str) -> DataFrame:
    return github.rank_languages(_t(spark, d, "events"), "user_id", "event_type")


# --- Extraction -------------------------------------------------------------------------------------------------------
@query("select event_id, json_extract_string(props, '$.k') as value from events where json_extract_string(props, '$.k') is not null")
def alias_resolve(spark: SparkSession, d: str) -> DataFrame:
    docs = _t(spark, d, "events").select(F.col("event_id").cast("string").alias("candidate_key"), F.col("props").alias("doc"))
    return ats.resolve_aliases(docs, {"amount": ["value", "k", "v"], "other": ["x"]}).select(F.col("candidate_key").cast("long").alias("event_id"), "value")


@query("with x as (select p_partkey, unnest(string_split(replace(p_name, ' ', ' , '), ',')) as item, generate_subscripts(string_split(replace(p_name, ' ', ' , '), ','), 1) - 1 as pos from part) select p_partkey, cast(pos as integer) as pos, trim(item) as item from x")
def list_explode(spark: SparkSession, d: str) -> DataFrame:
    p = _t(spark, d, "part")
    return p.select("p_partkey", F.posexplode(ats.as_list(F.replace("p_name", F.lit(" "), F.lit(" , ")), F.lit("string"))).alias("pos", "item"))


@query(f"select doc_id, len(list_distinct(regexp_extract_all(text, '{ref.EMAIL_PATTERN}'))) as n_emails, coalesce(lower(regexp_extract(text, '{ref.EMAIL_PATTERN}')), '') as first_email from documents")
def email_extract(spark: SparkSession, d: str) -> DataFrame:
    e = resume.emails(F.col("text"))
    return _t(spark, d, "documents").select("doc_id", F.size(e).cast("long").alias("n_emails"), F.coalesce(F.lower(F.get(e, F.lit(0))), F.lit("")).alias("first_email"))


@query(f"""with x as (select doc_id, list_filter(regexp_extract_all(coalesce(text, ''), '{ref.PHONE_PATTERN}'), lambda p: length(regexp_replace(p, '[^0-9]', '', 'g')) between 7 and 15) as l from documents),
y as (select doc_id, list_sort(list_distinct(list_transform(l, lambda p: trim(p)))) as l from x) select doc_id, cast(len(l) as bigint) as n_phones, md5(array_to_string(l, ';')) as phones from y""")
def phone_extract(spark: SparkSession, d: str) -> DataFrame:
    found = resume.phones(F.coalesce("text", F.lit("")))
    return _t(spark, d, "documents").select("doc_id", F.size(found).cast("long").alias("n_phones"), F.md5(F.array_join(F.array_sort(found), ";").cast("binary")).alias("phones"))


@query("select p_partkey, cast(p_size as double) as years from part")
def years_extract(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat(F.col("p_name"), F.lit(" maker with 1-"), F.col("p_size"), F.lit(" years of work"))
    return _t(spark, d, "part").select("p_partkey", tx.years_of_experience(text).alias("years"))


@query("select p_partkey, 'pre' as pre, p_name || ' new' as skills, p_brand || chr(10) || 'Other' as education from part")
def section_split(spark: SparkSession, d: str) -> DataFrame:
    p = _t(spark, d, "part")
    text = F.concat(F.lit("pre\nSkills\nold\nEducation:\n"), F.col("p_brand"), F.lit("\nOther\nTechnical Skills\n"), F.col("p_name"), F.lit(" new"))
    s = p.select("p_partkey", resume.sections(text).alias("s"))
    return s.select("p_partkey", F.element_at("s", F.lit("_preamble")).alias("pre"), F.element_at("s", F.lit("skills")).alias("skills"), F.element_at("s", F.lit("education")).alias("education"))


@query("select p_partkey, cast(3 as bigint) as n_entries, p_name as title, p_brand as company, '2019' as start_date, 'Present' as end_date from part")
def entry_split(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat(F.col("p_name"), F.lit(" at "), F.col("p_brand"), F.lit("\nsmall\n2019 - Present line\nmore words\nJan note\nend"))
    entry = lambda b: resume.experience_entry(F.concat(F.get(b, F.lit(0)), F.lit("\n"), F.get(b, F.lit(1))))
    row = lambda b, e: F.struct(F.size(b).cast("long").alias("n_entries"), e["title"].alias("title"), e["company"].alias("company"), F.regexp_replace(e["start_date"], r"\s", "").alias("start_date"), e["end_date"].alias("end_date"))
    x = tx.bound(resume.split_entries(text), lambda b: tx.bound(entry(b), lambda e: row(b, e)))
    return _t(spark, d, "part").select("p_partkey", F.explode(F.array(x)).alias("x")).select("p_partkey", "x.*")


@query("select p_partkey, case when p_name = p_type then p_name else p_name || ';' || p_type end || ';' || p_brand as skills from part")
def skill_tokenize(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat(F.lit("- "), F.col("p_name"), F.lit(" • "), F.col("p_type"), F.lit("|x,\n"), F.col("p_brand"), F.lit(", "), F.col("p_brand"))
    return _t(spark, d, "part").select("p_partkey", F.array_join(resume.skills(text), ";").alias("skills"))


@query(r"select doc_id, substr(trim(regexp_split_to_array(trim(text), '[.\n]')[1]), 1, 300) as headline from documents")
def headline_first_sentence(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "documents").select("doc_id", resume.headline(F.col("text")).alias("headline"))


@query()
def resume_fields(spark: SparkSession, d: str) -> DataFrame:
    """All rules of résumé texts over whole documents."""
    obs, _ = resume.resume_observations(_t(spark, d, "documents").select(F.col("doc_id").cast("string").alias("candidate_key"), "text"))
    return obs.groupBy("field").agg(F.count("*").alias("n"), F.count_distinct("candidate_key").alias("candidates"))


# --- Normalisers ------------------------------------------------------------------------------------------------------
@query(r"select doc_id, md5(trim(regexp_replace(text, '\s+', ' ', 'g'))) as digest from documents")
def normalize_ws(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "documents").select("doc_id", F.md5(tx.normalize_whitespace(F.col("text")).cast("binary")).alias("digest"))


@query("select s_suppkey, array_to_string(list_transform(string_split('mc' || s_name || ' of' || '  ' || 'NEW york', ' '), lambda w: case when regexp_matches(w, '[a-z]') and regexp_matches(substr(w, 2), '[A-Z]') then w else upper(substr(w, 1, 1)) || lower(substr(w, 2)) end), ' ').replace('  ', ' ') as title from supplier")
def title_case(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "supplier").select("s_suppkey", tx.to_title_case(F.concat(F.lit("mc"), F.col("s_name"), F.lit(" of  NEW york"))).alias("title"))


@query("select p_partkey, replace(lower(p_name), ' ', '-') || '-' || replace(lower(p_brand), '#', '') as slug from part")
def slugify(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "part").select("p_partkey", tx.slugify(F.concat(F.col("p_name"), F.lit("_ "), F.col("p_brand"), F.lit("!"))).alias("slug"))


@query("select page_id, rtrim(trim(url), '/') as url from pages")
def clean_url(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "pages").select("page_id", tx.clean_url(F.concat(F.lit(" "), F.col("url"), F.lit("//"))).alias("url"))


@query("""select c_custkey, case c_custkey % 4 when 0 then lower(replace(c_name, '#', '.')) || '@example.com' when 1 then replace(c_name, '#', '..') || '@example.com' when 2 then 'a' || c_custkey || '@gmail.com' else c_name end as email,
c_custkey % 4 in (0, 2) as valid, case when c_custkey % 4 in (0, 2) then 1.0 else 0.2 end::double as confidence from customer""")
def email_normalize(spark: SparkSession, d: str) -> DataFrame:
    raw = F.expr("case c_custkey % 4 when 0 then concat(' ', replace(c_name, '#', '.'), '@Example.ccom') when 1 then concat(replace(c_name, '#', '..'), '@example.com') when 2 then concat('A', c_custkey, '@gmaiil.con') else c_name end")
    return _t(spark, d, "customer").select("c_custkey", v.normalize_email(raw).alias("e")).select("c_custkey", "e.email", "e.valid", "e.confidence")


_NUM = "lpad(cast(c_custkey as varchar), 6, '0')"


@query(f"""select c_custkey, case c_custkey % 4 when 0 then '+12155' || {_NUM} when 1 then '+919876' || {_NUM} when 2 then '+4420' || {_NUM} || '12' else 'call ' || {_NUM} end as phone,
case when c_custkey % 4 < 3 then 1.0 else 0.2 end::double as confidence from customer""")
def phone_normalize(spark: SparkSession, d: str) -> DataFrame:
    n = "lpad(cast(c_custkey as string), 6, '0')"
    raw = F.expr(f"case c_custkey % 4 when 0 then concat('(215) 5', substr({n}, 1, 2), '-', substr({n}, 3)) when 1 then concat('9876', {n}) when 2 then concat('+44 20 ', {n}, ' 12') else concat('call ', {n}) end")
    region = F.when(F.col("c_custkey") % 4 == 1, "IN")
    return _t(spark, d, "customer").select("c_custkey", v.normalize_phone(raw, region).alias("p")).select("c_custkey", "p.phone", "p.confidence")


_DATES = ["yyyy-MM", "M/yyyy", "MMM yyyy", "MMMM yyyy", "yyyy-MM-dd", "d MMM yyyy"]


@query("select o_orderkey, case o_orderkey % 8 when 6 then 'Present' when 7 then 'soon' else strftime(o_orderdate, '%Y-%m') end as date, o_orderkey % 8 <> 7 as valid from orders")
def date_normalize(spark: SparkSession, d: str) -> DataFrame:
    raw = F
    for i, f in enumerate(_DATES):
        raw = raw.when(F.col("o_orderkey") % 8 == i, F.date_format("o_orderdate", f))
    raw = raw.when(F.col("o_orderkey") % 8 == 6, F.lit(" current ")).otherwise(F.lit("soon"))
    return _t(spark, d, "orders").select("o_orderkey", v.normalize_date(raw).alias("x")).select("o_orderkey", "x.date", "x.valid")


_COUNTRY = [k for k in ref.COUNTRIES][:25]
_PLACE = "case c_nationkey " + " ".join(f"when {i} then '{c}'" for i, c in enumerate(_COUNTRY)) + " else 'nowhere' end"
_CODE = "case c_nationkey " + " ".join(f"when {i} then '{ref.COUNTRIES[c]}'" for i, c in enumerate(_COUNTRY)) + " end"


@query(f"select c_custkey, c_name as city, case when c_custkey % 2 = 0 then 'ST' when c_nationkey >= {len(_COUNTRY)} then 'nowhere' end as state, {_CODE} as country from customer")
def location_parse(spark: SparkSession, d: str) -> DataFrame:
    raw = F.expr(f"concat(c_name, case when c_custkey % 2 = 0 then ', ST, ' else ' ,' end, {_PLACE})")
    return _t(spark, d, "customer").select("c_custkey", v.normalize_location(raw).alias("l")).select("c_custkey", "l.city", "l.state", "l.country")


@query(f"select c_custkey, case c_custkey % 3 when 0 then {_CODE} when 1 then 'CA' end as country from customer")
def country_resolve(spark: SparkSession, d: str) -> DataFrame:
    raw = F.expr(f"case c_custkey % 3 when 0 then upper({_PLACE}) when 1 then 'ca' else 'zz' end")
    return _t(spark, d, "customer").select("c_custkey", v.resolve_country(raw).alias("country"))


@query("select c_custkey, case when c_custkey % 2 = 0 then 'Customer ' || substr(c_name, 10) else upper(substr(c_mktsegment, 1, 1)) || lower(substr(c_mktsegment, 2)) || ' O''Neil' end as name, c_custkey % 2 <> 0 as valid from customer")
def name_normalize(spark: SparkSession, d: str) -> DataFrame:
    raw = F.expr("case when c_custkey % 2 = 0 then c_name else concat('  ', c_mktsegment, '   O\\'Neil* ') end")
    return _t(spark, d, "customer").select("c_custkey", v.normalize_name(raw).alias("n")).select("c_custkey", "n.name", "n.valid")


# --- Validators -------------------------------------------------------------------------------------------------------
@query("select c_custkey, c_custkey % 2 = 0 as ok, case when c_custkey % 2 = 0 then '' else 'not an e-mail address' end as reason from customer")
def validate_email(spark: SparkSession, d: str) -> DataFrame:
    raw = F.expr("concat(replace(c_name, '#', '.'), if(c_custkey % 2 = 0, '@example.com', '@example'))")
    return _t(spark, d, "customer").select("c_custkey", v.validate_email(raw).alias("x")).select("c_custkey", "x.ok", "x.reason")


@query("select page_id, regexp_matches(url, '^(?i)https?://[^/?#\\s]+') as ok from pages")
def validate_url(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "pages").select("page_id", v.validate_url(F.col("url"))["ok"].alias("ok"))


@query("select c_custkey, c_custkey % 3 < 2 as ok from customer")
def validate_github_url(spark: SparkSession, d: str) -> DataFrame:
    raw = F.expr("concat('https://', if(c_custkey % 3 = 0, 'www.', ''), 'github.com/u', c_custkey, if(c_custkey % 3 = 2, '/repo', '/'))")
    return _t(spark, d, "customer").select("c_custkey", v.validate_github_url(raw)["ok"].alias("ok"))


@query("select o_orderkey, o_orderkey % 3 <> 1 as ok from orders")
def validate_date(spark: SparkSession, d: str) -> DataFrame:
    raw = F.when(F.col("o_orderkey") % 3 == 0, F.date_format("o_orderdate", "yyyy-MM")).when(F.col("o_orderkey") % 3 == 1, F.date_format("o_orderdate", "MMM yyyy")).otherwise(F.lit("Present"))
    return _t(spark, d, "orders").select("o_orderkey", v.validate_date(raw)["ok"].alias("ok"))


@query("select c_custkey, c_custkey % 4 < 3 as ok from customer")
def validate_phone(spark: SparkSession, d: str) -> DataFrame:
    n = "lpad(cast(c_custkey as string), 6, '0')"
    raw = F.expr(f"case c_custkey % 4 when 0 then concat('2155', {n}) when 1 then concat('+919876', {n}) when 2 then concat('+4420', {n}, '12') else {n} end")
    return _t(spark, d, "customer").select("c_custkey", v.validate_phone(raw)["ok"].alias("ok"))


_LETTERS = "concat(chr(cast(65 + c_custkey % 26 as int)), chr(cast(65 + floor(c_custkey / 26) % 26 as int)))"


@query(f"select c_custkey, {_LETTERS} in ({', '.join(repr(c) for c in ref.ALPHA2.split())}) as ok from customer")
def validate_country(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "customer").select("c_custkey", v.validate_country(F.expr(_LETTERS))["ok"].alias("ok"))


@query("select p_partkey, p_partkey % 3 <> 2 as experience_ok, p_partkey % 3 = 1 as education_ok from part")
def validate_entries(spark: SparkSession, d: str) -> DataFrame:
    e = F.expr("map('company', if(p_partkey % 3 = 0, p_brand, ' '), 'title', if(p_partkey % 3 = 1, p_name, ''), 'institution', if(p_partkey % 3 = 1, p_name, ''))")
    return _t(spark, d, "part").select("p_partkey", v.validate_experience(e)["ok"].alias("experience_ok"), v.validate_education(e)["ok"].alias("education_ok"))


# --- Entries ----------------------------------------------------------------------------------------------------------
def _entries(spark: SparkSession, d: str, field: str) -> DataFrame:
    """Orders of a customer as entries: the priority is the company or institution, the status the title."""
    o = _t(spark, d, "orders")
    keys = ("company", "title") if field == "experience" else ("institution", "degree")
    entry = F.create_map(F.lit(keys[0]), F.substring("o_orderpriority", 3, 50), F.lit(keys[1]), F.concat(F.lit("status "), F.col("o_orderstatus")), F.lit("start_date"), F.date_format("o_orderdate", "MMM yyyy"))
    source = F.expr("case o_orderkey % 2 when 0 then 'ATS' else 'Resume' end")
    return o.select(
        F.col("o_custkey").cast("string").alias("candidate_key"), F.lit(field).alias("field"), source.alias("source"), F.col("o_orderkey").cast("int").alias("item_ord"), F.lit(None).cast("string").alias("value"), entry.alias("entry"), F.lit(None).cast("string").alias("raw"), ref.base_confidence(source).alias("confidence"),
        F.lit("m").alias("method"),
    )


_ENTRY = """with o as (select *, case o_orderkey % 2 when 0 then 0.95 else 0.85 end as conf, substr(o_orderpriority, 3) as p from orders),
r as (select *, row_number() over (partition by o_custkey, p order by conf desc, o_orderkey) as rn from o)"""


#: Priorities are not alike and statuses are, so the clusters of one customer's companies are their distinct values.
@query(_ENTRY + "select o_custkey, p as company, 'status ' || o_orderstatus as title, strftime(o_orderdate, '%Y-%m') as start_date, case o_orderkey % 2 when 0 then 'ATS' else 'Resume' end as source from r where rn = 1")
def experience_cluster(spark: SparkSession, d: str) -> DataFrame:
    x = entries.experiences(entries.cluster(_entries(spark, d, "experience"), "experience"))
    return x.select(F.col("candidate_key").cast("long").alias("o_custkey"), F.inline("experience")).select("o_custkey", "company", "title", "start_date", "source")


@query(_ENTRY + "select o_custkey, p as institution, 'status ' || o_orderstatus as degree, strftime(o_orderdate, '%Y-%m') as start_date from r where rn = 1")
def education_cluster(spark: SparkSession, d: str) -> DataFrame:
    x = entries.educations(entries.cluster(_entries(spark, d, "education"), "education"))
    return x.select(F.col("candidate_key").cast("long").alias("o_custkey"), F.inline("education")).select("o_custkey", "institution", "degree", "start_date")


@query("select p_partkey, case when p_partkey % 2 = 0 then p_name else p_type end as a, p_brand as b, p_type as c from part")
def coalesce_fill(spark: SparkSession, d: str) -> DataFrame:
    m = merge.coalesce_fill(F.expr("map('a', if(p_partkey % 2 = 0, p_name, ' '), 'b', p_brand)"), F.expr("map('a', p_type, 'b', 'no', 'c', p_type)"))
    return _t(spark, d, "part").select("p_partkey", m["a"].alias("a"), m["b"].alias("b"), m["c"].alias("c"))


@query("""with x as (select p_partkey, p_name || ' ' || p_type as a, regexp_replace(p_name || ' ' || p_type, '[aeiou]', '', 'g') as b from part)
select p_partkey, round(200.0 * length(b) / (length(a) + length(b)), 4)::double as ratio from x""")
def indel_ratio(spark: SparkSession, d: str) -> DataFrame:
    """Similarity as a Column, without Python, of each part's name and type and the same without vowels."""
    a = F.concat_ws(" ", "p_name", "p_type")
    return _t(spark, d, "part").select("p_partkey", F.round(sim.ratio_column(a, F.regexp_replace(a, "[aeiou]", "")), 4).alias("ratio"))


# --- Provenance, log, reports -----------------------------------------------------------------------------------------
_TRAIL = f"""{WON}, t as (select o.k, o.s, o.v, w.val, case when lower(trim(o.v)) = lower(trim(w.val)) then 'Selected' else 'Rejected — lower confidence than winning value ''' || w.val || '''' end as notes,
case o.s when 'ATS' then 0.95 when 'Resume' then 0.85 else 0.8 end::double as confidence from obs o join w on o.k = w.k)"""


def _trail(spark: SparkSession, d: str) -> DataFrame:
    o = _segments(spark, d)
    return merge.provenance(o, merge.vote(o, F.trim))


@query(f"with {_TRAIL} select k as c_custkey, s as source, v as normalized_value, confidence, notes from t")
def provenance_trail(spark: SparkSession, d: str) -> DataFrame:
    return _trail(spark, d).select(_key(), "source", "normalized_value", "confidence", "notes")


@query(f"with {WON}, c as (select k, string_agg(s || ': ' || v, '; ' order by pr desc) as candidates from obs group by k) select w.k as c_custkey, c.candidates, w.val as winner, w.score from w join c on w.k = c.k")
def merge_log(spark: SparkSession, d: str) -> DataFrame:
    o = _segments(spark, d)
    return merge.merge_log(o, merge.vote(o, F.trim)).select(_key(), F.array_join("candidates", "; ").alias("candidates"), "winner", "score")


@query(f"""with {_TRAIL} select k as c_custkey, string_agg(distinct s, ' & ' order by s) filter (where notes = 'Selected') as selected,
case count(distinct s) filter (where notes = 'Selected') when 3 then 'Three-Source Agreement' when 2 then 'Two-Source Agreement' else 'Single Source' end as agreement,
case when count(distinct s) filter (where notes = 'Selected') > 1 then 'Source agreement after normalization' when count(distinct s) > 1 then 'Highest source confidence' else 'Only source available' end as reason from t group by k""")
def merge_explanation(spark: SparkSession, d: str) -> DataFrame:
    return report.explain(_trail(spark, d)).select(_key(), "selected", "agreement", "reason")


@query(f"with {WON} select case when score >= 0.9 then 'high' when score >= 0.7 then 'medium' else 'low' end as band, count(*) as n from w group by 1")
def confidence_bands(spark: SparkSession, d: str) -> DataFrame:
    return merge.vote(_segments(spark, d), F.trim).groupBy(report.band(F.col("score")).alias("band")).agg(F.count("*").alias("n"))


@query(f"with {SEGMENTS} select k as c_custkey, s as source, v as value from obs where not (s = 'Resume' and k % 2 = 0)")
def source_filter_semi(spark: SparkSession, d: str) -> DataFrame:
    o = _segments(spark, d)
    c = _t(spark, d, "customer").withColumn("candidate_key", F.col("c_custkey").cast("string"))
    states = c.select("candidate_key", F.explode(F.array(*map(F.lit, ref.SOURCES))).alias("source"), "c_custkey").withColumn("available", ~((F.col("source") == "Resume") & (F.col("c_custkey") % 2 == 0)))
    return ob.available_only(o, states).select(_key(), "source", "value")


@query("select coalesce(a.k, b.k) as \"index\", a.x as ats, b.y as resume from (select c_custkey as k, c_name as x from customer where c_custkey % 2 = 0) a full outer join (select s_suppkey as k, s_name as y from supplier) b on a.k = b.k")
def slot_zip(spark: SparkSession, d: str) -> DataFrame:
    a = _t(spark, d, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("index"), F.col("c_name").alias("ats"))
    return report.zip_slots(a, _t(spark, d, "supplier").select(F.col("s_suppkey").alias("index"), F.col("s_name").alias("resume")))


# --- Batches and projection -------------------------------------------------------------------------------------------
def _slots(spark: SparkSession, d: str) -> DataFrame:
    c = _t(spark, d, "customer")
    doc = F.when(F.col("c_custkey") % 2 == 0, F.to_json(F.struct(F.col("c_name").alias("name"))))
    return c.select(F.col("c_custkey").cast("int").alias("index"), doc.alias("ats_data"), F.when(F.col("c_custkey") % 3 == 0, F.col("c_mktsegment")).alias("resume_text"), F.when(F.col("c_custkey") % 5 > 0, F.lit("https://github.com/u")).alias("github_url"))


_SLOTS = """s as (select c_custkey as k, c_name, concat_ws(', ', case when c_custkey % 2 <> 0 then 'ATS JSON' end, case when c_custkey % 3 <> 0 then 'Resume PDF' end, case when c_custkey % 5 = 0 then 'GitHub Profile URL' end) as lack from customer)"""


@query(f"with {_SLOTS} select cast(k as integer) as \"index\", '#' || (k + 1) || ' · ' || case when k % 2 = 0 then c_name else 'Candidate ' || (k + 1) end || case when lack <> '' then ' (Skipped)' else '' end as label, case when lack <> '' then 'skipped' else 'ready' end as status, case when lack <> '' then 'Missing: ' || lack end as error_msg from s")
def batch_status(spark: SparkSession, d: str) -> DataFrame:
    return pipeline.batch_status(_slots(spark, d)).select("index", "label", "status", "error_msg")


@query(f"with {_SLOTS} select count(*) as total, count(*) filter (where lack = '') as ok, cast(0 as bigint) as errors, count(*) filter (where lack <> '') as skipped, round(avg(case when lack = '' then 0.98::double end), 4) as avg_confidence from s")
def batch_dashboard(spark: SparkSession, d: str) -> DataFrame:
    return report.dashboard(pipeline.run_batch(_slots(spark, d)))


def _profiles(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("candidate_id"), F.when(F.col("c_custkey") % 3 > 0, F.col("c_name")).alias("full_name"), F.col("c_mktsegment").alias("headline"))


@query("select cast(c_custkey as varchar) as candidate_id, '{\"candidate_id\":\"' || c_custkey || '\",\"full_name\":' || case when c_custkey % 3 > 0 then '\"' || c_name || '\"' else 'null' end || ',\"headline\":\"' || c_mktsegment || '\"}' as json from customer")
def project_null(spark: SparkSession, d: str) -> DataFrame:
    return project.project_json(_profiles(spark, d), {"fields": ["full_name", "headline"]})


@query("select cast(c_custkey as varchar) as candidate_id, '{\"candidate_id\":\"' || c_custkey || '\"' || case when c_custkey % 3 > 0 then ',\"full_name\":\"' || c_name || '\"' else '' end || ',\"headline\":\"' || c_mktsegment || '\"}' as json from customer")
def project_omit(spark: SparkSession, d: str) -> DataFrame:
    return project.project_json(_profiles(spark, d), {"fields": ["full_name", "headline"], "missing_field_policy": "omit"})


@query("select cast(c_custkey as varchar) as candidate_id, case when c_custkey % 3 > 0 then c_name end as name, cast(null as varchar) as emails from customer")
def project_rename(spark: SparkSession, d: str) -> DataFrame:
    return project.project(_profiles(spark, d), {"fields": ["full_name", "emails"], "rename": {"full_name": "name"}})


_NUMBER = "lpad(cast(c_custkey as varchar), 6, '0')"


@query(f"""with j as (select o_custkey, count(distinct (o_orderpriority, o_orderstatus)) as n from orders group by o_custkey)
select c_custkey, replace(c_name, '#', ' ') as full_name, c_mktsegment || ' worker' as headline, lower(replace(c_name, '#', '.')) || '@example.com' || case when c_custkey % 3 = 0 then ',g' || c_custkey || '@example.com' else '' end as emails,
case when c_custkey % 2 = 0 then '+919876' || {_NUMBER} else '+4930' || {_NUMBER} end as phones, 'Town' as city, case when c_custkey % 2 = 0 then 'IN' else 'DE' end as country, cast(c_custkey % 30 as double) as years,
case when c_custkey % 2 = 0 then 'Python,JavaScript,SQL' else 'JavaScript,Python' end as skills, cast(n as integer) as n_jobs, c_mktsegment || ' BSc 2019-06' as schools, case when c_custkey % 3 = 0 then 'https://github.com/u' || c_custkey end as github,
case when c_custkey % 3 = 0 then 'https://b' || c_custkey || '.io' end as portfolio,
round(case when c_custkey % 2 = 0 then (case when c_custkey % 3 = 0 then (0.98 * 3 + 0.95 + 0.8) / 5 else (0.98 * 3 + 0.95) / 4 end) else (case when c_custkey % 3 = 0 then (0.95 * 4 + 0.8) / 5 else 0.95 end) end, 4)::double as overall_confidence, 'ok' as status from customer left join j on o_custkey = c_custkey""")
def canonical_profile(spark: SparkSession, d: str) -> DataFrame:
    """Whole profiles of all customers from JSON records, texts (every second) and a code host (every third)."""
    c = _t(spark, d, "customer").withColumn("candidate_key", F.col("c_custkey").cast("string"))
    jobs = _t(spark, d, "orders").groupBy(F.col("o_custkey").cast("string").alias("candidate_key")).agg(F.collect_list(F.struct(F.col("o_orderpriority").alias("company"), F.col("o_orderstatus").alias("title"), F.date_format("o_orderdate", "yyyy-MM").alias("start"))).alias("jobs"))
    even, number = F.col("c_custkey") % 2 == 0, F.lpad(F.col("c_custkey").cast("string"), 6, "0")
    doc = F.to_json(F.struct(
        F.col("c_name").alias("name"), F.concat(F.col("c_mktsegment"), F.lit(" worker")).alias("title"), F.expr("concat(replace(c_name, '#', '.'), '@example.com')").alias("email"), F.lit("Python, JS").alias("skills"), F.col("jobs").alias("work_experience"),
        F.when(even, F.concat(F.lit("9876"), number)).otherwise(F.concat(F.lit("030 "), number)).alias("contact_phone"), F.when(even, "Town, India").otherwise("Town, Germany").alias("current_location"), (F.col("c_custkey") % 30).alias("yearsOfExperience"),
        F.array(F.struct(F.col("c_mktsegment").alias("school"), F.lit("BSc").alias("degree"), F.lit("June 2019").alias("graduation_date"))).alias("qualifications"),
    ))
    docs = c.join(jobs, "candidate_key", "left").select("candidate_key", doc.alias("doc"))
    texts = c.where(even).select("candidate_key", F.concat(F.lit("Ann Lee\nPune, India\nSummary\n"), F.col("c_mktsegment"), F.lit(" worker\nSkills\nPython, SQL\n")).alias("text"))
    none, url = F.lit(None).cast("string"), F.concat(F.lit("https://github.com/u"), F.col("c_custkey"))
    users = c.where("c_custkey % 3 = 0").select("candidate_key", v.github_username(url).alias("username"), none.alias("name"), none.alias("bio"), F.concat(F.lit("G"), F.col("c_custkey"), F.lit("@Example.com")).alias("email"), none.alias("location"), F.concat(F.lit("https://b"), F.col("c_custkey"), F.lit(".io/")).alias("blog"), url.alias("html_url"))
    p = pipeline.transform(ats=docs, resumes=texts, users=users).canonical
    schools = F.array_join(F.transform("education", lambda e: F.concat_ws(" ", e["institution"], e["degree"], e["end_date"])), ",")
    return p.select(
        _key(), "full_name", "headline", F.array_join("emails", ",").alias("emails"), F.array_join("phones", ",").alias("phones"), "location.city", "location.country", F.col("years_experience").alias("years"), F.array_join(F.transform("skills", lambda s: s["name"]), ",").alias("skills"),
        F.size("experience").alias("n_jobs"), schools.alias("schools"), "links.github", "links.portfolio", "overall_confidence", "status",
    )


# --- Sources and whole profiles ---------------------------------------------------------------------------------------
@query("""select c_custkey, 'education' as field, c_mktsegment as a, 'L' || c_nationkey as b, c_name as c, 'degree,field_of_study,gpa,institution,start_date' as keys from customer
union all select c_custkey, 'experience', c_name, c_mktsegment, '2020-0' || (c_custkey % 9 + 1), 'company,start_date,title,until' from customer
union all select c_custkey, 'links', 'https://x.io/' || c_custkey, 't' || c_custkey, 'no', 'github,portfolio,twitter' from customer""")
def ats_records(spark: SparkSession, d: str) -> DataFrame:
    """Nested records and links of JSON documents under their canonical keys; keys that no alias covers stay."""
    doc = F.to_json(F.struct(
        F.array(F.struct(F.col("c_mktsegment").alias("college"), F.concat(F.lit("L"), F.col("c_nationkey")).alias("qualification"), F.col("c_name").alias("stream"), F.lit("2019").alias("from"), F.col("c_custkey").alias("cgpa"))).alias("academic"),
        F.array(F.struct(F.col("c_name").alias("employer"), F.col("c_mktsegment").alias("designation"), F.concat(F.lit("2020-0"), F.col("c_custkey") % 9 + 1).alias("from_date"), F.lit("now").alias("until"))).alias("career_history"),
        F.concat(F.lit("https://x.io/"), F.col("c_custkey")).alias("website"), F.struct(F.concat(F.lit("t"), F.col("c_custkey")).alias("twitter"), F.lit("no").alias("github")).alias("social_links"),
    ))
    obs, _ = ats.ats_observations(_t(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("candidate_key"), doc.alias("doc")))
    e = lambda *keys: F.coalesce(*[F.element_at("entry", F.lit(k)) for k in keys])
    o = obs.where("field in ('education', 'experience', 'links')")
    return o.select(_key(), "field", e("institution", "company", "portfolio").alias("a"), e("degree", "title", "twitter").alias("b"), e("field_of_study", "start_date", "github").alias("c"), F.array_join(F.array_sort(F.map_keys("entry")), ",").alias("keys"))


@query("""select c_custkey, 'Ann ' || upper(substr(c_mktsegment, 1, 1)) || lower(substr(c_mktsegment, 2)) as full_name, case when c_custkey % 2 = 0 then 'Pune, India' else 'near Chennai' end as location, c_mktsegment || ' worker with ' || (c_custkey % 30 + 1) || ' years' as headline,
cast(c_custkey % 30 + 1 as double) as years, 'u' || c_custkey || '@example.com' as email, '555-' || lpad(cast(c_custkey % 1000 as varchar), 3, '0') || '-1234' as phone, 'https://linkedin.com/in/u' || c_custkey as linkedin, 'https://www.github.com/u' || c_custkey as github,
'University of ' || c_mktsegment as institution, 'B.Sc' as degree, cast(1990 + c_custkey % 30 as varchar) as end_date, (c_custkey % 10) || '.5' as gpa from customer""")
def resume_values(spark: SparkSession, d: str) -> DataFrame:
    """What the rules of résumé texts read from a text for each customer."""
    k, seg = F.col("c_custkey").cast("string"), F.col("c_mktsegment")
    phone = F.concat(F.lit("555-"), F.lpad((F.col("c_custkey") % 1000).cast("string"), 3, "0"), F.lit("-1234"))
    text = F.concat(
        F.lit("Ann "), F.initcap(F.lower(seg)), F.when(F.col("c_custkey") % 2 == 0, "\nPune, India\n").otherwise("\n near Chennai \n"), F.lit("U"), k, F.lit("@Example.com "), phone, F.lit("\nlinkedin.com/in/u"), k, F.lit(" https://www.github.com/u"), k,
        F.lit("\nSummary\n"), seg, F.lit(" worker with "), F.col("c_custkey") % 30 + 1, F.lit(" years. Likes SQL\nEducation\nUniversity of "), seg, F.lit("\nB.Sc "), 1990 + F.col("c_custkey") % 30, F.lit(", GPA: "), F.col("c_custkey") % 10, F.lit(".5\n"),
    )
    obs, _ = resume.resume_observations(_t(spark, d, "customer").select(k.alias("candidate_key"), text.alias("text")))
    value = lambda f: F.max(F.when(F.col("field") == f, F.col("value")))
    entry = lambda f, key: F.max(F.when(F.col("field") == f, F.element_at("entry", F.lit(key))))
    g = obs.groupBy("candidate_key").agg(
        value("full_name").alias("full_name"), value("location").alias("location"), value("headline").alias("headline"), value("years_experience").cast("double").alias("years"), value("emails").alias("email"), value("phones").alias("phone"), entry("links", "linkedin").alias("linkedin"), entry("links", "github").alias("github"),
        *[entry("education", x).alias(x) for x in ("institution", "degree", "end_date", "gpa")],
    )
    return g.select(_key(), *g.columns[1:])


def _users(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    url = F.concat(F.when(k % 2 == 0, "https://www.github.com/u").otherwise("github.com/u"), k, F.when(k % 2 == 0, "/").otherwise(""))
    none = F.lit(None).cast("string")
    return _t(spark, d, "customer").select(k.cast("string").alias("candidate_key"), v.github_username(F.when(k % 7 > 0, url).otherwise("https://notgithub.com/u")).alias("username"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("bio"), none.alias("email"), none.alias("location"), none.alias("blog"), F.when(k % 3 > 0, url).alias("html_url"), F.when(k % 3 == 0, F.when(k % 4 == 0, 403).otherwise(404)).alias("status"))


@query("""with l as (select o_custkey, o_orderstatus, count(*) as n from orders where o_custkey % 3 > 0 and o_custkey % 7 > 0 group by o_custkey, o_orderstatus),
r as (select *, row_number() over (partition by o_custkey order by n desc, o_orderstatus) - 1 as i from l)
select c_custkey, 'full_name' as field, 0 as item_ord, c_name as value, c_name as raw from customer where c_custkey % 3 > 0 and c_custkey % 7 > 0 union all select c_custkey, 'headline', 0, c_mktsegment, c_mktsegment from customer where c_custkey % 3 > 0 and c_custkey % 7 > 0
union all select o_custkey, 'skills', cast(i as integer), o_orderstatus, o_orderstatus || ' (' || n || ' repos)' from r join customer on c_custkey = o_custkey""")
def github_profiles(spark: SparkSession, d: str) -> DataFrame:
    repos = _t(spark, d, "orders").select(F.col("o_custkey").cast("string").alias("candidate_key"), F.col("o_orderstatus").alias("language"))
    obs, _ = github.github_observations(_users(spark, d), repos)
    return obs.where("field <> 'links'").select(_key(), "field", "item_ord", "value", "raw")


@query("""select c_custkey, c_custkey % 3 > 0 and c_custkey % 7 > 0 as available, case when c_custkey % 12 = 0 then 'rate-limited (403): a token allows 5000 requests an hour' when c_custkey % 3 = 0 then 'not found (404)' when c_custkey % 7 = 0 then 'no user name' end as error from customer""")
def github_status(spark: SparkSession, d: str) -> DataFrame:
    _, states = github.github_observations(_users(spark, d), spark.createDataFrame([], "candidate_key string, language string"))
    return states.select(_key(), "available", F.get("parse_errors", F.lit(0)).alias("error"))


@query("""with x as (select c_custkey as k, case c_custkey % 5 when 0 then 'github.com/g' || c_custkey when 1 then 'https://www.github.com/a' || c_custkey when 2 then 'https://github.com/r' || c_custkey when 3 then 'https://notgithub.com/x' end as raw from customer)
select k as c_custkey, case when k % 5 = 0 then 'https://' || raw when k % 5 in (1, 2) then raw end as url, case k % 5 when 0 then 'g' || k when 1 then 'a' || k when 2 then 'r' || k end as username, case when k % 5 = 3 then 'invalid GitHub URL ''' || raw || '''' end as error from x""")
def github_url_chain(spark: SparkSession, d: str) -> DataFrame:
    """The address given, else that of the record's root, else the résumé's."""
    k = F.col("c_custkey")
    given = F.when(k % 5 == 0, F.concat(F.lit(" github.com/g"), k)).when(k % 5 == 3, F.lit("https://notgithub.com/x")).otherwise(F.lit(" "))
    doc = F.to_json(F.struct(F.when(k % 5 == 1, F.concat(F.lit("https://www.github.com/a"), k)).alias("githubUrl")))
    g = github.profile_url(given, doc, F.when(k % 5 == 2, F.concat(F.lit("https://github.com/r"), k)))
    return _t(spark, d, "customer").select("c_custkey", g.alias("g")).select("c_custkey", "g.url", "g.username", "g.error")


def _small(spark: SparkSession, d: str) -> pipeline.Profiles:
    """Profiles of records (title, skills, address, e-mail) and of texts of every second customer."""
    c = _t(spark, d, "customer").withColumn("candidate_key", F.col("c_custkey").cast("string"))
    doc = F.to_json(F.struct(F.col("c_mktsegment").alias("title"), F.lit("Python, JS").alias("skills"), F.concat(F.lit("https://github.com/u"), F.col("c_custkey")).alias("github_url"), F.concat(F.lit("U"), F.col("c_custkey"), F.lit("@Example.com")).alias("email")))
    text = F.concat(F.lit("12345\nSummary\n"), F.lower("c_mktsegment"), F.lit("\nSkills\nPython, SQL\n"))
    return pipeline.transform(ats=c.select("candidate_key", doc.alias("doc")), resumes=c.where("c_custkey % 2 = 0").select("candidate_key", text.alias("text")))


@query("""with c as (select c_custkey as k, c_mktsegment as m from customer), e as (select * from c where k % 2 = 0)
select k as c_custkey, 'headline' as field, 'ATS' as source, m as normalized_value, 'Selected' as notes from c union all select k, 'headline', 'Resume', lower(m), 'Selected' from e
union all select k, 'links', 'ATS', '{"github":"https://github.com/u' || k || '"}', 'Selected' from c union all select k, 'emails', 'ATS', 'u' || k || '@example.com', 'Selected' from c
union all select k, 'skills', 'ATS', 'Python', 'Selected' from c union all select k, 'skills', 'ATS', 'JavaScript', 'Selected' from c
union all select k, 'skills', 'Resume', 'Python', 'Merged with selected skill from source ''ATS''' from e union all select k, 'skills', 'Resume', 'SQL', 'Selected' from e""")
def profile_provenance(spark: SparkSession, d: str) -> DataFrame:
    """The trail of whole profiles, as it is attached to them."""
    x = _small(spark, d).full().select("candidate_key", F.inline("provenance"))
    return x.where("field <> 'full_name'").select(_key(), "field", "source", "normalized_value", "notes")


@query("""with c as (select c_custkey as k, c_mktsegment as m, c_custkey % 2 = 0 as even from customer)
select k as c_custkey, 'emails' as field, 'u' || k || '@example.com' as winner, 0.95::double as score, 'Merged and deduplicated 1 email(s) from 1 source entries.' as reasoning, 'ATS: u' || k || '@example.com' as candidates from c
union all select k, 'skills', case when even then '3 skills merged' else '2 skills merged' end, case when even then 0.9267 else 0.95 end, 'Merged and deduplicated ' || case when even then '3' else '2' end || ' skill(s) across all sources.', 'ATS: Python; ATS: JS' || case when even then '; Resume: Python; Resume: SQL' else '' end from c
union all select k, 'headline', m, case when even then 0.98 else 0.95 end, case when even then 'Agreement between ATS, Resume. Agreement bonus applied: 0.98.' else 'Single source (ATS). Base confidence: 0.95.' end, 'ATS: ' || m || case when even then '; Resume: ' || lower(m) else '' end from c""")
def list_merge_log(spark: SparkSession, d: str) -> DataFrame:
    return _small(spark, d).merge_log.where("field <> 'full_name'").select(_key(), "field", "winner", "score", "reasoning", F.array_join("candidates", "; ").alias("candidates"))


_JSON = """'{"candidate_id":"' || sha256(cast(c_custkey as varchar)) || '","skills":[' || case when c_custkey % 2 = 0 then '{"name":"Python","confidence":0.98,"sources":["ATS","Resume"]},' else '' end || '{"name":"JavaScript","confidence":0.95,"sources":["ATS"],"aliases":["JS"]}'
|| case when c_custkey % 2 = 0 then ',{"name":"SQL","confidence":0.85,"sources":["Resume"]}' else ',{"name":"Python","confidence":0.95,"sources":["ATS"]}' end || '],"links":{"github":"https://github.com/u' || c_custkey || '"},"place":null,"emails":["u' || c_custkey || '@example.com"]}'"""


@query(f"select sha256(cast(c_custkey as varchar)) as candidate_id, {_JSON} as json from customer")
def project_serialised(spark: SparkSession, d: str) -> DataFrame:
    """Nested fields in the output's shape: aliases only where there are any, no empty links, no source of entries."""
    return project.project_json(_small(spark, d).canonical, {"fields": ["skills", "links", "location", "emails"], "rename": {"location": "place"}, "include_confidence": False, "include_provenance": False})


@query("""select c_custkey, 'headline' as field, case when c_custkey % 2 = 0 then 0.98 else 0.95 end::double as score from customer union all select c_custkey, 'links', 0.95 from customer union all select c_custkey, 'emails', 0.9 from customer union all select c_custkey, 'phones', 0.85 from customer
union all select c_custkey, 'skills', case when c_custkey % 2 = 0 then 0.9267 else 0.95 end from customer""")
def confidence_summary(spark: SparkSession, d: str) -> DataFrame:
    s = report.confidence_summary(_small(spark, d).canonical)
    return s.where("field <> 'full_name'").select(_key(), "field", F.round("score", 4).alias("score"))


@query("select c_custkey, 2 as n_records, 'links' as scored, true as shown from customer")
def visible_fields(spark: SparkSession, d: str) -> DataFrame:
    """Without name, headline and skills: the records of links and e-mails, and the score of links."""
    x = project.visible(_small(spark, d).full(), ["full_name", "headline", "skills"])
    return x.select(_key(), F.size("provenance").alias("n_records"), F.array_join(F.map_keys("confidence_scores"), ",").alias("scored"), F.lit("skills" not in x.columns and "emails" in x.columns).alias("shown"))


@query(f"with {_TRAIL} select k as c_custkey, string_agg(s || ':' || v, '; ' order by s) as records, count(distinct s) as n_sources from t group by k")
def trail_records(spark: SparkSession, d: str) -> DataFrame:
    t = report.provenance_for(_trail(spark, d), "headline")
    r = report.trail(t).join(report.source_counts(t), "candidate_key")
    return r.select(_key(), F.array_join(F.transform("records", lambda x: F.concat_ws(":", x["source"], x["normalized_value"])), "; ").alias("records"), "n_sources")


@query("""select c_custkey, case when c_custkey % 20 > 10 then (c_custkey % 20) || '.0%' else (c_custkey % 20) || '.0' end as gpa, c_name || case when c_custkey % 2 = 0 then ', ST' else '' end || case when c_custkey % 3 = 0 and c_custkey % 2 = 0 then '' when c_custkey % 3 = 0 then ', IN' else ', DE' end as place from customer""")
def displays(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    return _t(spark, d, "customer").select("c_custkey", report.gpa_display((k % 20).cast("double")).alias("gpa"), report.location_display(F.col("c_name"), F.when(k % 2 == 0, "ST"), F.when(k % 3 == 0, "IN").otherwise("DE")).alias("place"))


@query("""select cast(c_custkey as integer) as "index", case when c_custkey % 5 = 0 then 'skipped' when c_custkey % 2 = 0 then 'ok' else 'error' end as status, case when c_custkey % 5 = 0 then 'Missing: Resume PDF' when c_custkey % 2 > 0 then 'missing field: headline' end as error_msg,
case when c_custkey % 5 > 0 then 'GitHub: ' || case when c_custkey % 3 = 0 then 'invalid GitHub URL ''https://x.io''' else 'profile not found' end end as errors,
case when c_custkey % 5 > 0 and c_custkey % 2 = 0 then '{"candidate_id":"' || sha256(cast(c_custkey as varchar)) || '","headline":"' || c_mktsegment || '"}' end as output from customer""")
def batch_output(spark: SparkSession, d: str) -> DataFrame:
    """Projected results of a batch under the policy error, and what went wrong with sources."""
    k = F.col("c_custkey")
    doc = F.to_json(F.struct(F.lit("Ann Lee").alias("name"), F.when(k % 2 == 0, F.col("c_mktsegment")).alias("title")))
    slots = _t(spark, d, "customer").select(k.cast("int").alias("index"), doc.alias("ats_data"), F.when(k % 5 > 0, "12345").alias("resume_text"), F.when(k % 3 == 0, "https://x.io").otherwise("https://github.com/u").alias("github_url"))
    out = pipeline.run_batch(slots, config={"fields": ["headline"], "include_confidence": False, "include_provenance": False, "missing_field_policy": "error"})
    return out.select("index", "status", "error_msg", F.array_join("errors", "; ").alias("errors"), "output")


@query("""select p_partkey, sha256('{"p_partkey":' || p_partkey || ',"p_name":"' || p_name || '"}') as hash, case when lower(p_name) = lower(p_type) then p_name else p_name || ',' || p_type end as names from part""")
def hash_and_distinct(spark: SparkSession, d: str) -> DataFrame:
    names = tx.distinct_ignoring_case(F.array("p_name", F.upper("p_name"), "p_type", F.lower("p_type")))
    return _t(spark, d, "part").select("p_partkey", tx.stable_hash(F.col("p_partkey"), F.col("p_name")).alias("hash"), F.array_join(names, ",").alias("names"))


@query(r"select doc_id, regexp_matches(text, '[A-Za-z]{26,}') or (length(text) - length(replace(text, ' ', ''))) < 0.04 * length(text) as glued, trim(regexp_replace(text, '\s+', ' ', 'g')) in ('', '[]', '{}') or text is null as empty from documents")
def glued_text(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "documents").select("doc_id", tx.glued(F.col("text")).alias("glued"), tx.is_empty(F.col("text")).alias("empty"))


@query("""select c_custkey, c_name as full_name, 'customer-' || c_custkey as slug from customer""")
def json_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Documents written as JSON lines and read again by their aliases."""
    path = f"{shared_dir(spark)}/accordis-json-{uuid.uuid4().hex}"
    files.write_json(_t(spark, d, "customer").select("c_custkey", F.col("c_name").alias("applicant_name"), F.lit(None).cast("string").alias("name")), path)
    docs = files.read_json_lines(spark, path)
    found = ats.find(docs.withColumn("candidate_key", F.get_json_object("doc", "$.c_custkey")), {"full_name": ref.FIELD_ALIASES["full_name"]})
    return found.select(_key(), F.get("found", F.lit(0))["value"].alias("full_name"), tx.slugify(F.concat(F.lit("Ĉustomér "), F.col("candidate_key"))).alias("slug"))


#: Queries whose times bench.py reports.
HEADLINE: list[str] = ["vote_scalar", "presence_confidence", "dedup_priority", "skills_merge", "language_rank", "alias_resolve", "email_extract", "date_normalize", "provenance_trail", "merge_log", "education_cluster", "canonical_profile"]
