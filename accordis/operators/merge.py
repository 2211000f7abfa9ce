"""Merging observations: agreement votes, priority dedup, skills, links, confidence, provenance notes, merge log.

Every operator hash-partitions by candidate (or candidate and field) once and aggregates with map-side combining;
order inside arrays is explicit, never that of arrival.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from accordis import reference as ref
from accordis.functions.text import is_empty, slugify

SCORED = ("full_name", "headline", "years_experience", "location", "links")


def _known(df: DataFrame) -> DataFrame:
    return df.withColumns({"pr": ref.priority(F.col("source")), "bit": ref.source_bit(F.col("source")), "so": ref.lookup(F.col("source"), {s: i for i, s in enumerate(ref.SOURCES)}, 9)})


def reasoning(mask: Column, all_mask: Column) -> Column:
    names, score = F.array_join(ref.sources_of(mask), ", "), F.format_string("%.2f", ref.agreement(mask))
    one = F.size(ref.sources_of(mask)) == 1
    said = F.when(one, F.concat(F.lit("Single source ("), names, F.lit("). Base confidence: "), score, F.lit("."))).otherwise(F.concat(F.lit("Agreement between "), names, F.lit(". Agreement bonus applied: "), score, F.lit(".")))
    others = all_mask.bitwiseAND(F.bitwise_not(mask))
    return F.concat(said, F.when(others > 0, F.concat(F.lit(" Disagreeing source(s): "), F.array_join(ref.sources_of(others), ", "), F.lit(" overridden."))).otherwise(F.lit("")))


def vote(observations: DataFrame, normalise: Callable[[Column], Column] | None = None, keys: list[str] | None = None) -> DataFrame:
    """The winning value of each key (default candidate_key, field): the group of equal values (case and outer space
    ignored) with the best agreement score, then the higher source priority.

    Returns the keys, value, score, mask, sources, all_mask, reasoning. Two aggregations; no window, no join."""
    keys = keys or ["candidate_key", "field"]
    norm = (normalise or (lambda c: c))(F.col("value"))
    o = _known(observations.where(~is_empty(F.col("value")))).withColumn("norm", norm)
    o = o.withColumn("gkey", F.lower(F.trim("norm")))
    g = o.groupBy(*keys, "gkey").agg(F.bit_or("bit").alias("mask"), F.max_by("norm", F.struct("pr", -F.col("item_ord") if "item_ord" in observations.columns else F.lit(0))).alias("value"), F.max("pr").alias("pr"))
    g = g.withColumn("score", ref.agreement(F.col("mask")))
    w = g.groupBy(*keys).agg(F.max_by(F.struct("value", "score", "mask"), F.struct("score", "pr", F.hash("gkey"), "gkey")).alias("w"), F.bit_or("mask").alias("all_mask"))
    return w.select(*keys, "w.value", "w.score", "w.mask", ref.sources_of(F.col("w.mask")).alias("sources"), "all_mask", reasoning(F.col("w.mask"), F.col("all_mask")).alias("reasoning"))


def agreement_scores(observations: DataFrame, keys: list[str]) -> DataFrame:
    """Score of the set of sources that are there for each key."""
    g = _known(observations).groupBy(*keys).agg(F.bit_or("bit").alias("mask"))
    return g.withColumn("score", ref.agreement(F.col("mask"))).withColumn("sources", ref.sources_of(F.col("mask")))


def presence_confidence(observations: DataFrame) -> DataFrame:
    """candidate_key, field, score, sources, reasoning of the five scored fields, from the sources that give a value."""
    o = _known(observations.where(F.col("field").isin(*SCORED)).where(~is_empty(F.col("value")) | F.col("entry").isNotNull()))
    there = o.groupBy("candidate_key", "field").agg(F.bit_or("bit").alias("mask"))
    everyone = _known(observations).groupBy("candidate_key").agg(F.bit_or("bit").alias("all_mask"))
    j = there.join(everyone, "candidate_key")
    return j.select("candidate_key", "field", F.round(ref.agreement(F.col("mask")), 4).alias("score"), ref.sources_of(F.col("mask")).alias("sources"), reasoning(F.col("mask"), F.col("all_mask")).alias("reasoning"))


def overall_confidence(scores: DataFrame) -> DataFrame:
    return scores.groupBy("candidate_key").agg(F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.avg("score"))), 4).alias("overall_confidence"))


def dedup_by_priority(observations: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """The observations with `kept`, `position` (of kept ones, from 1), `won` (the kept string) and `notes`: of strings equal
    but for case and outer space the one of the most trusted source, then the first, is kept."""
    keys = keys or ["candidate_key", "field"]
    o = _known(observations.where(~is_empty(F.col("value")))).withColumn("value", F.trim("value")).withColumn("gkey", F.lower("value"))
    order = [F.desc("pr"), "so", "item_ord"]
    alike = Window.partitionBy(*keys, "gkey").orderBy(*order)
    o = o.withColumns({"rn": F.row_number().over(alike), "won": F.first("value").over(alike)})
    o = o.withColumn("kept", F.col("rn") == 1).withColumn("notes", F.when(F.col("kept"), F.lit("Selected")).otherwise(F.lit("Rejected — duplicate of value from higher-priority source")))
    place = F.when(F.col("kept"), F.sum(F.col("kept").cast("int")).over(Window.partitionBy(*keys).orderBy(*order)))
    return o.withColumn("position", place).drop("pr", "bit", "so", "gkey", "rn")


def string_lists(observations: DataFrame) -> DataFrame:
    """candidate_key, field, values: the kept strings in order."""
    d = dedup_by_priority(observations).where("kept")
    return d.groupBy("candidate_key", "field").agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "value"))), lambda x: x.value).alias("values"))


def merge_skills(skills: DataFrame, strict: bool = False) -> DataFrame:
    """candidate_key, name, aliases, sources, confidence of each skill; skills: observations with canonical and value.

    Skills are equal if their slugs are (C, C++ and C# are one); strict: if their names are but for case."""
    s = _known(skills.where(~is_empty(F.col("canonical"))))
    s = s.withColumn("k", F.lower("canonical") if strict else slugify(F.col("canonical"))).withColumn("at", F.struct("so", "item_ord"))
    g = s.groupBy("candidate_key", "k").agg(
        F.min_by("canonical", "at").alias("name"), F.bit_or("bit").alias("mask"),
        F.array_sort(F.collect_set(F.when(F.lower("value") != F.lower("canonical"), F.struct("so", "item_ord", "value")))).alias("a"), F.array_sort(F.collect_set(F.struct("so", "source"))).alias("s"),
    )
    return g.select("candidate_key", "name", F.array_distinct(F.transform("a", lambda x: x.value)).alias("aliases"), F.transform("s", lambda x: x.source).alias("sources"), F.round(ref.agreement(F.col("mask")), 4).alias("confidence"))


def skill_lists(merged: DataFrame) -> DataFrame:
    """candidate_key and skills, best first, then by name."""
    item = F.struct((-F.col("confidence")).alias("k"), F.lower("name").alias("l"), F.struct("name", F.col("aliases").alias("aliases_found"), "confidence", "sources").alias("v"))
    return merged.groupBy("candidate_key").agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: x.v).alias("skills"))


def skill_provenance(skills: DataFrame, strict: bool = False) -> DataFrame:
    """A row for each skill of a source: of equal skills the most certain is selected, others are merged with it.

    skills: as for merge_skills, with match, method and confidence."""
    s = skills.where(~is_empty(F.col("canonical"))).withColumn("so", ref.lookup(F.col("source"), {x: i for i, x in enumerate(ref.SOURCES)}, 9))
    alias = F.when((F.col("match") != "passthrough") & (F.lower(F.trim("value")) != F.lower("canonical")), F.trim("value"))
    s = s.withColumns({"k": F.lower("canonical") if strict else slugify(F.col("canonical")), "alias": alias})
    group = Window.partitionBy("candidate_key", "k")
    own = F.struct("source", "method", "alias", "confidence")
    s = s.withColumns({"name": F.first("canonical").over(group.orderBy("so", "item_ord")), "best": F.first(own).over(group.orderBy(F.desc("confidence"), "so", "item_ord")), "own": own})
    notes = F.when(F.col("own").eqNullSafe(F.col("best")), F.lit("Selected")).otherwise(F.concat(F.lit("Merged with selected skill from source '"), F.col("best.source"), F.lit("'")))
    return s.select("candidate_key", F.lit("skills").alias("field"), "source", "method", F.coalesce("alias", "name").alias("raw_value"), F.col("name").alias("normalized_value"), F.round("confidence", 4).alias("confidence"), notes.alias("notes"), "item_ord")


def merge_links(links: DataFrame, blogs: DataFrame | None = None) -> DataFrame:
    """candidate_key, linkedin, github, portfolio, other: the first non-empty value of each of the three kinds in source
    order; values of all other kinds go to other, once each.

    blogs: observations of a blog address, the portfolio of a source that gives no links."""
    e = _known(links).select("candidate_key", "so", "source", F.explode("entry").alias("kind", "url")).where(~is_empty(F.col("url")))
    if blogs is not None:
        lone = blogs.join(links.select("candidate_key", "source"), ["candidate_key", "source"], "left_anti")
        e = e.unionByName(_known(lone).select("candidate_key", "so", "source", F.lit("portfolio").alias("kind"), F.col("value").alias("url")))
    e = e.withColumn("url", F.regexp_replace(F.trim("url"), "/+$", ""))
    first = lambda k: F.min_by(F.when(F.col("kind") == k, F.col("url")), F.when(F.col("kind") == k, F.col("so")))
    rest = F.array_distinct(F.transform(F.array_sort(F.collect_list(F.when(~F.col("kind").isin("linkedin", "github", "portfolio"), F.struct("so", "url")))), lambda x: x.url))
    return e.groupBy("candidate_key").agg(first("linkedin").alias("linkedin"), first("github").alias("github"), first("portfolio").alias("portfolio"), rest.alias("other"))


def links_provenance(links: DataFrame, blogs: DataFrame) -> DataFrame:
    """Every source's links are selected, a blog address only where the source gives no links."""
    lone = blogs.join(links.select("candidate_key", "source"), ["candidate_key", "source"], "left_anti")
    what = links.withColumn("normalized_value", F.to_json("entry")).unionByName(lone.withColumn("normalized_value", F.to_json(F.struct(F.col("value").alias("portfolio")))))
    return what.select("candidate_key", F.lit("links").alias("field"), "source", "method", F.col("raw").alias("raw_value"), "normalized_value", F.round("confidence", 4).alias("confidence"), F.lit("Selected").alias("notes"), "item_ord")


def coalesce_fill(high: Column, low: Column) -> Column:
    """A map whose empty values are filled from another."""
    return F.map_filter(F.map_zip_with(high, low, lambda k, a, b: F.when(is_empty(a), b).otherwise(a)), lambda k, v: v.isNotNull())


def provenance(observations: DataFrame, winners: DataFrame) -> DataFrame:
    """A row for each observation of a voted field, with what became of it."""
    o = observations.join(winners.select("candidate_key", "field", F.col("value").alias("won"), "mask"), ["candidate_key", "field"])
    agreed = F.lower(F.trim("value")) == F.lower(F.trim("won"))
    notes = F.when(agreed, F.lit("Selected")).otherwise(F.concat(F.lit("Rejected — lower confidence than winning value '"), F.col("won"), F.lit("'")))
    return o.select("candidate_key", "field", "source", "method", F.col("raw").alias("raw_value"), F.col("value").alias("normalized_value"), F.round("confidence", 4).alias("confidence"), notes.alias("notes"), *(["item_ord"] if "item_ord" in o.columns else []))


def merge_log(observations: DataFrame, winners: DataFrame) -> DataFrame:
    """candidate_key, field, candidates (source and up to 200 characters, in source order), winner, score, reasoning."""
    c = _known(observations).groupBy("candidate_key", "field").agg(F.transform(F.array_sort(F.collect_list(F.struct("so", "item_ord", "source", F.substring("value", 1, 200).alias("value")))), lambda x: F.concat_ws(": ", x.source, x.value)).alias("candidates"))
    return winners.join(c, ["candidate_key", "field"]).select("candidate_key", "field", "candidates", F.substring("value", 1, 200).alias("winner"), "score", "reasoning")


def list_log(deduped: DataFrame) -> DataFrame:
    """candidate_key, field, total, distinct_values and average confidence over the distinct ones (above 1 where
    duplicates add)."""
    return deduped.groupBy("candidate_key", "field").agg(F.count("*").alias("total"), F.count_if("kept").alias("distinct_values"), F.round(F.sum("confidence") / F.count_if("kept"), 4).alias("avg_confidence"))


def _told(items: Column) -> Column:
    return F.transform(F.array_sort(items), lambda x: F.concat_ws(": ", x.source, x.value))


def list_merge_log(deduped: DataFrame) -> DataFrame:
    """Entries of the merge log (as merge_log) of lists of strings: what sources gave, the list, its average confidence."""
    d = deduped.withColumn("so", ref.lookup(F.col("source"), {x: i for i, x in enumerate(ref.SOURCES)}, 9))
    kept = F.transform(F.array_sort(F.collect_list(F.when(F.col("kept"), F.struct("position", "value")))), lambda x: x.value)
    sure = F.sum(F.when(F.col("value") == F.col("won"), F.col("confidence")).otherwise(0.0))
    g = d.groupBy("candidate_key", "field").agg(_told(F.collect_list(F.struct("so", "item_ord", "source", F.substring("value", 1, 200).alias("value")))).alias("candidates"), kept.alias("l"), (sure / F.count_if("kept")).alias("score"), F.count("*").alias("n"))
    what = F.when(F.col("field") == "emails", "email(s)").when(F.col("field") == "phones", "phone number(s)").otherwise(F.col("field"))
    said = F.concat(F.lit("Merged and deduplicated "), F.size("l").cast("string"), F.lit(" "), what, F.lit(" from "), F.col("n").cast("string"), F.lit(" source entries."))
    return g.select("candidate_key", "field", "candidates", F.array_join("l", ", ").alias("winner"), F.round("score", 4).alias("score"), said.alias("reasoning"))


#: Of lists of records: what the log counts, and what it says of the count.
_LOGGED = {
    "skills": ("skills merged", "Merged and deduplicated {} skill(s) across all sources."),
    "experience": ("roles merged", "Merged and chronologically ordered {} work experience entry/entries."),
    "education": ("education records merged", "Merged and deduplicated {} education entry/entries."),
}


def record_log(observations: DataFrame, merged: DataFrame, field: str) -> DataFrame:
    """Entries of the merge log (as merge_log) of skills, experience or education. observations: of that field; merged:
    candidate_key and the list, whose records have a confidence."""
    o = observations.withColumn("so", ref.lookup(F.col("source"), {x: i for i, x in enumerate(ref.SOURCES)}, 9))
    get = lambda k, d: F.coalesce(F.element_at("entry", F.lit(k)), F.lit(d))
    shown = {"skills": F.col("value"), "experience": F.concat(get("title", "Unknown"), F.lit(" @ "), get("company", "Unknown")), "education": F.concat(get("degree", ""), F.lit(" @ "), get("institution", "Unknown"))}[field]
    c = o.groupBy("candidate_key").agg(_told(F.collect_list(F.struct("so", "item_ord", "source", F.substring(shown, 1, 200).alias("value")))).alias("candidates"))
    j = c.join(merged.select("candidate_key", F.col(field).alias("l")), "candidate_key", "left").withColumn("n", F.greatest(F.size("l"), F.lit(0)).cast("string"))
    mean = F.when(F.size("l") > 0, F.aggregate("l", F.lit(0.0), lambda a, x: a + x.confidence) / F.size("l")).otherwise(0.0)
    counted, said = _LOGGED[field]
    before, after = said.split("{}")
    return j.select("candidate_key", F.lit(field).alias("field"), "candidates", F.concat("n", F.lit(" " + counted)).alias("winner"), F.round(mean, 4).alias("score"), F.concat(F.lit(before), "n", F.lit(after)).alias("reasoning"))
