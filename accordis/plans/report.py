"""Reports on merged candidates: bands, summaries, explanations, batch figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def band(score: Column) -> Column:
    return F.when(score >= 0.9, "high").when(score >= 0.7, "medium").otherwise("low")


def gpa_display(gpa: Column) -> Column:
    return F.when(gpa > 10, F.concat(gpa.cast("string"), F.lit("%"))).otherwise(gpa.cast("string"))


def location_display(city: Column, state: Column, country: Column) -> Column:
    shown = F.when(country.isin("IN", "US", "GB") & city.isNotNull() & state.isNotNull(), F.lit(None)).otherwise(country)
    return F.array_join(F.filter(F.array(city, state, shown), lambda x: x.isNotNull()), ", ")


def explain(provenance: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """keys (default candidate_key, field), agreement and reason of the choice from provenance rows."""
    keys = keys or ["candidate_key", "field"]
    chosen = F.when(F.col("notes").contains("Selected"), F.col("source"))
    g = provenance.groupBy(*keys).agg(
        F.array_sort(F.collect_set(chosen)).alias("selected_sources"), F.count_distinct("source").alias("n_sources"), F.bool_or(F.col("confidence") <= 0.2).alias("any_bad"), F.bool_and(F.col("confidence") <= 0.2).alias("all_bad")
    )
    n = F.greatest(F.size("selected_sources"), F.lit(1))
    status = F.when(n >= 3, "Three-Source Agreement").when(n == 2, "Two-Source Agreement").otherwise("Single Source")
    reason = (
        F.when(F.col("all_bad"), "Invalid value rejected / Low confidence").when(F.col("any_bad"), "Highest source confidence (Invalid value rejected)")
        .when(n > 1, "Source agreement after normalization").when(F.col("n_sources") > 1, "Highest source confidence").otherwise("Only source available")
    )
    return g.select(*keys, F.array_join("selected_sources", " & ").alias("selected"), status.alias("agreement"), reason.alias("reason"))


def trail(provenance: DataFrame) -> DataFrame:
    """candidate_key, field and its records in order."""
    item = F.struct("source", "method", "raw_value", "normalized_value", "confidence", "notes")
    return provenance.groupBy("candidate_key", "field").agg(F.array_sort(F.collect_list(item)).alias("records"))


def provenance_for(provenance: DataFrame, field: str) -> DataFrame:
    """The records of one field."""
    return provenance.where(F.col("field") == field)


def confidence_for(profiles: DataFrame, field: str) -> DataFrame:
    """candidate_key, score, sources and reasoning of one field."""
    return profiles.select("candidate_key", F.element_at("confidence_scores", F.lit(field)).alias("c")).where("c is not null").select("candidate_key", "c.*")


def source_counts(provenance: DataFrame) -> DataFrame:
    """candidate_key and how many sources gave something."""
    return provenance.groupBy("candidate_key").agg(F.count_distinct("source").alias("n_sources"))


def dashboard(results: DataFrame) -> DataFrame:
    """total, ok, errors, skipped and average confidence of a batch (status, overall_confidence)."""
    return results.agg(
        F.count("*").alias("total"), F.count_if(F.col("status") == "ok").alias("ok"), F.count_if(F.col("status") == "error").alias("errors"), F.count_if(F.col("status") == "skipped").alias("skipped"),
        F.round(F.avg(F.when(F.col("status") == "ok", F.col("overall_confidence"))), 4).alias("avg_confidence"),
    )


def confidence_summary(profiles: DataFrame, defaults: dict[str, float] | None = None) -> DataFrame:
    """candidate_key, field, score: fixed values where a field is there and has no score of its own."""
    d = {"emails": 0.90, "phones": 0.85, "location": 0.80, "headline": 0.80} if defaults is None else defaults
    items = [F.struct(F.lit(f).alias("field"), F.coalesce(F.element_at("confidence_scores", F.lit(f))["score"], F.when(F.col(f).isNotNull(), F.lit(v))).alias("score")) for f, v in d.items()]
    mean = F.aggregate("skills", F.lit(0.0), lambda a, s: a + s.confidence) / F.size("skills")
    items += [F.struct(F.lit(f).alias("field"), F.element_at("confidence_scores", F.lit(f))["score"].alias("score")) for f in ("full_name", "years_experience", "links")]
    items.append(F.struct(F.lit("skills").alias("field"), F.when(F.size("skills") > 0, mean).alias("score")))
    return profiles.select("candidate_key", F.inline(F.array(*items))).where("score is not null")


def zip_slots(*inputs: DataFrame) -> DataFrame:
    """Inputs of one index each (index, and a value column of its own) beside each other; missing ones are null."""
    out = inputs[0]
    for i in inputs[1:]:
        out = out.join(i, "index", "full_outer")
    return out
