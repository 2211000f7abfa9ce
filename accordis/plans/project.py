"""Configured output: selected and renamed fields, policies for missing ones, confidence and provenance attached."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DEFAULT_FIELDS = ["candidate_id", "full_name", "emails", "phones", "location", "links", "headline", "years_experience", "skills", "experience", "education", "provenance", "overall_confidence"]


@dataclass
class Projection:
    fields: list[str] = field(default_factory=lambda: list(DEFAULT_FIELDS))
    rename: dict[str, str] = field(default_factory=dict)
    include_confidence: bool = True
    include_provenance: bool = True
    missing_field_policy: str = "null"

    @classmethod
    def of(cls, config: dict | None) -> Projection:
        """From a dict: keys that start with _ and unknown ones are ignored; an unknown policy is null."""
        known = {k: v for k, v in (config or {}).items() if k in cls.__dataclass_fields__}
        if known.get("missing_field_policy", "null") not in ("null", "omit", "error"):
            known["missing_field_policy"] = "null"
        return cls(**known)


def _without(records: Column, kind: T.DataType, *gone: str) -> Column:
    """An array of structs without some of their fields."""
    kept = [f.name for f in kind.elementType.fields if f.name not in gone]
    return F.transform(records, lambda r: F.struct(*[r[k].alias(k) for k in kept]))


def shown(df: DataFrame, name: str) -> Column:
    """A field in the shape of the output: skills with aliases only where there are any, entries without confidence and
    source, links without an empty list; confidence scores by field."""
    c, kind = F.col(name), df.schema[name].dataType
    if name == "skills" and isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType):
        return F.transform(c, lambda s: F.struct(s["name"].alias("name"), s["confidence"].alias("confidence"), s["sources"].alias("sources"), F.when(F.size(s["aliases_found"]) > 0, s["aliases_found"]).alias("aliases")))
    if name in ("experience", "education") and isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType):
        return _without(c, kind, "confidence", "source")
    if name == "links" and isinstance(kind, T.StructType) and "other" in kind.names:
        return F.when(c.isNotNull(), F.struct(*[(F.when(F.size(c[k]) > 0, c[k]) if k == "other" else c[k]).alias(k) for k in kind.names]))
    return c


def _plan(df: DataFrame, p: Projection) -> dict[str, tuple[str, Column]]:
    """Output name: field and value; candidate_id first, then the fields in order; of two with one name the later stays."""
    out: dict[str, tuple[str, Column]] = {"candidate_id": ("candidate_id", F.col("candidate_id"))}
    for f in p.fields:
        if f == "candidate_id":
            continue
        there = f in df.columns and not (f == "provenance" and not p.include_provenance)
        out[p.rename.get(f, f)] = (f, shown(df, f) if there else F.lit(None).cast("string"))
    if p.include_confidence and "confidence_scores" in df.columns:
        out["confidence_scores"] = ("confidence_scores", F.col("confidence_scores"))
    if p.include_provenance and "provenance" not in p.fields and "provenance" in df.columns:
        out["provenance"] = ("provenance", F.col("provenance"))
    return out


def columns(df: DataFrame, p: Projection) -> list[Column]:
    out = []
    for name, (f, c) in _plan(df, p).items():
        if p.missing_field_policy == "error" and f in p.fields and f != "candidate_id":
            c = F.when(F.col("candidate_id").isNotNull() & c.isNull(), F.raise_error(F.lit(f"missing field: {f}"))).otherwise(c)
        out.append(c.alias(name))
    return out


def project(df: DataFrame, config: dict | None = None) -> DataFrame:
    """The configured columns (policy omit shows as null here; see project_json). Catalyst prunes what is not asked."""
    return df.select(*columns(df, Projection.of(config)))


def checked_json(df: DataFrame, config: dict | None = None) -> DataFrame:
    """candidate_id, json and missing: the first field that is missing under the policy error (then json is null).

    Inside a field, what is null has no key. A field without a value is null, or has no key under the policy omit."""
    p = Projection.of(config)
    plan = _plan(df, p)
    parts = []
    for name, (f, c) in plan.items():
        pair = F.to_json(F.struct(c.alias(name)), {"ignoreNullFields": "true"})
        null = F.lit(None if p.missing_field_policy == "omit" and f in p.fields else json.dumps(name, ensure_ascii=False) + ":null")
        parts.append(F.when(c.isNull(), null.cast("string")).otherwise(F.regexp_replace(pair, r"(?s)^\{(.*)\}$", "$1")))
    missing = F.lit(None).cast("string")
    if p.missing_field_policy == "error":
        missing = F.coalesce(*[F.when(c.isNull(), F.lit(f)) for f, c in plan.values() if f in p.fields and f != "candidate_id"], F.lit(None).cast("string"))
    whole = F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))
    return df.select("candidate_id", F.when(missing.isNull(), whole).alias("json"), missing.alias("missing"))


def project_json(df: DataFrame, config: dict | None = None) -> DataFrame:
    """candidate_id and json (see checked_json); under the policy error a missing field ends the query."""
    out = checked_json(df, config)
    return out.select("candidate_id", F.when(F.col("missing").isNotNull(), F.raise_error(F.concat(F.lit("missing field: "), F.col("missing")))).otherwise(F.col("json")).alias("json"))


def visible(df: DataFrame, hidden: list[str]) -> DataFrame:
    """Without hidden fields, in columns, provenance and confidence; years_experience never has the latter two."""
    out = df.drop(*hidden)
    gone = [*hidden, "years_experience"]
    if "provenance" in out.columns:
        out = out.withColumn("provenance", F.filter("provenance", lambda r: ~r["field"].isin(gone)))
    if "confidence_scores" in out.columns:
        out = out.withColumn("confidence_scores", F.map_filter("confidence_scores", lambda k, v: ~k.isin(gone)))
    return out
