"""Observations that arrive as a stream: only candidates that a batch touches are merged again (an extension)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: Parts of the store by hash of the candidate; a batch reads those that its candidates fall into.
BUCKETS = 256


def consolidate_stream(observations: DataFrame, store: str, merge: Callable[[DataFrame], DataFrame], out: str, checkpoint: str):
    """Appends each micro-batch to `store` (Parquet by batch and bucket of candidates) and writes the merged rows of its
    candidates to out/batch=N. A batch that is run again overwrites its own folders, so results are exactly once."""

    def one(batch: DataFrame, number: int) -> None:
        spark, at = batch.sparkSession, f"{store}/batch={number}"
        batch.withColumn("bucket", F.pmod(F.hash("candidate_key"), F.lit(BUCKETS))).write.mode("overwrite").partitionBy("bucket").parquet(at)
        schema = T.StructType([*batch.schema.fields, T.StructField("bucket", T.IntegerType())])
        fresh = spark.read.schema(schema).parquet(at)
        buckets = [r["bucket"] for r in fresh.select("bucket").distinct().collect()]
        # Folders of later batches may be there after a failure.
        known = spark.read.schema(T.StructType([*schema.fields, T.StructField("batch", T.LongType())])).option("basePath", store).parquet(f"{store}/batch=*").where((F.col("batch") <= number) & F.col("bucket").isin(buckets))
        touched = fresh.select("candidate_key").distinct()
        merge(known.drop("batch", "bucket").join(touched, "candidate_key", "left_semi")).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return observations.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(merged: DataFrame, keys: list[str]) -> DataFrame:
    """The newest row of each key of the merged batches (a column batch)."""
    values = [c for c in merged.columns if c not in (*keys, "batch")]
    return merged.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("v")).select(*keys, "v.*")
