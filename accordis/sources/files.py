"""Files in and out: JSON documents, binary résumés with a pluggable text extractor, JSON and ZIP results."""

from __future__ import annotations

import io
import json
import re
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_json_documents(spark: SparkSession, path: str) -> DataFrame:
    """candidate_key (the file's path) and doc (its text), one row a file."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("candidate_key"), F.col("value").alias("doc"))


def read_json_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.sha2("value", 256).alias("candidate_key"), F.col("value").alias("doc"))


def read_binary(spark: SparkSession, path: str, pattern: str = "*.pdf") -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select(F.col("path").alias("candidate_key"), F.col("content"))


def plain_text(content: bytes) -> str:
    """The default extractor: text that is stored as such; a PDF or OCR library can be plugged in instead."""
    return content.decode("utf-8", "replace") if content and not content.startswith(b"%PDF") else ""


def extract_text(files: DataFrame, cheap: Callable[[bytes], str] = plain_text, costly: Callable[[bytes], str] | None = None, least: int = 100) -> DataFrame:
    """candidate_key and text: the cheap extractor's result if it has over `least` characters, else the costly one's."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            out = []
            for content in b.column(1).to_pylist():
                text = cheap(content or b"")
                out.append(costly(content or b"") if costly and len(text.strip()) <= least else text)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], ["candidate_key", "text"])

    return files.select("candidate_key", "content").mapInArrow(run, "candidate_key string, text string")


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_merge_log(log: DataFrame, path: str) -> None:
    """The log as a table by candidate; unlike a file that each candidate overwrites, it keeps all."""
    log.write.mode("overwrite").parquet(path)


def zip_profiles(profiles: DataFrame, most: int = 10_000) -> bytes:
    """A ZIP for download of one JSON file a successful profile (candidate_id, full_name, json and, if there, status).

    It is put together on the driver. More than `most` profiles are an error; write_profiles() takes any number."""
    good = profiles.where("status = 'ok'") if "status" in profiles.columns else profiles
    if good.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} profiles: use write_profiles()")
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for r in good.toLocalIterator():
            name = re.sub("/", "-", re.sub(" ", "_", r["full_name"] or "unknown"))
            z.writestr(f"candidate_{r['candidate_id'][:8]}_{name}.json", json.dumps(json.loads(r["json"]), indent=2, ensure_ascii=False))
    return out.getvalue()


def write_profiles(profiles: DataFrame, path: str) -> None:
    """The JSON of any number of profiles, a compressed line each, written by the executors."""
    profiles.select("json").write.mode("overwrite").option("compression", "gzip").text(path)
