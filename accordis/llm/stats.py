"""Statistics of whole documents, for the quality rules and the quality classifier: one pass, thin rows out."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from accordis.llm import text as tx
from accordis.llm.shared import arrow_batches, column_place, map_arrow

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: Ratios and logarithms that rules and kernels are learnt from.
FEATURES = ["log_words", "word_len", "symbol_rate", "dup_line_rate", "repeat_rate", "distinct_rate", "upper_rate", "digit_rate", "punct_rate", "wide_rate", "bang_rate", "bar_rate", "stop_rate", "line_words", "longest_word", "top_word_rate"]
STATS_SCHEMA = "doc_id long, " + ", ".join(f"{c} long" for c in BASE) + ", " + ", ".join(f"{c} double" for c in FEATURES)
_is = {k: np.isin(np.arange(256), list(v)) for k, v in {"symbol": b"#*$%&|<>", "digit": b"0123456789", "bang": b"!", "bar": b"|", "stop": b".?", "punct": b"!\"'(),-./:;?@[\\]^_`{}~+="}.items()}
_is["upper"] = (np.arange(256) >= 65) & (np.arange(256) < 91)


def _twice(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each entry: is its value there twice or more; and the positions of all but one of each value."""
    order = np.argsort(key, kind="stable")
    same = np.zeros(len(key) + 1, bool)
    k = key[order]
    same[1:-1] = k[1:] == k[:-1]
    out = np.zeros(len(key), bool)
    out[order] = same[1:] | same[:-1]
    return out, order[same[:-1]]


def document_stats(data: np.ndarray, offs: np.ndarray) -> dict[str, np.ndarray]:
    n = len(offs) - 1
    starts, ends, first = tx.words(data, offs)
    nw = np.diff(first)
    doc = np.repeat(np.arange(n), nw)
    pre = tx.prefix(data)
    h = tx.spans_hash(pre, starts, ends)
    lead = (data & 0xC0) != 0x80
    cp = np.zeros(len(data) + 1, np.int64)
    np.cumsum(lead, out=cp[1:])
    length = cp[ends] - cp[starts]
    salt = tx.mix(np.arange(1, n + 1, dtype=np.uint64))
    per = lambda where, weights=None: np.bincount(where, weights, n)
    # Lines with a word that equal an earlier one.
    cut = np.flatnonzero(data == 10)
    ls = np.unique(np.concatenate([offs[:-1], cut + 1]))
    ls = ls[ls < len(data)]
    ldoc = np.searchsorted(offs, ls, "right") - 1
    le = np.concatenate([ls[1:], [len(data)]])[: len(ls)]
    le = np.minimum(le, offs[ldoc + 1])
    le = le - (data[le - 1] == 10) * (le > ls)
    has = np.searchsorted(starts, le) > np.searchsorted(starts, ls)
    ls, le, ldoc = ls[has], le[has], ldoc[has]
    _, again = _twice(tx.spans_hash(pre, ls, le) ^ salt[ldoc]) if len(ls) else (None, np.zeros(0, int))
    dup_lines, lines = per(ldoc[again]), per(ldoc)
    # Words inside a 3-word window that is there twice or more.
    covered = np.zeros(len(h) + 2, bool)
    if len(h) >= 3:
        g, gdoc = tx.grams(h, first, 3)
        at = np.flatnonzero(doc[:-2] == doc[2:])
        twice = at[_twice(g ^ salt[gdoc])[0]] if len(g) else at
        for i in range(3):
            covered[twice + i] = True
    repeat = per(doc[covered[: len(h)]])
    # Distinct words and the commonest word's share.
    distinct, top = np.zeros(n), np.zeros(n)
    if len(h):
        key = np.sort((h & ~np.uint64(0xFFFF)) ^ salt[doc])
        order = np.argsort((h ^ salt[doc]), kind="stable")
        key = (h ^ salt[doc])[order]
        begin = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        runs = np.diff(np.concatenate([begin, [len(key)]]))
        wd = doc[order[begin]]
        distinct = per(wd)
        np.maximum.at(top, wd, runs)
    longest = np.zeros(n)
    np.maximum.at(longest, doc, length)
    chars = np.maximum(tx.within(lead, offs), 1)
    total = {k: tx.within(v[data], offs) for k, v in _is.items()}
    wide = tx.within(data >= 0xC0, offs)
    w = np.maximum(nw, 1)
    return {
        "n_words": nw, "word_chars": per(doc, length).astype(np.int64), "n_symbols": total["symbol"], "n_dup_lines": dup_lines, "n_repeat_words": repeat,
        "log_words": np.log1p(nw), "word_len": per(doc, length) / w, "symbol_rate": total["symbol"] / w, "dup_line_rate": dup_lines / np.maximum(lines, 1), "repeat_rate": repeat / w,
        "distinct_rate": distinct / w, "upper_rate": total["upper"] / chars, "digit_rate": total["digit"] / chars, "punct_rate": total["punct"] / chars, "wide_rate": wide / chars,
        "bang_rate": total["bang"] / w, "bar_rate": total["bar"] / w, "stop_rate": total["stop"] / w, "line_words": np.log1p(nw / np.maximum(lines, 1)), "longest_word": np.log1p(longest), "top_word_rate": top / w,
    }


def _batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in it:
        ids = batch.column(0)
        for lo, hi, data, offs in tx.steps(batch.column(1)):
            s = document_stats(data, offs)
            yield pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo).cast(pa.int64()), *(pa.array(s[c].astype(np.int64)) for c in BASE), *(pa.array(s[c].astype(np.float64)) for c in FEATURES)], ["doc_id", *BASE, *FEATURES])


def with_stats(docs: DataFrame) -> DataFrame:
    """doc_id, the base counts and the features of each document; a null text counts as an empty one."""
    return map_arrow(docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text"), _batches, STATS_SCHEMA)


def annotated(docs: DataFrame) -> DataFrame:
    """docs, all columns, with the statistics as __q_<name>; row by row, so null and repeated ids are no matter."""
    column = column_place(docs, "text")
    kind = StructType([*docs.schema.fields, *(StructField(f"__q_{c}", LongType() if c in BASE else DoubleType()) for c in BASE + FEATURES)])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for lo, hi, data, offs in tx.steps(batch.column(column)):
                s, part = document_stats(data, offs), batch.slice(lo, hi - lo)
                more = [pa.array(s[c].astype(np.int64 if c in BASE else np.float64)) for c in BASE + FEATURES]
                yield pa.RecordBatch.from_arrays([*part.columns, *more], [*part.schema.names, *(f"__q_{c}" for c in BASE + FEATURES)])

    arrow_batches(docs.sparkSession)
    return docs.mapInArrow(run, kind)
