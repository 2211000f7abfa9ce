"""Repeated keys found without a row for each: units of texts send packed distinct keys to key ranges, which answer.

A unit is some megabytes of texts of one task. It sends each range of keys one packed row of its distinct keys, so a
key held by a third of all rows arrives once from each unit, not once from each row. A range sorts what it got and
answers each unit; units put answers and their own payload together. Both exchanges are of few, packed rows.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from accordis.llm import text as tx
from accordis.llm.shared import map_arrow, written

U = np.uint64
UNIT_BYTES = 6 << 20
RANGE_BYTES = 12 << 20  # text for each range of keys
MOST_RANGES = 1 << 18
RANGE_SHARE = 256  # bytes of a unit's text for each range at least: with many ranges units grow, so that letters do not become rows of a key or two
SCHEMA = "unit long, range int, body binary, docs binary"
LOW = -(1 << 63)


@dataclass
class Held:
    """Arrays of the texts of a unit so far; `doc` numbers texts inside the unit."""

    ids: list = field(default_factory=list)
    hashes: list = field(default_factory=list)
    parts: list = field(default_factory=list)
    docs: int = 0
    size: int = 0


def pack(**arrays: np.ndarray) -> bytes:
    """Arrays of one length, or of different ones, as one binary value."""
    head = [np.array([len(arrays)], np.int64).tobytes()]
    for a in arrays.values():
        head.append(np.array([a.dtype.itemsize * (a.shape[1] if a.ndim > 1 else 1) * len(a)], np.int64).tobytes())
    return b"".join(head + [np.ascontiguousarray(a).tobytes() for a in arrays.values()])


def unpack(body: bytes, *kinds: str) -> list[np.ndarray]:
    n = int(np.frombuffer(body, np.int64, 1)[0])
    sizes = np.frombuffer(body, np.int64, n, 8)
    out, at = [], 8 * (n + 1)
    for size, kind in zip(sizes.tolist(), kinds, strict=True):
        out.append(np.frombuffer(body, np.uint8, size, at).view(kind))
        at += size
    return out


def places(ids: np.ndarray, hashes: np.ndarray, doc: np.ndarray, pos: np.ndarray, key: np.ndarray, keys: int) -> tuple[np.ndarray, ...]:
    """Places of keys (numbers from 0) in a unit, in the order of id, hash of the text and position: whether a place is
    its key's first; and for each key the position and text of the first, and whether there are two. Repeated rows
    (equal id and text) have the same places."""
    by = np.lexsort((hashes, ids))
    rank = np.zeros(len(ids), np.int64)
    rank[by[1:]] = np.cumsum((ids[by[1:]] != ids[by[:-1]]) | (hashes[by[1:]] != hashes[by[:-1]]))
    place = (rank[doc] << 32) + pos
    low, high = np.full(keys, np.iinfo(np.int64).max), np.full(keys, -1)
    np.minimum.at(low, key, place)
    np.maximum.at(high, key, place)
    return place == low[key], low & 0xFFFFFFFF, high > low, by[np.searchsorted(rank[by], low >> 32)]


#: cut(data, offs) -> arrays of keyed places of a step, with "doc" (rising) and "key" (uint64) among them.
Cut = Callable[[np.ndarray, np.ndarray], dict[str, np.ndarray]]


def sent(docs: DataFrame, cut: Cut, letter: Callable[[dict[str, np.ndarray], np.ndarray, int], Iterator[tuple[int, bytes, bytes]]], payload: Callable[[dict[str, np.ndarray]], bytes], tag: str) -> tuple[DataFrame, int]:
    """Writes the letters of all units to all ranges, and each unit's payload (range -1).

    letter(places, ids, ranges) yields (range, body, docs); places has the texts' "hashes" too. A unit's name is a random
    number: letters are written once, so that none is made again under another name."""
    base = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(LOW)).alias("id"), F.xxhash64(F.col("text").cast("string")).alias("th"), F.col("text").cast("string").alias("text"))
    size = int(docs.agg(F.sum(F.octet_length(F.col("text").cast("string")))).first()[0] or 0)
    ranges = min(MOST_RANGES, max(1, size // RANGE_BYTES))
    most = max(UNIT_BYTES, RANGE_SHARE * ranges)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Held()

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal held
            if held.docs:
                ids, hashes = np.concatenate(held.ids), np.concatenate(held.hashes)
                places = {k: np.concatenate([p[k] for p in held.parts]) for k in held.parts[0]}
                name = int.from_bytes(os.urandom(8), "big") >> 1
                places["hashes"] = hashes
                rows = [(r, body, who) for r, body, who in letter(places, ids, ranges)]
                rows.append((-1, payload(places), pack(ids=ids, hashes=hashes)))
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(rows), pa.int64()), pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())], ["unit", "range", "body", "docs"])
            held = Held()

        for b in it:
            for lo, hi, data, offs in tx.steps(b.column(2)):
                places = cut(data, offs)
                places["doc"] = places["doc"] + held.docs
                held.ids.append(b.column(0).slice(lo, hi - lo).to_numpy())
                held.hashes.append(b.column(1).slice(lo, hi - lo).to_numpy())
                held.parts.append(places)
                held.docs, held.size = held.docs + hi - lo, held.size + len(data)
                if held.size >= most or held.docs >= 60_000:
                    yield from flush()
        yield from flush()

    return written(map_arrow(base, run, SCHEMA), tag), ranges


def answered(letters: DataFrame, match: Callable[[list[bytes], list[bytes]], list[bytes]], assemble: Callable[[bytes, bytes, dict[int, bytes]], pa.Table], schema: str, kinds: pa.Schema) -> DataFrame:
    """match(bodies, docs) of a range answers each letter; assemble(payload, docs, answers by range) ends a unit."""

    def ranges(t: pa.Table) -> pa.Table:
        units = t.column("unit").to_pylist()
        out = match(t.column("body").to_pylist(), t.column("docs").to_pylist())
        return pa.table({"unit": pa.array(units, pa.int64()), "range": t.column("range"), "body": pa.array(out, pa.binary()), "docs": pa.nulls(len(units), pa.binary())})

    def units(t: pa.Table) -> pa.Table:
        rows = dict(zip(t.column("range").to_pylist(), zip(t.column("body").to_pylist(), t.column("docs").to_pylist(), strict=True), strict=True))
        body, who = rows.pop(-1)
        return assemble(body, who, {r: b for r, (b, _) in rows.items()}).cast(kinds)

    found = letters.where("range >= 0").groupBy("range").applyInArrow(ranges, SCHEMA)
    return letters.where("range < 0").unionByName(found).groupBy("unit").applyInArrow(units, schema)
