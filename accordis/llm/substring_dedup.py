"""Substring dedup: chunks cut where a gear hash of the last bytes says so, found again by digest."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from accordis.llm import text as tx
from accordis.llm.shared import plain_names
from accordis.llm.units import LOW, answered, pack, places, sent, unpack

U = np.uint64
#: Random steps of the gear for each byte; the hash of 8 bits' depth depends on the last 8 bytes.
GEAR = (tx._splitmix(256, 4242) >> U(40)).astype(np.uint16)
DEPTH = 8
BITS = np.uint16(0x00F0)  # a cut where these bits are 0: one place in 16
LEAST = 8  # bytes from a candidate cut to the next that holds
MOST = 512  # bytes of a chunk without a cut


def gear(data: np.ndarray) -> np.ndarray:
    """h[i] = GEAR[b[i]] + 2 h[i - 1], of which the lowest 8 bits know the last 8 bytes only; by doubling."""
    h = GEAR[data]
    for k in (1, 2, 4):
        more = h.copy()
        more[k:] += h[:-k] << np.uint16(k)
        h = more
    return h


def chunk_starts(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """First bytes of all chunks, rising. A cut depends on the bytes just before it alone, so that text which is
    inserted elsewhere moves no other cuts; only chunks of over MOST bytes are cut by count."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64)
    cut = np.flatnonzero((gear(data) & BITS) == 0) + 1
    cut = cut[cut < n]
    cut = cut[(data[cut] & 0xC0) != 0x80]  # never inside a character
    begin = offs[np.searchsorted(offs, cut, "right") - 1]
    cut = cut[cut - begin >= DEPTH]  # before that, the hash knows the text before
    gap = np.diff(cut, prepend=-MOST)
    cut = cut[gap >= LEAST]
    starts = np.unique(np.concatenate([offs[:-1][np.diff(offs) > 0], cut]))
    size = np.diff(np.concatenate([starts, [n]]))
    long = np.flatnonzero(size > MOST)
    if len(long):
        more = [np.arange(starts[i] + MOST, starts[i] + size[i], MOST) for i in long.tolist()]
        more = np.concatenate(more)
        for _ in range(3):
            more -= (data[more] & 0xC0) == 0x80
        starts = np.unique(np.concatenate([starts, more]))
    return starts


def _cut(data: np.ndarray, offs: np.ndarray) -> dict[str, np.ndarray]:
    starts = chunk_starts(data, offs)
    ends = np.concatenate([starts[1:], [len(data)]])[: len(starts)]
    cp = tx.code_points(data)
    words, _, _ = tx.words(data, offs)
    at = np.searchsorted(words, np.concatenate([starts, [len(data)]]))
    key = tx.spans_hash(tx.prefix(data), starts, ends) + (ends - starts).astype(U) * tx.LANE[3]
    return {"doc": np.searchsorted(offs, starts, "right") - 1, "key": tx.mix(key), "chars": (cp[ends] - cp[starts]).astype(np.uint16), "words": np.minimum(np.diff(at), 65535).astype(np.uint16)}


def _letter(p: dict[str, np.ndarray], ids: np.ndarray, ranges: int) -> Iterator[tuple[int, bytes, bytes]]:
    """Distinct digests by range, whether the unit has one at two places, and the first document that has it here."""
    key, inverse = np.unique(p["key"], return_inverse=True)
    p["index"] = inverse.astype(np.uint32)
    begin = np.concatenate([[0], np.cumsum(np.bincount(p["doc"], minlength=len(ids)))])
    p["lead"], _, twice, owner = places(ids, p["hashes"], p["doc"], np.arange(len(inverse)) - begin[p["doc"]], inverse, len(key))
    edges = np.searchsorted(key, np.array([(1 << 64) * r // ranges for r in range(ranges)], U))
    for r, (a, z) in enumerate(zip(edges, [*edges[1:], len(key)], strict=True)):
        if z > a:
            who, at = np.unique(owner[a:z], return_inverse=True)
            yield r, pack(key=key[a:z], twice=twice[a:z], at=at.astype(np.uint16)), pack(ids=ids[who], hashes=p["hashes"][who])


def _payload(p: dict[str, np.ndarray]) -> bytes:
    n = np.bincount(p["doc"]) if len(p["doc"]) else np.zeros(0, np.int64)
    return pack(n=n.astype(np.int32), index=p["index"], chars=p["chars"], words=p["words"], lead=np.packbits(p["lead"]))


def _match(bodies: list[bytes], docs: list[bytes]) -> list[bytes]:
    """For each letter: which of its digests are anywhere at two places, which of these are here first, and the id that
    has the first."""
    parts = [unpack(b, "<u8", "?", "<u2") for b in bodies]
    key, twice = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    owner, hashes = (np.concatenate([unpack(d, "<i8", "<i8")[i][p[2]] for d, p in zip(docs, parts, strict=True)]) for i in (0, 1))
    order = np.lexsort((hashes, owner, key))
    k, o, h = key[order], owner[order], hashes[order]
    begin = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
    size = np.diff(np.concatenate([begin, [len(k)]]))
    own = (o == np.repeat(o[begin], size)) & (h == np.repeat(h[begin], size))
    many = (np.add.reduceat(~own, begin) > 0) | (np.add.reduceat(twice[order], begin) > 0)
    many_all, mine, first = np.zeros(len(key), bool), np.zeros(len(key), bool), np.zeros(len(key), np.int64)
    many_all[order], mine[order], first[order] = np.repeat(many, size), own, np.repeat(o[begin], size)
    out, at = [], 0
    for p in parts:
        part = slice(at, at + len(p[0]))
        m = many_all[part]
        out.append(pack(bits=np.packbits(m), mine=np.packbits(mine[part]), first=first[part][m], n=np.array([len(m)])))
        at += len(p[0])
    return out


def _assemble(least_words: int):
    kinds = ["doc_id", "th", "start", "end", "words", "first_doc_id", "duplicate"]

    def run(body: bytes, who: bytes, answers: dict[int, bytes]) -> pa.Table:
        n, index, chars, words, lead = unpack(body, "<i4", "<u4", "<u2", "<u2", "u1")
        ids, hashes = unpack(who, "<i8", "<i8")
        again, first, mine = [], [], []
        for r in sorted(answers):
            bits, here, own, size = unpack(answers[r], "u1", "u1", "<i8", "<i8")
            m, x = (np.unpackbits(v)[: size[0]].astype(bool) for v in (bits, here))
            f = np.zeros(len(m), np.int64)
            f[m] = own
            again.append(m)
            first.append(f)
            mine.append(x)
        if not len(index):
            return pa.table({k: pa.array([], pa.bool_() if k == "duplicate" else pa.int64()) for k in kinds})
        again, first, mine = (np.concatenate(x)[index] for x in (again, first, mine))
        doc = np.repeat(np.arange(len(n)), n)
        end = np.cumsum(chars.astype(np.int64))
        base = np.concatenate([[0], end])[np.concatenate([[0], np.cumsum(n)])[:-1]]
        start = end - chars - base[doc]
        dup = again & ~(mine & np.unpackbits(lead)[: len(index)].astype(bool))
        # Neighbouring repeated chunks are one passage; a row for each stretch of it that goes or stays.
        new_island = again & ~(np.concatenate([[False], again[:-1]]) & (doc == np.concatenate([[-1], doc[:-1]])))
        island = np.cumsum(new_island) - 1
        at = np.flatnonzero(again)
        size = np.bincount(island[at], words[at], minlength=1) if len(at) else np.zeros(1)
        at = at[size[island[at]] >= least_words] if len(at) else at
        if not len(at):
            return pa.table({k: pa.array([], pa.bool_() if k == "duplicate" else pa.int64()) for k in kinds})
        cut = np.concatenate([[True], (island[at[1:]] != island[at[:-1]]) | (dup[at[1:]] != dup[at[:-1]])])
        b = np.flatnonzero(cut)
        e = np.concatenate([b[1:], [len(at)]]) - 1
        own = ids[doc[at[b]]]
        low = np.minimum.reduceat(first[at], b)
        nulls = lambda x: pa.array(x, pa.int64(), mask=x == LOW)
        return pa.table({"doc_id": nulls(own), "th": pa.array(hashes[doc[at[b]]]), "start": pa.array(start[at[b]]), "end": pa.array(start[at[e]] + chars[at[e]]), "words": pa.array(np.add.reduceat(words[at].astype(np.int64), b)), "first_doc_id": nulls(low), "duplicate": pa.array(dup[at[b]])})

    return run


def repeated_spans(docs: DataFrame, *, least_words: int = 25) -> DataFrame:
    """doc_id, th (hash of the text), start, end (code points), words, first_doc_id and duplicate of repeated passages.

    A passage is a run of chunks that each occur elsewhere (in any document, or again in this one), of at least
    least_words words (those that begin in its chunks); the edges of a repeated text that fill no chunk are not
    counted, so a text of 50 words shows about 41. duplicate is true for stretches that dedup removes and false where
    this place is the first (by doc_id, hash of the text, then place); first_doc_id is the smallest id that holds one of
    the chunks. A null doc_id is smaller than all and shown as null. Null and empty texts have no chunks, an empty table
    no rows; other columns are ignored. Repeated rows (equal doc_id and text) are one document, which is no repeat of
    itself: each gives the rows that one would. A text's chunks must fit a task's memory.
    """
    letters, _ = sent(docs, _cut, _letter, _payload, "chunks")
    schema = "doc_id long, th long, start long, end long, words long, first_doc_id long, duplicate boolean"
    kinds = pa.schema([*((k, pa.int64()) for k in ("doc_id", "th", "start", "end", "words", "first_doc_id")), ("duplicate", pa.bool_())])
    return answered(letters, _match, _assemble(least_words), schema, kinds)


@plain_names
def deduplicated(docs: DataFrame, **options) -> DataFrame:
    """docs, all columns, without the duplicate stretches of repeated passages."""
    return without(docs, repeated_spans(docs, **options).where("duplicate"))


def without(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """docs with spans (doc_id, th, start, end; rising code points that don't overlap) cut out of text."""
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(LOW))
    cuts = spans.groupBy(key.alias("__id"), F.col("th").alias("__th")).agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("__cuts"))
    out = docs.withColumns({"__id": key, "__th": F.xxhash64(F.col("text").cast("string"))}).join(cuts, ["__id", "__th"], "left")
    zero = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))
    step = F.aggregate("__cuts", zero, lambda a, c: F.struct(F.concat(a.out, F.substring(F.col("text"), (a.at + 1).cast("int"), (c.start - a.at).cast("int"))).alias("out"), c.end.alias("at")))
    rest = F.concat(step.out, F.substring(F.col("text"), (step.at + 1).cast("int"), F.lit(1 << 30)))
    return out.withColumn("text", F.when(F.col("__cuts").isNull(), F.col("text")).otherwise(rest)).select(*[F.col(f"`{c}`") for c in docs.columns])
