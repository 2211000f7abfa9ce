"""Suffix-array dedup: sparse suffixes at minimiser positions, sorted, compared with neighbours, extended to both sides."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from accordis.llm import text as tx
from accordis.llm.shared import arrow_batches, column_place, plain_names
from accordis.llm.units import LOW, answered, pack, places, sent, unpack

U = np.uint64
K = 6  # words of a minimiser
LEAST_WORDS = 30  # words of a passage; any so many equal words hold a window of LEAST_WORDS - K + 1 K-grams, whose least is retained
CODE = 12  # bits of a word beside a minimiser
NONE = 255
_POS = U((1 << 22) - 1)


def minimisers(g: np.ndarray, doc: np.ndarray, window: int = LEAST_WORDS - K + 1) -> np.ndarray:
    """Indices of the K-grams that are the least of some window of their text (a shorter text: of all of it)."""
    n = len(g)
    if not n:
        return np.zeros(0, np.int64)
    low = np.arange(n, dtype=U) & _POS
    key = (g & ~_POS) | low
    m, size = key.copy(), 1
    while size < window:
        step = min(size, window - size)
        m[: n - step] = np.minimum(m[: n - step], m[step:])
        size += step
    full = np.flatnonzero(doc[: n - window + 1] == doc[window - 1 :]) if n >= window else np.zeros(0, np.int64)
    at = full + ((m[full] - full.astype(U)) & _POS).astype(np.int64)
    begin = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
    length = np.diff(np.concatenate([begin, [n]]))
    least = np.minimum.reduceat(key, begin)
    short = begin + ((least - begin.astype(U)) & _POS).astype(np.int64)
    return np.unique(np.concatenate([at, short[length < window]]))


def narrow(codes: np.ndarray) -> np.ndarray:
    """Rows of 12-bit numbers, an even count, as bytes; order by bytes is order by numbers."""
    x, y = codes[:, 0::2], codes[:, 1::2]
    return np.stack([x >> 4, (x & 15) << 4 | y >> 8, y & 255], axis=2).astype(np.uint8).reshape(len(codes), codes.shape[1] // 2 * 3)


def wide(raw: np.ndarray, width: int) -> np.ndarray:
    b = raw.reshape(-1, width // 2, 3).astype(np.uint16)
    return np.stack([b[:, :, 0] << 4 | b[:, :, 1] >> 4, (b[:, :, 1] & 15) << 8 | b[:, :, 2]], axis=2).reshape(len(b), width)


def _even(reach: int) -> int:
    return reach + reach % 2


def _cut(least_words: int) -> Callable[[np.ndarray, np.ndarray], dict[str, np.ndarray]]:
    reach, window = least_words - K, least_words - K + 1

    def run(data: np.ndarray, offs: np.ndarray) -> dict[str, np.ndarray]:
        data = tx.LOWER[data]
        starts, ends, first = tx.words(data, offs)
        h = tx.spans_hash(tx.prefix(data), starts, ends)
        g, doc = tx.grams(h, first, K)
        at = minimisers(g, doc, window)
        at = at[np.diff(first)[doc[at]] >= least_words]
        doc_at = doc[at]
        pos = at - np.searchsorted(doc, doc_at)  # K-grams of a text are its words from the first on
        word, none = first[doc_at] + pos, len(h)
        code = np.concatenate([np.maximum(tx.mix(h + tx.LANE[11]) >> U(64 - CODE), U(1)).astype(np.uint16), np.zeros(1, np.uint16)])
        right = word[:, None] + K + np.arange(_even(reach))
        right = code[np.where(right < first[doc_at + 1][:, None], right, none)]
        left = word[:, None] - 1 - np.arange(_even(reach))
        left = code[np.where(left >= first[doc_at][:, None], left, none)]
        right[:, reach:] = left[:, reach:] = 0
        # Least hashes are small; mixed again they spread over the ranges.
        return {"doc": doc_at, "key": tx.mix(g[at] + tx.LANE[13]), "right": narrow(right), "left": narrow(left), "pos": pos.astype(np.uint32)}

    return run


def _columns(raw: np.ndarray) -> np.ndarray:
    """Rows of bytes as big-endian numbers, so that order by columns is order by bytes."""
    wide_ = np.zeros((len(raw), -(-raw.shape[1] // 8) * 8), np.uint8)
    wide_[:, : raw.shape[1]] = raw
    return wide_.view(">u8").astype(U)


def _letter(p: dict[str, np.ndarray], ids: np.ndarray, ranges: int) -> Iterator[tuple[int, bytes, bytes]]:
    """Distinct suffixes with their contexts by range of minimisers; equal ones of a unit go once, with their first place."""
    name = p["key"].copy()
    for side in ("right", "left"):
        c = _columns(p[side])
        for i in range(c.shape[1]):
            name = tx.mix(name + c[:, i] * tx.LANE[i + (side == "left") * 20])
    name = (p["key"] & ~U(0xFFFFFFFF)) | (name >> U(32))  # by minimiser, so that ranges are slices
    _, at, inverse = np.unique(name, return_index=True, return_inverse=True)
    p["index"] = inverse.astype(np.uint32)
    p["lead"], low, twice, owner = places(ids, p["hashes"], p["doc"], p["pos"], inverse, len(at))
    key = p["key"][at]
    edges = np.searchsorted(key >> U(32), np.array([(1 << 32) * r // ranges for r in range(ranges)], U))
    for r, (a, z) in enumerate(zip(edges, [*edges[1:], len(key)], strict=True)):
        if z > a:
            who, where = np.unique(owner[a:z], return_inverse=True)
            yield r, pack(key=key[a:z], right=p["right"][at[a:z]], left=p["left"][at[a:z]], twice=twice[a:z], at=where.astype(np.uint16), pos=low[a:z].astype(np.uint32)), pack(ids=ids[who], hashes=p["hashes"][who])


def _payload(p: dict[str, np.ndarray]) -> bytes:
    n = np.bincount(p["doc"]) if len(p["doc"]) else np.zeros(0, np.int64)
    return pack(n=n.astype(np.int32), index=p["index"], pos=p["pos"], lead=p["lead"])


def _common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Words in which rows of contexts agree from the start; a 0 is the end of a text."""
    differ = (a != b) | (a == 0)
    return np.where(differ.any(1), differ.argmax(1), a.shape[1])


def extended(key: np.ndarray, right: np.ndarray, left: np.ndarray, rank: np.ndarray, twice: np.ndarray, reach: int) -> tuple[np.ndarray, ...]:
    """For each suffix, words to the left and to the right of its minimiser that stretches of K + reach words hold which
    are at two places or more, those of them that an earlier place holds (-1: none), and the least rank of such a place.

    Suffixes are sorted by minimiser and what follows; neighbours' common words bound the runs of suffixes that share r
    words to the right. In a run, those whose reach - r words to the left agree too hold the same stretch. This is done
    for every r, so all partners count, not the nearest alone, and no pairs are made."""
    n = len(key)
    hit_l, hit_r, cut_l, cut_r = (np.full(n, -1) for _ in range(4))
    least = rank.copy()
    order = np.argsort(key, kind="stable")
    same = key[order[1:]] == key[order[:-1]]
    some = np.concatenate([same, [False]]) | np.concatenate([[False], same]) if n else np.zeros(0, bool)
    busy = order[some | twice[order]]
    if not len(busy):
        return hit_l, hit_r, cut_l, cut_r, least
    words = _columns(narrow(right[busy]))
    busy = busy[np.lexsort((*(words[:, i] for i in reversed(range(words.shape[1]))), key[busy]))]
    a, b = busy[:-1], busy[1:]
    lcp = np.concatenate([[-1], np.where(key[a] == key[b], _common(right[a], right[b]), -1)])
    own_l, own_r = (np.where((x[busy, :reach] == 0).any(1), (x[busy, :reach] == 0).argmax(1), reach) for x in (left, right))
    before = np.zeros((reach + 1, len(busy)), U)  # of the first l words to the left
    for l in range(reach):
        before[l + 1] = tx.mix(before[l] + left[busy, l].astype(U) * tx.LANE[30] + tx.LANE[31])
    for r in range(reach + 1):
        run = np.cumsum(lcp < r)
        x = np.flatnonzero((own_r >= r) & (own_l >= reach - r) & ((np.bincount(run)[run] > 1) | twice[busy]))
        if not len(x):
            continue
        group = tx.mix(before[reach - r, x] + run[x].astype(U) * tx.LANE[32])
        by = np.argsort(group, kind="stable")
        x, group = x[by], group[by]
        begin = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
        size = np.diff(np.concatenate([begin, [len(x)]]))
        i = busy[x]
        low, high = np.minimum.reduceat(rank[i], begin), np.maximum.reduceat(rank[i], begin)
        many = np.repeat((high > low) | (np.add.reduceat(twice[i], begin) > 0), size)
        low = np.repeat(low, size)
        later = rank[i] > low
        for chosen, l_, r_ in ((i[many], hit_l, hit_r), (i[later], cut_l, cut_r)):
            l_[chosen], r_[chosen] = np.maximum(l_[chosen], reach - r), r
        least[i] = np.minimum(least[i], low)
    return hit_l, hit_r, cut_l, cut_r, least


def _match(least_words: int) -> Callable[[list[bytes], list[bytes]], list[bytes]]:
    reach = least_words - K

    def run(bodies: list[bytes], docs: list[bytes]) -> list[bytes]:
        size = _even(reach) // 2 * 3
        parts = [unpack(b, "<u8", "u1", "u1", "?", "<u2", "<u4") for b in bodies]
        key, twice, pos = (np.concatenate([p[i] for p in parts]) for i in (0, 3, 5))
        right, left = (wide(np.concatenate([p[i].reshape(-1, size) for p in parts]), _even(reach)) for i in (1, 2))
        owner, hashes = (np.concatenate([unpack(d, "<i8", "<i8")[i][p[4]] for d, p in zip(docs, parts, strict=True)]) for i in (0, 1))
        by = np.lexsort((pos, hashes, owner))
        rank = np.zeros(len(key), np.int64)
        rank[by[1:]] = np.cumsum((owner[by[1:]] != owner[by[:-1]]) | (hashes[by[1:]] != hashes[by[:-1]]) | (pos[by[1:]] != pos[by[:-1]]))
        hit_l, hit_r, cut_l, cut_r, least = extended(key, right, left, rank, twice, reach)
        first = owner[by[np.searchsorted(rank[by], least)]]
        whole_l, whole_r = (np.where((x[:, :reach] == 0).any(1), (x[:, :reach] == 0).argmax(1), reach) for x in (left, right))
        byte = lambda x: np.where(x < 0, NONE, x).astype(np.uint8)
        rows = np.column_stack([byte(x) for x in (hit_l, hit_r, cut_l, cut_r, whole_l, whole_r)])
        out, at = [], 0
        for p in parts:
            s = slice(at, at + len(p[0]))
            hit = hit_l[s] >= 0
            out.append(pack(n=np.array([len(hit)]), bits=np.packbits(hit), first=first[s][hit], reach=rows[s][hit]))
            at += len(p[0])
        return out

    return run


KINDS = ["doc_id", "th", "start_word", "end_word", "words", "first_doc_id"]


def _merged(start: np.ndarray, end: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unions of ranges that overlap or touch, rising, and the least of `first` in each."""
    if not len(start):
        return start, end, first
    order = np.argsort(start, kind="stable")
    start, end, first = start[order], end[order], first[order]
    far = np.maximum.accumulate(end)
    b = np.flatnonzero(np.concatenate([[True], start[1:] > far[:-1]]))
    return start[b], far[np.concatenate([b[1:], [len(start)]]) - 1], np.minimum.reduceat(first, b)


def _assemble(body: bytes, who: bytes, answers: dict[int, bytes]) -> pa.Table:
    n, index, pos, lead = unpack(body, "<i4", "<u4", "<u4", "?")
    ids, hashes = unpack(who, "<i8", "<i8")
    empty = pa.table({**{k: pa.array([], pa.int64()) for k in KINDS}, "duplicate": pa.array([], pa.bool_())})
    if not len(index):
        return empty
    first, rows = [], []
    for r in sorted(answers):
        size, bits, own, reach = unpack(answers[r], "<i8", "u1", "<i8", "u1")
        hit = np.unpackbits(bits)[: size[0]].astype(bool)
        f, x = np.zeros(len(hit), np.int64), np.full((len(hit), 6), NONE, np.uint8)
        f[hit], x[hit] = own, reach.reshape(-1, 6)
        first.append(f)
        rows.append(x)
    first, rows = np.concatenate(first)[index], np.concatenate(rows)[index].astype(np.int64)
    # Later places of a suffix in its unit lose all that is compared around it.
    hit_l, hit_r, cut_l, cut_r = (np.where(lead | (rows[:, 0] == NONE), rows[:, i], rows[:, 4 + i % 2]) for i in range(4))
    wide_ = np.repeat(np.arange(len(n)), n) << 40
    wide_ += pos
    hit = hit_l != NONE
    if not hit.any():
        return empty
    b, e, _ = _merged((wide_ - hit_l)[hit], (wide_ + K + hit_r)[hit], first[hit])
    goes = (cut_l != NONE) & hit
    x, z, low = _merged((wide_ - cut_l)[goes], (wide_ + K + cut_r)[goes], first[goes])
    # A row for each stretch of a passage that goes or stays.
    edge = np.unique(np.concatenate([b, e, x, z]))
    start, end = edge[:-1], edge[1:]
    inside = lambda lo, hi: np.searchsorted(lo, start, "right") > np.searchsorted(hi, start, "right")
    keep = inside(b, e)
    dup = inside(x, z)[keep]
    start, end = start[keep], end[keep]
    d = start >> 40
    own = ids[d]
    if dup.any():
        own[dup] = low[np.searchsorted(x, start[dup], "right") - 1]
    low, start, end = own, start & ((1 << 40) - 1), end - (d << 40)
    nulls = lambda x: pa.array(x, pa.int64(), mask=x == LOW)
    return pa.table({"doc_id": nulls(ids[d]), "th": pa.array(hashes[d]), "start_word": pa.array(start), "end_word": pa.array(end), "words": pa.array(end - start), "first_doc_id": nulls(low), "duplicate": pa.array(dup)})


def repeated_spans(docs: DataFrame, *, least_words: int = LEAST_WORDS) -> DataFrame:
    """doc_id, th (hash of the text), start_word, end_word (exclusive), words, first_doc_id and duplicate of repeated
    passages: all words in stretches of least_words words (K + 1 to 200) that occur at two places or more.

    Words are split at ASCII white space, A-Z lower-cased. Every stretch of least_words words holds a minimiser that
    depends on its words alone. Suffixes at minimisers are sorted and compared as far as any such stretch reaches
    (12-bit codes of the words around the minimiser: of stretches that differ in one word, one in 4,096 passes as
    equal). There is a row for each part of a passage that goes or stays: duplicate is true for words in a stretch that
    an earlier place holds (by doc_id, hash of the text, then word; in another document or in this one) and false where
    this place is the first. first_doc_id of a duplicate is the least id among the places that its stretches are at,
    else its own. A null doc_id is smaller than all and shown as null. Null, empty and short texts have no spans, an
    empty table no rows; other columns are ignored. Repeated rows (equal doc_id and text) are one document, which is no
    repeat of itself: each gives the rows that one would. A text, and the suffixes of one minimiser, meet in one task.
    """
    if not K < least_words <= 200:
        raise ValueError("least_words")
    letters, _ = sent(docs, _cut(least_words), _letter, _payload, "suffixes")
    schema = ", ".join(f"{k} long" for k in KINDS) + ", duplicate boolean"
    return answered(letters, _match(least_words), _assemble, schema, pa.schema([*((k, pa.int64()) for k in KINDS), ("duplicate", pa.bool_())]))


@plain_names
def deduplicated(docs: DataFrame, **options) -> DataFrame:
    """docs, all columns, without the duplicate spans (from a span's first word to its last, with what is between)."""
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(LOW))
    spans = repeated_spans(docs, **options).where("duplicate")
    cuts = spans.groupBy(key.alias("__id"), F.col("th").alias("__th")).agg(F.array_sort(F.collect_set(F.struct("start_word", "end_word"))).alias("__cuts"))
    out = docs.withColumns({"__id": key, "__th": F.xxhash64(F.col("text").cast("string"))}).join(cuts, ["__id", "__th"], "left")
    out = out.select(*[F.col(f"`{c}`") for c in docs.columns], "__cuts")
    column, last = column_place(docs, "text"), len(docs.columns)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            texts = b.column(column).to_pylist()
            for i, cut in enumerate(b.column(last).to_pylist()):
                if cut:
                    data = np.frombuffer(texts[i].encode(), np.uint8)
                    starts, ends, _ = tx.words(data, np.array([0, len(data)]))
                    at, pieces = 0, []
                    for c in cut:
                        pieces.append(data[at : starts[c["start_word"]]].tobytes())
                        at = int(ends[c["end_word"] - 1])
                    texts[i] = b"".join([*pieces, data[at:].tobytes()]).decode()
            columns = [pa.array(texts, b.column(column).type) if j == column else b.column(j) for j in range(last)]
            yield pa.RecordBatch.from_arrays(columns, b.schema.names[:last])

    arrow_batches(docs.sparkSession)
    return out.mapInArrow(run, docs.schema)
