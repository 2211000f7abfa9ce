"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming search, exact weighted similarity."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations
from math import log
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from accordis.llm import text as tx
from accordis.llm.shared import column_place, dropped, map_arrow, written

U = np.uint64
K = 5
#: Words end at white space and at ASCII punctuation; letters of other scripts are words' parts.
BREAK = tx.SPACE | ~(np.isin(np.arange(256), list(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")) | (np.arange(256) >= 128))
ITEM_BYTES = 8 << 20  # of benchmark text that one index holds
#: Bits of a fingerprint, and how many may differ. A shingle's vector has the length of its weight's root, so two
#: multisets of weighted similarity s have a cosine of at least 2 s / (1 + s): 27.3 degrees at most at s = 0.8, by which
#: 0.1515 of the bits differ: 77.6 of 512, with a standard deviation of 8.1. Over 103 of them differ once in 1,000.
BITS, RADIUS = 512, 103
#: Blocks of 19 or 20 bits. Of 26 blocks one has at most 3 of 103 differing bits. Items stand under block values within
#: ITEM_FLIPS bits of theirs, windows look under those within the other flips: together 3. 4.1 % of random pairs pass.
BLOCKS, FLIPS, ITEM_FLIPS = 26, RADIUS // 26, 1
EDGES = [BITS * i // BLOCKS for i in range(BLOCKS + 1)]
PIECE = 4096  # shingles, or windows, whose rows of BITS numbers are held at once
_GAUSS = np.array([round(40 * NormalDist().inv_cdf((i + 0.5) / 256)) for i in range(256)], np.int8)
_EPS = 1e-9


def item_shingles(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, tuple]:
    data = tx.LOWER[data]
    starts, ends, first = tx.words(data, offs, BREAK)
    g, doc = tx.grams(tx.spans_hash(tx.prefix(data), starts, ends), first, K)
    return g, np.searchsorted(doc, np.arange(len(offs))), (starts, ends, first)


def directions(h: np.ndarray, k: np.ndarray | int = 0) -> np.ndarray:
    """A row of BITS numbers, normally distributed, for the k-th occurrence (from 0) of each shingle."""
    x = tx.mix(h + np.asarray(k).astype(U) * tx.LANE[40])
    return _GAUSS[tx.mix(x[:, None] + tx.LANE[None, : BITS // 8]).view(np.uint8)]


def roots(weights: np.ndarray) -> np.ndarray:
    return np.round(64 * np.sqrt(weights)).astype(np.int64)


def fingerprints(h: np.ndarray, root: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """SimHash (rows of BITS booleans) of the windows of `size` shingles that start at `at` (rising).

    Whole numbers are summed, so a window has the same bits wherever it stands. Rows for shingles are held PIECE at a
    time. A shingle that a window repeats has a direction of its own for each occurrence, as similarity counts them."""
    need = np.unique(np.concatenate([at, at + size]))
    sums, total = np.zeros((len(need), BITS), np.int64), np.zeros(BITS, np.int64)
    for a in range(int(need[0]), int(need[-1]), PIECE):
        z = min(a + PIECE, int(need[-1]))
        part = np.cumsum(directions(h[a:z]) * root[a:z, None], axis=0)
        rows = slice(int(np.searchsorted(need, a, "right")), int(np.searchsorted(need, z, "right")))
        sums[rows] = total + part[need[rows] - a - 1]
        total = total + part[-1]
    v = sums[np.searchsorted(need, at + size)] - sums[np.searchsorted(need, at)]
    # Occurrences of a shingle in the order of places: which one is it, and how many are before a window.
    lo, hi = int(at[0]), int(at[-1]) + size
    _, group = np.unique(h[lo:hi], return_inverse=True)
    order = np.argsort(group, kind="stable")
    begin = np.flatnonzero(np.concatenate([[True], np.diff(group[order]) > 0]))
    if len(begin) < len(order):
        first = np.repeat(begin, np.diff(np.concatenate([begin, [len(order)]])))
        rank, last = np.zeros(len(group), np.int64), np.full(len(group), -1)
        rank[order] = np.arange(len(order)) - first
        last[order[1:]] = np.where(np.diff(group[order]) == 0, order[:-1], -1)
        place = group[order] * np.int64(len(group) + 1) + order
        again = np.flatnonzero((last >= 0) & (np.arange(len(group)) - last < size))
        for i, s in enumerate((at - lo).tolist()):
            x = again[np.searchsorted(again, s) : np.searchsorted(again, s + size)]
            x = x[last[x] >= s]
            for y in range(0, len(x), PIECE):
                j = x[y : y + PIECE]
                before = np.searchsorted(place, group[j] * np.int64(len(group) + 1) + s) - begin[group[j]]
                more = directions(h[lo + j], rank[j] - before).astype(np.int64) - directions(h[lo + j])
                v[i] += (more * root[lo + j, None]).sum(0)
    return v > 0


def block_values(bits: np.ndarray) -> np.ndarray:
    return np.column_stack([bits[:, a:z] @ (1 << np.arange(z - a)) for a, z in zip(EDGES, EDGES[1:], strict=False)]).astype(U)


def packed(bits: np.ndarray) -> np.ndarray:
    return np.packbits(bits, axis=1).view(U)


def flips(width: int, most: int) -> np.ndarray:
    """Masks of at most `most` of `width` bits."""
    return np.array([sum(1 << b for b in c) for n in range(most + 1) for c in combinations(range(width), n)], U)


@dataclass
class Index:
    """Items, their distinct shingles (places in the vocabulary, with counts), and the classes of items by size that
    hold a shingle. Arrays only, a broadcast of some 20 bytes a shingle of ITEM_BYTES of text."""

    ids: np.ndarray
    kind: np.ndarray  # an item's class
    mass: np.ndarray  # weight of an item's shingles
    own: tuple[np.ndarray, np.ndarray, np.ndarray]  # item's first entry, places, counts
    vocabulary: np.ndarray
    weights: np.ndarray
    top: float  # weight of a shingle that an item doesn't hold
    held: tuple[np.ndarray, np.ndarray]  # vocabulary's first entry, classes
    sizes: np.ndarray  # shingles of a class's items
    least_mass: np.ndarray
    prints: np.ndarray
    values: np.ndarray
    name: str = field(default_factory=lambda: uuid.uuid4().hex)

    @classmethod
    def of(cls, items: list[tuple[int, str]], holders: tuple[np.ndarray, np.ndarray], total: int) -> Index | None:
        """holders: shingles that several items hold, and how many; others are held by one."""
        ids, rows = [], []
        for lo, hi, data, offs in tx.steps(pa.array([t for _, t in items], pa.string())):
            g, first, _ = item_shingles(data, offs)
            for i in range(hi - lo):
                if first[i + 1] > first[i]:
                    ids.append(items[lo + i][0])
                    rows.append(g[first[i] : first[i + 1]])
        if not ids:
            return None
        vocab = np.unique(np.concatenate(rows))
        many = np.ones(len(vocab))
        at = np.searchsorted(vocab, holders[0])
        many[at] = np.maximum(holders[1], 1)
        weights, top = np.log1p(max(total, 1) / many), log(1 + max(total, 1))
        sizes, kind = np.unique([len(r) for r in rows], return_inverse=True)
        place, count, mass, bits = [], [], [], []
        for r in rows:
            u, c = np.unique(r, return_counts=True)
            place.append(np.searchsorted(vocab, u))
            count.append(c)
            mass.append(float((weights[place[-1]] * c).sum()))
            bits.append(fingerprints(r, roots(weights[np.searchsorted(vocab, r)]), np.zeros(1, np.int64), len(r))[0])
        first = np.concatenate([[0], np.cumsum([len(p) for p in place])])
        flat = np.concatenate(place)
        both = np.unique(flat * len(sizes) + np.repeat(kind, np.diff(first)))
        least = np.full(len(sizes), np.inf)
        np.minimum.at(least, kind, mass)
        bits = np.array(bits)
        return cls(np.array(ids), kind, np.array(mass), (first, flat.astype(np.int32), np.concatenate(count).astype(np.int32)), vocab, weights, top, (np.searchsorted(both // len(sizes), np.arange(len(vocab) + 1)), (both % len(sizes)).astype(np.int32)), sizes, least, packed(bits), block_values(bits))


class Hamming:
    """Multi-index: items under the values of each block, those of few differing bits included."""

    def __init__(self, index: Index):
        self.kind, self.prints = index.kind.astype(U), index.prints
        keys, items = [], []
        for j, (a, z) in enumerate(zip(EDGES, EDGES[1:], strict=False)):
            near = flips(z - a, ITEM_FLIPS)
            keys.append(self._key(self.kind[:, None], j, index.values[:, j, None] ^ near[None, :]).ravel())
            items.append(np.repeat(np.arange(len(self.kind)), len(near)))
        keys, items = np.concatenate(keys), np.concatenate(items)
        order = np.argsort(keys, kind="stable")
        self.keys, self.items = keys[order], items[order].astype(np.int32)
        # One bit in eight or fewer is set: most looks end here.
        self.shift = U(64 - min(26, max(16, int(8 * len(keys)).bit_length())))
        self.seen = np.zeros(1 << (64 - int(self.shift)), bool)
        self.seen[self._slot(self.keys)] = True
        self.masks = {w: flips(w, FLIPS - ITEM_FLIPS) for w in {z - a for a, z in zip(EDGES, EDGES[1:], strict=False)}}

    @staticmethod
    def _key(kind: np.ndarray, block: int, value: np.ndarray) -> np.ndarray:
        return (kind << U(25)) | U(block << 20) | value

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key * tx.MUL) >> self.shift).astype(np.int64)

    def passed(self, kind: int, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row of values, item) that differ in at most FLIPS bits of some block, each once."""
        found = []
        for j, (a, z) in enumerate(zip(EDGES, EDGES[1:], strict=False)):
            key = self._key(np.full((1, 1), kind, U), j, values[:, j, None] ^ self.masks[z - a][None, :])
            row, look = np.nonzero(self.seen[self._slot(key)])
            key = key[row, look]
            lo = np.searchsorted(self.keys, key)
            n = np.searchsorted(self.keys, key, "right") - lo
            at = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum()) if len(n) else np.zeros(0, np.int64)
            found.append(np.repeat(row, n) * np.int64(len(self.kind)) + self.items[at])
        both = np.unique(np.concatenate(found))
        return both // len(self.kind), both % len(self.kind)

    def near(self, kind: int, bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, item) of a class whose fingerprints differ in at most RADIUS bits: all of them."""
        row, item = self.passed(kind, block_values(bits))
        ok = np.bitwise_count(packed(bits)[row] ^ self.prints[item]).sum(1) <= RADIUS
        return row[ok], item[ok]


class Scanner:
    """Finds similar windows in a step of texts; made once in a Python worker."""

    def __init__(self, index: Index, least: float):
        self.index, self.least, self.hamming = index, least, Hamming(index)
        self.table = np.zeros(1 << 20, bool)
        self.table[(index.vocabulary >> U(44)).astype(np.int64)] = True

    def windows(self, n: int, place: np.ndarray, where: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
        """(class, size, starts) of the windows of a text of n shingles (a text shorter than the class's items: all of
        it) that can be similar to an item of the class.

        where, place: known shingles' positions, and places in the vocabulary. What a window shares with an item weighs
        at most k, the weight of its shingles that items of the class hold, and each other shingle adds `top` to the
        union: the similarity is at most k / (k + others x top), and k / the least item's weight. Nothing is lost."""
        x, (first, classes) = self.index, self.index.held
        many = first[place + 1] - first[place]
        at = np.repeat(first[place] - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum())
        kind, pos, weight = classes[at], np.repeat(where, many), np.repeat(x.weights[place], many)
        enough = np.bincount(kind, weight, len(x.sizes)) >= self.least * x.least_mass - _EPS
        sel = np.flatnonzero(enough[kind])
        if not len(sel):
            return
        sel = sel[np.lexsort((pos[sel], kind[sel]))]
        kind, pos, weight = kind[sel], pos[sel], weight[sel]
        size = np.minimum(x.sizes[kind], n)
        # Runs of shingles of a class of which neighbours fit into one window.
        cut = np.flatnonzero(np.concatenate([[True], (kind[1:] != kind[:-1]) | (pos[1:] - pos[:-1] >= size[1:])]))
        for a, z in zip(cut.tolist(), [*cut[1:].tolist(), len(kind)], strict=True):
            c, m, need = int(kind[a]), int(size[a]), self.least * x.least_mass[kind[a]] - _EPS
            if weight[a:z].sum() < need:
                continue
            lo, hi = max(0, int(pos[a]) - m + 1), min(n, int(pos[z - 1]) + m)
            own, known = np.zeros(hi - lo + 1), np.zeros(hi - lo + 1, np.int64)
            own[pos[a:z] - lo + 1], known[pos[a:z] - lo + 1] = weight[a:z], 1
            own, known = np.cumsum(own), np.cumsum(known)
            k, others = own[m:] - own[:-m], m - (known[m:] - known[:-m])
            ok = np.flatnonzero((k >= need) & (k + _EPS >= self.least * (k + others * x.top)))
            if len(ok):
                yield c, m, ok + lo

    def similarity(self, item: int, window: np.ndarray) -> float:
        """Weighted Jaccard similarity of multisets: an item's shingles weigh by rarity, others as the rarest."""
        x, (first, place, count) = self.index, self.index.own
        own, n = place[first[item] : first[item + 1]], count[first[item] : first[item + 1]]
        u, c = np.unique(window, return_counts=True)
        at = np.minimum(np.searchsorted(x.vocabulary[own], u), len(own) - 1)
        hit = x.vocabulary[own[at]] == u
        w, m = x.weights[own[at[hit]]], n[at[hit]]
        both = float((w * np.minimum(c[hit], m)).sum())
        return both / (x.mass[item] + float((w * np.maximum(c[hit] - m, 0)).sum()) + x.top * int(c[~hit].sum()))

    def best(self, item: int, at: np.ndarray, size: int, h: np.ndarray) -> tuple[float, int]:
        """The greatest exact similarity (at least `least`) of windows with an item and the first start that has it.
        Windows go by an upper bound that ignores how often a shingle occurs, until none can be better."""
        x, (first, place, _) = self.index, self.index.own
        own = place[first[item] : first[item + 1]]
        lo = int(at[0])
        part = h[lo : int(at[-1]) + size]
        where = np.minimum(np.searchsorted(x.vocabulary[own], part), len(own) - 1)
        hit = x.vocabulary[own[where]] == part
        c = np.concatenate([[0.0], np.cumsum(np.where(hit, x.weights[own[where]], 0.0))])
        n = np.concatenate([[0], np.cumsum(hit)])
        both = np.minimum(c[at - lo + size] - c[at - lo], x.mass[item])
        bound = both / (x.mass[item] + x.top * (size - (n[at - lo + size] - n[at - lo])))
        best, start = 0.0, -1
        for i in np.lexsort((at, -bound)).tolist():
            if bound[i] < max(best, self.least) - _EPS:
                break
            s = self.similarity(item, h[at[i] : at[i] + size])
            if s >= self.least and (s > best + 1e-12 or s > best - 1e-12 and at[i] < start):
                best, start = max(s, best), int(at[i])
        return best, start

    def text(self, h: np.ndarray, place: np.ndarray, where: np.ndarray) -> list[tuple[int, float, int, int]]:
        """(item, similarity, first shingle, shingles) of the best window of a text for each similar item."""
        found: dict[int, tuple[float, int, int]] = {}
        root = None
        for kind, size, at in self.windows(len(h), place, where):
            if root is None:
                root = np.full(len(h), roots(np.array([self.index.top]))[0])
                root[where] = roots(self.index.weights[place])
            # Windows of the same shingles are looked up once, at the first of them.
            lo = int(at[0])
            c = np.concatenate([np.zeros(1, U), np.cumsum(tx.mix(h[lo : int(at[-1]) + size] + tx.LANE[41]))])
            _, one = np.unique(c[at - lo + size] - c[at - lo], return_index=True)
            at = at[np.sort(one)]
            pairs = []
            for i in range(0, len(at), PIECE):
                row, item = self.hamming.near(kind, fingerprints(h, root, at[i : i + PIECE], size))
                pairs.append((row + i, item))
            row, item = (np.concatenate(p) for p in zip(*pairs, strict=True))
            for i in np.unique(item).tolist():
                s, start = self.best(i, at[row[item == i]], size, h)
                if start >= 0 and (i not in found or s > found[i][0] + 1e-12):
                    found[i] = (s, start, size)
        return [(i, *v) for i, v in sorted(found.items())]

    def scan(self, data: np.ndarray, offs: np.ndarray) -> Iterator[tuple[int, int, int, int, float]]:
        """(text, item id, first and last byte + 1, similarity): the best window for each text and item."""
        g, first, (starts, ends, wfirst) = item_shingles(data, offs)
        maybe = np.flatnonzero(self.table[(g >> U(44)).astype(np.int64)])
        v = self.index.vocabulary
        place = np.minimum(np.searchsorted(v, g[maybe]), len(v) - 1)
        real = v[place] == g[maybe]
        maybe, place = maybe[real], place[real]
        if not len(maybe):
            return
        docs, begin = np.unique(np.searchsorted(first, maybe, "right") - 1, return_index=True)
        for doc, i, j in zip(docs.tolist(), begin.tolist(), [*begin[1:].tolist(), len(maybe)], strict=True):
            a, z = first[doc], first[doc + 1]
            for item, s, start, size in self.text(g[a:z], place[i:j], maybe[i:j] - a):
                word = wfirst[doc] + start
                yield doc, int(self.index.ids[item]), int(starts[word]), int(ends[word + size + K - 2]), s


_scanners: dict[tuple[str, float], Scanner] = {}


def _scanner(index, least: float) -> Scanner:
    """The scanner of a broadcast index; a Python worker keeps the last one for its next tasks."""
    key = (index.value.name, least)
    if key not in _scanners:
        _scanners.clear()
        _scanners[key] = Scanner(index.value, least)
    return _scanners[key]


def _shared(items: DataFrame) -> DataFrame:
    """h and how many items hold it, of the shingles that more than one item holds."""
    return map_arrow(items.select("text"), _vocabulary, "h long").groupBy("h").agg(F.count("*").alias("c")).where("c > 1")


def _vocabulary(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in it:
        for _, _, data, offs in tx.steps(b.column(0)):
            g, first, _ = item_shingles(data, offs)
            own = [np.unique(g[a:z]) for a, z in zip(first[:-1], first[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([*own, np.zeros(0, U)]).astype(U).view(np.int64))], ["h"])


def indexes(benchmark: DataFrame) -> Iterator[Index]:
    """The benchmark in parts of about ITEM_BYTES of text, by item id: each is small enough to send to every worker, and
    a larger benchmark takes more passes over the documents. How many items hold a shingle is counted over the whole
    benchmark; of the counts a part takes those of its own shingles only, so what the driver holds is bounded, and as
    other shingles weigh as the rarest, weights don't depend on the parts."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("item_id is not null and text is not null").distinct()
    size, total = items.agg(F.sum(F.octet_length("text")), F.count("*")).first()
    n = max(1, -(-int(size or 0) // ITEM_BYTES))
    if not total:
        return
    shared = written(_shared(items), "shared")
    for i in range(n):
        part = items.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == i)
        rows = part.orderBy("item_id", "text").collect()
        p = shared.join(map_arrow(part.select("text"), _vocabulary, "h long").distinct(), "h", "left_semi").toPandas()
        index = Index.of([(r["item_id"], r["text"]) for r in rows], (p["h"].to_numpy(np.int64).view(U), p["c"].to_numpy(np.int64)), total)
        if index:
            yield index
    dropped(shared)


SCHEMA = "doc_id long, item_id long, start long, end long, similarity double"


def contaminated(docs: DataFrame, benchmark: DataFrame, *, least: float = 0.8) -> DataFrame:
    """doc_id, item_id, start, end (code points) and similarity: the best window of each document for each item.

    Texts are cut into lower-cased words at white space and ASCII punctuation, and into 5-word shingles. A window has
    as many shingles as the item (a shorter document is one window). An item's shingles weigh by their rarity among
    items, log(1 + items / holders); a window's other shingles weigh as the rarest. A window counts as contaminated at
    an exact weighted Jaccard similarity (of multisets) of at least `least`. Windows whose shingles weigh too little
    for that are left out, without loss; the others' SimHashes are looked up in a multi-index that returns every item
    of that size within RADIUS bits. At a similarity of exactly 0.8 one pair in 1,000 may be missed by its SimHash,
    more similar ones less often (measured in tests). Items of under 5 words, null items and null texts match nothing.
    Empty tables: no rows. Repeated documents give repeated rows, repeated items one. Ties: the first window. Other
    columns are ignored. A very long text is scanned whole, with memory for its words' hashes; SimHash rows are held
    PIECE at a time. Narrow: no shuffle of documents.
    """
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = None
    for index in indexes(benchmark):
        sent = docs.sparkSession.sparkContext.broadcast(index)

        def run(it: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            scanner = _scanner(sent, least)
            for b in it:
                for lo, _, data, offs in tx.steps(b.column(1)):
                    rows = list(scanner.scan(data, offs))
                    if rows:
                        cp = tx.code_points(data)
                        yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array([lo + r[0] for r in rows])), pa.array([r[1] for r in rows], pa.int64()), *(pa.array([int(cp[r[k]] - cp[offs[r[0]]]) for r in rows], pa.int64()) for k in (2, 3)), pa.array([r[4] for r in rows])], [x.split()[0] for x in SCHEMA.split(", ")])

        part = map_arrow(base, run, SCHEMA)
        out = part if out is None else out.unionByName(part)
    if out is None:
        return docs.sparkSession.createDataFrame([], SCHEMA)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, *, least: float = 0.8) -> DataFrame:
    """The documents, all columns, that hold no window similar to an item (cases: see contaminated); decided row by row,
    so null and repeated ids are no matter."""
    column = column_place(docs, "text")
    for index in indexes(benchmark):
        sent = docs.sparkSession.sparkContext.broadcast(index)

        def run(it: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            scanner = _scanner(sent, least)
            for b in it:
                keep = np.ones(b.num_rows, bool)
                for lo, _, data, offs in tx.steps(b.column(column)):
                    for r in scanner.scan(data, offs):
                        keep[lo + r[0]] = False
                yield b.filter(pa.array(keep))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
