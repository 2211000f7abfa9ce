"""N-gram Jaccard join: a blocked sparse product of documents by shingles, bounded by set sizes, then components.

Documents with equal shingle sets are one row of the incidence matrix (its `sid`). Shingles are ordered by how
many sets hold them (the most frequent ones, which are counted, last) and then by hash; two sets of Jaccard
similarity t share one of the first n - ceil(t n) + 1 shingles of each, so only those columns are multiplied. The
columns are dealt into blocks; a block's task sorts its postings, and a posting list that equals another's is
multiplied once. Short lists give their pairs. Long ones (and hot columns, which are dealt by row instead) are
resolved in rounds: some members are compared with all others of a list that no link has joined yet, and then
leave it; lists whose members are all joined are done. So no list emits all its pairs unless its members really
differ, and no link between different components is lost. A pair is dropped when its sizes or its 2048-bit parity
sketches bound the overlap below the threshold; what is left is counted exactly on whole sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from accordis.llm import text as tx
from accordis.llm.shared import dropped, lean, map_arrow, one, plain_names, resolve, small, written

U = np.uint64
K = 5
TOKEN_BITS = 52  # above them, the row of a step
MASK = U((1 << TOKEN_BITS) - 1)
SKETCH = 2048
SMALL_LIST = 6
ENTRIES = 400_000  # postings of a block, on average
MOST_BLOCKS = 1 << 18
HELD = 16  # postings of a task for each block at least before it sends them: rows of many postings at any size
HOT = 20_000  # sets that hold a column from which on it is dealt by row


def shingle_sets(data: np.ndarray, offs: np.ndarray, k: int = K) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys (row << 52 | token) of the distinct shingles of each text, and each row's first key."""
    data = tx.LOWER[data]
    starts, ends, first = tx.words(data, offs)
    g, doc = tx.shingles(tx.spans_hash(tx.prefix(data), starts, ends), first, k)
    key = np.sort((doc.astype(U) << U(TOKEN_BITS)) | (g >> U(64 - TOKEN_BITS)))
    key = key[np.concatenate([[True], key[1:] != key[:-1]])] if len(key) else key
    return key, np.searchsorted(key, np.arange(len(offs), dtype=U) << U(TOKEN_BITS))


def _sum(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    c = np.zeros(len(values) + 1, values.dtype)
    np.cumsum(values, out=c[1:])
    return c[first[1:]] - c[first[:-1]]


def set_ids(key: np.ndarray, first: np.ndarray) -> np.ndarray:
    """An id for each row's set; equal for equal sets."""
    return tx.mix(_sum(tx.mix((key & MASK) + U(1)), first) + np.diff(first).astype(U) * tx.LANE[7]).view(np.int64)


def _bin(values: np.ndarray, width: int) -> pa.Array:
    """Rows of a contiguous array as binary values of equal length."""
    raw = np.ascontiguousarray(values)
    n = len(raw)
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((np.arange(n + 1) * width).astype(np.int32)), pa.py_buffer(raw.tobytes())])


def _profiles(k: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "th", "n", "sid", "sketch"]
        for batch in it:
            ids = batch.column(0)
            for lo, hi, data, offs in tx.steps(batch.column(2)):
                key, first = shingle_sets(data, offs, k)
                m, n = hi - lo, np.diff(first)
                row = np.repeat(np.arange(m), n)
                odd = np.bincount(row * SKETCH + (key & U(SKETCH - 1)).astype(np.int64), minlength=m * SKETCH) & 1
                sketch = np.packbits(odd.astype(bool).reshape(m, SKETCH), axis=1)
                yield pa.RecordBatch.from_arrays([ids.slice(lo, m), batch.column(1).slice(lo, m), pa.array(n.astype(np.int64)), pa.array(set_ids(key, first)), _bin(sketch, SKETCH // 8)], names)

    return run


def _counted(k: int, low: int, ranges: int):
    """Tokens under `low` and in how many different sets of a unit they are, packed by range; 5 bytes a token."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        seen: set[int] = set()

        def flush() -> Iterator[pa.RecordBatch]:
            if not held:
                return
            t = np.sort(np.concatenate(held))
            held.clear()
            begin = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]])) if len(t) else np.zeros(0, int)
            c = np.minimum(np.diff(np.concatenate([begin, [len(t)]])), 255).astype(np.uint8) if len(t) else np.zeros(0, np.uint8)
            t = t[begin]
            edge = np.searchsorted(t, np.array([low * r // ranges for r in range(ranges)], U)).tolist()
            raw = np.column_stack([t.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :7], c])
            parts = [(r, raw[a:z].tobytes()) for r, (a, z) in enumerate(zip(edge, [*edge[1:], len(t)], strict=True)) if z > a]
            yield pa.RecordBatch.from_arrays([pa.array([r for r, _ in parts], pa.int32()), pa.array([x for _, x in parts], pa.binary())], ["range", "tokens"])

        size = 0
        for batch in it:
            for _, _, data, offs in tx.steps(batch.column(0)):
                key, first = shingle_sets(data, offs, k)
                fresh = []
                for s in set_ids(key, first).tolist():
                    fresh.append(s not in seen)
                    seen.add(s)
                t = key[np.repeat(np.array(fresh, bool), np.diff(first))] & MASK
                held.append(t[t < U(low)])
                size += len(data)
                if size > max(8 << 20, 256 * ranges):
                    yield from flush()
                    size = 0
        yield from flush()

    return run


def _frequent(least: int):
    def run(t: pa.Table) -> pa.Table:
        raw = np.concatenate([np.frombuffer(x.as_py(), np.uint8).reshape(-1, 8) for x in t.column("tokens")])
        wide = raw.copy()
        wide[:, 7] = 0
        tok, c = wide.view("<u8").ravel(), raw[:, 7].astype(np.int64)
        order = np.argsort(tok)
        tok, c = tok[order], c[order]
        begin = np.flatnonzero(np.concatenate([[True], tok[1:] != tok[:-1]]))
        c = np.add.reduceat(c, begin)
        return pa.table({"token": pa.array(tok[begin][c >= least].view(np.int64)), "c": pa.array(c[c >= least])})

    return run


def frequent_tokens(texts: DataFrame, k: int, shingles: int, share: float, most: int = 1_000_000, least: int = SMALL_LIST + 1) -> tuple[np.ndarray, np.ndarray]:
    """At most `most` tokens (8 MB of a broadcast) that the most sets hold, of at least `least` sets, and their counts.

    Only tokens of the low `share` of the hash order are counted: prefixes are taken from there. The order that
    follows is exact for any choice; counting keeps what many documents share out of the prefixes."""
    low = int(share * (1 << TOKEN_BITS))
    ranges = min(MOST_BLOCKS, max(1, int(shingles * share) // (2 * ENTRIES)))
    t = map_arrow(texts, _counted(k, low, ranges), "range int, tokens binary").groupBy("range").applyInArrow(_frequent(least), "token long, c long")
    t = written(t, "frequent")
    if t.count() > most:
        # The counts' histogram (a few hundred steps) says from where on; a top-k would bring every task's own to the driver.
        step = F.floor(F.log2("c") * 8)
        left, cut = most, 1 << 30
        for r in sorted(t.groupBy(step.alias("s")).count().collect(), key=lambda r: -r["s"]):
            if r["count"] > left:
                break
            left, cut = left - r["count"], r["s"]
        t = t.where(step >= cut)
    p = t.toPandas().sort_values("token")
    return p["token"].to_numpy(np.int64).view(U), p["c"].to_numpy(np.int64)


def prefix_length(n: np.ndarray, num: int, den: int) -> np.ndarray:
    return n - (num * n + den - 1) // den + 1


def _postings(k: int, num: int, den: int, heavy: np.ndarray, counts: np.ndarray, blocks: int, hot: int, salts: int):
    """Packed (token, sid) of the columns that count, by block; columns of hot tokens are dealt by row."""
    rank = np.minimum(counts, (1 << 20) - 1).astype(U)
    is_hot = counts >= hot

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        table = np.zeros(1 << 20, bool)
        table[(heavy >> U(32)).astype(np.int64)] = True
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def flush() -> Iterator[pa.RecordBatch]:
            if not held:
                return
            block, tok, sid = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            order = np.argsort(block, kind="stable")
            block, tok, sid = block[order], tok[order], sid[order]
            begin = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]])) if len(block) else []
            ends = [*begin[1:], len(block)]
            yield pa.RecordBatch.from_arrays([pa.array(block[begin], pa.int32()), pa.array([tok[a:z].tobytes() for a, z in zip(begin, ends, strict=True)], pa.binary()), pa.array([sid[a:z].tobytes() for a, z in zip(begin, ends, strict=True)], pa.binary())], ["block", "tokens", "sids"])

        size = 0
        for batch in it:
            for _, _, data, offs in tx.steps(batch.column(0)):
                key, first = shingle_sets(data, offs, k)
                n = np.diff(first)
                sid = set_ids(key, first)
                fresh = np.zeros(len(n), bool)
                for i, s in enumerate(sid.tolist()):
                    if n[i] and s not in seen:
                        seen.add(s)
                        fresh[i] = True
                key, n, sid = key[np.repeat(fresh, n)], n[fresh], sid[fresh]
                if not len(n):
                    continue
                tok = key & MASK
                row = np.repeat(np.arange(len(n), dtype=U), n)
                order = tok >> U(1)
                if len(heavy):
                    maybe = np.flatnonzero(table[(tok >> U(32)).astype(np.int64)])
                    at = np.minimum(np.searchsorted(heavy, tok[maybe]), len(heavy) - 1)
                    hit = heavy[at] == tok[maybe]
                    maybe, at = maybe[hit], at[hit]
                    order[maybe] = U(1 << 51) | (rank[at] << U(31)) | (tok[maybe] & U((1 << 31) - 1))
                order = np.sort((row << U(TOKEN_BITS)) | order)
                begin = np.concatenate([[0], np.cumsum(n)])
                keep = np.arange(len(order)) - np.repeat(begin[:-1], n) < np.repeat(prefix_length(n, num, den), n)
                t, s = tx.mix(order[keep] & MASK), sid[row[keep].astype(np.int64)]
                block = ((t >> U(32)) % U(blocks)).astype(np.int32)
                if is_hot.any():
                    # As ordered tokens hide the originals, hot ones are known by the same order value.
                    hots = tx.mix(U(1 << 51) | (rank[is_hot] << U(31)) | (heavy[is_hot] & U((1 << 31) - 1)))
                    h = np.isin(t, hots)
                    block[h] = blocks + ((s[h].view(U) >> U(20)) % U(salts)).astype(np.int32)
                held.append((block, t.astype(np.uint32), s))
                size += len(t)
                if size > max(2 * ENTRIES, HELD * blocks):
                    yield from flush()
                    size = 0
        yield from flush()

    return run


def _lists(blocks: int):
    """Pairs of a block's short posting lists, members of its long ones."""

    def run(group: pa.Table) -> pa.Table:
        block = group.column("block")[0].as_py()
        t = np.concatenate([np.frombuffer(x.as_py(), np.uint32) for x in group.column("tokens")])
        s = np.concatenate([np.frombuffer(x.as_py(), np.int64) for x in group.column("sids")])
        order = np.lexsort((s, t))
        t, s = t[order], s[order]
        new = np.concatenate([[True], (t[1:] != t[:-1]) | (s[1:] != s[:-1])])
        t, s = t[new], s[new]
        if block >= blocks:  # rows of hot columns: their lists are longer than what is here
            return pa.table({"list": pa.array(t.astype(np.int64)), "a": pa.array(s), "b": pa.nulls(len(s), pa.int64())})
        begin = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]]))
        size = np.diff(np.concatenate([begin, [len(t)]]))
        c = np.zeros(len(s) + 1, U)
        np.cumsum(tx.mix(s.view(U)), out=c[1:])
        name = tx.mix(c[begin + size] - c[begin] + size.astype(U))
        two = size >= 2
        _, at = np.unique(name[two], return_index=True)
        begin, size, name = begin[two][at], size[two][at], name[two][at]
        left, right = [], []
        for m in range(2, SMALL_LIST + 1):
            rows = begin[size == m]
            for i in range(m):
                for j in range(i + 1, m):
                    left.append(s[rows + i])
                    right.append(s[rows + j])
        pairs = np.unique(np.column_stack([np.concatenate(left), np.concatenate(right)]), axis=0) if left else np.zeros((0, 2), np.int64)
        long = size > SMALL_LIST
        at = np.repeat(begin[long] - np.concatenate([[0], np.cumsum(size[long])[:-1]]) if long.any() else np.zeros(0, int), size[long]) + np.arange(size[long].sum())
        name = np.repeat(name[long].view(np.int64), size[long])
        return pa.table({"list": pa.array(np.concatenate([name, np.zeros(len(pairs), np.int64)]), mask=np.arange(len(name) + len(pairs)) >= len(name)), "a": pa.array(np.concatenate([s[at], pairs[:, 0]])), "b": pa.array(np.concatenate([np.zeros(len(at), np.int64), pairs[:, 1]]), mask=np.arange(len(name) + len(pairs)) < len(name))})

    return run


def _bound(num: int, den: int):
    """Sizes and parity sketches that allow the threshold: the symmetric difference has at least the bits that differ."""

    def run(n: np.ndarray, m: np.ndarray, d: np.ndarray) -> np.ndarray:
        # overlap = (n + m - d) / 2 and union = (n + m + d) / 2 for a symmetric difference of d
        return (den * (n + m - d) >= num * (n + m + d)) & (den * np.minimum(n, m) >= num * np.maximum(n, m))

    return run


def _pack_sets(k: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for _, _, data, offs in tx.steps(b.column(0)):
                key, first = shingle_sets(data, offs, k)
                low = (key & MASK).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]
                raw = np.ascontiguousarray(low).tobytes()
                yield pa.RecordBatch.from_arrays([pa.array(set_ids(key, first)), pa.array([raw[5 * a : 5 * z] for a, z in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)], pa.binary())], ["sid", "tokens"])

    return run


def _overlaps(num: int, den: int):
    """Exact overlap of two sets; 40 bits of each token tell it apart within a pair."""

    def wide(v: bytes) -> np.ndarray:
        out = np.zeros((len(v) // 5, 8), np.uint8)
        out[:, :5] = np.frombuffer(v, np.uint8).reshape(-1, 5)
        return out.view("<u8").ravel()

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            ok, last, x = [], None, None
            for p, q in zip(b.column("x"), b.column("y"), strict=True):
                p = p.as_py()
                if p != last:
                    last, x = p, wide(p)
                both = np.sort(np.concatenate([x, wide(q.as_py())]))
                o = int((both[1:] == both[:-1]).sum())
                ok.append(den * o >= num * (len(both) - o))
            yield b.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return run


class _Verifier:
    """Exact overlaps of pairs; sets are taken from the texts once and kept."""

    def __init__(self, docs: DataFrame, reps: DataFrame, k: int, num: int, den: int):
        self.docs, self.reps, self.k, self.num, self.den = docs, reps, k, num, den
        self.sets: DataFrame | None = None

    def verify(self, pairs: DataFrame) -> DataFrame:
        few = small(pairs, 50_000)
        pairs = one(pairs)
        need = pairs.select(F.explode(F.array("a", "b")).alias("sid")).distinct()
        if self.sets is not None:
            need = need.join(self.sets.select("sid"), "sid", "left_anti")
        need = F.broadcast(need) if few else need  # at most two rows a pair
        need = written(self.reps.select("sid", "th").join(need, "sid", "left_semi").select("th"), "need")
        found = map_arrow(self.docs.join(lean(need), "th", "left_semi").select("text"), _pack_sets(self.k), "sid long, tokens binary").dropDuplicates(["sid"])
        found = written(found, "sets")
        self.sets = found if self.sets is None else self.sets.unionByName(found)
        p = (F.broadcast(pairs) if few else pairs).join(self.sets.selectExpr("sid as b", "tokens as y"), "b").join(self.sets.selectExpr("sid as a", "tokens as x"), "a")
        out = written(map_arrow(p, _overlaps(self.num, self.den), "a long, b long"), "links")
        dropped(need)
        return out


def classes(docs: DataFrame, k: int = K, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, th (hash of the text), n (size of its set), sid and root (equal within a component) of each document."""
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.col("text").cast("string")).alias("th"), F.col("text").cast("string").alias("text"))
    prof = written(map_arrow(base, _profiles(k), "doc_id long, th long, n long, sid long, sketch binary"), "profiles")
    total = prof.agg(F.count("*"), F.sum("n")).first()
    slim = prof.select("doc_id", "th", "n", "sid")
    if not total[1]:
        return slim.withColumn("root", F.col("sid"))
    # A tenth more than a prefix, so that what replaces frequent tokens in it is counted too.
    heavy, counts = frequent_tokens(base.select("text"), k, int(total[1]), min(1.0, (den - num) / den + 0.1))
    blocks = min(MOST_BLOCKS, max(8, int(total[1]) * (den - num) // den // ENTRIES))
    packed = map_arrow(base.select("text"), _postings(k, num, den, heavy, counts, blocks, HOT, max(8, blocks // 2)), "block int, tokens binary, sids binary")
    lists = written(packed.groupBy("block").applyInArrow(_lists(blocks), "list long, a long, b long"), "lists")
    reps = written(prof.where("n > 0").groupBy("sid").agg(F.min("th").alias("th"), F.first("n").alias("n"), F.first("sketch").alias("sketch")), "reps")
    check = _Verifier(base, reps, k, num, den)
    roots = resolve(lists.where("list is not null").selectExpr("list", "a as node"), lists.where("list is null").select("a", "b"), reps.selectExpr("sid as node", "n", "sketch"), _bound(num, den), check.verify)
    return slim.join(roots, F.col("sid") == F.col("node"), "left").select("doc_id", "th", "n", "sid", F.coalesce("root", "sid").alias("root"))


def jaccard_join(docs: DataFrame, *, k: int = K, num: int = 80, den: int = 100) -> DataFrame:
    """doc_id, n_shingles and component_id (the smallest doc_id reachable by links) of each document.

    docs: doc_id, text; other columns are ignored. Two documents link when den x intersection >= num x union of
    their sets of distinct k-word shingles (A-Z lower-cased; fewer words: the whole sequence as one shingle). Null,
    empty or blank text: no shingles, a component of its own. Repeated rows give repeated results. A null doc_id is
    in its class but never names a component (it is null if all are). Empty table: no rows.
    """
    out = classes(docs, k, num, den)
    out = written(out, "classes")
    names = written(out.where("n > 0").groupBy("root").agg(F.min("doc_id").alias("component_id")), "names")
    named = out.join(names, "root", "left")
    return named.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


@plain_names
def deduplicated(docs: DataFrame, **options) -> DataFrame:
    """One document of each group of linked ones, all columns: the smallest doc_id (a null one last), then the smallest
    hash of the text; repeated rows of it are one. Documents without words all stay, repeated rows too."""
    key = F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id").alias("doc_id"), F.col("th").alias("th"))
    rows = written(classes(docs, **options).where("n > 0").groupBy("root", "doc_id", "th").agg(F.count("*").alias("c")), "rows")
    keep = written(rows.groupBy("root").agg(F.min(key).alias("k")), "keep")
    marked = rows.join(keep, "root").select("doc_id", "th", "c", (F.col("k.doc_id").eqNullSafe(F.col("doc_id")) & (F.col("k.th") == F.col("th"))).alias("kept"))
    marked = written(marked.where("not kept or c > 1"), "marked")
    out = docs.withColumns({"__id": F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))), "__th": F.xxhash64(F.col("text").cast("string"))})
    mark = marked.select(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("__id"), F.col("th").alias("__th"), "kept")
    rest = out.join(mark.drop("kept"), ["__id", "__th"], "left_anti")
    again = out.join(mark.where("kept").drop("kept"), ["__id", "__th"], "left_semi").dropDuplicates(["__id", "__th"])
    return rest.unionByName(again).select(*[F.col(f"`{c}`") for c in docs.columns])
