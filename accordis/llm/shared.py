"""What the operators of this package have in common: shared storage, Arrow plumbing, components."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one numpy step works on; a longer single text is a step of its own.
STEP_BYTES = 1 << 20
#: Rows of a batch that Python gets; texts are cut into steps inside a batch.
BATCH_ROWS = 512


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where the session names none, a local session (tests) gets one of its
    own; a cluster's executors could not see it, so there it is an error."""
    sc = spark.sparkContext
    at = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not at:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        at = "file://" + tempfile.mkdtemp(prefix="accordis-")
        sc.setCheckpointDir(at)
        at = sc.getCheckpointDir() or at
    return at.rstrip("/")


def written(df: DataFrame, tag: str) -> DataFrame:
    """Writes df as Parquet to the shared folder and reads it again: lineage ends there, lost executors cost nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/accordis-{tag}-{uuid.uuid4().hex}"
    began = time.time()
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._accordis_path = path
    if time.time() - began > 0.7 and hasattr(spark, "_jvm"):
        # Spark drops the shuffle files of plans that are no longer reachable when the driver collects garbage; a
        # driver with much memory may not do so for long, and finished steps' files would fill the disks.
        gc.collect()
        spark._jvm.System.gc()
    return out


def dropped(*tables: DataFrame) -> None:
    """Removes written() tables that nothing reads any more."""
    for t in tables:
        if (path := getattr(t, "_accordis_path", None)) and hasattr(t.sparkSession, "_jvm"):
            jvm = t.sparkSession._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(t.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(at, True)


def lean(table: DataFrame, rows: int = 100_000) -> DataFrame:
    """A written() table of at most three numbers a row: broadcast if it is counted to be under 3 MB, else left to a shuffle join."""
    return F.broadcast(table) if small(table, rows) else table


def small(table: DataFrame, rows: int) -> bool:
    return table.limit(rows + 1).count() <= rows


def one(table: DataFrame, rows: int = 50_000) -> DataFrame:
    """A written() table of a few numbers a row: if it is counted to be under 2 MB, as one partition, so that what
    follows needs no exchange of hundreds of empty parts; else as it is."""
    return table.coalesce(1) if small(table, rows) else table


def arrow_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Keeps the batches that Python gets small enough for long texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    arrow_batches(df.sparkSession)
    return df.mapInArrow(fn, schema)


def gathered(it: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """Batches together, at least `rows` rows at a time as far as there are."""
    held: list[pa.RecordBatch] = []
    for b in it:
        held.append(b)
        if sum(x.num_rows for x in held) >= rows:
            yield pa.Table.from_batches(held)
            held = []
    if held:
        yield pa.Table.from_batches(held)


def column_place(df: DataFrame, name: str) -> int:
    """Where a column stands; as in Spark, case does not matter."""
    return [c.lower() for c in df.columns].index(name.lower())


def plain_names(fn: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """For functions of documents that add columns of names in __: the documents' own such columns get other names
    meanwhile, so that none clash."""

    @wraps(fn)
    def run(docs: DataFrame, *args, **options) -> DataFrame:
        held = {c: f"held{i}_{uuid.uuid4().hex}" for i, c in enumerate(docs.columns) if c.startswith("__")}
        out = fn(docs.withColumnsRenamed(held), *args, **options) if held else fn(docs, *args, **options)
        return out.withColumnsRenamed({v: k for k, v in held.items()}) if held else out

    return run


def components(edges: DataFrame, tag: str = "cc") -> DataFrame:
    """Connected components by alternating large-star and small-star steps; no component meets in one task.

    edges: columns a and b (long). Returns node and root (its component's smallest node) for every node of an
    edge. Nulls, loops and repeated edges are ignored. Ends when a pass changes nothing. Each step is an
    aggregation of minima (combined on the map side) and an equality join.
    """
    e = written(edges.where("a is not null and b is not null and a <> b").selectExpr("greatest(a, b) as a", "least(a, b) as b").distinct(), tag)
    while True:
        tiny = small(e, 50_000)
        few = e.coalesce(1) if tiny else e
        merged = (lambda x, y: x.unionByName(y).coalesce(1)) if tiny else (lambda x, y: x.unionByName(y))
        # Done when every node has one parent and no parent has one.
        twice = few.groupBy("a").count().where("count > 1").select("a").limit(1)
        chain = few.join(few.selectExpr("a as b"), "b", "left_semi").select("a").limit(1)
        if not twice.unionByName(chain).head(1):
            return e.selectExpr("a as node", "b as root").unionByName(e.selectExpr("b as node", "b as root").distinct())
        # Large star: link larger neighbours to the smallest neighbour.
        both = merged(few, few.selectExpr("b as a", "a as b"))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(low, "a").where("b > a").selectExpr("b as a", "m as b").distinct()
        # Small star: link smaller neighbours, and the node itself, to the smallest.
        low2 = large.groupBy("a").agg(F.min("b").alias("m"))
        stars = merged(large.join(low2, "a").where("b <> m").selectExpr("b as a", "m as b"), low2.selectExpr("a", "m as b")).distinct()
        old, e = e, written(stars, tag)
        dropped(old)


_POP = np.array([bin(i).count("1") for i in range(256)], np.uint8)
#: Nodes of a list that one task compares (with sketches of 256 bytes, a megabyte); larger lists are thinned in rounds.
IN_TASK = 4096

Bound = Callable[[np.ndarray, np.ndarray, np.ndarray], np.ndarray]


def _sketches(column: pa.Array) -> np.ndarray:
    values = column.to_pylist()
    return np.frombuffer(b"".join(values), np.uint8).reshape(len(values), -1)


def _differ(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    if x.shape[-1] % 8 == 0:
        return np.bitwise_count(x.view(np.uint64) ^ y.view(np.uint64)).sum(-1, dtype=np.int64)
    return _POP[x ^ y].sum(-1, dtype=np.int64)


def _screened(bound: Bound):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            if b.num_rows:
                d = _differ(_sketches(b.column("x")), _sketches(b.column("y")))
                ok = bound(b.column("n").to_numpy(), b.column("m").to_numpy(), d)
                yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), pa.array(d)], ["a", "b", "d"]).filter(pa.array(ok))

    return run


def _inside(bound: Bound, nearest: bool):
    """Pairs of a list's nodes of different components within the bound; nearest: one for each node only.

    Two nodes with the same `top` (the largest list that holds them) meet in that list alone."""

    def run(t: pa.Table) -> pa.Table:
        t = t.combine_chunks()
        name = t.column("list")[0].as_py()
        node, root, top, n = (t.column(c).to_numpy() for c in ("node", "root", "top", "n"))
        s = _sketches(t.column("sketch").combine_chunks())
        _, kind = np.unique(top, return_inverse=True)
        here = top == name
        out: list[np.ndarray] = []
        rows = max(1, (1 << 16) // max(1, len(node)))
        order = np.argsort(kind, kind="stable")
        node, root, n, s, kind, here = node[order], root[order], n[order], s[order], kind[order], here[order]
        ends = np.searchsorted(kind, kind, "right")
        for i in range(0, len(node), rows):
            part = slice(i, min(i + rows, len(node)))
            # Later nodes, from behind the own top's others unless this list is that top.
            lo = int(min(np.where(here[part], np.arange(part.start, part.stop) + 1, ends[part])))
            if lo >= len(node):
                continue
            cols = slice(lo, len(node))
            where = np.arange(part.start, part.stop)[:, None] < np.arange(lo, len(node))[None, :]
            where &= (root[part, None] != root[None, cols]) & ((kind[part, None] != kind[None, cols]) | here[part, None])
            x, y = np.nonzero(where)
            for j in range(0, len(x), 1 << 16):
                p, q = x[j : j + (1 << 16)] + part.start, y[j : j + (1 << 16)] + lo
                d = _differ(s[p], s[q])
                ok = bound(n[p], n[q], d)
                out.append(np.column_stack([node[p[ok]], node[q[ok]], d[ok]]))
        v = np.concatenate([*out, np.zeros((0, 3), np.int64)])
        v[:, 0], v[:, 1] = np.minimum(v[:, 0], v[:, 1]), np.maximum(v[:, 0], v[:, 1])
        if nearest and len(v):
            both = np.concatenate([v, v[:, [1, 0, 2]]])
            both = both[np.lexsort((both[:, 1], both[:, 2], both[:, 0]))]
            v = both[np.concatenate([[True], both[1:, 0] != both[:-1, 0]])]
            v[:, 0], v[:, 1] = np.minimum(v[:, 0], v[:, 1]), np.maximum(v[:, 0], v[:, 1])
        v = np.unique(v, axis=0)
        return pa.table({"a": v[:, 0], "b": v[:, 1], "d": v[:, 2]})

    return run


#: Nodes of a part of a list whose texts one task compares: pairs of parts are dealt, so that none is left out.
TEXTS_IN_TASK = 256


def _joined(bound: Bound, settle: Callable[[list[str], np.ndarray, np.ndarray, np.ndarray], np.ndarray]):
    """Links between nodes of two parts of a list, or inside one, by their texts; of nodes of the same `top` as _inside.
    Rows come sorted by list and parts; the pairs of many lists are settled together."""

    def settled(t: pa.Table) -> pa.RecordBatch:
        t = t.combine_chunks()
        name, node, root, top, part, n = (t.column(c).to_numpy() for c in ("list", "node", "root", "top", "part", "n"))
        s = _sketches(t.column("sketch").combine_chunks())
        inside = (t.column("lo").to_numpy() == t.column("hi").to_numpy())
        begin = _group_starts(t)
        ps, qs, ds = [], [], []
        for x, z in zip(begin.tolist(), [*begin[1:].tolist(), len(node)], strict=True):
            p, q = np.triu_indices(z - x, 1)
            p, q = p + x, q + x
            ok = (root[p] != root[q]) & ((top[p] != top[q]) | (top[p] == name[x])) & ((part[p] != part[q]) | inside[x])
            p, q = p[ok], q[ok]
            d = _differ(s[p], s[q])
            ok = bound(n[p], n[q], d)
            ps.append(p[ok]), qs.append(q[ok]), ds.append(d[ok])
        p, q, d = (np.concatenate(v) for v in (ps, qs, ds))
        order = np.argsort(d, kind="stable")
        p, q = p[order], q[order]
        if len(p):
            ok = settle(t.column("line").to_pylist(), node, p, q)
            p, q = p[ok], q[ok]
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(node[p], node[q])), pa.array(np.maximum(node[p], node[q]))], ["a", "b"])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for t in gathered(it, 4096):
            held = t if held is None else pa.concat_tables([held, t])
            last = int(_group_starts(held)[-1])
            if last:
                yield settled(held.slice(0, last))
                held = held.slice(last)
        if held is not None:
            yield settled(held)

    return run


def _group_starts(t: pa.Table) -> np.ndarray:
    change = np.zeros(t.num_rows, bool)
    change[:1] = True
    for c in ("list", "lo", "hi"):
        v = t.column(c).to_numpy()
        change[1:] |= v[1:] != v[:-1]
    return np.flatnonzero(change)


def resolve(lists: DataFrame, pairs: DataFrame, features: DataFrame, bound: Bound, verify: Callable[[DataFrame], DataFrame], width: int = 8, settle: tuple[DataFrame, Callable] | None = None) -> DataFrame:
    """Components (node, root) under links that are sought among members of a list, without all pairs of a large list.

    lists: list, node (repeats are ignored); pairs: a, b to test besides; features: node, n (long), sketch (binary);
    bound(n, m, d) says which pairs may link whose sketches differ in d bits; verify(a, b) returns those that link.
    First each list's smallest node meets the others. A list of over IN_TASK nodes that still holds two components is
    thinned in rounds: about `width` of its nodes, of different components and four times as many each round, meet
    all nodes of other components and then leave it. Other lists compare the sketches of nodes of different
    components in a task, first for each node's nearest, then for all pairs that are still apart. So every pair of a
    list is tested or lies within a component. Of any pairs, each node's nearest is verified first, others only if
    that has not joined them. With settle, (node, line) and a function of lines, their nodes and pairs of their
    places that says which link, the other lists' texts come to the task instead, once a list and not once a pair.
    """
    roots: DataFrame | None = None

    def apart(p: DataFrame) -> DataFrame:
        q = p.join(lean(roots).selectExpr("node as a", "root as ra"), "a", "left").join(lean(roots).selectExpr("node as b", "root as rb"), "b", "left")
        return q.where("coalesce(ra, a) <> coalesce(rb, b)").select(*p.columns)

    def join_in(links: DataFrame) -> None:
        nonlocal roots
        if roots is None or links.head(1):
            roots = components(links.select("a", "b") if roots is None else roots.selectExpr("node as a", "root as b").unionByName(links.select("a", "b")), "roots")

    def screen(candidates: DataFrame) -> DataFrame:
        p = written(candidates.selectExpr("least(a, b) as a", "greatest(a, b) as b").where("a <> b").distinct(), "pairs")
        q = lean(p).join(features.selectExpr("node as a", "n", "sketch as x"), "a").join(features.selectExpr("node as b", "n as m", "sketch as y"), "b")
        return map_arrow(q, _screened(bound), "a long, b long, d long")

    def test(near: DataFrame) -> None:
        near = one(written(near, "near"))
        near = near.groupBy("a", "b").agg(F.min("d").alias("d"))
        first = written(near.groupBy("b").agg(F.min_by("a", F.struct("d", "a")).alias("a")).select("a", "b"), "first")
        if roots is not None and not first.head(1):
            return
        join_in(verify(first))
        rest = written(apart(near.select("a", "b").join(lean(first), ["a", "b"], "left_anti")), "rest")
        if rest.head(1):
            join_in(verify(rest))
        dropped(first, rest)

    def split(of: DataFrame) -> DataFrame:
        now = of.join(lean(roots), "node", "left").select("list", "node", F.coalesce("root", "node").alias("root"))
        open_ = now.groupBy("list").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("c")).where("lo <> hi").select("list", "c")
        # Written first, so that both sides of the join are plain exchanges, of which Spark splits a hot list's part.
        open_ = written(open_, "open")
        return written(now.join(open_, "list"), "members")

    members = written(lists.select("list", "node").distinct(), "members")
    lead = written(members.groupBy("list").agg(F.min("node").alias("lead")), "leads")
    test(screen(pairs.select("a", "b").unionByName(members.join(lead, "list").where("node <> lead").selectExpr("lead as a", "node as b"))))
    left = members.join(lead.selectExpr("list", "lead as node"), ["list", "node"], "left_anti")
    while True:
        members = split(left)
        large = members.where(F.col("c") > IN_TASK)
        if not large.head(1):
            break
        lead = large.groupBy("list", "root").agg(F.min("node").alias("lead"))
        # About `width` of a list's components by hash, and its least: no list is sorted in one task.
        lead = written(lead, "heads")
        count = written(lead.groupBy("list").agg(F.count("*").alias("roots"), F.min("root").alias("lo")), "counts")
        chosen = lead.join(count, "list").where((F.pmod(F.xxhash64("root", F.lit(width)), F.col("roots")) < width) | (F.col("root") == F.col("lo")))
        lead = written(chosen.select("list", F.col("root").alias("lead_root"), "lead"), "leads")
        test(screen(large.join(lead, "list").where("root <> lead_root").selectExpr("lead as a", "node as b")))
        left = members.select("list", "node").join(lead.selectExpr("list", "lead as node"), ["list", "node"], "left_anti")
        width *= 4
    if settle and members.head(1):
        top = members.groupBy("node").agg(F.max_by("list", F.struct("c", "list")).alias("top"))
        full = members.join(top, "node").join(features, "node").join(settle[0], "node")
        parts = F.ceil(F.col("c") / TEXTS_IN_TASK)
        full = full.withColumn("parts", parts).withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts"))).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        full = full.select("list", F.least("part", "other").alias("lo"), F.greatest("part", "other").alias("hi"), "node", "root", "top", "part", "n", "sketch", "line")
        full = full.repartition("list", "lo", "hi").sortWithinPartitions("list", "lo", "hi")
        join_in(written(map_arrow(full, _joined(bound, settle[1]), "a long, b long"), "links"))
        return roots
    for nearest in (True, False):
        if not members.head(1):
            break
        top = members.groupBy("node").agg(F.max_by("list", F.struct("c", "list")).alias("top"))
        full = members.join(top, "node").join(features, "node").select("list", "node", "root", "top", "n", "sketch")
        test(full.groupBy("list").applyInArrow(_inside(bound, nearest), "a long, b long, d long"))
        if nearest:
            members = split(members.select("list", "node"))
    return roots
