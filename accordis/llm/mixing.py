"""Mixing sources to target weights: min-cost flow from membership patterns to source quotas, seeded documents."""

from __future__ import annotations

import heapq
from itertools import cycle

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from accordis.llm.shared import plain_names, written

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5.0, 2.0, 1.0)


def targets(sizes: dict, weights: dict, total: float, most: float) -> dict:
    """Shares of total by weight; a target stops at most x its source's size, and the excess goes to the others."""
    out, free, left = {s: 0.0 for s in sizes}, {s for s in sizes if sizes[s] > 0}, float(total)
    while free:
        w = sum(weights[s] for s in free)
        over = {s for s in free if left * weights[s] / w > most * sizes[s]}
        if not over:
            return out | {s: left * weights[s] / w for s in free}
        for s in over:
            out[s] = float(most * sizes[s])
        left = max(0.0, left - sum(out[s] for s in over))
        free -= over
    return out


def min_cost_flow(supply: list[float], demand: list[float], member: list[list[int]], most: int) -> list[dict[int, float]]:
    """Flow from pattern i (at most `most` x supply[i] in all; the k-th repetition costs k - 1 a token) to each of
    its sources. Successive shortest paths with potentials; returns each pattern's flow by source.

    As costs are convex, cheap copies of every pattern go first; flow may be moved between sources of a pattern
    to make room. Demand beyond all capacity stays unmet."""
    n, m = len(supply), len(demand)
    start, end = n + m, n + m + 1
    graph: list[list[int]] = [[] for _ in range(n + m + 2)]
    to, cap, cost = [], [], []

    def arc(a: int, b: int, c: float, w: float) -> int:
        for x, y, q, z in ((a, b, c, w), (b, a, 0.0, -w)):
            graph[x].append(len(to))
            to.append(y)
            cap.append(q)
            cost.append(z)
        return len(to) - 2

    for i, s in enumerate(supply):
        for k in range(most):
            arc(start, i, s, float(k))
    routes = [{j: arc(i, n + j, float("inf"), 0.0) for j in member[i]} for i in range(n)]
    for j, d in enumerate(demand):
        arc(n + j, end, d, 0.0)
    high, eps = [0.0] * len(graph), 1e-9 * (1 + sum(demand))
    while True:
        dist, via = [float("inf")] * len(graph), [-1] * len(graph)
        dist[start] = 0.0
        heap = [(0.0, start)]
        while heap:
            d, v = heapq.heappop(heap)
            if d > dist[v]:
                continue
            for e in graph[v]:
                if cap[e] > eps and d + cost[e] + high[v] - high[to[e]] < dist[to[e]] - 1e-12:
                    dist[to[e]] = d + cost[e] + high[v] - high[to[e]]
                    via[to[e]] = e
                    heapq.heappush(heap, (dist[to[e]], to[e]))
        if dist[end] == float("inf"):
            break
        far = max(d for d in dist if d < float("inf"))
        high = [h + min(d, far) for h, d in zip(high, dist, strict=True)]
        path, v = [], end
        while v != start:
            path.append(via[v])
            v = to[via[v] ^ 1]
        amount = min(cap[e] for e in path)
        for e in path:
            cap[e] -= amount
            cap[e ^ 1] += amount
    return [{j: cap[e ^ 1] for j, e in r.items() if cap[e ^ 1] > eps} for r in routes]


def _cuts(rows: DataFrame, want: dict[int, float], rounds: int = 6, bits: int = 10) -> dict[int, int]:
    """For each pattern the largest key such that rows with a key of at most it hold about want[pattern] tokens.

    rows: pattern, size, key (0 to 2^60 - 1). Each round counts exact tokens by the next bits of the key inside the
    slot that holds the cut: at most 2^bits sums for each pattern reach the driver, never rows."""
    low, got, best = {p: 0 for p in want}, {p: 0.0 for p in want}, {}
    for r in range(rounds):
        live = [p for p in want if p not in best]
        if not live:
            break
        shift = 60 - bits * (r + 1)
        at = F.create_map(*(F.lit(x) for p in live for x in (p, low[p] >> (shift + bits))))
        cells = rows.where(F.col("pattern").isin(live)).where(F.shiftright("key", shift + bits) == at[F.col("pattern")])
        cells = cells.groupBy("pattern", F.shiftright("key", shift).alias("cell")).agg(F.sum("size").alias("t"), F.count("*").alias("n")).collect()
        by: dict[int, list] = {p: [] for p in live}
        for x in cells:
            by[x["pattern"]].append((x["cell"], float(x["t"]), x["n"]))
        for p in live:
            for cell, t, n in sorted(by[p]):
                if got[p] + t > want[p]:
                    if n == 1 or r == rounds - 1:  # one row decides: take it if that is nearer
                        best[p] = ((cell + 1) << shift) - 1 if got[p] + t - want[p] < want[p] - got[p] else (cell << shift) - 1
                    low[p] = cell << shift
                    break
                got[p] += t
            else:
                best[p] = (1 << 60) - 1 if r == 0 else low[p] + (1 << (shift + bits)) - 1
    return best


def _planned(docs: DataFrame, *, members: Column | None = None, weights: tuple[float, ...] = WEIGHTS, share: float = 1.0, most: int = 3, seed: int = 17) -> DataFrame:
    """docs with __size, __source_size, __target and __times.

    members: an array of the sources that a document belongs to (default: its source alone). Documents are summed
    by membership pattern; each pattern's tokens, `most` copies at most and dearer with each, flow to the sources'
    quotas at least cost; whole copies of a pattern go to all its documents, the rest to documents in a seeded
    order, found by exact token counts. Sources and patterns must be few enough for the driver; documents never
    reach it. A null text has size 0 and a null source is a source of its own, last. source_size and target are
    those of a document's first source. Empty table: no rows. A source's tokens miss its target by less than
    about one document. Reruns agree; repeated rows (same doc_id and text) are taken together.
    """
    group = members if members is not None else F.array(F.col("source").cast("string"))
    # One value for a null source: an array may hold it, a map key may not.
    thin = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.sort_array(F.array_distinct(group)).alias("in_"), F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD)), F.lit(0)).cast("long").alias("size"), F.xxhash64("text").alias("th"))
    thin = written(thin, "mix")
    found = thin.groupBy("in_").agg(F.sum("size").alias("t")).collect()
    patterns = sorted((tuple(r["in_"]) for r in found), key=lambda p: [(s is None, s or "") for s in p])
    tokens = {tuple(r["in_"]): int(r["t"]) for r in found}
    sources = sorted({s for p in patterns for s in p}, key=lambda s: (s is None, (s or "").encode("utf-32-be")))
    sizes = {s: sum(tokens[p] for p in patterns if s in p) for s in sources}
    goal = targets(sizes, dict(zip(sources, cycle(weights), strict=False)), share * sum(tokens.values()), most)
    place = {s: i for i, s in enumerate(sources)}
    flow = min_cost_flow([float(tokens[p]) for p in patterns], [goal[s] for s in sources], [[place[s] for s in p] for p in patterns], most)
    whole, part = {}, {}
    for i, p in enumerate(patterns):
        f, t = sum(flow[i].values()), tokens[p]
        whole[i] = min(most, int(f / t + 1e-9)) if t else 0
        if t and f - whole[i] * t > 1e-6 * t and whole[i] < most:
            part[i] = f - whole[i] * t
    spark = docs.sparkSession
    # As many rows as patterns; of one size with what the driver already holds.
    table = spark.createDataFrame([(i, list(p), whole[i], sizes[p[0]] if p else 0, goal[p[0]] if p else 0.0) for i, p in enumerate(patterns)], "pattern int, in_ array<string>, whole int, __source_size long, __target double")
    key = F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id", "th"), 4)
    keyed = thin.join(F.broadcast(table.select("pattern", F.col("in_").alias("in2"))), F.col("in_").eqNullSafe(F.col("in2"))).select("pattern", "size", key.alias("key"))
    cut = _cuts(keyed, part) if part else {}
    cuts = spark.createDataFrame([(i, cut.get(i, -1)) for i in range(len(patterns))], "pattern int, cut long")
    plan = table.join(cuts, "pattern").withColumnRenamed("in_", "in2").drop("pattern")
    out = docs.withColumn("__in", F.sort_array(F.array_distinct(group))).withColumn("__key", F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col("doc_id").cast("long"), F.xxhash64("text")), 4))
    out = out.withColumn("__size", F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD)), F.lit(0)).cast("long"))
    out = out.join(F.broadcast(plan), F.col("__in").eqNullSafe(F.col("in2")))
    return out.withColumn("__times", F.col("whole") + (F.col("__key") <= F.col("cut")).cast("int")).drop("__in", "__key", "in2", "whole", "cut")


@plain_names
def mix(docs: DataFrame, **options) -> DataFrame:
    """docs with size, source_size, target, times (copies that the mix takes) and taken (times x size); columns of docs
    with these names give way. Options and cases: see _planned."""
    own = {"size", "source_size", "target", "times", "taken"}
    out = _planned(docs, **options)
    out = out.drop(*[c for c in docs.columns if c.lower() in own])
    for c in ("size", "source_size", "target", "times"):
        out = out.withColumnRenamed(f"__{c}", c)
    return out.withColumn("taken", F.col("times") * F.col("size"))


@plain_names
def mixed(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each document of docs as often as it is taken, in the columns of docs."""
    out = _planned(docs, **options).where("__times > 0")
    return out.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__times")))).select(*[F.col(f"`{c}`") for c in docs.columns])
