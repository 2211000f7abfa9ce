"""Sharding by histogram sort: exact byte counts below probe keys place the splitters, then one exchange."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from accordis.llm.shared import plain_names, written

LOW, HIGH = -(1 << 63), (1 << 63) - 1
Point = tuple[int, int, int, int]


def splitters(thin: DataFrame, parts: int, tolerance: float, most_cells: int = 1 << 16) -> list[Point]:
    """parts - 1 splitters (h, id, bytes below, rows below) in the order of (h, id).

    thin: h, id (long), size. A round counts exact bytes and rows of the slots between evenly spaced probes, for all
    unsettled splitters at once, and keeps the slot that each falls in. A splitter is settled when a probe is within
    tolerance x the bytes of a part, or its slot holds one row or one key. A slot of a single h that is still too heavy (a large
    group of equal texts) is probed on by id. Only counts of slots reach the driver, most_cells or so in a round.
    """
    total = thin.agg(F.sum("size"), F.count("*")).first()
    all_bytes, all_rows = int(total[0] or 0), int(total[1])
    slack = tolerance * all_bytes / parts
    want = [all_bytes * (k + 1) // parts for k in range(parts - 1)]
    done: dict[int, Point] = {k: (HIGH, HIGH, 0, 0) for k in range(parts - 1)} if not all_rows else {}
    live = {} if not all_rows else {k: (0, 0, 0) for k in range(parts - 1)}  # prefix of h, bytes and rows below it
    deep: dict[int, tuple[int, int, int]] = {}
    level = 0
    while live:
        bits = min(64 - level, max(1, (most_cells // max(1, len({v[0] for v in live.values()}))).bit_length() - 1), 12)
        shift = 64 - level - bits
        rows = thin.where(F.shiftright("h", 64 - level).isin(sorted({v[0] for v in live.values()}))) if level else thin
        cells: dict[int, list] = {}
        for x in rows.groupBy(F.shiftright("h", shift).alias("c")).agg(F.sum("size").alias("b"), F.count("*").alias("n")).collect():
            cells.setdefault(x["c"] >> bits if level else 0, []).append((x["c"], int(x["b"]), int(x["n"])))
        for v in cells.values():
            v.sort()
        for k, (at, below, count) in list(live.items()):
            for c, b, n in cells[at]:
                if below + b > want[k]:
                    break
                below, count = below + b, count + n
            del live[k]
            down, up = want[k] - below, below + b - want[k]
            near = slack if n > 1 else all_bytes  # a single row settles it: its nearer side is the best there is
            if down <= min(near, up) or (c + 1) << shift > HIGH and up <= near:
                done[k] = (c << shift, LOW, below, count)
            elif up <= near:
                done[k] = ((c + 1) << shift, LOW, below + b, count + n)
            elif shift:
                live[k] = (c, below, count)
            else:
                deep[k] = (c, below, count)
        level += bits
    if deep:
        hot = thin.where(F.col("h").isin(sorted({v[0] for v in deep.values()})))
        span = {r["h"]: (r["a"], r["z"]) for r in hot.groupBy("h").agg(F.min("id").alias("a"), F.max("id").alias("z")).collect()}
        ends = {k: (v[0], *span[v[0]], v[1], v[2]) for k, v in deep.items()}
        while ends:
            # All splitters' intervals of ids are counted in one job; they are at most as many as splitters.
            todo = {i: (h, lo, hi, -(-(hi - lo + 1) // max(2, most_cells // len(ends)))) for i, (h, lo, hi) in enumerate(sorted({v[:3] for v in ends.values()}))}
            table = thin.sparkSession.createDataFrame([(i, *v[:3], str(v[3])) for i, v in todo.items()], "i int, h long, lo long, hi long, step string")
            inside = hot.join(F.broadcast(table), "h").where("id between lo and hi")
            cell = F.expr("(cast(id as decimal(20,0)) - cast(lo as decimal(20,0))) div cast(step as decimal(20,0))")
            got: dict[int, list] = {}
            for x in inside.groupBy("i", cell.alias("c")).agg(F.sum("size").alias("b"), F.count("*").alias("n")).collect():
                got.setdefault(x["i"], []).append((int(x["c"]), int(x["b"]), int(x["n"])))
            number = {v[:3]: i for i, v in todo.items()}
            for k, (h, lo, hi, below, count) in list(ends.items()):
                del ends[k]
                i = number[h, lo, hi]
                step = todo[i][3]
                for c, b, n in sorted(got[i]):
                    if below + b > want[k]:
                        break
                    below, count = below + b, count + n
                down, up, z = want[k] - below, below + b - want[k], lo + (c + 1) * step
                if step > 1 and n > 1 and min(down, up) > slack:
                    ends[k] = (h, lo + c * step, min(hi, z - 1), below, count)
                elif down <= up or z > HIGH:
                    done[k] = (h, lo + c * step, below, count)
                else:
                    done[k] = (h, z, below + b, count + n)
    out = [done[k] for k in range(parts - 1)]
    for k in range(1, len(out)):  # tolerances may let neighbours cross
        out[k] = max(out[k], out[k - 1])
    return out


def _cells(points: list[Point], shards: int) -> tuple[int, list[tuple]]:
    """For each slot of the leading bits of h: splitters before it, those inside it, and for these parts the rows
    between their shard's start and theirs. As many rows as 2 to 4 x the parts."""
    bits = max(4, len(points).bit_length() + 1)
    per, starts = (len(points) + 1) // shards, [0, *(p[3] for p in points)]
    offset = [starts[k] - starts[k // per * per] for k in range(len(starts))]
    out, k = [], 0
    for c in range(-(1 << (bits - 1)), 1 << (bits - 1)):
        base = k
        while k < len(points) and points[k][0] >> (64 - bits) == c:
            k += 1
        out.append((c, base, [(p[0], p[1]) for p in points[base:k]], offset[base : k + 1]))
    return bits, out


@plain_names
def shard(docs: DataFrame, *, shards: int = 8, tolerance: float = 0.002, part_bytes: int = 64 << 20, least_parts: int = 8) -> DataFrame:
    """docs with size, text_crc32, law ("bytes"), shard, slot and grown_shard (null under this law).

    Rows are sorted by (hash of the text, doc_id), so equal texts stand together and part only where a splitter
    must cut a group that alone exceeds the tolerance; shards' bytes differ from the mean by tolerance x a shard
    or one key's rows at most. Rows of one key (repeated rows) stay together. Each shard is cut into parts of
    about part_bytes (`least_parts` at least) whose rows below are known exactly, so that slots are numbered
    inside parts and no shard meets in one task. One exchange, DataFrame functions only. A null text has size 1
    and the crc32 of no bytes; a null doc_id sorts first. Empty table: no rows.
    """
    own = {"size", "text_crc32", "law", "shard", "slot", "grown_shard"}
    docs = docs.drop(*[c for c in docs.columns if c.lower() in own])
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    h, i = F.xxhash64(text), F.coalesce(F.col("doc_id").cast("long"), F.lit(LOW))
    size = (F.octet_length(text) + 1).cast("long")
    thin = written(docs.select(h.alias("h"), i.alias("id"), size.alias("size")), "shard")
    total = thin.agg(F.sum("size")).first()[0] or 0
    per = min(8192, max(least_parts, -(-int(total) // (shards * part_bytes))))
    bits, cells = _cells(splitters(thin, shards * per, tolerance), shards)
    table = docs.sparkSession.createDataFrame(cells, "__cell long, __base int, __keys array<struct<h:long,i:long>>, __offs array<long>")
    out = docs.withColumns({"size": size, "text_crc32": F.crc32(text.cast("binary")).cast("long"), "law": F.lit("bytes"), "__h": h, "__id": i})
    out = out.withColumn("__cell", F.shiftright("__h", 64 - bits)).join(F.broadcast(table), "__cell")
    out = out.withColumn("__n", F.size(F.filter("__keys", lambda k: (k.h < F.col("__h")) | ((k.h == F.col("__h")) & (k.i <= F.col("__id"))))))
    out = out.withColumn("__from", F.get("__offs", F.col("__n"))).withColumn("__part", F.col("__base") + F.col("__n")).drop("__keys", "__offs", "__cell", "__base", "__n")
    order = Window.partitionBy("__part").orderBy("__h", "__id", *[c for c, t in docs.dtypes if not re.search("map|variant|void|interval", t) and c not in ("text", "doc_id")])
    out = out.withColumn("shard", F.floor(F.col("__part") / per).cast("int")).withColumn("slot", (F.row_number().over(order) - 1 + F.col("__from")).cast("long"))
    return out.drop("__h", "__id", "__part", "__from").withColumn("grown_shard", F.lit(None).cast("int"))
