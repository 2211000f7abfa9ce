"""Operators whose results are fixed for every text, against plain Python on a table of awkward rows and on sf0.001."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from accordis.llm import mixing, quality_classifier, quality_rules, secrets, sharding

WORD = re.compile(r"[^\x20\x09-\x0D]+")
AWKWARD = [
    (1, None, "a", 1), (2, "", None, 2), (3, "one", "b", 3), (4, " \n\t ", "b", 3), (5, "naïve cafe x y\nnaïve cafe x y\n\n\nz", "a", 3),
    (6, "a b c a b c d a b c", "a", 1), (7, "same text here", "a", 1), (8, "same text here", "a", 1), (8, "same text here", "a", 1), (9, "w " * 30_000, "hot", 1), (None, "lost id #*$ words", "hot", 5),
    (10, "x\ry\x0bz\x0cq\nx\ry\x0bz\x0cq\nend", "hot", 5), (11, "é" * 5000, None, 5), (12, "\U0001f600 tail \U0001f600 tail \U0001f600 tail", "c", 5),
]
EXTRA = "doc_id long, text string, source string, size int"


@pytest.fixture(scope="module")
def awkward(spark):
    return spark.createDataFrame(AWKWARD, EXTRA)


def plain(text):
    text = text or ""
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    g = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {j for i in range(len(w) - 2) if g[tuple(w[i : i + 3])] > 1 for j in range(i, i + 3)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def test_rules_counts(spark, awkward):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    for d in (awkward, docs):
        got = sorted((r[:6] for r in quality_rules.report(d, labels).collect()), key=str)
        assert got == sorted(((r.doc_id, *plain(r.text)) for r in d.collect()), key=str)


def test_rules_learn(spark):
    rng = np.random.default_rng(1)
    x = {"a": rng.uniform(0, 1, 4000), "b": rng.uniform(0, 1, 4000), "c": rng.uniform(0, 1, 4000)}
    bad = (x["a"] > 0.8) & (x["b"] <= 0.3) | (x["c"] <= 0.05)
    rules = quality_rules.learn(x, bad)
    hit = np.zeros(4000, bool)
    for r in rules:
        hit |= r.holds(x)
    assert (hit & bad).sum() > 0.9 * bad.sum() and (hit & ~bad).sum() < 0.1 * hit.sum()
    df = spark.createDataFrame([(float(a), float(b), float(c)) for a, b, c in zip(*x.values())], "a double, b double, c double")
    assert df.where(~quality_rules.verdict(rules)).count() == hit.sum()
    assert quality_rules.learn(x, np.zeros(4000, bool)) == [] and quality_rules.learn({"a": np.zeros(0)}, np.zeros(0, bool)) == []


def test_rules_on_labels(spark):
    d = "/root/testdata/sf0.1/"
    out, rules = quality_rules.quality_rules(spark.read.parquet(d + "documents.parquet"), spark.read.parquet(d + "labels.parquet"))
    assert rules
    # The base rule is fixed; among what passes it, the learnt rules must keep good documents and find bad ones.
    k = {(r.quality, r.kept): r["count"] for r in out.where("not base_failed").join(spark.read.parquet(d + "labels.parquet"), "doc_id").groupBy("quality", "kept").count().collect()}
    assert k.get((1, True), 0) > 0.97 * (k.get((1, True), 0) + k.get((1, False), 0)), k
    assert k.get((0, False), 0) > 0.9 * (k.get((0, True), 0) + k.get((0, False), 0)), k


def test_rules_without_labels(spark, awkward):
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert all(r.kept != r.base_failed for r in quality_rules.report(awkward, none).collect())
    assert quality_rules.report(awkward.limit(0), none).count() == 0


def test_classifier(spark, awkward):
    d = "/root/testdata/sf0.1/"
    labels = spark.read.parquet(d + "labels.parquet")
    out = quality_classifier.quality_scores(spark.read.parquet(d + "documents.parquet"), labels).join(labels, "doc_id").toPandas()
    assert all(h == (zlib.crc32(str(i).encode()) % 5 == 0) for i, h in zip(out.doc_id, out.held_out))
    h = out[out.held_out]
    a, b = h[h.quality == 1].score.to_numpy(), h[h.quality == 0].score.to_numpy()
    auc = ((a[:, None] > b).sum() + 0.5 * (a[:, None] == b).sum()) / (len(a) * len(b))
    assert auc > 0.95 and out.score.between(0, 1).all() and (out.predicted == (out.score >= 0.3)).all(), auc
    few = quality_classifier.quality_scores(awkward, labels).collect()
    assert len(few) == len(AWKWARD) and all(0 <= r.score <= 1 for r in few)
    none = quality_classifier.quality_scores(awkward, labels.limit(0)).collect()
    assert {r.score for r in none} == {0.5}


def test_isotonic():
    x, y = quality_classifier.isotonic(np.arange(5.0), np.array([0, 0.5, 0.2, 0.9, 1]), np.ones(5))
    assert list(y) == [0, 0.35, 0.9, 1] and list(x) == [0, 1.5, 3, 4]


def test_mix(spark, awkward):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    for d in (awkward, docs):
        rows = mixing.mix(d).collect()
        assert len(rows) == d.count() and sorted(map(str, rows)) == sorted(map(str, mixing.mix(d.repartition(3)).collect()))
        sizes, taken, goal, largest = defaultdict(int), defaultdict(int), {}, defaultdict(int)
        for r in rows:
            assert r.size == len(WORD.findall(r.text or "")) and 0 <= r.taken <= 3 * r.size
            sizes[r.source] += r.size
            taken[r.source] += r.taken
            goal[r.source] = r.target
            largest[r.source] = max(largest[r.source], r.size)
        order = sorted(sizes, key=lambda s: (s is None, s or ""))
        want = mixing.targets(sizes, {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}, sum(sizes.values()), 3)
        for s in sizes:
            assert abs(goal[s] - want[s]) < 1e-6 * (1 + want[s]) and want[s] <= 3 * sizes[s] + 1e-6
            assert abs(taken[s] - goal[s]) <= largest[s], (s, taken[s], goal[s])
    assert mixing.mix(awkward.limit(0)).count() == 0


def test_flow():
    # Source 0 can only be met from the shared pattern; then source 1 must repeat its own documents.
    f = mixing.min_cost_flow([100.0, 100.0], [100.0, 150.0], [[0, 1], [1]], 3)
    assert abs(f[0].get(0, 0) - 100) < 1e-6 and abs(sum(x.get(1, 0) for x in f) - 150) < 1e-6
    assert abs(sum(f[0].values()) - 125) < 26 and sum(f[1].values()) >= 100


def test_mix_overlap(spark):
    from pyspark.sql import functions as F

    d = spark.createDataFrame([(i, "w " * 10, ["a"] if i % 3 == 0 else ["a", "b"] if i % 3 == 1 else ["b"]) for i in range(300)], "doc_id long, text string, of array<string>")
    rows = mixing.mix(d, members=F.col("of"), weights=(3.0, 1.0), share=0.5).collect()
    assert abs(sum(r.taken for r in rows) - 1500) <= 30


def brute_secrets(text):
    kinds = [("assign", r"(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 6, 1), ("access", r"AKIA[A-Z0-9]+", 20, 0), ("hex", r"[0-9a-f]+", 24, 0)]
    found = [(m.start(), i, m.end()) for i, (_, p, n, g) in enumerate(kinds) for m in re.finditer(p, text or "") if len(m[g]) >= n]
    return [(a, kinds[i][0], z) for a, i, z in sorted(found)]


SECRETS = [
    "PassWord = 'abcdef' password=token=abcdef; password=token: abcdefg", "é AKIA" + "A" * 16 + " secret: 'xK9fQ2mZpL7wR4tY8uB1' http://host.example/x", "0123456789abcdef01234567 and 0123456789abcdef0123456", None, "",
    "user=bob\n\nsecret: short", "client_id: svc-reader key Zk8Qw3Lm9Xr2Vt5Yb7 at db.example.com:5432", "client_id: svc-reader key Zk8Qw3Lm9Xr2Vt5Yb7", "a" * 100_000 + " api_key=123456", "toKen=abcdefgh ſecret=abcdefgh", "x" * 23 + "0" * 23 + "é" + "f" * 24,
]


def test_secrets(spark):
    d = spark.createDataFrame([(i, t) for i, t in enumerate(SECRETS)] + [(0, SECRETS[0])], "doc_id long, text string").unionByName(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text"))
    got = secrets.secret_scan(d).collect()
    texts = d.collect()
    assert len(got) == len(texts)
    want = sorted((t.doc_id, ",".join(f"{k}:{a}:{z}" for a, k, z in brute_secrets(t.text))) for t in texts)
    base = sorted((r.doc_id, ",".join(x for x in r.spans.split(",") if x.split(":")[0] in secrets.BASE_KINDS)) for r in got)
    assert base == want
    assert sorted(r.base_sha256 for r in got) == sorted(hashlib.sha256(w.encode()).hexdigest() for _, w in want)
    by = {i: secrets.scan(t or "") for i, t in enumerate(SECRETS)}
    assert {k for _, k, _ in by[1][1]} == {"endpoint"} and {k for _, k, _ in by[6][1]} == {"ident", "secret", "endpoint"}
    assert by[7][1] == [] and by[5][1] == []


def test_sharding(spark, awkward):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    hot = spark.range(400).selectExpr("id as doc_id", "case when id % 3 > 0 then 'copy' else repeat('x', cast(id as int)) end as text", "'n' as shard", "map(1, 2) as m")
    for d, even in ((awkward.limit(0), 0), (awkward, 0), (docs, 1.02), (hot, 1.3)):
        rows = sharding.shard(d).collect()
        assert len(rows) == d.count()
        slots, size = defaultdict(list), Counter()
        for r in rows:
            t = (r.text or "").encode()
            assert r.size == len(t) + 1 and r.text_crc32 == zlib.crc32(t) and r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < 8
            slots[r.shard].append(r.slot)
            size[r.shard] += r.size
        assert all(sorted(v) == list(range(len(v))) for v in slots.values())
        if even:
            assert len(size) == 8 and max(size.values()) <= even * sum(size.values()) / 8, size
    again = {(r.doc_id, r.shard, r.slot) for r in sharding.shard(docs.repartition(5)).collect()}
    assert again == {(r.doc_id, r.shard, r.slot) for r in sharding.shard(docs).collect()}


def brute_linked(text, base, window=240):
    """Every weak part against every other part of its scope, pair by pair."""
    parts = secrets._parts(text, base)
    cuts = [m.start() for m in re.finditer(r"\n[ \t\r]*\n", text)]
    scope = lambda a: sum(c <= a for c in cuts)
    out = []
    for p in parts:
        if p[3]:
            continue
        near = [q for q in parts if abs(q[0] - p[0]) <= window and (scope(q[0]) == scope(p[0]) or q[0] in (cuts[scope(p[0])] if scope(p[0]) < len(cuts) else -1,))]
        has = {(q[2], q[3]) for q in near}
        ident, secret = ("ident", True) in has, ("secret", True) in has
        weak_ident, weak_secret, end = ("ident", False) in has, ("secret", False) in has, ("endpoint", False) in has
        if {"secret": ident or weak_ident and end, "ident": secret or weak_secret and end, "endpoint": (ident or weak_ident) and (secret or weak_secret)}[p[2]]:
            out.append((p[0], p[2], p[1]))
    return out


def test_linking_against_all_pairs():
    rng = np.random.default_rng(6)
    pieces = ["client_id: svc-reader", "Zk8Qw3Lm9Xr2Vt5Yb7", "db.example.com:5432", "https://host.example/x", "AKIA" + "B" * 16, "AKIA" + "C" * 13, "password = hunter2hunter", "token: ab", "user=bob", "\n\n", "\n \t\n", "plain words here", "w " * 60, "é " * 40]
    found = 0
    for _ in range(1500):
        text = " ".join(rng.choice(pieces, rng.integers(1, 14)))
        base, more = secrets.scan(text)
        assert more == brute_linked(text, base), text
        found += len(more)
    assert found > 1000


def test_classifier_against_numpy(spark):
    """Normal equations, calibration and scores of a small table, computed once more without Spark."""
    rng = np.random.default_rng(9)
    rows = [(i, " ".join(["spam!!"] * int(rng.integers(1, 60)) if i % 3 == 0 else [f"word{x}" for x in rng.integers(0, 50, rng.integers(5, 80))])) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0 or i % 7 == 0)) for i, _ in rows] + [(None, 1), (3, None)], "doc_id long, quality int")
    got = {r.doc_id: r.score for r in quality_classifier.quality_scores(docs, labels, dims=32).collect()}
    stats = {r.doc_id: [r[f] for f in quality_classifier.FEATURES] for r in quality_classifier.with_stats(docs).collect()}
    x = np.array([stats[i] for i, _ in rows])
    y = np.array([float(i % 3 > 0 or i % 7 == 0) for i, _ in rows])
    fold = np.array([zlib.crc32(str(i).encode()) % 5 for i, _ in rows])
    fit, cal = (fold > 0) & (fold < 4), fold == 4
    kernel = quality_classifier.Kernel(x[fit].mean(0), x[fit].std(0), 32, 3.0, 11)
    z = kernel(x)
    # The features' inner products are near the Gaussian kernel's values.
    many = quality_classifier.Kernel(x[fit].mean(0), x[fit].std(0), 4096, 3.0, 1)
    s = np.clip((x[:40] - many.mean) / many.std, -8, 8)
    exact = np.exp(-((s[:, None] - s[None]) ** 2).sum(2) / (2 * 3.0**2))
    assert np.abs(many(x[:40])[:, :-1] @ many(x[:40])[:, :-1].T - exact).max() < 0.1
    a, b = quality_classifier.normal_equations(docs.select("doc_id").join(spark.createDataFrame([(i, float(t), *map(float, v)) for (i, _), t, v in zip(rows, y, x, strict=True)], ["doc_id", "y", *quality_classifier.FEATURES]), "doc_id").repartition(5), kernel)
    assert np.allclose(a, z.T @ z) and np.allclose(b, z.T @ y)
    coef = np.linalg.solve(z[fit].T @ z[fit] + (1e-4 * fit.sum() + 1e-3) * np.eye(33), z[fit].T @ y[fit])
    raw = z @ coef
    bins = np.floor(np.clip(raw[cal], -0.5, 1.5) * 200)
    cells = [(raw[cal][bins == c].mean(), y[cal][bins == c].mean(), (bins == c).sum()) for c in np.unique(bins)]
    # Least squares under order, by the min-max formula.
    m, w = np.array([c[1] for c in cells]), np.array([c[2] for c in cells], float)
    best = [max(min((m[i : j + 1] * w[i : j + 1]).sum() / w[i : j + 1].sum() for j in range(k, len(m))) for i in range(k + 1)) for k in range(len(m))]
    xs, ys = quality_classifier.isotonic(np.array([c[0] for c in cells]), m, w)
    assert np.allclose(sorted(set(np.round(ys, 9))), sorted(set(np.round(best, 9))))
    want = np.clip(0.999 * np.interp(raw, xs, ys) + 0.001 * np.clip(raw, 0, 1), 0, 1)
    assert np.abs(np.array([got[i] for i, _ in rows]) - want).max() < 1e-6


def best_flow(supply, demand, member, most):
    """Least (unmet demand, cost) over all whole flows."""
    import itertools

    arcs = [(i, j) for i, m in enumerate(member) for j in m]
    best = None
    for f in itertools.product(*[range(min(most * supply[i], demand[j]) + 1) for i, j in arcs]):
        out = [sum(x for x, (i, _) in zip(f, arcs, strict=True) if i == k) for k in range(len(supply))]
        into = [sum(x for x, (_, j) in zip(f, arcs, strict=True) if j == k) for k in range(len(demand))]
        if any(o > most * s for o, s in zip(out, supply, strict=True)) or any(x > d for x, d in zip(into, demand, strict=True)):
            continue
        cost = sum(k * max(0, min(o - k * s, s)) for o, s in zip(out, supply, strict=True) for k in range(most))
        best = min(best or (1e9, 0), (sum(demand) - sum(into), cost))
    return best


def test_flow_against_all_flows():
    rng = np.random.default_rng(4)
    for _ in range(60):
        n, m, most = int(rng.integers(1, 4)), int(rng.integers(1, 3)), int(rng.integers(1, 4))
        supply, demand = rng.integers(1, 4, n).tolist(), rng.integers(1, 6, m).tolist()
        member = [sorted(rng.choice(m, rng.integers(1, m + 1), replace=False).tolist()) for _ in range(n)]
        f = mixing.min_cost_flow(list(map(float, supply)), list(map(float, demand)), member, most)
        out = [sum(x.values()) for x in f]
        into = [sum(x.get(j, 0.0) for x in f) for j in range(m)]
        assert all(o <= most * s + 1e-6 for o, s in zip(out, supply, strict=True)) and all(x <= d + 1e-6 for x, d in zip(into, demand, strict=True))
        cost = sum(k * max(0.0, min(o - k * s, s)) for o, s in zip(out, supply, strict=True) for k in range(most))
        unmet, least = best_flow(supply, demand, member, most)
        assert abs(sum(demand) - sum(into) - unmet) < 1e-6 and abs(cost - least) < 1e-6, (supply, demand, member, most)


def test_clashing_names(spark):
    """Columns of the operators' own inner names come through unchanged."""
    from accordis.llm import decontaminate, jaccard_join, line_dedup, substring_dedup, suffix_dedup

    names = ["__id", "__th", "__h", "__q_n_words", "__q_log_words", "__size", "__times", "__copy", "__key", "__cuts", "__gone", "Shard", "size", "n_words", "item_id", "kept"]
    d = spark.createDataFrame([(i, f"line {i} of some words\nand more words of text {i % 3}", "a", *[f"{n}{i}" for n in names]) for i in range(9)], ", ".join(f"{c} {'long' if c == 'doc_id' else 'string'}" for c in ["doc_id", "text", "source", *names]))
    labels = spark.createDataFrame([(0, 1), (1, 0)], "doc_id long, quality int")
    bench = spark.createDataFrame([(1, "nothing of the kind is in any of these")], "item_id long, text string")
    for out in (quality_rules.accepted(d, labels), jaccard_join.deduplicated(d), decontaminate.clean(d, bench), mixing.mixed(d), line_dedup.deduplicated(d), substring_dedup.deduplicated(d), suffix_dedup.deduplicated(d)):
        assert out.columns == d.columns
        assert all(r[n] == f"{n}{r.doc_id}" for r in out.collect() for n in names)
    for out, own in ((mixing.mix(d), {"size"}), (sharding.shard(d), {"size", "Shard"})):
        rows = out.collect()
        assert len(rows) == 9 and all(r[n] == f"{n}{r.doc_id}" for r in rows for n in names if n not in own)


def test_hot_text_is_cut_by_id(spark):
    """Splitters inside one text's rows: all intervals of a level in one job, near equal bytes, whatever the ids."""
    rng = np.random.default_rng(3)
    ids = [int(x) for x in np.unique(rng.integers(-(1 << 63), (1 << 63) - 1, 3000))]
    d = spark.createDataFrame([(i, "copy " * 20 if k % 10 else f"other {k}") for k, i in enumerate(ids)], "doc_id long, text string")
    size = Counter()
    for r in sharding.shard(d, least_parts=4).collect():
        size[r.shard] += r.size
    assert len(size) == 8 and max(size.values()) <= 1.03 * sum(size.values()) / 8


def test_hint_of_a_whole_step():
    """A step of exactly 24 bytes, all hexadecimal digits."""
    import numpy as np

    from accordis.llm.secrets import _hint

    for n in (23, 24, 25):
        assert _hint(np.frombuffer(b"deadbeef0123456789abcdef0"[:n], np.uint8), np.array([0, n])).tolist() == [n >= 24]
