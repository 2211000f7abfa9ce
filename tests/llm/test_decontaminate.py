"""Decontamination against every window and item in plain Python."""

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa

from accordis.llm import decontaminate as dc
from accordis.llm import text as tx


def words(t):
    return [(m[0], m.start(), m.end()) for m in re.finditer(r"(?:[a-z0-9]|[^\x00-\x7f])+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))]


def grams(w):
    return [tuple(x[0] for x in w[i : i + 5]) for i in range(len(w) - 4)]


def brute(docs, items):
    items = sorted({(i, t) for i, t in items if i is not None and t is not None})
    own = [(i, Counter(grams(words(t)))) for i, t in items]
    own = [(i, c) for i, c in own if c]
    held = Counter(g for _, c in own for g in c)
    known = set(held)
    out = {}
    for d, t in docs:
        w = words(t)
        g = grams(w)
        if not known & set(g):
            continue
        for i, c in own:
            m = min(sum(c.values()), len(g))
            for a in range(len(g) - m + 1):
                x = Counter(g[a : a + m])
                if not x.keys() & c.keys():
                    continue
                # An item's shingles weigh by rarity, others as the rarest.
                weight = lambda g: math.log(1 + len(items) / (held[g] if g in c else 1))  # noqa: E731, B023
                both = x.keys() | c.keys()
                s = sum(weight(h) * min(x[h], c[h]) for h in both) / sum(weight(h) * max(x[h], c[h]) for h in both)
                if s >= 0.8 and s > out.get((d, i), (0,))[0]:
                    out[d, i] = (s, w[a][1], w[a + m + 3][2])
    return {k: (round(v[0], 9), v[1], v[2]) for k, v in out.items()}


def check(spark, docs, items):
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): (round(r.similarity, 9), r.start, r.end) for r in dc.contaminated(d, b).collect()}
    want = brute(docs, items)
    assert got == want
    kept = sorted(str(r.doc_id) for r in dc.clean(d.selectExpr("doc_id", "'x' as item_id", "text"), b).collect())
    assert kept == sorted(str(i) for i, _ in docs if i not in {k[0] for k in want})
    return want


def test_documents(spark):
    t = lambda n, *c: [tuple(r) for r in spark.read.parquet(f"/root/testdata/sf0.01/{n}.parquet").select(*c).collect()]
    assert len(check(spark, t("documents", "doc_id", "text"), t("benchmark", "item_id", "text"))) > 5


def test_awkward(spark):
    item = " ".join(f"Q{i}" for i in range(40))
    w = item.split()
    changed = " ".join([*w[:-2], "other", "end"])
    items = [(1, item), (1, item), (2, "one two"), (3, None), (None, item), (4, "same five words right here"), (5, "a b " * 20), (6, "same five words right here and more of it")]
    docs = [
        (1, None), (2, ""), (3, item.upper()), (4, "Zéro " * 3000 + item.replace(" ", ", ") + " tail" * 3000), (5, changed), (6, "one two"), (7, "x same five words right here y"),
        (8, " ".join(w[:36])), (9, " ".join(w[:20])), (10, "a b a b a b a b a b " * 50), (11, " ".join(w[:20]) + " gap " + " ".join(w[20:])), (12, item), (13, item), (14, "same five words right here and more of it"),
    ]
    found = check(spark, docs, items)
    assert {(3, 1), (4, 1), (5, 1), (7, 4), (8, 1), (10, 5), (14, 6), (14, 4)} <= found.keys() and (9, 1) not in found
    assert dc.contaminated(spark.createDataFrame(docs, "doc_id long, text string").limit(0), spark.createDataFrame(items, "item_id long, text string")).count() == 0
    none = spark.createDataFrame([], "item_id long, text string")
    assert dc.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), none).count() == 0
    assert dc.clean(spark.createDataFrame(docs, "doc_id long, text string"), none).count() == len(docs)


def test_parts(spark, monkeypatch):
    """A benchmark beyond the broadcast bound takes several passes and finds the same (equal weights)."""
    items = [(i, " ".join(f"w{i}x{j}" for j in range(20))) for i in range(30)]
    docs = [(i, "pre " * i + t) for i, t in items]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    monkeypatch.setattr(dc, "ITEM_BYTES", 1000)
    assert sorted((r.doc_id, r.item_id) for r in dc.contaminated(d, b).collect()) == [(i, i) for i in range(30)]


def test_parts_share_shingles(spark, monkeypatch):
    """Forced parts weigh shingles as one part does: an item's by all items that hold them, others as the rarest, so that
    other items' shingles in a window (20 and on) weigh the same wherever these items are."""
    common, other = ([f"{x}{j}" for j in range(24)] for x in "ab")
    items = [(i, " ".join([*common, *(f"w{i}x{j}" for j in range(30))])) for i in range(12)] + [(50 + i, " ".join([*other, f"v{i}"])) for i in range(12)]
    docs = []
    for i in range(12):
        rare = [f"w{i}x{j}" for j in range(30)]
        docs += [(i, " ".join([*common[:12], "gap", *common[13:], *rare])), (20 + i, " ".join([*other[:8], *common[8:], *rare])), (40 + i, " ".join([*common, *rare[:25], "x", *rare[26:]]))]
    want = check(spark, docs, items)
    assert {(i, i) for i in range(12)} <= want.keys() and not {(20 + i, i) for i in range(12)} & want.keys()
    monkeypatch.setattr(dc, "ITEM_BYTES", 1000)
    assert check(spark, docs, items) == want


def test_short_documents_and_shared_shingles(spark, monkeypatch):
    """Documents of fewer than 0.8 of an item's shingles that weigh enough; one part and many give the same."""
    items = []
    for i in range(60):
        own = [f"r{i}x{j}" for j in range(40)]
        items.append((i, " ".join([*own, *([f"end{j}" for j in range(16)] if i % 2 else [f"t{i}x{j}" for j in range(16)])])))
    docs = [(i, " ".join(t.split()[:40])) for i, t in items] + [(100 + i, "pre " * 30 + t + " end1 end2 end3 end4 end5" * 3) for i, t in items[:20]]
    want = check(spark, docs, items)
    assert {(i, i) for i in range(1, 60, 2)} <= want.keys()
    assert not {(i, i) for i in range(0, 60, 2)} & want.keys()
    monkeypatch.setattr(dc, "ITEM_BYTES", 5000)
    assert check(spark, docs, items) == want


def random_items(n, size, seed):
    rng = np.random.default_rng(seed)
    return [(i, " ".join(f"w{x}" for x in rng.integers(0, 1 << 40, size))) for i in range(n)]


def test_index_is_exact_and_prunes():
    """The multi-index returns every item within the radius, and passes under 5 % of random pairs."""
    index = dc.Index.of(random_items(400, 30, 1), (np.zeros(0, np.uint64), np.zeros(0, np.int64)), 400)
    h = dc.Hamming(index)
    rng = np.random.default_rng(2)
    bits = rng.random((600, dc.BITS)) < 0.5
    row, item = h.passed(0, dc.block_values(bits))
    assert 0.02 < len(row) / (600 * 400) < 0.05
    own = np.unpackbits(index.prints.view(np.uint8), axis=1).astype(bool)
    near = np.repeat(own, 3, axis=0)
    for r in near:  # from far too few to far too many bits
        r[rng.choice(dc.BITS, rng.integers(0, 180), replace=False)] ^= True
    got = set(zip(*(x.tolist() for x in h.near(0, near)), strict=True))
    distance = (near[:, None, :] ^ own[None, :, :]).sum(2)
    assert got == set(zip(*(x.tolist() for x in np.nonzero(distance <= dc.RADIUS)), strict=True))
    assert len(got) > 500


def test_recall_of_fingerprints():
    """Windows of weighted similarity 0.8 to 0.82: at least 0.99 of them are within the radius, few of similarity 0.5."""
    rng = np.random.default_rng(3)
    found = {0.8: [], 0.5: []}
    for trial in range(700):
        n = int(rng.integers(9, 120))
        weights = rng.choice([0.7, 2.0, 6.0, 10.0], 2 * n) if trial % 2 else np.full(2 * n, 5.0)
        h = rng.integers(0, 1 << 63, 2 * n).astype(np.uint64)
        a, w = h[:n], weights[:n]
        for least in found:
            for k in range(n, 0, -1):  # the last k shingles are others
                b = np.concatenate([a[: n - k], h[n : n + k]])
                total = w.sum() + weights[n : n + k].sum()
                s = w[: n - k].sum() / total
                if least <= s <= least + 0.02:
                    x, y = (dc.fingerprints(p, dc.roots(q), np.zeros(1, int), n)[0] for p, q in ((a, w), (b, np.concatenate([w[: n - k], weights[n : n + k]]))))
                    found[least].append((x ^ y).sum() <= dc.RADIUS)
                    break
    assert len(found[0.8]) > 200 and np.mean(found[0.8]) >= 0.995
    assert len(found[0.5]) > 200 and np.mean(found[0.5]) < 0.1


def test_fingerprints_of_windows(monkeypatch):
    """Sums in pieces give what each window alone gives, repeated shingles included."""
    rng = np.random.default_rng(4)
    h = rng.integers(0, 9, 300).astype(np.uint64)
    h[100:200] = rng.integers(0, 1 << 62, 100)
    root = dc.roots(rng.random(300) * 9)
    at = np.array([0, 1, 5, 70, 130, 255])
    whole = dc.fingerprints(h, root, at, 45)
    for i, a in enumerate(at.tolist()):
        k = np.array([(h[a:j] == h[j]).sum() for j in range(a, a + 45)])
        assert (whole[i] == ((dc.directions(h[a : a + 45], k) * root[a : a + 45, None]).sum(0) > 0)).all()
    monkeypatch.setattr(dc, "PIECE", 16)
    assert (dc.fingerprints(h, root, at, 45) == whole).all()


def test_long_text():
    """A text of some MB with a passage in its middle, and one that repeats an item all through."""
    items = random_items(50, 40, 5)
    index = dc.Index.of(items, (np.zeros(0, np.uint64), np.zeros(0, np.int64)), 50)
    texts = ["lorem ipsum dolor sit amet " * 100_000 + items[7][1] + " consectetur" * 100_000, (items[3][1] + " ") * 5000]
    (_, _, data, offs), = tx.steps(pa.array(texts), 1 << 30)
    got = list(dc.Scanner(index, 0.8).scan(data, offs))
    assert [(d, i, s) for d, i, _, _, s in got] == [(0, 7, 1.0), (1, 3, 1.0)]
    assert data[got[0][2] : got[0][3]].tobytes().decode() == items[7][1] and got[1][2] == len(texts[0].encode())
