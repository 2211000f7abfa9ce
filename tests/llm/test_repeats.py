"""Repeated passages by chunks and by suffixes: planted cases, plain-Python chunking, and awkward rows."""

import random
import re

import numpy as np
import pytest

from accordis.llm import substring_dedup as sub
from accordis.llm import suffix_dedup as suf
from accordis.llm import units


def words(rng, n):
    return [("".join(rng.choice("abcdefghijklmnoprstuvé") for _ in range(rng.randrange(2, 9)))) for _ in range(n)]


@pytest.fixture(scope="module")
def planted():
    rng = random.Random(8)
    docs, holds = [], {}
    passages = [" ".join(words(rng, 52 + 3 * i)) for i in range(12)]
    for i in range(150):
        body = words(rng, rng.randrange(60, 400))
        if i % 5 == 0:
            p = rng.randrange(len(passages))
            at = rng.randrange(len(body))
            body[at:at] = passages[p].split()
            holds[i] = p
        docs.append((i, " ".join(body)))
    docs.append((500, docs[3][1]))  # an exact copy
    return docs, holds, passages


@pytest.mark.parametrize("module", [sub, suf])
def test_planted(spark, planted, module, monkeypatch):
    monkeypatch.setattr(units, "UNIT_BYTES", 20_000)
    monkeypatch.setattr(units, "RANGE_BYTES", 50_000)
    docs, holds, passages = planted
    d = spark.createDataFrame(docs, "doc_id long, text string")
    rows = module.repeated_spans(d).collect()
    many = {p for p in holds.values() if sum(q == p for q in holds.values()) > 1}
    want = {i for i, p in holds.items() if p in many} | {3, 500}
    assert {r.doc_id for r in rows} == want
    text = dict(docs)
    for r in rows:
        got = text[r.doc_id][r.start : r.end] if module is sub else " ".join(text[r.doc_id].split()[r.start_word : r.end_word])
        if r.doc_id in holds:  # inside the passage, and most of it
            p = passages[holds[r.doc_id]]
            assert got.strip() in p and len(got) > 0.5 * len(p)
            assert r.first_doc_id == min(i for i, q in holds.items() if q == holds[r.doc_id]) and r.duplicate == (r.first_doc_id != r.doc_id)
    cut = {r.doc_id: r.text for r in module.deduplicated(d).collect()}
    assert all(cut[i] == text[i] for i in text if i not in want) and cut[3] == text[3] and len(cut[500]) < 0.05 * len(text[3])
    for i, p in holds.items():
        if p in many and any(j < i for j, q in holds.items() if q == p):
            assert len(cut[i]) < len(text[i]) - 0.5 * len(passages[p])


@pytest.mark.parametrize("module", [sub, suf])
def test_awkward(spark, module):
    rng = random.Random(2)
    p = " ".join(words(rng, 60))
    docs = [(1, None), (2, ""), (3, "short"), (4, "a " * 20_000), (None, p), (None, p + " tail"), (5, p), (5, p), (6, "é" * 3000), (7, p + "\n" + p)]
    d = spark.createDataFrame([(*x, 1, 2) for x in docs], "doc_id long, text string, start int, words int")
    rows = module.repeated_spans(d).collect()
    assert {5, 7, None} <= {r.doc_id for r in rows} and not {1, 2, 3} & {r.doc_id for r in rows}
    assert all(r.first_doc_id is None for r in rows if r.doc_id in (5, 7))
    out = module.deduplicated(d)
    assert out.columns == d.columns and out.count() == len(docs)
    assert module.repeated_spans(d.limit(0)).count() == 0 and module.deduplicated(d.limit(0)).count() == 0


def plain_chunks(b, gear):
    """The rules of cutting, byte by byte."""
    cuts, h, last = [], 0, -sub.MOST
    for i, x in enumerate(b):
        h = (h * 2 + int(gear[x])) & 0xFFFF
        at = i + 1
        if (h & int(sub.BITS)) == 0 and at < len(b) and (b[at] & 0xC0) != 0x80 and at >= sub.DEPTH:
            if at - last >= sub.LEAST:
                cuts.append(at)
            last = at
    out = [0]
    for c in [*cuts, len(b)]:
        start = out[-1]
        k = start + sub.MOST
        while k < c:
            while (b[k] & 0xC0) == 0x80:
                k -= 1
            out.append(k)
            start += sub.MOST
            k = start + sub.MOST
        if c < len(b):
            out.append(c)
    return out


def test_chunks():
    rng = random.Random(4)
    texts = [" ".join(words(rng, n)).encode() for n in (1, 30, 900)] + ["é".encode() * 2000, b"x" * 3000, b"ab"]
    data = np.frombuffer(b"".join(texts), np.uint8)
    offs = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    got = sub.chunk_starts(data, offs).tolist()
    want = [int(o) + c for t, o in zip(texts, offs) for c in plain_chunks(t, sub.GEAR)]
    assert got == want
    # What is inserted moves the cuts near it only.
    t = texts[2]
    moved = t[:700] + b" inserted words " + t[700:]
    one = lambda x: set(sub.chunk_starts(np.frombuffer(x, np.uint8), np.array([0, len(x)])).tolist())
    a, b = one(t), {c - 16 for c in one(moved) if c > 716}
    assert len({c for c in a if c > 760} ^ {c for c in b if c > 760}) == 0


def test_minimisers():
    rng = np.random.default_rng(1)
    g = rng.integers(0, 1 << 63, 500).astype(np.uint64)
    doc = np.repeat([0, 1, 2], [300, 20, 180])
    got = set(suf.minimisers(g, doc).tolist())
    want = set()
    for a, z in ((0, 300), (300, 320), (320, 500)):
        w = min(suf.LEAST_WORDS - suf.K + 1, z - a)
        want |= {i + int(np.argmin(g[i : i + w])) for i in range(a, z - w + 1)}
    assert got == want


def test_documents(spark):
    """Every document that holds 60 words which another holds too is found; none without 20 such words is."""
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").limit(400).collect()]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    held = {n: {} for n in (20, 60)}
    for i, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        for n, by in held.items():
            for k in range(len(w) - n + 1):
                by.setdefault(" ".join(w[k : k + n]), set()).add(i if n == 60 else (i, k))
    sure = {i for s in held[60].values() if len(s) > 1 for i in s}
    maybe = {i for s in held[20].values() if len(s) > 1 for i, _ in s}
    for module in (sub, suf):
        found = {r.doc_id for r in module.repeated_spans(d).collect()}
        assert len(sure - found) <= 0.02 * len(sure) and not found - maybe, (module.__name__, len(sure), len(sure - found), found - maybe)


def test_chunks_against_all_documents(spark, monkeypatch):
    """Spans of whole texts against a table of all chunks by their bytes."""
    monkeypatch.setattr(units, "UNIT_BYTES", 300_000)
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    docs = sorted({(r.doc_id, r.th, r.text or "") for r in d.selectExpr("doc_id", "xxhash64(text) th", "text").collect()})
    chunks, at = [], {}
    for k, (_, _, t) in enumerate(docs):
        b = t.encode()
        cut = [*sub.chunk_starts(np.frombuffer(b, np.uint8), np.array([0, len(b)])).tolist(), len(b)] if b else []
        chunks.append([b[a:z] for a, z in zip(cut, cut[1:], strict=False)])
        for n, c in enumerate(chunks[-1]):
            at.setdefault(c, []).append((k, n))
    want = []
    for k, (i, th, t) in enumerate(docs):
        words = [m.start() for m in re.finditer(rb"[^\x20\x09-\x0D]+", t.encode())]
        place, run = 0, []
        rows = []
        for n, c in enumerate([*chunks[k], None]):
            if c is not None and len(at[c]) > 1:
                first = at[c][0]
                run.append((place, place + len(c), first == (k, n), docs[first[0]][0]))
            elif run:
                rows.append(run)
                run = []
            place += len(c or b"")
        for run in rows:
            n_words = lambda a, z: sum(a <= w < z for w in words)  # noqa: E731, B023
            if n_words(run[0][0], run[-1][1]) < 25:
                continue
            points = lambda x: len(t.encode()[:x].decode())  # noqa: E731, B023
            part = [run[0]]
            for x in [*run[1:], None]:
                if x is not None and x[2] == part[0][2]:
                    part.append(x)
                    continue
                want.append((i, th, points(part[0][0]), points(part[-1][1]), n_words(part[0][0], part[-1][1]), min(p[3] for p in part), not part[0][2]))
                part = [x]
    got = {tuple(r) for r in sub.repeated_spans(d.repartition(7)).collect()}
    assert got == set(want) and len(want) > 500


def kept(spark, docs):
    return {r.doc_id: r.text.split() for r in suf.deduplicated(spark.createDataFrame(docs, "doc_id long, text string")).collect()}


def test_overlapping_excerpts(spark):
    """Each word of overlapping excerpts survives once; seams of fewer words than a passage has may stay."""
    w = words(random.Random(31), 200)
    docs = [(1, w[:60]), (2, w), (3, w[50:])]
    out = kept(spark, [(i, " ".join(x)) for i, x in docs])
    assert out[1] == w[:60] and out[2] == w[60:] and out[3] == []


def test_repeated_inside(spark):
    """Of a passage that one document repeats, the first place stays."""
    rng = random.Random(32)
    p, between = words(rng, 60), [words(rng, 40) for _ in range(8)]
    out = kept(spark, [(1, " ".join(" ".join([*p, *x]) for x in between)), (2, "no repeats here")])
    assert out[1] == [*p, *sum(between, [])]


def stretches(docs, n):
    """Words of each document in stretches of n words that are at two places or more, and at an earlier place."""
    at, low = {}, {}
    texts = sorted(set(docs), key=lambda d: (d[0] is not None, d[0] or 0, d[1]))
    lower = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    split = [(i, th, re.findall(r"[^\x20\x09-\x0D]+", lower(t))) for i, th, t in texts]
    for d, (_, _, w) in enumerate(split):
        for k in range(len(w) - n + 1):
            s = tuple(w[k : k + n])
            at[s] = at.get(s, 0) + 1
            low.setdefault(s, (d, k))
    out = {}
    for d, (i, th, w) in enumerate(split):
        hit, dup = set(), set()
        for k in range(len(w) - n + 1):
            s = tuple(w[k : k + n])
            if at[s] > 1:
                hit.update(range(k, k + n))
                if low[s] != (d, k):
                    dup.update(range(k, k + n))
        if hit:
            out[i, th] = (hit, dup)
    return out


def spans_of(rows):
    out = {}
    for r in set(rows):
        hit, dup = out.setdefault((r.doc_id, r.th), (set(), set()))
        hit.update(range(r.start_word, r.end_word))
        if r.duplicate:
            dup.update(range(r.start_word, r.end_word))
    return out


@pytest.mark.parametrize("least", [12, 30, 31])
def test_suffixes_against_all_stretches(spark, least, monkeypatch):
    """The words that brute force finds, and a few more where a differing word has the same code: passages of the least
    length, decoys that share one side, edits, repeats inside, mixed case, repeated rows."""
    monkeypatch.setattr(units, "UNIT_BYTES", 9_000)
    monkeypatch.setattr(units, "RANGE_BYTES", 30_000)
    rng = random.Random(least)
    passages = [words(rng, n) for n in (least - 1, least, least + 1, least + 2, 40, 40, 60, 90)]
    docs = []
    for i in range(240):
        body = words(rng, rng.randrange(5, 120))
        for _ in range(rng.randrange(3)):
            p = list(rng.choice(passages))
            kind = rng.random()
            if kind < 0.3:  # one side of a passage, beside other words
                k = rng.randrange(len(p))
                p = p[:k] if rng.random() < 0.5 else p[k:]
            elif kind < 0.5:
                p[rng.randrange(len(p))] = "changed"
            elif kind < 0.6:
                p = [x.upper() for x in p]
            at = rng.randrange(len(body))
            body[at:at] = p
        docs.append((i if i % 50 else None, " ".join(body)))
    docs += docs[:9]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    want = stretches([tuple(r) for r in d.selectExpr("doc_id", "xxhash64(text)", "text").collect()], least)
    first = None
    for n in (1, 5):
        got = spans_of(suf.repeated_spans(d.repartition(n), least_words=least).collect())
        first = first or got
        assert got == first and got.keys() == want.keys()
    assert all(v[0] <= got[k][0] and v[1] <= got[k][1] for k, v in want.items())
    assert sum(len(got[k][0] - v[0]) + len(got[k][1] - v[1]) for k, v in want.items()) <= 6
    assert len(want) > 60


@pytest.mark.parametrize("module", [sub, suf])
def test_rows_do_not_depend_on_partitions(spark, module, monkeypatch):
    monkeypatch.setattr(units, "UNIT_BYTES", 3000)
    rng = random.Random(7)
    p = [" ".join(words(rng, 80)) for _ in range(6)]
    docs = [(5, p[0])] * 4 + [(6, p[0])] * 2 + [(7, p[1] + " " + p[1])] * 3 + [(8, p[2])] * 2 + [(None, p[3]), (None, p[3] + " tail"), (9, p[3]), (9, p[4]), (9, p[4] + " x")]
    d = spark.createDataFrame(docs, "doc_id long, text string")
    want = None
    for n in (1, 3, 17):
        rows = sorted(module.repeated_spans(d.repartition(n)).collect(), key=str)
        want = want or rows
        assert rows == want
    count = lambda i: sum(r.doc_id == i for r in want)
    assert count(5) == 4 * (count(6) // 2) > 0 and count(8) == 0 and count(7) % 3 == 0 and count(7) > 0


def test_documents_against_all_stretches(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    want = stretches([tuple(r) for r in d.selectExpr("doc_id", "xxhash64(text)", "text").collect()], suf.LEAST_WORDS)
    got = spans_of(suf.repeated_spans(d).collect())
    assert got.keys() == want.keys()
    # A word that differs has the same 12-bit code once in 4,096.
    wrong = sum(len(got[k][0] ^ v[0]) + len(got[k][1] ^ v[1]) for k, v in want.items())
    assert wrong <= 0.001 * sum(len(v[0]) for v in want.values())


def test_codes():
    x = np.random.default_rng(0).integers(0, 4096, (50, 24)).astype(np.uint16)
    raw = suf.narrow(x)
    assert raw.shape == (50, 36) and (suf.wide(raw, 24) == x).all()
    assert sorted(range(50), key=lambda i: raw[i].tobytes()) == sorted(range(50), key=lambda i: x[i].tolist())
