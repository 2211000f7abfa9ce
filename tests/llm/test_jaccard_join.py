"""N-gram Jaccard join against all pairs in plain Python, on real documents, awkward rows and large groups of copies."""

import random
import re
from collections import defaultdict

from accordis.llm import jaccard_join as jj


def sets(text, k=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def brute(rows):
    s = {i: (d, sets(t)) for i, (d, t) in enumerate(rows)}
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    by = defaultdict(list)
    for i, (_, x) in s.items():
        for g in x:
            by[g].append(i)
    pairs = {(a, b) for v in by.values() for i, a in enumerate(v) for b in v[i + 1 :]}
    for a, b in pairs:
        o = len(s[a][1] & s[b][1])
        if 100 * o >= 80 * (len(s[a][1]) + len(s[b][1]) - o):
            parent[find(a)] = find(b)
    low = {}
    for i, (d, _) in s.items():
        r = find(i)
        low[r] = min((x for x in (low.get(r), d) if x is not None), default=None)
    return sorted(((d, len(x), low[find(i)]) for i, (d, x) in s.items()), key=str)


def check(spark, rows, monkeypatch=None):
    d = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, n string")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jj.jaccard_join(d).collect()), key=str)
    assert got == brute(rows)


def test_documents(spark):
    check(spark, [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").limit(400).collect()])


def test_awkward(spark):
    long = " ".join(str(i * 7919 % 1013) for i in range(30_000))
    check(spark, [(1, None), (2, ""), (3, " \n"), (4, "a b c"), (5, "A b C"), (6, "a b"), (None, "a b c"), (7, long), (8, long + " end"), (9, "É x y z w v"), (10, "é x y z w v"), (7, long), (None, None)])
    assert jj.jaccard_join(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert [r.component_id for r in jj.jaccard_join(spark.createDataFrame([(3, None)], "doc_id long, text string")).collect()] == [3]


def test_groups(spark):
    # Near copies of some bases at all distances, with passages that many share, so that long lists and chains occur.
    rng = random.Random(3)
    word = lambda: f"w{rng.randrange(3000)}"
    shared = [word() for _ in range(60)]
    rows = []
    for _ in range(3):
        base = [word() for _ in range(150)]
        for _ in range(60):
            t = list(base)
            for _ in range(rng.randrange(9)):
                t[rng.randrange(len(t))] = word()
            rows.append((len(rows), " ".join(t)))
    for _ in range(60):
        rows.append((len(rows), " ".join(shared + [word() for _ in range(rng.randrange(2, 12))])))
    check(spark, rows)


def test_hot_columns(spark, monkeypatch):
    # Hot columns are dealt by row: the same results when every frequent token is hot.
    plain = jj._postings
    monkeypatch.setattr(jj, "_postings", lambda k, num, den, heavy, counts, blocks, hot, salts: plain(k, num, den, heavy, counts, blocks, 3, salts))
    test_groups(spark)


def test_sql(spark):
    import duckdb

    from accordis.llm.queries import ORACLE_SQL, QUERIES

    d = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{d}/documents.parquet'")
    want = sorted(con.execute(ORACLE_SQL["op3_ngram_jaccard_join"]).fetchall())
    got = sorted(tuple(r) for r in QUERIES["op3_ngram_jaccard_join"](spark, d).select("doc_id", "n_shingles", "component_id").collect())
    assert got == want and len({r[2] for r in got}) < len(got)


def test_most_frequent(spark, monkeypatch):
    """With room for a few frequent tokens only, the order differs and the results do not."""
    plain = jj.frequent_tokens
    sizes = []

    def few(*args):
        out = plain(*args, most=40, least=3)
        sizes.append(len(out[0]))
        return out

    monkeypatch.setattr(jj, "frequent_tokens", few)
    test_groups(spark)
    assert 0 <= sizes[0] <= 40
