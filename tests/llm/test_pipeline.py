"""Each stage of the pipeline on awkward rows and on documents, against brute force on its own input."""

import re
from collections import Counter, defaultdict

import corpus_pipeline as cp
from tests.llm.test_contract_ops import plain
from tests.llm.test_decontaminate import brute as leaks
from tests.llm.test_jaccard_join import brute as groups

D = "/root/testdata/sf0.01"


def test_stages(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet").limit(500)
    copy = " ".join(f"w{i}" for i in range(80))
    odd = [(100_000, None, None, None, None), (100_001, "", "en", "src1", 0), (None, copy, None, "src1", 5), (None, copy, None, "src1", 5), (100_002, copy + " end", "en", None, 1), (7, copy, "x", "src2", 1)]
    docs = docs.unionByName(spark.createDataFrame(odd, docs.schema)).withColumn("size", docs.n_chars * 0 + 7).withColumn("n_words", docs.n_chars)
    names, rows = docs.columns, docs.collect()
    for name, stage in cp.STAGES:
        out = cp.written(stage(spark, docs, D), name)
        got = out.collect()
        key = lambda r: (r.doc_id, r.text)
        before, after = Counter(map(key, rows)), Counter(map(key, got))
        if name == "quality_rules":
            fails = lambda t: plain(t)[0] < 50 or 2 * plain(t)[4] > plain(t)[0]
            assert not after - before and not any(fails(t) for _, t in after)
            labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{D}/labels.parquet").collect()}
            good = [k for k in before if labels.get(k[0]) == 1 and not fails(k[1])]
            assert sum(k in after for k in good) > 0.97 * len(good)
        if name == "ngram_jaccard_join":
            ids = {i: k for i, k in enumerate(before)}
            root = {i: c for i, _, c in groups([(i, k[1]) for i, k in ids.items()])}
            assert Counter(root.values()).keys() == Counter(root[next(i for i in ids if ids[i] == k)] for k in after).keys() and len(after) == len(set(root.values())) == len(got)
        if name == "benchmark_decontamination":
            items = [(r.item_id, r.text) for r in spark.read.parquet(f"{D}/benchmark.parquet").collect()]
            bad = {k[0] for k in leaks([(k, k[1]) for k in before], items)}
            assert bad and after == Counter({k: n for k, n in before.items() if k not in bad})
        if name == "mixing":
            assert not set(after) - set(before) and max(after.values()) <= 3
            n = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
            assert abs(sum(n(r.text) for r in got) - sum(n(r.text) for r in rows)) < 0.1 * sum(n(r.text) for r in rows)
        if name == "sharding":
            assert after == before
            slots = defaultdict(list)
            for r in got:
                slots[r.shard].append(r.slot)
            assert all(sorted(v) == list(range(len(v))) for v in slots.values())
        else:
            assert out.columns == names
        docs, rows = out, got


def test_empty(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet").limit(0)
    for _, stage in cp.STAGES:
        docs = cp.written(stage(spark, docs, D), "empty")
        assert docs.count() == 0


def test_run(spark):
    assert cp.run(spark, "/root/testdata/sf0.001").count() > 50
