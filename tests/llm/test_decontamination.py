"""Phrase and proximity matches against brute force, blocks, and defined results."""

import hashlib
import re

import numpy as np
from siftgauge.llm import op10_decontaminate as op

R = np.random.default_rng(11)
DOCS = "doc_id long, text string, lang string, shard string, place int, c0 int, key string, items string"


def split(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, bench, width, slop=0):
    want = []
    for doc_id, text in docs:
        w, hit, items = split(text), set(), set()
        for item, phrase in bench:
            own = split(phrase)
            n = min(width, len(own))
            if item is None or not n:
                continue
            for window in {tuple(own[k : k + n]) for k in range(len(own) - n + 1)}:
                for s in range(len(w) - n + 1):
                    near = lambda j: w[max(0, s + j - slop) : s + j + slop + 1]
                    if w[s] == window[0] and all(window[j] in near(j) for j in range(1, n)):
                        hit |= set(range(s, s + n))
                        items.add(str(item))
        want.append((doc_id, len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), bool(hit)))
    return sorted(want, key=str)


def tables(spark, docs, bench):
    made = spark.createDataFrame([(*d, "en", "s", k, k, "k", "i") for k, d in enumerate(docs)], DOCS).repartition(3)
    return made, spark.createDataFrame([(*b, 1) for b in bench], "item_id long, text string, doc_id long")


def test_matches_equal_brute_force(spark):
    words = ["the", "The", "cat", "Ünder", "mat", "sat", "on2"]
    text = lambda n: " ".join(R.choice(words, n).tolist())
    docs = [(k, text(int(R.integers(0, 60)))) for k in range(30)] + [(None, text(30)), (3, text(30)), (40, None), (41, ""), (42, "... !"), (43, "the " * 5000), (44, "cat mat"), (44, "cat mat")]
    bench = [(1, text(4)), (2, text(9)), (3, "cat"), (2, text(5)), (10, "the the the"), (4, ""), (5, None), (None, "mat"), (1, text(4)), (9, "?!")]
    made, items = tables(spark, docs, bench)
    for slop in (0, 1, 2):
        for block in (1 << 20, 5):
            got = sorted(map(tuple, op.decontaminate(made, items, width=4, slop=slop, block_words=block).collect()), key=str)
            assert got == brute(docs, bench, 4, slop)
    rows = op.clean(made, items, width=4, block_words=5)
    assert rows.columns == made.columns
    bad = {d[0] for d in brute(docs, bench, 4) if d[5]}
    assert sorted((r["doc_id"] for r in rows.collect()), key=str) == sorted((r[0] for r in brute(docs, bench, 4) if not r[5]), key=str) and bad


def test_empty_tables(spark):
    docs, bench = tables(spark, [(1, "the cat sat")], [(1, "cat")])
    assert op.decontaminate(docs.limit(0), bench).collect() == [] and op.clean(docs.limit(0), bench).collect() == []
    none = hashlib.sha256(b"").hexdigest()
    assert [tuple(r) for r in op.decontaminate(docs, bench.limit(0)).collect()] == [(1, 3, 0, 0, none, False)]
    assert op.clean(docs, bench.limit(0)).count() == 1


def test_the_index_is_stored_and_holds_every_token(spark):
    docs, _ = tables(spark, [(k, "one two two three " * (k + 1)) for k in range(5)], [(1, "x")])
    from pyspark.sql import functions as F

    store = op.Tables(spark, "test")
    index = op.write_index(docs.select(F.col("doc_id").alias("i"), F.lit(1).cast("long").alias("key"), F.col("text").alias("t")), store)
    assert sum(len(r["positions"]) // 4 for r in index.collect()) == 60 and index.inputFiles()
