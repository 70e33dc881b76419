"""Naive Bayes against a plain version, and its defined results."""

import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from siftgauge.llm import op5_language as op

SCHEMA = "doc_id long, text string, lang string, k0 string, t long, lang_pred string"


def table(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "y") for r in rows], SCHEMA).repartition(3)


def predictions(docs):
    model = op.fit(docs.where("lang IS NOT NULL").withColumn("_pick", F.lit(0)))
    return op.predict(docs, *model, {"doc_id": F.col("doc_id")}).collect()


def plain_grams(text):
    chars = [" ", " ", *(c.lower() if c.isalpha() and len(c.lower()) == 1 else c if c.isalpha() else " " for c in text), " ", " "]
    out = []
    for k in range(2, len(chars)):
        a, b, c = (ord(x) for x in chars[k - 2 : k + 1])
        one = c * 0x9E3779B1
        two = one + b * 0x85EBCA77
        three = two + a * 0xC2B2AE3D
        for v in (one, two ^ 0x5BD1E995, three ^ 0x27D4EB2F):
            v &= 0xFFFFFFFF
            v ^= v >> 15
            out.append(((v * 0x2C1B3C6D) & 0xFFFFFFFF) >> 16)
    return out


TEXTS = [("Les œufs de l’été, déjà vus", "fr"), ("the quick brown fox", "en"), ("ÜBER den Fluß", "de"), ("漢字かな 文、。", "ja"), ("over the hill and far away", "en"), ("le garçon et la fille", "fr"), ("😀 日本 😀", "ja")]


def test_scores_equal_a_plain_version(spark):
    got = {r["doc_id"]: r for r in predictions(table(spark, [(k, *x) for k, x in enumerate(TEXTS)]))}
    counts, docs = {}, Counter(lang for _, lang in TEXTS)
    for text, lang in TEXTS:
        counts.setdefault(lang, Counter()).update(plain_grams(text))
    for k, (text, _) in enumerate(TEXTS):
        logs = {lang: math.log(docs[lang] / len(TEXTS)) + sum(math.log((c[g] + op.SMOOTHING) / (sum(c.values()) + op.SMOOTHING * op.BUCKETS)) for g in plain_grams(text)) for lang, c in counts.items()}
        best = max(sorted(logs), key=logs.get)
        assert got[k]["lang_pred"] == best
        assert got[k]["score"] == pytest.approx(1 / sum(math.exp(v - logs[best]) for v in logs.values()), abs=1e-9)


def test_a_text_is_scored_alone():
    alone, offsets, _ = op.grams(pa.array(["der"]))
    for before in ("abc", "xyz", None, ""):
        buckets, at, _ = op.grams(pa.array([before, "der", "more"]))
        assert (buckets[:, at[1] : at[2]] == alone[:, offsets[0] : offsets[1]]).all()


def test_defined_results(spark):
    rows = [(1, None, "en"), (2, "", "de"), (3, "12 !? 😀 、", None), (None, "the end", "en"), (5, "x" * 3_000_000, "de"), (7, "the cat", None), (7, "the cat", None), (8, "the cat", "en")]
    got = predictions(table(spark, rows))
    assert len(got) == len(rows)
    by = {r["doc_id"]: r for r in got}
    assert all(by[k]["lang_pred"] == "und" and by[k]["score"] == 0 for k in (1, 2, 3))
    assert by[5]["lang_pred"] == "de" and len({tuple(r) for r in got if r["doc_id"] == 7}) == 1
    assert all(0 <= r["score"] <= 1 for r in got)
    unlabelled = table(spark, [(1, "the cat", None)])
    assert [r["lang_pred"] for r in predictions(unlabelled)] == ["und"]
    assert predictions(table(spark, []).where("doc_id > 0")) == []
    tie = predictions(table(spark, [(1, "same", "b"), (2, "same", "a")]))
    assert {r["lang_pred"] for r in tie} == {"a"} and {round(r["score"], 9) for r in tie} == {0.5}
    assert sum(r["held_out"] for r in table(spark, rows).select(op.held_out().alias("held_out")).collect()) == sum(__import__("zlib").crc32(str(i).encode()) % 3 == 1 for i, *_ in rows if i is not None)


def test_sparse_counts():
    rng = np.random.default_rng(1)
    buckets, offsets = rng.integers(0, 1 << 16, (3, 50)).astype(np.int32) % 7, np.array([0, 10, 10, 50])
    text, bucket, count = op.sparse_counts(buckets, offsets)
    want = Counter((t, int(b)) for t in range(3) for b in buckets[:, offsets[t] : offsets[t + 1]].ravel())
    assert dict(zip(zip(text.tolist(), bucket.tolist()), count.tolist())) == want
