"""The pipeline stage by stage and as a whole against plain versions; quality verdicts against a plain EM."""

import numpy as np
import plain
import pytest

import corpus_pipeline
from siftgauge.llm import op2_quality, op9_packing

R = np.random.default_rng(3)
VOCAB = [f"{a}{b}" for a in ("ka", "lo", "mi", "nu", "ré", "so", "ta", "ve") for b in ("n", "r", "st", "l", "m", "ch")]
#: Documents, with columns named as the stages name theirs.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, t string, r string, of string, n_bytes int, kept string, kept_sha256 string, _row int, _id int, _quality_a int, row string, a int, c0 string, key long"


def prose(n):
    out = []
    while len(out) < n:
        s = R.choice(VOCAB, int(R.integers(6, 14))).tolist()
        out += [s[0].capitalize(), *s[1:-1], s[-1] + "."]
    return " ".join(out[:n]) + "."


def corpus():
    shared, leak = prose(70), prose(14)
    texts = [prose(int(n)) for n in R.integers(60, 400, 30)]
    texts += [texts[0], texts[0], texts[1] + " One more.", prose(80) + " " + shared + " " + prose(60), prose(90) + "\n" + shared, "Über " + shared + " " + prose(90)]
    texts += [prose(60) + " " + leak + " " + prose(60), "### $$$ && " * 60, "BUY NOW! " * 50, " ".join(f"{k}%" for k in range(90)), "short one.", "", None, " \n", "a" * 5000, prose(9000)]
    rows = list(enumerate(texts))
    return [*rows, (3, texts[3]), (None, texts[4]), (None, prose(100)), (2, prose(120))], [(1, leak), (2, "absent words here"), (None, texts[5]), (3, None), (4, "")]


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    docs, bench = corpus()
    folder = f"file://{tmp_path_factory.mktemp('sf')}"
    spark.createDataFrame([(i, t, "xx", None, None if t is None else len(t), "a", "b", "c", 1, "d", "e", 2, 3, 4, "f", 5, "g", 6) for i, t in docs], SCHEMA).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, docs, bench


def pairs(df):
    return sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=str)


def test_verdicts_equal_a_plain_em(spark, small):
    folder, docs, _ = small
    got = op2_quality.score(spark.read.parquet(f"{folder}/documents.parquet"), keys=("doc_id", "text")).collect()
    want = plain.kept([t for _, t in docs])
    assert sorted(((r["doc_id"], r["text"], r["kept"]) for r in got), key=str) == sorted(((i, t, k) for (i, t), k in zip(docs, want)), key=str)
    assert 25 < sum(want) <= len(docs) - 8


def test_every_stage_and_the_whole_equal_plain_versions(spark, small):
    folder, docs, bench = small
    want = [d for d, k in zip(docs, plain.kept([t for _, t in docs])) if k]
    steps = [want]
    steps.append(plain.one_of_each(steps[-1]))
    steps.append(plain.without_repeats(steps[-1]))
    steps.append(plain.clean(steps[-1], bench))
    now = spark.read.parquet(f"{folder}/documents.parquet")
    for k, ((name, stage), expected) in enumerate(zip(corpus_pipeline.STAGES, steps)):
        out = stage(spark, now, folder)
        assert out.columns == now.columns, name
        out.write.parquet(f"{folder}/after{k}")
        now = spark.read.parquet(f"{folder}/after{k}")
        assert pairs(now) == sorted(expected, key=str), name
        assert all(r["_id"] == 3 and r["t"] == "a" and r["kept"] == "d" and r["n_chars"] == len(r["text"]) for r in now.collect()), name
    assert len(steps[1]) < len(steps[0]) and steps[2] != steps[1] and len(steps[3]) == len(steps[2]) - 1
    packed = sorted(map(tuple, corpus_pipeline.STAGES[4][1](spark, now, folder).collect()), key=str)
    assert sorted(map(tuple, corpus_pipeline.run(spark, folder).collect()), key=str) == packed


def test_packing_of_the_result(spark, small):
    import public_tokenizers
    from tokenizers import Tokenizer

    folder, docs, _ = small
    path = public_tokenizers.path("word_bpe_49k.json")
    got = op9_packing.pack_documents(spark.read.parquet(f"{folder}/documents.parquet"), path, buckets=4, budget=2000).collect()
    encode = Tokenizer.from_file(path)
    lengths = sorted(len(encode.encode(t or "", add_special_tokens=False).ids) + 1 for _, t in docs)
    assert sorted(r["n_tokens"] for r in got) == lengths
    levels, counts = np.unique(lengths, return_counts=True)
    cost = lambda i, j: int(((levels[j - 1] - levels[i:j]) * counts[i:j]).sum())
    least = np.r_[0.0, np.full(len(levels), np.inf)]
    for _ in range(4):
        least = np.array([0.0] + [min(least[i] + cost(i, j) for i in range(j)) for j in range(1, len(levels) + 1)])
    assert sum(r["padded_length"] - r["n_tokens"] for r in got) == least[-1]
    batches = {}
    for r in got:
        batches.setdefault((r["bucket"], r["padded_length"], r["batch"]), []).append(r["place"])
    for (bucket, length, batch), places in batches.items():
        assert sorted(places) == list(range(len(places))) and len(places) <= max(1, 2000 // length)
        full = (bucket, length, batch + 1) in batches
        assert not full or len(places) == max(1, 2000 // length)


def test_empty_tables(spark, small):
    folder = small[0]
    docs = spark.read.parquet(f"{folder}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, folder).count() == 0
