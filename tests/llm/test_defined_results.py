"""Nulls, empties, ties, repeats, long texts, empty tables and clashing column names, operator by operator."""

import hashlib
import tracemalloc
import zlib
from collections import Counter

import pyarrow as pa

from siftgauge.llm import op1_suffix_dedup, op3_warc_zip, op4_token_store, op6_jaccard_join, op7_sharding, op9_packing, store

CLASH = "doc_id long, text string, r string, t string, h int, c int, at int, runs string, row string, node string, n string, token string, component string, i string, key string, shard string, base string, g string, upto string, slot string, n_tokens string, _block string"
EXTRA = ("x",) * 2 + (1,) * 3 + ("x",) * 15


def table(spark, rows):
    return spark.createDataFrame([(*r, *EXTRA) for r in rows], CLASH).repartition(4)


def test_many_copies_of_one_row(spark):
    text = " ".join(f"w{k}" for k in range(600))
    rows = [(7, text)] * 60 + [(8, text + " tail"), (9, "other " * 10), (None, None)]
    got = op1_suffix_dedup.deduplicate(table(spark, rows)).collect()
    assert len(got) == len(rows)
    size = len(text.encode())
    by = Counter((r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"]) for r in got)
    assert by == {(7, size, size, 1): 60, (8, size + 5, size, 1): 1, (9, 60, 0, 0): 1, (None, 0, 0, 0): 1}
    assert {r["kept_sha256"] for r in got if r["doc_id"] == 8} == {hashlib.sha256(b" tail").hexdigest()}


def test_joined_copies(spark):
    long = " ".join(f"z{k}" for k in range(200_000))
    rows = [(5, long), (4, long + " end"), (6, long), (1, ""), (2, None), (3, " \n"), (9, "one two"), (8, "ONE two"), (8, "ONE two")]
    got = sorted(map(tuple, op6_jaccard_join.linked(table(spark, rows)).collect()))
    assert got == sorted([(5, 199_997, 4), (4, 199_998, 4), (6, 199_997, 4), (1, 0, 1), (2, 0, 2), (3, 0, 3), (9, 1, 8), (8, 1, 8), (8, 1, 8)])
    assert op6_jaccard_join.linked(table(spark, rows).limit(0)).count() == 0
    kept = op6_jaccard_join.one_of_each(table(spark, rows))
    assert sorted((r["doc_id"], r["row"], r["r"]) for r in kept.collect()) == [(k, "x", "x") for k in (1, 2, 3, 4, 8)]


def test_archives(spark, tmp_path):
    rows = [(3, "http://b.a.example/x y", "same"), (3, "http://b.a.example/x y", "same"), (4, None, "same"), (5, "u", "x" * 3_000_000), (6, "http://c/", None), (None, "http://c/", "same")]
    pages = spark.createDataFrame([(*r, 1, "d", 2, "u") for r in rows], "page_id long, url string, html string, p int, d string, first int, h string")
    archives = op3_warc_zip.write_archives(pages, f"file://{tmp_path}/w", archive_bytes=200)
    got = Counter((r["page_id"], r["payload_bytes"], r["record_type"], r["refers_to"]) for r in op3_warc_zip.read_archives(archives).collect())
    assert got == {(3, 4, "response", None): 2, (4, 4, "revisit", 3): 1, (5, 3_000_000, "response", None): 1, (6, 0, "response", None): 1, (None, 4, "revisit", 3): 1}
    assert sum(r["records"] for r in archives.collect()) == 6 and archives.count() > 1
    with open(archives.first()["path"].removeprefix("file://"), "rb") as f:
        package = op3_warc_zip.ZipArchive(f)
        assert zlib.decompressobj(31).decompress(package.read(op3_warc_zip.DATA)).startswith(b"WARC/1.1\r\nWARC-Type: warcinfo")
        lines = package.read(op3_warc_zip.INDEX).decode().splitlines()
        assert lines == sorted(lines, key=lambda x: x.split(" ")[0])
    assert op3_warc_zip.surt("http://B.a.example:80/x?q") == "example,a,b)/x?q" and op3_warc_zip.surt(None) == "-" and op3_warc_zip.surt("u v") == "u%20v"


def test_stored_ids(spark, tmp_path):
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    rows = [(2, "b"), (2, "a b c"), (2, None), (None, "n"), (None, "n"), (1, "word " * 300_000), (3, "")]
    got = sorted((tuple(r) for r in op4_token_store.read_store(op4_token_store.write_store(table(spark, rows), f"file://{tmp_path}/t", path, 2)).collect()), key=lambda r: r[1])
    assert [r[0] for r in got] == [None, None, 1, 2, 2, 2, 3] and [r[1] for r in got] == [sum(x[2] for x in got[:k]) for k in range(7)]
    assert got[-1][2] == 1 and got[2][2] > 300_000
    assert op4_token_store.read_store(op4_token_store.write_store(table(spark, rows).limit(0), f"file://{tmp_path}/e", path, 2)).count() == 0


def test_shards(spark):
    rows = [(None, "a"), (None, None), (None, None), (1, "a"), (2, ""), (3, "x" * 2_000_000), (3, "x" * 2_000_000)]
    got = op7_sharding.shard_rows(table(spark, rows), 3).collect()
    assert len(got) == len(rows) and len({r["shard"] for r in got if r["size"] == 9}) == 1 and len({r["shard"] for r in got if r["size"] > 100}) == 1
    assert sorted((r["size"], r["text_crc32"]) for r in got) == sorted((8 + len(t or ""), zlib.crc32((t or "").encode())) for _, t in rows)
    for s in {r["shard"] for r in got}:
        own = sorted(r["slot"] for r in got if r["shard"] == s)
        assert own == list(range(len(own)))


def test_packed_rows(spark):
    import public_tokenizers

    rows = [(None, None), (1, ""), (1, ""), (2, "a b c d"), (3, "word " * 100_000)]
    got = op9_packing.pack_documents(table(spark, rows), public_tokenizers.path("word_bpe_49k.json"), buckets=2).collect()
    assert sorted(r["n_tokens"] for r in got)[:3] == [1, 1, 1] and len(got) == 5 and max(r["padded_length"] for r in got) > 100_000


def test_texts_meet_python_in_small_pieces(spark):
    """A worker never holds many texts, nor many arrays of a word for each of their bytes."""
    texts = [" ".join(f"{k}w{j}" for j in range(20_000)) for k in range(60)]
    rows = spark.createDataFrame(list(enumerate(texts)), "r long, t string").coalesce(1)

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], ["n"])

    held = [r["n"] for r in store.Tables(spark, "pieces").write(rows.mapInArrow(sizes, "n long")).collect()]
    assert sum(held) > sum(map(len, texts)) and max(held) < 5 << 20

    class Rows:
        def mapInArrow(self, f, schema):
            return f

    batch = pa.RecordBatch.from_arrays([pa.array(range(30)), pa.array(texts[:30])], ["r", "t"])
    tracemalloc.start()
    try:
        assert sum(b.num_rows for b in op1_suffix_dedup._contexts(Rows(), 200, 32)(iter([batch]))) > 10_000
        assert tracemalloc.get_traced_memory()[1] < 64 << 20
    finally:
        tracemalloc.stop()
