"""The operators against brute force on small tables with nulls, empties, repeats and clashing columns."""

import hashlib
import io
import re
import zipfile
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pytest

from siftgauge.llm import mph, op1_suffix_dedup, op2_quality, op3_warc_zip, op4_token_store, op5_language, op6_jaccard_join, op7_sharding, op8_html, op9_packing, op10_decontaminate, suffixes

R = np.random.default_rng(5)
WORDS = ["alpha", "Béta", "gamma", "delta,", "eps", "zeta", "eta.", "theta"]


def words(n):
    return " ".join(R.choice(WORDS, n).tolist()) + f" {R.integers(1e9)}"


PASSAGE = words(60)
TEXTS = [None, "", " \n ", "one", PASSAGE, PASSAGE, PASSAGE + " tail end", "lead in " + PASSAGE, words(400), words(90) + "\n" + PASSAGE + "\n" + words(5), "ab" * 300, "### $$$ " * 60, words(3000)]
TEXTS += [TEXTS[8].replace("gamma", "gamma", 1) + " x", TEXTS[8] + " y z"]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(k, t, ["en", None][k % 2], k, k, "row") for k, t in enumerate(TEXTS)] + [(4, TEXTS[4], "en", 9, 9, "row")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, h long, token long, _k string").repartition(3).cache()


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string")


def brute_removed(texts, width):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[k : k + width] for b in raw for k in range(len(b) - width + 1))
    out = []
    for b in raw:
        gone = np.zeros(len(b), bool)
        for k in range(len(b) - width + 1):
            if seen[b[k : k + width]] > 1:
                gone[k : k + width] = True
        out.append((len(b), int(gone.sum()), len(op1_suffix_dedup.runs_of(gone)), hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("shard_bytes", [1 << 20, 900])
def test_suffix_dedup(spark, docs, shard_bytes):
    got = sorted(tuple(r)[1:] for r in op1_suffix_dedup.deduplicate(docs, shard_bytes=shard_bytes).collect())
    assert got == brute_removed([r["text"] for r in docs.collect()], 200)
    assert op1_suffix_dedup.deduplicate(empty(spark)).count() == 0


def test_suffix_dedup_repeated_row_of_a_split_anchor(spark):
    core = " ".join(f"core{k}" for k in range(26))
    rows = [(k, f"{k:03d}" * 30 + core + f"{k + 500:03d}" * (k % 5)) for k in range(24)]
    rows += [rows[0], (None, rows[1][1]), (None, rows[1][1]), rows[2], rows[2]]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(tuple(r)[1:] for r in op1_suffix_dedup.deduplicate(docs, shard_bytes=900).collect())
    assert got == brute_removed([t for _, t in rows], 200)


def test_suffix_array_and_prefixes():
    for _ in range(60):
        parts = [bytes(R.integers(97, 99, R.integers(1, 40)).astype(np.uint8)) for _ in range(R.integers(1, 5))]
        sym, _ = suffixes.symbols(parts)
        sa, s = suffixes.suffix_array(sym), sym.tolist()
        assert sa.tolist() == sorted(range(len(s)), key=lambda i: s[i:])
        lcp = suffixes.common_prefixes(sym, sa, 12)
        for a, b in zip(sa[:-1], sa[1:]):
            k = 0
            while k < 12 and max(a, b) + k < len(s) and s[a + k] == s[b + k]:
                k += 1
            assert lcp[b] == k


def test_quality_counts(spark, docs):
    for r in op2_quality.score(docs).collect():
        text = TEXTS[r["doc_id"]] or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        grams = Counter(zip(w, w[1:], w[2:]))
        covered = {k + j for k, g in enumerate(zip(w, w[1:], w[2:])) if grams[g] > 1 for j in range(3)}
        lines = [x for x in text.split("\n") if x.strip(" \t\n\x0b\x0c\r")]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered))
        assert r["base_failed"] == (len(w) < 50 or 100 * len(covered) > 50 * len(w))
    assert op2_quality.score(empty(spark)).count() == 0
    kept = op2_quality.keep_good(docs)
    assert kept.columns == docs.columns and 11 not in [r["doc_id"] for r in kept.collect()]


def test_em_finds_the_bad_pattern(spark):
    rows = [([1, 1, 1, 1, 0, 0, 0, 0],)] * 90 + [([-1, -1, -1, 1, 0, 0, 0, 0],)] * 10
    model = op2_quality.fit(spark.createDataFrame(rows, "votes array<int>"))
    assert 0.8 < model["prior"] < 0.95 and model["right"][0] > 0.95


@pytest.mark.parametrize("zip64", [False, True])
def test_warc_zip(spark, tmp_path, zip64):
    rows = [(1, "http://a/", "same"), (2, "http://a/b c", "same"), (3, None, None), (4, "x", ""), (5, "u", "other é"), (2, "u", "more"), (None, "n", "lone")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    archives = op3_warc_zip.write_archives(pages, f"file://{tmp_path}/w", zip64=zip64)
    got = sorted((tuple(r) for r in op3_warc_zip.read_archives(archives).collect()), key=str)
    digest = lambda s: op3_warc_zip.payload_digest(s.encode())
    want = [(1, 4, digest("same"), "response", None), (2, 4, digest("same"), "revisit", 1), (3, 0, digest(""), "response", None), (4, 0, digest(""), "revisit", 3), (5, 8, digest("other é"), "response", None), (2, 4, digest("more"), "response", None), (None, 4, digest("lone"), "response", None)]
    assert got == sorted(want, key=str)
    for r in archives.collect():
        with zipfile.ZipFile(r["path"].removeprefix("file://")) as z:
            assert z.testzip() is None and set(z.namelist()) == {op3_warc_zip.DATA, op3_warc_zip.INDEX}
    assert op3_warc_zip.read_archives(op3_warc_zip.write_archives(pages.limit(0), f"file://{tmp_path}/e")).count() == 0


def test_zip_reader_on_foreign_file():
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("a", b"12345")
        z.comment = b"note"
    assert op3_warc_zip.ZipArchive(buffer).read("a", 1, 3) == b"234"


def test_perfect_hash():
    keys = np.unique(R.integers(0, 2**63, 20_000)).astype(np.uint64)
    h = mph.PerfectHash.load(mph.PerfectHash.build(keys).dump())
    assert sorted(h.slots(keys).tolist()) == list(range(len(keys)))
    assert mph.PerfectHash.build(np.zeros(0, np.uint64)).slots(keys[:2]).tolist() == [-1, -1]


def test_token_store(spark, docs, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    extra = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(None, "null key"), (77, "x<|endoftext|>y É Σας")], "doc_id long, text string"))
    got = op4_token_store.read_store(op4_token_store.write_store(extra, f"file://{tmp_path}/t", path, 2)).collect()
    encode, start = Tokenizer.from_file(path), 0
    rows = sorted(((r["doc_id"], r["text"]) for r in extra.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    want = []
    for key, text in rows:
        ids = np.array(encode.encode(text or "", add_special_tokens=False).ids + [2], "<u4")
        want.append((key, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted((tuple(r) for r in got), key=lambda r: r[1]) == want


def test_language(spark):
    rows = [(k, t, l) for k, (t, l) in enumerate([("the quick brown fox and the dog", "en"), ("der schnelle braune Fuchs und", "de")] * 30)] + [(90, None, "en"), (91, "123 !!", "en"), (92, "and the fox", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    train = docs.where(~op5_language.held_out()).selectExpr("*", "0L AS _pick")
    from pyspark.sql import functions as F

    got = {r["doc_id"]: r for r in op5_language.predict(docs, *op5_language.fit(train), {"doc_id": F.col("doc_id"), "held_out": op5_language.held_out()}).collect()}
    assert all(got[k]["lang_pred"] == ("en", "de")[k % 2] for k in range(60)) and got[92]["lang_pred"] == "en"
    assert got[90]["lang_pred"] == got[91]["lang_pred"] == "und" and all(0 <= r["score"] <= 1 for r in got.values())
    assert got[3]["held_out"] == (zlib.crc32(b"3") % 3 == 1)


@pytest.mark.parametrize("width,percent", [(4, 85), (5, 80), (1, 50)])
def test_jaccard_join(spark, docs, width, percent):
    many = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(100 + k, " ".join(f"w{j}" for j in range(k % 7, 40 + k % 11))) for k in range(60)], "doc_id long, text string"))
    rows = many.collect()
    sets = []
    for r in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), r["text"] or ""))
        sets.append({tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(range(len(rows)), 2):
        if sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            root[find(a)] = find(b)
    least = {}
    for k, r in enumerate(rows):
        least[find(k)] = min(least.get(find(k), 1 << 60), r["doc_id"])
    want = sorted((r["doc_id"], len(sets[k]), least[find(k)]) for k, r in enumerate(rows))
    assert sorted(tuple(r) for r in op6_jaccard_join.linked(many, width=width, percent=percent).collect()) == want


def test_jaccard_join_null_and_repeated_ids(spark):
    text = lambda k, tail="": " ".join(f"v{k}x{j}" for j in range(60)) + tail
    rows = [(None, text(0)), (5, text(0)), (7, text(0)), (3, text(0, " more")), (None, text(0, " end"))]  # a null id in a group of equals
    rows += [(None, text(1)), (None, text(1)), (None, text(1, " end"))]  # null ids only
    rows += [(20, text(2)), (20, text(3)), (21, text(2, " end")), (22, text(3, " end")), (19, text(3, " more"))]  # an id with two texts
    rows += [(20, text(4)), (None, ""), (None, text(5))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sets = [set(zip(*(t.split()[k:] for k in range(4)))) for _, t in rows]
    near = lambda a, b: 100 * len(a & b) >= 85 * max(1, len(a | b))
    least = lambda a: min((r[0] for r, b in zip(rows, sets) if near(a, b) and r[0] is not None), default=None)
    want = [(r[0], len(a), least(a) if a else r[0]) for r, a in zip(rows, sets)]
    assert sorted(map(tuple, op6_jaccard_join.linked(docs).collect()), key=str) == sorted(want, key=str)

    import corpus_pipeline

    kept = [tuple(r) for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()]
    ids = {0: [3], 1: [None], 2: [20], 3: [19], 4: [20], 5: [None]}
    assert {k: [i for i, t in kept if t.startswith(f"v{k}x")] for k in ids} == ids and (None, "") in kept and len(kept) == 7


def test_tile_bitmaps():
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64)) for n in rng.integers(1, 400, 60)]
    tile = op6_jaccard_join._Tile([(k, k, len(x), op6_jaccard_join.bitmap(x)) for k, x in enumerate(sets)])
    for i in range(len(sets)):
        found = tile.differing(i, 3, 57).tolist()
        assert found == [op6_jaccard_join.differing_bits(op6_jaccard_join.bitmap(sets[tile.node[i]]), op6_jaccard_join.bitmap(sets[k])) for k in tile.node[3:57]]


def test_sharding(spark, docs):
    for shards in (1, 3, 24):
        rows = op7_sharding.shard_rows(docs, shards).collect()
        assert len(rows) == docs.count()
        size = Counter()
        for r in rows:
            size[r["shard"]] += r["size"]
        groups = {}
        for r in docs.collect():
            key = ("null", r["doc_id"]) if r["text"] is None else r["text"]
            first, total = groups.get(key, (r["doc_id"], 0))
            groups[key] = (min(first, r["doc_id"]), total + len((r["text"] or "").encode()) + 8)
        sizes = [t for _, t in sorted(groups.values())]

        def fits(c):
            n, at = 1, 0
            for s in sizes:
                if s > c:
                    return False
                n, at = (n, at + s) if at + s <= c else (n + 1, s)
            return n <= shards

        assert max(size.values()) == next(c for c in range(max(sizes), sum(sizes) + 1) if fits(c))
        for s in size:
            assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sum(r["shard"] == s for r in rows)))
    assert op7_sharding.shard_rows(empty(spark)).count() == 0


def test_html():
    page = "<html><head><title>t</title><script>var a='</p>'</script></head><body><nav><a>menu</a></nav><div class=\"ad\">buy</div><article><h1>Head &amp; line</h1><p>a<b>b</b>  c<br>d<p>e&nbsp;f<aside>side</aside><div id='comments'>said</div><p>last</article><footer>foot</footer></body></html>"
    assert op8_html.extract(page, {}) == "Head & line\nab c d\ne f\nlast"
    assert op8_html.extract("", {}) == ""


def test_html_template(spark):
    rows = [(k, f"http://h/{k}", f"<hr><div><p>Site notice</p></div><div><p>story {k}</p></div>") for k in range(4)] + [(9, None, None)]
    got = {r["page_id"]: r["text"] for r in op8_html.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {k: f"story {k}" for k in range(4)} | {9: ""}


def test_packing(spark, docs):
    lengths, counts = np.array([1, 2, 5, 9, 10]), np.array([4, 1, 3, 2, 5])
    pad = lambda cuts: sum(n * (min(c for c in cuts if c >= x) - x) for x, n in zip(lengths, counts))
    for k in (1, 2, 3):
        best = min(pad({*c, 10}) for c in combinations(lengths.tolist(), k - 1)) if k > 1 else pad({10})
        assert pad(set(op9_packing.best_boundaries(lengths, counts, lengths * counts, k))) == best
    rows = [(k, 1 + k % 50) for k in range(500)]
    packed = op9_packing.pack(spark.createDataFrame(rows, "doc_id long, n_tokens long"), buckets=4, budget=128).collect()
    filled = Counter((r["bucket"], r["batch"]) for r in packed)
    assert len(packed) == 500 and all(r["n_tokens"] <= r["padded_length"] and filled[r["bucket"], r["batch"]] * r["padded_length"] <= max(128, r["padded_length"]) for r in packed)
    assert op9_packing.pack(spark.createDataFrame([], "doc_id long, n_tokens long")).count() == 0


def test_packing_is_the_least_padding(spark):
    for _ in range(40):
        lengths = np.unique(R.integers(1, 300, R.integers(1, 60)))
        counts, k = R.integers(1, 50, len(lengths)), int(R.integers(1, 7))
        least = np.r_[0.0, np.full(len(lengths), np.inf)]
        cost = lambda i, j: int(((lengths[j - 1] - lengths[i:j]) * counts[i:j]).sum())
        for _ in range(k):
            least = np.array([0.0] + [min(least[i] + cost(i, j) for i in range(j)) for j in range(1, len(lengths) + 1)])
        bounds = op9_packing.best_boundaries(lengths, counts, lengths * counts, k)
        assert len(bounds) <= k and sum(int(c) * (min(b for b in bounds if b >= x) - int(x)) for x, c in zip(lengths, counts)) == least[-1]
    # One long document leaves the others' boundaries where they are.
    rows = [(k, 1 + k % 3) for k in range(300)] + [(999, 1_000_000)]
    packed = op9_packing.pack(spark.createDataFrame(rows, "doc_id long, n_tokens long"), buckets=4).collect()
    assert sorted({r["padded_length"] for r in packed}) == [1, 2, 3, 1_000_000] and all(r["padded_length"] == r["n_tokens"] for r in packed)


def test_decontamination(spark, docs):
    bench = spark.createDataFrame([(1, PASSAGE), (2, "theta one"), (3, ""), (None, "one"), (10, "one"), (4, None), (1, PASSAGE)], "item_id long, text string")
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    want = []
    for r in docs.collect():
        w, hit, items = split(r["text"]), set(), set()
        for item, text in {(b["item_id"], b["text"]) for b in bench.collect() if b["item_id"] is not None}:
            own = split(text)
            n = min(10, len(own))
            grams = {tuple(own[k : k + n]) for k in range(len(own) - n + 1)} if n else set()
            for k in range(len(w) - n + 1):
                if tuple(w[k : k + n]) in grams:
                    hit |= set(range(k, k + n))
                    items.add(str(item))
        want.append((r["doc_id"], len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), bool(hit)))
    for block in (1 << 20, 1):
        assert sorted(tuple(r) for r in op10_decontaminate.decontaminate(docs, bench, block_words=block).collect()) == sorted(want)
    near = op10_decontaminate.decontaminate(spark.createDataFrame([(1, "a x b c")], "doc_id long, text string"), spark.createDataFrame([(1, "a b c")], "item_id long, text string"), slop=1)
    assert near.first()["contaminated"]
    assert op10_decontaminate.clean(docs, bench).columns == docs.columns
