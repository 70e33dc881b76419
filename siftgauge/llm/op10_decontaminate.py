"""Benchmark decontamination with a distributed positional inverted index.

`write_index` stores the postings of every training token once: a row for each shard of documents with its sorted terms,
the number of postings of each, and their positions in the order of terms; the shards are spread over the cluster.
A test phrase is looked up in each shard by taking the postings of its rarest term there, moving them by the term's
offset to starts of the phrase, and intersecting them with the equally moved postings of the other terms, next rarest
first.  `slop` = 0 gives exact phrases.  `slop` > 0 gives proximity matches: a match begins at the phrase's first word, and
each other term stands up to `slop` words from its place after it.

The test phrases come in blocks of about `block_words` words.  The driver holds and broadcasts one block at a time and
searches the stored index with it, so neither texts nor postings are made or moved again.  Terms are compared by 64-bit
hashes; rows meet their verdicts by a 64-bit hash of id and text.

Defined results: null or wordless documents have no hits; items without words match nothing; rows with a null
item_id are ignored; repeated item_ids count once per document; repeated documents each get their row; without
documents the result is empty; other columns of either table are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import text as tx
from .store import Tables

#: Bytes of text in a shard of the index (or one document).
SHARD_BYTES = 256 << 10
#: Shards that a task holds at once.
SHARDS_HELD = 16
INDEX = "shard long, ids array<bigint>, keys array<bigint>, offsets binary, terms binary, counts binary, positions binary"


@dataclass
class Phrases:
    """One block of test phrases: per window length, term numbers (windows x length) and item ordinals."""

    vocab: np.ndarray
    items: list
    groups: dict[int, tuple[np.ndarray, np.ndarray]]


def phrases_of(rows: list[tuple], width: int) -> Phrases:
    """Windows of `width` words of each (item_id, text), or the whole item where it is shorter."""
    hashes, offsets = tx.words_of(pa.array([t for _, t in rows], pa.string()), tx.ALNUM, True)
    vocab, terms = np.unique(hashes, return_inverse=True)
    found: dict[int, tuple[list, list]] = {}
    for k in range(len(rows)):
        own = terms[offsets[k] : offsets[k + 1]]
        if len(own):
            windows = np.lib.stride_tricks.sliding_window_view(own, min(width, len(own)))
            seen = found.setdefault(windows.shape[1], ([], []))
            seen[0].append(windows)
            seen[1].append(np.full(len(windows), k))
    groups = {n: (np.concatenate(a), np.concatenate(b)) for n, (a, b) in found.items()}
    return Phrases(vocab, [i for i, _ in rows], groups)


def write_index(rows: DataFrame, tables: Tables) -> DataFrame:
    """The stored index of rows (i, key, t), a row for each shard."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId() << 32
        for whole in batches:
            for batch in tx.row_chunks(whole, "t", SHARD_BYTES):
                words, offsets = tx.words_of(batch.column("t"), tx.ALNUM, True)
                order = np.argsort(words, kind="stable")
                ordered = words[order]
                first = np.flatnonzero(np.r_[True, ordered[1:] != ordered[:-1]]) if len(words) else np.zeros(0, np.int64)
                parts = (offsets.astype("<i8"), ordered[first], np.diff(np.r_[first, len(words)]).astype("<u4"), order.astype("<u4"))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([shard], pa.int64()), *(pa.array([batch.column(c).to_pylist()], pa.list_(pa.int64())) for c in ("i", "key")), *(pa.array([x.tobytes()], pa.binary()) for x in parts)],
                    ["shard", "ids", "keys", "offsets", "terms", "counts", "positions"],
                )
                shard += 1

    return tables.write(rows.select("i", "key", "t").mapInArrow(build, INDEX))


class Shard:
    """Postings of the terms of one block of phrases in one shard of the index."""

    def __init__(self, offsets: np.ndarray, terms: np.ndarray, counts: np.ndarray, positions: np.ndarray, vocab: np.ndarray) -> None:
        self.offsets, self.n = offsets, len(positions)
        at = np.minimum(np.searchsorted(terms, vocab), max(len(terms) - 1, 0))
        known = terms[at] == vocab if len(terms) else np.zeros(len(vocab), bool)
        begins = np.cumsum(counts, dtype=np.int64) - counts
        self.df = np.where(known, counts[at].astype(np.int64), 0) if len(terms) else np.zeros(len(vocab), np.int64)
        self.first = np.cumsum(self.df) - self.df
        term, k = tx.expand(self.df)
        self.positions = positions[begins[at[term]] + k].astype(np.int64) if len(term) else np.zeros(0, np.int64)
        self.keys = term * np.int64(self.n) + self.positions

    def document(self, position: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.offsets, position, "right") - 1

    def matches(self, windows: np.ndarray, slop: int = 0, at_once: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(window, start) of all matches."""
        df = self.df[windows]
        alive = np.flatnonzero(df.min(axis=1) > 0)
        if not len(alive):
            return
        width = windows.shape[1]
        ranks = np.argsort(df[alive], axis=1, kind="stable")
        rare = windows[alive, ranks[:, 0]]
        total, lo = np.cumsum(self.df[rare]), 0
        moves = np.arange(-slop, slop + 1)
        while lo < len(alive):
            base = total[lo - 1] if lo else 0
            hi = max(lo + 1, int(np.searchsorted(total, base + at_once // len(moves), "right")))
            row, k = tx.expand(self.df[rare[lo:hi]])
            row += lo
            start = self.positions[self.first[rare[row]] + k] - ranks[row, 0]
            if slop:
                row, start = np.repeat(row, len(moves)), (start[:, None] + moves).ravel()
            ok = (start >= 0) & (start + width <= self.n)
            row, start = row[ok], start[ok]
            doc = self.document(start)
            ok = start + width <= self.offsets[doc + 1]
            row, start, doc = row[ok], start[ok], doc[ok]
            for j in range(0 if slop else 1, width):
                if not len(row):
                    break
                offset = ranks[row, j]
                term = windows[alive[row], offset]
                far = np.where(offset > 0, slop, 0)
                key = term * np.int64(self.n)
                found = np.searchsorted(self.keys, key + np.maximum(start + offset - far, self.offsets[doc]))
                hit = found < len(self.keys)
                hit &= self.keys[np.minimum(found, len(self.keys) - 1)] <= key + np.minimum(start + offset + far, self.offsets[doc + 1] - 1)
                row, start, doc = row[hit], start[hit], doc[hit]
            if len(row):
                yield alive[row], start
            lo = hi


def _blocks(benchmark: DataFrame, block_words: int, id_col: str, text_col: str) -> Iterator[list[tuple]]:
    rows, size = [], 0
    items = benchmark.select(F.col(f"`{id_col}`").cast("string").alias("i"), F.col(f"`{text_col}`").cast("string").alias("t")).where("i IS NOT NULL AND t IS NOT NULL")
    for item, text in items.toLocalIterator():
        rows.append((item, text))
        size += len(text) // 2 + 1
        if size >= block_words:
            yield rows
            rows, size = [], 0
    if rows:
        yield rows


def search(index: DataFrame, phrases: Phrases, slop: int = 0) -> DataFrame:
    """(shard, place, items, runs) of each document with matches; runs: first and last + 1 of its matched words, in pairs."""
    block = index.sparkSession.sparkContext.broadcast(phrases)

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        phrases = block.value
        for batch in batches:
            for k in range(batch.num_rows):
                offsets, terms, counts, positions = (np.frombuffer(batch.column(c)[k].as_buffer(), kind) for c, kind in (("offsets", "<i8"), ("terms", "<u8"), ("counts", "<u4"), ("positions", "<u4")))
                shard = Shard(offsets, terms, counts, positions, phrases.vocab)
                spans: dict[int, list] = {}
                items: dict[int, set] = {}
                for length, (windows, item_of) in phrases.groups.items():
                    for row, start in shard.matches(windows, slop):
                        doc = shard.document(start)
                        pairs = np.unique(doc * np.int64(len(phrases.items)) + item_of[row])
                        for d, item in zip(*(x.tolist() for x in np.divmod(pairs, len(phrases.items))), strict=True):
                            items.setdefault(d, set()).add(phrases.items[item])
                        places = np.unique(np.stack([doc, start - offsets[doc]]), axis=1)
                        for d, at in zip(*(x.tolist() for x in places), strict=True):
                            spans.setdefault(d, []).append((at, at + length))
                shards = pa.array([batch.column("shard")[k].as_py()] * len(items), pa.int64())
                found = sorted(items)
                yield pa.RecordBatch.from_arrays([shards, pa.array(found, pa.int32()), pa.array([sorted(items[d]) for d in found], pa.list_(pa.string())), pa.array([np.array(spans[d], "<i8").tobytes() for d in found], pa.binary())], ["shard", "place", "items", "runs"])

    return index.select("shard", "offsets", "terms", "counts", "positions").mapInArrow(look, "shard long, place int, items array<string>, runs binary")


def covered(runs: list[bytes]) -> int:
    """Words inside any of the runs."""
    spans = np.concatenate([np.frombuffer(r, "<i8").reshape(-1, 2) for r in runs])
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    ends = np.maximum.accumulate(spans[:, 1])
    return int(np.maximum(ends - np.maximum(spans[:, 0], np.r_[0, ends[:-1]]), 0).sum())


def _found(docs: DataFrame, benchmark: DataFrame, width: int, slop: int, block_words: int, id_col: str, text_col: str, item_col: str, item_text_col: str) -> tuple[DataFrame, DataFrame]:
    """(index, matches of all blocks)."""
    tables = Tables(docs.sparkSession, "postings")
    text = F.col(f"`{text_col}`").cast("string")
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("i"), F.xxhash64(F.col(f"`{id_col}`").cast("long"), text).alias("key"), text.alias("t"))
    index = write_index(rows, tables)
    found = None
    for items in _blocks(benchmark, block_words, item_col, item_text_col):
        part = tables.write(search(index, phrases_of(items, width), slop), SHARDS_HELD)
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = docs.sparkSession.createDataFrame([], "shard long, place int, items array<string>, runs binary")
    return index, found


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, width: int = 10, slop: int = 0, block_words: int = 1 << 20,
                  id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """For each document its words, words inside matches, matching items, and whether there are any."""
    index, found = _found(docs, benchmark, width, slop, block_words, id_col, text_col, item_col, item_text_col)

    def lengths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                n = np.diff(np.frombuffer(batch.column("offsets")[k].as_buffer(), "<i8"))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), batch.column("shard")[k].as_py())), pa.array(np.arange(len(n), dtype=np.int32)), batch.column("ids")[k].values, pa.array(n)], ["shard", "place", "doc_id", "n_words"])

    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            items = [sorted({x for part in parts for x in part}) for parts in (p or [] for p in batch.column("items").to_pylist())]
            n_hit = [covered(r) if r else 0 for r in batch.column("runs").to_pylist()]
            digests = [hashlib.sha256(",".join(x).encode()).hexdigest() for x in items]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_words"), pa.array(n_hit, pa.int64()), pa.array([len(x) for x in items], pa.int64()), pa.array(digests, pa.string()), pa.array([n > 0 for n in n_hit], pa.bool_())], ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])

    every = index.select("shard", "ids", "offsets").mapInArrow(lengths, "shard long, place int, doc_id long, n_words long")
    merged = found.groupBy("shard", "place").agg(F.collect_list("items").alias("items"), F.collect_list("runs").alias("runs"))  # a row a block
    joined = every.join(merged, ["shard", "place"], "left").select("doc_id", "n_words", "items", "runs")
    return joined.mapInArrow(report, "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean")


def clean(docs: DataFrame, benchmark: DataFrame, *, width: int = 10, slop: int = 0, block_words: int = 1 << 20,
          id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of `docs` without matches, with their own columns."""
    index, found = _found(docs, benchmark, width, slop, block_words, id_col, text_col, item_col, item_text_col)
    keys = index.select("shard", F.posexplode("keys").alias("place", "key"))
    names = docs.columns
    hit = keys.join(found.select("shard", "place").distinct(), ["shard", "place"]).select("key").distinct()
    hit = Tables(docs.sparkSession, "contaminated").write(hit)
    key = F.xxhash64(F.col(f"c{names.index(id_col)}").cast("long"), F.col(f"c{names.index(text_col)}").cast("string"))
    rows = docs.select(*(F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(names)))
    return rows.join(hit, key == hit["key"], "left_anti").select(*(F.col(f"c{k}").alias(c) for k, c in enumerate(names)))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
