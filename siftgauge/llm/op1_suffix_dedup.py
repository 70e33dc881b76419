"""Exact substring deduplication with per-shard suffix arrays.

A byte goes if a string of `width` bytes that covers it also starts anywhere else.

1. Every window of `width` bytes has an anchor: of its GRAM-byte strings the one with the least hash, the leftmost of
   equals.  Equal windows have equal anchors at equal places.  Runs of windows with one anchor are a context.
2. Only contexts whose anchor occurs twice can hold a repeated window; the others are dropped before any text moves.
   Equal contexts are aggregated first: one stands for all and carries their count.
3. Contexts go to shards by anchor.  A shard builds its suffix array by Larsson-Sadakane refinement, then Kasai's
   common prefixes: a window is repeated if it shares `width` bytes with a neighbour, or its context stands for several.
4. Contexts of one anchor beyond SHARD_BYTES are split over shards.  Across shards they are
   not merged by binary search in sorted lists: 64-bit prints of all their windows are counted by a hash aggregation,
   whose partial sums keep a window that many contexts share out of one task.  Results are the same up to collisions.
5. Repeated runs return to the documents, where their union is cut out.

Rows are known by a hash of id and text, so repeated rows are found in each other.  Strings are judged on the input.
Defined results: null texts are empty; texts under `width` bytes stay whole; an empty table gives an empty result;
further columns do not matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from . import suffixes
from . import text as tx
from .store import Tables

WIDTH, GRAM = 200, 32
#: Bytes of contexts in one suffix array, and of one anchor in one shard.
SHARD_BYTES = 1 << 20
_RUN = np.dtype([("a", "<i4"), ("b", "<i4")])
_MEASURES = [StructField(c, LongType()) for c in ("n_bytes", "n_removed", "n_spans")] + [StructField("kept_sha256", StringType()), StructField("kept", StringType())]


def anchors(data: np.ndarray, offsets: np.ndarray, width: int, gram: int) -> tuple[np.ndarray, ...]:
    """(document, anchor hash, context hash, first window, windows) of each context; windows count in their document.

    `offsets` bound the documents, each with one byte after it.
    """
    n, span = len(data), width - gram + 1
    none = tuple(np.zeros(0, np.int64) for _ in range(5))
    if n < width:
        return none
    up, down = tx._POWERS.to(n + 1)
    sums = np.empty(n + 1, np.uint64)
    sums[0] = 0
    np.cumsum(tx._BYTE_CODES[data] * up[:n], out=sums[1:])
    hashes = tx.mix((sums[gram:] - sums[:-gram]) * down[: n - gram + 1])
    least = (hashes & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(hashes), dtype=np.uint64)
    reach = 1
    while reach * 2 <= span:
        least = np.minimum(least[:-reach], least[reach:])
        reach *= 2
    if span > reach:
        least = np.minimum(least[: len(least) - (span - reach)], least[span - reach :])
    windows = np.maximum(np.diff(offsets) - 1 - width + 1, 0)
    doc, k = tx.expand(windows)
    if not len(doc):
        return none
    start = offsets[doc] + k
    anchor = (least[start] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    edge = np.flatnonzero(np.r_[True, (anchor[1:] != anchor[:-1]) | (doc[1:] != doc[:-1])])
    count = np.diff(np.r_[edge, len(doc)])
    a, z = start[edge], start[edge] + count + width - 1
    content = tx.mix((sums[z] - sums[a]) * down[a] + count.astype(np.uint64))
    return doc[edge], hashes[anchor[edge]].view(np.int64), content.view(np.int64), k[edge], count


def runs_of(flags: np.ndarray) -> np.ndarray:
    """Maximal runs [a, b) of set flags."""
    edges = np.flatnonzero(np.diff(np.r_[False, flags, False].astype(np.int8)))
    out = np.zeros(len(edges) // 2, _RUN)
    out["a"], out["b"] = edges[::2], edges[1::2]
    return out


def _contexts(rows: DataFrame, width: int, gram: int) -> DataFrame:
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in tx.row_chunks(whole, "t", tx.PASS_BYTES):
                data, offsets = tx.joined(batch.column("t"))
                doc, h, c, first, count = anchors(data, offsets, width, gram)
                at = (first << 16) | count
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(c), batch.column("r").take(pa.array(doc)), pa.array(at)], ["h", "c", "r", "at"])

    return rows.mapInArrow(find, "h long, c long, r long, at long")


def repeated_runs(rows: DataFrame, width: int = WIDTH, gram: int = GRAM, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(r, first, runs): for rows (r, t) the runs of bytes to remove, as pairs of 32-bit integers; a row may have several."""
    tables = Tables(rows.sparkSession, "suffixes")
    every = tables.write(_contexts(rows, width, gram))
    twice = tables.write(every.groupBy("h").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("h"))
    all_found = tables.write(every.join(twice, "h"))
    tables.drop(every, twice)
    # A row that stands several times counts so often, but its contexts are found once.
    found = tables.write(all_found.groupBy("h", "c", "r", "at").agg(F.count(F.lit(1)).alias("n")))
    tables.drop(all_found)
    kinds = tables.write(found.groupBy("h", "c").agg(F.sum("n").alias("k"), F.min(F.struct("r", "at")).alias("x")).select("h", "c", "k", F.col("x.r").alias("r"), F.col("x.at").alias("at")))

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for text, places in zip(batch.column("t"), batch.column("of").to_pylist(), strict=True):
                raw = text.as_py() or b""
                out = [[], [], [], []]
                for p in places:
                    first, count = p["at"] >> 16, p["at"] & 0xFFFF
                    for column, value in zip(out, (p["h"], p["c"], p["k"], raw[first : first + count + width - 1]), strict=True):
                        column.append(value)
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], ["h", "c", "k", "s"])

    wanted = kinds.groupBy("r").agg(F.collect_list(F.struct("h", "c", "k", "at")).alias("of"))
    texts = rows.join(wanted, "r")
    shares = kinds.groupBy("h").agg(F.sum(F.col("at").bitwiseAND(0xFFFF) + width).alias("b"))
    hot = shares.where(F.col("b") > shard_bytes).select("h", F.ceil(F.col("b") / shard_bytes).alias("parts"))
    pieces = texts.select(F.col("t").cast("binary").alias("t"), "of").mapInArrow(take, "h long, c long, k long, s binary")
    dealt = pieces.join(hot, "h", "left").withColumn("part", F.when(F.col("parts").isNull(), 0).otherwise(F.pmod("c", "parts"))).withColumn("hot", F.col("parts").isNotNull()).drop("parts")
    dealt = dealt.repartition("h", "part").sortWithinPartitions("h", "part", "c")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Shards of whole (h, part) groups; of hot anchors also a row for each window to merge."""
        held: list[tuple] = []
        size = 0

        def shard() -> pa.RecordBatch:
            flags, begins, _ = suffixes.repeated([x[5] for x in held], width)
            out: list[list] = [[], [], [], []]
            for (h, _, c, k, is_hot, s), begin in zip(held, begins.tolist(), strict=True):
                own = flags[begin : begin + len(s) - width + 1] if k == 1 else np.ones(len(s) - width + 1, bool)
                runs = runs_of(own)
                windows = b""
                if is_hot:
                    raw = np.frombuffer(s, np.uint8)
                    up, down = tx._POWERS.to(len(raw) + 1)
                    sums = np.r_[np.uint64(0), np.cumsum(tx._BYTE_CODES[raw] * up[: len(raw)])]
                    windows = tx.mix((sums[width:] - sums[:-width]) * down[: len(raw) - width + 1]).tobytes()
                for column, value in zip(out, (h, c, runs.tobytes(), windows), strict=True):
                    column.append(value)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, (pa.int64(), pa.int64(), pa.binary(), pa.binary()), strict=True)], ["h", "c", "runs", "windows"])

        last = piece = None
        for batch in batches:
            for row in zip(*(batch.column(x).to_pylist() for x in ("h", "part", "c", "k", "hot", "s")), strict=True):
                if row[:3] == piece:  # a repeated row gives its pieces as often as it stands
                    continue
                piece = row[:3]
                if size > shard_bytes and (row[0], row[1]) != last:
                    yield shard()
                    size = 0
                held.append(row)
                size += len(row[5])
                last = (row[0], row[1])
        if held:
            yield shard()

    judged = tables.write(dealt.mapInArrow(judge, "h long, c long, runs binary, windows binary"))
    tables.drop(kinds)
    merged = _merge(judged.where(F.octet_length("windows") > 0).select("h", "c", "windows"))
    verdicts = judged.select("h", "c", "runs").unionByName(merged).where(F.octet_length("runs") > 0)
    runs = tables.write(found.join(verdicts, ["h", "c"]).select("r", F.shiftright("at", 16).alias("first"), "runs"))
    tables.drop(found, judged)
    return runs


def _merge(hot: DataFrame) -> DataFrame:
    """(h, c, runs) of windows of split anchors that stand in several contexts, found by counting their prints."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for h, c, w in zip(batch.column("h").to_pylist(), batch.column("c").to_pylist(), batch.column("windows"), strict=True):
                prints = np.frombuffer(w.as_buffer(), np.int64)
                n = len(prints)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, h)), pa.array(np.full(n, c)), pa.array(prints), pa.array(np.arange(n, dtype=np.int32))], ["h", "c", "w", "k"])

    prints = hot.mapInArrow(spread, "h long, c long, w long, k int")
    # Windows shared by many contexts are counted with partial sums; only their prints meet.
    shared = prints.groupBy("h", "w").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h", "w")

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [[], [], []]
            for h, c, own, known in zip(*(batch.column(x).to_pylist() for x in ("h", "c", "own", "known")), strict=True):
                own = np.array([x["w"] for x in sorted(own, key=lambda x: x["k"])], np.int64)
                known = np.sort(np.array(known, np.int64))
                at = np.minimum(np.searchsorted(known, own), len(known) - 1)
                for column, value in zip(out, (h, c, runs_of(known[at] == own).tobytes()), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, (pa.int64(), pa.int64(), pa.binary()), strict=True)], ["h", "c", "runs"])

    hits = prints.join(shared, ["h", "w"]).groupBy("h", "c").agg(F.collect_list("w").alias("known"))
    every = prints.groupBy("h", "c").agg(F.collect_list(F.struct("k", "w")).alias("own"))
    return every.join(hits, ["h", "c"]).mapInArrow(look, "h long, c long, runs binary")


def _removed(rows: DataFrame, runs: DataFrame, width: int, with_text: bool) -> DataFrame:
    """The columns k0, k1, ... of rows (k0, ..., r, t), then n_bytes, n_removed, n_spans, kept_sha256 (and kept)."""
    names = [c for c in rows.columns if c not in ("r", "t")]
    by_row = runs.groupBy("r").agg(F.collect_list(F.struct("first", "runs")).alias("of"))
    joined = rows.join(by_row, "r", "left").withColumn("t", F.coalesce(F.col("t"), F.lit("")).cast("binary")).select(*names, "t", "of")
    schema = StructType([*joined.select(*names).schema.fields, *_MEASURES[: 5 if with_text else 4]])

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in tx.row_chunks(whole, "t")):
            out: list[list] = [[] for _ in range(5 if with_text else 4)]
            for text, of in zip(batch.column("t"), batch.column("of"), strict=True):
                raw = text.as_py()
                values = (len(raw), 0, 0, hashlib.sha256(raw).hexdigest(), raw)
                if of.is_valid:
                    pairs = [np.frombuffer(x["runs"].as_buffer(), _RUN).astype([("a", "i8"), ("b", "i8")]) for x in of]
                    at = np.repeat([x["first"].as_py() for x in of], [len(p) for p in pairs])
                    both = np.concatenate(pairs)
                    edges = np.zeros(len(raw) + 1, np.int64)
                    np.add.at(edges, both["a"] + at, 1)
                    np.add.at(edges, both["b"] + at + width - 1, -1)
                    gone = np.cumsum(edges[:-1]) > 0
                    kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
                    values = (len(raw), int(gone.sum()), len(runs_of(gone)), hashlib.sha256(kept).hexdigest(), kept)
                for column, value in zip(out, values, strict=False):
                    column.append(value)
            arrays = [pa.array(v, t) for v, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=False)]
            if with_text:
                arrays.append(pa.array([x.decode("utf-8", "ignore") for x in out[4]], pa.string()))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], *arrays], schema.names)

    return joined.mapInArrow(remove, schema)


def _rows(docs: DataFrame, columns: list[str], id_col: str, text_col: str) -> DataFrame:
    """`columns` as k0, k1, ..., the text t, and r, by which rows are known."""
    text = F.col(f"`{text_col}`").cast("string")
    return docs.select(*(F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(columns)), text.alias("t"), F.xxhash64(F.col(f"`{id_col}`"), text).alias("r"))


def deduplicate(docs: DataFrame, *, width: int = WIDTH, gram: int = GRAM, shard_bytes: int = SHARD_BYTES, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and the kept text) of every row."""
    rows = _rows(docs, [id_col], id_col, text_col)
    runs = repeated_runs(rows.select("r", "t"), width, gram, shard_bytes)
    return _removed(rows, runs, width, with_text).withColumnRenamed("k0", "doc_id")


def without_repeats(docs: DataFrame, *, width: int = WIDTH, gram: int = GRAM, shard_bytes: int = SHARD_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """`docs` with their own columns; the text is what stays.  A null text stays null; of a character cut apart no byte stays."""
    others = [c for c in docs.columns if c != text_col]
    rows = _rows(docs, others, id_col, text_col).withColumn("some", F.col("t").isNotNull())
    out = _removed(rows, repeated_runs(rows.select("r", "t"), width, gram, shard_bytes), width, True)
    return out.select(*(F.when(F.col("some"), F.col("kept")).alias(c) if c == text_col else F.col(f"k{others.index(c)}").alias(c) for c in docs.columns))


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicate(spark.read.parquet(f"{sf_dir}/documents.parquet"))
