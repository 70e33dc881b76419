"""Token-ID shards with a minimal perfect hash index for keyed access.

`write_store` deals documents by ascending key to shards, encodes them, and writes per shard one folder:
`ids.bin`, the raw ids in little-endian order (16 bits where the vocabulary allows it, else 32), document after
document; `index.bin`, a perfect hash of the shard's keys with, at a key's slot, its fingerprint, first id, number of
ids and number of rows; `keys.bin`, the keys in file order.  A lookup reads one slot and one range of ids.  The list
of shards (one row each) names the key range and the ids before each shard.

Encoding splits a text at ASCII white space, which the word-level tokenizer drops anyway, and keeps the ids of words
already seen (known by a 64-bit hash); unseen words go to the tokenizers library.  A word's ids do not depend on its neighbours, so the ids are
those of the whole text.  Files are written under a name of the attempt and renamed, so a repeated task is harmless.

Defined results: null and empty texts have the end id only; rows with equal keys stand together, in order of their
text, and share one index entry; a null key is filed first, outside the index; an empty table has no shards and no
rows; further columns do not matter.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import text as tx
from .mph import PerfectHash, fingerprints
from .store import Tables, new_folder

#: Words whose ids a worker keeps; beyond it starts anew.
CACHE_WORDS = 1_500_000
#: Bytes of text for one shard.
SHARD_BYTES = 16 << 20
_HEAD = "<4sHHQQ"
_HEAD_BYTES = struct.calcsize(_HEAD)
MANIFEST = "shard int, path string, dtype string, first_key long, last_key long, n_docs long, n_ids long"
ENTRY = np.dtype([("print", "<u4"), ("rows", "<u4"), ("first", "<u8"), ("count", "<u8")])


class WordEncoder:
    """Ids of whole texts, in batches."""

    def __init__(self, path: str) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.wide = self.tokenizer.get_vocab_size() > 65536
        self.clear()

    def clear(self) -> None:
        self.hash = np.zeros(0, np.uint64)
        self.first, self.count, self.ids, self.used = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(1 << 20, np.uint16), 0

    def _learn(self, hashes: np.ndarray, words: list[str]) -> None:
        encoded = self.tokenizer.encode_batch_fast(words, add_special_tokens=False)
        each = [e.ids for e in encoded]
        count = np.fromiter(map(len, each), np.int64, len(each))
        new = np.fromiter((i for ids in each for i in ids), np.uint32 if self.wide else np.uint16, int(count.sum()))
        if self.used + len(new) > len(self.ids):
            self.ids = np.r_[self.ids[: self.used], np.zeros(self.used + 2 * len(new), new.dtype)]
        self.ids[self.used : self.used + len(new)] = new
        at = np.searchsorted(self.hash, hashes)
        self.first, self.count = np.insert(self.first, at, self.used + np.cumsum(count) - count), np.insert(self.count, at, count)
        self.hash, self.used = np.insert(self.hash, at, hashes), self.used + len(new)

    def _rows(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(row of every word in the table, offsets of the texts in the words)."""
        data, offsets = tx.joined(texts)
        starts, ends = tx.word_spans(data, tx.NON_SPACE)
        hashes, at, kind = np.unique(tx.word_hashes(data, starts, ends), return_index=True, return_inverse=True)
        if len(self.hash) + len(hashes) > CACHE_WORDS:
            self.clear()
        new = np.flatnonzero(np.isin(hashes, self.hash, assume_unique=True, invert=True))
        if len(new):
            raw = data.tobytes()
            self._learn(hashes[new], [raw[a:b].decode() for a, b in zip(starts[at[new]].tolist(), ends[at[new]].tolist(), strict=True)])
        return np.searchsorted(self.hash, hashes)[kind], np.searchsorted(starts, offsets)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(all ids, offsets of the texts in them)."""
        row, words = self._rows(texts)
        count = self.count[row]
        which, k = tx.expand(count)
        return self.ids[self.first[row][which] + k].astype(np.uint32), np.r_[0, np.cumsum(count)][words]

    def lengths(self, texts: pa.Array) -> np.ndarray:
        """Number of ids of every text."""
        row, words = self._rows(texts)
        return np.diff(np.r_[0, np.cumsum(self.count[row])][words])


_ENCODERS: dict[str, WordEncoder] = {}


def encoder_of(path: str) -> WordEncoder:
    """The worker's encoder, which keeps the words of earlier tasks."""
    if path not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def filesystem(uri: str):
    """(file system, path) of a URI, for any store pyarrow knows."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def put_folder(uri: str, files: dict[str, list]) -> None:
    """Writes files into the folder `uri`, under another name first; an existing folder stays."""
    from pyarrow import fs

    store, path = filesystem(uri)
    attempt = f"{path}.{uuid.uuid4().hex}"
    store.create_dir(attempt, recursive=True)
    for name, parts in files.items():
        with store.open_output_stream(f"{attempt}/{name}") as out:
            for part in parts:
                out.write(part)
    if store.get_file_info(path).type != fs.FileType.NotFound:
        store.delete_dir(attempt)
        return
    try:
        store.move(attempt, path)
    except OSError:
        if store.get_file_info(path).type == fs.FileType.NotFound:
            raise
        store.delete_dir(attempt)


def write_store(docs: DataFrame, folder: str, tokenizer_path: str, end_id: int | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes the store; returns the manifest, a row for each shard."""
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("i"), F.col(f"`{text_col}`").cast("string").alias("t"))
    total = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    shards = max(1, -(-total // SHARD_BYTES))
    dealt = rows.repartitionByRange(int(shards), F.col("i").asc_nulls_first(), F.xxhash64("t")).sortWithinPartitions(F.col("i").asc_nulls_first(), F.col("t").asc_nulls_first())

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId()
        encoder = encoder_of(tokenizer_path)
        dtype = np.dtype("<u4" if encoder.wide else "<u2")
        payload, keys, nulls, counts = [], [], [], []
        for whole in batches:
            for batch in tx.row_chunks(whole, "t", 4 << 20):
                ids, offsets = encoder.encode(batch.column("t"))
                if end_id is not None:
                    ids = np.insert(ids, offsets[1:], end_id)
                    offsets = offsets + np.arange(len(offsets))
                payload.append(ids.astype(dtype).tobytes())
                counts.append(np.diff(offsets))
                keys.append(batch.column("i").fill_null(0).to_numpy(zero_copy_only=False))
                nulls.append(batch.column("i").is_null().to_numpy(zero_copy_only=False))
        if not keys:
            return
        key, null, count = np.concatenate(keys), np.concatenate(nulls), np.concatenate(counts)
        first = np.cumsum(count) - count
        known = np.flatnonzero(~null)
        distinct, at, rows_ = np.unique(key[known], return_index=True, return_counts=True)
        index = PerfectHash.build(distinct.view(np.uint64))
        entries = np.zeros(len(distinct), ENTRY)
        slots = index.slots(distinct.view(np.uint64))
        start = known[at]
        after = np.r_[first, first[-1] + count[-1]]
        entries["print"][slots], entries["rows"][slots] = fingerprints(distinct.view(np.uint64)), rows_
        entries["first"][slots], entries["count"][slots] = first[start], after[start + rows_] - first[start]
        path = f"{folder}/shard-{shard:06d}"
        head = struct.pack(_HEAD, b"TIDS", 1, dtype.itemsize, len(key), int(count.sum()))
        hashed = index.dump()
        put_folder(path, {"ids.bin": [head, *payload], "index.bin": [struct.pack("<Q", len(hashed)), hashed, entries.tobytes()], "keys.bin": [key.astype("<i8").tobytes(), np.packbits(null).tobytes(), count.astype("<u8").tobytes()]})
        yield pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int32()), "path": [path], "dtype": [dtype.str], "first_key": pa.array([int(distinct[0]) if len(distinct) else None], pa.int64()), "last_key": pa.array([int(distinct[-1]) if len(distinct) else None], pa.int64()), "n_docs": pa.array([len(key)], pa.int64()), "n_ids": pa.array([int(count.sum())], pa.int64())})

    # Ids before each shard: summed inside blocks of shards, then over the blocks, of which there are few.
    listed = Tables(docs.sparkSession, "manifest").write(dealt.mapInArrow(write, MANIFEST)).withColumn("_block", F.col("shard").bitwiseAND(~0xFFF))
    blocks = listed.groupBy("_block").agg(F.sum("n_ids").alias("_ids"))
    before = lambda *by: Window.partitionBy(*by).rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("_block", F.coalesce(F.sum("_ids").over(before().orderBy("_block")), F.lit(0)).alias("_base"))
    inside = F.coalesce(F.sum("n_ids").over(before("_block").orderBy("shard")), F.lit(0))
    return listed.withColumn("_in", inside).join(blocks, "_block").select(*(c.split()[0] for c in MANIFEST.split(", ")), (F.col("_in") + F.col("_base")).alias("base"))


class ShardReader:
    """Keyed access to one shard."""

    def __init__(self, path: str) -> None:
        self.store, self.path = filesystem(path)
        with self.store.open_input_file(f"{self.path}/index.bin") as f:
            size = struct.unpack("<Q", f.read(8))[0]
            self.index = PerfectHash.load(f.read(size))
            self.entries = np.frombuffer(f.read(), ENTRY)
        self.file = self.store.open_input_file(f"{self.path}/ids.bin")
        magic, _, self.width, self.n_docs, self.n_ids = struct.unpack(_HEAD, self.file.read(_HEAD_BYTES))
        if magic != b"TIDS":
            raise ValueError(f"{path} has no ids")

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(known, entries): an entry for each key, of use where it is known."""
        slots = self.index.slots(keys.view(np.uint64))
        got = self.entries[np.maximum(slots, 0)] if len(self.entries) else np.zeros(len(keys), ENTRY)
        return (slots >= 0) & (got["print"] == fingerprints(keys.view(np.uint64))), got

    def ids(self, first: int, count: int) -> np.ndarray:
        data = self.file.read_at(count * self.width, _HEAD_BYTES + first * self.width)
        return np.frombuffer(data, f"<u{self.width}").astype("<u4")

    def key_order(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(keys, null, counts) of the rows in file order."""
        with self.store.open_input_file(f"{self.path}/keys.bin") as f:
            data, n = f.read(), self.n_docs
        return np.frombuffer(data, "<i8", n), np.unpackbits(np.frombuffer(data, np.uint8, (n + 7) // 8, 8 * n), count=n).astype(bool), np.frombuffer(data, "<u8", n, 8 * n + (n + 7) // 8).astype(np.int64)


def read_store(manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every row, each fetched through the index of its shard."""
    rows = manifest.select("path", "base").repartition(max(1, manifest.count()), "path")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base in zip(batch.column("path").to_pylist(), batch.column("base").to_pylist(), strict=True):
                shard = ShardReader(path)
                keys, null, counts = shard.key_order()
                firsts = np.cumsum(counts) - counts
                known, found = shard.find(keys)
                if not known[~null].all():
                    raise ValueError(f"{path}: a key is not in the index")
                new = np.r_[True, (keys[1:] != keys[:-1]) | null[:-1]] | null
                lead = np.maximum.accumulate(np.where(new, np.arange(len(keys)), 0))
                start = np.where(null, firsts, found["first"].astype(np.int64) + firsts - firsts[lead])
                crcs = np.fromiter((zlib.crc32(shard.ids(int(a), int(n)).tobytes()) for a, n in zip(start, counts, strict=True)), np.int64, len(keys))
                yield pa.RecordBatch.from_arrays([pa.array(keys, mask=null), pa.array(start + base), pa.array(counts), pa.array(crcs)], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return rows.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op4_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return read_store(write_store(docs, new_folder(spark, "tokens"), public_tokenizers.path("word_bpe_49k.json"), 2))
