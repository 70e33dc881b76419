"""Language identification: multinomial naive Bayes over hashed character n-grams.

Characters are lower-cased code points with every non-letter taken as a space; grams of 1 to 3 characters, of each text
by itself between two spaces, are hashed to BUCKETS columns.  Counts come from at most about SAMPLE_ROWS labelled rows,
picked by a hash of the id; prediction covers every row and the whole of its text.  The log-probability matrix
(BUCKETS + 1 rows, a column for each of at most MOST_LANGUAGES languages) is broadcast.  A batch becomes a sparse matrix
of counts, a row for each text, which is multiplied with one language's column after the other in numpy.

Defined results: a text that is null or has no letter is `und` with score 0; a table without labelled rows predicts
`und` for all; ties go to the language first in order; a prediction depends on nothing but the text, so repeated rows
are scored alike; null ids are learned from and not held out; an empty table gives an empty result; further columns do
not matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import text as tx

BUCKETS, SMOOTHING = 1 << 16, 0.5
#: About so many labelled rows are learned from, whatever the corpus.
SAMPLE_ROWS = 20_000
#: Beyond so many languages (65 MB of matrix) `fit` stops with an error.
MOST_LANGUAGES = 250
#: Texts in one sparse matrix: row and bucket share a 32-bit number.
_MOST_TEXTS = 1 << 16
_TASKS = 8
#: No letter of Unicode stands at or above this code point.
_CODES = 0x34000
_TABLES: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """Code point -> lower-case letter, or a space for what is no letter."""
    if not _TABLES:
        table = np.full(0x110000, 32, np.uint32)
        for c in range(_CODES):
            ch = chr(c)
            if ch.isalpha():
                low = ch.lower()
                table[c] = ord(low) if len(low) == 1 else c
        _TABLES.append(table)
    return _TABLES[0]


def grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(buckets of all grams as 3 rows, offsets of the texts, letters in each text): a gram ends at each character.

    A text ends with two separators, so that no gram holds characters of two texts.
    """
    data, offsets = tx.joined(pc.binary_join_element_wise(pc.fill_null(texts, ""), pa.scalar(""), pa.scalar("\n")))
    chars = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    at = np.r_[0, np.cumsum((data & 0xC0) != 0x80)][offsets]
    c = _letters()[np.r_[np.uint32(32), np.uint32(32), chars]]
    one = c[2:] * np.uint32(0x9E3779B1)
    two = one + c[1:-1] * np.uint32(0x85EBCA77)
    three = two + c[:-2] * np.uint32(0xC2B2AE3D)
    out = np.stack([one, two ^ np.uint32(0x5BD1E995), three ^ np.uint32(0x27D4EB2F)])
    out ^= out >> np.uint32(15)
    out *= np.uint32(0x2C1B3C6D)
    found = np.r_[0, np.cumsum(c[2:] != 32)][at]
    return (out >> np.uint32(16)).astype(np.int32), at, np.diff(found)


def sparse_counts(buckets: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, bucket, count) of each non-zero entry, in the order of text and bucket."""
    texts = np.repeat(np.arange(len(offsets) - 1, dtype=np.uint32), np.diff(offsets))
    keys = np.sort(((texts << np.uint32(16)) | buckets.astype(np.uint32)).ravel())
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    entries = keys[first]
    return (entries >> np.uint32(16)).astype(np.int64), (entries & np.uint32(0xFFFF)).astype(np.int64), np.diff(np.r_[first, len(keys)])


def fit(train: DataFrame, text_col: str = "text", lang_col: str = "lang", sample_rows: int = SAMPLE_ROWS) -> tuple[list[str], np.ndarray]:
    """(languages, log-probabilities: a row for each bucket, the priors last)."""
    known = train.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(F.col(text_col).alias("t"), F.col(lang_col).cast("string").alias("l"), F.col("_pick"))
    n = train.where(F.col(lang_col).isNotNull()).count()
    share = min(1 << 20, -(-sample_rows * (1 << 20) // max(n, 1)))
    sample = known.where(F.col("_pick") < share).drop("_pick").repartition(_TASKS)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, np.ndarray] = {}
        for whole in batches:
            for batch in tx.row_chunks(whole, "t"):
                buckets, offsets, _ = grams(batch.column("t"))
                for k, lang in enumerate(batch.column("l").to_pylist()):
                    own = found.setdefault(lang, np.zeros(BUCKETS + 1, np.int64))
                    own[:-1] += np.bincount(buckets[:, offsets[k] : offsets[k + 1]].ravel(), minlength=BUCKETS)
                    own[-1] += 1
        for lang, own in found.items():
            yield pa.RecordBatch.from_pydict({"lang": [lang], "counts": [own.tobytes()]})

    totals: dict[str, np.ndarray] = {}
    for row in sample.mapInArrow(count, "lang string, counts binary").toLocalIterator():  # _TASKS rows a language
        totals[row["lang"]] = totals.get(row["lang"], 0) + np.frombuffer(row["counts"], np.int64)
    langs = sorted(totals)
    if len(langs) > MOST_LANGUAGES:
        raise ValueError(f"{len(langs)} languages; the matrix is broadcast for {MOST_LANGUAGES} at most")
    if not langs:
        return [], np.zeros((BUCKETS + 1, 0))
    counts = np.stack([totals[x] for x in langs], axis=1).astype(np.float64)
    logs = np.log((counts[:-1] + SMOOTHING) / (counts[:-1].sum(axis=0) + SMOOTHING * BUCKETS))
    return langs, np.vstack([logs, np.log(counts[-1] / counts[-1].sum())])


def predict(docs: DataFrame, langs: list[str], logs: np.ndarray, keep: dict[str, Column], text_col: str = "text") -> DataFrame:
    """`keep` columns, lang_pred and score of every row."""
    model = docs.sparkSession.sparkContext.broadcast((langs, logs))
    rows = docs.select(*(c.alias(f"k{i}") for i, c in enumerate(keep.values())), F.col(text_col).cast("string").alias("t"))
    names = list(keep)
    schema = ", ".join(f"`{n}` {t.dataType.simpleString()}" for n, t in zip(names, rows.schema.fields, strict=False)) + ", lang_pred string, score double"

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, logs = model.value
        labels = np.array([*langs, "und"], object)
        for whole in batches:
            for chunk in tx.row_chunks(whole, "t"):
                for lo in range(0, chunk.num_rows, _MOST_TEXTS):
                    batch = chunk.slice(lo, _MOST_TEXTS)
                    buckets, offsets, letters = grams(batch.column("t"))
                    best, sure = np.full(batch.num_rows, len(langs)), np.zeros(batch.num_rows)
                    if langs:
                        text, bucket, count = sparse_counts(buckets, offsets)
                        total = np.stack([np.bincount(text, count * logs[bucket, k], batch.num_rows) + logs[-1, k] for k in range(len(langs))], axis=1)
                        odds = np.exp(total - total.max(axis=1, keepdims=True))
                        best = np.where(letters > 0, total.argmax(axis=1), len(langs))
                        sure = np.where(letters > 0, odds.max(axis=1) / odds.sum(axis=1), 0.0)
                    yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(labels[best], pa.string()), pa.array(sure, pa.float64())], [*names, "lang_pred", "score"])

    return rows.mapInArrow(score, schema)


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    langs, logs = fit(docs.where(~held_out()).withColumn("_pick", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20))))
    return predict(docs, langs, logs, {"doc_id": F.col("doc_id"), "held_out": held_out()})
