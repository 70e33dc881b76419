"""Packing into optimal length buckets.

Token counts come from the tokenizer; the driver gets their histogram, one row for each distinct length, of which there
are never more than the square root of twice all tokens.  Dynamic programming over the lengths picks at most `buckets`
boundaries with the least padding; a step costs one pass, as the best predecessors are the lower hull of lines.
Inside a bucket documents are numbered
without gaps and every budget // boundary of them make a batch (one where a document alone exceeds the budget).

Defined results: null and empty texts have the end id only; ties in length share a bucket; repeated rows are packed
each; an empty table gives an empty result; further columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ranks
from . import text as tx
from .store import cut

BUCKETS, BUDGET = 16, 65_536


def best_boundaries(longest: np.ndarray, counts: np.ndarray, sums: np.ndarray, buckets: int) -> list[int]:
    """Upper lengths of at most `buckets` runs of levels with the least total padding.

    Levels ascend; `longest` is the longest length of each, `counts` and `sums` its documents and their tokens.
    """
    n, total = ([0, *np.cumsum(x).tolist()] for x in (counts, sums))
    tops, m = longest.tolist(), len(longest)
    cost: list[int | None] = [0] + [None] * m
    choice = []
    for _ in range(min(buckets, m)):
        new, back = [0] * (m + 1), [0] * (m + 1)
        # Of the lines cost[i] + total[i] - n[i] * length the least at each length; slopes fall and lengths grow.
        hull: list[tuple[int, int, int]] = []
        at = 0
        for j in range(1, m + 1):
            if cost[j - 1] is not None:
                slope, base = -n[j - 1], cost[j - 1] + total[j - 1]
                while len(hull) > 1 and (base - hull[-2][1]) * (hull[-2][0] - hull[-1][0]) <= (hull[-1][1] - hull[-2][1]) * (hull[-2][0] - slope):
                    hull.pop()
                hull.append((slope, base, j - 1))
                at = min(at, len(hull) - 1)
            while at + 1 < len(hull) and hull[at + 1][0] * tops[j - 1] + hull[at + 1][1] <= hull[at][0] * tops[j - 1] + hull[at][1]:
                at += 1
            slope, base, back[j] = hull[at]
            new[j] = slope * tops[j - 1] + base + tops[j - 1] * n[j] - total[j]
        choice.append(back)
        cost = new
    out, j = [], m
    for back in reversed(choice):
        if j:
            out.append(int(longest[j - 1]))
            j = int(back[j])
    return out[::-1]


def token_lengths(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and n_tokens, the end id included."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .op4_token_store import encoder_of

        encoder = encoder_of(tokenizer_path)
        for whole in batches:
            for batch in tx.row_chunks(whole, "t", 1 << 20):
                yield pa.RecordBatch.from_arrays([batch.column("i"), pa.array(encoder.lengths(batch.column("t")) + 1)], ["doc_id", "n_tokens"])

    return docs.select(F.col(f"`{id_col}`").cast("long").alias("i"), F.col(f"`{text_col}`").cast("string").alias("t")).mapInArrow(count, "doc_id long, n_tokens long")


def pack(lengths: DataFrame, *, buckets: int = BUCKETS, budget: int = BUDGET) -> DataFrame:
    """bucket, padded_length, batch and place of every row of (doc_id, n_tokens)."""
    rows = cut(ranks.in_blocks(lengths, [F.col("doc_id")], cut_rows(lengths)))
    levels = rows.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n")).orderBy("n_tokens").toArrow()
    longest, counts = (levels.column(k).to_numpy() for k in ("n_tokens", "n"))
    bounds = best_boundaries(longest, counts, longest * counts, buckets)
    bucket = F.lit(0)
    for b in bounds[:-1]:
        bucket = bucket + F.when(F.col("n_tokens") > b, 1).otherwise(0)
    placed = ranks.numbered(rows.withColumn("bucket", bucket), ["bucket"], [F.col("doc_id"), F.col("n_tokens")], "_rank")
    padded = F.element_at(F.array(*(F.lit(int(b)).cast("long") for b in bounds or [1])), F.col("bucket") + 1)
    each = F.greatest(F.lit(1).cast("long"), F.floor(F.lit(budget) / padded))
    return placed.select("doc_id", "n_tokens", F.col("bucket").cast("int").alias("bucket"), padded.alias("padded_length"), F.floor(F.col("_rank") / each).alias("batch"), (F.col("_rank") % each).cast("long").alias("place"))


def cut_rows(df: DataFrame) -> int:
    return df.select("doc_id").count()


def pack_documents(docs: DataFrame, tokenizer_path: str, **options) -> DataFrame:
    return pack(cut(token_lengths(docs, tokenizer_path)), **options)


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
