"""Minimax contiguous partition of atomic groups into shards, in DataFrame functions only.

Documents of equal text form a group that no cut divides.  Groups stand in the order of their smallest id, and their
running sizes are summed in two steps (inside blocks, then over blocks).  The smallest capacity for which a greedy walk
fills at most `shards` shards is found by binary search.  The walk needs, for a capacity, the largest running size up
to some value; the driver keeps a bounded set of known running sizes (`Knots`) which gives a lower and an upper bound of
the capacity, and each round asks one aggregation for finer knots only where cuts can fall.  When both bounds meet the
capacity is exact.  What the driver holds does not grow with the data.

Defined results: a null text has size 8 and checksum 0 and is a group of its own, apart from empty texts; repeated rows
are equal texts; a group larger than the mean shard makes the capacity; an empty table gives an empty result; further
columns do not matter.
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import ranks
from .store import cut

SHARDS, OVERHEAD = 24, 8
#: Most knots asked for in one round.
KNOTS = 1 << 14


class Knots:
    """Known running sizes, in order; open[i]: there may be others between values[i] and values[i + 1]."""

    def __init__(self, total: int) -> None:
        self.values, self.open = [0, total], [True]

    def refine(self, low: int, high: int, buckets: list[tuple[int, int, int]]) -> None:
        """Replaces what is known inside [low, high], two knots, by (least, most, count) of non-empty buckets."""
        a, b = self.values.index(low), self.values.index(high)
        values, gaps = [low], []
        for least, most, count in sorted(buckets):
            for v, gap in ((least, False), (most, count > 2)):
                if v > values[-1] and v < high:
                    values.append(v)
                    gaps.append(gap if v != least else False)
        self.values[a : b + 1], self.open[a:b] = [*values, high], [*gaps, False]

    def walk(self, capacity: int, shards: int, hopeful: bool) -> list[int]:
        """Cuts of the greedy walk over known values; `hopeful`: an open gap is taken to hold any value."""
        at, cuts = 0, []
        while at < self.values[-1] and len(cuts) < shards:
            reach = at + capacity
            k = bisect_right(self.values, reach) - 1
            step = self.values[k]
            if hopeful and k < len(self.open) and self.open[k]:
                step = max(step, min(reach, self.values[k + 1] - 1))
            if step <= at:
                break
            cuts.append(at := step)
        return cuts

    def least(self, low: int, high: int, shards: int, hopeful: bool) -> int:
        """The least capacity in [low, high] whose walk reaches the end; `high` must."""
        while low < high:
            mid = (low + high) // 2
            cuts = self.walk(mid, shards, hopeful)
            if cuts and cuts[-1] == self.values[-1]:
                high = mid
            else:
                low = mid + 1
        return low


def minimax_cuts(sums: DataFrame, total: int, largest: int, shards: int) -> tuple[int, list[int]]:
    """(capacity, cuts) for the running sizes in column `upto` of `sums`."""
    if not total:
        return 0, []
    knots = Knots(total)
    low, high = max(-(-total // shards), largest), total
    spans = [(0, total)]
    while True:
        each = max(2, KNOTS // len(spans))
        which = where = None
        for k, (a, b) in enumerate(spans):
            inside = (F.col("upto") > a) & (F.col("upto") < b)
            place = F.floor((F.col("upto") - a) * F.lit(each) / F.lit(b - a)).cast("long")
            which, where = (F.when(inside, k), F.when(inside, place)) if which is None else (which.when(inside, k), where.when(inside, place))
        got = sums.select(which.alias("k"), where.alias("b"), "upto").where("k IS NOT NULL").groupBy("k", "b").agg(F.min("upto").alias("a"), F.max("upto").alias("z"), F.count(F.lit(1)).alias("n")).collect()
        for k, (a, b) in enumerate(spans):
            knots.refine(a, b, [(r["a"], r["z"], r["n"]) for r in got if r["k"] == k])
        low, high = knots.least(low, high, shards, True), knots.least(low, high, shards, False)
        if low >= high:
            return high, knots.walk(high, shards, False)
        reach = list(zip(knots.walk(low, shards, False), knots.walk(high, shards, True), strict=False))
        spans = []
        for a, b in sorted(reach):
            i, j = bisect_right(knots.values, a) - 1, bisect_right(knots.values, b)
            i, j = min(i, len(knots.open) - 1), min(j, len(knots.values) - 1)
            if any(knots.open[i:j]):
                a, b = knots.values[i], knots.values[j]
                if spans and a < spans[-1][1]:
                    spans[-1] = (spans[-1][0], max(b, spans[-1][1]))
                else:
                    spans.append((a, b))
        if not spans:
            return high, knots.walk(high, shards, False)


def shard_rows(docs: DataFrame, shards: int = SHARDS, overhead: int = OVERHEAD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every row."""
    text = F.col(f"`{text_col}`").cast("string")
    sized = docs.select(
        F.col(f"`{id_col}`").alias("doc_id"), (F.coalesce(F.octet_length(text), F.lit(0)) + overhead).cast("long").alias("size"),
        F.coalesce(F.crc32(text), F.lit(0)).cast("long").alias("text_crc32"), F.coalesce(F.unhex(F.sha2(text, 256)), F.concat(F.lit("null "), F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("null"))).cast("binary")).alias("g"),
    )
    n = docs.count()
    rows = cut(ranks.in_blocks(sized, [F.col("doc_id")], n))
    groups = rows.groupBy("g").agg(F.min("doc_id").alias("first"), F.sum("size").alias("bytes"))
    placed = cut(ranks.in_blocks(groups, [F.col("first"), F.col("g")], n))
    inside = Window.partitionBy(ranks.BLOCK).orderBy("first", "g").rowsBetween(Window.unboundedPreceding, 0)
    blocks = placed.groupBy(ranks.BLOCK).agg(F.sum("bytes").alias("b"))
    base = blocks.select(ranks.BLOCK, F.coalesce(F.sum("b").over(Window.orderBy(ranks.BLOCK).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    sums = cut(placed.withColumn("own", F.sum("bytes").over(inside)).join(base, ranks.BLOCK).select("g", "bytes", (F.col("own") + F.col("base")).alias("upto")))
    ends = sums.agg(F.max("upto").alias("t"), F.max("bytes").alias("m")).first()
    _, cuts = minimax_cuts(sums, ends["t"] or 0, ends["m"] or 0, shards)
    shard = F.lit(0)
    for c in cuts[:-1]:
        shard = shard + F.when(F.col("upto") > c, 1).otherwise(0)
    dealt = rows.join(sums.select("g", shard.cast("int").alias("shard")), "g").drop("g")
    return ranks.numbered(dealt, ["shard"], [F.col("doc_id"), F.col("text_crc32")], "slot").select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op7_shard_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_rows(spark.read.parquet(f"{sf_dir}/documents.parquet"))
