"""Exact n-gram Jaccard join in size-banded tiles with hashed bitmap signatures.

1. A document becomes its set of hashed shingles.  Equal sets are collapsed and numbered in the order of
   their smallest ids, last those of null ids only.  The number stands for the set: ids may be null or repeated.
2. Of a set of size n only the n - ceil(t n) + 1 first shingles in one global order go to tiles (a tile is a shingle):
   two sets that link share one of these.  The order is that of the hashes, but puts the shingles that are most frequent
   last.  They are counted over all rows, in the prefixes that the order of hashes alone would give; this steers the
   cost only, since any common order is exact.
   Tiles whose members are the same are one tile.
3. Inside a tile every set is paired with the smallest number of its own size band and of the band below; where the links
   found so far do not yet join all of a tile, pairs across its parts follow: at first for each set those with the
   fewest differing bits, then, where links of these leave parts, all.  So a group of copies gives pairs with its
   centres, not of all its members, and no link between parts is lost.
4. A pair is dropped by its sizes, then by bit counts: the bits in which two bitmaps of a size band differ are no more
   than the elements in which the sets differ, which bounds the overlap from above.  What is left is decided by the
   exact intersection of the sorted shingle arrays.
5. Components come from alternating star steps.  Links never reach the driver.

Defined results: documents without words (null, empty) have size 0 and are linked with nothing; fewer words than a
shingle make one shingle; repeated rows and ties are equal sets, and the smallest id names the component; a null id
takes part, but never names a component of others; an id with several texts is in the component of each; an empty table gives an empty result; further columns do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import text as tx
from .components import components
from .store import Tables, small_batches

WIDTH, PERCENT = 4, 85
#: Documents beyond which a shingle is frequent, and how many of the most frequent are known to all tasks (8 bytes each).
FREQUENT_FROM, MOST_FREQUENT = 16, 1 << 17
#: Members of one star that one task compares with its centre.
STAR_MEMBERS = 20_000
#: Sets to compare up to which their numbers (24 bytes each) are broadcast; beyond it texts meet them by a shuffle join.
MOST_BROADCAST = 500_000
#: Partners that a set gets in each round of pairs across the parts of a tile; None: all, so that no link is lost.
LIKELIEST = (4, None)
#: Bits of a bitmap for each element, at least.
BITS_EACH = 4
_HOT = np.uint64(1 << 63)


def shingle_sets(texts: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct shingle hashes, offsets of the documents in them)."""
    words, offsets = tx.words_of(texts, tx.NON_SPACE, True)
    n = np.diff(offsets)
    all_ = tx.shingle_hashes(words, width)
    sets, sizes = [], np.zeros(len(n), np.int64)
    for k, (lo, count) in enumerate(zip(offsets[:-1].tolist(), n.tolist(), strict=True)):
        if count >= width:
            own = np.unique(all_[lo : lo + count - width + 1])
        elif count:
            own = tx.shingle_hashes(words[lo : lo + count], count) ^ np.uint64(count)
        else:
            continue
        sets.append(own)
        sizes[k] = len(own)
    return np.concatenate(sets) if sets else np.zeros(0, np.uint64), np.r_[0, np.cumsum(sizes)]


def needed(n: np.ndarray, percent: int) -> np.ndarray:
    """The least overlap of a set of size n with any set that links with it."""
    return -(-percent * n // 100)


def bitmap(own: np.ndarray) -> bytes:
    """Signature of a set: 64 * 2^k bits, at least BITS_EACH for each element; bit = hash modulo the size."""
    bits = 64
    while bits < BITS_EACH * len(own):
        bits *= 2
    flags = np.zeros(bits, bool)
    flags[(own & np.uint64(bits - 1)).astype(np.int64)] = True
    return np.packbits(flags, bitorder="little").tobytes()


def differing_bits(a: bytes, b: bytes) -> int:
    """At most the number of elements in which the sets differ."""
    x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
    while len(x) > len(y):
        x = x[: len(x) // 2] | x[len(x) // 2 :]
    while len(y) > len(x):
        y = y[: len(y) // 2] | y[len(y) // 2 :]
    return int(np.bitwise_count(x ^ y).sum())


def _frequent(rows: DataFrame, width: int, percent: int) -> np.ndarray:
    """Shingles that more than FREQUENT_FROM documents have among their least hashes, rarest first; counted over all rows."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in tx.row_chunks(whole, "t", tx.PASS_BYTES):
                sets, offsets = shingle_sets(batch.column("t"), width)
                n = np.diff(offsets)
                row, k = tx.expand(np.where(n > 0, n - needed(n, percent) + 1, 0))
                yield pa.RecordBatch.from_arrays([pa.array(sets[offsets[row] + k].view(np.int64))], ["s"])

    counted = rows.select("t").mapInArrow(split, "s long").groupBy("s").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") > FREQUENT_FROM)
    with small_batches(rows.sparkSession):
        top = counted.orderBy(F.col("k").desc(), "s").limit(MOST_FREQUENT).select("s").toArrow()
    return top.column("s").to_numpy()[::-1].astype(np.int64).view(np.uint64)


def row_hash(id_col: str = "doc_id", text_col: str = "text") -> Column:
    """What rows are known by: equal for repeated rows, and defined for null ids."""
    return F.xxhash64(F.col(f"`{id_col}`").cast("long"), F.col(f"`{text_col}`").cast("string"))


def signatures(rows: DataFrame, width: int, percent: int) -> DataFrame:
    """doc_id, row, n, d1, d2 (a digest of the set), prefix and bits of every row of (i, t, row)."""
    frequent = rows.sparkSession.sparkContext.broadcast(_frequent(rows, width, percent))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot = frequent.value
        order = np.argsort(hot)
        known = hot[order]
        for whole in batches:
            for batch in tx.row_chunks(whole, "t", tx.PASS_BYTES):
                sets, offsets = shingle_sets(batch.column("t"), width)
                n = np.diff(offsets)
                key = sets >> np.uint64(1)
                if len(known):
                    at = np.minimum(np.searchsorted(known, sets), len(known) - 1)
                    is_hot = known[at] == sets
                    key = np.where(is_hot, _HOT + order[at].astype(np.uint64), key)
                sums = [np.r_[np.uint64(0), np.cumsum(tx.mix(sets ^ np.uint64(c)))] for c in (0x1234567, 0xABCDEF987)]
                d1, d2 = (tx.mix(s[offsets[1:]] - s[offsets[:-1]]).view(np.int64) for s in sums)
                length = np.where(n > 0, n - needed(n, percent) + 1, 0)
                prefixes, maps = [], []
                for k in range(batch.num_rows):
                    own, keys = sets[offsets[k] : offsets[k + 1]], key[offsets[k] : offsets[k + 1]]
                    p = int(length[k])
                    first = np.argpartition(keys, p - 1)[:p] if 0 < p < len(own) else np.arange(len(own))
                    prefixes.append(own[first].tobytes())
                    maps.append(bitmap(own))
                yield pa.RecordBatch.from_arrays([batch.column("i"), batch.column("row"), pa.array(n), pa.array(d1), pa.array(d2), pa.array(prefixes, pa.binary()), pa.array(maps, pa.binary())], ["doc_id", "row", "n", "d1", "d2", "prefix", "bits"])

    return rows.mapInArrow(sign, "doc_id long, row long, n long, d1 long, d2 long, prefix binary, bits binary")


def _tiles(sets: DataFrame) -> DataFrame:
    """(token, node) for each prefix shingle that several sets have."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 2000):
                batch = whole.slice(lo, 2000)
                prefixes = batch.column("prefix").to_pylist()
                node = np.repeat(batch.column("node").to_numpy(), [len(p) // 8 for p in prefixes])
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(b"".join(prefixes), np.int64)), pa.array(node)], ["token", "node"])

    def several(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Of rows in the order of their tokens those whose token also stands beside them; the last row waits for the next batch."""
        token, node = np.zeros(0, np.int64), np.zeros(0, np.int64)
        before = None
        for batch in batches:
            token, node = np.r_[token, batch.column("token").to_numpy()], np.r_[node, batch.column("node").to_numpy()]
            if len(token) < 2:
                continue
            same = token[1:] == token[:-1]
            keep = np.r_[before is not None and token[0] == before, same[:-1]] | same
            yield pa.RecordBatch.from_arrays([pa.array(token[:-1][keep]), pa.array(node[:-1][keep])], ["token", "node"])
            before, token, node = token[-2], token[-1:], node[-1:]
        if len(token) and before is not None and token[0] == before:
            yield pa.RecordBatch.from_arrays([pa.array(token), pa.array(node)], ["token", "node"])

    every = sets.select("prefix", "node").mapInArrow(split, "token long, node long")
    return every.repartition("token").sortWithinPartitions("token").mapInArrow(several, "token long, node long")


def _sizes_fit(a: str, b: str, percent: int) -> str:
    return f"100 * least({a}, {b}) >= {percent} * greatest({a}, {b})"


def _by_bits(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) that the bitmaps allow."""
    x = sets.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("bits").alias("xa"))
    y = sets.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("bits").alias("xb"))

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            na, nb = (batch.column(c).to_numpy() for c in ("na", "nb"))
            most = na + nb - 2 * (-(-percent * (na + nb) // (100 + percent)))
            ok = [differing_bits(p.as_py(), q.as_py()) <= m for p, q, m in zip(batch.column("xa"), batch.column("xb"), most.tolist(), strict=True)]
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return pairs.join(x, "a").join(y, "b").mapInArrow(test, "a long, b long")


class _Tile:
    """Members of a tile in the order of their sizes, and their bitmaps as one matrix for each bitmap size."""

    def __init__(self, rows: list[tuple]) -> None:
        rows.sort(key=lambda r: (r[2], r[0]))
        self.node, self.root, self.n = (np.array([r[k] for r in rows], np.int64) for k in range(3))
        width = np.array([len(r[3]) // 8 for r in rows])
        self.kinds, self.first = np.unique(width, return_index=True)
        self.end = np.r_[self.first[1:], len(rows)]
        self.maps = {(k, w): np.frombuffer(b"".join(r[3] for r in rows[lo:hi]), np.uint64).reshape(-1, w) for k, (w, lo, hi) in enumerate(zip(self.kinds.tolist(), self.first.tolist(), self.end.tolist(), strict=True))}

    def _folded(self, kind: int, width: int) -> np.ndarray:
        if (kind, width) not in self.maps:
            twice = self._folded(kind, 2 * width)
            self.maps[kind, width] = twice[:, :width] | twice[:, width:]
        return self.maps[kind, width]

    def differing(self, i: int, lo: int, hi: int) -> np.ndarray:
        """Differing bits of member i and the members from lo to hi - 1."""
        own, out = int(np.searchsorted(self.first, i, "right")) - 1, []
        for kind, (width, first, end) in enumerate(zip(self.kinds.tolist(), self.first.tolist(), self.end.tolist(), strict=True)):
            x, y = max(lo, first), min(hi, end)
            if x < y:
                width = min(width, int(self.kinds[own]))
                out.append(np.bitwise_count(self._folded(kind, width)[x - first : y - first] ^ self._folded(own, width)[i - self.first[own]]).sum(axis=1, dtype=np.int64))
        return np.concatenate(out)


def _tile_pairs(token: int, rows: list[tuple], percent: int, most: int | None) -> Iterator[pa.RecordBatch]:
    """(token, a, b, left): for each row outside the largest part its `most` likeliest partners of other parts; left: it has more."""
    tile = _Tile(rows)
    node, root, n = tile.node, tile.root, tile.n
    _, which = np.unique(root, return_inverse=True)
    outside = which != np.bincount(which).argmax()
    for i in np.flatnonzero(outside).tolist():
        # Partners in the band; of two rows outside the largest part the later one looks.
        lo, hi = int(np.searchsorted(n, -(-percent * n[i] // 100))), int(np.searchsorted(n, n[i] * 100 // percent, "right"))
        differ = tile.differing(i, lo, hi)
        other = n[lo:hi]
        ok = differ <= n[i] + other - 2 * (-(-percent * (n[i] + other) // (100 + percent)))
        j = np.flatnonzero(ok & (root[lo:hi] != root[i]) & ((np.arange(lo, hi) < i) | ~outside[lo:hi]))
        if not len(j):
            continue
        left = most is not None and len(j) > most
        if left:
            j = j[np.argsort(differ[j], kind="stable")[:most]]
        j += lo
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(j), token)), pa.array(np.maximum(node[j], node[i])), pa.array(np.minimum(node[j], node[i])), pa.array(np.full(len(j), left))], ["token", "a", "b", "left"])


def _across(members: DataFrame, percent: int, most: int | None) -> DataFrame:
    """Pairs (token, a, b) of different parts (`root`) of a tile that sizes and bit counts allow, and whether some are `left`."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        token = None
        for batch in batches:
            for t, *row in zip(*(batch.column(c).to_pylist() for c in ("token", "node", "root", "n", "bits")), strict=True):
                if t != token:
                    if len(held) > 1:
                        yield from _tile_pairs(token, held, percent, most)
                    held, token = [], t
                held.append(tuple(row))
        if len(held) > 1:
            yield from _tile_pairs(token, held, percent, most)

    dealt = members.select("token", "node", "root", "n", "bits").repartition("token").sortWithinPartitions("token")
    return dealt.mapInArrow(look, "token long, a long, b long, left boolean")


def _exact(pairs: DataFrame, rows: DataFrame, sets: DataFrame, width: int, percent: int, tables: Tables) -> DataFrame:
    """Pairs (a, b) that link; b is the centre of a star, whose members may be dealt to several tasks."""
    parts = pairs.groupBy("b").agg(F.count(F.lit(1)).alias("k")).select("b", F.ceil(F.col("k") / STAR_MEMBERS).alias("parts"))
    members = pairs.join(parts, "b").select(F.col("a").alias("node"), "b", F.pmod(F.xxhash64("a"), F.col("parts")).alias("part"))
    centres = parts.select(F.col("b").alias("node"), "b", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    places = tables.write(members.unionByName(centres))
    wanted = tables.write(places.select("node").distinct().join(sets.select("node", "d1", "row"), "node"))

    def shingle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in tx.row_chunks(whole, "t", tx.PASS_BYTES):
                own, offsets = shingle_sets(batch.column("t"), width)
                sums = np.r_[np.uint64(0), np.cumsum(tx.mix(own ^ np.uint64(0x1234567)))]
                found = tx.mix(sums[offsets[1:]] - sums[offsets[:-1]]).view(np.int64)
                right = np.flatnonzero(found == batch.column("d1").to_numpy())
                yield pa.RecordBatch.from_arrays([batch.column("node").take(pa.array(right)), pa.array([own[offsets[k] : offsets[k + 1]].tobytes() for k in right], pa.binary())], ["node", "s"])

    few = wanted.count() <= MOST_BROADCAST
    texts = rows.join(F.broadcast(wanted) if few else wanted, "row").select("node", "d1", "t")
    # A centre (b, part) is sent its members and itself; rows of it stand first, and a repeated row gives an array twice.
    together = texts.mapInArrow(shingle, "node long, s binary").join(places, "node").select("b", "part", (F.col("node") != F.col("b")).alias("member"), "node", "s")
    together = together.repartition("b", "part").sortWithinPartitions("b", "part", "member", "node")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre, last = np.zeros(0, np.uint64), None
        for batch in batches:
            links: list[tuple[int, int]] = []
            for place, is_member, s in zip(zip(*(batch.column(c).to_pylist() for c in ("b", "part", "node")), strict=True), batch.column("member").to_pylist(), batch.column("s"), strict=True):
                if place == last:
                    continue
                last = place
                own = np.frombuffer(s.as_buffer(), np.uint64)
                if not is_member:
                    centre = own.copy()
                    continue
                at = np.searchsorted(centre, own)
                both = int((centre[np.minimum(at, len(centre) - 1)] == own).sum())
                if 100 * both >= percent * (len(own) + len(centre) - both):
                    links.append((place[2], place[0]))
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in links], pa.int64()), pa.array([x[1] for x in links], pa.int64())], ["u", "v"])

    links = tables.write(together.mapInArrow(compare, "u long, v long"))
    tables.drop(places, wanted)
    return links


def members(docs: DataFrame, *, width: int = WIDTH, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, row (its `row_hash`), n_shingles, component (a number; null without words) and component_id of every row."""
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("i"), F.col(f"`{text_col}`").cast("string").alias("t"), row_hash(id_col, text_col).alias("row"))
    tables = Tables(docs.sparkSession, "jaccard")
    signed = tables.write(signatures(rows, width, percent))
    slim = tables.write(signed.select("doc_id", "row", "n", "d1", "d2"))
    least = slim.where("n > 0").groupBy("d1", "d2").agg(F.min("doc_id").alias("least"))
    numbers = tables.write(least.orderBy(F.col("least").asc_nulls_last(), "d1", "d2").withColumn("node", F.monotonically_increasing_id()))
    sets = signed.where("n > 0").groupBy("d1", "d2").agg(F.min(F.struct("row", "n", "prefix", "bits")).alias("x")).join(numbers, ["d1", "d2"])
    sets = tables.write(sets.select("d1", "node", "x.row", "x.n", "x.prefix", "x.bits"))
    tables.drop(signed)
    several = tables.write(_tiles(sets))
    # Tiles with the same members give the same pairs: one of them stays, as those of a shared passage mostly are.
    of = [F.count(F.lit(1)).alias("k"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64(F.lit(1), "node")).alias("y")]
    tiles = several.groupBy("token").agg(*of).groupBy("k", "x", "y").agg(F.min("token").alias("token")).select("token")
    shared = tables.write(several.join(tiles, "token").join(sets.select("node", "n"), "node"))
    tables.drop(several)
    # A star for each size band of a tile: bands are powers of 100 / percent, so members may link with their own centre or the one below.
    band = F.floor(F.log(F.col("n")) / F.log(F.lit(100 / percent)) + 1e-9).cast("int")
    banded = shared.withColumn("band", band)
    centres = banded.groupBy("token", "band").agg(F.min(F.struct("node", "n")).alias("c"))
    near = centres.select("token", "band", "c").unionByName(centres.select("token", (F.col("band") + 1).alias("band"), "c"))
    pairs = banded.join(near, ["token", "band"]).where("node <> c.node").where(_sizes_fit("n", "c.n", percent)).select(F.col("node").alias("a"), F.col("c.node").alias("b")).distinct()
    tried = tables.write(_by_bits(pairs, sets, percent))
    found = components(_exact(tried, rows, sets, width, percent, tables))
    # What the stars left apart: pairs across the parts of a tile, the likeliest first, then all that are still apart.
    tiles = shared.select("token", "node")
    for most in LIKELIEST:
        labelled = tiles.join(found, "node", "left").select("token", "node", F.coalesce("root", "node").alias("root"))
        # Two members have been compared: one of them is a centre of the other.
        open_ = labelled.groupBy("token").agg(F.count(F.lit(1)).alias("k"), F.min("root").alias("x"), F.max("root").alias("y")).where("k > 2 AND x <> y").select("token")
        across = tables.write(_across(labelled.join(open_, "token").join(sets.select("node", "n", "bits"), "node"), percent, most))
        known = tried.unionByName(tried.select(F.col("b").alias("a"), F.col("a").alias("b")))
        more = tables.write(across.select("a", "b").distinct().join(known, ["a", "b"], "left_anti"))
        if more.head(1):
            tried = tried.unionByName(more)
            new = _exact(more, rows, sets, width, percent, tables)
            if new.head(1):
                found = components(found.select(F.col("node").alias("u"), F.col("root").alias("v")).unionByName(new))
        # Of other tiles every pair of parts has been tried.
        rest = tables.write(across.where("left").select("token").distinct())
        tables.drop(across)
        if not rest.head(1):
            break
        tiles = shared.select("token", "node").join(rest, "token")
    tables.drop(sets, shared)
    # The root is the least number of a component, so its least id is that of the component.
    roots = numbers.select("d1", "d2", "node").join(found, "node", "left").select("d1", "d2", F.coalesce("root", "node").alias("component"))
    roots = roots.join(numbers.select(F.col("node").alias("component"), F.col("least").alias("component_id")), "component")
    full = slim.where("n > 0").join(roots, ["d1", "d2"]).select("doc_id", "row", F.col("n").alias("n_shingles"), "component", "component_id")
    return full.unionByName(slim.where("n = 0").select("doc_id", "row", F.col("n").alias("n_shingles"), F.lit(None).cast("long").alias("component"), F.col("doc_id").alias("component_id")))


def linked(docs: DataFrame, **options) -> DataFrame:
    """doc_id, n_shingles and component_id of every row."""
    return members(docs, **options).select("doc_id", "n_shingles", "component_id")


def one_of_each(docs: DataFrame, *, width: int = WIDTH, percent: int = PERCENT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs`, with their own columns, of which one stands for its component, and those without words.

    The smallest id stays, null last; of rows with one id and text, one.
    """
    tables, names = Tables(docs.sparkSession, "representatives"), docs.columns
    found = tables.write(members(docs, width=width, percent=percent, id_col=id_col, text_col=text_col))
    firsts = found.where("n_shingles > 0").groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("x")).select("x.row")
    copies = found.groupBy("row").agg(F.count(F.lit(1)).alias("copies"))
    kept = tables.write(firsts.unionByName(found.where("n_shingles = 0").select("row")).distinct().join(copies, "row"))
    tables.drop(found)
    rows = docs.select(*(F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(names)), row_hash(id_col, text_col).alias("row")).join(kept, "row")
    # Only rows that stand several times meet by a shuffle.
    one = rows.where("copies = 1").unionByName(rows.where("copies > 1").dropDuplicates(["row"]))
    return one.select(*(F.col(f"c{k}").alias(c) for k, c in enumerate(names)))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked(spark.read.parquet(f"{sf_dir}/documents.parquet"))
