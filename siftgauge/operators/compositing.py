"""Front-to-back compositing of splats, a tile at a time, as a renderer does it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Splats of a tile that are laid over its pixels at once.
STEP = 256


def composite(splats: DataFrame, side: int, least: float) -> DataFrame:
    """Contributions a and transmittances t of all pairs of splat and pixel with t >= `least`.

    `splats` has a row for each splat and each tile (cam, tx, ty) of `side` x `side` pixels that its box l, r, t, b meets.
    A pixel is supported where the conic is at most 9 and -conic / 2 at least `faint`.  Only splats are dealt out and
    sorted; their pixels are made where a tile is composited, and those behind `least`, beyond which transmittance only
    falls, are never made.  A task holds the log transmittances of one tile and STEP splats.
    """
    kind = {f.name: f.dataType.simpleString() for f in splats.schema}
    columns = ["gid", "cam", "batch", "px int", "py int", "cz", "a double", "t double", "w double", "c0", "c1", "c2"]
    schema = ", ".join(c if " " in c else f"{c} {kind[c]}" for c in columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, sums, live = None, np.zeros(0), np.zeros(0, int)
        for batch in batches:
            tiles = np.stack([batch.column(c).to_numpy() for c in ("cam", "tx", "ty")], axis=1)
            starts = [0, *(np.flatnonzero((tiles[1:] != tiles[:-1]).any(axis=1)) + 1).tolist(), len(tiles)]
            for first, end in zip(starts, starts[1:], strict=False):
                if first == end:
                    continue
                if (tile := tuple(tiles[first].tolist())) != at:
                    at, sums, live = tile, np.zeros(side * side), np.arange(side * side)
                for k in range(first, end, STEP):
                    if not len(live):
                        break
                    some = batch.slice(k, min(STEP, end - k))
                    px, py = at[1] * side + live % side, at[2] * side + live // side
                    l, r, t, b = (some.column(c).to_numpy() for c in "lrtb")  # noqa: E741
                    some = some.take(pa.array(np.flatnonzero((l <= px.max()) & (r >= px.min()) & (t <= py.max()) & (b >= py.min()))))
                    if not len(some):
                        continue
                    u, v, ia, ib, ic, alpha, faint, l, r, t, b = (some.column(c).to_numpy(zero_copy_only=False)[:, None] for c in ("u", "v", "ia", "ib", "ic", "alpha", "faint", "l", "r", "t", "b"))  # noqa: E741
                    with np.errstate(all="ignore"):
                        conic = ia * (px - u) * (px - u) + 2 * ib * (px - u) * (py - v) + ic * (py - v) * (py - v)
                        on = (px >= l) & (px <= r) & (py >= t) & (py <= b) & (conic <= 9) & (-conic / 2 >= faint)
                        a, logs = np.zeros(on.shape), np.zeros(on.shape)
                        a[on] = np.fmin(0.99, np.broadcast_to(alpha, on.shape)[on] * np.exp(-conic[on] / 2))
                        logs[on] = np.log(1 - a[on])
                    # Sums go down the rows one by one, from those of the splats before.
                    passed = np.cumsum(np.vstack([sums[live], logs]), axis=0)
                    through = np.exp(passed[:-1])
                    row, pixel = np.nonzero(on & (through >= least))
                    if len(row):
                        found, a, t = some.take(pa.array(row)), a[row, pixel], through[row, pixel]
                        made = {"px": pa.array(px[pixel], pa.int32()), "py": pa.array(py[pixel], pa.int32()), "a": pa.array(a), "t": pa.array(t), "w": pa.array(a * t)}
                        names = [c.split(" ")[0] for c in columns]
                        yield pa.RecordBatch.from_arrays([made[c] if c in made else found.column(c) for c in names], names)
                    sums[live] = passed[-1]
                    live = live[np.exp(passed[-1]) >= least]

    return splats.repartition("cam", "tx", "ty").sortWithinPartitions("cam", "tx", "ty", "cz", "gid").mapInArrow(run, schema)
