"""Slabs between boundaries, boxes fitted to grids, and masks of blocks."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import floor

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blockmask import AXES, Box, Triple, common, is_empty
from .geometry import split_runs


def slab_of(x: Column, boundaries: list[int], first: int, step: int = -1) -> Column:
    """The number of the slab that x is in: first from the first boundary on, and so on; null before the first and from the last on."""
    out = F.lit(None).cast("int")
    for k in range(len(boundaries) - 1):
        out = F.when((x >= boundaries[k]) & (x < boundaries[k + 1]), first + step * k).otherwise(out)
    return out


def region_slabs(regions: DataFrame, boundaries: list[int], first: int, step: int = -1, block: int = 32) -> DataFrame:
    """(roi, slab, x, blocks, voxels, percent): how each region's runs (roi, z, y, x0, x1) of blocks are spread over slabs along x.

    Boundaries move to the nearest block, halves up. Slabs without blocks are listed too; percent is of all the
    region's blocks, those outside of slabs too.
    """
    near = [floor(b / block + 0.5) for b in boundaries]
    slabs = F.array(*(F.struct(F.lit(first + step * k).alias("slab"), F.lit(boundaries[k]).alias("x"), F.lit(near[k]).alias("lo"), F.lit(near[k + 1]).alias("hi")) for k in range(len(boundaries) - 1)))
    inside = lambda s: F.greatest(F.least(F.col("x1") + 1, s["hi"]) - F.greatest(F.col("x0"), s["lo"]), F.lit(0))
    rows = regions.select("roi", (F.col("x1") - F.col("x0") + 1).alias("n"), F.inline(F.transform(slabs, lambda s: F.struct(s["slab"].alias("slab"), s["x"].alias("x"), inside(s).cast("long").alias("k")))))
    out = rows.groupBy("roi", "slab", "x").agg(F.sum("k").alias("blocks"), F.sum("n").alias("all"))
    return out.select("roi", "slab", "x", "blocks", (F.col("blocks") * block**3).cast("double").alias("voxels"), (100 * F.col("blocks") / F.col("all")).alias("percent"))


def severed_bodies(voxels: DataFrame, boundaries: list[int], offset: int, bodies: DataFrame | None = None, label: str = "label") -> DataFrame:
    """(label, left, right, severed) of bodies met at planes just before (left) and after (right) inner boundaries along x.

    Going from boundary to boundary, a body is severed if, of the planes so far, it has been met on one side alone.
    """
    own = voxels if bodies is None else voxels.join(bodies.select(label).distinct(), label, "left_semi")
    planes = [(b + side * offset, k, side) for k, b in enumerate(boundaries[1:-1]) for side in (-1, 1)]
    at = F.inline(F.filter(F.array(*(F.struct(F.lit(x).alias("at"), F.lit(k).alias("k"), F.lit(s).alias("side")) for x, k, s in planes)), lambda p: p["at"] == F.col("x")))
    met = own.where(f"`{label}` != 0").select(label, at).groupBy(label).agg(F.min(F.when(F.col("side") < 0, F.col("k"))).alias("l"), F.min(F.when(F.col("side") > 0, F.col("k"))).alias("r"))
    return met.select(label, F.col("l").isNotNull().alias("left"), F.col("r").isNotNull().alias("right"), (~F.col("l").eqNullSafe(F.col("r"))).alias("severed"))


@dataclass(frozen=True)
class Grid:
    shape: Triple
    offset: Triple = (0, 0, 0)
    halo: Triple = (0, 0, 0)

    def equivalent(self, other: Grid) -> bool:
        """Whether both have the same cells: offsets count by what is left of whole cells."""
        left = lambda g: tuple(o % s for o, s in zip(g.offset, g.shape))
        return self.shape == other.shape and self.halo == other.halo and left(self) == left(other)

    def outward(self, box: Box) -> Box:
        return tuple((a - o) // s * s + o for a, s, o in zip(box[0], self.shape, self.offset)), tuple(-((o - b) // s) * s + o for b, s, o in zip(box[1], self.shape, self.offset))

    def inward(self, box: Box) -> Box:
        return tuple(-((o - a) // s) * s + o for a, s, o in zip(box[0], self.shape, self.offset)), tuple((b - o) // s * s + o for b, s, o in zip(box[1], self.shape, self.offset))


def crop_to_grid(voxels: DataFrame, box: Box, grid: Grid) -> tuple[DataFrame, Box]:
    """(voxels, box) within the greatest box of whole cells inside the given one; an empty one if there is none."""
    new = grid.inward(box)
    if is_empty(new):
        new = (new[0], new[0])
    inside = [(F.col(a) >= lo) & (F.col(a) < hi) for a, lo, hi in zip(AXES, *common(new, box))]
    return voxels.where(inside[0] & inside[1] & inside[2]), new


def pad_to_grid(voxels: DataFrame, box: Box, grid: Grid, fill: int | None = None, label: str = "label") -> tuple[DataFrame, Box]:
    """(voxels, box) of the least box of whole cells around the given one. Voxels that aren't listed are 0 anyway; with fill those outside the old box are listed with that label."""
    new = grid.outward(box)
    if fill is None:
        return voxels, new
    cells = voxels.sparkSession.range(new[0][0], new[1][0]).select(F.col("id").alias("z"))
    for a, k in (("y", 1), ("x", 2)):
        cells = cells.repartition(*cells.columns).withColumn(a, F.explode(F.sequence(F.lit(new[0][k]).cast("long"), F.lit(new[1][k] - 1).cast("long"))))
    inside = [(F.col(a) >= lo) & (F.col(a) < hi) for a, lo, hi in zip(AXES, *box)]
    rim = cells.where(~(inside[0] & inside[1] & inside[2]))
    kind = dict(voxels.dtypes)
    return voxels.select(*AXES, label).unionByName(rim.select(*(F.col(a).cast(kind[a]).alias(a) for a in AXES), F.lit(fill).cast(kind[label]).alias(label))), new


def block_masks(runs: DataFrame, side: int, halo: int = 0) -> DataFrame:
    """(bz, by, bx, z0, y0, x0, z1, y1, x1, mask) of the blocks of a grid that runs (z, y, x0, x1) touch: bits of the block with its halo, in scan order, eight a byte, the first one highest."""
    wide = side + 2 * halo

    def masks(rows: pd.DataFrame) -> Iterator[tuple]:
        at = rows[["bz", "by", "bx"]].to_numpy()
        low = at * side - halo
        line = ((rows["z"].to_numpy() - low[:, 0]) * wide + rows["y"].to_numpy() - low[:, 1]) * wide - low[:, 2]
        starts, lengths = line + rows["x0"].to_numpy(), (rows["x1"] - rows["x0"] + 1).to_numpy()
        ends = np.append(np.flatnonzero((at[1:] != at[:-1]).any(axis=1)) + 1, len(at))
        first = 0
        for end in ends.tolist():
            mask, n = np.zeros(wide**3, bool), lengths[first:end]
            mask[np.repeat(starts[first:end] - np.cumsum(n) + n, n) + np.arange(n.sum())] = True
            corner = low[first].tolist()
            yield (*at[first].tolist(), *corner, *(v + wide for v in corner), np.packbits(mask).tobytes())
            first = end

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None  # a block that may go on in the next batch
        for rows in batches:
            rows = rows if held is None else pd.concat([held, rows], ignore_index=True)
            last = (rows[["bz", "by", "bx"]] == rows[["bz", "by", "bx"]].iloc[-1]).all(axis=1) if len(rows) else []
            held, rows = (rows[last], rows[~last]) if len(rows) else (None, rows)
            if len(rows):
                yield pd.DataFrame(list(masks(rows)), columns=names)
        if held is not None:
            yield pd.DataFrame(list(masks(held)), columns=names)

    form = "bz long, by long, bx long, z0 long, y0 long, x0 long, z1 long, y1 long, x1 long, mask binary"
    names = [c.split()[0] for c in form.split(", ")]
    cut = split_runs(runs.select(*(F.col(c).cast("long").alias(c) for c in ("z", "y", "x0", "x1"))), side, halo)
    return cut.select("bz", "by", "bx", "z", "y", "x0", "x1").repartition("bz", "by", "bx").sortWithinPartitions("bz", "by", "bx").mapInPandas(run, form)


def masks_to_voxels(masks: DataFrame, side: int, halo: int = 0) -> DataFrame:
    """(z, y, x) of set voxels of block masks, each once."""
    wide = side + 2 * halo

    def run(batches):
        for b in batches:
            made, n = [], 0
            for z0, y0, x0, mask in zip(b["z0"], b["y0"], b["x0"], b["mask"]):
                bits = np.unpackbits(np.frombuffer(bytes(mask), np.uint8), count=wide**3).reshape((wide,) * 3)
                at = np.nonzero(bits)
                made.append([a + low for a, low in zip(at, (z0, y0, x0))])
                n += len(at[0])
                if n >= 100_000:
                    yield pd.DataFrame(dict(zip(AXES, map(np.concatenate, zip(*made)))))
                    made, n = [], 0
            if made:
                yield pd.DataFrame(dict(zip(AXES, map(np.concatenate, zip(*made)))))

    got = masks.select("z0", "y0", "x0", "mask").mapInPandas(run, "z long, y long, x long")
    return got.distinct() if halo else got

