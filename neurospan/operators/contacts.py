"""Where labels meet, what grows around points and labels, and how large supervoxels are cut along grids."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .geometry import dealt, downsample, split_runs
from .graph import settle, _spread_join

AXES = ("z", "y", "x")
_FACES = [(-1, 0, 0), (0, -1, 0), (0, 0, -1), (0, 0, 1), (0, 1, 0), (1, 0, 0)]  # in scan order


def grid_split_plan(runs: DataFrame, first: int, last: int, key: str = "sv") -> DataFrame:
    """(key, grid, bz, by, bx, voxels, parent_voxels, remains) of cuts along cubes, from a coarse grid to a fine one by halves.

    Each piece of a grid is cut along the next; the last cell of a piece in scan order is what remains of it
    (remains), all others are split off. first is last times a power of 2, else it raises. Runs are (key, z, y, x0,
    x1 inclusive). Pieces needn't hang together. No runs, no cuts.
    """
    ratio = first // last if last > 0 else 0
    if ratio < 1 or ratio * last != first or ratio & (ratio - 1):
        raise ValueError("the coarse grid must be the fine one times a power of 2")
    fine = settle(split_runs(runs.select(key, "z", "y", "x0", "x1"), last))
    cells = settle(dealt(fine, key, "bz", "by", "bx").groupBy(key, "bz", "by", "bx").agg(F.sum(F.col("x1") - F.col("x0") + 1).alias("voxels")))  # a cell of a coarser grid is made of these
    n, plan = cells.count(), None
    grid = first
    while grid >= last:
        factor = grid // last
        up = lambda n: [F.floor(F.col(f"b{a}") / n).cast("long") for a in AXES]
        at = F.struct("bz", "by", "bx")
        if grid == first:  # the parent of all cells of a key is the key
            moved = cells.select(key, *(v.alias(f"b{a}") for a, v in zip(AXES, up(factor))), "voxels")
            own = settle(dealt(moved, key, "bz", "by", "bx", n=n).groupBy(F.struct(key).alias("_k"), "bz", "by", "bx").agg(F.sum("voxels").alias("voxels")))
            whole = own.groupBy("_k").agg(F.sum("voxels").alias("parent_voxels"), F.max(at).alias("_last"))
            rows = _spread_join(own, whole, "_k").select(f"_k.{key}", F.lit(grid).alias("grid"), "bz", "by", "bx", "voxels", "parent_voxels", (at == F.col("_last")).alias("remains"))
        else:
            parent = [f"_p{a}" for a in AXES]
            moved = cells.select(key, *(v.alias(p) for p, v in zip(parent, up(2 * factor))), *(v.alias(f"b{a}") for a, v in zip(AXES, up(factor))), "voxels")
            own = dealt(moved, key, *parent, n=n).groupBy(key, *parent, "bz", "by", "bx").agg(F.sum("voxels").alias("voxels"))
            whole = Window.partitionBy(key, *parent)  # 8 cells at most
            rows = own.select(key, F.lit(grid).alias("grid"), "bz", "by", "bx", "voxels", F.sum("voxels").over(whole).alias("parent_voxels"), (at == F.max(at).over(whole)).alias("remains"))
        plan = rows if plan is None else plan.unionByName(rows)
        grid //= 2
    return plan


def ball_runs(points: DataFrame, keys: list[str], radius: str = "radius") -> DataFrame:
    """(keys, z, y, x0, x1) of balls: voxels whose centres are no farther than the radius (a whole number) from a point's."""
    r = F.col(radius)
    rows = points.where(r >= 0).select("*", F.explode(F.sequence(-r, r)).alias("_dz")).select("*", F.explode(F.sequence(-r, r)).alias("_dy"))
    left = r * r - F.col("_dz") * F.col("_dz") - F.col("_dy") * F.col("_dy")
    half = F.floor(F.sqrt(left.cast("double"))).cast("long")
    return rows.where(left >= 0).select(*keys, (F.col("z") + F.col("_dz")).alias("z"), (F.col("y") + F.col("_dy")).alias("y"), (F.col("x") - half).alias("x0"), (F.col("x") + half).alias("x1"))


def placed_balls(points: DataFrame, box: tuple[tuple[int, int, int], tuple[int, int, int]], order: str, label: str = "label") -> DataFrame:
    """Voxels (z, y, x, label) of balls around points (z, y, x, radius, label) within a box; of balls that overlap the last by the order stays."""
    runs = ball_runs(points, [label, order])
    for a, lo, hi in zip(AXES[:2], box[0], box[1]):
        runs = runs.where((F.col(a) >= lo) & (F.col(a) < hi))
    x0, x1 = F.greatest(F.col("x0"), F.lit(box[0][2])), F.least(F.col("x1"), F.lit(box[1][2] - 1))
    cut = runs.select(label, order, "z", "y", x0.alias("x0"), x1.alias("x1")).where("x0 <= x1")
    return cut.select(label, order, "z", "y", F.explode(F.sequence("x0", "x1")).alias("x")).groupBy(*AXES).agg(F.max_by(label, F.struct(order, label)).alias(label))


def box_dilated(voxels: DataFrame, radius: int, box: tuple[tuple[int, int, int], tuple[int, int, int]], label: str = "label") -> DataFrame:
    """Each voxel of a box takes the greatest label within a cube around it; label 0 and voxels without one don't grow.

    The axes follow one another, so a voxel is copied three times the cube's side, not its volume.
    """
    rows = voxels.where(F.col(label) != 0).select(*AXES, label)
    for a, lo, hi in zip(AXES, *box):
        near = F.explode(F.sequence(F.greatest(F.col(a) - radius, F.lit(lo)), F.least(F.col(a) + radius, F.lit(hi - 1))))
        others = [b for b in AXES if b != a]
        rows = rows.where((F.col(a) >= lo) & (F.col(a) < hi)).select(*others, label, near.alias(a)).groupBy(*AXES).agg(F.max(label).alias(label))
    return rows.select(*AXES, label)


def normalized(df: DataFrame, value: str, most: int | None = None) -> DataFrame:
    """Values moved and scaled to 0..1, or to whole numbers from 0 to most; all 0 where values don't differ, null stays."""
    ends = df.agg(F.min(value).cast("double").alias("_lo"), F.max(value).cast("double").alias("_hi"))
    share = F.coalesce(F.try_divide(F.col(value).cast("double") - F.col("_lo"), F.col("_hi") - F.col("_lo")), F.when(F.col(value).isNotNull(), F.lit(0.0)))
    scaled = share if most is None else F.floor(share * most).cast("long")
    return df.crossJoin(F.broadcast(ends)).withColumn(value, scaled).drop("_lo", "_hi")  # one row


def _chosen(side: int):
    """Of a cube's places (codes: 8 times the place in scan order, and a face) the one that halving leads to, towards the octant with the most; ties to the first in scan order."""

    def one(codes: np.ndarray) -> int:
        codes = np.sort(codes)
        at, half = codes >> 3, side
        z, y, x = at // (side * side), at // side % side, at % side
        while half > 1 and len(codes) > 1:
            half //= 2
            octant = (z // half % 2) * 4 + (y // half % 2) * 2 + x // half % 2
            own = octant == np.bincount(octant, minlength=8).argmax()
            codes, z, y, x = codes[own], z[own], y[own], x[own]
        return int(codes[0])

    @F.pandas_udf("long")
    def choose(codes: pd.Series) -> pd.Series:
        return pd.Series([one(np.asarray(v, np.int64)) for v in codes], dtype="int64")

    return choose


def contact_points(tasks: DataFrame, voxels: DataFrame, scales: int = 3, radius: int = 64) -> DataFrame:
    """(task, status, z1, y1, x1, z2, y2, x2): for each task (task, label_1, label_2, z1.. x2) two points where its labels meet.

    At each scale, from the full image to 2**scales, a cube of the radius around the points' middle is searched
    for voxels of label_2 with a face of label_1; the first scale with any counts. Halving the cube towards the
    octant with most of them gives the second point, its first neighbour of label_1 in scan order the first. Status
    is adjusted-at-scale-N, or misplaced, where points stay. The radius is a power of 2. Image voxels are (z, y, x,
    label); a task gathers one number a meeting voxel of its cube, and labels meet tasks by blocks, so that large labels are spread.
    """
    side = 2 * radius
    if side & (side - 1):
        raise ValueError("the radius must be a power of 2")
    open_, found, image = settle(tasks.select("task", "label_1", "label_2", *(f"{a}{k}" for k in (1, 2) for a in AXES))), None, voxels.where("label != 0").select(*AXES, "label")
    for scale in range(scales + 1):
        if scale:
            image = settle(downsample(image))
        low = [F.floor(F.floor((F.col(f"{a}1") + F.col(f"{a}2")) / 2) / (1 << scale)).cast("long") - radius for a in AXES]
        boxes = open_.select("task", "label_1", "label_2", *(v.alias(f"l{a}") for a, v in zip(AXES, low)))
        for a in AXES:
            boxes = boxes.withColumn(f"c{a}", F.explode(F.sequence(F.floor(F.col(f"l{a}") / side).cast("long"), F.floor((F.col(f"l{a}") + side - 1) / side).cast("long"))))
        cells = image.select("label", *(F.col(a).cast("long").alias(a) for a in AXES), *(F.floor(F.col(a) / side).cast("long").alias(f"c{a}") for a in AXES))

        def within(name: str) -> DataFrame:
            own = boxes.select("task", F.col(name).alias("label"), *(f"l{a}" for a in AXES), *(f"c{a}" for a in AXES))
            hit = cells.join(own.hint("merge"), ["label", "cz", "cy", "cx"])  # a small file of tasks makes many rows: no broadcast
            for a in AXES:
                hit = hit.where((F.col(a) >= F.col(f"l{a}")) & (F.col(a) < F.col(f"l{a}") + side))
            return hit.select("task", *AXES, *(f"l{a}" for a in AXES))

        def moved(k: int, d: tuple[int, int, int]) -> Column:
            """The voxel that has this one as its k-th neighbour."""
            return F.struct(*((F.col(a) - v).alias(a) for a, v in zip(AXES, d)), F.lit(k).alias("face"))

        ones = within("label_1").select("task", F.inline(F.array(*(moved(k, d) for k, d in enumerate(_FACES)))))
        first = ones.groupBy("task", *AXES).agg(F.min("face").alias("face"))
        meet = within("label_2").join(first.hint("merge"), ["task", *AXES])
        place = ((F.col("z") - F.col("lz")) * side + F.col("y") - F.col("ly")) * side + F.col("x") - F.col("lx")
        best = meet.groupBy("task", "lz", "ly", "lx").agg(F.collect_list(8 * place + F.col("face")).alias("codes")).withColumn("code", _chosen(side)("codes"))
        face, at = F.col("code") % 8, F.floor(F.col("code") / 8).cast("long")
        second = dict(zip(AXES, (F.floor(at / (side * side)).cast("long"), F.floor(at / side).cast("long") % side, at % side)))
        offset = {a: F.element_at(F.array(*(F.lit(d[n]) for d in _FACES)), (face + 1).cast("int")) for n, a in enumerate(AXES)}
        two = {a: F.col(f"l{a}") + second[a] for a in AXES}
        got = best.select("task", *((two[a] + offset[a]).alias(f"{a}1") for a in AXES), *(two[a].alias(f"{a}2") for a in AXES))
        up = got.select("task", F.lit(f"adjusted-at-scale-{scale}").alias("status"), *((F.col(f"{a}{k}") * (1 << scale)).alias(f"{a}{k}") for k in (1, 2) for a in AXES))
        up = settle(up)
        found = up if found is None else found.unionByName(up)
        open_ = settle(open_.join(up.select("task").hint("merge"), "task", "left_anti"))
    rest = open_.select("task", F.lit("misplaced").alias("status"), *(F.col(f"{a}{k}").cast("long").alias(f"{a}{k}") for k in (1, 2) for a in AXES))
    return found.unionByName(rest)
