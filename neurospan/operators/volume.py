"""Label volumes as voxel rows (z, y, x, label): edges, components, islands, holes, distances, masks, modes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .geometry import dealt
from .graph import connected_components, settle
from .shapes import closest_approach  # noqa: F401
from .tables import numbered

AXES = ("z", "y", "x")
_FACES = [(1, 0, 0), (0, 1, 0), (0, 0, 1)]


def _moved(voxels: DataFrame, offsets: list[tuple[int, int, int]], name: str, label: str = "label") -> DataFrame:
    """Voxels as their neighbours see them."""
    o = F.explode(F.array(*(F.struct(*(F.lit(v).alias(f"d{a}") for a, v in zip(AXES, t))) for t in offsets)))
    return voxels.withColumn("_o", o).select(*((F.col(a) - F.col(f"_o.d{a}")).alias(a) for a in AXES), F.col(label).alias(name))


def voxel_id(z: Column, y: Column, x: Column) -> Column:
    from ..functions.coords import pack_point

    return pack_point(z, y, x)


def nonzero_box(voxels: DataFrame, label: str = "label") -> DataFrame:
    return voxels.where(F.col(label) != 0).agg(*(F.min(a).alias(f"{a}0") for a in AXES), *((F.max(a) + 1).alias(f"{a}1") for a in AXES))


def has_exterior(voxels: DataFrame, box: dict[str, tuple[int, int]], label: str = "label") -> DataFrame:
    """(exterior): whether a face of the box has a label."""
    on: Column = F.lit(False)
    for a in AXES:
        on = on | (F.col(a) == box[a][0]) | (F.col(a) == box[a][1] - 1)
    return voxels.agg(F.coalesce(F.bool_or(on & (F.col(label) != 0)), F.lit(False)).alias("exterior"))


def edges(voxels: DataFrame, mode: str = "both", label: str = "label") -> DataFrame:
    """Voxels next to another label (faces): before marks the lower side of a border, after the upper, both both. Voxels outside don't count."""
    ways = {"before": _FACES, "after": [tuple(-v for v in t) for t in _FACES]}
    offsets = ways[mode] if mode != "both" else ways["before"] + ways["after"]
    near = _moved(voxels, offsets, "_other", label)
    hit = voxels.join(near, list(AXES)).where(F.col(label) != F.col("_other")).select(*AXES).distinct()
    return voxels.join(hit, list(AXES), "left_semi")


def label_components(voxels: DataFrame, label: str = "label", corners: bool = False) -> DataFrame:
    """Adds component: the least packed voxel id of each label's piece, by faces or (corners) all 26 neighbours. Label 0 is left out."""
    v = voxels.where(F.col(label) != 0).withColumn("_id", voxel_id(F.col("z"), F.col("y"), F.col("x")))
    offsets = _FACES if not corners else [(i, j, k) for i in (0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1) if (i, j, k) > (0, 0, 0)]
    o = F.explode(F.array(*(F.struct(*(F.lit(t[n]).alias(f"d{a}") for n, a in enumerate(AXES))) for t in offsets)))
    shifted = v.withColumn("_o", o).select(*((F.col(a) - F.col(f"_o.d{a}")).alias(a) for a in AXES), label, F.col("_id").alias("b"))
    e = v.select(*AXES, label, F.col("_id").alias("a")).join(shifted, [*AXES, label]).select("a", "b")
    comp = connected_components(v.select(F.col("_id").alias("node")), e)
    return v.join(comp.withColumnRenamed("node", "_id"), "_id").drop("_id")


def erase_islands(voxels: DataFrame, label: str = "label") -> DataFrame:
    """Voxels of each label's largest piece keep it, the others become 0; ties to the lower piece."""
    comp = label_components(voxels, label)
    n = comp.groupBy(label, "component").agg(F.count("*").alias("n"))
    keep = n.withColumn("_r", F.row_number().over(Window.partitionBy(label).orderBy(F.desc("n"), "component"))).where("_r = 1").select("component", F.lit(True).alias("_keep"))
    marked = comp.join(keep, "component", "left").select(*AXES, F.when(F.col("_keep"), F.col(label)).otherwise(F.lit(0)).cast(dict(voxels.dtypes)[label]).alias(label))
    return marked.unionByName(voxels.where(F.col(label) == 0).select(*AXES, label))


def split_bodies(voxels: DataFrame, label: str = "label") -> tuple[DataFrame, DataFrame]:
    """Voxels in which each piece has a label of its own, the largest keeping the old one; and (new, old) of split labels."""
    comp = label_components(voxels, label)
    n = comp.groupBy(label, "component").agg(F.count("*").alias("n"))
    ranked = n.withColumn("_r", F.row_number().over(Window.partitionBy(label).orderBy(F.desc("n"), "component")))
    extra = ranked.where("_r > 1")
    top = voxels.agg(F.max(label).alias("_m"))
    rows = numbered(extra.select(label, "_r", "component"), [label, "_r"], "_k")  # one row a piece beyond the first of its label
    named = rows.crossJoin(F.broadcast(top)).select("component", (F.col("_m") + F.col("_k") + 1).alias("new"), F.col(label).alias("old"))
    out = comp.join(named, "component", "left").select(*AXES, F.coalesce("new", F.col(label)).alias(label))
    pieces = named.select("new", "old").union(named.select(F.col("old").alias("new"), "old")).distinct()
    return out, pieces


def fill_holes(mask: DataFrame, box: dict[str, tuple[int, int]]) -> DataFrame:
    """Voxels (z, y, x) of a mask with its cavities: what isn't joined by faces to the outside of its box."""
    cells = mask.sparkSession.range(box["z"][0] - 1, box["z"][1] + 1).select(F.col("id").cast("int").alias("z"))
    cells = cells.withColumn("y", F.explode(F.sequence(F.lit(box["y"][0] - 1), F.lit(box["y"][1])))).repartition("z", "y")  # lines, before they are cells
    cells = cells.withColumn("x", F.explode(F.sequence(F.lit(box["x"][0] - 1), F.lit(box["x"][1]))))
    empty = cells.select(*AXES).join(mask.select(*AXES), list(AXES), "left_anti").withColumn("label", F.lit(1))
    comp = label_components(empty)
    outside = comp.where(" AND ".join(f"{a} = {box[a][0] - 1}" for a in AXES)).select("component")  # the corner's one row
    return mask.select(*AXES).union(comp.join(F.broadcast(outside), "component", "left_anti").select(*AXES))


def mode_downsample(voxels: DataFrame, factor: int, ignore_zero: bool = False, label: str = "label") -> DataFrame:
    """The most frequent label of each block, ties to the lower; with ignore_zero 0 wins only where it is alone."""
    cell = [F.floor(F.col(a) / factor).cast("int").alias(a) for a in AXES]
    n = voxels.select(*cell, label).groupBy(*AXES, label).agg(F.count("*").alias("n"))
    first = F.struct((F.col(label) == 0) & F.lit(ignore_zero), -F.col("n"), F.col(label))
    return n.groupBy(*AXES).agg(F.min_by(label, first).alias(label))


def mask_downsample(mask: DataFrame, factor: int, how: str = "or") -> DataFrame:
    """Blocks of a mask of which any (or) or every (and) voxel is set."""
    cell = [F.floor(F.col(a) / factor).cast("int").alias(a) for a in AXES]
    voxels = dealt(mask.select(*AXES, F.xxhash64(*cell).alias("_h")), "_h")
    n = voxels.distinct().select("_h", *cell).groupBy("_h", *AXES).agg(F.count("*").alias("n"))
    return (n if how == "or" else n.where(F.col("n") == factor**3)).select(*AXES)


def upsample(voxels: DataFrame, factor: int, label: str = "label") -> DataFrame:
    out, span = voxels, F.sequence(F.lit(0), F.lit(factor - 1))
    for a in AXES:
        out = out.withColumn(f"_{a}", F.explode(span))
    return out.select(*((F.col(a) * factor + F.col(f"_{a}")).alias(a) for a in AXES), label)


def ellipsoid(spark, center: tuple[float, float, float], radii: tuple[float, float, float]) -> DataFrame:
    """Lattice points of an ellipsoid along the axes; equal radii give a sphere."""
    cells, d = spark.range(1), F.lit(0.0)
    for a, c, r in zip(AXES, center, radii):
        cells = cells.withColumn(a, F.explode(F.sequence(F.floor(F.lit(c - r)), F.ceil(F.lit(c + r)))))
        d = d + F.pow((F.col(a) - c) / r, 2)
    return cells.where(d <= 1).select(*(F.col(a).cast("int").alias(a) for a in AXES))


def principal_axes(voxels: DataFrame, label: str = "label") -> DataFrame:
    """(label, size, centre, covariances): what an ellipsoid is fitted from."""
    pairs = [(a, b) for i, a in enumerate(AXES) for b in AXES[i:]]
    return voxels.groupBy(label).agg(F.count("*").alias("size"), *(F.avg(a).alias(f"center_{a}") for a in AXES), *(F.covar_pop(a, b).alias(f"cov_{a}{b}") for a, b in pairs))


def nearest_voxel(voxels: DataFrame, points: DataFrame, label: str = "label") -> DataFrame:
    """(label, z, y, x): the voxel of each label nearest to its point (label, pz, py, px), ties in scan order."""
    d = sum((F.pow(F.col(a) - F.col(f"p{a}"), 2) for a in AXES), F.lit(0.0))
    near = voxels.join(points, label).groupBy(label).agg(F.min(F.struct(d.alias("d"), *AXES)).alias("m"))
    return near.select(label, *(F.col(f"m.{a}").alias(a) for a in AXES))


def distances(voxels: DataFrame, most: int, label: str = "label") -> DataFrame:
    """Adds distance: how many steps over faces a voxel is from another label, up to a bound (bound + 1 beyond)."""
    done = rim = settle(edges(voxels, "both", label).select(*AXES, F.lit(1).alias("distance")))
    offsets = _FACES + [tuple(-v for v in t) for t in _FACES]
    inside = voxels.select(*AXES, label)
    for k in range(2, most + 1):
        step = _moved(rim.withColumn("_l", F.lit(0)), offsets, "_l2", "_l").select(*AXES).distinct()
        rim = settle(inside.join(step, list(AXES), "left_semi").join(done, list(AXES), "left_anti").select(*AXES, F.lit(k).alias("distance")))
        done = done.unionByName(rim)
    return voxels.join(done, list(AXES), "left").withColumn("distance", F.coalesce("distance", F.lit(most + 1)))


def thickest_point(voxels: DataFrame, most: int, label: str = "label") -> DataFrame:
    """(label, z, y, x, distance): the voxel of each label farthest from its rim, ties in scan order."""
    far = distances(voxels, most, label).where(F.col(label) != 0).groupBy(label).agg(F.min(F.struct((-F.col("distance")).alias("d"), *AXES)).alias("m"))
    return far.select(label, *(F.col(f"m.{a}").alias(a) for a in AXES), (-F.col("m.d")).alias("distance"))


def mask_blocks(mask: DataFrame, log2: int = 6) -> DataFrame:
    """Blocks (bz, by, bx) that a mask touches."""
    return mask.select(*(F.shiftright(F.col(a), log2).alias(f"b{a}") for a in AXES)).distinct()


def brick_boxes(blocks: DataFrame, brick: int, resolution: int) -> DataFrame:
    """Tight boxes, in voxels, of the blocks within each brick of so many blocks."""
    keyed = blocks.select("*", *(F.floor(F.col(f"b{a}") / brick).alias(f"_k{a}") for a in AXES))
    out = keyed.groupBy(*(f"_k{a}" for a in AXES)).agg(*((F.min(f"b{a}") * resolution).alias(f"{a}0") for a in AXES), *(((F.max(f"b{a}") + 1) * resolution).alias(f"{a}1") for a in AXES))
    return out.drop(*(f"_k{a}" for a in AXES))
