"""Statistics of organelles within bodies, and points drawn from bodies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .geometry import points_in_regions
from .graph import prune_close, settle

AXES = ("z", "y", "x")


def organelle_classes(voxels: DataFrame, empty: int = 0) -> DataFrame:
    """(body, organelle, class, n) of voxels (z, y, x, body, organelle, class); organelle 0 and the empty class are none."""
    rows = voxels.where(f"body IS NOT NULL AND organelle != 0 AND class != {empty}")
    return rows.groupBy("body", "organelle", "class").agg(F.count("*").alias("n"))


def organelle_stats(voxels: DataFrame, least: int = 0, radius: int = 50, empty: int = 0) -> DataFrame:
    """(body, organelle, z, y, x, total_size, classes map, centroid_type) of organelles with at least so many voxels.

    The centroid is that of the voxels within the body, cut to whole numbers. Where it isn't one of the
    organelle's voxels (of any body or class), it moves to the nearest of them within the radius along each axis,
    ties in scan order (adjusted); where there is none it stays (error).
    """
    rows = voxels.where(f"body IS NOT NULL AND organelle != 0 AND class != {empty}")
    classes = organelle_classes(voxels, empty).groupBy("body", "organelle").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("class", "n")))).alias("classes"), F.sum("n").alias("total_size"))  # a few classes each
    centre = rows.groupBy("body", "organelle").agg(*(F.avg(a).cast("long").alias(a) for a in AXES))
    stats = settle(classes.where(F.col("total_size") >= least).join(centre, ["body", "organelle"]))
    parts = voxels.where("organelle != 0").select("organelle", *(F.col(a).cast("long").alias(f"_{a}") for a in AXES))
    apart = [F.abs(F.col(f"_{a}") - F.col(a)) for a in AXES]
    d = apart[0] * apart[0] + apart[1] * apart[1] + apart[2] * apart[2]
    near = stats.select("body", "organelle", *AXES).join(parts, "organelle").where((apart[0] <= radius) & (apart[1] <= radius) & (apart[2] <= radius))
    best = near.groupBy("body", "organelle").agg(F.min(F.struct(d.alias("d"), *(f"_{a}" for a in AXES))).alias("at"))
    met = stats.join(best, ["body", "organelle"], "left")
    kind = F.when(F.col("at").isNull(), "error").when(F.col("at.d") == 0, "exact").otherwise("adjusted")
    return met.select("body", "organelle", *(F.coalesce(F.col(f"at._{a}"), F.col(a)).alias(a) for a in AXES), "total_size", "classes", kind.alias("centroid_type"))


def sampled_points(points: DataFrame, count: int | None, regions: DataFrame | None = None, roi: str | None = None, minimum_distance: float = 0.0, seed: int = 0, log2: int = 5) -> DataFrame:
    """points (id, z, y, x) drawn by a seeded hash of their ids: within a region, no two nearer than a distance, count at most.

    The same points are drawn however they are partitioned. Nearby points give way to those that come first by
    the hash, before any are counted, so as many as asked for are found if there are that many. Whether a point
    stays depends on those before it alone: only the points before a hash are looked at, and more if too few stay.
    """
    every = points.where("id IS NOT NULL AND z IS NOT NULL AND y IS NOT NULL AND x IS NOT NULL")
    h = F.xxhash64("id", F.lit(seed))

    def drawn(own: DataFrame) -> DataFrame:
        own = own.dropDuplicates(["id"])
        if roi is not None:
            own = points_in_regions(own.drop("roi"), regions, log2).where(F.col("roi") == roi).drop("roi")
        return prune_close(settle(own), minimum_distance, seed) if minimum_distance > 0 else own

    if count is None:
        return drawn(every)
    total, tries = every.count(), 4 * count
    while tries < total:
        got = settle(drawn(every.where(h < (tries << 64) // total - (1 << 63))))
        if got.count() >= count:
            return got.orderBy(h, "id").limit(count)
        tries *= 4
    return drawn(every).orderBy(h, "id").limit(count)
