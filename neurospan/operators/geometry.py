"""Run-length geometry: runs (z, y, x0, x1) with x1 included, voxels (z, y, x), and regions made of runs of blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

AXES = ("z", "y", "x")
ROWS = 1_000_000  # of a task that sorts or groups voxels


def dealt(rows: DataFrame, *by: str, n: int | None = None) -> DataFrame:
    """Rows with those of like columns in one task, so many tasks that each has about ROWS: its memory doesn't grow with the table. n: how many rows there are, counted if not given."""
    n = rows.count() if n is None else n
    return rows.repartition(max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n // ROWS)), *by)


def encode_runs(voxels: DataFrame, keys: list[str] | None = None, line: tuple[str, ...] = ("z", "y"), x: str = "x") -> DataFrame:
    """Runs of each line's voxels; repeated voxels count once."""
    by = [*(keys or []), *line]
    w = Window.partitionBy("_h", *by).orderBy(x)
    marked = dealt(voxels.withColumn("_h", F.xxhash64(*by)), "_h").withColumn("_island", F.col(x) - F.dense_rank().over(w))
    return marked.groupBy("_h", *by, "_island").agg(F.min(x).alias("x0"), F.max(x).alias("x1")).drop("_h", "_island")


def decode_runs(runs: DataFrame) -> DataFrame:
    keep = [c for c in runs.columns if c not in ("x0", "x1")]
    return runs.where("x1 >= x0").select(*keep, F.explode(F.sequence("x0", "x1")).alias("x"))


def run_lengths(runs: DataFrame) -> DataFrame:
    """Starts and lengths in place of starts and stops."""
    keep = [c for c in runs.columns if c not in ("x0", "x1")]
    return runs.select(*keep, F.col("x0").alias("x"), (F.col("x1") - F.col("x0") + 1).alias("length"))


def from_lengths(lengths: DataFrame) -> DataFrame:
    keep = [c for c in lengths.columns if c not in ("x", "length")]
    return lengths.select(*keep, F.col("x").alias("x0"), (F.col("x") + F.col("length") - 1).alias("x1"))


def upsample_runs(runs: DataFrame) -> DataFrame:
    """Runs at twice the resolution."""
    keep = [c for c in runs.columns if c not in ("z", "y", "x0", "x1")]
    offsets = F.explode(F.array(*(F.struct(F.lit(a).alias("dz"), F.lit(b).alias("dy")) for a in (0, 1) for b in (0, 1))))
    return runs.withColumn("_o", offsets).select(*keep, (2 * F.col("z") + F.col("_o.dz")).alias("z"), (2 * F.col("y") + F.col("_o.dy")).alias("y"), (2 * F.col("x0")).alias("x0"), (2 * F.col("x1") + 1).alias("x1"))


def merge_runs(runs: DataFrame, keys: list[str] | None = None, n: int | None = None) -> DataFrame:
    """Runs of a line joined where they overlap or touch. n: how many runs there are; without it they are written and counted."""
    from .graph import settle

    by = [*(keys or []), "z", "y"]
    runs = dealt((settle(runs) if n is None else runs).withColumn("_h", F.xxhash64(*by)), "_h", n=n)
    w = Window.partitionBy("_h", *by).orderBy("x0", "x1")
    reach = F.max("x1").over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = runs.withColumn("_new", (F.coalesce(F.col("x0") > reach + 1, F.lit(True))).cast("int")).withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy("_h", *by, "_island").agg(F.min("x0").alias("x0"), F.max("x1").alias("x1")).drop("_h", "_island")


def dilate_runs(runs: DataFrame, radius: int, keys: list[str] | None = None) -> DataFrame:
    """Runs grown by a box of the radius."""
    from .graph import settle

    span, runs = F.sequence(F.lit(-radius), F.lit(radius)), settle(runs)
    grown = runs.withColumn("_dz", F.explode(span)).withColumn("_dy", F.explode(span))
    return merge_runs(grown.select(*(keys or []), (F.col("z") + F.col("_dz")).alias("z"), (F.col("y") + F.col("_dy")).alias("y"), (F.col("x0") - radius).alias("x0"), (F.col("x1") + radius).alias("x1")), keys, runs.count() * (2 * radius + 1) ** 2)


def split_runs(runs: DataFrame, grid: int, halo: int = 0) -> DataFrame:
    """Runs cut where blocks of the grid (z, y and x alike) meet, with the block's bz, by, bx; a halo gives a block its neighbours' rim too."""
    cell = lambda c: F.floor(c.cast("double") / F.lit(float(grid))).cast("long")
    keep = [c for c in runs.columns if c not in ("x0", "x1")]
    cut = runs
    for a, lo, hi in (("bz", F.col("z"), F.col("z")), ("by", F.col("y"), F.col("y")), ("bx", F.col("x0"), F.col("x1"))):
        cut = cut.withColumn(a, F.explode(F.sequence(cell(lo - halo), cell(hi + halo))))
    x0, x1 = F.greatest(F.col("x0"), F.col("bx") * grid - halo), F.least(F.col("x1"), F.col("bx") * grid + grid - 1 + halo)
    return cut.select(*keep, "bz", "by", "bx", x0.alias("x0"), x1.alias("x1")).where("x1 >= x0")


def runs_box(runs: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Box of runs, stops outside."""
    aggs = [F.min("z").alias("z0"), F.min("y").alias("y0"), F.min("x0").alias("x0"), (F.max("z") + 1).alias("z1"), (F.max("y") + 1).alias("y1"), (F.max("x1") + 1).alias("x1")]
    return runs.groupBy(*(keys or [])).agg(*aggs)


def region_sizes(regions: DataFrame) -> DataFrame:
    """(roi, blocks)."""
    return regions.groupBy("roi").agg(F.sum(F.col("x1") - F.col("x0") + 1).alias("blocks"))


def region_blocks(regions: DataFrame) -> DataFrame:
    return decode_runs(regions)


def _dealt_blocks(regions: DataFrame) -> DataFrame:
    """Blocks of regions, those of like place in one task."""
    from .graph import settle

    runs = settle(regions)
    n = runs.where("x1 >= x0").agg(F.coalesce(F.sum(F.col("x1") - F.col("x0") + 1), F.lit(0)).alias("n")).first()["n"]
    return dealt(region_blocks(runs), *AXES, n=n)


def points_in_regions(points: DataFrame, regions: DataFrame, log2: int = 5, order: str = "roi", none: str = "<unspecified>") -> DataFrame:
    """Adds roi to points: the region of the point's block, the last in the order where several overlap."""
    blocks = _dealt_blocks(regions).groupBy("z", "y", "x").agg(F.max_by("roi", order).alias("roi"))
    keyed = points.withColumns({f"_{a}": F.shiftright(F.col(a), log2) for a in AXES})
    renamed = blocks.select(*(F.col(a).alias(f"_{a}") for a in AXES), "roi")
    return keyed.join(renamed, [f"_{a}" for a in AXES], "left").withColumn("roi", F.coalesce("roi", F.lit(none))).drop(*(f"_{a}" for a in AXES))


def region_overlaps(regions: DataFrame) -> DataFrame:
    """(roi_a, roi_b, blocks) of regions that share blocks."""
    b = _dealt_blocks(regions).select("z", "y", "x", "roi").distinct()
    other = b.withColumnRenamed("roi", "roi_b")
    return b.withColumnRenamed("roi", "roi_a").join(other, ["z", "y", "x"]).where("roi_a < roi_b").groupBy("roi_a", "roi_b").agg(F.count("*").alias("blocks"))


def combined_regions(regions: DataFrame, joint: bool = False) -> DataFrame:
    """One region a block: the last by name, or with joint the names of all, joined by +."""
    blocks = _dealt_blocks(regions)
    name = F.array_join(F.array_sort(F.collect_set("roi")), "+") if joint else F.max("roi")
    return blocks.groupBy("z", "y", "x").agg(name.alias("roi"))


def in_intervals(points: DataFrame, intervals: DataFrame, value: str, lo: str, hi: str, width: int) -> DataFrame:
    """Range join: points whose value lies in [lo, hi] of an interval. Intervals meet points by buckets of the width."""
    bucket = lambda c: F.floor(F.col(c).cast("double") / F.lit(float(width))).cast("long")
    wide = intervals.withColumn("_b", F.explode(F.sequence(bucket(lo), bucket(hi))))
    return points.withColumn("_b", bucket(value)).join(wide, "_b").where((F.col(value) >= F.col(lo)) & (F.col(value) <= F.col(hi))).drop("_b")


def sample_of_runs(runs: DataFrame, keys: list[str], per_key: int, seed: int = 0) -> DataFrame:
    """Voxels drawn from each key's runs, uniform over its voxels: numbers below its size, found by running sums."""
    size = (F.col("x1") - F.col("x0") + 1).cast("long")
    w = Window.partitionBy(*keys).orderBy("z", "y", "x0").rowsBetween(Window.unboundedPreceding, 0)
    placed = runs.withColumn("_stop", F.sum(size).over(w)).withColumn("_start", F.col("_stop") - size)
    totals = runs.groupBy(*keys).agg(F.sum(size).alias("_n"))
    drawn = totals.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(per_key - 1)))).withColumn("_at", F.pmod(F.xxhash64(*keys, F.col("draw"), F.lit(seed)), F.col("_n")))
    hit = drawn.join(placed, keys).where((F.col("_at") >= F.col("_start")) & (F.col("_at") < F.col("_stop")))
    return hit.select(*keys, "draw", "z", "y", (F.col("x0") + F.col("_at") - F.col("_start")).alias("x"))


def middle_voxel(voxels: DataFrame, label: str = "label") -> DataFrame:
    """The voxel in the middle of each label's scan order."""
    w = Window.partitionBy(label)
    ranked = voxels.withColumn("_n", F.count("*").over(w)).withColumn("_r", F.row_number().over(w.orderBy("z", "y", "x")))
    return ranked.where(F.col("_r") == F.floor(F.col("_n") / 2) + 1).drop("_n", "_r")


def first_voxel(voxels: DataFrame, label: str = "label") -> DataFrame:
    """The first voxel of each label in scan order."""
    return voxels.where(F.col(label) != 0).groupBy(label).agg(F.min(F.struct(*AXES)).alias("p")).select(label, "p.*")


def region_boxes(voxels: DataFrame, label: str = "label") -> DataFrame:
    aggs = [F.min(a).alias(f"{a}0") for a in AXES] + [(F.max(a) + 1).alias(f"{a}1") for a in AXES]
    return voxels.groupBy(label).agg(*aggs)


def region_centroids(voxels: DataFrame, label: str = "label") -> DataFrame:
    return voxels.groupBy(label).agg(*(F.avg(a).alias(a) for a in AXES), F.count("*").alias("size"))


def region_features(voxels: DataFrame, label: str = "label", value: str | None = None) -> DataFrame:
    """Box, size, centre, and of a value its least, greatest, mean and moments."""
    aggs = [F.count("*").alias("size"), *(F.avg(a).alias(f"center_{a}") for a in AXES), *(F.min(a).alias(f"{a}0") for a in AXES), *((F.max(a) + 1).alias(f"{a}1") for a in AXES)]
    if value:
        aggs += [F.min(value).alias("least"), F.max(value).alias("greatest"), F.avg(value).alias("mean"), F.var_pop(value).alias("variance"), F.skewness(value).alias("skewness"), F.kurtosis(value).alias("kurtosis")]
    return voxels.groupBy(label).agg(*aggs)


def inner_coordinates(voxels: DataFrame, label: str = "label") -> DataFrame:
    """The voxel of each label nearest its centroid, ties in scan order."""
    c = region_centroids(voxels, label).select(label, *(F.col(a).alias(f"_{a}") for a in AXES))
    d = sum((F.pow(F.col(a) - F.col(f"_{a}"), 2) for a in AXES), F.lit(0.0))
    near = voxels.join(c, label).groupBy(label).agg(F.min(F.struct(d.alias("d"), *AXES)).alias("m"))
    return near.select(label, *(F.col(f"m.{a}").alias(a) for a in AXES))


def contingency(left: DataFrame, right: DataFrame, place: list[str], zeros: bool = False) -> DataFrame:
    """(left, right, n): how many places carry each pair of labels, largest first."""
    both = left.select(*place, F.col("label").alias("left")).join(right.select(*place, F.col("label").alias("right")), place)
    both = both if zeros else both.where("left != 0 AND right != 0")
    return both.groupBy("left", "right").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "left", "right")


def match_overlaps(pairs: DataFrame, least: int = 1, min_jaccard: float = 0.0, crossover: str = "include", favorites: str = "all") -> DataFrame:
    """Overlap edges of two label images (left, right, n).

    crossover: include identities, exclude-identities drops pairs of equal ids, exclude-all every id that
    has an identity. favorites: all, any (best of one side), mutual. Ties go to lower ids.
    """
    size = lambda s: pairs.groupBy(s).agg(F.sum("n").alias(f"size_{s}"))
    rows = pairs.join(size("left"), "left").join(size("right"), "right").withColumn("jaccard", F.col("n") / (F.col("size_left") + F.col("size_right") - F.col("n")))
    rows = rows.where((F.col("n") >= least) & (F.col("jaccard") >= min_jaccard))
    if crossover == "exclude-identities":
        rows = rows.where("left != right")
    elif crossover == "exclude-all":
        same = rows.where("left = right").select("left")
        rows = rows.join(same, "left", "left_anti").join(same.withColumnRenamed("left", "right"), "right", "left_anti")
    if favorites != "all":
        rank = lambda s, o: F.row_number().over(Window.partitionBy(s).orderBy(F.desc("n"), o)) == 1
        rows = rows.withColumn("_l", rank("left", "right")).withColumn("_r", rank("right", "left"))
        rows = rows.where(F.col("_l") & F.col("_r") if favorites == "mutual" else F.col("_l") | F.col("_r")).drop("_l", "_r")
    return rows.select("left", "right", "n", "jaccard")


def block_stats(voxels: DataFrame, log2: int = 6, label: str = "label") -> DataFrame:
    """(label, z, y, x, n): voxels of a label in a block, whose first voxel names it; label 0 is left out."""
    first = [F.shiftleft(F.shiftright(F.col(a), log2), log2).alias(a) for a in AXES]
    return voxels.where(F.col(label) != 0).select(label, *first).groupBy(label, *AXES).agg(F.count("*").alias("n"))


def adjacencies(voxels: DataFrame, label: str = "label") -> DataFrame:
    """(a, b, area): faces between voxels of two labels, a < b, none 0."""
    v = voxels.select(*AXES, F.col(label).alias("a")).where("a != 0")
    shifts = F.explode(F.array(*(F.struct(*(F.lit(int(i == k)).alias(f"d{a}") for i, a in enumerate(AXES))) for k in range(3))))
    moved = v.withColumn("_s", shifts).select(*((F.col(a) - F.col(f"_s.d{a}")).alias(a) for a in AXES), F.col("a").alias("b"))
    both = v.join(moved, list(AXES)).where("a != b")
    return both.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.count("*").alias("area"))


def face_labels(voxels: DataFrame, box: dict[str, tuple[int, int]], label: str = "label") -> DataFrame:
    """Distinct labels on the faces of a box."""
    edge: Column = F.lit(False)
    for a in AXES:
        edge = edge | (F.col(a) == box[a][0]) | (F.col(a) == box[a][1] - 1)
    return voxels.where(edge & (F.col(label) != 0)).select(label).distinct()


def points_to_labels(points: DataFrame, voxels: DataFrame, scale: int = 0, label: str = "label") -> DataFrame:
    """Adds the label of the voxel that each point is in at a scale; 0 outside."""
    v = voxels.select(*(F.col(a).alias(f"_{a}") for a in AXES), F.col(label).alias(label))
    keyed = points.withColumns({f"_{a}": F.shiftright(F.col(a), scale) for a in AXES})
    return keyed.join(v, [f"_{a}" for a in AXES], "left").withColumn(label, F.coalesce(label, F.lit(0))).drop(*(f"_{a}" for a in AXES))


def only_labels(voxels: DataFrame, labels: DataFrame, label: str = "label") -> DataFrame:
    """Voxels whose label isn't in the list become 0."""
    kept = labels.select(F.col(label).alias("_k")).distinct()
    return voxels.join(kept, voxels[label] == F.col("_k"), "left").withColumn(label, F.when(F.col("_k").isNotNull(), F.col(label)).otherwise(F.lit(0).cast(dict(voxels.dtypes)[label]))).drop("_k")


def downsample(voxels: DataFrame, label: str = "label") -> DataFrame:
    """Label of each 2x2x2 block: the most frequent, ties to the lower; 0 only where nothing else is."""
    half = voxels.select(*(F.shiftright(F.col(a), 1).alias(a) for a in AXES), label)
    n = half.groupBy(*AXES, label).agg(F.count("*").alias("n"))
    return n.groupBy(*AXES).agg(F.min_by(label, F.struct(F.col(label) == 0, -F.col("n"), F.col(label))).alias(label))


def region_distributions(block_counts: DataFrame, regions: DataFrame, log2: int = 5) -> DataFrame:
    """(body, roi, voxels) of block counts (body, z, y, x, n), by the region of each block's centre (64-voxel blocks)."""
    centred = block_counts.withColumns({a: F.col(a) + 32 for a in AXES})
    return points_in_regions(centred, regions, log2).groupBy("body", "roi").agg(F.sum("n").alias("voxels"))


def missing_adjacencies(labels_by_block: DataFrame) -> DataFrame:
    """(a, b, z, y, x): pairs of supervoxels of one body that meet in a block or in neighbouring ones. Input: (body, sv, bz, by, bx)."""
    offsets = F.explode(F.array(*(F.struct(F.lit(i).alias("dz"), F.lit(j).alias("dy"), F.lit(k).alias("dx")) for i in (0, 1) for j in (0, 1) for k in (0, 1))))
    near = labels_by_block.withColumn("_o", offsets).select("body", (F.col("bz") - F.col("_o.dz")).alias("bz"), (F.col("by") - F.col("_o.dy")).alias("by"), (F.col("bx") - F.col("_o.dx")).alias("bx"), F.col("sv").alias("b"))
    own = labels_by_block.withColumnRenamed("sv", "a")
    pairs = own.join(near, ["body", "bz", "by", "bx"]).where("a != b")
    return pairs.groupBy("body", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.min(F.struct("bz", "by", "bx")).alias("p")).select("body", "a", "b", F.col("p.bz").alias("z"), F.col("p.by").alias("y"), F.col("p.bx").alias("x"))
