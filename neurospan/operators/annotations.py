"""Viewer annotations (spatial levels, binary encodings, segment properties) and annotation tables by key."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.coords import morton


def spatial_grids(shape: list[float], levels: int, scales: list[float] | None = None) -> list[dict]:
    """Chunk and grid shapes of each level, from one chunk of the whole shape on.

    At each level the widest axis halves, and others that are more than three quarters as wide, so that chunks
    become nearly cubes; widths count in units of the axes' scales.
    """
    scales = scales or [1.0] * len(shape)
    chunk, grid = [float(s) * k for s, k in zip(shape, scales)], [1] * len(shape)
    out = []
    for _ in range(levels):
        out.append({"chunk": [c / k for c, k in zip(chunk, scales)], "grid": list(grid)})
        widest = chunk.index(max(chunk))
        halved = [i == widest or c > 0.75 * chunk[widest] for i, c in enumerate(chunk)]
        chunk = [c / 2 if h else c for c, h in zip(chunk, halved)]
        grid = [2 * g if h else g for g, h in zip(grid, halved)]
    return out


def level_quotas(n: int, grids: list[dict], per_chunk: int) -> list[int]:
    """How many annotations each level takes; the last takes the rest."""
    out, left = [], n
    for g in grids[:-1]:
        take = min(left, per_chunk * int(np.prod(g["grid"])))
        out.append(take)
        left -= take
    return [*out, left]


def assign_levels(points: DataFrame, lower: list[float], grids: list[dict], quotas: list[int], seed: int = 0) -> DataFrame:
    """Adds level and cell (a compressed Morton code) to points (id, z, y, x): a hash order fills one level after the other."""
    from .tables import numbered

    order = points.withColumn("_h", F.xxhash64("id", F.lit(seed)))
    rows, ends = numbered(order, ["_h", "id"], "_n"), np.cumsum(quotas).tolist()
    level = F.lit(len(ends) - 1)
    for k in reversed(range(len(ends) - 1)):
        level = F.when(F.col("_n") < ends[k], F.lit(k)).otherwise(level)
    cell: Column = F.lit(None).cast("long")
    for k, g in enumerate(grids):
        at = [F.least(F.floor((F.col(a) - lo) / c), F.lit(m - 1)) for a, lo, c, m in zip("zyx", lower, g["chunk"], g["grid"])]
        cell = F.when(F.col("level") == k, morton(at, g["grid"])).otherwise(cell)
    return rows.withColumn("level", level).withColumn("cell", cell).drop("_h", "_n")


def cells_of_boxes(boxes: DataFrame, lower: list[float], grid: dict) -> DataFrame:
    """One row for each cell of a level that a box (z0..x1) overlaps."""
    out = boxes
    for a, lo, c, m in zip("zyx", lower, grid["chunk"], grid["grid"]):
        first, last = F.greatest(F.floor((F.col(f"{a}0") - lo) / c), F.lit(0)), F.least(F.floor((F.col(f"{a}1") - lo) / c), F.lit(m - 1))
        out = out.withColumn(f"_{a}", F.explode(F.when(first <= last, F.sequence(first, last))))
    return out.withColumn("cell", morton(["_z", "_y", "_x"], grid["grid"]))


def cells_of_ellipsoids(shapes: DataFrame, lower: list[float], grid: dict) -> DataFrame:
    """Cells that an ellipsoid (centre z, y, x; radii rz, ry, rx) meets: the cell's nearest point lies inside."""
    boxes = shapes
    for a in "zyx":
        boxes = boxes.withColumn(f"{a}0", F.col(a) - F.col(f"r{a}")).withColumn(f"{a}1", F.col(a) + F.col(f"r{a}"))
    d = F.lit(0.0)
    for a, lo, c in zip("zyx", lower, grid["chunk"]):
        start = F.col(f"_{a}") * c + lo
        near = F.greatest(start, F.least(F.col(a), start + c))
        d = d + F.pow((near - F.col(a)) / F.col(f"r{a}"), 2)
    return cells_of_boxes(boxes, lower, grid).where(d <= 1)


def cells_of_lines(lines: DataFrame, lower: list[float], grid: dict) -> DataFrame:
    """Cells that a segment (za, ya, xa) to (zb, yb, xb) crosses: its spans within the cell on all axes overlap."""
    boxes = lines
    for a in "zyx":
        boxes = boxes.withColumn(f"{a}0", F.least(f"{a}a", f"{a}b")).withColumn(f"{a}1", F.greatest(f"{a}a", f"{a}b"))
    enter, leave = F.lit(0.0), F.lit(1.0)
    for a, lo, c in zip("zyx", lower, grid["chunk"]):
        start, step = F.col(f"_{a}") * c + lo, (F.col(f"{a}b") - F.col(f"{a}a")).cast("double")
        t0, t1 = F.try_divide(start - F.col(f"{a}a"), step), F.try_divide(start + c - F.col(f"{a}a"), step)
        enter, leave = F.greatest(enter, F.coalesce(F.least(t0, t1), F.lit(0.0))), F.least(leave, F.coalesce(F.greatest(t0, t1), F.lit(1.0)))
    return cells_of_boxes(boxes, lower, grid).where(enter <= leave)


def encode_points(rows: DataFrame, keys: list[str], props: dict[str, str] | None = None) -> DataFrame:
    """(keys..., n, data binary): each cell's annotations as count, positions with float32 properties, then ids, little-endian."""
    props = props or {}

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        cols = [pdf[c].to_numpy(np.float32) for c in ("x", "y", "z")] + [pdf[c].to_numpy(np.float32) for c in props]
        data = np.array([len(pdf)], "<u8").tobytes() + np.stack(cols, axis=1).astype("<f4").tobytes() + pdf["id"].to_numpy("<u8").tobytes()
        return pdf.iloc[:1][keys].assign(n=len(pdf), data=[data])

    kinds = dict(rows.dtypes)
    return rows.groupBy(*keys).applyInPandas(run, ", ".join([*(f"{k} {kinds[k]}" for k in keys), "n long", "data binary"]))


def decode_points(encoded: DataFrame, keys: list[str], props: list[str] | None = None) -> DataFrame:
    """Rows of encode_points()."""
    props, kinds = props or [], dict(encoded.dtypes)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for row in pdf.to_dict("records"):
                raw, width = bytes(row["data"]), 3 + len(props)
                n = int(np.frombuffer(raw, "<u8", 1)[0])
                cols = np.frombuffer(raw, "<f4", n * width, 8).reshape(n, width)
                ids = np.frombuffer(raw, "<u8", n, 8 + 4 * n * width)
                out = pd.DataFrame({k: [row[k]] * n for k in keys})
                yield out.assign(id=ids.astype(np.int64), x=cols[:, 0], y=cols[:, 1], z=cols[:, 2], **{p: cols[:, 3 + k] for k, p in enumerate(props)})

    schema = ", ".join([*(f"{k} {kinds[k]}" for k in keys), "id long, x float, y float, z float", *(f"{p} float" for p in props)])
    return encoded.mapInPandas(run, schema)


def relationship_index(rows: DataFrame, relation: str) -> DataFrame:
    """(segment, ids): annotations that each segment has part in."""
    return rows.where(F.col(relation).isNotNull()).groupBy(F.col(relation).alias("segment")).agg(F.array_sort(F.collect_set("id")).alias("ids"))


def tag_codes(segments: DataFrame, columns: list[str], prefix: bool = False) -> tuple[DataFrame, DataFrame]:
    """(segment, codes) and the dictionary (tag, code) of tag columns, tags in order. Tags that several columns have carry their column's name, with prefix all do; blanks become underscores."""
    kinds = dict(segments.dtypes)
    named = [F.struct(F.lit(c).alias("c"), (F.when(F.col(c), F.lit(c)) if kinds[c] == "boolean" else F.when(F.col(c) != "", F.translate(c, " ", "_"))).alias("t")) for c in columns]
    rows = segments.select("segment", F.inline(F.array(*named))).where("t IS NOT NULL")
    several = rows.select("c", "t").distinct().groupBy("t").agg((F.count("*") > 1).alias("many"))
    rows = rows.join(several, "t").select("segment", F.when(F.col("many") | F.lit(prefix), F.concat_ws(":", "c", "t")).otherwise(F.col("t")).alias("tag"))
    codes = rows.select("tag").distinct().withColumn("code", F.row_number().over(Window.orderBy("tag")) - 1)  # one row a distinct tag
    own = rows.join(codes, "tag").groupBy("segment").agg(F.array_sort(F.collect_set("code")).alias("codes"))
    return segments.select("segment").join(own, "segment", "left").withColumn("codes", F.coalesce("codes", F.array().cast("array<int>"))), codes


def property_document(segments: DataFrame, columns: list[str]) -> DataFrame:
    """(segment, doc): JSON of a segment's scalar properties, nulls left out."""
    return segments.select("segment", F.to_json(F.struct(*columns)).alias("doc"))


def update_plan(source: DataFrame, target: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Rows of the source that differ from the target in a given value; null values don't update."""
    t = target.select(key, *(F.col(c).alias(f"_{c}") for c in columns))
    both = source.join(t, key, "left")
    differ = F.lit(False)
    for c in columns:
        differ = differ | (F.col(c).isNotNull() & ~F.col(c).eqNullSafe(F.col(f"_{c}")))
    return both.where(differ).select(key, *(F.coalesce(F.col(c), F.col(f"_{c}")).alias(c) for c in columns))


def first_given(df: DataFrame, name: str, columns: list[str]) -> DataFrame:
    """The first value given among columns in order of priority."""
    return df.withColumn(name, F.coalesce(*(F.when(F.col(c).cast("string") != "", F.col(c)) for c in columns)))


def rank_of(column: str, levels: list[str]) -> Column:
    """Place of a status among levels, from 0; null if it isn't one."""
    at = F.array_position(F.array(*(F.lit(x) for x in levels)), F.coalesce(F.col(column), F.lit("")))
    return F.when(at > 0, (at - 1).cast("int"))


def upgrade_status(annotations: DataFrame, bodies: DataFrame, status: str, levels: list[str]) -> DataFrame:
    """Bodies of the list whose status ranks lower get the status."""
    hit = bodies.select("body").distinct().withColumn("_hit", F.lit(True))
    low = F.coalesce(rank_of("status", levels) < levels.index(status), F.lit(True))
    return annotations.join(hit, "body", "left").withColumn("status", F.when(F.col("_hit") & low, F.lit(status)).otherwise(F.col("status"))).drop("_hit")


def leave_one_out(vectors: DataFrame, group: str = "label", vector: str = "embedding", key: str = "vec_id", size: int = 64) -> DataFrame:
    """(key, group, similarity): cosine of each vector to the mean of its group's others. Sums go by position, so groups have any size."""
    from ..functions.scores import cosine

    v = lambda k: F.col(vector)[k].cast("double")
    sums = vectors.groupBy(group).agg(F.count("*").alias("_n"), F.array(*(F.sum(v(k)) for k in range(size))).alias("_s"))
    rows = vectors.join(sums, group).where("_n > 1")
    others = F.zip_with("_s", vector, lambda s, x: s - x.cast("double"))
    return rows.select(key, group, cosine(F.col(vector), others).alias("similarity"))
