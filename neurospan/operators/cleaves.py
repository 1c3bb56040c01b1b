"""Plans of many cleaves: bodies are halved at groups' borders again and again, so that N groups move N log N rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import settle


def plan_cleaves(index: DataFrame, groups: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(cleaves, result) that leave each group of supervoxels as a body of its own.

    index: (body, sv, ...), a row for each block in which a supervoxel lies; groups: (sv, group). Groups of
    a body are ordered by their number; a part of a body with several groups is cut at the border nearest
    to its middle row, its top going into a new body. A body that has other supervoxels besides is first
    rid of all groups together, in one cleave.

    cleaves: (body, level, path, n_groups, n_rows, part_rows, first_group, last_group): what a cleave takes
    away, from first to last group, of how many rows of how many. path tells the part that is cut: 'g' for the
    grouped part, then 't' or 'b' for the top or bottom of each cut; a body without other supervoxels starts
    with ''. Cleaves of a level don't depend on each other.
    result: (body, group, path): the part that each group ends as.

    Supervoxels that groups don't list stay. One that is listed twice takes its least group; nulls don't
    count. Levels are at most about twice the logarithm of a body's rows.
    """
    own = groups.where("sv IS NOT NULL AND `group` IS NOT NULL").groupBy("sv").agg(F.min("group").alias("group"))
    rows = index.where("body IS NOT NULL AND sv IS NOT NULL").groupBy("body", "sv").agg(F.count("*").alias("n"))
    met = rows.join(own, "sv", "left")
    sizes = met.groupBy("body", "group").agg(F.sum("n").alias("n"))
    total = sizes.groupBy("body").agg(F.sum("n").alias("all"), F.max(F.when(F.col("group").isNull(), 1).otherwise(0)).alias("rest"))
    w = Window.partitionBy("body").orderBy("group").rowsBetween(Window.unboundedPreceding, -1)
    placed = sizes.where("`group` IS NOT NULL").withColumn("start", F.coalesce(F.sum("n").over(w), F.lit(0))).join(total, "body")
    first = F.when(F.col("rest") == 1, "g").otherwise("")
    parts = settle(placed.select("body", "group", "start", "n", "all", "rest", first.alias("path")))
    each = [F.count("*").alias("n_groups"), F.sum("n").alias("n_rows"), F.min("group").alias("first_group"), F.max("group").alias("last_group")]
    names = ["body", "level", "path", "n_groups", "n_rows", "part_rows", "first_group", "last_group"]
    cleaves = parts.where("rest = 1").groupBy("body", F.col("all").alias("part_rows")).agg(*each).withColumns({"level": F.lit(0), "path": F.lit("")}).select(*names)
    done, level = None, 0
    while True:
        level += 1
        part = Window.partitionBy("body", "path")
        low, size, count = F.min("start").over(part), F.sum("n").over(part), F.count("*").over(part)
        seen = parts.withColumns({"at": F.col("start") - low, "size": size, "count": count})
        ended = seen.where("count = 1").select("body", "group", "path")
        done = ended if done is None else done.unionByName(ended)
        going = seen.where("count > 1").withColumn("half", F.floor(F.col("size") / 2))
        above = F.max(F.when(F.col("at") < F.col("half"), F.col("at"))).over(part)
        below = F.min(F.when(F.col("at") >= F.col("half"), F.col("at"))).over(part)
        cut = F.when(below.isNull(), above).when(above.isNull() | (above < F.col("size") - below), below).otherwise(above)
        told = settle(going.withColumn("cut", cut).withColumn("top", F.col("at") < F.col("cut")))
        if not told.limit(1).count():
            return settle(cleaves), settle(done)
        cleaves = cleaves.unionByName(told.where("top").groupBy("body", "path", F.col("size").alias("part_rows")).agg(*each).withColumn("level", F.lit(level)).select(*names))
        parts = told.select("body", "group", "start", "n", "all", "rest", F.concat("path", F.when(F.col("top"), "t").otherwise("b")).alias("path"))


def moved_rows(cleaves: DataFrame) -> DataFrame:
    """(body, cleaves, levels, rows): how many rows the parts have that are rewritten."""
    return cleaves.groupBy("body").agg(F.count("*").alias("cleaves"), F.max("level").cast("long").alias("levels"), F.sum("part_rows").alias("rows"))
