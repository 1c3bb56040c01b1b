"""Helpers on tables of any content. Order-dependent choices take explicit order columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keep_one(df: DataFrame, keys: list[str], order: list, last: bool = False) -> DataFrame:
    """The first (or last) row of each key in an order; nulls are keys too."""
    cols = [F.col(o) if isinstance(o, str) else o for o in order]
    w = Window.partitionBy(*keys).orderBy(*(c.desc() if last else c.asc() for c in cols))
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def unordered_key(columns: list[str]) -> Column:
    return F.array_sort(F.array(*columns))


def unordered_duplicated(df: DataFrame, columns: list[str], order: list[str], keep: str | None = "first") -> DataFrame:
    """Adds duplicated: rows that repeat others' values in any order; keep first, last, or (None) mark all of them."""
    key = unordered_key(columns)
    w = Window.partitionBy(key)
    if keep is None:
        return df.withColumn("duplicated", F.count("*").over(w) > 1)
    ranked = w.orderBy(*(F.col(o).desc() if keep == "last" else F.col(o).asc() for o in order))
    return df.withColumn("duplicated", F.row_number().over(ranked) > 1)


def drop_unordered_duplicates(df: DataFrame, columns: list[str], order: list[str], keep: str | None = "first") -> DataFrame:
    return unordered_duplicated(df, columns, order, keep).where(~F.col("duplicated")).drop("duplicated")


def swap_columns(df: DataFrame, where: Column, pairs: list[tuple[str, str]]) -> DataFrame:
    """Swaps pairs of columns in rows that meet a condition (null: not)."""
    cond = F.coalesce(where, F.lit(False))
    new = {}
    for a, b in pairs:
        new[a], new[b] = F.when(cond, F.col(b)).otherwise(F.col(a)), F.when(cond, F.col(a)).otherwise(F.col(b))
    return df.select(*(new[c].alias(c) if c in new else F.col(f"`{c}`") for c in df.columns))


def suffixed_pairs(columns: list[str], suffixes: tuple[str, str] = ("_a", "_b")) -> list[tuple[str, str]]:
    """Pairs of columns that differ in their suffix alone."""
    a, b = suffixes
    return [(c, c[: -len(a)] + b) for c in columns if c.endswith(a) and c[: -len(a)] + b in columns]


def _ranged(df: DataFrame, order: list[str], buckets: int) -> DataFrame:
    """Rows with _bucket, the number of their range by all order columns. They are written, so that ranges stay as they are."""
    from .graph import settle

    n = buckets or max(8, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return settle(df.repartitionByRange(n, *order).withColumn("_bucket", F.spark_partition_id()))


def numbered(df: DataFrame, order: list[str], name: str = "n", buckets: int = 0) -> DataFrame:
    """Adds a dense row number from 0 in an order of any types, nulls first, without dealing all rows to one task.

    Ranges of the order columns are numbered apart; only their counts are summed in one place.
    """
    rows = _ranged(df, order, buckets)
    counts = rows.groupBy("_bucket").agg(F.count("*").alias("_c"))
    ahead = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("_bucket", F.coalesce(F.sum("_c").over(ahead), F.lit(0)).alias("_base"))
    own = Window.partitionBy("_bucket").orderBy(*order)
    return rows.withColumn("_own", F.row_number().over(own) - 1).join(F.broadcast(base), "_bucket").withColumn(name, (F.col("_own") + F.col("_base")).cast("long")).drop("_bucket", "_own", "_base")


def running_sum(df: DataFrame, order: list[str], values: dict[str, Column], buckets: int = 0) -> DataFrame:
    """Adds running sums over a global order by a two-level prefix sum: within ranges, and over ranges' totals."""
    rows = _ranged(df.withColumns({f"_v_{k}": v for k, v in values.items()}), order, buckets)
    totals = rows.groupBy("_bucket").agg(*(F.sum(f"_v_{k}").alias(f"_t_{k}") for k in values))
    ahead = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select("_bucket", *(F.coalesce(F.sum(f"_t_{k}").over(ahead), F.lit(0)).alias(f"_b_{k}") for k in values))
    own = Window.partitionBy("_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = rows.withColumns({f"_s_{k}": F.sum(f"_v_{k}").over(own) for k in values}).join(F.broadcast(base), "_bucket")
    return out.withColumns({k: F.col(f"_s_{k}") + F.col(f"_b_{k}") for k in values}).drop("_bucket", *(f"_{p}_{k}" for k in values for p in "vtsb"))


def chunks_of(df: DataFrame, order: list[str], size: int, name: str = "chunk") -> DataFrame:
    """Adds the number of a fixed-size chunk in an order; the last takes what is left."""
    return numbered(df, order, "_row").withColumn(name, F.floor(F.col("_row") / size)).drop("_row")


def is_sorted(df: DataFrame, order: list[str], keys: list[str], partition: list[str]) -> DataFrame:
    """(partition..., ordered): whether rows taken by order have ascending keys."""
    w = Window.partitionBy(*partition).orderBy(*order)
    step = F.lag(F.struct(*keys)).over(w)
    flagged = df.withColumn("_ok", step.isNull() | (step <= F.struct(*keys)))
    return flagged.groupBy(*partition).agg(F.bool_and("_ok").alias("ordered"))


def runs(df: DataFrame, partition: list[str], order: list[str], key: str) -> DataFrame:
    """Spans of equal keys in an order: partition columns, key, start and stop row (from 0, stop outside)."""
    w = Window.partitionBy(*partition).orderBy(*order)
    marked = df.withColumn("_row", F.row_number().over(w) - 1).withColumn("_new", F.coalesce((~F.col(key).eqNullSafe(F.lag(key).over(w))).cast("int"), F.lit(1)))
    marked = marked.withColumn("_new", F.when(F.col("_row") == 0, 1).otherwise(F.col("_new"))).withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(*partition, "_run", key).agg(F.min("_row").cast("long").alias("start"), (F.max("_row") + 1).cast("long").alias("stop")).drop("_run")


def top(df: DataFrame, count: str, key: str, n: int) -> DataFrame:
    """The n rows of highest count, ties by key."""
    return df.orderBy(F.desc(count), F.asc(key)).limit(n)


def page(df: DataFrame, count: str, key: str, threshold: int, offset: int, n: int) -> DataFrame:
    """A page of the rows whose count reaches a threshold, highest first."""
    return df.where(F.col(count) >= threshold).orderBy(F.desc(count), F.asc(key)).offset(offset).limit(n)


def task_batches(tasks: DataFrame, controls: DataFrame, key: str, size: int, per_batch: int, seed: int = 0) -> DataFrame:
    """Batches of tasks in the order of a seeded hash, each with per_batch shared control tasks in rotation."""
    order = tasks.withColumn("_h", F.xxhash64(F.col(key), F.lit(seed)))
    rows = chunks_of(order, ["_h", key], size, "batch").drop("_h")
    shared = numbered(controls.withColumn("_h", F.xxhash64(F.col(key), F.lit(seed + 1))), ["_h", key], "_k").drop("_h")
    n = shared.agg(F.count("*").alias("_n"))
    wanted = rows.select("batch").distinct().withColumn("_j", F.explode(F.sequence(F.lit(0), F.lit(per_batch - 1)))).crossJoin(F.broadcast(n)).where("_n > 0").withColumn("_k", F.pmod(F.col("batch") * per_batch + F.col("_j"), F.col("_n")))
    extra = wanted.join(shared, "_k").select(*(c for c in controls.columns), "batch")
    return rows.select(*tasks.columns, "batch", F.lit(False).alias("control")).unionByName(extra.select(*tasks.columns, "batch", F.lit(True).alias("control")))
