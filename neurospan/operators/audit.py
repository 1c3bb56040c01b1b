"""Audit of a mutation log against the statuses that bodies had: merges that lose traced bodies, cleaves that take half of one.

events: (seq, version, action, target, merged array, cleaved, cleaved_size), seq in the log's order;
statuses: (version, body, status), what a version set; sizes: (body, size) before the log.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import settle, subtree_sums

# Statuses of traced bodies.
TRACED = ("Leaves", "Prelim Roughly traced", "Roughly traced", "Traced")


def statuses_before(asked: DataFrame, statuses: DataFrame) -> DataFrame:
    """(seq, body, status): of rows (seq, version, body) the body's status as the versions before left it; null if none set any.

    As-of join by one pass over both in order, so a body's events and statuses are never paired.
    """
    rows = asked.select("body", "version", F.lit(0).alias("_kind"), "seq", F.lit(None).cast("string").alias("status"), F.lit(None).cast("boolean").alias("_set"))
    told = statuses.groupBy("body", "version").agg(F.max("status").alias("status")).select("body", "version", F.lit(1).alias("_kind"), F.lit(None).cast("long").alias("seq"), "status", F.lit(True).alias("_set"))
    w = Window.partitionBy("body").orderBy("version", "_kind").rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(F.when(F.col("_set"), F.struct("status")), ignorenulls=True).over(w)
    both = rows.unionByName(told).withColumn("_last", last)
    return both.where("_kind = 0").select("seq", "body", F.col("_last.status").alias("status"))


def sizes_before(events: DataFrame, sizes: DataFrame) -> DataFrame:
    """(seq, size): the target's size before each merge and cleave, from sizes before the log; null where it can't be told.

    A merge brings the merged body's own size, what was merged into it before, less what was cleaved from it:
    sums over trees of merges. Bodies that cleaves made begin with what was cleaved.
    """
    merges = events.where("action = 'merge'").select("seq", "target", F.explode("merged").alias("body"))
    cleaves = events.where("action = 'cleave'").select("seq", "target", "cleaved", F.coalesce("cleaved_size", F.lit(0)).cast("long").alias("n"))
    made = cleaves.where("cleaved IS NOT NULL").select(F.col("cleaved").alias("body"), F.col("n").alias("size"))
    begun = sizes.where("size IS NOT NULL").select("body", F.col("size").cast("long").alias("size")).union(made).groupBy("body").agg(F.sum("size").alias("size"))
    begun = settle(begun)
    lost = cleaves.groupBy(F.col("target").alias("body")).agg(F.sum("n").alias("lost"))
    own = begun.join(lost, "body", "left").select(F.col("body").alias("node"), (F.col("size") - F.coalesce("lost", F.lit(0))).alias("value"))
    moved = subtree_sums(own, merges.select(F.col("body").alias("node"), F.col("target").alias("parent"))).select(F.col("node").alias("body"), "total")
    changes = merges.join(moved, "body").groupBy("seq", F.col("target").alias("body")).agg(F.sum("total").alias("change"))
    changes = changes.union(cleaves.select("seq", "target", -F.col("n"))).groupBy("seq", "body").agg(F.sum("change").alias("change"))
    before = Window.partitionBy("body").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    placed = changes.withColumn("before", F.coalesce(F.sum("change").over(before), F.lit(0)))
    return placed.join(begun, "body", "left").select("seq", (F.col("size") + F.col("before")).alias("size"))


def audit_traced(events: DataFrame, statuses: DataFrame, sizes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(bad merges, bad cleaves) of traced bodies.

    bad merges: (seq, reason, target, target_status, traced_bodies, traced_statuses): merges of traced bodies, with
    the reason merge-traced-to-traced or merge-traced-to-nontraced; bodies in ascending order.
    bad cleaves: (seq, reason, target, target_size, cleave_size): of a traced target; large-cleave if more than half of
    it goes, failed-to-assess if its size isn't known or 0. Bodies count by their status before the event's version;
    nulls are no status. An empty log gives no rows.
    """
    some = settle(events.where("seq IS NOT NULL AND target IS NOT NULL"))
    of_target = statuses_before(some.select("seq", "version", F.col("target").alias("body")), statuses).select("seq", F.col("status").alias("target_status"))
    each = some.where("action = 'merge'").select("seq", "version", F.explode(F.array_distinct("merged")).alias("body"))
    traced = statuses_before(each, statuses).where(F.col("status").isin(*TRACED))
    lists = traced.groupBy("seq").agg(F.array_sort(F.collect_list(F.struct("body", "status"))).alias("all"))
    met = some.select("seq", "target").join(lists, "seq").join(of_target, "seq")
    reason = F.when(F.col("target_status").isin(*TRACED), "merge-traced-to-traced").otherwise("merge-traced-to-nontraced")
    merges = met.select("seq", reason.alias("reason"), "target", "target_status", F.col("all.body").alias("traced_bodies"), F.col("all.status").alias("traced_statuses"))
    at = some.where("action = 'cleave'").join(of_target.where(F.col("target_status").isin(*TRACED)), "seq").join(sizes_before(some, sizes), "seq", "left")
    known, gone = F.coalesce("size", F.lit(0).cast("long")), F.coalesce("cleaved_size", F.lit(0)).cast("long")
    why = F.when(known == 0, "failed-to-assess").when(2 * gone > known, "large-cleave")
    cleaves = at.select("seq", why.alias("reason"), "target", known.alias("target_size"), F.when(known == 0, 0).otherwise(gone).alias("cleave_size")).where("reason IS NOT NULL")
    return merges, cleaves
