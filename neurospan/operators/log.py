"""Mutation logs: parsing, filters, replay into affected bodies, and transactions. streaming.log has the streaming twins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.names import local_timestamp, log_timestamp
from .graph import ancestors
from .tables import keep_one

MESSAGE = "struct<Action:string,Target:long,Labels:array<long>,UUID:string,MutationID:long,User:string,Timestamp:string,OrigLabel:long,CleavedLabel:long,CleavedSupervoxels:array<long>,NewLabel:long,Supervoxel:long,SplitSupervoxel:long,RemainSupervoxel:long,SVSplits:map<string,struct<Split:long,Remain:long>>>"


def parse(lines: DataFrame, column: str = "value", exact_duplicates: bool = False) -> DataFrame:
    """Typed log rows of JSON lines: timestamp, uuid, action, user, mutid, target_body, merged, cleaved, splits, msg."""
    rows = lines if exact_duplicates else lines.dropDuplicates([column])
    m = F.from_json(column, MESSAGE)
    rows = rows.select(F.col(column).alias("msg"), m.alias("m"))
    target = F.coalesce("m.Target", "m.OrigLabel")
    return rows.select(
        log_timestamp(F.col("msg")).alias("timestamp"),
        F.col("m.UUID").alias("uuid"),
        F.col("m.Action").alias("action"),
        F.col("m.User").alias("user"),
        F.col("m.MutationID").alias("mutid"),
        target.alias("target_body"),
        F.coalesce("m.Labels", F.array().cast("array<long>")).alias("merged"),
        F.coalesce("m.CleavedLabel", "m.NewLabel").alias("child_body"),
        F.coalesce("m.CleavedSupervoxels", F.array().cast("array<long>")).alias("cleaved_svs"),
        F.col("m.Supervoxel").alias("target_sv"),
        F.col("m.SplitSupervoxel").alias("child_split_sv"),
        F.col("m.RemainSupervoxel").alias("child_remain_sv"),
        F.col("m.SVSplits").alias("sv_splits"),
        "msg",
    )


def in_range(log: DataFrame, start: str | None = None, stop: str | None = None, first: int | None = None, last: int | None = None) -> DataFrame:
    """Rows within times (local texts) and mutation ids, ends included."""
    out = log
    if start is not None:
        out = out.where(F.col("timestamp") >= local_timestamp(F.lit(start)))
    if stop is not None:
        out = out.where(F.col("timestamp") <= local_timestamp(F.lit(stop)))
    if first is not None:
        out = out.where(F.col("mutid") >= first)
    if last is not None:
        out = out.where(F.col("mutid") <= last)
    return out


def with_actions(log: DataFrame, actions: list[str]) -> DataFrame:
    return log.where(F.col("action").isin(actions))


def of_versions(log: DataFrame, edges: DataFrame, leaf: DataFrame, parents: bool = True) -> DataFrame:
    """Rows of the leaf version, or of it and its ancestors."""
    if not parents:
        return log.join(leaf.select(F.col("node").alias("uuid")).distinct(), "uuid", "left_semi")
    return log.join(ancestors(edges, leaf).select(F.col("node").alias("uuid")).distinct(), "uuid", "left_semi")


def _events(log: DataFrame) -> DataFrame:
    """(body, mutid, seq, event): what each message does to each body; events are new, changed, removed."""
    event = lambda body, seq, name: F.struct(body.cast("long").alias("body"), F.lit(seq).alias("seq"), F.lit(name).alias("event"))
    merged = F.transform("merged", lambda b: F.struct(b.alias("body"), F.lit(0).alias("seq"), F.lit("removed").alias("event")))
    target = F.array(event(F.col("target_body"), 1, "changed"))
    child = F.array(event(F.col("child_body"), 2, "new"))
    kind = F.col("action")
    per = F.when(kind == "merge", F.concat(merged, target)).when(kind.isin("cleave", "split"), F.concat(target, child)).when(kind.isin("split-supervoxel", "supervoxel-split"), target).otherwise(F.array().cast("array<struct<body:bigint,seq:int,event:string>>"))
    return log.select("mutid", F.inline(per)).where("body IS NOT NULL")


def affected_bodies(log: DataFrame) -> DataFrame:
    """(body, state): new (made in the log and there still), changed, or removed. A body made and removed in it is left out."""
    e = _events(log)
    g = e.groupBy("body").agg(F.max_by("event", F.struct("mutid", "seq")).alias("last"), F.min_by("event", F.struct("mutid", "seq")).alias("first"))
    state = F.when((F.col("last") == "removed") & (F.col("first") == "new"), F.lit(None)).when(F.col("last") == "removed", "removed").when(F.col("first") == "new", "new").otherwise("changed")
    return g.select("body", state.alias("state")).where("state IS NOT NULL")


def affected_supervoxels(log: DataFrame) -> DataFrame:
    """(sv, state): new or deleted by splits; made and split again counts as deleted only if it was there before."""
    s = splits(log)
    new = s.select("remain").union(s.select("split")).distinct().toDF("sv")
    old = s.select(F.col("old").alias("sv")).distinct()
    return new.join(old, "sv", "left_anti").withColumn("state", F.lit("new")).union(old.join(new, "sv", "left_anti").withColumn("state", F.lit("deleted")))


def splits(log: DataFrame) -> DataFrame:
    """(mutid, old, remain, split, type) of split messages, those nested in body splits too."""
    direct = log.where("target_sv IS NOT NULL AND child_split_sv IS NOT NULL").select("mutid", F.col("target_sv").alias("old"), F.col("child_remain_sv").alias("remain"), F.col("child_split_sv").alias("split"), F.lit("split-supervoxel").alias("type"))
    nested = log.where("sv_splits IS NOT NULL").select("mutid", F.explode("sv_splits").alias("old", "s")).select("mutid", F.col("old").cast("long").alias("old"), F.col("s.Remain").alias("remain"), F.col("s.Split").alias("split"), F.lit("split").alias("type"))
    return direct.union(nested).dropDuplicates(["old", "remain", "split"])


def new_fragments(split_events: DataFrame, types: list[str]) -> DataFrame:
    """(sv): split and remain ids of the types that weren't split again."""
    s = split_events.where(F.col("type").isin(types))
    return s.select("split").union(s.select("remain")).distinct().toDF("sv").join(split_events.select(F.col("old").alias("sv")), "sv", "left_anti")


def transactions(log: DataFrame, key: str, order: list[str], trigger: Column, done: Column, value: str) -> DataFrame:
    """Adds transaction (its number in the key) and the value of the row that completes it (null if none does).

    A transaction begins with a trigger row and holds rows up to the completing one.
    """
    w = Window.partitionBy(key).orderBy(*order)
    number = F.sum(trigger.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    rows = log.withColumn("transaction", number)
    inner = Window.partitionBy(key, "transaction").orderBy(*order)
    return rows.withColumn("completed", F.first(F.when(done, F.col(value)), ignorenulls=True).over(inner.rowsBetween(0, Window.unboundedFollowing)))


def last_mutation(log: DataFrame, key: list[str] | None = None) -> DataFrame:
    """The last row by mutation id, of all or of each key."""
    if key:
        return keep_one(log, key, ["mutid"], last=True)
    return log.orderBy(F.desc("mutid")).limit(1)


def since(log: DataFrame, receipt: DataFrame) -> DataFrame:
    """Rows after the last mutation that a receipt (mutid) names; all rows without one."""
    last = receipt.agg(F.max("mutid").alias("_last"))
    return log.crossJoin(F.broadcast(last)).where("_last IS NULL OR mutid > _last").drop("_last")


def merge_edges(log: DataFrame) -> DataFrame:
    """(target, absorbed, mutid) of merges and renumberings."""
    return log.where(F.col("action").isin("merge", "renumber")).select(F.col("target_body").alias("target"), F.explode("merged").alias("absorbed"), "mutid")


def drop_removed(annotations: DataFrame, affected: DataFrame, key: str = "body") -> DataFrame:
    """Annotations of bodies that weren't removed."""
    return annotations.join(affected.where("state = 'removed'").select(F.col("body").alias(key)), key, "left_anti")


def replay_mapping(mapping: DataFrame, log: DataFrame) -> DataFrame:
    """(sv, body) after merges and cleaves of a log: cleaved supervoxels take their last child body, then bodies their owners."""
    from .graph import owners

    moved = log.where("action = 'cleave'").select("mutid", "child_body", F.explode("cleaved_svs").alias("sv"))
    last = moved.groupBy("sv").agg(F.max_by("child_body", "mutid").alias("child"))
    own = owners(merge_edges(log).select("target", "absorbed"))
    out = mapping.join(last, "sv", "left").select("sv", F.coalesce("child", "body").alias("body"))
    return out.join(own, "body", "left").select("sv", F.coalesce("owner", "body").alias("body"))
