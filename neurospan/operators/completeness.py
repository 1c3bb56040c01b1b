"""How complete connectivity becomes as bodies are finished in the order of their weight."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .graph import settle
from .tables import numbered, running_sum


def body_weights(connections: DataFrame) -> DataFrame:
    """(body, presyn, postsyn, synweight): pre points, post points, and outputs plus inputs, of connections (pre_id, body_pre, post_id, body_post)."""
    out = connections.groupBy(F.col("body_pre").alias("body")).agg(F.countDistinct("pre_id").alias("presyn"), F.count("*").alias("outputs"))
    into = connections.groupBy(F.col("body_post").alias("body")).agg(F.count("*").alias("postsyn"))
    both = out.join(into, "body", "full").na.fill(0)
    return both.select("body", "presyn", "postsyn", (F.col("outputs") + F.col("postsyn")).alias("synweight"))


def top_regions(connections: DataFrame, body: str, name: str) -> DataFrame:
    """The region in which each body has most connections; ties by name."""
    n = connections.where("roi IS NOT NULL").groupBy(F.col(body).alias("body"), "roi").agg(F.count("*").alias("n"))
    return n.groupBy("body").agg(F.min_by("roi", F.struct(-F.col("n"), F.col("roi"))).alias(name))


def ranked_counts(connections: DataFrame) -> DataFrame:
    """Bodies with their counts, main regions and rank from 0 by weight, ties by id."""
    bodies = body_weights(connections)
    if "roi" in connections.columns:
        bodies = bodies.join(top_regions(connections, "body_post", "top_input_roi"), "body", "left").join(top_regions(connections, "body_pre", "top_output_roi"), "body", "left")
    keyed = settle(bodies.withColumn("_down", -F.col("synweight")))  # read for bounds, counts and rows
    return numbered(keyed, ["_down", "body"], "rank").drop("_down")


def forecast(connections: DataFrame, ranked: DataFrame | None = None, stop_rank: int | None = None) -> DataFrame:
    """Connections in the order in which both their bodies are done, with running totals and their share of everything.

    A body counts at its first connection. Totals are those before a cutoff by rank.
    """
    ranked = settle(ranked if ranked is not None else ranked_counts(connections.drop("roi")))
    ranks = ranked.select("body", "rank", "presyn", "postsyn")
    total = ranks.agg(F.sum("presyn").alias("t_pre"), F.sum("postsyn").alias("t_post")).crossJoin(connections.agg(F.count("*").alias("t_conn")))
    if stop_rank is not None:
        ranks = ranks.where(F.col("rank") <= stop_rank)
    side = lambda s: ranks.select(F.col("body").alias(f"body_{s}"), F.col("rank").alias(f"rank_{s}"), F.col("presyn").alias(f"n_pre_{s}"), F.col("postsyn").alias(f"n_post_{s}"))
    rows = connections.join(side("pre"), "body_pre").join(side("post"), "body_post")
    rows = rows.withColumn("max_rank", F.greatest("rank_pre", "rank_post")).withColumn("min_rank", F.least("rank_pre", "rank_post"))
    order = ["max_rank", "min_rank", "pre_id", "post_id"]
    key = F.struct(*order)
    # the first connection of each body, without a window over all connections
    ends = F.array(F.col("body_pre"), F.col("body_post"))
    first = rows.select(key.alias("k"), F.explode(ends).alias("body")).groupBy("body").agg(F.min("k").alias("k"))
    new = first.join(ranks, "body").groupBy("k").agg(F.sum("presyn").alias("new_pre"), F.sum("postsyn").alias("new_post"))
    new = new.select(*(F.col(f"k.{c}").alias(c) for c in order), "new_pre", "new_post")
    marked = settle(rows.join(new, order, "left").na.fill(0, ["new_pre", "new_post"]))
    done = running_sum(marked, order, {"traced_pre": F.col("new_pre"), "traced_post": F.col("new_post"), "traced_conn": F.lit(1).cast("long")})
    out = done.crossJoin(F.broadcast(total))
    share = lambda a, b: F.coalesce(F.try_divide(F.col(a).cast("double"), F.col(b).cast("double")), F.lit(0.0))
    return out.select("pre_id", "post_id", "body_pre", "body_post", "max_rank", "min_rank", "traced_pre", "traced_post", "traced_conn", share("traced_pre", "t_pre").alias("traced_pre_frac"), share("traced_post", "t_post").alias("traced_post_frac"), share("traced_conn", "t_conn").alias("traced_conn_frac"))


def downstream(tasks: DataFrame, upstream: str = "upstream", body: str = "body", weight: str = "weight") -> DataFrame:
    """Tasks of each upstream body, heaviest first, with the running and the highest share of its weight; a pair counts once."""
    once = tasks.groupBy(upstream, body).agg(F.max(weight).alias(weight))
    w = Window.partitionBy(upstream).orderBy(F.desc(weight), body).rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum(weight).over(Window.partitionBy(upstream))
    got = once.withColumn("cumulative", F.sum(weight).over(w)).withColumn("expected", F.coalesce(F.try_divide(F.col("cumulative").cast("double"), total.cast("double")), F.lit(0.0)))
    return got.withColumn("highest", F.max("expected").over(Window.partitionBy(upstream)))
