"""Versions of a store: branches, heads, parents, and references to them, for any number of them at once.

nodes: (uuid, version, branch, locked, created, updated), version rising with time; the main branch's
name is empty. edges: (uuid, parent).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .geometry import dealt
from .graph import ancestors, roots, settle

MAIN = "master"
LONGEST = 64  # characters of an id


def branch_nodes(nodes: DataFrame, edges: DataFrame, branches: DataFrame | None = None, with_ancestors: bool = True) -> DataFrame:
    """(branch, uuid, version, place): a branch's nodes from the first on, with all that its newest one descends from.

    Each branch gets its own row for each node, so name the branches that are wanted.
    """
    own = nodes if branches is None else nodes.join(branches.select("branch").distinct(), "branch", "left_semi")
    got = own.select("branch", "uuid", "version")
    if with_ancestors:
        leaf = own.groupBy("branch").agg(F.max_by("uuid", "version").alias("start"))
        up = ancestors(edges, leaf.select(F.col("start").alias("node")), "uuid", "parent").select("start", F.col("node").alias("uuid"))
        got = leaf.join(up, "start").join(nodes.select("uuid", "version"), "uuid").select("branch", "uuid", "version")
    return got.withColumn("place", F.row_number().over(Window.partitionBy("branch").orderBy("version", "uuid")) - 1)


def node_branches(refs: DataFrame, nodes: DataFrame, edges: DataFrame, with_ancestors: bool = True, with_descendants: bool = False) -> DataFrame:
    """(ref, uuid, version, place): for references to nodes, the nodes of their branches up to themselves, with what they descend
    from; with_descendants the rest of their branches too. References that aren't known have no rows."""
    at = resolve(refs, nodes, edges).where("uuid IS NOT NULL").join(nodes, "uuid").select("ref", "uuid", "branch", "version")
    rest = F.lit(with_descendants) | (F.col("version") <= F.col("own"))
    mine = at.select("ref", "branch", F.col("version").alias("own")).join(nodes.select("uuid", "branch", "version"), "branch").where(rest).select("ref", "uuid", "version")
    if with_ancestors:
        up = ancestors(edges, at.select(F.col("uuid").alias("node")), "uuid", "parent").select(F.col("start").alias("_at"), F.col("node").alias("uuid"))
        above = at.select("ref", F.col("uuid").alias("_at")).join(up, "_at").join(nodes.select("uuid", "version"), "uuid").select("ref", "uuid", "version")
        mine = mine.union(above).distinct()
    return mine.withColumn("place", F.row_number().over(Window.partitionBy("ref").orderBy("version", "uuid")) - 1)


def heads(nodes: DataFrame, edges: DataFrame, branches: DataFrame | None = None, locked_only: bool = False) -> DataFrame:
    """(branch, uuid) of the newest node of each branch; with locked_only the one before it where that isn't locked."""
    listed = branch_nodes(nodes, edges, branches).join(nodes.select("uuid", "locked"), "uuid")
    last = listed.groupBy("branch").agg(F.max("place").alias("last"), F.max_by("locked", "place").alias("closed"))
    place = F.when(F.lit(locked_only) & ~F.col("closed"), F.col("last") - 1).otherwise(F.col("last"))
    return listed.join(last, "branch").where(F.col("place") == place).select("branch", "uuid")


def parents_of(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(uuid, parent); a root's is null, of several parents the least is taken."""
    one = edges.groupBy("uuid").agg(F.min("parent").alias("parent"))
    return nodes.select("uuid").join(one, "uuid", "left")


def roots_of(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(uuid, root)."""
    top = roots(edges, "uuid", "parent").withColumnRenamed("node", "uuid")
    return nodes.select("uuid").join(top, "uuid", "left").select("uuid", F.coalesce("root", "uuid").alias("root"))


def lock_dates(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(uuid, lock_date): a node was closed when its first child was made, or else when it was changed last."""
    made = edges.join(nodes.select("uuid", "created"), "uuid").groupBy(F.col("parent").alias("uuid")).agg(F.min("created").alias("_made"))
    return nodes.join(made, "uuid", "left").select("uuid", F.to_date(F.least("updated", "_made")).alias("lock_date"))


def resolve(refs: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(ref, uuid) of references: ids or beginnings of one id, else a branch's newest node; 'repo:' may stand
    before a branch and '~n' after it for the n-th before the newest. What can't be resolved has a null."""
    own, nodes = settle(dealt(refs.select("ref").distinct(), "ref")), settle(dealt(nodes, "uuid"))  # both are read often
    lengths = own.select(F.length("ref").alias("k")).where(f"k BETWEEN 1 AND {LONGEST}").distinct()
    starts = nodes.select("uuid").crossJoin(F.broadcast(lengths)).select(F.substring("uuid", F.lit(1), F.col("k")).alias("ref"), "uuid").distinct()
    by_id = own.join(starts, "ref").groupBy("ref").agg(F.min("uuid").alias("_id"), F.count("*").alias("n")).where("n = 1").drop("n")
    name = F.regexp_replace("ref", "^[^:]*:", "")
    branch = F.regexp_replace(name, "~[0-9]+$", "")
    back = F.coalesce(F.try_to_number(F.nullif(F.regexp_extract(name, "~([0-9]+)$", 1), F.lit("")), F.lit("999999999")).cast("int"), F.lit(0))
    parts = own.select("ref", F.when(branch == MAIN, "").otherwise(branch).alias("branch"), back.alias("back"))
    listed = branch_nodes(nodes, edges, parts)
    last = listed.groupBy("branch").agg(F.max("place").alias("last"))
    by_name = parts.join(last, "branch").withColumn("place", F.col("last") - F.col("back")).join(listed, ["branch", "place"]).select("ref", F.col("uuid").alias("_named"))
    return own.join(by_id, "ref", "left").join(by_name, "ref", "left").select("ref", F.coalesce("_id", "_named").alias("uuid"))


def _parsed(c: Column) -> list[Column]:
    """(kind, opened, first, last, closed) of a range's text; kind is one for a single reference, range, or null for what is neither."""
    text = F.trim(c)
    opened, closed = F.substring(text, 1, 1), F.substring(text, -1, 1)
    ends = F.split(F.substring(text, F.lit(2), F.length(text) - 2), ",")
    first, last = F.trim(F.get(ends, F.lit(0))), F.trim(F.get(ends, F.lit(1)))
    bare = lambda r: (r != "") & (F.translate(r, " ()[]", "") == r)
    good = opened.isin("(", "[") & closed.isin(")", "]") & (F.size(ends) == 2) & bare(first) & bare(last)
    single = ~F.contains(text, F.lit(","))
    kind = F.when(single & (text != ""), "one").when(~single & good, "range")
    return [kind.alias("kind"), opened.alias("opened"), F.when(single, text).otherwise(first).alias("first"), F.when(single, text).otherwise(last).alias("last"), closed.alias("closed")]


def resolve_ranges(ranges: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(range, place, uuid) of ranges like '[first, last]' along the way to last; a parenthesis leaves its end out,
    and root stands for the first node of all. A reference alone stands for its node.

    What is malformed, names unknown nodes, or whose first isn't above its last, gets one row without a uuid;
    a range that leaves all out gets none.
    """
    parts = settle(dealt(ranges.select("range").distinct(), "range").select("range", *_parsed(F.col("range"))))
    nodes, edges = settle(dealt(nodes, "uuid")), settle(dealt(edges, "uuid"))
    good = parts.where("kind IS NOT NULL")
    refs = good.select(F.col("last").alias("ref")).union(good.where("first != 'root'").select("first"))
    named = settle(resolve(refs, nodes, edges))
    first, last = named.toDF("first", "a"), named.toDF("last", "b")
    ends = settle(parts.join(last, "last", "left").join(first, "first", "left"))
    up = ancestors(edges, ends.where("kind = 'range' AND b IS NOT NULL").select(F.col("b").alias("node")), "uuid", "parent").select(F.col("start").alias("b"), F.col("node").alias("uuid"))
    listed = settle(up.join(nodes.select("uuid", "version"), "uuid").select("b", "uuid", (F.row_number().over(Window.partitionBy("b").orderBy("version", "uuid")) - 1).alias("at")))
    counts = listed.groupBy("b").agg(F.max("at").alias("stop"))
    ends = ends.join(counts, "b", "left").join(listed.select("b", F.col("uuid").alias("a"), F.col("at").alias("start")), ["b", "a"], "left")
    start = F.when(F.col("first") == "root", F.lit(0)).otherwise(F.col("start"))
    lo, hi = start + (F.col("opened") == "(").cast("int"), F.col("stop") - (F.col("closed") == ")").cast("int")
    ends = ends.select("range", "kind", "b", lo.alias("lo"), hi.alias("hi"))
    spans = ends.where("kind = 'range' AND lo IS NOT NULL AND hi IS NOT NULL")
    found = spans.join(listed, "b").where("at BETWEEN lo AND hi").select("range", (F.col("at") - F.col("lo")).alias("place"), "uuid")
    single = ends.where("kind = 'one'").select("range", F.when(F.col("b").isNotNull(), 0).alias("place"), F.col("b").alias("uuid"))
    lost = ends.where("kind IS NULL OR kind = 'range' AND (lo IS NULL OR hi IS NULL)").select("range", F.lit(None).cast("int").alias("place"), F.lit(None).cast("string").alias("uuid"))
    return found.unionByName(single).unionByName(lost)
