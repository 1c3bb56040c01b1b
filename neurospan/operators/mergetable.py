"""Merge tables (id_a, xa, ya, za, id_b, xb, yb, zb, score) and mappings (sv, body)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import keep_one, swap_columns

SCHEMA = "id_a long, xa int, ya int, za int, id_b long, xb int, yb int, zb int, score float"
PAIRS = [("id_a", "id_b"), ("xa", "xb"), ("ya", "yb"), ("za", "zb")]


def normalize(edges: DataFrame, order: list[str] | None, pairs: list[tuple[str, str]] | None = None) -> DataFrame:
    """Edges with id_a <= id_b; of a pair's rows the last in the order stays (None: all do)."""
    own = [p for p in (pairs or PAIRS) if p[0] in edges.columns]
    out = swap_columns(edges, F.col(own[0][0]) > F.col(own[0][1]), own)
    return out if order is None else keep_one(out, list(own[0]), order, last=True)


def mapped(df: DataFrame, mapping: DataFrame, column: str, name: str) -> DataFrame:
    """Adds the body of a supervoxel column; what isn't mapped is its own body."""
    own = mapping.select(F.col("sv").alias(column), F.col("body").alias("_m"))
    return df.join(own, column, "left").withColumn(name, F.coalesce("_m", column)).drop("_m").select(*df.columns, name)


def apply_mapping(edges: DataFrame, mapping: DataFrame) -> DataFrame:
    """Adds body: both ends' body, or 0 if they differ."""
    out = mapped(mapped(edges, mapping, "id_a", "_a"), mapping, "id_b", "_b")
    return out.withColumn("body", F.when(F.col("_a") == F.col("_b"), F.col("_a")).otherwise(F.lit(0).cast("long"))).drop("_a", "_b")


def apply_mappings(svs: DataFrame, mappings: dict[str, DataFrame]) -> DataFrame:
    out = svs
    for name, m in mappings.items():
        out = mapped(out, m, "sv", name)
    return out


def body_sizes(sizes: DataFrame, mapping: DataFrame, singletons: bool = False) -> DataFrame:
    """(body, voxels, svs) without body 0, largest first. With singletons, unmapped supervoxels are bodies of their own."""
    rows = sizes.join(mapping, "sv").select("body", "size")
    if singletons:
        rows = rows.union(sizes.join(mapping, "sv", "left_anti").select(F.col("sv").alias("body"), "size"))
    return rows.where("body != 0").groupBy("body").agg(F.sum("size").alias("voxels"), F.count("*").alias("svs")).orderBy(F.desc("voxels"), "body")


def favorites(edges: DataFrame, id_a: str = "id_a", id_b: str = "id_b", score: str = "score", key: list[str] | None = None) -> DataFrame:
    """(body, best, side, key..., edges): each body's edge of least score, ties to side a, then by key; and its number of edges."""
    keys = key or [id_a, id_b]
    side = lambda a, b, s: edges.select(F.col(a).alias("body"), F.struct(F.col(score).alias("score"), F.lit(s).alias("side"), *(F.col(k).alias(f"k_{k}") for k in keys)).alias("e"))
    best = side(id_a, id_b, "a").union(side(id_b, id_a, "b")).groupBy("body").agg(F.min("e").alias("e"), F.count("*").alias("edges"))
    return best.select("body", F.col("e.score").alias("best"), F.col("e.side").alias("side"), *(F.col(f"e.k_{k}").alias(k) for k in keys), "edges")


def mark_favorites(edges: DataFrame, id_a: str = "id_a", id_b: str = "id_b", score: str = "score", key: list[str] | None = None) -> DataFrame:
    """Adds favorite_of_a and favorite_of_b."""
    keys = key or [id_a, id_b]
    best = favorites(edges, id_a, id_b, score, keys)
    hit = lambda s, name: best.select(*keys, F.lit(True).alias(name), F.col("body").alias(s)).dropDuplicates([*keys, s])
    if id_a in keys and id_b in keys:
        a, b = best.where(F.col("body") == F.col(id_a)).select(*keys, F.lit(True).alias("favorite_of_a")).distinct(), best.where(F.col("body") == F.col(id_b)).select(*keys, F.lit(True).alias("favorite_of_b")).distinct()
        out = edges.join(a, keys, "left").join(b, keys, "left")
    else:
        out = edges.join(hit(id_a, "favorite_of_a"), [*keys, id_a], "left").join(hit(id_b, "favorite_of_b"), [*keys, id_b], "left")
    return out.na.fill(False, ["favorite_of_a", "favorite_of_b"])


def extract_favorites(edges: DataFrame, mutual: bool = False, **kw) -> DataFrame:
    both = F.col("favorite_of_a") & F.col("favorite_of_b") if mutual else F.col("favorite_of_a") | F.col("favorite_of_b")
    return mark_favorites(edges, **kw).where(both)


def important_merges(edges: DataFrame, mapping: DataFrame, important: DataFrame, drop_duplicates: bool = True) -> DataFrame:
    """Edges between two different important bodies, oriented by body; one row a pair of bodies, of least score."""
    out = mapped(mapped(edges, mapping, "id_a", "body_a"), mapping, "id_b", "body_b").where("body_a != body_b")
    out = swap_columns(out, F.col("body_a") > F.col("body_b"), [("body_a", "body_b"), *(p for p in PAIRS if p[0] in edges.columns)])
    for s in ("body_a", "body_b"):
        out = out.join(important.select(F.col("body").alias(s)), s, "left_semi")
    return keep_one(out, ["body_a", "body_b"], ["score", "id_a", "id_b"]) if drop_duplicates else out


def drop_reviewed(edges: DataFrame, reviewed: DataFrame) -> DataFrame:
    """Edges whose unordered pair isn't among the reviewed."""
    lo, hi = F.least("id_a", "id_b").alias("_lo"), F.greatest("id_a", "id_b").alias("_hi")
    return edges.withColumns({"_lo": F.least("id_a", "id_b"), "_hi": F.greatest("id_a", "id_b")}).join(reviewed.select(lo, hi), ["_lo", "_hi"], "left_anti").select(*edges.columns)


def filter_tasks(tasks: DataFrame, least_pre: int, least_post: int, bad: DataFrame, statuses: DataFrame, wanted: list[str], either: bool = True, reviewed: DataFrame | None = None) -> DataFrame:
    """Tasks whose bodies have enough synapses on both sides, aren't bad, and of which either (or both) has a wanted status."""
    enough = lambda s: (F.col(f"pre_{s}") >= least_pre) | (F.col(f"post_{s}") >= least_post)
    out = tasks.where(enough("a") & enough("b"))
    for s in ("a", "b"):
        out = out.join(bad.select(F.col("body").alias(f"body_{s}")), f"body_{s}", "left_anti")
        out = out.join(statuses.select(F.col("body").alias(f"body_{s}"), F.col("status").alias(f"status_{s}")), f"body_{s}", "left")
    good = lambda s: F.coalesce(F.col(f"status_{s}").isin(wanted), F.lit(False))
    out = out.where(good("a") | good("b") if either else good("a") & good("b"))
    return drop_reviewed(out, reviewed) if reviewed is not None else out


def status_matchups(tasks: DataFrame, levels: list[str], missing: str = "tiny") -> DataFrame:
    """(lower, higher, n): unordered pairs of statuses in the order of levels."""
    rank = lambda c: F.array_position(F.array(*(F.lit(x) for x in levels)), F.coalesce(F.col(c), F.lit(missing))).cast("int")
    name = lambda c: F.element_at(F.array(*(F.lit(x) for x in levels)), F.col(c))
    pairs = tasks.select(F.least(rank("status_a"), rank("status_b")).alias("i"), F.greatest(rank("status_a"), rank("status_b")).alias("j")).where("i > 0")
    return pairs.groupBy("i", "j").agg(F.count("*").alias("n")).select(name("i").alias("lower"), name("j").alias("higher"), "n")


def bodywise_stats(tasks: DataFrame) -> DataFrame:
    """Per larger body (by post points): its post points, tasks, what they add, and the improvement in whole percent."""
    rows = swap_columns(tasks, F.col("post_a") < F.col("post_b"), [("body_a", "body_b"), ("post_a", "post_b")])
    got = rows.groupBy(F.col("body_a").alias("body")).agg(F.max("post_a").alias("post"), F.count("*").alias("tasks"), F.sum("post_b").alias("gain"))
    return got.withColumn("improvement", F.coalesce(F.floor(F.try_divide(100 * F.col("gain"), F.col("post"))), F.lit(0)).cast("long"))


def changed_bodies(before: DataFrame, after: DataFrame) -> DataFrame:
    """Distinct bodies, but for 0, of supervoxels whose body differs between two mappings."""
    both = before.select("sv", F.col("body").alias("_a")).join(after.select("sv", F.col("body").alias("_b")), "sv", "full")
    ids = both.where(~F.col("_a").eqNullSafe(F.col("_b"))).select(F.explode(F.array("_a", "_b")).alias("body"))
    return ids.where("body IS NOT NULL AND body != 0").distinct()


def complete_mapping(mapping: DataFrame, retired: DataFrame, known: DataFrame) -> DataFrame:
    """Mapping with retired supervoxels at 0 and all other known ones at themselves; the first of these holds."""
    rows = mapping.select("sv", "body", F.lit(0).alias("_p")).union(retired.select("sv", F.lit(0).cast("long"), F.lit(1))).union(known.select("sv", F.col("sv"), F.lit(2)))
    return keep_one(rows, ["sv"], ["_p", "body"]).drop("_p")


def refresh(points: DataFrame, stale: DataFrame, fresh: DataFrame, key: str = "point_id") -> DataFrame:
    """Points whose supervoxel is stale take the supervoxel looked up anew (key, sv); the others stay."""
    old = points.join(stale.select("sv"), "sv", "left_anti").select(*points.columns)
    new = points.join(stale.select("sv"), "sv", "left_semi").drop("sv").join(fresh.select(key, "sv"), key, "left").select(*points.columns)
    return old.union(new)


def refresh_edges(edges: DataFrame, roots: DataFrame, fresh: DataFrame) -> DataFrame:
    """Endpoints replaced by those looked up anew, kept only if they come from the same split root; else body 0."""
    out = edges
    for s in ("a", "b"):
        new = fresh.select(F.col("sv").alias(f"id_{s}"), F.col("new_sv").alias("_n"))
        out = out.join(new, f"id_{s}", "left").withColumn(f"_new_{s}", F.coalesce("_n", f"id_{s}")).drop("_n")
        for c in (f"id_{s}", f"_new_{s}"):
            r = roots.select(F.col("sv").alias(c), F.col("root").alias(f"_r_{c}"))
            out = out.join(r, c, "left").withColumn(f"_r_{c}", F.coalesce(f"_r_{c}", c))
    same = (F.col("_r_id_a") == F.col("_r__new_a")) & (F.col("_r_id_b") == F.col("_r__new_b"))
    out = out.withColumn("body", F.when(same, F.col("body")).otherwise(F.lit(0).cast("long"))).withColumn("id_a", F.when(same, F.col("_new_a")).otherwise(F.col("id_a"))).withColumn("id_b", F.when(same, F.col("_new_b")).otherwise(F.col("id_b")))
    return out.select(*edges.columns)


def mergeable_groups(members: DataFrame, preferences: list[str], group: str = "mergeset", body: str = "body") -> DataFrame:
    """Groups of more than one member with their target: the first by the boolean preferences, then by id."""
    order = [*(F.coalesce(F.col(p), F.lit(False)).desc() for p in preferences), F.col(body).asc()]
    w = Window.partitionBy(group)
    got = members.withColumn("_n", F.count("*").over(w)).withColumn("_k", F.row_number().over(w.orderBy(*order))).where("_n > 1")
    target = F.max(F.when(F.col("_k") == 1, F.col(body))).over(w)
    return got.withColumn("target", target).where(F.col(body) != F.col("target")).drop("_n", "_k")


def merge_commands(members: DataFrame) -> DataFrame:
    """(mergeset, target, fragments) of mergeable groups."""
    return members.groupBy("mergeset", "target").agg(F.array_sort(F.collect_set("body")).alias("fragments"))


def append_decisions(edges: DataFrame, decisions: DataFrame, score: float = 0.01) -> DataFrame:
    """Edges and the decided merges, at a fixed low score."""
    good = decisions.where(F.col("result").isin("merge", "mergeLater")).drop("result", "score").withColumn("score", F.lit(score).cast("float"))
    return edges.unionByName(good, allowMissingColumns=True)


def focused_bodies(synapse: DataFrame, big: DataFrame, bad: DataFrame) -> DataFrame:
    """Bodies with enough synapses or size, without the bad ones."""
    return synapse.select("body").union(big.select("body")).distinct().join(bad.select("body"), "body", "left_anti")


def with_columns_of(df: DataFrame, other: DataFrame, on: str, fill: dict | None = None) -> DataFrame:
    out = df.join(other, on, "left")
    return out.na.fill(fill) if fill else out


def outer_merge(a: DataFrame, b: DataFrame, on: str, suffixes: tuple[str, str] = ("_a", "_b")) -> DataFrame:
    """Full outer join; columns of both get suffixes."""
    same = [c for c in a.columns if c in b.columns and c != on]
    left = a.select(on, *(F.col(c).alias(c + suffixes[0]) if c in same else F.col(c) for c in a.columns if c != on))
    right = b.select(on, *(F.col(c).alias(c + suffixes[1]) if c in same else F.col(c) for c in b.columns if c != on))
    return left.join(right, on, "full")


def disagreements(df: DataFrame, a: str, b: str) -> DataFrame:
    """Rows where both values are given and differ."""
    given: Column = F.col(a).isNotNull() & (F.col(a) != "") & F.col(b).isNotNull() & (F.col(b) != "")
    return df.where(given & (F.col(a) != F.col(b)))


def with_several(df: DataFrame, key: str, coords: list[str]) -> DataFrame:
    """Distinct rows (key, coords) of keys that have more than one place."""
    once = df.select(key, *coords).distinct()
    return once.withColumn("_n", F.count("*").over(Window.partitionBy(key))).where("_n > 1").drop("_n")


def drop_empty(df: DataFrame, columns: list[str]) -> DataFrame:
    """Rows in which some column is neither null, empty nor false."""
    kinds = dict(df.dtypes)
    full = [F.col(c).isNotNull() & (F.col(c) != "" if kinds[c] == "string" else F.col(c) if kinds[c] == "boolean" else F.lit(True)) for c in columns]
    cond = full[0]
    for c in full[1:]:
        cond = cond | c
    return df.where(cond)


def merge_lists(pairs: DataFrame) -> DataFrame:
    """(agg, origs): original ids of each segment by falling overlap, of segments with several. pairs: (orig, agg)."""
    n = pairs.where("orig != 0 AND agg != 0").groupBy("orig", "agg").agg(F.count("*").alias("n"))
    lists = n.groupBy("agg").agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "orig"))).alias("l"))
    return lists.where(F.size("l") > 1).select("agg", F.transform("l", lambda x: x["orig"]).alias("origs"))


def edges_of_body(edges: DataFrame, body: int) -> DataFrame:
    """Edges within one body, by the body that apply_mapping() gave them."""
    return edges.where(F.col("body") == body)


def edges_within(edges: DataFrame, svs: DataFrame) -> DataFrame:
    """Edges with both ends among supervoxels (sv)."""
    own = svs.select("sv").distinct()
    return edges.join(own.withColumnRenamed("sv", "id_a"), "id_a", "left_semi").join(own.withColumnRenamed("sv", "id_b"), "id_b", "left_semi").select(*edges.columns)
