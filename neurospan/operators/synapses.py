"""Point tables (point_id, z, y, x, kind, conf, user, body, sv), partner tables (pre_id, post_id), and their counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import keep_one

PRE, POST = "PreSyn", "PostSyn"


def weighted_edges(relations: DataFrame, points: DataFrame, keys: tuple[list[str], list[str]] = (["from_z", "from_y", "from_x"], ["to_z", "to_y", "to_x"]), point_keys: list[str] | None = None) -> DataFrame:
    """(from_body, to_body, weight) of relations between points, heaviest first. Ends without a body aren't counted."""
    on = point_keys or ["z", "y", "x"]
    out = relations
    for side, cols in zip(("from", "to"), keys):
        bodies = points.select(*(F.col(p).alias(c) for p, c in zip(on, cols)), F.col("body").alias(f"{side}_body"))
        out = out.join(bodies, list(cols))
    out = out.where("from_body IS NOT NULL AND to_body IS NOT NULL")
    return out.groupBy("from_body", "to_body").agg(F.count("*").alias("weight")).orderBy(F.desc("weight"), "from_body", "to_body")


def body_counts(points: DataFrame, kinds: tuple[str, ...] = (PRE, POST)) -> DataFrame:
    """Counts per body and kind, absent ones 0."""
    return points.where("body IS NOT NULL").groupBy("body").agg(*(F.count(F.when(F.col("kind") == k, 1)).alias(k) for k in kinds))


def bodies_of_interest(points: DataFrame, least_pre: int, least_post: int) -> DataFrame:
    return body_counts(points).where((F.col(PRE) >= least_pre) | (F.col(POST) >= least_post))


def full_partners(points: DataFrame, partners: DataFrame, columns: list[str]) -> DataFrame:
    """Partners with both points' columns, suffixed _pre and _post. Pairs without both points are dropped."""
    pre = points.select(F.col("point_id").alias("pre_id"), *(F.col(c).alias(f"{c}_pre") for c in columns))
    post = points.select(F.col("point_id").alias("post_id"), *(F.col(c).alias(f"{c}_post") for c in columns))
    return partners.join(pre, "pre_id").join(post, "post_id")


def partners_to_points(full: DataFrame, columns: list[str]) -> DataFrame:
    """Points of a full partner table; a pre point once."""
    pre = full.select(F.col("pre_id").alias("point_id"), F.lit(PRE).alias("kind"), *(F.col(f"{c}_pre").alias(c) for c in columns)).dropDuplicates(["point_id"])
    post = full.select(F.col("post_id").alias("point_id"), F.lit(POST).alias("kind"), *(F.col(f"{c}_post").alias(c) for c in columns))
    return pre.unionByName(post)


def autapses(full: DataFrame) -> DataFrame:
    return full.where("body_pre = body_post")


def redundant_posts(full: DataFrame, conf: str = "conf_post") -> DataFrame:
    """Rows of a pre point and post body beyond their most confident one."""
    w = Window.partitionBy("pre_id", "body_post").orderBy(F.desc(conf), "post_id")
    return full.withColumn("_n", F.row_number().over(w)).where("_n > 1").drop("_n")


def delete_posts(points: DataFrame, partners: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables without the post points and without pre points that lose their last partner."""
    left = partners.join(gone.select(F.col("point_id").alias("post_id")), "post_id", "left_anti")
    lost = partners.join(gone.select(F.col("point_id").alias("post_id")), "post_id", "left_semi").select("pre_id").distinct().join(left.select("pre_id"), "pre_id", "left_anti")
    ids = gone.select("point_id").union(lost.select("pre_id"))
    return points.join(ids, "point_id", "left_anti"), left


def delete_pres(points: DataFrame, partners: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both tables without the pre points and their post points."""
    pre = gone.select(F.col("point_id").alias("pre_id"))
    ids = gone.select("point_id").union(partners.join(pre, "pre_id", "left_semi").select("post_id"))
    return points.join(ids, "point_id", "left_anti"), partners.join(pre, "pre_id", "left_anti")


def add_points(points: DataFrame, more: DataFrame) -> DataFrame:
    """Union in which the later table's row of a point stays."""
    both = points.withColumn("_src", F.lit(0)).unionByName(more.withColumn("_src", F.lit(1)))
    return keep_one(both, ["point_id"], ["_src"], last=True).drop("_src")


def consistency(points: DataFrame, partners: DataFrame) -> DataFrame:
    """(report, n): how many rows break each rule between points and partners."""
    kinds = points.select("point_id", "kind")
    pre = partners.join(kinds.select(F.col("point_id").alias("pre_id"), F.col("kind").alias("pre_kind")), "pre_id", "left")
    both = pre.join(kinds.select(F.col("point_id").alias("post_id"), F.col("kind").alias("post_kind")), "post_id", "left")
    pairs = both.agg(
        F.count(F.when(F.col("pre_kind").isNull(), 1)).alias("dangling_pre"),
        F.count(F.when(F.col("post_kind").isNull(), 1)).alias("dangling_post"),
        F.count(F.when(F.col("pre_kind") != PRE, 1)).alias("wrong_kind_pre"),
        F.count(F.when(F.col("post_kind") != POST, 1)).alias("wrong_kind_post"),
    )
    repeated = partners.groupBy("pre_id", "post_id").agg(F.count("*").alias("c")).agg(F.coalesce(F.sum(F.col("c") - 1), F.lit(0)).alias("duplicate_pairs"))
    crowded = partners.dropDuplicates(["pre_id", "post_id"]).groupBy("post_id").count().where("count > 1").agg(F.count("*").alias("oversubscribed_posts"))
    same = points.groupBy("point_id").count().where("count > 1").agg(F.count("*").alias("duplicate_points"))
    lonely_pre = points.where(F.col("kind") == PRE).join(partners.select(F.col("pre_id").alias("point_id")), "point_id", "left_anti").agg(F.count("*").alias("childless_pres"))
    lonely_post = points.where(F.col("kind") == POST).join(partners.select(F.col("post_id").alias("point_id")), "point_id", "left_anti").agg(F.count("*").alias("orphan_posts"))
    row = pairs
    for x in (repeated, crowded, same, lonely_pre, lonely_post):
        row = row.crossJoin(x)  # one row each
    names = row.columns
    return row.select(F.inline(F.array(*(F.struct(F.lit(n).alias("report"), F.col(n).cast("long").alias("n")) for n in names))))


def relationship_weights(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.where(" AND ".join(f"{k} IS NOT NULL" for k in keys)).groupBy(*keys).agg(F.count("*").alias("weight"))


def with_totals(rows: DataFrame, keys: list[str], rolled: str) -> DataFrame:
    """Weights per keys, and in rows with a null in the rolled column over all its values."""
    rest = [k for k in keys if k != rolled]
    got = rows.where(" AND ".join(f"{k} IS NOT NULL" for k in keys)).groupBy(*keys).agg(F.count("*").alias("weight"))
    total = got.groupBy(*rest).agg(F.sum("weight").alias("weight")).withColumn(rolled, F.lit(None).cast(dict(rows.dtypes)[rolled]))
    return got.unionByName(total)


def roi_counts(points: DataFrame) -> DataFrame:
    """(body, roi, PreSyn, PostSyn) per region, and over both sides of paired regions, whose names end in (L) or (R)."""
    base = points.where("body IS NOT NULL AND roi IS NOT NULL")
    both = base.withColumn("roi", F.regexp_replace("roi", r"\((L|R)\)$", "")).join(base.select(F.regexp_replace("roi", r"\((L|R)\)$", "").alias("roi"), (F.regexp_replace("roi", r"\((L|R)\)$", "") != F.col("roi")).alias("sided")).where("sided").distinct(), "roi", "left_semi")
    count = lambda df: df.groupBy("body", "roi").agg(*(F.count(F.when(F.col("kind") == k, 1)).alias(k) for k in (PRE, POST)))
    return count(base).unionByName(count(both))


def pre_post_layout(weights: DataFrame) -> DataFrame:
    """Weights in pre and post columns: what is said of the body's outputs and inputs alike."""
    out = F.col("rel") == "PreSynTo"
    return weights.select(F.when(out, F.col("body")).otherwise(F.col("to_body")).alias("pre"), F.when(out, F.col("to_body")).otherwise(F.col("body")).alias("post"), "weight")


def in_regions(points: DataFrame, partners: DataFrame, rois: list[str]) -> tuple[DataFrame, DataFrame]:
    """Points in the regions, and partners both of whose ends are."""
    kept = points.where(F.col("roi").isin(rois))
    ids = kept.select("point_id")
    left = partners.join(ids.withColumnRenamed("point_id", "pre_id"), "pre_id", "left_semi").join(ids.withColumnRenamed("point_id", "post_id"), "post_id", "left_semi")
    return kept, left.select(*partners.columns)


def filtered(points: DataFrame, partners: DataFrame, conf_pre: float, conf_post: float, rois: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Points with a body, confident for their kind and in the regions; partners whose ends stay; points that have partners still."""
    good = (F.col("body") != 0) & (((F.col("kind") == PRE) & (F.col("conf") >= conf_pre)) | ((F.col("kind") == POST) & (F.col("conf") >= conf_post)))
    kept = points.where(good & F.col("roi").isin(rois) if rois else good)
    ids = kept.select("point_id")
    pairs = partners.join(ids.withColumnRenamed("point_id", "pre_id"), "pre_id", "left_semi").join(ids.withColumnRenamed("point_id", "post_id"), "post_id", "left_semi").select("pre_id", "post_id")
    used = pairs.select(F.col("pre_id").alias("point_id")).union(pairs.select("post_id"))
    return kept.join(used, "point_id", "left_semi"), pairs


def elements_to_points(elements: DataFrame) -> DataFrame:
    """Points of JSON elements (Pos, Kind, Tags, Prop): x, y, z, kind, user, conf, tags."""
    return elements.select(F.col("Pos")[2].alias("z"), F.col("Pos")[1].alias("y"), F.col("Pos")[0].alias("x"), F.col("Kind").alias("kind"), F.element_at("Prop", F.lit("user")).alias("user"), F.element_at("Prop", F.lit("conf")).cast("float").alias("conf"), F.col("Tags").alias("tags"))


def elements_to_relations(elements: DataFrame) -> DataFrame:
    """(from_z, from_y, from_x, to_z, to_y, to_x, rel) of elements' relations."""
    rows = elements.select("Pos", F.explode("Rels").alias("r"))
    return rows.select(*(F.col("Pos")[k].alias(f"from_{a}") for k, a in ((2, "z"), (1, "y"), (0, "x"))), *(F.col("r.To")[k].alias(f"to_{a}") for k, a in ((2, "z"), (1, "y"), (0, "x"))), F.col("r.Rel").alias("rel"))


def points_to_elements(points: DataFrame, partners: DataFrame) -> DataFrame:
    """JSON elements of a synapse table: positions, kinds, properties and relations to partners."""
    at = F.array("x", "y", "z")
    pos = points.select("point_id", at.alias("at"))
    rel = partners.join(pos.select(F.col("point_id").alias("post_id"), F.col("at").alias("to")), "post_id").select(F.col("pre_id").alias("point_id"), F.struct(F.lit("PreSynTo").alias("Rel"), F.col("to").alias("To")).alias("r"))
    rev = partners.join(pos.select(F.col("point_id").alias("pre_id"), F.col("at").alias("to")), "pre_id").select(F.col("post_id").alias("point_id"), F.struct(F.lit("PostSynTo").alias("Rel"), F.col("to").alias("To")).alias("r"))
    rels = rel.union(rev).groupBy("point_id").agg(F.array_sort(F.collect_list("r")).alias("Rels"))
    prop = F.create_map(F.lit("conf"), F.col("conf").cast("string"), F.lit("user"), F.coalesce(F.col("user"), F.lit("")))
    return points.join(rels, "point_id", "left").select(at.alias("Pos"), F.col("kind").alias("Kind"), F.array().cast("array<string>").alias("Tags"), prop.alias("Prop"), F.coalesce("Rels", F.array().cast("array<struct<Rel:string,To:array<int>>>")).alias("Rels"))


def parse_elements(lines: DataFrame, column: str = "value") -> DataFrame:
    """Elements of JSON texts, one array or object a line."""
    schema = "array<struct<Pos:array<int>,Kind:string,Tags:array<string>,Prop:map<string,string>,Rels:array<struct<Rel:string,To:array<int>>>>>"
    text = F.when(F.ltrim(column).startswith("{"), F.concat(F.lit("["), F.col(column), F.lit("]"))).otherwise(F.col(column))
    return lines.select(F.explode(F.from_json(text, schema)).alias("e")).select("e.*")


def prop_columns(elements: DataFrame, props: list[str]) -> DataFrame:
    """Properties as columns."""
    return elements.withColumns({p: F.element_at("Prop", F.lit(p)) for p in props})


def tiebars_to_tables(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Points and partners of files that list T-bars with their partners: data[].T-bar{location, confidence}, partners[]. A place counts once for each kind."""
    from ..functions.coords import pack_point

    place = "location:array<int>,confidence:string"
    schema = f"struct<data:array<struct<`T-bar`:struct<{place}>,partners:array<struct<{place}>>>>>"
    rows = lines.select(F.explode(F.from_json("value", schema)["data"]).alias("d"))
    at = lambda c: pack_point(c["location"][2], c["location"][1], c["location"][0])

    def point(c: Column, kind: str) -> list[Column]:
        return [at(c).alias("point_id"), c["location"][2].alias("z"), c["location"][1].alias("y"), c["location"][0].alias("x"), F.lit(kind).alias("kind"), c["confidence"].cast("float").alias("conf")]

    bar = F.col("d")["T-bar"]
    pres = rows.select(*point(bar, PRE))
    each = rows.select(bar.alias("bar"), F.explode(F.col("d")["partners"]).alias("p"))
    return pres.union(each.select(*point(F.col("p"), POST))).dropDuplicates(["z", "y", "x", "kind"]), each.select(at(F.col("bar")).alias("pre_id"), at(F.col("p")).alias("post_id"))
