"""Queries of store operations, element files, indexes and refreshed tables over the driver's tables, with their SQL.

Orders are pre points and line items post points; customers are bodies, parts and suppliers supervoxels.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog import _t
from .operators import annotations, contacts, geometry, log, mergetable, synapses
from .operators.graph import shared_path
from .operators.tables import unordered_duplicated
from .sources import sinks, store, tables
from .streaming import log as stream

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
c = F.col


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _points(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    item, order = _t(spark, sf_dir, "lineitem"), _t(spark, sf_dir, "orders")
    pre = order.select((-c("o_orderkey")).alias("point_id"), F.lit(0).alias("z"), c("o_custkey").cast("int").alias("y"), c("o_orderkey").cast("int").alias("x"), F.lit("PreSyn").alias("kind"), F.lit(0.9).alias("conf"), c("o_orderpriority").alias("user"), c("o_custkey").alias("body"), c("o_orderstatus").alias("roi"))
    one = item.groupBy("l_orderkey", "l_linenumber").agg(F.min("l_suppkey").alias("s"), F.min("l_discount").alias("conf"), F.min("l_returnflag").alias("user"))
    post_id = c("l_orderkey") * 8 + c("l_linenumber")
    post = one.select(post_id, F.lit(1), c("s").cast("int"), post_id.cast("int"), F.lit("PostSyn"), "conf", "user", "s", "user")
    return pre.union(post), one.select((-c("l_orderkey")).alias("pre_id"), post_id.alias("post_id"))


_POINTS = """
p AS MATERIALIZED (SELECT -o_orderkey AS point_id, 0 AS z, CAST(o_custkey AS INT) AS y, CAST(o_orderkey AS INT) AS x, 'PreSyn' AS kind, 0.9::DOUBLE AS conf, o_orderpriority AS user, o_custkey AS body, o_orderstatus AS roi FROM orders
 UNION ALL SELECT l_orderkey * 8 + l_linenumber, 1, CAST(min(l_suppkey) AS INT), CAST(l_orderkey * 8 + l_linenumber AS INT), 'PostSyn', min(l_discount), min(l_returnflag), min(l_suppkey), min(l_returnflag) FROM lineitem GROUP BY l_orderkey, l_linenumber),
r AS MATERIALIZED (SELECT DISTINCT -l_orderkey AS pre_id, l_orderkey * 8 + l_linenumber AS post_id FROM lineitem),
f AS MATERIALIZED (SELECT a.z AS from_z, a.y AS from_y, a.x AS from_x, b.z AS to_z, b.y AS to_y, b.x AS to_x FROM r JOIN p a ON a.point_id = pre_id JOIN p b ON b.point_id = post_id),
e AS MATERIALIZED (SELECT *, 'PreSynTo' AS rel FROM f UNION ALL SELECT to_z, to_y, to_x, from_z, from_y, from_x, 'PostSynTo' FROM f)"""


def _elements(spark, sf_dir) -> DataFrame:
    """Elements as they are read from JSON lines."""
    made = synapses.points_to_elements(*_points(spark, sf_dir))
    return synapses.parse_elements(made.select(F.to_json(F.struct(*made.columns)).alias("value")))


@query(f'WITH {_POINTS} SELECT z, y, x, kind, "user", CAST(conf AS FLOAT) AS conf, 0 AS n_tags FROM p')
def element_points(spark, sf_dir):
    """Points of JSON elements."""
    return synapses.elements_to_points(_elements(spark, sf_dir)).withColumn("n_tags", F.size("tags")).drop("tags")


@query(f"WITH {_POINTS} SELECT * FROM e")
def element_relations(spark, sf_dir):
    """Relations of JSON elements, from both ends."""
    return synapses.elements_to_relations(_elements(spark, sf_dir))


@query(f"WITH {_POINTS} SELECT (x >> 6) || ',' || (y >> 6) || ',' || (z >> 6) AS key, count(*) AS n FROM p GROUP BY 1")
def elements_by_block(spark, sf_dir):
    """How many elements the JSON of each block holds."""
    got = store.elements_by_block(_elements(spark, sf_dir))
    return got.select("key", F.json_array_length("elements").cast("long").alias("n"))


@query(f"""
WITH {_POINTS}, d AS (SELECT from_z AS z, from_y AS y, from_x AS x, count(*) AS rels FROM e WHERE rel = 'PreSynTo' GROUP BY ALL UNION ALL SELECT from_z, from_y, from_x, 1 FROM e WHERE rel = 'PostSynTo')
SELECT (x >> 6) || ',' || (y >> 6) || ',' || (z >> 6) AS block, count(*) AS n, CAST(sum(rels) AS BIGINT) AS rels FROM d GROUP BY 1""")
def element_documents(spark, sf_dir):
    """Elements and relations in the JSON documents of blocks, made from a partner table."""
    points, partners = _points(spark, sf_dir)
    side = lambda s: points.select(c("point_id").alias(f"{s}_id"), *(c(a).alias(f"{a}_{s}") for a in "zyx"))
    docs = sinks.element_documents(partners.join(side("pre"), "pre_id").join(side("post"), "post_id"))
    back = docs.select("block", F.explode(F.from_json("doc", "array<struct<Kind:string,Rels:array<struct<Rel:string>>>>")).alias("e"))
    return back.groupBy("block").agg(F.count("*").alias("n"), F.sum(F.size("e.Rels")).alias("rels"))


@query(f"WITH {_POINTS} SELECT point_id, z, y, x FROM p WHERE z = 1 AND y BETWEEN 2 AND 7 AND x BETWEEN 64 AND 4095")
def elements_in_box(spark, sf_dir):
    """Points of a half-open box."""
    return store.in_box(_points(spark, sf_dir)[0], {"z": (1, 2), "y": (2, 8), "x": (64, 4096)}).select("point_id", "z", "y", "x")


@query(f"WITH {_POINTS} SELECT point_id, kind FROM p WHERE (z, y, x) IN (SELECT (0, CAST(l_partkey AS INT), CAST(l_orderkey AS INT)) FROM lineitem)")
def elements_at_points(spark, sf_dir):
    """Points at exactly the places where a line's part is of its order's customer's number."""
    at = _t(spark, sf_dir, "lineitem").select(F.lit(0).alias("z"), c("l_partkey").cast("int").alias("y"), c("l_orderkey").cast("int").alias("x"))
    return store.at_points(_points(spark, sf_dir)[0], at).select("point_id", "kind")


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE 'R' IN (l_returnflag, l_linestatus) OR 'O' IN (l_returnflag, l_linestatus)")
def elements_with_tags(spark, sf_dir):
    """Line items with either of two tags."""
    rows = _t(spark, sf_dir, "lineitem").withColumn("Tags", F.array("l_returnflag", "l_linestatus"))
    one, two = store.with_tag(rows, "R"), store.with_tag(store.with_tag(rows, "O").where(~F.array_contains("Tags", "R")), "O")
    return one.union(two).select("l_orderkey", "l_linenumber", "l_partkey")


_FIRST = "(SELECT min(l_orderkey) FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"


def _first_element(spark, sf_dir) -> tuple[int, int, int]:
    item, order = _t(spark, sf_dir, "lineitem"), _t(spark, sf_dir, "orders")
    q = item.join(order, item.l_orderkey == order.o_orderkey).agg(F.min(F.struct("o_orderkey", "o_custkey")).alias("k")).first().k
    return q.o_orderkey, q.o_custkey, 0


@query(f"""
WITH {_POINTS}, k AS (SELECT from_z, from_y, from_x, to_z, to_y, to_x, rel, from_z = 0 AND from_x = {_FIRST} AS own, to_z = 0 AND to_x = {_FIRST} AS far FROM e)
SELECT if(own, 5, from_z) AS from_z, if(own, 7, from_y) AS from_y, if(own, -1, from_x) AS from_x, if(far, 5, to_z) AS to_z, if(far, 7, to_y) AS to_y, if(far, -1, to_x) AS to_x, rel FROM k""")
def moved_element_relations(spark, sf_dir):
    """Relations after the first order's element moved."""
    return synapses.elements_to_relations(store.move_element(_elements(spark, sf_dir), _first_element(spark, sf_dir), (-1, 7, 5)))


@query(f"WITH {_POINTS} SELECT * FROM e WHERE NOT (from_z = 0 AND from_x = {_FIRST}) AND NOT (to_z = 0 AND to_x = {_FIRST})")
def deleted_element_relations(spark, sf_dir):
    """Relations after the first order's element was deleted."""
    return synapses.elements_to_relations(store.delete_element(_elements(spark, sf_dir), _first_element(spark, sf_dir)))


@query(f"""
WITH {_POINTS}, k AS (SELECT * FROM p WHERE body <> 0 AND ((kind = 'PreSyn' AND conf >= 0.5) OR (kind = 'PostSyn' AND conf >= 0.03)) AND roi IN ('F', 'O', 'A', 'N'))
SELECT a.point_id AS pre_id, b.point_id AS post_id, a.body AS body_pre, b.body AS body_post FROM r JOIN k a ON a.point_id = pre_id JOIN k b ON b.point_id = post_id""")
def filtered_synapses(spark, sf_dir):
    """Partners whose ends are confident and in regions, with their bodies."""
    kept, pairs = synapses.filtered(*_points(spark, sf_dir), 0.5, 0.03, ["F", "O", "A", "N"])
    side = lambda s: kept.select(c("point_id").alias(f"{s}_id"), c("body").alias(f"body_{s}"))
    return pairs.join(side("pre"), "pre_id").join(side("post"), "post_id").select("pre_id", "post_id", "body_pre", "body_post")


_BARS = "b AS MATERIALIZED (SELECT DISTINCT o_orderkey, o_custkey, l_linenumber, l_suppkey, l_discount FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"


@query(f"""
WITH {_BARS}, p AS (SELECT DISTINCT 1 AS z, o_custkey AS y, o_orderkey AS x, 'PreSyn' AS kind, CAST(0.75 AS FLOAT) AS conf FROM b),
s AS (SELECT 2 AS z, l_suppkey AS y, o_orderkey * 8 + l_linenumber AS x, 'PostSyn' AS kind, 0.25 AS conf FROM b GROUP BY ALL)
SELECT z, CAST(y AS INT) AS y, CAST(x AS INT) AS x, kind, conf FROM p UNION ALL SELECT z, CAST(y AS INT), CAST(x AS INT), kind, CAST(conf AS FLOAT) FROM s""")
def bars_with_partners(spark, sf_dir):
    """Points of files that list each order's bar with its partners."""
    item, order = _t(spark, sf_dir, "lineitem"), _t(spark, sf_dir, "orders")
    place = lambda z, y, x, conf: F.struct(F.array(x, y, F.lit(z)).alias("location"), F.lit(conf).alias("confidence"))
    rows = item.join(order, item.l_orderkey == order.o_orderkey).groupBy("o_orderkey", "o_custkey").agg(F.collect_list(place(2, c("l_suppkey"), c("o_orderkey") * 8 + c("l_linenumber"), "0.25")).alias("partners"))
    one = F.struct(place(1, c("o_custkey"), c("o_orderkey"), "0.75").alias("T-bar"), "partners")
    points, _ = synapses.tiebars_to_tables(rows.select(F.to_json(F.struct(F.array(one).alias("data"))).alias("value")))
    return points.drop("point_id")


@query("SELECT o_custkey AS label FROM orders WHERE o_custkey >= 20 GROUP BY 1 ORDER BY 1 LIMIT 50")
def label_page(spark, sf_dir):
    """The next 50 labels from 20 on."""
    return store.label_page(_t(spark, sf_dir, "orders").select(c("o_custkey").alias("label")).distinct(), 20, 50)


@query("SELECT max(c_custkey) AS max_label FROM customer WHERE c_nationkey = (SELECT min(c_nationkey) FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey = 2)")
def nearest_max_label(spark, sf_dir):
    """The greatest customer of the nearest version of one region that has any."""
    maxima = _t(spark, sf_dir, "customer").groupBy(c("c_nationkey").alias("uuid")).agg(F.max("c_custkey").alias("max_label"))
    return store.max_label(maxima, _t(spark, sf_dir, "nation").where("n_regionkey = 2").select(c("n_nationkey").alias("node"), c("n_nationkey").alias("depth")))


@query("""
WITH v AS (SELECT c_nationkey AS uuid, c_mktsegment AS key, min(c_acctbal) AS value, min(c_acctbal) < -980 AS deleted FROM customer GROUP BY ALL),
n AS (SELECT v.*, row_number() OVER (PARTITION BY key ORDER BY uuid) AS k FROM v JOIN nation ON uuid = n_nationkey WHERE n_regionkey = 1)
SELECT uuid, key, value FROM n WHERE k = 1 AND NOT deleted""")
def values_of_version(spark, sf_dir):
    """What a version sees of keys that its ancestors wrote or deleted."""
    rows = _t(spark, sf_dir, "customer").groupBy(c("c_nationkey").alias("uuid"), c("c_mktsegment").alias("key")).agg(F.min("c_acctbal").alias("value")).withColumn("deleted", c("value") < -980)
    return store.current(rows, _t(spark, sf_dir, "nation").where("n_regionkey = 1").select(c("n_nationkey").alias("node"), c("n_nationkey").alias("depth")), ["key"])


@query("SELECT o_orderkey, replace(o_orderpriority, 'MEDIUM', 'MIDDLE') AS o_orderpriority FROM orders WHERE o_orderpriority LIKE '%MEDIUM%'")
def changed_values(spark, sf_dir):
    """Values of a new table that differ from the old one's."""
    old = _t(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    return store.changed_only(old, old.withColumn("o_orderpriority", F.regexp_replace("o_orderpriority", "MEDIUM", "MIDDLE")), "o_orderkey", "o_orderpriority")


@query("WITH v AS (SELECT l_orderkey AS key, l_suppkey AS v FROM lineitem UNION SELECT l_orderkey, l_linenumber FROM lineitem) SELECT key, count(*) AS n, CAST(sum(v) AS BIGINT) AS total FROM v GROUP BY 1")
def extended_lists(spark, sf_dir):
    """Orders' lists of suppliers, extended by line numbers."""
    item = _t(spark, sf_dir, "lineitem")
    of = lambda x: item.groupBy(c("l_orderkey").alias("key")).agg(F.collect_list(c(x).cast("long")).alias("value"))
    got = store.extend_lists(of("l_suppkey"), of("l_linenumber"))
    return got.select("key", F.size("value").cast("long").alias("n"), F.aggregate("value", F.lit(0).cast("long"), lambda a, v: a + v).alias("total"))


def _index(spark, sf_dir) -> DataFrame:
    rows = _t(spark, sf_dir, "lineitem").select(c("l_suppkey").alias("label"), (c("l_linenumber") * 64).alias("z"), (F.expr("l_partkey div 16") * 64).cast("int").alias("y"), F.lit(0).alias("x"), c("l_partkey").alias("sv"))
    return rows.groupBy("label", "z", "y", "x", "sv").agg(F.count("*").alias("count"))


_INDEX = "SELECT l_suppkey AS label, l_linenumber * 64 AS z, CAST(l_partkey // 16 * 64 AS INT) AS y, 0 AS x, l_partkey AS sv, count(*) AS count FROM lineitem GROUP BY ALL"


@query(f"{_INDEX}")
def label_index_rows(spark, sf_dir):
    """Label indexes nested by block and read again."""
    got = tables.flatten_index(tables.nest_index(_index(spark, sf_dir)))
    return got.select("label", *(c(a).cast("int").alias(a) for a in "zyx"), "sv", "count")


@query(f"SELECT DISTINCT label, z, y, x FROM ({_INDEX})")
def coarse_blocks(spark, sf_dir):
    """Blocks of each label."""
    return store.coarse_blocks(_index(spark, sf_dir))


@query("SELECT DISTINCT CAST(p_size AS BIGINT) AS body, p_name || '-' || p_partkey || '.ngmesh' AS name, p_brand AS data FROM part")
def tar_members(spark, sf_dir):
    """Parts' files, packed into a tar for each size and read again."""
    files = _t(spark, sf_dir, "part").select(c("p_size").cast("long").alias("body"), F.concat("p_name", F.lit("-"), c("p_partkey").cast("string"), F.lit(".ngmesh")).alias("name"), c("p_brand").cast("binary").alias("data"))
    return store.untar_files(store.tar_files(files), suffix=".ngmesh").withColumn("data", c("data").cast("string"))


@query("SELECT l_returnflag AS user, l_suppkey AS body, (l_linenumber + 7) / 2.0::DOUBLE AS z, l_suppkey::DOUBLE AS y, (l_quantity + l_linenumber) / 2 AS x, sqrt((l_quantity - l_linenumber) ** 2 + (l_linenumber - 7) ** 2) AS diameter FROM lineitem")
def sphere_annotations(spark, sf_dir):
    """Centres and diameters of spheres, from JSON values under users' keys."""
    item = _t(spark, sf_dir, "lineitem")
    ends = F.array(F.array("l_quantity", c("l_suppkey").cast("double"), c("l_linenumber").cast("double")), F.array(c("l_linenumber").cast("double"), c("l_suppkey").cast("double"), F.lit(7.0)))
    return store.sphere_annotations(item.select(F.concat_ws("-", "l_returnflag", "l_orderkey", "l_linenumber").alias("key"), F.to_json(F.struct(ends.alias("ends"), c("l_suppkey").alias("body"))).alias("value")))


@query("SELECT c_custkey AS body, coalesce(nullif(c_mktsegment, 'MACHINERY'), '') AS status, c_acctbal AS score, CASE c_mktsegment WHEN 'MACHINERY' THEN 0 WHEN 'BUILDING' THEN 1 WHEN 'AUTOMOBILE' THEN 2 END AS status_rank FROM customer")
def body_annotation_ranks(spark, sf_dir):
    """Annotations of bodies with ranked statuses, from JSON values."""
    kv = _t(spark, sf_dir, "customer").select(c("c_custkey").cast("string").alias("key"), F.to_json(F.struct(F.when(c("c_mktsegment") != "MACHINERY", c("c_mktsegment")).alias("status"), c("c_acctbal").alias("score"))).alias("value"))
    return store.body_annotations(kv, "status string, score double", ["", "BUILDING", "AUTOMOBILE"])


@query("SELECT o_orderkey AS mutid, o_custkey AS target_body FROM orders WHERE o_custkey = 7 OR o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_suppkey = 7)")
def body_history(spark, sf_dir):
    """Orders whose customer or suppliers are body 7."""
    item, order = _t(spark, sf_dir, "lineitem"), _t(spark, sf_dir, "orders")
    merged = item.groupBy(c("l_orderkey").alias("o_orderkey")).agg(F.collect_set("l_suppkey").alias("merged"))
    rows = order.join(merged, "o_orderkey", "left").select(c("o_orderkey").alias("mutid"), c("o_custkey").alias("target_body"), F.lit(None).cast("long").alias("child_body"), "merged")
    return store.history_of(rows, 7).select("mutid", "target_body")


@query("SELECT o_orderkey, n_nationkey AS uuid FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE n_nationkey IN (0, 1, 2, 5, 11, 23)")
def log_of_versions(spark, sf_dir):
    """Orders of a version and its ancestors; a nation's parent is half its number."""
    order, cust, nation = (_t(spark, sf_dir, n) for n in ("orders", "customer", "nation"))
    rows = order.join(cust, order.o_custkey == cust.c_custkey).select("o_orderkey", c("c_nationkey").alias("uuid"))
    edges = nation.where("n_nationkey > 0").select(c("n_nationkey").alias("node"), F.expr("cast(n_nationkey div 2 as int)").alias("parent"))
    return log.of_versions(rows, edges, nation.where("n_nationkey = 23").select(c("n_nationkey").alias("node")))


@query("""
WITH v AS (SELECT l_suppkey AS y, l_partkey // 2 AS x, min(l_linenumber) AS label FROM lineitem GROUP BY ALL)
SELECT o_orderkey, coalesce(label, 0) AS label FROM orders LEFT JOIN v ON y = o_custkey // 2 AND x = o_orderkey // 2""")
def labels_at_points(spark, sf_dir):
    """Labels of an image at half resolution under orders' points."""
    vox = _t(spark, sf_dir, "lineitem").groupBy(F.lit(0).alias("z"), c("l_suppkey").alias("y"), F.expr("l_partkey div 2").alias("x")).agg(F.min("l_linenumber").alias("label"))
    points = _t(spark, sf_dir, "orders").select("o_orderkey", F.lit(1).alias("z"), c("o_custkey").alias("y"), c("o_orderkey").alias("x"))
    return geometry.points_to_labels(points, vox, 1).select("o_orderkey", "label")


def _regions(spark, sf_dir) -> DataFrame:
    voxels = _t(spark, sf_dir, "lineitem").select(c("l_returnflag").alias("roi"), c("l_linenumber").alias("z"), c("l_suppkey").alias("y"), c("l_partkey").alias("x"))
    return geometry.encode_runs(voxels, ["roi"])


_CELLS = "v AS MATERIALIZED (SELECT DISTINCT l_returnflag AS roi, l_linenumber AS z, l_suppkey AS y, l_partkey AS x FROM lineitem)"


@query(f"WITH {_CELLS} SELECT roi, count(*) AS blocks FROM v GROUP BY 1")
def region_sizes(spark, sf_dir):
    """Blocks of each region, from runs."""
    return geometry.region_sizes(_regions(spark, sf_dir))


@query(f"WITH {_CELLS} SELECT a.roi AS roi_a, b.roi AS roi_b, count(*) AS blocks FROM v a JOIN v b USING (z, y, x) WHERE a.roi < b.roi GROUP BY ALL")
def region_overlaps(spark, sf_dir):
    """Blocks that regions share."""
    return geometry.region_overlaps(_regions(spark, sf_dir))


@query(f"WITH {_CELLS} SELECT z, y, x, string_agg(roi, '+' ORDER BY roi) AS roi FROM v GROUP BY ALL")
def combined_regions(spark, sf_dir):
    """One name a block, of all regions that hold it."""
    return geometry.combined_regions(_regions(spark, sf_dir), joint=True).select(*(c(a).cast("long").alias(a) if a != "z" else c(a) for a in "zyx"), "roi")


@query(f"""
WITH {_CELLS}, b AS (SELECT o_custkey AS body, o_custkey % 7 * 64 AS z, o_custkey // 8 * 64 AS y, o_orderkey // 8 * 64 AS x, count(*) AS n FROM orders GROUP BY ALL), m AS (SELECT z, y, x, max(roi) AS roi FROM v GROUP BY ALL)
SELECT body, coalesce(roi, '<unspecified>') AS roi, CAST(sum(n) AS BIGINT) AS voxels FROM b LEFT JOIN m ON m.z = (b.z + 32) >> 5 AND m.y = (b.y + 32) >> 5 AND m.x = (b.x + 32) >> 5 GROUP BY ALL""")
def region_distributions(spark, sf_dir):
    """Voxels of customers by the region of their blocks' centres."""
    blocks = _t(spark, sf_dir, "orders").groupBy(c("o_custkey").alias("body"), (c("o_custkey") % 7 * 64).alias("z"), F.expr("o_custkey div 8 * 64").alias("y"), F.expr("o_orderkey div 8 * 64").alias("x")).agg(F.count("*").alias("n"))
    return geometry.region_distributions(blocks, _regions(spark, sf_dir))


@query("""
WITH v AS MATERIALIZED (SELECT DISTINCT l_suppkey AS body, l_partkey AS sv, l_linenumber AS z, CAST(l_quantity AS BIGINT) AS y, l_partkey // 8 AS x FROM lineitem),
p AS (SELECT a.body, least(a.sv, b.sv) AS a, greatest(a.sv, b.sv) AS b, a.z, a.y, a.x FROM v a JOIN v b ON a.body = b.body AND a.sv <> b.sv AND b.z - a.z IN (0, 1) AND b.y - a.y IN (0, 1) AND b.x - a.x IN (0, 1))
SELECT body, a, b, first(z ORDER BY z, y, x) AS z, first(y ORDER BY z, y, x) AS y, first(x ORDER BY z, y, x) AS x FROM p GROUP BY ALL""")
def missing_adjacencies(spark, sf_dir):
    """Parts of one supplier in like or neighbouring blocks, with the first place."""
    rows = _t(spark, sf_dir, "lineitem").select(c("l_suppkey").alias("body"), c("l_partkey").alias("sv"), c("l_linenumber").alias("bz"), c("l_quantity").cast("long").alias("by"), F.expr("l_partkey div 8").alias("bx")).distinct()
    return geometry.missing_adjacencies(rows)


@query("SELECT l_orderkey, l_linenumber, l_partkey AS sv, coalesce(p_size, l_partkey) AS small, coalesce(s_nationkey, l_partkey) AS large FROM lineitem LEFT JOIN part ON l_partkey = p_partkey AND p_size < 25 LEFT JOIN supplier ON l_partkey = s_suppkey")
def several_mappings(spark, sf_dir):
    """Bodies of parts in two mappings."""
    part, supp = _t(spark, sf_dir, "part"), _t(spark, sf_dir, "supplier")
    maps = {"small": part.where("p_size < 25").select(c("p_partkey").alias("sv"), c("p_size").cast("long").alias("body")), "large": supp.select(c("s_suppkey").alias("sv"), c("s_nationkey").cast("long").alias("body"))}
    return mergetable.apply_mappings(_t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", c("l_partkey").alias("sv")), maps)


@query("""
WITH p AS (SELECT l_orderkey * 8 + l_linenumber AS point_id, max(l_partkey) AS sv, min(l_suppkey) AS fresh FROM lineitem GROUP BY 1)
SELECT point_id, if(sv IN (SELECT p_partkey FROM part WHERE p_size < 20), fresh, sv) AS sv FROM p""")
def refreshed_points(spark, sf_dir):
    """Points on stale supervoxels take those looked up anew."""
    rows = _t(spark, sf_dir, "lineitem").groupBy((c("l_orderkey") * 8 + c("l_linenumber")).alias("point_id")).agg(F.max("l_partkey").alias("sv"), F.min("l_suppkey").alias("fresh"))
    stale = _t(spark, sf_dir, "part").where("p_size < 20").select(c("p_partkey").alias("sv"))
    return mergetable.refresh(rows.select("point_id", "sv"), stale, rows.select("point_id", c("fresh").alias("sv")))


@query("""
WITH n AS (SELECT p_partkey AS sv, p_partkey + p_size % 4 AS new_sv FROM part), t AS (SELECT p_partkey AS sv, p_partkey // 4 AS root FROM part),
e AS (SELECT l_orderkey, l_linenumber, l_partkey AS id_a, l_suppkey AS id_b, l_linenumber AS body, coalesce(na.new_sv, l_partkey) AS a, coalesce(nb.new_sv, l_suppkey) AS b FROM lineitem LEFT JOIN n na ON na.sv = l_partkey LEFT JOIN n nb ON nb.sv = l_suppkey),
s AS (SELECT e.*, coalesce(o1.root, id_a) = coalesce(o2.root, a) AND coalesce(o3.root, id_b) = coalesce(o4.root, b) AS same FROM e LEFT JOIN t o1 ON o1.sv = id_a LEFT JOIN t o2 ON o2.sv = a LEFT JOIN t o3 ON o3.sv = id_b LEFT JOIN t o4 ON o4.sv = b)
SELECT l_orderkey, l_linenumber, if(same, a, id_a) AS id_a, if(same, b, id_b) AS id_b, if(same, body, 0) AS body FROM s""")
def refreshed_edges(spark, sf_dir):
    """Edges whose ends were split, with ends looked up anew within their split roots."""
    part = _t(spark, sf_dir, "part")
    edges = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", c("l_partkey").alias("id_a"), c("l_suppkey").alias("id_b"), c("l_linenumber").cast("long").alias("body"))
    return mergetable.refresh_edges(edges, part.select(c("p_partkey").alias("sv"), F.expr("p_partkey div 4").alias("root")), part.select(c("p_partkey").alias("sv"), (c("p_partkey") + c("p_size") % 4).alias("new_sv")))


@query("""
SELECT l_partkey AS id_a, l_suppkey AS id_b, CAST(l_discount AS FLOAT) AS score FROM lineitem
UNION ALL SELECT o_custkey, o_orderkey, CAST(0.01 AS FLOAT) FROM orders WHERE o_orderstatus IN ('F', 'O')""")
def appended_decisions(spark, sf_dir):
    """Edges with decided merges."""
    edges = _t(spark, sf_dir, "lineitem").select(c("l_partkey").alias("id_a"), c("l_suppkey").alias("id_b"), c("l_discount").cast("float").alias("score"))
    said = F.when(c("o_orderstatus") == "F", "merge").when(c("o_orderstatus") == "O", "mergeLater").otherwise("dontMerge")
    return mergetable.append_decisions(edges, _t(spark, sf_dir, "orders").select(c("o_custkey").alias("id_a"), c("o_orderkey").alias("id_b"), said.alias("result"), F.lit(0.5).alias("score")))


@query("SELECT c_custkey AS body FROM customer WHERE (c_acctbal > 5000 OR c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)) AND c_mktsegment <> 'MACHINERY'")
def focused_bodies(spark, sf_dir):
    """Bodies that are large or busy, without bad ones."""
    cust, order = _t(spark, sf_dir, "customer"), _t(spark, sf_dir, "orders")
    busy = order.join(cust, order.o_custkey == cust.c_custkey).where("o_totalprice > 200000").select(c("c_custkey").alias("body"))
    of = lambda cond: cust.where(cond).select(c("c_custkey").alias("body"))
    return mergetable.focused_bodies(busy, of("c_acctbal > 5000"), of("c_mktsegment = 'MACHINERY'"))


@query("""
WITH m AS (SELECT c_nationkey AS mergeset, c_custkey AS body, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal > 0 DESC, c_custkey) AS k, count(*) OVER (PARTITION BY c_nationkey) AS n FROM customer),
t AS (SELECT mergeset, max(CASE WHEN k = 1 THEN body END) AS target FROM m WHERE n > 1 GROUP BY 1)
SELECT mergeset, target, string_agg(body::TEXT, ',' ORDER BY body) AS fragments FROM m JOIN t USING (mergeset) WHERE body <> target GROUP BY ALL""")
def merge_commands(spark, sf_dir):
    """One merge for each group, into its preferred body."""
    members = _t(spark, sf_dir, "customer").select(c("c_nationkey").alias("mergeset"), c("c_custkey").alias("body"), (c("c_acctbal") > 0).alias("good"))
    return mergetable.merge_commands(mergetable.mergeable_groups(members, ["good"])).withColumn("fragments", F.array_join(F.transform("fragments", lambda b: b.cast("string")), ","))


@query("SELECT l_orderkey, l_linenumber, l_returnflag, l_linestatus FROM lineitem WHERE l_returnflag <> '' AND l_linestatus <> '' AND l_returnflag <> l_linestatus AND l_returnflag <> 'A'")
def disagreements(spark, sf_dir):
    """Line items whose two flags are given and differ; flag A counts as none."""
    rows = _t(spark, sf_dir, "lineitem").withColumn("l_returnflag", F.when(c("l_returnflag") != "A", c("l_returnflag")).otherwise(""))
    return mergetable.disagreements(rows, "l_returnflag", "l_linestatus").select("l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus")


@query("SELECT c_custkey, nullif(c_mktsegment, 'BUILDING') AS a, CASE WHEN c_acctbal > 0 THEN c_acctbal END AS b FROM customer WHERE c_mktsegment <> 'BUILDING' OR c_acctbal > 0")
def rows_not_empty(spark, sf_dir):
    """Customers with a segment other than one, or with money."""
    rows = _t(spark, sf_dir, "customer").select("c_custkey", F.when(c("c_mktsegment") != "BUILDING", c("c_mktsegment")).alias("a"), F.when(c("c_acctbal") > 0, c("c_acctbal")).alias("b"))
    return mergetable.drop_empty(rows, ["a", "b"])


@query("SELECT o_orderkey, o_custkey AS body, coalesce(c_mktsegment, '') AS type FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND c_acctbal > 0")
def annotated_bodies(spark, sf_dir):
    """Orders with their customers' types, empty where there is none."""
    types = _t(spark, sf_dir, "customer").where("c_acctbal > 0").select(c("c_custkey").alias("body"), c("c_mktsegment").alias("type"))
    return mergetable.with_columns_of(_t(spark, sf_dir, "orders").select("o_orderkey", c("o_custkey").alias("body")), types, "body", {"type": ""})


_WEIGHTS = "w AS (SELECT o_custkey AS body, 'PreSynTo' AS rel, l_suppkey AS to_body, count(*) AS weight FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL UNION ALL SELECT l_suppkey, 'PostSynTo', o_custkey, count(*) FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL)"


@query(f"WITH {_WEIGHTS} SELECT body, to_body, weight, if(rel = 'PreSynTo', 'out', 'in') AS file FROM w")
def exported_inputs_outputs(spark, sf_dir):
    """What bodies receive and send, as the two files of an export."""
    item, order = _t(spark, sf_dir, "lineitem"), _t(spark, sf_dir, "orders")
    rows = item.join(order, item.l_orderkey == order.o_orderkey).groupBy("o_custkey", "l_suppkey").agg(F.count("*").alias("weight"))
    both = rows.select(c("o_custkey").alias("body"), F.lit("PreSynTo").alias("rel"), c("l_suppkey").alias("to_body"), "weight").union(rows.select("l_suppkey", F.lit("PostSynTo"), "o_custkey", "weight"))
    got, sent = sinks.export_inputs_outputs(sinks.export_relationships(both))
    return got.withColumn("file", F.lit("in")).union(sent.withColumn("file", F.lit("out")))


@query("SELECT l_suppkey AS segment, count(DISTINCT l_orderkey * 8 + l_linenumber) AS n, CAST(sum(DISTINCT l_orderkey * 8 + l_linenumber) AS BIGINT) AS total FROM lineitem GROUP BY 1")
def relationship_ids(spark, sf_dir):
    """Annotations that each segment has part in."""
    rows = _t(spark, sf_dir, "lineitem").select((c("l_orderkey") * 8 + c("l_linenumber")).alias("id"), "l_suppkey")
    got = annotations.relationship_index(rows, "l_suppkey")
    return got.select("segment", F.size("ids").cast("long").alias("n"), F.aggregate("ids", F.lit(0).cast("long"), lambda a, v: a + v).alias("total"))


@query("SELECT l_suppkey AS cell, l_orderkey * 8 + l_linenumber AS id, CAST(l_partkey AS FLOAT) AS x, CAST(l_quantity AS FLOAT) AS y, CAST(l_linenumber AS FLOAT) AS z, CAST(l_discount AS FLOAT) AS conf FROM lineitem")
def annotation_buffers(spark, sf_dir):
    """Line items as annotations in suppliers' binary buffers, read again."""
    rows = _t(spark, sf_dir, "lineitem").select(c("l_suppkey").alias("cell"), (c("l_orderkey") * 8 + c("l_linenumber")).alias("id"), c("l_partkey").alias("x"), c("l_quantity").alias("y"), c("l_linenumber").alias("z"), c("l_discount").alias("conf"))
    return annotations.decode_points(annotations.encode_points(rows, ["cell"], {"conf": "float32"}), ["cell"], ["conf"])


@query("SELECT s_suppkey AS segment, s_name AS name, CASE WHEN s_acctbal > 0 THEN s_acctbal END AS score, s_acctbal > 0 AS has_score FROM supplier")
def property_documents(spark, sf_dir):
    """Suppliers' properties, written to documents without nulls and read again."""
    rows = _t(spark, sf_dir, "supplier").select(c("s_suppkey").alias("segment"), c("s_name").alias("name"), F.when(c("s_acctbal") > 0, c("s_acctbal")).alias("score"))
    doc = annotations.property_document(rows, ["name", "score"])
    return doc.select("segment", F.from_json("doc", "name string, score double").alias("v"), c("doc").contains('"score"').alias("has_score")).select("segment", "v.*", "has_score")


@query("""
SELECT c_custkey AS body, coalesce(nullif(upper(c_mktsegment), 'MACHINERY'), c_mktsegment) AS type, c_acctbal AS score FROM customer WHERE FALSE
UNION ALL SELECT c_custkey, if(c_mktsegment = 'BUILDING', 'HOUSES', c_mktsegment), if(c_acctbal < 0, 0, c_acctbal) FROM customer WHERE c_mktsegment = 'BUILDING' OR c_acctbal < 0""")
def annotation_updates(spark, sf_dir):
    """Rows that differ from what is stored, where a value is given."""
    cust = _t(spark, sf_dir, "customer").select(c("c_custkey").alias("body"), c("c_mktsegment").alias("type"), c("c_acctbal").alias("score"))
    new = cust.select("body", F.when(c("type") == "BUILDING", "HOUSES").alias("type"), F.when(c("score") < 0, 0.0).otherwise(c("score")).alias("score"))
    return annotations.update_plan(new, cust, "body", ["type", "score"])


@query("SELECT c_custkey, CASE WHEN c_acctbal > 5000 THEN c_name WHEN c_mktsegment <> 'BUILDING' THEN c_mktsegment ELSE c_phone END AS label FROM (SELECT *, c_nationkey::TEXT AS c_phone FROM customer)")
def first_given_names(spark, sf_dir):
    """The first name given of three, in order of priority."""
    rows = _t(spark, sf_dir, "customer").select("c_custkey", F.when(c("c_acctbal") > 5000, c("c_name")).alias("a"), F.when(c("c_mktsegment") != "BUILDING", c("c_mktsegment")).otherwise("").alias("b"), c("c_nationkey").cast("string").alias("n"))
    return annotations.first_given(rows, "label", ["a", "b", "n"]).select("c_custkey", "label")


@query("""
WITH p AS (SELECT DISTINCT split_part(p_brand, '#', 1) AS a, p_type AS b FROM part), f AS (SELECT split_part(p_brand, '#', 1) AS a, p_type AS b FROM part)
SELECT '' AS folder, count(*) AS files FROM f UNION ALL SELECT a, count(*) FROM f GROUP BY 1 UNION ALL SELECT a || '/' || b, count(*) FROM f GROUP BY 1""")
def counted_files(spark, sf_dir):
    """Files below each folder, of a list of paths."""
    path = F.concat_ws("/", F.lit("/data"), F.substring_index("p_brand", "#", 1), "p_type", c("p_partkey").cast("string"))
    return tables.count_files(_t(spark, sf_dir, "part").select(path.alias("path")), "/data")


@query("SELECT CAST(l_partkey AS INT) AS x, l_linenumber AS y, CAST(l_suppkey AS INT) AS z, l_returnflag AS kind, CAST(l_discount AS FLOAT) AS conf, l_linestatus AS user, l_orderkey AS label FROM lineitem")
def csv_there_and_back(spark, sf_dir):
    """A point table through CSV files."""
    path = shared_path(spark)
    rows = _t(spark, sf_dir, "lineitem").select(c("l_partkey").alias("x"), c("l_linenumber").alias("y"), c("l_suppkey").alias("z"), c("l_returnflag").alias("kind"), c("l_discount").alias("conf"), c("l_linestatus").alias("user"), c("l_orderkey").alias("label"), c("l_orderkey").alias("body"), c("l_orderkey").alias("sv"))
    sinks.write_csv(rows, path)
    return tables.read_csv(spark, path, tables.POINT_CSV).drop("body", "sv")


@query("SELECT o_orderkey, o_custkey, o_orderpriority FROM orders")
def json_there_and_back(spark, sf_dir):
    """Orders through files of JSON lines."""
    path = shared_path(spark)
    sinks.write_json_lines(_t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority"), path)
    return spark.read.schema("o_orderkey long, o_custkey long, o_orderpriority string").json(path)


@query("""
WITH e AS (SELECT least(l_partkey, l_suppkey) AS a, greatest(l_partkey, l_suppkey) AS b, row_number() OVER (PARTITION BY least(l_partkey, l_suppkey), greatest(l_partkey, l_suppkey) ORDER BY l_orderkey, l_linenumber) AS k, l_orderkey, l_linenumber FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem))
SELECT k > 1 AS duplicated, count(*) AS n FROM e GROUP BY 1""")
def unordered_duplicates(spark, sf_dir):
    """How many pairs of part and supplier repeat an earlier one in either order."""
    rows = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").distinct()
    return unordered_duplicated(rows, ["l_partkey", "l_suppkey"], ["l_orderkey", "l_linenumber"]).groupBy("duplicated").agg(F.count("*").alias("n"))


@query("""
WITH v AS (SELECT DISTINCT l_returnflag AS sv, l_linenumber AS z, l_suppkey AS y, l_partkey AS x FROM lineitem),
g AS (SELECT sv, grid, z // grid AS cz, y // grid AS cy, x // grid AS cx, count(*) AS voxels FROM v, (VALUES (32), (16), (8)) s(grid) GROUP BY ALL),
p AS (SELECT *, if(grid = 32, 0, cz // 2) AS pz, if(grid = 32, 0, cy // 2) AS py, if(grid = 32, 0, cx // 2) AS px FROM g),
k AS (SELECT *, sum(voxels) OVER w AS parent_voxels, row_number() OVER (PARTITION BY sv, grid, pz, py, px ORDER BY cz DESC, cy DESC, cx DESC) = 1 AS remains FROM p WINDOW w AS (PARTITION BY sv, grid, pz, py, px))
SELECT sv, grid, CAST(cz AS BIGINT) AS bz, CAST(cy AS BIGINT) AS "by", CAST(cx AS BIGINT) AS bx, voxels, CAST(parent_voxels AS BIGINT) AS parent_voxels, remains FROM k""")
def grid_split_plan(spark, sf_dir):
    """Cuts of return flags' voxels along grids of 32, 16 and 8."""
    return contacts.grid_split_plan(_regions(spark, sf_dir).withColumnRenamed("roi", "sv"), 32, 8)


@query("""
WITH p AS (SELECT c_custkey AS id, 4 + c_nationkey % 9 AS z, c_custkey % 37 AS y, c_custkey AS x, c_nationkey % 4 AS r FROM customer),
d AS (SELECT range - 3 AS d FROM range(7)),
v AS (SELECT id, z + a.d AS z, y + b.d AS y, x + e.d AS x FROM p, d a, d b, d e WHERE a.d * a.d + b.d * b.d + e.d * e.d <= r * r)
SELECT z, y, x, max(id) AS label FROM v WHERE z BETWEEN 2 AND 11 AND y BETWEEN 0 AND 35 AND x >= 1 AND x < 100000 GROUP BY ALL""")
def placed_balls(spark, sf_dir):
    """Balls around customers' places in a box; of those that overlap the greatest customer stays."""
    p = _t(spark, sf_dir, "customer").select(c("c_custkey").alias("label"), c("c_custkey").alias("at"), (4 + c("c_nationkey") % 9).cast("long").alias("z"), (c("c_custkey") % 37).alias("y"), c("c_custkey").alias("x"), (c("c_nationkey") % 4).cast("long").alias("radius"))
    return contacts.placed_balls(p, ((2, 0, 1), (12, 36, 100000)), "at")


@query("""
WITH v AS (SELECT l_linenumber AS z, l_suppkey AS y, l_partkey AS x, max(l_orderkey) AS label FROM lineitem WHERE l_linenumber BETWEEN 1 AND 6 AND l_suppkey BETWEEN 1 AND 8 AND l_partkey BETWEEN 1 AND 19999 GROUP BY ALL),
d AS (SELECT range - 1 AS d FROM range(3)), n AS (SELECT z + a.d AS z, y + b.d AS y, x + e.d AS x, label FROM v, d a, d b, d e)
SELECT CAST(z AS INT) AS z, y, x, max(label) AS label FROM n WHERE z BETWEEN 1 AND 6 AND y BETWEEN 1 AND 8 AND x BETWEEN 1 AND 19999 GROUP BY ALL""")
def box_dilated(spark, sf_dir):
    """Labels grown by one voxel within a box."""
    vox = _t(spark, sf_dir, "lineitem").groupBy(c("l_linenumber").alias("z"), c("l_suppkey").alias("y"), c("l_partkey").alias("x")).agg(F.max("l_orderkey").alias("label"))
    return contacts.box_dilated(vox, 1, ((1, 1, 1), (7, 9, 20000)))


@query("SELECT o_orderkey, (o_totalprice - lo) / (hi - lo) AS o_totalprice FROM orders, (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders)")
def normalized_values(spark, sf_dir):
    """Prices scaled to 0..1."""
    return contacts.normalized(_t(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice")


@query()
def contact_points(spark, sf_dir):
    """Points where pairs of line numbers meet in an image of suppliers and parts, around each order's place."""
    vox = _t(spark, sf_dir, "lineitem").groupBy(F.lit(0).alias("z"), c("l_suppkey").alias("y"), F.expr("l_partkey div 4").alias("x")).agg(F.min("l_linenumber").alias("label"))
    order = _t(spark, sf_dir, "orders")
    at = [F.lit(0).alias("z1"), (c("o_custkey") % 16).alias("y1"), F.expr("o_custkey div 4").alias("x1"), F.lit(0).alias("z2"), (c("o_custkey") % 16).alias("y2"), F.expr("o_custkey div 4").alias("x2")]
    return contacts.contact_points(order.select(c("o_orderkey").alias("task"), (1 + c("o_custkey") % 3).cast("int").alias("label_1"), (4 + c("o_orderkey") % 3).cast("int").alias("label_2"), *at), vox, 1, 8)


_MAPPED = "SELECT l_partkey AS id_a, l_suppkey AS id_b, if(a.p_size % 5 = b.p_size % 5, a.p_size % 5, 0) AS body FROM lineitem JOIN part a ON a.p_partkey = l_partkey JOIN part b ON b.p_partkey = l_suppkey"


@query(f"SELECT id_a, id_b FROM ({_MAPPED}) WHERE body = 3")
def edges_of_body(spark, sf_dir):
    """Edges within one body."""
    edges = _t(spark, sf_dir, "lineitem").select(c("l_partkey").alias("id_a"), c("l_suppkey").alias("id_b"))
    part = _t(spark, sf_dir, "part").select(c("p_partkey").alias("sv"), (c("p_size") % 5).cast("long").alias("body"))
    return mergetable.edges_of_body(mergetable.apply_mapping(edges, part), 3).select("id_a", "id_b")


@query("SELECT l_orderkey, l_linenumber, l_partkey AS id_a, l_suppkey AS id_b FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size < 20) AND l_suppkey IN (SELECT p_partkey FROM part WHERE p_size < 20)")
def edges_within(spark, sf_dir):
    """Edges with both ends among small parts."""
    edges = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", c("l_partkey").alias("id_a"), c("l_suppkey").alias("id_b"))
    return mergetable.edges_within(edges, _t(spark, sf_dir, "part").where("p_size < 20").select(c("p_partkey").alias("sv")))


@query("SELECT o_custkey, max(o_orderkey) AS o_orderkey, last(o_orderpriority ORDER BY o_orderkey) AS o_orderpriority FROM orders GROUP BY 1")
def stream_upserted(spark, sf_dir):
    """Each customer's last order, kept by a stream of orders in buckets of a table."""
    path = shared_path(spark)
    s = stream.table_stream(spark, f"{sf_dir}/orders.parquet").select("o_custkey", "o_orderkey", "o_orderpriority")
    stream.upserts(s, f"{path}/table", ["o_custkey"], "o_orderkey", f"{path}/state").awaitTermination()
    return stream.upserted(spark, f"{path}/table", s.schema)
