"""Queries of proofreading operators and file formats over the driver's tables, with their SQL.

Customers and suppliers are bodies, their nations types; customers of the lowest balances have none and are orphans.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .catalog import _t
from .operators import autoproof, geometry, organelles, slabs
from .operators.graph import settle
from .sources import formats, tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _network(spark, sf_dir) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Connections from customers to suppliers, types of both, and orphans in each region that they have."""
    item, order, cust, supp = (_t(spark, sf_dir, n) for n in ("lineitem", "orders", "customer", "supplier"))
    rel = item.join(order, item.l_orderkey == order.o_orderkey)
    conn = rel.groupBy((2 * F.col("o_custkey")).alias("body_pre"), (2 * F.col("l_suppkey") + 1).alias("body_post"), F.col("o_orderstatus").alias("roi")).agg(F.count("*").alias("weight"))
    lonely = F.col("c_acctbal") < -950
    nation = lambda c: F.concat(F.lit("n"), F.col(c).cast("string"))
    types = cust.select((2 * F.col("c_custkey")).alias("body"), F.when(~lonely, nation("c_nationkey")).alias("type")).union(supp.select(2 * F.col("s_suppkey") + 1, nation("s_nationkey")))
    orphans = conn.join(types.where("type IS NULL").select(F.col("body").alias("body_pre")), "body_pre", "left_semi").select(F.col("body_pre").alias("orphan"), "roi").distinct()
    return conn, types, orphans


_NETWORK = """
c AS MATERIALIZED (SELECT 2 * o_custkey AS body_pre, 2 * l_suppkey + 1 AS body_post, o_orderstatus AS roi, count(*) AS weight FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL),
n AS (SELECT 2 * c_custkey AS body, CASE WHEN c_acctbal >= -950 THEN 'n' || c_nationkey END AS type FROM customer UNION ALL SELECT 2 * s_suppkey + 1, 'n' || s_nationkey FROM supplier),
o AS (SELECT body_pre AS orphan, roi, 'post' AS side, t.type AS partner_type, CAST(sum(weight) AS BIGINT) AS strength FROM c JOIN n ON n.body = body_pre AND n.type IS NULL JOIN n t ON t.body = body_post GROUP BY ALL),
b AS MATERIALIZED (SELECT body_pre AS body, roi, p.type AS own, t.type AS partner_type, CAST(sum(weight) AS BIGINT) AS strength FROM c JOIN n p ON p.body = body_pre AND p.type IS NOT NULL JOIN n t ON t.body = body_post GROUP BY ALL),
g AS (SELECT orphan, o.roi, body AS target, own AS type, 'post' AS side, o.partner_type, b.strength, o.strength AS o FROM o JOIN b ON b.roi = o.roi AND b.partner_type = o.partner_type)"""


@query(f"WITH {_NETWORK} SELECT * FROM o")
def orphan_type_strengths(spark, sf_dir):
    """Each orphan's weights to types, by region."""
    return autoproof.orphan_strengths(*_network(spark, sf_dir))


@query(f"WITH {_NETWORK} SELECT orphan, roi, target, type, side, partner_type, strength FROM g")
def target_type_strengths(spark, sf_dir):
    """The same of typed bodies that share types with an orphan."""
    conn, types, orphans = _network(spark, sf_dir)
    return autoproof.target_strengths(conn, types, settle(autoproof.orphan_strengths(conn, types, orphans)))


@query(f"""
WITH {_NETWORK}, s AS (SELECT orphan, roi, type, count(DISTINCT target) AS n FROM g GROUP BY ALL HAVING count(DISTINCT target) > 1), a AS (SELECT orphan, roi, type, partner_type, sum(strength) AS total FROM g GROUP BY ALL),
t AS (SELECT DISTINCT orphan, roi, type, target FROM g),
r AS (SELECT t.*, coalesce(g.strength, 0) AS s, o.strength AS o, coalesce(total, 0) AS total, n FROM t JOIN s USING (orphan, roi, type) JOIN o USING (orphan, roi) LEFT JOIN a USING (orphan, roi, type, partner_type) LEFT JOIN g USING (orphan, roi, type, target, partner_type)),
v AS (SELECT *, CASE WHEN s >= 2 THEN s ELSE 0 END AS x, CASE WHEN s + o >= 2 THEN s + o ELSE 0 END AS m, CASE WHEN (total - s) / (n - 1) >= 2 THEN (total - s) / (n - 1) ELSE 0 END AS p FROM r),
k AS (SELECT orphan, roi, target, type, sum(x * p) AS xp, sum(m * p) AS mp, sum(x * x) AS xx, sum(m * m) AS mm, sum(p * p) AS pp, max((x > 0)::BIGINT) AS similar_body_connections, CAST(sum((total > 0)::BIGINT) AS BIGINT) AS similar_type_connections FROM v GROUP BY ALL)
SELECT orphan, roi, target, type, round(CASE WHEN mm > 0 AND pp > 0 THEN mp / sqrt(mm * pp) ELSE 0 END - CASE WHEN xx > 0 AND pp > 0 THEN xp / sqrt(xx * pp) ELSE 0 END, 6) + 0 AS score, similar_body_connections, similar_type_connections FROM k""")
def autoproof_improvements(spark, sf_dir):
    """How much nearer each target comes to its type with an orphan's connections."""
    conn, types, orphans = _network(spark, sf_dir)
    mine = settle(autoproof.orphan_strengths(conn, types, orphans))
    got = autoproof.improvements(mine, settle(autoproof.target_strengths(conn, types, mine)), 2)
    return got.withColumn("score", F.round("score", 6) + 0)


def _organelles(spark, sf_dir) -> DataFrame:
    c = F.col
    return _t(spark, sf_dir, "lineitem").select(c("l_linenumber").alias("z"), c("l_quantity").cast("int").alias("y"), c("l_partkey").cast("int").alias("x"), (c("l_suppkey") % 2).alias("body"), c("l_suppkey").alias("organelle"), F.ascii("l_returnflag").alias("class")).distinct()


@query("""
WITH v AS (SELECT DISTINCT l_linenumber AS z, CAST(l_quantity AS INT) AS y, CAST(l_partkey AS INT) AS x, l_suppkey % 2 AS body, l_suppkey AS organelle, ascii(l_returnflag) AS class FROM lineitem),
r AS (SELECT * FROM v WHERE class <> 65 AND organelle <> 0), s AS (SELECT body, organelle, CAST(trunc(avg(z)) AS BIGINT) AS z, CAST(trunc(avg(y)) AS BIGINT) AS y, CAST(trunc(avg(x)) AS BIGINT) AS x, count(*) AS total_size FROM r GROUP BY ALL HAVING count(*) >= 20),
c AS (SELECT body, organelle, string_agg(class || ':' || n, ',' ORDER BY class) AS classes FROM (SELECT body, organelle, class, count(*) AS n FROM r GROUP BY ALL) GROUP BY ALL),
p AS (SELECT s.body, s.organelle, min((v.z - s.z) ** 2 + (v.y - s.y) ** 2 + (v.x - s.x) ** 2) AS d, first({'z': v.z, 'y': v.y, 'x': v.x} ORDER BY (v.z - s.z) ** 2 + (v.y - s.y) ** 2 + (v.x - s.x) ** 2, v.z, v.y, v.x) AS m
 FROM s JOIN v ON v.organelle = s.organelle AND abs(v.z - s.z) <= 9 AND abs(v.y - s.y) <= 9 AND abs(v.x - s.x) <= 9 GROUP BY ALL)
SELECT body, organelle, coalesce(m.z, s.z) AS z, coalesce(m.y, s.y) AS y, coalesce(m.x, s.x) AS x, total_size, classes, CASE WHEN d IS NULL THEN 'error' WHEN d = 0 THEN 'exact' ELSE 'adjusted' END AS centroid_type
FROM s JOIN c USING (body, organelle) LEFT JOIN p USING (body, organelle)""")
def organelle_stats(spark, sf_dir):
    """Sizes, classes and centres of suppliers' items as organelles."""
    got = organelles.organelle_stats(_organelles(spark, sf_dir), 20, 9, 65)
    classes = F.array_join(F.transform(F.map_entries("classes"), lambda e: F.concat(e["key"].cast("string"), F.lit(":"), e["value"].cast("string"))), ",")
    return got.withColumn("classes", classes)


def _regions(spark, sf_dir) -> DataFrame:
    voxels = _t(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("roi"), F.col("l_linenumber").alias("z"), F.col("l_suppkey").alias("y"), F.expr("l_partkey div 3").alias("x"))
    return geometry.encode_runs(voxels, ["roi"])


@query("""
WITH v AS (SELECT DISTINCT l_returnflag AS roi, l_linenumber AS z, l_suppkey AS y, l_partkey // 3 AS x FROM lineitem),
b(slab, x, lo, hi) AS (VALUES (34, 0, 0, 83), (33, 2655, 83, 164), (32, 5251, 164, 248), (31, 7920, 248, 331))
SELECT roi, slab, b.x, count(*) FILTER (v.x >= lo AND v.x < hi) AS blocks, count(*) FILTER (v.x >= lo AND v.x < hi) * 32768.0::DOUBLE AS voxels, 100.0::DOUBLE * count(*) FILTER (v.x >= lo AND v.x < hi) / count(*) AS percent FROM v, b GROUP BY ALL""")
def region_slabs(spark, sf_dir):
    """How the blocks of return flags are spread over slabs."""
    return slabs.region_slabs(_regions(spark, sf_dir), [0, 2655, 5251, 7920, 10600], 34)


@query("""
WITH v AS (SELECT l_suppkey AS label, l_partkey AS x FROM lineitem), p(x, k, side) AS (VALUES (95, 0, -1), (105, 0, 1), (115, 1, -1), (125, 1, 1), (145, 2, -1), (155, 2, 1)),
m AS (SELECT label, min(k) FILTER (side < 0) AS l, min(k) FILTER (side > 0) AS r FROM v JOIN p USING (x) WHERE label <> 0 GROUP BY 1)
SELECT label, l IS NOT NULL AS "left", r IS NOT NULL AS "right", l IS DISTINCT FROM r AS severed FROM m""")
def severed_bodies(spark, sf_dir):
    """Suppliers with parts on one side of boundaries alone."""
    item = _t(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("label"), F.col("l_partkey").alias("x"))
    return slabs.severed_bodies(item, [0, 100, 120, 150, 100000], 5)


@query("SELECT DISTINCT CAST(l_linenumber AS BIGINT) AS z, l_suppkey AS y, l_partkey // 3 AS x FROM lineitem WHERE l_returnflag = 'A'")
def block_mask_voxels(spark, sf_dir):
    """Voxels of one region, through masks of blocks with halos."""
    runs = _regions(spark, sf_dir).where("roi = 'A'")
    return slabs.masks_to_voxels(slabs.block_masks(runs, 16, 1), 16, 1)


@query("SELECT z, y, x, label, n FROM (SELECT DISTINCT l_linenumber AS z, l_suppkey AS y, l_partkey AS x, l_linenumber AS label, 32 AS n FROM lineitem) WHERE z BETWEEN 2 AND 5 AND y BETWEEN 2 AND 9 AND x BETWEEN 7 AND 166")
def cropped_to_grid(spark, sf_dir):
    """What lies in whole cells of a grid within a box; n counts the cells."""
    item = _t(spark, sf_dir, "lineitem")
    vox = item.select(F.col("l_linenumber").alias("z"), F.col("l_suppkey").alias("y"), F.col("l_partkey").alias("x"), F.col("l_linenumber").alias("label")).distinct()
    cut, box = slabs.crop_to_grid(vox, ((1, 1, 0), (7, 11, 170)), slabs.Grid((2, 4, 20), (0, 2, 7)))
    return cut.withColumn("n", F.lit((box[1][0] - box[0][0]) // 2 * ((box[1][1] - box[0][1]) // 4) * ((box[1][2] - box[0][2]) // 20)))


@query("""
WITH v AS (SELECT DISTINCT l_linenumber AS z, l_suppkey AS y, l_partkey // 8 AS x, l_linenumber AS label FROM lineitem)
SELECT label, count(*) AS n FROM (SELECT label FROM v UNION ALL SELECT 0 FROM range(0, 8) z(z), range(-2, 14) y(y), range(-6, 34) x(x) WHERE NOT (z BETWEEN 1 AND 7 AND y BETWEEN 0 AND 10 AND x BETWEEN 0 AND 25)) GROUP BY 1""")
def padded_to_grid(spark, sf_dir):
    """Voxels by label after what a grid's cells have around a box is filled with zeros."""
    item = _t(spark, sf_dir, "lineitem")
    vox = item.select(F.col("l_linenumber").alias("z"), F.col("l_suppkey").alias("y"), F.expr("l_partkey div 8").alias("x"), F.col("l_linenumber").alias("label")).distinct()
    full, _ = slabs.pad_to_grid(vox, ((1, 0, 0), (8, 11, 26)), slabs.Grid((4, 8, 20), (0, 6, 14)), fill=0)
    return full.groupBy("label").agg(F.count("*").alias("n"))


@query("""
WITH v AS (SELECT DISTINCT l_suppkey AS body, l_linenumber AS z, CAST(l_quantity AS INT) AS y, CAST(l_partkey AS INT) AS x FROM lineitem)
SELECT body, count(*) AS voxels, first(z ORDER BY z, y, x)::BIGINT AS z, first(y ORDER BY z, y, x)::BIGINT AS y, first(x ORDER BY z, y, x)::BIGINT AS x FROM v GROUP BY 1""")
def run_payload_facts(spark, sf_dir):
    """Sizes and first voxels read from suppliers' run payloads."""
    item = _t(spark, sf_dir, "lineitem")
    vox = item.select(F.col("l_suppkey").alias("body"), F.col("l_linenumber").alias("z"), F.col("l_quantity").cast("int").alias("y"), F.col("l_partkey").cast("int").alias("x"))
    return formats.run_payload_facts(tables.encode_run_payload(geometry.encode_runs(vox, ["body"])), payload="data")


@query("""
WITH o AS (SELECT o_custkey AS body, o_orderkey, row_number() OVER w - 1 AS node, lag(o_orderkey) OVER w AS before FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey))
SELECT body, node, CAST(o_orderkey % 1000 * 8 AS FLOAT) AS x, CAST(node * 16 AS FLOAT) AS y, CAST(0 AS FLOAT) AS z, CASE WHEN before IS NULL THEN -1 ELSE node - 1 END AS parent FROM o""")
def skeleton_buffers(spark, sf_dir):
    """Customers' orders as chains of nodes, through viewers' buffers."""
    from pyspark.sql import Window

    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    o = _t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("body"), F.col("o_orderkey").alias("node"), (F.col("o_orderkey") % 1000).cast("double").alias("x"), (2.0 * (F.row_number().over(w) - 1)).alias("y"), F.lit(0.0).alias("z"), F.coalesce(F.lag("o_orderkey").over(w), F.lit(-1)).alias("parent"))
    return formats.decode_skeletons(formats.encode_skeletons(o))


@query("""SELECT least(l_partkey, l_suppkey) AS sv_a, greatest(l_partkey, l_suppkey) AS sv_b, CASE WHEN l_partkey > l_suppkey THEN l_linenumber + 10 ELSE l_linenumber END AS xa, CASE WHEN l_partkey > l_suppkey THEN l_linenumber ELSE l_linenumber + 10 END AS xb, count(*) AS n
FROM lineitem GROUP BY ALL""")
def task_list_edges(spark, sf_dir):
    """Edges of parts and suppliers, through task lists of about 500."""
    item = _t(spark, sf_dir, "lineitem")
    at = F.col("l_linenumber")
    edges = item.select(F.col("l_partkey").alias("id_a"), F.col("l_suppkey").alias("id_b"), at.alias("xa"), (at + 10).alias("xb"), *(F.lit(0).alias(c) for c in ("ya", "za", "yb", "zb")), "l_orderkey", "l_linenumber")
    return formats.parse_task_lists(formats.task_lists(edges, ["l_orderkey", "l_linenumber"], 500)).groupBy("sv_a", "sv_b", "xa", "xb").agg(F.count("*").alias("n"))


@query("SELECT s_suppkey AS segment, 'supplier ' || s_suppkey AS name, s_nationkey AS nation, s_acctbal < 0 AS poor, s_suppkey % 2 = 1 AS odd FROM supplier")
def segment_property_columns(spark, sf_dir):
    """Names, numbers and tags of suppliers, read from a property document of each nation."""
    s = _t(spark, sf_dir, "supplier")
    code = F.to_json(F.filter(F.array(F.when(F.col("s_acctbal") < 0, 0), F.when(F.col("s_suppkey") % 2 == 1, 1)), lambda c: c.isNotNull()))
    row = F.struct(F.col("s_suppkey").cast("string").alias("id"), F.concat(F.lit("supplier "), F.col("s_suppkey").cast("string")).alias("name"), F.col("s_nationkey").alias("nation"), code.alias("code"))
    every = s.groupBy("s_nationkey").agg(F.collect_list(row).alias("all"))
    quoted = F.concat(F.lit('"'), F.array_join("all.name", '","'), F.lit('"'))
    ids = F.concat(F.lit('"'), F.array_join("all.id", '","'), F.lit('"'))
    document = F.concat(
        F.lit('{"inline":{"ids":['), ids, F.lit('],"properties":[{"id":"name","type":"label","values":['), quoted, F.lit(']},{"id":"nation","type":"number","data_type":"int32","values":['),
        F.array_join(F.transform("all.nation", lambda n: n.cast("string")), ","), F.lit(']},{"id":"tags","type":"tags","tags":["poor","odd"],"values":['), F.array_join("all.code", ","), F.lit("]}]}}"),
    )
    return formats.property_columns(formats.segment_properties(every.select(document.alias("document"))), {"name": "string", "nation": "int"}, ["poor", "odd"])


@query()
def sampled_points(spark, sf_dir):
    """A thousand line items drawn by a seed, no two of like line number within two parts and quantities."""
    item = _t(spark, sf_dir, "lineitem")
    points = item.select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"), (F.col("l_linenumber") * 50).alias("z"), F.col("l_quantity").cast("int").alias("y"), F.col("l_partkey").cast("int").alias("x"))
    return organelles.sampled_points(points, 1000, minimum_distance=2.0, seed=5)


@query("""
WITH RECURSIVE m AS (SELECT DISTINCT c_custkey // 5 AS target, c_custkey AS fragment FROM customer WHERE c_custkey > 0 AND c_custkey % 11 <> 0 AND c_custkey // 5 > 0),
l AS (SELECT c_custkey // 7 AS target, c_custkey AS absorbed FROM customer WHERE c_custkey > 6 AND c_acctbal < 500),
e AS (SELECT absorbed AS body, target AS up FROM l UNION ALL SELECT e.body, l.target FROM e JOIN l ON l.absorbed = e.up), w AS (SELECT body, up AS owner FROM e WHERE up NOT IN (SELECT absorbed FROM l)),
b AS (SELECT target AS body FROM m UNION SELECT fragment FROM m),
o AS (SELECT b.body, coalesce(c_acctbal >= 500, FALSE) AS "exists", CASE WHEN c_acctbal >= 500 THEN b.body ELSE coalesce(w.owner, 0) END AS owner FROM b LEFT JOIN customer ON c_custkey = b.body LEFT JOIN w USING (body)),
u AS (SELECT fragment AS body, target AS up FROM m UNION ALL SELECT u.body, m.target FROM u JOIN m ON m.fragment = u.up),
r AS (SELECT b.body, coalesce((SELECT min(up) FROM u WHERE u.body = b.body), b.body) AS root FROM b),
a AS (SELECT o.*, root, p.owner AS root_owner, CASE WHEN o.body = root THEN CASE WHEN o.owner = 0 THEN 'unknown' WHEN o.owner = o.body THEN 'target' ELSE 'old_target' END WHEN p.owner = 0 THEN 'unassessed' WHEN o.owner = p.owner AND o.owner = o.body THEN 'already_absorbed_target'
 WHEN o.owner = p.owner THEN 'already_merged' WHEN o.owner = o.body THEN 'mergeable' ELSE 'merged_elsewhere' END AS assessment FROM o JOIN r USING (body) JOIN (SELECT body AS root, owner FROM o) p USING (root)),
k AS (SELECT m.* FROM m JOIN a ON a.body = fragment WHERE assessment <> 'merged_elsewhere'), v AS (SELECT fragment AS body, target AS up FROM k UNION ALL SELECT v.body, k.target FROM v JOIN k ON k.fragment = v.up),
g AS (SELECT a.*, coalesce((SELECT min(up) FROM v WHERE v.body = a.body), a.body) AS begin FROM a),
h AS (SELECT g.*, x.owner AS begin_owner, x.assessment AS begin_assessment, g.assessment = 'mergeable' AND g.body <> g.begin AND x.assessment <> 'unknown' AS goes FROM g JOIN a x ON x.body = g.begin)
SELECT body, "exists", owner, CASE WHEN goes AND begin_assessment = 'merged_elsewhere' THEN 'my_target_merged_elsewhere' ELSE assessment END AS assessment,
 CAST(CASE WHEN (goes OR body = begin) AND bool_or(goes) OVER (PARTITION BY begin) THEN CASE WHEN begin_assessment = 'merged_elsewhere' THEN begin ELSE begin_owner END ELSE -1 END AS BIGINT) AS mergeset FROM h""")
def assessed_merges(spark, sf_dir):
    """Proposed merges in a tree of customers, some of whom have gone into others since."""
    from .operators import review

    c = _t(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    merges = c.where("c_custkey > 0 AND c_custkey % 11 <> 0 AND c_custkey div 5 > 0").select(F.expr("c_custkey div 5").alias("target"), k.alias("fragment"))
    log = c.where("c_custkey > 6 AND c_acctbal < 500").select(F.expr("c_custkey div 7").alias("target"), k.alias("absorbed"))
    return review.assess_merges(merges, c.select(k.alias("body"), (F.col("c_acctbal") >= 500).cast("int").alias("size")), log)


@query("""
WITH n AS (SELECT c_custkey AS body, c_custkey // 4 AS g, c_mktsegment IN ('BUILDING', 'MACHINERY') AS traced FROM customer WHERE c_custkey // 4 <> 0)
SELECT g AS "group", string_agg(body, ',' ORDER BY body) AS bodies, count(*) AS n FROM n GROUP BY 1 HAVING NOT bool_and(traced) AND count(*) IN (3, 4)""")
def review_groups(spark, sf_dir):
    """Fours of customers, of whom not all are in two segments."""
    from .operators import review

    n = _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("body"), F.expr("c_custkey div 4").alias("group"), F.col("c_mktsegment").alias("status"))
    return review.review_groups(n, ["BUILDING", "MACHINERY"], [3, 4]).withColumn("bodies", F.array_join("bodies", ","))


@query("SELECT agg, string_agg(orig, ',' ORDER BY n DESC, orig) AS origs FROM (SELECT l_suppkey AS agg, l_partkey AS orig, count(*) AS n FROM lineitem WHERE l_suppkey <> 0 AND l_partkey <> 0 GROUP BY ALL) GROUP BY 1 HAVING count(*) > 1")
def whole_merge_lists(spark, sf_dir):
    """The parts that each supplier's items are made of, the most frequent first, over real ids."""
    from .operators import mergetable

    p = _t(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("orig"), F.col("l_suppkey").alias("agg"))
    return mergetable.merge_lists(p).select("agg", F.array_join(F.transform("origs", lambda x: x.cast("string")), ",").alias("origs"))


@query("""
WITH r AS (SELECT min(event_id) + (max(event_id) - min(event_id)) // 4 AS lo, max(event_id) - (max(event_id) - min(event_id)) // 4 AS hi FROM events)
SELECT event_id, ts, user_id FROM events, r WHERE event_id BETWEEN lo AND hi AND event_type IN ('purchase', 'error')""")
def log_middle(spark, sf_dir):
    """Two kinds of events in the middle half of the log."""
    from .operators import log

    e = _t(spark, sf_dir, "events").withColumnsRenamed({"event_id": "mutid", "event_type": "action"})
    at = e.agg(F.min("mutid").alias("a"), F.max("mutid").alias("b")).first()
    lo, hi = (at["a"] + (at["b"] - at["a"]) // 4, at["b"] - (at["b"] - at["a"]) // 4) if at["a"] is not None else (0, 0)
    return log.with_actions(log.in_range(e, first=lo, last=hi), ["purchase", "error"]).select(F.col("mutid").alias("event_id"), "ts", "user_id")
