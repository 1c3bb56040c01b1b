"""Queries over the driver's tables, one for each family of operators, with their SQL.

Line items stand for synapses: a line item is a post point (id 8 * order + line), its order the pre point,
the customer the body before it, the supplier the body after it, the order's priority its region, the
return flag its kind, the discount its confidence.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import coords, names, scores
from .operators import annotations, completeness, geometry, graph, log, mergetable, synapses, tables, volume
from .sources import store
from .streaming import log as stream

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _connections(spark, sf_dir) -> DataFrame:
    item, order = _t(spark, sf_dir, "lineitem"), _t(spark, sf_dir, "orders")
    once = item.groupBy("l_orderkey", "l_linenumber").agg(F.min("l_suppkey").alias("l_suppkey"), F.min("l_discount").alias("l_discount"))
    rows = once.join(order, once.l_orderkey == order.o_orderkey)
    return rows.select(F.col("l_orderkey").alias("pre_id"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("post_id"), F.col("o_custkey").alias("body_pre"), F.col("l_suppkey").alias("body_post"), F.col("o_orderpriority").alias("roi"), F.col("l_discount").alias("conf_post"))


_CONN = "SELECT l_orderkey AS pre_id, l_orderkey * 8 + l_linenumber AS post_id, o_custkey AS body_pre, l_suppkey AS body_post, o_orderpriority AS roi, l_discount AS conf_post FROM (SELECT l_orderkey, l_linenumber, min(l_suppkey) AS l_suppkey, min(l_discount) AS l_discount FROM lineitem GROUP BY 1, 2) JOIN orders ON l_orderkey = o_orderkey"


def _edges(spark, sf_dir) -> DataFrame:
    """Parts and suppliers as ends of merge edges."""
    return _t(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("id_a"), F.col("l_linenumber").alias("xa"), F.col("l_suppkey").alias("id_b"), (F.col("l_linenumber") + 10).alias("xb"), F.col("l_extendedprice").alias("score"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("row"))


_EDGES = "SELECT l_partkey AS id_a, l_linenumber AS xa, l_suppkey AS id_b, l_linenumber + 10 AS xb, l_extendedprice AS score, l_orderkey * 8 + l_linenumber AS row FROM lineitem"


def _voxels(spark, sf_dir) -> DataFrame:
    """Part keys along lines of suppliers as a label image in two dimensions."""
    return _t(spark, sf_dir, "lineitem").select(F.lit(0).alias("z"), F.col("l_suppkey").cast("int").alias("y"), F.col("l_partkey").cast("int").alias("x"), F.col("l_linenumber").alias("label"))


_VOX = "SELECT 0 AS z, CAST(l_suppkey AS INT) AS y, CAST(l_partkey AS INT) AS x, l_linenumber AS label FROM lineitem"


@query("""
SELECT c_nationkey AS from_body, s_nationkey AS to_body, count(*) AS weight
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
GROUP BY 1, 2""")
def weighted_edges(spark, sf_dir):
    item, order, cust, supp = (_t(spark, sf_dir, n) for n in ("lineitem", "orders", "customer", "supplier"))
    rel = item.join(order, item.l_orderkey == order.o_orderkey).select((2 * F.col("o_custkey")).alias("from_p"), (2 * F.col("l_suppkey") + 1).alias("to_p"))
    points = cust.select((2 * F.col("c_custkey")).alias("p"), F.col("c_nationkey").alias("body")).union(supp.select(2 * F.col("s_suppkey") + 1, "s_nationkey"))
    return synapses.weighted_edges(rel, points, (["from_p"], ["to_p"]), ["p"])


@query('SELECT l_suppkey AS body, count(*) FILTER (l_returnflag = \'A\') AS "A", count(*) FILTER (l_returnflag = \'N\') AS "N", count(*) FILTER (l_returnflag = \'R\') AS "R" FROM lineitem GROUP BY 1')
def body_kind_counts(spark, sf_dir):
    points = _t(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("body"), F.col("l_returnflag").alias("kind"))
    return synapses.body_counts(points, ("A", "N", "R"))


@query("""SELECT * FROM (SELECT l_partkey AS body, count(*) FILTER (l_returnflag = 'N') AS "PreSyn", count(*) FILTER (l_returnflag = 'R') AS "PostSyn" FROM lineitem GROUP BY 1) WHERE "PreSyn" >= 20 OR "PostSyn" >= 10""")
def bodies_of_interest(spark, sf_dir):
    kind = F.when(F.col("l_returnflag") == "N", "PreSyn").when(F.col("l_returnflag") == "R", "PostSyn")
    return synapses.bodies_of_interest(_t(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("body"), kind.alias("kind")), 20, 10)


@query(f"""
SELECT c_nationkey AS body_pre, s_nationkey AS body_post, post_id
FROM ({_CONN}) JOIN customer ON body_pre = c_custkey JOIN supplier ON body_post = s_suppkey WHERE c_nationkey = s_nationkey""")
def autapses(spark, sf_dir):
    c = _connections(spark, sf_dir).select("post_id", F.col("body_pre").alias("c_custkey"), F.col("body_post").alias("s_suppkey"))
    full = c.join(_t(spark, sf_dir, "customer"), "c_custkey").join(_t(spark, sf_dir, "supplier"), "s_suppkey").select(F.col("c_nationkey").alias("body_pre"), F.col("s_nationkey").alias("body_post"), "post_id")
    return synapses.autapses(full)


@query(f"SELECT pre_id, post_id, body_pre, body_post, conf_post FROM ({_CONN}) QUALIFY row_number() OVER (PARTITION BY pre_id, body_post ORDER BY conf_post DESC, post_id) > 1")
def redundant_posts(spark, sf_dir):
    return synapses.redundant_posts(_connections(spark, sf_dir).drop("roi"))


@query(f"""
WITH p AS (SELECT o_orderkey AS point_id FROM orders WHERE o_orderkey % 3 <> 0), r AS (SELECT pre_id, post_id FROM ({_CONN})),
q AS (SELECT post_id AS point_id FROM r WHERE post_id % 5 <> 0)
SELECT 'dangling_pre' AS report, count(*) AS n FROM r WHERE pre_id NOT IN (SELECT point_id FROM p) UNION ALL
SELECT 'dangling_post', count(*) FROM r WHERE post_id NOT IN (SELECT point_id FROM q) UNION ALL
SELECT 'wrong_kind_pre', CAST(0 AS BIGINT) UNION ALL SELECT 'wrong_kind_post', CAST(0 AS BIGINT) UNION ALL
SELECT 'duplicate_pairs', CAST(coalesce(sum(c - 1), 0) AS BIGINT) FROM (SELECT count(*) AS c FROM r GROUP BY pre_id, post_id) UNION ALL
SELECT 'oversubscribed_posts', count(*) FROM (SELECT post_id FROM (SELECT DISTINCT pre_id, post_id FROM r) GROUP BY 1 HAVING count(*) > 1) UNION ALL
SELECT 'duplicate_points', CAST(0 AS BIGINT) UNION ALL
SELECT 'childless_pres', count(*) FROM p WHERE point_id NOT IN (SELECT pre_id FROM r) UNION ALL
SELECT 'orphan_posts', count(*) FROM q WHERE point_id NOT IN (SELECT post_id FROM r)""")
def consistency_report(spark, sf_dir):
    order = _t(spark, sf_dir, "orders").where("o_orderkey % 3 != 0").select((2 * F.col("o_orderkey")).alias("point_id"), F.lit("PreSyn").alias("kind"))
    c = _connections(spark, sf_dir)
    posts = c.where("post_id % 5 != 0").select((2 * F.col("post_id") + 1).alias("point_id"), F.lit("PostSyn").alias("kind"))
    return synapses.consistency(order.union(posts), c.select((2 * F.col("pre_id")).alias("pre_id"), (2 * F.col("post_id") + 1).alias("post_id")))


@query(f"SELECT pre_id, post_id, body_pre, body_post FROM ({_CONN})")
def full_partner_table(spark, sf_dir):
    c = _connections(spark, sf_dir)
    pre = _t(spark, sf_dir, "orders").select((2 * F.col("o_orderkey")).alias("point_id"), F.col("o_custkey").alias("body"))
    points = pre.union(c.select(2 * F.col("post_id") + 1, "body_post"))
    got = synapses.full_partners(points, c.select((2 * F.col("pre_id")).alias("pre_id"), (2 * F.col("post_id") + 1).alias("post_id")), ["body"])
    return got.select(F.expr("pre_id div 2").alias("pre_id"), F.expr("(post_id - 1) div 2").alias("post_id"), "body_pre", "body_post")


@query(f"SELECT DISTINCT pre_id AS point_id, 'PreSyn' AS kind, body_pre AS body FROM ({_CONN}) UNION ALL SELECT post_id, 'PostSyn', body_post FROM ({_CONN})")
def partner_to_points(spark, sf_dir):
    return synapses.partners_to_points(_connections(spark, sf_dir), ["body"])


@query("""
SELECT point_id, conf FROM (SELECT l_orderkey AS point_id, l_linenumber AS conf, 0 AS src FROM lineitem WHERE l_linenumber = 1 UNION ALL SELECT l_orderkey, l_linenumber, 1 FROM lineitem WHERE l_linenumber = 2)
QUALIFY row_number() OVER (PARTITION BY point_id ORDER BY src DESC) = 1""")
def add_keep_last(spark, sf_dir):
    item = _t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("point_id"), F.col("l_linenumber").alias("conf"))
    return synapses.add_points(item.where("conf = 1"), item.where("conf = 2"))


@query("""
WITH r AS (SELECT l_orderkey AS pre_id, l_orderkey * 8 + l_linenumber AS post_id FROM lineitem), gone AS (SELECT post_id FROM r WHERE post_id % 8 <= 3)
SELECT o_orderkey AS point_id FROM orders WHERE o_orderkey NOT IN (SELECT pre_id FROM r WHERE post_id IN (SELECT post_id FROM gone)) OR o_orderkey IN (SELECT pre_id FROM r WHERE post_id NOT IN (SELECT post_id FROM gone))""")
def delete_cascade(spark, sf_dir):
    r = _t(spark, sf_dir, "lineitem").select((-F.col("l_orderkey")).alias("pre_id"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("post_id"))
    points = _t(spark, sf_dir, "orders").select((-F.col("o_orderkey")).alias("point_id"))
    kept, _ = synapses.delete_posts(points, r, r.where("post_id % 8 <= 3").select(F.col("post_id").alias("point_id")))
    return kept.select((-F.col("point_id")).alias("point_id"))


@query("""
WITH w AS (SELECT l_suppkey AS body, l_returnflag AS rel, o_orderpriority AS roi FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
SELECT body, rel, roi, count(*) AS weight FROM w GROUP BY 1, 2, 3 UNION ALL SELECT body, rel, NULL, count(*) FROM w GROUP BY 1, 2""")
def relationship_weights(spark, sf_dir):
    item, order = _t(spark, sf_dir, "lineitem"), _t(spark, sf_dir, "orders")
    rows = item.join(order, item.l_orderkey == order.o_orderkey).select(F.col("l_suppkey").alias("body"), F.col("l_returnflag").alias("rel"), F.col("o_orderpriority").alias("roi"))
    return synapses.with_totals(rows, ["body", "rel", "roi"], "roi").withColumn("weight", F.col("weight").cast("long"))


@query("SELECT CASE WHEN l_returnflag = 'N' THEN l_suppkey ELSE l_partkey END AS pre, CASE WHEN l_returnflag = 'N' THEN l_partkey ELSE l_suppkey END AS post, CAST(l_quantity AS BIGINT) AS weight FROM lineitem")
def pre_post_layout(spark, sf_dir):
    rel = F.when(F.col("l_returnflag") == "N", "PreSynTo").otherwise("PostSynTo")
    return synapses.pre_post_layout(_t(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("body"), F.col("l_partkey").alias("to_body"), rel.alias("rel"), F.col("l_quantity").cast("long").alias("weight")))


_RANKED = f"""
c AS ({_CONN}), o AS (SELECT body_pre AS body, count(DISTINCT pre_id) AS presyn, count(*) AS outputs FROM c GROUP BY 1), i AS (SELECT body_post AS body, count(*) AS postsyn FROM c GROUP BY 1),
b AS (SELECT coalesce(o.body, i.body) AS body, coalesce(presyn, 0) AS presyn, coalesce(postsyn, 0) AS postsyn, coalesce(outputs, 0) + coalesce(postsyn, 0) AS synweight FROM o FULL JOIN i ON o.body = i.body),
r AS (SELECT *, row_number() OVER (ORDER BY synweight DESC, body) - 1 AS rank FROM b)"""


@query(f"""
WITH {_RANKED},
ti AS (SELECT body_post AS body, roi AS top_input_roi FROM (SELECT body_post, roi, count(*) AS n FROM c GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY body_post ORDER BY n DESC, roi) = 1),
tx AS (SELECT body_pre AS body, roi AS top_output_roi FROM (SELECT body_pre, roi, count(*) AS n FROM c GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY body_pre ORDER BY n DESC, roi) = 1)
SELECT r.body, presyn, postsyn, synweight, top_input_roi, top_output_roi, rank FROM r LEFT JOIN ti ON r.body = ti.body LEFT JOIN tx ON r.body = tx.body""")
def ranked_counts(spark, sf_dir):
    return completeness.ranked_counts(_connections(spark, sf_dir))


@query(f"""
WITH {_RANKED}, e AS (SELECT c.*, greatest(a.rank, z.rank) AS max_rank, least(a.rank, z.rank) AS min_rank FROM c JOIN r a ON c.body_pre = a.body JOIN r z ON c.body_post = z.body),
p AS (SELECT *, row_number() OVER (ORDER BY max_rank, min_rank, pre_id, post_id) AS pos FROM e),
f AS (SELECT body, min(pos) AS pos FROM (SELECT body_pre AS body, pos FROM p UNION ALL SELECT body_post, pos FROM p) GROUP BY 1),
n AS (SELECT pos, sum(presyn) AS np, sum(postsyn) AS nq FROM f JOIN r USING (body) GROUP BY 1),
s AS (SELECT p.*, sum(coalesce(np, 0)) OVER (ORDER BY p.pos) AS tp, sum(coalesce(nq, 0)) OVER (ORDER BY p.pos) AS tq FROM p LEFT JOIN n ON p.pos = n.pos)
SELECT pre_id, post_id, body_pre, body_post, max_rank, min_rank, CAST(tp AS BIGINT) AS traced_pre, CAST(tq AS BIGINT) AS traced_post, pos AS traced_conn,
 CAST(tp AS DOUBLE) / (SELECT sum(presyn) FROM r) AS traced_pre_frac, CAST(tq AS DOUBLE) / (SELECT sum(postsyn) FROM r) AS traced_post_frac, CAST(pos AS DOUBLE) / (SELECT count(*) FROM c) AS traced_conn_frac FROM s""")
def completeness_forecast(spark, sf_dir):
    return completeness.forecast(_connections(spark, sf_dir))


@query("""
WITH w AS (SELECT l_suppkey AS upstream, l_partkey AS body, CAST(max(l_quantity) AS BIGINT) AS weight FROM lineitem GROUP BY 1, 2),
c AS (SELECT *, CAST(sum(weight) OVER (PARTITION BY upstream ORDER BY weight DESC, body ROWS UNBOUNDED PRECEDING) AS BIGINT) AS cumulative, sum(weight) OVER (PARTITION BY upstream) AS t FROM w)
SELECT upstream, body, weight, cumulative, CAST(cumulative AS DOUBLE) / t AS expected, max(CAST(cumulative AS DOUBLE) / t) OVER (PARTITION BY upstream) AS highest FROM c""")
def downstream_completeness(spark, sf_dir):
    return completeness.downstream(_t(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("upstream"), F.col("l_partkey").alias("body"), F.col("l_quantity").cast("long").alias("weight")))


@query(f"""
SELECT least(id_a, id_b) AS id_a, greatest(id_a, id_b) AS id_b, CASE WHEN id_a > id_b THEN xb ELSE xa END AS xa, CASE WHEN id_a > id_b THEN xa ELSE xb END AS xb, score, row FROM ({_EDGES})
QUALIFY row_number() OVER (PARTITION BY least(id_a, id_b), greatest(id_a, id_b) ORDER BY row DESC, score DESC) = 1""")
def normalize_pairs(spark, sf_dir):
    return mergetable.normalize(_edges(spark, sf_dir), ["row", "score"])


@query("SELECT l_partkey AS a, l_suppkey AS b, l_orderkey * 8 + l_linenumber AS row FROM lineitem QUALIFY row_number() OVER (PARTITION BY least(l_partkey, l_suppkey), greatest(l_partkey, l_suppkey) ORDER BY l_orderkey * 8 + l_linenumber, l_partkey) = 1")
def unordered_dedupe(spark, sf_dir):
    rows = _t(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("row"))
    return tables.drop_unordered_duplicates(rows, ["a", "b"], ["row", "a"])


@query(f"""
WITH m AS (SELECT p_partkey AS sv, CAST(p_size AS BIGINT) AS body FROM part WHERE p_partkey % 2 = 0)
SELECT id_a, id_b, row, CASE WHEN coalesce(a.body, id_a) = coalesce(b.body, id_b) THEN coalesce(a.body, id_a) ELSE 0 END AS body FROM ({_EDGES}) e LEFT JOIN m a ON id_a = a.sv LEFT JOIN m b ON id_b = b.sv""")
def apply_mapping(spark, sf_dir):
    m = _t(spark, sf_dir, "part").where("p_partkey % 2 = 0").select(F.col("p_partkey").alias("sv"), F.col("p_size").cast("long").alias("body"))
    return mergetable.apply_mapping(_edges(spark, sf_dir), m).select("id_a", "id_b", "row", "body")


@query("""
WITH s AS (SELECT l_partkey AS sv, CAST(sum(l_quantity) AS BIGINT) AS size FROM lineitem GROUP BY 1), m AS (SELECT p_partkey AS sv, CAST(p_size AS BIGINT) AS body FROM part WHERE p_partkey % 2 = 0)
SELECT body, CAST(sum(size) AS BIGINT) AS voxels, count(*) AS svs FROM (SELECT body, size FROM s JOIN m USING (sv) UNION ALL SELECT sv, size FROM s WHERE sv NOT IN (SELECT sv FROM m)) WHERE body <> 0 GROUP BY 1""")
def body_sizes(spark, sf_dir):
    s = _t(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("sv")).agg(F.sum("l_quantity").cast("long").alias("size"))
    m = _t(spark, sf_dir, "part").where("p_partkey % 2 = 0").select(F.col("p_partkey").alias("sv"), F.col("p_size").cast("long").alias("body"))
    return mergetable.body_sizes(s, m, singletons=True)


_FAV = f"""
WITH e AS ({_EDGES}), b AS (SELECT id_a AS body, score, 'a' AS side, row FROM e UNION ALL SELECT id_b, score, 'b', row FROM e),
f AS (SELECT *, count(*) OVER (PARTITION BY body) AS edges FROM b QUALIFY row_number() OVER (PARTITION BY body ORDER BY score, side, row) = 1)"""


@query(_FAV + " SELECT body, score AS best, side, row, edges FROM f")
def favorites(spark, sf_dir):
    return mergetable.favorites(_edges(spark, sf_dir), key=["row"])


@query(_FAV + " SELECT e.id_a, e.id_b, e.row FROM e JOIN f a ON e.row = a.row AND e.id_a = a.body JOIN f b ON e.row = b.row AND e.id_b = b.body")
def mutual_favorites(spark, sf_dir):
    return mergetable.extract_favorites(_edges(spark, sf_dir), mutual=True, key=["row"]).select("id_a", "id_b", "row")


@query(f"""
WITH m AS (SELECT p_partkey AS sv, CAST(p_size AS BIGINT) AS body FROM part), e AS (SELECT e.*, coalesce(a.body, id_a) AS ba, coalesce(b.body, id_b) AS bb FROM ({_EDGES}) e LEFT JOIN m a ON id_a = a.sv LEFT JOIN m b ON id_b = b.sv),
o AS (SELECT least(ba, bb) AS body_a, greatest(ba, bb) AS body_b, score, CASE WHEN ba > bb THEN id_b ELSE id_a END AS id_a, CASE WHEN ba > bb THEN id_a ELSE id_b END AS id_b FROM e WHERE ba <> bb)
SELECT body_a, body_b, id_a, id_b, score FROM o WHERE body_a % 2 = 0 AND body_b % 2 = 0 QUALIFY row_number() OVER (PARTITION BY body_a, body_b ORDER BY score, id_a, id_b) = 1""")
def important_merges(spark, sf_dir):
    part = _t(spark, sf_dir, "part")
    m = part.select(F.col("p_partkey").alias("sv"), F.col("p_size").cast("long").alias("body"))
    important = m.select("body").union(part.select("p_partkey")).where("body % 2 = 0")
    return mergetable.important_merges(_edges(spark, sf_dir), m, important).select("body_a", "body_b", "id_a", "id_b", "score")


_TASKS = "SELECT l_partkey AS body_a, l_suppkey AS body_b, CAST(l_quantity AS INT) AS pre_a, l_linenumber AS post_a, CAST(l_discount * 100 AS INT) AS pre_b, CAST(l_tax * 100 AS INT) AS post_b, l_orderkey AS id_a, l_partkey AS id_b, l_linenumber AS row FROM lineitem"


def _tasks(spark, sf_dir):
    return _t(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("body_a"), F.col("l_suppkey").alias("body_b"), F.col("l_quantity").cast("int").alias("pre_a"), F.col("l_linenumber").alias("post_a"), F.round(F.col("l_discount") * 100).cast("int").alias("pre_b"), F.round(F.col("l_tax") * 100).cast("int").alias("post_b"), F.col("l_orderkey").alias("id_a"), F.col("l_partkey").alias("id_b"), F.col("l_linenumber").alias("row"))


@query(f"""
WITH t AS ({_TASKS.replace('CAST(l_discount * 100 AS INT)', 'CAST(round(l_discount * 100) AS INT)').replace('CAST(l_tax * 100 AS INT)', 'CAST(round(l_tax * 100) AS INT)')}), s AS (SELECT p_partkey AS body, p_brand AS status FROM part)
SELECT body_a, body_b, id_a, row, a.status AS status_a, b.status AS status_b FROM t LEFT JOIN s a ON body_a = a.body LEFT JOIN s b ON body_b = b.body
WHERE (pre_a >= 20 OR post_a >= 5) AND (pre_b >= 5 OR post_b >= 4) AND body_a % 7 <> 0 AND body_b % 7 <> 0 AND (coalesce(a.status IN ('Brand#11', 'Brand#12', 'Brand#13'), FALSE) OR coalesce(b.status IN ('Brand#11', 'Brand#12', 'Brand#13'), FALSE))
AND NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_linenumber = 1 AND least(l.l_orderkey, l.l_partkey) = least(id_a, id_b) AND greatest(l.l_orderkey, l.l_partkey) = greatest(id_a, id_b))""")
def filter_tasks(spark, sf_dir):
    part = _t(spark, sf_dir, "part")
    ids = part.select(F.col("p_partkey").alias("body"))
    done = _t(spark, sf_dir, "lineitem").where("l_linenumber = 1").select(F.col("l_orderkey").alias("id_a"), F.col("l_partkey").alias("id_b"))
    got = mergetable.filter_tasks(_tasks(spark, sf_dir).where("(pre_a >= 20 OR post_a >= 5) AND (pre_b >= 5 OR post_b >= 4)"), 0, 0, ids.where("body % 7 = 0"), part.select(F.col("p_partkey").alias("body"), F.col("p_brand").alias("status")), ["Brand#11", "Brand#12", "Brand#13"], reviewed=done)
    return got.select("body_a", "body_b", "id_a", "row", "status_a", "status_b")


@query("""
WITH p AS (SELECT least(list_position(['tiny', 'F', 'O', 'P'], coalesce(a.o_orderstatus, 'tiny')), list_position(['tiny', 'F', 'O', 'P'], coalesce(b.o_orderstatus, 'tiny'))) AS i, greatest(list_position(['tiny', 'F', 'O', 'P'], coalesce(a.o_orderstatus, 'tiny')), list_position(['tiny', 'F', 'O', 'P'], coalesce(b.o_orderstatus, 'tiny'))) AS j
 FROM lineitem LEFT JOIN orders a ON l_orderkey = a.o_orderkey LEFT JOIN orders b ON l_partkey = b.o_orderkey)
SELECT ['tiny', 'F', 'O', 'P'][i] AS lower, ['tiny', 'F', 'O', 'P'][j] AS higher, count(*) AS n FROM p GROUP BY i, j""")
def status_matchups(spark, sf_dir):
    item, order = _t(spark, sf_dir, "lineitem"), _t(spark, sf_dir, "orders")
    side = lambda c, s: order.select(F.col("o_orderkey").alias(c), F.col("o_orderstatus").alias(s))
    rows = item.join(side("l_orderkey", "status_a"), "l_orderkey", "left").join(side("l_partkey", "status_b"), "l_partkey", "left")
    return mergetable.status_matchups(rows, ["tiny", "F", "O", "P"])


@query("""
WITH t AS (SELECT CASE WHEN l_linenumber < CAST(l_quantity AS BIGINT) THEN l_suppkey ELSE l_partkey END AS body, greatest(l_linenumber, CAST(l_quantity AS BIGINT)) AS post, least(l_linenumber, CAST(l_quantity AS BIGINT)) AS gain FROM lineitem)
SELECT body, max(post) AS post, count(*) AS tasks, CAST(sum(gain) AS BIGINT) AS gain, CAST(floor(CAST(100 * sum(gain) AS DOUBLE) / max(post)) AS BIGINT) AS improvement FROM t GROUP BY 1""")
def bodywise_stats(spark, sf_dir):
    t = _t(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("body_a"), F.col("l_suppkey").alias("body_b"), F.col("l_linenumber").cast("long").alias("post_a"), F.col("l_quantity").cast("long").alias("post_b"))
    return mergetable.bodywise_stats(t)


@query("""
WITH a AS (SELECT o_orderkey AS sv, o_custkey AS body FROM orders WHERE o_orderdate < TIMESTAMP '1996-01-01'), b AS (SELECT o_orderkey AS sv, o_custkey + CASE WHEN o_orderkey % 10 = 0 THEN 1 ELSE 0 END AS body FROM orders WHERE o_orderkey % 11 <> 0),
c AS (SELECT a.body AS x, b.body AS y FROM a FULL JOIN b ON a.sv = b.sv WHERE a.body IS DISTINCT FROM b.body)
SELECT DISTINCT body FROM (SELECT x AS body FROM c UNION ALL SELECT y FROM c) WHERE body IS NOT NULL AND body <> 0""")
def changed_bodies(spark, sf_dir):
    o = _t(spark, sf_dir, "orders")
    a = o.where("o_orderdate < TIMESTAMP_NTZ '1996-01-01 00:00:00'").select(F.col("o_orderkey").alias("sv"), F.col("o_custkey").alias("body"))
    b = o.where("o_orderkey % 11 != 0").select(F.col("o_orderkey").alias("sv"), (F.col("o_custkey") + F.when(F.col("o_orderkey") % 10 == 0, 1).otherwise(0)).alias("body"))
    return mergetable.changed_bodies(a, b)


@query("""
WITH m AS (SELECT o_orderkey AS sv, o_custkey AS body FROM orders WHERE o_orderkey % 2 = 0), r AS (SELECT o_orderkey AS sv FROM orders WHERE o_orderkey % 3 = 0)
SELECT o_orderkey AS sv, CASE WHEN o_orderkey % 2 = 0 THEN o_custkey WHEN o_orderkey % 3 = 0 THEN 0 ELSE o_orderkey END AS body FROM orders""")
def complete_mapping(spark, sf_dir):
    o = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("sv"), F.col("o_custkey").alias("body"))
    return mergetable.complete_mapping(o.where("sv % 2 = 0"), o.where("sv % 3 = 0").select("sv"), o.select("sv"))


@query("""
WITH g AS (SELECT c_nationkey AS mergeset, c_custkey AS body, c_acctbal > 5000 AS rich, c_mktsegment = 'BUILDING' AS built FROM customer),
t AS (SELECT mergeset, body AS target FROM g QUALIFY row_number() OVER (PARTITION BY mergeset ORDER BY rich DESC, built DESC, body) = 1), n AS (SELECT mergeset FROM g GROUP BY 1 HAVING count(*) > 1)
SELECT g.mergeset, body, target FROM g JOIN t USING (mergeset) JOIN n USING (mergeset) WHERE body <> target""")
def mergeable_groups(spark, sf_dir):
    g = _t(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("mergeset"), F.col("c_custkey").alias("body"), (F.col("c_acctbal") > 5000).alias("rich"), (F.col("c_mktsegment") == "BUILDING").alias("built"))
    return mergetable.mergeable_groups(g, ["rich", "built"]).select("mergeset", "body", "target")


@query("""
WITH b AS (SELECT l_suppkey AS body, CASE WHEN l_linenumber % 2 = 0 THEN l_returnflag || '(L)' ELSE l_returnflag || '(R)' END AS roi, CASE WHEN l_linestatus = 'O' THEN 'PreSyn' ELSE 'PostSyn' END AS kind FROM lineitem),
a AS (SELECT * FROM b UNION ALL SELECT body, regexp_replace(roi, '\\((L|R)\\)$', ''), kind FROM b)
SELECT body, roi, count(*) FILTER (kind = 'PreSyn') AS "PreSyn", count(*) FILTER (kind = 'PostSyn') AS "PostSyn" FROM a GROUP BY 1, 2""")
def roi_counts_bilateral(spark, sf_dir):
    side = F.when(F.col("l_linenumber") % 2 == 0, "(L)").otherwise("(R)")
    return synapses.roi_counts(_t(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("body"), F.concat("l_returnflag", side).alias("roi"), F.when(F.col("l_linestatus") == "O", "PreSyn").otherwise("PostSyn").alias("kind")))


@query("SELECT l_partkey AS body, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY n DESC, body LIMIT 25")
def top_bodies(spark, sf_dir):
    """A top-k report: the limit is the feature."""
    return tables.top(_t(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("body")).agg(F.count("*").alias("n")), "n", "body", 25)


@query("SELECT l_partkey AS body, count(*) AS n FROM lineitem GROUP BY 1 HAVING count(*) >= 10 ORDER BY n DESC, body LIMIT 50 OFFSET 20")
def threshold_page(spark, sf_dir):
    """A page of a report: the limit is the feature."""
    return tables.page(_t(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("body")).agg(F.count("*").alias("n")), "n", "body", 10, 20, 50)


@query("SELECT ((l_suppkey & 2097151) << 42) | ((l_partkey & 2097151) << 21) | (l_linenumber & 2097151) AS point, CAST(l_suppkey AS INT) AS z, CAST(l_partkey AS INT) AS y, l_linenumber AS x FROM lineitem")
def pack_roundtrip(spark, sf_dir):
    p = _t(spark, sf_dir, "lineitem").select(coords.pack_point("l_suppkey", "l_partkey", "l_linenumber").alias("point"), coords.point_wraps("l_suppkey", "l_partkey", "l_linenumber").alias("wraps"))
    return p.select("point", *(c.alias(a) for a, c in zip("zyx", coords.unpack_point("point", "wraps"))))


@query("SELECT l_suppkey AS z, l_partkey AS y, l_linenumber AS x FROM lineitem")
def block_point_roundtrip(spark, sf_dir):
    p = _t(spark, sf_dir, "lineitem").select(coords.pack_block_point(-F.col("l_suppkey"), "l_partkey", "l_linenumber").alias("p"), coords.point_wraps(-F.col("l_suppkey"), "l_partkey", "l_linenumber").alias("wraps"))
    z, y, x = coords.unpack_block_point("p", wraps="wraps")
    return p.select((-z).cast("long").alias("z"), y.cast("long").alias("y"), x.alias("x"))


@query("SELECT l_suppkey AS label, CAST(0 AS BIGINT) AS z, (l_partkey >> 6) << 6 AS y, CAST(0 AS BIGINT) AS x, count(*) AS n FROM lineitem WHERE l_suppkey <> 0 GROUP BY 1, 3")
def block_stats(spark, sf_dir):
    v = _t(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("label"), F.lit(0).cast("long").alias("z"), F.col("l_partkey").alias("y"), F.col("l_linenumber").cast("long").alias("x"))
    return geometry.block_stats(v)


@query(f'SELECT body_pre % 6 AS "left", body_post % 7 AS "right", count(*) AS n FROM ({_CONN}) WHERE body_pre % 6 <> 0 AND body_post % 7 <> 0 GROUP BY 1, 2')
def contingency(spark, sf_dir):
    c = _connections(spark, sf_dir)
    return geometry.contingency(c.select("post_id", (F.col("body_pre") % 6).alias("label")), c.select("post_id", (F.col("body_post") % 7).alias("label")), ["post_id"])


@query(f"""
WITH p AS (SELECT body_pre % 6 AS l, body_post % 7 AS r, count(*) AS n FROM ({_CONN}) WHERE body_pre % 6 <> 0 AND body_post % 7 <> 0 GROUP BY 1, 2), s AS (SELECT *, sum(n) OVER (PARTITION BY l) AS sl, sum(n) OVER (PARTITION BY r) AS sr FROM p),
f AS (SELECT *, row_number() OVER (PARTITION BY l ORDER BY n DESC, r) AS a, row_number() OVER (PARTITION BY r ORDER BY n DESC, l) AS b FROM s WHERE n >= 10)
SELECT l AS "left", r AS "right", n, n / CAST(sl + sr - n AS DOUBLE) AS jaccard FROM f WHERE a = 1 OR b = 1""")
def match_overlaps(spark, sf_dir):
    return geometry.match_overlaps(contingency(spark, sf_dir), least=10, favorites="any")


@query(f"SELECT label, min(z) AS z0, min(y) AS y0, min(x) AS x0, max(z) + 1 AS z1, max(y) + 1 AS y1, max(x) + 1 AS x1 FROM ({_VOX}) GROUP BY 1")
def region_boxes(spark, sf_dir):
    return geometry.region_boxes(_voxels(spark, sf_dir))


@query(f"SELECT label, avg(z) AS z, avg(y) AS y, avg(x) AS x, count(*) AS size FROM ({_VOX}) GROUP BY 1")
def region_centroids(spark, sf_dir):
    return geometry.region_centroids(_voxels(spark, sf_dir))


_RLE = f"SELECT z, y, min(x) AS x0, max(x) AS x1 FROM (SELECT *, x - row_number() OVER (PARTITION BY z, y ORDER BY x) AS g FROM (SELECT DISTINCT z, y, x FROM ({_VOX}))) GROUP BY z, y, g"


@query(_RLE)
def rle_encode(spark, sf_dir):
    return geometry.encode_runs(_voxels(spark, sf_dir))


@query(f"SELECT DISTINCT z, y, x FROM ({_VOX})")
def rle_roundtrip(spark, sf_dir):
    return geometry.decode_runs(geometry.encode_runs(_voxels(spark, sf_dir)))


@query(f'SELECT z, y, bz, "by", bx, greatest(x0, bx * 8) AS x0, least(x1, bx * 8 + 7) AS x1 FROM (SELECT *, CAST(floor(z / 8.0) AS BIGINT) AS bz, CAST(floor(y / 8.0) AS BIGINT) AS "by", unnest(range(CAST(floor(x0 / 8.0) AS BIGINT), CAST(floor(x1 / 8.0) AS BIGINT) + 1)) AS bx FROM ({_RLE}))')
def rle_split(spark, sf_dir):
    return geometry.split_runs(geometry.encode_runs(_voxels(spark, sf_dir)), 8)


@query(f"""
WITH g AS (SELECT y + d AS y, x0 - 1 AS x0, x1 + 1 AS x1 FROM ({_RLE}), (VALUES (-1), (0), (1)) t(d)), v AS (SELECT DISTINCT y, unnest(range(x0, x1 + 1)) AS x FROM g),
r AS (SELECT y, min(x) AS x0, max(x) AS x1 FROM (SELECT *, x - row_number() OVER (PARTITION BY y ORDER BY x) AS k FROM v) GROUP BY y, k)
SELECT z, CAST(y AS INT) AS y, CAST(x0 AS INT) AS x0, CAST(x1 AS INT) AS x1 FROM r, (VALUES (-1), (0), (1)) t(z)""")
def rle_dilate(spark, sf_dir):
    return geometry.dilate_runs(geometry.encode_runs(_voxels(spark, sf_dir)), 1)


@query("""
SELECT o_orderkey, n_nationkey FROM orders JOIN nation ON CAST(o_totalprice AS BIGINT) BETWEEN n_nationkey * 10000 AND n_nationkey * 10000 + 15000""")
def points_in_intervals(spark, sf_dir):
    points = _t(spark, sf_dir, "orders").select("o_orderkey", F.rint("o_totalprice").cast("long").alias("v"))
    spans = _t(spark, sf_dir, "nation").select("n_nationkey", (F.col("n_nationkey") * 10000).cast("long").alias("lo"), (F.col("n_nationkey") * 10000 + 15000).cast("long").alias("hi"))
    return geometry.in_intervals(points, spans, "v", "lo", "hi", 10000).select("o_orderkey", "n_nationkey")


@query("""
SELECT l_orderkey, l_linenumber, CASE WHEN l_partkey >> 5 BETWEEN 2 AND 3 THEN 'c' WHEN l_partkey >> 5 BETWEEN 0 AND 2 THEN 'a' ELSE '<unspecified>' END AS roi FROM lineitem""")
def points_in_regions(spark, sf_dir):
    regions = spark.createDataFrame([("a", 0, 0, 0, 2), ("c", 0, 0, 2, 3)], "roi string, z int, y int, x0 int, x1 int")
    points = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.lit(0).alias("z"), F.lit(0).alias("y"), F.col("l_partkey").alias("x"))
    return geometry.points_in_regions(points, regions).select("l_orderkey", "l_linenumber", "roi")


def _events(spark, sf_dir):
    e = _t(spark, sf_dir, "events")
    kind = F.when(F.col("event_type") == "error", "removed").when(F.col("event_type") == "signup", "new").otherwise("changed")
    return e.select(F.col("user_id").alias("body"), F.col("event_id").alias("mutid"), F.lit(0).alias("seq"), kind.alias("event"), "ts", "event_type", "value", "props")


@query("SELECT event_id, ts, user_id FROM events WHERE event_id BETWEEN 100 AND 700 AND event_type IN ('purchase', 'error')")
def log_filter(spark, sf_dir):
    e = _t(spark, sf_dir, "events").withColumnsRenamed({"event_id": "mutid", "event_type": "action"})
    return log.with_actions(log.in_range(e, first=100, last=700), ["purchase", "error"]).select(F.col("mutid").alias("event_id"), "ts", "user_id")


@query("""
WITH k AS (SELECT user_id AS body, arg_min(event_type, event_id) AS f, arg_max(event_type, event_id) AS l FROM events GROUP BY 1)
SELECT body, CASE WHEN l = 'error' THEN 'removed' WHEN f = 'signup' THEN 'new' ELSE 'changed' END AS state FROM k WHERE NOT (l = 'error' AND f = 'signup')""")
def log_affected(spark, sf_dir):
    e = _events(spark, sf_dir)
    rows = e.select(F.col("mutid"), F.when(F.col("event") == "removed", "merge").when(F.col("event") == "new", "cleave").otherwise("split-supervoxel").alias("action"), F.when(F.col("event") == "removed", F.array("body")).otherwise(F.array().cast("array<long>")).alias("merged"), F.when(F.col("event") == "changed", F.col("body")).alias("target_body"), F.when(F.col("event") == "new", F.col("body")).alias("child_body"))
    return log.affected_bodies(rows)


@query("""
WITH t AS (SELECT *, CAST(sum(CASE WHEN event_type = 'click' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS transaction FROM events)
SELECT user_id, event_id, transaction, min(CASE WHEN event_type = 'purchase' THEN event_id END) OVER (PARTITION BY user_id, transaction ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS completed FROM t""")
def log_transactions(spark, sf_dir):
    e = _t(spark, sf_dir, "events")
    return log.transactions(e, "user_id", ["event_id"], F.col("event_type") == "click", F.col("event_type") == "purchase", "event_id").select("user_id", "event_id", "transaction", "completed")


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def log_json_props(spark, sf_dir):
    return _t(spark, sf_dir, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@query("SELECT user_id, max(event_id) AS event_id FROM events GROUP BY 1")
def log_last(spark, sf_dir):
    return log.last_mutation(_t(spark, sf_dir, "events").withColumnRenamed("event_id", "mutid"), ["user_id"]).select("user_id", F.col("mutid").alias("event_id"))


def _forest(spark, sf_dir):
    return _t(spark, sf_dir, "customer").where("c_custkey > 1").select(F.floor(F.col("c_custkey") / 2).alias("target"), F.col("c_custkey").alias("absorbed"))


@query("SELECT c_custkey AS body, CAST(1 AS BIGINT) AS owner FROM customer WHERE c_custkey > 0 UNION SELECT 1, 1")
def owners(spark, sf_dir):
    return graph.owners(_forest(spark, sf_dir))


@query("""
WITH RECURSIVE e AS (SELECT c_custkey AS body, c_custkey // 2 AS next FROM customer WHERE c_custkey > 1),
r AS (SELECT body, next AS top, 1 AS n FROM e UNION ALL SELECT r.body, e.next, n + 1 FROM r JOIN e ON r.top = e.body)
SELECT body, top AS owner, n AS merge_count FROM r WHERE top = 1""")
def merge_chains(spark, sf_dir):
    return graph.merge_chains(_forest(spark, sf_dir)).select("body", "owner", "merge_count")


@query("""
WITH m AS (SELECT o_custkey, least(2 * o_custkey, min(2 * o_orderkey + 1)) AS c FROM orders GROUP BY 1)
SELECT 2 * o_custkey AS node, c AS component FROM m UNION ALL SELECT 2 * o_orderkey + 1, c FROM orders JOIN m USING (o_custkey)""")
def connected_components(spark, sf_dir):
    """Customers with their orders: the components are stars, so SQL finds them too."""
    e = _t(spark, sf_dir, "orders").select((2 * F.col("o_custkey")).alias("a"), (2 * F.col("o_orderkey") + 1).alias("b"))
    return graph.connected_components(None, e)


@query("""
WITH RECURSIVE e AS (SELECT c_custkey AS node, c_custkey // 2 AS parent FROM customer WHERE c_custkey > 1),
r AS (SELECT c_custkey AS start, c_custkey AS node, 0 AS depth FROM customer UNION ALL SELECT start, parent, depth + 1 FROM r JOIN e ON r.node = e.node) SELECT start, node, depth FROM r""")
def ancestors(spark, sf_dir):
    e = _forest(spark, sf_dir).select(F.col("absorbed").alias("node"), F.col("target").alias("parent"))
    return graph.ancestors(e, _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("node")))


@query("""
SELECT (3 * a.s_suppkey) || ',' || (3 * a.s_nationkey + 1) || ',' || (3 * b.s_suppkey) AS path FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey""")
def paths_upto_depth(spark, sf_dir):
    """Ways between suppliers over nations and regions, two steps long at most."""
    supp, nation = _t(spark, sf_dir, "supplier"), _t(spark, sf_dir, "nation")
    e = supp.select((3 * F.col("s_suppkey")).alias("a"), (3 * F.col("s_nationkey") + 1).cast("long").alias("b")).union(nation.select((3 * F.col("n_nationkey") + 1).cast("long"), (3 * F.col("n_regionkey") + 2).cast("long")))
    got = graph.paths(e, supp.select((3 * F.col("s_suppkey")).alias("node")), 2)
    return got.select(F.array_join(F.transform("path", lambda x: x.cast("string")), ",").alias("path"))


@query("""
WITH u AS (SELECT vec_id, label, unnest(embedding) AS x, unnest(range(64)) AS k FROM embeddings), s AS (SELECT label, k, sum(CAST(x AS DOUBLE)) AS s FROM u GROUP BY 1, 2), n AS (SELECT label FROM embeddings GROUP BY 1 HAVING count(*) > 1),
d AS (SELECT vec_id, u.label, sum(x * (s - x)) AS ab, sum(CAST(x AS DOUBLE) * x) AS aa, sum((s - x) * (s - x)) AS bb FROM u JOIN s ON u.label = s.label AND u.k = s.k JOIN n ON u.label = n.label GROUP BY 1, 2)
SELECT vec_id, label, round(ab / sqrt(aa) / sqrt(bb), 6) AS similarity FROM d""")
def cosine_leave_one_out(spark, sf_dir):
    return annotations.leave_one_out(_t(spark, sf_dir, "embeddings")).withColumn("similarity", F.round("similarity", 6))


@query(f"SELECT label, CAST(0 AS INT) AS z, y, x FROM ({_VOX}) WHERE label <> 0 QUALIFY row_number() OVER (PARTITION BY label ORDER BY z, y, x) = 1")
def one_point_per_body(spark, sf_dir):
    return geometry.first_voxel(_voxels(spark, sf_dir))


@query("""
SELECT l_orderkey, l_linenumber, l_partkey, CAST(CASE WHEN l_linenumber IN (1, 2) THEN CASE WHEN l_discount > 0.05 THEN 1.0 ELSE 2.0 END WHEN l_linenumber = 3 THEN 3.0 ELSE 10 + (1 - l_discount) END AS FLOAT) AS score FROM lineitem""")
def agglo_score(spark, sf_dir):
    res = F.when(F.col("l_linenumber") <= 2, 32).when(F.col("l_linenumber") == 3, 16).otherwise(8)
    return _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", scores.by_resolution(res, F.col("l_discount"), scores.tiered([(F.col("l_discount") > 0.05, F.lit(1.0))], 2.0), F.lit(3.0)).alias("score"))


@query("SELECT greatest(least(l_quantity, l_discount), least(l_tax, l_extendedprice)) AS score, l_orderkey, l_linenumber FROM lineitem")
def speculative_score(spark, sf_dir):
    c = F.col
    return _t(spark, sf_dir, "lineitem").select(scores.speculative(c("l_quantity"), c("l_discount"), c("l_tax"), c("l_extendedprice")).alias("score"), "l_orderkey", "l_linenumber")


@query("SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_tumbling(spark, sf_dir):
    events = stream.table_stream(spark, f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    got = stream.into_table(stream.tumbling(events, "ts", "1 hour", ["event_type"], "1 hour"), "complete")
    return got.select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n")


@query("""
WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL '6 hours' THEN 0 ELSE 1 END AS b FROM events), s AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM e)
SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, g""")
def event_sessions(spark, sf_dir):
    got = stream.sessions(_t(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", "6 hours", "user_id", "1 hour")
    return got.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n")


@query("""
WITH k AS (SELECT user_id AS body, arg_min(event_type, event_id) AS f, arg_max(event_type, event_id) AS l, max(event_id) AS mutid FROM events GROUP BY 1)
SELECT body, CASE WHEN l = 'error' AND f = 'signup' THEN NULL WHEN l = 'error' THEN 'removed' WHEN f = 'signup' THEN 'new' ELSE 'changed' END AS state, mutid FROM k""")
def stream_body_states(spark, sf_dir):
    events = stream.table_stream(spark, f"{sf_dir}/events.parquet")
    kind = F.when(F.col("event_type") == "error", "removed").when(F.col("event_type") == "signup", "new").otherwise("changed")
    rows = events.select(F.col("user_id").alias("body"), F.col("event_id").alias("mutid"), F.lit(0).alias("seq"), kind.alias("event"))
    return stream.into_table(stream.body_states(rows), "update", ["body"])


@query()
def cleave(spark, sf_dir):
    edges = _t(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("body"), F.col("l_partkey").alias("a"), (-F.col("l_linenumber")).cast("long").alias("b"), F.col("l_discount").alias("weight"))
    seeds = edges.groupBy("body").agg(F.min("a").alias("lo"), F.max("a").alias("hi")).where("lo < hi").select("body", F.inline(F.array(F.struct(F.col("lo").alias("node"), F.lit(1).cast("long").alias("seed")), F.struct(F.col("hi").alias("node"), F.lit(2).cast("long").alias("seed")))))
    return graph.cleave(edges, seeds)


@query("""
WITH p AS (SELECT DISTINCT l_partkey AS id, l_partkey % 40 AS z, l_partkey // 40 % 40 AS y, l_partkey % 7 * 3 AS x FROM lineitem)
SELECT p.id AS a, q.id AS b, sqrt(pow(p.z - q.z, 2) + pow(p.y - q.y, 2) + pow(p.x - q.x, 2)) AS d FROM p JOIN p q ON p.id < q.id WHERE sqrt(pow(p.z - q.z, 2) + pow(p.y - q.y, 2) + pow(p.x - q.x, 2)) <= 3""")
def close_pairs(spark, sf_dir):
    p = _t(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("id")).distinct()
    pts = p.select("id", (F.col("id") % 40).alias("z"), (F.floor(F.col("id") / 40) % 40).alias("y"), (F.col("id") % 7 * 3).alias("x"))
    return graph.close_pairs(pts, 3.0)


@query("SELECT c_custkey, regexp_replace(lower(c_mktsegment), '[^a-z]', '', 'g') AS camel, '#' || lower(lpad(to_hex(c_custkey % 16777216), 6, '0')) AS color FROM customer")
def names_and_colors(spark, sf_dir):
    c = _t(spark, sf_dir, "customer")
    camel = names.snake_to_camel(F.regexp_replace(F.lower("c_mktsegment"), "[^a-z]", ""))
    return c.select("c_custkey", camel.alias("camel"), coords.hex_color(F.col("c_custkey") % 16777216).alias("color"))


_LABELS = "SELECT y, x, CAST(sum(label) % 3 AS INT) AS label FROM (SELECT CAST(l_suppkey AS INT) % 40 AS y, CAST(l_partkey AS INT) % 60 AS x, l_linenumber AS label FROM lineitem) GROUP BY 1, 2"


def _image(spark, sf_dir) -> DataFrame:
    rows = _t(spark, sf_dir, "lineitem").select((F.col("l_suppkey").cast("int") % 40).alias("y"), (F.col("l_partkey").cast("int") % 60).alias("x"), F.col("l_linenumber").alias("label"))
    return rows.groupBy("y", "x").agg((F.sum("label") % 3).cast("int").alias("label")).select(F.lit(0).alias("z"), "y", "x", "label")


@query(f"""
WITH v AS ({_LABELS}), o AS (SELECT * FROM (VALUES (0, 1), (0, -1), (1, 0), (-1, 0)) t(dy, dx))
SELECT DISTINCT v.y, v.x, v.label FROM v, o, v w WHERE w.y = v.y + dy AND w.x = v.x + dx AND w.label <> v.label""")
def edge_voxels(spark, sf_dir):
    return volume.edges(_image(spark, sf_dir)).select("y", "x", "label")


@query(f"""
WITH v AS ({_LABELS}), o AS (SELECT * FROM (VALUES (0, 1), (1, 0)) t(dy, dx))
SELECT least(v.label, w.label) AS a, greatest(v.label, w.label) AS b, count(*) AS area FROM v, o, v w WHERE w.y = v.y + dy AND w.x = v.x + dx AND w.label <> v.label AND v.label <> 0 AND w.label <> 0 GROUP BY 1, 2""")
def adjacencies(spark, sf_dir):
    return geometry.adjacencies(_image(spark, sf_dir))


@query(f"SELECT y, x, label FROM (SELECT y // 4 AS y, x // 4 AS x, label, count(*) AS n FROM ({_LABELS}) GROUP BY 1, 2, 3) QUALIFY row_number() OVER (PARTITION BY y, x ORDER BY n DESC, label) = 1")
def mode_downsample(spark, sf_dir):
    return volume.mode_downsample(_image(spark, sf_dir), 4).select("y", "x", "label")


@query(f"""
WITH RECURSIVE v AS (SELECT y, x, label, y * 2097152 + x AS id FROM ({_LABELS}) WHERE label <> 0), o AS (SELECT * FROM (VALUES (0, 1), (0, -1), (1, 0), (-1, 0)) t(dy, dx)),
e AS (SELECT v.id AS a, w.id AS b FROM v, o, v w WHERE w.y = v.y + dy AND w.x = v.x + dx AND w.label = v.label),
r AS (SELECT id AS node, id AS c FROM v UNION SELECT e.b, r.c FROM r JOIN e ON r.node = e.a)
SELECT v.y, v.x, v.label, CAST(m.c AS BIGINT) AS component FROM v JOIN (SELECT node, min(c) AS c FROM r GROUP BY 1) m ON v.id = m.node""")
def label_components(spark, sf_dir):
    return volume.label_components(_image(spark, sf_dir)).select("y", "x", "label", "component")


@query(f"SELECT label, count(*) AS size, avg(0) AS center_z, avg(y) AS center_y, avg(x) AS center_x, covar_pop(y, x) AS cov_yx FROM ({_LABELS}) GROUP BY 1")
def principal_axes(spark, sf_dir):
    return volume.principal_axes(_image(spark, sf_dir)).select("label", "size", "center_z", "center_y", "center_x", "cov_yx")


_WHOLE = f"SELECT z, y, x, min(label) AS label FROM ({_VOX}) GROUP BY 1, 2, 3"


def _whole_image(spark, sf_dir) -> DataFrame:
    """All voxels, unfolded; where line items share one, the lower line number is its label."""
    return _voxels(spark, sf_dir).groupBy("z", "y", "x").agg(F.min("label").alias("label"))


@query(f"""
WITH v AS ({_WHOLE}), o AS (SELECT * FROM (VALUES (0, 1), (0, -1), (1, 0), (-1, 0)) t(dy, dx))
SELECT DISTINCT v.y, v.x, v.label FROM v, o, v w WHERE w.y = v.y + dy AND w.x = v.x + dx AND w.label <> v.label""")
def whole_edge_voxels(spark, sf_dir):
    return volume.edges(_whole_image(spark, sf_dir)).select("y", "x", "label")


@query(f"""
WITH v AS ({_WHOLE}), o AS (SELECT * FROM (VALUES (0, 1), (1, 0)) t(dy, dx))
SELECT least(v.label, w.label) AS a, greatest(v.label, w.label) AS b, count(*) AS area FROM v, o, v w WHERE w.y = v.y + dy AND w.x = v.x + dx AND w.label <> v.label GROUP BY 1, 2""")
def whole_adjacencies(spark, sf_dir):
    return geometry.adjacencies(_whole_image(spark, sf_dir))


@query(f"SELECT y, x, label FROM (SELECT y // 4 AS y, x // 4 AS x, label, count(*) AS n FROM ({_WHOLE}) GROUP BY 1, 2, 3) QUALIFY row_number() OVER (PARTITION BY y, x ORDER BY n DESC, label) = 1")
def whole_mode_downsample(spark, sf_dir):
    return volume.mode_downsample(_whole_image(spark, sf_dir), 4).select("y", "x", "label")


@query()
def whole_label_components(spark, sf_dir):
    """Components of the whole image; SQL would recurse over all pairs of a component's voxels."""
    return volume.label_components(_whole_image(spark, sf_dir)).select("y", "x", "label", "component")


@query(f"SELECT label, count(*) AS size, avg(0) AS center_z, avg(y) AS center_y, avg(x) AS center_x, covar_pop(y, x) AS cov_yx FROM ({_WHOLE}) GROUP BY 1")
def whole_principal_axes(spark, sf_dir):
    return volume.principal_axes(_whole_image(spark, sf_dir)).select("label", "size", "center_z", "center_y", "center_x", "cov_yx")


_PAIRS = f'SELECT body_pre AS "left", body_post AS "right", count(*) AS n FROM ({_CONN}) WHERE body_pre <> 0 AND body_post <> 0 GROUP BY 1, 2'


@query(_PAIRS)
def whole_contingency(spark, sf_dir):
    c = _connections(spark, sf_dir)
    return geometry.contingency(c.select("post_id", F.col("body_pre").alias("label")), c.select("post_id", F.col("body_post").alias("label")), ["post_id"])


@query(f"""
WITH s AS (SELECT "left" AS l, "right" AS r, n, sum(n) OVER (PARTITION BY "left") AS sl, sum(n) OVER (PARTITION BY "right") AS sr FROM ({_PAIRS})),
f AS (SELECT *, row_number() OVER (PARTITION BY l ORDER BY n DESC, r) AS a, row_number() OVER (PARTITION BY r ORDER BY n DESC, l) AS b FROM s)
SELECT l AS "left", r AS "right", n, n / CAST(sl + sr - n AS DOUBLE) AS jaccard FROM f WHERE a = 1 OR b = 1""")
def whole_match_overlaps(spark, sf_dir):
    return geometry.match_overlaps(whole_contingency(spark, sf_dir), favorites="any")


@query("SELECT event_type AS tag, count(*) AS n FROM events GROUP BY 1")
def tag_summary(spark, sf_dir):
    return store.tag_summary(_t(spark, sf_dir, "events").select(F.array("event_type").alias("Tags")))


@query("""
WITH m AS (SELECT o_orderkey AS sv, o_custkey AS body FROM orders WHERE o_orderkey % 2 = 0)
SELECT l_orderkey AS sv, CASE WHEN l_orderkey % 9 = 0 THEN 0 ELSE coalesce(body, l_orderkey) END AS body FROM (SELECT DISTINCT l_orderkey FROM lineitem) LEFT JOIN m ON l_orderkey = sv""")
def map_ids(spark, sf_dir):
    o = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("sv"), F.col("o_custkey").alias("body"))
    wanted = _t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("sv")).distinct()
    return store.map_ids(wanted, o.where("sv % 2 = 0"), wanted.where("sv % 9 = 0"))


@query("""SELECT p_partkey AS label, CAST(coalesce(sum(l_quantity), 0) AS BIGINT) AS size FROM part LEFT JOIN (SELECT * FROM lineitem WHERE l_returnflag = 'A') ON p_partkey = l_partkey GROUP BY 1""")
def sizes_of(spark, sf_dir):
    index = _t(spark, sf_dir, "lineitem").where("l_returnflag = 'A'").select(F.col("l_partkey").alias("label"), F.col("l_quantity").cast("long").alias("count"))
    return store.sizes_of(index, _t(spark, sf_dir, "part").select(F.col("p_partkey").alias("label")))


@query("SELECT o_custkey AS body, CAST(floor((row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1) / 3) AS BIGINT) AS batch, o_orderkey AS sv FROM orders")
def mapping_batches(spark, sf_dir):
    m = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("sv"), F.col("o_custkey").alias("body"))
    return store.mapping_batches(m, 3).select("body", "batch", F.explode("svs").alias("sv"))


@query("""
SELECT l_suppkey AS k, l_returnflag AS v, CAST(min(r) AS BIGINT) AS start, CAST(max(r) + 1 AS BIGINT) AS stop FROM (
 SELECT *, sum(n) OVER (PARTITION BY l_suppkey ORDER BY r ROWS UNBOUNDED PRECEDING) AS g FROM (
  SELECT l_suppkey, l_returnflag, row_number() OVER w - 1 AS r, CASE WHEN l_returnflag = lag(l_returnflag) OVER w THEN 0 ELSE 1 END AS n FROM lineitem WINDOW w AS (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice))) GROUP BY l_suppkey, l_returnflag, g""")
def runs(spark, sf_dir):
    rows = _t(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("k"), F.col("l_returnflag").alias("v"), "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    return tables.runs(rows, ["k"], ["l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"], "v")


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 AS n, floor((row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1) / 100)::BIGINT AS chunk FROM orders")
def chunks(spark, sf_dir):
    rows = tables.numbered(_t(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), ["o_totalprice", "o_orderkey"])
    return rows.select("o_orderkey", "n", F.floor(F.col("n") / 100).alias("chunk"))


@query("""
WITH n AS (SELECT p_partkey AS label, p_brand AS brand, p_type AS type FROM part), k AS (SELECT label, 'brand' AS c, replace(brand, ' ', '_') AS t FROM n UNION ALL SELECT label, 'type', replace(type, ' ', '_') FROM n)
SELECT label AS segment, count(*) AS tags FROM k GROUP BY 1""")
def segment_tags(spark, sf_dir):
    codes, _ = annotations.tag_codes(_t(spark, sf_dir, "part").select(F.col("p_partkey").alias("segment"), F.col("p_brand").alias("brand"), F.col("p_type").alias("type")), ["brand", "type"])
    return codes.select("segment", F.size("codes").cast("long").alias("tags"))


@query("""
WITH s AS (SELECT c_custkey AS body, c_mktsegment AS status, c_nationkey FROM customer)
SELECT s.body, CASE WHEN o.body IS NOT NULL AND list_position(['AUTOMOBILE', 'BUILDING', 'FURNITURE', 'MACHINERY', 'HOUSEHOLD'], s.status) < 3 THEN 'FURNITURE' ELSE s.status END AS status
FROM s LEFT JOIN (SELECT DISTINCT o_custkey AS body FROM orders WHERE o_orderstatus = 'P') o ON s.body = o.body""")
def upgrade_status(spark, sf_dir):
    c = _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("body"), F.col("c_mktsegment").alias("status"))
    bodies = _t(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("body"))
    return annotations.upgrade_status(c, bodies, "FURNITURE", ["AUTOMOBILE", "BUILDING", "FURNITURE", "MACHINERY", "HOUSEHOLD"])


@query("""
SELECT a.c_custkey AS body, b.s_acctbal IS NOT NULL AS both FROM customer a FULL JOIN supplier b ON a.c_custkey = b.s_suppkey""")
def outer_merge(spark, sf_dir):
    a = _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("body"), F.col("c_acctbal").alias("bal"))
    b = _t(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("body"), F.col("s_acctbal").alias("bal"))
    return mergetable.outer_merge(a, b, "body").select("body", F.col("bal_b").isNotNull().alias("both"))


@query()
def spanning_tree(spark, sf_dir):
    """Nations and market segments, joined by their customers of least balance."""
    segment = F.array_position(F.array(*(F.lit(x) for x in ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"))), F.col("c_mktsegment"))
    return graph.spanning_tree(_t(spark, sf_dir, "customer").select(F.col("c_nationkey").cast("long").alias("a"), (-segment).cast("long").alias("b"), F.col("c_acctbal").alias("weight")))
