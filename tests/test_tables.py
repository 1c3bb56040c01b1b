from pyspark.sql import functions as F

from neurospan.functions import coords, names, scores
from neurospan.operators import mergetable, synapses, tables


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_keep_last_with_null_keys(spark):
    df = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (None, 1, "c"), (None, 2, "d")], "k int, o int, v string")
    assert {(r.k, r.v) for r in tables.keep_one(df, ["k"], ["o"], last=True).collect()} == {(1, "b"), (None, "d")}


def test_unordered_duplicates(spark):
    df = spark.createDataFrame([(1, 2, 0), (2, 1, 1), (3, 4, 2)], "a int, b int, o int")
    assert rows(tables.drop_unordered_duplicates(df, ["a", "b"], ["o"])) == [(1, 2, 0), (3, 4, 2)]
    assert rows(tables.drop_unordered_duplicates(df, ["a", "b"], ["o"], "last")) == [(2, 1, 1), (3, 4, 2)]
    assert rows(tables.drop_unordered_duplicates(df, ["a", "b"], ["o"], None)) == [(3, 4, 2)]


def test_numbered_and_running_sum_match_one_window(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 997).alias("o"), "id")
    got = tables.running_sum(tables.numbered(df, ["o", "id"]), ["o", "id"], {"s": F.col("id")}).collect()
    total = 0
    for n, r in enumerate(sorted(got, key=lambda r: (r.o, r.id))):
        total += r.id
        assert (r.n, r.s) == (n, total)


def test_runs(spark):
    df = spark.createDataFrame([(1, k, v) for k, v in enumerate([5, 5, None, None, 7, 5])], "p int, o int, v int")
    got = {(r.v, r.start, r.stop) for r in tables.runs(df, ["p"], ["o"], "v").collect()}
    assert got == {(5, 0, 2), (None, 2, 4), (7, 4, 5), (5, 5, 6)}


def test_points_pack_signed(spark):
    pts = [(0, 0, 0), (-1, 5, -1048576), (1048575, -7, 63), (-64, -65, 128)]
    df = spark.createDataFrame(pts, "z int, y int, x int")
    for pack, unpack in ((coords.pack_point, coords.unpack_point), (coords.pack_block_point, coords.unpack_block_point)):
        got = df.select("*", pack("z", "y", "x").alias("p")).select("z", "y", "x", *(c.alias(f"u{a}") for a, c in zip("zyx", unpack("p")))).collect()
        assert all((r.z, r.y, r.x) == (r.uz, r.uy, r.ux) for r in got)
    order = df.select("z", "y", "x", coords.pack_block_point("z", "y", "x").alias("p")).orderBy("p").collect()
    key = lambda r: ((r.z >> 6, r.y >> 6, r.x >> 6), (r.z, r.y, r.x))
    assert [key(r) for r in order] == sorted(key(r) for r in order)


def test_morton_roundtrip(spark):
    shape = [3, 5, 2]
    df = spark.range(30).select((F.col("id") % 3).alias("z"), (F.floor(F.col("id") / 3) % 5).alias("y"), F.floor(F.col("id") / 15).alias("x"))
    got = df.select("*", coords.morton(["z", "y", "x"], shape).alias("m")).select("*", *(c.alias(f"u{k}") for k, c in enumerate(coords.unmorton("m", shape)))).collect()
    assert all((r.z, r.y, r.x) == (r.u0, r.u1, r.u2) for r in got) and len({r.m for r in got}) == 30


def test_rounding(spark):
    df = spark.createDataFrame([(-1,), (0,), (5,), (10,)], "c int")
    assert [tuple(r) for r in df.select(coords.round_coord("c", 10), coords.round_coord("c", 10, "up"), coords.round_coord("c", 10, "closest")).collect()] == [(-10, 0, 0), (0, 0, 0), (0, 10, 0), (10, 10, 10)]


def test_grid_boxes(spark):
    df = spark.createDataFrame([(0, 0, 5, 10, 10, 25)], "z0 int, y0 int, x0 int, z1 int, y1 int, x1 int")
    got = coords.boxes_from_grid(df, {"z": 10, "y": 10, "x": 10}, clipped=True)
    assert sorted((r.x0, r.x1) for r in got.collect()) == [(5, 10), (10, 20), (20, 25)]
    full = {"z": (0, 10), "y": (0, 10), "x": (0, 20)}
    assert not coords.is_covered(df, full, {"z": 5, "y": 5, "x": 5}).first().covered
    assert coords.is_covered(df.withColumn("x0", F.lit(0)), full, {"z": 5, "y": 5, "x": 5}).first().covered


def test_names(spark):
    df = spark.createDataFrame([("someName2", "some_name")], "c string, s string")
    assert tuple(df.select(names.camel_to_snake(F.col("c")), names.snake_to_camel(F.col("s"))).first()) == ("some_name2", "someName")


def test_scores(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 1.0], [0.0, 0.0])], "a array<double>, b array<double>, z array<double>")
    r = df.select(scores.cosine(F.col("a"), F.col("b")).alias("c"), scores.cosine(F.col("a"), F.col("z")).alias("n")).first()
    assert abs(r.c - 0.5**0.5) < 1e-12 and r.n is None


def test_body_sizes(spark):
    sizes = spark.createDataFrame([(k, 10 * k) for k in range(1, 6)], "sv long, size long")
    mapping = spark.createDataFrame([(1, 11), (2, 11), (3, 12), (4, 12)], "sv long, body long")
    assert rows(mergetable.body_sizes(sizes, mapping)) == [(11, 30, 2), (12, 70, 2)]
    assert rows(mergetable.body_sizes(sizes, mapping, True)) == [(5, 50, 1), (11, 30, 2), (12, 70, 2)]


def test_normalize_and_map(spark):
    edges = spark.createDataFrame([(2, 1, 20, 10, 0.4, 0), (1, 2, 11, 21, 0.5, 1), (3, 3, 1, 1, 0.1, 2)], "id_a long, id_b long, xa int, xb int, score double, row int")
    got = mergetable.normalize(edges, ["row"]).where("id_a != id_b").collect()
    assert [(r.id_a, r.id_b, r.xa, r.xb, r.row) for r in got] == [(1, 2, 11, 21, 1)]
    mapping = spark.createDataFrame([(1, 9), (2, 9)], "sv long, body long")
    assert {(r.row, r.body) for r in mergetable.apply_mapping(edges, mapping).collect()} == {(0, 9), (1, 9), (2, 3)}


def test_changed_bodies_nulls(spark):
    a = spark.createDataFrame([(1, 5), (2, 6), (3, 0)], "sv long, body long")
    b = spark.createDataFrame([(1, 5), (2, 7), (4, 8)], "sv long, body long")
    assert rows(mergetable.changed_bodies(a, b)) == [(6,), (7,), (8,)]


def test_delete_cascade(spark):
    points = spark.createDataFrame([(1, "PreSyn"), (2, "PostSyn"), (3, "PostSyn"), (4, "PreSyn"), (5, "PostSyn")], "point_id long, kind string")
    partners = spark.createDataFrame([(1, 2), (1, 3), (4, 5)], "pre_id long, post_id long")
    gone = spark.createDataFrame([(3,), (5,)], "point_id long")
    p, q = synapses.delete_posts(points, partners, gone)
    assert rows(p.select("point_id")) == [(1,), (2,)] and rows(q.select("pre_id", "post_id")) == [(1, 2)]


def test_json_elements(spark):
    line = '[{"Pos":[3,2,1],"Kind":"PreSyn","Tags":["t"],"Prop":{"conf":"0.5","user":"u"},"Rels":[{"Rel":"PreSynTo","To":[6,5,4]}]}]'
    e = synapses.parse_elements(spark.createDataFrame([(line,), ("broken",)], "value string"))
    assert rows(synapses.elements_to_points(e).select("z", "y", "x", "kind", "user", "conf")) == [(1, 2, 3, "PreSyn", "u", 0.5)]
    assert rows(synapses.elements_to_relations(e)) == [(1, 2, 3, 4, 5, 6, "PreSynTo")]
