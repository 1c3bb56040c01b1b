"""Type strengths, organelles, slabs, grids, block masks and file formats."""

import json
import math
import random
import struct
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from neurospan.operators import autoproof, geometry, organelles, slabs
from neurospan.sources import formats, tables


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def brute_strengths(conn, types, orphan, roi):
    """A wide table as dictionaries, body by body."""
    mine = Counter()
    for a, b, w, r in conn:
        if r == roi and a == orphan and types.get(b):
            mine["post", types[b]] += w
        if r == roi and b == orphan and types.get(a):
            mine["pre", types[a]] += w
    of = defaultdict(Counter)
    for a, b, w, r in conn:
        if r == roi and types.get(a) and types.get(b) and orphan not in (a, b):
            if ("pre", types[a]) in mine:
                of[b]["pre", types[a]] += w
            if ("post", types[b]) in mine:
                of[a]["post", types[b]] += w
    return mine, {b: v for b, v in of.items() if types.get(b)}


def brute_scores(mine, of, types, least):
    cut = lambda v: [x if x >= least else 0 for x in v]
    norm = lambda v: math.sqrt(sum(x * x for x in v))
    cos = lambda a, b: sum(x * y for x, y in zip(a, b)) / (norm(a) * norm(b)) if norm(a) and norm(b) else 0.0
    out, keys = [], sorted(mine)
    for t in {types[b] for b in of}:
        peers = [b for b in of if types[b] == t]
        if len(peers) < 2:
            continue
        for b in peers:
            own = [of[b][k] for k in keys]
            mean = cut([sum(of[p][k] for p in peers if p != b) / (len(peers) - 1) for k in keys])
            both = cut([x + mine[k] for x, k in zip(own, keys)])
            out.append((b, t, round(cos(both, mean) - cos(cut(own), mean), 9), int(any(cut(own))), sum(any(of[p][k] for p in peers) for k in keys)))
    return sorted(out)


@pytest.mark.parametrize("seed", [1, 2])
def test_autoproof_matches_brute_force(spark, seed):
    r = random.Random(seed)
    types = {b: r.choice(["A", "B", "C", "D", None]) for b in range(40)}
    types |= {40: "A"}  # an orphan with a type
    conn = [(r.randrange(42), r.randrange(42), r.randrange(1, 9), r.choice(["x", "y"])) for _ in range(500)]
    conn += [(40, b, 5, "x") for b in range(6)]
    orphans = [(40, "x"), (41, "x"), (41, "y"), (99, "x")]
    c = spark.createDataFrame(conn, "body_pre long, body_post long, weight int, roi string")
    n = spark.createDataFrame(list(types.items()), "body long, type string")
    mine = autoproof.orphan_strengths(c, n, spark.createDataFrame(orphans, "orphan long, roi string"))
    of = autoproof.target_strengths(c, n, mine)
    better = autoproof.improvements(mine, of, 3).collect()
    for o, roi in orphans:
        a, b = brute_strengths(conn, types, o, roi)
        assert {(q.side, q.partner_type): q.strength for q in mine.where(f"orphan = {o} AND roi = '{roi}'").collect()} == a
        got = defaultdict(Counter)
        for q in of.where(f"orphan = {o} AND roi = '{roi}'").collect():
            got[q.target][q.side, q.partner_type] = q.strength
            assert q.type == types[q.target]
        assert got == b
        assert sorted((q.target, q.type, round(q.score, 9), q.similar_body_connections, q.similar_type_connections) for q in better if (q.orphan, q.roi) == (o, roi)) == brute_scores(a, b, types, 3)


def test_organelles(spark):
    ring = [(0, y, x) for y in range(9) for x in range(9) if y in (0, 8) or x in (0, 8)]
    vox = [(*p, 1, 10, 2) for p in ring] + [(0, 4, 4, 1, 20, 1), (0, 4, 5, 1, 20, 3), (0, 4, 3, 2, 20, 1), (0, 3, 3, 1, 30, 0), (0, 3, 3, None, 30, 1), (9, 9, 9, 1, 0, 1)]
    vox += [(50, 0, 0, 1, 40, 1), (50, 0, 200, 1, 40, 1)]
    df = spark.createDataFrame(vox, "z int, y int, x int, body long, organelle long, class int")
    got = {(r.body, r.organelle): ((r.z, r.y, r.x), r.total_size, r.classes, r.centroid_type) for r in organelles.organelle_stats(df).collect()}
    assert got == {
        (1, 10): ((0, 0, 4), 32, {2: 32}, "adjusted"), (1, 20): ((0, 4, 4), 2, {1: 1, 3: 1}, "exact"), (2, 20): ((0, 4, 3), 1, {1: 1}, "exact"), (1, 40): ((50, 0, 100), 2, {1: 2}, "error"),
    }
    assert {r.organelle for r in organelles.organelle_stats(df, least=3).collect()} == {10} and organelles.organelle_stats(df.limit(0)).count() == 0
    assert rows(organelles.organelle_classes(df).where("organelle = 20")) == [(1, 20, 1, 1), (1, 20, 3, 1), (2, 20, 1, 1)]


def test_sampled_points_are_the_same_for_any_partitioning(spark):
    r = random.Random(3)
    pts = [(i, r.randrange(100), r.randrange(100), r.randrange(100)) for i in range(400)]
    df = spark.createDataFrame(pts + pts[:50], "id long, z int, y int, x int")
    region = spark.createDataFrame([("a", z, y, 0, 1) for z in range(2) for y in range(4)], "roi string, z int, y int, x0 int, x1 int")
    draw = lambda d: rows(organelles.sampled_points(d, 15, region, "a", 12.0, 7).select("id", "z", "y", "x"))
    got = draw(df)
    assert got == draw(df.repartition(7, "x")) and len(got) == 15 and set(got) <= set(pts)
    assert all(p[1] < 64 and p[3] < 64 for p in got) and all(math.dist(p[1:], q[1:]) > 12 for p in got for q in got if p != q)
    assert organelles.sampled_points(df, None).count() == 400 and organelles.sampled_points(df.limit(0), 5).count() == 0


def test_slabs(spark):
    region = spark.createDataFrame([("a", 0, 0, 0, 9), ("a", 0, 1, 2, 30), ("b", 0, 0, 3, 3), ("c", 0, 0, 900, 901)], "roi string, z int, y int, x0 int, x1 int")
    edges = [0, 100, 210, 640]  # 100 is nearest to block 3, 210 to block 7
    got = {(q.roi, q.slab): (q.x, q.blocks, q.voxels, round(q.percent, 6)) for q in slabs.region_slabs(region, edges, 34).collect()}
    cells = {"a": [*range(10), *range(2, 31)], "b": [3], "c": [900, 901]}
    for roi, xs in cells.items():
        for slab, x, lo, hi in ((34, 0, 0, 3), (33, 100, 3, 7), (32, 210, 7, 20)):
            n = sum(lo <= v < hi for v in xs)
            assert got[roi, slab] == (x, n, n * 32768.0, round(100 * n / len(xs), 6))
    at = spark.createDataFrame([(v,) for v in (-1, 0, 99, 100, 639, 640)], "x int").select(slabs.slab_of(F.col("x"), edges, 34).alias("s"))
    assert [r.s for r in at.collect()] == [None, 34, 34, 33, 32, None]
    vox = spark.createDataFrame([(1, 98), (1, 102), (2, 98), (3, 212), (4, 98), (4, 212), (5, 50), (0, 98), (6, 98), (6, 102), (6, 208)], "label int, x int")
    assert rows(slabs.severed_bodies(vox, edges, 2)) == [(1, True, True, False), (2, True, False, True), (3, False, True, True), (4, True, True, True), (6, True, True, False)]
    assert rows(slabs.severed_bodies(vox, edges, 2, vox.where("label = 2").select("label"))) == [(2, True, False, True)]


def test_grids(spark):
    g = slabs.Grid((10, 10, 10), (1, 2, 3))
    assert g.equivalent(slabs.Grid((10, 10, 10), (11, -8, 3))) and not g.equivalent(slabs.Grid((10, 10, 10))) and not g.equivalent(slabs.Grid((10, 10, 10), (1, 2, 3), (1, 1, 1)))
    box = ((0, 5, 3), (25, 30, 23))
    df = spark.createDataFrame([(z, y, x, 1) for z in (0, 1, 20, 21, 24) for y in (11, 12, 21, 22) for x in (3, 22)], "z int, y int, x int, label int")
    cut, new = slabs.crop_to_grid(df, box, g)
    assert new == ((1, 12, 3), (21, 22, 23)) and rows(cut.select("z", "y").distinct()) == [(1, 12), (1, 21), (20, 12), (20, 21)]
    same, wide = slabs.pad_to_grid(df, box, g)
    assert wide == ((-9, 2, 3), (31, 32, 23)) and same is df
    full, _ = slabs.pad_to_grid(df, box, g, fill=0)
    assert full.where("label = 0").count() == 40 * 30 * 20 - 25 * 25 * 20 and full.where("label = 0 AND z BETWEEN 0 AND 24 AND y BETWEEN 5 AND 29").count() == 0
    assert slabs.crop_to_grid(df, ((2, 3, 4), (9, 9, 9)), g)[0].count() == 0


@pytest.mark.parametrize("halo", [0, 2])
def test_block_masks(spark, halo):
    r = random.Random(5)
    vox = {(r.randrange(-9, 20), r.randrange(20), r.randrange(-20, 20)) for _ in range(300)}
    runs = geometry.encode_runs(spark.createDataFrame(sorted(vox), "z int, y int, x int"))
    masks = slabs.block_masks(runs, 8, halo)
    assert rows(slabs.masks_to_voxels(masks, 8, halo)) == sorted(vox)
    touched = {tuple(c // 8 for c in p) for p in vox}
    got = {(m.bz, m.by, m.bx): m for m in masks.collect()}
    assert touched <= set(got) and (halo or touched == set(got))
    for k, m in got.items():
        assert (m.z0, m.y0, m.x0) == tuple(c * 8 - halo for c in k) and m.z1 - m.z0 == 8 + 2 * halo and len(m.mask) == -(-((8 + 2 * halo) ** 3) // 8)


def test_run_payload_facts(spark):
    runs = spark.createDataFrame([(1, 5, -6, 7, 9), (1, 5, -5, 1, 1), (2, 0, 0, 0, 0)], "body long, z int, y int, x0 int, x1 int")
    payloads = tables.encode_run_payload(runs)
    name = next(c for c, t in payloads.dtypes if t == "binary")
    got = {r.body: (r.voxels, r.z, r.y, r.x) for r in formats.run_payload_facts(payloads, payload=name).collect()}
    assert got == {1: (4, 5, -6, 7), 2: (1, 0, 0, 0)}
    byhand = spark.createDataFrame([(3, b"\0" * 12 + struct.pack("<4i", 4, 3, 2, 7) + struct.pack("<4i", 0, 3, 2, 1))], "body long, payload binary")
    assert rows(formats.run_payload_facts(byhand)) == [(3, 8, 2, 3, 4)]
    for bad in (b"", b"\0" * 12, b"\0" * 30):
        with pytest.raises(Exception, match="run payload"):
            formats.run_payload_facts(spark.createDataFrame([(1, bad)], "body long, payload binary")).count()


def test_skeleton_buffers(spark):
    nodes = [(1, 10, 1.0, 2.0, 3.0, -1), (1, 12, 4.0, 5.0, 6.5, 10), (1, 11, 7.0, 8.0, 9.0, 12), (2, 1, 0.0, 0.0, 0.0, 0)]
    df = spark.createDataFrame(nodes, "body long, node long, x double, y double, z double, parent long")
    made = {r.body: bytes(r.buffer) for r in formats.encode_skeletons(df).collect()}
    assert made[2] == struct.pack("<2I3f", 1, 0, 0, 0, 0)
    assert made[1] == struct.pack("<2I9f4I", 3, 2, 8, 16, 24, 56, 64, 72, 32, 40, 52, 1, 2, 2, 0)
    back = formats.decode_skeletons(formats.encode_skeletons(df))
    assert rows(back.where("body = 1")) == [(1, 0, 8.0, 16.0, 24.0, -1), (1, 1, 56.0, 64.0, 72.0, 2), (1, 2, 32.0, 40.0, 52.0, 0)]
    for bad in (made[1][:-1], made[1] + b"\0" * 4, b""):
        with pytest.raises(Exception, match="malformed"):
            formats.decode_skeletons(spark.createDataFrame([(1, bad)], "body long, buffer binary")).count()


def test_segment_properties(spark):
    doc = {"@type": "neuroglancer_segment_properties", "inline": {"ids": ["5", "7", "18446744073"], "properties": [
        {"id": "name", "type": "label", "values": ["a", "b", ""]}, {"id": "size", "type": "number", "data_type": "int32", "values": [3, -4, 5]},
        {"id": "tags", "type": "tags", "tags": ["big", "odd"], "values": [[0, 1], [], [1]]}]}}
    df = formats.segment_properties(spark.createDataFrame([(json.dumps(doc),)], "document string"))
    assert df.where("type = 'tags'").count() == 3 and rows(df.where("property = 'size'").select("segment", "data_type", "value")) == [(5, "int32", "3"), (7, "int32", "-4"), (18446744073, "int32", "5")]
    wide = formats.property_columns(df, {"name": "string", "size": "int"}, ["big", "odd"])
    assert rows(wide) == [(5, "a", 3, True, True), (7, "b", -4, False, False), (18446744073, "", 5, False, True)]


def test_task_lists(spark, tmp_path):
    r = random.Random(8)
    edges = [(i, r.randrange(1000), r.randrange(1000), *(r.randrange(99) for _ in range(6)), 0.5) for i in range(23)]
    names = ["sv_a", "sv_b", "xa", "ya", "za", "xb", "yb", "zb"]
    df = spark.createDataFrame(edges, "n int, " + ", ".join(f"{c} long" for c in names) + ", score double")
    made = formats.task_lists(df, ["n"], 5).orderBy("list").collect()
    docs = [json.loads(m.document) for m in made]
    assert [len(d["task list"]) for d in docs] == [5, 5, 5, 5, 3] and docs[0]["file type"] == "Neu3 task list" and docs[0]["file version"] == 1
    flip = lambda e: e[1:9] if e[1] <= e[2] else (e[2], e[1], *e[6:9], *e[3:6])
    assert docs[0]["task list"][0] == {"task type": "body merge", "supervoxel ID 1": flip(edges[0])[0], "supervoxel point 1": list(flip(edges[0])[2:5]), "supervoxel ID 2": flip(edges[0])[1], "supervoxel point 2": list(flip(edges[0])[5:])}
    back = formats.parse_task_lists(formats.task_lists(df, ["n"], 5), "`task type` string")
    assert rows(back.select(*names)) == sorted(map(flip, edges)) and back.where("`task type` = 'body merge'").count() == 23
    old = formats.edge_tasks(df.withColumnsRenamed({"sv_a": "id_a", "sv_b": "id_b"}))
    assert sorted(json.loads(t.task)["supervoxel ID 1"] for t in old.collect()) == sorted(flip(e)[0] for e in edges)
    with pytest.raises(ValueError):
        formats.edge_tasks(df.withColumn("id_a", F.lit(1)))
    path = str(tmp_path / "edges.csv")
    df.drop("n").coalesce(1).write.csv(path, header=True)
    schema = ", ".join(f"{c} long" for c in names) + ", score double"
    assert rows(formats.read_edge_table(spark, path, schema)) == sorted(e[1:] for e in edges)
    pq = str(tmp_path / "edges")
    df.drop("n", "zb").write.parquet(pq)
    with pytest.raises(ValueError, match="zb"):
        formats.read_edge_table(spark, pq, schema)
