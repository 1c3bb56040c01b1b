import random

import pytest
from pyspark.sql import functions as F

from neurospan.operators import annotations, geometry, graph, log
from neurospan.sources import tables as sources


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_runs_roundtrip_and_dilation(spark):
    r = random.Random(1)
    vox = {(0, r.randrange(6), r.randrange(12)) for _ in range(30)}
    df = spark.createDataFrame(sorted(vox) + sorted(vox)[:5], "z int, y int, x int")
    runs = geometry.encode_runs(df)
    assert rows(geometry.decode_runs(runs).select("z", "y", "x")) == sorted(vox)
    grown = {(z + a, y + b, x + c) for z, y, x in vox for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1)}
    assert rows(geometry.decode_runs(geometry.dilate_runs(runs, 1)).select("z", "y", "x")) == sorted(grown)
    up = {(2 * z + a, 2 * y + b, 2 * x + c) for z, y, x in vox for a in (0, 1) for b in (0, 1) for c in (0, 1)}
    assert rows(geometry.decode_runs(geometry.upsample_runs(runs)).select("z", "y", "x")) == sorted(up)
    cut = geometry.split_runs(runs, 4)
    assert rows(geometry.decode_runs(cut).select("z", "y", "x")) == sorted(vox)
    assert cut.where("floor(x0 / 4) != bx OR floor(x1 / 4) != bx").count() == 0


def test_run_payload(spark):
    runs = spark.createDataFrame([(1, 0, 1, 1, 3), (1, 0, 2, 0, 1), (2, 5, 5, 5, 5)], "body long, z int, y int, x0 int, x1 int")
    assert rows(sources.decode_run_payload(sources.encode_run_payload(runs))) == rows(runs)


def test_overlaps_of_two_images(spark):
    left, right = [0, 0, 0, 1, 1, 1, 2, 2, 2, 3, 3, 3, 4], [0, 0, 5, 5, 5, 1, 2, 2, 7, 7, 7, 8, 0]
    image = lambda v: spark.createDataFrame(list(enumerate(v)), "p int, label int")
    c = geometry.contingency(image(left), image(right), ["p"])
    assert rows(c) == [(1, 1, 1), (1, 5, 2), (2, 2, 2), (2, 7, 1), (3, 7, 2), (3, 8, 1)]
    edges = lambda **k: [r[:2] for r in rows(geometry.match_overlaps(c, **k))]
    assert edges(crossover="exclude-identities") == [(1, 5), (2, 7), (3, 7), (3, 8)]
    assert edges(crossover="exclude-all") == [(3, 7), (3, 8)]
    assert edges(favorites="mutual") == [(1, 5), (2, 2), (3, 7)]


def test_adjacencies(spark):
    df = spark.createDataFrame([(0, 0, x, x // 3 + 1) for x in range(15)], "z int, y int, x int, label int")
    assert rows(geometry.adjacencies(df)) == [(k, k + 1, 1) for k in range(1, 5)]


def test_components_and_roots(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (7, 9), (None, 4)], "a long, b long")
    n = spark.createDataFrame([(k,) for k in (1, 2, 3, 5, 7, 9)], "node long")
    assert rows(graph.connected_components(n, e)) == [(1, 1), (2, 1), (3, 1), (5, 5), (7, 7), (9, 7)]
    chain = spark.createDataFrame([(k, k - 1) for k in range(1, 40)] + [(100, 101), (101, 100)], "node long, parent long")
    got = dict(rows(graph.roots(chain).where("node < 100")))
    assert set(got.values()) == {0} and got[39] == 0
    assert all(r.root is None for r in graph.roots(chain).where("node >= 100").collect())


@pytest.mark.parametrize("method", ["seeded-mst", "seeded-watershed", "agglo"])
def test_cleave_line(spark, method):
    edges = spark.createDataFrame([(1, k, k + 1, 1.0 if k == 4 else 0.5) for k in range(9)], "body long, a long, b long, weight double")
    seeds = spark.createDataFrame([(1, 0, 1), (1, 9, 2)], "body long, node long, seed long")
    got = graph.cleave(edges, seeds, method).orderBy("node").collect()
    assert [r.label for r in got] == [1] * 5 + [2] * 5 and not any(r.disconnected or r.unlabeled for r in got)


def test_cleave_empty_and_unlabeled(spark):
    edges = spark.createDataFrame([(1, 0, 1, 0.5), (1, 5, 6, 0.5)], "body long, a long, b long, weight double")
    seeds = spark.createDataFrame([(1, 0, 1)], "body long, node long, seed long")
    got = {r.node: (r.label, r.unlabeled) for r in graph.cleave(edges, seeds).collect()}
    assert got == {0: (1, False), 1: (1, False), 5: (0, True), 6: (0, True)}
    assert graph.cleave(edges.limit(0), seeds.limit(0)).count() == 0


def test_spanning_tree_and_prune(spark):
    r = random.Random(3)
    e = [(a, b, round(r.random(), 3)) for a in range(12) for b in range(a + 1, 12)]
    tree = graph.spanning_tree(spark.createDataFrame(e, "a long, b long, weight double")).collect()
    parent = {n: n for n in range(12)}
    total = 0
    for w, a, b in sorted((w, a, b) for a, b, w in e):
        p, q = graph._find(parent, a), graph._find(parent, b)
        if p != q:
            parent[p] = q
            total += w
    assert len(tree) == 11 and abs(sum(t.weight for t in tree) - total) < 1e-9
    pts = [(k, r.random() * 10, r.random() * 10, 0.0) for k in range(60)]
    kept = graph.prune_close(spark.createDataFrame(pts, "id long, z double, y double, x double"), 2.0).collect()
    near = lambda p, q: ((p[1] - q[1]) ** 2 + (p[2] - q[2]) ** 2) ** 0.5 <= 2
    assert not any(near(p, q) for i, p in enumerate(kept) for q in kept[:i])
    assert all(any(near(p, q) for q in kept) for p in pts)


def test_log_messages(spark):
    lines = [
        '{"Action":"merge","Target":9,"Labels":[2,3],"UUID":"a","MutationID":1,"Timestamp":"2020-01-01 00:00:00.123456789 -0500"}',
        '{"Action":"cleave","OrigLabel":9,"CleavedLabel":12,"CleavedSupervoxels":[3],"UUID":"b","MutationID":2}',
        '{"Action":"split-supervoxel","Target":9,"Supervoxel":4,"SplitSupervoxel":40,"RemainSupervoxel":41,"UUID":"b","MutationID":3}',
    ]
    parsed = log.parse(spark.createDataFrame([(x,) for x in lines + lines[:1]], "value string"))
    assert parsed.count() == 3
    assert rows(log.affected_bodies(parsed)) == [(2, "removed"), (3, "removed"), (9, "changed"), (12, "new")]
    assert rows(log.affected_supervoxels(parsed)) == [(4, "deleted"), (40, "new"), (41, "new")]
    m = spark.createDataFrame([(1, 9), (2, 2), (3, 3)], "sv long, body long")
    assert rows(log.replay_mapping(m, parsed)) == [(1, 9), (2, 9), (3, 12)]
    versions = spark.createDataFrame([("b", "a")], "node string, parent string")
    leaf = spark.createDataFrame([("b",)], "node string")
    assert log.of_versions(parsed, versions, leaf, parents=False).count() == 2
    assert log.of_versions(parsed, versions, leaf).count() == 3


def test_annotation_encoding(spark):
    df = spark.createDataFrame([(0, 5, 1.0, 2.0, 3.0, 0.5), (0, 4, 0.0, 1.0, 1.5, 0.25), (3, 9, 9.0, 8.0, 7.0, 1.0)], "cell long, id long, x float, y float, z float, p float")
    back = annotations.decode_points(annotations.encode_points(df, ["cell"], {"p": "float32"}), ["cell"], ["p"])
    assert rows(back) == rows(df.select("cell", "id", "x", "y", "z", "p"))
    grids = annotations.spatial_grids([100, 50, 50], 3)
    placed = annotations.assign_levels(spark.range(100).select("id", *((F.col("id") % 50).cast("float").alias(a) for a in "zyx")), [0, 0, 0], grids, [10, 20, 70])
    assert rows(placed.groupBy("level").count()) == [(0, 10), (1, 20), (2, 70)]


def test_tags(spark):
    df = spark.createDataFrame([(1, "a b", "x", True), (2, "x", None, False), (3, None, "", None)], "segment long, t string, u string, f boolean")
    codes, names = annotations.tag_codes(df, ["t", "u", "f"])
    by = {r.code: r.tag for r in names.collect()}
    assert {r.segment: sorted(by[c] for c in r.codes) for r in codes.collect()} == {1: ["a_b", "f", "u:x"], 2: ["t:x"], 3: []}


def test_volume_operators(spark):
    from neurospan.operators import volume

    lab = {(0, y, x): 1 if 1 <= y <= 5 and 1 <= x <= 5 and not (y == 3 and x == 3) else 2 if x >= 8 else 0 for y in range(7) for x in range(10)}
    lab[(0, 6, 6)] = 1
    df = spark.createDataFrame([(*k, v) for k, v in lab.items()], "z int, y int, x int, label int")
    comp = volume.label_components(df).groupBy("label", "component").count().collect()
    assert sorted((r.label, r["count"]) for r in comp) == [(1, 1), (1, 24), (2, 14)]
    erased = volume.erase_islands(df)
    assert erased.where("label = 1").count() == 24 and erased.count() == 70
    split, pieces = volume.split_bodies(df)
    assert sorted(tuple(r) for r in pieces.collect()) == [(1, 1), (3, 1)] and split.where("label = 3").count() == 1
    mask = df.where("label = 1 AND y < 6").select("z", "y", "x")
    solid = spark.createDataFrame([(z, y, x) for z in range(3) for y in range(3) for x in range(3) if (z, y, x) != (1, 1, 1)], "z int, y int, x int")
    assert volume.fill_holes(solid, {a: (0, 3) for a in "zyx"}).count() == 27
    assert volume.mask_downsample(mask, 2).count() == 9 and volume.mask_downsample(solid, 3, "and").count() == 0
    assert volume.closest_approach(df.where("y < 6"), 1, 2).first().d == 3.0
    assert volume.ellipsoid(spark, (0, 0, 0), (1, 1, 1)).count() == 7
    t = volume.thickest_point(df.where("y < 6"), 5).where("label = 2").first()
    assert (t.x, t.distance) == (9, 2)


def test_store_tables(spark):
    from neurospan.sources import store

    kv = spark.createDataFrame([("a", [1, 2]), ("b", [3])], "key string, value array<int>")
    more = spark.createDataFrame([("a", [2, 5]), ("c", [7])], "key string, value array<int>")
    assert rows(store.extend_lists(kv, more)) == [("a", [1, 2, 5]), ("b", [3]), ("c", [7])]
    assert rows(store.upsert(kv, more)) == [("a", [2, 5]), ("b", [3]), ("c", [7])]
    vers = spark.createDataFrame([("leaf", 0), ("mid", 1), ("root", 2)], "node string, depth int")
    data = spark.createDataFrame([(1, "root", False), (1, "mid", True), (2, "root", False), (3, "other", False)], "k int, uuid string, deleted boolean")
    assert rows(store.current(data, vers, ["k"])) == [("root", 2)] or rows(store.current(data, vers, ["k"]).select("k")) == [(2,)]
    files = spark.createDataFrame([(1, "x.swc", bytearray(b"ab")), (1, "y.obj", bytearray(b"c"))], "body long, name string, data binary")
    assert [(r.name, bytes(r.data)) for r in store.untar_files(store.tar_files(files), suffix=".swc").collect()] == [("x.swc", b"ab")]
    mapping = spark.createDataFrame([(1, 9), (2, 9)], "sv long, body long")
    assert rows(store.supervoxels_of(mapping, spark.createDataFrame([(9,), (4,)], "body long"))) == [(4, 4), (9, 1), (9, 2)]
    assert rows(store.mapping_batches(mapping, 1)) == [(9, 0, [1]), (9, 1, [2])]


def test_whole_image_queries(spark, tmp_path):
    """Voxels beyond 40 lines and 60 columns stay apart, and components match a search voxel by voxel."""
    from neurospan import catalog

    r = random.Random(11)
    snake = [(y, x) for y in range(100, 113) for x in (range(300, 330) if y % 2 == 0 else [329 if y % 4 == 1 else 300])]
    items = [(k, y, x, 1) for k, (y, x) in enumerate(snake)] + [(1000 + k, r.randrange(1, 50), r.randrange(1, 90), r.randrange(1, 4)) for k in range(1500)]
    spark.createDataFrame([(k, x, y, n, 0.0) for k, y, x, n in items], "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_discount double").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(k, k % 30 + 1, "x") for k, *_ in items], "o_orderkey long, o_custkey long, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    image = {}
    for _, y, x, n in items:
        image[y, x] = min(n, image.get((y, x), n))
    near = lambda y, x: [p for p in ((y, x + 1), (y, x - 1), (y + 1, x), (y - 1, x)) if p in image]
    component = {}
    for start in sorted(image):
        if start not in component:
            component[start], todo = start, [start]
            while todo:
                at = todo.pop()
                for p in near(*at):
                    if image[p] == image[at] and p not in component:
                        component[p] = start
                        todo.append(p)
    whole = lambda name: rows(catalog.QUERIES[f"whole_{name}"](spark, str(tmp_path)))
    assert whole("label_components") == sorted((y, x, n, component[y, x][0] * 2097152 + component[y, x][1]) for (y, x), n in image.items())
    assert whole("edge_voxels") == sorted((y, x, n) for (y, x), n in image.items() if any(image[p] != n for p in near(y, x)))
    assert sum(a for *_, a in whole("adjacencies")) == sum(image[p] != n for at, n in image.items() for p in near(*at)) / 2
    assert len(whole("mode_downsample")) == len({(y // 4, x // 4) for y, x in image})
    assert sum(n for _, n, *_ in whole("principal_axes")) == len(image)
    pairs = {(k % 30 + 1, y) for k, y, *_ in items}
    assert {(a, b) for a, b, _ in whole("contingency")} == pairs
    best = whole("match_overlaps")
    assert {a for a, *_ in best} == {a for a, _ in pairs} and {b for _, b, *_ in best} == {b for _, b in pairs}
