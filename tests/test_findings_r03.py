"""Queries on small tables of the kinds on which they went wrong, against DuckDB."""

import datetime
import time

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq

import __spark_entry__ as entry
from neurospan.llm import phrases
from neurospan.operators import autoproof, contacts, graph, organelles, shapes
from neurospan.sources import blocks, formats, store


def compared(spark, folder, name: str, **tables) -> None:
    """The query's rows on these tables are its SQL's."""
    con = duckdb.connect()
    for t, rows in tables.items():
        pq.write_table(pa.Table.from_pylist(rows), f"{folder}/{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    got = entry.queries()[name](spark, str(folder))
    order = ", ".join(f'"{c}"' for c in got.columns)
    want = con.execute(f"SELECT {order} FROM ({entry.oracle_sql()[name]})").fetchall()
    assert want
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))


def test_interval_points_round_halves_to_even(spark, tmp_path):
    compared(spark, tmp_path, "points_in_intervals", orders=[{"o_orderkey": k, "o_totalprice": v} for k, v in enumerate([25000.5, 25001.5, 9999.5, 15000.5])], nation=[{"n_nationkey": k} for k in range(4)])


def test_first_event_of_a_body_in_several_batches(spark, tmp_path):
    start = datetime.datetime(2024, 1, 1)
    kinds = ["signup", "click", "view", "view", "click", "error", "view"]
    rows = [{"event_id": k, "ts": start, "user_id": 7, "event_type": e, "value": 1.0, "props": "{}"} for k, e in enumerate(kinds)][::-1]
    key, before = "spark.sql.execution.arrow.maxRecordsPerBatch", spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set(key, 2)
    try:
        compared(spark, tmp_path, "stream_body_states", events=rows)
    finally:
        spark.conf.set(key, before)


WIDE = [{"l_orderkey": k, "l_linenumber": k % 7 + 1, "l_suppkey": s, "l_partkey": p} for k, (s, p) in enumerate([(0, 0), (5, 1048575), (6, 1048576), (2097151, 2097153), (3000000, 7200000)])]


def test_packed_points_beyond_21_bits(spark, tmp_path):
    compared(spark, tmp_path, "pack_roundtrip", lineitem=WIDE)


def test_block_ids_beyond_21_bits(spark, tmp_path):
    compared(spark, tmp_path, "block_ids", lineitem=WIDE)


def test_block_order_ids_beyond_21_bits(spark, tmp_path):
    compared(spark, tmp_path, "block_order_ids", lineitem=WIDE)


def test_block_points_beyond_21_bits(spark, tmp_path):
    compared(spark, tmp_path, "block_point_roundtrip", lineitem=WIDE)


def test_cleaves_of_suppliers_with_more_than_a_million_parts(spark, tmp_path):
    items = [{"l_suppkey": s, "l_partkey": p} for s, p in [(1, 1000013), (1, 1), (2, 13), (2, 14), (2, 1000020), (3, 20), (3, 21)]]
    compared(spark, tmp_path, "hierarchical_cleaves", lineitem=items)


def test_ids_of_items_that_are_keys_of_orders(spark, tmp_path):
    orders = [{"o_orderkey": k, "o_custkey": k, "o_orderpriority": "1-URGENT"} for k in (4998, 4999, 5003)]
    compared(spark, tmp_path, "sharded_index", orders=orders, lineitem=[{"l_orderkey": k} for k in (985003, 1985006, 7, 7)])


def test_bars_beyond_21_bits(spark, tmp_path):
    orders = [{"o_orderkey": k, "o_custkey": 3} for k in (1, 2097153, 262145)]
    compared(spark, tmp_path, "bars_with_partners", orders=orders, lineitem=[{"l_orderkey": k, "l_linenumber": 1, "l_suppkey": 5, "l_discount": 0.1} for k in (1, 2097153, 262145)])


def test_fragments_of_several_splits(spark, tmp_path):
    keys = [(1, "F", "1-URGENT"), (250000, "F", "1-URGENT"), (4500000, "F", "5-LOW"), (8000000, "O", "5-LOW")]
    compared(spark, tmp_path, "split_mapping", orders=[{"o_orderkey": k, "o_orderstatus": s, "o_orderpriority": p} for k, s, p in keys])


def test_tasks_of_runs_rise_with_the_voxels(spark, monkeypatch):
    from neurospan.operators import geometry

    monkeypatch.setattr(geometry, "ROWS", 50)
    voxels = spark.range(1000).selectExpr("0 AS z", "cast(id div 10 AS int) AS y", "cast(id % 10 * 2 AS int) AS x")
    runs = geometry.encode_runs(voxels.union(voxels))
    assert runs.count() == 1000
    assert runs.rdd.getNumPartitions() == 40
    merged = geometry.merge_runs(runs.withColumn("x1", runs.x1 + 1))
    assert merged.rdd.getNumPartitions() == 20
    assert merged.where("x0 = 0 AND x1 = 19").count() == merged.count() == 100


def test_masks_of_blocks_that_go_on_in_the_next_batch(spark):
    from neurospan.operators import geometry, slabs

    voxels = spark.range(400).selectExpr("id % 7 AS z", "id div 7 % 9 AS y", "id * 5 % 41 - 8 AS x").distinct()
    key, before = "spark.sql.execution.arrow.maxRecordsPerBatch", spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set(key, 3)
    try:
        masks = slabs.block_masks(geometry.encode_runs(voxels), 4, 1)
        assert masks.groupBy("bz", "by", "bx").count().where("count > 1").count() == 0
        back = slabs.masks_to_voxels(masks, 4, 1)
        assert sorted(map(tuple, back.collect())) == sorted(map(tuple, voxels.collect()))
    finally:
        spark.conf.set(key, before)


def test_paths_through_one_node_are_dealt_over_tasks(spark, monkeypatch):
    from neurospan.operators import geometry, graph

    monkeypatch.setattr(geometry, "ROWS", 100)
    ends = spark.range(1, 41).toDF("node")
    edges = ends.selectExpr("node AS a", "0L AS b")
    got = graph.paths(edges, ends, 2)
    assert sorted(tuple(r["path"]) for r in got.collect()) == [(a, 0, b) for a in range(1, 41) for b in range(a + 1, 41)]
    met = graph._spread_join(edges.withColumnRenamed("b", "u"), edges.selectExpr("b AS u", "a AS v"), "u")
    sizes = [n for n in met.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect() if n]
    assert sum(sizes) == 1600 and max(sizes) < 1600


def test_sparse_label_blocks_take_little_time():
    rng = np.random.default_rng(2)
    labels = np.zeros(64**3, np.uint64)
    labels[rng.choice(64**3, 120, replace=False)] = rng.integers(1, 9, 120)
    block, start = labels.reshape((64,) * 3), time.process_time()
    for _ in range(100):
        data = blocks.encode_block(block)
    assert time.process_time() - start < 2  # 5 where each sub-block is sorted
    assert (blocks.decode_block(data) == block).all()


def test_label_blocks_that_span_batches(spark):
    key, before = "spark.sql.execution.arrow.maxRecordsPerBatch", spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = {(0, y, x): 1 + (y + x) % 3 for y in range(20) for x in range(-5, 5)} | {(70, 0, 0): 7}
    spark.conf.set(key, 3)
    try:
        df = spark.createDataFrame([(*p, v) for p, v in want.items()] + [(200, 0, 0, 0)], "z int, y int, x int, label long")
        made = blocks.encode_blocks(df)
        assert {(r.z, r.y, r.x): r.label for r in blocks.decode_blocks(made).collect()} == want
        assert sorted((r.bz, r.by, r.bx) for r in made.collect()) == [(0, 0, -1), (0, 0, 0), (1, 0, 0), (3, 0, 0)]
    finally:
        spark.conf.set(key, before)


def test_blocks_of_payloads_are_made_once(spark):
    made = spark.sparkContext.accumulator(0)

    def run(batches):
        for b in batches:
            made.add(len(b))
            yield b

    df = spark.createDataFrame([(0, 0, k, b"x") for k in range(9)], "bz long, by long, bx long, block binary").mapInPandas(run, "bz long, by long, bx long, block binary")
    assert sum(r.blocks for r in blocks.block_payloads(df, 4).collect()) == 9
    assert made.value == 9


def network(spark):
    conn = [(1, 101, 3, "r"), (1, 103, 1, "r"), (2, 101, 4, "r"), (2, 103, 2, "r"), (3, 101, 5, "r"), (4, 103, 7, "r"), (4, 105, 2, "r"), (2, 105, 9, "q")]
    types = [(1, None), (2, "a"), (3, "a"), (4, "a"), (101, "x"), (103, "y"), (105, "x")]
    n = spark.createDataFrame(types, "body long, type string")
    c = spark.createDataFrame(conn, "body_pre long, body_post long, weight long, roi string")
    return c, n, autoproof.orphan_strengths(c, n, spark.createDataFrame([(1, "r")], "orphan long, roi string"))


def planned(spark, df) -> list[str]:
    spark.conf.set("spark.sql.adaptive.enabled", False)
    try:
        return df.select("*")._jdf.queryExecution().executedPlan().toString().splitlines()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", True)


def test_strengths_of_an_untyped_orphan_are_not_shuffled(spark):
    of = autoproof.target_strengths(*network(spark))
    assert {tuple(r) for r in of.collect()} == {(1, "r", b, "a", "post", t, s) for b, t, s in [(2, "x", 4), (2, "y", 2), (3, "x", 5), (4, "x", 2), (4, "y", 7)]}
    lines = planned(spark, of)
    product = next(k for k, line in enumerate(lines) if "Join [roi" in line)
    assert not any("Exchange" in line for line in lines[:product])


def test_improvements_have_rows_of_strengths_alone(spark):
    c, n, mine = network(spark)
    got = autoproof.improvements(mine, autoproof.target_strengths(c, n, mine), 2)
    cos = lambda a, b: sum(x * y for x, y in zip(a, b)) / (sum(x * x for x in a) * sum(y * y for y in b)) ** 0.5
    own, means = {2: (4, 2), 3: (5, 0), 4: (2, 7)}, {2: (3.5, 3.5), 3: (3, 4.5), 4: (4.5, 0)}
    want = {b: cos((s[0] + 3, s[1] + 1 if s[1] else 0), means[b]) - cos(s, means[b]) for b, s in own.items()}
    rows = got.collect()
    assert {r.target: round(r.score, 12) for r in rows} == {b: round(v, 12) for b, v in want.items()}
    assert {(r.similar_body_connections, r.similar_type_connections) for r in rows} == {(1, 2)}
    assert not any("Join" in line and "target" in line for line in planned(spark, got))  # base filled every target's missing strengths


def test_tasks_of_contact_points_are_not_broadcast(spark, monkeypatch):
    plans, settle = [], contacts.settle
    monkeypatch.setattr(contacts, "settle", lambda df: (plans.append(df._jdf.queryExecution().executedPlan().toString()), settle(df))[1])
    vox = spark.createDataFrame([(0, 5, 5, 1), (0, 5, 6, 4)], "z int, y int, x int, label int")
    tasks = spark.createDataFrame([(1, 1, 4, 0, 4, 4, 0, 4, 4), (2, 1, 5, 0, 4, 4, 0, 4, 4)], "task long, label_1 int, label_2 int, z1 int, y1 int, x1 int, z2 int, y2 int, x2 int")
    got = {r.task: (r.status, r.y1, r.x1, r.y2, r.x2) for r in contacts.contact_points(tasks, vox, 0, 8).collect()}
    assert got == {1: ("adjusted-at-scale-0", 5, 5, 5, 6), 2: ("misplaced", 4, 4, 4, 4)}
    assert any("SortMergeJoin" in p for p in plans) and not any("BroadcastHashJoin" in p for p in plans)


def test_hulls_that_overlap_are_not_made_of_voxels(spark, monkeypatch):
    made, decode = [], shapes.decode_runs
    monkeypatch.setattr(shapes, "decode_runs", lambda runs: (made.append(decode(runs)), made[-1])[1])
    corners = [(0, 0, 0), (0, 9, 0), (0, 0, 9), (0, 9, 9)]
    rows = [(z, y, x + 2 * k, 1 + k) for k in range(4) for z, y, x in corners] + [(0, 5, 40, 9), (0, 4, 0, 1), (0, 4, 1, -7), (0, 3, 14, 3)]
    image = spark.createDataFrame(rows, "z int, y int, x int, label long")
    got = {(r.z, r.y, r.x): r.label for r in shapes.hull_labels(image).collect()}
    want = {(0, y, x): 1 if x < 2 else 4 if x > 13 else 0 for y in range(10) for x in range(16)} | {(0, 5, 40): 9, (0, 4, 1): 0, (0, 3, 14): 0}
    assert got == want
    assert made[0].count() < 170  # all hulls have 400 voxels and more


def test_sketch_grows_with_texts_and_leaves_a_bit_a_counter(spark, monkeypatch):
    assert all(phrases.cells_for(n << 30) >= (n << 30) // 16 for n in (1, 6, 10))  # 1 << 25 bounded nothing beyond some 500 MB
    monkeypatch.setattr(phrases, "SHARD", 2000)  # counts come from many shards
    words = np.random.default_rng(3).integers(0, 60, (90, 40))
    df = spark.createDataFrame([("x", " ".join(f"w{v * v}" for v in row)) for row in words.tolist()], "lang string, text string").repartition(3)
    sketch = phrases.sketch_of(df, 22, 30)
    assert sketch.nbytes == 1 << 19
    texts = [" ".join(f"w{v * v}" for v in row).encode() for row in words.tolist()]
    n = np.zeros(1 << 22, np.int64)
    for _, h in ((None, h[within]) for t in texts for within, h in phrases.Shard("x", [t]).grams()):
        np.add.at(n, (h >> np.uint64(42)).astype(np.int64), 1)
    assert 0 < (n >= 30).sum() and (np.unpackbits(sketch) == (n >= 30)).all()


def test_points_are_drawn_from_those_that_come_first(spark, monkeypatch):
    looked, prune = [], organelles.prune_close
    monkeypatch.setattr(organelles, "prune_close", lambda df, *a: (looked.append(df.count()), prune(df, *a))[1])
    df = spark.createDataFrame([(i, i % 7, i % 40, i // 40) for i in range(2000)], "id long, z int, y int, x int")
    got = organelles.sampled_points(df, 30, minimum_distance=2.0, seed=3)
    assert max(looked) < 1000  # of 2000 before
    want = organelles.sampled_points(df, None, minimum_distance=2.0, seed=3).selectExpr("id", "xxhash64(id, 3) AS h").orderBy("h", "id").limit(30)
    assert [r.id for r in got.collect()] == [r.id for r in want.collect()]
    assert organelles.sampled_points(df, 900, minimum_distance=3.0, seed=3).count() == organelles.sampled_points(df, None, minimum_distance=3.0, seed=3).count()


def test_only_near_places_are_spread_over_their_points(spark, monkeypatch):
    spread, join = [], graph._spread_join
    monkeypatch.setattr(graph, "_spread_join", lambda a, b, key: (spread.append(a.count()), join(a, b, key))[1])
    points = [(i, i % 2, 0, 2 * (i % 3)) for i in range(60)]
    got = sorted(map(tuple, graph.close_pairs(spark.createDataFrame(points, "id long, z int, y int, x int"), 2.0).collect()))
    far = lambda p, q: ((p[1] - q[1]) ** 2 + (p[3] - q[3]) ** 2) ** 0.5
    assert got == [(p[0], q[0], far(p, q)) for p in points for q in points if p[0] < q[0] and far(p, q) <= 2]
    assert spread == [130]  # 6 places of 10 points, each with itself, and 3 + 4 pairs of near ones


def test_skeletons_are_not_grouped_one_by_one(spark):
    rows = [(k, n, 1.0 * n, 2.0, None, n - 1 if n else -1) for k in (None, 5, 1 << 60) for n in range(30)]
    df = spark.createDataFrame(rows, "body long, node long, x double, y double, z double, parent long").repartition(3)
    made = formats.encode_skeletons(df)
    assert "FlatMapGroups" not in made._jdf.queryExecution().toString()
    key, before = "spark.sql.execution.arrow.maxRecordsPerBatch", spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set(key, 7)  # skeletons go on from batch to batch
    try:
        back = formats.decode_skeletons(made).collect()
    finally:
        spark.conf.set(key, before)
    assert sorted((r.body or 0, r.node, r.x, r.y, r.parent) for r in back) == sorted((k or 0, n, 8 * x, 8 * y, p) for k, n, x, y, _, p in rows)


def test_cells_of_a_key_are_not_one_group(spark):
    df = spark.createDataFrame([(s, z, y, 0, 40) for s in ("a", "b", None) for z in (0, 9) for y in (1, 17)], "sv string, z long, y long, x0 long, x1 long")
    plan = contacts.grid_split_plan(df, 16, 4)
    assert all("_pz" in spec for spec in plan._jdf.queryExecution().executedPlan().toString().split("windowspecdefinition(")[1:])
    top = {(r.sv, r.bz, r.by, r.bx): (r.voxels, r.parent_voxels, r.remains) for r in plan.where("grid = 16").collect()}
    assert top == {(s, 0, y, x): (2 * n, 164, (y, x) == (1, 2)) for s in ("a", "b", None) for y in (0, 1) for x, n in enumerate((16, 16, 9))}


def test_many_files_of_a_key_make_several_tars(spark, monkeypatch):
    monkeypatch.setattr(store, "TAR", 10_000)
    rows = [(k, f"{i}.swc", bytes([i])) for k, n in ((1, 90), (2, 3), (None, 2)) for i in range(n)]
    tars = store.tar_files(spark.createDataFrame(rows, "body long, name string, data binary")).collect()
    n = {k: [len(t.data) for t in tars if t.body == k] for k in (1, 2, None)}
    assert len(n[1]) > 5 and max(n[1]) < 40_000 and len(n[2]) == len(n[None]) == 1
    back = store.untar_files(spark.createDataFrame(tars).where("body IS NOT NULL"), suffix=".swc").collect()
    assert sorted((r.body, r.name, bytes(r.data)) for r in back) == sorted(r for r in rows if r[0])


def test_ancestors_of_nothing_take_no_rounds_and_those_of_forests_no_grouping(spark, monkeypatch):
    plans, settle = [], graph.settle
    monkeypatch.setattr(graph, "settle", lambda df: (plans.append(df._jdf.queryExecution().toString()), settle(df))[1])
    made = lambda e: spark.createDataFrame(e, "node long, parent long")
    forest = [(i, i // 2) for i in range(2, 40)]
    for edges in (forest, [*forest, (9, 3), (30, 2)], [*forest, (1, 37)], [(5, 5), (4, 5)]):
        want = {(s, s): 0 for s in (37, 9, 4)}
        while more := {(s, p): d + 1 for (s, n), d in want.items() for c, p in edges if c == n and (s, p) not in want}:
            want |= more
        plans.clear()
        got = graph.ancestors(made(edges), made([(s, 0) for s in (37, 9, 4)]).select("node"))
        assert sorted(map(tuple, got.collect())) == sorted((*k, d) for k, d in want.items())
        assert edges != forest or not any("min(depth" in p for p in plans)
    plans.clear()
    assert graph.ancestors(made(forest), made([]).select("node")).count() == 0 and len(plans) == 1


def test_places_between_slices_are_made_in_strips_and_not_written(spark, monkeypatch):
    written, settle = [], shapes.settle
    monkeypatch.setattr(shapes, "settle", lambda df: (written.append(settle(df)), written[-1])[1])
    r, n, m = np.random.default_rng(7), 23, 31
    planes = {z: r.random((n, m)) < p for z, p in ((2, 0.03), (3, 0.5), (6, 0.97), (7, 1), (9, 0.2))}
    planes[9][4:15, 3:24], planes[9][0], planes[2][5:], planes[3][:, 20:] = True, True, False, False  # cores, full and empty rows and columns
    cells = [(z, y + 100, x - 7) for z, own in planes.items() for y, x in zip(*(v.tolist() for v in np.nonzero(own)))]
    mask, box = spark.createDataFrame(cells, "z int, y int, x int").repartition(3), ((100, -7), (100 + n, m - 7))
    at = np.stack(np.meshgrid(np.arange(n), np.arange(m), indexing="ij"), -1).reshape(-1, 2)
    square = ((at[:, None] - at[None]) ** 2).sum(-1)

    def signed(own):
        far = np.where(own.ravel()[:, None] != own.ravel()[None], square, 1 << 40).min(1)
        return [None if d == 1 << 40 else -(d**0.5) if i else d**0.5 for d, i in zip(far.tolist(), own.ravel().tolist())]

    known = {z: signed(own) for z, own in planes.items()}
    want = {}
    for z, z1 in zip(known, [*list(known)[1:], 10]):
        for k in range(z, z1):
            for (y, x), a, b in zip(at.tolist(), known[z], known.get(z1, known[z])):
                want[k, y + 100, x - 7] = a if k == z else None if a is None or b is None else a + (b - a) * (k - z) / (z1 - z)
    for places in (shapes.PLACES, 3 * n, 1):  # strips of a quarter, of three columns and of one
        monkeypatch.setattr(shapes, "PLACES", places)
        got = shapes.interpolated_slices(mask, box)
        assert {(q.z, q.y, q.x): q.distance for q in got.collect()} == want
        plan = planned(spark, got)
        assert not any("Join" in line for line in plan)
    assert all(df.count() == len(cells) for df in written)  # all places of all planes were written, and shuffled thrice


def test_merges_of_customers_with_rows_that_share_a_key(spark, tmp_path):
    r = np.random.default_rng(3)
    keys = [*range(260), *range(1, 8), *r.integers(0, 260, 25).tolist()]
    compared(spark, tmp_path, "assessed_merges", customer=[{"c_custkey": k, "c_acctbal": float(v)} for k, v in zip(keys, r.choice([100.0, 499.5, 500.0, 9000.0], len(keys)))])
