import json

from neurospan.operators import synapses
from neurospan.sources import sinks, tables
from neurospan.streaming import log as stream


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_csv_with_and_without_header(spark, tmp_path):
    (tmp_path / "a.csv").write_text("body,size\n1,2\n3,4\n")
    (tmp_path / "b.csv").write_text("1,2\n3,4\n")
    assert tables.csv_header(spark, str(tmp_path / "a.csv")) == ["body", "size"]
    assert tables.csv_header(spark, str(tmp_path / "b.csv")) is None
    for name in ("a.csv", "b.csv"):
        assert rows(tables.read_csv(spark, str(tmp_path / name), "body long, size long")) == [(1, 2), (3, 4)]
        assert rows(tables.read_ids(spark, str(tmp_path / name))) == [(1,), (3,)]


def test_files_and_folders(spark, tmp_path):
    for p in ("x/a.json", "x/y/b.json", "x/y/c.txt"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_text("[{\"k\": 1}, {\"k\": 2}]")
    found = tables.list_files(spark, str(tmp_path), "*.json")
    assert found.count() == 2
    assert rows(tables.count_files(found, f"file:{tmp_path}")) == [("", 2), ("x", 2), ("x/y", 1)]
    assert rows(tables.read_json_array(spark, str(tmp_path / "x" / "a.json"), "k int")) == [(1,), (2,)]


def test_swc(spark, tmp_path):
    (tmp_path / "7.swc").write_text("# comment\n1 0 1.0 2.0 3.0 0.5 -1\n2 0 1.5 2 3 .5 1\n")
    got = tables.read_swc(spark, str(tmp_path / "7.swc")).drop("path")
    assert rows(got) == [(1, 0, 1.0, 2.0, 3.0, 0.5, -1), (2, 0, 1.5, 2.0, 3.0, 0.5, 1)]


def test_index_nesting(spark):
    flat = spark.createDataFrame([(1, 64, 0, -64, 5, 10), (1, 64, 0, -64, 6, 11), (1, 0, 0, 0, 5, 1), (2, 0, 0, 0, 7, 3)], "label long, z int, y int, x int, sv long, count int")
    assert rows(tables.flatten_index(tables.nest_index(flat))) == rows(flat)


def test_keyvalues_and_gzip(spark):
    df = spark.createDataFrame([(1, "a", 2)], "body long, t string, n int")
    kv = tables.keyvalues(df, "body", ["t", "n"])
    assert rows(tables.from_keyvalues(kv, "body", "t string, n int")) == [(1, "a", 2)]
    z = tables.gzipped("z", "u", tables.gzipped("value", "z", kv), inverse=True).first()
    assert bytes(z.u).decode() == z.value and bytes(z.z)[:2] == b"\x1f\x8b"


def test_pre_post_export(spark):
    w = spark.createDataFrame([(1, "PreSynTo", 2, 5), (2, "PostSynTo", 1, 5), (3, "PostSynTo", 1, 4)], "body long, rel string, to_body long, weight long")
    assert rows(sinks.export_pre_post(w)) == [(1, 2, 5), (1, 3, 4)]
    into, out = sinks.export_inputs_outputs(w)
    assert into.count() == 2 and out.count() == 1
    assert json.loads(sinks.json_array(w, ["body", "weight"], ["body", "weight"]).first().value)[0] == {"body": 1, "weight": 5}


def test_element_documents(spark):
    full = spark.createDataFrame([(1, 2, 0, 0, 1, 0, 0, 70), (1, 3, 0, 0, 1, 0, 0, 2)], "pre_id long, post_id long, z_pre int, y_pre int, x_pre int, z_post int, y_post int, x_post int")
    got = {r.block: json.loads(r.doc) for r in sinks.element_documents(full).collect()}
    assert sorted(got) == ["0,0,0", "1,0,0"] and len(got["0,0,0"]) == 2
    e = synapses.parse_elements(sinks.element_documents(full).withColumnRenamed("doc", "value"))
    assert synapses.elements_to_relations(e).count() == 4


def test_stream_counts_equal_batch(spark, tmp_path):
    df = spark.createDataFrame([(1, "2024-01-01 00:10:00", "a"), (2, "2024-01-01 00:50:00", "a"), (3, "2024-01-01 02:00:00", "b")], "id int, t string, k string").selectExpr("id", "to_timestamp(t) AS ts", "k")
    df.write.parquet(str(tmp_path / "e"))
    s = stream.table_stream(spark, str(tmp_path / "e"))
    got = stream.into_memory(stream.tumbling(s, "ts", "1 hour", ["k"], "1 hour"), "counts_test", "complete")
    assert sorted((r.k, r.n) for r in got.collect()) == [("a", 2), ("b", 1)]
    q = stream.upserts(s.select("k", "id"), str(tmp_path / "u"), ["k"], "id", str(tmp_path / "c"))
    q.awaitTermination()
    assert rows(spark.read.parquet(str(tmp_path / "u" / "g=0")).select("k", "id")) == [("a", 2), ("b", 3)]


def test_upserts_rewrite_only_touched_buckets(spark, tmp_path):
    """Three batches: rows by key and order as a dictionary has them, old generations gone, a batch run again the same."""
    src, out, at = tmp_path / "s", str(tmp_path / "u"), str(tmp_path / "c")
    want, names = {}, "k string, id long, v string"
    for n, new in enumerate(([("a", 1, "x"), ("b", 1, "x"), (None, 4, "x")], [("a", 0, "late"), ("c", 1, "y")], [("a", 5, "z"), ("c", 3, "z"), ("c", 2, "y")])):
        spark.createDataFrame(new, names).coalesce(1).write.mode("append").parquet(str(src))
        for k, i, v in new:
            want[k] = max(want.get(k, (-1, "")), (i, v))
        s = spark.readStream.schema(names).parquet(str(src))
        stream.upserts(s, out, ["k"], "id", at, buckets=8).awaitTermination()
        got = stream.upserted(spark, out, s.schema)
        assert {r.k: (r.id, r.v) for r in got.collect()} == want and got.count() == len(want)
        assert stream._held(spark, out)[0] == n
    last = stream._held(spark, out)[1]
    assert set(last.values()) == {0, 2}  # b's and the null's buckets weren't written again
    kept = {(int(g.name[2:]), int(b.name[7:])) for g in (tmp_path / "u").glob("g=*") for b in g.glob("bucket=*")}
    before = set((g, b) for b, g in stream._held(spark, out, 2)[1].items())
    assert kept == before | {(g, b) for b, g in last.items()}
    assert stream.upserted(spark, str(tmp_path / "none"), s.schema).count() == 0
