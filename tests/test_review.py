"""Assessments of proposed merges, cycles, groups to review, streams into tables."""

import random

import pytest
from pyspark.sql import functions as F

from neurospan.operators import review
from neurospan.streaming import log as stream


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_cycles(spark):
    r = random.Random(1)
    for n in (1, 7, 40):
        up = {k: r.randrange(n) for k in range(n) if r.random() < 0.9}
        on = set()
        for k in up:
            way = [k]
            while way[-1] in up and up[way[-1]] not in way:
                way.append(up[way[-1]])
            if way[-1] in up:
                on |= set(way[way.index(up[way[-1]]) :])
        df = spark.createDataFrame(list(up.items()), "node long, parent long")
        assert {q.node for q in review.cycle_nodes(df).collect()} == on
        kept = {q.node: q.parent for q in review.without_cycles(df).collect()}
        assert review.cycle_nodes(spark.createDataFrame(list(kept.items()), "node long, parent long")).count() == 0
        least = {k for k in on if k == min(_cycle(up, k))}
        assert kept == {k: p for k, p in up.items() if k not in least and k != p}


def _cycle(up, k):
    way = [k]
    while up[way[-1]] != k:
        way.append(up[way[-1]])
    return way


def test_assessments_by_hand(spark):
    merges = [(1, 2), (1, 3), (3, 4), (10, 11), (20, 21), (20, 22), (30, 31), (40, 41), (41, 42), (41, 43), (50, 51), (60, 61), (61, 60)]
    gone = {3: 1, 10: 12, 21: 99, 30: None, 41: 98, 50: 51}
    bodies = [(b, 0 if b in gone else 5) for b in {x for m in merges for x in m}]
    log = [(t, b) for b, t in gone.items() if t]
    got = {q.body: (q.owner, q.assessment, q.mergeset) for q in review.assess_merges(spark.createDataFrame(merges + [(None, 5)], "target long, fragment long"), spark.createDataFrame(bodies, "body long, size long"), spark.createDataFrame(log, "target long, absorbed long")).collect()}
    assert got == {
        1: (1, "target", 1), 2: (2, "mergeable", 1), 3: (1, "already_merged", -1), 4: (4, "mergeable", 1), 10: (12, "old_target", 12), 11: (11, "mergeable", 12),
        20: (20, "target", 20), 21: (99, "merged_elsewhere", -1), 22: (22, "mergeable", 20), 30: (0, "unknown", -1), 31: (31, "unassessed", -1),
        40: (40, "target", -1), 41: (98, "merged_elsewhere", 41), 42: (42, "my_target_merged_elsewhere", 41), 43: (43, "my_target_merged_elsewhere", 41),
        50: (51, "old_target", -1), 51: (51, "already_absorbed_target", -1), 60: (60, "target", 60), 61: (61, "mergeable", 60),
    }
    with pytest.raises(ValueError):
        review.assess_merges(spark.createDataFrame([(1, 3), (2, 3)], "target long, fragment long"), spark.createDataFrame(bodies, "body long, size long"), spark.createDataFrame(log, "target long, absorbed long"))


def test_groups_to_review(spark):
    df = spark.createDataFrame([(1, 7, "T"), (2, 7, None), (3, 8, "T"), (4, 8, "T"), (5, 0, None), (6, None, None), (7, 9, "x"), (1, 7, "T")], "body long, `group` long, status string")
    assert [(q.group, q.bodies, q.n) for q in review.review_groups(df, ["T"]).orderBy("group").collect()] == [(7, [1, 2], 2), (9, [7], 1)]
    assert review.review_groups(df, ["T"], untraced_only=False).count() == 3 and review.review_groups(df, ["T"], [1]).count() == 1


def test_streams_into_tables(spark, tmp_path):
    df = spark.createDataFrame([(i, i % 3, f"v{i}") for i in range(20)], "id int, k int, v string")
    df.repartition(4).write.parquet(str(tmp_path / "e"))
    s = stream.table_stream(spark, str(tmp_path / "e"))
    assert rows(stream.into_table(s, "append")) == rows(df)
    counts = s.groupBy("k").agg(F.count("*").alias("n"), F.max("id").alias("last"))
    want = [(0, 7, 18), (1, 7, 19), (2, 6, 17)]
    assert rows(stream.into_table(counts, "complete")) == want and rows(stream.into_table(counts, "update", ["k"])) == want
    assert stream.into_table(s.where("id < 0"), "append").columns == ["id", "k", "v"]
