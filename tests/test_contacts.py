"""Contacts, balls, grown labels and cuts along grids against numpy."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from neurospan.operators import contacts, geometry, mergetable

VOXEL = "z long, y long, x long, label long"


def image(spark, a, low=(0, 0, 0)):
    return spark.createDataFrame([(*(int(v + k) for v, k in zip(p, low)), int(a[tuple(p)])) for p in np.argwhere(a >= 0)], VOXEL)


def array_of(df, shape):
    a = np.zeros(shape, int)
    for q in df.collect():
        a[q.z, q.y, q.x] = q.label
    return a


def brute_contact(a, one, two, middle, radius):
    """(first, second) by looking at every voxel of a cube; outside the image there is none."""
    low = [m - radius for m in middle]
    get = lambda p: a[tuple(p)] if all(0 <= v < n for v, n in zip(p, a.shape)) else 0
    inside = lambda p: all(lo <= v < lo + 2 * radius for v, lo in zip(p, low))
    faces = [(-1, 0, 0), (0, -1, 0), (0, 0, -1), (0, 0, 1), (0, 1, 0), (1, 0, 0)]
    meet = {}
    for p in map(tuple, np.argwhere(a == two)):
        near = [q for q in (tuple(v + d for v, d in zip(p, f)) for f in faces) if inside(q) and get(q) == one]
        if inside(p) and near:
            meet[tuple(v - lo for v, lo in zip(p, low))] = min(near)
    left, at, side = sorted(meet), (0, 0, 0), 2 * radius
    while left and side > 1:
        side //= 2
        parts = {}
        for p in left:
            parts.setdefault(tuple((v - o) // side for v, o in zip(p, at)), []).append(p)
        best = max(sorted(parts), key=lambda k: len(parts[k]))
        left, at = parts[best], tuple(o + side * k for o, k in zip(at, best))
    return (meet[left[0]], tuple(v + lo for v, lo in zip(left[0], low))) if left else None


@pytest.mark.parametrize("seed", [1, 2])
def test_contact_points(spark, seed):
    r = np.random.default_rng(seed)
    a = r.integers(0, 5, (6, 9, 11))
    a[0, 0, 0], a[5, 8, 10] = 8, 9
    tasks = [(k, *(int(v) for v in r.integers(1, 5, 2)), *(int(v) for _ in (1, 2) for v in r.integers(0, a.shape))) for k in range(12)]
    tasks += [(12, 8, 9, 0, 0, 0, 5, 8, 10), (13, 8, 77, 1, 1, 1, 1, 1, 1)]  # they never meet
    df = spark.createDataFrame(tasks, "task long, label_1 long, label_2 long, z1 long, y1 long, x1 long, z2 long, y2 long, x2 long")
    got = {q.task: q for q in contacts.contact_points(df, image(spark, a), 0, 4).collect()}
    assert len(got) == len(tasks)
    for task, one, two, *p in tasks:
        want = brute_contact(a, one, two, [(u + v) // 2 for u, v in zip(p[:3], p[3:])], 4) if one != two else None
        q = got[task]
        if one == two:
            continue
        if want is None:
            assert q.status == "misplaced" and [q.z1, q.y1, q.x1, q.z2, q.y2, q.x2] == p
        else:
            assert q.status == "adjusted-at-scale-0" and ((q.z1, q.y1, q.x1), (q.z2, q.y2, q.x2)) == want
    assert got[12].status == got[13].status == "misplaced"


def test_contact_points_of_a_coarser_scale(spark):
    """Labels a voxel apart meet once the image is halved."""
    a = np.zeros((2, 2, 12), int)
    a[:, :, 2:5], a[:, :, 6:9] = 3, 4
    df = spark.createDataFrame([(1, 3, 4, 0, 0, 3, 0, 0, 7)], "task long, label_1 long, label_2 long, z1 long, y1 long, x1 long, z2 long, y2 long, x2 long")
    q = contacts.contact_points(df, image(spark, a), 1, 4).first()
    assert (q.status, q.z1, q.y1, q.x1, q.z2, q.y2, q.x2) == ("adjusted-at-scale-1", 0, 0, 4, 0, 0, 6)
    assert contacts.contact_points(df.limit(0), image(spark, a), 1, 4).count() == 0
    assert contacts.contact_points(df, image(spark, a).limit(0), 1, 4).first().status == "misplaced"
    with pytest.raises(ValueError):
        contacts.contact_points(df, image(spark, a), 1, 6)


def test_balls(spark):
    points = [(5, 1, 3, 3, 3, 2), (7, 2, 4, 5, 0, 3), (6, 3, 0, 0, 0, 0), (9, 2, 4, 5, 1, 1), (4, 9, 5, 5, 5, None), (4, 9, 5, 5, 5, -1)]
    df = spark.createDataFrame(points, "label long, at long, z long, y long, x long, radius long")
    want = np.zeros((6, 7, 8), int)
    for label, _, z, y, x, r in sorted(points[:4], key=lambda p: (p[1], p[0])):
        for p in np.argwhere(want >= 0):
            if sum((u - v) ** 2 for u, v in zip(p, (z, y, x))) <= r * r:
                want[tuple(p)] = label
    assert (array_of(contacts.placed_balls(df, ((0, 0, 0), (6, 7, 8)), "at"), want.shape) == want).all()
    assert contacts.placed_balls(df.limit(0), ((0, 0, 0), (6, 7, 8)), "at").count() == 0


def test_dilation(spark):
    r = np.random.default_rng(3)
    a = np.where(r.random((5, 6, 7)) < 0.06, r.integers(1, 1 << 60, (5, 6, 7)), 0)
    want = np.zeros(a.shape, int)
    for z, y, x in np.argwhere(want == 0):
        want[z, y, x] = a[max(0, z - 1) : z + 2, max(0, y - 1) : y + 2, max(0, x - 1) : x + 2].max()
    assert (array_of(contacts.box_dilated(image(spark, a), 1, ((0, 0, 0), a.shape)), a.shape) == want).all()
    assert (array_of(contacts.box_dilated(image(spark, a), 0, ((0, 0, 0), a.shape)), a.shape) == a).all()


def test_normalized(spark):
    df = spark.createDataFrame([(1, 2.0), (2, 4.0), (3, None), (4, 10.0)], "k int, v double")
    assert [q.v for q in contacts.normalized(df, "v").orderBy("k").collect()] == [0.0, 0.25, None, 1.0]
    assert [q.v for q in contacts.normalized(df, "v", 254).orderBy("k").collect()] == [0, 63, None, 254]
    assert [q.v for q in contacts.normalized(df.where("k in (2, 3)"), "v").orderBy("k").collect()] == [0.0, None]
    assert contacts.normalized(df.limit(0), "v").count() == 0


def test_grid_split_plan(spark):
    """Replaying the plan gives every voxel to one piece of the finest grid."""
    r = random.Random(4)
    voxels = {(r.choice((1, 2)), *(r.randrange(-20, 40) for _ in range(3))) for _ in range(300)}
    df = spark.createDataFrame(sorted(voxels), "sv long, z long, y long, x long")
    plan = contacts.grid_split_plan(geometry.encode_runs(df, ["sv"]), 16, 4).collect()
    for grid in (16, 8, 4):
        pieces = {}
        for sv, *p in voxels:
            pieces.setdefault((sv, *(v // grid for v in p)), []).append(p)
        own = {(q["sv"], q["bz"], q["by"], q["bx"]): q for q in plan if q["grid"] == grid}
        assert {k: q["voxels"] for k, q in own.items()} == {k: len(v) for k, v in pieces.items()}
        groups = {}
        for k in pieces:
            groups.setdefault((k[0], *(v // 2 for v in k[1:])) if grid < 16 else k[0], []).append(k)
        for members in groups.values():
            assert [own[k]["remains"] for k in sorted(members)] == [False] * (len(members) - 1) + [True]
            assert {own[k]["parent_voxels"] for k in members} == {sum(own[k]["voxels"] for k in members)}
    assert contacts.grid_split_plan(geometry.encode_runs(df.limit(0), ["sv"]), 16, 4).count() == 0
    for bad in ((12, 8), (4, 8), (24, 8), (8, 0)):
        with pytest.raises(ValueError):
            contacts.grid_split_plan(geometry.encode_runs(df, ["sv"]), *bad)


def test_rows_of_a_merge_graph(spark):
    edges = spark.createDataFrame([(1, 2, 5), (2, 3, 5), (3, 4, 0), (None, 1, None)], "id_a long, id_b long, body long")
    assert mergetable.edges_of_body(edges, 5).count() == 2
    svs = spark.createDataFrame([(2,), (3,), (3,), (None,)], "sv long")
    assert [tuple(q) for q in mergetable.edges_within(edges, svs).collect()] == [(2, 3, 5)]
    assert mergetable.edges_within(edges, svs.limit(0)).where(F.col("body") >= 0).count() == 0
