"""Block masks and plans of cleaves."""

import random
from collections import defaultdict
from itertools import product

import pytest

from neurospan.operators import cleaves
from neurospan.operators.blockmask import BlockMask


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def blocks(spark, cells):
    return spark.createDataFrame(sorted(cells), "z int, y int, x int")


def test_voxels_of_any_box(spark):
    r = random.Random(1)
    cells = {(0, y, x) for y in range(10) for x in range(10) if r.random() < 0.5}
    m = BlockMask.from_blocks(blocks(spark, cells).union(blocks(spark, cells)), (1, 10, 10), ((0, 0, 0), (1, 100, 100)))
    full = {(0, y, x) for y in range(100) for x in range(100) if (0, y // 10, x // 10) in cells}
    assert rows(m.voxels(((0, 0, 0), (1, 100, 100)))) == sorted(full)
    assert rows(m.voxels(((0, 10, 20), (1, 150, 150)))) == sorted(p for p in full if p[1] >= 10 and p[2] >= 20)
    assert m.voxels(((5, 500, 500), (6, 510, 510))).count() == 0
    with pytest.raises(ValueError):
        m.voxels(((0, 5, 0), (1, 20, 20)))


#: Masks, grids and the boxes that they give.
ROWS = {(0, 0, x) for x in range(5)} | {(0, 1, x) for x in range(1, 4)}
SQUARE = {(0, y, x) for y in (1, 2, 3) for x in (2, 3)} | {(0, 4, 6), (0, 4, 7)}
CASES = [
    (ROWS, 10, (10, 10, 30), (0, 0, 0), [(0, 0, 0, 10, 10, 30), (0, 0, 30, 10, 10, 60), (0, 10, 0, 10, 20, 30), (0, 10, 30, 10, 20, 60)],
     [(0, 0, 0, 10, 10, 30), (0, 0, 30, 10, 10, 50), (0, 10, 10, 10, 20, 30), (0, 10, 30, 10, 20, 40)]),
    ({(z, y + 1, x + 2) for z, y, x in ROWS}, 10, (10, 10, 30), (0, 0, 0), [(0, 10, 0, 10, 20, 30), (0, 10, 30, 10, 20, 60), (0, 10, 60, 10, 20, 90), (0, 20, 30, 10, 30, 60)],
     [(0, 10, 20, 10, 20, 30), (0, 10, 30, 10, 20, 60), (0, 10, 60, 10, 20, 70), (0, 20, 30, 10, 30, 60)]),
    (SQUARE, (1, 10, 10), (1, 60, 30), (0, 0, 0), [(0, 0, 0, 1, 60, 30), (0, 0, 30, 1, 60, 60), (0, 0, 60, 1, 60, 90)], [(0, 10, 20, 1, 40, 30), (0, 10, 30, 1, 40, 40), (0, 40, 60, 1, 50, 80)]),
    (SQUARE, (1, 10, 10), (1, 60, 30), (0, 10, 20), [(0, 10, 20, 1, 70, 50), (0, 10, 50, 1, 70, 80)], [(0, 10, 20, 1, 40, 40), (0, 40, 60, 1, 50, 80)]),
]


@pytest.mark.parametrize("cells,size,brick,offset,logical,tight", CASES)
def test_boxes_of_bricks(spark, cells, size, brick, offset, logical, tight):
    m = BlockMask.from_blocks(blocks(spark, cells), size)
    assert rows(m.boxes(brick, offset, logical=True)) == logical
    assert rows(m.boxes(brick, offset)) == tight
    assert rows(m.boxes(brick, offset, halo=2)) == sorted(tuple(v - 2 if k < 3 else v + 2 for k, v in enumerate(b)) for b in tight)


def test_blocks_across_bricks(spark):
    """Blocks that aren't multiples of bricks are cut by them."""
    r = random.Random(2)
    cells = {tuple(r.randrange(-3, 4) for _ in range(3)) for _ in range(20)}
    m = BlockMask.from_blocks(blocks(spark, cells), (4, 6, 10))
    inside = defaultdict(list)
    for z, y, x in ((4 * c[0] + i, 6 * c[1] + j, 10 * c[2] + k) for c in cells for i, j, k in product(range(4), range(6), range(10))):
        inside[(z - 1) // 5, (y - 2) // 9, x // 7].append((z, y, x))
    want = sorted((*map(min, zip(*v)), *(max(c) + 1 for c in zip(*v))) for v in inside.values())
    assert rows(m.boxes((5, 9, 7), (1, 2, 0))) == want


def test_parts_and_resolutions(spark):
    m = BlockMask.from_blocks(blocks(spark, SQUARE), (1, 10, 10))
    assert m.box == ((0, 10, 20), (1, 50, 80)) and m.resolution == (1, 10, 10)
    part = m.part(((0, 15, 25), (1, 38, 31)))
    assert part.box == ((0, 10, 20), (1, 40, 40)) and rows(part.blocks) == sorted(c for c in SQUARE if c[1] < 4)
    assert m.part(((0, 60, 0), (1, 70, 100))) is None and BlockMask.empty(spark, 8).part(((0, 0, 0), (9, 9, 9))) is None
    far = m.with_resolution((2, 20, 20))
    assert far.box == ((0, 20, 40), (2, 100, 160)) and rows(far.blocks) == rows(m.blocks) and far.with_resolution((1, 10, 10)).box == m.box
    with pytest.raises(ValueError):
        m.with_resolution((2, 5, 20))
    fine = m.regrid((1, 5, 2))
    whole = ((0, 0, 0), (10, 100, 100))
    assert rows(fine.voxels(whole)) == rows(m.voxels(whole)) and fine.blocks.count() == len(SQUARE) * 10
    assert rows(fine.regrid((1, 10, 10)).blocks) == sorted(SQUARE)
    assert rows(m.regrid((2, 20, 40)).blocks) == sorted({(z // 2, y // 2, x // 4) for z, y, x in SQUARE})
    with pytest.raises(ValueError):
        m.regrid((1, 15, 10))
    coarse = BlockMask.from_mask(blocks(spark, {(0, y - 1, x - 2) for _, y, x in SQUARE}), (1, 10, 10), ((0, 10, 20), (1, 50, 80)), (1, 20, 20))
    assert rows(coarse.blocks) == sorted({(0, y // 2, x // 2) for _, y, x in SQUARE})
    none = BlockMask.from_blocks(blocks(spark, SQUARE).limit(0), 4)
    assert none.boxes(8).count() == 0 and none.box == ((0, 0, 0), (0, 0, 0)) and none.regrid(2).blocks.count() == 0


def replay(index, groups, plan):
    """Bodies after the cleaves: parts of supervoxels by path."""
    group, parts = dict(groups), {}
    for body in {b for b, _ in index}:
        parts[body, ""] = {s for b, s in index if b == body}
    for c in sorted(plan, key=lambda c: c.level):
        svs = parts.pop((c.body, c.path))
        taken = {s for s in svs if s in group and c.first_group <= group[s] <= c.last_group}
        size = lambda some: sum(1 for b, s in index if b == c.body and s in some)  # noqa: B023, E731
        assert taken and taken != svs and size(taken) == c.n_rows and size(svs) == c.part_rows and len({group[s] for s in taken}) == c.n_groups
        rest, new = ("", "g") if c.level == 0 else (c.path + "b", c.path + "t")
        parts[c.body, new], parts[c.body, rest if c.level else "rest"] = taken, svs - taken
    return parts


@pytest.mark.parametrize("seed", [1, 2])
def test_plan_of_cleaves(spark, seed):
    r = random.Random(seed)
    index = [(b, 100 * b + s) for b in range(1, 6) for s in range(30) for _ in range(r.choice([1, 1, 2, 60]))]
    groups = [(s, r.randrange(3 + b)) for b, s in set(index) if b % 2 or s % 100 < 20 for b in [s // 100]]
    df = spark.createDataFrame(index + [(None, 5), (9, None)], "body long, sv long")
    plan, result = cleaves.plan_cleaves(df, spark.createDataFrame(groups + [(None, 1), (7, None)], "sv long, group int"))
    got = plan.collect()
    parts = replay(index, groups, got)
    ends = {(x.body, x.path): x.group for x in result.collect()}
    known = dict(groups)
    for key, svs in parts.items():
        assert {known.get(s) for s in svs} == ({ends[key]} if key in ends else {None})
    assert len(ends) == len({(s // 100, g) for s, g in groups})
    for b in range(1, 6):
        n = len({g for s, g in groups if s // 100 == b})
        assert sum(c.body == b for c in got) == n - (b % 2 == 1)
    moved = {m.body: m.rows for m in cleaves.moved_rows(plan).collect()}
    assert all(moved[b] <= sum(x == b for x, _ in index) * 10 for b in moved)


def test_many_groups_take_few_levels(spark):
    df = spark.range(600).selectExpr("1 AS body", "id AS sv")
    plan, result = cleaves.plan_cleaves(df, df.selectExpr("sv", "sv AS `group`"))
    m = cleaves.moved_rows(plan).collect()[0]
    assert m.cleaves == 599 and m.levels <= 10 and m.rows <= 600 * 10 and result.count() == 600
