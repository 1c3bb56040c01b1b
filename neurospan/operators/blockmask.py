"""Sparse masks of blocks: a table of set blocks with a resolution and a box of their own, in voxels of full resolution."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

AXES = ("z", "y", "x")
Triple = tuple[int, int, int]
Box = tuple[Triple, Triple]


def triple(v: int | Triple) -> Triple:
    return (v,) * 3 if isinstance(v, int) else tuple(v)


def _cell(c: Column, size: int, origin: int = 0) -> Column:
    """Floor of (c - origin) / size in whole numbers."""
    c = c.cast("long") - origin
    return F.call_function("div", c - F.pmod(c, F.lit(size)), F.lit(size))


def outward(box: Box, size: Triple) -> Box:
    """The box grown to multiples of a size."""
    return tuple(a // s * s for a, s in zip(box[0], size)), tuple(-(-b // s) * s for b, s in zip(box[1], size))


def common(a: Box, b: Box) -> Box:
    return tuple(map(max, a[0], b[0])), tuple(map(min, a[1], b[1]))


def is_empty(box: Box) -> bool:
    return any(a >= b for a, b in zip(*box))


@dataclass(frozen=True)
class BlockMask:
    """blocks: distinct (z, y, x) of set blocks, counted from the space's origin; box: what the mask knows of, stops outside."""

    blocks: DataFrame
    resolution: Triple
    box: Box

    @classmethod
    def empty(cls, spark, resolution: int | Triple, corner: Triple = (0, 0, 0)) -> BlockMask:
        return cls(spark.createDataFrame([], "z long, y long, x long"), triple(resolution), (corner, corner))

    @classmethod
    def from_blocks(cls, blocks: DataFrame, resolution: int | Triple, box: Box | None = None) -> BlockMask:
        """From rows (z, y, x) of blocks; without a box, it is the tight one. Repeated blocks count once, those with a null or outside a given box are left out."""
        size = triple(resolution)
        own = blocks.select(*(F.col(a).cast("long").alias(a) for a in AXES)).where("z IS NOT NULL AND y IS NOT NULL AND x IS NOT NULL").distinct()
        if box is not None:
            return cls(own, size, box)._within(box)
        at = own.agg(*(f(a).alias(f"{a}{n}") for a in AXES for n, f in (("0", F.min), ("1", F.max)))).first()
        if at["z0"] is None:
            return cls(own, size, ((0, 0, 0), (0, 0, 0)))
        return cls(own, size, (tuple(at[f"{a}0"] * s for a, s in zip(AXES, size)), tuple((at[f"{a}1"] + 1) * s for a, s in zip(AXES, size))))

    @classmethod
    def from_mask(cls, mask: DataFrame, mask_resolution: int | Triple, box: Box, resolution: int | Triple) -> BlockMask:
        """From set cells (z, y, x) of a finer mask, counted from the box's corner; its resolution has to divide the new one's. A block is set if any of its cells is."""
        fine, size = triple(mask_resolution), triple(resolution)
        if any(s % f for s, f in zip(size, fine)):
            raise ValueError(f"{fine} doesn't divide {size}")
        own = mask.select(*(_cell(F.col(a).cast("long") * f + low, s).alias(a) for a, f, s, low in zip(AXES, fine, size, box[0])))
        return cls.from_blocks(own, size, box)

    def _within(self, box: Box) -> BlockMask:
        inside = [(F.col(a) >= lo // s) & (F.col(a) < -(-hi // s)) for a, s, lo, hi in zip(AXES, self.resolution, *box)]
        return BlockMask(self.blocks.where(inside[0] & inside[1] & inside[2]), self.resolution, box)

    def part(self, box: Box) -> BlockMask | None:
        """The mask within a box, grown to whole blocks; None if the two have nothing in common."""
        new = common(outward(box, self.resolution), self.box)
        return None if is_empty(new) else self._within(new)

    def with_resolution(self, resolution: int | Triple) -> BlockMask:
        """The same blocks read as of another size: the mask is stretched or shrunk about the origin."""
        new, old = triple(resolution), self.resolution
        if not (all(n >= o for n, o in zip(new, old)) or all(n <= o for n, o in zip(new, old))):
            raise ValueError("a resolution can't be finer along some axes and coarser along others")
        scaled = lambda p: tuple(v * (n // o) if n > o else v // (o // n) for v, n, o in zip(p, new, old))
        return BlockMask(self.blocks, new, (scaled(self.box[0]), scaled(self.box[1])))

    def regrid(self, resolution: int | Triple) -> BlockMask:
        """The same space in blocks of another size. Finer blocks cover exactly what is set; a coarser one is set if any of it is. Along each axis one size has to divide the other."""
        new, cells = triple(resolution), self.blocks
        for a, n, o in zip(AXES, new, self.resolution):
            if n % o and o % n:
                raise ValueError(f"neither of {n} and {o} divides the other")
            if o > n:
                cells = cells.withColumn(a, F.explode(F.sequence(F.col(a) * (o // n), F.col(a) * (o // n) + (o // n - 1))))
            elif n > o:
                cells = cells.withColumn(a, _cell(F.col(a), n // o))
        return BlockMask(cells.distinct() if any(n > o for n, o in zip(new, self.resolution)) else cells, new, outward(self.box, new))

    def voxels(self, box: Box) -> DataFrame:
        """(z, y, x) of set voxels of full resolution within a box of whole blocks. A block gives its own voxels alone, so work grows with what is set."""
        if any(v % s for end in box for v, s in zip(end, self.resolution)):
            raise ValueError("the box isn't made of whole blocks")
        cells = self._within(box).blocks
        for a, s in zip(AXES, self.resolution):
            cells = cells.withColumn(a, F.explode(F.sequence(F.col(a) * s, F.col(a) * s + (s - 1))))
        return cells

    def boxes(self, brick: int | Triple, offset: Triple = (0, 0, 0), halo: int | Triple = 0, logical: bool = False) -> DataFrame:
        """(z0, y0, x0, z1, y1, x1) of the bricks of a grid that have set blocks: whole bricks if logical, else the tight box of what is set in each, with the halo around it.

        A block that several bricks share counts in each with its part there.
        """
        size, wide = triple(brick), triple(halo)
        rows = self.blocks
        for a, s, b, o in zip(AXES, self.resolution, size, offset):
            rows = rows.withColumn(f"_{a}0", F.col(a) * s).withColumn(f"_{a}1", (F.col(a) + 1) * s)
            rows = rows.withColumn(f"_b{a}", F.explode(F.sequence(_cell(F.col(f"_{a}0"), b, o), _cell(F.col(f"_{a}1") - 1, b, o))))
        low = {a: F.col(f"_b{a}") * b + o for a, b, o in zip(AXES, size, offset)}
        keys = [f"_b{a}" for a in AXES]
        if logical:
            whole = rows.select(*keys).distinct()
            return whole.select(*(low[a].alias(f"{a}0") for a in AXES), *((low[a] + b).alias(f"{a}1") for a, b in zip(AXES, size)))
        tight = rows.groupBy(*keys).agg(*(F.min(f"_{a}0").alias(f"_{a}0") for a in AXES), *(F.max(f"_{a}1").alias(f"_{a}1") for a in AXES))
        return tight.select(*((F.greatest(F.col(f"_{a}0"), low[a]) - h).alias(f"{a}0") for a, h in zip(AXES, wide)), *((F.least(F.col(f"_{a}1"), low[a] + b) + h).alias(f"{a}1") for a, b, h in zip(AXES, size, wide)))
