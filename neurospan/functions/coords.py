"""Coordinates, boxes and grids as Column expressions. Coordinates are in z, y, x order; boxes are [start, stop)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 21
_MASK = (1 << BITS) - 1
AXES = ("z", "y", "x")


def _long(c) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("long")


def pack_point(z, y, x) -> Column:
    """63-bit point id, 21 signed bits an axis."""
    part = lambda c: _long(c).bitwiseAND(F.lit(_MASK))
    return F.shiftleft(part(z), 2 * BITS).bitwiseOR(F.shiftleft(part(y), BITS)).bitwiseOR(part(x))


def unpack_point(point, wraps=None) -> tuple[Column, Column, Column]:
    p = _long(point)
    low = [F.shiftright(F.shiftleft(p, 1 + BITS * k), 64 - BITS) for k in range(3)]
    return tuple(_rewrapped(low, wraps))


def point_wraps(z, y, x) -> Column:
    """What coordinates have beyond the 21 signed bits of a point id, as an id of the same form: 0 for all that fit. Ids of coordinates beyond 2^20 stay apart with it, up to 2^31."""
    return pack_point(*(F.shiftright(_long(c) + F.lit(1 << (BITS - 1)), BITS) for c in (z, y, x)))


def _rewrapped(low: list[Column], wraps) -> list[Column]:
    if wraps is None:
        return [c.cast("int") for c in low]
    return [(c + F.shiftleft(w.cast("long"), BITS)).cast("int") for c, w in zip(low, unpack_point(wraps))]


def pack_block_point(z, y, x, log2: int = 6) -> Column:
    """Point id whose high bits are the block's index: signed order of ids is order of blocks, then of voxels."""
    high = BITS - log2
    flip = lambda c: _long(c).bitwiseAND(F.lit(_MASK)).bitwiseXOR(F.lit(1 << (BITS - 1)))
    parts = [flip(c) for c in (z, y, x)]
    blocks = [F.shiftleft(F.shiftright(p, log2), 3 * log2 + high * (2 - k)) for k, p in enumerate(parts)]
    inner = [F.shiftleft(p.bitwiseAND(F.lit((1 << log2) - 1)), log2 * (2 - k)) for k, p in enumerate(parts)]
    return reduce(lambda a, b: a.bitwiseOR(b), blocks + inner)


def unpack_block_point(point, log2: int = 6, wraps=None) -> tuple[Column, Column, Column]:
    high, p, out = BITS - log2, _long(point), []
    for k in range(3):
        block = F.shiftright(p, 3 * log2 + high * (2 - k)).bitwiseAND(F.lit((1 << high) - 1))
        inner = F.shiftright(p, log2 * (2 - k)).bitwiseAND(F.lit((1 << log2) - 1))
        raw = F.shiftleft(block, log2).bitwiseOR(inner).bitwiseXOR(F.lit(1 << (BITS - 1)))
        out.append(F.shiftright(F.shiftleft(raw, 64 - BITS), 64 - BITS))
    return tuple(_rewrapped(out, wraps))


def pack_aligned_block(z, y, x, log2: int = 6) -> Column:
    """Block id of voxel coordinates that are multiples of the block; raises at any other."""
    aligned = reduce(lambda a, b: a & b, (F.pmod(_long(c), F.lit(1 << log2)) == 0 for c in (z, y, x)))
    checked = lambda c: F.when(aligned, F.shiftright(_long(c), log2)).otherwise(F.raise_error(F.lit("coordinate is not aligned to the block")).cast("long"))
    return pack_point(checked(z), checked(y), checked(x))


def unpack_aligned_block(block, log2: int = 6, wraps=None) -> tuple[Column, Column, Column]:
    """The voxel coordinates, as longs with point_wraps of the blocks' places."""
    return tuple(F.shiftleft(c if wraps is None else c.cast("long"), log2) for c in unpack_point(block, wraps))


def pack_with_width(z, y, x, bits: int) -> Column:
    part = lambda c: _long(c).bitwiseAND(F.lit((1 << bits) - 1))
    return F.shiftleft(part(z), 2 * bits).bitwiseOR(F.shiftleft(part(y), bits)).bitwiseOR(part(x))


def _morton_bits(shape: list[int]) -> list[tuple[int, int]]:
    """(axis, bit) of the code's bits from the lowest on: axes from last to first, each as long as its extent needs bits."""
    need = [max(0, n - 1).bit_length() for n in shape]
    return [(a, b) for b in range(max(need, default=0)) for a in reversed(range(len(shape))) if b < need[a]]


def morton(coords: list, shape: list[int]) -> Column:
    """Compressed Morton code of grid coordinates in a grid of the shape."""
    bit = lambda k, a, b: F.shiftleft(F.shiftright(_long(coords[a]), b).bitwiseAND(F.lit(1)), k)
    return reduce(lambda p, q: p.bitwiseOR(q), (bit(k, a, b) for k, (a, b) in enumerate(_morton_bits(shape))), F.lit(0).cast("long"))


def unmorton(code, shape: list[int]) -> tuple[Column, ...]:
    bits = list(enumerate(_morton_bits(shape)))
    take = lambda axis: reduce(lambda p, q: p.bitwiseOR(q), (F.shiftleft(F.shiftright(_long(code), k).bitwiseAND(F.lit(1)), b) for k, (a, b) in bits if a == axis), F.lit(0).cast("long"))
    return tuple(take(a) for a in range(len(shape)))


def floor_div(c, n: int) -> Column:
    """Division that rounds to lower integers, negative ones included."""
    return F.floor((F.col(c) if isinstance(c, str) else c).cast("double") / F.lit(float(n))).cast("long")


def round_coord(c, grid: int, how: str = "down") -> Column:
    """Coordinate on the grid: down, up, or closest (ties down)."""
    c = _long(c)
    down = c - F.pmod(c, F.lit(grid))
    up = c + F.pmod(-c, F.lit(grid))
    if how == "down":
        return down
    if how == "up":
        return up
    if how == "closest":
        return F.when(c - down <= up - c, down).otherwise(up)
    raise ValueError(how)


def round_box(box: dict[str, Column], grid: dict[str, int], how: str = "out") -> dict[str, Column]:
    """Box with columns z0, z1, ...; out and in move starts and stops apart or together."""
    start, stop = {"out": ("down", "up"), "in": ("up", "down")}.get(how, (how, how))
    return {f"{a}{k}": round_coord(box[f"{a}{k}"], grid[a], start if k == 0 else stop) for a in AXES for k in (0, 1)}


def box_columns(prefix: str = "") -> dict[str, Column]:
    return {f"{a}{k}": F.col(f"{prefix}{a}{k}") for a in AXES for k in (0, 1)}


def box_intersection(p: dict[str, Column], q: dict[str, Column]) -> dict[str, Column]:
    """May be inverted where boxes are apart."""
    return {k: F.greatest(p[k], q[k]) if k[1] == "0" else F.least(p[k], q[k]) for k in p}


def box_union(p: dict[str, Column], q: dict[str, Column]) -> dict[str, Column]:
    return {k: F.least(p[k], q[k]) if k[1] == "0" else F.greatest(p[k], q[k]) for k in p}


def box_shape(p: dict[str, Column]) -> dict[str, Column]:
    return {a: p[f"{a}1"] - p[f"{a}0"] for a in AXES}


def box_volume(p: dict[str, Column]) -> Column:
    return reduce(lambda a, b: a * b, (F.greatest(c.cast("long"), F.lit(0)) for c in box_shape(p).values()))


def grid_cell(point: dict[str, Column], grid: dict[str, int], offset: dict[str, int] | None = None) -> dict[str, Column]:
    """Box of the grid cell that holds a point."""
    off = offset or dict.fromkeys(AXES, 0)
    low = {a: round_coord(point[a] - off[a], grid[a]) + off[a] for a in AXES}
    return {f"{a}{k}": low[a] + (grid[a] if k else 0) for a in AXES for k in (0, 1)}


def boxes_from_grid(df: DataFrame, grid: dict[str, int], halo: int = 0, clipped: bool = False, box: dict[str, Column] | None = None) -> DataFrame:
    """One row a grid cell that meets each row's box, as columns z0..x1 in place of the box; cells grow by halo, then are clipped."""
    b = box or box_columns()
    out = df
    for a in AXES:
        lo = round_coord(b[f"{a}0"], grid[a])
        cells = F.when(b[f"{a}1"] > b[f"{a}0"], F.sequence(lo, round_coord(b[f"{a}1"] - 1, grid[a]), F.lit(grid[a]).cast("long")))
        out = out.withColumn(f"_{a}", F.explode(cells))
    new = {}
    for a in AXES:
        start, stop = F.col(f"_{a}") - halo, F.col(f"_{a}") + grid[a] + halo
        new[f"{a}0"] = F.greatest(start, b[f"{a}0"]) if clipped else start
        new[f"{a}1"] = F.least(stop, b[f"{a}1"]) if clipped else stop
    keep = [c for c in df.columns if c not in new]
    return out.select(*keep, *(c.alias(n) for n, c in new.items()))


def slabs_from_box(df: DataFrame, axis: str, depth: int) -> DataFrame:
    """Slabs of a depth across an axis, clipped to each row's box."""
    lo, hi = F.col(f"{axis}0"), F.col(f"{axis}1")
    cut = df.withColumn("_s", F.explode(F.sequence(round_coord(lo, depth), round_coord(hi - 1, depth), F.lit(depth).cast("long"))))
    return cut.withColumn(f"{axis}0", F.greatest(F.col("_s"), lo)).withColumn(f"{axis}1", F.least(F.col("_s") + depth, hi)).drop("_s")


def boxes_from_points(df: DataFrame, grid: dict[str, int]) -> DataFrame:
    """Distinct cells that hold points z, y, x."""
    return df.select(*(c.alias(n) for n, c in grid_cell({a: F.col(a) for a in AXES}, grid).items())).distinct()


def is_covered(boxes: DataFrame, full: dict[str, tuple[int, int]], unit: dict[str, int]) -> DataFrame:
    """One row (covered): whether boxes on the unit grid cover the full box. unit divides all coordinates."""
    want = 1
    for a in AXES:
        want *= (full[a][1] - full[a][0]) // unit[a]
    inside = boxes.select(*(F.greatest(F.col(f"{a}0"), F.lit(full[a][0])).alias(f"{a}0") for a in AXES), *(F.least(F.col(f"{a}1"), F.lit(full[a][1])).alias(f"{a}1") for a in AXES))
    cells = boxes_from_grid(inside, unit).select("z0", "y0", "x0").distinct()
    return cells.agg((F.count("*") >= want).alias("covered"))


def pyramid_depth(shape: dict[str, Column], top: int) -> Column:
    """Halvings until the largest axis fits the top size."""
    return F.greatest(F.ceil(F.log2(F.greatest(*shape.values()) / F.lit(float(top)))), F.lit(0)).cast("int")


def lattice_line(z0, y0, x0, z1, y1, x1) -> Column:
    """Array of the integer points on a segment, one a step of its longest axis."""
    ends = [(_long(a), _long(b)) for a, b in ((z0, z1), (y0, y1), (x0, x1))]
    n = F.greatest(*(F.abs(b - a) for a, b in ends))
    at = lambda t, a, b: F.when(n == 0, a).otherwise(F.round(a + (b - a) * t / F.greatest(n, F.lit(1)))).cast("int")
    return F.transform(F.sequence(F.lit(0).cast("long"), n), lambda t: F.struct(*(at(t, a, b).alias(k) for k, (a, b) in zip(AXES, ends))))


# Factors and addend of the public 32-bit hash by which viewers colour segments.
_FACTORS, _ADDEND = (0xCC9E2D51, 0x1B873593), 0xE6546B64
_WORD = 0xFFFFFFFF


def hash_combine(state, value) -> Column:
    """32-bit hash (as LONG) of a state and a value's low bits; products stay below 2^63 by 16-bit halves."""

    def times(x: Column, m: int) -> Column:
        low, high = x.bitwiseAND(F.lit(0xFFFF)), F.shiftright(x, 16)
        return (low * m + F.shiftleft((high * m).bitwiseAND(F.lit(0xFFFF)), 16)).bitwiseAND(F.lit(_WORD))

    def turned(x: Column, n: int) -> Column:
        return F.shiftleft(x, n).bitwiseOR(F.shiftright(x, 32 - n)).bitwiseAND(F.lit(_WORD))

    v = times(turned(times(_long(value).bitwiseAND(F.lit(_WORD)), _FACTORS[0]), 15), _FACTORS[1])
    return (turned(_long(state).bitwiseAND(F.lit(_WORD)).bitwiseXOR(v), 13) * 5 + _ADDEND).bitwiseAND(F.lit(_WORD))


def pack_color(r, g, b) -> Column:
    return F.shiftleft(_long(r), 16).bitwiseOR(F.shiftleft(_long(g), 8)).bitwiseOR(_long(b))


def unpack_color(c) -> tuple[Column, Column, Column]:
    return tuple(F.shiftright(_long(c), s).bitwiseAND(F.lit(255)).cast("int") for s in (16, 8, 0))


def hsv_to_rgb(h: Column, s: Column, v: Column) -> tuple[Column, Column, Column]:
    """Hue, saturation, value in 0..1 to red, green, blue in 0..1."""
    i = F.floor(h * 6)
    f = h * 6 - i
    p, q, t, k = v * (1 - s), v * (1 - s * f), v * (1 - s * (1 - f)), F.pmod(i, F.lit(6))
    table = [(v, t, p), (q, v, p), (p, v, t), (p, q, v), (t, p, v), (v, p, q)]
    pick = lambda n: reduce(lambda c, j: c.when(k == j, table[j][n]), range(1, 6), F.when(k == 0, table[0][n]))
    return tuple(pick(n) for n in range(3))


def color_of_id(c, seed: int = 0) -> Column:
    """Packed colour of an id as a viewer with this colour seed shows it: hue and saturation from the hash of both halves."""
    h = hash_combine(hash_combine(F.lit(seed), c), F.shiftright(_long(c), 32))
    byte = lambda k: F.shiftright(h, k).bitwiseAND(F.lit(255)) / F.lit(255.0)
    return pack_color(*(F.rint(x * 255) for x in hsv_to_rgb(byte(0), F.lit(0.5) + F.lit(0.5) * byte(8), F.lit(1.0))))


def hex_color(c) -> Column:
    return F.concat(F.lit("#"), F.lower(F.lpad(F.hex(_long(c)), 6, "0")))
