"""Great circles, the cube sphere and views as Column expressions."""

from __future__ import annotations

from decimal import Decimal, localcontext

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meridia.functions.cal import col

EARTH_KM = 6371.0088
COMPASS = ("N", "NE", "E", "SE", "S", "SW", "W", "NW")


def great_circle_km(lon1, lat1, lon2, lat2) -> Column:
    """Haversine distance; the square is clamped to [0, 1]."""
    a, b = F.radians(col(lat1)), F.radians(col(lat2))
    h = F.pow(F.sin((b - a) / 2), 2) + F.cos(a) * F.cos(b) * F.pow(F.sin(F.radians(col(lon2) - col(lon1)) / 2), 2)
    return 2 * EARTH_KM * F.asin(F.sqrt(F.least(F.lit(1.0), F.greatest(F.lit(0.0), h))))


def km_between(lat1, cos1, lon1, lat2, cos2, lon2) -> Column:
    """great_circle_km() from latitudes in radians and their cosines, to the last bit; longitudes in degrees."""
    a, b = F.sin((col(lat2) - col(lat1)) / 2), F.sin(F.radians(col(lon2) - col(lon1)) / 2)
    h = a * a + col(cos1) * col(cos2) * (b * b)
    return 2 * EARTH_KM * F.asin(F.sqrt(F.least(F.lit(1.0), F.greatest(F.lit(0.0), h))))


def half_up(x, digits: int) -> Column:
    """A number that is not negative rounded as DuckDB does, without the decimals that Spark's round() makes of every double."""
    scaled = col(x) * float(10**digits)
    low = F.floor(scaled)
    return (low + F.when(scaled - low >= 0.5, 1).otherwise(0)) / float(10**digits)


def bearing(lon1, lat1, lon2, lat2) -> Column:
    """Degrees clockwise from north at the first point."""
    a, b, d = F.radians(col(lat1)), F.radians(col(lat2)), F.radians(col(lon2) - col(lon1))
    return F.pmod(F.degrees(F.atan2(F.sin(d) * F.cos(b), F.cos(a) * F.sin(b) - F.sin(a) * F.cos(b) * F.cos(d))) + 360, F.lit(360.0))


def compass(degrees) -> Column:
    """One of eight names."""
    return F.element_at(F.array(*map(F.lit, COMPASS)), (F.pmod(F.floor(col(degrees) / 45 + 0.5), F.lit(8)) + 1).cast("int"))


def unit(lon, lat) -> Column:
    """struct(x, y, z): z to the north pole, x to (0, 0)."""
    a, b = F.radians(col(lon)), F.radians(col(lat))
    return F.struct((F.cos(b) * F.cos(a)).alias("x"), (F.cos(b) * F.sin(a)).alias("y"), F.sin(b).alias("z"))


def lon_lat(x, y, z) -> Column:
    return F.struct(F.degrees(F.atan2(col(y), col(x))).alias("lon"), F.degrees(F.atan2(col(z), F.sqrt(col(x) * col(x) + col(y) * col(y)))).alias("lat"))


#: Outward axis of each cube face, and the axes of its s and t.
FACES = (
    ((1, 0, 0), (0, 1, 0), (0, 0, 1)),
    ((0, 1, 0), (-1, 0, 0), (0, 0, 1)),
    ((-1, 0, 0), (0, -1, 0), (0, 0, 1)),
    ((0, -1, 0), (1, 0, 0), (0, 0, 1)),
    ((0, 0, 1), (0, 1, 0), (-1, 0, 0)),
    ((0, 0, -1), (0, 1, 0), (1, 0, 0)),
)


def _dot(axis: tuple[int, int, int], x: Column, y: Column, z: Column) -> Column:
    return axis[0] * x + axis[1] * y + axis[2] * z


def _arcs(n: int) -> tuple[list[float], list[float]]:
    """Angles whose tangents are 0, 1 / n, ... 1: as doubles, and what these lack of them."""
    high, low, at = [0.0], [0.0], Decimal(0)
    with localcontext(prec=50):
        for k in range(1, n + 1):
            step = Decimal(n) / (n * n + k * (k - 1))
            at += sum((-1) ** i * step ** (2 * i + 1) / (2 * i + 1) for i in range(10))
            high.append(float(at))
            low.append(float(at - Decimal(high[-1])))
    return high, low


_STEPS = 256
_HIGH, _LOW = _arcs(_STEPS)


def atan(x) -> Column:
    """Angle of a tangent from -1 to 1, rounded to the nearest double but for some in a thousand; the JVM's own is off by one in some in a hundred,
    which moves places on the border of two tiles. x stands in it many times: give it a column, not a long expression."""
    given = lambda values: F.expr(f"array({', '.join(f'{v!r}D' for v in values)})")
    a = F.abs(col(x))
    k = F.floor(a * _STEPS + 0.5).cast("int")
    u = (a - k / _STEPS) / (1 + a * (k / _STEPS))
    angle = F.get(given(_HIGH), k) + (F.get(given(_LOW), k) + u * (1 - u * u * (1 / 3 - u * u / 5)))
    return F.when(col(x) < 0, -angle).otherwise(angle)


def tangents(x, y, z) -> tuple[Column, Column, Column]:
    """Face of a direction, that of the largest dot product (the lowest of equals), and the tangents of its two angles there."""
    x, y, z = col(x), col(y), col(z)
    best = F.greatest(*[_dot(f[0], x, y, z) for f in FACES])
    face = F.coalesce(*[F.when(_dot(f[0], x, y, z) == best, i) for i, f in enumerate(FACES)])
    along = lambda k: F.coalesce(*[F.when(face == i, _dot(f[k], x, y, z)) for i, f in enumerate(FACES)])
    return face, along(1) / best, along(2) / best


def cube(x, y, z) -> Column:
    """struct(face, s, t) of a direction: the face of the largest dot product (the lowest of equals), s and t in [0, 1] of equal angles."""
    face, a, b = tangents(x, y, z)
    return F.struct(face.alias("face"), (0.5 + 2 / 3.141592653589793 * F.atan(a)).alias("s"), (0.5 + 2 / 3.141592653589793 * F.atan(b)).alias("t"))


def along(u: Column, face: int, axis: int) -> Column:
    """A direction's share along one of a face's axes: 0 outward, 1 that of s, 2 that of t."""
    return _dot(FACES[face][axis], u["x"], u["y"], u["z"])


def tile_index(s, level: int) -> Column:
    """Number of the tile along one side."""
    n = 1 << level
    return F.least(F.lit(n - 1), F.greatest(F.lit(0), F.floor(col(s) * n))).cast("int")


def node_id(face, level: int, x, y) -> Column:
    """Number of a tile: all levels above come first, then faces, rows, columns."""
    n = 1 << level
    before = 6 * ((4**level - 1) // 3)
    return (before + (col(face).cast("long") * n + col(y)) * n + col(x)).cast("long")


def node_tile(node, level: int) -> Column:
    """struct(face, x, y) of a node of a level."""
    n = 1 << level
    k = col(node) - 6 * ((4**level - 1) // 3)
    return F.struct(F.floor(k / (n * n)).cast("int").alias("face"), F.pmod(k, F.lit(n)).cast("int").alias("x"), F.pmod(F.floor(k / n), F.lit(n)).cast("int").alias("y"))


def children(x, y) -> Column:
    """The four tiles of the next level, as structs of x and y."""
    return F.array(*[F.struct((2 * col(x) + i).alias("x"), (2 * col(y) + j).alias("y")) for j in (0, 1) for i in (0, 1)])


def face_edges() -> list[tuple[int, int, int, int, int]]:
    """(face, side, other face, other side, turned) of all 24 face sides; sides 0: s=0, 1: s=1, 2: t=0, 3: t=1. turned: the shared edge runs the other way."""

    def end(face: int, side: int, at: int) -> tuple[int, ...]:
        out, s, t = FACES[face]
        u, v = ((2 * (side % 2) - 1, at) if side < 2 else (at, 2 * (side % 2) - 1))
        return tuple(o + u * a + v * b for o, a, b in zip(out, s, t, strict=True))

    sides = [(f, k) for f in range(6) for k in range(4)]
    out = []
    for f, k in sides:
        a, b = end(f, k, -1), end(f, k, 1)
        for g, m in sides:
            if g != f and {end(g, m, -1), end(g, m, 1)} == {a, b}:
                out.append((f, k, g, m, int(end(g, m, -1) != a)))
    return out


def screen(m: list[Column], x, y, z, width, height) -> Column:
    """struct(px, py, front) of a direction under a row-major 4 x 4 view matrix: pixels, and whether it is before the horizon (w > 0)."""
    x, y, z = col(x), col(y), col(z)
    row = lambda r: m[4 * r] * x + m[4 * r + 1] * y + m[4 * r + 2] * z + m[4 * r + 3]
    w = row(3)
    return F.struct(((row(0) / w + 1) / 2 * col(width)).alias("px"), ((1 - row(1) / w) / 2 * col(height)).alias("py"), (w > 0).alias("front"))


def lattice(west, south, east, north, n: int) -> list[tuple[Column, Column]]:
    """The (lon, lat) of n x n points of an extent, its corners among them; west > east where it goes across 180 degrees."""
    w, s = col(west), col(south)
    wide = F.pmod(col(east) - w, F.lit(360.0))
    return [(F.pmod(w + wide * (k / (n - 1)) + 180, F.lit(360.0)) - 180, s + (col(north) - s) * (m / (n - 1))) for k in range(n) for m in range(n)]


def extent_reach(lon, lat, west, south, east, north) -> Column:
    """Kilometres from a place to the furthest of nine points of an extent."""
    return F.greatest(*[great_circle_km(lon, lat, a, b) for a, b in lattice(west, south, east, north, 3)])


def smoothstep(a: float, b: float, x) -> Column:
    t = F.least(F.lit(1.0), F.greatest(F.lit(0.0), (col(x) - a) / (b - a)))
    return t * t * (3 - 2 * t)


def with_arc(df: DataFrame, lon1: str, lat1: str, lon2: str, lat2: str) -> DataFrame:
    """df with the great circle between two points, for along_arc(): unit vectors, angle and the inverse of its sine.

    Each step is a projection of its own, so that Spark computes every sine once per row of df.
    """
    flat = {}
    for n, lon, lat in ((1, lon1, lat1), (2, lon2, lat2)):
        a, b = F.radians(lon), F.radians(lat)
        flat |= {f"_x{n}": F.cos(b) * F.cos(a), f"_y{n}": F.cos(b) * F.sin(a), f"_z{n}": F.sin(b)}
    dot = F.col("_x1") * F.col("_x2") + F.col("_y1") * F.col("_y2") + F.col("_z1") * F.col("_z2")
    df = df.withColumns(flat).withColumn("_angle", F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), dot))))
    return df.withColumn("_over", F.when(F.col("_angle") >= 1e-9, 1 / F.sin("_angle")))


def along_arc(df: DataFrame, share: str, lon: str, lat: str) -> DataFrame:
    """with_arc()'s rows with lon and lat at a share of the way; the first point (its columns lon, lat) where both are one or share is 0."""
    df = df.withColumn("_p", F.sin((1 - F.col(share)) * F.col("_angle")) * F.col("_over")).withColumn("_q", F.sin(F.col(share) * F.col("_angle")) * F.col("_over"))
    df = df.withColumns({f"_{k}": F.col("_p") * F.col(f"_{k}1") + F.col("_q") * F.col(f"_{k}2") for k in "xyz"})
    first = F.col("_over").isNull() | (F.col(share) == 0)
    there = {lon: F.degrees(F.atan2("_y", "_x")), lat: F.degrees(F.atan2("_z", F.sqrt(F.col("_x") * F.col("_x") + F.col("_y") * F.col("_y"))))}
    df = df.withColumns({c: F.when(first, F.col(c).cast("double")).otherwise(x) for c, x in there.items()})
    return df.drop(*[f"_{k}{n}" for k in "xyz" for n in ("", 1, 2)], "_angle", "_over", "_p", "_q")
