"""Vector, rounding and distance helpers that expand to column arithmetic, so that they stay in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Vec = tuple[Column, Column, Column]


def vec(x: str, y: str, z: str) -> Vec:
    """Three columns as doubles; single-precision columns are widened before any arithmetic."""
    return tuple(F.col(c).cast("double") for c in (x, y, z))


def sub(a: Vec, b: Vec) -> Vec:
    return tuple(p - q for p, q in zip(a, b, strict=True))


def add(a: Vec, b: Vec) -> Vec:
    return tuple(p + q for p, q in zip(a, b, strict=True))


def scale(a: Vec, k: Column | float) -> Vec:
    return tuple(p * k for p in a)


def dot(a: Vec, b: Vec) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def cross(a: Vec, b: Vec) -> Vec:
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def norm(a: Vec) -> Column:
    return F.sqrt(dot(a, a))


def distance(a: Vec, b: Vec) -> Column:
    return norm(sub(a, b))


def unit(a: Vec, least: float = 1e-12) -> Vec:
    """a over its length; +Z where the length is below `least`."""
    n = norm(a)
    long = n > least
    return tuple(F.when(long, p / n).otherwise(F.lit(d)) for p, d in zip(a, (0.0, 0.0, 1.0), strict=True))


def angle(a: Vec, b: Vec) -> Column:
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(unit(a), unit(b)))))


def triangle_normal(a: Vec, b: Vec, c: Vec) -> Vec:
    return unit(cross(sub(b, a), sub(c, a)))


def triangle_area(a: Vec, b: Vec, c: Vec) -> Column:
    return norm(cross(sub(b, a), sub(c, a))) * F.lit(0.5)


def signed_volume(a: Vec, b: Vec, c: Vec) -> Column:
    return dot(a, cross(b, c)) / F.lit(6.0)


def rounded(c: Column, digits: int) -> Column:
    """To `digits` decimals, halves towards +infinity."""
    k = F.lit(10.0**digits)
    return F.floor(c * k + F.lit(0.5)).cast("double") / k


def quantized(c: Column, step: float) -> Column:
    """The number of steps nearest to c, halves towards +infinity."""
    return F.floor(c / F.lit(step) + F.lit(0.5)).cast("long")


def basis(n: Vec) -> tuple[Vec, Vec]:
    """Two unit vectors across n: the first from X, or from Y where |nx| > 0.8."""
    steep = F.abs(n[0]) > 0.8
    ref = tuple(F.when(steep, F.lit(a)).otherwise(F.lit(b)) for a, b in ((0.0, 1.0), (1.0, 0.0), (0.0, 0.0)))
    u = unit(sub(ref, scale(n, dot(ref, n))))
    return u, cross(n, u)


def snapped_axis(n: Vec, least: float = 0.92) -> Column:
    """The signed coordinate axis that n is closest to (of equals the first), null if none is within `least`."""
    most = F.greatest(*[F.abs(c) for c in n])
    out = F.lit(None).cast("string")
    for c, name in reversed(list(zip(n, "XYZ", strict=True))):
        out = F.when((F.abs(c) == most) & (c >= least), "+" + name).when((F.abs(c) == most) & (c <= -least), "-" + name).otherwise(out)
    return out


def plane_distance(p: Vec, origin: Vec, n: Vec) -> Column:
    return F.abs(dot(sub(p, origin), n))


def cylinder_distance(p: Vec, origin: Vec, axis: Vec, radius: Column, height: Column) -> Column:
    """To a finite cylinder's wall: beyond its ends the distance to the rim."""
    w = sub(p, origin)
    t = dot(w, axis)
    r = norm(sub(w, scale(axis, t)))
    beyond = F.greatest(-t, t - height, F.lit(0.0))
    return F.sqrt((r - radius) * (r - radius) + beyond * beyond)


def cone_distance(p: Vec, apex: Vec, axis: Vec, half_angle: Column) -> Column:
    """To a cone's wall; in the region behind the apex, to the apex."""
    w = sub(p, apex)
    t = dot(w, axis)
    r = norm(sub(w, scale(axis, t)))
    behind = t * F.cos(half_angle) + r * F.sin(half_angle) < 0
    return F.when(behind, norm(w)).otherwise(F.abs(r * F.cos(half_angle) - t * F.sin(half_angle)))


def torus_distance(p: Vec, centre: Vec, axis: Vec, major: Column, minor: Column) -> Column:
    w = sub(p, centre)
    t = dot(w, axis)
    r = norm(sub(w, scale(axis, t)))
    return F.abs(F.sqrt((r - major) * (r - major) + t * t) - minor)


def halton(i: Column, base: int, digits: int = 40) -> Column:
    """The radical inverse of i, by digits in the base."""
    k = F.sequence(F.lit(0), F.lit(digits - 1))
    return F.aggregate(k, F.lit(0.0), lambda s, d: s + (F.floor(i / F.pow(F.lit(float(base)), d)) % base) / F.pow(F.lit(float(base)), d + 1))


def line_distance(p: Vec, origin: Vec, axis: Vec) -> Column:
    w = sub(p, origin)
    return norm(sub(w, scale(axis, dot(w, axis))))


def interval_overlap(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(a1, b1) - F.greatest(a0, b0))


def plane_foot(p: Vec, origin: Vec, n: Vec) -> Vec:
    """The point of a plane that is nearest to p."""
    return sub(p, scale(n, dot(sub(p, origin), n)))


def cylinder_foot(p: Vec, origin: Vec, axis: Vec, radius: Column, height: Column) -> tuple[Vec, Column]:
    """The point of a finite cylinder's wall that is nearest to p, and whether p lies beyond an end. A point on the axis has
    its foot along the first vector across it."""
    w = sub(p, origin)
    t = dot(w, axis)
    out = sub(w, scale(axis, t))
    r = norm(out)
    u, _ = basis(axis)
    across = tuple(F.when(r > 1e-12, o / r).otherwise(k) for o, k in zip(out, u, strict=True))
    return add(add(origin, scale(axis, F.greatest(F.lit(0.0), F.least(height, t)))), scale(across, radius)), (t < 0) | (t > height)


def cylinder_through(p0: Vec, n0: Vec, p1: Vec, n1: Vec, least: float = 0.05) -> tuple[Vec, Vec, Column]:
    """(axis, centre, radius) of the cylinder on which p0 and p1 lie with the normals n0 and n1: the axis is across both, and
    the normals' lines meet on it. Null where the normals are nearly parallel. Normals that point apart give no axis; two
    that oppose each other are parallel."""
    c = cross(n0, n1)
    size = norm(c)
    good = size > least
    axis = tuple(F.when(good, k / size) for k in c)
    w = sub(p1, p0)
    flat = sub(w, scale(axis, dot(w, axis)))
    s = dot(cross(flat, n1), axis) / F.nullif(dot(cross(n0, n1), axis), F.lit(0.0))
    return axis, add(p0, scale(n0, s)), F.abs(s)
