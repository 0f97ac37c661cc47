"""Plane polygons as tables of vertices (keys, loop_id, ord, x, y): area, containment, simplicity, and points near triangles."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf


def sides(loops: DataFrame, keys: list[str]) -> DataFrame:
    """Each loop's directed sides (x, y) to (x2, y2), closing it."""
    w = Window.partitionBy(*keys, "loop_id").orderBy("ord")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return loops.select(*keys, "loop_id", "ord", "x", "y", *[F.coalesce(F.lead(c).over(w), F.first(c).over(whole)).alias(f"{c}2") for c in "xy"])


def areas(loops: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, loop_id, area, min_x, max_x, min_y, max_y): signed shoelace area and bounds."""
    s = sides(loops, keys)
    return s.groupBy(*keys, "loop_id").agg((F.sum(F.expr("x * y2 - x2 * y")) / 2.0).alias("area"), F.min("x").alias("min_x"), F.max("x").alias("max_x"), F.min("y").alias("min_y"), F.max("y").alias("max_y"))


def containing(points: DataFrame, loops: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, point_id, loop_id) of each loop that a point (keys, point_id, px, py) lies in, by the parity of sides crossed.

    Bounds join first, so only loops whose box holds the point count their sides."""
    box = areas(loops, keys).select(*keys, "loop_id", "min_x", "max_x", "min_y", "max_y")
    near = points.join(box, keys).where("px BETWEEN min_x AND max_x AND py BETWEEN min_y AND max_y").select(*keys, "point_id", "px", "py", "loop_id")
    cross = F.expr("(y > py) <> (y2 > py) AND px < (x2 - x) * (py - y) / nullif(y2 - y, 0e0) + x")
    return near.join(sides(loops, keys), [*keys, "loop_id"]).groupBy(*keys, "point_id", "loop_id").agg(F.count_if(cross).alias("n")).where("n % 2 = 1").select(*keys, "point_id", "loop_id")


def forest(loops: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, loop_id, parent, depth): the least loop around each, and how many there are. A loop is around another if it
    holds its first vertex and is larger; loops do not cross."""
    a = areas(loops, keys).select(*keys, "loop_id", F.abs("area").alias("area"))
    first = loops.groupBy(*keys, "loop_id").agg(F.min(F.struct("ord", "x", "y")).alias("p")).select(*keys, F.col("loop_id").alias("point_id"), F.col("p.x").alias("px"), F.col("p.y").alias("py"))
    held = containing(first, loops, keys).where("point_id <> loop_id")
    sized = held.join(a, [*keys, "loop_id"]).join(a.withColumnRenamed("loop_id", "point_id").withColumnRenamed("area", "own"), [*keys, "point_id"]).where("area > own")
    up = sized.groupBy(*keys, "point_id").agg(F.min(F.struct("area", "loop_id"))["loop_id"].alias("parent"), F.count("*").alias("depth"))
    return a.join(up.withColumnRenamed("point_id", "loop_id"), [*keys, "loop_id"], "left").select(*keys, "loop_id", "parent", F.coalesce("depth", F.lit(0)).alias("depth"))


def crossings(loops: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, loop_id, n): pairs of a loop's sides that properly cross; none for a simple loop."""
    s = sides(loops, keys)
    a, b = s.alias("a"), s.alias("b")
    turn = lambda p, q, r: f"sign(({q[0]} - {p[0]}) * ({r[1]} - {p[1]}) - ({q[1]} - {p[1]}) * ({r[0]} - {p[0]}))"
    p, q, r, t = (("a.x", "a.y"), ("a.x2", "a.y2"), ("b.x", "b.y"), ("b.x2", "b.y2"))
    on = F.expr("a.ord < b.ord AND least(a.x, a.x2) <= greatest(b.x, b.x2) AND least(b.x, b.x2) <= greatest(a.x, a.x2)")
    for k in [*keys, "loop_id"]:
        on = on & (F.col(f"a.{k}") == F.col(f"b.{k}"))
    hit = F.expr(f"{turn(p, q, r)} * {turn(p, q, t)} < 0 AND {turn(r, t, p)} * {turn(r, t, q)} < 0")
    found = a.join(b, on).where(hit).groupBy(*[F.col(f"a.{k}").alias(k) for k in [*keys, "loop_id"]]).agg(F.count("*").alias("n"))
    return loops.select(*keys, "loop_id").distinct().join(found, [*keys, "loop_id"], "left").na.fill(0, ["n"])


def straightened(loops: DataFrame, keys: list[str], slack: float = 1e-9) -> DataFrame:
    """Loops without the vertices that lie on the line through both neighbours. (outlines.thinned_loops() holds each vertex
    against the last one kept, which a slowly bending run needs.)"""
    w = Window.partitionBy(*keys, "loop_id").orderBy("ord")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    near = loops.select("*", *[F.coalesce(F.lag(c).over(w), F.last(c).over(whole)).alias(f"{c}0") for c in "xy"], *[F.coalesce(F.lead(c).over(w), F.first(c).over(whole)).alias(f"{c}2") for c in "xy"])
    return near.where(F.abs(F.expr("(x - x0) * (y2 - y0) - (y - y0) * (x2 - x0)")) > slack).drop("x0", "y0", "x2", "y2")


def triangle_distances(p: np.ndarray, t: np.ndarray) -> np.ndarray:
    """Distances of points (n, 3) from triangles (n, 3, 3): inside the prism to the plane, else to the nearest side."""
    a, b, c = t[:, 0], t[:, 1], t[:, 2]
    n = np.cross(b - a, c - a)
    size = np.linalg.norm(n, axis=1)
    best = np.full(len(p), np.inf)
    inside = size > 1e-18
    for u, v in ((a, b), (b, c), (c, a)):
        d = v - u
        k = np.clip(((p - u) * d).sum(axis=1) / np.maximum((d * d).sum(axis=1), 1e-30), 0, 1)
        best = np.minimum(best, np.linalg.norm(p - u - k[:, None] * d, axis=1))
        inside &= (np.cross(d, p - u) * n).sum(axis=1) >= 0
    flat = np.abs(((p - a) * n).sum(axis=1)) / np.maximum(size, 1e-30)
    return np.where(inside, flat, best)


def _distances(point: pd.DataFrame, triangle: pd.DataFrame) -> pd.Series:
    return pd.Series(triangle_distances(point.to_numpy(float), triangle.to_numpy(float).reshape(-1, 3, 3)))


def triangle_distance(point: Column, triangle: Column) -> Column:
    """Of structs (x, y, z) and (x0 .. z2), by Arrow batches."""
    return pandas_udf(_distances, "double")(point, triangle)


def material_spec(text: str) -> Iterator[tuple[str, str, int, str]]:
    """(scope, key, ord, material) rules of a specification: `auto` has none, one name is for all, a list goes by
    position, `3=name` by index, `role=name` by role. Empty positions and rules are skipped."""
    parts = [p.strip() for p in text.split(",")]
    if text.strip().lower() in ("", "auto"):
        return
    for i, p in enumerate(parts):
        key, eq, name = (x.strip() for x in p.partition("="))
        if eq and key and name:
            yield ("index" if key.isdigit() else "role", key, i, name)
        elif not eq and key:
            yield ("all", "", i, key) if len(parts) == 1 else ("index", str(i), i, key)


def chordal_bias(cylinders: DataFrame) -> DataFrame:
    """(mesh_id, volume): what a mesh's cylinders (mesh_id, radius, area, is_internal, n_tri) lose or gain by their chords:
    per cylinder the area of its facets times two thirds of the sagitta, bores negative."""
    n = F.greatest(F.lit(8.0), F.least(F.lit(128.0), F.floor(F.col("n_tri") / 2.0 + 0.5)))
    sagitta = F.col("radius") * (1 - F.cos(F.lit(np.pi) / n))
    return cylinders.groupBy("mesh_id").agg(F.sum(F.when(F.col("is_internal"), -1.0).otherwise(1.0) * F.col("area") * sagitta * (2.0 / 3.0)).alias("volume"))
