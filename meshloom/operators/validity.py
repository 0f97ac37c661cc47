"""Predicates and limits: scale tolerances, locked vertices, and what makes a cylinder, a plane or a hole a valid feature."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meshloom.functions.geometry import add, dot, line_distance, norm, scale, sub, triangle_normal, vec
from meshloom.operators.topology import bounds, corners

#: Lengths at a diagonal of 140, which scale with it: fixed values.
REFERENCE_DIAGONAL = 140.0
LENGTHS = {"crease": 0.20, "feature": 0.35, "interior": 1.20, "inward": 0.08, "datum": 0.05}


def scale_tolerances(vertex: DataFrame) -> DataFrame:
    """(mesh_id, diagonal, ratio, crease, feature, interior, inward, datum, min_z, max_z): lengths for a mesh of its size."""
    b = bounds(vertex, ["mesh_id"])
    size = norm(sub(vec("max_x", "max_y", "max_z"), vec("min_x", "min_y", "min_z")))
    ratio = F.when(F.col("diagonal") > 1e-4, F.least(F.lit(100.0), F.greatest(F.lit(0.01), F.col("diagonal") / REFERENCE_DIAGONAL))).otherwise(1.0)
    out = b.withColumn("diagonal", size).withColumn("ratio", ratio)
    return out.select("mesh_id", "diagonal", "ratio", *[(F.col("ratio") * v).alias(k) for k, v in LENGTHS.items()], "min_z", "max_z")


def datum_vertices(vertex: DataFrame) -> DataFrame:
    """(mesh_id, vid): vertices on the lowest or highest plane along Z."""
    limits = scale_tolerances(vertex).select("mesh_id", "datum", "min_z", "max_z")
    z = F.col("z").cast("double")
    near = (F.abs(z - F.col("min_z")) < F.col("datum")) | (F.abs(z - F.col("max_z")) < F.col("datum"))
    return vertex.join(limits, "mesh_id").where(near).select("mesh_id", "vid")


def chamfer_vertices(facet: DataFrame) -> DataFrame:
    """(mesh_id, vid): vertices of a sloped facet (the normal's largest component from 0.45 to 0.88) and of one square to an axis (0.98)."""
    most = F.greatest(*[F.abs(c) for c in triangle_normal(*corners())])
    f = facet.select("mesh_id", F.explode(F.array("i0", "i1", "i2")).alias("vid"), most.alias("most"))
    g = f.groupBy("mesh_id", "vid").agg(F.bool_or(F.col("most").between(0.45, 0.88)).alias("slope"), F.bool_or(F.col("most") >= 0.98).alias("flat"))
    return g.where("slope AND flat").select("mesh_id", "vid")


def short_creases(facet: DataFrame, feature_deg: float = 30.0, fine_deg: float = 12.0, length: float = 0.35) -> DataFrame:
    """(mesh_id, vid): ends of two-face edges that fold by feature_deg, or by fine_deg where they are shorter than 2 * length."""
    n = triangle_normal(*corners())
    p = [F.struct(*[F.col(f"{c}{k}").cast("double").alias(c) for c in "xyz"]) for k in range(3)]
    ends = [F.struct(F.least(f"i{k}", f"i{j}").alias("a"), F.greatest(f"i{k}", f"i{j}").alias("b"), norm(tuple(p[k][c] - p[j][c] for c in "xyz")).alias("len")) for k, j in ((0, 1), (1, 2), (2, 0))]
    e = facet.select("mesh_id", F.struct("tri", *[c.alias(k) for k, c in zip(("nx", "ny", "nz"), n, strict=True)]).alias("f"), F.explode(F.array(*ends)).alias("e"))
    g = e.groupBy("mesh_id", "e.a", "e.b").agg(F.count("*").alias("n"), F.min("f").alias("p"), F.max("f").alias("q"), F.max("e.len").alias("len"))
    fold = dot(vec("p.nx", "p.ny", "p.nz"), vec("q.nx", "q.ny", "q.nz"))
    sharp = (fold < math.cos(math.radians(feature_deg))) | ((F.col("len") < 2 * length) & (fold < math.cos(math.radians(fine_deg))))
    return g.where((F.col("n") != 2) | sharp).select("mesh_id", F.explode(F.array("a", "b")).alias("vid")).distinct()


def curved_vertices(facet: DataFrame, curvature_deg: float = 20.0) -> DataFrame:
    """(mesh_id, vid): vertices around which some facet's normal turns by more than curvature_deg from their mean."""
    n = triangle_normal(*corners())
    f = facet.select("mesh_id", F.explode(F.array("i0", "i1", "i2")).alias("vid"), *[c.alias(k) for k, c in zip("xyz", n, strict=True)])
    w = Window.partitionBy("mesh_id", "vid")  # the facets around one vertex
    mean = tuple(F.avg(k).over(w) for k in "xyz")
    f = f.withColumns(dict(zip(("mx", "my", "mz"), mean, strict=True)))
    turn = dot(vec("x", "y", "z"), vec("mx", "my", "mz")) / F.greatest(norm(vec("mx", "my", "mz")), F.lit(1e-12))
    return f.groupBy("mesh_id", "vid").agg(F.min(turn).alias("least")).where(F.col("least") < math.cos(math.radians(curvature_deg))).select("mesh_id", "vid")


def boxed_vertices(vertex: DataFrame, boxes: DataFrame) -> DataFrame:
    """(mesh_id, vid): vertices in a box of their mesh (mesh_id, min_x .. max_z)."""
    b = boxes.withColumnRenamed("mesh_id", "of")
    inside = F.col("mesh_id") == F.col("of")
    for c in "xyz":
        inside &= F.col(c).between(F.col(f"min_{c}"), F.col(f"max_{c}"))
    return vertex.join(b, inside, "left_semi").select("mesh_id", "vid")


def cylinder_valid(flank_rms: Column, span_deg: Column, coverage: Column, density: Column, fillet: Column, axis: tuple[Column, Column, Column]) -> Column:
    """Whether a candidate is a cylinder: smooth flanks, and the span and coverage of a bore or the span of a fillet; one
    that follows no axis needs three quarters of a turn."""
    square = F.greatest(*[F.abs(c) for c in axis]) > 0.90
    bore = (span_deg >= 180) & (coverage >= 0.45) & (density >= 0.40)
    blend = fillet & span_deg.between(40, 140) & (density >= 0.20)
    return (flank_rms <= 0.035) & (bore | blend) & (square | (span_deg >= 270))


def pruned(inliers: DataFrame, tolerance: float = 0.35, least: int = 8) -> DataFrame:
    """inliers (mesh_id, surface_id, tri, distance, radius) within the tolerance of the radius; all, if fewer than `least` are."""
    near = F.abs(F.col("distance") - F.col("radius")) <= tolerance
    few = inliers.groupBy("mesh_id", "surface_id").agg((F.count_if(near) < least).alias("few"))
    return inliers.join(few, ["mesh_id", "surface_id"]).where(near | F.col("few")).drop("few")


def minor_planes(inliers: DataFrame) -> DataFrame:
    """(mesh_id, surface_id, n, compactness, rms_deg, max_deg, mean_distance, valid): planes (nx..nz, ox..oz) judged by their
    facets (cx..cz, fx..fz, area), one row an inlier."""
    off = dot(vec("fx", "fy", "fz"), vec("nx", "ny", "nz"))
    turn = F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), off))))
    away = F.abs(dot(sub(vec("cx", "cy", "cz"), vec("ox", "oy", "oz")), vec("nx", "ny", "nz")))
    spread = sum(((F.max(c) - F.min(c)) * (F.max(c) - F.min(c)) for c in ("cx", "cy", "cz")), F.lit(0.0))
    g = inliers.groupBy("mesh_id", "surface_id").agg(
        F.count("*").alias("n"), (F.sum("area") / F.greatest(F.lit(1e-4), spread)).alias("compactness"),
        F.sqrt(F.avg(turn * turn)).alias("rms_deg"), F.max(turn).alias("max_deg"), F.avg(away).alias("mean_distance"),
    )
    valid = (F.col("n") >= 3) & (F.col("compactness") >= 0.015) & (F.col("max_deg") <= 1.0) & (F.col("rms_deg") <= 0.6) & (F.col("mean_distance") <= 0.02)
    return g.withColumn("valid", valid)


def valid_holes(holes: DataFrame, bound: DataFrame, planes: DataFrame) -> DataFrame:
    """holes (mesh_id, id, x..z, ax..az, diameter, depth) that can be: along an axis or a plane's normal (or deep and wide),
    begun in the mesh's bounds, no deeper than what they go through, and of a sound size. planes: mesh_id, nx, ny, nz."""
    h = holes.join(bound, "mesh_id")
    a = vec("ax", "ay", "az")
    p = planes.select(F.col("mesh_id").alias("of"), "nx", "ny", "nz")
    faced = h.join(p, (F.col("mesh_id") == F.col("of")) & (F.abs(dot(a, vec("nx", "ny", "nz"))) >= 0.80), "left_semi").select("mesh_id", "id").withColumn("faced", F.lit(True))
    h = h.join(faced, ["mesh_id", "id"], "left")
    size = [F.col(f"max_{c}") - F.col(f"min_{c}") for c in "xyz"]
    square = F.greatest(*[F.abs(c) for c in a]) >= 0.80
    inside = F.lit(True)
    for c in "xyz":
        inside &= F.col(c).between(F.col(f"min_{c}") - 2.0, F.col(f"max_{c}") + 2.0)
    through = sum((F.abs(c) * s for c, s in zip(a, size, strict=True)), F.lit(0.0))
    sound = (square | F.coalesce("faced", F.lit(False)) | ((F.col("depth") >= 2.0) & (F.col("diameter") >= 1.0))) & inside
    sound &= (F.col("depth") <= 1.35 * through) & (F.col("depth") >= 0.8) & F.col("diameter").between(0.5, 0.95 * F.greatest(*size))
    return h.where(sound).select(*holes.columns)


def free_of_hinges(cylinders: DataFrame, hinges: DataFrame, far: float = 3.5, least: float = 0.9) -> DataFrame:
    """cylinders (mesh_id, id, x..z, ax..az) that are no part of a hinge (mesh_id, socket, pin, hx..hz, dx..dz): neither named
    by one nor within `far` of its axis and along it. Few hinges a mesh, so the join is on the mesh."""
    h = hinges.select(F.col("mesh_id").alias("of"), "socket", "pin", "hx", "hy", "hz", "dx", "dy", "dz")
    d, axis = vec("dx", "dy", "dz"), vec("ax", "ay", "az")
    on = (line_distance(vec("x", "y", "z"), vec("hx", "hy", "hz"), d) <= far) & (F.abs(dot(d, axis)) > least)
    return cylinders.join(h, (F.col("mesh_id") == F.col("of")) & ((F.col("id") == F.col("socket")) | (F.col("id") == F.col("pin")) | on), "left_anti")


def collapse_allowed(before: tuple, after: tuple, least_dot: float = 0.5, most_move: float = 0.08, least_height: float = 0.02) -> Column:
    """Whether a facet may go from the corners `before` to `after`: no flip, no far move of its centroid, no sliver."""
    n0, n1 = triangle_normal(*before), triangle_normal(*after)
    middle = lambda t: scale(add(add(t[0], t[1]), t[2]), 1.0 / 3.0)
    sides = [norm(sub(after[k], after[(k + 1) % 3])) for k in range(3)]
    longest = F.greatest(*sides)
    s = (sides[0] + sides[1] + sides[2]) / 2.0
    area = F.sqrt(F.greatest(F.lit(0.0), s * (s - sides[0]) * (s - sides[1]) * (s - sides[2])))
    moved = F.abs(dot(sub(middle(after), middle(before)), n0))
    return (dot(n0, n1) >= least_dot) & (moved <= most_move) & (area > 1e-12) & (2.0 * area / longest >= least_height * longest)


def strip_statistics(strips: DataFrame, keys: list[str], least_rad: float = 0.01, most_rad: float = 0.9) -> DataFrame:
    """(keys, n, mean_width, cv_width, mean_theta, cv_theta, lawful): chains of strips (width, theta, the last theta null)
    whose widths vary by less than 6 % and whose angles by less than 9 % of their means are arcs cut in equal steps."""
    cv = lambda c: F.when(F.avg(c) > 1e-9, F.stddev_pop(c) / F.avg(c)).otherwise(1.0)
    g = strips.groupBy(*keys).agg(F.count("width").alias("n"), F.avg("width").alias("mean_width"), cv("width").alias("cv_width"), F.avg("theta").alias("mean_theta"), cv("theta").alias("cv_theta"), F.count("theta").alias("m"))
    lawful = (F.col("n") >= 2) & (F.col("m") == F.col("n") - 1) & (F.col("cv_width") < 0.06) & (F.col("cv_theta") < 0.09) & F.col("mean_theta").between(least_rad, most_rad)
    return g.withColumn("lawful", F.coalesce(lawful, F.lit(False))).drop("m")


def arc_radius(chord: Column, theta: Column) -> Column:
    """The radius of the arc that a chord cuts off at an angle, null where either is too small."""
    return F.when((chord > 1e-7) & (F.sin(theta / 2) >= 1e-9), chord / (2 * F.sin(theta / 2)))


def arc_volume(radius: Column, theta: Column, steps: Column, height: Column) -> Column:
    """What chords leave out of an arc of `steps` steps, times its height."""
    return radius * radius / 2 * (theta - F.sin(theta)) * steps * height


def volume_budget(volumes: DataFrame, arcs: DataFrame) -> DataFrame:
    """(mesh_id, predicted, residual, allowed, accepted): volumes (mesh_id, mesh_volume, solid_volume) against what their arcs
    (mesh_id, radius, theta, steps, height, additive) explain."""
    v = arc_volume(F.col("radius"), F.col("theta"), F.col("steps"), F.col("height"))
    per = arcs.groupBy("mesh_id").agg(F.sum(F.when(F.col("additive"), v).otherwise(-v)).alias("predicted"), F.sum(v).alias("whole"))
    r = volumes.join(per, "mesh_id", "left").na.fill(0.0, ["predicted", "whole"])
    r = r.withColumn("residual", F.abs(F.col("solid_volume") - F.col("mesh_volume") - F.col("predicted"))).withColumn("allowed", F.greatest(F.abs("mesh_volume") * 1e-4, F.col("whole") * 3.0 + 1e-3))
    return r.select("mesh_id", "predicted", "residual", "allowed", (F.col("residual") <= F.col("allowed")).alias("accepted"))


def profile_areas(segments: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, area): signed areas of loops of segments (x0, y0, x1, y1, radius, span, clockwise; radius null for a line): chords
    plus what arcs add or take."""
    arc = F.coalesce(F.col("radius") * F.col("radius") / 2 * (F.abs("span") - F.sin(F.abs("span"))), F.lit(0.0))
    chord = (F.col("x0") * F.col("y1") - F.col("x1") * F.col("y0")) / 2
    return segments.groupBy(*keys).agg(F.sum(chord + F.when(F.col("clockwise"), -arc).otherwise(arc)).alias("area"))


def extrusion_volumes(areas: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, volume): an outer loop's area less its holes', times the height. areas: keys, area, is_hole, height."""
    a = F.abs("area")
    net = F.sum(F.when(F.col("is_hole"), -a).otherwise(a))
    return areas.groupBy(*keys).agg((F.greatest(F.lit(0.0), net) * F.greatest(F.lit(0.0), F.max("height"))).alias("volume"))


def regularized_solution(a: list[list[Column]], b: list[Column], ridge: float = 1e-4) -> tuple[Column, Column, Column]:
    """x of (A + ridge * mean trace * I) x = b, A symmetric 3x3, by cofactors."""
    lift = (a[0][0] + a[1][1] + a[2][2]) / 3.0 * ridge
    m = [[a[i][j] + lift if i == j else a[i][j] for j in range(3)] for i in range(3)]
    minor = lambda i, j: m[(i + 1) % 3][(j + 1) % 3] * m[(i + 2) % 3][(j + 2) % 3] - m[(i + 1) % 3][(j + 2) % 3] * m[(i + 2) % 3][(j + 1) % 3]
    det = m[0][0] * minor(0, 0) + m[0][1] * minor(0, 1) + m[0][2] * minor(0, 2)
    return tuple(F.try_divide(sum((minor(j, i) * b[j] for j in range(3)), F.lit(0.0)), det) for i in range(3))


def sorted_sides(*sides: Column) -> Column:
    """Sides from the least to the greatest."""
    return F.array_sort(F.array(*sides))


def odd_faces(faces: DataFrame, box: DataFrame, margin: float = 0.5) -> DataFrame:
    """faces (file_id, face_id, area, cx..cz) of no area, or whose centre lies outside the file's box by the margin, with `why`."""
    outside = F.lit(False)
    for c in "xyz":
        outside |= ~F.col(f"c{c}").between(F.col(f"min_{c}") - margin, F.col(f"max_{c}") + margin)
    why = F.when(F.col("area") < 1e-10, "no area").when(outside, "outside")
    return faces.join(box, "file_id").withColumn("why", why).where("why IS NOT NULL").select(*faces.columns, "why")


def bore_spanners(faces: DataFrame, bores: DataFrame, share: float = 0.70) -> DataFrame:
    """(file_id, face_id, bore_id): faces whose centre lies inside a bore (file_id, bore_id, x, y, radius, lo, hi; along Z). Bores
    are few a file, so the join is on the file."""
    f, b = faces.alias("f"), bores.alias("b")
    near = F.sqrt((F.col("f.cx") - F.col("b.x")) * (F.col("f.cx") - F.col("b.x")) + (F.col("f.cy") - F.col("b.y")) * (F.col("f.cy") - F.col("b.y"))) < share * F.col("b.radius")
    return f.join(b, (F.col("f.file_id") == F.col("b.file_id")) & near & F.col("f.cz").between(F.col("b.lo"), F.col("b.hi"))).select("f.file_id", "face_id", "bore_id")
