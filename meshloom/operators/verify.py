"""Verification: area-weighted samples, residuals against fitted surfaces, and five gates."""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meshloom.functions.geometry import cylinder_distance, halton, plane_distance, triangle_area, vec
from meshloom.operators.polygons import triangle_distances
from meshloom.operators.spatial import order_statistic
from meshloom.operators.topology import corners


def samples(facet: DataFrame, n: int = 3000) -> DataFrame:
    """(mesh_id, sample, tri, x, y, z): n points a mesh, spread by area: a Halton number (base 2) picks the facet by the running
    share of area, two more (bases 3 and 5) the place in it. Areas run in whole 1e-9, so that the sums are exact.
    A sample finds its facet by the last running sum below it: facets and samples in one order, no range join."""
    a, b, c = corners()
    order = Window.partitionBy("mesh_id").orderBy("tri").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    w = facet.withColumn("w", F.floor(triangle_area(a, b, c) * 1e9 + 0.5).cast("long")).withColumn("hi", F.sum("w").over(order)).withColumn("at", F.col("hi") - F.col("w")).where("w > 0")
    total = w.groupBy("mesh_id").agg(F.max("hi").alias("total"))
    s = total.select("mesh_id", "total", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(n).cast("long"))).alias("id")).select("mesh_id", F.col("id").alias("sample"), F.floor(halton(F.col("id"), 2) * F.col("total")).cast("long").alias("at"))
    pt = [f"{k}{j}" for j in range(3) for k in "xyz"]
    both = w.select("mesh_id", "at", F.lit(0).alias("kind"), F.struct("tri", *pt).alias("f"), F.lit(None).cast("long").alias("sample")).unionByName(s.select("mesh_id", "at", F.lit(1).alias("kind"), F.lit(None).alias("f"), "sample"), allowMissingColumns=True)
    last = Window.partitionBy("mesh_id").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    met = both.withColumn("f", F.last("f", ignorenulls=True).over(last)).where("sample IS NOT NULL").select("mesh_id", "sample", "f.*")
    u, v = F.sqrt(halton(F.col("sample"), 3)), halton(F.col("sample"), 5)
    bary = (1 - u, u * (1 - v), u * v)
    return met.select("mesh_id", "sample", "tri", *[sum((bary[j] * F.col(f"{k}{j}").cast("double") for j in range(3)), F.lit(0.0)).alias(k) for k in "xyz"])


def reduced(facet: DataFrame, k: int = 3000, beyond: int = 50_000) -> DataFrame:
    """(mesh_id, tri, why): the facets that stand for a mesh: all of one that has no more than `beyond`; else up to k/4 large ones
    (whose squared double area is 16 times the mean or more, in order of tri), and further ones that Halton numbers (base 3)
    pick by place, k in all. Places come from running counts; picks that fall on a facet again are left out and made up for
    by later ones."""
    a, b, c = corners()
    order = Window.partitionBy("mesh_id").orderBy("tri")  # the facets of one mesh
    f = facet.select("mesh_id", "tri", (2 * triangle_area(a, b, c)).alias("d")).withColumn("d", F.col("d") * F.col("d"))
    n = f.groupBy("mesh_id").agg(F.count("*").alias("n"), F.avg("d").alias("mean"))
    few, many = n.where(F.col("n") <= max(beyond, k)), n.where(F.col("n") > max(beyond, k))
    placed = f.join(many, "mesh_id").withColumn("place", F.row_number().over(order) - 1)
    large = placed.where((F.col("d") >= 16 * F.col("mean")) & (F.col("mean") > 0)).withColumn("r", F.row_number().over(order)).where(F.col("r") <= k // 4)
    picks = many.select("mesh_id", "n", F.explode(F.sequence(F.lit(1), F.lit(4 * k))).alias("s"))
    picks = picks.withColumn("place", F.least(F.col("n") - 1, F.floor(halton(F.col("s"), 3) * F.col("n"))).cast("int")).groupBy("mesh_id", "place").agg(F.min("s").alias("s"))
    rest = placed.join(picks, ["mesh_id", "place"]).join(large.select("mesh_id", "tri"), ["mesh_id", "tri"], "left_anti")
    held = large.groupBy("mesh_id").agg(F.count("*").alias("held"))
    rest = rest.join(held, "mesh_id", "left").withColumn("r", F.row_number().over(Window.partitionBy("mesh_id").orderBy("s"))).where(F.col("r") <= k - F.coalesce("held", F.lit(0)))
    whole = f.join(few, "mesh_id").select("mesh_id", "tri", F.lit("all").alias("why"))
    return whole.unionByName(large.select("mesh_id", "tri", F.lit("large").alias("why"))).unionByName(rest.select("mesh_id", "tri", F.lit("picked").alias("why")))


def residuals(sample: DataFrame, surfaces: DataFrame, inliers: DataFrame) -> DataFrame:
    """sample with its distance to its facet's surface: the plane or cylinder; 0 for a facet of no such surface.

    surfaces (mesh_id, surface_id, type, x, y, z, ax, ay, az, radius, height); inliers (mesh_id, surface_id, tri)."""
    s = sample.join(inliers, ["mesh_id", "tri"], "left").join(surfaces.select("mesh_id", "surface_id", "type", *[F.col(c).alias(f"s_{c}") for c in ("x", "y", "z", "ax", "ay", "az", "radius", "height")]), ["mesh_id", "surface_id"], "left")
    p, o, n = vec("x", "y", "z"), vec("s_x", "s_y", "s_z"), vec("s_ax", "s_ay", "s_az")
    d = F.when(F.col("type") == "plane", plane_distance(p, o, n)).when(F.col("type") == "cylinder", cylinder_distance(p, o, n, F.col("s_radius"), F.col("s_height"))).otherwise(0.0)
    return s.select("mesh_id", "sample", "tri", "surface_id", d.cast("float").cast("double").alias("residual"))


_SURFACE = ["x", "y", "z", "ax", "ay", "az", "radius", "height"]
_CORNERS = [f"{c}{k}" for k in range(3) for c in "xyz"]


def _to_surface(p: np.ndarray, kind: np.ndarray, s: np.ndarray) -> np.ndarray:
    """Distances of points (n, 3) from surfaces (k), as (n, k); infinite from one that is no plane or cylinder."""
    w = p[:, None] - s[None, :, :3]
    t = (w * s[:, 3:6]).sum(axis=2)
    r = np.linalg.norm(w - t[..., None] * s[:, 3:6], axis=2)
    wall = np.hypot(r - s[:, 6], np.maximum(np.maximum(-t, t - s[:, 7]), 0))
    return np.where(kind == "plane", np.abs(t), np.where(kind == "cylinder", wall, np.inf))


def _across(point: pd.DataFrame, facet: pd.DataFrame) -> pd.DataFrame:
    p, t = point[["x", "y", "z"]].to_numpy(float), facet[_CORNERS].to_numpy(float).reshape(-1, 3, 3)
    kind, s = facet["type"].to_numpy(object), facet[[f"s_{c}" for c in _SURFACE]].to_numpy(float)
    out = np.zeros(len(p))
    if len(t) and len(p):
        low, high = t.min(axis=1), t.max(axis=1)
        diagonal = max(1e-3, float(np.linalg.norm(high.max(axis=0) - low.min(axis=0))))
        size = max(diagonal * 1e-4, diagonal / min(32.0, max(8.0, float(np.cbrt(max(64, len(t)))))))
        grid: dict[tuple, list[int]] = {}
        first, last = np.floor((low - size / 4) / size).astype(int), np.floor((high + size / 4) / size).astype(int)
        for k, (a, b) in enumerate(zip(first.tolist(), last.tolist(), strict=True)):
            for c in itertools.product(*[range(i, j + 1) for i, j in zip(a, b, strict=True)]):
                grid.setdefault(c, []).append(k)
        cells, which = np.unique(np.floor(p / size).astype(int), axis=0, return_inverse=True)
        surface = np.unique(facet["surface_id"].to_numpy(float), return_index=True)[1]
        order, which = np.argsort(which.ravel(), kind="stable"), which.ravel()
        bounds = np.searchsorted(which[order], np.arange(len(cells) + 1))
        for i, c in enumerate(cells.tolist()):
            near: set[int] = set()
            for ring in range(3):
                for d in itertools.product(range(-ring, ring + 1), repeat=3):
                    if max(map(abs, d)) == ring:
                        near.update(grid.get((c[0] + d[0], c[1] + d[1], c[2] + d[2]), ()))
                if near:
                    break
            rows = order[bounds[i] : bounds[i + 1]]
            on = np.array(sorted(near), int) if near else surface
            best = _to_surface(p[rows], kind[on], s[on]).min(axis=1)
            if near:
                for k in on.tolist():
                    best = np.minimum(best, triangle_distances(p[rows], np.broadcast_to(t[k], (len(rows), 3, 3))))
            out[rows] = np.where(np.isfinite(best), best, 0.0)
    return pd.DataFrame({"mesh_id": point["mesh_id"], "sample": point["sample"], "residual": out.astype(np.float32).astype(float)})


def cross_residuals(sample: DataFrame, facet: DataFrame, surfaces: DataFrame, inliers: DataFrame) -> DataFrame:
    """(mesh_id, sample, residual): samples of one mesh against another of the same mesh_id, the least distance to the
    facets (and their planes and cylinders) of the first of three rings of cells that holds any; beyond these, to any
    of the surfaces; 0 where there is none. surfaces and inliers as for residuals(), of the other mesh."""
    s = surfaces.select("mesh_id", "surface_id", "type", *[F.col(c).alias(f"s_{c}") for c in _SURFACE])
    f = facet.join(inliers, ["mesh_id", "tri"], "left").join(s, ["mesh_id", "surface_id"], "left").select("mesh_id", "surface_id", "type", *_CORNERS, *[f"s_{c}" for c in _SURFACE])
    return sample.select(F.col("mesh_id").alias("mesh_id"), "sample", "x", "y", "z").groupBy("mesh_id").cogroup(f.groupBy("mesh_id")).applyInPandas(_across, "mesh_id string, sample long, residual double")


def deviations(residual: DataFrame) -> DataFrame:
    """(mesh_id, h99, hmax, rmse): the value at place floor(0.99 n), the greatest, and the root mean square."""
    o = order_statistic(residual, ["mesh_id"], "residual").select("mesh_id", F.col("stat").alias("h99"), F.col("greatest").alias("hmax"))
    r = residual.groupBy("mesh_id").agg(F.sqrt(F.avg(F.col("residual") * F.col("residual"))).alias("rmse"))
    return o.join(r, "mesh_id")


def gates(analysis: DataFrame, coverage: DataFrame, joints: DataFrame, deviation: DataFrame, volumes: DataFrame | None = None, terms: DataFrame | None = None, spanners: DataFrame | None = None) -> DataFrame:
    """(mesh_id, no, gate, status): intake, surface coverage, joint clearance, solid topology, deviation; passed, warning or failed.

    coverage (mesh_id, covered, n); joints (mesh_id, gap); volumes (mesh_id, other): a second volume to hold the mesh's against;
    terms (mesh_id, curvature, tolerance, threads): the mean curvature ratio, the tolerance asked for and the threads found,
    which widen the limits of deviation; spanners (mesh_id): one row for each face that spans a bore."""
    a = analysis.join(coverage, "mesh_id", "left").join(joints.groupBy("mesh_id").agg(F.min("gap").alias("clearance")), "mesh_id", "left").join(deviation, "mesh_id", "left")
    a = a.join(volumes, "mesh_id", "left") if volumes is not None else a.withColumn("other", F.lit(None).cast("double"))
    a = a.join(terms, "mesh_id", "left") if terms is not None else a.withColumns({"curvature": F.lit(0.0), "tolerance": F.lit(0.0), "threads": F.lit(0)})
    a = a.join(spanners.groupBy("mesh_id").agg(F.count("*").alias("spanners")), "mesh_id", "left") if spanners is not None else a.withColumn("spanners", F.lit(0))
    a = a.na.fill({"curvature": 0.0, "tolerance": 0.0, "threads": 0, "spanners": 0})
    closed = (F.col("open_edges") == 0) & (F.col("non_manifold_edges") == 0)
    sound = closed & (F.col("n_degenerate") == 0) & (F.col("chi") % 2 == 0) & (F.col("chi") <= 2 * F.col("n_shells"))
    share = F.col("covered") / F.col("n")
    clear = F.coalesce("clearance", F.lit(0.35))
    drift = F.coalesce(F.abs(F.col("other") - F.col("volume")) / F.greatest(F.abs("volume"), F.lit(1e-9)), F.lit(0.0))
    h99, hmax = F.coalesce("h99", F.lit(0.0)), F.coalesce("hmax", F.lit(0.0))
    threaded = F.col("threads") > 0
    most99 = F.greatest(F.lit(0.20), 0.10 + 0.5 * F.col("curvature"), F.when(threaded, 4.0).otherwise(0.0))
    most = F.greatest(F.lit(1.2), 3.0 * F.col("tolerance"), F.when(threaded, 8.0).otherwise(0.0))
    each = [
        ("intake", F.when(sound, "passed").when(F.col("open_edges") < 5, F.when(F.col("non_manifold_edges") == 0, "warning").otherwise("failed")).otherwise("failed")),
        ("segmentation", F.when(share >= 0.97, "passed").when(share >= 0.85, "warning").otherwise("failed")),
        ("kinematics", F.when(clear < 0.05, "failed").when(clear < 0.10, "warning").otherwise("passed")),
        ("solid", F.when(closed & (F.col("inverted_edges") == 0) & (F.col("spanners") == 0), "passed").otherwise("failed")),
        ("differential", F.when((hmax > most) | (drift > 0.05), "failed").when((h99 > most99) | (drift > 0.005), "warning").otherwise("passed")),
    ]
    rows = F.array(*[F.struct(F.lit(i).alias("no"), F.lit(g).alias("gate"), s.alias("status")) for i, (g, s) in enumerate(each)])
    return a.select("mesh_id", F.explode(rows).alias("r")).select("mesh_id", "r.*")


def rollup(gate: DataFrame, keys: list[str]) -> DataFrame:
    """FAILED if any gate failed, else WARNING if any warned, else PASSED; with counts."""
    failed, warned = F.count_if(F.col("status") == "failed"), F.count_if(F.col("status") == "warning")
    status = F.when(failed > 0, "FAILED").when(warned > 0, "WARNING").otherwise("PASSED")
    return gate.groupBy(*keys).agg(status.alias("status"), failed.alias("failed"), warned.alias("warned"), F.count("*").alias("gates"))
