"""Outlines of plane regions: clusters of coplanar facets, their boundary loops with holes, simplicity, and arcs in profiles.

Tracing follows one region's boundary vertex by vertex, so a mesh is one kernel's work; what can be asked of all vertices at
once is windows and sums.
"""

from __future__ import annotations

import math
from collections import deque

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meshloom.operators.kernels import CORNERS, Faces, circle, frame, grouped



def segments_meet(a: tuple[Column, Column], b: tuple[Column, Column], c: tuple[Column, Column], d: tuple[Column, Column], slack: float = 1e-9) -> Column:
    """Whether segments ab and cd have a point in common: they cross, touch, or overlap on one line."""
    side = lambda p, q, r: (q[0] - p[0]) * (r[1] - p[1]) - (q[1] - p[1]) * (r[0] - p[0])
    sign = lambda x: F.when(F.abs(x) <= slack, 0).otherwise(F.signum(x))
    within = lambda p, q, r: F.least(p[0], q[0]).__le__(r[0] + slack) & (r[0] <= F.greatest(p[0], q[0]) + slack) & (F.least(p[1], q[1]) <= r[1] + slack) & (r[1] <= F.greatest(p[1], q[1]) + slack)
    s = [sign(side(a, b, c)), sign(side(a, b, d)), sign(side(c, d, a)), sign(side(c, d, b))]
    touch = ((s[0] == 0) & within(a, b, c)) | ((s[1] == 0) & within(a, b, d)) | ((s[2] == 0) & within(c, d, a)) | ((s[3] == 0) & within(c, d, b))
    return ((s[0] * s[1] < 0) & (s[2] * s[3] < 0)) | touch


def simple(loops: DataFrame, keys: list[str], least: float = 1e-6, hairpin: float = 0.999) -> DataFrame:
    """(keys, loop_id, simple, why): loops (keys, loop_id, ord, x, y) of three vertices and more, without sides shorter than
    `least`, without hairpins (a turn back whose cosine is below -hairpin), and without sides that meet but for neighbours."""
    from meshloom.operators.polygons import sides

    id_ = [*keys, "loop_id"]
    s = sides(loops, keys).withColumn("n", F.count("*").over(Window.partitionBy(*id_))).withColumn("k", F.row_number().over(Window.partitionBy(*id_).orderBy("ord")))  # one loop
    w = Window.partitionBy(*id_).orderBy("ord")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    dx, dy = F.col("x2") - F.col("x"), F.col("y2") - F.col("y")
    s = s.withColumns({"dx": dx, "dy": dy}).withColumns({f"next_{c}": F.coalesce(F.lead(c).over(w), F.first(c).over(whole)) for c in ("dx", "dy")})
    size, after = F.sqrt(F.expr("dx * dx + dy * dy")), F.sqrt(F.expr("next_dx * next_dx + next_dy * next_dy"))
    turned = F.expr("dx * next_dx + dy * next_dy") < -hairpin * size * after
    local = s.groupBy(*id_).agg(F.max("n").alias("n"), F.bool_or(size < least).alias("short"), F.bool_or(turned & (size >= least) & (after >= least)).alias("hairpin"))
    a, b = s.alias("a"), s.alias("b")
    on = F.col("a.k") + 1 < F.col("b.k")
    for k in id_:
        on = on & (F.col(f"a.{k}") == F.col(f"b.{k}"))
    box = F.lit(True)
    for c in "xy":
        low, high = lambda t: F.least(F.col(f"{t}.{c}"), F.col(f"{t}.{c}2")), lambda t: F.greatest(F.col(f"{t}.{c}"), F.col(f"{t}.{c}2"))  # noqa: B023, E731
        box = box & (low("a") <= high("b")) & (low("b") <= high("a"))
    ends = lambda t: ((F.col(f"{t}.x"), F.col(f"{t}.y")), (F.col(f"{t}.x2"), F.col(f"{t}.y2")))
    apart = ~((F.col("a.k") == 1) & (F.col("b.k") == F.col("b.n")))
    met = a.join(b, on & box).where(apart & segments_meet(*ends("a"), *ends("b"))).groupBy(*[F.col(f"a.{k}").alias(k) for k in id_]).agg(F.lit(True).alias("meet"))
    out = local.join(met, id_, "left")
    why = F.when(F.col("n") < 3, "few").when(F.col("short"), "short side").when(F.col("hairpin"), "hairpin").when(F.col("meet"), "crossing")
    return out.select(*id_, why.isNull().alias("simple"), why.alias("why"))


def thinned(points: Column, slack: float) -> Column:
    """An ordered array of structs (ord, x, y) without the points that lie within `slack` of the line from the last kept one to
    the next; the first and the last stay."""

    def step(kept: Column, i: Column) -> Column:
        p, q, r = F.element_at(kept, -1), F.element_at(points, i), F.element_at(points, i + 1)
        dx, dy = r["x"] - p["x"], r["y"] - p["y"]
        size = F.sqrt(dx * dx + dy * dy)
        off = F.abs((q["x"] - p["x"]) * dy - (q["y"] - p["y"]) * dx)
        along = (q["x"] - p["x"]) * dx + (q["y"] - p["y"]) * dy
        on_line = (size > 1e-9) & (off < slack * size) & (along > 0) & (along < size * size)
        return F.when(on_line, kept).otherwise(F.concat(kept, F.array(q)))

    n = F.size(points)
    inner = F.when(n > 2, F.sequence(F.lit(2), n - 1)).otherwise(F.array().cast("array<int>"))
    return F.when(n > 2, F.concat(F.aggregate(inner, F.slice(points, 1, 1), step), F.slice(points, -1, 1))).otherwise(points)


def thinned_loops(loops: DataFrame, keys: list[str], slack: float = 1e-4) -> DataFrame:
    """(keys, loop_id, ord, x, y): loops without the vertices that thinned() drops. A run that bends slowly keeps a vertex
    wherever it has left the line from the last one kept."""
    g = loops.groupBy(*keys, "loop_id").agg(F.array_sort(F.collect_list(F.struct("ord", "x", "y"))).alias("p"))
    return g.select(*keys, "loop_id", F.explode(thinned(F.col("p"), slack)).alias("p")).select(*keys, "loop_id", "p.*")


CLUSTER = "mesh_id string, cluster_id long, tri long, nx double, ny double, nz double, ox double, oy double, oz double"


def _clusters(least: float, reach: float):
    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        f = Faces(pdf)
        curved = pdf.sort_values("tri")["surface_id"].where(pdf.sort_values("tri")["curved"]).fillna(-1).to_numpy(np.int64)
        of, rows = np.full(len(f.tri), -1), []
        for seed in range(len(f.tri)):
            if of[seed] >= 0:
                continue
            of[seed], queue = seed, deque([seed])
            while queue:
                for b in f.near[queue.popleft()]:
                    if of[b] < 0 and curved[b] == curved[seed] and f.n[b] @ f.n[seed] >= least and abs((f.c[b] - f.c[seed]) @ f.n[seed]) <= reach:
                        of[b] = seed
                        queue.append(b)
        rows = np.column_stack([f.n[of], f.c[of]])
        out = pd.DataFrame(rows, columns=["nx", "ny", "nz", "ox", "oy", "oz"])
        out.insert(0, "tri", f.tri)
        out.insert(0, "cluster_id", f.tri[of])
        out.insert(0, "mesh_id", pdf["mesh_id"].iloc[0])
        return out

    return kernel


def coplanar(facet: DataFrame, surfaces: DataFrame | None = None, least: float = 0.999, reach: float = 0.012) -> DataFrame:
    """(mesh_id, cluster_id, tri, nx..nz, ox..oz): facets joined over edges while they keep to the plane of the cluster's least
    facet, in direction and distance. surfaces (mesh_id, tri, surface_id, type): facets of curved ones keep among themselves."""
    f = facet.select("mesh_id", "tri", "i0", "i1", "i2", *CORNERS)
    if surfaces is None:
        f = f.withColumns({"surface_id": F.lit(-1).cast("long"), "curved": F.lit(False)})
    else:
        f = f.join(surfaces.select("mesh_id", "tri", "surface_id", (~F.col("type").isin("plane", "freeform")).alias("curved")), ["mesh_id", "tri"], "left").na.fill({"surface_id": -1, "curved": False})
    return grouped(f, _clusters(least, reach), CLUSTER)


LOOP = "mesh_id string, cluster_id long, loop_id long, ord long, vid long, x double, y double, area double, parent long"


def _area(xy: np.ndarray) -> float:
    nxt = np.roll(xy, -1, axis=0)
    return float((xy[:, 0] * nxt[:, 1] - nxt[:, 0] * xy[:, 1]).sum() / 2)


def _holds(xy: np.ndarray, p: np.ndarray) -> bool:
    a, b = xy, np.roll(xy, -1, axis=0)
    on = (a[:, 1] > p[1]) != (b[:, 1] > p[1])
    return bool((p[0] < ((b[on, 0] - a[on, 0]) * (p[1] - a[on, 1]) / (b[on, 1] - a[on, 1]) + a[on, 0])).sum() % 2)


def trace(after: dict[int, list[int]], xy: dict[int, np.ndarray]) -> list[list[int]]:
    """Closed loops of directed boundary edges. Where several leave a vertex the walk takes the one farthest to its left; a walk
    that comes back to a vertex of its own gives up the loop that this closes and goes on with what is left."""
    left = {u: list(v) for u, v in after.items()}
    out = []
    for start in sorted(left):
        while left.get(start):
            path, at = [start], start
            while left.get(at):
                to = left[at]
                if len(to) > 1 and len(path) > 1:
                    back = xy[path[-2]] - xy[at]
                    turns = [math.atan2(*(lambda d: (back[0] * d[1] - back[1] * d[0], back @ d))(xy[v] - xy[at])) % (2 * math.pi) for v in to]
                    pick = int(np.argmin(np.where(np.array(turns) > 1e-12, turns, 7.0)))
                else:
                    pick = 0
                at = to.pop(pick)
                if at in path:
                    k = path.index(at)
                    if len(path) - k >= 3:
                        out.append(path[k:])
                    path = path[: k + 1]
                else:
                    path.append(at)
            if len(path) == 1 or not left.get(start):
                break
    return out


def _outline(slack: float):
    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for cluster, g in pdf.groupby("cluster_id", sort=True):
            n = g[["nx", "ny", "nz"]].iloc[0].to_numpy(float)
            u, v = frame(n)
            ids, pts = g[["i0", "i1", "i2"]].to_numpy(np.int64), g[CORNERS].to_numpy(float).reshape(-1, 3, 3)
            he = np.stack([ids.ravel(), np.roll(ids, -1, axis=1).ravel()], axis=1)
            seen = set(map(tuple, he.tolist()))
            after: dict[int, list[int]] = {}
            for a, b in he.tolist():
                if (b, a) not in seen:
                    after.setdefault(a, []).append(b)
            flat = dict(zip(ids.ravel().tolist(), np.column_stack([pts.reshape(-1, 3) @ u, pts.reshape(-1, 3) @ v]), strict=True))
            found = []
            for loop in trace(after, flat):
                keep = _unbent(np.array([flat[i] for i in loop]), slack)
                xy = np.array([flat[loop[k]] for k in keep])
                if len(keep) >= 3 and abs(_area(xy)) >= 1e-10:
                    found.append(([loop[k] for k in keep], xy, _area(xy)))
            outer = [k for k, f in enumerate(found) if f[2] > 0]
            for k, (loop, xy, area) in enumerate(found):
                parent = None
                if area < 0:
                    around = [o for o in outer if found[o][2] > -area and _holds(found[o][1], xy[0])]
                    parent = min(around, key=lambda o: found[o][2]) if around else None
                rows += [(cluster, k, j, vid, *xy[j], area, parent) for j, vid in enumerate(loop)]
        out = pd.DataFrame(rows, columns=[c.split()[0] for c in LOOP.split(", ")][1:])
        out["parent"] = out["parent"].astype("Int64")
        out.insert(0, "mesh_id", pdf["mesh_id"].iloc[0])
        return out

    return kernel


def _unbent(xy: np.ndarray, slack: float) -> list[int]:
    """Places of a closed loop's vertices that leave the line from the last kept one to the next."""
    keep: list[int] = []
    last, n = xy[-1], len(xy)
    for i in range(n):
        nxt = xy[keep[0]] if i == n - 1 and keep else xy[(i + 1) % n]
        d = nxt - last
        size = math.hypot(*d)
        if size < 1e-9:
            continue
        w = xy[i] - last
        if abs(w[0] * d[1] - w[1] * d[0]) < slack * size and 0 < w @ d < size * size:
            continue
        keep.append(i)
        last = xy[i]
    return keep if len(keep) >= 3 else list(range(n))


def outlines(facet: DataFrame, clusters: DataFrame, slack: float = 1e-4) -> DataFrame:
    """(mesh_id, cluster_id, loop_id, ord, vid, x, y, area, parent): the boundary of each coplanar cluster as loops in its plane,
    outer ones counter-clockwise with a positive area, holes clockwise with the least outer loop around them as parent."""
    f = facet.select("mesh_id", "tri", "i0", "i1", "i2", *CORNERS).join(clusters.where("error IS NULL").select("mesh_id", "tri", "cluster_id", "nx", "ny", "nz"), ["mesh_id", "tri"])
    return grouped(f, _outline(slack), LOOP)


def loop_metrics(loops: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, loop_id, n, cx, cy, radius, roundness): a loop's mean centre, its mean distance from there, and the least of these
    distances over the greatest."""
    id_ = [*keys, "loop_id"]
    c = loops.groupBy(*id_).agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"))
    r = F.sqrt((F.col("x") - F.col("cx")) * (F.col("x") - F.col("cx")) + (F.col("y") - F.col("cy")) * (F.col("y") - F.col("cy")))
    # centres are as many as loops, whose size Spark takes too small where they were made by explode: never broadcast
    p = loops.join(c.hint("merge"), id_).withColumn("r", r)
    return p.groupBy(*id_).agg(F.count("*").alias("n"), F.first("cx").alias("cx"), F.first("cy").alias("cy"), F.avg("r").alias("radius"), F.coalesce(F.try_divide(F.min("r"), F.max("r")), F.lit(0.0)).alias("roundness"))


def turns(loops: DataFrame, keys: list[str]) -> DataFrame:
    """loops with turn, the signed angle at each vertex, and run, the number of the run of neighbours that turn to one side."""
    id_ = [*keys, "loop_id"]
    w = Window.partitionBy(*id_).orderBy("ord")  # one loop
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    near = loops.select("*", *[F.coalesce(F.lag(c).over(w), F.last(c).over(whole)).alias(f"{c}0") for c in "xy"], *[F.coalesce(F.lead(c).over(w), F.first(c).over(whole)).alias(f"{c}2") for c in "xy"])
    cross, dot = F.expr("(x - x0) * (y2 - y) - (y - y0) * (x2 - x)"), F.expr("(x - x0) * (x2 - x) + (y - y0) * (y2 - y)")
    t = near.withColumn("turn", F.atan2(cross, dot)).drop("x0", "y0", "x2", "y2")
    t = t.withColumn("fresh", F.coalesce((F.signum("turn") != F.lag(F.signum("turn")).over(w)).cast("long"), F.lit(0)))
    return t.withColumn("run", F.sum("fresh").over(w)).drop("fresh")


def fitted_arcs(loops: DataFrame, keys: list[str], least_rad: float = 0.01, least_chain: int = 3, alike: float = 0.35) -> DataFrame:
    """(mesh_id, loop_id, arc, first, n, cx, cy, radius, span, clockwise): runs of vertices that turn to one side by like angles,
    with the circle through them. A loop is walked in order, so loops of one mesh_id are one kernel's work."""
    t = turns(loops, keys).select("mesh_id", "loop_id", "ord", "x", "y", "turn")

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for loop, g in pdf.groupby("loop_id", sort=True):
            g = g.sort_values("ord")
            xy, turn, n = g[["x", "y"]].to_numpy(float), g["turn"].to_numpy(float), len(g)
            bends = (np.abs(turn) >= least_rad) & (np.abs(turn) <= math.pi / 2)
            i, arcs = 0, 0
            while i < n:
                k = 0
                while k < n and bends[(i + k) % n] and turn[(i + k) % n] * turn[i] > 0 and abs(abs(turn[(i + k) % n]) - abs(turn[i])) <= alike * abs(turn[i]):
                    k += 1
                if k >= least_chain:
                    on = xy[np.arange(i, i + k + 1) % n]
                    c, r = circle(on)
                    rows.append((loop, arcs, int(g["ord"].iloc[i]), k, float(c[0]), float(c[1]), r, float(abs(turn[np.arange(i, i + k) % n]).sum()), bool(turn[i] < 0)))
                    arcs += 1
                i += max(k, 1)
        out = pd.DataFrame(rows, columns=["loop_id", "arc", "first", "n", "cx", "cy", "radius", "span", "clockwise"])
        out.insert(0, "mesh_id", pdf["mesh_id"].iloc[0])
        return out

    return grouped(t, kernel, "mesh_id string, loop_id long, arc long, first long, n long, cx double, cy double, radius double, span double, clockwise boolean")


def circle_sums(points: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n, cx, cy, radius): the algebraic least-squares circle of each key's points, from seven sums and a 2x2 solution; the
    radius is the root of the mean square distance. Null where the points lie on a line."""
    mean = points.groupBy(*keys).agg(F.avg("x").alias("mx"), F.avg("y").alias("my"))
    p = points.join(mean, keys).withColumns({"u": F.col("x") - F.col("mx"), "v": F.col("y") - F.col("my")})
    s = p.groupBy(*keys).agg(F.count("*").alias("n"), F.first("mx").alias("mx"), F.first("my").alias("my"), *[F.sum(F.expr(e)).alias(k) for k, e in {"uu": "u*u", "vv": "v*v", "uv": "u*v", "a": "u*(u*u+v*v)", "b": "v*(u*u+v*v)"}.items()])
    det = F.expr("uu * vv - uv * uv")
    good = F.abs(det) > 1e-12
    cu, cv = F.when(good, F.expr("(a * vv - b * uv) / 2") / det), F.when(good, F.expr("(b * uu - a * uv) / 2") / det)
    return s.select(*keys, "n", (F.col("mx") + cu).alias("cx"), (F.col("my") + cv).alias("cy"), F.sqrt(cu * cu + cv * cv + (F.col("uu") + F.col("vv")) / F.col("n")).alias("radius"))


def flooded(triangle: DataFrame, seeds: DataFrame, barrier: DataFrame, rounds: int = 64) -> DataFrame:
    """(mesh_id, seed, tri): facets reached over two-face edges from seeds (mesh_id, seed, tri) without entering barrier facets
    (mesh_id, tri), in `rounds` steps at most; a mesh's facets are one kernel's work."""
    from meshloom.operators.topology import adjacency

    near = adjacency(triangle).join(barrier.select("mesh_id", F.col("tri").alias("nbr")), ["mesh_id", "nbr"], "left_anti")
    rows = near.select("mesh_id", "tri", "nbr", F.lit(None).cast("long").alias("seed")).unionByName(seeds.select("mesh_id", "tri", "seed"), allowMissingColumns=True)

    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        edge, out = pdf[pdf["nbr"].notna()], []
        after: dict[int, list[int]] = {}
        for a, b in edge[["tri", "nbr"]].astype(np.int64).to_numpy().tolist():
            after.setdefault(a, []).append(b)
        for seed, g in pdf[pdf["seed"].notna()].groupby("seed"):
            reached = now = set(g["tri"].tolist())
            for _ in range(rounds):
                now = {b for a in now for b in after.get(a, ())} - reached
                if not now:
                    break
                reached = reached | now
            out += [(int(seed), t) for t in sorted(reached)]
        frame_ = pd.DataFrame(out, columns=["seed", "tri"])
        frame_.insert(0, "mesh_id", pdf["mesh_id"].iloc[0])
        return frame_

    return grouped(rows, kernel, "mesh_id string, seed long, tri long")
