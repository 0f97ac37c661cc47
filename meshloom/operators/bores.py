"""Bores, threads and hinges out of cylinders: scores, coaxial merging and pairing, duplicates, numbering, documents.

Pairings that consume what they pair run as one kernel a mesh, over a mesh's few cylinders or holes; counts and scores over
facets are joins and sums.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meshloom.functions.catalogs import PREFERRED, THREADS
from meshloom.functions.geometry import cross, dot, line_distance, norm, rounded, scale, sub, unit, vec
from meshloom.functions.text import thread_pitch, thread_size
from meshloom.operators.kernels import arc, frame, grouped
from meshloom.operators.matching import FIRST_SERIES, SECOND_SERIES

BINS = 36


def cylinder_scores(facets: DataFrame, candidates: DataFrame, tolerance: float = 0.35, angle: float = 0.25) -> DataFrame:
    """(mesh_id, candidate, inliers, rmse, height, lo, hi): facets (mesh_id, cx..cz, nx..nz) near each candidate's wall
    (mesh_id, candidate, ox..oz, ax..az, radius) that stand along it. Candidates are few a mesh, so the join is on the mesh."""
    f = facets.join(candidates, "mesh_id")
    w, a = sub(vec("cx", "cy", "cz"), vec("ox", "oy", "oz")), vec("ax", "ay", "az")
    t = dot(w, a)
    r = norm(sub(w, scale(a, t)))
    lean = F.abs(dot(vec("nx", "ny", "nz"), a))
    f = f.select("mesh_id", "candidate", t.alias("t"), (F.abs(r - F.col("radius"))).alias("off"), lean.alias("lean"))
    f = f.where((F.col("off") <= tolerance) & (F.col("lean") <= math.sin(max(0.45, angle))))
    return f.groupBy("mesh_id", "candidate").agg(F.count("*").alias("inliers"), F.sqrt(F.avg(F.col("off") * F.col("off"))).alias("rmse"), (F.max("t") - F.min("t")).alias("height"), F.min("t").alias("lo"), F.max("t").alias("hi"))


def flank_metrics(inliers: DataFrame) -> DataFrame:
    """(mesh_id, surface_id, n, flank_rms, spread, coverage, density, axial_gap): facets (cx..cz, nx..nz, area) of cylinders
    (ox..oz, ax..az, ux..uz a unit vector across the axis). flank_rms: how far normals lean along the axis; spread: of the
    distances from it; coverage: the share of 36 sectors that hold a facet; axial_gap: the widest gap along the axis."""
    w, a, u = sub(vec("cx", "cy", "cz"), vec("ox", "oy", "oz")), vec("ax", "ay", "az"), vec("ux", "uy", "uz")
    v = (a[1] * u[2] - a[2] * u[1], a[2] * u[0] - a[0] * u[2], a[0] * u[1] - a[1] * u[0])
    t = dot(w, a)
    turn = F.atan2(dot(w, v), dot(w, u)) / (2 * math.pi)
    sector = F.floor((turn - F.floor(turn)) * BINS)
    f = inliers.withColumns({"t": t, "r": norm(sub(w, scale(a, t))), "lean": dot(vec("nx", "ny", "nz"), a), "sector": sector})
    gap = F.col("t") - F.lag("t").over(Window.partitionBy("mesh_id", "surface_id").orderBy("t"))  # the facets of one cylinder
    f = f.withColumn("gap", gap)
    around = 2 * math.pi * F.avg("r") * F.greatest(F.lit(1e-9), F.max("t") - F.min("t"))
    return f.groupBy("mesh_id", "surface_id").agg(
        F.count("*").alias("n"), F.sqrt(F.avg(F.col("lean") * F.col("lean"))).alias("flank_rms"), (F.max("r") - F.min("r")).alias("spread"),
        (F.countDistinct("sector") / float(BINS)).alias("coverage"), (F.sum("area") / around).alias("density"), F.coalesce(F.max("gap"), F.lit(0.0)).alias("axial_gap"),
    )


def helical(metrics: DataFrame) -> DataFrame:
    """metrics with `helical`: flanks that lean and distances that spread, as a thread's do."""
    return metrics.withColumn("helical", (F.col("flank_rms") >= 0.040) & (F.col("spread") >= 0.20))


def counterbored(d0: Column, d1: Column, h0: Column, h1: Column) -> Column:
    """Whether of two coaxial bores one is the other's counterbore: by their diameters and heights."""
    low, high = F.least(d0, d1), F.greatest(d0, d1)
    step = (high - low) / 2
    one = (high / low).between(1.30, 2.50) & (h0 >= 1) & (h1 >= 1) & (step >= 0.5)
    return one | ((step >= 0.8) & (F.least(h0, h1) < 0.75 * F.greatest(h0, h1)))


@lru_cache(1 << 16)
def _score_pair(bore: float, crest: float) -> tuple[float, int] | None:
    best = None
    for k, (_, nominal, _, drill, *_) in enumerate(THREADS):
        off = abs(crest - nominal), abs(bore - drill)
        score = sum(off) + 0.4 * abs((crest - bore) - (nominal - drill)) + (0.0 if nominal in FIRST_SERIES else 0.05 if nominal in SECOND_SERIES else 0.20)
        if max(off) <= 0.85 and score <= 1.35 and (best is None or score < best[0]):
            best = score, k
    return best


@lru_cache(1 << 16)
def _score_single(d: float) -> tuple[float, int] | None:
    best = None
    for k, (_, nominal, _, drill, _, minor) in enumerate(THREADS):
        score = min(abs(d - drill), abs(d - nominal) + 0.15, abs(d - minor)) + (0.0 if nominal in PREFERRED else 0.25)
        if score <= 0.45 and (best is None or score < best[0]):
            best = score, k
    return best


_AXIS = ["x", "y", "z", "ax", "ay", "az"]
CYLINDER = "mesh_id string, id long, x double, y double, z double, ax double, ay double, az double, radius double, height double, span double, is_internal boolean, members string"


def _apart(p: np.ndarray, q: np.ndarray) -> tuple[float, float, float]:
    """|dot| of two axes, the offset of the second's origin from the first axis, and along it."""
    w = q[:3] - p[:3]
    t = float(w @ p[3:])
    return abs(float(p[3:] @ q[3:])), float(np.linalg.norm(w - t * p[3:])), t


def _coaxial(p: np.ndarray, reach: np.ndarray, along: float, block: int = 1 << 20) -> Iterator[tuple[int, np.ndarray]]:
    """(i, others) for each of the lines p (origin, axis) that has any, in order: the lines whose origins lie within reach[i] of
    i's and whose axes are parallel to i's (|dot| of `along` at least), in order.

    Lines of like direction share a grid across it, whose cells are as wide as their reach, with what their directions differ
    over the mesh's extent; what meets there is measured, block by block. Lines that have no axis or no place meet none."""
    o, a, n = p[:, :3], p[:, 3:], len(p)
    size = np.linalg.norm(a, axis=1)
    fine = np.flatnonzero(np.isfinite(p).all(axis=1) & np.isfinite(reach) & (size > 0))
    if len(fine) < 2:
        return
    base = o[fine].min(axis=0)
    extent = float(np.linalg.norm(o[fine].max(axis=0) - base)) + 1.0
    unit = a[fine] / size[fine, None]
    unit *= np.where(unit[np.arange(len(fine)), np.abs(unit).argmax(axis=1)] < 0, -1.0, 1.0)[:, None]
    step = min(0.25, max(1e-9, 0.25 * float(np.median(reach[fine])) / extent))
    while len((found := np.unique(np.round(unit / step), axis=0, return_inverse=True))[0]) > 64 and step < 0.25:
        step *= 4
    of = found[1].ravel()
    begin, end, flat, held = np.zeros((n, 3), np.int64), np.zeros((n, 3), np.int64), [], 0
    for g in range(len(found[0])):
        own, axis = fine[of == g], unit[of == g][0]
        lean = float(np.linalg.norm(unit[of == g] - axis, axis=1).max())
        to = fine[np.abs(a[fine] @ axis) + lean * size[fine] >= along / size[own].max() - 1e-9]
        flat_of, across = np.column_stack(frame(axis)), reach[own] + lean * extent + 1e-9 * extent
        tier = np.ceil(np.log2(across))
        for k in np.unique(tier):
            wide = max(2.0**k, extent / 1e9)
            row = int(2 * extent / wide) + 4
            cell = lambda i: (lambda c: (c[:, 0] + 1) * row + c[:, 1] + 1)(np.floor(((o[i] - base) @ flat_of + extent) / wide).astype(np.int64))  # noqa: B023, E731
            some, keys = own[tier == k], cell(to)
            order = np.argsort(keys, kind="stable")
            for s, off in enumerate((-row, 0, row)):
                begin[some, s] = held + np.searchsorted(keys[order], cell(some) + off - 1)
                end[some, s] = held + np.searchsorted(keys[order], cell(some) + off + 1, side="right")
            flat.append(to[order])
            held += len(to)
    other, upto = np.concatenate(flat), np.cumsum((end - begin).sum(axis=1))
    at = 0
    while at < n:
        stop = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + block, side="right")))
        many, first = (end - begin)[at:stop].ravel(), begin[at:stop].ravel()
        i = np.repeat(np.repeat(np.arange(at, stop), 3), many)
        j = other[np.arange(len(i)) + np.repeat(first - np.cumsum(many) + many, many)]
        w = o[j] - o[i]
        off = np.linalg.norm(w - (w * a[i]).sum(axis=1)[:, None] * a[i], axis=1)
        ok = (i != j) & (np.abs((a[i] * a[j]).sum(axis=1)) >= along) & (off <= reach[i])
        i, j = i[ok], j[ok]
        order = np.lexsort((j, i))
        i, j = i[order], j[order]
        new = np.flatnonzero(np.diff(i, prepend=-1))
        for x, until in zip(new.tolist(), [*new[1:].tolist(), len(i)], strict=False):
            yield int(i[x]), j[x:until]
        at = stop


def _stitch(pdf: pd.DataFrame) -> pd.DataFrame:
    """Always the first pair of rows, by place, that can be merged. A merge changes only what its row can do, so rows before it
    are tried with that row alone, and no pair that failed is tried again before one of it has grown."""
    pdf = pdf.sort_values("id", kind="stable")
    ids, start = np.unique(pdf["id"].to_numpy(), return_index=True)
    one = pdf.iloc[start].reset_index(drop=True)
    theta = np.split(pdf["theta"].to_numpy(float), start[1:])
    p, radius, height = one[_AXIS].to_numpy(float), one["radius"].to_numpy(float), one["height"].to_numpy(float).copy()
    side, span, members = pd.factorize(one["is_internal"])[0], [arc(t) for t in theta], [[i] for i in ids.tolist()]
    later: dict[int, list[int]] = {}
    earlier: dict[int, list[int]] = {}
    for i, j in _coaxial(p, np.maximum(0.35, 0.12 * radius), 0.98):
        near = np.maximum(0.35, 0.12 * np.minimum(radius[i], radius[j]))
        w = p[j, :3] - p[i, :3]
        off = np.linalg.norm(w - (w @ p[i, 3:])[:, None] * p[i, 3:], axis=1)
        later[i] = j[(j > i) & (side[j] == side[i]) & (np.abs(radius[j] - radius[i]) <= near) & (off <= near)].tolist()
        for k in later[i]:
            earlier.setdefault(k, []).append(i)
    there = [True] * len(ids)

    def merged(i: int, j: int) -> bool:
        if not (there[i] and there[j]):
            return False
        both = np.concatenate([theta[i], theta[j]])
        if not (turn := arc(both)) > max(span[i], span[j]):
            return False
        t = _apart(p[i], p[j])[2]
        height[i] = max(height[i], height[j], abs(t) + min(height[i], height[j]))
        theta[i], span[i], there[j] = both, turn, False
        members[i] += members[j]
        return True

    k = 0
    while k < len(ids):
        if not any(merged(k, j) for j in later.get(k, ())):
            k += 1
            continue
        while (i := next((i for i in earlier.get(k, ()) if merged(i, k)), None)) is not None:
            k = i
    rows = [k for k in range(len(ids)) if there[k]]
    out = [(pdf["mesh_id"].iloc[0], ids[k], *p[k], radius[k], height[k], span[k], one["is_internal"].iloc[k], ",".join(map(str, sorted(members[k])))) for k in rows]
    return pd.DataFrame(out, columns=[c.split()[0] for c in CYLINDER.split(", ")])


def stitched(facets: DataFrame) -> DataFrame:
    """Cylinders merged where they have one side, one radius and one axis, and cover more of the turn together than either
    alone: (mesh_id, id, .., span in degrees, members). facets: one row a facet, with its cylinder (id, x..z, ax..az, radius,
    height, is_internal) and theta, its angle about the axis. One kernel a mesh, over a mesh's cylinders, to a fixed point."""
    return grouped(facets.select("mesh_id", "id", *_AXIS, "radius", "height", "is_internal", "theta"), _stitch, CYLINDER)


HOLE = "mesh_id string, id long, kind string, diameter double, depth double, x double, y double, z double, ax double, ay double, az double, designation string, pitch double, wide double, members string"


def _pair(pdf: pd.DataFrame) -> pd.DataFrame:
    c = pdf.sort_values("id").reset_index(drop=True)
    p, height, used, rows = c[_AXIS].to_numpy(float), c["height"].to_numpy(float).copy(), set(), []
    radius, ids = c["radius"].tolist(), c["id"].tolist()
    for i, others in _coaxial(p, np.full(len(c), 1.25), 0.95):
        for j in others.tolist():
            if i in used:
                break
            if j in used:
                continue
            _, off, t = _apart(p[i], p[j])
            if off >= 1.25:
                continue
            lo, hi = (i, j) if radius[i] < radius[j] else (j, i)
            d, wide = 2 * radius[lo], 2 * radius[hi]
            depth = max(height[i], height[j], abs(t) + min(height[i], height[j]))
            fit = _score_pair(d, wide) or _score_single(d) or _score_single(wide)
            name, nominal, pitch, drill = THREADS[fit[1]][:4] if fit else (None, 0.0, 0.0, 0.0)
            ratio, step = wide / d, (wide - d) / 2
            bored = (1.30 <= ratio <= 2.50 and min(height[i], height[j]) >= 1 and step >= 0.5) or (step >= 0.8 and min(height[i], height[j]) < 0.75 * max(height[i], height[j]))
            members = ",".join(map(str, sorted((ids[i], ids[j]))))
            if fit and wide - d <= max(1.8, 2 * pitch):
                rows.append(("tapped", drill, depth, *p[lo], name, pitch, None, members))
            elif bored:
                rows.append(("counterbore", d, height[i] + height[j], *p[hi], None, None, wide, members))
            elif abs(wide - d) / 2 < 0.15:
                height[i] = depth
                used.add(j)
                continue
            else:
                continue
            used |= {i, j}
    for i in range(len(c)):
        if i not in used:
            fit = _score_single(2 * radius[i])
            name, _, pitch = THREADS[fit[1]][:3] if fit else (None, None, None)
            rows.append(("single", 2 * radius[i], height[i], *p[i], name, pitch, None, str(ids[i])))
    out = pd.DataFrame(rows, columns=[x.split()[0] for x in HOLE.split(", ")][2:])
    out.insert(0, "id", np.arange(len(out)))
    out.insert(0, "mesh_id", pdf["mesh_id"].iloc[0])
    return out


def paired_bores(cylinders: DataFrame) -> DataFrame:
    """Holes out of internal cylinders (mesh_id, id, x..z, ax..az, radius, height): of two on one axis a tapped hole where a
    thread fits the pair, else a counterbore, else one bore cut in two; what is left alone is a hole of its own, with the
    thread that fits it. Each cylinder serves once, in order of id."""
    return grouped(cylinders.select("mesh_id", "id", *_AXIS, "radius", "height"), _pair, HOLE)


UNIQUE = "mesh_id string, id long, diameter double, depth double, x double, y double, z double, ax double, ay double, az double, designation string"


def _unique(pdf: pd.DataFrame) -> pd.DataFrame:
    kept: list[dict] = []
    for r in pdf.sort_values("id").to_dict("records"):
        p = np.array([r[c] for c in _AXIS])
        for k in kept:
            along, off, _ = _apart(k["p"], p)
            if along < 0.90 or off > 1.8:
                continue
            k["depth"] = max(k["depth"], r["depth"])
            has, new = isinstance(k["designation"], str), isinstance(r["designation"], str)
            if new and (not has or r["diameter"] > k["diameter"]):
                k.update(p=p, diameter=r["diameter"], designation=r["designation"])
            elif not new and not has and 0.35 < abs(r["diameter"] - k["diameter"]) < 6.5 and (fit := _score_pair(min(r["diameter"], k["diameter"]), max(r["diameter"], k["diameter"]))):
                k.update(diameter=THREADS[fit[1]][3], designation=THREADS[fit[1]][0])
            break
        else:
            kept.append({"p": p, **{c: r[c] for c in ("diameter", "depth", "designation")}})
    out = pd.DataFrame([(pdf["mesh_id"].iloc[0], 0, k["diameter"], k["depth"], *k["p"], k["designation"]) for k in kept], columns=[c.split()[0] for c in UNIQUE.split(", ")])
    out["level"] = np.floor(out["z"] / 2 + 0.5)
    out = out.sort_values(["level", "x", "y", "z"], kind="stable").drop(columns="level").reset_index(drop=True)
    out["id"] = np.arange(1, len(out) + 1)
    return out


def unique_holes(holes: DataFrame) -> DataFrame:
    """holes (mesh_id, id, diameter, depth, x..z, ax..az, designation) on one axis as one: the deepest depth, the widest thread;
    two plain ones become a tapped hole where a thread fits the pair. Numbered from 1 by level (2 along Z), x and y."""
    return grouped(holes.select("mesh_id", "id", "diameter", "depth", *_AXIS, "designation"), _unique, UNIQUE)


def numbered(holes: DataFrame, keys: list[str], step: float = 2.0) -> DataFrame:
    """holes with `no`, from 1, in order of level (steps along z), x, y and id."""
    order = Window.partitionBy(*keys).orderBy(F.floor(F.col("z") / step + 0.5), "x", "y", "id")  # the holes of one mesh
    return holes.withColumn("no", F.row_number().over(order).cast("long"))


def hole_threads(holes: DataFrame, catalog: DataFrame) -> DataFrame:
    """(mesh_id, id, designation, nominal, pitch, depth) of the threaded holes: sizes read from the designation, a missing pitch
    from the catalog (34 rows) by its nominal size, else 1.5."""
    c = F.broadcast(catalog.groupBy("nominal").agg(F.min_by("pitch", "pos").alias("listed")))
    h = holes.where("designation IS NOT NULL").select("mesh_id", "id", "designation", F.coalesce(thread_size("designation"), F.lit(10.0)).alias("nominal"), thread_pitch("designation").alias("own"), "depth")
    return h.join(c, "nominal", "left").select("mesh_id", "id", "designation", "nominal", F.coalesce("own", "listed", F.lit(1.5)).alias("pitch"), "depth")


HINGE = "mesh_id string, no long, socket string, pin string, clearance double, overlap double, x double, y double, z double, ax double, ay double, az double"


def _hinges(pdf: pd.DataFrame) -> pd.DataFrame:
    kept: list[dict] = []
    for r in pdf.sort_values(["socket", "pin"]).to_dict("records"):
        p = np.array([r[c] for c in _AXIS])
        for k in kept:
            along, off, _ = _apart(k["p"], p)
            if off < 2.5 and along > 0.90:
                if r["overlap"] > k["overlap"]:
                    k.update(p=np.append(p[:3], k["p"][3:]), **{c: r[c] for c in ("socket", "pin", "clearance", "overlap")})
                break
        else:
            kept.append({"p": p, **{c: r[c] for c in ("socket", "pin", "clearance", "overlap")}})
    kept.sort(key=lambda k: (k["p"][1], k["socket"]))
    return pd.DataFrame([(pdf["mesh_id"].iloc[0], n, k["socket"], k["pin"], k["clearance"], k["overlap"], *k["p"]) for n, k in enumerate(kept, 1)], columns=[c.split()[0] for c in HINGE.split(", ")])


def hinges(pairs: DataFrame) -> DataFrame:
    """Pairs of socket and pin (mesh_id, socket, pin, clearance, overlap, x..z, ax..az) along one line as one hinge, the one that
    overlaps most; numbered by y."""
    return grouped(pairs.select("mesh_id", "socket", "pin", "clearance", "overlap", *_AXIS), _hinges, HINGE)


CELL = 8.0  # of the grid across a loop's normal


def through_holes(loops: DataFrame) -> DataFrame:
    """(mesh_id, top, bottom, offset): hole loops (mesh_id, id, x..z, nx..nz of their plane, radius) on planes that face apart,
    each with the one whose centre is nearest across the axis, within half a radius (0.5 to 3.5), if it is that one's nearest too.
    Loops meet in a grid across each different normal of their mesh."""
    place, turn = ("x", "y", "z"), ("nx", "ny", "nz")
    f = loops.select("mesh_id", "id", *[F.col(c).cast("double").alias(c) for c in (*place, *turn, "radius")])
    near = F.least(F.lit(3.5), F.greatest(F.lit(0.5), 0.5 * F.col("radius")))
    # a loop goes to the cells across its normal that it can reach, and one that faces apart to its own cell there
    names = dict(zip(turn, ("mx", "my", "mz"), strict=True))
    steep = F.abs(F.col("ex")) > 0.8
    side = [F.when(steep, p).otherwise(q) for p, q in ((-F.col("ez"), F.lit(0.0)), (F.lit(0.0), F.col("ez")), (F.col("ex"), -F.col("ey")))]

    def with_sides(df: DataFrame) -> DataFrame:
        """df with u and v, two vectors across the axis m and each other, of length 0.6 to 1; step by step, so that plans stay small."""
        df = df.withColumns(dict(zip(("ex", "ey", "ez"), unit(vec("mx", "my", "mz")), strict=True)))
        df = df.withColumns(dict(zip(("ux", "uy", "uz"), side, strict=True)))
        return df.withColumns(dict(zip(("vx", "vy", "vz"), cross(vec("ex", "ey", "ez"), vec("ux", "uy", "uz")), strict=True)))

    flat = lambda df: df.withColumns({k: dot(vec(*place), vec(f"{k}x", f"{k}y", f"{k}z")) for k in "uv"}).where("abs(u) < 1e15 AND abs(v) < 1e15")
    reach = near + 0.1
    cells = lambda c: F.sequence(F.floor((F.col(c) - reach) / CELL), F.floor((F.col(c) + reach) / CELL))
    grid = ["mesh_id", "mx", "my", "mz", "gu", "gv"]
    a = flat(with_sides(f.withColumns({m: F.col(k) for k, m in names.items()})))
    a = a.withColumn("gu", F.explode(cells("u"))).withColumn("gv", F.explode(cells("v")))
    a = a.select(*grid, F.col("id").alias("top"), *[F.col(c).alias(f"a{c}") for c in place], near.alias("near"))
    axes = with_sides(f.select("mesh_id", *[F.col(k).alias(m) for k, m in names.items()]).distinct())
    # loops that were made by explode are many times what Spark takes them for, too many to be broadcast
    b = flat(f.join(axes.hint("merge"), "mesh_id").where(dot(vec(*turn), vec("mx", "my", "mz")) <= -0.85))
    b = b.withColumns({f"g{c}": F.floor(F.col(c) / CELL) for c in "uv"}).select(*grid, F.col("id").alias("bottom"), *[F.col(c).alias(f"b{c}") for c in place])
    off = line_distance(vec("bx", "by", "bz"), vec("ax", "ay", "az"), vec("mx", "my", "mz"))
    met = a.join(b.hint("merge"), grid).where((F.col("top") < F.col("bottom")) & (off < F.col("near")))
    p = met.select("mesh_id", "top", "bottom", off.alias("offset"))
    best = lambda k, o: F.row_number().over(Window.partitionBy("mesh_id", k).orderBy("offset", o))  # noqa: E731  the few loops near one
    return p.withColumn("i", best("top", "bottom")).withColumn("j", best("bottom", "top")).where("i = 1 AND j = 1").drop("i", "j")


def normalized_holes(rows: DataFrame, column: str = "hole") -> DataFrame:
    """rows with diameter, depth, origin and axis of a JSON hole in either spelling of its fields; 5, 10, the origin and +Z
    where they are missing, and a unit axis."""
    get = lambda *paths: F.coalesce(*[F.get_json_object(column, p).cast("double") for p in paths])
    d = F.coalesce(get("$.diameter", "$.diameterMm"), F.lit(5.0))
    depth = F.coalesce(get("$.depth", "$.depthMm"), F.lit(10.0))
    o = [F.coalesce(get(f"$.axisOrigin[{i}]", f"$.origin[{i}]"), F.lit(0.0)) for i in range(3)]
    a = [F.coalesce(get(f"$.axisDirection[{i}]", f"$.axis[{i}]"), F.lit(float(i == 2))) for i in range(3)]
    size = norm(tuple(a))
    unit = [F.when(size > 1e-9, c / size).otherwise(F.lit(float(i == 2))) for i, c in enumerate(a)]
    return rows.withColumns({"diameter": d, "depth": depth, **dict(zip("xyz", o, strict=True)), **dict(zip(("ax", "ay", "az"), unit, strict=True))})


def feature_documents(holes: DataFrame, blends: DataFrame, hinge: DataFrame) -> DataFrame:
    """(mesh_id, document): holes, fillets, chamfers and hinges of each mesh as one JSON document, in order of their ids."""
    h = holes.groupBy("mesh_id").agg(F.array_sort(F.collect_list(F.struct("id", rounded(F.col("diameter"), 2).alias("diameter"), rounded(F.col("depth"), 2).alias("depth"), "designation"))).alias("holes"))
    b = blends.groupBy("mesh_id").agg(*[F.array_sort(F.collect_list(F.when(F.col("kind") == k, F.struct("surface_id", rounded(F.col("size"), 3).alias("size"))))).alias(f"{k}s") for k in ("fillet", "chamfer")])
    j = hinge.groupBy("mesh_id").agg(F.array_sort(F.collect_list(F.struct("no", "socket", "pin", rounded(F.col("clearance"), 4).alias("clearance")))).alias("hinges"))
    out = h.join(b, "mesh_id", "full").join(j, "mesh_id", "full")
    return out.select("mesh_id", F.to_json(F.struct(*[F.coalesce(c, F.array()).alias(c) for c in ("holes", "fillets", "chamfers", "hinges")])).alias("document"))
