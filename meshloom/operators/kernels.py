"""Work that is sequential within one mesh: segmentation, loops, patterns, simplification. One mesh is one group; groups
are spread over the workers. Each kernel takes and gives tables of a fixed schema; a mesh that fails gives no rows and its
reason in `error`, never a failed job.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CORNERS = [f"{c}{k}" for k in range(3) for c in "xyz"]


def grouped(df: DataFrame, kernel: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """kernel for each mesh_id; an exception becomes a row that has only mesh_id and error."""
    names = [c.split()[0] for c in schema.split(", ")]

    def safe(pdf: pd.DataFrame) -> pd.DataFrame:
        try:
            out = kernel(pdf)
            out["error"] = None
        except Exception as e:
            out = pd.DataFrame({"mesh_id": [pdf["mesh_id"].iloc[0]], "error": [f"{type(e).__name__}: {e}"]})
        return out.reindex(columns=[*names, "error"])

    return df.groupBy("mesh_id").applyInPandas(safe, schema + ", error string")


class Faces:
    """A mesh's facets as arrays: corner ids and points, unit normals, areas, centroids, neighbours over edges."""

    def __init__(self, pdf: pd.DataFrame) -> None:
        pdf = pdf.sort_values("tri")
        self.tri = pdf["tri"].to_numpy()
        self.ids = pdf[["i0", "i1", "i2"]].to_numpy(np.int64)
        self.p = pdf[CORNERS].to_numpy(np.float64).reshape(-1, 3, 3)
        n = np.cross(self.p[:, 1] - self.p[:, 0], self.p[:, 2] - self.p[:, 0])
        size = np.linalg.norm(n, axis=1)
        self.area = size / 2
        self.n = np.where(size[:, None] > 1e-12, n / np.maximum(size, 1e-12)[:, None], [0.0, 0.0, 1.0])
        self.c = self.p.mean(axis=1)
        owner: dict[tuple[int, int], list[int]] = {}
        for f, ids in enumerate(self.ids.tolist()):
            for a, b in ((0, 1), (1, 2), (2, 0)):
                owner.setdefault((min(ids[a], ids[b]), max(ids[a], ids[b])), []).append(f)
        self.near: list[list[int]] = [[] for _ in self.tri]
        for fs in owner.values():
            if len(fs) == 2:
                self.near[fs[0]].append(fs[1])
                self.near[fs[1]].append(fs[0])


def circle(xy: np.ndarray) -> tuple[np.ndarray, float]:
    """Algebraic least-squares circle: centre, and the mean distance to it."""
    a = np.column_stack([2 * xy, np.ones(len(xy))])
    s = np.linalg.lstsq(a, (xy**2).sum(axis=1), rcond=None)[0]
    return s[:2], float(np.linalg.norm(xy - s[:2], axis=1).mean())


def frame(axis: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    ref = np.array([0.0, 1.0, 0.0]) if abs(axis[0]) > 0.8 else np.array([1.0, 0.0, 0.0])
    u = ref - axis * (ref @ axis)
    u /= np.linalg.norm(u)
    return u, np.cross(axis, u)


def arc(theta: np.ndarray) -> float:
    """The span in degrees that angles take up: the circle without its widest gap."""
    t = np.sort(np.mod(theta, 2 * math.pi))
    return 360 - math.degrees(max(np.append(np.diff(t), t[0] + 2 * math.pi - t[-1]).max(), 0)) if len(t) > 1 else 0.0


SURFACE = "mesh_id string, surface_id long, tri long, type string, x double, y double, z double, ax double, ay double, az double, radius double, height double, span double, is_internal boolean, area double, residual double"


def _plane(f: Faces, on: np.ndarray) -> dict:
    o = np.average(f.c[on], axis=0, weights=f.area[on])
    n = (f.n[on] * f.area[on, None]).sum(axis=0)
    n /= np.linalg.norm(n)
    d = np.abs((f.c[on] - o) @ n)
    return {"type": "plane", "o": o, "a": n, "residual": float(d.mean())}


def _cylinder(f: Faces, on: np.ndarray, rms: float) -> dict | None:
    w = f.area[on]
    val, vec = np.linalg.eigh((f.n[on] * w[:, None]).T @ f.n[on] / w.sum())
    axis = vec[:, 0]
    if val[0] > 0.02 or val[1] < 0.02:
        return None
    axis = axis * (1 if axis[np.abs(axis).argmax()] > 0 else -1)
    u, v = frame(axis)
    pts = f.p[on].reshape(-1, 3)
    xy = np.column_stack([pts @ u, pts @ v])
    centre, r = circle(np.unique(np.round(xy, 6), axis=0))
    off = np.linalg.norm(xy - centre, axis=1) - r
    if not np.isfinite(r) or r <= 0 or math.sqrt((off**2).mean()) > max(rms, 0.02 * r):
        return None
    t = pts @ axis
    o = u * centre[0] + v * centre[1] + axis * t.min()
    out = f.c[on] - o
    out -= np.outer(out @ axis, axis)
    inner = float((w * (f.n[on] * out).sum(axis=1)).sum()) < 0
    return {"type": "cylinder", "o": o, "a": axis, "radius": r, "height": float(np.ptp(t)), "span": arc(np.arctan2(xy[:, 1] - centre[1], xy[:, 0] - centre[0])), "is_internal": inner, "residual": float(np.abs(off).mean())}


def _regions(f: Faces, free: np.ndarray, least: float) -> list[np.ndarray]:
    """Connected free faces whose neighbours' normals agree by `least`, largest first."""
    seen, out = ~free, []
    for s in range(len(f.tri)):
        if seen[s]:
            continue
        seen[s], stack, got = True, [s], []
        while stack:
            a = stack.pop()
            got.append(a)
            for b in f.near[a]:
                if not seen[b] and f.n[a] @ f.n[b] >= least:
                    seen[b] = True
                    stack.append(b)
        out.append(np.array(sorted(got)))
    return sorted(out, key=lambda g: (-f.area[g].sum(), g[0]))


def _segment(angle_deg: float, tolerance: float, macro: float, rms: float):
    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        f = Faces(pdf)
        free = np.ones(len(f.tri), bool)
        found: list[tuple[dict, np.ndarray]] = []

        def planes(least: float, facets: int) -> None:
            key = np.column_stack([np.floor(f.n * 20 + 0.5), np.floor((f.n * f.c).sum(axis=1) * 5 + 0.5)]).astype(np.int64)
            _, group = np.unique(key, axis=0, return_inverse=True)
            size = np.bincount(group.ravel(), f.area * free)
            for g in np.argsort(-size, kind="stable"):
                on = np.flatnonzero((group.ravel() == g) & free)
                if len(on) == 0 or size[g] < least:
                    continue
                p = _plane(f, on)
                hit = free & (f.n @ p["a"] >= math.cos(math.radians(angle_deg))) & (np.abs((f.c - p["o"]) @ p["a"]) <= 1.5 * tolerance)
                on = np.flatnonzero(hit)
                if len(on) >= facets and f.area[on].sum() >= least:
                    found.append((_plane(f, on), on))
                    free[on] = False

        planes(macro * f.area.sum(), 1)
        for on in _regions(f, free.copy(), math.cos(math.radians(35))):
            if len(on) >= 8 and (c := _cylinder(f, on, rms)):
                found.append((c, on))
                free[on] = False
        planes(0.0, 3)
        if free.any():
            found.append(({"type": "freeform", "o": f.c[free].mean(axis=0), "a": np.array([0.0, 0.0, 1.0]), "residual": 0.0}, np.flatnonzero(free)))
        rows = []
        for i, (s, on) in enumerate(found):
            head = {"mesh_id": pdf["mesh_id"].iloc[0], "surface_id": i, "type": s["type"], **dict(zip(("x", "y", "z"), s["o"], strict=True)), **dict(zip(("ax", "ay", "az"), s["a"], strict=True)), **{k: s.get(k) for k in ("radius", "height", "span", "is_internal", "residual")}, "area": float(f.area[on].sum())}
            rows += [head | {"tri": int(f.tri[k])} for k in on]
        return pd.DataFrame(rows)

    return kernel


def segment(facet: DataFrame, angle_deg: float = 5.0, tolerance: float = 0.02, macro: float = 0.01, rms: float = 0.035) -> DataFrame:
    """Each facet (mesh_id, tri, i0..i2, x0..z2) with its surface: macro planes (`macro` of the area or more) by buckets of
    normal and offset, then cylinders fitted to smooth regions, then lesser planes; what is left is one freeform surface."""
    return grouped(facet.select("mesh_id", "tri", "i0", "i1", "i2", *CORNERS), _segment(angle_deg, tolerance, macro, rms), SURFACE)


def _ransac(tolerance: float, rounds: int, seed: int, widest: float | None):
    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        f = Faces(pdf)
        rng = np.random.Generator(np.random.PCG64(seed))
        size = float(np.linalg.norm(np.ptp(f.p.reshape(-1, 3), axis=0)))
        most = widest or max(25.0, 0.35 * size)
        least = int(min(max(0.002 * len(f.tri), 16), 300))
        free, rows, failures, found = np.ones(len(f.tri), bool), [], 0, 0
        while failures < 25 and free.sum() >= max(least, 0.02 * len(f.tri)):
            at, best, tried, need = np.flatnonzero(free), None, 0, rounds
            while tried < need:
                i, j = rng.choice(at, 2, replace=False)
                tried += 1
                c = np.cross(f.n[i], f.n[j])
                s = np.linalg.norm(c)
                if s < 0.05:
                    continue
                axis = c / s
                w = f.c[j] - f.c[i]
                w = w - axis * (w @ axis)
                depth = float(np.cross(w, f.n[j]) @ axis) / s
                r = abs(depth)
                if not 0 < r <= most:
                    continue
                o = f.c[i] + f.n[i] * depth
                out = f.c[at] - o
                out -= np.outer(out @ axis, axis)
                far = np.linalg.norm(out, axis=1)
                on = at[(np.abs(far - r) <= tolerance) & (np.abs(f.n[at] @ axis) <= math.sin(0.45)) & (np.abs((f.n[at] * out).sum(axis=1)) >= 0.9 * far)]
                if len(on) >= least and (best is None or len(on) > len(best[0])):
                    best = (on, o, axis, r)
                    share = min(0.999, (len(on) / len(at)) ** 2)
                    need = min(rounds, max(4, int(math.log(0.01) / math.log(1 - share)) + 1))
            if best is None or not (fit := _cylinder(f, best[0], tolerance)):
                failures += 1
                if best is None:
                    break
                free[best[0]] = False
                continue
            on = best[0]
            free[on] = False
            head = (found, *fit["o"], *fit["a"], fit["radius"], fit["height"], fit["span"], bool(fit["is_internal"]))
            rows += [(*head[:1], int(f.tri[k]), *head[1:]) for k in on]
            found += 1
        out = pd.DataFrame(rows, columns=["surface_id", "tri", "x", "y", "z", "ax", "ay", "az", "radius", "height", "span", "is_internal"])
        out.insert(0, "mesh_id", pdf["mesh_id"].iloc[0])
        return out

    return kernel


def searched_cylinders(facet: DataFrame, tolerance: float = 0.35, rounds: int = 60, seed: int = 11, widest: float | None = None) -> DataFrame:
    """(mesh_id, surface_id, tri, x..z, ax..az, radius, height, span, is_internal): cylinders found by drawing pairs of facets, each
    of which fixes one, from the facets not yet taken. The draws follow the seed, fewer of them the more facets the best one
    takes, so that a search has missed a better one with 1 % at most; it ends after 25 failures, or with 2 % of the facets left."""
    schema = "mesh_id string, surface_id long, tri long, x double, y double, z double, ax double, ay double, az double, radius double, height double, span double, is_internal boolean"
    return grouped(facet.select("mesh_id", "tri", "i0", "i1", "i2", *CORNERS), _ransac(tolerance, rounds, seed, widest), schema)


def surfaces(segments: DataFrame) -> DataFrame:
    """One row a surface of segment()."""
    keep = [c.split()[0] for c in SURFACE.split(", ") if c.split()[0] not in ("mesh_id", "surface_id", "tri")]
    return segments.where("error IS NULL").groupBy("mesh_id", "surface_id").agg(*[F.first(c).alias(c) for c in keep], F.count("*").alias("n_tri"))


def _loops(pdf: pd.DataFrame) -> pd.DataFrame:
    nxt: dict[int, list[int]] = {}
    for u, v in pdf.sort_values(["u", "v"])[["u", "v"]].itertuples(index=False):
        nxt.setdefault(u, []).append(v)
    rows, loop = [], 0
    while nxt:
        start = at = min(nxt)
        path = []
        while at in nxt:
            path.append(at)
            to = nxt[at].pop(0)
            if not nxt[at]:
                del nxt[at]
            at = to
            if at == start:
                break
        rows += [(loop, k, int(v), at == start) for k, v in enumerate(path)]
        loop += 1
    out = pd.DataFrame(rows, columns=["loop_id", "ord", "vid", "closed"])
    out.insert(0, "mesh_id", pdf["mesh_id"].iloc[0])
    return out


def loops(boundary: DataFrame) -> DataFrame:
    """(mesh_id, loop_id, ord, vid, closed): boundary half-edges (mesh_id, u, v) traced head to tail, each from its least vertex."""
    return grouped(boundary.select("mesh_id", "u", "v"), _loops, "mesh_id string, loop_id long, ord long, vid long, closed boolean")


PATTERN = "mesh_id string, pattern_id long, kind string, n long, cx double, cy double, cz double, pcd double, step_deg double, equispaced boolean, members string"


def _bolt_circles(pdf: pd.DataFrame) -> pd.DataFrame:
    h = pdf.sort_values("id").reset_index(drop=True).fillna({"designation": ""})
    left, rows = list(range(len(h))), []
    pos, axis = h[["x", "y", "z"]].to_numpy(float), h[["ax", "ay", "az"]].to_numpy(float)
    while left:
        s = left[0]
        alike = [i for i in left if h.designation[i] == h.designation[s] and abs(h.diameter[i] - h.diameter[s]) <= 0.20 and abs(h.depth[i] - h.depth[s]) <= 0.50 and axis[i] @ axis[s] >= 0.985 and abs((pos[i] - pos[s]) @ axis[s]) <= 0.50]
        if len(alike) < 4:
            left.remove(s)
            continue
        u, v = frame(axis[s])
        on = alike
        while len(on) >= 4:
            xy = np.column_stack([pos[on] @ u, pos[on] @ v])
            c, r = circle(xy)
            off = np.abs(np.linalg.norm(xy - c, axis=1) - r)
            if off.max() <= min(max(0.02 * r, 0.40), 1.2):
                break
            on = [i for k, i in enumerate(on) if k != int(off.argmax())]
        if len(on) >= 4 and r >= 1.5:
            t = np.sort(np.mod(np.arctan2(*(xy - c).T[::-1]), 2 * math.pi))
            gaps = np.degrees(np.append(np.diff(t), t[0] + 2 * math.pi - t[-1]))
            centre = u * c[0] + v * c[1] + axis[s] * (pos[s] @ axis[s])
            rows.append((len(rows), "circle", len(on), *centre, 2 * r, float(np.median(gaps)), bool(np.abs(gaps - 360 / len(on)).max() <= 4), ",".join(map(str, h.id[on]))))
            left = [i for i in left if i not in on]
        else:
            left.remove(s)
    out = pd.DataFrame(rows, columns=[c.split()[0] for c in PATTERN.split(", ")][1:])
    out.insert(0, "mesh_id", pdf["mesh_id"].iloc[0])
    return out


def bolt_circles(holes: DataFrame) -> DataFrame:
    """Circles of four and more equal holes (mesh_id, id, x, y, z, ax, ay, az, diameter, depth, and designation where threads
    are known): centre, pitch circle, step; equispaced where no step is off by more than 4 degrees."""
    thread = F.col("designation") if "designation" in holes.columns else F.lit(None).cast("string")
    return grouped(holes.select("mesh_id", "id", "x", "y", "z", "ax", "ay", "az", "diameter", "depth", thread.alias("designation")), _bolt_circles, PATTERN)


def _simplify(target: float | int, feature_deg: float, most: float):
    def kernel(pdf: pd.DataFrame) -> pd.DataFrame:
        f = Faces(pdf)
        goal = int(target * len(f.tri)) if isinstance(target, float) else target
        vid = np.unique(f.ids)
        face = np.searchsorted(vid, f.ids)
        p = np.zeros((len(vid), 3))
        p[face.ravel()] = f.p.reshape(-1, 3)
        plane = np.column_stack([f.n, -(f.n * f.c).sum(axis=1)])
        q = np.zeros((len(vid), 4, 4))
        k = plane[:, :, None] * plane[:, None, :] * f.area[:, None, None]
        for j in range(3):
            np.add.at(q, face[:, j], k)
        around: list[set[int]] = [set() for _ in vid]
        for i, t in enumerate(face.tolist()):
            for a in t:
                around[a].add(i)
        edges: dict[tuple[int, int], list[int]] = {}
        for i, t in enumerate(face.tolist()):
            for a, b in ((0, 1), (1, 2), (2, 0)):
                edges.setdefault((min(t[a], t[b]), max(t[a], t[b])), []).append(i)
        crease = math.cos(math.radians(feature_deg))
        locked = np.zeros(len(vid), bool)
        for (a, b), fs in edges.items():
            if len(fs) != 2 or f.n[fs[0]] @ f.n[fs[1]] < crease:
                locked[[a, b]] = True
        alive = np.ones(len(face), bool)
        live = len(face)

        def cost(a: int, b: int) -> float:
            """Of moving b to a."""
            h = np.append(p[a], 1.0)
            return float(h @ (q[a] + q[b]) @ h)

        heap = [(cost(a, b), a, b) for x, y in edges for a, b in ((x, y), (y, x)) if not locked[b]]
        heapq.heapify(heap)
        gone = np.zeros(len(vid), bool)
        while heap and live > goal:
            c, a, b = heapq.heappop(heap)
            if c > most:
                break
            if gone[a] or gone[b] or (now := cost(a, b)) > c + 1e-12 and now > most:
                continue
            shared = [i for i in around[b] if alive[i] and a in face[i]]
            rest = [i for i in around[b] if alive[i] and a not in face[i]]
            ring = lambda x: {v for i in around[x] if alive[i] for v in face[i].tolist()} - {x}
            if len(shared) != 2 or len(ring(a) & ring(b)) != 2:
                continue
            ok = True
            for i in rest:
                old = np.cross(p[face[i, 1]] - p[face[i, 0]], p[face[i, 2]] - p[face[i, 0]])
                t = np.where(face[i] == b, a, face[i])
                new = np.cross(p[t[1]] - p[t[0]], p[t[2]] - p[t[0]])
                size = np.linalg.norm(new) * np.linalg.norm(old)
                if size < 1e-18 or old @ new < 0.5 * size:
                    ok = False
                    break
            if not ok:
                continue
            for i in shared:
                alive[i] = False
            live -= len(shared)
            for i in rest:
                face[i][face[i] == b] = a
                around[a].add(i)
            q[a] += q[b]
            gone[b] = True
            for v in ring(a):
                for x, y in ((a, v), (v, a)):
                    if not locked[y] and not gone[y]:
                        heapq.heappush(heap, (cost(x, y), x, y))
        out = pd.DataFrame(vid[face[alive]], columns=["i0", "i1", "i2"])
        out[CORNERS] = p[face[alive]].reshape(-1, 9)
        out.insert(0, "tri", np.arange(len(out)))
        out.insert(0, "mesh_id", pdf["mesh_id"].iloc[0])
        return out

    return kernel


FACET = "mesh_id string, tri long, i0 long, i1 long, i2 long, " + ", ".join(f"{c} double" for c in CORNERS)


def simplify(facet: DataFrame, target: float | int, feature_deg: float = 30.0, most: float = 1e-2) -> DataFrame:
    """Facets after quadric edge collapse to `target` (a share, or a count): vertices at open or sharp edges stay, links stay
    manifold, no face flips, and no collapse costs more than `most`."""
    return grouped(facet.select("mesh_id", "tri", "i0", "i1", "i2", *CORNERS), _simplify(target, feature_deg, most), FACET)


def band(top: np.ndarray, bottom: np.ndarray) -> list[tuple[int, int, int]]:
    """Triangles between two closed loops of points in one plane frame, by a sweep of the angle about their centre; top are
    points 0..m-1, bottom m..m+n-1; m + n triangles."""
    m, n = len(top), len(bottom)
    c = np.vstack([top, bottom]).mean(axis=0)
    turn = lambda p: np.mod(np.arctan2(p[:, 1] - c[1], p[:, 0] - c[0]), 2 * math.pi)
    a, b = np.argsort(turn(top), kind="stable"), np.argsort(turn(bottom), kind="stable")
    ta, tb = np.append(turn(top)[a], turn(top)[a[0]] + 2 * math.pi), np.append(turn(bottom)[b], turn(bottom)[b[0]] + 2 * math.pi)
    i = j = 0
    out = []
    while i < m or j < n:
        if j == n or (i < m and ta[i + 1] <= tb[j + 1]):
            out.append((int(a[i % m]), int(a[(i + 1) % m]), int(m + b[j % n])))
            i += 1
        else:
            out.append((int(m + b[j % n]), int(a[i % m]), int(m + b[(j + 1) % n])))
            j += 1
    return out
