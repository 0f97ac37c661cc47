"""Procedural meshes: exact inputs with known topology, volume and features."""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

VERTEX = "mesh_id string, vid long, x float, y float, z float"
TRIANGLE = "mesh_id string, tri long, i0 long, i1 long, i2 long"


@dataclass
class Mesh:
    points: list[tuple[float, float, float]] = field(default_factory=list)
    faces: list[tuple[int, int, int]] = field(default_factory=list)

    def quad(self, a: int, b: int, c: int, d: int) -> None:
        self.faces += [(a, b, c), (a, c, d)]

    def __add__(self, other: Mesh) -> Mesh:
        n = len(self.points)
        return Mesh(self.points + other.points, self.faces + [tuple(i + n for i in f) for f in other.faces])


def box(w: float, d: float, h: float, at: tuple[float, float, float] = (0, 0, 0), inverted: bool = False) -> Mesh:
    m = Mesh([(at[0] + w * x, at[1] + d * y, at[2] + h * z) for z in (0, 1) for x, y in ((0, 0), (1, 0), (1, 1), (0, 1))])
    for q in ((0, 3, 2, 1), (4, 5, 6, 7), (0, 1, 5, 4), (1, 2, 6, 5), (2, 3, 7, 6), (3, 0, 4, 7)):
        m.quad(*q)
    if inverted:
        m.faces = [(a, c, b) for a, b, c in m.faces]
    return m


def labyrinth() -> Mesh:
    """A box with a closed cavity."""
    return box(50, 50, 30) + box(30, 30, 15, (10, 10, 7.5), inverted=True)


def hinge() -> Mesh:
    """Two boxes with a gap of 0.35 along X."""
    return box(20, 15, 10) + box(20, 15, 10, (20.35, 0, 0))


def bored_block(segments: int = 32, side: float = 40, height: float = 20, radius: float = 2.5) -> Mesh:
    """A square block with a through bore, one ring of quads a level."""
    per = segments // 4
    half, step = side / 2, side / per
    ring = [(-half + i * step, -half) for i in range(per)] + [(half, -half + i * step) for i in range(per)] + [(half - i * step, half) for i in range(per)] + [(-half, half - i * step) for i in range(per)]
    m = Mesh()
    for i, (x, y) in enumerate(ring):
        a = -3 * math.pi / 4 + 2 * math.pi * i / segments
        u, v = radius * math.cos(a), radius * math.sin(a)
        m.points += [(x, y, height), (u, v, height), (x, y, 0.0), (u, v, 0.0)]
    for i in range(segments):
        to, ti, bo, bi = (4 * i + k for k in range(4))
        to2, ti2, bo2, bi2 = (4 * ((i + 1) % segments) + k for k in range(4))
        m.quad(to, to2, ti2, ti)
        m.quad(bo2, bo, bi, bi2)
        m.quad(to, bo, bo2, to2)
        m.quad(ti2, bi2, bi, ti)
    return m


def saddle(cells: int = 16, step: float = 2.0, base: float = -15.0) -> Mesh:
    """A freeform saddle on a flat base."""
    n = cells + 1
    grid = [((i - cells / 2) * step, (j - cells / 2) * step) for i in range(n) for j in range(n)]
    m = Mesh([(x, y, (x * x - y * y) / 25) for x, y in grid] + [(x, y, base) for x, y in grid])
    at = lambda i, j, low=0: low * n * n + i * n + j
    for i in range(cells):
        for j in range(cells):
            a, b, c, d = at(i, j), at(i + 1, j), at(i + 1, j + 1), at(i, j + 1)
            m.faces += [(a, b, d), (d, b, c)]
            a, b, c, d = (k + n * n for k in (a, b, c, d))
            m.faces += [(a, d, b), (d, c, b)]
    for k in range(cells):
        for (i, j), (p, q) in (((k, 0), (k + 1, 0)), ((cells, k), (cells, k + 1)), ((cells - k, cells), (cells - k - 1, cells)), ((0, cells - k), (0, cells - k - 1))):
            m.quad(at(i, j, 1), at(p, q, 1), at(p, q), at(i, j))
    return m


def open_box() -> Mesh:
    m = box(1, 1, 1)
    m.faces = m.faces[:2] + m.faces[4:]
    return m


def wedge(size: float = 10, cut: float = 4, depth: float = 10) -> Mesh:
    """A block one of whose edges is cut off at 45 degrees."""
    rim = [(0, 0), (size, 0), (size, size - cut), (size - cut, size), (0, size)]
    m = Mesh([(x, y, z) for y in (0.0, depth) for x, z in rim])
    n = len(rim)
    for k in range(1, n - 1):
        m.faces += [(0, k, k + 1), (n, n + k + 1, n + k)]
    for k in range(n):
        j = (k + 1) % n
        m.quad(k, n + k, n + j, j)
    return m


MESHES = {"unit_cube": lambda: box(1, 1, 1), "labyrinth": labyrinth, "hinge": hinge, "prismatic_m6": bored_block, "saddle": saddle, "open_box": open_box}


def tables(spark: SparkSession, meshes: dict[str, Mesh] | None = None) -> tuple[DataFrame, DataFrame]:
    """(vertex, triangle) of the named meshes."""
    meshes = meshes or {k: f() for k, f in MESHES.items()}
    v = [(k, i, *map(float, np.float32(p))) for k, m in meshes.items() for i, p in enumerate(m.points)]
    t = [(k, i, *f) for k, m in meshes.items() for i, f in enumerate(m.faces)]
    return spark.createDataFrame(v, VERTEX), spark.createDataFrame(t, TRIANGLE)


def replicated(vertex: DataFrame, triangle: DataFrame, copies: int) -> tuple[DataFrame, DataFrame]:
    """Each mesh `copies` times under new ids: a load of any size. The copies are dealt by spark.range, not collected."""
    n = vertex.sparkSession.range(copies).select(F.col("id").cast("string").alias("copy"))
    many = lambda df: n.join(F.broadcast(df)).withColumn("mesh_id", F.concat("mesh_id", F.lit("#"), "copy")).drop("copy")  # noqa: E731  a fixed set of meshes
    return many(vertex), many(triangle)


def sql_values(meshes: dict[str, Mesh]) -> str:
    """The same tables as common table expressions `vertex` and `triangle` for an SQL engine."""
    v = ", ".join(f"('{k}', {i}, {', '.join(f'{float(np.float32(c))!r}::DOUBLE' for c in p)})" for k, m in meshes.items() for i, p in enumerate(m.points))
    t = ", ".join(f"('{k}', {i}, {a}, {b}, {c})" for k, m in meshes.items() for i, (a, b, c) in enumerate(m.faces))
    return f"vertex(mesh_id, vid, x, y, z) AS (VALUES {v}), triangle(mesh_id, tri, i0, i1, i2) AS (VALUES {t})"
