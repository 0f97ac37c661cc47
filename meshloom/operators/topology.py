"""Mesh topology and mass: facets, welding, edges, shells, bounds and moments as joins and grouped sums.

Tables carry mesh_id, so that one plan serves any number of meshes. Coordinates are single precision and are widened
before arithmetic.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meshloom.functions.geometry import cross, dot, quantized, rounded, sub, triangle_area, triangle_normal, vec

TOLERANCE = 1e-4


def facets(vertex: DataFrame, triangle: DataFrame) -> DataFrame:
    """triangle with its corners x0..z2. The three lookups shuffle on (mesh_id, vertex id) unless the vertices are small."""
    out = triangle
    for k in range(3):
        v = vertex.select("mesh_id", F.col("vid").alias(f"i{k}"), *[F.col(c).alias(f"{c}{k}") for c in "xyz"])
        out = out.join(v, ["mesh_id", f"i{k}"])
    return out


def corners():
    return tuple(vec(f"x{k}", f"y{k}", f"z{k}") for k in range(3))


def facet_geometry(facet: DataFrame) -> DataFrame:
    """facet with its unit normal (+Z where it has none), centroid and area, stored in single precision."""
    a, b, c = corners()
    n, area = triangle_normal(a, b, c), triangle_area(a, b, c)
    cols = {f"n{k}": n[i] for i, k in enumerate("xyz")} | {f"c{k}": (a[i] + b[i] + c[i]) / 3.0 for i, k in enumerate("xyz")} | {"area": area}
    return facet.select("*", *[v.cast("float").alias(k) for k, v in cols.items()])


def weld(soup: DataFrame, tolerance: float = TOLERANCE) -> tuple[DataFrame, DataFrame]:
    """(vertex, triangle) of a soup (mesh_id, tri, x0..z2): corners whose offsets from the mesh's least corner round to
    the same steps are one vertex. The first corner in order gives its coordinates, and ids follow first occurrence."""
    row = F.posexplode(F.array(*[F.struct(*[F.col(f"{c}{k}").alias(c) for c in "xyz"]) for k in range(3)]))
    pts = soup.select("mesh_id", "tri", row.alias("k", "p")).select("mesh_id", "tri", "k", "p.*", (F.col("tri") * 3 + F.col("k")).alias("row"))
    low = pts.groupBy("mesh_id").agg(*[F.min(c).cast("double").alias(f"{c}_low") for c in "xyz"])
    q = pts.join(low, "mesh_id").select("*", *[quantized(F.col(c).cast("double") - F.col(f"{c}_low"), tolerance).alias(f"q{c}") for c in "xyz"])
    first = q.groupBy("mesh_id", "qx", "qy", "qz").agg(F.min(F.struct("row", "x", "y", "z")).alias("f"))
    ranked = first.withColumn("vid", (F.row_number().over(Window.partitionBy("mesh_id").orderBy("f.row")) - 1).cast("long"))
    vertex = ranked.select("mesh_id", "vid", "f.x", "f.y", "f.z")
    corner = q.join(ranked.select("mesh_id", "qx", "qy", "qz", "vid"), ["mesh_id", "qx", "qy", "qz"])
    triangle = corner.groupBy("mesh_id", "tri").agg(*[F.max(F.when(F.col("k") == k, F.col("vid"))).alias(f"i{k}") for k in range(3)])
    return vertex, triangle


def proper(facet: DataFrame, least_area: float | None = None) -> DataFrame:
    """Facets with three different corners and, where coordinates are there, an area of `least_area` or more."""
    ok = (F.col("i0") != F.col("i1")) & (F.col("i1") != F.col("i2")) & (F.col("i0") != F.col("i2"))
    return facet.where(ok if least_area is None else ok & (triangle_area(*corners()) >= least_area))


def half_edges(triangle: DataFrame) -> DataFrame:
    """(mesh_id, tri, ord, u, v): the three directed edges of each triangle."""
    e = F.array(*[F.struct(F.col(f"i{k}").alias("u"), F.col(f"i{(k + 1) % 3}").alias("v")) for k in range(3)])
    return triangle.select("mesh_id", "tri", F.posexplode(e).alias("ord", "e")).select("mesh_id", "tri", "ord", "e.u", "e.v")


def edges(triangle: DataFrame) -> DataFrame:
    """(mesh_id, a, b, degree, orient_sum): undirected edges with the number of faces and the sum of directions. Combines before it is shuffled."""
    h = half_edges(triangle)
    return h.groupBy("mesh_id", F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).agg(
        F.count("*").alias("degree"), F.sum(F.when(F.col("u") < F.col("v"), 1).otherwise(-1)).alias("orient_sum")
    )


def edge_audit(triangle: DataFrame) -> DataFrame:
    """Counts of edges by degree, and of two-face edges run in one direction, for each mesh."""
    return edges(triangle).groupBy("mesh_id").agg(
        F.count("*").alias("n_edges"),
        F.count_if(F.col("degree") == 1).alias("open_edges"),
        F.count_if(F.col("degree") == 2).alias("manifold_edges"),
        F.count_if(F.col("degree") > 2).alias("non_manifold_edges"),
        F.count_if((F.col("degree") == 2) & (F.col("orient_sum") != 0)).alias("inverted_edges"),
    )


def boundary_half_edges(triangle: DataFrame) -> DataFrame:
    """Directed edges whose reverse is absent in the mesh: one grouping by undirected edge, which keeps a direction where the
    other has none."""
    h = half_edges(triangle).withColumns({"a": F.least("u", "v"), "b": F.greatest("u", "v"), "up": F.col("u") < F.col("v")})
    one = F.struct("tri", "ord", "u", "v")
    g = h.groupBy("mesh_id", "a", "b").agg(F.collect_list(F.when(F.col("up"), one)).alias("ups"), F.collect_list(F.when(~F.col("up"), one)).alias("downs"))
    alone = F.when(F.size("downs") == 0, F.col("ups")).when(F.size("ups") == 0, F.col("downs"))
    return g.where((F.size("ups") == 0) | (F.size("downs") == 0)).select("mesh_id", F.explode(alone).alias("e")).select("mesh_id", "e.*")


def adjacency(triangle: DataFrame) -> DataFrame:
    """(mesh_id, tri, nbr): faces across edges of exactly two faces, both ways."""
    h = half_edges(triangle).select("mesh_id", "tri", F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b"))
    pair = h.groupBy("mesh_id", "a", "b").agg(F.count("*").alias("n"), F.min("tri").alias("p"), F.max("tri").alias("q")).where("n = 2")
    return pair.select("mesh_id", F.explode(F.array(F.struct(F.col("p").alias("tri"), F.col("q").alias("nbr")), F.struct(F.col("q").alias("tri"), F.col("p").alias("nbr")))).alias("e")).select("mesh_id", "e.*")


def euler(triangle: DataFrame) -> DataFrame:
    """V - E + F over used vertices."""
    used = triangle.select("mesh_id", F.explode(F.array("i0", "i1", "i2")).alias("vid")).distinct().groupBy("mesh_id").agg(F.count("*").alias("v"))
    e = edges(triangle).groupBy("mesh_id").agg(F.count("*").alias("e"))
    f = triangle.groupBy("mesh_id").agg(F.count("*").alias("f"))
    return used.join(e, "mesh_id").join(f, "mesh_id").select("mesh_id", "v", "e", "f", (F.col("v") - F.col("e") + F.col("f")).alias("chi"))


def shell_labels(triangle: DataFrame) -> DataFrame:
    """(mesh_id, tri, shell_id): faces joined over two-face edges, a shell named by its least face.

    A mesh fits a worker (the unit of work is a mesh, and work is spread over meshes), so its components are found there
    with arrays: least labels spread over neighbours and labels jump to their labels' labels.
    """
    import numpy as np
    import pandas as pd

    def label(pdf: pd.DataFrame) -> pd.DataFrame:
        tri = np.sort(pdf["tri"].unique())
        at = np.searchsorted(tri, pdf["tri"].to_numpy())
        has = pdf["nbr"].notna().to_numpy()
        nbr = np.searchsorted(tri, pdf["nbr"].to_numpy()[has].astype(np.int64))
        own, lab = at[has], np.arange(len(tri))
        while True:
            new = lab.copy()
            np.minimum.at(new, own, lab[nbr])
            new = new[new]
            if (new == lab).all():
                break
            lab = new
        return pd.DataFrame({"mesh_id": pdf["mesh_id"].iloc[0], "tri": tri, "shell_id": tri[lab]})

    rows = triangle.select("mesh_id", "tri").join(adjacency(triangle), ["mesh_id", "tri"], "left")
    return rows.groupBy("mesh_id").applyInPandas(label, "mesh_id string, tri long, shell_id long")


def shells(facet: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """One row a shell: faces, signed volume, area and bounds; a cavity has a negative volume."""
    a, b, c = corners()
    labels = shell_labels(facet) if labels is None else labels
    f = facet.join(labels, ["mesh_id", "tri"])
    low = lambda k: F.least(*[F.min(f"{k}{i}") for i in range(3)]).cast("double").alias(f"min_{k}")
    high = lambda k: F.greatest(*[F.max(f"{k}{i}") for i in range(3)]).cast("double").alias(f"max_{k}")
    return f.groupBy("mesh_id", "shell_id").agg(
        F.count("*").alias("n_tri"), F.sum(dot(a, cross(b, c)) / 6.0).alias("signed_volume"), F.sum(triangle_area(a, b, c)).alias("area"), *[low(k) for k in "xyz"], *[high(k) for k in "xyz"]
    ).withColumn("is_cavity", F.col("signed_volume") < 0)


def _large(n_tri, volume, least: float):
    return (n_tri >= 8) & ((n_tri >= 30) | (F.abs(volume) >= least))


def debris_free(shell: DataFrame) -> DataFrame:
    """Shells that are kept. Of several in a mesh, first those of 8 faces and more that have 30 faces or a volume of 1; if none
    is, those of 8 faces and more that have 30 or a volume of 0.1; if none is, all."""
    mesh = Window.partitionBy("mesh_id")  # the shells of one mesh
    n, v = F.col("n_tri"), F.col("signed_volume")
    first, second = _large(n, v, 1.0), _large(n, v, 0.1)
    some = lambda c: F.max(c.cast("int")).over(mesh) == 1
    s = shell.withColumns({"many": F.count("*").over(mesh), "some1": some(first), "some2": some(second)})
    keep = F.when(F.col("many") == 1, True).when(F.col("some1"), first).when(F.col("some2"), second).otherwise(True)
    return s.where(keep).drop("many", "some1", "some2")


def bounds(points: DataFrame, keys: list[str], x: str = "x", y: str = "y", z: str = "z") -> DataFrame:
    cols = {"x": x, "y": y, "z": z}
    return points.groupBy(*keys).agg(*[f(F.col(c).cast("double")).alias(f"{n}_{k}") for n, f in (("min", F.min), ("max", F.max)) for k, c in cols.items()])


def mass_properties(facet: DataFrame) -> DataFrame:
    """Volume, area, centre of mass and inertia (unit density) about it, from one pass of sums over signed tetrahedra.

    Positions are taken from the mesh's first facet's first corner, which keeps the sums small.
    """
    first = facet.groupBy("mesh_id").agg(F.min(F.struct("tri", "x0", "y0", "z0")).alias("o"))
    o = tuple(F.col(f"o.{k}0").cast("double") for k in "xyz")
    a, b, c = (sub(p, o) for p in corners())
    det = dot(a, cross(b, c))
    s = [a[i] + b[i] + c[i] for i in range(3)]
    pair = lambda i, j: det * (s[i] * s[j] + a[i] * a[j] + b[i] * b[j] + c[i] * c[j]) / 120.0
    sums = {"v": det / 6.0, "area": triangle_area(a, b, c)} | {f"m{k}": det * s[i] / 24.0 for i, k in enumerate("xyz")} | {f"s{n}": pair(*ij) for n, ij in {"xx": (0, 0), "yy": (1, 1), "zz": (2, 2), "xy": (0, 1), "yz": (1, 2), "zx": (2, 0)}.items()}
    g = facet.join(first, "mesh_id").groupBy("mesh_id").agg(F.first("o").alias("o"), *[F.sum(e).alias(n) for n, e in sums.items()])
    v = F.when(F.abs("v") < 1e-12, F.lit(1e-12)).otherwise(F.col("v"))
    com = {k: F.col(f"m{k}") / v for k in "xyz"}
    moment = lambda p, q, r: F.greatest(F.lit(0.0), F.col(f"s{p}{p}") + F.col(f"s{q}{q}") - v * (com[p] * com[p] + com[q] * com[q]))
    product = lambda n, p, q: -(F.col(f"s{n}") - v * com[p] * com[q])
    return g.select(
        "mesh_id", F.col("v").alias("volume"), "area", *[(com[k] + F.col(f"o.{k}0").cast("double")).alias(f"com_{k}") for k in "xyz"],
        moment("y", "z", "x").alias("i_xx"), moment("x", "z", "y").alias("i_yy"), moment("x", "y", "z").alias("i_zz"),
        product("xy", "x", "y").alias("i_xy"), product("yz", "y", "z").alias("i_yz"), product("zx", "z", "x").alias("i_zx"),
    ).withColumn("principal", F.array_sort(F.array("i_xx", "i_yy", "i_zz")))


def wall_estimates(mass: DataFrame, bound: DataFrame) -> DataFrame:
    """(mesh_id, wall): a thickness guessed from volume and area: twice their ratio, between 0.6 and a quarter of the least side."""
    side = F.least(*[F.col(f"max_{c}") - F.col(f"min_{c}") for c in "xyz"])
    ratio = F.try_divide(2 * F.abs("volume"), F.col("area"))
    return mass.join(bound, "mesh_id").select("mesh_id", F.greatest(F.lit(0.6), F.least(side / 4, F.coalesce(ratio, F.lit(0.0)))).alias("wall"))


def sanitized(vertex: DataFrame, triangle: DataFrame, tolerance: float = 0.005) -> tuple[DataFrame, DataFrame]:
    """(facet, labels): facets without degenerate ones, sewn where open edges nearly meet, without debris; and their shells. Both
    are computed here, since what follows asks for them many times."""
    from meshloom.operators.spatial import sewn
    from meshloom.operators.staging import kept

    clean = kept(proper(facets(vertex, triangle), 1e-9).select("mesh_id", "tri", "i0", "i1", "i2"))
    f = kept(facets(vertex, sewn(vertex, clean, tolerance)))
    labels = shell_labels(f)
    good = debris_free(shells(f, labels)).select("mesh_id", "shell_id")
    labels = kept(labels.join(good, ["mesh_id", "shell_id"], "left_semi").select("mesh_id", "tri", "shell_id"))
    return f.join(labels.select("mesh_id", "tri"), ["mesh_id", "tri"], "left_semi"), labels


def analyze(vertex: DataFrame, triangle: DataFrame, sanitize: bool = True) -> DataFrame:
    """One row a mesh: counts, watertightness, Euler characteristic, shells, bounds, volume and area, of the sanitized mesh (or,
    without `sanitize`, of all facets but degenerate ones).

    Volume sums shells that are no cavities; area sums all."""
    f = facets(vertex, triangle)
    good, labels = sanitized(vertex, triangle) if sanitize else (proper(f, 1e-9), None)
    s = shells(good, labels).groupBy("mesh_id").agg(
        F.count("*").alias("n_shells"), F.count_if("is_cavity").alias("n_cavities"), F.sum(F.when(~F.col("is_cavity"), F.col("signed_volume")).otherwise(0.0)).alias("volume"), F.sum("area").alias("area"),
        *[F.min(f"min_{k}").alias(f"min_{k}") for k in "xyz"], *[F.max(f"max_{k}").alias(f"max_{k}") for k in "xyz"],
    )
    counts = euler(good).join(edge_audit(good), "mesh_id").join(s, "mesh_id")
    degenerate = f.groupBy("mesh_id").agg(F.count("*").alias("n_read"), F.count_if((F.col("i0") == F.col("i1")) | (F.col("i1") == F.col("i2")) | (F.col("i0") == F.col("i2")) | (triangle_area(*corners()) < 1e-9)).alias("n_degenerate"))
    out = counts.join(degenerate, "mesh_id")
    return out.select(
        "mesh_id", F.col("f").alias("n_tri"), F.col("v").alias("n_vertices"), "n_degenerate", "open_edges", "non_manifold_edges", "inverted_edges", "chi", "n_shells", "n_cavities",
        ((F.col("open_edges") == 0) & (F.col("non_manifold_edges") == 0)).alias("watertight"), rounded(F.col("volume"), 4).alias("volume"), rounded(F.col("area"), 4).alias("area"),
        *[f"{m}_{k}" for m in ("min", "max") for k in "xyz"],
    )


def y_up(vertex: DataFrame) -> DataFrame:
    """(x, y, z) to (x, z, -y)."""
    return vertex.select("mesh_id", "vid", "x", F.col("z").alias("y"), (-F.col("y")).alias("z"))


def vertex_quadrics(facet: DataFrame) -> DataFrame:
    """Area-weighted plane quadrics summed by vertex: the ten different entries of a symmetric 4x4 matrix."""
    a, b, c = corners()
    n, area = triangle_normal(a, b, c), triangle_area(a, b, c)
    p = (*n, -dot(n, a))
    names = [f"q{i}{j}" for i in range(4) for j in range(i, 4)]
    entries = [area * p[i] * p[j] for i in range(4) for j in range(i, 4)]
    rows = facet.select("mesh_id", F.explode(F.array("i0", "i1", "i2")).alias("vid"), *[e.alias(k) for e, k in zip(entries, names, strict=True)])
    return rows.groupBy("mesh_id", "vid").agg(*[F.sum(k).alias(k) for k in names])


def shielded(facet: DataFrame, feature_deg: float = 30.0, fine_deg: float | None = None, length: float = 0.35, curvature_deg: float | None = None, boxes: DataFrame | None = None, vertex: DataFrame | None = None) -> DataFrame:
    """(mesh_id, vid): vertices to keep in place: ends of edges that have not two faces or whose faces meet at a crease, and
    where asked for, ends of short edges with a finer crease, vertices where the surface turns, and those in keep-out boxes."""
    from meshloom.operators.validity import boxed_vertices, curved_vertices, short_creases

    out = short_creases(facet, feature_deg, feature_deg if fine_deg is None else fine_deg, length)
    if curvature_deg is not None:
        out = out.unionByName(curved_vertices(facet, curvature_deg))
    if boxes is not None:
        out = out.unionByName(boxed_vertices(vertex, boxes))
    return out.distinct()
