"""Features of segmented meshes: holes and threads, counterbores, blends, notches."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshloom.functions.geometry import dot, line_distance, rounded, vec
from meshloom.operators.matching import match_thread
from meshloom.operators.spatial import gap_clusters


def holes(surface: DataFrame) -> DataFrame:
    """Full internal cylinders (a span of 280 degrees and more, at least 0.5 across and 0.8 deep) with their best thread."""
    c = surface.where("type = 'cylinder' AND is_internal AND span >= 280 AND 2 * radius >= 0.5 AND height >= 0.8")
    h = c.select("mesh_id", F.concat(F.lit("hole_"), "surface_id").alias("id"), rounded(2 * F.col("radius"), 4).alias("diameter"), rounded(F.col("height"), 4).alias("depth"), "x", "y", "z", "ax", "ay", "az")
    return match_thread(h, "diameter")


def counterbores(hole: DataFrame) -> DataFrame:
    """Pairs of coaxial holes of a mesh (axes within 1.25, nearly parallel) of which one is 1.3 to 2.5 times as wide and 0.5 wider in radius."""
    side = lambda p: hole.select("mesh_id", *[F.col(c).alias(f"{p}_{c}") for c in ("id", "diameter", "x", "y", "z", "ax", "ay", "az")])
    v = lambda p, *c: vec(*[f"{p}_{k}" for k in c])
    a, b = side("a"), side("b")
    ratio = F.col("b_diameter") / F.col("a_diameter")
    near = (line_distance(v("b", "x", "y", "z"), v("a", "x", "y", "z"), v("a", "ax", "ay", "az")) < 1.25) & (F.abs(dot(v("a", "ax", "ay", "az"), v("b", "ax", "ay", "az"))) >= 0.95)
    return a.join(b, "mesh_id").where(near & ratio.between(1.3, 2.5) & (F.col("b_diameter") - F.col("a_diameter") >= 1.0)).select("mesh_id", F.col("a_id").alias("bore"), F.col("b_id").alias("counterbore"), ratio.alias("ratio"))


def blends(surface: DataFrame) -> DataFrame:
    """Fillets: cylinders that span 140 degrees at most. Chamfers: planes whose two largest normal components lie within
    0.2 of each other, between 0.5 and 0.88; the width is estimated from the area."""
    n = F.array_sort(F.array(*[F.abs(F.col(c)) for c in ("ax", "ay", "az")]))
    first, second = F.element_at(n, 3), F.element_at(n, 2)
    chamfer = (F.col("type") == "plane") & (first - second <= 0.20) & first.between(0.5, 0.88) & second.between(0.5, 0.88)
    fillet = (F.col("type") == "cylinder") & (F.col("span") <= 140)
    return surface.where(chamfer | fillet).select("mesh_id", "surface_id", F.when(fillet, "fillet").otherwise("chamfer").alias("kind"), F.when(fillet, F.col("radius")).otherwise(0.35 * F.sqrt(F.greatest(F.lit(1.0), F.col("area")))).alias("size"))


def notches(geometry: DataFrame, axis: str = "x", gap: float = 3.5) -> DataFrame:
    """Runs of facets (mesh_id, nx.., cx..) that face along the mesh's long axis, within its middle 70 percent, parted by
    gaps; runs of 25 to 800 facets that span 15 at most."""
    c, n = f"c{axis}", f"n{axis}"
    span = geometry.groupBy("mesh_id").agg(F.min(c).alias("lo"), F.max(c).alias("hi"))
    t = (F.col(c) - F.col("lo")) / F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0))
    mid = geometry.join(span, "mesh_id").where((F.col("hi") - F.col("lo") > 50) & t.between(0.15, 0.85) & (F.abs(F.col(n)) > 0.40))
    return gap_clusters(mid, ["mesh_id"], c, gap).where((F.col("n").between(25, 800)) & (F.col("last") - F.col("first") <= 15))


def coverage(segments: DataFrame) -> DataFrame:
    """(mesh_id, covered, n): facets on planes and cylinders, and all."""
    return segments.where("tri IS NOT NULL").groupBy("mesh_id").agg(F.countDistinct(F.when(F.col("type") != "freeform", F.col("tri"))).alias("covered"), F.countDistinct("tri").alias("n"))
