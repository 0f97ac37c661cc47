"""Spatial joins: grid cells, pairs within a distance, sewing, nearest in rings, plane buckets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meshloom.functions.geometry import distance, quantized, vec


def cell(c: str, step: float):
    return F.floor(F.col(c) / F.lit(step)).cast("long")


def grid_buckets(points: DataFrame, keys: list[str], step: float) -> DataFrame:
    return points.groupBy(*keys, *[cell(c, step).alias(f"g{c}") for c in "xyz"]).agg(F.count("*").alias("n"))


def distance_pairs(points: DataFrame, keys: list[str], most: float) -> DataFrame:
    """(keys, a, b, distance) for pairs of points (keys, id, x, y, z) within `most`, a < b.

    One side keeps its cell, the other goes to the 27 cells around its own: an equi-join on cells, no cross join."""
    own = points.select(*keys, F.col("id").alias("a"), *[F.col(c).cast("double").alias(f"a{c}") for c in "xyz"], *[cell(c, most).alias(f"g{c}") for c in "xyz"])
    other = points.select(*keys, F.col("id").alias("b"), *[F.col(c).cast("double").alias(f"b{c}") for c in "xyz"], *[cell(c, most).alias(f"g{c}") for c in "xyz"])
    for c in "xyz":
        other = other.withColumn(f"g{c}", F.explode(F.array(*[F.col(f"g{c}") + d for d in (-1, 0, 1)])))
    d = distance(vec("ax", "ay", "az"), vec("bx", "by", "bz"))
    return own.join(other, [*keys, "gx", "gy", "gz"]).where(F.col("a") < F.col("b")).select(*keys, "a", "b", d.alias("distance")).where(F.col("distance") <= most)


def chained(pairs: DataFrame, key: str = "mesh_id") -> DataFrame:
    """(key, id, rep): ids that pairs (key, a, b) join, in chains of any length, each with the least id of its chain. The pairs
    of one key are one kernel's work."""
    import numpy as np
    import pandas as pd

    def label(pdf: pd.DataFrame) -> pd.DataFrame:
        vid, at = np.unique(pdf[["a", "b"]].to_numpy(np.int64), return_inverse=True)
        a, b = at.reshape(-1, 2).T
        lab = np.arange(len(vid))
        while True:
            new = lab.copy()
            np.minimum.at(new, a, lab[b])
            np.minimum.at(new, b, lab[a])
            new = new[new]
            if (new == lab).all():
                break
            lab = new
        return pd.DataFrame({key: pdf[key].iloc[0], "id": vid, "rep": vid[lab]})

    return pairs.select(key, "a", "b").groupBy(key).applyInPandas(label, f"{key} string, id long, rep long")


def sewn(vertex: DataFrame, triangle: DataFrame, tolerance: float = 0.005) -> DataFrame:
    """triangle with corners of open edges that lie within the tolerance of each other taken as one, the least of their ids.
    Chains of near points become one vertex whatever their order and length: the least of the chain's ids."""
    from .topology import boundary_half_edges

    loose = boundary_half_edges(triangle).select("mesh_id", F.explode(F.array("u", "v")).alias("vid")).distinct()
    pts = vertex.join(loose, ["mesh_id", "vid"]).select("mesh_id", F.col("vid").alias("id"), "x", "y", "z")
    to = chained(distance_pairs(pts, ["mesh_id"], tolerance))
    out = triangle
    for k in range(3):
        t = to.select("mesh_id", F.col("id").alias(f"i{k}"), F.col("rep").alias(f"r{k}"))
        out = out.join(t, ["mesh_id", f"i{k}"], "left").withColumn(f"i{k}", F.coalesce(f"r{k}", f"i{k}")).drop(f"r{k}")
    return out.where("i0 <> i1 AND i1 <> i2 AND i0 <> i2").select("mesh_id", "tri", "i0", "i1", "i2")


def nearest_in_rings(samples: DataFrame, targets: DataFrame, keys: list[str], step: float, rings: int = 2) -> DataFrame:
    """samples with the nearest target of the first ring of cells (0..rings) that holds any; ties to the least id; null beyond.

    A ring's cells that hold no target are left out before samples are sent there: each sample meets the different cells of
    targets (a small table of counts), takes its first ring that holds any, and goes to that ring's full cells only."""
    g = [cell(c, step).alias(f"g{c}") for c in "xyz"]
    s = samples.select(*keys, F.col("id").alias("s"), *[F.col(c).cast("double").alias(f"s{c}") for c in "xyz"], *g)
    t = targets.select(*keys, F.col("id").alias("t"), *[F.col(c).cast("double").alias(f"t{c}") for c in "xyz"], *g)
    at, own = [*keys, "gx", "gy", "gz"], [*keys, "ox", "oy", "oz"]
    reach = range(-rings, rings + 1)
    around = F.array(*[F.struct(F.lit(max(abs(i), abs(j), abs(k))).alias("ring"), F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(k).alias("k")) for i in reach for j in reach for k in reach])
    asked = s.select(*keys, F.col("gx").alias("ox"), F.col("gy").alias("oy"), F.col("gz").alias("oz")).distinct().withColumn("o", F.explode(around))
    asked = asked.select(*own, F.col("o.ring").alias("ring"), *[(F.col(f"o{c}") + F.col(f"o.{k}")).alias(f"g{c}") for c, k in zip("xyz", "ijk", strict=True)])
    full = asked.join(t.select(*at).distinct(), at)
    first = full.groupBy(*own).agg(F.min("ring").alias("ring"))
    cells = full.join(first, [*own, "ring"])
    wide = s.select(*keys, "s", "sx", "sy", "sz", F.col("gx").alias("ox"), F.col("gy").alias("oy"), F.col("gz").alias("oz")).join(cells, own)
    met = wide.join(t, at).select(*keys, "s", "ring", "t", distance(vec("sx", "sy", "sz"), vec("tx", "ty", "tz")).alias("d"))
    best = met.groupBy(*keys, "s").agg(F.min(F.struct("ring", "d", "t")).alias("m"))
    return s.select(*keys, "s").join(best, [*keys, "s"], "left").select(*keys, F.col("s").alias("id"), F.col("m.t").alias("target"), F.col("m.d").alias("distance"), F.col("m.ring").alias("ring"))


def in_box(points: DataFrame, low: tuple[float, float, float], high: tuple[float, float, float]) -> DataFrame:
    ok = F.lit(True)
    for c, a, b in zip("xyz", low, high, strict=True):
        ok = ok & F.col(c).between(a, b)
    return points.where(ok)


def plane_buckets(facet: DataFrame, keys: list[str], least_area: float = 0.0) -> DataFrame:
    """Facets (keys, tri, nx, ny, nz, offset, area) by normal in twentieths (near-axis normals are the axis) and offset in
    fifths: count and area; areas sum exactly in whole 1e-6."""
    snapped = {c: F.when(F.abs(F.col(f"n{c}")) > 0.998, F.signum(F.col(f"n{c}"))).when(F.greatest(*[F.abs(F.col(f"n{k}")) for k in "xyz" if k != c]) > 0.998, 0.0).otherwise(F.col(f"n{c}")) for c in "xyz"}
    q = facet.select(*keys, *[quantized(e, 0.05).alias(f"q{c}") for c, e in snapped.items()], quantized(F.col("offset"), 0.2).alias("qd"), F.floor(F.col("area") * 1e6 + 0.5).cast("long").alias("a"))
    return q.groupBy(*keys, "qx", "qy", "qz", "qd").agg(F.count("*").alias("n"), (F.sum("a") / 1e6).alias("area")).where(F.col("area") >= least_area)


def order_statistic(rows: DataFrame, keys: list[str], value: str, share: float = 0.99) -> DataFrame:
    """The value at place min(n - 1, floor(share * n)) in ascending order, the greatest, and the count: exact.

    Equal values are counted before they are ranked, so a hot key's window holds its different values, not its rows."""
    counted = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("k"))
    part = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    up = part.orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = counted.withColumn("upto", F.sum("k").over(up)).withColumn("n", F.sum("k").over(part))
    at = F.least(F.col("n") - 1, F.floor(F.col("n") * F.lit(share)))
    hit = F.min(F.when(F.col("upto") > at, F.col(value)))
    return ranked.groupBy(*keys).agg(hit.alias("stat"), F.max(value).alias("greatest"), F.max("n").alias("n"))


def running_share(rows: DataFrame, keys: list[str], order: str, weight: str) -> DataFrame:
    """rows with lo and hi, the running sums of whole weights before and after each row."""
    up = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    hi = F.sum(weight).over(up)
    return rows.withColumn("hi", hi).withColumn("lo", F.col("hi") - F.col(weight))


def gap_clusters(rows: DataFrame, keys: list[str], value: str, gap: float) -> DataFrame:
    """Each key's values in runs whose neighbours differ by less than `gap`: first, last and count of each run."""
    part = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    distinct = rows.groupBy(*keys, value).agg(F.count("*").alias("k"))
    order = part.orderBy(value)
    fresh = F.coalesce((F.col(value) - F.lag(value).over(order) >= gap).cast("long"), F.lit(0))
    named = distinct.withColumn("fresh", fresh).withColumn("cluster", F.sum("fresh").over(order))
    return named.groupBy(*keys, "cluster").agg(F.min(value).alias("first"), F.max(value).alias("last"), F.sum("k").alias("n"))


def circular_gaps(rows: DataFrame, keys: list[str], angle: str) -> DataFrame:
    """The widest gap between a key's angles (in degrees, 0 to 360) around the circle, and the span left."""
    order = Window.partitionBy(*keys).orderBy(angle)
    part = Window.partitionBy(*keys)
    nxt = F.coalesce(F.lead(angle).over(order), F.min(angle).over(part) + 360.0)
    g = rows.select(*keys, angle).distinct().withColumn("gap", nxt - F.col(angle))
    return g.groupBy(*keys).agg(F.max("gap").alias("widest"), F.count("*").alias("n")).withColumn("span", 360.0 - F.col("widest"))


def covariance(rows: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Population covariances of each pair of columns and the means, in one pass."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    return rows.groupBy(*keys).agg(F.count("*").alias("n"), *[F.avg(c).alias(f"mean_{c}") for c in columns], *[F.covar_pop(a, b).alias(f"cov_{a}{b}") for a, b in pairs])


def axial_gaps(rows: DataFrame, keys: list[str], place: str) -> DataFrame:
    """(keys, widest, n, span): the widest gap between a key's different places along an axis, their number and their span."""
    order = Window.partitionBy(*keys).orderBy(place)
    g = rows.select(*keys, place).distinct().withColumn("gap", F.col(place) - F.lag(place).over(order))
    return g.groupBy(*keys).agg(F.coalesce(F.max("gap"), F.lit(0.0)).alias("widest"), F.count("*").alias("n"), (F.max(place) - F.min(place)).alias("span"))


def inner_band(rows: DataFrame, keys: list[str], place: str, value: str, low: float = 0.15, high: float = 0.85) -> DataFrame:
    """(keys, n, least, most, depth): a key's values whose place lies in the inner part of its depth. Two grouped passes, no window."""
    ends = rows.groupBy(*keys).agg(F.min(place).alias("lo"), (F.max(place) - F.min(place)).alias("depth"))
    inside = rows.join(ends, keys).where(F.col(place).between(F.col("lo") + F.col("depth") * low, F.col("lo") + F.col("depth") * high))
    return inside.groupBy(*keys).agg(F.count("*").alias("n"), F.min(value).alias("least"), F.max(value).alias("most"), F.first("depth").alias("depth"))


def obstacle_bands(surface: DataFrame, obstacles: DataFrame, keys: list[str], least: float = 0.1) -> DataFrame:
    """(keys, no, lo, hi, obstructed): surfaces (keys, lo, hi) along their axes cut where obstacles (keys, at) begin and end; free
    ends of `least` or less are left out."""
    o = obstacles.groupBy(*keys).agg(F.min("at").alias("a"), F.max("at").alias("b"))
    s = surface.join(o, keys, "left")
    a, b = F.greatest("lo", "a"), F.least("hi", "b")
    band = lambda x, y, z: F.struct(x.alias("lo"), y.alias("hi"), F.lit(z).alias("obstructed"))
    lo, hi = F.col("lo"), F.col("hi")
    some = F.filter(F.array(F.when(a - lo > least, band(lo, a, False)), band(a, b, True), F.when(hi - b > least, band(b, hi, False))), lambda x: x.isNotNull())
    bands = F.when(F.col("a").isNull(), F.array(band(lo, hi, False))).otherwise(some)
    return s.select(*keys, F.posexplode(bands).alias("no", "band")).select(*keys, "no", "band.*")
