"""Bodies of an assembly: metrics on stored coordinates, roll-ups, order, and the part that each body plays."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meshloom.functions.geometry import rounded, signed_volume, triangle_area

ROLES = ("base", "arm", "strut")


def stored_metrics(facet: DataFrame, labels: DataFrame) -> DataFrame:
    """(mesh_id, shell_id, n_tri, volume, area, min_x .. max_z) of shells on coordinates of five decimals, as files hold them."""
    p = [tuple(rounded(F.col(f"{c}{k}").cast("double"), 5) for c in "xyz") for k in range(3)]
    side = lambda f, g, i: f(g(*[p[k][i] for k in range(3)]))
    bound = [side(*fg, i).alias(f"{m}_{c}") for m, fg in (("min", (F.min, F.least)), ("max", (F.max, F.greatest))) for i, c in enumerate("xyz")]
    f = facet.join(labels, ["mesh_id", "tri"])
    return f.groupBy("mesh_id", "shell_id").agg(F.count("*").alias("n_tri"), F.abs(F.sum(signed_volume(*p))).alias("volume"), F.sum(triangle_area(*p)).alias("area"), *bound)


def rolled_up(metrics: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, bodies, n_tri, volume, area, min_x .. max_z): metrics of bodies as one, partial sums before the shuffle."""
    return metrics.groupBy(*keys).agg(
        F.count("*").alias("bodies"), F.sum("n_tri").alias("n_tri"), F.sum("volume").alias("volume"), F.sum("area").alias("area"),
        *[F.min(f"min_{c}").alias(f"min_{c}") for c in "xyz"], *[F.max(f"max_{c}").alias(f"max_{c}") for c in "xyz"],
    )


def ordered(bodies: DataFrame, keys: list[str], step: float = 1e-3) -> DataFrame:
    """bodies with `no`, from 1: by the lowest z (in steps), then the greatest volume, then id."""
    w = Window.partitionBy(*keys).orderBy(F.floor(F.col("min_z") / step + 0.5), F.abs("signed_volume").desc(), "id")  # the bodies of one mesh
    return bodies.withColumn("no", F.row_number().over(w).cast("long"))


Strategy = tuple[str, Callable[[DataFrame], Column], Callable[[DataFrame], DataFrame]]


def _folding(b: DataFrame) -> DataFrame:
    """Of three bodies and two hinges: the short one is the strut, of the others the one that begins left by 5 is the arm, or
    else the one that is by both hinges."""
    mesh = Window.partitionBy("mesh_id")  # three bodies
    length = F.col("max_y") - F.col("min_y")
    b = b.withColumn("short", length < 0.65 * F.max(length).over(mesh)).withColumn("one_short", F.sum(F.col("short").cast("int")).over(mesh) == 1)
    left = F.when(~F.col("short"), F.col("min_x"))
    b = b.withColumn("first", F.min(left).over(mesh)).withColumn("last", F.max(left).over(mesh)).withColumn("both", F.sum(F.when(~F.col("short"), F.col("by_both").cast("int"))).over(mesh))
    far = F.col("first") < F.col("last") - 5.0
    arm = F.when(far, F.col("min_x") == F.col("first")).when(F.col("both") == 1, F.col("by_both")).otherwise(F.col("no") != F.min(F.when(~F.col("short"), F.col("no"))).over(mesh))
    role = F.when(F.col("short"), "strut").when(arm, "arm").otherwise("base")
    by_place = F.element_at(F.array(*[F.lit(r) for r in ROLES]), F.col("no").cast("int"))
    return b.withColumn("role", F.when(F.col("one_short"), role).otherwise(by_place)).drop("short", "one_short", "first", "last", "both")


def _in_order(b: DataFrame) -> DataFrame:
    place = F.col("no").cast("int")
    return b.withColumn("role", F.when(place <= len(ROLES), F.element_at(F.array(*[F.lit(r) for r in ROLES]), F.least(place, F.lit(len(ROLES))))).otherwise("component"))


#: Tried in order; the last holds for any mesh. Callers may put their own before them.
STRATEGIES: list[Strategy] = [
    ("single", lambda b: F.col("n_bodies") == 1, lambda b: b.withColumn("role", F.lit("base"))),
    ("folding", lambda b: (F.col("n_bodies") == 3) & (F.col("n_hinges") >= 2), _folding),
    ("in order", lambda b: F.lit(True), _in_order),
]


def classified(bodies: DataFrame, hinges: DataFrame, strategies: list[Strategy] | None = None) -> DataFrame:
    """(mesh_id, id, no, role, strategy): bodies (mesh_id, id, signed_volume, min_x .. max_z) by the first strategy that takes
    their mesh. hinges: mesh_id, no, x..z."""
    near = F.lit(True)
    for c in "xyz":
        near &= F.col(c).between(F.col(f"min_{c}") - 4.0, F.col(f"max_{c}") + 4.0)
    count = hinges.groupBy("mesh_id").agg(F.count("*").alias("n_hinges"))
    first = hinges.where("no <= 2").select(F.col("mesh_id").alias("of"), *"xyz")
    by = bodies.join(first, (F.col("mesh_id") == F.col("of")) & near).groupBy("mesh_id", "id").agg((F.count("*") >= 2).alias("by_both"))
    b = ordered(bodies, ["mesh_id"]).join(count, "mesh_id", "left").join(by, ["mesh_id", "id"], "left").na.fill({"n_hinges": 0, "by_both": False})
    b = b.withColumn("n_bodies", F.count("*").over(Window.partitionBy("mesh_id")))
    out, taken = None, F.lit(False)
    for name, takes, give in strategies or STRATEGIES:
        mine = give(b.where(takes(b) & ~taken)).select("mesh_id", "id", "no", "role", F.lit(name).alias("strategy"))
        taken = taken | takes(b)
        out = mine if out is None else out.unionByName(mine)
    return out
