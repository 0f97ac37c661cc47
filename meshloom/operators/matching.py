"""Joins to the catalogs (threads, materials) and pairings of cylinders, shells, loops and boxes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meshloom.functions.catalogs import MATERIALS, names, threads
from meshloom.functions.geometry import dot, interval_overlap, line_distance, vec
from meshloom.functions.text import material_key

# fixed values: nominal sizes of the first and second choice
FIRST_SERIES = (1.0, 1.2, 1.6, 2.0, 2.5, 3.0, 4.0, 5.0, 6.0, 8.0, 10.0, 12.0, 16.0, 20.0, 24.0, 30.0, 36.0, 42.0, 48.0, 56.0, 64.0)
SECOND_SERIES = (1.4, 1.8, 3.5, 7.0, 14.0, 18.0, 22.0, 27.0, 33.0, 39.0, 45.0, 52.0, 60.0)


def match_thread(bores: DataFrame, diameter: str, internal: bool = True, tolerance: float = 0.45) -> DataFrame:
    """bores with the best thread for a measured diameter: least score within the tolerance, ties to the smaller size.

    Internal: the least of the distances to the tap drill, to the nominal size plus 0.15, and to the minor diameter;
    plus 0.25 off the preferred series. External: the distance to the nominal size, plus 0.20. Null where none fits.
    The distinct diameters meet the catalog (34 rows, broadcast) once each.
    """
    d = F.col("d")
    t = F.broadcast(threads(bores.sparkSession))
    near = F.least(F.abs(d - F.col("tap_drill")), F.abs(d - F.col("nominal")) + 0.15, F.abs(d - F.col("minor_internal"))) if internal else F.abs(d - F.col("nominal"))
    score = near + F.when(F.col("preferred"), 0.0).otherwise(0.25 if internal else 0.20)
    sizes = bores.select(F.col(diameter).cast("double").alias("d")).where("d IS NOT NULL").distinct()
    scored = sizes.join(t, F.abs(d - F.col("nominal")) <= F.col("nominal") - F.col("tap_drill") + 1.0).withColumn("score", score).where(F.col("score") <= tolerance)
    best = scored.groupBy("d").agg(F.min(F.struct("score", "pos", "designation", "nominal", "pitch")).alias("t"))
    return bores.join(best.select("d", "t.designation", "t.nominal", "t.pitch", "t.score"), F.col(diameter).cast("double") == d, "left").drop("d")


def match_thread_pair(pairs: DataFrame, bore: str, crest: str, worst: float = 1.35) -> DataFrame:
    """pairs with the best thread for a bore and a crest diameter: both errors at most 0.85, the weighted score at most `worst`."""
    b, c = F.col("b"), F.col("c")
    nominal, drill = F.abs(c - F.col("nominal")), F.abs(b - F.col("tap_drill"))
    deep = F.abs((c - b) - (F.col("nominal") - F.col("tap_drill")))
    penalty = F.when(F.col("nominal").isin(*FIRST_SERIES), 0.0).when(F.col("nominal").isin(*SECOND_SERIES), 0.05).otherwise(0.20)
    sizes = pairs.select(F.col(bore).cast("double").alias("b"), F.col(crest).cast("double").alias("c")).where("b IS NOT NULL AND c IS NOT NULL").distinct()
    scored = sizes.join(F.broadcast(threads(pairs.sparkSession)), (nominal <= 0.85) & (drill <= 0.85)).withColumn("score", nominal + drill + deep * 0.4 + penalty).where(F.col("score") <= worst)
    best = scored.groupBy("b", "c").agg(F.min(F.struct("score", "pos", "designation")).alias("t")).select("b", "c", "t.designation", "t.score")
    return pairs.join(best, (F.col(bore).cast("double") == b) & (F.col(crest).cast("double") == c), "left").drop("b", "c")


def resolve_materials(rows: DataFrame, name: str, fallback: str = "steel") -> DataFrame:
    """rows with material_id: the whole key as a name, else its first pair of words that is one, else its first word,
    else the first material of five letters or more that the key holds or begins, else `fallback`. Each different name is
    resolved once; names are a broadcast table of fixed size."""
    known = F.broadcast(names(rows.sparkSession))
    keyed = rows.select(F.col(name).alias("raw")).distinct().withColumn("key", F.coalesce(material_key(F.col("raw")), F.lit("")))
    words = F.split("key", "_")
    n = F.size(words)
    pair = F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.when((i < n) & (F.element_at(words, i) != "") & (F.try_element_at(words, i + 1) != ""), F.concat_ws("_", F.element_at(words, i), F.try_element_at(words, i + 1))))
    tries = F.concat(
        F.array(F.struct(F.lit(0).alias("stage"), F.lit(0).alias("at"), F.col("key").alias("name"))),
        F.transform(pair, lambda p, i: F.struct(F.lit(1).alias("stage"), i.alias("at"), p.alias("name"))),
        F.transform(words, lambda w, i: F.struct(F.lit(2).alias("stage"), i.alias("at"), w.alias("name"))),
    )
    found = keyed.select("raw", F.explode(tries).alias("t")).select("raw", "t.*").join(known, "name").groupBy("raw").agg(F.min(F.struct("stage", "at", "id"))["id"].alias("named"))
    long = F.lit(None).cast("string")
    for m in reversed([m[0] for m in MATERIALS if len(m[0]) >= 5]):
        long = F.when(F.contains(F.col("key"), F.lit(m)) | ((F.length("key") >= 4) & F.startswith(F.lit(m), F.col("key"))), m).otherwise(long)
    out = keyed.join(found, "raw", "left").select("raw", F.when(F.col("key") == "", fallback).otherwise(F.coalesce("named", long, F.lit(fallback))).alias("material_id"))
    return rows.join(out, F.col(name).eqNullSafe(F.col("raw")), "left").drop("raw")


def assign_materials(bodies: DataFrame, spec: DataFrame, fallback: str = "aluminum") -> DataFrame:
    """bodies (mesh_id, idx, role, name) with a material: the rule for all, else for the index, else for the role, else the
    first whose word the name holds (spec: scope, key, ord, material_id), else the role's and name's heuristics."""
    s = F.broadcast(spec)
    hit = bodies.join(s, (F.col("scope") == "all") | ((F.col("scope") == "index") & (F.col("key") == F.col("idx").cast("string"))) | ((F.col("scope") == "role") & (F.col("key") == F.col("role"))) | ((F.col("scope") == "name") & F.contains("name", F.col("key"))), "left")
    rank = F.when(F.col("scope") == "all", 0).when(F.col("scope") == "index", 1).when(F.col("scope") == "role", 2).otherwise(3)
    best = hit.groupBy("mesh_id", "idx", "role", "name").agg(F.min(F.when(F.col("scope").isNotNull(), F.struct(rank.alias("rank"), "ord", "material_id")))["material_id"].alias("given"))
    return best.select("mesh_id", "idx", "role", "name", F.coalesce("given", heuristic_material(F.lower(F.concat_ws(" ", "role", "name"))), F.lit(fallback)).alias("material_id"))


def heuristic_material(text: Column) -> Column:
    out = F.lit(None).cast("string")
    for words, material in reversed([("lens|window|glass", "glass"), ("gasket|seal|o-ring", "rubber"), ("bolt|screw|shaft|pin", "steel"), ("bush|bearing", "brass"), ("clip|snap|cover", "abs")]):
        out = F.when(text.rlike(words), material).otherwise(out)
    return out


def revolute_pairs(cylinders: DataFrame) -> DataFrame:
    """Pins in sockets: an external cylinder in an internal one of another shell of the mesh, nearly parallel, axes 0.65
    apart at most at the middle of their common length, with a clearance of 0.12 to 2."""
    side = lambda p, inner: cylinders.where(F.col("is_internal") == inner).select("mesh_id", *[F.col(c).alias(f"{p}_{c}") for c in ("id", "shell_id", "x", "y", "z", "ax", "ay", "az", "radius", "lo", "hi")])
    v = lambda p, *c: vec(*[f"{p}_{k}" for k in c])
    s, q = side("s", True), side("p", False)
    overlap = interval_overlap(F.col("s_lo"), F.col("s_hi"), F.col("p_lo"), F.col("p_hi"))
    gap = F.col("s_radius") - F.col("p_radius")
    near = line_distance(v("p", "x", "y", "z"), v("s", "x", "y", "z"), v("s", "ax", "ay", "az")) <= 0.65
    return s.join(q, "mesh_id").where((F.col("s_shell_id") != F.col("p_shell_id")) & (gap > 0) & gap.between(0.12, 2.0) & (F.abs(dot(v("s", "ax", "ay", "az"), v("p", "ax", "ay", "az"))) >= 0.95) & (overlap > 0) & near).select(
        "mesh_id", F.col("s_id").alias("socket"), F.col("p_id").alias("pin"), gap.alias("clearance"), overlap.alias("overlap")
    )


def axis_gaps(boxes: DataFrame, keys: list[str], least: float = 0.10, most: float = 3.0) -> DataFrame:
    """Pairs of boxes (keys, id, min_*, max_*) that one axis alone parts, by a gap of `least` to `most`; the axis and the gap."""
    a = boxes.select(*keys, *[F.col(c).alias(f"a_{c}") for c in boxes.columns if c not in keys])
    b = boxes.select(*keys, *[F.col(c).alias(f"b_{c}") for c in boxes.columns if c not in keys])
    gap = {k: F.greatest(F.col(f"a_min_{k}") - F.col(f"b_max_{k}"), F.col(f"b_min_{k}") - F.col(f"a_max_{k}")) for k in "xyz"}
    parted = sum(((g > 0.05).cast("int") for g in gap.values()), F.lit(0))
    wide, axis = F.greatest(*gap.values()), F.when(gap["x"] > 0.05, "X").when(gap["y"] > 0.05, "Y").otherwise("Z")
    return a.join(b, keys).where(F.col("a_id") < F.col("b_id")).select(*keys, "a_id", "b_id", parted.alias("parted"), axis.alias("axis"), wide.alias("gap")).where((F.col("parted") == 1) & F.col("gap").between(least, most)).drop("parted")


def smallest_enclosing(inner: DataFrame, outer: DataFrame, keys: list[str], slack: float = 1e-3) -> DataFrame:
    """inner (keys, id, min_*, max_*) with the enclosing box of outer (keys, id, size, min_*, max_*) of least size, ties to the least id."""
    i = inner.select(*keys, F.col("id").alias("inner_id"), *[F.col(f"{m}_{k}").alias(f"i_{m}_{k}") for m in ("min", "max") for k in "xyz"])
    inside = F.lit(True)
    for k in "xyz":
        inside = inside & (F.col(f"i_min_{k}") >= F.col(f"min_{k}") - slack) & (F.col(f"i_max_{k}") <= F.col(f"max_{k}") + slack)
    best = i.join(outer, keys).where(inside).groupBy(*keys, "inner_id").agg(F.min(F.struct("size", "id"))["id"].alias("outer_id"))
    return i.select(*keys, "inner_id").join(best, [*keys, "inner_id"], "left")


def majority(votes: DataFrame, keys: list[str], choice: str) -> DataFrame:
    """The choice that most rows of a key make; ties to the least."""
    return votes.groupBy(*keys, choice).agg(F.count("*").alias("n")).groupBy(*keys).agg(F.min(F.struct((-F.col("n")).alias("m"), choice)).alias("b")).select(*keys, F.col(f"b.{choice}").alias(choice), (-F.col("b.m")).alias("n"))


def groups_by_tolerance(rows: DataFrame, keys: list[str], value: str, tolerance: float) -> DataFrame:
    """rows with `cluster`: values of a key in order are parted where neighbours differ by more than the tolerance; numbered from 0."""
    order = Window.partitionBy(*keys).orderBy(value)
    fresh = (F.col(value) - F.lag(value).over(order) > tolerance).cast("long")
    marked = rows.select(*keys, value).distinct().withColumn("fresh", F.coalesce(fresh, F.lit(0)))
    named = marked.withColumn("cluster", F.sum("fresh").over(order)).drop("fresh")
    return rows.join(named, [*keys, value])
