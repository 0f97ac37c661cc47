"""Reports: context budgets, compact strings, manufacturing notes, and the summary document."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meshloom.functions.geometry import rounded
from meshloom.functions.text import tokens_estimate

#: Holes, fillets and chamfers that a context tier keeps; None keeps all. Fixed values.
TIERS = {"4k": (8, 10, 10), "8k": (25, 30, 30), "32k": (None, None, None), "128k": (None, None, None)}


def truncated(rows: DataFrame, keys: list[str], order: str, most: int | None) -> DataFrame:
    """The first `most` rows of each key by `order`; all if it is None."""
    if most is None:
        return rows
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    return rows.withColumn("_k", place).where(F.col("_k") <= most).drop("_k")


def hole_text(holes: DataFrame) -> DataFrame:
    """holes with dsl, a compact line: id, diameter x depth, thread."""
    return holes.withColumn("dsl", F.concat_ws(" ", "id", F.format_string("D%.2fx%.2f", "diameter", "depth"), "designation"))


def notes(holes: DataFrame, joints: DataFrame | None = None) -> DataFrame:
    """(mesh_id, nozzle, layer, notes): print settings by the narrowest hole, a note for threads, and one for each joint
    (mesh_id, a_id, b_id, gap) with its clearance."""
    g = holes.groupBy("mesh_id").agg(F.min("diameter").alias("d"), F.count("designation").alias("n_threads"))
    if joints is not None:
        said = F.format_string("joint %s-%s: keep a clearance of %.2f", F.col("a_id").cast("string"), F.col("b_id").cast("string"), F.col("gap"))
        g = g.join(joints.groupBy("mesh_id").agg(F.array_sort(F.collect_list(said)).alias("each")), "mesh_id", "full").na.fill(0, ["n_threads"])
    else:
        g = g.withColumn("each", F.lit(None).cast("array<string>"))
    fine, mid = F.coalesce(F.col("d") <= 2.5, F.lit(False)), F.coalesce(F.col("d") <= 4.0, F.lit(False))
    note = F.filter(F.array(F.when(fine, F.lit("narrow holes: use a fine nozzle")), F.when(F.col("n_threads") > 0, F.lit("tap threaded holes after printing"))), lambda x: x.isNotNull())
    return g.select("mesh_id", F.when(fine, 0.25).otherwise(0.40).alias("nozzle"), F.when(fine, 0.12).when(mid, 0.16).otherwise(0.20).alias("layer"), F.concat(note, F.coalesce("each", F.array())).alias("notes"))


def mass_rollup(shell: DataFrame, materials: DataFrame) -> DataFrame:
    """(mesh_id, mass_g, transparent): shells (mesh_id, signed_volume, material_id) by their materials' density."""
    s = shell.join(materials.select(F.col("id").alias("material_id"), "density_g_cm3", "transparency"), "material_id")
    return s.groupBy("mesh_id").agg(rounded(F.sum(F.abs("signed_volume") / 1000.0 * F.col("density_g_cm3")), 4).alias("mass_g"), F.bool_or(F.col("transparency") > 0).alias("transparent"))


def first_places(rows: DataFrame, keys: list[str], order: str, column: str, most: int) -> DataFrame:
    """(keys, places): the first `most` values of a column by `order`."""
    return truncated(rows, keys, order, most).groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(column).alias("v")))), lambda s: s["v"]).alias("places"))


def compact(holes: DataFrame, blends: DataFrame, joints: DataFrame, most: int = 5) -> DataFrame:
    """(mesh_id, dsl): one line a mesh: counts, then the first few holes, fillets and chamfers by number, joints."""
    h = first_places(hole_text(holes), ["mesh_id"], "id", "dsl", most).withColumnRenamed("places", "first")
    n = holes.groupBy("mesh_id").agg(F.count("*").alias("n_holes"), F.count("designation").alias("n_threads"))
    b = blends.groupBy("mesh_id").agg(*[F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in ("fillet", "chamfer")])
    j = joints.groupBy("mesh_id").agg(F.count("*").alias("n_joints"))
    a = n.join(h, "mesh_id", "left").join(b, "mesh_id", "full").join(j, "mesh_id", "full").na.fill(0)
    parts = [F.format_string("holes %d (%d threaded)", "n_holes", "n_threads"), F.array_join("first", "; "), F.format_string("fillets %d", "n_fillet"), F.format_string("chamfers %d", "n_chamfer"), F.format_string("joints %d", "n_joints")]
    return a.select("mesh_id", F.concat_ws(" | ", *parts).alias("dsl"))


def summary(analysis: DataFrame, holes: DataFrame, joints: DataFrame, tier: str = "8k", blends: DataFrame | None = None, patterns: DataFrame | None = None, mass: DataFrame | None = None) -> DataFrame:
    """(mesh_id, document, tokens): a JSON document for each mesh with its features, cut to a context tier. blends (mesh_id,
    surface_id, kind, size), patterns (kernels.bolt_circles()) and mass (mesh_id, mass_g) add to it where they are given."""
    most_holes, *most_blends = TIERS[tier]
    h = truncated(hole_text(holes), ["mesh_id"], "id", most_holes).groupBy("mesh_id").agg(F.array_sort(F.collect_list(F.struct("id", "diameter", "depth", "designation", "dsl"))).alias("holes"))
    total = holes.groupBy("mesh_id").agg(F.count("*").alias("n_holes"))
    j = joints.groupBy("mesh_id").agg(F.array_sort(F.collect_list(F.struct("a_id", "b_id", "axis", "gap"))).alias("joints"))
    a = analysis.join(h, "mesh_id", "left").join(total, "mesh_id", "left").join(j, "mesh_id", "left").join(notes(holes, joints), "mesh_id", "left")
    more = []
    if blends is not None:
        for kind, most in zip(("fillet", "chamfer"), most_blends, strict=True):
            rows = truncated(blends.where(F.col("kind") == kind), ["mesh_id"], "surface_id", most).groupBy("mesh_id").agg(F.array_sort(F.collect_list(F.struct("surface_id", "size"))).alias(f"{kind}s"))
            a = a.join(rows, "mesh_id", "left")
            more.append(F.coalesce(f"{kind}s", F.array()).alias(f"{kind}s"))
    if patterns is not None:
        rows = patterns.where("error IS NULL").groupBy("mesh_id").agg(F.array_sort(F.collect_list(F.struct("pattern_id", "n", rounded(F.col("pcd"), 3).alias("pcd"), "equispaced"))).alias("patterns"))
        a = a.join(rows, "mesh_id", "left")
        more.append(F.coalesce("patterns", F.array()).alias("patterns"))
    if mass is not None:
        a = a.join(mass.select("mesh_id", "mass_g"), "mesh_id", "left")
        more.append(F.col("mass_g"))
    body = F.struct(
        F.struct("n_tri", "n_vertices", "open_edges", "chi", "n_shells", "n_cavities", "watertight").alias("topology"), F.struct("volume", "area").alias("mass"),
        F.coalesce("n_holes", F.lit(0)).alias("n_holes"), F.coalesce("holes", F.array()).alias("holes"), F.coalesce("joints", F.array()).alias("joints"), F.struct("nozzle", "layer", "notes").alias("print"), *more,
    )
    return a.select("mesh_id", F.to_json(body).alias("document")).withColumn("tokens", tokens_estimate(F.col("document")))
