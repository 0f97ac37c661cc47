"""The four tools over facet soups or indexed meshes: analyze, detect_threads, verify, convert."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshloom.functions import catalogs
from meshloom.functions.geometry import dot, rounded, vec
from meshloom.operators import bodies, bores, features, kernels, matching, outlines, polygons, reports, topology, verify
from meshloom.operators.staging import kept
from meshloom.plans.options import MANY_FACETS, Options
from meshloom.sources import exchange, glb, step


def indexed(soup: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Welded (vertex, triangle) of facets as read; rows that only carry an error are left out."""
    return topology.weld(soup.where("tri IS NOT NULL"))


def shells_of(vertex: DataFrame, triangle: DataFrame) -> DataFrame:
    return topology.shells(topology.proper(topology.facets(vertex, triangle), 1e-9))


def joints(shell: DataFrame) -> DataFrame:
    s = shell.where("NOT is_cavity").withColumnRenamed("shell_id", "id")
    return matching.axis_gaps(s.select("mesh_id", "id", *[f"{m}_{k}" for m in ("min", "max") for k in "xyz"]), ["mesh_id"])


def kinematics(facet: DataFrame, labels: DataFrame, segments: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(hinges, prismatic): pins in sockets of other shells, one a line; and shells that one axis alone parts, hinged pairs left out."""
    seg = segments.where("error IS NULL")
    own = seg.select("mesh_id", "surface_id", "tri").join(labels, ["mesh_id", "tri"])
    of = matching.majority(own, ["mesh_id", "surface_id"], "shell_id").select("mesh_id", "surface_id", "shell_id")
    c = kernels.surfaces(segments).where("type = 'cylinder' AND span >= 280").join(of, ["mesh_id", "surface_id"])
    lo = dot(vec("x", "y", "z"), vec("ax", "ay", "az"))
    c = c.select("mesh_id", F.col("surface_id").cast("string").alias("id"), "shell_id", "is_internal", "x", "y", "z", "ax", "ay", "az", "radius", lo.alias("lo"), (lo + F.col("height")).alias("hi"))
    axis = c.select("mesh_id", F.col("id").alias("socket"), F.col("shell_id").alias("a_id"), "x", "y", "z", "ax", "ay", "az")
    pairs = matching.revolute_pairs(c).join(axis, ["mesh_id", "socket"])
    hinge = bores.hinges(pairs).where("error IS NULL")
    tied = pairs.join(c.select("mesh_id", F.col("id").alias("pin"), F.col("shell_id").alias("b_id")), ["mesh_id", "pin"]).select("mesh_id", F.least("a_id", "b_id").alias("a_id"), F.greatest("a_id", "b_id").alias("b_id")).distinct()
    return hinge, joints(topology.shells(facet, labels)).join(tied, ["mesh_id", "a_id", "b_id"], "left_anti")


def analyze(vertex: DataFrame, triangle: DataFrame) -> DataFrame:
    return topology.analyze(vertex, triangle)


def holes(facet: DataFrame, segments: DataFrame) -> DataFrame:
    """Bores out of segmented meshes: internal cylinders, paired on their axes, joined by those that plane outlines show, each
    axis once, and only what a bore in this mesh can be. Numbered by level."""
    surface = kernels.surfaces(segments)
    inner = surface.where("type = 'cylinder' AND is_internal AND span >= 280").withColumn("id", F.col("surface_id"))
    found = bores.paired_bores(inner).where("error IS NULL").select("mesh_id", "id", "diameter", "depth", "x", "y", "z", "ax", "ay", "az", "designation")
    one = bores.unique_holes(found).where("error IS NULL")
    corner = facet.select("mesh_id", F.explode(F.array(*[F.struct(*[F.col(f"{c}{k}").alias(c) for c in "xyz"]) for k in range(3)])).alias("p")).select("mesh_id", "p.*")
    planes = surface.where("type = 'plane'").select("mesh_id", F.col("ax").alias("nx"), F.col("ay").alias("ny"), F.col("az").alias("nz"))
    from meshloom.operators.validity import valid_holes

    return valid_holes(one.drop("error"), topology.bounds(corner, ["mesh_id"]), planes)


def detect_threads(vertex: DataFrame, triangle: DataFrame) -> DataFrame:
    """(mesh_id, id, diameter, depth, designation, pitch, score, ..): bores with the thread that fits best, if one does."""
    return features.holes(kernels.surfaces(kernels.segment(topology.facets(vertex, triangle))))


def verify_meshes(vertex: DataFrame, triangle: DataFrame, n: int = 3000, source: tuple[DataFrame, DataFrame] | None = None, tolerance: float = 0.0) -> DataFrame:
    """(mesh_id, no, gate, status) of the five gates. Where the (vertex, triangle) that meshes were made from are given,
    samples are taken there and held against the meshes; else against the surfaces of their own facets."""
    f = topology.facets(vertex, triangle)
    seg = kept(kernels.segment(f))
    s = seg.where("error IS NULL")
    surfaces, inliers = kernels.surfaces(seg), s.select("mesh_id", "surface_id", "tri")
    if source is None:
        residual = verify.residuals(verify.samples(f, n), surfaces, inliers)
    else:
        residual = verify.cross_residuals(verify.samples(topology.facets(*source), n), f, surfaces, inliers)
    a = topology.analyze(vertex, triangle)
    bias = polygons.chordal_bias(surfaces.where("type = 'cylinder'")).withColumnRenamed("volume", "bias")
    volumes = a.select("mesh_id", "volume").join(bias, "mesh_id", "left").select("mesh_id", (F.col("volume") + F.coalesce("bias", F.lit(0.0))).alias("other"))
    return verify.gates(a, features.coverage(seg), joints(shells_of(vertex, triangle)), verify.deviations(residual), volumes)


def gated(vertex: DataFrame, triangle: DataFrame, n: int = 3000, tolerance: float = 0.0) -> DataFrame:
    """verify_meshes() with limits that heed what was found: the share of freeform area as curvature, threads, the tolerance."""
    f = topology.facets(vertex, triangle)
    seg = kept(kernels.segment(f))
    surfaces = kernels.surfaces(seg)
    share = F.sum(F.when(F.col("type") == "freeform", F.col("area")).otherwise(0.0)) / F.sum("area")
    threads = features.holes(surfaces).where("designation IS NOT NULL").groupBy("mesh_id").agg(F.count("*").alias("threads"))
    terms = surfaces.groupBy("mesh_id").agg(share.alias("curvature")).join(threads, "mesh_id", "left").withColumn("tolerance", F.lit(float(tolerance)))
    residual = verify.residuals(verify.samples(f, n), surfaces, seg.where("error IS NULL").select("mesh_id", "surface_id", "tri"))
    return verify.gates(topology.analyze(vertex, triangle), features.coverage(seg), joints(shells_of(vertex, triangle)), verify.deviations(residual), None, terms)


def reports_of(gate: DataFrame) -> DataFrame:
    """(mesh_id, document): each mesh's gates and their roll-up as a JSON document."""
    g = gate.groupBy("mesh_id").agg(F.array_sort(F.collect_list(F.struct("no", "gate", "status"))).alias("gates"))
    return g.join(verify.rollup(gate, ["mesh_id"]).select("mesh_id", F.struct("status", "failed", "warned").alias("summary")), "mesh_id").select("mesh_id", F.to_json(F.struct("gates", "summary")).alias("document"))


def heat_maps(vertex: DataFrame, triangle: DataFrame, gate: DataFrame, mode: str = "failed-only") -> DataFrame:
    """(mesh_id, content): meshes coloured by how far their facets' centres lie from the surfaces found: of all meshes (always), of
    those with a failed gate (failed-only), or none."""
    f = topology.facets(vertex, triangle)
    if mode == "failed-only":
        f = f.join(gate.where("status = 'failed'").select("mesh_id").distinct(), "mesh_id", "left_semi")
    elif mode == "none":
        f = f.where("false")
    seg = kernels.segment(f)
    g = topology.facet_geometry(f)
    centre = g.select("mesh_id", F.col("tri").alias("sample"), "tri", *[F.col(f"c{c}").cast("double").alias(c) for c in "xyz"])
    off = verify.residuals(centre, kernels.surfaces(seg), seg.where("error IS NULL").select("mesh_id", "surface_id", "tri"))
    return glb.heat_maps(f, off.select("mesh_id", "tri", F.col("residual").alias("deviation")))


def freeform_maps(facet: DataFrame, segments: DataFrame) -> DataFrame:
    """(mesh_id, content): meshes in green, with the vertices of freeform facets in orange."""
    free = segments.where("type = 'freeform'").select("mesh_id", "tri").distinct().withColumn("free", F.lit(True))
    return glb.two_colours(facet.join(free, ["mesh_id", "tri"], "left").na.fill({"free": False}))


def simplified(vertex: DataFrame, triangle: DataFrame, target: float | int) -> tuple[DataFrame, DataFrame]:
    """(vertex, triangle) after edge collapse; a mesh that has no more facets than the target goes round the kernel."""
    f = topology.facets(vertex, triangle)
    if isinstance(target, int):
        few = triangle.groupBy("mesh_id").agg(F.count("*").alias("n")).where(F.col("n") <= target).select("mesh_id")
        small, large = f.join(few, "mesh_id", "left_semi"), f.join(few, "mesh_id", "left_anti")
        cols = ["mesh_id", "tri", "i0", "i1", "i2", *kernels.CORNERS]
        done = kernels.simplify(large, target).where("error IS NULL").select(*cols).unionByName(small.select(*cols[:5], *[F.col(c).cast("double").alias(c) for c in kernels.CORNERS]))
    else:
        done = kernels.simplify(f, target).where("error IS NULL")
    p = done.select("mesh_id", F.explode(F.array(*[F.struct(F.col(f"i{k}").alias("vid"), *[F.col(f"{c}{k}").cast("float").alias(c) for c in "xyz"]) for k in range(3)])).alias("p"))
    return p.select("mesh_id", "p.*").dropDuplicates(["mesh_id", "vid"]), done.select("mesh_id", "tri", "i0", "i1", "i2")


def convert(vertex: DataFrame, triangle: DataFrame, out: str | None = None, tier: str = "8k", simplify_to: float | int | None = None) -> DataFrame:
    """(mesh_id, text, document, tokens): an exchange file and a summary for each mesh, written below `out` where it is given."""
    return converted(vertex, triangle, Options(out=out, tier=tier, simplify_to=simplify_to))


def converted(vertex: DataFrame, triangle: DataFrame, options: Options) -> DataFrame:
    """(mesh_id, text, document, tokens): each mesh sanitized, segmented and written as an exchange file with the materials,
    threads and surfaces found, and summed up. What options.emit names is written below options.out, where it is given."""
    if options.y_up:
        vertex = topology.y_up(vertex)
    if options.simplify_to is not None:
        vertex, triangle = simplified(vertex, triangle, options.simplify_to)
    facet, labels = topology.sanitized(vertex, triangle)
    clean = facet.select("mesh_id", "tri", "i0", "i1", "i2")
    segments = kept(kernels.segment(facet))
    surfaces, inliers = kept(kernels.surfaces(segments)), segments.where("error IS NULL").select("mesh_id", "surface_id", "tri")
    shell = kept(topology.shells(facet, labels))
    hinge, prismatic = (kept(x) for x in kinematics(facet, labels, segments))
    hole = kept(features.holes(surfaces))
    solid = shell.where("NOT is_cavity").withColumnRenamed("shell_id", "id")
    body = bodies.classified(solid, hinge)
    named = body.select("mesh_id", (F.col("no") - 1).cast("long").alias("idx"), "role", F.concat_ws("_", F.lit("body"), F.col("no").cast("string"), "role").alias("name"), F.col("id").alias("shell_id"))
    spec = facet.sparkSession.createDataFrame(list(polygons.material_spec(options.material)), "scope string, key string, ord long, material_id string")
    given = matching.resolve_materials(matching.assign_materials(named.select("mesh_id", "idx", "role", "name"), spec).withColumnRenamed("material_id", "asked"), "asked").drop("asked")
    known = catalogs.materials(facet.sparkSession).select(F.col("id").alias("material_id"), "density_g_cm3", "red", "green", "blue", "transparency")
    made = named.join(given, ["mesh_id", "idx", "role", "name"]).join(F.broadcast(known), "material_id")  # 19 rows
    made = kept(made)
    styled = made.select("mesh_id", "shell_id", "name", F.col("red").alias("r"), F.col("green").alias("g"), F.col("blue").alias("b"), "transparency", F.col("material_id").alias("material"), F.col("density_g_cm3").alias("density"))
    threads = hole.where("designation IS NOT NULL").select("mesh_id", "designation")
    files = lambda kind, t: exchange.solids(vertex, t, labels, shell, kind, styled, threads, surfaces, inliers)
    if options.representation == "auto":
        many = clean.groupBy("mesh_id").agg(F.count("*").alias("n")).where(F.col("n") > MANY_FACETS).select("mesh_id")
        solids = files("faceted", clean.join(many, "mesh_id", "left_anti")).unionByName(files("tessellated", clean.join(many, "mesh_id", "left_semi")))
    else:
        solids = files(options.representation, clean)
    mass = reports.mass_rollup(shell.where("NOT is_cavity").join(made.select("mesh_id", "shell_id", "material_id"), ["mesh_id", "shell_id"]), catalogs.materials(facet.sparkSession))
    analysis = kept(topology.analyze(vertex, triangle))
    doc = reports.summary(analysis, hole, prismatic, options.tier, features.blends(surfaces), kernels.bolt_circles(hole), mass)
    if options.out:
        gate = gated(vertex, triangle) if {"report", "heatmap"} & options.emit else None
        if "step" in options.emit:
            step.write_step(solids, f"{options.out}/step")
        if "summary" in options.emit:
            exchange.write_documents(doc.select("mesh_id", "document"), f"{options.out}/summary")
        if "topology" in options.emit:
            exchange.write_documents(exchange.topology_documents(surfaces, inliers, analysis), f"{options.out}/topology")
        if "report" in options.emit:
            exchange.write_documents(reports_of(gate), f"{options.out}/report")
        if "heatmap" in options.emit:
            heat_maps(vertex, triangle, gate, options.heatmap).write.mode("overwrite").parquet(f"{options.out}/heatmap")
    return solids.join(doc, "mesh_id", "left")


def boundary_faces(facet: DataFrame, slack: float = 1e-4) -> DataFrame:
    """(mesh_id, cluster_id, loop_id, ord, vid, x, y, area, parent): outlines of a mesh's coplanar regions, with their holes."""
    return outlines.outlines(facet, outlines.coplanar(facet), slack)


def outline_holes(facet: DataFrame, least_round: float = 0.88, least_radius: float = 0.8, most_radius: float = 40.0) -> DataFrame:
    """(mesh_id, cluster_id, loop_id, x, y, z, nx, ny, nz, radius, roundness): round holes in plane regions, in space."""
    c = outlines.coplanar(facet).where("error IS NULL")
    loops = outlines.outlines(facet, c).where("error IS NULL AND area < 0")
    m = outlines.loop_metrics(loops, ["mesh_id", "cluster_id"])
    m = m.where((F.col("n") >= 12) & (F.col("roundness") >= least_round) & F.col("radius").between(least_radius, most_radius))
    corner = facet.select("mesh_id", F.explode(F.array(*[F.struct(F.col(f"i{k}").alias("vid"), *[F.col(f"{x}{k}").cast("double").alias(f"p{x}") for x in "xyz"]) for k in range(3)])).alias("p")).select("mesh_id", "p.*").dropDuplicates(["mesh_id", "vid"])
    middle = loops.join(corner, ["mesh_id", "vid"]).groupBy("mesh_id", "cluster_id", "loop_id").agg(*[F.avg(f"p{x}").alias(x) for x in "xyz"])
    plane = c.select("mesh_id", "cluster_id", "nx", "ny", "nz").distinct()
    return m.join(middle, ["mesh_id", "cluster_id", "loop_id"]).join(plane, ["mesh_id", "cluster_id"]).select("mesh_id", "cluster_id", "loop_id", "x", "y", "z", "nx", "ny", "nz", rounded(F.col("radius"), 6).alias("radius"), "roundness")


def scanned_holes(vertex: DataFrame, facet: DataFrame) -> DataFrame:
    """(mesh_id, id, diameter, depth, designation, ..): round outlines probed inwards: vertices within the outline's radius (plus
    0.35) along its axis give the depth; those of the middle part of the depth the least and the greatest radius, which a
    thread's bore and crest are matched by, and else its bore alone."""
    from meshloom.operators.spatial import inner_band

    o = outline_holes(facet).withColumn("id", F.xxhash64("cluster_id", "loop_id"))
    p = vertex.select("mesh_id", *[F.col(c).cast("double").alias(f"p{c}") for c in "xyz"])
    w = tuple(F.col(f"p{c}") - F.col(c) for c in "xyz")
    into = tuple(-F.col(f"n{c}") for c in "xyz")
    t = dot(w, into)
    r = F.sqrt(F.greatest(F.lit(0.0), dot(w, w) - t * t))
    probe = F.col("radius") + 0.35
    # a vertex lies along the outline only if it lies in the box around the probe, on each axis
    near = F.lit(True)
    for k, c in enumerate("xyz"):
        near &= (F.abs(into[k]) > 0.999) | (F.abs(w[k]) <= probe + F.abs(into[k]) * 1e4)
    q = o.join(p, "mesh_id").where(near).withColumns({"t": t, "r": r}).where((F.col("t") >= -0.2) & (F.col("r") <= probe)).select("mesh_id", "id", "t", "r")
    band = inner_band(q, ["mesh_id", "id"], "t", "r").where("depth >= 1.5 AND n >= 10").select("mesh_id", "id", (2 * F.col("least")).alias("bore"), (2 * F.col("most")).alias("crest"), "depth")
    pair = matching.match_thread_pair(band, "bore", "crest").withColumnRenamed("designation", "paired").drop("score")
    alone = matching.match_thread(pair, "bore").withColumn("single", F.when(F.col("crest") - F.col("bore") < 0.5, F.col("designation")))
    named = alone.select("mesh_id", "id", rounded(F.col("bore"), 4).alias("bore"), rounded(F.col("crest"), 4).alias("crest"), rounded(F.col("depth"), 4).alias("depth"), F.coalesce("paired", "single").alias("designation"))
    return named.join(o.select("mesh_id", "id", "x", "y", "z", "nx", "ny", "nz"), ["mesh_id", "id"])
