"""Exchange files (STEP): statements, boundary topology and its audit, and a writer of faceted solids."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meshloom.functions.text import references, statements
from meshloom.operators.topology import half_edges


def read_step(spark: SparkSession, path: str) -> DataFrame:
    """(file_id, entity_id, entity_type, rhs) of each statement in a folder's *.st[e]p files."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.[sS][tT]*[pP]").load(path)
    return parse(files.select(F.col("path").alias("file_id"), F.col("content").cast("string").alias("text")))


def parse(files: DataFrame) -> DataFrame:
    """Statements of files (file_id, text): quotes ('' within them) and comments are respected, only the DATA section counts."""
    data = F.regexp_extract("text", r"(?s)\bDATA\s*;(.*?)\bENDSEC\s*;", 1)
    body = F.when(data == "", F.col("text")).otherwise(data)
    s = files.select("file_id", F.explode(statements(body)).alias("s")).select("file_id", F.trim(F.regexp_replace("s", r"\s+", " ")).alias("s"))
    pattern = r"^(#\d+) ?= ?([A-Z0-9_]+) ?\((.*)\)$"
    return s.select("file_id", *[F.regexp_extract("s", pattern, i).alias(n) for i, n in ((1, "entity_id"), (2, "entity_type"), (3, "rhs"))]).where("entity_id <> ''")


def oriented_edges(entities: DataFrame) -> DataFrame:
    """(file_id, face_id, loop_id, ord, u, v): each face's directed edges, from vertex loops and from loops of points."""
    of = lambda *kinds: entities.where(F.col("entity_type").isin(*kinds))
    faces = of("ADVANCED_FACE", "FACE_SURFACE", "FACE").select("file_id", F.col("entity_id").alias("face_id"), F.explode(references(F.col("rhs"))).alias("bound"))
    bounds = of("FACE_BOUND", "FACE_OUTER_BOUND").select("file_id", F.col("entity_id").alias("bound"), references(F.col("rhs"))[0].alias("loop_id"), (~F.col("rhs").rlike(r"\.F\.\s*$")).alias("sense"))
    loops = faces.join(bounds, ["file_id", "bound"])
    poly = of("POLY_LOOP").select("file_id", F.col("entity_id").alias("loop_id"), references(F.col("rhs")).alias("p"))
    ring = F.transform("p", lambda x, i: F.struct(i.cast("long").alias("ord"), x.alias("u"), F.element_at("p", (i + 1) % F.size("p") + 1).alias("v")))
    from_points = poly.select("file_id", "loop_id", F.explode(ring).alias("e")).select("file_id", "loop_id", "e.*")
    curve = of("EDGE_CURVE").select("file_id", F.col("entity_id").alias("curve"), references(F.col("rhs"))[0].alias("a"), references(F.col("rhs"))[1].alias("b"))
    oriented = of("ORIENTED_EDGE").select("file_id", F.col("entity_id").alias("oe"), F.element_at(references(F.col("rhs")), -1).alias("curve"), (~F.col("rhs").rlike(r"\.F\.\s*$")).alias("forward"))
    edge_loops = of("EDGE_LOOP").select("file_id", F.col("entity_id").alias("loop_id"), F.posexplode(references(F.col("rhs"))).alias("ord", "oe"))
    from_edges = edge_loops.join(oriented, ["file_id", "oe"]).join(curve, ["file_id", "curve"]).select("file_id", "loop_id", F.col("ord").cast("long").alias("ord"), F.when(F.col("forward"), F.col("a")).otherwise(F.col("b")).alias("u"), F.when(F.col("forward"), F.col("b")).otherwise(F.col("a")).alias("v"))
    both = loops.join(from_points.unionByName(from_edges), ["file_id", "loop_id"])
    return both.select("file_id", "face_id", "loop_id", "ord", F.when(F.col("sense"), F.col("u")).otherwise(F.col("v")).alias("u"), F.when(F.col("sense"), F.col("v")).otherwise(F.col("u")).alias("v"))


def audit(entities: DataFrame) -> DataFrame:
    """One row a file: vertices, edges, faces, Euler characteristic, open, non-manifold and inverted edges, watertight."""
    he = oriented_edges(entities).where("u <> v")
    e = he.groupBy("file_id", F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).agg(F.count("*").alias("n"), F.sum(F.when(F.col("u") < F.col("v"), 1).otherwise(-1)).alias("o"))
    g = e.groupBy("file_id").agg(F.count("*").alias("edges"), F.count_if(F.expr("n = 1")).alias("open_edges"), F.count_if(F.expr("n > 2")).alias("non_manifold_edges"), F.count_if(F.expr("n = 2 AND o <> 0")).alias("inverted_edges"))
    v = he.select("file_id", "u").distinct().groupBy("file_id").agg(F.count("*").alias("vertices"))
    loops = he.select("file_id", "face_id", "loop_id").distinct().groupBy("file_id").agg(F.countDistinct("face_id").alias("faces"), F.count("*").alias("loops"))
    out = g.join(v, "file_id").join(loops, "file_id")
    chi = F.col("vertices") - F.col("edges") + F.col("faces") - (F.col("loops") - F.col("faces"))
    return out.select("file_id", "vertices", "edges", "faces", chi.alias("chi"), "open_edges", "non_manifold_edges", "inverted_edges", F.expr("open_edges = 0 AND non_manifold_edges = 0 AND inverted_edges = 0").alias("watertight"))


def faceted_solids(vertex: DataFrame, triangle: DataFrame, labels: DataFrame) -> DataFrame:
    """(mesh_id, text): each mesh as an exchange file with one faceted solid a shell (labels: mesh_id, tri, shell_id).

    Entity numbers run in sequence within a file, so a file is one kernel's work and files are spread over workers."""
    t = triangle.join(labels, ["mesh_id", "tri"]).select("mesh_id", F.lit(1).alias("kind"), "tri", "i0", "i1", "i2", "shell_id", F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.lit(0.0).alias("z"))
    v = vertex.select("mesh_id", F.lit(0).alias("kind"), F.col("vid").alias("tri"), *[F.lit(0).cast("long").alias(c) for c in ("i0", "i1", "i2", "shell_id")], *[F.col(c).cast("double").alias(c) for c in "xyz"])
    return v.unionByName(t).groupBy("mesh_id").applyInPandas(_solid, "mesh_id string, text string")


def number(v: float) -> str:
    if not np.isfinite(v):
        return "0."
    s = f"{v:.5f}".rstrip("0")
    return "0." if s == "-0." else s


def _solid(pdf: pd.DataFrame) -> pd.DataFrame:
    mesh = pdf["mesh_id"].iloc[0]
    pts, tri = pdf[pdf["kind"] == 0].sort_values("tri"), pdf[pdf["kind"] == 1].sort_values(["shell_id", "tri"])
    lines: list[str] = []

    def put(text: str) -> int:
        lines.append(f"#{len(lines) + 1} = {text};")
        return len(lines)

    at: dict[str, int] = {}
    ref = {}
    for vid, x, y, z in pts[["tri", "x", "y", "z"]].itertuples(index=False):
        key = f"{number(x)}, {number(y)}, {number(z)}"
        if key not in at:
            at[key] = put(f"CARTESIAN_POINT('', ({key}))")
        ref[vid] = at[key]
    vids, xyz = pts["tri"].to_numpy(), pts[["x", "y", "z"]].to_numpy(float)
    solids = []
    for _, shell in tri.groupby("shell_id", sort=True):
        faces = []
        ids = shell[["i0", "i1", "i2"]].to_numpy(np.int64)
        at_ = np.searchsorted(vids, ids)
        p, q, r = (xyz[at_[:, k]] for k in range(3))
        normal = np.cross(q - p, r - p)
        size = np.linalg.norm(normal, axis=1)
        normal = np.where(size[:, None] > 1e-12, normal / np.maximum(size, 1e-12)[:, None], [0.0, 0.0, 1.0])
        side_ = (q - p) / np.maximum(np.linalg.norm(q - p, axis=1), 1e-12)[:, None]
        for (a, b, c), n, u in zip(ids.tolist(), normal, side_, strict=True):
            if len({ref[a], ref[b], ref[c]}) < 3:
                continue
            axis, side = (put(f"DIRECTION('', ({', '.join(map(number, d))}))") for d in (n, u))
            plane = put(f"PLANE('', #{put(f"AXIS2_PLACEMENT_3D('', #{ref[a]}, #{axis}, #{side})")})")
            bound = put(f"FACE_OUTER_BOUND('', #{put(f"POLY_LOOP('', (#{ref[a]}, #{ref[b]}, #{ref[c]}))")}, .T.)")
            faces.append(put(f"FACE_SURFACE('', (#{bound}), #{plane}, .T.)"))
        solids.append(put(f"FACETED_BREP('', #{put(f"CLOSED_SHELL('', ({', '.join(f'#{f}' for f in faces)}))")})"))
    put(f"SHAPE_REPRESENTATION('{mesh}', ({', '.join(f'#{s}' for s in solids)}), $)")
    head = "ISO-10303-21;\nHEADER;\nFILE_DESCRIPTION((''), '2;1');\nFILE_NAME('" + mesh.replace("'", "''") + "', '', (''), (''), '', '', '');\nFILE_SCHEMA(('CONFIG_CONTROL_DESIGN'));\nENDSEC;\nDATA;\n"
    return pd.DataFrame({"mesh_id": [mesh], "text": [head + "\n".join(lines) + "\nENDSEC;\nEND-ISO-10303-21;\n"]})


def write_step(solids: DataFrame, path: str) -> None:
    """One text file for each mesh, below a folder of its id."""
    solids.select("mesh_id", F.col("text").alias("value")).write.partitionBy("mesh_id").mode("overwrite").text(path)


def wireframe(triangle: DataFrame, vertex: DataFrame) -> DataFrame:
    """(mesh_id, x0, y0, x1, y1): each edge once, seen along Z."""
    e = half_edges(triangle).select("mesh_id", F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).distinct()
    end = lambda k, n: vertex.select("mesh_id", F.col("vid").alias(k), F.col("x").alias(f"x{n}"), F.col("y").alias(f"y{n}"))
    return e.join(end("a", 0), ["mesh_id", "a"]).join(end("b", 1), ["mesh_id", "b"]).select("mesh_id", "x0", "y0", "x1", "y1")


def loop_areas(loops: DataFrame) -> DataFrame:
    """(file_id, loop_id, area): the length of the vector area of loops (file_id, loop_id, ord, x, y, z)."""
    w = Window.partitionBy("file_id", "loop_id").orderBy("ord")
    whole = Window.partitionBy("file_id", "loop_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    nxt = {c: F.coalesce(F.lead(c).over(w), F.first(c).over(whole)) for c in "xyz"}
    r = loops.select("*", *[nxt[c].alias(f"{c}2") for c in "xyz"])
    s = r.groupBy("file_id", "loop_id").agg(F.sum(F.expr("y * z2 - z * y2")).alias("a"), F.sum(F.expr("z * x2 - x * z2")).alias("b"), F.sum(F.expr("x * y2 - y * x2")).alias("c"))
    return s.select("file_id", "loop_id", (F.sqrt(F.expr("a * a + b * b + c * c")) / 2).alias("area"))


