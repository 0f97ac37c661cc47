"""The registered queries and the SQL that an independent engine checks them with.

Meshes are procedural: both engines build the same vertices and triangles. Operators whose input has the shape of one of the
driver's tables also run over that table (its columns stand for the operator's, as said in each query).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshloom.functions import catalogs, geometry, text
from meshloom.operators import matching, polygons, spatial, topology
from meshloom.sources import procedural

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

EXACT = {k: procedural.MESHES[k]() for k in ("unit_cube", "labyrinth", "open_box")} | {"hinge": procedural.hinge()}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(c):
    return geometry.rounded(c, 6)


_MESH = "WITH RECURSIVE " + procedural.sql_values(EXACT)
_FACET = _MESH + """, facet AS (
    SELECT t.mesh_id, t.tri, t.i0, t.i1, t.i2, a.x AS x0, a.y AS y0, a.z AS z0, b.x AS x1, b.y AS y1, b.z AS z1, c.x AS x2, c.y AS y2, c.z AS z2
    FROM triangle t JOIN vertex a ON a.mesh_id = t.mesh_id AND a.vid = t.i0 JOIN vertex b ON b.mesh_id = t.mesh_id AND b.vid = t.i1 JOIN vertex c ON c.mesh_id = t.mesh_id AND c.vid = t.i2),
    measured AS (SELECT *, (x0 * (y1 * z2 - z1 * y2) + y0 * (z1 * x2 - x1 * z2) + z0 * (x1 * y2 - y1 * x2)) / 6 AS vol,
        sqrt(power((y1 - y0) * (z2 - z0) - (z1 - z0) * (y2 - y0), 2) + power((z1 - z0) * (x2 - x0) - (x1 - x0) * (z2 - z0), 2) + power((x1 - x0) * (y2 - y0) - (y1 - y0) * (x2 - x0), 2)) / 2 AS area FROM facet)"""
_HALF = ", half AS (SELECT mesh_id, tri, unnest([i0, i1, i2]) AS u, unnest([i1, i2, i0]) AS v FROM triangle), edge AS (SELECT mesh_id, least(u, v) AS a, greatest(u, v) AS b, count(*) AS degree, sum(CASE WHEN u < v THEN 1 ELSE -1 END) AS orient FROM half GROUP BY ALL)"
_LINE = "WITH triangle AS (SELECT 'm' AS mesh_id, l_orderkey * 8 + l_linenumber AS tri, l_orderkey AS i0, l_partkey AS i1, l_suppkey AS i2 FROM lineitem WHERE l_orderkey <> l_partkey AND l_partkey <> l_suppkey AND l_orderkey <> l_suppkey)"


def meshes(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    return procedural.tables(spark, EXACT)


def lineitem_facets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem rows as facets with the corners order, part and supplier."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.lit("m").alias("mesh_id"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("tri"), F.col("l_orderkey").alias("i0"), F.col("l_partkey").alias("i1"), F.col("l_suppkey").alias("i2"))


# -- meshes ---------------------------------------------------------------------------------------


@query(_FACET + _HALF + """,
    near AS (SELECT h.mesh_id, h.tri, g.tri AS nbr FROM half h JOIN half g ON h.mesh_id = g.mesh_id AND least(h.u, h.v) = least(g.u, g.v) AND greatest(h.u, h.v) = greatest(g.u, g.v) AND h.tri <> g.tri),
    reach(mesh_id, tri, other) AS (SELECT mesh_id, tri, tri FROM triangle UNION SELECT r.mesh_id, r.tri, n.nbr FROM reach r JOIN near n ON n.mesh_id = r.mesh_id AND n.tri = r.other),
    label AS (SELECT mesh_id, tri, min(other) AS shell_id FROM reach GROUP BY ALL),
    shell AS (SELECT m.mesh_id, l.shell_id, sum(vol) AS v, sum(area) AS a FROM measured m JOIN label l USING (mesh_id, tri) GROUP BY ALL)
    SELECT t.mesh_id, (SELECT count(*) FROM triangle x WHERE x.mesh_id = t.mesh_id) AS n_tri, t.n_vertices, 0::BIGINT AS n_degenerate, e.open_edges, e.non_manifold_edges, e.inverted_edges,
        t.n_vertices - e.n_edges + (SELECT count(*) FROM triangle x WHERE x.mesh_id = t.mesh_id) AS chi, s.n_shells, s.n_cavities, e.open_edges = 0 AND e.non_manifold_edges = 0 AS watertight,
        floor(s.volume * 1e4 + 0.5) / 1e4 AS volume, floor(s.area * 1e4 + 0.5) / 1e4 AS area, t.min_x, t.min_y, t.min_z, t.max_x, t.max_y, t.max_z
    FROM (SELECT mesh_id, count(*) AS n_vertices, min(x) AS min_x, min(y) AS min_y, min(z) AS min_z, max(x) AS max_x, max(y) AS max_y, max(z) AS max_z FROM vertex GROUP BY 1) t
    JOIN (SELECT mesh_id, count(*) AS n_edges, count(*) FILTER (degree = 1) AS open_edges, count(*) FILTER (degree > 2) AS non_manifold_edges, count(*) FILTER (degree = 2 AND orient <> 0) AS inverted_edges FROM edge GROUP BY 1) e USING (mesh_id)
    JOIN (SELECT mesh_id, count(*) AS n_shells, count(*) FILTER (v < 0) AS n_cavities, sum(CASE WHEN v >= 0 THEN v ELSE 0 END) AS volume, sum(a) AS area FROM shell GROUP BY 1) s USING (mesh_id)""")
def analyze_meshes(spark, sf_dir):
    return topology.analyze(*meshes(spark))


@query(_FACET + " SELECT mesh_id, tri, floor(area * 1e6 + 0.5) / 1e6 AS area, floor(vol * 1e6 + 0.5) / 1e6 AS volume FROM measured")
def facet_measures(spark, sf_dir):
    a, b, c = topology.corners()
    return topology.facets(*meshes(spark)).select("mesh_id", "tri", r6(geometry.triangle_area(a, b, c)).alias("area"), r6(geometry.signed_volume(a, b, c)).alias("volume"))


@query(_FACET + """, o AS (SELECT mesh_id, x0 AS ox, y0 AS oy, z0 AS oz FROM facet WHERE tri = 0),
    s AS (SELECT mesh_id, x0-ox AS ax, y0-oy AS ay, z0-oz AS az, x1-ox AS bx, y1-oy AS by_, z1-oz AS bz, x2-ox AS cx, y2-oy AS cy, z2-oz AS cz, ox, oy, oz FROM facet JOIN o USING (mesh_id)),
    d AS (SELECT *, ax*(by_*cz-bz*cy) + ay*(bz*cx-bx*cz) + az*(bx*cy-by_*cx) AS det FROM s),
    g AS (SELECT mesh_id, any_value(ox) AS ox, any_value(oy) AS oy, any_value(oz) AS oz, sum(det/6) AS v, sum(det*(ax+bx+cx)/24) AS mx, sum(det*(ay+by_+cy)/24) AS my, sum(det*(az+bz+cz)/24) AS mz,
        sum(det*((ax+bx+cx)*(ax+bx+cx)+ax*ax+bx*bx+cx*cx)/120) AS sxx, sum(det*((ay+by_+cy)*(ay+by_+cy)+ay*ay+by_*by_+cy*cy)/120) AS syy, sum(det*((az+bz+cz)*(az+bz+cz)+az*az+bz*bz+cz*cz)/120) AS szz,
        sum(det*((ax+bx+cx)*(ay+by_+cy)+ax*ay+bx*by_+cx*cy)/120) AS sxy, sum(det*((ay+by_+cy)*(az+bz+cz)+ay*az+by_*bz+cy*cz)/120) AS syz, sum(det*((az+bz+cz)*(ax+bx+cx)+az*ax+bz*bx+cz*cx)/120) AS szx FROM d GROUP BY mesh_id)
    SELECT mesh_id, floor(v*1e3+0.5)/1e3 AS volume, floor((mx/v+ox)*1e3+0.5)/1e3 AS com_x, floor((my/v+oy)*1e3+0.5)/1e3 AS com_y, floor((mz/v+oz)*1e3+0.5)/1e3 AS com_z,
        floor(greatest(0, syy+szz-v*(my/v*my/v+mz/v*mz/v))*100+0.5)/100 AS i_xx, floor(greatest(0, sxx+szz-v*(mx/v*mx/v+mz/v*mz/v))*100+0.5)/100 AS i_yy, floor(greatest(0, sxx+syy-v*(mx/v*mx/v+my/v*my/v))*100+0.5)/100 AS i_zz,
        floor(-(sxy-v*mx/v*my/v)*100+0.5)/100 AS i_xy, floor(-(syz-v*my/v*mz/v)*100+0.5)/100 AS i_yz, floor(-(szx-v*mz/v*mx/v)*100+0.5)/100 AS i_zx FROM g""")
def mass_properties(spark, sf_dir):
    m = topology.mass_properties(topology.facets(*meshes(spark)))
    return m.select("mesh_id", *[geometry.rounded(F.col(c), 3).alias(c) for c in ("volume", "com_x", "com_y", "com_z")], *[(geometry.rounded(F.col(c), 2) + F.lit(0.0)).alias(c) for c in ("i_xx", "i_yy", "i_zz", "i_xy", "i_yz", "i_zx")])


@query(_MESH + " SELECT mesh_id, min(x) AS min_x, min(y) AS min_y, min(z) AS min_z, max(x) AS max_x, max(y) AS max_y, max(z) AS max_z FROM vertex GROUP BY 1")
def mesh_bounds(spark, sf_dir):
    return topology.bounds(meshes(spark)[0], ["mesh_id"])


@query(_FACET + " SELECT mesh_id, count(*) AS n_vertices FROM vertex GROUP BY 1")
def weld_vertices(spark, sf_dir):
    """Facets as a soup, welded: as many vertices as the mesh had."""
    soup = topology.facets(*meshes(spark)).drop("i0", "i1", "i2")
    return topology.weld(soup)[0].groupBy("mesh_id").agg(F.count("*").alias("n_vertices"))


@query(_MESH + " SELECT mesh_id, vid, x, z AS y, -y AS z FROM vertex")
def axis_remap(spark, sf_dir):
    v = topology.y_up(meshes(spark)[0])
    return v.select("mesh_id", "vid", *[F.col(c).cast("double").alias(c) for c in "xyz"])


@query(_MESH + _HALF + """, near AS (SELECT h.mesh_id, h.tri, g.tri AS nbr FROM half h JOIN half g ON h.mesh_id = g.mesh_id AND h.u = g.v AND h.v = g.u AND h.tri <> g.tri),
    reach(mesh_id, tri, other) AS (SELECT mesh_id, tri, tri FROM triangle UNION SELECT r.mesh_id, r.tri, n.nbr FROM reach r JOIN near n ON n.mesh_id = r.mesh_id AND n.tri = r.other)
    SELECT mesh_id, tri, min(other) AS shell_id FROM reach GROUP BY ALL""")
def shell_labels(spark, sf_dir):
    return topology.shell_labels(meshes(spark)[1])


@query("""SELECT * FROM (VALUES ('hinge', 0::BIGINT, 12::BIGINT, 'X', 0.35e0)) t(mesh_id, a_id, b_id, axis, gap)""")
def prismatic_joints(spark, sf_dir):
    """Shells of a mesh that one axis alone parts by 0.10 to 3."""
    s = topology.shells(topology.facets(*meshes(spark))).withColumnRenamed("shell_id", "id")
    return matching.axis_gaps(s.select("mesh_id", "id", *[f"{m}_{k}" for m in ("min", "max") for k in "xyz"]), ["mesh_id"]).withColumn("gap", geometry.rounded(F.col("gap"), 3))


@query("SELECT 'labyrinth' AS mesh_id, 12::BIGINT AS inner_id, 0::BIGINT AS outer_id")
def cavity_bodies(spark, sf_dir):
    """Each cavity with the least body whose bounds enclose it."""
    s = topology.shells(topology.facets(*meshes(spark))).withColumn("id", F.col("shell_id")).withColumn("size", F.abs("signed_volume"))
    return matching.smallest_enclosing(s.where("is_cavity"), s.where("NOT is_cavity"), ["mesh_id"])


@query(_FACET + """, n AS (SELECT mesh_id, area, ((y1-y0)*(z2-z0)-(z1-z0)*(y2-y0)) / (2*area) AS nx, ((z1-z0)*(x2-x0)-(x1-x0)*(z2-z0)) / (2*area) AS ny, ((x1-x0)*(y2-y0)-(y1-y0)*(x2-x0)) / (2*area) AS nz, x0, y0, z0 FROM measured)
    SELECT mesh_id, floor(nx*20+0.5)::BIGINT AS qx, floor(ny*20+0.5)::BIGINT AS qy, floor(nz*20+0.5)::BIGINT AS qz, floor((nx*x0+ny*y0+nz*z0)/0.2+0.5)::BIGINT AS qd, count(*) AS n, sum(floor(area*1e6+0.5))/1e6 AS area FROM n GROUP BY ALL""")
def plane_buckets(spark, sf_dir):
    f = topology.facets(*meshes(spark))
    a, b, c = topology.corners()
    n = geometry.triangle_normal(a, b, c)
    g = f.select("mesh_id", n[0].alias("nx"), n[1].alias("ny"), n[2].alias("nz"), geometry.dot(n, a).alias("offset"), geometry.triangle_area(a, b, c).alias("area"))
    return spatial.plane_buckets(g, ["mesh_id"])


@query(_MESH + _HALF + " SELECT h.mesh_id, h.u, h.v FROM half h ANTI JOIN half g ON h.mesh_id = g.mesh_id AND h.u = g.v AND h.v = g.u")
def mesh_boundary(spark, sf_dir):
    return topology.boundary_half_edges(meshes(spark)[1]).select("mesh_id", "u", "v")


@query(_FACET + ", p AS (SELECT mesh_id, unnest([i0, i1, i2]) AS vid, area FROM measured) SELECT mesh_id, vid, floor(sum(area) * 1e3 + 0.5) / 1e3 AS trace FROM p GROUP BY ALL")
def quadrics(spark, sf_dir):
    """The trace of each vertex's quadric is the area around it."""
    q = topology.vertex_quadrics(topology.facets(*meshes(spark)))
    return q.select("mesh_id", "vid", geometry.rounded(F.col("q00") + F.col("q11") + F.col("q22"), 3).alias("trace"))


# -- lineitem as facets ---------------------------------------------------------------------------


@query(_LINE + _HALF + " SELECT degree, count(*) AS n FROM edge GROUP BY 1")
def edge_audit(spark, sf_dir):
    return topology.edges(topology.proper(lineitem_facets(spark, sf_dir))).groupBy("degree").agg(F.count("*").alias("n"))


@query("SELECT count(*) AS read, count(*) FILTER (l_orderkey <> l_partkey AND l_partkey <> l_suppkey AND l_orderkey <> l_suppkey) AS kept FROM lineitem")
def degenerate_filter(spark, sf_dir):
    f = lineitem_facets(spark, sf_dir)
    return f.agg(F.count("*").alias("read")).join(topology.proper(f).agg(F.count("*").alias("kept")))  # one row each


@query(_LINE + _HALF + ", used AS (SELECT DISTINCT unnest([i0, i1, i2]) AS vid FROM triangle) SELECT (SELECT count(*) FROM used) AS v, (SELECT count(*) FROM edge) AS e, (SELECT count(*) FROM triangle) AS f, (SELECT count(*) FROM used) - (SELECT count(*) FROM edge) + (SELECT count(*) FROM triangle) AS chi")
def euler_characteristic(spark, sf_dir):
    return topology.euler(topology.proper(lineitem_facets(spark, sf_dir))).select("v", "e", "f", "chi")


@query(_LINE + _HALF + " SELECT h.tri, h.u, h.v FROM half h ANTI JOIN half g ON h.u = g.v AND h.v = g.u")
def boundary_half_edges(spark, sf_dir):
    return topology.boundary_half_edges(topology.proper(lineitem_facets(spark, sf_dir))).select("tri", "u", "v")


@query(_LINE + _HALF + ", pairs AS (SELECT least(u, v) AS a, greatest(u, v) AS b, min(tri) AS p, max(tri) AS q FROM half GROUP BY ALL HAVING count(*) = 2) SELECT p AS tri, q AS nbr FROM pairs UNION ALL SELECT q, p FROM pairs")
def face_adjacency(spark, sf_dir):
    return topology.adjacency(topology.proper(lineitem_facets(spark, sf_dir))).select("tri", "nbr")


# -- catalogs -------------------------------------------------------------------------------------

_THREADS = "thread(pos, designation, nominal, pitch, tap_drill, minor, preferred) AS (VALUES " + ", ".join(f"({i}, '{t[0]}', {t[1]}e0, {t[2]}e0, {t[3]}e0, {t[5]}e0, {str(t[1] in catalogs.PREFERRED).lower()})" for i, t in enumerate(catalogs.THREADS)) + ")"


def _thread_sql(score: str) -> str:
    return f"""WITH {_THREADS}, d AS (SELECT DISTINCT l_quantity AS d FROM lineitem),
        s AS (SELECT d, pos, designation, {score} AS score FROM d, thread), k AS (SELECT *, row_number() OVER (PARTITION BY d ORDER BY score, pos) AS r FROM s WHERE score <= 0.45e0)
        SELECT d.d AS diameter, k.designation, floor(k.score * 1e6 + 0.5) / 1e6 AS score FROM d LEFT JOIN k ON k.d = d.d AND k.r = 1"""


@query(_thread_sql("least(abs(d - tap_drill), abs(d - nominal) + 0.15e0, abs(d - minor)) + CASE WHEN preferred THEN 0e0 ELSE 0.25e0 END"))
def thread_match_internal(spark, sf_dir):
    """l_quantity as a measured bore."""
    d = table(spark, sf_dir, "lineitem").select(F.col("l_quantity").cast("double").alias("diameter")).distinct()
    return matching.match_thread(d, "diameter").select("diameter", "designation", r6(F.col("score")).alias("score"))


@query(_thread_sql("abs(d - nominal) + CASE WHEN preferred THEN 0e0 ELSE 0.20e0 END"))
def thread_match_external(spark, sf_dir):
    d = table(spark, sf_dir, "lineitem").select(F.col("l_quantity").cast("double").alias("diameter")).distinct()
    return matching.match_thread(d, "diameter", internal=False).select("diameter", "designation", r6(F.col("score")).alias("score"))


@query(f"""WITH {_THREADS}, p AS (SELECT DISTINCT l_quantity AS b, l_quantity + l_linenumber AS c FROM lineitem),
    s AS (SELECT b, c, pos, designation, abs(c-nominal) + abs(b-tap_drill) + abs((c-b)-(nominal-tap_drill))*0.4e0 + CASE WHEN nominal IN ({", ".join(map(str, matching.FIRST_SERIES))}) THEN 0e0 WHEN nominal IN ({", ".join(map(str, matching.SECOND_SERIES))}) THEN 0.05e0 ELSE 0.20e0 END AS score
        FROM p, thread WHERE abs(c-nominal) <= 0.85e0 AND abs(b-tap_drill) <= 0.85e0),
    k AS (SELECT *, row_number() OVER (PARTITION BY b, c ORDER BY score, pos) AS r FROM s WHERE score <= 1.35e0)
    SELECT p.b AS bore, p.c AS crest, k.designation, floor(k.score*1e6+0.5)/1e6 AS score FROM p LEFT JOIN k ON k.b = p.b AND k.c = p.c AND k.r = 1""")
def thread_pair_match(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    p = li.select(F.col("l_quantity").cast("double").alias("bore"), (F.col("l_quantity") + F.col("l_linenumber")).cast("double").alias("crest")).distinct()
    return matching.match_thread_pair(p, "bore", "crest").select("bore", "crest", "designation", r6(F.col("score")).alias("score"))


_KEY = r"regexp_replace(trim(regexp_replace(lower(p_name), '[()\[\]{}/\\.,;:]+', ' ', 'g')), '[\s\-_]+', '_', 'g')"
_NAMES = "names(name, id) AS (VALUES " + ", ".join(f"('{a}', '{m}')" for a, m in ([(m[0], m[0]) for m in catalogs.MATERIALS] + [(a, m) for a, m in catalogs.ALIASES if a != m])) + ")"
_LONG = [(i, m[0]) for i, m in enumerate(catalogs.MATERIALS) if len(m[0]) >= 5]


@query(f"SELECT p_partkey, {_KEY} AS key FROM part")
def material_keys(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", text.material_key(F.col("p_name")).alias("key"))


@query(f"""WITH {_NAMES}, raw AS (SELECT DISTINCT p_name || ' ' || p_type AS raw FROM part UNION SELECT * FROM (VALUES ('pyrex'), ('carb'), ('plate'), ('Structural Carbon Steel (AISI 1020)'), ('POM / Polyacetal (Delrin)')) v),
    keyed AS (SELECT raw, {_KEY.replace('p_name', 'raw')} AS key FROM raw), words AS (SELECT raw, key, string_split(key, '_') AS w FROM keyed),
    tries AS (SELECT raw, 0 AS stage, 0 AS place, key AS name FROM words UNION ALL SELECT raw, 1, i, w[i] || '_' || w[i + 1] FROM words, range(1, 20) r(i) WHERE i < len(w) UNION ALL SELECT raw, 2, i, w[i] FROM words, range(1, 21) r(i) WHERE i <= len(w)),
    found AS (SELECT raw, arg_min(id, stage * 1000 + place) AS id FROM tries JOIN names USING (name) GROUP BY raw),
    long(pos, m) AS (VALUES {", ".join(f"({i}, '{m}')" for i, m in _LONG)}),
    held AS (SELECT raw, arg_min(m, pos) AS id FROM keyed, long WHERE contains(key, m) OR (length(key) >= 4 AND starts_with(m, key)) GROUP BY raw)
    SELECT k.raw, coalesce(f.id, h.id, 'steel') AS material_id FROM keyed k LEFT JOIN found f USING (raw) LEFT JOIN held h USING (raw)""")
def material_resolve(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.concat_ws(" ", "p_name", "p_type").alias("raw"))
    golden = spark.createDataFrame([("pyrex",), ("carb",), ("plate",), ("Structural Carbon Steel (AISI 1020)",), ("POM / Polyacetal (Delrin)",)], "raw string")
    return matching.resolve_materials(p.union(golden).distinct().withColumnRenamed("raw", "label"), "label").withColumnRenamed("label", "raw")


@query("SELECT o_orderkey, CASE WHEN o_totalprice < 50000 THEN 'fast' WHEN o_totalprice < 300000 THEN 'medium' ELSE 'heavy' END AS class, least(300e0, 45e0 + 2.5e0 * (o_totalprice / 10000e0)) AS deadline FROM orders")
def priority_class(spark, sf_dir):
    """o_totalprice over 10000 as a file's MiB."""
    from meshloom.operators.scheduling import deadline_seconds, size_class

    mib = F.col("o_totalprice") / F.lit(10000.0)
    return table(spark, sf_dir, "orders").select("o_orderkey", size_class(mib).alias("class"), deadline_seconds(mib).alias("deadline"))


@query("""WITH c AS (SELECT o_orderkey, CASE WHEN o_totalprice < 50000 THEN 0 WHEN o_totalprice < 300000 THEN 1 ELSE 2 END AS class FROM orders),
    n AS (SELECT *, row_number() OVER (PARTITION BY class ORDER BY o_orderkey) AS rn FROM c)
    SELECT o_orderkey, class::BIGINT AS class, floor((rn - 1) / CASE class WHEN 0 THEN 8 WHEN 1 THEN 4 ELSE 1 END)::BIGINT AS cycle FROM n""")
def drr_order(spark, sf_dir):
    """The round of a deficit round robin (8, 4, 1 a round) in which each task starts."""
    from meshloom.operators.scheduling import round_robin

    o = table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_totalprice") < 50000, 0).when(F.col("o_totalprice") < 300000, 1).otherwise(2).cast("long").alias("class"))
    return round_robin(o, "class", "o_orderkey", {0: 8, 1: 4, 2: 1})


# -- points: the first three components of embeddings ------------------------------------------------

_PTS = "pts AS (SELECT vec_id AS id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z, label FROM embeddings)"


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.lit(0).alias("g"), F.col("vec_id").alias("id"), *[F.element_at("embedding", i + 1).cast("double").alias(c) for i, c in enumerate("xyz")], "label")


@query(f"WITH {_PTS} SELECT floor(x / 0.125e0)::BIGINT AS gx, floor(y / 0.125e0)::BIGINT AS gy, floor(z / 0.125e0)::BIGINT AS gz, count(*) AS n FROM pts GROUP BY ALL")
def grid_buckets(spark, sf_dir):
    return spatial.grid_buckets(points(spark, sf_dir), [], 0.125)


@query(f"WITH {_PTS}, d AS (SELECT a.id AS a, b.id AS b, sqrt((a.x-b.x)*(a.x-b.x) + (a.y-b.y)*(a.y-b.y) + (a.z-b.z)*(a.z-b.z)) AS d FROM pts a, pts b WHERE a.id < b.id) SELECT a, b, floor(d * 1e6 + 0.5) / 1e6 AS distance FROM d WHERE d <= 0.03125e0")
def distance_pairs(spark, sf_dir):
    return spatial.distance_pairs(points(spark, sf_dir), ["g"], 0.03125).select("a", "b", r6(F.col("distance")).alias("distance"))


@query(f"""WITH {_PTS}, t AS (SELECT *, floor(x / 0.0625e0) AS gx, floor(y / 0.0625e0) AS gy, floor(z / 0.0625e0) AS gz FROM pts), s AS (SELECT id, x + 0.03125e0 AS x, y, z, floor((x + 0.03125e0) / 0.0625e0) AS gx, floor(y / 0.0625e0) AS gy, floor(z / 0.0625e0) AS gz FROM pts),
    m AS (SELECT s.id, t.id AS target, greatest(abs(s.gx-t.gx), abs(s.gy-t.gy), abs(s.gz-t.gz)) AS ring, sqrt((s.x-t.x)*(s.x-t.x) + (s.y-t.y)*(s.y-t.y) + (s.z-t.z)*(s.z-t.z)) AS d FROM s, t),
    k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ring, d, target) AS r FROM m WHERE ring <= 2)
    SELECT p.id, k.target, floor(k.d * 1e6 + 0.5) / 1e6 AS distance, k.ring::BIGINT AS ring FROM pts p LEFT JOIN k ON k.id = p.id AND k.r = 1""")
def nearest_in_rings(spark, sf_dir):
    """For each point, moved along X by half a cell, the nearest of all points."""
    p = points(spark, sf_dir)
    n = spatial.nearest_in_rings(p.withColumn("x", F.col("x") + 0.03125), p, ["g"], 0.0625)
    return n.select("id", "target", r6(F.col("distance")).alias("distance"), F.col("ring").cast("long").alias("ring"))


@query(f"WITH {_PTS} SELECT id, x, y, z FROM pts WHERE x BETWEEN -0.1e0 AND 0.1e0 AND y BETWEEN 0 AND 0.2e0 AND z BETWEEN -0.05e0 AND 1")
def voxel_box(spark, sf_dir):
    return spatial.in_box(points(spark, sf_dir), (-0.1, 0.0, -0.05), (0.1, 0.2, 1.0)).select("id", "x", "y", "z")


@query(f"WITH {_PTS} SELECT label, min(x) AS min_x, min(y) AS min_y, min(z) AS min_z, max(x) AS max_x, max(y) AS max_y, max(z) AS max_z FROM pts GROUP BY 1")
def label_bounds(spark, sf_dir):
    return topology.bounds(points(spark, sf_dir), ["label"])


@query(f"WITH {_PTS} SELECT label, count(*) AS n, floor(covar_pop(x, x)*1e6+0.5)/1e6 AS cov_xx, floor(covar_pop(x, y)*1e6+0.5)/1e6 AS cov_xy, floor(covar_pop(y, z)*1e6+0.5)/1e6 AS cov_yz FROM pts GROUP BY 1")
def pca_covariance(spark, sf_dir):
    c = spatial.covariance(points(spark, sf_dir), ["label"], ["x", "y", "z"])
    return c.select("label", "n", *[r6(F.col(k)).alias(k) for k in ("cov_xx", "cov_xy", "cov_yz")])


_DIST = {
    "plane": "abs(z)",
    "cylinder": "sqrt(power(sqrt(x*x + y*y) - 0.25e0, 2) + power(greatest(-z, z - 0.5e0, 0e0), 2))",
    "torus": "abs(sqrt(power(sqrt(x*x + y*y) - 0.5e0, 2) + z*z) - 0.125e0)",
}


@query(f"WITH {_PTS} SELECT id, " + ", ".join(f"floor({e} * 1e6 + 0.5) / 1e6 AS {k}" for k, e in _DIST.items()) + " FROM pts")
def surface_distances(spark, sf_dir):
    p, o, z = geometry.vec("x", "y", "z"), tuple(F.lit(0.0) for _ in range(3)), (F.lit(0.0), F.lit(0.0), F.lit(1.0))
    d = {"plane": geometry.plane_distance(p, o, z), "cylinder": geometry.cylinder_distance(p, o, z, F.lit(0.25), F.lit(0.5)), "torus": geometry.torus_distance(p, o, z, F.lit(0.5), F.lit(0.125))}
    return points(spark, sf_dir).select("id", *[r6(e).alias(k) for k, e in d.items()])


@query("SELECT i::BIGINT AS i, list_sum([floor(i / power(2, d)) % 2 / power(2, d + 1) for d in range(0, 40)]) AS h2 FROM range(1, 4097) t(i)")
def halton_samples(spark, sf_dir):
    return spark.range(1, 4097).select(F.col("id").alias("i"), geometry.halton(F.col("id"), 2).alias("h2"))


# -- order, gaps and sums ----------------------------------------------------------------------------


@query("WITH r AS (SELECT l_returnflag, l_extendedprice AS v, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) - 1 AS i, count(*) OVER (PARTITION BY l_returnflag) AS n FROM lineitem) SELECT l_returnflag, max(v) FILTER (i = least(n - 1, floor(0.99e0 * n))) AS stat, max(v) AS greatest, max(n) AS n FROM r GROUP BY 1")
def order_stat_p99(spark, sf_dir):
    return spatial.order_statistic(table(spark, sf_dir, "lineitem"), ["l_returnflag"], "l_extendedprice")


@query("SELECT user_id, cluster::BIGINT AS cluster, min(value) AS first, max(value) AS last, count(*) AS n FROM (SELECT *, sum(CASE WHEN value - p >= 25e0 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY value) AS cluster FROM (SELECT user_id, value, lag(value) OVER (PARTITION BY user_id ORDER BY value) AS p FROM events)) GROUP BY ALL")
def gap_clusters(spark, sf_dir):
    return spatial.gap_clusters(table(spark, sf_dir, "events"), ["user_id"], "value", 25.0)


@query("WITH a AS (SELECT DISTINCT user_id, floor(value * 100)::BIGINT % 360 * 1e0 AS t FROM events), g AS (SELECT user_id, coalesce(lead(t) OVER w, min(t) OVER (PARTITION BY user_id) + 360) - t AS gap FROM a WINDOW w AS (PARTITION BY user_id ORDER BY t)) SELECT user_id, max(gap) AS widest, count(*) AS n, 360e0 - max(gap) AS span FROM g GROUP BY 1")
def circular_gaps(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", (F.floor(F.col("value") * 100).cast("long") % 360).cast("double").alias("t"))
    return spatial.circular_gaps(e, ["user_id"], "t")


@query("SELECT o_orderstatus, o_orderkey, sum(w) OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) - w AS lo, sum(w) OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) AS hi FROM (SELECT o_orderstatus, o_orderkey, floor(o_totalprice)::BIGINT AS w FROM orders)")
def running_cdf(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderstatus", "o_orderkey", F.floor("o_totalprice").cast("long").alias("w"))
    return spatial.running_share(o, ["o_orderstatus"], "o_orderkey", "w").select("o_orderstatus", "o_orderkey", "lo", "hi")


@query("SELECT p_brand, p_partkey, dense_rank() OVER (PARTITION BY p_brand ORDER BY g) - 1 AS cluster FROM (SELECT *, sum(CASE WHEN p_size - p > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY p_brand ORDER BY p_size) AS g FROM (SELECT p_brand, p_partkey, p_size, lag(p_size) OVER (PARTITION BY p_brand ORDER BY p_size) AS p FROM part))")
def group_by_tolerance(spark, sf_dir):
    return matching.groups_by_tolerance(table(spark, sf_dir, "part"), ["p_brand"], "p_size", 1).select("p_brand", "p_partkey", "cluster")


@query("SELECT lang, arg_min(source, (-n, source)) AS source, max(n) AS n FROM (SELECT lang, source, count(*) AS n FROM documents GROUP BY ALL) GROUP BY lang")
def majority_vote(spark, sf_dir):
    return matching.majority(table(spark, sf_dir, "documents"), ["lang"], "source")


@query("SELECT d.source, CASE WHEN max(toxic) = 1 THEN 'FAILED' WHEN min(quality) = 0 THEN 'WARNING' ELSE 'PASSED' END AS status, count(*) FILTER (toxic = 1) AS failed, count(*) FILTER (toxic = 0 AND quality = 0) AS warned, count(*) AS gates FROM labels l JOIN documents d USING (doc_id) GROUP BY 1")
def gate_rollup(spark, sf_dir):
    """Toxic labels as failed gates, low quality as warnings, rolled up for each source."""
    from meshloom.operators.verify import rollup

    g = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "source"), "doc_id")
    return rollup(g.withColumn("status", F.when(F.col("toxic") == 1, "failed").when(F.col("quality") == 0, "warning").otherwise("passed")), ["source"])


@query("SELECT event_type, count(*) AS processed, count(*) FILTER (value >= 50) AS success, count(*) FILTER (value < 50) AS errors, sum(user_id)::BIGINT AS triangles FROM events GROUP BY 1")
def manifest_totals(spark, sf_dir):
    """events as a manifest: a value of 50 and more is a success, user_id counts triangles."""
    from meshloom.streaming.manifest import totals

    e = table(spark, sf_dir, "events").select("event_type", (F.col("value") >= 50).alias("success"), F.col("user_id").alias("triangles"))
    return totals(e, ["event_type"])


@query("SELECT event_type, time_bucket(INTERVAL 1 HOUR, ts) AS start, count(*) AS n FROM events GROUP BY ALL")
def tumbling_throughput(spark, sf_dir):
    from meshloom.streaming.manifest import tumbling

    return tumbling(table(spark, sf_dir, "events"), "ts", "1 hour", ["event_type"])


@query("WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS f FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT user_id, ts, sum(f) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, min(ts) AS start, count(*) AS n FROM s GROUP BY user_id, k")
def session_throughput(spark, sf_dir):
    from meshloom.streaming.manifest import sessions

    return sessions(table(spark, sf_dir, "events"), "ts", "30 minutes", ["user_id"])


@query("""WITH l AS (SELECT doc_id, string_split(replace(replace(text, '''', ''), '.', ';'), ';') AS l FROM documents), f AS (SELECT doc_id, list_filter(l[:-2], lambda x: x <> '') AS l FROM l)
    SELECT doc_id, i::BIGINT AS ord, s AS statement FROM (SELECT doc_id, unnest(l) AS s, generate_subscripts(l, 1) - 1 AS i FROM f)""")
def statement_split(spark, sf_dir):
    """Sentences as an exchange file's statements."""
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.posexplode(text.statements(F.translate("text", ".'", ";"))).alias("ord", "statement")).withColumn("ord", F.col("ord").cast("long"))


@query("SELECT doc_id, ceil(length(text) / 3.2e0)::BIGINT AS tokens FROM documents")
def token_budget(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", text.tokens_estimate(F.col("text")).alias("tokens"))


@query("SELECT conv_id, turn, length(text) AS size FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS k FROM conversations) WHERE k <= 3")
def tier_truncate(spark, sf_dir):
    """The first rows of each list that a context tier keeps."""
    from meshloom.operators.reports import truncated

    c = table(spark, sf_dir, "conversations")
    return truncated(c, ["conv_id"], "turn", 3).select("conv_id", "turn", F.length("text").cast("long").alias("size"))


@query(r"SELECT l_orderkey, l_linenumber, regexp_replace(regexp_replace(printf('%.6f', l_extendedprice / 7), '0+$', ''), '^-0\.$', '0.') AS number FROM lineitem")
def step_numbers(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return li.select("l_orderkey", "l_linenumber", text.step_number(F.col("l_extendedprice") / F.lit(7.0)).alias("number"))


# -- features, files and verification of the procedural meshes ----------------------------------------

_TRI = "mesh_id IN ('unit_cube', 'labyrinth', 'open_box', 'hinge')"


@query("SELECT * FROM (VALUES ('prismatic_m6', 5.0e0, 20e0, 'M6x1.0', 1e0, 0e0)) t(mesh_id, diameter, depth, designation, pitch, score)")
def detect_threads(spark, sf_dir):
    """Bores of the procedural meshes, found by segmentation, and the threads that fit them."""
    from meshloom.plans import api

    return api.detect_threads(*procedural.tables(spark)).select("mesh_id", "diameter", "depth", "designation", "pitch", r6(F.col("score")).alias("score"))


@query("SELECT * FROM (VALUES ('hinge', 'plane', 8::BIGINT), ('labyrinth', 'plane', 12), ('open_box', 'plane', 5), ('prismatic_m6', 'plane', 6), ('prismatic_m6', 'cylinder', 1), ('unit_cube', 'plane', 6)) t(mesh_id, type, n)")
def segment_surfaces(spark, sf_dir):
    from meshloom.operators import kernels

    s = kernels.surfaces(kernels.segment(topology.facets(*procedural.tables(spark)).where("mesh_id <> 'saddle'")))
    return s.groupBy("mesh_id", "type").agg(F.count("*").alias("n"))


@query("""SELECT m AS mesh_id, g AS gate, CASE WHEN m = 'open_box' AND g = 'intake' THEN 'warning' WHEN m = 'open_box' AND g = 'solid' THEN 'failed' ELSE 'passed' END AS status
    FROM (VALUES ('unit_cube'), ('labyrinth'), ('open_box'), ('hinge')) a(m), (VALUES ('intake'), ('segmentation'), ('kinematics'), ('solid'), ('differential')) b(g)""")
def verify_gates(spark, sf_dir):
    from meshloom.plans import api

    return api.verify_meshes(*meshes(spark)).select("mesh_id", "gate", "status")


@query(_MESH + _HALF + """ SELECT t.mesh_id AS file_id, count(DISTINCT t.vid) AS vertices, any_value(e.n) AS edges, any_value(f.n) AS faces, any_value(e.open) AS open_edges, any_value(e.open) = 0 AS watertight
    FROM vertex t JOIN (SELECT mesh_id, count(*) AS n, count(*) FILTER (degree = 1) AS open FROM edge GROUP BY 1) e USING (mesh_id) JOIN (SELECT mesh_id, count(*) AS n FROM triangle GROUP BY 1) f USING (mesh_id) GROUP BY 1""")
def step_audit(spark, sf_dir):
    """Exchange files of the meshes, written, parsed and audited."""
    from meshloom.sources import step

    v, t = meshes(spark)
    text_ = step.faceted_solids(v, t, topology.shell_labels(t)).withColumnRenamed("mesh_id", "file_id")
    return step.audit(step.parse(text_)).select("file_id", "vertices", "edges", "faces", "open_edges", "watertight")


@query(_FACET + " SELECT mesh_id, tri, x0, y1, z2 FROM facet")
def stl_round_trip(spark, sf_dir):
    """Meshes as binary STL bytes, read back."""
    from meshloom.sources import stl

    back = stl.parse_files(stl.encoded(topology.facets(*meshes(spark))).withColumnRenamed("mesh_id", "path"))
    return back.select("mesh_id", "tri", *[F.col(c).cast("double").alias(c) for c in ("x0", "y1", "z2")])


@query("SELECT 'open_box' AS mesh_id, 0::BIGINT AS loop_id, 4::BIGINT AS n, true AS closed")
def boundary_loops(spark, sf_dir):
    from meshloom.operators import kernels

    loop = kernels.loops(topology.boundary_half_edges(meshes(spark)[1]))
    return loop.groupBy("mesh_id", "loop_id").agg(F.count("*").alias("n"), F.bool_and("closed").alias("closed"))


@query(_MESH + _HALF + " SELECT mesh_id, true AS no_more_facets, true AS as_closed, true AS volume_kept FROM edge GROUP BY 1")
def simplify_meshes(spark, sf_dir):
    """Edge collapse of each mesh: fewer facets or as many, open only where it was, and the volume within 1 %."""
    from meshloom.operators import kernels
    from meshloom.operators.staging import kept

    def told(f, p):
        e = topology.edge_audit(f).select("mesh_id", F.col("open_edges").alias(f"{p}_open"), F.col("non_manifold_edges").alias(f"{p}_many"))
        m = topology.mass_properties(f).select("mesh_id", F.col("volume").alias(f"{p}_volume"))
        return e.join(m, "mesh_id").join(f.groupBy("mesh_id").agg(F.count("*").alias(f"{p}_n")), "mesh_id")

    f = topology.facets(*meshes(spark))
    s = kept(kernels.simplify(f, 0.5).where("error IS NULL"))
    both = told(f, "a").join(told(s, "b"), "mesh_id")
    return both.select("mesh_id", F.expr("b_n <= a_n").alias("no_more_facets"), F.expr("b_open = a_open AND b_many = a_many").alias("as_closed"), F.expr("abs(a_volume - b_volume) <= 0.01 * abs(a_volume)").alias("volume_kept"))


@query()
def surface_samples(spark, sf_dir):
    """Area-weighted samples of each mesh with their deviation from the surfaces found."""
    from meshloom.operators import kernels, verify

    f = topology.facets(*procedural.tables(spark))
    seg = kernels.segment(f)
    return verify.residuals(verify.samples(f), kernels.surfaces(seg), seg.where("error IS NULL").select("mesh_id", "surface_id", "tri"))


@query(_FACET + ", n AS (SELECT mesh_id, count(*) AS total FROM triangle GROUP BY 1) SELECT mesh_id, 200::BIGINT AS n FROM n")
def sample_counts(spark, sf_dir):
    from meshloom.operators import verify

    return verify.samples(topology.facets(*meshes(spark)), 200).groupBy("mesh_id").agg(F.count("*").alias("n"))


@query(_MESH + _HALF + " SELECT e.mesh_id, p.x AS x0, p.y AS y0, q.x AS x1, q.y AS y1 FROM edge e JOIN vertex p ON p.mesh_id = e.mesh_id AND p.vid = e.a JOIN vertex q ON q.mesh_id = e.mesh_id AND q.vid = e.b")
def wireframe_edges(spark, sf_dir):
    from meshloom.sources.step import wireframe

    v, t = meshes(spark)
    return wireframe(t, v).select("mesh_id", *[F.col(c).cast("double").alias(c) for c in ("x0", "y0", "x1", "y1")])


@query(_FACET + _HALF + """, n AS (SELECT mesh_id, tri, ((y1-y0)*(z2-z0)-(z1-z0)*(y2-y0))/(2*area) AS nx, ((z1-z0)*(x2-x0)-(x1-x0)*(z2-z0))/(2*area) AS ny, ((x1-x0)*(y2-y0)-(y1-y0)*(x2-x0))/(2*area) AS nz FROM measured),
    f AS (SELECT h.mesh_id, least(u, v) AS a, greatest(u, v) AS b, count(*) AS k, arg_min(n.nx, h.tri)*arg_max(n.nx, h.tri) + arg_min(n.ny, h.tri)*arg_max(n.ny, h.tri) + arg_min(n.nz, h.tri)*arg_max(n.nz, h.tri) AS fold FROM half h JOIN n USING (mesh_id, tri) GROUP BY ALL)
    SELECT DISTINCT mesh_id, unnest([a, b]) AS vid FROM f WHERE k <> 2 OR fold < cos(radians(30))""")
def feature_shield(spark, sf_dir):
    return topology.shielded(topology.facets(*meshes(spark)))


@query(_FACET + ", s AS (SELECT mesh_id, sum(vol) AS v FROM measured GROUP BY 1) SELECT mesh_id, floor(abs(v) / 1000 * 7.98e0 * 1e4 + 0.5) / 1e4 AS mass_g, false AS transparent FROM s WHERE mesh_id IN ('unit_cube', 'open_box')")
def mass_by_material(spark, sf_dir):
    from meshloom.operators.reports import mass_rollup

    s = topology.shells(topology.facets(*meshes(spark)).where("mesh_id IN ('unit_cube', 'open_box')"))
    return mass_rollup(s.withColumn("material_id", F.lit("steel")), catalogs.materials(spark))


@query("SELECT c_nationkey AS mesh_id, min(c_acctbal / 1000 + 1) <= 2.5 AS fine, CASE WHEN min(c_acctbal / 1000 + 1) <= 2.5 THEN 0.25e0 ELSE 0.40e0 END AS nozzle, CASE WHEN min(c_acctbal / 1000 + 1) <= 2.5 THEN 0.12e0 WHEN min(c_acctbal / 1000 + 1) <= 4.0 THEN 0.16e0 ELSE 0.20e0 END AS layer FROM customer GROUP BY 1")
def manufacturing_notes(spark, sf_dir):
    """Account balances in thousands, plus one, as hole diameters of a nation's mesh."""
    from meshloom.operators.reports import notes

    h = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("mesh_id"), (F.col("c_acctbal") / F.lit(1000.0) + 1.0).alias("diameter"), F.lit(None).cast("string").alias("designation"))
    return notes(h).select("mesh_id", (F.col("nozzle") < 0.3).alias("fine"), F.col("nozzle").cast("double").alias("nozzle"), F.col("layer").cast("double").alias("layer"))


_CYL = """cyl(mesh_id, id, shell_id, is_internal, x, y, z, ax, ay, az, radius, lo, hi) AS (VALUES ('m', 's', 0, true, 0e0, 0e0, 0e0, 0e0, 0e0, 1e0, 5.5e0, 0e0, 20e0), ('m', 'p', 1, false, 0.25e0, 0e0, 0e0, 0e0, 0e0, 1e0, 5e0, 5e0, 30e0), ('m', 'far', 2, false, 9e0, 0e0, 0e0, 0e0, 0e0, 1e0, 5e0, 5e0, 30e0), ('m', 'own', 0, false, 0e0, 0e0, 0e0, 0e0, 0e0, 1e0, 5e0, 5e0, 30e0), ('m', 'tight', 3, false, 0e0, 0e0, 0e0, 0e0, 0e0, 1e0, 5.45e0, 5e0, 30e0))"""


@query(f"WITH {_CYL} SELECT s.mesh_id, s.id AS socket, p.id AS pin, s.radius - p.radius AS clearance, least(s.hi, p.hi) - greatest(s.lo, p.lo) AS overlap FROM cyl s JOIN cyl p USING (mesh_id) WHERE s.is_internal AND NOT p.is_internal AND s.shell_id <> p.shell_id AND s.radius - p.radius BETWEEN 0.12e0 AND 2e0 AND sqrt(power(s.x - p.x, 2) + power(s.y - p.y, 2)) <= 0.65e0 AND least(s.hi, p.hi) > greatest(s.lo, p.lo)")
def revolute_joints(spark, sf_dir):
    rows = [("m", "s", 0, True, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0, 5.5, 0.0, 20.0), ("m", "p", 1, False, 0.25, 0.0, 0.0, 0.0, 0.0, 1.0, 5.0, 5.0, 30.0), ("m", "far", 2, False, 9.0, 0.0, 0.0, 0.0, 0.0, 1.0, 5.0, 5.0, 30.0), ("m", "own", 0, False, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0, 5.0, 5.0, 30.0), ("m", "tight", 3, False, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0, 5.45, 5.0, 30.0)]
    c = spark.createDataFrame(rows, "mesh_id string, id string, shell_id int, is_internal boolean, x double, y double, z double, ax double, ay double, az double, radius double, lo double, hi double")
    return matching.revolute_pairs(c)


@query("""WITH s AS (SELECT c_nationkey AS nation, c_custkey % 40 AS n, abs(c_acctbal / 1000) AS v FROM customer), r AS (SELECT *, n >= 8 AND (n >= 30 OR v >= 1) AS strict, n >= 8 AND (n >= 30 OR v >= 0.1e0) AS loose FROM s),
    w AS (SELECT *, count(*) OVER (PARTITION BY nation) AS m, bool_or(strict) OVER (PARTITION BY nation) AS some_strict, bool_or(loose) OVER (PARTITION BY nation) AS some_loose FROM r)
    SELECT nation, count(*) AS kept FROM w WHERE CASE WHEN m = 1 THEN true WHEN some_strict THEN strict WHEN some_loose THEN loose ELSE true END GROUP BY 1""")
def debris_filter(spark, sf_dir):
    """Customers as the shells of a nation's mesh."""
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("mesh_id"), (F.col("c_custkey") % 40).alias("n_tri"), (F.col("c_acctbal") / F.lit(1000.0)).alias("signed_volume"))
    return topology.debris_free(c).groupBy(F.col("mesh_id").alias("nation")).agg(F.count("*").alias("kept"))


# -- plane polygons: parts as squares, their sizes as half sides --------------------------------------------

_SQUARE = "loops AS (SELECT p_brand AS g, p_partkey AS loop_id, o.i AS ord, p_size * o.dx + 0e0 AS x, p_size * o.dy + 0e0 AS y FROM (SELECT p_brand, min(p_partkey) AS p_partkey, p_size FROM part GROUP BY p_brand, p_size) p, (VALUES (0, -1, -1), (1, 1, -1), (2, 1, 0), (3, 1, 1), (4, -1, 1)) o(i, dx, dy))"


def squares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One square for each size of a brand, about one centre, with a vertex in the middle of a side."""
    p = table(spark, sf_dir, "part").groupBy("p_brand", "p_size").agg(F.min("p_partkey").alias("loop_id"))
    corner = F.explode(F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(a).alias("dx"), F.lit(b).alias("dy")) for i, a, b in ((0, -1, -1), (1, 1, -1), (2, 1, 0), (3, 1, 1), (4, -1, 1))]))
    return p.withColumn("o", corner).select(F.col("p_brand").alias("g"), "loop_id", "o.ord", (F.col("p_size") * F.col("o.dx") + F.lit(0.0)).alias("x"), (F.col("p_size") * F.col("o.dy") + F.lit(0.0)).alias("y"))


@query(f"WITH {_SQUARE} SELECT g, loop_id, power(max(x) - min(x), 2) AS area FROM loops GROUP BY ALL")
def polygon_areas(spark, sf_dir):
    return polygons.areas(squares(spark, sf_dir), ["g"]).select("g", "loop_id", "area")


@query(f"WITH {_SQUARE}, s AS (SELECT g, loop_id, max(x) AS h FROM loops GROUP BY ALL) SELECT g, loop_id, lead(loop_id) OVER (PARTITION BY g ORDER BY h) AS parent, count(*) OVER (PARTITION BY g) - row_number() OVER (PARTITION BY g ORDER BY h) AS depth FROM s")
def containment_forest(spark, sf_dir):
    return polygons.forest(squares(spark, sf_dir), ["g"])


@query("SELECT p_brand AS g, p_partkey AS loop_id, p_partkey % 2 AS n FROM part")
def polygon_crossings(spark, sf_dir):
    """Parts as squares, and odd ones as bow ties, whose sides cross once."""
    shape = lambda *p: F.array(*[F.struct(F.lit(i).alias("ord"), F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for i, (x, y) in enumerate(p)])
    pts = F.when(F.col("p_partkey") % 2 == 0, shape((0, 0), (1, 0), (1, 1), (0, 1))).otherwise(shape((0, 0), (1, 1), (1, 0), (0, 1)))
    loops = table(spark, sf_dir, "part").select(F.col("p_brand").alias("g"), F.col("p_partkey").alias("loop_id"), F.explode(pts).alias("p")).select("g", "loop_id", "p.*")
    return polygons.crossings(loops, ["g"])


@query(f"WITH {_SQUARE} SELECT g, loop_id, ord::BIGINT AS ord FROM loops WHERE ord <> 2")
def collinear_vertices(spark, sf_dir):
    return polygons.straightened(squares(spark, sf_dir), ["g"]).select("g", "loop_id", F.col("ord").cast("long").alias("ord"))


# -- the same operators over all rows, where the queries above take some --------------------------------------


@query("WITH b AS (SELECT c_nationkey AS k, c_custkey AS id, c_acctbal AS lo, c_acctbal + 100e0 AS hi FROM customer) SELECT i.k, i.id AS inner_id, min(o.id) AS outer_id FROM b i JOIN b o ON o.k = i.k AND i.lo >= o.lo - 500e0 - 1e-3 AND i.hi <= o.hi + 500e0 + 1e-3 GROUP BY ALL")
def smallest_enclosing(spark, sf_dir):
    """Each customer's interval in the wider ones of all customers of the nation."""
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k"), F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("lo"), (F.col("c_acctbal") + 100.0).alias("hi"))
    box = lambda pad: c.select("k", "id", F.lit(1100.0).alias("size"), *[(F.col("lo") - pad).alias(f"min_{a}") for a in "xyz"], *[(F.col("hi") + pad).alias(f"max_{a}") for a in "xyz"])
    return matching.smallest_enclosing(box(0.0), box(500.0), ["k"])


@query(f"WITH {_PTS}, m AS (SELECT *, greatest(abs(x), abs(y), abs(z)) AS m FROM pts) SELECT id, CASE WHEN m < 0.25e0 THEN NULL WHEN abs(x) = m THEN CASE WHEN x > 0 THEN '+X' ELSE '-X' END WHEN abs(y) = m THEN CASE WHEN y > 0 THEN '+Y' ELSE '-Y' END WHEN abs(z) = m THEN CASE WHEN z > 0 THEN '+Z' ELSE '-Z' END END AS axis FROM m")
def axis_snap(spark, sf_dir):
    """All points; of several axes that qualify the closest, of equals the first."""
    return points(spark, sf_dir).select("id", geometry.snapped_axis(geometry.vec("x", "y", "z"), 0.25).alias("axis"))


@query(f"""WITH {_PTS}, k AS (SELECT *, least(1e0, greatest(0e0, x)) AS a, least(1e0, greatest(0e0, y)) AS b, least(1e0, greatest(0e0, (x + y) / 2)) AS c FROM pts)
    SELECT id, floor(CASE WHEN x <= 1 AND y BETWEEN 0 AND x THEN abs(z) ELSE sqrt(least((x-a)*(x-a) + y*y, (x-1)*(x-1) + (y-b)*(y-b), (x-c)*(x-c) + (y-c)*(y-c)) + z*z) END * 1e6 + 0.5) / 1e6 AS distance FROM k""")
def triangle_distances(spark, sf_dir):
    """All points: over the triangle, or nearest to one of its sides or corners."""
    t = F.struct(*[F.lit(float(v)).alias(k) for k, v in zip(("x0", "y0", "z0", "x1", "y1", "z1", "x2", "y2", "z2"), (0, 0, 0, 1, 0, 0, 1, 1, 0), strict=True)])
    return points(spark, sf_dir).select("id", r6(polygons.triangle_distance(F.struct("x", "y", "z"), t)).alias("distance"))


from meshloom.plans import feature_queries  # noqa: E402, F401  registers its own
