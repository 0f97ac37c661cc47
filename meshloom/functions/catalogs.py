"""Catalogs of thread sizes and materials. Fixed values, on which results depend."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# designation, nominal, pitch, tap drill, pitch diameter, minor diameter of the internal thread (ISO 261, 724)
THREADS = [
    ("M1x0.25", 1.0, 0.25, 0.75, 0.838, 0.729),
    ("M1.2x0.25", 1.2, 0.25, 0.95, 1.038, 0.929),
    ("M1.4x0.3", 1.4, 0.3, 1.1, 1.205, 1.075),
    ("M1.6x0.35", 1.6, 0.35, 1.25, 1.373, 1.221),
    ("M1.8x0.35", 1.8, 0.35, 1.45, 1.573, 1.421),
    ("M2x0.4", 2.0, 0.4, 1.6, 1.74, 1.567),
    ("M2.5x0.45", 2.5, 0.45, 2.05, 2.208, 2.013),
    ("M3x0.5", 3.0, 0.5, 2.5, 2.675, 2.459),
    ("M3.5x0.6", 3.5, 0.6, 2.9, 3.11, 2.85),
    ("M4x0.7", 4.0, 0.7, 3.3, 3.545, 3.242),
    ("M5x0.8", 5.0, 0.8, 4.2, 4.48, 4.134),
    ("M6x1.0", 6.0, 1.0, 5.0, 5.35, 4.917),
    ("M7x1.0", 7.0, 1.0, 6.0, 6.35, 5.917),
    ("M8x1.25", 8.0, 1.25, 6.8, 7.188, 6.647),
    ("M10x1.5", 10.0, 1.5, 8.5, 9.026, 8.376),
    ("M12x1.75", 12.0, 1.75, 10.2, 10.863, 10.106),
    ("M14x2.0", 14.0, 2.0, 12.0, 12.701, 11.835),
    ("M16x2.0", 16.0, 2.0, 14.0, 14.701, 13.835),
    ("M18x2.5", 18.0, 2.5, 15.5, 16.376, 15.294),
    ("M20x2.5", 20.0, 2.5, 17.5, 18.376, 17.294),
    ("M22x2.5", 22.0, 2.5, 19.5, 20.376, 19.294),
    ("M24x3.0", 24.0, 3.0, 21.0, 22.051, 20.752),
    ("M27x3.0", 27.0, 3.0, 24.0, 25.051, 23.752),
    ("M30x3.5", 30.0, 3.5, 26.5, 27.727, 26.211),
    ("M33x3.5", 33.0, 3.5, 29.5, 30.727, 29.211),
    ("M36x4.0", 36.0, 4.0, 32.0, 33.402, 31.67),
    ("M39x4.0", 39.0, 4.0, 35.0, 36.402, 34.67),
    ("M42x4.5", 42.0, 4.5, 37.5, 39.077, 37.129),
    ("M45x4.5", 45.0, 4.5, 40.5, 42.077, 40.129),
    ("M48x5.0", 48.0, 5.0, 43.0, 44.752, 42.587),
    ("M52x5.0", 52.0, 5.0, 47.0, 48.752, 46.587),
    ("M56x5.5", 56.0, 5.5, 50.5, 52.428, 50.046),
    ("M60x5.5", 60.0, 5.5, 54.5, 56.428, 54.046),
    ("M64x6.0", 64.0, 6.0, 58.0, 60.103, 57.505),
]
#: Preferred nominal sizes for a single diameter.
PREFERRED = (3, 4, 5, 6, 8, 10, 12, 14, 16, 18, 20, 22, 24)

# id, category, density in g/cm3, red, green, blue, transparency
MATERIALS = [
    ("glass", "glass", 2.23, 0.9, 0.95, 1.0, 0.85),
    ("soda_lime_glass", "glass", 2.5, 0.88, 0.94, 0.92, 0.82),
    ("quartz", "glass", 2.2, 0.95, 0.97, 1.0, 0.92),
    ("acrylic", "polymer", 1.18, 0.93, 0.97, 1.0, 0.88),
    ("polycarbonate", "polymer", 1.2, 0.89, 0.93, 0.97, 0.8),
    ("steel", "metal", 7.98, 0.75, 0.76, 0.78, 0.0),
    ("mild_steel", "metal", 7.85, 0.55, 0.55, 0.58, 0.0),
    ("aluminum", "metal", 2.7, 0.82, 0.84, 0.86, 0.0),
    ("brass", "metal", 8.5, 0.85, 0.75, 0.25, 0.0),
    ("copper", "metal", 8.96, 0.85, 0.53, 0.4, 0.0),
    ("titanium", "metal", 4.43, 0.58, 0.58, 0.62, 0.0),
    ("pla", "polymer", 1.24, 0.15, 0.45, 0.85, 0.0),
    ("petg", "polymer", 1.27, 0.15, 0.65, 0.45, 0.15),
    ("abs", "polymer", 1.04, 0.92, 0.52, 0.12, 0.0),
    ("nylon", "polymer", 1.01, 0.9, 0.9, 0.92, 0.0),
    ("pom", "polymer", 1.41, 0.88, 0.88, 0.88, 0.0),
    ("rubber", "elastomer", 1.2, 0.18, 0.18, 0.18, 0.0),
    ("silicone", "elastomer", 1.15, 0.85, 0.88, 0.9, 0.4),
    ("carbon_fiber", "composite", 1.55, 0.2, 0.2, 0.22, 0.0),
]
# fixed values: another name of a material, and the material
ALIASES = [
    ("glass", "glass"),
    ("glass_clear", "glass"),
    ("borosilicate", "glass"),
    ("pyrex", "glass"),
    ("float_glass", "soda_lime_glass"),
    ("window_glass", "soda_lime_glass"),
    ("soda_lime", "soda_lime_glass"),
    ("silica", "quartz"),
    ("fused_silica", "quartz"),
    ("fused_quartz", "quartz"),
    ("pmma", "acrylic"),
    ("plexiglass", "acrylic"),
    ("plexi", "acrylic"),
    ("perspex", "acrylic"),
    ("pc", "polycarbonate"),
    ("lexan", "polycarbonate"),
    ("makrolon", "polycarbonate"),
    ("inox", "steel"),
    ("stainless", "steel"),
    ("stainless_steel", "steel"),
    ("ss316", "steel"),
    ("ss316l", "steel"),
    ("ss304", "steel"),
    ("metal", "steel"),
    ("iron", "mild_steel"),
    ("carbon_steel", "mild_steel"),
    ("aisi_1020", "mild_steel"),
    ("al", "aluminum"),
    ("alu", "aluminum"),
    ("aluminium", "aluminum"),
    ("al6061", "aluminum"),
    ("6061", "aluminum"),
    ("bronze", "brass"),
    ("c36000", "brass"),
    ("cu", "copper"),
    ("c11000", "copper"),
    ("ti", "titanium"),
    ("ti6al4v", "titanium"),
    ("grade_5", "titanium"),
    ("plastic", "pla"),
    ("polylactic", "pla"),
    ("pa", "nylon"),
    ("pa12", "nylon"),
    ("pa6", "nylon"),
    ("polyamide", "nylon"),
    ("delrin", "pom"),
    ("acetal", "pom"),
    ("polyacetal", "pom"),
    ("nbr", "rubber"),
    ("nitrile", "rubber"),
    ("gasket", "rubber"),
    ("seal", "rubber"),
    ("o_ring", "rubber"),
    ("silicone_rubber", "silicone"),
    ("carbon", "carbon_fiber"),
    ("carb", "carbon_fiber"),
    ("car", "carbon_fiber"),
    ("cfrp", "carbon_fiber"),
]


def threads(spark: SparkSession) -> DataFrame:
    rows = [(i, *t, t[1] in PREFERRED) for i, t in enumerate(THREADS)]
    return spark.createDataFrame(rows, "pos int, designation string, nominal double, pitch double, tap_drill double, pitch_dia double, minor_internal double, preferred boolean")


def materials(spark: SparkSession) -> DataFrame:
    rows = [(i, *m) for i, m in enumerate(MATERIALS)]
    return spark.createDataFrame(rows, "pos int, id string, category string, density_g_cm3 double, red double, green double, blue double, transparency double")


def names(spark: SparkSession) -> DataFrame:
    """(name, id): each material's id and its aliases; an id wins over an alias of the same name."""
    known = {m[0]: m[0] for m in MATERIALS}
    rows = list(known.items()) + [(a, m) for a, m in ALIASES if a not in known]
    return spark.createDataFrame(rows, "name string, id string")
