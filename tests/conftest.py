import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from pyspark.sql import SparkSession

    s = (
        SparkSession.builder.master("local[4]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.checkpoint.dir", "file://" + str(tmp_path_factory.mktemp("shared")))
        .getOrCreate()
    )
    s.sparkContext.setLogLevel("ERROR")
    yield s
    s.stop()


def compared(con, sql, df):
    """None if the SQL's rows and the frame's are the same, else the first difference."""
    import math

    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want, got = cur.fetchall(), [tuple(r) for r in df.collect()]
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(names)} and {sorted(df.columns)}"

    def row(r, cols):
        out = []
        for c in sorted(cols):
            x = r[cols.index(c)]
            out.append((round(x, 6) + 0.0 if math.isfinite(x) else str(x)) if isinstance(x, float) else x)
        return tuple(out)

    a, b = sorted((row(r, names) for r in want), key=repr), sorted((row(r, df.columns) for r in got), key=repr)
    return None if a == b else f"{len(a)} and {len(b)} rows; {next(((x, y) for x, y in zip(a, b, strict=False) if x != y), None)}"


@pytest.fixture(scope="session")
def tables():
    import duckdb

    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '/root/testdata/sf0.001/{t}.parquet'")
    return con
