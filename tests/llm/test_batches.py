import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from meshloom.llm import common, repeats

KEY = "spark.sql.execution.arrow.maxBytesPerBatch"


def test_batches_that_reach_a_worker_are_bounded_in_bytes(spark):
    """3,000 texts of 10,000 bytes in one partition, planned after mapped() has returned; rows stay whole, and a limit of
    the session's own stays."""

    def _sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], names=["n", "size"])

    spark.conf.unset(KEY)
    long = spark.range(3000).coalesce(1).select(F.repeat(F.lit("x"), 10_000).alias("text"))
    got = common.mapped(long, _sizes, "n long, size long").collect()
    assert sum(r.n for r in got) == 3000 and max(r.size for r in got) < 1.1 * common.BATCH_BYTES
    spark.conf.set(KEY, 1 << 20)
    try:
        assert max(r.size for r in common.mapped(long, _sizes, "n long, size long").collect()) < 1.1 * (1 << 20)
    finally:
        spark.conf.unset(KEY)


def test_cells_are_found_in_small_slices(monkeypatch):
    """No more than SLICE bytes of several texts at once, and the same cells as of all texts together."""
    rng = np.random.Generator(np.random.PCG64(3))
    texts = ["".join(map(chr, rng.integers(97, 123, int(n)))) for n in rng.integers(0, 3000, 800)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(800)), pa.array(range(800)), pa.array(texts)], names=["id", "fp", "text"])
    seen, cells = [], repeats.cells
    monkeypatch.setattr(repeats, "cells", lambda raw, ends, length: seen.append(len(raw)) or cells(raw, ends, length))
    small = pa.Table.from_batches(list(repeats._find(400)(iter([batch]))))
    assert len(seen) > 4 and max(seen) <= 1 << 18
    monkeypatch.setattr(repeats, "SLICE", 1 << 30)
    assert pa.Table.from_batches(list(repeats._find(400)(iter([batch])))).to_pylist() == small.to_pylist()
