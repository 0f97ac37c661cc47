"""Results that several others are made of, computed once and kept as leaves of later plans."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import DataFrame


def kept(df: DataFrame) -> DataFrame:
    """df computed now, in the folder that spark.checkpoint.dir names (one of our own where none is named and all runs on this
    machine): plans that use it often stay small, and lost executors cost nothing."""
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        named = df.sparkSession.conf.get("spark.checkpoint.dir", None)
        if not named:
            if sc.master.split("[")[0] != "local":
                raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            folder = tempfile.mkdtemp(prefix="meshloom-")
            atexit.register(shutil.rmtree, folder, True)
            named = "file://" + folder
        sc.setCheckpointDir(named)
    return df.checkpoint(eager=True)
