"""A corpus pipeline of five stages over `documents`: language ID, near-dedup, repeat removal, mixing, byte-level BPE."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from meshloom.llm import bpe, language, minhash, mixing, repeats
from meshloom.llm.common import drop_path, dropped, paths, stored

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
_LEFT: set[str] = set()  # tables that the last stage's result was made of


def _in_turn(stage: Stage) -> Stage:
    """A stage whose documents are the written and reread result of the stage before it, as STAGES asks for. So what that
    result was made of goes from disk here."""

    def run_(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        for path in _LEFT & paths():
            drop_path(spark, path)
        before = paths()
        out = stage(spark, docs, sf_dir)
        _LEFT.clear()
        _LEFT.update(paths() - before)
        return out

    return run_


STAGES = [
    ("language_id", _in_turn(language.stage)),
    ("minhash_dedup", _in_turn(minhash.stage)),
    ("repeat_removal", _in_turn(repeats.stage)),
    ("source_mixing", _in_turn(mixing.stage)),
    ("byte_bpe", _in_turn(bpe.stage)),
]

#: The language model and the balanced rates are fitted by iteration, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn, each written as Parquet to the shared folder and read again as the next one's documents."""
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
        dropped(*last)
        last = [docs]
    return docs
