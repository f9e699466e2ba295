"""Intermediate tables in the folder that spark.checkpoint.dir names, so that iterations do not grow their lineage."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """df, computed and kept in the shared checkpoint folder; a folder of our own only where none is set."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(sc.getConf().get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="atlasloom-"))
    return df.checkpoint()
