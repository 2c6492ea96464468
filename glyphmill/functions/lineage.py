"""Cutting the lineage of DataFrames that a loop makes anew."""

from __future__ import annotations

import functools
import tempfile

from pyspark.sql import DataFrame


@functools.cache
def _own_folder(app: str) -> str:
    return tempfile.mkdtemp(prefix="glyphmill-steps-")


def settled(df: DataFrame) -> DataFrame:
    """df written to the folder in spark.checkpoint.dir, which all executors share, and read from there. Where it is unset a folder of our own serves, on a local master only."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        base = sc.getConf().get("spark.checkpoint.dir")
        if not base:
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            base = _own_folder(sc.applicationId)
        sc.setCheckpointDir(base)
    return df.checkpoint()
