"""Cutting the lineage of a reused table so that a lost executor does not replay the raw scan."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(session: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; a local session without it gets a folder of its own, a cluster is refused."""
    context = session.sparkContext
    known = context.getCheckpointDir() or session.conf.get("spark.checkpoint.dir", None)
    if known is None and context.master.startswith("local"):
        context.setCheckpointDir(tempfile.mkdtemp(prefix="driftpanel-"))
        known = context.getCheckpointDir()
    if known is None:
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return known


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back as a table.

    Later readers prune columns and know the size of the table, and nothing upstream is ever
    replayed.
    """
    path = f"{shared_folder(df.sparkSession)}/driftpanel-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
