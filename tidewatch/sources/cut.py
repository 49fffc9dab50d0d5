"""Cutting lineage: results that are read more than once are written to the cluster's shared folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and kept as a table in the shared folder of the session (spark.checkpoint.dir) until the session ends.

    A table rather than checkpoint(), which computes its rows twice: once to count and once to write. Only where the session
    names no folder, as in local tests, a temporary one is used; a cluster always names a shared one.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    set_dir = context._jsc.sc().getCheckpointDir()
    folder = set_dir.get() if set_dir.isDefined() else spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir", None) or tempfile.mkdtemp()
    path = f"{folder}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    at = context._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(context._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)
