"""Cutting lineage in loops: tables written below the folder that the cluster names in spark.checkpoint.dir."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """The shared folder. A temporary one is made only where none is named and all runs on this machine, as in tests."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir names no folder, and a machine-local one would be lost with an executor")
        if named is None:
            named = tempfile.mkdtemp(prefix="lineweave-")
            atexit.register(shutil.rmtree, named, ignore_errors=True)
        sc.setCheckpointDir(named)
    return sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Write df as a table below the shared folder and go on from its files, which outlive any executor.

    The next reader packs small files together, so a small table costs few tasks however many partitions wrote it.
    """
    path = f"{folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def free(*tables: DataFrame | None) -> None:
    """Delete what cut() wrote for these tables; whatever was made from them lazily must be done."""
    for table in tables:
        path = getattr(table, "written_to", None)
        if path is not None:
            sc = table.sparkSession.sparkContext
            at = sc._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(sc._jsc.hadoopConfiguration()).delete(at, True)
