"""Intermediate tables in the folder that all executors share.

The folder is the session's ``spark.checkpoint.dir``.  Only where that is unset and the session is local (tests,
notebooks) a temporary folder of this machine is used, entered into the session and removed at its end; on a cluster an
unset folder is an error.
"""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

KEY = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The shared folder; set to a temporary one where a local session names none."""
    at = spark.sparkContext.getConf().get(KEY) or spark.conf.get(KEY, None)
    if not at:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError(f"set {KEY} to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="sieveline-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        at = "file://" + folder
        spark.conf.set(KEY, at)
        spark.sparkContext.setCheckpointDir(at)
    return at.rstrip("/")


def save(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once into the shared folder and return the written table.

    Cuts the lineage: what follows reads files that survive the loss of any executor.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/sieveline/{name}-{uuid.uuid4().hex[:12]}"
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """``df`` over at least as many partitions as there are cores; tables of enough files or splits come back as they are.

    For work that costs far more per row than its shuffle, on inputs of a few small files.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def forget(spark: SparkSession) -> None:
    """Delete the intermediate tables of this session's runs; no result that reads them may be in use."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/sieveline")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
