"""Parquet tables, dealt out over the cluster's cores where there are fewer row groups than cores; paths of scratch tables."""

from __future__ import annotations

import atexit
import re
import shutil
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Bytes of a table that is dealt out anew. A larger one has row groups for many tasks of its own, a smaller one isn't worth it.
LEAST, MOST = 1 << 18, 1 << 30


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def spread(rows: DataFrame) -> DataFrame:
    """A small table in fewer parts than there are cores, dealt out to all of them; any other as it is.

    A file of one row group is read by one task, and what is computed from its rows would stay in it.
    """
    cores = rows.sparkSession.sparkContext.defaultParallelism
    if rows.rdd.getNumPartitions() >= cores:
        return rows
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return rows.repartition(cores) if LEAST <= size <= MOST else rows


def scratch(spark: SparkSession, name: str) -> str:
    """A new path for a table, in the folder that driver and executors share: spark.checkpoint.dir, or the warehouse.

    Where all run in one process and the first is unset, a temporary folder that goes at the end.
    """
    there = spark.conf.get("spark.checkpoint.dir", None)
    if not there and re.match(r"local(\[|$)", spark.sparkContext.master):
        local = f"/tmp/bitloom-scratch-{spark.sparkContext.applicationId}"
        atexit.register(shutil.rmtree, local, ignore_errors=True)
        there = f"file://{local}"
    there = there or spark.conf.get("spark.sql.warehouse.dir")
    return f"{there.rstrip('/')}/{name}-{uuid.uuid4().hex}"
