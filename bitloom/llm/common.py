"""Helpers that several operators share: table loading, shared-folder tables, Arrow maps."""

from __future__ import annotations

import atexit
import contextlib
import re
import shutil
import uuid
from collections.abc import Callable, Iterator

import bitloom
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bitloom.sources.tables import read_table

# Tasks carry this package's code with them: executors need not have it on their paths.
cloudpickle.register_pickle_by_value(bitloom)

#: Characters that separate words, as in every contract: space, tab, LF, VT, FF, CR.
WORD = r"[^\x20\x09-\x0D]+"

#: Rows in one Arrow batch. With long texts a batch is cut further by ``slices``.
BATCH_ROWS = "500"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_table(spark, sf_dir, name)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's spark.checkpoint.dir.

    Only where it is unset and all run in one process (tests) a local folder is chosen and set; on a
    cluster it is an error, since other executors would not see what is written there.
    """
    there = spark.conf.get("spark.checkpoint.dir", None)
    if not there:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        local = f"/tmp/bitloom-checkpoints-{spark.sparkContext.applicationId}"
        atexit.register(shutil.rmtree, local, ignore_errors=True)
        there = f"file://{local}"
        spark.conf.set("spark.checkpoint.dir", there)
    return there.rstrip("/")


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: the lineage ends there."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if not _WRITTEN:
        atexit.register(_clear)
    _WRITTEN.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_WRITTEN: list[str] = []


def _clear() -> None:
    """Delete the tables that ``cut`` wrote when the driver ends, if its session is still there."""
    spark = SparkSession.getActiveSession()
    if spark is not None and spark.sparkContext._jsc is not None:
        with contextlib.suppress(Exception):
            _delete(spark, _WRITTEN)


def _delete(spark: SparkSession, paths: list[str]) -> None:
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    for name in paths:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(hadoop).delete(path, True)


def drop_table(df: DataFrame) -> None:
    """Delete the files of a table that ``cut`` wrote, once nothing will read it again."""
    _delete(df.sparkSession, list({f.rsplit("/", 1)[0] for f in df.inputFiles()}))


def arrow_map(
    df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str
) -> DataFrame:
    """``mapInArrow`` with batches of at most BATCH_ROWS rows, so that worker memory is bounded."""
    conf = df.sparkSession.conf
    if int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > int(BATCH_ROWS):
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    return df.mapInArrow(fn, schema)


def slices(texts: pa.Array, limit: int = 1 << 21) -> Iterator[tuple[int, int]]:
    """Row ranges [a, b) of a batch with about ``limit`` bytes of text each (one row at least)."""
    import pyarrow.compute as pc

    size, start = 0, 0
    for i, n in enumerate(pc.binary_length(texts).to_pylist()):
        if i > start and size + (n or 0) > limit:
            yield start, i
            size, start = 0, i
        size += n or 0
    if len(texts) > start:
        yield start, len(texts)


def fold_of(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds`` (null ids: fold 0)."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(folds)), F.lit(0))
