"""Integer stores of tokenized pairs, result files and statistics files."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RECORD = "run string, test_set string, seed int, beam int, n long, metrics map<string,double>, bleu_signature string"


def write_store(rows: DataFrame, path: str) -> None:
    """(idx, src, tgt) as Parquet, in ranges of ids, so that a reader of some ids opens few files."""
    rows.select("idx", "src", "tgt").repartitionByRange("idx").sortWithinPartitions("idx").write.mode("overwrite").parquet(path)


def read_store(spark: SparkSession, path: str, ids: list[int] | None = None) -> DataFrame:
    """The store with the length used for bucketing; given ids are pushed down to the files' statistics."""
    rows = spark.read.schema("idx long, src array<int>, tgt array<int>").parquet(path)
    rows = rows if ids is None else rows.where(F.col("idx").isin(ids))
    return rows.withColumn("length", F.greatest(F.size("src"), F.size("tgt")))


def export_binary(rows: DataFrame, prefix: str) -> int:
    """For readers outside Spark: <prefix>.src.bin and .tgt.bin (uint16) and .idx.npy (offset and length of both, int64).

    Rows are streamed through the driver in order, partition by partition, and the index is written as
    they come; nothing that grows with the rows stays in memory.
    """
    count, at = rows.count(), [0, 0]
    index = np.lib.format.open_memmap(f"{prefix}.idx.npy", "w+", np.int64, (count, 4)) if count else np.zeros((0, 4), np.int64)
    with open(f"{prefix}.src.bin", "wb") as src, open(f"{prefix}.tgt.bin", "wb") as tgt:
        for i, row in enumerate(rows.orderBy("idx").toLocalIterator()):
            entry: list[int] = []
            for k, (file, ids) in enumerate(((src, row["src"]), (tgt, row["tgt"]))):
                file.write(np.array(ids, np.uint16).tobytes())
                entry += [at[k], len(ids)]
                at[k] += len(ids)
            index[i] = entry
    if count:
        index.flush()
    else:
        np.save(f"{prefix}.idx.npy", index)
    return count


def load_results(spark: SparkSession, path: str) -> DataFrame:
    """Result records appended so far; none if the folder isn't there."""
    try:
        return spark.read.schema(RECORD + ", version long").json(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], RECORD + ", version long")


def append_results(records: DataFrame, path: str, version: int) -> None:
    """Append records with a version. Jobs that run side by side never rewrite each other's; readers take the latest of each key."""
    records.withColumn("version", F.lit(version).cast("long")).write.mode("append").json(path)


def save_stats(stats: DataFrame, path: str) -> None:
    stats.coalesce(1).write.mode("overwrite").json(path)
