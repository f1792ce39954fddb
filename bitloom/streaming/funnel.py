"""The cleaning funnel over a stream: each micro-batch is cleaned and joined with a table of the keys seen so far.

First-wins deduplication over an unbounded stream needs all keys for good; they are kept in a
table (Parquet files on the shared storage), not in the streaming state. A batch scans the table's
keys, 32 characters each, beside its own; its own are the smaller side, which Spark can broadcast, so
the keys seen so far need no shuffle. A batch that is run again replaces what it wrote before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from bitloom.operators.corpus import ORDER, FilterConfig, funnel_stages, key_digest


def stream_funnel(raw: DataFrame, keys_path: str, out_path: str, checkpoint: str, cfg: FilterConfig | None = None) -> StreamingQuery:
    """Start the funnel on a stream of raw pairs (source, source_ord, doc_id, line_no, ja_raw, en_raw)."""

    def clean(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        staged = funnel_stages(batch, cfg)
        own = F.when(F.col("stage").isNull(), key_digest(F.col("ja"), F.col("en"))).otherwise(F.concat(F.lit("-"), F.xxhash64(*ORDER).cast("string")))
        keyed = staged.withColumn("_own", own)
        try:
            seen = spark.read.parquet(keys_path).where(F.col("batch") < number)
        except Exception as e:  # the table isn't there before the first batch
            if "PATH_NOT_FOUND" not in str(e):
                raise
            seen = spark.createDataFrame([], "key string, batch int")
        mine = keyed.where("stage IS NULL").select(F.col("_own").alias("key"))  # one row a key: later ones are duplicates
        old = seen.join(mine, "key").select(F.col("key").alias("_k")).distinct()
        judged = keyed.join(old, F.col("_own") == F.col("_k"), "left")
        final = judged.withColumn("stage", F.when(F.col("_k").isNotNull(), "dedup").otherwise(F.col("stage"))).drop("_k", "_own")
        out = f"{out_path}/batch={number}"
        final.write.mode("overwrite").parquet(out)
        # from what was written, so that the batch isn't cleaned once more; keys of duplicates are there already
        kept = spark.read.schema(final.schema).parquet(out).where("stage IS NULL")
        kept.select(key_digest(F.col("ja"), F.col("en")).alias("key")).write.mode("overwrite").parquet(f"{keys_path}/batch={number}")

    return raw.writeStream.foreachBatch(clean).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
