"""Mixing sources to target weights by systematic sampling. DataFrame functions only.

Every document of a source has the same expected number of copies, target / source size. The
documents of a source are laid in one fixed order; the prefix sum of expected copies after the
r-th document is r * rate; with one random offset u in [0, 1) per source a document is emitted
once for each integer in (u + (r-1) * rate, u + r * rate]. So the copies of any run of documents
differ from their expectation by less than one, and the order by size class keeps the words that
are taken close to the target.

The prefix sum is built in three levels, so that no task holds a whole source: counts of size
classes within a source, counts of buckets within a size class, ranks within a bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bitloom.llm.common import WORD, cut

#: Weights of sources by rank, repeating.
WEIGHTS = (1, 2, 3)
#: No source is repeated more often than this on average, and no document more often at all.
MAX_COPIES = 3
OWN = ("_size", "_source_size", "_target", "_copies", "_copy", "_class", "_bucket", "_same", "_rank", "_s", "_c", "_b", "_start")


def word_count(text: Column) -> Column:
    """Number of words of a text; null counts as empty."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def unit_hash(key: Column) -> Column:
    """A number in [0, 1) that depends on the key alone (32 bits of its MD5)."""
    return F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def source_targets(sizes: DataFrame) -> DataFrame:
    """One row per source: source, source_size, target.

    ``sizes`` has source and source_size. Sources in code point order, null last, weigh 1, 2, 3,
    repeating. Targets are w * level, at most MAX_COPIES times the source's size, and add up to
    the total. As the sources are taken by rising (cap / weight), the sources at their cap are a
    prefix of that order, so the level follows from prefix sums without iterating.
    The input has one row per source, never rows of documents.
    """
    ranked = sizes.select(
        "source",
        "source_size",
        (F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.col("source").asc_nulls_last())) - 1).alias("_k"),
    )
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.col("_k") % len(WEIGHTS) + 1).cast("int"))
    caps = ranked.withColumn("_w", weight.cast("double")).withColumn(
        "_cap", F.col("source_size").cast("double") * MAX_COPIES
    )
    order = Window.partitionBy(F.lit(0)).orderBy((F.col("_cap") / F.col("_w")).asc(), F.col("_k").asc())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(0))
    levels = caps.select(
        "*",
        F.sum("source_size").over(everything).cast("double").alias("_total"),
        F.coalesce(F.sum("_cap").over(before), F.lit(0.0)).alias("_capped"),
        (F.sum("_w").over(everything) - F.coalesce(F.sum("_w").over(before), F.lit(0.0))).alias("_open"),
    ).withColumn("_level", (F.col("_total") - F.col("_capped")) / F.col("_open"))
    # the first source that stays below its cap sets the level of all that follow
    found = levels.withColumn(
        "_first",
        F.min(F.when(F.col("_w") * F.col("_level") < F.col("_cap"), F.struct(F.col("_cap") / F.col("_w"), "_k", "_level"))).over(
            everything
        ),
    )
    return found.select(
        "source",
        "source_size",
        F.when(F.col("_first").isNull(), F.col("_cap"))
        .otherwise(F.least(F.col("_cap"), F.col("_w") * F.col("_first._level")))
        .alias("target"),
    )


def size_class(size: Column) -> Column:
    """Eight classes per doubling of the size, in order of size."""
    return F.when(size <= 0, F.lit(-1)).otherwise(F.floor(F.log2(size.cast("double") + 0.5) * 8)).cast("int")


def mix(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id") -> DataFrame:
    """All rows of ``docs`` and _size, _source_size, _target, _copies.

    Null text is empty; null sources are one source; a source without words has target 0 and no
    copies. Rows with the same id and text are separate documents; rows equal in source, id and text
    are interchangeable, any others have a fixed order, so reruns agree. Rows without an id are told
    apart by their text. Empty tables give empty results. Other columns are kept as they are, but for
    those whose names are used here (OWN), which are replaced or dropped.
    """
    sized = docs.drop(*OWN).withColumn("_size", word_count(F.col(text)))
    same_text = F.xxhash64(text)
    known = F.coalesce(F.col(doc_id).cast("string"), F.concat(F.lit("text|"), same_text.cast("string")))
    cells = sized.withColumns({"_class": size_class(F.col("_size")), "_bucket": F.substring(F.md5(known), 1, 2), "_same": same_text})
    key = [F.col(source).alias("_src"), "_class", "_bucket"]
    # counts of cells are needed three times; written once, so that texts are counted in two passes, not four
    counts = cut(cells.groupBy(*key).agg(F.count("*").alias("_n"), F.sum("_size").alias("_words")), "cells")
    of_class = counts.groupBy("_src", "_class").agg(F.sum("_n").alias("_nc"), F.sum("_words").alias("_wc"))
    of_source = of_class.groupBy(F.col("_src").alias("source")).agg(F.sum("_wc").alias("source_size"))
    targets = source_targets(of_source).select(F.col("source").alias("_src"), F.col("source_size").alias("_source_size"), F.col("target").alias("_target"))
    running = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    class_start = of_class.withColumn(
        "_class_start", F.coalesce(F.sum("_nc").over(running(Window.partitionBy("_src").orderBy("_class"))), F.lit(0))
    ).drop("_nc", "_wc")
    bucket_start = counts.withColumn(
        "_bucket_start",
        F.coalesce(F.sum("_n").over(running(Window.partitionBy("_src", "_class").orderBy("_bucket"))), F.lit(0)),
    ).drop("_n", "_words")
    starts = (
        bucket_start.alias("b")
        .join(class_start.alias("c"), [F.col("b._src").eqNullSafe(F.col("c._src")), F.col("b._class") == F.col("c._class")])
        .join(targets.alias("t"), F.col("b._src").eqNullSafe(F.col("t._src")))
        .select(
            F.col("b._src").alias("_s"), F.col("b._class").alias("_c"), F.col("b._bucket").alias("_b"),
            (F.col("_bucket_start") + F.col("_class_start")).alias("_start"), "_source_size", "_target",
        )
    )
    in_bucket = Window.partitionBy(source, "_class", "_bucket").orderBy("_size", doc_id, "_same")
    ranked = cells.withColumn("_rank", F.row_number().over(in_bucket))
    joined = ranked.join(
        starts,
        [F.col(source).eqNullSafe(F.col("_s")), F.col("_class") == F.col("_c"), F.col("_bucket") == F.col("_b")],
    )
    rate = F.when(F.col("_source_size") > 0, F.col("_target") / F.col("_source_size")).otherwise(F.lit(0.0))
    offset = unit_hash(F.concat(F.lit("mix|"), F.coalesce(F.col(source), F.lit("\0"))))
    at = lambda r: F.floor(r.cast("double") * rate + offset)
    last = F.col("_start") + F.col("_rank")
    copies = F.least(at(last) - at(last - 1), F.lit(MAX_COPIES)).cast("long")
    return joined.withColumn("_copies", copies).drop("_class", "_bucket", "_same", "_rank", "_s", "_c", "_b", "_start")


def emit(mixed: DataFrame) -> DataFrame:
    """The mixed corpus itself: each document as often as ``mix`` says."""
    kept = mixed.where("_copies > 0")
    return kept.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies"))))


def query(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken of every document."""
    return mix(docs.select("doc_id", "source", "text")).select(
        "doc_id",
        F.col("_size").alias("size"),
        F.col("_source_size").alias("source_size"),
        F.col("_target").alias("target"),
        (F.col("_copies") * F.col("_size")).alias("taken"),
    )


SQL = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), cells AS (
  SELECT *, CASE WHEN size <= 0 THEN -1 ELSE floor(log2(size::DOUBLE + 0.5) * 8)::INT END AS class,
         substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 2) AS bucket FROM sized
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) - 1 AS k
  FROM sized GROUP BY source
), caps AS (
  SELECT *, (k % 3 + 1)::DOUBLE AS w, 3.0::DOUBLE * source_size AS cap FROM sources
), levels AS (
  SELECT *, (sum(source_size) OVER ()::DOUBLE
             - coalesce(sum(cap) OVER (ORDER BY cap / w, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / (sum(w) OVER ()
             - coalesce(sum(w) OVER (ORDER BY cap / w, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level
  FROM caps
), targets AS (
  SELECT source, source_size,
         coalesce(least(cap, w * (SELECT arg_min(level, cap / w) FROM levels WHERE w * level < cap)), cap) AS target FROM levels
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY class, bucket, size, doc_id NULLS FIRST) AS r FROM cells
), laid AS (
  SELECT ranked.doc_id, ranked.source, ranked.size, ranked.r, source_size, target,
         CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate,
         ('0x' || substr(md5('mix|' || coalesce(ranked.source, chr(0))), 1, 8))::BIGINT::DOUBLE / 4294967296.0 AS u
  FROM ranked JOIN targets ON ranked.source IS NOT DISTINCT FROM targets.source
)
SELECT doc_id, size, source_size, target,
       least(floor(r::DOUBLE * rate + u) - floor((r - 1)::DOUBLE * rate + u), 3)::BIGINT * size AS taken FROM laid
"""
