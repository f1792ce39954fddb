"""The cleaning funnel, its counts and statistics, samples, splits and keyed upserts."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bitloom.functions import text as tx


@dataclass(frozen=True)
class FilterConfig:
    """Bounds of the cheap filters; all inclusive, lengths in code points."""

    ja_min: int = 1
    ja_max: int = 250
    en_min: int = 1
    en_max: int = 500
    ratio_min: float = 0.5
    ratio_max: float = 6.0
    require_japanese: bool = True
    require_latin: bool = True
    latin_min: float = 0.5


@dataclass(frozen=True)
class LangIDConfig:
    ja: str = "ja"
    en: str = "en"
    min_confidence: float = 0.5
    min_chars: int = 10


STAGES = ["length", "ratio", "script", "dedup", "langid", "labse"]
ORDER = ["source_ord", "doc_id", "line_no"]


def length_ok(ja: Column, en: Column, cfg: FilterConfig) -> Column:
    return F.length(ja).between(cfg.ja_min, cfg.ja_max) & F.length(en).between(cfg.en_min, cfg.en_max)


def ratio_ok(ja: Column, en: Column, cfg: FilterConfig) -> Column:
    ratio = F.length(en) / F.nullif(F.length(ja), F.lit(0))
    return F.coalesce((F.length(en) > 0) & ratio.between(cfg.ratio_min, cfg.ratio_max), F.lit(False))


def script_ok(ja: Column, en: Column, cfg: FilterConfig) -> Column:
    ok = F.lit(True)
    if cfg.require_japanese:
        ok = ok & tx.has_japanese(ja)
    if cfg.require_latin:
        ok = ok & (tx.latin_ratio(en) >= cfg.latin_min)
    return ok


def cheap_stage(ja: Column, en: Column, cfg: FilterConfig) -> Column:
    """Name of the first cheap filter that rejects the pair; null if none does."""
    return (
        F.when(~length_ok(ja, en, cfg), "length").when(~ratio_ok(ja, en, cfg), "ratio").when(~script_ok(ja, en, cfg), "script")
    )


def key_digest(ja: Column, en: Column) -> Column:
    """128 bits of the duplicate key's SHA-256: what is shuffled instead of the texts."""
    key = tx.dedup_key(ja, en)
    return F.substring(F.sha2(F.concat_ws("\0", key["ja"], key["en"]), 256), 1, 32)


def langid_stage(pairs: DataFrame, predict: Callable[[Column], Column], cfg: LangIDConfig) -> DataFrame:
    """Set stage to ``langid`` on pairs whose sides don't read as their languages.

    ``predict`` gives struct<lang, conf>. Short pairs pass; their texts reach the classifier as null.
    """
    long_enough = F.col("stage").isNull() & (F.length("ja") >= cfg.min_chars) & (F.length("en") >= cfg.min_chars)
    side = lambda c: predict(F.when(long_enough, F.col(c)))
    judged = pairs.withColumn("_ja", side("ja")).withColumn("_en", side("en"))
    good = lambda p, lang: (F.col(f"{p}.lang") == lang) & (F.col(f"{p}.conf") >= cfg.min_confidence)
    fails = long_enough & ~F.coalesce(good("_ja", cfg.ja) & good("_en", cfg.en), F.lit(False))
    return judged.withColumn("stage", F.when(fails, "langid").otherwise(F.col("stage"))).drop("_ja", "_en")


def funnel_stages(
    raw: DataFrame, cfg: FilterConfig | None = None, predict: Callable[[Column], Column] | None = None, langid: LangIDConfig | None = None,
    normalize: Callable[[Column], Column] = tx.normalize_text,
) -> DataFrame:
    """Every raw pair (ja_raw, en_raw, source and order) with ja, en and ``stage``, the filter that dropped it or null.

    Duplicates are judged among pairs that pass the cheap filters, over all sources, and before
    language identification: the first in order survives, even if that check drops it later. The
    first row of each key comes from a partial aggregate, so a key that a large share of the rows have
    doesn't gather them in one task; in the join AQE splits it. A pair that is rejected before gets a
    key of its own, which nothing meets: it is dealt out evenly, and its normalization isn't repeated
    in a branch of its own. Only digests and orders go into the aggregate.
    """
    cfg = cfg or FilterConfig()
    staged = (
        raw.withColumn("ja", normalize(F.col("ja_raw")))
        .withColumn("en", normalize(F.col("en_raw")))
        .drop("ja_raw", "en_raw")
        .withColumn("stage", cheap_stage(F.col("ja"), F.col("en"), cfg))
    )
    keyed = staged.withColumn("_key", F.when(F.col("stage").isNull(), key_digest(F.col("ja"), F.col("en"))))
    # rejected pairs are one null group here; asking for it after the aggregate keeps the filters from being evaluated twice
    found = keyed.groupBy("_key").agg(F.min(F.struct(*ORDER)).alias("_first"), F.count("_key").alias("_n")).where("_n > 0")
    first = found.select(F.col("_key").alias("_k"), "_first")
    own = F.coalesce(F.col("_key"), F.concat(F.lit("-"), F.xxhash64(*ORDER).cast("string")))
    # null-safe, although no key is null: of a plain equation Spark makes a filter by key, below the aggregate
    joined = keyed.withColumn("_own", own).join(first, F.col("_own").eqNullSafe(F.col("_k")), "left")
    repeated = F.col("_first").isNotNull() & (F.struct(*ORDER) != F.col("_first"))
    judged = joined.withColumn("stage", F.when(repeated, "dedup").otherwise(F.col("stage"))).drop("_key", "_own", "_k", "_first")
    return langid_stage(judged, predict, langid or LangIDConfig()) if predict is not None else judged


def funnel_counts(staged: DataFrame, totals: bool = False) -> DataFrame:
    """Per source: input, drops by stage, kept, keep_rate (4 decimals; 0 of nothing); with ``totals`` a row ALL."""
    drops = [F.count(F.when(F.col("stage") == s, 1)).alias(s) for s in STAGES]
    grouped = staged.rollup("source") if totals else staged.groupBy("source")
    counts = grouped.agg(F.count("*").alias("input_pairs"), *drops, F.count(F.when(F.col("stage").isNull(), 1)).alias("kept"))
    if totals:
        counts = counts.withColumn("source", F.coalesce("source", F.lit("ALL")))
    return counts.withColumn("keep_rate", F.coalesce(F.round(F.col("kept") / F.nullif(F.col("input_pairs"), F.lit(0)), 4), F.lit(0.0)))


def semantic_stage(staged: DataFrame, score: Column, flagged: Column, threshold: float = 0.6) -> DataFrame:
    """Drop kept pairs of flagged sources whose similarity is below the threshold (stage ``labse``)."""
    low = F.col("stage").isNull() & flagged & (F.coalesce(score, F.lit(0.0)) < threshold)
    return staged.withColumn("stage", F.when(low, "labse").otherwise(F.col("stage")))


# --- statistics ------------------------------------------------------------------------------------


def length_stats(
    rows: DataFrame, length: Column, by: list[str] | None = None, sums: dict[str, Column] | None = None, more: list[Column] | None = None
) -> DataFrame:
    """n, mean (2 decimals), p50, p95, max of a length; percentiles by nearest rank with half-even rounding; 0 of nothing.

    From the exact histogram, so rows are aggregated before they are shuffled. ``more``: further aggregates of the histogram
    (length v, count c), which has the ``sums`` too.
    """
    by = by or []
    sums = {name: c.alias(name) for name, c in (sums or {}).items()}
    # lengths that are null are one group; asked for before the aggregate, a costly length would be evaluated twice
    histogram = rows.select(*by, length.alias("v"), *sums.values()).groupBy(*by, "v").agg(F.count("v").alias("c"), *[F.sum(name).alias(name) for name in sums]).where("c > 0")
    part = Window.partitionBy(*(by or [F.lit(0)]))
    cumulated = histogram.withColumn("cum", F.sum("c").over(part.orderBy("v").rowsBetween(Window.unboundedPreceding, 0))).withColumn(
        "n", F.sum("c").over(part)
    )
    rank = lambda p: F.bround(F.lit(p / 100) * (F.col("n") - 1), 0)
    at = lambda p: F.coalesce(F.min(F.when(F.col("cum") > rank(p), F.col("v"))), F.lit(0)).cast("long")
    return cumulated.groupBy(*by).agg(
        F.coalesce(F.sum("c"), F.lit(0)).alias("n"),
        F.coalesce(F.round(F.sum(F.col("v") * F.col("c")) / F.nullif(F.sum("c"), F.lit(0)), 2), F.lit(0.0)).alias("mean"),
        at(50).alias("p50"), at(95).alias("p95"), F.coalesce(F.max("v"), F.lit(0)).cast("long").alias("max"), *(more or []),
    )


# --- samples and splits ----------------------------------------------------------------------------


def shuffle_key(seed: int, *columns: Column) -> Column:
    """A seeded order that any engine reproduces."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *columns))


def take_shuffled(rows: DataFrame, n: int, seed: int, columns: list[Column], ties: list[str]) -> DataFrame:
    """n rows of a seeded uniform order, with their place ``i`` from 0. Top-n in each partition, then of those."""
    first = rows.withColumn("_h", shuffle_key(seed, *columns)).orderBy("_h", *ties).limit(n)
    return first.withColumn("i", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("_h", *ties)) - 1).drop("_h")


def split_holdout(rows: DataFrame, valid: int, test: int, seed: int, columns: list[Column], ties: list[str], small_rule: str = "share") -> DataFrame:
    """``rows`` with ``split``: train, valid or test.

    The holdout is the first valid + test rows of the seeded order. With fewer rows than that, by
    ``share`` all are holdout, valid in proportion and train empty; by ``fifth`` the holdout is a
    fifth of the rows, half of it valid. Only the holdout is numbered; it joins back by its ids.
    """
    total, holdout = rows.count(), valid + test
    if total < holdout if small_rule == "share" else total <= holdout:
        held, valid = (total, total * valid // holdout) if small_rule == "share" else (total // 5, total // 10)
    else:
        held = holdout
    values = [c.alias(f"_c{k}") for k, c in enumerate(columns)]
    top = take_shuffled(rows.select(*ties, *values), held, seed, [F.col(f"_c{k}") for k in range(len(columns))], ties)
    chosen = top.select(*[F.col(t).alias(f"_{t}") for t in ties], "i")
    same = [F.col(t).eqNullSafe(F.col(f"_{t}")) for t in ties]
    return rows.join(chosen, same, "left").select(
        rows["*"], F.when(F.col("i").isNull(), "train").when(F.col("i") < valid, "valid").otherwise("test").alias("split")
    )


# --- keyed results ---------------------------------------------------------------------------------


def latest(records: DataFrame, keys: list[str], version: str) -> DataFrame:
    """One row for each key, of the highest version. Null keys are keys. Aggregated before the shuffle."""
    rest = [c for c in records.columns if c not in keys]
    newest = records.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col(version)).alias("_r"))
    return newest.select(*keys, *[F.col(f"_r.{c}").alias(c) for c in rest])


def rollup_results(records: DataFrame, metrics: list[str]) -> DataFrame:
    """By run, test set and beam (1 if null): distinct seeds; of each metric values, mean and population deviation, nulls left out."""
    aggregates = [x for m in metrics for x in (F.count(m).alias(f"{m}_n"), F.avg(m).alias(f"{m}_mean"), F.stddev_pop(m).alias(f"{m}_std"))]
    return records.groupBy("run", "test_set", F.coalesce("beam", F.lit(1)).alias("beam")).agg(F.countDistinct("seed").alias("seeds"), *aggregates)
