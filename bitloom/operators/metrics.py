"""Translation quality: corpus chrF and BLEU, cosine similarity of embeddings, label-smoothed loss."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CHRF_ORDER, CHRF_BETA, BLEU_ORDER = 6, 2.0, 4
#: Units (characters or tokens) that are counted together.
PORTION = 1 << 21


def _units(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, int]:
    """Numbers of the units of all texts, units in each text, and a bound of the numbers."""
    if pa.types.is_list(texts.type):
        found = pc.dictionary_encode(texts.flatten())
        return found.indices.to_numpy().astype(np.int64), pc.list_value_length(texts).to_numpy().astype(np.int64), len(found.dictionary) + 1
    points = np.frombuffer("".join(texts.to_pylist()).encode("utf-32-le"), np.uint32)
    return points.astype(np.int64), pc.utf8_length(texts).to_numpy().astype(np.int64), 0x110000


def ngram_sums(hyp: pa.Array, ref: pa.Array, order: int) -> list[int]:
    """Of each order n-grams of hyp, of ref, and clipped matches, summed over pairs of texts (strings or lists of tokens).

    An n-gram's number is the rank of its first n - 1 units' number and its last unit; the first
    numbers tell the pairs apart, so an n-gram only meets those of its own pair.
    """
    units, lengths, bound = _units(pa.concat_arrays([hyp, ref]))
    pairs, texts = len(hyp), np.repeat(np.arange(len(lengths)), lengths)
    left = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(units))  # units up to the text's end
    number, sums = texts % pairs, []
    for n in range(1, order + 1):
        begin = np.flatnonzero(left >= n)
        _, ranks = np.unique(number[begin] * bound + units[begin + n - 1], return_inverse=True)
        number[begin] = ranks
        kinds, said = int(ranks.max()) + 1 if len(ranks) else 0, texts[begin] < pairs
        ours, theirs = np.bincount(ranks[said], minlength=kinds), np.bincount(ranks[~said], minlength=kinds)
        sums += [int(ours.sum()), int(theirs.sum()), int(np.minimum(ours, theirs).sum())]
    return sums


def _matches(pairs: DataFrame, units: Callable[[Column], Column], order: int) -> DataFrame:
    """Per order: hyp and ref n-grams and clipped matches over the corpus.

    The counts of a pair are made where the pair is, so no n-gram is shuffled: a task sends three sums
    for each order and portion.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hyp, ref = batch.column(0), batch.column(1)
            size = (lambda x: pc.list_value_length(x)) if pa.types.is_list(hyp.type) else pc.utf8_length
            ends, at = np.cumsum(size(hyp).to_numpy().astype(np.int64) + size(ref).to_numpy()), 0
            while at < batch.num_rows:
                until = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PORTION, "right")))
                yield pa.RecordBatch.from_arrays([pa.array([ngram_sums(hyp.slice(at, until - at), ref.slice(at, until - at), order)], pa.list_(pa.int64()))], ["s"])
                at = until

    said = lambda c: units(F.coalesce(F.col(c), F.lit(""))).alias(c)
    stats = pairs.select(said("hyp"), said("ref")).mapInArrow(run, "s array<long>")
    sums = stats.agg(*[F.sum(F.get("s", F.lit(k))).alias(f"s{k}") for k in range(3 * order)])
    rows = F.array(*[F.struct(F.lit(n + 1).alias("n"), *[F.coalesce(f"s{3 * n + k}", F.lit(0)).alias(name) for k, name in enumerate(("hyp", "ref", "hit"))]) for n in range(order)])
    return sums.select(F.explode(rows).alias("x")).select("x.*")


def visible(text: Column) -> Column:
    """The text without white space."""
    return F.regexp_replace(text, r"(?U)\s+", "")


def chrf(pairs: DataFrame) -> DataFrame:
    """One row, chrf, of rows (id, hyp, ref): character n-grams 1 to 6, beta 2, orders that both sides have."""
    per = _matches(pairs, visible, CHRF_ORDER).where("hyp > 0 AND ref > 0")
    means = per.agg(F.avg(F.col("hit") / F.col("hyp")).alias("p"), F.avg(F.col("hit") / F.col("ref")).alias("r"))
    b = CHRF_BETA**2
    score = 100.0 * (1 + b) * F.col("p") * F.col("r") / F.nullif(b * F.col("p") + F.col("r"), F.lit(0.0))
    return means.select(F.coalesce(score, F.lit(0.0)).alias("chrf"))


def tokens_13a(text: Column) -> Column:
    """Tokens by the mteval-v13a rules."""
    t = F.replace(F.replace(F.replace(text, F.lit("<skipped>"), F.lit("")), F.lit("-\n"), F.lit("")), F.lit("\n"), F.lit(" "))
    for entity, sign in (("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")):
        t = F.replace(t, F.lit(entity), F.lit(sign))
    t = F.concat(F.lit(" "), t, F.lit(" "))
    t = F.regexp_replace(t, r"([\{-\~\[-\` -\&\(-\+\:-\@\/])", " $1 ")
    t = F.regexp_replace(t, r"([^0-9])([\.,])", "$1 $2 ")
    t = F.regexp_replace(t, r"([\.,])([^0-9])", " $1 $2")
    t = F.regexp_replace(t, r"([0-9])(-)", "$1 $2 ")
    return F.filter(F.split(t, r"\s+"), lambda w: w != "")


def bleu(pairs: DataFrame) -> DataFrame:
    """One row, bleu, of rows (id, hyp, ref): 13a tokens, orders 1 to 4, exponential smoothing, brevity penalty."""
    per = _matches(pairs, tokens_13a, BLEU_ORDER)
    one = per.groupBy().agg(F.map_from_entries(F.collect_list(F.struct("n", F.struct("hyp", "ref", "hit")))).alias("m"))
    get = lambda n, what: F.coalesce(F.try_element_at(F.col("m"), F.lit(n))[what], F.lit(0)).cast("double")
    logs, smooth = F.lit(0.0), F.lit(1.0)
    for n in range(1, BLEU_ORDER + 1):
        smooth = F.when(get(n, "hit") == 0, smooth * 2).otherwise(smooth)
        precision = F.when(get(n, "hit") == 0, 1.0 / (smooth * F.nullif(get(n, "hyp"), F.lit(0.0)))).otherwise(get(n, "hit") / F.nullif(get(n, "hyp"), F.lit(0.0)))
        logs = logs + F.ln(precision) / BLEU_ORDER
    brevity = F.when(get(1, "hyp") < get(1, "ref"), F.exp(1 - get(1, "ref") / F.nullif(get(1, "hyp"), F.lit(0.0)))).otherwise(F.lit(1.0))
    return one.select(F.coalesce(100.0 * brevity * F.exp(logs), F.lit(0.0)).alias("bleu"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0))


def smoothed_loss(logits: Column, gold: Column, epsilon: float, pad: int = 0) -> Column:
    """Label-smoothed cross entropy of one position; epsilon is spread over all classes, gold too; 0 at padding."""
    top = F.array_max(logits)
    log_sum = top + F.ln(F.aggregate(logits, F.lit(0.0), lambda s, x: s + F.exp(x - top)))
    mean = F.aggregate(logits, F.lit(0.0), lambda s, x: s + x) / F.size(logits)
    loss = (1 - epsilon) * (log_sum - F.element_at(logits, gold + 1)) + epsilon * (log_sum - mean)
    return F.when(gold == pad, F.lit(0.0)).otherwise(loss)


def mean_loss(rows: DataFrame) -> DataFrame:
    """Token-weighted mean of rows (loss, n_tokens); of nothing 0."""
    return rows.agg((F.sum("loss") / F.greatest(F.sum("n_tokens"), F.lit(1))).alias("loss"), F.sum("n_tokens").alias("n_tokens"))


def position_table(spark, length: int, width: int) -> DataFrame:
    """Sinusoidal position encodings: pos, dim, value."""
    pos, dim = spark.range(length).withColumnRenamed("id", "pos"), F.explode(F.sequence(F.lit(0), F.lit(width - 1))).alias("dim")
    angle = F.col("pos") / F.pow(F.lit(10000.0), (F.col("dim") - F.col("dim") % 2) / width)
    return pos.select("pos", dim).select("pos", "dim", F.when(F.col("dim") % 2 == 0, F.sin(angle)).otherwise(F.cos(angle)).alias("value"))
