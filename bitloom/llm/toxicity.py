"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features of a text are the distinct hashes of its words, of neighbouring words and of words two
apart. The model is fitted on the driver from a bounded sample of labelled documents, in one fixed
order; per-coordinate learning rates and the L1 term leave few weights, which are broadcast. The
bound of what is broadcast is that of the hash space (2^BITS weights), whatever the corpus.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bitloom.llm.common import arrow_map, fold_of, slices

#: The classifier is fitted on at most so many labelled documents, and so many characters of text.
MAX_TRAIN_ROWS, MAX_TRAIN_CHARS = 8000, 64 << 20
BITS = 20
#: What a whole text of any length counts for at most: its distinct features are 2^BITS and no more.
MAX_TEXT_CHARS = 2 << BITS
HELD_OUT_FOLDS = 5
EPOCHS = 10
ALPHA, BETA, L1, L2 = 1.0, 1.0, 12.0, 0.5
#: Weight of a toxic example against one that isn't.
POSITIVE_WEIGHT = 4.0

_PUNCTUATION = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


class WordHashes(dict):
    """Word to 62-bit hash; forgets all it knows when it has grown large, so that it stays bounded."""

    LIMIT = 200_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word) >> 2
        return value


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased words; ASCII characters other than letters and digits separate them."""
    return (text or "").lower().encode().translate(_PUNCTUATION).split()


def hashed(ids: np.ndarray) -> list[np.ndarray]:
    """Feature numbers of consecutive words: of each word, each pair of neighbours, each pair two apart."""
    shift = np.uint64(64 - BITS)
    first = ids * _MIX[0]
    return [first >> shift, (first[:-1] ^ ids[1:] * _MIX[1]) * _MIX[2] >> shift, (first[:-2] ^ ids[2:] * _MIX[2]) * _MIX[1] >> shift]


def features(text: str | None, hashes: WordHashes) -> np.ndarray:
    words = words_of(text)
    ids = np.fromiter(map(hashes.__getitem__, words), np.int64, len(words)).view(np.uint64)
    return np.unique(np.concatenate(hashed(ids))).astype(np.int32)


@dataclass
class Model:
    """Nonzero weights by feature number, and the bias."""

    at: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))
    weight: np.ndarray = field(default_factory=lambda: np.zeros(0, np.float32))
    bias: float = -1.1

    def dense(self) -> np.ndarray:
        table = np.zeros(1 << BITS, np.float32)
        table[self.at] = self.weight
        return table


def sigmoid(x: np.ndarray | float) -> np.ndarray | float:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35, 35)))


def fit(examples: list[tuple[np.ndarray, int]]) -> Model:
    """FTRL-proximal over the examples as they are ordered, EPOCHS times. No examples: the prior alone."""
    positives = sum(y for _, y in examples)
    prior = float(np.log((positives + 0.5) / (len(examples) - positives + 1.5)))
    z, n = np.zeros(1 << BITS), np.zeros(1 << BITS)
    bias_z = bias_n = 0.0

    def weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
        return np.where(np.abs(z) <= L1, 0.0, (np.sign(z) * L1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    for _ in range(EPOCHS):
        for at, y in examples:
            w = weights(z[at], n[at])
            bias = -bias_z / ((BETA + np.sqrt(bias_n)) / ALPHA)
            g = (sigmoid(prior + bias + w.sum()) - y) * (POSITIVE_WEIGHT if y else 1.0)
            step = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA
            z[at] += g - step * w
            n[at] += g * g
            bias_z += g - (np.sqrt(bias_n + g * g) - np.sqrt(bias_n)) / ALPHA * bias
            bias_n += g * g
    w = weights(z, n)
    kept = np.flatnonzero(w)
    return Model(kept.astype(np.int32), w[kept].astype(np.float32), prior - bias_z / ((BETA + np.sqrt(bias_n)) / ALPHA))


def _featurize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes = WordHashes()
    for batch in batches:
        for a, b in slices(batch.column("text")):
            part = batch.slice(a, b - a)
            rows = [features(t, hashes) for t in part.column("text").to_pylist()]
            ends = np.cumsum([0, *map(len, rows)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(rows)))
            names = ["_order", "_same", "_y"]
            yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), lists], [*names, "at"])


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit on the labelled documents outside the held-out fold: a sample by hash of the id, of bounded size.

    The sample's ids are chosen from the labels alone, so only its texts are read and sent. A
    document with several labels counts as toxic if one says so; rows without a label are left out.
    """
    order = F.xxhash64(F.lit(11), F.col("doc_id"))
    chosen = (
        labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (fold_of(F.col("doc_id"), HELD_OUT_FOLDS) != 0))
        .groupBy("doc_id")
        .agg(F.max("toxic").cast("int").alias("_y"))
        .withColumn("_order", order)
        .orderBy("_order", "doc_id")
        .limit(MAX_TRAIN_ROWS)
    )
    # at most MAX_TRAIN_ROWS rows of three numbers
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("_order", F.xxhash64("text").alias("_same"), "_y", "text")
    size = F.sum(F.least(F.length(F.coalesce("text", F.lit(""))), F.lit(MAX_TEXT_CHARS))).over(
        Window.partitionBy(F.lit(0)).orderBy("_order", "_same").rowsBetween(Window.unboundedPreceding, 0)
    )
    bounded = sample.withColumn("_size", size).where(F.col("_size") <= MAX_TRAIN_CHARS).limit(MAX_TRAIN_ROWS)
    rows = arrow_map(bounded.select("_order", "_same", "_y", "text"), _featurize, "_order long, _same long, _y int, at array<int>").toArrow().combine_chunks()
    if not len(rows):
        return fit([])
    # the features stay in Arrow's buffer: as Python numbers they would take ten times the memory
    order, same, labels_, lists = (rows.column(n).chunk(0) for n in ("_order", "_same", "_y", "at"))
    ends, values, y = lists.offsets.to_numpy(), lists.values.to_numpy(), labels_.to_numpy()
    arranged = np.lexsort((same.to_numpy(), order.to_numpy()))
    return fit([(values[ends[i] : ends[i + 1]], int(y[i])) for i in arranged.tolist()])


def score_texts(texts: list[str | None], table: np.ndarray, bias: float, hashes: WordHashes) -> np.ndarray:
    """Scores of whole texts: each feature counts once in a text, however often it occurs."""
    parts = [words_of(t) for t in texts]
    lengths = np.array([len(p) for p in parts])
    ids = np.fromiter((h for p in parts for h in map(hashes.__getitem__, p)), np.int64, int(lengths.sum())).view(np.uint64)
    owner = np.repeat(np.arange(len(parts)), lengths)
    hits = []
    for apart, at in enumerate(hashed(ids)):
        found = np.flatnonzero(table[at])
        if apart:
            found = found[owner[found] == owner[found + apart]]
        hits.append(np.column_stack([owner[found], at[found].astype(np.int64)]))
    distinct = np.unique(np.concatenate(hits), axis=0)
    return sigmoid(bias + np.bincount(distinct[:, 0], table[distinct[:, 1]], len(parts)))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of ``docs`` and _score of every whole text; a null or empty text has the prior's score.

    A column _score that is there already is replaced.
    """
    docs = docs.drop("_score")
    sent = docs.sparkSession.sparkContext.broadcast((model.at, model.weight, model.bias))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, hashes = Model(*sent.value), WordHashes()
        table, bias = known.dense(), known.bias
        for batch in batches:
            for a, b in slices(batch.column("text")):
                part = batch.slice(a, b - a)
                scores = score_texts(part.column("text").to_pylist(), table, bias, hashes)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(scores, pa.float64())], [*part.schema.names, "_score"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return arrow_map(docs, run, f"{schema}, _score double")


def query(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document.

    Null ids are in fold 0. Labels outside the held-out fold fit the model; language, source and id
    are no features. Without labels all texts have the prior's score, below one half.
    """
    small = docs.select("doc_id", "text")
    return score(small, train(small, labels)).select(
        "doc_id",
        (fold_of(F.col("doc_id"), HELD_OUT_FOLDS) == 0).alias("held_out"),
        F.col("_score").alias("score"),
        (F.col("_score") >= 0.5).cast("int").alias("predicted"),
    )
