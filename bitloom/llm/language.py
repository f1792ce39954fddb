"""Language identification by rank-order profiles of character n-grams.

A profile is the list of the most frequent 1- to 3-grams of letters, with word boundaries, by
falling frequency (ties by code points). A document is compared with each language's profile by the
out-of-place distance: the sum over the document's n-grams of how far their ranks are apart, or of
the profile's length for an n-gram that the language's profile lacks. The nearest language wins,
ties by name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bitloom.llm.common import arrow_map, fold_of, slices

PROFILE = 300
#: Profiles are learned from about so many documents of each language, chosen by a hash of the id.
TRAIN_DOCS = 2000
FOLDS, HELD_OUT = 4, 2
UNDETERMINED = "und"
#: Characters that are sorted at a time.
SLICE = 1 << 20

_letters: np.ndarray | None = None


def _code_table() -> np.ndarray:
    """Code point to code: 1 for what is no letter, else the code point + 2."""
    global _letters
    if _letters is None:
        codes = np.ones(0x110000, np.int32)
        letters = [c for c in range(0x110000) if chr(c).isalpha()]
        codes[letters] = np.array(letters, np.int32) + 2
        _letters = codes
    return _letters


def _grams(codes: np.ndarray, bits: int) -> np.ndarray:
    """Sorted keys of all n-grams of a sequence of codes that begins and ends with a boundary (1)."""
    kind = np.int32 if bits <= 10 else np.int64
    c = codes.astype(kind)
    inner = c != 1
    pairs = (c[:-1] << bits) | c[1:]
    triples = (pairs[:-1] << bits) | c[2:]
    return np.sort(np.concatenate([c[inner], pairs, triples[inner[1:-1]]]))


def _wide(keys: np.ndarray, bits: int) -> np.ndarray:
    """Keys with 21 bits for each code, as they are in profiles."""
    k, mask = keys.astype(np.int64), (1 << bits) - 1
    return (k & mask) | (k >> bits & mask) << 21 | (k >> 2 * bits) << 42


def count_grams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of a text (ascending keys) and their counts; long texts are counted in slices."""
    raw = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    codes = _code_table()[raw]
    codes = np.concatenate([np.ones(1, np.int32), codes, np.ones(1, np.int32)])
    keep = np.ones(len(codes), bool)
    keep[1:] = (codes[1:] != 1) | (codes[:-1] != 1)
    codes = codes[keep]
    if len(codes) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    bits = 10 if codes.max() < 1 << 9 else 21
    if len(codes) > SLICE:
        return _count_long(codes)
    keys = _grams(codes, bits)
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    distinct = keys[at]
    return (_wide(distinct, bits) if bits != 21 else distinct), np.diff(np.append(at, len(keys)))


def _count_long(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slices are cut at word boundaries, which belong to both sides; no n-gram spans one."""
    cuts = np.flatnonzero(codes == 1)
    total: tuple[np.ndarray, np.ndarray] = (np.zeros(0, np.int64), np.zeros(0, np.int64))
    start = 0
    while start < len(codes) - 1:
        end = cuts[np.searchsorted(cuts, min(start + SLICE, len(codes) - 1), "left")]
        total = add_counts([total, _run_lengths(_grams(codes[start : end + 1], 21))])
        start = end
    return total


def _run_lengths(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[at], np.diff(np.append(at, len(keys)))


def add_counts(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, back = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
    total = np.bincount(back, np.concatenate([c for _, c in parts]), len(keys)) if len(keys) else np.zeros(0)
    return keys, total.astype(np.int64)


def top(keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The profile: at most PROFILE keys by falling count, ties by rising key."""
    if len(keys) > PROFILE:
        least = np.partition(counts, len(counts) - PROFILE)[len(counts) - PROFILE]
        kept = counts >= least
        keys, counts = keys[kept], counts[kept]
    return keys[np.argsort(-counts, kind="stable")[:PROFILE]]


class Profiles:
    """Language profiles, arranged to compare a document with all of them at once."""

    def __init__(self, profiles: dict[str, list[int]]) -> None:
        self.langs = sorted(profiles)
        self.keys = np.unique(np.concatenate([np.zeros(0, np.int64), *(np.array(p, np.int64) for p in profiles.values())]))
        self.ranks = np.full((len(self.langs), len(self.keys)), -1, np.int32)
        for i, lang in enumerate(self.langs):
            self.ranks[i, np.searchsorted(self.keys, np.array(profiles[lang], np.int64))] = np.arange(len(profiles[lang]))

    def distances(self, profile: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.keys, profile), len(self.keys) - 1)
        ranks = np.where(self.keys[at] == profile, self.ranks[:, at], -1)
        return np.where(ranks < 0, PROFILE, np.abs(ranks - np.arange(len(profile), dtype=np.int32))).sum(1)

    def predict(self, text: str | None) -> tuple[str, float]:
        """Language and likeness (1: all ranks agree, 0: nothing in common)."""
        profile = top(*count_grams(text))
        if not len(profile) or not self.langs:
            return UNDETERMINED, 0.0
        distances = self.distances(profile)
        best = int(np.argmin(distances))
        return self.langs[best], 1.0 - float(distances[best]) / (PROFILE * len(profile))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b in slices(batch.column("text")):
            part = batch.slice(a, b - a)
            by_lang: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
            for lang, text in zip(part.column("lang").to_pylist(), part.column("text").to_pylist(), strict=True):
                by_lang.setdefault(lang, []).append(count_grams(text))
            for lang, counts in by_lang.items():
                keys, total = add_counts(counts)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys), pa.array(total)], ["lang", "key", "n"])


def train(docs: DataFrame) -> dict[str, list[int]]:
    """Profiles of the languages of documents outside the held-out fold.

    The rate at which documents of a language are taken follows from its count, so the expected
    sample is TRAIN_DOCS documents a language; the driver gets PROFILE n-grams for each.
    """
    known = docs.select("doc_id", "lang", "text").where(F.col("lang").isNotNull() & (fold_of(F.col("doc_id"), FOLDS) != HELD_OUT))
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return {}
    rate = F.element_at(F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, min(1.0, TRAIN_DOCS / n))]), F.col("lang"))
    unit = F.pmod(F.xxhash64(F.lit(7), F.col("doc_id")), F.lit(1 << 20)) / F.lit(float(1 << 20))
    grams = arrow_map(known.where(unit < rate).select("lang", "text"), _count, "lang string, key long, n long")
    total = grams.groupBy("lang", "key").agg(F.sum("n").alias("n"))
    ranked = total.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), F.asc("key"))))
    profiles: dict[str, list[int]] = {lang: [] for lang in counts}
    for row in sorted(ranked.where(F.col("r") <= PROFILE).collect(), key=lambda r: (r["lang"], r["r"])):
        profiles[row["lang"]].append(row["key"])
    return {lang: keys for lang, keys in profiles.items() if keys}


def identify(docs: DataFrame, profiles: dict[str, list[int]]) -> DataFrame:
    """doc_id, lang_pred, score of every whole text; a text that is null or has no letter is undetermined, score 0."""
    sent = docs.sparkSession.sparkContext.broadcast(profiles)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Profiles(sent.value)
        for part in (batch.slice(a, b - a) for batch in batches for a, b in slices(batch.column("text"))):
            found = [known.predict(t) for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())],
                ["doc_id", "lang_pred", "score"],
            )

    return arrow_map(docs.select("doc_id", "text"), run, "doc_id long, lang_pred string, score double")


def query(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score. Null ids are in fold 0. No labelled rows: all undetermined."""
    found = identify(docs, train(docs))
    return found.select("doc_id", (fold_of(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), "lang_pred", "score")
