"""Document fingerprints: a quartile bucket digest of hashed byte triplets.

Over every window of five bytes, triplets of its bytes are hashed to 128 buckets and counted. Each
bucket is written as its quartile among the 128 counts (two bits); two bytes before them hold the
length on a logarithmic scale and the ratios of the quartiles. The difference of two digests adds
the steps between quartiles (a whole range counts double), lengths and ratios, and is bounded.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bitloom.llm.common import arrow_map

BUCKETS = 128
#: Offsets of the triplets within a window; all contain its first byte.
TRIPLETS = ((0, 1, 2), (0, 2, 3), (0, 1, 4))
#: A difference of so much, or more, is no likeness at all. Unrelated digests differ by about as much.
BOUND = 200
#: Bytes that are counted at a time.
SLICE = 1 << 20

_MULTIPLIERS = np.array([2654435761, 2246822519, 3266489917], np.uint64).astype(np.uint32)


def bucket_counts(texts: list[bytes]) -> np.ndarray:
    """Counts of hashed triplets, one row of BUCKETS for each text; long texts are counted in slices."""
    counts = np.zeros((len(texts), BUCKETS), np.int64)
    size, parts, rows = 0, [], []

    def count() -> None:
        data = np.frombuffer(b"".join(parts), np.uint8).astype(np.uint32)
        lengths = np.array([len(p) for p in parts])
        owner = np.repeat(np.arange(len(parts), dtype=np.int64) * BUCKETS, lengths)
        tail = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(data))  # bytes from here to the part's end
        total = np.zeros(len(parts) * BUCKETS, np.int64)
        for n, (i, j, k) in enumerate(TRIPLETS):
            if len(data) <= k:
                continue
            m = len(data) - k
            h = data[i : i + m] * _MULTIPLIERS[0] + data[j : j + m] * _MULTIPLIERS[1] + data[k : k + m] * _MULTIPLIERS[2]
            h ^= h >> np.uint32(15)
            h = (h * np.uint32(2246822519 + 2 * n)) >> np.uint32(25)
            whole = tail[:m] > k
            total += np.bincount(owner[:m][whole] + h[whole], minlength=len(total))
        np.add.at(counts, np.array(rows), total.reshape(-1, BUCKETS))

    for row, text in enumerate(texts):
        if len(text) > SLICE:
            counts[row] = _counts_of_long(text)
            continue
        parts.append(text)
        rows.append(row)
        size += len(text)
        if size > SLICE:
            count()
            size, parts, rows = 0, [], []
    if parts:
        count()
    return counts


def _counts_of_long(text: bytes) -> np.ndarray:
    """The counts of one text that is longer than a slice; slices overlap by what a triplet form reaches."""
    total = np.zeros(BUCKETS, np.int64)
    for n, (i, j, k) in enumerate(TRIPLETS):
        for a in range(0, len(text) - k, SLICE):
            data = np.frombuffer(text[a : a + SLICE + k], np.uint8).astype(np.uint32)
            m = len(data) - k
            h = data[i : i + m] * _MULTIPLIERS[0] + data[j : j + m] * _MULTIPLIERS[1] + data[k : k + m] * _MULTIPLIERS[2]
            h ^= h >> np.uint32(15)
            total += np.bincount((h * np.uint32(2246822519 + 2 * n)) >> np.uint32(25), minlength=BUCKETS)
    return total


def digests(texts: list[bytes]) -> np.ndarray:
    """One row of 2 + BUCKETS small numbers for each text: length code, ratio code, quartiles of buckets."""
    counts = bucket_counts(texts)
    ordered = np.sort(counts, axis=1)
    q1, q2, q3 = (ordered[:, BUCKETS * k // 4 - 1][:, None] for k in (1, 2, 3))
    quartile = (counts > q1).astype(np.uint8) + (counts > q2) + (counts > q3)
    length = np.array([len(t) for t in texts], np.float64)
    code = np.minimum(255, np.floor(np.log1p(length) / np.log(1.2)))
    top = np.maximum(1, q3[:, 0])
    ratio = (q1[:, 0] * 15 // top) * 16 + q2[:, 0] * 15 // top
    return np.column_stack([code.astype(np.uint8), ratio.astype(np.uint8), quartile.astype(np.uint8)])


def as_hex(digest: np.ndarray) -> list[str]:
    two_bits = digest[:, 2:].reshape(len(digest), -1, 4)
    packed = (two_bits << np.array([6, 4, 2, 0], np.uint8)).sum(2, dtype=np.uint8)
    return [bytes(row).hex() for row in np.column_stack([digest[:, :2], packed])]


def from_hex(text: str) -> np.ndarray:
    raw = np.frombuffer(bytes.fromhex(text), np.uint8)
    return np.concatenate([raw[:2], (raw[2:, None] >> np.array([6, 4, 2, 0], np.uint8) & 3).reshape(-1)])


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """1 for equal digests, 0 where the difference reaches BOUND; row by row."""
    x, y = a.astype(np.int32), b.astype(np.int32)
    length = np.abs(x[:, 0] - y[:, 0])
    length = np.where(length <= 1, length, 4 * (length - 1))
    ratios = np.abs((x[:, 1] >> 4) - (y[:, 1] >> 4)) + np.abs((x[:, 1] & 15) - (y[:, 1] & 15))
    step = np.abs(x[:, 2:] - y[:, 2:])
    total = (step + 3 * (step == 3)).sum(1) + length + ratios
    return np.maximum(0.0, 1.0 - total / BOUND)


NEIGHBOURS = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_FIRST = -(1 << 63)


def bucket_of(key: Column, cuts: list[int]) -> Column:
    """How many of the ascending cuts are at most the key; found in two steps of about the root of their number."""
    if not cuts:
        return F.lit(0)
    step = max(1, int(len(cuts) ** 0.5))
    groups = [cuts[k : k + step] for k in range(0, len(cuts), step)]
    numbers = lambda xs: F.array(*map(F.lit, xs)).cast("array<bigint>")
    below = lambda xs: F.size(F.filter(xs, lambda x: x <= key))
    full = F.greatest(below(numbers([g[0] for g in groups])) - 1, F.lit(0))  # the last group that begins at or before the key
    return full * step + below(F.get(F.array(*map(numbers, groups)), full))


def with_successors(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, text, _bucket, _copy) such that, sorted by _bucket, _copy, id and text within a partition,
    each row of a bucket is followed by its successor in the order of ids; the last by a copy (_copy = 1)
    of the next bucket's first, or of the very first row.

    Ids are cut into ranges at approximate quantiles. What the driver gets are a few numbers for
    each range; the texts are shuffled once.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("doc_id", F.lit(_FIRST)).alias("_key"))
    parts = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = sorted(set(docs.approxQuantile("doc_id", [k / parts for k in range(1, parts)], 0.25 / parts)))
    bucket = bucket_of(F.col("_key"), [int(x) for x in cuts])
    heads = sorted((r["_bucket"], r["_key"]) for r in rows.select(bucket.alias("_bucket"), "_key").groupBy("_bucket").agg(F.min("_key").alias("_key")).collect())
    if not heads:
        return rows.select("doc_id", "text", F.lit(0).alias("_bucket"), F.lit(0).alias("_copy"))
    before = {key: heads[i - 1][0] for i, (_, key) in enumerate(heads)}  # the first key's is the last bucket
    ids = [key for _, key in heads if key != _FIRST]
    is_head = F.col("doc_id").isin(ids)
    if _FIRST in before:
        is_head = is_head | F.col("doc_id").isNull() | (F.col("doc_id") == _FIRST)
    to = F.create_map(*[F.lit(x) for pair in before.items() for x in pair])
    copies = (
        rows.where(is_head).groupBy("_key").agg(F.min("text").alias("text"))
        .select(F.lit(None).cast("long").alias("doc_id"), "text", F.element_at(to, F.col("_key")).cast("int").alias("_bucket"), F.lit(1).alias("_copy"))
    )
    return rows.select("doc_id", "text", bucket.alias("_bucket"), F.lit(0).alias("_copy")).unionByName(copies)


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Compare each row with its successor and with its edited text."""
    prev: tuple[int | None, str, np.ndarray] | None = None
    for batch in batches:
        for a, b in _row_slices(batch):
            part = batch.slice(a, b - a)
            ids, copies = part.column("doc_id").to_pylist(), part.column("_copy").to_pylist()
            texts = part.column("text").to_pylist()
            own = digests([t.encode() for t in texts])
            out = []  # id, text, digest, index of the successor
            for i, (doc, copy, text) in enumerate(zip(ids, copies, texts, strict=True)):
                if prev is not None:
                    out.append((*prev, i))
                prev = None if copy else (doc, text, own[i])
            if out:
                new = [t[: len(t) - len(t) // 4] + texts[i][: len(t) // 4] for _, t, _, i in out]
                raw = [t.encode() for t in new]
                edited, mine, following = digests(raw), np.stack([d for _, _, d, _ in out]), own[[i for *_, i in out]]
                columns = [
                    pa.array([d for d, *_ in out], pa.int64()), pa.array([len(t) for _, t, _, _ in out], pa.int64()),
                    pa.array([hashlib.sha256(t).hexdigest() for t in raw]), pa.array(as_hex(mine)), pa.array(as_hex(edited)),
                    pa.array(likeness(mine, edited)), pa.array(likeness(mine, following)),
                ]
                yield pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in NEIGHBOURS.split(", ")])


def _row_slices(batch: pa.RecordBatch) -> Iterator[tuple[int, int]]:
    from bitloom.llm.common import slices

    yield from slices(batch.column("text"))


def query(docs: DataFrame) -> DataFrame:
    """Digest of every text and of its edited form, and likeness to that and to the next document.

    Null text is empty; null ids come first; rows of one id are ordered by text, and repeated rows
    follow each other. An empty table gives an empty result.
    """
    rows = with_successors(docs).repartition("_bucket").sortWithinPartitions("_bucket", "_copy", "doc_id", "text")
    return arrow_map(rows, _edited, NEIGHBOURS)


FINGERPRINTS = "doc_id long, n_bytes long, fingerprint string"


def _fingerprint(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b in _row_slices(batch):
            part = batch.slice(a, b - a)
            raw = [(t or "").encode() for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array([len(t) for t in raw], pa.int64()), pa.array(as_hex(digests(raw)))],
                ["doc_id", "n_bytes", "fingerprint"],
            )


def fingerprint(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and fingerprint of every row; null text is empty; equal texts have equal fingerprints."""
    return arrow_map(docs.select("doc_id", "text"), _fingerprint, FINGERPRINTS)
