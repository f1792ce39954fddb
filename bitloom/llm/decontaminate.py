"""Benchmark decontamination: BM25 over an inverted index of test items, searched by block-max WAND.

Every passage of every document is a query: runs of words twice as long as the longest item, half
overlapping, so that each item that a document contains lies whole within one passage. The index
holds the test items (the small side) in shards of bounded size, whose postings are broadcast; word
frequencies, the mean length and the passages' length are those of all items, so scores don't depend
on the shards. A test set of one shard, some ten thousand items, is one pass over the documents.

Impacts are BM25 weights divided by the item's score against itself, so an item that a passage
contains scores 1 and one threshold serves items of any length. All items that reach it are
retrieved: no top-k. Retrieved pairs are verified by the overlap of word trigrams with the item's
question and of words with its answer (its last sentence).
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bitloom.llm.common import arrow_map, slices

K1, B = 1.2, 0.75
#: Share of its own score that an item must reach to be retrieved.
THRESHOLD = 0.6
#: Overlaps that make a retrieved pair a leak.
QUESTION_OVERLAP, ANSWER_OVERLAP = 0.6, 0.6
#: Postings in a block and items in a range; items and characters of test data in one shard of the index.
BLOCK, SHARD_ITEMS, SHARD_CHARS = 4, 16_384, 16 << 20

_SPLIT = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").lower().encode().translate(_SPLIT).split()


def question_and_answer(text: str) -> tuple[list[bytes], list[bytes]]:
    """Words of all sentences but the last, and of the last; one sentence alone is both."""
    sentences = [s for s in re.split(r"(?<=[.!?])\s+|\n+", text or "") if words_of(s)]
    if len(sentences) < 2:
        return words_of(text), words_of(text)
    return words_of(" ".join(sentences[:-1])), words_of(sentences[-1])


def grams(words: list[bytes]) -> set[tuple[bytes, ...]]:
    """Word trigrams; of fewer words the whole."""
    return {tuple(words[i : i + 3]) for i in range(max(1, len(words) - 2))} if words else set()


def overlap(part: set, whole: set) -> float:
    return len(part & whole) / len(part) if part else 1.0


@dataclass
class Statistics:
    """What BM25 needs to know of all items: in how many each word is, their number, their words, the longest."""

    seen: Counter = field(default_factory=Counter)
    items: int = 0
    words: int = 0
    longest: int = 1

    def add(self, text: str) -> None:
        words = words_of(text)
        if words:
            self.seen.update(set(words))
            self.items += 1
            self.words += len(words)
            self.longest = max(self.longest, len(words))

    @classmethod
    def of(cls, rows: list[tuple[int, str]]) -> Statistics:
        self = cls()
        for _, text in rows:
            self.add(text)
        return self


@dataclass
class Index:
    """Postings of a shard, one after the other: per term the items (ascending) and impacts, with the maximum of each block.

    Terms have numbers in the order of ``terms``; ``first`` and ``first_block`` are where each begins.
    ``range_of`` and ``range_top`` are the highest impacts by term and range of BLOCK items.
    """

    items: list[int] = field(default_factory=list)
    texts: list[str] = field(default_factory=list)
    terms: dict[bytes, int] = field(default_factory=dict)
    window: int = 1
    first: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))
    docs: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))
    impacts: np.ndarray = field(default_factory=lambda: np.zeros(0))
    first_block: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))
    block_top: np.ndarray = field(default_factory=lambda: np.zeros(0))
    first_range: np.ndarray = field(default_factory=lambda: np.zeros(1, np.int64))
    range_of: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))
    range_top: np.ndarray = field(default_factory=lambda: np.zeros(0))

    @classmethod
    def of(cls, rows: list[tuple[int, str]], known: Statistics | None = None) -> Index:
        known = known or Statistics.of(rows)
        # by length, so that a range has items whose impacts are of one order
        bags = [(item, text, Counter(words_of(text))) for item, text in sorted(rows, key=lambda r: (len(words_of(r[1])), r))]
        bags = [b for b in bags if b[2]]
        if not bags:
            return cls(window=known.longest)
        mean = known.words / known.items
        idf = {t: math.log(1 + (known.items - known.seen[t] + 0.5) / (known.seen[t] + 0.5)) for _, _, bag in bags for t in bag}
        lists: dict[bytes, list[tuple[int, float]]] = {}
        for i, (_, _, bag) in enumerate(bags):
            norm = K1 * (1 - B + B * bag.total() / mean)
            weight = {t: idf[t] * n * (K1 + 1) / (n + norm) for t, n in bag.items()}
            own = sum(weight.values())
            for t, w in weight.items():
                lists.setdefault(t, []).append((i, w / own))
        terms = sorted(lists)
        lengths = np.array([len(lists[t]) for t in terms], np.int64)
        first = np.concatenate([[0], np.cumsum(lengths)])
        docs = np.array([d for t in terms for d, _ in lists[t]], np.int32)
        impacts = np.array([w for t in terms for _, w in lists[t]])
        blocks = -(-lengths // BLOCK)
        begin = np.repeat(first[:-1], blocks) + BLOCK * (np.arange(blocks.sum()) - np.repeat(np.cumsum(blocks) - blocks, blocks))
        # postings of a term are ascending, so those of one range are neighbours
        term = np.repeat(np.arange(len(terms)), lengths)
        change = np.flatnonzero(np.concatenate([[True], (docs[1:] // BLOCK != docs[:-1] // BLOCK) | (term[1:] != term[:-1])]))
        return cls(
            [item for item, _, _ in bags], [text for _, text, _ in bags], {t: k for k, t in enumerate(terms)}, known.longest, first, docs, impacts,
            np.concatenate([[0], np.cumsum(blocks)]), np.maximum.reduceat(impacts, begin),
            np.concatenate([np.searchsorted(change, first[:-1]), [len(change)]]), docs[change] // BLOCK, np.maximum.reduceat(impacts, change),
        )

    def postings(self, term: int) -> tuple[list[int], list[float], list[float]]:
        """Items, impacts and maxima of blocks of a term."""
        a, b = self.first[term], self.first[term + 1]
        return self.docs[a:b].tolist(), self.impacts[a:b].tolist(), self.block_top[self.first_block[term] : self.first_block[term + 1]].tolist()

    def bound(self, terms: np.ndarray) -> float:
        """The most that any item can score for these terms, by the maxima of ranges."""
        if not len(terms):
            return 0.0
        begin, count = self.first_range[terms], self.first_range[terms + 1] - self.first_range[terms]
        at = np.repeat(begin - np.cumsum(count) + count, count) + np.arange(count.sum())
        return float(np.bincount(self.range_of[at], self.range_top[at]).max())


def block_max_wand(index: Index, query: set[int], threshold: float) -> list[tuple[int, float]]:
    """(item, score) of all items that score at least ``threshold`` for a set of term numbers.

    Cursors are kept in order of their current item. The pivot is the first item that the maxima of
    the lists before it allow; if the maxima of the blocks around the pivot don't, the cursors
    skip to the end of the nearest block. Only items that pass both are scored.
    """
    lists = [index.postings(t) for t in query]
    tops = [max(blocks) for *_, blocks in lists]
    at = [0] * len(lists)
    floor = threshold - 1e-9
    found = []
    live = sorted(range(len(lists)), key=lambda k: lists[k][0][0])

    def skip(k: int, item: int) -> None:
        docs, n = lists[k][0], len(lists[k][0])
        i = at[k]
        while i < n and docs[i] < item:  # block by block, then one by one
            end = (i // BLOCK + 1) * BLOCK
            i = end if end <= n and docs[end - 1] < item else i + 1
        at[k] = i

    while live:
        bound, pivot = 0.0, None
        for place, k in enumerate(live):
            bound += tops[k]
            if bound >= floor:
                pivot = lists[k][0][at[k]]
                break
        if pivot is None:
            break
        last = place
        while last + 1 < len(live) and lists[live[last + 1]][0][at[live[last + 1]]] == pivot:
            last += 1
        # maxima of the blocks in which the pivot would lie
        block_bound, until = 0.0, None
        for k in live[: last + 1]:
            docs, _, blocks = lists[k]
            b = at[k] // BLOCK
            while b < len(blocks) - 1 and docs[min((b + 1) * BLOCK, len(docs)) - 1] < pivot:
                b += 1
            end = docs[min((b + 1) * BLOCK, len(docs)) - 1]
            if end >= pivot:
                block_bound += blocks[b]
                until = end if until is None else min(until, end)
        if block_bound >= floor:
            score = 0.0
            for k in live[: last + 1]:
                skip(k, pivot)
                docs, impacts, _ = lists[k]
                if at[k] < len(docs) and docs[at[k]] == pivot:
                    score += impacts[at[k]]
                    at[k] += 1
            if score >= floor:
                found.append((pivot, score))
        else:
            target = pivot + 1 if until is None else until + 1
            if last + 1 < len(live):
                target = max(pivot + 1, min(target, lists[live[last + 1]][0][at[live[last + 1]]]))
            for k in live[: last + 1]:
                skip(k, target)
        live = sorted((k for k in live if at[k] < len(lists[k][0])), key=lambda k: lists[k][0][at[k]])
    return found


MATCHES = "doc_id long, item_id long, bm25 double, question_overlap double, answer_overlap double, n_passages long, leaked boolean"


def leaks(question: float, answer: float) -> bool:
    return question >= QUESTION_OVERLAP and answer >= ANSWER_OVERLAP


def search(texts: list[str | None], index: Index) -> list[list[tuple[int, float, float, float, int]]]:
    """Per text: (item number, best score, overlaps, passages) of all items that any of its passages retrieves.

    The best passage is one that leaks, if there is one, then the one with the largest overlaps.
    First the sums of the maxima of ranges of items tell which passages can reach the threshold for
    any item; only these are searched.
    """
    get, sides, out = index.terms.get, {}, []
    for words in map(words_of, texts):
        best: dict[int, list] = {}
        ids = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
        for a in range(0, max(1, len(words) - index.window), index.window):
            b = a + 2 * index.window
            query = np.unique(ids[a:b])
            query = query[query >= 0]
            if index.bound(query) < THRESHOLD - 1e-9:
                continue
            hits = block_max_wand(index, set(query.tolist()), THRESHOLD)
            if not hits:
                continue
            passage, bag = grams(words[a:b]), set(words[a:b])
            for item, score in hits:
                if item not in sides:
                    question, answer = question_and_answer(index.texts[item])
                    sides[item] = grams(question), set(answer)
                q, r = overlap(sides[item][0], passage), overlap(sides[item][1], bag)
                was = best.get(item)
                if was is None:
                    best[item] = [score, q, r, 1]
                else:
                    was[3] += 1
                    if (leaks(q, r), q + r, score) > (leaks(was[1], was[2]), was[1] + was[2], was[0]):
                        was[:3] = score, q, r
        out.append([(item, *found) for item, found in sorted(best.items())])
    return out


def indexes(benchmark: DataFrame) -> Iterator[Index]:
    """The index in shards of at most SHARD_ITEMS items and about SHARD_CHARS characters; items without an id or words are left out.

    The test set is streamed to the driver partition by partition, twice: for the statistics of all
    items, and for the shards. It is the small side by its nature, and every broadcast is bounded by
    the shard.
    """
    items = benchmark.where(F.col("item_id").isNotNull()).select("item_id", F.coalesce("text", F.lit("")).alias("text"))
    known = Statistics()
    for row in items.select("text").toLocalIterator():
        known.add(row["text"])
    shard: list[tuple[int, str]] = []
    size = 0
    for row in items.orderBy("item_id", "text").toLocalIterator():
        if not words_of(row["text"]):
            continue
        if len(shard) >= SHARD_ITEMS or size > SHARD_CHARS:
            yield Index.of(shard, known)
            shard, size = [], 0
        shard.append((row["item_id"], row["text"]))
        size += len(row["text"])
    if shard:
        yield Index.of(shard, known)


def matches(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """All retrieved pairs: doc_id, item_id, bm25, question_overlap, answer_overlap, n_passages, leaked.

    ``leaked``: both overlaps reach their least. Null texts are empty; texts and items without words
    match nothing; a document that has an item several times has one row for it; repeated documents
    have rows each. No items: no rows.
    """
    spark = docs.sparkSession
    found = None
    kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64(), pa.int64(), pa.bool_())
    for shard in indexes(benchmark):
        sent = spark.sparkContext.broadcast(vars(shard))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            index = Index(**sent.value)
            for batch in batches:
                for a, b in slices(batch.column("text")):
                    part = batch.slice(a, b - a)
                    hits = search(part.column("text").to_pylist(), index)
                    out = [(doc, index.items[i], s, q, r, n, leaks(q, r))
                           for doc, of in zip(part.column("doc_id").to_pylist(), hits, strict=True) for i, s, q, r, n in of]
                    if out:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], [f.split()[0] for f in MATCHES.split(", ")])

        one = arrow_map(docs.select("doc_id", "text"), run, MATCHES)
        found = one if found is None else found.unionByName(one)
    return found if found is not None else spark.createDataFrame([], MATCHES)


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs``, with all their columns, that have no leaked item; each row is judged by its own text.

    The verdict is made where the row is: nothing is shuffled. Null texts and texts without words stay.
    """
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    for shard in indexes(benchmark):
        sent = docs.sparkSession.sparkContext.broadcast(vars(shard))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            index = Index(**sent.value)
            for batch in batches:
                for a, b in slices(batch.column("text")):
                    part = batch.slice(a, b - a)
                    clean = [not any(leaks(q, r) for _, _, q, r, _ in of) for of in search(part.column("text").to_pylist(), index)]
                    yield part.filter(pa.array(clean, pa.bool_()))

        docs = arrow_map(docs, run, schema)
    return docs


def query(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The retrieved pairs of all documents and test items (see ``matches``)."""
    return matches(docs, benchmark)
