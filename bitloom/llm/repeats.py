"""Suffix-array deduplication: every byte that lies in a 400-byte string which also starts elsewhere.

1. Windows are dealt out by content. Each 400-byte window belongs to its rightmost minimal hash of a
   64-byte string in it (its anchor). The choice depends on the window's bytes alone, so equal
   windows have equal anchors. An anchor owns a run of window starts, whose bytes are its context.
   What a document has several times is covered at once and counted, in one row.
2. Anchors that occur once are done with. Contexts that occur twice are covered as a whole. What is
   left are anchors with several different contexts; each different context is fetched once, however
   many documents have it.
3. For these an enhanced suffix array is built (rank doubling, longest common prefixes from the
   ranks). A stack scan walks the tree of common-prefix intervals; an interval of at least 400 bytes
   whose occurrences differ in the byte to their left is a maximal repeat, with all its occurrences.
   A class of equal windows with one and the same byte to their left is part of a longer repeat one
   byte earlier and needs no scan.
4. An anchor with more different contexts than one task should sort (GROUP_MAX) is divided first: a
   window's distance to its anchor depends on its bytes too, so windows are parted by ranges of that
   distance and by the bytes that all windows of a range share. Then steps 2 and 3 begin again, with
   narrower ranges each time. Windows of one distance share all their bytes, so the last division
   leaves groups of equal contexts and nothing to sort.

Anchors and contexts are compared by 64-bit hashes, in the suffix array symbol by symbol. Spans found
this way are merged in each document and cut out.

The same search finds repeats of 51 words (WORDS): there a symbol is a word's 32-bit hash.
"""

from __future__ import annotations

import hashlib
import re
import string
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bitloom.llm.common import arrow_map, cut, slices

#: Different contexts of an anchor that are sorted together in one task; more are divided.
GROUP_MAX = 8192
#: Ranges of distances that a crowded anchor is divided into at a time.
PARTS_OF = 8
#: Symbols hashed at a time, and bytes sorted together.
SLICE, CHUNK = 1 << 17, 1 << 19

OWN = ("_id", "_version", "_spans", "_word_spans", "_wanted", "_from")
_PLACE = 20  # bits of an anchor's key that hold its place in a slice
_BASE = 0x9E3779B97F4A7C15
_PUNCTUATION = string.punctuation.encode()
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


class _Codes(dict):
    """32 bits of the hash of each word that was met, without the ASCII punctuation at its ends."""

    MOST = 1 << 18

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.MOST:
            self.clear()
        code = self[word] = xxhash.xxh3_64_intdigest(word.strip(_PUNCTUATION) or word) & 0xFFFFFFFF
        return code


_CODES = _Codes()


def text_bytes(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode(), np.uint8)


def word_codes(text: str | None) -> np.ndarray:
    """A code for each word; what separates words and the punctuation around them is left out."""
    return np.array([_CODES[w] for w in (text or "").encode().split()], np.uint32)


@dataclass(frozen=True)
class Unit:
    """What texts are cut into: symbols, their type, the least repeat, the length of an anchor's string."""

    encode: Callable[[str | None], np.ndarray]
    dtype: type
    least: int
    gram: int
    #: Symbols in the suffix array's first key, and their bits with one more for the end.
    packed: int
    bits: int

    @property
    def size(self) -> int:
        return np.dtype(self.dtype).itemsize

    @property
    def distances(self) -> int:
        """How far an anchor may be from the start of its window, and one."""
        return self.least - self.gram + 1

    @property
    def levels(self) -> list[int]:
        """Symbols by which the suffix array's ranks are made; their sum is no less than a context."""
        out = [self.packed]
        while 2 * out[-1] <= self.least + self.distances:
            out.append(2 * out[-1])
        return out


BYTES = Unit(text_bytes, np.uint8, 400, 64, 7, 9)
WORDS = Unit(word_codes, np.uint32, 51, 8, 1, 33)


def word_spans(raw: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """Merged spans of words as spans of a text's bytes, without the punctuation at their ends, and their numbers of words."""
    if not spans:
        return []
    words, out = [m.span() for m in _WORD.finditer(raw)], []
    for lo, hi in spans:
        (a, first_end), (last, b) = words[lo], words[hi - 1]
        first_word, last_word = raw[a:first_end], raw[last:b]
        if first_word.strip(_PUNCTUATION):
            a += len(first_word) - len(first_word.lstrip(_PUNCTUATION))
        if last_word.strip(_PUNCTUATION):
            b -= len(last_word) - len(last_word.rstrip(_PUNCTUATION))
        out.append((a, b, hi - lo))
    return out


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """A 64-bit hash of the ``gram`` (a power of two) symbols from each place, by doubling."""
    h, n = (data.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93), 1
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    while n < gram:
        h = h[:-n] * np.uint64(pow(_BASE, n, 1 << 64)) + h[n:]
        n *= 2
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xC2B2AE3D27D4EB4F)
    return h ^ h >> np.uint64(29)


def anchors(data: np.ndarray, starts: np.ndarray, unit: Unit = BYTES) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one anchor in concatenated texts (``starts``: their offsets and the end).

    Gives hash, text number, first and last window start (in ``data``) of each run. No window
    crosses texts. ``data`` has less than 2^20 symbols.
    """
    none, length = np.zeros(0, np.int64), unit.least
    if len(data) < length:
        return none.view(np.uint64), none, none, none
    h = gram_hashes(data, unit.gram)
    low = np.uint64((1 << _PLACE) - 1)
    key = (h & ~low) | (low - np.arange(len(h), dtype=np.uint64))
    n = 1
    while 2 * n <= unit.distances:
        key = np.minimum(key[:-n], key[n:])
        n *= 2
    if n < unit.distances:
        key = np.minimum(key[: len(data) - length + 1], key[unit.distances - n :])
    place = (low - (key & low)).astype(np.int64)
    change = np.zeros(len(place), bool)
    change[0] = True
    change[1:] = place[1:] != place[:-1]
    inner = starts[1:-1]
    change[inner[inner < len(place)]] = True
    tails = np.maximum(starts[1:] - length + 1, starts[:-1])
    change[tails[tails < len(place)]] = True
    first = np.flatnonzero(change)
    last = np.append(first[1:], len(place)) - 1
    text = np.searchsorted(starts, first, "right") - 1
    whole = first + length <= starts[text + 1]
    first, last, text = first[whole], last[whole], text[whole]
    return h[place[first]], text, first, last


#: anchor and context: hashes; lo, len: the context's place; n: how often it is there. Without them: a covered span.
OCCURRENCES = "anchor long, context long, id long, version int, lo int, len int, n long"


def _names(schema: str) -> list[str]:
    return [f.split()[0] for f in schema.split(", ")]


def _batch(columns: list, schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string()}
    arrays = [pa.array(c, kinds[f.split()[1]]) for c, f in zip(columns, schema.split(", "), strict=True)]
    return pa.RecordBatch.from_arrays(arrays, _names(schema))


def _find_anchors(unit: Unit):
    def rows(parts: list[tuple[int, int, np.ndarray, int]]) -> Iterator[pa.RecordBatch]:
        """parts: id, version, symbols, place of these symbols in the text."""
        data = np.concatenate([p for _, _, p, _ in parts])
        raw, size, length = data.tobytes(), unit.size, unit.least
        starts = np.cumsum([0, *(len(p) for _, _, p, _ in parts)])
        h, text, first, last = anchors(data, starts, unit)
        if not len(h):
            return
        digest = xxhash.xxh3_64_intdigest
        context = np.array([digest(raw[a * size : (b + length) * size]) for a, b in zip(first.tolist(), last.tolist(), strict=True)], np.uint64)
        number: dict[tuple, int] = {}
        doc = np.array([number.setdefault(p[:2], len(number)) for p in parts])[text]
        of = lambda k: np.array([p[k] for p in parts], np.int64)[text]
        lo, n = first - starts[text] + of(3), last - first + length
        order = np.lexsort((lo, h, context, doc))
        same = (doc[order][1:] == doc[order][:-1]) & (context[order][1:] == context[order][:-1]) & (h[order][1:] == h[order][:-1])
        begin = np.flatnonzero(np.concatenate([[True], ~same]))
        count = np.diff(np.append(begin, len(order)))
        one = order[begin]
        columns = [h.view(np.int64)[one], context.view(np.int64)[one], of(0)[one], of(1)[one].astype(np.int32), lo[one].astype(np.int32), n[one].astype(np.int32), count]
        yield _batch(columns, OCCURRENCES)
        if len(one) < len(order):
            again = np.sort(order[np.repeat(count > 1, count)])  # in the order of places
            a, b, d = lo[again], lo[again] + n[again], doc[again]
            # windows of one document follow each other, so spans that touch are one
            fresh = np.concatenate([[True], (d[1:] != d[:-1]) | (a[1:] > b[:-1]) | (a[1:] < a[:-1])])
            where = np.flatnonzero(fresh)
            until = np.append(where[1:], len(again)) - 1
            nothing = [None] * len(where)
            spans = [nothing, nothing, of(0)[again][where], of(1)[again][where].astype(np.int32), a[where].astype(np.int32), (b[until] - a[where]).astype(np.int32), nothing]
            yield _batch(spans, OCCURRENCES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        length = unit.least
        for batch in batches:
            parts, size = [], 0
            for doc, version, text in zip(*(batch.column(n) for n in ("_id", "_version", "text")), strict=True):
                data = unit.encode(text.as_py())
                for at in range(0, max(1, len(data) - length + 1), SLICE - length + 1):
                    piece = data[at : at + SLICE]
                    if len(piece) < length:
                        continue
                    parts.append((doc.as_py(), version.as_py(), piece, at))
                    size += len(piece)
                    if size >= SLICE:
                        yield from rows(parts)
                        parts, size = [], 0
            if parts:
                yield from rows(parts)

    return run


# --- the enhanced suffix array -------------------------------------------------------------------


def suffix_ranks(strings: list[np.ndarray], unit: Unit) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Symbols of the strings, each followed by ends (0); the strings' starts; ranks by the symbols of each level."""
    ends, bits = unit.packed, unit.bits
    lengths = np.array([len(s) for s in strings])
    starts = np.cumsum([0, *(lengths[:-1] + ends)])
    symbols = np.zeros(int(lengths.sum()) + ends * len(strings), np.int64)
    flat = np.concatenate(strings)
    symbols[np.arange(len(flat)) + np.repeat(np.arange(len(strings)) * ends, lengths)] = flat.astype(np.int64) + 1
    key = np.zeros(len(symbols), np.int64)
    for k in range(unit.packed):
        key[: len(symbols) - k] |= symbols[k:] << bits * (unit.packed - 1 - k)
    ranks = []
    for n in unit.levels:
        if ranks:
            key = ranks[-1].astype(np.int64) << 32
            key[: len(symbols) - n // 2] |= ranks[-1][n // 2 :] + 1
        order = np.argsort(key)
        arranged = key[order]
        rank = np.empty(len(key), np.int32)
        rank[order] = np.cumsum(np.concatenate([[False], arranged[1:] != arranged[:-1]]))
        ranks.append(rank)
    return symbols, starts, ranks


def common_prefixes(symbols: np.ndarray, ranks: list[np.ndarray], unit: Unit, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Lengths of the common prefixes of suffixes a[i] and b[i], as far as strings go."""
    n = len(symbols)
    length = np.zeros(len(a), np.int64)
    for rank, step in zip(reversed(ranks), reversed(unit.levels), strict=True):
        x, y = np.minimum(a + length, n - 1), np.minimum(b + length, n - 1)
        length += step * ((rank[x] == rank[y]) & (a + length < n) & (b + length < n))
    for _ in range(unit.packed - 1):
        x, y = np.minimum(a + length, n - 1), np.minimum(b + length, n - 1)
        length += (symbols[x] == symbols[y]) & (a + length < n) & (b + length < n)
    return length


def maximal_repeats(strings: list[np.ndarray], unit: Unit = BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Maximal repeats of at least ``unit.least`` symbols: length, string numbers and starts of all occurrences.

    Strings are no longer than contexts. An occurrence at a string's start differs from any other in
    the symbol to its left.
    """
    least = unit.least
    lengths = np.array([len(s) for s in strings])
    keep = lengths >= least
    if not keep.any():
        return
    symbols, starts, ranks = suffix_ranks(strings, unit)
    count = np.maximum(lengths - least + 1, 0)
    owner = np.repeat(np.arange(len(strings)), count)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
    suffix = starts[owner] + place
    top, reach = ranks[-1], unit.levels[-1]
    second = np.where(suffix + reach < len(symbols), top[np.minimum(suffix + reach, len(symbols) - 1)].astype(np.int64) + 1, 0)
    order = np.argsort(top[suffix].astype(np.int64) << 32 | second)
    suffix, owner, place = suffix[order], owner[order], place[order]
    shared = common_prefixes(symbols, ranks, unit, suffix[:-1], suffix[1:])
    rest = lengths[owner] - place
    shared = np.minimum(shared, np.minimum(rest[:-1], rest[1:]))
    joined = np.concatenate([[False], shared >= least])
    # the symbol to the left; a string's start is unlike any other
    left = np.where(place > 0, symbols[suffix - 1], -1 - np.arange(len(suffix)))
    first = np.flatnonzero(~joined)
    size = np.diff(np.append(first, len(joined)))
    diverse = np.minimum.reduceat(left, first) != np.maximum.reduceat(left, first)
    for a, n in zip(first[(size > 1) & diverse].tolist(), size[(size > 1) & diverse].tolist(), strict=True):
        for length, i, j in _scan(shared[a : a + n - 1].tolist(), left[a : a + n].tolist()):
            yield length, owner[a + i : a + j], place[a + i : a + j]


def _scan(shared: list[int], left: list[int]) -> Iterator[tuple[int, int, int]]:
    """Stack scan of common-prefix intervals: (length, begin, end) of those that are left-diverse, inner ones first.

    ``shared``: common prefixes of neighbours; ``left``: the symbol before each suffix. A range of
    suffixes has one and the same symbol before them if no two neighbours in it differ.
    """
    n = len(left)
    changes = [0]
    for i in range(1, n):
        changes.append(changes[-1] + (left[i] != left[i - 1]))
    stack: list[tuple[int, int]] = []
    for i in range(1, n + 1):
        bound, begin = (shared[i - 1] if i < n else 0), i - 1
        while stack and stack[-1][0] > bound:
            length, begin = stack.pop()
            if changes[begin] != changes[i - 1]:
                yield length, begin, i
        if i < n and (not stack or stack[-1][0] < bound):
            stack.append((bound, begin))


COVERED = "id long, version int, lo int, hi int"


def _scan_groups(unit: Unit):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Contexts sorted by anchor to the covered spans of those that occur once; an anchor's are never parted."""
        waiting: list[tuple] = []
        size = 0

        def covered(rows: list[tuple]) -> pa.RecordBatch | None:
            best: dict[int, dict[int, int]] = {}
            for shared, owner, place in maximal_repeats([np.frombuffer(r[1], unit.dtype) for r in rows], unit):
                for o, p in zip(owner.tolist(), place.tolist(), strict=True):
                    ends = best.setdefault(o, {})
                    ends[p] = max(ends.get(p, 0), p + shared)
            spans = [(*rows[o][2:4], rows[o][4] + p, rows[o][4] + e) for o, ends in best.items() if rows[o][5] == 1 for p, e in merge(list(ends.items()))]
            return _batch(list(zip(*spans, strict=True)), COVERED) if spans else None

        for batch in batches:
            for row in zip(*(batch.column(n).to_pylist() for n in ("anchor", "data", "id", "version", "lo", "n")), strict=True):
                if size >= CHUNK and row[0] != waiting[-1][0]:
                    if found := covered(waiting):
                        yield found
                    waiting, size = [], 0
                waiting.append(row)
                size += len(row[1])
        if waiting and (found := covered(waiting)):
            yield found

    return run


CONTEXTS = "anchor long, data binary, id long, version int, lo int, n long, place int, low int"


def _cut_contexts(unit: Unit):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The symbols of the wanted contexts of each row, which is a text, or a context from the place ``_from`` on."""
        size = unit.size
        for batch in batches:
            parted = "_from" in batch.schema.names
            for a, b in slices(batch.column("text")):
                part = batch.slice(a, b - a)
                out = []
                for doc, version, text, at, wanted in zip(*(part.column(n).to_pylist() for n in ("_id", "_version", "text", "_from" if parted else "_id", "_wanted")), strict=True):
                    raw, at = (text, at) if parted else (unit.encode(text).tobytes(), 0)
                    for w in wanted:
                        lo = (w["lo"] - at) * size
                        out.append((w["anchor"], raw[lo : lo + w["len"] * size], doc, version, w["lo"], w["n"], w["place"], w["low"]))
                if out:
                    yield _batch(list(zip(*out, strict=True)), CONTEXTS)

    return run


#: What divided contexts have besides OCCURRENCES: the place of the row whose bytes they are cut from, the anchor's
#: place, and the least distance of their windows to it.
PARTS = OCCURRENCES + ", _from int, place int, low int"


def _divide(unit: Unit, width: int, before: int):
    """CONTEXTS of windows at ``before`` distances from their anchors, to PARTS of ``width`` distances each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digest, length, size = xxhash.xxh3_64_intdigest, unit.least, unit.size
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                data, lo, place, low = row["data"], row["lo"], row["place"], row["low"]
                if place < 0:  # not divided yet: the anchor is the last gram with its hash
                    grams = gram_hashes(np.frombuffer(data, unit.dtype), unit.gram).view(np.int64)
                    place, low = lo + int(np.flatnonzero(grams == row["anchor"])[-1]), 0
                final = lo + len(data) // size - length
                piece = lambda a, b: data[(a - lo) * size : (b - lo) * size]  # noqa: B023, E731
                for near in range(low, min(low + before, unit.distances), width):
                    far = min(near + width, low + before, unit.distances) - 1
                    first, last = max(lo, place - far), min(final, place - near)
                    if first <= last:
                        shared, context = piece(place - near, place + length - far), piece(first, last + length)
                        out.append((digest(shared, near), digest(context), row["id"], row["version"], first, len(context) // size, row["n"], lo, place, near))
            if out:
                columns = list(zip(*out, strict=True))
                yield _batch([*(np.array(c, np.uint64).view(np.int64) for c in columns[:2]), *columns[2:]], PARTS)

    return run


def keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with _id and _version, which tell rows apart as far as their ids and texts do; columns named like OWN are dropped."""
    return docs.drop(*OWN).withColumns(
        {"_id": F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text")), "_version": F.hash("text")}
    )


def _resolve(found: DataFrame, source: DataFrame, keys: list[str], unit: Unit) -> tuple[DataFrame, DataFrame | None]:
    """Covered spans (COVERED) of the contexts in ``found`` (PARTS), and the contexts of crowded anchors (CONTEXTS), if there are any.

    ``source`` has the symbols: _id, _version, text and, for divided contexts, _from; ``keys`` tell its rows apart.
    """
    several = (
        found.groupBy("anchor")
        .agg(F.sum("n").alias("_n"), F.min("context").alias("_lo"), F.max("context").alias("_hi"))
        .where("_n > 1")
        .select("anchor", (F.col("_lo") == F.col("_hi")).alias("same"))
    )
    # written first: Spark splits a skewed join only if its sides come straight from shuffles
    again = cut(found.join(cut(several, "several"), "anchor"), "repeated")
    span = ["id", "version", "lo", (F.col("lo") + F.col("len")).alias("hi")]
    whole = again.where("same").select(*span)
    mixed = again.where(~F.col("same"))
    one = F.struct("id", "version", "lo", "len", "_from", "place", "low")
    kinds = cut(mixed.groupBy("anchor", "context").agg(F.sum("n").alias("n"), F.min(one).alias("_one")), "contexts")
    copied = mixed.join(kinds.where("n > 1").select("anchor", "context"), ["anchor", "context"], "left_semi").select(*span)
    groups = kinds.groupBy("anchor").agg(F.count("*").alias("_kinds"), F.min("n").alias("_least")).where("_least = 1")
    groups = cut(groups, "groups")
    place = F.struct("anchor", "_one.lo", "_one.len", "n", "_one.place", "_one.low").alias("w")
    wanted = kinds.join(groups, "anchor").select("_one.id", "_one.version", "_one._from", place, "_kinds")

    def contexts(some: DataFrame) -> DataFrame:
        """The symbols of some contexts. The texts' shuffle is the same here and where spans are cut out, so Spark reuses it."""
        lists = some.groupBy(*[F.col(k if k == "_from" else k[1:]).alias(k) for k in keys]).agg(F.collect_list("w").alias("_wanted"))
        return arrow_map(source.join(lists.hint("shuffle_hash"), keys), _cut_contexts(unit), CONTEXTS)

    few = contexts(wanted.where(F.col("_kinds") <= GROUP_MAX)).repartition("anchor").sortWithinPartitions("anchor")
    spans = whole.unionByName(copied).unionByName(arrow_map(few, _scan_groups(unit), COVERED))
    if not groups.where(F.col("_kinds") > GROUP_MAX).limit(1).count():
        return spans, None
    return spans, cut(contexts(wanted.where(F.col("_kinds") > GROUP_MAX)), "crowded")


def covered_spans(base: DataFrame, unit: Unit = BYTES) -> DataFrame:
    """_id, _version, _spans (array of lo, hi; not merged yet) of the rows of ``base`` (see ``keyed``) with repeated symbols.

    Spans are places among the text's symbols, repeats have ``unit.least`` of them at least.
    """
    made = cut(arrow_map(base.select("_id", "_version", "text"), _find_anchors(unit), OCCURRENCES), "anchors")
    inside = made.where("n IS NULL").select("id", "version", "lo", (F.col("lo") + F.col("len")).alias("hi"))
    whole_texts = {"_from": F.lit(0), "place": F.lit(-1), "low": F.lit(0)}
    spans, crowded = _resolve(made.where("n IS NOT NULL").withColumns(whole_texts), base, ["_id", "_version"], unit)
    spans, before = spans.unionByName(inside), unit.distances
    while crowded is not None:
        width = -(-before // PARTS_OF)
        source = crowded.select(F.col("id").alias("_id"), F.col("version").alias("_version"), F.col("lo").alias("_from"), F.col("data").alias("text"))
        parts = cut(arrow_map(crowded, _divide(unit, width, before), PARTS), "parts")
        more, crowded = _resolve(parts, source, ["_id", "_version", "_from"], unit)
        spans, before = spans.unionByName(more), width
    return spans.groupBy(F.col("id").alias("_id"), F.col("version").alias("_version")).agg(
        F.collect_set(F.struct("lo", "hi")).alias("_spans")
    )


def merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted spans; those that overlap or touch become one."""
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1][1]:
            out[-1] = (out[-1][0], max(hi, out[-1][1]))
        else:
            out.append((lo, hi))
    return out


def without(raw: bytes, spans: list[tuple[int, int]]) -> bytes:
    edges = [0, *(x for span in spans for x in span), len(raw)]
    return b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))


def on_characters(raw: bytes, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans without the parts of characters at their ends, so that what stays is valid UTF-8."""
    out = []
    for lo, hi in spans:
        while lo < hi and raw[lo] & 0xC0 == 0x80:
            lo += 1
        while lo < hi < len(raw) and raw[hi] & 0xC0 == 0x80:
            hi -= 1
        if lo < hi:
            out.append((lo, hi))
    return out


def _spans(value: list[dict] | None) -> list[tuple[int, int]]:
    return merge([(s["lo"], s["hi"]) for s in value or []])


RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_passages long, passage_words long"


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a, b in slices(batch.column("text")):
            part = batch.slice(a, b - a)
            rows = []
            for doc, text, value, coded in zip(*(part.column(n).to_pylist() for n in ("doc_id", "text", "_spans", "_word_spans")), strict=True):
                raw, spans = (text or "").encode(), _spans(value)
                passages = [n for _, _, n in word_spans(raw, _spans(coded))]
                rows.append((doc, len(raw), sum(hi - lo for lo, hi in spans), len(spans), hashlib.sha256(without(raw, spans)).hexdigest(), len(passages), sum(passages)))
            yield _batch(list(zip(*rows, strict=True)), RESULT)


def with_spans(base: DataFrame, words: bool) -> DataFrame:
    """``base`` (see ``keyed``) with _spans, of bytes, and with ``words`` also _word_spans, of words; null: none."""
    found = base.join(covered_spans(base).hint("shuffle_hash"), ["_id", "_version"], "left")
    if not words:
        return found.withColumn("_word_spans", F.lit(None).cast("array<struct<lo:int,hi:int>>"))
    coded = covered_spans(base, WORDS).withColumnRenamed("_spans", "_word_spans")
    return found.join(coded.hint("shuffle_hash"), ["_id", "_version"], "left")


def query(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every row; n_passages and passage_words besides.

    Null text is empty. Repeated rows are documents like any other, so their texts of 400 bytes and
    more are removed. Null ids are kept apart by their text. The last two are passages of 51 words
    at least that occur elsewhere too, however few bytes they have, and the words in them; they are
    reported, what is removed goes by bytes alone.
    """
    return arrow_map(with_spans(keyed(docs.select("doc_id", "text")), words=True), _digest, RESULT)


def remove_repeats(docs: DataFrame, words: bool = False) -> DataFrame:
    """``docs`` with the repeated bytes cut out of ``text`` (in whole characters); all rows stay, and all columns but OWN.

    Null and empty texts stay as they are; rows repeated in id and text are cut alike.

    With ``words`` repeats of 51 words go too, however few bytes they have. Their words are the same
    without the ASCII punctuation at their ends; white space and punctuation between them need not be.
    """
    docs = docs.drop(*OWN)
    names = docs.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column("text")):
                part = batch.slice(a, b - a)
                texts = []
                for text, value, coded in zip(*(part.column(n).to_pylist() for n in ("text", "_spans", "_word_spans")), strict=True):
                    if value or coded:
                        raw = text.encode()
                        spans = merge([*_spans(value), *((a, b) for a, b, _ in word_spans(raw, _spans(coded)))])
                        text = without(raw, on_characters(raw, spans)).decode()
                    texts.append(text)
                yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if n == "text" else part.column(n) for n in names], names)

    return arrow_map(with_spans(keyed(docs), words), run, schema)
