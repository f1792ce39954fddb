"""Byte-level BPE: script-aware pre-tokens, training, encoding, decoding; token offsets, batches and padding."""

from __future__ import annotations

import heapq
import json
import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bitloom.operators import annotation as an
from bitloom.sources.tables import scratch

# Special tokens in the order of their ids.
SPECIALS = [("PAD", None), ("BOS", None), ("EOS", None), ("HEADER", an.HEADER), ("TOKEN", an.TOKEN), ("WORD", an.WORD), ("SENTENCE", an.SENTENCE),
            ("GRAMMAR", an.GRAMMAR), ("PARAGRAPH", an.PARAGRAPH), ("LIST_SEP", an.LIST_SEP), ("FIELD_SEP", an.FIELD_SEP), ("RECORD_END", an.RECORD_END)]
PAD, BOS, EOS = 0, 1, 2
OFFSET, BYTES = len(SPECIALS), 256
VERSION = 1
#: Different pre-tokens that one task takes to find merges; of more, about as many to guess merges from, which all words then confirm.
MOST_WORDS = 300_000
#: Symbols of words that a task holds at once, and characters of texts that it encodes at once.
CHUNK = 1 << 20
#: Merges up to which new words of a batch are encoded together, a pass for each merge.
MOST_PASSES = 1000
#: Stands behind each word among symbols.
END = 0xFFFFFFFF

_HAN, _HIRA, _KATA = r"\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{F900}-\x{FAFF}", r"\x{3040}-\x{309F}", r"\x{30A0}-\x{30FF}\x{FF66}-\x{FF9D}"
#: Runs of one script; the last space before Latin letters or digits belongs to them.
PRETOKEN = rf"(?U)\s?[A-Za-z]+|\s?[0-9]+|[{_HAN}]+|[{_HIRA}]+|[{_KATA}]+|\s+(?=\s[A-Za-z0-9])|\s+|[^\sA-Za-z0-9{_HAN}{_HIRA}{_KATA}]+"
_PRETOKEN = re.compile(re.sub(r"\\x\{([0-9A-F]+)\}", lambda m: chr(int(m[1], 16)), PRETOKEN.removeprefix("(?U)")))


Pair = tuple[int, int]


def pretokens(text: Column) -> Column:
    """Pre-tokens, whose concatenation is the text."""
    return F.regexp_extract_all(text, F.lit(PRETOKEN), F.lit(0))


def frequencies(texts: DataFrame, column: str) -> DataFrame:
    """(word, freq) of all pre-tokens; counted in each partition first."""
    return texts.select(F.explode(pretokens(F.col(column))).alias("word")).groupBy("word").agg(F.count("*").alias("freq"))


def pair_counts(words: DataFrame) -> DataFrame:
    """(a, b, n): adjacent bytes of the words, weighted by frequency."""
    hexed = F.hex(F.encode(F.col("word"), "UTF-8"))
    at = lambda i: F.conv(F.substring(hexed, 2 * i + 1, F.lit(2)), 16, 10).cast("int")
    several = words.where(F.octet_length("word") > 1)
    places = several.select("word", "freq", F.explode(F.sequence(F.lit(0), F.octet_length("word") - 2)).alias("i"))
    return places.groupBy(at(F.col("i")).alias("a"), at(F.col("i") + 1).alias("b")).agg(F.sum("freq").alias("n"))


# --- training --------------------------------------------------------------------------------------


class Words:
    """Words as one array of symbols, linked to their neighbours within the word, and the places of each pair."""

    def __init__(self, symbols: np.ndarray, lengths: np.ndarray, freqs: np.ndarray) -> None:
        """``symbols``: those of all words, none of them empty, one after the other."""
        self.symbol, self.weight = symbols.astype(np.int64), np.repeat(freqs.astype(np.int64), lengths)
        self.following, self.before = np.arange(1, len(symbols) + 1), np.arange(-1, len(symbols) - 1)
        ends = np.cumsum(lengths)
        self.following[ends - 1] = -1
        self.before[ends - lengths] = -1
        self.places: defaultdict[int, list[np.ndarray]] = defaultdict(list)

    def _keys(self, places: np.ndarray) -> np.ndarray:
        return self.symbol[places] << 32 | self.symbol[self.following[places]]

    def _recount(self, gone: np.ndarray, gone_keys: np.ndarray, come: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs that begin at ``gone`` were there, those that begin at ``come`` are now: keys and what their counts change by."""
        come_keys = self._keys(come)
        order = np.argsort(come_keys)
        arranged = come_keys[order]
        cuts = np.flatnonzero(arranged[1:] != arranged[:-1]) + 1
        for part in np.split(come[order], cuts) if len(order) else []:
            self.places[int(self._keys(part[:1])[0])].append(part)
        weights = self.weight[come[order]]
        if len(gone):
            arranged, weights = np.concatenate([gone_keys, come_keys]), np.concatenate([-self.weight[gone], self.weight[come]])
            order = np.argsort(arranged)
            arranged, weights = arranged[order], weights[order]
            cuts = np.flatnonzero(arranged[1:] != arranged[:-1]) + 1
        begins = np.concatenate([[0], cuts]) if len(arranged) else np.zeros(0, np.int64)
        by = np.add.reduceat(weights, begins) if len(begins) else weights
        return arranged[begins][by != 0], by[by != 0]

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Keys and counts of all pairs; to be asked once, before the first merge."""
        none = np.zeros(0, np.int64)
        return self._recount(none, none, np.flatnonzero(self.following >= 0))

    def merge(self, key: int, new: int) -> tuple[np.ndarray, np.ndarray]:
        """Join all places of a pair; keys of pairs and what their counts change by."""
        symbol, following, before = self.symbol, self.following, self.before
        a, b = key >> 32, key & 0xFFFFFFFF
        at = np.unique(np.concatenate([np.zeros(0, np.int64), *self.places.pop(key, [])]))
        at = at[(symbol[at] == a) & (following[at] >= 0)]
        at = at[symbol[following[at]] == b]
        if a == b and len(at):  # in a run of equal symbols every second place, from the left
            fresh = np.concatenate([[True], at[1:] != following[at[:-1]]])
            first = np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))
            at = at[(np.arange(len(at)) - first) % 2 == 0]
        second = following[at]
        left = before[at]
        gone = np.unique(np.concatenate([left[left >= 0], at, second[following[second] >= 0]]))
        gone_keys = self._keys(gone)
        after = following[second]
        symbol[at], symbol[second], following[at] = new, -1, after
        before[after[after >= 0]] = at[after >= 0]
        left = before[at]
        return self._recount(gone, gone_keys, np.unique(np.concatenate([left[left >= 0], at[after >= 0]])))


class Ranking:
    """Counts of pairs. A heap holds each pair with a count it had; an entry whose count is out of date is dropped."""

    def __init__(self) -> None:
        self.counts: dict[int, int] = {}
        self.heap: list[tuple[int, int]] = []

    def add(self, keys: np.ndarray, by: np.ndarray) -> None:
        for key, n in zip(keys.tolist(), by.tolist(), strict=True):
            self.counts[key] = self.counts.get(key, 0) + n
            if self.counts[key] > 0:
                heapq.heappush(self.heap, (-self.counts[key], key))

    def best(self) -> int | None:
        """The most frequent pair, of equals the smallest; none if there is no pair."""
        while self.heap and self.counts.get(self.heap[0][1], 0) != -self.heap[0][0]:
            heapq.heappop(self.heap)
        return self.heap[0][1] if self.heap else None


class Exact:
    """What is known of all words while merges are guessed from a share: counts of all pairs at ``step``, and what merges changed
    them by. Symbols have names, given to what they are made of, since each guess numbers them by its own order."""

    def __init__(self) -> None:
        self.step, self.counts = 0, None
        self.names: dict[Pair, int] = {}
        self.changes: dict[Pair, tuple[np.ndarray, ...]] = {}

    def name(self, pair: Pair) -> int:
        return self.names.setdefault(pair, BYTES + len(self.names))

    def learn(self, guess: list[Pair], step: int, keys: np.ndarray, by: np.ndarray) -> None:
        """What the merge before ``step`` of a guess changed counts by."""
        named = list(range(BYTES))
        for a, b in guess[:step]:
            named.append(self.name((named[a], named[b])))
        a, b = guess[step - 1]
        names = np.array(named)
        self.changes[named[a], named[b]] = names[keys >> 32], names[keys & 0xFFFFFFFF], by


def train_merges(freqs: dict[bytes, int], count: int, begun: list[Pair] | None = None, exact: Exact | None = None) -> list[Pair]:
    """``count`` merges, or as many as there are: each the most frequent adjacent pair, of equals the smallest. ``begun``: the first of them, if they are given.

    A merge looks up the places of its pair, joins them all at once and recounts the pairs that begin at or before them.
    ``exact`` stands in for the counts of these words where it has them. Merges that don't touch change the same counts in any
    order, so that two that were guessed in the wrong order leave little to be guessed again.
    """
    used = [w for w in freqs if w]
    words = Words(np.frombuffer(b"".join(used), np.uint8), np.array([len(w) for w in used], np.int64), np.array([freqs[w] for w in used], np.int64))
    ranking, merges, begun, exact = Ranking(), [], begun or [], exact or Exact()
    counted = words.pairs()
    if exact.counts is None:
        ranking.add(*counted)
    named, symbols = list(range(BYTES)), {k: k for k in range(BYTES)}
    while len(merges) < count:
        k = len(merges)
        if exact.counts is not None and k == exact.step:
            ranking.add(*exact.counts)
        best = begun[k][0] << 32 | begun[k][1] if k < len(begun) else ranking.best()
        if best is None:
            break
        a, b = best >> 32, best & 0xFFFFFFFF
        changed = words.merge(best, BYTES + k)
        pair = named[a], named[b]
        named.append(exact.name(pair))
        symbols[named[-1]] = BYTES + k
        if pair in exact.changes:
            firsts, seconds, by = exact.changes[pair]
            of = np.full(BYTES + len(exact.names), -1)
            of[list(symbols)] = list(symbols.values())
            there = (of[firsts] >= 0) & (of[seconds] >= 0)
            changed = of[firsts[there]] << 32 | of[seconds[there]], by[there]
        if exact.counts is None or k >= exact.step:
            ranking.add(*changed)
            ranking.counts[best] = 0
        merges.append((a, b))
    return merges


def joined(symbols: np.ndarray, pair: Pair, new: int) -> np.ndarray:
    """``merged`` for an array of symbols; what separates words is in no pair."""
    at = np.flatnonzero((symbols[:-1] == pair[0]) & (symbols[1:] == pair[1]))
    if pair[0] == pair[1] and len(at):
        fresh = np.concatenate([[True], at[1:] != at[:-1] + 1])
        first = np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))
        at = at[(np.arange(len(at)) - first) % 2 == 0]
    if not len(at):
        return symbols
    symbols[at] = new
    keep = np.ones(len(symbols), bool)
    keep[at + 1] = False
    return symbols[keep]


def symbols_of(words: list[bytes], merges: list[Pair]) -> tuple[np.ndarray, np.ndarray]:
    """Symbols of all words after the merges, with END behind each word, and the places of these."""
    # in 16 bits where they hold all symbols
    kind = np.uint16 if BYTES + len(merges) < 0xFFFF else np.uint32
    end = np.iinfo(kind).max
    symbols = np.frombuffer(b"\0".join([*words, b""]), np.uint8).astype(kind)
    symbols[np.cumsum(np.array([len(w) + 1 for w in words], np.int64)) - 1] = end
    for k, pair in enumerate(merges):
        symbols = joined(symbols, pair, BYTES + k)
    symbols = symbols.astype(np.uint32)
    symbols[symbols == end] = END
    return symbols, np.flatnonzero(symbols == END)


def counts_along(words: DataFrame, merges: list[Pair], known: int) -> DataFrame:
    """(step, pair, n): the counts of all pairs after the first ``known`` merges, and what each later merge changes them by."""

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[Words]:
        held, size = [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                held.append(batch.slice(at, 4096))
                size += pc.sum(pc.binary_length(held[-1]["word"])).as_py()
                if size >= CHUNK:
                    yield words_of(held)
                    held, size = [], 0
        if size:
            yield words_of(held)

    def words_of(held: list[pa.RecordBatch]) -> Words:
        rows = pa.Table.from_batches(held)
        symbols, ends = symbols_of(rows["word"].cast("large_binary").to_pylist(), merges[:known])
        lengths = np.diff(ends, prepend=-1) - 1
        return Words(symbols[symbols != END], lengths, rows["freq"].to_numpy())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches):
            steps, pairs, by = [], [], []
            for k in range(known, len(merges) + 1):
                keys, n = part.pairs() if k == known else part.merge(merges[k - 1][0] << 32 | merges[k - 1][1], BYTES + k - 1)
                steps.append(np.full(len(keys), k, np.int32))
                pairs.append(keys)
                by.append(n)
            made = [pa.array(np.concatenate(x)) for x in (steps, pairs, by)]
            yield pa.RecordBatch.from_arrays(made, ["step", "pair", "n"])

    return words.mapInArrow(run, "step int, pair long, n long").groupBy("step", "pair").agg(F.sum("n").alias("n")).where("n <> 0")


def merges_in_a_task(words: DataFrame, count: int, begun: list[Pair], exact: Exact) -> list[Pair]:
    """``train_merges`` of a table (word, freq) that one task holds; the driver gets the merges."""
    sent = words.sparkSession.sparkContext.broadcast(exact)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        freqs: dict[bytes, int] = {}
        for batch in batches:
            freqs.update(zip(batch["word"].cast("binary").to_pylist(), batch["freq"].to_pylist(), strict=True))
        made = np.array(train_merges(freqs, count, begun, sent.value), np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (np.arange(len(made)), made[:, 0], made[:, 1])], ["rank", "a", "b"])

    found = words.repartition(1).mapInArrow(run, "rank long, a long, b long").toArrow().sort_by("rank")
    return list(zip(found["a"].to_pylist(), found["b"].to_pylist(), strict=True))


def merges_of(words: DataFrame, count: int, most: int = MOST_WORDS) -> list[Pair]:
    """``train_merges`` of a table (word, freq) of any size, read several times.

    No word is on the driver. One task guesses the merges from about ``most`` of the words: each with a chance in proportion to its
    frequency, in its own weight where that chance is one. All words are then merged along the guess where they are, and
    the driver gets the exact counts of pairs at each step: up to the first step at which the guess was wrong
    all merges are confirmed, and that step's is known. From there it guesses again, with these counts where they hold.
    """
    share = 1.0
    by_freq = words.groupBy("freq").agg(F.count("*").alias("n")).toArrow()
    freq, n = by_freq["freq"].to_numpy().astype(float), by_freq["n"].to_numpy()
    if n.sum() > most:
        low, share = 0.0, 1.0
        for _ in range(60):
            middle = (low + share) / 2
            low, share = (middle, share) if (np.minimum(1, freq * middle) * n).sum() < most else (low, middle)
    chance = F.least(F.lit(1.0), F.col("freq") * F.lit(share))
    dealt = F.pmod(F.xxhash64("word"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    some = words.where(dealt < chance).select("word", F.round(F.col("freq") / chance).cast("long").alias("freq"))
    if n.sum() <= most:
        return merges_in_a_task(some, count, [], Exact())
    merges, exact = [], Exact()
    while len(merges) < count:
        known, guess = len(merges), merges_in_a_task(some, count, merges, exact)
        found = counts_along(words, guess, known).toArrow().sort_by("step")
        ends = np.searchsorted(found["step"].to_numpy(), np.arange(known, len(guess) + 2))
        keys, by, ranking = found["pair"].to_numpy(), found["n"].to_numpy(), Ranking()
        for k in range(known + 1, len(guess) + 1):
            exact.learn(guess, k, keys[ends[k - known] : ends[k - known + 1]], by[ends[k - known] : ends[k - known + 1]])
        for k in range(known, count):
            if k <= len(guess):
                ranking.add(keys[ends[k - known] : ends[k - known + 1]], by[ends[k - known] : ends[k - known + 1]])
            best = ranking.best()
            if best is None:
                return merges
            merges.append((best >> 32, best & 0xFFFFFFFF))
            if k >= len(guess) or guess[k] != merges[k]:
                there = [(key, n) for key, n in ranking.counts.items() if n > 0]
                exact.step, exact.counts = k, tuple(np.array(there, np.int64).reshape(-1, 2).T)
                break
    return merges


def merged(word: list[int], pair: Pair, new: int) -> list[int]:
    """``word`` with each occurrence of ``pair``, from the left and without overlaps, replaced."""
    out: list[int] = []
    for x in word:
        # a merge leaves ``new`` at the end, which is never the first half of the same pair
        if out and out[-1] == pair[0] and x == pair[1]:
            out[-1] = new
        else:
            out.append(x)
    return out


def train(texts: DataFrame, column: str, vocab: int) -> Tokenizer:
    """A tokenizer of at most ``vocab`` tokens.

    Spark counts the pre-tokens and writes them once. The merges follow from all of them; the driver
    has none of them (see ``merges_of``).
    """
    count = vocab - OFFSET - BYTES
    if count < 0:
        raise ValueError(f"a vocabulary has at least {OFFSET + BYTES} tokens")
    spark = texts.sparkSession
    path = scratch(spark, "words")
    frequencies(texts, column).where("word <> ''").write.parquet(path)
    return Tokenizer(merges_of(spark.read.schema("word string, freq long").parquet(path), count))


class Tokenizer:
    """Merges with encoding and decoding. Ids: special tokens, then bytes, then merges."""

    def __init__(self, merges: list[Pair]) -> None:
        self.merges = [(int(a), int(b)) for a, b in merges]
        self.rank = {pair: k for k, pair in enumerate(self.merges)}
        self.pieces = [bytes([b]) for b in range(BYTES)]
        for a, b in self.merges:
            self.pieces.append(self.pieces[a] + self.pieces[b])
        self._special = {c: i for i, (_, c) in enumerate(SPECIALS) if c}
        self._known: dict[str, list[int]] = {}

    @property
    def vocab_size(self) -> int:
        return OFFSET + BYTES + len(self.merges)

    def name_to_id(self, name: str) -> int:
        return {n: i for i, (n, _) in enumerate(SPECIALS)}[name]

    def prefix(self, vocab: int) -> Tokenizer:
        """The tokenizer of a smaller vocabulary: its merges are the first of these."""
        return Tokenizer(self.merges[: vocab - OFFSET - BYTES])

    def _word(self, word: str) -> list[int]:
        if word not in self._known:
            ids = list(word.encode())
            while len(ids) > 1:
                rank = min((self.rank[p] for p in zip(ids, ids[1:], strict=False) if p in self.rank), default=None)
                if rank is None:
                    break
                ids = merged(ids, self.merges[rank], BYTES + rank)
            if len(self._known) > 200_000:
                self._known.clear()
            self._known[word] = [OFFSET + i for i in ids]
        return self._known[word]

    def encode(self, text: str, add_bos: bool = False, add_eos: bool = False) -> list[int]:
        """Ids of a text; special characters are tokens of their own and never merge."""
        ids = [BOS] if add_bos else []
        for part in re.split(f"([{''.join(self._special)}])", text):
            if part in self._special:
                ids.append(self._special[part])
            else:
                for word in _PRETOKEN.findall(part):
                    ids += self._word(word)
        return ids + [EOS] if add_eos else ids

    def decode(self, ids: list[int], skip_special: bool = True) -> str:
        """Text of ids; broken UTF-8 and unknown ids become U+FFFD, control tokens are skipped or named."""
        out, held = [], bytearray()

        def flush() -> None:
            out.append(held.decode("utf-8", "replace"))
            held.clear()

        for i in ids:
            if OFFSET <= i < self.vocab_size:
                held += self.pieces[i - OFFSET]
                continue
            flush()
            if 0 <= i < OFFSET:
                name, char = SPECIALS[i]
                out.append(char or ("" if skip_special else f"<{name}>"))
            else:
                out.append("\ufffd")
        flush()
        return "".join(out)

    def to_json(self) -> str:
        specials = [{"name": n, "id": i, "surface": c} for i, (n, c) in enumerate(SPECIALS)]
        head = json.dumps({"version": VERSION, "pretokenizer": "script_aware", "special_tokens": specials})[:-1]
        return head + ', "merges": [\n' + ",\n".join(f"[{a}, {b}]" for a, b in self.merges) + "\n]}\n"

    @classmethod
    def from_json(cls, text: str) -> Tokenizer:
        data = json.loads(text)
        if data["version"] != VERSION:
            raise ValueError(f"unknown tokenizer version {data['version']}")
        return cls(data["merges"])


def encode_words(words: list[str], merges: list[Pair]) -> list[bytes]:
    """Ids of each word, as the bytes of int32. Merges in their order give what the lowest rank first gives in each word."""
    symbols, ends = symbols_of([w.encode() for w in words], merges)
    held, begins = (symbols + np.uint32(OFFSET)).astype(np.int32).tobytes(), np.concatenate([[0], ends[:-1] + 1]) * 4
    return [held[i:j] for i, j in zip(begins.tolist(), (ends * 4).tolist(), strict=True)]


class BatchEncoder:
    """Ids of columns of texts, as ``Tokenizer.encode`` gives them; each word is encoded once, new ones together."""

    def __init__(self, tokenizer: Tokenizer, add_bos: bool = False, add_eos: bool = False) -> None:
        one = lambda i: np.int32(i).tobytes()
        self.tokenizer, self.before, self.after = tokenizer, one(BOS) if add_bos else b"", one(EOS) if add_eos else b""
        self.special = {c: one(i) for c, i in tokenizer._special.items()}
        self.marks = re.compile(f"([{''.join(self.special)}])")
        self.known = dict(self.special)

    def words(self, text: str) -> list[str]:
        if not self.marks.search(text):
            return _PRETOKEN.findall(text)
        return [w for part in self.marks.split(text) for w in ([part] if part in self.special else _PRETOKEN.findall(part))]

    def some(self, texts: list[str | None]) -> pa.Array:
        cut = [None if t is None else self.words(t) for t in texts]
        new = list(set().union(*filter(None, cut)) - self.known.keys())
        if new and len(self.known) > 500_000:
            self.known = dict(self.special)
            new = list(set().union(*filter(None, cut)) - self.known.keys())
        if len(self.tokenizer.merges) <= MOST_PASSES:
            made = encode_words(new, self.tokenizer.merges) if new else []
        else:
            made = [np.array(self.tokenizer._word(w), np.int32).tobytes() for w in new]
        self.known.update(zip(new, made, strict=True))
        ids = [None if c is None else b"".join([self.before, *map(self.known.__getitem__, c), self.after]) for c in cut]
        offsets = np.concatenate([[0], np.cumsum([0 if i is None else len(i) // 4 for i in ids])]).astype(np.int32)
        values = pa.array(np.frombuffer(b"".join(filter(None, ids)), np.int32))
        return pa.ListArray.from_arrays(pa.array(offsets), values, mask=pa.array([i is None for i in ids]))

    def column(self, texts: pa.Array) -> pa.Array:
        """In slices of some CHUNK bytes."""
        size = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(texts), 0))) // CHUNK
        cuts = [0, *(np.flatnonzero(size[1:] != size[:-1]) + 1).tolist(), len(texts)]
        parts = [self.some(texts[i:j].to_pylist()) for i, j in zip(cuts, cuts[1:], strict=False) if i < j]
        return pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.int32()))


class BatchDecoder:
    """Texts of columns of ids, as ``Tokenizer.decode`` gives them."""

    def __init__(self, tokenizer: Tokenizer, skip_special: bool = True) -> None:
        self.tokenizer, self.skip_special = tokenizer, skip_special
        pieces = [(c or "").encode() for _, c in SPECIALS] + tokenizer.pieces
        self.letters = np.frombuffer(b"".join(pieces), np.uint8)
        self.lengths = np.array([len(p) for p in pieces], np.int64)
        self.begins = np.cumsum(self.lengths) - self.lengths

    def column(self, ids: pa.Array) -> pa.Array:
        size = np.cumsum(np.asarray(pc.fill_null(pc.list_value_length(ids), 0), np.int64)) // CHUNK
        cuts = [0, *(np.flatnonzero(size[1:] != size[:-1]) + 1).tolist(), len(ids)]
        parts = [self.some(ids[i:j]) for i, j in zip(cuts, cuts[1:], strict=False) if i < j]
        return pa.concat_arrays(parts) if parts else pa.array([], pa.string())

    def some(self, ids: pa.Array) -> pa.Array:
        flat = ids.flatten()
        values = np.asarray(flat, np.int64) if not flat.null_count else np.array([-1])
        if not len(values) or values.min() > EOS and values.max() < len(self.lengths):
            sizes = self.lengths[values]
            ends = np.cumsum(sizes)
            at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.begins[values] - (ends - sizes), sizes)
            letters = self.letters[at]
            rows = np.concatenate([[0], np.cumsum(np.asarray(pc.fill_null(pc.list_value_length(ids), 0), np.int64))])
            places = np.concatenate([[0], ends])[rows]
            begins = places[:-1][places[:-1] < len(letters)]
            if not (letters[begins] & 0xC0 == 0x80).any():
                try:
                    raw = letters.tobytes()
                    raw.decode()
                    texts = pa.StringArray.from_buffers(len(ids), pa.py_buffer(places.astype(np.int32)), pa.py_buffer(raw))
                    return pc.if_else(ids.is_valid(), texts, pa.scalar(None, pa.string())) if ids.null_count else texts
                except UnicodeDecodeError:
                    pass
        # control tokens, unknown ids or broken characters: row by row
        return pa.array([None if row is None else self.tokenizer.decode(row, self.skip_special) for row in ids.to_pylist()], pa.string())


def encode_column(df: DataFrame, column: str, merges: list[Pair], out: str = "ids", add_bos: bool = False, add_eos: bool = False) -> DataFrame:
    """``df`` with the ids of a text column. Merges are broadcast (their number is the vocabulary's); words are encoded once in each task."""
    sent = df.sparkSession.sparkContext.broadcast(merges)

    @F.arrow_udf("array<int>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = BatchEncoder(Tokenizer(sent.value), add_bos, add_eos)
        for batch in batches:
            yield known.column(batch)

    return df.withColumn(out, run(column))


def decode_column(df: DataFrame, column: str, merges: list[Pair], out: str = "text", skip_special: bool = True) -> DataFrame:
    sent = df.sparkSession.sparkContext.broadcast(merges)

    @F.arrow_udf("string")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = BatchDecoder(Tokenizer(sent.value), skip_special)
        for batch in batches:
            yield known.column(batch)

    return df.withColumn(out, run(column))


class Counts:
    """How many ids the texts of a column have under each of several vocabularies, the merges of which begin those of the last."""

    def __init__(self, merges: list[Pair], prefixes: list[int]) -> None:
        """``prefixes``: ascending numbers of merges."""
        self.encoder, self.merges, self.prefixes = BatchEncoder(Tokenizer([])), merges, prefixes
        self.known: dict[str, int] = {}
        self.table = np.zeros((0, len(prefixes)), np.int32)

    def of_words(self, words: list[str]) -> np.ndarray:
        """A row of numbers for each word. Merges in their order give what the lowest rank first gives in each word."""
        symbols, _ = symbols_of([w.encode() for w in words], [])
        made = np.empty((len(words), len(self.prefixes)), np.int32)
        done = 0
        for i, n in enumerate(self.prefixes):
            for k in range(done, min(n, len(self.merges))):
                symbols = joined(symbols, self.merges[k], BYTES + k)
            done = max(done, min(n, len(self.merges)))
            made[:, i] = np.diff(np.flatnonzero(symbols == END), prepend=-1) - 1
        return made

    def some(self, texts: list[str | None]) -> pa.Array:
        cut = [None if t is None else self.encoder.words(t) for t in texts]
        new = list(set().union(*filter(None, cut)) - self.known.keys())
        if new and len(self.known) > 500_000:
            self.known, self.table = {}, self.table[:0]
            new = list(set().union(*filter(None, cut)))
        if new:
            rows = self.of_words(new)
            rows[[w in self.encoder.special for w in new]] = 1
            self.known.update(zip(new, range(len(self.known), len(self.known) + len(new)), strict=True))
            self.table = np.concatenate([self.table, rows])
        sizes = np.array([len(c or []) for c in cut], np.int64)
        places = np.fromiter(map(self.known.__getitem__, chain.from_iterable(filter(None, cut))), np.int64, sizes.sum())
        sums = np.concatenate([np.zeros((1, len(self.prefixes)), np.int64), np.cumsum(self.table[places], axis=0, dtype=np.int64)])
        ends = np.cumsum(sizes)
        values = pa.array((sums[ends] - sums[ends - sizes]).astype(np.int32).ravel())
        offsets = pa.array(np.arange(len(texts) + 1, dtype=np.int32) * len(self.prefixes))
        return pa.ListArray.from_arrays(offsets, values, mask=pa.array([c is None for c in cut]))

    column = BatchEncoder.column


def count_tokens(df: DataFrame, column: str, merges: list[Pair], vocabs: list[int], out: str = "tokens") -> DataFrame:
    """``df`` with the numbers of ids that a text has under vocabularies of ascending sizes, whose merges are the first of ``merges``.

    As the sizes of what ``encode_column`` gives; texts are cut once for all of them and no ids leave the task.
    """
    sent = df.sparkSession.sparkContext.broadcast((merges, [v - OFFSET - BYTES for v in vocabs]))

    @F.arrow_udf("array<int>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = Counts(*sent.value)
        for batch in batches:
            yield known.column(batch)

    return df.withColumn(out, run(column))


def output_ids(ids: Column) -> Column:
    """Ids without a leading BOS and from the first EOS on."""
    begin = F.when(F.get(ids, F.lit(0)) == BOS, 2).otherwise(1)
    end = F.when(F.array_position(ids, EOS) > 0, F.array_position(ids, EOS)).otherwise(F.size(ids) + 1)
    return F.slice(ids, begin, F.greatest(end - begin, F.lit(0)).cast("int"))


def as_training_pair(src: Column, tgt: Column, longest: int) -> tuple[Column, Column]:
    """src + EOS and BOS + tgt + EOS, of at most ``longest`` ids each."""
    one = lambda x: F.array(F.lit(x))
    return F.concat(F.slice(src, 1, longest - 1), one(EOS)), F.concat(one(BOS), F.slice(tgt, 1, longest - 2), one(EOS))


# --- stores, batches, padding ----------------------------------------------------------------------


def offsets(rows: DataFrame, order: str, lengths: list[str], parts: int | None = None) -> DataFrame:
    """``rows`` with <length>_off, the running sum of each length before the row, in the order of ids.

    Two levels: sums within ranges of ids, and the sums of the ranges before, so that no task has all
    rows. There are as many ranges as shuffle partitions, 64 at least.
    """
    parts = parts or max(64, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    cuts = sorted(set(rows.approxQuantile(order, [k / parts for k in range(1, parts)], 0.25 / parts)))
    ranges = F.array(*[F.lit(int(c)) for c in cuts]) if cuts else F.array().cast("array<bigint>")
    ranged = rows.withColumn("_range", F.size(F.filter(ranges, lambda c: c <= F.col(order))))
    sums = ranged.groupBy("_range").agg(*[F.sum(n).alias(f"_{n}") for n in lengths])
    before = Window.partitionBy(F.lit(0)).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("_range", *[F.coalesce(F.sum(f"_{n}").over(before), F.lit(0)).alias(f"_{n}") for n in lengths])
    inside = Window.partitionBy("_range").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    # at most ``parts`` rows of starts
    joined = ranged.join(F.broadcast(starts), "_range")
    return joined.select(*rows.columns, *[(F.coalesce(F.sum(n).over(inside), F.lit(0)) + F.col(f"_{n}")).alias(f"{n}_off") for n in lengths])


def pack(lengths: list[int], budget: int) -> list[int]:
    """Batch number of each item, in order: a batch ends before the item that makes (items * longest) exceed the budget."""
    out, batch, size, longest = [], 0, 0, 0
    for n in lengths:
        longest = max(longest, n)
        if size and (size + 1) * longest > budget:
            batch, size, longest = batch + 1, 0, n
        size += 1
        out.append(batch)
    return out


def token_batches(rows: DataFrame, budget: int, seed: int = 0, epoch: int = 0, shuffle: bool = True, megabatch: int = 50) -> DataFrame:
    """(batch_id, place, idx, length) of rows (idx, length): batches whose padded size keeps to the budget.

    Seeded order, megabatches of about ``megabatch`` batches, sorted by length within, packed in
    order; batches are numbered in a seeded order. A megabatch is one task's group; its size is
    bounded by the budget.
    """
    stats = rows.agg(F.count("*").alias("n"), F.avg("length").alias("mean")).first()
    if not stats["n"]:
        return rows.sparkSession.createDataFrame([], "batch_id string, place int, idx long, length int")
    size = max(1, megabatch * budget // max(1, int(stats["mean"])))
    groups = -(-stats["n"] // size)
    order = F.xxhash64(F.lit(seed + epoch), "idx") if shuffle else F.col("idx")
    # a seeded order cut at equal distances deals out equal shares; without a shuffle ids are cut into equal ranges
    if shuffle:
        group = F.pmod(order, F.lit(groups))
    else:
        top = rows.agg(F.max("idx").alias("m")).first()["m"]
        group = F.floor(F.col("idx") * groups / (top + 1))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "o"], kind="stable")
        batch = pack(pdf["length"].tolist(), budget)
        ids = pdf["g"].iloc[0]
        return pd.DataFrame({"batch_id": [f"{ids}-{b}" for b in batch], "place": range(len(pdf)), "idx": pdf["idx"].to_numpy(), "length": pdf["length"].to_numpy()})

    keyed = rows.select(group.cast("long").alias("g"), order.alias("o"), "idx", F.col("length").cast("int").alias("length"))
    return keyed.groupBy("g").applyInPandas(run, "batch_id string, place int, idx long, length int")


def pad_batches(rows: DataFrame, column: str, by: str = "batch_id", pad: int = PAD) -> DataFrame:
    """``rows`` with the array column padded to the longest of its batch."""
    longest = F.max(F.size(column)).over(Window.partitionBy(by))
    return rows.withColumn("_n", longest).withColumn(column, F.concat(column, F.array_repeat(F.lit(pad), (F.col("_n") - F.size(column)).cast("int")))).drop("_n")


def load_batches(store: DataFrame, budget: int, seed: int = 0, epoch: int = 0, shuffle: bool = True) -> DataFrame:
    """(batch_id, idx, src, tgt) of a store (idx, src, tgt, length): batches in their order, padded to their longest, longest side first.

    The store is joined with the batches by id; sort or stream partitions by batch_id to train on them.
    """
    batches = token_batches(store.select("idx", "length"), budget, seed, epoch, shuffle).select("batch_id", "place", "idx")
    rows = batches.join(store.select("idx", "src", "tgt"), "idx")
    padded = pad_batches(pad_batches(rows, "src"), "tgt")
    return padded.repartition("batch_id").sortWithinPartitions("batch_id", "place").select("batch_id", "idx", "src", "tgt")


def epochs(store: DataFrame, budget: int, seed: int = 0) -> Iterator[list]:
    """Batches one after the other, without an end, in a new order for each epoch; each batch is a list of rows (idx, src, tgt)."""
    epoch = 0
    while True:
        batch: list = []
        for row in load_batches(store, budget, seed, epoch).toLocalIterator():
            if batch and row["batch_id"] != batch[0]["batch_id"]:
                yield batch
                batch = []
            batch.append(row)
        if not batch:
            return
        yield batch
        epoch += 1


def token_stats(rows: DataFrame, text: Column, ids: Column) -> DataFrame:
    """Tokens a sentence (mean, p95) and characters a token; texts are encoded once."""
    return count_stats(rows, F.length(text), F.size(ids))


def count_stats(rows: DataFrame, chars: Column, tokens: Column) -> DataFrame:
    """The same of numbers of characters and tokens."""
    from bitloom.operators.corpus import length_stats

    per = (F.sum("chars") / F.nullif(F.sum(F.col("v") * F.col("c")), F.lit(0))).alias("chars_per_token")
    return length_stats(rows, tokens, sums={"chars": chars}, more=[per]).select("mean", "p95", "chars_per_token")
