"""SimHash near-duplicates with bit-sliced comparison.

Fingerprints are compared only within buckets that agree on some of their bits, in tables so
chosen that no pair within the radius is missed (``block_masks``) or that nearly none is
(``random_masks``). In a bucket 64 fingerprints make a block, held vertically: word b of a block
has bit b of all 64. The distances of a query to a whole block are counted at once by carry-save
adders on such words, and a block is abandoned as soon as all its 64 distances exceed the radius.

A bucket gives the links of its components' members to one of them, never all its pairs. Buckets
beyond BUCKET_MAX are dealt out as pairs of tiles, so every pair is still compared but no task
holds the bucket. Keys grow with the logarithm of the rows (``blocks_for``, ``tables_for``), so that
unrelated fingerprints don't fill the buckets; what is found doesn't depend on that.

The pipeline's near duplicates take such components as candidates only: the sets of shingles of a
component's members meet, and pairs of at least the required Jaccard similarity are linked anew.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bitloom.llm.common import arrow_map, cut, slices
from bitloom.llm.graph import components

SEED, SHINGLE, RADIUS, BLOCKS = 42, 4, 4, 6
#: Fingerprints of a bucket that one task compares with each other; larger buckets are tiled.
BUCKET_MAX = 8192
#: Unrelated fingerprints that a bucket may hold on average, as a power of two: keys have the bits for that.
BUCKET_BITS = 8
#: Fingerprints that are compared in one go, and pairs of a query and a block.
CHUNK, PAIRS = 1 << 16, 1 << 17


def shingle_hashes(text: str | None, size: int, seed: int) -> np.ndarray:
    """XXH64 of every word shingle, repeats included, as rows of eight bytes, high byte first."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros((0, 8), np.uint8)
    joined = b" ".join(words)
    digest = xxhash.xxh64_digest
    if len(words) <= size:
        return np.frombuffer(digest(joined, seed), np.uint8).reshape(1, 8)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    pairs = zip(starts[: len(words) - size + 1].tolist(), ends[size - 1 :].tolist(), strict=True)
    return np.frombuffer(b"".join([digest(joined[a:b], seed) for a, b in pairs]), np.uint8).reshape(-1, 8)


def majority(hashes: np.ndarray) -> int:
    """The 64 bits that are set in over half of the hashes; none: zero. As a signed number."""
    n = len(hashes)
    if not n:
        return 0
    set_bits = np.zeros(64, np.int64)
    for a in range(0, n, 255 * 256):  # sums of 255 rows fit into a byte
        part = np.unpackbits(hashes[a : a + 255 * 256], axis=1)
        whole = len(part) // 255 * 255
        set_bits += part[:whole].reshape(-1, 255, 64).sum(1, dtype=np.uint8).sum(0, dtype=np.int64)
        set_bits += part[whole:].sum(0, dtype=np.int64)
    return int(np.packbits(2 * set_bits > n).view(">i8")[0])


def fingerprints(docs: DataFrame, size: int = SHINGLE, seeds: tuple[int, ...] = (SEED,)) -> DataFrame:
    """doc_id and fp (one 64-bit number for each seed) of every whole text; null is empty, no words: zeros."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column("text")):
                part = batch.slice(a, b - a)
                found = [[majority(shingle_hashes(t, size, s)) for s in seeds] for t in part.column("text").to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(found, pa.list_(pa.int64()))], ["doc_id", "fp"])

    return arrow_map(docs.select("doc_id", "text"), run, "doc_id long, fp array<long>")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def block_masks(radius: int = RADIUS, blocks: int = BLOCKS) -> list[list[int]]:
    """Masks of 64 bits: any two numbers within the radius agree under at least one of them.

    The bits are cut into blocks; ``radius`` differing bits leave at least blocks - radius of them equal.
    """
    cuts = [64 * k // blocks for k in range(blocks + 1)]
    ones = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(cuts, cuts[1:], strict=False)]
    return [[_signed(sum(chosen))] for chosen in combinations(ones, blocks - radius)]


def blocks_for(rows: int, radius: int = RADIUS) -> int:
    """The least number of blocks (BLOCKS or more) whose shortest keys have bits enough for ``rows`` fingerprints.

    Any number is exact. 20 bits in 15 tables do below 2^28 rows, 27 in 35 below 2^35, 32 in 70 below 2^40.
    """
    blocks = max(BLOCKS, radius + 1)
    while blocks < 64 and (blocks - radius) * (64 // blocks) < rows.bit_length() - BUCKET_BITS:
        blocks += 1
    return blocks


def random_masks(tables: int, bits: int, words: int, seed: int = 5) -> list[list[int]]:
    """``tables`` masks of ``bits`` of the 64 * words bits each, drawn from a fixed seed."""
    rng = np.random.default_rng(seed)
    masks = []
    for _ in range(tables):
        mask = [0] * words
        for at in rng.choice(64 * words, bits, replace=False).tolist():
            mask[at // 64] |= 1 << (at % 64)
        masks.append([_signed(m) for m in mask])
    return masks


def _planes(values: np.ndarray, block: np.ndarray, lane: np.ndarray, blocks: int) -> np.ndarray:
    """Bit planes of fingerprints (rows, words) sorted by block: [bit, block] holds that bit of the block's 64."""
    starts = np.searchsorted(block, np.arange(blocks))
    planes = np.empty((64 * values.shape[1], blocks), np.uint64)
    for w in range(values.shape[1]):
        column = values[:, w]
        for b in range(64):
            planes[64 * w + b] = np.bitwise_or.reduceat((column >> np.uint64(b) & np.uint64(1)) << lane, starts)
    return planes


def within_radius(planes: np.ndarray, queries: np.ndarray, query: np.ndarray, block: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """For pairs (query row, block): which pairs have near lanes, and the lanes as bits of a word.

    Planes are added three at a time: a full adder makes one sum and one carry, the sum and each
    carry ripple on through the counters. A counter that overflows has exceeded any radius.
    """
    depth = max(2, int(radius).bit_length())
    alive = np.arange(len(query))
    counters = [np.zeros(len(query), np.uint64) for _ in range(depth)]
    over = np.zeros(len(query), np.uint64)

    def add(word: np.ndarray, level: int) -> None:
        nonlocal over
        for k in range(level, depth):
            counters[k], word = counters[k] ^ word, counters[k] & word
        over = over | word

    def exceeded() -> np.ndarray:
        """Lanes whose count is above the radius."""
        above, equal = over.copy(), ~over
        for k in reversed(range(depth)):
            if radius >> k & 1:
                equal &= counters[k]
            else:
                above |= equal & counters[k]
                equal &= ~counters[k]
        return above

    q, blk = queries[query], block
    bits = len(planes)
    for at in range(0, bits, 3):
        x = []
        for b in range(at, min(at + 3, bits)):
            flip = np.uint64(0) - (q[:, b // 64] >> np.uint64(b % 64) & np.uint64(1))
            x.append(planes[b][blk] ^ flip)
        if len(x) == 3:
            half = x[0] ^ x[1]
            add((x[0] & x[1]) | (half & x[2]), 1)
            add(half ^ x[2], 0)
        else:
            for word in x:
                add(word, 0)
        if at % 12 == 9:
            near = ~exceeded()
            keep = np.flatnonzero(near)
            if len(keep) < len(near):
                alive, q, blk, over = alive[keep], q[keep], blk[keep], over[keep]
                counters = [c[keep] for c in counters]
            if not len(alive):
                break
    near = ~exceeded() if len(alive) else np.zeros(0, np.uint64)
    found = np.flatnonzero(near)
    return alive[found], near[found]


def _lowest(label: np.ndarray, u: np.ndarray, v: np.ndarray) -> None:
    """Merge the components of linked rows; a label is the lowest row of its component."""
    while True:
        a, b = label[u], label[v]
        apart = a != b
        if not apart.any():
            return
        u, v, a, b = u[apart], v[apart], a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while True:
            further = label[label]
            if (further == label).all():
                break
            label[:] = further


def link_rows(bucket: np.ndarray, side: np.ndarray, values: np.ndarray, radius: int) -> np.ndarray:
    """Component labels (row numbers) of rows sorted by bucket and side.

    Rows of a bucket with sides 0 and 1 are compared across only, others all with all.
    """
    n = len(bucket)
    label = np.arange(n)
    first = np.concatenate([[True], (bucket[1:] != bucket[:-1]) | (side[1:] != side[:-1])])
    group = np.cumsum(first) - 1  # rows of one bucket and side
    start = np.flatnonzero(first)
    size = np.diff(np.append(start, n))
    blocks_of = (size + 63) // 64
    base = np.cumsum(blocks_of) - blocks_of
    place = np.arange(n) - start[group]
    block, lane = base[group] + place // 64, (place % 64).astype(np.uint64)
    total = int(blocks_of.sum())
    planes = _planes(values, block, lane, total)
    filled = np.bincount(block, minlength=total).astype(np.uint64)
    valid = np.where(filled == 64, ~np.uint64(0), (np.uint64(1) << np.minimum(filled, np.uint64(63))) - np.uint64(1))
    block_start = start[np.repeat(np.arange(len(start)), blocks_of)] + 64 * (np.arange(total) - np.repeat(base, blocks_of))
    # which blocks each row meets: those of its own side from its own block on, or all of the other side
    crossed = np.zeros(len(start), bool)
    crossed[:-1] = (bucket[start[1:]] == bucket[start[:-1]]) & (side[start[:-1]] == 0) & (side[start[1:]] == 1)
    is_side = side[start] < 2
    lo = np.where(crossed[group], (base + blocks_of)[group], block)
    hi = np.where(crossed[group], np.append(base[1:] + blocks_of[1:], 0)[group], np.where(is_side[group], block, (base + blocks_of)[group]))
    alone = (size[group] == 1) & ~crossed[group]
    meets = np.where(alone, 0, hi - lo)
    ends = np.cumsum(meets)
    at = 0
    while at < n:
        until = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS, "right")))
        rows = np.arange(at, until)
        query = np.repeat(rows, meets[rows])
        if len(query):
            offset = np.arange(len(query)) - np.repeat(np.cumsum(meets[rows]) - meets[rows], meets[rows])
            pair, near = within_radius(planes, values, query, lo[query] + offset, radius)
            near = near & valid[(lo[query] + offset)[pair]]
            u, v = [], []
            for b in range(64):
                hit = np.flatnonzero(near >> np.uint64(b) & np.uint64(1))
                u.append(query[pair[hit]])
                v.append(block_start[(lo[query] + offset)[pair[hit]]] + b)
            _lowest(label, np.concatenate(u), np.concatenate(v))
        at = until
    return label


def _links(radius: int, words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Batches sorted by _bucket and _side to the links of each bucket; a bucket is never cut."""
        held: pa.Table | None = None

        def links(part: pa.Table) -> Iterator[pa.RecordBatch]:
            bucket = part["_bucket"].to_numpy()
            changes = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]]))
            sizes = np.diff(np.append(changes, len(bucket)))
            several = np.repeat(sizes > 1, sizes)
            part = part.filter(pa.array(several))
            if not len(part):
                return
            side = part["_side"].to_numpy()
            values = np.column_stack([part[f"f{w}"].to_numpy() for w in range(words)]).view(np.uint64)
            label = link_rows(part["_bucket"].to_numpy(), side, np.ascontiguousarray(values), radius)
            # one link for each known component that is new to the bucket's component
            group, root = part["group"].to_numpy(), np.arange(len(label))
            linked = np.flatnonzero((label != root) & (group != group[label]))
            if len(linked):
                links = np.unique(np.column_stack([label[linked], group[linked]]), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(group[links[:, 0]]), pa.array(links[:, 1])], ["u", "v"])

        waiting: list[pa.Table] = []
        size = 0
        for batch in batches:
            waiting.append(pa.Table.from_batches([batch]))
            size += batch.num_rows
            if size < CHUNK:
                continue
            part = pa.concat_tables([held, *waiting] if held is not None else waiting)
            bucket = part["_bucket"].to_numpy()
            end = int(np.searchsorted(bucket, bucket[-1]))  # the last bucket may go on
            if end:
                yield from links(part.slice(0, end))
            held, waiting, size = part.slice(end), [], 0
        if held is not None or waiting:
            part = pa.concat_tables([held, *waiting] if held is not None else waiting)
            if len(part):
                yield from links(part)

    return run


def link(nodes: DataFrame, masks: list[list[int]], radius: int) -> DataFrame:
    """Links (u, v) between groups of fingerprints: ``nodes`` has node (a number), group and f0, f1 ... with distinct values.

    Within each bucket the links span the components of near fingerprints; fingerprints of one group
    count as linked already. Links grow with the fingerprints, not with their pairs.
    """
    words = len(masks[0])
    names = [f"f{w}" for w in range(words)]
    keys = [
        F.xxhash64(F.lit(t), *[F.col(f).bitwiseAND(F.lit(m)) for f, m in zip(names, mask, strict=True)]) for t, mask in enumerate(masks)
    ]
    dealt = nodes.select("node", "group", *names, F.explode(F.array(*keys)).alias("_key"))
    # a key is a hash of what a table's fingerprints agree on: an accidental clash only adds comparisons
    hot = dealt.groupBy("_key").agg(F.count("*").alias("_n")).where(F.col("_n") > BUCKET_MAX)
    tiles = F.ceil(F.col("_n") / BUCKET_MAX).cast("int")
    sized = dealt.join(hot, "_key", "left").withColumn("_tiles", F.coalesce(tiles, F.lit(1)))
    mine = F.pmod(F.xxhash64(F.lit(3), "node"), F.col("_tiles")).cast("int")
    tiled = sized.withColumn("_t", mine).withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_tiles") - 1)))
    low, high = F.least("_t", "_o"), F.greatest("_t", "_o")
    placed = tiled.select(
        "group", *names,
        F.when(F.col("_tiles") == 1, F.col("_key")).otherwise(F.xxhash64("_key", low, high)).alias("_bucket"),
        F.when(low == high, F.lit(2)).when(F.col("_t") == low, F.lit(0)).otherwise(F.lit(1)).alias("_side"),
    )
    # by group too, so that a component's links in all tables lead to the same smallest group where they can
    arranged = placed.repartition("_bucket").sortWithinPartitions("_bucket", "_side", "group")
    return arrow_map(arranged, _links(radius, words), "u long, v long")


def classes(prints: DataFrame, masks: list[list[int]], radius: int, first: int | None = None) -> DataFrame:
    """All columns and component (a number) of every row of ``prints`` (doc_id, fp array<long> and more).

    Equal fingerprints are one node, however many documents have them. With ``first`` so many tables
    are searched before the others: a group of near copies is one group then, and the other tables
    add a link only where it meets another, not one for each member and table.
    """
    words = len(masks[0])
    flat = prints.select(*prints.columns, *[F.col("fp")[w].alias(f"f{w}") for w in range(words)])
    names = [f"f{w}" for w in range(words)]
    node = F.col("f0") if words == 1 else F.xxhash64(*names)
    nodes = flat.select(node.alias("node"), *names).distinct().withColumn("group", F.col("node"))
    found = components(link(nodes, masks[:first], radius))
    if first is not None:
        known = found.withColumnRenamed("root", "group")
        grouped = cut(nodes.drop("group").join(known, "node", "left").withColumn("group", F.coalesce("group", "node")), "groups")
        merged = components(link(grouped, masks[first:], radius)).withColumnRenamed("node", "group")
        found = grouped.join(merged, "group", "left").select("node", F.coalesce("root", "group").alias("root"))
    return (
        flat.withColumn("_node", node)
        .join(found.withColumnRenamed("node", "_node"), "_node", "left")
        .select(*prints.columns, F.coalesce("root", "_node").alias("component"))
    )


def query(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint, component_id of every document, by four-word shingles and at most four differing bits.

    Null texts and texts without words have fingerprint zero and are linked like any other. Null
    ids stay rows of their own; they count for no component's smallest id.
    """
    prints = cut(fingerprints(docs), "simhash")
    found = cut(classes(prints, block_masks(RADIUS, blocks_for(prints.count())), RADIUS), "classes")
    # written first: Spark splits a skewed join only if its sides come straight from shuffles
    smallest = cut(found.groupBy("component").agg(F.min("doc_id").alias("component_id")), "smallest")
    digits = F.lower(F.lpad(F.hex(F.col("fp")[0]), 16, "0"))
    return found.join(smallest, "component").select("doc_id", digits.alias("fingerprint"), "component_id")


#: The pipeline's near duplicates: distinct five-word shingles, 128 bits for candidates. At a Jaccard similarity of 0.8
#: two fingerprints differ in 19.5 of 128 bits on average (the angle's share), at 0.9 in 13.3; unrelated ones in 64.
#: STAGE_BITS in STAGE_TABLES are the least; ``tables_for`` has more for more rows.
STAGE_SHINGLE, STAGE_SEEDS, STAGE_RADIUS = 5, (42, 43), 31
STAGE_TABLES, STAGE_BITS, STAGE_FIRST = 96, 16, 12
#: The least Jaccard similarity of near duplicates, as a fraction.
STAGE_LEAST = (4, 5)
#: Sets of a component that one task compares with each other, and their shingles; larger components are tiled.
SETS_MAX, SHINGLES_MAX = 4096, 1 << 22

PRINTS = "doc_id long, fp array<long>, row long, node long, size long"
MEMBERS = "node long, hashes binary, _bucket long, _side int"


def shingle_set(text: str | None, size: int, seed: int) -> np.ndarray:
    """The distinct hashes of a text's shingles, sorted."""
    return np.unique(shingle_hashes(text, size, seed).view(">u8").ravel().astype(np.uint64))


def set_fingerprints(docs: DataFrame, size: int, seeds: tuple[int, ...]) -> DataFrame:
    """PRINTS of every row of ``docs`` (doc_id, text, row): fingerprints of distinct shingles; node is a hash of their set, size their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column("text")):
                part = batch.slice(a, b - a)
                fps, nodes, sizes = [], [], []
                for t in part.column("text").to_pylist():
                    sets = [shingle_set(t, size, s) for s in seeds]
                    fps.append([majority(x.astype(">u8").view(np.uint8).reshape(-1, 8)) for x in sets])
                    nodes.append(_signed(xxhash.xxh3_64_intdigest(sets[0].tobytes())))
                    sizes.append(len(sets[0]))
                columns = [part.column("doc_id"), pa.array(fps, pa.list_(pa.int64())), part.column("row"), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "fp", "row", "node", "size"])

    return arrow_map(docs.select("doc_id", "text", "row"), run, PRINTS)


def similar_sets(sets: list[np.ndarray], side: list[int], least: tuple[int, int]) -> np.ndarray:
    """Component labels (places in the list) of sets that are linked by a Jaccard similarity of at least ``least``.

    Sets of sides 0 and 1 are compared across only, others all with all. Two sets so similar share
    one of their rarest shingles, so many that the rest is too small; all pairs that do are counted
    out, but for those in one component already.
    """
    p, q = least
    label = np.arange(len(sets))
    size = np.array([len(x) for x in sets], np.int64)
    if not size.sum():
        return label
    _, ids, often = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.empty(len(often), np.int64)
    rank[np.argsort(often, kind="stable")] = np.arange(len(often))
    begin = np.cumsum(size) - size
    flat = rank[ids.ravel()]
    tokens = [np.sort(flat[a : a + n]) for a, n in zip(begin.tolist(), size.tolist(), strict=True)]
    sides = np.array(side)
    index: dict[int, list[int]] = {}
    marked = np.zeros(len(often), bool)
    for i in np.argsort(size, kind="stable").tolist():
        n = int(size[i])
        if not n:
            continue
        prefix = tokens[i][: n + 1 + -p * n // q].tolist()  # all but the least overlap, and one
        met = [index[t] for t in prefix if t in index]
        near = np.unique(np.concatenate([np.array(m) for m in met])) if met else np.zeros(0, np.int64)
        near = near[(q * size[near] >= p * n) & ((sides[near] != side[i]) | (side[i] == 2))]
        marked[tokens[i]] = True
        step = 16
        while len(near := near[label[near] != label[i]]):
            some, near = near[:step], near[step:]
            cuts = np.cumsum(size[some]) - size[some]
            both = np.add.reduceat(marked[np.concatenate([tokens[j] for j in some.tolist()])].astype(np.int64), cuts)
            for j in some[q * both >= p * (n + size[some] - both)].tolist():
                a, b = sorted((int(label[i]), int(label[j])))
                if a != b:
                    label[label == b] = a
            step = min(2 * step, 512)
        marked[tokens[i]] = False
        for t in prefix:
            index.setdefault(t, []).append(i)
    return label


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """MEMBERS sorted by bucket and node to the links (u, v) of similar sets; a bucket is never cut."""

    def links(held: dict[int, tuple[np.ndarray, int]]) -> Iterator[pa.RecordBatch]:
        if len(held) > 1:
            nodes = np.array(list(held), np.int64)
            label = similar_sets([x for x, _ in held.values()], [s for _, s in held.values()], STAGE_LEAST)
            linked = np.flatnonzero(label != np.arange(len(label)))
            if len(linked):
                yield pa.RecordBatch.from_arrays([pa.array(nodes[label[linked]]), pa.array(nodes[linked])], ["u", "v"])

    bucket, held = None, {}
    for batch in batches:
        for node, raw, at, side in zip(*(batch.column(n) for n in ("node", "hashes", "_bucket", "_side")), strict=True):
            if at.as_py() != bucket:
                yield from links(held)
                bucket, held = at.as_py(), {}
            held[node.as_py()] = (np.frombuffer(raw.as_py(), np.uint64), side.as_py())
    yield from links(held)


def similar(texts: DataFrame, found: DataFrame) -> DataFrame:
    """Links (u, v) from the smallest node of each group of similar ones to the others; ``texts`` (row, text) has the rows of ``found``.

    Each different set of shingles is made once from one of its texts. Within a component all sets are
    compared, not only those that met in a table. Only where a component is tiled its links are put
    together by label rounds.
    """
    kinds = cut(found.groupBy("component", "node").agg(F.min("row").alias("row"), F.max("size").alias("size")), "sets")
    groups = kinds.groupBy("component").agg(F.count("*").alias("_n"), F.sum("size").alias("_size")).where("_n > 1")
    tiles = F.greatest(F.ceil(F.col("_n") / SETS_MAX), F.ceil(F.col("_size") / SHINGLES_MAX)).cast("int")
    groups = cut(groups.select("component", tiles.alias("_tiles")), "groups")
    wanted = cut(kinds.join(groups, "component").select("row", "node", "component", "_tiles"), "wanted")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in slices(batch.column("text")):
                part = batch.slice(a, b - a)
                sets = pa.array([shingle_set(t, STAGE_SHINGLE, STAGE_SEEDS[0]).tobytes() for t in part.column("text").to_pylist()], pa.binary())
                names = ["node", "component", "_tiles"]
                yield pa.RecordBatch.from_arrays([*(part.column(n) for n in names), sets], [*names, "hashes"])

    sets = arrow_map(texts.join(wanted, "row").select("text", "node", "component", "_tiles"), run, "node long, component long, _tiles int, hashes binary")
    mine = F.pmod(F.xxhash64(F.lit(3), "node"), F.col("_tiles")).cast("int")
    tiled = sets.withColumn("_t", mine).withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_tiles") - 1)))
    low, high = F.least("_t", "_o"), F.greatest("_t", "_o")
    placed = tiled.select(
        "node", "hashes", F.xxhash64("component", low, high).alias("_bucket"),
        F.when(low == high, F.lit(2)).when(F.col("_t") == low, F.lit(0)).otherwise(F.lit(1)).alias("_side"),
    )
    arranged = placed.repartition("_bucket").sortWithinPartitions("_bucket", "node")
    links = arrow_map(arranged, _verified, "u long, v long")
    if not groups.where("_tiles > 1").limit(1).count():
        return links
    return components(links).select(F.col("root").alias("u"), F.col("node").alias("v"))


def row_key() -> Column:
    """A number for each different pair of id and text."""
    return F.xxhash64("doc_id", "text").alias("row")


def tables_for(rows: int) -> tuple[int, int]:
    """Tables and bits of their random keys for ``rows`` fingerprints; a pair is found as surely as with the least.

    A key of ``bits`` of 128 bits is equal with probability (1 - 19.5 / 128) ** bits at the least
    similarity. The bits grow with the logarithm of the rows, the tables as these probabilities fall:
    about as the fourth root of the rows, where tiles of full buckets would grow as the rows.
    """
    bits = max(STAGE_BITS, rows.bit_length() - BUCKET_BITS)
    agree = 1 - 19.5 / (64 * len(STAGE_SEEDS))
    return math.ceil(STAGE_TABLES * math.log1p(-(agree**STAGE_BITS)) / math.log1p(-(agree**bits))), bits


def near_duplicates(docs: DataFrame) -> DataFrame:
    """row (see ``row_key``) and _keep of each different row: of each group of near duplicates the one with the smallest id is kept.

    Near fingerprints are candidates; a group is linked by Jaccard similarities of at least STAGE_LEAST
    of the distinct shingles. Texts without words are copies of each other. Rows of one id with
    different texts are different documents, rows without an id come last in their group; rows equal in
    id and text are one row here. An empty table gives an empty one.
    """
    texts = docs.select("doc_id", "text", row_key())
    prints = cut(set_fingerprints(texts, STAGE_SHINGLE, STAGE_SEEDS), "simhash")
    tables, bits = tables_for(prints.count())
    masks = random_masks(tables, bits, len(STAGE_SEEDS))
    loose = cut(classes(prints, masks, STAGE_RADIUS, STAGE_FIRST * tables // STAGE_TABLES).drop("fp"), "classes")
    roots = similar(texts.select("row", "text"), loose).select(F.col("u").alias("root"), F.col("v").alias("node"))
    found = cut(loose.join(roots, "node", "left").select("doc_id", "row", F.coalesce("root", "node").alias("component")), "similar")
    order = F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "row")
    smallest = cut(found.groupBy("component").agg(F.min(order).alias("_first")), "smallest")
    return found.join(smallest, "component").groupBy("row").agg(F.max(F.col("row") == F.col("_first.row")).alias("_keep"))
