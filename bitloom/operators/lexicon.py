"""The lexicon of aligned lines: for each source token the target token of the highest co-occurrence over frequency, without all pairs of tokens."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bitloom.sources.tables import scratch

#: Commonest tokens of a side, which every task has with their counts; rarer ones meet theirs in a join.
MOST_COMMON = 300_000
#: Pairs that a task compares at once.
BLOCK = 1 << 22

SRC, TGT = 0, 1
LINE = "row long, sc array<int>, sr array<string>, tc array<int>, tr array<string>"


#: Setting by which Spark removes the shuffle files of a query when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` as a scratch table: the lineage ends there, and so do the shuffle files that led to it."""
    spark, path = rows.sparkSession, scratch(rows.sparkSession, name)
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        # a new frame, since the setting counts when a frame is made
        rows.select("*").write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(rows.schema).parquet(path)


def beginnings(tokens: pa.Array) -> np.ndarray:
    """The first seven bytes of each token as a number: of two tokens that differ there the smaller has the smaller one."""
    tokens = tokens.combine_chunks() if isinstance(tokens, pa.ChunkedArray) else tokens
    sizes = np.asarray(pc.binary_length(tokens), np.int64)
    letters = np.concatenate([np.frombuffer(b"".join(tokens.cast("large_binary").to_pylist()), np.uint8), np.zeros(8, np.uint8)])
    begins, out = np.cumsum(sizes) - sizes, np.zeros(len(tokens), np.int64)
    for k in range(7):
        out = out << 8 | np.where(k < sizes, letters[np.minimum(begins + k, len(letters) - 1)], 0)
    return out


def lists(line: np.ndarray, values: pa.Array, n: int) -> pa.Array:
    """Values by line, which ascends."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(line, np.arange(n + 1)).astype(np.int32)), values)


def flat(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """The line of each value of an array column, and the values; of a column of texts, their words between spaces."""
    if pa.types.is_string(column.type) or pa.types.is_large_string(column.type):
        column = pc.split_pattern(column, " ")
        line, words = np.asarray(pc.list_parent_indices(column), np.int64), pc.list_flatten(column)
        some = pc.not_equal(words, "")
        return line[np.asarray(some)], words.filter(some)
    return np.asarray(pc.list_parent_indices(column), np.int64), pc.list_flatten(column)


def common(counts: DataFrame, side: int, most: int) -> tuple[pa.Array, np.ndarray]:
    """The commonest tokens, by count and then by token, and their counts."""
    by = counts.where(F.col("side") == side).groupBy("n").agg(F.count("*").alias("k")).orderBy(F.desc("n")).toArrow()
    n, k = by["n"].to_numpy(), np.cumsum(by["k"].to_numpy())
    bound = int(n[np.searchsorted(k, most, side="right")]) if len(k) and k[-1] > most else 0
    rows = counts.where((F.col("side") == side) & (F.col("n") > bound)).select("token", "n").toArrow().sort_by([("n", "ascending"), ("token", "ascending")])
    return rows["token"].combine_chunks().cast("string") if rows.num_rows else pa.array([], "string"), rows["n"].to_numpy()


def split_lines(pairs: DataFrame, src: pa.Array, tgt: pa.Array) -> DataFrame:
    """LINE: of each line's different tokens the places of common ones in ``src`` and ``tgt``, and the others."""
    sent = pairs.sparkSession.sparkContext.broadcast((src, tgt))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [batch["row"]]
            for name, known in zip(("src", "tgt"), sent.value, strict=True):
                line, tokens = flat(batch[name])
                place = pc.index_in(tokens, known)
                rare = np.asarray(place.is_null())
                keys = np.unique(line[~rare] << 32 | np.asarray(place.drop_null(), np.int64))
                made.append(lists(keys >> 32, pa.array((keys & 0xFFFFFFFF).astype(np.int32)), batch.num_rows))
                coded = tokens.filter(pa.array(rare)).dictionary_encode()
                keys = np.unique(line[rare] << 32 | np.asarray(coded.indices, np.int64))
                made.append(lists(keys >> 32, coded.dictionary.take(pa.array(keys & 0xFFFFFFFF)), batch.num_rows))
            yield pa.RecordBatch.from_arrays(made, ["row", "sc", "sr", "tc", "tr"])

    return pairs.select(F.monotonically_increasing_id().alias("row"), "src", "tgt").mapInArrow(run, LINE)


def counted(rows: DataFrame, columns: dict[int, str], once: tuple[int, ...] = ()) -> DataFrame:
    """(side, token, n) of columns of tokens or texts by side; counted in each task first. ``once``: sides of which a line counts a token once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[pa.Table]] = {side: [] for side in columns}

        def summed(side: int) -> pa.Table:
            return pa.concat_tables(held[side]).group_by("token").aggregate([("n", "sum")]).rename_columns(["token", "n"])

        def told(side: int) -> Iterator[pa.RecordBatch]:
            for batch in summed(side).to_batches(max_chunksize=1 << 16) if held[side] else []:
                yield pa.RecordBatch.from_arrays([pa.array(np.full(batch.num_rows, side, np.int32)), *batch.columns], ["side", "token", "n"])

        for batch in batches:
            for side, name in columns.items():
                line, tokens = flat(batch[name])
                if side in once:
                    coded = tokens.dictionary_encode()
                    codes = np.asarray(coded.indices.fill_null(len(coded.dictionary)), np.int64)
                    codes = np.unique(line << 32 | codes) & 0xFFFFFFFF
                    tokens = coded.dictionary.take(pa.array(codes[codes < len(coded.dictionary)]))
                found = pc.value_counts(tokens)
                held[side].append(pa.table({"token": found.field("values").cast("string"), "n": found.field("counts")}))
                if sum(x.num_rows for x in held[side]) > 1 << 20:
                    held[side] = [summed(side)]
                    if held[side][0].num_rows > 1 << 20:
                        yield from told(side)
                        held[side] = []
        for side in columns:
            yield from told(side)

    made = rows.select(*columns.values()).mapInArrow(run, "side int, token string, n long")
    return made.where("token IS NOT NULL").groupBy("side", "token").agg(F.sum("n").alias("n"))


def lexicon(pairs: DataFrame, most: int = MOST_COMMON) -> DataFrame:
    """(src, tgt): for each source token the target token with the highest co-occurrence over frequency.

    ``pairs`` has src and tgt, arrays of tokens or texts with spaces between tokens. Co-occurrence counts lines that have both tokens; the frequency counts
    every occurrence. Of equals the smallest token wins.

    A line's rarest target token t gives each source token s of the line a score of at least 1/freq(t), and no pair has more
    than min(lines with s, freq)/freq. Only pairs that can be as good as the best of these bounds are counted; what
    a bound excludes can't win, so all that is left out are pairs of losers. A bound of ties goes by the tokens' beginnings.
    """
    spark = pairs.sparkSession
    counts = written(counted(pairs, {SRC: "src", TGT: "tgt"}, once=(SRC,)), "counts")
    (s_common, s_lines), (t_common, t_freq) = common(counts, SRC, most), common(counts, TGT, most)
    lines = written(split_lines(pairs, s_common, t_common), "lines")
    tagged = lambda side, c: F.transform(c, lambda x: F.struct(F.lit(side).alias("side"), x.alias("token")))
    rare = lines.select("row", F.explode(F.concat(tagged(SRC, "sr"), tagged(TGT, "tr"))).alias("x")).select("row", "x.*").join(counts, ["side", "token"])
    rare = rare.groupBy("row").agg(F.collect_list(F.struct("side", "token", "n")).alias("rare"))
    of = lambda side: F.filter("rare", lambda x: x["side"] == side)
    weighed = lines.join(rare, "row", "left").select("sc", "tc", of(SRC).alias("sr"), of(TGT).alias("tr"))
    weighed = written(
        weighed.select("sc", "tc", F.col("sr.token").alias("sr"), F.col("sr.n").alias("sn"), F.col("tr.token").alias("tr"), F.col("tr.n").alias("tn")), "weighed"
    )
    sent = spark.sparkContext.broadcast((s_common, s_lines, t_common, t_freq, beginnings(t_common)))

    def targets(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
        """Line, frequency, beginning and place of each target token, the rare ones' places behind the common ones'; arranged by these."""
        _, _, words, freq, first = sent.value
        line, place = flat(batch["tc"])
        place = np.asarray(place, np.int64)
        rare_line, tokens = flat(batch["tr"])
        n = np.asarray(flat(batch["tn"])[1], np.int64)
        found = (np.concatenate([line, rare_line]), np.concatenate([freq[place], n]), np.concatenate([first[place], beginnings(tokens)]),
                 np.concatenate([place, len(words) + np.arange(len(tokens))]))
        order = np.lexsort(found[2::-1])
        return tuple(x[order] for x in found)

    def rarest(line: np.ndarray, n: np.ndarray, first: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Whether a line has a target token; the rarest one's frequency and beginning."""
        at = np.searchsorted(line, np.arange(rows))
        some = at < np.searchsorted(line, np.arange(rows), side="right")
        at = np.minimum(at, max(len(line) - 1, 0))
        return some, n[at] if len(n) else np.zeros(rows, np.int64), first[at] if len(n) else np.zeros(rows, np.int64)

    def bounds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = np.full(len(s_common), np.iinfo(np.int64).max), np.full(len(s_common), np.iinfo(np.int64).max)
        for batch in batches:
            line, n, first, _ = targets(batch)
            some, n, first = rarest(line, n, first, batch.num_rows)
            line, place = flat(batch["sc"])
            place, line = np.asarray(place, np.int64)[some[line]], line[some[line]]
            place, n, first = np.concatenate([place, np.arange(len(best[0]))]), np.concatenate([n[line], best[0]]), np.concatenate([first[line], best[1]])
            order = np.lexsort((first, n, place))
            head = order[np.concatenate([[True], place[order][1:] != place[order][:-1]])] if len(order) else order
            best = n[head], first[head]
        at = np.flatnonzero(best[0] < np.iinfo(np.int64).max)
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (at.astype(np.int32), best[0][at], best[1][at])], ["s", "n", "first"])

    low = weighed.mapInArrow(bounds, "s int, n long, first long").groupBy("s").agg(F.min(F.struct("n", "first")).alias("b")).select("s", "b.n", "b.first").toArrow()
    least, tie = np.ones(len(s_common), np.int64), np.zeros(len(s_common), np.int64)
    least[low["s"].to_numpy()], tie[low["s"].to_numpy()] = low["n"].to_numpy(), low["first"].to_numpy()
    limits = spark.sparkContext.broadcast((least, tie))

    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, s_count, words, _, _ = sent.value
        least, tie = limits.value
        for batch in batches:
            line, n, first, place = targets(batch)
            some, top_n, top_first = rarest(line, n, first, batch.num_rows)
            s_line, common_s = flat(batch["sc"])
            common_s = np.asarray(common_s, np.int64)
            rare_line, rare_s = flat(batch["sr"])
            by = np.concatenate([s_line, rare_line])
            lines_s = np.concatenate([s_count[common_s], np.asarray(flat(batch["sn"])[1], np.int64)])
            least_s, tie_s = np.concatenate([least[common_s], top_n[rare_line]]), np.concatenate([tie[common_s], top_first[rare_line]])
            s_place = np.concatenate([common_s, len(names) + np.arange(len(rare_s))])
            # targets that no source token of the line can have
            most_n, most_least, most_tie = (np.zeros(batch.num_rows, np.int64) for _ in range(3))
            np.maximum.at(most_n, by, lines_s * least_s)
            np.maximum.at(most_least, by, least_s)
            np.maximum.at(most_tie, by, tie_s)
            use = (n <= most_n[line]) & ((most_least[line] > 1) | (first <= most_tie[line]))
            line, n, first, place = line[use], n[use], first[use], place[use]
            begins = np.searchsorted(line, np.arange(batch.num_rows))
            width = (np.searchsorted(line, np.arange(batch.num_rows), side="right") - begins)[by]
            block = np.cumsum(width) // BLOCK
            cuts = [0, *(np.flatnonzero(block[1:] != block[:-1]) + 1).tolist(), len(by)]
            s_names, t_names = pa.chunked_array([names, rare_s.cast("string")]), pa.chunked_array([words, flat(batch["tr"])[1].cast("string")])
            for i, j in zip(cuts, cuts[1:], strict=False):
                w = width[i:j]
                s = np.repeat(np.arange(i, j), w)
                t = np.arange(len(s)) - np.repeat(np.cumsum(w) - w - begins[by[i:j]], w)
                reach = np.minimum(lines_s[s], n[t]) * least_s[s]
                keep = (reach > n[t]) | ((reach == n[t]) & (first[t] <= tie_s[s]))
                s, t = s[keep], t[keep]
                for k in range(0, len(s), 1 << 18):
                    a, b = s[k : k + (1 << 18)], t[k : k + (1 << 18)]
                    made = [s_names.take(pa.array(s_place[a])).combine_chunks(), t_names.take(pa.array(place[b])).combine_chunks(), pa.array(n[b])]
                    yield pa.RecordBatch.from_arrays(made, ["src", "tgt", "freq"])

    kept = weighed.mapInArrow(candidates, "src string, tgt string, freq long").groupBy("src", "tgt").agg((F.count("*") / F.first("freq")).alias("score"))
    best = kept.groupBy("src").agg(F.min(F.struct((-F.col("score")).alias("s"), F.col("tgt").alias("t"))).alias("b"))
    return best.select("src", F.col("b.t").alias("tgt"))


def translate_by_lexicon(sentences: DataFrame, lex: DataFrame, most: int = MOST_COMMON) -> DataFrame:
    """(id, hyp): known tokens replaced in order; a token equal to the one before it is left out.

    Ids are different; src is an array of tokens or a text with spaces between them. What the commonest tokens become is sent to every task; rarer ones meet their translations in a join.
    """
    spark = sentences.sparkSession
    lex = written(lex.select("src", "tgt"), "lexicon")
    known, _ = common(written(counted(sentences, {SRC: "src"}), "counts"), SRC, most)
    asked = spark.createDataFrame(pa.table({"src": known, "place": pa.array(np.arange(len(known)))}))
    # at most ``most`` rows
    told = lex.join(F.broadcast(asked), "src").select("place", "tgt").toArrow()
    means = np.full(len(known), -1, np.int64)
    means[told["place"].to_numpy()] = np.arange(told.num_rows)
    sent = spark.sparkContext.broadcast((known, means, told["tgt"].combine_chunks().cast("string") if told.num_rows else pa.array([], "string")))

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = sent.value[0]
        for batch in batches:
            line, tokens = flat(batch["src"])
            place = pc.index_in(tokens, words)
            rare = np.asarray(place.is_null())
            others = tokens.filter(pa.array(rare)).cast("string")
            # a rare token counts down from -1 within its line
            rare_line = line[rare]
            codes = np.asarray(pc.fill_null(place, 0), np.int64)
            codes[rare] = -1 - (np.arange(len(rare_line)) - np.searchsorted(rare_line, rare_line))
            made = [batch["row"], batch["id"], lists(line, pa.array(codes.astype(np.int32)), batch.num_rows), lists(rare_line, others, batch.num_rows)]
            yield pa.RecordBatch.from_arrays(made, ["row", "id", "codes", "rare"])

    kind = sentences.select("id").schema[0].dataType.simpleString()
    schema = f"row long, id {kind}, codes array<int>, rare array<string>"
    lines = written(sentences.select(F.monotonically_increasing_id().alias("row"), "id", "src").mapInArrow(coded, schema), "sentences")
    rare = lines.select("row", F.posexplode("rare").alias("k", "src")).join(lex, "src").groupBy("row").agg(F.collect_list(F.struct("k", "tgt")).alias("r"))
    met = lines.join(rare, "row", "left").select("id", "codes", F.col("r.k").alias("k"), F.col("r.tgt").alias("tgt"))

    def said(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, means, targets = sent.value
        for batch in batches:
            line, codes = flat(batch["codes"])
            codes = np.asarray(codes, np.int64)
            rare_line, own = flat(batch["tgt"])
            keys, asked = rare_line << 32 | np.asarray(flat(batch["k"])[1], np.int64), line << 32 | (-1 - codes)
            order = np.argsort(keys)
            at = np.minimum(np.searchsorted(keys[order], asked), max(len(keys) - 1, 0))
            rare_at = np.where(keys[order][at] == asked, len(targets) + order[at], -1) if len(keys) else np.full(len(codes), -1)
            place = np.where(codes >= 0, means[np.maximum(codes, 0)] if len(means) else -1, rare_at)
            line, place = line[place >= 0], place[place >= 0]
            tokens = pa.chunked_array([targets, own.cast("string")]).take(pa.array(place)).combine_chunks()
            same = np.asarray(tokens.dictionary_encode().indices, np.int64)
            new = np.concatenate([[True], (same[1:] != same[:-1]) | (line[1:] != line[:-1])])[: len(line)]
            texts = pc.binary_join(lists(line[new], tokens.filter(pa.array(new)), batch.num_rows), " ")
            yield pa.RecordBatch.from_arrays([batch["id"], texts], ["id", "hyp"])

    return met.mapInArrow(said, f"id {kind}, hyp string")
