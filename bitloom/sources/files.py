"""Sources and sinks of sentence pairs: parallel line files, tab-separated files, crawl lines, JSON lines, binary stores."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bitloom.functions import text as tx

PAIR = "ja string, en string"


def lines(spark: SparkSession, path: str) -> DataFrame:
    """(line_no, value) of text files, in the order of their paths and lines; broken UTF-8 becomes U+FFFD.

    Files are read in blocks. A line's number is its place in its block and the lines of all blocks
    before, by path and offset, so that no task reads a whole file. Only counts of blocks are ordered
    in one place.
    """
    block = [F.col("_metadata.file_path").alias("_f"), F.col("_metadata.file_block_start").alias("_b")]
    raw = spark.read.text(path).select("value", *block, F.monotonically_increasing_id().alias("_m"))
    counts = raw.groupBy("_f", "_b").agg(F.count("*").alias("_n"), F.min("_m").alias("_first"))
    before = Window.partitionBy(F.lit(0)).orderBy("_f", "_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_f", "_b", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"))
    return raw.join(starts, ["_f", "_b"]).select((F.col("_shift") + F.col("_m")).alias("line_no"), "value")


def list_files(spark: SparkSession, root: str) -> list[str]:
    """Paths of all files below a folder, in any file system that Spark reads."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(conf)
    if not fs.exists(path):
        return []
    found, out = fs.listFiles(path, True), []
    while found.hasNext():
        out.append(found.next().getPath().toString())
    return out


def once(spark: SparkSession, marker: str, make: Callable[[], None]) -> bool:
    """Run ``make`` (a download, an extraction) unless ``marker`` is there, and leave the marker when it is done; whether it ran."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(marker)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if fs.exists(path):
        return False
    make()
    fs.create(path, True).close()
    return True


def locate_bitext(paths: list[str]) -> str | None:
    """The extracted file among ``paths``: the first *.txt by path, else the first whose name begins with en-ja; archives (.gz) are none."""
    name = lambda p: p.rsplit("/", 1)[-1]
    texts, others = sorted(p for p in paths if name(p).endswith(".txt")), sorted(p for p in paths if name(p).startswith("en-ja"))
    return next((p for p in texts + others if not name(p).endswith(".gz")), None)


def parallel(spark: SparkSession, ja_path: str, en_path: str) -> DataFrame:
    """(line_no, ja, en) of two files line by line, up to the end of the shorter."""
    ja, en = lines(spark, ja_path).withColumnRenamed("value", "ja"), lines(spark, en_path).withColumnRenamed("value", "en")
    return ja.join(en, "line_no").select("line_no", "ja", "en")


def parallel_splits(spark: SparkSession, root: str, prefix: str, splits: tuple[str, ...] = ("train", "tune")) -> DataFrame:
    """Several splits ``root/prefix-split.ja|en`` one after the other; test data stays out by default."""
    found = None
    for k, split in enumerate(splits):
        one = parallel(spark, f"{root}/{prefix}-{split}.ja", f"{root}/{prefix}-{split}.en").withColumn("split_ord", F.lit(k))
        found = one if found is None else found.unionByName(one)
    return found


def tab_pairs(rows: DataFrame, value: str = "value", keep: tuple[str, ...] = ()) -> DataFrame:
    """ja, en, attribution of lines ``en TAB ja [TAB attribution]``; lines without both sides go. Quotes are text like any other."""
    parts = F.split(value, "\t")
    second, third = F.try_element_at(parts, F.lit(2)), F.try_element_at(parts, F.lit(3))
    out = rows.select(*keep, second.alias("ja"), parts[0].alias("en"), F.coalesce(third, F.lit("")).alias("attribution"))
    return out.where("ja IS NOT NULL AND ja <> '' AND en <> ''")


def crawl_pairs(rows: DataFrame, floor: float | None = 0.5, value: str = "value", keep: tuple[str, ...] = ()) -> DataFrame:
    """ja, en of crawl lines whose columns are told apart by their content."""
    return rows.select(*keep, tx.crawl_pair(F.col(value), floor).alias("p")).where("p IS NOT NULL").select(*keep, "p.ja", "p.en")


def read_pairs(spark: SparkSession, path: str, schema: str = PAIR) -> DataFrame:
    """JSON lines of pairs, with their schema given, so that nothing is scanned to guess it."""
    return spark.read.schema(schema).json(path)


def write_pairs(pairs: DataFrame, path: str) -> int:
    """Write JSON lines; the number of rows comes with the same pass."""
    from pyspark.sql import Observation

    seen = Observation("written")
    pairs.observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").json(path)
    return seen.get["n"]


def write_texts(pairs: DataFrame, path: str) -> None:
    """pairs.tsv, en.txt and ja.txt as folders of text files."""
    for name, value in (("pairs.tsv", F.concat_ws("\t", "en", "ja")), ("en.txt", F.col("en")), ("ja.txt", F.col("ja"))):
        pairs.select(value.alias("value")).write.mode("overwrite").text(f"{path}/{name}")


def head_lines(rows: DataFrame, n: int) -> DataFrame:
    """The first n physical lines, and of these those that aren't blank."""
    return rows.where((F.col("line_no") < n) & (tx.strip(F.col("value")) != ""))


SOURCES: dict[str, Callable[..., DataFrame]] = {}


def source(name: str) -> Callable[[Callable[..., DataFrame]], Callable[..., DataFrame]]:
    """Register a source under a name: a function (spark, root, **options) -> (line_no, ja, en)."""

    def add(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        SOURCES[name] = f
        return f

    return add


@source("parallel")
def _parallel(spark: SparkSession, root: str, ja: str = "pairs.ja", en: str = "pairs.en") -> DataFrame:
    return parallel(spark, f"{root}/{ja}", f"{root}/{en}")


@source("splits")
def _splits(spark: SparkSession, root: str, prefix: str = "data", splits: tuple[str, ...] = ("train", "tune")) -> DataFrame:
    return parallel_splits(spark, root, prefix, splits)


@source("tabs")
def _tabs(spark: SparkSession, root: str, name: str = "pairs.tsv") -> DataFrame:
    return tab_pairs(lines(spark, f"{root}/{name}"), keep=("line_no",))


@source("crawl")
def _crawl(spark: SparkSession, root: str, name: str | None = None, floor: float | None = 0.5) -> DataFrame:
    path = f"{root}/{name}" if name else locate_bitext(list_files(spark, root))
    if path is None:
        raise ValueError(f"no bitext below {root!r}")
    return crawl_pairs(lines(spark, path), floor, keep=("line_no",))


def union_sources(spark: SparkSession, config: list[dict], only: set[str] | None = None, most: int | None = None) -> DataFrame:
    """source, source_ord, line_no, ja_raw, en_raw of all configured sources in order; ``most`` first lines of each.

    A config entry has name, kind, root and further options of the kind; an unknown kind is an error.
    """
    found = None
    for k, entry in enumerate(config):
        options = {x: v for x, v in entry.items() if x not in ("name", "kind", "root")}
        if only and entry["name"] not in only:
            continue
        if entry["kind"] not in SOURCES:
            raise ValueError(f"unknown source kind {entry['kind']!r}")
        one = SOURCES[entry["kind"]](spark, entry["root"], **options)
        one = first_of_source(one.withColumn("source", F.lit(entry["name"])), most) if most is not None else one
        one = one.select(F.lit(entry["name"]).alias("source"), F.lit(k).alias("source_ord"), "line_no", F.col("ja").alias("ja_raw"), F.col("en").alias("en_raw"))
        found = one if found is None else found.unionByName(one)
    if found is None:
        raise ValueError("no source is left")
    return found


def first_of_source(rows: DataFrame, most: int) -> DataFrame:
    """The first ``most`` lines of each source. Spark keeps that many in each partition before it shuffles."""
    place = F.row_number().over(Window.partitionBy("source").orderBy("line_no"))
    return rows.withColumn("_r", place).where(F.col("_r") <= most).drop("_r")


def test_set(spark: SparkSession, name: str, known: dict[str, str], published: str | None = None) -> DataFrame:
    """A test set by its registered name or a path to JSON lines; anything else is an error.

    wmt names are sets that others publish; ``published`` is the folder where their files were put, as
    <name>.ja and <name>.en (this engine fetches nothing).
    """
    if name in known:
        return read_pairs(spark, known[name])
    if name.endswith(".jsonl"):
        return read_pairs(spark, name)
    if name.startswith("wmt") and published is not None:
        return parallel(spark, f"{published}/{name}.ja", f"{published}/{name}.en").orderBy("line_no").select("ja", "en")
    raise ValueError(f"unknown test set {name!r}")


def job_status(jobs: DataFrame) -> DataFrame:
    """Completed, failed and all requests of batch jobs; missing counts are 0."""
    total = lambda c: F.coalesce(F.sum(F.coalesce(c, F.lit(0))), F.lit(0)).alias(c)
    return jobs.agg(F.count("*").alias("jobs"), total("completed"), total("failed"), total("total"))


def digest(files: DataFrame) -> DataFrame:
    """(path, sha256) of files read with the binaryFile source."""
    return files.select("path", F.sha2("content", 256).alias("sha256"))


# --- reports ---------------------------------------------------------------------------------------


def markdown(df: DataFrame, title: str, formats: dict[str, str] | None = None, most: int = 1000) -> str:
    """A Markdown table of a small result, at most ``most`` rows."""
    formats = formats or {}
    rows = df.limit(most).collect()
    cell = lambda c, v: "—" if v is None else formats.get(c, "{}").format(v)
    head = [f"# {title}", "", "| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join(head + ["| " + " | ".join(cell(c, r[c]) for c in df.columns) + " |" for r in rows]) + "\n"


def mean_and_deviation(n: Column, mean: Column, deviation: Column) -> Column:
    """``mean ± deviation`` of several values, the bare number of one, a dash of none."""
    return F.when(n == 0, "—").when(n == 1, F.format_string("%.2f", mean)).otherwise(F.format_string("%.2f ± %.2f", mean, deviation))
