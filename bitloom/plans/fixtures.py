"""Inputs derived from the driver's tables, as DataFrames and as SQL views of the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bitloom.sources.tables import read_table, scratch  # noqa: F401  scratch for the queries

LATIN, KANA = "abcdefghijklmnopqrstuvwxyz", "あいうえおかきくけこさしすせそたちつてとなにぬねのは"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_table(spark, sf_dir, name)


def kana_image(text: Column) -> Column:
    return F.translate(F.lower(text), LATIN, KANA)


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of the documents with a kana image of their beginning: source, doc_id, line_no, en_raw, ja_raw."""
    rows = table(spark, sf_dir, "documents").select("source", "doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "en_raw"))
    cut = F.floor(F.length("en_raw") / (1 + F.col("doc_id") % 8)).cast("int")
    ja = F.when(F.col("doc_id") % 11 == 0, F.col("en_raw")).otherwise(kana_image(F.substring(F.col("en_raw"), F.lit(1), cut)))
    return rows.select("source", "doc_id", "line_no", "en_raw", ja.alias("ja_raw"))


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of the documents with a kana image of their beginning: source, source_ord, doc_id, line_no, en_raw, ja_raw."""
    docs = table(spark, sf_dir, "documents")
    # one row per source, so the window's single partition is small; Spark broadcasts it if its size allows
    order = docs.select("source").distinct().select("source", (F.rank().over(_by_source()) - 1).alias("source_ord"))
    lines = docs.select("source", "doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "en_raw"))
    cut = F.floor(F.length("en_raw") / (1 + F.col("doc_id") % 8)).cast("int")
    ja = F.when(F.col("doc_id") % 11 == 0, F.col("en_raw")).otherwise(kana_image(F.substring(F.col("en_raw"), F.lit(1), cut)))
    return lines.join(order, "source").select("source", "source_ord", "doc_id", "line_no", "en_raw", ja.alias("ja_raw"))


def _by_source():
    from pyspark.sql import Window

    return Window.orderBy("source")


PAIRS = f"""pairs AS (
  SELECT source, (dense_rank() OVER (ORDER BY source) - 1)::INT AS source_ord, doc_id, line_no, en_raw,
         CASE WHEN doc_id % 11 = 0 THEN en_raw
              ELSE translate(lower(substr(en_raw, 1, (length(en_raw) // (1 + doc_id % 8))::INT)), '{LATIN}', '{KANA}') END AS ja_raw
  FROM (SELECT source, doc_id, unnest(string_split(text, chr(10))) AS en_raw,
               unnest(range(0, len(string_split(text, chr(10)))))::INT AS line_no FROM documents)
)"""

STRIPPED = r"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def clean_sql(x: str) -> str:
    r"""Normalization in SQL; NFKC changes nothing in the driver's texts."""
    return rf"trim(regexp_replace(regexp_replace({x}, '[\p{{Cc}}\p{{Co}}]', '', 'g'), '\s+', ' ', 'g'))"


def crawl_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tab-separated crawl lines: some without score, permuted, or with one field."""
    p = pairs(spark, sf_dir)
    score = F.format_string("0.%02d", (F.col("doc_id") % 100).cast("int"))
    url = F.concat(F.lit("http://a.example/"), F.col("doc_id").cast("string"))
    value = (
        F.when(F.col("doc_id") % 19 == 0, F.col("en_raw"))
        .when(F.col("doc_id") % 17 == 0, F.concat_ws("\t", "ja_raw", score, url, "en_raw"))
        .when(F.col("doc_id") % 13 == 0, F.concat_ws("\t", url, url, "en_raw", "ja_raw"))
        .otherwise(F.concat_ws("\t", url, url, score, "en_raw", "ja_raw"))
    )
    return p.select("doc_id", "line_no", value.alias("value"))


CRAWL = """crawl AS (
  SELECT doc_id, line_no, CASE
    WHEN doc_id % 19 = 0 THEN en_raw
    WHEN doc_id % 17 = 0 THEN ja_raw || chr(9) || score || chr(9) || url || chr(9) || en_raw
    WHEN doc_id % 13 = 0 THEN url || chr(9) || url || chr(9) || en_raw || chr(9) || ja_raw
    ELSE url || chr(9) || url || chr(9) || score || chr(9) || en_raw || chr(9) || ja_raw END AS value
  FROM (SELECT *, '0.' || lpad((doc_id % 100)::VARCHAR, 2, '0') AS score, 'http://a.example/' || doc_id AS url FROM pairs)
)"""


def result_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Result records with repeated keys and rising versions: run, test_set, seed, beam, n, chrf, comet, version."""
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderpriority").alias("run"), F.col("o_orderstatus").alias("test_set"), (F.col("o_custkey") % 3).alias("seed"),
        F.when(F.col("o_orderkey") % 4 != 0, F.lit(1)).alias("beam"), (F.col("o_orderkey") % 100).alias("n"),
        F.pmod(F.floor(F.col("o_totalprice")), F.lit(100)).cast("double").alias("chrf"),
        F.when(F.col("o_orderkey") % 6 != 0, (F.col("o_orderkey") % 7).cast("double") / 8).alias("comet"), F.col("o_orderkey").alias("version"),
    )


RECORDS = """records AS (
  SELECT o_orderpriority AS run, o_orderstatus AS test_set, o_custkey % 3 AS seed, CASE WHEN o_orderkey % 4 <> 0 THEN 1 END AS beam,
         o_orderkey % 100 AS n, (floor(o_totalprice)::BIGINT % 100)::DOUBLE AS chrf,
         CASE WHEN o_orderkey % 6 <> 0 THEN (o_orderkey % 7)::DOUBLE / 8 END AS comet, o_orderkey AS version FROM orders
)"""


def teacher_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Translations by pair (doc_id, line_no) with missing, blank, refused, kana and over-long ones."""
    p = pairs(spark, sf_dir)
    k = F.col("doc_id") + 31 * F.col("line_no")
    en = (
        F.when(k % 7 == 0, F.lit("  "))
        .when(k % 11 == 0, F.concat(F.lit("Sorry, "), F.col("en_raw")))
        .when(k % 13 == 0, F.concat(F.lit("I am "), F.col("en_raw")))
        .when(k % 17 == 0, kana_image(F.col("en_raw")))
        .when(k % 19 == 0, F.repeat(F.col("en_raw"), 9))
        .otherwise(F.col("en_raw"))
    )
    return p.where(k % 5 != 0).select("doc_id", "line_no", en.alias("en"))


TEACHER = f"""teacher AS (
  SELECT doc_id, line_no, CASE
    WHEN k % 7 = 0 THEN '  ' WHEN k % 11 = 0 THEN 'Sorry, ' || en_raw WHEN k % 13 = 0 THEN 'I am ' || en_raw
    WHEN k % 17 = 0 THEN translate(lower(en_raw), '{LATIN}', '{KANA}') WHEN k % 19 = 0 THEN repeat(en_raw, 9) ELSE en_raw END AS en
  FROM (SELECT *, doc_id + 31 * line_no AS k FROM pairs) WHERE k % 5 <> 0
)"""
