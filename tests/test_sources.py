"""Files in and out, and the funnel over a stream."""

import pytest
from pyspark.sql import functions as F

from bitloom.sources import files, stores


def write(path, *rows):
    path.write_text("\n".join(rows) + "\n", encoding="utf-8")
    return str(path)


def test_parallel_files_stop_at_the_shorter(spark, tmp_path):
    ja, en = write(tmp_path / "d-train.ja", "一", "二", "三"), write(tmp_path / "d-train.en", "one", "two")
    assert [(r["ja"], r["en"]) for r in files.parallel(spark, ja, en).orderBy("line_no").collect()] == [("一", "one"), ("二", "two")]
    assert files.parallel_splits(spark, str(tmp_path), "d", ("train",)).count() == 2


def test_tabs_and_crawl(spark, tmp_path):
    write(tmp_path / "pairs.tsv", 'a "quoted"\t一\tCC', "", "orphan", "b\t二", "\t三")
    write(tmp_path / "x.txt", "http://a\thttp://b\t0.9\tHello\tこんにちは", "http://a\thttp://b\t0.1\tHello\tこんにちは")
    config = [{"name": "t", "kind": "tabs", "root": str(tmp_path)}, {"name": "c", "kind": "crawl", "root": str(tmp_path)}]
    rows = files.union_sources(spark, config).orderBy("source_ord", "line_no").collect()
    assert [(r["source"], r["ja_raw"], r["en_raw"]) for r in rows] == [("t", "一", 'a "quoted"'), ("t", "二", "b"), ("c", "こんにちは", "Hello")]
    assert files.union_sources(spark, config, only={"t"}, most=1).count() == 1
    with pytest.raises(ValueError):
        files.union_sources(spark, [{"name": "x", "kind": "nope", "root": ""}])


def test_lines_of_several_files_and_blocks(spark, tmp_path):
    """Numbers follow paths and offsets, also where Spark reads a later or larger block first."""
    write(tmp_path / "b.txt", *[f"b{i:03d}" for i in range(400)])
    write(tmp_path / "a.txt", *[f"a{i}" for i in range(5)])
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    try:
        rows = files.lines(spark, str(tmp_path / "*.txt")).orderBy("line_no").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)
    assert [tuple(r) for r in rows] == list(enumerate([f"a{i}" for i in range(5)] + [f"b{i:03d}" for i in range(400)]))


def test_bitext_is_located(spark, tmp_path):
    assert files.locate_bitext(["/r/en-ja/en-ja.tar.gz", "/r/en-ja/x.bicleaner", "/r/z/b.txt", "/r/a/c.txt"]) == "/r/a/c.txt"
    assert files.locate_bitext(["/r/en-ja.tar.gz", "/r/q/en-ja.text"]) == "/r/q/en-ja.text" and files.locate_bitext(["/r/en-ja.gz"]) is None
    (tmp_path / "en-ja").mkdir()
    write(tmp_path / "en-ja" / "en-ja.txt", "http://a\thttp://b\t0.9\tHello\tこんにちは")
    write(tmp_path / "en-ja" / "en-ja.txt.gz", "nothing")
    assert files.SOURCES["crawl"](spark, str(tmp_path)).count() == 1
    with pytest.raises(ValueError):
        files.SOURCES["crawl"](spark, str(tmp_path / "nowhere"))
    ran = []
    assert [files.once(spark, str(tmp_path / ".done"), lambda: ran.append(1)) for _ in range(2)] == [True, False] and ran == [1]
    write(tmp_path / "wmt22.ja", "一"), write(tmp_path / "wmt22.en", "one")
    assert [tuple(r) for r in files.test_set(spark, "wmt22", {}, str(tmp_path)).collect()] == [("一", "one")]


def test_digest_and_status(spark, tmp_path):
    import hashlib

    write(tmp_path / "x.bin", "abc")
    assert files.digest(spark.read.format("binaryFile").load(str(tmp_path / "x.bin"))).first()["sha256"] == hashlib.sha256(b"abc\n").hexdigest()
    assert tuple(files.job_status(spark.createDataFrame([(1, None, 3), (None, 2, 4)], "completed int, failed int, total int")).first()) == (2, 1, 2, 7)


def test_json_lines(spark, tmp_path):
    pairs = spark.createDataFrame([("一", "one"), ("二", "two")], files.PAIR)
    assert files.write_pairs(pairs, str(tmp_path / "p")) == 2
    assert files.read_pairs(spark, str(tmp_path / "p")).orderBy("en").collect() == pairs.orderBy("en").collect()
    files.write_texts(pairs, str(tmp_path / "t"))
    assert spark.read.text(str(tmp_path / "t" / "en.txt")).count() == 2
    with pytest.raises(ValueError):
        files.test_set(spark, "nope", {})


def test_head_counts_physical_lines(spark, tmp_path):
    rows = files.lines(spark, write(tmp_path / "l", "a", "", "b", "c"))
    assert [r["value"] for r in files.head_lines(rows, 3).orderBy("line_no").collect()] == ["a", "b"]


def test_report(spark):
    text = files.markdown(spark.createDataFrame([("a", 0.5), ("b", None)], "k string, v double"), "Title", {"v": "{:.2f}"})
    assert "| a | 0.50 |" in text and "| b | — |" in text
    row = spark.range(3).select(files.mean_and_deviation(F.col("id"), F.lit(47.2), F.lit(0.2)).alias("x")).orderBy("x").collect()
    assert {r["x"] for r in row} == {"—", "47.20", "47.20 ± 0.20"}


def test_stream(spark, tmp_path):
    from bitloom.streaming.funnel import stream_funnel

    schema = "source string, source_ord int, doc_id long, line_no int, ja_raw string, en_raw string"
    put = lambda i, ja: spark.createDataFrame([("s", 0, i, 0, ja, "Hello there")], schema).write.mode("append").parquet(str(tmp_path / "in"))
    run = lambda: stream_funnel(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), str(tmp_path / "keys"), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    put(1, "こんにちは")
    run()
    put(2, "こんにちは")
    put(3, "さようなら")
    run()
    assert {r["doc_id"]: r["stage"] for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {1: None, 2: "dedup", 3: None}


def test_first_lines_of_each_source(spark):
    rows = spark.createDataFrame([(s, n) for s in "ab" for n in range(5)] + [("c", 0)], "source string, line_no long").repartition(3)
    found = files.first_of_source(rows, 2)
    assert found.columns == ["source", "line_no"]
    assert sorted(map(tuple, found.collect())) == [("a", 0), ("a", 1), ("b", 0), ("b", 1), ("c", 0)]
    assert files.first_of_source(rows.where("false"), 2).count() == 0


def test_saved_statistics_replace_older_ones(spark, tmp_path):
    path = str(tmp_path / "stats")
    for n in (1, 2):
        stores.save_stats(spark.createDataFrame([(n, "x")], "total long, source string"), path)
    assert [tuple(r) for r in spark.read.schema("total long, source string").json(path).collect()] == [(2, "x")]
