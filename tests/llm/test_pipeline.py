"""The pipeline's stages, one after the other."""

import random

from pyspark.sql import functions as F

from tests.llm.test_operators import DOC, prose

SF = "/root/testdata/sf0.001"


def test_contract(spark):
    import corpus_pipeline as cp

    assert [name for name, _ in cp.STAGES] == ["toxicity", "near_duplicates", "repeated_passages", "decontamination", "mixing"]
    whole = cp.run(spark, SF)
    assert whole.count() > 0 and set(cp.COLUMNS) <= set(whole.columns)


def test_stages_on_planted_documents(spark, tmp_path):
    import corpus_pipeline as cp

    rng = random.Random(2)
    clean = [prose(i, rng.randint(90, 160)) for i in range(150)]
    item = prose(7000, 30) + ". " + prose(7001, 6) + "."
    passage = prose(8000, 90)
    near = clean[3].split()
    near[10] = "edited"
    planted = [clean[0], " ".join(near), prose(5, 40) + f" {item} " + prose(6, 40), prose(9001, 60) + "(" + passage + ")" + prose(9002, 60), prose(9003, 60) + "[" + passage + "]" + prose(9004, 60)]
    toxic = [prose(i + 500, 70) + " rotten villain scum " + prose(i + 900, 30) for i in range(60)]
    texts = clean + planted + toxic
    docs = spark.createDataFrame([(i, t, "en", "ab"[i % 2], len(t)) for i, t in enumerate(texts)], DOC)
    spark.createDataFrame([(i, 1, int(i >= 155)) for i in range(len(texts)) if i % 3], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    ids = lambda df: {r["doc_id"] for r in df.select("doc_id").collect()}
    seen = {}
    at = docs
    for name, stage in cp.STAGES[:-1]:
        at = stage(spark, at, str(tmp_path)).cache()
        seen[name] = ids(at)
        assert at.columns == cp.COLUMNS
    assert seen["toxicity"] == set(range(155))
    assert seen["near_duplicates"] == set(range(155)) - {150, 151}
    assert seen["repeated_passages"] == seen["near_duplicates"]
    left = {r["doc_id"]: r["text"] for r in at.collect()}
    assert left[153] == prose(9001, 60) + "()" + prose(9002, 60) and left[154] == prose(9003, 60) + "[]" + prose(9004, 60)
    assert seen["decontamination"] == seen["near_duplicates"] - {152}
    mixed = cp.STAGES[-1][1](spark, at, str(tmp_path))
    assert mixed.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 3").count() == 0 and ids(mixed) <= seen["decontamination"]


def test_rows_with_nulls(spark, tmp_path):
    """An empty text stays whatever n_chars says; a leaked document without an id goes, clean ones without one stay."""
    import corpus_pipeline as cp

    item = prose(7000, 30) + ". " + prose(7001, 6) + "."
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = [(None, item + " " + prose(1, 40)), (None, prose(2, 80)), (1, item), (2, ""), (3, None), (4, prose(3, 80)), (1, prose(4, 80))]
    docs = spark.createDataFrame([(i, t, "en", "a", None) for i, t in rows], DOC)
    as_set = lambda df: {(r["doc_id"], r["text"]) for r in df.collect()}
    assert as_set(cp.cut_repeats(spark, docs, str(tmp_path))) == set(rows)
    assert as_set(cp.drop_leaks(spark, docs, str(tmp_path))) == {rows[1], *rows[3:]}


def tables(spark, tmp_path, labels=()):
    item = prose(7000, 30) + ". " + prose(7001, 6) + "."
    spark.createDataFrame([(1, item), (None, "x"), (2, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame(list(labels), "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    return item


def test_every_stage_takes_an_empty_table_and_clashing_columns(spark, tmp_path):
    import corpus_pipeline as cp

    tables(spark, tmp_path, [(1, None, 1), (None, 1, None)])
    docs = spark.createDataFrame([(1, prose(1, 60), None, None, None), (1, prose(1, 60), None, None, None), (None, None, None, None, None), (None, "", "en", "a", 0)], DOC)
    for name in ("_id", "_version", "_score", "_size", "_copies", "_copy", "copy", "_row", "_key", "row", "fp", "component", "_keep", "_empty", "_spans"):
        docs = docs.withColumn(name, F.lit("clash"))
    for name, stage in cp.STAGES:
        assert stage(spark, docs.where("false"), str(tmp_path)).count() == 0, name
        found = stage(spark, docs, str(tmp_path))
        assert found.columns[:5] == cp.COLUMNS and found.count() <= 6, name


def jaccard(a, b):
    sets = [{tuple(t.lower().split()[k : k + 5]) for k in range(max(1, len(t.split()) - 4))} if t and t.split() else set() for t in (a, b)]
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1]) if sets[0] | sets[1] else 1.0


def test_near_duplicates_against_all_pairs(spark, tmp_path):
    """Groups linked at 0.8 by brute force: at least 0.9 of what should go goes, nothing else does."""
    import corpus_pipeline as cp

    rng, rows = random.Random(9), []
    for group in range(40):
        words = prose(group, 150).split()
        for _ in range(rng.randrange(1, 5)):
            copy = [w if rng.random() > 0.015 else "edit" + str(rng.randrange(999)) for w in words]
            rows.append(" ".join(copy))
    rows += ["", None, " ", rows[0], rows[0]]
    ids = [*range(len(rows) - 2), None, 5]  # one id twice, with different texts, and one row without an id
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if jaccard(rows[i], rows[j]) >= 0.8:
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    order = lambda i: (ids[i] is None, ids[i] or 0, rows[i] or "")
    first = {r: min((i for i in range(len(rows)) if root[i] == r), key=order) for r in set(root)}
    docs = spark.createDataFrame([(i, t, "en", "a", 0) for i, t in zip(ids, rows, strict=True)], DOC)
    left = {(r["doc_id"], r["text"]) for r in cp.drop_near_duplicates(spark, docs, str(tmp_path)).collect()}
    kept = {i for i in range(len(rows)) if (ids[i], rows[i]) in left}
    should_go = {i for i in range(len(rows)) if first[root[i]] != i and (ids[i], rows[i]) != (ids[first[root[i]]], rows[first[root[i]]])}
    gone = set(range(len(rows))) - kept
    assert len(gone & should_go) >= 0.9 * len(should_go) and not gone - should_go


def test_passages_against_counting_words(spark, tmp_path):
    import corpus_pipeline as cp

    rng, pool = random.Random(5), [prose(900 + k, 120).split() for k in range(4)]
    texts = []
    for d in range(30):
        p, a = rng.choice(pool), rng.randrange(40)
        texts.append(" ".join(prose(d, rng.randrange(30)).split() + p[a : a + rng.randrange(40, 80)] + prose(d + 500, 20).split()))
    seen = {}
    for d, t in enumerate(texts):
        w = t.split()
        for k in range(len(w) - 50):
            seen.setdefault(tuple(w[k : k + 51]), set()).add((d, k))
    gone = [bytearray(len(t)) for t in texts]
    for places in seen.values():
        for d, k in places if len(places) > 1 else ():
            before = len(" ".join(texts[d].split()[:k] + [""]))
            gone[d][before : before + len(" ".join(texts[d].split()[k : k + 51]))] = b"\1" * len(" ".join(texts[d].split()[k : k + 51]))
    assert any(map(any, gone))
    strings = {}
    for d, t in enumerate(texts):
        for k in range(len(t) - 399):
            strings.setdefault(t[k : k + 400], []).append((d, k))
    for places in strings.values():
        for d, k in places if len(places) > 1 else ():
            gone[d][k : k + 400] = b"\1" * 400
    docs = spark.createDataFrame([(d, t, "en", "a", 0) for d, t in enumerate(texts)], DOC)
    left = {r["doc_id"]: r["text"] for r in cp.cut_repeats(spark, docs, str(tmp_path)).collect()}
    assert left == {d: x for d, t in enumerate(texts) if (x := "".join(c for c, g in zip(t, gone[d], strict=True) if not g))}


def test_leaks_against_scanning_every_pair(spark, tmp_path):
    import corpus_pipeline as cp

    item = tables(spark, tmp_path)
    words = item.split()
    texts = [prose(1, 50) + " " + " ".join(words[a:b]) + " " + prose(2, 50) for a, b in ((0, 36), (0, 28), (4, 36), (20, 36), (0, 0), (2, 35))]
    docs = spark.createDataFrame([(k, t, "en", "a", 0) for k, t in enumerate(texts)], DOC)
    question, answer = (set(p.replace(".", "").split()) for p in item.split(". "))

    def leaks(text):
        has = set(text.replace(".", "").split())
        tri = lambda t: {tuple(t[k : k + 3]) for k in range(len(t) - 2)}
        q = item.split(". ")[0].split()
        return len(tri(q) & tri(text.replace(".", "").split())) / len(tri(q)) >= 0.6 and len(answer & has) / len(answer) >= 0.6

    left = {r["doc_id"] for r in cp.drop_leaks(spark, docs, str(tmp_path)).collect()}
    assert question and left == {k for k, t in enumerate(texts) if not leaks(t)} and 4 in left and 0 not in left


def test_toxic_documents_by_their_scores(spark, tmp_path):
    """The stage keeps what scores below one half under a model fitted on the labelled rows that are there."""
    import corpus_pipeline as cp
    from bitloom.llm import toxicity

    texts = [prose(k, 40) + (" rotten scum " if k % 3 == 0 else " ") + prose(k + 300, 10) for k in range(200)] + [None, "", texts_of_one_word()]
    tables(spark, tmp_path, [(k, 1, int(k % 3 == 0)) for k in range(200)])
    docs = spark.createDataFrame([(k, t, "en", "a", 0) for k, t in enumerate(texts)], DOC)
    model = toxicity.train(docs, spark.read.parquet(str(tmp_path / "labels.parquet")))
    table, hashes = model.dense(), toxicity.WordHashes()
    by_hand = {k for k, t in enumerate(texts) if model.bias + sum(float(table[i]) for i in toxicity.features(t, hashes)) < 0}
    assert {r["doc_id"] for r in cp.drop_toxic(spark, docs, str(tmp_path)).collect()} == by_hand
    assert sum(k % 3 != 0 for k in by_hand if k < 200) == 133 and sum(k % 3 == 0 for k in by_hand if k < 200) < 7


def texts_of_one_word():
    return "word " * 20_000
