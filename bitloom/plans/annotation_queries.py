"""Queries of the annotation format over documents whose words are tokens, with one fault in most of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bitloom.operators import annotation as an
from bitloom.operators import model
from bitloom.operators import tokenizer as tok
from bitloom.operators.lexicon import written
from bitloom.plans import fixtures as fx
from bitloom.plans.queries import query, with_

RULES_MARKDOWN = """
```yaml
MARK:
  name: 'marking'
  level: N5
  roles: {marker: {target: token, required: true}, topic: {target: span, required: false}}
```
"""


def rules(s: SparkSession) -> DataFrame:
    return an.load_ruleset(s, "grammar-1.0", RULES_MARKDOWN)


def all_words(s: SparkSession, d: str) -> DataFrame:
    """doc_id and the words of the text; null is empty."""
    words = F.filter(F.split(F.translate(F.coalesce("text", F.lit("")), "\n", " "), " "), lambda w: w != "")
    return fx.table(s, d, "documents").select("doc_id", words.alias("w"))


def wires(s: SparkSession, d: str) -> DataFrame:
    """doc_id, wire, source (array of one text), n; doc_id mod 10 names the invariant that is broken, 0 none.

    A text of one word has no fault (its sentence can't be misplaced), one without words an empty paragraph.
    """
    fault = F.when(F.size("w") >= 2, F.col("doc_id") % 10).otherwise(0).cast("int")
    f = lambda k, bad, good: F.when(fault == k, bad).otherwise(good)
    t = lambda x: F.lit(x) if isinstance(x, str) else x
    line = lambda tag, *fields: F.concat(F.lit(tag), F.concat_ws(an.FIELD_SEP, *map(t, fields)), F.lit(an.RECORD_END + "\n"))

    def token(w: Column, i: Column) -> Column:
        first = i == 0
        number = (i + F.when(fault == 2, 1).otherwise(0)).cast("string")
        surface = F.when(first & (fault == 4), F.concat(w, F.lit("漢"))).otherwise(w)
        gloss = F.when(first & (fault == 9), F.concat(F.lit("g"), F.lit("\ue01a"))).otherwise(F.concat(F.lit("g"), i.cast("string")))
        return line(an.TOKEN, number, surface, "", F.lower(w), F.when(first & (fault == 8), "XXX").otherwise("NOUN"), gloss)

    n = F.size("w")
    grammar = F.when(fault == 7, F.when(F.col("doc_id") % 20 < 10, line(an.GRAMMAR, "NOPE", "marker=0")).otherwise(line(an.GRAMMAR, "MARK", "topic=0:1", "other=1"))).otherwise(
        line(an.GRAMMAR, "MARK", "marker=0")
    )
    about = F.concat(
        F.array_join(F.transform("w", token), ""), line(an.WORD, F.concat(F.lit("0:"), (n + f(5, 3, 0)).cast("string")), "d", "w"),
        line(an.SENTENCE, F.concat(f(6, "1:", "0:"), n.cast("string")), "said"), grammar,
    )
    wire = F.concat(line(an.HEADER, f(1, "9.9", "0.2"), "grammar-1.0"), F.lit(an.PARAGRAPH + an.RECORD_END + "\n"), F.when(n > 0, about).otherwise(""))
    joined = F.array_join("w", "")
    source = F.when(fault == 3, F.concat(joined, F.lit("!"))).when(fault == 4, F.concat(F.get("w", F.lit(0)), F.lit("漢"), F.array_join(F.slice("w", F.lit(2), n), ""))).otherwise(joined)
    return all_words(s, d).select("doc_id", wire.alias("wire"), F.array(source).alias("source"), n.alias("n"))


W = """w AS (SELECT doc_id, list_filter(string_split(replace(coalesce(text, ''), chr(10), ' '), ' '), lambda x: x <> '') AS w FROM documents),
d AS (SELECT doc_id, CASE WHEN len(w) >= 2 THEN doc_id % 10 ELSE 0 END AS f, w, len(w) AS n FROM w)"""
T = "chr(57345)"
WIRE = rf"""wires AS (SELECT doc_id, chr(57344) || CASE WHEN f = 1 THEN '9.9' ELSE '0.2' END || chr(57359) || 'grammar-1.0' || e || chr(57349) || e || CASE WHEN n = 0 THEN '' ELSE
 array_to_string(list_transform(list_zip(w, range(0, n)), lambda z: chr(57345) || (z[2] + CASE WHEN f = 2 THEN 1 ELSE 0 END) || chr(57359) || z[1] || CASE WHEN z[2] = 0 AND f = 4 THEN '漢' ELSE '' END || chr(57359)
  || chr(57359) || lower(z[1]) || chr(57359) || CASE WHEN z[2] = 0 AND f = 8 THEN 'XXX' ELSE 'NOUN' END || chr(57359) || 'g' || CASE WHEN z[2] = 0 AND f = 9 THEN chr(57370) ELSE z[2]::VARCHAR END || e), '') ||
 chr(57346) || '0:' || (n + CASE WHEN f = 5 THEN 3 ELSE 0 END) || chr(57359) || 'd' || chr(57359) || 'w' || e || chr(57347) || CASE WHEN f = 6 THEN '1:' ELSE '0:' END || n || chr(57359) || 'said' || e ||
 chr(57348) || CASE WHEN f = 7 THEN CASE WHEN doc_id % 20 < 10 THEN 'NOPE' || chr(57359) || 'marker=0' ELSE 'MARK' || chr(57359) || 'topic=0:1' || chr(57359) || 'other=1' END ELSE 'MARK' || chr(57359) || 'marker=0' END || e END AS wire, f, n
 FROM (SELECT *, chr(57360) || chr(10) AS e FROM d))"""


def parsed(s: SparkSession, d: str) -> DataFrame:
    return wires(s, d).withColumn("parsed", an.parse(F.col("wire")))


@query("g1_g2_p13_parse", with_(W) + "SELECT doc_id, n::INT AS tokens, least(n, 1)::INT AS words, least(n, 1)::INT AS sentences, least(n, 1)::INT AS grammar, CASE WHEN f = 4 THEN w[1] || '漢' || array_to_string(w[2:], '') ELSE coalesce(array_to_string(w, ''), '') END AS plain FROM d")
def _(s, d):
    p = F.col("parsed.doc.paragraphs")[0]
    return parsed(s, d).select("doc_id", F.size(p["tokens"]).alias("tokens"), F.size(p["words"]).alias("words"), F.size(p["sentences"]).alias("sentences"),
                       F.size(p["grammar"]).alias("grammar"), F.array_join(F.transform(p["tokens"], lambda t: t["surface"]), "").alias("plain"))


@query("g3_p10_serialize", with_(W, WIRE) + "SELECT doc_id, CASE WHEN f <> 9 THEN md5(wire) END AS digest FROM wires")
def _(s, d):
    back = an.serialize(F.col("parsed.doc"), strict=False)
    return parsed(s, d).select("doc_id", F.md5(an.from_debug(an.to_debug(back))).alias("digest"))


@query("g10_parse_errors", with_(W, WIRE) + """SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'more than one header' WHEN doc_id % 3 = 1 THEN 'unknown record tag U+0058' ELSE 'no header' END AS msg,
CASE WHEN doc_id % 3 = 0 THEN length(wire) WHEN doc_id % 3 = 1 THEN 0 END::INT AS pos FROM wires WHERE doc_id % 3 < 2
UNION ALL SELECT doc_id, 'no header', NULL FROM wires WHERE doc_id % 3 = 2""")
def _(s, d):
    header = F.lit(f"{an.HEADER}0.2{an.FIELD_SEP}grammar-1.0{an.RECORD_END}\n")
    # the second header's record begins with the line end before it
    bad = F.when(F.col("doc_id") % 3 == 0, F.concat("wire", header)).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("X" + an.RECORD_END), "wire")).otherwise(F.lit(an.PARAGRAPH + an.RECORD_END))
    rows = wires(s, d).withColumn("parsed", an.parse(bad))
    pos = F.col("parsed.error.pos") + F.when(F.col("doc_id") % 3 == 0, 1).otherwise(0)
    return rows.select("doc_id", "parsed.error.msg", pos.cast("int").alias("pos"))


@query("l1_l9_lint", with_(W) + """SELECT doc_id, f::INT AS invariant, (CASE WHEN f = 7 AND doc_id % 20 >= 10 THEN 2 ELSE 1 END)::BIGINT AS n FROM d WHERE f > 0""")
def _(s, d):
    docs = parsed(s, d).select("doc_id", F.col("parsed.doc").alias("doc"), "source")
    return an.lint(docs, rules(s), source="source").groupBy("doc_id", "invariant").agg(F.count("*").alias("n"))


def annotations(s: SparkSession, d: str) -> DataFrame:
    """i, text, morphs, content: a teacher's JSON with overlapping words, split sentences, unknown rules and bad targets."""
    words = all_words(s, d)
    morph = lambda w, i: F.struct(
        w.alias("surface"), F.array().cast("array<string>").alias("ruby"), F.lower(w).alias("dictionary_form"),
        F.when((i == 0) & (F.col("doc_id") % 8 == 0), "XXX").otherwise("NOUN").alias("pos"), F.lit(True).alias("ruby_ok"))
    n = F.size("w").cast("string")
    content = F.concat(
        F.lit('{"tokens": [{"id": 0, "gloss": "first"}, {"id": "1", "gloss": "second"}], "words": [{"span": [0, 1], "dict": "a", "gloss": "b"}, {"span": [0, 2]}, {"span": [1, 1]}, {"span": [1, '),
        n, F.lit(']}, {"span": [1, 99]}], "sentences": [{"translation": " one "}, {"translation": ""}, {"translation": "two"}], "grammar": [{"rule": "MARK", "roles": {"marker": 0}}, {"rule": "NOPE", "roles": {"marker": 0}}, {"rule": "MARK", "roles": {"marker": '),
        F.when(F.col("doc_id") % 2 == 0, n).otherwise(F.lit("1")), F.lit("}}, {\"rule\": \"MARK\", \"roles\": {}}]}"),
    )
    content = F.when(F.col("doc_id") % 23 == 0, F.lit(None)).when(F.col("doc_id") % 29 == 0, F.lit("{broken")).otherwise(content)
    return words.select(F.col("doc_id").alias("i"), F.array_join("w", "").alias("text"), F.transform("w", morph).alias("morphs"), content.alias("content"), F.size("w").alias("n"))


@query("g6_j5_j6_w7_assemble", with_(W) + """SELECT doc_id AS i, CASE WHEN doc_id % 23 = 0 THEN 'api_fail' WHEN doc_id % 29 = 0 THEN 'assemble_err' END AS reason,
CASE WHEN doc_id % 23 <> 0 AND doc_id % 29 <> 0 THEN least(n, 2) END::INT AS words, CASE WHEN doc_id % 23 <> 0 AND doc_id % 29 <> 0 THEN CASE WHEN doc_id % 2 = 0 THEN least(n, 1) ELSE least(n, 2) END END::INT AS grammar,
CASE WHEN doc_id % 23 <> 0 AND doc_id % 29 <> 0 AND n > 0 THEN 'one two' END AS translation,
CASE WHEN doc_id % 23 <> 0 AND doc_id % 29 <> 0 THEN CASE WHEN n = 0 THEN '' WHEN n = 1 THEN 'first' ELSE 'first|second' || repeat('|', n::INT - 2) END END AS glosses FROM d""")
def _(s, d):
    p = F.col("doc.paragraphs")[0]
    return an.assemble(annotations(s, d), rules(s)).select("i", "reason", F.when(p.isNotNull(), F.size(p["words"])).alias("words"), F.when(p.isNotNull(), F.size(p["grammar"])).alias("grammar"),
                                                           F.get(p["sentences"], F.lit(0))["translation"].alias("translation"), F.array_join(F.transform(p["tokens"], lambda t: t["gloss"]), "|").alias("glosses"))


GATE = """g AS (SELECT doc_id, CASE WHEN doc_id % 23 = 0 THEN 'api_fail' WHEN doc_id % 29 = 0 THEN 'assemble_err' WHEN doc_id % 8 = 0 AND n > 0 THEN 'inv8' END AS reason, coalesce(array_to_string(w, ''), '') AS text FROM d)"""


@query("g7_g8_j4_gate", with_(W, GATE) + "SELECT reason, count(*) AS n FROM g WHERE reason IS NOT NULL GROUP BY reason")
def _(s, d):
    return an.gate(an.assemble(annotations(s, d), rules(s)), rules(s))[0]


@query("a13_gate_report", with_(W, GATE) + """SELECT count(*) AS total, count(*) FILTER (WHERE reason IS NULL) AS passed, round(count(*) FILTER (WHERE reason IS NULL) / count(*)::DOUBLE, 4) AS pass_rate,
array_to_string((SELECT list(text ORDER BY doc_id) FROM (SELECT * FROM g WHERE reason IS NULL ORDER BY doc_id LIMIT 40)), ' ') AS sample FROM g""")
def _(s, d):
    assembled = an.assemble(annotations(s, d), rules(s))
    return an.gate_report(assembled, an.gate(assembled, rules(s))[1]).select("total", "passed", "pass_rate", F.array_join("audit_sample", " ").alias("sample"))


@query("p21_display", with_(W) + """SELECT doc_id, '{"tokens":[' || coalesce(array_to_string(list_transform(list_zip(w, range(0, n)), lambda z: '{"surface":' || to_json(z[1] || CASE WHEN z[2] = 0 AND f = 4 THEN '漢' ELSE '' END)::VARCHAR
|| ',"ruby":[],"gloss":' || to_json('g' || CASE WHEN z[2] = 0 AND f = 9 THEN chr(57370) ELSE z[2]::VARCHAR END)::VARCHAR || ',"pos":' || CASE WHEN z[2] = 0 AND f = 8 THEN '"XXX"' ELSE '"NOUN"' END || ',"dict":' || to_json(lower(z[1]))::VARCHAR || '}'), ','), '')
|| '],"translation":' || CASE WHEN n = 0 THEN '"","grammar":[]' ELSE '"said","grammar":[{"rule":' || CASE WHEN f <> 7 THEN '"MARK","roles":[{"role":"marker","tok":0}]' WHEN doc_id % 20 < 10 THEN '"NOPE","roles":[{"role":"marker","tok":0}]'
ELSE '"MARK","roles":[{"role":"topic","span":[0,1]},{"role":"other","tok":1}]' END || '}]' END || '}' AS shown FROM d""")
def _(s, d):
    return parsed(s, d).select("doc_id", an.display(F.col("parsed.doc")).alias("shown"))


@query("a14_rates", with_(W) + """SELECT count(*) FILTER (WHERE doc_id % 13 <> 0) / count(*)::DOUBLE AS parse_rate, count(*) FILTER (WHERE (f = 0 OR f = 3) AND doc_id % 13 <> 0) / count(*)::DOUBLE AS lint_rate,
count(*) FILTER (WHERE f <> 3 AND doc_id % 13 <> 0) / count(*)::DOUBLE AS rebuilt_rate FROM d""")
def _(s, d):
    """Shares of all documents that can be read, have no violation, and give their source text back; every thirteenth is broken."""
    broken = F.when(F.col("doc_id") % 13 == 0, F.concat(F.lit("X"), "wire")).otherwise(F.col("wire"))
    docs = wires(s, d).withColumn("parsed", an.parse(broken)).select("doc_id", F.col("parsed.doc").alias("doc"), "source")
    plain = an.lint(docs, rules(s)).select("doc_id").distinct().withColumn("bad", F.lit(True))
    rebuilt = F.array_join(F.transform(F.col("doc.paragraphs")[0]["tokens"], lambda t: t["surface"]), "") == F.col("source")[0]
    rate = lambda c: F.avg(F.coalesce(c, F.lit(False)).cast("double"))
    return docs.join(plain, "doc_id", "left").agg(rate(F.col("doc").isNotNull()).alias("parse_rate"), rate(F.col("bad").isNull() & F.col("doc").isNotNull()).alias("lint_rate"), rate(rebuilt).alias("rebuilt_rate"))


@query("g9_training_set", with_(W, GATE) + ", kept AS (SELECT *, row_number() OVER (ORDER BY md5('1|' || text), doc_id) - 1 AS i, count(*) OVER () AS n FROM g WHERE reason IS NULL) "
       "SELECT doc_id AS i, CASE WHEN kept.i < least(200, n // 20) THEN 'valid' ELSE 'train' END AS split FROM kept")  # fmt: skip
def _(s, d):
    from bitloom.operators.corpus import split_holdout

    # written once: it is counted twice, sampled and split
    passed = written(an.gate(an.assemble(annotations(s, d), rules(s)), rules(s))[1].select(F.col("i").alias("row"), F.col("ja").alias("text")), "passed")
    held = min(200, passed.count() // 20)
    return split_holdout(passed, held, 0, 1, [F.col("text")], ["row"]).select(F.col("row").alias("i"), "split")


@query("e5_e7_m3_m7_translate")
def _(s, d):
    """Untrained weights, so the words mean nothing: batches, cache and decoding run over all test items, beams over all nations."""
    cfg = model.ModelConfig(vocab=tok.OFFSET + tok.BYTES)
    known, weights = tok.Tokenizer([]), model.new_weights(cfg)
    items = fx.table(s, d, "benchmark").select(F.col("item_id").alias("id"), F.col("text").alias("src"))
    names = fx.table(s, d, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("src"))
    greedy = model.translate(items, cfg, weights, known.encode, known.decode).select(F.lit("greedy").alias("by"), "id", "hyp")
    return greedy.unionByName(model.translate(names, cfg, weights, known.encode, known.decode, longest=16, beam=4).select(F.lit("beam").alias("by"), "id", "hyp"))
