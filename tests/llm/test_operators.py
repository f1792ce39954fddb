"""The training-data operators on small inputs, against brute-force versions and for odd rows."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from bitloom.llm import chat, decontaminate, digests, graph, language, licenses, mixing, registry, repeats, simhash, toxicity, urls
from bitloom.llm.common import table
from tests.oracle import assert_same

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long"
PROSE = "the quick brown fox jumps over a lazy dog while seven wizards brew dark potions near old castle walls under pale moon light again".split()


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join(rng.choice(PROSE) + str(rng.randrange(60)) for _ in range(n))


def docs(spark, texts, **more):
    rows = [(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, DOC)
    for name, value in more.items():
        df = df.withColumn(name, F.lit(value))
    return df


ODD = [None, "", " \n ", "a", "word " * 40_000, "z" * 70_000, "x", "x", "日本語のテキスト", prose(1, 300), prose(1, 300)]


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_sql(spark, name):
    assert_same(registry.queries()[name](spark, SF), SF, registry.oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_runs(spark, name):
    assert registry.queries()[name](spark, SF).count() >= 0


def test_odd_rows_and_clashing_columns(spark):
    odd = docs(spark, ODD, token=1, node="n", bucket=2, size=3, target=4, h=5).unionByName(spark.createDataFrame([(None, "null id", None, None, None)], DOC), allowMissingColumns=True)
    odd = odd.unionByName(odd.where("doc_id = 6"))  # a repeated row
    n = odd.count()
    bench = spark.createDataFrame([(1, prose(1, 300)[40:200]), (2, None), (None, "x")], "item_id long, text string")
    labels = spark.createDataFrame([(0, 1, 0), (9, 0, None), (4, 1, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    assert mixing.query(odd).count() == n
    assert digests.query(odd).count() == n and digests.fingerprint(odd).count() == n
    assert repeats.query(odd).count() == n
    assert simhash.query(odd).count() == n
    assert toxicity.query(odd, labels).count() == n
    assert language.query(odd).count() == n
    assert licenses.query(odd).count() == 0
    assert {(r["doc_id"], r["item_id"]) for r in decontaminate.query(odd, bench).where("leaked").collect()} == {(9, 1), (10, 1)}


def test_empty_tables(spark):
    none = docs(spark, []).limit(0)
    labels, bench = spark.createDataFrame([], "doc_id long, quality int, toxic int"), spark.createDataFrame([], "item_id long, text string")
    for df in (
        mixing.query(none), digests.query(none), repeats.query(none), simhash.query(none), toxicity.query(none, labels), language.query(none), licenses.query(none),
        decontaminate.query(none, bench), decontaminate.query(docs(spark, ["a"]), bench), urls.query(spark.createDataFrame([], "page_id long, url string, html string")),
    ):
        assert df.count() == 0
    assert chat.query(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 1  # the trap alone
    assert toxicity.query(docs(spark, ["a"]), labels).first()["predicted"] == 0


# --- 1 decontamination -------------------------------------------------------------------------------


def test_bm25_search_finds_what_scoring_everything_finds():
    rng = random.Random(4)
    items = [(i, prose(100 + i, rng.randint(12, 60))) for i in range(90)]
    index = decontaminate.Index.of(items)
    texts = [prose(i, 150) + " " + items[rng.randrange(90)][1] + " " + prose(900 + i, 80) for i in range(40)]
    found = decontaminate.search(texts, index)
    for text, hits in zip(texts, found, strict=True):
        words, best = decontaminate.words_of(text), {}
        for a in range(0, max(1, len(words) - index.window), index.window):
            query = {index.terms[w] for w in words[a : a + 2 * index.window] if w in index.terms}
            scores = Counter()
            for t in query:
                for item, impact in zip(*index.postings(t)[:2], strict=True):
                    scores[item] += impact
            for item, s in scores.items():
                if s >= decontaminate.THRESHOLD:
                    best[item] = max(best.get(item, 0), s)
        assert {h[0] for h in hits} == set(best)
    assert all(h for h in found)


def test_scores_do_not_depend_on_the_shards(spark, monkeypatch):
    rng = random.Random(6)
    items = [(i, prose(100 + i, rng.randint(12, 60)) + ". " + prose(300 + i, 5) + ".") for i in range(40)] + [(90, None), (91, "")]
    bench = spark.createDataFrame([*items, (None, "no id")], "item_id long, text string")
    texts = [prose(i, 60) + " " + " ".join(items[rng.randrange(40)][1].split()[: rng.randint(8, 60)]) + " " + prose(700 + i, 40) for i in range(50)] + [None, ""]
    run = lambda: sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in decontaminate.matches(docs(spark, texts), bench).collect())
    clean = lambda: sorted(r["doc_id"] for r in decontaminate.without_leaks(docs(spark, texts, extra=1), bench).collect())
    whole, kept = run(), clean()
    monkeypatch.setattr(decontaminate, "SHARD_ITEMS", 7)
    assert whole and run() == whole and clean() == kept
    assert kept == sorted(set(range(52)) - {r[0] for r in whole if r[-1]})


def test_overlaps_by_sets():
    question, answer = decontaminate.question_and_answer("One two three four? Two is it. Yes five six!")
    assert question == b"one two three four two is it".split() and answer == b"yes five six".split()
    whole = {tuple(b"one two three four nine".split()[k : k + 3]) for k in range(3)}
    assert decontaminate.overlap(decontaminate.grams(question), whole) == 2 / 5


def test_leaks_need_question_and_answer(spark):
    question, answer = prose(1, 30) + ".", prose(2, 6) + "."
    bench = spark.createDataFrame([(5, f"{question} {answer}")], "item_id long, text string")
    texts = [prose(3, 90) + f" {question.upper()}\n{answer} " + prose(4, 90), prose(3, 90) + f" {question} " + prose(4, 90), prose(6, 200)]
    rows = decontaminate.query(docs(spark, texts), bench).collect()
    assert [(r["doc_id"], r["leaked"]) for r in sorted(rows, key=lambda r: r["doc_id"])] == [(0, True), (1, False)]


def test_a_leak_is_not_hidden_by_a_larger_overlap(spark):
    """One passage has the whole question and half of the answer, another most of both: only the second leaks."""
    question, answer = prose(41, 30).split(), [f"answer{i}" for i in range(8)]
    bench = spark.createDataFrame([(5, " ".join(question) + ". " + " ".join(answer) + ".")], "item_id long, text string")
    first, second = " ".join(question + answer[:4]), " ".join(question[:22] + answer[:6])
    far = prose(43, 200)
    rows = decontaminate.query(docs(spark, [f"{first} {far}", f"{first} {far} {second} {prose(44, 90)}", f"{second} {far} {first}"]), bench).orderBy("doc_id").collect()
    assert [r["leaked"] for r in rows] == [False, True, True]
    assert rows[0]["question_overlap"] == 1 and rows[1]["answer_overlap"] == 0.75


# --- 2 URL filters -------------------------------------------------------------------------------------


def test_url_intervals(spark):
    entries = spark.createDataFrame(
        [("l", "domain", "Bad.example", "block", 10, "add"), ("l", "domain", "bad.example", "block", 20, "remove"), ("l", "domain", "bad.example", "block", 30, "add"),
         ("l", "domain", "bad.example", "block", 30, "remove"), ("m", "prefix", "a.bad.example/ok", "allow", 0, "add"), ("n", "host", "x.example", None, 5, None), ("n", "host", None, "block", 5, "add")],
        "list_name string, kind string, value string, effect string, at long, action string",
    )
    urls_ = ["http://a.bad.example/x", "http://a.bad.example/ok/y?z", "http://notbad.example/", "ftp://user@x.example:80", "http://y.x.example/", None, "no url", ""]
    rows = [(i, u, t) for i, u in enumerate(urls_) for t in (4, 9, 10, 19, 20, 30, None)]
    captures = spark.createDataFrame([*rows, rows[0]], "page_id long, url string, fetched_at long").withColumn("effect", F.lit("clash"))
    found = urls.judge(captures, entries)
    assert found.count() == len(rows) + 1
    got = {(r["page_id"], r["fetched_at"]): r["effect"] for r in found.collect()}
    want = lambda i, t: {0: "block" if 10 <= t < 20 or t >= 30 else "none", 1: "allow", 3: "block" if t >= 5 else "none"}.get(i, "none")
    assert got == {(i, t): "none" if t is None else want(i, t) for i, _, t in rows}


def test_hot_values_are_dealt_out(spark, monkeypatch):
    """The same verdicts whether a value's captures are in one part or in many."""
    pages = spark.createDataFrame([(i, f"http://h{i % 3}.example.com/a/{i % 5}") for i in range(400)] + [(None, None), (7, "nonsense")], "page_id long, url string")
    run = lambda: sorted(map(str, urls.query(pages).collect()))
    whole = run()
    monkeypatch.setattr(urls, "PART_ROWS", 20)
    assert len(whole) == 402 and run() == whole


# --- 3 chat formatting ---------------------------------------------------------------------------------

TRICKY = ["", "### a", "\\### b", "####  c </turn> d", "\\\\</turn>", "x\n</turn>\n### user:\n", "日本\\", "\\", "</turn></turn>", "a" * 300, None]


def test_chat_round_trip(spark):
    rng = random.Random(1)
    rows = [(c, t, rng.choice(["user", "assistant", "sys\ntem:", None, "### x"]), rng.choice(TRICKY)) for c in range(40) for t in range(rng.randint(1, 9))]
    rows += [(None, 0, "user", "x"), (None, 0, "assistant", "y"), (7, None, "assistant", "first")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("piece", F.lit(9))
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        by[conv].append((-1 if turn is None else turn, role or "", text or ""))
    for r in chat.format_chats(turns).collect():
        said = [(role, text) for _, role, text in sorted(by[r["conv_id"]], key=lambda x: x[0])]
        assert sorted(chat.parse(r["formatted"])) == sorted(said) and r["n_turns"] == len(said)
        masked = [chat.unescape(r["formatted"][s["start"] : s["end"]]) for s in r["loss_spans"]]
        assert sorted(masked) == sorted(t for role, t in said if role == "assistant")


def test_assembly_is_what_plain_escaping_gives():
    import pyarrow as pa

    roles, texts = ["user"] * len(TRICKY), TRICKY
    out, offsets, starts, ends = chat.assemble(pa.array(roles), pa.array(texts, pa.string()))
    raw = out.tobytes()
    for k, text in enumerate(texts):
        assert raw[starts[k] : ends[k]].decode() == chat.escape(text or "")
        assert raw[offsets[k] : offsets[k + 1]].decode() == f"### user:\n{chat.escape(text or '')}\n</turn>\n"


def test_long_conversations_come_in_pieces(spark, monkeypatch):
    rows = [(1, t, "assistant" if t % 2 else "user", prose(t, 50)) for t in range(1500)] + [(2, 0, "user", "x")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    monkeypatch.setattr(chat, "PIECE_BYTES", 20_000)
    assert chat.format_chats(turns).count() > 2
    row = chat.read_back(chat.format_chats(turns)).where("conv_id = 1").first()
    assert row["n_turns"] == 1500
    assert row["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{t}\n" for c, _, r, t in rows if c == 1).encode()).hexdigest()


# --- 4 repeated passages -------------------------------------------------------------------------------


def covered(texts):
    places = defaultdict(list)
    for d, x in enumerate(texts):
        for i in range(len(x) - repeats.BYTES.least + 1):
            places[x[i : i + repeats.BYTES.least]].append((d, i))
    out = [bytearray(len(x)) for x in texts]
    for p in places.values():
        if len(p) > 1:
            for d, i in p:
                out[d][i : i + repeats.BYTES.least] = b"\1" * repeats.BYTES.least
    return out


def repeated_texts(seed, n=24):
    rng = random.Random(seed)
    shared = [prose(1000 + k, rng.randint(50, 200)) for k in range(4)]
    texts = [" ".join(rng.choice(shared) if rng.random() < 0.4 else prose(rng.randrange(10**6), rng.randrange(100)) for _ in range(rng.randint(1, 4))) for _ in range(n)]
    return [*texts, texts[0], "ab" * 600, "é" * 300, "x" + "é" * 300, "short"]


@pytest.mark.parametrize("group_max", [8192, 2])
def test_repeats_against_brute_force(spark, monkeypatch, group_max):
    """With a small bound for groups most anchors are divided first, down to single distances."""
    monkeypatch.setattr(repeats, "GROUP_MAX", group_max)
    texts = repeated_texts(group_max)
    raw = [t.encode() for t in texts]
    rows = {r["doc_id"]: r for r in repeats.query(docs(spark, texts)).collect()}
    for d, (x, marks) in enumerate(zip(raw, covered(raw), strict=True)):
        kept = bytes(b for b, m in zip(x, marks, strict=True) if not m)
        runs = sum(1 for run in bytes(marks).split(b"\0") if run)
        r = rows[d]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == (len(x), sum(marks), runs, hashlib.sha256(kept).hexdigest())


def test_passages_are_reported_beside_the_bytes(spark):
    """A passage of 51 words and under 400 bytes is not removed but reported, one of 50 words is neither."""
    rng = random.Random(51)
    passage = " ".join(rng.choice("abcdefgh") + str(rng.randrange(90)) for _ in range(51))
    texts = [prose(1, 40) + " " + passage, passage + " " + prose(2, 40), passage.split(" ", 1)[1], prose(3, 90), None]
    rows = repeats.query(docs(spark, texts)).orderBy("doc_id").collect()
    assert [(r["n_passages"], r["passage_words"], r["n_removed"]) for r in rows] == [(1, 51, 0), (1, 51, 0), (0, 0, 0), (0, 0, 0), (0, 0, 0)]


def test_maximal_repeats_have_all_occurrences():
    passage, other = prose(1, 90).encode(), prose(2, 90).encode()
    strings = [b"1" + passage[:500] + b"2", b"3" + passage[:500] + b"4", b"5" + passage[:500] + b"6" + b"pad" * 20, other[:520]]
    found = [(n, sorted(zip(o.tolist(), p.tolist(), strict=True))) for n, o, p in repeats.maximal_repeats([np.frombuffer(x, np.uint8) for x in strings])]
    assert found == [(500, [(0, 1), (1, 1), (2, 1)])]


def test_text_stays_valid(spark):
    passage = "é" * 400
    left = repeats.remove_repeats(docs(spark, ["1" + passage + "a", "2" + passage + "b", "日" + prose(5, 20)])).orderBy("doc_id").collect()
    assert [r["text"] for r in left] == ["1a", "2b", "日" + prose(5, 20)]


@pytest.mark.parametrize("words", [50, 51, 64])
def test_passages_of_over_fifty_words(spark, words):
    """Short words, so that the passage is far below 400 bytes; in the text, at its ends, with other separators and punctuation around."""
    rng = random.Random(words)
    passage = [rng.choice("abcdefgh") + str(rng.randrange(90)) + rng.choice([",", "", "", "."]) for _ in range(words - 1)] + ["end"]
    plain, other = " ".join(passage), "\n ".join(passage)
    texts = [prose(1, 70) + " " + plain + " " + prose(2, 70), prose(3, 40) + " (" + other + ") " + prose(4, 30), plain, prose(5, 90), "日本 " + plain + "! " + prose(6, 9), None, ""]
    assert len(plain) < repeats.BYTES.least
    left = [r["text"] for r in repeats.remove_repeats(docs(spark, texts), words=True).orderBy("doc_id").collect()]
    if words == 50:
        assert left == texts
    else:
        assert left == [prose(1, 70) + "  " + prose(2, 70), prose(3, 40) + " () " + prose(4, 30), "", texts[3], "日本 ! " + prose(6, 9), None, ""]
    assert [r["text"] for r in repeats.remove_repeats(docs(spark, texts)).orderBy("doc_id").collect()] == texts


@pytest.mark.parametrize("group_max", [8192, 1])
def test_word_passages_against_counting(spark, monkeypatch, group_max):
    monkeypatch.setattr(repeats, "GROUP_MAX", group_max)
    rng = random.Random(7)
    pool = [prose(800 + i, 75).split() for i in range(4)]
    texts = []
    for i in range(30):
        words = prose(i, rng.randrange(40)).split()
        for _ in range(2):
            a, p = rng.randrange(25), rng.choice(pool)
            words += p[a : a + rng.randrange(45, 60)] + prose(100 * i + a + 3000, 5).split()
        texts.append(" ".join(words))
    windows = defaultdict(list)
    for d, t in enumerate(texts):
        w = t.split()
        for k in range(len(w) - repeats.WORDS.least + 1):
            windows[tuple(w[k : k + repeats.WORDS.least])].append((d, k))
    gone = {(d, k + i) for places in windows.values() if len(places) > 1 for d, k in places for i in range(repeats.WORDS.least)}
    base = repeats.keyed(docs(spark, texts))
    found = {r["_id"]: repeats.merge([(s["lo"], s["hi"]) for s in r["_spans"]]) for r in repeats.covered_spans(base, repeats.WORDS).collect()}
    ours = set()
    for d, spans in found.items():
        raw = texts[d].encode()
        for a, b, _ in repeats.word_spans(raw, spans):
            first = len(raw[:a].split())
            ours |= {(d, first + i) for i in range(len(raw[a:b].split()))}
    assert gone and ours == gone


# --- 5 licenses ------------------------------------------------------------------------------------------


def test_licenses(spark):
    mit = licenses.TEMPLATES["MIT-text"]
    texts = [prose(1, 50) + " " + mit.replace("free of charge", "free of any charge") + " " + prose(2, 30), "Released under the MIT License.", prose(3, 200), mit[:60], None, "",
             "Released under an MIT License", licenses.TEMPLATES["MIT-whole"][400:800]]
    rows = sorted((r["doc_id"], r["license"], r["coverage"], r["first_word"], r["last_word"]) for r in licenses.query(docs(spark, texts)).collect())
    n = len(licenses.words_of(mit))
    assert [r[:2] for r in rows] == [(0, "MIT-text"), (1, "MIT"), (6, "MIT"), (7, "MIT-whole")]
    assert rows[0][2:] == (1.0, 50, 50 + n + 1) and rows[1][2:] == (1.0, 0, 5)
    assert rows[2][2] == 0.8 and 0.2 < rows[3][2] < 0.8


def whole_table(template, text):
    """Best score and most matches of a local alignment, over the whole table."""
    cells = [[(0, 0)] * (len(text) + 1) for _ in range(len(template) + 1)]
    for i in range(1, len(template) + 1):
        for j in range(1, len(text) + 1):
            same = template[i - 1] == text[j - 1]
            options = [(0, 0), (cells[i - 1][j - 1][0] + (2 if same else -1), cells[i - 1][j - 1][1] + same)]
            options += [(c[0] - 1, c[1]) for c in (cells[i - 1][j], cells[i][j - 1]) if c[0] > 1]
            cells[i][j] = max(options)
    return max(c for row in cells for c in row)


def test_banded_alignment_against_the_whole_table():
    rng = random.Random(2)
    for _ in range(60):
        a = [rng.randrange(1, 6) for _ in range(rng.randint(3, 14))]
        b = [x for x in a if rng.random() > 0.15]
        for _ in range(rng.randrange(3)):
            b.insert(rng.randrange(len(b) + 1), 9)
        b = [0] * rng.randrange(4) + b + [0] * 3
        matched, begin, end = licenses.align(np.array(a), np.array(b), 0, band=30)  # a band that holds the whole table
        assert matched == whole_table(a, b)[1]
        # the span alone gives the same alignment
        assert not matched or whole_table(a, b[begin:end]) == whole_table(a, b)


def test_every_text_with_enough_of_a_template_is_a_candidate():
    """All ways to lose a fifth of a short template's words, and many of the longer ones'."""
    from itertools import combinations

    known, rng = licenses.Templates(licenses.TEMPLATES), random.Random(1)
    for name, template in licenses.TEMPLATES.items():
        words = [w.decode() for w in licenses.words_of(template)]
        lost = len(words) - math.ceil(licenses.COVERAGE * len(words))
        ways = list(combinations(range(len(words)), lost)) if len(words) < 12 else [rng.sample(range(len(words)), lost) for _ in range(15)]
        for way in ways:
            text = " ".join(["other"] + ["changed" if k in way else w for k, w in enumerate(words)] + ["end"])
            assert known.names.index(name) in _hits(text, known), (name, way)


def _hits(text, known):
    """Templates with a gram in the text."""
    words = licenses.words_of(text)
    codes = np.array([known.number.get(w, 0) for w in words])
    return {int(t) for gram, (hashes, template, _) in known.index.items() for t, h in zip(template, hashes, strict=True) if h in licenses.gram_hashes(codes, gram)}


def test_licenses_against_all_alignments(spark):
    """Every template aligned with every text over the whole table finds the same licenses."""
    rng, names = random.Random(8), [n for n, t in licenses.TEMPLATES.items() if len(t) < 260]
    texts = []
    for k in range(40):
        words = licenses.TEMPLATES[rng.choice(names)].split()
        words = [w if rng.random() > 0.12 else "other" for w in words]
        texts.append(prose(k, rng.randrange(12)) + " " + " ".join(words[rng.randrange(3) :]) + " " + prose(k + 99, 5))
    found = defaultdict(set)
    for r in licenses.licenses(docs(spark, texts), {n: licenses.TEMPLATES[n] for n in names}).collect():
        found[r["doc_id"]].add(r["license"])
    for d, text in enumerate(texts):
        for n in names:
            template = licenses.words_of(licenses.TEMPLATES[n])
            _, matched = whole_table(template, licenses.words_of(text))
            assert (n in found[d]) == (matched >= licenses.COVERAGE * len(template) or matched >= licenses.PART_WORDS), (n, text)


# --- 6 toxicity --------------------------------------------------------------------------------------------


def test_toxicity_learns_words_and_not_ids(spark):
    rng = random.Random(3)
    texts = [prose(i, 60) + (" you rotten villain " if i % 4 == 0 else " ") + prose(10**6 + i, 40) for i in range(600)]
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(600) if rng.random() < 0.8], "doc_id long, quality int, toxic int")
    rows = toxicity.query(docs(spark, texts), labels).collect()
    held = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    assert np.mean([r["predicted"] == (r["doc_id"] % 4 == 0) for r in held]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_fit_against_plain_ftrl():
    """One coordinate after the other, as the update is published, with the bias as one more coordinate without penalty."""
    rng = random.Random(12)
    examples = [(np.unique([rng.randrange(40) for _ in range(12)]).astype(np.int32), int(rng.random() < 0.4)) for _ in range(60)]
    z, n, bz, bn = defaultdict(float), defaultdict(float), 0.0, 0.0
    toxic = sum(y for _, y in examples)
    prior = math.log((toxic + 0.5) / (len(examples) - toxic + 1.5))
    a, b, l1, l2 = toxicity.ALPHA, toxicity.BETA, toxicity.L1, toxicity.L2
    weight = lambda i: 0.0 if abs(z[i]) <= l1 else (math.copysign(l1, z[i]) - z[i]) / ((b + math.sqrt(n[i])) / a + l2)
    bias = lambda: -bz / ((b + math.sqrt(bn)) / a)
    for _ in range(toxicity.EPOCHS):
        for at, y in examples:
            ws = {int(i): weight(int(i)) for i in at}
            g = (1 / (1 + math.exp(-(prior + bias() + sum(ws.values())))) - y) * (toxicity.POSITIVE_WEIGHT if y else 1.0)
            for i, w in ws.items():
                sigma = (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / a
                z[i] += g - sigma * w
                n[i] += g * g
            sigma = (math.sqrt(bn + g * g) - math.sqrt(bn)) / a
            bz, bn = bz + g - sigma * bias(), bn + g * g
    model = toxicity.fit(examples)
    expected = {i: weight(i) for i in list(z) if weight(i)}
    assert expected and dict(zip(model.at.tolist(), model.weight.tolist(), strict=True)) == pytest.approx(expected, rel=1e-5)
    assert model.bias == pytest.approx(prior + bias())


def test_features_by_plain_hashing():
    """The same word, pair or skip-gram has the same number wherever it is; the three kinds are told apart."""
    h = toxicity.WordHashes()
    f = lambda t: set(toxicity.features(t, h).tolist())
    one, two, three = f("a"), f("a b"), f("a b c")
    assert len(one) == 1 and len(two) == 3 and len(three) == 6
    assert one < two < three and f("x a b") >= two and f("A, b! (c)") == three and f(None) == f("") == set()


def test_scores_do_not_depend_on_the_batch():
    model = toxicity.fit([(toxicity.features(prose(i, 30) + (" villain" if i % 2 else ""), toxicity.WordHashes()), i % 2) for i in range(200)])
    texts, hashes = [None, "", "villain", prose(1, 30) + " villain", "villain " * 5], toxicity.WordHashes()
    together = toxicity.score_texts(texts, model.dense(), model.bias, hashes)
    alone = [toxicity.score_texts([t], model.dense(), model.bias, hashes)[0] for t in texts]
    assert np.allclose(together, alone) and together[2] > 0.5 > together[0]
    assert len(model.at) < 200


def test_giant_texts_do_not_empty_the_sample(spark, monkeypatch):
    """A labelled text beyond the sample's bound comes first in the order; the others still fit the model."""
    monkeypatch.setattr(toxicity, "MAX_TRAIN_CHARS", 1 << 18)
    monkeypatch.setattr(toxicity, "MAX_TEXT_CHARS", 1 << 11, raising=False)
    ids = spark.range(200).where(toxicity.fold_of(F.col("id"), toxicity.HELD_OUT_FOLDS) != 0)
    first = ids.orderBy(F.xxhash64(F.lit(11), "id")).first()["id"]
    texts = [prose(i, 40) + (" rotten villain" if i % 4 == 0 else "") for i in range(200)]
    texts[first] += " " + prose(300, 40_000)
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(200)], "doc_id long, quality int, toxic int")
    rows = toxicity.query(docs(spark, texts), labels).where(F.col("doc_id") != first).collect()
    assert len(texts[first]) > toxicity.MAX_TRAIN_CHARS
    assert np.mean([r["predicted"] == (r["doc_id"] % 4 == 0) for r in rows]) > 0.97


# --- 7 language --------------------------------------------------------------------------------------------


def test_profiles_by_plain_counting():
    text = "Zwei  Öfen, zwei 3 Katzen!"
    words = "".join(c if c.isalpha() else " " for c in text.lower()).split()
    counts = Counter(g for w in words for n in (1, 2, 3) for g in ["".join(x) for x in zip(*[f"_{w}_"[k:] for k in range(n)])] if g != "_")
    keys, n = language.count_grams(text)
    code = lambda g: sum((1 if c == "_" else ord(c) + 2) << 21 * k for k, c in enumerate(reversed(g)))
    assert dict(zip(keys.tolist(), n.tolist(), strict=True)) == {code(g): c for g, c in counts.items()}


def plain_profile(text):
    """n-grams of letters and boundaries (a space) by falling count, then by code points."""
    runs = "".join(c if c.isalpha() else " " for c in (text or "").lower()).split()
    counts = Counter()
    padded = " " + " ".join(runs) + " " if runs else ""
    for n in (1, 2, 3):
        for k in range(len(padded) - n + 1):
            gram = padded[k : k + n]
            if gram != " " and " " not in gram[1:-1]:
                counts[gram] += 1
    code = lambda c: 1 if c == " " else ord(c) + 2
    key = lambda g: sum(code(c) << 21 * (len(g) - 1 - i) for i, c in enumerate(g))
    return [g for g, _ in sorted(counts.items(), key=lambda x: (-x[1], key(x[0])))][: language.PROFILE], key


def test_distance_by_plain_ranks():
    samples = {"en": prose(1, 400), "xx": " ".join(w[::-1] for w in prose(2, 300).split()), "yy": "où est l'été à Noël ñandú " * 30}
    profiles = {lang: plain_profile(t)[0] for lang, t in samples.items()}
    key = plain_profile("a")[1]
    known = language.Profiles({lang: [key(g) for g in grams] for lang, grams in profiles.items()})
    for text in [prose(5, 30), " ".join(w[::-1] for w in prose(9, 12).split()), "l'été à", "日本語", "a"]:
        own = plain_profile(text)[0]
        assert [key(g) for g in own] == language.top(*language.count_grams(text)).tolist()
        distance = {lang: sum(abs(grams.index(g) - i) if g in grams else language.PROFILE for i, g in enumerate(own)) for lang, grams in profiles.items()}
        best = min(sorted(distance), key=distance.get)
        assert known.predict(text) == (best, pytest.approx(1 - distance[best] / (language.PROFILE * len(own))))
    assert known.predict(None) == known.predict("123 !") == ("und", 0.0)


def test_long_texts_are_counted_in_slices(monkeypatch):
    text = prose(1, 4000)
    whole = language.count_grams(text)
    monkeypatch.setattr(language, "SLICE", 1000)
    assert all((a == b).all() for a, b in zip(whole, language.count_grams(text), strict=True))


def test_languages(spark):
    rows = [(i, [" ".join(random.Random(i).choices(w, k=30)) for w in (PROSE, "der die das und nicht mit auf eine straße über".split())][i % 2], ["en", "de"][i % 2], "s", 0) for i in range(200)]
    df = spark.createDataFrame([*rows, (900, None, None, "s", 0), (901, "12 !", "de", "s", 0)], DOC)
    found = {r["doc_id"]: r for r in language.query(df).collect()}
    assert all(found[i]["lang_pred"] == lang for i, _, lang, *_ in rows)
    assert found[900]["lang_pred"] == found[901]["lang_pred"] == "und" and found[901]["score"] == 0.0


# --- 8 mixing ----------------------------------------------------------------------------------------------


def test_targets_by_filling_up(spark):
    rng = random.Random(8)
    for _ in range(6):
        sizes = {f"s{k}" if k else None: rng.choice([0, 3, 50, 1000, 40_000]) for k in range(rng.randint(1, 7))}
        names = sorted((n for n in sizes if n is not None)) + [None] * (None in sizes)
        weight = {n: k % 3 + 1 for k, n in enumerate(names)}
        target, open_, left = {}, list(names), sum(sizes.values())
        while open_:
            level = left / sum(weight[n] for n in open_)
            over = [n for n in open_ if level * weight[n] > 3 * sizes[n]]
            for n in over or open_:
                target[n] = 3 * sizes[n] if over else level * weight[n]
                left -= target[n] if over else 0
            open_ = [n for n in open_ if n in over and False or n not in target]
        df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
        assert {r["source"]: pytest.approx(r["target"]) for r in mixing.source_targets(df).collect()} == target


def test_mix_is_near_its_targets_and_repeatable(spark):
    rng = random.Random(9)
    rows = [(i, prose(i, rng.randint(1, 40)), None, rng.choice(["a", "a", "a", "b", "c", None]), 0) for i in range(3000)]
    df = spark.createDataFrame(rows, DOC)
    found = mixing.query(df).toPandas()
    assert (found["taken"] <= 3 * found["size"]).all()
    by = found.assign(s=found["source_size"]).groupby("s").agg({"taken": "sum", "target": "first"})
    assert (abs(by["taken"] - by["target"]) / by["target"] < 0.03).all()
    again = mixing.query(df.repartition(7)).toPandas()
    assert found.sort_values("doc_id").reset_index(drop=True).equals(again.sort_values("doc_id").reset_index(drop=True))
    assert mixing.emit(mixing.mix(df)).count() == int((found["taken"] / found["size"]).sum())


def test_equal_ids_and_null_ids_have_one_order(spark):
    """Rows of one id and size are told apart by their text, so reruns agree."""
    rows = [(5 if i % 2 else None, f"a b {i}", None, "s", 0) for i in range(600)] + [(None, None, None, None, None), (1, "", None, "z", 0)]
    df = spark.createDataFrame(rows, DOC).withColumn("_size", F.lit("clash")).withColumn("_rank", F.lit(1))
    run = lambda d: sorted((r["text"] or "", r["_copies"]) for r in mixing.mix(d).collect())
    first = run(df.repartition(3))
    assert first == run(df.repartition(7)) and len(first) == 602 and {c for t, c in first if t == ""} == {0}


# --- components ----------------------------------------------------------------------------------------------


def rooted(edges):
    root = {}
    for u, v in edges:
        root.setdefault(u, u), root.setdefault(v, v)
    changed = True
    while changed:
        changed = False
        for u, v in edges:
            low = min(root[u], root[v])
            changed |= root[u] != low or root[v] != low
            root[u] = root[v] = low
    return root


def test_components_against_relabelling(spark):
    rng = random.Random(4)
    path = [(i, i + 1) for i in range(60)]
    mixed = [(i, i + 1) for i in rng.sample(range(200, 300), 100)]
    star = [(500, 510 + i) for i in range(20)] + [(999, 600 + i) for i in range(20)]
    loose = [(1000 + rng.randrange(80), 1000 + rng.randrange(80)) for _ in range(50)]
    edges = path + mixed + star + loose + [(-5, -5), (-3, -4), (-4, -3), (7, 6)]
    found = graph.components(spark.createDataFrame(edges, "u long, v long"))
    assert {r["node"]: r["root"] for r in found.collect()} == rooted(edges)
    assert graph.components(spark.createDataFrame([], "u long, v long")).count() == 0


# --- 9 SimHash ---------------------------------------------------------------------------------------------


def fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 4]), 42) for i in range(max(1, len(words) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BUCKET_MAX", 3)  # so that most buckets are dealt out in tiles
    rng = random.Random(5)
    texts = [prose(i, rng.randint(0, 120)) for i in range(60)]
    for i in range(60):
        words = texts[i].split()
        if len(words) > 30:
            words[rng.randrange(len(words))] = "Changed"
        texts.append(" ".join(words))
    texts += [None, "", "  \n", "One two"]
    f = [fingerprint(t) for t in texts]
    root = list(range(len(f)))
    for i in range(len(f)):
        for j in range(i):
            if (f[i] ^ f[j]).bit_count() <= 4 and root[i] != root[j]:
                a, b = max(root[i], root[j]), min(root[i], root[j])
                root = [b if r == a else r for r in root]
    assert len(set(root)) < len(root) - 20
    rows = {r["doc_id"]: r for r in simhash.query(docs(spark, texts)).collect()}
    assert [(rows[i]["fingerprint"], rows[i]["component_id"]) for i in range(len(f))] == [(f"{f[i]:016x}", root[i]) for i in range(len(f))]


def test_bit_sliced_distances():
    rng = np.random.default_rng(3)
    for words, radius in ((1, 4), (2, 27), (1, 0), (1, 7)):
        base = rng.integers(0, 1 << 62, (8, words)).astype(np.uint64)
        values = base[rng.integers(0, 8, 150)]
        for _ in range(radius + 2):
            at = rng.integers(0, words, 150)
            values[np.arange(150), at] ^= np.where(rng.random(150) < 0.6, np.uint64(1) << rng.integers(0, 64, 150).astype(np.uint64), np.uint64(0))
        label = simhash.link_rows(np.zeros(150, np.int64), np.full(150, 2), values, radius)
        near = np.bitwise_count(values[:, None] ^ values[None]).sum(-1) <= radius
        reach = near.copy()
        for _ in range(8):
            reach = (reach.astype(int) @ reach.astype(int)) > 0
        assert (label == reach.argmax(1)).all()


@pytest.mark.parametrize("rows", [0, 1 << 30, 1 << 37])
def test_every_pair_within_the_radius_shares_a_block(rows):
    masks = [m[0] % (1 << 64) for m in simhash.block_masks(4, simhash.blocks_for(rows))]
    assert min(m.bit_count() for m in masks) >= rows.bit_length() - simhash.BUCKET_BITS
    rng = random.Random(1)
    for _ in range(3000):
        flips = sum(1 << b for b in rng.sample(range(64), 4))
        assert any(not flips & m for m in masks)


def kept_ids(df):
    kept = simhash.near_duplicates(df).where("_keep")
    return {r["doc_id"] for r in df.select("doc_id", simhash.row_key()).join(kept, "row", "left_semi").collect()}


def test_more_rows_get_longer_keys_and_find_as_much():
    agree = 1 - 19.5 / 128
    for rows in (0, 1000, 1 << 24, 1 << 30, 1 << 36):
        tables, bits = simhash.tables_for(rows)
        assert bits >= 16 and rows >> bits <= 1 << simhash.BUCKET_BITS
        assert (1 - agree**bits) ** tables <= (1 - agree**16) ** 96 * 1.0001


@pytest.mark.parametrize("fullness", [8, -16])  # -16: keys as for 2^30 rows
def test_stage_finds_near_duplicates(spark, monkeypatch, fullness):
    monkeypatch.setattr(simhash, "BUCKET_BITS", fullness)
    rng = random.Random(6)
    texts = [prose(i, 200) for i in range(60)]
    for i in range(60):
        words = texts[i].split()
        for k in rng.sample(range(200), 4):  # four of 200 words: 20 of 196 shingles
            words[k] = f"new{k}"
        texts.append(" ".join(words))
    kept = kept_ids(docs(spark, texts))
    assert set(range(60)) <= kept and len(kept) <= 68  # just above the least similarity most are found, not all


def test_stage_links_only_what_is_similar(spark):
    """Loose texts have near fingerprints by their repeated words or share half their shingles; no pair is similar."""
    rng = random.Random(8)
    base = prose(1, 200).split()
    texts = [" ".join(w for w in prose(i, 12).split() for _ in range(100)) for i in range(20)]  # junk: repeated words
    for _ in range(20):
        words = list(base)
        for k in rng.sample(range(200), 8):
            words[k] = f"other{rng.randrange(10**6)}"
        texts.append(" ".join(words))
    texts += [texts[20].replace(" ", "\n"), texts[21] + " more", "", None]
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in ((t or "").split() for t in texts)]
    drop = {j for i in range(44) for j in range(i + 1, 44) if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])}
    kept = kept_ids(docs(spark, texts))
    assert drop == {40, 41, 43} and kept == set(range(44)) - drop


@pytest.mark.parametrize("sets_max", [4096, 7])
def test_similar_sets_in_one_task_and_in_tiles(spark, monkeypatch, sets_max):
    monkeypatch.setattr(simhash, "SETS_MAX", sets_max)
    rng = random.Random(9)
    texts = []
    for i in range(40):
        words = prose(3, 120).split()
        for k in rng.sample(range(120), rng.randrange(5)):
            words[k] = f"x{i}"
        texts.append(" ".join(words))
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (t.split() for t in texts)]
    label = list(range(40))
    for i in range(40):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                a, b = sorted((label[i], label[j]))
                label = [a if x == b else x for x in label]
    ours = simhash.similar_sets([simhash.shingle_set(t, 5, 42) for t in texts], [2] * 40, (4, 5))
    assert ours.tolist() == label
    found = docs(spark, texts).select(F.col("doc_id").alias("row"), "text", F.col("doc_id").alias("node"), F.lit(0).cast("long").alias("component"), F.lit(116).cast("long").alias("size"))
    linked = list(range(40))
    for r in simhash.similar(found.select("row", "text"), found.drop("text")).collect():
        a, b = sorted((linked[r["u"]], linked[r["v"]]))
        linked = [a if x == b else x for x in linked]
    assert linked == label


# --- 10 fingerprints ---------------------------------------------------------------------------------------


def test_digest_against_plain_counting(monkeypatch):
    texts = [b"", b"ab", b"abc", prose(1, 50).encode(), prose(2, 400).encode(), bytes(range(256)) * 4]
    mult, mask = [int(x) for x in digests._MULTIPLIERS], (1 << 32) - 1
    for text, counts in zip(texts, digests.bucket_counts(texts), strict=True):
        plain = [0] * digests.BUCKETS
        for n, offsets in enumerate(digests.TRIPLETS):
            for i in range(len(text) - offsets[2]):
                h = sum(text[i + o] * m for o, m in zip(offsets, mult, strict=True)) & mask
                h ^= h >> 15
                plain[(h * (2246822519 + 2 * n) & mask) >> 25] += 1
        assert counts.tolist() == plain
    before = digests.bucket_counts(texts)
    monkeypatch.setattr(digests, "SLICE", 64)
    assert (digests.bucket_counts(texts) == before).all()


def test_digest_text_form_and_likeness():
    d = digests.digests([prose(1, 100).encode(), prose(1, 101).encode(), prose(77, 100).encode(), b""])
    assert all((digests.from_hex(h) == row).all() for h, row in zip(digests.as_hex(d), d, strict=True))
    assert digests.likeness(d, d).tolist() == [1.0] * 4
    assert digests.likeness(d[:1], d[1:2])[0] > 0.9 > digests.likeness(d[:1], d[2:3])[0]


def test_quartiles_and_likeness_by_plain_counting():
    rng = random.Random(3)
    texts = [prose(k, rng.randrange(1, 200)).encode() for k in range(12)] + [b"", b"ab", b"a" * 300]
    made = digests.digests(texts)
    for text, counts, digest in zip(texts, digests.bucket_counts(texts).tolist(), made, strict=True):
        ordered = sorted(counts)
        q = [ordered[31], ordered[63], ordered[95]]
        assert digest[2:].tolist() == [sum(c > x for x in q) for c in counts]
        assert digest[0] == min(255, math.floor(math.log1p(len(text)) / math.log(1.2)))
        assert digest[1] == q[0] * 15 // max(1, q[2]) * 16 + q[1] * 15 // max(1, q[2])
    for a, b in zip(made[:-1], made[1:], strict=True):
        x, y = [list(map(int, d)) for d in (a, b)]
        steps = [abs(p - q) for p, q in zip(x[2:], y[2:], strict=True)]
        length = abs(x[0] - y[0])
        total = sum(6 if d == 3 else d for d in steps) + (length if length <= 1 else 4 * (length - 1)) + abs((x[1] >> 4) - (y[1] >> 4)) + abs((x[1] & 15) - (y[1] & 15))
        assert digests.likeness(a[None], b[None])[0] == pytest.approx(max(0.0, 1 - total / digests.BOUND))


@pytest.mark.parametrize("n", [0, 1, 2, 3, 10, 37])
def test_ranges_in_two_steps(spark, n):
    cuts = sorted(random.Random(n).sample(range(-50, 50), n))
    rows = spark.range(-55, 55).select("id", digests.bucket_of(F.col("id"), cuts).alias("b")).collect()
    assert all(r["b"] == sum(c <= r["id"] for c in cuts) for r in rows)


def test_successors_in_order_of_ids(spark):
    ids = [5, -3, 10**12, 7, 0, 44, None]
    rows = [(i, prose(k, 20 + k), None, None, 0) for k, i in enumerate(ids)]
    found = {r["doc_id"]: r for r in digests.query(spark.createDataFrame(rows, DOC)).collect()}
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    for k, (i, text, *_) in enumerate(order):
        after, n = order[(k + 1) % len(order)][1], len(text) // 4
        edited = text[: len(text) - n] + after[:n]
        assert found[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest() and found[i]["n_chars"] == len(text)
        assert found[i]["near_edited"] > found[i]["near_next"]


def test_labels_never_enter_the_table(spark):
    assert "label" not in table(spark, SF, "documents").columns
