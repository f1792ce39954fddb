"""Scalar text functions as Column expressions; Arrow UDFs only where no built-in exists.

UDFs are made where they are used: one that was used once holds on to the JVM, and tasks carry this
module with them (see the package).
"""

from __future__ import annotations

import re
import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# Code point ranges, which differ from use to use on purpose.
JAPANESE = r"[\x{3040}-\x{30FF}\x{FF66}-\x{FF9D}\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}]"
KANJI_RUN = r"[\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{F900}-\x{FAFF}\x{20000}-\x{2A6DF}\x{2A700}-\x{2B73F}\x{2B740}-\x{2B81F}\x{2B820}-\x{2CEAF}]+"
RUBY_KANJI = r"\x{4E00}-\x{9FFF}\x{3005}"
CJK = r"[\x{3040}-\x{30FF}\x{4E00}-\x{9FFF}]"
RESERVED = r"[\x{E000}-\x{E01F}]"
REFUSAL = r"(?iU)\b(I('?m| am| cannot| can't)|sorry|as an ai|unable to)\b"
#: The same where only ASCII letters, digits and _ make words, as in DuckDB's expressions; there ſ is an s, and no part of a word.
_EDGE = r"(?:(?<=[0-9A-Za-z_])(?![0-9A-Za-z_])|(?<![0-9A-Za-z_])(?=[0-9A-Za-z_]))"
REFUSAL_ASCII = rf"(?i){_EDGE}(I('?m| am| cannot| can't)|[sſ]orry|a[sſ] an ai|unable to){_EDGE}"
TERMINATORS = "。！？!?"
OPENERS, CLOSERS = "「『（(〈《【〔", "」』）)〉》】〕"


def nfkc(text: Column) -> Column:
    """NFKC; ASCII text, which it never changes, is handed to the UDF as null."""

    @F.arrow_udf("string")
    def normalized(texts: pa.Array) -> pa.Array:
        made = [t if t is None or unicodedata.is_normalized("NFKC", t) else unicodedata.normalize("NFKC", t) for t in texts.to_pylist()]
        return pa.array(made, pa.string())

    plain = text.rlike(r"^[\x00-\x7F]*$")
    return F.when(plain, text).otherwise(normalized(F.when(~plain, text)))


def strip(text: Column) -> Column:
    """Without white space of any script at the ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def clean(text: Column) -> Column:
    """Normalization after NFKC: private-use and control characters go (tabs and newlines too), white space collapses."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"[\p{Cc}\p{Co}]", ""), r"(?U)\s+", " "))


def normalize_text(text: Column) -> Column:
    return clean(nfkc(text))


def count_pua(text: Column) -> Column:
    return F.length(text) - F.length(F.regexp_replace(text, r"\p{Co}", ""))


def has_japanese(text: Column) -> Column:
    return text.rlike(JAPANESE)


def latin_ratio(text: Column) -> Column:
    """ASCII letters over all letters; 0 without letters."""
    latin = F.length(F.regexp_replace(text, "[^A-Za-z]", ""))
    letters = F.length(F.regexp_replace(text, r"[^\p{L}]", ""))
    return F.coalesce(latin / F.nullif(letters, F.lit(0)), F.lit(0.0))


def casefold(text: Column) -> Column:
    """Full case folding of the letters that lower() alone leaves apart (ß and the like).

    The empty string in between keeps the optimizer from reading lower(upper(x)) as lower(x).
    """
    return F.lower(F.concat(F.upper(text), F.lit("")))


def dedup_key(ja: Column, en: Column) -> Column:
    return F.struct(F.replace(ja, F.lit(" "), F.lit("")).alias("ja"), F.replace(casefold(en), F.lit(" "), F.lit("")).alias("en"))


def split_paragraphs(text: Column) -> Column:
    parts = F.split(strip(text), r"\n[ \t\x{3000}]*\n+")
    return F.filter(F.transform(parts, strip), lambda p: p != "")


def sentences_of(paragraph: str) -> list[str]:
    """Cut after terminators outside quotes; closers right behind a terminator stay with it."""
    found, begin, depth, at = [], 0, 0, 0
    for piece in re.finditer(f"[{re.escape(OPENERS)}]|[{re.escape(TERMINATORS)}][{re.escape(CLOSERS)}]*|[{re.escape(CLOSERS)}]", paragraph):
        at, sign = piece.start(), piece[0][0]
        if sign in OPENERS:
            depth += 1
        elif sign in CLOSERS:
            depth = max(0, depth - 1)
        elif depth == 0:
            found.append(paragraph[begin : piece.end()])
            begin = piece.end()
        else:  # inside quotes the closers behind a terminator only close
            depth = max(0, depth - (len(piece[0]) - 1))
    found.append(paragraph[begin:])
    return [s for s in map(str.strip, found) if s]


def split_sentences(paragraph: Column) -> Column:
    @F.arrow_udf("array<string>")
    def cut(paragraphs: pa.Array) -> pa.Array:
        return pa.array([None if p is None else sentences_of(p) for p in paragraphs.to_pylist()], pa.list_(pa.string()))

    return cut(paragraph)


def ascii_only(text: Column) -> Column:
    """As many bytes as characters."""
    return F.length(text) == F.octet_length(text)


def contains_reserved(text: Column) -> Column:
    # most texts are told apart by their lengths, without the expression
    return ~ascii_only(text) & text.rlike(RESERVED)


def cjk_fraction(text: Column) -> Column:
    """Share of kana and common kanji; 1 for the empty text."""
    return F.coalesce((F.length(text) - F.length(F.regexp_replace(text, CJK, ""))) / F.nullif(F.length(text), F.lit(0)), F.lit(1.0))


def kanji_runs(text: Column) -> Column:
    return F.size(F.regexp_extract_all(text, F.lit(KANJI_RUN), F.lit(0)))


def kata_to_hira(text: Column) -> Column:
    return F.translate(text, _KATAKANA, _KATAKANA.translate(_HIRAGANA))


def ruby_segments(surface: Column) -> Column:
    """Runs of kanji and of anything else."""
    return F.regexp_extract_all(surface, F.lit(f"[{RUBY_KANJI}]+|[^{RUBY_KANJI}]+"), F.lit(0))


_KATAKANA = "".join(map(chr, range(0x30A1, 0x30F7)))
_HIRAGANA = {ord(c): ord(c) - 0x60 for c in _KATAKANA}
_RUNS = re.compile("([一-鿿々]+)")


def ruby_of(surface: str, reading: str) -> list[str] | None:
    """Readings of the kanji runs, aligned so that the kana between them match; [] without kanji, None if they don't align."""
    kana = _RUNS.split(surface.translate(_HIRAGANA))  # kana and kanji by turns
    if len(kana) == 1:
        return []
    match = re.fullmatch("(.+?)".join(map(re.escape, kana[::2])), reading.translate(_HIRAGANA))
    return list(match.groups()) if match else None


def align_ruby(surface: Column, reading: Column) -> Column:
    @F.arrow_udf("array<string>")
    def align(surfaces: pa.Array, readings: pa.Array) -> pa.Array:
        return pa.array([ruby_of(s or "", r or "") for s, r in zip(surfaces.to_pylist(), readings.to_pylist(), strict=True)], pa.list_(pa.string()))

    return align(surface, reading)


# The closed set of tags, and dictionary categories by tag.
POS_TAGS = ["NOUN", "VERB", "ADJ_I", "ADJ_NA", "ADV", "PRON", "PART", "COP", "AUX", "CONJ", "DET", "NUM", "INTERJ", "PREFIX", "SUFFIX", "PUNCT", "SYM", "OTHER"]
CATEGORY_TAGS = {
    "代名詞": "PRON", "動詞": "VERB", "形容詞": "ADJ_I", "形状詞": "ADJ_NA", "副詞": "ADV", "助詞": "PART", "接続詞": "CONJ",
    "連体詞": "DET", "感動詞": "INTERJ", "接頭辞": "PREFIX", "接尾辞": "SUFFIX", "記号": "SYM", "空白": "OTHER", "フィラー": "INTERJ",
}


def map_pos(category: Column, detail: Column, lemma: Column) -> Column:
    tags = F.create_map(*[F.lit(x) for pair in CATEGORY_TAGS.items() for x in pair])
    return (
        F.when(category == "名詞", F.when(detail == "数詞", "NUM").otherwise("NOUN"))
        .when(category == "助動詞", F.when(lemma.isin("だ", "です"), "COP").otherwise("AUX"))
        .when(category == "補助記号", F.when(detail.isin("句点", "読点"), "PUNCT").otherwise("SYM"))
        .otherwise(F.coalesce(F.try_element_at(tags, category), F.lit("OTHER")))
    )


def word_count(text: Column) -> Column:
    """White-space separated words; 0 for blank text."""
    stripped = strip(text)
    return F.when(stripped == "", 0).otherwise(F.size(F.split(stripped, r"(?U)\s+")))


def crawl_pair(line: Column, floor: float | None) -> Column:
    """(ja, en) of a tab-separated crawl line whose columns are told apart by content; null if it is rejected.

    Score: first field that is a number in [0, 1]. Below ``floor`` the line goes; no score passes.
    ja: first field with Japanese; en: longest other field without Japanese that is no URL (first of equals).
    """
    parts = F.split(line, "\t")
    numbers = F.filter(F.transform(parts, lambda p: strip(p).try_cast("double")), lambda v: v.isNotNull() & (v >= 0) & (v <= 1))
    score = F.try_element_at(numbers, F.lit(1))
    ja = F.try_element_at(F.filter(parts, has_japanese), F.lit(1))
    texts = F.filter(parts, lambda p: ~has_japanese(p) & ~p.startswith("http://") & ~p.startswith("https://"))
    ranked = F.transform(texts, lambda p, i: F.struct(F.length(p).alias("n"), (-i).alias("i"), p.alias("p")))
    en = F.array_max(ranked)["p"]
    low = F.coalesce(score < floor, F.lit(False)) if floor is not None else F.lit(False)
    return F.when((F.size(parts) >= 2) & ~low & ja.isNotNull() & (F.coalesce(en, F.lit("")) != ""), F.struct(ja.alias("ja"), en.alias("en")))


# --- small numeric functions ---------------------------------------------------------------------


def learning_rate(step: Column, peak: float, warmup: int) -> Column:
    s = F.greatest(step, F.lit(1))
    return F.when(s <= warmup, F.lit(peak) * s / warmup).otherwise(F.lit(peak) * F.sqrt(F.lit(float(warmup)) / s))


def length_penalty(n: Column, alpha: float) -> Column:
    return F.pow((F.lit(5.0) + n) / 6.0, F.lit(alpha))


def size_label(n: Column) -> Column:
    return F.when(n % 1000 == 0, F.concat((n / 1000).cast("int").cast("string"), F.lit("k"))).otherwise(n.cast("string"))


def effort_for(model: Column) -> Column:
    """Lean reasoning setting by model family."""
    older = model.startswith("gpt-4.1") | model.startswith("gpt-4o") | model.startswith("gpt-4-")
    return F.when(older, F.lit(None).cast("string")).when(model.startswith("gpt-5.6"), "none").otherwise("minimal")


#: US dollars for a million tokens in and out.
PRICES = [
    ("gpt-4.1-mini", 0.40, 1.60), ("gpt-5-mini", 0.25, 2.00), ("gpt-5.6-sol", 5.00, 30.00), ("gpt-5.6-terra", 2.50, 15.00),
    ("gpt-5.6-luna", 1.00, 6.00), ("gpt-5.4-mini", 0.75, 4.50), ("gpt-5.4-nano", 0.20, 1.25),
]
