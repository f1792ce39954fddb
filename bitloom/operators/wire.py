"""Wire texts to nested documents, a batch of texts at a time.

The records of all texts of a batch are one Arrow array. They are cut, told apart by their tags,
checked and counted as whole columns; lists of tokens, words, sentences and grammar records are made
from the counts. Only the message of a text's first fault is put together by itself.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# The format's separators.
HEADER, TOKEN, WORD, SENTENCE, GRAMMAR, PARAGRAPH = "", "", "", "", "", ""
LIST_SEP, FIELD_SEP, RECORD_END = "", "", ""
NAMES = {HEADER: "⟨H⟩", TOKEN: "⟨T⟩", WORD: "⟨W⟩", SENTENCE: "⟨S⟩", GRAMMAR: "⟨G⟩", PARAGRAPH: "⟨P⟩", LIST_SEP: "⟨L⟩", FIELD_SEP: "⟨F⟩", RECORD_END: "⟨E⟩"}
BLANK = "\n\r\t "

SPAN = "struct<start:int,end:int>"
PARAGRAPH_TYPE = (
    "struct<tokens:array<struct<id:int,surface:string,ruby:array<string>,dictionary_form:string,pos:string,gloss:string>>,"
    f"words:array<struct<span:{SPAN},dictionary_form:string,gloss:string>>,"
    f"sentences:array<struct<span:{SPAN},translation:string>>,"
    f"grammar:array<struct<rule_id:string,roles:array<struct<name:string,tok:int,span:{SPAN}>>>>>"
)
DOCUMENT_TYPE = f"struct<header:struct<format_version:string,ruleset_version:string>,paragraphs:array<{PARAGRAPH_TYPE}>>"
PARSED_TYPE = f"struct<doc:{DOCUMENT_TYPE},error:struct<kind:string,pos:int,msg:string>>"

TAGS = [HEADER, PARAGRAPH, TOKEN, WORD, SENTENCE, GRAMMAR]
H, P, T, W, S, G = range(6)
ARITY = {T: 6, W: 3, S: 2}
#: Code points of text that are read at a time.
PORTION = 1 << 22


def _integers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Whole numbers of at most nine ASCII digits, with a sign and white space around them or without, and which texts are such."""
    plain = pc.utf8_trim(texts, characters=" \t\n\v\f\r")
    good = pc.match_substring_regex(plain, r"^[+-]?[0-9]{1,9}$")
    digits = pc.if_else(good, pc.replace_substring_regex(plain, r"^\+", ""), "0")
    return digits.cast(pa.int32()).to_numpy(zero_copy_only=False), good.to_numpy(zero_copy_only=False)


class _Lists:
    """The parts of texts that are split by a separator, once for all texts."""

    def __init__(self, texts: pa.Array, separator: str, most: int | None = None) -> None:
        lists = pc.split_pattern(texts, separator, max_splits=most) if most else pc.split_pattern(texts, separator)
        self.flat, self.first = lists.flatten(), lists.offsets.to_numpy()[:-1]
        self.count = np.diff(lists.offsets.to_numpy())

    def at(self, rows: np.ndarray, k: int) -> pa.Array:
        """The k-th part of some texts; the last one of those that have fewer."""
        return self.flat.take(pa.array(self.first[rows] + np.minimum(k, self.count[rows] - 1)))


def _spans(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of ``start:end``, which can be read, and which of these have 0 <= start < end."""
    sides, every = _Lists(texts, ":"), np.arange(len(texts))
    (start, a), (end, b) = _integers(sides.at(every, 0)), _integers(sides.at(every, 1))
    readable = (sides.count == 2) & a & b
    return start, end, readable, readable & (start >= 0) & (end > start)


def _lists(owner: np.ndarray, owners: int, values: pa.Array) -> pa.ListArray:
    """One list for each owner of the values, which are in the order of their owners."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=owners))]), pa.int32()), values)


def _struct(mask: np.ndarray | None = None, **columns: pa.Array) -> pa.StructArray:
    return pa.StructArray.from_arrays(list(columns.values()), list(columns), mask=None if mask is None else pa.array(mask))


def _span_struct(texts: pa.Array) -> pa.StructArray:
    start, end, _, _ = _spans(texts)
    return _struct(start=pa.array(start), end=pa.array(end))


def _documents(texts: pa.Array) -> pa.StructArray:
    n = len(texts)
    cut = _Lists(texts, RECORD_END)
    size = pc.utf8_length(cut.flat).to_numpy().astype(np.int64) + 1
    begin = np.cumsum(size) - size
    doc = np.repeat(np.arange(n), cut.count)
    place = begin - begin[cut.first][doc]
    body = pc.utf8_ltrim(cut.flat, characters=BLANK)
    filled = pc.utf8_length(body).to_numpy() > 0
    body, doc, place = body.filter(pa.array(filled)), doc[filled], place[filled]
    kind = pc.fill_null(pc.index_in(pc.utf8_slice_codeunits(body, 0, 1), value_set=pa.array(TAGS)), -1).to_numpy()
    fields = _Lists(pc.utf8_slice_codeunits(body, 1), FIELD_SEP)

    of = lambda k: np.flatnonzero(kind == k)
    # a text's records of a kind before each record
    starts = np.searchsorted(doc, np.arange(n))

    def before(k: int) -> np.ndarray:
        seen = np.concatenate([[0], np.cumsum(kind == k)])
        return seen[:-1] - seen[starts[doc]]

    fault = np.zeros(len(kind), np.int8)

    def note(rows: np.ndarray, bad: np.ndarray, code: int) -> None:
        """The first fault of a record counts."""
        rows = rows[bad]
        fault[rows] = np.where(fault[rows] == 0, code, fault[rows])

    UNKNOWN, TWICE, ORPHAN, COUNT, BODY, NUMBER, UNREADABLE, INVALID, RULE, ROLE, TARGET = range(1, 12)
    every = np.arange(len(kind))
    note(every, kind < 0, UNKNOWN)
    note(of(H), before(H)[of(H)] > 0, TWICE)
    note(of(H), fields.count[of(H)] != 2, COUNT)
    note(of(P), pc.utf8_length(body).to_numpy()[of(P)] > 1, BODY)
    note(every, (kind >= T) & (before(P) == 0), ORPHAN)
    for k, arity in ARITY.items():
        note(of(k), fields.count[of(k)] != arity, COUNT)
    note(of(T), ~_integers(fields.at(of(T), 0))[1], NUMBER)
    for k in (W, S):
        _, _, readable, valid = _spans(fields.at(of(k), 0))
        note(of(k), ~readable, UNREADABLE)
        note(of(k), ~valid, INVALID)
    note(of(G), pc.utf8_length(fields.at(of(G), 0)).to_numpy() == 0, RULE)
    # roles: name=target, a target is a number or a span
    roles_of = fields.count[of(G)] - 1
    record = np.repeat(of(G), roles_of)
    number = np.arange(len(record)) - np.repeat(np.cumsum(roles_of) - roles_of, roles_of)
    roles = fields.flat.take(pa.array(fields.first[record] + 1 + number))
    sides, all_roles = _Lists(roles, "=", 1), np.arange(len(record))
    name, target = sides.at(all_roles, 0), sides.at(all_roles, 1)
    malformed = (sides.count < 2) | (pc.utf8_length(name).to_numpy() == 0) | (pc.utf8_length(target).to_numpy() == 0)
    spanned = pc.match_substring(target, ":").to_numpy(zero_copy_only=False)
    start, end, readable, valid = _spans(target)
    token, whole = _integers(target)
    role_fault = np.select([malformed, spanned & ~readable, spanned & ~valid, ~spanned & ~whole], [ROLE, UNREADABLE, INVALID, TARGET], 0)
    wrong = np.flatnonzero(role_fault)
    owner, at = np.unique(record[wrong], return_index=True)
    first_wrong = dict(zip(owner.tolist(), wrong[at].tolist(), strict=True))
    for r, k in first_wrong.items():
        fault[r] = fault[r] or role_fault[k]

    # the first faulty record of each text
    errors: dict[int, tuple[str, int | None, str]] = {}
    faulty = np.flatnonzero(fault)
    _, at = np.unique(doc[faulty], return_index=True)
    for r in faulty[at].tolist():
        code, tag = fault[r], body[r].as_py()[0]
        parts = fields.flat.slice(fields.first[r], fields.count[r]).to_pylist()
        said = (roles if kind[r] == G else fields.flat)[first_wrong.get(r, 0) if kind[r] == G else fields.first[r]].as_py() if code in (NUMBER, UNREADABLE, INVALID, ROLE, TARGET) else ""
        value = said.partition("=")[2] if kind[r] == G and code in (UNREADABLE, INVALID, TARGET) else said
        message = {
            UNKNOWN: f"unknown record tag U+{ord(tag):04X}", TWICE: "more than one header", ORPHAN: "record before any paragraph",
            COUNT: f"{'header' if kind[r] == H else NAMES.get(tag)} expects {ARITY.get(int(kind[r]), 2)} fields, got {len(parts)}", BODY: "paragraph record with a body",
            NUMBER: f"token id is no integer: {value!r}", UNREADABLE: f"bad span {value!r}", INVALID: f"invalid span {value}", RULE: "grammar record without a rule",
            ROLE: f"malformed role {value!r}", TARGET: f"role target is no integer: {value!r}",
        }[int(code)]
        about_value = code in (UNREADABLE, INVALID)
        errors[int(doc[r])] = ("value" if about_value else "parse", None if about_value else int(place[r]), message)
    headed = np.bincount(doc[kind == H], minlength=n) > 0
    for d in np.flatnonzero(~headed).tolist():
        errors.setdefault(d, ("parse", None, "no header" if texts[d].as_py() else "empty input"))

    ok = np.ones(n, bool)
    ok[list(errors)] = False
    kept = ok[doc] & (kind >= 0)
    pick = lambda k: np.flatnonzero(kept & (kind == k))
    paragraph = np.cumsum(kept & (kind == P)) - 1
    count = int(paragraph[-1]) + 1 if len(paragraph) else 0
    t, w, s, g = (pick(k) for k in (T, W, S, G))
    ruby = _Lists(fields.at(t, 2), LIST_SEP)
    some = pc.utf8_length(fields.at(t, 2)).to_numpy() > 0
    ruby_parts = ruby.flat.filter(pa.array(np.repeat(some, ruby.count)))
    tokens = _struct(
        id=pa.array(_integers(fields.at(t, 0))[0]), surface=fields.at(t, 1), ruby=_lists(np.repeat(np.arange(len(t)), ruby.count * some), len(t), ruby_parts),
        dictionary_form=fields.at(t, 3), pos=fields.at(t, 4), gloss=fields.at(t, 5),
    )
    words = _struct(span=_span_struct(fields.at(w, 0)), dictionary_form=fields.at(w, 1), gloss=fields.at(w, 2))
    sentences = _struct(span=_span_struct(fields.at(s, 0)), translation=fields.at(s, 1))
    good = kept[record]
    spans = _struct(~spanned, start=pa.array(start), end=pa.array(end))
    role_structs = _struct(name=name, tok=pa.array(token, mask=spanned), span=spans).filter(pa.array(good))
    number_of = np.full(len(kind), -1)
    number_of[g] = np.arange(len(g))
    grammar = _struct(rule_id=fields.at(g, 0), roles=_lists(number_of[record[good]], len(g), role_structs))
    paragraphs = _struct(
        tokens=_lists(paragraph[t], count, tokens), words=_lists(paragraph[w], count, words), sentences=_lists(paragraph[s], count, sentences), grammar=_lists(paragraph[g], count, grammar)
    )
    header = np.full(n, -1)
    header[doc[pick(H)]] = fields.first[pick(H)]
    version = lambda k: fields.flat.take(pa.array(header + k, mask=header < 0))
    documents = _struct(~ok, header=_struct(~ok, format_version=version(0), ruleset_version=version(1)), paragraphs=_lists(doc[pick(P)], n, paragraphs))
    kinds, places, messages = zip(*[errors.get(d, (None, None, None)) for d in range(n)], strict=True)
    error = _struct(ok, kind=pa.array(kinds, pa.string()), pos=pa.array(places, pa.int32()), msg=pa.array(messages, pa.string()))
    return _struct(doc=documents, error=error)


def parse_texts(texts: pa.Array, kind: pa.DataType) -> pa.Array:
    """struct<doc, error> of each wire text, of which one is null; null is an empty text. The last record may lack its end."""
    texts = pc.fill_null(texts.cast(pa.string()), "")
    ends = np.cumsum(pc.utf8_length(texts).to_numpy().astype(np.int64))
    out, at = [], 0
    while at < len(texts):  # portions, so that memory doesn't grow with the length of a batch's texts
        until = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PORTION, "right")))
        out.append(_documents(texts.slice(at, until - at)).cast(kind))
        at = until
    return pa.concat_arrays(out) if out else pa.array([], kind)
