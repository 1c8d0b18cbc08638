"""Normalised lexical terms for text and for questions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

# What an identifier is, where it breaks into parts, and the shape of a
# question token.
IDENTIFIER = r"[A-Za-z_$][A-Za-z0-9_$]*"
PART_BREAK = (
    r"[_$]+"
    r"|(?<=[a-z0-9])(?=[A-Z])"
    r"|(?<=[A-Z])(?=[A-Z][a-z])"
    r"|(?<=[A-Za-z])(?=[0-9])"
    r"|(?<=[0-9])(?=[A-Za-z])"
)
QUESTION_TOKEN = r"[A-Za-z0-9_$./-]+"
MIN_PART_CHARS = 2

# Question words without lexical signal.
STOP_WORDS = (
    "a an and any are as at be by can do does done for from has have how i in into is it "
    "its me my of on or our should so that the their them there these this those to used "
    "was we were what when where which who why will with would you your defined "
    "implemented handled happens work works"
).split()

# A word of letters without an inner capital is one term; most prose takes this path.
ONE_TERM = r"^[A-Za-z]?[a-z]*$"


def _no_terms() -> Column:
    return F.array().cast("array<string>")


def _normal(text: Column) -> Column:
    return F.regexp_replace(F.lower(text), "[^a-z0-9]", "")


def identifier_terms(word: Column) -> Column:
    """The joined lower-case identifier, then its camel, snake and digit parts."""
    whole = _normal(word)
    parts = F.filter(
        F.transform(F.split(word, PART_BREAK), _normal),
        lambda part: (F.length(part) >= MIN_PART_CHARS) & (part != whole),
    )
    split_up = F.concat(F.when(whole != "", F.array(whole)).otherwise(_no_terms()), parts)
    return F.when(word.rlike(ONE_TERM), F.array(F.lower(word))).otherwise(split_up)


def _split_words(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of the joined terms of words, and where each word's end; ``ends`` are those of the words in data."""
    upper, lower, digit = ((data >= low) & (data <= high) for low, high in (b"AZ", b"az", b"09"))
    letter, kept = upper | lower, upper | lower | digit
    sizes = np.diff(ends, prepend=0)
    starts, word = np.zeros(len(data), bool), np.repeat(np.arange(len(ends)), sizes)
    starts[(ends - sizes)[sizes > 0]] = True
    opens = starts.copy()  # where a part begins
    opens[1:] |= ~kept[:-1] | ((lower | digit)[:-1] & upper[1:]) | (letter[:-1] & digit[1:]) | (digit[:-1] & letter[1:])
    opens[1:-1] |= upper[:-2] & upper[1:-1] & lower[2:] & ~starts[2:]
    opens, word = opens[kept], word[kept]
    low = np.where(upper, data + 32, data)[kept].astype(np.uint8)
    part = np.cumsum(opens) - 1
    first = np.flatnonzero(opens)
    length = np.diff(np.append(first, len(low)))
    owner = word[first]
    shown = (length >= MIN_PART_CHARS) & (np.bincount(owner, minlength=len(ends))[owner] > 1)
    room = np.where(shown, length + 1, 0)  # a space and the part
    whole = np.bincount(word, minlength=len(ends))
    out_ends = np.cumsum(whole + np.bincount(owner, room, len(ends)).astype(np.int64))
    out = np.full(int(out_ends[-1]) if len(ends) else 0, ord(" "), np.uint8)
    before = np.cumsum(whole) - whole  # characters, and room of parts, of the words before
    taken = np.cumsum(room) - room
    extra = np.append(0, out_ends)[:-1] - before
    out[np.arange(len(low)) + extra[word]] = low
    at = (before + whole)[owner] + taken + 1 - first
    into = shown[part]
    out[(np.arange(len(low)) + at[part])[into]] = low[into]
    return out, out_ends


WORDS_AT_ONCE = 1 << 18


def _joined_terms(words: pa.Array) -> pa.Array:
    lists = words.cast(pa.list_(pa.string()))
    flat, found = lists.flatten().fill_null(""), []
    for at in range(0, len(flat), WORDS_AT_ONCE):
        piece = pa.concat_arrays([flat.slice(at, WORDS_AT_ONCE)])
        _, offsets, data = piece.buffers()
        edges = np.frombuffer(offsets, np.int32)[piece.offset : piece.offset + len(piece) + 1].astype(np.int64)
        text = np.frombuffer(data, np.uint8)[edges[0] : edges[-1]] if data else np.zeros(0, np.uint8)
        out, ends = _split_words(text, edges[1:] - edges[0])
        found.append(pa.StringArray.from_buffers(len(ends), pa.py_buffer(np.append(0, ends).astype(np.int32)), pa.py_buffer(out)))
    sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    edges = pa.array(np.append(0, np.cumsum(sizes)), pa.int32())
    return pa.ListArray.from_arrays(edges, pa.concat_arrays(found) if found else pa.array([], pa.string()), mask=lists.is_null())


def joined_terms(words: Column) -> Column:
    """The terms of each identifier of an array, joined by a space; "" for one without terms.

    As ``identifier_terms`` for words of ASCII letters, digits, `_` and `$`, many at once.
    """
    return F.arrow_udf(_joined_terms, "array<string>")(words)


def text_terms(text: Column) -> Column:
    """Terms of all identifiers in order of appearance, repeats kept."""
    words = F.regexp_extract_all(text, F.lit(IDENTIFIER), F.lit(0))
    return F.coalesce(F.flatten(F.transform(words, identifier_terms)), _no_terms())


COUNTED = "struct<total:bigint,counts:array<struct<term:string,tf:bigint>>>"
BYTES_AT_ONCE = 1 << 21


def _counted(texts: pa.StringArray) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Of some texts: distinct terms, their counts, how many of them each text has, and how many terms in all."""
    data = np.frombuffer(b"".join(x.encode() for x in texts.to_pylist()), np.uint8)
    sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.repeat(np.arange(len(texts)), sizes)
    digit = (data >= ord("0")) & (data <= ord("9"))
    upper, lower = ((data >= low) & (data <= high) for low, high in (b"AZ", b"az"))
    named = upper | lower | (data == ord("_")) | (data == ord("$"))
    held = named | digit
    fresh = np.diff(row, prepend=-1) != 0
    # An identifier starts at the first character of a run that is no digit.
    runs = held & (fresh | ~np.append(False, held[:-1]))
    seen = np.cumsum(named)
    before = (seen - named)[runs]
    held &= seen > (before[np.maximum(np.cumsum(runs) - 1, 0)] if len(before) else 0)
    opens = held & (fresh | ~np.append(False, held[:-1]))
    word_row = row[opens]
    ends = np.append(np.flatnonzero(opens[held]), int(held.sum()))[1:]
    out, out_ends = _split_words(data[held], ends)
    word = np.repeat(np.arange(len(ends)), np.diff(out_ends, prepend=0))
    kept = out != ord(" ")
    first = np.append(False, ~kept[:-1])[: len(out)] | (np.diff(word, prepend=-1) != 0)
    at = np.flatnonzero(first[kept])
    offsets = np.append(at, int(kept.sum())).astype(np.int32)
    terms = pa.StringArray.from_buffers(len(at), pa.py_buffer(offsets), pa.py_buffer(out[kept]))
    coded = terms.dictionary_encode()
    term_row = word_row[word[kept][at]]
    width = max(len(coded.dictionary), 1)
    keys, counts = np.unique(term_row * width + coded.indices.to_numpy(zero_copy_only=False), return_counts=True)
    found = np.bincount(keys // width, minlength=len(texts))
    return coded.dictionary.take(pa.array(keys % width)), counts, found, np.bincount(term_row, minlength=len(texts))


def _counted_terms(texts: pa.Array) -> pa.Array:
    texts = texts.cast(pa.string()).fill_null("")
    reached = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    parts, at = [], 0
    while at < len(texts):
        until = max(at + 1, int(np.searchsorted(reached, (reached[at - 1] if at else 0) + BYTES_AT_ONCE, "right")))
        parts.append(_counted(texts.slice(at, until - at)))
        at = until
    names = pa.concat_arrays([p[0] for p in parts]) if parts else pa.array([], pa.string())
    tf, sizes, total = (np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, np.int64) for i in (1, 2, 3))
    rows = pa.StructArray.from_arrays([names, pa.array(tf, pa.int64())], ["term", "tf"])
    counts = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), rows)
    return pa.StructArray.from_arrays([pa.array(total, pa.int64()), counts], ["total", "counts"])


def counted_terms(text: Column) -> Column:
    """The number of terms of ``text_terms`` and, for each distinct one, how often it comes; many texts at once."""
    return F.arrow_udf(_counted_terms, COUNTED)(text)


FIELDS = "struct<total:bigint,terms:array<struct<term:string,tf_names:bigint,tf_body:bigint>>>"


def _field_terms(names: pa.Array, bodies: pa.Array) -> pa.Array:
    names, bodies = (texts.cast(pa.string()).fill_null("") for texts in (names, bodies))
    reached = np.cumsum(pc.binary_length(bodies).to_numpy(zero_copy_only=False).astype(np.int64))
    parts, at = [], 0
    while at < len(bodies):
        until = max(at + 1, int(np.searchsorted(reached, (reached[at - 1] if at else 0) + BYTES_AT_ONCE, "right")))
        rows = until - at
        body, name = _counted(bodies.slice(at, rows)), _counted(names.slice(at, rows))
        coded = pa.concat_arrays([body[0], name[0]]).dictionary_encode()
        width = max(len(coded.dictionary), 1)
        row = np.concatenate([np.repeat(np.arange(rows), found) for _, _, found, _ in (body, name)])
        keys, place = np.unique(row * width + coded.indices.to_numpy(zero_copy_only=False), return_inverse=True)
        held = len(body[0])
        tf = [np.bincount(p, n, len(keys)).astype(np.int64) for p, n in ((place[held:], name[1]), (place[:held], body[1]))]
        terms = coded.dictionary.take(pa.array(keys % width))
        parts.append((terms, *tf, np.bincount(keys // width, minlength=rows), body[3] + name[3]))
        at = until
    found = pa.concat_arrays([p[0] for p in parts]) if parts else pa.array([], pa.string())
    tf_names, tf_body, sizes, total = (np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, np.int64) for i in range(1, 5))
    rows = pa.StructArray.from_arrays([found, pa.array(tf_names, pa.int64()), pa.array(tf_body, pa.int64())], ["term", "tf_names", "tf_body"])
    lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), rows)
    return pa.StructArray.from_arrays([pa.array(total, pa.int64()), lists], ["total", "terms"])


def field_terms(names: Column, body: Column) -> Column:
    """The number of terms of ``text_terms`` of two texts and, for each distinct one, how often it comes in either."""
    return F.arrow_udf(_field_terms, FIELDS)(names, body)


# A joiner, an inner capital, a dot between letters, or letters together with digits.
CODE_SHAPE = r"[_/]|[a-z][A-Z]|[A-Za-z]\.[A-Za-z]|[A-Za-z].*[0-9]|[0-9].*[A-Za-z]"


def looks_like_code(token: Column) -> Column:
    return token.rlike(CODE_SHAPE)


def question_tokens(question: Column) -> Column:
    """Tokens as typed, without leading or trailing dots, slashes and dashes."""
    raw = F.regexp_extract_all(question, F.lit(QUESTION_TOKEN), F.lit(0))
    stripped = F.transform(raw, lambda token: F.regexp_replace(token, "^[./-]+|[./-]+$", ""))
    return F.filter(stripped, lambda token: token != "")


def question_terms(question: Column) -> Column:
    """Distinct terms in order; plain words stay whole, code-like tokens are split."""

    def plain(token: Column) -> Column:
        words = F.transform(F.split(token, "[^A-Za-z0-9]+"), F.lower)
        return F.filter(words, lambda word: word != "")

    per_token = F.transform(
        question_tokens(question),
        lambda token: F.when(looks_like_code(token), text_terms(token)).otherwise(plain(token)),
    )
    stop = F.array(*(F.lit(word) for word in STOP_WORDS))
    return F.array_except(F.flatten(per_token), stop)


def question_identifiers(question: Column) -> Column:
    """Code-like tokens exactly as typed, each once."""
    return F.array_distinct(F.filter(question_tokens(question), looks_like_code))


def compact(name: Column) -> Column:
    """Name without case and separators, for symbol comparison."""
    return F.regexp_replace(F.lower(name), "[^a-z0-9]", "")
