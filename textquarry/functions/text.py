"""Small text expressions used throughout the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Line-comment markers of the languages that have structure.
COMMENT_PREFIXES = {
    "python": ("#",),
    "javascript": ("//", "/*", "*/", "*"),
    "jsx": ("//", "/*", "*/", "*"),
    "typescript": ("//", "/*", "*/", "*"),
    "tsx": ("//", "/*", "*/", "*"),
}

LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
ALNUM = r"[\p{L}\p{N}]"
NOT_BLANK = r"(?U)\S"


def is_blank(text: Column) -> Column:
    return ~text.rlike(NOT_BLANK)


def has_alnum(text: Column) -> Column:
    return text.rlike(ALNUM)


def utf8(text: Column) -> Column:
    return F.encode(text, "UTF-8")


def byte_slice(data: Column, start: Column, end: Column) -> Column:
    """Text held by the half-open byte range of a UTF-8 binary column."""
    return F.substring(data, start + 1, end - start).cast("string")


def split_lines_keep_ends(text: Column) -> Column:
    """Lines with their newline, so that joining them gives the text back."""
    return F.filter(F.split(text, r"(?<=\n)"), lambda line: line != "")


def count_char(text: Column, char: str) -> Column:
    """Occurrences of a single character."""
    return F.length(text) - F.length(F.replace(text, F.lit(char), F.lit("")))


def starts_comment(stripped: Column, language: Column) -> Column:
    test = F.lit(False)
    for slug, prefixes in COMMENT_PREFIXES.items():
        marked = F.lit(False)
        for prefix in prefixes:
            marked = marked | stripped.startswith(prefix)
        test = F.when(language == slug, marked).otherwise(test)
    return test


def line_kind(line: Column, language: Column) -> Column:
    """blank, comment, punctuation (nothing alphanumeric) or code."""
    stripped = F.regexp_replace(line, r"(?U)^\s+", "")
    return (
        F.when(is_blank(line), "blank")
        .when(starts_comment(stripped, language), "comment")
        .when(~has_alnum(line), "punctuation")
        .otherwise("code")
    )


def is_trivia(text: Column, language: Column) -> Column:
    """True when no line of the text is code. Unstructured languages need one regex only."""
    per_line = F.forall(
        F.split(text, LINE_BREAK), lambda line: line_kind(line, language) != "code"
    )
    return F.when(language.isin(*COMMENT_PREFIXES), per_line).otherwise(~has_alnum(text))


def cut_at_newline(text: Column, limit: int, suffix: str = "") -> Column:
    """At most ``limit`` chars, cut at the last newline when there is one past the start."""
    head = F.left(text, F.lit(limit))
    whole_lines = F.regexp_extract(head, r"(?s)^(.+)\n", 1)
    cut = F.when(whole_lines != "", whole_lines).otherwise(head)
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(cut, F.lit(suffix)))


def location(path: Column, start: Column, end: Column) -> Column:
    return F.concat(path, F.lit(":"), start.cast("string"), F.lit("-"), end.cast("string"))


def qualified_symbol(parent: Column, symbol: Column) -> Column:
    """Parent.symbol, or whichever of the two exists."""
    return F.when(
        (parent != "") & (symbol != ""), F.concat_ws(".", parent, symbol)
    ).otherwise(F.coalesce(F.nullif(symbol, F.lit("")), F.nullif(parent, F.lit(""))))


# Fixed value: the space separators of Unicode, which trimming a line takes off its ends.
SPACES = " \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"


def preview_line(content: Column, limit: int = 96) -> Column:
    """First line that is neither blank, comment nor decorator, shortened with an ellipsis."""
    lines = F.filter(
        F.transform(F.split(content, "\n"), lambda line: F.trim(line, F.lit(SPACES))),
        lambda line: (line != "") & ~line.rlike(r"^(#|//|/\*|\*|@|\{/\*)"),
    )
    line = F.try_element_at(lines, F.lit(1))
    return F.when(
        F.length(line) > limit, F.concat(F.left(line, F.lit(limit - 1)), F.lit("…"))
    ).otherwise(line)
