"""Cleaning command lines before they are validated, with built-in functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


#: What a continuation, white space, a brace glued to a word on either side, and a flag glued to a word look like, and what each becomes.
CONTINUATION, BACKSLASH = "\\\n", "\\"
BLANKS = (r"(?U)\s+", " ")
OPEN_BRACE, CLOSE_BRACE = (r"(\S)\{", r"$1 {"), (r"\}(\S)", r"} $1")
GLUED_FLAG = ("([a-zA-Z_]+)-([a-zA-Z_]+)", "$1 -$2")


def clean_text(line: Column) -> Column:
    """Continuations and backslashes, white space, glued braces, glued flags. Null and empty lines stay as they are."""
    out = F.replace(F.replace(line, F.lit(CONTINUATION), F.lit(" ")), F.lit(BACKSLASH), F.lit(" "))
    for pattern, new in (BLANKS, OPEN_BRACE, CLOSE_BRACE, GLUED_FLAG):
        out = F.regexp_replace(out, pattern, new)
    return F.when(line == "", line).otherwise(out)


def cut_flags(line: Column, known_flags: Column) -> Column:
    """Cut the first known flag that ends a longer token off it; one cut for a token, tokens joined by one space."""

    def cut(token: Column) -> Column:
        ends = F.get(F.filter(known_flags, lambda f: token.endswith(f) & (token != f)), F.lit(0))
        return F.when(ends.isNull(), token).otherwise(F.concat(F.substring(token, F.lit(1), F.length(token) - F.length(ends)), F.lit(" "), ends))

    tokens = F.filter(F.split(line, r"(?U)\s+"), lambda t: t != "")
    return F.when(F.size(known_flags) > 0, F.array_join(F.transform(tokens, cut), " ")).otherwise(line)


def clean(line: Column, known_flags: Column | None = None) -> Column:
    """N1 to N5, ends trimmed. ``known_flags`` is an array column in syntax order; null or none skips N5."""
    out = clean_text(line)
    if known_flags is not None:
        out = F.coalesce(cut_flags(out, known_flags), out)
    return F.when(line == "", line).otherwise(F.regexp_replace(out, r"(?U)^\s+|\s+$", ""))
