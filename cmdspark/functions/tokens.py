"""Tokens of command lines, with nested braces and quotes, in Arrow batches."""

from __future__ import annotations

import re
from itertools import accumulate, groupby
from operator import itemgetter

TOKENS = "struct<plain:array<string>,items:array<struct<kind:string,name:string,args:array<string>>>>"
_WORD, _BRACE = re.compile(r'[ \t]*("[^"]*"?|\{|[^ \t]+)'), re.compile(r"[{}]")


def _block_end(line: str, start: int) -> int:
    """Where the block that opens at ``start`` has been closed, or the line's end."""
    depth = 0
    for brace in _BRACE.finditer(line, start):
        depth += 1 if brace[0] == "{" else -1
        if not depth:
            return brace.end()
    return len(line)


def tokenise(line: str, keep_quotes: bool = False) -> list[str]:
    """Words between blanks and tabs; ``{...}`` with inner braces and ``"..."`` are one word each where one begins there."""
    line, out, at = line.strip(), [], 0
    if "{" not in line and '"' not in line:
        return [w for w in line.replace("\t", " ").split(" ") if w]
    while match := _WORD.match(line, at):
        word, at = match[1], match.end()
        if word == "{":
            at = _block_end(line, match.start(1))
            word = line[match.start(1) : at]
        elif word[0] == '"' and not keep_quotes:
            word = word[1:-1] if len(word) > 1 and word[-1] == '"' else word[1:]
        out.append(word)
    return out


def structure(tokens: list[str]) -> list[tuple[str, str, list[str]]]:
    """(kind, name, args): the command, flags with all plain words that follow them, and other words as positionals.

    A word belongs to the flags counted up to it: those of count 0 stand alone, others are arguments of the
    flag that opens their count, unless that brought its own by an equals sign.
    """
    rest = tokens[1:]
    counted = zip(accumulate(word.startswith("-") for word in rest), rest, strict=True)
    items: list[tuple[str, str, list[str]]] = [("cmd", word, []) for word in tokens[:1]]
    for flags, group in groupby(counted, key=itemgetter(0)):
        words = [word for _, word in group]
        if flags:
            name, equals, value = words.pop(0).partition("=")
            args = [value] * bool(value) if equals else words
            items.append(("flag_arg" if args or equals else "flag", name, args))
            words = words if equals else []
        items += [("positional", word, []) for word in words]
    return items


def line_tokens(lines: list[str | None]) -> list[dict]:
    """Plain tokens (quotes dropped) and structured items (quotes kept) of each line; null counts as empty."""
    out = []
    for line in lines:
        plain = tokenise(line or "")
        quoted = tokenise(line, True) if line and '"' in line else plain
        out.append({"plain": plain, "items": [{"kind": kind, "name": name, "args": args} for kind, name, args in structure(quoted)]})
    return out
