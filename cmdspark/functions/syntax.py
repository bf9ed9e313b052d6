"""Argument rules from a command's syntax string, one small Arrow function over the catalogue."""

from __future__ import annotations

import re

RULES = (
    "struct<flags:array<struct<flag:string,ord:int,type:string,n_args:int,choices:array<string>>>,"
    "mutex:array<array<string>>,positionals:array<struct<position:int,choices:array<string>>>,status:string>"
)
_PART = re.compile(r"[\[\]{}<>|]|-?[^\s\[\]{}<>|]*")
_CLOSE = {"[": "]", "{": "}", "<": ">"}


def _tree(syntax: str) -> list[tuple]:
    """Nested parts of a syntax: ("word" | "flag" | "mark", text) and (bracket, parts). ValueError if a bracket stays open."""
    stack: list[tuple[str, list]] = [("", [])]
    for part in filter(None, _PART.findall(syntax)):
        if part in _CLOSE:
            stack.append((part, []))
        elif len(stack) > 1 and part == _CLOSE[stack[-1][0]]:
            done = stack.pop()
            stack[-1][1].append(done)
        elif part in "]}>|":
            stack[-1][1].append(("mark", part))  # a closer that closes nothing is read as a word
        else:
            stack[-1][1].append(("flag" if part[0] == "-" else "word", part))
    if len(stack) > 1:
        raise ValueError(f"{stack[-1][0]} stays open")
    return stack[0][1]


def _with_args(parts: list[tuple]) -> list[tuple]:
    """Parts in which each flag has taken the words, braces and angle brackets that follow it: ("flag", text, args)."""
    out: list[tuple] = []
    for part in parts:
        if out and out[-1][0] == "flag" and part[0] in ("word", "{", "<"):
            out[-1][2].append(part)
        else:
            out.append((*part, []) if part[0] == "flag" else part)
    return out


def _alternatives(parts: list[tuple]) -> list[str]:
    """Texts of the parts between bars at this level; only words and flags count, empty texts are left out."""
    groups: list[list[tuple]] = [[]]
    for part in parts:
        if part == ("mark", "|"):
            groups.append([])
        else:
            groups[-1].append(part)
    texts = (" ".join(p[1] for p in _with_args(g) if p[0] in ("word", "flag", "mark")) for g in groups)
    return [t for t in texts if t]


def syntax_rules(syntax: str | None) -> dict:
    """Flag rules, groups of which one member at most may be used, required positionals, and whether the syntax could be read.

    Status is ``none`` without a syntax, ``failed`` if it can't be read (the rules are then empty), else ``ok``.
    """
    rules: dict = {"flags": [], "mutex": [], "positionals": [], "status": "ok"}
    if not syntax or not syntax.strip():
        return rules | {"status": "none"}
    try:
        parts = _tree(syntax)
        if not parts or parts[0][0] != "word":
            raise ValueError("no command")
    except ValueError:
        return rules | {"status": "failed"}
    flags: dict[str, dict] = {}

    def visit(part: tuple, top: bool) -> None:
        kind = part[0]
        if kind == "flag":
            args = part[2]
            rule = {"flag": part[1], "ord": flags.get(part[1], {"ord": len(flags)})["ord"], "type": "value", "n_args": len(args), "choices": []}
            if not args:
                rule["type"] = "boolean"
            elif len(args) == 1 and args[0][0] == "{":
                rule["type"] = "block"
            elif len(args) == 1 and args[0][0] == "<":
                rule |= {"type": "choice", "choices": _alternatives(args[0][1])}
            flags[part[1]] = rule
        elif kind == "<":
            texts = _alternatives(part[1])
            if top and texts:
                rules["positionals"].append({"position": len(rules["positionals"]), "choices": texts})
            elif not top and len(texts) > 1:
                rules["mutex"].append(texts)
        elif kind in ("[", "{"):
            inside = _with_args(part[1])
            if all(p[0] in ("word", "flag", "mark") for p in inside):
                texts = _alternatives(part[1])
                if len(texts) > 1:
                    rules["mutex"].append(texts)
            for p in inside:
                visit(p, False)

    for part in _with_args(parts[1:]):
        visit(part, True)
    return rules | {"flags": sorted(flags.values(), key=lambda r: r["ord"])}


def rules_of(syntaxes: list[str | None]) -> list[dict]:
    return [syntax_rules(x) for x in syntaxes]
