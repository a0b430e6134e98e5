"""A statement's text as tokens, for checks and repairs that must work on statements that don't analyze."""

from __future__ import annotations

import re
from dataclasses import dataclass

_TOKEN = re.compile(r"(?P<space>\s+|--[^\n]*|/\*.*?\*/)|(?P<text>'(?:[^'\\]|\\.|'')*')|(?P<name>`[^`]+`|[^\W\d]\w*)|(?P<number>\d+(?:\.\d+)?)|(?P<sign><=>|<>|!=|>=|<=|\|\||.)", re.S)
_END = {"where", "group", "order", "having", "limit", "union", "intersect", "except", "on", "join", "inner", "left", "right", "full", "cross", "using", "select", "from", "as", "lateral", "semi", "anti", "natural", "window", "qualify"}


@dataclass
class Token:
    kind: str
    text: str

    @property
    def word(self) -> str:
        return self.text.strip("`").lower() if self.kind == "name" else ""

    @property
    def value(self) -> str:
        return self.text[1:-1].replace("''", "'")


def tokens(sql: str) -> list[Token]:
    return [Token(m.lastgroup, m[0]) for m in _TOKEN.finditer(sql)]


def text(parts: list[Token]) -> str:
    return "".join(t.text for t in parts)


def solid(parts: list[Token]) -> list[int]:
    """Places of tokens that aren't space or comment."""
    return [i for i, t in enumerate(parts) if t.kind != "space"]


def tables(parts: list[Token]) -> dict[str, str]:
    """Alias -> name of every table after FROM, JOIN or a comma of a FROM list, over all scopes."""
    at, out, listed = solid(parts), {}, False
    k = 0
    while k < len(at):
        word = parts[at[k]].word
        if word in ("from", "join") or listed and parts[at[k]].text == ",":
            listed = word == "from" or listed
            if k + 1 < len(at) and parts[at[k + 1]].kind == "name":
                name, j = parts[at[k + 1]].word, k + 2
                if j < len(at) and parts[at[j]].word == "as":
                    j += 1
                named = j < len(at) and parts[at[j]].kind == "name" and parts[at[j]].word not in _END
                out[parts[at[j]].word if named else name] = name
                k = j + named
                continue
        elif word in _END - {"as"} or parts[at[k]].text in "()":
            listed = False
        k += 1
    return out


def clause(parts: list[Token], word: str, start: int = 0) -> int:
    """Place of a keyword outside parentheses, or -1."""
    depth = 0
    for i in range(start, len(parts)):
        depth += {"(": 1, ")": -1}.get(parts[i].text, 0)
        if not depth and parts[i].word == word:
            return i
    return -1


def compared(parts: list[Token], names: set[str]):
    """Yields (place of a column's name, place of a literal it is compared with) for the names."""
    at = solid(parts)
    for k, i in enumerate(at):
        if parts[i].word not in names:
            continue
        nxt = [parts[j] for j in at[k + 1 : k + 4]]
        if not nxt:
            continue
        if nxt[0].text in ("=", "<", ">", "<=", ">=", "<>", "!=") or nxt[0].word == "like":
            j = at[k + 2] if k + 2 < len(at) else -1
            if j >= 0 and parts[j].kind == "text":
                yield i, j
        elif nxt[0].word in ("between", "in") or nxt[0].word == "not" and len(nxt) > 1 and nxt[1].word in ("between", "in"):
            for j in at[k + 2 :]:
                if parts[j].kind == "text":
                    yield i, j
                elif parts[j].text not in ("(", ",") and parts[j].word not in ("and", "in", "between"):
                    break
        before = [parts[j] for j in at[max(0, k - 2) : k]]
        if len(before) == 2 and before[0].kind == "text" and before[1].text in ("=", "<", ">", "<=", ">=", "<>", "!="):
            yield i, at[k - 2]
