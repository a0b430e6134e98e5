"""Checks of a statement that analysis can't make: dates kept as eight digits, and code columns compared with labels."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from .statement import Token, compared, solid, tokens

ISO = re.compile(r"\d{4}-\d{2}-\d{2}")
#: Functions that read dates, which eight digits in a string are not.
DATE_FUNCTIONS = {"year", "month", "day", "date", "quarter", "to_date", "date_trunc", "date_format", "datediff", "add_months", "strftime", "julianday", "last_day", "weekofyear"}


@dataclass
class Dictionary:
    """What is known of columns beyond their types. dates: names of eight-digit date columns; codes: a column's code -> label."""

    dates: frozenset = frozenset()
    codes: dict[str, dict[str, str]] = field(default_factory=dict)


def wrapped(parts: list[Token], i: int) -> tuple[str, int, int] | None:
    """The date function right around a column, with the places of its name and its closing parenthesis."""
    at = solid(parts)
    k = at.index(i)
    if k >= 2 and parts[at[k - 1]].text == "." and k >= 4:
        k -= 2
    if k >= 2 and parts[at[k - 1]].text == "(" and parts[at[k - 2]].word in DATE_FUNCTIONS:
        depth = 0
        for j in at[k - 1 :]:
            depth += {"(": 1, ")": -1}.get(parts[j].text, 0)
            if not depth:
                return parts[at[k - 2]].word, at[k - 2], j
    return None


def check(sql: str, known: Dictionary) -> list[tuple[str, str, str]]:
    """(code, severity, subject) of dates and codes that are compared in a way that silently finds nothing."""
    parts, out = tokens(sql), []
    for i, j in compared(parts, set(known.dates)):
        if ISO.match(parts[j].value):
            out.append(("DATE_FORMAT_MISMATCH", "error", parts[i].word))
    for i, t in enumerate(parts):
        if t.word in known.dates and (w := wrapped(parts, i)):
            out.append(("DATE_FORMAT_MISMATCH", "error", f"{w[0]}({t.word})"))
    for i, j in compared(parts, set(known.codes)):
        labels, value = known.codes[parts[i].word], parts[j].value
        if value in labels:
            continue
        if value in labels.values():
            out.append(("CODE_LITERAL_MISMATCH", "error", parts[i].word))
        elif re.search(r"[^\x00-\x7F]|[a-z]{2}", value):  # a word in letters where there are only codes
            out.append(("CODE_LITERAL_MISMATCH", "warn", parts[i].word))
    return list(dict.fromkeys(out))
