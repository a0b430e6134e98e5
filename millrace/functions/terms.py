"""Terms and hashed features of texts, and vector arithmetic as columns."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def terms(text: Column) -> Column:
    """Lower-case words of ASCII letters and digits."""
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: F.length(w) > 0)


def terms_sql(x: str) -> str:
    return f"list_filter(string_split_regex(lower({x}), '[^a-z0-9]+'), lambda w: length(w) > 0)"


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def fnv1a(data: bytes) -> int:
    """The 64-bit FNV-1a hash."""
    h = 0xCBF29CE484222325
    for b in data:
        h = (h ^ b) * 0x100000001B3 % (1 << 64)
    return h


def features(text: str) -> Counter:
    """Words, and their runs of two and three characters within marks of begin and end."""
    out: Counter = Counter()
    for w in re.findall(r"\w+", text.lower()):
        out["w:" + w] += 1
        marked = f"<{w}>"
        for n in (2, 3):
            out.update(f"c{n}:{marked[i : i + n]}" for i in range(len(marked) - n + 1))
    return out


def embed(text: str, dim: int, idf: np.ndarray | None = None) -> np.ndarray:
    """A signed hashing vector of unit length."""
    out = np.zeros(dim)
    for f, n in features(text).items():
        h = fnv1a(f.encode())
        out[h % dim] += (1 if h >> 32 & 1 else -1) * (1 + np.log(n)) * (1 if idf is None else idf[h % dim])
    size = np.linalg.norm(out)
    return out / size if size else out
