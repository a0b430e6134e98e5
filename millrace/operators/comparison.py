"""Result sets compared as answers: values normalised, rows with or without order, columns in any order."""

from __future__ import annotations

import math
import re
from collections import Counter
from itertools import permutations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.statement import text, tokens
from ..registry import query
from .governance import _values

#: Columns up to which all orders of columns are tried, and the relative difference up to which numbers are equal.
PERMUTED, TOLERANCE = 6, 1e-6


def value(v):
    """Booleans as numbers, floats to 6 places, strings without edges and as numbers where they are some."""
    if v is None:
        return None
    if isinstance(v, bool):
        return int(v)
    if isinstance(v, int):
        return v
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    s = str(v).strip()
    if re.fullmatch(r"[+-]?\d+", s):
        return int(s)
    return round(float(s), 6) if re.fullmatch(r"[+-]?(\d+\.\d*|\.\d+|\d+)([eE][+-]?\d+)?", s) else s


def close(a, b) -> bool:
    if isinstance(a, int | float) and isinstance(b, int | float):
        return abs(a - b) <= TOLERANCE * max(abs(a), abs(b), 1.0)
    return a == b


def _key(v) -> tuple:
    return (0, 0.0, "") if v is None else (1, float(v), "") if isinstance(v, int | float) else (2, 0.0, str(v))


def _same(a: list[tuple], b: list[tuple], ordered: bool) -> bool:
    if not ordered:
        if Counter(a) == Counter(b):
            return True
        a, b = (sorted(x, key=lambda r: [_key(v) for v in r]) for x in (a, b))
    return all(close(x, y) for p, q in zip(a, b, strict=True) for x, y in zip(p, q, strict=True))


def matches(got: list[tuple], gold: list[tuple], ordered: bool = False) -> bool:
    """Whether got answers what gold does: as many rows, gold's columns among got's in any order; ordered if the gold query orders."""
    got, gold = ([tuple(map(value, r)) for r in x] for x in (got, gold))
    if len(got) != len(gold):
        return False
    if not gold:
        return True
    n, m = len(gold[0]), len(got[0])
    if m < n:
        return False
    if max(n, m) <= PERMUTED:
        return any(_same([tuple(r[i] for i in p) for r in got], gold, ordered) for p in permutations(range(m), n))
    free = list(range(m))  # of many columns each takes the first that has its values
    for j in range(n):
        at = next((i for i in free if _same([(r[i],) for r in got], [(r[j],) for r in gold], ordered)), None)
        if at is None:
            return False
        free.remove(at)
    return True


def normal_form(sql: str) -> str:
    """The statement in lower case but for its strings, with single spaces and without comments."""
    return " ".join(t.text if t.kind == "text" else t.text.lower() for t in tokens(sql) if t.kind != "space").removesuffix(" ;")


def skeleton(sql: str) -> str:
    """The normal form with literals masked."""
    return " ".join("_" if t.kind in ("text", "number") else t.text.lower() for t in tokens(sql) if t.kind != "space").removesuffix(" ;")


def shape(sql: str) -> str:
    """The skeleton's keywords alone, in order."""
    kept = {"select", "distinct", "from", "join", "left", "on", "where", "group", "by", "having", "order", "limit", "union", "intersect", "except", "with", "in", "exists", "case", "count", "sum", "avg", "min", "max", "over"}
    return " ".join(t.word for t in tokens(sql) if t.word in kept)


_A = "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1"
_CASES = {
    "same": (_A, "SELECT o_orderstatus, sum(1) AS n FROM orders GROUP BY 1"),
    "filtered": (_A, "SELECT o_orderstatus, count(*) AS n FROM orders WHERE o_orderkey > 100 GROUP BY 1"),
    "twice": (_A, f"{_A} UNION ALL {_A}"),
    "by another way": ("SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1", "SELECT n_nationkey, count(c_custkey) AS n FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY 1"),
}


def multiset_equal(a: DataFrame, b: DataFrame) -> DataFrame:
    """Whether two results have the same rows as often: one shuffle, no row order."""
    cols = a.columns
    both = a.withColumn("_d", F.lit(1)).unionAll(b.toDF(*cols).withColumn("_d", F.lit(-1)))
    return both.groupBy(*cols).agg(F.sum("_d").alias("_s")).where("_s <> 0").agg((F.count(F.lit(1)) == 0).alias("equal"))


@query(" UNION ALL ".join(f"SELECT '{k}' AS pair, NOT EXISTS (({a} EXCEPT ALL {b}) UNION ALL ({b} EXCEPT ALL {a})) AS equal".replace(f"EXCEPT ALL {b}", f"EXCEPT ALL ({b})").replace(f"(({a}", f"((({a})").replace(f"({b} EXCEPT", f"(({b}) EXCEPT").replace(f"EXCEPT ALL {a})", f"EXCEPT ALL ({a}))") for k, (a, b) in _CASES.items()))
def result_multiset_equal(t):
    s = t.spark.newSession()
    for n in ("orders", "customer", "nation"):
        s.read.parquet(f"{t.folder}/{n}.parquet").createOrReplaceTempView(n)
    out = None
    for k, (a, b) in _CASES.items():
        one = multiset_equal(s.sql(a), s.sql(b)).select(F.lit(k).alias("pair"), "equal")
        out = one if out is None else out.unionAll(one)
    return out


_ROWS = [(1, "a"), (2, "b")]
_MATCH = [
    ("equal", _ROWS, _ROWS, False, True), ("order free", _ROWS[::-1], _ROWS, False, True), ("order kept", _ROWS[::-1], _ROWS, True, False), ("columns swapped", [("a", 1), ("b", 2)], _ROWS, False, True), ("column more", [(9, 1, "a"), (9, 2, "b")], _ROWS, False, True),
    ("column less", [(1,), (2,)], _ROWS, False, False), ("tolerance", [(1.0000000001,)], [(1,)], True, True), ("beyond it", [(1.001,)], [(1,)], False, False), ("text numbers", [("12", " x ")], [(12, "x")], False, True), ("both empty", [], [], False, True),
    ("row more", [*_ROWS, (3, "c")], _ROWS, False, False), ("booleans", [(True,)], [(1,)], False, True), ("seven columns", [tuple(range(7))], [tuple(range(6, -1, -1))], False, True), ("nulls", [(None,)], [("",)], False, False),
]


@query(_values([(c[0], int(c[4])) for c in _MATCH], "kind, matched").replace("SELECT *", "SELECT kind, matched = 1 AS matched"))
def execution_match(t):
    return t.values("kind string, matched boolean", [(c[0], matches(c[1], c[2], c[3])) for c in _MATCH])


_TEXTS = [("SELECT a FROM t WHERE x = 1", "select  a from t where x = 1 ;", "yes", "yes", "yes"), ("SELECT a FROM t WHERE x = 1", "SELECT a FROM t WHERE x = 2", "no", "yes", "yes"), ("SELECT a FROM t WHERE x = 1", "SELECT b FROM u WHERE y > 'z'", "no", "no", "yes"), ("SELECT a FROM t", "SELECT a FROM t ORDER BY a", "no", "no", "no")]


@query(_values(_TEXTS, "a, b, exact, skeleton, shape"))
def statement_match(t):
    yes = lambda f, a, b: "yes" if f(a) == f(b) else "no"
    return t.values("a string, b string, exact string, skeleton string, shape string", [(a, b, yes(normal_form, a, b), yes(skeleton, a, b), yes(shape, a, b)) for a, b, *_ in _TEXTS])


def statement_of(sql: str) -> str:
    return text(tokens(sql))
