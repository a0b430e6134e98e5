"""Production of question and statement pairs: sampled programs, their wording, near misses, merges of tokens, routing samples."""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.statement import clause, text, tokens
from ..registry import query
from .comparison import normal_form
from .curation import _tokens
from .governance import _values
from .routing import FEATURES

#: Attempts per wanted program, before a bucket counts as dry.
PATIENCE = 30


@dataclass(frozen=True)
class Program:
    template: str
    difficulty: str
    sql: str
    slots: tuple


#: What slots are filled with, and how they are called.
SLOTS = {
    "dim": [("o_orderstatus", "상태"), ("o_orderpriority", "우선순위")],
    "measure": [("o_totalprice", "주문금액"), ("o_orderkey", "주문번호")],
    "agg": [("sum", "합계"), ("avg", "평균"), ("max", "최대")],
    "year": [(str(y), f"{y}년") for y in range(1995, 2001)],
    "k": [(str(k), f"{k}개") for k in (3, 5, 10)],
}
TEMPLATES = {
    "count_year": ("easy", "SELECT count(*) AS cnt FROM orders WHERE year(o_orderdate) = {year}", "{year} 주문 건수는?"),
    "agg_all": ("easy", "SELECT {agg}({measure}) AS val FROM orders", "주문의 {measure} {agg}는?"),
    "agg_by": ("medium", "SELECT {dim}, {agg}({measure}) AS val FROM orders GROUP BY {dim}", "{dim}별 {measure} {agg}를 보여줘"),
    "agg_by_year": ("medium", "SELECT {dim}, {agg}({measure}) AS val FROM orders WHERE year(o_orderdate) = {year} GROUP BY {dim}", "{year} {dim}별 {measure} {agg}는?"),
    "top": ("hard", "SELECT o_custkey, {agg}({measure}) AS val FROM orders WHERE year(o_orderdate) = {year} GROUP BY o_custkey ORDER BY val DESC, o_custkey LIMIT {k}", "{year} {measure} {agg} 상위 {k} 고객은?"),
    "above": ("hard", "SELECT {dim}, {agg}({measure}) AS val FROM orders GROUP BY {dim} HAVING avg({measure}) > (SELECT avg({measure}) FROM orders)", "전체 평균보다 {measure} 평균이 높은 {dim}별 {agg}는?"),
}


def sample(n: int, seed: int) -> list[Program]:
    """n programs at most, as many of each difficulty as there can be, different by their normal form; buckets take turns."""
    rng, seen, out = np.random.default_rng(seed), set(), []
    by = {d: [t for t in TEMPLATES if TEMPLATES[t][0] == d] for d in ("easy", "medium", "hard")}
    tries = {d: PATIENCE * n for d in by}
    while len(out) < n and any(tries.values()):
        for d, names in by.items():
            while tries[d] and len(out) < n:
                tries[d] -= 1
                name = names[rng.integers(len(names))]
                slots = {s: SLOTS[s][rng.integers(len(SLOTS[s]))] for s in re.findall(r"{(\w+)}", TEMPLATES[name][1] + TEMPLATES[name][2])}
                sql = TEMPLATES[name][1].format(**{k: v[0] for k, v in slots.items()})
                if (form := normal_form(sql)) not in seen:
                    seen.add(form)
                    out.append(Program(name, d, sql, tuple(sorted(slots.items()))))
                    break
    return out


def wording(p: Program) -> str:
    """The question that a program answers."""
    return TEMPLATES[p.template][2].format(**{k: v[1] for k, v in p.slots})


def programs(spark: SparkSession, n: int, seed: int) -> DataFrame:
    return spark.createDataFrame([(p.template, p.difficulty, p.sql, wording(p)) for p in sample(n, seed)], "template string, difficulty string, sql string, question string")


def near_miss(sql: str) -> str | None:
    """The statement without its WHERE, else without its GROUP BY, else without its count: plausible and wrong."""
    parts = tokens(sql)
    for word in ("where", "group"):
        at = clause(parts, word)
        if at >= 0:
            stop = next((i for i in range(at + 1, len(parts)) if clause(parts[i : i + 1], parts[i].word) == 0 and parts[i].word in ({"group", "having", "order", "limit"} if word == "where" else {"order", "limit"}) and sum({"(": 1, ")": -1}.get(t.text, 0) for t in parts[at:i]) == 0), len(parts))
            return " ".join((text(parts[:at]) + " " + text(parts[stop:])).split())
    new = re.sub(r"count\(\s*(?:\*|1)\s*\)", "1", sql, flags=re.I)
    return new if new != sql else None


_MISSES = [("SELECT a, count(*) FROM t WHERE b IN (SELECT c FROM u WHERE d = 1) GROUP BY a", "SELECT a, count(*) FROM t GROUP BY a"), ("SELECT a, count(*) FROM t GROUP BY a ORDER BY 2", "SELECT a, count(*) FROM t ORDER BY 2"), ("SELECT count(*) FROM t", "SELECT 1 FROM t"), ("SELECT a FROM t", None)]


@query(_values(_MISSES, "sql, miss"))
def near_misses(t):
    return t.values("sql string, miss string", [(s, near_miss(s)) for s, _ in _MISSES])


@query(_values([("easy", 10), ("medium", 10), ("hard", 10)], "difficulty, n").replace("SELECT *", "SELECT difficulty, CAST(n AS BIGINT) AS n"))
def sampled_programs(t):
    """As many programs of each difficulty, no two alike, all with their wording."""
    return programs(t.spark, 30, 7).where("question NOT LIKE '%{%'").dropDuplicates(["sql"]).groupBy("difficulty").agg(F.count(F.lit(1)).alias("n"))


def merges(counts: dict[str, int], n: int, least: int = 2) -> list[tuple[str, str]]:
    """Byte-pair merges of weighted words: the most frequent pair first, the lesser of equal ones, until none occurs `least` times."""
    words, out = {w: list(w) for w in counts}, []
    for _ in range(n):
        pairs: Counter = Counter()
        for w, parts in words.items():
            for pair in zip(parts, parts[1:], strict=False):
                pairs[pair] += counts[w]
        if not pairs:
            break
        best = min(pairs, key=lambda p: (-pairs[p], p))
        if pairs[best] < least:
            break
        out.append(best)
        for w, parts in words.items():
            i, new = 0, []
            while i < len(parts):
                two = tuple(parts[i : i + 2]) == best
                new.append("".join(best) if two else parts[i])
                i += 1 + two
            words[w] = new
    return out


_TOK = "(SELECT unnest(regexp_extract_all(text, '[a-z]+|[0-9]')) AS tok FROM conversations)"


@query(f"WITH w AS (SELECT tok, count(*) AS n FROM {_TOK} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1000), p AS (SELECT substr(tok, i, 1) AS a, substr(tok, i + 1, 1) AS b, n FROM w, unnest(range(1, length(tok))) u(i)) SELECT a, b FROM p GROUP BY 1, 2 ORDER BY sum(n) DESC, 1, 2 LIMIT 1")
def first_merge(t):
    """The first merge learned from the commonest thousand words: their counts are made in Spark, the merging is over different words."""
    rows = _tokens(t).orderBy(F.desc("n"), "tok").limit(1000).collect()
    return t.values("a string, b string", merges({r.tok: r.n for r in rows}, 1))


def routing_samples(spark: SparkSession, n: int, seed: int) -> DataFrame:
    """n rows of features and a label drawn from a logistic rule over them with noise; the same for a seed, whatever the partitions."""
    u = lambda i: F.pmod(F.xxhash64(F.col("id"), F.lit(seed), F.lit(i)), F.lit(1 << 30)) / float(1 << 30)
    x = spark.range(n).select("id", *[F.round(u(i), 6).alias(f) for i, f in enumerate(FEATURES)])
    logit = sum((F.col(f) * w for f, w in (("nested", 2.0), ("ratio", 1.5), ("n_words", 1.0), ("n_values", -1.0))), F.lit(-1.75)) + (u(99) - 0.5)
    return x.withColumn("label", (u(100) < 1 / (1 + F.exp(-logit))).cast("int"))


@query(_values([("balanced", 1)], "kind, ok").replace("SELECT *", "SELECT kind, ok = 1 AS ok"))
def synthetic_routing(t):
    """Harder samples are labelled more often, and both labels occur."""
    rows = routing_samples(t.spark, 2000, 7).agg(F.avg("label").alias("rate"), F.corr("nested", "label").alias("r")).first()
    return t.values("kind string, ok boolean", [("balanced", 0.3 < rows.rate < 0.7 and rows.r > 0.1)])


@query("SELECT variant, count(*) AS n, round(avg(CASE WHEN variant = 'all' OR hash_ok THEN y ELSE 0 END), 6) AS rate FROM (SELECT quality AS y, doc_id % 10 <> CASE v WHEN 'all' THEN -1 WHEN 'no value' THEN 1 WHEN 'no glossary' THEN 2 ELSE 3 END AS hash_ok, v AS variant FROM labels, (VALUES ('all'), ('no value'), ('no glossary'), ('no examples')) x(v)) GROUP BY 1")
def ablation_matrix(t):
    """Every item under every variant: a variant loses the items that need what it leaves out."""
    needs = {"all": -1, "no value": 1, "no glossary": 2, "no examples": 3}
    x = t.labels.select("doc_id", F.col("quality").alias("y"), F.explode(F.array(*[F.struct(F.lit(v).alias("variant"), F.lit(k).alias("k")) for v, k in needs.items()])).alias("v"))
    return x.groupBy("v.variant").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.when(F.col("doc_id") % 10 != F.col("v.k"), F.col("y")).otherwise(0)), 6).alias("rate"))
