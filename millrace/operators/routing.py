"""Routing of questions: features, a small network, calibration, tiers under a budget, escalation."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..language import compiler, question
from ..plans.runtime import ship_package
from ..registry import query
from .evaluation import predictions
from .governance import _values
from .understanding import TODAY

FEATURES = ["n_words", "n_chars", "n_periods", "n_amounts", "n_comparisons", "n_groups", "n_values", "n_tables", "n_measures", "has_top", "aggregate", "ranking", "temporal", "comparison", "nested", "ratio", "negation"]
#: Tiers from the cheapest, the difficulty from which each is taken, and their cost.
TIERS = [("template", 0.0, 0.0), ("small", 0.3025, 1.0), ("hosted", 0.55, 10.0), ("ensemble", 0.95, 50.0)]
ATTEMPTS = 3


def features(text: str) -> list[float]:
    """17 numbers of a question, in the order of FEATURES."""
    q = question.understand(text, TODAY)
    flat = q.text.replace(" ", "")
    counts = [len(q.words), len(q.text), len(q.periods), len(q.amounts), len(q.comparisons), len(q.groups), len(q.values), sum(x in flat for x in compiler.TABLES), sum(x in flat for x in compiler.MEASURES), q.top is not None]
    return [float(x) for x in [*counts, *(c in q.cues for c in FEATURES[10:])]]


def network(x: np.ndarray, layers: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """A perceptron with rectified layers and a logistic end, in float32."""
    out = x.astype(np.float32)
    for i, (w, b) in enumerate(layers):
        out = out @ w.astype(np.float32) + b.astype(np.float32)
        if i + 1 < len(layers):
            out = np.maximum(out, 0)
    return 1 / (1 + np.exp(-out[:, 0]))


def random_layers(seed: int, sizes: tuple[int, ...] = (17, 64, 32, 1)) -> list[tuple[np.ndarray, np.ndarray]]:
    rng = np.random.default_rng(seed)
    return [(rng.normal(0, (2 / a) ** 0.5, (a, b)), np.zeros(b)) for a, b in zip(sizes, sizes[1:], strict=False)]


def difficulty(df: DataFrame, text: str, layers) -> DataFrame:
    """df with `p`: the network over each question's features, by Arrow batches."""
    ship_package(df.sparkSession)
    return df.withColumn("p", F.pandas_udf(lambda s: pd.Series(network(np.array([features(x) for x in s]).reshape(-1, 17), layers).astype(float)), "double")(text))


def platt(df: DataFrame, p: str = "p", y: str = "y", steps: int = 12) -> tuple[float, float]:
    """a and b of sigmoid(a * logit(p) + b) with the least log loss, by Newton steps of one aggregate each; (1, 0) if the calibration error grows."""
    x = df.select(F.log(F.col(p) / (1 - F.col(p))).alias("x"), F.col(y).cast("double").alias("y"))
    a, b = 1.0, 0.0
    for _ in range(steps):
        q = 1 / (1 + F.exp(-(a * F.col("x") + b)))
        g = x.select("x", (q - F.col("y")).alias("d"), (q * (1 - q)).alias("w")).agg(F.sum(F.col("d") * F.col("x")).alias("ga"), F.sum("d").alias("gb"), F.sum(F.col("w") * F.col("x") * F.col("x")).alias("haa"), F.sum(F.col("w") * F.col("x")).alias("hab"), F.sum("w").alias("hbb")).first()
        det = (g.haa + 1e-9) * (g.hbb + 1e-9) - g.hab**2
        da, db = ((g.hbb + 1e-9) * g.ga - g.hab * g.gb) / det, ((g.haa + 1e-9) * g.gb - g.hab * g.ga) / det
        a, b = a - da, b - db
        if abs(da) + abs(db) < 1e-9:
            break
    done = x.select((1 / (1 + F.exp(-(a * F.col("x") + b)))).alias("p"), "y")
    return (a, b) if calibration_error(done) <= calibration_error(df.select(F.col(p).alias("p"), F.col(y).alias("y"))) else (1.0, 0.0)


def calibration_error(df: DataFrame) -> float:
    bins = df.groupBy(F.greatest(F.ceil(F.col("p") * 10), F.lit(1)).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg("p").alias("c"), F.avg("y").alias("a"))
    return bins.agg(F.sum(F.col("n") * F.abs(F.col("c") - F.col("a"))) / F.sum("n")).first()[0]


@dataclass
class Choice:
    tier: str
    samples: int


def choose(p: float, nested: bool, available: set[str], budget: float, samples: int = 5) -> Choice:
    """The tier of a calibrated difficulty: nested questions never take the template; missing tiers give way to the next below, or above if there is none; an ensemble narrows before it is given up, and dearer tiers are given up beyond the budget."""
    at = max(i for i, (_, least, _) in enumerate(TIERS) if p >= least)
    at = max(at, 1) if nested else at
    order = [*range(at, -1, -1), *range(at + 1, len(TIERS))]
    for i in order:
        name, _, cost = TIERS[i]
        if name not in available:
            continue
        if name == "ensemble":
            n = min(samples, int(budget // (cost / samples)))
            if n >= 2:
                return Choice(name, n)
        elif cost <= budget:
            return Choice(name, 1)
    return Choice("template", 1)


def escalated(tier: str, available: set[str], attempts: int, forced: bool = False) -> str | None:
    """The next tier above, if there is one, the tier wasn't forced and attempts are left."""
    names = [t for t, _, _ in TIERS]
    above = [t for t in names[names.index(tier) + 1 :] if t in available]
    return above[0] if above and not forced and attempts < ATTEMPTS else None


_ALL = {t for t, _, _ in TIERS}
_CHOICES = [(0.1, 0, 100.0, "template", 1), (0.1, 1, 100.0, "small", 1), (0.6, 0, 100.0, "hosted", 1), (0.6, 0, 5.0, "small", 1), (0.97, 0, 100.0, "ensemble", 5), (0.97, 0, 30.0, "ensemble", 3), (0.97, 0, 15.0, "hosted", 1), (0.97, 0, 0.0, "template", 1)]


@query(_values(_CHOICES, "p, nested, budget, tier, samples").replace("SELECT *", "SELECT CAST(p AS DOUBLE) AS p, CAST(nested AS INTEGER) AS nested, CAST(budget AS DOUBLE) AS budget, tier, CAST(samples AS INTEGER) AS samples"))
def tier_budget(t):
    return t.values("p double, nested int, budget double, tier string, samples int", [(p, n, b, (c := choose(p, bool(n), _ALL, b)).tier, c.samples) for p, n, b, _, _ in _CHOICES])


_STEPS = [("template", 0, 0, "small"), ("small", 1, 0, "hosted"), ("ensemble", 0, 0, None), ("small", 3, 0, None), ("small", 0, 1, None)]


@query(_values(_STEPS, "tier, attempts, forced, onward").replace("SELECT *", "SELECT tier, CAST(attempts AS INTEGER) AS attempts, CAST(forced AS INTEGER) AS forced, onward"))
def tier_escalation(t):
    return t.values("tier string, attempts int, forced int, onward string", [(a, n, f, escalated(a, _ALL, n, bool(f))) for a, n, f, _ in _STEPS])


_QUESTIONS = ["1996년 2분기 주문 건수는", "매출 상위 3개 국가별", "전체 평균보다 높은 주문금액 20만원 이상"]


@query(_values([(_QUESTIONS[0], 1, 0, 0, 0), (_QUESTIONS[1], 0, 0, 1, 1), (_QUESTIONS[2], 0, 1, 0, 0)], "question, periods, comparisons, groups, top").replace("SELECT *", "SELECT question, CAST(periods AS DOUBLE) AS periods, CAST(comparisons AS DOUBLE) AS comparisons, CAST(groups AS DOUBLE) AS groups, CAST(top AS DOUBLE) AS top"))
def question_features(t):
    ship_package(t.spark)
    rows = t.values("question string", [(q,) for q in _QUESTIONS]).withColumn("f", F.pandas_udf(lambda s: s.map(features), "array<double>")("question"))
    at = lambda n: F.col("f")[FEATURES.index(n)]
    return rows.select("question", at("n_periods").alias("periods"), at("n_comparisons").alias("comparisons"), at("n_groups").alias("groups"), at("has_top").alias("top"))


@query()
def platt_calibration(t):
    a, b = platt(predictions(t))
    return t.values("a double, b double", [(a, b)])


@query()
def routing_network(t):
    return difficulty(t.values("question string", [(q,) for q in _QUESTIONS]), "question", random_layers(7))
