"""Result comparison, voting, calibration and routing metrics as aggregates.

Predictions are made from the tables: a document's score is a fixed function of its length, its label from `labels`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..registry import Tables, query

_P = "((n_chars * 7919) % 1000 + 0.5) / 1000.0"
_PRED = f"(SELECT doc_id, lang, source, quality AS y, {_P} AS p FROM labels JOIN documents USING (doc_id))"


def predictions(t: Tables) -> DataFrame:
    p = (F.col("n_chars") * 7919 % 1000 + 0.5) / 1000.0
    return t.labels.join(t.documents.select("doc_id", "lang", "source", "n_chars"), "doc_id").select("doc_id", "lang", "source", F.col("quality").alias("y"), p.alias("p"))


def signature(df: DataFrame, cols: list[str]) -> DataFrame:
    """A digest of the rows without their order: a sum of row digests, so it needs no task with all rows."""
    row = F.conv(F.substring(F.sha2(F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols]), 256), 1, 12), 16, 10).cast("decimal(20,0)")
    return df.agg(F.coalesce(F.sum(row).cast("decimal(38,0)").cast("string"), F.lit("0")).alias("signature"), F.count(F.lit(1)).alias("n"))


@query("SELECT CAST(CAST(sum(CAST('0x' || substr(sha256(r_regionkey || chr(31) || r_name), 1, 12) AS BIGINT)) AS HUGEINT) AS VARCHAR) AS signature, count(*) AS n FROM region")
def result_signature(t):
    return signature(t.region, ["r_regionkey", "r_name"])


_CAND = [("a", "F", "F"), ("b", "F", "F"), ("c", "O", "O"), ("d", "X", "X")]
_VOTES = " UNION ALL ".join(f"SELECT '{c}' AS cand, (SELECT count(*) FROM orders WHERE o_orderstatus = '{s}') AS sig" for c, s, _ in _CAND)


def candidates(t: Tables) -> DataFrame:
    counts = t.orders.groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("sig"))
    return t.values("cand string, s string", [(c, s) for c, s, _ in _CAND]).join(counts, F.col("s") == F.col("o_orderstatus"), "left").select("cand", F.coalesce("sig", F.lit(0)).alias("sig"))


@query(f"SELECT cand, votes FROM (SELECT min(cand) AS cand, count(*) AS votes, sig > 0 AS filled FROM ({_VOTES}) GROUP BY sig) ORDER BY filled DESC, votes DESC, cand LIMIT 1")
def vote_plurality(t):
    g = candidates(t).groupBy("sig").agg(F.min("cand").alias("cand"), F.count(F.lit(1)).alias("votes"))
    return g.orderBy(F.desc(F.col("sig") > 0), F.desc("votes"), "cand").limit(1).select("cand", "votes")


@query(f"SELECT round(max(votes) / sum(votes), 4) AS agreement FROM (SELECT count(*) AS votes FROM ({_VOTES}) GROUP BY sig)")
def vote_agreement(t):
    return candidates(t).groupBy("sig").agg(F.count(F.lit(1)).alias("votes")).agg(F.round(F.max("votes") / F.sum("votes"), 4).alias("agreement"))


@query(f"SELECT lang, round(avg(least(1.0, sqrt(0.25 / p))), 6) AS ves FROM {_PRED} GROUP BY 1")
def ves_score(t):
    return predictions(t).groupBy("lang").agg(F.round(F.avg(F.least(F.lit(1.0), F.sqrt(0.25 / F.col("p")))), 6).alias("ves"))


def nearest_rank(values, q: float):
    """The element of a sorted array at round(q * (n - 1)), half to even."""
    return F.get(values, F.bround(F.lit(q) * (F.size(values) - 1), 0).cast("int"))


@query(f"WITH x AS (SELECT lang, y, p, row_number() OVER (PARTITION BY lang ORDER BY p) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n FROM {_PRED}) SELECT lang, round(avg(y), 6) AS rate, max(CASE WHEN i = CAST(round_even(0.5 * (n - 1), 0) AS BIGINT) THEN p END) AS p50, max(CASE WHEN i = CAST(round_even(0.95 * (n - 1), 0) AS BIGINT) THEN p END) AS p95 FROM x GROUP BY lang")
def eval_aggregate(t):
    """Rates and nearest-rank percentiles from counts by value, so the window sees different values and not rows."""
    w = Window.partitionBy("lang")
    x = predictions(t).groupBy("lang", "p").agg(F.count(F.lit(1)).alias("c"), F.sum("y").alias("s"))
    x = x.withColumn("upto", F.sum("c").over(w.orderBy("p"))).withColumn("n", F.sum("c").over(w))
    at = lambda q: F.min(F.when(F.col("upto") > F.bround(F.lit(q) * (F.col("n") - 1), 0).cast("bigint"), F.col("p")))
    return x.groupBy("lang").agg(F.round(F.sum("s") / F.sum("c"), 6).alias("rate"), at(0.5).alias("p50"), at(0.95).alias("p95"))


@query(f"SELECT tag, count(*) AS n, round(avg(y), 6) AS rate FROM (SELECT y, unnest([lang, source]) AS tag FROM {_PRED}) GROUP BY 1 HAVING count(*) >= 3")
def eval_by_tag(t):
    return predictions(t).select("y", F.explode(F.array("lang", "source")).alias("tag")).groupBy("tag").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("y"), 6).alias("rate")).where("n >= 3")


@query(f"SELECT count(*) AS n, round(avg(CASE WHEN (p >= 0.5) = (y = 1) THEN 1.0 ELSE 0.0 END), 6) AS score FROM {_PRED}")
def governance_score(t):
    return predictions(t).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(((F.col("p") >= 0.5) == (F.col("y") == 1)).cast("double")), 6).alias("score"))


@query(f"WITH g AS (SELECT p, sum(y) AS pos, count(*) - sum(y) AS neg FROM {_PRED} GROUP BY p), c AS (SELECT pos, neg, coalesce(sum(neg) OVER (ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM g) SELECT round(sum(pos * (below + neg / 2.0)) / (sum(pos) * sum(neg)), 6) AS auc FROM c")
def roc_auc(t):
    """Rank-sum area with ties at half: summed by distinct score first, so the ordered window sees distinct scores only."""
    g = predictions(t).groupBy("p").agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg"))
    below = F.coalesce(F.sum("neg").over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return g.withColumn("below", below).agg(F.round(F.sum(F.col("pos") * (F.col("below") + F.col("neg") / 2)) / (F.sum("pos") * F.sum("neg")), 6).alias("auc"))


_BINS = f"(SELECT CAST(greatest(ceil(p * 10), 1) AS INT) AS bin, count(*) AS n, avg(p) AS conf, avg(y) AS acc FROM {_PRED} GROUP BY 1)"


def _bins(t):
    return predictions(t).groupBy(F.greatest(F.ceil(F.col("p") * 10), F.lit(1)).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg("p").alias("conf"), F.avg("y").alias("acc"))


@query(f"SELECT bin, n, round(conf, 6) AS conf, round(acc, 6) AS acc FROM {_BINS}")
def reliability_bins(t):
    return _bins(t).select("bin", "n", F.round("conf", 6).alias("conf"), F.round("acc", 6).alias("acc"))


@query(f"SELECT round(sum(n * abs(conf - acc)) / sum(n), 6) AS ece FROM {_BINS}")
def ece(t):
    return _bins(t).agg(F.round(F.sum(F.col("n") * F.abs(F.col("conf") - F.col("acc"))) / F.sum("n"), 6).alias("ece"))


@query(f"SELECT th, sum(CASE WHEN p >= th THEN 1 ELSE 0 END)::BIGINT AS escalated, round(avg(CASE WHEN (p >= th) = (y = 1) THEN 1.0 ELSE 0.0 END), 6) AS accuracy, round(sum(CASE WHEN p >= th AND y = 1 THEN 1.0 ELSE 0.0 END) / sum(y), 6) AS recall FROM {_PRED}, (VALUES (0.25), (0.5), (0.75)) AS v(th) GROUP BY 1".replace("(VALUES (0.25), (0.5), (0.75))", "(VALUES (0.25::DOUBLE), (0.5::DOUBLE), (0.75::DOUBLE))"))
def threshold_sweep(t):
    x = predictions(t).select("p", "y", F.explode(F.array(*[F.lit(v) for v in (0.25, 0.5, 0.75)])).alias("th"))
    up = F.col("p") >= F.col("th")
    return x.groupBy("th").agg(F.count_if(up).alias("escalated"), F.round(F.avg((up == (F.col("y") == 1)).cast("double")), 6).alias("accuracy"), F.round(F.count_if(up & (F.col("y") == 1)) / F.sum("y"), 6).alias("recall"))


#: Weights of a question's features (those made here from a conversation's text).
WEIGHTS = [("n_words / 28.0", 0.02), ("n_digits / 5.0", 0.01), ("n_marks / 3.0", 0.12)]
_FEAT = "(SELECT conv_id, turn, least(len(string_split(text, ' ')) / 28.0, 1.0) * 0.02 + least(len(regexp_extract_all(text, '[0-9]')) / 5.0, 1.0) * 0.01 + least(len(regexp_extract_all(text, '[?!]')) / 3.0, 1.0) * 0.12 AS s FROM conversations)"


def _heuristic(t):
    n = {"n_words": F.size(F.split("text", " ")), "n_digits": F.size(F.regexp_extract_all("text", F.lit("[0-9]"), 0)), "n_marks": F.size(F.regexp_extract_all("text", F.lit("[?!]"), 0))}
    total = F.lit(0.0)
    for expr, w in WEIGHTS:
        name, scale = expr.split(" / ")
        total = total + F.least(n[name] / float(scale), F.lit(1.0)) * w
    return t.conversations.select("conv_id", "turn", total.alias("s"))


@query(f"SELECT conv_id, turn, round(s, 6) AS score FROM {_FEAT}")
def heuristic_score(t):
    return _heuristic(t).select("conv_id", "turn", F.round("s", 6).alias("score"))


@query(f"SELECT CASE WHEN p < 0.3025 THEN 'template' WHEN p < 0.55 THEN 'small' WHEN p < 0.95 THEN 'hosted' ELSE 'ensemble' END AS tier, count(*) AS n FROM {_PRED} GROUP BY 1")
def tier_bands(t):
    p = F.col("p")
    tier = F.when(p < 0.3025, "template").when(p < 0.55, "small").when(p < 0.95, "hosted").otherwise("ensemble")
    return predictions(t).groupBy(tier.alias("tier")).agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT count(*) AS n, sum(CASE WHEN p < 0.6 AND (doc_id % 10) / 10.0 < 0.6 AND doc_id % 4 >= 2 AND doc_id % 6 >= 2 THEN 1 ELSE 0 END)::BIGINT AS triggered FROM {_PRED}")
def resample_trigger(t):
    d = F.col("doc_id")
    go = (F.col("p") < 0.6) & (d % 10 / 10.0 < 0.6) & (d % 4 >= 2) & (d % 6 >= 2)
    return predictions(t).agg(F.count(F.lit(1)).alias("n"), F.count_if(go).alias("triggered"))


@query(f"SELECT sum(CASE WHEN y = 0 AND p >= 0.5 THEN 1 ELSE 0 END)::BIGINT AS gains, sum(CASE WHEN y = 1 AND p < 0.5 THEN 1 ELSE 0 END)::BIGINT AS losses, round(quantile_cont(p, 0.5), 6) AS p50, round(quantile_cont(p, 0.95), 6) AS p95 FROM {_PRED}")
def paired_policy(t):
    y, p = F.col("y"), F.col("p")
    return predictions(t).agg(F.count_if((y == 0) & (p >= 0.5)).alias("gains"), F.count_if((y == 1) & (p < 0.5)).alias("losses"), F.round(F.percentile("p", 0.5), 6).alias("p50"), F.round(F.percentile("p", 0.95), 6).alias("p95"))


@query("SELECT conv_id, turn, CASE WHEN regexp_matches(lower(text), 'weather|stock') THEN 'external' WHEN regexp_matches(lower(text), '[?]') THEN 'question' ELSE 'none' END AS missing FROM conversations WHERE role = 'user'")
def capability_gate(t):
    rules = [("weather|stock", "external"), ("[?]", "question")]
    out = F.lit("none")
    for pattern, name in reversed(rules):
        out = F.when(F.lower("text").rlike(pattern), name).otherwise(out)
    return t.conversations.where("role = 'user'").select("conv_id", "turn", out.alias("missing"))


@query(f"SELECT source AS style, round(avg(y), 6) AS rate FROM {_PRED} GROUP BY 1 ORDER BY round(avg(y), 6) DESC, style LIMIT 1")
def ablation_winner(t):
    g = predictions(t).groupBy(F.col("source").alias("style")).agg(F.round(F.avg("y"), 6).alias("rate"))
    return g.orderBy(F.desc("rate"), "style").limit(1)


@query("SELECT doc_id, 1 - quality AS label, CAST(n_chars AS DOUBLE) AS f0, CAST(toxic AS DOUBLE) AS f1 FROM labels JOIN documents USING (doc_id) WHERE lang IS NOT NULL")
def routing_dataset(t):
    return t.labels.join(t.documents.where("lang IS NOT NULL").select("doc_id", "n_chars"), "doc_id").select("doc_id", (1 - F.col("quality")).alias("label"), F.col("n_chars").cast("double").alias("f0"), F.col("toxic").cast("double").alias("f1"))
