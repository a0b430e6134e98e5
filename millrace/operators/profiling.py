"""Column profiles: one pass over a table for the plain statistics, one for frequent values."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..registry import query
from .relational import CODES

TEXTS = ["o_orderstatus", "o_orderpriority"]


def stats(df: DataFrame, cols: list[str]) -> DataFrame:
    """column_name, null_ratio, n_distinct, min_value, max_value, avg_length of each column, in one scan."""
    aggs = []
    for i, c in enumerate(cols):
        x = F.col(c)
        aggs += [F.round(F.avg(x.isNull().cast("double")), 4).alias(f"n{i}"), F.count_distinct(x).alias(f"d{i}"), F.min(x).cast("string").alias(f"a{i}"), F.max(x).cast("string").alias(f"b{i}"), F.round(F.avg(F.length(x.cast("string"))), 4).alias(f"l{i}")]
    row = df.agg(*aggs)
    parts = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"n{i}").alias("null_ratio"), F.col(f"d{i}").alias("n_distinct"), F.col(f"a{i}").alias("min_value"), F.col(f"b{i}").alias("max_value"), F.col(f"l{i}").alias("avg_length")) for i, c in enumerate(cols)])
    return row.select(F.explode(parts).alias("p")).select("p.*")


def top_values(df: DataFrame, cols: list[str], k: int = 25) -> DataFrame:
    """column_name, value, n, r: the k commonest values of each column, ties in order of the text."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("value")) for c in cols]))
    counts = df.select(pairs.alias("p")).select("p.*").where("value IS NOT NULL").groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n"))
    r = F.row_number().over(Window.partitionBy("column_name").orderBy(F.desc("n"), "value"))  # with the limit, a group-limited window
    return counts.withColumn("r", r).where(F.col("r") <= k)


def _each(exprs: str) -> str:
    return " UNION ALL ".join(f"SELECT '{c}' AS column_name, {exprs.replace('?', c)} FROM orders" for c in TEXTS)


@query(_each("round(avg(CASE WHEN ? IS NULL THEN 1.0 ELSE 0.0 END), 4) AS null_ratio"))
def profile_nulls(t):
    return stats(t.orders, TEXTS).select("column_name", "null_ratio")


@query(_each("count(DISTINCT ?) AS n_distinct"))
def profile_distinct(t):
    return stats(t.orders, TEXTS).select("column_name", "n_distinct")


@query(_each("min(?) AS min_value, max(?) AS max_value"))
def profile_minmax(t):
    return stats(t.orders, TEXTS).select("column_name", "min_value", "max_value")


@query(_each("round(avg(length(?)), 4) AS avg_length"))
def profile_avg_length(t):
    return stats(t.orders, TEXTS).select("column_name", "avg_length")


_TOP = " UNION ALL ".join(f"SELECT '{c}' AS column_name, {c} AS value, count(*) AS n FROM part GROUP BY 2" for c in ("p_brand", "p_type"))


@query(f"SELECT column_name, value, n FROM (SELECT *, row_number() OVER (PARTITION BY column_name ORDER BY n DESC, value) AS r FROM ({_TOP})) WHERE r <= 5")
def profile_top_values(t):
    return top_values(t.part, ["p_brand", "p_type"], 5).drop("r")


@query("SELECT column_name, n > 0 AND n <= 40 AS is_categorical FROM (SELECT 'p_brand' AS column_name, count(DISTINCT p_brand) AS n FROM part UNION ALL SELECT 'p_name', count(DISTINCT p_name) FROM part UNION ALL SELECT 'p_type', count(DISTINCT p_type) FROM part)")
def profile_roles(t):
    return stats(t.part, ["p_brand", "p_name", "p_type"]).select("column_name", F.col("n_distinct").between(1, 40).alias("is_categorical"))


@query("SELECT * FROM (VALUES ('day', true), ('code', false)) AS v(column_name, is_date)")
def profile_date_detect(t):
    df = t.orders.select(F.date_format("o_orderdate", "yyyyMMdd").alias("day"), F.lpad(F.col("o_orderkey").cast("string"), 8, "9").alias("code"))
    top = top_values(df, ["day", "code"], 8)
    ok = F.every(F.col("value").rlike("^[0-9]{8}$") & F.substring("value", 1, 4).between("1900", "2100"))
    return top.groupBy("column_name").agg(ok.alias("is_date"))


@query("SELECT * FROM (VALUES ('LINE_STAT', 'F=Final;O=Ongoing'), ('ORD_STAT', 'F=Fulfilled;O=Open;P=Partial')) AS v(cd_grp, labels)")
def code_dictionary_map(t):
    rows = t.values("cd_grp string, cd string, cd_nm string", CODES).where(F.col("cd_grp").isin("ORD_STAT", "LINE_STAT"))
    m = F.array_sort(F.map_entries(F.map_from_entries(F.collect_list(F.struct("cd", "cd_nm")))))
    return rows.groupBy("cd_grp").agg(F.array_join(F.transform(m, lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";").alias("labels"))


def role(name: str, kind: str, n_distinct: int) -> str:
    """What a column is for: key, measure, date, code or label."""
    if name.endswith("key"):
        return "key"
    if kind.startswith("timestamp") or kind == "date":
        return "date"
    if kind == "string":
        return "code" if 0 < n_distinct <= 40 else "label"
    return "measure"


@query("SELECT * FROM (VALUES ('o_orderkey', 'key'), ('o_custkey', 'key'), ('o_orderstatus', 'code'), ('o_totalprice', 'measure'), ('o_orderdate', 'date'), ('o_orderpriority', 'code')) AS v(column_name, role)")
def column_roles(t):
    kinds = dict(t.orders.dtypes)
    texts = [c for c, k in kinds.items() if k == "string"]
    n = {r.column_name: r.n_distinct for r in stats(t.orders, texts).collect()}
    return t.values("column_name string, role string", [(c, role(c, k, n.get(c, 0))) for c, k in kinds.items()])


@query("WITH v AS (SELECT p_size AS x, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, CAST(p_size AS VARCHAR) LIMIT 25), s AS (SELECT x, row_number() OVER (ORDER BY x) - 1 AS i, count(*) OVER () AS k FROM v) SELECT x AS threshold FROM s WHERE i = CAST(round_even(0.75 * (k - 1), 0) AS BIGINT)")
def modal_quantile(t):
    """The three-quarter order statistic of a column's commonest values, by the nearest rank."""
    top = top_values(t.part, ["p_size"], 25).select(F.col("value").cast("int").alias("x"))
    xs = F.sort_array(F.collect_list("x"))
    return top.agg(xs.alias("xs")).select(F.get("xs", F.bround(F.lit(0.75) * (F.size("xs") - 1), 0).cast("int")).alias("threshold"))


@query(
    "WITH b AS (SELECT min(o_orderdate)::DATE AS a, max(o_orderdate)::DATE AS z FROM orders), q AS (SELECT y, k, make_date(y, 3 * k - 2, 1) AS first, (make_date(y, 3 * k - 2, 1) + INTERVAL 3 MONTH - INTERVAL 1 DAY)::DATE AS last FROM range(1990, 2011) r(y), range(1, 5) s(k)) SELECT CAST(y AS VARCHAR) || 'Q' || k AS win, strftime(first, '%Y%m%d') AS first, strftime(last, '%Y%m%d') AS last FROM q, b WHERE date_diff('day', greatest(first, a), least(last, z)) + 1 >= 45"
)
def calendar_windows(t):
    """Quarters that the observed range overlaps by 45 days or more."""
    b = t.orders.agg(F.min("o_orderdate").cast("date").alias("a"), F.max("o_orderdate").cast("date").alias("z"))
    first = F.explode(F.sequence(F.trunc("a", "quarter"), F.col("z"), F.expr("INTERVAL 3 MONTH"))).alias("first")
    w = b.select("a", "z", first).withColumn("last", F.date_sub(F.add_months("first", 3), 1))
    w = w.where(F.datediff(F.least("last", "z"), F.greatest("first", "a")) + 1 >= 45)
    return w.select(F.concat(F.year("first"), F.lit("Q"), F.quarter("first")).alias("win"), F.date_format("first", "yyyyMMdd").alias("first"), F.date_format("last", "yyyyMMdd").alias("last"))
