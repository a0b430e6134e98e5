"""Relational query shapes: filters, joins, aggregates, windows emulated by the surface language, top-k.

Roles: orders is the contract fact (o_orderdate as an 8-digit string, o_orderstatus its code), lineitem the detail fact,
customer -> nation -> region the two-hop dimension, part the product, CODES the shared code table.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.quantiles import top_rows
from ..functions.scalars import d8, nice_threshold, parse_d8, quarter_of
from ..registry import Tables, query

#: The shared code table (group, code, label).
CODES = [
    ("ORD_STAT", "F", "Fulfilled"), ("ORD_STAT", "O", "Open"), ("ORD_STAT", "P", "Partial"),
    ("RET_FLAG", "A", "Accepted"), ("RET_FLAG", "N", "None"), ("RET_FLAG", "R", "Returned"),
    ("LINE_STAT", "F", "Final"), ("LINE_STAT", "O", "Ongoing"),
    ("PRIORITY", "1-URGENT", "Urgent"), ("PRIORITY", "2-HIGH", "High"), ("PRIORITY", "3-MEDIUM", "Medium"),
]
CODES_SQL = "(VALUES " + ", ".join(f"('{g}', '{c}', '{n}')" for g, c, n in CODES) + ") AS code(cd_grp, cd, cd_nm)"
D8 = "strftime(o_orderdate, '%Y%m%d')"
S8 = "strftime(l_shipdate, '%Y%m%d')"


def codes(t: Tables, group: str) -> DataFrame:
    """One group of the code table; an in-code list, so it is broadcast."""
    rows = t.values("cd_grp string, cd string, cd_nm string", CODES).where(F.col("cd_grp") == group)
    return F.broadcast(rows.select("cd", "cd_nm"))


def between(col: str, first: str, last: str) -> Column:
    """An inclusive window on a timestamp, given as 8-digit days; a range that the scan can use."""
    low, high = (F.to_timestamp_ntz(F.lit(x), F.lit("yyyyMMdd")) for x in (first, last))
    return (F.col(col) >= low) & (F.col(col) < high + F.expr("INTERVAL 1 DAY"))


def ratio(num: Column, den: Column) -> Column:
    return F.round(num.cast("double") / F.nullif(den, F.lit(0)), 4)


def n_rows() -> Column:
    return F.count(F.lit(1))


# --- projections, filters, predicates


@query("SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders")
def scan_table(t):
    return t.orders.select("o_orderkey", "o_orderstatus", "o_totalprice")


@query("SELECT c_name AS customer, c_mktsegment AS segment FROM customer")
def project_alias(t):
    return t.customer.select(F.col("c_name").alias("customer"), F.col("c_mktsegment").alias("segment"))


@query("SELECT o_orderkey, o_totalprice, o_custkey, o_orderstatus, o_orderpriority FROM orders WHERE o_totalprice > 400000")
def fallback_projection(t):
    # Key first, then the measure, then what links best; never a bare star.
    return t.orders.where("o_totalprice > 400000").select("o_orderkey", "o_totalprice", "o_custkey", "o_orderstatus", "o_orderpriority")


@query("SELECT * FROM nation")
def star_expand(t):
    df = t.nation
    return df.select(*df.columns)


@query("SELECT count(*) AS cnt FROM orders WHERE o_orderstatus = 'F'")
def count_by_code(t):
    return t.orders.where(F.col("o_orderstatus") == "F").agg(n_rows().alias("cnt"))


@query(f"SELECT count(*) AS cnt FROM orders WHERE {D8} BETWEEN '19970101' AND '19970630'")
def count_in_window(t):
    return t.orders.where(between("o_orderdate", "19970101", "19970630")).agg(n_rows().alias("cnt"))


@query(f"SELECT count(*) AS cnt FROM orders WHERE {D8} BETWEEN '19960101' AND '19960331' OR {D8} BETWEEN '19970101' AND '19970331'")
def multi_window_or(t):
    windows = [("19960101", "19960331"), ("19970101", "19970331")]
    return t.orders.where(reduce(lambda a, b: a | b, [between("o_orderdate", *w) for w in windows])).agg(n_rows().alias("cnt"))


@query("SELECT count(*) AS cnt FROM orders WHERE o_totalprice >= 250000")
def count_over_threshold(t):
    return t.orders.where("o_totalprice >= 250000").agg(n_rows().alias("cnt"))


@query(f"SELECT count(*) AS cnt FROM orders WHERE o_orderstatus IN (SELECT cd FROM {CODES_SQL} WHERE cd_grp = 'ORD_STAT' AND cd_nm = 'Open')")
def label_to_code_filter(t):
    return t.orders.join(codes(t, "ORD_STAT").where("cd_nm = 'Open'"), F.col("o_orderstatus") == F.col("cd"), "left_semi").agg(n_rows().alias("cnt"))


@query("SELECT p_partkey, p_name FROM part WHERE lower(p_name) LIKE '%re%' AND p_size < 10")
def name_like_filter(t):
    return t.part.where(F.lower("p_name").contains("re") & (F.col("p_size") < 10)).select("p_partkey", "p_name")


@query(f"SELECT o_orderstatus, count(*) AS cnt FROM orders WHERE (o_totalprice > 300000 AND o_orderpriority = '1-URGENT') AND {D8} BETWEEN '19970101' AND '19971231' GROUP BY 1")
def glossary_filter(t):
    terms = {"large urgent order": "o_totalprice > 300000 AND o_orderpriority = '1-URGENT'"}
    return t.orders.where(F.expr(terms["large urgent order"]) & between("o_orderdate", "19970101", "19971231")).groupBy("o_orderstatus").agg(n_rows().alias("cnt"))


@query(f"SELECT round(sum(o_totalprice), 2) AS val FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderstatus = 'F' AND {D8} BETWEEN '19970101' AND '19971231' AND o_totalprice >= 100000 AND c_mktsegment = 'BUILDING'")
def multi_predicate(t):
    o = t.orders.where((F.col("o_orderstatus") == "F") & between("o_orderdate", "19970101", "19971231") & (F.col("o_totalprice") >= 100000))
    return o.join(t.customer.where("c_mktsegment = 'BUILDING'"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").agg(F.round(F.sum("o_totalprice"), 2).alias("val"))


@query("SELECT sum(CASE WHEN done IS NULL THEN 1 ELSE 0 END)::BIGINT AS open_cnt, count(done) AS done_cnt FROM (SELECT CASE WHEN o_orderstatus = 'F' THEN o_orderdate END AS done FROM orders)")
def null_test(t):
    done = F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate"))
    return t.orders.agg(F.count_if(done.isNull()).alias("open_cnt"), F.count(done).alias("done_cnt"))


@query("SELECT o_orderpriority, count(*) AS cnt FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') GROUP BY 1")
def in_list(t):
    return t.orders.where(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH")).groupBy("o_orderpriority").agg(n_rows().alias("cnt"))


@query(f"SELECT count(*) AS cnt FROM orders WHERE substr({D8}, 1, 4) IN ('1996', '1998')")
def year_filter(t):
    return t.orders.where(between("o_orderdate", "19960101", "19961231") | between("o_orderdate", "19980101", "19981231")).agg(n_rows().alias("cnt"))


@query("SELECT count(*) AS cnt FROM (SELECT l_orderkey, sum(l_extendedprice) AS s FROM lineitem GROUP BY 1) JOIN orders ON o_orderkey = l_orderkey WHERE s > o_totalprice")
def agg_vs_column(t):
    per = t.lineitem.groupBy("l_orderkey").agg(F.sum("l_extendedprice").alias("s"))
    return per.join(t.orders, F.col("o_orderkey") == F.col("l_orderkey")).where("s > o_totalprice").agg(n_rows().alias("cnt"))


@query("SELECT count(*) AS cnt FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) FROM orders)")
def above_global_avg(t):
    mean = t.orders.agg(F.avg("o_totalprice").alias("m"))
    return t.orders.select("o_totalprice").where(F.col("o_totalprice") > mean.scalar()).agg(n_rows().alias("cnt"))


# --- joins


@query("SELECT c_mktsegment AS grp, count(*) AS val FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1 ORDER BY val DESC, grp LIMIT 3")
def group_by_dimension(t):
    return t.orders.join(t.customer, F.col("c_custkey") == F.col("o_custkey")).groupBy(F.col("c_mktsegment").alias("grp")).agg(n_rows().alias("val")).orderBy(F.desc("val"), "grp").limit(3)


@query(f"SELECT n_name AS grp, count(*) AS val FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey WHERE {D8} BETWEEN '19970701' AND '19971231' GROUP BY 1 ORDER BY val DESC, grp LIMIT 10")
def three_table_join(t):
    o = t.orders.where(between("o_orderdate", "19970701", "19971231"))
    j = o.join(t.customer, F.col("c_custkey") == F.col("o_custkey")).join(t.nation, F.col("n_nationkey") == F.col("c_nationkey"))
    return j.groupBy(F.col("n_name").alias("grp")).agg(n_rows().alias("val")).orderBy(F.desc("val"), "grp").limit(10)


@query("SELECT r_name AS grp, round(avg(l_quantity), 4) AS val FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY 1")
def four_table_join(t):
    j = t.lineitem.join(t.supplier, F.col("s_suppkey") == F.col("l_suppkey")).join(t.nation, F.col("n_nationkey") == F.col("s_nationkey")).join(t.region, F.col("r_regionkey") == F.col("n_regionkey"))
    return j.groupBy(F.col("r_name").alias("grp")).agg(F.round(F.avg("l_quantity"), 4).alias("val"))


@query(f"SELECT cd_nm AS grp, count(*) AS cnt, round(sum(o_totalprice), 2) AS val FROM orders JOIN {CODES_SQL} ON cd = o_orderstatus AND cd_grp = 'ORD_STAT' GROUP BY 1")
def code_label_join(t):
    return t.orders.join(codes(t, "ORD_STAT"), F.col("cd") == F.col("o_orderstatus")).groupBy(F.col("cd_nm").alias("grp")).agg(n_rows().alias("cnt"), F.round(F.sum("o_totalprice"), 2).alias("val"))


@query(f"SELECT o_orderpriority, cd_nm AS label, count(*) AS cnt FROM orders LEFT JOIN {CODES_SQL} ON cd = o_orderpriority AND cd_grp = 'PRIORITY' GROUP BY 1, 2")
def code_label_left(t):
    return t.orders.join(codes(t, "PRIORITY"), F.col("cd") == F.col("o_orderpriority"), "left").groupBy("o_orderpriority", F.col("cd_nm").alias("label")).agg(n_rows().alias("cnt"))


@query(
    f"SELECT a.cd_nm AS flag, b.cd_nm AS status, count(*) AS cnt FROM lineitem JOIN (SELECT * FROM {CODES_SQL}) a ON a.cd = l_returnflag AND a.cd_grp = 'RET_FLAG' JOIN (SELECT * FROM {CODES_SQL}) b ON b.cd = l_linestatus AND b.cd_grp = 'LINE_STAT' GROUP BY 1, 2"
)
def double_code_join(t):
    a, b = (codes(t, g).select(F.col("cd").alias(f"{x}_cd"), F.col("cd_nm").alias(x)) for g, x in (("RET_FLAG", "flag"), ("LINE_STAT", "status")))
    return t.lineitem.join(a, F.col("flag_cd") == F.col("l_returnflag")).join(b, F.col("status_cd") == F.col("l_linestatus")).groupBy("flag", "status").agg(n_rows().alias("cnt"))


@query(f"SELECT c_custkey, count(o_orderkey) AS cnt FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND {D8} BETWEEN '19970101' AND '19970331' GROUP BY 1 HAVING count(o_orderkey) <= 1")
def left_join_zero_groups(t):
    o = t.orders.where(between("o_orderdate", "19970101", "19970331")).groupBy("o_custkey").agg(n_rows().alias("k"))
    return t.customer.join(o, F.col("o_custkey") == F.col("c_custkey"), "left").select("c_custkey", F.coalesce("k", F.lit(0)).alias("cnt")).where("cnt <= 1")


@query("SELECT count(*) AS cnt FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def anti_join_not_exists(t):
    return t.orders.join(t.lineitem, F.col("l_orderkey") == F.col("o_orderkey"), "left_anti").agg(n_rows().alias("cnt"))


@query(f"SELECT o_orderstatus AS grp, count(*) AS cnt FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND {S8} BETWEEN '19970101' AND '19971231' WHERE l_orderkey IS NULL GROUP BY 1")
def left_join_is_null(t):
    child = t.lineitem.where(between("l_shipdate", "19970101", "19971231"))
    return t.orders.join(child, F.col("l_orderkey") == F.col("o_orderkey"), "left_anti").groupBy(F.col("o_orderstatus").alias("grp")).agg(n_rows().alias("cnt"))


@query("SELECT o_orderstatus AS grp, round(sum(o_totalprice), 2) AS val FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') GROUP BY 1")
def exists_fanout_semi(t):
    # A child on a non-unique key that only filters must not multiply its parent: semi-join, never inner join.
    return t.orders.join(t.lineitem.where("l_returnflag = 'R'"), F.col("l_orderkey") == F.col("o_orderkey"), "left_semi").groupBy(F.col("o_orderstatus").alias("grp")).agg(F.round(F.sum("o_totalprice"), 2).alias("val"))


@query("SELECT count(*) AS cnt FROM events WHERE user_id IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)")
def in_subquery_semi(t):
    return t.events.join(t.orders.where("o_totalprice > 400000"), F.col("user_id") == F.col("o_custkey"), "left_semi").agg(n_rows().alias("cnt"))


@query("WITH g AS (SELECT o_orderstatus, o_orderpriority, count(*) AS cnt FROM orders GROUP BY 1, 2), m AS (SELECT o_orderstatus, max(cnt) AS mx FROM g GROUP BY 1) SELECT g.o_orderstatus, o_orderpriority, cnt FROM g JOIN m ON m.o_orderstatus = g.o_orderstatus AND cnt = mx")
def argmax_per_group(t):
    g = t.orders.groupBy("o_orderstatus", "o_orderpriority").agg(n_rows().alias("cnt"))
    return g.withColumn("r", F.rank().over(Window.partitionBy("o_orderstatus").orderBy(F.desc("cnt")))).where("r = 1").drop("r")


@query(f"WITH m AS (SELECT substr({D8}, 1, 6) AS ym, count(*) AS cnt FROM orders GROUP BY 1) SELECT a.ym, a.cnt, b.cnt AS prev_cnt, a.cnt - b.cnt AS diff FROM m a JOIN m b ON CAST(b.ym AS INT) = CAST(a.ym AS INT) - 1")
def self_join_prev_month(t):
    m = t.orders.groupBy(F.substring(d8("o_orderdate"), 1, 6).alias("ym")).agg(n_rows().alias("cnt"))
    b = m.select((F.col("ym").cast("int") + 1).alias("nxt"), F.col("cnt").alias("prev_cnt"))
    return m.join(b, F.col("ym").cast("int") == F.col("nxt")).select("ym", "cnt", "prev_cnt", (F.col("cnt") - F.col("prev_cnt")).alias("diff"))


@query("WITH g AS (SELECT n_name AS grp, round(sum(s_acctbal), 2) AS amt FROM supplier JOIN nation ON n_nationkey = s_nationkey GROUP BY 1) SELECT grp, amt, (SELECT 1 + count(*) FROM g b WHERE b.amt > a.amt) AS rnk FROM g a")
def rank_emulation(t):
    g = t.supplier.join(t.nation, F.col("n_nationkey") == F.col("s_nationkey")).groupBy(F.col("n_name").alias("grp")).agg(F.round(F.sum("s_acctbal"), 2).alias("amt"))
    return g.withColumn("rnk", F.rank().over(Window.orderBy(F.desc("amt"))).cast("bigint"))  # one row a nation


# --- aggregation


@query("SELECT count(*) AS cnt FROM lineitem")
def count_star(t):
    return t.lineitem.agg(n_rows().alias("cnt"))


@query(f"SELECT round(sum(o_totalprice), 2) AS s, round(avg(o_totalprice), 4) AS a, min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders WHERE {D8} BETWEEN '19960101' AND '19961231'")
def aggregate_in_window(t):
    p = F.col("o_totalprice")
    return t.orders.where(between("o_orderdate", "19960101", "19961231")).agg(F.round(F.sum(p), 2).alias("s"), F.round(F.avg(p), 4).alias("a"), F.min(p).alias("lo"), F.max(p).alias("hi"))


@query("SELECT round(avg(o_totalprice), 4) AS val FROM orders WHERE o_orderstatus = 'P'")
def aggregate_by_code(t):
    return t.orders.where("o_orderstatus = 'P'").agg(F.round(F.avg("o_totalprice"), 4).alias("val"))


@query(f"SELECT count(DISTINCT o_custkey) AS cnt FROM orders WHERE {D8} BETWEEN '19970101' AND '19971231'")
def distinct_count(t):
    return t.orders.where(between("o_orderdate", "19970101", "19971231")).agg(F.count_distinct("o_custkey").alias("cnt"))


def _trend(t, width: int):
    return t.orders.groupBy(F.substring(d8("o_orderdate"), 1, width).alias("bucket")).agg(n_rows().alias("cnt"), F.round(F.sum("o_totalprice"), 2).alias("val"))


def _trend_sql(width: int) -> str:
    return f"SELECT substr({D8}, 1, {width}) AS bucket, count(*) AS cnt, round(sum(o_totalprice), 2) AS val FROM orders GROUP BY 1"


@query(_trend_sql(6))
def date_bucket_month(t):
    return _trend(t, 6)


@query(_trend_sql(4))
def date_bucket_year(t):
    return _trend(t, 4)


@query(f"SELECT substr({D8}, 1, 4) || 'Q' || ((CAST(substr({D8}, 5, 2) AS INT) + 2) // 3) AS bucket, count(*) AS cnt FROM orders GROUP BY 1")
def date_bucket_quarter(t):
    return t.orders.groupBy(quarter_of(d8("o_orderdate")).alias("bucket")).agg(n_rows().alias("cnt"))


@query("SELECT n_name AS grp, count(*) AS cnt FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY 1 HAVING count(*) > 50")
def having_threshold(t):
    return t.customer.join(t.nation, F.col("n_nationkey") == F.col("c_nationkey")).groupBy(F.col("n_name").alias("grp")).agg(n_rows().alias("cnt")).where("cnt > 50")


@query("SELECT p_type AS grp, round(avg(p_retailprice), 4) AS val FROM part GROUP BY 1 HAVING avg(p_retailprice) >= 951")
def having_avg(t):
    return t.part.groupBy(F.col("p_type").alias("grp")).agg(F.avg("p_retailprice").alias("v")).where("v >= 951").select("grp", F.round("v", 4).alias("val"))


@query("SELECT c_nationkey AS grp, round(avg(c_acctbal), 4) AS val FROM customer GROUP BY 1 HAVING avg(c_acctbal) > (SELECT avg(c_acctbal) FROM customer)")
def having_vs_global(t):
    mean = t.customer.agg(F.avg("c_acctbal").alias("m"))
    return t.customer.groupBy(F.col("c_nationkey").alias("grp")).agg(F.avg("c_acctbal").alias("v")).where(F.col("v") > mean.scalar()).select("grp", F.round("v", 4).alias("val"))


@query("SELECT l_linestatus AS grp, round(CAST(sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS DOUBLE) / nullif(count(*), 0), 4) AS ratio FROM lineitem GROUP BY 1")
def conditional_ratio(t):
    return t.lineitem.groupBy(F.col("l_linestatus").alias("grp")).agg(ratio(F.count_if(F.col("l_returnflag") == "R"), n_rows()).alias("ratio"))


@query("SELECT o_orderpriority AS grp, round(CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM orders), 4) AS share FROM orders GROUP BY 1")
def share_of_total(t):
    g = t.orders.groupBy(F.col("o_orderpriority").alias("grp")).agg(n_rows().alias("c"))
    return g.select("grp", ratio(F.col("c"), F.sum("c").over(Window.partitionBy())).alias("share"))  # one row a code


@query("SELECT l_returnflag AS grp, round(sum(l_extendedprice * l_discount) / nullif(sum(l_extendedprice), 0), 6) AS ratio FROM lineitem GROUP BY 1 ORDER BY sum(l_extendedprice * l_discount) / sum(l_extendedprice), grp LIMIT 1")
def ratio_of_sums(t):
    g = t.lineitem.groupBy(F.col("l_returnflag").alias("grp")).agg((F.sum(F.col("l_extendedprice") * F.col("l_discount")) / F.nullif(F.sum("l_extendedprice"), F.lit(0))).alias("r"))
    return g.orderBy("r", "grp").limit(1).select("grp", F.round("r", 6).alias("ratio"))


@query("WITH p AS (SELECT o_custkey AS grp, sum(o_totalprice) AS amt FROM orders GROUP BY 1) SELECT grp, round(amt, 2) AS amt FROM p WHERE amt > (SELECT avg(amt) FROM p)")
def cte_two_stage(t):
    p = t.orders.groupBy(F.col("o_custkey").alias("grp")).agg(F.sum("o_totalprice").alias("amt"))
    return p.where(F.col("amt") > p.agg(F.avg("amt")).scalar()).select("grp", F.round("amt", 2).alias("amt"))


@query("SELECT c_mktsegment AS grp, round(max(s), 2) AS val, round(avg(s), 2) AS mean FROM (SELECT c_mktsegment, c_custkey, sum(o_totalprice) AS s FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2) GROUP BY 1")
def nested_aggregate(t):
    per = t.orders.groupBy("o_custkey").agg(F.sum("o_totalprice").alias("s"))  # summed before the join
    return per.join(t.customer, F.col("c_custkey") == F.col("o_custkey")).groupBy(F.col("c_mktsegment").alias("grp")).agg(F.round(F.max("s"), 2).alias("val"), F.round(F.avg("s"), 2).alias("mean"))


@query(
    f"SELECT o_orderstatus AS grp, round(sum(CASE WHEN {D8} BETWEEN '19970101' AND '19971231' THEN o_totalprice ELSE 0 END), 2) AS cur_amt, round(sum(CASE WHEN {D8} BETWEEN '19960101' AND '19961231' THEN o_totalprice ELSE 0 END), 2) AS prev_amt, round(sum(CASE WHEN {D8} BETWEEN '19970101' AND '19971231' THEN o_totalprice ELSE 0 END) / nullif(sum(CASE WHEN {D8} BETWEEN '19960101' AND '19961231' THEN o_totalprice ELSE 0 END), 0) - 1, 4) AS growth FROM orders WHERE {D8} BETWEEN '19960101' AND '19971231' GROUP BY 1"
)
def period_over_period(t):
    part = lambda y: F.sum(F.when(between("o_orderdate", f"{y}0101", f"{y}1231"), F.col("o_totalprice")).otherwise(0.0))
    g = t.orders.where(between("o_orderdate", "19960101", "19971231")).groupBy(F.col("o_orderstatus").alias("grp")).agg(part(1997).alias("c"), part(1996).alias("p"))
    return g.select("grp", F.round("c", 2).alias("cur_amt"), F.round("p", 2).alias("prev_amt"), F.round(F.col("c") / F.nullif("p", F.lit(0.0)) - 1, 4).alias("growth"))


@query(
    "SELECT n_name AS grp, count(*) AS cnt, round(sum(o_totalprice), 2) AS amt FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity >= 49) GROUP BY 1 HAVING count(*) >= 20"
)
def join_having_subquery(t):
    o = t.orders.join(t.lineitem.where("l_quantity >= 49"), F.col("l_orderkey") == F.col("o_orderkey"), "left_semi")
    j = o.join(t.customer, F.col("c_custkey") == F.col("o_custkey")).join(t.nation, F.col("n_nationkey") == F.col("c_nationkey"))
    return j.groupBy(F.col("n_name").alias("grp")).agg(n_rows().alias("cnt"), F.round(F.sum("o_totalprice"), 2).alias("amt")).where("cnt >= 20")


@query("WITH busy AS (SELECT user_id FROM events GROUP BY 1 HAVING count(*) >= 8), amt AS (SELECT o_custkey, sum(o_totalprice) AS s FROM orders WHERE o_custkey IN (SELECT user_id FROM busy) GROUP BY 1) SELECT round(avg(s), 4) AS val, count(*) AS cnt FROM amt")
def cte_nested_filter_avg(t):
    busy = t.events.groupBy("user_id").agg(n_rows().alias("n")).where("n >= 8")
    amt = t.orders.join(busy, F.col("user_id") == F.col("o_custkey"), "left_semi").groupBy("o_custkey").agg(F.sum("o_totalprice").alias("s"))
    return amt.agg(F.round(F.avg("s"), 4).alias("val"), n_rows().alias("cnt"))


@query(f"WITH s AS (SELECT o_custkey, min({D8}) AS a, max({D8}) AS b FROM orders GROUP BY 1 HAVING count(*) >= 2) SELECT round(avg(date_diff('day', strptime(a, '%Y%m%d'), strptime(b, '%Y%m%d'))), 4) AS val FROM s")
def avg_span_days(t):
    g = t.orders.groupBy("o_custkey").agg(F.min(d8("o_orderdate")).alias("a"), F.max(d8("o_orderdate")).alias("b"), n_rows().alias("n")).where("n >= 2")
    return g.agg(F.round(F.avg(F.datediff(parse_d8("b"), parse_d8("a"))), 4).alias("val"))


@query("SELECT o_orderkey AS id, o_totalprice AS val FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def top_n_rows(t):
    return t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("val")).orderBy(F.desc("val"), "id").limit(10)


@query(f"SELECT substr({D8}, 1, 6) AS bucket, count(*) AS cnt FROM orders GROUP BY 1 ORDER BY bucket LIMIT 12")
def trend_chronological(t):
    return t.orders.groupBy(F.substring(d8("o_orderdate"), 1, 6).alias("bucket")).agg(n_rows().alias("cnt")).orderBy("bucket").limit(12)


@query("SELECT id, amt FROM (SELECT o_custkey AS id, round(sum(o_totalprice), 2) AS amt, row_number() OVER (ORDER BY round(sum(o_totalprice), 2) DESC, o_custkey) AS r, count(*) OVER () AS n FROM orders GROUP BY o_custkey) WHERE r <= floor(n * 0.1)")
def top_percent(t):
    g = t.orders.groupBy(F.col("o_custkey").alias("id")).agg(F.round(F.sum("o_totalprice"), 2).alias("amt"))
    # The cut is found by counting cents; only the rows at the cut are ranked.
    return top_rows(g, F.round(F.col("amt") * 100).cast("bigint"), int(g.count() * 0.1), "id")


@query(f"SELECT round(avg(date_diff('day', strptime({D8}, '%Y%m%d'), strptime({S8}, '%Y%m%d'))), 4) AS val FROM lineitem JOIN orders ON o_orderkey = l_orderkey")
def date_diff_avg(t):
    return t.lineitem.join(t.orders, F.col("o_orderkey") == F.col("l_orderkey")).agg(F.round(F.avg(F.datediff("l_shipdate", "o_orderdate")), 4).alias("val"))


@query(f"SELECT round(avg(2026 - CAST(substr({D8}, 1, 4) AS INT)), 4) AS val FROM orders")
def year_diff_avg(t):
    return t.orders.agg(F.round(F.avg(2026 - F.substring(d8("o_orderdate"), 1, 4).cast("int")), 4).alias("val"))


_NICE = "CASE WHEN abs(x) >= 100000000 THEN round_even(x / 100000000, 0) * 100000000 WHEN abs(x) >= 10000 THEN round_even(x / 10000, 0) * 10000 WHEN abs(x) >= 100 THEN round_even(x / 100, 0) * 100 ELSE round_even(x, 0) END"


@query(f"SELECT o_orderkey, {_NICE.replace('x', 'o_totalprice')} AS nice FROM orders")
def nice_round(t):
    return t.orders.select("o_orderkey", nice_threshold(F.col("o_totalprice")).alias("nice"))


@query("SELECT p_brand AS a, count(*) AS cnt FROM part WHERE p_size <= 5 GROUP BY 1 UNION ALL SELECT p_type, count(*) FROM part WHERE p_size <= 5 GROUP BY 1")
def union_branches(t):
    p = t.part.where("p_size <= 5")
    return p.groupBy(F.col("p_brand").alias("a")).agg(n_rows().alias("cnt")).union(p.groupBy("p_type").agg(n_rows().alias("cnt")))


@query("SELECT count(*) AS cnt FROM (SELECT c_custkey FROM customer INTERSECT SELECT o_custkey FROM orders)")
def intersect_keys(t):
    return t.customer.select("c_custkey").intersect(t.orders.select("o_custkey")).agg(n_rows().alias("cnt"))


@query("SELECT count(*) AS cnt FROM (SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders)")
def except_keys(t):
    return t.customer.select("c_custkey").subtract(t.orders.select("o_custkey")).agg(n_rows().alias("cnt"))
