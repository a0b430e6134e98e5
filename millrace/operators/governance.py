"""Policy operators over the tables: catalog, masks, row policies, verdicts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.checks import Dictionary
from ..plans.checks import check as check_text
from ..plans.guard import Guard, Policy, RowPolicy, capped, holds, mask
from ..plans.intent import classify
from ..plans.joins import EDGES, JoinGraph, nearest
from ..plans.repair import Catalog, repair
from ..plans.runtime import ship_package
from ..registry import Tables, query

NAMES = ("customer", "lineitem", "nation", "orders", "part", "region", "supplier")
COLUMNS = {
    "customer": ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"],
    "orders": ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"],
    "nation": ["n_nationkey", "n_name", "n_regionkey"],
    "region": ["r_regionkey", "r_name"],
    "supplier": ["s_suppkey", "s_name", "s_nationkey", "s_acctbal"],
    "part": ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"],
    "lineitem": ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"],
}
GRADES = {f"{t}.{c}": "public" for t, cols in COLUMNS.items() for c in cols} | {"customer.c_name": "masked", "customer.c_acctbal": "internal", "supplier.s_acctbal": "internal", "supplier.s_name": "forbidden"}


def policy(**changes) -> Policy:
    base = dict(grades=GRADES, masks={"customer.c_name": "name"}, rows=[RowPolicy("segment scope", "customer", "c_mktsegment = {segment}", "segment", True)], k_tables=frozenset(["customer"]), k=5)
    return Policy(**(base | changes))


def guard(t: Tables, context: dict | None = None, **changes) -> Guard:
    return Guard(t.spark, t.folder, policy(**changes), context, NAMES)


def verdict(t: Tables, sql: str, context: dict | None = None):
    v = guard(t, context).check(sql).violations or [("ALLOWED", "info", "")]
    return t.values("code string, severity string, subject string", v)


def _answer(t: Tables, sql: str, context: dict | None = None):
    v = guard(t, context).check(sql)
    if not v.allowed:
        raise ValueError(v.violations)
    return v.result


def _values(rows: list[tuple], names: str) -> str:
    lit = lambda x: "NULL" if x is None else "'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x)
    return f"SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(lit, r)) + ')' for r in rows)}) AS v({names})"


_SCHEMA = sorted((t, c) for t in ("nation", "region", "customer") for c in COLUMNS[t])


@query("SELECT table_name, column_name FROM information_schema.columns WHERE table_name IN ('nation', 'region', 'customer')")
def schema_catalog(t):
    return t.values("table_name string, column_name string", [(n, c) for n in ("nation", "region", "customer") for c in getattr(t, n).columns])


@query(" UNION ALL ".join(f"SELECT '{n}' AS table_name, count(*) AS n_rows FROM {n}" for n in NAMES))
def table_row_counts(t):
    out = None
    for n in NAMES:
        one = getattr(t, n).agg(F.lit(n).alias("table_name"), F.count(F.lit(1)).alias("n_rows"))
        out = one if out is None else out.unionAll(one)
    return out


_CODED = ["ord_stat_cd", "flag_cd", "stat_cd", "priority_cd", "color_cd"]
_GROUPS = ["ORD_STAT", "RET_FLAG", "LINE_STAT", "PRIORITY"]


@query(_values([("ord_stat_cd", "ORD_STAT"), ("flag_cd", "RET_FLAG"), ("priority_cd", "PRIORITY")], "col, cd_grp"))
def code_group_inference(t):
    """A coded column's group: that of its stem, or the only group that ends in it."""
    cols = t.values("col string", [(c,) for c in _CODED]).withColumn("stem", F.upper(F.regexp_replace("col", "_cd$", "")))
    groups = t.values("cd_grp string", [(g,) for g in _GROUPS])
    met = cols.join(groups, F.col("cd_grp").endswith(F.col("stem"))).withColumn("exact", F.col("cd_grp") == F.col("stem"))  # tables of the catalog's size
    best = met.groupBy("col").agg(F.max(F.when(F.col("exact"), F.col("cd_grp"))).alias("e"), F.min("cd_grp").alias("m"), F.count("*").alias("n"))
    return best.where(F.col("e").isNotNull() | (F.col("n") == 1)).select("col", F.coalesce("e", "m").alias("cd_grp"))


_LINKS = f"links(a, b) AS (VALUES {', '.join(f"('{x}', '{y}')" for e in EDGES for x, y in ((e.child, e.parent), (e.parent, e.child)))})"


@query(
    f"""WITH RECURSIVE {_LINKS}, walk AS (SELECT 'lineitem' AS at_, ['lineitem'] AS path UNION ALL
    SELECT b, list_append(path, b) FROM walk JOIN links ON a = at_ WHERE NOT list_contains(path, b)),
    best AS (SELECT path FROM walk WHERE at_ = 'region' ORDER BY len(path), path LIMIT 1)
    SELECT CAST(i AS INTEGER) AS pos, path[i + 1] AS table_name FROM best, range(10) r(i) WHERE i < len(path)"""
)
def fk_shortest_path(t):
    return t.values("pos int, table_name string", list(enumerate(JoinGraph().path("lineitem", "region"))))


@query(_values([("customer",), ("nation",), ("orders",), ("part",), ("lineitem",)], "table_name"))
def steiner_connect(t):
    return t.values("table_name string", [(x,) for x in JoinGraph().connect(["part", "orders", "nation"])])


@query(f"WITH {_LINKS}, one AS (SELECT b AS t FROM links WHERE a = 'orders' UNION SELECT 'orders') SELECT t AS table_name FROM one UNION SELECT b FROM links JOIN one ON a = t")
def fk_expand(t):
    return t.values("table_name string", [(x,) for x in JoinGraph().expand(["orders"], 2)])


@query(_values([("lineitem", "semi"), ("nation", "inner"), ("customer", "bridge")], "table_name, how"))
def join_pruning(t):
    return t.values("table_name string, how string", JoinGraph().needed("orders", {"nation": "dimension", "lineitem": "filter", "part": "linked"}))


_CROSSED = {
    "SELECT n_name, r_name FROM nation, region": True,
    "SELECT n_name, r_name FROM nation, region WHERE n_regionkey = r_regionkey": False,
    "SELECT n_name, r_name FROM nation JOIN region ON true": True,
    "SELECT n_name, r_name FROM nation JOIN region ON n_nationkey > 0": True,
    "SELECT n_name, r_name FROM nation CROSS JOIN region": True,
    "SELECT n_name FROM nation, region, customer WHERE n_regionkey = r_regionkey AND c_nationkey = n_nationkey": False,
    "SELECT n_name FROM nation, region, customer WHERE n_regionkey = r_regionkey": True,
}


@query(_values([(s, "yes" if x else "no") for s, x in _CROSSED.items()], "statement, crossed"))
def cartesian_check(t):
    g = guard(t)
    return t.values("statement string, crossed string", [(s, "yes" if any(c == "CARTESIAN_JOIN" for c, _, _ in g.check(s).violations) else "no") for s in _CROSSED])


_WIDE = " JOIN ".join(["customer", "orders ON c_custkey = o_custkey", "lineitem ON o_orderkey = l_orderkey", "nation ON c_nationkey = n_nationkey", "region ON n_regionkey = r_regionkey", "part ON l_partkey = p_partkey"])


@query(_values([("aliases", 0), ("tables", 1)], "kind, n").replace("SELECT *", "SELECT kind, CAST(n AS INTEGER) AS n"))
def join_width(t):
    """Aliases of one table count once; a policy of five tables refuses six."""
    many = "SELECT a.n_name FROM nation a " + " ".join(f"JOIN nation b{i} ON a.n_nationkey = b{i}.n_nationkey" for i in range(8))
    g = guard(t, width=5)
    n = lambda sql: sum(c == "TOO_MANY_JOINS" for c, _, _ in g.check(sql).violations)
    return t.values("kind string, n int", [("aliases", n(many)), ("tables", n(f"SELECT n_name FROM {_WIDE}"))])


@query(_values([("GROUPBY_MISMATCH", "error")], "code, severity"))
def groupby_check(t):
    return verdict(t, "SELECT n_name, count(*) FROM nation GROUP BY n_regionkey").select("code", "severity")


@query("SELECT count(*) AS cnt FROM (SELECT o_orderkey FROM orders LIMIT 200)")
def limit_inject(t):
    return _answer(t, "SELECT o_orderkey FROM orders").agg(F.count("*").alias("cnt"))


@query("SELECT count(*) AS cnt FROM (SELECT o_orderkey FROM orders LIMIT 500)")
def limit_cap(t):
    return _answer(t, "SELECT o_orderkey FROM orders LIMIT 5000").agg(F.count("*").alias("cnt"))


@query("SELECT CAST(least(count(*), 100) AS BIGINT) AS n_rows, count(*) > 100 AS truncated FROM orders")
def truncate_flag(t):
    rows, more = capped(t.orders.select("o_orderkey"), 100)
    return t.values("n_rows bigint, truncated boolean", [(len(rows), more)])


def _masked(rule: str, expr: str):
    return lambda t: t.customer.select("c_custkey", mask(rule, F.expr(expr)).alias("masked"))


query("SELECT c_custkey, '***-****-' || right(c_name, 4) AS masked FROM customer", "mask_phone")(_masked("phone", "c_name"))
query("SELECT c_custkey, 'c***@example.org' AS masked FROM customer", "mask_email")(_masked("email", "concat('c', c_custkey, '@example.org')"))
query("SELECT c_custkey, substr(sha256(c_name), 1, 16) AS masked FROM customer", "mask_hash")(_masked("hash", "c_name"))
query("SELECT c_custkey, CAST(NULL AS VARCHAR) AS masked FROM customer", "mask_null")(_masked("null", "c_name"))


@query("SELECT c_custkey, substr(c_name, 1, 1) || '**' AS c_name FROM customer WHERE c_nationkey = 3 ORDER BY c_custkey LIMIT 200")
def mask_name(t):
    return _answer(t, "SELECT c_custkey, c_name FROM customer WHERE c_nationkey = 3 ORDER BY c_custkey LIMIT 200")


@query(_values([("PII_FORBIDDEN", "block", "supplier.s_name")], "code, severity, subject"))
def gov_forbidden(t):
    return verdict(t, "WITH x AS (SELECT upper(s_name) AS n FROM supplier UNION ALL SELECT n_name FROM nation) SELECT n FROM x")


@query(_values([("PII_PREDICATE", "block", "customer.c_name")], "code, severity, subject"))
def gov_masked_predicate(t):
    return verdict(t, "SELECT c_custkey FROM customer WHERE c_name LIKE 'A%'")


@query("SELECT count(c_name) AS cnt FROM customer")
def mask_count_ok(t):
    return _answer(t, "SELECT count(c_name) AS cnt FROM customer")


@query("SELECT c_mktsegment, round(avg(c_acctbal), 4) AS val FROM customer GROUP BY 1 HAVING count(*) >= 5")
def internal_aggregate(t):
    return _answer(t, "SELECT c_mktsegment, round(avg(c_acctbal), 4) AS val FROM customer GROUP BY c_mktsegment HAVING count(*) >= 5")


@query("SELECT count(*) AS cnt FROM customer WHERE c_mktsegment = 'BUILDING'")
def row_policy_branch(t):
    return _answer(t, "SELECT count(*) AS cnt FROM customer", {"segment": "BUILDING"})


@query("SELECT count(*) AS cnt, round(sum(l_quantity), 2) AS qty FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_mktsegment = 'BUILDING')")
def row_policy_propagated(t):
    return _answer(t, "SELECT count(*) AS cnt, round(sum(l_quantity), 2) AS qty FROM lineitem", {"segment": "BUILDING"})


@query("SELECT c_nationkey, c_mktsegment, count(*) AS cnt FROM customer GROUP BY 1, 2 HAVING count(*) >= 12")
def k_anonymity(t):
    """The guard appends the least group size itself."""
    return guard(t, k=12, limit=None, cap=None).check("SELECT c_nationkey, c_mktsegment, count(*) AS cnt FROM customer GROUP BY c_nationkey, c_mktsegment").result


@query("SELECT c_nationkey, c_mktsegment, count(*) AS cnt FROM customer GROUP BY 1, 2 HAVING count(*) >= 12 AND (sum(c_custkey) >= 5 OR true)")
def k_anonymity_with_having(t):
    """A HAVING of the statement doesn't stand in for the least group size."""
    return guard(t, k=12, limit=None, cap=None).check("SELECT c_nationkey, c_mktsegment, count(*) AS cnt FROM customer GROUP BY c_nationkey, c_mktsegment HAVING sum(c_custkey) >= 5 OR true").result


#: Conditions of row policies, the context they meet, and whether the policy applies (n/a: refused).
_WHEN = [("ctx.a", "yes"), ("not ctx.a", "no"), ("ctx.a == 'x'", "yes"), ("a != 'x'", "no"), ("b or a", "yes"), ("b and a", "no"), ("b and b or a", "yes"), ("a == x", "n/a"), ("a; drop", "n/a")]


@query(_values(_WHEN, "cond, applies"))
def policy_conditions(t):
    def one(when):
        try:
            return "yes" if holds(when, {"a": "x", "b": ""}) else "no"
        except ValueError:
            return "n/a"

    return t.values("cond string, applies string", [(w, one(w)) for w, _ in _WHEN])


#: Requests and what they ask for; those that must not be refused among them.
_REQUESTS = [
    ("고객 테이블 전부 삭제해줘", "write"), ("delete all customers", "write"), ("계약 상태를 해지로 변경해줘", "write"), ("새 고객 데이터 등록해줘", "write"), ("권한을 부여해줘", "admin"), ("pragma table_info", "admin"),
    ("고객 주민번호 뽑아줘", "pii"), ("지난달 해지된 계약 건수 알려줘", "read"), ("최근 갱신된 계약 목록 보여줘", "read"), ("정렬 순서를 바꿔서 보여줘", "read"), ("추가로 지역별 매출도 보여줘", "read"), ("삭제된 티켓 현황", "read"), ("show orders by status", "read"),
]


@query(_values(_REQUESTS, "request, kind"))
def request_intent(t):
    """Batches of requests are classified side by side."""
    rows = t.values("request string", [(r,) for r, _ in _REQUESTS])
    kind = F.pandas_udf(lambda s: s.map(lambda r: classify(r, {"고객", "계약", "계약 상태", "orders"}, {"주민등록번호", "주민번호"}).kind), "string")
    ship_package(t.spark)
    return rows.select("request", kind("request").alias("kind"))


_KNOWN = Dictionary(frozenset({"order_dt"}), {"o_orderstatus": {"F": "Finished", "O": "Open", "P": "Pending"}})
_CHECKED = [
    ("SELECT 1 FROM orders WHERE order_dt = '2025-07-01'", "DATE_FORMAT_MISMATCH", "error"),
    ("SELECT 1 FROM orders WHERE order_dt BETWEEN '2025-07-01' AND '2025-07-31'", "DATE_FORMAT_MISMATCH", "error"),
    ("SELECT 1 FROM orders WHERE year(order_dt) = 2025", "DATE_FORMAT_MISMATCH", "error"),
    ("SELECT 1 FROM orders WHERE order_dt >= '20250701'", "", ""),
    ("SELECT 1 FROM orders WHERE o_orderstatus = 'Open'", "CODE_LITERAL_MISMATCH", "error"),
    ("SELECT 1 FROM orders WHERE o_orderstatus IN ('O', 'closed')", "CODE_LITERAL_MISMATCH", "warn"),
    ("SELECT 1 FROM orders WHERE o_orderstatus = 'O'", "", ""),
]


@query(_values(_CHECKED, "statement, code, severity"))
def silent_mismatch_check(t):
    rows = []
    for s, _, _ in _CHECKED:
        found = check_text(s, _KNOWN)
        rows.append((s, found[0][0] if found else "", found[0][1] if found else ""))
    return t.values("statement string, code string, severity string", rows)


def _repaired(t, sql: str, **changes) -> DataFrame:
    """All rows of a statement after repair; orders has its date as eight digits too."""
    g = guard(t, grades=GRADES | {"orders.order_dt": "public"}, limit=None, cap=None, k=0, **changes)
    g.spark.table("orders").withColumn("order_dt", F.date_format("o_orderdate", "yyyyMMdd")).createOrReplaceTempView("orders")
    cat = Catalog({n: [*COLUMNS[n], *(["order_dt"] if n == "orders" else [])] for n in COLUMNS}, JoinGraph(), _KNOWN)
    done = repair(g, sql, cat)
    if not done.verdict.allowed:
        raise ValueError((done.sql, done.applied, done.verdict.violations))
    return done.verdict.result


def _repair_query(name: str, broken: str, sql: str) -> None:
    query(sql, name)(lambda t: _repaired(t, broken))


_DT = "strftime(o_orderdate, '%Y%m%d')"
_repair_query("repair_unknown_table", "SELECT n_name FROM nations", "SELECT n_name FROM nation")
_repair_query("repair_unknown_column", "SELECT o_orderkey, o_orderstats FROM orders", "SELECT o_orderkey, o_orderstatus FROM orders")
_repair_query("repair_ambiguous_column", "SELECT n_name, b.n_nationkey FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey", "SELECT a.n_name, b.n_nationkey FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey")
_repair_query("repair_date_format", "SELECT count(*) AS cnt FROM orders WHERE order_dt BETWEEN '1996-01-01' AND '1996-12-31'", f"SELECT count(*) AS cnt FROM orders WHERE {_DT} BETWEEN '19960101' AND '19961231'")
_repair_query("repair_date_function", "SELECT count(*) AS cnt FROM orders WHERE year(order_dt) = 1997", f"SELECT count(*) AS cnt FROM orders WHERE substr({_DT}, 1, 4) = '1997'")
_repair_query("repair_code_literal", "SELECT count(*) AS cnt FROM orders WHERE o_orderstatus IN ('Open', 'P')", "SELECT count(*) AS cnt FROM orders WHERE o_orderstatus IN ('O', 'P')")
_repair_query("repair_missing_join", "SELECT r_name, count(*) AS cnt FROM region, customer GROUP BY r_name", "SELECT r_name, count(*) AS cnt FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey GROUP BY 1")
_repair_query("repair_agg_groupby", "SELECT o_orderstatus, o_orderpriority, count(*) AS cnt FROM orders GROUP BY o_orderstatus", "SELECT o_orderstatus, o_orderpriority, count(*) AS cnt FROM orders GROUP BY 1, 2")
_repair_query("repair_limit", "SELECT count(*) AS cnt FROM orderz LIMIT 5", "SELECT count(*) AS cnt FROM orders")
_repair_query("repair_several", "SELECT r_nam, count(*) AS cnt FROM region, nations GROUP BY r_nam", "SELECT r_name, count(*) AS cnt FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY 1")


@query(_values([("public", len(GRADES) - 4), ("internal", 2), ("masked", 1), ("forbidden", 1)], "grade, n").replace("SELECT *", "SELECT grade, CAST(n AS BIGINT) AS n"))
def policy_grade_counts(t):
    return t.values("col string, grade string", list(GRADES.items())).groupBy("grade").agg(F.count(F.lit(1)).alias("n"))


@query(_values([("o_totalprise", "o_totalprice"), ("cmktsegment", "c_mktsegment"), ("n_nam", "n_name")], "wanted, found"))
def nearest_identifier(t):
    known = [c for cols in COLUMNS.values() for c in cols]
    wanted = ["o_totalprise", "cmktsegment", "n_nam", "something_else_entirely"]
    return t.values("wanted string, found string", [(w, f) for w in wanted if (f := nearest(w, known))])
