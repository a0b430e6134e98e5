import pytest

from millrace.operators.governance import guard
from millrace.plans.guard import Policy, split_statements
from millrace.plans.joins import JoinGraph, nearest
from millrace.registry import Tables


@pytest.fixture(scope="module")
def t(spark):
    return Tables(spark, "/root/testdata/sf0.001")


def codes(t, sql, context=None, **changes):
    return {c for c, _, _ in guard(t, context, **changes).check(sql).violations}


@pytest.mark.parametrize(
    "sql",
    [
        "SELECT s_name FROM supplier",
        "SELECT x.s_name AS y FROM supplier x",
        "SELECT * FROM supplier",
        "SELECT n FROM (SELECT s_name AS n FROM supplier)",
        "WITH c AS (SELECT s_name AS n FROM supplier) SELECT n FROM c",
        "SELECT s_suppkey FROM supplier WHERE s_name = 'a'",
        "SELECT n_name FROM nation UNION ALL SELECT s_name FROM supplier",
        "SELECT n_name FROM nation WHERE n_name IN (SELECT s_name FROM supplier)",
        "SELECT concat(s_suppkey, s_name) FROM supplier",
    ],
)
def test_forbidden_columns_are_found_on_every_path(t, sql):
    assert "PII_FORBIDDEN" in codes(t, sql)


@pytest.mark.parametrize("sql", ["DROP TABLE nation", "INSERT INTO nation SELECT * FROM nation", "CREATE TABLE x AS SELECT 1", "SET a=b", "DELETE FROM nation", "TRUNCATE TABLE nation"])
def test_only_queries_pass(t, sql):
    assert codes(t, sql) & {"WRITE_FORBIDDEN", "SQL_PARSE"}


def test_other_codes(t):
    assert "MULTI_STATEMENT" in codes(t, "SELECT 1; SELECT 2")
    assert "FUNCTION_FORBIDDEN" in codes(t, "SELECT reflect('java.lang.System', 'exit') FROM nation")
    assert "UNKNOWN_TABLE" in codes(t, "SELECT 1 FROM nowhere")
    assert "UNKNOWN_COLUMN" in codes(t, "SELECT n_nme FROM nation")
    assert "PII_EXPRESSION" in codes(t, "SELECT upper(c_name) FROM customer")
    assert "PII_PREDICATE" in codes(t, "SELECT c_name, count(*) FROM customer GROUP BY c_name")
    assert "INTERNAL_ROWLEVEL" in codes(t, "SELECT c_acctbal FROM customer")
    assert "K_ANONYMITY" in codes(t, "SELECT DISTINCT c_nationkey FROM customer")
    assert "K_ANONYMITY" in codes(t, "SELECT n FROM (SELECT c_nationkey, count(*) AS n FROM customer GROUP BY c_nationkey)")
    assert not codes(t, "SELECT ';' AS x, n_name FROM nation -- ; no more")


def test_row_policy_holds_for_every_alias(t):
    g = guard(t, {"segment": "BUILDING"})
    v = g.check("SELECT count(*) AS n FROM customer a JOIN customer b ON a.c_custkey = b.c_custkey")
    assert v.allowed and v.result.first().n == t.customer.where("c_mktsegment = 'BUILDING'").count()


def test_context_values_are_quoted(t):
    v = guard(t, {"segment": "x' OR '1'='1"}).check("SELECT count(*) AS n FROM customer")
    assert v.result.first().n == 0


def test_a_condition_that_is_not_understood_is_refused(t):
    from millrace.plans.guard import RowPolicy

    with pytest.raises(ValueError):
        guard(t, rows=[RowPolicy("x", "customer", "1 = 1", "a == b")])


def test_statements_and_names():
    assert split_statements("SELECT ';'; -- a;b\n SELECT 1") == ["SELECT ';'", "-- a;b\n SELECT 1"]
    assert nearest("o_totalprise", ["o_totalprice", "o_custkey"]) == "o_totalprice"
    assert JoinGraph().path("orders", "region") == ["orders", "customer", "nation", "region"]
    with pytest.raises(ValueError):
        JoinGraph().connect(["orders", "documents"])


def test_stream_equals_batch(spark, tmp_path):
    from millrace.streaming.events import hourly_counts, run_hourly

    src = str(tmp_path / "in")
    spark.read.parquet("/root/testdata/sf0.001/events.parquet").write.parquet(src)
    run_hourly(spark, src, str(tmp_path / "out"), str(tmp_path / "cp"))
    got = {tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    all_rows = {tuple(r) for r in hourly_counts(spark.read.parquet(src)).collect()}
    last = max(r[0] for r in all_rows)
    assert got <= all_rows and {r for r in all_rows - got} <= {r for r in all_rows if r[0] >= min(x[0] for x in all_rows - got)} and last


@pytest.mark.parametrize("having", ["", " HAVING sum(c_custkey) >= 5", " HAVING count(*) >= 5 OR true", " HAVING count(DISTINCT c_custkey) >= 5", " HAVING count(*) FILTER (WHERE false) >= 0"])
def test_small_groups_are_cut_off_whatever_the_having(t, having):
    v = guard(t).check(f"SELECT c_nationkey, count(*) AS n FROM customer GROUP BY c_nationkey{having} ORDER BY n")
    assert v.allowed and "having:5" in v.rewrites and all(r.n >= 5 for r in v.result.collect())


def test_policy_document(t, tmp_path):
    from millrace.plans.guard import load_policy

    path = tmp_path / "policy.json"
    path.write_text('{"columns": {"nation.n_name": "public"}, "k_anonymity": {"tables": ["nation"], "k": 3}, "limits": {"limit": 7}, "row_policies": [{"name": "a", "table": "nation", "predicate": "n_regionkey = {r}", "when": "ctx.r"}]}')
    p = load_policy(str(path))
    assert (p.grade("nation", "n_name"), p.grade("nation", "n_regionkey"), p.k, p.limit, p.rows[0].when) == ("public", "forbidden", 3, 7, "ctx.r")
    assert p.narrowed(limit=100).limit == 7 and p.narrowed(limit=2).limit == 2
    path.write_text('{"columns": {"nation.n_name": "pubic"}}')
    with pytest.raises(ValueError):
        load_policy(str(path))


def test_blocks_are_not_repaired(t):
    from millrace.operators import governance
    from millrace.plans.repair import Catalog, repair

    g = guard(t)
    done = repair(g, "SELECT s_name FROM supplier WHERE s_acctbal > 0", Catalog(governance.COLUMNS, JoinGraph()))
    assert not done.verdict.allowed and not done.applied
    assert not repair(g, "SELECT n_nam FROM nation", Catalog(governance.COLUMNS, JoinGraph()), budget=0).applied


def test_repaired_statements_and_groups_have_all_their_rows(spark, tmp_path):
    """No limit of the policy cuts their results, however many rows there are."""
    from millrace.registry import QUERIES

    spark.range(100_003).selectExpr("id AS o_orderkey", "id AS o_custkey", "'O' AS o_orderstatus", "1.0 AS o_totalprice", "timestamp'1996-01-01' AS o_orderdate", "'1-URGENT' AS o_orderpriority").write.parquet(f"{tmp_path}/orders.parquet")
    spark.range(1_200_024).selectExpr("id AS c_custkey", "'x' AS c_name", "id % 100002 AS c_nationkey", "1.0 AS c_acctbal", "'m' AS c_mktsegment").write.parquet(f"{tmp_path}/customer.parquet")
    for name in ("region", "nation", "supplier", "part", "lineitem"):
        spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    assert QUERIES["repair_unknown_column"](spark, str(tmp_path)).count() == 100_003
    assert QUERIES["k_anonymity"](spark, str(tmp_path)).count() == 100_002


def test_limits_without_number():
    p = Policy({}, limit=None, cap=None)
    assert (p.narrowed().limit, p.narrowed(limit=5).limit, p.narrowed(cap=7).cap) == (None, 5, 7)
