"""Questions in words: what is understood of them, batch by batch, and their answers over the tables."""

from __future__ import annotations

import json
from datetime import date

import pandas as pd
from pyspark.sql import functions as F

from ..language import compiler, question
from ..plans.runtime import ship_package
from ..registry import query
from .governance import _values

TODAY = date(2026, 8, 24)


def understood(df, text: str = "question", today: date = TODAY):
    """df with `got`, a JSON object of all that is understood of each question; batches go through Python by Arrow."""
    ship_package(df.sparkSession)

    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda x: json.dumps(question.understand(x, today).__dict__, ensure_ascii=False))

    return df.withColumn("got", F.pandas_udf(run, "string")(text))


def _register(name: str, cases: list[tuple], names: str, pick) -> None:
    """A query over the questions of the cases; pick turns the JSON column into theirs."""
    fields = names.split(", ")

    def run(t):
        rows = t.values("question string", [(c[0],) for c in cases])
        return understood(rows).select("question", *[c.alias(f) for f, c in zip(fields[1:], pick(F.col("got")), strict=True)])

    query(_values(cases, names), name)(run)


def _get(path: str):
    return lambda c: [F.get_json_object(c, path)]


#: Phrases and their periods, on the day 2026-08-24.
PERIODS = [
    ("작년 하반기 계약", "20250701", "20251231"), ("올해 상반기 신계약", "20260101", "20260630"), ("2025년 2분기", "20250401", "20250630"), ("2024년 7월", "20240701", "20240731"), ("2023년", "20230101", "20231231"), ("지난달", "20260701", "20260731"),
    ("이번달", "20260801", "20260831"), ("최근 3개월", "20260525", "20260824"), ("최근 7일", "20260818", "20260824"), ("올해 들어", "20260101", "20260824"), ("재작년", "20240101", "20241231"), ("2025-03", "20250301", "20250331"),
    ("2025년 7월 1일부터 12월 31일까지 체결된 계약", "20250701", "20251231"), ("2025년 7월부터 12월까지 신계약", "20250701", "20251231"), ("2024년 3월 1일부터 2025년 2월 28일까지", "20240301", "20250228"), ("2025-03-01부터 2025-03-31까지", "20250301", "20250331"),
    ("2025.01.01 ~ 2025.06.30 계약", "20250101", "20250630"), ("20250101부터 20250630까지", "20250101", "20250630"), ("어제 접수", "20260823", "20260823"), ("지난 분기 실적", "20260401", "20260630"), ("이번 주", "20260824", "20260830"), ("지난주", "20260817", "20260823"),
]
_register("nlu_periods", PERIODS, "question, first_day, last_day", lambda c: [F.get_json_object(c, "$.periods[0][2]"), F.get_json_object(c, "$.periods[0][3]")])
_register("nlu_amounts", [("20만원 이상", "200000"), ("1억5천만원", "150000000"), ("3.5억", "350000000"), ("천만원", "10000000"), ("100만", "1000000"), ("2,000원", "2000"), ("500000원", "500000"), ("20만명", None), ("2025년", None)], "question, amount", _get("$.amounts[0][1]"))
_register("nlu_comparisons", [("20만원 이상", ">=", "200000"), ("100만원 미만", "<", "1000000"), ("10만원에서 20만원 사이", "between", "100000"), ("3건 초과", ">", "3"), ("평균", None, None)], "question, op, low", lambda c: [F.get_json_object(c, "$.comparisons[0][0]"), F.get_json_object(c, "$.comparisons[0][1]")])
_register("nlu_groupings", [("지점별 월별 계약 건수", '["지점","월"]'), ("특별 할인", "[]"), ("채널별 비중", '["채널"]')], "question, groups", _get("$.groups"))
_register("nlu_top_k", [("상위 5개 지점", "5"), ("top 3 상품", "3"), ("지점 목록", None)], "question, k", _get("$.top"))
_register("nlu_intent", [("계약이 몇 건이야", "count"), ("보험료 합계는", "sum"), ("상위 5개 지점", "rank"), ("월별 추이", "trend"), ("채널별 비중", "ratio"), ("평균 보험료", "avg"), ("가장 큰 금액은 얼마", "max"), ("지점 목록 보여줘", "select")], "question, intent", _get("$.intent"))
_register("nlu_normalise", [("２０２５년　 ２분기", "2025년 2분기"), ("ＴＯＰ  3", "TOP 3")], "question, folded", _get("$.text"))
_register("nlu_words", [("계약자의 보험료가", '["계약자의","계약자","보험료가","보험료"]'), ("하나 미만", '["하나","미만"]')], "question, words", _get("$.words"))
_register("nlu_cues", [("상위 5개 상품", '["ranking"]'), ("채널별 비중", '["ratio"]'), ("최근 7일", '["temporal"]')], "question, cues", _get("$.cues"))


@query("SELECT CAST(i AS INTEGER) AS n, strftime(DATE '2026-03-31' - to_months(CAST(i AS INTEGER)) + INTERVAL 1 DAY, '%Y%m%d') AS first_day, '20260331' AS last_day FROM range(1, 61) r(i)")
def nlu_recent_months(t):
    """A window of n months is closed and ends today; its start is clamped to its month."""
    rows = t.spark.range(1, 61).select(F.col("id").cast("int").alias("n"), F.concat(F.lit("최근 "), F.col("id"), F.lit("개월")).alias("question"))
    got = understood(rows, today=date(2026, 3, 31))
    return got.select("n", F.get_json_object("got", "$.periods[0][2]").alias("first_day"), F.get_json_object("got", "$.periods[0][3]").alias("last_day"))


_ASKED = {
    "ask_count": ("1996년 2분기 주문 건수는", "SELECT count(*) AS value FROM orders WHERE o_orderdate >= '1996-04-01' AND o_orderdate < '1996-07-01'"),
    "ask_sum_by_dimension": ("1997년 지역별 주문금액 합계", "SELECT r_name, round(sum(o_totalprice), 4) AS value FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE year(o_orderdate) = 1997 GROUP BY 1"),
    "ask_trend": ("1996년 월별 주문 추이", "SELECT strftime(o_orderdate, '%Y-%m') AS bucket_0, count(*) AS value FROM orders WHERE year(o_orderdate) = 1996 GROUP BY 1"),
    "ask_quarters": ("상태별 분기별 매출 합계", "SELECT o_orderstatus, year(o_orderdate) || 'Q' || quarter(o_orderdate) AS bucket_0, round(sum(o_totalprice), 4) AS value FROM orders GROUP BY 1, 2"),
    "ask_top": ("매출 상위 3개 국가별", "SELECT n_name, round(sum(o_totalprice), 4) AS value FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3"),
    "ask_ratio": ("우선순위별 주문 비중", "SELECT o_orderpriority, round(count(*) / (SELECT count(*) FROM orders), 4) AS value FROM orders GROUP BY 1"),
    "ask_average": ("세그먼트별 평균 잔액", "SELECT c_mktsegment, round(avg(c_acctbal), 4) AS value FROM customer GROUP BY 1"),
    "ask_comparison": ("주문금액 20만 이상 건수", "SELECT count(*) AS value FROM orders WHERE o_totalprice >= 200000"),
    "ask_largest": ("주문금액이 가장 큰 금액은 얼마", "SELECT round(max(o_totalprice), 4) AS value FROM orders"),
    "ask_two_periods": ("1995년과 1997년 상태별 주문 건수", "SELECT o_orderstatus, count(*) AS value FROM orders WHERE year(o_orderdate) IN (1995, 1997) GROUP BY 1"),
}
for _name, (_text, _sql) in _ASKED.items():
    query(_sql, _name)(lambda t, x=_text: compiler.ask(x, TODAY, lambda n: getattr(t, n)))


@query(_values([(123_450_000, "1억 2,345만"), (20_000, "2만"), (999, "999"), (-50_000, "-5만"), (1_000_000_000_000, "1조")], "n, shown").replace("SELECT *", "SELECT CAST(n AS BIGINT) AS n, shown"))
def display_units(t):
    ship_package(t.spark)
    rows = t.values("n bigint", [(123_450_000,), (20_000,), (999,), (-50_000,), (1_000_000_000_000,)])
    return rows.withColumn("shown", F.pandas_udf(lambda s: s.map(question.korean_units), "string")("n"))
