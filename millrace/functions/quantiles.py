"""Exact order statistics by distributed histograms: no task sorts or holds all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def kth_largest(df: DataFrame, value: Column, k: int, bits: int = 14) -> tuple[int, int]:
    """The k-th largest of a bigint column without nulls, and how many are larger; k from 1 to the number of rows.

    The range is cut into 2 ** bits buckets that are counted, the one with the k-th is cut again, down to one value; each pass
    brings one row to the driver.
    """
    rows = df.select(value.alias("v"))
    got = rows.agg(F.min("v").alias("a"), F.max("v").alias("b")).first()
    low, high, above = got.a, got.b + 1, 0
    while high - low > 1:
        shift = max(0, (high - low - 1).bit_length() - bits)
        counts = rows.where((F.col("v") >= low) & (F.col("v") < high)).groupBy(F.expr(f"shiftright(v - {low}L, {shift})").alias("b")).agg(F.count(F.lit(1)).alias("n"))
        for r in counts.orderBy(F.desc("b")).collect():  # 2 ** bits rows at most
            if above + r.n >= k:
                low, high = low + (r.b << shift), min(high, low + ((r.b + 1) << shift))
                break
            above += r.n
    return low, above


def top_rows(df: DataFrame, value: Column, k: int, tie: str) -> DataFrame:
    """The k rows of the largest values (bigint), of equal ones those of the least ties; only ties of the last value are ranked."""
    if k <= 0:
        return df.limit(0)
    cut, above = kth_largest(df, value, k)
    last = df.where(value == cut)
    return df.where(value > cut).unionByName(last.orderBy(tie).limit(k - above))
