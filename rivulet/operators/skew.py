"""Skew: shares, apportionment and reports.

These work on one row per tenant, a dimension; a global order over it is a single small task.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

def _all():
    return Window.partitionBy()



def zipf_shares(tenants: DataFrame, exponent: float) -> DataFrame:
    """``tenants`` (tenant, rank from 1) with ``share`` proportional to 1/rank**exponent."""
    p = F.pow(F.col("rank").cast("double"), F.lit(-exponent))
    return tenants.withColumn("share", p / F.sum(p).over(_all()))


def apportion(rows: DataFrame, weight: str, total: int, order: str) -> DataFrame:
    """``rows`` with ``units``: largest remainders of ``total`` over the weights, ties to the earlier row."""
    exact = F.col(weight) / F.sum(weight).over(_all()) * total
    x = rows.withColumn("_exact", exact).withColumn("units", F.floor("_exact").cast("long"))
    left = F.lit(total) - F.sum("units").over(_all())
    nth = F.row_number().over(Window.orderBy(F.desc(F.round(F.col("_exact") - F.col("units"), 9)), order))
    return x.withColumns({"_left": left, "_n": nth}).withColumn("units", F.col("units") + (F.col("_n") <= F.col("_left")).cast("long")).drop("_exact", "_left", "_n")


def users_needed(sessions: str = "units", least: int = 50, per_user: int = 625):
    return F.greatest(F.lit(least), F.ceil(F.col(sessions) / per_user)).cast("long")


def report(counts: DataFrame, n: str = "n") -> DataFrame:
    """One row: units, tenants, shares of the top 1 % and 5 %, busiest, median (upper) and thinnest tenant."""
    # tenants with the same count are one row, so ranks come from running sums over distinct counts
    x = counts.groupBy(F.col(n).alias("n")).agg(F.count("*").alias("m"))
    before = lambda o: F.coalesce(F.sum("m").over(Window.orderBy(o).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    x = x.withColumns({"above": before(F.desc("n")), "below": before("n"), "k": F.sum("m").over(_all()), "t": F.sum(F.col("n") * F.col("m")).over(_all())})
    taken = lambda p: F.greatest(F.lit(0), F.least("m", F.greatest(F.lit(1), F.floor(F.col("k") * p)) - F.col("above")))
    top = lambda p: F.bround(F.sum(F.col("n") * taken(p)) / F.max("t"), 4)
    middle = F.floor(F.col("k") / 2) + 1
    return x.agg(F.max("t").alias("units"), F.max("k").alias("tenants"), top(0.01).alias("top1_share"), top(0.05).alias("top5_share"), F.max("n").alias("busiest"), F.max(F.when((F.col("below") < middle) & (middle <= F.col("below") + F.col("m")), F.col("n"))).alias("median"), F.min("n").alias("thinnest"))


def fingerprint(rows: DataFrame, group: str, *parts: str) -> DataFrame:
    """A digest per group that does not depend on row order: of its sorted counts by ``parts``.

    Rows are counted before they are gathered, so a group holds one entry per combination.
    """
    c = rows.groupBy(group, *parts).agg(F.count("*").alias("n"))
    text = F.array_join(F.array_sort(F.collect_list(F.concat_ws("|", *[F.col(p).cast("string") for p in parts], F.col("n").cast("string")))), ";")
    return c.groupBy(group).agg(F.sha2(text.cast("binary"), 256).alias("digest"))


def injected_total(n: int, rate: float) -> int:
    return math.floor(n * rate + 0.5)
