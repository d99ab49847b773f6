"""Counters, histograms, quantiles and rates as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schemas as S
from ..staging import staged


def counters(rows: DataFrame, *labels: str) -> DataFrame:
    """Counts by labels; a null label shows as unset."""
    return rows.groupBy(*(F.coalesce(F.col(c), F.lit(S.UNSET)).alias(c) for c in labels)).agg(F.count("*").alias("n"))


def capped_labels(rows: DataFrame, label: str, arrival: str, cap: int = S.LABEL_CAP) -> DataFrame:
    """Counts by label where only the ``cap`` values that arrived first keep their name.

    Values are reduced to one row each; the first ``cap`` of them are broadcast.
    """
    per = rows.groupBy(label).agg(F.count("*").alias("n"), F.min(arrival).alias("first"))
    named = per.orderBy("first", label).limit(cap).select(F.col(label).alias("_label"), F.lit(True).alias("_named"))
    x = per.join(F.broadcast(named), F.col(label).eqNullSafe(F.col("_label")), "left")
    return x.groupBy(F.when(F.col("_named"), F.col(label)).otherwise(S.OTHER).alias(label)).agg(F.sum("n").alias("n"), F.sum(F.when(F.col("_named"), 0).otherwise(F.col("n"))).alias("folded"))


def scrape_totals(samples: DataFrame, *by: str) -> DataFrame:
    """(by..., name, value) over the samples of all workers: sums, but the maximum of what is a share of one worker.

    Shares have names that end in ``_utilisation``: four of them add up to no share.
    """
    return samples.groupBy(*by, "name").agg(F.when(F.col("name").endswith("_utilisation"), F.max("sample")).otherwise(F.sum("sample")).alias("value"))


def histogram(rows: DataFrame, value: Column, edges: list[float]) -> DataFrame:
    """(le, n, cumulative) per bucket, empty ones included; a value falls in the first bucket with value <= le."""
    bounds = F.array(*[F.lit(float(e)) for e in [*edges, float("inf")]])
    got = rows.select(F.array_min(F.filter(bounds, lambda e: value.cast("double") <= e)).alias("le")).groupBy("le").agg(F.count("*").alias("n"))
    all_ = rows.sparkSession.range(1).select(F.explode(bounds).alias("le"))
    x = all_.join(got, "le", "left").select("le", F.coalesce("n", F.lit(0)).alias("n"))
    return x.withColumn("cumulative", F.sum("n").over(Window.orderBy("le").rowsBetween(Window.unboundedPreceding, 0)))


def bucket_quantile(hist: DataFrame, q: float, by: list[str] = ()) -> DataFrame:
    """(q, value): linear interpolation inside the bucket of the rank; null if empty or beyond the last edge.

    Empty buckets do not move the lower end.
    """
    k = list(by)
    filled = Window.partitionBy(*k).orderBy("le").rowsBetween(Window.unboundedPreceding, -1)
    floor_le = F.last(F.when(F.col("n") > 0, F.col("le")), True).over(filled)
    floor_c = F.last(F.when(F.col("n") > 0, F.col("cumulative")), True).over(filled)
    total = F.max("cumulative").over(Window.partitionBy(*k))
    x = hist.withColumns({"lo": F.coalesce(floor_le, F.lit(0.0)), "lc": F.coalesce(floor_c, F.lit(0)), "rank": F.lit(q) * total, "total": total})
    hit = x.where("cumulative >= rank and total > 0").groupBy(*k).agg(F.min_by(F.struct("le", "lo", "lc", "cumulative", "rank"), "le").alias("b"))
    value = F.when(F.col("b.le") == float("inf"), None).when(F.col("b.cumulative") <= F.col("b.lc"), F.col("b.le")).otherwise(F.col("b.lo") + (F.col("b.le") - F.col("b.lo")) * (F.col("b.rank") - F.col("b.lc")) / (F.col("b.cumulative") - F.col("b.lc")))
    return hit.select(*k, F.lit(q).alias("q"), value.alias("value"))


def rates(scrapes: DataFrame, counters_: list[str], by: list[str] = ()) -> DataFrame:
    """Rates per second since the scrape before, with a caveat where none can be told; of accepted and rejected also the error rate.

    ``scrapes`` has ``at`` (seconds), ``workers`` and the counters.  The first one is a baseline.
    """
    w = Window.partitionBy(*by).orderBy("at")
    prev = {c: F.lag(c).over(w) for c in ["at", "workers", *counters_]}
    fell = F.lit(False)
    for c in counters_:
        fell = fell | (F.col(c) < prev[c])
    caveat = F.when(prev["at"].isNull(), "baseline").when(prev["at"] == F.col("at"), "same time").when(prev["workers"] != F.col("workers"), "workers changed").when(fell, "counter fell")
    out = scrapes.withColumn("caveat", caveat)
    if {"accepted", "rejected"} <= set(counters_):
        more = {c: F.col(c) - prev[c] for c in ("accepted", "rejected")}
        total = more["accepted"] + more["rejected"]
        out = out.withColumn("error_rate", F.when(F.col("caveat").isNull() & (total > 0), more["rejected"] / total))
    return out.withColumns({f"{c}_per_sec": F.when(F.col("caveat").isNull(), (F.col(c) - prev[c]) / (F.col("at") - prev["at"])) for c in counters_})


def exact_quantiles(rows: DataFrame, by: str, value: str, quantiles: list[float], most: int = 100_000, accuracy: int = 10_000) -> DataFrame:
    """(by, q, value): for each group the least value that at least a share q of its values do not exceed; nulls take no part.

    Selection by narrowing ranges: approximate quantiles a little below and above q enclose the value, and the number of values under
    the range is counted.  Ranges are narrowed until none holds more than ``most`` values or they hold one value only; then a group's last
    range, counted by value, is all that meets in one task.  ``rows`` are read a few times, so stage them.
    """
    spark = rows.sparkSession
    v = rows.where(F.col(value).isNotNull()).select(F.col(by).alias("g"), F.col(value).alias("v"))
    total = staged(v.groupBy("g").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")), "groups")
    qs = F.explode(F.array(*map(F.lit, quantiles))).alias("q")
    # rank among the values from lo on, and how many there are up to hi
    open_ = staged(total.select("g", qs, "lo", "hi", "n").withColumn("rank", F.greatest(F.ceil(F.col("q") * F.col("n")), F.lit(1))), "ranges")
    for _ in range(12):
        wide = open_.where((F.col("n") > most) & (F.col("lo") < F.col("hi")))
        if wide.isEmpty():
            break
        inside = v.join(_small(wide), v.g.eqNullSafe(wide.g), "inner").where("v between lo and hi").select(wide.g, "q", "lo", "hi", "rank", "n", "v")
        share = F.col("rank") / F.col("n")
        cut = F.percentile_approx("v", [i / 64 for i in range(65)], accuracy)
        near = inside.groupBy("g", "q", "lo", "hi", "rank", "n").agg(cut.alias("c"))
        at = F.floor(share * 64).cast("int")
        # one cut more on either side than the rank asks for; the counts decide
        near = staged(near.select("g", "q", "lo", "hi", "rank", "n", F.element_at("c", F.greatest(at, F.lit(1))).alias("lo2"), F.element_at("c", F.least(at + 3, F.lit(65))).alias("hi2")), "cuts")
        counted = v.join(_small(near), v.g.eqNullSafe(near.g), "inner").where("v between lo and hi").groupBy(near.g, "q", "lo", "hi", "lo2", "hi2", "rank", "n").agg(F.count_if(F.expr("v < lo2")).alias("below"), F.count_if(F.expr("v = lo2")).alias("first"), F.count_if(F.expr("v between lo2 and hi2")).alias("held"))
        good = (F.col("below") < F.col("rank")) & (F.col("rank") <= F.col("below") + F.col("held"))
        low, high = F.col("rank") <= F.col("below"), F.col("rank") > F.col("below") + F.col("held")
        # cuts that miss the rank still halve the range: it lies before the first or after the second
        new = counted.select(
            "g", "q", F.when(high, F.col("lo2")).when(low, F.col("lo")).otherwise(F.col("lo2")).alias("lo"), F.when(low, F.col("lo2")).when(high, F.col("hi")).otherwise(F.col("hi2")).alias("hi"),
            F.when(good, F.col("held")).when(low, F.col("below") + F.col("first")).otherwise(F.col("n") - F.col("below")).alias("n"), F.when(low, F.col("rank")).otherwise(F.col("rank") - F.col("below")).alias("rank"),
        )
        open_ = staged(new.unionByName(open_.where((F.col("n") <= most) | (F.col("lo") >= F.col("hi"))).select("g", "q", "lo", "hi", "n", "rank")), "ranges")
    last = v.join(_small(open_), v.g.eqNullSafe(open_.g), "inner").where("v between lo and hi").groupBy(open_.g, "q", "rank", "v").agg(F.count("*").alias("k"))
    upto = F.sum("k").over(Window.partitionBy("g", "q").orderBy("v"))
    return last.withColumn("upto", upto).where("upto >= rank").groupBy("g", "q").agg(F.min("v").alias("value")).select(F.col("g").alias(by), "q", "value")


def _small(ranges: DataFrame, limit: int = 100_000) -> DataFrame:
    """``ranges``, broadcast if a count shows that they are few."""
    return F.broadcast(ranges) if ranges.limit(limit + 1).count() <= limit else ranges
