"""Normality of grouped values: order statistics, the Shapiro-Wilk test, Q-Q points with their line, box plots."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import normal as N

# Royston 1995 (AS R94), lowest power first.
LAST_WEIGHT = [0.0, 0.221157, -0.147981, -2.07119, 4.434685, -2.706056]
NEXT_WEIGHT = [0.0, 0.042981, -0.293762, -1.752461, 5.682633, -3.582633]
SMALL_LIMIT = [-2.273, 0.459]
SMALL_MEAN = [0.544, -0.39978, 0.025054, -6.714e-4]
SMALL_SPREAD = [1.3822, -0.77857, 0.062767, -0.0020322]
LARGE_MEAN = [-1.5861, -0.31082, -0.083751, 0.0038915]
LARGE_SPREAD = [-0.4803, -0.082676, 0.0030302]
#: Equal values are told apart as so many at once.
RUN = 10_000


def order_statistics(values: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by, x, c, lo, hi, n): each distinct value of a group with its count and the places that it fills, 1 to n; nulls are left out.

    Values are counted in the tasks first, so what a group sorts are its distinct values.
    """
    own = values.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).cast("double").alias("x")).agg(F.count("*").alias("c"))
    w = Window.partitionBy(*by)
    places = own.withColumns({"hi": F.sum("c").over(w.orderBy("x").rowsBetween(Window.unboundedPreceding, 0)), "n": F.sum("c").over(w)})
    return places.withColumn("lo", F.col("hi") - F.col("c") + 1)


def places(order: DataFrame) -> DataFrame:
    """A row a place ``i`` of ``order_statistics``."""
    runs = order.withColumn("__at", F.explode(F.sequence("lo", "hi", F.lit(RUN).cast("long"))))
    return runs.withColumn("i", F.explode(F.sequence(F.col("__at"), F.least(F.col("hi"), F.col("__at") + RUN - 1)))).drop("__at")


def shapiro_wilk(values: DataFrame, by: list[str], value: str = "diff") -> DataFrame:
    """(by, n, w, p): the Shapiro-Wilk statistic and its p in Royston's form.

    Null below three values and where all are as good as equal. Beyond 5,000 values p is an extrapolation.
    """
    n = F.col("n").cast("double")
    score = N.quantile((F.col("i") - 0.375) / (n + 0.25))
    rows = places(order_statistics(values, by, value)).withColumn("m", score)
    at = lambda place: F.max(F.when(F.col("i") == place, F.col("x")))
    g = rows.groupBy(*by).agg(
        F.max("n").alias("n"), F.sum(F.col("m") * F.col("x")).alias("mx"), F.sum(F.col("m") * F.col("m")).alias("mm"), (F.var_pop("x") * F.count("*")).alias("ss"),
        F.max("x").alias("last"), F.min("x").alias("first"), at(F.col("n") - 1).alias("last2"), at(F.lit(2)).alias("first2"),
    )
    score_of = lambda k: N.quantile((n + 1 - k - 0.375) / (n + 0.25))
    weight = lambda c, m: N.once(1.0 / F.sqrt(n), lambda r: N.polynomial(c, r)) + F.try_divide(m, F.sqrt("mm"))
    g = g.withColumns({"m1": score_of(1), "m2": score_of(2)}).withColumns({"a1": weight(LAST_WEIGHT, F.col("m1")), "a2": weight(NEXT_WEIGHT, F.col("m2"))})
    m1, m2, a1, a2, mm = (F.col(c) for c in ("m1", "m2", "a1", "a2", "mm"))
    outer, inner = F.col("last") - F.col("first"), F.col("last2") - F.col("first2")
    few = a1 * outer + F.try_divide(F.col("mx") - m1 * outer, F.sqrt(F.try_divide(mm - 2 * m1 * m1, 1 - 2 * a1 * a1)))
    many = a1 * outer + a2 * inner + F.try_divide(F.col("mx") - m1 * outer - m2 * inner, F.sqrt(F.try_divide(mm - 2 * m1 * m1 - 2 * m2 * m2, 1 - 2 * a1 * a1 - 2 * a2 * a2)))
    line = N.once(F.when(n == 3, math.sqrt(0.5) * outer).when(n <= 5, few).otherwise(many), lambda v: v * v)
    fit = F.when((F.col("n") >= 3) & (outer > 1e-8 + 1e-5 * F.abs("first")), F.least(F.lit(1.0), F.try_divide(line, "ss")))
    return g.withColumn("w", fit).select(*by, "n", "w", N.once(F.col("w"), lambda w: _royston_p(w, n)).alias("p"))


def _royston_p(w: Column, n: Column) -> Column:
    three = F.greatest(F.lit(0.0), 6.0 / math.pi * (F.asin(F.sqrt(w)) - math.asin(math.sqrt(0.75))))
    limit = N.polynomial(SMALL_LIMIT, n)
    small = lambda y: F.when(y >= limit, 0.0).otherwise(N.upper_tail((-F.log(F.when(y < limit, limit - y)) - N.polynomial(SMALL_MEAN, n)) / F.exp(N.polynomial(SMALL_SPREAD, n))))
    large = lambda y: N.once(F.log(n), lambda size: N.upper_tail((y - N.polynomial(LARGE_MEAN, size)) / F.exp(N.polynomial(LARGE_SPREAD, size))))
    distance = F.log(F.greatest(1.0 - w, F.lit(1e-300)))
    return F.when(w.isNull(), None).when(n == 3, three).when(n > 11, N.once(distance, large)).otherwise(N.once(distance, small))


def qq_points(values: DataFrame, by: list[str], value: str) -> DataFrame:
    """(by, i, theoretical, value, slope, intercept): sorted values against normal quantiles of Filliben's medians, and the least-squares line."""
    n = F.col("n").cast("double")
    last = F.pow(F.lit(0.5), 1.0 / n)
    median = F.when(F.col("i") == F.col("n"), last).when(F.col("i") == 1, 1.0 - last).otherwise((F.col("i") - 0.3175) / (n + 0.365))
    rows = places(order_statistics(values, by, value)).withColumn("theoretical", N.quantile(median))
    # One value has no line.
    line = rows.groupBy(*by).agg(F.regr_slope("x", "theoretical").alias("slope"), F.regr_intercept("x", "theoretical").alias("intercept"))
    return rows.join(line, by).select(*by, F.col("i").cast("int").alias("i"), "theoretical", F.col("x").alias("value"), "slope", "intercept")


def boxes(values: DataFrame, by: list[str], value: str, reach: float = 1.5) -> DataFrame:
    """(by, n, q1, median, q3, low, high): interpolated quartiles, and whiskers at the last values within ``reach`` ranges of the box."""
    own = values.where(F.col(value).isNotNull())
    quartiles = F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    g = own.groupBy(*by).agg(F.count("*").alias("n"), quartiles.alias("q")).select(*by, "n", *[F.col("q")[i].alias(c) for i, c in enumerate(["q1", "median", "q3"])])
    x, span = F.col(value), F.col("q3") - F.col("q1")
    inside = own.join(g, by).groupBy(*by).agg(F.min(F.when(x >= F.col("q1") - reach * span, x)).alias("low"), F.max(F.when(x <= F.col("q3") + reach * span, x)).alias("high"))
    return g.join(inside, by).select(*by, "n", "q1", "median", "q3", F.least("low", "q1").alias("low"), F.greatest("high", "q3").alias("high"))
