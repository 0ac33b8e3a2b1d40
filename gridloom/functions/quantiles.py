"""Exact percentiles of large tables: brackets by a sketch, narrowed until few values lie in them, then their exact ranks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Accuracy of the sketch: a rank is off by at most 1 / ACCURACY of the rows.
ACCURACY = 10_000
#: Rows that a bracket may hold for certain, and the steps that a narrowing divides it into.
BRACKET_ROWS, STEPS = 200_000, 1000


def rounds(rows: int | None) -> int:
    """How often brackets of a table of so many rows are narrowed: none of up to 500 million, one of up to 100 billion."""
    held, n = (rows or 0) * 4 / ACCURACY, 0
    while held > BRACKET_ROWS:
        held, n = held * 6 / STEPS, n + 1
    return n


def _inside(held: DataFrame, k: int, few) -> DataFrame:
    """g, n, i, v of the values within each bracket i, its ends included."""
    which = F.filter(F.transform(F.arrays_zip(F.col("low").alias("low"), F.col("high").alias("high")), lambda x, i: F.when(few | (F.col("v") >= x["low"]) & (F.col("v") <= x["high"]), i)), lambda i: i.isNotNull())
    return held.select("g", "n", "v", F.explode(which).alias("i"))


def _below(held: DataFrame, k: int, few) -> DataFrame:
    """g, below: how many values lie under each bracket."""
    return held.groupBy("g").agg(F.array(*[F.count(F.when(~few & (F.col("v") < F.col("low")[i]), 1)) for i in range(k)]).alias("below"))


def brackets(t: DataFrame, at: list[float], rows: int | None = None) -> DataFrame:
    """g, n, low, high: per group and share two values between which the share's ranks lie for certain."""
    k, room = len(at), 2 / ACCURACY
    shares = [max(0.0, q - room) for q in at] + [min(1.0, q + room) for q in at]
    rough = t.groupBy("g").agg(F.percentile_approx("v", shares, ACCURACY).alias("b"), F.count("v").alias("n"))
    rough = rough.select("g", "n", F.slice("b", 1, k).alias("low"), F.slice("b", k + 1, k).alias("high"))
    few = F.col("n") <= 4 * ACCURACY
    for _ in range(rounds(rows)):
        held = t.where(F.col("v").isNotNull()).join(F.broadcast(rough), "g")
        grid = [j / STEPS for j in range(STEPS + 1)]
        steps = _inside(held, k, few).groupBy("g", "n", "i").agg(F.percentile_approx("v", grid, ACCURACY).alias("s"), F.count(F.lit(1)).alias("c")).join(F.broadcast(_below(held, k, few)), "g")
        place = (F.array(*[F.lit(float(q)) for q in at])[F.col("i")] * (F.col("n") - 1) - F.col("below")[F.col("i")]) / F.col("c") * STEPS
        step = lambda x: F.greatest(F.lit(1), F.least(F.lit(STEPS + 1), x.cast("int")))
        ends = steps.select("g", "n", F.struct("i", F.element_at("s", step(F.floor(place) - 1)).alias("low"), F.element_at("s", step(F.ceil(place) + 3)).alias("high")).alias("e"))
        sorted_ = ends.groupBy("g", "n").agg(F.array_sort(F.collect_list("e")).alias("e"))
        rough = t.select("g").distinct().join(sorted_, "g", "left").select("g", F.coalesce("n", F.lit(0)).alias("n"), F.col("e.low").alias("low"), F.col("e.high").alias("high"))
    return rough


def percentiles(t: DataFrame, at: list[float], rows: int | None = None) -> DataFrame:
    """g, p: linearly interpolated percentiles (shares ``at``) of t (g, v) per group, NULL for a group without values.

    ``t`` holds few groups (a raster's bands) of many rows. One pass finds, per share, two values between which its ranks lie
    for certain, some ten-thousandths of the rows apart; of a table of more ``rows`` further passes divide that bracket until it
    holds at most ``BRACKET_ROWS``; the last counts the rows below and the distinct values between. So no task holds more than
    that, however many rows a group has and however they are spread.
    """
    k, rough = len(at), brackets(t, at, rows)
    held = t.where(F.col("v").isNotNull()).join(F.broadcast(rough), "g")
    few = F.col("n") <= 4 * ACCURACY  # brackets could miss a rank by its rounding: all values are looked at
    below, inside = _below(held, k, few), _inside(held, k, few).groupBy("g", "n", "i", "v").agg(F.count(F.lit(1)).alias("c"))
    up = Window.partitionBy("g", "i").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = inside.join(F.broadcast(below), "g").withColumn("upto", F.col("below")[F.col("i")] + F.sum("c").over(up))
    place = F.array(*[F.lit(float(q)) for q in at])[F.col("i")] * (F.col("n") - 1)
    x = lambda rank: F.min(F.when(F.col("upto") > rank, F.col("v")))
    found = ranked.withColumn("place", place).groupBy("g", "i").agg(x(F.floor("place")).alias("a"), x(F.ceil("place")).alias("z"), F.first("place").alias("place"))
    up_to = F.ceil("place") - F.col("place")
    value = F.when(F.col("a") == F.col("z"), F.col("a")).otherwise(up_to * F.col("a") + (F.col("place") - F.floor("place")) * F.col("z"))
    rows = found.groupBy("g").agg(F.array_sort(F.collect_list(F.struct("i", value.alias("x")))).alias("q")).select(F.col("g").alias("__g"), F.col("q.x").alias("p"))
    return rough.select("g").join(F.broadcast(rows), F.col("g") == F.col("__g"), "left").select("g", "p")
