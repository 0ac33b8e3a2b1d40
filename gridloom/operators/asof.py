"""As-of joins: for each pixel and date the latest, or the nearest, valid observation within a tolerance.

Both tables are put into one and sorted by pixel and time; a forward fill carries the last valid observation to the rows that ask.
There is no range join. Time is cut into spans, and what a span begins with, the last observation of any earlier one, comes from
one small row per pixel and span. So a pixel with very many observations is as many groups as it has spans.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import ValidationError

#: Seconds of a span.
SPAN = 30 * 86400


def as_of(asked: DataFrame, observed: DataFrame, values: Sequence[str], *, keys: Sequence[str] = ("row", "col"), ts: str = "ts", tolerance: float | None = None, direction: str = "backward", span: int = SPAN) -> DataFrame:
    """Rows of ``asked`` with ``values`` of an observation of the same keys, and ``seen_at``, its time; NULL where there is none.

    ``direction``: "backward" is the latest observation not after the asked time, "nearest" the nearer of that and the first one
    after it, the earlier of equally near ones. An observation without any valid value doesn't count. Of several observations
    at one time the greatest values count. ``tolerance``: seconds that may lie between. Rows without keys or time get NULL.
    """
    if direction not in ("backward", "nearest"):
        raise ValidationError("direction is 'backward' or 'nearest'")
    if not values or set(values) & {*keys, ts} or set(asked.columns) & {*values, "seen_at"}:
        raise ValidationError("values are columns of the observations alone")
    at, held = F.col(ts).cast("timestamp"), [f"__k{i}" for i in range(len(keys))]
    key = lambda: [F.col(k).alias(h) for k, h in zip(keys, held, strict=True)]
    seconds = lambda c: c.cast("double")
    valid: Column = F.lit(False)
    for v in values:
        valid = valid | F.col(v).isNotNull()
    for c in (ts, *keys):
        valid = valid & F.col(c).isNotNull()
    seen = observed.where(valid).select(*key(), at.alias("__t"), F.struct(at.alias("t"), *values).alias("__o"))
    seen = seen.groupBy(*held, "__t").agg(F.max("__o").alias("__o"))
    number = lambda: F.floor(seconds(F.col("__t")) / span).alias("__s")
    seen = seen.select(*held, "__t", "__o", number())
    rows = asked.select(*key(), at.alias("__t"), F.struct(*asked.columns).alias("__a")).select(*held, "__t", "__a", number())
    # one row per pixel and span: its last and its first observation; rows that ask need what lies before and behind
    spans = seen.groupBy(*held, "__s").agg(F.max_by("__o", "__t").alias("last"), F.min_by("__o", "__t").alias("first")).unionByName(rows.where(F.col("__s").isNotNull()).select(*held, "__s").distinct().withColumns({"last": F.lit(None).cast(seen.schema["__o"].dataType), "first": F.lit(None).cast(seen.schema["__o"].dataType)}))
    spans = spans.groupBy(*held, "__s").agg(F.first("last", True).alias("last"), F.first("first", True).alias("first"))
    line = Window.partitionBy(*held).orderBy("__s")
    edges = spans.select(*held, "__s", F.last("last", True).over(line.rowsBetween(Window.unboundedPreceding, -1)).alias("before"), F.first("first", True).over(line.rowsBetween(1, Window.unboundedFollowing)).alias("after"))
    none = {"__a": F.lit(None).cast(rows.schema["__a"].dataType), "__o": F.lit(None).cast(seen.schema["__o"].dataType)}
    table = rows.withColumns({"__o": none["__o"], "__p": F.lit(1)}).unionByName(seen.withColumns({"__a": none["__a"], "__p": F.lit(0)}))
    for name, place in (("before", F.col("__s") * span), ("after", (F.col("__s") + 1) * span)):
        carried = edges.where(F.col(name).isNotNull()).select(*held, place.cast("timestamp").alias("__t"), F.col(name).alias("__o"), "__s").withColumns({"__a": none["__a"], "__p": F.lit(-1 if name == "before" else 2)})
        table = table.unionByName(carried.select(*table.columns))
    inner = Window.partitionBy(*held, "__s").orderBy("__t", "__p")
    table = table.withColumn("__back", F.last("__o", True).over(inner.rowsBetween(Window.unboundedPreceding, 0)))
    found = F.col("__back")
    if direction == "nearest":
        table = table.withColumn("__next", F.first("__o", True).over(inner.rowsBetween(0, Window.unboundedFollowing)))
        apart = lambda c: F.abs(seconds(F.col(f"{c}.t")) - seconds(F.col("__t")))
        found = F.when(F.col("__back").isNull() | (apart("__next") < apart("__back")), F.col("__next")).otherwise(F.col("__back"))
    table = table.where(F.col("__a").isNotNull()).withColumn("__f", found)
    if tolerance is not None:
        table = table.withColumn("__f", F.when(F.abs(seconds(F.col("__f.t")) - seconds(F.col("__t"))) <= tolerance, F.col("__f")))
    return table.select("__a.*", *[F.col(f"__f.{v}").alias(v) for v in values], F.col("__f.t").alias("seen_at"))
