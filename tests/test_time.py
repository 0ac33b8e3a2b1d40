"""As-of joins, kept composites and exact percentiles."""

import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.functions import quantiles
from gridloom.operators.asof import as_of
from gridloom.streaming import stateful

START = datetime(2024, 1, 1)


@pytest.mark.parametrize("direction", ["backward", "nearest"])
@pytest.mark.parametrize("tolerance", [None, 3 * 3600])
def test_as_of(spark, direction, tolerance):
    r = random.Random(3)
    seen = [(r.choice([1, 2, 2, 2, 2, None]), r.choice([0, 0, 1]), START + timedelta(hours=r.randint(0, 400)), r.choice([None, 1.0, 2.0, 3.0]), r.choice([None, None, 5])) for _ in range(150)] + [(1, 0, None, 9.0, 9)]
    asked = [(i, r.choice([1, 2, 3, None]), r.choice([0, 1]), START + timedelta(hours=r.randint(-20, 420)) if r.random() < 0.95 else None, "x") for i in range(120)]
    a = spark.createDataFrame(asked, "id long, row int, col int, ts timestamp, __t string")
    o = spark.createDataFrame(seen, "row int, col int, ts timestamp, v double, w int")
    got = {x.id: (x.v, x.w, x.seen_at) for x in as_of(a.withColumnRenamed("__t", "kept"), o, ["v", "w"], tolerance=tolerance, direction=direction, span=36 * 3600).collect()}
    assert len(got) == len(asked)
    best = {}
    for row, col, ts, v, w in seen:
        if ts is not None and row is not None and (v is not None or w is not None):
            old = best.get((row, col, ts))
            key = lambda p: (p[0] is not None, p[0] or 0, p[1] is not None, p[1] or 0)
            best[row, col, ts] = (v, w) if old is None or key((v, w)) > key(old) else old
    for i, row, col, ts, _ in asked:
        near = [(abs((t - ts).total_seconds()), t > ts, t, v) for (a_, b_, t), v in best.items() if (a_, b_) == (row, col) and (direction == "nearest" or t <= ts)] if ts is not None else []
        d, _, t, v = min(near, default=(0, 0, None, (None, None)))
        if tolerance is not None and d > tolerance:
            t, v = None, (None, None)
        assert got[i] == (*v, t), i
    assert as_of(a.drop("__t").limit(0), o, ["v"]).count() == 0
    assert all(x.v is None for x in as_of(a.drop("__t"), o.limit(0), ["v"]).collect())


def test_percentiles_of_narrowed_brackets(spark, monkeypatch):
    for name, value in (("ACCURACY", 100), ("BRACKET_ROWS", 300), ("STEPS", 20)):
        monkeypatch.setattr(quantiles, name, value)
    held = []
    for n in (20_000, 60_000):  # three times the rows, no more of them in a bracket
        v = np.random.default_rng(n).normal(size=n).round(4)
        v[: n // 3] = 0.25  # a third of all rows is one value
        t = spark.createDataFrame([(g % 2, float(x)) for g, x in enumerate(v)] + [(7, None)], "g int, v double")
        at = [0.0, 0.02, 0.5, 0.6, 0.98, 1.0]
        got = {r.g: r.p for r in quantiles.percentiles(t, at, rows=n).collect()}
        assert quantiles.rounds(n) >= 1 and got[7] is None
        for g in (0, 1):
            np.testing.assert_allclose(got[g], np.quantile(v[np.arange(n) % 2 == g], at))
        b = quantiles.brackets(t, at, n)
        inside = quantiles._inside(t.where("v is not null").join(F.broadcast(b), "g"), len(at), F.lit(False)).groupBy("g", "i").agg(F.countDistinct("v").alias("c"))
        held.append(inside.agg(F.max("c")).first()[0])
    assert max(held) < 400


def test_running_medians():
    r = np.random.default_rng(0)
    v = r.normal(size=101)
    values, weights = np.zeros(0), np.zeros(0)
    for x in np.split(v, [7, 20, 77]):
        values, weights = stateful.merged(values, weights, x)
    assert stateful.median(values, weights) == np.median(v) and stateful.median(values[:4], weights[:4]) == np.median(values[:4])
    values, weights = np.zeros(0), np.zeros(0)
    many = r.exponential(size=20_000)
    for x in np.split(many, 40):
        values, weights = stateful.merged(values, weights, x)
    assert len(values) == stateful.HELD_VALUES and abs(stateful.median(values, weights) - np.median(many)) < 0.02


def test_a_restarted_stream_equals_the_batch(spark, tmp_path):
    stateful.stateful_session(spark)
    r = random.Random(8)
    rows = [(r.randint(0, 2), r.randint(0, 1), START + timedelta(minutes=r.randint(0, 50_000)), r.choice([None, float(r.randint(0, 30))])) for _ in range(400)]
    source, out, place = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "ck")
    schema = "row int, col int, ts timestamp, value float"

    def run():
        stream = stateful.latest_composite(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source), late="60 days")
        q = stream.writeStream.outputMode("update").option("checkpointLocation", place).foreachBatch(lambda df, k: df.withColumn("batch", F.lit(k)).write.mode("append").parquet(out)).trigger(availableNow=True).start()
        q.awaitTermination(120)
        assert q.exception() is None

    for part in (rows[:150], rows[150:230]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
    run()
    spark.createDataFrame(rows[230:], schema).coalesce(1).write.mode("append").parquet(source)  # after a stop
    run()
    got = {}
    for x in spark.read.parquet(out).orderBy("batch").collect():
        got[x.row, x.col] = (x.n, x.latest_ts, x.latest, x.median)
    want = {}
    for row, col, ts, v in rows:
        if v is not None:
            want.setdefault((row, col), []).append((ts, v))
    assert got == {k: (len(v), *max(v), float(np.median([x for _, x in v]))) for k, v in want.items()}


def test_idle_pixels_are_forgotten(spark, tmp_path):
    stateful.stateful_session(spark)
    schema = "row int, col int, ts timestamp, value float"
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    hours = lambda h: START + timedelta(hours=h)
    for k, part in enumerate([[(0, 0, hours(0), 1.0), (1, 1, hours(1), 5.0)], [(1, 1, hours(30), 6.0)], [(1, 1, hours(31), 7.0)], [(0, 0, hours(32), 2.0), (1, 1, hours(32), 8.0)]]):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{source}/part={k}")
    files = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(source)
    q = stateful.latest_composite(files, late="0 seconds", idle_ms=10 * 3600 * 1000).writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "ck")).foreachBatch(lambda df, k: df.withColumn("batch", F.lit(k)).write.mode("append").parquet(out)).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    last = {(x.row, x.col): x for x in spark.read.parquet(out).orderBy("batch").collect()}
    assert last[0, 0].n == 1 and last[0, 0].latest == 2.0  # forgotten in between
    assert last[1, 1].latest == 8.0
