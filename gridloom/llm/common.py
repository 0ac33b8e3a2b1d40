"""Shared helpers: table reading, scratch tables in the cluster's shared folder, Arrow text buffers."""

from __future__ import annotations

import ctypes
import math
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Bytes of text that one vectorised step handles; a longer single text is a step of its own.
SLICE_BYTES = 1 << 20
#: Rows that a rank bucket holds on average.
BUCKET_ROWS = 4000
#: Rows that a key may always bring to a task of a join.
FREQUENT_ROWS = 1000


#: Rows of an Arrow batch where the session doesn't say otherwise: texts are long, and a batch lies in memory several times.
BATCH_ROWS = 1000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Sets the session's Arrow batch size, unless the user has."""
    if spark.conf.get(_BATCH, None) is None:
        spark.conf.set(_BATCH, str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table ``name`` of a data folder."""
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir`` if set; on one machine, else, a folder of our own."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    now = spark.sparkContext._jsc.sc().getCheckpointDir()
    if now.isEmpty():
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="gridloom-"))
        now = spark.sparkContext._jsc.sc().getCheckpointDir()
    return now.get().rstrip("/")


class Scratch:
    """Tables written to the shared folder, which cut lineage and outlive executors.

    ``keep`` writes and rereads a DataFrame; ``drop`` deletes a table once later ones are written.
    """

    def __init__(self, spark: SparkSession, label: str):
        small_batches(spark)
        self.spark, self.root, self.n = spark, f"{shared_dir(spark)}/gridloom/{label}-{uuid.uuid4().hex}", 0

    def keep(self, df: DataFrame, compression: str = "zstd") -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n}"
        df.write.option("compression", compression).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def keep_by(self, df: DataFrame, column: str) -> DataFrame:
        """As ``keep``, in as many buckets of ``column`` as a shuffle has partitions: joins on it don't shuffle the table again."""
        self.n += 1
        path, name = f"{self.root}/{self.n}", f"gridloom_{uuid.uuid4().hex}"
        df.repartition(task_width(self.spark), column).write.bucketBy(task_width(self.spark), column).sortBy(column).option("path", path).option("compression", "zstd").saveAsTable(name)
        out = self.spark.table(name)
        out._scratch_path, out._scratch_table = path, name
        return out

    def drop(self, df: DataFrame) -> None:
        path, name = getattr(df, "_scratch_path", None), getattr(df, "_scratch_table", None)
        if name:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        if path:
            where = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def own_name(label: str) -> str:
    """A column name that no table has."""
    return f"__{label}_{uuid.uuid4().hex}"


def task_width(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def frequent_join(left: DataFrame, right: DataFrame, on: list[str], count: str, how: str = "inner") -> DataFrame:
    """left joined (``how``: inner or left) with right, which has one row a key and in ``count`` how many rows of left the key has.

    Keys with more rows than a quarter of a task's fair share are at most ``4 * task_width``, so their hashes fit a filter and
    their rows of right a broadcast; left's rows of them stay where they are. All other keys meet by shuffle.
    """
    width = task_width(left.sparkSession)
    limit = max(FREQUENT_ROWS, (right.agg(F.sum(count)).first()[0] or 0) // (4 * width))
    hashed = F.xxhash64(*on)
    frequent = [r[0] for r in right.where(F.col(count) > limit).select(hashed).collect()]
    if not frequent:
        return left.join(right, on, how)
    chosen = hashed.isin(frequent)
    return left.where(chosen).join(F.broadcast(right.where(chosen)), on, how).unionByName(left.where(~chosen).join(right.where(~chosen), on, how))


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column without a copy; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    o = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    d = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return d[o[0] : o[-1]], o - o[0]


def slices(offsets: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges [a, b) of at most ``limit`` bytes, or of one longer row."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + limit, "right")) - 1)
        b = min(b, n)
        yield a, b
        a = b


def take(column: pa.Array, rows: np.ndarray) -> pa.Array:
    return column.take(pa.array(rows))


def dense_rank_in(df: DataFrame, keys: list[str], order: list, out: str, n_rows: int) -> DataFrame:
    """Adds ``out``: a number from 0 within ``keys``, gapless, without one task per key.

    Rows of a key are dealt to buckets by the hash of ``order``; a bucket's rows are numbered by a window, buckets are
    offset by a running sum over bucket counts. The numbers follow the hash, a seeded order.
    """
    buckets = max(1, math.ceil(n_rows / BUCKET_ROWS))
    h = df.withColumn("__h", F.xxhash64(*order)).withColumn("__b", F.pmod(F.col("__h"), F.lit(buckets)))
    counts = h.groupBy(*keys, "__b").agg(F.count(F.lit(1)).alias("__n"))
    ahead = Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select(*[F.col(k).alias(f"__k_{k}") for k in keys], F.col("__b").alias("__kb"), F.coalesce(F.sum("__n").over(ahead), F.lit(0)).alias("__from"))
    inner = Window.partitionBy(*keys, "__b").orderBy("__h", *order)
    same = [h[k].eqNullSafe(counts[f"__k_{k}"]) for k in keys]
    on = h["__b"] == counts["__kb"]
    for s in same:
        on = on & s
    return h.join(counts, on).withColumn(out, F.col("__from") + F.row_number().over(inner) - 1).drop("__h", "__b", "__kb", "__from", *[f"__k_{k}" for k in keys])


def trim() -> None:
    """Gives a worker's free memory back at a task's end, where the C library can."""
    pa.default_memory_pool().release_unused()
    release = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if release:
        release(0)
