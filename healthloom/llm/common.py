"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import contextlib
import sys
import tempfile
from collections.abc import Callable, Iterator

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: White space of the contracts: space and U+0009 to U+000D, nothing else.
WORD = r"[^\x20\x09-\x0D]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and leave every other character alone."""
    return F.translate(text, UPPER, UPPER.lower())


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster; a local one only where none is set (tests)."""
    context = spark.sparkContext
    now = context._jsc.sc().getCheckpointDir()
    if now.isDefined():
        return now.get()
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not context.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoints-"))
    return context._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and go on from there.

    A reliable checkpoint: it outlives executors.  Spark's cleaner removes it
    when the frame is no longer referenced, if the cluster sets
    ``spark.cleaner.referenceTracking.cleanCheckpoints``.
    """
    checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a folder of this library's in the shared folder, through Spark's file system."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def small(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """A broadcast hint if ``df`` (written before) has few rows; else Spark joins by a shuffle."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


@contextlib.contextmanager
def short_batches(spark: SparkSession, rows: int = 512) -> Iterator[None]:
    """Arrow batches of few rows for what is run inside, so that batches of long texts stay small."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, rows)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shipped(module: str) -> None:
    """Pickle the module's functions by value: executors need not have this package."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


def spread(spark: SparkSession, least: int) -> int:
    """How many buckets to deal rows into: more than there are shuffle partitions."""
    return max(least, 2 * int(spark.conf.get("spark.sql.shuffle.partitions")))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over a value that is worked out once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def before_each(values: Column) -> Column:
    """Sums of the whole numbers before each one of an array.

    In chunks of about the square root of its length: an array that grows by one
    element is copied each time, so one pass would cost the square of the length.
    """
    none = F.struct(F.lit(0).cast("long").alias("sum"), F.array().cast("array<bigint>").alias("out"))

    def sums(chunk: Column) -> Column:
        step = lambda held, v: F.struct((held["sum"] + v).alias("sum"), F.array_append(held["out"], held["sum"]).alias("out"))
        return F.aggregate(chunk, none, step)

    def shifted(parts: Column) -> Column:
        starts = sums(F.transform(parts, lambda p: p["sum"]))["out"]
        return F.flatten(F.zip_with(parts, starts, lambda p, at: F.transform(p["out"], lambda v: v + at)))

    def chunked(all_values: Column) -> Column:
        size = F.size(all_values)
        wide = F.greatest(F.lit(1), F.ceil(F.sqrt(size)).cast("int"))
        places = F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(size / wide).cast("int") - 1))
        return let(F.transform(places, lambda k: sums(F.slice(all_values, k * wide + 1, wide))), shifted)

    return let(F.transform(values, lambda v: v.cast("long")), chunked)


def bucket_of(keys: list[Column], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def searched(bounds: list[int], value: Column) -> Column:
    """Number of ``bounds`` (ascending) that are <= value, by binary search in one expression."""
    if not bounds:
        return F.lit(0)
    size = 1 << len(bounds).bit_length()
    table = F.lit([*bounds, *[2**63 - 1] * (size - len(bounds))])
    steps = F.lit([size >> k for k in range(1, size.bit_length())])
    found = F.aggregate(
        steps, F.lit(0), lambda at, step: F.when(F.element_at(table, at + step) <= value, at + step).otherwise(at)
    )
    return F.least(F.coalesce(found, F.lit(0)), F.lit(len(bounds)))


#: A filter's most bits: 1024 bitmaps of 4 KiB (4 MiB) are broadcast at most, whatever the input.
FILTER_BITS = 1 << 25
BITMAP_BITS = 32768


class KeyFilter:
    """A filter of the keys of ``listed`` (a written frame), of about 16 bits for each up to ``FILTER_BITS``.

    Beyond two million keys more and more other rows pass: it only saves a
    shuffle, and what passes is joined with the keys themselves.
    """

    def __init__(self, listed: DataFrame, keys: list[str]):
        self.bits = BITMAP_BITS
        most = 16 * listed.count()
        while self.bits < min(most, FILTER_BITS):
            self.bits *= 2
        self.bitmaps = cut(bitmaps(listed.select(filter_bit(keys, self.bits).alias("bit"))))

    def told(self, df: DataFrame, keys: list[str]) -> DataFrame:
        """``df`` and ``live``: whether the row's key may be listed."""
        return flagged(df, filter_bit(keys, self.bits), self.bitmaps)

    def passed(self, df: DataFrame, keys: list[str]) -> DataFrame:
        return self.told(df, keys).filter("live").drop("live")


def filter_bit(keys: list[str], bits: int = FILTER_BITS) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(bits))


def bitmaps(bit_rows: DataFrame) -> DataFrame:
    """``bit`` numbers -> (part, bits): the filter as bitmaps of 32768 bits."""
    return bit_rows.groupBy(F.floor(F.col("bit") / BITMAP_BITS).alias("part")).agg(
        F.bitmap_construct_agg(F.col("bit") % BITMAP_BITS).alias("bits")
    )


def flagged(df: DataFrame, bit: Column, filter_: DataFrame) -> DataFrame:
    """``df`` and ``live``: whether the row's bit is set.  No key of the filter is missed; few others pass."""
    at = (bit % BITMAP_BITS).cast("int")
    byte = F.conv(F.hex(F.expr("substring(bits, at div 8 + 1, 1)")), 16, 10).cast("int")
    return (
        df.withColumns({"part": F.floor(bit / BITMAP_BITS), "at": at})
        .join(F.broadcast(filter_), "part", "left")
        .withColumn("live", F.coalesce(F.call_function("getbit", byte, F.col("at") % 8) == 1, F.lit(False)))
        .drop("part", "at", "bits")
    )


def drop_rows(keyed: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """The ``row`` structs of ``keyed`` without those listed in ``gone``, as columns.

    ``gone``: the key columns (each key once) and ``gone``, how many rows of
    that key go.  Rows whose filter bit is dead pass without a shuffle, so the
    texts that move are those of listed rows.
    """
    gone = cut(gone.select(*[F.col(k).alias(f"g_{k}") for k in keys], "gone"))
    held = KeyFilter(gone, [f"g_{k}" for k in keys]).told(keyed, keys)
    same = F.lit(True)
    for k in keys:
        same &= F.col(k).eqNullSafe(F.col(f"g_{k}"))
    joined = held.filter("live").join(gone, same, "left")
    # only rows of listed keys are numbered: the window holds the repeats of one row
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.lit(0)))
    again = joined.filter("gone IS NOT NULL").withColumn("place", place).filter("place > gone")
    return (
        held.filter("NOT live")
        .select("row.*")
        .unionByName(joined.filter("gone IS NULL").select("row.*"))
        .unionByName(again.select("row.*"))
    )
