"""What the operators of this subpackage share: tables, row locators, and memory of Python workers."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from prismark.plans.storage import remove, scratch, stored

__all__ = ["ascii_lower", "at_locators", "collected", "heavy_join", "located", "locator", "maybe_in", "parts", "plain", "release", "remove", "scratch", "small_batches", "stored", "table", "unused", "without", "worker_forget", "worker_kept"]

#: Bytes of an Arrow batch, about, and of the texts that Python works on together.
BATCH_BYTES = 4_000_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def locator(df: DataFrame) -> tuple[Column, Column]:
    """File and row number that Parquet scans expose, whatever the columns are called; AnalysisException where df is no plain scan."""
    scan = df.metadataColumn("_metadata")
    return scan["file_path"], scan["row_index"]


def located(df: DataFrame, columns: list[Column]) -> DataFrame:
    """``columns`` of df with the locator of each row: ``at_file``, ``at_row``. A frame that is no plain scan is first written to the shared folder."""
    try:
        at = [c.alias(n) for c, n in zip(locator(df), ("at_file", "at_row"), strict=True)]
        return df.select(*columns, *at)
    except AnalysisException:
        names = [f"c{i}" for i in range(len(columns))]
        kept = stored(df.select(*[c.alias(n) for c, n in zip(columns, names, strict=True)]), "rows")
        fields = df.select(*columns).columns
        at = [c.alias(n) for c, n in zip(locator(kept), ("at_file", "at_row"), strict=True)]
        return kept.select(*[F.col(n).alias(f) for n, f in zip(names, fields, strict=True)], *at)


def small_batches(spark: SparkSession) -> None:
    """Texts may be very long: Arrow batches to Python are bounded by bytes, beside Spark's bound on their rows, for all that the session runs from here on."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def plain(df: DataFrame) -> DataFrame:
    """df itself if it is a plain Parquet scan, else a stored copy that is one."""
    small_batches(df.sparkSession)
    try:
        df.select(*locator(df))
        return df
    except AnalysisException:
        return stored(df, "table")


def unused(df: DataFrame, name: str) -> str:
    """A column name that df does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


#: Bits of the filter below; it is sent to all tasks, 4 MB at most whatever the tables' sizes.
FILTER_BITS, BUCKET_BITS = 1 << 25, 32_768


def maybe_in(df: DataFrame, keys: list[Column], wanted: DataFrame, wanted_keys: list[Column]) -> tuple[DataFrame, str]:
    """df with a boolean column, and its name: false only where no row of wanted has the row's keys.

    A bitmap of fixed size holds a hash of each wanted key. It spares a shuffle the rows that cannot
    match; as it fills up it spares less, and the join behind it decides in any case.
    """
    maybe, bucket_name, bits_name = (unused(df, f"__{x}") for x in ("maybe", "bucket", "bits"))
    place = lambda columns: F.pmod(F.xxhash64(*columns), F.lit(FILTER_BITS))
    bucket, bit = (lambda p: F.floor(p / BUCKET_BITS)), (lambda p: p % BUCKET_BITS)
    bits = wanted.select(place(wanted_keys).alias("p")).groupBy(bucket(F.col("p")).alias(bucket_name)).agg(F.bitmap_construct_agg(bit(F.col("p"))).alias(bits_name))
    own = place(keys)
    byte = F.conv(F.hex(F.substring(bits_name, (bit(own) / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    is_set = (F.call_function("shiftright", byte, (bit(own) % 8).cast("int")) % 2) == 1
    # at most FILTER_BITS / BUCKET_BITS rows of BUCKET_BITS / 8 bytes
    joined = df.join(F.broadcast(bits), bucket(own) == F.col(bucket_name), "left")
    return joined.withColumn(maybe, F.coalesce(is_set, F.lit(False))).drop(bucket_name, bits_name), maybe


def without(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """docs, a plain Parquet scan, without the rows at the locators (at_file, at_row) in dropped. Only rows that may be dropped are shuffled."""
    names = [unused(docs, f"__{x}") for x in ("file", "row", "gone_file", "gone_row")]
    file, row = locator(docs)
    mine = docs.select("*", file.alias(names[0]), row.alias(names[1]))
    gone = dropped.select(F.col("at_file").alias(names[2]), F.col("at_row").alias(names[3]))
    mine, maybe = maybe_in(mine, [F.col(names[0]), F.col(names[1])], gone, [F.col(names[2]), F.col(names[3])])
    checked = mine.where(F.col(maybe)).join(gone, (F.col(names[0]) == F.col(names[2])) & (F.col(names[1]) == F.col(names[3])), "left_anti")
    return mine.where(~F.col(maybe)).unionByName(checked).drop(*names[:2], maybe)


def heavy_join(left: DataFrame, right: DataFrame, key: str, weight: str, rows: int, spread: list[str]) -> DataFrame:
    """left joined with right, which has one row for each key, and in ``weight`` how many of left's ``rows`` hold it at most.

    A key with more than a thousandth of all rows, so one of fewer than a thousand keys, is split: its rows
    are dealt out by a hash of the columns ``spread``, and its row in right is copied as often.
    """
    most = max(1, rows // 1000)
    part, parts = unused(left, "__part"), unused(left, "__parts")
    many = F.ceil(F.col(weight) / most)
    heavy = right.where(F.col(weight) > most).select(key, many.alias(parts))
    dealt = left.join(F.broadcast(heavy), key, "left").withColumn(part, F.pmod(F.xxhash64(*spread), F.coalesce(parts, F.lit(1).cast("bigint")))).drop(parts)
    copies = right.withColumn(part, F.explode(F.sequence(F.lit(0).cast("bigint"), many - 1)))
    return dealt.join(copies, [key, part]).drop(part)


def at_locators(located_rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """The located rows whose locators (at_file, at_row) are in wanted, joined with it."""
    keys = [F.col("at_file"), F.col("at_row")]
    some, maybe = maybe_in(located_rows, keys, wanted, keys)
    return some.where(F.col(maybe)).drop(maybe).join(wanted, ["at_file", "at_row"])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z only; every other character stays as it is."""
    return F.translate(c, UPPER, LOWER)


def parts(batch: pa.RecordBatch, column: str, most: int) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about so many bytes in a column each: texts may be very long."""
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)) // most
    starts = np.flatnonzero(np.diff(size, prepend=-1))
    for a, b in zip(starts, [*starts[1:], batch.num_rows], strict=True):
        yield batch.slice(a, b - a)


_kept: dict[Any, Any] = {}


def worker_kept(key: Any, make: Callable[[], Any]) -> Any:
    """What a Python worker keeps between its tasks. It keeps one thing: another key drops what was there, so operators that run one after another do not add up."""
    if key not in _kept:
        _kept.clear()
        release()
        _kept[key] = make()
    return _kept[key]


def worker_forget() -> None:
    """Drops what the worker keeps: for steps whose workers then wait beside those of the next stage."""
    _kept.clear()
    release()


def release() -> None:
    """Gives freed memory back, as idle workers live on beside the next stage."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def collected(spark: SparkSession) -> None:
    """Collects the driver's garbage: its heap otherwise grows to its limit before it is collected, and shuffle files and broadcasts that nothing refers to any more stay until then."""
    release()
    spark.sparkContext._jvm.System.gc()
