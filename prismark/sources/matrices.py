"""Feature matrices and their metadata: NumPy files, CSV, JSON maps, generated vectors, reports."""

from __future__ import annotations

from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from prismark.functions.vectors import l2_normalize
from prismark.plans.numbering import numbered


class _Rows(InputPartition):
    def __init__(self, first: int, last: int):
        self.first, self.last = first, last


class _NpyReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"].removeprefix("file://")
        self.rows = int(options.get("rows", -1))
        self.parts = max(1, int(options.get("partitions", 8)))

    def partitions(self) -> list[InputPartition]:
        n = np.load(self.path, mmap_mode="r").shape[0]
        n = n if self.rows < 0 else min(n, self.rows)
        step = max(1, -(-n // self.parts))
        return [_Rows(a, min(n, a + step)) for a in range(0, n, step)]

    def read(self, partition: _Rows) -> Iterator[pa.RecordBatch]:
        m = np.load(self.path, mmap_mode="r")
        for a in range(partition.first, partition.last, 4096):
            part = np.asarray(m[a : min(a + 4096, partition.last)], np.float32)
            flat = pa.array(np.ascontiguousarray(part).ravel())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1, dtype=np.int32) * part.shape[1]), flat)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(a, a + len(part))), lists], names=["row_index", "features"])


class NpyDataSource(DataSource):
    """``spark.read.format("npy").load(path)``: a two-dimensional .npy file on a path that all workers see, memory-mapped, a range of rows to a partition.

    Options: rows (only the first so many), partitions.
    """

    @classmethod
    def name(cls) -> str:
        return "npy"

    def schema(self) -> str:
        return "row_index bigint, features array<float>"

    def reader(self, schema) -> DataSourceReader:
        return _NpyReader(self.options)


def read_npy(spark: SparkSession, path: str, rows: int | None = None, partitions: int = 8) -> DataFrame:
    spark.dataSource.register(NpyDataSource)
    read = spark.read.format("npy").option("partitions", partitions)
    return (read if rows is None else read.option("rows", rows)).load(path)


def write_npy(df: DataFrame, path: str, order: str = "row_index", column: str = "features") -> int:
    """Writes vectors in order to one .npy file on a path that all workers see; returns their number.

    The driver writes the header; every task writes its rows to their places. Vectors must have one length.
    For exchange; tables belong in Parquet.
    """
    path = path.removeprefix("file://")
    Path(path).parent.mkdir(parents=True, exist_ok=True)
    own = df.select(order, F.col(column).cast("array<float>").alias("features"))
    size = own.agg(F.count(F.lit(1)).alias("n"), F.min(F.size("features")).alias("a"), F.max(F.size("features")).alias("b"), F.count("features").alias("there")).first()
    if not size["n"]:
        np.save(path, np.zeros((0, 0), np.float32))
        return 0
    if size["a"] != size["b"] or size["there"] < size["n"]:
        raise ValueError("vectors of one matrix must be there and have one length")
    width = size["a"]
    np.lib.format.open_memmap(path, "w+", np.float32, (size["n"], width)).flush()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, n = np.load(path, mmap_mode="r+"), 0
        for b in batches:
            m[b.column("place").to_numpy()] = b.column("features").flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            n += b.num_rows
        m.flush()
        yield pa.RecordBatch.from_arrays([pa.array([n])], names=["n"])

    return numbered(own, [order], "place").select("place", "features").mapInArrow(run, "n bigint").agg(F.sum("n")).first()[0]


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """Rows (index, image_path) of a .npy list of paths or of a CSV with a header, split at the first comma only.

    A line that does not begin with a number and a comma, other than the header, is kept whole as path with a null index.
    """
    if path.endswith(".npy"):
        paths = np.load(path.removeprefix("file://"), allow_pickle=False)
        return spark.createDataFrame([(i, str(p)) for i, p in enumerate(paths)], "index bigint, image_path string")
    lines = spark.read.text(path).where("trim(value) <> '' AND NOT value RLIKE '^ *index *,'")
    fits = F.col("value").rlike("^[0-9]{1,18},")
    return lines.select(F.when(fits, F.substring_index("value", ",", 1).cast("bigint")).alias("index"), F.when(fits, F.regexp_replace("value", "^[0-9]+,", "")).otherwise(F.col("value")).alias("image_path"))


def write_metadata(df: DataFrame, path: str) -> None:
    """Rows (index, image_path) as CSV lines, the header first in each file."""
    df.select("index", "image_path").write.mode("overwrite").option("header", True).option("quote", "").option("emptyValue", "").csv(path)


def write_hashes(df: DataFrame, path: str) -> None:
    """Hash records as JSON lines."""
    df.write.mode("overwrite").json(path)


def read_hash_map(spark: SparkSession, path: str) -> DataFrame:
    """Rows (image_path, ahash, dhash, phash) of a JSON object that maps paths to hash records, or of a folder of such objects."""
    text = spark.read.text(path, wholetext=True)
    entries = text.select(F.explode(F.from_json("value", "map<string,map<string,string>>")).alias("image_path", "h"))
    return entries.select("image_path", F.col("h")["aHash"].alias("ahash"), F.col("h")["dHash"].alias("dhash"), F.col("h")["pHash"].alias("phash"))


def write_hash_map(df: DataFrame, path: str, each: int = 10_000) -> None:
    """Rows (image_path, ahash, dhash, phash) as JSON objects that map paths to hash records, about ``each`` records to an object, one object to a file."""
    parts = max(1, -(-df.count() // each))
    one = F.struct("image_path", F.struct(F.col("ahash").alias("aHash"), F.col("dhash").alias("dHash"), F.col("phash").alias("pHash")))
    own = df.where("image_path IS NOT NULL").dropDuplicates(["image_path"]).groupBy(F.pmod(F.xxhash64("image_path"), F.lit(parts)).alias("part"))
    objects = own.agg(F.to_json(F.map_from_entries(F.collect_list(one))).alias("value"))
    objects.select("value").write.mode("overwrite").option("maxRecordsPerFile", 1).text(path)


def write_alignment(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def read_alignment(spark: SparkSession, path: str) -> DataFrame:
    schema = "image_id string, ahash string, dhash string, phash string, trad_row_index bigint, deep_row_index bigint"
    return spark.read.schema(schema).option("header", True).csv(path)


def generate(spark: SparkSession, rows: int, dim: int, seed: int = 42) -> DataFrame:
    """Rows (image_id, features): Gaussian vectors of unit norm, each from its own seed, so any partitioning gives the same table."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(0).to_numpy()
            m = np.stack([np.random.default_rng([seed, int(i)]).standard_normal(dim) for i in ids]) if len(ids) else np.zeros((0, dim))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(list(m.astype(np.float32)), pa.list_(pa.float32()))], names=["image_id", "raw"])

    raw = spark.range(rows).mapInArrow(run, "image_id bigint, raw array<float>")
    return raw.select("image_id", l2_normalize(F.col("raw")).cast("array<float>").alias("features"))


def write_report(metrics: DataFrame, path: str) -> None:
    """A table of metrics as JSON lines in one file."""
    metrics.coalesce(1).write.mode("overwrite").json(path)
