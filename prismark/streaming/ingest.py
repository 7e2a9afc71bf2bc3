"""Validated incremental inserts, as batches and as a stream, and the live index they go to.

An index lives in a folder: vectors, postings and rejects, written by batch and attempt. A batch counts
once its marker is in ``commits``, which is made last; so readers see a batch in all tables or in none. A
batch that is replayed is written as a new attempt, which replaces the earlier one when it is committed;
files of the earlier one stay until ``vacuum``, for readers that have begun.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from prismark.operators import lsh
from prismark.plans.storage import remove, scratch, stored

VECTORS = "image_id bigint, features array<float>"
POSTINGS = "table_id int, bucket bigint, image_id bigint, node_id int"
REJECTS = "image_id bigint, size int, outcome string"
#: A batch of so many distinct ids at most is sent to the index's ids; beyond that both are shuffled.
BROADCAST_IDS = 1_000_000
BUILD = -1


def known_ids(batch: DataFrame, existing: DataFrame) -> DataFrame:
    """The ids (image_id) of batch that existing has. Existing ids outside the batch's range are not read where files tell their ranges."""
    wanted = batch.where("image_id IS NOT NULL").select("image_id").distinct()
    ends = wanted.agg(F.min("image_id").alias("a"), F.max("image_id").alias("b"), F.count(F.lit(1)).alias("n")).first()
    there = existing.select("image_id").where(F.col("image_id").between(ends["a"], ends["b"]))
    return there.join(F.broadcast(wanted) if ends["n"] <= BROADCAST_IDS else wanted, "image_id", "left_semi").distinct()


def validated(batch: DataFrame, existing: DataFrame, dim: int, order: str = "image_id") -> DataFrame:
    """batch (image_id, features, and the order column) with outcome: ok, null_id, dim_mismatch or duplicate_id.

    Ids that exist already, and all but the first valid row of an id in the batch, are duplicates.
    """
    size = F.coalesce(F.size("features"), F.lit(-1))
    checked = batch.withColumn("outcome", F.when(F.col("image_id").isNull(), "null_id").when(size != dim, "dim_mismatch"))
    there = known_ids(batch, existing).select(F.col("image_id").alias("_id"))
    first = F.row_number().over(W.partitionBy("image_id").orderBy(order, F.xxhash64("features")))
    fit = checked.where("outcome IS NULL").withColumn("_first", first).join(there, F.col("image_id") == F.col("_id"), "left")
    fit = fit.withColumn("outcome", F.when(F.col("_id").isNotNull() | (F.col("_first") > 1), "duplicate_id").otherwise("ok")).drop("_first", "_id")
    return checked.where("outcome IS NOT NULL").unionByName(fit)


Snapshot = tuple[tuple[int, int], ...]


class LiveIndex:
    """An LSH index in a folder that takes inserts while it is searched; a search reads the batches that are committed when it starts."""

    def __init__(self, spark: SparkSession, path: str, config: lsh.LSHConfig, dim: int, ring: DataFrame | None = None):
        self.spark, self.path, self.config, self.dim, self.ring = spark, path, config, dim, ring

    def _folder(self, name: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _markers(self) -> Iterator[tuple[int, int]]:
        fs, p = self._folder("commits")
        if fs.exists(p):
            for s in fs.listStatus(p):
                batch, _, attempt = s.getPath().getName().rpartition("_")
                yield int(batch), int(attempt)

    def snapshot(self) -> Snapshot:
        """The committed batches, each with its last attempt. What is read at one snapshot fits together."""
        last: dict[int, int] = {}
        for batch, attempt in self._markers():
            last[batch] = max(attempt, last.get(batch, 0))
        return tuple(sorted(last.items()))

    @property
    def built(self) -> bool:
        return bool(self.snapshot())

    def _table(self, name: str, schema: str, at: Snapshot | None = None) -> DataFrame:
        at = self.snapshot() if at is None else at
        paths = [f"{self.path}/{name}/batch={b}/attempt={a}" for b, a in at]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def vectors(self, at: Snapshot | None = None) -> DataFrame:
        return self._table("vectors", VECTORS, at)

    def postings(self, at: Snapshot | None = None) -> DataFrame:
        return self._table("postings", POSTINGS, at)

    def rejects(self, at: Snapshot | None = None) -> DataFrame:
        return self._table("rejects", REJECTS, at)

    def _commit(self, checked: DataFrame, number: int) -> None:
        """Writes a batch (image_id, features, outcome) as a new attempt and then its marker."""
        attempt = 1 + max((a for b, a in self._markers() if b == number), default=0)
        folder = lambda name: f"{self.path}/{name}/batch={number}/attempt={attempt}"
        accepted = checked.where("outcome = 'ok'").select("image_id", F.col("features").cast("array<float>").alias("features"))
        postings = lsh.build_index(accepted, self.config, self.dim, self.ring, "image_id", "features")
        rejected = checked.where("outcome <> 'ok'").select("image_id", F.size("features").alias("size"), "outcome")
        # ids lie together in files, so a later batch's check can pass over files
        accepted.sortWithinPartitions("image_id").write.mode("overwrite").parquet(folder("vectors"))
        postings.select("table_id", "bucket", "image_id", "node_id").write.mode("overwrite").parquet(folder("postings"))
        rejected.write.mode("overwrite").parquet(folder("rejects"))
        fs, p = self._folder(f"commits/{number}_{attempt}")
        fs.create(p, False).close()

    def build(self, vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding") -> None:
        own = vectors.select(F.col(id_column).cast("bigint").alias("image_id"), F.col(vector_column).cast("array<float>").alias("features"))
        self._commit(stored(own.where("image_id IS NOT NULL AND features IS NOT NULL").withColumn("outcome", F.lit("ok")), "build"), BUILD)

    def insert(self, batch: DataFrame, number: int, order: str = "image_id") -> None:
        """Appends the valid rows of a batch (image_id, features); the others go to the rejects with their outcome."""
        at = self.snapshot()
        if not at:
            raise RuntimeError("the index is not built")
        existing = self.vectors(tuple(x for x in at if x[0] != number))
        batch = stored(batch, "insert-batch")
        # stored first: what the batch is checked against is the table it is then added to
        self._commit(stored(validated(batch, existing, self.dim, order), "insert"), number)

    def vacuum(self) -> None:
        """Deletes attempts that a later one has replaced; no reader may have begun before that."""
        now = dict(self.snapshot())
        for batch, attempt in list(self._markers()):
            if attempt < now[batch]:
                for name in ("vectors", "postings", "rejects"):
                    remove(self.spark, f"{self.path}/{name}/batch={batch}/attempt={attempt}")
                remove(self.spark, f"{self.path}/commits/{batch}_{attempt}")

    def stream(self, source: DataFrame, order: str = "image_id", checkpoint: str | None = None):
        """Starts inserting what is available in a streaming source (image_id, features) and returns the query."""
        def add(batch: DataFrame, number: int) -> None:
            self.insert(batch, number, order)

        mark = checkpoint or scratch(self.spark, "insert-checkpoint")
        return source.writeStream.foreachBatch(add).option("checkpointLocation", mark).trigger(availableNow=True).start()

    def search(self, queries: DataFrame, k: int, metric: str = "cosine", id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
        at = self.snapshot()
        q = queries.select(F.col(id_column).alias("vec_id"), F.col(vector_column).alias("embedding"))
        v = self.vectors(at).select(F.col("image_id").alias("vec_id"), F.col("features").alias("embedding"))
        return lsh.search_index(self.postings(at), v, q, self.config, self.dim, k, metric)
