"""A query service over a live index: cached answers, statistics of each step, and streams of queries.

The service answers batches of at most ``MOST`` queries, whose results it collects, as a client asks for
them; larger batches are ordinary searches of the index. Answers are kept by the query's vector, k, metric
and the snapshot of the index they were computed at, so an insert makes all earlier ones stale.
"""

from __future__ import annotations

import time
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismark.operators import cache, lsh, search, statistics
from prismark.plans.storage import scratch, stored
from prismark.streaming.ingest import LiveIndex

MOST = 1024
ANSWER = "query_id bigint, rank int, image_id bigint, score double, node_id int"


@dataclass(frozen=True)
class QueryStats:
    """Of one batch: its queries, how many the cache answered, candidates before and after merging, nodes that held them, and milliseconds."""

    queries: int
    cached: int
    met: int
    candidates: int
    nodes: int
    fan_out_ms: float
    merge_ms: float
    rerank_ms: float
    total_ms: float


class QueryService:
    def __init__(self, index: LiveIndex, capacity: int = 100):
        self.index, self.cache, self.log = index, cache.ResultCache(capacity), []
        self._version = None

    def query(self, queries: DataFrame, k: int, metric: str = "cosine", id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
        """Rows (query_id, rank, image_id, score, node_id); what it took is the last entry of ``log``."""
        search.vectors.metric(metric)
        began, index, spark = time.perf_counter(), self.index, self.index.spark
        at = index.snapshot()
        if at != self._version:
            self.cache.clear()
            self._version = at
        own = queries.select(F.col(id_column).cast("bigint").alias("vec_id"), F.col(vector_column).alias("embedding")).where("vec_id IS NOT NULL AND embedding IS NOT NULL")
        key = cache.cache_key(F.col("embedding"), k, metric, str(at))
        asked = own.select("vec_id", key.alias("key")).limit(MOST + 1).collect()
        if len(asked) > MOST:
            raise ValueError(f"more than {MOST} queries: search the index itself")
        known = {r["vec_id"]: self.cache.get(r["key"]) for r in asked}
        fresh = [i for i, answer in known.items() if answer is None]
        met = candidates = nodes = 0
        marks = [time.perf_counter()] * 4
        if fresh:
            wanted = stored(own.where(F.col("vec_id").isin(fresh)), "service-queries")
            asking = lsh.codes(wanted, index.config, index.dim).select(F.col("image_id").alias("query_id"), "table_id", "bucket")
            hits = stored(index.postings(at).join(asking, ["table_id", "bucket"]).select("query_id", "image_id", "node_id"), "service-hits")
            met = hits.count()
            marks[1] = time.perf_counter()
            merged = stored(hits.groupBy("query_id", "image_id").agg(F.min("node_id").alias("node_id")), "service-candidates")
            counts = merged.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("node_id").alias("nodes")).first()
            candidates, nodes = counts["n"], counts["nodes"]
            marks[2] = time.perf_counter()
            rows = index.vectors(at).select(F.col("image_id").alias("vec_id"), F.col("features").alias("embedding"))
            answers: dict[int, list] = {i: [] for i in fresh}
            for r in search.rerank(merged, rows, wanted, metric, k).select(*[x.split()[0] for x in ANSWER.split(", ")]).collect():  # at most k rows a query
                answers[r["query_id"]].append(tuple(r)[1:])
            marks[3] = time.perf_counter()
            for r in asked:
                if r["vec_id"] in answers:
                    known[r["vec_id"]] = sorted(answers[r["vec_id"]])
                    self.cache.put(r["key"], known[r["vec_id"]])
        out = spark.createDataFrame([(i, *x) for i, answer in known.items() for x in answer], ANSWER)
        ms = [1000 * (b - a) for a, b in zip(marks, marks[1:], strict=False)] if fresh else [0.0] * 3
        self.log.append(QueryStats(len(known), len(known) - len(fresh), met, candidates, nodes, *ms, 1000 * (time.perf_counter() - began)))
        return out

    def latencies(self) -> DataFrame:
        """The log as a table, a row for each batch."""
        fields = [f"{n} {'double' if n.endswith('_ms') else 'bigint'}" for n in QueryStats.__dataclass_fields__]
        return self.index.spark.createDataFrame([tuple(asdict(s).values()) for s in self.log], ", ".join(fields))

    def percentiles(self, ps: tuple[float, ...] = (0.5, 0.95, 0.99)) -> DataFrame:
        """One row with percentiles of the batches' times, by nearest rank."""
        all_ = self.latencies().withColumn("of", F.lit("total_ms"))
        return statistics.percentiles(all_, "of", "total_ms", list(ps), nearest_rank=True)

    def stream(self, source: DataFrame, out: str, k: int, metric: str = "cosine", checkpoint: str | None = None, id_column: str = "vec_id", vector_column: str = "embedding"):
        """Answers a stream of queries as they come: results go to ``out`` by micro-batch, times to the log. Stop the returned query to shut down."""
        def answer(batch: DataFrame, number: int) -> None:
            began = time.perf_counter()
            batch = stored(batch, "service-stream")
            self.index.search(batch, k, metric, id_column, vector_column).write.mode("overwrite").parquet(f"{out}/batch={number}")
            total = 1000 * (time.perf_counter() - began)
            self.log.append(QueryStats(batch.count(), 0, 0, 0, 0, 0.0, 0.0, 0.0, total))

        mark = checkpoint or scratch(self.index.spark, "service-checkpoint")
        return source.writeStream.foreachBatch(answer).option("checkpointLocation", mark).start()
