"""Command line: build an index, search it, time searches, tune re-ranking, extract descriptors of an image folder."""

from __future__ import annotations

import argparse
import random
import time

from pyspark.sql import SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from prismark.operators import evaluation, lsh, ring, search
from prismark.plans.storage import scratch
from prismark.sources import images, matrices
from prismark.streaming.ingest import LiveIndex
from prismark.streaming.serving import QueryService


def _vectors(spark: SparkSession, path: str):
    df = matrices.read_npy(spark, path) if path.endswith(".npy") else spark.read.parquet(path)
    key, value = df.columns[0], next(c for c, kind in df.dtypes if kind.startswith("array"))
    return df.select(F.col(key).cast("bigint").alias("vec_id"), F.col(value).alias("embedding"))


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="python -m prismark", description=__doc__)
    verbs = p.add_subparsers(dest="verb", required=True)
    for verb in ("index", "search", "benchmark", "tune"):
        v = verbs.add_parser(verb)
        v.add_argument("--vectors", required=True, help="Parquet folder or .npy file: id, vector")
        v.add_argument("--num-tables", type=int, default=10)
        v.add_argument("--hash-width", type=int, default=32)
        v.add_argument("--num-nodes", type=int, default=4)
        v.add_argument("--virtual-nodes", type=int, default=150)
        v.add_argument("--metric", choices=("cosine", "l2"), default="cosine")
        if verb == "index":
            v.add_argument("--out", required=True)
        else:
            v.add_argument("--query-id", type=int, action="append", help="may be repeated; without it, ids that 20 divides")
            v.add_argument("--random", type=int, metavar="N", help="N rows drawn at random as queries")
            v.add_argument("--seed", type=int, default=42)
            v.add_argument("--top-k", type=int, default=10)
            v.add_argument("--out", help="folder for the results as JSON lines; they are shown in any case")
        if verb == "search":
            v.add_argument("--exact", action="store_true")
            v.add_argument("--metadata", help=".npy or CSV of index and image path, for a column image_path")
        if verb == "benchmark":
            v.add_argument("--repeat", type=int, default=3, help="single-query searches after the batch")
    v = verbs.add_parser("extract")
    v.add_argument("--folder", required=True)
    v.add_argument("--out", required=True)
    v.add_argument("--extractor", action="append", default=[], help="color, orb, sift; in this order")
    return p


def _asked(rows, a):
    if a.query_id:
        return rows.where(F.col("vec_id").isin(a.query_id))
    if a.random:
        return evaluation.sampled(rows, a.random, a.seed).drop("place")
    return rows.where("vec_id % 20 = 0")


def _shown(out, order: list[str], a, lines: int = 50) -> None:
    if a.out:
        matrices.write_report(out, a.out)
        out = out.sparkSession.read.schema(out.schema).json(a.out)
    out.orderBy(*order).show(lines, truncate=False)


def _benchmark(index: LiveIndex, asked, a) -> None:
    """One batch of all queries and then single ones, through the query service; its statistics, and percentiles of the single ones."""
    batch, single = QueryService(index, 0), QueryService(index, 0)
    batch.query(asked, a.top_k, a.metric)
    ids = sorted(r["vec_id"] for r in asked.select("vec_id").collect())  # at most serving.MOST, as the service has taken them
    began = time.perf_counter()
    for i in random.Random(a.seed).choices(ids, k=a.repeat):
        single.query(asked.where(F.col("vec_id") == i), a.top_k, a.metric)
    seconds = time.perf_counter() - began
    both = batch.latencies().withColumn("run", F.lit("batch")).unionByName(single.latencies().withColumn("run", F.lit("single")))
    _shown(both, ["run", "total_ms"], a)
    single.percentiles().show()
    print(f"{a.repeat / seconds:.2f} single queries a second")


def main(args: list[str] | None = None) -> None:
    a = _parser().parse_args(args)
    spark = SparkSession.builder.appName("prismark").getOrCreate()
    if a.verb == "extract":
        loaded = images.load_images(spark, a.folder)
        images.with_hashes(loaded).write.mode("overwrite").parquet(f"{a.out}/hashes")
        images.with_features(loaded, *map(images.library_extractor, a.extractor or ["color"])).write.mode("overwrite").parquet(f"{a.out}/features")
        images.load_quality(loaded).show()
        return
    rows = _vectors(spark, a.vectors)
    first = rows.first()
    if first is None:
        raise SystemExit("no vectors")
    dim = len(first["embedding"])
    config = lsh.LSHConfig(a.num_tables, a.hash_width, a.num_nodes, a.virtual_nodes)
    nodes = ring.positions(spark, a.num_nodes, a.virtual_nodes)
    if a.verb == "index":
        index = LiveIndex(spark, a.out, config, dim, nodes)
        index.build(rows)
        lsh.bucket_summary(index.postings()).orderBy("table_id").show()
        ring.summary(index.postings().where("table_id = 0"), a.num_nodes).orderBy("node_id").show()
        return
    asked = _asked(rows, a)
    if asked.isEmpty():
        raise SystemExit("no row has that id")
    if a.verb == "benchmark":
        index = LiveIndex(spark, scratch(spark, "benchmark-index"), config, dim, nodes)
        index.build(rows)
        return _benchmark(index, asked, a)
    if a.verb == "tune":
        truth = search.exact_topk(rows, asked, a.top_k, a.metric)
        found = lsh.probe(lsh.build_index(rows, config, dim, nodes), lsh.codes(asked, config, dim))
        place = F.row_number().over(W.partitionBy("query_id").orderBy("image_id"))
        _shown(evaluation.tune_candidates(found.select("query_id", "image_id", place.alias("position")), rows, asked, truth, [10, 25, 50, 100, 250, 500], a.metric), ["k"], a)
        return
    if a.exact:
        out = search.exact_topk(rows, asked, a.top_k, a.metric)
    else:
        out = lsh.search_index(lsh.build_index(rows, config, dim, nodes), rows, asked, config, dim, a.top_k, a.metric)
    if a.metadata:
        out = search.with_paths(out, matrices.read_metadata(spark, a.metadata).withColumnRenamed("index", "image_id"))
    _shown(out, ["query_id", "rank"], a, a.top_k * 10)


if __name__ == "__main__":
    main()
