"""The live index under readers and writers, the query service, and the command line."""

import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from prismark import __main__ as cli
from prismark.operators import lsh, search
from prismark.sources import matrices
from prismark.streaming import serving
from prismark.streaming.ingest import LiveIndex, validated

CONFIG = lsh.LSHConfig(num_tables=6, hash_width=4)


def vectors(spark, ids, dim=16, seed=0):
    rng = np.random.default_rng(seed)
    return spark.createDataFrame([(i, [float(x) for x in rng.standard_normal(dim)]) for i in ids], "image_id bigint, features array<float>")


def built(spark, path, rows=40):
    index = LiveIndex(spark, str(path), CONFIG, 16)
    index.build(vectors(spark, range(rows)), "image_id", "features")
    return index


def queries(index, where):
    return index.vectors().where(where).select(F.col("image_id").alias("vec_id"), F.col("features").alias("embedding"))


def test_readers_while_batches_come_and_are_replayed(spark, tmp_path):
    """Every read is of whole batches: each table has a posting for each vector it also has, and no search fails."""
    index = built(spark, tmp_path / "i")
    own = [queries(index, f"image_id IN ({k}, {k + 1})").collect() for k in (0, 10, 20)]
    stop, seen, errors = threading.Event(), [], []

    def read(rows):
        try:
            while not stop.is_set():
                at = index.snapshot()
                n, p = index.vectors(at).count(), index.postings(at).count()
                assert p == n * CONFIG.num_tables and n % 10 == 0
                found = index.search(spark.createDataFrame(rows, "vec_id bigint, embedding array<float>"), 3).where("rank = 1").collect()
                assert {r["image_id"] for r in found} == {r["vec_id"] for r in rows}
                seen.append(n)
        except Exception as e:  # noqa: BLE001
            errors.append(e)

    readers = [threading.Thread(target=read, args=(rows,)) for rows in own]
    for t in readers:
        t.start()
    for number in (0, 1, 1, 2, 0):  # two are replayed
        index.insert(vectors(spark, range(100 * (number + 1), 100 * (number + 1) + 10), seed=number), number)
    stop.set()
    for t in readers:
        t.join()
    assert not errors and seen
    assert index.vectors().count() == 70 and set(dict(index.snapshot()).values()) == {1, 2}
    index.vacuum()
    assert index.vectors().count() == 70 and index.postings().count() == 70 * CONFIG.num_tables


def test_writers_side_by_side(spark, tmp_path):
    index = built(spark, tmp_path / "i")
    writers = [threading.Thread(target=lambda n=n: index.insert(vectors(spark, range(1000 * n, 1000 * n + 7), seed=n), n)) for n in (1, 2, 3)]
    for t in writers:
        t.start()
    for t in writers:
        t.join()
    assert index.vectors().count() == 61 and index.vectors().select("image_id").distinct().count() == 61


def test_a_batch_without_its_marker_does_not_count(spark, tmp_path, monkeypatch):
    index = built(spark, tmp_path / "i")
    with monkeypatch.context() as m:
        m.setattr(index, "_folder", lambda name: 1 / 0 if name.startswith("commits/") else LiveIndex._folder(index, name))
        with pytest.raises(ZeroDivisionError):
            index.insert(vectors(spark, [500, 501]), 0)
    assert index.vectors().count() == 40 and index.postings().count() == 40 * CONFIG.num_tables
    index.insert(vectors(spark, [500, 501]), 0)
    assert index.vectors().count() == 42


def test_the_duplicate_check_passes_over_other_ids(spark):
    existing = vectors(spark, range(100))
    batch = spark.createDataFrame([(None, [1.0] * 16)] * 30 + [(50, [1.0] * 16), (500, [1.0] * 16), (500, [2.0] * 16), (501, None)], "image_id bigint, features array<float>")
    got = sorted((r["image_id"] or -1, r["outcome"]) for r in validated(batch, existing, 16).collect())
    assert got == [(-1, "null_id")] * 30 + [(50, "duplicate_id"), (500, "duplicate_id"), (500, "ok"), (501, "dim_mismatch")]
    assert validated(batch.limit(0), existing, 16).count() == 0


def test_service_caches_until_an_insert(spark, tmp_path):
    index = built(spark, tmp_path / "i")
    service, asked = serving.QueryService(index, 10), queries(index, "image_id < 4")
    first = service.query(asked, 5).orderBy("query_id", "rank").collect()
    want = index.search(asked, 5).select("query_id", "rank", "image_id", "node_id").orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["rank"], r["image_id"], r["node_id"]) for r in first] == [tuple(r) for r in want]
    assert service.query(asked, 5).orderBy("query_id", "rank").collect() == first
    a, b = service.log
    assert (a.queries, a.cached, b.cached) == (4, 0, 4) and a.met >= a.candidates >= 4 and 1 <= a.nodes <= 4 and a.total_ms >= a.rerank_ms > 0 and b.candidates == 0
    assert service.query(asked, 6).count() >= len(first) and service.log[-1].cached == 0
    twin = asked.where("vec_id = 0").select(F.lit(900).cast("bigint").alias("image_id"), F.col("embedding").alias("features"))
    index.insert(twin, 0)
    again = service.query(asked.where("vec_id = 0"), 5).orderBy("rank").collect()
    assert service.log[-1].cached == 0 and {r["image_id"] for r in again[:2]} == {0, 900}
    assert service.latencies().count() == 4 and service.percentiles().first()["p50"] > 0
    assert service.query(asked.where("vec_id = 77"), 5).count() == 0
    with pytest.raises(ValueError):
        service.query(spark.range(serving.MOST + 1).select(F.col("id").alias("vec_id"), F.array(*[F.lit(0.5)] * 16).alias("embedding")), 2)


def test_stream_of_queries(spark, tmp_path):
    index = built(spark, tmp_path / "i")
    asked = queries(index, "image_id < 9")
    asked.repartition(3).write.parquet(str(tmp_path / "in"))
    service = serving.QueryService(index)
    source = spark.readStream.schema(asked.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = service.stream(source, str(tmp_path / "out"), 4)
    q.processAllAvailable()
    q.stop()
    key = lambda df: sorted((r["query_id"], r["rank"], r["image_id"]) for r in df.collect())
    assert key(spark.read.parquet(str(tmp_path / "out"))) == key(index.search(asked, 4)) and sum(s.queries for s in service.log) == 9


def test_scores_of_asked_rows(spark):
    """Re-ranking keeps other columns, drops candidates of unknown queries, and refuses other lengths."""
    df = vectors(spark, range(12)).select(F.col("image_id").alias("vec_id"), F.col("features").alias("embedding"))
    c = spark.createDataFrame([(0, 1, "x"), (0, 2, "y"), (3, 1, "z"), (99, 1, "q"), (3, 77, "w")], "query_id bigint, image_id bigint, tag string")
    m = {r["vec_id"]: np.array(r["embedding"], np.float64) for r in df.collect()}
    for metric, score in (("cosine", lambda a, b: a @ b / np.linalg.norm(a) / np.linalg.norm(b)), ("dot", lambda a, b: a @ b), ("l2", lambda a, b: -np.linalg.norm(a - b))):
        got = {(r["query_id"], r["image_id"]): r for r in search.rerank(c, df, df, metric).collect()}
        assert set(got) == {(0, 1), (0, 2), (3, 1)} and got[0, 2]["tag"] == "y"
        assert all(np.isclose(r["score"], score(m[q], m[i])) for (q, i), r in got.items())
    short = df.withColumn("embedding", F.slice("embedding", 1, 15))
    with pytest.raises(Exception, match="must have 16 elements"):
        search.rerank(c, short, df).collect()


def test_command_line(spark, tmp_path, capsys):
    path = str(tmp_path / "v.npy")
    rng = np.random.default_rng(0)
    np.save(path, rng.standard_normal((60, 8)).astype(np.float32))
    (tmp_path / "m.csv").write_text("index,image_path\n" + "".join(f"{i},a/{i}.jpg\n" for i in range(50)))
    own = ["--vectors", path, "--hash-width", "3", "--num-tables", "4"]
    cli.main(["search", *own, "--query-id", "3", "--top-k", "4", "--metadata", str(tmp_path / "m.csv"), "--out", str(tmp_path / "found")])
    found = spark.read.json(str(tmp_path / "found")).orderBy("rank").collect()
    assert found[0]["image_id"] == 3 and found[0]["image_path"] == "a/3.jpg" and len(found) == 4
    cli.main(["search", *own, "--random", "2", "--exact", "--out", str(tmp_path / "exact")])
    assert spark.read.json(str(tmp_path / "exact")).select("query_id").distinct().count() == 2
    cli.main(["tune", *own, "--out", str(tmp_path / "tuned")])
    assert spark.read.json(str(tmp_path / "tuned")).where("k = 10").count() == 1
    cli.main(["benchmark", *own, "--random", "5", "--repeat", "2", "--out", str(tmp_path / "times")])
    assert spark.read.json(str(tmp_path / "times")).where("run = 'single'").count() == 2
    assert "single queries a second" in capsys.readouterr().out
    cli.main(["index", *own, "--out", str(tmp_path / "index")])
    for wrong in (["search", *own, "--query-id", "1000"], ["search", "--vectors", path, "--metric", "x"]):
        with pytest.raises(SystemExit):
            cli.main(wrong)
