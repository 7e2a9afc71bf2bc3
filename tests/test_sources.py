import json
import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from prismark.operators import lsh
from prismark.sources import images, matrices
from prismark.streaming.ingest import LiveIndex


def png(a):
    """A PNG file of an RGB array."""
    def chunk(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    raw = b"".join(b"\0" + row.tobytes() for row in a.astype(np.uint8))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", a.shape[1], a.shape[0], 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("images")
    for name in ("dew", "rain"):
        (d / name).mkdir()
    rng = np.random.default_rng(0)
    (d / "dew/a.png").write_bytes(png(rng.integers(0, 256, (40, 30, 3))))
    (d / "rain/b.PNG").write_bytes(png(np.full((16, 16, 3), [255, 0, 0])))
    (d / "rain/broken.png").write_bytes(b"no image")
    (d / "rain/notes.txt").write_text("no image either")
    return str(d)


def test_images(spark, folder):
    listed = images.list_images(spark, folder).collect()
    assert [r["index"] for r in listed] == [0, 1, 2] and [r["category"] for r in listed] == ["dew", "rain", "rain"]
    loaded = images.load_images(spark, folder)
    assert tuple(images.load_quality(loaded).first()) == (2, 1)
    h = {r["path"].rsplit("/", 1)[1]: r for r in images.with_hashes(loaded).collect()}
    assert set(h) == {"a.png", "b.PNG"} and all(len(h["a.png"][k]) == 16 for k in ("ahash", "dhash", "phash"))
    assert h["b.PNG"]["ahash"] == "0" * 16
    f = {r["path"].rsplit("/", 1)[1]: np.array(r["features"]) for r in images.with_features(loaded, images.library_extractor("color"), lambda a: a.mean((0, 1))).collect()}
    assert len(f["b.PNG"]) == 1027
    red = np.flatnonzero(f["b.PNG"][:512])
    assert list(red) == [7] and np.isclose(np.linalg.norm(f["a.png"][512:1024]), 1)
    assert np.allclose(f["b.PNG"][1024:], [0, 0, 255])
    with pytest.raises(ValueError):
        images.library_extractor("surf")
    assert images.mean_pooled(None, 32).tolist() == [0] * 32
    assert images.imagenet_input(np.zeros((2, 2, 3), np.uint8)).shape == (2, 2, 3)


def test_matrices(spark, tmp_path):
    m = np.random.default_rng(1).standard_normal((50, 6)).astype(np.float32)
    np.save(tmp_path / "f.npy", m)
    df = matrices.read_npy(spark, str(tmp_path / "f.npy"), partitions=4)
    assert df.rdd.getNumPartitions() == 4
    assert np.allclose([r["features"] for r in df.orderBy("row_index").collect()], m)
    assert matrices.read_npy(spark, str(tmp_path / "f.npy"), rows=7).count() == 7
    assert matrices.write_npy(df, str(tmp_path / "g.npy")) == 50 and np.allclose(np.load(tmp_path / "g.npy"), m)
    (tmp_path / "m.csv").write_text("index,image_path\n0,a/b, c.jpg\n1,d.jpg\nx,e.jpg\n")
    assert [tuple(r) for r in matrices.read_metadata(spark, str(tmp_path / "m.csv")).orderBy("index").collect()] == [(None, "x,e.jpg"), (0, "a/b, c.jpg"), (1, "d.jpg")]
    with pytest.raises(ValueError):
        matrices.write_npy(spark.createDataFrame([(0, [1.0]), (1, None)], "row_index bigint, features array<float>"), str(tmp_path / "x.npy"))
    assert matrices.write_npy(df.limit(0), str(tmp_path / "e.npy")) == 0 and np.load(tmp_path / "e.npy").shape == (0, 0)
    np.save(tmp_path / "p.npy", np.array(["x.jpg", "y.jpg"]))
    assert matrices.read_metadata(spark, str(tmp_path / "p.npy")).count() == 2
    (tmp_path / "h.json").write_text(json.dumps({"a.jpg": {"aHash": "1", "dHash": "2", "pHash": "3"}}))
    hashes = matrices.read_hash_map(spark, str(tmp_path / "h.json"))
    assert tuple(hashes.first()) == ("a.jpg", "1", "2", "3")
    matrices.write_hashes(hashes, str(tmp_path / "h"))
    assert spark.read.json(str(tmp_path / "h")).count() == 1
    a = spark.createDataFrame([("a", "1", "2", "3", 4, 5)], "image_id string, ahash string, dhash string, phash string, trad_row_index bigint, deep_row_index bigint")
    matrices.write_alignment(a, str(tmp_path / "a"))
    assert matrices.read_alignment(spark, str(tmp_path / "a")).collect() == a.collect()
    g = matrices.generate(spark, 20, 8)
    x = np.array([r["features"] for r in g.orderBy("image_id").collect()])
    assert np.allclose(np.linalg.norm(x, axis=1), 1) and np.allclose(x, [r["features"] for r in g.repartition(3).orderBy("image_id").collect()])
    matrices.write_report(spark.createDataFrame([(1, 2.0)], "k int, v double"), str(tmp_path / "r"))
    assert spark.read.json(str(tmp_path / "r")).first()["v"] == 2.0


def test_resampling():
    rng = np.random.default_rng(2)
    a = rng.integers(0, 256, (40, 30, 3)).astype(np.uint8)
    for kernel in images.KERNELS:
        for smooth in (False, True):
            for size, n in ((40, 7), (7, 40), (30, 30), (1, 5)):
                assert np.allclose(images.resampling(size, n, kernel, smooth).sum(1), 1)
            assert (images.resized(a, 40, 30, kernel, smooth) == a).all()
            assert (images.resized(np.full((9, 5, 3), 77, np.uint8), 33, 2, kernel, smooth) == 77).all()
    # halving with a wide triangle weighs 1, 3, 3, 1; plain bilinear takes the mean of the two nearest
    row = np.array([[0, 40, 80, 200]], np.uint8)
    assert images.resized(row, 1, 2, "bilinear", True).tolist() == [[round((3 * 0 + 3 * 40 + 80) / 7), round((40 + 3 * 80 + 3 * 200) / 7)]]
    assert images.resized(row, 1, 2).tolist() == [[20, 140]]
    assert images.resized(row[:, :2], 1, 4).tolist() == [[0, 10, 30, 40]]
    # a cubic kernel passes through whole places and overshoots beside them
    assert np.allclose(images.KERNELS["bicubic"][1](np.array([0.0, 1.0, 2.0, 0.5, -0.5, 1.5])), [1, 0, 0, 0.5625, 0.5625, -0.0625])
    assert images.grey(np.array([[[0, 0, 255], [255, 0, 0], [0, 255, 0], [255, 255, 255]]], np.uint8)).tolist() == [[76, 29, 150, 255]]


def test_preprocessed(spark, folder):
    got = {r["path"].rsplit("/", 1)[1]: r for r in images.preprocessed(images.load_images(spark, folder), 8).collect()}
    assert set(got) == {"a.png", "b.PNG", "broken.png"} and got["broken.png"]["pixels"] is None and got["broken.png"]["error"]
    assert len(got["a.png"]["pixels"]) == 192 and got["b.PNG"]["pixels"][:3] == [1.0, 0.0, 0.0] and all(0 <= x <= 1 for x in got["a.png"]["pixels"])


def test_model_batches(spark, folder):
    """A model is loaded once a task and gets whole batches of prepared images."""
    calls = spark.sparkContext.accumulator(0)

    def load():
        def infer(x):
            calls.add(1)
            assert x.shape[1:] == (224, 224, 3) and len(x) <= 1
            return np.stack([x.mean((1, 2, 3)), x.max((1, 2, 3))], 1)

        return infer

    images.register_backbone("means", load)
    loaded = images.load_images(spark, folder)
    got = {r["path"].rsplit("/", 1)[1]: r for r in images.with_model(loaded, "means", 1, images.normalised).collect()}
    assert set(got) == {"a.png", "b.PNG"} and np.allclose(got["b.PNG"]["features"], [1 / 3, 1]) and got["a.png"]["model_ms"] >= 0 and calls.value == 2
    for wrong in (lambda: images.with_model(loaded, "no such"), lambda: images.with_model(loaded, load, 0)):
        with pytest.raises(ValueError):
            wrong()


CONFIG = lsh.LSHConfig(num_tables=10, hash_width=8)


def vectors(spark, ids, dim=16, seed=0):
    rng = np.random.default_rng(seed)
    return spark.createDataFrame([(i, [float(x) for x in rng.standard_normal(dim)]) for i in ids], "image_id bigint, features array<float>")


def built(spark, path):
    index = LiveIndex(spark, str(path), CONFIG, 16)
    base = vectors(spark, range(40))
    index.build(base, "image_id", "features")
    return index


def test_inserts_are_checked_and_replays_add_nothing(spark, tmp_path):
    with pytest.raises(RuntimeError):
        LiveIndex(spark, str(tmp_path / "none"), CONFIG, 16).insert(vectors(spark, [1]), 0)
    index = built(spark, tmp_path / "i")
    batch = vectors(spark, [100, 101, 0, 100], seed=5).unionByName(vectors(spark, [200], dim=9)).unionByName(spark.createDataFrame([(None, [1.0] * 16), (300, None)], "image_id bigint, features array<float>"))
    for _ in range(2):
        index.insert(batch, 0)
        assert index.vectors().count() == 42 and index.postings().count() == 420
        rejected = sorted((r["outcome"], -1 if r["image_id"] is None else r["image_id"]) for r in index.rejects().collect())
        assert rejected == [("dim_mismatch", 200), ("dim_mismatch", 300), ("duplicate_id", 0), ("duplicate_id", 100), ("null_id", -1)]
    q = index.vectors().where("image_id = 101").select(F.col("image_id").alias("vec_id"), F.col("features").alias("embedding"))
    assert index.search(q, 10).orderBy("rank").first()["image_id"] == 101


def test_stream_equals_batch(spark, tmp_path):
    new = vectors(spark, list(range(35, 60)), seed=2)
    new.repartition(3).write.parquet(str(tmp_path / "in"))
    streamed, batched = built(spark, tmp_path / "s"), built(spark, tmp_path / "b")
    source = spark.readStream.schema(new.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    streamed.stream(source).awaitTermination()
    batched.insert(new, 0)
    key = lambda df: sorted(tuple(r) for r in df.collect())
    assert key(streamed.postings()) == key(batched.postings()) and streamed.vectors().count() == 60
    assert sorted(r["image_id"] for r in streamed.rejects().collect()) == list(range(35, 40))
