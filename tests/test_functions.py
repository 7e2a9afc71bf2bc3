import numpy as np
import pytest
from pyspark.sql import functions as F

from prismark.functions import hashes, paths
from prismark.operators import align, statistics


def one(spark, column):
    return spark.range(1).select(column).first()[0]


def test_paths(spark):
    df = spark.createDataFrame([("a\\b\\c.jpg",), ("c.PNG",), ("  ",), (None,), ("/data/dew/1.jpg",)], "p string")
    p = F.col("p")
    got = df.select(paths.file_key(p), paths.folder_key(p), paths.category(p), paths.has_extension(p), paths.relative_to(p, "/data")).collect()
    assert [tuple(r) for r in got] == [
        ("c.jpg", "b/c.jpg", "b", True, "a\\b\\c.jpg"), ("c.PNG", "c.PNG", "root", True, "c.PNG"), ("invalid_path", "invalid", "root", False, "  "),
        ("invalid_path", "invalid", "root", None, None), ("1.jpg", "dew/1.jpg", "dew", True, "dew/1.jpg"),
    ]


def test_hashes(spark):
    assert one(spark, hashes.hamming(F.lit("f" * 16), F.lit("0" + "f" * 13 + "00"))) == 12
    grey = F.array(*[F.lit(float(i)) for i in range(64)])
    assert one(spark, hashes.average_hash(grey)) == "0" * 8 + "f" * 8
    nine = F.array(*[F.lit(float(i % 9)) for i in range(72)])
    assert one(spark, hashes.difference_hash(nine, 9)) == "f" * 16
    x = np.random.default_rng(0).random(1024)
    d = hashes.dct_matrix(32)
    low = (d @ x.reshape(32, 32) @ d.T)[:8, :8]
    assert one(spark, hashes.perceptual_hash(F.array(*[F.lit(float(v)) for v in x]))) == f"{int(''.join(str(int(b)) for b in (low > np.median(low)).ravel()), 2):016x}"
    assert [one(spark, hashes.distance_class(F.lit(n))) for n in (0, 9, 10, 20, 21)] == ["identical", "very similar", "somewhat similar", "somewhat similar", "different"]


@pytest.mark.parametrize("p", [0.0, 0.25, 0.5, 0.99, 1.0])
def test_percentiles(spark, p):
    x = np.concatenate([np.arange(1, 51), np.full(30, 7.0)])
    df = spark.createDataFrame([("a", float(v)) for v in x] + [("b", 1.0), ("b", None)], "g string, v double")
    name = f"p{p * 100:g}"
    linear = {r["g"]: r[name] for r in statistics.percentiles(df, "g", "v", [p]).collect()}
    nearest = {r["g"]: r[name] for r in statistics.percentiles(df, "g", "v", [p], nearest_rank=True).collect()}
    assert np.isclose(linear["a"], np.percentile(x, p * 100)) and linear["b"] == 1.0
    assert nearest["a"] == np.sort(x)[min(int(len(x) * p), len(x) - 1)]


def test_align_fans_out_and_first_of_key(spark):
    h = align.keyed(spark.createDataFrame([("x/1.jpg", "aa"), (None, "zz")], "path string, ahash string"), "path").drop("path")
    t = align.keyed(spark.createDataFrame([("d/x/1.jpg", 5), ("x\\1.jpg", 2)], "path string, trad_row_index int"), "path").drop("path")
    d = align.keyed(spark.createDataFrame([("x/1.jpg", 9)], "path string, deep_row_index int"), "path").drop("path")
    a = align.align_three_way(h, t, d)
    assert a.count() == 2
    assert align.first_of_key(a, "trad_row_index", "deep_row_index").first()["trad_row_index"] == 2
