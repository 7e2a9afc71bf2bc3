"""Ships the package to the executors' Python workers."""

from __future__ import annotations

import functools
import tempfile
import weakref
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: weakref.WeakSet = weakref.WeakSet()


def ship(spark: SparkSession) -> None:
    """Sends this package to all workers, once per context; Spark's own file server carries it."""
    sc = spark.sparkContext
    if sc in _shipped:
        return
    root = Path(__file__).resolve().parents[2]
    target = Path(tempfile.mkdtemp(prefix="prismark-")) / "prismark.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted((root / "prismark").rglob("*.py")):
            z.write(p, p.relative_to(root))
    sc.addPyFile(str(target))
    _shipped.add(sc)


def shipped(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    @functools.wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return query(spark, sf_dir)

    return run
