"""The folder that driver and executors share, and tables written there to cut lineage."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: list[tuple[SparkSession, str]] = []


def shared_root(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session. Where there is none, a folder is made in local mode, as in tests; on a cluster executors could not read it, so it is refused."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="prismark-")
        spark.conf.set("spark.checkpoint.dir", root)
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def scratch(spark: SparkSession, what: str) -> str:
    """A new folder name under the shared root; it is removed when the driver ends."""
    path = f"{shared_root(spark)}/prismark/{what}-{uuid.uuid4().hex[:12]}"
    if not _made:
        atexit.register(_clean)
    _made.append((spark, path))
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder through Spark's own file system layer."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def _clean() -> None:
    for spark, path in _made:
        if spark.sparkContext._jsc is not None:
            remove(spark, path)


def stored(df: DataFrame, what: str, path: str | None = None) -> DataFrame:
    """Writes df to the shared folder and reads it back, so a lost executor costs no recomputation."""
    path = path or scratch(df.sparkSession, what)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
