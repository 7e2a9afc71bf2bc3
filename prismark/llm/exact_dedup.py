"""Exact deduplication by stateful streaming (native: DataFrame operations only).

A header (digest, identifier, locator) of every row streams through an aggregation keyed by digest
whose state lives in RocksDB and has no expiry: per digest it retains the identifier that stays, the
locator of its content and the number of rows. Rows that hit an existing digest are then checked on
their full bytes against the content at the retained locator; rows that share a digest but not the
bytes are grouped anew by their bytes.

With a ``state`` folder the keyed state outlives the call: contents, headers, the stream's checkpoint and
its results stay there, and the next call's rows are checked against all that earlier calls brought. A
call that broke off is made good by the next one, as headers wait in the folder until the stream has read
them. Without a folder the state lasts for the call.

Groups may be large: their rows are dealt out to many tasks, and so is, in copies, the content that the
rows of a group are checked against, one copy for ``SALT`` rows.

Defined results: null text counts as empty text; of equal texts the row with the largest id stays,
null ids last, ties (repeated rows) by the later locator; an empty table gives an empty result; other
columns are ignored whatever their names are. A row that an earlier call kept is replaced where a later
call brings an equal text with a larger id; its group's rows of the later call name the id that stays.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prismark.llm import common

#: RocksDB's memory is bounded for all partitions of an executor together. Its files are not allocated ahead of use: many small stores would hold disk that they never fill.
STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "64",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
    "spark.sql.streaming.metricsEnabled": "false",
    "spark.sql.streaming.stateStore.maintenanceInterval": "5s",  # so soon after a stream ends its stores are closed
}
#: Rows of a group that one copy of its content is checked against.
SALT = 1000
HEADERS = "digest string, sort_id boolean, id bigint, at_file string, at_row bigint, call string"


def normalised(text: Column) -> Column:
    return common.ascii_lower(F.coalesce(text, F.lit("")))


def keyed_state(headers: DataFrame, path: str, folder: str, files_per_batch: int | None = None) -> DataFrame:
    """Streams the header table at ``path``, as far as that is not done, through the keyed state in ``folder``; one row per digest.

    ``files_per_batch`` bounds a micro-batch; any number gives the same result, because what a later
    batch emits for a digest replaces what an earlier one emitted.
    """
    spark, out = headers.sparkSession, f"{folder}/digests"
    before = {k: spark.conf.get(k, None) for k in STATE_CONF}
    for k, v in STATE_CONF.items():
        spark.conf.set(k, v)
    try:
        stream = spark.readStream.schema(headers.schema)
        if files_per_batch:
            stream = stream.option("maxFilesPerTrigger", files_per_batch)
        state = (
            stream.parquet(path)
            .groupBy("digest")
            .agg(F.max(F.struct("sort_id", "id", "at_file", "at_row")).alias("top"), F.count(F.lit(1)).alias("group_size"))
        )

        def emit(batch: DataFrame, number: int) -> None:
            batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

        query = state.writeStream.outputMode("update").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).foreachBatch(emit).start()
        query.awaitTermination()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    schema = "digest string, top struct<sort_id:boolean,id:bigint,at_file:string,at_row:bigint>, group_size bigint, batch bigint"
    seen = spark.read.schema(schema).option("basePath", out).parquet(out)
    if seen.select("batch").distinct().count() > 1:
        seen = seen.groupBy("digest").agg(F.max_by(F.struct("top", "group_size"), "batch").alias("s")).select("digest", "s.*")
    return seen.select("digest", "top", "group_size")


def decide(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    digest: Callable[[Column], Column] = lambda t: F.sha2(t, 256),
    files_per_batch: int | None = None,
    state: str | None = None,
) -> DataFrame:
    """One row per row of docs: id, keep_id, group_size, kept, digest, and its locator (at_file, at_row; in docs or, with a state folder, in its contents)."""
    spark = docs.sparkSession
    text, i = normalised(F.col(text_column)), F.col(id_column).cast("bigint")
    call, folder = uuid.uuid4().hex, state or common.scratch(spark, "dedup-state")
    path = f"{folder}/headers"
    if state:
        kept = docs.select(i.alias("id"), text.alias("bytes"), F.lit(call).alias("call"))
        kept.write.mode("append").option("compression", "zstd").parquet(f"{folder}/contents")
        contents = spark.read.schema("id bigint, bytes string, call string").parquet(f"{folder}/contents")
        rows, content, i, text = contents.where(F.col("call") == call), contents, F.col("id"), F.col("bytes")
    else:
        rows = content = common.plain(docs)
    own_headers = common.located(rows, [digest(text).alias("digest"), i.isNotNull().alias("sort_id"), i.alias("id"), F.lit(call).alias("call")])
    own_headers.write.mode("append").parquet(path)
    headers = spark.read.schema(HEADERS).parquet(path)
    mine = headers.where(F.col("call") == call)
    if not headers.take(1):
        return spark.createDataFrame([], "id bigint, keep_id bigint, group_size bigint, kept boolean, digest string, at_file string, at_row bigint")
    groups = keyed_state(headers, path, folder, files_per_batch)

    joined = common.heavy_join(headers, groups, "digest", "group_size", headers.count(), ["at_file", "at_row"])
    own = (F.col("at_file") == F.col("top.at_file")) & (F.col("at_row") == F.col("top.at_row"))
    alone = joined.where((F.col("group_size") == 1) & (F.col("call") == call))
    alone = alone.select("id", F.col("id").alias("keep_id"), "group_size", F.lit(True).alias("kept"), "digest", "at_file", "at_row")

    # hits: fetch the full bytes of the row and of the content at the retained locator
    hits = joined.where("group_size > 1").select("digest", "id", "sort_id", "at_file", "at_row", F.col("top.id").alias("keep_id"), "group_size", own.alias("own"), (F.col("call") == call).alias("mine"))
    if state:  # groups that this call's rows are in
        hits = hits.join(mine.select("digest").distinct(), "digest", "left_semi")
    content = common.located(content, [text.alias("bytes")])
    hits = common.stored(common.at_locators(content, common.stored(hits, "dedup-hit-headers")), "dedup-hits")
    parts = F.ceil(F.col("group_size") / SALT)
    copies = F.explode(F.sequence(F.lit(0).cast("bigint"), parts - 1)).alias("part")
    first = hits.where("own").select("digest", copies, F.col("bytes").alias("state_bytes"))
    same = F.col("bytes") == F.col("state_bytes")
    dealt = hits.withColumn("part", F.pmod(F.xxhash64("at_file", "at_row"), parts))
    checked = dealt.join(first, ["digest", "part"]).withColumn("same", same).withColumn("bytes", F.when(~same, F.col("bytes"))).drop("state_bytes")
    checked = common.stored(checked, "dedup-checked")
    verdicts = checked.where("NOT same").groupBy("digest").agg(F.count(F.lit(1)).alias("differ"), F.max("group_size").alias("group_size"))
    hits = checked.join(verdicts.select("digest", copies, "differ"), ["digest", "part"], "left").withColumn("differ", F.coalesce("differ", F.lit(0)))
    equal = hits.where("same AND mine").select(
        "id", "keep_id", (F.col("group_size") - F.col("differ")).alias("group_size"), F.col("own").alias("kept"), "digest", "at_file", "at_row"
    )
    # rows whose bytes differ from the retained content's: grouped by their bytes
    rest = hits.where("not same").select("digest", "bytes", "id", "sort_id", "at_file", "at_row", "mine")
    tops = rest.groupBy("digest", "bytes").agg(F.max(F.struct("sort_id", "id", "at_file", "at_row")).alias("top"), F.count(F.lit(1)).alias("group_size"))
    rest = rest.where("mine").join(tops, ["digest", "bytes"]).select("id", F.col("top.id").alias("keep_id"), "group_size", own.alias("kept"), "digest", "at_file", "at_row")
    return alone.unionByName(equal).unionByName(rest)


def deduplicate(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """docs, with all their columns, without the rows that an equal text with a larger id replaces."""
    docs = common.plain(docs)
    dropped = decide(docs, id_column, text_column).where("NOT kept").select("at_file", "at_row")
    return common.without(docs, common.stored(dropped, "dedup-dropped"))


def op2_exact_dedup(spark, sf_dir: str) -> DataFrame:
    d = decide(common.table(spark, sf_dir, "documents"))
    return d.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


OP2_SQL = """
WITH n AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id AS kept, sha256(n.t) AS text_sha256 FROM n JOIN g USING (t)
"""
