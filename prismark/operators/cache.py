"""Query result cache, and replay of an LRU cache over a request log."""

from __future__ import annotations

import threading
from collections import OrderedDict

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from prismark.plans.storage import stored


def cache_key(vector: Column, k: int, metric: str = "cosine", index_version: str = "") -> Column:
    """Key of a query: its vector to four digits, and all that the answer depends on."""
    digits = F.array_join(F.transform(vector, lambda x: (F.round(x.cast("double"), 4) + F.lit(0.0)).cast("string")), ",")
    return F.md5(F.concat_ws("|", digits, F.lit(str(k)), F.lit(metric), F.lit(index_version)).cast("binary"))


class ResultCache:
    """Collected results of queries on the driver, the least recently used dropped beyond capacity."""

    def __init__(self, capacity: int = 100):
        self.capacity, self.hits, self.misses = capacity, 0, 0
        self._kept: OrderedDict = OrderedDict()
        self._lock = threading.Lock()

    def get(self, key):
        with self._lock:
            if key not in self._kept:
                self.misses += 1
                return None
            self.hits += 1
            self._kept.move_to_end(key)
            return self._kept[key]

    def put(self, key, results) -> None:
        with self._lock:
            self._kept[key] = results
            self._kept.move_to_end(key)
            if len(self._kept) > self.capacity:
                self._kept.popitem(last=False)

    def clear(self) -> None:
        """Called when the index gets new rows."""
        with self._lock:
            self._kept.clear()

    @property
    def hit_rate(self) -> float:
        asked = self.hits + self.misses
        return self.hits / asked if asked else 0.0


#: Chunks whose summaries are read together.
FAN = 256


def _begins(recent: DataFrame, capacity: int) -> DataFrame:
    """The state (chunk, held: keys, oldest use first) that each chunk begins with, from its own last keys (chunk, key, last).

    Chunks are gathered ``FAN`` to a group, groups are summed up like chunks, and the states that the
    groups begin with, found the same way, are carried through their chunks, all groups side by side.
    """
    recent = stored(recent, "cache-states")
    ends = recent.agg(F.min("chunk").alias("a"), F.max("chunk").alias("b")).first()
    grouped = recent.withColumn("group", F.floor(F.col("chunk") / FAN))
    if ends["a"] is None or ends["a"] // FAN == ends["b"] // FAN:
        each = grouped.withColumn("held", F.array().cast("array<string>"))
    else:
        last = grouped.groupBy(F.col("group").alias("chunk"), "key").agg(F.max("last").alias("last"))
        rank = F.row_number().over(W.partitionBy("chunk").orderBy(F.desc("last")))
        groups = _begins(last.withColumn("r", rank).where(F.col("r") <= capacity).drop("r"), capacity)
        each = grouped.join(groups.withColumnRenamed("chunk", "group"), "group")

    def carry(b: pd.DataFrame) -> pd.DataFrame:
        state, out = OrderedDict.fromkeys(b["held"].iloc[0]), []
        for chunk, own in b.sort_values("last").groupby("chunk", sort=True):
            out.append((chunk, list(state)))
            for key in own["key"]:
                state.pop(key, None)
                state[key] = None
            while len(state) > capacity:
                state.popitem(last=False)
        return pd.DataFrame(out, columns=["chunk", "held"])

    # a group has at most FAN * capacity rows
    return each.groupBy("group").applyInPandas(carry, "chunk bigint, held array<string>")


def lru_replay(requests: DataFrame, capacity: int, seq: str = "seq", key: str = "key", chunk: int = 100_000) -> DataFrame:
    """requests (seq, key) with hit: whether an LRU cache that stores every miss holds the key.

    A replay needs no more from the past than the last ``capacity`` distinct keys. Chunks of the log are
    summed up to those, and then all chunks are replayed side by side, each from the state it begins with
    (``_begins``). Only counts reach the driver.
    """
    own = requests.select(F.col(seq).cast("bigint").alias("seq"), F.col(key).cast("string").alias("key")).where("seq IS NOT NULL")
    own = stored(own.withColumn("chunk", F.floor(F.col("seq") / chunk)), "requests")
    last = own.groupBy("chunk", "key").agg(F.max("seq").alias("last"))
    rank = F.row_number().over(W.partitionBy("chunk").orderBy(F.desc("last")))
    recent = last.withColumn("r", rank).where(F.col("r") <= capacity).drop("r")
    begins = _begins(recent, capacity)

    def run(b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values("seq")
        kept = OrderedDict.fromkeys(b["held"].iloc[0])
        hits = []
        for k in b["key"]:
            hits.append(k in kept)
            kept.pop(k, None)
            kept[k] = None
            if len(kept) > capacity:
                kept.popitem(last=False)
        return pd.DataFrame({"seq": b["seq"], "key": b["key"], "hit": hits})

    return own.join(begins, "chunk").groupBy("chunk").applyInPandas(run, "seq bigint, key string, hit boolean")


def hit_rate(replayed: DataFrame) -> DataFrame:
    hits = F.sum(F.col("hit").cast("bigint"))
    return replayed.agg(F.count(F.lit(1)).alias("requests"), hits.alias("hits"), (hits / F.count(F.lit(1))).alias("hit_rate"))
