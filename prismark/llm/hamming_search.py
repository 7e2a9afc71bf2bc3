"""Exact top-k search of binary codes by incremental multi-index hashing.

A vector's code has a bit for each dimension, set where the value is above 0. Codes are cut into
segments, and the index holds every distinct code once for each segment, under the segment's number and
value. For radius 0, 1, 2, ... the queries that are still open visit the values at that distance from
their own in every segment, by one equi join on segment and value. A code is verified where it is met
first, in full. Any code not met by then differs by more than the radius in every segment; so once the
k-th verified distance is below what such a code must have, the query is proved, ties included, and
leaves. The others go on with the next radius. A round takes several radii while they are cheap together.

Segments have about the logarithm of the number of codes in bits, so a value holds few codes however
many there are. Equal codes are one entry with their k lowest ids; a value that still holds more than a
thousandth of the index, of which there are at most a thousand, is split into parts that queries visit
all. Where the values to visit outnumber the codes, which is only so far from all codes or among few of
them, what is left of the queries, a stated set, meets all codes in blocks instead.

Defined results: rows with a null vector or id are no rows and no queries; vectors of different lengths
are refused (``ValueError``); null elements and NaN count as bits that are not set; of equal distances
the lower id ranks first; repeated rows rank each, repeated queries (id and code) are one, and queries of
one id with other codes are searched each; fewer than k rows give fewer results; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce
from itertools import combinations
from math import ceil, comb, log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from prismark.llm import common

#: Queries that meet all codes at a time, where that is cheaper.
QUERIES = 1024
#: Values that a query visits in one round, if that is more than one radius.
VISITS = 512
#: Codes that a segment's value holds on average, as a power of two; bits of a segment at least and at most.
HELD, LEAST, MOST = 4, 6, 24
#: A value with more than the index's rows divided by this is split.
SPLIT = 1000


def code(vector: Column) -> Column:
    """The bits of a vector as a string of 0 and 1."""
    return F.array_join(F.transform(vector, lambda x: F.when((x > 0) & ~F.isnan(x), "1").otherwise("0")), "")


def _cuts(width: int, codes: int) -> list[int]:
    bits = min(MOST, max(LEAST, ceil(log2(max(2, codes))) - HELD))
    count = max(1, round(width / bits))
    return [width * i // count for i in range(count + 1)]


def _sum(columns: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, columns)


def classes_of(rows: DataFrame, k: int) -> DataFrame:
    """Distinct codes with their k lowest ids and the least of them: code, ids, least."""
    lowest = F.row_number().over(W.partitionBy("code").orderBy("id"))
    few = rows.select("id", "code").withColumn("r", lowest).where(F.col("r") <= k)
    classes = few.groupBy("code").agg(F.sort_array(F.collect_list("id")).alias("ids"))  # at most k ids
    return common.stored(classes.withColumn("least", F.col("ids")[0]), "hamming-codes")


class Index:
    """Distinct codes with their lowest ids, and the same once for each segment."""

    def __init__(self, classes: DataFrame, size: int, width: int, k: int, segment_bits: int | None = None):
        self.k, self.size = k, size
        self.cuts = _cuts(width, self.size) if segment_bits is None else _cuts(width, 2 ** (segment_bits + HELD))
        self.count = len(self.cuts) - 1
        self.widths = [b - a for a, b in zip(self.cuts, self.cuts[1:], strict=False)]
        self.codes = classes.select("ids", "least", *self.segments("s"))
        entries = F.array(*[F.struct(F.lit(j).alias("segment"), F.col(f"s{j}").alias("value")) for j in range(self.count)])
        table = self.codes.select(F.explode(entries).alias("e"), "*").select("e.*", "ids", "least", *self.names("s"))
        held = table.groupBy("segment", "value").agg(F.count(F.lit(1)).alias("n"))
        most = max(1, self.size * self.count // SPLIT)
        split = held.where(F.col("n") > most).select("segment", "value", F.ceil(F.col("n") / most).cast("int")).collect()  # fewer than SPLIT rows, as each has more than a thousandth of all
        self.split = classes.sparkSession.createDataFrame(split, "segment int, value int, parts int")
        parts = F.coalesce("parts", F.lit(1))
        dealt = table.join(F.broadcast(self.split), ["segment", "value"], "left").withColumn("part", F.pmod(F.xxhash64(*self.names("s")), parts).cast("int"))
        self.table = common.stored(dealt.drop("parts"), "hamming-index")

    def names(self, prefix: str) -> list[str]:
        return [f"{prefix}{j}" for j in range(self.count)]

    def segments(self, prefix: str) -> list[Column]:
        """The segments' values of the column code."""
        return [F.coalesce(F.conv(F.substring("code", a + 1, b - a), 2, 10).cast("int"), F.lit(0)).alias(n) for n, a, b in zip(self.names(prefix), self.cuts, self.cuts[1:], strict=False)]

    def apart(self) -> list[Column]:
        """The distance of query (q) and code (s) in each segment."""
        return [F.bit_count(F.col(s).bitwiseXOR(F.col(q))) for s, q in zip(self.names("s"), self.names("q"), strict=True)]

    def visits(self, radius: int) -> int:
        """Values that a query visits at a radius."""
        return sum(comb(w, radius) for w in self.widths)

    def met(self, queries: DataFrame, radii: range) -> DataFrame:
        """Codes that queries (query_id, q..., bound) meet first at these radii, with their distances."""
        masks = [(j, sum(1 << i for i in c)) for r in radii for j, w in enumerate(self.widths) for c in combinations(range(w), r)]
        masks = queries.sparkSession.createDataFrame(masks, "segment int, mask int")  # fewer than there are codes, and than 2 ** MOST a segment
        own = F.array(*[F.struct(F.lit(j).alias("segment"), F.col(f"q{j}").alias("own")) for j in range(self.count)])
        probes = queries.select(F.explode(own).alias("e"), "*").select("e.*", "query_id", "bound", *self.names("q")).join(F.broadcast(masks), "segment")
        probes = probes.select("segment", F.col("own").bitwiseXOR(F.col("mask")).alias("value"), F.bit_count("mask").alias("radius"), "query_id", "bound", *self.names("q"))
        parts = F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("part")
        probes = probes.join(F.broadcast(self.split), ["segment", "value"], "left").select("segment", "value", parts, "radius", "query_id", "bound", *self.names("q"))
        both = probes.join(self.table, ["segment", "value", "part"])
        # no lesser radius met it, and at this one no earlier segment
        radius = F.col("radius")
        first = reduce(lambda a, b: a & b, [(d > radius) | ((d == radius) & (F.col("segment") <= j)) for j, d in enumerate(self.apart())])
        found = both.where(first).withColumn("distance", _sum(self.apart()).cast("bigint"))
        return found.where("bound IS NULL OR distance <= bound").select("query_id", *self.names("q"), "ids", "least", "distance")

    def all(self, queries: DataFrame, each: int) -> DataFrame:
        """All codes with their distances from all queries (query_id, q...), in blocks of queries."""
        blocks = max(1, ceil(queries.count() / each))
        block = F.pmod(F.xxhash64("query_id", *self.names("q")), F.lit(blocks))
        out = []
        for i in range(blocks):
            own = queries.select("query_id", *self.names("q")).where(block == i)  # about ``each`` rows
            met = self.codes.crossJoin(F.broadcast(own)).withColumn("distance", _sum(self.apart()).cast("bigint"))
            out.append(self.nearest(met.select("query_id", *self.names("q"), "ids", "least", "distance")))
        return reduce(DataFrame.unionByName, out)

    def nearest(self, met: DataFrame) -> DataFrame:
        """Of each query the k nearest ids among codes: query_id, q..., id, distance."""
        query = W.partitionBy("query_id", *self.names("q"))
        # an id among the k nearest has a code among the k nearest by distance and least id
        codes = met.withColumn("r", F.row_number().over(query.orderBy("distance", "least"))).where(F.col("r") <= self.k)
        ids = codes.select("query_id", *self.names("q"), F.explode("ids").alias("id"), "distance")
        return ids.withColumn("rank", F.row_number().over(query.orderBy("distance", "id"))).where(F.col("rank") <= self.k).drop("rank")


def top_k(rows: DataFrame, queries: DataFrame, k: int = 10, segment_bits: int | None = None, queries_per_block: int = QUERIES) -> DataFrame:
    """rows and queries: id, code. Returns query_id, rank, id, distance for each query."""
    spark = rows.sparkSession
    rows, queries = (df.where("id IS NOT NULL AND code IS NOT NULL") for df in (rows, queries))
    classes = classes_of(rows, k)
    own = classes.select("code", F.lit(1).alias("n")).unionByName(queries.select("code", F.lit(0).alias("n")))
    seen = own.agg(F.min(F.length("code")).alias("width"), F.max(F.length("code")).alias("most"), F.sum("n").alias("codes")).first()
    if not seen["codes"]:
        return spark.createDataFrame([], "query_id bigint, rank int, id bigint, distance bigint")
    if seen["width"] < seen["most"]:
        raise ValueError(f"codes of {seen['width']} and of {seen['most']} bits cannot be compared")
    index = Index(classes, seen["codes"], seen["width"], k, segment_bits)
    q = index.names("q")
    query = W.partitionBy("query_id", *q)
    left = common.stored(queries.select(F.col("id").alias("query_id"), "code").distinct().select("query_id", *index.segments("q"), F.lit(None).cast("bigint").alias("bound")), "hamming-queries")
    best, done, radius, most = None, [], 0, max(index.widths)
    while radius <= most:
        if index.visits(radius) >= index.size:
            done.append(index.all(left, queries_per_block))
            break
        last = radius
        while last < most and index.visits(last + 1) < index.size and sum(map(index.visits, range(radius, last + 2))) <= VISITS:
            last += 1
        found = index.nearest(index.met(left, range(radius, last + 1)))
        radius = last + 1
        if best is not None:
            both = best.unionByName(found)
            found = both.withColumn("rank", F.row_number().over(query.orderBy("distance", "id"))).where(F.col("rank") <= k).drop("rank")
        best = common.stored(found, "hamming-best")
        # a code that is not met differs by the next radius or more in every segment
        kth = best.groupBy("query_id", *q).agg(F.count(F.lit(1)).alias("n"), F.max("distance").alias("kth")).where(F.col("n") == k)
        proved = kth.where(F.col("kth") < index.count * radius)
        done.append(best.join(proved.select("query_id", *q), ["query_id", *q], "left_semi"))
        left = left.drop("bound").join(proved, ["query_id", *q], "left_anti").join(kth.select("query_id", *q, F.col("kth").alias("bound")), ["query_id", *q], "left")
        left = common.stored(left, "hamming-queries")
        if left.isEmpty():
            break
        best = best.join(left.select("query_id", *q), ["query_id", *q], "left_semi")
    else:  # every code is met, but there are fewer than k rows
        done.append(best)
    ranked = reduce(DataFrame.unionByName, done).withColumn("rank", F.row_number().over(query.orderBy("distance", "id")))
    return ranked.select("query_id", "rank", "id", "distance")


def op8_hamming_topk(spark, sf_dir: str) -> DataFrame:
    own = common.table(spark, sf_dir, "embeddings").where("vec_id IS NOT NULL AND embedding IS NOT NULL")
    rows = own.select(F.col("vec_id").alias("id"), code(F.col("embedding")).alias("code"))
    found = top_k(rows, rows.where("id % 20 = 0"), 10)
    return found.select("query_id", F.col("rank").cast("bigint").alias("rank"), F.col("id").alias("vec_id"), F.col("distance").alias("hamming"))


OP8_SQL = """
WITH c AS (SELECT vec_id, list_transform(embedding, lambda x: CASE WHEN x > 0 AND NOT isnan(x) THEN 1 ELSE 0 END) AS b FROM embeddings WHERE embedding IS NOT NULL AND vec_id IS NOT NULL),
q AS (SELECT DISTINCT vec_id, b FROM c WHERE vec_id % 20 = 0),
d AS (SELECT q.vec_id AS query_id, q.b, r.vec_id, list_sum(list_transform(list_zip(q.b, r.b), lambda z: abs(z[1] - z[2])))::BIGINT AS hamming FROM q, c r),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id, b ORDER BY hamming, vec_id) AS rank FROM d)
SELECT query_id, rank, vec_id, hamming FROM k WHERE rank <= 10
"""
