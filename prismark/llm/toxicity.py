"""Toxicity: class-conditional Kneser-Ney models over the letters of words.

Two interpolated Kneser-Ney models, toxic and ordinary, keep their own counts at the highest order;
below it both back off to one set of continuation counts gathered from all training words, so a rare
expression gets the same backed-off probability from either model and moves the score only as far as
a class has really seen its letters. A word's evidence is its toxic log-likelihood less its ordinary
one; a text's is the sum over its words divided by its length in words, so the two likelihoods are
compared normalised by length, and ordinary words speak against a text as toxic ones speak for it. Two
samples of one language differ by a few nats on any word, which in sum would hide a few toxic
expressions; so evidence is shrunk by a tolerance, on both sides alike, before it is summed. At
tolerance 0 the comparison is the plain one. A logistic curve maps the result to 0..1; curve and
tolerance are fitted on held-back labelled rows, by their loss.

Training reads at most ``max_per_class`` labelled rows of each class, the ones whose ids hash lowest
(the documented bound of the classifier's sample); scoring reads every whole text.

Defined results: null and empty texts, and texts without letters, have no evidence and so the curve's
value at 0; without labelled rows of both classes every score is 0; labels that are neither
0 nor 1 are ignored, of repeated labels of an id the largest counts; rows with a null id are scored
and never train; repeated rows are each scored; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prismark.llm import common

WORD = re.compile(r"[^\W\d_]+")
ORDER, DISCOUNT = 5, 0.75
THRESHOLD = 0.3
#: Words longer than this are read in pieces of this length, so that one text without spaces needs no more memory.
PIECE = 64
CACHE = 200_000
#: Words that are taken apart together.
WORDS = 20_000
#: Nats of a word's evidence that chance explains; the fit picks one of them.
TOLERANCES = (0.0, 1.0, 2.0, 3.0, 4.0, 5.0)
_STEP, _WRAP = 0x9E3779B97F4A7C15, (1 << 64) - 1


def words_of(text: str | None) -> list[str]:
    found = WORD.findall(text.lower()) if text else []
    if any(len(w) > PIECE for w in found):
        found = [w[i : i + PIECE] for w in found for i in range(0, len(w), PIECE)]
    return found


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x.astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def grams(words: list[str], order: int) -> tuple[np.ndarray, Iterator[tuple[np.ndarray, np.ndarray]]]:
    """For each letter and each word's end, the word's number; and for each length up to order the hashes of the
    grams that end there and of their contexts. One length at a time is in memory."""
    lengths = np.fromiter(map(len, words), np.int32, len(words)) + order
    joined = "".join(["\x02" * (order - 1) + w + "\x03" for w in words])
    codes = _mixed(np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32))
    owner = np.repeat(np.arange(len(words), dtype=np.int32), lengths)
    at = np.arange(len(codes)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    place = np.flatnonzero(at >= order - 1)
    del at, joined

    def lengthening() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        power, hashed, context = 1, np.zeros(len(codes), np.uint64), np.zeros(len(place), np.uint64)
        for n in range(order):
            hashed[n:] += codes[: len(codes) - n] * np.uint64(power)
            power = power * _STEP & _WRAP
            yield hashed[place], context
            context = hashed[place - 1]

    return owner[place], lengthening()


class Table:
    """Values by 64-bit hash: sorted hashes with an index over their leading bits, about one hash to an index entry."""

    def __init__(self, keys: np.ndarray, *values: np.ndarray):
        self.keys, self.values = keys, values
        self.shift = np.uint64(64 - max(1, int(len(keys)).bit_length()))
        buckets = np.arange((1 << (64 - int(self.shift))) + 1, dtype=np.float64) * float(1 << int(self.shift))
        self.starts = np.append(np.searchsorted(keys, buckets[:-1].astype(np.uint64)), len(keys)).astype(np.int32)

    def __call__(self, wanted: np.ndarray) -> list[np.ndarray]:
        """Of each wanted hash its values, 0 where it is unknown."""
        if not len(self.keys):
            return [np.zeros(len(wanted)) for _ in self.values]
        bucket = (wanted >> self.shift).astype(np.int64)
        at, end = self.starts[bucket], self.starts[bucket + 1]
        found = np.full(len(wanted), -1, np.int64)
        open_ = np.flatnonzero(at < end)
        while len(open_):
            i = at[open_]
            hit = self.keys[i] == wanted[open_]
            found[open_[hit]] = i[hit]
            open_ = open_[~hit]
            at[open_] += 1
            open_ = open_[at[open_] < end[open_]]
        return [np.where(found >= 0, v[found], 0).astype(np.float64) for v in self.values]


@dataclass
class Counts:
    """One order: the weight of each gram, and of each context the weight and the number of kinds that follow it."""

    grams: Table
    contexts: Table

    @classmethod
    def of(cls, keys: np.ndarray, contexts: np.ndarray, weights: np.ndarray) -> Counts:
        """From grams, each with its context and weight; a gram may occur more than once."""
        u, first, back = np.unique(keys, return_index=True, return_inverse=True)
        n = np.bincount(back, weights, len(u))
        c, where = np.unique(contexts[first], return_inverse=True)
        total, kinds = np.bincount(where, n, len(c)), np.bincount(where, minlength=len(c))
        return cls(Table(u, n.astype(np.float32)), Table(c, total.astype(np.float32), kinds.astype(np.float32)))

    def smoothed(self, keys: np.ndarray, contexts: np.ndarray, below: np.ndarray) -> np.ndarray:
        (n,), (total, kinds) = self.grams(keys), self.contexts(contexts)
        seen = total > 0
        return np.where(seen, (np.maximum(n - DISCOUNT, 0) + DISCOUNT * kinds * below) / np.where(seen, total, 1), below)


@dataclass
class Model:
    shared: list[Counts]
    toxic: Counts
    ordinary: Counts
    tolerance: float = 4.0
    slope: float = 1.0
    intercept: float = 0.0
    _sent: Broadcast | None = None

    def sent(self, spark: SparkSession) -> Broadcast:
        """The counts, sent to the workers once; tolerance and curve are not theirs."""
        if self._sent is None:
            self._sent = spark.sparkContext.broadcast(self)
            common.release()
        return self._sent

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_sent": None}

    @classmethod
    def trained(cls, words: list[str], toxic: np.ndarray, ordinary: np.ndarray) -> Model:
        """From distinct words with their counts in toxic and in ordinary texts. So many words at a time are taken apart as memory should hold; what they have in common is then summed."""
        levels: list[list[tuple[np.ndarray, ...]]] = [[] for _ in range(ORDER)]
        for at in range(0, len(words), WORDS):
            owner, lengthening = grams(words[at : at + WORDS], ORDER)
            before = None
            for n, (keys, contexts) in enumerate(lengthening):
                if before is not None:  # grams of n letters count once for each gram of n + 1 letters that ends in them
                    u, first = np.unique(keys, return_index=True)
                    levels[n - 1].append((u, before[0][first], before[1][first]))
                before = keys, contexts
            u, first, back = np.unique(keys, return_index=True, return_inverse=True)
            levels[-1].append((u, contexts[first], *(np.bincount(back, np.asarray(w[at : at + WORDS], np.float64)[owner], len(u)) for w in (toxic, ordinary))))
        shared = []
        for parts in levels[:-1]:
            longer, keys, contexts = (np.concatenate(x) for x in zip(*parts, strict=True))
            _, first = np.unique(longer, return_index=True)
            shared.append(Counts.of(keys[first], contexts[first], np.ones(len(first))))
            parts.clear()
        keys, contexts, *weights = (np.concatenate(x) for x in zip(*levels[-1], strict=True))
        return cls(shared, *(Counts.of(keys[w > 0], contexts[w > 0], w[w > 0]) for w in weights))

    def words(self, words: list[str]) -> np.ndarray:
        """Log-likelihoods of each word: columns toxic, ordinary."""
        if not words:
            return np.zeros((0, 2))
        owner, lengthening = grams(words, ORDER)
        below = np.full(len(owner), 1 / (len(self.shared[0].grams.keys) + 1))
        for counts in self.shared:
            below = counts.smoothed(*next(lengthening), below)
        top = next(lengthening)
        return np.stack([np.bincount(owner, np.log(c.smoothed(*top, below)), len(words)) for c in (self.toxic, self.ordinary)], 1)


class Scorer:
    """Scores texts; remembers words, up to a bound."""

    def __init__(self, model: Model):
        self.model = model
        self.known: dict[str, int] = {}
        self.evidence = np.zeros(0)

    def compared(self, texts: list[str | None], tolerances: tuple[float, ...]) -> np.ndarray:
        """A row per text: for each tolerance, the evidence per word, each word's shrunk by it."""
        out = np.zeros((len(texts), len(tolerances)))
        lists = [words_of(t) for t in texts]
        fresh = list(set().union(*lists).difference(self.known))
        if len(self.known) + len(fresh) > CACHE:
            self.known, self.evidence = {}, np.zeros(0)
            fresh = list(set().union(*lists))
        self.known.update(zip(fresh, range(len(self.known), len(self.known) + len(fresh)), strict=True))
        new = [self.model.words(fresh[i : i + 20_000]) for i in range(0, len(fresh), 20_000)]
        self.evidence = np.concatenate([self.evidence, *(x[:, 0] - x[:, 1] for x in new)])
        get = self.known.__getitem__
        for k, words in enumerate(lists):
            if words:
                own = self.evidence[np.fromiter(map(get, words), np.int64, len(words))]
                for i, t in enumerate(tolerances):
                    out[k, i] = (own - np.clip(own, -t, t)).sum() / len(words)
        return out


def fitted_curve(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[float, float]:
    """Weighted logistic regression on one standardised feature, by Newton's method with a small ridge."""
    mean, spread = np.average(x, weights=w), x.std() or 1.0
    a = np.stack([(x - mean) / spread, np.ones(len(x))], 1)
    b = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ b, -30, 30)))
        h = (a * (w * p * (1 - p))[:, None]).T @ a + np.diag([1e-2, 1e-6])
        step = np.linalg.solve(h, a.T @ (w * (y - p)) - np.array([1e-2, 1e-6]) * b)
        b = b + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return float(b[0] / spread), float(b[1] - b[0] * mean / spread)


def _batches(texts: pd.Series) -> Iterator[pd.Series]:
    """Parts of a batch with about a million letters each: texts may be very long."""
    size = texts.str.len().fillna(0).cumsum() // 1_000_000
    for _, part in texts.groupby(size.to_numpy(), sort=True):
        yield part


def train(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", max_per_class: int = 2000) -> Model | None:
    """Fits both models and the curve; None without rows of both classes."""
    own = labels.where("toxic IN (0, 1) AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    own = own.where("crc32(cast(doc_id AS string)) % 4 != 2").withColumn("h", F.xxhash64("doc_id"))
    parts = [own.where(F.col("toxic") == c).orderBy("h", "doc_id").limit(max_per_class) for c in (1, 0)]
    sizes = {r["toxic"]: r["n"] for r in own.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if len(sizes) < 2:
        return None
    # at most 2 * max_per_class rows of three numbers
    sample = parts[0].unionByName(parts[1]).select(F.col("doc_id").alias("__id"), "toxic", (F.pmod(F.shiftright("h", 7), F.lit(4)) == 0).alias("held"))
    texts = docs.select(F.col(id_column).cast("bigint").alias("__id"), F.col(text_column).alias("text")).join(F.broadcast(sample), "__id")
    texts = common.stored(texts.select("__id", "text", "toxic", "held"), "toxic-sample")

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n = (Counter(), Counter())
        for b in batches:
            for text, toxic in zip(b["text"], b["toxic"], strict=True):
                n[toxic].update(words_of(text))
        for toxic in (0, 1):
            if n[toxic]:
                yield pd.DataFrame({"word": list(n[toxic]), "toxic": toxic, "n": list(n[toxic].values())})

    counts = (
        texts.where("not held").select("text", "toxic").mapInPandas(counted, "word string, toxic int, n bigint")
        .groupBy("word").agg(F.sum(F.expr("if(toxic = 1, n, 0)")).alias("toxic"), F.sum(F.expr("if(toxic = 0, n, 0)")).alias("ordinary"))
        .toPandas().sort_values("word")
    )
    if not len(counts) or not counts["toxic"].any() or not counts["ordinary"].any():
        return None
    model = Model.trained(counts["word"].tolist(), counts["toxic"].to_numpy(), counts["ordinary"].to_numpy())
    del counts
    common.release()
    held = texts.where("held").select("toxic", evidence(F.col("text"), model, TOLERANCES).alias("x")).toPandas().sort_values("toxic")
    if held["toxic"].nunique() == 2:
        weight = held["toxic"].map({c: n / min(n, max_per_class) for c, n in sizes.items()}).to_numpy(np.float64)
        x, y = np.stack(held["x"].tolist()), held["toxic"].to_numpy(np.float64)
        curves = [fitted_curve(x[:, i], y, weight) for i in range(len(TOLERANCES))]
        z = [np.clip(a * x[:, i] + b, -30, 30) for i, (a, b) in enumerate(curves)]
        loss = [np.average(np.logaddexp(0, v) - y * v, weights=weight) for v in z]
        best = int(np.argmin(loss))
        model.tolerance, (model.slope, model.intercept) = TOLERANCES[best], curves[best]
    return model


def evidence(text: Column, model: Model, tolerances: tuple[float, ...]) -> Column:
    """An array with, for each tolerance, the text's evidence per word."""
    spark = SparkSession.getActiveSession()
    common.small_batches(spark)
    sent = model.sent(spark)

    @F.pandas_udf(T.ArrayType(T.DoubleType()))
    def compared(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = common.worker_kept(("toxicity", id(sent.value)), lambda: Scorer(sent.value))
        for texts in batches:
            yield pd.Series([list(x) for part in _batches(texts) for x in scorer.compared(part.where(part.notna(), None).tolist(), tolerances)], dtype=object)
        common.release()

    return compared(text)


def toxicity(text: Column, model: Model | None) -> Column:
    """The score of each text, 0 to 1."""
    if model is None:
        return F.lit(0.0)
    x = evidence(text, model, (model.tolerance,))[0]
    z = F.greatest(F.lit(-40.0), F.least(F.lit(40.0), x * F.lit(model.slope) + F.lit(model.intercept)))
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def keep_ordinary(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """docs, with all their columns, without the rows whose score reaches the threshold."""
    model = train(docs, labels, id_column, text_column)
    if model is None:
        return docs
    name = common.unused(docs, "__toxicity")
    return docs.withColumn(name, toxicity(F.col(text_column), model)).where(F.col(name) < threshold).drop(name)


def op10_toxicity(spark, sf_dir: str) -> DataFrame:
    docs, labels = common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels")
    model = train(docs, labels)
    held_out = F.expr("coalesce(crc32(cast(doc_id AS string)) % 4 = 2, false)").alias("held_out")
    scored = docs.select("doc_id", held_out, toxicity(F.col("text"), model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
