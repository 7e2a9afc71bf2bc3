"""URL filters: host and path rules, and gradient-boosted trees for what no rule covers.

The trees read lexical features only: lengths, depth, digit ratio, entropy, parameter counts, and
statistics of the host's suffixes (how often urls under a suffix are blocked in the training rows,
smoothed, each row without itself). They are trained on labelled urls; ``op1`` takes as labelled the
urls that a rule covers. Training reads at most ``max_labelled`` of them, those that hash lowest, which
is the documented bound of the classifier's sample. Features and scores are computed from every url.

Defined results: a null url, or one without ``://``, has empty host and path and is covered by no rule;
without labelled urls of both verdicts the trees give the only verdict there is, or allow; repeated
rows are judged each; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prismark.llm import common

#: Rules of the query: verdict and rule string, host up to the first slash, then path.
RULES = [("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/")]
NAMES = [
    "length", "host_length", "path_length", "query_length", "depth", "labels", "digit_ratio", "host_digits", "path_digits", "hyphens", "entropy",
    "parameters", "fragment", "secure", "file_ending", "longest_segment", "suffix1", "suffix2", "suffix3", "segment1",
]


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.regexp_extract(url, r"(?s)^.*?://(.*)$", 1)
    host = common.ascii_lower(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1))
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def longest_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """The rule that covers host and path, as struct(rule, verdict); null if none does. The longest wins, of equally long ones block."""
    table = F.array(*[
        F.struct(F.lit(r).alias("rule"), F.lit(v).alias("verdict"), F.lit(r.partition("/")[0].lower()).alias("host"), F.lit("/" + r.partition("/")[2]).alias("path"))
        for v, r in sorted(rules, key=lambda x: (-len(x[1]), x[0] != "block"))
    ])
    fits = F.filter(table, lambda r: ((host == r["host"]) | host.endswith(F.concat(F.lit("."), r["host"]))) & path.startswith(r["path"]))
    return F.get(fits, F.lit(0))


def _suffixes(host: str, path: str) -> tuple[str, str, str, str]:
    labels = host.split(".")
    return labels[-1], ".".join(labels[-2:]), ".".join(labels[-3:]), "/" + path[1:].partition("/")[0]


@dataclass
class Trees:
    """Gradient-boosted regression trees on binned features, for the logistic loss."""

    rounds: int = 60
    depth: int = 4
    rate: float = 0.2
    bins: int = 64
    least: float = 5.0
    base: float = 0.0
    edges: list[np.ndarray] = field(default_factory=list)
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    def _binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, k], side="left") for k, e in enumerate(self.edges)], 1)

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        self.edges = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, self.bins)[1:-1])) for k in range(x.shape[1])]
        b, (n, width), cells = self._binned(x), x.shape, self.bins
        p = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.base = float(np.log(p / (1 - p)))
        score = np.full(n, self.base)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-score))
            g, h = y - p, np.maximum(p * (1 - p), 1e-6)
            feature, cut = np.zeros(2**self.depth - 1, np.int64), np.full(2**self.depth - 1, self.bins)
            node = np.zeros(n, np.int64)
            for level in range(self.depth):
                first, count = 2**level - 1, 2**level
                best, gain = [(0, self.bins)] * count, np.full(count, 1e-9)
                for k in range(width):
                    at = (node - first) * cells + b[:, k]
                    gs = np.cumsum(np.bincount(at, g, count * cells).reshape(count, cells), 1)
                    hs = np.cumsum(np.bincount(at, h, count * cells).reshape(count, cells), 1)
                    gl, hl, ga, ha = gs[:, :-1], hs[:, :-1], gs[:, -1:], hs[:, -1:]
                    won = gl**2 / (hl + 1) + (ga - gl) ** 2 / (ha - hl + 1) - ga**2 / (ha + 1)
                    won[(hl < self.least) | (ha - hl < self.least)] = -1
                    at_best = won.argmax(1)
                    for m in np.flatnonzero(won[np.arange(count), at_best] > gain):
                        gain[m], best[m] = won[m, at_best[m]], (k, int(at_best[m]))
                for m, (k, c) in enumerate(best):
                    feature[first + m], cut[first + m] = k, c
                node = 2 * node + 1 + (b[np.arange(n), feature[node]] > cut[node])
            leaf = node - (2**self.depth - 1)
            value = self.rate * np.bincount(leaf, g, 2**self.depth) / (np.bincount(leaf, h, 2**self.depth) + 1)
            self.trees.append((feature, cut, value))
            score += value[leaf]
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        b, rows, score = self._binned(x), np.arange(len(x)), np.full(len(x), self.base)
        for feature, cut, value in self.trees:
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (b[rows, feature[node]] > cut[node])
            score += value[node - (2**self.depth - 1)]
        return 1 / (1 + np.exp(-score))


class UrlModel:
    """Suffix statistics and trees; ``of`` scores urls, 1 for block."""

    def __init__(self, urls: list[str], hosts: list[str], paths: list[str], block: np.ndarray):
        self.prior = float(block.mean()) if len(block) else 0.0
        self.known: list[dict[str, tuple[float, float]]] = [{} for _ in range(4)]
        self.trees: Trees | None = None
        if len(np.unique(block)) < 2:
            return
        parts = [_suffixes(h, p) for h, p in zip(hosts, paths, strict=True)]
        for k in range(4):
            sums = pd.DataFrame({"s": [p[k] for p in parts], "y": block}).groupby("s")["y"].agg(["sum", "count"])
            self.known[k] = {s: (float(a), float(n)) for s, a, n in sums.itertuples()}
        self.trees = Trees().fit(self.features(urls, hosts, paths, block), block)

    def features(self, urls: list[str], hosts: list[str], paths: list[str], own: np.ndarray | None = None) -> np.ndarray:
        out = np.zeros((len(urls), len(NAMES)))
        for i, (u, h, p) in enumerate(zip(urls, hosts, paths, strict=True)):
            u = u or ""
            digits = sum(map(str.isdigit, u))
            counts = np.array([u.count(c) for c in set(u)], float) / max(1, len(u))
            query = u.partition("?")[2].partition("#")[0]
            segments = [s for s in p.split("/") if s]
            y = None if own is None else own[i]
            rates = []
            for k, s in enumerate(_suffixes(h, p)):
                a, n = self.known[k].get(s, (0.0, 0.0))
                if y is not None:  # a row is judged by the others
                    a, n = a - y, n - 1
                rates.append((a + 2 * self.prior) / (n + 2))
            out[i] = (
                len(u), len(h), len(p), len(query), len(segments), h.count(".") + 1, digits / max(1, len(u)), sum(map(str.isdigit, h)), sum(map(str.isdigit, p)), u.count("-"),
                -(counts * np.log2(counts)).sum() if len(u) else 0, query.count("&") + bool(query), "#" in u, u.startswith("https:"), "." in (segments[-1] if segments else ""), max(map(len, segments), default=0), *rates,
            )
        return out

    def of(self, urls: list[str], hosts: list[str], paths: list[str]) -> np.ndarray:
        if self.trees is None:
            return np.full(len(urls), self.prior)
        return self.trees.predict(self.features(urls, hosts, paths))


def train(labelled: DataFrame, max_labelled: int = 20_000) -> UrlModel:
    """labelled: url, host, path, block (0 or 1)."""
    own = labelled.where("block IS NOT NULL").select("url", "host", "path", F.col("block").cast("double"), F.xxhash64("url").alias("h"))
    rows = own.orderBy("h", "url").limit(max_labelled).toPandas()
    return UrlModel(rows["url"].tolist(), rows["host"].tolist(), rows["path"].tolist(), rows["block"].to_numpy(np.float64))


def judged(pages: DataFrame, rules: list[tuple[str, str]], id_column: str = "page_id", url_column: str = "url", max_labelled: int = 20_000) -> DataFrame:
    """One row per row of pages: page_id, host, path, rule, verdict, and score, the trees' chance of block."""
    host, path = host_and_path(F.col("url"))
    own = pages.select(F.col(id_column).cast("bigint").alias("page_id"), F.col(url_column).alias("url"))
    own = own.withColumns({"host": host, "path": path}).withColumn("found", longest_rule(F.col("host"), F.col("path"), rules))
    model = train(own.where("found IS NOT NULL").select("url", "host", "path", (F.col("found.verdict") == "block").cast("int").alias("block")), max_labelled)
    sent = SparkSession.getActiveSession().sparkContext.broadcast(model)

    @F.pandas_udf(T.DoubleType())
    def score(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for u, h, p in batches:
            yield pd.Series(sent.value.of(u.where(u.notna(), None).tolist(), h.tolist(), p.tolist()))

    scored = own.withColumn("score", score("url", "host", "path"))
    verdict = F.coalesce(F.col("found.verdict"), F.when(F.col("score") > 0.5, "block").otherwise("allow"))
    return scored.select("page_id", "host", "path", F.col("found.rule").alias("rule"), verdict.alias("verdict"), "score")


def op1_url_filter(spark, sf_dir: str) -> DataFrame:
    return judged(common.table(spark, sf_dir, "pages"), RULES)
