"""LM scoring by Brown class-based n-grams.

A word's probability is that of its class after the class before it, times that of the word in its class.
Exchange clustering assigns the classes. The most frequent types, ``CORE`` of them, are clustered by
exact exchange on their bigram counts: each in turn moves to the class that gains most likelihood, until
none moves. Every other training word then makes exchange moves against the classes of its core
neighbours, in sweeps over all words in parallel: each sweep moves every word to its best class under the
class bigrams that the sweep before has left, and sweeps go on while these gain mutual information.

Words are counted exactly over all training texts, however many there are. Only for speed are at most
``HEAD`` frequent words, of at most ``LONGEST`` bytes, sent to all tasks as a dictionary, a bound by
construction. All other words have their class and count in a table, which reaches the texts by a join:
the model does not depend on ``HEAD``, as long as it holds the core. Words that training lacks have the
class of their ending (``ENDINGS`` hashed endings), for which rare words speak.

Texts are encoded once into type ids in the shared folder, and joined once with that table; every later
pass reads those. Passes send counts, pre-aggregated, never tokens.

Defined results: null text counts as empty, whose one token is the end; a text is held out if crc32 of
its id as text leaves 2 divided by 7, rows with a null id train; without training texts all counts are
0; repeated rows count and are scored each; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from prismark.llm import common

HEAD, LONGEST, ENDINGS, LETTERS = 131_072, 64, 8192, 4
CORE, CLASSES, SWEEPS = 2048, 64, 12
#: Words seen at most so often also speak for their ending, which unseen words share.
RARE = 5
#: Most sweeps over the words outside the core, and the share of mutual information that one must gain.
WORD_SWEEPS, GAIN = 8, 2e-3


def tokens(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct words (binary), each token's number among them, and each token's row. A-Z is lower-cased; the six ASCII spaces divide."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    coded = lists.flatten().dictionary_encode()
    codes = coded.indices.to_numpy()
    rows = np.repeat(np.arange(len(texts)), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
    words = coded.dictionary.cast(pa.binary())
    empty = pc.index(words, b"").as_py()
    if empty >= 0:
        kept = codes != empty
        codes, rows = codes[kept], rows[kept]
    return words, codes, rows


def _summed(df: DataFrame, columns: str | list[str], count: Callable[[pa.RecordBatch], tuple[np.ndarray, np.ndarray]], column: str) -> DataFrame:
    """Counts by key (key, n): ``count`` gives the keys and numbers of a part of a batch."""
    schema = pa.schema([("key", pa.int64()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.parts(batch, column, common.BATCH_BYTES):
                keys, n = count(part)
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(n, pa.int64())], schema=schema)

    return df.select(columns).mapInArrow(run, "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n"))


def _collected(counts: DataFrame, size: int) -> np.ndarray:
    """Counts by key as an array of the given, bounded size, on the driver."""
    table, out = counts.toArrow(), np.zeros(size)
    for batch in table.to_batches():
        out[batch.column(0).to_numpy()] = batch.column(1).to_numpy()
    return out


def _flat(part: pa.RecordBatch) -> np.ndarray:
    return np.frombuffer(b"".join(part.column("ids").to_pylist()), np.int32)


def word_counts(texts: DataFrame) -> DataFrame:
    """Rows (word, n) over all texts (column text)."""
    schema = pa.schema([("word", pa.binary()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.parts(batch, "text", common.BATCH_BYTES):
                words, codes, _ = tokens(part.column("text"))
                n = np.bincount(codes, minlength=len(words))
                some = pa.array(np.flatnonzero(n))
                yield pa.RecordBatch.from_arrays([words.take(some), pa.array(n[n > 0], pa.int64())], schema=schema)

    return texts.select("text").mapInArrow(run, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def ending(word: bytes) -> int:
    return zlib.crc32(word[-LETTERS:]) % ENDINGS


@dataclass
class Types:
    """What each type id stands for: head words by falling count, then endings, then the end of a text. Greater ids are a text's other words."""

    words: list[bytes]
    counts: np.ndarray
    kinds: np.ndarray

    @property
    def end(self) -> int:
        return len(self.counts) - 1


def head_and_endings(words: DataFrame, texts: int) -> tuple[Types, Column]:
    """The types with their counts and numbers of distinct words, and the condition for words that are not in the head."""
    short = words.where(F.octet_length("word") <= LONGEST)
    level = F.floor(F.log2(F.col("n").cast("double")) * 16).cast("int")
    levels = short.groupBy(level.alias("level")).agg(F.count(F.lit(1)).alias("kinds"), F.min("n").alias("least")).toPandas().sort_values("level", ascending=False)
    fits = levels[levels["kinds"].cumsum() <= HEAD]
    core = min(CORE, HEAD)  # where whole levels do not hold it, it is taken by count and word
    whole = fits["kinds"].sum() >= core or len(fits) == len(levels)
    head = short.where(F.col("n") >= (int(fits["least"].min()) if len(fits) else 1)) if whole else short.orderBy(F.desc("n"), "word").limit(core)
    head = head.toPandas()  # at most HEAD rows
    head = head.sort_values(["n", "word"], ascending=[False, True])
    counts, kinds = np.zeros((2, len(head) + ENDINGS + 1))
    counts[: len(head)], kinds[: len(head)] = head["n"], 1
    counts[-1], kinds[-1] = texts, texts > 0
    known = [bytes(w) for w in head["word"]]
    if not known:
        return Types(known, counts, kinds), F.lit(True)
    n, least = F.col("n"), int(head["n"].iloc[-1])
    above = (n > least) | ((n == least) & (F.col("word") <= F.lit(known[-1])))
    return Types(known, counts, kinds), ~above | (F.octet_length("word") > LONGEST)


def encoded(texts: DataFrame, types: Types) -> DataFrame:
    """Rows (key, doc_id, held_out, ids, tail): type ids with the end, and the text's distinct words that are not in the head; the j-th of them has the first free type id plus j."""
    sent = texts.sparkSession.sparkContext.broadcast(types.words)
    tail_type = pa.list_(pa.binary())
    schema = pa.schema([("key", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("ids", pa.binary()), ("tail", tail_type)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = {w: i for i, w in enumerate(sent.value)}
        head, key = len(known), TaskContext.get().partitionId() << 40
        for batch in batches:
            for part in common.parts(batch, "text", common.BATCH_BYTES):
                words, codes, rows = tokens(part.column("text"))
                of = np.fromiter([known.get(w, -1) for w in words.to_pylist()], np.int64, len(words))
                own = of[codes]
                tail = np.flatnonzero(own < 0)
                pairs, which = np.unique(rows[tail] * len(words) + codes[tail], return_inverse=True)
                offsets = np.searchsorted(pairs, np.arange(part.num_rows + 1) * len(words))
                own[tail] = head + ENDINGS + 1 + which - offsets[rows[tail]]
                n = np.bincount(rows, minlength=part.num_rows)
                ends = np.cumsum(n + 1)
                ids = np.full(ends[-1], head + ENDINGS, np.int32)
                ids[np.arange(len(rows)) + rows] = own
                data, bounds = ids.tobytes(), [0, *(4 * ends).tolist()]
                inner = words.take(pa.array(pairs % max(1, len(words))))
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.arange(key, key + part.num_rows)), part.column("doc_id"), part.column("held_out"),
                    pa.array([data[a:b] for a, b in zip(bounds, bounds[1:], strict=False)], pa.binary()), pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), inner, type=tail_type),
                ], schema=schema)
                key += part.num_rows

    own = texts.select("doc_id", "held_out", "text")
    return own.mapInArrow(run, "key bigint, doc_id bigint, held_out boolean, ids binary, tail array<binary>")


def _in_tail(part: pa.RecordBatch, ids: np.ndarray, total: int) -> tuple[np.ndarray, np.ndarray]:
    """Where ids, all of a part, are words of the texts' tails, and their places in the part's flattened tails."""
    lengths = pc.binary_length(part.column("ids")).to_numpy(zero_copy_only=False) // 4
    sizes = pc.list_value_length(part.column("tail")).to_numpy(zero_copy_only=False)
    at = np.flatnonzero(ids >= total)
    return at, np.repeat(np.cumsum(sizes) - sizes, lengths)[at] + ids[at] - total


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def exchange(bigrams: np.ndarray, classes: int = CLASSES, sweeps: int = SWEEPS) -> np.ndarray:
    """Classes of types 0, 1, ... (by falling count) from their bigram counts, by exchange until no type moves."""
    size = len(bigrams)
    classes = max(1, min(classes, size))
    of = np.arange(size) % classes
    member = np.zeros((size, classes))
    member[np.arange(size), of] = 1
    n = member.T @ bigrams @ member
    rows, columns = n.sum(1), n.sum(0)
    every = np.arange(classes)
    for _ in range(sweeps):
        moved = 0
        for w in range(size):
            a, self_ = of[w], bigrams[w, w]
            right = np.bincount(of, bigrams[w], classes)
            left = np.bincount(of, bigrams[:, w], classes)
            out, into = right.sum(), left.sum()
            if not out + into:
                continue
            right[a] -= self_
            left[a] -= self_
            n[a] -= right
            n[:, a] -= left
            n[a, a] -= self_
            rows[a] -= out
            columns[a] -= into
            by_row, by_column = n + right, n.T + left
            gain = (_xlogx(by_row) - _xlogx(n)).sum(1) + (_xlogx(by_column) - _xlogx(n.T)).sum(1)
            own = n[every, every]
            gain -= _xlogx(own + right) - _xlogx(own) + _xlogx(own + left) - _xlogx(own)
            gain += _xlogx(own + right + left + self_) - _xlogx(own)
            gain -= _xlogx(rows + out) - _xlogx(rows) + _xlogx(columns + into) - _xlogx(columns)
            b = int(gain.argmax()) if gain.max() > gain[a] + 1e-6 else a
            n[b] += right
            n[:, b] += left
            n[b, b] += self_
            rows[b] += out
            columns[b] += into
            moved += b != a
            of[w] = b
        if not moved:
            break
    return of


def _ending(word: str) -> Column:
    """``ending`` as a column expression."""
    return F.pmod(F.crc32(F.substring(word, -LETTERS, LETTERS)), F.lit(ENDINGS)).cast("int")


def _affinity(n: np.ndarray) -> np.ndarray:
    """What a step from one class (row) to another is worth: its logarithm against chance."""
    n = n + 0.1
    return np.log(n) - np.log(n.sum(1))[:, None] - np.log(n.sum(0))[None]


def _information(n: np.ndarray) -> float:
    """Mutual information of neighbouring classes, in nats over all steps."""
    return float(_xlogx(n).sum() - _xlogx(n.sum(1)).sum() - _xlogx(n.sum(0)).sum() + _xlogx(n.sum()))


def _best(column: pa.Array, both: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of rows of seen (none empty): the class that gains most, the rows' sizes, and the flattened keys and numbers. both: by key and own class."""
    flat, sizes = column.flatten(), pc.list_value_length(column).to_numpy(zero_copy_only=False)
    keys, n = flat.field("k").to_numpy(), flat.field("n").to_numpy()
    return np.add.reduceat(both[keys] * n[:, None], np.cumsum(sizes) - sizes).argmax(1), sizes, keys, n


def _both(affinity: np.ndarray) -> np.ndarray:
    return np.concatenate([affinity, affinity.T])  # rows: class before, then class after; columns: own class


def _swept(words: DataFrame, core: np.ndarray) -> np.ndarray:
    """The affinity under which the words' (seen) best classes have the most mutual information. core: the class bigrams of the core."""
    k, affinity, best, most = len(core), _affinity(core), _affinity(core), -np.inf
    schema = pa.schema([("key", pa.int64()), ("n", pa.int64())])
    for _ in range(WORD_SWEEPS):
        sent = words.sparkSession.sparkContext.broadcast(_both(affinity))

        def steps(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            total = np.zeros(2 * k * k, np.int64)
            for b in batches:
                if b.num_rows:
                    own, sizes, keys, n = _best(b.column("seen"), sent.value)
                    total += np.bincount(keys * k + np.repeat(own, sizes), n, 2 * k * k).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.flatnonzero(total)), pa.array(total[total > 0])], schema=schema)

        counts = words.select("seen").mapInArrow(steps, "key bigint, n bigint").groupBy("key").agg(F.sum("n").alias("n"))
        before, after = _collected(counts, 2 * k * k).reshape(2, k, k)  # at most two sides times CLASSES * CLASSES rows
        n = core + before + after.T
        now = _information(n)
        if np.isfinite(most) and now <= most + GAIN * abs(most):
            break
        most, best, affinity = now, affinity, _affinity(n)
    return best


def _best_moves(seen: DataFrame, affinity: np.ndarray) -> DataFrame:
    """Adds the class that gains most to rows with seen: side times classes plus neighbour's class, and how often."""
    sent = seen.sparkSession.sparkContext.broadcast(_both(affinity))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                own, _, _, _ = _best(b.column("seen"), sent.value)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(own, pa.int64())], names=[*b.schema.names, "class"])

    return seen.mapInArrow(run, ", ".join(f"{c} {t}" for c, t in seen.dtypes) + ", class bigint")


@dataclass
class Found:
    """Classes of all types, and of the tail: its table (word, n, class), tokens and distinct words by class."""

    of: np.ndarray
    tail: DataFrame | None
    counts: np.ndarray
    kinds: np.ndarray


def clustered(training: DataFrame, types: Types, tail_words: DataFrame | None = None) -> Found:
    """The class of every type and training word. training: rows (ids, tail) of the training texts; tail_words: rows (word, n) that are not in the head."""
    spark, total = training.sparkSession, len(types.counts)
    order = np.lexsort((np.arange(total), -types.counts))
    core = order[: min(CORE, int((types.counts > 0).sum()))]
    if not len(core):
        empty = tail_words.select("word", "n", F.lit(0).cast("bigint").alias("class")) if tail_words is not None else None
        return Found(np.zeros(total, np.int64), empty, np.zeros(1), np.zeros(1))
    place = np.full(total + 1, -1, np.int64)
    place[core] = np.arange(len(core))
    size, end = len(core), types.end
    sent = spark.sparkContext.broadcast(place)

    def pairs(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        at = sent.value[np.minimum(np.concatenate([[end], _flat(part)]), total)]  # each text ends with the end, so the next one starts after it
        both = (at[:-1] >= 0) & (at[1:] >= 0)
        return np.unique(at[:-1][both] * size + at[1:][both], return_counts=True)

    bigrams = _collected(_summed(training, "ids", pairs, "ids"), size * size).reshape(size, size)  # at most CORE * CORE rows
    own = exchange(bigrams)
    k = int(own.max()) + 1
    member = np.zeros((size, k))
    member[np.arange(size), own] = 1
    n = member.T @ bigrams @ member

    of = np.full(total + 1, -1, np.int64)
    of[core] = own
    speaks = np.full(total + 1, -1, np.int64)  # the ending that a rare head word also speaks for
    head = len(types.words)
    for i in np.flatnonzero(types.counts[:head] <= RARE):
        speaks[i] = head + ending(types.words[i])
    about = spark.sparkContext.broadcast((of, speaks))
    schema = pa.schema([("word", pa.binary()), ("key", pa.int64()), ("n", pa.int64())])

    def around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, speaks = about.value
        for batch in batches:
            for part in common.parts(batch, "ids", common.BATCH_BYTES):
                flat = _flat(part)
                at, places = _in_tail(part, flat, total)
                coded = part.column("tail").flatten().dictionary_encode()
                word = np.full(len(flat) + 1, -1, np.int64)
                word[at + 1] = coded.indices.to_numpy()[places]
                ids = np.minimum(np.concatenate([[end], flat]).astype(np.int64), total)
                c = of[ids]
                keys, words = [], []
                for mine, other, side in ((slice(1, None), c[:-1], 0), (slice(None, -1), c[1:], 1)):
                    some = (c[mine] < 0) & (other >= 0)
                    about_, seen, own_word = ids[mine][some], side * k + other[some], word[mine][some]
                    for who in (np.where(own_word < 0, about_, -1), speaks[about_]):
                        keys.append(who[who >= 0] * 2 * k + seen[who >= 0])
                    words.append(own_word[own_word >= 0] * 2 * k + seen[own_word >= 0])
                for x, named in ((keys, False), (words, True)):
                    x, n = np.unique(np.concatenate(x), return_counts=True)
                    names = coded.dictionary.take(pa.array(x // (2 * k))) if named else pa.nulls(len(x), pa.binary())
                    yield pa.RecordBatch.from_arrays([names, pa.array(x % (2 * k) if named else x, pa.int64()), pa.array(n, pa.int64())], schema=schema)

    seen = training.select("ids", "tail").mapInArrow(around, "word binary, key bigint, n bigint").groupBy("word", "key").agg(F.sum("n").alias("n"))
    # at most two sides times CLASSES rows for each type or word
    one = F.struct((F.col("key") % (2 * k)).cast("int").alias("k"), "n")
    by_type = seen.groupBy("word", (F.col("key") / (2 * k)).cast("bigint").alias("type")).agg(F.sort_array(F.collect_list(one)).alias("seen"))
    path = common.scratch(spark, "brown-seen")
    by_type = common.stored(by_type, "brown-seen", path)
    affinity = _swept(by_type.where(f"word IS NOT NULL OR type < {head}"), n)
    moves = common.stored(_best_moves(by_type, affinity), "brown-moves")
    common.remove(spark, path)
    moved = moves.where(f"word IS NULL AND type < {head}").select("type", "class").toPandas()  # at most one row a type
    of[moved["type"]] = moved["class"]

    votes = moves.where(f"word IS NULL AND type >= {head}").select((F.col("type") - head).cast("int").alias("e"), F.explode("seen").alias("s"))
    if tail_words is not None:
        of_words = tail_words.join(moves.where("word IS NOT NULL").select("word", "class", "seen"), "word", "left")
        tail = common.stored(of_words.withColumn("seen", F.when(F.col("n") <= RARE, F.col("seen"))), "brown-classes")
        votes = votes.union(tail.select(_ending("word").alias("e"), F.explode("seen").alias("s")))
    summed = votes.groupBy("e", F.col("s.k").alias("k")).agg(F.sum("s.n").alias("n"))
    by_ending = summed.groupBy("e").agg(F.sort_array(F.collect_list(F.struct("k", "n"))).alias("seen"))
    moved = _best_moves(by_ending, affinity).select("e", "class").toPandas()  # at most ENDINGS rows
    of[head + moved["e"]] = moved["class"]

    of = of[:total]
    counts, kinds, more = np.zeros(k), np.zeros(k), np.zeros(2)
    if tail_words is not None:
        for r in tail.groupBy("class").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("kinds")).collect():  # at most CLASSES rows and one
            if r["class"] is None:
                more = np.array([r["n"], r["kinds"]])
            else:
                counts[r["class"]], kinds[r["class"]] = r["n"], r["kinds"]
    rest = int((np.bincount(of[of >= 0], types.kinds[of >= 0], k) + kinds).argmax())  # types without a clustered neighbour: the class with the most words
    of[of < 0] = rest
    counts[rest] += more[0]
    kinds[rest] += more[1]
    table = None if tail_words is None else tail.select("word", "n", F.coalesce("class", F.lit(rest)).alias("class"))
    return Found(of, table, counts, kinds)


def placed(codes: DataFrame, found: Found) -> DataFrame:
    """codes with (class, n) for the words of each text's tail; unseen words have -1 - their ending instead, and no count."""
    words = codes.select("key", F.posexplode("tail").alias("j", "word"))
    known = words.join(found.tail, "word", "left")
    joined = known.select("key", F.struct("j", F.coalesce("class", -1 - _ending("word")).cast("int").alias("class"), F.coalesce("n", F.lit(0)).alias("n")).alias("t"))
    tails = joined.groupBy("key").agg(F.sort_array(F.collect_list("t")).alias("tail"))
    none = F.array().cast("array<struct<j: int, class: int, n: bigint>>")
    return codes.drop("tail").join(tails, "key", "left").withColumn("tail", F.coalesce("tail", none))


@dataclass
class Model:
    classes: np.ndarray
    transitions: np.ndarray
    emissions: np.ndarray
    base: np.ndarray
    below: np.ndarray
    of_all: float
    head: int
    train_tokens: int


def _class_of(part: pa.RecordBatch, ids: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The classes of a part's ids after the end, which stands before them; where ids are of the tail, and how often training has those."""
    at, places = _in_tail(part, ids, len(of))
    c = of[np.minimum(np.concatenate([[len(of) - 1], ids]), len(of) - 1)]
    if not len(at):
        return c, at, np.zeros(0)
    tail = part.column("tail").flatten()
    own = tail.field("class").to_numpy()[places]
    c[at + 1] = np.where(own < 0, of[len(of) - 2 - ENDINGS - own], own)  # endings stand before the end
    return c, at, tail.field("n").to_numpy()[places]


def fit(training: DataFrame, types: Types, found: Found | None = None) -> Model:
    """Log10 tables. For words of the tail they lack the part log10(c + 1), c the word's count. training: placed rows, or any if no text has a tail."""
    found = found or clustered(training, types)
    of, k, end = found.of, len(found.counts), types.end
    sent = training.sparkSession.sparkContext.broadcast(of)

    def steps(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        c, _, _ = _class_of(part, _flat(part), sent.value)
        n = np.bincount(c[:-1] * k + c[1:], minlength=k * k)
        return np.flatnonzero(n), n[n > 0]

    t = _collected(_summed(training, ["ids", "tail"], steps, "ids"), k * k).reshape(k, k)  # at most CLASSES * CLASSES rows
    own = np.bincount(of, types.counts, k) + found.counts
    share = (own + 1) / (own.sum() + k)
    transitions = np.log10((t + k * share) / (t.sum(1) + k)[:, None])
    below = np.log10(own + np.bincount(of, types.kinds, k) + found.kinds + 1)
    head = len(types.words)
    numerators = np.log10(types.counts + 1)
    tokens_, kinds = types.counts.sum() + found.counts.sum(), types.kinds.sum() + found.kinds.sum()
    of_all = np.log10(tokens_ + kinds + 1)
    return Model(of, transitions, numerators - below[of], numerators - of_all, below, of_all, head, int(tokens_))


def scored(codes: DataFrame, types: Types, model: Model) -> DataFrame:
    """One row per text: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score. codes: placed rows."""
    end, known = types.end, types.counts > 0
    sent = codes.sparkSession.sparkContext.broadcast((model, known))
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, known = sent.value
        for batch in batches:
            for part in common.parts(batch, "ids", common.BATCH_BYTES):
                ids = _flat(part)
                n = pc.binary_length(part.column("ids")).to_numpy(zero_copy_only=False) // 4
                starts = np.cumsum(n) - n
                c, at, times = _class_of(part, ids, m.classes)
                ids = np.minimum(ids, end)
                is_known, base, own = known[ids].astype(np.int64), m.base[ids], m.emissions[ids]
                more = np.log10(times + 1)
                is_known[at], base[at], own[at] = times > 0, more - m.of_all, more - m.below[c[at + 1]]
                sums = [np.add.reduceat(x, starts) for x in (is_known, base, m.transitions[c[:-1], c[1:]] + own)]
                trained = pa.array(np.full(part.num_rows, m.train_tokens, np.int64))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(n, pa.int64()), pa.array(sums[0]), trained, *map(pa.array, sums[1:])], schema=schema)

    rows = codes.select("doc_id", "held_out", "ids", "tail")
    return rows.mapInArrow(run, "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")


def brown_scores(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Learns from the texts that are not held out and scores every text."""
    common.small_batches(docs.sparkSession)
    i = F.col(id_column).cast("bigint")
    held_out = F.coalesce(F.crc32(i.cast("string")) % 7 == 2, F.lit(False))
    texts = docs.select(i.alias("doc_id"), held_out.alias("held_out"), F.col(text_column).alias("text"))
    training = texts.where("NOT held_out")
    words = common.stored(word_counts(training), "brown-words")
    types, in_tail = head_and_endings(words, training.count())
    path = common.scratch(texts.sparkSession, "brown-codes")
    codes = common.stored(encoded(texts, types), "brown-codes", path)
    found = clustered(codes.where("NOT held_out"), types, words.where(in_tail))
    codes = common.stored(placed(codes, found), "brown-placed")
    common.remove(texts.sparkSession, path)
    return scored(codes, types, fit(codes.where("NOT held_out"), types, found))


def op9_brown_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brown_scores(common.table(spark, sf_dir, "documents"))
