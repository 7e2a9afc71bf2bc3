"""Packing: shortest-pack-first over the length histogram.

Every text becomes its token ids and an end id. It is cut at multiples of ``size`` tokens, so its pieces
are known from the text alone, and all of them but the last fill a sequence. The histogram of piece lengths, at most ``size`` numbers, is
packed on the driver: lengths go longest first, each to the open packs with the fewest tokens that
have room, and as many packs as pieces of a length are moved at once, so a pack pattern carries a
count. The pieces then join the patterns by their rank within their length. Ranks come from counts of
hashed parts of each length, so a length that a third of all pieces have is ranked by many tasks.

A sequence is padded to ``size`` except where its length is a power of two.

Defined results: null text counts as empty and gives one piece with the end id; repeated rows are
packed each; ids may be null; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import bisect
import os
import zlib
from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from prismark.llm import common

SIZE, END_ID = 2048, 1
CACHE, OTHERS = 100_000, 60_000
#: Bytes of text that are encoded together.
BATCH = 2_500_000
#: A stretch of letters that all have one composed form, and a stop that no letter merges with.
PLAIN = "^[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]+[.,]?$"
#: Pieces of one length that are ranked together, about.
PART = 1000


def gathered(values: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """values holds stretches of the given lengths, one after another: those that codes name, in a row, and where each begins and the last ends."""
    lengths = lengths.astype(np.int32)  # a batch's ids are far fewer than 2 ** 31
    firsts = np.cumsum(lengths, dtype=np.int32) - lengths
    own = lengths[codes]
    ends = np.zeros(len(codes) + 1, np.int32)
    np.cumsum(own, out=ends[1:])
    at = np.repeat(firsts[codes] - ends[:-1], own)
    at += np.arange(ends[-1], dtype=np.int32)
    return values[at], ends


def _encodings(tokenizer, texts: list[str], each: int) -> Iterator:
    """The texts' encodings; only ``each`` of them are in memory at a time."""
    for i in range(0, len(texts), each):
        yield from tokenizer.encode_batch_fast(texts[i : i + each], add_special_tokens=False)


class ChunkEncoder:
    """Encodes texts with a tokenizer that drops white space, by the distinct chunks between spaces.

    A chunk that is a plain word, with or without a stop, is the word's ids and the stop's. The first
    ``CACHE`` words and ``OTHERS`` other chunks stay known, which soon holds the usual ones; what is left
    is learnt for the batch it occurs in.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core, and each thread would hold memory of its own
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        # for plain words in lower case, the same model without the steps that leave them as they are
        self.words = Tokenizer(self.tokenizer.model)
        self.words.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.ends = np.zeros(self.tokenizer.get_vocab_size(with_added_tokens=True), bool)
        for token, i in self.tokenizer.get_vocab(with_added_tokens=False).items():
            self.ends[i] = token.endswith("</w>")
        self.known_words: dict[str, bytes] = {}
        self.known_others: dict[str, bytes] = {}
        self.stops = [b"", *self._others([".", ","])]

    def _others(self, chunks: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in _encodings(self.tokenizer, chunks, 4000)]

    def _plain(self, words: list[str]) -> list[bytes]:
        """Ids of plain words, encoded together: each is one stretch of letters and so ends at its first token that ends a word."""
        out: list[bytes] = []
        parts = [words[i : i + 1000] for i in range(0, len(words), 1000)]
        for part, e in zip(parts, _encodings(self.words, [" ".join(p) for p in parts], 8), strict=True):
            ids = np.array(e.ids, "<u4")
            own, ends = ids.tobytes(), (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
            if len(ends) != len(part):
                raise ValueError("a plain word was taken apart")
            out += [own[a:b] for a, b in zip([0, *ends], ends, strict=False)]
        return out

    @staticmethod
    def _found(known: dict[str, bytes], most: int, wanted: list[str], learn: Callable[[list[str]], list[bytes]]) -> list[bytes]:
        found = list(map(known.get, wanted))
        fresh = [w for w, ids in zip(wanted, found, strict=True) if ids is None]
        if fresh:
            new = iter(learn(fresh))
            found = [next(new) if ids is None else ids for ids in found]
            if len(known) < most:
                known.update(islice(zip(wanted, found, strict=True), most - len(known)))
        return found

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts in a row, and where each text begins and the last ends."""
        # the vocabulary's rules drop white space, and no token crosses it
        chunks = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        coded = chunks.flatten().dictionary_encode()
        distinct = coded.dictionary
        plain = pc.match_substring_regex(distinct, PLAIN)
        is_plain = plain.to_numpy(zero_copy_only=False)
        words = pc.utf8_lower(pc.utf8_rtrim(distinct.filter(plain), ".,")).dictionary_encode()
        pieces = self._found(self.known_words, CACHE, words.dictionary.to_pylist(), self._plain)
        count = len(pieces)
        pieces += self._found(self.known_others, OTHERS, distinct.filter(pc.invert(plain)).to_pylist(), self._others)
        total = len(pieces)
        pieces += self.stops
        parts = np.full((len(distinct), 2), total, np.int64)  # a chunk's ids: a piece's, then a stop's or none
        parts[is_plain, 0] = words.indices.to_numpy()
        parts[~is_plain, 0] = np.arange(count, total)
        for k, stop in ((1, "."), (2, ",")):
            parts[is_plain & pc.ends_with(distinct, stop).to_numpy(zero_copy_only=False), 1] = total + k
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces)) // 4
        of_chunks, bounds = gathered(np.frombuffer(b"".join(pieces), "<u4"), lengths, parts.ravel())
        ids, ends = gathered(of_chunks, bounds[2::2] - bounds[:-2:2], coded.indices.to_numpy())
        offsets = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(chunks), 0).to_numpy(zero_copy_only=False))])
        return ids, ends[offsets]


def pieces(docs: DataFrame, tokenizer_path: str, id_column: str = "doc_id", text_column: str = "text", size: int = SIZE, end_id: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, and h, a hash that spreads the pieces."""
    common.small_batches(docs.sparkSession)
    end = np.array([end_id], "<u4").tobytes()
    schema = pa.schema([("doc_id", pa.int64()), *((c, pa.int64()) for c in ("start", "length", "ids_crc32", "doc_tokens", "h"))])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = common.worker_kept(("chunks", tokenizer_path), lambda: ChunkEncoder(tokenizer_path))
        for batch in batches:
            for part in common.parts(batch, "text", BATCH):
                ids, bounds = encoder.encode(part.column("text"))
                rows = []
                for doc, a, b in zip(part.column("doc_id").to_pylist(), bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                    n = b - a + 1
                    for start in range(0, n, size):
                        length = min(size, n - start)
                        crc = zlib.crc32(ids[a + start : min(a + start + length, b)])
                        if start + length == n:
                            crc = zlib.crc32(end, crc)
                        rows.append((doc, start, length, crc, n, zlib.crc32(repr((doc, start, len(rows))).encode(), crc)))
                columns = zip(*rows, strict=True) if rows else [[]] * 6
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], schema=schema)
        common.release()

    own = docs.select(F.col(id_column).cast("bigint").alias("doc_id"), F.col(text_column).alias("text"))
    return own.mapInArrow(cut, "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, h bigint")


def shortest_pack_first(histogram: dict[int, int], size: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths in order) with their counts, for pieces of the given lengths.

    Lengths go longest first to the open packs with the fewest tokens that have room.
    """
    open_by: dict[int, list[list]] = {}  # tokens in a pack -> [pattern, count]
    levels: list[int] = []
    def put(tokens: int, pattern: tuple[int, ...], count: int) -> None:
        if tokens not in open_by:
            bisect.insort(levels, tokens)
            open_by[tokens] = []
        open_by[tokens].append([pattern, count])

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left and levels and levels[0] + length <= size:
            tokens = levels[0]
            pattern, count = open_by[tokens][-1]
            moved = min(count, left)
            if moved == count:
                open_by[tokens].pop()
                if not open_by[tokens]:
                    del open_by[tokens]
                    levels.pop(0)
            else:
                open_by[tokens][-1][1] -= moved
            left -= moved
            put(tokens + length, (*pattern, length), moved)
        if left:
            fit = size // length  # what is left opens packs of its own; alike pieces share them as far as they fit
            if left >= fit:
                put(fit * length, (length,) * fit, left // fit)
            if left % fit:
                put(left % fit * length, (length,) * (left % fit), 1)
    return [(tuple(p), c) for tokens in sorted(open_by) for p, c in open_by[tokens]]


def ranked(pieces: DataFrame, part: int = PART) -> tuple[DataFrame, dict[int, int]]:
    """pieces with ``rank``, 0 and up within their length, and the histogram of lengths.

    A length's pieces are ranked in hashed parts, as many as its count asks for; the counts of parts, one row per length and part, give each part its first rank.
    """
    spark = pieces.sparkSession
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most size rows
    parts = spark.createDataFrame([(x, -(-n // part)) for x, n in histogram.items()], "length bigint, parts bigint")
    dealt = pieces.join(F.broadcast(parts), "length").withColumn("part", F.pmod(F.col("h"), F.col("parts"))).drop("parts")
    counts = dealt.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    before = W.partitionBy("length").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    first = counts.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    own = W.partitionBy("length", "part").orderBy("doc_id", "start", "ids_crc32")
    placed = dealt.withColumn("own", F.row_number().over(own) - 1).join(first, ["length", "part"])
    return placed.withColumn("rank", F.col("first") + F.col("own")).drop("part", "own", "first", "h"), histogram


def slots(patterns: list[tuple[tuple[int, ...], int]]) -> list[tuple[int, int, int, int, int]]:
    """Rows (length, first_rank, last_rank, first_sequence, offset): piece r of the length is in sequence first_sequence + r - first_rank."""
    rows, taken, sequence = [], {}, 0
    for pattern, count in patterns:
        offset = 0
        for length in pattern:
            r = taken.get(length, 0)
            rows.append((length, r, r + count - 1, sequence, offset))
            taken[length] = r + count
            offset += length
        sequence += count
    return rows


def pack(docs: DataFrame, tokenizer_path: str, id_column: str = "doc_id", text_column: str = "text", size: int = SIZE, end_id: int = END_ID) -> DataFrame:
    """One row per piece with its sequence_id and offset."""
    spark = docs.sparkSession
    own = common.stored(pieces(docs, tokenizer_path, id_column, text_column, size, end_id), "packing-pieces")
    placed, histogram = ranked(own)
    rows = slots(shortest_pack_first(histogram, size))
    # a length takes few slots: the patterns' number depends on size, not on the number of pieces
    table = spark.createDataFrame(rows, "length bigint, first_rank bigint, last_rank bigint, first_sequence bigint, offset bigint")
    by_length = table.groupBy("length").agg(F.sort_array(F.collect_list(F.struct("first_rank", "last_rank", "first_sequence", "offset"))).alias("slots"))
    found = placed.join(F.broadcast(by_length), "length")
    slot = F.filter("slots", lambda s: (s["first_rank"] <= F.col("rank")) & (F.col("rank") <= s["last_rank"]))[0]
    found = found.withColumn("slot", slot)
    return found.select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens",
        (F.col("slot.first_sequence") + F.col("rank") - F.col("slot.first_rank")).alias("sequence_id"), F.col("slot.offset").alias("offset"),
    )


def word_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op4_packing(spark, sf_dir: str) -> DataFrame:
    return pack(common.table(spark, sf_dir, "documents"), word_vocabulary())
