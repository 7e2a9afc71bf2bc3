"""BPE encoding by prefix-sharing trie traversal, and decoding.

The last token of a prefix's encoding fixes the rest of it: the prefix without that token has the same
encoding it would have alone. So each trie node, a prefix shared by words, needs one state, its last
token. Distinct words go into a trie; a depth-first walk gives a node the one vocabulary entry that
ends there and that merges leave alone behind the last token of the node where it starts. Encodings of
shared prefixes are computed once, and a word's ids are read back from its node towards the root.

The trie is walked in its sorted form: in byte order of the words, the nodes on the path to a word are
a stack, of which the next word keeps what both have in common.

Defined results: null text counts as empty and has no ids; a special token's string in a text becomes
its id, as the library does by default; decoding replaces bytes that are no UTF-8; repeated rows are
each encoded; null ids stay null; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prismark.llm import common

# Fixed values of the public byte-level format: white space, and what the pattern keeps together.
WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{WHITE}\p{{L}}\p{{N}}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+"
#: Stretches that the pattern's matches never cross: a plain word before a space or a stop, the stop, or any white space and what follows it.
LETTERS = r"A-Za-zÀ-ÖØ-öø-ɏ"
SEGMENT = re.compile(rf" ?[{LETTERS}]+(?=[.,]?[ \n])|[.,](?=[ \n])|[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")
CACHE = 700_000


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the vocabulary file: itself where it can be printed, else the next from 256 on."""
    printed = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in printed}
    letters.update({chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(printed))})
    return letters


class Vocabulary:
    """Tokens as bytes, merges as ranked pairs of ids, and the special tokens of a tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        letters = byte_letters()
        self.ids = {bytes(letters[c] for c in token): i for token, i in file["model"]["vocab"].items() if all(c in letters for c in token)}
        self.special = {t["content"]: t["id"] for t in file["added_tokens"]}
        self.bytes = [b""] * (1 + max([*self.ids.values(), *self.special.values()]))
        for token, i in self.ids.items():
            self.bytes[i] = token
        for content, i in self.special.items():
            self.bytes[i] = content.encode()
        own = lambda token: self.ids[bytes(letters[c] for c in token)]
        self.merges = {}
        for rank, merge in enumerate(file["model"]["merges"]):
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            left, right = own(a), own(b)
            self.merges[left, right] = (rank, self.ids[self.bytes[left] + self.bytes[right]])
        self.longest = max(map(len, self.ids))

    def merged(self, word: bytes) -> list[int]:
        """Plain pair merging, lowest rank first; for the few tokens that a pair is checked with."""
        parts = [self.ids[word[i : i + 1]] for i in range(len(word))]
        while len(parts) > 1:
            ranked = [(self.merges[p][0], i) for i, p in enumerate(zip(parts, parts[1:], strict=False)) if p in self.merges]
            if not ranked:
                break
            i = min(ranked)[1]
            parts[i : i + 2] = [self.merges[parts[i], parts[i + 1]][1]]
        return parts


class TrieEncoder:
    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.pairs: dict[int, bool] = {}
        self.by_length: list[dict[bytes, int]] = [{} for _ in range(vocabulary.longest + 1)]
        for token, i in vocabulary.ids.items():
            self.by_length[len(token)][token] = i
        #: lengths of the tokens that end in a byte, the usual ones first: just one token can be the last, so any order finds it
        found: list[set[int]] = [set() for _ in range(256)]
        for token in vocabulary.ids:
            found[token[-1]].add(len(token))
        self.lengths_by_end = [sorted(n, key=lambda k: abs(k - 2.6)) for n in found]

    def _fits(self, left: int, right: int) -> bool:
        """Whether merging leaves the token right alone behind the token left (-1: at a word's start)."""
        key = (left + 1) << 20 | right
        known = self.pairs.get(key)
        if known is None:
            v = self.v
            if left < 0:
                known = v.merged(v.bytes[right]) == [right]
            else:
                known = v.merged(v.bytes[left] + v.bytes[right]) == [left, right]
            self.pairs[key] = known
        return known

    def encode_words(self, words: list[bytes]) -> dict[bytes, list[int]]:
        """Ids of distinct words."""
        out, by_length, ends, fits, pairs = {}, self.by_length, self.lengths_by_end, self._fits, self.pairs
        last: list[int] = [-1]  # last[d]: last token of the path's node at depth d
        size: list[int] = [0]  # its length in bytes
        before = b""
        for word in sorted(words):
            shared, most = 0, min(len(before), len(word))
            while shared < most and before[shared] == word[shared]:
                shared += 1
            del last[shared + 1 :], size[shared + 1 :]
            for d in range(shared + 1, len(word) + 1):
                for n in ends[word[d - 1]]:
                    if n > d:
                        continue
                    token = by_length[n].get(word[d - n : d])
                    if token is None:
                        continue
                    left = last[d - n]
                    ok = pairs.get((left + 1) << 20 | token)
                    if ok or ok is None and fits(left, token):
                        last.append(token)
                        size.append(n)
                        break
                else:
                    raise ValueError("the vocabulary lacks a byte")
            ids, d = [], len(word)
            while d:
                ids.append(last[d])
                d -= size[d]
            ids.reverse()
            out[word] = ids
            before = word
        return out


class TextEncoder:
    """Encodes texts: white space and what follows it are looked up whole, and words new to it go through the trie together."""

    def __init__(self, path: str):
        self.v = Vocabulary(path)
        self.trie = TrieEncoder(self.v)
        self.words = regex.compile(PATTERN).findall
        self.segments = SEGMENT.findall
        self.special = re.compile("|".join(re.escape(s) for s in sorted(self.v.special, key=len, reverse=True))) if self.v.special else None
        self.known: dict[str, bytes] = {}
        self.text_of = self.v.bytes.__getitem__

    def _learn(self, segments: list[str]) -> None:
        split = [[w.encode("utf-8", "replace") for w in self.words(s)] for s in segments]
        ids = self.trie.encode_words(list(set().union(*split)))
        for s, words in zip(segments, split, strict=True):
            self.known[s] = np.array([i for w in words for i in ids[w]], "<u4").tobytes()

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Of each text its ids as little-endian unsigned 32-bit numbers."""
        lists = []
        for t in texts:
            if not t:
                lists.append([])
            elif self.special and self.special.search(t):
                parts, at = [], 0
                for m in self.special.finditer(t):
                    parts += [*self.segments(t[at : m.start()]), m[0]]
                    at = m.end()
                lists.append(parts + self.segments(t[at:]))
            else:
                lists.append(self.segments(t))
        fresh = set().union(*lists).difference(self.known)
        if len(self.known) + len(fresh) > CACHE:
            self.known = {}
            fresh = set().union(*lists)
        for s in fresh.intersection(self.v.special):
            self.known[s] = np.array([self.v.special[s]], "<u4").tobytes()
        self._learn(list(fresh.difference(self.v.special)))
        get = self.known.__getitem__
        return [b"".join(map(get, parts)) for parts in lists]

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.text_of, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


def encoded(docs: DataFrame, tokenizer_path: str, id_column: str = "doc_id", text_column: str = "text", keep: bool = True) -> DataFrame:
    """One row per row of docs: doc_id, n_tokens, ids_sha256, decoded_sha256, and with keep the ids (binary, unsigned 32-bit) and the decoded text."""

    common.small_batches(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = common.worker_kept(("trie", tokenizer_path), lambda: TextEncoder(tokenizer_path))
        for b in batches:
            letters = b["text"].str.len().fillna(0).cumsum() // 1_000_000
            for _, part in b.groupby(letters.to_numpy(), sort=True):
                ids = encoder.encode(part["text"].where(part["text"].notna(), None).tolist())
                texts = list(map(encoder.decode, ids))
                out = pd.DataFrame({"doc_id": part["doc_id"].astype("Int64").to_numpy(), "n_tokens": [len(x) // 4 for x in ids]})
                out["doc_id"] = out["doc_id"].astype("Int64")
                out["ids_sha256"] = [hashlib.sha256(x).hexdigest() for x in ids]
                out["decoded_sha256"] = [hashlib.sha256(t.encode()).hexdigest() for t in texts]
                if keep:
                    out["ids"], out["decoded"] = ids, texts
                yield out
        common.release()

    own = docs.select(F.col(id_column).cast("bigint").alias("doc_id"), F.col(text_column).alias("text"))
    return own.mapInPandas(run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids binary, decoded string" * keep)


def byte_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op7_trie_bpe(spark, sf_dir: str) -> DataFrame:
    return encoded(common.table(spark, sf_dir, "documents"), byte_vocabulary(), keep=False)
