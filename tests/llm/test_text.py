"""Packing, BPE, LM, toxicity and licence operators against the library or brute force."""

import hashlib
import math
import random
import re
import textwrap
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from prismark.llm import brown_lm, license_scan, packing, toxicity, trie_bpe

tokenizers = pytest.importorskip("tokenizers")
SCHEMA = "doc_id bigint, text string, length int, ids string, words int, n int, score int, word string"
LETTERS = "abAB  \n\t\x0b\x0c.,'sé中😀 \x85\xa0　\x1c²½١İıſΣ́Å̊<|>ǅŉß"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, 1, "x", 1, 1, 1, "w") for i, t in rows], SCHEMA)


def odd_texts(n=300):
    r = random.Random(4)
    return ["".join(r.choices(LETTERS, k=r.randrange(60))) for _ in range(n)] + ["don't we'll <|endoftext|> x", "a<|endoftext|>", " " * 30, "x" * 5000, "foo, bar. Foo. É", "", None, "İ."]


ROWS = [*enumerate(odd_texts()), (None, "null id"), (3, "again"), (900, "word " * 30_000)]


def test_bpe_equals_the_library(spark):
    path = trie_bpe.byte_vocabulary()
    t = tokenizers.Tokenizer.from_file(path)
    got = {(r["doc_id"], r["ids_sha256"]): r for r in trie_bpe.encoded(docs(spark, ROWS), path).collect()}
    for i, text in ROWS:
        ids = t.encode(text or "", add_special_tokens=False).ids
        raw = np.array(ids, "<u4").tobytes()
        r = got[i, hashlib.sha256(raw).hexdigest()]
        assert r["n_tokens"] == len(ids) and bytes(r["ids"]) == raw
        assert r["decoded"] == t.decode(ids, skip_special_tokens=False) and r["decoded_sha256"] == hashlib.sha256(r["decoded"].encode()).hexdigest()
    assert trie_bpe.encoded(docs(spark, []), path).count() == 0


def test_trie_shares_prefixes():
    e = trie_bpe.TrieEncoder(trie_bpe.Vocabulary(trie_bpe.byte_vocabulary()))
    r = random.Random(0)
    words = {"".join(r.choices("etaoin shr", k=r.randrange(1, 12))).encode() for _ in range(500)}
    assert e.encode_words(list(words)) == {w: e.v.merged(w) for w in words}


def test_decode_replaces_what_is_no_utf8():
    e = trie_bpe.TextEncoder(trie_bpe.byte_vocabulary())
    t = tokenizers.Tokenizer.from_file(trie_bpe.byte_vocabulary())
    ids = [i for i, b in enumerate(e.v.bytes) if b in (b"\xc3", b"\xe4", b"a")]
    assert e.decode(np.array(ids, "<u4").tobytes()) == t.decode(ids, skip_special_tokens=False)


def test_chunk_encoder_equals_the_library():
    import pyarrow as pa

    e = packing.ChunkEncoder(packing.word_vocabulary())
    texts = [t for _, t in ROWS]
    for _ in range(2):  # new, then known
        ids, bounds = e.encode(pa.array(texts, pa.string()))
        for k, t in enumerate(texts):
            assert ids[bounds[k] : bounds[k + 1]].tolist() == e.tokenizer.encode(t or "", add_special_tokens=False).ids


def test_plain_letters_lower_as_the_library_does():
    import pyarrow as pa

    e = packing.ChunkEncoder(packing.word_vocabulary())
    letters = [chr(c) for c in [*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0xC0, 0x250)] if c not in (0xD7, 0xF7, 0x130)]
    ids, bounds = e.encode(pa.array(letters))
    assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:], strict=False)] == [e.tokenizer.encode(x, add_special_tokens=False).ids for x in letters]


@pytest.mark.parametrize("part", [20_000, 3])
def test_packing(spark, monkeypatch, part):
    monkeypatch.setattr(packing.ranked, "__defaults__", (part,))
    t = tokenizers.Tokenizer.from_file(packing.word_vocabulary())
    rows = [*ROWS, *[(1000 + k, "same text of a few words") for k in range(40)]]
    got = packing.pack(docs(spark, rows), packing.word_vocabulary(), size=64).toPandas()
    want = Counter()
    for i, text in rows:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 1]
        for a in range(0, len(ids), 64):
            want[i, a, len(ids[a : a + 64]), zlib.crc32(np.array(ids[a : a + 64], "<u4").tobytes()), len(ids)] += 1
    assert Counter((None if r.doc_id != r.doc_id else int(r.doc_id), r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got.itertuples()) == want
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        assert s["offset"].tolist() == (s["length"].cumsum() - s["length"]).tolist() and s["length"].sum() <= 64
    assert got["length"].sum() / (64 * got["sequence_id"].nunique()) > 0.95
    assert packing.pack(docs(spark, []), packing.word_vocabulary()).count() == 0


def test_shortest_pack_first_places_everything():
    r = random.Random(1)
    for _ in range(50):
        h = {r.randrange(1, 100): r.randrange(1, 50) for _ in range(r.randrange(1, 30))}
        patterns = packing.shortest_pack_first(h, 100)
        placed = Counter()
        for p, n in patterns:
            assert sum(p) <= 100
            for x in p:
                placed[x] += n
        assert placed == Counter(h)
        rows = packing.slots(patterns)
        for length, n in h.items():
            taken = sorted((a, b) for x, a, b, _, _ in rows if x == length)
            assert taken[0][0] == 0 and taken[-1][1] == n - 1 and all(b + 1 == c for (_, b), (c, _) in zip(taken, taken[1:], strict=False))


@pytest.mark.parametrize("head", [131_072, 30])
def test_brown_counts_and_scores(spark, monkeypatch, head):
    monkeypatch.setattr(brown_lm, "HEAD", head)
    r = random.Random(5)
    text = lambda a: " ".join(f"{a}{min(r.randrange(30), r.randrange(30))}" for _ in range(r.randrange(5, 40)))
    rows = [(i, text("ab"[i % 2])) for i in range(300)] + [(1000, None), (1001, ""), (1002, "É\x0bÉ x" + "y" * 200), (None, "a1 a2"), (5, "a1"), (7, "new words only here")]
    got = brown_lm.brown_scores(docs(spark, rows)).collect()
    own = lambda t: [*(t or "").encode().lower().split(), None]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    c = Counter(w for i, t in rows if not held(i) for w in own(t))
    n, v = sum(c.values()), len(c)
    want = sorted((-1 if i is None else i, held(i), len(own(t)), sum(c[w] > 0 for w in own(t)), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in own(t)), 6)) for i, t in rows)
    assert sorted((-1 if x["doc_id"] is None else x["doc_id"], x["held_out"], x["n_tokens"], x["n_known"], x["train_tokens"], round(x["base_score"], 6)) for x in got) == want
    per = lambda k: sum(x[k] for x in got if x["held_out"]) / sum(x["n_tokens"] for x in got if x["held_out"])
    assert per("score") > per("base_score") + 0.1  # two languages: the class before tells which


def test_brown_classes_do_not_depend_on_the_dictionary(spark, monkeypatch):
    """Words that are not sent to all tasks have classes of their own: scores are the same as if all were sent."""
    monkeypatch.setattr(brown_lm, "CORE", 12)
    r = random.Random(9)
    text = lambda a: " ".join(f"{a}{int(r.expovariate(0.05))}ness" for _ in range(r.randrange(5, 40)))
    rows = [(i, text("ab"[i % 2])) for i in range(300)] + [(1000, None), (1001, "new words a1ness"), (None, "a1ness lone"), (1002, "x" * 90 + " b2ness")]
    scores = []
    for head in (131_072, 40, 12):
        monkeypatch.setattr(brown_lm, "HEAD", head)
        scores.append(sorted((-1 if x["doc_id"] is None else x["doc_id"], x["n_known"], round(x["score"], 8)) for x in brown_lm.brown_scores(docs(spark, rows)).collect()))
    assert scores[0] == scores[1] == scores[2]


@pytest.mark.parametrize("head", [131_072, 30])
def test_brown_scores_equal_brute_force(spark, monkeypatch, head):
    """Scores from plain dictionaries, given the classes of words and endings."""
    monkeypatch.setattr(brown_lm, "HEAD", head)
    monkeypatch.setattr(brown_lm, "CORE", 25)
    r = random.Random(8)
    text = lambda a: " ".join(f"{a}{int(r.expovariate(0.06))}" for _ in range(r.randrange(0, 30)))
    rows = [(i, text("ab"[i % 2])) for i in range(200)] + [(900, None), (901, "new a1 words b2"), (None, "a1 " + "z" * 90)]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    own = lambda t: [*(t or "").encode().lower().split(), None]
    df = docs(spark, rows).withColumn("held_out", F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7 == 2, F.lit(False))).select("doc_id", "held_out", "text")
    training = df.where("NOT held_out")
    words = brown_lm.word_counts(training).cache()
    types, in_tail = brown_lm.head_and_endings(words, training.count())
    codes = brown_lm.encoded(df, types)
    found = brown_lm.clustered(codes.where("NOT held_out"), types, words.where(in_tail))
    of = {w: int(c) for w, c in zip(types.words, found.of, strict=False)} | {bytes(x["word"]): x["class"] for x in found.tail.collect()} | {None: int(found.of[-1])}
    endings = found.of[len(types.words) : -1]
    class_of = lambda w: of[w] if w in of else int(endings[brown_lm.ending(w)])
    k = len(found.counts)
    train = [own(t) for i, t in rows if not held(i)]
    count = Counter(w for t in train for w in t)
    steps = Counter((class_of(a), class_of(b)) for t in train for a, b in zip([None, *t], t, strict=False))
    size, kinds = Counter(), Counter()
    for w, n in count.items():
        size[class_of(w)] += n
        kinds[class_of(w)] += 1
    total = sum(size.values())

    def score(t):
        out = 0.0
        for a, b in zip([None, *own(t)], own(t), strict=False):
            x, y = class_of(a), class_of(b)
            share = (size[y] + 1) / (total + k)
            out += math.log10((steps[x, y] + k * share) / (sum(steps[x, z] for z in range(k)) + k)) + math.log10((count[b] + 1) / (size[y] + kinds[y] + 1))
        return out

    placed = brown_lm.placed(codes, found)
    got = brown_lm.scored(placed, types, brown_lm.fit(placed.where("NOT held_out"), types, found)).collect()
    want = sorted((-1 if i is None else i, round(score(t), 6)) for i, t in rows)
    assert sorted((-1 if x["doc_id"] is None else x["doc_id"], round(x["score"], 6)) for x in got) == want


def test_brown_core_is_whole():
    assert brown_lm.CORE >= 2048


def test_brown_model_is_a_distribution(spark):
    """Over the training words and one unseen word a class, the chances after any class add up to 1."""
    r = random.Random(6)
    rows = [(i, " ".join(f"w{min(r.randrange(20), r.randrange(20))}" for _ in range(20))) for i in range(50)]
    words = brown_lm.word_counts(docs(spark, rows)).cache()
    types, _ = brown_lm.head_and_endings(words, len(rows))
    codes = brown_lm.encoded(docs(spark, rows).selectExpr("doc_id", "false AS held_out", "text"), types)
    m = brown_lm.fit(codes, types)
    seen = np.flatnonzero(types.counts > 0)
    k = len(m.transitions)
    unseen = 1 / (np.bincount(m.classes, types.counts, k) + np.bincount(m.classes, types.kinds, k) + 1)
    emitted = np.bincount(m.classes[seen], 10 ** m.emissions[seen], k) + unseen
    assert np.allclose(10**m.transitions @ emitted, 1)


def test_exchange_raises_likelihood():
    rng = np.random.default_rng(0)
    true = np.arange(60) % 4
    b = rng.poisson(np.where((true[:, None] + 1) % 4 == true[None], 20, 0.2)).astype(float)
    of = brown_lm.exchange(b, 4)
    assert len({(x, y) for x, y in zip(true, of, strict=True)}) == 4
    assert brown_lm.exchange(np.zeros((3, 3)), 8).tolist() == [0, 1, 2]


def test_brown_without_training_or_rows(spark):
    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    r = brown_lm.brown_scores(docs(spark, [(held, "a b")])).first()
    assert (r["n_known"], r["train_tokens"], r["base_score"]) == (0, 0, 0.0)
    assert brown_lm.brown_scores(docs(spark, [])).count() == 0


def toxic_rows(n=400):
    r = random.Random(7)
    word = lambda p: p + "".join(r.choice(["an", "er", "ti", "on", "sh", "le"]) for _ in range(r.randrange(1, 4)))
    rows = []
    for i in range(n):
        bad = i % 5 == 0
        own = [word("grubb" if bad and r.random() < 0.1 else r.choice(["th", "a", "re", "in"])) for _ in range(r.randrange(20, 200))]
        rows.append((i, " ".join([*own, "grubbanti"] if bad else own), int(bad)))
    return rows


def test_toxicity_finds_new_words_of_a_known_stem(spark):
    rows = toxic_rows()
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (3, 7), (10, None)], "doc_id bigint, toxic int")
    df = docs(spark, [(i, t) for i, t, _ in rows] + [(5000, None), (5001, ""), (5002, "12 34 !"), (None, "theran an"), (5003, "grubb" + "x" * 100_000)])
    model = toxicity.train(df, labels)
    got = df.select("doc_id", toxicity.toxicity(df["text"], model).alias("p")).toPandas()
    y = {i: v for i, _, v in rows}
    held = got[got["doc_id"].map(lambda i: i == i and i < 5000 and zlib.crc32(str(int(i)).encode()) % 4 == 2)]
    assert ((held["p"] >= 0.3).astype(int) == held["doc_id"].map(lambda i: y[int(i)])).mean() > 0.95
    assert got["p"].between(0, 1).all() and (got[got["doc_id"].isin([5000, 5001, 5002])]["p"] < 0.3).all()
    kept = toxicity.keep_ordinary(df, labels)
    assert kept.columns == df.columns and abs(kept.count() - (got["p"] < 0.3).sum()) == 0


def test_toxicity_without_labels(spark):
    df = docs(spark, [(1, "a"), (2, None)])
    none = spark.createDataFrame([], "doc_id bigint, toxic int")
    assert toxicity.train(df, none) is None and toxicity.keep_ordinary(df, none).count() == 2
    assert toxicity.train(df.limit(0), spark.createDataFrame([(1, 1), (4, 0)], "doc_id bigint, toxic int")) is None


def test_kneser_ney_sums_to_one():
    """After any context the chances of all letters and the word's end, with an unknown letter, add up to 1."""
    words = ["abc", "abd", "b", "ca"]
    m = toxicity.Model.trained(words, np.array([1, 0, 2, 0]), np.array([0, 3, 1, 1]))
    letters = ["a", "b", "c", "d", "\x03"]
    for context in ("", "a", "ab", "zz"):
        total = np.zeros(2)
        for x in letters:
            whole = toxicity.grams([context + x if x != "\x03" else context], toxicity.ORDER)[1]
            at = len(context)
            below = np.full(1, 1 / (len(m.shared[0].grams.keys) + 1))
            for counts in m.shared:
                k, c = next(whole)
                below = counts.smoothed(k[at : at + 1], c[at : at + 1], below)
            k, c = next(whole)
            total += [t.smoothed(k[at : at + 1], c[at : at + 1], below)[0] for t in (m.toxic, m.ordinary)]
        assert (total <= 1 + 1e-9).all() and (total > 0.85).all()


def brute_kneser_ney(words, counts):
    """The log-likelihood of a word by interpolated Kneser-Ney from plain dictionaries. words: all distinct training words; counts: by word, of the class."""
    order, d = toxicity.ORDER, toxicity.DISCOUNT

    def grams_of(w, n):
        x = "\x02" * (order - 1) + w + "\x03"
        return [x[i - n + 1 : i + 1] for i in range(order - 1, len(x))]

    levels = []
    for n in range(1, order):  # grams of n letters count once for each gram of n + 1 letters that ends in them
        longer = {g for w in words for g in grams_of(w, n + 1)}
        levels.append(Counter(g[1:] for g in longer))
    top = Counter()
    for w, c in counts.items():
        for g in grams_of(w, order):
            top[g] += c
    levels.append(top)
    about = []
    for level in levels:
        total, kinds = Counter(), Counter()
        for g, c in level.items():
            if c:
                total[g[:-1]] += c
                kinds[g[:-1]] += 1
        about.append((total, kinds))

    def likelihood(word):
        out = 0.0
        for k, _ in enumerate(grams_of(word, 1)):
            p = 1 / (len(levels[0]) + 1)
            for n in range(1, order + 1):
                g = grams_of(word, n)[k]
                (total, kinds), c = about[n - 1], levels[n - 1].get(g, 0)
                if total[g[:-1]]:
                    p = (max(c - d, 0) + d * kinds[g[:-1]] * p) / total[g[:-1]]
            out += math.log(p)
        return out

    return likelihood


def test_kneser_ney_equals_brute_force(spark):
    """Words' likelihoods, and texts' scores at a given tolerance and curve, from dictionaries."""
    r = random.Random(12)
    words = sorted({"".join(r.choices("abcdé", k=r.randrange(1, 8))) for _ in range(60)})
    toxic, ordinary = np.array([r.randrange(4) for _ in words]), np.array([r.randrange(4) for _ in words])
    m = toxicity.Model.trained(words, toxic, ordinary)
    sides = [brute_kneser_ney(words, dict(zip(words, n.tolist(), strict=True))) for n in (toxic, ordinary)]
    others = ["zz", "abcdefgh", "é", "a", *("".join(r.choices("abcdéx", k=6)) for _ in range(20))]
    assert np.allclose(m.words(words + others), [[f(w) for f in sides] for w in words + others], rtol=1e-4)
    m.tolerance, m.slope, m.intercept = 1.0, 0.7, -0.2
    rows = [(i, " ".join(r.choices(words + others, k=r.randrange(12)))) for i in range(40)] + [(99, None), (100, "12 !")]
    got = {x["doc_id"]: x["p"] for x in docs(spark, rows).select("doc_id", toxicity.toxicity(F.col("text"), m).alias("p")).collect()}
    for i, t in rows:
        own = [sides[0](w) - sides[1](w) for w in toxicity.words_of(t)]
        x = sum(max(e - 1, 0) - max(-e - 1, 0) for e in own) / len(own) if own else 0
        assert math.isclose(got[i], 1 / (1 + math.exp(-(0.7 * x - 0.2))), rel_tol=1e-3)


def test_toxicity_counts_ordinary_evidence():
    """Ordinary words speak against a text as toxic ones speak for it."""
    m = toxicity.Model.trained(["bad", "good", "so"], np.array([50, 0, 9]), np.array([0, 50, 9]))
    x = toxicity.Scorer(m).compared(["bad so", "bad so good good", "good", "", None], (0.0, 1.0))
    assert (x[0] > x[1]).all() and (x[2] < 0).all() and (x[3:] == 0).all()


MIT = """MIT License

Copyright (c) someone

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.
"""


def test_licences(spark):
    rows = [
        (1, MIT), (2, "Some text. Released under the MIT License. More."), (3, "x\nLicensed under CC BY-NC 4.0.\nLicensed under CC BY-NC 4.0.\n"),
        (4, None), (5, ""), (6, "the licence of nothing"), (7, "LICENSED UNDER THE\nAPACHE LICENSE, VERSION 2.0"), (None, "Released under the MIT License."), (2, "Released under the MIT License."),
        (8, "GNU GENERAL PUBLIC LICENSE\n\nVersion 3, 29 June 2007\n"), (9, "Version 3, 29 June 2007\nGNU General Public License"),
    ]
    got = sorted((-1 if r["doc_id"] is None else r["doc_id"], r["rules"], r["licences"]) for r in license_scan.scanned(docs(spark, rows)).collect())
    assert got == [
        (-1, "mit-note:1", "MIT"), (1, "mit-full:1 mit-title:1", "MIT"), (2, "mit-note:1", "MIT"), (2, "mit-note:1", "MIT"), (3, "cc-by-nc:2", "CC-BY-NC-4.0"),
        (7, "apache-note:1", "Apache-2.0"), (8, "gpl3-title:1", "GPL-3.0-only"), (9, "", ""),
    ]
    assert license_scan.scanned(docs(spark, [])).count() == 0


GPL3 = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.\n\nThis program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."
GPL2 = GPL3.replace("software:", "software;").replace("Foundation, either version 3", "Foundation; either version 2")
MPL = "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."


def wrapped(text, width):
    return "\n\n".join(textwrap.fill(p, width) for p in text.split("\n\n"))


@pytest.mark.parametrize("width", [40, 72, 79, 10_000])
def test_licences_with_stops_inside(spark, width):
    rows = [(i, wrapped(t, width)) for i, t in enumerate([GPL3, GPL2, MPL, "This program is free software: so there."])]
    got = {r["doc_id"]: (r["rules"], r["licences"]) for r in license_scan.scanned(docs(spark, rows)).collect()}
    assert got == {0: ("gpl3-header:1", "GPL-3.0-or-later"), 1: ("gpl2-header:1", "GPL-2.0-or-later"), 2: ("mpl-terms:1", "MPL-2.0")}


def brute_licences(text):
    """Word by word, from the rule: the identifiers and the rules' counts."""
    words, behind = [], []
    for m in re.finditer("[a-z0-9]+|[.!?;:]+[ \t\r\n]+|\n", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "") + "\n"):
        if m[0][0].isalnum():
            words.append(m[0])
            behind.append(0)
        elif words:
            behind[-1] = 2 if m[0][0] in ".!?;:" else min(2, behind[-1] + 1)
    ids, i = [], 0
    while i < len(words):
        best = None
        if not i or behind[i - 1]:
            for s, name in license_scan.SENTENCES.items():
                own = s.split()
                n = len(own)
                most = 2 if name in license_scan.INNER_STOPS else 1
                if words[i : i + n] == own and behind[i + n - 1] and max(behind[i : i + n - 1], default=0) <= most and (best is None or n > best[0]):
                    best = (n, name)
        if best:
            ids.append(best[1])
        i += best[0] if best else 1
    left, counts = list(ids), {}
    for rule, _, wanted in license_scan.RULES:
        k = 0
        while k + len(wanted) <= len(left):
            if left[k : k + len(wanted)] == wanted:
                left[k : k + len(wanted)] = ["#"]
                counts[rule] = counts.get(rule, 0) + 1
            k += 1
    return " ".join(ids), " ".join(f"{k}:{v}" for k, v in counts.items())


def test_licences_equal_brute_force(spark):
    r = random.Random(3)
    notices = [MIT, GPL3, GPL2, MPL, APACHE, "All rights reserved.", "Released under CC0!", "SPDX-License-Identifier: MIT", "Version 2, June 1991", "some words", "license", ""]
    notices += [" * " + APACHE.replace("\n", "\n * ") + "/", "// " + MIT.replace("\n", "\n// "), "\x01The MIT License\x01 x"]
    rows = []
    for i in range(300):
        text = ""
        for _ in range(r.randrange(1, 6)):
            own = r.choice(notices)
            if r.random() < 0.5:
                own = wrapped(own, r.choice([20, 50, 130]))
            if r.random() < 0.2:
                own = own.upper()
            if r.random() < 0.2 and own:
                k = r.randrange(len(own))
                own = own[:k] + r.choice([" ", "\n", ". ", "x", "\n\n", ", "]) + own[k:]
            text += own + r.choice(["", " ", "\n", "\n\n", ". ", "\r\n", "x"])
        rows.append((i, text))
    got = {x["doc_id"]: (x["sentence_ids"], x["rules"]) for x in license_scan.scanned(docs(spark, rows)).collect()}
    assert got == {i: want for i, t in rows if (want := brute_licences(t))[0]}
    assert len({x for _, x in got.values()}) > 20


def test_every_rule_has_sentences_and_a_telling_word():
    known = set(license_scan.SENTENCES.values())
    assert all(set(ids) <= known for _, _, ids in license_scan.RULES) and license_scan.INNER_STOPS <= known
    telling = license_scan.telling_words(list(license_scan.SENTENCES))
    assert all(any(w in s for w in telling) for s in license_scan.SENTENCES)


APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License.
"""


def test_licences_keep_order_and_repeats(spark):
    """Wrapped sentences stand where they stand in the text, as often as they do."""
    mit = MIT.split("\n\n", 2)[2]
    flat = "\n\n".join(" ".join(p.split()) for p in mit.split("\n\n"))
    rows = [(1, wrapped(flat, 130)), (2, wrapped(mit + "\n\n" + mit, 70)), (3, flat + "\n\n" + flat), (4, APACHE + "\n\n" + APACHE), (5, mit + "\n\n" + flat)]
    got = {r["doc_id"]: r["rules"] for r in license_scan.scanned(docs(spark, rows)).collect()}
    assert got == {1: "mit-full:1", 2: "mit-full:2", 3: "mit-full:2", 4: "apache-header:2", 5: "mit-full:2"}


def test_licences_with_neighbours_and_comment_signs(spark):
    rows = [(1, APACHE + "All rights reserved."), (2, "/*\n * " + APACHE.replace("\n", "\n * ") + "*/"), (3, "MIT License\n" + MIT.split("\n\n", 2)[2]), (4, "Copyright x. All rights reserved.\n" + APACHE)]
    got = {r["doc_id"]: r["rules"] for r in license_scan.scanned(docs(spark, rows)).collect()}
    assert got == {1: "apache-header:1", 2: "apache-header:1", 3: "mit-full:1 mit-title:1", 4: "apache-header:1"}
