"""URL filter, WARC archives and Hamming search."""

import base64
import gzip
import hashlib
import random
import zlib

import numpy as np
import pytest

from prismark.llm import common, hamming_search, url_filter, warc


def test_rules_and_parts(spark):
    urls = [
        (1, "https://a.example.org/es/1"), (2, "http://EXAMPLE.org/en/12?x#y"), (3, "http://x.org"), (4, "http://x.org/"), (5, "https://b.com/de/?q"), (6, "https://b.com/fr"),
        (7, None), (8, "no scheme"), (9, "http://notexample.org/es/"), (10, "ftp://c.net/a?b://d"), (11, "http://h.com?q=/de/"), (12, "http://org/x"), (None, "http://x.org/a"), (1, "https://a.example.org/es/1"), (13, "É://Ä.ORG/es"),
        (14, "http://x.org/" + "y" * 100_000),
    ]
    df = spark.createDataFrame([(i, u, "h", "p", 1.0) for i, u in urls], "page_id bigint, url string, host string, path string, score double")
    got = {r["page_id"]: r for r in url_filter.judged(df, url_filter.RULES).collect()}

    def want(u):
        rest = u.partition("://")[2] if u and "://" in u else ""
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:]
        path = path[: min([path.find(c) for c in "?#" if c in path], default=len(path))]
        best = None
        for verdict, rule in url_filter.RULES:
            h, _, p = rule.partition("/")
            if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(rule) > len(best[1])):
                best = (verdict, rule)
        return host, path, best

    for i, u in urls:
        host, path, best = want(u)
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, best and best[1])
        assert got[i]["verdict"] in ("allow", "block") and (best is None or got[i]["verdict"] == best[0])
    assert got[3]["rule"] is None and got[2]["rule"] == "example.org/en/1"
    assert url_filter.judged(df.limit(0), url_filter.RULES).count() == 0


def test_trees_learn_and_generalise(spark):
    r = random.Random(1)
    rows = []
    for i in range(3000):
        bad = r.random() < 0.4
        host = f"{'x9' if bad else 'ab'}{r.randrange(10**6) if bad else ''}{r.choice('abcdef')}.site{r.randrange(50)}.net"
        rows.append((f"http://{host}/{r.randrange(9)}/" + ("?a=1&b=2&c=3" if bad and r.random() < 0.7 else ""), host, "/1/", int(bad)))
    df = spark.createDataFrame(rows, "url string, host string, path string, block int")
    model = url_filter.train(df, 1500)
    p = model.of(*map(list, zip(*[x[:3] for x in rows], strict=True)))
    assert ((p > 0.5) == np.array([x[3] for x in rows])).mean() > 0.97
    assert url_filter.train(df.where("block = 1")).of(["u"], ["h"], ["/"])[0] == 1


def test_trees_split_and_predict_as_brute_force_does():
    rng = np.random.default_rng(5)
    x = np.stack([rng.integers(0, 9, 300), rng.random(300), rng.integers(0, 2, 300)], 1).astype(float)
    y = ((x[:, 1] > 0.6) ^ (rng.random(300) < 0.1)).astype(float)
    t = url_filter.Trees(rounds=1, depth=1).fit(x, y)
    p = y.mean()
    best = max(
        (sum((y[m] - p).sum() ** 2 / (m.sum() * p * (1 - p) + 1) for m in (x[:, k] <= e, x[:, k] > e)), k, e)
        for k in range(3) for e in t.edges[k] if min((x[:, k] <= e).sum(), (x[:, k] > e).sum()) * p * (1 - p) >= t.least
    )
    feature, cut, value = t.trees[0]
    assert feature[0] == best[1] and np.isclose(t.edges[feature[0]][cut[0]], best[2])
    for side in (x[:, best[1]] <= best[2], x[:, best[1]] > best[2]):
        leaf = t.rate * (y[side] - p).sum() / (side.sum() * p * (1 - p) + 1)
        assert np.allclose(t.predict(x)[side], 1 / (1 + np.exp(-(t.base + leaf))))
    deep = url_filter.Trees(rounds=7, depth=3).fit(x, y)
    for row, got in zip(x, deep.predict(x), strict=True):
        score = deep.base
        for feature, cut, value in deep.trees:
            node = 0
            while node < 7:
                k = feature[node]
                node = 2 * node + 1 + int(cut[node] < len(deep.edges[k]) and row[k] > deep.edges[k][min(cut[node], len(deep.edges[k]) - 1)])
            score += value[node - 7]
        assert np.isclose(got, 1 / (1 + np.exp(-score)))


def test_features_equal_plain_ones():
    """Each feature from its definition, one url at a time."""
    import math

    urls = ["https://A1.b-c.net/x9/yy.html?q=1&r=2#f", "http://h.org", "ftp://h/é/", ""]
    hosts, paths = ["a1.b-c.net", "h.org", "h", ""], ["/x9/yy.html", "", "/é/", ""]
    m = url_filter.UrlModel(urls[:2], hosts[:2], paths[:2], np.array([1.0, 0.0]))
    got = dict(zip(url_filter.NAMES, m.features(urls, hosts, paths).T.tolist(), strict=True))
    assert got["length"] == [len(u) for u in urls] and got["depth"] == [2, 0, 1, 0] and got["labels"] == [3, 2, 1, 1] and got["parameters"] == [2, 0, 0, 0]
    assert got["query_length"] == [7, 0, 0, 0] and got["hyphens"] == [1, 0, 0, 0] and got["fragment"] == [1, 0, 0, 0] and got["secure"] == [1, 0, 0, 0] and got["file_ending"] == [1, 0, 0, 0]
    assert got["digit_ratio"] == [4 / len(urls[0]), 0, 0, 0] and got["host_digits"] == [1, 0, 0, 0] and got["path_digits"] == [1, 0, 0, 0] and got["longest_segment"] == [7, 0, 1, 0]
    for u, e in zip(urls, got["entropy"], strict=True):
        assert math.isclose(e, -sum(u.count(c) / len(u) * math.log2(u.count(c) / len(u)) for c in set(u)), abs_tol=1e-9)
    assert got["suffix1"][0] == (1 + 2 * 0.5) / 3 and got["suffix1"][1] == (0 + 2 * 0.5) / 3 and got["suffix1"][2] == 0.5


def test_odd_urls_with_trained_trees(spark):
    """Null urls and urls without a scheme are judged by the trees, like all that no rule covers."""
    urls = [f"http://a{i}.example.org/es/{i}" for i in range(80)] + [f"http://b{i}.site.org/{i}" for i in range(80)] + [None, None, "", "x", "http://" + "q" * 50_000 + ".net/", "http://b1.site.net/1"]
    df = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string")
    got = {r["page_id"]: r for r in url_filter.judged(df, url_filter.RULES).collect()}
    assert len(got) == len(urls)
    for i in range(160, len(urls)):
        assert got[i]["rule"] is None and got[i]["verdict"] == ("block" if got[i]["score"] > 0.5 else "allow") and 0 <= got[i]["score"] <= 1
    assert got[160]["score"] == got[161]["score"] and got[160]["host"] == got[160]["path"] == ""


def test_warc_round_trip_and_revisits(spark):
    tricky = "a\r\n\r\nWARC/1.0\r\nContent-Length: 5\r\n\r\nb"
    rows = [(1, "http://a", "x"), (2, "http://b", "x"), (3, None, None), (4, "http://d", ""), (5, "u\r\nX: y", tricky), (6, "http://f", tricky), (7, "é", "é€😀"), (8, "http://h", "z" * 500_000), (2, "http://b", "x"), (None, "http://n", "x"), (None, "http://m", "only"), (9, "k", "\n")]
    df = spark.createDataFrame([(i, u, h, "c", 1) for i, u, h in rows], "page_id bigint, url string, html string, payload string, record_type int")
    path = common.scratch(spark, "warc-test")
    got = warc.deduplicated_archives(df.repartition(3), path).collect()
    assert len(got) == len(rows)
    by = {}
    for i, _, h in rows:
        by.setdefault((h or "").encode(), []).append(i)
    for payload, ids in by.items():
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        own = [r for r in got if r["payload_digest"] == digest]
        assert sorted(r["page_id"] or -1 for r in own) == sorted(i or -1 for i in ids) and all(r["payload_bytes"] == len(payload) for r in own)
        top = max((i for i in ids if i is not None), default=None)
        assert [r["page_id"] for r in own if r["record_type"] == "response"] == [top]
        assert all(r["refers_to"] == top for r in own if r["record_type"] == "revisit")
    records = [(h, block) for r in warc.archives(spark, path).collect() for h, block, _ in warc.parsed(bytes(r["content"]))]
    ids = {h["warc-record-id"]: h for h, _ in records}
    assert len(ids) == len(rows)
    for h, block in records:
        if h["warc-type"] == "revisit":  # the record it names is a response with the same payload
            o = ids[h["warc-refers-to"]]
            assert o["warc-type"] == "response" and o["warc-payload-digest"] == h["warc-payload-digest"] and o.get("warc-target-uri") == h.get("warc-refers-to-target-uri") and o["warc-date"] == h["warc-refers-to-date"]
            assert h.get("warc-profile") == warc.PROFILE
        else:
            assert "warc-refers-to" not in h
    for content in [r["content"] for r in warc.archives(spark, path).collect()]:
        for h, block, _ in warc.parsed(bytes(content)):
            assert h["warc-type"] == "revisit" and block == b"" or h["warc-payload-digest"] == "sha1:" + warc.payload_digest(block)
    least = warc.deduplicated_archives(df, common.scratch(spark, "warc-test"), min_bytes=2).collect()
    assert all(r["record_type"] == "response" for r in least if r["payload_bytes"] < 2) and any(r["record_type"] == "revisit" for r in least)
    assert warc.deduplicated_archives(df.limit(0), common.scratch(spark, "warc-test")).count() == 0


def test_warc_a_member_a_record_and_bounded_archives(spark):
    """Each record is a gzip member that begins and ends with it; archives are bounded by records and bytes, and a great record stands alone."""
    rng = np.random.default_rng(1)
    rows = [(i, f"http://h/{i}", rng.bytes(3000).hex()) for i in range(40)] + [(100, "http://big", rng.bytes(2_000_000).hex())]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").coalesce(1)
    path = common.scratch(spark, "warc-test")
    assert warc.deduplicated_archives(df, path, records_per_file=15, bytes_per_file=30_000).count() == 41
    seen = 0
    for content in [bytes(r["content"]) for r in warc.archives(spark, path).collect()]:
        own = list(warc.parsed(content))
        assert len(own) <= 15 and (len(content) < 32_000 or len(own) == 1)
        assert gzip.decompress(content).startswith(b"WARC/1.0\r\n")
        z = zlib.decompressobj(31)
        first = z.decompress(content)
        assert z.eof and first.endswith(b"\r\n\r\n") and first.count(b"WARC/1.0\r\n") == 1
        seen += len(own)
    assert seen == 41
    with pytest.raises(ValueError, match="cut off"):
        list(warc.parsed(content[:-30]))


def test_warc_great_payload(spark):
    n = 50_000_000
    df = spark.range(2).selectExpr("id AS page_id", "'http://x' AS url", f"concat(repeat('ab', {n // 2}), if(id = 2, 'x', '')) AS html")
    got = sorted(tuple(r) for r in warc.deduplicated_archives(df, common.scratch(spark, "warc-test")).select("page_id", "payload_bytes", "record_type", "refers_to").collect())
    assert got == [(0, n, "revisit", 1), (1, n, "response", None)]


@pytest.mark.parametrize(("width", "bits_each"), [(64, None), (64, 16), (20, 5), (20, 8), (7, 7)])
def test_hamming_equals_brute_force(spark, width, bits_each):
    rng = np.random.default_rng(width)
    bits = rng.integers(0, 2, (300, width))
    bits[100:200] = bits[0]  # a third of all rows share a code
    codes = ["".join(map(str, b)) for b in bits]
    rows = spark.createDataFrame([(i * 3, c) for i, c in enumerate(codes)], "id bigint, code string")
    got = hamming_search.top_k(rows, rows.where("id % 20 = 0"), 12, segment_bits=bits_each, queries_per_block=4).collect()
    for q in range(0, 300, 20):
        d = (bits != bits[q]).sum(1)
        want = [(int(i) * 3, int(d[i])) for i in np.lexsort((np.arange(300), d))[:12]]
        own = sorted((r["rank"], r["id"], r["distance"]) for r in got if r["query_id"] == q * 3)
        assert [(i, x) for _, i, x in own] == want
    assert hamming_search.top_k(rows.limit(0), rows, 3).count() == 0 and hamming_search.top_k(rows, rows.limit(0), 3).count() == 0


@pytest.mark.parametrize("visits", [1, 100])
def test_hamming_proves_near_queries_without_meeting_all(spark, monkeypatch, visits):
    """Clusters of near codes are proved at a small radius; a segment value that a third of all share is split. With more visits a round takes more radii."""
    rng = np.random.default_rng(3)
    centres = rng.integers(0, 2, (40, 64))
    bits = np.repeat(centres, 25, 0) ^ (rng.random((1000, 64)) < 0.03)
    bits[::3, :20] = 1
    codes = ["".join(map(str, b)) for b in bits]
    rows = spark.createDataFrame(list(enumerate(codes)), "id bigint, code string")
    monkeypatch.setattr(hamming_search, "SPLIT", 50)
    radii = []
    met = hamming_search.Index.met
    monkeypatch.setattr(hamming_search.Index, "met", lambda self, q, r: radii.append((r[0], q.count())) or met(self, q, r))
    monkeypatch.setattr(hamming_search, "VISITS", visits)
    got = hamming_search.top_k(rows, rows.where("id % 20 = 0"), 30).collect()
    for q in range(0, 1000, 20):
        d = (bits != bits[q]).sum(1)
        want = [(int(i), int(d[i])) for i in np.lexsort((np.arange(1000), d))[:30]]
        assert [(r["id"], r["distance"]) for r in sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])] == want
    assert radii[0] == (0, 50) and len(radii) > 1 and all(a[0] < b[0] and a[1] >= b[1] for a, b in zip(radii, radii[1:], strict=False))


def test_hamming_odd_rows(spark):
    rows = spark.createDataFrame([(1, "1" * 64), (1, "1" * 64), (None, "1" * 64), (3, None), (2, "0" * 64)], "id bigint, code string")
    got = sorted((r["query_id"], r["rank"], r["id"], r["distance"]) for r in hamming_search.top_k(rows, rows, 4).collect())
    assert got == [(1, 1, 1, 0), (1, 2, 1, 0), (1, 3, 2, 64), (2, 1, 2, 0), (2, 2, 1, 64), (2, 3, 1, 64)]
    mixed = spark.createDataFrame([(1, "1" * 63), (2, "1" * 65), (3, "1" * 64)], "id bigint, code string")
    for a, b in ((mixed, mixed), (rows, mixed.where("id = 1"))):
        with pytest.raises(ValueError, match="cannot be compared"):
            hamming_search.top_k(a, b, 2)


def test_codes_of_odd_vectors(spark):
    df = spark.createDataFrame([([0.5, -1.0, 0.0, float("nan"), None],)], "v array<float>")
    assert df.select(hamming_search.code(df["v"])).first()[0] == "10000"
