import os

import pytest
from pyspark.sql import functions as F
from test_dedup import brute, families, fold
from test_text import toxic_rows

from comparing import assert_same
from prismark.llm import common, near_dedup, packing, registry, toxicity

SF = "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_its_sql(spark, name):
    assert_same(spark, registry.QUERIES[name], registry.ORACLES[name], SF)


def test_stages_keep_whole_documents(spark):
    import corpus_pipeline

    docs = common.table(spark, SF, "documents")
    seen = {r["doc_id"]: r["text"] for r in docs.collect()}
    before = set(seen)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.stored(stage(spark, docs, SF), name)
        rows = docs.collect()
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        kept = {r["doc_id"] for r in rows}
        assert kept <= before and len(kept) == len(rows) and all(seen[r["doc_id"]] == r["text"] for r in rows)
        if name == "exact_dedup":
            want = {}
            for i in before:
                key = seen[i].encode().lower()
                want[key] = max(i, want.get(key, i))
            assert kept == set(want.values())
        before = kept
    packed = corpus_pipeline.packing(spark, docs, SF).toPandas()
    assert set(packed["doc_id"]) == before and (packed.groupby("doc_id")["length"].sum() == packed.groupby("doc_id")["doc_tokens"].first()).all()


SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars int"


def written(spark, folder, rows, labels):
    spark.createDataFrame([(i, t, "en", "web", len(t or "")) for i, t in rows], SCHEMA).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")


def test_pipeline_equals_brute_force(spark, tmp_path):
    """With nulls, empty and very long texts, repeated rows and families of near copies; each stage from plain Python, but for the model's scores."""
    import corpus_pipeline

    toxic = toxic_rows(150)
    rows = [(i, t) for i, t, _ in toxic] + [(1000 + i, t) for i, t in families(4, 5, 8, words=80, edits=3)]
    rows += [(2000, None), (2001, ""), (2002, "One two"), (2003, "one TWO"), (None, "one two"), (2004, "word " * 30_000), (7, toxic[7][1]), (7, toxic[7][1]), (None, None)]
    labels = [(i, 1, y) for i, _, y in toxic] + [(None, 1, 1), (3, 0, None)]
    written(spark, tmp_path, rows, labels)
    docs, table = common.table(spark, str(tmp_path), "documents"), common.table(spark, str(tmp_path), "labels")
    model = toxicity.train(docs, table)
    kept = [(r["doc_id"], r["text"]) for r in docs.withColumn("p", toxicity.toxicity(F.col("text"), model)).where(f"p < {toxicity.THRESHOLD}").collect()]
    assert 100 < len(kept) < len(rows)
    by = {}
    for i, t in kept:
        by[fold(t)] = max((i is not None, i or 0), by.get(fold(t), (False, -1)))
    kept = [(i if some else None, t) for t, (some, i) in by.items()]
    component = {d: c for d, _, c in brute(kept, near_dedup.Threshold(4, 5, 5)) if d != -1}
    want = sorted(-1 if d is None else d for d, t in kept if d is None or component[d] in (d, -1))
    got = corpus_pipeline.run(spark, str(tmp_path)).toPandas()
    assert sorted(-1 if d != d else int(d) for d in got.loc[got["start"] == 0, "doc_id"]) == want
    ids = {d: [*packing.ChunkEncoder(packing.word_vocabulary()).tokenizer.encode(t, add_special_tokens=False).ids, 1] for d, t in kept if d in (2004, 2003)}
    assert all(got.loc[got["doc_id"] == d, "length"].sum() == len(x) for d, x in ids.items())
    assert all(s["offset"].tolist() == (s["length"].cumsum() - s["length"]).tolist() for _, s in got.sort_values("offset").groupby("sequence_id"))


def test_pipeline_of_empty_tables(spark, tmp_path):
    import corpus_pipeline

    written(spark, tmp_path, [], [])
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    for name, query in registry.QUERIES.items():
        if name not in ("op1_url_filter", "op6_warc_revisits", "op8_hamming_topk"):
            assert query(spark, str(tmp_path)).count() == 0, name
