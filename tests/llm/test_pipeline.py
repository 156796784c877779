"""The pipeline's stages on the smallest tables."""

from collections import Counter

import corpus_pipeline
from ledgerlark.llm import queries, toxicity
from ledgerlark.llm.common import settle


def test_stages(spark, data):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "source_mixing", "packing"]
    docs = spark.read.parquet(f"{data}/documents.parquet")
    first, seen = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        docs = settle(stage(spark, docs, data), name)
        seen.append(docs.count())
        if name != "packing":
            assert docs.columns == first
        if name == "near_dedup":
            ids = Counter(r.doc_id for r in docs.select("doc_id").collect())
            assert set(ids.values()) == {1}
        if name == "source_mixing":
            mixed = Counter(r.doc_id for r in docs.select("doc_id").collect())
            assert set(mixed) <= set(ids)
    assert {r.doc_id for r in docs.select("doc_id").distinct().collect()} == set(mixed)
    assert seen[0] >= seen[1] >= seen[2] > 0


def test_toxic_stage_rejects_what_op9_predicts_as_toxic(spark, data, monkeypatch):
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "text").orderBy("doc_id").limit(40).cache()
    plain = toxicity.SubwordBags.trained(["a b", "bad bad"] * 20, [0, 1] * 20)
    monkeypatch.setattr(toxicity, "fit", lambda *a: plain)
    monkeypatch.setattr(queries, "table", lambda spark, sf_dir, name: docs)
    scores = sorted(r.score for r in toxicity.scores(docs, plain).collect())
    assert scores[0] < scores[-1]
    shift = lambda p: float(__import__("math").log(p / (1 - p)))
    middle = scores[len(scores) // 2]
    plain.bias[1] += shift(0.4) - shift(middle)  # many scores lie between 0.3 and 0.5 now
    between = toxicity.scores(docs, plain).filter("score >= 0.3 and score < 0.5").count()
    predicted = {r.doc_id for r in queries.op9_toxicity(spark, data).filter("predicted = 1").collect()}
    kept = {r.doc_id for r in corpus_pipeline.drop_toxic(spark, docs, data).collect()}
    assert between and kept == {r.doc_id for r in docs.collect()} - predicted


def test_run_with_edge_rows(spark, tmp_path):
    """Null, empty, very long and repeated texts, and empty tables, through all stages."""
    words = [f"w{k}" for k in range(300)]
    text = lambda k: " ".join(words[(7 * k + j * j) % 300] for j in range(40))
    rows = [(k, text(k), "en", f"s{k % 3}", 1) for k in range(20)]
    rows += [(20, None, None, None, None), (21, "", "en", "s1", 0), (22, text(3).upper(), "en", "s1", 1), (23, text(4) + " more", "en", "s2", 1), (24, "long words " * 9000, "en", "s2", 1), (19, text(19), "en", "s1", 1)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/a/documents.parquet")
    spark.createDataFrame([(k, 1, 0) for k in range(10)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/a/labels.parquet")
    pieces = corpus_pipeline.run(spark, f"{tmp_path}/a").collect()
    left = {r.doc_id for r in pieces}
    assert {22, 4} <= left and not left & {3, 23} and len(left & {20, 21}) <= 1
    by_seq = Counter()
    for r in pieces:
        by_seq[r.sequence_id] += r.length
    assert all(n <= 4096 for n in by_seq.values())
    spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/b/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/b/labels.parquet")
    assert corpus_pipeline.run(spark, f"{tmp_path}/b").count() == 0
