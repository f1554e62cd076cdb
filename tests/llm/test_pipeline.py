"""The pipeline's stages over a whole small table, held against brute force."""

import corpus_pipeline
from tests.llm import brute as B

SF = "/root/testdata/sf0.001"


def test_stages_in_order_and_against_brute_force(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kinds, results = docs.dtypes, {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        results[name] = (docs, spark.read.parquet(str(tmp_path / name)))
        docs = results[name][1]
        assert name == "encode" or docs.dtypes == kinds
    rows = lambda name, side: {r["doc_id"]: r["text"] for r in results[name][side].collect()}
    assert not any(B.quality(t)[-1] for t in rows("quality", 1).values())
    before = rows("near_duplicates", 0)
    assert set(rows("near_duplicates", 1)) == {c for _, c in B.components(list(before.items())).values()}
    masked = rows("personal_data", 1)
    for d, t in rows("personal_data", 0).items():
        assert not B.pii(masked[d])
        assert (masked[d] == t) or B.pii(t) or "[" in masked[d]
    assert results["encode"][1].where("restored").count() == docs.count()


def test_run_gives_the_last_stage(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == ["doc_id", "n_pieces", "n_byte_pieces", "restored", "ids"] and out.count() > 0
