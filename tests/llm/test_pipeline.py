import corpus_pipeline
from pyspark.sql import functions as F

from roadsky.llm import decontaminate, pieces, secrets, simhash, toxicity
from roadsky.llm.common import stored

SF_DIR = "/root/testdata/sf0.001"


def test_stages_act_on_all_that_is_kept(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").withColumn("n_hit", F.lit("extra"))
    labels, bench = (spark.read.parquet(f"{SF_DIR}/{t}.parquet") for t in ("labels", "benchmark"))
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "simhash near-dedup", "benchmark decontamination", "secret scans", "sentencepiece encoding and decoding"]
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stored(stage(spark, docs, SF_DIR), "stage")
        ids = {r[0] for r in docs.select("doc_id").collect()}
        all_ids = {r[0] for r in before.select("doc_id").collect()}
        if name != names[-1]:
            assert docs.columns == before.columns
        if name == "toxicity":
            scores = toxicity.toxicity_scores(before, labels)
            assert ids == {r["doc_id"] for r in scores.filter("predicted = 0").collect()} and len(ids) < len(all_ids)
        elif name == "simhash near-dedup":
            found = simhash.near_duplicates(before).collect()
            assert ids == {r["component_id"] for r in found}
        elif name == "benchmark decontamination":
            hit = decontaminate.matched(before, bench, ["doc_id"]).filter("n_hit > 0")
            assert all_ids - ids == {r["doc_id"] for r in hit.collect()}
        elif name == "secret scans":
            assert ids == all_ids
            assert secrets.with_spans(docs, {}).filter(F.size("_base") > 0).count() == 0
        else:
            assert ids == all_ids and all(r["round_trip"] for r in docs.collect())
            encoder = pieces.Encoder(pieces.Vocabulary.load())
            for r in before.limit(5).collect():
                got = docs.filter(F.col("doc_id") == r["doc_id"]).first()["ids"]
                assert encoder.encode([r["text"]])[0].tolist() == got


def test_run_gives_the_last_stage(spark):
    rows = corpus_pipeline.run(spark, SF_DIR)
    assert rows.columns == ["doc_id", "ids", "n_pieces", "round_trip"]
    assert 0 < rows.count() < 200
