import corpus_pipeline
from holdfast.llm.tables import saved
from tests.llm.test_simhash import brute_stay
from tests.llm.test_text_operators import brute_lines

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_on_their_own_inputs(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language_id", "line_dedup", "near_dedup", "decontamination", "packing"]
    inputs, outputs = {}, {}
    for name, stage in stages.items():
        inputs[name] = sorted((r.doc_id, r.text) for r in docs.collect())
        docs = saved(stage(spark, docs, SF))
        if name != "packing":
            assert docs.columns == COLUMNS
            assert all(r.n_chars == len(r.text) for r in docs.collect())
            outputs[name] = sorted((r.doc_id, r.text) for r in docs.collect())
    assert outputs["language_id"] == inputs["language_id"]
    assert outputs["line_dedup"] == sorted((i, t) for i, _, _, t in brute_lines(inputs["line_dedup"], 10))
    assert outputs["near_dedup"] == sorted(brute_stay(inputs["near_dedup"]))
    assert {i for i, _ in outputs["decontamination"]} == {r.doc_id for r in docs.collect()}


def test_run(spark):
    found = corpus_pipeline.run(spark, SF)
    assert {"doc_id", "start", "length", "ids", "sequence_id", "offset"} <= set(found.columns) and found.count() > 100
