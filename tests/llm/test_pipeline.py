import corpus_pipeline
import pytest
from logtide.llm import registry
from tests.conftest import SF001
from tests.llm import cases


def test_stages_take_effect(spark):
    docs = cases.documents(spark).select("doc_id", "text", "lang", "source", "n_chars", "score", "size")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    steps, frame = {}, docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        frame = stage(spark, frame, "unused")
        assert frame.columns == docs.columns
        frame = spark.createDataFrame(frame.collect(), docs.schema)
        steps[name] = frame.collect()
    ids = lambda name: [r.doc_id for r in steps[name]]
    assert not {100, 101, 102, 104} & set(ids("language")) and {1, 2, 3, 103, 105} <= set(ids("language"))
    assert 5 in ids("near duplicates") and not {111, 112, 113} & set(ids("near duplicates"))
    cut = {r.doc_id: r for r in steps["repeated passages"]}
    before = {r.doc_id: r for r in steps["near duplicates"]}
    assert cut[108].text == before[108].text and 110 not in cut  # the first has the passage; the bare one goes
    assert len(cut[109].text.split()) == 30 and cut[109].n_chars == len(cut[109].text)
    assert all(cut[d].text == before[d].text for d in range(1, 60) if d in cut and d != 7)
    assert set(ids("mix")) <= set(cut)
    assert corpus_pipeline.STAGES[-1][1](spark, frame, "unused").count() >= len(steps["mix"])


def test_run_and_empty(spark, tmp_dir):
    out = corpus_pipeline.run(spark, SF001)
    assert {"doc_id", "start", "length", "ids", "sequence_id", "offset"} <= set(out.columns) and out.count() > 100
    folder = cases.save(cases.empty(spark), tmp_dir)
    assert corpus_pipeline.run(spark, folder).count() == 0


@pytest.mark.parametrize("n", range(1, 11))
def test_registered(n):
    assert sum(name.startswith(f"op{n}_") for name in registry.QUERIES) == 1
