"""The pipeline's stages and its whole run on a small table, held against the operators and plain versions."""

import sys
from collections import Counter

import pytest

sys.path.insert(0, __file__.rpartition("/")[0])
from fixtures import documents, empty  # noqa: E402
from test_llm_whole import kept_by_force  # noqa: E402

import corpus_pipeline as pipeline  # noqa: E402
from pagesheaf.llm import language, quality  # noqa: E402
from pagesheaf.llm.common import stored, table  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    docs, out = table(spark, SF, "documents"), []
    for name, stage in pipeline.STAGES:
        docs = stored(stage(spark, docs, SF), "test-stage")
        out.append(docs)
    return out


def test_stages_keep_the_columns(spark, steps):
    want = table(spark, SF, "documents").columns
    assert [s.columns for s in steps[:-1]] == [want] * 4


def test_stage_decisions(spark, steps):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    good = {r.doc_id for r in quality.classify_quality(docs, labels).collect() if r.score >= 0.3}
    assert {r.doc_id for r in steps[0].collect()} == good and len(good) < docs.count()
    found = {r.doc_id: r for r in language.identify_language(steps[0]).collect()}
    want = {r.doc_id for r in steps[0].collect() if found[r.doc_id].lang_pred != "und"
            and not (r.lang and r.lang != found[r.doc_id].lang_pred and found[r.doc_id].score >= 0.1)}
    assert {r.doc_id for r in steps[1].collect()} == want
    # Five-word similarity of 0.8 or more, by comparing all pairs.
    one = set(kept_by_force([(r.doc_id, r.text) for r in steps[1].collect()]))
    assert sorted(r.doc_id for r in steps[2].collect()) == sorted(one) and len(one) < len(want)
    times = Counter(r.doc_id for r in steps[3].collect())
    assert set(times) == one and max(times.values()) <= 2
    packed = steps[4].toPandas()
    assert Counter(packed[packed.piece == 0].doc_id) == times


def test_run_is_the_stages_in_turn(spark, steps):
    cols = ["doc_id", "n_tokens", "piece", "piece_tokens"]
    got = sorted(map(tuple, pipeline.run(spark, SF).select(*cols).collect()))
    assert got == sorted(map(tuple, steps[-1].select(*cols).collect()))


def test_stages_bear_odd_rows_and_empty_tables(spark):
    docs = documents(spark)
    for name, stage in pipeline.STAGES:
        out = stage(spark, docs, SF)
        assert out.count() >= 1
        assert stage(spark, empty(spark), SF).count() == 0
        if stage is not pipeline.packing:
            assert out.columns == docs.columns
