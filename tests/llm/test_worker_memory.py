"""A worker keeps the tables of one operator at a time (round 3, pipeline)."""

import sys

import pandas as pd
import pytest

from spendlens.llm import common, pii_tagger, quality_rank, simhash_dedup


@pytest.fixture
def box(monkeypatch):
    monkeypatch.delitem(sys.modules, "spendlens_worker_box", raising=False)
    common.per_worker(("pieces", "a"), lambda: "table")
    yield lambda: [k for k in common._worker_box() if isinstance(k, tuple)]
    sys.modules.pop("spendlens_worker_box", None)


def test_tables_of_one_operator(box):
    common.per_worker(("pieces", "b"), lambda: "other file")
    assert box() == [("pieces", "a"), ("pieces", "b")]
    assert common.per_worker(("pieces", "a"), lambda: "made again") == "table"
    common.per_worker(("letters",), lambda: "letters")
    assert box() == [("letters",)]
    common.release("letters")
    assert box() == [("letters",)]
    common.release()
    assert box() == []


@pytest.mark.parametrize("stage", [simhash_dedup.fingerprints, quality_rank.numbers_of,
                                   lambda docs: pii_tagger.find_spans(docs, None), lambda docs: pii_tagger.redact(docs, None)])
def test_text_stages_begin_without_them(spark, box, monkeypatch, stage):
    docs = spark.createDataFrame([(1, "some words and a@b.example")], "doc_id long, text string")
    tasks = []
    monkeypatch.setattr(type(docs), "mapInPandas", lambda df, run, schema: (tasks.append(run), df)[1])
    stage(docs)
    out = list(tasks[0](iter([pd.DataFrame({"doc_id": [1], "text": ["some words and a@b.example"]})])))
    assert len(out) == 1 and len(out[0]) == 1 and box() == []
