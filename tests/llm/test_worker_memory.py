"""What earlier stages leave in Python workers, which outlive them."""

import sys
import time

import pytest

from roadlens.llm import common as K
from roadlens.llm import substring_dedup as SD


def test_units_are_cut_without_what_earlier_stages_left(spark, monkeypatch):
    def fill(batches):
        for batch in batches:
            K.worker_state("left", lambda: bytearray(1 << 20))
            time.sleep(0.3)
            yield batch

    def watched(text, min_words=SD.MIN_WORDS, cut=SD.units):
        state = sys.modules.get("_roadlens_worker_state")
        assert getattr(state, "held", None) is None, "state of an earlier stage"
        return cut(text, min_words)

    for _ in range(3):
        spark.range(0, 8, 1, 4).mapInArrow(fill, "id long").collect()
    monkeypatch.setattr(SD, "units", watched)
    docs = spark.range(0, 1000, 1, 4).selectExpr("id as doc_id", "concat('This text has one number of its own, ', id, '. And this is its end today.') as text")
    table = SD.unit_table(docs).collect()
    assert len({r.doc_id for r in table}) == 1000  # batches are cut into pieces, none of which is lost


def steps_of_python(plan):
    """For each stage of a plan, how many steps of Python one of its tasks goes through: each has a worker of its own."""
    out = []

    def walk(node, n):
        if "Exchange" in (name := node.nodeName()):
            out.append(n)
            n = 0
        n += "Python" in name or "InArrow" in name or "InPandas" in name
        children = [node.children().apply(i) for i in range(node.children().size())]
        out.extend([] if children else [n])
        for child in children:
            walk(child, n)

    walk(plan, 0)
    return out


@pytest.mark.parametrize("bound", [SD.BROADCAST_SPANS, 0])
def test_texts_are_cut_by_one_worker_in_a_task(spark, folder, monkeypatch, bound):
    import corpus_pipeline as C

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    monkeypatch.setattr(SD, "BROADCAST_SPANS", bound)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        steps = steps_of_python(C.substring_stage(spark, docs, folder)._jdf.queryExecution().executedPlan())
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert max(steps) == 1, steps
