"""Scores of texts that the model was not fitted on: small corpora and contexts that always go on alike."""

import numpy as np

from roadlens.llm import lm_score as LM
from roadlens.llm import queries


def test_held_out_rows_of_a_small_corpus_are_not_far_below_the_base(spark):
    rows = queries.QUERIES["op10_lm_score"](spark, "/root/testdata/sf0.001").collect()
    gain = np.array([(r.score - r.base_score) / r.n_tokens for r in rows if r.held_out])
    assert len(gain) and np.isfinite(gain).all() and gain.min() > -0.2 and np.median(gain) > 0


def test_digits_that_a_frequent_context_never_had_keep_a_share(spark):
    """A context that ten million times goes on with a rare digit: its other digits had a share of 0 in half precision."""
    counts = np.zeros(LM.BLOCK, np.int64)
    counts[3] = 10_000_000
    at = np.flatnonzero(counts)
    block = [(LM.FIRST, bytearray(at.astype("<u2").tobytes()), bytearray(counts[at].astype("<i8").tobytes()))]
    shares = np.full((LM.ENDINGS, LM.DIGITS), 0.99 / (LM.DIGITS - 1))
    shares[:, 3] = 0.01
    ratios = LM.train_digits(spark.createDataFrame(block, "block int, places binary, counts binary"), shares, 64).astype(float)
    first = ratios[0][: LM.DIGITS]
    assert np.allclose((first * shares[0]).sum(), 1, atol=2e-3)
    assert first.min() > 0.05 and first[3] > 50


def test_what_tasks_send_to_the_driver_does_not_grow_with_their_number(spark, monkeypatch):
    """Each task sent a whole table of weights (1 MB) in each round."""
    rng = np.random.default_rng(5)
    counts = np.where(rng.random(LM.BLOCK) < 0.3, rng.integers(1, 50, LM.BLOCK), 0)
    at = np.flatnonzero(counts)
    block = [(0, bytearray(at.astype("<u2").tobytes()), bytearray(counts[at].astype("<i8").tobytes()))]
    blocks = spark.createDataFrame(block, "block int, places binary, counts binary")
    frame, sent = type(blocks), []
    deal, collect = frame.repartition, frame.collect

    def counted(self):
        rows = collect(self)
        if "gradient" in self.columns:
            sent.append(sum(len(r["gradient"]) for r in rows))
        return rows

    few = LM.train_classes(blocks, rounds=3)
    monkeypatch.setattr(frame, "repartition", lambda self, n, *keys: deal(self, 61 if keys else n, *keys))
    monkeypatch.setattr(frame, "collect", counted)
    splits = {"spark.sql.files.maxPartitionBytes": "8k", "spark.sql.files.openCostInBytes": "1k"}  # a task for each file or two
    try:
        for k, v in splits.items():
            spark.conf.set(k, v)
        many = LM.train_classes(blocks, rounds=3)
    finally:
        for k in splits:
            spark.conf.unset(k)
    assert np.allclose(few, many, atol=1e-9)
    assert len(sent) == 3 and max(sent) <= 4 * LM.CLASSES**2 * LM.CLASSES * 8
    assert max(sent) < 61 * LM.FEATURES * LM.CLASSES * 8 / 10
