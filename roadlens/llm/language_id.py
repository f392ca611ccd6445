"""Language ID: multinomial naive Bayes over hashed character n-grams.

Counting is distributed (each batch sums its n-grams by language, Spark sums the batches); the matrix of log probabilities is
bounded by CELLS numbers and broadcast; texts are scored in sparse numpy batches over their whole length.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_worker_state, map_arrow, small_batches

ORDERS = (1, 2, 3)
#: Most n-gram buckets, and most numbers in the broadcast matrix (buckets times languages).
BUCKETS, CELLS = 1 << 15, 1 << 23
#: n-grams that are gathered at once.
CHUNK = 1 << 20
UNDETERMINED = "und"
_MULTIPLIERS = np.array([2654435761, 2246822519, 3266489917], np.uint32)
_LETTER = re.compile(r"[^\W\d_]")


def has_letter(text: str | None) -> bool:
    found = _LETTER.search(text) if text else None
    return bool(found) and (found.group().isalpha() or any(map(str.isalpha, text)))


def ngrams(text: str, buckets: int) -> np.ndarray:
    """Buckets of the text's character n-grams, after lower-casing."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    out = []
    for order in ORDERS:
        if len(codes) >= order:
            h = np.full(len(codes) - order + 1, order * 0x9E37, np.uint32)
            for i in range(order):
                h = (h ^ codes[i : len(codes) - order + 1 + i]) * _MULTIPLIERS[i]
                h ^= h >> np.uint32(15)
            out.append(h % np.uint32(buckets))
    return np.concatenate(out) if out else np.empty(0, np.uint32)


class Model:
    """Languages, their log priors and the matrix of log probabilities (buckets x languages)."""

    def __init__(self, languages: list[str], priors: np.ndarray, matrix: np.ndarray) -> None:
        self.languages, self.priors, self.matrix, self.buckets = languages, priors, matrix, len(matrix)

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        scores = np.tile(self.priors, (len(texts), 1)) if self.languages else np.empty((len(texts), 0))
        ready, sizes, n = [], [], 0

        def flush() -> None:
            grams = np.concatenate([g for _, g in ready])
            starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
            rows = [i for i, _ in ready]
            for k in range(len(self.languages)):
                scores[rows, k] += np.add.reduceat(self.matrix[:, k][grams], starts, dtype=np.float64)

        letters = [has_letter(t) for t in texts]
        for i, text in enumerate(texts):
            if letters[i] and self.languages:
                grams = ngrams(text, self.buckets)
                for at in range(0, len(grams), CHUNK):  # a long text is scored piece by piece
                    piece = grams[at : at + CHUNK]
                    ready.append((i, piece))
                    sizes.append(len(piece))
                    n += len(piece)
                    if n >= CHUNK or at + CHUNK < len(grams):
                        flush()
                        ready, sizes, n = [], [], 0
        if ready:
            flush()
        names, best = [], []
        for i in range(len(texts)):
            if not letters[i] or not self.languages:
                names.append(UNDETERMINED)
                best.append(0.0)
            else:
                k = int(scores[i].argmax())
                names.append(self.languages[k])
                best.append(float(1 / np.exp(scores[i] - scores[i, k]).sum()))
        return names, best


def train(labelled: DataFrame, alpha: float = 0.5) -> Model:
    """The model learned from all rows of labelled (text, lang); rows with a null are left out."""
    small_batches(labelled.sparkSession)
    rows = labelled.select("text", "lang").where("text is not null and lang is not null")
    found = sorted(rows.groupBy("lang").count().collect(), key=lambda r: r["lang"])
    languages = [r["lang"] for r in found]
    if not languages:
        return Model([], np.empty(0), np.empty((BUCKETS, 0), np.float32))
    if len(languages) > CELLS // 64:
        raise ValueError(f"{len(languages)} languages are too many for a broadcast matrix")
    buckets = min(BUCKETS, CELLS // len(languages))
    index = {name: k for k, name in enumerate(languages)}

    def fn(batches):
        drop_worker_state()
        total = np.zeros((len(index), buckets), np.int64)  # one for each task
        for batch in batches:
            by_language: dict[int, list[np.ndarray]] = {}
            held: dict[int, int] = {}
            for text, lang in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                k = index[lang]
                by_language.setdefault(k, []).append(grams := ngrams(text, buckets))
                held[k] = held.get(k, 0) + len(grams)
                if held[k] >= CHUNK:
                    total[k] += np.bincount(np.concatenate(by_language.pop(k)), minlength=buckets)
                    held[k] = 0
            for k, parts in by_language.items():
                total[k] += np.bincount(np.concatenate(parts), minlength=buckets)
        for k in range(len(index)):
            at = np.flatnonzero(total[k])
            if len(at):
                yield pa.RecordBatch.from_pydict(
                    {"k": pa.array(np.full(len(at), k, np.int32)), "bucket": pa.array(at.astype(np.int32)), "n": pa.array(total[k][at])}
                )

    counts = rows.mapInArrow(fn, "k int, bucket int, n long").groupBy("k", "bucket").agg(F.sum("n").alias("n")).toPandas()  # at most CELLS rows
    matrix = np.full((buckets, len(languages)), alpha)
    np.add.at(matrix, (counts["bucket"].to_numpy(), counts["k"].to_numpy()), counts["n"].to_numpy())
    matrix = np.log(matrix) - np.log(matrix.sum(axis=0))
    docs = np.array([r["count"] for r in found], float)
    return Model(languages, np.log((docs + 1) / (docs.sum() + len(docs))), np.asfortranarray(matrix.astype(np.float32)))


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score for every row of docs (doc_id, text).

    A null text or one without a letter is `und` with score 0, as is every text if the model has learned no language.
    The score is the posterior probability of the predicted language.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def fn(batch: pa.RecordBatch) -> dict[str, object]:
        names, scores = shared.value.predict(batch.column(1).to_pylist())
        return {"doc_id": batch.column(0), "lang_pred": pa.array(names, pa.string()), "score": pa.array(scores, pa.float64())}

    return map_arrow(docs.select("doc_id", "text"), fn, "doc_id long, lang_pred string, score double", stateless=True)


def keep_identified(docs: DataFrame, model: Model, least_score: float = 0.5) -> DataFrame:
    """The rows of docs whose language can be told: a letter, a learned language, a score of at least least_score. No shuffle."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        drop_worker_state()
        for batch in batches:
            names, scores = shared.value.predict(batch.column(batch.schema.get_field_index("text")).to_pylist())
            yield batch.filter(pa.array([n != UNDETERMINED and s >= least_score for n, s in zip(names, scores, strict=True)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def fold(column: str, parts: int, held: int):
    """Whether crc32 of the id as text leaves this remainder; false for a null id."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % parts == held, F.lit(False))


def op2_language_id(spark, sf_dir: str) -> DataFrame:
    """Learned from two thirds of documents by id, applied to all."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    learn = docs.where(F.col("doc_id").isNotNull() & ~fold("doc_id", 3, 1))
    found = identify(docs, train(learn))
    return found.select("doc_id", fold("doc_id", 3, 1).alias("held_out"), "lang_pred", "score")
