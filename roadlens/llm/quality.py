"""Quality classifier: a sparse rule ensemble.

Text statistics of every document are computed once; boosted trees on labelled rows give paths, each path is a conjunctive rule
over the statistics; a lasso logistic regression keeps few of the rules and weighs them; rules and weights become one Spark
column expression that scores all rows inside generated code. Trees and weights are fitted with Spark MLlib on at most
`sample` labelled rows (a documented bound); statistics and scores cover all documents.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, materialize, utf8
from .language_id import fold

#: Most labelled rows that trees and weights are fitted on; 60,000 rows decide a few dozen rules.
SAMPLE = 60_000
STATISTICS = (
    "log_chars", "log_words", "mean_word", "longest_word", "letters", "upper", "digits", "spaces", "stops", "symbols", "other_ascii", "non_ascii",
    "lines", "words_a_line", "distinct_words", "top_word", "odd_ends", "repeated_lines", "short_words", "repeated_pairs",
)
_KIND = np.zeros(256, np.int64)
for _byte in range(256):
    _c = chr(_byte)
    _KIND[_byte] = 7 if _byte >= 128 else 0 if _c.islower() else 1 if _c.isupper() else 2 if _c.isdigit() else 3 if _c.isspace() else 4 if _c in ".,;:?'\"-()" else 5 if _c in "*#&%$|!@=~^_<>{}[]\\/+`" else 6
_ODD_END = re.compile(rb"[*#&%$|!@=~^]+(?:\s|$)")


def statistics(text: bytes | None) -> list[float]:
    """The STATISTICS of one text; all 0 without words."""
    words = (text or b"").split()
    if not words:
        return [0.0] * len(STATISTICS)
    n, k = len(text), len(words)
    kinds = np.bincount(_KIND[np.frombuffer(text, np.uint8)], minlength=8) / n
    sizes = np.fromiter(map(len, words), np.int64, k)
    seen: dict[bytes, int] = {}
    for w in words:
        seen[w] = seen.get(w, 0) + 1
    lines = [x for x in text.split(b"\n") if x.strip()]
    pairs = len(set(zip(words, words[1:], strict=False)))
    return [
        math.log1p(n), math.log1p(k), float(sizes.mean()), float(sizes.max()), float(kinds[0] + kinds[1] + kinds[7]), float(kinds[1]), float(kinds[2]),
        float(kinds[3]), float(kinds[4]), float(kinds[5]), float(kinds[6]), float(kinds[7]),
        math.log1p(len(lines)), k / len(lines), len(seen) / k, max(seen.values()) / k, len(_ODD_END.findall(text)) / k, 1 - len(set(lines)) / len(lines),
        float((sizes <= 3).mean()), 1 - pairs / max(1, k - 1),
    ]


def text_statistics(docs: DataFrame) -> DataFrame:
    """doc_id and the STATISTICS (doubles) of every row of docs (doc_id, text)."""

    def fn(batch: pa.RecordBatch) -> dict[str, object]:
        rows = np.array([statistics(t) for t in batch.column(1).to_pylist()], float).reshape(-1, len(STATISTICS))
        return {"doc_id": batch.column(0)} | {name: pa.array(rows[:, i]) for i, name in enumerate(STATISTICS)}

    return map_arrow(docs.select("doc_id", utf8("text")), fn, "doc_id long, " + ", ".join(f"{s} double" for s in STATISTICS))


#: (statistic, is it "at most", threshold)
Condition = tuple[str, bool, float]


@dataclass
class RuleModel:
    rules: list[tuple[Condition, ...]]
    weights: list[float]
    intercept: float

    def score(self) -> Column:
        """Probability of label 1 as a column over the STATISTICS."""
        total = F.lit(self.intercept)
        for rule, weight in zip(self.rules, self.weights, strict=True):
            total = total + F.when(holds(rule), F.lit(weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-total))


def holds(rule: tuple[Condition, ...]) -> Column:
    out = F.lit(True)
    for name, at_most, value in rule:
        out = out & ((F.col(name) <= value) if at_most else (F.col(name) > value))
    return out


def tree_paths(description: str) -> list[tuple[Condition, ...]]:
    """Every path from a root (inner nodes too) in MLlib's text form of a tree ensemble, as sorted conditions."""
    found: dict[tuple[Condition, ...], None] = {}
    path: list[tuple[int, Condition]] = []
    for line in description.splitlines():
        m = re.match(r"(\s*)(?:If|Else) \(feature (\d+) (<=|>) (\S+)\)", line)
        if not m:
            continue
        depth = len(m[1])
        while path and path[-1][0] >= depth:
            path.pop()
        path.append((depth, (STATISTICS[int(m[2])], m[3] == "<=", float(m[4]))))
        tightest: dict[tuple[str, bool], float] = {}
        for _, (name, at_most, value) in path:
            old = tightest.get((name, at_most), value)
            tightest[name, at_most] = min(old, value) if at_most else max(old, value)
        found[tuple(sorted((n, a, v) for (n, a), v in tightest.items()))] = None
    return list(found)


def fit_rules(labelled: DataFrame, sample: int = SAMPLE, trees: int = 12, depth: int = 3, penalty: float = 5e-4) -> RuleModel:
    """Fit the ensemble on labelled (STATISTICS, label 0/1); one class or no rows give a constant score."""
    rows = labelled.where("label in (0, 1)")
    counts = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}
    total = sum(counts.values())
    if len(counts) < 2:
        share = (counts.get(1, 0) + 1) / (total + 2)
        return RuleModel([], [], math.log(share / (1 - share)))
    if total > sample:  # by hash of the id: the same rows each time
        rows = rows.where(F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1 << 30)) < int(sample / total * (1 << 30)))
    rows = materialize(rows.select(*STATISTICS, F.col("label").cast("double").alias("label")).coalesce(8), "labelled")
    vectors = VectorAssembler(inputCols=list(STATISTICS), outputCol="features").transform(rows)
    forest = GBTClassifier(maxIter=trees, maxDepth=depth, maxBins=64, stepSize=0.3, subsamplingRate=0.7, seed=7).fit(vectors.select("features", "label"))
    rules = tree_paths(forest.toDebugString)
    if not rules:
        share = counts[1] / total
        return RuleModel([], [], math.log(share / (1 - share)))
    fired = rows.select("label", F.array(*[holds(r).cast("double") for r in rules]).alias("x"))
    from pyspark.ml.functions import array_to_vector

    lasso = LogisticRegression(
        elasticNetParam=1.0, regParam=penalty, standardization=False, maxIter=60
    ).fit(fired.select("label", array_to_vector("x").alias("features")))
    weights = lasso.coefficients.toArray()
    kept = [i for i in np.argsort(-np.abs(weights)).tolist() if abs(weights[i]) > 1e-6]
    return RuleModel([rules[i] for i in kept], [float(weights[i]) for i in kept], float(lasso.intercept))


def classify(statistics_table: DataFrame, model: RuleModel, threshold: float = 0.7) -> DataFrame:
    """doc_id, score (0 to 1) and predicted for every row of the statistics; texts without words score as their zeros do."""
    return statistics_table.select("doc_id", model.score().alias("score")).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op7_quality(spark, sf_dir: str) -> DataFrame:
    """Fitted on three quarters of labels by id, applied to all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    table = materialize(text_statistics(docs), "statistics")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").alias("label"))
    labels = labels.where(F.col("doc_id").isNotNull() & ~fold("doc_id", 4, 2)).groupBy("doc_id").agg(F.max("label").alias("label"))
    model = fit_rules(table.join(labels, "doc_id"))
    scored = classify(table, model)
    return scored.select("doc_id", fold("doc_id", 4, 2).alias("held_out"), "score", "predicted")
