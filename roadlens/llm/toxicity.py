"""Toxic passages by maximum-scoring segments.

Every word scores its log-odds of standing in toxic against clean labelled documents. Occurrences are counted (TOLD of a word in one document
at most), and a Dirichlet prior of PRIOR words' weight carries the shares of a word's stem (its first letters, from short to long) down
to the word, so unseen inflections score as their stem does and rare words score near zero. Less DRIFT a word, scores fall on clean text, and one linear scan
over a document's words finds all of its maximal scoring segments. For segments by chance extreme-value theory holds: with lambda
from the score distribution of clean words and K fitted on clean documents, K n exp(-lambda s) segments of score s or more are expected
among n words. The best segments together give the evidence against a document, and a logistic curve turns it into a probability.
All of this is calibrated with each labelled document's own counts taken out of the table that scores it.

Lexicon and calibration are learned on at most SAMPLE labelled documents (a documented bound) without their near copies; whole texts of
all documents are scored in one pass.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import map_arrow, materialize, mix64, odd_multipliers, small_batches, utf8, word_hashes
from .decontaminate import _FOLD, words_of
from .language_id import fold

#: Most labelled documents to learn from, and most stems and words in the lexicon.
SAMPLE, LEXICON = 60_000, 200_000
#: Lengths of stems in code points, the weight of the prior in words, and how often a document counts for one word.
STEMS, PRIOR, TOLD = (4, 5, 6, 7, 8), 6.0, 10
#: Most of the labelled documents that the calibration is fitted on; it has five numbers.
CALIBRATION = 15_000
#: A stem or word is listed if it stands so often in toxic or in clean documents, each word of a document counted once.
LEAST_TOXIC, LEAST_CLEAN = 2, 10
#: Log-odds are held between these bounds, less DRIFT each.
LOWEST, HIGHEST, DRIFT = -1.5, 8.0, 0.7
#: Best segments that count together, and expected chance segments up to which a passage is reported.
SEGMENTS, EXPECTED = 8, 0.05
#: Evidence x counts as SATURATION (1 - exp(-x / SATURATION)): some labels are wrong, so a smaller chance says little more.
SATURATION = 12.0
#: Signatures by which near copies of labelled documents are left out.
SIGNATURES = 4
_BIN = 0.01
_MARKS = odd_multipliers(SIGNATURES + 3, 17)


def path_of(word: bytes) -> list[str]:
    """The root, the stems of a word from short to long, then the word itself (marked by a dot, which no word has)."""
    letters = word.decode("utf-8", "replace")
    return ["", *(letters[:k] for k in STEMS if k <= len(letters)), letters + "."]


def node_counts(words: list[bytes], paths: dict[bytes, list[str]]) -> dict[str, int]:
    """How often one document counts for each node of its words; paths is a cache."""
    seen: dict[bytes, int] = {}
    for word in words:
        seen[word] = seen.get(word, 0) + 1
    out: dict[str, int] = {}
    for word, n in seen.items():
        path = paths.get(word)
        if path is None:
            path = paths[word] = path_of(word)
        told = n if n < TOLD else TOLD
        for node in path:
            out[node] = out.get(node, 0) + told
    return out


@dataclass
class Model:
    """Listed stems and words with their occurrences in toxic and clean documents, the numbers of these, and the calibration."""

    counts: dict[str, tuple[int, int]]
    toxic: int
    clean: int
    scale: float = 1.0  # lambda
    rate: float = 1.0  # K
    slope: float = 0.0
    intercept: float = 0.0
    #: scores of all listed words, and of all listed stems, for new documents
    words: dict[bytes, float] = field(default_factory=dict)
    stems: dict[str, float] = field(default_factory=dict)

    def score(self, word: bytes, label: int | None = None, own: dict[str, int] | None = None, stem: bool = False) -> float:
        """Score of a word (or of a stem) in a new document, or in a learned one with this label, whose own counts are then taken out."""
        share, base = 0.5, None
        for node in path_of(word)[: -1 if stem else None]:
            found = self.counts.get(node)
            if found is None:  # longer stems are rarer still
                break
            mine = own[node] if own else 0
            a, b = found[0] - (mine if label == 1 else 0), found[1] - (mine if label == 0 else 0)
            share = (a + PRIOR * share) / (a + b + PRIOR) if base is not None else (a + 1) / (a + b + 2)
            base = share if base is None else base
        base = share if base is None else base
        share = min(max(share, 1e-9), 1 - 1e-9)  # beyond the bounds of the score
        odds = math.log(share / (1 - share)) - math.log(base / (1 - base))
        return min(max(odds, LOWEST), HIGHEST) - DRIFT

    def ready(self) -> Model:
        """The model for new documents: scores in place of counts, without stems and words that score as their own stem does."""
        self.words, self.stems = {}, {}
        for node in sorted(self.counts, key=len):
            if node.endswith("."):
                word = node[:-1].encode()
                score = self.score(word)
                if abs(score - self.stem_score(word)) > 0.01:
                    self.words[word] = score
            elif node:
                self.stems[node] = self.score(node.encode(), stem=True)
        return Model({}, self.toxic, self.clean, self.scale, self.rate, self.slope, self.intercept, self.words, self.stems)

    def stem_score(self, word: bytes) -> float:
        """Score of a word that is not listed: that of its longest listed stem."""
        letters, found = word.decode("utf-8", "replace"), -DRIFT
        for k in STEMS:
            score = self.stems.get(letters[:k]) if k <= len(letters) else None
            if score is None:
                break
            found = score
        return found

    def scores_of(self, words: list[bytes], label: int | None = None) -> np.ndarray:
        """Scores for a new document (after ready), or for a learned one with its label."""
        if label is not None:
            own = node_counts(words, {})
            held = {w: self.score(w, label, own) for w in set(words)}
        else:
            get, stem = self.words.get, self.stem_score
            held = {w: stem(w) if (x := get(w)) is None else x for w in set(words)}
        return np.fromiter(map(held.__getitem__, words), np.float64, len(words))

    def evidence(self, n_words: int, best: list[float]) -> float:
        """Minus the log of the chance that clean text of n_words has segments as good as these (falling scores) together, saturated."""
        out, total = 0.0, 0.0
        space = math.log(max(self.rate * n_words, 1e-300))
        for r, score in enumerate(best[:SEGMENTS], 1):
            total += self.scale * score - space
            if r == 1:
                found = -math.log(-math.expm1(-math.exp(-total))) if total < 30 else total
            elif total > r:
                found = total - (r - 1) * math.log(total) + math.lgamma(r + 1) + math.lgamma(r) - (r - 1) * math.log(2)
            else:
                break
            out = max(out, found)
        return -SATURATION * math.expm1(-out / SATURATION)

    def probability(self, evidence: float) -> float:
        return 1 / (1 + math.exp(-(self.intercept + self.slope * evidence)))


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first, one past the last, score): none can be extended or cut without losing, by one scan."""
    sums = np.concatenate([[0.0], np.cumsum(scores)])
    left: list[float] = []  # cumulated score before, and at the end of, each candidate
    right: list[float] = []
    spans: list[tuple[int, int]] = []
    lower: list[int] = []  # the nearest earlier candidate with a smaller left sum
    for i in np.flatnonzero(scores > 0).tolist():
        low, high, first = float(sums[i]), float(sums[i + 1]), i
        j = len(left) - 1
        while True:
            while j >= 0 and left[j] >= low:
                j = lower[j]
            if j < 0 or right[j] >= high:
                break
            low, first = left[j], spans[j][0]  # joined with everything from candidate j on
            del left[j:], right[j:], spans[j:], lower[j + 1 :]
            j = lower.pop()
        left.append(low)
        right.append(high)
        spans.append((first, i + 1))
        lower.append(j)
    return [(a, b, r - p) for (a, b), p, r in zip(spans, left, right, strict=True)]


def labelled_texts(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, label (0, 1), text as UTF-8 of at most about `sample` labelled documents; rows without an id, label or text are left out.

    labels: doc_id, label; of several labels of an id the largest holds. Near copies (an equal minhash of three-word shingles and an
    equal label) are left out but for the one of smallest id, and a repeated id keeps one text.
    """
    found = labels.where("doc_id is not null and label in (0, 1)").groupBy("doc_id").agg(F.max("label").cast("int").alias("label"))
    total = found.count()
    if total > sample:  # by hash of the id: the same rows each time
        found = found.where(F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 30)) < int(sample / total * (1 << 30)))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8("text").alias("text")).where("text is not null")
    rows = materialize(rows.join(F.broadcast(found), "doc_id"), "labelled")  # `sample` short rows

    def fn(batch: pa.RecordBatch) -> dict[str, object]:
        marks = []
        for text in batch.column(0).to_pylist():
            codes = word_hashes(words_of(text))
            k = min(3, len(codes))
            hashes = sum((codes[j : len(codes) - k + 1 + j] * _MARKS[j] for j in range(k)), np.zeros(max(1, len(codes) - k + 1), np.uint64))
            marks.append([int(mix64(hashes * m).min() >> np.uint64(1)) for m in _MARKS[3:]] if k else None)
        return {"doc_id": batch.column(1), "label": batch.column(2), "marks": pa.array(marks, pa.list_(pa.int64()))}

    signed = map_arrow(rows.select("text", "doc_id", "label"), fn, "doc_id long, label int, marks array<long>").where("marks is not null")
    first = [F.min("doc_id").over(Window.partitionBy("label", F.col("marks")[j])) for j in range(SIGNATURES)]
    kept = signed.withColumn("first", F.greatest(*first)).where("first = doc_id").select("doc_id").distinct()
    return rows.join(F.broadcast(kept), "doc_id", "left_semi").dropDuplicates(["doc_id"])


def count_nodes(texts: DataFrame) -> Model:
    """The uncalibrated model: how often each stem and word occurs in toxic and in clean documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        told: tuple[dict[bytes, int], dict[bytes, int]] = ({}, {})
        docs: tuple[dict[bytes, int], dict[bytes, int]] = ({}, {})

        def flush() -> Iterator[pa.RecordBatch]:
            for label in (0, 1):
                counts, found = told[label], docs[label]
                columns = {"word": pa.array([w.decode("utf-8", "replace") for w in counts], pa.string()), "label": pa.array([label] * len(counts), pa.int32())}
                columns |= {"n": pa.array(list(counts.values()), pa.int64()), "docs": pa.array([found[w] for w in counts], pa.int64())}
                yield pa.RecordBatch.from_pydict(columns)
                counts.clear()
                found.clear()

        for batch in batches:
            for label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                counts, found = told[label], docs[label]
                for word, n in Counter(words_of(text)).items():
                    counts[word] = counts.get(word, 0) + (n if n < TOLD else TOLD)
                    found[word] = found.get(word, 0) + 1
                if len(told[0]) + len(told[1]) > 400_000:
                    yield from flush()
        yield from flush()

    small_batches(texts.sparkSession)
    sizes = {r["label"]: r["count"] for r in texts.groupBy("label").count().collect()}
    counted = texts.select("label", "text").mapInArrow(run, "word string, label int, n long, docs long")
    of = lambda column, label: F.sum(F.when(F.col("label") == label, F.col(column)).otherwise(0))
    words = counted.groupBy("word").agg(of("n", 1).alias("a"), of("n", 0).alias("b"), of("docs", 1).alias("da"), of("docs", 0).alias("db"))
    stems = [F.when(F.length("word") >= k, F.substring("word", 1, k)) for k in STEMS]
    path = F.filter(F.array(F.lit(""), *stems, F.concat("word", F.lit("."))), lambda x: x.isNotNull())
    nodes = words.withColumn("node", F.explode(path)).groupBy("node").agg(*[F.sum(c).alias(c) for c in ("a", "b", "da", "db")])
    # stems are listed wherever their longer forms are, as they are at least as common
    listed = nodes.where((F.col("da") >= LEAST_TOXIC) | (F.col("db") >= LEAST_CLEAN))
    listed = listed.orderBy(F.desc("da"), F.desc("db"), F.length("node"), "node").limit(LEXICON).select("node", "a", "b")
    found = listed.toArrow()  # at most LEXICON rows
    counts = dict(zip(found["node"].to_pylist(), zip(found["a"].to_pylist(), found["b"].to_pylist(), strict=True), strict=True))
    return Model(counts, sizes.get(1, 0), sizes.get(0, 0))


def chance_scale(counts: dict[int, int]) -> float:
    """lambda: the positive root of E[exp(lambda s)] = 1 for scores of clean words (number of each score, in steps of _BIN).

    One more word of the highest score is counted, so a root exists however few clean words score above 0.
    """
    if not counts:
        return 1.0
    top = round((HIGHEST - DRIFT) / _BIN)
    counts = {**counts, top: counts.get(top, 0) + 1}
    scores, n = np.array(list(counts)) * _BIN, np.array(list(counts.values()), float)
    share = n / n.sum()
    excess = lambda x: float(np.log((share * np.exp(x * scores - x * scores.max())).sum()) + x * scores.max())
    low, high = 1e-6, 1.0
    if float((share * scores).sum()) >= 0:
        return 1.0
    while excess(high) < 0 and high < 64:
        high *= 2
    for _ in range(60):
        middle = (low + high) / 2
        low, high = (middle, high) if excess(middle) < 0 else (low, middle)
    return high


def logistic(evidence: np.ndarray, toxic: np.ndarray, clean: np.ndarray) -> tuple[float, float]:
    """Slope and intercept by Newton steps over counted evidence; a small ridge keeps separable counts finite."""
    x = np.stack([evidence, np.ones(len(evidence))])
    w = np.array([0.0, math.log((toxic.sum() + 1) / (clean.sum() + 1))])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(w @ x, -30, 30)))
        n = toxic + clean
        slope = x @ (toxic - n * p) - np.array([0.05, 0.0]) * w
        curve = (x * (n * p * (1 - p))) @ x.T + np.diag([0.05, 1e-6])
        step = np.linalg.solve(curve, slope)
        w = w + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return float(max(w[0], 0.0)), float(w[1])


def fit(texts: DataFrame) -> Model:
    """The model learned from texts (doc_id, label, text), as labelled_texts gives them. One class alone gives every text the same score."""
    model = count_nodes(texts)
    if not model.toxic or not model.clean:
        model.intercept = math.log((model.toxic + 1) / (model.clean + 1))
        return model.ready()
    spark, learned = texts.sparkSession, model.toxic + model.clean
    if learned > CALIBRATION:  # by hash of the id: the same rows each time
        texts = texts.where(F.pmod(F.xxhash64("doc_id", F.lit(13)), F.lit(1 << 30)) < int(CALIBRATION / learned * (1 << 30)))
    shared = spark.sparkContext.broadcast(model)

    def fn(batch: pa.RecordBatch) -> dict[str, object]:
        rows: list[tuple] = []
        bins: dict[int, int] = {}
        for label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            scores = shared.value.scores_of(words_of(text), label)
            rows.append((label, len(scores), sorted((s for _, _, s in segments(scores)), reverse=True)[:SEGMENTS], None, 0))
            if not label:
                for at, n in zip(*np.unique(np.rint(scores / _BIN).astype(int), return_counts=True), strict=True):
                    bins[int(at)] = bins.get(int(at), 0) + int(n)
        rows += [(None, 0, None, at, n) for at, n in bins.items()]
        columns = list(zip(*rows, strict=True))
        types = {"label": pa.int32(), "n_words": pa.int64(), "best": pa.list_(pa.float64()), "bin": pa.int32(), "n": pa.int64()}
        return {name: pa.array(list(c), kind) for (name, kind), c in zip(types.items(), columns, strict=True)}

    scanned = map_arrow(texts.select("label", "text"), fn, "label int, n_words long, best array<double>, bin int, n long")
    scanned = materialize(scanned, "scanned")  # one short row for each of the sample's documents
    bins = scanned.where("bin is not null").groupBy("bin").agg(F.sum("n").alias("n")).collect()  # at most one row for each step of the score
    model.scale = chance_scale({r["bin"]: r["n"] for r in bins})
    best = F.coalesce(F.try_element_at("best", F.lit(1)), F.lit(0.0))
    sums = scanned.where("label = 0 and n_words > 0").agg(F.count("*"), F.sum(F.col("n_words") * F.exp(-F.lit(model.scale) * best))).first()
    model.rate = (sums[0] + 1) / ((sums[1] or 0.0) + 1)
    shared = spark.sparkContext.broadcast(model)

    def weigh(batch: pa.RecordBatch) -> dict[str, object]:
        found = [shared.value.evidence(n, best or []) for n, best in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
        return {"label": batch.column(0), "step": pa.array([round(x * 20) for x in found], pa.int32())}

    steps = map_arrow(scanned.where("label is not null").select("label", "n_words", "best"), weigh, "label int, step int")
    counted = steps.groupBy("step").agg(F.sum("label").alias("toxic"), F.sum(1 - F.col("label")).alias("clean")).orderBy("step").collect()  # few steps
    columns = np.array([[r.step / 20, r.toxic, r.clean] for r in counted], float).T
    model.slope, model.intercept = logistic(*columns)
    return model.ready()


_SPAN = re.compile(rb"[^ ]+")


def passages_of(model: Model, text: bytes) -> tuple[float, int, list[dict]]:
    """Probability, number of words, and the significant passages (offsets in code points, falling score) of one text."""
    words = words_of(text)
    if not words:
        return model.probability(0.0), 0, []
    found = sorted(segments(model.scores_of(words)), key=lambda s: (-s[2], s[0]))
    probability = model.probability(model.evidence(len(words), [s for _, _, s in found[:SEGMENTS]]))
    space = math.log(max(model.rate * len(words), 1e-300))
    significant = [s for s in found if model.slope > 0 and space - model.scale * s[2] <= math.log(EXPECTED)]
    if not significant:
        return probability, len(words), []
    places = [m.span() for m in _SPAN.finditer(text.translate(_FOLD))]
    out = []
    for a, b, score in significant:
        start = len(text[: places[a][0]].decode("utf-8", "replace"))
        length = len(text[places[a][0] : places[b - 1][1]].decode("utf-8", "replace"))
        expected = math.exp(min(space - model.scale * score, 0.0))
        out.append({"start": start, "end": start + length, "words": b - a, "score": score, "expected": expected})
    return probability, len(words), out


def score_texts(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, score (0 to 1), n_words, passages (start, end, words, score, expected) of every row of docs (doc_id, text).

    passages are all segments of which at most EXPECTED are expected by chance in clean text as long. A null or blank text has none and
    scores as clean text does. Rows are judged one by one, so repeated rows and rows without an id need no care; other columns are left out.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def fn(batch: pa.RecordBatch) -> dict[str, object]:
        rows = [passages_of(shared.value, text or b"") for text in batch.column(1).to_pylist()]
        kind = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("words", pa.int32()), ("score", pa.float64()), ("expected", pa.float64())])
        return {
            "doc_id": batch.column(0), "score": pa.array([r[0] for r in rows], pa.float64()), "n_words": pa.array([r[1] for r in rows], pa.int64()),
            "passages": pa.array([r[2] for r in rows], pa.list_(kind)),
        }

    schema = "doc_id long, score double, n_words long, passages array<struct<start:int,end:int,words:int,score:double,expected:double>>"
    return map_arrow(docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8("text")), fn, schema)


def op11_toxicity(spark, sf_dir: str) -> DataFrame:
    """Learned from four fifths of labels by id, applied to all documents."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    labels = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").alias("label")).where(~fold("doc_id", 5, 0))
    scored = score_texts(docs, fit(labelled_texts(docs, labels)))
    predicted = (F.col("score") >= 0.5).cast("int").alias("predicted")
    return scored.select("doc_id", fold("doc_id", 5, 0).alias("held_out"), "score", predicted, F.size("passages").alias("n_passages"))
