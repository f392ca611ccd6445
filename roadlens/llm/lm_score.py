"""LM scoring: a hashed maximum-entropy model with a class-factored softmax.

p(word | history) = p(class | history) p(digit | class, history) p(word | class, digit). The most frequent words are classes of their own,
every other word belongs to a class hashed from its ending, and to one of DIGITS hashed digits in it. The class softmax has hashed
features of the history's classes: a bias, the class one back (n-gram), the class two back (skip) and both together. The digit softmax
has hashed features of the history's words, one family for the word one back (n-gram) and one for the word two back (skip): each context
hashes to one of `slots` rows of its class, and the two softmaxes are mixed by MIX. Rows grow with the vocabulary up to SLOTS.
Each softmax is mixed with the level above it (classes: shares one class back, digits: the class's shares) by how few tokens its history
has, and never stands alone: a small corpus, or one of copies, would otherwise score unseen text below the unigram base.
Counts cover the whole training corpus: word counts, class counts by history and digit counts by hashed context, which are all
that the gradients need. Every task sends the counts of its texts, packed in blocks of BLOCK cells; what is gathered grows with the corpus.
Class weights are updated by gradients summed over the distributed history table, digit weights (each block's rows are independent of
all others) inside the block's task. p(word | class, digit) is the smoothed share of the word's count in its cell. Scoring goes through
texts in sparse numpy batches; frequent words (at most HEAD, by a count threshold) are looked up in a broadcast table, all others by a
join with the counts.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, odd_multipliers, partitions, small_batches, utf8, worker_state
from .language_id import fold

#: Classes: 0 is the text end, then OWN frequent words, then ENDINGS hashed endings.
OWN, ENDINGS = 31, 32
CLASSES = 1 + OWN + ENDINGS
#: Rows of the hashed weight table; most words in the broadcast table.
FEATURES, HEAD = 1 << 11, 500_000
ROUNDS, RATE, PENALTY = 20, 0.15, 1e-7
#: Digits in a class of hashed endings; most rows of contexts in such a class; weights of the n-gram and skip softmaxes.
DIGITS, SLOTS, MIX = 64, 4096, (0.65, 0.35)
#: Updates of the digit softmaxes, their step, and the inverse variance of their Gaussian prior.
DIGIT_ROUNDS, DIGIT_STEP, DIGIT_PENALTY = 15, 0.6, 2.0
#: Tokens that the level above weighs in a history (class shares, one class back) and in a context; least share of the level above.
BACK_OFF, CONTEXT_BACK_OFF, LEAST_BACK_OFF = (20.0, 60.0), 30.0, 0.1
#: Cells that travel together; the first FIRST blocks are those of class counts.
BLOCK = 1 << 16
FIRST = CLASSES**3 // BLOCK
#: Tokens gathered at once.
CHUNK = 1 << 20


class Tokens(dict):
    """word -> id: a 64-bit hash whose lowest 5 bits are the hashed ending; emptied when it holds `most` words."""

    def __init__(self, most: int = 250_000) -> None:
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        from xxhash import xxh3_64_intdigest, xxh32_intdigest

        if len(self) >= self.most:
            self.clear()
        ending = xxh32_intdigest(word[-3:]) % ENDINGS
        value = self[word] = (xxh3_64_intdigest(word) & 0x7FFFFFFFFFFFFFE0) | ending
        return value


#: The id of the text end; words are never empty.
END = 0x1F


def token_ids(text: bytes | None) -> np.ndarray:
    """Ids of the text's words and of its end."""
    cache = worker_state("lm_tokens", Tokens)
    words = (text or b"").lower().split()
    out = np.empty(len(words) + 1, np.int64)
    out[:-1] = np.fromiter(map(cache.__getitem__, words), np.int64, len(words))
    out[-1] = END
    return out


def classes_of(ids: np.ndarray, own_ids: np.ndarray, own_classes: np.ndarray) -> np.ndarray:
    """The class of each id; own_ids is sorted."""
    out = 1 + OWN + (ids & 31)
    at = np.minimum(np.searchsorted(own_ids, ids), len(own_ids) - 1)
    return np.where(own_ids[at] == ids, own_classes[at], out)


def groups(batch: pa.RecordBatch, column: int):
    """Runs of rows of about CHUNK tokens: first row, ids of all, number of tokens of each row."""
    first, parts, n = 0, [], 0
    for i, text in enumerate(batch.column(column).to_pylist()):
        parts.append(token_ids(text))
        n += len(parts[-1])
        if n >= CHUNK:
            yield first, np.concatenate(parts), np.array([len(p) for p in parts])
            first, parts, n = i + 1, [], 0
    if parts:
        yield first, np.concatenate(parts), np.array([len(p) for p in parts])


def histories(classes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The history of each token, class two back times CLASSES plus class one back; class 0 before a text."""
    one = np.concatenate([[0], classes[:-1]])
    two = np.concatenate([[0, 0], classes[:-2]])[: len(classes)]
    starts = np.cumsum(sizes) - sizes
    one[starts] = 0
    two[starts] = 0
    second = starts[sizes > 1] + 1
    two[second] = 0
    return two * CLASSES + one


def count_words(texts: DataFrame) -> DataFrame:
    """token, n over all rows of texts (text as bytes)."""

    def fn(batches):
        for batch in batches:
            for _, ids, _ in groups(batch, 0):
                token, n = np.unique(ids, return_counts=True)
                yield pa.RecordBatch.from_pydict({"token": pa.array(token), "n": pa.array(n)})

    return texts.mapInArrow(fn, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))


def feature_rows(history: np.ndarray) -> np.ndarray:
    """The weight rows (bias, one back, two back, both) of each history."""
    one, two = history % CLASSES, history // CLASSES
    h = (history.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    both = 1 + 2 * CLASSES + ((h >> np.uint64(40)) % np.uint64(FEATURES - 1 - 2 * CLASSES)).astype(np.int64)
    return np.stack([np.zeros_like(one), 1 + one, 1 + CLASSES + two, both], axis=1)


def _log_softmax(logits: np.ndarray) -> np.ndarray:
    top = logits.max(axis=1, keepdims=True)
    return logits - top - np.log(np.exp(logits - top).sum(axis=1, keepdims=True))


_CONTEXT = odd_multipliers(2, 23)


def context_cells(ids: np.ndarray, classes: np.ndarray, sizes: np.ndarray, slots: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Positions of the tokens with a digit, and the cells of their digits under the contexts one back and two back."""
    at = np.flatnonzero(classes > OWN)
    starts = np.cumsum(sizes) - sizes
    first = np.repeat(starts, sizes)[at]  # of each token's text
    out = []
    for back in (1, 2):
        word = np.where(at - back >= first, ids[np.maximum(at - back, 0)], 0).astype(np.uint64)
        slot = ((word * _CONTEXT[back - 1]) >> np.uint64(40)).astype(np.int64) & (slots - 1)
        out.append((((classes[at] - OWN - 1) * slots + slot) * DIGITS) + ((ids[at] >> 5) & (DIGITS - 1)))
    return at, *out


def context_slots(vocabulary: int) -> int:
    """Rows of contexts in a class: a power of two about as large as the vocabulary, at most SLOTS."""
    return min(SLOTS, 1 << max(6, int(vocabulary).bit_length()))


def sum_blocks(rows: DataFrame) -> DataFrame:
    """block, places, counts: the sums by block of rows of that form (places and counts as packed numbers).

    A block's rows are dealt over several tasks first, so that more partitions than blocks share the work; a task holds one block.
    """

    def add(batches):
        key, total = None, None

        def packed():
            at = np.flatnonzero(total)
            names = ("block", "places", "counts")
            arrays = (
                pa.array([key], pa.int32()), pa.array([at.astype("<u2").tobytes()], pa.binary()), pa.array([total[at].astype("<i8").tobytes()], pa.binary())
            )
            return pa.RecordBatch.from_arrays(list(arrays), names=list(names))

        for batch in batches:
            for block, places, counts in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                if block != key:
                    if key is not None:
                        yield packed()
                    key, total = block, np.zeros(BLOCK, np.int64)
                total[np.frombuffer(places, "<u2")] += np.frombuffer(counts, "<i8")  # places are distinct
        if key is not None:
            yield packed()

    spark, schema = rows.sparkSession, "block int, places binary, counts binary"
    small_batches(spark)
    parts = partitions(spark)
    deals = max(1, parts // 64)
    if deals > 1:
        dealt = rows.withColumn("deal", F.pmod(F.spark_partition_id(), F.lit(deals))).repartition(parts, "block", "deal")
        rows = dealt.sortWithinPartitions("deal", "block").select("block", "places", "counts").mapInArrow(add, schema)
    return rows.repartition(parts, "block").sortWithinPartitions("block").mapInArrow(add, schema)


def count_contexts(texts: DataFrame, own_ids: np.ndarray, own_classes: np.ndarray, slots: int) -> DataFrame:
    """block, places, counts over all texts: first the class counts by history, then digit counts by context of each family."""
    own = texts.sparkSession.sparkContext.broadcast((own_ids, own_classes))
    family = ENDINGS * slots * DIGITS

    def count(batches):
        classes, digits = np.zeros(CLASSES**3, np.int64), np.zeros(2 * family, np.int32)
        for batch in batches:
            for _, ids, sizes in groups(batch, 0):
                c = classes_of(ids, *own.value)
                classes += np.bincount(histories(c, sizes) * CLASSES + c, minlength=CLASSES**3)
                _, one, two = context_cells(ids, c, sizes, slots)
                np.add.at(digits, one, 1)
                np.add.at(digits, two + family, 1)
        for first, cells in ((0, classes), (FIRST, digits)):
            for k in range(0, len(cells), BLOCK):
                at = np.flatnonzero(cells[k : k + BLOCK])
                if len(at):
                    places, counts = at.astype("<u2").tobytes(), cells[k : k + BLOCK][at].astype("<i8").tobytes()
                    yield pa.RecordBatch.from_pydict(
                        {
                            "block": pa.array([first + k // BLOCK], pa.int32()),
                            "places": pa.array([places], pa.binary()),
                            "counts": pa.array([counts], pa.binary()),
                        }
                    )

    small_batches(texts.sparkSession)
    return sum_blocks(texts.mapInArrow(count, "block int, places binary, counts binary"))


def train_digits(blocks: DataFrame, shares: np.ndarray, slots: int) -> np.ndarray:
    """p(digit | class, context) / p(digit | class) for every cell, by family; shares is p(digit | class) of the hashed classes.

    Weights start at 0, where the softmax is the class's share, and are updated by damped gradients in the block's task: counts minus
    expected counts minus the penalty, each over its curvature. A context without counts keeps the ratio 1.
    """
    spark = blocks.sparkSession
    shared = spark.sparkContext.broadcast(shares)
    family = ENDINGS * slots * DIGITS

    def fit(batches):
        for batch in batches:
            for block, places, counts in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                n = np.zeros(BLOCK)
                n[np.frombuffer(places, "<u2")] = np.frombuffer(counts, "<i8")
                first = (block - FIRST) * BLOCK % family
                n = n[: min(BLOCK, family - first)].reshape(-1, DIGITS)
                q = shared.value[(first // DIGITS + np.arange(len(n))) // slots]
                seen, weights, p = n.sum(axis=1, keepdims=True), np.zeros_like(n), q
                for _ in range(DIGIT_ROUNDS):
                    slope = n - seen * p - DIGIT_PENALTY * weights
                    weights = weights + DIGIT_STEP * slope / (seen * p + DIGIT_PENALTY)
                    p = q * np.exp(np.clip(weights, -20, 20))
                    p /= p.sum(axis=1, keepdims=True)
                above = np.maximum(CONTEXT_BACK_OFF / (seen + CONTEXT_BACK_OFF), LEAST_BACK_OFF)
                ratio = (1 - above) * p / q + above
                yield pa.RecordBatch.from_pydict(
                    {"block": pa.array([block - FIRST], pa.int32()), "ratio": pa.array([ratio.astype("<f2").tobytes()], pa.binary())}
                )

    out = np.ones((2, family), np.float16)
    for r in blocks.where(F.col("block") >= FIRST).mapInArrow(fit, "block int, ratio binary").toLocalIterator():  # at most 2 x 32 x SLOTS x DIGITS halves
        ratio = np.frombuffer(r["ratio"], "<f2")
        out.reshape(-1)[r["block"] * BLOCK : r["block"] * BLOCK + len(ratio)] = ratio
    return out


def back_off(model: np.ndarray, counts: np.ndarray, prior: np.ndarray | None = None) -> np.ndarray:
    """p(class | history) of the model, mixed with the smoothed shares one class back by how few tokens the history has.

    counts: CLASSES**2 rows of CLASSES numbers. prior: weights of the classes where nothing is known, else from their counts.
    """
    shares = counts.sum(axis=0) + 0.5 if prior is None else prior
    one = counts.reshape(CLASSES, CLASSES, CLASSES).sum(axis=0) + BACK_OFF[0] * shares / shares.sum()
    one /= one.sum(axis=1, keepdims=True)
    above = np.maximum(BACK_OFF[1] / (counts.sum(axis=1, keepdims=True) + BACK_OFF[1]), LEAST_BACK_OFF)
    return (1 - above) * model + above * np.tile(one, (CLASSES, 1))


def train_classes(blocks: DataFrame, rounds: int = ROUNDS, prior: np.ndarray | None = None) -> np.ndarray:
    """log10 p(class | history) for every history: CLASSES**2 rows of CLASSES numbers; prior as for back_off."""
    spark = blocks.sparkSession

    def rows_of(batches):
        for batch in batches:
            for block, places, counts in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                n = np.zeros(BLOCK, np.int64)
                n[np.frombuffer(places, "<u2")] = np.frombuffer(counts, "<i8")
                n = n.reshape(-1, CLASSES)
                at = np.flatnonzero(n.sum(axis=1))
                yield pa.RecordBatch.from_pydict(
                    {"history": pa.array((at + block * BLOCK // CLASSES).astype(np.int32)), "n": pa.array([n[i].tobytes() for i in at], pa.binary())}
                )

    table = blocks.where(F.col("block") < FIRST).mapInArrow(rows_of, "history int, n binary").repartition(6, "history")
    table = materialize(table, "histories")

    weights = np.zeros((FEATURES, CLASSES))
    mean, square = np.zeros_like(weights), np.zeros_like(weights)
    total = 0
    for k in range(1, rounds + 1):
        shared = spark.sparkContext.broadcast(weights)

        def gradient(batches, shared=shared, starting=k == 1):
            out, weight, touched = np.zeros((FEATURES, CLASSES)), 0, np.zeros(FEATURES, bool)
            for batch in batches:
                history = batch.column(0).to_numpy().astype(np.int64)
                counts = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.int64).reshape(-1, CLASSES).astype(float)
                rows = feature_rows(history)
                seen = counts.sum(axis=1, keepdims=True)
                expected = 0 if starting else np.exp(_log_softmax(shared.value[rows].sum(axis=1))) * seen
                for f in range(rows.shape[1]):
                    np.add.at(out, rows[:, f], counts - expected)
                touched[rows] = True
                weight += int(seen.sum())
            if weight:
                at = np.flatnonzero(touched)
                packed = {"features": [at.astype("<i4").tobytes()], "gradient": [out[at].tobytes()]}
                yield pa.RecordBatch.from_pydict({k: pa.array(v, pa.binary()) for k, v in packed.items()} | {"weight": pa.array([weight], pa.int64())})

        # a task sends the rows that its histories have, so all of them send 4 x CLASSES**2 rows at most (8 MB), however many tasks there are
        slope, total = np.zeros((FEATURES, CLASSES)), 0
        for r in table.mapInArrow(gradient, "features binary, gradient binary, weight long").collect():
            slope[np.frombuffer(r["features"], "<i4")] += np.frombuffer(r["gradient"], float).reshape(-1, CLASSES)
            total += r["weight"]
        shared.unpersist()
        if not total:
            break
        if k == 1:  # the counts themselves: start at the class shares and at each class's shares one back
            shares = (slope[0] + 0.5) / (slope[0] + 0.5).sum()
            after = slope[1 : 1 + CLASSES] + 10 * shares
            weights = np.zeros_like(weights)
            weights[0] = np.log(shares)
            weights[1 : 1 + CLASSES] = np.log(after / after.sum(axis=1, keepdims=True)) - weights[0]
            continue
        slope = slope / total - PENALTY * weights
        mean, square = 0.9 * mean + 0.1 * slope, 0.98 * square + 0.02 * slope**2
        step = (mean / (1 - 0.9 ** (k - 1))) / (np.sqrt(square / (1 - 0.98 ** (k - 1))) + 1e-7)
        weights = weights + RATE / math.sqrt(k - 1) * step
    model = np.exp(_log_softmax(weights[feature_rows(np.arange(CLASSES**2))].sum(axis=1)))
    counts = np.zeros((CLASSES**2, CLASSES))
    for r in table.collect():  # at most CLASSES**2 rows
        counts[r["history"]] = np.frombuffer(r["n"], np.int64)
    return np.log10(back_off(model, counts, prior))


def score(docs: DataFrame, learn: DataFrame) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score for every row of docs (doc_id, text), learning from learn (text).

    A null text is the end token alone. Without training rows every word is unknown and classes are equally likely.
    """
    spark = docs.sparkSession
    learn = learn.select(utf8(F.coalesce("text", F.lit(""))).alias("text"))
    words = materialize(count_words(learn), "words")
    totals = words.agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).first()
    n_train, v_train = totals["n"] or 0, totals["v"]
    by_size = {r["k"]: r["words"] for r in words.groupBy(F.floor(F.log2("n")).cast("int").alias("k")).agg(F.count(F.lit(1)).alias("words")).collect()}  # at most 64 rows
    least, held = 64, 0
    while least > 0 and held + by_size.get(least - 1, 0) <= HEAD:
        least -= 1
        held += by_size.get(least, 0)
    threshold = 1 << min(least, 62)
    head = words.where(F.col("n") >= threshold).select("token", "n").toArrow().sort_by("token")  # at most HEAD rows, 16 bytes each
    head_ids, head_counts = (head.column(k).to_numpy() for k in ("token", "n"))
    own = head_ids[np.lexsort((head_ids, -head_counts))]
    own = own[own != END][:OWN]
    order = np.argsort(own)
    own_ids = np.concatenate([[END], own[order]])  # END is smaller than any hash
    own_classes = np.concatenate([[0], 1 + order])
    if not len(head_ids):
        head_ids, head_counts = np.array([-1]), np.array([0])
    slots = context_slots(v_train)
    blocks = materialize(count_contexts(learn, own_ids, own_classes, slots), "contexts")

    own_list = [int(x) for x in own_ids]
    hashed = ~F.col("token").isin(own_list)
    ending = F.when(hashed, F.col("token").bitwiseAND(31)).otherwise(-1)
    digit = F.when(hashed, F.shiftright("token", 5).bitwiseAND(DIGITS - 1)).otherwise(0)
    cells, kinds = np.zeros((ENDINGS, DIGITS)), np.zeros((ENDINGS, DIGITS))
    for r in words.groupBy(ending.alias("c"), digit.alias("d")).agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("v")).collect():  # at most 1 + 32 x DIGITS rows
        if r["c"] >= 0:
            cells[r["c"], r["d"]], kinds[r["c"], r["d"]] = r["n"], r["v"]
    cells = cells + 0.5 * (kinds + 1)
    shares = cells / cells.sum(axis=1, keepdims=True)
    ratios = train_digits(blocks, shares, slots)
    sizes = np.full(CLASSES, 1.0)
    sizes[1 + OWN :] = cells.sum(axis=1)
    at = np.searchsorted(head_ids, own_ids)
    for i, c in enumerate(own_classes):
        if at[i] < len(head_ids) and head_ids[at[i]] == own_ids[i]:
            sizes[c] = head_counts[at[i]] + 1
    within = np.log10(sizes)
    table = train_classes(blocks, prior=sizes)
    base_log = math.log10(n_train + 0.5 * (v_train + 1))
    shared = spark.sparkContext.broadcast((table.astype(np.float64).reshape(-1), ratios, own_ids, own_classes, head_ids, head_counts, within))

    def fn(batches):
        from pyspark import TaskContext

        row = TaskContext.get().partitionId() << 40
        table, ratios, own_ids, own_classes, head_ids, head_counts, within = shared.value
        log_counts = np.log10(head_counts + 0.5)
        for batch in batches:
            for first, ids, sizes in groups(batch, 1):
                starts = np.cumsum(sizes) - sizes
                c = classes_of(ids, own_ids, own_classes)
                history = table[histories(c, sizes) * CLASSES + c] - within[c]
                at, one, two = context_cells(ids, c, sizes, slots)
                history[at] += np.log10(MIX[0] * ratios[0][one].astype(float) + MIX[1] * ratios[1][two].astype(float))
                history = np.add.reduceat(history, starts)
                at = np.minimum(np.searchsorted(head_ids, ids), len(head_ids) - 1)
                known = (head_ids[at] == ids) & (head_counts[at] > 0)
                counted = np.add.reduceat(np.where(known, log_counts[at], 0.0), starts)
                n_known = np.add.reduceat(known.astype(np.int64), starts)
                n_rare = sizes - n_known
                ends = np.concatenate([[0], np.cumsum(n_rare)]).astype(np.int32)
                columns = {
                    "row": pa.array(np.arange(row, row + len(sizes))),
                    "doc_id": batch.column(0).slice(first, len(sizes)),
                    "n_tokens": pa.array(sizes.astype(np.int64)),
                    "n_known": pa.array(n_known),
                    "counted": pa.array(counted),
                    "history": pa.array(history),
                    "rare": pa.ListArray.from_arrays(pa.array(ends), pa.array(ids[~known])),
                }
                yield pa.RecordBatch.from_pydict(columns)
                row += len(sizes)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8(F.coalesce("text", F.lit(""))).alias("text"))
    scored = materialize(
        rows.mapInArrow(fn, "row long, doc_id long, n_tokens long, n_known long, counted double, history double, rare array<long>"), "scored"
    )
    shared.destroy()
    rare = scored.select("row", F.explode("rare").alias("token")).join(words.where(F.col("n") < threshold), "token")
    rare = rare.groupBy("row").agg(F.count(F.lit(1)).alias("rare_known"), F.sum(F.log10(F.col("n") + 0.5)).alias("rare_counted"))
    out = scored.drop("rare").join(rare, "row", "left").na.fill(0, ["rare_known"]).na.fill(0.0, ["rare_counted"])
    n_known = F.col("n_known") + F.col("rare_known")
    counted = F.col("counted") + F.col("rare_counted") + (F.col("n_tokens") - n_known) * math.log10(0.5)
    return out.select(
        "doc_id",
        "n_tokens",
        n_known.alias("n_known"),
        F.lit(int(n_train)).cast("long").alias("train_tokens"),
        (counted - F.col("n_tokens") * base_log).alias("base_score"),
        (counted + F.col("history")).alias("score"),
    )


def op10_lm_score(spark, sf_dir: str) -> DataFrame:
    """Learned from four fifths of documents by id, applied to all."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = score(docs, docs.where(F.col("doc_id").isNotNull() & ~fold("doc_id", 5, 1)))
    return found.select("doc_id", fold("doc_id", 5, 1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
