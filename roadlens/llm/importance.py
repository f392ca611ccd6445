"""Importance resampling towards a target: documents are drawn in proportion to how much likelier the target makes their n-grams.

Arrow kernels fold and split whole texts and encode the words of a batch as a dictionary; shifted indices form the n-grams, so that only
the distinct ones of a batch are spelled out and hashed to buckets. Bucket counts of the corpus and of the target are summed by Spark;
their log ratios (one integer a bucket, a bounded table) are broadcast, taken for each n-gram and summed for each document. A document's
weight and a Gumbel number that depends on its id make its score, and the highest scores are a draw without replacement. Ranks go over
ranges of scores with carried counts, so no task sorts all documents.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import BROADCAST_IDS, id_bounds, map_arrow, materialize, partitions, range_of, small_batches

BUCKETS, ORDER = 10_000, 1
LEAST_WORDS, PER_CENT, SEED = 20, 10, 2024
#: What lies between words: all ASCII characters but digits and letters.
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def encoded_words(texts: pa.Array) -> tuple[np.ndarray, list[bytes], np.ndarray]:
    """Of a batch of texts: each word's index into the distinct words, these words, and how many words each text has."""
    lists = pc.split_pattern_regex(pc.ascii_lower(texts), _BETWEEN)
    words, owner = pc.list_flatten(lists), pc.list_parent_indices(lists)
    real = pc.not_equal(words, "")
    coded = words.filter(real).dictionary_encode()
    sizes = np.bincount(owner.filter(real).to_numpy(zero_copy_only=False), minlength=len(texts))
    distinct = [w.encode() for w in coded.dictionary.to_pylist()]
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), distinct, sizes


def buckets_of(codes: np.ndarray, words: list[bytes], sizes: np.ndarray, order: int, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length 1 to order: the buckets of all n-grams, text after text, and how many each text has."""
    ends = np.cumsum(sizes)
    last = np.repeat(ends, sizes)  # where the text of each word ends
    grams, spelled = codes, words
    for n in range(1, order + 1):
        if n > 1:  # the n-gram that begins at a word: its (n-1)-gram, then the word n - 1 places on
            inside = np.arange(len(codes)) + n <= last
            at = np.flatnonzero(inside)
            long = np.full(len(codes), -1, np.int64)
            pairs, long[at] = np.unique(grams[at] * np.int64(max(1, len(words))) + codes[at + n - 1], return_inverse=True)
            spelled = [spelled[p // len(words)] + b" " + words[p % len(words)] for p in pairs.tolist()]
            grams = long
        table = np.fromiter((zlib.crc32(g) % buckets for g in spelled), np.int64, len(spelled))
        have = grams >= 0
        yield table[grams[have]], np.maximum(sizes - n + 1, 0)


def bucket_counts(texts: DataFrame, order: int = ORDER, buckets: int = BUCKETS) -> np.ndarray:
    """How many n-grams of all texts (a column text) fall into each bucket; null and blank texts have none."""
    small_batches(texts.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)  # one for each task
        for batch in batches:
            for found, _ in buckets_of(*encoded_words(batch.column(0)), order, buckets):
                total += np.bincount(found, minlength=buckets)
        at = np.flatnonzero(total)
        if len(at):
            yield pa.RecordBatch.from_pydict({"bucket": pa.array(at.astype(np.int32)), "n": pa.array(total[at])})

    summed = texts.select(F.col("text").cast("string")).mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for bucket, n in summed.collect():  # at most `buckets` rows
        out[bucket] = n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of smoothed bucket probabilities, target to corpus, rounded down."""
    k = float(len(corpus))
    ratio = ((target + 1.0) * (float(corpus.sum()) + k)) / ((corpus + 1.0) * (float(target.sum()) + k))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


def weigh(docs: DataFrame, gain: np.ndarray, order: int = ORDER) -> DataFrame:
    """doc_id, n_words, n_features, weight (sum of the gains of all n-grams; 0 without any) of every row of docs (doc_id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(gain)

    def fn(batch: pa.RecordBatch) -> dict[str, object]:
        table = shared.value
        codes, words, sizes = encoded_words(batch.column(1))
        features, weight = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
        for found, counts in buckets_of(codes, words, sizes, order, len(table)):
            some = np.flatnonzero(counts)
            if len(some):
                starts = np.cumsum(counts[some]) - counts[some]
                weight[some] += np.add.reduceat(table.take(found), starts)
            features += counts
        return {"doc_id": batch.column(0), "n_words": pa.array(sizes.astype(np.int64)), "n_features": pa.array(features), "weight": pa.array(weight)}

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_arrow(rows, fn, "doc_id long, n_words long, n_features long, weight long")


def gumbel(doc_id: str, seed: int = SEED) -> Column:
    """Thousandths of a standard Gumbel number that the id and the seed decide, rounded down."""
    digits = F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col(doc_id).cast("string")), 256), 1, 8)
    share = (F.conv(digits, 16, 10).cast("double") + 0.5) / F.lit(4294967296.0)
    return F.floor(F.lit(-1000.0) * F.log(-F.log(share))).cast("long")


def draw(scored: DataFrame, per_cent: int = PER_CENT, least_words: int = LEAST_WORDS) -> DataFrame:
    """scored (doc_id, n_words, score, ...) with rank: 1, 2, 3... for the drawn rows by falling score, then rising id; else null.

    Of N rows with at least least_words words, floor(per_cent * N / 100) are drawn. Rows without an id are not drawn. Rows of one id and
    score take neighbouring ranks. Only rows in the score ranges above the cut are shuffled.
    """
    spark = scored.sparkSession
    fits = F.col("doc_id").isNotNull() & (F.col("n_words") >= least_words)
    bounds = id_bounds(scored.where(fits), "score", partitions(spark))
    placed = scored.withColumn("_range", F.when(fits, range_of(spark, "score", bounds)))
    counts = {r["_range"]: r["count"] for r in placed.where("_range is not null").groupBy("_range").count().collect()}  # at most one row a range
    wanted = sum(counts.values()) * per_cent // 100
    before, above = [], 0
    for place in sorted(counts, reverse=True):
        if above >= wanted:
            break
        before.append((place, above))
        above += counts[place]
    none = F.lit(None).cast("long").alias("rank")
    if not before:
        return scored.select("*", none)
    lowest = before[-1][0]
    carried = F.broadcast(spark.createDataFrame(before, "_range int, _before long"))
    own = F.row_number().over(Window.partitionBy("_range").orderBy(F.desc("score"), "doc_id")).cast("long") + F.col("_before")
    high = placed.where(F.col("_range") >= lowest).join(carried, "_range").withColumn("rank", own)
    high = high.select(*scored.columns, F.when(F.col("rank") <= wanted, F.col("rank")).alias("rank"))
    return high.unionByName(placed.where(~F.coalesce(F.col("_range") >= lowest, F.lit(False))).select(*scored.columns, none))


def resample(docs: DataFrame, target: DataFrame, per_cent: int = PER_CENT, order: int = ORDER, buckets: int = BUCKETS, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score, rank of every row of docs (doc_id, text), drawn towards the texts of target (text).

    A null or blank text has no features, weight 0 and is too short to be drawn; an empty target or an empty docs gives weights by the
    smoothing alone. A row without an id has a null score. Repeated rows are scored alike; other columns are left out.
    """
    gain = gains(bucket_counts(docs, order, buckets), bucket_counts(target, order, buckets))
    scored = weigh(docs, gain, order).withColumn("score", F.col("weight") + gumbel("doc_id", seed))
    return draw(materialize(scored, "weighed"), per_cent).select("doc_id", "n_features", "weight", "score", "rank")


def select_drawn(docs: DataFrame, target: DataFrame, per_cent: int = PER_CENT, order: int = ORDER) -> DataFrame:
    """The rows of docs that are drawn, with all their columns; doc_id is taken as unique. Texts are shuffled only beyond BROADCAST_IDS drawn ids."""
    drawn = materialize(resample(docs, target, per_cent, order).where("rank is not null").select("doc_id"), "drawn")
    return docs.join(F.broadcast(drawn) if drawn.count() <= BROADCAST_IDS else drawn, "doc_id", "left_semi").select(*docs.columns)


def op13_importance_resampling(spark, sf_dir: str) -> DataFrame:
    """All documents, drawn towards the benchmark's texts."""
    docs, benchmark = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return resample(docs, benchmark)


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
#: CTE `tab`: the 256 entries of the crc32 table, made from its polynomial.
CRC_TABLE = """tab AS (SELECT list(list_reduce(range(8), lambda a, x: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, b) ORDER BY b) AS t
        FROM range(256) AS r(b))"""


def crc_sql(text: str) -> str:
    """DuckDB SQL for the unsigned crc32 of a string's UTF-8 bytes, where `t` of CRC_TABLE is in scope."""
    nibble = lambda at: f"(strpos('0123456789ABCDEF', substr(hex(encode({text})), {at}, 1)) - 1)"
    octets = f"list_transform(range(1, octet_length(encode({text})) + 1), lambda i: 16 * {nibble('2 * i - 1')} + {nibble('2 * i')})"
    return f"xor(list_reduce({octets}, lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1]), 4294967295), 4294967295)"


OP13_SQL = rf"""
WITH {CRC_TABLE},
d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
dw AS (SELECT doc_id, unnest(w) AS f FROM d),
bw AS (SELECT unnest({_WORDS}) AS f FROM benchmark),
h AS (SELECT f, {crc_sql('f')} % 10000 AS bucket FROM (SELECT f FROM dw UNION SELECT f FROM bw), tab),
s AS (SELECT bucket, count(*) AS s FROM dw JOIN h USING (f) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM bw JOIN h USING (f) GROUP BY bucket),
n AS (SELECT CAST((SELECT count(*) FROM dw) AS DOUBLE) AS sn, CAST((SELECT count(*) FROM bw) AS DOUBLE) AS tn),
g AS (SELECT bucket, CAST(floor(1000 * ln(((coalesce(t, 0) + 1.0::DOUBLE) * (sn + 10000)) / ((coalesce(s, 0) + 1.0::DOUBLE) * (tn + 10000)))) AS BIGINT) AS gain
      FROM s FULL JOIN t USING (bucket), n),
x AS (SELECT doc_id, sum(gain) AS weight FROM dw JOIN h USING (f) JOIN g USING (bucket) GROUP BY doc_id),
y AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight, substr(sha256('2024:' || doc_id), 1, 8) AS hx
      FROM d LEFT JOIN x USING (doc_id)),
z AS (SELECT *, list_reduce(list_transform(range(1, 9), lambda i: strpos('0123456789abcdef', substr(hx, i, 1)) - 1), lambda a, b: 16 * a + b) AS h FROM y),
q AS (SELECT doc_id, n_features, weight, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score FROM z),
r AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS k, (SELECT count(*) FROM q WHERE n_features >= 20) * 10 // 100 AS m FROM q)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND k <= m THEN k END AS rank FROM r
"""
