"""Document fingerprints: content-defined chunking by a normalised gear hash.

Chunk ends lie where the gear hash of the last 32 bytes has enough zero bits: more of them before the wanted size, fewer after it,
so sizes gather round it. A fingerprint is the set of chunk digests with their lengths, written `digest:length` and joined by
commas in digest order; likeness is the shared length over the smaller total length, a containment that shifts do not disturb.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_bounds, partitions, range_of, small_batches

#: Chunk sizes in bytes: least, wanted, most; bits that must be zero before and after the wanted size.
LEAST, WANTED, MOST = 16, 64, 256
STRICT, LOOSE = np.uint32(0xFE000000), np.uint32(0xF8000000)
_GEAR = np.random.default_rng(8).integers(0, 1 << 32, 256, dtype=np.uint32)


def gear(data: np.ndarray) -> np.ndarray:
    """The gear hash after each byte, over the last 32 bytes, by doubling."""
    h = _GEAR[data]
    for step in (1, 2, 4, 8, 16):
        if len(h) > step:
            shifted = h.copy()
            shifted[step:] += h[:-step] << np.uint32(step)
            h = shifted
    return h


def chunk_ends(data: bytes) -> list[int]:
    """Ends of the chunks of data; the last is its length."""
    n = len(data)
    if n <= LEAST:
        return [n] if n else []
    h = gear(np.frombuffer(data, np.uint8))
    loose = np.flatnonzero((h & LOOSE) == 0)
    strict = loose[(h[loose] & STRICT) == 0]
    loose, strict = [*loose.tolist(), n], [*strict.tolist(), n]
    ends, start, a, b = [], 0, 0, 0
    while start < n:
        low, mid, high = min(start + LEAST, n) - 1, start + WANTED - 1, min(start + MOST, n) - 1
        while strict[a] < low:
            a += 1
        if strict[a] <= min(mid, high):
            end = strict[a] + 1
        else:
            while loose[b] <= mid and loose[b] < n:
                b += 1
            end = min(loose[b], high) + 1
        end = min(end, n)
        ends.append(end)
        start = end
    return ends


def fingerprint(data: bytes) -> dict[str, int]:
    """Chunk digest (12 hex digits) -> length, in digest order."""
    import xxhash

    out, start = {}, 0
    for end in chunk_ends(data):
        out[xxhash.xxh3_64_hexdigest(data[start:end])[:12]] = end - start
        start = end
    return dict(sorted(out.items()))


def render(found: dict[str, int]) -> str:
    return ",".join(f"{k}:{v}" for k, v in found.items())


def likeness(x: dict[str, int], y: dict[str, int]) -> float:
    """Shared length over the smaller total length; 1 for two empty texts, 0 for one."""
    if not x or not y:
        return float(not x and not y)
    if len(y) < len(x):
        x, y = y, x
    return min(1.0, sum(v for k, v in x.items() if k in y) / min(sum(x.values()), sum(y.values())))


def with_next(docs: DataFrame) -> DataFrame:
    """Rows of docs (doc_id, text) in ranges of ids, one a partition, in descending order, each ended by the row that follows it.

    bucket, doc_id, text, tail: the tail row of a range is the first row of the next non-empty one (of the first after the last).
    Only one id for each range goes to the driver; texts are shuffled once.
    """
    spark = docs.sparkSession
    bounds = id_bounds(docs, "doc_id", partitions(spark))
    ids = docs.select("doc_id").where("doc_id is not null")
    heads = ids.groupBy(range_of(spark, "doc_id", bounds).alias("bucket")).agg(F.max("doc_id").alias("head")).orderBy(F.desc("bucket")).collect()
    heads = [(r["bucket"], r["head"]) for r in heads]  # one row for each range
    follows = [(head, heads[i - 1][0]) for i, (_, head) in enumerate(heads)]
    first = docs.join(
        F.broadcast(spark.createDataFrame(follows, "doc_id long, goes int")), "doc_id"
    ).groupBy("goes", "doc_id").agg(F.min("text").alias("text"))
    # a tail is dealt by the id of the range that it ends
    end = spark.createDataFrame([(bucket, head) for bucket, head in heads], "goes int, at long")
    tails = first.join(F.broadcast(end), "goes").select("doc_id", "text", F.lit(True).alias("tail"), "at")
    rows = docs.select("doc_id", "text", F.lit(False).alias("tail"), F.col("doc_id").alias("at")).unionByName(tails)
    dealt = rows.withColumn("bucket", range_of(spark, "at", bounds)).repartitionById(len(bounds) + 1, "bucket").select("bucket", "doc_id", "text", "tail")
    return dealt.sortWithinPartitions("bucket", "tail", F.desc_nulls_last("doc_id"), "text")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for every row of docs (doc_id, text).

    The edited text is the text whose last floor(n_chars / 2) characters give way to the first as many (or all) of the document
    that follows by descending doc_id, the first following the last. Equal ids are ordered by text; a null text is empty; a row
    without doc_id comes last in its bucket and is followed by nothing there (an empty text).
    """
    rows = with_next(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")))
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    types = [
        ("doc_id", pa.int64()),
        ("n_chars", pa.int64()),
        ("edited_sha256", pa.string()),
        ("fingerprint", pa.string()),
        ("edited_fingerprint", pa.string()),
        ("near_edited", pa.float64()),
        ("near_next", pa.float64()),
    ]

    def run(batches):
        out: list[tuple] = []
        held = None  # the row before: bucket, doc_id, text, fingerprint

        def done(row, text: str, found: dict[str, int]) -> None:
            _, doc_id, own, mine = row
            half = len(own) // 2
            edited = (own[: len(own) - half] + text[:half]).encode()
            changed = fingerprint(edited)
            out.append(
                (doc_id, len(own), hashlib.sha256(edited).hexdigest(), render(mine), render(changed), likeness(mine, changed), likeness(mine, found))
            )

        def emit():
            columns = list(zip(*out, strict=True))
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, types, strict=True)], names=[n for n, _ in types])

        for batch in batches:
            for bucket, doc_id, text, tail in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found = fingerprint(text.encode())
                if held is not None:
                    done(held, *((text, found) if held[0] == bucket else ("", {})))
                held = None if tail else (bucket, doc_id, text, found)
            if out:
                yield emit()
        if held is not None:
            done(held, "", {})
            yield emit()

    small_batches(docs.sparkSession)
    return rows.mapInArrow(run, schema)


def op8_fingerprints(spark, sf_dir: str) -> DataFrame:
    """All documents."""
    return fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
