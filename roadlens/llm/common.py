"""Shared pieces of the training-data operators."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest id list that is broadcast (8 bytes a row); longer lists are joined by a shuffle.
BROADCAST_IDS = 1_000_000
#: Most rows of an Arrow batch: some megabytes of text, where Spark's default of 10,000 rows would be tens of them in each worker.
BATCH_ROWS = 2_000
#: Most ids that are sampled for range bounds.
SAMPLED_IDS = 1_000_000
#: A key of more than one row in HOT is joined by a broadcast; there can be no more than HOT such keys.
HOT = 2_000

_MASK = (1 << 64) - 1


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that setting is missing, a new temporary one in local mode and an error on a cluster."""
    small_batches(spark)
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="spark-ckpt-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Cut the lineage: write df as Parquet into the shared folder and read it back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def keep_ids(df: DataFrame, key: str, ids: DataFrame, n_ids: int) -> DataFrame:
    """Rows of df whose key is among ids (one column of that name); broadcast only below BROADCAST_IDS rows."""
    return df.join(F.broadcast(ids) if n_ids <= BROADCAST_IDS else ids, key, "left_semi")


def join_hot(rows: DataFrame, table: DataFrame, keys: list[str], weight: str, total: int, spread: str) -> DataFrame:
    """Inner join of rows with table, which has one row for each key and, in `weight`, how many of the `total` rows have it.

    Keys that more than total / HOT rows have are broadcast (at most HOT of them), and their rows are dealt by `spread`; all
    other keys are joined by a shuffle, in which none of them is large.
    """
    rest = F.struct(*[c for c in table.columns if c not in keys])
    hot = F.col(weight) > total / HOT
    heavy = table.where(hot).select(*keys, rest.alias("_heavy"))
    light = table.where(~hot).select(*keys, rest.alias("_light"), F.lit(0).alias("_deal"))
    dealt = rows.join(F.broadcast(heavy), keys, "left")
    dealt = dealt.withColumn("_deal", F.when(F.col("_heavy").isNull(), 0).otherwise(1 + F.pmod(F.xxhash64(spread), F.lit(1 << 20)).cast("int")))
    found = dealt.join(light, [*keys, "_deal"], "left").withColumn("_found", F.coalesce("_heavy", "_light")).where("_found is not null")
    return found.select(*rows.columns, "_found.*")


def utf8(column: str | Column) -> Column:
    """A string column as its UTF-8 bytes; ASCII case folding and splitting are cheap on bytes."""
    return (F.col(column) if isinstance(column, str) else column).cast("binary")


def small_batches(spark: SparkSession) -> None:
    """Rows of whole texts go to Python in batches of at most BATCH_ROWS, unless the session asks for fewer.

    This lowers the session's own setting, which stays lowered: Spark reads it when a plan runs, so it cannot be given back here.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def map_arrow(df: DataFrame, fn: Callable[[pa.RecordBatch], dict[str, object] | None], schema: str, rows: int = BATCH_ROWS, stateless: bool = False) -> DataFrame:
    """Apply fn to each Arrow batch, cut into pieces of at most `rows` rows; fn returns the columns of the output batch.

    stateless: fn needs no worker_state of an earlier task, so what one left in the worker goes first.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        if stateless:
            drop_worker_state()
        for batch in batches:
            for first in range(0, batch.num_rows, rows):
                if (columns := fn(batch.slice(first, rows))) is not None:
                    yield pa.RecordBatch.from_pydict(columns)

    small_batches(df.sparkSession)
    return df.mapInArrow(run, schema)


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser over an array of uint64."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def odd_multipliers(n: int, seed: int) -> np.ndarray:
    """n odd 64-bit numbers that depend on the seed alone."""
    return np.random.default_rng(seed).integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def worker_state(key: str, make: Callable[[], object]) -> object:
    """An object kept for the life of the Python worker, so that a later task in it finds a warm cache; one at a time, to bound memory."""
    import sys
    import types

    state = sys.modules.setdefault("_roadlens_worker_state", types.ModuleType("_roadlens_worker_state"))
    if (getattr(state, "held", None) or (None, None))[0] != key:
        state.held = None
        state.held = (key, make())
    return state.held[1]


def drop_worker_state() -> None:
    """Let go of what an earlier task's worker_state held, for tasks that need none, and hand freed memory back to the system.

    Python workers outlive stages: what one stage leaves in them counts beside the next stage's heap.
    """
    import ctypes
    import sys

    if (state := sys.modules.get("_roadlens_worker_state")) is not None:
        state.held = None
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux" and hasattr(libc := ctypes.CDLL(None), "malloc_trim"):
        libc.malloc_trim(0)


class WordHashes(dict):
    """word -> 64-bit hash, filled on demand; emptied when it holds `most` words, so memory stays bounded."""

    def __init__(self, most: int = 250_000) -> None:
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= self.most:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def word_hashes(words: list[bytes], cache: WordHashes | None = None) -> np.ndarray:
    """The words' hashes as uint64."""
    cache = worker_state("word_hashes", WordHashes) if cache is None else cache
    return np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))


def id_bounds(df: DataFrame, key: str, parts: int, per_part: int = 40) -> np.ndarray:
    """At most parts - 1 increasing values that split the keys evenly: quantiles of a hash sample of at most SAMPLED_IDS keys.

    The sample depends on the keys alone, so a rerun gives the same bounds.
    """
    ids = df.select(F.col(key).cast("long").alias("k")).where("k is not null")
    n = ids.count()
    if parts <= 1 or not n:
        return np.empty(0, np.int64)
    want = min(parts * per_part, SAMPLED_IDS // 4)
    step = max(1, n // want)
    rows = ids.where(F.pmod(F.xxhash64("k"), F.lit(step)) == 0).groupBy("k").count().select("k").orderBy("k").limit(4 * want).collect()
    found = np.array([r.k for r in rows], np.int64)
    return np.unique(found[np.arange(1, parts) * len(found) // parts]) if len(found) else found


def range_of(spark: SparkSession, key: str, bounds: np.ndarray) -> Column:
    """How many of the bounds are at most the key (0 for a null key). The bounds are broadcast, not written into the plan; keys alone go to Python."""
    shared = spark.sparkContext.broadcast(bounds)

    @F.arrow_udf("int")
    def place(keys: pa.Array) -> pa.Array:
        at = np.searchsorted(shared.value, keys.fill_null(0).to_numpy(zero_copy_only=False), side="right")
        return pa.array(np.where(keys.is_null().to_numpy(zero_copy_only=False), 0, at).astype(np.int32))

    return place(F.col(key).cast("long"))


#: Bits of a map of 64-bit keys (16 MB); a map that is fuller lets more keys pass in vain, and loses none.
MAP_BITS = 27


def key_map(keys: DataFrame) -> np.ndarray:
    """A bitmap with a bit for the upper MAP_BITS bits of each key (a column `key` of evenly spread longs); tasks make its 8 KB pieces."""
    place = F.shiftrightunsigned("key", 64 - MAP_BITS)
    bits = keys.select(F.shiftright(place, 16).cast("int").alias("piece"), place.bitwiseAND(F.lit(0xFFFF).cast("long")).cast("int").alias("bit"))

    def piece(table: pa.Table) -> pa.Table:
        found = np.zeros(1 << 16, bool)
        found[table.column("bit").to_numpy()] = True
        packed = np.packbits(found, bitorder="little").tobytes()
        return pa.table({"piece": table.column("piece")[:1].cast(pa.int32()), "bits": pa.array([packed], pa.binary())})

    out = np.zeros(1 << (MAP_BITS - 3), np.uint8)
    for row in bits.distinct().groupBy("piece").applyInArrow(piece, "piece int, bits binary").collect():  # 16 MB at most
        out[row.piece << 13 : (row.piece + 1) << 13] = np.frombuffer(row.bits, np.uint8)
    return out


def in_map(bitmap: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which of the keys (uint64) may be among those of the map."""
    place = (keys >> np.uint64(64 - MAP_BITS)).astype(np.int64)
    return (bitmap[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1


def may_be_in(spark: SparkSession, bitmap: np.ndarray, key: Column) -> Column:
    """in_map as a column over longs without nulls."""
    shared = spark.sparkContext.broadcast(bitmap)

    @F.arrow_udf("boolean")
    def found(keys: pa.Array) -> pa.Array:
        return pa.array(in_map(shared.value, keys.to_numpy(zero_copy_only=False).view(np.uint64)))

    return found(key)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
