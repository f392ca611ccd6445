"""Benchmark decontamination: a broadcast set of benchmark word windows against all windows of the training texts.

Words are the runs of digits, ASCII letters and non-ASCII characters after folding A-Z. An item's windows are its runs of `width`
words; a shorter item is one window. Window hashes find candidates, the words themselves confirm them. The benchmark is read in
blocks of about BLOCK_BYTES of text, so what is broadcast at once is bounded however large it gets: about 20 bytes a word and 200 a
distinct word, under half a gigabyte for a block of distinct short words and some tens of megabytes for prose. Texts are cut
or dropped in the pass that finds the last hits, so they are never shuffled.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import drop_worker_state, mix64, odd_multipliers, small_batches, utf8

BLOCK_BYTES = 8 << 20
WIDTH = 10

#: A-Z folded, digits, a-z and bytes of non-ASCII characters kept, all else a separator.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
_POSITION = odd_multipliers(256, 7)


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_FOLD).split()


def _window_hashes(codes: np.ndarray, starts: np.ndarray, k: int) -> np.ndarray:
    out = np.zeros(len(starts), np.uint64)
    for j in range(k):
        out += codes[starts + j].astype(np.uint64) * _POSITION[j % 256]
    return mix64(out)


class Windows:
    """The windows of one block of benchmark items: sorted hashes by length, and where each stands in the block's words."""

    def __init__(self, items: list[tuple[int, bytes]], width: int) -> None:
        #: word -> number from 1; 0 marks words that the block does not have
        self.vocabulary: dict[bytes, int] = {}
        codes, by_length, at = [], {}, 0
        for item, text in items:
            if item is None or not (words := words_of(text)):
                continue
            k = min(width, len(words))
            codes.append(np.fromiter((self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words), np.int32, len(words)))
            by_length.setdefault(k, []).append((at, at + len(words) - k + 1, item))
            at += len(words)
        self.codes = np.concatenate(codes) if codes else np.empty(0, np.int32)
        self.by_length: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for k, runs in by_length.items():
            starts = np.concatenate([np.arange(a, b) for a, b, _ in runs])
            owners = np.repeat(np.array([item for _, _, item in runs], np.int64), [b - a for a, b, _ in runs])
            hashes = _window_hashes(self.codes, starts, k)
            order = np.argsort(hashes, kind="stable")
            self.by_length[k] = (hashes[order], starts[order].astype(np.int32), owners[order])

    def hits(self, words: list[bytes]) -> tuple[np.ndarray | None, set[int]]:
        """The mask of hit words (None without any) and the items that occur."""
        n = len(words)
        codes = np.fromiter(map(self.vocabulary.get, words, repeat(0)), np.int32, n)
        known = np.concatenate([[0], np.cumsum(codes != 0)])
        mask, items = None, set()
        for k, (hashes, places, owners) in self.by_length.items():
            if n < k:
                continue
            starts = np.flatnonzero(known[k:] - known[:-k] == k)
            if not len(starts):
                continue
            found = _window_hashes(codes, starts, k)
            first, last = np.searchsorted(hashes, found, side="left"), np.searchsorted(hashes, found, side="right")
            for i in np.flatnonzero(last > first).tolist():
                window = codes[starts[i] : starts[i] + k]
                for at in range(int(first[i]), int(last[i])):  # equal hashes: items that share the window
                    if np.array_equal(window, self.codes[places[at] : places[at] + k]):
                        mask = np.zeros(n, bool) if mask is None else mask
                        mask[starts[i] : starts[i] + k] = True
                        items.add(int(owners[at]))
        return mask, items


def _ranges(mask: np.ndarray) -> list[list[int]]:
    """First and one-past-last word of each run of hit words."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], mask.astype(np.int8), [0]])))
    return edge.reshape(-1, 2).tolist()


#: What the last pass makes of a batch, its words' numbers, hit ranges and items.
Finish = Callable[[pa.RecordBatch, list[int], list[list[list[int]]], list[list[int]]], pa.RecordBatch]


def _passes(rows: DataFrame, benchmark: DataFrame, width: int, finish: Finish, schema) -> DataFrame:
    """rows (with a column text) through one pass for each block of the benchmark; the last one returns what finish makes of them."""
    spark = rows.sparkSession
    bench = benchmark.select(F.col("item_id").cast("long").alias("item_id"), utf8("text").alias("text")).where("item_id is not null and text is not null")
    total = bench.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = total // BLOCK_BYTES + 1
    width_in, text_at = len(rows.columns), rows.columns.index("text")
    hits, items_name = "hits", "items"
    while {hits, items_name} & set(rows.columns):
        hits, items_name = hits + "_", items_name + "_"
    extra = [T.StructField(hits, T.ArrayType(T.ArrayType(T.IntegerType()))), T.StructField(items_name, T.ArrayType(T.LongType()))]
    carried = T.StructType([*rows.schema.fields, *extra])
    for block in range(blocks):
        listed = bench.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).collect()  # about BLOCK_BYTES
        windows = spark.sparkContext.broadcast(Windows([(r.item_id, bytes(r.text)) for r in listed], width))

        def run(batches, windows=windows, first=block == 0, last=block == blocks - 1):
            drop_worker_state()
            for batch in batches:
                if not batch.num_rows:
                    continue
                ranges, items, n_words = [], [], []
                texts = batch.column(text_at).cast(pa.binary()).to_pylist()
                before = repeat((None, None)) if first else zip(batch.column(width_in).to_pylist(), batch.column(width_in + 1).to_pylist(), strict=True)
                for text, (old, old_items) in zip(texts, before, strict=False):
                    words = words_of(text)
                    mask, got = windows.value.hits(words)
                    if old:
                        mask = np.zeros(len(words), bool) if mask is None else mask
                        for a, b in old:
                            mask[a:b] = True
                    n_words.append(len(words))
                    ranges.append([] if mask is None else _ranges(mask))
                    items.append(sorted(got | set(old_items or ())))
                own = pa.RecordBatch.from_arrays(batch.columns[:width_in], names=batch.schema.names[:width_in])
                if last:
                    yield finish(own, n_words, ranges, items)
                else:
                    arrays = [*own.columns, pa.array(ranges, pa.list_(pa.list_(pa.int32()))), pa.array(items, pa.list_(pa.int64()))]
                    yield pa.RecordBatch.from_arrays(arrays, names=[*own.schema.names, hits, items_name])

        small_batches(spark)
        rows = rows.mapInArrow(run, schema if block == blocks - 1 else carried)
    return rows


def scan(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, n_words, hit_ranges (first word, one past the last word), item_ids (sorted) for every row of docs (doc_id, text).

    A null or blank text has no words; items without id or words have no windows; repeated rows get equal results.
    """

    def finish(batch, n_words, ranges, items):
        columns = {"doc_id": batch.column(0), "n_words": pa.array(n_words, pa.int64())}
        columns |= {"hit_ranges": pa.array(ranges, pa.list_(pa.list_(pa.int32()))), "item_ids": pa.array(items, pa.list_(pa.int64()))}
        return pa.RecordBatch.from_pydict(columns)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return _passes(rows, benchmark, width, finish, "doc_id long, n_words long, hit_ranges array<array<int>>, item_ids array<long>")


def cut_words(text: str, ranges: list[list[int]]) -> str:
    """The text without the characters from each range's first to its last word; what stands around is kept."""
    data = text.encode()
    folded = data.translate(_FOLD)
    spans, at = [], 0
    for word in folded.split():
        at = folded.index(word, at)
        spans.append((at, at + len(word)))
        at += len(word)
    kept, last = [], 0
    for a, b in ranges:
        kept.append(data[last : spans[a][0]])
        last = spans[b - 1][1]
    return b"".join([*kept, data[last:]]).decode()


def decontaminate(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, drop_share: float = 0.5) -> DataFrame:
    """docs with benchmark passages cut out; a document with more than drop_share of its words hit is left out.

    Columns of docs are kept; n_chars, if present, is renewed for cut texts. Texts without hits stay as they are. Rows are judged one
    by one, so repeated rows and rows without an id need no care; nothing is shuffled.
    """
    names = docs.columns
    text_at, chars_at = names.index("text"), names.index("n_chars") if "n_chars" in names else None

    def finish(batch, n_words, ranges, items):
        hit = [sum(b - a for a, b in r) for r in ranges]
        if any(hit):
            arrays = list(batch.columns)
            texts = arrays[text_at].to_pylist()
            chars = arrays[chars_at].to_pylist() if chars_at is not None else None
            for i, found in enumerate(ranges):
                if found:
                    texts[i] = cut_words(texts[i], found)
                    if chars is not None:
                        chars[i] = len(texts[i])
            arrays[text_at] = pa.array(texts, arrays[text_at].type)
            if chars is not None:
                arrays[chars_at] = pa.array(chars, arrays[chars_at].type)
            batch = pa.RecordBatch.from_arrays(arrays, names=names)
        return batch.filter(pa.array([h <= drop_share * n for h, n in zip(hit, n_words, strict=True)], pa.bool_()))

    return _passes(docs, benchmark, width, finish, docs.schema)


def op1_decontaminate(spark, sf_dir: str) -> DataFrame:
    """Ten-word windows of benchmark against all documents."""
    docs, benchmark = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    found = scan(docs.select("doc_id", "text"), benchmark)
    names = F.array_sort(F.transform("item_ids", lambda i: i.cast("string")))
    n_hit = F.aggregate("hit_ranges", F.lit(0).cast("long"), lambda s, r: s + (r[1] - r[0]))
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join(names, ","), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP1_SQL = rf"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, w, least(10, len(w)) AS k FROM (SELECT item_id, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL) WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS g FROM b, unnest(range(1, len(w) - k + 2)) AS t(i)),
dw AS (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS g
       FROM d, (SELECT DISTINCT k FROM b) AS ks, unnest(range(1, len(w) - k + 2)) AS t(i) WHERE len(w) >= k),
m AS (SELECT doc_id, i, k, item_id FROM dw JOIN bw USING (k, g)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM m) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS names
       FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM m) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)
"""
