"""Packing by minimum bin slack.

Documents are tokenised once and cut into full windows and one remainder. The planner sees only how many remainders have each
length (at most `window` numbers, whatever the corpus): it fixes the longest length left, and a bitset subset-sum picks the multiset
of remaining lengths whose sum comes closest to the window's free space; backtracking gives the counts, and the pattern is used as
often as they allow. Lengths that no multiset completes exactly are laid end to end and cut at window bounds; what is left at
the end is cut into sequences of powers of two, which need no padding. Pieces learn their places from their rank among pieces of
equal length, which is counted in salted slots, so a length that a third of the corpus has is no hot group.
"""

from __future__ import annotations

import base64
import json
import re
import sys
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_arrow, materialize, partitions, worker_state

WINDOW = 2048
END = 1
#: Pieces that are cut anew go to all executors up to so many (about 100 bytes each); more of them are joined by a shuffle.
BROADCAST_PIECES = 200_000


class Encoder:
    """Ids of whole texts as little-endian 32-bit numbers. Most words of a corpus are rare, so a cache of words costs more than it saves."""

    def __init__(self, path: str) -> None:
        import tiktoken
        from public_tokenizers import PATTERN

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.encode = tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def ids(self, text: str) -> bytes:
        ids = array("I", self.encode(text))
        if sys.byteorder != "little":
            ids.byteswap()
        return ids.tobytes()


def default_vocabulary() -> str:
    """The rank file of the byte-level vocabulary whose ids are those of byte_bpe_50k.json."""
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.tiktoken"))


def added_tokens() -> dict[str, int]:
    """The added tokens of byte_bpe_50k.json and their ids: tokenizers finds these in a text before it splits the rest."""
    import public_tokenizers

    with open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8") as file:
        return {t["content"]: t["id"] for t in json.load(file)["added_tokens"]}


def tokenize(text: str | None, path: str, end: int = END, added: dict[str, int] | None = None) -> bytes:
    """The text's ids and the end id; an added token in the text is one id, or plain text where none are given."""
    encoder = worker_state("encoder", lambda: Encoder(path))
    text = text or ""
    if not any(token in text for token in added or ()):
        return encoder.ids(text) + end.to_bytes(4, "little")
    out, at = [], 0
    for m in re.finditer("|".join(map(re.escape, sorted(added, key=len, reverse=True))), text):
        out += [encoder.ids(text[at : m.start()]), added[m.group()].to_bytes(4, "little")]
        at = m.end()
    return b"".join([*out, encoder.ids(text[at:]), end.to_bytes(4, "little")])


def pieces_of(docs: DataFrame, path: str, window: int = WINDOW, end: int = END, added: dict[str, int] | None = None) -> DataFrame:
    """doc_id, row_hash, start, length, ids_crc32, doc_tokens: the full windows of each document and its remainder."""

    def fn(batch: pa.RecordBatch) -> dict[str, object]:
        ids, hashes, starts, lengths, crcs, totals = [], [], [], [], [], []
        for doc_id, row_hash, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            data = tokenize(text, path, end, added)
            n = len(data) // 4
            for start in range(0, n, window):
                piece = data[4 * start : 4 * (start + window)]
                ids.append(doc_id)
                hashes.append(row_hash)
                starts.append(start)
                lengths.append(len(piece) // 4)
                crcs.append(zlib.crc32(piece))
                totals.append(n)
        columns = {"doc_id": ids, "row_hash": hashes, "start": starts, "length": lengths, "ids_crc32": crcs, "doc_tokens": totals}
        return {k: pa.array(v, pa.int64()) for k, v in columns.items()}

    rows = docs.select("doc_id", F.xxhash64("text").alias("row_hash"), "text")
    return map_arrow(rows, fn, "doc_id long, row_hash long, start long, length long, ids_crc32 long, doc_tokens long")


def fill(gap: int, counts: dict[int, int]) -> dict[int, int]:
    """The multiset of lengths (each at most as often as counted) whose sum is at most gap and closest to it."""
    reach, states = 1, []
    full = (1 << (gap + 1)) - 1
    for length in sorted((x for x in counts if x <= gap and counts[x] > 0), reverse=True):
        most = min(counts[length], gap // length)
        states.append((length, most, reach))
        left, step = most, 1
        while left:  # doubling: sums of up to `most` copies
            step = min(step, left)
            reach |= (reach << (length * step)) & full
            left -= step
            step *= 2
        if reach >> gap & 1:
            break
    total, chosen = reach.bit_length() - 1, {}
    for length, most, before in reversed(states):
        for k in range(most + 1):
            if total - k * length >= 0 and before >> (total - k * length) & 1:
                if k:
                    chosen[length] = k
                total -= k * length
                break
    return chosen


def plan(counts: dict[int, int], window: int = WINDOW) -> tuple[list[tuple[int, int, int, int, int]], list[tuple[int, int, int]], int, int]:
    """How pieces go to sequences: (length, first rank, first sequence, pieces a sequence, offset) of pieces kept whole,
    (length, first rank, position) of those laid end to end, the first sequence of these, and their total length."""
    left = {k: v for k, v in counts.items() if v}
    used = dict.fromkeys(left, 0)
    whole, laid, sequence = [], [], 0
    position = 0
    while left:
        longest = max(left)
        left[longest] -= 1
        chosen = fill(window - longest, left)
        left[longest] += 1
        if sum(k * v for k, v in chosen.items()) + longest == window:
            pattern = dict(chosen)
            pattern[longest] = pattern.get(longest, 0) + 1
            times = min(left[k] // v for k, v in pattern.items())
            offset = 0
            for length in sorted(pattern, reverse=True):
                whole.append((length, used[length], sequence, pattern[length], offset))
                offset += length * pattern[length]
                used[length] += times * pattern[length]
                left[length] -= times * pattern[length]
            sequence += times
        else:
            laid.append((longest, used[longest], position))
            position += longest * left[longest]
            left[longest] = 0
        left = {k: v for k, v in left.items() if v}
    return whole, laid, sequence, position


def _rank(pieces: DataFrame) -> DataFrame:
    """pieces with their rank among pieces of equal length, from counts of salted slots and ranks within these."""
    slots = 4 * partitions(pieces.sparkSession)
    salted = pieces.withColumn("slot", F.pmod(F.xxhash64("doc_id", "row_hash", "start"), F.lit(slots)))
    before = Window.partitionBy("length").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    counts = salted.groupBy("length", "slot").agg(F.count(F.lit(1)).alias("n")).select(
        "length", "slot", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base")
    )
    own = Window.partitionBy("length", "slot").orderBy("doc_id", "row_hash", "start")
    return salted.withColumn("own", F.row_number().over(own) - 1).join(counts, ["length", "slot"]).withColumn(
        "rank", F.col("base") + F.col("own")
    ).drop("slot", "own", "base")


def cut_ids(docs: DataFrame, pieces: DataFrame, path: str, end: int = END, keep_ids: bool = False, added: dict[str, int] | None = None) -> DataFrame:
    """pieces (doc_id, row_hash, start, length, doc_tokens, sequence_id, offset) with ids_crc32 from their documents' ids, and the ids."""
    fields = ["start", "length", "doc_tokens", "sequence_id", "offset"]
    listed = pieces.groupBy("doc_id", "row_hash").agg(F.collect_list(F.struct(*fields)).alias("pieces"))
    if pieces.limit(BROADCAST_PIECES + 1).count() <= BROADCAST_PIECES:  # texts stay where they are
        listed = F.broadcast(listed)
    texts = docs.select("doc_id", F.xxhash64("text").alias("row_hash"), "text")
    on = [F.col("p.doc_id").eqNullSafe(F.col("t.doc_id")), F.col("p.row_hash") == F.col("t.row_hash")]
    joined = texts.alias("t").join(listed.alias("p"), on).select("p.doc_id", "p.row_hash", "p.pieces", "t.text")
    joined = joined.groupBy("doc_id", "row_hash").agg(F.first("pieces").alias("pieces"), F.first("text").alias("text"))  # equal rows share their pieces

    def fn(batch: pa.RecordBatch) -> dict[str, object]:
        out = {k: [] for k in ("doc_id", "row_hash", *fields, "ids_crc32")}
        ids = []
        for doc_id, row_hash, places, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            data = tokenize(text, path, end, added)
            for place in places:
                piece = data[4 * place["start"] : 4 * (place["start"] + place["length"])]
                out["doc_id"].append(doc_id)
                out["row_hash"].append(row_hash)
                for f in fields:
                    out[f].append(place[f])
                out["ids_crc32"].append(zlib.crc32(piece))
                ids.append(np.frombuffer(piece, "<u4").astype(np.int32) if keep_ids else None)
        columns = {k: pa.array(v, pa.int64()) for k, v in out.items()}
        return columns | ({"ids": pa.array(ids, pa.list_(pa.int32()))} if keep_ids else {})

    schema = ", ".join(f"{k} long" for k in ("doc_id", "row_hash", *fields, "ids_crc32")) + (", ids array<int>" if keep_ids else "")
    return map_arrow(joined, fn, schema)


def pack(docs: DataFrame, path: str | None = None, window: int = WINDOW, end: int = END, added: dict[str, int] | None = None) -> DataFrame:
    """doc_id, row_hash, start, length, ids_crc32, doc_tokens, sequence_id, offset: one row for each piece of docs (doc_id, text).

    A null or empty text is the end id alone; equal rows are packed one by one; no rows give no pieces. `cut_ids` adds the ids.
    Tokens of `added` (see added_tokens) become their ids; without it they are plain text.
    """
    spark = docs.sparkSession
    path = path or default_vocabulary()
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    pieces = materialize(pieces_of(docs, path, window, end, added), "pieces")
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most `window` rows
    whole, laid, first_laid, total = plan(counts, window)
    table = sorted([(n, lo, 0, a, b, c) for n, lo, a, b, c in whole] + [(n, lo, 1, at, 0, 0) for n, lo, at in laid])
    bounds, at = [], total // window * window
    for power in range(window.bit_length() - 1, -1, -1):  # the last, partial window: powers of two
        if (total - total // window * window) >> power & 1:
            bounds.append(at)
            at += 1 << power
    keys = np.array([(n << 44) + lo for n, lo, *_ in table], np.int64)
    columns = np.array([row[1:] for row in table], np.int64).reshape(len(table), 5)
    last_window, tails = total // window * window, np.array([*bounds, total], np.int64)
    shared = spark.sparkContext.broadcast((keys, columns, tails))
    names = ("doc_id", "row_hash", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")

    def fn(batch: pa.RecordBatch) -> dict[str, object]:
        keys, columns, tails = shared.value
        doc_id, row_hash, start, length, crc, tokens, rank = (batch.column(i) for i in range(7))
        n, r = length.to_numpy(), rank.to_numpy()
        lo, kind, a, b, c = columns[np.searchsorted(keys, (n << 44) + r, side="right") - 1].T
        b = np.maximum(b, 1)
        kept = kind == 0
        sequence, offset = a + (r - lo) // b, c + (r - lo) % b * n
        out = {k: pa.array(v)  if not isinstance(v, pa.Array) else v for k, v in zip(names, (doc_id, row_hash, start, length, crc, tokens, sequence, offset), strict=True)}
        flat = {k: v.filter(pa.array(kept)) for k, v in out.items()}
        extra: dict[str, list] = {k: [] for k in names}
        for i in np.flatnonzero(~kept).tolist():
            begin = p = int(a[i] + (r[i] - lo[i]) * n[i])
            stop = p + int(n[i])
            while p < stop:
                if p < last_window:
                    window_start, window_end, number = p // window * window, (p // window + 1) * window, p // window
                else:
                    k = int(np.searchsorted(tails, p, side="right")) - 1
                    window_start, window_end, number = int(tails[k]), int(tails[k + 1]), last_window // window + k
                q = min(stop, window_end)
                uncut = q - p == stop - begin
                values = (
                    doc_id[i].as_py(),
                    row_hash[i].as_py(),
                    start[i].as_py() + p - begin,
                    q - p,
                    crc[i].as_py() if uncut else None,
                    tokens[i].as_py(),
                    first_laid + number,
                    p - window_start,
                )
                for k, v in zip(names, values, strict=True):
                    extra[k].append(v)
                p = q
        return {k: pa.concat_arrays([flat[k].cast(pa.int64()), pa.array(extra[k], pa.int64())]) for k in names}

    ranked = _rank(pieces).select("doc_id", "row_hash", "start", "length", "ids_crc32", "doc_tokens", "rank")
    placed = materialize(map_arrow(ranked, fn, ", ".join(f"{k} long" for k in names)), "placed")
    cut = cut_ids(docs, placed.where("ids_crc32 is null"), path, end, added=added)
    return placed.where("ids_crc32 is not null").unionByName(cut)


def op4_packing(spark, sf_dir: str) -> DataFrame:
    """All documents into windows of 2048 ids."""
    packed = pack(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), added=added_tokens())
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
