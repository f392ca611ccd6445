"""Spelling variants: words of the corpus that differ by one edit, found through a reduced alphabet.

Letters are hashed to SYMBOLS symbols, so many words share a reduced form and the one-edit neighbourhood of a reduced word is small enough
to be generated in full: itself and every deletion, replacement and insertion over the symbols. The keys of a neighbourhood (64-bit
polynomial hashes, made for all positions at once) meet the reduced vocabulary in a join, and the edit distance of the original words
decides. Two words one edit apart have reduced forms at most one edit apart, so no pair is lost. A bitmap of fixed size that holds the
reduced vocabulary drops nearly all other keys before the shuffle. Words of a reduced form that more than CROWD words share are matched
by the same steps over the full alphabet instead, where each form is one word.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_map, key_map, map_arrow, materialize, mix64, small_batches
from .importance import CRC_TABLE, crc_sql

SYMBOLS = 6
#: A reduced form of more words is not matched as one group.
CROWD = 64
LEAST_LETTERS, LEAST_COUNT, RATIO, TYPO = 6, 5, 5, 199
#: Distinct words that a task holds before it passes their counts on, and keys that it makes at once.
HELD, KEYS = 400_000, 1 << 21
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: a-z and U+00C0 to U+00FF in UTF-8.
_RUN = re.compile(rb"(?:[a-z]+|\xc3[\x80-\xbf])+")
#: Code points below 256 that can stand in a word; their places are the symbols of the full alphabet.
_LETTERS = [*range(97, 123), *range(0xC0, 0x100)]
_BASE = np.uint64(0x9E3779B97F4A7C15)


def word_counts(docs: DataFrame, least_letters: int = LEAST_LETTERS, typo: int | None = None) -> DataFrame:
    """word, n of all runs of letters with at least least_letters code points in docs (doc_id, text), A-Z folded.

    With typo, a run whose crc32 behind its document's id is a multiple of it loses one code point, in all its places in the document.
    A null text has no words; a null id counts as an empty one.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        held: dict[bytes, int] = {}

        def flush() -> pa.RecordBatch:
            words = pa.array([w.decode() for w in held], pa.string())
            out = pa.RecordBatch.from_pydict({"word": words, "n": pa.array(list(held.values()), pa.int64())})
            held.clear()
            return out

        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if not text:
                    continue
                own: dict[bytes, int] = {}
                for run in _RUN.findall(text.encode("utf-8", "replace").translate(_FOLD)):
                    if len(run) >= least_letters:
                        own[run] = own.get(run, 0) + 1
                start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
                for run, n in own.items():
                    if typo and not (h := zlib.crc32(run, start)) % typo:
                        letters = run.decode()
                        at = h % len(letters)
                        run = (letters[:at] + letters[at + 1 :]).encode()
                    if len(run) - run.count(b"\xc3") >= least_letters:
                        held[run] = held.get(run, 0) + n
                if len(held) >= HELD:
                    yield flush()
        if held:
            yield flush()

    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def symbols_of(full: bool) -> np.ndarray:
    """Symbol (from 1) of each code point below 256, of the reduced or of the full alphabet."""
    table = np.zeros(256, np.uint64)
    table[_LETTERS] = np.arange(1, len(_LETTERS) + 1) if full else 1 + mix64(np.array(_LETTERS, np.uint64)) % np.uint64(SYMBOLS)
    return table


def _powers(n: int) -> np.ndarray:
    out = np.ones(n + 1, np.uint64)
    out[1:] = _BASE
    return np.multiply.accumulate(out)


def form_keys(words: list[str], full: bool) -> np.ndarray:
    """Key of each word's form."""
    table, out = symbols_of(full), np.zeros(len(words), np.uint64)
    for rows, marks in _by_length(words, table):
        out[rows] = mix64((marks * _powers(marks.shape[1])[:-1]).sum(axis=1, dtype=np.uint64))
    return out


def _by_length(words: list[str], table: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows and symbols (words x letters) of the words of each length, a bounded number of letters at once."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    for size in np.unique(sizes).tolist():
        rows = np.flatnonzero(sizes == size)
        step = max(1, KEYS // max(1, 2 * size * int(table.max() + 1)))
        for at in range(0, len(rows), step):
            some = rows[at : at + step]
            codes = np.frombuffer("".join(words[i] for i in some).encode("latin-1"), np.uint8).reshape(len(some), size)
            yield some, table[codes]


def neighbour_keys(words: list[str], full: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Word numbers and keys of all forms that are at most one deletion, replacement or insertion from each word's own form."""
    table = symbols_of(full)
    alphabet = np.arange(1, int(table.max()) + 1, dtype=np.uint64)
    for rows, marks in _by_length(words, table):
        m, size = marks.shape
        power = _powers(size + 1)
        before = np.zeros((m, size + 1), np.uint64)  # hash of the letters before each place
        np.cumsum(marks * power[:size], axis=1, dtype=np.uint64, out=before[:, 1:])
        after = np.zeros((m, size + 2), np.uint64)  # hash of the letters from each place on, as if they began the word
        for at in range(size - 1, -1, -1):
            after[:, at] = marks[:, at] + _BASE * after[:, at + 1]
        yield rows, mix64(before[:, size])
        block = max(1, KEYS // (m * len(alphabet)))
        for lo in range(0, size + 1, block):
            at = np.arange(lo, min(size + 1, lo + block))
            head, here = before[:, at], power[at]
            letter = head[:, :, None] + here[None, :, None] * alphabet[None, None, :]
            inserted = letter + (power[at + 1] * after[:, at])[:, :, None]
            replaced = (letter + (power[at + 1] * after[:, at + 1])[:, :, None])[:, at < size]
            deleted = (head + here * after[:, at + 1])[:, at < size]
            for keys in (inserted, replaced, deleted):
                each = keys.reshape(m, -1)
                yield np.repeat(rows, each.shape[1]), mix64(each.ravel())


def with_keys(words: DataFrame, full: bool) -> DataFrame:
    """words (word, n) with the key of each word's form."""

    def fn(batch: pa.RecordBatch) -> dict[str, object]:
        keys = form_keys(batch.column(0).to_pylist(), full).view(np.int64)
        return {"word": batch.column(0), "n": batch.column(1), "key": pa.array(keys)}

    return map_arrow(words.select("word", "n"), fn, "word string, n long, key long")


def probes(words: DataFrame, bitmap: np.ndarray, full: bool) -> DataFrame:
    """word, key: the keys of each word's neighbourhood that the map has."""
    shared = words.sparkSession.sparkContext.broadcast(bitmap)

    def fn(batch: pa.RecordBatch) -> dict[str, object]:
        listed, rows, keys = batch.column(0).to_pylist(), [], []
        for at, key in neighbour_keys(listed, full):
            have = in_map(shared.value, key)
            rows.append(at[have])
            keys.append(key[have])
        found = np.unique(np.stack([np.concatenate(rows).astype(np.uint64), np.concatenate(keys)]), axis=1)
        return {"word": batch.column(0).take(pa.array(found[0].astype(np.int64))), "key": pa.array(found[1].view(np.int64))}

    return map_arrow(words.select("word"), fn, "word string, key long")


def near_words(words: DataFrame) -> DataFrame:
    """word, near, near_n for each ordered pair of words (word, n; distinct words) that are one edit apart."""
    keyed = materialize(with_keys(words, False), "reduced")
    crowded = keyed.groupBy("key").count().where(F.col("count") > CROWD).select("key")
    found = materialize(probes(keyed, key_map(keyed), False), "neighbourhoods")
    near = lambda asked, have: asked.join(have.select("key", F.col("word").alias("near"), F.col("n").alias("near_n")), "key").where(
        F.levenshtein("word", "near", 1) == 1
    ).select("word", "near", "near_n")
    if not crowded.limit(1).count():
        return near(found, keyed).distinct()
    crowded = materialize(crowded, "crowded")
    asked = found.join(crowded, "key", "left_semi").select("word").distinct()
    have = materialize(with_keys(keyed.join(crowded, "key", "left_semi"), True), "unreduced")
    plain = near(found.join(crowded, "key", "left_anti"), keyed)
    return plain.unionByName(near(probes(asked, key_map(have), True), have)).distinct()


def group_variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """word, form, root, n, n_near, form_n for each of words (word, n; distinct words).

    A word's form is the commonest of the words one edit away (ties: the first in code-point order) if that is at least ratio times as
    common, else null. Counts grow along forms, so following them ends; the last is the root, which is the word itself without a form.
    An empty table gives an empty one.
    """
    best = near_words(words).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("m"), "near")).alias("best"))
    chosen = words.select("word", "n").join(best, "word", "left")
    is_form = -F.col("best.m") >= ratio * F.col("n")
    table = chosen.select(
        "word", F.when(is_form, F.col("best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
        F.when(is_form, -F.col("best.m")).alias("form_n"),
    )
    table = materialize(table, "forms")
    links = table.where("form is not null").select("word", F.col("form").alias("root"))
    while True:  # each round doubles the steps followed; counts grow by ratio a step, so there are few
        onward = links.select(F.col("word").alias("root"), F.col("root").alias("onward"))
        joined = materialize(links.join(onward, "root", "left"), "roots")
        links = joined.select("word", F.coalesce("onward", "root").alias("root"))
        if not joined.where("onward is not null").limit(1).count():
            break
    out = table.join(links, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_spelling_variants(spark, sf_dir: str) -> DataFrame:
    """Words of at least 6 letters and 5 occurrences in all documents, with the form and the root of each."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    words = materialize(word_counts(docs, typo=TYPO).where(F.col("n") >= LEAST_COUNT), "vocabulary")
    return group_variants(words)


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
OP12_SQL = f"""
WITH RECURSIVE {CRC_TABLE},
r AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[a-zÀ-ÿ]+')) AS run FROM documents),
x AS (SELECT doc_id, run, count(*) AS k FROM r WHERE length(run) >= 6 GROUP BY doc_id, run),
h AS (SELECT run, k, {crc_sql("(doc_id || ':' || run)")} AS h FROM x, tab),
w AS (SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, k FROM h),
v AS (SELECT word, CAST(sum(k) AS BIGINT) AS n FROM w WHERE length(word) >= 6 GROUP BY word HAVING sum(k) >= 5),
d AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM v, unnest(range(1, length(word) + 1)) AS t(i)),
p AS (SELECT a.word, b.word AS near, b.n AS near_n FROM d AS a JOIN d AS b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
      UNION SELECT d.word, v.word, v.n FROM d JOIN v ON d.rest = v.word
      UNION SELECT v.word, d.word, d.n FROM d JOIN v ON d.rest = v.word),
o AS (SELECT word, near, near_n, count(*) OVER (PARTITION BY word) AS n_near, row_number() OVER (PARTITION BY word ORDER BY near_n DESC, near) AS k FROM p),
f AS (SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 5 * v.n THEN near END AS form, CASE WHEN near_n >= 5 * v.n THEN near_n END AS form_n
      FROM v LEFT JOIN o ON v.word = o.word AND k = 1),
c AS (SELECT word, word AS root, form AS onward FROM f UNION ALL SELECT c.word, f.word, f.form FROM c JOIN f ON c.onward = f.word)
SELECT word, form, root, n, CAST(n_near AS BIGINT) AS n_near, form_n FROM f JOIN (SELECT word, root FROM c WHERE onward IS NULL) AS e USING (word)
"""
