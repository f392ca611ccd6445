"""Substring dedup by hashing units of text.

Lines are split into units after sentence ends and before a capital that follows an uncapitalised word. Parts of fewer than MIN_WORDS
words are joined: their unit ends where it has MIN_WORDS words and the last part's hash selects it, or where a longer part ends it (what is
left of a line is a unit of its own if it has MIN_WORDS words, and else belongs to the unit before it). A unit of more than LONG_WORDS
words is split after words that their hash selects. A line of fewer than MIN_WORDS words is a unit of its own, so every line of any length
lies in units as a whole. Characters of scripts without spaces between words count as words.
All of these bounds depend on nearby text alone, so a passage has the same inner units wherever it stands, be it a line of its own or
inside one. Units are normalised (case, white space) and hashed to 128 bits; digests are grouped over the corpus; the occurrence that
comes first by (doc_id, hash of the text, offset) stays, all later ones are repeats. Offsets refer to the original text. Every repeat is
reported; runs of repeats that stand side by side are removed if they have least_run words or more (1 removes every repeat).
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import HOT, key_map, map_arrow, materialize, may_be_in

MIN_WORDS, LONG_WORDS = 5, 40
#: Repeated units side by side are removed from running text if they have so many words together.
LEAST_RUN = 10
#: Repeats that are broadcast (about 40 bytes each); with more of them, the texts that have some are shuffled to them.
BROADCAST_SPANS = 100_000
#: Texts whose units are held at once, as Python numbers, before they become Arrow columns.
UNIT_ROWS = 200
_LINE = re.compile(r"[^\n]+")
#: Bounds inside a line: white space after a sentence end, a sentence end of scripts without spaces, or (if a lower-case letter stands before it) before a capitalised word.
_BOUND = re.compile(r"[.!?…。！？]\s+|[。！？]|\s+(?=[A-ZÀ-ÖØ-Þ][^\WA-ZÀ-ÖØ-Þ])")
#: Thai, Lao, Tibetan, Myanmar, Khmer, kana and Chinese characters.
_UNSPACED = "\u0e00-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
_ANY_UNSPACED = re.compile(f"[{_UNSPACED}]")
_WORD = re.compile(rf"[{_UNSPACED}]|[^\s{_UNSPACED}]+")


def is_spaced(text: str) -> bool:
    return text.isascii() or not _ANY_UNSPACED.search(text)


def count_words(text: str, a: int, b: int, spaced: bool) -> int:
    return len(text[a:b].split()) if spaced else sum(1 for _ in _WORD.finditer(text, a, b))


def units(text: str, min_words: int = MIN_WORDS, long_words: int = LONG_WORDS) -> list[tuple[int, int]]:
    """Start and end of each unit, in code points."""
    import xxhash

    out: list[tuple[int, int]] = []
    spaced = is_spaced(text)

    def words_of(a: int, b: int) -> int:
        return count_words(text, a, b, spaced)

    def add(a: int, b: int, n_words: int) -> None:
        if n_words <= long_words:
            out.append((a, b))
            return
        start, k, cuts = a, 0, 0
        for m in _WORD.finditer(text, a, b):
            start = m.start() if start is None else start
            k += 1
            if k >= min_words and b - m.end() > 1 and xxhash.xxh3_64_intdigest(m.group()) % 8 == 0:
                out.append((start, m.end()))
                start, k, cuts = None, 0, cuts + 1
        if cuts and k < min_words:
            out[-1] = (out[-1][0], b)
        else:
            out.append((start, b))

    def selected(a: int, b: int) -> bool:
        last = text[a:b].rsplit(None, 1)[-1:]
        return bool(last) and xxhash.xxh3_64_intdigest(last[0].lower()) % 4 == 0

    for line in _LINE.finditer(text):
        a, end = line.span()
        parts, at = [], a
        for bound in _BOUND.finditer(text, a, end):
            cut = bound.start()
            if not text[cut].isspace():
                cut += 1
            elif cut == a or not text[cut - 1].islower():
                continue
            parts.append((at, cut))
            at = bound.end()
        parts.append((at, end))
        begin, n, before, first = None, 0, a, len(out)
        for start, stop in parts:
            n_words = words_of(start, stop)
            if n >= min_words <= n_words:  # joined parts before a long one are a unit of their own
                add(begin, before, n)
                begin, n = None, 0
            begin, n, before = start if begin is None else begin, n + n_words, stop
            if n_words >= min_words or (n >= min_words and selected(start, stop)):
                add(begin, stop, n)
                begin, n = None, 0
        if begin is not None and n >= min_words:
            add(begin, end, n)
        elif begin is not None and len(out) > first:  # a short rest of the line ends its last unit
            out[-1] = (out[-1][0], end)
        elif begin is not None and text[a:end].strip():  # a short line
            out.append((a, end))
    return out


def unit_table(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, text_hash, start, end, place, words, d1, d2 (the digest's halves) of every unit of docs (doc_id, text).

    place counts a document's units; it skips a number where more than white space stands between two of them.
    """

    def fn(batch: pa.RecordBatch) -> dict[str, object]:
        from xxhash import xxh3_128_digest

        at, starts, ends, places, sizes, digests = [], [], [], [], [], []
        for row, text in enumerate(batch.column(2).to_pylist()):
            place, last, spaced = 0, 0, is_spaced(text or "")
            for a, b in units(text or "", min_words):
                normal = " ".join(text[a:b].lower().split())
                if normal:
                    place += 1 if not text[last:a].strip() else 2
                    last = b
                    at.append(row)
                    starts.append(a)
                    ends.append(b)
                    places.append(place)
                    sizes.append(count_words(normal, 0, len(normal), spaced))
                    digests.append(xxh3_128_digest(normal))
        halves = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
        rows = pa.array(at, pa.int32())
        return {
            "doc_id": batch.column(0).take(rows), "text_hash": batch.column(1).take(rows), "start": pa.array(starts, pa.int32()), "end": pa.array(ends, pa.int32()),
            "place": pa.array(places, pa.int32()), "words": pa.array(sizes, pa.int32()), "d1": pa.array(halves[:, 0]), "d2": pa.array(halves[:, 1]),
        }

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    schema = "doc_id long, text_hash long, start int, end int, place int, words int, d1 long, d2 long"
    return map_arrow(rows, fn, schema, rows=UNIT_ROWS, stateless=True)


def later_units(table: DataFrame) -> DataFrame:
    """Units of the table whose digest an earlier one has.

    Most units stand alone. They leave first: half digests are counted, a map of fixed size of those that occur again says which units may
    be repeats, and only these are shuffled with what belongs to them. Digests that more than one in HOT units have are broadcast (at most
    HOT of them), and their units stay where they are.
    """
    spark, keys, rank = table.sparkSession, ["d1", "d2"], F.struct("doc_id", "text_hash", "start")
    again = key_map(table.groupBy(F.col("d1").alias("key")).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key"))
    maybe = table.where(may_be_in(spark, again, F.col("d1")))
    repeated = maybe.groupBy(*keys).agg(F.min(rank).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    hot = F.col("n") > table.count() / HOT
    heavy, light = (repeated.where(x).select(*keys, "first") for x in (hot, ~hot))
    few = maybe.join(F.broadcast(heavy.select(*keys)), keys, "left_anti").join(light, keys)
    return table.join(F.broadcast(heavy), keys).unionByName(few).where(rank > F.col("first")).select(*table.columns)


def repeats(docs: DataFrame, min_words: int = MIN_WORDS, least_run: int = LEAST_RUN) -> DataFrame:
    """doc_id, text_hash, repeated, removed (arrays of start, end; sorted) of each text with units that repeat earlier ones.

    removed are those in runs of least_run words or more; it may be empty.
    """
    table = materialize(unit_table(docs.where("doc_id is not null"), min_words), "units")
    later = later_units(table)
    found = later.groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_set(F.struct("start", "end", "place", "words"))).alias("repeated"))

    def fn(batch: pa.RecordBatch) -> dict[str, object]:
        listed = [[(x["start"], x["end"], x["place"], x["words"]) for x in spans] for spans in batch.column(2).to_pylist()]
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        pairs = lambda spans: [{"start": s[0], "end": s[1]} for s in spans]
        return {
            "doc_id": batch.column(0), "text_hash": batch.column(1), "repeated": pa.array([pairs(x) for x in listed], kind),
            "removed": pa.array([pairs(long_runs(x, least_run)) for x in listed], kind),
        }

    spans = "array<struct<start:int,end:int>>"
    return map_arrow(found, fn, f"doc_id long, text_hash long, repeated {spans}, removed {spans}", stateless=True)


def long_runs(spans: list[tuple[int, int, int, int]], least_run: int) -> list[tuple[int, int, int, int]]:
    """The spans (start, end, place, words; sorted) of runs of neighbouring places that have least_run words or more together."""
    out: list[tuple[int, int, int, int]] = []
    run: list[tuple[int, int, int, int]] = []
    for span in spans:
        if run and span[2] != run[-1][2] + 1:
            out += run if sum(s[3] for s in run) >= least_run else []
            run = []
        run.append(span)
    return out + run if sum(s[3] for s in run) >= least_run else out


def remove_spans(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the spans; white space left double by a removal goes with it."""
    kept, at = [], 0
    for a, b in spans:
        kept.append(text[at:a])
        while b < len(text) and text[b] == " ":
            b += 1
        if b < len(text) and text[b] == "\n" and (a == 0 or text[a - 1] == "\n" or not "".join(kept)):
            b += 1
        at = max(at, b)
    return "".join([*kept, text[at:]])


def _meet(rows: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """rows (doc_id, text_hash, ...) that may have repeats, with the columns of found or nulls, and the other rows, if they were told apart.

    Up to BROADCAST_SPANS repeats are broadcast. With more, a map of fixed size says which rows may have some, and only those are shuffled;
    the join is no broadcast, so the map and what cuts the texts are steps of Python in different stages.
    """
    spark, keys = rows.sparkSession, ["doc_id", "text_hash"]
    if (found.agg(F.sum(F.size("repeated"))).first()[0] or 0) <= BROADCAST_SPANS:
        return rows.join(F.broadcast(found), keys, "left"), None
    key = F.xxhash64(*keys)
    marked = rows.withColumn("maybe", may_be_in(spark, key_map(found.select(key.alias("key"))), key))
    return marked.where("maybe").drop("maybe").join(found.hint("merge"), keys, "left"), marked.where("not maybe").drop("maybe")


def dedup_substrings(docs: DataFrame, min_words: int = MIN_WORDS, least_run: int = LEAST_RUN, report: bool = True) -> DataFrame:
    """docs with n_units_removed and removed_spans, and text without the removed repeats; n_chars, if present, is renewed.

    With report, repeated_spans has all repeats, removed or not, and text_without_repeats is the text without any of them.
    A null text and texts without repeats stay as they are; a text of repeats alone becomes empty. Texts are told apart by (doc_id, hash
    of the text): rows equal in both are one document and keep the same units, rows of one id with different texts are different
    documents, the one with the smaller hash first. Rows without doc_id are kept as they are and don't count as occurrences.
    """
    made = ("n_units_removed", "removed_spans", "repeated_spans", "text_without_repeats")
    names = [c for c in docs.columns if c not in made]
    rest = [c for c in names if c not in ("doc_id", "text")]
    packed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", (F.struct(*rest) if rest else F.struct(F.lit(0))).alias("rest"))
    found = materialize(repeats(packed.select("doc_id", "text"), min_words, least_run), "repeats")
    met, others = _meet(packed.withColumn("text_hash", F.xxhash64("text")), found if report else found.where(F.size("removed") > 0))

    @F.arrow_udf("string")
    def without(texts: pa.Array, spans: pa.Array) -> pa.Array:
        pairs = zip(texts.to_pylist(), spans.to_pylist(), strict=True)
        return pa.array([text if s is None else remove_spans(text, [(x["start"], x["end"]) for x in s]) for text, s in pairs], pa.string())

    # a text goes to Python only where something is cut, and once: Spark repeats a deterministic function in a filter over its result, in a worker of its own
    without = without.asNondeterministic()
    cut, again = F.coalesce(F.size("removed") > 0, F.lit(False)), F.coalesce(F.size("repeated") > 0, F.lit(False))
    made_of = {"short": without(F.when(cut, F.col("text")), F.when(cut, F.col("removed")))}
    if report:
        made_of["bare"] = without(F.when(again, F.col("text")), F.when(again, F.col("repeated")))
    met = met.withColumns(made_of)
    joined = met if others is None else met.unionByName(others, allowMissingColumns=True)
    columns = {"doc_id": F.col("doc_id"), "text": F.when(cut, F.col("short")).otherwise(F.col("text"))} | {c: F.col(f"rest.`{c}`") for c in rest}
    if "n_chars" in columns:
        columns["n_chars"] = F.when(cut, F.length("short").cast("long")).otherwise(F.col("rest.n_chars"))
    none = F.array().cast("array<struct<start:int,end:int>>")
    out = [columns[c].alias(c) for c in names] + [F.when(cut, F.size("removed")).otherwise(0).alias("n_units_removed"), F.coalesce("removed", none).alias("removed_spans")]
    if report:
        out += [F.coalesce("repeated", none).alias("repeated_spans"), F.when(again, F.col("bare")).otherwise(F.col("text")).alias("text_without_repeats")]
    return joined.select(*out)


def op6_substring_dedup(spark, sf_dir: str) -> DataFrame:
    """All documents: the text without repeated passages, the text without any repeat, and where all of these stand."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_substrings(docs).select("doc_id", "text", "n_units_removed", "removed_spans", "repeated_spans", "text_without_repeats")
