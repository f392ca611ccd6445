"""Operators without SQL form against plain Python versions that share no code with them, and odd inputs of every operator."""

import hashlib
import math
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from roadlens.llm import decontaminate as D
from roadlens.llm import fingerprint as P
from roadlens.llm import language_id as L
from roadlens.llm import lm_score as LM
from roadlens.llm import near_dedup as N
from roadlens.llm import packing as K
from roadlens.llm import quality as Q
from roadlens.llm import queries
from roadlens.llm import substring_dedup as S
from roadlens.llm import url_filter as U
from roadlens.llm import warc as W

DOCS = "doc_id long, text string"


def fold(i, parts, held):
    import zlib

    return zlib.crc32(str(i).encode()) % parts == held


# Language ID: multinomial naive Bayes with dictionaries ---------------------------------------------------------------------------


def buckets_of(text, buckets):
    """Hashed character n-grams, one at a time."""
    codes = [ord(c) for c in text.lower()]
    for order in (1, 2, 3):
        for at in range(len(codes) - order + 1):
            h = order * 0x9E37
            for c, m in zip(codes[at : at + order], (2654435761, 2246822519, 3266489917), strict=False):
                h = (h ^ c) * m & 0xFFFFFFFF
                h ^= h >> 15
            yield h % buckets


def test_language_id_equals_plain_naive_bayes(spark, folder):
    rows = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text", "lang").collect()
    short = [r for r in rows if r.text and len(r.text) < 4000]
    docs, counts, totals = Counter(), defaultdict(Counter), Counter()
    for r in rows:
        if not fold(r.doc_id, 3, 1) and r.text is not None and r.lang is not None:
            docs[r.lang] += 1
            counts[r.lang].update(buckets_of(r.text, L.BUCKETS))
    for lang in docs:
        totals[lang] = sum(counts[lang].values()) + 0.5 * L.BUCKETS
    got = {r.doc_id: r for r in queries.QUERIES["op2_language_id"](spark, folder).collect()}
    assert len(got) == len(rows) and len(short) > 100
    for r in short[:80]:
        scores = {}
        for lang in docs:
            grams = Counter(buckets_of(r.text, L.BUCKETS))
            prior = math.log((docs[lang] + 1) / (sum(docs.values()) + len(docs)))
            scores[lang] = prior + sum(n * math.log((counts[lang][b] + 0.5) / totals[lang]) for b, n in grams.items())
        best = max(scores, key=scores.get)
        posterior = 1 / sum(math.exp(s - scores[best]) for s in scores.values())
        assert got[r.doc_id].lang_pred == best and got[r.doc_id].score == pytest.approx(posterior, abs=2e-3)


def test_language_id_ties_empty_tables_and_extra_columns(spark):
    model = L.train(spark.createDataFrame([("ab ab", "x"), ("ab ab", "y")], "text string, lang string"))
    tie = L.identify(spark.createDataFrame([(1, "ab")], DOCS), model).first()
    assert tie.lang_pred == "x" and tie.score == pytest.approx(0.5)  # of equal languages the first by name
    assert L.identify(spark.createDataFrame([], DOCS), model).count() == 0
    frame = spark.createDataFrame([(1, "ab ab", 5, "s"), (2, None, 6, "t")], DOCS + ", score int, lang_pred string")
    kept = L.keep_identified(frame, model)
    assert [tuple(r) for r in kept.collect()] == [(1, "ab ab", 5, "s")] and kept.columns == frame.columns


# Quality: statistics and rules evaluated in Python ----------------------------------------------------------------------------------


def plain_statistics(text):
    import re

    data = (text or "").encode()
    words = data.split()
    if not words:
        return dict.fromkeys(Q.STATISTICS, 0.0)
    n, k = len(data), len(words)
    share = lambda test: sum(map(test, data)) / n
    char = lambda b: chr(b) if b < 128 else "é"
    lower, upper = (lambda b: b < 128 and char(b).islower()), (lambda b: b < 128 and char(b).isupper())
    stops, symbols = ".,;:?'\"-()", "*#&%$|!@=~^_<>{}[]\\/+`"
    digit, space, wide = (lambda b: b < 128 and char(b).isdigit()), (lambda b: b < 128 and char(b).isspace()), (lambda b: b >= 128)
    known = lambda b: lower(b) or upper(b) or digit(b) or space(b) or wide(b) or char(b) in stops or char(b) in symbols
    lines = [x for x in data.split(b"\n") if x.strip()]
    pairs = {tuple(words[i : i + 2]) for i in range(k - 1)}
    return {
        "log_chars": math.log1p(n), "log_words": math.log1p(k), "mean_word": sum(map(len, words)) / k, "longest_word": max(map(len, words)), "letters": share(
            lambda b: lower(b) or upper(b) or wide(b)
        ),
        "upper": share(upper), "digits": share(digit), "spaces": share(space), "stops": share(lambda b: char(b) in stops),
        "symbols": share(lambda b: char(b) in symbols), "other_ascii": share(lambda b: not known(b)),
        "non_ascii": share(wide), "lines": math.log1p(len(lines)), "words_a_line": k / len(lines), "distinct_words": len(set(words)) / k,
        "top_word": Counter(words).most_common(1)[0][1] / k,
        "odd_ends": len(
            re.findall(rb"[*#&%$|!@=~^]+(?:\s|$)", data)
        ) / k, "repeated_lines": 1 - len(set(lines)) / len(lines), "short_words": sum(len(w) <= 3 for w in words) / k, "repeated_pairs": 1 - len(pairs) / max(1,
        k - 1),
    }


def test_quality_equals_rules_in_python(spark, folder, monkeypatch):
    held = {}
    fit = Q.fit_rules
    monkeypatch.setattr(Q, "fit_rules", lambda *a, **k: held.setdefault("model", fit(*a, **k)))
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()}
    rows = queries.QUERIES["op7_quality"](spark, folder).collect()
    model = held["model"]
    assert len(rows) == len(texts) and model.rules
    for r in rows:
        s = plain_statistics(texts[r.doc_id])
        total = model.intercept
        for rule, weight in zip(model.rules, model.weights, strict=True):
            total += weight * all(s[name] <= value if at_most else s[name] > value for name, at_most, value in rule)
        assert r.score == pytest.approx(1 / (1 + math.exp(-total)), abs=1e-6)
        assert r.predicted == (r.score >= 0.7) and r.held_out == fold(r.doc_id, 4, 2)


def test_quality_odd_tables(spark, tmp_path):
    schema = "doc_id int, text string, lang string, score double"
    for name, docs, labels in (
        ("empty", [], []),
        ("few", [(1, "a b", "x", 0.1), (1, "a b", "x", 0.1), (2, "word " * 200_000, None, None), (3, None, "y", 1.0)], [(1, 1), (1, 0), (3, None), (9, 1)]),
    ):
        spark.createDataFrame(docs, schema).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.createDataFrame(labels, "doc_id int, quality int").write.parquet(f"{tmp_path}/{name}/labels.parquet")
        got = queries.QUERIES["op7_quality"](spark, f"{tmp_path}/{name}").collect()
        assert len(got) == len(docs) and all(0 <= r.score <= 1 for r in got)
        assert len({r.score for r in got if r.doc_id == 1}) <= 1


# Fingerprints: one byte at a time ---------------------------------------------------------------------------------------------------


def plain_chunks(data):
    """Ends by the rule: no cut before 16 bytes, a strict mask up to 64, a loose one after it, 256 at most; hash over the last 32 bytes."""
    ends, start, h = [], 0, 0
    for at, byte in enumerate(data):
        h = ((h << 1) + int(P._GEAR[byte])) & 0xFFFFFFFF
        size = at + 1 - start
        mask = int(P.STRICT) if size <= 64 else int(P.LOOSE)
        if (size >= 16 and h & mask == 0) or size == 256 or at + 1 == len(data):
            ends.append(at + 1)
            start = at + 1
    return ends


def test_chunks_equal_a_byte_at_a_time(spark, folder):
    texts = [r.text or "" for r in spark.read.parquet(f"{folder}/documents.parquet").select("text").limit(60).collect()]
    rng = np.random.default_rng(3)
    samples = [t.encode() for t in texts] + [
        bytes(rng.integers(0, 256, n, dtype=np.uint8)) for n in (0, 1, 15, 16, 17, 63, 64, 65, 255, 256, 257, 5000)
    ] + [b"\0" * 1000]
    for data in samples:
        assert P.chunk_ends(data) == plain_chunks(data)


def test_fingerprints_of_clashing_columns_and_long_texts(spark):
    rows = [(1, "abc " * 50_000, 7, "t"), (2, "abc " * 50_000, 8, "u"), (3, "", 9, "v")]
    got = {r.doc_id: r for r in P.fingerprints(spark.createDataFrame(rows, "doc_id int, text string, bucket int, tail string")).collect()}
    assert got[1].fingerprint == got[2].fingerprint and got[3].fingerprint == "" and got[2].near_next == 1.0
    text = rows[1][1]
    assert got[2].edited_sha256 == hashlib.sha256((text[: len(text) // 2] + rows[0][1][: len(text) // 2]).encode()).hexdigest()


def test_ranges_follow_large_ids(spark):
    """Ids beyond 2^53 beside null ones keep their order."""
    base = (1 << 60) + 1
    rows = [(base + i, f"text {i} " * 5) for i in range(40)] + [(None, "none")]
    got = {r.doc_id: r for r in P.fingerprints(spark.createDataFrame(rows, DOCS)).collect()}
    for i in range(1, 40):
        text, after = rows[i][1], rows[i - 1][1]
        assert got[base + i].edited_sha256 == hashlib.sha256((text[: len(text) - len(text) // 2] + after[: len(text) // 2]).encode()).hexdigest()


# Odd inputs of the others -----------------------------------------------------------------------------------------------------------


def test_url_filter_of_an_empty_table(spark):
    rules = spark.createDataFrame(U.RULES, "verdict string, host string, path string")
    assert U.judge(spark.createDataFrame([], "page_id long, url string"), rules).count() == 0
    tie = spark.createDataFrame([("block", "a.b", "/x"), ("allow", "a.b", "/x")], "verdict string, host string, path string")
    assert U.judge(spark.createDataFrame([(1, "http://a.b/x")], "page_id long, url string"), tie).first().verdict == "block"


def test_url_filter_of_hosts_with_many_labels(spark, monkeypatch):
    """A host of 60,000 labels costs no more than its length; suffixes that most hosts share; repeated rows."""
    import time

    rules = spark.createDataFrame([*U.RULES, ("block", "", "/p"), ("allow", "b.c.d.net", "/")], "verdict string, host string, path string")
    deep = "http://" + "a." * 60_000 + "b.c.d.net/x"
    rows = [(1, deep), (2, "http://" + "a." * 60_000 + "com/de/"), (3, "http:///p"), (3, "http:///p"), (4, "http://net./p/q")]
    rows += [(100 + i, f"http://h{i}.net/") for i in range(3000)]
    pages = spark.createDataFrame(rows, "page_id long, url string").repartition(4).cache()
    want = Counter({(1, "b.c.d.net/", "allow"): 1, (2, None, "allow"): 1, (3, "/p", "block"): 2, (4, "/p", "block"): 1})
    want.update((100 + i, "net/", "block") for i in range(3000))
    pages.count()
    for limit in (U.BROADCAST_RULES, 1):
        monkeypatch.setattr(U, "BROADCAST_RULES", limit)
        began = time.time()
        assert Counter((r.page_id, r.rule, r.verdict) for r in U.judge(pages, rules).select("page_id", "rule", "verdict").collect()) == want
        assert time.time() - began < 30
    pages.unpersist()


def test_very_long_texts(spark, tmp_path):
    long = " ".join(f"w{i % 5000}x{i % 77}" for i in range(150_000))
    rows = [(1, long), (2, long + " end"), (3, "y" * 400_000)]
    docs = spark.createDataFrame(rows, DOCS)
    assert {(r.doc_id, r.component_id) for r in N.near_duplicates(docs, 3, 85, 100).collect()} == {(1, 1), (2, 1), (3, 3)}
    cut = {r.doc_id: r.text for r in S.dedup_substrings(docs).collect()}
    assert cut[1] == long and len(cut[2]) < 0.01 * len(long) and cut[3] == rows[2][1]
    scored = {r.doc_id: r for r in LM.score(docs, docs).collect()}
    assert scored[1].n_tokens == 150_001 and all(math.isfinite(r.score) for r in scored.values())
    pieces = K.pack(docs).groupBy("doc_id").agg(F.sum("length").alias("n"), F.first("doc_tokens").alias("t")).collect()
    assert all(r.n == r.t for r in pieces)
    pages = spark.createDataFrame([(i, "u", t) for i, t in rows], "page_id int, url string, html string")
    back = W.read_warc(spark, f"file://{tmp_path}/w", W.write_warc(pages, f"file://{tmp_path}/w"))
    assert {r.page_id: r.payload_bytes for r in back.collect()} == {i: len(t) for i, t in rows}


def test_lm_of_empty_documents(spark):
    empty = spark.createDataFrame([], DOCS)
    assert LM.score(empty, empty).count() == 0 and LM.score(empty, spark.createDataFrame([(1, "a b")], DOCS)).count() == 0


def test_pipeline_stages_of_odd_tables(spark, folder):
    """Nulls, empty texts, repeated rows and ids, extra columns with clashing names, and no rows at all."""
    import corpus_pipeline as C

    schema = "doc_id int, text string, lang string, source string, n_chars long, kept string, hits int, spans string, component_id int"
    tail = ("en", "s", 4, "k", 1, "x", 2)
    text = "the cat sat on the mat and the dog ran over the wide green field to the old mill"
    rows = [
        (1, text, *tail),
        (1, text, *tail),
        (1, "another text with the same id but with no word of the first one in it", *tail),
        (2, text + "\nnow", *tail),
        (3, None, *tail),
        (4, "", *tail),
        (None, text, *tail),
        (5, "x" * 100_000, *tail),
    ]
    for made in (rows, []):
        docs = spark.createDataFrame(made, schema)
        for name, stage in C.STAGES[:-1]:
            out = stage(spark, docs, folder)
            assert out.columns == docs.columns, name
            got = Counter((r.doc_id, r.text) for r in out.collect())
            if made and name == "near_dedup":
                assert got == Counter([(1, text), (1, rows[2][1]), (3, None), (4, ""), (None, text), (5, "x" * 100_000)])
            if made and name == "language_id":
                assert {k for k in got} >= {(1, text), (1, rows[2][1])} and (3, None) not in got and (4, "") not in got
            if made and name == "substring_dedup":  # of the two copies of the passage that stand in other documents, the later one goes
                assert got == Counter([(1, text), (1, text), (1, rows[2][1]), (2, "now"), (None, text), (5, "x" * 100_000)]), got
            if made and name == "decontamination":
                assert got == Counter((r[0], r[1]) for r in rows)
        assert C.STAGES[-1][1](spark, docs, folder).select("doc_id").distinct().count() == len({r[0] for r in made})


def test_scan_takes_any_integer_id(spark):
    bench = spark.createDataFrame([(1, "one two three")], "item_id int, text string")
    got = D.scan(spark.createDataFrame([(7, "one two three"), (None, None)], "doc_id int, text string"), bench).collect()
    assert sorted((r.doc_id or 0, len(r.item_ids)) for r in got) == [(0, 0), (7, 1)]


def test_near_dedup_with_deep_nodes_equals_an_exact_join(spark, monkeypatch):
    """All documents of sf0.01, with nodes so small that most branch over several levels: no link is lost."""
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()
    sets, owners = {}, defaultdict(list)
    for r in rows:
        words = (r.text or "").encode().lower().split()
        k = min(3, len(words))
        sets[r.doc_id] = {tuple(words[j : j + k]) for j in range(len(words) - k + 1)} if words else set()
    often = Counter(x for s in sets.values() for x in s)
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i in sorted(sets):  # prefix filter: of a set's rarest shingles, one more than may be missing is shared
        rare = sorted(sets[i], key=lambda x: (often[x], x))[: len(sets[i]) - math.ceil(0.85 * len(sets[i])) + 1]
        for j in {j for x in rare for j in owners[x]}:
            common = len(sets[i] & sets[j])
            if 100 * common >= 85 * (len(sets[i]) + len(sets[j]) - common):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
        for x in rare:
            owners[x].append(i)
    monkeypatch.setattr(N, "SMALL", 24)
    got = {r.doc_id: r.component_id for r in queries.QUERIES["op5_near_dedup"](spark, "/root/testdata/sf0.01").collect()}
    assert got == {i: find(i) for i in sets} and len(set(got.values())) < len(got)
