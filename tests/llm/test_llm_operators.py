"""Training-data operators: brute force, round trips, held-out accuracy, and odd inputs."""

import hashlib
import json
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from compare import check
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
from roadlens.llm.common import materialize

DOCS = "doc_id long, text string"
ODD = [(1, None), (2, ""), (3, " \n\t"), (4, "a"), (5, "a"), (5, "a"), (6, "é " * 3), (None, "no id at all here"), (7, "*** 123")]


def docs_of(spark, rows, schema=DOCS):
    return spark.createDataFrame(rows, schema)


@pytest.fixture(scope="module")
def documents(spark, folder):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()}


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_oracle(name, spark, duck, folder):
    check(name, spark, duck, folder, queries.QUERIES, queries.ORACLE_SQL)


# Near-dedup --------------------------------------------------------------------------------------------------------------------


def brute_components(texts, width, num, den):
    sets = {}
    for i, text in texts.items():
        w = (text or "").encode().lower().split()
        k = min(width, len(w))
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if w else set()
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            a, b = sets[i], sets[j]
            if a and b and min(len(a), len(b)) * den >= num * max(len(a), len(b)):
                common = len(a & b)
                if den * common >= num * (len(a) + len(b) - common):
                    x, y = find(i), find(j)
                    parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_near_dedup_equals_brute_force(spark, folder, documents):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in queries.QUERIES["op5_near_dedup"](spark, folder).collect()}
    assert got == brute_components(documents, 3, 85, 100)


def edited(words, count, rng):
    words = list(words)
    for at in rng.integers(0, len(words), count):
        words[at] = f"w{rng.integers(1 << 30)}"
    return " ".join(words)


def test_near_dedup_of_chains_and_groups(spark, monkeypatch):
    """Chains of edits, groups of near copies and groups just below the threshold; small nodes forced to branch."""
    rng = np.random.default_rng(3)
    texts = {}
    for g in range(4):
        base = [f"t{rng.integers(1 << 30)}" for _ in range(120)]
        for i in range(14):
            texts[100 * g + i] = edited(base, (1, 2, 4, 7)[g], rng)
    chain = [f"c{rng.integers(1 << 30)}" for _ in range(150)]
    for i in range(10):
        chain[i * 9] = f"x{i}"
        texts[900 + i] = " ".join(chain)
    want = brute_components(texts, 3, 85, 100)
    frame = docs_of(spark, list(texts.items()))
    for small, depth in ((6, N.DEPTH), (6, 1)):  # the last: nodes that are still large meet in blocks
        monkeypatch.setattr(N, "SMALL", small)
        monkeypatch.setattr(N, "DEPTH", depth)
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in N.near_duplicates(frame, 3, 85, 100).collect()}
        assert got == want


def test_one_template_below_the_threshold_is_compared_once(spark, monkeypatch):
    """Documents that are alike on average but not near copies: branching stops where it makes more pairs, and nothing is lost."""
    rng = np.random.default_rng(12)
    base = [f"t{i}" for i in range(120)]
    texts = {i: edited(base, 4, rng) for i in range(600)}
    texts |= {1000 + i: edited(texts[i * 7].split(), 1, rng) for i in range(20)}
    want = brute_components(texts, 3, 85, 100)
    levels, blocks = [], []
    children, in_blocks = N._children, N._blocks
    monkeypatch.setattr(N, "SMALL", 40)
    monkeypatch.setattr(N, "_children", lambda rows, level: levels.append(level) or children(rows, level))
    monkeypatch.setattr(N, "_blocks", lambda rows: blocks.append(rows.count()) or in_blocks(rows))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in N.near_duplicates(docs_of(spark, list(texts.items())), 3, 85, 100).collect()}
    assert got == want and len({c for _, c in want.values()}) > 500
    assert len(levels) <= 4 and sum(blocks) < 40 * len(texts)  # without the rule: 8 levels, over a hundred nodes for each document


def test_components_are_contracted_over_roots(spark):
    rng = np.random.default_rng(2)
    parts = [[(int(a), int(b)) for a, b in rng.integers(0, 400, (n, 2)) if a != b] for n in (60, 80, 100)]
    frames = [spark.createDataFrame(p, "a long, b long") for p in parts]
    roots = N.star_components(frames[0])
    for frame in frames[1:]:
        roots = N.contract(roots, frame)
    want = {r.id: r.root for r in N.star_components(frames[0].union(frames[1]).union(frames[2])).collect()}
    assert {r.id: r.root for r in roots.collect()} == want and roots.count() == len(want)
    assert N.contract(roots, frames[0]).count() == len(want)


def test_deep_nodes_keep_pairs_together(spark):
    """Pairs whose sketches agree at 0.7 of the places share a node of the last level as often as independent choices let them."""
    rng, n = np.random.default_rng(11), 600
    one = rng.integers(-(1 << 31), 1 << 31, (n, N.SKETCH))
    other = np.where(rng.random(one.shape) < 0.7, one, rng.integers(-(1 << 31), 1 << 31, one.shape))
    rows = [(2 * i + k, 1, [int(x) for x in marks[i]]) for i in range(n) for k, marks in enumerate((one, other))]
    base = spark.createDataFrame(rows, "id long, size long, sketch array<int>")
    level = base
    for depth in range(N.DEPTH):
        nodes = N._children(level, depth)
        pair = F.expr("id div 2").alias("pair")
        shared = nodes.groupBy("tree", "node", pair).agg(F.collect_set("id").alias("ids")).where("size(ids) = 2")
        shared = materialize(shared, "shared-nodes")
        level = shared.select("tree", "node", F.explode("ids").alias("id")).join(base, "id")
    assert n - shared.select("pair").distinct().count() <= 6


def test_near_dedup_odd_rows(spark):
    rows = N.near_duplicates(docs_of(spark, ODD), 3, 85, 100).collect()
    assert Counter((r.doc_id, r.component_id, r.kept) for r in rows) == Counter(
        [(1, 1, True), (2, 2, True), (3, 3, True), (4, 4, True), (5, 4, False), (5, 4, False), (6, 6, True), (None, None, True), (7, 7, True)]
    )
    assert N.near_duplicates(docs_of(spark, [])).count() == 0


def test_one_id_with_different_texts(spark):
    rng = np.random.default_rng(5)
    a, b, c = (" ".join(f"{k}{rng.integers(1 << 30)}" for _ in range(80)) for k in "abc")
    rows = [(1, a), (1, b), (2, a + " end"), (3, b + " end"), (3, c), (3, c), (4, c)]
    got = N.near_duplicates(docs_of(spark, rows), 3, 85, 100).join(
        docs_of(spark, rows).distinct().select("doc_id", F.xxhash64("text").alias("text_hash"), "text"), ["doc_id", "text_hash"]
    )
    got = Counter((r.doc_id, r.text, r.component_id, r.kept) for r in got.collect())
    assert got == Counter(
        [(1, a, 1, True), (1, b, 1, True), (2, a + " end", 1, False), (3, b + " end", 1, False), (3, c, 3, True), (3, c, 3, True), (4, c, 3, False)]
    )


def test_long_chains_have_one_root(spark):
    n = 300
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(1000, 1000 + i) for i in range(1, 50)], "a long, b long")
    roots = {r.id: r.root for r in N.star_components(edges).collect()}
    assert roots == dict.fromkeys(range(n + 1), 0) | dict.fromkeys(range(1000, 1050), 1000)


def test_exact_links_inside_a_node():
    rng = np.random.default_rng(1)
    base = np.unique(rng.integers(0, 1 << 62, 400, dtype=np.uint64))
    sets = [np.unique(np.concatenate([base[k:], rng.integers(0, 1 << 62, k, dtype=np.uint64)])) for k in (0, 5, 60, 200)]
    found = N.links_within([0, 1, 2, 3], [0, 1, 2, 3], sets, 85, 100)
    near = lambda a, b: 100 * len(np.intersect1d(a, b)) >= 85 * len(np.union1d(a, b))
    assert all(near(sets[a], sets[b]) for a, b in found) and len(found) == 1


# Substring dedup ---------------------------------------------------------------------------------------------------------------


def test_substring_dedup_equals_brute_force(spark, folder, documents):
    """Later occurrences of units, and which of them stand in long runs, by plain dictionaries and word lists."""
    first, want = {}, {}
    for i in sorted(documents):
        text, runs = documents[i], []
        for a, b in S.units(text):
            key = " ".join(text[a:b].lower().split())
            if first.setdefault(key, (i, a)) != (i, a):
                if runs and not text[runs[-1][-1][1] : a].strip():
                    runs[-1].append((a, b))
                else:
                    runs.append([(a, b)])
        every = [span for run in runs for span in run]
        spans = [span for run in runs if sum(len(text[a:b].split()) for a, b in run) >= 10 for span in run]
        want[i] = (S.remove_spans(text, spans) if spans else text, spans, every, S.remove_spans(text, every) if every else text)
    rows = queries.QUERIES["op6_substring_dedup"](spark, folder).collect()
    pairs = lambda spans: [(s.start, s.end) for s in spans]
    got = {r.doc_id: (r.text or "", pairs(r.removed_spans), pairs(r.repeated_spans), r.text_without_repeats or "") for r in rows}
    assert got == want and any(spans for _, spans, _, _ in want.values())
    assert all(r.n_units_removed == len(r.removed_spans) for r in rows)


def test_every_repeated_line_goes(spark, monkeypatch):
    """Plain sets of whole lines, of any length, over sf0.01: nothing of a line that stood before is left, and first lines of new words stay."""
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    seen_lines, seen_words, again, new = set(), set(), defaultdict(list), defaultdict(list)
    for i in sorted(texts):
        at = 0
        for line in texts[i].split("\n"):
            key, words = " ".join(line.lower().split()), set(line.lower().split())
            if key:
                if key in seen_lines:
                    again[i].append((at, at + len(line)))
                elif words - seen_words == words:
                    new[i].append((at, at + len(line)))
                seen_lines.add(key)
                seen_words |= words
            at += len(line) + 1
    assert sum(map(len, again.values())) > 1000 and new
    for limit in (S.BROADCAST_SPANS, 0):  # broadcast, and shuffled behind the map
        monkeypatch.setattr(S, "BROADCAST_SPANS", limit)
        for r in S.dedup_substrings(docs).collect():
            gone = np.zeros(len(texts[r.doc_id]) + 1, bool)
            for s in r.repeated_spans:
                gone[s.start : s.end] = True
            for a, b in again[r.doc_id]:
                assert all(gone[k] or texts[r.doc_id][k].isspace() for k in range(a, b)), (r.doc_id, a, b)


@pytest.mark.parametrize("limit", [S.BROADCAST_SPANS, 0])
def test_texts_of_one_id_are_cut_apart(spark, monkeypatch, limit):
    monkeypatch.setattr(S, "BROADCAST_SPANS", limit)
    rng = np.random.default_rng(6)
    passage, own, other = (" ".join(f"{k}{rng.integers(1 << 30)}" for _ in range(60)) for k in "pao")
    rows = [(0, passage), (1, own), (1, f"{other}\n{passage}"), (1, own), (None, passage)]
    for report in (True, False):
        out = Counter((r.doc_id, r.text) for r in S.dedup_substrings(docs_of(spark, rows), report=report).collect())
        assert out == Counter([(0, passage), (1, own), (1, f"{other}\n"), (1, own), (None, passage)])


def test_whole_lines_equal_brute_force(spark):
    """Lines of one sentence each: what a plain set of lines finds is what goes."""
    rng = np.random.default_rng(4)
    pool = [" ".join(f"{chr(97 + x)}{rng.integers(300)}" for x in rng.integers(0, 26, rng.integers(1, 30))) for _ in range(60)]
    rows = [(i, "\n".join(pool[k] for k in rng.integers(0, 60, rng.integers(1, 12)))) for i in range(80)]
    for least in (1, 15):
        seen, want = set(), {}
        for i, text in rows:
            lines, runs = text.split("\n"), []
            for k, line in enumerate(lines):
                again = line in seen
                seen.add(line)
                if again and runs and runs[-1][-1] == k - 1:
                    runs[-1].append(k)
                elif again:
                    runs.append([k])
            gone = {k for run in runs if sum(len(lines[k].split()) for k in run) >= least for k in run}
            want[i] = " ".join(x for k, line in enumerate(lines) if k not in gone for x in line.split())
        got = {r.doc_id: " ".join(r.text.split()) for r in S.dedup_substrings(docs_of(spark, rows), min_words=1, least_run=least).collect()}
        assert got == want


def test_passages_inside_lines_are_found(spark):
    passage = (
        "The old mill stood by the river for years. Nobody knew who had built it there. Every spring the water rose up to its door. Then one day it was "
        "gone."
    )
    rows = [
        (1, f"Here begins a first text of its own. {passage} And it goes on."),
        (2, f"some words before it {passage} and others after it"),
        (3, "A clean text. It repeats nothing that is long."),
    ]
    out = {r.doc_id: r for r in S.dedup_substrings(docs_of(spark, rows)).collect()}
    assert out[1].text == rows[0][1] and out[3].text == rows[2][1]
    assert "Every spring the water rose up to its door." not in out[2].text and out[2].text.endswith("and others after it")


def test_lines_of_short_parts_are_units(spark):
    """Whole repeated lines go, and repeated passages of short parts go wherever they stand in a line."""
    rng = np.random.default_rng(8)
    name = lambda: "".join(chr(97 + x) for x in rng.integers(0, 26, 6))
    titles = " ".join(name().title() for _ in range(60))
    lines = [
        "He ran. She sat. They saw it. A dog barked. It was late.",
        titles,
        "STOP!! " * 12,
        "Ann Lee, Bob Ray, Cy Dow, Di Fox",
        "雨が降る日に本を読む。猫は窓の外を見る",
        "今日は良い天気ですね",
        "x " * 3 + "Abc " * 50,
    ]
    for line in lines:
        assert S.units(line) and sum(b - a for a, b in S.units(line)) >= 0.8 * len(line.strip())
    rows = [(i + 10 * k, line + "\n") for k in (0, 1) for i, line in enumerate(lines)]
    got = {r.doc_id: r.text for r in S.dedup_substrings(docs_of(spark, rows), least_run=1).collect()}
    assert {i: got[i + 10].strip() for i in range(len(lines))} == dict.fromkeys(range(len(lines)), "")
    assert all(got[i] == lines[i] + "\n" for i in (0, 1, 3, 4, 5))
    for passage in (titles, "".join(chr(0x4E00 + int(x)) for x in rng.integers(0, 5000, 200))):
        shifted = [(1, passage), (2, f"Xa Yb Zc 前 {passage} Other Words Stand Here Now")]
        out = {r.doc_id: r.text for r in S.dedup_substrings(docs_of(spark, shifted)).collect()}
        assert out[1] == passage and len(out[2]) < 0.5 * len(passage)


def test_substring_odd_rows(spark):
    line = "one two three four five six"
    rows = [*ODD, (20, line), (21, f"{line}\n{line}"), (22, line.upper())]
    out = [(r.doc_id, r.text) for r in S.dedup_substrings(docs_of(spark, rows), least_run=6).collect()]
    assert Counter(out) == Counter([*ODD, (20, line), (21, ""), (22, "")])
    assert S.dedup_substrings(docs_of(spark, [])).count() == 0
    wide = S.dedup_substrings(docs_of(spark, [(1, line, 3, "x")], DOCS + ", n_chars long, spans string"))
    assert wide.first().spans == "x" and wide.first().n_chars == 3


# Decontamination ---------------------------------------------------------------------------------------------------------------


def test_decontamination_cuts_passages_only(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu"
    bench = spark.createDataFrame([(7, item), (8, "short one"), (9, ""), (10, None)], "item_id long, text string")
    rows = [
        (1, f"before that {' '.join(f'w{i}' for i in range(30))} {item.upper()}! after it"),
        (2, "clean text with alpha and beta"),
        (3, item),
        (4, None),
        (5, "Short, one; two more words that are clean"),
    ]
    rows.append((None, f"no id {item} end"))
    frame = docs_of(spark, [(a, b, "s") for a, b in rows], DOCS + ", source string")
    out = {r.doc_id: r.text for r in D.decontaminate(frame, bench).collect()}
    assert set(out) == {1, 2, 4, 5} | ({None} if None in out else set()) and out[2] == rows[1][1] and out[4] is None
    assert "ALPHA" not in out[1] and out[1].endswith("! after it")
    assert out[5] == "; two more words that are clean"


def test_decontamination_in_blocks(spark, folder, monkeypatch):
    docs, bench = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "benchmark"))
    whole = D.scan(docs.select("doc_id", "text"), bench).toPandas().sort_values("doc_id")
    monkeypatch.setattr(D, "BLOCK_BYTES", 2000)
    parts = D.scan(docs.select("doc_id", "text"), bench).toPandas().sort_values("doc_id")
    assert json.dumps(whole.to_dict("list"), default=list) == json.dumps(parts.to_dict("list"), default=list)


def test_benchmark_memory_is_bounded(spark):
    """32 MB of benchmark text of many distinct words: the blocks' windows together stay under a gigabyte."""
    import tracemalloc

    rng = np.random.default_rng(2)
    tracemalloc.start()
    block = []
    for i in range(D.BLOCK_BYTES // 8000):
        block.append((i, b" ".join(b"%x" % x for x in rng.integers(0, 1 << 20, 1350))))
    before = tracemalloc.get_traced_memory()[0]
    windows = D.Windows(block, D.WIDTH)
    used = tracemalloc.get_traced_memory()[0] - before
    tracemalloc.stop()
    assert sum(len(t) for _, t in block) > 0.8 * D.BLOCK_BYTES and used < 250e6
    text = block[5][1].split()
    mask, items = windows.hits([b"x", *text[100:130], b"y"])
    assert items == {5} and mask.sum() == 30


def test_repeated_windows_name_all_items(spark):
    item = " ".join(f"q{i}" for i in range(12))
    bench = spark.createDataFrame([(1, item), (2, item + " more words here"), (3, "other " + item)], "item_id int, text string")
    docs = spark.createDataFrame([(1, f"a {item} b", 5), (1, f"a {item} b", 5), (2, "x " * 50_000 + item, 6)], "doc_id int, text string, hits int")
    assert [r.item_ids for r in D.scan(docs, bench).collect()] == [[1, 2, 3]] * 3
    left = D.decontaminate(docs, bench).collect()
    assert [(r.doc_id, r.hits) for r in left] == [(2, 6)] and "q0" not in left[0].text


def test_decontamination_odd_rows(spark):
    empty = spark.createDataFrame([], "item_id long, text string")
    assert {r.n_words for r in D.scan(docs_of(spark, ODD), empty).where("doc_id < 4").collect()} == {0}
    assert D.scan(docs_of(spark, []), empty).count() == 0


# Language ID, quality, LM ------------------------------------------------------------------------------------------------------


def test_language_id_held_out(spark, folder):
    found = queries.QUERIES["op2_language_id"](spark, folder).join(
        spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang"), "doc_id"
    ).where("held_out").toPandas()
    assert (found.lang_pred == found.lang).mean() > 0.97 and found.score.between(0, 1).all()


def test_language_id_odd_rows(spark):
    model = L.train(
        spark.createDataFrame([("the cat and the dog", "en"), ("der hund und die katze", "de"), (None, "de"), ("x", None)], "text string, lang string")
    )
    got = {(r.doc_id, r.lang_pred) for r in L.identify(docs_of(spark, [*ODD, (30, "der hund " * 200_000)]), model).collect()}
    assert {(1, "und"), (2, "und"), (3, "und"), (7, "und"), (30, "de")} <= got
    nothing = L.train(spark.createDataFrame([], "text string, lang string"))
    assert {r.lang_pred for r in L.identify(docs_of(spark, ODD), nothing).collect()} == {"und"}


def test_quality_held_out(spark):
    folder = "/root/testdata/sf0.01"
    found = queries.QUERIES["op7_quality"](spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").where("held_out").toPandas()
    assert ((found.score >= 0.7).astype(int) == found.predicted).all() and (found.predicted == found.quality).mean() > 0.9


def test_quality_odd_rows(spark):
    table = Q.text_statistics(docs_of(spark, ODD))
    constant = Q.fit_rules(table.withColumn("label", F.lit(1)))
    assert Q.classify(table, constant).where("score between 0 and 1").count() == len(ODD)
    assert Q.tree_paths(
        "  Tree 0\n    If (feature 0 <= 1.5)\n     Predict: 0\n    Else (feature 0 > 1.5)\n     If (feature 1 <= 2.0)\n      Predict: 1\n     Else "
        "(feature 1 > 2.0)\n      Predict: 0"
    )[0] == (("log_chars", True, 1.5),)


def test_lm_base_equals_brute_force_and_model_is_better(spark, folder, documents):
    counts, tokens = Counter(), {}
    for i, text in documents.items():
        tokens[i] = [*text.encode().lower().split(), b""]
        if zlib.crc32(str(i).encode()) % 5 != 1:
            counts.update(tokens[i])
    n, v = sum(counts.values()), len(counts)
    rows = queries.QUERIES["op10_lm_score"](spark, folder).collect()
    assert len(rows) == len(documents)
    for r in rows:
        base = sum(np.log10((counts[t] + 0.5) / (n + 0.5 * (v + 1))) for t in tokens[r.doc_id])
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(tokens[r.doc_id]), sum(counts[t] > 0 for t in tokens[r.doc_id]), n)
        assert r.base_score == pytest.approx(base, rel=1e-9)
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)


def test_lm_probabilities_sum_to_one_and_head_is_bounded(spark, monkeypatch):
    texts = docs_of(spark, [(i, t) for i, t in enumerate(["a b c a b", "c a b", "d e f g", None, ""])])
    own_ids, own_classes = np.array([LM.END]), np.array([0])
    binary = texts.select(F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    blocks = LM.count_contexts(binary, own_ids, own_classes, 64)
    table = LM.train_classes(blocks, rounds=3)
    assert np.allclose((10**table).sum(axis=1), 1)
    shares = np.random.default_rng(0).dirichlet(np.ones(LM.DIGITS), LM.ENDINGS)
    ratios = LM.train_digits(blocks, shares, 64).astype(float).reshape(2, LM.ENDINGS, 64, LM.DIGITS)
    assert np.allclose((ratios * shares[None, :, None, :]).sum(axis=3), 1, atol=2e-3) and (ratios != 1).any()
    whole = LM.score(texts, texts).orderBy("doc_id").collect()
    monkeypatch.setattr(LM, "HEAD", 2)
    split = LM.score(texts, texts).orderBy("doc_id").collect()
    assert [r.base_score for r in whole] == pytest.approx([r.base_score for r in split])
    assert [r.n_known for r in whole] == [r.n_known for r in split]
    assert LM.score(docs_of(spark, ODD), docs_of(spark, [])).where("n_known = 0").count() == len(ODD)


def test_lm_score_equals_plain_python(spark, monkeypatch):
    """The score of each text, token by token, from the trained tables and plain counts."""
    rng = np.random.default_rng(9)
    words = [f"{'abcdefgh'[k % 8]}{k}{'xyz'[k % 3]}" for k in range(90)]
    texts = {
        i: " ".join(words[k] for k in np.minimum(rng.geometric(0.04, rng.integers(1, 60)), 89)) for i in range(60)
    } | {60: None, 61: "", 62: "unseen Words here"}
    held: dict = {}
    for name in ("train_classes", "train_digits"):
        monkeypatch.setattr(LM, name, lambda *a, _f=getattr(LM, name), _n=name, **k: held.setdefault(_n, _f(*a, **k)))
    frame = docs_of(spark, list(texts.items()))
    got = {r.doc_id: r.score for r in LM.score(frame, frame.where("doc_id < 40")).collect()}
    table, ratios = held["train_classes"], held["train_digits"].astype(float)
    cache = LM.Tokens()
    tokens = {i: [*(cache[w] for w in (t or "").lower().encode().split()), LM.END] for i, t in texts.items()}
    counts = Counter(x for i in range(40) for x in tokens[i])
    own = [t for t, _ in sorted(((t, n) for t, n in counts.items() if t != LM.END), key=lambda x: (-x[1], x[0]))[: LM.OWN]]
    number = {LM.END: 0} | {t: 1 + k for k, t in enumerate(own)}
    of = lambda t: number.get(t, 1 + LM.OWN + (t & 31))
    slots = LM.context_slots(len(counts))
    mass = defaultdict(float)
    for c in range(LM.CLASSES):
        mine = [t for t in counts if of(t) == c]
        mass[c] = counts[mine[0]] + 1 if c <= LM.OWN and mine else 1 if c <= LM.OWN else sum(counts[t] for t in mine) + 0.5 * (len(mine) + LM.DIGITS)
    for i, ids in tokens.items():
        want = 0.0
        for k, t in enumerate(ids):
            back = [ids[k - b] if k >= b else None for b in (1, 2)]
            one, two = (0 if b is None else of(b) for b in back)
            c = of(t)
            want += table[two * LM.CLASSES + one, c] + np.log10((counts[t] + 0.5) / mass[c])
            if c > LM.OWN:
                ratio = 0.0
                for family in (0, 1):
                    slot = (((back[family] or 0) * int(LM._CONTEXT[family]) & (1 << 64) - 1) >> 40) & (slots - 1)
                    ratio += LM.MIX[family] * ratios[family][((c - LM.OWN - 1) * slots + slot) * LM.DIGITS + (t >> 5 & 63)]
                want += np.log10(ratio)
        assert got[i] == pytest.approx(want, rel=1e-6)


# URLs --------------------------------------------------------------------------------------------------------------------------


def test_url_rules(spark, monkeypatch):
    urls = [
        "http://a.example.NET/en/x?y",
        "http://a.example.net/fr/",
        "https://net",
        "https://x.net/",
        "ftp://xnet/",
        None,
        "no url",
        "http://example.com/de/1#t",
        "http://b.org/fr/",
        "http://org/fr/",
        "http:///p",
        "x://h?q://z/",
    ]
    pages = spark.createDataFrame([(i, u, 1) for i, u in enumerate(urls)], "page_id long, url string, host int")
    rules = spark.createDataFrame(U.RULES, "verdict string, host string, path string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in U.judge(pages, rules).collect()}
    assert got[0] == ("a.example.net", "/en/x", "example.net/en/", "allow") and got[1][2:] == ("net/", "block")
    assert got[2] == ("net", "", None, "allow") and got[3][2] == "net/" and got[4][2] is None and got[5] == got[6] == ("", "", None, "allow")
    assert got[7][2:] == (
        "example.com/de/", "block"
    ) and got[8][2:] == got[9][2:] == ("org/fr/", "allow") and got[10][:2] == ("", "/p") and got[11][:2] == ("h", "")
    assert U.judge(pages, rules.limit(0)).where("rule is null").count() == len(urls)
    monkeypatch.setattr(U, "BROADCAST_RULES", 2)  # more rules than may be broadcast
    assert {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in U.judge(pages, rules).collect()} == got
    plan = U.judge(pages, rules)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan


# Packing -----------------------------------------------------------------------------------------------------------------------


def test_fill_is_closest_sum():
    rng = np.random.default_rng(0)
    for _ in range(60):
        counts = {int(k): int(rng.integers(1, 4)) for k in rng.integers(1, 40, 6)}
        gap = int(rng.integers(0, 90))
        chosen = K.fill(gap, counts)
        assert all(v <= counts[k] for k, v in chosen.items())
        sums = {0}
        for k, c in counts.items():
            sums = {s + i * k for s in sums for i in range(c + 1) if s + i * k <= gap}
        assert sum(k * v for k, v in chosen.items()) == max(sums)


def held_pieces(rows, ids):
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        assert zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) == r.ids_crc32 and r.doc_tokens == len(ids[r.doc_id])
        by_doc[r.doc_id].append((r.start, r.length))
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for pieces in [*by_doc.values(), *by_sequence.values()]:
        at = 0
        for start, length in sorted(pieces):
            assert start == at
            at += length
    sizes = [sum(n for _, n in p) for p in by_sequence.values()]
    assert set(by_doc) == set(ids) and max(sizes) <= 2048
    return sum(2048 - s for s in sizes if s & (s - 1))


def test_packing_is_an_exact_partition(spark, folder, documents):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    tokenizer.encode_special_tokens = True
    encode = lambda text: np.array([*tokenizer.encode(text, add_special_tokens=False).ids, 1], "<u4")
    assert held_pieces(queries.QUERIES["op4_packing"](spark, folder).collect(), {i: encode(t) for i, t in documents.items()}) == 0
    odd = {
        1: None,
        2: "",
        3: "  two  spaces\n\n and\ttabs ",
        4: " lead",
        5: "trail ",
        6: "it's <|endoftext|> é 漢字 \u00a0 x",
        7: "word " * 5000,
        8: "y" * 9000,
        9: "a\n b\x1c c",
    }
    packed = K.pack(docs_of(spark, list(odd.items())))
    assert held_pieces(packed.collect(), {i: encode(t or "") for i, t in odd.items()}) == 0
    with_ids = K.cut_ids(docs_of(spark, list(odd.items())), packed, K.default_vocabulary(), keep_ids=True).collect()
    assert sum(len(r.ids) for r in with_ids) == sum(len(encode(t or "")) for t in odd.values())
    assert K.pack(docs_of(spark, [])).count() == 0
    assert K.pack(docs_of(spark, [(5, "a"), (5, "a")])).count() >= 2


def test_added_tokens_are_found_as_tokenizers_does(spark, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(str(public_tokenizers.path("byte_bpe_50k.json")))
    texts = {1: "a <|endoftext|> b", 2: "<|endoftext|>", 3: "x  <|endoftext|><|endoftext|>  y z " * 900, 4: "a <|endoftext| > b", 5: None}
    docs_of(spark, list(texts.items())).write.parquet(f"{tmp_path}/documents.parquet")
    ids = {i: np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4") for i, t in texts.items()}
    assert 50256 in ids[1] and held_pieces(queries.QUERIES["op4_packing"](spark, str(tmp_path)).collect(), ids) == 0


# Fingerprints ------------------------------------------------------------------------------------------------------------------


def test_fingerprints(spark, folder, documents):
    ids = sorted(documents, reverse=True)
    following = dict(zip(ids, ids[1:] + ids[:1], strict=True))
    rows = {r.doc_id: r for r in queries.QUERIES["op8_fingerprints"](spark, folder).collect()}
    assert len(rows) == len(documents)
    for i, r in rows.items():
        text, half = documents[i], len(documents[i]) // 2
        assert r.n_chars == len(text) and r.edited_sha256 == hashlib.sha256(
            (text[: len(text) - half] + documents[following[i]][:half]).encode()
        ).hexdigest()
        assert r.fingerprint == P.render(P.fingerprint(text.encode())) and r.near_next == P.likeness(
            P.fingerprint(text.encode()), P.fingerprint(documents[following[i]].encode())
        )
    long = [r.near_edited for r in rows.values() if r.n_chars > 2000]
    assert 0.35 < np.mean(long) < 0.8


def test_chunks_resist_shifts():
    data = np.random.default_rng(5).integers(97, 123, 20_000, dtype=np.uint8).tobytes()
    assert P.likeness(P.fingerprint(data), P.fingerprint(b"inserted text" + data)) > 0.95
    ends = P.chunk_ends(data)
    assert ends[-1] == len(data) and all(0 < b - a <= P.MOST for a, b in zip([0, *ends], ends, strict=False))
    assert P.chunk_ends(b"") == [] and P.likeness({}, {}) == 1 and P.likeness({}, {"a": 1}) == 0


def test_fingerprint_odd_rows(spark):
    assert P.fingerprints(docs_of(spark, ODD)).count() == len(ODD)
    assert P.fingerprints(docs_of(spark, [])).count() == 0
    one = P.fingerprints(docs_of(spark, [(1, "abcd")])).first()
    assert one.edited_sha256 == hashlib.sha256(b"abab").hexdigest() and one.near_next == 1


# WARC --------------------------------------------------------------------------------------------------------------------------


def test_warc_is_deterministic_and_complete(spark, folder, tmp_path):
    big, small = "<html>" + "x" * 120, "<p>"
    rows = [
        (3, "http://a/ é", big),
        (1, "http://b/", big),
        (2, None, small),
        (5, "http://c/", small),
        (4, "http://d/", None),
        (None, "http://e/", big),
        (1, "http://b/", big),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    manifests = []
    for k in range(2):
        manifest = W.write_warc(pages, f"file://{tmp_path}/{k}", roll_bytes=300)
        manifests.append({(r.path.rsplit("/", 1)[1], r.records, r.sha256) for r in manifest.collect()})
        back = W.read_warc(spark, f"file://{tmp_path}/{k}", manifest).collect()
        assert Counter((r.page_id, r.record_type, r.refers_to, r.payload_bytes) for r in back) == Counter(
            [
                (3, "revisit", 1, 126),
                (1, "response", None, 126),
                (1, "response", None, 126),
                (2, "response", None, 3),
                (5, "response", None, 3),
                (4, "response", None, 0),
                (None, "response", None, 126),
            ]
        )
        assert all(r.payload is None or hashlib.sha256(r.payload).hexdigest() == r.payload_digest for r in back)
    assert manifests[0] == manifests[1] and len(manifests[0]) > 1
    empty = W.write_warc(pages.limit(0), f"file://{tmp_path}/none")
    assert empty.count() == 0 and W.read_warc(spark, f"file://{tmp_path}/none", empty).count() == 0


# Pipeline ----------------------------------------------------------------------------------------------------------------------


def test_pipeline_stages(spark, folder, documents):
    import corpus_pipeline

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
        assert docs.columns == columns
        kept[name] = {r.doc_id: r.text for r in docs.collect()}
    assert set(kept["language_id"]) == set(documents)  # every text of these tables has a language
    components = brute_components(documents, 5, 80, 100)
    assert set(kept["near_dedup"]) == {i for i, (_, c) in components.items() if i == c}
    cut = {r.doc_id: r for r in S.dedup_substrings(docs_of(spark, list(kept["near_dedup"].items()))).collect()}
    assert kept["substring_dedup"] == {i: r.text for i, r in cut.items() if r.text and r.text.strip()}
    for i, r in cut.items():
        assert r.text == (S.remove_spans(kept["near_dedup"][i], [(x.start, x.end) for x in r.removed_spans]) if r.removed_spans else kept["near_dedup"][i])
    flagged = {
        r.doc_id for r in D.scan(
            spark.createDataFrame(list(kept["decontamination"].items()), DOCS), spark.read.parquet(f"{folder}/benchmark.parquet")
        ).where("size(hit_ranges) > 0").collect()
    }
    assert len(flagged) <= 0.01 * len(documents)
    packed = corpus_pipeline.run(spark, folder)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == set(kept["decontamination"])
