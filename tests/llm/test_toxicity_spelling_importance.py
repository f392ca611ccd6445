"""Toxicity, spelling variants and importance resampling: brute force, plain Python versions, held-out accuracy, and odd inputs."""

import hashlib
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from roadlens.llm import importance as I
from roadlens.llm import queries
from roadlens.llm import spelling as S
from roadlens.llm import toxicity as T

DOCS = "doc_id long, text string"
ODD = [(1, None), (2, ""), (3, " \n\t,."), (4, "a"), (5, "b"), (5, "b"), (6, "é " * 3), (None, "no id at all here"), (7, "*** 123")]


def split(text):
    out, word = [], ""
    for c in (text or "") + " ":
        c = c.lower() if c.isascii() else c
        if c.isascii() and not c.isalnum():
            out += [word] if word else []
            word = ""
        else:
            word += c
    return out


# Importance resampling --------------------------------------------------------------------------------------------------------------


def plain_draw(docs, target, order, per_cent, seed=I.SEED):
    grams = lambda w: [" ".join(w[i : i + n]) for n in range(1, order + 1) for i in range(len(w) - n + 1)]
    bucket = lambda g: zlib.crc32(g.encode()) % I.BUCKETS
    s = Counter(bucket(g) for _, t in docs for g in grams(split(t)))
    t = Counter(bucket(g) for x in target for g in grams(split(x)))
    sn, tn = sum(s.values()) + I.BUCKETS, sum(t.values()) + I.BUCKETS
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * sn / ((s[b] + 1) * tn)))
    rows = []
    for i, text in docs:
        words = split(text)
        weight = sum(gain(bucket(g)) for g in grams(words))
        h = int(hashlib.sha256(f"{seed}:{i}".encode()).hexdigest()[:8], 16)
        score = None if i is None else weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))
        rows.append([i, len(grams(words)), weight, score, None, len(words)])
    fit = sorted((r for r in rows if r[5] >= I.LEAST_WORDS and r[0] is not None), key=lambda r: (-r[3], r[0]))
    for k, r in enumerate(fit[: len(fit) * per_cent // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in rows), key=repr)


@pytest.mark.parametrize(("order", "per_cent"), [(1, 10), (2, 35), (3, 100)])
def test_resampling_equals_plain_python(spark, order, per_cent):
    rng = np.random.default_rng(order)
    words = [f"w{i}" for i in range(40)] + ["École", "ß", "X-1", "a.b"]
    docs = [(i, " ".join(words[j] for j in rng.integers(0, len(words), rng.integers(0, 60)))) for i in range(300)] + ODD + [(900, "long " * 50_000)]
    target = [" ".join(words[:9]) * 3, None, "", "w1 w2, W3"]
    got = I.resample(spark.createDataFrame(docs, DOCS).repartition(5), spark.createDataFrame([(x,) for x in target], "text string"), per_cent, order)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plain_draw(docs, target, order, per_cent)


def test_draw_with_ties_ranges_and_empty_tables(spark):
    schema = "doc_id long, n_words long, score long, extra string"
    rows = [(i, 20 + i % 2, i // 50, "x") for i in range(1000)] + [(2000, 5, 99, "short"), (None, 50, 99, "no id")]
    got = {r.doc_id: r.rank for r in I.draw(spark.createDataFrame(rows, schema), 33).collect()}
    want = sorted(range(1000), key=lambda i: (-(i // 50), i))[:330]
    assert {i: k for i, k in got.items() if k} == {i: k + 1 for k, i in enumerate(want)} and len(got) == 1002
    assert I.draw(spark.createDataFrame([], schema)).count() == 0
    empty = spark.createDataFrame([], DOCS)
    assert I.resample(empty, empty).count() == 0
    one = I.resample(spark.createDataFrame([(1, "a " * 30)], DOCS), empty).first()
    assert (one.n_features, one.rank) == (30, None)


def test_select_drawn_keeps_columns(spark):
    docs = spark.createDataFrame([(i, f"w{i} " * 25, i * 2, "r") for i in range(40)], DOCS + ", score int, rank string")
    target = spark.createDataFrame([("w3 w5",)], "text string")
    got = I.select_drawn(docs, target, 25)
    assert got.columns == docs.columns and got.count() == 10


# Spelling variants ------------------------------------------------------------------------------------------------------------------


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(counts, ratio=5):
    words = sorted(counts)
    near = {w: [x for x in words if one_edit(w, x)] for w in words}
    best = {w: min(near[w], key=lambda x: (-counts[x], x)) if near[w] else None for w in words}
    form = {w: b if b is not None and counts[b] >= ratio * counts[w] else None for w, b in best.items()}

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return sorted((w, form[w], root(w), counts[w], len(near[w]), counts[form[w]] if form[w] else None) for w in words)


@pytest.mark.parametrize("crowd", [S.CROWD, 2, 0])
def test_variants_equal_brute_force(spark, monkeypatch, crowd):
    """Reduced forms shared by many words go over the full alphabet; with 0 all of them do."""
    monkeypatch.setattr(S, "CROWD", crowd)
    rng = np.random.default_rng(5)
    counts = {}
    letters = "abeéèÿ×z"
    for _ in range(60):
        word = "".join(rng.choice(list(letters), rng.integers(1, 9)))
        for _ in range(5):
            counts[word] = int(5 ** rng.integers(1, 6))
            at = rng.integers(0, len(word) + 1)
            word = (word[:at] + str(rng.choice(["", "a", "é"])) + word[at + rng.integers(0, 2) :]) or "a"
    counts |= {"y" * 3000: 7, "y" * 2999: 70, "y" * 1500 + "z" + "y" * 1499: 3}
    got = S.group_variants(spark.createDataFrame(list(counts.items()), "word string, n long").repartition(3))
    assert sorted((tuple(r) for r in got.collect()), key=repr) == sorted(plain_variants(counts), key=repr)


def test_neighbourhoods_are_full():
    for word in ("ab", "zéa", "q"):
        for full in (False, True):
            keys = {int(k) for _, ks in S.neighbour_keys([word], full) for k in ks}
            letters = [chr(c) for c in S._LETTERS]
            forms = {word} | {word[:i] + word[i + 1 :] for i in range(len(word)) if len(word) > 1}
            forms |= {word[:i] + c + word[i + k :] for i in range(len(word) + 1) for c in letters for k in (0, 1)}
            assert keys >= {int(k) for k in S.form_keys(sorted(f for f in forms if f), full)}
            assert len(keys) <= 2 + len(word) * 3 * (len(S._LETTERS) if full else S.SYMBOLS) + S.SYMBOLS * (1 if not full else 20)


def test_word_counts_and_typos(spark):
    docs = [(i, f"Planet planet PLANETÉ Éplanet çaıüplanet short{i} 12planets34") for i in range(400)] + [*ODD, (None, "planets")]
    want = Counter()
    for i, text in docs:
        runs, run = [], ""
        for c in (text or "") + " ":
            c = c.lower() if c.isascii() else c
            if "a" <= c <= "z" or "À" <= c <= "ÿ":
                run += c
            elif run:
                runs.append(run)
                run = ""
        for run in runs:
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % S.TYPO == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 6:
                want[run] += 1
    got = S.word_counts(spark.createDataFrame(docs, DOCS), typo=S.TYPO)
    assert {r.word: r.n for r in got.collect()} == want and any(w not in ("planet", "planets", "planeté", "Éplanet") for w in want)


def test_variants_of_empty_tables(spark, tmp_path):
    assert S.group_variants(spark.createDataFrame([], "word string, n long")).count() == 0
    spark.createDataFrame(ODD, DOCS).selectExpr("*", "1 AS n", "'x' AS word").write.parquet(f"{tmp_path}/documents.parquet")
    assert queries.QUERIES["op12_spelling_variants"](spark, str(tmp_path)).count() == 0


# Toxicity ---------------------------------------------------------------------------------------------------------------------------


def test_segments_are_all_maximal_ones():
    """Against the definition: recursively the best run, then what lies left and right of it; ties decide nothing with real scores."""

    def plain(scores, lo, hi):
        best = None
        for a in range(lo, hi):
            total = 0.0
            for b in range(a, hi):
                total += scores[b]
                if total > 1e-12 and (best is None or total > best[0] + 1e-12):
                    best = (total, a, b + 1)
        if best is None:
            return []
        return plain(scores, lo, best[1]) + [(best[1], best[2], best[0])] + plain(scores, best[2], hi)

    rng = np.random.default_rng(2)
    for _ in range(200):
        scores = rng.normal(-0.3, 1, rng.integers(0, 25))
        got = T.segments(scores)
        want = plain(scores.tolist(), 0, len(scores))
        assert [g[:2] for g in got] == [w[:2] for w in want]
        assert np.allclose([g[2] for g in got], [w[2] for w in want])
    assert len(T.segments(np.tile([1.0, -2.0], 200_000))) == 200_000  # linear
    assert T.segments(np.tile([1.0, -0.5], 200_000)) == [(0, 399_999, 100_000.5)]


def test_scale_is_the_root():
    counts = {-70: 900, 100: 50, 300: 2}
    x = T.chance_scale(counts)
    counts = counts | {round((T.HIGHEST - T.DRIFT) / T._BIN): 1}
    total = sum(counts.values())
    assert sum(n / total * math.exp(x * s * T._BIN) for s, n in counts.items()) == pytest.approx(1, abs=1e-6)


@pytest.fixture(scope="module")
def fitted(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    texts = T.labelled_texts(docs, labels.select("doc_id", F.col("toxic").alias("label")).where(~T.fold("doc_id", 5, 0)))
    return texts, T.count_nodes(texts), T.fit(texts)


def test_lexicon_and_scores_equal_plain_python(spark, fitted):
    texts, counted, model = fitted
    counts, words = defaultdict(Counter), defaultdict(Counter)
    for r in texts.collect():
        for word, n in Counter(split(bytes(r.text).decode())).items():
            for node in ["", *(word[:k] for k in (4, 5, 6, 7, 8) if k <= len(word)), word + "."]:
                counts[node][r.label] += min(n, 10)
                words[node][r.label] += 1
    listed = {x for x, d in words.items() if d[1] >= 2 or d[0] >= 10}
    assert counted.counts == {x: (counts[x][1], counts[x][0]) for x in listed}
    base = (counts[""][1] + 1) / (counts[""][1] + counts[""][0] + 2)
    for word in ("idiot", "idiots", "idiotic", "the", "unheardofword", "thenx", "de"):
        share = base
        for node in [word[:k] for k in (4, 5, 6, 7, 8) if k <= len(word)] + [word + "."]:
            if node not in listed:
                break
            share = (counts[node][1] + 6 * share) / (counts[node][1] + counts[node][0] + 6)
        odds = math.log(share / (1 - share)) - math.log(base / (1 - base))
        want = min(max(odds, -1.5), 8) - 0.7
        assert counted.score(word.encode()) == pytest.approx(want)
        assert model.scores_of([word.encode()])[0] == pytest.approx(want, abs=0.011)
    assert model.scores_of([b"idiot"])[0] > 3 > 0 > model.scores_of([b"the"])[0]


def test_own_counts_are_taken_out(fitted):
    texts, counted, _ = fitted
    r = texts.where("label = 1 and length(text) < 2000").orderBy("doc_id").first()
    own = T.node_counts(T.words_of(bytes(r.text)), {})
    rest = T.Model({x: (a - own.get(x, 0), b) for x, (a, b) in counted.counts.items()}, counted.toxic - 1, counted.clean)
    words = T.words_of(bytes(r.text))
    assert np.allclose(counted.scores_of(words, 1), [rest.score(w) for w in words])


def test_toxicity_held_out(spark):
    folder = "/root/testdata/sf0.1"
    rows = queries.QUERIES["op11_toxicity"](spark, folder).join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").where("held_out").collect()
    toxic, clean = [r for r in rows if r.toxic], [r for r in rows if not r.toxic]
    assert sum(r.predicted for r in toxic) / len(toxic) > 0.87  # some of the rest are labelled wrongly
    assert sum(r.predicted for r in clean) / len(clean) < 0.01
    assert all((r.n_passages > 0) >= (r.score > 0.9) and 0 <= r.score <= 1 for r in rows)


def test_passages_lie_where_the_words_are(spark, fitted):
    model = fitted[2]
    calm = "the and of that is with for in to as " * 30
    text = "É " + calm + "you Idiot, you worthless\nclown of " + calm
    row = T.score_texts(spark.createDataFrame([(1, text), (2, calm)], DOCS), model).orderBy("doc_id").collect()
    found = [text[p.start : p.end] for p in row[0].passages]
    assert row[0].score > 0.5 > row[1].score and not row[1].passages
    assert any("Idiot" in f for f in found) and any("clown" in f for f in found) and all(len(f) < 60 for f in found)


def test_toxicity_odd_tables(spark, tmp_path):
    schema = "doc_id int, text string, lang string, score double, label int"
    cases = {
        "empty": ([], []),
        "unlabelled": ([(1, "a b", "x", 0.1, 1), (2, None, None, None, None)], []),
        "one_class": ([(i, f"word{i} more", "x", 0.1, 0) for i in range(12)], [(i, 1) for i in range(12)]),
        "few": (
            [(1, "a b", "x", 0.1, 1), (1, "a b", "x", 0.1, 0), (2, "word " * 300_000, None, None, 1), (3, None, "y", 1.0, 0), (None, "a b", "", 0.0, 1),
             (4, "", "y", 1.0, 0), (5, " .,", "y", 1.0, 0), (6, "bad thing", "y", 1.0, 0)],
            [(1, 1), (1, 0), (2, 0), (3, None), (None, 1), (9, 1), (4, 1), (6, 0)],
        ),
    }
    for name, (docs, labels) in cases.items():
        spark.createDataFrame(docs, schema).write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.createDataFrame(labels, "doc_id int, toxic int").write.parquet(f"{tmp_path}/{name}/labels.parquet")
        got = queries.QUERIES["op11_toxicity"](spark, f"{tmp_path}/{name}").collect()
        assert len(got) == len(docs) and all(0 <= r.score <= 1 and r.held_out is not None for r in got)
        assert len({r.score for r in got if r.doc_id == 1}) <= 1


def test_scores_of_very_common_words_are_bounded():
    path = T.path_of(b"insulting")
    sure = T.Model({x: (10**9, 0) for x in path} | {"": (10**9, 10**9)}, 10, 10)
    never = T.Model({x: (0, 10**9) for x in path} | {"": (10**9, 10**9)}, 10, 10)
    assert sure.score(b"insulting") == T.HIGHEST - T.DRIFT and never.score(b"insulting") == T.LOWEST - T.DRIFT


def test_near_copies_are_learned_once(spark):
    rng = np.random.default_rng(1)
    base = [f"w{i}" for i in rng.integers(0, 10_000, 200)]
    docs = [(i, " ".join(base[:i] + [f"x{i}"] + base[i + 1 :])) for i in range(50)] + [(100 + i, f"other{i} text{i} here{i}") for i in range(5)]
    labels = spark.createDataFrame([(i, 1) for i, _ in docs], "doc_id long, label int")
    kept = {r.doc_id for r in T.labelled_texts(spark.createDataFrame(docs, DOCS), labels).collect()}
    assert kept >= {0, 100, 101, 102, 103, 104} and len(kept) < 9
    some = T.labelled_texts(spark.createDataFrame(docs[50:] * 3, DOCS), labels, sample=3)
    assert some.count() == some.select("doc_id").distinct().count()
