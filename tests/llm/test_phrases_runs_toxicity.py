"""Phrases, periodic runs and toxicity against brute force, and the pipeline's stages on odd rows."""

import hashlib
import math
import random
from collections import Counter

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from riskgrid.llm import collocations, mixing, periodic, toxicity
from riskgrid.llm.queries import QUERIES

DOCS = "doc_id long, text string, lang string, source string, n_chars long, a long, w string, rows string, words string"


def frame(spark, rows):
    """Documents with columns whose names clash with what the operators add."""
    return spark.createDataFrame([(i, t, lang, s, None, 7, "x", None, "y") for i, t, lang, s in rows], DOCS)


ODD = [(1, None, None, None), (2, "", "en", "a"), (3, "ab c", "en", None), (3, "ab c", "en", None), (4, "\n \t", None, "b"), (5, "é" * 60, "fr", "a"), (None, "no id", "en", "a")]


# ---------------------------------------------------------------------- phrases


def best_phrases(rows, least, limit, cover):
    counts, totals = {}, Counter()
    for text, lang in rows:
        lang = lang if lang is not None else "und"
        low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for stop in ".,;:!?\n\v\f\r":
            low = low.replace(stop, "\0")
        for piece in low.split("\0"):
            words = [w for w in piece.replace("\t", " ").split(" ") if w]
            totals[lang] += len(words)
            for n in range(1, 5):
                for k in range(len(words) - n + 1):
                    g = tuple(words[k : k + n])
                    counts[lang, g] = counts.get((lang, g), 0) + 1
    out = []
    for (lang, g), a in counts.items():
        if len(g) < 2 or a < least:
            continue
        cuts = [(2_000_000 * a // (counts[lang, g[:k]] + counts[lang, g[k:]]), k) for k in range(1, len(g))]
        score, k = min(cuts)
        inside = [f for (other, h), f in counts.items() if other == lang and f >= least and len(h) > len(g) and any(h[i : i + len(g)] == g for i in range(len(h)))]
        if not any(100 * f >= cover * a for f in inside):
            out.append((lang, -score, -a, " ".join(g).encode(), counts[lang, g[:k]], counts[lang, g[k:]]))
    rank, got = Counter(), []
    for lang, score, a, phrase, left, right in sorted(out):
        rank[lang] += 1
        if rank[lang] <= limit:
            got.append((lang, rank[lang], phrase.decode(), -a, left, right, totals[lang], -score))
    return got


@pytest.mark.parametrize("limit, batch", [(2000, 8000), (12, 3), (3, 1)])
def test_phrases(spark, limit, batch):
    rng = random.Random(limit)
    words = ["en", "es", "a", "b", "Ab", "c", "é", "x\x0by", "A"]
    texts = [" ".join(rng.choice(words) + rng.choice(["", "", "", ".", "\t", "!"]) for _ in range(rng.choice([0, 3, 60]))) for _ in range(60)]
    texts += ["the same long passage again and again in every copy"] * 25 + ["one two three four five"] * 9
    rows = [(i, t, rng.choice(["en", "es", None, "und"]), None) for i, t in enumerate(texts)] + ODD
    got = collocations.phrases(frame(spark, rows), least=4, limit=limit, batch=batch).collect()
    assert sorted(map(tuple, got)) == sorted(best_phrases([(t, lang) for _, t, lang, _ in rows], 4, limit, 80))


def test_phrases_of_nothing(spark):
    for rows in ([], ODD):
        got = collocations.phrases(frame(spark, rows), least=30)
        assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"] and got.count() == 0


def test_counts_beyond_64_bit_products(spark):
    df = spark.createDataFrame([(9 * 10**18, 9 * 10**18, 9 * 10**18)], "a long, x long, y long")
    row = collocations._scored(df, [("x", "y"), ("y", "x")]).first()
    assert row.score == 1_000_000 and (row.l, row.r) == (9 * 10**18, 9 * 10**18)


# ------------------------------------------------------------------------- runs


def brute_runs(words, least, times):
    out = {}
    for q in range(1, len(words) // times + 1):
        i = 0
        while i + q < len(words):
            start = i
            while i + q < len(words) and words[i] == words[i + q]:
                i += 1
            if i - start + q >= max(least, times * q):
                out.setdefault((start, i - start + q), q)
            i += 1
    return sorted((s, n, q) for (s, n), q in out.items())


@pytest.mark.parametrize("least, times", [(6, 4), (2, 2), (9, 3)])
def test_runs(spark, least, times):
    rng = random.Random(least)
    rows = list(ODD)
    for i in range(300):
        n, k = rng.choice([0, 1, 5, 40, 150]), rng.choice([1, 2, 3, 9])
        words = [rng.choice("abcdefghi"[:k]) for _ in range(n)]
        for _ in range(rng.randrange(3)):
            if n > 4:
                a, p = rng.randrange(n), rng.randrange(1, 1 + n // 3)
                for j in range(a + p, rng.randrange(a, n + 1)):
                    words[j] = words[j - p]
        rows.append((i, " \n".join(words), None, None))
    rows.append((900, "loop " * 20_000, None, None))
    got = periodic.periodic_runs(frame(spark, rows).coalesce(2), least=least, times=times).collect()
    assert len(got) == len(rows)
    want = Counter()
    for i, t, _, _ in rows:
        words = (t or "").encode().split()
        runs = brute_runs(words, least, times) if i != 900 else [(0, 20_000, 1)]
        gone = {k for s, n, q in runs for k in range(s + q, s + n)}
        want[i, len(words), tuple(runs), b" ".join(w for k, w in enumerate(words) if k not in gone)] += 1
    assert Counter((r.doc_id, r.n_words, tuple(map(tuple, r.runs)), bytes(r.kept)) for r in got) == want


def test_runs_of_nothing(spark):
    assert periodic.periodic_runs(frame(spark, [])).count() == 0
    with pytest.raises(ValueError):
        periodic.periodic_runs(frame(spark, []), times=1)


def test_looped_texts(spark):
    from pyspark.sql import functions as F

    rows = [(k, t, h) for k, (t, h) in enumerate([("a b c d e f g h", 10 * 13), ("a b c", 11), (None, 0), ("", 20), ("x", 990)])]
    got = {r.k: r.t for r in spark.createDataFrame(rows, "k int, text string, h long").select("k", periodic.looped(F.col("text"), F.col("h")).alias("t")).collect()}
    # g = 13: a = 5, p = 1 + 3 div 8
    assert got == {0: "a b c d e f f f", 1: "a b c", 2: None, 3: "", 4: "x"}


# --------------------------------------------------------------------- toxicity


def grams(text):
    text = "".join(" " if ord(c) < 32 else c for c in f" {(text or '').lower()} ")
    return Counter(text[i : i + n] for n in toxicity.SIZES for i in range(len(text) - n + 1))


def corpus(seed=4, n=240):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 6)))
    rows = []
    for i in range(n):
        words = [word() for _ in range(rng.choice([5, 30, 120]))]
        toxic = i % 4 == 0
        if toxic:
            for _ in range(2):
                words.insert(rng.randrange(len(words)), rng.choice(["ZULKOX", "zulkoxer"]))
        rows.append((i, "\n".join(words) if i % 5 else " ".join(words), None, None, int(toxic)))
    return rows


def test_toxicity_by_brute_force(spark):
    rows = corpus()
    docs = frame(spark, [r[:4] for r in rows] + [(8001, None, None, None), (8002, "", "en", "a")])
    labels = spark.createDataFrame([(i, y) for i, *_, y in rows if i % 3] + [(None, 1), (7000, 1), (3, None)], "doc_id long, toxic int")
    known = [r for r in rows if r[0] % 3]
    fitted = toxicity.train(docs, labels, grams=300)
    # ratios and choice of grams
    toxic, clean = Counter(), Counter()
    for _, t, _, _, y in known:
        (toxic if y else clean).update(grams(t).keys())
    many = sum(y for *_, y in known)
    ratio = {g: math.log((k + 1) / (many + 2)) - math.log((clean[g] + 1) / (len(known) - many + 2)) for g, k in toxic.items() if k >= 5}
    clear = {g: abs(r) / math.sqrt(1 / (toxic[g] + 1) + 1 / (clean[g] + 1)) for g, r in ratio.items()}

    edge = sorted(clear.values(), reverse=True)[299]
    weights = {}
    for g in ratio:
        points = np.frombuffer(g.encode("utf-32-le"), np.uint32)
        h = {n: int(x[0]) for n, x in toxicity.gram_hashes(np.concatenate([points, np.zeros(8, np.uint32)]))}[len(g)]
        at = np.searchsorted(fitted.hashes, np.uint64(h))
        if at < len(fitted.hashes) and fitted.hashes[at] == h:
            weights[g] = fitted.weights[at]
            assert clear[g] >= edge - 1e-12
        else:
            assert clear[g] <= edge + 1e-12
    assert len(weights) == 300
    got = {(r.doc_id, r.score, r.predicted) for r in toxicity.score(docs, fitted).collect()}
    scores = {i: s for i, s, _ in got}
    for i, t, *_ in rows:
        margin = fitted.bias + sum(math.log1p(k) * weights.get(g, 0.0) for g, k in grams(t).items())
        assert scores[i] == pytest.approx(1 / (1 + math.exp(-margin)), abs=1e-9)
    assert all(p == (s >= 0.7) for _, s, p in got)
    held = [(scores[i], y) for i, *_, y in rows if i % 3 == 0]
    assert min(s for s, y in held if y) > max(s for s, y in held if not y)
    again = toxicity.train(docs.repartition(7), labels.repartition(3), grams=300)
    assert (again.hashes == fitted.hashes).all() and again.weights == pytest.approx(fitted.weights) and again.bias == pytest.approx(fitted.bias)


def test_toxicity_of_odd_rows(spark):
    docs = frame(spark, ODD)
    none = spark.createDataFrame([], "doc_id long, toxic int")
    fitted = toxicity.train(docs, none)
    got = toxicity.score(docs, fitted).collect()
    assert len(got) == len(ODD) and all(r.score < 1e-6 and r.predicted == 0 for r in got)
    assert toxicity.score(frame(spark, []), fitted).count() == 0
    one_class = toxicity.train(docs, spark.createDataFrame([(2, 1), (3, 1)], "doc_id long, toxic int"))
    assert all(r.score > 0.99 for r in toxicity.score(docs, one_class).collect())


def test_descent_reaches_the_minimum():
    a = np.diag([1.0, 10.0, 100.0]) + 0.5
    b = np.array([1.0, -2.0, 3.0])
    x = toxicity.minimise(lambda v: (0.5 * v @ a @ v - b @ v, a @ v - b), np.zeros(3), 100)
    assert x == pytest.approx(np.linalg.solve(a, b), abs=1e-3)


def test_held_out_toxicity(spark):
    folder = "/root/testdata/sf0.01"
    label = dict(duckdb.sql(f"SELECT doc_id, toxic FROM '{folder}/labels.parquet'").fetchall())
    held = [r for r in QUERIES["op12_toxicity"](spark, folder).collect() if r.held_out and r.doc_id in label]
    assert sum(r.predicted == label[r.doc_id] for r in held) >= 0.93 * len(held) > 50
    assert sum(r.predicted and not label[r.doc_id] for r in held) <= 0.02 * len(held)


# ----------------------------------------------------------- mixing and stages


def test_repeated_rows_lose_no_words(spark):
    rng = random.Random(9)
    rows = [(1, "w " * 100, None, "a")] * 5 + [(i, "v " * rng.randrange(1, 200), None, rng.choice("abcd")) for i in range(40) for _ in range(rng.choice([1, 1, 3]))]
    rows += [(None, "x y z", None, None)] * 400
    docs = frame(spark, rows)
    mixed = mixing.mix(docs)
    got = mixing.realised(docs, mixed)
    assert got.columns == docs.columns
    took, words = Counter(), Counter()
    for r in mixed.collect():
        took[r.doc_id, r.source, r.size] += r.taken
        assert 0 <= r.taken <= 3 * r.size
    whole = {(i, s, len((t or "").split())) for i, t, _, s in rows}
    sizes = {(i, s): n for i, s, n in whole if sum(k[:2] == (i, s) for k in whole) == 1}
    for r in got.collect():
        words[r.doc_id, r.source] += len(r.text.split())
    for (i, s), n in sizes.items():
        assert words[i, s] == took[i, s, n]
    assert sum(words.values()) == sum(took.values())
    assert len(mixed.collect()) == len(rows)
    assert sorted(map(str, mixed.collect())) == sorted(map(str, mixing.mix(docs.repartition(7)).collect()))


CLASH = "_doc string, _id string, _from string, _crc string, _t string, _words string, _text string, _kept string, kept string, rest string, doc string, row string, of_id string, taken string, number string"


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
@pytest.mark.parametrize("kind", ["odd", "empty", "repeated"])
def test_stages_on_odd_rows(spark, data, name, stage, kind):
    docs = spark.read.parquet(f"{data}/documents.parquet").limit(40)
    if kind == "odd":
        docs = docs.unionByName(spark.createDataFrame([(i, t, lang, s, 1) for i, t, lang, s in ODD], "doc_id long, text string, lang string, source string, n_chars long").select(*docs.columns))
    elif kind == "empty":
        docs = docs.where("false")
    else:
        docs = docs.unionAll(docs).unionAll(docs)
    extra = [c.split()[0] for c in CLASH.split(", ")]
    from pyspark.sql import functions as F

    docs = docs.select("*", *[F.lit(f"{c} stays").alias(c) for c in extra])
    got = stage(spark, docs, data)
    rows = got.collect()
    if name != "packing":
        assert got.columns == docs.columns and all(r[c] == f"{c} stays" for r in rows for c in extra)
        assert len(rows) <= 3 * docs.count()
    assert rows or kind == "empty"


def test_digest_of_runs(spark, data):
    got = {r.doc_id: r for r in QUERIES["op13_periodic_runs"](spark, data).collect()}
    empty = hashlib.sha256(b"").hexdigest()
    assert all(r.runs_sha256 != empty and r.start is not None for r in got.values() if r.n_runs)
    assert all(r.runs_sha256 == empty and r.start is None for r in got.values() if not r.n_runs)


# ------------------------------------------------------------------------ top k


@pytest.mark.parametrize("sizes", [[1.0], [1e16], [1.0, 1e8, 1e16], [1e300, 1e-300, 3.0], [2.0**45, 2.0**44]])
def test_top_k_of_large_components(spark, sizes):
    from riskgrid.llm import voronoi
    from pyspark.sql import functions as F

    rng = np.random.default_rng(len(sizes))
    rows = [(i, [float(x) for x in rng.normal(size=6) * rng.choice(sizes)]) for i in range(150)]
    rows += [(i, rows[i - 150][1]) for i in range(150, 160)] + [(200, [0.0] * 6), (201, [float("inf")] * 6)]
    got = {}
    for r in voronoi.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 10 == 0).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.id, r.score))
    whole = {i: [math.floor(256 * x) if abs(256 * x) < 2**53 else int(256 * x) for x in v] for i, v in rows if all(map(math.isfinite, v))}
    for i in whole:
        if i % 10 == 0:
            score = lambda j: min(max(sum(a * b for a, b in zip(whole[i], whole[j])), -(2**63)), 2**63 - 1)
            best = sorted((-score(j), j) for j in whole if j != i)[:5]
            assert sorted(got[i]) == [(k + 1, j, -s) for k, (s, j) in enumerate(best)]
    assert set(got) == {i for i in whole if i % 10 == 0}
