"""Each operator on small rows: nulls, empties, ties, repeats, clashing columns, and brute force."""

import hashlib
import random
import sys
import time
import tracemalloc
import zlib
from collections import Counter
from fractions import Fraction
from pathlib import Path
from urllib.parse import urlparse

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from riskgrid.llm import feistel, language, mixing, packing, pigeonhole, quality, suffixes, substrings, toccurrence, voronoi
from riskgrid.llm.queries import tokenizer_path
from riskgrid.llm.shared import components
from riskgrid.session import cut_lineage, ensure_checkpoint_dir, release

DOCS = "doc_id long, text string, lang string, source string, n_chars long, _block long, size string, word string"


def frame(spark, rows):
    """Documents with columns whose names clash with what the operators add."""
    return spark.createDataFrame([(i, t, lang, s, None, 7, "x", None) for i, t, lang, s in rows], DOCS)


def roots(nodes, links):
    label = {n: n for n in nodes}

    def find(n):
        while label[n] != n:
            n = label[n]
        return n

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        label[b] = a
    return {n: find(n) for n in nodes}


ODD = [(1, None, None, None), (2, "", "en", "a"), (3, "ab c", "en", None), (3, "ab c", "en", None), (4, "\n \t", None, "b"), (5, "é" * 60, "fr", "a"), (None, "no id", "en", "a")]


def test_components_of_chains_and_stars(spark):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(100, 160)] + [(5, rng.randrange(200, 400)) for _ in range(150)] + [(rng.randrange(1000), rng.randrange(1000)) for _ in range(300)] + [(7, 7)]
    want = roots({n for e in edges for n in e}, edges)
    got = {r[0]: r[1] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: c for n, c in want.items() if any(n in e for e in edges if e[0] != e[1])}


def test_finished_shuffles_and_released_rows_leave_the_disk(spark):
    ensure_checkpoint_dir(spark)
    start = files_of(spark)
    rows = cut_lineage(spark.range(200_000).groupBy((F.xxhash64("id") % 100_003).alias("k")).agg(F.max("id").alias("m")))
    shuffled, stored = settled(spark, start, 0)
    assert shuffled == 0 < stored and rows.count() == rows.agg(F.sum(F.lit(1))).first()[0]
    release(rows)
    assert on_disk(spark, start)[1] == 0


def test_near_duplicates_leave_little_on_disk(spark):
    rng = random.Random(5)
    words = [f"w{i:x}q{i * 7919 % 99991}" for i in range(5000)]
    texts = [" ".join(rng.choices(words, k=300)) for _ in range(800)]
    rows = [(i, t, "en", "a") for i, t in enumerate(texts)] + [(1000 + i, t + " end", "en", "a") for i, t in enumerate(texts[:400])]
    docs = frame(spark, rows).cache()
    size = sum(len(t) for _, t, *_ in rows)
    ensure_checkpoint_dir(spark)
    start = files_of(spark)
    found = toccurrence.similar_sets(docs)
    shuffled, stored = settled(spark, start, size // 4)
    assert shuffled < size // 4 and stored < size // 4, (shuffled, stored, size)
    assert found.where("doc <> component").count() == 400
    docs.unpersist()


@pytest.mark.parametrize("n", [0, 1, 2, 9, 500])
def test_sharding(spark, n):
    rows = [(i if i % 7 else None, f"t{i % 5}" if i % 3 else None, None, None) for i in range(n)]
    got = feistel.shard(frame(spark, rows), shards=8).collect()
    assert len(got) == n and {r.law for r in got} <= {"rows"}
    by = Counter(r.shard for r in got)
    assert not n or max(by.get(k, 0) for k in range(8)) - min(by.get(k, 0) for k in range(8)) <= 1
    for k, count in by.items():
        assert sorted(r.slot for r in got if r.shard == k) == list(range(count))
    assert Counter(r.size for r in got) == Counter(len((t or "").encode()) + 1 for _, t, _, _ in rows)
    assert Counter(r.text_crc32 for r in got) == Counter(zlib.crc32((t or "").encode()) for _, t, _, _ in rows)
    assert sorted(map(str, got)) == sorted(map(str, feistel.shard(frame(spark, rows[::-1]), shards=8).collect()))


@pytest.mark.parametrize("n", [1, 2, 3, 10, 1000, 4097])
def test_permutation_and_its_inverse(spark, n):
    df = spark.range(n).withColumn("p", feistel.permuted(F.col("id"), n)).withColumn("b", feistel.permuted(F.col("p"), n, back=True))
    got = df.collect()
    assert sorted(r.p for r in got) == list(range(n)) and all(r.b == r.id for r in got)
    assert n < 10 or sum(r.p == r.id for r in got) < n / 2


def test_seats_are_dealt_to_the_highest_quotients():
    rng = random.Random(2)
    for _ in range(50):
        votes = [Fraction(rng.randrange(0, 50)) for _ in range(rng.randrange(1, 7))]
        most, house = [rng.randrange(0, 20) for _ in votes], rng.randrange(0, 40)
        got = [0] * len(votes)
        for _ in range(house):
            free = [i for i in range(len(votes)) if got[i] < most[i] and votes[i]]
            if free:
                got[max(free, key=lambda i: (votes[i] / (2 * got[i] + 1), -i))] += 1
        assert mixing.seats(votes, house, most) == got


def test_targets_stop_at_the_cap():
    got = mixing.targets({"a": 10, "b": 100, None: 50, "c": 0}, [5, 2, 1], 3)
    assert got["a"] == 30 and got["c"] == 0 and sum(got.values()) == 160
    assert got["b"] / 2 == got[None] / 5  # weights 5, 2, 1, 5 by order a, b, c, null


def test_mixing(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(["w"] * rng.randrange(0, 300)), None, rng.choice(["a", "a", "b", "Ä", None])) for i in range(400)] + ODD
    got = mixing.mix(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    assert Counter((r.doc_id, r.size) for r in got) == Counter((i, len((t or "").encode().split())) for i, t, _, _ in rows)
    for source in {r.source for r in got}:
        own = [r for r in got if r.source == source]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 64 and all(0 <= r.taken <= 3 * r.size for r in own)
        # a row takes whole passes and a part of one more
        assert all(r.passes * r.size <= r.taken <= (r.passes + 1) * r.size for r in own)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(frame(spark, rows[::-1])).collect()))
    docs = frame(spark, [r for r in rows if r[0] is not None and r[0] > 9])
    out = mixing.realised(docs, mixed := mixing.mix(docs))
    assert out.columns == docs.columns
    words = Counter()
    for r in out.collect():
        words[r.doc_id] += len(r.text.split())
    assert words == Counter({r.doc_id: r.taken for r in mixed.collect() if r.taken})


def test_mixed_rows_are_the_chosen_blocks(spark):
    rng = random.Random(8)
    rows = [(i, " ".join(f"d{i}w{k}" for k in range(rng.choice([1, 20, 90, 400, 5000]))), None, rng.choice("abcd")) for i in range(160)]
    rows += [(3, "same id", None, "a"), (3, "same id, other text", None, "b")]
    docs, text = frame(spark, rows), {(i, s, zlib.crc32(t.encode())): t.split() for i, t, _, s in rows}
    mixed = mixing.mix(docs).collect()
    got = Counter(w for r in mixing.realised(docs, mixing.mix(docs)).collect() for w in r.text.split())
    want, plan = Counter(), mixing.quotas({s: sum(len(t.split()) for _, t, _, x in rows if x == s) for s in "abcd"}, [5, 2, 1], 32, 3, 8)
    for source in "abcd":
        own = sorted((r for r in mixed if r.source == source), key=lambda r: (r.place, r.size))
        stream = [w for r in own for w in text[r.doc_id, r.source, r.text_crc32]]
        places = [r.place for r in own]
        assert places == [sum(r.size for r in own[:k]) for k in range(len(own))]
        passes = own[0].passes
        left = sum(r.taken for r in own) - passes * len(stream)
        assert abs(left - sum(plan[source][1]) * 32 + passes * len(stream)) <= 64
        for w in stream * passes + stream[:left]:
            want[w] += 1
        # at most one document of a source is cut
        assert sum(r.size > 0 and r.taken % r.size > 0 for r in own) <= 1
    assert got == want


def test_sources_below_one_block(spark):
    sizes = {"a": 10, "b": 20, "c": 5, "d": 1000}
    rows = [(i, " ".join(["w"] * n), None, s) for i, (s, n) in enumerate(sizes.items())]
    got = {r.source: r for r in mixing.mix(frame(spark, rows)).collect()}
    assert {s: r.taken for s, r in got.items() if s != "d"} == {"a": 30, "b": 60, "c": 15} and abs(got["d"].taken - got["d"].target) <= 32
    assert all(len(r.quotas) == 8 and sum(r.quotas) == r.quota for r in got.values())
    assert [r.taken for r in mixing.mix(frame(spark, [(1, "five words in all here", None, "a")])).collect()] == [5]


def test_mixing_of_nothing(spark):
    assert mixing.mix(frame(spark, [])).count() == 0


def test_packing_keeps_every_id(spark):
    from tokenizers import Tokenizer

    rng = random.Random(4)
    words = ["don't", "THE", "naïve", "x1", "<|endoftext|>", "ﬁ", "éa", "ΑΣ", "a.b,c!", "日本", " y", "l'été's"] + ["".join(rng.choices("abcdefgh", k=5)) for _ in range(50)]
    rows = [(i, " ".join(rng.choices(words, k=rng.choice([0, 1, 30, 400, 3000]))), None, None) for i in range(60)] + ODD
    got = packing.pack(frame(spark, rows), tokenizer_path()).collect()
    whole = Tokenizer.from_file(tokenizer_path())
    want = Counter()
    for i, text, _, _ in rows:
        ids = np.array([*whole.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        for a in range(0, len(ids), 2048):
            want[i, a, len(ids[a : a + 2048]), zlib.crc32(ids[a : a + 2048].tobytes()), len(ids)] += 1
    assert Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got) == want
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert sorted(sequences) == list(range(len(sequences)))
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 2048
    assert sum(r.length for r in got) / (2048 * len(sequences)) > 0.88
    assert packing.pack(frame(spark, []), tokenizer_path()).count() == 0


def test_column_generation_against_the_bound():
    rng = np.random.default_rng(5)
    for n in (1, 7, 300):
        demand = np.bincount(rng.integers(1, 129, n), minlength=129)
        plan = packing.patterns(demand, 128)
        assert all(sum(w * k for w, k in p.items()) <= 128 for p, _ in plan)
        used = np.zeros_like(demand)
        for p, bins in plan:
            for w, k in p.items():
                used[w] += k * bins
        assert (used == demand).all()
        assert sum(b for _, b in plan) <= np.ceil((demand * np.arange(129)).sum() / 128) * 1.1 + 2


def test_language(spark):
    rows = [(i, t, lang, "s") for i, (t, lang) in enumerate([("the cat and the dog", "en"), ("der Hund und die Katze", "de"), ("le chat et le chien", "fr")] * 4)]
    model = language.learn(frame(spark, [*rows, (50, None, "en", "s"), (51, "word", None, "s")]))
    new = frame(spark, [(1, "the dogs", None, None), (2, "Katzen und Hunde", None, None), (3, "chienne", None, None), (4, None, None, None), (5, "12 !! \n", None, None), (6, "", None, None), (7, "日本", None, None), (8, "the " * 30000, None, None), (1, "the dogs", None, None)])
    got = sorted(language.identify(new, model).collect())
    assert [r.lang_pred for r in got] == ["en", "en", "de", "fr", "und", "und", "und", got[7].lang_pred, "en"]
    assert got[7].lang_pred in ("en", "de", "fr") and all(0 <= r.score <= 1 for r in got)
    nothing = language.learn(frame(spark, []))
    assert {r.lang_pred for r in language.identify(new, nothing).collect()} == {"und"}
    assert language.identify(frame(spark, []), model).count() == 0


def test_every_counted_word_and_gram_is_kept(spark, monkeypatch):
    """A large language doesn't push a small one out; scores as by plain counting, with few frequent words shipped."""
    rng = random.Random(12)
    word = lambda letters, k: "".join(rng.choices(letters, k=k))
    large, small = [word("abcdefgh", 6) for _ in range(3000)], [word("efghijkl", 6) for _ in range(300)]
    rows = [(i, " ".join(rng.choices(large, k=200)), "big", None) for i in range(300)] + [(1000 + i, " ".join(rng.choices(small, k=30)), "tiny", None) for i in range(40)]
    new = [(i, " ".join([*rng.choices(small, k=2), *rng.choices(large, k=2), word("efgh", 5), word("ghijz", 4), "日本"]), None, None) for i in range(80)] + [(90, "日", None, None), (90, "日", None, None)]
    counts = [{} for _ in range(6)]
    for (lang, w), n in Counter((lang, w) for _, t, lang, _ in rows for w in t.split()).items():
        framed = f"_{w}_"
        for size, g in [(0, w)] * (n >= 2) + [(k, framed[a : a + k]) for k in range(1, 6) for a in range(len(framed) - k + 1)]:
            counts[size].setdefault(g, Counter())[lang] += n
    langs, scores = ["big", "tiny"], []
    for by in counts:
        whole = [1 + sum(c[lang] for c in by.values()) for lang in langs]
        scores.append({g: tuple(np.log(t) - np.log(c[lang] or 0.5) for lang, t in zip(langs, whole)) for g, c in by.items()})
    plain = language.LanguageModel(langs, "big", scores)
    frequent = language._frequent
    model = language.learn(frame(spark, rows))
    assert model.entries == plain.entries and model.usual == "big"
    for room in (0, 700, 10**6):
        monkeypatch.setattr(language, "_frequent", lambda table, _: frequent(table, room))
        assert len(frequent(model.table, room)[0]) <= room
        got = sorted(language.identify(frame(spark, new), model).collect())
        assert len(got) == len(new)
        for r, (i, text, _, _) in zip(got, sorted(new)):
            found = [s for w in text.split() if (s := plain.of(w)) is not None]
            big, tiny = map(sum, zip(*found)) if found else (0.0, 0.0)
            assert r.doc_id == i and r.lang_pred == ("big" if big <= tiny else "tiny")
            assert r.score == pytest.approx(1 / (1 + np.exp(-abs(big - tiny))), abs=1e-4)


def test_language_keeps_little_on_disk(spark, monkeypatch):
    """Counts and texts' rare words are stored once each, even with nothing cleaned up; words are scored as one by one."""
    rng = random.Random(31)
    word = lambda letters: "".join(rng.choices(letters, k=rng.randrange(8, 12)))
    some = {lang: [word(letters) for _ in range(400)] for lang, letters in (("x", "abcdefgh"), ("y", "efghijkl"))}
    rows = [(i, " ".join(rng.choice(some[lang]) if rng.random() < 0.5 else word("abcdefghijkl") for _ in range(250)), lang, None) for i in range(200) for lang in some]
    kept, store, frequent = [], language.cut_lineage, language._frequent

    def stored(df):
        kept.append(store(df))
        return kept[-1]

    ensure_checkpoint_dir(spark)
    folder = Path(urlparse(spark.sparkContext.getCheckpointDir()).path)
    before = set(folder.rglob("part-*"))
    monkeypatch.setattr(language, "cut_lineage", stored)
    monkeypatch.setattr(language, "_frequent", lambda table, _: frequent(table, 100))
    docs = frame(spark, rows)
    model = language.learn(docs.where("doc_id % 5 <> 0"))
    assert language.identify(docs, model).where("lang_pred = 'und'").count() == 0
    on_disk = sum(f.stat().st_size for f in set(folder.rglob("part-*")) - before)
    # mostly n-grams, of which random words have more than any language
    assert on_disk < 4 * sum(len(text) for _, text, _, _ in rows) and len(kept) == 2

    plain = language.LanguageModel(model.langs, model.usual, [{} for _ in range(6)])
    for r in model.table.collect():
        plain.scores[r.size][r.gram] = (r.s0, r.s1)
    words = ["a", "l", "é", "日本", "az", "zz", "zzzz", "zzzzl", "abc", "abcdefgh" * 9, *some["x"][:5], *[word("abcdefghijklz") for _ in range(60)]]
    want = {w: s for w in words if (s := plain.of(w)) is not None}
    for entries in (model.entries, [10**9] * 6):  # n-grams broadcast, and shuffled
        model.entries = entries
        got = language._rest_scores(spark.createDataFrame([(w,) for w in words], "word string"), model.table, model).collect()
        assert len(got) == len(want) and all((r.s0, r.s1) == pytest.approx(want[r.word], abs=2e-6) for r in got)


def test_backoff_uses_the_longest_known_grams():
    model = language.LanguageModel(["x", "y"], "x", [{"word": (1.0, 2.0)}, {"w": (3.0, 4.0), "_": (9.0, 9.0)}, {"_w": (5.0, 6.0), "wo": (7.0, 8.0)}])
    assert model.of("word") == (1.0, 2.0) and model.of("wo") == (6.0, 7.0) and model.of("aw") == pytest.approx((7.0, 22 / 3)) and model.of("日") == (9.0, 9.0)


def test_quality(spark):
    rng = random.Random(6)
    good = lambda: " ".join("".join(rng.choices("abcdeino", k=rng.randrange(2, 8))) for _ in range(40)) + "."
    rows = [(i, good() if i % 2 else good().upper().replace(" ", "!! "), None, "s") for i in range(120)] + ODD
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(80)] + [(81, None, 1), (None, 1, 1), (3, 1, 0)], "doc_id long, quality int, toxic int")
    docs = frame(spark, rows)
    machine = quality.train(docs, labels, steps=200)
    got = [r for r in quality.score(docs, machine).collect()]
    assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert all(r.predicted == r.doc_id % 2 for r in got if r.doc_id is not None and 80 <= r.doc_id < 120)
    kept = quality.accepted(docs, machine)
    assert kept.columns == docs.columns and sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(r.doc_id) for r in got if r.predicted)
    none = quality.train(docs, labels.limit(0))
    assert {(r.score, r.predicted) for r in quality.score(docs, none, metadata=("source", "lang")).collect()} == {(0.5, 1)}
    assert quality.score(frame(spark, []), machine).count() == 0


def test_pair_terms_by_the_square_identity():
    machine = quality.Machine()
    machine.w[:3] = [0.5, -1, 2]
    feature, value = np.array([0, 1, 2]), np.array([1.0, 0.5, 2.0], np.float32)
    want = sum(machine.w[i] * value[i] for i in range(3)) + sum(machine.v[i] @ machine.v[j] * value[i] * value[j] for i in range(3) for j in range(i))
    assert machine.margins(np.array([0]), feature, value)[0][0] == pytest.approx(want, rel=1e-5)


def vectors(n, seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, 16))
    rows = [(i, (centres[rng.integers(12)] + rng.normal(size=16) * rng.choice([0.01, 0.1, 0.12, 1])).astype(np.float32).tolist(), int(rng.integers(3)), "x", 1) for i in range(n)]
    rows += [(1000 + i, rows[5][1], rows[5][2], None, 1) for i in range(40)] + [(2000, [2 * x for x in rows[5][1]], rows[5][2], None, 1)]
    odd = [None, [], [0.0] * 16, [float("nan")] * 16, [1.0, None] * 8, [float("inf")] * 16, [1.0] * 3]
    rows += [(3000 + 50 * i, v, 1, None, None) for i, v in enumerate(odd)] + [(4000, rows[5][1], None, None, None), (None, rows[5][1], 1, None, None), (7, *rows[7][1:])]
    return rows


VECTORS = "vec_id long, embedding array<float>, label int, cell string, id long"


def sound(v):
    return v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v)


@pytest.mark.parametrize("per_task", [4096, 20])
def test_embedding_links(spark, monkeypatch, per_task):
    monkeypatch.setattr(pigeonhole, "PER_TASK", per_task)
    rows = vectors(300 if per_task > 100 else 130, 7)
    got = {r.vec_id: r for r in pigeonhole.near_duplicates(spark.createDataFrame(rows, VECTORS), width=4).collect()}
    ids = {r[0]: r for r in rows if r[0] is not None}
    use = [r for r in ids.values() if r[2] is not None and sound(r[1]) and any(r[1])]
    links = []
    for i, a in enumerate(use):
        for b in use[:i]:
            if a[2] == b[2] and len(a[1]) == len(b[1]):
                x, y = np.array(a[1], float), np.array(b[1], float)
                if x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.98:
                    links.append((a[0], b[0]))
    want, count = roots(ids, links), Counter(n for pair in links for n in pair)
    assert len(links) > 300 and set(got) == set(ids)
    assert all((got[i].n_links, got[i].component_id, got[i].kept) == (count[i], want[i], want[i] == i) for i in ids)
    assert pigeonhole.near_duplicates(spark.createDataFrame([], VECTORS)).count() == 0


def files_of(spark):
    """The session's shuffle files and the files of its checkpoint folder."""
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n").split("\n")
    return {Path(f) for f in files if "/shuffle_" in f}, set(Path(spark.sparkContext.getCheckpointDir().removeprefix("file:")).rglob("part-*"))


def on_disk(spark, start):
    """Bytes of those files that are not among ``start``."""
    return tuple(sum(f.stat().st_size for f in now - old if f.exists()) for now, old in zip(files_of(spark), start))


def settled(spark, start, most):
    """The same; Spark deletes files a little later."""
    for _ in range(40):
        now = on_disk(spark, start)
        if now[0] <= most:
            break
        time.sleep(0.25)
    return now


def test_embedding_disk(spark, monkeypatch):
    rng = np.random.default_rng(3)
    n, size = 4000, 64
    rows = [(i, v.tolist(), i % 4, "x", 1) for i, v in enumerate(rng.normal(size=(n, size)).astype(np.float32))]
    rows += [(n + i, rows[i][1][:-1] + [rows[i][1][-1] + 0.01], i % 4, "x", 1) for i in range(100)]
    data = spark.createDataFrame(rows, VECTORS)
    ensure_checkpoint_dir(spark)
    start, peak, cut = files_of(spark), [0], pigeonhole.cut_lineage

    def watched(df):
        done = cut(df)
        peak[0] = max(peak[0], sum(on_disk(spark, start)))
        return done

    monkeypatch.setattr(pigeonhole, "cut_lineage", watched)
    got = pigeonhole.near_duplicates(data).collect()
    assert sum(not r.kept for r in got) == 100 and sum(r.n_links for r in got) == 200
    assert 0 < peak[0] < 4 * 4 * n * size


@pytest.mark.parametrize("size", [2048, 5])
def test_top_k(spark, monkeypatch, size):
    monkeypatch.setattr(voronoi, "QUERIES_PER_CELL", size)
    monkeypatch.setattr(voronoi, "DATA_PER_CELL", 40 * size)
    rows = vectors(300 if size > 100 else 110, 8)
    got = voronoi.top_k(spark.createDataFrame(rows, VECTORS), F.col("vec_id") % 10 == 0, pivots=7).collect()
    ids = {r[0]: np.floor(256 * np.array(r[1], float)).astype(int) for r in rows if r[0] is not None and sound(r[1])}
    want = []
    for q, v in ids.items():
        if q % 10 == 0:
            scored = sorted((-int(v @ w), i) for i, w in ids.items() if i != q and len(w) == len(v))[:5]
            want += [(q, k, i, -s) for k, (s, i) in enumerate(scored, 1)]
    assert sorted(map(tuple, got)) == sorted(want)
    assert voronoi.top_k(spark.createDataFrame([], VECTORS), F.lit(True)).count() == 0


def variants(seed, n=160, vocabulary=400):
    """Texts with exact copies, edits, shared passages, short texts and repeated lines."""
    rng = random.Random(seed)
    word = lambda: rng.choice(pool)
    pool = ["".join(rng.choices("abcdefghijklmnop", k=rng.randrange(1, 9))) for _ in range(vocabulary)] + ["é", "Straße", "日本", "A.", "X"]
    passages = [[word() for _ in range(rng.randrange(20, 60))] for _ in range(4)]
    texts = []
    for i in range(n):
        kind = rng.randrange(6)
        base = list(rng.choice(texts)) if texts and kind < 3 else [word() for _ in range(rng.choice([0, 1, 2, 3, 12, 80, 150]))]
        if kind == 1 and base:
            for _ in range(rng.choice([1, 1, 2, 6])):
                base[rng.randrange(len(base))] = word()
        if kind == 2 or kind == 5:
            at = rng.randrange(len(base) + 1)
            base[at:at] = rng.choice(passages)
        if kind == 3:
            base = base + ["for", "For"] * rng.choice([3, 60])
        texts.append(base)
    return [(i, rng.choice([" ", "\n", "\t "]).join(t), None, None) for i, t in enumerate(texts)]


@pytest.mark.parametrize("length,percent,small", [(3, 90, False), (5, 80, True), (2, 60, True)])
def test_similar_sets(spark, monkeypatch, length, percent, small):
    if small:
        monkeypatch.setattr(toccurrence, "SETS", 8)
        monkeypatch.setattr(toccurrence, "LOAD", 500)
        monkeypatch.setattr(toccurrence, "LONG", 3)
    rows = variants(9) + [(1000, None, None, None), (1001, "", None, None), (1002, "A b", None, None), (1003, "a  B", None, None), (1004, "a", None, None), (None, "a", None, None), (5, variants(9)[5][1], None, None)]
    sets = {}
    for i, text, _, _ in rows:
        words = (text or "").encode().lower().split()
        if i is not None:
            sets[i] = {tuple(words[k : k + length]) for k in range(max(1, len(words) - length + 1))} if words else set()
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    want = roots(sets, links)
    got = {r.doc: (r.n_shingles, r.component) for r in toccurrence.similar_sets(frame(spark, rows), length=length, percent=percent).collect()}
    assert sum(sets[a] != sets[b] for a, b in links) > 5
    assert got == {i: (len(sets[i]), want[i]) for i in sets}
    assert toccurrence.similar_sets(frame(spark, [])).count() == 0


@pytest.mark.parametrize("window,period,load", [(35, 21, 10**6), (10, 7, 500), (5, 3, 500)])
def test_repeated_windows(spark, window, period, load):
    rows = variants(10) + [(1000, None, None, None), (1001, "", None, None), (None, "a " * 80, None, None)]
    words = {i: (t or "").encode().split() for i, t, _, _ in rows}
    count = Counter(tuple(w[k : k + window]) for i, w in words.items() for k in range(len(w) - window + 1) if i is not None)
    got = {r.doc: (r.n_words, r.n_removed, r.kept_sha256, r.kept) for r in substrings.drop_repeated_windows(frame(spark, rows), window=window, period=period).collect()}
    for i, w in words.items():
        gone = set()
        for k in range(len(w) - window + 1):
            if i is not None and count[tuple(w[k : k + window])] > 1:
                gone |= set(range(k, k + window))
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        assert got[i] == (len(w), len(gone), hashlib.sha256(kept).hexdigest(), kept), i
    assert len(got) == len(words) and substrings.drop_repeated_windows(frame(spark, [])).count() == 0


def test_difference_covers_cover():
    for period, cover in substrings.COVERS.items():
        assert {(a - b) % period for a in cover for b in cover} == set(range(period))


@pytest.mark.parametrize("window,gram,frequent", [(100, 32, False), (40, 16, False), (40, 16, True), (24, 8, True)])
def test_suffix_dedup(spark, monkeypatch, window, gram, frequent):
    if frequent:
        monkeypatch.setattr(suffixes, "TOGETHER", 2)
        monkeypatch.setattr(suffixes, "LOAD", 3000)
    rows = variants(11, 120, 60) + [(1000, None, None, None), (1001, "", None, None), (1002, "x" * 500, None, None), (1003, "xy" * 300, None, None), (None, "x" * 500, None, None)]
    random.Random(1).shuffle(rows)
    seen, want = set(), {}
    for i, text, _, _ in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        data, gone = (text or "").encode(), set()
        for k in range(len(data) - window + 1):
            if (piece := data[k : k + window]) in seen:
                gone |= set(range(k, k + window))
            seen.add(piece)
        kept = bytes(x for k, x in enumerate(data) if k not in gone)
        want[i] = (len(data), kept, sum(k - 1 not in gone for k in gone))
    got = {r.doc: (r.n_bytes, bytes(r.kept), len(r.spans)) for r in suffixes.drop_repeats(frame(spark, rows), window=window, gram=gram).collect()}
    assert got.pop(None) == (500, b"x" * 500, 0) and sum(n for _, _, n in want.values()) > 30
    assert got == want
    assert suffixes.drop_repeats(frame(spark, [])).count() == 0


def test_prefix_intervals():
    assert list(suffixes.intervals([2, 5, 5, 1, 3], 2)) == [(1, 3, 5), (0, 3, 2), (4, 5, 3)]
    assert list(suffixes.intervals([], 1)) == [] and list(suffixes.intervals([4, 4], 4)) == [(0, 2, 4)]


def test_packing_plan_stops_once_bins_are_full(monkeypatch):
    # the bound of bins without a gap shows that nothing is left to gain, so no prices are asked for
    demand = np.zeros(13, int)
    demand[[1, 2, 3, 4, 6, 12]] = 24, 12, 8, 9, 4, 5
    monkeypatch.setattr(np, "argmin", lambda x: pytest.fail("another round"))
    plan = packing.patterns(demand, 12)
    assert sum(bins for _, bins in plan) == demand @ np.arange(13) // 12
    used = np.zeros_like(demand)
    for p, bins in plan:
        for w, k in p.items():
            used[w] += k * bins
    assert (used == demand).all()


def test_words_kept_by_packing_go_when_another_operator_runs():
    process = lambda: sys.modules.get("_riskgrid_llm_process")
    schema = pa.schema([("doc_id", pa.int64()), *[(c, pa.int64()) for c in ("start", "length", "ids_crc32", "doc_tokens")]])
    for other in (
        lambda: list(quality._featurise(iter([pa.record_batch({"label": [1], "text": [b"a few words"]})]))),
        lambda: list(toccurrence._spread(5, 80, 64)(iter([pa.record_batch({"doc": [1], "text": [b"a few words"]})]))),
        lambda: list(toccurrence._sets(5)(iter([]))),
        lambda: list(suffixes._anchors(100, 32)(iter([]))),
        lambda: list(mixing._cut(iter([]))),
    ):
        list(packing._cut(tokenizer_path(), 2048, 1, schema)(iter([pa.record_batch({"doc_id": [1], "text": [b"a few words"]})])))
        assert process() is not None
        other()
        assert process() is None


def test_a_batch_is_not_held_as_python_texts():
    """Batches of the pipeline's stages have tens of MB of text; only a slice of them is Python objects at a time."""
    texts = pa.array([b"x%d " % i + b"x" * 300_000 for i in range(100)])
    ids = pa.array(range(100))
    shared = type("Shared", (), {"value": quality.Machine()})
    for run, columns in (
        (lambda batches: quality._featurise(batches), [ids, texts]),
        (lambda batches: (x for b in batches for x in quality._scores(shared)(b.column(1), [])), [ids, texts]),
        (toccurrence._spread(5, 80, 64), [ids, texts]),
        (toccurrence._sets(5), [ids, texts, ids, ids, ids]),
    ):
        batch = pa.RecordBatch.from_arrays(columns, names=list("abcde")[: len(columns)])
        tracemalloc.start()
        try:
            for _ in run(iter([batch])):
                pass
            most = tracemalloc.get_traced_memory()[1]
        finally:
            tracemalloc.stop()
        assert most < 24_000_000, (run, most)


def test_accepted_sends_a_text_once_and_plans_start_no_python_workers(spark):
    docs = frame(spark, [(1, "a few words", None, "s"), (2, None, None, None)])
    machine = quality.Machine()
    sent = quality.accepted(docs, machine, metadata=("source",))._jdf.queryExecution().analyzed().children().apply(0)
    assert sent.output().size() == len(docs.columns) + 1
    for frame_, name in ((mixing.mix(docs), "of"), (packing.pack(docs, tokenizer_path()), "_w")):
        assert f"LogicalRDD [{name}#" not in frame_._jdf.queryExecution().analyzed().toString()


def test_packing_takes_no_step_per_word_form():
    """Forms of a word that differ in capitals and closing signs cost no Python call each, nor does a text's every word."""
    from tokenizers import Tokenizer

    rng = random.Random(8)
    signs = [a + b + c for a in ("", "!", "(") for b in ("", "-", "}") for c in ("", ",", "~", "_")]
    forms = [f + s for stem in ("straße", "packing", "naïve", "þing") for f in {"".join(rng.choice([x, x if x == "ß" else x.upper()]) for x in stem) for _ in range(60)} for s in signs]
    odd = ["\u212aelvin", "İx", "a×b", "÷", "don't", "...", "x\x00y", "a\x1cb", "\u00a0", "  \t", "日本,", "ﬁ", "Ÿ", "ẞ!"]
    texts = [" ".join(forms), "", "  ", *odd, " ".join(rng.choices(forms + odd, k=20_000)), "\x85 a\u2003b"]
    rows = pa.record_batch({"doc_id": list(range(len(texts))), "text": [t.encode() for t in texts]})
    schema = pa.schema([("doc_id", pa.int64()), *[(c, pa.int64()) for c in ("start", "length", "ids_crc32", "doc_tokens")]])
    cut = packing._cut(tokenizer_path(), 2048, 1, schema)
    list(cut(iter([rows.slice(1, 2)])))  # reads the vocabulary
    calls = Counter()
    sys.setprofile(lambda frame, event, _: calls.update([event]))
    try:
        got = list(cut(iter([rows])))
    finally:
        sys.setprofile(None)
    packing.forget()
    assert calls["call"] + calls["c_call"] < len(set(forms)) / 2
    whole, want = Tokenizer.from_file(tokenizer_path()), []
    for i, text in enumerate(texts):
        ids = np.array([*whole.encode(text, add_special_tokens=False).ids, 1], "<u4")
        want += [(i, a, len(ids[a : a + 2048]), zlib.crc32(ids[a : a + 2048].tobytes()), len(ids)) for a in range(0, len(ids), 2048)]
    assert [tuple(r.values()) for b in got for r in b.to_pylist()] == want


def test_language_takes_no_step_per_word_or_gram():
    """Forms of a word, words and n-grams cost no Python call each; counts and sums as by plain counting."""
    rng = random.Random(9)
    stems = ["".join(rng.choices("abcdeßéö", k=9)) for _ in range(300)]
    forms = [f + s for stem in stems for f in (stem, stem.capitalize(), stem.upper() if "ß" not in stem else stem) for s in ("", ",", ".)", "1", "_")]
    odd = ["don't", "\u212aelvin", "İx", "a×b", "x²", "ª", "12", "...", "日本,", "ΑΣ", "a\x1cb", "\u00a0c", "_", "ẞ", "x\x00y"]
    texts = ["", " \t", " ".join(forms), *odd, " ".join(rng.choices(forms + odd, k=3000)), "é" * 300, "1 2"]
    langs = [rng.choice(["en", "de"]) for _ in texts]
    words = [[w for token in t.encode().split() for w in language.LETTERS.findall(token.decode().lower())] for t in texts]
    rows = pa.record_batch({"lang": langs, "text": [t.encode() for t in texts]})
    calls = Counter()

    def steps(run, *batches):
        calls.clear()
        sys.setprofile(lambda frame, event, _: calls.update([event]))
        try:
            list(run(iter(batches)))
        finally:
            sys.setprofile(None)
        return calls["call"] + calls["c_call"]

    def total(got, *keys):
        out = Counter()
        for r in got:
            out[tuple(r[c] for c in keys)] += r["n"]
        return out

    want = Counter((lang, w) for lang, ws in zip(langs, words) for w in ws)
    got = [r for b in language._words(iter([rows, rows.slice(0, 0)])) for r in b.to_pylist()]
    assert total(got, "lang", "word") == want and steps(language._words, rows) < len(forms) / 2

    table = pa.record_batch({"lang": [lang for lang, _ in want], "word": [w for _, w in want], "n": list(want.values())})
    grams = Counter()
    for (lang, w), n in want.items():
        framed = f"_{w}_"
        for size, g in [(0, w)] * (n >= 2) + [(k, framed[a : a + k]) for k in range(1, 6) for a in range(len(framed) - k + 1)]:
            grams[lang, size, g] += n
    got = [r for b in language._grams(5, 2)(iter([table])) for r in b.to_pylist()]
    assert total(got, "lang", "size", "gram") == grams and steps(language._grams(5, 2), table) < len(grams) / 2

    known = sorted({w for _, w in want})[::2]
    scores = np.rint(np.random.default_rng(3).random((len(known), 2)) * 1024) / 1024
    place = {w: i for i, w in enumerate(known)}
    docs = pa.record_batch({"id": list(range(len(texts))), "text": rows.column(1)})
    got = [r for b in language._known(known, scores)(iter([docs])) for r in b.to_pylist()]
    for r, text, ws in zip(got, texts, words, strict=True):
        found = [place[w] for w in ws if w in place]
        letters = sum(any(map(str.isalpha, token.decode())) for token in text.encode().split())
        assert r["sums"] == [*scores[found].sum(axis=0), len(found), letters]
        assert Counter({o["word"]: o["n"] for o in r["others"]}) == Counter(w for w in ws if w not in place)
    assert steps(language._known(known, scores), docs) < len(forms) / 2
