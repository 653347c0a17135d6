"""Phrase collocation mining: phrases grow best-first under score bounds until each language's best are settled."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window, functions as F

from riskgrid.llm.packing import slices
from riskgrid.llm.repeats import LOAD, mixed, runs
from riskgrid.llm.shared import ship, text_bytes
from riskgrid.session import cut_lineage

#: Scores are this many times the share of a phrase among the places of its two parts, halved.
SCALE = 2_000_000
#: Bytes to spaces, to lower case, and to the sign of a piece's end, which no lower-cased text has.
STOP = b"A"
FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t.,;:!?\n\v\f\r", b"abcdefghijklmnopqrstuvwxyz " + STOP * 10)
#: Bits of a filter of grams. A gram that passes by chance is counted in vain; the size is fixed.
FILTER_BITS = 1 << 26
REMEMBERED = 200_000
_ODD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)


class Words:
    """Words of texts as 64-bit hashes that depend on the language too; 0 ends a piece."""

    def __init__(self):
        self.number: dict[bytes, int] = {}
        self.hashes, self.texts, self.langs = np.zeros(1 << 12, np.uint64), [], {}

    def of(self, texts: list[bytes], langs: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of all words of the texts, one after the other: number, language (number) and hash. Texts end with a piece."""
        split = [(t.translate(FOLD) + STOP).replace(STOP, b" A ").split() for t in texts]
        for word in set().union(*split) - self.number.keys():
            k = self.number[word] = len(self.texts)
            self.texts.append(word)
            if k >= len(self.hashes):
                self.hashes = np.concatenate([self.hashes, np.zeros_like(self.hashes)])
            self.hashes[k] = 0 if word == STOP else xxhash.xxh64_intdigest(word) | 1
        lengths = np.fromiter(map(len, split), np.int64, len(split))
        at = np.fromiter(map(self.number.__getitem__, chain.from_iterable(split)), np.int64, int(lengths.sum()))
        for lang in set(langs) - self.langs.keys():
            self.langs[lang] = len(self.langs)
        lang = np.repeat(np.array([self.langs[x] for x in langs], np.int64), lengths)
        return at, lang, self.of_lang(at, lang)

    def of_lang(self, number: np.ndarray, lang: np.ndarray) -> np.ndarray:
        seeds = np.array([xxhash.xxh64_intdigest(x.encode(), seed=1) for x in self.langs], np.uint64)
        h = self.hashes[number]
        return np.where(h == 0, h, mixed(h ^ seeds[lang]) | np.uint64(1))

    def full(self) -> bool:
        return len(self.number) > REMEMBERED

    def forget(self) -> None:
        self.number, self.texts = {}, []


def gram_hash(words: list[np.ndarray]) -> np.ndarray:
    """One hash of several words in their order."""
    total = np.zeros(len(words[0]), np.uint64)
    for w, odd in zip(words, _ODD):
        total = mixed(total + w * np.uint64(odd))
    return total


def passes(bits: np.ndarray, words: list[np.ndarray]) -> np.ndarray:
    """Which grams are in a filter: all that were put in, and few others."""
    at = gram_hash(words) % np.uint64(FILTER_BITS)
    return (bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) == 1


def filter_of(grams: DataFrame, columns: list[str]) -> Broadcast:
    """A filter (one bit a gram) of a frame's grams (columns of word hashes); its size is fixed."""

    def run(batches):
        for batch in batches:
            at = gram_hash([c.to_numpy().view(np.uint64) for c in batch.columns]) % np.uint64(FILTER_BITS)
            yield pa.RecordBatch.from_pydict({"cell": pa.array((at >> np.uint64(6)).astype(np.int64)), "bit": pa.array((np.uint64(1) << (at & np.uint64(63))).view(np.int64))})

    cells = grams.select(*columns).mapInArrow(run, "cell long, bit long").groupBy("cell").agg(F.bit_or("bit").alias("bit")).toArrow()
    bits = np.zeros(FILTER_BITS // 64, np.uint64)
    bits[cells.column("cell").to_numpy()] = cells.column("bit").to_numpy().view(np.uint64)
    return grams.sparkSession.sparkContext.broadcast(bits)


def _combined(parts: Iterator[list[np.ndarray]], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Grams (one array per word) with their counts, summed over loads of a bounded size."""

    def told(held: list[list[np.ndarray]]) -> pa.RecordBatch:
        words = [np.concatenate(w) for w in zip(*held)]
        h = gram_hash(words)
        order = np.argsort(h, kind="stable")
        starts, counts = runs(h[order])
        first = order[starts]
        return pa.RecordBatch.from_arrays([*[pa.array(w[first].view(np.int64)) for w in words], pa.array(counts, pa.int64())], schema=schema)

    held, size = [], 0
    for part in parts:
        held.append(part)
        size += len(part[0])
        if size >= LOAD:
            yield told(held)
            held, size = [], 0
    if size:
        yield told(held)


def _gram_schema(n: int) -> pa.Schema:
    return pa.schema([*[(f"w{k}", pa.int64()) for k in range(n)], ("a", pa.int64())])


def _read(batches) -> Iterator[np.ndarray]:
    """Hashes of the words of slices of texts."""
    words = Words()
    for batch in batches:
        texts, langs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for a, b in slices(texts):
            if words.full():
                words.forget()
            yield words.of(texts[a:b], langs[a:b])[2]


WORD_COUNTS = pa.schema([("lang", pa.string()), ("word", pa.binary()), ("w", pa.int64()), ("f", pa.int64())])


def _count_words(batches):
    """Counts of words by language, summed as long as the words are remembered."""
    words, sums = Words(), {}

    def told():
        names = list(words.langs)
        for lang, counts in sums.items():
            at = np.flatnonzero(counts)
            at = at[words.hashes[at] != 0]
            h = words.of_lang(at, np.full(len(at), lang))
            yield pa.RecordBatch.from_arrays([pa.array([names[lang]] * len(at), pa.string()), pa.array([words.texts[k] for k in at], pa.binary()), pa.array(h.view(np.int64)), pa.array(counts[at], pa.int64())], schema=WORD_COUNTS)

    for batch in batches:
        texts, langs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        for a, b in slices(texts):
            if words.full():
                yield from told()
                sums.clear()
                words.forget()
            at, lang, _ = words.of(texts[a:b], langs[a:b])
            for k in np.unique(lang).tolist():
                counts = np.bincount(at[lang == k], minlength=len(words.texts))
                if k in sums:
                    counts[: len(sums[k])] += sums[k]
                sums[k] = counts
    yield from told()


def _count_pairs(frequent):
    """Counts of pairs of frequent words."""

    def run(batches):
        def pairs():
            for h in _read(batches):
                good = (h != 0) & passes(frequent.value, [h])
                at = np.flatnonzero(good[:-1] & good[1:])
                if len(at):
                    yield [h[at], h[at + 1]]

        yield from _combined(pairs(), _gram_schema(2))

    return run


def _stretches(pairs):
    """What is left of the texts: stretches of words that are frequent pairs throughout, each behind a 0."""

    def run(batches):
        for h in _read(batches):
            linked = np.zeros(len(h), bool)  # with the next word
            at = np.flatnonzero((h[:-1] != 0) & (h[1:] != 0))
            linked[at] = passes(pairs.value, [h[at], h[at + 1]])
            before = np.append(False, linked[:-1])
            # longer phrases need two links in a row
            twice = linked & (before | np.append(linked[1:], False))
            part = twice | np.append(False, twice[:-1])
            first = part & ~np.append(False, twice[:-1])
            stretched = np.insert(h[part], np.flatnonzero(first[part]), np.uint64(0))
            yield pa.RecordBatch.from_pydict({"words": pa.array([stretched.tobytes()], pa.binary())})

    return run


def _count_longer(n: int, heads, tails, settled: list[tuple]):
    """Counts of phrases of ``n`` words whose first words are a gram of ``heads`` or last words one of ``tails``.

    What an earlier round's filters have let pass has been counted there and is left out.
    """

    def run(batches):
        def grams():
            for batch in batches:
                for blob in batch.column(0).to_pylist():
                    h = np.frombuffer(blob, np.uint64)
                    if len(h) < n:
                        continue
                    good = np.ones(len(h) - n + 1, bool)
                    for k in range(n):
                        good &= h[k : len(h) - n + 1 + k] != 0
                    at = np.flatnonzero(good)
                    words = [h[at + k] for k in range(n)]
                    wanted = passes(heads.value, words[:-1]) | passes(tails.value, words[1:])
                    for head, tail in settled:
                        wanted &= ~(passes(head.value, words[:-1]) | passes(tail.value, words[1:]))
                    if wanted.any():
                        yield [w[wanted] for w in words]

        yield from _combined(grams(), _gram_schema(n))

    return run


def _counted(rows: DataFrame, n: int, count, least: int) -> DataFrame:
    names = [f"w{k}" for k in range(n)]
    kinds = ", ".join(f"{x} long" for x in names)
    return rows.mapInArrow(count, f"{kinds}, a long").groupBy(*names).agg(F.sum("a").alias("a")).where(F.col("a") >= least)


def _bound(word_count: str) -> Column:
    """The best score that a phrase can have which takes up ``a`` places at most and starts (or ends) with a word."""
    return F.expr(f"cast({SCALE} * cast(a as decimal(20,0)) div ({word_count} + cast(a as decimal(20,0))) as long)")


def _scored(grams: DataFrame, cuts: list[tuple[str, str]]) -> DataFrame:
    """The lowest score of the cuts, exact for counts of up to 64 bits; of equal ones the first cut counts."""
    of = [F.struct(F.expr(f"cast({SCALE} * cast(a as decimal(20,0)) div (cast({x} as decimal(20,0)) + {y}) as long)").alias("score"), F.lit(k).alias("cut"), F.col(x).alias("l"), F.col(y).alias("r")) for k, (x, y) in enumerate(cuts)]
    return grams.withColumn("_low", F.array_min(F.array(*of))).withColumns({c: F.col(f"_low.{c}") for c in ("score", "l", "r")}).drop("_low")


def _grown(grams: DataFrame, parts: DataFrame, n: int) -> DataFrame:
    """Phrases of ``n`` words with their language and the counts of their first and last 1, 2, ... words.

    ``parts`` are the phrases one word shorter with the same facts; phrases of which a part isn't there are left out.
    """
    own = [f"w{k}" for k in range(n)]
    head = parts.select("lang", *[F.col(f"w{k}") for k in range(n - 1)], *[f"head{k}" for k in range(1, n - 1)], F.col("a").alias(f"head{n - 1}"))
    tail = parts.select(*[F.col(f"w{k}").alias(f"w{k + 1}") for k in range(n - 1)], *[f"tail{k}" for k in range(1, n - 1)], F.col("a").alias(f"tail{n - 1}"))
    both = grams.join(head, own[:-1]).join(tail, own[1:])
    both = both.select("lang", *own, "a", *[f"{side}{k}" for side in ("head", "tail") for k in range(1, n)])
    return _scored(both, [(f"head{k}", f"tail{n - k}") for k in range(1, n)]).withColumns({"head": _bound("head1"), "tail": _bound("tail1")})


def _surviving(grams: DataFrame, longer: DataFrame | None, n: int, cover: int) -> DataFrame:
    """Phrases that no phrase of one word more covers: it would cover them if a still longer one does."""
    own = [f"w{k}" for k in range(n)]
    if longer is not None:
        sides = longer.select(*own, "a").unionAll(longer.select(*[F.col(f"w{k + 1}").alias(f"w{k}") for k in range(n)], "a"))
        grams = grams.join(sides.groupBy(*own).agg(F.max("a").alias("_most")), own, "left")
        grams = grams.where(F.expr(f"_most is null or 100 * cast(_most as decimal(20,0)) < {cover} * cast(a as decimal(20,0))"))
    return grams.select("lang", "a", "l", "r", "score", F.array(*own).alias("words"))


def _ranked(found: DataFrame, words: DataFrame, limit: int, salts: int = 64) -> DataFrame:
    """Each language's first ``limit``, with their words. No task gets over ``salts * limit`` rows of a language."""
    salt = F.pmod(F.xxhash64("words"), F.lit(salts))
    best = Window.partitionBy("lang", salt).orderBy(F.desc("score"), F.desc("a"))
    some = found.withColumn("_at", F.rank().over(best)).where(F.col("_at") <= limit).drop("_at")
    spelled = some.select("*", F.posexplode("words").alias("_k", "w")).join(words.select("w", F.col("word").cast("string").alias("_word")), "w")
    spelled = spelled.groupBy("lang", "words").agg(*[F.first(c).alias(c) for c in ("a", "l", "r", "score")], F.array_join(F.sort_array(F.collect_list(F.struct("_k", "_word")))["_word"], " ").alias("phrase"))
    order = [F.desc("score"), F.desc("a"), "phrase"]
    few = spelled.withColumn("_at", F.row_number().over(Window.partitionBy("lang", salt).orderBy(*order))).where(F.col("_at") <= limit)
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")
    return few.withColumn("rank", rank).where(F.col("rank") <= limit).drop("_at", "words")


def phrases(docs: DataFrame, text_column: str = "text", lang_column: str = "lang", least: int = 30, limit: int = 2000, cover: int = 80, batch: int = 8000) -> DataFrame:
    """Each language's ``limit`` best phrases of 2 to 4 words.

    Texts are lower-cased (A-Z), cut into pieces at ``.,;:!?`` and line ends, and pieces into words at spaces and tabs. A
    phrase's count a is the number of its places within pieces, overlaps included; from ``least`` on it is a candidate. A
    cut of it into two parts with counts l and r scores floor(2000000 a / (l + r)); the lowest counts (of equal ones
    the earliest cut). A candidate goes if a longer one around it has at least ``cover`` percent of its count. Order: score
    and count falling, then the phrase's bytes.

    Growth is best-first, in rounds of about ``batch``, then four times as many prefixes a language. All pairs of words that
    occur ``least`` times are counted; from then on a prefix of count a whose first word has count f can't grow to a phrase
    of a better score than floor(2000000 a / (f + a)) - any such phrase is cut behind its first word too, and neither
    its count nor its rest's falls out of that bound. The same holds for endings, which have the parts behind a cut and the
    phrases that cover a candidate from the left. A round counts the longer phrases of all prefixes and endings whose
    bound reaches the round's level, so every score from that level up and whether it survives is known in full. A language is
    settled when ``limit`` phrases survive at or above the level, or nothing is left to grow. The rounds read the stretches
    of the texts that consist of counted pairs only.

    Returns lang, rank, phrase, a, l, r, n (words of the language), score. A null language is ``und``, together with
    rows that have it; a null or empty text has no words; repeated rows count as often as they occur; an empty table
    gives no rows; other columns are ignored. Words are told apart by 64-bit hashes. To the driver go filters of a fixed
    size and histograms of bounds per language.
    """
    spark = docs.sparkSession
    rows = docs.select(text_bytes(text_column).alias("text"), F.coalesce(F.col(lang_column).cast("string"), F.lit("und")).alias("lang"))
    counted = cut_lineage(rows.mapInArrow(_count_words, "lang string, word binary, w long, f long").groupBy("lang", "word").agg(F.first("w").alias("w"), F.sum("f").alias("f")))
    words = counted.where(F.col("f") >= least)
    pairs = _counted(rows, 2, _count_pairs(filter_of(words, ["w"])), least)
    pairs = pairs.join(words.select("lang", F.col("w").alias("w0"), F.col("f").alias("head1")), "w0").join(words.select(F.col("w").alias("w1"), F.col("f").alias("tail1")), "w1")
    two = cut_lineage(_scored(pairs, [("head1", "tail1")]).withColumns({"head": _bound("head1"), "tail": _bound("tail1")}))
    texts = cut_lineage(rows.mapInArrow(_stretches(filter_of(two, ["w0", "w1"])), "words binary"))

    bands: dict[str, list[tuple[int, int]]] = {}
    band = F.expr("greatest(head, tail) div 1000").alias("band")
    for lang, at, many in sorted(two.groupBy("lang", band).agg(F.count(F.lit(1)).alias("many")).collect(), reverse=True):
        bands.setdefault(lang, []).append((at * 1000, many))
    level = {lang: SCALE for lang in bands}
    open_, kept, settled = set(bands), None, {3: [], 4: []}
    three = four = four_counts = None
    while open_:
        for lang in open_:
            level[lang] = _reach(bands[lang], batch)
        batch *= 4
        levels = spark.createDataFrame(sorted(level.items()), "lang string, level long")

        def new(n: int, parts: DataFrame) -> DataFrame:
            reached = parts.join(levels, "lang")
            names = [f"w{k}" for k in range(n - 1)]
            heads, tails = (filter_of(reached.where(F.col(side) >= F.col("level")), names) for side in ("head", "tail"))
            grams = _counted(texts, n, _count_longer(n, heads, tails, list(settled[n])), least)
            settled[n].append((heads, tails))
            return cut_lineage(grams)

        fresh = new(3, two)
        grown = cut_lineage(_grown(fresh, two, 3))
        three = grown if three is None else three.unionAll(grown)
        fresh = new(4, three)
        four_counts = fresh if four_counts is None else four_counts.unionAll(fresh)
        four = _grown(four_counts, three, 4)
        all_ = _surviving(two, three, 2, cover).unionAll(_surviving(three, four_counts, 3, cover)).unionAll(_surviving(four, None, 4, cover))
        kept = cut_lineage(all_.join(levels, "lang").where(F.col("score") >= F.col("level")).drop("level"))
        many = {r[0]: r[1] for r in kept.groupBy("lang").count().collect()}
        open_ = {lang for lang in open_ if level[lang] > 0 and many.get(lang, 0) < limit}
    if kept is None:
        return spark.createDataFrame([], "lang string, rank long, phrase string, a long, l long, r long, n long, score long")
    totals = counted.groupBy("lang").agg(F.sum("f").alias("n"))
    return _ranked(kept, words, limit).join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def _reach(bands: list[tuple[int, int]], batch: int) -> int:
    """The bound down to which about ``batch`` prefixes and endings are grown; 0 for all."""
    total = 0
    for low, many in bands[:-1]:
        total += many
        if total >= batch:
            return low
    return 0


ship(__name__)
