"""Language identification: known words first, then ever shorter character n-grams."""

from __future__ import annotations

import re
from functools import reduce
from itertools import chain
from math import log
from operator import add

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from riskgrid.llm.packing import runs_of, spans
from riskgrid.llm.shared import ship
from riskgrid.session import cut_lineage

#: A run of letters; and the entries a task gathers before it hands them on (bounds memory only).
LETTERS, GATHERED = re.compile(r"[^\W\d_]+"), 500_000
#: A token with a single run, of Latin letters whose lower case is plain, between ASCII signs and digits; and bytes of text or words cut at a time.
PLAIN, TEXT, CUT = r"^[!-@\[-`{-~]*(?P<letters>[A-Za-zÀ-ÖØ-öø-ÿ]+)[!-@\[-`{-~]*$", 4_000_000, 500_000


class _Tokens:
    """White-space tokens of some texts: ``counts`` by text, ``index`` of each, and of the distinct ones whether they have a
    letter, and the ``sizes`` and ``values`` of their lower-case letter runs, as places in ``words``."""

    def __init__(self, texts: pa.Array):
        split = pc.ascii_split_whitespace(texts.cast(pa.large_binary()).view(pa.large_string()))
        tokens = split.flatten().dictionary_encode()
        self.counts, self.index = pc.list_value_length(split).to_numpy(), tokens.indices.to_numpy()
        found = pc.extract_regex(tokens.dictionary, PLAIN)
        plain = found.is_valid().to_numpy(zero_copy_only=False)
        others = [token.decode("utf-8", "replace").lower() for token in tokens.dictionary.filter(found.is_null()).view(pa.large_binary()).to_pylist()]
        runs = [LETTERS.findall(token) for token in others]
        words = pa.concat_arrays([pc.utf8_lower(found.drop_null().field("letters")), pa.array(list(chain.from_iterable(runs)), pa.large_string())]).dictionary_encode()
        self.words, self.lettered, self.sizes = words.dictionary, plain.copy(), plain.astype(int)
        self.lettered[~plain] = [any(map(str.isalpha, token)) for token in others]
        self.sizes[~plain] = [len(r) for r in runs]
        owner = np.concatenate([np.flatnonzero(plain), np.repeat(np.flatnonzero(~plain), self.sizes[~plain])])
        self.values = words.indices.to_numpy()[np.argsort(owner, kind="stable")]


def _totals(a: np.ndarray, b: np.ndarray, bound: int, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs of ``a`` and ``b`` (below ``bound``) in order, and the sum of ``n`` (1) of each."""
    keys, at = np.unique(a.astype(np.int64) * max(bound, 1) + b, return_inverse=True)
    return *divmod(keys, max(bound, 1)), np.bincount(at, n, len(keys)).astype(np.int64)


def _summed(tables, keys: list[str]):
    """Rows of the tables with ``n`` summed by ``keys``, handed on whenever ``GATHERED`` different ones have come."""
    held, rows = [], 0
    for table in chain(tables, [None]):
        if table is not None:
            held.append(table)
            rows += table.num_rows
        if held and (table is None or rows > 2 * GATHERED):
            one = pa.concat_tables(held).group_by(keys, use_threads=False).aggregate([("n", "sum")]).rename_columns({"n_sum": "n"}).select([*keys, "n"])
            held, rows = [one], one.num_rows
            if table is None or rows > GATHERED:
                # rows that differ little from the one before take less disk
                yield from one.sort_by([(k, "ascending") for k in (*keys[:-1], "n", keys[-1])]).to_batches(max_chunksize=65_536)
                held, rows = [], 0


def _words(batches):
    """Counts of lower-case letter runs by language, summed per task."""

    def counted():
        for batch in batches:
            langs, texts = batch.column(0).dictionary_encode(), batch.column(1)
            for a, b in spans(pc.binary_length(texts).to_pylist(), TEXT):
                tokens = _Tokens(texts.slice(a, b - a))
                lang, token, n = _totals(np.repeat(langs.indices.to_numpy()[a:b], tokens.counts), tokens.index, len(tokens.sizes))
                more = tokens.sizes[token]
                lang, word, n = _totals(np.repeat(lang, more), runs_of(tokens.values, tokens.sizes, token), len(tokens.words), np.repeat(n, more))
                yield pa.table({"lang": langs.dictionary.take(pa.array(lang)).cast(pa.string()), "word": tokens.words.take(pa.array(word)).cast(pa.string()), "n": n})

    yield from _summed(counted(), ["lang", "word"])


def _grams(longest: int, least: int):
    """Counts of words (size 0) that come ``least`` times, and of n-grams of framed words, summed per task."""

    def counted(batches):
        for batch in batches:
            langs, words, n = batch.column(0).dictionary_encode(), batch.column(1), batch.column(2).to_numpy()
            names, codes = langs.dictionary.cast(pa.string()), langs.indices.to_numpy()

            def table(lang, size, grams, n):
                return pa.table({"lang": names.take(pa.array(lang)), "size": pa.array(np.full(len(n), size, np.int32)), "gram": grams.cast(pa.string()), "n": pa.array(n, pa.int64())})

            kept = np.flatnonzero(n >= least)
            yield table(codes[kept], 0, words.take(pa.array(kept)), n[kept])
            for a, b in spans(pc.binary_length(words).to_pylist(), CUT):
                edge, none = pa.scalar("_", pa.large_string()), pa.scalar("", pa.large_string())
                framed = pc.binary_join_element_wise(edge, words.slice(a, b - a).cast(pa.large_string()), edge, none)
                ends = np.cumsum(pc.binary_length(framed).to_numpy())
                data = np.frombuffer(b"".join(framed.view(pa.large_binary()).to_pylist()), np.uint8)
                begins = np.flatnonzero((data & 0xC0) != 0x80)  # of letters
                owner, stops = np.searchsorted(ends, begins, "right"), np.append(begins, len(data))
                for size in range(1, longest + 1):
                    at = np.flatnonzero(owner[: max(len(owner) - size + 1, 0)] == owner[size - 1 :])
                    lengths = stops[at + size] - stops[at]
                    letters = data[np.repeat(stops[at] - np.cumsum(lengths) + lengths, lengths) + np.arange(lengths.sum())]
                    grams = pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(np.append(0, np.cumsum(lengths))), pa.py_buffer(letters)).dictionary_encode()
                    lang, gram, total = _totals(codes[a:b][owner[at]], grams.indices.to_numpy(), len(grams.dictionary), n[a:b][owner[at]])
                    yield table(lang, size, grams.dictionary.take(pa.array(gram)), total)

    return lambda batches: _summed(counted(batches), ["lang", "size", "gram"])


class LanguageModel:
    """Negative log frequencies by language of known words (size 0) and of character n-grams (sizes 1 to longest).

    ``scores`` holds them by size; a learned model has them all in ``table`` (size, gram, seen, s0, s1, ...) instead, and
    in ``entries`` their number by size.
    """

    def __init__(self, langs: list[str], usual: str | None, scores: list[dict[str, tuple[float, ...]]], table: DataFrame | None = None, entries: list[int] | None = None):
        self.langs, self.usual, self.scores, self.table = langs, usual, scores, table
        self.entries = [len(s) for s in scores] if entries is None else entries

    def of(self, word: str) -> tuple[float, ...] | None:
        """Score per language (lower is likelier) by ``scores``: the word's own, or the mean of its longest known n-grams."""
        if (own := self.scores[0].get(word)) is not None:
            return own
        framed = f"_{word}_"
        for size in range(len(self.scores) - 1, 0, -1):
            known = self.scores[size]
            found = [s for k in range(len(framed) - size + 1) if (s := known.get(framed[k : k + size])) is not None]
            if found:
                return tuple(map(lambda *x: sum(x) / len(found), *found))
        return None

    def rows(self, spark: SparkSession) -> DataFrame:
        if self.table is not None:
            return self.table
        kinds = ", ".join(["size int, gram string, seen long", *[f"s{i} double" for i in range(len(self.langs))]])
        return spark.createDataFrame([(size, g, 1, *map(float, s)) for size, known in enumerate(self.scores) for g, s in known.items()], kinds)


def _grid(column: Column) -> Column:
    """To a multiple of 2^-20, so that sums do not depend on their order."""
    return F.rint(column * (1 << 20)) / (1 << 20)


def learn(docs: DataFrame, text_column: str = "text", lang_column: str = "lang", longest: int = 5, least: int = 2) -> LanguageModel:
    """Count words and n-grams by language over all rows with a text and a language.

    All documents are counted, on the executors, and the model keeps every word that a language has ``least`` times and
    every n-gram, as a table of one row each. Only the totals of each language come to the driver.
    """
    rows = docs.where(F.col(text_column).isNotNull() & F.col(lang_column).isNotNull()).select(F.col(lang_column).cast("string").alias("lang"), F.col(text_column).cast("binary"))
    spoken = docs.where(F.col(lang_column).isNotNull()).select(F.col(lang_column).cast("string").alias("lang")).distinct()
    spoken = sorted(r.lang for r in spoken.collect())
    if not spoken:
        return LanguageModel([], None, [{}])
    words = rows.mapInArrow(_words, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    grams = words.mapInArrow(_grams(longest, least), "lang string, size int, gram string, n long")
    # only these counts are stored; scores follow from them and the totals
    counts = cut_lineage(grams.groupBy("size", "gram").agg(*[F.sum(F.when(F.col("lang") == lang, F.col("n"))).alias(f"n{i}") for i, lang in enumerate(spoken)]))
    sums = counts.groupBy("size").agg(F.count(F.lit(1)).alias("n"), *[F.sum(f"n{i}").alias(f"n{i}") for i in range(len(spoken))]).collect()
    totals = {(lang, r.size): n for r in sums for i, lang in enumerate(spoken) if (n := r[f"n{i}"])}
    held = {r.size: r.n for r in sums}
    langs = sorted({lang for lang, _ in totals})
    if not langs:
        return LanguageModel([], None, [{}])

    def score(lang: str) -> Column:
        whole = F.array(*[F.lit(log(totals.get((lang, size), 0) + 1)) for size in range(longest + 1)])
        # a gram that a language lacks counts as seen half a time
        return _grid(F.get(whole, F.col("size")) - F.log(F.coalesce(F.col(f"n{spoken.index(lang)}").cast("double"), F.lit(0.5))))

    seen = reduce(add, [F.coalesce(f"n{spoken.index(lang)}", F.lit(0)) for lang in langs])
    table = counts.select("size", "gram", seen.alias("seen"), *[score(lang).alias(f"s{i}") for i, lang in enumerate(langs)])
    usual = max(langs, key=lambda lang: (totals.get((lang, 1), 0), lang))
    return LanguageModel(langs, usual, [], table, [held.get(size, 0) for size in range(longest + 1)])


def _frequent(table: DataFrame, room: int) -> tuple[list[str], np.ndarray]:
    """About the ``room`` most frequent words, never more, and their scores; which they are changes no result."""
    words = table.where("size = 0").withColumn("_level", 64 * F.floor(16 * F.log2("seen")) + F.pmod(F.xxhash64("gram"), F.lit(64)))
    lowest = None
    for level, n in sorted(map(tuple, words.groupBy("_level").count().collect()), reverse=True):
        room -= n
        if room < 0:
            break
        lowest = level
    names = [c for c in table.columns if c not in ("size", "gram", "seen")]
    if lowest is None:
        return [], np.zeros((0, len(names)))
    kept = words.where(F.col("_level") >= lowest).select("gram", *names).toArrow()
    return kept.column(0).to_pylist(), np.column_stack([kept.column(c).to_numpy() for c in names])


def _rest_scores(words: DataFrame, table: DataFrame, model: LanguageModel) -> DataFrame:
    """Scores of each of the distinct ``words``: its own, or the mean of its longest known n-grams; without any it goes.

    Words stay where the first join puts them; n-grams of a word that has its scores are no longer looked up.
    """
    names = [f"s{i}" for i in range(len(model.langs))]
    out = words.join(table.where("size = 0").select(F.col("gram").alias("word"), *names), "word", "left")
    framed = F.concat(F.lit("_"), F.col("word"), F.lit("_"))
    for size in range(len(model.entries) - 1, 0, -1):
        places = F.sequence(F.lit(1), F.greatest(F.length(framed) - size + 1, F.lit(1)))
        pieces = F.transform(places, lambda k: F.substring(framed, k, F.lit(size)))
        # what isn't looked up stands as a string of another length, which no n-gram equals and which differs by word
        pieces = F.when(F.col(names[0]).isNull(), pieces).otherwise(F.array(F.concat(framed, F.lit("_" * size))))
        known = table.where(F.col("size") == size).select("gram", *[F.col(c).alias(f"_{c}") for c in names])
        # a bounded side only
        known = F.broadcast(known) if model.entries[size] * (len(names) + 2) <= 2_000_000 else known
        found = F.nullif(F.count(f"_{names[0]}"), F.lit(0))
        means = [F.coalesce(F.max(c), _grid(F.sum(f"_{c}") / found)).alias(c) for c in names]
        out = out.withColumn("gram", F.explode(pieces)).join(known, "gram", "left").groupBy("word").agg(*means)
    return out.where(F.col(names[0]).isNotNull())


def _known(words: list[str], scores: np.ndarray):
    """Sums over a row's words that are in ``words``; the others, with their counts, are handed on."""
    width, listed = scores.shape[1], pa.array(words, pa.large_string())

    def run(batches):
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for a, b in spans(pc.binary_length(texts).to_pylist(), TEXT):
                tokens = _Tokens(texts.slice(a, b - a))
                place = pc.index_in(tokens.words, value_set=listed).fill_null(-1).to_numpy()[tokens.values]
                owner, hit = np.repeat(np.arange(len(tokens.sizes)), tokens.sizes), place >= 0
                vectors = np.zeros((len(tokens.sizes), width + 2))  # scores, scored words, has a letter
                for i in range(width):
                    vectors[:, i] = np.bincount(owner[hit], scores[place[hit], i], len(vectors))
                vectors[:, width] = np.bincount(owner[hit], minlength=len(vectors))
                vectors[:, -1] = tokens.lettered
                sums, full = np.zeros((b - a, width + 2)), tokens.counts > 0
                if full.any():
                    sums[full] = np.add.reduceat(vectors[tokens.index], (np.cumsum(tokens.counts) - tokens.counts)[full])
                left = np.bincount(owner[~hit], minlength=len(vectors))
                row = np.repeat(np.repeat(np.arange(b - a), tokens.counts), left[tokens.index])
                row, word, n = _totals(row, runs_of(tokens.values[~hit], left, tokens.index), len(tokens.words))
                others = pa.StructArray.from_arrays([tokens.words.take(pa.array(word)).cast(pa.string()), pa.array(n)], ["word", "n"])
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(a, b - a),
                        pa.ListArray.from_arrays(pa.array(np.arange(b - a + 1) * (width + 2), pa.int32()), pa.array(sums.ravel())),
                        pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(b - a + 1)), pa.int32()), others),
                    ],
                    names=["id", "sums", "others"],
                )

    return run


def _best(langs: list[str], usual: str | None, schema: pa.Schema):
    def run(batches):
        width = len(langs)
        for batch in batches:
            names, values = [], []
            for s in map(np.array, batch.column(1).to_pylist()):
                if not s[-1]:
                    names.append("und"), values.append(0.0)
                elif not s[width]:
                    names.append(usual or "und"), values.append(1 / width if width else 0.0)
                else:
                    best = int(s[:width].argmin())
                    names.append(langs[best]), values.append(float(1 / np.exp(np.clip(s[best] - s[:width], -700, 0)).sum()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(values, pa.float64())], schema=schema)

    return run


def identify(docs: DataFrame, model: LanguageModel, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Predict the language of every row: id, lang_pred, score (0 to 1, the share of the likelihood).

    A text without letters, or null, is ``und`` with score 0; letters of which no n-gram is known go to the most
    frequent language with an even score; ties to the first language by name. With nothing learned all rows are
    ``und``. Whole texts count; repeated rows and null ids are scored like others; an empty table gives no rows.
    The most frequent words are looked up in the tasks that read the texts; the rest, which are too many to ship, by
    joins with the model's table, each distinct word once.
    """
    spark, field, width = docs.sparkSession, docs.schema[id_column].dataType, len(model.langs)
    schema = pa.schema([(id_column, to_arrow_type(field)), ("lang_pred", pa.string()), ("score", pa.float64())])
    rows = docs.select(id_column, F.coalesce(F.col(text_column).cast("binary"), F.lit(b"")))
    table = model.rows(spark)
    shared = spark.sparkContext.broadcast(_frequent(table, min(200_000, 4_000_000 // max(width, 1))))

    def known(batches):
        yield from _known(*shared.value)(batches)

    begun = rows.mapInArrow(known, f"id {field.simpleString()}, sums array<double>, others array<struct<word:string,n:bigint>>")
    sums = F.col("sums")
    if width:
        # row numbers are stored, so they stay as they are; words, which have letters only, in a third of a struct's bytes
        begun = begun.select("id", "sums", F.array_join("others.word", " ").alias("words"), F.col("others.n").cast("array<int>").alias("counts"))
        begun = cut_lineage(begun.withColumn("row", F.monotonically_increasing_id()))
        others = begun.where("words <> ''").select("row", F.inline(F.arrays_zip(F.split("words", " "), "counts")).alias("word", "n"))
        scored = _rest_scores(others.select("word").distinct(), table, model)
        names = [f"s{i}" for i in range(width)]
        more = others.join(scored, "word").groupBy("row").agg(F.array(*[F.sum(F.col(c) * F.col("n")) for c in names], F.sum("n").cast("double"), F.lit(0.0)).alias("more"))
        begun = begun.select("id", "sums", "row").join(more, "row", "left")
        sums = F.when(F.col("more").isNull(), F.col("sums")).otherwise(F.zip_with("sums", "more", lambda x, y: x + y))
    langs, usual = model.langs, model.usual

    def best(batches):
        yield from _best(langs, usual, schema)(batches)

    return begun.select("id", sums.alias("sums")).mapInArrow(best, f"`{id_column}` {field.simpleString()}, lang_pred string, score double")


ship(__name__)
