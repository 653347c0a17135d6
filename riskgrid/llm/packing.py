"""Packing: cutting-stock column generation over the histogram of piece lengths."""

from __future__ import annotations

import os
import sys
import types
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from riskgrid.llm.shared import ranked, ship, text_bytes
from riskgrid.session import cut_lineage

#: Text handled and text encoded at a time, in bytes, and words remembered per process: they bound memory, none changes a result.
SLICE, ENCODED, REMEMBERED = 2_000_000, 4_000_000, 500_000


def per_process(key: tuple, make):
    """What ``make`` returns, once for each Python worker process, which runs many tasks."""
    held = sys.modules.setdefault("_riskgrid_llm_process", types.ModuleType("_riskgrid_llm_process")).__dict__
    return held[key] if key in held else held.setdefault(key, make())


def forget() -> None:
    """Let go of what ``per_process`` holds, so that a process doesn't keep it through the later stages of a pipeline.

    Arrow's pool keeps the buffers of earlier tasks too, until it is told to return them.
    """
    sys.modules.pop("_riskgrid_llm_process", None)
    pa.default_memory_pool().release_unused()


class WordIds:
    """Token ids of texts, word by word.

    The vocabulary's rules drop white space and never join across it, so a text's ids are its words' ids in a row. Each
    distinct word of a call is looked at once. Plain words (Latin letters, then ASCII signs, no apostrophe) are split into
    their lower-case letters and the signs, which the rules also keep apart, and go to the vocabulary's BPE model in bulk; all
    other words go through the whole tokenizer. Ids are remembered for letters, signs and other words.
    """

    PLAIN = r"^(?P<letters>[A-Za-zÀ-ÖØ-öø-ÿ]+)(?P<signs>[!-&(-/:-@\[-`{-~]*)$"

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.whole = Tokenizer.from_file(path)
        self.whole.no_padding()
        self.whole.no_truncation()
        self.bare = Tokenizer(self.whole.model)
        self.bare.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.ascii = Tokenizer(self.whole.model)  # the byte alphabet has printable ASCII as it is
        self.ascii.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        vocabulary = self.whole.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.parts: dict[bytes, bytes] = {b"": b""}

    def learn(self, plain: list[bytes], other: list[bytes]) -> None:
        if len(self.parts) > REMEMBERED:
            self.parts = {b"": b""}
        parts = self.parts
        for word in other:
            if word not in parts:
                parts[word] = np.array(self.whole.encode(word.decode("utf-8", "replace"), add_special_tokens=False).ids, "<u4").tobytes()
        new = [x for x in plain if x not in parts]
        for model, kind in ((self.ascii, [x for x in new if x.isascii()]), (self.bare, [x for x in new if not x.isascii()])):
            for at in range(0, len(kind), 2000):
                some = kind[at : at + 2000]
                lines = [b" ".join(some[k : k + 50]).decode() for k in range(0, len(some), 50)]
                ids = np.concatenate([np.array(e.ids, "<u4") for e in model.encode_batch_fast(lines, add_special_tokens=False)])
                stops = (np.flatnonzero(self.ends[ids]) + 1).tolist()
                if len(stops) != len(some):
                    raise ValueError("the vocabulary doesn't mark the ends of words")
                data, start = ids.tobytes(), 0
                for x, stop in zip(some, stops):
                    parts[x], start = data[4 * start : 4 * stop], stop

    def encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, ``end_id`` after each, and their number for each text."""
        split = pc.ascii_split_whitespace(texts.cast(pa.large_binary()).view(pa.large_string()))
        words = split.flatten().dictionary_encode()
        found = pc.extract_regex(words.dictionary, self.PLAIN)
        plain, other = found.drop_null(), words.dictionary.filter(found.is_null()).view(pa.large_binary())
        plain = pa.concat_arrays([pc.utf8_lower(plain.field("letters")), plain.field("signs")]).view(pa.large_binary()).dictionary_encode()
        plain_keys, other_keys = plain.dictionary.to_pylist(), other.to_pylist()
        self.learn(plain_keys, other_keys)
        # parts: none, the end, then those of plain words, then other words
        data = [b"", int(end_id).to_bytes(4, "little"), *map(self.parts.__getitem__, plain_keys), *map(self.parts.__getitem__, other_keys)]
        sizes = np.fromiter(map(len, data), int, len(data)) // 4
        # two parts of each distinct word, the end coming as one more word
        is_plain, pairs = found.is_valid().to_numpy(zero_copy_only=False), np.zeros((len(found) + 1, 2), int)
        pairs[:-1][is_plain] = plain.indices.to_numpy().reshape(2, -1).T + 2
        pairs[:-1, 0][~is_plain] = np.arange(len(other_keys)) + 2 + len(plain_keys)
        pairs[-1, 0] = 1
        ids = runs_of(np.frombuffer(b"".join(data), "<u4"), sizes, pairs.ravel())
        sizes = sizes[pairs].sum(axis=1)
        counts = pc.list_value_length(split).to_numpy()
        order = np.insert(words.indices.to_numpy(), np.cumsum(counts), len(found))
        return runs_of(ids, sizes, order), np.add.reduceat(sizes[order], np.cumsum(counts + 1) - counts - 1)


def runs_of(values: np.ndarray, sizes: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """``values`` are runs of ``sizes`` one after the other; those numbered ``chosen`` in a row."""
    starts, n = np.cumsum(sizes) - sizes, sizes[chosen]
    return values[np.repeat(starts[chosen] - np.cumsum(n) + n, n) + np.arange(n.sum())]


def slices(texts: list[bytes], most: int = SLICE):
    """Ranges of the list that hold about ``most`` bytes each."""
    return spans(list(map(len, texts)), most)


def sliced(texts: pa.Array, most: int = SLICE):
    """The ranges of ``slices``, each with its texts; only those of one range are Python objects at a time."""
    for a, b in spans(pc.binary_length(texts).to_pylist(), most):
        yield a, b, texts.slice(a, b - a).to_pylist()


def spans(sizes: list[int], most: int):
    """Ranges of the list that sum to about ``most`` each."""
    start, held = 0, 0
    for i, n in enumerate(sizes):
        held += n
        if held >= most:
            yield start, i + 1
            start, held = i + 1, 0
    if start < len(sizes):
        yield start, len(sizes)


def _cut(path: str, capacity: int, end_id: int, schema: pa.Schema):
    def run(batches):
        words = per_process(("WordIds", path), lambda: WordIds(path))
        for batch in batches:
            names, texts = batch.column(0), batch.column(1)
            for a, b in spans(pc.binary_length(texts).to_pylist(), ENCODED):
                ids, totals = words.encode(texts.slice(a, b - a), end_id)
                pieces = -(-totals // capacity)
                row = np.repeat(np.arange(b - a), pieces)
                start = capacity * (np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces))
                length = np.minimum(totals[row] - start, capacity)
                at = (np.cumsum(totals) - totals)[row] + start
                crc = [zlib.crc32(ids[x : x + n]) for x, n in zip(at.tolist(), length.tolist())]
                yield pa.RecordBatch.from_arrays([names.take(pa.array(a + row)), *[pa.array(x, pa.int64()) for x in (start, length, crc, totals[row])]], schema=schema)

    return run


def patterns(demand: np.ndarray, capacity: int, gap: float = 0.001, most: int = 20_000) -> list[tuple[dict[int, int], int]]:
    """Whole-number plan for ``demand[w]`` items of each width w in bins of ``capacity``: (items by width, bins).

    The linear program over patterns is solved by column generation: the simplex prices give each width a value, an
    unbounded knapsack finds the pattern of the highest value, and it enters the basis while it is worth more than one
    bin (or until a bound, the prices' or that of bins without any gap, shows less than ``gap`` to gain). Pattern counts
    are rounded down; what is left, less than one bin per pattern, is packed by best fit, largest first.
    """
    widths = np.flatnonzero(demand)
    if not len(widths):
        return []
    m, need = len(widths), demand[widths].astype(float)
    fit = capacity // widths
    inverse, value = np.diag(1.0 / fit), need / fit
    basis = [{int(w): int(k)} for w, k in zip(widths, fit)]
    cost = np.ones(m)
    enough = (1 + gap) * float(widths @ need) / capacity
    at = np.full(capacity + 1, -1)
    at[widths] = np.arange(m)
    for _ in range(most):
        if cost @ value <= enough:
            break
        prices = cost @ inverse
        worst = int(np.argmin(prices))
        if prices[worst] < -1e-9:
            column, new, new_cost = np.zeros(m), None, 0.0
            column[worst] = -1.0
        else:
            worth = np.full(capacity + 1, -1.0)
            worth[widths] = prices
            best, took = np.zeros(capacity + 1), np.zeros(capacity + 1, int)
            for c in range(1, capacity + 1):
                gains = best[c - 1 :: -1][:c] + worth[1 : c + 1]
                k = int(gains.argmax())
                if gains[k] > best[c - 1] + 1e-12:
                    best[c], took[c] = gains[k], k + 1
                else:
                    best[c] = best[c - 1]
            if best[capacity] <= 1 + gap:
                break
            new, c, column = {}, capacity, np.zeros(m)
            while c:
                if took[c]:
                    new[int(took[c])] = new.get(int(took[c]), 0) + 1
                    column[at[took[c]]] += 1
                    c -= took[c]
                else:
                    c -= 1
            new_cost = 1.0
        direction = inverse @ column
        grows = direction > 1e-9
        if not grows.any():
            break
        ratio = np.full(m, np.inf)
        ratio[grows] = value[grows] / direction[grows]
        out = int(ratio.argmin())
        pivot = inverse[out] / direction[out]
        step = ratio[out]
        inverse -= np.outer(direction, pivot)
        inverse[out] = pivot
        value = np.maximum(value - step * direction, 0)
        value[out], cost[out], basis[out] = step, new_cost, new
    left, plan = demand.astype(int).copy(), []
    for pattern, x in sorted(zip(basis, value), key=lambda p: -p[1]):
        if pattern:
            bins = min(int(x + 1e-6), *(left[w] // k for w, k in pattern.items()))
            if bins:
                plan.append((pattern, int(bins)))
                for w, k in pattern.items():
                    left[w] -= k * bins
    return plan + _best_fit(left, capacity)


def _best_fit(left: np.ndarray, capacity: int) -> list[tuple[dict[int, int], int]]:
    """One bin after the other: always the largest item left that still fits."""
    left, out = left.copy(), []
    while left.any():
        room, bin_ = capacity, {}
        while room and (fits := np.flatnonzero(left[: room + 1])).size:
            w = int(fits[-1])
            k = min(int(left[w]), room // w)
            bin_[w] = bin_.get(w, 0) + k
            left[w] -= k
            room -= k * w
        bins = 1 + min(int(left[w]) // k for w, k in bin_.items())
        for w, k in bin_.items():
            left[w] -= k * (bins - 1)
        out.append((bin_, bins))
    return out


def pack(docs: DataFrame, tokenizer: str, id_column: str = "doc_id", text_column: str = "text", capacity: int = 2048, end_id: int = 1, grid: int = 4) -> DataFrame:
    """Pack all rows into sequences of at most ``capacity`` tokens with little padding.

    A row's ids (from the vocabulary file ``tokenizer``, without special tokens, then ``end_id``) are cut every
    ``capacity`` tokens; only the last piece of a row is shorter. Piece lengths, rounded up to ``grid`` tokens, form a
    histogram of at most capacity/grid bins, the only thing that goes to the driver. ``patterns`` plans it; the pieces
    of a width are ranked over the whole table (no width meets in one task) and the plan's intervals of ranks give
    each its sequence. Sequences are to be padded to ``capacity``.

    Returns per piece: id, start, length, ids_crc32, doc_tokens, sequence_id (from 0 without gaps), offset. A null or
    empty text has the single token ``end_id``; long texts are encoded whole; a null id and repeated rows are packed
    like others; an empty table gives no rows; other columns are ignored.
    """
    kind = docs.schema[id_column].dataType.simpleString()
    name = F.col(id_column)
    from pyspark.sql.pandas.types import to_arrow_type

    schema = pa.schema([(id_column, to_arrow_type(docs.schema[id_column].dataType)), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64())])
    texts = docs.select(name, text_bytes(text_column).alias("_text"))
    pieces = texts.mapInArrow(_cut(tokenizer, capacity, end_id, schema), f"`{id_column}` {kind}, start long, length long, ids_crc32 long, doc_tokens long")
    pieces = cut_lineage(pieces.withColumn("_width", F.expr(f"cast((length + {grid - 1}) div {grid} as int)")))
    demand = np.zeros(capacity // grid + 1, int)
    for r in pieces.groupBy("_width").count().collect():
        demand[r[0]] = r[1]
    rows, sequence, given = [], 0, np.zeros_like(demand)
    for pattern, bins in patterns(demand, capacity // grid):
        for width, copies in sorted(pattern.items(), reverse=True):
            rows.append((width, int(given[width]), int(given[width] + copies * bins), bins, sequence))
            given[width] += copies * bins
        sequence += bins
    # as an Arrow table, since rows would start Python workers that stay beside those of the stages
    kinds = {"_w": pa.int32(), "_from": pa.int64(), "_to": pa.int64(), "_bins": pa.int64(), "_first": pa.int64()}
    plan = docs.sparkSession.createDataFrame(pa.Table.from_pylist([dict(zip(kinds, r)) for r in rows], pa.schema(kinds)))
    numbered = ranked(pieces, ["_width"], [id_column, "start", "ids_crc32"], "_rank")
    # at most some hundred intervals of ranks for each of capacity/grid widths
    placed = numbered.join(F.broadcast(plan), (F.col("_width") == F.col("_w")) & (F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_to")))
    placed = placed.withColumn("sequence_id", F.col("_first") + F.pmod(F.col("_rank") - F.col("_from"), F.col("_bins")))
    before = Window.partitionBy("sequence_id").orderBy(F.desc("_width"), "_rank").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("length").over(before), F.lit(0)).cast("long")
    return placed.select(id_column, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", offset.alias("offset"))


ship(__name__)
