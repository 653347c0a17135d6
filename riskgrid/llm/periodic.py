"""Periodic run detection: classes of suffixes united by falling common prefix, over ordered sets of positions."""

from __future__ import annotations

from bisect import bisect_left, insort
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from riskgrid.llm.packing import slices
from riskgrid.llm.shared import WORD, ship, text_bytes

RUN = "array<struct<start:bigint,length:bigint,period:bigint>>"
RUN_TYPE = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def suffix_ranks(doc: np.ndarray, word: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
    """Ranks of all suffixes by their first 1, 2, 4, ... words; equal where those words are equal.

    A suffix ends with its document and is ranked among its document's suffixes only. A rank is the place, from 1, of
    the first suffix of its class, so the last level orders the suffixes. Only classes of several suffixes are sorted
    again; the last level has none.
    """
    active = np.lexsort((word, doc))
    new = np.ones(len(active), bool)
    new[1:] = (doc[active[1:]] != doc[active[:-1]]) | (word[active[1:]] != word[active[:-1]])
    rank, levels, length = np.zeros(len(active), np.int32), [], 1
    shift = np.ones(len(active), np.int64)  # from a place among the sorted suffixes to a rank
    while True:
        at = np.flatnonzero(new)
        size = np.diff(at, append=len(active))
        rank = rank.copy()
        rank[active] = np.repeat(at + shift[at], size)
        levels.append(rank)
        active = active[np.repeat(size > 1, size)]
        if not len(active):
            return levels
        after = active + length
        inside = after < ends[active]
        key = rank[active].astype(np.int64) * (len(rank) + 2) + np.where(inside, rank[np.where(inside, after, 0)], 0)
        order = np.argsort(key, kind="stable")
        active, key = active[order], key[order]
        new = np.ones(len(key), bool)
        new[1:] = key[1:] != key[:-1]
        mother = rank[active].astype(np.int64)
        first = np.flatnonzero(np.append(True, mother[1:] != mother[:-1]))
        shift = np.repeat(mother[first] - first, np.diff(first, append=len(key)))
        length *= 2


def common_prefixes(levels: list[np.ndarray], ends: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Words that the suffixes at ``a`` and ``b`` have in common at their start."""
    a, b, total = a.copy(), b.copy(), np.zeros(len(a), np.int64)
    stop_a, stop_b = ends[a], ends[b]
    for k in range(len(levels) - 1, -1, -1):
        ranks = levels[k]
        inside = (a < stop_a) & (b < stop_b)
        same = np.zeros(len(a), np.int64)
        same[inside] = ranks[a[inside]] == ranks[b[inside]]
        same <<= k
        total += same
        a += same
        b += same
    return total


def unite(first: list[int], second: list[int], prefix: list[int], times: int) -> dict[tuple[int, int], int]:
    """Kruskal over pairs of suffixes in order of falling common ``prefix``: (period, end) -> start of each run found.

    Each class of united suffixes keeps its positions in order; the smaller class goes into the larger. Positions that
    become neighbours this way have exactly ``prefix`` words in common, so at a distance d they seed a run of period d
    that ends ``prefix`` words behind the later one. The seed of a run's first word comes first, since it has the longest
    prefix. Distances over ``prefix / (times - 1)`` give runs of less than ``times`` periods and are left out.
    """
    root: dict[int, int] = {}
    members: dict[int, list[int]] = {}
    found: dict[tuple[int, int], int] = {}
    less = times - 1

    def find(x: int) -> int:
        top = x
        while (up := root.get(top, top)) != top:
            top = up
        while x != top:
            root[x], x = top, root.get(x, x)
        return top

    for x, y, common in zip(first, second, prefix):
        x, y = find(x), find(y)
        small, large = members.pop(x, None) or [x], members.pop(y, None) or [y]
        if len(small) > len(large):
            small, large, x, y = large, small, y, x
        before = -1
        for k, p in enumerate(small):
            at = bisect_left(large, p)
            if at and large[at - 1] > before and (p - large[at - 1]) * less <= common:
                found.setdefault((p - large[at - 1], p + common), large[at - 1])
            if at < len(large) and (k + 1 == len(small) or large[at] < small[k + 1]) and (large[at] - p) * less <= common:
                found.setdefault((large[at] - p, large[at] + common), p)
            before = p
        if len(small) * 16 < len(large):
            for p in small:
                insort(large, p)
        else:
            large += small
            large.sort()
        root[x] = y
        members[y] = large
    return found


def find_runs(lengths: np.ndarray, word: np.ndarray, least: int, times: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and period of each run in texts of ``lengths`` words, by start, then period; starts count through all texts."""
    none = np.zeros(0, np.int64)
    if not len(word):
        return none, none, none
    stop = np.cumsum(lengths)
    ends = np.repeat(stop, lengths)
    doc = np.repeat(np.arange(len(lengths)), lengths)
    levels = suffix_ranks(doc, word, ends)
    # a run's first word and the one a period later have at least so many words in common
    shortest = min(max(least - q, (times - 1) * q) for q in range(1, least + 1))
    base = levels[min(shortest.bit_length() - 1, len(levels) - 1)]
    order = np.empty(len(word), np.int64)
    order[levels[-1] - 1] = np.arange(len(word))
    pair = np.flatnonzero(base[order[1:]] == base[order[:-1]])
    a, b = order[pair], order[pair + 1]
    prefix = common_prefixes(levels, ends, a, b)
    enough = prefix >= shortest
    a, b, prefix = a[enough], b[enough], prefix[enough]
    falling = np.argsort(-prefix, kind="stable")
    found = unite(a[falling].tolist(), b[falling].tolist(), prefix[falling].tolist(), times)
    rows = np.array([(start, end - start, period) for (period, end), start in found.items()], np.int64).reshape(-1, 3)
    rows = rows[(rows[:, 1] >= least) & (rows[:, 1] >= times * rows[:, 2])]
    return tuple(rows[np.lexsort((rows[:, 2], rows[:, 0]))].T)


def _detect(least: int, times: int, schema: pa.Schema):
    def run(batches):
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in slices(texts):
                split = [t.split() for t in texts[a:b]]
                numbers = {w: k for k, w in enumerate(set().union(*split))}
                lengths = np.fromiter(map(len, split), np.int64, len(split))
                total = int(lengths.sum())
                word = np.fromiter(map(numbers.__getitem__, chain.from_iterable(split)), np.int64, total)
                start, length, period = find_runs(lengths, word, least, times)
                covered = np.zeros(total + 1, np.int64)
                np.add.at(covered, start + period, 1)
                np.add.at(covered, start + length, -1)
                covered = np.cumsum(covered)[:total] > 0
                offset = np.cumsum(lengths) - lengths
                at = np.searchsorted(start, offset)
                edges = np.append(at, len(start))
                kept = []
                for k, words in enumerate(split):
                    gone = covered[offset[k] : offset[k] + lengths[k]] if edges[k] < edges[k + 1] else ()
                    kept.append(b" ".join([w for w, g in zip(words, gone) if not g] if len(gone) else words))
                relative = start - np.repeat(offset, np.diff(edges))
                runs = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (relative, length, period)], names=["start", "length", "period"]))
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], pa.array(lengths, pa.int64()), runs, pa.array(kept, pa.binary())], schema=schema)

    return run


def periodic_runs(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", least: int = 6, times: int = 4) -> DataFrame:
    """All maximal periodic runs of each whole text and the text without their repetitions.

    A run is a stretch of consecutive words in which words ``period`` (the smallest such number) apart are equal, at
    least ``least`` words and ``times`` (2 or more) periods long, that no neighbouring word extends. ``kept`` has all
    words, joined by one space, but those that lie in a run behind its first period. Runs may overlap.

    Returns id, n_words, runs (start, length, period: in words, ordered by start, then period), kept (UTF-8). A null
    text has no words; a null id and repeated rows are rows like others; no row needs another, so nothing is
    shuffled; an empty table gives no rows; other columns are ignored. A text is handled by one task, in memory that
    grows with its words.
    """
    if times < 2 or least < 2:
        raise ValueError("runs have at least two periods and two words")
    kind = docs.schema[id_column].dataType
    schema = pa.schema([(id_column, to_arrow_type(kind)), ("n_words", pa.int64()), ("runs", RUN_TYPE), ("kept", pa.binary())])
    rows = docs.select(F.col(id_column), text_bytes(text_column).alias("_text"))
    return rows.mapInArrow(_detect(least, times, schema), f"`{id_column}` {kind.simpleString()}, n_words long, runs {RUN}, kept binary")


def looped(text: Column, seed: Column) -> Column:
    """A text whose tail repeats, where the unsigned ``seed`` ends in 0: words joined by one space, else as it is.

    With n words, g = seed div 10, a = g % n, p = 1 + (n - a) div (3 + g % 8), each word i >= a becomes word
    a + (i - a) % p.
    """
    words = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), 0)
    g = F.floor(seed / 10).cast("long")
    inner = F.transform(
        F.array(F.struct(words.alias("w"), g.alias("g"))),
        lambda x: F.struct(x["w"].alias("w"), (x["g"] % F.size(x["w"])).alias("a"), (x["g"] % 8).alias("m"), F.size(x["w"]).cast("long").alias("n")),
    )[0]
    start, period = inner["a"], 1 + F.floor((inner["n"] - inner["a"]) / (3 + inner["m"])).cast("long")
    changed = F.transform(
        F.array(F.struct(inner["w"].alias("w"), start.alias("a"), period.alias("p"))),
        lambda x: F.array_join(F.transform(x["w"], lambda w, i: F.when(i < x["a"], w).otherwise(F.get(x["w"], (x["a"] + (i - x["a"]) % x["p"]).cast("int")))), " "),
    )[0]
    return F.when((seed % 10 == 0) & (F.size(words) > 0), changed).otherwise(text)


ship(__name__)
