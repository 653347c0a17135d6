"""Substring dedup: windows of words found by anchors at the places of a difference cover."""

from __future__ import annotations

import hashlib
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from riskgrid.llm.packing import slices
from riskgrid.llm.repeats import Rolling, bucket_count, gathered, repeated, wide
from riskgrid.llm.shared import ship, text_bytes

#: Difference covers by period: any two places have a common shift below the period that puts both into the cover.
COVERS = {3: (0, 1), 7: (0, 1, 3), 13: (0, 1, 3, 9), 21: (3, 6, 7, 12, 14), 31: (1, 5, 11, 24, 25, 27)}
REMEMBERED = 200_000


class WordHashes:
    """64-bit hashes of the words of texts; hashes of seen words are remembered."""

    def __init__(self):
        self.known: dict[bytes, int] = {}

    def of(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All words' hashes in a row, and the number of words of each text."""
        split = [t.split() for t in texts]
        if len(self.known) > REMEMBERED:
            self.known = {}
        for word in set().union(*split) - self.known.keys():
            self.known[word] = xxhash.xxh64_intdigest(word)
        lengths = np.fromiter(map(len, split), np.int64, len(split))
        return np.fromiter(map(self.known.__getitem__, chain.from_iterable(split)), np.uint64, int(lengths.sum())), lengths


def _places(lengths: np.ndarray) -> np.ndarray:
    """Of each word its place in its text."""
    return np.arange(int(lengths.sum())) - np.repeat(np.cumsum(lengths) - lengths, lengths)


def _anchors(period: int, length: int):
    """Hashes of ``length`` words that start at a place of the cover."""
    cover = np.isin(np.arange(period), COVERS[period])

    def make(batches):
        words, rolling = WordHashes(), Rolling()
        for batch in batches:
            ids, texts = batch.column(0).to_numpy(), batch.column(1).to_pylist()
            for a, b in slices(texts):
                values, lengths = words.of(texts[a:b])
                place = _places(lengths)
                at = np.flatnonzero(cover[place % period] & (place + length <= np.repeat(lengths, lengths)))
                yield np.repeat(ids[a:b], lengths)[at], place[at], rolling.windows(rolling.sums(values), at, length)

    return make


def _windows(period: int, window: int):
    """Extend: hashes of the whole windows around repeated anchors."""

    def make(batches):
        words, rolling = WordHashes(), Rolling()
        for batch in batches:
            ids, texts, anchors = batch.column(0).to_numpy(), batch.column(1).to_pylist(), batch.column(2).to_pylist()
            for a, b in slices(texts):
                values, lengths = words.of(texts[a:b])
                first = np.cumsum(lengths) - lengths
                hit = np.zeros(len(values) + 1, np.int64)
                for k, blobs in enumerate(anchors[a:b]):
                    for blob in blobs:
                        hit[first[k] + wide(blob)] = 1
                before = np.concatenate([[0], np.cumsum(hit)])
                place = _places(lengths)
                at = np.flatnonzero(place + window <= np.repeat(lengths, lengths))
                at = at[before[at + period] > before[at]]  # an anchor among the window's first ``period`` places
                yield np.repeat(ids[a:b], lengths)[at], place[at], rolling.windows(rolling.sums(values), at, window)

    return make


def _removed(window: int):
    def run(batches):
        for batch in batches:
            ids, texts, starts = (batch.column(k) for k in range(3))
            words, removed, kept, flags = [], [], [], []
            for text, blobs in zip(texts.to_pylist(), starts.to_pylist()):
                split = text.split()
                gone = np.zeros(len(split) + 1, np.int64)
                for blob in blobs or ():
                    at = wide(blob)
                    np.add.at(gone, at, 1)
                    np.add.at(gone, at + window, -1)
                covered = np.cumsum(gone)[: len(split)] > 0
                left = [w for w, g in zip(split, covered) if not g] if blobs else split
                text = b" ".join(left)
                words.append(len(split)), removed.append(len(split) - len(left)), kept.append(text), flags.append(hashlib.sha256(text).hexdigest())
            yield pa.RecordBatch.from_arrays([ids, pa.array(words, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()), pa.array(flags)], names=["doc", "n_words", "n_removed", "kept", "kept_sha256"])

    return run


def drop_repeated_windows(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", window: int = 35, period: int = 21) -> DataFrame:
    """Remove every word covered by a window of ``window`` words that starts anywhere else too, first copies included.

    Two equal windows share, at one of ``period`` shifts, places that both lie in the difference cover; so hashes of
    ``window - period + 1`` words taken only at cover places meet there. Windows around anchors that repeat are
    extended to their full length, and those that repeat in full are removed. Windows are judged on the input.

    Returns doc, n_words, n_removed, kept (the words left, joined by one space), kept_sha256. Words are compared by
    64-bit hashes of their bytes. A null text has no words; texts shorter than a window stay; rows of a repeated id
    are joined by id, so ids must be unique integers (rows that share one see the union of what is removed); rows
    without id can't be told apart and nothing is removed from them; an empty table gives no rows.
    """
    length = window - period + 1
    if length < 1 or period not in COVERS:
        raise ValueError(f"the period must be one of {sorted(COVERS)} and at most the window")
    buckets = bucket_count(docs.count())
    texts = docs.select(F.col(id_column).cast("long").alias("doc"), text_bytes(text_column).alias("text"))
    known = texts.where("doc is not null")
    anchors = gathered(repeated(known, _anchors(period, length), buckets), "places")
    near = known.join(anchors, "doc").select("doc", "text", "places")
    starts = gathered(repeated(near, _windows(period, window), buckets), "places").withColumnRenamed("doc", "_doc")
    # both joins take the same frame of texts, so one shuffle of it serves both
    none = F.lit(None).cast("array<binary>").alias("places")
    both = known.join(starts, F.col("doc") == F.col("_doc"), "left").select("doc", "text", "places").unionAll(texts.where("doc is null").select("doc", "text", none))
    return both.mapInArrow(_removed(window), "doc long, n_words long, n_removed long, kept binary, kept_sha256 string")


ship(__name__)
