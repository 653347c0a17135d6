"""Find which content hashes occur more than once, over all documents, and tell each document where.

Hashes travel as blobs, one for each bucket of hashes and each load of a task, so neither a frequent hash nor a long
document makes a large group: a load first drops its own repeats (they are known to be repeats), so a hash reaches its
bucket at most once per load.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from riskgrid.llm.shared import ship

Entries = tuple[np.ndarray, np.ndarray, np.ndarray]  #: documents, places, hashes

#: Entries that a task holds at a time (bounds memory only).
LOAD = 1_500_000


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread the bits of 64-bit hashes."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x9E3779B97F4A7C15)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


class Rolling:
    """Hashes of all windows of a sequence of 64-bit values: differences of weighted running sums."""

    BASE = 0x9E3779B97F4A7C55

    def __init__(self):
        self.size, self.powers, self.inverse = 0, None, None

    def sums(self, values: np.ndarray) -> np.ndarray:
        if self.powers is None or len(values) > self.size:
            self.size = max(2 * self.size, len(values), 1 << 16)
            inverse = pow(self.BASE, -1, 1 << 64)
            one = np.ones(1, np.uint64)
            with np.errstate(over="ignore"):
                self.powers = np.concatenate([one, np.cumprod(np.full(self.size, self.BASE, np.uint64))])
                self.inverse = np.concatenate([one, np.cumprod(np.full(self.size, inverse, np.uint64))])
        return np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * self.powers[: len(values)])])

    def windows(self, sums: np.ndarray, starts: np.ndarray | slice, length: int) -> np.ndarray:
        if isinstance(starts, slice):
            starts = np.arange(starts.start, starts.stop)
        return mixed((sums[starts + length] - sums[starts]) * self.inverse[starts])


def narrow(values: np.ndarray) -> bytes:
    """Whole numbers >= 0 as the smallest type that holds them all, the type's size first."""
    top = int(values.max()) if len(values) else 0
    kind = next(k for k in ("<u1", "<u2", "<u4", "<u8") if top < 1 << (8 * int(k[-1])))
    return kind[-1].encode() + values.astype(kind).tobytes()


def wide(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"<u{data[:1].decode()}", offset=1).astype(np.int64)


def _signed(values: np.ndarray) -> np.ndarray:
    return (values << 1) ^ (values >> 63)


def steps(values: np.ndarray) -> bytes:
    """Whole numbers by their differences."""
    return narrow(_signed(np.diff(values, prepend=0)).astype(np.uint64))


def unsteps(data: bytes) -> np.ndarray:
    z = wide(data)
    return np.cumsum((z >> 1) ^ -(z & 1))


def by_bucket(hashes: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """Indexes of each bucket's entries, in their order."""
    bucket = (hashes % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
    for b in np.flatnonzero(np.diff(edges)):
        yield int(b), order[edges[b] : edges[b + 1]]


def runs(ordered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and length of each run of equal values."""
    starts = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(ordered) else np.zeros(0, np.int64)
    return starts, np.diff(starts, append=len(ordered))


def loads(parts: Iterator[Entries], load: int = LOAD) -> Iterator[Entries]:
    """Join entries to loads of bounded size."""
    held, size = [], 0
    for part in parts:
        held.append(part)
        size += len(part[0])
        if size >= load:
            yield tuple(np.concatenate(x) for x in zip(*held))
            held, size = [], 0
    if size:
        yield tuple(np.concatenate(x) for x in zip(*held))


SPREAD = pa.schema([("bucket", pa.int32()), ("hash", pa.binary()), ("doc", pa.binary()), ("place", pa.binary()), ("count", pa.binary())])
REPEATED = pa.schema([("doc", pa.int64()), ("places", pa.binary()), ("hot", pa.binary())])


def _spread(make: Callable[[Iterator[pa.RecordBatch]], Iterator[Entries]], buckets: int, load: int):
    def run(batches):
        for number, (doc, place, h) in enumerate(loads(make(batches), load)):
            order = np.argsort(h, kind="stable")
            starts, lengths = runs(h[order])
            count = np.zeros(len(h), np.int64)
            count[order[starts]] = lengths  # of the first entry with a hash; the others have 0
            repeats = np.ones(len(h), bool)
            repeats[order] = np.repeat(lengths > 1, lengths)
            sent = np.flatnonzero(count)
            rows = [(b, h[i].tobytes(), steps(doc[i]), narrow(place[i]), narrow(count[i])) for b, pick in by_bucket(h[sent], buckets) for i in [sent[pick]]]
            known = np.flatnonzero(repeats & (count == 0))
            # repeats within the load are settled here; they only pass through a bucket
            if len(known):
                rows.append((number % buckets, b"", steps(doc[known]), narrow(place[known]), b""))
            yield pa.RecordBatch.from_pydict(dict(zip(SPREAD.names, zip(*rows))), schema=SPREAD)

    return run


def per_document(doc: np.ndarray, *values: np.ndarray) -> dict[str, list]:
    """One row per document with the packed values of its entries."""
    order = np.lexsort((values[0], doc))
    doc, values = doc[order], [v[order] for v in values]
    starts, lengths = runs(doc)
    return {"doc": doc[starts].tolist(), **{f"v{k}": [narrow(v[a : a + n]) for a, n in zip(starts, lengths)] for k, v in enumerate(values)}}


def _settle(frequent: int | None):
    def run(blobs):
        docs, places, hashes, counts, out_doc, out_place, hot = [], [], [], [], [], [], []
        for h, d, p, c in zip(*[blobs.column(c).to_pylist() for c in ("hash", "doc", "place", "count")]):
            if h:
                docs.append(unsteps(d)), places.append(wide(p)), hashes.append(np.frombuffer(h, np.uint64)), counts.append(wide(c))
            else:
                out_doc.append(unsteps(d)), out_place.append(wide(p))
        if docs:
            doc, place, h, count = (np.concatenate(x) for x in (docs, places, hashes, counts))
            order = np.argsort(h, kind="stable")
            starts, lengths = runs(h[order])
            total = np.add.reduceat(count[order], starts)
            keep = np.zeros(len(h), bool)
            keep[order] = np.repeat(total > 1, lengths)
            out_doc.append(doc[keep]), out_place.append(place[keep])
            if frequent is not None and (often := total > frequent).any():
                hot = [np.stack([h[order[starts[often]]], total[often].astype(np.uint64)], 1).tobytes()]
        rows = per_document(np.concatenate(out_doc), np.concatenate(out_place)) if out_doc else {"doc": [], "v0": []}
        return pa.Table.from_pydict({"doc": rows["doc"] + [None] * len(hot), "places": rows["v0"] + [None] * len(hot), "hot": [None] * len(rows["doc"]) + hot}, schema=REPEATED)

    return run


def bucket_count(documents: int) -> int:
    return max(64, documents // 2000)


def repeated(texts: DataFrame, make: Callable, buckets: int, load: int = LOAD, frequent: int | None = None) -> DataFrame:
    """Rows (doc, places, hot): where each document's entries are whose hash occurs more than once.

    ``make`` turns batches of ``texts`` into entries. A document gets a row from each bucket that has something to tell.
    With ``frequent``, further rows without document list the hashes that occur more often, with their counts.
    """
    spread = texts.mapInArrow(_spread(make, buckets, load), "bucket int, hash binary, doc binary, place binary, count binary")
    return spread.groupBy("bucket").applyInArrow(_settle(frequent), "doc long, places binary, hot binary")


def gathered(rows: DataFrame, *columns: str) -> DataFrame:
    """One row per document: the lists of its packed values."""
    return rows.groupBy("doc").agg(*[F.collect_list(c).alias(c) for c in columns])


ship(__name__)
