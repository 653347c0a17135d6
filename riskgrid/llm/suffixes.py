"""Suffix-array dedup: maximal repeats of byte strings from a common-prefix interval tree.

A suffix array of a whole corpus is neither needed nor possible in one task. Every string of ``window`` bytes contains an
anchor: its ``gram`` bytes of smallest hash. Equal strings have equal anchors at equal distances. So only anchors that
occur more than once matter, and all occurrences of a string lie around occurrences of one anchor hash, which are brought
together with the bytes around them. There they form a sparse enhanced suffix array.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from riskgrid.llm.packing import forget, sliced
from riskgrid.llm.repeats import Rolling, bucket_count, by_bucket, gathered, mixed, narrow, per_document, repeated, runs, steps, unsteps, wide
from riskgrid.llm.shared import ship, text_bytes
from riskgrid.session import cut_lineage

GRAM = 32
#: Bytes of surroundings that a task gathers before it hands them on; occurrences of a frequent anchor that meet; bytes
#: of texts hashed at a time.
LOAD, TOGETHER, SLICE = 8_000_000, 1000, 1_000_000
PLACE_BITS = np.uint64(30)


def byte_values() -> np.ndarray:
    return mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All bytes in a row, with each text's start and length."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    return np.frombuffer(b"".join(texts), np.uint8), np.cumsum(lengths) - lengths, lengths


def window_minima(h: np.ndarray, width: int) -> np.ndarray:
    """Place of the smallest hash (the first of equal ones) among ``width`` places, for each start."""
    key = (h >> PLACE_BITS << PLACE_BITS) | np.arange(len(h), dtype=np.uint64)
    step = 1
    while 2 * step <= width:
        key = np.minimum(key[:-step], key[step:])
        step *= 2
    if rest := width - step:
        key = np.minimum(key[:-rest], key[rest:])
    return (key & ((np.uint64(1) << PLACE_BITS) - np.uint64(1))).astype(np.int64)


def _anchors(window: int, gram: int):
    def make(batches):
        forget()
        rolling, table = Rolling(), byte_values()
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for a, b, texts in sliced(batch.column(1), SLICE):
                data, first, lengths = joined(texts)
                if len(data) < window:
                    continue
                sums = rolling.sums(table[data])
                h = rolling.windows(sums, slice(0, len(data) - gram + 1), gram)
                at = window_minima(h, window - gram + 1)
                doc = np.repeat(np.arange(b - a), lengths)[: len(at)]
                at = at[np.arange(len(at)) + window <= (first + lengths)[doc]]
                at = at[np.concatenate([[True], at[1:] != at[:-1]])] if len(at) else at
                owner = np.searchsorted(first, at, "right") - 1
                # texts without bytes share a start with the next one, which owns the place
                yield ids[a:b][owner], at - first[owner], h[at]

    return make


def _merged(batches):
    for batch in batches:
        places = [narrow(np.sort(np.concatenate([wide(x) for x in blobs]))) if blobs else None for blobs in batch.column(1).to_pylist()]
        hot = [b"".join(blobs) for blobs in batch.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(places, pa.binary()), pa.array(hot, pa.binary())], names=["doc", "places", "hot"])


AROUND = pa.schema([("bucket", pa.int32()), ("salt", pa.int32()), ("hash", pa.binary()), ("doc", pa.binary()), ("place", pa.binary()), ("left", pa.binary()), ("right", pa.binary()), ("text", pa.binary())])


def _surroundings(window: int, gram: int, buckets: int, hot, load: int):
    """Bytes around the repeated anchors; a load's own repeats are settled at once."""

    def run(batches):
        frequent = np.frombuffer(hot.value, np.uint64).reshape(-1, 2)
        frequent = frequent[np.argsort(frequent[:, 0])]
        rolling, table, held, size, number = Rolling(), byte_values(), [], 0, 0

        def out():
            h, same, doc, place, left, right = (np.concatenate([x[k] for x in held]) for k in range(6))
            text = np.concatenate([x[6] for x in held])
            start = np.cumsum(left + right) - left - right
            order = np.lexsort((place, doc, same))
            first = np.zeros(len(h), bool)
            first[order[runs(same[order])[0]]] = True
            rows, again = [], np.flatnonzero(~first)
            if len(again):
                rows.append((number % buckets, 0, b"", steps(doc[again]), narrow(place[again] - left[again]), narrow((left + right)[again]), b"", b""))
            sent = np.flatnonzero(first)
            salt = np.zeros(len(sent), np.int64)
            if len(frequent):
                k = np.minimum(np.searchsorted(frequent[:, 0], h[sent]), len(frequent) - 1)
                parts = np.where(frequent[k, 0] == h[sent], -(-frequent[k, 1].astype(np.int64) // TOGETHER), 1)
                # 0 marks what isn't frequent
                salt = np.where(parts > 1, 1 + (mixed(doc[sent].astype(np.uint64)) % parts.astype(np.uint64)).astype(np.int64), 0)
            for b, pick in by_bucket(h[sent], buckets):
                for value in np.unique(salt[pick]):
                    i = sent[pick[salt[pick] == value]]
                    n = (left + right)[i]
                    where = np.repeat(start[i] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
                    rows.append((b, int(value), h[i].tobytes(), steps(doc[i]), narrow(place[i]), narrow(left[i]), narrow(right[i]), text[where].tobytes()))
            return pa.RecordBatch.from_pydict(dict(zip(AROUND.names, zip(*rows))), schema=AROUND)

        for batch in batches:
            ids, anchors = batch.column(0).to_numpy(), batch.column(2).to_pylist()
            for a, b, texts in sliced(batch.column(1), SLICE):
                data, first, lengths = joined(texts)
                if len(data) < window:
                    continue
                places = [wide(x) for x in anchors[a:b]]
                owner = np.repeat(np.arange(b - a), [len(p) for p in places])
                place = np.concatenate(places)
                left, right = np.minimum(place, window - gram), np.minimum(lengths[owner] - place, window)
                use = left + right >= window
                owner, place, left, right = owner[use], place[use], left[use], right[use]
                at = first[owner] + place
                sums = rolling.sums(table[data])
                h = rolling.windows(sums, at, gram)
                n = left + right
                same = mixed(mixed(rolling.windows(sums, at - left, n) + n.astype(np.uint64)) + left.astype(np.uint64))
                where = np.repeat(at - left - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
                held.append((h, same, ids[a:b][owner], place, left, right, data[where]))
                size += len(where)
                if size >= load:
                    yield out()
                    held, size, number = [], 0, number + 1
        if size:
            yield out()

    return run


def _common(x: np.ndarray, y: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Length of the common prefix of each pair of rows, at most ``most``."""
    differ = x != y
    return np.minimum(np.where(differ.any(1), differ.argmax(1), x.shape[1]), most)


def _keys(rows: np.ndarray) -> list[np.ndarray]:
    """Rows of bytes as big-endian words, last first, for lexsort."""
    width = -(-rows.shape[1] // 8) * 8
    wide_rows = np.zeros((len(rows), width), np.uint8)
    wide_rows[:, : rows.shape[1]] = rows
    words = wide_rows.view(">u8").astype(np.uint64)
    return [words[:, k] for k in range(words.shape[1] - 1, -1, -1)]


def intervals(lcp: list[int], least: int) -> Iterator[tuple[int, int, int]]:
    """(first, last, common prefix) of every interval of at least ``least``, inner ones first: a scan with a stack.

    ``lcp[k]`` is the common prefix of rows k and k+1.
    """
    stack: list[tuple[int, int]] = []  # (common prefix, first row)
    for k, value in enumerate([*lcp, -1]):
        first = k
        while stack and stack[-1][0] > value:
            length, first = stack.pop()
            if length >= least:
                yield first, k, length
        if not stack or stack[-1][0] < value:
            stack.append((value, first))


def maximal_repeats(left: np.ndarray, left_length: np.ndarray, lcp: np.ndarray, window: int, gram: int) -> Iterator[tuple[np.ndarray, int, int]]:
    """(rows, bytes before, bytes after) of each maximal repeat of ``window`` bytes or more around one anchor.

    Rows are in suffix order; ``left`` holds the bytes before the anchor, nearest first. Each interval of the prefix
    tree is a set of rows that agree in so many bytes from the anchor on. Among them the bytes before are compared the
    same way: rows that agree further to the left, where their left neighbours become diverse, are a repeat with all
    its occurrences, unless an inner interval holds them all (then they agree further to the right).
    """
    rank = np.lexsort((left_length, *_keys(left)))
    place = np.empty(len(rank), np.int64)
    place[rank] = np.arange(len(rank))
    steps_left = _common(left[rank[:-1]], left[rank[1:]], np.minimum(left_length[rank[:-1]], left_length[rank[1:]]))
    for first, last, right in intervals(lcp.tolist(), gram):
        rows = np.arange(first, last + 1)
        rows = rows[np.argsort(place[rows])]
        where = place[rows]
        if len(rows) == len(rank):
            agree = steps_left
        elif len(rows) == 2:
            agree = steps_left[where[0] : where[1]].min(keepdims=True)
        else:  # common prefix of rows that aren't neighbours: the least between them
            agree = np.minimum.reduceat(np.append(steps_left, 0), where)[:-1]
        for a, b, before in intervals(agree.tolist(), max(window - right, 0)):
            group = rows[a : b + 1]
            if lcp[group.min() : group.max()].min() == right:
                yield group, before, right


LATER = pa.schema([("bucket", pa.int32()), ("hash", pa.binary()), ("doc", pa.binary()), ("start", pa.binary()), ("length", pa.binary())])


def _tree(window: int, gram: int, buckets: int):
    """Repeats among the surroundings of one bucket: what to remove, and for frequent anchors the windows left over."""

    def run(blobs):
        rows, parts = [], []
        for h, d, p, l, r, t, s in zip(*[blobs.column(c).to_pylist() for c in ("hash", "doc", "place", "left", "right", "text", "salt")]):
            if h:
                parts.append((np.frombuffer(h, np.uint64), unsteps(d), wide(p), wide(l), wide(r), np.frombuffer(t, np.uint8)))
                frequent = s > 0
            else:
                rows.append((int(blobs.column("bucket")[0].as_py()), b"", d, p, l))
        if not parts:
            return pa.Table.from_pydict(dict(zip(LATER.names, zip(*rows))), schema=LATER) if rows else LATER.empty_table()
        h, doc, place, left, right, text = (np.concatenate(x) for x in zip(*parts))
        stop = np.cumsum(left + right)
        anchor = stop - right
        text = np.concatenate([text, np.zeros(window, np.uint8)])
        # bytes from the anchor on, and before it with the nearest first; zeros beyond the end
        after = text[anchor[:, None] + np.arange(window)]
        after[np.arange(window) >= right[:, None]] = 0
        reach = window - gram
        before = text[np.maximum(anchor[:, None] - 1 - np.arange(reach), 0)]
        before[np.arange(reach) >= left[:, None]] = 0
        order = np.lexsort((place, doc, left, *_keys(before), right, *_keys(after), h))
        h, doc, place, left, right, after, before, anchor = (x[order] for x in (h, doc, place, left, right, after, before, anchor))
        alike = (h[1:] == h[:-1]) & (left[1:] == left[:-1]) & (right[1:] == right[:-1]) & (after[1:] == after[:-1]).all(1) & (before[1:] == before[:-1]).all(1)
        first = np.concatenate([[True], ~alike])
        gone = [(doc[~first], (place - left)[~first], (left + right)[~first])]
        h, doc, place, left, right, after, before, anchor = (x[first] for x in (h, doc, place, left, right, after, before, anchor))
        lcp = _common(after[:-1], after[1:], np.minimum(right[:-1], right[1:]))
        starts, lengths = runs(h)
        # two different surroundings: a single repeat
        a = starts[lengths == 2]
        b = a + 1
        wide_left = _common(before[a], before[b], np.minimum(left[a], left[b]))
        long = wide_left + lcp[a] >= window if len(a) else np.zeros(0, bool)
        later = np.where((doc[a] < doc[b]) | (doc[a] == doc[b]) & (place[a] < place[b]), b, a)[long]
        gone.append((doc[later], place[later] - wide_left[long], (wide_left + lcp[a])[long] if len(a) else later))
        cut = [(later, -wide_left[long], lcp[a][long] if len(a) else later)]
        for at, n in zip(starts[lengths > 2], lengths[lengths > 2]):
            for group, l, r in maximal_repeats(before[at : at + n], left[at : at + n], lcp[at : at + n - 1], window, gram):
                group = group + at
                earliest = np.lexsort((place[group], doc[group]))[0]
                group = np.delete(group, earliest)
                gone.append((doc[group], place[group] - l, np.full(len(group), l + r)))
                cut.append((group, np.full(len(group), -l), np.full(len(group), r)))
        doc_out, start_out, length_out = (np.concatenate(x) for x in zip(*gone))
        bucket = int(blobs.column("bucket")[0].as_py())
        if len(doc_out):
            rows.append((bucket, b"", steps(doc_out), narrow(start_out), narrow(length_out)))
        if frequent:  # windows that nothing earlier in this part covers: the other parts may have them
            who, lo, hi = (np.concatenate(x) for x in zip(*cut))
            count = left + right - window + 1
            owner = np.repeat(np.arange(len(h)), count)
            offset = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count) - left[owner]
            base = np.cumsum(count) - count + left  # entry of the window at the anchor
            cover = np.zeros(len(owner) + 1, np.int64)
            np.add.at(cover, base[who] + lo, 1)
            np.add.at(cover, base[who] + hi - window + 1, -1)
            open_ = np.cumsum(cover)[:-1] == 0
            owner, offset = owner[open_], offset[open_]
            rolling = Rolling()
            sums = rolling.sums(byte_values()[text])
            whole = rolling.windows(sums, anchor[owner] + offset, window)
            for b, i in by_bucket(whole, buckets):
                rows.append((b, whole[i].tobytes(), steps(doc[owner[i]]), narrow(place[owner[i]] + offset[i]), b""))
        return pa.Table.from_pydict(dict(zip(LATER.names, zip(*rows))), schema=LATER) if rows else LATER.empty_table()

    return run


REMOVE = pa.schema([("doc", pa.int64()), ("starts", pa.binary()), ("lengths", pa.binary())])


def _first_stays(window: int):
    def run(blobs):
        docs, starts, lengths, open_ = [], [], [], []
        for h, d, s, n in zip(*[blobs.column(c).to_pylist() for c in ("hash", "doc", "start", "length")]):
            if h:
                open_.append((np.frombuffer(h, np.uint64), unsteps(d), wide(s)))
            else:
                docs.append(unsteps(d)), starts.append(wide(s)), lengths.append(wide(n))
        if open_:
            h, doc, start = (np.concatenate(x) for x in zip(*open_))
            order = np.lexsort((start, doc, h))
            h, doc, start = h[order], doc[order], start[order]
            at, count = runs(h)
            first = np.repeat(at, count)
            # one window may come from several frequent anchors in it: its own other mentions don't count
            later = (doc != doc[first]) | (start != start[first])
            docs.append(doc[later]), starts.append(start[later]), lengths.append(np.full(int(later.sum()), window))
        if not docs:
            return REMOVE.empty_table()
        rows = per_document(*(np.concatenate(x) for x in (docs, starts, lengths)))
        return pa.Table.from_pydict({"doc": rows["doc"], "starts": rows["v0"], "lengths": rows["v1"]}, schema=REMOVE)

    return run


def _cut_out(as_text: bool):
    def run(batches):
        for batch in batches:
            yield _cut_batch(batch, as_text)

    return run


def _cut_batch(batch: pa.RecordBatch, as_text: bool) -> pa.RecordBatch:
    kept, spans, sizes, flags = [], [], [], []
    for text, starts, lengths in zip(*[batch.column(k).to_pylist() for k in (1, 2, 3)]):
        sizes.append(len(text))
        runs_out = []
        if starts:
            a = np.concatenate([wide(x) for x in starts])
            b = a + np.concatenate([wide(x) for x in lengths])
            order = np.argsort(a, kind="stable")
            a, b = a[order], np.maximum.accumulate(b[order])
            new = np.flatnonzero(np.concatenate([[True], a[1:] > b[:-1]]))
            runs_out = list(zip(a[new].tolist(), b[np.append(new[1:], len(a)) - 1].tolist()))
            at, pieces = 0, []
            for x, y in runs_out:
                pieces.append(text[at:x])
                at = y
            text = b"".join([*pieces, text[at:]])
        kept.append(text), spans.append([{"start": x, "stop": y} for x, y in runs_out]), flags.append(hashlib.sha256(text).hexdigest())
    left = pa.array([t.decode("utf-8", "ignore") for t in kept], pa.string()) if as_text else pa.array(kept, pa.binary())
    columns = [batch.column(0), pa.array(sizes, pa.int64()), left, pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))), pa.array(flags)]
    return pa.RecordBatch.from_arrays([*columns, *batch.columns[4:]], names=["doc", "n_bytes", "kept", "spans", "kept_sha256", *batch.schema.names[4:]])


def drop_repeats(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", window: int = 100, gram: int = GRAM, as_text: bool = False, carry: tuple[str, ...] = ()) -> DataFrame:
    """Remove each byte covered by a string of ``window`` bytes that also starts earlier: in a smaller id, or before.

    See the module's text for the way. An anchor that occurs in more than a thousandth of the documents (and over
    TOGETHER times) is frequent: its occurrences are dealt to parts, each part removes what repeats within it, and of
    the rest the windows' hashes are compared over all parts. The list of frequent anchors is the only thing that goes
    to the driver; it holds at most a thousand times the anchors of a mean document.

    Returns doc, n_bytes, kept (bytes; they may cut a character; with ``as_text`` a text without the cut characters),
    spans (start, stop of removed runs), kept_sha256, rest (a struct of the columns ``carry``).
    Strings never cross texts and are judged on the input. Anchors and whole surroundings are compared by 64-bit
    hashes, all else byte by byte. A null text counts as empty; texts below ``window`` bytes stay; ids must be unique
    integers (rows that share one see the union of what is removed); nothing is removed from rows without id; an empty
    table gives no rows.
    """
    n = docs.count()
    buckets = bucket_count(n)
    spark = docs.sparkSession
    rest = [F.struct(*[F.col(c) for c in carry]).alias("rest")] if carry else []
    texts = docs.select(F.col(id_column).cast("long").alias("doc"), text_bytes(text_column).alias("text"), *rest)
    known = texts.where("doc is not null")
    found = gathered(repeated(known.select("doc", "text"), _anchors(window, gram), buckets, frequent=max(TOGETHER, n // 1000)), "places", "hot")
    found = cut_lineage(found.mapInArrow(_merged, "doc long, places binary, hot binary"))
    hot = spark.sparkContext.broadcast(b"".join(r[0] for r in found.where("doc is null").select("hot").collect()))
    near = known.join(found.where("doc is not null").select("doc", "places"), "doc").select("doc", "text", "places")
    around = near.mapInArrow(_surroundings(window, gram, buckets, hot, LOAD), "bucket int, salt int, hash binary, doc binary, place binary, left binary, right binary, text binary")
    later = around.groupBy("bucket", "salt").applyInArrow(_tree(window, gram, buckets), "bucket int, hash binary, doc binary, start binary, length binary")
    remove = gathered(later.groupBy("bucket").applyInArrow(_first_stays(window), "doc long, starts binary, lengths binary"), "starts", "lengths").withColumnRenamed("doc", "_doc")
    # both joins take the same frame of texts, so one shuffle of it serves both
    carried = [*(["rest"] if carry else [])]
    none = F.lit(None).cast("array<binary>")
    both = known.join(remove, F.col("doc") == F.col("_doc"), "left").select("doc", "text", "starts", "lengths", *carried)
    both = both.unionAll(texts.where("doc is null").select("doc", "text", none.alias("starts"), none.alias("lengths"), *carried))
    kind = f"doc long, n_bytes long, kept {'string' if as_text else 'binary'}, spans array<struct<start:long,stop:long>>, kept_sha256 string"
    if carry:
        kind += f", rest {both.schema['rest'].dataType.simpleString()}"
    return both.mapInArrow(_cut_out(as_text), kind)


ship(__name__)
