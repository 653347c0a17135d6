"""N-gram Jaccard join: T-occurrence search over inverted lists of word shingles, by DivideSkip."""

from __future__ import annotations

from math import ceil

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from riskgrid.llm.packing import forget, sliced
from riskgrid.llm.repeats import Rolling, bucket_count, by_bucket, mixed, narrow, runs, steps, unsteps, wide
from riskgrid.llm.shared import components, ship, text_bytes
from riskgrid.llm.substrings import WordHashes
from riskgrid.session import cut_lineage, release

#: Signatures that a task holds at a time; sets and shingles that meet in a task; a list longer than this is long.
LOAD, SETS, SHINGLES, LONG = 1_500_000, 4096, 2_500_000, 64


class Shingles:
    """Distinct shingle hashes of texts, ASCII letters in lower case."""

    def __init__(self, length: int):
        self.length, self.words, self.rolling = length, WordHashes(), Rolling()

    def of(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, hash) sorted and without repeats, and each text's number of them."""
        values, lengths = self.words.of([t.lower() for t in texts])
        first = np.cumsum(lengths) - lengths
        sums = self.rolling.sums(values)
        place = np.arange(len(values)) - np.repeat(first, lengths)
        doc = np.repeat(np.arange(len(texts)), lengths)
        at = np.flatnonzero(place + self.length <= np.repeat(lengths, lengths))
        parts = [(doc[at], self.rolling.windows(sums, at, self.length))]
        for n in range(1, self.length):  # a text of fewer words is one shingle
            some = np.flatnonzero(lengths == n)
            parts.append((some, mixed(self.rolling.windows(sums, first[some], n) + np.uint64(n))))
        doc, h = (np.concatenate(x) for x in zip(*parts))
        order = np.lexsort((h, doc))
        doc, h = doc[order], h[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
        doc, h = doc[new], h[new]
        return doc, h, np.bincount(doc, minlength=len(texts))


def overlap(sizes: int | np.ndarray, percent: int):
    """Least common shingles of two linked sets of ``sizes`` shingles together."""
    return -(-percent * sizes // (100 + percent))


def bands(percent: int, largest: int = 1 << 26) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Set sizes in bands: least size, most differing shingles of a pair within the band or the one below, and blocks.

    Linked sets lie in one band or two neighbouring ones. With more blocks than shingles that may differ, linked sets
    agree in whole blocks.
    """
    least, differ, blocks, low = [], [], [], 1
    while low < largest:
        high = max(low, 100 * low // percent)
        most = max(s - 2 * overlap(s, percent) for s in (2 * high, 2 * high - 1))
        least.append(low), differ.append(max(most, 0)), blocks.append(most + 3 + most * 5 // 8)
        low = high + 1
    return np.array(least), np.array(differ), np.array(blocks)


def signatures(doc: np.ndarray, h: np.ndarray, sizes: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, signature): a hash of the fuller blocks of each set, for its own band and the next.

    Blocks deal out all shingles by hash. Of each set only blocks of at least c shingles are named, with the largest c
    that leaves more of them than shingles may differ from a linked set. Of two linked sets, the one of larger c has
    such a block in which they agree, and the other names it too. Small blocks, which sets may share by chance or by a
    common passage, so stay out.
    """
    least, differ, blocks = bands(percent)
    out_doc, out = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    band = np.searchsorted(least, np.maximum(sizes, 1), "right") - 1
    both = sizes + 100 * sizes // percent
    most = np.maximum(both - 2 * overlap(both, percent), both - 1 - 2 * overlap(both - 1, percent))
    for up in (0, 1):
        level = band + up
        k = np.where((sizes > 0) & (differ[level] > 0), blocks[level], 0)
        base = np.cumsum(k) - k
        use = k[doc] > 0
        d, x = doc[use], h[use]
        block = ((x >> np.uint64(7)) % k[d].astype(np.uint64)).astype(np.int64)
        total = int(k.sum())
        if not total:
            continue
        at = base[d] + block
        low = np.bincount(at, (x & np.uint64(0xFFFFFFFF)).astype(float), total).astype(np.uint64)
        high = np.bincount(at, (x >> np.uint64(32)).astype(float), total).astype(np.uint64)
        count = np.bincount(at, minlength=total)
        owner = np.repeat(np.arange(len(sizes)), k)
        number = (np.arange(total) - base[owner]).astype(np.uint64)
        fullness = np.zeros(len(sizes), np.int64)
        for c in range(1, 9):
            fullness[np.bincount(owner, count >= c, len(sizes)) > most] = c
        keep = count >= fullness[owner]
        name = mixed(number * np.uint64(0x9E3779B97F4A7C15) + level[owner].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        sign = mixed(low * np.uint64(0xA0761D6478BD642F) + high * np.uint64(0xE7037ED1A0B428DB) + count.astype(np.uint64) + name)
        out_doc.append(owner[keep]), out.append(sign[keep])
    return np.concatenate(out_doc), np.concatenate(out)


SPREAD = pa.schema([("bucket", pa.int32()), ("sign", pa.binary()), ("doc", pa.binary()), ("n", pa.binary()), ("prints", pa.binary())])
FOUND = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("n", pa.int64()), ("print", pa.binary())])


def _stars(doc: np.ndarray, sign: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (smallest document, document) of each signature, distinct; and the entry of the smallest."""
    order = np.lexsort((doc, sign))
    starts, lengths = runs(sign[order])
    a, b = np.repeat(doc[order[starts]], lengths), doc[order]
    return np.unique(np.stack([a, b], 1)[a != b], axis=0), order[starts]


def _spread(length: int, percent: int, buckets: int):
    def run(batches):
        forget()
        shingles, held, size, number = Shingles(length), [], 0, 0

        def out():
            doc, sign = (np.concatenate(x) for x in zip(*held))
            pairs, first = _stars(doc, sign)
            first = np.sort(first)
            rows = [(b, sign[i].tobytes(), steps(doc[i]), b"", b"") for b, pick in by_bucket(sign[first], buckets) for i in [first[pick]]]
            rows.append((number % buckets, b"", steps(pairs[:, 0]), steps(pairs[:, 1]), b""))
            return rows

        def batch_of(rows):
            return pa.RecordBatch.from_pydict(dict(zip(SPREAD.names, zip(*rows))), schema=SPREAD)

        for batch in batches:
            ids = batch.column(0).to_numpy()
            for a, b, texts in sliced(batch.column(1)):
                doc, h, sizes = shingles.of(texts)
                stops = np.cumsum(sizes)
                # facts of a slice only pass through a bucket
                prints = b"".join(xxhash.xxh128_digest(h[y - n : y].tobytes()) for y, n in zip(stops.tolist(), sizes.tolist()))
                number += 1
                yield batch_of([(number * 7919 % buckets, b"", steps(ids[a:b]), narrow(sizes), prints)])
                owner, sign = signatures(doc, h, sizes, percent)
                held.append((ids[a:b][owner], sign))
                size += len(sign)
                if size >= LOAD:
                    yield batch_of(out())
                    held, size = [], 0
        if size:
            yield batch_of(out())

    return run


def _meet(blobs):
    docs, signs, pairs, facts = [], [], [], []
    for sign, d, n, prints in zip(*[blobs.column(c).to_pylist() for c in ("sign", "doc", "n", "prints")]):
        if sign:
            docs.append(unsteps(d)), signs.append(np.frombuffer(sign, np.uint64))
        elif prints:
            facts.append(pa.Table.from_pydict({"a": pa.nulls(len(prints) // 16, pa.int64()), "b": unsteps(d), "n": wide(n), "print": [prints[k : k + 16] for k in range(0, len(prints), 16)]}, schema=FOUND))
        elif len(d) > 1:
            pairs.append(np.stack([unsteps(d), unsteps(n)], 1))
    if docs:
        pairs.append(_stars(np.concatenate(docs), np.concatenate(signs))[0])
    if pairs and len(pairs := np.unique(np.concatenate(pairs), axis=0)):
        facts.append(pa.Table.from_pydict({"a": pairs[:, 0], "b": pairs[:, 1], "n": pa.nulls(len(pairs), pa.int64()), "print": pa.nulls(len(pairs), pa.binary())}, schema=FOUND))
    return pa.concat_tables(facts) if facts else FOUND.empty_table()


def _sets(length: int):
    def run(batches):
        forget()
        shingles = Shingles(length)
        for batch in batches:
            for a, b, texts in sliced(batch.column(1)):
                _, h, sizes = shingles.of(texts)
                stops = np.cumsum(sizes)
                rest = [batch.column(k).slice(a, b - a) for k in (0, *range(2, batch.num_columns))]
                cells = [h[y - n : y].tobytes() for y, n in zip(stops.tolist(), sizes.tolist())]
                yield pa.RecordBatch.from_arrays([*rest, pa.array(cells, pa.binary())], names=["doc", "component", "parts", "own", "set"])

    return run


def divide_skip(ids: np.ndarray, own: np.ndarray, sets: list[np.ndarray], percent: int, across: bool) -> list[tuple[int, int]]:
    """Edges that connect the sets (sorted arrays) of Jaccard similarity >= ``percent``/100.

    Sets are taken from small to large, each queried against those before it. It needs at least T = ``percent`` of its
    shingles in common. Of its inverted lists, up to T-1 long ones are set aside; the short ones are merged, and only
    sets that occur there often enough to reach T are looked up in the long lists, by binary search. A set that is
    already connected to the query needs no look-up. With ``across``, pairs of one part are left to another task.
    """
    order = sorted(range(len(ids)), key=lambda i: (len(sets[i]), ids[i]))
    sets, names, part = [sets[i] for i in order], [int(ids[i]) for i in order], own[order]
    sizes = np.array([len(s) for s in sets])
    tokens, doc = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
    by_token = np.argsort(tokens, kind="stable")
    starts, lengths = runs(tokens[by_token])
    posting = doc[by_token]
    list_of = np.empty(len(tokens), np.int64)
    list_of[by_token] = np.repeat(np.arange(len(starts)), lengths)
    stops = np.cumsum(sizes)
    root = list(range(len(sets)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    edges = []
    for x, n in enumerate(sizes.tolist()):
        lists = list_of[stops[x] - n : stops[x]]
        size = lengths[lists]
        need = ceil(percent * n / 100)
        if int((size > 1).sum()) < need:
            continue
        by_size = np.argsort(size, kind="stable")
        apart = min(int((size > LONG).sum()), need - 1)
        short, long = lists[by_size[: n - apart]], by_size[n - apart :]
        length = lengths[short]
        place = np.repeat(starts[short] - (np.cumsum(length) - length), length) + np.arange(int(length.sum()))
        merged = np.sort(posting[place])
        merged = merged[: np.searchsorted(merged, x)]
        first, seen = runs(merged)
        candidate = merged[first]
        keep = (seen >= need - apart) & (sizes[candidate] * 100 >= percent * n)
        candidate, seen = candidate[keep], seen[keep]
        probes = np.sort(sets[x][long])
        for k in np.argsort(-seen, kind="stable").tolist():
            y = int(candidate[k])
            if find(y) == find(x) or across and part[y] == part[x]:
                continue
            common = int(seen[k])
            if len(probes):
                at = np.minimum(np.searchsorted(sets[y], probes), len(sets[y]) - 1)
                common += int((sets[y][at] == probes).sum())
            if common >= overlap(n + len(sets[y]), percent):
                root[find(x)] = find(y)
                edges.append((names[x], names[y]))
    return edges


def _search(percent: int):
    def run(rows):
        ids, index = np.unique(rows.column("doc").to_numpy(), return_index=True)
        cells = rows.column("set").to_pylist()
        sets = [np.frombuffer(cells[i], np.uint64) for i in index]
        across = rows.column("q")[0].as_py() != rows.column("d")[0].as_py()
        edges = divide_skip(ids, rows.column("own").to_numpy()[index], sets, percent, across)
        return pa.Table.from_pydict({"a": pa.array([a for a, _ in edges], pa.int64()), "b": pa.array([b for _, b in edges], pa.int64())})

    return run


def similar_sets(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", length: int = 5, percent: int = 80) -> DataFrame:
    """Components of documents whose sets of word shingles have a Jaccard similarity of ``percent``/100 or more.

    1. Equal sets form classes; only one set of each goes on. 2. Sets are dealt into more blocks than two linked sets
    can differ in; sets that agree in a block are candidates, and only their connected groups meet. This leaves out no
    link and doesn't depend on how frequent a shingle is. 3. Within a group ``divide_skip`` does the T-occurrence
    search on the shingles' inverted lists. A large group is cut into parts that meet pairwise. Only edges that connect
    leave a task, never all pairs.

    Returns doc, n_shingles, representative (smallest id with an equal set), component (smallest id reachable). Texts
    without words, or null, have the empty set and link with nothing. Texts with fewer words than a shingle are one
    shingle. Shingles are compared by 64-bit hashes. Ids must be integers; rows of a repeated id count as one document
    (the one of the smallest set hash); rows without id are left out; an empty table gives no rows.
    """
    texts = docs.where(F.col(id_column).isNotNull()).select(F.col(id_column).cast("long").alias("doc"), text_bytes(text_column).alias("text"))
    buckets = bucket_count(texts.count())
    spread = texts.mapInArrow(_spread(length, percent, buckets), "bucket int, sign binary, doc binary, n binary, prints binary")
    found = cut_lineage(spread.groupBy("bucket").applyInArrow(_meet, "a long, b long, n long, print binary"))
    facts = found.where("a is null").groupBy(F.col("b").alias("doc")).agg(F.min(F.struct("print", "n")).alias("x")).select("doc", "x.print", "x.n")
    filled = facts.where("n > 0")
    first = filled.groupBy(F.col("print").alias("p")).agg(F.min("doc").alias("representative"))
    facts = cut_lineage(filled.join(first, F.col("print") == F.col("p")).drop("p").unionByName(facts.where("n = 0").withColumn("representative", F.col("doc"))))
    near = components(found.where("a is not null").select("a", "b"))
    members = stored = cut_lineage(near.join(facts.where("doc = representative").select("doc", "n"), F.col("node") == F.col("doc")).select("doc", "n", "component"))
    release(found)
    groups = members.groupBy("component").agg(F.count(F.lit(1)).alias("c"), F.sum("n").alias("s")).where("c > 1")
    parts = F.ceil(F.greatest(F.col("c") / SETS, F.col("s") / SHINGLES)).cast("int")
    members = members.join(groups.select("component", parts.alias("parts")), "component").select("doc", "component", "parts", F.pmod(F.xxhash64("doc"), F.col("parts")).cast("int").alias("own"))
    sets = texts.join(members, "doc").select("doc", "text", "component", "parts", "own").mapInArrow(_sets(length), "doc long, component long, parts int, own int, set binary")
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    sets = sets.withColumn("o", other).withColumn("q", F.least("own", "o")).withColumn("d", F.greatest("own", "o"))
    bundle = F.when(F.col("parts") == 1, F.pmod(F.xxhash64("component"), F.lit(buckets))).otherwise(F.col("component"))
    sets = sets.select((F.col("parts") > 1).alias("large"), bundle.alias("bundle"), "q", "d", "doc", "own", "set")
    edges = sets.groupBy("large", "bundle", "q", "d").applyInArrow(_search(percent), "a long, b long")
    roots = components(edges)
    release(stored)
    result = facts.join(roots, F.col("representative") == F.col("node"), "left")
    return result.select("doc", F.col("n").alias("n_shingles"), "representative", F.coalesce("component", "representative").alias("component"))


ship(__name__)
