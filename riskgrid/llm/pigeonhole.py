"""Embedding near-dedup: a subspace pigeonhole join of short codes of vectors with equal labels, then an exact one of what it links."""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, FloatType

from riskgrid.llm.repeats import runs
from riskgrid.llm.shared import components, ship
from riskgrid.llm.vectors import matrix, packed, unpacked, usable
from riskgrid.session import cut_lineage, release

#: Codes of a cell that meet in a task, of whole vectors an eighth; querying rows of a leaf; distances of a block; pairs
#: compared at a time; codes that a task holds; subspaces searched at a time; a code's steps from 0 to 1.
PER_TASK, LEAF, BLOCK, PAIRS, HELD, WAVE, STEPS = 65_536, 256, 4_000_000, 100_000, 200_000, 2, 32_767


def _of_one_length(batch: pa.RecordBatch, column: int):
    """The rows of each length of a column of lists or bytes."""
    cells = batch.column(column)
    lengths = (cells.value_lengths() if pa.types.is_list(cells.type) or pa.types.is_large_list(cells.type) else pc.binary_length(cells)).to_numpy(zero_copy_only=False)
    for length in np.unique(lengths):
        yield batch.take(pa.array(np.flatnonzero(lengths == length)))


def rotation(size: int, seed: int = 17) -> np.ndarray:
    """A seeded orthogonal matrix: spreads every difference over all components."""
    return np.linalg.qr(np.random.default_rng(seed).normal(size=(size, size)))[0]


def subspaces(size: int, width: int) -> list[slice]:
    return [slice(a, min(a + width, size)) for a in range(0, size, width)]


def _reach(size: int, threshold: float) -> float:
    """Largest distance of the codes of linked unit vectors: their own and what rounding both adds."""
    return (np.sqrt(max(2 - 2 * threshold, 0)) + np.sqrt(size) / STEPS) * (1 + 1e-9) + 1e-9


def _share(part: slice, size: int, threshold: float) -> float:
    """A subspace's share, by its dimensions, of that distance."""
    return _reach(size, threshold) * np.sqrt((part.stop - part.start) / size)


def _codes(vectors: np.ndarray, seed: int) -> np.ndarray:
    """Turned unit vectors in steps of a fixed size."""
    unit = vectors / np.sqrt((vectors**2).sum(1))[:, None]
    return np.rint(np.clip(unit @ rotation(vectors.shape[1], seed), -1, 1) * STEPS).astype("<i2")


def _cells(block: np.ndarray, reach: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, cell, whether it is the row's own): each row in its own grid cell and in the earlier ones within reach.

    Of two rows in different cells the one of the later cell is met in the other's.
    """
    width = 4 * reach
    own = np.floor(block / width).astype(np.int64)
    places = [(np.arange(len(block)), own, True)]
    for d in range(block.shape[1]):  # a row near a side of its cell is met from the next cell too
        more = []
        for at, cell, mine in places:
            x = block[at, d] / width - cell[:, d]
            sides = [(-1, x * width <= reach * (1 + 1e-9) + 1e-12)]
            if not mine:
                sides.append((1, (1 - x) * width <= reach * (1 + 1e-9) + 1e-12))
            for side, near in sides:
                if near.any():
                    step = cell[near].copy()
                    step[:, d] += side
                    more.append((at[near], step, False))
        places += more
    at, cell = (np.concatenate([p[k] for p in places]) for k in (0, 1))
    return at, cell, np.arange(len(at)) < len(block)


def _by_cell(cell: np.ndarray):
    """Each cell's bytes and the entries in it."""
    code = np.zeros(len(cell), np.int64)
    for d in range(cell.shape[1]):
        step = cell[:, d] - cell[:, d].min()
        code = code * (step.max() + 1) + step
        if code.max() > 1 << 31:
            code = np.unique(code, return_inverse=True)[1]
    order = np.argsort(code, kind="stable")
    starts, lengths = runs(code[order])
    for a, n in zip(starts.tolist(), lengths.tolist()):
        yield cell[order[a]].astype("<i4").tobytes(), order[a : a + n]


def _placed(width: int, threshold: float, dims: dict, seed: int, kind: str, wave: list | None):
    """(label, subspace, cell, entries' rows, whether each is in its own cell), with ids and codes, of the subspaces of a wave or all."""

    def run(batches):
        for batch in (part for whole in batches for part in _of_one_length(whole, 2)):
            group = np.array([dims.get(g, -1) for g in batch.column(1).to_pylist()])
            if not (group >= 0).any():
                continue
            batch = batch.filter(pa.array(group >= 0))
            codes = _codes(unpacked(batch.column(2), kind).astype(np.float64), seed)
            size, ids = codes.shape[1], batch.column(0).to_numpy()
            labels = batch.column(1).dictionary_encode()
            label = labels.indices.to_numpy()
            for k, name in enumerate(labels.dictionary.to_pylist()):
                rows = np.flatnonzero(label == k)
                for b, part in enumerate(subspaces(size, width)):
                    if wave is not None and b not in wave:
                        continue
                    block = codes[rows, part][:, : dims[name]] / STEPS
                    at, cell, mine = _cells(block, _share(part, size, threshold))
                    for key, some in _by_cell(cell):
                        yield (name, b, key), ids[rows[at[some]]], codes[rows[at[some]]], mine[some]

    return run


def _counted(*how):
    def run(batches):
        total = defaultdict(int)
        for key, ids, _, _ in _placed(*how, None)(batches):
            total[key] += len(ids)
        if total:
            yield pa.RecordBatch.from_pydict(dict(zip(["group", "subspace", "cell", "n"], zip(*[(g, b, c, n) for (g, b, c), n in total.items()]))), schema=pa.schema([("group", pa.string()), ("subspace", pa.int32()), ("cell", pa.binary()), ("n", pa.int64())]))

    return run


SENT = pa.schema([("group", pa.string()), ("subspace", pa.int32()), ("cell", pa.binary()), ("q", pa.int32()), ("d", pa.int32()), ("ids", pa.binary()), ("codes", pa.binary()), ("asks", pa.binary()), ("met", pa.binary())])


def _spread(heavy: dict, *how):
    """Codes to their cells; those of a heavy cell to its parts, of which each asks the others."""

    def parted(key, ids, codes, mine):
        parts = heavy.get(key, 1)
        if parts == 1:
            yield (*key, 0, 0), ids, codes, mine, np.ones(len(ids), bool)
            return
        own = ((ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % parts
        for q in range(parts):
            for d in range(parts):
                asks = mine & (own == q)
                met = (own == d) & (~mine | (q <= d))  # two rows of the cell meet once
                if (some := asks | met).any():
                    yield (*key, q, d), ids[some], codes[some], asks[some], met[some]

    def run(batches):
        held, size = defaultdict(list), 0

        def out():
            rows = []
            for key, parts in held.items():
                ids, codes, asks, met = (np.concatenate(x) for x in zip(*parts))
                rows.append((*key, ids.tobytes(), codes.tobytes(), asks.tobytes(), met.tobytes()))
            return pa.RecordBatch.from_pydict(dict(zip(SENT.names, zip(*rows))), schema=SENT)

        for placed in _placed(*how)(batches):
            for key, *entries in parted(*placed):
                held[key].append(entries)
                size += len(entries[0])
            if size >= HELD:
                yield out()
                held.clear()
                size = 0
        if size:
            yield out()

    return run


def _roots(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Smallest index reachable from each of n nodes by the pairs (a, b)."""
    label = np.arange(n)
    while True:
        new = label.copy()
        low = np.minimum(label[a], label[b])
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _united(label: np.ndarray, x: np.ndarray, y: np.ndarray, linked=None) -> np.ndarray:
    """Labels (smallest index of a connected set) after the pairs x, y are added, where ``linked`` says so.

    Pairs that earlier ones connect are not looked at.
    """
    while True:
        apart = label[x] != label[y]
        x, y = x[apart], y[apart]
        if not len(x):
            return label
        a, b = x[:PAIRS], y[:PAIRS]
        if linked is not None:
            found = linked(a, b)
            a, b = a[found], b[found]
        x, y = x[PAIRS:], y[PAIRS:]
        if len(a):
            nodes, index = np.unique(np.concatenate([label[a], label[b]]), return_inverse=True)
            to = np.arange(len(label))
            to[nodes] = nodes[_roots(index[: len(a)], index[len(a) :], len(nodes))]
            label = to[label]


def _leaves(block: np.ndarray, q: np.ndarray, d: np.ndarray, reach: float):
    """Few querying rows at a time with all rows that may be within reach of one: both are halved along the widest axis."""
    todo = [(q, d)]
    while todo:
        q, d = todo.pop()
        if not len(q) or not len(d):
            continue
        if len(q) > LEAF and len(d) > LEAF:
            axis = int(np.argmax(np.ptp(block[q], axis=0)))
            x, y = block[q, axis], block[d, axis]
            middle = np.partition(x, len(x) // 2)[len(x) // 2]
            low, left, right = x < middle, y <= middle + reach, y >= middle - reach
            if low.any() and left.sum() + right.sum() < 1.9 * len(d):
                todo += [(q[low], d[left]), (q[~low], d[right])]
                continue
        yield q, d


def _near(width: int, threshold: float, seed: int):
    """Pairs that connect what may be linked in one cell (or one part of it): close in the subspace and as whole codes."""

    def run(key, rows):
        ids = np.frombuffer(b"".join(rows.column("ids").to_pylist()), np.int64)
        size = int(key[0].as_py().split(":", 1)[0])
        whole = np.frombuffer(b"".join(rows.column("codes").to_pylist()), "<i2").reshape(-1, size)
        asks, met = (np.frombuffer(b"".join(rows.column(c).to_pylist()), bool) for c in ("asks", "met"))
        order = np.argsort(ids)
        ids, whole, asks, met = ids[order], whole[order].astype(np.float32) / np.float32(STEPS), asks[order], met[order]
        part, loose = subspaces(size, width)[key[1].as_py()], 1e-5  # far more than single precision takes off
        reach, far = _share(part, size, threshold), _reach(size, threshold) ** 2 * (1 + 1e-4) + loose
        block = whole[:, part]
        squares, ones = (block**2).sum(1)[:, None], np.ones((len(ids), 1), np.float32)
        left, right = np.hstack([-2 * block, ones, squares]), np.hstack([block, squares, ones])
        lengths = (whole**2).sum(1)
        label = np.arange(len(ids))

        def linked(x, y):
            return ((whole[x] - whole[y]) ** 2).sum(1) <= far

        for q, d in _leaves(block, np.flatnonzero(asks), np.flatnonzero(met), reach + loose):
            others, step = np.ascontiguousarray(right[d].T), max(1, BLOCK // len(d))
            for at in range(0, len(q), step):
                some = q[at : at + step]
                rough = left[some] @ others
                hits, check = np.flatnonzero(rough <= reach**2 * (1 + 1e-4) + loose), linked
                if len(hits) > rough.size // 50 and len(hits) > PAIRS:  # whole codes at once cost less than pair by pair
                    rough = lengths[some][:, None] + lengths[d] - 2 * (whole[some] @ whole[d].T)
                    hits, check = np.flatnonzero(rough <= far), None
                label = _united(label, some[hits // len(d)], d[hits % len(d)], check)
        moved = label != np.arange(len(ids))
        return pa.table({"a": pa.array(ids[label[moved]], pa.int64()), "b": pa.array(ids[moved], pa.int64())})

    return run


def _linked(threshold: float, kind: str):
    """Links among whole vectors that meet: each row's (with their weights) and the smallest id it is connected to here."""

    def run(rows):
        order = np.lexsort((rows.column("id").to_numpy(), rows.column("component").to_numpy()))
        ids, part, weight, component = (rows.column(c).to_numpy()[order] for c in ("id", "own", "weight", "component"))
        cells = rows.column("vector").to_pylist()
        across = rows.column("q")[0].as_py() != rows.column("d")[0].as_py()
        label, links = np.arange(len(ids)), np.zeros(len(ids), np.int64)
        for a, n in zip(*(x.tolist() for x in runs(component))):
            v = np.frombuffer(b"".join([cells[i] for i in order[a : a + n]]), kind).reshape(n, -1).astype(np.float64)
            length = np.sqrt((v**2).sum(1))
            unit = v / length[:, None]
            q = np.flatnonzero(part[a : a + n] == part[a]) if across else np.arange(n)
            d = np.flatnonzero(part[a : a + n] != part[a]) if across else q
            if not len(d):
                continue
            own, step = weight[a : a + n].astype(np.float64), max(1, BLOCK // len(d))
            for at in range(0, len(q), step):
                some = q[at : at + step]
                cosine = unit[some] @ unit[d].T
                found = cosine >= threshold
                i, j = np.nonzero(np.abs(cosine - threshold) < 1e-9)  # so near that the order of sums may decide
                found[i, j] = (v[some[i]] * v[d[j]]).sum(1) / (length[some[i]] * length[d[j]]) >= threshold
                if not across:
                    found[np.arange(len(some)), some] = False
                links[a + some] += np.rint(found @ own[d]).astype(np.int64)
                if across:
                    links[a + d] += np.rint(own[some] @ found).astype(np.int64)
                hits = np.flatnonzero(found)
                label = _united(label, a + some[hits // len(d)], a + d[hits % len(d)])
        seen = np.flatnonzero(links)
        other = ids[label[seen]]
        return pa.table({"id": pa.array(ids[seen], pa.int64()), "links": pa.array(links[seen], pa.int64()), "other": pa.array(other, pa.int64(), mask=other == ids[seen])})

    return run


def _to_bytes(kind: str):
    def run(batches):
        for batch in batches:
            for part in _of_one_length(batch, 2):
                rows = matrix(part.column(2))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(packed(rows.astype(kind))), pa.array((rows**2).sum(1) > 0)], names=["id", "group", "vector", "sound"])

    return run


def near_duplicates(data: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding", label_column: str = "label", threshold: float = 0.98, width: int = 8, seed: int = 17) -> DataFrame:
    """Link vectors of equal label and cosine >= ``threshold``; per row its links, its component and whether it stays.

    Unit vectors are turned by a seeded rotation, rounded to codes of two bytes a component and split into subspaces of
    ``width`` dimensions. Linked vectors have a squared distance of at most 2 - 2*threshold, so in some subspace at most
    that subspace's share: each subspace is range-joined by grid cells under its share, and of the pairs found there those
    whose whole codes are near enough are candidates. Only pairs that connect them leave a task. The subspaces are
    searched a few at a time, so that codes of few of them are on disk at once. The grid uses more dimensions as a label
    grows; a cell of many more than PER_TASK codes is cut into parts that meet pairwise. Whole vectors move once, to
    the others of their connected candidates: there each pair is compared in double precision on the given vectors. Large
    groups of candidates are cut into parts that meet pairwise. Equal vectors of a label are one class, linked to each
    other without pairs. Only counts and spanning edges leave a task.

    Returns id, n_links, component_id (smallest id reachable, itself included), kept. Rows with a null label, or a
    vector that is null, empty, zero or holds a null or non-finite component, link with nothing; vectors of different
    lengths don't link; repeated rows of one id are dropped, the smallest row stays; rows without id are left out; an
    empty table gives no rows. Classes are told apart by their bytes, and named to their rows by a 128-bit hash.
    """
    column = data.schema[vector_column].dataType
    kind = "<f4" if isinstance(column, ArrayType) and isinstance(column.elementType, FloatType) else "<f8"
    label = F.col(label_column).cast("string")
    rows = data.where(F.col(id_column).isNotNull()).groupBy(F.col(id_column).cast("long").alias("id")).agg(F.min(F.struct(label.alias("label"), F.col(vector_column).alias("v"))).alias("r")).select("id", "r.*")
    sound = rows.where(F.col("label").isNotNull() & usable("v")).select("id", F.concat_ws(":", F.size("v").cast("string"), "label").alias("group"), "v")
    sound = cut_lineage(sound.mapInArrow(_to_bytes(kind), "id long, group string, vector binary, sound boolean").where("sound").drop("sound"))
    every = cut_lineage(rows.select("id"))
    members = cut_lineage(sound.select("id", F.unhex(F.md5(F.concat(F.col("group").cast("binary"), "vector"))).alias("key")))
    classes = cut_lineage(sound.groupBy("group", "vector").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("weight")).select("id", "group", "vector", "weight"))
    release(sound)
    sizes = {r[0]: r[1] for r in classes.groupBy("group").count().where("count > 1").collect()}  # a row for each label
    dims = {g: int(np.ceil(np.log2(max(n / PER_TASK, 1)))) for g, n in sizes.items()}
    heavy, large = {}, {g: n for g, n in dims.items() if n}
    if large:
        cells = classes.mapInArrow(_counted(width, threshold, large, seed, kind), "group string, subspace int, cell binary, n long")
        cells = cells.groupBy("group", "subspace", "cell").agg(F.sum("n").alias("n")).where(F.col("n") > 2 * PER_TASK)
        heavy = {(r["group"], r["subspace"], bytes(r["cell"])): -(-r["n"] // PER_TASK) for r in cells.collect()}  # rows of cells with many
    most = max([len(subspaces(int(g.split(":", 1)[0]), width)) for g in sizes], default=0)
    at_once = max(1, WAVE >> max(dims.values(), default=0))
    found = []
    for first in range(0, most, at_once):
        wave = list(range(first, first + at_once))
        sent = classes.mapInArrow(_spread(heavy, width, threshold, dims, seed, kind, wave), "group string, subspace int, cell binary, q int, d int, ids binary, codes binary, asks binary, met binary")
        found.append(cut_lineage(sent.groupBy("group", "subspace", "cell", "q", "d").applyInArrow(_near(width, threshold, seed), "a long, b long")))
    pairs = found[0] if found else data.sparkSession.createDataFrame([], "a long, b long")
    for more in found[1:]:
        pairs = pairs.unionAll(more)
    near = cut_lineage(components(pairs))
    release(*found)
    meet = max(PER_TASK // 8, 1)
    groups = near.groupBy("component").agg(F.ceil(F.count(F.lit(1)) / meet).cast("int").alias("parts"))
    buckets = max(64, near.count() // 2000)
    live = near.join(groups, "component").select(F.col("node").alias("id"), "component", "parts", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int").alias("own"))
    live = classes.join(live, "id").withColumn("o", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    bundle = F.when(F.col("parts") == 1, F.pmod(F.xxhash64("component"), F.lit(buckets))).otherwise(F.col("component"))
    live = live.select((F.col("parts") > 1).alias("large"), bundle.alias("bundle"), F.least("own", "o").alias("q"), F.greatest("own", "o").alias("d"), "component", "id", "own", "weight", "vector")
    found = cut_lineage(live.groupBy("large", "bundle", "q", "d").applyInArrow(_linked(threshold, kind), "id long, links long, other long"))
    release(near, classes)
    links = found.groupBy("id").agg(F.sum("links").alias("links"))
    roots = components(found.where("other is not null").select(F.col("id").alias("a"), F.col("other").alias("b")))
    named = members.groupBy("key").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("weight"))
    named = named.join(links, F.col("first") == links["id"], "left").join(roots, F.col("first") == F.col("node"), "left").select("key", (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "first").alias("component_id"))
    members = members.join(named, "key").select(F.col("id").alias("_id"), "n_links", "component_id")
    result = every.join(members, F.col("id") == F.col("_id"), "left").select(F.col("id").alias(id_column), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "id").alias("component_id"))
    return result.withColumn("kept", F.col(id_column) == F.col("component_id"))


ship(__name__)
