"""Mixing sources to target weights: Sainte-Laguë seats for equal-token blocks, then blocks in a seeded order of documents."""

from __future__ import annotations

import heapq
import itertools
import re
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from riskgrid.llm.packing import forget
from riskgrid.llm.shared import WORD, ship
from riskgrid.session import cut_lineage

Sizes = dict[str | None, int]
WORDS = re.compile(WORD)


def targets(sizes: Sizes, weights: list[int], repeats: int) -> dict[str | None, Fraction]:
    """Share the sum of all sizes by weight; none gets over ``repeats`` times its size, the excess is shared again.

    Sources are weighed in order of code points, null last, with ``weights`` repeating.
    """
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    out, open_ = {s: Fraction(0) for s in order}, set(order)
    left = Fraction(sum(sizes.values()))
    while open_:
        unit = left / sum(weight[s] for s in open_)
        above = {s for s in open_ if unit * weight[s] > repeats * sizes[s]}
        if not above:
            out |= {s: unit * weight[s] for s in open_}
            break
        for s in above:
            out[s] = Fraction(repeats * sizes[s])
            left -= out[s]
        open_ -= above
    return out


def seats(votes: list[Fraction], house: int, most: list[int]) -> list[int]:
    """Sainte-Laguë: ``house`` seats go one by one to the highest votes/(2*seats+1); ties to the earlier, none over ``most``.

    The seats above a divisor are counted at once; only the last few are dealt one by one.
    """

    def won(divisor: Fraction) -> list[int]:
        return [min(m, int((v / divisor + 1) / 2)) for v, m in zip(votes, most)]

    low, high = Fraction(0), sum(votes, Fraction(0)) + 1
    for _ in range(200):
        middle = Fraction(float((low + high) / 2))
        if not low < middle < high:
            break
        if sum(won(middle)) > house:
            low = middle
        else:
            high = middle
    got = won(high)
    heap = [(-v / (2 * n + 1), i) for i, (v, n, m) in enumerate(zip(votes, got, most)) if v > 0 and n < m]
    heapq.heapify(heap)
    for _ in range(house - sum(got)):
        if not heap:
            break
        _, i = heapq.heappop(heap)
        got[i] += 1
        if got[i] < most[i]:
            heapq.heappush(heap, (-votes[i] / (2 * got[i] + 1), i))
    return got


def quotas(sizes: Sizes, weights: list[int], block: int, repeats: int, shards: int) -> dict[str | None, tuple[Fraction, list[int]]]:
    """Per source its target and its blocks in each of ``shards`` output shards.

    The method never takes a seat back as the house grows, so the shards' quotas are the seats that the house gains
    from one shard to the next. Parts of a block count as blocks: of a source's limit and of the whole.
    """
    goal = targets(sizes, weights, repeats)
    order, total = list(goal), sum(sizes.values())
    most = [-(-repeats * sizes[s] // block) for s in order]
    before, out = [0] * len(order), {s: [] for s in order}
    for k in range(1, shards + 1):
        now = seats([goal[s] for s in order], -(-total * k // (block * shards)), most)
        for s, a, b in zip(order, now, before):
            out[s].append(a - b)
        before = now
    return {s: (goal[s], out[s]) for s in order}


def mix(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source", weights: tuple[int, ...] = (5, 2, 1), repeats: int = 3, block: int = 32, shards: int = 8, seed: int = 11) -> DataFrame:
    """How many words of each row a mix of the sources takes.

    A source's documents follow each other in a seeded order as a stream of words, cut into blocks of ``block`` words.
    Sainte-Laguë gives each source integer quotas of blocks per output shard; whole passes over the stream are taken
    first, and the last, partial pass takes the rest in the seeded order, from the first block on; a source's last block
    may be a part of one, and a source with a target below one block is served in words. So whole documents are
    chosen, in a source at most one is cut (at the last block's end: it keeps its first words), a block is taken once
    at most and no row exceeds ``repeats`` times its size. The order is a hash order of the rows, so reruns agree.

    Returns id, source, size, source_size, target, quota (blocks), quotas (blocks of each output shard; rows are not
    dealt to shards here), passes, place (words of the stream before the row),
    text_crc32 and taken. A null or wordless text has size
    0 and takes 0; null is a source of its own, last in order; repeated rows are separate rows with the same or
    adjoining places; an empty table gives no rows; other columns are ignored. Sources are expected to be as few as
    their weights (one row each goes to the driver); words and rows are not collected.
    """
    text = F.coalesce(F.col(text_column), F.lit(""))
    facts = docs.select(F.col(id_column).alias("id"), F.col(source_column).alias("source"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("crc"))
    # rows that are equal in all this are one row with a count from here on, so no number of them is too much for a task
    facts = cut_lineage(facts.groupBy("id", "source", "size", "crc").agg(F.count(F.lit(1)).alias("rows")))
    sizes = {r[0]: r[1] for r in facts.groupBy("source").agg(F.sum(F.col("size") * F.col("rows"))).collect()}
    plan = []
    for source, (goal, per_shard) in quotas(sizes, list(weights), block, repeats, shards).items():
        size = sizes[source]
        # a target below one block is served in words
        words = int(goal) if goal < block else min(sum(per_shard) * block, repeats * size)
        passes = words // size if size else 0
        plan.append((source, size, float(goal), sum(per_shard), per_shard, passes, words - passes * size))
    kinds = {"of": pa.string(), "source_size": pa.int64(), "target": pa.float64(), "quota": pa.int64(), "quotas": pa.list_(pa.int64()), "passes": pa.int64(), "last": pa.int64()}
    # as an Arrow table, since rows would start Python workers that stay beside those of the stages
    plan = docs.sparkSession.createDataFrame(pa.Table.from_pylist([dict(zip(kinds, r)) for r in plan], pa.schema(kinds)))
    joined = _stream_places(facts, seed).join(F.broadcast(plan), F.col("source").cast("string").eqNullSafe(F.col("of")))
    chunk = 10_000
    each = joined.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(rows - 1) div {chunk}"))))
    each = each.withColumn("number", F.explode(F.sequence(F.col("chunk") * chunk, F.least(F.col("rows"), (F.col("chunk") + 1) * chunk) - 1)))
    place = F.col("place") + F.col("number") * F.col("size")
    part = F.least(place + F.col("size"), F.col("last")) - F.least(place, F.col("last"))
    taken = (F.col("passes") * F.col("size") + part).cast("long")
    return each.select(
        F.col("id").alias(id_column), F.col("source").alias(source_column), "size", "source_size", "target", "quota", "quotas", "passes", place.alias("place"), F.col("crc").alias("text_crc32"), taken.alias("taken")
    )


def _stream_places(facts: DataFrame, seed: int, least_blocks: int = 1024, rows_per_block: int = 20_000) -> DataFrame:
    """Words of the source before each row, in seeded order: sums within hash blocks plus the sums of earlier blocks."""
    parts = max(least_blocks, facts.count() // rows_per_block)
    words = F.col("size") * F.col("rows")
    dealt = facts.withColumn("hash", F.xxhash64(F.lit(seed), "id", "crc")).withColumn("part", F.pmod("hash", F.lit(parts)))
    within = Window.partitionBy("source", "part").orderBy("hash", "id", "crc", "size").rowsBetween(Window.unboundedPreceding, -1)
    local = dealt.withColumn("inside", F.coalesce(F.sum(words).over(within), F.lit(0)))
    sums = dealt.groupBy("source", "part").agg(F.sum(words).alias("n"))
    earlier = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sums.select(F.col("source").alias("s"), F.col("part").alias("p"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("shift"))
    return local.join(shifts, F.col("source").eqNullSafe(F.col("s")) & (F.col("part") == F.col("p"))).withColumn("place", F.col("inside") + F.col("shift")).drop("s", "p", "shift", "inside", "part", "hash")


def _cut(batches):
    forget()
    for batch in batches:
        texts = []
        for text, words in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if words is not None:
                ends = itertools.islice(WORDS.finditer(text), words - 1, None)
                text = text[: next(ends).end()]
            texts.append(text)
        yield pa.RecordBatch.from_arrays([*batch.columns[2:], pa.array(texts, pa.string())], names=[*batch.schema.names[2:], "text"])


def _numbered(rows: DataFrame, group: list[str], salts: int = 1024) -> DataFrame:
    """Number the rows of each group from 0; a group of any size is spread over ``salts`` parts."""
    dealt = cut_lineage(rows.withColumn("nth", F.monotonically_increasing_id())).withColumn("salt", F.pmod("nth", F.lit(salts)))
    local = dealt.withColumn("number", F.row_number().over(Window.partitionBy(*group, "salt").orderBy("nth")) - 1)
    before = Window.partitionBy(*group).orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    shifts = dealt.groupBy(*group, "salt").agg(F.count(F.lit(1)).alias("n")).withColumn("shift", F.coalesce(F.sum("n").over(before), F.lit(0)))
    shifts = shifts.select(*[F.col(g).alias(f"of_{g}") for g in group], F.col("salt").alias("of_salt"), "shift")
    same = F.col("salt") == F.col("of_salt")
    for g in group:
        same &= F.col(g).eqNullSafe(F.col(f"of_{g}"))
    return local.join(shifts, same).withColumn("number", F.col("number") + F.col("shift"))


def realised(docs: DataFrame, mixed: DataFrame, id_column: str = "doc_id", text_column: str = "text", source_column: str = "source") -> DataFrame:
    """The mix as rows of ``docs``: a row that takes n times its words comes n times, and once more cut to the rest.

    The cut row keeps the words of the chosen blocks, which are its first. Rows with nothing taken go. Rows that share
    id, source and text share what they take together: the first take what a whole row takes, one the rest. Null is an
    id and a source of its own; an empty table gives no rows; further columns may have any names.
    """
    keys = F.col(id_column).alias("of_id"), F.col(source_column).alias("of_source"), F.col("text_crc32").alias("of_crc")
    taken = mixed.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), F.sum("taken").alias("taken"), F.max("size").alias("size"), F.max("passes").alias("passes")).where("taken > 0")
    names = [f"c{i}" for i in range(len(docs.columns))]
    own = dict(zip(docs.columns, names))
    rows = docs.toDF(*names)
    crc = F.crc32(F.coalesce(F.col(own[text_column]), F.lit("")).cast("binary"))
    both = rows.join(taken, F.col(own[id_column]).eqNullSafe(F.col("of_id")) & F.col(own[source_column]).eqNullSafe(F.col("of_source")) & (crc == F.col("of_crc")))
    facts = ["rows", "taken", "size", "passes", "number"]
    single = both.where("rows = 1").withColumn("number", F.lit(0).cast("long")).select(*names, *facts)
    several = mixed.groupBy(*keys).count().where("count > 1").limit(1).count()
    if several:
        single = single.unionAll(_numbered(both.where("rows > 1"), ["of_id", "of_source", "of_crc"]).select(*names, *facts))
    more = F.expr("taken - passes * size * rows")  # beyond the passes that every row of the group has
    full = F.expr("(taken - passes * size * rows) div size")
    whole = (F.col("passes") + F.when(F.col("number") < full, 1).otherwise(0)).cast("int")
    rest = F.when(F.col("number") == full, (more % F.col("size")).cast("int")).otherwise(F.lit(0))
    copies = F.concat(F.array_repeat(F.lit(None).cast("int"), whole), F.when(rest > 0, F.array(rest)).otherwise(F.array().cast("array<int>")))
    others = [c for c in docs.columns if c != text_column]
    kinds = ", ".join(f"{own[c]} {docs.schema[c].dataType.simpleString()}" for c in others)
    cut = single.select(own[text_column], F.explode(copies).alias("words"), *[own[c] for c in others]).mapInArrow(_cut, f"{kinds}, text string")
    return cut.select(*[F.col("text" if c == text_column else own[c]).alias(c) for c in docs.columns])


ship(__name__)
