"""Sharding: a keyed permutation of global row numbers that gives shard and slot by arithmetic."""

from __future__ import annotations

from math import isqrt

from pyspark.sql import Column, DataFrame, functions as F

from riskgrid.llm.shared import ranked
from riskgrid.session import cut_lineage

ROUNDS = 6


def _mix(seed: int, step: int, value: Column, size: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), F.lit(step), value.cast("long")), F.lit(size))


def _sides(rows: int) -> tuple[int, int]:
    """A rectangle a x b that holds the row numbers with less than one column to spare."""
    a = max(1, isqrt(max(0, rows - 1)) + 1)
    return a, max(1, -(-rows // a))


def _once(x: Column, rows: int, seed: int, back: bool) -> Column:
    a, b = _sides(rows)
    right = F.pmod(x, F.lit(b))
    left = F.floor((x - right) / F.lit(b)).cast("long")
    for step in reversed(range(ROUNDS)) if back else range(ROUNDS):
        if step % 2:
            change = _mix(seed, step, left, b)
            right = F.pmod(right - change if back else right + change, F.lit(b))
        else:
            change = _mix(seed, step, right, a)
            left = F.pmod(left - change if back else left + change, F.lit(a))
    return left * F.lit(b) + right


def permuted(number: Column, rows: int, seed: int = 7, back: bool = False) -> Column:
    """The place of row ``number`` (0 to rows - 1) in the shuffle of ``seed``; with ``back`` the row at a place.

    An unbalanced Feistel network permutes the rectangle around [0, rows); a value that falls outside walks along its
    cycle until it is inside. At most ``a*b - rows`` values lie outside, which bounds the walk; 64 steps are allowed
    (a longer walk, of probability below rows^-30, raises an error instead of giving a wrong place).
    """
    a, b = _sides(rows)
    steps = min(64, a * b - rows)
    start = _once(number.cast("long"), rows, seed, back)
    if not steps:
        return start
    end = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, lambda x, _: F.when(x < rows, x).otherwise(_once(x, rows, seed, back)))
    return F.when(end < rows, end).otherwise(F.raise_error(F.lit("cycle walk too long")).cast("long"))


def shard(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", shards: int = 8, seed: int = 7) -> DataFrame:
    """Put every row into one of ``shards`` shards by law ``rows``: shard sizes differ by one row at most.

    Rows get global numbers (by hash block, then id; see ``shared.ranked``), the numbers are permuted by ``permuted``,
    and place p is shard ``p mod shards``, slot ``p div shards``: both follow from the row number alone, and
    ``permuted(back=True)`` finds the row of a given shard and slot. Equal rows, seed and shard count give the same result.

    Returns the id, size (UTF-8 bytes of the text plus 1), text_crc32, row_number, law, shard, slot, grown_shard (null:
    only law ``key`` promises where one more shard would take rows from). A null text counts as empty (size 1); a null
    id is a value like others; repeated rows are separate rows, and equal texts are spread like other rows; an empty
    table gives no rows. Other columns are ignored.
    """
    text = F.coalesce(F.col(text_column), F.lit(""))
    facts = cut_lineage(docs.select(F.col(id_column), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32")))
    rows = facts.count()
    numbered = ranked(facts, [], [id_column, "text_crc32", "size"], "row_number")
    place = permuted(F.col("row_number"), rows, seed)
    return numbered.withColumn("_p", place).select(
        id_column, "size", "text_crc32", "row_number", F.lit("rows").alias("law"),
        F.pmod("_p", F.lit(shards)).cast("int").alias("shard"),
        F.expr(f"_p div {shards}").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
