"""Exact ordered statistics without sorting a group in one task.

Quantiles are selected digit by digit from the ordered bits of the values.  For
running sums, values are dealt to slots by value: a coarse slot between the group's
bounds, then a finer one inside coarse slots that hold many rows; only slot totals are
ordered across a group, and rows are sorted within their slot only.  Every
quantity the slots depend on (minimum, maximum, counts) is independent of
evaluation order, so a recomputed task lands on the same slots.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from riskgrid.session import sized_side

FANOUT = 1024
ROWS_PER_SLOT = 50_000


def _slot(value: Column, low: Column, high: Column, slots: Column) -> Column:
    """Index 0..slots-1 of ``value`` between ``low`` and ``high``, never decreasing in value."""
    share = F.coalesce(F.try_divide(value - low, high - low), F.lit(0.0))
    raw = F.floor(share * slots)
    return F.greatest(F.least(raw, slots - 1), F.lit(0)).cast("bigint")


def running_by_value(
    df: DataFrame,
    groups: Sequence[str],
    value: str,
    sums: Sequence[str],
    bounds: tuple[float, float] | None = None,
    fanout: int = FANOUT,
    rows_per_slot: int = ROWS_PER_SLOT,
) -> DataFrame:
    """Add ``before_<s>`` (sum over smaller values) and ``total_<s>`` (sum over the group).

    ``df`` holds one row per (groups, value).  ``bounds`` spares the pass for the
    group minimum and maximum where they are known, e.g. (0, 1) for scores.
    """
    g = list(groups)
    if bounds is None:
        ends = df.groupBy(*g).agg(F.min(value).alias("__lo"), F.max(value).alias("__hi"))
        coarse = df.join(ends, g) if g else df.select("*", *[ends.select(c).scalar().alias(c) for c in ("__lo", "__hi")])
        low, high = F.col("__lo"), F.col("__hi")
    else:
        coarse, low, high = df, F.lit(bounds[0]), F.lit(bounds[1])
    coarse = coarse.select(*df.columns, _slot(F.col(value), low, high, F.lit(fanout)).alias("__s0"))

    ordered = Window.partitionBy(*g).orderBy("__s0").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*g)
    level0 = (
        coarse.groupBy(*g, "__s0")
        .agg(
            F.min(value).alias("__lo1"),
            F.max(value).alias("__hi1"),
            F.ceil(F.count(F.lit(1)) / F.lit(rows_per_slot)).alias("__slots1"),
            *[F.sum(s).alias(f"__t_{s}") for s in sums],
        )
        .select(
            *g,
            "__s0",
            "__lo1",
            "__hi1",
            "__slots1",
            *[F.coalesce(F.sum(f"__t_{s}").over(ordered), F.lit(0)).alias(f"__o0_{s}") for s in sums],
            *[F.sum(f"__t_{s}").over(whole).alias(f"total_{s}") for s in sums],
        )
    )
    fine = coarse.join(level0, [*g, "__s0"]).withColumn(
        "__s1", _slot(F.col(value), F.col("__lo1"), F.col("__hi1"), F.col("__slots1"))
    )
    ordered1 = Window.partitionBy(*g, "__s0").orderBy("__s1").rowsBetween(Window.unboundedPreceding, -1)
    level1 = (
        fine.groupBy(*g, "__s0", "__s1")
        .agg(*[F.sum(s).alias(f"__t_{s}") for s in sums])
        .select(*g, "__s0", "__s1", *[F.coalesce(F.sum(f"__t_{s}").over(ordered1), F.lit(0)).alias(f"__o1_{s}") for s in sums])
    )
    inner = Window.partitionBy(*g, "__s0", "__s1").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    placed = fine.join(level1, [*g, "__s0", "__s1"])
    return placed.select(
        *df.columns,
        *[
            (F.coalesce(F.sum(s).over(inner), F.lit(0)) + F.col(f"__o0_{s}") + F.col(f"__o1_{s}")).alias(f"before_{s}")
            for s in sums
        ],
        *[f"total_{s}" for s in sums],
    )


MANTISSA, SMALLEST, UPPERMOST = 1 << 52, 2.0**-1022, 2047
#: Bits of an ordered number that one level of the selection tells apart, and its levels.
DIGIT, LEVELS = 16, 4


def ordered_bits(value: Column) -> Column:
    """The bits of a double as a whole number of the same order; not-a-number comes last, both zeros are one.

    Exponent and mantissa are taken apart by exact arithmetic: powers of two are exact, and so is a division by them.
    """
    size = F.abs(value)
    near = F.floor(F.log2(size))
    step = F.pow(F.lit(2.0), near)
    exponent = near - F.when(size < step, 1).otherwise(0) + F.when(size >= step * 2, 1).otherwise(0)
    normal = (exponent.cast("bigint") + 1023) * F.lit(MANTISSA) + ((size / F.pow(F.lit(2.0), exponent) - 1) * F.lit(float(MANTISSA))).cast("bigint")
    tiny = (size * F.lit(2.0**537) * F.lit(2.0**537)).cast("bigint")
    bits = F.when(F.isnan(value), F.lit(UPPERMOST * MANTISSA + 1)).when(size == float("inf"), F.lit(UPPERMOST * MANTISSA)).when(size < SMALLEST, tiny).otherwise(normal)
    return F.when(value < 0, -bits).otherwise(bits)


def double_of(bits: Column) -> Column:
    """The double whose ``ordered_bits`` these are."""
    size = F.abs(bits)
    exponent, mantissa = F.shiftright(size, 52), (size % F.lit(MANTISSA)).cast("double")
    normal = (F.lit(1.0) + mantissa / float(MANTISSA)) * F.pow(F.lit(2.0), exponent - 1023)
    ending = F.when(mantissa == 0, F.lit(float("inf"))).otherwise(F.lit(float("nan")))
    value = F.when(exponent == 0, mantissa * F.lit(2.0**-537) * F.lit(2.0**-537)).when(exponent == UPPERMOST, ending).otherwise(normal)
    return F.when(bits < 0, -value).otherwise(value)


def exact_quantiles(df: DataFrame, groups: Sequence[str], columns: Sequence[str], probabilities: Sequence[float]) -> DataFrame:
    """Linear-interpolation quantiles of several columns for groups of any size and distribution.

    Radix selection: the values' ordered bits are told apart digit by digit, 16 bits a level. Each level is one pass over
    the input that counts, combined before the shuffle, the rows of each digit below the prefixes that hold a wanted rank,
    and keeps the digits that hold one. So four levels end at single values whatever the distribution, no task
    ever orders more than the 65 536 digits of a prefix, and no values are sorted.
    Returns (groups, variable, q0, q1, ...) in the order of ``probabilities``. Nulls don't count; a column without values
    has no row.
    """
    keys = [*groups, "variable"]
    wide = df.select(*groups, *[F.col(c).cast("double").alias(c) for c in columns])
    rows = wide.unpivot(list(groups), list(columns), "variable", "value").filter(F.col("value").isNotNull()).select(*keys, ordered_bits(F.col("value")).alias("__bits"))
    spots = lambda n: [f(F.lit(float(p)) * (n - 1)).cast("bigint") for p in probabilities for f in (F.floor, F.ceil)]
    found = None
    for level in range(LEVELS):
        digit = F.shiftright("__bits", 64 - DIGIT * (level + 1)).alias("__digit")
        if found is None:
            counts = rows.groupBy(*keys, digit).agg(F.count(F.lit(1)).alias("__c"))
            below = Window.partitionBy(*keys)
            counts = counts.select("*", F.lit(0).cast("bigint").alias("__p"), F.sum("__c").over(below).alias("__n"))
        else:
            inside = rows.join(found, [F.col(k).eqNullSafe(F.col(f"__of_{k}")) for k in keys] + [F.shiftright("__bits", 64 - DIGIT * level) == F.col("__prefix")])
            counts = inside.groupBy(*keys, "__prefix", digit).agg(F.count(F.lit(1)).alias("__c"), F.max("__before").alias("__p"), F.max("__total").alias("__n"))
            below = Window.partitionBy(*keys, "__prefix")
        earlier = F.coalesce(F.sum("__c").over(below.orderBy("__digit").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        placed = counts.withColumn("__before", F.col("__p") + earlier)
        holds = lambda spot: (spot >= F.col("__before")) & (spot < F.col("__before") + F.col("__c"))
        wanted = placed.filter(F.exists(F.array(*spots(F.col("__n"))), holds))
        if level < LEVELS - 1:
            found = sized_side(wanted.select(*[F.col(k).alias(f"__of_{k}") for k in keys], F.col("__digit").alias("__prefix"), "__before", F.col("__n").alias("__total")))
    value = double_of(F.col("__digit"))
    picks = [F.max(F.when(holds(spot), value)).alias(f"__v{i}") for i, spot in enumerate(spots(F.col("__n")))]
    result = wanted.groupBy(*keys).agg(F.max("__n").alias("__n"), *picks)

    def between(i: int, p: float) -> Column:
        spot = F.lit(float(p)) * (F.col("__n") - 1)
        a, b = F.col(f"__v{2 * i}"), F.col(f"__v{2 * i + 1}")
        return (a + (b - a) * (spot - F.floor(spot))).alias(f"q{i}")

    return result.select(*keys, *[between(i, p) for i, p in enumerate(probabilities)])


def spread_ranks(df: DataFrame, groups: Sequence[str], key: Sequence[str], name: str, blocks: int = 256) -> DataFrame:
    """Number the rows of each group from 0 in a hash order of ``key``, without a group ever meeting in one task.

    Rows are numbered within hash blocks and shifted by the group's rows in earlier blocks. Rows of one key are told apart
    by their other columns; equal rows get any of their numbers. ``df`` is read twice, so it should be stored.
    """
    g = list(groups)
    dealt = df.withColumn("__h", F.xxhash64(*key)).withColumn("__block", F.pmod("__h", F.lit(blocks)))
    rest = [c for c in df.columns if c not in g]
    local = dealt.withColumn("__at", F.row_number().over(Window.partitionBy(*g, "__block").orderBy("__h", *rest)) - 1)
    counts = dealt.groupBy(*g, "__block").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*g).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    shifts = counts.select(*[F.col(c).alias(f"__of_{c}") for c in g], F.col("__block").alias("__of"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__shift"))
    placed = local.join(shifts, [F.col(c).eqNullSafe(F.col(f"__of_{c}")) for c in g] + [F.col("__block") == F.col("__of")])
    return placed.select(*df.columns, (F.col("__at") + F.col("__shift")).cast("bigint").alias(name))


def bounded_quantiles(df: DataFrame, groups: Sequence[str], columns: Sequence[str], probabilities: Sequence[float]) -> DataFrame:
    """The same table for groups with a bounded number of distinct values.

    A daily panel grouped by entity qualifies (one value per day).  One
    aggregate, no unpivoted rows: ``percentile`` merges value counts map-side.
    """
    g = list(groups)
    probs = F.array(*[F.lit(float(p)) for p in probabilities])
    wide = df.groupBy(*g).agg(*[F.percentile(F.col(c), probs).alias(c) for c in columns])
    rows = F.array(
        *[
            F.struct(F.lit(c).alias("variable"), *[F.col(c)[i].alias(f"q{i}") for i in range(len(probabilities))])
            for c in columns
        ]
    )
    return wide.select(*g, F.inline(rows))

