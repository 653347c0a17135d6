"""Isotonic regression for groups of any size: neighbours are pooled within blocks, then the blocks' pools across shifted blocks."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

from riskgrid.operators.order import running_by_value
from riskgrid.session import cut_lineage

#: Pools that a task looks at together.
BLOCK = 20_000


def pool(rows: Iterable[tuple]) -> list[list]:
    """Pool adjacent violators of rows (low, high, total, weight) in order; means rise strictly afterwards.

    Means are compared by cross products, so whole numbers are compared exactly.
    """
    out: list[list] = []
    for low, high, total, weight in rows:
        out.append([low, high, total, weight])
        while len(out) > 1 and out[-2][2] * out[-1][3] >= out[-1][2] * out[-2][3]:
            _, top, more, heavier = out.pop()
            last = out[-1]
            last[1], last[2], last[3] = top, last[2] + more, last[3] + heavier
    return out


def isotonic_steps(df: DataFrame, groups: Sequence[str], x: str, y: str, weight: str | None = None, block: int = BLOCK) -> DataFrame:
    """The rising step function of least squares of ``y`` on ``x`` in each group: low, high, value, total, weight of each step.

    Rows of one x are summed first. Sums in order may be pooled in any sequence with the same result, so blocks of ``block``
    neighbours are pooled by one task each; what is left is numbered anew and pooled in blocks shifted by a half, until no block
    ends above the next one's start. No task sees more than a block, however many distinct x a group has. Rows with
    a null (or not-a-number) x or y, and those without weight, don't count.
    """
    g = list(groups)
    w = F.col(weight).cast("double") if weight else F.lit(1).cast("bigint")
    value = F.col(y) if weight is None else F.col(y) * w
    sound = F.col(x).isNotNull() & ~F.isnan(F.col(x).cast("double")) & F.col(y).isNotNull()
    rows = df.filter(sound & (w > 0)).groupBy(*g, F.col(x).cast("double").alias("low")).agg(F.sum(value).alias("total"), F.sum(w).alias("weight"))
    kind = {c: t for c, t in rows.dtypes}
    placed = running_by_value(cut_lineage(rows).withColumn("one", F.lit(1).cast("bigint")), g, "low", ["one"])
    state = placed.select(*g, F.col("before_one").alias("place"), "low", F.col("low").alias("high"), "total", "weight")
    schema = ", ".join(f"`{c}` {df.schema[c].dataType.simpleString()}" for c in g)
    schema = f"{schema}{', ' if g else ''}part long, place long, low double, high double, total {kind['total']}, weight {kind['weight']}"

    def pooled(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("place")
        done = pool(zip(*[part[c].tolist() for c in ("low", "high", "total", "weight")]))
        out = pd.DataFrame(done, columns=["low", "high", "total", "weight"])
        head = {c: part[c].iloc[0] for c in [*g, "part"]}
        return out.assign(**head, place=range(len(out)))[[*g, "part", "place", "low", "high", "total", "weight"]]

    shift = 0
    while True:
        dealt = state.withColumn("part", F.floor((F.col("place") + shift) / block).cast("bigint"))
        done = cut_lineage(dealt.groupBy(*g, "part").applyInPandas(pooled, schema))
        ends = done.groupBy(*g, "part").agg(F.count(F.lit(1)).alias("pools"), F.min_by(F.struct("total", "weight"), "place").alias("first"), F.max_by(F.struct("total", "weight"), "place").alias("last"))
        order = Window.partitionBy(*g).orderBy("part")
        before = F.coalesce(F.sum("pools").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        ends = cut_lineage(ends.select(*g, "part", before.alias("start"), "first", F.lag("last").over(order).alias("previous")))
        exact = lambda a, b: F.col(a).cast("double") * F.col(b).cast("double")
        fall = exact("previous.total", "first.weight") >= exact("first.total", "previous.weight")
        broken = ends.filter(F.col("previous").isNotNull() & fall).limit(1).count()
        if not broken:
            return done.select(*g, "low", "high", (F.col("total") / F.col("weight")).alias("value"), "total", "weight")
        state = done.join(ends.select(*[F.col(c).alias(f"of_{c}") for c in g], F.col("part").alias("of_part"), "start"), [F.col(c).eqNullSafe(F.col(f"of_{c}")) for c in g] + [F.col("part") == F.col("of_part")])
        state = state.select(*g, (F.col("place") + F.col("start")).alias("place"), "low", "high", "total", "weight")
        shift = block // 2 - shift


def apply_steps(df: DataFrame, steps: DataFrame, groups: Sequence[str], x: str, name: str, slots: int = 1024) -> DataFrame:
    """Add the fitted value at ``x`` (0 to 1): steps joined by straight lines between them, constant beyond the first and last.

    Steps and rows meet by slot of x, in which a row has exactly one interval; a null x gets null, a group without steps too.
    """
    g = list(groups)
    order = Window.partitionBy(*g).orderBy("low")
    nearest = lambda c: F.least(F.greatest(F.floor(c * slots), F.lit(0)), F.lit(slots - 1)).cast("int")
    spans = steps.select(*[F.col(c).alias(f"__of_{c}") for c in g], F.col("low").alias("__low"), F.col("high").alias("__high"), F.col("value").alias("__value"), F.lead("low").over(order).alias("__next"), F.lead("value").over(order).alias("__then"), F.lag("low").over(order).isNull().alias("__first"))
    first = F.when(F.col("__first"), F.lit(0)).otherwise(nearest(F.col("__low")))
    last = F.when(F.col("__next").isNull(), F.lit(slots - 1)).otherwise(nearest(F.col("__next")))
    spans = spans.withColumn("__slot", F.explode(F.sequence(first, last)))
    inside = (F.col("__first") | (F.col(x) >= F.col("__low"))) & (F.col("__next").isNull() | (F.col(x) < F.col("__next")))
    joined = df.join(spans, [F.col(c).eqNullSafe(F.col(f"__of_{c}")) for c in g] + [nearest(F.col(x)) == F.col("__slot"), inside], "left")
    slope = (F.col(x) - F.col("__high")) / (F.col("__next") - F.col("__high"))
    value = F.when(F.col("__next").isNull() | (F.col(x) <= F.col("__high")), F.col("__value")).otherwise(F.col("__value") + (F.col("__then") - F.col("__value")) * slope)
    return joined.select(*[c for c in df.columns if c != name], value.alias(name))
