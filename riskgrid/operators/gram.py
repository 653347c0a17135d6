"""Sums of products of many columns at once, over the rows in which both columns have a value."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Columns of a tile; a pass over the data handles the pairs of two tiles.
TILE = 512
#: What is summed for a pair: rows, both columns, their product and squares.
SUMS = ("n", "sa", "sb", "sab", "saa", "sbb")
SCHEMA = pa.schema([("i", pa.int32()), ("j", pa.int32()), ("n", pa.int64()), *[(c, pa.float64()) for c in SUMS[1:]]])


def _tile(first: int, second: int, width: int, centre: np.ndarray):
    """Sums of each task's rows for the columns of two tiles; batches hold the first tile's columns, then the second's."""

    def run(batches: Iterator[pa.RecordBatch]):
        total = None
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns], 1) - centre
            here = np.isfinite(x)
            x = np.where(here, x, 0.0)
            mask = here.astype(float)
            a, b = slice(0, width), slice(0 if first == second else width, None)
            xa, xb, ma, mb = x[:, a], x[:, b], mask[:, a], mask[:, b]
            part = np.stack([ma.T @ mb, xa.T @ mb, ma.T @ xb, xa.T @ xb, (xa * xa).T @ mb, ma.T @ (xb * xb)])
            total = part if total is None else total + part
        if total is not None:
            i, j = np.meshgrid(np.arange(total.shape[1]) + first, np.arange(total.shape[2]) + second, indexing="ij")
            keep = i < j
            values = {"i": i[keep].astype(np.int32), "j": j[keep].astype(np.int32), "n": total[0][keep].astype(np.int64)}
            yield pa.RecordBatch.from_pydict(values | {c: total[k][keep] for k, c in enumerate(SUMS) if k}, schema=SCHEMA)

    return run


def pair_sums(df: DataFrame, columns: Sequence[str], tile: int = TILE) -> DataFrame:
    """Of every pair of columns i < j the sums over rows in which both are finite: n, sa, sb, sab, saa, sbb.

    Columns are dealt to tiles of ``tile``; each pair of tiles is one pass over those columns only, in which a task multiplies
    blocks of rows (missing values as zeros beside a mask) and sends one row a pair of columns, summed before the shuffle. A
    task holds six numbers for each pair of two tiles' columns, whatever the rows. Values are taken
    relative to the columns' means, which keeps the later subtractions exact; correlations don't notice.
    """
    typed = df.select(*[F.col(c).cast("double").alias(c) for c in columns])
    finite = lambda c: F.when(F.abs(c) < float("inf"), F.col(c))
    means = typed.agg(*[F.coalesce(F.avg(finite(c)), F.lit(0.0)).alias(c) for c in columns]).first()
    centre = np.array([means[c] for c in columns], float)
    out = None
    starts = range(0, len(columns), tile)
    for first in starts:
        for second in (s for s in starts if s >= first):
            near = list(range(first, min(first + tile, len(columns))))
            far = [] if second == first else list(range(second, min(second + tile, len(columns))))
            part = typed.select(*[columns[k] for k in [*near, *far]]).mapInArrow(_tile(first, second, len(near), centre[[*near, *far]]), "i int, j int, n long, sa double, sb double, sab double, saa double, sbb double")
            out = part if out is None else out.unionAll(part)
    return out.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in SUMS])


def correlations(df: DataFrame, columns: Sequence[str], tile: int = TILE, constant: float | None = None) -> DataFrame:
    """Pearson r of every pair i < j over pairwise complete rows: i, j, a, b, r (``constant`` where a column is, null where no row has both)."""
    sums = pair_sums(df, columns, tile)
    n = F.col("n").cast("double")
    spread = lambda s, ss: F.col(ss) - F.try_divide(F.col(s) * F.col(s), n)
    # what rounding leaves of a constant column's spread is no spread
    flat = lambda s, ss: spread(s, ss) <= F.col(ss) * 1e-12
    r = F.when(~flat("sa", "saa") & ~flat("sb", "sbb"), (F.col("sab") - F.try_divide(F.col("sa") * F.col("sb"), n)) / F.sqrt(spread("sa", "saa") * spread("sb", "sbb")))
    r = r if constant is None else r.when(n > 0, F.lit(constant))
    names = F.array(*[F.lit(c) for c in columns])
    return sums.select("i", "j", F.get(names, F.col("i")).alias("a"), F.get(names, F.col("j")).alias("b"), r.alias("r"))
