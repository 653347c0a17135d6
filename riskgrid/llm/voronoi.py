"""Exact top-k search: a Voronoi join of queries and data on shared pivots."""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from riskgrid.llm.shared import ship
from riskgrid.llm.vectors import matrix, packed, unpacked, usable
from riskgrid.session import cut_lineage

#: Rows of queries, and of data, that meet in one task at most; rows of a task's product at a time.
QUERIES_PER_CELL, DATA_PER_CELL, BLOCK = 8192, 16_384, 512
#: Largest whole number up to which all are doubles, and where 64 bits end.
EXACT, ENDS, LARGEST = 2.0**53, (-(1 << 63), (1 << 63) - 1), sys.float_info.max


def quantised(vector: str, scale: int = 256) -> Column:
    """floor(scale * x) of every component: whole numbers as doubles, so that those of any size are kept exactly."""

    def floor(x: Column) -> Column:
        wide = F.lit(float(scale)) * x.cast("double")
        return F.when(F.abs(wide) < EXACT, F.floor(wide).cast("double")).otherwise(F.least(F.greatest(wide, F.lit(-LARGEST)), F.lit(LARGEST)))

    return F.transform(F.col(vector), floor)


def _distances(points: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    square = (points**2).sum(1)[:, None] + (pivots**2).sum(1)[None, :] - 2 * points @ pivots.T
    return np.sqrt(np.maximum(square, 0))


def _lifted(rows: np.ndarray, reach: float) -> np.ndarray:
    """Data with one more component that brings every row to length ``reach``: nearest is then highest product."""
    return np.concatenate([rows, np.sqrt(np.maximum(reach**2 - (rows**2).sum(1), 0))[:, None]], 1)


def _flat(rows: np.ndarray) -> np.ndarray:
    return np.concatenate([rows, np.zeros((len(rows), 1))], 1)


def _assign(pivots: np.ndarray, unit: float, reach: float):
    """Each data row's nearest pivot and the distance to it."""

    def run(batches):
        for batch in batches:
            rows = matrix(batch.column(1))
            if len(rows):
                away = _distances(_lifted(rows / unit, reach), pivots)
                cell = away.argmin(1)
                yield pa.RecordBatch.from_pydict({"id": batch.column(0), "vector": packed(rows.astype("<f8")), "cell": pa.array(cell, pa.int32()), "far": pa.array(away[np.arange(len(rows)), cell])})

    return run


def _ask(pivots: np.ndarray, unit: float, inner: np.ndarray, outer: np.ndarray, near: tuple[np.ndarray, np.ndarray], chunks: np.ndarray, k: int, slack: float):
    """Send each query to the chunks of the data cells that may hold one of its ``k`` nearest rows."""

    def run(batches):
        for batch in batches:
            rows = matrix(batch.column(1))
            if not len(rows):
                continue
            away = _distances(_flat(rows / unit), pivots)
            if near is not None and len(near[0]) > k:
                # k+1 rows lie within the bound: the query itself may be one of them
                bound = np.partition(away[:, near[0]] + near[1][None, :], k, axis=1)[:, k] + slack
                wanted = np.maximum(away - outer[None, :], inner[None, :] - away) <= bound[:, None]
            else:
                wanted = np.ones(away.shape, bool)
            row, cell = np.nonzero(wanted & (chunks > 0)[None, :])
            times = chunks[cell]
            row, cell = np.repeat(row, times), np.repeat(cell, times)
            chunk = np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times)
            vectors = pa.array(packed(rows.astype("<f8")))
            for a in range(0, len(row), 20_000):
                some = pa.array(row[a : a + 20_000])
                yield pa.RecordBatch.from_pydict({"id": batch.column(0).take(some), "vector": vectors.take(some), "cell": pa.array(cell[a : a + 20_000], pa.int32()), "chunk": pa.array(chunk[a : a + 20_000], pa.int32())})

    return run


def _products(q: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers, exact; beyond 64 bits they are its ends."""
    with np.errstate(over="ignore"):
        top = float(np.abs(q).max()) * float(np.abs(d).max()) * q.shape[1]
    if top < EXACT:
        return (q @ d.T).astype(np.int64)
    whole = lambda x: np.array([[int(v) for v in row] for row in x.tolist()], dtype=object).reshape(x.shape)
    exact = whole(q) @ whole(d).T
    return np.array([[min(max(v, ENDS[0]), ENDS[1]) for v in row] for row in exact.tolist()], np.int64).reshape(len(q), len(d))


def _solve(k: int):
    def run(_key, queries: pa.Table, data: pa.Table) -> pa.Table:
        out = {"query_id": [], "id": [], "score": []}
        if queries.num_rows and data.num_rows:
            q_id, d_id = queries.column("id").to_numpy(), data.column("id").to_numpy()
            order = np.argsort(d_id, kind="stable")
            q, d = unpacked(queries.column("vector"), "<f8"), unpacked(data.column("vector"), "<f8")[order]
            d_id = d_id[order]
            for a in range(0, len(q), BLOCK):
                ids = q_id[a : a + BLOCK]
                for i, s in enumerate(_products(q[a : a + BLOCK], d)):
                    others = np.flatnonzero(d_id != ids[i])
                    room = min(k, len(others))
                    if not room:
                        continue
                    own = s[others]
                    least = np.partition(own, len(own) - room)[len(own) - room]
                    at = np.flatnonzero(own >= least)
                    # from the highest, ties in order of id; ~ turns the order of all 64-bit numbers round
                    at = others[at[np.argsort(~own[at], kind="stable")[:room]]]
                    out["query_id"] += [ids[i]] * len(at)
                    out["id"] += d_id[at].tolist()
                    out["score"] += s[at].tolist()
        return pa.table({n: pa.array(x, pa.int64()) for n, x in out.items()})

    return run


def top_k(data: DataFrame, is_query: Column, id_column: str = "vec_id", vector_column: str = "embedding", k: int = 5, scale: int = 256, pivots: int = 48) -> DataFrame:
    """For each query row the ``k`` rows of highest inner product, by integer components floor(scale * x).

    Inner products become distances: data rows get one more component that brings all to one length, so the nearest
    row is the one of highest product. ``pivots`` rows (more as the table grows) split the data into cells; of a cell only its
    nearest and furthest distance from the pivot and the k+1 smallest are summed up. They bound how far a query's k-th
    neighbour can be, and a query is sent to a cell only if the triangle inequality leaves some of it within that bound.
    Data rows stay in their cell and are sent once (once for each 8192 queries); large cells are cut into chunks. Of equal
    vectors only the k+1 smallest ids can be in a result, so only they take part.

    Returns query_id, rank (from 1), id, score; ties to the smaller id. Vectors that are null, empty or hold a null or
    non-finite component take no part, nor do rows without id; rows of one id are one row (the smallest vector counts)
    and never their own result; vectors of other lengths than the query's are not candidates; fewer than k candidates
    give fewer rows; an empty table gives none. Other columns are ignored. Whole numbers of any size are multiplied exactly;
    a score beyond 64 bits is the nearest number of 64 bits, and such scores tie. (A component whose product with ``scale``
    is beyond a double counts as the largest double.)
    """
    spark = data.sparkSession
    out = "query_id long, rank int, id long, score long"
    rows = data.where(usable(vector_column) & F.col(id_column).isNotNull()).select(F.col(id_column).cast("long").alias("id"), quantised(vector_column, scale).alias("vector"), F.coalesce(is_query, F.lit(False)).alias("is_query"))
    rows = cut_lineage(rows.groupBy("id").agg(F.min("vector").alias("vector"), F.max("is_query").alias("is_query")))
    found = []
    for (length,) in rows.select(F.size("vector")).distinct().collect():
        found.append(_of_length(rows.where(F.size("vector") == length), k, pivots))
    if not found:
        return spark.createDataFrame([], out)
    result = found[0]
    for other in found[1:]:
        result = result.unionAll(other)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return result.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "id", "score")


def _of_length(rows: DataFrame, k: int, pivots: int) -> DataFrame:
    # equal vectors: k+1 smallest ids, chosen within hash parts first so that no group of copies meets in one task
    for salt in (["_salt"], []):
        first = Window.partitionBy("vector", *salt).orderBy("id")
        dealt = rows.withColumn("_salt", F.pmod(F.xxhash64("id"), F.lit(1024))) if salt else slim
        slim = dealt.withColumn("_n", F.row_number().over(first)).where((F.col("_n") <= k + 1) | F.col("is_query")).drop("_n")
    # queries among the later copies stay as queries only
    slim = cut_lineage(slim.withColumn("_data", F.row_number().over(Window.partitionBy("vector").orderBy("id")) <= k + 1).drop("_salt"))
    unit, count, asking = slim.agg(F.max(F.array_max(F.transform("vector", F.abs))), F.count_if("_data"), F.count_if("is_query")).first()
    unit = float(unit) or 1.0  # distances are taken in this unit, so that none overflows
    reach = float(slim.agg(F.sqrt(F.max(F.aggregate("vector", F.lit(0.0), lambda s, x: s + (x / unit) * (x / unit))))).first()[0]) * (1 + 1e-12) + 1e-12
    pivots = max(pivots, min(1024, count // DATA_PER_CELL))
    chosen = [r[0] for r in slim.where("_data").orderBy(F.xxhash64(F.lit(5), "id"), "id").limit(pivots).select("vector").collect()]
    centres = _flat(np.array(chosen, float) / unit)
    cells = cut_lineage(slim.where("_data").select("id", "vector").mapInArrow(_assign(centres, unit, reach), "id long, vector binary, cell int, far double"))
    inner, outer, chunks = np.zeros(len(centres)), np.zeros(len(centres)), np.zeros(len(centres), int)
    for r in cells.groupBy("cell").agg(F.min("far"), F.max("far"), F.count(F.lit(1))).collect():
        inner[r[0]], outer[r[0]], chunks[r[0]] = r[1], r[2], -(-r[3] // DATA_PER_CELL)
    close = Window.partitionBy("cell").orderBy("far")
    salted = Window.partitionBy("cell", F.pmod(F.xxhash64("id"), F.lit(1024))).orderBy("far")
    nearest = cells.select("cell", "far", "id").withColumn("_n", F.row_number().over(salted)).where(F.col("_n") <= k + 1).withColumn("_n", F.row_number().over(close)).where(F.col("_n") <= k + 1).select("cell", "far").collect()
    near = (np.array([r[0] for r in nearest]), np.array([r[1] for r in nearest]))
    if unit * unit * centres.shape[1] >= 2.0**62:
        near = None  # scores may tie at the ends of 64 bits, which distances don't know
    asked = slim.where("is_query").select("id", "vector").mapInArrow(_ask(centres, unit, inner, outer, near, chunks, k, reach * 1e-7), "id long, vector binary, cell int, chunk int")
    parts = max(1, -(-asking // QUERIES_PER_CELL))
    keys = ["cell", "chunk", "part"]
    asked = asked.select("cell", "chunk", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int").alias("part"), "id", "vector")
    in_cell = F.element_at(F.array(*[F.lit(max(1, int(c))) for c in chunks]), F.col("cell") + 1)
    sent = cells.select("cell", F.pmod(F.xxhash64("id"), in_cell).cast("int").alias("chunk"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), "id", "vector")
    return asked.groupBy(*keys).cogroup(sent.groupBy(*keys)).applyInArrow(_solve(k), "query_id long, id long, score long")


ship(__name__)
