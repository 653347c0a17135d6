"""Profiles, tests, outliers, correlations and trends as single-pass aggregates."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from riskgrid.functions.nulls import ratio
from riskgrid.operators.order import bounded_quantiles, exact_quantiles
from riskgrid.operators.gram import correlations
from riskgrid.session import cut_lineage, fixed_rows


# ---------------------------------------------------------------- shape helpers


def per_variable(df: DataFrame, by: Sequence[str], columns: Sequence[str], build, filters: Column | None = None) -> DataFrame:
    """Aggregate every column once and return one row per (by, variable).

    ``build(name)`` gives the named aggregates of one column.  The rows are
    built from the finished aggregates, so the input is not unpivoted.
    """
    source = df if filters is None else df.filter(filters)
    aggregates, rows = [], []
    for i, c in enumerate(columns):
        parts = build(c)
        aggregates += [expr.alias(f"__{i}_{name}") for name, expr in parts.items()]
        rows.append(F.struct(F.lit(c).alias("variable"), *[F.col(f"__{i}_{name}").alias(name) for name in parts]))
    return source.groupBy(*by).agg(*aggregates).select(*by, F.inline(F.array(*rows)))


# -------------------------------------------------------------------- profiles


def bias_corrected(n: Column, skew: Column, excess: Column) -> tuple[Column, Column]:
    """Sample skewness (n > 2) and excess kurtosis (n > 3) from the population versions."""
    n = n.cast("double")
    g1 = F.when(n > 2, F.sqrt(n * (n - 1)) / (n - 2) * skew)
    g2 = F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * excess + 6))
    return g1, g2


def entity_profile(df: DataFrame, by: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """n, mean, std, median, skew and kurtosis per entity and column of a bounded panel."""

    def build(c: str) -> dict[str, Column]:
        n = F.count(c)
        g1, g2 = bias_corrected(n, F.skewness(c), F.kurtosis(c))
        return {
            "n": n,
            "mean": F.avg(c),
            "std": F.stddev_samp(c),
            "median": F.percentile(F.col(c), F.lit(0.5)),
            "skew": g1,
            "kurtosis": g2,
        }

    return per_variable(df, by, columns, build)


def describe(df: DataFrame, by: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """count, mean, std, min, quartiles and max per entity and column of a bounded panel."""

    def build(c: str) -> dict[str, Column]:
        quartiles = {q: F.percentile(F.col(c), F.lit(p)) for q, p in (("q1", 0.25), ("median", 0.5), ("q3", 0.75))}
        return {"n": F.count(c), "mean": F.avg(c), "std": F.stddev_samp(c), "min": F.min(c), **quartiles, "max": F.max(c)}

    return per_variable(df, by, columns, build)


def missing_audit(df: DataFrame) -> DataFrame:
    """Nulls, share and type of each column, in one pass."""
    types = dict(df.dtypes)
    out = per_variable(df, [], df.columns, lambda c: {"missing": F.count_if(F.col(c).isNull()), "rows": F.count(F.lit(1))})
    kind = F.create_map(*[F.lit(x) for item in types.items() for x in item])[F.col("variable")]
    return out.select("variable", kind.alias("type"), "missing", (ratio(F.col("missing"), F.col("rows")) * 100).alias("missing_pct"))


def duplicate_count(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows beyond the first of their key."""
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates"))


def histogram(df: DataFrame, value: str, bins: int, by: Sequence[str] = ()) -> DataFrame:
    """Equal-width counts between the global minimum and maximum; the last bin is closed."""
    ends = df.agg(F.struct(F.min(value).alias("lo"), F.max(value).alias("hi")).alias("e")).scalar()
    lo, hi = ends.getField("lo"), ends.getField("hi")
    share = F.coalesce(F.try_divide(F.col(value) - lo, hi - lo), F.lit(0.0))
    slot = F.least(F.floor(share * bins), F.lit(bins - 1)).cast("int")
    counted = df.filter(F.col(value).isNotNull()).groupBy(*by, slot.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    width = (hi - lo) / bins
    return counted.select(*by, "bin", (lo + width * F.col("bin")).alias("bin_from"), "n")


def near_constant(df: DataFrame, columns: Sequence[str], below: float = 0.001) -> DataFrame:
    """Columns whose sample standard deviation is below the limit."""
    out = per_variable(df, [], columns, lambda c: {"std": F.stddev_samp(c)})
    return out.filter(F.col("std") < below)


# ------------------------------------------------------------------ correlation


def correlation_pairs(df: DataFrame, columns: Sequence[str], constant: float | None = None) -> DataFrame:
    """Pearson r of every pair i < j over pairwise complete rows, from tiled sums of products; ``constant`` where a column is."""
    return correlations(df, columns, constant=constant)


def pearson(x: Column, y: Column) -> Column:
    """Pearson r over the rows with both: NaN where one of them is constant, null without such rows.

    ``corr`` divides by zero there, or by what rounding leaves of the spread when partial sums are merged.
    """
    x, y = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)
    spread = F.stddev_pop(x) * F.stddev_pop(y)
    constant = (F.min(x) == F.max(x)) | (F.min(y) == F.max(y)) | (spread == 0)
    return F.when(constant, F.lit(math.nan)).otherwise(F.try_divide(F.covar_pop(x, y), spread))


def target_correlation(df: DataFrame, columns: Sequence[str], target: str) -> DataFrame:
    """Pearson r of every column with the target: NaN where one of them is constant, null where no row has both."""
    y = F.col(target).cast("double")
    return per_variable(df, [], columns, lambda c: {"r": pearson(F.col(c).cast("double"), y)})


def collinear_pairs(pairs: DataFrame, limit: float = 0.9) -> DataFrame:
    return pairs.filter(F.abs("r") > limit)


def prune_correlated(df: DataFrame, columns: Sequence[str], target: str, limit: float = 0.95, constant: float = 0.0) -> list[str]:
    """Columns to drop: of each pair above the limit the one less related to the target (equal to nine digits: the later).

    The statistics are one distributed aggregate; only the matrix (a few
    numbers per column pair) reaches the driver for the order-dependent pass.
    A coefficient with a constant column counts as ``constant``; NaN, as in SQL, is above every number.
    """
    related = {}
    for row in target_correlation(df, columns, target).collect():
        r = 0.0 if row["r"] is None else constant if math.isnan(row["r"]) else row["r"]
        related[row["variable"]] = math.inf if math.isnan(r) else round(abs(r), 9)
    strong = correlation_pairs(df, columns, constant).filter(F.abs("r") > limit).orderBy("i", "j").collect()
    dropped: list[str] = []
    for row in strong:
        a, b = row["a"], row["b"]
        if a in dropped or b in dropped:
            continue
        dropped.append(b if related[a] >= related[b] else a)
    return dropped


# ------------------------------------------------------------------------ tests


def log_gamma(z: Column) -> Column:
    """Logarithm of the gamma function for z > 0: Stirling's series ten steps higher, brought down by the recurrence."""
    high = z + 10
    series = 1 / (12 * high) - 1 / (360 * high**3) + 1 / (1260 * high**5) - 1 / (1680 * high**7)
    steps = F.aggregate(F.sequence(F.lit(0), F.lit(9)), F.lit(0.0), lambda total, k: total + F.log(z + k))
    return (high - 0.5) * F.log(high) - high + 0.5 * math.log(2 * math.pi) + series - steps


def _beta_fraction(a: Column, b: Column, x: Column, rounds: int = 300) -> Column:
    """Continued fraction of the incomplete beta function, two steps a round, from the front (Lentz)."""
    guard = lambda v: F.when(F.abs(v) < 1e-300, F.lit(1e-300)).otherwise(v)
    first = 1 / guard(1 - (a + b) * x / (a + 1))

    def step(at: Column, part: Column) -> Column:
        d = 1 / guard(1 + part * at["d"])
        c = guard(1 + part / at["c"])
        return F.struct(c.alias("c"), d.alias("d"), (at["h"] * d * c).alias("h"))

    def turn(at: Column, m: Column) -> Column:
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        # a list of one element names the first step's result, so it is computed once
        return F.transform(F.array(step(at, even)), lambda half: step(half, odd))[0]

    start = F.struct(F.lit(1.0).alias("c"), first.alias("d"), first.alias("h"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, turn, lambda at: at["h"])


def student_p(t: Column | str, dof: Column | str) -> Column:
    """P(|T| > |t|) for Student's t with real degrees of freedom, in columns; null where either is missing or not positive."""
    t, n = (F.col(c) if isinstance(c, str) else c for c in (t, dof))

    def tail(given: Column) -> Column:
        square, n = given["t"] * given["t"], given["n"]
        a, x, rest = n / 2, n / (n + square), square / (n + square)
        front = F.exp(log_gamma(a + 0.5) - log_gamma(a) - 0.5 * math.log(math.pi) + a * F.log(x) + 0.5 * F.log(rest))
        swapped = x >= (a + 1) / (a + 2.5)
        half = F.lit(0.5)
        low = front * _beta_fraction(a, half, x) / a
        high = 1 - front * _beta_fraction(half, a, rest) / half
        return F.when(square == 0, F.lit(1.0)).when(x == 0, F.lit(0.0)).when(swapped, high).otherwise(low)

    sound = t.isNotNull() & ~F.isnan(t) & (n > 0) & (n < float("inf"))
    return F.when(sound, F.transform(F.array(F.struct(t.alias("t"), n.alias("n"))), tail)[0])


def welch_table(
    df: DataFrame, by: Sequence[str], columns: Sequence[str], label: str, min_events: int = 5, min_group: int = 3
) -> DataFrame:
    """Means, difference, t and degrees of freedom of event rows against other rows.

    All moments come from one aggregate over the panel.
    """
    event, other = F.col(label) == 1, F.col(label) == 0

    def build(c: str) -> dict[str, Column]:
        inside, outside = F.when(event, F.col(c)), F.when(other, F.col(c))
        return {
            "events": F.count_if(event),
            "n1": F.count(inside),
            "n0": F.count(outside),
            "m1": F.avg(inside),
            "m0": F.avg(outside),
            "v1": F.var_samp(inside),
            "v0": F.var_samp(outside),
        }

    table = per_variable(df, by, columns, build)
    table = table.filter((F.col("events") >= min_events) & (F.col("n1") >= min_group) & (F.col("n0") >= min_group))
    s1, s0 = F.col("v1") / F.col("n1"), F.col("v0") / F.col("n0")
    diff = F.col("m1") - F.col("m0")
    return table.select(
        *by,
        "variable",
        F.col("m1").alias("Fire_mean"),
        F.col("m0").alias("NoFire_mean"),
        diff.alias("Diff"),
        F.try_divide(diff, F.sqrt(s1 + s0)).alias("t_stat"),
        F.try_divide((s1 + s0) * (s1 + s0), s1 * s1 / (F.col("n1") - 1) + s0 * s0 / (F.col("n0") - 1)).alias("dof"),
    )


def welch_tests(df: DataFrame, by: Sequence[str], columns: Sequence[str], label: str, alpha: float = 0.05) -> DataFrame:
    """Welch table with the two-sided p-value, computed on the aggregated rows only."""
    out = welch_table(df, by, columns, label).withColumn("p_value", student_p("t_stat", "dof"))
    return out.withColumn("Significant", F.coalesce(F.col("p_value") < alpha, F.lit(False)))


def significant_share(tests: DataFrame) -> DataFrame:
    return tests.groupBy("variable").agg(F.avg(F.col("Significant").cast("int")).alias("share"), F.count(F.lit(1)).alias("n"))


# --------------------------------------------------------------------- outliers


def iqr_fences(df: DataFrame, by: Sequence[str], columns: Sequence[str], width: float = 1.5) -> DataFrame:
    q = bounded_quantiles(df, by, columns, (0.25, 0.75))
    reach = (F.col("q1") - F.col("q0")) * width
    return q.select(*by, "variable", (F.col("q0") - reach).alias("low"), (F.col("q1") + reach).alias("high"))


def iqr_outliers(df: DataFrame, by: Sequence[str], columns: Sequence[str], width: float = 1.5) -> DataFrame:
    """Rows outside the fences, count and percent, per entity and column."""
    fences = iqr_fences(df, by, columns, width)
    wide = fences.groupBy(*by).agg(
        *[F.max(F.when(F.col("variable") == c, F.col(side))).alias(f"__{side}_{c}") for c in columns for side in ("low", "high")]
    )
    joined = df.select(*by, *columns).join(wide, list(by))

    def build(c: str) -> dict[str, Column]:
        out = (F.col(c) < F.col(f"__low_{c}")) | (F.col(c) > F.col(f"__high_{c}"))
        return {"n": F.count(F.lit(1)), "outliers": F.count_if(out)}

    counted = per_variable(joined, by, columns, build)
    return counted.withColumn("pct", ratio(F.col("outliers"), F.col("n")) * 100)


def box_statistics(df: DataFrame, by: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Quartiles and the whiskers: furthest values inside the fences."""
    q = bounded_quantiles(df, by, columns, (0.25, 0.5, 0.75))
    wide = q.groupBy(*by).agg(
        *[F.max(F.when(F.col("variable") == c, F.col(k))).alias(f"__{k}_{c}") for c in columns for k in ("q0", "q1", "q2")]
    )
    joined = df.select(*by, *columns).join(wide, list(by))

    def build(c: str) -> dict[str, Column]:
        lo, mid, hi = (F.col(f"__{k}_{c}") for k in ("q0", "q1", "q2"))
        inside = F.col(c).between(lo - (hi - lo) * 1.5, hi + (hi - lo) * 1.5)
        kept = F.when(inside, F.col(c))
        return {"q1": F.max(lo), "median": F.max(mid), "q3": F.max(hi), "whisker_low": F.min(kept), "whisker_high": F.max(kept)}

    return per_variable(joined, by, columns, build)


# ----------------------------------------------------------------------- trends


def linear_trend(df: DataFrame, x: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    xx, yy = F.col(x).cast("double"), F.col(y).cast("double")
    return df.groupBy(*by).agg(F.regr_slope(yy, xx).alias("slope"), F.regr_intercept(yy, xx).alias("intercept"))


# ------------------------------------------------------------- fitted statistics


def fit_global_quantiles(df: DataFrame, wanted: Sequence[tuple[str, float, str]]) -> DataFrame:
    """Exact quantiles over all rows as one row of constants; ``wanted`` lists (column, probability, name).

    The columns are materialised once and the ranks narrowed through histograms, at every size the same way.
    """
    columns = list(dict.fromkeys(c for c, _, _ in wanted))
    values = cut_lineage(df.select(*columns))
    q = exact_quantiles(values, [], columns, [p for _, p, _ in wanted])
    cell = lambda i, c: F.max(F.when(F.col("variable") == c, F.col(f"q{i}")))
    return fixed_rows(q.agg(*[cell(i, c).alias(n) for i, (c, _, n) in enumerate(wanted)]))


def fit_thresholds(
    df: DataFrame, temp: str, humidity: str, wind: str, scope: Sequence[str] = (), hot: float = 0.95, dry: float = 0.10, windy: float = 0.90
) -> DataFrame:
    """Extreme-weather limits as a fitted table: one row, or one per ``scope`` entity."""
    wanted = ((temp, hot, "hot"), (humidity, dry, "dry"), (wind, windy, "windy"))
    if scope:
        return df.groupBy(*scope).agg(*[F.percentile(F.col(c), F.lit(p)).alias(n) for c, p, n in wanted])
    return fit_global_quantiles(df, wanted)


def fit_monthly_means(df: DataFrame, columns: Sequence[str], entity: str = "City", month: str = "Month") -> DataFrame:
    return df.groupBy(entity, month).agg(*[F.avg(c).alias(f"{c}_month_mean") for c in columns])


def fit_medians(df: DataFrame, columns: Sequence[str], by: Sequence[str] = ("City",), suffix: str = "_median") -> DataFrame:
    return df.groupBy(*by).agg(*[F.percentile(F.col(c), F.lit(0.5)).alias(f"{c}{suffix}") for c in columns])


def fit_clip_limits(df: DataFrame, columns: Sequence[str], low: float = 0.01, high: float = 0.99) -> DataFrame:
    """Global percentiles of every column as one row (``<c>_low``, ``<c>_high``)."""
    return fit_global_quantiles(df, [(c, p, f"{c}{s}") for c in columns for p, s in ((low, "_low"), (high, "_high"))])


def fit_spread(df: DataFrame, variables: Sequence[str]) -> DataFrame:
    """Mean upward and downward distance of the daily extremes from the daily mean."""
    up = lambda v: F.avg(F.greatest(F.col(f"{v}_max") - F.col(f"{v}_mean"), F.lit(0.0)))
    down = lambda v: F.avg(F.greatest(F.col(f"{v}_mean") - F.col(f"{v}_min"), F.lit(0.0)))
    return df.agg(*[e for v in variables for e in (up(v).alias(f"{v}_up"), down(v).alias(f"{v}_down"))])


def as_scalar_row(fitted: DataFrame) -> Column:
    """A one-row fitted table as a struct column, read once as a scalar subquery."""
    return fitted.select(F.struct(*fitted.columns).alias("s")).scalar()


# --------------------------------------------------------------------- coverage


def ingest_coverage(df: DataFrame, entity: str, ts: str, limit: int = 100_000) -> DataFrame:
    """Rows and time range per entity, flagged when a full history is present."""
    return df.groupBy(entity).agg(
        F.count(F.lit(1)).alias("n"),
        F.min(ts).alias("first"),
        F.max(ts).alias("last"),
        (F.count(F.lit(1)) > limit).alias("full_history"),
    )


def coverage_ratio(df: DataFrame, entity: str, hour_no: Column) -> DataFrame:
    """Rows against entities times hours between the first and the last hour."""
    base = df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.countDistinct(entity).alias("entities"),
        (F.max(hour_no) - F.min(hour_no) + 1).alias("hours"),
    )
    return base.select("rows", (F.col("entities") * F.col("hours")).alias("expected"), ratio(F.col("rows"), F.col("entities") * F.col("hours")).alias("coverage"))


def completeness(df: DataFrame, entity: str, date: str, start: Column, end: Column) -> DataFrame:
    """Whether each entity covers [start + 1 day, end - 1 day]."""
    first, last = F.min(date), F.max(date)
    return df.groupBy(entity).agg(
        first.alias("first"),
        last.alias("last"),
        F.count(F.lit(1)).alias("n"),
        ((first <= F.date_add(start, 1)) & (last >= F.date_sub(end, 1))).alias("complete"),
    )


def lagging_entities(df: DataFrame, entity: str, date: str, target: Column) -> DataFrame:
    """Entities whose newest row is older than the target."""
    return df.groupBy(entity).agg(F.max(date).alias("last")).filter(F.col("last") < target)


def feature_coverage(df: DataFrame, expected: Sequence[str]) -> DataFrame:
    """For each expected column: present in the schema, and non-zero anywhere."""
    have = [c for c in expected if c in df.columns]
    names = df.sparkSession.createDataFrame([(c, c in have) for c in expected], "variable string, matched boolean")
    if not have:
        return names.withColumn("non_zero", F.lit(False))
    filled = per_variable(df, [], have, lambda c: {"non_zero": F.coalesce(F.max(F.abs(c)) > 0, F.lit(False))})
    return names.join(filled, "variable", "left").fillna({"non_zero": False})

