"""Data-quality checks; each yields rows (name, passed, detail)."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from riskgrid.functions.nulls import present, ratio
from riskgrid.functions.risk import risk_tier
from riskgrid.operators.joins import missing_entities
from riskgrid.operators.stats import per_variable
from riskgrid.spec import CHECK_BOUNDS, LEAK_COLUMNS, TIERS

SCHEMA = "name string, passed boolean, detail string"


def _row(df: DataFrame, name: str, passed: Column, detail: Column) -> DataFrame:
    return df.select(F.lit(name).alias("name"), passed.alias("passed"), detail.cast("string").alias("detail"))


def _static(df: DataFrame, name: str, passed: bool, detail: str) -> DataFrame:
    """A check decided from the schema alone, as a one-row frame."""
    return df.sparkSession.createDataFrame([(name, passed, detail)], SCHEMA)


def columns_present(df: DataFrame, required: Sequence[str], name: str) -> DataFrame:
    missing = [c for c in required if c not in df.columns]
    return _static(df, name, not missing, ",".join(missing))


def entities_present(df: DataFrame, required: DataFrame, name: str, entity: str = "City") -> DataFrame:
    absent = missing_entities(required, df, entity).agg(F.count(F.lit(1)).alias("n"))
    return _row(absent, name, F.col("n") == 0, F.format_string("%d missing", F.col("n")))


def no_nulls(df: DataFrame, name: str) -> DataFrame:
    cells = reduce(lambda a, b: a + b, [F.count_if(F.col(c).isNull()) for c in df.columns])
    return _row(df.agg(cells.alias("n")), name, F.col("n") == 0, F.format_string("%d null cells", F.col("n")))


def within_bounds(df: DataFrame, prefix: str, bounds: dict[str, tuple[float, float]] = CHECK_BOUNDS) -> DataFrame:
    """One row per bounded column, from one aggregate."""
    use = [c for c in bounds if c in df.columns]
    outside = lambda c: F.count_if((F.col(c) < bounds[c][0]) | (F.col(c) > bounds[c][1]))
    counts = per_variable(df, [], use, lambda c: {"n": outside(c)})
    return counts.select(
        F.concat(F.lit(f"{prefix}:"), F.col("variable")).alias("name"),
        (F.col("n") == 0).alias("passed"),
        F.format_string("%d outside", F.col("n")).alias("detail"),
    )


def unique_key(df: DataFrame, key: Sequence[str], name: str) -> DataFrame:
    extra = df.groupBy(*key).agg(F.count(F.lit(1)).alias("c")).agg(F.coalesce(F.sum(F.col("c") - 1), F.lit(0)).alias("n"))
    return _row(extra, name, F.col("n") == 0, F.format_string("%d duplicates", F.col("n")))


def probability_range(df: DataFrame, p: str, name: str) -> DataFrame:
    ends = df.agg(F.min(p).alias("lo"), F.max(p).alias("hi"))
    fine = F.coalesce((F.col("lo") >= 0) & (F.col("hi") <= 1), F.lit(False))
    return _row(ends, name, fine, F.format_string("min=%.4f max=%.4f", F.col("lo"), F.col("hi")))


def known_tiers(df: DataFrame, tier: str, name: str) -> DataFrame:
    odd = df.agg(F.count_if(~F.coalesce(F.col(tier).isin(*TIERS), F.lit(False))).alias("n"))
    return _row(odd, name, F.col("n") == 0, F.format_string("%d unknown", F.col("n")))


def records_valid(records: DataFrame, required: Sequence[str], name: str) -> DataFrame:
    """Parsed JSON records: not empty, keys there, no null under a key."""
    have = present(records, required)
    holes = reduce(lambda a, b: a + b, [F.count_if(F.col(c).isNull()) for c in have], F.lit(0))
    counts = records.agg(F.count(F.lit(1)).alias("rows"), holes.alias("n"))
    fine = (F.col("rows") > 0) & (F.col("n") == 0) & F.lit(len(have) == len(required))
    return _row(counts, name, fine, F.format_string("%d records, %d nulls", F.col("rows"), F.col("n")))


def datasets_exist(expected: DataFrame, listing: DataFrame, name: str) -> DataFrame:
    """Every expected dataset name occurs in a listing of written ones."""
    absent = expected.select("dataset").join(listing.select("dataset").distinct(), "dataset", "left_anti")
    return _row(absent.agg(F.count(F.lit(1)).alias("n")), name, F.col("n") == 0, F.format_string("%d missing", F.col("n")))


def manifest_complete(manifest: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """A one-row model manifest has every key, none of them null."""
    missing = [k for k in keys if k not in manifest.columns]
    if missing:
        return _static(manifest, name, False, ",".join(missing))
    return no_nulls(manifest.select(*keys), name)


def leakage(df: DataFrame, split_date: str, date: str = "Date") -> DataFrame:
    """Leak columns listed, lagged features there, both sides of the split non-empty."""
    leaks = present(df, LEAK_COLUMNS)
    shifted = [c for c in df.columns if "roll" in c.lower() or "lag" in c.lower()]
    cut = F.lit(split_date).cast("date")
    sides = df.agg(F.count_if(F.col(date) < cut).alias("a"), F.count_if(F.col(date) >= cut).alias("b"))
    return run_all(
        [
            _static(df, "leakage:leak_columns", True, ",".join(leaks)),
            _static(df, "leakage:shifted_features", bool(shifted), f"{len(shifted)} features"),
            _row(
                sides,
                "leakage:split",
                (F.col("a") > 0) & (F.col("b") > 0),
                F.format_string("train=%d test=%d", F.col("a"), F.col("b")),
            ),
        ]
    )


def run_all(checks: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), checks)


def summary(checks: DataFrame) -> DataFrame:
    return checks.agg(F.count_if("passed").alias("passed"), F.count_if(~F.col("passed")).alias("failed"))


# ----------------------------------------------------------- daily against hourly


def daily_from_hourly(hourly: DataFrame, p: str = "probability", entity: str = "City", ts: str = "Timestamp") -> DataFrame:
    return hourly.groupBy(entity, F.to_date(ts).alias("Date")).agg(F.max(p).alias("hourly_max"), F.avg(p).alias("hourly_mean"))


def consistency_report(
    daily: DataFrame, hourly: DataFrame, limit: float = 0.35, daily_p: str = "probability", hourly_p: str = "probability", entity: str = "City"
) -> DataFrame:
    """Daily and hourly risk side by side for every shared entity-day."""
    both = daily.select(entity, "Date", F.col(daily_p).alias("daily_prob")).join(
        daily_from_hourly(hourly, hourly_p, entity), [entity, "Date"]
    )
    gap = F.abs(F.col("hourly_max") - F.col("daily_prob"))
    return both.select(
        entity,
        "Date",
        "daily_prob",
        "hourly_max",
        "hourly_mean",
        gap.alias("disagreement"),
        F.coalesce(gap > limit, F.lit(False)).alias("mismatch_flag"),
        risk_tier("daily_prob", "right").alias("daily_risk_level"),
        risk_tier("hourly_max", "right").alias("hourly_max_risk_level"),
    )


def consistency_check(report: DataFrame, name: str = "consistency:daily_hourly_agreement", allowed: float = 0.20) -> DataFrame:
    counts = report.agg(F.count(F.lit(1)).alias("n"), F.count_if("mismatch_flag").alias("m"))
    fine = (F.col("n") > 0) & (ratio(F.col("m"), F.col("n")) <= allowed)
    return _row(counts, name, fine, F.format_string("%d/%d over the limit", F.col("m"), F.col("n")))


def worst_disagreements(report: DataFrame, n: int = 20, entity: str = "City") -> DataFrame:
    return report.orderBy(F.desc("disagreement"), entity, "Date").limit(n)
