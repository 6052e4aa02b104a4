"""k-anonymity and Laplace noise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.clinical import age_bin, generalize_age, generalize_care_unit
from .staging import where_source

K, EPSILON = 5, 1.0
QUASI = ("age_bucket", "gender", "care_unit")
MECHANISM = "Laplace"


def suppress(df: DataFrame, keys: list[str], k: int = K, counted: str | None = None) -> DataFrame:
    """Rows whose group has k rows or more; NULL keys are in no group. The
    counts are aggregated before they are joined back, so that a large group
    is never sorted in one task. ``counted``: size a group by the non-null
    values of that column."""
    size = F.count(counted) if counted else F.count("*")
    groups = df.dropna(subset=keys).groupBy(*keys).agg(size.alias("_size")).filter(F.col("_size") >= k)
    return df.join(groups.select(*keys), keys, "left_semi")


def anonymize(df: DataFrame, k: int = K, mimic_iv_only: bool = True, strict_compat: bool = False) -> DataFrame:
    """Decades of age, broad care units, then suppression of small groups."""
    out = where_source(df) if mimic_iv_only else df
    if "age" in out.columns:
        out = out.withColumn("age_bucket", generalize_age("age"))
    if "care_unit" in out.columns:
        out = out.withColumn("care_unit", generalize_care_unit("care_unit"))
    keys = [c for c in QUASI if c in out.columns]
    counted = next((c for c in out.columns if c not in keys), None) if strict_compat else None
    return suppress(out, keys, k, counted) if keys else out


def anonymize_binned(features: DataFrame, demographics: DataFrame, key: str, k: int = K) -> DataFrame:
    """Demographics joined on, ages in bins, groups below k suppressed."""
    merged = features.join(demographics.distinct(), key, "left").withColumn("age_group", age_bin("age"))
    return suppress(merged, ["age_group", "gender", "unittype"], k)


def is_k_anonymous(df: DataFrame, keys: list[str], k: int = K) -> DataFrame:
    """One row: the smallest group and whether it has k rows."""
    least = df.dropna(subset=keys).groupBy(*keys).agg(F.count("*").alias("n")).agg(F.min("n").alias("min_size"))
    return least.select("min_size", F.coalesce(F.col("min_size") >= k, F.lit(True)).alias("valid"))


def laplace(scale: Column | float, seed: int | None = None) -> Column:
    """Noise by the inverse distribution function."""
    u = F.rand(seed) - 0.5
    b = scale if isinstance(scale, Column) else F.lit(float(scale))
    return -b * F.signum(u) * F.log(F.greatest(1 - 2 * F.abs(u), F.lit(1e-300)))


def noised(value: Column, sensitivity: Column | float, epsilon: float = EPSILON, seed: int | None = None) -> Column:
    """The value with noise; epsilon 0 means none is wanted."""
    if epsilon == 0:
        return value
    b = sensitivity if isinstance(sensitivity, Column) else F.lit(float(sensitivity))
    return value + laplace(b / epsilon, seed)


def dp_stats(df: DataFrame, group: str, value: str, sensitivity: float = 1.0, metric: str | None = None, epsilon: float = EPSILON, seed: int | None = None,
        true_values: bool = False) -> DataFrame:
    """Mean and non-null count of each group, both with noise; what is true is
    shown only where it is asked for."""
    out = df.filter(F.col(group).isNotNull()).groupBy(group).agg(F.avg(value).alias("mean"), F.count(value).alias("count"))
    out = out.withColumns({
        "dp_mean": noised(F.col("mean"), sensitivity, epsilon, seed), "dp_count": noised(F.col("count").cast("double"), 1.0, epsilon, None if seed is None else seed + 1),
        "epsilon": F.lit(epsilon), "mechanism": F.lit(MECHANISM), "sensitivity": F.lit(sensitivity),
    })
    out = out if true_values else out.drop("mean", "count")
    return out.withColumn("metric", F.lit(metric)) if metric else out


def dp_dashboard(df: DataFrame, epsilon: float = EPSILON, seed: int | None = None) -> dict[str, DataFrame]:
    """The three protected metrics, those whose columns are there."""
    out = {}
    if {"kdigo_stage", "creatinine"} <= {*df.columns}:
        out["creatinine_by_kdigo"] = dp_stats(df, "kdigo_stage", "creatinine", 1.0, "mean_creatinine", epsilon, seed)
    if "kdigo_stage" in df.columns:
        out["patient_count_by_kdigo"] = dp_stats(df, "kdigo_stage", "patient_id", 1.0, "patient_count", epsilon, seed)
    if "timestamp" in df.columns:
        hours = df.withColumn("hour", F.date_trunc("HOUR", "timestamp"))
        out["event_count_by_hour"] = dp_stats(hours, "hour", "patient_id", 1.0, "event_count", epsilon, seed)
    return out


def dp_mean_by_unit(df: DataFrame, unit: str, value: str, low: float = 0.5, high: float = 5.0, epsilon: float = EPSILON, seed: int | None = None,
        true_values: bool = False) -> DataFrame:
    """The mean of each unit, with noise that shrinks with its size."""
    out = df.groupBy(unit).agg(F.count("*").alias("n"), F.avg(value).alias("true_mean")).withColumn("sensitivity", (high - low) / F.col("n"))
    out = out.withColumn("dp_mean", noised(F.col("true_mean"), F.col("sensitivity"), epsilon, seed))
    return out if true_values else out.drop("true_mean", "n")
