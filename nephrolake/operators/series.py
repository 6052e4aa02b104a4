"""Hourly series of a subject: aggregation, joins, features and labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.clinical import hour_bucket, safe_ratio

KEY, HOUR = "subject_id", "hour_bucket"


def by_subject(key: str = KEY, order: str = HOUR):
    return Window.partitionBy(key).orderBy(order)


def rows_back(n: int, key: str = KEY, order: str = HOUR):
    """The current row and the n - 1 before it."""
    return by_subject(key, order).rowsBetween(1 - n, 0)


# ---- aggregation to hours

def first_of_hour(events: DataFrame, value: str, tiebreak: str) -> DataFrame:
    """The earliest reading of each subject-hour. Rows are dealt out by subject
    alone, which serves this window and those over the subject's hours."""
    at = events.withColumn(HOUR, hour_bucket("charttime")).repartition(KEY)
    w = Window.partitionBy(KEY, HOUR).orderBy("charttime", tiebreak)
    return at.withColumn("_n", F.row_number().over(w)).filter("_n = 1").select(KEY, HOUR, "charttime", F.col(value).alias("creatinine"))


def last_of_hour(events: DataFrame, value: str, tiebreak: str) -> DataFrame:
    """The latest non-null reading, by time and then by id."""
    at = events.filter(F.col(value).isNotNull()).withColumn(HOUR, hour_bucket("charttime"))
    return at.groupBy(KEY, HOUR).agg(F.max_by(value, F.struct("charttime", tiebreak)).alias("creatinine"))


def hourly_urine(events: DataFrame, value: str = "value", keys=(KEY, "hadm_id", "stay_id")) -> DataFrame:
    out = events.groupBy(*keys, hour_bucket("charttime").alias(HOUR)).agg(
        F.sum(value).alias("urine_output_ml"), F.count("*").alias("n_readings"), F.min("charttime").alias("first_charttime"), F.max("charttime").alias("last_charttime"))
    return out.filter(F.col("urine_output_ml") >= 0)


# ---- joins

def within_stays(events: DataFrame, stays: DataFrame, keys: list[str]) -> DataFrame:
    """Events inside the stays of their subject: equal keys, and a range test in the join."""
    inside = F.col("charttime").between(F.col("intime"), F.col("outtime"))
    names = [f"_s_{k}" for k in keys]
    slim = stays.select(*(F.col(k).alias(n) for k, n in zip(keys, names, strict=True)), *(c for c in stays.columns if c not in keys))
    on = inside
    for k, n in zip(keys, names, strict=True):
        on = on & (F.col(k) == F.col(n))
    return events.join(slim, on).drop(*names)


def outer_hours(left: DataFrame, right: DataFrame, keys: list[str], null_keys: bool = False) -> DataFrame:
    """Full outer join on shared keys; ``null_keys`` lets NULL keys meet, as they do in pandas."""
    if not null_keys:
        return left.join(right, keys, "full_outer")
    r = right.select(*(F.col(c).alias(f"_r_{c}") if c in keys else F.col(c) for c in right.columns))
    on = None
    for k in keys:
        test = F.col(k).eqNullSafe(F.col(f"_r_{k}"))
        on = test if on is None else on & test
    joined = left.join(r, on, "full_outer")
    return joined.select(*(F.coalesce(k, f"_r_{k}").alias(k) for k in keys), *(c for c in left.columns if c not in keys), *(c for c in right.columns if c not in keys))


def timeline(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


# ---- features

def creatinine_features(df: DataFrame, key: str = KEY, order: str = HOUR) -> DataFrame:
    w = by_subject(key, order)
    cr = F.col("creatinine")
    out = df.withColumn("min_cr_48h", F.min(cr).over(rows_back(48, key, order)))
    return out.withColumns({"creatinine_ratio": safe_ratio(cr, "min_cr_48h")} | {f"cr_delta_{n}h": cr - F.lag(cr, n).over(w) for n in (1, 12, 48)})


def average_velocity(df: DataFrame, urine: str = "urine_ml", weight: float = 70.0, key: str = KEY, order: str = HOUR) -> DataFrame:
    """The mean of the last h rows over weight times h."""
    return df.withColumns({f"urine_output_velocity_{h}h": F.avg(urine).over(rows_back(h, key, order)) / (weight * h) for h in (6, 12, 24)})


def sum_velocity(df: DataFrame, urine: str = "urine_output_ml", weight: Column | float = 70.0, key: str = KEY, order: str = HOUR) -> DataFrame:
    """The sum of the last h rows over weight times h."""
    kg = F.lit(weight) if isinstance(weight, float) else weight
    return df.withColumns({f"urine_ml_kg_hr_{h}h": F.sum(urine).over(rows_back(h, key, order)) / (kg * h) for h in (6, 12, 24)})


def engineer(df: DataFrame, key: str = KEY, weight: Column | float = 70.0) -> DataFrame:
    """Baseline over all rows, previous values, differences, urine by weight."""
    w, whole = by_subject(key), Window.partitionBy(key)
    cr = F.col("creatinine")
    out = df.fillna({"urine_output_ml": 0.0}).withColumns({
        "baseline_creatinine": F.min(cr).over(whole),
        "creatinine_prev_1h": F.lag(cr, 1).over(w), "creatinine_prev_48h": F.lag(cr, 48).over(w),
    })
    out = out.withColumns({
        "creatinine_ratio": safe_ratio(cr, "baseline_creatinine"),
        "creatinine_delta_1h": cr - F.col("creatinine_prev_1h"), "creatinine_delta_48h": cr - F.col("creatinine_prev_48h"),
    })
    return sum_velocity(out, weight=weight, key=key)


def trailing(column: Column, hours: int, key: str = KEY, time: str = "charttime") -> Column:
    """An aggregate over the last so many hours of true time, both ends
    included. Times in whole microseconds make the range exact."""
    micros = F.unix_micros(F.col(time).cast("timestamp"))
    return column.over(Window.partitionBy(key).orderBy(micros).rangeBetween(-hours * 3_600_000_000, 0))


# ---- labels: is stage 3 ahead?

def label_sql(stage: str = "kdigo_stage", key: str = KEY, order: str = HOUR) -> Column:
    """This row and the 48 after it."""
    return (F.max(stage).over(by_subject(key, order).rowsBetween(0, 48)) >= 3).cast("int")


def label_ahead(stage: str = "kdigo_stage", key: str = KEY, order: str = HOUR) -> Column:
    """The 48 rows after this one."""
    return F.coalesce((F.max(stage).over(by_subject(key, order).rowsBetween(1, 48)) >= 3).cast("int"), F.lit(0))


def label_shifted(df: DataFrame, shift: int, below_three: bool = False, stage: str = "kdigo_stage", key: str = KEY, order: str = HOUR, name: str = "target") -> DataFrame:
    """A rolling maximum over 48 rows of the stage ``shift`` rows ahead."""
    out = df.withColumn("_ahead", F.lead(stage, shift).over(by_subject(key, order)))
    hit = F.coalesce(F.max("_ahead").over(rows_back(48, key, order)) >= 3, F.lit(False))
    if below_three:
        hit = hit & (F.col(stage) < 3)
    return out.withColumn(name, hit.cast("int")).drop("_ahead")


def label_running(stage: str = "kdigo_stage", key: str = KEY, order: str = HOUR) -> Column:
    return (F.max(stage).over(by_subject(key, order).rowsBetween(Window.unboundedPreceding, 0)) >= 3).cast("int")
