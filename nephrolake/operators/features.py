"""Baselines from few readings and fixed-order feature vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.clinical import col, hour_bucket
from . import kdigo, series, staging

HISTORY, FIRST = 20, 3


def baseline_of_three(events: DataFrame, value: str, tiebreak: str, key: str = "subject_id") -> DataFrame:
    """The median of the first three of the newest twenty readings."""
    back = Window.partitionBy(key).orderBy(F.desc("charttime"), F.desc(tiebreak))
    newest = events.withColumn("_back", F.row_number().over(back)).filter(F.col("_back") <= HISTORY)
    history = newest.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("charttime", tiebreak, F.col(value).alias("v")))).alias("h"))
    first = F.transform(F.slice("h", 1, FIRST), lambda r: r["v"])
    return history.select(key, F.explode(first).alias("v")).groupBy(key).agg(F.percentile("v", 0.5).alias("baseline"))


def offset_cohort(patients: DataFrame, labs: DataFrame, intake: DataFrame, tiebreak: str) -> DataFrame:
    """From patients (subject_id, age, weight), labs (labname, labresult) and
    intake (intake_ml), both with a subject_id and minutes in ``offset``, to
    hours with features by each patient's weight, and a stage."""
    people = staging.plausible_patients(patients).select("subject_id", "weight")
    at = lambda df: staging.shifted(df.filter(F.col("offset").isNotNull()), "offset").withColumnRenamed("event_time", "charttime")
    named = staging.plausible_labs(labs).filter(F.lower(F.trim("labname")) == "creatinine")
    hours = series.last_of_hour(at(named), "labresult", tiebreak)
    urine = at(staging.plausible_intake(intake)).groupBy("subject_id", hour_bucket("charttime").alias("hour_bucket")).agg(F.sum("intake_ml").alias("urine_output_ml"))
    both = series.outer_hours(hours, urine, ["subject_id", "hour_bucket"]).join(people, "subject_id")
    out = series.engineer(both, weight=F.col("weight"))
    stage = kdigo.stage_gap_free("creatinine", "creatinine_ratio", "creatinine_delta_48h", *(f"urine_ml_kg_hr_{h}h" for h in (6, 12, 24)))
    return out.withColumn("kdigo_stage", stage)


def feature_vector(current, baseline, ratio, delta, uo6, uo24) -> Column:
    """Ten slots; the last three stand for what a live stream does not know."""
    or_ = lambda c, x: F.coalesce(col(c), F.lit(x))
    d = or_(delta, 0.0)
    slots = [or_(current, 0.0), or_(baseline, 1.0), or_(ratio, 1.0), d, d * 0.5, or_(uo6, 0.0), or_(uo24, 0.0)]
    return F.array(*(F.round(s, 3) for s in slots), F.lit(65.0), F.lit(1.0), F.lit(0.0))
