"""Filters and projections from raw tables to staging, by generation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.clinical import CREATININE_ITEMS, URINE_ITEMS, parse_time, to_number

RENAL_LABELS = {"creatinine": "creatinine", "urine": "urine|foley|void"}


def creatinine(labs: DataFrame, low: float = 0.3, high: float = 15.0, unit: str = "mg/dL", whole: bool = True) -> DataFrame:
    """Plausible readings of the allowed items, in typed columns; ``whole``:
    subject and time must be there."""
    good = F.col("itemid").isin(*CREATININE_ITEMS) & F.col("valuenum").between(low, high) & (F.col("valueuom") == unit)
    return labs.filter(good & F.col("subject_id").isNotNull() & F.col("charttime").isNotNull() if whole else good)


def creatinine_from_text(labs: DataFrame) -> DataFrame:
    """The older form, from all-text landing tables, with casts that give NULL:
    wider bounds, and a reading without a subject or a time stays."""
    typed = labs.select(*(F.col(c).try_cast("long").alias(c) for c in ("subject_id", "hadm_id", "itemid")), parse_time("charttime").alias("charttime"),
        to_number("valuenum").alias("valuenum"), "valueuom")
    return creatinine(typed, 0.1, 20.0, whole=False)


def urine(outputs: DataFrame, cap: float | None = None, unit: str | None = None) -> DataFrame:
    """Non-negative output of the allowed items; the older form caps it and asks for a unit."""
    out = outputs.filter(F.col("itemid").isin(*URINE_ITEMS) & (F.col("value") >= 0) & F.col("subject_id").isNotNull() & F.col("charttime").isNotNull())
    if cap is not None:
        out = out.filter(F.col("value") <= cap)
    return out if unit is None else out.filter(F.col("valueuom") == unit)


def stays(icu: DataFrame) -> DataFrame:
    return icu.filter((F.col("los") > 0) & F.col("subject_id").isNotNull() & F.col("stay_id").isNotNull()).select("subject_id", "hadm_id", "stay_id", "intime",
        "outtime", F.col("los").alias("los_days"), F.round(F.col("los") * 24, 2).alias("los_hours"), F.to_date("intime").alias("icu_admit_date"))


def stays_strict(icu: DataFrame) -> DataFrame:
    keys = ("subject_id", "hadm_id", "stay_id", "intime", "outtime")
    return icu.dropna(subset=list(keys)).filter(F.col("intime") < F.col("outtime")).select(*keys)


def plausible_patients(patients: DataFrame) -> DataFrame:
    return patients.filter(F.col("age").between(0, 120) & F.col("weight").between(30, 250))


def plausible_labs(labs: DataFrame) -> DataFrame:
    """Only creatinine is bounded; other labs pass."""
    return labs.filter((F.lower(F.trim("labname")) != "creatinine") | F.col("labresult").between(0.3, 15))


def plausible_intake(intake: DataFrame, value: str = "intake_ml", cap: float = 5000.0) -> DataFrame:
    return intake.filter(F.col(value).between(0, cap) & F.col("subject_id").isNotNull())


def by_label(events: DataFrame, dictionary: DataFrame, pattern: str) -> DataFrame:
    """Events of the items whose label matches. The dictionary is small and of
    fixed size; the session's broadcast threshold decides how it is joined."""
    items = dictionary.filter(F.coalesce(F.lower("label").rlike(pattern), F.lit(False))).select("itemid")
    return events.join(items, "itemid")


def shifted(df: DataFrame, offset: str, base: str = "2022-01-01") -> DataFrame:
    """Minutes since a base time become a time."""
    at = F.lit(base).cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.lit(0), F.col(offset), F.lit(0))
    return df.withColumn("event_time", at)


def where_source(df: DataFrame, source: str = "mimic-iv") -> DataFrame:
    return df.filter(F.col("source") == source) if "source" in df.columns else df


def existing(df: DataFrame, columns) -> DataFrame:
    return df.select(*(c for c in columns if c in df.columns))
