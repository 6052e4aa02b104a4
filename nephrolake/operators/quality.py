"""Declarative quality rules: gates, tests on columns, quarantine, summaries.

A rule is a column expression that is true for a good row. All rules of a
check are evaluated in one pass as conditional counts.
"""

from __future__ import annotations

import html
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.clinical import no_nan

CREATININE_RANGE = (0.3, 15.0)
CREATININE_UNITS = ("mg/dL",)


@dataclass(frozen=True)
class Rule:
    """``good`` is judged on rows whose ``column`` is not NULL, unless the rule
    is about NULL itself; it holds if a share of ``mostly`` passes."""

    name: str
    column: str
    good: Column
    mostly: float = 1.0
    about_null: bool = False


def not_null(column: str) -> Rule:
    return Rule(f"not_null_{column}", column, F.col(column).isNotNull(), about_null=True)


def between(column: str, low=None, high=None, mostly: float = 1.0) -> Rule:
    good = F.lit(True)
    if low is not None:
        good = good & (F.col(column) >= low)
    if high is not None:
        good = good & (F.col(column) <= high)
    return Rule(f"range_{column}", column, good, mostly)


def one_of(column: str, values, mostly: float = 1.0) -> Rule:
    return Rule(f"set_{column}", column, F.col(column).isin(*values), mostly)


def evaluate(df: DataFrame, rules: list[Rule]) -> DataFrame:
    """(rule, column_name, judged, bad, passed), a row for each rule."""
    parts = []
    for i, r in enumerate(rules):
        judged = F.lit(True) if r.about_null else F.col(r.column).isNotNull()
        parts += [F.count_if(judged).alias(f"j{i}"), F.count_if(judged & ~F.coalesce(r.good, F.lit(False))).alias(f"b{i}")]
    counted = df.agg(*parts)
    rows = F.array(*(F.struct(F.lit(r.name).alias("rule"), F.lit(r.column).alias("column_name"), F.col(f"j{i}").alias("judged"), F.col(f"b{i}").alias("bad"),
        F.lit(r.mostly).alias("mostly")) for i, r in enumerate(rules)))
    out = counted.select(F.inline(rows))
    return out.select("rule", "column_name", "judged", "bad", ((F.col("judged") == 0) | (F.col("judged") - F.col("bad") >= F.col("mostly") * F.col("judged"))).alias("passed"))


def present(column: str) -> Rule:
    return Rule(f"present_{column}", column, F.lit(True), about_null=True)


def gate_rules(source_type: str, value_column: str = "valuenum") -> list[Rule]:
    """Checkpoint 1, on raw readings. Items are not its business."""
    if source_type not in ("creatinine", "urine"):
        raise ValueError(f"Unknown source_type: {source_type}")
    rules = [not_null("subject_id"), not_null("charttime"), present("subject_id"), present("charttime"), present(value_column)]
    if source_type == "urine":
        return [*rules, between(value_column, 0.0)]
    return [*rules, between(value_column, *CREATININE_RANGE, mostly=0.99), one_of("valueuom", CREATININE_UNITS)]


def missing_columns(df: DataFrame, required) -> list[str]:
    """Required columns that are not there, in order of name."""
    return sorted({*required} - {*df.columns})


def run_gate(df: DataFrame, source_type: str, value_column: str = "valuenum") -> dict:
    """Checkpoint 1: passed, success_rate, failed columns, row count, report.
    Subject, time and value must be there; a rule on another column that is
    missing fails."""
    missing = missing_columns(df, ["subject_id", "charttime", value_column])
    if missing:
        raise ValueError(f"missing required columns: {missing}")
    rules = gate_rules(source_type, value_column)
    rows = [r.asDict() for r in evaluate(df, [r for r in rules if r.column in df.columns]).collect()]  # one row for each rule
    n = rows[0]["judged"]
    if n == 0:
        raise ValueError("empty DataFrame")
    rows += [{"rule": r.name, "column_name": r.column, "judged": n, "bad": n, "passed": False} for r in rules if r.column not in df.columns]
    failed = [r["column_name"] for r in rows if not r["passed"]]
    return {"passed": not failed, "success_rate": 1 - len(failed) / len(rows), "failed": failed, "rows": n, "results": rows, "report": report(source_type, rows)}


def report(title: str, rows: list[dict]) -> str:
    """The results as an HTML page."""
    cells = "".join("<tr>" + "".join(f"<td>{html.escape(str(r[k]))}</td>" for k in ("rule", "column_name", "judged", "bad", "passed")) + "</tr>" for r in rows)
    return f"<html><head><title>{html.escape(title)}</title></head><body><h1>{html.escape(title)}</h1><table><tr><th>rule</th><th>column</th><th>judged</th><th>bad</th><th>passed</th></tr>{cells}</table></body></html>"


def silver_rules() -> list[Rule]:
    """Checkpoint 2, on hourly tables."""
    return [not_null("subject_id"), not_null("hour_bucket"), between("creatinine", *CREATININE_RANGE), between("urine_output_ml", 0.0)]


def dataset_gate(df: DataFrame, dataset: str, id_col: str) -> DataFrame:
    """(dataset, check, passed); a NULL creatinine fails its check."""
    tests = {
        "creatinine_range_valid": ("creatinine", no_nan("creatinine").between(*CREATININE_RANGE) if "creatinine" in df.columns else None),
        "urine_non_negative": ("urine_output_ml", F.col("urine_output_ml") >= 0 if "urine_output_ml" in df.columns else None),
        "no_missing_patient_ids": (id_col, F.col(id_col).isNotNull() if id_col in df.columns else None),
        "valid_timestamps": ("hour_bucket", F.col("hour_bucket").cast("string").isNull() | F.col("hour_bucket").cast("string").try_cast("timestamp").isNotNull() if "hour_bucket" in df.columns else None),
    }
    tests = {k: test for k, (c, test) in tests.items() if c in df.columns}
    done = df.agg(*(F.coalesce(F.bool_and(F.coalesce(t, F.lit(False))), F.lit(True)).alias(k) for k, t in tests.items()))
    return done.select(F.inline(F.array(*(F.struct(F.lit(dataset).alias("dataset"), F.lit(k).alias("check"), F.col(k).alias("passed")) for k in tests))))


def split(df: DataFrame, rules: list[Rule]) -> tuple[DataFrame, DataFrame]:
    """(good rows, quarantined rows with the names of the rules they broke)."""
    broken = F.array_join(F.filter(F.array(*(F.when(~F.coalesce(r.good, F.lit(False)), r.name) for r in rules)), lambda x: x.isNotNull()), ",")
    marked = df.withColumn("failed_rules", broken)
    return marked.filter("failed_rules = ''").drop("failed_rules"), marked.filter("failed_rules <> ''")


def unique(df: DataFrame, columns: list[str]) -> DataFrame:
    """(rule, bad): values of the columns that come more than once, as rows too many."""
    n = df.dropna(subset=columns).groupBy(*columns).agg(F.count("*").alias("n"))
    return n.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("long").alias("bad")).select(F.lit("unique_" + "_".join(columns)).alias("rule"), "bad")


def summary(df: DataFrame, dataset: str, id_col: str) -> DataFrame:
    """One row of counts over a labelled hourly table."""
    hours = df.groupBy(id_col, "hour_bucket").agg(F.count("*").alias("n"))
    main = df.agg(
        F.count("*").alias("rows"), F.count_distinct(id_col).alias("unique_ids"), F.count_if(F.col(id_col).isNull()).alias("missing_id_rows"),
        F.count_if(~F.coalesce(F.col("kdigo_stage").isin(0, 1, 2, 3), F.lit(False))).alias("invalid_kdigo_rows"),
        F.count_if(F.col("urine_output_ml") < 0).alias("negative_urine_rows"),
        F.count_if(F.col("creatinine") < 0.3).alias("low_creatinine_rows"), *(F.count_if(F.col("kdigo_stage") == k).alias(f"stage_{k}_rows") for k in range(4)))
    repeats = hours.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("long").alias("duplicate_patient_hour_rows"))
    return main.crossJoin(repeats).select(F.lit(dataset).alias("dataset"), *main.columns, "duplicate_patient_hour_rows")  # one row each


def profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column_name, nulls, distinct) of text or other columns; empty text counts as NULL."""
    parts = []
    for c in columns:
        value = F.when(F.col(c).cast("string") != "", F.col(c).cast("string"))
        parts += [F.count_if(value.isNull()).alias(f"{c}__n"), F.count_distinct(value).alias(f"{c}__d")]
    done = df.agg(*parts)
    return done.select(F.inline(F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(f"{c}__n").alias("nulls"), F.col(f"{c}__d").alias("distinct_values")) for c in columns))))
