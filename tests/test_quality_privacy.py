"""Gates, quarantine, k-anonymity and noise."""

import statistics

import pytest
from pyspark.sql import functions as F

from nephrolake.functions import clinical as fn
from nephrolake.operators import privacy, quality, sketches

COLS = "subject_id long, hadm_id long, charttime string, valuenum double, valueuom string, itemid long"


def labs(spark, values, unit="mg/dL", subject=(1, 2, 3, 4)):
    return spark.createDataFrame([(subject[i % 4], 9, "2150-01-01", v, unit, 50912) for i, v in enumerate(values)], COLS)


def test_gate_passes(spark):
    for values in ([1.2, 0.8, 3.5, 0.3], [0.3, 15.0]):
        r = quality.run_gate(labs(spark, values), "creatinine")
        assert r["passed"] and r["success_rate"] == 1.0 and not r["failed"] and "<table>" in r["report"]


@pytest.mark.parametrize(("make", "column"), [
    (lambda s: labs(s, [0.1, 0.2]), "valuenum"), (lambda s: labs(s, [16.0, 20.0]), "valuenum"), (lambda s: labs(s, [1.0, 2.0], subject=(1, None, 3, 4)), "subject_id"),
    (lambda s: labs(s, [1.0, 2.0]).withColumn("charttime", F.when(F.col("subject_id") == 1, "x")), "charttime"), (lambda s: labs(s, [1.0], unit="umol/L"), "valueuom")])
def test_gate_fails(spark, make, column):
    r = quality.run_gate(make(spark), "creatinine")
    assert not r["passed"] and column in r["failed"]


def test_gate_errors(spark):
    with pytest.raises(ValueError, match="empty DataFrame"):
        quality.run_gate(labs(spark, [1.0]).limit(0), "creatinine")
    with pytest.raises(ValueError, match="missing required columns"):
        quality.run_gate(labs(spark, [1.0]).drop("valuenum"), "creatinine")
    with pytest.raises(ValueError, match="Unknown source_type"):
        quality.run_gate(labs(spark, [1.0]), "blood")


def test_gate_on_other_columns(spark):
    """Items are not judged; a rule on a missing column fails, the other six pass."""
    assert quality.run_gate(labs(spark, [1.0]).withColumn("itemid", F.lit(7)), "creatinine")["passed"]
    r = quality.run_gate(labs(spark, [1.0]).drop("valueuom"), "creatinine")
    assert r["failed"] == ["valueuom"] and r["success_rate"] == 1 - 1 / 7


def test_urine_gate(spark):
    df = labs(spark, [250.0, 0.0, 450.5], unit="mL").withColumn("itemid", F.lit(226559))
    assert quality.run_gate(df, "urine")["passed"]


def test_dataset_gate_null_creatinine_fails(spark):
    df = spark.createDataFrame([(1, 1.0, 2.0), (2, None, 3.0)], "subject_id long, creatinine double, urine_output_ml double")
    assert {r.check: r.passed for r in quality.dataset_gate(df, "d", "subject_id").collect()} == {"creatinine_range_valid": False, "urine_non_negative": True,
        "no_missing_patient_ids": True}


def test_ages(spark):
    df = spark.createDataFrame([(x,) for x in (0.0, 18.0, 18.5, 39.0, 40.0, 79.0, 80.0, 120.0, 121.0, None)], "a double")
    rows = df.select(fn.age_bin("a"), fn.generalize_age("a")).collect()
    assert [r[0] for r in rows] == [None, "<18", "18-30", "30-40", "30-40", "70-80", "70-80", "80+", None, None]
    assert [r[1] for r in rows] == ["<40", "<40", "<40", "<40", "40-49", "70-79", "80+", "80+", "80+", "unknown"]


def test_k_anonymity(spark):
    rows = [("F", 50, "MICU")] * 4 + [("M", 50, "MICU")] * 5 + [("M", 70, "Med-Surg")] * 6 + [(None, 50, "CCU")] * 9
    df = spark.createDataFrame(rows, "gender string, age int, care_unit string")
    out = privacy.anonymize(df, 5)
    assert {(r.gender, r.age_bucket, r.care_unit) for r in out.collect()} == {("M", "50-59", "other"), ("M", "70-79", "medical")} and out.count() == 11
    assert privacy.is_k_anonymous(out, ["gender", "age_bucket", "care_unit"]).first().valid
    assert not privacy.is_k_anonymous(df, ["gender", "care_unit"]).first().valid


def test_laplace(spark):
    x = [r[0] for r in spark.range(20000).select(privacy.laplace(2.0, 3)).collect()]
    assert abs(statistics.mean(x)) < 0.1 and abs(statistics.mean(map(abs, x)) - 2.0) < 0.1
    assert spark.range(1).select(privacy.noised(F.lit(5.0), 1.0, 0)).first()[0] == 5.0


def test_quarantine(spark):
    good, bad = quality.split(labs(spark, [1.0, 99.0]), quality.gate_rules("creatinine"))
    assert good.count() == 1 and bad.first().failed_rules == "range_valuenum"


def test_sketches(spark):
    at = lambda xs: spark.createDataFrame([(i, x) for i, x in enumerate(xs)], "i int, s long").withColumn("ts", F.timestamp_seconds("s"))
    last = lambda xs, w: sketches.window_counts(at(xs), w).orderBy(F.desc("i")).first().n_in_window
    assert last([0, 5, 9], 10) == 3 and last([0, 5, 9, 11], 10) == 3 and last([0, 1, 2, 3, 4, 100], 5) == 1
    ids = spark.range(10000).withColumnRenamed("id", "v")
    assert 2000 < sketches.flajolet_martin(ids, "v").first()[0] < 50000
    assert sketches.flajolet_martin(ids.withColumn("v", F.lit("same")), "v", 32).first()[0] <= 8
    assert sketches.flajolet_martin(ids.limit(0), "v").first()[0] == 0
    assert sketches.reservoir(ids, 10, 1, "v").count() == 10 and sketches.reservoir(ids.limit(5), 10, 1, "v").count() == 5
    rows = spark.createDataFrame([("a",), ("b",), ("a",)], "k string")
    assert sketches.seen_stats(rows, ["k"]).first()[:] == (2, 1, 33.33)


def test_reservoir_is_uniform(spark):
    from collections import Counter

    seen = Counter()
    base = spark.range(20).crossJoin(spark.range(2000).withColumnRenamed("id", "seed"))  # 2000 trials of 5 of 20
    from pyspark.sql import Window

    w = Window.partitionBy("seed").orderBy(F.xxhash64("seed", "id"))
    for r in base.withColumn("n", F.row_number().over(w)).filter("n <= 5").groupBy("id").count().collect():
        seen[r.id] = r["count"]
    assert all(375 < seen[i] < 625 for i in range(20))
