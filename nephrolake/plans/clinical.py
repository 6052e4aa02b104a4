"""Queries of staging, features, labels, cohorts, quality, privacy, sketches,
similarity and evaluation, on the bound tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import clinical as fn
from ..operators import evaluation, kdigo, privacy, quality, series, similarity, sketches, staging
from . import relational as rel
from .registry import query


def staged(t):
    """Creatinine features with the v12 stage, urine terms left out."""
    none = F.lit(None).cast("double")
    return rel.creatinine_features(t).withColumn("kdigo_stage", kdigo.stage_v12("creatinine", "creatinine_ratio", "cr_delta_48h", none, none, none))


def gold(t):
    return rel.gold_features(t).withColumn("kdigo_stage", kdigo.stage_v12("creatinine", "creatinine_ratio", "cr_delta_48h", *(f"urine_output_velocity_{h}h" for h in (6, 12, 24))))


def flagship(t):
    """Readings to first of hour to features to stage to label."""
    return staged(t).withColumn("label", series.label_sql()).select("subject_id", "hour_bucket", "creatinine", "creatinine_ratio", "cr_delta_48h", "kdigo_stage", "label")


query("flagship_stage_and_label", """SELECT subject_id, hour_bucket, creatinine, creatinine_ratio, cr_delta_48h, kdigo_stage,
    CAST(max(kdigo_stage) OVER (PARTITION BY subject_id ORDER BY hour_bucket ROWS BETWEEN CURRENT ROW AND 48 FOLLOWING) >= 3 AS INTEGER) AS label FROM staged""")(flagship)

RULES = """CASE WHEN creatinine_ratio >= 3.0 OR creatinine >= 4.0 OR {u24} < 0.3 THEN 3 WHEN creatinine_ratio BETWEEN 2.0 AND {a} OR {u12} < 0.5 THEN 2
    WHEN {d} >= 0.3 OR creatinine_ratio BETWEEN 1.5 AND {b} OR {u6} < 0.5 THEN 1 ELSE 0 END"""
_V12 = RULES.format(u24="urine_output_velocity_24h", u12="urine_output_velocity_12h", u6="urine_output_velocity_6h", d="cr_delta_48h", a=2.99, b=1.99)
_FREE = "CASE WHEN creatinine_ratio >= 3.0 OR creatinine >= 4.0 OR urine_ml_kg_hr_24h < 0.3 THEN 3 WHEN creatinine_ratio >= 2.0 OR urine_ml_kg_hr_12h < 0.5 THEN 2 WHEN creatinine_delta_48h >= 0.3 OR creatinine_ratio >= 1.5 OR urine_ml_kg_hr_6h < 0.5 THEN 1 ELSE 0 END"


@query("k1_k2_stage_v12", f"SELECT subject_id, hour_bucket, {_V12} AS kdigo_stage FROM gold_features")
def _(t):
    return gold(t).select("subject_id", "hour_bucket", "kdigo_stage")


def stage_free(t):
    return rel.engineered(t).withColumn("kdigo_stage",
        kdigo.stage_gap_free("creatinine", "creatinine_ratio", "creatinine_delta_48h", *(f"urine_ml_kg_hr_{h}h" for h in (6, 12, 24))))


@query("k3_stage_gap_free", f"SELECT subject_id, hour_bucket, {_FREE} AS kdigo_stage FROM engineered")
def _(t):
    return stage_free(t).select("subject_id", "hour_bucket", "kdigo_stage")


_K4 = """c AS (SELECT stay_id, date_trunc('hour', charttime) AS h, max(valuenum) AS cr, any_value(b) AS b FROM (SELECT *, min(valuenum)
    OVER (PARTITION BY stay_id) AS b FROM creat) GROUP BY 1, 2),
    u AS (SELECT stay_id, date_trunc('hour', charttime) AS h, sum(value) AS ml FROM urine GROUP BY 1, 2)"""


def hourly_sql_stage(t):
    c = rel.creat(t).withColumn("b", F.min("valuenum").over(Window.partitionBy("stay_id"))).groupBy("stay_id",
        fn.hour_bucket("charttime").alias("h")).agg(F.max("valuenum").alias("cr"), F.first("b").alias("b"))
    u = rel.urine(t).groupBy("stay_id", fn.hour_bucket("charttime").alias("h")).agg(F.sum("value").alias("ml"))
    both = c.withColumn("sc", kdigo.creatinine_stage_hourly("cr", "b")).join(u.withColumn("su", kdigo.urine_stage_hourly("ml")), ["stay_id", "h"], "full_outer")
    return both.select("stay_id", F.col("h").alias("charttime"), F.coalesce("sc", F.lit(0)).alias("kdigo_creat_stage"),
        F.coalesce("su", F.lit(0)).alias("kdigo_urine_stage"), F.greatest(F.coalesce("sc", F.lit(0)), F.coalesce("su", F.lit(0))).alias("kdigo_stage"))


@query("k4_stage_sql_hourly", """SELECT stay_id, charttime, sc AS kdigo_creat_stage, su AS kdigo_urine_stage, greatest(sc, su) AS kdigo_stage FROM (
    SELECT coalesce(c.stay_id, u.stay_id) AS stay_id, coalesce(c.h, u.h) AS charttime,
      CASE WHEN cr IS NULL OR b IS NULL OR b = 0 THEN 0 WHEN cr / b >= 3.0 OR cr >= 4.0 THEN 3 WHEN cr / b >= 2.0 THEN 2 WHEN cr / b >= 1.5 THEN 1 ELSE 0 END AS sc,
      CASE WHEN ml < 30 THEN 2 WHEN ml < 60 THEN 1 ELSE 0 END AS su
    FROM (SELECT stay_id, date_trunc('hour', charttime) AS h, max(valuenum) AS cr, any_value(b) AS b FROM (SELECT *, min(valuenum) OVER (PARTITION BY stay_id) AS b
    FROM creat) GROUP BY 1, 2) c
    FULL JOIN (SELECT stay_id, date_trunc('hour', charttime) AS h, sum(value) AS ml FROM urine GROUP BY 1, 2) u ON c.stay_id = u.stay_id AND c.h = u.h)""")
def _(t):
    return hourly_sql_stage(t)


@query("k5_stage_stream", "SELECT subject_id, hour_bucket, greatest(CASE WHEN creatinine_ratio >= 3.0 THEN 3 WHEN creatinine_ratio >= 2.0 THEN 2 WHEN "
    "creatinine_ratio >= 1.5 THEN 1 ELSE 0 END, CASE WHEN urine_ml_kg_hr_6h < 0.3 THEN 3 WHEN urine_ml_kg_hr_6h < 0.5 THEN 2 ELSE 0 END) AS kdigo_stage FROM engineered")
def _(t):
    return rel.engineered(t).select("subject_id", "hour_bucket", kdigo.stage_stream("creatinine_ratio", "urine_ml_kg_hr_6h").alias("kdigo_stage"))


@query("k6_k7_classify", """SELECT subject_id, hour_bucket, CASE WHEN r >= 3.0 THEN 'cr_ratio>=3.0' WHEN creatinine >= 4.0 THEN 'cr_current>=4.0' WHEN u24 < 0.3
    THEN 'uo_24h<0.3' WHEN r >= 2.0 THEN '2.0<=cr_ratio<3.0'
    WHEN u12 < 0.5 THEN 'uo_12h<0.5' WHEN creatinine - b >= 0.3 THEN 'cr_delta_48h>=0.3' WHEN r >= 1.5 THEN '1.5<=cr_ratio<2.0' WHEN u6 < 0.5 THEN 'uo_6h<0.5'
    ELSE 'none' END AS triggered_by
    FROM (SELECT *, baseline_creatinine AS b, creatinine / nullif(baseline_creatinine, 0) AS r, urine_ml_kg_hr_6h AS u6, urine_ml_kg_hr_12h AS u12,
    urine_ml_kg_hr_24h AS u24 FROM engineered)""")
def _(t):
    c = kdigo.classify("creatinine", "baseline_creatinine", *(f"urine_ml_kg_hr_{h}h" for h in (6, 12, 24)))
    return rel.engineered(t).select("subject_id", "hour_bucket", c["triggered_by"].alias("triggered_by"))


# ---- features, cohorts, marts

@query("d1_d2_engineered", "SELECT subject_id, hour_bucket, creatinine, baseline_creatinine, creatinine_ratio, creatinine_delta_48h, round(urine_ml_kg_hr_6h, "
    "6) AS u6 FROM engineered")
def _(t):
    return rel.engineered(t).select("subject_id", "hour_bucket", "creatinine", "baseline_creatinine", "creatinine_ratio", "creatinine_delta_48h",
        F.round("urine_ml_kg_hr_6h", 6).alias("u6"))


@query("d4_d5_d6_outer_features", """SELECT subject_id, hour_bucket, creatinine, min(creatinine) OVER (w ROWS 47 PRECEDING) AS min_cr_48h,
    creatinine - lag(creatinine, 1) OVER w AS cr_delta_1h,
    round(avg(urine_output_ml) OVER (w ROWS 5 PRECEDING) / (70.0::DOUBLE * 6), 8) AS v6 FROM outer_hours WINDOW w AS (PARTITION BY subject_id ORDER BY hour_bucket)""")
def _(t):
    hours = rel.outer_hours(t).fillna({"urine_output_ml": 0.0})
    both = series.average_velocity(series.creatinine_features(hours), "urine_output_ml")
    return both.select("subject_id", "hour_bucket", "creatinine", "min_cr_48h", "cr_delta_1h", F.round("urine_output_velocity_6h", 8).alias("v6"))


@query("d7_gold_features", "SELECT subject_id, hour_bucket, creatinine, min_cr_48h, creatinine_ratio, cr_delta_1h, cr_delta_12h, cr_delta_48h, round(urine_ml, "
    "6) AS urine_ml, round(urine_output_velocity_24h, 8) AS v24 FROM gold_features")
def _(t):
    return rel.gold_features(t).select("subject_id", "hour_bucket", "creatinine", "min_cr_48h", "creatinine_ratio", "cr_delta_1h", "cr_delta_12h", "cr_delta_48h",
        F.round("urine_ml", 6).alias("urine_ml"), F.round("urine_output_velocity_24h", 8).alias("v24"))


@query("d8_d9_hourly_mart", """SELECT s.subject_id, hour_bucket, date_diff('hour', intime, hour_bucket) AS hours_since_icu, CAST(max(kdigo_stage)
    OVER (PARTITION BY s.subject_id ORDER BY hour_bucket ROWS UNBOUNDED PRECEDING) >= 3 AS INTEGER) AS label
    FROM staged s LEFT JOIN raw_stays i ON s.subject_id = i.subject_id""")
def _(t):
    joined = staged(t).join(t.raw_stays.select("subject_id", "intime"), "subject_id", "left")
    return joined.select("subject_id", "hour_bucket", fn.hour_boundaries("intime", "hour_bucket").alias("hours_since_icu"), series.label_running().alias("label"))


@query("d10_training_mart", f"""SELECT f.subject_id, f.hour_bucket, f.creatinine, k.kdigo_stage, CAST(max(k.kdigo_stage) OVER (PARTITION BY f.subject_id
    ORDER BY f.hour_bucket ROWS BETWEEN CURRENT ROW AND 48 FOLLOWING) >= 3 AS INTEGER) AS label
    FROM gold_features f JOIN (SELECT subject_id, hour_bucket, {_V12} AS kdigo_stage FROM gold_features) k ON f.subject_id = k.subject_id AND f.hour_bucket = k.hour_bucket""")
def _(t):
    stages = gold(t).select("subject_id", "hour_bucket", "kdigo_stage")
    return rel.gold_features(t).join(stages, ["subject_id", "hour_bucket"]).select("subject_id", "hour_bucket", "creatinine", "kdigo_stage", series.label_sql().alias("label"))


@query("d11_j6_icu_cohort", """SELECT s.stay_id, s.subject_id, date_diff('hour', a.admittime, s.intime) AS hours_admit_to_icu, a.admission_type, p.gender, CASE
    WHEN p.anchor_age < 65 THEN '<65' ELSE '>=65' END AS age_group,
    CASE WHEN p.dod IS NOT NULL AND p.dod <= a.admittime + INTERVAL 30 DAY THEN 1 ELSE 0 END AS mortality_30d FROM raw_stays s LEFT
    JOIN raw_admissions a ON s.hadm_id = a.hadm_id LEFT JOIN raw_patients p ON s.subject_id = p.subject_id""")
def _(t):
    s = t.raw_stays.join(t.raw_admissions.drop("subject_id"), "hadm_id", "left").join(t.raw_patients, "subject_id", "left")
    died = F.coalesce(F.col("dod").cast("timestamp_ntz") <= F.col("admittime") + F.expr("INTERVAL 30 DAYS"), F.lit(False))
    return s.select("stay_id", "subject_id", fn.hour_boundaries("admittime", "intime").alias("hours_admit_to_icu"), "admission_type", "gender",
        fn.age_group("anchor_age").alias("age_group"), died.cast("int").alias("mortality_30d"))


@query("d12_d13_anomaly_score", """SELECT subject_id, hour_bucket,
    round(least(CASE WHEN creatinine_ratio IS NULL THEN 0 ELSE least(creatinine_ratio * 20, 50) END + CASE WHEN d >= 0.3 THEN 15 WHEN d >= 0.1 THEN 8 ELSE 0 END +
    CASE WHEN u < 0.3 THEN 30 WHEN u < 0.5 THEN 15 ELSE 0 END, 100), 6) AS score,
    round(least(CASE WHEN creatinine_ratio IS NULL THEN 0 ELSE least(creatinine_ratio * 20, 50) END + CASE WHEN d > 0.3 THEN 15 WHEN d > 0.1 THEN 8 ELSE 0 END + CASE
    WHEN u < 0.3 THEN 30 WHEN u < 0.5 THEN 15 ELSE 0 END, 100), 6) AS score_strict
    FROM (SELECT *, creatinine_delta_1h AS d, urine_ml_kg_hr_6h AS u FROM engineered)""")
def _(t):
    raw = lambda strict: F.round(kdigo.anomaly_score("creatinine_ratio", "creatinine_delta_1h", "urine_ml_kg_hr_6h", strict, None), 6)
    return rel.engineered(t).select("subject_id", "hour_bucket", raw(False).alias("score"), raw(True).alias("score_strict"))


@query("d14_baseline_of_three", """SELECT subject_id, round(quantile_cont(valuenum, 0.5), 6) AS baseline FROM (SELECT subject_id, valuenum, n, row_number()
    OVER (PARTITION BY subject_id ORDER BY n) AS k FROM (
    SELECT subject_id, valuenum, row_number() OVER (PARTITION BY subject_id ORDER BY charttime DESC, labevent_id DESC) AS back, row_number()
    OVER (PARTITION BY subject_id ORDER BY charttime, labevent_id) AS n FROM creat) WHERE back <= 20) WHERE k <= 3 GROUP BY 1""")
def _(t):
    from ..operators.features import baseline_of_three

    return baseline_of_three(rel.creat(t), "valuenum", "labevent_id").select("subject_id", F.round("baseline", 6).alias("baseline"))


@query("d15_feature_vector", """SELECT subject_id, hour_bucket, round(coalesce(creatinine, 0), 3) AS f0, round(coalesce(baseline_creatinine, 1), 3) AS f1,
    CAST(65 AS DOUBLE) AS f7, CAST(10 AS INTEGER) AS n FROM engineered""")
def _(t):
    from ..operators.features import feature_vector

    v = rel.engineered(t).withColumn("v", feature_vector("creatinine", "baseline_creatinine", "creatinine_ratio", "creatinine_delta_1h", "urine_ml_kg_hr_6h", "urine_ml_kg_hr_24h"))
    return v.select("subject_id", "hour_bucket", F.col("v")[0].alias("f0"), F.col("v")[1].alias("f1"), F.col("v")[7].alias("f7"), F.size("v").alias("n"))


# ---- labels

@query("w10_label_sql", "SELECT subject_id, hour_bucket, CAST(max(kdigo_stage) OVER (PARTITION BY subject_id ORDER BY hour_bucket ROWS BETWEEN CURRENT ROW AND 48 "
    "FOLLOWING) >= 3 AS INTEGER) AS target FROM staged")
def _(t):
    return staged(t).select("subject_id", "hour_bucket", series.label_sql().alias("target"))


_SHIFT = """SELECT subject_id, hour_bucket, CAST(({extra} coalesce(max(a) OVER (PARTITION BY subject_id ORDER BY hour_bucket ROWS 47 PRECEDING) >= 3, false)) AS INTEGER) AS target
    FROM (SELECT *, lead(kdigo_stage, {n}) OVER (PARTITION BY subject_id ORDER BY hour_bucket) AS a FROM staged)"""


@query("w11_label_shift_48", _SHIFT.format(n=48, extra=""))
def _(t):
    return series.label_shifted(staged(t), 48).select("subject_id", "hour_bucket", "target")


@query("w12_label_shift_1", _SHIFT.format(n=1, extra="kdigo_stage < 3 AND"))
def _(t):
    return series.label_shifted(staged(t), 1, below_three=True).select("subject_id", "hour_bucket", "target")


@query("label_ahead", "SELECT subject_id, hour_bucket, CAST(coalesce(max(kdigo_stage) OVER (PARTITION BY subject_id ORDER BY hour_bucket ROWS BETWEEN 1 FOLLOWING AND "
    "48 FOLLOWING) >= 3, false) AS INTEGER) AS target FROM staged")
def _(t):
    return staged(t).select("subject_id", "hour_bucket", series.label_ahead().alias("target"))


# ---- quality

@query("q1_gate", """SELECT 'not_null_subject_id' AS rule, count(*) FILTER (subject_id IS NULL) AS bad, count(*) FILTER (subject_id IS NULL) = 0 AS passed FROM raw_labs
    UNION ALL SELECT 'not_null_charttime', count(*) FILTER (charttime IS NULL), count(*) FILTER (charttime IS NULL) = 0 FROM raw_labs
    UNION ALL SELECT 'present_' || c, CAST(0 AS BIGINT), true FROM (VALUES ('subject_id'), ('charttime'), ('valuenum')) v(c)
    UNION ALL SELECT 'range_valuenum', count(*) FILTER (valuenum NOT BETWEEN 0.3 AND 15.0),
      count(*) FILTER (valuenum BETWEEN 0.3 AND 15.0) >= 0.99 * count(valuenum) FROM raw_labs
    UNION ALL SELECT 'set_valueuom', count(*) FILTER (valueuom <> 'mg/dL'), count(*) FILTER (valueuom <> 'mg/dL') = 0 FROM raw_labs""")
def _(t):
    return quality.evaluate(t.raw_labs, quality.gate_rules("creatinine")).select("rule", "bad", "passed")


@query("q2_silver_gate", """SELECT 'not_null_subject_id' AS rule, count(*) FILTER (subject_id IS NULL) AS bad FROM outer_hours UNION ALL
    SELECT 'not_null_hour_bucket', count(*) FILTER (hour_bucket IS NULL) FROM outer_hours
    UNION ALL SELECT 'range_creatinine', count(*) FILTER (creatinine NOT BETWEEN 0.3 AND 15.0) FROM outer_hours UNION ALL SELECT 'range_urine_output_ml',
    count(*) FILTER (urine_output_ml < 0) FROM outer_hours""")
def _(t):
    return quality.evaluate(rel.outer_hours(t), quality.silver_rules()).select("rule", "bad")


@query("q4_dataset_gate", """SELECT 'set' AS dataset, 'creatinine_range_valid' AS "check", coalesce(bool_and(coalesce(creatinine BETWEEN 0.3 AND 15.0, false)),
    true) AS passed FROM outer_hours UNION ALL SELECT 'set', 'urine_non_negative', bool_and(coalesce(urine_output_ml >= 0, false)) FROM outer_hours
    UNION ALL SELECT 'set', 'no_missing_patient_ids', bool_and(subject_id IS NOT NULL) FROM outer_hours UNION ALL SELECT 'set', 'valid_timestamps', true""")
def _(t):
    return quality.dataset_gate(rel.outer_hours(t).fillna({"urine_output_ml": 0.0}), "set", "subject_id")


@query("q5_quarantine", """SELECT failed_rules, count(*) AS n FROM (SELECT concat_ws(',', CASE WHEN NOT (l_quantity <= 45) THEN 'range_l_quantity' END, CASE
    WHEN NOT (l_returnflag IN ('N', 'R')) THEN 'set_l_returnflag' END) AS failed_rules FROM lineitem) WHERE failed_rules <> '' GROUP BY 1""")
def _(t):
    _, bad = quality.split(t.read("lineitem"), [quality.between("l_quantity", None, 45), quality.one_of("l_returnflag", ("N", "R"))])
    return bad.groupBy("failed_rules").agg(F.count("*").alias("n"))


@query("q6_column_tests", "SELECT 'unique_o_orderkey' AS rule, count(*) - count(DISTINCT o_orderkey) AS bad FROM orders UNION ALL SELECT 'unique_o_custkey', "
    "count(*) - count(DISTINCT o_custkey) FROM orders UNION ALL SELECT 'set_o_orderstatus', count(*) FILTER (o_orderstatus NOT IN ('O', 'F')) FROM orders")
def _(t):
    o = t.read("orders")
    return quality.unique(o, ["o_orderkey"]).union(quality.unique(o, ["o_custkey"])).union(quality.evaluate(o, [quality.one_of("o_orderstatus", ("O", "F"))]).select("rule", "bad"))


@query("q7_readiness", """SELECT 'purchase' AS item, count(*) AS rows, count(DISTINCT user_id) AS subjects, count(*) FILTER (value BETWEEN 0.3 AND 150) AS in_range
    FROM events WHERE event_type = 'purchase'
    UNION ALL SELECT 'click', count(*), count(DISTINCT user_id), count(*) FILTER (value BETWEEN 0.3 AND 150) FROM events WHERE event_type = 'click'""")
def _(t):
    kept = t.events.filter(F.col("event_type").isin("purchase", "click"))
    return kept.groupBy(F.col("event_type").alias("item")).agg(F.count("*").alias("rows"), F.count_distinct("user_id").alias("subjects"),
        F.count_if(F.col("value").between(0.3, 150)).alias("in_range"))


# ---- privacy

_ANON = """SELECT subject_id, decade AS age_bucket, gender, unit AS care_unit FROM (SELECT *, count(*) OVER (PARTITION BY decade, gender, unit) AS n
    FROM (SELECT subject_id, gender,
    CASE WHEN anchor_age IS NULL THEN 'unknown' WHEN anchor_age < 40 THEN '<40' WHEN anchor_age < 50 THEN '40-49' WHEN anchor_age < 60 THEN '50-59'
    WHEN anchor_age < 70 THEN '60-69' WHEN anchor_age < 80 THEN '70-79' ELSE '80+' END AS decade,
    CASE WHEN lower(care_unit) LIKE '%med%' THEN 'medical' WHEN lower(care_unit) LIKE '%surg%' OR lower(care_unit) LIKE '%sicu%' THEN 'surgical'
    WHEN lower(care_unit) LIKE '%card%' OR lower(care_unit) LIKE '%ccu%' THEN 'cardiac' ELSE 'other' END AS unit
    FROM raw_patients)) WHERE n >= {k}"""


@query("v1_k_anonymity", _ANON.format(k=60))
def _(t):
    return privacy.anonymize(t.raw_patients.withColumnRenamed("anchor_age", "age"), k=60).select("subject_id", "age_bucket", "gender", "care_unit")


@query("v2_k_anonymity_binned", """SELECT subject_id, age_group, gender, unittype FROM (SELECT *, count(*) OVER (PARTITION BY age_group, gender, unittype) AS n
    FROM (SELECT c.subject_id, p.gender, p.care_unit AS unittype,
    CASE WHEN anchor_age <= 18 THEN '<18' WHEN anchor_age <= 30 THEN '18-30' WHEN anchor_age <= 40 THEN '30-40' WHEN anchor_age <= 50 THEN '40-50'
    WHEN anchor_age <= 60 THEN '50-60' WHEN anchor_age <= 70 THEN '60-70' WHEN anchor_age <= 80 THEN '70-80' WHEN anchor_age <= 120 THEN '80+' END AS age_group
    FROM (SELECT DISTINCT user_id AS subject_id FROM events) c LEFT JOIN raw_patients p ON c.subject_id = p.subject_id) WHERE age_group IS NOT NULL
    AND gender IS NOT NULL AND unittype IS NOT NULL) WHERE n >= 5""")
def _(t):
    who = t.raw_patients.select("subject_id", F.col("anchor_age").alias("age"), "gender", F.col("care_unit").alias("unittype"))
    out = privacy.anonymize_binned(t.events.select(F.col("user_id").alias("subject_id")).distinct(), who, "subject_id", 5)
    return out.select("subject_id", "age_group", "gender", "unittype")


@query("v3_validate", "SELECT min(n) AS min_size, min(n) >= 5 AS valid FROM (SELECT count(*) AS n FROM raw_patients WHERE gender IS NOT NULL AND care_unit IS NOT "
    "NULL GROUP BY gender, care_unit)")
def _(t):
    return privacy.is_k_anonymous(t.raw_patients, ["gender", "care_unit"], 5)


@query("v4_v5_dp_stats")
def _(t):
    """Noise is random: no SQL form. Tests fix the seed and check the distribution."""
    return privacy.dp_stats(staged(t), "kdigo_stage", "creatinine", metric="mean_creatinine", seed=7)


@query("v6_dp_dashboard")
def _(t):
    frame = staged(t).withColumns({"patient_id": F.col("subject_id"), "timestamp": F.col("hour_bucket")})
    parts = [d.select("metric", F.col(d.columns[0]).cast("string").alias("group_value"), "dp_mean", "dp_count") for d in privacy.dp_dashboard(frame, seed=7).values()]
    return parts[0].union(parts[1]).union(parts[2])


@query("v5_v7_true_stats", "SELECT care_unit, count(*) AS n, round(avg(anchor_age), 6) AS true_mean, round(4.5::DOUBLE / count(*), 9) AS sensitivity FROM raw_patients GROUP BY 1")
def _(t):
    out = privacy.dp_mean_by_unit(t.raw_patients, "care_unit", "anchor_age", epsilon=0, true_values=True)
    return out.select("care_unit", "n", F.round("true_mean", 6).alias("true_mean"), F.round("sensitivity", 9).alias("sensitivity"))


# ---- sketches

@query("z1_z2_window_count", "SELECT event_id, count(*) OVER (ORDER BY ts RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW) AS n_in_window FROM events")
def _(t):
    return sketches.window_counts(t.events.select("event_id", "ts"), 3600).select("event_id", "n_in_window")


@query("t11_sliding_counts", "SELECT window_start, count(*) AS n FROM (SELECT time_bucket(INTERVAL 10 MINUTE, "
    "ts) - i * INTERVAL 10 MINUTE AS window_start FROM events, range(6) r(i)) GROUP BY 1")
def _(t):
    return sketches.sliding_counts(t.events)


@query("z3_flajolet_martin", """SELECT CASE WHEN max(z) = 0 THEN 0 ELSE round(64 / sum(pow(2.0::DOUBLE, -z)) / 0.77351::DOUBLE)::BIGINT END AS estimate
    FROM (SELECT i, max(CASE WHEN h = 0 THEN 0 ELSE bit_count((h & -h) - 1) END) AS z FROM (
    SELECT i, CAST('0x' || substr(sha1(i || '|' || v), 1, 8) AS BIGINT) AS h FROM (SELECT DISTINCT user_id AS v FROM events), range(64) r(i)) GROUP BY i)""")
def _(t):
    return sketches.flajolet_martin(t.events, "user_id")


@query("z4_approx_distinct")
def _(t):
    """The production form; approximate, so without a SQL form."""
    return t.events.groupBy("event_type").agg(F.approx_count_distinct("user_id").alias("users"))


@query("z5_reservoir", "SELECT event_id FROM events ORDER BY md5('42|' || event_id), event_id LIMIT 50")
def _(t):
    return sketches.reservoir_md5(t.events.select("event_id"), 50, 42, "event_id")


@query("z6_z7_first_seen", "SELECT event_id, CASE WHEN row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, "
    "event_id) = 1 THEN 'UNIQUE' ELSE 'DUP' END AS status FROM events")
def _(t):
    return sketches.mark_seen(t.events, ["user_id", "event_type"], ["ts", "event_id"]).select("event_id", "status")


@query("z6_seen_stats", 'SELECT count(DISTINCT (user_id, event_type)) AS "new", count(*) - count(DISTINCT (user_id, event_type)) AS dup, '
    'round(100.0::DOUBLE * (count(*) - count(DISTINCT (user_id, event_type))) / count(*), 2) AS dup_rate_pct FROM events')
def _(t):
    return sketches.seen_stats(t.events, ["user_id", "event_type"])


# ---- similarity

def _vectors(t):
    return t.read("embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("z"))


_KNN = """SELECT query_id, id, rank FROM (SELECT q.vec_id AS query_id, e.vec_id AS id, row_number() OVER (PARTITION BY q.vec_id
    ORDER BY list_distance(e.embedding::DOUBLE[], q.embedding::DOUBLE[]), e.vec_id) AS rank
    FROM embeddings e, embeddings q WHERE q.vec_id % 100 = 0 AND e.vec_id <> q.vec_id) WHERE rank <= 5"""


@query("l3_l5_nearest", _KNN)
def _(t):
    v = _vectors(t)
    return similarity.brute_force(v, v.filter("id % 100 = 0"), 5).select("query_id", "id", F.col("rank").cast("long").alias("rank"))


@query("l1_l2_hashed_nearest")
def _(t):
    """Bucketed search; what it finds depends on its random planes, so a test
    holds it against the exact neighbours (recall of at least 0.9). These
    vectors' neighbours lie at wide angles: 64 tables of 5 bits are needed, and
    five rows in six share a bucket with a query in some table."""
    v = _vectors(t)
    return similarity.hashed(v, v.filter("id % 100 = 0"), similarity.planes(64, 5, 64), 5).select("query_id", "id", "rank")


@query("l4_l6_explanations", """SELECT c_custkey, CASE WHEN abs(c_acctbal) >= c_nationkey THEN printf('acctbal: %.2f%%',
    100 * abs(c_acctbal) / (abs(c_acctbal) + c_nationkey + 0.000001)) ELSE printf('nation: %.2f%%', 100 * c_nationkey / (abs(c_acctbal) + c_nationkey + 0.000001))
    END AS explanation FROM customer""")
def _(t):
    c = t.read("customer").select("c_custkey", F.array("c_acctbal", F.col("c_nationkey").cast("double")).alias("a"), F.array(F.lit(0.0), F.lit(0.0)).alias("b"))
    return similarity.explain(c, ["acctbal", "nation"], "a", "b", top=1).select("c_custkey", "explanation")


@query("l1_standardized", "SELECT o_orderkey, round((o_totalprice - (SELECT avg(o_totalprice) FROM orders)) / ((SELECT stddev_pop(o_totalprice) FROM orders) + 1e-9), "
    "5) AS z FROM orders")
def _(t):
    return similarity.standardize(t.read("orders"), ["o_totalprice"]).select("o_orderkey", F.round(F.col("z")[0], 5).alias("z"))


# ---- evaluation

_STEPS = """(SELECT {g} p, pos, neg, sum(pos) OVER (PARTITION BY {k} ORDER BY p DESC) AS tp, sum(neg) OVER (PARTITION BY {k} ORDER BY p DESC) AS fp, sum(pos)
    OVER (PARTITION BY {k}) AS npos, sum(neg) OVER (PARTITION BY {k}) AS nneg
    FROM (SELECT {g} p, sum(y) AS pos, sum(1 - y) AS neg FROM {src} GROUP BY {g} p))"""


@query("e1_ranking_metrics", f"""SELECT lang, CASE WHEN any_value(npos) > 0 AND any_value(nneg) > 0 THEN
    round(sum(neg * (2 * tp - pos)) / (2.0::DOUBLE * any_value(npos) * any_value(nneg)), 9) END AS auroc,
    CASE WHEN any_value(npos) > 0 AND any_value(nneg) > 0 THEN round(sum(pos * tp / (tp + fp)::DOUBLE) / any_value(npos), 9) END AS auprc
    FROM {_STEPS.format(g="lang,", k="lang", src="scored")} GROUP BY lang""")
def _(t):
    return evaluation.ranking_metrics(t.scored, ["lang"]).select("lang", F.round("auroc", 9).alias("auroc"), F.round("auprc", 9).alias("auprc"))


@query("e1_threshold_metrics", """SELECT lang, n, round(coalesce(tp / nullif(tp + fp, 0), 0), 9) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0),
    9) AS recall, round(coalesce(2.0::DOUBLE * tp / nullif(2 * tp + fp + fn, 0), 0), 9) AS f1, round((tp + tn) / n, 9) AS accuracy, round(brier, 9) AS brier
    FROM (SELECT lang, count(*) AS n, (count(*) FILTER (p >= 0.5 AND y = 1))::DOUBLE AS tp, (count(*) FILTER (p >= 0.5 AND y = 0))::DOUBLE AS fp,
    (count(*) FILTER (p < 0.5 AND y = 1))::DOUBLE AS fn, (count(*) FILTER (p < 0.5 AND y = 0))::DOUBLE AS tn, avg((p - y) * (p - y)) AS brier FROM scored GROUP BY 1)""")
def _(t):
    m = evaluation.threshold_metrics(t.scored, ["lang"])
    return m.select("lang", "n", *(F.round(c, 9).alias(c) for c in ("precision", "recall", "f1", "accuracy", "brier")))


@query("e2_calibration", "SELECT lang, round(sum(n * abs(acc - conf)) / any_value(total), 9) AS ece FROM (SELECT s.lang, ceil(p * 10) AS bin, count(*) AS n, "
    "avg(p) AS conf, avg(y) AS acc, any_value(total) AS total FROM scored s JOIN (SELECT lang, "
    "count(*) AS total FROM scored GROUP BY 1) c ON s.lang = c.lang WHERE p > 0 GROUP BY 1, 2) GROUP BY 1")
def _(t):
    return evaluation.calibration_error(t.scored, ["lang"]).select("lang", F.round("ece", 9).alias("ece"))


@query("e3_roc_points", f"SELECT lang, p AS threshold, round(fp / nullif(nneg, 0)::DOUBLE, 9) AS fpr, round(tp / nullif(npos, 0)::DOUBLE, "
    f"9) AS tpr FROM {_STEPS.format(g='lang,', k='lang', src='scored')}")
def _(t):
    return evaluation.roc_points(t.scored, ["lang"]).select("lang", "threshold", F.round("fpr", 9).alias("fpr"), F.round("tpr", 9).alias("tpr"))


@query("e5_e6_e7_fairness", f"""SELECT m.attribute, m.value, m.n, round(m.f1, 9) AS f1, round(r.auroc, 9) AS auroc, m.f1 < 0.8 OR m.recall < 0.8 AS flagged FROM (
    SELECT attribute, value, count(*) AS n, coalesce(2.0::DOUBLE * count(*) FILTER (p >= 0.5 AND y = 1) / nullif(count(*) FILTER (p >= 0.5) +
    count(*) FILTER (y = 1), 0), 0) AS f1, coalesce((count(*) FILTER (p >= 0.5 AND y = 1))::DOUBLE / nullif(count(*) FILTER (y = 1), 0), 0) AS recall
    FROM (SELECT y, p, 'lang' AS attribute, lang AS value FROM scored UNION ALL SELECT y, p, 'source', source FROM scored) WHERE value IS NOT NULL GROUP BY 1,
    2 HAVING count(*) >= 10) m
    JOIN (SELECT attribute, value, CASE WHEN any_value(npos) > 0 AND any_value(nneg) > 0 THEN
    sum(neg * (2 * tp - pos)) / (2.0::DOUBLE * any_value(npos) * any_value(nneg)) END AS auroc
      FROM {_STEPS.format(g="attribute, value,", k="attribute, value", src="(SELECT y, p, 'lang' AS attribute, lang AS value FROM scored UNION ALL SELECT y, p, "
      "'source', source FROM scored)")} GROUP BY 1, 2) r ON m.attribute = r.attribute AND m.value = r.value""")
def _(t):
    return evaluation.by_attribute(t.scored, ["lang", "source"]).select("attribute", "value", "n", F.round("f1", 9).alias("f1"), F.round("auroc", 9).alias("auroc"), "flagged")


@query("a13_correlations", """SELECT 'l_quantity' AS a, 'l_extendedprice' AS b, round(corr(l_quantity, l_extendedprice), 8) AS corr FROM lineitem UNION ALL
    SELECT 'l_quantity', 'l_quantity', round(corr(l_quantity, l_quantity), 8) FROM lineitem
    UNION ALL SELECT 'l_extendedprice', 'l_extendedprice', round(corr(l_extendedprice, l_extendedprice), 8) FROM lineitem""")
def _(t):
    return evaluation.correlations(t.read("lineitem"), ["l_quantity", "l_extendedprice"]).select("a", "b", F.round("corr", 8).alias("corr"))


@query("a14_confusion", "SELECT y, CAST(p >= 0.5 AS INTEGER) AS y_hat, count(*) AS n FROM scored GROUP BY 1, 2")
def _(t):
    return evaluation.confusion(t.scored)
