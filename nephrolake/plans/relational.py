"""Queries of the relational operators: staging, joins, aggregates, windows,
sorts, set operations and scalar functions, on the bound tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import clinical as fn
from ..operators import incremental, quality, series, staging
from .registry import query

ROUND = lambda c, alias=None: F.round(c, 6).alias(alias or c)


def creat(t):
    return staging.creatinine(t.raw_labs)


def urine(t):
    return staging.urine(t.raw_outputs)


def silver_creatinine(t):
    return series.first_of_hour(creat(t), "valuenum", "labevent_id")


def silver_urine(t):
    return series.hourly_urine(urine(t))


def urine_hours(t):
    return silver_urine(t).groupBy("subject_id", "hour_bucket").agg(F.sum("urine_output_ml").alias("urine_ml"))


def creatinine_features(t):
    return series.creatinine_features(silver_creatinine(t))


# ---- staging and projections

@query("p1_stg_creatinine", "SELECT labevent_id, subject_id, hadm_id, itemid, charttime, valuenum FROM creat")
def _(t):
    return creat(t).select("labevent_id", "subject_id", "hadm_id", F.col("itemid").cast("int").alias("itemid"), "charttime", "valuenum")


@query("p2_stg_creatinine_from_text", """SELECT subject_id, hadm_id, itemid, charttime, valuenum FROM raw_labs
    WHERE valuenum BETWEEN 0.1 AND 20.0 AND itemid IN (50912, 51081, 52024, 52546) AND valueuom = 'mg/dL'""")
def _(t):
    text = t.raw_labs.select(*(F.col(c).cast("string").alias(c) for c in ("subject_id", "hadm_id", "itemid", "charttime", "valuenum", "valueuom")))
    return staging.creatinine_from_text(text).select("subject_id", "hadm_id", F.col("itemid").cast("int").alias("itemid"), "charttime", "valuenum")


@query("p3_stg_urine", "SELECT event_id, subject_id, stay_id, itemid, charttime, value FROM urine")
def _(t):
    return urine(t).select("event_id", "subject_id", "stay_id", "itemid", "charttime", "value")


@query("p4_stg_urine_capped", "SELECT event_id, subject_id, charttime, value FROM urine WHERE value <= 300 AND valueuom = 'mL'")
def _(t):
    return staging.urine(t.raw_outputs, cap=300.0, unit="mL").select("event_id", "subject_id", "charttime", "value")


@query("p5_stg_stays", "SELECT subject_id, hadm_id, stay_id, intime, outtime, los AS los_days, round(los * 24, 2) AS los_hours, "
    "CAST(CAST(intime AS DATE) AS VARCHAR) AS icu_admit_date FROM raw_stays WHERE los > 0")
def _(t):
    return staging.stays(t.raw_stays).withColumn("icu_admit_date", F.col("icu_admit_date").cast("string"))


@query("p6_stg_stays_strict", "SELECT subject_id, hadm_id, stay_id, intime, outtime FROM raw_stays WHERE intime < outtime")
def _(t):
    return staging.stays_strict(t.raw_stays)


@query("p7_cohort_columns", "SELECT subject_id, stay_id, intime FROM raw_stays")
def _(t):
    return staging.existing(t.raw_stays, ["subject_id", "stay_id", "intime", "not_there"])


@query("p8_plausible_patients", "SELECT subject_id, anchor_age AS age, "
    "weight FROM raw_patients WHERE anchor_age BETWEEN 0 AND 120 AND weight BETWEEN 60 AND 130 AND weight BETWEEN 30 AND 250")
def _(t):
    return staging.plausible_patients(t.raw_patients.withColumnRenamed("anchor_age", "age")).filter(F.col("weight").between(60, 130)).select("subject_id", "age", "weight")


@query("p9_conditional_range", "SELECT event_id, event_type AS labname, value AS labresult FROM (SELECT event_id, "
    "CASE event_type WHEN 'purchase' THEN ' Creatinine ' ELSE event_type END AS event_type, "
    "value FROM events) WHERE lower(trim(event_type)) <> 'creatinine' OR value BETWEEN 0.3 AND 15")
def _(t):
    labs = t.events.select("event_id", F.when(F.col("event_type") == "purchase", " Creatinine ").otherwise(F.col("event_type")).alias("labname"), F.col("value").alias("labresult"))
    return staging.plausible_labs(labs)


@query("p10_parsed_times", "SELECT event_id, ts AS charttime FROM events WHERE event_id % 5 <> 0")
def _(t):
    text = t.events.select("event_id", F.when(F.col("event_id") % 5 == 0,
        "not a time").otherwise(F.concat(F.replace(F.col("ts").cast("string"), F.lit(" "), F.lit("T")), F.lit("Z"))).alias("at"))
    return text.select("event_id", fn.parse_time("at").alias("charttime")).filter("charttime IS NOT NULL")


@query("p11_label_regex", "SELECT p_partkey, p_name FROM part WHERE regexp_matches(lower(p_name), 'cream|urine|foley|void|red')")
def _(t):
    return t.read("part").filter(F.coalesce(F.lower("p_name").rlike("cream|urine|foley|void|red"), F.lit(False))).select("p_partkey", "p_name")


@query("p12_shifted_time", "SELECT event_id, TIMESTAMP '2022-01-01' + CAST(event_id % 5000 AS INTEGER) * INTERVAL 1 MINUTE AS event_time FROM events")
def _(t):
    return staging.shifted(t.events.select("event_id", (F.col("event_id") % 5000).cast("int").alias("offset")), "offset").select("event_id", "event_time")


@query("p14_filled", "SELECT subject_id, hour_bucket, round(urine_output_ml, 6) AS urine_output_ml FROM outer_hours")
def _(t):
    return outer_hours(t).fillna({"urine_output_ml": 0.0}).select("subject_id", "hour_bucket", ROUND("urine_output_ml"))


@query("p15_both_measures", "SELECT subject_id, hour_bucket, creatinine, round(urine_ml, 6) AS urine_ml FROM gold_features WHERE creatinine IS NOT NULL AND urine_ml IS NOT NULL")
def _(t):
    return gold_features(t).dropna(subset=["creatinine", "urine_ml"]).select("subject_id", "hour_bucket", "creatinine", ROUND("urine_ml"))


@query("p17_where_source", "SELECT doc_id FROM documents WHERE source = 'src1'")
def _(t):
    return staging.where_source(t.read("documents").select("doc_id", "source"), "src1").select("doc_id")


# ---- joins

@query("j1_interval_join_creatinine", """SELECT c.labevent_id, s.stay_id, c.valuenum FROM raw_labs c JOIN signup_stays s
    ON c.subject_id = s.subject_id AND c.hadm_id = s.hadm_id AND c.charttime BETWEEN s.intime AND s.outtime""")
def _(t):
    return series.within_stays(t.raw_labs.drop("stay_id"), t.signup_stays, ["subject_id", "hadm_id"]).select("labevent_id", "stay_id", "valuenum")


@query("j2_interval_join_urine", "SELECT u.event_id, u.stay_id, u.value FROM urine u JOIN raw_stays s ON u.stay_id = s.stay_id AND u.charttime BETWEEN s.intime AND s.outtime")
def _(t):
    return series.within_stays(urine(t), t.raw_stays.select("stay_id", "intime", "outtime"), ["stay_id"]).select("event_id", "stay_id", "value")


@query("j3_baseline", "SELECT c.labevent_id, b.baseline FROM creat c JOIN (SELECT stay_id, min(valuenum) AS baseline FROM creat GROUP BY 1) b ON c.stay_id = b.stay_id")
def _(t):
    return creat(t).withColumn("baseline", F.min("valuenum").over(Window.partitionBy("stay_id"))).select("labevent_id", "baseline")


@query("j4_outer_join_hours", "SELECT subject_id, hour_bucket, creatinine, round(urine_output_ml, 6) AS urine_output_ml FROM outer_hours")
def _(t):
    return outer_hours(t).select("subject_id", "hour_bucket", "creatinine", F.round(F.coalesce("urine_output_ml", F.lit(0.0)), 6).alias("urine_output_ml"))


@query("j5_left_join_cohort", "SELECT c.subject_id, c.hour_bucket, s.stay_id FROM silver_cr c LEFT JOIN raw_stays s ON c.subject_id = s.subject_id")
def _(t):
    return silver_creatinine(t).join(t.raw_stays.select("subject_id", "stay_id"), "subject_id", "left").select("subject_id", "hour_bucket", "stay_id")


@query("j7_left_join_urine", "SELECT c.subject_id, c.hour_bucket, round(u.urine_ml, "
    "6) AS urine_ml FROM silver_cr c LEFT JOIN urine_hours u ON c.subject_id = u.subject_id AND c.hour_bucket = u.hour_bucket")
def _(t):
    return silver_creatinine(t).join(urine_hours(t), ["subject_id", "hour_bucket"], "left").select("subject_id", "hour_bucket", ROUND("urine_ml"))


@query("j9_dictionary_join", "SELECT l.l_orderkey, l.l_linenumber, p.p_brand FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey WHERE p.p_name LIKE '%red%'")
def _(t):
    items = t.read("part").filter(F.col("p_name").contains("red")).select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    return t.read("lineitem").select("l_orderkey", "l_linenumber", "l_partkey").join(items, "l_partkey").select("l_orderkey", "l_linenumber", "p_brand")


@query("j10_outer_join_null_keys", """SELECT coalesce(a.k, b.k, -1) AS k, coalesce(a.x, 0) AS x, coalesce(b.y, 0) AS y FROM (SELECT CASE WHEN user_id % 4 = 0
    THEN NULL ELSE user_id END AS k, count(*) AS x FROM events WHERE event_type = 'click' GROUP BY 1) a
    FULL JOIN (SELECT CASE WHEN user_id % 4 = 0 THEN NULL ELSE user_id END AS k, count(*) AS y FROM events WHERE event_type = 'error' AND user_id % 3 = 0
    GROUP BY 1) b ON a.k IS NOT DISTINCT FROM b.k""")
def _(t):
    k = F.when(F.col("user_id") % 4 != 0, F.col("user_id")).alias("k")
    a = t.events.filter("event_type = 'click'").groupBy(k).agg(F.count("*").alias("x"))
    b = t.events.filter("event_type = 'error' AND user_id % 3 = 0").groupBy(k).agg(F.count("*").alias("y"))
    return series.outer_hours(a, b, ["k"], null_keys=True).select(*(F.coalesce(c, F.lit(x)).alias(c) for c, x in (("k", -1), ("x", 0), ("y", 0))))


@query("j12_demographics", "SELECT e.event_id, p.gender, coalesce(p.anchor_age, -1) AS anchor_age FROM events e LEFT JOIN (SELECT DISTINCT subject_id, gender, "
    "anchor_age FROM raw_patients) p ON e.user_id = p.subject_id")
def _(t):
    who = t.raw_patients.select(F.col("subject_id").alias("user_id"), "gender", "anchor_age").distinct()
    return t.events.select("event_id", "user_id").join(who, "user_id", "left").select("event_id", "gender", F.coalesce("anchor_age", F.lit(-1)).alias("anchor_age"))


@query("j13_semi_join", "SELECT event_id FROM events WHERE user_id IN (SELECT user_id FROM events GROUP BY user_id HAVING count(*) >= 70)")
def _(t):
    many = t.events.groupBy("user_id").agg(F.count("*").alias("n")).filter("n >= 70").select("user_id")
    return t.events.join(many, "user_id", "left_semi").select("event_id")


@query("j14_set_overlap", "SELECT (SELECT count(DISTINCT user_id) FROM events WHERE event_type = 'error') AS n_left, "
    "(SELECT count(DISTINCT user_id) FROM events WHERE event_type = 'error' AND user_id IN (SELECT user_id FROM events WHERE event_type = 'signup' AND value > 100)) AS n_both")
def _(t):
    left = t.events.filter("event_type = 'error'").select("user_id").distinct()
    right = t.events.filter("event_type = 'signup' AND value > 100").select("user_id").distinct().withColumn("in_right", F.lit(1))
    return left.join(right, "user_id", "left").agg(F.count("*").alias("n_left"), F.count("in_right").alias("n_both"))


# ---- aggregates

@query("a1_hourly_urine", "SELECT subject_id, stay_id, hour_bucket, round(urine_output_ml, 6) AS urine_output_ml, n_readings, first_charttime, last_charttime FROM silver_ur")
def _(t):
    return silver_urine(t).select("subject_id", "stay_id", "hour_bucket", ROUND("urine_output_ml"), "n_readings", "first_charttime", "last_charttime")


@query("a2_hourly_creatinine_max", "SELECT stay_id, date_trunc('hour', charttime) AS chart_hour, max(valuenum) AS creatinine FROM creat GROUP BY 1, 2")
def _(t):
    return creat(t).groupBy("stay_id", fn.hour_bucket("charttime").alias("chart_hour")).agg(F.max("valuenum").alias("creatinine"))


@query("a4_urine_across_stays", "SELECT subject_id, hour_bucket, round(urine_ml, 6) AS urine_ml FROM urine_hours")
def _(t):
    return urine_hours(t).select("subject_id", "hour_bucket", ROUND("urine_ml"))


@query("a5_hourly_creatinine_last", "SELECT subject_id, date_trunc('hour', charttime) AS hour_bucket, arg_max(valuenum, (charttime, "
    "labevent_id)) AS creatinine FROM creat GROUP BY ALL")
def _(t):
    return series.last_of_hour(creat(t), "valuenum", "labevent_id")


@query("a6_stay_baseline", "SELECT stay_id, min(valuenum) AS baseline_creatinine FROM creat GROUP BY 1")
def _(t):
    return creat(t).groupBy("stay_id").agg(F.min("valuenum").alias("baseline_creatinine"))


@query("a10_dataset_summary", """SELECT 'v12' AS dataset, count(*) AS rows, count(DISTINCT subject_id) AS unique_ids,
    count(*) FILTER (subject_id IS NULL) AS missing_id_rows, count(*) FILTER (kdigo_stage NOT IN (0,1,2,3)) AS invalid_kdigo_rows,
    CAST(0 AS BIGINT) AS negative_urine_rows, count(*) FILTER (creatinine < 0.3) AS low_creatinine_rows, count(*) FILTER (kdigo_stage = 0) AS stage_0_rows,
    count(*) FILTER (kdigo_stage = 1) AS stage_1_rows,
    count(*) FILTER (kdigo_stage = 2) AS stage_2_rows, count(*) FILTER (kdigo_stage = 3) AS stage_3_rows, CAST(0 AS BIGINT) AS duplicate_patient_hour_rows FROM staged""")
def _(t):
    from .clinical import staged

    return quality.summary(staged(t).withColumn("urine_output_ml", F.lit(0.0)), "v12", "subject_id")


@query("a11_profile", """SELECT 'o_orderstatus' AS column_name, CAST(0 AS BIGINT) AS nulls, count(DISTINCT o_orderstatus) AS distinct_values FROM orders
    UNION ALL SELECT 'o_custkey', CAST(0 AS BIGINT), count(DISTINCT o_custkey) FROM orders UNION ALL SELECT 'o_orderpriority', CAST(0 AS BIGINT),
    count(DISTINCT o_orderpriority) FROM orders""")
def _(t):
    return quality.profile(t.read("orders"), ["o_orderstatus", "o_custkey", "o_orderpriority"])


@query("a12_calibration", "SELECT event_type, round(coalesce(nullif(avg(value), 0), 1.2), 6) AS mean_value, round(coalesce(nullif(stddev_samp(value), 0), 0.4), "
    "6) AS std_value FROM events GROUP BY 1")
def _(t):
    return t.events.groupBy("event_type").agg(F.round(F.coalesce(F.nullif(F.avg("value"), F.lit(0.0)), F.lit(1.2)), 6).alias("mean_value"),
        F.round(F.coalesce(F.nullif(F.stddev_samp("value"), F.lit(0.0)), F.lit(0.4)), 6).alias("std_value"))


@query("a15_metric_rollup", "SELECT event_type AS metric_name, count(*) AS n, round(avg(value), 4) AS avg_value FROM events GROUP BY 1")
def _(t):
    return t.events.groupBy(F.col("event_type").alias("metric_name")).agg(F.count("*").alias("n"), F.round(F.avg("value"), 4).alias("avg_value"))


@query("a16_stage_distribution", "SELECT kdigo_stage, count(*) AS n, min(creatinine) AS lo, max(creatinine) AS hi, round(avg(creatinine), 6) AS mean FROM staged GROUP BY 1")
def _(t):
    from .clinical import staged

    return staged(t).groupBy("kdigo_stage").agg(F.count("*").alias("n"), F.min("creatinine").alias("lo"), F.max("creatinine").alias("hi"),
        F.round(F.avg("creatinine"), 6).alias("mean"))


@query("a17_distinct", "SELECT DISTINCT user_id, event_type FROM events")
def _(t):
    return t.events.select("user_id", "event_type").dropDuplicates()


@query("a18_latest_snapshot", "SELECT user_id, max(ts) AS last_ts, arg_max(event_type, (ts, event_id)) AS last_type, arg_max(value, (ts, "
    "event_id)) AS last_value FROM events GROUP BY 1")
def _(t):
    last = F.max(F.struct("ts", "event_id", "event_type", "value")).alias("r")
    return t.events.groupBy("user_id").agg(last).select("user_id", F.col("r.ts").alias("last_ts"), F.col("r.event_type").alias("last_type"), F.col("r.value").alias("last_value"))


# ---- windows

@query("w1_first_of_hour", "SELECT subject_id, hour_bucket, charttime, creatinine FROM silver_cr")
def _(t):
    return silver_creatinine(t)


@query("w2_w3_min_and_lags", "SELECT subject_id, hour_bucket, min_cr_48h, cr_delta_1h, cr_delta_12h, cr_delta_48h, creatinine_ratio FROM cr_features")
def _(t):
    return creatinine_features(t).select("subject_id", "hour_bucket", "min_cr_48h", "cr_delta_1h", "cr_delta_12h", "cr_delta_48h", "creatinine_ratio")


@query("w4_previous", "SELECT subject_id, hour_bucket, creatinine_prev_1h, creatinine_prev_48h, creatinine_delta_1h, creatinine_delta_48h FROM engineered")
def _(t):
    return engineered(t).select("subject_id", "hour_bucket", "creatinine_prev_1h", "creatinine_prev_48h", "creatinine_delta_1h", "creatinine_delta_48h")


@query("w5_average_velocity", "SELECT subject_id, hour_bucket, round(urine_output_velocity_6h, 8) AS v6, round(urine_output_velocity_12h, 8) AS v12, "
    "round(urine_output_velocity_24h, 8) AS v24 FROM gold_features")
def _(t):
    return gold_features(t).select("subject_id", "hour_bucket", *(F.round(f"urine_output_velocity_{h}h", 8).alias(f"v{h}") for h in (6, 12, 24)))


@query("w6_sum_velocity", "SELECT subject_id, hour_bucket, round(urine_ml_kg_hr_6h, 6) AS v6, round(urine_ml_kg_hr_12h, 6) AS v12, round(urine_ml_kg_hr_24h, "
    "6) AS v24 FROM engineered")
def _(t):
    return engineered(t).select("subject_id", "hour_bucket", *(F.round(f"urine_ml_kg_hr_{h}h", 6).alias(f"v{h}") for h in (6, 12, 24)))


@query("w7_rolling_sum", "SELECT subject_id, hour_bucket, round(sum(urine_ml) OVER (PARTITION BY subject_id ORDER BY hour_bucket ROWS 5 PRECEDING), "
    "6) AS urine_6h FROM urine_hours")
def _(t):
    return urine_hours(t).select("subject_id", "hour_bucket", F.round(F.sum("urine_ml").over(series.rows_back(6)), 6).alias("urine_6h"))


@query("w8_partition_min", "SELECT subject_id, hour_bucket, baseline_creatinine FROM engineered")
def _(t):
    return engineered(t).select("subject_id", "hour_bucket", "baseline_creatinine")


@query("w9_running_max", "SELECT subject_id, hour_bucket, max(kdigo_stage) OVER (PARTITION BY subject_id ORDER BY hour_bucket ROWS UNBOUNDED PRECEDING) AS max_stage FROM staged")
def _(t):
    from .clinical import staged

    return staged(t).select("subject_id", "hour_bucket", F.max("kdigo_stage").over(series.by_subject().rowsBetween(Window.unboundedPreceding, 0)).alias("max_stage"))


@query("w14_duplicate_hours", "SELECT coalesce(sum(n - 1), 0)::BIGINT AS duplicate_rows FROM (SELECT count(*) AS n FROM creat GROUP BY subject_id, date_trunc('hour', charttime))")
def _(t):
    return creat(t).groupBy("subject_id", fn.hour_bucket("charttime")).agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1),
        F.lit(0)).cast("long").alias("duplicate_rows"))


@query("w15_range_48h", """SELECT labevent_id, min(valuenum) OVER w AS min_48h, count(*) OVER w AS n_48h FROM creat
    WINDOW w AS (PARTITION BY subject_id ORDER BY charttime RANGE BETWEEN INTERVAL 48 HOUR PRECEDING AND CURRENT ROW)""")
def _(t):
    return creat(t).select("labevent_id", series.trailing(F.min("valuenum"), 48).alias("min_48h"), series.trailing(F.count("*"), 48).alias("n_48h"))


# ---- sorts, sets, increments

@query("o2_top_k", "SELECT event_id, value FROM events ORDER BY value DESC, event_id LIMIT 25")
def _(t):
    return t.events.select("event_id", "value").orderBy(F.desc("value"), "event_id").limit(25)


@query("o3_latest", "SELECT event_id, ts FROM events ORDER BY ts DESC, event_id LIMIT 100")
def _(t):
    return t.events.select("event_id", "ts").orderBy(F.desc("ts"), "event_id").limit(100)


@query("o5_newest_per_patient", "SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, "
    "event_id) AS n FROM events) WHERE n <= 3")
def _(t):
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), "event_id")
    return t.events.withColumn("n", F.row_number().over(w)).filter("n <= 3").select("user_id", "event_id")


@query("u1_union_padded", "SELECT subject_id, charttime, 'creatinine' AS event_type, valuenum AS creatinine, "
    "CAST(NULL AS DOUBLE) AS urine_ml FROM creat UNION ALL SELECT subject_id, charttime, 'urine', NULL, value FROM urine")
def _(t):
    c = creat(t).select("subject_id", "charttime", F.lit("creatinine").alias("event_type"), F.col("valuenum").alias("creatinine"))
    u = urine(t).select("subject_id", "charttime", F.lit("urine").alias("event_type"), F.col("value").alias("urine_ml"))
    return series.timeline(c, u)


@query("u4_row_counts", "SELECT 'events' AS table_name, count(*) AS n FROM events UNION ALL SELECT 'orders', count(*) FROM orders UNION ALL SELECT 'customer', "
    "count(*) FROM customer")
def _(t):
    parts = [t.read(n).agg(F.count("*").alias("n")).select(F.lit(n).alias("table_name"), "n") for n in ("events", "orders", "customer")]
    return parts[0].union(parts[1]).union(parts[2])


@query("i1_incremental_upsert", """SELECT subject_id, hour_bucket, charttime, creatinine FROM (SELECT *, max(charttime) FILTER (charttime < TIMESTAMP '2024-01-15')
    OVER () AS high FROM silver_cr) s
    WHERE charttime > high OR (charttime < TIMESTAMP '2024-01-15')""")
def _(t):
    s = silver_creatinine(t)
    return incremental.upsert(s.filter("charttime < TIMESTAMP_NTZ '2024-01-15'"), s, ["subject_id", "hour_bucket"], "charttime")


# ---- scalar functions

@query("f1_hour_bucket", "SELECT event_id, date_trunc('hour', ts) AS hour_bucket FROM events")
def _(t):
    return t.events.select("event_id", fn.hour_bucket("ts").alias("hour_bucket"))


@query("f2_f3_hours", "SELECT o_orderkey, l_linenumber, date_diff('hour', o_orderdate, l_shipdate) AS hours, "
    "(epoch(l_shipdate) - epoch(o_orderdate)) / 3600.0::DOUBLE AS hours_exact FROM orders JOIN lineitem ON o_orderkey = l_orderkey")
def _(t):
    joined = t.read("orders").select("o_orderkey",
        "o_orderdate").join(t.read("lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_shipdate"), "o_orderkey")
    return joined.select("o_orderkey", "l_linenumber", fn.hour_boundaries("o_orderdate", "l_shipdate").alias("hours"),
        fn.fractional_hours("o_orderdate", "l_shipdate").alias("hours_exact"))


@query("f5_f6_ratio", "SELECT l_orderkey, l_linenumber, l_quantity / nullif(l_discount, 0) AS r, coalesce(nullif(l_tax, 0), -1) AS t, greatest(l_tax, "
    "l_discount) AS g FROM lineitem")
def _(t):
    return t.read("lineitem").select("l_orderkey", "l_linenumber", fn.safe_ratio("l_quantity", "l_discount").alias("r"),
        F.coalesce(F.nullif(F.col("l_tax"), F.lit(0.0)), F.lit(-1.0)).alias("t"), F.greatest("l_tax", "l_discount").alias("g"))


@query("f8_f9_f11_ages", """SELECT subject_id, CASE WHEN anchor_age < 65 THEN '<65' ELSE '>=65' END AS age_group,
    CASE WHEN anchor_age IS NULL THEN 'unknown' WHEN anchor_age < 40 THEN '<40' WHEN anchor_age < 50 THEN '40-49' WHEN anchor_age < 60 THEN '50-59'
    WHEN anchor_age < 70 THEN '60-69' WHEN anchor_age < 80 THEN '70-79' ELSE '80+' END AS decade,
    CASE WHEN anchor_age <= 0 THEN NULL WHEN anchor_age <= 18 THEN '<18' WHEN anchor_age <= 30 THEN '18-30' WHEN anchor_age <= 40 THEN '30-40' WHEN anchor_age <= 50
    THEN '40-50' WHEN anchor_age <= 60 THEN '50-60' WHEN anchor_age <= 70 THEN '60-70' WHEN anchor_age <= 80 THEN '70-80' WHEN anchor_age <= 120 THEN '80+' END AS age_bin
    FROM raw_patients""")
def _(t):
    return t.raw_patients.select("subject_id", fn.age_group("anchor_age").alias("age_group"), fn.generalize_age("anchor_age").alias("decade"),
        fn.age_bin("anchor_age").alias("age_bin"))


@query("f10_care_units", "SELECT subject_id, CASE WHEN lower(care_unit) LIKE '%med%' THEN 'medical' WHEN lower(care_unit) LIKE '%surg%' OR lower(care_unit) LIKE "
    "'%sicu%' THEN 'surgical' WHEN lower(care_unit) LIKE '%card%' OR lower(care_unit) LIKE '%ccu%' THEN 'cardiac' ELSE 'other' END AS unit FROM raw_patients")
def _(t):
    return t.raw_patients.select("subject_id", fn.generalize_care_unit("care_unit").alias("unit"))


@query("f12_f22_event_key", "SELECT event_id, user_id || '|' || strftime(ts, "
    "'%Y-%m-%d %H:%M:%S') || '|' || event_type || '|' || CAST(floor(value)::BIGINT AS VARCHAR) AS key FROM events")
def _(t):
    return t.events.select("event_id", fn.event_key("user_id", "ts", "event_type", F.floor("value")).alias("key"))


@query("f14_dialysis_flag", "SELECT c_custkey, CAST(regexp_matches(lower(c_mktsegment), 'dialysis|crrt|building') AS INTEGER) AS flag FROM customer")
def _(t):
    drug = F.when(F.col("c_mktsegment") == "BUILDING", "Hemodialysis set").otherwise(F.col("c_mktsegment"))
    return t.read("customer").select("c_custkey", fn.dialysis_flag(drug).alias("flag"))


@query("f17_json", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def _(t):
    return t.events.select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


@query("f18_hashes", "SELECT user_id, sha256(CAST(user_id AS VARCHAR)) AS sha2, CAST(('0x' || substr(sha1(CAST(user_id AS VARCHAR)), 1, "
    "8)) AS BIGINT) AS h32 FROM (SELECT DISTINCT user_id FROM events)")
def _(t):
    u = t.events.select("user_id").distinct()
    text = F.col("user_id").cast("string")
    return u.select("user_id", F.sha2(text, 256).alias("sha2"), fn.hash32(text).alias("h32"))


@query("f19_trailing_zeros", "SELECT event_id, CASE WHEN event_id = 0 THEN 0 ELSE bit_count((event_id & -event_id) - 1)::INTEGER END AS tz FROM events")
def _(t):
    return t.events.select("event_id", fn.trailing_zeros("event_id").cast("int").alias("tz"))


@query("f21_percent_text", "SELECT event_type, printf('%s: %.2f%%', event_type, 100.0::DOUBLE * count(*) / (SELECT count(*) FROM events)) AS share FROM events GROUP BY 1")
def _(t):
    n = t.events.groupBy("event_type").agg(F.count("*").alias("n"))
    total = t.events.agg(F.count("*").alias("total"))
    return n.join(F.broadcast(total)).select("event_type", fn.percent_text("event_type", F.col("n") / F.col("total")).alias("share"))


@query("s1_null_tokens", "SELECT event_id, CASE WHEN event_type IN ('error', 'view') THEN NULL ELSE event_type END AS event_type FROM events")
def _(t):
    raw = F.when(F.col("event_type") == "error", "NULL").when(F.col("event_type") == "view", "").otherwise(F.col("event_type"))
    return t.events.select("event_id", fn.null_tokens(raw).alias("event_type"))


@query("s12_s13_replay", """SELECT topic, count(*) AS n FROM (SELECT CASE event_type WHEN 'purchase' THEN 'aki.labs.events' WHEN 'click' THEN 'aki.fluids.events'
    WHEN 'view' THEN 'aki.vitals.events' END AS topic FROM events) GROUP BY 1""")
def _(t):
    from ..streaming.replay import counts, routed

    kind = F.when(F.col("event_type") == "purchase", " Creatinine ").when(F.col("event_type") == "click", "urine").when(F.col("event_type") == "view", "SPO2").otherwise("ekg")
    return counts(routed(t.events.select(F.col("user_id").alias("subject_id"), F.col("ts").alias("charttime"), kind.alias("event_type"), "value", F.lit("u").alias("valueuom"))))


def outer_hours(t):
    hours = series.last_of_hour(creat(t), "valuenum", "labevent_id")
    return series.outer_hours(hours, urine_hours(t).withColumnRenamed("urine_ml", "urine_output_ml"), ["subject_id", "hour_bucket"])


def engineered(t):
    return series.engineer(outer_hours(t))


def gold_features(t):
    joined = creatinine_features(t).join(urine_hours(t), ["subject_id", "hour_bucket"], "left")
    return series.average_velocity(joined)
