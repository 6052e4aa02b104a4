"""Further queries: projections, scalar functions, sinks, traces and models."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import clinical as fn
from ..operators import evaluation, kdigo, ml, privacy, series, staging
from ..sources import files
from ..streaming import replay
from . import relational as rel
from .clinical import staged
from .registry import query


@query("p13_u2_timeline", """SELECT subject_id, charttime AS event_time, 'creatinine' AS event_type, valuenum AS value, 'mg/dL' AS unit FROM creat UNION ALL
    SELECT subject_id, charttime, 'urine_output', value, 'mL' FROM urine""")
def _(t):
    part = lambda df, v, kind, unit: df.select("subject_id", F.col("charttime").alias("event_time"), F.lit(kind).alias("event_type"), F.col(v).alias("value"),
        F.lit(unit).alias("unit"))
    return series.timeline(part(rel.creat(t), "valuenum", "creatinine", "mg/dL"), part(rel.urine(t), "value", "urine_output", "mL"))


@query("o1_sorted_timeline", "SELECT user_id, ts, event_type, event_id FROM events ORDER BY user_id, ts, event_type, event_id")
def _(t):
    return t.events.select("user_id", "ts", "event_type", "event_id").orderBy("user_id", "ts", "event_type", "event_id")


@query("p16_non_negative_hours", "SELECT subject_id, hour_bucket, n_readings FROM silver_ur WHERE urine_output_ml >= 0")
def _(t):
    return rel.silver_urine(t).select("subject_id", "hour_bucket", "n_readings")


@query("p18_training_columns", "SELECT subject_id, hour_bucket, creatinine, creatinine_ratio FROM cr_features")
def _(t):
    return staging.existing(rel.creatinine_features(t), ["subject_id", "hour_bucket", "creatinine", "creatinine_ratio", "bun", "weight"])


@query("a3_stay_urine", "SELECT stay_id, date_trunc('hour', charttime) AS chart_hour, round(sum(value), 6) AS urine_ml FROM urine GROUP BY 1, 2")
def _(t):
    return rel.urine(t).groupBy("stay_id", fn.hour_bucket("charttime").alias("chart_hour")).agg(F.round(F.sum("value"), 6).alias("urine_ml"))


@query("a7_a8_group_stats", "SELECT kdigo_stage, round(avg(cr_delta_48h), 6) AS mean_delta, count(cr_delta_48h) AS n_known, count(*) AS n FROM staged GROUP BY 1")
def _(t):
    return staged(t).groupBy("kdigo_stage").agg(F.round(F.avg("cr_delta_48h"), 6).alias("mean_delta"), F.count("cr_delta_48h").alias("n_known"), F.count("*").alias("n"))


@query("a9_w13_group_size", "SELECT subject_id, count(anchor_age) OVER (PARTITION BY gender, care_unit) AS n_known FROM raw_patients")
def _(t):
    sizes = t.raw_patients.groupBy("gender", "care_unit").agg(F.count("anchor_age").alias("n_known"))  # aggregated first: a group may be large
    return t.raw_patients.join(sizes, ["gender", "care_unit"]).select("subject_id", "n_known")


@query("v1_strict_group_size", "SELECT subject_id FROM (SELECT subject_id, gender, care_unit, count(weight) OVER (PARTITION BY gender, "
    "care_unit) AS n FROM raw_patients) WHERE n >= 100")
def _(t):
    return privacy.suppress(t.raw_patients, ["gender", "care_unit"], 100, counted="weight").select("subject_id")


@query("f4_within_30_days", "SELECT l_orderkey, l_linenumber, "
    "CASE WHEN CAST(l_shipdate AS DATE) <= o_orderdate + INTERVAL 30 DAY THEN 1 ELSE 0 END AS soon FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def _(t):
    o = t.read("orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate")
    soon = F.to_date("l_shipdate").cast("timestamp_ntz") <= F.col("o_orderdate") + F.expr("INTERVAL 30 DAYS")
    return t.read("lineitem").select("l_orderkey", "l_linenumber", "l_shipdate").join(o, "l_orderkey").select("l_orderkey", "l_linenumber", soon.cast("int").alias("soon"))


@query("f7_half_even", "SELECT event_id, round_even((event_id % 1000) / 8.0::DOUBLE, 2) AS r FROM events")
def _(t):
    return t.events.select("event_id", F.bround((F.col("event_id") % 1000) / F.lit(8.0), 2).alias("r"))


@query("f13_normalised", "SELECT event_id, lower(trim('  ' || upper(event_type) || ' ')) AS kind FROM events")
def _(t):
    return t.events.select("event_id", F.lower(F.trim(F.concat(F.lit("  "), F.upper("event_type"), F.lit(" ")))).alias("kind"))


@query("f15_tolerant_casts", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE value END AS v FROM events")
def _(t):
    text = F.when(F.col("event_id") % 3 == 0, "n/a").otherwise(F.col("value").cast("string"))
    return t.events.select("event_id", fn.to_number(text).alias("v"))


@query("f16_time_forms", "SELECT event_id, date_trunc('second', ts) AS at FROM events")
def _(t):
    base = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    form = F.element_at(F.array(base, F.concat(F.replace(base, F.lit(" "), F.lit("T")), F.lit("Z")),
        F.concat(F.replace(base, F.lit(" "), F.lit("T")), F.lit("+02:00"))), (F.col("event_id") % 3).cast("int") + 1)
    return t.events.select("event_id", fn.parse_time(form).alias("at"))


@query("f20_distance", "SELECT vec_id, round(sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS norm FROM embeddings")
def _(t):
    from ..operators.similarity import distance

    v = F.col("embedding").cast("array<double>")
    return t.read("embeddings").select("vec_id", F.round(distance(v, F.transform(v, lambda x: F.lit(0.0))), 6).alias("norm"))


@query("s5_row_count_report", "SELECT 'nation' AS table_name, count(*) AS n FROM nation UNION ALL SELECT 'region', count(*) FROM region UNION ALL SELECT 'supplier', "
    "count(*) FROM supplier")
def _(t):
    return files.row_counts({n: t.read(n) for n in ("nation", "region", "supplier")})


@query("s15_synthetic_events")
def _(t):
    """Random readings; tests check their bounds."""
    return replay.synthetic(t.spark, 20, 10)


@query("s24_newest_traces", "SELECT user_id AS patient_id, event_id FROM (SELECT user_id, event_id, "
    "row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events) WHERE n <= 10")
def _(t):
    doc = F.to_json(F.struct(F.col("user_id").alias("patient_id"), F.lpad(F.col("event_id").cast("string"), 12, "0").alias("timestamp"), "event_id"))
    lines = t.events.select(F.concat(F.lit("INFO [PATIENT_TRACE] "), doc).alias("value"))
    return files.traces_from_log(lines, "patient_id long, timestamp string, event_id long", keep=10).select("patient_id", "event_id")


@query("t2_t3_state_snapshot", """SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n_events,
    min(CASE WHEN event_type <> 'click' THEN value / 10 END) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 48 HOUR PRECEDING AND CURRENT ROW) AS baseline_cr_48h,
    round(sum(CASE WHEN event_type = 'click' THEN value END) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 6 HOUR PRECEDING
    AND CURRENT ROW) / (70.0::DOUBLE * 6), 6) AS urine_velocity_6h FROM events""")
def _(t):
    """The batch twin of the stream's state."""
    e = t.events.select("event_id", "user_id", "ts", F.when(F.col("event_type") != "click", F.col("value") / 10).alias("cr"),
        F.when(F.col("event_type") == "click", F.col("value")).alias("uo"))
    back = lambda c, h: series.trailing(c, h, "user_id", "ts")
    n = F.count("*").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return e.select("event_id", n.alias("n_events"), back(F.min("cr"), 48).alias("baseline_cr_48h"), F.round(back(F.sum("uo"), 6) / (70.0 * 6), 6).alias("urine_velocity_6h"))


@query("z9_windowed_distinct", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, count(*) AS events, count(DISTINCT user_id) AS subjects FROM events GROUP BY 1")
def _(t):
    w = F.window(F.col("ts").cast("timestamp"), "1 hour")
    return t.events.groupBy(w.alias("w")).agg(F.count("*").alias("events"),
        F.count_distinct("user_id").alias("subjects")).select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), "events", "subjects")


@query("e11_histogram", "SELECT CAST(floor(value / 50) AS BIGINT) AS bin, count(*) AS n FROM events GROUP BY 1")
def _(t):
    return t.events.groupBy(F.floor(F.col("value") / 50).alias("bin")).agg(F.count("*").alias("n"))


@query("e9_registry_entry", "SELECT substr(sha256('training_set'), 1, 12) AS run, 0.9::DOUBLE AS auroc")
def _(t):
    entry = files.registry_entry(t.spark, "gbt", "training_set", {"depth": 3}, {"auroc": 0.9})
    return entry.select(F.substring("run_id", 5, 12).alias("run"), F.col("metrics")["auroc"].alias("auroc"))


@query("m1_m3_logistic_regression")
def _(t):
    """Fitted here: no SQL form; tests bound its AUROC."""
    df = staged(t).select("subject_id", "hour_bucket", "creatinine", "creatinine_ratio", "cr_delta_1h", series.label_ahead().alias("target"))
    df = df.withColumn("key", F.xxhash64("subject_id", "hour_bucket"))
    train, test = ml.stratified(df, "target", "key")
    return ml.fit_and_score(train, test, "lr", ["creatinine", "creatinine_ratio", "cr_delta_1h"])[1]


@query("e8_site_metrics", "SELECT source = 'src0' AS here, count(*) AS n, round(avg((p - y) * (p - y)), 9) AS brier FROM scored GROUP BY 1")
def _(t):
    return evaluation.threshold_metrics(t.scored.withColumn("here", F.col("source") == "src0"), ["here"]).select("here", "n", F.round("brier", 9).alias("brier"))
