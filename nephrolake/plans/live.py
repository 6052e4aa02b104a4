"""Queries over files, streams and what surrounds them: CSV sources, the
composed stream and its batch twin, score rows, cohorts by offsets, saved models."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import functions as F

from ..operators import evaluation, features, ml, privacy, quality
from ..sources import files
from ..streaming import live, trace
from .clinical import staged
from .registry import query


def _scratch(t) -> str:
    """A folder for files that a query writes and reads back, where the
    session says that executors share one."""
    base = t.spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not t.spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="nephrolake-")
    return f"{base.rstrip('/')}/query-{uuid.uuid4().hex}"


# ---- CSV: every seventh row does not parse, every fifth has a NULL word, gzipped

_CSV = "event_id long, user_id long, event_type string, value double"


def _csv(t) -> str:
    path, k = _scratch(t), F.col("event_id")
    text = t.events.select(k, "user_id", F.when(k % 5 == 0,
        F.element_at(F.array(F.lit("NULL"), F.lit("null")), (k % 2).cast("int") + 1)).otherwise(F.concat(F.col("event_type"),
        F.lit(", so called"))).alias("event_type"), F.when(k % 7 == 0, "n/a").otherwise(F.col("value").cast("string")).alias("value"))
    files.write_csv(text, path, "gzip")
    return path


@query("s2_bad_rows", "SELECT count(*) FILTER (event_id % 7 <> 0) AS rows_loaded, count(*) FILTER (event_id % 7 = 0) AS errors_seen FROM events")
def _(t):
    return files.copy_into(files.read_csv(t.spark, _csv(t), _CSV))[1]


@query("s1_s3_s7_csv_rows", "SELECT event_id, user_id, CASE WHEN event_id % 5 = 0 THEN NULL ELSE event_type || ', so called' END AS event_type, "
    "value FROM events WHERE event_id % 7 <> 0")
def _(t):
    return files.copy_into(files.read_csv(t.spark, _csv(t), _CSV))[0]


@query("s4_s6_s8_text_table", "SELECT CAST(event_id AS VARCHAR) AS event_id, CAST(user_id AS VARCHAR) AS user_id, event_id % 7 = 0 AS unreadable FROM events")
def _(t):
    landed = files.read_text_table(t.spark, f"{_csv(t)}/part-*", ["event_id", "user_id", "event_type", "value"])
    return landed.select("event_id", "user_id", (F.col("value") == "n/a").alias("unreadable"))


@query("s10_s23_run_log", "SELECT 'gbt-' || substr(sha256('events'), 1, 12) AS run_id, 3 AS depth, 0.75::DOUBLE AS auroc, length(sha256('events')) AS digest, true AS dated")
def _(t):
    path = _scratch(t)
    files.append_run(files.registry_entry(t.spark, "gbt", "events", {"depth": 3}, {"auroc": 0.75}), path)
    dated = F.to_timestamp("created_at") > F.lit("2020-01-01").cast("timestamp")
    return files.read_runs(t.spark, path).select("run_id", F.col("params")["depth"].cast("int").alias("depth"), F.col("metrics")["auroc"].alias("auroc"),
        F.length("lineage").cast("long").alias("digest"), dated.alias("dated"))


@query("q3_u5_missing_columns", "SELECT * FROM (VALUES ('charttime'), ('itemid')) v(missing)")
def _(t):
    found = quality.missing_columns(t.raw_labs.drop("charttime", "itemid"), ["subject_id", "charttime", "itemid", "valuenum"])
    return t.spark.createDataFrame([(c,) for c in found], "missing string")


# ---- the composed stream: repeats, counters over all events, state, stage, score

_READINGS = """SELECT CASE WHEN event_id % 101 <> 0 THEN user_id END AS subject_id, ts AS charttime, CASE event_type WHEN 'click' THEN 'uo' WHEN 'error' THEN 'other'
    WHEN 'view' THEN ' CR ' ELSE 'creatinine' END AS event_type,
    CASE WHEN event_id % 97 = 0 THEN NULL WHEN event_type = 'click' THEN value ELSE value / 10 END AS value, event_id FROM events"""
_COMPOSED = f"""WITH first AS ({_READINGS}), src AS (SELECT * FROM first UNION ALL SELECT * REPLACE (event_id + 1000000000 AS event_id) FROM first WHERE event_id % 50 = 0),
  marked AS (SELECT *, row_number() OVER (PARTITION BY subject_id, date_trunc('second', charttime), event_type, value ORDER BY charttime, event_id) AS nth,
    count(*) OVER (ORDER BY charttime RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW) AS dgim_events_1h FROM src),
  slim AS (SELECT *, CASE WHEN lower(trim(event_type)) IN ('cr', 'creatinine') THEN value END AS cr, CASE WHEN event_type = 'uo' THEN value END AS uo FROM marked WHERE nth = 1),
  fm AS (SELECT CASE WHEN max(z) = 0 THEN 0 ELSE round(64 / sum(pow(2.0::DOUBLE, -z)) / 0.77351::DOUBLE)::BIGINT END AS estimate FROM (SELECT i, max(CASE WHEN h = 0
    THEN 0 ELSE bit_count((h & -h) - 1) END) AS z FROM (
    SELECT i, CAST('0x' || substr(sha1(i || '|' || v), 1, 8) AS BIGINT) AS h FROM (SELECT DISTINCT subject_id AS v FROM first WHERE subject_id IS NOT NULL),
    range(64) r(i)) GROUP BY i)),
  state AS (SELECT *, count(value) OVER (PARTITION BY subject_id ORDER BY charttime, event_id ROWS UNBOUNDED PRECEDING) AS n_events,
    arg_max(cr, CASE WHEN cr IS NOT NULL THEN (charttime, event_id) END) OVER h48 AS cr_current, min(cr) OVER h48 AS baseline_cr_48h,
    sum(uo) OVER (PARTITION BY subject_id ORDER BY charttime RANGE BETWEEN INTERVAL 6 HOUR PRECEDING AND CURRENT ROW) / (70.0::DOUBLE * 6) AS u6, sum(uo)
    OVER (PARTITION BY subject_id ORDER BY charttime RANGE BETWEEN INTERVAL 12 HOUR PRECEDING AND CURRENT ROW) / (70.0::DOUBLE * 12) AS u12,
    sum(uo) OVER (PARTITION BY subject_id ORDER BY charttime RANGE BETWEEN INTERVAL 24 HOUR PRECEDING AND CURRENT ROW) / (70.0::DOUBLE * 24) AS u24
    FROM slim WINDOW h48 AS (PARTITION BY subject_id ORDER BY charttime RANGE BETWEEN INTERVAL 48 HOUR PRECEDING AND CURRENT ROW)),
  composed AS (SELECT *, cr_current / nullif(baseline_cr_48h, 0) AS ratio, cr_current - baseline_cr_48h AS delta, (SELECT estimate FROM fm) AS fm_distinct_patients FROM state),
  final AS (SELECT *, CASE WHEN ratio >= 3.0 THEN 'cr_ratio>=3.0' WHEN cr_current >= 4.0 THEN 'cr_current>=4.0' WHEN u24 < 0.3 THEN 'uo_24h<0.3' WHEN ratio >= 2.0
    THEN '2.0<=cr_ratio<3.0'
    WHEN u12 < 0.5 THEN 'uo_12h<0.5' WHEN delta >= 0.3 THEN 'cr_delta_48h>=0.3' WHEN ratio >= 1.5 THEN '1.5<=cr_ratio<2.0' WHEN u6 < 0.5 THEN 'uo_6h<0.5' ELSE 'none'
    END AS triggered_by FROM composed)"""
_STAGE = "CASE WHEN triggered_by IN ('cr_ratio>=3.0', 'cr_current>=4.0', 'uo_24h<0.3') THEN 3 WHEN triggered_by IN ('2.0<=cr_ratio<3.0', 'uo_12h<0.5') THEN 2 WHEN triggered_by = 'none' THEN 0 ELSE 1 END"
_SCORE = "least(CASE WHEN ratio IS NULL THEN 0 ELSE least(round(ratio, 4) * 20, 50) END + CASE WHEN round(delta, 4) >= 0.3 THEN 15 WHEN round(delta, 4) >= 0.1 THEN 8 ELSE 0 END + CASE WHEN u6 < 0.3 THEN 30 WHEN u6 < 0.5 THEN 15 ELSE 0 END, 100)"


def readings(t):
    """Events as messages: spellings of kinds, missing values and subjects, repeats."""
    k, kind = F.col("event_id"), F.col("event_type")
    name = F.when(kind == "click", "uo").when(kind == "error", "other").when(kind == "view", " CR ").otherwise("creatinine")
    value = F.when(k % 97 != 0, F.when(kind == "click", F.col("value")).otherwise(F.col("value") / 10))
    first = t.events.select(F.when(k % 101 != 0, F.col("user_id")).alias("subject_id"), F.col("ts").alias("charttime"), name.alias("event_type"),
        value.alias("value"), k.alias("event_id"))
    return first.unionByName(first.filter("event_id % 50 = 0").withColumn("event_id", k + 1_000_000_000))


@query("t8_composed", f"{_COMPOSED} SELECT event_id, 'UNIQUE' AS bloom, dgim_events_1h, fm_distinct_patients, n_events, cr_current, baseline_cr_48h, round(u6, "
    f"6) AS u6, triggered_by FROM final")
def _(t):
    return live.composed(readings(t)).select("event_id", "bloom", "dgim_events_1h", "fm_distinct_patients", "n_events", "cr_current", "baseline_cr_48h",
        F.round("urine_velocity_6h", 6).alias("u6"), "triggered_by")


@query("s17_s18_score_rows", f"""{_COMPOSED} SELECT subject_id, charttime AS score_ts, {_STAGE} AS kdigo_stage, (floor(d) + CAST(d - floor(d) > 0.5
    OR d - floor(d) = 0.5 AND floor(d) % 2 = 1 AS INTEGER))::DOUBLE / 10 AS anomaly_score, cr_current, baseline_cr_48h, floor(round(ratio,
    4) * 100 + 0.001) / 100 AS cr_ratio, round(delta, 3) AS cr_delta_48h,
    round(u6, 6) AS urine_velocity_6h, round(u12, 6) AS urine_velocity_12h, round(u24, 6) AS urine_velocity_24h, 'UNIQUE' AS bloom_status, fm_distinct_patients,
    dgim_events_1h, triggered_by FROM (SELECT *, CAST(CAST(({_SCORE})::DOUBLE AS VARCHAR) AS DECIMAL(24, 16)) * 10 AS d FROM final)""")
def _(t):
    rows = files.score_rows(live.composed(readings(t)))
    return rows.withColumns({f"urine_velocity_{h}h": F.round(f"urine_velocity_{h}h", 6) for h in (6, 12,
        24)} | {"cr_ratio": F.floor(F.col("cr_ratio") * 100 + 0.001) / 100, "cr_delta_48h": F.round("cr_delta_48h", 3)} | {"score_ts": F.col("score_ts").cast("timestamp_ntz")})


@query("t1_t4_t5_stream_traces", f"{_COMPOSED} SELECT CAST(subject_id AS VARCHAR) AS patient_id, charttime AS at, lower(trim(event_type)) AS kind, n_events, "
    f"cr_current, baseline_cr_48h, triggered_by FROM final WHERE subject_id IS NOT NULL AND value IS NOT NULL")
def _(t):
    """The same through a stream: state store, repeats marked there, all that is
    there in one run. An event without a value has a trace, but moves no window."""
    path = _scratch(t)
    readings(t).filter("subject_id IS NOT NULL").write.parquet(f"{path}/in")
    events = t.spark.readStream.schema(t.spark.read.parquet(f"{path}/in").schema).parquet(f"{path}/in")
    out = trace.traces(events).writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state")
    live.every(out, None).start().awaitTermination()
    done = t.spark.read.parquet(f"{path}/out").filter("bloom = 'UNIQUE' AND value IS NOT NULL")
    return done.select("patient_id", F.col("timestamp").cast("timestamp_ntz").alias("at"), F.lower(F.trim("event_type")).alias("kind"), "n_events", "cr_current",
        "baseline_cr_48h", "triggered_by")


@query("t9_group_size", "SELECT subject_id AS patient_id, 'k=' || count(*) OVER (PARTITION BY gender, care_unit) AS k_anonymity FROM raw_patients")
def _(t):
    return live.with_group_size(t.raw_patients.select(F.col("subject_id").alias("patient_id")), t.raw_patients.withColumnRenamed("subject_id", "patient_id"),
        ["gender", "care_unit"])


# ---- a cohort by offsets, whole: plausible people, labs and intake, hours, features, stage

_OFFSET = """WITH people AS (SELECT subject_id AS id, weight * 2 AS kg FROM raw_patients WHERE anchor_age + subject_id % 5 * 20 BETWEEN 0 AND 120
    AND weight * 2 BETWEEN 30 AND 250),
  labs AS (SELECT event_id, user_id AS id, value / 10 AS v, TIMESTAMP '2022-01-01' + CAST(event_id % 5000 AS INTEGER) * INTERVAL 1 MINUTE AS tm FROM events
    WHERE event_type = 'view' AND value / 10 BETWEEN 0.3 AND 15),
  intake AS (SELECT user_id AS id, value * 100 AS v, TIMESTAMP '2022-01-01' + CAST(event_id % 5000 AS INTEGER) * INTERVAL 1 MINUTE AS tm FROM events
    WHERE event_type = 'click' AND value * 100 BETWEEN 0 AND 5000),
  c AS (SELECT id, date_trunc('hour', tm) AS h, arg_max(v, (tm, event_id)) AS cr FROM labs GROUP BY 1, 2), u AS (SELECT id, date_trunc('hour', tm) AS h, sum(v) AS ml
    FROM intake GROUP BY 1, 2),
  hours AS (SELECT p.id, h, cr, coalesce(ml, 0) AS ml, kg FROM (SELECT coalesce(c.id, u.id) AS id, coalesce(c.h, u.h) AS h, cr, ml FROM c FULL JOIN u ON c.id = u.id
    AND c.h = u.h) j JOIN people p ON j.id = p.id),
  f AS (SELECT *, min(cr) OVER (PARTITION BY id) AS b, cr - lag(cr, 48) OVER w AS d48, sum(ml) OVER (w ROWS 5 PRECEDING) / (kg * 6) AS u6, sum(ml)
    OVER (w ROWS 11 PRECEDING) / (kg * 12) AS u12, sum(ml) OVER (w ROWS 23 PRECEDING) / (kg * 24) AS u24 FROM hours WINDOW w AS (PARTITION BY id ORDER BY h))"""


@query("d3_offset_cohort", f"""{_OFFSET} SELECT id, h AS hour_bucket, cr AS creatinine, b AS baseline_creatinine, round(u12, 6) AS u12,
    CASE WHEN cr / nullif(b, 0) >= 3.0 OR cr >= 4.0 OR u24 < 0.3 THEN 3 WHEN cr / nullif(b, 0) >= 2.0 OR u12 < 0.5 THEN 2 WHEN d48 >= 0.3 OR cr / nullif(b, 0) >= 1.5
    OR u6 < 0.5 THEN 1 ELSE 0 END AS kdigo_stage FROM f""")
def _(t):
    people = t.raw_patients.select("subject_id", (F.col("anchor_age") + F.col("subject_id") % 5 * 20).alias("age"), (F.col("weight") * 2).alias("weight"))
    at = lambda kind, *columns: t.events.filter(F.col("event_type") == kind).select("event_id", F.col("user_id").alias("subject_id"),
        (F.col("event_id") % 5000).cast("int").alias("offset"), *columns)
    labs = at("view", F.lit(" Creatinine").alias("labname"), (F.col("value") / 10).alias("labresult"))
    intake = at("click", (F.col("value") * 100).alias("intake_ml"))
    out = features.offset_cohort(people, labs, intake, "event_id")
    return out.select(F.col("subject_id").alias("id"), "hour_bucket", "creatinine", "baseline_creatinine", F.round("urine_ml_kg_hr_12h", 6).alias("u12"), "kdigo_stage")


# ---- evaluation across sites, protected metrics, saved models

_ECE = "(SELECT sum(n * abs(acc - conf)) / (SELECT count(*) FROM scored WHERE {0}) FROM (SELECT count(*) AS n, avg(p) AS conf, avg(y) AS acc FROM scored WHERE p > 0 AND {0} GROUP BY ceil(p * 10)))"


@query("e8_cross_site", f"SELECT round(a, 9) AS ece_source, round(b, 9) AS ece_target, "
    f"abs(a - b) > 0.05 AS warned FROM (SELECT {_ECE.format('lang = ' + chr(39) + 'en' + chr(39))} AS a, {_ECE.format('lang <> ' + chr(39) + 'en' + chr(39))} AS b)")
def _(t):
    return evaluation.cross_site(t.scored, F.col("lang") == "en").select(F.round("ece_source", 9).alias("ece_source"), F.round("ece_target", 9).alias("ece_target"), "warned")


@query("v4_noise_bounds", "SELECT kdigo_stage, true AS near, true AS noised FROM staged GROUP BY 1")
def _(t):
    """Noise moves a value, and by no more than 60 scales (chance e^-60)."""
    out = privacy.dp_stats(staged(t), "kdigo_stage", "creatinine", seed=7, true_values=True)
    scale = 60 / privacy.EPSILON
    near = (F.abs(F.col("dp_mean") - F.col("mean")) < scale) & (F.abs(F.col("dp_count") - F.col("count")) < scale)
    return out.select("kdigo_stage", near.alias("near"), (F.col("dp_mean") != F.col("mean")).alias("noised"))


@query("s26_dp_metrics", "SELECT 'mean_creatinine' AS metric, CAST(kdigo_stage AS VARCHAR) AS group_value, 'int' AS count_type, true AS filled FROM staged GROUP BY kdigo_stage")
def _(t):
    out = privacy.dp_stats(staged(t), "kdigo_stage", "creatinine", metric="mean_creatinine", seed=7)
    table = files.as_declared(out.withColumn("group_value", F.col("kdigo_stage").cast("string")).withColumn("computed_at", F.current_timestamp()), files.DP_METRICS)
    return table.select("metric", "group_value", F.typeof("dp_count").alias("count_type"), (F.col("dp_mean").isNotNull() & F.col("computed_at").isNotNull()).alias("filled"))


@query("s26_training_set", "SELECT subject_id, hour_bucket, kdigo_stage, creatinine, gender, "
    "CAST(NULL AS DOUBLE) AS urine_output_velocity_6h FROM staged JOIN raw_patients USING (subject_id)")
def _(t):
    table = files.as_declared(staged(t).join(t.raw_patients.select("subject_id", "gender"), "subject_id"), files.TRAINING_SET)
    return table.select("subject_id", F.col("hour_bucket").cast("timestamp_ntz").alias("hour_bucket"), "kdigo_stage", "creatinine", "gender", "urine_output_velocity_6h")


@query("m2_m4_m5_saved_models", "SELECT * FROM (VALUES ('gbt', true, true), ('lr', true, true)) v(model, useful, same)")
def _(t):
    """Boosted trees, and a scaled logistic regression: better than chance on
    rows held out, and the same scores after they are saved and read again."""
    rows = t.read("lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"),
        F.when(F.col("l_orderkey") % 11 > 0, F.col("l_quantity")).alias("a"), "l_discount", (F.col("l_quantity") + F.col("l_orderkey") % 20 > 35).cast("int").alias("target"))
    train, test = ml.stratified(rows, "target", "id")
    out = []
    for kind, scaled in (("gbt", False), ("lr", True)):
        model, metrics = ml.fit_and_score(train, test, kind, ["a", "l_discount"], scaled=scaled, trees=5)
        path = _scratch(t)
        ml.save(model, path)
        scores = lambda m: trace.scored_by_model(test, m).agg(F.sum("risk"), F.min("risk"), F.max("risk")).first()
        a, b = scores(model), scores(ml.load(path))
        out.append((kind, metrics.first()["auroc"] > 0.8, abs(a[0] - b[0]) < 1e-6 * abs(a[0]) and 0 <= b[1] <= b[2] <= 1))
    return t.spark.createDataFrame(out, "model string, useful boolean, same boolean")
