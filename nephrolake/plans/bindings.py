"""How the test tables stand for the clinical model, in Spark and in DuckDB.

``events`` gives readings (all but clicks: creatinine = value / 10), urine
(clicks) and stays (signups); ``customer`` gives patients, ``orders``
admissions. Some readings have no subject, no time, another unit or another
item. Both forms are views: nothing is computed until it is used.
"""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UNITS = ("MICU", "SICU", "CCU", "Med-Surg", "Neuro")

#: DuckDB forms, in order of use.
VIEWS = {
    "raw_labs": """SELECT event_id AS labevent_id, CASE WHEN event_id % 101 <> 0 THEN user_id END AS subject_id, user_id + 100000 AS hadm_id,
        user_id + 500000 AS stay_id, CASE WHEN event_id % 19 = 0 THEN 50971 ELSE CASE event_type WHEN 'purchase' THEN 50912 WHEN 'view' THEN 51081 WHEN 'error'
        THEN 52024 ELSE 52546 END END AS itemid,
        CASE WHEN event_id % 103 <> 0 THEN ts END AS charttime, value / 10 AS valuenum, CASE WHEN event_id % 17 = 0 THEN 'umol/L' WHEN event_id % 107 <> 0
        THEN 'mg/dL' END AS valueuom FROM events WHERE event_type <> 'click'""",
    "raw_outputs": """SELECT event_id, CASE WHEN event_id % 101 <> 0 THEN user_id END AS subject_id, user_id + 100000 AS hadm_id, user_id + 500000 AS stay_id,
        CASE WHEN event_id % 19 = 0 THEN 220045 ELSE 226559 + event_id % 3 END AS itemid, CASE WHEN event_id % 103 <> 0 THEN ts END AS charttime, value,
        'mL' AS valueuom FROM events WHERE event_type = 'click'""",
    "raw_stays": """SELECT user_id AS subject_id, user_id + 100000 AS hadm_id, user_id + 500000 AS stay_id, 'MICU' AS first_careunit,
        min(ts) AS intime, min(ts) + INTERVAL 10 DAY AS outtime, CAST(10.0 AS DOUBLE) AS los FROM events WHERE event_type = 'signup' GROUP BY user_id""",
    "signup_stays": """SELECT event_id AS stay_id, user_id AS subject_id, user_id + 100000 AS hadm_id, ts AS intime, ts + INTERVAL 48 HOUR AS outtime
        FROM events WHERE event_type = 'signup'""",
    "raw_patients": """SELECT c_custkey AS subject_id, CASE WHEN c_custkey % 2 = 0 THEN 'F' ELSE 'M' END AS gender,
        CASE WHEN c_custkey % 13 = 0 THEN NULL ELSE CAST(18 + c_nationkey * 3 AS BIGINT) END AS anchor_age,
        CASE c_custkey % 5 WHEN 0 THEN 'MICU' WHEN 1 THEN 'SICU' WHEN 2 THEN 'CCU' WHEN 3 THEN 'Med-Surg' ELSE 'Neuro' END AS care_unit,
        CAST(40 + c_nationkey * 5 AS DOUBLE) AS weight, CASE WHEN c_custkey % 7 = 0 THEN DATE '1998-01-01' END AS dod, c_mktsegment AS ethnicity FROM customer""",
    "raw_admissions": """SELECT o_custkey AS subject_id, o_custkey + 100000 AS hadm_id, min(o_orderdate) AS admittime,
        min(o_orderdate) + INTERVAL 5 DAY AS dischtime, min(o_orderpriority) AS admission_type FROM orders GROUP BY o_custkey""",
    "creat": """SELECT * FROM raw_labs WHERE itemid IN (50912, 51081, 52024, 52546) AND valuenum BETWEEN 0.3 AND 15.0
        AND valueuom = 'mg/dL' AND subject_id IS NOT NULL AND charttime IS NOT NULL""",
    "urine": """SELECT * FROM raw_outputs WHERE itemid IN (226559, 226560, 226561, 226567, 226627, 226631, 227489) AND value >= 0
        AND subject_id IS NOT NULL AND charttime IS NOT NULL""",
    "silver_cr": """SELECT subject_id, date_trunc('hour', charttime) AS hour_bucket, charttime, valuenum AS creatinine FROM (
        SELECT *, row_number() OVER (PARTITION BY subject_id, date_trunc('hour', charttime) ORDER BY charttime, labevent_id) AS n FROM creat) WHERE n = 1""",
    "silver_ur": """SELECT subject_id, hadm_id, stay_id, date_trunc('hour', charttime) AS hour_bucket, sum(value) AS urine_output_ml, count(*) AS n_readings,
        min(charttime) AS first_charttime, max(charttime) AS last_charttime FROM urine GROUP BY ALL""",
    "urine_hours": "SELECT subject_id, hour_bucket, sum(urine_output_ml) AS urine_ml FROM silver_ur GROUP BY ALL",
    "cr_features": """SELECT *, creatinine / nullif(min_cr_48h, 0) AS creatinine_ratio FROM (
        SELECT *, min(creatinine) OVER (w ROWS BETWEEN 47 PRECEDING AND CURRENT ROW) AS min_cr_48h,
          creatinine - lag(creatinine, 1) OVER w AS cr_delta_1h, creatinine - lag(creatinine, 12) OVER w AS cr_delta_12h, creatinine - lag(creatinine, 48) OVER w AS cr_delta_48h
        FROM silver_cr WINDOW w AS (PARTITION BY subject_id ORDER BY hour_bucket))""",
    "gold_features": """SELECT c.*, u.urine_ml,
        avg(u.urine_ml) OVER (PARTITION BY c.subject_id ORDER BY c.hour_bucket ROWS 5 PRECEDING) / (70.0::DOUBLE * 6) AS urine_output_velocity_6h,
        avg(u.urine_ml) OVER (PARTITION BY c.subject_id ORDER BY c.hour_bucket ROWS 11 PRECEDING) / (70.0::DOUBLE * 12) AS urine_output_velocity_12h,
        avg(u.urine_ml) OVER (PARTITION BY c.subject_id ORDER BY c.hour_bucket ROWS 23 PRECEDING) / (70.0::DOUBLE * 24) AS urine_output_velocity_24h
        FROM cr_features c LEFT JOIN urine_hours u ON c.subject_id = u.subject_id AND c.hour_bucket = u.hour_bucket""",
    "staged": """SELECT *, CASE WHEN creatinine_ratio >= 3.0 OR creatinine >= 4.0 THEN 3 WHEN creatinine_ratio BETWEEN 2.0 AND 2.99 THEN 2
        WHEN cr_delta_48h >= 0.3 OR creatinine_ratio BETWEEN 1.5 AND 1.99 THEN 1 ELSE 0 END AS kdigo_stage FROM cr_features""",
    "outer_hours": """SELECT coalesce(c.subject_id, u.subject_id) AS subject_id, coalesce(c.hour_bucket, u.hour_bucket) AS hour_bucket, c.creatinine,
    coalesce(u.urine_ml, 0) AS urine_output_ml
        FROM (SELECT subject_id, date_trunc('hour', charttime) AS hour_bucket, arg_max(valuenum, (charttime, labevent_id)) AS creatinine FROM creat GROUP BY ALL) c
        FULL JOIN urine_hours u ON c.subject_id = u.subject_id AND c.hour_bucket = u.hour_bucket""",
    "engineered": """SELECT *, creatinine / nullif(baseline_creatinine, 0) AS creatinine_ratio, creatinine - creatinine_prev_1h AS creatinine_delta_1h,
        creatinine - creatinine_prev_48h AS creatinine_delta_48h FROM (
        SELECT *, min(creatinine) OVER (PARTITION BY subject_id) AS baseline_creatinine, lag(creatinine, 1) OVER w AS creatinine_prev_1h, lag(creatinine, 48)
        OVER w AS creatinine_prev_48h,
          sum(urine_output_ml) OVER (w ROWS 5 PRECEDING) / (70.0::DOUBLE * 6) AS urine_ml_kg_hr_6h, sum(urine_output_ml)
          OVER (w ROWS 11 PRECEDING) / (70.0::DOUBLE * 12) AS urine_ml_kg_hr_12h,
          sum(urine_output_ml) OVER (w ROWS 23 PRECEDING) / (70.0::DOUBLE * 24) AS urine_ml_kg_hr_24h
        FROM outer_hours WINDOW w AS (PARTITION BY subject_id ORDER BY hour_bucket))""",
    "scored": """SELECT d.doc_id, d.lang, d.source, l.quality AS y, (d.n_chars % 1000) / 1000.0::DOUBLE AS p FROM documents d JOIN labels l ON d.doc_id = l.doc_id
    WHERE l.quality IS NOT NULL""",
}


def with_views(sql: str) -> str:
    """``sql`` behind the views it uses, directly or through another."""
    used: set[str] = set()

    def visit(text: str) -> None:
        for name in VIEWS:
            if name not in used and re.search(rf"\b{name}\b", text):
                used.add(name)
                visit(VIEWS[name])

    visit(sql)
    ctes = [f"{name} AS ({VIEWS[name]})" for name in VIEWS if name in used]
    if not ctes:
        return sql
    own = sql.lstrip()
    return "WITH " + ",\n".join(ctes) + (",\n" + own[5:] if own.startswith("WITH ") else "\n" + sql)


class Tables:
    """The Spark side of the views, and the plain tables."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def events(self) -> DataFrame:
        return self.read("events")

    def _subject(self) -> list:
        return [F.col("user_id").alias("subject_id"), (F.col("user_id") + 100000).alias("hadm_id"), (F.col("user_id") + 500000).alias("stay_id")]

    def _reading(self, item: Column, other: int) -> list:
        """Whose, which and when: subjects and times are missing here and there,
        and some items are of another kind."""
        k = F.col("event_id")
        return [
            F.when(k % 101 != 0, F.col("user_id")).alias("subject_id"), *self._subject()[1:],
            F.when(k % 19 == 0, other).otherwise(item).alias("itemid"), F.when(k % 103 != 0, F.col("ts")).alias("charttime"),
        ]

    @cached_property
    def raw_labs(self) -> DataFrame:
        k, kind = F.col("event_id"), F.col("event_type")
        item = F.when(kind == "purchase", 50912).when(kind == "view", 51081).when(kind == "error", 52024).otherwise(52546)
        unit = F.when(k % 17 == 0, "umol/L").when(k % 107 != 0, "mg/dL")
        return self.events.filter("event_type <> 'click'").select(
            k.alias("labevent_id"), *self._reading(item, 50971), (F.col("value") / 10).alias("valuenum"), unit.alias("valueuom"))

    @cached_property
    def raw_outputs(self) -> DataFrame:
        k = F.col("event_id")
        return self.events.filter("event_type = 'click'").select("event_id", *self._reading(k % 3 + 226559, 220045), "value", F.lit("mL").alias("valueuom"))

    @cached_property
    def raw_stays(self) -> DataFrame:
        first = self.events.filter("event_type = 'signup'").groupBy("user_id").agg(F.min("ts").alias("intime"))
        return first.select(*self._subject(), F.lit("MICU").alias("first_careunit"), "intime", (F.col("intime") + F.expr("INTERVAL 10 DAYS")).alias("outtime"),
            F.lit(10.0).alias("los"))

    @cached_property
    def signup_stays(self) -> DataFrame:
        return self.events.filter("event_type = 'signup'").select(F.col("event_id").alias("stay_id"), *self._subject()[:2], F.col("ts").alias("intime"),
            (F.col("ts") + F.expr("INTERVAL 48 HOURS")).alias("outtime"))

    @cached_property
    def raw_patients(self) -> DataFrame:
        k = F.col("c_custkey")
        unit = F.element_at(F.array(*map(F.lit, UNITS)), (k % 5).cast("int") + 1)
        return self.read("customer").select(
            k.alias("subject_id"), F.when(k % 2 == 0, "F").otherwise("M").alias("gender"),
            F.when(k % 13 != 0, (F.col("c_nationkey") * 3 + 18).cast("long")).alias("anchor_age"), unit.alias("care_unit"),
            (F.col("c_nationkey") * 5 + 40).cast("double").alias("weight"), F.when(k % 7 == 0, F.lit("1998-01-01").cast("date")).alias("dod"),
            F.col("c_mktsegment").alias("ethnicity"))

    @cached_property
    def raw_admissions(self) -> DataFrame:
        first = self.read("orders").groupBy("o_custkey").agg(F.min("o_orderdate").alias("admittime"), F.min("o_orderpriority").alias("admission_type"))
        return first.select(F.col("o_custkey").alias("subject_id"), (F.col("o_custkey") + 100000).alias("hadm_id"), "admittime",
            (F.col("admittime") + F.expr("INTERVAL 5 DAYS")).alias("dischtime"), "admission_type")

    @cached_property
    def scored(self) -> DataFrame:
        """A score and a label for each document, with groups."""
        labels = self.read("labels").filter("quality IS NOT NULL").select("doc_id", F.col("quality").alias("y"))
        return self.read("documents").select("doc_id", "lang", "source", ((F.col("n_chars") % 1000) / F.lit(1000.0)).alias("p")).join(labels, "doc_id")
