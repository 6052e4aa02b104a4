"""Replay of a table as messages for topics, and synthetic readings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.clinical import topic_for

PAYLOAD = "subject_id string, charttime timestamp, event_type string, value double, valueuom string"


def routed(events: DataFrame) -> DataFrame:
    """(topic, key, value): JSON payloads keyed by subject; unrouted kinds have no topic."""
    payload = F.to_json(F.struct(F.col("subject_id").cast("string").alias("subject_id"), F.col("charttime").cast("string").alias("charttime"), "event_type", "value", "valueuom"))
    return events.select(topic_for("event_type").alias("topic"), F.col("subject_id").cast("string").alias("key"), payload.alias("value"),
        F.col("charttime").cast("string").alias("at"))


def counts(messages: DataFrame) -> DataFrame:
    """Messages by topic; those that were skipped under a NULL topic."""
    return messages.groupBy("topic").agg(F.count("*").alias("n"))


def in_order(messages: DataFrame) -> DataFrame:
    """Routed messages in the order of their subject and time, both as text."""
    return messages.filter("topic IS NOT NULL").orderBy("key", "at").select("topic", "key", "value")


def to_kafka(messages: DataFrame, servers: str) -> None:
    """Needs the Kafka connector on the class path."""
    in_order(messages).write.format("kafka").option("kafka.bootstrap.servers", servers).save()


def parsed(messages: DataFrame, *kept: str) -> DataFrame:
    """Typed events from messages, topic and ``kept`` columns as they are."""
    return messages.select("topic", *kept, F.from_json("value", PAYLOAD).alias("e")).select("topic", *kept, "e.*")


def synthetic(spark: SparkSession, subjects: int, readings: int, creatinine: tuple[float, float] = (1.2, 0.4), urine: tuple[float, float] = (60.0, 20.0),
        seed: int = 42) -> DataFrame:
    """Readings around calibrated means; one subject in five is sick."""
    rows = spark.range(subjects * readings).withColumns({"subject_id": F.col("id") % subjects, "n": F.floor(F.col("id") / subjects)})
    sick = F.col("subject_id") % 5 == 0
    cr = F.randn(seed) * creatinine[1] + creatinine[0] + F.when(sick, 1 + 2.5 * F.rand(seed + 1)).otherwise(0)
    ur = F.randn(seed + 2) * urine[1] + urine[0] - F.when(sick, 10 + 20 * F.rand(seed + 3)).otherwise(0)
    at = F.lit("2150-01-01").cast("timestamp") + F.make_dt_interval(F.lit(0), F.col("n").cast("int"))
    is_cr = F.col("n") % 2 == 0
    return rows.select("subject_id", at.alias("charttime"), F.when(is_cr, "creatinine").otherwise("urine").alias("event_type"),
        F.when(is_cr, F.greatest(cr, F.lit(0.2))).otherwise(F.greatest(ur, F.lit(0.0))).alias("value"), F.when(is_cr, "mg/dL").otherwise("mL").alias("valueuom"))
