"""What a running stream needs around its state: topics in, triggers, counters
over all events, group sizes, twins, and the batch twin of the whole path."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..functions.clinical import TOPICS, event_key
from ..operators import kdigo, series, similarity, sketches
from .replay import parsed

#: Seconds between micro-batches; messages and seconds of the older consumer's.
TRIGGER_SECONDS, BATCH_MESSAGES, BATCH_SECONDS = 5, 10, 3
VECTOR = ("cr_current", "baseline_cr_48h", "cr_ratio", "cr_delta_48h", "urine_velocity_6h", "urine_velocity_12h", "urine_velocity_24h")


def kafka_options(servers: str, topics=tuple(TOPICS), starting: str = "earliest", at_most: int | None = None) -> dict[str, str]:
    out = {"kafka.bootstrap.servers": servers, "subscribe": ",".join(topics), "startingOffsets": starting, "failOnDataLoss": "false"}
    return out if at_most is None else out | {"maxOffsetsPerTrigger": str(at_most)}


def typed(messages: DataFrame) -> DataFrame:
    """Events from a topic's rows, with the topic, the broker's time, and the
    offset as an id."""
    text = messages.withColumns({"value": F.col("value").cast("string"), "kafka_ts": F.col("timestamp")})
    named = text.select("topic", "value", "kafka_ts", F.col("offset").alias("event_id"))
    return parsed(named, "kafka_ts", "event_id")


def from_kafka(spark: SparkSession, servers: str, topics=tuple(TOPICS), starting: str = "earliest", at_most: int | None = None) -> DataFrame:
    """Needs the Kafka connector on the class path."""
    return typed(spark.readStream.format("kafka").options(**kafka_options(servers, topics, starting, at_most)).load())


def every(writer: DataStreamWriter, seconds: float | None = TRIGGER_SECONDS) -> DataStreamWriter:
    """Micro-batches at an interval, or None: all that is there, then stop."""
    return writer.trigger(availableNow=True) if seconds is None else writer.trigger(processingTime=f"{int(seconds * 1000)} milliseconds")


def to_console(stream: DataFrame, seconds: float | None = TRIGGER_SECONDS, rows: int = 20) -> DataStreamWriter:
    return every(stream.writeStream.format("console").option("truncate", False).option("numRows", rows), seconds)


def counters(path: str, window_seconds: int = 3600):
    """A function of a micro-batch and its id that adds ``fm_distinct_patients``
    and ``dgim_events_1h``: both count all events, repeated ones too. What is
    kept between batches is a row of registers and the events by minute of the
    last window; batch n reads what batch n - 1 wrote, so a batch that runs
    again gives the same."""

    def add(batch: DataFrame, batch_id: int) -> DataFrame:
        spark = batch.sparkSession
        fresh = sketches.fm_registers(batch, "patient_id").first()
        top = [fresh[f"z{i}"] or 0 for i in range(sketches.REGISTERS)]
        minutes = {r["m"]: r["n"] for r in batch.groupBy(F.floor(F.unix_micros("timestamp") / 60_000_000).alias("m")).agg(F.count("*").alias("n")).orderBy(F.desc("m")).limit(window_seconds // 60 + 1).collect()}
        kept = _read(spark, path, batch_id - 1)
        if kept is not None:
            top = [max(a, b) for a, b in zip(top, kept["registers"], strict=True)]
            for r in kept["minutes"]:
                minutes[r["m"]] = minutes.get(r["m"], 0) + r["n"]
        last = max((m for m in minutes if m is not None), default=0)
        minutes = {m: n for m, n in minutes.items() if m is not None and m > last - window_seconds // 60}
        row = spark.createDataFrame([(top, sorted(minutes.items()))], "registers array<int>, minutes array<struct<m:long,n:long>>")
        row.coalesce(1).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
        return batch.withColumns({"fm_distinct_patients": F.lit(sketches.estimate(top)).cast("long"), "dgim_events_1h": F.lit(sum(minutes.values())).cast("long")})

    return add


def _read(spark: SparkSession, path: str, batch_id: int):
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/batch={batch_id}")
    if batch_id < 0 or not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return None
    return spark.read.parquet(f"{path}/batch={batch_id}").first()


def with_twins(traces: DataFrame, history: DataFrame, projections, k: int = 3) -> DataFrame:
    """``traces`` with ``twins``: the ids of the k nearest rows of a history (id,
    outcome, and the columns of ``VECTOR``, in the same order on both sides)
    among those that share a bucket. An empty list where none does."""
    vector = F.array(*(F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in VECTOR))
    key = F.xxhash64("patient_id", "timestamp", *VECTOR)
    asked = traces.withColumn("_at", key)
    found = similarity.hashed(history.select("id", vector.alias("z")), asked.select(F.col("_at").alias("id"), vector.alias("z")).dropDuplicates(["id"]), projections,
        k, itself=True)
    told = found.join(history.select("id", "outcome"),
        "id").groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "id", "outcome", F.round("distance", 3).alias("dist")))).alias("twins"))
    none = F.array().cast(told.schema["twins"].dataType)
    return asked.join(told, asked["_at"] == told["query_id"], "left").withColumn("twins", F.coalesce("twins", none)).drop("_at", "query_id")


def with_group_size(traces: DataFrame, people: DataFrame, quasi: list[str], key: str = "patient_id") -> DataFrame:
    """``k_anonymity``: the size of the patient's group over ``quasi``, in place of a made-up label."""
    sizes = people.groupBy(*quasi).agg(F.count("*").alias("_k"))
    own = people.select(F.col(key).alias("_p"), *quasi).join(sizes, quasi).select("_p", F.concat(F.lit("k="), F.col("_k")).alias("k_anonymity"))
    return traces.join(own, traces[key] == own["_p"], "left").drop("_p")


def composed(events: DataFrame) -> DataFrame:
    """The batch twin of the stream: first-seen marks, counters over all events
    (repeated ones too), state, stage and score of those that are no repeats.
    events: subject_id, charttime, event_type, value, event_id. Windows end with
    each event, also where it has no value."""
    kind = F.lower(F.trim("event_type"))
    marked = events.withColumn("_key", event_key("subject_id", "charttime", "event_type", "value"))
    marked = sketches.mark_seen(marked, ["_key"], ["charttime", "event_id"]).withColumnRenamed("status", "bloom")
    total = sketches.flajolet_martin(events, "subject_id").first()["estimate"]
    counted = sketches.window_counts(marked, 3600, time="charttime").withColumnRenamed("n_in_window", "dgim_events_1h").filter("bloom = 'UNIQUE'")
    cr, uo = F.when(kind.isin("creatinine", "cr"), F.col("value")), F.when(kind.isin("urine", "urine_output", "uo"), F.col("value"))
    slim = counted.withColumns({"_cr": cr, "_uo": uo})
    back = lambda c, hours: series.trailing(c, hours, "subject_id", "charttime")
    newest = F.max_by("_cr", F.when(F.col("_cr").isNotNull(), F.struct("charttime", "event_id")))
    order = Window.partitionBy("subject_id").orderBy("charttime", "event_id")
    state = slim.select(
        F.col("subject_id").cast("string").alias("patient_id"), F.col("charttime").alias("timestamp"), "event_type", "value", "event_id", "bloom", "dgim_events_1h",
        F.count("value").over(order).alias("n_events"), back(newest, 48).alias("cr_current"), back(F.min("_cr"), 48).alias("baseline_cr_48h"),
        *((back(F.sum("_uo"), h) / (70.0 * h)).alias(f"urine_velocity_{h}h") for h in (6, 12, 24)))
    state = state.withColumns({"cr_ratio": F.round(F.try_divide("cr_current", "baseline_cr_48h"), 4), "cr_delta_48h": F.round(F.col("cr_current") - F.col("baseline_cr_48h"), 4)})
    c = kdigo.classify("cr_current", "baseline_cr_48h", *(f"urine_velocity_{h}h" for h in (6, 12, 24)))
    staged = state.withColumns({"kdigo_stage": c["stage"], "triggered_by": c["triggered_by"],
        "anomaly_score": kdigo.anomaly_score("cr_ratio", "cr_delta_48h", "urine_velocity_6h")})
    return staged.withColumn("fm_distinct_patients", F.lit(total).cast("long"))
