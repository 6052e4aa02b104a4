"""File sources and sinks: CSV with bad-row accounting, text landing tables,
log traces, JSON, layers of tables. All paths go through Spark's readers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.clinical import null_tokens

CORRUPT = "_corrupt_record"
#: Layer of a table to its database.
DATABASES = {"bronze": "bronze", "staging": "staging", "silver": "silver", "gold": "gold", "mart": "mart"}
TRACE = r"\[PATIENT_TRACE\]\s*(\{.*\})"

# The raw tables' columns.
SCHEMAS = {
    "raw_labevents": "labevent_id long, subject_id long, hadm_id long, specimen_id long, itemid long, charttime timestamp_ntz, storetime timestamp_ntz, value string, "
    "valuenum double, valueuom string, ref_range_lower double, ref_range_upper double, flag string, priority string, comments string",
    "raw_outputevents": "subject_id long, hadm_id long, stay_id long, charttime timestamp_ntz, storetime timestamp_ntz, itemid long, value double, valueuom string",
    "raw_icustays": "subject_id long, hadm_id long, stay_id long, first_careunit string, last_careunit string, intime timestamp_ntz, outtime timestamp_ntz, los double",
    "raw_admissions": "subject_id long, hadm_id long, admittime timestamp_ntz, dischtime timestamp_ntz, deathtime timestamp_ntz, admission_type string, "
    "admission_location string, discharge_location string, insurance string, language string, marital_status string, race string, edregtime timestamp_ntz, "
    "edouttime timestamp_ntz, hospital_expire_flag int",
    "raw_patients": "subject_id long, gender string, anchor_age long, anchor_year long, anchor_year_group string, dod date",
}
LIVE_SCORES = "subject_id long, score_ts timestamp, kdigo_stage int, anomaly_score double, cr_current double, baseline_cr_48h double, cr_ratio double, cr_delta_48h double, urine_velocity_6h double, urine_velocity_12h double, urine_velocity_24h double, bloom_status string, fm_distinct_patients long, dgim_events_1h long, triggered_by string"

TRAINING_SET = "subject_id long, hour_bucket timestamp, kdigo_stage int, creatinine double, creatinine_ratio double, cr_delta_48h double, urine_output_velocity_6h double, urine_output_velocity_24h double, age_group string, gender string, target int"
DP_METRICS = "metric string, group_value string, dp_mean double, dp_count int, epsilon double, mechanism string, sensitivity double, computed_at timestamp"


def schema_of(ddl: str) -> T.StructType:
    return T._parse_datatype_string(ddl)


def read_csv(spark: SparkSession, path: str, ddl: str, mode: str = "PERMISSIVE") -> DataFrame:
    """Header skipped, quotes honoured, '', NULL and null read as NULL in text
    columns; short rows are padded; rows that do not parse keep their line in
    ``_corrupt_record``. Plain or gzipped, one file or many."""
    schema = schema_of(ddl).add(CORRUPT, T.StringType())
    df = spark.read.schema(schema).option("header", True).option("quote", '"').option("nullValue", "NULL").option("mode", mode).option("columnNameOfCorruptRecord",
        CORRUPT).csv(path)
    return df.select(*(null_tokens(f.name).alias(f.name) if isinstance(f.dataType, T.StringType) and f.name != CORRUPT else F.col(f.name) for f in schema))


def read_text_table(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A landing table in which every column is text."""
    return read_csv(spark, path, ", ".join(f"`{c}` string" for c in columns)).drop(CORRUPT)


def copy_into(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(good rows, one row with rows_loaded and errors_seen): bad rows are skipped."""
    others = [c for c in df.columns if c != CORRUPT]
    # a column that nobody asks for is not parsed, and its bad values would pass: a test
    # that always holds asks for all of them, whatever is selected later
    whole = F.xxhash64(*others) >= F.lit(-(2**63))
    good = F.col(CORRUPT).isNull() & whole
    return df.filter(good).drop(CORRUPT), df.agg(F.count_if(good).alias("rows_loaded"), F.count_if(F.col(CORRUPT).isNotNull() & whole).alias("errors_seen"))


def load_tables(spark: SparkSession, root: str, names: list[str] | None = None) -> dict[str, DataFrame]:
    return {n: read_csv(spark, f"{root}/{n}.csv*", SCHEMAS[n]) for n in names or SCHEMAS}


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    parts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), "n") for name, df in tables.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def write_csv(df: DataFrame, path: str, compression: str = "none") -> None:
    df.write.mode("overwrite").option("header", True).option("compression", compression).csv(path)


def database_for(layer: str, prefix: str = "") -> str:
    return f"{prefix}{DATABASES.get(layer, layer)}"


def provision(spark: SparkSession, layers=DATABASES, prefix: str = "") -> None:
    """Databases of the layers and the live score table, if they are not there."""
    for layer in layers:
        spark.sql(f"CREATE DATABASE IF NOT EXISTS {database_for(layer, prefix)}")
    for name, columns in {"live_risk_scores": f"{LIVE_SCORES}, ingested_at timestamp", "training_set": TRAINING_SET, "dp_metrics": DP_METRICS}.items():
        spark.sql(f"CREATE TABLE IF NOT EXISTS {database_for('mart', prefix)}.{name} ({columns}) USING parquet")


def as_declared(df: DataFrame, ddl: str) -> DataFrame:
    """``df`` in the columns and types of a declared table; what it lacks is NULL.
    Fractional counts (noise makes them) are rounded where the table has whole ones."""
    whole = (T.IntegerType, T.LongType)
    value = lambda f: F.round(f.name) if isinstance(f.dataType, whole) and isinstance(df.schema[f.name].dataType, T.DoubleType) else F.col(f.name)
    return df.select(*((value(f) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema_of(ddl)))


def materialize(df: DataFrame, layer: str, name: str, kind: str = "table", prefix: str = "", cluster: list[str] | None = None, unique: list[str] | None = None,
        newest: str | None = None) -> None:
    """``view``: a temporary view. ``table``: a table sorted within partitions
    by the clustering columns. ``incremental``: rows of ``df`` replace those of
    the table with the same ``unique`` columns, only rows later than the
    table's ``newest`` being taken if that is given."""
    if kind == "view":
        df.createOrReplaceTempView(name)
        return
    spark, table = df.sparkSession, f"{database_for(layer, prefix)}.{name}"
    if kind == "incremental" and spark.catalog.tableExists(table):
        old = spark.table(table)
        if newest is not None:
            last = old.agg(F.max(newest)).first()[0]
            df = df if last is None else df.filter(F.col(newest) > F.lit(last))
        merged = old.join(df.select(*unique), unique, "left_anti").unionByName(df) if unique else old.unionByName(df)
        # a table can't be read and written at once: the new one takes its place when it is whole
        merged.write.mode("overwrite").format("parquet").saveAsTable(f"{table}__next")
        spark.sql(f"DROP TABLE {table}")
        spark.sql(f"ALTER TABLE {table}__next RENAME TO {table}")
        return
    if cluster:
        df = df.repartition(*cluster[:1]).sortWithinPartitions(*cluster)
    df.write.mode("overwrite").format("parquet").saveAsTable(table)


def fresh(df: DataFrame, column: str = "computed_at", hours: int = 24) -> Column:
    return F.count_if(F.col(column) > F.current_timestamp() - F.make_dt_interval(F.lit(0), F.lit(hours)))


def traces_from_log(lines: DataFrame, ddl: str, keep: int = 100, column: str = "value") -> DataFrame:
    """Traces in log lines, the newest of each patient."""
    from pyspark.sql import Window

    found = lines.select(F.from_json(F.regexp_extract(column, TRACE, 1), ddl).alias("t")).filter("t.patient_id IS NOT NULL").select("t.*")
    w = Window.partitionBy("patient_id").orderBy(F.desc("timestamp"))
    return found.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= keep).drop("_n")


def score_rows(traces: DataFrame) -> DataFrame:
    """The fifteen columns of the live score table from traces."""
    c = F.col
    return traces.select(
        c("patient_id").cast("long").alias("subject_id"), c("timestamp").cast("timestamp").alias("score_ts"),
        F.coalesce("kdigo_stage", F.lit(0)).cast("int").alias("kdigo_stage"), F.coalesce("anomaly_score", F.lit(0.0)).cast("double").alias("anomaly_score"),
        "cr_current", "baseline_cr_48h", "cr_ratio", "cr_delta_48h", "urine_velocity_6h", "urine_velocity_12h", "urine_velocity_24h",
        F.coalesce("bloom", F.lit("UNIQUE")).alias("bloom_status"), c("fm_distinct_patients").cast("long").alias("fm_distinct_patients"),
        c("dgim_events_1h").cast("long").alias("dgim_events_1h"), "triggered_by")


# ---- registry of model runs

RUN = "run_id string, model string, created_at string, lineage string, params map<string,string>, metrics map<string,double>"


def registry_entry(spark: SparkSession, model: str, lineage: Column | str, params: dict, metrics: dict, source: DataFrame | None = None) -> DataFrame:
    """One row: what was trained, on what (a digest), how, and how well."""
    digest = F.sha2(F.lit(lineage) if isinstance(lineage, str) else lineage, 256)
    base = source if source is not None else spark.range(1)
    return base.select(
        F.concat(F.lit(f"{model}-"), F.substring(digest, 1, 12)).alias("run_id"), F.lit(model).alias("model"),
        F.current_timestamp().cast("string").alias("created_at"), digest.alias("lineage"),
        F.create_map(*(F.lit(str(x)) for kv in params.items() for x in kv)).alias("params") if params else F.create_map().cast("map<string,string>").alias("params"),
        F.create_map(*(x for k, v in metrics.items() for x in (F.lit(k),
        F.lit(float(v))))).alias("metrics") if metrics else F.create_map().cast("map<string,double>").alias("metrics"))


def file_digest(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256) of each file, read by Spark."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"))


def append_run(entry: DataFrame, path: str) -> None:
    entry.write.mode("append").json(path)


def read_runs(spark: SparkSession, path: str, multiline: bool = False) -> DataFrame:
    return spark.read.schema(RUN).option("multiLine", multiline).json(path)


def logic_version(root: str) -> str:
    """The commit that HEAD names, or 'unknown'."""
    import subprocess

    done = subprocess.run(["git", "-C", root, "rev-parse", "HEAD"], capture_output=True, text=True, check=False)
    return done.stdout.strip() or "unknown"
