"""Streams from files: traces, batch equivalence, dedup, sinks; sources and models."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from nephrolake.operators import ml, similarity
from nephrolake.sources import files
from nephrolake.streaming import live, replay, trace

EVENTS = "subject_id string, charttime timestamp, event_type string, value double, event_id long"


def rows(*events):
    return [{"subject_id": s, "charttime": f"2150-01-{1 + h // 24:02d} {h % 24:02d}:00:00", "event_type": k, "value": v} for s, h, k, v in events]


def test_state_fixtures():
    last = lambda *e: trace.process(rows(*e))[-1]
    t = last(("1", 0, "creatinine", 1.2), ("1", 6, "creatinine", 0.8), ("1", 12, "creatinine", 1.5), ("1", 24, "creatinine", 2.4))
    assert t["cr_current"] == 2.4 and t["baseline_cr_48h"] == 0.8 and t["cr_ratio"] == pytest.approx(3) and t["cr_delta_48h"] == pytest.approx(1.6)
    t = last(("1", 0, "creatinine", 0.5), ("1", 72, "creatinine", 1.6), ("1", 80, "creatinine", 2.0))
    assert t["baseline_cr_48h"] == 1.6 and t["cr_ratio"] == 1.25
    t = last(("1", 2, "urine", 250), ("1", 5, "urine", 250), ("1", 6, "creatinine", 1.0))
    assert t["urine_velocity_6h"] == pytest.approx(500 / 420)
    t = last(("1", 0, "urine", 1000), ("1", 10, "urine", 70), ("1", 12, "creatinine", 1.0))
    assert t["urine_velocity_6h"] == pytest.approx(70 / 420) and t["urine_velocity_12h"] == pytest.approx(1070 / 840)
    t = last(("1", 0, "creatinine", None))
    assert t["cr_current"] is None and t["n_events"] == 0
    assert len(trace.process(rows(("1", 0, "creatinine", "x"), ("2", 1, "urine", 3)))) == 2


def stream(spark, tmp_path, df, name="in"):
    df.coalesce(1).write.mode("append").parquet(str(tmp_path / name))
    return spark.readStream.schema(df.schema).parquet(str(tmp_path / name))


def run(spark, df, name, path, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(path)).trigger(availableNow=True).start()
    q.awaitTermination(100)
    return spark.table(name)


def bound(spark):
    e = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    kind = F.when(F.col("event_type") == "click", "urine").when(F.col("event_type") == "error", "other").otherwise("creatinine")
    return e.select(F.col("user_id").cast("string").alias("subject_id"), F.col("ts").cast("timestamp").alias("charttime"), kind.alias("event_type"), "value", "event_id")


def test_stream_equals_batch_window(spark, tmp_path):
    events = bound(spark)
    out = run(spark, trace.traces(stream(spark, tmp_path, events)), "traces", tmp_path / "cp")
    # as the state sees it: readings of the 48 hours up to each event, all kinds moving the anchor
    micros = F.unix_micros("charttime")
    w = Window.partitionBy("subject_id").orderBy(micros).rangeBetween(-48 * 3_600_000_000, 0)
    batch = events.withColumn("b", F.min(F.when(F.col("event_type") == "creatinine", F.col("value"))).over(w)).withColumn("n",
        F.count("*").over(Window.partitionBy("subject_id").orderBy("charttime", "event_id")))
    want = sorted((r.subject_id, r.charttime, r.b is not None and round(r.b, 9)) for r in batch.collect())
    got = sorted((r.patient_id, r.timestamp, r.baseline_cr_48h is not None and round(r.baseline_cr_48h, 9)) for r in out.collect())
    assert got == want and out.filter("kdigo_stage NOT IN (0, 1, 2, 3)").count() == 0


def test_state_survives_a_restart(spark, tmp_path):
    first = spark.createDataFrame([("1", None, "creatinine", 1.0, 1)], EVENTS).withColumn("charttime", F.lit("2150-01-01 00:00:00").cast("timestamp"))
    def go(df):
        q = trace.traces(stream(spark, tmp_path, df)).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation",
            str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination(100)
        return spark.read.parquet(str(tmp_path / "out"))

    go(first)
    second = first.withColumns({"charttime": F.lit("2150-01-01 12:00:00").cast("timestamp"), "value": F.lit(2.5), "event_id": F.lit(2).cast("long")})
    out = go(second).filter("cr_current = 2.5").collect()
    assert [(r.kdigo_stage, r.cr_ratio, r.baseline_cr_48h, r.bloom) for r in out] == [(2, 2.5, 1.0, "UNIQUE")]


def test_dedup_counts_and_sink(spark, tmp_path):
    e = bound(spark)
    twice = e.union(e).withColumn("event_time", F.col("charttime"))
    assert run(spark, trace.dedup(stream(spark, tmp_path, twice)), "once", tmp_path / "c1").count() == e.count()
    assert trace.dedup(e, "nothing") is e
    live = run(spark, trace.live_counts(stream(spark, tmp_path, e, "in2")), "live", tmp_path / "c2")
    assert live.count() > 0 and live.filter("subjects > events").count() == 0
    q = trace.traces(stream(spark, tmp_path, e, "in3")).writeStream.foreachBatch(trace.score_sink(str(tmp_path / "scores"))).option("checkpointLocation",
        str(tmp_path / "c3")).trigger(availableNow=True).start()
    q.awaitTermination(100)
    scores = spark.read.parquet(str(tmp_path / "scores"))
    assert scores.count() == e.count() and len([c for c in scores.columns if c not in ("ingested_at", "batch")]) == 15
    nested = trace.nested_trace(spark.table("once").limit(0).selectExpr("subject_id AS patient_id", "charttime AS timestamp", "event_type", "0 AS kdigo_stage",
        "0.0 AS anomaly_score", "'U' AS bloom", *(f"value AS {c}" for c in ("cr_current", "baseline_cr_48h", "cr_ratio", "cr_delta_48h", "urine_velocity_6h",
        "urine_velocity_12h", "urine_velocity_24h"))))
    assert nested.columns == ["patient_id", "trace"]


@pytest.mark.parametrize(("kind", "topic"), [("creatinine", "labs"), (" BMP ", "labs"), ("lab", "labs"), ("Heart_Rate", "vitals"), ("spo2", "vitals"),
    ("urine", "fluids"), ("IV_total", "fluids"), ("ekg", None), ("", None), (None, None)])
def test_topics(spark, kind, topic):
    df = spark.createDataFrame([(kind,)], "k string")
    from nephrolake.functions.clinical import topic_for

    assert df.select(topic_for("k")).first()[0] == (topic and f"aki.{topic}.events")


def test_replay_round_trip(spark):
    e = replay.synthetic(spark, 10, 6)
    sent = replay.in_order(replay.routed(e))
    back = replay.parsed(sent)
    assert back.count() == e.count() and back.filter("value < 0 OR subject_id IS NULL").count() == 0
    assert {r.topic: r.n for r in replay.counts(replay.routed(e)).collect()} == {"aki.labs.events": 30, "aki.fluids.events": 30}


def test_csv_with_bad_rows(spark, tmp_path):
    (tmp_path / "t.csv").write_text('subject_id,gender,anchor_age,anchor_year,anchor_year_group,dod\n1,"F",50,2000,NULL,\n2,null,xx,2000,a,\n3,M\n')
    df = files.read_csv(spark, str(tmp_path / "t.csv"), files.SCHEMAS["raw_patients"]).cache()
    good, counts = files.copy_into(df)
    assert counts.first()[:] == (1, 2) or counts.first()[:] == (2, 1)
    assert good.filter("subject_id = 1").first().gender == "F" and good.filter("subject_id = 1").first().anchor_year_group is None
    assert {r.table_name: r.n for r in files.row_counts({"a": df, "b": df.limit(0)}).collect()} == {"a": 3, "b": 0}
    files.write_csv(good, str(tmp_path / "out"))
    assert files.read_text_table(spark, str(tmp_path / "out"), good.columns).count() == good.count()


def test_layers_registry_and_log(spark, tmp_path):
    files.provision(spark, prefix="t_")
    files.materialize(spark.range(5), "silver", "five", prefix="t_", cluster=["id"])
    assert spark.table("t_silver.five").count() == 5 and spark.table("t_mart.live_risk_scores").columns[-1] == "ingested_at"
    files.append_run(files.registry_entry(spark, "gbt", "data", {"depth": 3}, {"auroc": 0.9}), str(tmp_path / "runs"))
    run_ = files.read_runs(spark, str(tmp_path / "runs")).first()
    assert run_.run_id.startswith("gbt-") and run_.metrics == {"auroc": 0.9} and len(run_.lineage) == 64
    lines = spark.createDataFrame([("noise",), ('x [PATIENT_TRACE] {"patient_id": "7", "timestamp": "2150-01-01"}',)], "value string")
    assert files.traces_from_log(lines, "patient_id string, timestamp string").first()[:] == ("7", "2150-01-01")
    for name in ("bronze", "staging", "silver", "gold", "mart"):
        spark.sql(f"DROP DATABASE t_{name} CASCADE")


@pytest.mark.parametrize("kind", ["lr", "gbt"])
def test_models(spark, tmp_path, kind):
    df = spark.range(1500).select("id", F.when(F.col("id") % 9 > 0, F.rand(1)).alias("a"), F.rand(2).alias("b")).withColumn("target",
        (F.coalesce("a", F.lit(0.5)) + F.col("b") > 1).cast("int"))
    train, test = ml.stratified(df, "target", "id")
    assert 0.1 < test.count() / 1500 < 0.3
    model, metrics = ml.fit_and_score(train, test, kind, ["a", "b"], scaled=kind == "lr", trees=15)
    assert metrics.first().auroc > 0.85
    ml.save(model, str(tmp_path / "m"))
    scored = trace.scored_by_model(test, ml.load(str(tmp_path / "m")))
    assert scored.filter("risk NOT BETWEEN 0 AND 1").count() == 0


def test_hashed_neighbours_recall(spark):
    v = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("z"))
    q = v.filter("id % 50 = 0")
    exact = {(r.query_id, r.id) for r in similarity.brute_force(v, q, 1).collect()}
    found = {(r.query_id, r.id) for r in similarity.hashed(v, q, similarity.planes(24, 5, 64), 1).collect()}
    assert len(exact & found) >= 0.5 * len(exact)


def test_hashed_neighbours_recall_as_registered(spark):
    import __spark_entry__ as entry

    for data in ("/root/testdata/sf0.001", "/root/testdata/sf0.1"):
        exact, found = ({(r.query_id, r.id) for r in entry.registry.QUERIES[n](spark, data).collect()} for n in ("l3_l5_nearest", "l1_l2_hashed_nearest"))
        assert len(exact & found) >= 0.9 * len(exact) > 0


def test_hashed_search_leaves_broken_vectors_out(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.1]), (3, None), (4, [None, 1.0]), (5, [float("nan"), 1.0]), (6, [])], "id long, z array<double>")
    assert {(r.query_id, r.id) for r in similarity.hashed(v, v, similarity.planes(16, 1, 2), 3).collect()} == {(1, 2), (2, 1)}
    assert similarity.hashed(v.limit(0), v, similarity.planes(2, 1, 2), 3).count() == 0


@pytest.mark.parametrize("itself", [False, True])
def test_hashed_search_meets_each_bucket(spark, monkeypatch, itself):
    """Against all pairs that share a bucket: copies, ties, repeated and missing ids, several blocks."""
    import numpy as np

    rng, planes = random.Random(3), similarity.planes(3, 3, 4)
    rows = [(i, [float(rng.randrange(-2, 3)) for _ in range(4)]) for i in range(300)] + [(i, [1.0, 2.0, 0.5, 0.0]) for i in range(300, 360)]
    rows += rows[5:9] + [(7, [0.5, 0.5, 0.5, 0.5]), (None, [1.0, 1.0, 1.0, 1.0]), (400, None), (401, [1.0, None, 0.0, 0.0]), (402, [float("inf"), 0.0, 0.0, 0.0])]
    sound = [(i, v) for i, v in rows if i is not None and v is not None and None not in v]
    with np.errstate(invalid="ignore"):
        codes = [tuple(map(tuple, (np.array(planes) @ np.array(v) > 0).tolist())) for _, v in sound]
    want = []
    for x, (query, q) in enumerate(sound):
        if query % 10 in (0, 7):
            want += [(query, i, float(np.sqrt(sum((a - b) * (a - b) for a, b in zip(v, q, strict=True))))) for y, (i, v) in enumerate(sound)
                if any(a == b for a, b in zip(codes[x], codes[y], strict=True)) and (itself or i != query)]
    key = lambda r: (r[0], r[2] != r[2], r[2], r[1])  # noqa: E731  NaN comes last
    want.sort(key=key)
    best = [(*r[:2], r[2] if r[2] == r[2] else None) for n, r in enumerate(want) if n < 4 or want[n - 4][0] != r[0]]
    v = spark.createDataFrame(rows, "id long, z array<double>").repartition(3)
    for size, tile in ((similarity.BROADCAST_QUERIES, similarity.TILE_PAIRS), (16, 200)):
        monkeypatch.setattr(similarity, "BROADCAST_QUERIES", size)
        monkeypatch.setattr(similarity, "TILE_PAIRS", tile, raising=False)
        found = similarity.hashed(v, v.filter("id % 10 IN (0, 7)"), planes, 4, itself=itself).select("query_id", "id", F.nanvl("distance", F.lit(None))).collect()
        assert sorted(map(str, map(tuple, found))) == sorted(map(str, best))


def test_hashed_search_sends_on_the_nearest_only(spark, monkeypatch):
    """What tasks send on follows the queries, not the pairs that share a bucket."""
    sent, rank = [], similarity.nearest
    monkeypatch.setattr(similarity, "nearest", lambda candidates, k: sent.append(candidates.count()) or rank(candidates, k))
    v = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("z")).repartition(4)
    assert similarity.hashed(v, v.filter("id % 100 = 0"), similarity.planes(64, 5, 64), 5).count() == 100
    assert 100 <= sent[0] <= 5 * 20 * max(4, spark.sparkContext.defaultParallelism)


def test_brute_force_in_blocks(spark, monkeypatch):
    v = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("z"))
    q = v.filter("id % 40 = 0")
    want = sorted(similarity.brute_force(v, q, 3).select("query_id", "id", "rank").collect())
    monkeypatch.setattr(similarity, "BROADCAST_QUERIES", 4)
    assert sorted(similarity.brute_force(v, q, 3).select("query_id", "id", "rank").collect()) == want


def test_spellings_and_repeats():
    events = rows(("1", 0, "CR ", 1.0), ("1", 1, " uo", 210), ("1", 1, " uo", 210), ("1", 12, "cr", 2.5))
    t = trace.process(events)
    assert [x["bloom"] for x in t] == ["UNIQUE", "UNIQUE", "DUP", "UNIQUE"] and t[2]["urine_velocity_6h"] == pytest.approx(0.5)
    assert (t[-1]["cr_ratio"], t[-1]["cr_delta_48h"], t[-1]["n_events"]) == (2.5, 1.5, 3)
    assert trace.process(rows(("1", 0, "cr", 0.7), ("1", 1, "cr", 1.0)))[-1]["cr_ratio"] == 1.4286


def test_counters_go_on(spark, tmp_path):
    """Registers and minutes carry over from batch to batch; a batch that runs again gives the same."""
    count = live.counters(str(tmp_path / "counters"))
    at = lambda lo, hi, minute: spark.range(lo, hi).select(F.col("id").cast("string").alias("patient_id"),
        F.to_timestamp(F.lit(f"2150-01-01 {minute // 60:02}:{minute % 60:02}:00")).alias("timestamp"))
    get = lambda df, n: count(df, n).select("fm_distinct_patients", "dgim_events_1h").first()[:]
    first, second, late = get(at(0, 500, 0), 0), get(at(400, 3000, 30), 1), get(at(0, 10, 75), 2)
    assert get(at(400, 3000, 30), 1) == second
    assert first[1] == 500 and second[1] == 3100 and late[1] == 2610
    assert 100 < first[0] < 2500 and 600 < second[0] < 15000 and late[0] == second[0]
    whole = at(0, 3000, 0).withColumnRenamed("patient_id", "v")
    from nephrolake.operators import sketches

    assert sketches.flajolet_martin(whole, "v").first()[0] == second[0]


def test_topics_in_and_console(spark, tmp_path, capfd):
    sent = replay.routed(replay.synthetic(spark, 4, 3)).select("topic", "value", F.lit("2150-01-01").cast("timestamp").alias("timestamp"),
        F.monotonically_increasing_id().alias("offset"))
    got = live.typed(sent.withColumn("value", F.col("value").cast("binary")))
    assert got.count() == 12 and {"kafka_ts", "event_id", "topic", "subject_id"} <= {*got.columns}
    o = live.kafka_options("a:1", at_most=10)
    assert o["startingOffsets"] == "earliest" and o["maxOffsetsPerTrigger"] == "10" and o["subscribe"].count(",") == 2
    q = live.to_console(stream(spark, tmp_path, got.select("subject_id", "event_id")), None).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination(60)
    assert q.exception() is None


def test_twins_and_group_size(spark):
    vector = lambda *v: dict(zip(live.VECTOR, map(float, v), strict=True))
    history = spark.createDataFrame([{"id": 1, "outcome": "stable", **vector(1, 1, 1, 0, 1, 1, 1)}, {"id": 2, "outcome": "stage 3", **vector(9, 1, 9, 8, 0, 0, 0)}])
    traces = spark.createDataFrame([{"patient_id": "7", "timestamp": "a", **vector(8, 1, 8, 7, 0, 0, 0)}, {"patient_id": "8", "timestamp": "a", **vector(1, 1, 1, 0, 1, 1, 1)}])
    out = {r.patient_id: r.twins for r in live.with_twins(traces, history, similarity.planes(16, 2, 7), 1).collect()}
    assert out["7"][0]["id"] == 2 and out["7"][0]["outcome"] == "stage 3" and out["8"][0]["id"] == 1 and out["8"][0]["dist"] == 0
    people = spark.createDataFrame([("7", "F", 60), ("8", "F", 60), ("9", "M", 60)], "patient_id string, gender string, age int")
    assert {r.patient_id: r.k_anonymity for r in live.with_group_size(traces, people, ["gender", "age"]).collect()} == {"7": "k=2", "8": "k=2"}


def test_first_seen_with_missing_keys(spark):
    from nephrolake.functions.clinical import event_key
    from nephrolake.operators import sketches

    df = spark.createDataFrame([(None, 1), (None, 2), ("a", 3)], "k string, n int")
    assert sorted(r.status for r in sketches.mark_seen(df, ["k"], ["n"]).collect()) == ["DUP", "UNIQUE", "UNIQUE"]
    keys = df.select(event_key("k", F.lit("2150-01-01 08:00:00").cast("timestamp"), F.lit("creatinine"), F.lit(1.2)).alias("k")).collect()
    assert keys[2].k == "a|2150-01-01 08:00:00|creatinine|1.2" and keys[0].k == "None|2150-01-01 08:00:00|creatinine|1.2"


def test_incremental_table(spark):
    files.provision(spark, ["silver", "mart"], prefix="i_")
    rows_ = lambda *r: spark.createDataFrame(r, "id int, at int, v string")
    for part in (rows_((1, 1, "a"), (2, 1, "b")), rows_((2, 2, "c"), (3, 2, "d"), (9, 0, "old"))):
        files.materialize(part, "silver", "t", "incremental", "i_", unique=["id"], newest="at")
    assert sorted(r[:] for r in spark.table("i_silver.t").collect()) == [(1, 1, "a"), (2, 2, "c"), (3, 2, "d")]
    assert spark.table("i_mart.dp_metrics").columns[:2] == ["metric", "group_value"] and spark.table("i_mart.training_set").columns[-1] == "target"
    for name in ("silver", "mart"):
        spark.sql(f"DROP DATABASE i_{name} CASCADE")
