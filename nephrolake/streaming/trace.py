"""Stateful traces of patients, watermarked dedup and live aggregates.

State is a subject's readings of the last 48 hours and the keys of its events
in that time, kept in the state store, so a restart from the checkpoint goes on
where it stopped. Each event gives one trace, in order of event time (and id)
within a micro-batch; a repeated event is marked DUP and changes nothing.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators import kdigo
from ..sources.files import score_rows
from . import live

HOURS, WEIGHT = 48, 70.0
CREATININE, URINE = ("creatinine", "cr"), ("urine", "urine_output", "uo")
#: What the state function emits; staging and scores follow as columns.
SNAPSHOT = "patient_id string, timestamp timestamp, event_type string, value double, bloom string, n_events long, cr_current double, baseline_cr_48h double, cr_ratio double, cr_delta_48h double, urine_velocity_6h double, urine_velocity_12h double, urine_velocity_24h double"
STATE = "cr array<struct<ts:long,v:double>>, uo array<struct<ts:long,v:double>>, n long, last long, seen array<struct<ts:long,k:long>>"
_SECOND = 1_000_000


class Subject:
    """Readings in arrival order; the newest event time is the anchor."""

    def __init__(self, cr=(), uo=(), n: int = 0, last: int | None = None, seen=()) -> None:
        self.cr, self.uo, self.n, self.last = [tuple(x) for x in cr], [tuple(x) for x in uo], n, last
        self.seen = {int(k): int(ts) for ts, k in seen}

    def mark(self, kind: str | None, value: float | None, ts: int) -> str:
        """UNIQUE or DUP, by time, kind and value, within the hours of the state."""
        digest = hashlib.blake2b(f"{ts}|{kind}|{value}".encode(), digest_size=8).digest()
        key = int.from_bytes(digest, "little", signed=True)
        known = key in self.seen
        self.seen[key] = ts
        edge = max(self.seen.values()) - HOURS * 3600 * _SECOND
        self.seen = {k: at for k, at in self.seen.items() if at >= edge}
        return "DUP" if known else "UNIQUE"

    def take(self, kind: str | None, value: float | None, ts: int) -> None:
        """A reading without a value still moves nothing; one of another kind
        moves the anchor and counts."""
        if value is None or pd.isna(value):
            return
        self.n += 1
        self.last = ts if self.last is None else max(self.last, ts)
        name = (kind or "").strip().lower()
        if name in CREATININE:
            self.cr.append((ts, float(value)))
        elif name in URINE:
            self.uo.append((ts, float(value)))
        edge = self.last - HOURS * 3600 * _SECOND
        self.cr, self.uo = [x for x in self.cr if x[0] >= edge], [x for x in self.uo if x[0] >= edge]

    def urine(self, hours: int) -> float | None:
        own = [v for ts, v in self.uo if self.last is not None and ts >= self.last - hours * 3600 * _SECOND]
        return sum(own) / (WEIGHT * hours) if own else None

    def snapshot(self) -> dict:
        now = self.cr[-1][1] if self.cr else None
        base = min((v for _, v in self.cr), default=None)
        return {
            "n_events": self.n, "cr_current": now, "baseline_cr_48h": base, "cr_ratio": round(now / base, 4) if now is not None and base else None,
            "cr_delta_48h": round(now - base, 4) if now is not None else None,
            "urine_velocity_6h": self.urine(6), "urine_velocity_12h": self.urine(12), "urine_velocity_24h": self.urine(24),
        }


def _step(key: tuple, frames: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    if state.exists:
        cr, uo, n, last, seen = state.get
        plain = lambda pairs: [tuple(r.values()) if isinstance(r, dict) else tuple(r) for r in pairs]
        subject = Subject(plain(cr), plain(uo), n, last, plain(seen))
    else:
        subject = Subject()
    events = pd.concat(list(frames), ignore_index=True).sort_values(["charttime", "event_id"], kind="stable")
    rows = []
    for r in events.itertuples(index=False):
        ts = int(pd.Timestamp(r.charttime).value // 1000)
        mark = subject.mark(r.event_type, r.value, ts)
        if mark == "UNIQUE":
            subject.take(r.event_type, r.value, ts)
        rows.append({"patient_id": str(key[0]), "timestamp": r.charttime, "event_type": r.event_type, "value": r.value, "bloom": mark} | subject.snapshot())
    seen = [(at, k) for k, at in subject.seen.items()]
    state.update((subject.cr, subject.uo, subject.n, subject.last if subject.last is not None else 0, seen))
    out = pd.DataFrame(rows)
    for c in out.columns:
        if c not in ("patient_id", "timestamp", "event_type", "bloom", "n_events"):
            out[c] = out[c].astype("float64")
    yield out


def with_scores(snapshots: DataFrame) -> DataFrame:
    """Stage, rule and score of each snapshot, as column expressions."""
    uo = [f"urine_velocity_{h}h" for h in (6, 12, 24)]
    c = kdigo.classify("cr_current", "baseline_cr_48h", *uo)
    return snapshots.withColumns({"kdigo_stage": c["stage"], "triggered_by": c["triggered_by"],
        "anomaly_score": kdigo.anomaly_score("cr_ratio", "cr_delta_48h", "urine_velocity_6h")})


def traces(events: DataFrame) -> DataFrame:
    """One trace per event of a stream: subject_id, charttime (timestamp),
    event_type, value, event_id."""
    slim = events.select(F.col("subject_id").cast("string").alias("subject_id"), F.col("charttime").cast("timestamp").alias("charttime"), "event_type", "value", "event_id")
    return with_scores(slim.groupBy("subject_id").applyInPandasWithState(_step, SNAPSHOT, STATE, "append", GroupStateTimeout.NoTimeout))


def process(rows: list[dict]) -> list[dict]:
    """Traces of a short list of events, in the order given (tests, notebooks)."""
    subjects, out = {}, []
    for e in rows:
        s = subjects.setdefault(str(e["subject_id"]), Subject())
        ts = pd.Timestamp(e["charttime"])
        mark = s.mark(e["event_type"], e["value"], int(ts.value // 1000))
        try:
            if mark == "UNIQUE":
                s.take(e["event_type"], None if e["value"] is None else float(e["value"]), int(ts.value // 1000))
        except (TypeError, ValueError):
            pass  # a value that is no number still gives a trace
        out.append({"patient_id": str(e["subject_id"]), "timestamp": ts.to_pydatetime(), "event_type": e["event_type"], "bloom": mark} | s.snapshot())
    return out


def dedup(events: DataFrame, key: str = "event_id", time: str = "event_time", delay: str = "6 hours") -> DataFrame:
    """First sightings within the watermark; as it is where a column is missing."""
    if not {key, time} <= {*events.columns}:
        return events
    return events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def live_counts(events: DataFrame, time: str = "charttime", window: str = "1 hour", slide: str = "10 minutes", delay: str = "1 hour") -> DataFrame:
    """Events and distinct subjects of sliding windows."""
    at = events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay)
    counted = at.groupBy(F.window(time, window, slide).alias("w")).agg(F.count("*").alias("events"), F.approx_count_distinct("subject_id").alias("subjects"))
    return counted.select(F.col("w.start").alias("window_start"), "events", "subjects")


def score_sink(path: str):
    """A foreachBatch function that counts subjects and events, drops repeated
    events and writes scores once for each batch, so that a batch that runs
    again replaces what it wrote."""
    count = live.counters(f"{path}/_counters")

    def write(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        rows = score_rows(count(batch, batch_id).filter("bloom = 'UNIQUE'"))
        rows.withColumn("ingested_at", F.current_timestamp()).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")
        batch.unpersist()

    return write


def nested_trace(t: DataFrame) -> DataFrame:
    """The older, nested document as JSON; counters, group size and twins are in
    it where their columns are there."""
    there = lambda *names: [c for c in names if c in t.columns]
    vector = F.array("cr_current", "baseline_cr_48h", "cr_ratio", "cr_delta_48h", *(f"urine_velocity_{h}h" for h in (6, 12, 24)))
    parts = [
        F.struct("patient_id", "timestamp", *there("event_type", "value")).alias("record"),
        F.struct("kdigo_stage", "anomaly_score", *there("bloom", "fm_distinct_patients", "dgim_events_1h", "k_anonymity")).alias("algorithms"),
        F.struct("cr_current", "baseline_cr_48h", "cr_ratio", "cr_delta_48h", *there("urine_velocity_6h", "urine_velocity_24h")).alias("features"),
        vector.alias("vector"), *there("twins"),
    ]
    return t.select("patient_id", F.to_json(F.struct(*parts)).alias("trace"))


def scored_by_model(stream: DataFrame, model) -> DataFrame:
    """A saved pipeline model applied to a stream; scores lie in [0, 1]."""
    from pyspark.ml.functions import vector_to_array

    return model.transform(stream).withColumn("risk", vector_to_array("probability")[1])
