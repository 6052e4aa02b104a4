"""Staging of acute kidney injury, by named variant.

=============  =================================================================
``v12``        bands that end at 2.99 and 1.99: ratios just below 3 or 2 fall through
``gap_free``   the same rules with bands that meet
``sql_hourly`` creatinine by ratio or value, urine by mL in the hour, greater of both
``stream``     ratio and urine only
``contract``   half-open bands, difference to the baseline, with the rule that fired
=============  =================================================================
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.clinical import col, no_nan, safe_ratio

#: Rules of a stage in order, highest stage first: (stage, name, column, test).
_RULES = (
    (3, "cr_ratio>=3.0", "ratio", lambda c: c >= 3.0),
    (3, "cr_current>=4.0", "current", lambda c: c >= 4.0),
    (3, "uo_24h<0.3", "uo24", lambda c: c < 0.3),
    (2, "2.0<=cr_ratio<3.0", "ratio", lambda c: (c >= 2.0) & (c < 3.0)),
    (2, "uo_12h<0.5", "uo12", lambda c: c < 0.5),
    (1, "cr_delta_48h>=0.3", "delta", lambda c: c >= 0.3),
    (1, "1.5<=cr_ratio<2.0", "ratio", lambda c: (c >= 1.5) & (c < 2.0)),
    (1, "uo_6h<0.5", "uo6", lambda c: c < 0.5),
)
NO_RULE = "none"


def _inputs(**columns) -> dict[str, Column]:
    return {k: no_nan(col(c).cast("double")) for k, c in columns.items()}


def _choose(inputs: dict[str, Column], tests) -> tuple[Column, Column]:
    stage, name = F.lit(0), F.lit(NO_RULE)
    for level, label, key, test in reversed(tests):
        hit = F.coalesce(test(inputs[key]), F.lit(False))
        stage, name = F.when(hit, level).otherwise(stage), F.when(hit, label).otherwise(name)
    return stage, name


def stage_v12(current, ratio, delta, uo6, uo12, uo24) -> Column:
    narrow = [(s, n, k, (lambda c: c.between(2.0, 2.99)) if n.startswith("2.0") else (lambda c: c.between(1.5, 1.99)) if n.startswith("1.5") else t) for s, n, k, t in _RULES]
    return _choose(_inputs(current=current, ratio=ratio, delta=delta, uo6=uo6, uo12=uo12, uo24=uo24), narrow)[0]


def stage_gap_free(current, ratio, delta, uo6, uo12, uo24) -> Column:
    return _choose(_inputs(current=current, ratio=ratio, delta=delta, uo6=uo6, uo12=uo12, uo24=uo24), _RULES)[0]


def classify(current, baseline, uo6, uo12, uo24) -> Column:
    """struct(stage, triggered_by, ratio, delta_48h) of the ``contract`` variant."""
    now, base = no_nan(col(current).cast("double")), no_nan(col(baseline).cast("double"))
    inputs = _inputs(uo6=uo6, uo12=uo12, uo24=uo24) | {"current": now, "ratio": safe_ratio(now, base), "delta": now - base}
    stage, name = _choose(inputs, _RULES)
    return F.struct(stage.alias("stage"), name.alias("triggered_by"), inputs["ratio"].alias("ratio"), inputs["delta"].alias("delta_48h"))


def creatinine_stage_hourly(creatinine, baseline) -> Column:
    ratio = safe_ratio(creatinine, baseline)
    return F.when(ratio.isNull(), 0).when((ratio >= 3.0) | (col(creatinine) >= 4.0), 3).when(ratio >= 2.0, 2).when(ratio >= 1.5, 1).otherwise(0)


def urine_stage_hourly(urine_ml) -> Column:
    return F.when(col(urine_ml) < 30, 2).when(col(urine_ml) < 60, 1).otherwise(0)


def stage_stream(ratio, uo) -> Column:
    by_ratio = F.when(col(ratio) >= 3.0, 3).when(col(ratio) >= 2.0, 2).when(col(ratio) >= 1.5, 1).otherwise(0)
    by_urine = F.when(col(uo) < 0.3, 3).when(col(uo) < 0.5, 2).otherwise(0)
    return F.greatest(by_ratio, by_urine)


def anomaly_score(ratio, delta, uo6, strict: bool = False, digits: int | None = 1) -> Column:
    """0 to 100. ``strict``: the older form, which asks for more than 0.3 and 0.1.
    Rounded half to even, or not at all."""
    r, d, u = col(ratio), col(delta), col(uo6)
    rise = (lambda x: d > x) if strict else (lambda x: d >= x)
    score = F.when(r.isNotNull(), F.least(r * 20, F.lit(50.0))).otherwise(0.0) + F.when(rise(0.3), 15).when(rise(0.1), 8).otherwise(0)
    score += F.when(u < 0.3, 30).when(u < 0.5, 15).otherwise(0)
    return F.least(score if digits is None else F.bround(score, digits), F.lit(100.0))
