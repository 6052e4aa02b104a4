"""Staging fixtures: every branch, precedence, and the gaps of the older bands."""

import pytest
from pyspark.sql import functions as F

from nephrolake.operators import kdigo

CASES = [
    ((3.6, 1.0, 1, 1, 1), 3, "cr_ratio>=3.0"), ((4.5, 2.5, 1, 1, 1), 3, "cr_current>=4.0"), ((1.0, 1.0, 1, 1, 0.25), 3, "uo_24h<0.3"),
    ((2.4, 1.0, 1, 1, 1), 2, "2.0<=cr_ratio<3.0"), ((1.0, 1.0, 1, 0.4, 1), 2, "uo_12h<0.5"), ((1.4, 1.0, 1, 1, 1), 1, "cr_delta_48h>=0.3"),
    ((0.65, 0.4, 1, 1, 1), 1, "1.5<=cr_ratio<2.0"), ((1.0, 1.0, 0.4, 1, 1), 1, "uo_6h<0.5"), ((1.1, 1.0, 1, 1, 1), 0, "none"),
    ((None,) * 5, 0, "none"), ((1.5, 1.0, 0.4, 0.4, 1), 2, "uo_12h<0.5"), ((1.5, 1.0, 0.4, 0.4, 0.2), 3, "uo_24h<0.3"), ((float("nan"),) * 5, 0, "none"),
    ((1.0, 0.0, 1, 1, 1), 1, "cr_delta_48h>=0.3"),
]


def test_contract(spark):
    floats = lambda x: tuple(None if v is None else float(v) for v in x)
    df = spark.createDataFrame([(i, *floats(c[0])) for i, c in enumerate(CASES)], "i int, a double, b double, u6 double, u12 double, u24 double")
    rows = df.select("i", kdigo.classify("a", "b", "u6", "u12", "u24").alias("c")).orderBy("i").collect()
    assert [(r.c.stage, r.c.triggered_by) for r in rows] == [(s, t) for _, s, t in CASES]


@pytest.mark.parametrize(("ratio", "v12", "free"), [(2.995, 0, 2), (1.995, 0, 1), (2.99, 2, 2), (3.0, 3, 3), (1.5, 1, 1), (1.4999, 0, 0)])
def test_gaps(spark, ratio, v12, free):
    df = spark.range(1).withColumn("r", F.lit(ratio))
    args = (F.lit(1.0), "r", F.lit(0.0), F.lit(1.0), F.lit(1.0), F.lit(1.0))
    assert df.select(kdigo.stage_v12(*args), kdigo.stage_gap_free(*args)).first()[:] == (v12, free)


def test_score(spark):
    df = spark.createDataFrame([(2.5, 0.3, 0.2), (None, None, None), (1.0, 0.1, 0.4)], "r double, d double, u double")
    assert [x[0] for x in df.select(kdigo.anomaly_score("r", "d", "u")).collect()] == [95.0, 0.0, 43.0]
    assert [x[0] for x in df.select(kdigo.anomaly_score("r", "d", "u", strict=True)).collect()] == [88.0, 0.0, 35.0]
