"""Window counts, distinct counts, samples and first-seen marks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.clinical import hash32, trailing_zeros

REGISTERS, PHI = 64, 0.77351


def window_counts(df: DataFrame, seconds: int, key: str | None = None, time: str = "ts") -> DataFrame:
    """Events of a key in the window that ends with each row, both ends in.
    Without a key the count runs over all rows by hour: hours before the last
    window's first are summed, so no task holds the whole stream."""
    micros = F.unix_micros(F.col(time).cast("timestamp"))
    span = seconds * 1_000_000
    if key is not None:
        w = Window.partitionBy(key).orderBy(micros).rangeBetween(-span, 0)
        return df.withColumn("n_in_window", F.count("*").over(w))
    # a row counts in its own slot and lends itself to the next, so windows never cross slots
    slot = F.floor(micros / span)
    lent = df.withColumns({"_t": micros, "_slot": slot, "_own": F.lit(1)}).unionByName(df.withColumns({"_t": micros, "_slot": slot + 1, "_own": F.lit(0)}))
    w = Window.partitionBy("_slot").orderBy("_t").rangeBetween(-span, 0)
    return lent.withColumn("n_in_window", F.count("*").over(w)).filter("_own = 1").drop("_t", "_slot", "_own")


def sliding_counts(df: DataFrame, time: str = "ts", window: str = "1 hour", slide: str = "10 minutes") -> DataFrame:
    counted = df.groupBy(F.window(F.col(time).cast("timestamp"), window, slide).alias("w")).agg(F.count("*").alias("n"))
    return counted.select(F.col("w.start").cast("timestamp_ntz").alias("window_start"), "n")


def _by_register(df: DataFrame, value: str, registers: int) -> DataFrame:
    """(i, z): the most trailing zeros that register i's hash of a value has,
    combined within a task before anything is shuffled."""
    distinct = df.select(F.col(value).cast("string").alias("v")).filter("v IS NOT NULL").distinct()
    per = distinct.select(F.explode(F.sequence(F.lit(0), F.lit(registers - 1))).alias("i"), "v")
    return per.groupBy("i").agg(F.max(trailing_zeros(hash32(F.concat_ws("|", F.col("i").cast("string"), "v")))).alias("z"))


def fm_registers(df: DataFrame, value: str, registers: int = REGISTERS) -> DataFrame:
    """One row, a column z0, z1, ... for each register."""
    return _by_register(df, value, registers).agg(*(F.max(F.when(F.col("i") == i, F.col("z"))).alias(f"z{i}") for i in range(registers)))


def estimate(top: list[int]) -> int:
    """The distinct count that registers stand for."""
    if not any(top):
        return 0
    return round(len(top) / sum(2.0**-z for z in top) / PHI)


def flajolet_martin(df: DataFrame, value: str, registers: int = REGISTERS) -> DataFrame:
    """One row: the estimate from ``registers`` hashes of each distinct value."""
    total = _by_register(df, value, registers).agg(F.max("z").alias("top"), F.sum(F.pow(F.lit(2.0), -F.col("z"))).alias("s"))
    return total.select(F.when(F.coalesce(F.col("top"), F.lit(0)) == 0, 0).otherwise(F.round(registers / F.col("s") / PHI)).cast("long").alias("estimate"))


def reservoir(df: DataFrame, k: int, seed: int, key: str) -> DataFrame:
    """k rows, each as likely as any other, the same for the same seed."""
    return df.orderBy(F.xxhash64(F.lit(seed), F.col(key)), key).limit(k)


def reservoir_md5(df: DataFrame, k: int, seed: int, key: str) -> DataFrame:
    """The same by a hash that other engines have too."""
    return df.orderBy(F.md5(F.concat(F.lit(f"{seed}|"), F.col(key).cast("string"))), key).limit(k)


def mark_seen(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """``status``: UNIQUE for the first row of a key, DUP for the rest. Firsts
    are aggregated and joined back, so a key with many rows stays spread. NULL
    is a key like any other. ``order`` should tell rows of a key apart: those
    that tie for the first place are all UNIQUE."""
    names = [f"_k{i}" for i in range(len(key))]
    first = df.groupBy(*(F.col(k).alias(n) for k, n in zip(key, names, strict=True))).agg(F.min(F.struct(*order)).alias("_first"))
    same = F.lit(True)
    for k, n in zip(key, names, strict=True):
        same = same & F.col(k).eqNullSafe(F.col(n))
    test = F.struct(*order) == F.col("_first")
    return df.join(first, same).withColumn("status", F.when(test, "UNIQUE").otherwise("DUP")).drop("_first", *names)


def seen_stats(df: DataFrame, key: list[str]) -> DataFrame:
    """One row: new keys, duplicate rows, and their share in percent."""
    n = df.groupBy(*key).agg(F.count("*").alias("n")).agg(F.count("*").alias("new"), F.sum("n").alias("total"))
    return n.select("new", (F.coalesce("total", F.lit(0)) - F.col("new")).alias("dup"),
        F.coalesce(F.round(100.0 * F.try_divide(F.col("total") - F.col("new"), F.col("total")), 2), F.lit(0.0)).alias("dup_rate_pct"))
