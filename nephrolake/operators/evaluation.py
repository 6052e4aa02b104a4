"""Metrics of binary scores in SQL terms: (label y, score p), by group.

Rows are first counted by distinct score, so that what is sorted is the
scores, not the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

THRESHOLD, BINS, MIN_GROUP, FLOOR = 0.5, 10, 10, 0.80
#: Bands of a score's unit that prefix sums go by.
BANDS = 1024


def _steps(df: DataFrame, groups: list[str]) -> DataFrame:
    """By group and distinct score, from the highest: positives and negatives so far."""
    n = df.groupBy(*groups, "p").agg(F.sum(F.col("y").cast("long")).alias("pos"), F.sum(1 - F.col("y").cast("long")).alias("neg"))
    # prefix sums by bands of scores: no task holds all the scores of a group, and the bands are few
    n = n.withColumn("_band", F.floor(F.coalesce(F.col("p").cast("double"), F.lit(-1.0)) * BANDS))
    bands = n.groupBy(*groups, "_band").agg(F.sum("pos").alias("_pos"), F.sum("neg").alias("_neg"))
    above, whole = Window.partitionBy(*groups).orderBy(F.desc("_band")).rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(*groups)
    before = lambda c: F.coalesce(F.sum(c).over(above), F.lit(0))
    bands = bands.select(*(F.col(g).alias(f"_g_{g}") for g in groups), F.col("_band").alias("_b"), before("_pos").alias("_tp"), before("_neg").alias("_fp"),
        F.sum("_pos").over(whole).alias("all_pos"), F.sum("_neg").over(whole).alias("all_neg"))
    same = F.col("_band") == F.col("_b")
    for g in groups:
        same = same & F.col(g).eqNullSafe(F.col(f"_g_{g}"))
    down = Window.partitionBy(*groups, "_band").orderBy(F.desc("p")).rowsBetween(Window.unboundedPreceding, 0)
    out = n.join(bands, same).withColumns({"tp": F.col("_tp") + F.sum("pos").over(down), "fp": F.col("_fp") + F.sum("neg").over(down)})
    return out.select(*groups, "p", "pos", "neg", "tp", "fp", "all_pos", "all_neg")


def ranking_metrics(df: DataFrame, groups: list[str]) -> DataFrame:
    """AUROC (ties count half) and average precision; NULL with one class only."""
    s = _steps(df, groups)
    both = (F.first("all_pos") > 0) & (F.first("all_neg") > 0)
    return s.groupBy(*groups).agg(
        F.when(both, F.sum(F.col("neg") * (2 * F.col("tp") - F.col("pos"))) / (2.0 * F.first("all_pos") * F.first("all_neg"))).alias("auroc"),
        F.when(both, F.sum(F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp"))) / F.first("all_pos")).alias("auprc"))


def threshold_metrics(df: DataFrame, groups: list[str], threshold: float = THRESHOLD) -> DataFrame:
    yes, hit = F.col("p") >= threshold, F.col("y") == 1
    n = df.groupBy(*groups).agg(F.count("*").alias("n"), F.count_if(yes & hit).alias("tp"), F.count_if(yes & ~hit).alias("fp"), F.count_if(~yes & hit).alias("fn"),
        F.count_if(~yes & ~hit).alias("tn"), F.avg((F.col("p") - F.col("y")) * (F.col("p") - F.col("y"))).alias("brier"))
    share = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    return n.select(*groups, "n", share(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"), share(F.col("tp"), F.col("tp") + F.col("fn")).alias("recall"),
        share(2.0 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")).alias("f1"), ((F.col("tp") + F.col("tn")) / F.col("n")).alias("accuracy"), "brier")


def calibration_error(df: DataFrame, groups: list[str], bins: int = BINS) -> DataFrame:
    """Bins are closed on the right; a score of 0 is in none."""
    total = df.groupBy(*groups).agg(F.count("*").alias("total"))
    b = df.filter("p > 0").withColumn("bin", F.ceil(F.col("p") * bins)).groupBy(*groups, "bin").agg(F.count("*").alias("n"), F.avg("p").alias("conf"), F.avg("y").alias("acc"))
    gaps = b.groupBy(*groups).agg(F.sum(F.col("n") * F.abs(F.col("acc") - F.col("conf"))).alias("gap"))
    return total.join(gaps, groups, "left").select(*groups, (F.coalesce("gap", F.lit(0.0)) / F.col("total")).alias("ece"))


def cross_site(df: DataFrame, here: Column, bins: int = BINS, gap: float = 0.05) -> DataFrame:
    """One row: calibration error where the model is from and elsewhere, and
    whether they are more than ``gap`` apart."""
    sites = calibration_error(df.withColumn("_here", here), ["_here"], bins)
    one = sites.agg(F.max(F.when(F.col("_here"), F.col("ece"))).alias("ece_source"), F.max(F.when(~F.col("_here"), F.col("ece"))).alias("ece_target"))
    return one.withColumn("warned", F.abs(F.col("ece_source") - F.col("ece_target")) > gap)


def roc_points(df: DataFrame, groups: list[str]) -> DataFrame:
    return _steps(df, groups).select(*groups, F.col("p").alias("threshold"), F.try_divide("fp", "all_neg").alias("fpr"), F.try_divide("tp", "all_pos").alias("tpr"))


def all_metrics(df: DataFrame, groups: list[str]) -> DataFrame:
    return threshold_metrics(df, groups).join(ranking_metrics(df, groups), groups).join(calibration_error(df, groups), groups)


def by_attribute(df: DataFrame, attributes: list[str], least: int = MIN_GROUP) -> DataFrame:
    """(attribute, value): precision, recall, F1 and AUROC of groups of ``least`` rows or more."""
    long = df.select("y", "p", F.inline(F.array(*(F.struct(F.lit(a).alias("attribute"), F.col(a).cast("string").alias("value")) for a in attributes)))).filter("value IS NOT NULL")
    keys = ["attribute", "value"]
    out = threshold_metrics(long, keys).filter(F.col("n") >= least).join(ranking_metrics(long, keys), keys)
    return out.select(*keys, "n", "precision", "recall", "f1", "auroc", ((F.col("f1") < FLOOR) | (F.col("recall") < FLOOR)).alias("flagged"))


def confusion(df: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    return df.groupBy("y", (F.col("p") >= threshold).cast("int").alias("y_hat")).agg(F.count("*").alias("n"))


def correlations(df: DataFrame, columns: list[str]) -> DataFrame:
    """(a, b, corr, covar) of each pair, over the rows that have both."""
    parts = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    both = lambda a, b, c: F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), F.col(c))
    done = df.agg(*(x for i, (a, b) in enumerate(parts) for x in (F.corr(both(a, b, a), both(a, b, b)).alias(f"r{i}"), F.covar_samp(both(a, b, a), both(a, b, b)).alias(f"v{i}"))))
    return done.select(F.inline(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"r{i}").alias("corr"), F.col(f"v{i}").alias("covar"))
        for i, (a, b) in enumerate(parts)))))
