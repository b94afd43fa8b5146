"""Macro features, regime labels and scores."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.expr import clamp, div
from ..session import stored
from . import sequence

FEATURES = ["dgs10_level", "dgs10_6m_chg", "cpi_yoy", "unrate_6m_chg", "fedfunds_level"]
HALF_YEAR, YEAR = 126, 252


def regime_features(macro: DataFrame) -> DataFrame:
    """Level, half-year change and yearly growth of the key series, as standard scores.

    Lags run per series; the conditional aggregate then lays the series side by side.
    """
    w = W.partitionBy("series_id").orderBy("date")
    f = macro.where(F.col("series_id").isin("DGS10", "CPIAUCSL", "UNRATE", "FEDFUNDS")).select(
        "series_id", "date", "value", (F.col("value") - F.lag("value", HALF_YEAR).over(w)).alias("d"),
        (div("value", F.lag("value", YEAR).over(w)) - 1).alias("y"))

    def of(series: str, c: str) -> Column:
        return F.max(F.when(F.col("series_id") == series, F.col(c)))

    wide = f.groupBy("date").agg(of("DGS10", "value").alias("dgs10_level"), of("DGS10", "d").alias("dgs10_6m_chg"),
                                 of("CPIAUCSL", "y").alias("cpi_yoy"), of("UNRATE", "d").alias("unrate_6m_chg"),
                                 of("FEDFUNDS", "value").alias("fedfunds_level"))
    return sequence.z_scores(wide, FEATURES)


def label_regimes(features: DataFrame) -> DataFrame:
    """Threshold rules; the later rule of the list takes precedence."""
    rates, cpi, jobs = F.col("dgs10_6m_chg"), F.col("cpi_yoy"), F.col("unrate_6m_chg")
    label = (F.when((cpi < -0.3) & (rates < 0.3), "Disinflation").when((rates > 0.5) & (cpi > 0.5), "Tightening")
             .when((jobs > 0.5) & (rates < -0.3), "Recessionary").otherwise("Risk-on"))
    return features.select("date", label.alias("regime"))


def cluster_regimes(features: DataFrame, k: int = 4, rounds: int = 100) -> DataFrame:
    """K-means clusters named by their centroids.

    Lloyd rounds over the stored days, from centres the data define: the means of ``k`` equal runs in the order of
    inflation, then date. So labels are repeatable. A day belongs to its nearest centre (the earlier run on
    a tie), a centre without days goes, and rounds end when no centre moves. Only the ``k`` centres reach the driver.
    Days that lack a feature have no label; an empty table gives none.
    """
    runs = F.ntile(k).over(W.orderBy("cpi_yoy", "date"))  # calendar only
    days = stored(features.select("date", *FEATURES).na.drop(subset=FEATURES).withColumn("run", runs))

    def means(cluster: Column) -> dict[int, list[float]]:
        rows = days.groupBy(cluster.alias("c")).agg(*[F.avg(c).alias(c) for c in FEATURES]).collect()  # k rows
        return {r["c"]: [r[c] for c in FEATURES] for r in sorted(rows)}

    def nearest(centres: dict[int, list[float]]) -> Column:
        apart = lambda x: sum(((F.col(c) - v) * (F.col(c) - v) for c, v in zip(FEATURES, x, strict=True)), F.lit(0.0))
        return F.array_min(F.array(*[F.struct(apart(x).alias("d"), F.lit(c).alias("c")) for c, x in centres.items()]))["c"]

    def name(x: list[float]) -> str:
        at = dict(zip(FEATURES, x, strict=True))
        if at["unrate_6m_chg"] > 0.3:
            return "Recessionary"
        if at["dgs10_6m_chg"] > 0.3 and at["cpi_yoy"] > 0.3:
            return "Tightening"
        return "Disinflation" if at["cpi_yoy"] < -0.3 else "Risk-on"

    centres = means(F.col("run"))
    if not centres:
        return days.select("date", F.lit(None).cast("string").alias("regime"))
    for _ in range(rounds):
        last, centres = centres, means(nearest(centres))
        if last.keys() == centres.keys() and all(abs(x - y) < 1e-12 for c in last for x, y in zip(last[c], centres[c], strict=True)):
            break
    names = F.coalesce(*[F.when(F.col("c") == c, name(x)) for c, x in centres.items()])
    return days.select("date", nearest(centres).alias("c")).select("date", names.alias("regime"))


def current_regime(regimes: DataFrame, lookback: int = 30) -> DataFrame:
    """Most frequent label of the latest days; the alphabetically first on a tie."""
    recent = regimes.orderBy(F.desc("date")).limit(lookback)
    return recent.agg(F.coalesce(F.mode("regime", True), F.lit("Unknown")).alias("regime"))


def _tail_facts(macro: DataFrame) -> DataFrame:
    """Latest value, the values 3 and 6 rows before, and the 60-row mean, per series."""
    w = W.partitionBy("series_id").orderBy(F.desc("date"))
    t = macro.where("value is not null").withColumn("_n", F.row_number().over(w)).where("_n <= 60")
    at = lambda k: F.max(F.when(F.col("_n") == k + 1, F.col("value")))
    grow = lambda k: F.coalesce((at(0) - at(k)) / F.when(at(k) == 0, 1.0).otherwise(F.abs(at(k))), F.lit(0.0))
    return t.groupBy("series_id").agg(grow(3).alias("g3"), grow(6).alias("g6"), F.avg("value").alias("m60"))


def macro_scores(macro: DataFrame) -> DataFrame:
    """Risk-on, tightening and recessionary scores in [0, 1], as one row."""
    of = lambda s, c: F.max(F.when(F.col("series_id") == s, F.col(c)))
    pos = lambda c: F.greatest(F.lit(0.0), c)
    f = _tail_facts(macro).agg(of("T10Y2Y", "m60").alias("steep"), of("T10Y2Y", "g3").alias("curve"), of("CPIAUCSL", "g6").alias("cpi"),
                               of("UNRATE", "g6").alias("jobs"), of("DGS10", "g3").alias("rates"))
    c = F.col
    return f.select(
        clamp(pos(c("steep") / 2) + pos(-c("jobs")) + pos(-c("cpi")), 0.0, 1.0).alias("risk_on"),
        clamp(pos(c("rates")) + pos(-c("curve")), 0.0, 1.0).alias("tightening"),
        clamp(pos(-c("steep")) + pos(c("jobs")), 0.0, 1.0).alias("recessionary"))


def regime_onehot(scores: DataFrame) -> DataFrame:
    """One row per score, flag on the largest (the first of equals in fixed order)."""
    names = ["risk_on", "tightening", "recessionary"]
    best = F.when(F.col(names[0]) >= F.greatest(*names[1:]), names[0]).when(F.col(names[1]) >= F.col(names[2]), names[1]).otherwise(names[2])
    long = F.explode(F.array(*[F.struct(F.lit(n).alias("regime"), F.col(n).alias("score"), (best == n).alias("active")) for n in names]))
    return scores.select(long.alias("x")).select("x.*")
