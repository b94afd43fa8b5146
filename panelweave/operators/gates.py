"""Data-quality gates: each returns rows to look at and a verdict, never an exception."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions import fixed
from ..functions.expr import div
from . import stats

C = F.col


def price_gate(requested: DataFrame, panel: DataFrame, provenance: DataFrame, max_null: float = 0.05, min_years: float = 3.0) -> DataFrame:
    """Per requested ticker: present, share of panel dates missing, and provenance; plus the panel's span."""
    whole = panel.agg(F.struct(F.count_distinct("date").alias("n"), (F.datediff(F.max("date"), F.min("date")) / 365.25).alias("y"))).scalar()
    g = panel.groupBy("ticker").agg(F.count("price").alias("_c"))
    j = requested.select("ticker").distinct().join(g, "ticker", "left").join(
        provenance.select("ticker", F.lit(True).alias("_p")), "ticker", "left").withColumn("_w", whole)
    gap = F.lit(1.0) - C("_c") / C("_w.n")
    return j.select("ticker", C("_c").isNotNull().alias("present"), gap.alias("nan_ratio"), F.coalesce(gap <= max_null, F.lit(False)).alias("nan_ok"),
                    C("_w.y").alias("span_years"), (C("_w.y") >= min_years).alias("span_ok"), F.coalesce("_p", F.lit(False)).alias("has_provenance"))


def return_gate(rets: DataFrame, max_mean_abs: float = 0.10) -> DataFrame:
    """Missing cells of the grid, infinities and mean absolute size (mean of the ticker means)."""
    good = ~F.isnan("ret") & (F.abs("ret") < float("inf"))
    t = rets.groupBy("ticker").agg(F.count(F.when(~F.isnan("ret"), 1)).alias("n"), F.count(F.when(F.abs("ret") == float("inf"), 1)).alias("i"),
                                   F.avg(F.when(good, F.abs("ret"))).alias("m"))
    days = rets.agg(F.count_distinct("date")).scalar()
    g = t.agg(F.count("*").alias("k"), F.sum("n").alias("n"), F.sum("i").alias("inf_count"), F.avg("m").alias("mean_abs"))
    g = g.select((C("k") * days - C("n")).alias("nan_count"), "inf_count", "mean_abs")
    return g.withColumn("passed", (C("nan_count") == 0) & (C("inf_count") == 0) & (C("mean_abs") <= max_mean_abs))


def candidate_gate(weights: DataFrame, classes: DataFrame, caps: dict[str, float], tolerance: float = 1e-3) -> DataFrame:
    """Per candidate: negative weights, sum near one, class caps kept."""
    cap = F.coalesce(*[F.when(C("asset_class") == k, v) for k, v in caps.items()], F.lit(1.0))
    w = weights.join(classes.select(C("symbol").alias("ticker"), "asset_class"), "ticker", "left")
    by_class = w.groupBy("portfolio_id", "asset_class").agg(F.sum("weight").alias("_s"), F.count_if(C("weight") < 0).alias("_neg"))
    over = C("asset_class").isNotNull() & (C("asset_class") != "unknown") & (C("_s") > cap + tolerance)
    g = by_class.groupBy("portfolio_id").agg(F.sum("_s").alias("total"), F.sum("_neg").alias("negatives"), F.count_if(over).alias("caps_broken"))
    return g.withColumn("passed", (C("negatives") == 0) & C("total").between(0.99, 1.01) & (C("caps_broken") == 0))


def candidate_count_gate(kept: DataFrame, distinct: DataFrame, expected: int, group: str = "group_id") -> DataFrame:
    """Per group: enough candidates, and enough of them distinct."""
    a = kept.groupBy(group).agg(F.count("*").alias("candidates"))
    b = distinct.groupBy(group).agg(F.count("*").alias("distinct_candidates"))
    j = a.join(b, group, "left").na.fill(0)
    return j.withColumn("passed", (C("candidates") >= expected) & (C("distinct_candidates") >= max(2, min(5, expected))))




def plausibility_gate(metrics: DataFrame, key: str = "portfolio_id", ranges: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """Every metric value outside its plausible range."""
    r = ranges or fixed.PLAUSIBLE
    long = metrics.unpivot([key], list(r), "metric", "value").where("value is not null")
    lo = F.coalesce(*[F.when(C("metric") == m, a) for m, (a, _) in r.items()])
    hi = F.coalesce(*[F.when(C("metric") == m, b) for m, (_, b) in r.items()])
    return long.where(~C("value").between(lo, hi))


RECEIPT_FIELDS = ["ticker", "provider", "backfill_pct", "first", "last", "nan_rate"]


def receipt_gate(receipts: DataFrame, requested: DataFrame) -> DataFrame:
    """Receipts against requested tickers, absent required fields, missing rates outside [0, 1]."""
    absent = F.size(F.array_compact(F.array(*[F.when(C(c).isNull(), F.lit(c)) for c in RECEIPT_FIELDS])))
    g = receipts.agg(F.count("*").alias("receipts"), F.coalesce(F.sum(absent), F.lit(0)).alias("absent_fields"),
                     F.count_if(~C("nan_rate").between(0.0, 1.0)).alias("bad_rates"))
    g = g.withColumn("requested", requested.select("ticker").distinct().agg(F.count("*")).scalar())
    return g.withColumn("passed", (C("receipts") == C("requested")) & (C("absent_fields") == 0) & (C("bad_rates") == 0))


def light_gate(rets: DataFrame, min_rows: int = 252, max_null: float = 0.20, min_history: int = 126) -> DataFrame:
    """Quick yes or no: enough symbols, rows, filled cells and symbols with history."""
    t = rets.groupBy("ticker").agg(F.count("ret").alias("n"))
    g = t.agg(F.count("*").alias("tickers"), F.sum("n").alias("cells"), F.count_if(C("n") > min_history).alias("long_tickers"))
    g = g.withColumn("dates", rets.agg(F.count_distinct("date")).scalar()).withColumn(
        "nan_ratio", F.lit(1.0) - div("cells", C("dates") * C("tickers")))
    return g.withColumn("passed", (C("tickers") >= 3) & (C("dates") >= min_rows) & (C("nan_ratio") <= max_null) & (C("long_tickers") >= 3))


def backtest_audit(rets: DataFrame, key: str = "ticker") -> DataFrame:
    """Per series: dates strictly increasing in row order, constant or not, and metric bounds."""
    w = W.partitionBy(key).orderBy("date")
    r = rets.withColumn("_up", F.coalesce(C("date") > F.lag("date").over(w), F.lit(True)))
    g = r.groupBy(key).agg(F.every("_up").alias("monotonic"), (F.coalesce(F.stddev_samp("ret"), F.lit(0.0)) == 0).alias("constant"))
    m = stats.curve_facts(rets, key)
    sharpe = F.coalesce(div("mean", "sd") * stats.ROOT, F.lit(0.0))
    bounds = m.select(key, stats.growth(C("final"), C("n")).alias("cagr"), sharpe.alias("sharpe"), "max_dd")
    ok = C("cagr").between(-0.5, 0.5) & C("sharpe").between(-1.0, 3.0) & C("max_dd").between(-0.95, -0.01)
    return g.join(bounds, key).withColumn("plausible", ok)
