"""Performance metrics as grouped aggregates, by ticker, portfolio or any other key.

A key has at most one row per day, so every window here is bounded by the calendar.
"""
from __future__ import annotations

import math

from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.expr import TRADING_DAYS, clamp, div, keys_of, years_between
from . import clean, panels

ANNUAL = float(TRADING_DAYS)
ROOT = ANNUAL ** 0.5


# ---- curves -----------------------------------------------------------------------------------

def equity_curve(rets: DataFrame, key="ticker", missing_as_zero: bool = False) -> DataFrame:
    """Running product of 1 + ret; nulls are skipped, or count as no change."""
    r = F.coalesce("ret", F.lit(0.0)) if missing_as_zero else F.col("ret")
    src = rets if missing_as_zero else rets.where("ret is not null")
    w = W.partitionBy(*keys_of(key)).orderBy("date").rowsBetween(W.unboundedPreceding, 0)
    return src.withColumn("value", F.product(r + 1).over(w))


def drawdown_series(curve: DataFrame, key="ticker") -> DataFrame:
    """Distance from the running peak, which starts at the curve's first point."""
    w = W.partitionBy(*keys_of(key)).orderBy("date").rowsBetween(W.unboundedPreceding, 0)
    return curve.withColumn("drawdown", div("value", F.max("value").over(w)) - 1)


def curve_facts(rets: DataFrame, key="ticker") -> DataFrame:
    """Everything the metric sets need from one pass over the returns."""
    d = drawdown_series(equity_curve(rets, key), key)
    return d.groupBy(*keys_of(key)).agg(
        F.count("ret").alias("n"), F.min_by("value", "date").alias("first_value"),
        F.max_by("value", "date").alias("final"), F.avg("ret").alias("mean"), F.stddev_samp("ret").alias("sd"),
        F.min("drawdown").alias("max_dd"), F.min("date").alias("start"), F.max("date").alias("end"))


def growth(final: Column, n: Column) -> Column:
    return F.when(final > 0, F.pow(final, F.lit(ANNUAL) / n) - 1)


# ---- metric sets ------------------------------------------------------------------------------

def annualized_metrics(rets: DataFrame, key="ticker", rf: float = 0.0) -> DataFrame:
    """CAGR, volatility, Sharpe on CAGR, maximum drawdown, span."""
    f = curve_facts(rets, key).withColumn("cagr", growth(F.col("final"), F.col("n"))).withColumn(
        "volatility", F.col("sd") * ROOT)
    return f.select(*keys_of(key), "cagr", "volatility",
                    F.when(F.col("volatility") > 0, (F.col("cagr") - rf) / F.col("volatility")).alias("sharpe"),
                    "max_dd", "n", "start", "end")


def quality_metrics(rets: DataFrame, key="ticker", rf: float = 0.015) -> DataFrame:
    """Metrics used by the filters: growth from the first curve point, validity and reason."""
    return quality_of_facts(curve_facts(rets, key), key, rf)


def quality_of_facts(f: DataFrame, key, rf: float = 0.015) -> DataFrame:
    """``quality_metrics`` from n, first_value, final, sd and max_dd of each curve."""
    reason = F.when(F.col("n") < 2, "insufficient data").when(
        (F.col("first_value") <= 0) | (F.col("final") <= 0), "invalid equity curve")
    f = f.withColumn("reason", reason).withColumn("valid", reason.isNull()).withColumn("volatility", F.col("sd") * ROOT)
    ok = F.col("valid")
    f = f.withColumn("cagr", F.when(ok, F.pow(div("final", "first_value"), F.lit(ANNUAL) / F.col("n")) - 1))
    return f.select(
        *keys_of(key), "valid", "reason", F.when(ok, F.col("n") / ANNUAL).alias("years"), "cagr",
        F.when(ok, F.col("volatility")).alias("volatility"),
        F.when(ok, F.coalesce(div(F.col("cagr") - rf, "volatility"), F.lit(0.0))).alias("sharpe"),
        F.when(ok, F.col("max_dd")).alias("max_drawdown"), F.when(ok, F.col("final") - 1).alias("total_return"))


def geometric_return(rets: DataFrame, key="ticker") -> DataFrame:
    """Compounded annual growth; also the expected return per ticker."""
    g = rets.groupBy(*keys_of(key)).agg(F.product(F.col("ret") + 1).alias("_p"), F.count("ret").alias("_n"))
    return g.select(*keys_of(key), growth(F.col("_p"), F.col("_n")).alias("ann_return"))


def annual_volatility(rets: DataFrame, key="ticker") -> DataFrame:
    return rets.groupBy(*keys_of(key)).agg((F.stddev_samp("ret") * ROOT).alias("ann_vol"))


def max_drawdown(rets: DataFrame, key="ticker") -> DataFrame:
    return drawdown_series(equity_curve(rets, key), key).groupBy(*keys_of(key)).agg(F.min("drawdown").alias("max_dd"))


def _arith_sharpe(rf: float) -> Column:
    return div((F.avg("ret") - rf / ANNUAL) * ANNUAL, F.stddev_samp("ret") * ROOT)


def sharpe(rets: DataFrame, key="ticker", rf: float = 0.0) -> DataFrame:
    """Annual mean excess over annual volatility; null when nothing moves."""
    return rets.groupBy(*keys_of(key)).agg(_arith_sharpe(rf).alias("sharpe"))


def risk_bundle(rets: DataFrame, key="portfolio_id", rf: float = 0.015, assets: DataFrame | None = None) -> DataFrame:
    """Return, volatility, Sharpe, drawdown, observations and, with weights given, asset count."""
    f = curve_facts(rets, key)
    out = f.select(*keys_of(key), growth(F.col("final"), F.col("n")).alias("ann_return"), (F.col("sd") * ROOT).alias("ann_vol"),
                   div((F.col("mean") - rf / ANNUAL) * ANNUAL, F.col("sd") * ROOT).alias("sharpe"), "max_dd",
                   F.col("n").alias("n_obs"))
    if assets is None:
        return out.withColumn("n_assets", F.lit(1).cast("long"))
    return out.join(assets.groupBy(*keys_of(key)).agg(F.count_distinct("ticker").alias("n_assets")), keys_of(key))


def backtest_summary(rets: DataFrame, key="portfolio_id", rf: float = 0.015) -> DataFrame:
    b = risk_bundle(rets, key, rf)
    return b.select(*keys_of(key), F.round("ann_return", 4).alias("cagr"), F.round("ann_vol", 4).alias("vol"),
                    F.round("sharpe", 2).alias("sharpe"), F.round("max_dd", 4).alias("max_dd"), F.col("n_obs").alias("n"))


def quick_metrics(curve: DataFrame, years: int, key="portfolio_id") -> DataFrame:
    """Growth, drawdown and Sharpe of a stored curve over its last ``years`` x 365 days."""
    k = keys_of(key)
    cut = curve.withColumn("_end", F.max("date").over(W.partitionBy(*k))).where(
        F.col("date") > F.date_sub(F.col("_end"), 365 * years))
    step = W.partitionBy(*k).orderBy("date")
    d = drawdown_series(cut, key).withColumn("_r", div("value", F.lag("value").over(step)) - 1)
    g = d.groupBy(*k).agg(F.count("*").alias("_n"), F.min_by("value", "date").alias("_a"), F.max_by("value", "date").alias("_b"),
                          F.min("drawdown").alias("_dd"), (div(F.avg("_r") * ANNUAL, F.stddev_samp("_r") * ROOT)).alias("_s"))
    enough = F.col("_n") >= 2
    return g.select(*k, F.when(enough, F.round(F.pow(div("_b", "_a"), F.lit(1.0 / years)) - 1, 4)).alias("cagr"),
                    F.when(enough, F.round("_dd", 4)).alias("max_dd"), F.when(enough, F.round("_s", 2)).alias("sharpe"))


HORIZONS = {"1y": 252, "3y": 756, "5y": 1260, "10y": 2520}


def horizon_metrics(rets: DataFrame, key="portfolio_id", horizons: dict[str, int] | None = None) -> DataFrame:
    """Metrics over the most recent rows of each horizon; a short series uses all it has."""
    k, hs = keys_of(key), horizons or HORIZONS
    rn = F.row_number().over(W.partitionBy(*k).orderBy(F.desc("date")))
    fits = F.filter(F.array(*[F.struct(F.lit(h).alias("h"), F.lit(d).alias("d")) for h, d in hs.items()]),
                    lambda x: x["d"] >= F.col("_rn"))
    long = rets.where("ret is not null").withColumn("_rn", rn).withColumn("_h", F.explode(fits))
    return annualized_metrics(long.select(*k, "date", "ret", F.col("_h.h").alias("horizon")), [*k, "horizon"])


def lookback_metrics(rets: DataFrame, key="portfolio_id", years=(1, 5)) -> DataFrame:
    """Full history and calendar look-backs from the key's last date."""
    k = keys_of(key)
    last = F.max("date").over(W.partitionBy(*k))
    wins = F.array(F.lit("full"), *[F.when(F.col("date") >= F.date_sub(F.col("_last"), 365 * y), f"{y}y") for y in years])
    long = rets.withColumn("_last", last).withColumn("window", F.explode(F.array_compact(wins)))
    f = curve_facts(long, [*k, "window"])
    return f.select(*k, "window", growth(F.col("final"), F.col("n")).alias("cagr"), "max_dd",
                    F.coalesce(div(F.col("mean"), "sd") * ROOT, F.lit(0.0)).alias("sharpe"))


def beta(rets: DataFrame, benchmark: DataFrame, key="portfolio_id", min_overlap: int = 252) -> DataFrame:
    """Covariance with the benchmark over its variance on shared dates; null when too few."""
    j = rets.join(benchmark.select("date", F.col("ret").alias("_b")), "date").where("ret is not null and _b is not null")
    g = j.groupBy(*keys_of(key)).agg(F.count("*").alias("_n"), F.covar_samp("ret", "_b").alias("_c"), F.var_samp("_b").alias("_v"))
    return g.select(*keys_of(key), F.when(F.col("_n") >= min_overlap, div("_c", "_v")).alias("beta"))


def value_at_risk(rets: DataFrame, key="portfolio_id", confidence: float = 0.95, parametric: bool = False) -> DataFrame:
    """Historical quantile of the returns, or the normal quantile at their mean and deviation."""
    if parametric:
        var = F.avg("ret") + F.lit(NormalDist().inv_cdf(1 - confidence)) * F.stddev_samp("ret")
    else:
        var = F.percentile("ret", F.lit(1 - confidence))
    return rets.groupBy(*keys_of(key)).agg(var.alias("var"))


def calmar(rets: DataFrame, key="portfolio_id") -> DataFrame:
    m = annualized_metrics(rets, key)
    return m.select(*keys_of(key), div("cagr", F.abs("max_dd")).alias("calmar"))


def asset_table(panel: DataFrame) -> DataFrame:
    """Last price, 21- and 252-row change, volatility and drawdown per ticker (own rows)."""
    w = W.partitionBy("ticker").orderBy("date")
    p = panel.withColumn("_m", F.lag("price", 21).over(w)).withColumn("_y", F.lag("price", 252).over(w))
    last = p.groupBy("ticker").agg(
        F.max_by("price", "date").alias("last_price"),
        F.max_by(div("price", "_m") - 1, "date").alias("ret_1m"), F.max_by(div("price", "_y") - 1, "date").alias("ret_1y"))
    f = curve_facts(clean.own_returns(panel)).select("ticker", (F.col("sd") * ROOT).alias("ann_vol"), "max_dd")
    return last.join(f, "ticker", "left")


def holdings_detail(weights: DataFrame, rets: DataFrame, min_weight: float = 0.001, min_rows: int = 252) -> DataFrame:
    g = rets.groupBy("ticker").agg(F.count("ret").alias("_n"), F.product(F.col("ret") + 1).alias("_p"),
                                   (F.stddev_samp("ret") * ROOT).alias("volatility"))
    g = g.where(F.col("_n") >= min_rows).withColumn("cagr", growth(F.col("_p"), F.col("_n")))
    g = g.select("ticker", "cagr", "volatility", F.coalesce(div("cagr", "volatility"), F.lit(0.0)).alias("sharpe"))
    return weights.where(F.col("weight") >= min_weight).join(g, "ticker", "left").select(
        "portfolio_id", "ticker", (F.col("weight") * 100).alias("weight_pct"), (F.col("cagr") * 100).alias("cagr_pct"),
        (F.col("volatility") * 100).alias("vol_pct"), "sharpe")


# ---- coverage and receipts --------------------------------------------------------------------

def coverage_metrics(panel: DataFrame) -> DataFrame:
    """First, last, share of panel dates missing, points and years per ticker."""
    dates = panel.agg(F.count_distinct("date")).scalar()
    g = panel.groupBy("ticker").agg(F.min("date").alias("first"), F.max("date").alias("last"), F.count("price").alias("n_points"))
    gap = F.greatest(F.lit(0.0), F.lit(1.0) - F.col("n_points") / dates)
    return g.select("ticker", "first", "last", F.round(gap, 4).alias("nan_rate"), "n_points",
                    F.round(years_between(F.col("first"), F.col("last")), 1).alias("hist_years"))


def receipt_returns(panel: DataFrame, min_rows: int = 252) -> DataFrame:
    w = W.partitionBy("ticker").orderBy("date")
    r = panel.withColumn("ret", div("price", F.lag("price").over(w)) - 1)
    g = r.groupBy("ticker").agg(F.count("*").alias("_n"), (F.stddev_samp("ret") * ROOT).alias("_v"), _arith_sharpe(0.0).alias("_s"))
    long = F.col("_n") >= min_rows
    return g.select("ticker", F.when(long, F.round("_v", 3)).alias("ann_vol"), F.when(long, F.round("_s", 2)).alias("sharpe"))


def receipts(requested: DataFrame, panel: DataFrame, provenance: DataFrame) -> DataFrame:
    """One receipt per requested ticker, also for those without any data."""
    out = requested.select("ticker").distinct().join(coverage_metrics(panel), "ticker", "left")
    out = out.join(receipt_returns(panel), "ticker", "left").join(
        provenance.select("ticker", "provider_map", "backfill_pct"), "ticker", "left")
    return out.select(
        "ticker", F.coalesce("provider_map", F.lit("stooq(+tiingo?)")).alias("provider"),
        F.format_string("%.2f", F.coalesce("backfill_pct", F.lit(0.0))).alias("backfill_pct"), "first", "last",
        F.coalesce("nan_rate", F.lit(1.0)).alias("nan_rate"), F.coalesce("n_points", F.lit(0)).alias("n_points"),
        "hist_years", "ann_vol", "sharpe")


def panel_coverage(panel: DataFrame, value: str = "price") -> DataFrame:
    """Share of filled cells of the date x ticker grid."""
    return panel.agg((F.count(value) / (F.count_distinct("date") * F.count_distinct("ticker"))).alias("coverage"))


def length_coverage(panel: DataFrame) -> DataFrame:
    """Mean of series length over the longest one."""
    n = panel.groupBy("ticker").agg(F.count("*").alias("n"))
    return n.agg(F.coalesce(div(F.avg("n"), F.max("n")), F.lit(0.0)).alias("coverage"))


def effective_assets(weights: DataFrame, key="portfolio_id") -> DataFrame:
    w = F.greatest(F.lit(0.0), F.col("weight"))
    g = weights.groupBy(*keys_of(key)).agg(F.sum(w).alias("_s"), F.sum(w * w).alias("_q"))
    return g.select(*keys_of(key), F.when(F.col("_s") > 0, div(F.col("_s") * F.col("_s"), "_q")).otherwise(0.0).alias("effective_n"))


# ---- distributions, tests ---------------------------------------------------------------------

def category_counts(df: DataFrame, columns: list[str], unknown: str = "unknown") -> DataFrame:
    """Row counts of several label columns in one scan."""
    pairs = F.array(*[F.struct(F.lit(c).alias("field"), F.coalesce(F.col(c), F.lit(unknown)).alias("label")) for c in columns])
    return df.select(F.explode(pairs).alias("_x")).groupBy("_x.field", "_x.label").count()


def spread(df: DataFrame, column: str, digits: int = 2) -> DataFrame:
    return df.agg(F.round(F.min(column), digits).alias("min"), F.round(F.percentile(column, F.lit(0.5)), digits).alias("median"),
                  F.round(F.max(column), digits).alias("max"))


def volatility_distribution(metrics: DataFrame, column: str = "volatility", by=()) -> DataFrame:
    v = metrics.where(F.col(column).isNotNull())
    qs = {"p05": 0.05, "p25": 0.25, "median": 0.5, "p75": 0.75, "p95": 0.95}
    q = F.percentile(column, F.array(*map(F.lit, qs.values())))
    return v.groupBy(*by).agg(F.count(column).alias("count"), F.min(column).alias("min"), F.max(column).alias("max"),
                              F.avg(column).alias("mean"), F.stddev_pop(column).alias("std"),
                              *[q[i].alias(n) for i, n in enumerate(qs)])


def anova(rets: DataFrame, labels: DataFrame, key=("portfolio_id",)) -> DataFrame:
    """One-way F of the returns by label, from group counts, means and variances."""
    k = list(key)
    g = rets.join(labels.select("date", "label"), "date").groupBy(*k, "label").agg(
        F.count("ret").alias("n"), F.avg("ret").alias("m"), F.coalesce(F.var_samp("ret"), F.lit(0.0)).alias("v"))
    t = g.groupBy(*k).agg(
        F.count("*").alias("k"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("m")).alias("_s"),
        F.sum(F.col("n") * F.col("m") * F.col("m")).alias("_q"), F.sum((F.col("n") - 1) * F.col("v")).alias("_w"))
    between = (F.col("_q") - F.col("_s") * F.col("_s") / F.col("n")) / (F.col("k") - 1)
    return t.select(*k, "k", "n", F.when(F.col("k") >= 2, div(between, div("_w", F.col("n") - F.col("k")))).alias("f"))


def _f_tail():
    """Upper tail of the F distribution: the regularised incomplete beta function I_x(within / 2, between / 2) at within / (within + between f)."""
    @F.pandas_udf("double")
    def tail_of(f: pd.Series, between: pd.Series, within: pd.Series) -> pd.Series:
        f, d1, d2 = (np.asarray(c, dtype=float) for c in (f, between, within))
        x = d2 / (d2 + d1 * np.maximum(f, 0.0))
        a, b = d2 / 2, d1 / 2
        swap = x > (a + 1) / (a + b + 2)  # the continued fraction converges fast below that point
        a, b, x = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1 - x, x)
        gamma = np.vectorize(math.lgamma, otypes=[float])
        with np.errstate(all="ignore"):
            front = np.exp(gamma(a + b) - gamma(a) - gamma(b) + a * np.log(x) + b * np.log1p(-x)) / a
            c, d = np.ones_like(x), 1 / (1 - (a + b) * x / (a + 1))
            h = d
            for m in range(1, 300):  # modified Lentz steps
                for term in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
                    d, c = 1 / (1 + term * d), 1 + term / c
                    h = h * d * c
            tail = np.where(x > 0, front * h, 0.0)
        return pd.Series(np.where(np.isnan(f) | (d1 <= 0) | (d2 <= 0), np.nan, np.where(swap, 1 - tail, tail)))

    return tail_of


def anova_p_value(rets: DataFrame, labels: DataFrame, key=("portfolio_id",)) -> DataFrame:
    """F and its p-value for every key: one aggregation, then Arrow batches of one row a key."""
    t = anova(rets, labels, key)
    p = _f_tail()("f", (F.col("k") - 1).cast("double"), (F.col("n") - F.col("k")).cast("double"))
    return t.select(*key, "f", F.when(F.col("f").isNotNull(), p).alias("p"))


def _resampled(stat: str, seed: int):
    """Vectorised statistic of ``count`` replicates of one packed series, from replicate ``first`` on.

    Draws follow ``expr.scatter``, so they depend only on (seed, replicate, position).
    """
    @F.pandas_udf("array<double>")
    def run(series: pd.Series, first: pd.Series, count: pd.Series) -> pd.Series:
        def one(r, a, c):
            r, n = np.asarray(r, dtype=float), len(r)
            x = (np.arange(a, a + c, dtype=np.uint64)[:, None] * np.uint64(2654435761)
                 + np.arange(1, n + 1, dtype=np.uint64)[None, :] * np.uint64(2246822519) + np.uint64(seed)) & np.uint64(0xFFFFFFFF)
            for shift, factor in ((16, 569420461), (15, 1935289751)):
                x = ((x ^ (x >> np.uint64(shift))) * np.uint64(factor)) & np.uint64(0xFFFFFFFF)
            x ^= x >> np.uint64(15)
            s = r[(x % np.uint64(n)).astype(np.int64)]
            if stat == "ann_vol":
                return s.std(axis=1) * ROOT
            end = np.prod(1.0 + s, axis=1)
            return np.where(end > 0, np.power(np.where(end > 0, end, 1.0), ANNUAL / n) - 1.0, 0.0)

        return pd.Series([one(*t) for t in zip(series, first, count)])

    return run


def _replicates(rets: DataFrame, k: list[str], stat: str, replicates: int, seed: int, min_rows: int, chunk: int = 250) -> DataFrame:
    """One row per key and replicate. A key's series is one array, which the calendar bounds; its
    replicates are cut into chunks, so one key's work spreads over many tasks."""
    s = rets.where("ret is not null").groupBy(*k).agg(F.sort_array(F.collect_list(F.struct("date", "ret"))).alias("_s"))
    s = s.where(F.size("_s") >= min_rows).select(*k, F.transform("_s", lambda x: x["ret"]).alias("_r"))
    starts = s.withColumn("_a", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1), F.lit(chunk))))
    size = F.least(F.lit(chunk), F.lit(replicates) - F.col("_a"))
    out = starts.withColumn("_v", _resampled(stat, seed)("_r", "_a", size))
    return out.select(*k, "_a", F.posexplode("_v").alias("_i", "value")).select(*k, (F.col("_a") + F.col("_i")).alias("rep"), "value")


def bootstrap_interval(rets: DataFrame, stat: str = "cagr", replicates: int = 1000, alpha: float = 0.05,
                       key="ticker", seed: int = 42, min_rows: int = 30) -> DataFrame:
    """Percentile interval of CAGR or volatility over resampled series; null when too short."""
    k = keys_of(key)
    q = F.percentile("value", F.array(F.lit(alpha / 2), F.lit(1 - alpha / 2)))
    hit = _replicates(rets, k, stat, replicates, seed, min_rows).groupBy(*k).agg(q.alias("_q"))
    return rets.select(*k).distinct().join(hit, k, "left").select(*k, F.col("_q")[0].alias("lo"), F.col("_q")[1].alias("hi"))


def _beaten(seed: int):
    """How often, in ``count`` replicates, another series of a group has at least the mean of its first one.

    A replicate is a vector of how often each day is drawn, which the whole group shares: the means of all
    are one matrix product.
    """
    def one(group: list, a: int, c: int) -> tuple[int, int]:
        r = np.array([np.asarray(x, dtype=float) for x in group])
        n = r.shape[1]
        drawn = panels.scatter(np.arange(a, a + c)[:, None], np.arange(1, n + 1)[None, :], seed) % n
        counts = np.bincount((drawn + n * np.arange(c)[:, None]).ravel(), minlength=c * n).reshape(c, n).astype(float)
        means = counts @ r.T
        return int((means[:, :1] - means[:, 1:] <= 0).sum()), c * (len(r) - 1)

    @F.pandas_udf("struct<hits: long, total: long>")
    def run(series: pd.Series, first: pd.Series, count: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([one(*t) for t in zip(series, first, count)], columns=["hits", "total"])

    return run


def bootstrap_winner(rets: DataFrame, group="group_id", name="name", replicates: int = 2000, seed: int = 42,
                     min_rows: int = 60, chunk: int = 250) -> DataFrame:
    """Candidate with the best mean/deviation per group and the chance that another is as good.

    All candidates of a group are cut to their common dates and share the draws of a replicate. A group is one
    row of series, bounded by its grid and the calendar; its replicates are cut into chunks, of which two
    counts come back.
    """
    common = clean.complete_case(rets.withColumnRenamed(name, "ticker"), group=[group]).withColumnRenamed("ticker", name)
    like = common.groupBy(group, name).agg(
        F.avg("ret").alias("mean"), F.coalesce(div(F.avg("ret"), F.stddev_samp("ret")), F.lit(-1e9)).alias("_like"),
        F.transform(F.sort_array(F.collect_list(F.struct("date", "ret"))), lambda x: x["ret"]).alias("_r"))
    ranked = like.withColumn("rank", F.row_number().over(W.partitionBy(group).orderBy(F.desc("_like"), name)))
    packed = ranked.where(F.size("_r") >= min_rows).groupBy(group).agg(F.sort_array(F.collect_list(F.struct("rank", "_r"))).alias("_g"))
    parts = packed.select(group, F.transform("_g", lambda x: x["_r"]).alias("_s"), F.explode(F.sequence(F.lit(0), F.lit(replicates - 1), F.lit(chunk))).alias("_a"))
    size = F.least(F.lit(chunk), F.lit(replicates) - F.col("_a"))
    p = parts.select(group, _beaten(seed)("_s", "_a", size).alias("_b")).groupBy(group).agg(div(F.sum("_b.hits"), F.sum("_b.total")).alias("p_value"))
    return ranked.where("rank = 1").select(group, F.col(name).alias("winner"), "mean").join(p, group, "left")


def normal_interval(rets: DataFrame, key="ticker", z: float = 1.96) -> DataFrame:
    half = F.stddev_pop("ret") * z / F.sqrt(F.count("ret"))
    return rets.groupBy(*keys_of(key)).agg((F.avg("ret") - half).alias("lo"), (F.avg("ret") + half).alias("hi"))


def consistency_score(sd: Column) -> Column:
    """100 at a deviation of 0.02 or less, 0 at 0.20 or more, linear between."""
    return clamp(F.lit(100.0) * (F.lit(1.0) - (sd - 0.02) / F.lit(0.20 - 0.02)), 0.0, 100.0)


def robustness(curve: DataFrame, key="portfolio_id", segments: int = 3) -> DataFrame:
    """Consistency of growth over equal row segments of a curve; 50 when it is too short."""
    k = keys_of(key)
    part = W.partitionBy(*k)
    rn, n = F.row_number().over(part.orderBy("date")) - 1, F.count("*").over(part)
    s = curve.withColumn("_n", n).withColumn("_seg", F.least(F.lit(segments - 1), F.floor(rn / F.floor(F.col("_n") / segments))))
    g = s.groupBy(*k, "_seg", "_n").agg(F.min_by("value", "date").alias("_a"), F.max_by("value", "date").alias("_b"), F.count("*").alias("_c"))
    ok = (F.col("_c") >= 2) & (F.col("_a") > 0)
    g = g.withColumn("_g", F.when(ok, F.pow(div("_b", "_a"), F.lit(ANNUAL) / F.col("_c")) - 1))
    t = g.groupBy(*k, "_n").agg(F.count("_g").alias("_k"), F.stddev_samp("_g").alias("_sd"))
    short = (F.col("_n") < 126) | (F.col("_n") < segments * 30) | (F.col("_k") == 0)
    return t.select(*k, F.when(short, 50.0).when(F.col("_k") == 1, 100.0).otherwise(consistency_score(F.col("_sd"))).alias("robustness"))


# ---- report tables ----------------------------------------------------------------------------

def sensitivity_pivot(results: DataFrame, shocks: list[str]) -> DataFrame:
    return results.groupBy("objective").pivot("shock", shocks).agg(F.avg("top_score"))


def top_optimizer_counts(results: DataFrame) -> DataFrame:
    return results.groupBy(F.split("top_name", " - ")[0].alias("optimizer")).count()


def failure_reasons(receipts_: DataFrame, by=(), top: int = 10) -> DataFrame:
    """Most frequent failure reasons of the candidates that did not pass (top per group)."""
    g = receipts_.where(~F.col("passed")).groupBy(*by, F.coalesce("fail_reason", F.lit("unknown")).alias("reason")).count()
    if not by:
        return g.orderBy(F.desc("count"), "reason").limit(top)
    w = W.partitionBy(*by).orderBy(F.desc("count"), "reason")
    return g.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= top).drop("_n")


def stage_counts(recommended: DataFrame) -> DataFrame:
    stage = F.when(F.col("fallback_level") >= 2, F.concat(F.lit("Stage "), F.col("fallback_level").cast("string"))).when(
        F.col("passed"), "Stage 1").otherwise("Unknown")
    return recommended.groupBy(stage.alias("stage")).count()


def pass_counts(receipts_: DataFrame) -> DataFrame:
    return receipts_.agg(F.count_if("passed").alias("passed"), F.count_if(~F.col("passed")).alias("failed"))


def allocation_by_class(weights: DataFrame, classes: DataFrame, min_share: float = 0.001) -> DataFrame:
    """Normalised positive weight and holdings per asset class; tiny classes left out."""
    w = weights.where("weight > 0").join(classes.select(F.col("symbol").alias("ticker"), "asset_class"), "ticker", "left")
    g = w.groupBy("portfolio_id", F.coalesce("asset_class", F.lit("Unknown")).alias("asset_class")).agg(
        F.sum("weight").alias("_w"), F.count("*").alias("holdings"))
    share = F.col("_w") / F.sum("_w").over(W.partitionBy("portfolio_id"))
    return g.withColumn("share", share).where(F.col("share") >= min_share).drop("_w")


def top_classes(allocation: DataFrame, top: int = 4) -> DataFrame:
    w = W.partitionBy("portfolio_id").orderBy(F.desc("holdings"), "asset_class")
    return allocation.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= top)


def candidate_table(weights: DataFrame, port_rets: DataFrame, benchmark: DataFrame, days: int = 252) -> DataFrame:
    """One-year metrics, beta, value at risk and holdings per candidate."""
    year = clean.trailing_dates(port_rets, days)
    m = annualized_metrics(year, "portfolio_id")
    h = weights.groupBy("portfolio_id").agg(F.count_if(F.col("weight") > 0.001).alias("holdings"))
    out = m.join(beta(year, benchmark, min_overlap=126), "portfolio_id", "left").join(
        value_at_risk(year), "portfolio_id", "left").join(h, "portfolio_id")
    return out.select("portfolio_id", "holdings", F.round(F.col("cagr") * 100, 2).alias("cagr_1y"),
                      F.round(F.col("volatility") * 100, 2).alias("vol_1y"), F.round("sharpe", 3).alias("sharpe_1y"),
                      F.round("beta", 3).alias("beta"), F.round("var", 4).alias("var95"))


def best_by_growth(table: DataFrame, top: int = 4) -> DataFrame:
    return table.orderBy(F.desc_nulls_last("cagr_1y"), "portfolio_id").limit(top)
