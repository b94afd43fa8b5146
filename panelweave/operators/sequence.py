"""Windowed and sequential operators: rolling risk, contributions, internal rate of return."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.expr import div, keys_of
from . import stats


def _frame(key, window: int):
    return W.partitionBy(*keys_of(key)).orderBy("date").rowsBetween(-(window - 1), 0)


def rolling_risk(rets: DataFrame, window: int = 252, rf: float = 0.0, min_periods: int | None = None, key="ticker") -> DataFrame:
    """Rolling volatility (population) and Sharpe."""
    w, need = _frame(key, window), min_periods or window
    rf_daily = (1 + rf) ** (1 / 252) - 1 if rf else 0.0
    ok = F.count("ret").over(w) >= need
    vol = F.stddev_pop("ret").over(w) * stats.ROOT
    out = rets.where("ret is not null").withColumn("vol", F.when(ok, vol))
    return out.withColumn("sharpe", F.when(ok, div((F.avg("ret").over(w) - rf_daily) * 252.0, "vol")))


def rolling_drawdown(rets: DataFrame, window: int = 252, min_periods: int | None = None, key="ticker") -> DataFrame:
    """Worst fall inside each trailing window; the peak starts afresh with the window.

    Each series is cut into blocks of ``window`` rows. A window is the end of one block and the start of
    the next, and falls combine: the least of both parts' own and of the later part's low under the earlier part's
    high. Starts and ends of blocks are running sums of their rows in either order, so the work is constant a row.
    """
    k, need = keys_of(key), min_periods or window
    series = W.partitionBy(*k).orderBy("date")
    c = stats.equity_curve(rets, key).withColumn("_n", F.row_number().over(series)).withColumn("_b", F.floor((F.col("_n") - 1) / window))
    ahead = W.partitionBy(*k, "_b").orderBy("date").rowsBetween(W.unboundedPreceding, 0)
    back = W.partitionBy(*k, "_b").orderBy(F.desc("date")).rowsBetween(W.unboundedPreceding, 0)
    c = c.withColumns({"_low": F.min("value").over(ahead), "_fall": div("value", F.max("value").over(ahead)) - 1})
    c = c.withColumn("_start", F.least(F.lit(0.0), F.min("_fall").over(ahead)))  # of the block's first rows
    c = c.withColumns({"_high": F.max("value").over(back), "_drop": div(F.min("value").over(back), "value") - 1})
    c = c.withColumn("_end", F.min("_drop").over(back))  # of the block's last rows
    old = lambda name: F.lag(name, window - 1).over(series)
    across = F.least("_start", old("_end"), div("_low", old("_high")) - 1)
    dd = F.when((F.col("_n") <= window) | (F.col("_n") % window == 0), F.col("_start")).otherwise(across)
    return c.withColumn("maxdd", F.when(F.least("_n", F.lit(window)) >= need, dd)).drop("value", "_n", "_b", "_low", "_fall", "_start", "_high", "_drop", "_end")


def rebased_history(curves: DataFrame, years: int = 20, key="series") -> DataFrame:
    """Each series' last years scaled to start at 100."""
    k = keys_of(key)
    last = F.max("date").over(W.partitionBy(*k))
    cut = curves.withColumn("_last", last).where(F.col("date") >= F.add_months(F.col("_last"), -12 * years))
    first = F.first("value").over(W.partitionBy(*k).orderBy("date"))
    return cut.select(*k, "date", (div("value", first) * 100).alias("value"))


def month_end_buys(curve: DataFrame, key="portfolio_id") -> DataFrame:
    """Flags the first row and the last row of each calendar month (the day a contribution trades)."""
    k = keys_of(key)
    month = W.partitionBy(*k, F.trunc("date", "month"))
    return curve.withColumn("is_buy", F.col("date") == F.max("date").over(month)).withColumn(
        "is_first", F.col("date") == F.min("date").over(W.partitionBy(*k)))


def dca_value(curve: DataFrame, monthly: Column | float, lump: Column | float = 0.0, key="portfolio_id") -> DataFrame:
    """Cash invested so far and market value of month-end buys plus a lump on the first row."""
    k = keys_of(key)
    as_col = lambda x: x if isinstance(x, Column) else F.lit(float(x))
    cash = F.when(F.col("is_buy"), as_col(monthly)).otherwise(0.0) + F.when(F.col("is_first"), as_col(lump)).otherwise(0.0)
    run = W.partitionBy(*k).orderBy("date").rowsBetween(W.unboundedPreceding, 0)
    b = month_end_buys(curve.where("value is not null"), key).withColumn("_cash", cash)
    shares = F.sum(F.when(F.col("value") > 0, F.col("_cash") / F.col("value")).otherwise(0.0)).over(run)
    return b.select(*k, "date", F.sum("_cash").over(run).alias("invested"), (shares * F.col("value")).alias("market_value"))


def dca_plans(curve: DataFrame, plans: dict[str, tuple[float, float]], key="portfolio_id") -> DataFrame:
    """Every plan (lump, monthly) on every curve. The buys are the same for all plans, so the running
    sums of 1/price are taken once and the plans only scale them."""
    k = keys_of(key)
    run = W.partitionBy(*k).orderBy("date").rowsBetween(W.unboundedPreceding, 0)
    unit = F.when(F.col("value") > 0, 1 / F.col("value")).otherwise(0.0)
    b = month_end_buys(curve.where("value is not null"), key)
    b = b.select(*k, "date", "value", F.sum(F.when(F.col("is_buy"), unit).otherwise(0.0)).over(run).alias("_m"),
                 F.sum(F.col("is_buy").cast("int")).over(run).alias("_c"), F.sum(F.when(F.col("is_first"), unit).otherwise(0.0)).over(run).alias("_l"))
    specs = F.array(*[F.struct(F.lit(n).alias("plan"), F.lit(float(l)).alias("lump"), F.lit(float(m)).alias("monthly"))
                      for n, (l, m) in plans.items()])
    p = b.withColumn("_p", F.explode(specs))
    return p.select(*k, "_p.plan", "date", (F.col("_p.lump") + F.col("_p.monthly") * F.col("_c")).alias("invested"),
                    ((F.col("_p.monthly") * F.col("_m") + F.col("_p.lump") * F.col("_l")) * F.col("value")).alias("market_value"))


def final_contribution_value(curve: DataFrame, monthly: float, key="portfolio_id") -> DataFrame:
    return dca_value(curve, monthly, 0.0, key).groupBy(*keys_of(key)).agg(F.max_by("market_value", "date").alias("final_value"))


def rough_projection(curve: DataFrame, lump: float, monthly: float, key="portfolio_id") -> DataFrame:
    """Lump at the start plus one average-price buy per 21 rows."""
    g = curve.groupBy(*keys_of(key)).agg(F.min_by("value", "date").alias("a"), F.max_by("value", "date").alias("b"),
                                         F.avg("value").alias("m"), F.count("value").alias("n"))
    shares = F.coalesce(div(F.lit(float(lump)), "a"), F.lit(0.0)) + F.coalesce(
        div(F.lit(float(monthly)) * F.floor(F.col("n") / 21), "m"), F.lit(0.0))
    return g.select(*keys_of(key), (shares * F.col("b")).alias("final_value"))


def lookback_change(series: DataFrame, k: int, key="series_id", kind: str = "diff") -> DataFrame:
    """Change against k rows before: difference, relative change, or growth over the absolute base."""
    prev = F.lag("value", k).over(W.partitionBy(*keys_of(key)).orderBy("date"))
    change = {"diff": F.col("value") - prev, "pct": div("value", prev) - 1,
              "growth": (F.col("value") - prev) / F.when(prev == 0, 1.0).otherwise(F.abs(prev))}[kind]
    return series.withColumn("change", change)


def z_scores(df: DataFrame, columns: list[str]) -> DataFrame:
    """Standard scores per column over complete rows; a constant column stays as it is."""
    full = df.na.drop(subset=columns)
    facts = full.agg(F.struct(*[F.struct(F.avg(c).alias("m"), F.stddev_samp(c).alias("s")).alias(c) for c in columns]).alias("k")).scalar()
    rest = [c for c in df.columns if c not in columns]
    out = full.withColumn("_k", facts)
    return out.select(*rest, *[F.when(F.col(f"_k.{c}.s") > 0, (F.col(c) - F.col(f"_k.{c}.m")) / F.col(f"_k.{c}.s"))
                               .otherwise(F.col(c)).alias(c) for c in columns])


def latest_values(series: DataFrame, key="series_id", tail: int = 365) -> DataFrame:
    """Last value, its date, and the rows among the last ``tail``."""
    w = W.partitionBy(*keys_of(key)).orderBy(F.desc("date"))
    t = series.where("value is not null").withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= tail)
    return t.groupBy(*keys_of(key)).agg(F.max_by("value", "date").alias("value"), F.max("date").alias("date"), F.count("*").alias("tail_rows"))


def latest_row(series: DataFrame) -> DataFrame:
    """Most recent date with a value of every series as known then (forward filled)."""
    day = series.where("value is not null").agg(F.max("date").alias("date"))
    known = series.where("value is not null").groupBy("series_id").agg(F.max_by("value", "date").alias("value"))
    return known.withColumn("date", day.scalar())


def curve_consistent(rets: DataFrame, curve: DataFrame, rtol: float = 1e-6, key="portfolio_id") -> DataFrame:
    """Does the stored curve's last value equal the one rebuilt from returns?"""
    k = keys_of(key)
    built = stats.equity_curve(rets, key).select(*k, "date", F.col("value").alias("built"))
    last = built.join(curve.select(*k, "date", "value"), [*k, "date"]).groupBy(*k).agg(
        F.max_by("built", "date").alias("built"), F.max_by("value", "date").alias("stored"))
    gap = F.abs(F.col("built") - F.col("stored")) <= F.greatest(F.lit(1.0), F.abs("stored")) * rtol
    return last.withColumn("consistent", gap)


def xirr(flows: DataFrame, key="account_id", steps: int = 80) -> DataFrame:
    """Annual internal rate of return per account by bisection on [-0.9999, 10].

    The flows of one account are one array; the fold halves the bracket ``steps`` times, more than
    a double can resolve. No sign change over the bracket gives null.
    """
    k = keys_of(key)
    t0 = F.min("date").over(W.partitionBy(*k))
    years = F.datediff("date", t0) / F.lit(365.0)
    daily = flows.where("amount is not null").groupBy(*k, "date").agg(F.sum("amount").alias("amount"))
    a = daily.withColumn("t", years).groupBy(*k).agg(F.sort_array(F.collect_list(F.struct("t", "amount"))).alias("_f"))

    def npv(rate: Column) -> Column:
        return F.aggregate("_f", F.lit(0.0), lambda s, f: s + f["amount"] / F.pow(rate + 1, f["t"]))

    a = a.withColumn("_lo", npv(F.lit(-0.9999))).withColumn("_hi", npv(F.lit(10.0)))
    start = F.struct(F.lit(-0.9999).alias("lo"), F.lit(10.0).alias("hi"))

    def halve(b: Column, _: Column) -> Column:
        mid = (b["lo"] + b["hi"]) / 2
        low_side = npv(mid) * F.signum("_lo") < 0
        return F.struct(F.when(low_side, b["lo"]).otherwise(mid).alias("lo"), F.when(low_side, mid).otherwise(b["hi"]).alias("hi"))

    box = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, halve)
    return a.withColumn("_b", F.when(F.col("_lo") * F.col("_hi") <= 0, box)).select(*k, ((F.col("_b.lo") + F.col("_b.hi")) / 2).alias("xirr"))


def future_value(lump: Column, monthly: Column, years: Column, rate: Column) -> Column:
    """Lump and monthly contributions with monthly compounding."""
    months = F.greatest(F.lit(0), F.round(years * 12).cast("int"))
    r = rate / 12
    up = F.pow(r + 1, months)
    return F.when(months == 0, lump).when(r == 0, lump + monthly * months).otherwise(lump * up + monthly * (up - 1) / r)


def base_growth(*metrics: Column) -> Column:
    """First present growth metric; values above 1.5 were given in percent; 6 % when none is known."""
    first = F.coalesce(*metrics)
    return F.coalesce(F.when(F.abs(first) > 1.5, first / 100).otherwise(first), F.lit(0.06))


def projection_table(users: DataFrame, key="user_id") -> DataFrame:
    """Year-by-year value under three growth scenarios; needs lump, monthly, years and base_cagr."""
    base = F.col("base_cagr")
    sc = F.array(F.struct(F.lit("Conservative").alias("s"), F.greatest(F.lit(0.01), base - 0.02).alias("r")),
                 F.struct(F.lit("Base").alias("s"), base.alias("r")), F.struct(F.lit("Optimistic").alias("s"), (base + 0.02).alias("r")))
    u = users.withColumn("_s", F.explode(sc)).withColumn("year", F.explode(F.sequence(F.lit(0), F.greatest(F.lit(1), F.col("years")))))
    return u.select(*keys_of(key), F.col("_s.s").alias("scenario"), "year",
                    future_value(F.col("lump"), F.col("monthly"), F.col("year"), F.col("_s.r")).alias("value"))
