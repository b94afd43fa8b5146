"""Reshape, cleaning and calendars over tidy price and return panels."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from ..functions.expr import col, div, finite, keys_of, pct


def panel_calendar(panel: DataFrame) -> DataFrame:
    """Distinct panel dates with their position and the date before.

    The unpartitioned window only ever sees the calendar (thousands of days), never the panel.
    """
    w = W.orderBy("date")
    return panel.select("date").distinct().select(
        "date", F.row_number().over(w).alias("date_idx"), F.lag("date").over(w).alias("prev_date"))


def tidy_prices(df: DataFrame, seq: str) -> DataFrame:
    """(ticker, date, price) from any frame with a price-like column; the first row per key, by ``seq``, wins."""
    names = {c.lower(): c for c in df.columns}
    price = F.coalesce(*[F.col(names[c]).try_cast("double") for c in ("price", "adj_close", "close", "last") if c in names][:1])
    ticker = F.col(names.get("ticker") or names["symbol"])
    out = df.select(F.trim(ticker.cast("string")).alias("ticker"), F.col(names["date"]).try_cast("date").alias("date"),
                    finite(price).alias("price"), seq)
    out = out.withColumn("_n", F.row_number().over(W.partitionBy("ticker", "date").orderBy(seq)))
    return out.where("_n = 1 and date is not null and price is not null and ticker <> ''").select("ticker", "date", "price")


def to_wide(panel: DataFrame, tickers: list[str], value: str = "price") -> DataFrame:
    """One column per named ticker, for the edge of the system; all-null dates are dropped."""
    wide = panel.where(F.col("ticker").isin(tickers)).groupBy("date").pivot("ticker", tickers).agg(F.first(value))
    return wide.na.drop(how="all", subset=tickers)


def align_outer(series: dict[str, DataFrame], value: str = "price") -> DataFrame:
    """Any number of named series, with one value a date each, side by side on the union of their dates.

    One aggregation by date, whatever the number of series.
    """
    rows = reduce(DataFrame.union, (df.select("date", F.lit(name).alias("_s"), F.col(value).alias("_v")) for name, df in series.items()))
    return rows.groupBy("date").agg(*(F.max(F.when(F.col("_s") == name, F.col("_v"))).alias(name) for name in series))


def melt(wide: DataFrame, columns: list[str], name: str = "series", value: str = "value") -> DataFrame:
    return wide.unpivot("date", columns, name, value).where(F.col(value).isNotNull())


def period_last(panel: DataFrame, freq: str = "W", key="ticker", value: str = "price") -> DataFrame:
    """Last value of each week (labelled by its Sunday), month or quarter end."""
    end: Column = {
        "W": F.date_add(F.date_trunc("week", "date").cast("date"), 6),
        "M": F.last_day("date"),
        "Q": F.last_day(F.add_months(F.date_trunc("quarter", "date").cast("date"), 2)),
    }[freq[0].upper()]
    return panel.where(F.col(value).isNotNull()).groupBy(*keys_of(key), end.alias("period_end")).agg(
        F.max_by(value, "date").alias(value))


def densify(panel: DataFrame, key="ticker", value: str = "price", business_days: bool = False) -> DataFrame:
    """Every (business) day between a key's first and last date, forward filled.

    Each key expands its own span with ``sequence``, so no date x key cross join is needed.
    """
    k = keys_of(key)
    span = panel.groupBy(*k).agg(F.min("date").alias("_a"), F.max("date").alias("_b"))
    days = span.select(*k, F.explode(F.sequence("_a", "_b")).alias("date"))
    if business_days:
        days = days.where(F.weekday("date") < 5)
    w = W.partitionBy(*k).orderBy("date").rowsBetween(W.unboundedPreceding, 0)
    return days.join(panel, [*k, "date"], "left").withColumn(value, F.last(value, True).over(w))


def simple_returns(panel: DataFrame, freq: str = "D", key: str = "ticker", calendar: DataFrame | None = None) -> DataFrame:
    """price / previous price - 1, never across a gap of the panel.

    A ticker absent on a panel date has no return on that date nor on the next one. Pass the
    calendar when it is known, which saves a second pass over the panel.
    """
    if freq.upper() == "B":
        panel = densify(panel, key, business_days=True)
    elif freq.upper() != "D":
        panel = period_last(panel, freq, key).withColumnRenamed("period_end", "date")
    w = W.partitionBy(key).orderBy("date")
    out = panel.join(panel_calendar(panel) if calendar is None else calendar, "date").select(
        key, "date", "prev_date", (div("price", F.lag("price").over(w)) - 1).alias("ret"),
        F.lag("date").over(w).alias("_last"))
    return out.where("_last = prev_date").select(key, "date", finite("ret").alias("ret")).where("ret is not null")


def own_returns(panel: DataFrame, key: str = "ticker") -> DataFrame:
    """Change against the ticker's own previous row, whatever the gap."""
    w = W.partitionBy(key).orderBy("date")
    return panel.withColumn("ret", finite(div("price", F.lag("price").over(w)) - 1)).where("ret is not null")


def bounded_fill(panel: DataFrame, limit: int = 5, calendar: DataFrame | None = None) -> DataFrame:
    """Forward fill at most ``limit`` consecutive panel dates per ticker.

    Only the rows to be filled are generated (from a row to the next one), not the whole grid;
    positions past the last panel date fall out of the join back to the calendar.
    """
    cal = panel_calendar(panel) if calendar is None else calendar
    nxt = F.lead("date_idx").over(W.partitionBy("ticker").orderBy("date_idx"))
    steps = panel.join(cal.select("date", "date_idx"), "date").withColumn("_next", nxt)
    upto = F.least(F.col("date_idx") + limit, F.col("_next") - 1)  # least skips the null of the last row
    filled = steps.select("ticker", "price", F.col("date_idx").alias("_from"),
                          F.explode(F.sequence("date_idx", upto)).alias("date_idx"))
    return filled.join(cal.select("date", "date_idx"), "date_idx").select(
        "ticker", "date", "price", (F.col("date_idx") != F.col("_from")).alias("filled"))


def trailing_dates(panel: DataFrame, k: int = 1260, calendar: DataFrame | None = None) -> DataFrame:
    """Rows on the last k dates of the calendar (default: the panel's own dates)."""
    days = (panel if calendar is None else calendar).select("date").distinct().orderBy(F.desc("date")).limit(k)
    return panel.join(days, "date", "left_semi")


def observation_counts(rets: DataFrame, key: str = "ticker", value: str = "ret") -> DataFrame:
    return rets.groupBy(key).agg(F.count(value).alias("n_obs"))


def min_observations(rets: DataFrame, n: int, key: str = "ticker") -> DataFrame:
    """Series with at least n returns. A key has at most one row per day, so its window is bounded
    by the calendar, and the filter costs no second pass over the panel."""
    return rets.withColumn("_n", F.count("ret").over(W.partitionBy(key))).where(F.col("_n") >= n).drop("_n")


def dropped_for_observations(tickers: DataFrame, rets: DataFrame, n: int, reason: str = "too-few-points") -> DataFrame:
    """The other side of min_observations: who was dropped and why."""
    enough = observation_counts(rets).where(F.col("n_obs") >= n)
    return tickers.select("ticker").distinct().join(enough, "ticker", "left_anti").withColumn("reason", F.lit(reason))


def winsorise(rets: DataFrame, p: float = 0.005, key: str = "ticker") -> DataFrame:
    """Clip each series to its [p, 1-p] quantiles (linear interpolation)."""
    q = F.percentile("ret", F.array(F.lit(p), F.lit(1 - p))).over(W.partitionBy(key))
    return rets.withColumn("_q", q).withColumn(
        "ret", F.greatest(F.col("_q")[0], F.least(F.col("_q")[1], F.col("ret")))).drop("_q")


def winsorise_by_count(rets: DataFrame, p: float = 0.005, key: str = "ticker") -> DataFrame:
    """Replace the int(p*n) lowest and highest values by the next kept one."""
    part = W.partitionBy(key)
    rn, n = F.row_number().over(part.orderBy("ret", "date")), F.count("ret").over(part)
    ranked = rets.withColumn("_rn", rn).withColumn("_n", n).withColumn("_k", F.floor(F.col("_n") * F.lit(p)))
    lo = F.max(F.when(F.col("_rn") == F.col("_k") + 1, F.col("ret"))).over(part)
    hi = F.max(F.when(F.col("_rn") == F.col("_n") - F.col("_k"), F.col("ret"))).over(part)
    return ranked.withColumn("_lo", lo).withColumn("_hi", hi).select(
        key, "date", F.greatest("_lo", F.least("_hi", F.col("ret"))).alias("ret"))


def complete_case(rets: DataFrame, group=()) -> DataFrame:
    """Rows on dates where every ticker (of the group) has a value."""
    g = list(group)
    if g:
        need = rets.groupBy(*g).agg(F.count_distinct("ticker").alias("_need"))
        out = rets.join(need, g)
    else:
        out = rets.withColumn("_need", rets.agg(F.count_distinct("ticker")).scalar())
    out = out.withColumn("_have", F.count("ticker").over(W.partitionBy(*g, "date")))
    return out.where("_have = _need").drop("_have", "_need")


def drop_constant(rets: DataFrame, key: str = "ticker") -> DataFrame:
    return rets.withColumn("_s", F.stddev_samp("ret").over(W.partitionBy(key))).where("_s > 0").drop("_s")


def strict_returns(panel: DataFrame, winsor_p: float = 0.005, min_obs: int = 252) -> DataFrame:
    """Returns, minimum history, winsorised, complete dates only."""
    return complete_case(winsorise(min_observations(simple_returns(panel), min_obs), winsor_p))


def numeric_clean(rets: DataFrame, winsor_p: float = 0.0) -> DataFrame:
    live = drop_constant(rets)
    return complete_case(winsorise(live, winsor_p) if winsor_p else live)


def robust_returns(panel: DataFrame, winsor_p: float = 0.005, min_obs: int = 126, k_days: int = 1260,
                   strict: bool = False) -> DataFrame:
    """Gap-tolerant cleaner: bounded fill, history test before and inside the trailing window."""
    if strict:
        return strict_returns(panel, winsor_p, max(252, min_obs))
    cal = panel_calendar(panel)
    rets = min_observations(simple_returns(bounded_fill(panel, calendar=cal), calendar=cal), min_obs)
    window = min_observations(trailing_dates(rets, k_days, calendar=cal), min_obs)
    return complete_case(winsorise(window, winsor_p))


def robust_diagnostics(panel: DataFrame, min_obs: int = 126, k_days: int = 1260) -> DataFrame:
    """Per ticker: observations before and inside the window, and the reason it was dropped."""
    cal = panel_calendar(panel)
    first = cal.orderBy(F.desc("date")).limit(k_days).agg(F.min("date")).scalar()
    counts = simple_returns(bounded_fill(panel, calendar=cal), calendar=cal).groupBy("ticker").agg(
        F.count("ret").alias("n_obs"), F.count(F.when(F.col("date") >= first, F.col("ret"))).alias("n_window"))
    base = panel.select("ticker").distinct().join(counts, "ticker", "left").na.fill(0, ["n_obs", "n_window"])
    return base.withColumn("reason", F.when(F.col("n_obs") < min_obs, "too-few-points")
                           .when(F.col("n_window") < min_obs, "too-few-points-window"))


def overlap_preclean(panel: DataFrame, k_days: int = 1260, min_obs: int = 126, min_overlap: float = 0.70) -> DataFrame:
    """Which tickers to keep so that enough dates are shared by all of them.

    Tickers are ranked by coverage. For a kept set of the best n, a date is shared when its first
    missing rank is above n and touched when its first present rank is at most n, so two events a date
    and running sums over n score every n at once.
    """
    window = trailing_dates(panel, k_days)
    counts = window.groupBy("ticker").agg(F.count("price").alias("n_obs"))
    days = window.agg(F.count_distinct("date")).scalar()
    ok = counts.where(F.col("n_obs") >= min_obs)
    ranks = ok.withColumn("rank", F.row_number().over(W.orderBy(F.desc("n_obs"), "ticker")))  # one row per ticker
    n_all = ranks.agg(F.max("rank")).scalar()
    seen = window.join(ranks.select("ticker", "rank"), "ticker")
    seen = seen.withColumn("_rn", F.row_number().over(W.partitionBy("date").orderBy("rank")))
    per_date = seen.groupBy("date").agg(
        F.min("rank").alias("first_present"),
        (F.sum((F.col("rank") == F.col("_rn")).cast("int")) + 1).cast("int").alias("first_missing"))
    # sweep over n: a date is touched from its first present rank on, shared from there up to its first missing one
    whole = (F.col("first_missing") > F.col("first_present")).cast("int")
    events = per_date.select(F.explode(F.array(F.struct(F.col("first_present").alias("n"), F.lit(1).alias("any"), whole.alias("all")),
                                               F.struct(F.col("first_missing").alias("n"), F.lit(0).alias("any"), (-whole).alias("all")))).alias("e")).select("e.*")
    steps = ranks.select(F.col("rank").alias("n")).join(events.groupBy("n").agg(F.sum("any").alias("any"), F.sum("all").alias("all")), "n", "left").na.fill(0)
    upto = W.orderBy("n").rowsBetween(W.unboundedPreceding, 0)  # one row per ticker
    scores = steps.select("n", F.sum("any").over(upto).alias("any_dates"), F.sum("all").over(upto).alias("all_dates"))
    scores = scores.withColumn("ratio", div("all_dates", "any_dates"))
    best = scores.where((F.col("n") >= 3) & (F.col("ratio") >= min_overlap)).agg(F.max("n")).scalar()
    take = F.when(n_all <= 3, n_all).otherwise(F.coalesce(best, n_all))
    out = counts.join(ranks.select("ticker", "rank"), "ticker", "left").withColumn("coverage", F.col("n_obs") / days)
    return out.select(
        "ticker", "n_obs", "coverage", F.coalesce(F.col("rank") <= take, F.lit(False)).alias("kept"),
        F.when(F.col("rank").isNull(), F.format_string("only_%d_obs", "n_obs"))
        .when(F.col("rank") > take, F.concat(F.lit("low_overlap_"), pct(F.col("coverage")))).alias("reason"))


def normalise_symbol(c, exchange_suffix: bool = False) -> Column:
    """Trimmed upper-case symbol, or the lower-case exchange form with a ``.us`` suffix."""
    s = F.trim(col(c))
    if not exchange_suffix:
        return F.upper(s)
    low = F.lower(s)
    return F.when(low.rlike("^[a-z]+$"), F.concat(low, F.lit(".us"))).otherwise(low)


def unique_symbols(df: DataFrame, symbol: str = "symbol", order: str = "ordinal") -> DataFrame:
    """First row per normalised symbol, in list order; blanks dropped."""
    out = df.withColumn(symbol, normalise_symbol(symbol)).where(F.col(symbol) != "")
    return out.withColumn("_n", F.row_number().over(W.partitionBy(symbol).orderBy(order))).where("_n = 1").drop("_n")
