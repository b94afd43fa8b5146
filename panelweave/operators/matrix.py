"""Covariance and correlation of many series.

A covariance matrix is quadratic in the tickers by nature; what must not be quadratic is the row
count that gets shuffled. Dates are cut into blocks and tickers into tiles; one task multiplies one
bounded block (numpy) and emits its partial sums, which Spark then adds up per pair.
"""
from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..functions.expr import TRADING_DAYS, div
from . import clean, stats

_SUMS = ["n", "si", "sj", "sii", "sjj", "sij", "siijj"]
_SCHEMA = "i string, j string, " + ", ".join(f"{s} double" for s in _SUMS)


def _block_sums(pdf: pd.DataFrame) -> pd.DataFrame:
    wide = pdf.pivot(index="date", columns="ticker", values="ret")
    tile = pdf.groupby("ticker")["own"].first().reindex(wide.columns).to_numpy()
    x = wide.to_numpy(dtype=float)
    m = (~np.isnan(x)).astype(float)
    x = np.nan_to_num(x)
    sq = x * x
    s, ss = x.T @ m, sq.T @ m
    names = wide.columns.to_numpy()
    a, b = np.triu_indices(len(names))
    lo, hi = pdf["ti"].iat[0], pdf["tj"].iat[0]
    if lo != hi:  # two tiles: only the pairs across them belong to this block
        keep = tile[a] != tile[b]
        a, b = a[keep], b[keep]
    return pd.DataFrame({
        "i": names[a], "j": names[b], "n": (m.T @ m)[a, b], "si": s[a, b], "sj": s[b, a], "sii": ss[a, b], "sjj": ss[b, a],
        "sij": (x.T @ x)[a, b], "siijj": (sq.T @ sq)[a, b]})


TILE_TICKERS = 500


def pair_sums(rets: DataFrame, tiles: int | None = None, block_days: int = 512) -> DataFrame:
    """Sums over shared dates for every pair i <= j.

    ``tiles`` bounds a block to about 2 x tickers / tiles columns; by default it follows from the ticker
    count, at TILE_TICKERS a tile. A row is copied once per tile, never once per partner.
    """
    tiles = F.lit(tiles) if tiles else rets.agg(F.greatest(F.ceil(F.count_distinct("ticker") / TILE_TICKERS), F.lit(1)).cast("int")).scalar()
    own = F.pmod(F.xxhash64("ticker"), tiles).cast("int")
    rows = rets.where("ret is not null").select(
        "ticker", "date", "ret", own.alias("own"),
        F.floor(F.datediff("date", F.lit("1970-01-01").cast("date")) / block_days).alias("block"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), tiles - 1))).select(
        "ticker", "date", "ret", "own", "block", F.least("own", "other").alias("ti"), F.greatest("own", "other").alias("tj"))
    part = rows.groupBy("block", "ti", "tj").applyInPandas(_block_sums, _SCHEMA)
    return part.groupBy("i", "j").agg(*[F.sum(s).alias(s) for s in _SUMS])


def _mirror(pairs: DataFrame) -> DataFrame:
    """Both triangles of a symmetric matrix in long form."""
    sides = F.when(F.col("i") == F.col("j"), F.array(F.struct("i", "j"))).otherwise(
        F.array(F.struct("i", "j"), F.struct(F.col("j").alias("i"), F.col("i").alias("j"))))
    return pairs.select(F.explode(sides).alias("_p"), "value").select("_p.i", "_p.j", "value")


def _cov():
    return div(F.col("sij") - div(F.col("si") * F.col("sj"), "n"), F.col("n") - 1)


def covariance(rets: DataFrame, annual: bool = True, tiles: int | None = None) -> DataFrame:
    """Pairwise sample covariance (shared dates of each pair), annualised by default."""
    return _mirror(pair_sums(rets, tiles).select("i", "j", (_cov() * (TRADING_DAYS if annual else 1)).alias("value")))


def lookback_covariance(aged: DataFrame, lookbacks: list[int], tiles: int | None = None) -> DataFrame:
    """(lookback, i, j, value): annual pairwise covariance over each of the look-backs, from one pass.

    ``aged`` carries ``_age``, the panel's dates counted from the last (1). Dates fall into bands between
    the look-backs; a pair's sums are taken once a band and added up, so a look-back is a prefix of bands.
    """
    ends = sorted(lookbacks)
    band = F.coalesce(*[F.when(F.col("_age") <= n, i) for i, n in enumerate(ends)])
    parts = [pair_sums(aged.where(band == i), tiles).withColumn("band", F.lit(i)) for i in range(len(ends))]
    sums = reduce(lambda a, b: a.unionByName(b), parts)
    upto = F.explode(F.sequence("band", F.lit(len(ends) - 1))).alias("upto")
    total = sums.select("i", "j", upto, *_SUMS).groupBy("upto", "i", "j").agg(*[F.sum(c).alias(c) for c in _SUMS])
    total = total.withColumn("lookback", F.get(F.array(*map(F.lit, ends)), F.col("upto")))
    both = F.when(F.col("i") == F.col("j"), F.array(F.struct("i", "j"))).otherwise(F.array(F.struct("i", "j"), F.struct(F.col("j").alias("i"), F.col("i").alias("j"))))
    return total.select("lookback", F.explode(both).alias("_p"), (_cov() * TRADING_DAYS).alias("value")).select("lookback", "_p.i", "_p.j", "value")


def correlation(rets: DataFrame, tiles: int | None = None) -> DataFrame:
    """Upper triangle of the pairwise correlation."""
    n = F.col("n")
    spread = F.sqrt((n * F.col("sii") - F.col("si") * F.col("si")) * (n * F.col("sjj") - F.col("sj") * F.col("sj")))
    return pair_sums(rets, tiles).where("i < j").select("i", "j", div(n * F.col("sij") - F.col("si") * F.col("sj"), spread).alias("value"))


def correlation_summary(rets: DataFrame, tiles: int | None = None) -> DataFrame:
    """Mean correlation of all pairs and mean population volatility of all series."""
    vol = rets.groupBy("ticker").agg((F.stddev_pop("ret") * stats.ROOT).alias("v"))
    return vol.agg(F.avg("v").alias("avg_volatility")).withColumn(
        "avg_correlation", correlation(rets, tiles).agg(F.avg("value")).scalar())


def shrunk_covariance(rets: DataFrame, tiles: int | None = None) -> DataFrame:
    """Ledoit-Wolf shrinkage towards a scaled identity (2004), on complete dates, annualised."""
    from pyspark.sql import Window as W

    full = clean.complete_case(rets)
    centred = full.withColumn("ret", F.col("ret") - F.avg("ret").over(W.partitionBy("ticker")))
    s = pair_sums(centred, tiles).select("i", "j", "n", (F.col("sij") / F.col("n")).alias("s"), (F.col("siijj") / F.col("n")).alias("q"))
    diag, both = F.col("i") == F.col("j"), F.when(F.col("i") == F.col("j"), 1.0).otherwise(2.0)
    t = s.agg(F.count_if(diag).alias("p"), F.max("n").alias("n"), F.sum(F.when(diag, F.col("s"))).alias("tr"),
              F.sum(both * F.col("s") * F.col("s")).alias("ss"), F.sum(both * (F.col("q") - F.col("s") * F.col("s"))).alias("b"))
    m = F.col("tr") / F.col("p")
    d = (F.col("ss") - m * F.col("tr")) / F.col("p")  # sum (S - mI)^2 = sum S^2 - 2 m tr + p m^2
    b = F.least(d, F.col("b") / (F.col("p") * F.col("n")))
    k = t.select(F.struct(m.alias("m"), F.coalesce(div(b, d), F.lit(0.0)).alias("lam")).alias("k")).scalar()
    out = s.withColumn("_k", k)
    value = (F.lit(1.0) - F.col("_k.lam")) * F.col("s") + F.when(diag, F.col("_k.lam") * F.col("_k.m")).otherwise(0.0)
    return _mirror(out.select("i", "j", (value * TRADING_DAYS).alias("value")))


def as_rows(matrix: DataFrame) -> DataFrame:
    """One row per i with its values by j as a map: the form the portfolio operators join to."""
    return matrix.groupBy("i").agg(F.map_from_entries(F.collect_list(F.struct("j", "value"))).alias("row"))
