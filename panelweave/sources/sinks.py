"""Writers and the tables they can be read back from."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F


def write_price_store(bars: DataFrame, path: str, fetched_at: Column, source: str = "api", min_rows: int = 100) -> None:
    """Bars partitioned by ticker with a manifest beside them; short series are refused.

    Rows are laid out by ticker and year before the write, so a ticker's history is spread over
    several writers and one busy ticker does not end up in a single task.
    """
    n = F.count("*").over(W.partitionBy("ticker"))
    good = bars.withColumn("_n", n).where(F.col("_n") >= min_rows).drop("_n")
    good.repartition("ticker", F.year("date")).write.mode("overwrite").partitionBy("ticker").parquet(f"{path}/prices")
    stored = bars.sparkSession.read.parquet(f"{path}/prices")
    stored.groupBy("ticker").agg(
        F.min("provider").alias("provider"), F.min("date").alias("start"), F.max("date").alias("end"), F.count("*").alias("rows")
    ).withColumns({"fetched_at": fetched_at, "source": F.concat("provider", F.lit(f".{source}"))}).write.mode("overwrite").parquet(f"{path}/manifest")


def read_price_store(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/prices"), spark.read.parquet(f"{path}/manifest")


def write_scenario(candidates: DataFrame, weights: DataFrame, horizon_metrics: DataFrame, tickers: list[str], horizons: list[str], path: str) -> None:
    """Candidates as nested JSON lines, weights and horizon metrics as wide CSV tables."""
    held = weights.where("weight > 0").groupBy("portfolio_id").agg(F.map_from_entries(F.collect_list(F.struct("ticker", "weight"))).alias("weights"))
    m = F.struct(*[c for c in candidates.columns if c != "portfolio_id"]).alias("metrics")
    candidates.select("portfolio_id", m).join(held, "portfolio_id", "left").write.mode("overwrite").json(f"{path}/candidates")
    weights.groupBy("portfolio_id").pivot("ticker", tickers).agg(F.sum("weight")).na.fill(0.0).write.mode("overwrite").option("header", True).csv(f"{path}/weights")
    horizon_metrics.groupBy("portfolio_id").pivot("horizon", horizons).agg(
        F.first("cagr").alias("cagr"), F.first("volatility").alias("volatility"), F.first("sharpe").alias("sharpe"), F.first("max_dd").alias("max_dd")
    ).write.mode("overwrite").option("header", True).csv(f"{path}/metrics")


def write_universe_snapshot(records: DataFrame, metrics: DataFrame, path: str) -> None:
    records.write.mode("overwrite").parquet(f"{path}/universe_records")
    metrics.write.mode("overwrite").parquet(f"{path}/universe_metrics")


def read_universe_snapshot(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(valid symbols' records, aggregate metrics) of the last snapshot."""
    return spark.read.parquet(f"{path}/universe_records").where("valid"), spark.read.parquet(f"{path}/universe_metrics")
