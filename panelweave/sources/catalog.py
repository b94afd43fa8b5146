"""Catalog, universe and objectives configuration as tables."""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.expr import literal_table
from ..operators.clean import unique_symbols

CATALOG_SCHEMA = """assets array<struct<symbol string, name string, class string, asset_class string, sector string, region string,
 eligibility string, risk_bucket string, core_or_satellite string, max_weight double, min_history_years double>>,
 caps struct<asset_class: map<string, double>>"""


def catalog_documents(spark: SparkSession, path: str) -> DataFrame:
    """Catalog files, one JSON document each."""
    return spark.read.text(path, wholetext=True).withColumnRenamed("value", "body")


def catalog_assets(documents: DataFrame, body: str = "body") -> DataFrame:
    """One row per symbol (upper case); the first entry of a repeated symbol counts."""
    doc = documents.select(F.from_json(body, CATALOG_SCHEMA).alias("d"))
    rows = doc.select(F.posexplode("d.assets").alias("ordinal", "a")).select("ordinal", "a.*").where("symbol is not null")
    return unique_symbols(rows)


def class_caps(documents: DataFrame, body: str = "body") -> DataFrame:
    doc = documents.select(F.from_json(body, CATALOG_SCHEMA).alias("d"))
    return doc.select(F.explode("d.caps.asset_class").alias("asset_class", "cap"))


def filter_universe(universe: DataFrame, asset_classes: list[str] | None = None, min_history: float | None = None,
                    core_only: bool = False) -> DataFrame:
    out = universe
    if asset_classes:
        out = out.where(F.col("asset_class").isin(asset_classes))
    if min_history is not None:
        out = out.where(F.coalesce("min_history_years", F.lit(0.0)) >= min_history)
    return out.where("core_or_satellite = 'core'") if core_only else out


def symbols_by_class(universe: DataFrame) -> DataFrame:
    """Symbols of each class in list order (catalog sized)."""
    ordered = F.sort_array(F.collect_list(F.struct("ordinal", "symbol")))
    return universe.groupBy("asset_class").agg(F.transform(ordered, lambda x: x["symbol"]).alias("symbols"))


def asset_metadata(universe: DataFrame, symbol: str) -> DataFrame:
    return universe.where(F.col("symbol") == symbol)


def objective_tables(spark: SparkSession, config: dict) -> tuple[DataFrame, DataFrame]:
    """Parsed objectives configuration as (objectives, asset class bands)."""
    rows, bands = [], []
    for i, (name, o) in enumerate(config.items()):
        r, v = o["target_return"], o["target_volatility"]
        rows.append((i, name, o["label"], float(o["risk_score_min"]), float(o["risk_score_max"]), float(o["risk_score_optimal"]),
                     r["min"], r["max"], r["target"], v["min"], v["max"], v["target"],
                     o.get("min_holdings", 8), o.get("max_holdings", 20), bool(o.get("prefer_core_assets", False))))
        bands += [(name, j, c, float(b.get("min", 0.0)), float(b.get("max", 1.0))) for j, (c, b) in enumerate(o["asset_class_bands"].items())]
    return (
        literal_table(spark, rows, "position name label risk_min risk_max risk_optimal ret_min ret_max ret_target vol_min_target "
                                   "vol_max_target vol_target_target min_holdings max_holdings prefer_core"),
        literal_table(spark, bands, "name band_order asset_class band_min band_max"))
