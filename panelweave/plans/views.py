"""The engine's input tables, derived from the driver's star-schema tables.

One nation of suppliers is a ticker, its discount level a bounded price index; a customer is an
investor; the customers of one nation and market segment hold a book (portfolio); one hour of
events is one day of a macro series.
"""
from __future__ import annotations

from functools import cached_property

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from ..functions.expr import choose, dealt, lookup, mod
from ..operators import clean

CLASS_OF_REGION = {"AFRICA": "equity", "AMERICA": "bond", "ASIA": "reit", "EUROPE": "commodity", "MIDDLE EAST": "cash"}
SERIES_OF_EVENT = {"click": "DGS10", "view": "CPIAUCSL", "error": "UNRATE", "purchase": "FEDFUNDS", "signup": "T10Y2Y"}
PROVIDER_OF_FLAG = {"A": "stooq", "N": "tiingo", "R": "yfinance"}
FINE_CLASS = {
    "equity": ("public_equity", "public_equity_intl"),
    "bond": ("treasury_long", "corporate_bond"),
    "reit": ("reit", "reit"),
    "commodity": ("gold", "commodities"),
    "cash": ("tbills", "tbills"),
}
BROADCAST_ROWS = 1 << 20  # of a supplier's key and two names
OBJECTIVE_NAMES = ["CONSERVATIVE", "BALANCED", "GROWTH", "GROWTH_PLUS_INCOME", "AGGRESSIVE", "INCOME"]
GOALS = ["grow", "grow_income", "income", "preserve", "tax_efficiency", "other"]


def kept(df: DataFrame) -> DataFrame:
    """A compact panel that many branches of a query read: computed by the first action that needs it, kept
    in memory or on disk, and worked out again from its lineage where an executor is lost. Equal plans of
    other queries in the session find the same data."""
    return df.persist(StorageLevel.MEMORY_AND_DISK)


class Views:
    """Lazy views over one data folder; nothing runs until a caller acts on a result."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir.rstrip("/")

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def nations(self) -> DataFrame:
        return self.table("nation").join(self.table("region"), F.col("n_regionkey") == F.col("r_regionkey"))

    @cached_property
    def fact(self) -> DataFrame:
        """Line items with ticker, class ticker, trade date and price quote."""
        line = self.table("lineitem").select(
            "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice",
            "l_discount", "l_returnflag", F.to_date("l_shipdate").alias("date"),
            (F.lit(100.0) * (F.lit(0.95) + F.col("l_discount"))).alias("px"),
        )
        return line.join(self.sellers, F.col("l_suppkey") == F.col("s_suppkey"))

    @cached_property
    def sellers(self) -> DataFrame:
        """Ticker and class ticker of every supplier. The planner takes the product of both sides for the size of
        a join and would shuffle the line items for it; up to BROADCAST_ROWS short rows are sent to the tasks."""
        seller = self.table("supplier").join(self.nations, F.col("s_nationkey") == F.col("n_nationkey")).select(
            "s_suppkey", F.col("n_name").alias("ticker"), F.col("r_name").alias("cls"))
        return F.broadcast(seller) if self.table("supplier").count() <= BROADCAST_ROWS else seller

    def _bars(self, *by: str) -> DataFrame:
        first = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
        return self.fact.groupBy(*by).agg(
            F.min_by("px", first).alias("open"), F.max("px").alias("high"), F.min("px").alias("low"),
            F.avg("px").alias("close"), F.sum("l_quantity").alias("volume"))

    @cached_property
    def prices_raw(self) -> DataFrame:
        """Daily bars per provider, with the gaps real feeds have."""
        bars = self._bars("l_returnflag", "ticker", "date")
        day = F.dayofmonth("date")
        p = lookup(F.col("l_returnflag"), PROVIDER_OF_FLAG)
        return kept(bars.select(
            p.alias("provider"), "ticker", "date",
            F.when(~((F.col("l_returnflag") == "N") & (day == 1)), F.col("open")).alias("open"),
            "high", "low", "close",
            F.when(F.col("l_returnflag") != "R", F.col("close")).alias("adj_close"),
            F.when(~((F.col("l_returnflag") == "A") & (day <= 3)), F.col("volume")).alias("volume")))

    @cached_property
    def ohlcv(self) -> DataFrame:
        return self._bars("ticker", "date").withColumn("adj_close", F.col("close"))

    @cached_property
    def prices(self) -> DataFrame:
        return kept(self.fact.groupBy("ticker", "date").agg(F.avg("px").alias("price")))

    @cached_property
    def prices_class(self) -> DataFrame:
        return kept(self.fact.groupBy(F.col("cls").alias("ticker"), "date").agg(F.avg("px").alias("price")))

    @cached_property
    def returns(self) -> DataFrame:
        return kept(clean.simple_returns(self.prices))

    @cached_property
    def returns_class(self) -> DataFrame:
        return kept(clean.simple_returns(self.prices_class))

    @cached_property
    def returns_table(self) -> DataFrame:
        """The return panel, for queries that read it many times."""
        return self.returns

    @cached_property
    def returns_class_table(self) -> DataFrame:
        return self.returns_class

    @cached_property
    def books_class_table(self) -> DataFrame:
        return self.books_class

    @cached_property
    def catalog(self) -> DataFrame:
        """One row per ticker of the price panel."""
        ac = lookup(F.col("r_name"), CLASS_OF_REGION)
        even = mod(F.col("n_nationkey"), 2) == 0
        fine = F.coalesce(*[F.when(ac == k, F.when(even, a).otherwise(b)) for k, (a, b) in FINE_CLASS.items()])
        return self.nations.select(
            F.col("n_name").alias("symbol"), ac.alias("asset_class"), fine.alias("class"),
            F.when(even, "core").otherwise("satellite").alias("core_or_satellite"),
            F.col("n_nationkey").cast("long").alias("ordinal"))

    @cached_property
    def catalog_class(self) -> DataFrame:
        """One row per ticker of the five-ticker class panel."""
        return self.table("region").select(
            F.col("r_name").alias("symbol"), lookup(F.col("r_name"), CLASS_OF_REGION).alias("asset_class"),
            F.when(F.col("r_name").isin("AFRICA", "AMERICA", "MIDDLE EAST"), "core").otherwise("satellite")
            .alias("core_or_satellite"))

    @cached_property
    def listing(self) -> DataFrame:
        """Wide instrument list, one row per supplier: grows with the data."""
        n = F.col("s_suppkey").cast("long")
        s = self.table("supplier").join(self.nations, F.col("s_nationkey") == F.col("n_nationkey"))
        ac = lookup(F.col("r_name"), CLASS_OF_REGION)
        fine = F.coalesce(*[F.when(ac == k, F.when(mod(n, 2) == 0, a).otherwise(b)) for k, (a, b) in FINE_CLASS.items()])
        tier = F.when(mod(n, 3) == 0, "satellite").otherwise("core")
        return s.select(
            F.col("s_name").alias("symbol"), F.concat(F.lit("Fund "), n.cast("string")).alias("name"), ac.alias("asset_class"),
            F.when(mod(n, 7) == 0, "single_stock").otherwise(fine).alias("class"),
            choose([None, "tech", "energy", "health"], mod(n, 4)).alias("sector"),
            F.col("r_name").alias("region"), F.col("n_name").alias("ticker"),
            F.when(mod(n, 9) == 8, "accredited").otherwise("retail").alias("eligibility"),
            tier.alias("risk_bucket"), tier.alias("core_or_satellite"),
            (F.lit(0.1) + mod(n, 5) * F.lit(0.25)).alias("max_weight"),
            (F.lit(5.0) + mod(n, 4) * F.lit(5.0)).alias("min_history_years"), n.alias("ordinal"))

    @cached_property
    def buyers(self) -> DataFrame:
        """Order to customer, nation and segment."""
        return self.table("orders").select("o_orderkey", "o_custkey").join(
            self.table("customer").select("c_custkey", "c_nationkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"))

    def _weights(self, portfolio, ticker, buyers: DataFrame, many: bool = False) -> DataFrame:
        """Share of spend per ticker. Spend collapses to (portfolio, ticker) by partial aggregation
        before anything is grouped by portfolio alone. With ``many`` portfolios nothing collapses: lines are dealt
        by portfolio once, for the sums and for all that follows by portfolio."""
        lines, n = self.fact, self.table("lineitem").count() if many else 0
        if many:
            lines, buyers = dealt(lines, n, "l_orderkey"), dealt(buyers, n, "o_orderkey")
        spend = lines.join(buyers, F.col("l_orderkey") == F.col("o_orderkey")).select(
            portfolio.alias("portfolio_id"), ticker.alias("ticker"), "l_extendedprice")
        spend = (dealt(spend, n, "portfolio_id") if many else spend).groupBy("portfolio_id", "ticker").agg(F.sum("l_extendedprice").alias("spend"))
        total = F.sum("spend").over(W.partitionBy("portfolio_id"))
        return spend.select("portfolio_id", "ticker", (F.col("spend") / total).alias("weight"))

    def customer_weights(self, ticker: str = "ticker") -> DataFrame:
        orders = self.table("orders").select("o_orderkey", "o_custkey")
        return self._weights(F.col("o_custkey").cast("string"), F.col(ticker), orders, many=True)

    @cached_property
    def weights(self) -> DataFrame:
        """One portfolio per customer."""
        return kept(self.customer_weights())

    @staticmethod
    def book_id():
        return F.concat_ws("|", F.col("c_nationkey").cast("string"), F.col("c_mktsegment"))

    @cached_property
    def books(self) -> DataFrame:
        """One portfolio per customer nation and market segment."""
        return kept(self._weights(self.book_id(), F.col("ticker"), self.buyers))

    @cached_property
    def books_class(self) -> DataFrame:
        return kept(self._weights(self.book_id(), F.col("cls"), self.buyers))

    @cached_property
    def macro(self) -> DataFrame:
        """Hourly event averages as a daily series: hour h of 2024 is day h from 2000-01-01."""
        hour = F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")) * 24 + F.hour("ts")
        return self.table("events").select(
            lookup(F.col("event_type"), SERIES_OF_EVENT).alias("series_id"),
            F.date_add(F.lit("2000-01-01").cast("date"), hour).alias("date"), "value",
        ).groupBy("series_id", "date").agg(F.avg("value").alias("value"))

    @cached_property
    def users(self) -> DataFrame:
        """Questionnaire answers and financial facts per customer, by fixed arithmetic."""
        from ..operators import investors as inv

        k = F.col("c_custkey").cast("long")
        seg = {"AUTOMOBILE": "Very stable", "BUILDING": "Stable", "FURNITURE": "Moderate",
               "MACHINERY": "Unstable", "HOUSEHOLD": "Very unstable"}
        answers = [
            choose(list(table) + ["(no answer)"], F.floor(mod(k * (i + 3), (len(table) + 1) * 16) / 16)).alias(q)
            for i, (q, table) in enumerate(inv.ANSWER_SCORES.items())
        ]
        bal = F.col("c_acctbal")
        return self.table("customer").select(
            k.alias("user_id"), F.col("c_nationkey").cast("long").alias("nation_key"), "c_mktsegment", *answers,
            lookup(F.col("c_mktsegment"), seg).alias("income_stability"),
            (F.col("c_nationkey") / F.lit(3.0)).alias("emergency_fund_months"),
            (F.greatest(bal, F.lit(0.0)) * 10).alias("investable_amount"),
            F.when(mod(k, 50) == 0, 0.0).otherwise(F.lit(1000.0) + F.col("c_nationkey") * 100).alias("monthly_expenses"),
            (F.greatest(-bal, F.lit(0.0)) * 100 + mod(k, 7) * 20000).cast("double").alias("outstanding_debt"),
            (mod(k, 11) * 25000).cast("double").alias("annual_income"),
            (bal * 3000).alias("net_worth"),
            mod(k, 21).cast("int").alias("horizon_years"),
            choose(OBJECTIVE_NAMES, mod(F.col("c_nationkey"), 6)).alias("objective"),
            choose(GOALS, mod(k, 6)).alias("goal"),
            F.when(mod(k, 3) != 0, (mod(k * 7, 121) - 10).cast("double")).alias("slider"))

    @cached_property
    def cash_flows(self) -> DataFrame:
        """Each customer's orders as outflows and one later inflow; some accounts get none."""
        flow = self.table("orders").groupBy(
            F.col("o_custkey").cast("long").alias("account_id"), F.to_date("o_orderdate").alias("date")
        ).agg((-F.sum("o_totalprice")).alias("amount"))
        back = flow.groupBy("account_id").agg(F.sum("amount").alias("paid")).where(mod(F.col("account_id"), 13) != 0)
        back = back.select("account_id", F.lit("2003-01-01").cast("date").alias("date"),
                           (-F.col("paid") * (F.lit(0.5) + mod(F.col("account_id"), 10) * F.lit(0.15))).alias("amount"))
        return flow.unionByName(back)
