"""Landed files as tables: prices, provider payloads, macro series, filings."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.expr import col, finite

BAR_COLUMNS = ["open", "high", "low", "close", "adj_close", "volume"]
ALIASES = {"date": ["date"], "open": ["open"], "high": ["high"], "low": ["low"], "close": ["close", "close*", "last"],
           "adj_close": ["adj_close", "adj close", "adjclose"], "volume": ["volume"], "price": ["price"], "ticker": ["ticker", "symbol"]}


def _named(df: DataFrame) -> dict[str, Column]:
    """Canonical name -> column, header case and spelling ignored."""
    have = {c.strip().lower(): c for c in df.columns}
    return {k: F.col(f"`{have[a]}`") for k, names in ALIASES.items() for a in names if a in have}


def scan_price_files(spark: SparkSession, paths: list[str], start: str | None = None, end: str | None = None) -> DataFrame:
    """Per-symbol CSV files, one path per header layout, all read as text columns.

    The symbol comes from the file or folder name; the date range is a plain filter on the scan.
    """
    def one(path: str) -> DataFrame:
        df = spark.read.option("header", True).option("inferSchema", False).csv(path)
        n = _named(df)
        name = F.regexp_extract("_metadata.file_path", r"(?:symbol=([^/]+)/[^/]*|([^/]+)\.csv)$", 1)
        alone = F.regexp_extract("_metadata.file_path", r"([^/]+)\.csv$", 1)
        symbol = F.upper(F.url_decode(F.coalesce(F.nullif(name, F.lit("")), alone)))
        cols = [n.get(c, F.lit(None).cast("string")).cast("string").alias(c) for c in ["date", *BAR_COLUMNS, "price"]]
        out = df.select(F.coalesce(n.get("ticker", F.lit(None).cast("string")), symbol).alias("ticker"), *cols)
        day = F.col("date").try_cast("date")
        if start:
            out = out.where(day >= F.lit(start).cast("date"))
        return out.where(day <= F.lit(end).cast("date")) if end else out

    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [one(p) for p in paths])


def canonical_bars(raw: DataFrame) -> DataFrame:
    """Typed bars: unreadable dates dropped, unreadable numbers null, close from price, adjusted from close."""
    n = _named(raw)
    num = lambda c: finite(n[c].try_cast("double")) if c in n else F.lit(None).cast("double")
    keep = [c for c in raw.columns if c.lower() not in sum(ALIASES.values(), [])]
    ticker = [n["ticker"].alias("ticker")] if "ticker" in n else []
    out = raw.select(*keep, *ticker, n["date"].try_cast("date").alias("date"), *[num(c).alias(c) for c in BAR_COLUMNS], num("price").alias("_p"))
    out = out.withColumn("close", F.coalesce("close", "_p")).withColumn("adj_close", F.coalesce("adj_close", "close")).drop("_p")
    return out.where("date is not null").na.drop(how="all", subset=["open", "high", "low", "close", "adj_close"])


def price_column(df: DataFrame, order=("adj_close", "close", "price")) -> Column:
    """First present price column, row by row."""
    return F.coalesce(*[F.col(c) for c in order if c in df.columns])


RATE_LIMIT_PHRASES = "rate limit|too many|exceeded|throttled"


ERROR_WORDS = r"\berror\b"
TABLE_HEADER = r"(?i)^\s*\"?(date|ticker|symbol|timestamp)\"?\s*,"


def split_payloads(payloads: DataFrame, body: str = "body") -> tuple[DataFrame, DataFrame]:
    """(usable, quarantined) landed texts; a provider's error page is not data.

    The whole text decides: a text whose first line with content is the header of a table is data,
    whatever its columns are called; any other text is an error page if a word anywhere says so. Empty
    and missing texts are errors.
    """
    b = F.coalesce(col(body), F.lit(""))
    limited, failed = F.lower(b).rlike(RATE_LIMIT_PHRASES), F.lower(b).rlike(ERROR_WORDS)
    bad = (F.trim(b) == "") | (~b.rlike(TABLE_HEADER) & (limited | failed))
    return payloads.where(~bad), payloads.where(bad).withColumn("kind", F.when(limited, "rate_limit").otherwise("error"))


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("body"))


AGGREGATE_SCHEMA = "results array<struct<t bigint, o double, h double, l double, c double, v double>>"
DIVIDENDS = "cash_amount double, currency string, ex_dividend_date string, pay_date string, declaration_date string, record_date string, ticker string"
SPLITS = "execution_date string, split_from double, split_to double, ticker string"


def aggregate_bars(documents: DataFrame, body: str = "body") -> DataFrame:
    """Bars out of {results: [{t, o, h, l, c, v}]} documents; epoch milliseconds become dates."""
    r = documents.select("ticker", F.explode(F.from_json(body, AGGREGATE_SCHEMA)["results"]).alias("r"))
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(F.col("r.t") / 86400000).cast("int"))
    return r.select("ticker", day.alias("date"), F.col("r.o").alias("open"), F.col("r.h").alias("high"), F.col("r.l").alias("low"),
                    F.col("r.c").alias("close"), F.col("r.c").alias("adj_close"), F.col("r.v").alias("volume"))


def reference_rows(documents: DataFrame, schema: str, body: str = "body") -> DataFrame:
    """Dividends or splits; fields a document lacks are null."""
    return documents.select(F.explode(F.from_json(body, f"results array<struct<{schema}>>")["results"]).alias("r")).select("r.*")


def scan_macro_files(spark: SparkSession, paths: dict[str, str], start: str | None = None, end: str | None = None) -> DataFrame:
    """Series files with differing date and value headers as one (series_id, date, value) table."""
    def one(series: str, path: str) -> DataFrame:
        df = spark.read.option("header", True).option("inferSchema", False).csv(path)
        have = {c.lower(): c for c in df.columns}
        value = next(have[c] for c in (series.lower(), "value") if c in have)
        return df.select(F.lit(series).alias("series_id"), F.col(have["date"]).try_cast("date").alias("date"),
                         finite(F.col(value).try_cast("double")).alias("value"))

    out = reduce(lambda a, b: a.unionByName(b), [one(*p) for p in paths.items()]).where("date is not null")
    if start:
        out = out.where(F.col("date") >= F.lit(start).cast("date"))
    return out.where(F.col("date") <= F.lit(end).cast("date")) if end else out


def macro_wide(macro: DataFrame, series: list[str]) -> DataFrame:
    return macro.groupBy("date").pivot("series_id", series).agg(F.first("value"))


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """Paths below a folder, without reading any content."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path")


def filings_summary(listing: DataFrame, as_of: Column, lookback_days: int = 365) -> DataFrame:
    """Filings per symbol and form inside the look-back; the date is read off the file name.

    Paths look like .../<symbol>/<form>/<..._YYYY-MM-DD_...>.txt (or .html).
    """
    p = F.col("path")
    x = listing.where(p.rlike(r"\.(txt|html)$")).select(
        F.regexp_extract(p, r"([^/]+)/[^/]+/[^/]+$", 1).alias("symbol"),
        F.replace(F.regexp_extract(p, r"([^/]+)/[^/]+$", 1), F.lit("_"), F.lit("-")).alias("form"),
        F.regexp_extract(p, r"_(\d{4}-\d{2}-\d{2})(?:_|\.)[^/]*$", 1).try_cast("date").alias("date"))
    x = x.where(F.col("form").isin("10-K", "10-Q", "8-K") & (F.col("date") >= F.date_sub(as_of, lookback_days)))
    return x.groupBy("symbol", "form").agg(F.count("*").alias("filings"), F.max("date").alias("last_date"))
