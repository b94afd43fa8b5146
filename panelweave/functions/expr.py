"""Column expressions shared by the operators."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

TRADING_DAYS = 252
INF = float("inf")


def keys_of(key) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def div(a, b) -> Column:
    """Division that yields null on a zero divisor, also under ANSI mode."""
    return F.try_divide(col(a), col(b))


def finite(c) -> Column:
    """NaN and infinities become null: the engine knows one kind of missing."""
    c = col(c)
    return F.when(~F.isnan(c) & (F.abs(c) < F.lit(INF)), c)


def clamp(c, lo, hi) -> Column:
    c = col(c)
    return F.when(c.isNotNull(), F.greatest(F.lit(lo), F.least(F.lit(hi), c)))


def rounded(c, digits: int) -> Column:
    """A double rounded half away from zero after scaling, as SQL engines round doubles: 60.95, held as a little less,
    gives 61.0. Spark's own ``round`` goes by the shortest decimal of the double, so 60.949999999999996 gives 60.9."""
    scale = F.lit(10.0 ** digits)
    return F.round(col(c).cast("double") * scale) / scale


def lerp(a: float, b: float, t: Column) -> Column:
    return F.lit(a) + F.lit(b - a) * t


def mod(c: Column, n: int) -> Column:
    """Remainder of a long by a constant, kept as a long."""
    return F.pmod(c.cast("long"), F.lit(n).cast("long"))


def lookup(c: Column, table: dict, default=None) -> Column:
    """Fixed small mapping as a literal map (constant-folded, no join)."""
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), c), F.lit(default))


def choose(options: list, position: Column) -> Column:
    """Element of a literal list by 0-based position, null outside it."""
    return F.get(F.array(*[F.lit(o) for o in options]), position.cast("int"))


def weekdays_through(d: Column) -> Column:
    """Weekdays from Monday 1970-01-05 through ``d``, in closed form."""
    days = F.datediff(d, F.lit("1970-01-05").cast("date"))
    weeks = F.floor(days / F.lit(7))
    return weeks * 5 + F.least(days - weeks * 7 + 1, F.lit(5))


def weekday_count(start: Column, end: Column) -> Column:
    """Weekdays in [start, end], the expected length of a business-day index."""
    return weekdays_through(end) - weekdays_through(F.date_sub(start, 1))


def years_between(start: Column, end: Column) -> Column:
    return F.datediff(end, start) / F.lit(365.25)


def running(key) -> "W":
    return W.partitionBy(*keys_of(key)).orderBy("date").rowsBetween(W.unboundedPreceding, 0)


def scatter(a: Column, b: Column, seed: int = 42) -> Column:
    """Repeatable, well mixed integer in [0, 2^32) from two longs.

    A public 32-bit finaliser (xor-shift and multiply) in plain 64-bit arithmetic, so any engine
    reproduces the same draw from (seed, a, b); the library's own hash functions would not.
    """
    m = F.lit(4294967296)
    x = F.pmod(a.cast("long") * F.lit(2654435761) + b.cast("long") * F.lit(2246822519) + F.lit(seed), m)
    for shift, factor in ((16, 569420461), (15, 1935289751)):
        x = F.pmod(x.bitwiseXOR(F.shiftright(x, shift)) * F.lit(factor), m)
    return x.bitwiseXOR(F.shiftright(x, 15))


def draw(a: Column, b: Column, n: Column, seed: int = 42) -> Column:
    """0-based draw from n items."""
    return F.pmod(scatter(a, b, seed), n.cast("long"))


def pct(c: Column, digits: int = 1) -> Column:
    return F.format_string(f"%.{digits}f%%", c * 100)


def ordinals(df: DataFrame, name: str, out: str = "ord") -> DataFrame:
    """Rank of the distinct values of a dimension column (catalog sized, never fact sized)."""
    return df.select(name).distinct().withColumn(out, F.row_number().over(W.orderBy(name)).cast("long"))


ROWS_A_TASK = 150_000


def dealt(df: DataFrame, rows: int, *key) -> DataFrame:
    """``df`` by hash of the key in as many partitions as give a task about ROWS_A_TASK of ``rows`` rows.

    A task's memory then stays the same whatever the size of the table; partitions merged by their compressed
    size hold ten times the rows where these compress well.
    """
    return df.repartition(max(1, -(-rows // ROWS_A_TASK)), *key)


def literal_table(spark: SparkSession, rows: list[tuple], names: str) -> DataFrame:
    """Small configuration table as literals: Spark knows its size, so joins to it broadcast by themselves."""
    cols = names.split()
    return spark.range(1).select(F.inline(F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(cols, r)]) for r in rows])))
