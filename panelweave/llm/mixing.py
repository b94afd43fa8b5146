"""Mixing of sources to target weights by Poisson replication. Built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelweave.llm.common import Stages

WHOLE = 1 << 52  # steps of the uniform numbers
MOST_MEAN = 500  # beyond it a count is the sum of several draws, as exp(-mean) would vanish
BROADCAST_SOURCES = 100_000


def hashed(*parts: Column) -> Column:
    """Whole number below 2^52 from the md5 of the parts, the same in any engine."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts).cast("binary")), 1, 13), 16, 10).cast("long")


def poisson(u: Column, mean: Column) -> Column:
    """Smallest n whose cumulative probability is not below u."""
    most = F.ceil(mean + 12 * F.sqrt(mean) + 30).cast("int")
    step = lambda s, k: F.when(s["c"] < u, F.struct((s["p"] * mean / k).alias("p"), (s["c"] + s["p"] * mean / k).alias("c"), (s["n"] + 1).alias("n"))).otherwise(s)
    start = F.struct(F.exp(-mean).alias("p"), F.exp(-mean).alias("c"), F.lit(0).alias("n"))
    return F.aggregate(F.sequence(F.lit(1), most), start, step, lambda s: s["n"])


def repetition_rates(docs: DataFrame, weights: dict[str, float] | None, exponent: float, factor: float, source_col: str, text_col: str) -> DataFrame:
    """(source, rate): mean repetitions that give each source its target share of ``factor`` times all bytes.

    A document's size is its UTF-8 bytes plus one. Targets are ``weights`` over their sum (sources not named
    get none), or in proportion to size ** ``exponent``.
    """
    sizes = docs.groupBy(F.coalesce(F.col(source_col), F.lit("")).alias("source")).agg(F.sum(F.coalesce(F.octet_length(text_col), F.lit(0)) + 1).alias("size"))
    if weights is None:
        target = F.pow(F.col("size").cast("double"), F.lit(exponent))
    else:
        named = F.create_map(*(F.lit(x) for kv in weights.items() for x in kv)) if weights else F.create_map()
        target = F.coalesce(named[F.col("source")].cast("double"), F.lit(0.0)) if weights else F.lit(0.0)
    rows = sizes.withColumn("target", target)
    whole = rows.agg(F.struct(F.sum("target").alias("targets"), F.sum("size").alias("all")).alias("whole")).scalar()  # one row
    rows = rows.withColumn("whole", whole)
    rate = F.when(F.col("whole.targets") > 0, factor * F.col("whole.all") * F.col("target") / F.col("whole.targets") / F.col("size")).otherwise(F.lit(0.0))
    return rows.select("source", rate.alias("rate"))


def mix_sources(docs: DataFrame, weights: dict[str, float] | None = None, exponent: float = 0.5, factor: float = 1.0, seed: int = 17,
                id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", stages: Stages | None = None) -> DataFrame:
    """The input's columns in struct ``doc``, ``copy`` (from 1) and ``order_key``, in a global random order.

    A document appears Poisson(rate of its source) times: the count inverts the distribution at a uniform
    number hashed from seed and id, so any run, task or retry gives the same rows. Copies are sorted by a
    hash of seed, id and copy, by ranges. The rates, one row a source, are broadcast up to
    BROADCAST_SOURCES of them and joined by the planner beyond.

    A null source is the empty one, a null text has size one, null ids share one uniform number, repeated rows
    are drawn alike and each replicated; an empty table gives none. Input columns may have any names.
    """
    stages = stages or Stages(docs.sparkSession)
    rates = stages.table(repetition_rates(docs, weights, exponent, factor, source_col, text_col), "rates")
    few = rates.count() <= BROADCAST_SOURCES
    ident = F.coalesce(F.col(id_col).cast("string"), F.lit("null"))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"), ident.alias("ident"), F.coalesce(F.col(source_col), F.lit("")).alias("source"))
    rows = rows.join(F.broadcast(rates) if few else rates, "source")
    parts = F.greatest(F.ceil(F.col("rate") / MOST_MEAN), F.lit(1)).cast("int")
    uniform = lambda j: (hashed(F.lit(str(seed)), j.cast("string"), F.col("ident")) + 0.5) / WHOLE
    draws = F.transform(F.sequence(F.lit(1), parts), lambda j: poisson(uniform(j), F.col("rate") / parts))
    rows = rows.withColumn("copies", F.aggregate(draws, F.lit(0), lambda a, x: a + x)).where("copies > 0")
    rows = rows.select("doc", "ident", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"))
    rows = rows.withColumn("order_key", hashed(F.lit(str(seed)), F.lit("order"), F.col("copy").cast("string"), F.col("ident")))
    return rows.select("doc", "copy", "order_key").orderBy("order_key", "copy")


SQL = """
WITH d AS (SELECT doc_id, coalesce(source, '') AS s, source, coalesce(CAST(doc_id AS VARCHAR), 'null') AS ident, coalesce(strlen(text), 0) + 1 AS n FROM documents),
z AS (SELECT s, sum(n) AS size FROM d GROUP BY s),
m AS (SELECT s, (SELECT sum(size) FROM z) * sqrt(size) / (SELECT sum(sqrt(size)) FROM z) / size AS rate FROM z),
c AS (SELECT s, k, sum(exp(-rate + k * ln(rate) - lgamma(k + 1))) OVER (PARTITION BY s ORDER BY k) AS cum FROM m, (SELECT unnest(range(0, 400)) AS k) WHERE k < rate + 12 * sqrt(rate) + 30),
a AS (SELECT s, list(cum ORDER BY k) AS cums FROM c GROUP BY s),
n AS (SELECT doc_id, source, ident, len(list_filter(cums, lambda x: x < (CAST('0x' || substr(md5('17:1:' || ident), 1, 13) AS BIGINT) + 0.5) / 4503599627370496)) AS copies FROM d JOIN a USING (s)),
e AS (SELECT doc_id, source, ident, unnest(range(1, copies + 1)) AS copy FROM n)
SELECT doc_id, source, CAST(copy AS INTEGER) AS copy, CAST('0x' || substr(md5('17:order:' || copy || ':' || ident), 1, 13) AS BIGINT) AS order_key FROM e
"""
