"""Fuzzy line deduplication: MinHash over character shingles, exact verification, union-find. Built-in functions only."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from panelweave.llm.common import Stages
from panelweave.llm.components import components

SPACE = r"[\x20\x09\x0B-\x0D]+"
NO_ID = (1 << 63) - 1
SKETCH = 64  # 64-bit words of a line's sketch
FEW = 16  # words of the sketch by which a line is compared with its head
SLOTS = (0, 5, 2, 7, 3, 6, 1, 4)
LOW = (1 << 59) - 1
LONG = 128  # bytes of a line that is likely to have hashes in every cell


def constants(n: int) -> list[int]:
    """``n`` fixed signed 64-bit numbers: steps of the golden ratio, mixed."""
    out = []
    for j in range(1, n + 1):
        x = j * 0x9E3779B97F4A7C15 % (1 << 64)
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 % (1 << 64)
        x = (x ^ x >> 27) * 0x94D049BB133111EB % (1 << 64)
        x ^= x >> 31
        out.append(signed(x))
    return out


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def cells(bands: int, rows: int) -> list[tuple[int, int, int]]:
    """(quarter, slot, layer) of every row of every band: the part of all hashes that a permutation looks at first.

    A permutation is the exclusive-or with a fixed number; the least hash is the one that shares most leading bits with
    that. A quarter's 2 bits lead, then a slot's 3, then those of the layer. The rows of a band are in different
    quarters, so they are as good as independent; those of one row are dealt over all.
    """
    at = [(b, r, b // 4 * rows + r) for b in range(bands) for r in range(rows)]
    return [((b + r) % 4, SLOTS[k % 8], k // 8) for b, r, k in at]


def numbers(bands: int, rows: int) -> list[int]:
    """The unsigned number of every row of every band."""
    layers = constants(bands * rows)
    return [q << 62 | x << 59 | layers[k] & LOW for q, x, k in cells(bands, rows)]


def single_spaced(text: Column) -> Column:
    odd = F.contains(text, F.lit("  "))
    for x in "\t\x0b\x0c\r":  # a search for a fixed text costs little beside the pattern
        odd = odd | F.contains(text, F.lit(x))
    return F.when(odd, F.regexp_replace(text, SPACE, " ")).otherwise(text)


def normal_lines(text: Column) -> Column:
    """Lower-case lines with single spaces; a line without words is empty."""
    lower = F.array(F.lower(F.coalesce(text, F.lit(""))))  # worked out once, as a value of the transform
    return F.transform(lower, lambda t: F.transform(F.split(t, "\n"), lambda x: F.trim(single_spaced(x))))[0]


def starts(wide: Column, size: int) -> Column:
    """Where the shingles start; shorter lines are one shingle. ``wide`` is the line in UTF-16, where a shingle is found without counting characters."""
    return F.sequence(F.lit(1), F.greatest(F.octet_length(wide).cast("int") - 2 * size + 1, F.lit(1)), F.lit(2))


def shingle(wide: Column, at: Column, size: int) -> Column:
    return F.xxhash64(F.substring(wide, at, F.lit(2 * size)))


def shingle_set(norm: Column, size: int) -> Column:
    # the outer transform hands the line to the inner one as a value that is not copied for each shingle
    return F.array_distinct(F.transform(F.array(F.encode(norm, "UTF-16BE")), lambda w: F.transform(starts(w, size), lambda i: shingle(w, i, size)))[0])


def hashed(lines: DataFrame, size: int) -> DataFrame:
    """(line, n, h) of each shingle."""
    wide = lines.select("line", "n", F.encode("norm", "UTF-16BE").alias("wide"))
    each = wide.select("line", "n", "wide", F.explode(starts(F.col("wide"), size)).alias("at"))
    return each.select("line", "n", shingle(F.col("wide"), F.col("at"), size).alias("h"))


def band_keys(bands: int, rows: int) -> Column:
    return F.array(*(F.xxhash64(F.lit(b), *(f"m{b * rows + r}" for r in range(rows))) for b in range(bands)))


def signatures(lines: DataFrame, stages: Stages, size: int, bands: int, rows: int) -> DataFrame:
    """(line, n, key) of every band of every line.

    One hash a shingle; its exclusive-or with fixed numbers gives the permutations, whose minima are kept by a grouped
    aggregation. Where a line has hashes in a permutation's cell the minimum is among them, so a hash is tried with
    the few permutations of its cell; lines with an empty cell try every hash with all. Both give the same minima.
    ``lines`` is partitioned by line already, so nothing is shuffled for it.
    """
    where, fixed = cells(bands, rows), numbers(bands, rows)
    layers = {k: c & LOW for (*_, k), c in zip(where, fixed, strict=True)}
    each = hashed(lines.where(F.octet_length("norm") >= LONG), size)
    each = each.select("line", "n", F.shiftrightunsigned("h", 62).alias("quarter"), F.shiftrightunsigned("h", 59).bitwiseAND(F.lit(7)).alias("slot"), F.col("h").bitwiseAND(F.lit(LOW)).alias("h"))
    tried = sorted({(q, k) for q, _, k in where})
    each = each.where(F.col("slot").isin(sorted({x for _, x, _ in where}))).groupBy("line", "n", "slot")
    each = each.agg(*(F.min(F.when(F.col("quarter") == q, F.col("h").bitwiseXOR(F.lit(layers[k])))).alias(f"q{q}_{k}") for q, k in tried))
    own = each.groupBy("line", "n").agg(*(F.max(F.when(F.col("slot") == x, F.col(f"q{q}_{k}"))).alias(f"m{j}") for j, (q, x, k) in enumerate(where)))
    own = own.dropna().select("line", "n", band_keys(bands, rows).alias("keys"))
    own = stages.table(own, "signatures")
    top = -(1 << 63)
    least = [F.min(F.col("h").bitwiseXOR(F.lit(signed(c) ^ top))).bitwiseXOR(F.lit(top)).alias(f"m{j}") for j, c in enumerate(fixed)]
    rest = hashed(lines.join(own.select("line"), "line", "left_anti"), size).groupBy("line", "n").agg(*least)
    return own.union(rest.select("line", "n", band_keys(bands, rows).alias("keys"))).select("line", "n", F.explode("keys").alias("key"))


def verified(pairs: DataFrame, size: int) -> DataFrame:
    """Pairs (a, b, a_norm, b_norm) as (a, b, j) with their exact Jaccard similarity ``j``."""
    both = pairs.select("a", "b", shingle_set(F.col("a_norm"), size).alias("x"), shingle_set(F.col("b_norm"), size).alias("y"))
    both = both.select("a", "b", F.size(F.array_intersect("x", "y")).alias("common"), F.size("x").alias("nx"), F.size("y").alias("ny"))
    return both.select("a", "b", (F.col("common") / (F.col("nx") + F.col("ny") - F.col("common"))).alias("j"))


def sketches(lines: DataFrame, size: int, words: int = SKETCH) -> DataFrame:
    """(line, most, spare, s0, s1, ...): the number of distinct shingles, a bitmap with one bit for each one's hash, and how many shingles more there are than bits."""
    each = lines.select("line", shingle_set(F.col("norm"), size).alias("all"))
    each = each.select("line", F.size("all").alias("most"), F.explode("all").alias("h"))
    word, bit = F.shiftrightunsigned("h", 6).bitwiseAND(F.lit(words - 1)).cast("int"), F.call_function("shiftleft", F.lit(1).cast("long"), F.col("h").bitwiseAND(F.lit(63)).cast("int"))
    each = each.select("line", "most", word.alias("word"), bit.alias("bit")).groupBy("line", "most", "word").agg(F.bit_or("bit").alias("bits"))
    # words become columns by eights, as a column costs time for every row
    eights = each.groupBy("line", "most", F.shiftrightunsigned("word", 3).alias("eight")).agg(*(F.bit_or(F.when(F.col("word").bitwiseAND(F.lit(7)) == k, F.col("bits"))).alias(f"e{k}") for k in range(8)))
    columns = [F.coalesce(F.bit_or(F.when(F.col("eight") == k // 8, F.col(f"e{k % 8}"))), F.lit(0).cast("long")).alias(f"s{k}") for k in range(words)]
    return eights.groupBy("line", "most").agg((F.col("most") - F.sum(bits([F.coalesce(f"e{k}", F.lit(0).cast("long")) for k in range(8)]))).cast("int").alias("spare"), *columns)


def bits(words: list[Column]) -> Column:
    total = F.bit_count(words[0])
    for w in words[1:]:
        total = total + F.bit_count(w)
    return total


def possible(a: str, b: str, least: float, words: int = SKETCH) -> Column:
    """Whether two sketched lines may be similar enough; never false where they are.

    A bit that only one of them has is a shingle that only that one has. So of either line's shingles no more are common
    than there are bits of both, and those that share a bit in the line.
    """
    m, n = F.col(f"{a}.most"), F.col(f"{b}.most")
    common = bits([F.col(f"{a}.s{k}").bitwiseAND(F.col(f"{b}.s{k}")) for k in range(words)]) + F.least(F.col(f"{a}.spare"), F.col(f"{b}.spare"))
    return (F.least(m, n) >= least * F.greatest(m, n)) & (common * (1 + least) >= least * (m + n) - 1e-6)


def line_links(lines: DataFrame, stages: Stages, size: int, bands: int, rows: int, least: float) -> DataFrame:
    """(a, b) links among lines that share a band, enough to connect all that are similar enough.

    In a bucket every line is compared with the most frequent one, its head. Lines that are not similar to it are
    compared with each other and with the other lines of that head, so no similar pair of a bucket goes
    unseen, yet a large group of near copies gives a star and not all its pairs. Joins hand on only the
    pairs that the lines' sketches leave possible; those are verified. Texts are read once for all lines that meet another.
    """
    first = F.first("line").over(W.partitionBy("key").orderBy(F.desc("n"), "line").rowsBetween(W.unboundedPreceding, 0))
    members = signatures(lines, stages, size, bands, rows).select("line", first.alias("head")).where("line <> head")
    members = stages.table(members.distinct(), "members")
    met = members.select("line").union(members.select("head")).distinct()
    near = stages.table(lines.select("line", "norm").join(met, "line", "left_semi"), "near")
    texts = near.repartition("line")  # shuffled once for the sketches and the join
    few = stages.table(sketches(texts, size, FEW).join(texts, "line"), "few")
    x, y = few.alias("x"), few.alias("y")
    stars = members.select(F.col("line").alias("a"), F.col("head").alias("b")).join(x, F.col("a") == F.col("x.line")).join(y, (F.col("b") == F.col("y.line")) & possible("x", "y", least, FEW))
    stars = stars.select("a", "b", F.col("x.norm").alias("a_norm"), F.col("y.norm").alias("b_norm"))
    stars = stages.table(verified(stars, size), "stars").where(F.col("j") >= least).select("a", "b")  # stored first: a filter pushed down would work the sets out again
    judged = members.join(stars.select(F.col("a").alias("line"), F.col("b").alias("head"), F.lit(True).alias("like")), ["line", "head"], "left").withColumn("like", F.col("like").isNotNull())
    unlike = judged.groupBy("head").agg(F.count(F.lit(1)).alias("n"), F.min("like").alias("like")).where("n > 1 AND NOT like").select("head")
    judged = stages.table(judged.join(unlike, "head"), "judged")
    sketch = sketches(near.join(judged.select("line").distinct(), "line", "left_semi").repartition("line"), size)
    judged = stages.table(judged.join(sketch, "line"), "sketches")
    x, y = judged.where("NOT like").alias("x"), judged.alias("y")
    other = (F.col("x.head") == F.col("y.head")) & (F.col("y.like") | (F.col("x.line") < F.col("y.line"))) & possible("x", "y", least)
    more = x.join(y, other).select(F.least("x.line", "y.line").alias("a"), F.greatest("x.line", "y.line").alias("b")).distinct()
    more = stages.table(more, "possible")
    more = more.join(near.select(F.col("line").alias("a"), F.col("norm").alias("a_norm")), "a").join(near.select(F.col("line").alias("b"), F.col("norm").alias("b_norm")), "b")
    return stars.union(stages.table(verified(more, size), "others").where(F.col("j") >= least).select("a", "b"))


def dedup_lines(docs: DataFrame, size: int = 9, bands: int = 8, rows: int = 3, least: float = 0.8,
                id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """One row per input row: (id, n_lines, n_removed, removed), and the text left as ``kept`` where asked for.

    Lines are compared in lower case with single spaces, by the Jaccard similarity of their ``size``-character
    shingles (UTF-16 units); shorter lines are one shingle. Lines within ``least`` are linked, and of every
    connected group only the first line stays: smallest id (null last), then earliest line. ``removed``
    holds the numbers of removed lines, from 0, joined by commas. Two lines at similarity s share one of the
    bands with probability 1 - (1 - s^rows)^bands: 0.997 at 0.8, 0.9999 at 0.9.

    Lines without words are neither counted nor removed. A null text has no lines; rows with one id and one
    text count as one document and get the same result; an empty table gives none; other columns play
    no part. A distinct line is known by a 64-bit hash.
    """
    spark = docs.sparkSession
    stages = Stages(spark)
    source = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("doc"), F.xxhash64(text_col).alias("tie"), F.col(text_col).alias("text"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    name, place = f"lines_{uuid.uuid4().hex}", stages.folder("lines")
    distinct = source.select(F.explode(normal_lines(F.col("text"))).alias("norm")).where("norm <> ''").withColumn("line", F.xxhash64("norm"))
    distinct = distinct.groupBy("line").agg(F.first("norm").alias("norm"), F.count(F.lit(1)).alias("n"))
    distinct.write.bucketBy(parts, "line").sortBy("line").option("path", place).option("compression", "zstd").saveAsTable(name)
    lines = spark.table(name)
    links = stages.table(line_links(lines, stages, size, bands, rows, least), "links")
    classes = stages.table(components(links, stages).select(F.col("node").alias("line"), "root"), "classes")
    # only lines that occur again, or belong to a group, can go
    again = lines.where("n > 1").select("line").join(classes, "line", "left").select("line", F.coalesce("root", "line").alias("root")).union(classes.select("line", "root")).distinct()
    again = stages.table(again, "again")
    # a document's lines by number, null without words
    numbered = stages.table(source.select("id", "doc", "tie", F.transform(normal_lines(F.col("text")), lambda x: F.when(x != "", F.xxhash64(x))).alias("lines")), "numbered")
    each = numbered.select("doc", "tie", F.posexplode("lines").alias("at", "line")).where("line IS NOT NULL")
    spots = stages.table(each.join(again, "line").select("root", "doc", "tie", "at"), "spots")
    first = spots.groupBy("root").agg(F.min(F.struct("doc", "tie", "at")).alias("first"))
    gone = spots.join(first, "root").where(F.struct("doc", "tie", "at") != F.col("first"))
    gone = stages.table(gone.groupBy("doc", "tie").agg(F.array_sort(F.collect_set("at")).alias("gone")), "gone")
    spark.sql(f"DROP TABLE {name}")
    if with_text:
        rows_ = source.select("id", "doc", "tie", F.size(F.filter(normal_lines(F.col("text")), lambda x: x != "")).cast("long").alias("n_lines"), F.split(F.coalesce("text", F.lit("")), "\n").alias("raw"))
    else:
        rows_ = numbered.select("id", "doc", "tie", F.size(F.array_compact("lines")).cast("long").alias("n_lines"))
    rows_ = rows_.join(gone, ["doc", "tie"], "left")
    gone_ = F.coalesce("gone", F.array().cast("array<int>"))
    out = [F.col("id").alias(id_col), "n_lines", F.size(gone_).cast("long").alias("n_removed"), F.array_join(gone_.cast("array<string>"), ",").alias("removed")]
    if with_text:
        stay = F.array_except(F.sequence(F.lit(0), F.size("raw") - 1), gone_)
        out.append(F.array_join(F.transform(stay, lambda i: F.get("raw", i)), "\n").alias("kept"))
    return rows_.select(*out)
