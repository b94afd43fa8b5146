"""Quality rules of documents, with the frequency of lines across the documents of a host. Built-in functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelweave.llm.common import Stages, text_key, words_of

FREQUENT_ROWS = 1 << 20  # of a host and a hash
SPACE = r"[\x20\x09-\x0D]+"


def repeated_words(rows: DataFrame, words: str = "words") -> DataFrame:
    """``rows`` with ``n_repeat_words``: words inside 3-word windows that occur twice or more in the text.

    Windows are compared by 64-bit hashes. Texts without a repeated window, found by a hash set, are done;
    in the others the hashes are sorted with their places and neighbours compared, so the cost grows as
    n log n with the length of a text.
    """
    window = F.transform(words, lambda x, i: F.xxhash64(x, F.get(words, i + 1), F.get(words, i + 2)))
    rows = rows.withColumn("__h", F.when(F.size(words) >= 3, F.slice(window, 1, F.greatest(F.size(words) - 2, F.lit(0)))).otherwise(F.array().cast("array<bigint>")))
    sort = F.array_sort(F.transform("__h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    rows = rows.withColumn("__s", F.when(F.size(F.array_distinct("__h")) < F.size("__h"), sort))
    twice = F.filter("__s", lambda e, j: (e["h"] == F.get("__s", j - 1)["h"]) | (e["h"] == F.get("__s", j + 1)["h"]))
    rows = rows.withColumn("__at", F.array_sort(F.transform(twice, lambda e: e["i"])))
    new = F.transform("__at", lambda p, j: F.least(F.lit(3), F.coalesce(F.get("__at", j + 1), p + 3) - p))
    total = F.aggregate(new, F.lit(0).cast("long"), lambda a, x: a + x)
    return rows.withColumn("n_repeat_words", F.coalesce(total, F.lit(0).cast("long"))).drop("__h", "__s", "__at")


def base_rules(docs: DataFrame, text: Column) -> DataFrame:
    """``docs`` with the base figures and ``base_failed``."""
    rows = docs.withColumn("__text", F.coalesce(text, F.lit(""))).withColumn("words", words_of(F.col("__text")))
    rows = rows.withColumn("__lines", F.filter(F.split("__text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    rows = repeated_words(rows.select(
        "*", F.size("words").cast("long").alias("n_words"), F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        (F.length("__text") - F.length(F.regexp_replace("__text", r"[#*$%&|<>]", ""))).cast("long").alias("n_symbols"),
        (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long").alias("n_dup_lines")))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return rows.drop("words", "__text", "__lines").withColumn("base_failed", failed)


def normal(line: Column) -> Column:
    """A line in lower case with single spaces."""
    return F.trim(F.regexp_replace(F.lower(line), SPACE, " "))


def line_rows(docs: DataFrame) -> DataFrame:
    """(host, key, line, n, total): hash and words of every normalised line with a word, and the words of its text."""
    lines = F.filter(F.transform(F.split(F.lower(F.coalesce("text", F.lit(""))), "\n"), lambda x: F.trim(F.regexp_replace(x, SPACE, " "))), lambda x: x != "")
    size = lambda x: F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit(""))) + 1
    rows = docs.select("host", "key", lines.alias("lines")).withColumn("total", F.aggregate("lines", F.lit(0), lambda a, x: a + size(x)))
    rows = rows.select("host", "key", "total", F.explode("lines").alias("norm"))
    return rows.select("host", "key", F.xxhash64("norm").alias("line"), size(F.col("norm")).alias("n"), "total")


def frequent_lines(docs: DataFrame, stages: Stages, least: int, share: float) -> DataFrame:
    """(host, line) found in more documents of the host than max(least, share of the host's documents).

    Documents with equal texts count once, so that copies do not make a text's own lines look like
    furniture. Both counts combine before they are shuffled, whatever the size of a host.
    """
    each = line_rows(docs).groupBy("host", "line", "key").agg(F.lit(1)).groupBy("host", "line").agg(F.count(F.lit(1)).alias("docs"))
    each = stages.table(each.where(F.col("docs") > least), "candidate-lines")
    hosts = stages.table(docs.select("host", "key").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("all")), "hosts")
    return stages.table(each.join(hosts, "host").where(F.col("docs") > share * F.col("all")).select("host", "line"), "frequent-lines")


def lost_words(docs: DataFrame, stages: Stages, least: int, share: float, frequent: DataFrame | None = None) -> DataFrame:
    """(host, key, n_frequent_words, total, gone) of the texts that hold frequent lines; ``gone`` are the hashes of these."""
    frequent = frequent_lines(docs, stages, least, share) if frequent is None else frequent
    lost = line_rows(docs).join(frequent, ["host", "line"]).groupBy("host", "key").agg(F.sum("n").alias("n"), F.max("total").alias("total"), F.collect_set("line").alias("gone"))
    copies = docs.groupBy("host", "key").agg(F.count(F.lit(1)).alias("copies"))  # each copy has added the same words
    lost = lost.join(copies, ["host", "key"]).select("host", "key", (F.col("n") / F.col("copies")).cast("long").alias("n_frequent_words"), F.col("total").cast("long").alias("total"), "gone")
    return stages.table(lost, "lost-words")


def keyed(docs: DataFrame, text_col: str, host_col: str) -> DataFrame:
    """(mine, host, key, text): the input's columns as a struct, beside what the rules look at."""
    mine = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("mine")
    return docs.select(mine, F.coalesce(F.col(host_col), F.lit("")).alias("host"), text_key(F.col(text_col)).alias("key"), F.col(text_col).alias("text"))


def without_lines(text: Column, gone: Column) -> Column:
    """The text without the lines whose normalised form has a hash in ``gone``; the same text where that is null."""
    left = F.array_join(F.filter(F.split(text, "\n"), lambda x: ~F.array_contains(gone, F.xxhash64(normal(x)))), "\n")
    return F.when(gone.isNull(), text).otherwise(left)


def enough_left(words: Column, lost: Column, left_percent: int) -> Column:
    return 100 * (words - lost) >= left_percent * words


def quality_rules(docs: DataFrame, least: int = 20, share: float = 0.1, left_percent: int = 30,
                  id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", stages: Stages | None = None, with_text: bool = False) -> DataFrame:
    """One row per document: (id, base figures, base_failed, kept, n_frequent_words), and ``with_text`` the text left.

    A line is frequent if more than max(``least``, ``share`` of the host's documents) contain it. Frequent
    lines are removed; a document is depleted, and not kept, if less than ``left_percent`` of its words
    are left. Base rules that fail also reject it. A null text has no words and fails, a null host is
    the empty one, null and repeated ids keep a row each with the verdict of their own text, an empty
    table gives none; other columns play no part.
    """
    stages = stages or Stages(docs.sparkSession)
    rows = keyed(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(host_col).alias("host")), "text", "host")
    lost = lost_words(rows.select("host", "key", "text"), stages, least, share).drop("total", *([] if with_text else ["gone"]))
    rows = base_rules(rows.select(F.col("mine.id").alias(id_col), "host", "key", F.col("text").alias("raw")), F.col("raw"))
    rows = rows if with_text else rows.drop("raw")
    rows = rows.join(lost, ["host", "key"], "left").withColumn("n_frequent_words", F.coalesce("n_frequent_words", F.lit(0).cast("long")))
    kept = ~F.col("base_failed") & enough_left(F.col("n_words"), F.col("n_frequent_words"), left_percent)
    return rows.select(id_col, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "n_frequent_words", *([without_lines(F.col("raw"), F.col("gone")).alias(text_col)] if with_text else []))


def keep_documents(docs: DataFrame, least: int = 20, share: float = 0.1, left_percent: int = 30, text_col: str = "text", host_col: str = "source") -> DataFrame:
    """The rows, with all their columns, that ``quality_rules`` keeps, their texts without frequent lines.

    Texts are filtered where they are read, and not shuffled: the frequent lines of each host, found in so many
    texts each that they are few, are sent to them. Above FREQUENT_ROWS lines the texts are joined to the words they lose.
    """
    stages = Stages(docs.sparkSession)
    rows = keyed(docs, text_col, host_col)
    frequent = frequent_lines(rows.select("host", "key", "text"), stages, least, share)
    # the task's number holds the filter above the figures; below them it would work them out anew for each mention
    figures = base_rules(rows.select("mine", "host", "key"), F.col("mine").getField(text_col)).withColumn("task", F.spark_partition_id())
    passed = figures.where(~F.col("base_failed") & (F.col("task") >= 0)).select("mine", "host", "key")
    columns = lambda text: [text.alias(c) if c == text_col else F.col("mine").getField(c).alias(c) for c in docs.columns]
    text = F.col("mine").getField(text_col)
    if frequent.limit(FREQUENT_ROWS + 1).count() > FREQUENT_ROWS:
        lost = lost_words(rows.select("host", "key", "text"), stages, least, share, frequent)
        lines = lost.select("host", "key", "gone", enough_left(F.col("total"), F.col("n_frequent_words"), left_percent).alias("enough"))
        left = passed.join(lines, ["host", "key"], "left").where(F.coalesce("enough", F.lit(True)))
        return left.select(*columns(without_lines(text, F.col("gone"))))
    often = frequent.groupBy("host").agg(F.collect_set("line").alias("often"))
    size = lambda x: F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit(""))) + 1
    norms = F.transform(F.split(text, "\n"), lambda x: F.struct(x.alias("line"), normal(x).alias("norm")))
    lines = F.transform(norms, lambda p: F.struct(p["line"].alias("line"), F.when(p["norm"] == "", 0).otherwise(size(p["norm"])).alias("n"),
                                                  ((p["norm"] != "") & F.array_contains("often", F.xxhash64(p["norm"]))).alias("gone")))
    words = lambda kind: F.aggregate(F.filter("lines", kind), F.lit(0).cast("long"), lambda a, p: a + p["n"])
    left = passed.join(F.broadcast(often), "host", "left").select("mine", F.when(F.col("often").isNotNull(), lines).alias("lines"))
    left = left.select("mine", "lines", words(lambda p: p["n"] > 0).alias("total"), words(lambda p: p["gone"]).alias("lost"), F.spark_partition_id().alias("task"))
    left = left.where(F.coalesce(enough_left(F.col("total"), F.col("lost"), left_percent), F.lit(True)) & (F.col("task") >= 0))
    kept = F.array_join(F.transform(F.filter("lines", lambda p: ~p["gone"]), lambda p: p["line"]), "\n")
    return left.select(*columns(F.when(F.col("lost") > 0, kept).otherwise(text)))


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(source, '') AS host, coalesce(text, '') AS t, md5(coalesce(text, '')) AS k FROM documents),
w AS (SELECT rid, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
p AS (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 3),
g AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) AS c FROM p),
r AS (SELECT rid, count(DISTINCT i + o) AS n FROM g, (SELECT unnest([0, 1, 2]) AS o) WHERE c >= 2 GROUP BY rid),
l AS (SELECT rid, host, k, unnest(string_split(t, chr(10))) AS line FROM d),
dup AS (SELECT rid, count(*) - count(DISTINCT line) AS n FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY rid),
nl AS (SELECT rid, host, k, trim(regexp_replace(lower(line), '[\x20\x09-\x0D]+', ' ', 'g')) AS line FROM l),
lc AS (SELECT host, line, count(DISTINCT k) AS docs FROM nl WHERE line <> '' GROUP BY host, line),
h AS (SELECT host, count(DISTINCT k) AS n FROM d GROUP BY host),
f AS (SELECT lc.host, lc.line FROM lc JOIN h USING (host) WHERE lc.docs > 20 AND lc.docs > 0.1 * h.n),
lost AS (SELECT rid, sum(len(string_split(line, ' '))) AS n FROM nl JOIN f USING (host, line) GROUP BY rid),
b AS (SELECT d.rid, doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
 CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
 CAST(coalesce(dup.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words, CAST(coalesce(lost.n, 0) AS BIGINT) AS n_frequent_words
 FROM d JOIN w USING (rid) LEFT JOIN r USING (rid) LEFT JOIN dup USING (rid) LEFT JOIN lost USING (rid))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
 NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 100 * (n_words - n_frequent_words) >= 30 * n_words AS kept, n_frequent_words FROM b
"""
