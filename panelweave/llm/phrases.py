"""Phrase collocations: Misra-Gries summaries per hash partition find every frequent n-gram, a second pass counts exactly.

Words are runs of characters other than space and tab, lower-cased (A-Z); ``[.,;:!?]`` and line ends part the
pieces that no phrase crosses. A frequent phrase has frequent parts, so n-grams are summarised in three
passes, each over those whose shorter parts survived: words, pairs, longer ones (3 words and more share a pass
and a summary, over n-grams of surviving pairs). What survives is handed on
as a bitmap of fixed size; its false positives cost work, never results, as the last pass counts by the phrase itself.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from panelweave.llm.common import Stages, utf8

CHUNK, HELD = 4 << 20, 4 << 20  # bytes of text worked on at once; n-grams a task holds before it sends them on
PART_BYTES, MAX_BITS = 16 << 20, 29  # text a hash partition stands for; log2 of the bits of a bitmap at most (64 MB)
END = b"\xff"  # never in UTF-8: ends a piece
CLEAN = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ.,;:!?\n\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz" + END * 10)
STEP, MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


class Vocabulary:
    """Words of one language met by a task, as numbers with 64-bit hashes; number 0 ends a piece."""

    def __init__(self, lang: str):
        self.seed = xxhash.xxh32_intdigest(lang.encode())
        self.numbers: defaultdict[bytes, int] = defaultdict()
        self.numbers.default_factory = self.numbers.__len__
        self.numbers[END]
        self.hashes = np.zeros(1, np.uint64)

    def read(self, blob: bytes) -> tuple[list[bytes], np.ndarray]:
        words = blob.translate(CLEAN).replace(END, b" \xff ").split()
        ids = np.fromiter(map(self.numbers.__getitem__, words), np.int64, len(words))
        if len(self.numbers) > len(self.hashes):
            new = list(self.numbers)[len(self.hashes):]
            self.hashes = np.concatenate([self.hashes, np.array([xxhash.xxh64_intdigest(w, self.seed) for w in new], np.uint64)])
        return words, ids


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * MIX
    return h ^ (h >> np.uint64(29))


def chunks(part: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes]]:
    """(lang, texts): whole texts of a language together, about ``CHUNK`` bytes at a time; null languages are ``und``."""
    held: dict[str, list[bytes]] = defaultdict(list)
    sizes: dict[str, int] = defaultdict(int)
    for batch in part:
        for lang, text in zip(batch.column("lang").to_pylist(), utf8(batch.column("text")), strict=True):
            lang = "und" if lang is None else lang
            held[lang].append(text)
            sizes[lang] += len(text) + 1
            if sizes[lang] >= CHUNK:
                yield lang, END.join(held.pop(lang))
                sizes.pop(lang)
    for lang, found in held.items():
        yield lang, END.join(found)


def read(part: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, list[bytes], np.ndarray, np.ndarray]]:
    """(lang, words, numbers, word hashes) of each chunk."""
    known: dict[str, Vocabulary] = {}
    for lang, blob in chunks(part):
        v = known.get(lang)
        if v is None or len(v.numbers) > 1 << 20:
            v = known[lang] = Vocabulary(lang)
        words, ids = v.read(blob)
        yield lang, words, ids, v.hashes


def marked(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    at = h >> np.uint64(64 - (len(bits).bit_length() + 2))
    return (bits[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def grams(ids: np.ndarray, hashes: np.ndarray, longest: int, maps: dict[int, np.ndarray]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, positions, hashes) of the n-grams within pieces whose shorter parts all pass the bitmaps so far."""
    word = mixed(hashes)
    good = np.ones(len(hashes), bool) if 1 not in maps else marked(maps[1], word)
    good[0] = False
    h, at = hashes[ids], np.flatnonzero(good[ids])
    yield 1, at, word[ids[at]]
    run = h[at]
    ok = good[ids]
    for k in range(2, longest + 1):
        # parts: the n-gram so far has passed, its last k - 1 words have to
        stays = at < len(ids) - k + 1
        at, run = at[stays], run[stays]
        passes = ok[at + 1]
        at, run = at[passes], run[passes]
        run = run * STEP + h[at + k - 1]
        gram = mixed(run)
        yield k, at, gram
        if 2 not in maps:
            return
        if min(k, 3) in maps:
            passed = marked(maps[min(k, 3)], gram)
            at, run = at[passed], run[passed]
        ok = np.zeros(len(ids), bool)
        ok[at] = True


def combined(h: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes in order, with their summed counts."""
    if not len(h):
        return h, n
    order = np.argsort(h, kind="stable")
    h, n = h[order], n[order]
    starts = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
    return h[starts], np.add.reduceat(n, starts)


SUMMARY = pa.schema([("part", pa.int32()), ("data", pa.int32()), ("mass", pa.int64()), ("hashes", pa.binary()), ("counts", pa.binary())])


def local_counts(level: int, longest: int, log_parts: int, shared) -> object:
    """Task: the n-grams of a level in its texts, combined; a row with the mass, and a row of hashes and counts, for each hash partition."""

    def sent(h: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        part = (h >> np.uint64(64 - log_parts)).astype(np.int32)
        starts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
        rows = []
        for a, b in zip(starts, [*starts[1:], len(h)], strict=True):
            rows.append((int(part[a]), 0, int(n[a:b].sum()), b"", b""))
            rows.append((int(part[a]), 1, 0, h[a:b].tobytes(), n[a:b].tobytes()))
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), SUMMARY.types, strict=True)], schema=SUMMARY)

    def task(part: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maps = {k: np.frombuffer(b, np.uint8) for k, b in shared.value.items()}
        found: list[tuple[np.ndarray, np.ndarray]] = []
        held = 0
        for _, _, ids, hashes in read(part):
            if level == 1:
                n = np.bincount(ids, minlength=len(hashes))
                seen = np.flatnonzero(n[1:]) + 1
                new = [combined(mixed(hashes[seen]), n[seen])]
            else:
                new = []
                for k, _, h in grams(ids, hashes, longest, maps):
                    if min(k, 3) == level and len(h):
                        h = np.sort(h)
                        starts = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
                        new.append((h[starts], np.diff(np.append(starts, len(h)))))
            found += [x for x in new if len(x[0])]
            held += sum(len(x[0]) for x in new)
            if held > HELD:
                whole = combined(np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found]))
                found, held = [whole], len(whole[0])
                if held > HELD // 2:
                    yield sent(*whole)
                    found, held = [], 0
        if found:
            yield sent(*combined(np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found])))

    return task


class MisraGries:
    """Weighted summary: counts fall short by ``short`` at most, which stays below mass / (capacity + 1)."""

    def __init__(self, capacity: int):
        self.capacity, self.short = capacity, 0
        self.h, self.n = np.empty(0, np.uint64), np.empty(0, np.int64)

    def merge(self, h: np.ndarray, n: np.ndarray) -> None:
        self.h, self.n = combined(np.concatenate([self.h, h]), np.concatenate([self.n, n]))
        over = len(self.n) - self.capacity
        if over > 0:
            cut = np.partition(self.n, over - 1)[over - 1]  # largest count without a place
            stay = self.n > cut
            self.h, self.n, self.short = self.h[stay], self.n[stay] - cut, self.short + int(cut)

    def possible(self, least: int) -> np.ndarray:
        """Every hash counted ``least`` times or more is among these if mass / least < capacity + 1."""
        return self.h[self.n + self.short >= least]


def summaries(least: int, log_parts: int, log_bits: int) -> object:
    """Task: hash partitions one after the other; masses come first and give the capacity. Gives each one's slice of the bitmap."""
    schema = pa.schema([("part", pa.int32()), ("bits", pa.binary())])

    def closed(part: int, s: MisraGries, held: list) -> pa.RecordBatch:
        if held:
            s.merge(np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held]))
        at = (s.possible(least) >> np.uint64(64 - log_bits)) - np.uint64(part << (log_bits - log_parts))
        bits = np.zeros(1 << (log_bits - log_parts), np.uint8)
        bits[at.astype(np.int64)] = 1
        return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())], schema=schema)

    def task(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, mass, summary, held, size = None, 0, None, [], 0
        for batch in rows:
            for part, data, more, hashes, counts in zip(*(batch.column(c) for c in SUMMARY.names), strict=True):
                part = part.as_py()
                if part != now:
                    if now is not None:
                        yield closed(now, summary or MisraGries(1), held)
                    now, mass, summary, held, size = part, 0, None, [], 0
                if not data.as_py():
                    mass += more.as_py()
                    continue
                summary = summary or MisraGries(mass // least + 1)
                held.append((np.frombuffer(hashes.as_buffer(), np.uint64), np.frombuffer(counts.as_buffer(), np.int64)))
                size += len(held[-1][0])
                if size > max(1 << 20, summary.capacity):
                    summary.merge(np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held]))
                    held, size = [], 0
        if now is not None:
            yield closed(now, summary or MisraGries(1), held)

    return task


def exact_counts(longest: int, log_parts: int, shared) -> object:
    """Task: (hash partition, lang, phrases, counts) of the n-grams that pass all bitmaps, combined; the empty phrase carries the words of a language."""
    schema = pa.schema([("part", pa.int32()), ("lang", pa.string()), ("phrases", pa.list_(pa.binary())), ("counts", pa.list_(pa.int64()))])

    def sent(totals: dict[str, dict[bytes, int]]) -> Iterator[pa.RecordBatch]:
        for lang, found in totals.items():
            by: dict[int, tuple[list[bytes], list[int]]] = defaultdict(lambda: ([], []))
            for phrase, n in found.items():
                row = by[xxhash.xxh64_intdigest(phrase) >> (64 - log_parts)]
                row[0].append(phrase)
                row[1].append(n)
            columns = [list(by), [lang] * len(by), [r[0] for r in by.values()], [r[1] for r in by.values()]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types, strict=True)], schema=schema)

    def task(part: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        maps = {k: np.frombuffer(b, np.uint8) for k, b in shared.value.items()}
        totals: dict[str, dict[bytes, int]] = {}
        for lang, words, ids, hashes in read(part):
            found = totals.setdefault(lang, defaultdict(int))
            found[b""] += int(np.count_nonzero(ids))
            for k, at, h in grams(ids, hashes, longest, maps):
                if k > 1:
                    passed = marked(maps[min(k, 3)], h)
                    at, h = at[passed], h[passed]
                _, first, n = np.unique(h, return_index=True, return_counts=True)
                for i, more in zip(at[first].tolist(), n.tolist(), strict=True):
                    found[b" ".join(words[i:i + k])] += more
            if sum(map(len, totals.values())) > HELD // 4:
                yield from sent(totals)
                totals = {}
        yield from sent(totals)

    return task


def summed(least: int) -> object:
    """Task: (lang, phrase, a) of a sorted partition, those counted ``least`` times or more and the words of a language."""
    schema = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("a", pa.int64())])

    def merged(held: list[pa.Table]) -> pa.Table:
        return pa.concat_tables(held).group_by("phrase").aggregate([("a", "sum")]).rename_columns(["phrase", "a"])

    def closed(lang: str, held: list[pa.Table]) -> list[pa.RecordBatch]:
        t = merged(held)
        t = t.filter(pc.or_(pc.greater_equal(t["a"], least), pc.equal(t["phrase"], b"")))
        return pa.table([pa.array([lang] * len(t), pa.string()), t["phrase"].cast(pa.string()), t["a"]], schema=schema).to_batches()

    def task(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, size = None, [], 0
        for batch in rows:
            for part, lang, phrases, counts in zip(batch.column("part").to_pylist(), batch.column("lang").to_pylist(), batch.column("phrases"), batch.column("counts"), strict=True):
                if (part, lang) != now:
                    if now is not None:
                        yield from closed(now[1], held)
                    now, held, size = (part, lang), [], 0
                held.append(pa.table({"phrase": phrases.values, "a": counts.values}))
                size += len(counts)
                if size > HELD // 4:
                    held = [merged(held)]
                    size = len(held[0]) // 2
        if now is not None:
            yield from closed(now[1], held)

    return task


def frequent_phrases(docs: DataFrame, least: int, longest: int, stages: Stages) -> DataFrame:
    """(lang, length, phrase, a): every phrase of up to ``longest`` words found ``least`` times or more in a language, with its exact count; length 0: all words of the language.

    Memory of a task: a chunk of text, ``HELD`` n-grams, or one summary, whose number follows the size of the
    table so that each stands for about ``PART_BYTES`` of text. Sent to all tasks: three bitmaps of at most 64 MB
    each, whatever the size of the table. Equal n-grams of a task meet before the shuffle.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    log_parts = min(20, max(4, (size // PART_BYTES).bit_length()))
    log_bits = min(MAX_BITS, max(log_parts + 3, 16, (size // least * 4).bit_length()))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    maps: dict[int, bytes] = {}
    for level in range(1, min(3, longest) + 1):
        shared = spark.sparkContext.broadcast(dict(maps))
        sent = docs.mapInArrow(local_counts(level, longest, log_parts, shared), "part int, data int, mass long, hashes binary, counts binary")
        slices = sent.repartition(parts, "part").sortWithinPartitions("part", "data").mapInArrow(summaries(least, log_parts, log_bits), "part int, bits binary")
        whole = np.zeros((1 << log_parts, 1 << (log_bits - log_parts - 3)), np.uint8)
        for r in slices.toLocalIterator():  # the bitmap: fixed size
            whole[r.part] = np.frombuffer(r.bits, np.uint8)
        maps[level] = whole.tobytes()
        shared.unpersist()
    counts = docs.mapInArrow(exact_counts(longest, log_parts, spark.sparkContext.broadcast(maps)), "part int, lang string, phrases array<binary>, counts array<long>")
    sums = counts.repartition(parts, "part").sortWithinPartitions("part", "lang").mapInArrow(summed(least), "lang string, phrase string, a long")
    length = F.when(F.col("phrase") == "", 0).otherwise(F.size(F.split("phrase", " ")))
    return stages.table(sums.select("lang", length.alias("length"), "phrase", "a"), "phrases")


def collocations(docs: DataFrame, least: int = 100, longest: int = 5, top: int = 2000) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the first ``top`` phrases of each language by their weakest cut.

    A cut after k words compares the phrase with the product of its halves: floor(1000 * a * n / (l * r)), in
    38-digit decimals; the least cut counts, then the smallest k. A phrase inside a longer frequent one of the
    same count goes: as counts never grow with length, one of just one more word decides. Null texts are empty,
    null languages ``und``; languages without a frequent phrase, and an empty table, give no rows.
    """
    stages = Stages(docs.sparkSession)
    found = frequent_phrases(docs, least, longest, stages)
    phrases = found.where("length > 0").select("lang", "phrase", "a")
    totals = found.where("length = 0").select("lang", F.col("a").alias("n"))
    longer = found.where("length > 2").withColumn("w", F.split("phrase", " "))
    within = longer.select("lang", F.explode(F.array(F.array_join(F.slice("w", 1, F.col("length") - 1), " "), F.array_join(F.slice("w", 2, F.col("length") - 1), " "))).alias("phrase"), "a")
    open_ = found.where("length > 1").join(within, ["lang", "phrase", "a"], "left_anti").withColumn("w", F.split("phrase", " "))
    cuts = open_.select("lang", "phrase", "a", F.explode(F.sequence(F.lit(1), F.col("length") - 1)).alias("k"), "w", "length")
    cuts = cuts.select("lang", "phrase", "a", "k", F.array_join(F.slice("w", F.lit(1), F.col("k")), " ").alias("head"), F.array_join(F.slice("w", F.col("k") + 1, F.col("length") - F.col("k")), " ").alias("rest"))
    cuts = (cuts.join(phrases.select("lang", F.col("phrase").alias("head"), F.col("a").alias("l")), ["lang", "head"])
            .join(phrases.select("lang", F.col("phrase").alias("rest"), F.col("a").alias("r")), ["lang", "rest"]).join(totals, "lang"))
    big = lambda c: f"CAST({c} AS DECIMAL(18, 0))"
    score = F.expr(f"(CAST(1000 AS DECIMAL(4, 0)) * ({big('a')} * {big('n')})) div ({big('l')} * {big('r')})")
    best = cuts.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))
    order = Window.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("a"), "phrase")
    ranked = best.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)
    return ranked.select("lang", "rank", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")


SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
words AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
starts AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM words),
grams AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM starts, range(1, 6) t(k) WHERE i + k - 1 <= len(w)),
f AS (SELECT lang, phrase, k AS words, count(*) AS a FROM grams GROUP BY ALL HAVING count(*) >= 100),
totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM words GROUP BY lang),
kept AS (
  SELECT * FROM f c WHERE words > 1 AND NOT EXISTS (
    SELECT 1 FROM f o WHERE o.lang = c.lang AND o.a = c.a AND o.words > c.words AND contains(' ' || o.phrase || ' ', ' ' || c.phrase || ' '))),
cuts AS (
  SELECT lang, phrase, a, k, array_to_string(string_split(phrase, ' ')[:k], ' ') AS head, array_to_string(string_split(phrase, ' ')[k + 1:], ' ') AS rest
  FROM kept, range(1, 5) t(k) WHERE k < words),
scored AS (
  SELECT c.lang, c.phrase, c.a, l.a AS l, r.a AS r, n, (1000::HUGEINT * c.a * n // (l.a::HUGEINT * r.a))::BIGINT AS score
  FROM cuts c JOIN f l ON l.lang = c.lang AND l.phrase = head JOIN f r ON r.lang = c.lang AND r.phrase = rest JOIN totals t ON t.lang = c.lang
  QUALIFY row_number() OVER (PARTITION BY c.lang, c.phrase ORDER BY (1000::HUGEINT * c.a * n // (l.a::HUGEINT * r.a)), k) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM scored
QUALIFY rank <= 2000
"""
