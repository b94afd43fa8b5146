"""Benchmark decontamination by templates: re-parameterised questions match too."""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelweave.llm.common import Stages, slices, texts
from panelweave.llm.pretokens import Memo

TOKEN = re.compile(r"[^\W\d_]+|\d+(?:[.,]\d+)*|[.!?\n]")
UNITS = ("mm", "cm", "m", "km", "inch", "inches", "foot", "feet", "yard", "yards", "mile", "miles", "mg", "g", "kg", "gram", "grams", "ton", "tons", "tonne", "tonnes", "ounce", "ounces", "pound", "pounds",
         "ml", "cl", "l", "liter", "liters", "litre", "litres", "gallon", "gallons", "ms", "s", "sec", "second", "seconds", "min", "minute", "minutes", "h", "hour", "hours", "day", "days", "week", "weeks",
         "month", "months", "year", "years", "cent", "cents", "dollar", "dollars", "euro", "euros", "percent", "mph", "kmh", "degree", "degrees", "watt", "watts", "volt", "volts")
NUMBERS = ("zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve", "thirteen", "fourteen", "fifteen", "sixteen", "seventeen", "eighteen", "nineteen",
           "twenty", "thirty", "forty", "fifty", "sixty", "seventy", "eighty", "ninety", "hundred", "thousand", "million", "billion")
UNIT_SET, NUMBER_SET = frozenset(UNITS), frozenset(NUMBERS)
WORD, CAPITAL, NUMBER, UNIT, MARK = range(5)
SLOTS = {NUMBER: 0x9E3779B97F4A7C15, CAPITAL: 0xC2B2AE3D27D4EB4F, UNIT: 0x165667B19E3779F9}
BROADCAST_WINDOWS = 4_000_000


def token_code(token: str) -> int:
    """Hash of the lower-case token with its kind in the lowest three bits."""
    low = token.lower()
    kind = MARK if not token[0].isalnum() else NUMBER if token[0].isnumeric() or low in NUMBER_SET else UNIT if low in UNIT_SET else CAPITAL if token[0].isupper() else WORD
    return xxhash.xxh64_intdigest(low.encode()) & ~7 | kind


class Template:
    """Tokens of a text with their typed placeholders.

    A number is a slot; so is a unit word right after a number, and a capitalised word (a name) that does
    not open a sentence. Every other token is itself, in lower case. ``code`` holds the placeholder's or
    token's hash, ``slot`` tells slots, ``own`` is the hash of the token itself.
    """

    def __init__(self, text: str, codes: Memo):
        tokens = TOKEN.findall(text)
        code = np.fromiter(map(codes.__getitem__, tokens), np.uint64, len(tokens))
        kind = (code & np.uint64(7)).astype(np.int8)
        before = np.concatenate([[MARK], kind[:-1]]) if len(kind) else kind
        words = kind != MARK
        self.tokens, self.words = tokens, np.flatnonzero(words)
        self.own = code[words] & ~np.uint64(7)
        kind, before = kind[words], before[words]
        self.slot = (kind == NUMBER) | ((kind == UNIT) & (before == NUMBER)) | ((kind == CAPITAL) & (before != MARK))
        self.code = self.own.copy()
        for k, value in SLOTS.items():
            self.code[self.slot & (kind == k)] = np.uint64(value)

    def __len__(self) -> int:
        return len(self.words)

    def windows(self, size: int, literal: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Hash of the window from each token, and whether at least half its tokens are no slots."""
        n = len(self) - size + 1
        if n <= 0:
            return np.empty(0, np.uint64), np.empty(0, bool)
        code, h = self.own if literal else self.code, np.full(n, size + literal * 1000, np.uint64)
        for j in range(size):
            h = (h ^ code[j:j + n]) * np.uint64(0xD6E8FEB86659FD93)
            h ^= h >> np.uint64(32)
        slots = np.concatenate([[0], np.cumsum(self.slot)])
        return h, np.ones(n, bool) if literal else 2 * (slots[size:] - slots[:-size]) <= size

    def slot_values(self, start: int, size: int) -> list[str]:
        """Lower-case tokens in the window's slots."""
        return [self.tokens[self.words[i]].lower() for i in range(start, start + size) if self.slot[i]]


def codes() -> Memo:
    return Memo(token_code, 100_000)


def item_windows(text: str, size: int, memo: Memo) -> list[tuple[int, bool, int, int, list[str]]]:
    """(window size, literal, hash, start, slot values) of an item; by the tokens themselves every window over a token that no template window with few enough slots covers."""
    t = Template(text, memo)
    size = min(size, len(t))
    if not size:
        return []
    h, usable = t.windows(size)
    rows = [(size, False, int(h[i].view(np.int64)), i, t.slot_values(i, size)) for i in np.flatnonzero(usable).tolist()]
    bare = np.convolve(usable, np.ones(size, int)) == 0  # tokens outside all usable windows
    own, _ = t.windows(size, True)
    return rows + [(size, True, int(own[i].view(np.int64)), i, []) for i in np.flatnonzero(np.convolve(bare, np.ones(size, int), "valid")).tolist()]


def benchmark_windows(benchmark: DataFrame, size: int, id_col: str, text_col: str) -> DataFrame:
    """(item, n_tokens, size, literal, h, start, slots) of every item."""
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = codes()
        for batch in batches:
            rows = []
            for item, text in zip(batch.column(0).to_pylist(), texts(batch.column(1)), strict=True):
                n = len(Template(text, memo))
                rows += [{"item": item, "n_tokens": n, "size": s, "literal": lit, "h": h, "start": at, "slots": slots} for s, lit, h, at, slots in item_windows(text, size, memo)]
            if rows:
                yield pa.RecordBatch.from_pylist(rows, pa.schema([("item", pa.int64()), ("n_tokens", pa.int32()), ("size", pa.int32()), ("literal", pa.bool_()), ("h", pa.int64()), ("start", pa.int32()), ("slots", pa.list_(pa.string()))]))

    rows = benchmark.select(F.col(id_col).cast("long").alias("item"), F.col(text_col).alias("text"))
    return rows.mapInArrow(cut, "item long, n_tokens int, size int, literal boolean, h long, start int, slots array<string>")


def document_windows(docs: DataFrame, shapes: list[tuple[int, bool]], known: np.ndarray | None) -> DataFrame:
    """(doc, tie, h, at, slots) of the documents' windows; only those with a known hash, if the hashes are given."""
    known = docs.sparkSession.sparkContext.broadcast(known)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, wanted = codes(), known.value
        schema = pa.schema([("doc", pa.int64()), ("tie", pa.int64()), ("h", pa.int64()), ("at", pa.int32()), ("slots", pa.list_(pa.string()))])
        for batch in slices(batches):
            rows = []
            for doc, tie, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts(batch.column(2)), strict=True):
                t = Template(text, memo)
                for size, literal in shapes:
                    h, usable = t.windows(size, literal)
                    if wanted is not None and len(h):
                        usable = usable & (wanted[np.minimum(np.searchsorted(wanted, h), len(wanted) - 1)] == h)
                    rows += [(doc, tie, int(h[i].view(np.int64)), i, [] if literal else t.slot_values(i, size)) for i in np.flatnonzero(usable).tolist()]
                if len(rows) > 20_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return docs.select("doc", "tie", "text").mapInArrow(cut, "doc long, tie long, h long, at int, slots array<string>")


def consistent(hits: list[dict], n_tokens: int) -> tuple[float, bool]:
    """Share of the item's tokens under windows whose slots agree, and whether a slot's value is another.

    Windows at one offset between document and item belong together. There, an item's value must stand
    for one value of the document: for the one found most often, and the windows that say otherwise do
    not count.
    """
    runs, covered, other = defaultdict(list), set(), False
    for w in hits:
        runs[w["at"] - w["start"]].append(w)
    for windows in runs.values():
        votes: dict[str, Counter] = defaultdict(Counter)
        for w in windows:
            for mine, theirs in zip(w["slots"], w["doc_slots"], strict=True):
                votes[mine][theirs] += 1
        stands = {mine: min(c, key=lambda v: (-c[v], v)) for mine, c in votes.items()}
        for w in windows:
            if all(stands[m] == d for m, d in zip(w["slots"], w["doc_slots"], strict=True)):
                covered.update(range(w["start"], w["start"] + w["size"]))
                other |= w["slots"] != w["doc_slots"]
    return len(covered) / n_tokens, other


def found_items(rows: DataFrame, benchmark: DataFrame, size: int, least: float, item_col: str, item_text_col: str, stages: Stages) -> DataFrame:
    """Stored (d, t, other, n, items) of the rows (doc, tie, text) in which items are found."""
    windows = stages.table(benchmark_windows(benchmark, size, item_col, item_text_col), "item-windows")
    shapes = sorted((r["size"], r["literal"]) for r in windows.select("size", "literal").distinct().collect())  # at most two a length
    few = windows.count() <= BROADCAST_WINDOWS
    known = np.unique(np.array([r.h for r in windows.select("h").distinct().collect()], np.int64).view(np.uint64)) if few else None
    if few and not len(known):
        shapes = []
    hits = document_windows(rows, shapes, known).withColumnRenamed("slots", "doc_slots").join(windows, "h")
    one = F.struct("at", "start", "size", "slots", "doc_slots")
    pairs = hits.groupBy("doc", "tie", "item", "n_tokens").agg(F.collect_set(one).alias("hits"))  # a set: repeated rows match alike

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [consistent(h, n) for h, n in zip(batch.column(4).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            keep = pa.array([c >= least for c, _ in found], pa.bool_())
            out = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array([o for _, o in found], pa.bool_())], ["doc", "tie", "item", "other"])
            yield out.filter(keep)

    judged = pairs.select("doc", "tie", "item", "n_tokens", "hits").mapInArrow(judge, "doc long, tie long, item long, other boolean")
    found = judged.groupBy("doc", "tie").agg(F.bool_or("other").alias("other"), F.count(F.lit(1)).cast("int").alias("n"), F.array_join(F.array_sort(F.collect_list("item")), ",").alias("items"))
    return stages.table(found.select(F.col("doc").alias("d"), F.col("tie").alias("t"), "other", "n", "items"), "found")


def decontaminate(docs: DataFrame, benchmark: DataFrame, size: int = 8, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text_col: str = "text", stages: Stages | None = None) -> DataFrame:
    """One row per input row: (id, contaminated, reparameterised, n_items, items).

    Windows of ``size`` template tokens are joined by hash; an item is found where at least ``least`` of its
    tokens lie under matching windows with consistent slots. ``items`` lists the found item ids, ascending,
    ``reparameterised`` tells that a slot's value differs in one of them. Shorter items are one window of
    their own length; items without words are never found; stretches that are mostly slots (runs of numbers
    or names) are matched by their tokens themselves, so that a verbatim copy always covers the whole item.

    A null text has no tokens; null and repeated ids keep a row each, judged by their own text; an empty
    table gives none, an empty benchmark marks nothing; other columns play no part. The benchmark's window
    hashes are sent to the tasks as a filter up to BROADCAST_WINDOWS of them; beyond, all windows are
    joined by the planner.
    """
    stages = stages or Stages(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.xxhash64(text_col).alias("tie"), F.col(text_col).alias("text"))
    found = found_items(rows, benchmark, size, least, item_col, item_text_col, stages)
    every = rows.select("doc", "tie").join(found, F.col("doc").eqNullSafe(F.col("d")) & (F.col("tie") == F.col("t")), "left")
    return every.select(F.col("doc").alias(id_col), F.col("n").isNotNull().alias("contaminated"), F.coalesce("other", F.lit(False)).alias("reparameterised"),
                        F.coalesce("n", F.lit(0)).alias("n_items"), F.coalesce("items", F.lit("")).alias("items"))


def keep_clean(docs: DataFrame, benchmark: DataFrame, size: int = 8, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text",
               item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, that ``decontaminate`` does not mark."""
    stages, mine = Stages(docs.sparkSession), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("mine")
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.xxhash64(text_col).alias("tie"), F.col(text_col).alias("text"))
    found = found_items(rows, benchmark, size, least, item_col, item_text_col, stages).select("d", "t")
    out = docs.select(mine, F.col(id_col).cast("long").alias("doc"), F.xxhash64(text_col).alias("tie"))
    return out.join(found, F.col("doc").eqNullSafe(F.col("d")) & (F.col("tie") == F.col("t")), "left_anti").select("mine.*")
