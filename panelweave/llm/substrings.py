"""Removal of repeated substrings: sparse prefix doubling over sampled positions.

A suffix array over every byte would sort some ten rows a byte and round. Here only anchors are sorted
(see ``anchors``): every string of ``length`` bytes contains one at a place its content fixes. An anchor
stands for a range of window starts. The string that all windows of the range share is its rank's key,
``k`` bytes at first; the string they span together tells whether all of them repeat at once. Rounds sort
(rank, rank of the longer string) pairs, drop what is unique, settle what repeats as a whole, halve the range
of the rest and rank again at the longer offsets, until the ranked string has ``length`` bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelweave.llm.anchors import Hasher, anchors, mix
from panelweave.llm.common import Stages, utf8

PIECE = 1 << 20  # bytes hashed at once; longer documents are cut into pieces that overlap
SETTLE_ROWS = 400_000  # anchors a task holds at once
NO_ID = (1 << 63) - 1  # a null id comes after all others
POSITION = [("doc", np.int64), ("tie", np.int64), ("at", np.int64)]  # at: the anchor's place in its document
ROW = np.dtype([("i", np.uint64), ("u", np.uint64), *POSITION, ("lo", np.uint8), ("hi", np.uint8)])


def pieces(docs: Iterator[tuple[int, int, bytes]], length: int) -> Iterator[list[tuple[int, int, int, bytes]]]:
    """Lists of (doc, tie, offset, bytes) of about PIECE bytes; every window lies whole in one piece."""
    held, size = [], 0
    for doc, tie, text in docs:
        for at in range(0, max(1, len(text) - length + 1), PIECE):
            part = text[at:at + PIECE + length - 1]
            if len(part) >= length:
                held.append((doc, tie, at, part))
                size += len(part)
            if size >= PIECE:
                yield held
                held, size = [], 0
    if held:
        yield held


def anchor_rows(parts: list[tuple[int, int, int, bytes]], length: int, k: int) -> np.ndarray:
    """A row for each anchor: hash of its ``k`` bytes, hash of the span of the windows it serves, its place, and how far before it (lo to hi) they start."""
    data = np.frombuffer(b"".join(p[3] for p in parts), np.uint8)
    sizes = [len(p[3]) for p in parts]
    number = np.repeat(np.arange(len(parts), dtype=np.int32), sizes)
    h = Hasher(data)
    every = h.every(k)
    best, first, last = anchors(every, length - k + 1, number, length)
    base = np.cumsum([0, *sizes[:-1]])
    of = number[best]
    out = np.empty(len(best), ROW)
    out["i"] = every[best]
    out["lo"], out["hi"] = best - last, best - first
    out["u"] = span(h, first, last + length, out["lo"], out["hi"])
    out["doc"], out["tie"] = np.array([p[0] for p in parts])[of], np.array([p[1] for p in parts])[of]
    out["at"] = best - base[of] + np.array([p[2] for p in parts])[of]
    return out


def span(h: Hasher, start: np.ndarray, stop: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    return mix(h.of(start, stop) + lo.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + hi.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))


def settle(i: np.ndarray, u: np.ndarray, place: np.ndarray, group: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Indices of rows that repeat as a whole, and of the first row of each span in ranks with several spans.

    Rows of a rank are sorted by span and place; of equal spans all but the first place repeat.
    """
    keys = (place["at"], place["tie"], place["doc"], u, i)
    order = np.lexsort(keys if group is None else (*keys, group))
    i, u, p = i[order], u[order], place[order]
    rank = np.concatenate([[True], i[1:] != i[:-1]])
    if group is not None:
        rank[1:] |= group[order][1:] != group[order][:-1]
    new = rank.copy()
    new[1:] |= u[1:] != u[:-1]
    head = np.flatnonzero(new)[np.cumsum(new) - 1]
    later = (p["doc"] != p["doc"][head]) | (p["tie"] != p["tie"][head]) | (p["at"] != p["at"][head])
    ranks = np.cumsum(rank) - 1
    spans = np.bincount(ranks, new)
    return order[later], order[new & (spans[ranks] > 1)]


class Contexts:
    """The anchors' surroundings, one after the other, hashed; each reaches from its first window's start to its last window's end."""

    def __init__(self, context: list[bytes], hi: np.ndarray):
        sizes = np.fromiter(map(len, context), np.int64, len(context))
        self.hashes = Hasher(np.frombuffer(b"".join(context), np.uint8))
        self.anchor = np.cumsum(sizes) - sizes + hi


def next_ranks(row: np.ndarray, n_lo: np.ndarray, n_hi: np.ndarray, lo: np.ndarray, hi: np.ndarray, c: Contexts, length: int) -> tuple[np.ndarray, ...]:
    """Halves of the ranges n_lo to n_hi that a row serves, the parts it serves, their ranks and their spans."""
    middle, halves = (n_lo + n_hi) // 2, []
    for a, b in ((n_lo, middle), (middle + 1, n_hi)):
        keep = (a <= b) & (np.maximum(a, lo[row]) <= np.minimum(b, hi[row]))
        halves.append((row[keep], a[keep], b[keep]))
    row, n_lo, n_hi = (np.concatenate(x) for x in zip(*halves, strict=True))
    e_lo, e_hi, at, h = np.maximum(n_lo, lo[row]), np.minimum(n_hi, hi[row]), c.anchor[row], c.hashes
    i = mix(h.of(at - n_lo, at - n_hi + length) + n_lo.astype(np.uint64) * np.uint64(0x165667B19E3779F9))
    return row, n_lo, n_hi, e_lo, e_hi, i, span(h, at - e_hi, at - e_lo + length, e_lo, e_hi)


def resolve(place: np.ndarray, lo: np.ndarray, hi: np.ndarray, context: list[bytes], group: np.ndarray, length: int, width: int,
            n_lo: np.ndarray | None = None, n_hi: np.ndarray | None = None) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(index, lo, hi) of the window ranges that repeat, among anchors of equal rank (``group``): all rounds to the end."""
    c, row, found = Contexts(context, hi), np.arange(len(place)), []
    n_lo = np.zeros(len(row), np.int64) if n_lo is None else n_lo.astype(np.int64)
    n_hi = np.full(len(row), width - 1) if n_hi is None else n_hi.astype(np.int64)
    while len(row):
        row, n_lo, n_hi, e_lo, e_hi, i, u = next_ranks(row, n_lo, n_hi, lo, hi, c, length)
        again, open_ = settle(i, u, place[row], group[row])
        found.append((row[again], e_lo[again], e_hi[again]))
        open_ = open_[n_lo[open_] < n_hi[open_]]
        row, n_lo, n_hi = row[open_], n_lo[open_], n_hi[open_]
    return found


def packed(rows: np.ndarray, lo: np.ndarray | None = None, hi: np.ndarray | None = None) -> pa.RecordBatch:
    """(doc, tie, run): run is the first repeated window's start times 256 plus the number of windows after it."""
    lo, hi = (rows["lo"] if lo is None else lo).astype(np.int64), (rows["hi"] if hi is None else hi).astype(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(rows["doc"]), pa.array(rows["tie"]), pa.array((rows["at"] - hi) * 256 + hi - lo)], ["doc", "tie", "run"])


SIGHT = "kind int, key long, doc long, tie long, run long"
AGAIN, OPEN = 1, 2


def sighted(kind: int, rows: np.ndarray, key: np.ndarray | None = None) -> pa.RecordBatch:
    p, n = packed(rows), len(rows)
    key = np.zeros(n, np.int64) if key is None else key.view(np.int64)
    run = p.column(2) if kind == AGAIN else pa.array((rows["at"] * 256 + rows["lo"]) * 256 + rows["hi"])
    return pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, np.int32)), pa.array(key), p.column(0), p.column(1), run], ["kind", "key", "doc", "tie", "run"])


def first_round(docs: DataFrame, length: int, k: int, buckets: int) -> DataFrame:
    """Anchors of all documents, ranked: (kind, key, doc, tie, run) of those that repeat as a whole and those left open.

    Anchors travel packed, a blob for some SETTLE_ROWS anchors and a hash bucket; what repeats among them is
    settled there and sent once, which keeps a passage that many documents share from filling a bucket.
    """
    mask = np.uint64(buckets - 1)

    def anchor(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def settled(found: list[np.ndarray]) -> pa.RecordBatch:
            rows = np.concatenate(found)
            again, _ = settle(rows["i"], rows["u"], rows)
            local = np.zeros(len(rows), bool)
            local[again] = True
            kinds, owners, blobs = [], [], []
            done = rows[local]
            for at in range(0, len(done), 1 << 16):
                kinds.append(AGAIN), owners.append(int(done["doc"][at]) & (buckets - 1)), blobs.append(pack(done[at:at + (1 << 16)]))
            rest = rows[~local]
            bucket = (rest["i"] & mask).astype(np.int64)
            rest = rest[order := np.argsort(bucket, kind="stable")]
            ends = np.searchsorted(bucket[order], np.arange(buckets + 1))
            for b in np.flatnonzero(np.diff(ends)).tolist():
                kinds.append(OPEN), owners.append(b), blobs.append(pack(rest[ends[b]:ends[b + 1]]))
            return pa.RecordBatch.from_arrays([pa.array(kinds, pa.int32()), pa.array(owners, pa.int32()), pa.array(blobs, pa.binary())], ["kind", "bucket", "rows"])

        for batch in batches:
            docs, found, n = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), utf8(batch.column(2)), strict=True), [], 0
            for p in pieces(docs, length):
                found.append(anchor_rows(p, length, k))
                n += len(found[-1])
                if n >= SETTLE_ROWS:
                    yield settled(found)
                    found, n = [], 0
            if found:
                yield settled(found)

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, last = [], None

        def work() -> Iterator[pa.RecordBatch]:
            rows = np.concatenate(held)
            held.clear()
            again, open_ = settle(rows["i"], rows["u"], rows)
            yield sighted(AGAIN, rows[again])
            yield sighted(OPEN, rows[open_], rows["i"][open_])

        for batch in batches:
            for kind, bucket, blob in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                if kind == AGAIN:
                    yield sighted(AGAIN, unpack(blob))
                    continue
                if bucket != last and held:
                    yield from work()
                last = bucket
                held.append(unpack(blob))
        if held:
            yield from work()

    sent = docs.select("doc", "tie", "text").mapInArrow(anchor, "kind int, bucket int, rows binary")
    return sent.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(rank, SIGHT)


def pack(rows: np.ndarray) -> bytes:
    """Column by column, so that the shuffle's compression finds equal neighbours."""
    return b"".join([len(rows).to_bytes(8, "little"), rows["i"].tobytes(), rows["u"].tobytes(), rows["doc"].tobytes(), rows["tie"].tobytes(), rows["at"].tobytes(), rows["lo"].tobytes(), rows["hi"].tobytes()])


def unpack(blob: bytes) -> np.ndarray:
    n, at = int.from_bytes(blob[:8], "little"), 8
    out = np.empty(n, ROW)
    for name in ROW.names:
        kind = ROW[name]
        out[name] = np.frombuffer(blob, kind, n, at)
        at += n * kind.itemsize
    return out


def contexts(docs: DataFrame, sights: DataFrame, length: int) -> DataFrame:
    """(key, doc, tie, at, lo, hi, context) of the open anchors; a document's anchors are cut from its text together."""
    wanted = sights.where(F.col("kind") == OPEN).groupBy("doc", "tie").agg(F.collect_list(F.struct("key", "run")).alias("open"))
    rows = squeezed(docs).join(wanted, ["doc", "tie"]).select("doc", "tie", "small", F.col("open.key").alias("keys"), F.col("open.run").alias("runs"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [[] for _ in range(7)]
            for doc, tie, small, keys, runs in zip(*(batch.column(c).to_pylist() for c in range(5)), strict=True):
                text = unsqueezed(small)
                for key, run in zip(keys, runs, strict=True):
                    at, lo, hi = run >> 16, run >> 8 & 255, run & 255
                    for column, value in zip(columns, (key, doc, tie, at, lo, hi, text[at - hi:at - lo + length]), strict=True):
                        column.append(value)
                if len(columns[0]) > 20_000:
                    yield context_batch(columns)
                    columns = [[] for _ in range(7)]
            yield context_batch(columns)

    return rows.mapInArrow(cut, CONTEXT)


CONTEXT = "key long, doc long, tie long, at long, lo int, hi int, context binary"


def context_batch(columns: list[list]) -> pa.RecordBatch:
    kinds = [pa.int64()] * 4 + [pa.int32()] * 2 + [pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["key", "doc", "tie", "at", "lo", "hi", "context"])


def squeezed(docs: DataFrame) -> DataFrame:
    """(doc, tie, small): texts as compressed bytes, for the shuffle by document."""
    def squeeze(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            small = [len(t).to_bytes(8, "little") + pa.compress(t, "zstd", asbytes=True) for t in utf8(batch.column(2))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(small, pa.binary())], ["doc", "tie", "small"])

    return docs.select("doc", "tie", "text").mapInArrow(squeeze, "doc long, tie long, small binary")


def unsqueezed(small: bytes) -> bytes:
    size = int.from_bytes(small[:8], "little")
    return pa.decompress(small[8:], size, "zstd", asbytes=True) if size else b""


RANKED = "key long, n_lo int, n_hi int, doc long, tie long, at long, lo int, hi int, context binary"


def columns_of(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Places, the numeric columns, and the contexts of a batch of RANKED rows."""
    numbers = {f.name: batch.column(k).to_numpy() for k, f in enumerate(batch.schema) if f.name != "context"}
    place = np.empty(batch.num_rows, POSITION)
    for name, _ in POSITION:
        place[name] = numbers[name]
    return place, numbers, batch.column(8).to_pylist()


def compare_ranks(rows: DataFrame, length: int, width: int) -> DataFrame:
    """(doc, tie, run) of the repeats among anchors of one rank; a task compares the anchors of whole ranks."""
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def work() -> Iterator[pa.RecordBatch]:
            place, n, context = columns_of(pa.Table.from_batches(held).combine_chunks().to_batches()[0])
            held.clear()
            for row, lo, hi in resolve(place, n["lo"].astype(np.int64), n["hi"].astype(np.int64), context, n["key"], length, width, n["n_lo"], n["n_hi"]):
                yield packed(place[row], lo, hi)

        for batch in batches:
            if not batch.num_rows:
                continue
            key = batch.column(0).to_numpy()
            new = np.flatnonzero(key[1:] != key[:-1]) + 1
            if held and held[-1].column(0)[-1].as_py() != key[0]:
                new = np.concatenate([[0], new])
            if len(new) and sum(b.num_rows for b in held) + len(key) > 20_000:
                held.append(batch.slice(0, new[-1]))
                yield from work() if sum(b.num_rows for b in held) else ()
                batch = batch.slice(new[-1])
            held.append(batch)
        if held:
            yield from work()

    return rows.repartition("key").sortWithinPartitions("key").mapInArrow(compare, "doc long, tie long, run long")


def halved(rows: DataFrame, length: int) -> DataFrame:
    """Both halves of each anchor's range, ranked by the longer string their windows share: RANKED with ``u``."""
    def halve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            _, n, context = columns_of(batch)
            row, n_lo, n_hi, e_lo, e_hi, i, u = next_ranks(np.arange(batch.num_rows), n["n_lo"].astype(np.int64), n["n_hi"].astype(np.int64), n["lo"].astype(np.int64), n["hi"].astype(np.int64), Contexts(context, n["hi"]), length)
            key = mix(i + n["key"][row].view(np.uint64)).view(np.int64)
            taken = [pa.array(n[c][row]) for c in ("doc", "tie", "at", "lo", "hi")]
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n_lo.astype(np.int32)), pa.array(n_hi.astype(np.int32)), *taken, batch.column(8).take(pa.array(row)), pa.array(u.view(np.int64)), pa.array(e_lo), pa.array(e_hi)],
                                             [*(f.name for f in batch.schema), "u", "e_lo", "e_hi"])

    return rows.mapInArrow(halve, RANKED + ", u long, e_lo long, e_hi long")


def later_rounds(rows: DataFrame, stages: Stages, length: int, width: int, limit: int = 4096) -> list[DataFrame]:
    """Stored tables (doc, tie, run) of the repeats among open anchors (RANKED).

    A rank's anchors are compared inside one task, through all its rounds. A rank with more than
    ``limit`` is never gathered: Spark ranks its anchors by the longer strings, settles what repeats by a
    grouped minimum and a join, and leaves smaller ranks for the next turn.
    """
    out = []
    while True:
        large = stages.table(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > limit).select("key"), "large-ranks")
        some = not large.isEmpty()
        small = rows.join(large, "key", "left_anti") if some else rows
        out.append(stages.table(compare_ranks(small.select(*(c.split()[0] for c in RANKED.split(", "))), length, width), "repeats"))
        if not some:
            return out
        place = F.struct("doc", "tie", "at")
        half = stages.table(halved(rows.join(large, "key", "left_semi"), length), "halves")
        first = half.groupBy("key", "u").agg(F.min(place).alias("first"))
        spans = first.groupBy("key").agg(F.count(F.lit(1)).alias("spans"))
        known = half.join(first, ["key", "u"])
        run = ((F.col("at") - F.col("e_hi")) * 256 + F.col("e_hi") - F.col("e_lo")).alias("run")
        out.append(stages.table(known.where(place != F.col("first")).select("doc", "tie", run), "repeats"))
        still = known.where((place == F.col("first")) & (F.col("n_lo") < F.col("n_hi"))).join(spans.where("spans > 1"), "key")
        rows = stages.table(still.select(*rows.columns), "open")


def covered(runs: list[int], length: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes that the repeated windows cover."""
    r = np.sort(np.array(runs, np.int64))
    start, stop = r >> 8, (r >> 8) + (r & 255) + length
    stop = np.maximum.accumulate(stop)
    new = np.concatenate([[True], start[1:] > stop[:-1]])
    return start[new], np.append(stop[:-1][new[1:]], stop[-1])


def remove_repeats(docs: DataFrame, length: int = 100, k: int = 32, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """Removes each byte covered by a ``length``-byte string that also starts earlier.

    Texts are UTF-8 bytes, a null text is empty. Earlier means a smaller id, or the same document and an
    earlier start; a null id comes after all others, and rows that share an id are told apart by a hash of
    their text (equal ones count as one document: neither makes the other go). Strings never cross
    documents. One row per input row: (id, n_bytes, n_removed, n_spans, kept_sha256), and the kept bytes
    as ``kept`` where asked for. An empty table gives none; other columns play no part. Strings are
    compared by two 64-bit hashes, that of the rank and that of the span.
    """
    spark, width = docs.sparkSession, length - k + 1
    stages = Stages(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("doc", F.coalesce("id", F.lit(NO_ID)))
    shared = stages.table(rows.groupBy("doc").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("bytes")), "ids")
    total, repeated = shared.agg(F.sum("bytes"), F.max("n")).first()
    tie = F.lit(0).cast("long") if (repeated or 0) <= 1 else F.xxhash64("text")
    rows = rows.withColumn("tie", tie)
    stages.drop(shared)
    buckets = 1 << max(6, ((total or 0) >> 23).bit_length())  # about 8 MB of text a bucket
    sights = stages.table(first_round(rows, length, k, buckets), "sights")
    opened = contexts(rows, sights, length).select("key", F.lit(0).alias("n_lo"), F.lit(width - 1).alias("n_hi"), "doc", "tie", "at", "lo", "hi", "context")
    opened = stages.table(opened, "open")
    runs = sights.where(F.col("kind") == AGAIN).select("doc", "tie", "run")
    for found in later_rounds(opened, stages, length, width):
        runs = runs.union(found)
    gone = runs.groupBy("doc", "tie").agg(F.collect_list("run").alias("runs"))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = {"doc": batch.column(0), "n_bytes": [], "n_removed": [], "n_spans": [], "kept_sha256": [], "kept": []}
            for small, runs in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                text, n_spans, n = unsqueezed(small), 0, 0
                kept = text
                if runs:
                    start, stop = covered(runs, length)
                    n_spans = len(start)
                    kept = b"".join(text[a:b] for a, b in zip([0, *stop.tolist()], [*start.tolist(), len(text)], strict=True))
                    n = len(text) - len(kept)
                for name, value in (("n_bytes", len(text)), ("n_removed", n), ("n_spans", n_spans), ("kept_sha256", hashlib.sha256(kept).hexdigest()), ("kept", kept if with_text else None)):
                    out[name].append(value)
            kinds = [None, pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([v if t is None else pa.array(v, t) for v, t in zip(out.values(), kinds, strict=True)], list(out))

    joined = squeezed(rows).join(gone, ["doc", "tie"], "left").select("doc", "small", "runs")
    out = joined.mapInArrow(keep, "doc long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    return out.withColumn(id_col, F.when(F.col("doc") != NO_ID, F.col("doc"))).select(id_col, "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept"] if with_text else []))
