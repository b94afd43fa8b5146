"""Documents into shards of near equal bytes by Karmarkar-Karp differencing."""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelweave.llm.common import Stages, text_key


SIZES = 8  # of pieces: each but the last is meant to be half of that before it


def differencing(partials: Sequence[Sequence[int]], k: int) -> list[list[int]]:
    """Bin of each part of each partial partition.

    A partial partition is a list of up to ``k`` part sums. The two with the largest spread are combined
    again and again, the largest part of one with the smallest of the other, until one is left. Ties go
    to the earlier partial. Each partial's parts end in different bins.
    """
    nodes: list[tuple] = []  # a node is a part of a partial, or two nodes that share a bin

    def entry(order: int, parts: list[tuple[int, int]]) -> tuple:
        parts.sort(reverse=True)
        low = parts[-1][0] if len(parts) == k else 0
        parts = [(s - low, n) for s, n in parts]
        return (-parts[0][0] if parts else 0, order, parts)

    heap = []
    for i, sums in enumerate(partials):
        parts = []
        for j, s in enumerate(sums):
            parts.append((int(s), len(nodes)))
            nodes.append((i, j, None))
        heap.append(entry(i, parts))
    heapq.heapify(heap)
    order = len(heap)
    while len(heap) > 1:
        _, _, a = heapq.heappop(heap)
        _, _, b = heap[0]
        joined = a[:k - len(b)] + b[:k - len(a)] if len(a) + len(b) <= k else a[:k - len(b)]
        if len(a) + len(b) > k:
            over = len(a) + len(b) - k  # the last ``over`` of a meet the last of b in opposite order
            for (s, n), (t, m) in zip(a[k - len(b):], reversed(b[len(b) - over:]), strict=True):
                joined.append((s + t, len(nodes)))
                nodes.append((n, m, True))
            joined += b[:len(b) - over]
        heapq.heapreplace(heap, entry(order, joined))
        order += 1
    out = [[0] * len(sums) for sums in partials]
    for bin_, (_, root) in enumerate(heap[0][2] if heap else []):
        stack = [root]
        while stack:
            a, b, pair = nodes[stack.pop()]
            if pair:
                stack += [a, b]
            else:
                out[a][b] = bin_
    return out


def assign_groups(groups: DataFrame, unit: int) -> DataFrame:
    """(key, part, piece, weight) of (key, weight): a task's groups of up to ``unit`` are dealt into pieces of less than two units, a heavier one is a piece of its own (a negative number).

    Pieces are meant to weigh a unit, a half, a quarter and so on, again and again: small ones level what large ones leave. They stay unbalanced for the differencing over all tasks: a partition levelled inside a task could not offset a heavy group of another.
    """
    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, filled, alone = TaskContext.get().partitionId(), 0, 0
        for batch in batches:
            weights = batch.column(1).to_numpy()
            heavy = weights > unit
            sums, own = filled + np.cumsum(np.where(heavy, 0, weights)), alone + np.cumsum(heavy)
            piece = np.where(heavy, -own, SIZES * (sums // (2 * unit)) + np.minimum(-np.log2(1 - sums % (2 * unit) / (2 * unit)), SIZES - 1).astype(np.int64))
            if len(weights):
                filled, alone = int(sums[-1]), int(own[-1])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.full(len(piece), part, np.int32)), pa.array(piece.astype(np.int64)), batch.column(1)], ["key", "part", "piece", "weight"])

    return groups.select("key", "weight").mapInArrow(assign, "key binary, part int, piece long, weight long")


def piece_unit(total: int, k: int) -> int:
    """Weight of the largest pieces: 1/128 of a mean shard, more where that made over 4096 of them in all, but never over 1/8."""
    return max(1, total // (k * max(8, min(128, 4096 // k))))


def number_slots(rows: DataFrame, stages: Stages, shard: str = "shard") -> DataFrame:
    """``rows`` with ``slot``, gapless from 0 in each shard. Tasks number their own rows; only their counts, one a task and shard, pass the driver."""
    names = rows.columns

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, counts = TaskContext.get().partitionId(), {}
        for batch in batches:
            shards = batch.column(names.index(shard)).to_numpy()
            local = np.empty(len(shards), np.int64)
            for s in np.unique(shards):
                at = np.flatnonzero(shards == s)
                local[at] = counts.get(int(s), 0) + np.arange(len(at))
                counts[int(s)] = counts.get(int(s), 0) + len(at)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(shards), part, np.int32)), pa.array(local)], [*names, "__part", "__local"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    done = stages.table(rows.mapInArrow(number, f"{schema}, __part int, __local long"), "numbered")
    counts = sorted((r[shard], r["__part"], r["n"]) for r in done.groupBy(shard, "__part").agg(F.count(F.lit(1)).alias("n")).collect())
    before, seen = [], {}
    for s, part, n in counts:
        before.append((s, part, seen.get(s, 0)))
        seen[s] = seen.get(s, 0) + n
    offsets = rows.sparkSession.createDataFrame(before, f"{shard} int, __part int, __before long")
    return done.join(F.broadcast(offsets), [shard, "__part"]).withColumn("slot", F.col("__before") + F.col("__local")).select(*names, "slot")


def shard_by_bytes(docs: DataFrame, k: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, size, text_crc32, shard, slot) with near equal sums of size; equal texts stay together.

    Size is the UTF-8 bytes of the text plus 1. Texts are compared by a 128-bit key; a null text is an
    empty one. The group table keeps one row a distinct text. Tasks deal light groups into small pieces;
    these and the heavy groups, whose number ``piece_unit`` bounds, are differenced together by the driver.
    Null and repeated ids keep a row each; an empty table gives none; other columns play no part.
    """
    spark = docs.sparkSession
    stages = Stages(spark)
    text = F.coalesce(F.col(text_col), F.lit(""))
    base = stages.table(docs.select(F.col(id_col).alias("id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), text_key(F.col(text_col)).alias("key")), "sizes")
    unit = piece_unit(base.agg(F.sum("size")).first()[0] or 0, k)
    groups = stages.table(assign_groups(base.groupBy("key").agg(F.sum("size").alias("weight")), unit), "groups")
    pieces = sorted(map(tuple, groups.groupBy("part", "piece").agg(F.sum("weight").alias("w")).collect()))
    placed = differencing([[w] for *_, w in pieces], k)
    places = spark.createDataFrame([(p, n, s) for (p, n, _), (s,) in zip(pieces, placed, strict=True)], "part int, piece long, shard int")
    rows = base.join(groups.select("key", "part", "piece"), "key").join(F.broadcast(places), ["part", "piece"]).select("id", "size", "text_crc32", "shard")
    return number_slots(rows, stages).withColumnRenamed("id", id_col)
