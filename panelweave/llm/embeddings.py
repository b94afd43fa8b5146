"""Embedding near-duplicates: iterative quantisation, multi-index Hamming tables, original vectors compared.

A rotation learned on a bounded sample turns unit vectors into balanced binary codes. Codes are cut into
substrings, one a table; vectors that share a substring in some table meet, and their cosines decide.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelweave.llm.common import Stages
from panelweave.llm.components import components

SAMPLE = 20_000  # vectors the rotations are fitted on, at most
RECALL = 0.99  # of pairs at the least cosine, by formula
CHUNK = 2048  # vectors of a bucket compared with as many others at once


def unit_rows(values: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """(rows, unit vectors in double precision) for each dimension; null, zero, and vectors with null or non-finite parts are left out."""
    lists = values.cast(pa.list_(pa.float64()))
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    out = []
    for d in np.unique(sizes[sizes > 0]):
        rows = np.flatnonzero(sizes == d)
        v = pc.list_flatten(lists.take(pa.array(rows))).to_numpy(zero_copy_only=False).reshape(len(rows), d)
        top = np.abs(v).max(1)
        good = np.isfinite(v).all(1) & (top > 0)
        v = v[good] / top[good, None]
        out.append((rows[good], v / np.linalg.norm(v, axis=1, keepdims=True)))
    return out


def quantiser(sample: np.ndarray, dimension: int, bits: int, rounds: int = 30) -> tuple[np.ndarray, np.ndarray]:
    """(mean, projection to ``bits`` signs) by iterative quantisation, as many independent starts as ``bits`` needs.

    Each start turns the centred vectors by a random rotation, then alternates: codes from the rotated
    vectors, and the rotation that brings the vectors closest to their codes (orthogonal Procrustes).
    """
    rng = np.random.default_rng(dimension)
    mean = sample.mean(0) if len(sample) else np.zeros(dimension)
    centred, out = sample - mean, []
    for _ in range(math.ceil(bits / dimension)):
        turn = np.linalg.qr(rng.standard_normal((dimension, dimension)))[0]
        for _ in range(rounds if len(sample) > dimension else 0):
            left, _, right = np.linalg.svd(np.where(centred @ turn > 0, 1.0, -1.0).T @ centred)
            turn = (left @ right).T
        out.append(turn)
    return mean, np.hstack(out)[:, :bits]


def tables_for(rows: int, least: float) -> tuple[int, int]:
    """(bits a substring, tables): buckets of about 64 vectors; as many tables as meet ``RECALL`` at the least cosine.

    Signs of vectors at an angle differ in a share angle / pi of the bits.
    """
    width = min(24, max(8, math.ceil(math.log2(max(rows, 1) / 64 + 1))))
    same = (1 - math.acos(min(1.0, max(-1.0, least))) / math.pi) ** width
    return width, max(1, math.ceil(math.log(1 - RECALL) / math.log(1 - same))) if same < 1 else 1


def coder(models: object, width: int, tables: int) -> object:
    """Task: (vec_id, label, unit vector, substrings) of every comparable vector."""
    schema = pa.schema([("vec_id", pa.int64()), ("label", pa.int64()), ("unit", pa.binary()), ("codes", pa.list_(pa.int32()))])
    weights = 1 << np.arange(width)

    def task(part: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = dict(models.value)
        for batch in part:
            for rows, unit in unit_rows(batch.column("embedding")):
                d = unit.shape[1]
                if d not in known:
                    known[d] = quantiser(np.empty((0, d)), d, width * tables)
                mean, turn = known[d]
                signs = ((unit - mean) @ turn > 0).reshape(len(unit), tables, width)
                codes = (signs * weights).sum(2).astype(np.int32)
                yield pa.RecordBatch.from_arrays([
                    batch.column("vec_id").take(pa.array(rows)), batch.column("label").take(pa.array(rows)),
                    pa.array([v.tobytes() for v in unit], pa.binary()), pa.array(list(codes), pa.list_(pa.int32()))], schema=schema)

    return task


def links(ids: np.ndarray, unit: np.ndarray, codes: np.ndarray, second: np.ndarray, table: int, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, links, root) of the linked vectors of one bucket; a pair that shares an earlier table too is counted there.

    ``second``: vectors that only meet those of the other kind (None: all meet all). Root: a smaller vector
    reached by links of this bucket, its least where the vector is no root itself.
    """
    a, b = np.arange(len(ids)), np.arange(len(ids))
    if second is not None:
        a, b = np.flatnonzero(~second), np.flatnonzero(second)
    left, right = [], []
    for at in range(0, len(a), 512):
        i, j = np.nonzero(unit[a[at:at + 512]] @ unit[b].T >= least)
        i, j = a[at:at + 512][i], b[j]
        if second is None:
            i, j = i[i < j], j[i < j]
        new = ~(codes[i, :table] == codes[j, :table]).any(1)
        left.append(i)
        right.append(j)
        if not new.all():
            left[-1], right[-1] = i[new], j[new]
    i, j = np.concatenate(left), np.concatenate(right)
    n = np.bincount(i, minlength=len(ids)) + np.bincount(j, minlength=len(ids))
    root = ids.copy()
    while True:
        low = np.minimum(root[i], root[j])
        before = root.copy()
        np.minimum.at(root, i, low)
        np.minimum.at(root, j, low)
        if (root == before).all():
            break
    found = np.flatnonzero(n)
    return ids[found], n[found], root[found]


FOUND = pa.schema([("vec_id", pa.int64()), ("n", pa.int64()), ("root", pa.int64())])


def compare(least: float) -> object:
    """Task: buckets of a sorted partition, one after the other; gives links and root of each linked vector, never pairs."""

    def closed(key: tuple, rows: list) -> pa.RecordBatch | None:
        ids = np.array([r[0] for r in rows])
        if len(ids) < 2:
            return None
        table, first, second = key[1], key[3], key[4]
        sizes = np.array([len(r[1]) for r in rows])
        out = []
        for size in np.unique(sizes):  # vectors of another dimension never link
            of = np.flatnonzero(sizes == size)
            side = None if first == second else np.array([rows[k][3] == second for k in of])
            out.append(links(ids[of], np.array([np.frombuffer(rows[k][1]) for k in of]), np.array([rows[k][2] for k in of]), side, table, least))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([o[c] for o in out]), pa.int64()) for c in range(3)], schema=FOUND)

    def task(part: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, []
        for batch in part:
            keys = zip(*(batch.column(c).to_pylist() for c in ("label", "slot", "code", "low", "high")), strict=True)
            for key, row in zip(keys, zip(*(batch.column(c).to_pylist() for c in ("vec_id", "unit", "codes", "group")), strict=True), strict=True):
                if key != now:
                    if now is not None and (out := closed(now, rows)) is not None:
                        yield out
                    now, rows = key, []
                rows.append(row)
        if now is not None and (out := closed(now, rows)) is not None:
            yield out

    return task


def fitted(spark: SparkSession, vectors: DataFrame, bits: int) -> object:
    """Rotations of every dimension in a sample of at most ``SAMPLE`` vectors, those of smallest hash."""
    sample = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("embedding").toArrow().column("embedding").combine_chunks()
    return spark.sparkContext.broadcast({unit.shape[1]: (quantiser(unit, unit.shape[1], bits)) for _, unit in unit_rows(sample)} if len(sample) else {})


def near_duplicate_vectors(embeddings: DataFrame, least: float = 0.98) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of every vector: links to vectors of its label at cosine ``least`` or more.

    Vectors travel once a table, to the bucket of their substring. A bucket of more than ``CHUNK`` vectors, as
    a hot group of near copies makes it, is dealt into groups; every two groups meet in a cell of their own, so no
    task holds more than two groups, and what leaves a cell is one row a linked vector, never a pair. The work in a
    hot group still is the square of its size, as links between all its vectors are counted one by one.
    Rows with the same vec_id are one vector (the least label and embedding stand for it); a null vec_id, a null
    label and vectors that are null, empty, zero or hold null or non-finite parts link with nothing. Vectors of
    different dimensions do not link. A null vec_id gives a row of its own with no component. Empty in, empty out.
    """
    spark = embeddings.sparkSession
    stages = Stages(spark)
    all_ = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    vectors = stages.table(all_.groupBy("vec_id").agg(F.min(F.struct("label", "embedding")).alias("v")).select("vec_id", "v.label", "v.embedding"), "vectors")
    open_ = vectors.where("vec_id IS NOT NULL AND label IS NOT NULL AND size(embedding) > 0")
    width, tables = tables_for(open_.count(), least)
    coded = stages.table(open_.mapInArrow(coder(fitted(spark, open_, width * tables), width, tables), "vec_id long, label long, unit binary, codes array<int>"), "coded")
    slots = coded.select("vec_id", "label", F.posexplode("codes").alias("slot", "code"))
    heavy = slots.groupBy("label", "slot", "code").count().where(F.col("count") > CHUNK).withColumn("groups", F.ceil(F.col("count") / CHUNK).cast("int")).drop("count")
    heavy = stages.table(heavy, "heavy")  # its size is known now, so vectors are not shuffled for the join where it is small
    dealt = coded.select("*", F.posexplode("codes").alias("slot", "code")).join(heavy, ["label", "slot", "code"], "left")
    dealt = dealt.withColumn("group", F.coalesce(F.pmod(F.xxhash64("vec_id", F.lit(1)), "groups"), F.lit(0)).cast("int"))
    others = F.sequence(F.lit(0), F.coalesce("groups", F.lit(1)) - 1)
    dealt = dealt.select("*", F.explode(others).alias("other")).withColumns({"low": F.least("group", "other"), "high": F.greatest("group", "other")})
    cell = ["label", "slot", "code", "low", "high"]
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    met = dealt.select(*cell, "group", "vec_id", "unit", "codes").repartition(parts, *cell).sortWithinPartitions(*cell)
    found = stages.table(met.mapInArrow(compare(least), "vec_id long, n long, root long"), "found")
    n = found.groupBy("vec_id").agg(F.sum("n").alias("n_links"))
    roots = components(found.select(F.col("vec_id").alias("a"), F.col("root").alias("b")), stages).select(F.col("node").alias("vec_id"), F.col("root").alias("component_id"))
    out = vectors.select("vec_id").join(n, "vec_id", "left").join(roots, "vec_id", "left")
    out = out.select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


SQL = r"""
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
pairs AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, p.b FROM reach r JOIN pairs p ON p.a = r.b),
roots AS (SELECT a, min(b) AS root FROM reach GROUP BY a),
counts AS (SELECT a, count(*) AS n FROM pairs GROUP BY a)
SELECT e.vec_id, coalesce(n, 0) AS n_links, root AS component_id, e.vec_id = root AS kept
FROM (SELECT DISTINCT vec_id FROM embeddings) e LEFT JOIN counts c ON c.a = e.vec_id LEFT JOIN roots r ON r.a = e.vec_id
"""
