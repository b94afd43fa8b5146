"""SimHash near-duplicates: banded candidates, compared bit-sliced; or, by similarity, confirmed by exact Jaccard."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelweave.llm.common import Stages, slices, utf8
from panelweave.llm.components import components

BITS, PARTS = 64, 4  # fingerprint bits; equal parts a fingerprint is cut into
SHINGLE, SIMILAR = 5, 0.8  # words a shingle and least Jaccard similarity of near-duplicates by similarity
BROADCAST_ROWS = 1 << 20  # of two or three numbers each
TABLES, KEY_BITS, WIDE_RADIUS = 80, 13, 34  # their candidates: tables of sampled bits of a 128-bit fingerprint, bits a key, differing bits allowed


def shingle_hashes(text: bytes, words: int = 3) -> np.ndarray:
    """XXH64 (seed 42) of each shingle of lower-cased (A-Z) words; fewer words: of all; none: empty."""
    tokens = text.lower().split()  # bytes: ASCII letters and white space only
    if not tokens:
        return np.empty(0, np.uint64)
    if len(tokens) <= words:
        return np.array([xxhash.xxh64_intdigest(b" ".join(tokens), 42)], np.uint64)
    line, h = b" ".join(tokens), xxhash.xxh64_intdigest
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1) - 1
    starts = np.concatenate([[0], ends[:-words] + 1]).tolist()
    return np.array([h(line[a:b], 42) for a, b in zip(starts, ends[words - 1:].tolist(), strict=True)], np.uint64)


def fingerprints(batch: list[np.ndarray]) -> np.ndarray:
    """A bit is 1 if set in over half the hashes; no hashes give zero."""
    out = np.empty(len(batch), np.uint64)
    for i, h in enumerate(batch):
        ones = np.zeros(BITS, np.int64)
        for at in range(0, len(h), 1 << 14):
            piece = h[at:at + (1 << 14)].astype(">u8")
            ones += np.unpackbits(piece.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
        out[i] = np.packbits(2 * ones > len(h)).view(">u8")[0]
    return out


def linked(fp: np.ndarray, group: np.ndarray, radius: int, pairs_at_once: int = 1 << 15) -> np.ndarray:
    """Smallest row of each row's component, where rows of one group link at ``radius`` differing bits or fewer.

    ``group`` is sorted. Bit planes are stored vertically: word w of plane p holds bit p of rows 64 w to
    64 w + 63. A row is compared with the words of its group from its own on. Carry-save counters of
    two bits add a plane's differences to 64 distances at once, a third bit marks distances above the
    radius, and a word is abandoned once all its lanes are above it.
    """
    n, words = len(fp), -(-len(fp) // 64)
    bits = np.unpackbits(np.concatenate([fp, np.zeros(words * 64 - n, np.uint64)]).astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
    planes = np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view("<u8")  # (64, words)
    change = np.concatenate([[True], group[1:] != group[:-1]])
    begin = np.flatnonzero(change)
    stop = np.append(begin[1:], n)[np.cumsum(change) - 1]  # end of each row's group
    rows = np.flatnonzero(stop - np.arange(n) > 1)
    first, last = rows // 64, (stop[rows] - 1) // 64
    many = last - first + 1
    label = np.arange(n)
    ends = np.cumsum(many)
    at = 0
    while at < len(rows):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + pairs_at_once, "right")))
        reps = many[at:to]
        row = np.repeat(rows[at:to], reps)
        word = np.arange(len(row)) - np.repeat(np.cumsum(reps) - reps, reps) + np.repeat(first[at:to], reps)
        full = np.uint64(0xFFFFFFFFFFFFFFFF)
        low = np.maximum(row + 1 - word * 64, 0).astype(np.uint64)  # lanes before it and beyond the group count as above
        high = np.minimum(stop[row] - word * 64, 64)
        below = np.where(high >= 64, full, (np.uint64(1) << np.minimum(high, 63).astype(np.uint64)) - np.uint64(1))
        above = ~below | np.where(low >= 64, full, (np.uint64(1) << np.minimum(low, np.uint64(63))) - np.uint64(1))
        one, two = np.zeros_like(above), np.zeros_like(above)
        for p in range(BITS):
            if p % 8 == 0:
                keep = above != full
                row, word, above, one, two = row[keep], word[keep], above[keep], one[keep], two[keep]
                if not len(row):
                    break
            differ = planes[p, word] ^ (np.uint64(0) - ((planes[p, row >> 6] >> (row & 63).astype(np.uint64)) & np.uint64(1)))
            carry = one & differ
            one ^= differ
            above |= two & carry
            two ^= carry
            above |= {0: one | two, 1: two, 2: two & one}[radius]
        keep = above != full
        row, word, near = row[keep], word[keep], ~above[keep]
        if len(row):
            lanes = np.unpackbits(near.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            i, lane = np.nonzero(lanes)
            merge(label, row[i], word[i] * 64 + lane)
        at = to
    return label


def merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Union of linked rows: labels sink to the smallest row of a component."""
    while True:
        x, y = label[a], label[b]
        if (x == y).all():
            return
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label[:] = up


def candidate_links(prints: DataFrame, radius: int, limit: int = 4096) -> DataFrame:
    """(a, b) links that join every two distinct fingerprints within the radius, directly or by others.

    Two fingerprints that differ in up to 2 bits agree on at least 2 of 4 parts, so each pair meets
    under one of 6 keys of two parts. A key with more than ``limit`` fingerprints is dealt on by chunks:
    each pair of its chunks is a task's work of its own, so no key fills a task and none is cut short.
    Within a bucket only the links of a spanning forest leave the task.
    """
    width = BITS // PARTS
    part = [F.shiftrightunsigned("fp", width * i).bitwiseAND((1 << width) - 1) for i in range(PARTS)]
    keys = [F.lit(i * PARTS + j).cast("long") * (1 << 2 * width) + part[i] * (1 << width) + part[j] for i in range(PARTS) for j in range(i)]
    rows = prints.select("fp", F.explode(F.array(*keys)).alias("key"))
    sizes = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    rows = rows.join(sizes, "key").withColumn("chunks", F.ceil(F.col("n") / limit).cast("int"))
    own = F.pmod(F.xxhash64("fp"), F.col("chunks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))
    rows = rows.withColumn("own", own).select("fp", "key", "own", other.alias("other")).select(
        "fp", "key", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def links() -> pa.RecordBatch:
            fp, group = (np.concatenate(x) for x in zip(*held, strict=True))
            label = linked(fp.view(np.uint64), group, radius)
            at = np.flatnonzero(label != np.arange(len(label)))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(fp[at]), pa.array(fp[label[at]])], ["a", "b"])

        number, last, rows_held = 0, None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            fp, key = batch.column(0).to_numpy(), np.stack([batch.column(i).to_numpy().astype(np.int64) for i in (1, 2, 3)], 1)
            new = np.concatenate([[last is None or (key[0] != last).any()], (key[1:] != key[:-1]).any(1)])
            group = number + np.cumsum(new)
            number, last = int(group[-1]), key[-1]
            cut = int(np.flatnonzero(new)[-1]) if new.any() else 0
            if rows_held + len(fp) > 1 << 16 and new.any():  # work is cut between groups
                held.append((fp[:cut], group[:cut]))
                yield links()
                held.append((fp[cut:], group[cut:]))
                rows_held = len(fp) - cut
            else:
                held.append((fp, group))
                rows_held += len(fp)
        if held:
            yield links()

    return rows.repartition("key", "lo", "hi").sortWithinPartitions("key", "lo", "hi").mapInArrow(compare, "a long, b long")


def fingerprint_table(docs: DataFrame, id_col: str, text_col: str, *also: str) -> DataFrame:
    """(id, fp) of every row, the fingerprint as a signed long, and ``also``. A null text has no words: zero."""
    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            fp = fingerprints([shingle_hashes(t) for t in utf8(batch.column(1))])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64)), *batch.columns[2:]], ["id", "fp", *also])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *also)
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return rows.mapInArrow(prints, ", ".join([f"id {kinds['id']}", "fp long", *(f"{c} {kinds[c]}" for c in also)]))


def near_duplicates(docs: DataFrame, radius: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint, component_id): one row per input row; component_id is the smallest id reachable.

    Equal fingerprints are one node, so copies cost nothing beyond their own row. Null ids are kept,
    and count for a component only if it has no other; repeated rows keep a row each; null, empty and
    wordless texts share fingerprint zero; an empty table gives none; other columns play no part.
    ``radius`` is 0, 1 or 2.
    """
    stages = Stages(docs.sparkSession)
    rows = stages.table(fingerprint_table(docs, id_col, text_col), "fingerprints")
    rooted = print_roots(rows, stages, radius)
    heads = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = stages.table(rooted.join(heads, "root").select("fp", "component_id"), "classes")
    return rows.join(classes, "fp").select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def print_roots(rows: DataFrame, stages: Stages, radius: int) -> DataFrame:
    """(fp, least, root) of every fingerprint: its smallest id, and the component it belongs to."""
    prints = stages.table(rows.groupBy("fp").agg(F.min("id").alias("least")), "prints")
    roots = components(candidate_links(prints, radius), stages)
    return stages.table(prints.join(roots, prints["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), "rooted")


def keep_first(docs: DataFrame, radius: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row, with all its columns, of each group of near-duplicates: that with the smallest id.

    A null id comes after all others. Of rows that share the smallest id that with the smallest hash of
    its text stays, and one of those that are equal in both.
    """
    stages = Stages(docs.sparkSession)
    rows = stages.table(fingerprint_table(tied(docs, id_col, text_col), "id", "text", "tie"), "fingerprints")
    return first_rows(docs, rows.join(print_roots(rows, stages, radius).select("fp", "root"), "fp"), stages, id_col, text_col)


def tied(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, text, tie): the tie is a hash of the text."""
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("tie"))


def sized(side: DataFrame) -> DataFrame:
    """A stored side of a join, sent to the tasks where it has at most BROADCAST_ROWS rows; a larger one is left to a shuffle."""
    return F.broadcast(side) if side.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else side


def first_rows(docs: DataFrame, rooted: DataFrame, stages: Stages, id_col: str, text_col: str) -> DataFrame:
    """The row of each root of ``rooted`` (id, tie, root) that comes first by id and tie.

    Only what goes is looked up: the keys that are not first in their group.
    """
    mine = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("mine")
    order = F.struct(F.col("id").isNull(), "id", "tie")
    keys = rooted.select("id", "tie", "root").distinct()
    first = keys.groupBy("root").agg(F.min(order).alias("first"))
    gone = keys.join(first, "root").where(order != F.col("first")).select(F.col("id").alias("k_id"), F.col("tie").alias("k_tie"))
    out = docs.select(mine, F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("tie"))
    out = out.join(sized(stages.table(gone, "gone")), F.col("id").eqNullSafe(F.col("k_id")) & (F.col("tie") == F.col("k_tie")), "left_anti")
    if not rooted.groupBy("id", "tie").count().where("count > 1").isEmpty():
        out = out.dropDuplicates(["id", "tie"])
    return out.select("mine.*")


def wide_prints(batch: list[np.ndarray]) -> np.ndarray:
    """(n, 2): fingerprints of 128 bits over sets of hashes; the second half's hashes are the first's, mixed."""
    def mixed(h: np.ndarray) -> np.ndarray:
        h = (h ^ h >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ h >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
        return h ^ h >> np.uint64(31)

    return np.stack([fingerprints(batch), fingerprints([mixed(h) for h in batch])], 1)


def table_keys(prints: np.ndarray) -> np.ndarray:
    """(n, TABLES): the key of each fingerprint in each table, that is the table's number and its sampled bits."""
    rng = np.random.default_rng(42)
    bits = np.unpackbits(prints.astype(">u8").view(np.uint8).reshape(-1, 16), axis=1)
    keys = np.empty((len(prints), TABLES), np.int64)
    for t in range(TABLES):
        at = rng.choice(2 * BITS, KEY_BITS, replace=False)
        keys[:, t] = (t << KEY_BITS) + bits[:, at].astype(np.int64) @ (1 << np.arange(KEY_BITS))
    return keys


def added(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Carry-save addition of three bits a lane: sum and carry."""
    apart = a ^ b
    return apart ^ c, a & b | apart & c


def exceeding(counts: list[np.ndarray], bound: int) -> np.ndarray:
    """Lanes whose count, one array a binary digit, is above the bound."""
    more, same = np.zeros_like(counts[0]), ~np.zeros_like(counts[0])
    for k in reversed(range(len(counts))):
        if bound >> k & 1:
            same &= counts[k]
        else:
            more |= same & counts[k]
            same &= ~counts[k]
    return more


def near_pairs(prints: np.ndarray, stop: np.ndarray, radius: int, at_once: int = 1 << 13) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(i, j, differing bits) of rows i < j < stop[i] whose fingerprints, (n, 64-bit words), differ in ``radius`` bits or fewer.

    Bit planes are stored vertically as in ``linked``. Eight planes at a time go through carry-save adders into
    counters of 64 lanes; a word is abandoned once all its lanes are above the radius.
    """
    n, words, depth = len(prints), -(-len(prints) // 64), 64 * prints.shape[1]
    padded = np.concatenate([prints, np.zeros((words * 64 - n, prints.shape[1]), np.uint64)])
    bits = np.unpackbits(padded.astype(">u8").view(np.uint8).reshape(words * 64, -1), axis=1)
    planes = np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view("<u8")  # (depth, words)
    rows = np.flatnonzero(stop - np.arange(n) > 1)
    first = (rows + 1) // 64
    many = (stop[rows] - 1) // 64 - first + 1
    ends, zero, unit, at = np.cumsum(many), np.uint64(0), np.uint64(1), 0
    while at < len(rows):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + at_once, "right")))
        reps = many[at:to]
        row = np.repeat(rows[at:to], reps)
        word = np.arange(len(row)) - np.repeat(np.cumsum(reps) - reps, reps) + np.repeat(first[at:to], reps)
        low = np.maximum(row + 1 - word * 64, 0).astype(np.uint64)  # lanes before it and beyond the group are left out
        high = np.minimum(stop[row] - word * 64, 64).astype(np.uint64)
        live = ~zero >> (np.uint64(64) - high) & ~zero << low
        own, counts = prints[row], [np.zeros(len(row), np.uint64) for _ in range(depth.bit_length())]
        for p in range(0, depth, 8):
            d = [planes[q].take(word) ^ (zero - (own[:, q >> 6] >> np.uint64(63 - (q & 63)) & unit)) for q in range(p, p + 8)]
            fours = []
            for k in (0, 4):
                counts[0], x = added(counts[0], d[k], d[k + 1])
                counts[0], y = added(counts[0], d[k + 2], d[k + 3])
                counts[1], z = added(counts[1], x, y)
                fours.append(z)
            counts[2], carry = added(counts[2], *fours)
            for k in range(3, len(counts)):
                counts[k], carry = counts[k] ^ carry, counts[k] & carry
            if p + 8 > radius and p % 16 == 8:
                live &= ~exceeding(counts, radius)
                keep = live != 0
                if not keep.all():
                    row, word, live, own, counts = row[keep], word[keep], live[keep], own[keep], [c[keep] for c in counts]
                if not len(row):
                    break
        if len(row):
            live &= ~exceeding(counts, radius)
            i, lane = np.nonzero(np.unpackbits(live.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
            apart = sum((c[i] >> lane.astype(np.uint64) & unit).astype(np.int64) << k for k, c in enumerate(counts))
            yield row[i], word[i] * 64 + lane, apart
        at = to


def bucket_pairs(prints: np.ndarray, group: np.ndarray, root: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Rows (i, j) of one group within WIDE_RADIUS; ``group`` is sorted.

    With roots, all pairs of different roots. Without, each row's nearest one before it, or after it if
    none is before: enough to hold every row that has a pair, and to connect a group of like rows.
    """
    n = len(prints)
    change = np.concatenate([[True], group[1:] != group[:-1]])
    stop = np.append(np.flatnonzero(change)[1:], n)[np.cumsum(change) - 1]  # end of each row's group
    near, partner = np.full((2, n), (2 * BITS + 1) * n), np.full((2, n), -1)  # by differing bits, then by distance in the group
    found = []
    for i, j, apart in near_pairs(prints, stop, WIDE_RADIUS):
        if root is not None:
            ok = root[i] != root[j]
            found.append((i[ok], j[ok]))
            continue
        far = apart * n + (j - i)
        for side, (x, y) in enumerate(((j, i), (i, j))):
            order = np.lexsort((far, x))
            order = order[np.concatenate([[True], x[order][1:] != x[order][:-1]])] if len(order) else order  # the nearest of each x
            order = order[far[order] < near[side, x[order]]]
            near[side, x[order]], partner[side, x[order]] = far[order], y[order]
    if root is not None:
        return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.empty(0, int), np.empty(0, int))
    best = np.where(partner[0] >= 0, partner[0], partner[1])
    at = np.flatnonzero(best >= 0)
    return at, best[at]


def crowded_keys(prints: DataFrame, stages: Stages, limit: int) -> DataFrame:
    """(key, chunks) of the keys with more than ``limit`` rows; at most one row a key, whose number the key bits fix.

    A task counts its own keys and hands on those with at least ``limit`` / 256 rows, so hardly a row
    is shuffled; a key may hold that many rows a task more before it counts as crowded.
    """
    local = max(1, limit // 256)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(TABLES << KEY_BITS, np.int64)
        for batch in batches:
            keys = table_keys(np.stack([c.to_numpy() for c in batch.columns], 1).view(np.uint64))
            total += np.bincount(keys.ravel(), minlength=len(total))
        at = np.flatnonzero(total >= local)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["key", "n"])

    counts = prints.select("p", "q").mapInArrow(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") > limit)
    return stages.table(counts.select("key", F.ceil(F.col("n") / limit).cast("int").alias("chunks")), "crowded")


def wide_pairs(prints: DataFrame, rooted: bool, stages: Stages, limit: int = 4096) -> DataFrame:
    """Distinct (a, b), a < b, of nodes that meet in a table within WIDE_RADIUS; see ``bucket_pairs``.

    ``prints`` is a stored (node, p, q, root). A key with more than ``limit`` rows is dealt on by chunks, like in
    ``candidate_links``. The copies are shuffled once, by key and pair of chunks.
    """
    kept = ["node", "p", "q", *(["root"] if rooted else [])]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                columns = [c.to_numpy() for c in batch.slice(at, 1000).columns]
                keys = table_keys(np.stack(columns[1:3], 1).view(np.uint64))
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), *(pa.array(np.repeat(x, TABLES)) for x in columns)], ["key", *kept])

    rows = prints.select(*kept).mapInArrow(cut, "key long, " + ", ".join(f"{c} long" for c in kept))
    crowded, bucket = crowded_keys(prints, stages, limit), F.shiftleft(F.col("key"), 40)
    if not crowded.isEmpty():
        rows = rows.join(F.broadcast(crowded), "key", "left").withColumn("chunks", F.coalesce("chunks", F.lit(1)))
        rows = rows.withColumn("own", F.pmod(F.xxhash64("node"), F.col("chunks"))).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        bucket = bucket + F.shiftleft(F.least("own", "other").cast("long"), 20) + F.greatest("own", "other")
    rows = rows.select(bucket.alias("bucket"), *kept)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pairs(held: pa.Table) -> Iterator[pa.RecordBatch]:
            bucket, node, p, q, *root = (c.to_numpy() for c in held.columns)
            i, j = bucket_pairs(np.stack([p, q], 1).view(np.uint64), bucket, root[0] if rooted else None)
            both = np.unique(np.stack([np.minimum(node[i], node[j]), np.maximum(node[i], node[j])], 1), axis=0)
            for at in range(0, len(both), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(both[at:at + (1 << 16), 0]), pa.array(both[at:at + (1 << 16), 1])], ["a", "b"])

        held = None
        for batch in batches:
            held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            if held.num_rows > 1 << 16:  # work is cut between groups
                bucket = held.column(0).to_numpy()
                cut_at = int(np.searchsorted(bucket, bucket[-1]))
                if cut_at:
                    yield from pairs(held.slice(0, cut_at))
                    held = held.slice(cut_at)
        if held is not None and held.num_rows:
            yield from pairs(held)

    found = rows.repartition("bucket").sortWithinPartitions("bucket", "node").mapInArrow(compare, "a long, b long")
    return found.distinct()


def shingle_set(text: bytes) -> np.ndarray:
    return np.unique(shingle_hashes(text, SHINGLE))


def node_table(rows: DataFrame) -> DataFrame:
    """(id, tie, node, p, q) of (id, text, tie): texts of the same words are one node, that is a hash of them; p and q are the fingerprint."""
    def prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            data = list(utf8(batch.column(1)))
            node = np.array([xxhash.xxh64_intdigest(b" ".join(t.lower().split()), 42) for t in data], np.uint64).view(np.int64)
            wide = wide_prints([shingle_set(t) for t in data]).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(node), pa.array(wide[:, 0]), pa.array(wide[:, 1])], ["id", "tie", "node", "p", "q"])

    return rows.select("id", "text", "tie").mapInArrow(prints, "id long, tie long, node long, p long, q long")


def shingle_sets(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, hashes): the sorted shingle hashes, as bytes, of a text (id, text, tie) of each of the nodes (node, r_id, r_tie)."""
    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shingle_set(t).tobytes() for t in utf8(batch.column(1))], pa.binary())], ["node", "hashes"])

    mine = rows.join(sized(nodes), F.col("id").eqNullSafe(F.col("r_id")) & (F.col("tie") == F.col("r_tie")))
    return mine.select("node", "text").mapInArrow(sets, "node long, hashes binary").dropDuplicates(["node"])


def confirmed(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose shingle sets have a Jaccard similarity of at least ``least``."""
    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(both / max(1, len(x) + len(y) - both) >= least)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    rows = pairs.join(sets.select(F.col("node").alias("a"), F.col("hashes").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("hashes").alias("y")), "b")
    return rows.select("a", "b", "x", "y").mapInArrow(judge, "a long, b long")


def similar_roots(rows: DataFrame, nodes: DataFrame, stages: Stages, least: float) -> DataFrame:
    """(node, root) of every node tied to another by similar pairs of rows (id, text, tie); ``nodes`` is (id, tie, node, p, q)."""
    one = nodes.groupBy("node").agg(F.min(F.struct(F.col("id").isNull(), "id", "tie")).alias("r"), F.first("p").alias("p"), F.first("q").alias("q"))
    one = stages.table(one.select("node", "p", "q", F.col("r.id").alias("r_id"), F.col("r.tie").alias("r_tie"), F.lit(0).cast("long").alias("root")), "nodes")
    pairs = stages.table(wide_pairs(one, False, stages), "nearest")
    met = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    one = stages.table(one.drop("root").join(met, "node"), "met")
    sets = stages.table(shingle_sets(rows, one.select("node", "r_id", "r_tie")), "sets")
    links = stages.table(confirmed(pairs, sets, least), "links")
    roots = components(links, stages)
    # the other pairs: only those not connected yet have to be looked at
    left = one.join(roots.withColumnRenamed("root", "known"), "node", "left").select("node", "p", "q", F.coalesce("known", "node").alias("root"))
    more = stages.table(confirmed(wide_pairs(stages.table(left, "left"), True, stages), sets, least), "more-links")
    return components(links.union(more), stages)


def keep_first_similar(docs: DataFrame, least: float = SIMILAR, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row, with all its columns, of each group of texts tied by a Jaccard similarity of ``least`` or more: that ``keep_first`` keeps.

    Similarity is that of the sets of 5-word shingles (words as in ``shingle_hashes``; a shorter text is one
    shingle, texts without words are alike), compared by 64-bit hashes. A pair is looked at if it meets in
    one of TABLES tables and lies within WIDE_RADIUS of 128 bits, and linked only if its exact similarity suffices.
    """
    stages, rows = Stages(docs.sparkSession), tied(docs, id_col, text_col)
    nodes = stages.table(node_table(rows), "fingerprints")
    roots = stages.table(similar_roots(rows, nodes, stages, least), "roots").withColumnRenamed("root", "known")
    rooted = nodes.join(roots, "node", "left").select("id", "tie", F.coalesce("known", "node").alias("root"))
    return first_rows(docs, rooted, stages, id_col, text_col)
