"""Token ids in grammar-compressed binary files, and their random-access reader.

A file holds blocks, each with a grammar of its own, and ends with an index of its blocks. All numbers
are little-endian:

    file    b"RPTK0002", blocks, index, index length u64, b"RPTK0002"
    index   per block: offset u64, bytes u64, documents u64, tokens u64
    block   documents u64, rules u64, symbols of all right-hand sides u64, symbols u64, first rule id u64,
            doc ids i64, 1 where the id is null u8, token counts u64,
            length of each right-hand side u32, expansion length of each rule u32,
            right-hand sides and symbols: first the lower 16 bits of all u16, then the upper ones, 8 bits u8 (32 where
            an id passes 24)
"""

from __future__ import annotations

import struct
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from panelweave.llm.common import Stages, filesystem, slices, texts
from panelweave.llm.pretokens import Apart, Memo, Splitter
from panelweave.llm.repair import Grammar, compress

MAGIC = b"RPTK0002"
HEAD = struct.Struct("<QQQQQ")
INDEX = struct.Struct("<QQQQ")
WORDS = 450_000  # a worker remembers; it outlives its task, beside others that need the memory


@lru_cache(maxsize=4)
def encoder(path: str, words: int = WORDS):
    """Function from a text to its ids as bytes, their type and the size of the vocabulary.

    The first ``words`` words are remembered, each once, by the worker process: its next task finds them.
    """
    split = Splitter(path)
    kind = np.dtype("<u2" if split.tokenizer.get_vocab_size() <= 0x10000 else "<u4")
    packed = lambda ids: array("H" if kind.itemsize == 2 else "I", ids).tobytes()
    tokenize, table = split.model.tokenize, split.bytes
    learn = lambda p: packed([t.id for t in tokenize(p.translate(table))])
    piece = Memo(learn, 50_000).__getitem__
    pieces, space = split.pieces, split.space

    def spell(chunk: str) -> bytes:
        if chunk.isalpha():
            return learn(space + chunk)
        if chunk[-1:] in (",", ".") and chunk[:-1].isalpha():
            return word(chunk[:-1]) + piece(chunk[-1])
        return b"".join(map(piece, pieces(chunk)))

    word = Memo(spell, words).__getitem__

    def encode(text: str) -> bytes:
        if (chunks := split.chunks(text)) is None:
            return packed(split.whole(text))
        try:
            head = b"".join(map(piece, split.find(chunks[0]))) if split.space else word(chunks[0])
            return head + b"".join(map(word, chunks[1:]))
        except Apart:
            return packed(split.whole(text))

    return encode, kind, split.tokenizer.get_vocab_size()


def upper_kind(top: int) -> str:
    """Type of an id's bits above the lower 16, where ``top`` is the largest id."""
    return "u1" if top < 1 << 24 else "<u4"


def block_bytes(ids: np.ndarray, doc_ids: list, counts: list[int], vocabulary: int, end: int) -> bytes:
    g = compress(ids, vocabulary, end)
    both = np.concatenate([g.right, g.symbols])
    parts = [np.array([d or 0 for d in doc_ids], "<i8"), np.array([d is None for d in doc_ids], "u1"), np.array(counts, "<u8"),
             g.sizes.astype("<u4"), g.lengths.astype("<u4"), (both & 0xFFFF).astype("<u2"), (both >> 16).astype(upper_kind(g.first + len(g.sizes)))]
    return HEAD.pack(len(doc_ids), len(g.sizes), len(g.right), len(g.symbols), g.first) + b"".join(p.tobytes() for p in parts)


def file_end(index: list[tuple[int, int, int, int]]) -> bytes:
    listing = b"".join(INDEX.pack(*x) for x in index)
    return listing + len(listing).to_bytes(8, "little") + MAGIC


def read_block(data: bytes) -> tuple[list, np.ndarray, Grammar]:
    """Document ids, token counts and grammar of a block."""
    n, rules, inner, symbols, first = HEAD.unpack_from(data)
    at, out = HEAD.size, []
    for kind, size in (("<i8", n), ("u1", n), ("<u8", n), ("<u4", rules), ("<u4", rules), ("<u2", inner + symbols), (upper_kind(first + rules), inner + symbols)):
        out.append(np.frombuffer(data, kind, size, at))
        at += size * np.dtype(kind).itemsize
    ids, null, counts, sizes, lengths, lower, upper = out
    both = upper.astype(np.int64) << 16 | lower
    grammar = Grammar(first, sizes, both[:inner], lengths, both[inner:])
    return [None if e else int(i) for i, e in zip(ids, null, strict=True)], counts.astype(np.int64), grammar


def read_document(uri: str, number: int) -> np.ndarray:
    """Ids of the document with this place in a file, by the index and the expansion lengths alone."""
    fs, path = filesystem(uri)
    with fs.open_input_file(path) as f:
        tail = f.size() - len(MAGIC) - 8
        f.seek(tail)
        size = int.from_bytes(f.read(8), "little")
        f.seek(tail - size)
        for offset, length, docs, _ in INDEX.iter_unpack(f.read(size)):
            if number < docs:
                f.seek(offset)
                _, counts, g = read_block(f.read(length))
                start = int(counts[:number].sum())
                return g.decode(start, start + int(counts[number]))
            number -= docs
    raise IndexError(number)


def write_token_files(docs: DataFrame, tokenizer_path: str, folder: str, end: int = 0, block_tokens: int = 1 << 20,
                      id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """Writes every text's ids plus the end id, in ascending order of id; returns the blocks written.

    The table is range-partitioned on (id, hash of the text), so a repeated id cannot fill one task;
    each partition streams into one file, block by block, under a name of its own that is moved into
    place at the end, so a lost executor leaves no half file. A null text is empty (only the end id), a
    null id sorts first, repeated rows are written as often as they come, other columns play no part.
    Result: (part, block, path, offset, size, n_docs, n_tokens).
    """
    order = [F.col("id"), F.col("tie")]
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).withColumn("tie", F.xxhash64("text"))
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("id", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, kind, vocabulary = encoder(tokenizer_path, words)
        part, stop = TaskContext.get().partitionId(), np.array([end], kind).tobytes()
        attempt = TaskContext.get().taskAttemptId()
        fs, path = filesystem(f"{folder}/part-{part:06d}.rptk")
        fs.create_dir(path.rpartition("/")[0], recursive=True)
        index, ids, doc_ids, counts, held, f = [], [], [], [], 0, None

        def flush() -> None:
            data = block_bytes(np.frombuffer(b"".join(ids), kind), doc_ids, counts, vocabulary, end)
            index.append((f.tell(), len(data), len(doc_ids), sum(counts)))
            f.write(data)
            ids.clear(), doc_ids.clear(), counts.clear()

        for batch in slices(batches):
            for doc_id, text in zip(batch.column(0).to_pylist(), texts(batch.column(1)), strict=True):
                if f is None:
                    f = fs.open_output_stream(f"{path}.{attempt}")
                    f.write(MAGIC)
                coded = encode(text) + stop
                ids.append(coded)
                doc_ids.append(doc_id)
                counts.append(len(coded) // kind.itemsize)
                held += counts[-1]
                if held >= block_tokens:
                    flush()
                    held = 0
        if f is not None:
            if ids:
                flush()
            f.write(file_end(index))
            f.close()
            fs.move(f"{path}.{attempt}", path)
            yield pa.RecordBatch.from_pylist([{"part": part, "block": k, "path": f"{folder}/part-{part:06d}.rptk", "offset": x[0], "size": x[1], "n_docs": x[2], "n_tokens": x[3]} for k, x in enumerate(index)], BLOCKS)

    return rows.mapInArrow(write, "part int, block int, path string, offset long, size long, n_docs long, n_tokens long")


BLOCKS = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("path", pa.string()), ("offset", pa.int64()), ("size", pa.int64()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())])


def read_token_files(spark: SparkSession, blocks: DataFrame) -> DataFrame:
    """Every document of the written files: (doc_id, start, n_tokens, ids_crc32).

    ``blocks`` is a stored result of ``write_token_files``. Only one sum a file passes the driver, and
    there is one file a partition. Each block is read and expanded on its own.
    """
    sums = sorted((r.part, r.n) for r in blocks.groupBy("part").agg(F.sum("n_tokens").alias("n")).collect())
    before, total = [], 0
    for part, n in sums:
        before.append((part, total))
        total += n
    ahead = W.partitionBy("part").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    files = spark.createDataFrame(before, "part int, before long")
    rows = blocks.withColumn("ahead", F.coalesce(F.sum("n_tokens").over(ahead), F.lit(0))).join(F.broadcast(files), "part") \
        .select("path", "offset", "size", (F.col("before") + F.col("ahead")).alias("start"))
    slices = max(1, min(len(sums) * 4, spark.sparkContext.defaultParallelism * 8))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                fs, path = filesystem(row["path"])
                with fs.open_input_file(path) as f:
                    f.seek(row["offset"])
                    doc_ids, counts, grammar = read_block(f.read(row["size"]))
                ids = memoryview(grammar.decode().astype("<u4").tobytes())
                ends = np.cumsum(counts)
                starts = ends - counts
                crc = [zlib.crc32(ids[4 * a:4 * b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.array(starts + row["start"]), pa.array(counts), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return rows.repartition(slices, "path", "offset").mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_round_trip(docs: DataFrame, tokenizer_path: str, end: int = 0, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS) -> DataFrame:
    """Encodes, writes, and reads the files back: one row per document; an empty table gives none."""
    spark = docs.sparkSession
    stages = Stages(spark)
    blocks = stages.table(write_token_files(docs, tokenizer_path, stages.folder("tokens"), end, id_col=id_col, text_col=text_col, words=words), "blocks")
    return read_token_files(spark, blocks)
