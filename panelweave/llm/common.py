"""Shared folders, stage tables and small Arrow helpers of the operators."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelweave.session import shared_folder


class Stages:
    """Written tables of one run, in a fresh folder below ``spark.checkpoint.dir``.

    A written table cuts the lineage: a lost executor costs the running stage and nothing before it.
    Tables that only the next step needs are removed with ``drop``; those a returned frame still
    reads stay, as its reader decides when it is done.
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.root, self.count = spark, shared_folder(spark), 0

    def folder(self, name: str) -> str:
        self.count += 1
        return f"{self.root}/{self.count:03d}-{name}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        """``df`` written and read again; its place is the attribute ``stage_path``."""
        path = self.folder(name)
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.stage_path = path
        return out

    @staticmethod
    def drop(*tables: DataFrame) -> None:
        for t in tables:
            fs, path = filesystem(t.stage_path)
            fs.delete_dir(path)


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """Filesystem and path of a shared place, local mount or remote store alike."""
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("/") else uri.replace("file:", "file://", 1))


def utf8(values: pa.Array) -> Iterator[bytes]:
    """UTF-8 bytes of each text; null counts as empty."""
    for v in values.cast(pa.large_binary()):
        yield v.as_py() or b""


def texts(values: pa.Array) -> list[str]:
    """The texts of a batch; null counts as empty."""
    return ["" if v is None else v for v in values.to_pylist()]


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """The batches in slices of at most ``rows`` rows, so that what a task derives from texts is held for few of them at once.

    At the end memory that Arrow holds back is given up, as a worker outlives its task.
    """
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
    pa.default_memory_pool().release_unused()


def text_key(text: Column) -> Column:
    """16 bytes that stand for a whole text (null counts as empty)."""
    return F.unhex(F.md5(F.coalesce(text, F.lit("")).cast("binary")))


def words_of(text: Column) -> Column:
    """Words of a text: runs of characters other than ASCII white space; null has none."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"), 0)
