"""WARC archives: a writer with revisit records and a splittable reader."""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelweave.llm.common import Stages, filesystem

MAGIC = b"\x1f\x8b\x08"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
GZIP = 31  # zlib's window bits for a gzip member
READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, uri string, payload binary"


def gzip_member(data: bytes, level: int = 6) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, GZIP)
    return z.compress(data) + z.flush()


def record(kind: str, record_id: str, headers: list[tuple[str, str]], block: bytes, date: str) -> bytes:
    lines = [("WARC-Type", kind), ("WARC-Record-ID", f"<{record_id}>"), ("WARC-Date", date), *headers, ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in lines).encode() + b"\r\n" + block + b"\r\n\r\n"


def page_urn(page_id: int | None) -> str:
    return f"urn:page:{'none' if page_id is None else page_id}"


def page_record(page_id: int | None, url: str | None, payload: bytes, sha1_hex: str, refers_to: int | None, revisit: bool, date: str) -> bytes:
    digest = base64.b32encode(bytes.fromhex(sha1_hex)).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    headers = [("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http; msgtype=response")]
    if url is not None:
        headers.insert(0, ("WARC-Target-URI", " ".join(url.split())))
    if not revisit:
        return record("response", page_urn(page_id), headers, http + payload, date)
    return record("revisit", page_urn(page_id), [*headers, ("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<{page_urn(refers_to)}>")], http, date)


def mark_revisits(pages: DataFrame, stages: Stages, least_bytes: int) -> DataFrame:
    """(page_id, url, html, digest, refers_to): refers_to is set where an equal payload has a smaller page_id.

    Only digests found more than once are gathered and joined; their table is stored, so the planner
    broadcasts it only where its files are small and shuffles both sides otherwise.
    """
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")).withColumn("digest", F.sha1("html"))
    again = rows.where(F.octet_length("html") >= least_bytes).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
    again = stages.table(again.where("n > 1 and first is not null").select("digest", "first"), "copies")
    return rows.join(again, "digest", "left").select(
        "page_id", "url", "html", "digest", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to"))


def write_warc(pages: DataFrame, stages: Stages, folder: str, least_bytes: int = 0, date: str = "1970-01-01T00:00:00Z", level: int = 6,
               file_bytes: int = 1 << 30) -> DataFrame:
    """One record a page, one gzip member a record; returns the files written as (path, size, n_records).

    Of pages with equal payloads of at least ``least_bytes`` the one with the smallest page_id is a
    response and the others revisit it; rows that repeat the smallest id stay responses, a null id is
    never referred to, smaller payloads are all responses. A null html is an empty payload, a null url
    gives a record without target. Tasks write files of their own, moved into place when complete.
    """
    marked = mark_revisits(pages, stages, least_bytes)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, attempt, done, n, f = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId(), [], 0, None
        fs, base = filesystem(folder)
        fs.create_dir(base, recursive=True)
        name = lambda: f"part-{part:06d}-{len(done):04d}.warc.gz"

        def close() -> None:
            size = f.tell()
            f.close()
            fs.move(f"{base}/.{name()}.{attempt}", f"{base}/{name()}")
            done.append({"path": f"{folder}/{name()}", "size": size, "n_records": n})

        for batch in batches:
            for i in range(batch.num_rows):
                page_id, url, html, digest, refers_to = (batch.column(c)[i].as_py() for c in range(5))
                if f is None:
                    f, n = fs.open_output_stream(f"{base}/.{name()}.{attempt}"), 0
                    f.write(gzip_member(record("warcinfo", f"urn:file:{name()}", [("WARC-Filename", name()), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n", date)))
                f.write(gzip_member(page_record(page_id, url, html.encode(), digest, refers_to, refers_to is not None, date), level))
                n += 1
                if f.tell() >= file_bytes:
                    close()
                    f = None
        if f is not None:
            close()
        if done:
            yield pa.RecordBatch.from_pylist(done)

    return marked.mapInArrow(write, "path string, size long, n_records long")


class Window:
    """Forward reads of a file through one bounded buffer."""

    def __init__(self, f: pa.NativeFile, size: int, step: int = 1 << 18):
        self.f, self.size, self.step, self.at, self.data = f, size, step, 0, b""

    def read(self, pos: int, n: int) -> bytes:
        if not self.at <= pos or pos + n > self.at + len(self.data):
            self.f.seek(pos)
            self.at, self.data = pos, self.f.read(max(n, self.step))
        return self.data[pos - self.at:pos - self.at + n]


def member_at(w: Window, pos: int, most: int | None = None) -> tuple[bytes, int] | None:
    """Content and end of the gzip member at ``pos``; None where there is none. ``most``: bytes of content that suffice."""
    z, out, at, got = zlib.decompressobj(GZIP), [], pos, 0
    try:
        while not z.eof and at < w.size:
            piece = w.read(at, min(1 << 15, w.size - at))
            out.append(z.decompress(piece) if most is None else z.decompress(piece, most - got))
            at, got = at + len(piece), got + len(out[-1])
            if most is not None and got >= most:
                break
    except zlib.error:
        return None
    if most is None and not z.eof:
        return None
    return b"".join(out), at - len(z.unused_data)


def first_member(w: Window, start: int, stop: int) -> int | None:
    """Start of the first member in [start, stop): gzip magic whose content opens with a record's header."""
    at = start
    while at < stop:
        n = min(1 << 16, stop - at + 2)
        chunk = w.read(at, n)
        k = chunk.find(MAGIC)
        while k >= 0:
            if at + k >= stop:
                return None
            head = member_at(w, at + k, 5)
            if head is not None and head[0].startswith(b"WARC/"):
                return at + k
            chunk = w.read(at, n)
            k = chunk.find(MAGIC, k + 1)
        if len(chunk) < 3:
            return None
        at += max(1, len(chunk) - 2)
    return None


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Records of a member's content: lower-case header names with values, and the block."""
    at = 0
    while data.startswith(b"WARC/", at):
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode("utf-8", "replace").split("\r\n")[1:]
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        n = int(headers["content-length"])
        yield headers, data[end + 4:end + 4 + n]
        at = end + 4 + n + 4


def range_records(w: Window, start: int, stop: int) -> Iterator[tuple[dict[str, str], bytes]]:
    """Records of the members that start inside [start, stop); the last may end beyond."""
    pos = first_member(w, start, stop)
    while pos is not None and pos < stop:
        member = member_at(w, pos)
        if member is None:
            raise ValueError(f"broken gzip member at byte {pos}")
        yield from parse(member[0])
        pos = member[1]
        if pos < stop and w.read(pos, 3) != MAGIC:
            pos = first_member(w, pos, stop)


def page_row(headers: dict[str, str], block: bytes) -> dict | None:
    """Row of a response or revisit record; None for other kinds. A response's digest is recomputed and compared."""
    kind = headers.get("warc-type")
    if kind not in ("response", "revisit"):
        return None
    number = lambda urn: None if urn.endswith(":none>") else int(urn.strip("<>").rpartition(":")[2])
    http, _, payload = block.partition(b"\r\n\r\n")
    digest = headers["warc-payload-digest"].removeprefix("sha1:")
    length = next(int(x.partition(b":")[2]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    if kind == "response" and (len(payload) != length or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
        raise ValueError(f"payload of {headers['warc-record-id']} does not match its digest")
    return {"page_id": number(headers["warc-record-id"]), "payload_bytes": length, "payload_digest": digest, "record_type": kind,
            "refers_to": number(headers["warc-refers-to"]) if kind == "revisit" else None, "uri": headers.get("warc-target-uri"),
            "payload": payload if kind == "response" else None}


def read_warc(spark: SparkSession, folder: str, split_bytes: int = 32 << 20, with_payload: bool = True) -> DataFrame:
    """Pages of every ``.warc.gz`` file below a folder, read by byte ranges.

    The driver lists names and sizes only. A range's task looks for gzip magic from the range's start,
    tries each candidate by decoding the header behind it, and owns the records whose member starts
    inside its range; every record thus has one owner, whatever the split size. An absent or empty
    folder gives no rows; a broken member or a payload that does not match its digest raises.
    """
    fs, base = filesystem(folder)
    found = fs.get_file_info(pafs.FileSelector(base, recursive=True, allow_not_found=True))
    files = [(f"{folder}{x.path[len(base):]}", x.size) for x in found if x.type == pafs.FileType.File and x.path.endswith(".warc.gz") and not x.base_name.startswith(".")]
    rows = spark.createDataFrame(files, "path string, size long").where("size > 0")
    ranges = rows.withColumn("start", F.explode(F.sequence(F.lit(0), F.col("size") - 1, F.lit(split_bytes))))
    count = sum(-(-s // split_bytes) for _, s in files)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pack(rows: list[dict]) -> pa.RecordBatch:
            schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("uri", pa.string()), ("payload", pa.binary())])
            return pa.RecordBatch.from_pylist(rows, schema)

        for batch in batches:
            for r in batch.to_pylist():
                fs, path = filesystem(r["path"])
                rows, held = [], 0
                with fs.open_input_file(path) as f:
                    for headers, block in range_records(Window(f, r["size"]), r["start"], min(r["size"], r["start"] + split_bytes)):
                        if (row := page_row(headers, block)) is None:
                            continue
                        if not with_payload:
                            row["payload"] = None
                        rows.append(row)
                        held += len(row["payload"] or b"")
                        if held > 16 << 20 or len(rows) >= 5000:
                            yield pack(rows)
                            rows, held = [], 0
                yield pack(rows)

    return ranges.repartition(max(1, min(count, spark.sparkContext.defaultParallelism * 16)), "path", "start").mapInArrow(read, READ)


def warc_round_trip(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Writes the archives, reads them back: one row a page. An empty table gives none; clashing extra columns play no part."""
    spark = pages.sparkSession
    stages = Stages(spark)
    folder = stages.folder("warc")
    stages.table(write_warc(pages, stages, folder, least_bytes), "files")
    return read_warc(spark, folder, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
