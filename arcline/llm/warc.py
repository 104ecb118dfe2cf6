"""WARC archives of Zstandard frames: a writer with revisit records, and a reader that loads the archive's dictionary.

An archive (.warc.zst) starts with a skippable frame that holds its dictionary; every record is a frame of its own.  The reader takes
a table of (path, content), as ``spark.read.format("binaryFile")`` gives it; the writer makes such a table, staged in the shared folder
as Parquet, so that a lost executor leaves no half-written archive.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct as pack
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arcline.llm.common import BINARY, LONG, STRING, read, stage, struct

#: Fixed values of the formats.
DICTIONARY_MAGIC = 0x184D2A5D
FRAME_MAGIC = 0xFD2FB528
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

ARCHIVES = struct(path=STRING, content=BINARY)
RECORDS = struct(path=STRING, record_type=STRING, page_id=LONG, url=STRING, refers_to=LONG, payload_bytes=LONG, payload_digest=STRING, payload=BINARY, error=STRING)
DICTIONARY_BYTES = 16 << 10
SAMPLES, SAMPLE_BYTES = 256, 4 << 10


def _record(kind: str, page_id: int | None, url: str | None, payload: bytes | None, size: int, digest: str, refers_to: int | None, revisit_null: bool, date: str) -> bytes:
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size
    block = http + (payload or b"")
    name = lambda x: f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{x}')}>"
    head = [("WARC-Type", kind), ("WARC-Record-ID", name(page_id)), ("WARC-Date", date), ("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", f"sha1:{digest}")]
    if url is not None:
        head.append(("WARC-Target-URI", quote(url, safe="%/:=&?~#+!$,;'@()*[]|^`{}\\\"<> ")))
    if page_id is not None:
        head.append(("X-Page-Id", str(page_id)))
    if kind == "revisit":
        head += [("WARC-Profile", PROFILE), ("WARC-Refers-To", name(refers_to))]
        if not revisit_null:
            head.append(("X-Refers-To-Page-Id", str(refers_to)))
    head.append(("Content-Length", str(len(block))))
    return VERSION + b"\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def _train(records: list[bytes]) -> zstandard.ZstdCompressionDict:
    samples = [r[:SAMPLE_BYTES] for r in records[:SAMPLES]]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, k=256, d=8, f=18, accel=4)
    except zstandard.ZstdError:  # too few samples: their text itself
        return zstandard.ZstdCompressionDict(b"".join(samples)[:DICTIONARY_BYTES], dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def write_archives(pages: DataFrame, *, min_revisit_bytes: int = 0, archive_bytes: int = 8 << 20, level: int = 3, date: str = "2000-01-01T00:00:00Z") -> DataFrame:
    """Archives (path, content) holding a record per row of ``pages`` (page_id, url, html), staged in the shared folder.

    The payload is the html in UTF-8, empty for null.  Of rows with equal payloads of ``min_revisit_bytes`` or more, that of the
    smallest page_id (null after all others; among rows that repeat it, one) is a response and the others are revisits, which
    hold no payload.  A null url leaves its header out.  An archive is closed once it has ``archive_bytes`` of records; a longer record
    is kept whole.  Its dictionary is trained on the first ``SAMPLES`` records of its task, ``SAMPLE_BYTES`` of each.  Other
    columns, whatever their names, are not read.  An empty table makes no archives.
    """
    rows = stage(pages.select(F.monotonically_increasing_id().alias("_row"), "page_id", "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("_payload")).withColumn("_sha", F.unhex(F.sha1("_payload"))).withColumn("_bytes", F.length("_payload").cast("long")), "payloads")
    repeated = rows.where(F.col("_bytes") >= min_revisit_bytes).groupBy("_sha").agg(F.count("*").alias("_n"), F.min(F.struct(F.col("page_id").isNull(), "page_id", "_row")).alias("_first")).where("_n > 1")
    repeated = stage(repeated.select("_sha", F.col("_first.page_id").alias("_to"), F.col("_first._row").alias("_kept")), "revisits")
    joined = rows.join(repeated, "_sha", "left")
    kind = F.when(F.col("_kept").isNull() | (F.col("_kept") == F.col("_row")) | (F.col("_bytes") < min_revisit_bytes), "response").otherwise("revisit")
    typed = joined.select("page_id", "url", "_sha", "_bytes", kind.alias("_kind"), "_to", F.when(kind == "response", F.col("_payload")).alias("_payload"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        size, trained = 0, None

        def archive() -> pa.RecordBatch:
            nonlocal trained, held, size
            trained = trained or _train(held)
            raw = trained.as_bytes()
            packer = zstandard.ZstdCompressor(level=level, dict_data=trained, write_content_size=True, write_checksum=True)
            content = pack.pack("<II", DICTIONARY_MAGIC, len(raw)) + raw + b"".join(packer.compress(r) for r in held)
            held, size = [], 0
            return pa.RecordBatch.from_arrays([pa.array([f"{hashlib.sha1(content).hexdigest()}.warc.zst"]), pa.array([content], pa.binary())], names=["path", "content"])

        for batch in batches:
            for i in range(batch.num_rows):
                page_id, url, sha, n, kind, to, payload = (column[i].as_py() for column in batch.columns)
                record = _record(kind, page_id, url, payload, n, base64.b32encode(sha).decode(), to, to is None, date)
                held.append(record)
                size += len(record)
                if size >= archive_bytes:
                    yield archive()
        if held:
            yield archive()

    return stage(typed.mapInArrow(run, ARCHIVES), "archives")


def _frame_size(data: memoryview, at: int) -> int:
    """Length of the Zstandard frame at ``at``, by its header and block headers; raises ValueError where it is cut short."""
    try:
        if pack.unpack_from("<I", data, at)[0] != FRAME_MAGIC:
            raise ValueError("no Zstandard frame here")
        flags = data[at + 4]
        single = flags >> 5 & 1
        end = at + 5 + (1 - single) + (0, 1, 2, 4)[flags & 3] + ((1 if single else 0), 2, 4, 8)[flags >> 6]
        last = 0
        while not last:
            head = data[end] | data[end + 1] << 8 | data[end + 2] << 16
            last, kind, size = head & 1, head >> 1 & 3, head >> 3
            if kind == 3:
                raise ValueError("a reserved block type")
            end += 3 + (1 if kind == 1 else size)
        end += 4 * (flags >> 2 & 1)
    except (IndexError, pack.error):
        raise ValueError("a frame is cut short") from None
    if end > len(data):
        raise ValueError("a frame is cut short")
    return end - at


def frames(content: bytes) -> Iterator[bytes | ValueError]:
    """The records of an archive; a ValueError stands for what can't be read, and nothing follows a broken frame."""
    data, at, words = memoryview(content), 0, None
    if len(data) >= 8 and pack.unpack_from("<I", data, 0)[0] == DICTIONARY_MAGIC:
        at = 8 + pack.unpack_from("<I", data, 4)[0]
        raw = bytes(data[8:at])
        if at > len(data):
            yield ValueError("the dictionary is cut short")
            return
        try:
            if raw[:4] == pack.pack("<I", FRAME_MAGIC):  # the dictionary may be compressed itself
                raw = zstandard.ZstdDecompressor().decompressobj().decompress(raw)
            words = zstandard.ZstdCompressionDict(raw)
        except zstandard.ZstdError as e:
            yield ValueError(f"the dictionary can't be loaded: {e}")
            return
    unpacker = zstandard.ZstdDecompressor(dict_data=words)
    while at < len(data):
        try:
            size = _frame_size(data, at)
        except ValueError as e:
            yield e
            return
        try:
            yield unpacker.decompressobj().decompress(data[at : at + size])
        except zstandard.ZstdError as e:
            yield ValueError(f"a frame can't be decoded: {e}")
        at += size


_HEADER = re.compile(rb"([^\x00-\x20:]+):[ \t]*(.*?)[ \t]*$", re.S)


def _parsed(raw: bytes) -> dict:
    """A record's fields; ValueError if its version, headers, lengths or digest are wrong."""
    head, gap, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.split(b"\r\n")
    if not gap or not re.fullmatch(rb"WARC/1\.[01]", version):
        raise ValueError("not a WARC record")
    fields = {}
    for line in lines:
        m = _HEADER.match(line)
        if not m:
            raise ValueError("a header line has no name")
        fields[m[1].decode("latin-1").lower()] = m[2].decode("utf-8", "replace")
    missing = [k for k in ("warc-type", "warc-record-id", "warc-date", "content-length") if k not in fields]
    if missing:
        raise ValueError(f"no {missing[0]}")
    if not fields["content-length"].isdigit() or len(rest) != int(fields["content-length"]) + 4 or rest[-4:] != b"\r\n\r\n":
        raise ValueError("content-length and the block differ")
    http, gap, payload = rest[:-4].partition(b"\r\n\r\n")
    told = re.search(rb"(?im)^content-length:[ \t]*(\d+)\r?$", http)
    if not gap or not told:
        raise ValueError("the block has no HTTP headers with a length")
    digest = fields.get("warc-payload-digest", "").removeprefix("sha1:")
    if fields["warc-type"] == "response":
        if len(payload) != int(told[1]):
            raise ValueError("the payload and its length differ")
        if digest and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
            raise ValueError("the payload and its digest differ")
    number = lambda k: int(fields[k]) if re.fullmatch(r"-?\d{1,19}", fields.get(k, "")) else None
    return {"record_type": fields["warc-type"], "page_id": number("x-page-id"), "url": fields.get("warc-target-uri"), "refers_to": number("x-refers-to-page-id"), "payload_bytes": int(told[1]), "payload_digest": digest or None, "payload": payload if fields["warc-type"] == "response" else None}


def read_archives(archives: DataFrame, *, with_payload: bool = True, batch_bytes: int = 8 << 20) -> DataFrame:
    """Records of ``archives`` (path, content): a row each, with ``error`` set and the rest null where one is not valid.

    Null or empty contents hold no records.  A record whose frame is broken ends its archive; one whose headers, lengths or payload
    digest are wrong is reported and the next is read.
    """
    schema = T.StructType([f for f in RECORDS if with_payload or f.name != "payload"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.schema([(f.name, {"LongType()": pa.int64(), "StringType()": pa.string(), "BinaryType()": pa.binary()}[repr(f.dataType)]) for f in schema])
        for batch in batches:
            for i in range(batch.num_rows):
                path, content = batch.column(0)[i].as_py(), batch.column(1)[i].as_py() or b""
                rows, size = [], 0
                for raw in frames(content):
                    try:
                        if isinstance(raw, ValueError):
                            raise raw
                        rows.append({"path": path, "error": None, **_parsed(raw)})
                        size += len(raw)
                    except ValueError as e:
                        rows.append({"path": path, "error": str(e)})
                    if size >= batch_bytes:
                        yield pa.RecordBatch.from_pylist([{k: r.get(k) for k in kinds.names} for r in rows], kinds)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist([{k: r.get(k) for k in kinds.names} for r in rows], kinds)

    return archives.select("path", "content").mapInArrow(run, schema)


def op4(spark, sf_dir: str) -> DataFrame:
    records = read_archives(write_archives(read(spark, sf_dir, "pages")), with_payload=False)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "error")


def _sha1_base32() -> str:
    """SQL for the base-32 SHA-1 of html: forty hex digits make 32 groups of five bits."""
    digit = "(CASE WHEN {c} <= '9' THEN ascii({c}) - 48 ELSE ascii({c}) - 87 END)"
    out = []
    for g in range(32):
        first, last = g * 5 // 4, (g * 5 + 4) // 4
        value = digit.format(c=f"s[{first + 1}]")
        if last != first:
            value = f"({value} * 16 + {digit.format(c=f's[{last + 1}]')})"
        shift = (last + 1) * 4 - (g * 5 + 5)
        out.append(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(({value} >> {shift}) & 31 AS INTEGER), 1)")
    return " || ".join(out)


OP4_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS s FROM pages),
r AS (SELECT *, row_number() OVER (PARTITION BY html ORDER BY page_id NULLS LAST) AS k, first(page_id) OVER (PARTITION BY html ORDER BY page_id NULLS LAST) AS f FROM p)
SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, {_sha1_base32()} AS payload_digest,
       CASE WHEN k = 1 THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN k > 1 THEN f END AS refers_to, CAST(NULL AS VARCHAR) AS error
FROM r
"""
