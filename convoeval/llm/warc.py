"""WARC archives: write pages as records, read archives back, reassemble segments.

Writing: one HTTP response record per row, the payload framed in chunked transfer coding; payloads
longer than ``segment_bytes`` are cut into a first segment and ``continuation`` records, which may land
in other files. A payload that another row already stores becomes a ``revisit`` record. Reading: records
are cut out of the files by their Content-Length; segments meet by origin identifier, are ordered by
number, checked against the total length and only then decoded.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from convoeval.llm.common import slices, work_folder

VERSION = b"WARC/1.1"
END = b"\r\n\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORDS = (
    "record_id string, record_type string, page_id bigint, url string, refers_to string, digest string, "
    "payload_length bigint, origin string, segment int, total_length bigint, block binary"
)
WHOLE = "record_id string, record_type string, page_id bigint, url string, refers_to string, payload binary, payload_length bigint, digest string, complete boolean"


def record_id(name: str) -> str:
    return f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name)}"


def _header(fields: list[tuple[str, object]], block: bytes) -> bytes:
    lines = [f"{k}: {v}" for k, v in fields if v is not None] + [f"Content-Length: {len(block)}"]
    return VERSION + b"\r\n" + "\r\n".join(lines).encode() + END + block


def chunked(payload: bytes, size: int) -> bytes:
    """``payload`` in chunked transfer coding."""
    parts = [payload[i : i + size] for i in range(0, len(payload), size)]
    return b"".join(b"%x\r\n%b\r\n" % (len(p), p) for p in parts) + b"0\r\n\r\n"


def unchunked(body: bytes) -> bytes | None:
    """The payload of a chunked body; None if its framing is broken or it ends early."""
    out, at = [], 0
    while True:
        line = body.find(b"\r\n", at)
        if line < 0:
            return None
        try:
            n = int(body[at:line].split(b";")[0], 16)
        except ValueError:
            return None
        at = line + 2
        if n == 0:
            return b"".join(out)
        if n < 0 or body[at + n : at + n + 2] != b"\r\n":
            return None
        out.append(body[at : at + n])
        at += n + 2


def _clean(value: object) -> str | None:
    """A header value on one line."""
    return None if value is None else re.sub(r"[\r\n]+", " ", str(value))


def write_warc(
    pages: DataFrame, folder: str, min_revisit: int = 100, segment_bytes: int = 1 << 20, chunk_bytes: int = 1 << 15,
    date: str = "2000-01-01T00:00:00Z", files: int | None = None, file_bytes: int = 1 << 28,
) -> None:
    """Write ``pages(page_id, url, html)`` as WARC files into ``folder``.

    A null html is an empty payload. Of rows with equal payloads of ``min_revisit`` bytes or more the
    one with the smallest page_id is the response, the others revisit it; rows that repeat that page_id
    too are responses of their own. Rows without page_id come last. Records of one row are written one
    after the other, each ending with two line ends, through Spark's own text writer, so a retried task
    leaves one copy. A record holds at most ``segment_bytes`` of a payload's block, and a file so many
    records that it stays below about ``file_bytes``. A response's record id has the row's number in it, so
    segments of equal rows never meet. Other columns are not read.
    """
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
        F.coalesce("html", F.lit("")).cast("binary").alias("payload"),
    ).withColumns({"digest": F.sha2("payload", 256), "length": F.length("payload").cast("long")})
    # the narrow side is combined before it is dealt out, so a very common payload is one row a task
    first = rows.where(F.col("length") >= min_revisit).groupBy("digest").agg(
        F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n"))
    first = first.where("n > 1").select(F.col("digest").alias("of"), "first_id")
    # payloads too short for a revisit are dealt out by their page, not to one task by a common digest
    own = F.when(F.col("length") >= min_revisit, F.col("digest")).otherwise(F.xxhash64("page_id", "url").cast("string"))
    rows = rows.withColumn("own", own).join(first, F.col("own") == F.col("of"), "left").withColumn(
        "refers", F.when(~F.col("page_id").eqNullSafe(F.col("first_id")), F.col("first_id")))
    if files:
        rows = rows.repartition(files)
    rows = rows.withColumn("row", F.monotonically_increasing_id())
    columns = ["page_id", "url", "payload", "digest", "length", "refers", "row"]

    def records(batches):
        for batch in slices(batches, "payload"):
            out = []
            for page, url, payload, digest, length, refers, row in zip(*(batch.column(c).to_pylist() for c in columns), strict=True):
                known = [("WARC-Page-ID", page), ("WARC-Target-URI", _clean(url)), ("WARC-Date", date), ("WARC-Payload-Digest", f"sha256:{digest}")]
                rid = record_id(f"page:{page}:{digest}:{row}")
                if refers is not None:
                    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % length
                    fields = [("WARC-Type", "revisit"), ("WARC-Record-ID", f"<{record_id(f'revisit:{page}:{digest}:{row}')}>"), *known,
                              ("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To-Page-ID", refers), ("Content-Type", "application/http; msgtype=response")]
                    out.append(_header(fields, head))
                    continue
                block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(payload, chunk_bytes)
                cuts = list(range(0, len(block), segment_bytes))
                for n, at in enumerate(cuts, 1):
                    part = block[at : at + segment_bytes]
                    last = [("WARC-Segment-Total-Length", len(block))] if n == len(cuts) > 1 else []
                    if n == 1:
                        fields = [("WARC-Type", "response"), ("WARC-Record-ID", f"<{rid}>"), *known, ("Content-Type", "application/http; msgtype=response"),
                                  ("WARC-Segment-Number", 1 if len(cuts) > 1 else None)]
                    else:
                        fields = [("WARC-Type", "continuation"), ("WARC-Record-ID", f"<{record_id(f'page:{page}:{digest}:{row}:{n}')}>"), ("WARC-Date", date),
                                  ("WARC-Segment-Origin-ID", f"<{rid}>"), ("WARC-Segment-Number", n), *last]
                    out.append(_header(fields, part))
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])

    rows.select(columns).mapInArrow(records, "value binary").select(F.col("value").cast("string").alias("value")).write.option(
        "lineSep", END.decode()).option("compression", "gzip").option("maxRecordsPerFile", max(1, file_bytes // (segment_bytes + 1024))).text(folder)


def parse_records(data: bytes):
    """(headers, block) of each record of an archive, plain or gzip, one or many members.

    Records start at the version line and end where their Content-Length says; bytes between records
    are skipped. A record cut short by the end of the file is given with what is there.
    """
    if data[:2] == b"\x1f\x8b":
        parts = []
        while data[:2] == b"\x1f\x8b":
            member = zlib.decompressobj(31)
            parts.append(member.decompress(data))
            data = member.unused_data
        data = b"".join(parts)
    at = data.find(b"WARC/1.")
    while at >= 0:
        end = data.find(END, at)
        if end < 0:
            return
        headers = {}
        for line in data[at:end].decode("utf-8", "replace").split("\r\n")[1:]:
            key, _, value = line.partition(":")
            headers[key.strip().lower()] = value.strip()
        try:
            n = max(0, int(headers.get("content-length", "0")))
        except ValueError:
            n = 0
        yield headers, data[end + 4 : end + 4 + n]
        at = data.find(b"WARC/1.", end + 4 + n)


def read_records(spark: SparkSession, folder: str, whole: bool = False, payloads: bool = True) -> DataFrame:
    """Every record of the archives below ``folder``, undecoded (schema ``RECORDS``).

    With ``whole`` only the records that are no segments, decoded at once (schema ``WHOLE``).

    A file is read whole by one task, so keep archives at the usual size of up to 1 GB, or well below
    an executor's memory.
    """

    def as_int(value):
        return int(value) if value and re.fullmatch(r"-?\d{1,18}", value) else None

    raw = [c.split()[0] for c in RECORDS.split(", ")]
    names = [c.split()[0] for c in WHOLE.split(", ")] if whole else raw

    def cut(batches):
        for batch in batches:
            for data in batch.column("content"):
                rows, held = [], 0
                for h, block in parse_records(data.as_py()):
                    inner = re.search(rb"(?i)\r\ncontent-length: *(\d{1,18})\r\n", block[:4096]) if h.get("warc-type") == "revisit" else None
                    row = (
                        h.get("warc-record-id", "").strip("<>"), h.get("warc-type"), as_int(h.get("warc-page-id")), h.get("warc-target-uri"),
                        h.get("warc-refers-to-page-id"), (h.get("warc-payload-digest") or "").rpartition(":")[2].lower() or None,
                        int(inner[1]) if inner else None, h["warc-segment-origin-id"].strip("<>") if "warc-segment-origin-id" in h else None,
                        as_int(h.get("warc-segment-number")), as_int(h.get("warc-segment-total-length")), block,
                    )
                    if whole:
                        r = dict(zip(raw, row, strict=True))
                        if r["segment"] is None and r["record_type"] in ("response", "revisit"):
                            rows.append(decoded(r, payloads))
                    else:
                        rows.append(row)
                    held += len(block)
                    if held > 2_000_000:
                        yield _batch(rows, names)
                        rows, held = [], 0
                yield _batch(rows, names)

    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).where("length > 0").select("content").mapInArrow(cut, WHOLE if whole else RECORDS)


_TYPES = {"page_id": pa.int64(), "payload_length": pa.int64(), "total_length": pa.int64(), "segment": pa.int32(), "block": pa.binary(), "payload": pa.binary(), "complete": pa.bool_()}


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(list(c), _TYPES.get(n, pa.string())) for n, c in zip(names, columns, strict=True)], names)


def decoded(r: dict, payloads: bool) -> tuple:
    """A row of ``WHOLE`` from a whole record of ``RECORDS``."""
    if r["record_type"] == "revisit":
        return r["record_id"], "revisit", r["page_id"], r["url"], r["refers_to"], None, r["payload_length"], r["digest"], True
    block, payload = r["block"], None
    if r["total_length"] is None or r["total_length"] == len(block):
        head, _, body = block.partition(END)
        payload = unchunked(body) if re.search(rb"(?i)\r\ntransfer-encoding:[^\r]*chunked", head) else body
    known = payload is not None
    return (r["record_id"], "response", r["page_id"], r["url"], None, payload if payloads else None, len(payload) if known else None,
            hashlib.sha256(payload).hexdigest() if known else None, known)


def reassemble(records: DataFrame, payloads: bool = True) -> DataFrame:
    """Whole records (schema ``WHOLE``) from ``read_records``; without ``payloads`` those stay null.

    Segments meet by the identifier of their first record, in the order of their numbers. ``complete``
    is false, and payload, length and digest are null, where a number is missing, the total length
    differs or the chunked framing is broken. A revisit carries the digest and length that its record
    names and no payload. Segments that came twice count once; a continuation without a first record
    gives no row.
    """
    single = records.where("record_type in ('response', 'revisit') and segment is null")
    parts = records.where("segment is not null")
    # one payload's segments meet in one task; more than one whole payload never do
    joined = parts.groupBy(F.coalesce("origin", "record_id").alias("record_id")).agg(
        F.array_sort(F.collect_set(F.struct("segment", "block", "total_length"))).alias("parts"),
        *(F.max(F.when(F.col("segment") == 1, F.col(c))).alias(c) for c in ("record_type", "page_id", "url", "digest")),
    ).where("record_type is not null").withColumn("total_length", F.array_max("parts.total_length")).withColumn(
        "numbered", (F.element_at("parts.segment", -1) == F.size("parts")) & F.element_at("parts.total_length", -1).isNotNull())
    whole = joined.select(
        "record_id", "record_type", "page_id", "url", F.lit(None).cast("string").alias("refers_to"), "digest",
        F.lit(None).cast("long").alias("payload_length"), F.lit(None).cast("string").alias("origin"), F.lit(None).cast("int").alias("segment"),
        F.when(F.col("numbered"), F.col("total_length")).otherwise(F.lit(-1)).cast("long").alias("total_length"),
        F.aggregate("parts.block", F.lit(b""), lambda x, y: F.concat(x, y)).alias("block"),
    )

    def decode(batches):
        names = [c.split()[0] for c in WHOLE.split(", ")]
        for batch in slices(batches, "block"):
            yield _batch([decoded(r, payloads) for r in batch.to_pylist()], names)

    return single.select(whole.columns).unionByName(whole).mapInArrow(decode, WHOLE)


def round_trip(pages: DataFrame, payloads: bool = True, **options) -> DataFrame:
    """``pages`` written as archives to a work folder and read back as whole records."""
    folder = work_folder(pages.sparkSession, "warc")
    write_warc(pages, folder, **options)
    # whole records are decoded where they are read, so that a task needs one Python worker
    spark = pages.sparkSession
    segments = read_records(spark, folder).where("segment is not null")
    return read_records(spark, folder, True, payloads).unionByName(reassemble(segments, payloads))
