"""WARC archives with revisit records, and their way back.

Records are written as text files of the shared folder, one archive per task, gzipped:
Spark's text writer puts the line separator CR LF CR LF, which ends a WARC record, after
each value, and a value is a record's header and block. They are read back whole file by
file and cut by their content lengths, decompressed piece by piece.

Which record is a response is decided on headers alone: digests, lengths and ids are
counted per (digest, salt) before they meet per digest, and only digests that occur
more than once go on. These originals are dealt out over the salts in which their copies
lie, so that the copies of one payload, however many, meet them in many tasks. Payloads
travel once, to their verdict, and not at all where no payload occurs twice or the
originals are small enough for Spark to broadcast.

Defined results: a null payload is the empty one, a null address is empty; a record
without an id is never an original unless no record of that payload has an id, and then
all are responses; rows that share the smallest id of a payload are all responses;
line ends in addresses are percent-encoded; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ledgerline.session import stage

#: Fixed values of the format.
VERSION = "WARC/1.1"
LINE = "\r\n"
RECORD_END = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

SALTS = 256
RECORDS_PER_FILE = 20_000
#: Originals that may be broadcast: rows of some 50 bytes.
BROADCAST_ROWS = 50_000
DATE = "2000-01-01T00:00:00Z"
READ_BYTES = 1 << 20


def base32_sha1(payload: Column) -> Column:
    """The SHA-1 of a payload in base32: five hex digits at a time are four letters."""
    digest = F.sha1(payload)
    letters = []
    for group in range(8):
        value = F.conv(F.substring(digest, 5 * group + 1, 5), 16, 10).cast("int")
        for shift in (15, 10, 5, 0):
            letters.append(F.substring(F.lit(BASE32), F.shiftright(value, shift).bitwiseAND(F.lit(31)) + 1, F.lit(1)))
    return F.concat(*letters)


def with_digests(pages: DataFrame, payload: str = "html") -> DataFrame:
    """``(page_id, url, payload, payload_bytes, payload_digest, salt)``."""
    whole = F.coalesce(F.col(payload), F.lit(""))
    return pages.select(
        "page_id", F.coalesce(F.col("url"), F.lit("")).alias("url"), whole.alias("payload"),
        F.octet_length(whole).cast("long").alias("payload_bytes"), base32_sha1(whole).alias("payload_digest"),
        F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).alias("salt"))


def originals(records: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Stored ``(o_digest, o_salt, o_first)``: for payloads of at least ``min_bytes`` that
    occur more than once, the smallest id, in each salt where the payload occurs."""
    headers = records.where(F.col("payload_bytes") >= min_bytes).select("page_id", "payload_digest", "salt")
    salted = headers.groupBy("payload_digest", "salt").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
    # A list holds at most one entry for each salt.
    whole = salted.groupBy("payload_digest").agg(
        F.min("first").alias("o_first"), F.sum("n").alias("n"), F.collect_list("salt").alias("salts"))
    return stage(
        whole.where("n > 1 and o_first is not null")
        .select(F.col("payload_digest").alias("o_digest"), F.explode("salts").alias("o_salt"), "o_first"), "originals")


def with_types(records: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Records with ``record_type`` (response or revisit) and ``refers_to``."""
    first = originals(records, min_bytes)
    # Few originals are broadcast. Else they are the small side of each partition, which
    # is hashed, so that payloads need no sort.
    first = F.broadcast(first) if first.count() <= BROADCAST_ROWS else first.hint("shuffle_hash")
    met = records.join(
        first,
        (F.col("payload_digest") == F.col("o_digest")) & (F.col("salt") == F.col("o_salt")), "left")
    revisit = F.col("o_first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("o_first"))
    return met.select(
        "page_id", "url", "payload", "payload_bytes", "payload_digest",
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("o_first")).alias("refers_to"))


def _record_id(page: Column) -> Column:
    return F.concat(F.lit("<urn:x-page:"), F.coalesce(page.cast("string"), F.lit("none")), F.lit(">"))


def record_text(typed: DataFrame, date: str = DATE) -> DataFrame:
    """``value``: each record's fresh header and block, without the end mark. The block of
    a response is an HTTP head and the payload, that of a revisit the HTTP head."""
    revisit = F.col("record_type") == "revisit"
    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{LINE}Content-Type: text/html; charset=UTF-8{LINE}Content-Length: "),
        F.col("payload_bytes").cast("string"), F.lit(LINE + LINE))
    length = F.octet_length("http") + F.when(revisit, 0).otherwise(F.col("payload_bytes"))
    address = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    head = F.concat(
        F.lit(f"{VERSION}{LINE}WARC-Type: "), F.col("record_type"),
        F.lit(f"{LINE}WARC-Record-ID: "), _record_id(F.col("page_id")),
        F.lit(f"{LINE}WARC-Date: {date}{LINE}WARC-Target-URI: "), address,
        F.lit(f"{LINE}WARC-Payload-Digest: sha1:"), F.col("payload_digest"),
        F.when(revisit, F.concat(
            F.lit(f"{LINE}WARC-Refers-To: "), _record_id(F.col("refers_to")),
            F.lit(f"{LINE}WARC-Profile: {PROFILE}"))).otherwise(""),
        F.lit(f"{LINE}Content-Type: application/http; msgtype=response{LINE}Content-Length: "),
        length.cast("string"), F.lit(LINE + LINE))
    return typed.withColumn("http", http).select(
        F.concat(head, F.col("http"), F.when(revisit, "").otherwise(F.col("payload"))).alias("value"))


def write_archives(typed: DataFrame, path: str, date: str = DATE) -> None:
    record_text(typed, date).write.option("compression", "gzip").option("lineSep", RECORD_END) \
        .option("maxRecordsPerFile", RECORDS_PER_FILE).text(path)


def _unzipped(content: memoryview) -> Iterator[bytes]:
    """The decompressed content, piece by piece, member after member."""
    machine, at, rest = zlib.decompressobj(31), 0, b""
    while rest or at < len(content):
        if not rest:
            rest, at = bytes(content[at:at + READ_BYTES]), at + READ_BYTES
        piece = machine.decompress(rest, 4 * READ_BYTES)
        rest = machine.unconsumed_tail
        if machine.eof:
            rest, machine = machine.unused_data, zlib.decompressobj(31)
        if piece:
            yield piece


def records_of(content: memoryview) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields and block of each record of a gzipped archive. Holds one record."""
    held = bytearray()
    source = _unzipped(content)

    def upto(size: int) -> bool:
        while len(held) < size:
            piece = next(source, None)
            if piece is None:
                return False
            held.extend(piece)
        return True

    while upto(1):
        end = -1
        while end < 0:
            end = held.find(b"\r\n\r\n")
            if end < 0 and not upto(len(held) + 1):
                raise ValueError("a record's header does not end")
        lines = bytes(held[:end]).decode("utf-8", "surrogatepass").split(LINE)
        if lines[0] != VERSION:
            raise ValueError(f"no WARC record: {lines[0][:40]!r}")
        fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
        size = int(fields["Content-Length"])
        if not upto(end + 4 + size + 4) or held[end + 4 + size:end + 8 + size] != b"\r\n\r\n":
            raise ValueError("a record's block does not end")
        yield fields, bytes(held[end + 4:end + 4 + size])
        del held[:end + 8 + size]


_PAGE = re.compile(r"<urn:x-page:(-?\d+)>")
_HTTP_LENGTH = re.compile(rb"\r\nContent-Length: (\d+)\r\n")


def _page(record_id: str) -> int | None:
    match = _PAGE.fullmatch(record_id)
    return int(match.group(1)) if match else None


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["page_id", "url", "record_type", "payload_digest", "payload_bytes", "refers_to", "payload"]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary()]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([r[n] for r in rows], kind) for n, kind in enumerate(kinds)], names=names)

    for files in batches:
        for content in files.column("content"):
            rows, held = [], 0
            for fields, block in records_of(memoryview(content.as_buffer())):
                head, _, payload = block.partition(b"\r\n\r\n")
                kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
                size = int(_HTTP_LENGTH.search(head + b"\r\n").group(1))
                if kind == "response":
                    found = base64.b32encode(hashlib.sha1(payload).digest()).decode()
                    if (found, len(payload)) != (digest, size):
                        raise ValueError(f"the payload of {fields['WARC-Record-ID']} is not what its header says")
                rows.append((
                    _page(fields["WARC-Record-ID"]), fields["WARC-Target-URI"], kind, digest, size,
                    _page(fields["WARC-Refers-To"]) if kind == "revisit" else None,
                    payload if kind == "response" else None))
                held += len(payload)
                if held > 8 * READ_BYTES or len(rows) == 2000:
                    yield batch(rows)
                    rows, held = [], 0
            yield batch(rows)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """``(page_id, url, record_type, payload_digest, payload_bytes, refers_to, payload)`` of
    every record; digests and lengths are of the full payload, and checked for responses."""
    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(
        _read, "page_id long, url string, record_type string, payload_digest string, payload_bytes long, "
        "refers_to long, payload binary")


def resolved(records: DataFrame) -> DataFrame:
    """Records read from archives, with the payload of the original in place of a
    revisit's missing one. Revisits are joined to responses by digest; only digests that
    are revisited move their payloads."""
    revisits = records.where("record_type = 'revisit'").drop("payload")
    responses = records.where("record_type = 'response'")
    wanted = responses.join(revisits.select("payload_digest").distinct(), "payload_digest", "left_semi") \
        .groupBy("payload_digest").agg(F.first("payload").alias("payload"))
    names = ["page_id", "url", "record_type", "payload_digest", "payload_bytes", "refers_to", "payload"]
    return responses.select(*names).unionByName(revisits.join(wanted, "payload_digest", "left").select(*names))
