"""Conversion of legacy ARC archives to WARC, and readers and writers of both.

An ARC archive begins with a version block that names its version and the fields of its header lines: five in version 1,
ten in version 2. Each record is a header line, a block of the declared length, and a line feed. Conversion reads the
header lines as the version says, takes blocks by their declared lengths only, and makes up what a WARC record needs: an
identifier from the archive's name and the offset in it, a timestamp from the 14 digits of the date, a type from the
address and the block, and digests of block and payload. Records whose payload was met before become revisits.

Archives are gzip files with a member for each record, about ``ARCHIVE`` bytes each before compression, and one at least
for each task; a longer record has an archive of its own. Spark's text writer writes them, one row for each file, so they
can lie wherever Spark can write; what it puts after a row is a zero byte, which gzip takes for padding. They are read
as whole files, so a task holds those of one split. Payloads are shuffled once, compressed; the search for equal ones
moves digests only.

Defined results: a null payload is empty; a null address is written as ``-`` and read as null; characters that would
end a header's field are percent-encoded. Repeated records are copies like others: one of those with the smallest
``order`` is the response, and a null order comes last. An empty table gives empty archives; further columns are
ignored. A header line, a length or a digest that doesn't fit stops the run and names archive and offset.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import delete, scratch, stored

#: Bytes of an archive before compression.
ARCHIVE = 32 << 20
#: Fields of the header lines by version: fixed values of the format.
FIELDS = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
LEVEL = 1
PADDING = "\x00"
_DELIMITERS = re.compile(rb"[\x00-\x20\x7f]")


def member(data: bytes) -> bytes:
    """A gzip member; without a time, so that equal records are equal bytes."""
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def unpacked(data: bytes) -> bytes:
    """The content of a gzip file of any number of members, with padding; other files as they are."""
    if data[:2] != b"\x1f\x8b":
        return data
    out, at, view = [], 0, memoryview(data)
    while data[at : at + 1] == b"\x1f":
        reader = zlib.decompressobj(31)
        while not reader.eof:
            # little at a time, since what is left of it is copied at the member's end
            part = view[at : at + 16_384]
            if not len(part):
                raise ValueError("a gzip member is cut off")
            out.append(reader.decompress(part))
            at += len(part) - len(reader.unused_data)
    return b"".join(out)


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def word(value: bytes | str | None) -> bytes:
    """A field of a header line."""
    raw = value.encode() if isinstance(value, str) else value or b""
    return _DELIMITERS.sub(lambda m: b"%%%02X" % m[0][0], raw) or b"-"


# -- ARC ---------------------------------------------------------------------------------------------


def arc_line(version: int, url, ip: str, date: str, mime: str, status: int, length: int, name: str, offset: int) -> bytes:
    middle = b"" if version == 1 else b"%d - - %d %s " % (status, offset, word(name))
    return b"%s %s %s %s %s%d\n" % (word(url), word(ip), word(date), word(mime), middle, length)


def arc_start(version: int, name: str, date: str) -> bytes:
    """The version block."""
    block = f"{version} 0 converted\n{FIELDS[version]}\n".encode()
    return arc_line(version, f"filedesc://{name}", "0.0.0.0", date, "text/plain", 200, len(block), name, 0) + block + b"\n"


def arc_records(data: bytes, archive: str = ""):
    """(offset, version, fields by name, block) of each record, the version block first."""
    at, version, names = 0, 0, []
    while at < len(data):
        if data[at : at + 1] == b"\n":
            at += 1
            continue
        end = data.find(b"\n", at)
        line = data[at:end] if end >= 0 else data[at:]
        if not version:
            # the version block's own line has as many fields as its version; only the block tells which
            first = line.rsplit(b" ", 1)
            found = re.match(rb"([12]) \d+ [^\n]*\n([^\n]+)", data[end + 1 :]) if line.startswith(b"filedesc://") else None
            if not found or not first[-1].strip().isdigit():
                raise ValueError(f"{archive}, offset {at}: no version block")
            version, names = int(found[1]), found[2].decode("latin-1").split()
        parts = line.rstrip(b"\r").rsplit(b" ", len(names) - 1)
        if len(parts) != len(names) or not parts[-1].isdigit():
            raise ValueError(f"{archive}, offset {at}: {len(parts)} fields in a header line of version {version}")
        length = int(parts[-1])
        if end < 0 or end + 1 + length > len(data):
            raise ValueError(f"{archive}, offset {at}: {length} bytes are declared, {max(0, len(data) - end - 1)} are there")
        yield at, version, dict(zip(names, (p.decode("utf-8", "replace") for p in parts), strict=True)), data[end + 1 : end + 1 + length]
        at = end + 1 + length


def split_http(block: bytes) -> tuple[bytes | None, bytes]:
    """(header with its empty line, payload) of an HTTP response; without one, (None, block)."""
    if not block.startswith(b"HTTP/"):
        return None, block
    found = re.search(rb"\r?\n\r?\n", block)
    return (block, b"") if not found else (block[: found.end()], block[found.end() :])


def rolled(pieces, start, most: int):
    """Archives as gzip files: ``start(number)`` opens each, then come its records; ``pieces`` are functions of the offset."""
    held, size, number = [], 0, 0
    for piece, length in pieces:
        if held and size + length > most:
            yield b"".join(held)
            held, size = [], 0
        if not held:
            opening = start(number)
            held, size, number = [member(opening)], len(opening), number + 1
        raw = piece(size)
        held.append(member(raw))
        size += len(raw)
    if held:
        yield b"".join(held)


def written(archives: DataFrame, at: str) -> str:
    """Each row of one binary column as a file of its own below ``at``."""
    one = archives.select(F.col(archives.columns[0]).cast("string").alias("value"))
    one.write.option("maxRecordsPerFile", 1).option("lineSep", PADDING).text(at)
    return at


def write_arc(pages: DataFrame, at: str, version: int | None = None, most: int = ARCHIVE) -> str:
    """Archives of (url, date, status, header, payload): the header is that of HTTP. Without a version, tasks take 1 and 2 in turn."""

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        context = TaskContext.get()
        task = context.partitionId() if context else 0
        own = version or 1 + task % 2
        name = lambda n: f"task-{task:05d}-{n:05d}.arc.gz"
        number = [0]

        def pieces():
            for batch in batches:
                url, date, status, header, payload = (batch.column(c) for c in ("url", "date", "status", "header", "payload"))
                for i in range(batch.num_rows):
                    block = header[i].as_py() + (payload[i].as_py() or b"")

                    def piece(offset: int, i=i, block=block) -> bytes:
                        return arc_line(own, url[i].as_py(), "0.0.0.0", date[i].as_py(), "text/html", status[i].as_py(), len(block), name(number[0]), offset) + block + b"\n"

                    yield piece, len(block) + 200

        def start(n: int) -> bytes:
            number[0] = n
            return arc_start(own, name(n), "20240101000000")

        for archive in rolled(pieces(), start, most):
            yield pa.RecordBatch.from_arrays([pa.array([archive], pa.binary())], names=["archive"])

    rows = pages.select("url", "date", F.col("status").cast("int").alias("status"), F.col("header").cast("binary").alias("header"), F.col("payload").cast("binary").alias("payload"))
    return written(rows.mapInArrow(run, "archive binary"), at)


def _files(spark: SparkSession, at: str) -> DataFrame:
    return spark.read.format("binaryFile").load(at).select("path", "content")


ARC = "path string, offset long, version int, url string, ip string, date string, mime string, header string, payload_bytes long, payload_digest string"


def read_arc(spark: SparkSession, at: str, blocks: bool = False) -> DataFrame:
    """A row for each record of the ARC archives below ``at``; with ``blocks``, its block, compressed, too."""
    schema = f"{ARC}, block binary" if blocks else ARC

    def run(batches):
        import pyarrow as pa

        arrow = _arrow(schema)
        for batch in batches:
            for i in range(batch.num_rows):
                path, rows = batch.column("path")[i].as_py(), []
                for offset, version, fields, block in arc_records(unpacked(batch.column("content")[i].as_py()), path):
                    if fields["URL"].startswith("filedesc://") and not offset:
                        continue
                    header, payload = split_http(block)
                    rows.append((path, offset, version, None if fields["URL"] == "-" else fields["URL"], fields["IP-address"], fields["Archive-date"], fields["Content-type"], None if header is None else header.decode("latin-1"), len(payload), digest(payload), *[zlib.compress(block, LEVEL)] * blocks))
                    if len(rows) >= 500:
                        yield _batch(rows, arrow, pa)
                        rows = []
                if rows:
                    yield _batch(rows, arrow, pa)

    return _files(spark, at).mapInArrow(run, schema)


def _arrow(schema: str):
    import pyarrow as pa

    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    return pa.schema([(name, kinds[kind]) for name, kind in (x.split() for x in schema.split(", "))])


def _batch(rows: list[tuple], arrow, pa):
    return pa.RecordBatch.from_arrays([pa.array(list(column), kind) for column, kind in zip(zip(*rows, strict=True), arrow.types, strict=True)], schema=arrow)


# -- WARC --------------------------------------------------------------------------------------------


def warc_date(date: str) -> str:
    """2024-01-31T23:59:59Z from up to 14 digits; what is missing is the first month, day or second."""
    full = date + "00000101000000"[len(date) :] if date.isdigit() and 4 <= len(date) <= 14 else "19700101000000"
    return f"{full[:4]}-{full[4:6]}-{full[6:8]}T{full[8:10]}:{full[10:12]}:{full[12:14]}Z"


def record_id(archive: str, offset: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{archive}#{offset}')}>"


def warc_type(url: str | None, header: str | None) -> str:
    """The type of a record that is no revisit: what HTTP sent is a response, a name server's answer or anything else a resource."""
    return "response" if header is not None else "resource"


def warc_record(fields: dict[str, object], block: bytes) -> bytes:
    lines = "".join(f"{k}: {v}\r\n" for k, v in fields.items() if v is not None)
    return f"WARC/1.1\r\n{lines}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def warc_records(data: bytes, archive: str = ""):
    """(offset, fields by name in lower case, block) of each record, by its Content-Length."""
    at = 0
    while at < len(data):
        end = data.find(b"\r\n\r\n", at)
        if not data.startswith(b"WARC/", at) or end < 0:
            raise ValueError(f"{archive}, offset {at}: no record")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in data[at:end].decode("utf-8", "replace").split("\r\n")[1:])}
        length = int(fields["content-length"])
        if data[end + 4 + length : end + 8 + length] != b"\r\n\r\n":
            raise ValueError(f"{archive}, offset {at}: {length} bytes are declared, and no record ends there")
        yield at, fields, data[end + 4 : end + 4 + length]
        at = end + 8 + length


REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def decided(records: DataFrame, order: str, least: int = 0) -> DataFrame:
    """(path, offset, first_path, first_offset): for each revisit, the response that has its payload."""
    key = F.struct(F.col(order).isNull().alias("none"), F.col(order).alias("order"), "path", "offset")
    rows = records.where(F.col("payload_bytes") >= least).select("payload_digest", "payload_bytes", key.alias("key"))
    rows = stored(rows, "digests")
    # stored, so that the join can split a payload that most records have
    first = stored(rows.groupBy("payload_digest", "payload_bytes").agg(F.min("key").alias("first"), F.count(F.lit(1)).alias("k")).where("k > 1").drop("k"), "firsts")
    same = rows.join(first, ["payload_digest", "payload_bytes"]).where(F.col("key") != F.col("first"))
    return same.select("key.path", "key.offset", F.col("first.path").alias("first_path"), F.col("first.offset").alias("first_offset"))


def convert(spark: SparkSession, arc: str, at: str, order: str = "offset", ordered=None, least: int = 0, most: int = ARCHIVE) -> str:
    """WARC archives below ``at`` of the ARC archives below ``arc``.

    ``ordered`` adds the column ``order`` to ``read_arc``'s rows; of equal payloads of at least ``least`` bytes, the smallest
    is the response.
    """
    narrow = read_arc(spark, arc)
    revisits = decided(ordered(narrow) if ordered else narrow, order, least)
    rows = read_arc(spark, arc, blocks=True).join(revisits, ["path", "offset"], "left")

    def run(batches):
        import pyarrow as pa

        def pieces():
            for batch in batches:
                for r in (row for k in range(0, batch.num_rows, 64) for row in batch.slice(k, 64).to_pylist()):
                    block = zlib.decompress(r["block"])
                    again = r["first_path"] is not None
                    if again:
                        block = split_http(block)[0] or b""
                    http = r["header"] is not None
                    fields = {
                        "WARC-Type": "revisit" if again else warc_type(r["url"], r["header"]),
                        "WARC-Record-ID": record_id(r["path"], r["offset"]),
                        "WARC-Date": warc_date(r["date"]),
                        "WARC-Target-URI": r["url"],
                        "WARC-IP-Address": None if r["ip"] in ("-", "0.0.0.0") else r["ip"],
                        "WARC-Payload-Digest": f"sha1:{r['payload_digest']}",
                        "WARC-Block-Digest": f"sha1:{digest(block)}",
                        "WARC-Profile": REVISIT if again else None,
                        "WARC-Refers-To": record_id(r["first_path"], r["first_offset"]) if again else None,
                        "X-Payload-Length": r["payload_bytes"] if again else None,
                        "Content-Type": "application/http; msgtype=response" if http else "text/dns" if (r["url"] or "").startswith("dns:") else r["mime"],
                    }
                    made = warc_record(fields, block)
                    yield (lambda _, made=made: made), len(made)

        def start(n: int) -> bytes:
            block = b"software: fixcorpus\r\nformat: WARC File Format 1.1\r\n"
            return warc_record({"WARC-Type": "warcinfo", "WARC-Record-ID": f"<urn:uuid:{uuid.uuid4()}>", "WARC-Date": "2024-01-01T00:00:00Z", "Content-Type": "application/warc-fields"}, block)

        for archive in rolled(pieces(), start, most):
            yield pa.RecordBatch.from_arrays([pa.array([archive], pa.binary())], names=["archive"])

    return written(rows.mapInArrow(run, "archive binary"), at)


WARC = "path string, offset long, record_type string, record_id string, refers_to_id string, date string, url string, header string, payload_bytes long, payload_digest string"


def read_warc(spark: SparkSession, at: str) -> DataFrame:
    """A row for each record of the WARC archives below ``at`` but their openings; digests are held against the bytes."""

    def run(batches):
        import pyarrow as pa

        arrow = _arrow(WARC)
        for batch in batches:
            for i in range(batch.num_rows):
                path, rows = batch.column("path")[i].as_py(), []
                for offset, fields, block in warc_records(unpacked(batch.column("content")[i].as_py()), path):
                    kind = fields["warc-type"]
                    if kind == "warcinfo":
                        continue
                    header, payload = split_http(block)
                    length, known = len(payload), fields["warc-payload-digest"].removeprefix("sha1:")
                    if fields["warc-block-digest"] != f"sha1:{digest(block)}" or kind != "revisit" and known != digest(payload):
                        raise ValueError(f"{path}, offset {offset}: a digest differs")
                    if kind == "revisit":
                        length = int(fields["x-payload-length"])
                    rows.append((path, offset, kind, fields["warc-record-id"], fields.get("warc-refers-to"), fields["warc-date"], fields.get("warc-target-uri"), None if header is None else header.decode("latin-1"), length, known))
                if rows:
                    yield _batch(rows, arrow, pa)

    return _files(spark, at).mapInArrow(run, WARC)


# -- pages -------------------------------------------------------------------------------------------


def page_id_of(records: DataFrame, kind) -> DataFrame:
    """The page's number from the field that ``archived`` puts into the HTTP header."""
    return records.withColumn("page_id", F.expr("try_cast(nullif(regexp_extract(header, 'X-Page-Id: (-?[0-9]+)', 1), '') AS bigint)").cast(kind))


def archived(pages: DataFrame, least: int = 0) -> DataFrame:
    """Pages written to ARC archives, converted to WARC and read back: (page_id, payload_bytes, payload_digest, record_type, refers_to, url)."""
    spark, kind = pages.sparkSession, pages.schema["page_id"].dataType
    html = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    number = F.coalesce(F.concat(F.lit("X-Page-Id: "), F.col("page_id").cast("string"), F.lit("\r\n")), F.lit(""))
    header = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"), number, F.lit("Content-Length: "), F.octet_length(html).cast("string"), F.lit("\r\n\r\n"))
    rows = pages.select(F.col("url").cast("string").alias("url"), F.lit("20240101000000").alias("date"), F.lit(200).alias("status"), header.alias("header"), html.alias("payload"))
    arc, warc = scratch(spark, "arc"), scratch(spark, "warc")
    write_arc(rows, arc)
    convert(spark, arc, warc, order="page_id", ordered=lambda r: page_id_of(r, T.LongType()), least=least)
    delete(spark, arc)
    found = stored(page_id_of(read_warc(spark, warc), kind), "records")
    delete(spark, warc)
    response = found.where(F.col("record_type") != "revisit").select(F.col("record_id").alias("_id"), F.col("page_id").alias("refers_to"))
    out = found.join(response, F.col("refers_to_id") == F.col("_id"), "left")
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")


def sql() -> str:
    """``archived`` in DuckDB's SQL; base32 from the hexadecimal digits, five at a time."""
    letter = "substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(hex, 1 + 5 * (i // 4), 5))::BIGINT >> (15 - 5 * (i % 4))) & 31), 1)"
    return f"""WITH p AS (SELECT page_id, url, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages),
d AS (SELECT page_id, url, payload_bytes, array_to_string(list_transform(range(32), lambda i: {letter}), '') AS payload_digest FROM p),
r AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first, row_number() OVER (PARTITION BY payload_digest ORDER BY page_id) AS k FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN k = 1 THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN k > 1 THEN first END AS refers_to, url FROM r"""
