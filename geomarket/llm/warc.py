"""WARC archives: written as whole gzip streams, normalised to one gzip member a record, read by an offset index.

``write_archives`` lets Spark's text writer make monolithic archives: a record is a line that
ends in two line breaks, a file one gzip stream. Nothing in such a file can be reached without
inflating all that comes before. ``normalise`` inflates each file once, as a stream, so that a
task holds one record and not the file; it writes every record as a gzip member of its own,
cuts archives at a number of bytes, and lists each member's place in a sidecar index.
``read_records`` walks through whole archives, or opens the members that index rows name.

Files are written and read by Spark, so they may lie in any store it knows, and a lost
executor or a retried task leaves no half-written file. A record whose digest does not match
its payload, or a file that ends inside a record, fails the job.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import zlib
from collections.abc import Iterator
from typing import NamedTuple
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geomarket.llm.tables import BLOOM_BITS, collected_bits, written
from geomarket.llm.tasks import fields, rows_from
from geomarket.session import scratch_path

# Compressed bytes after which an archive ends; a reader holds one archive.
ARCHIVE_BYTES = 16 << 20
# What begins a record; the minor version follows.
MARK = "WARC/1."
BREAK = "\r\n"
# Rows that a task gives on at once.
SLICE_BYTES = 8 << 20
# Bytes inflated at once.
WINDOW = 1 << 16
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_PAGE = "urn:x-page:"
_LINES = fields(part="string", archive="string", number="long", line="binary")
_READ = fields(record_type="string", record_id="string", target_uri="string", refers_to="string",
               payload_bytes="long", payload_digest="string", payload="binary")
# A gzip member without content: its end is zeros, see `_line`.
_EMPTY_MEMBER = bytes.fromhex("1f8b08000000000000ff030000000000") + b"\0\0\0\0"


def _base32(sha1: str) -> str:
    """SQL for upper-case base32 of a SHA-1 in hexadecimal: four characters from every five digits."""
    return f"""concat_ws('', transform(sequence(0, 7), i -> transform(
        array(cast(conv(substring({sha1}, i * 5 + 1, 5), 16, 10) as int)), v -> concat(
          substring('{_BASE32}', 1 + (shiftright(v, 15) & 31), 1), substring('{_BASE32}', 1 + (shiftright(v, 10) & 31), 1),
          substring('{_BASE32}', 1 + (shiftright(v, 5) & 31), 1), substring('{_BASE32}', 1 + (v & 31), 1)))[0]))"""


class Typed(NamedTuple):
    """Rows that become responses, with ``id``, ``uri``, ``payload``, ``bytes``, ``sha1``, ``name``; revisits have ``kept`` too."""
    responses: DataFrame
    revisits: DataFrame


def with_types(pages: DataFrame, least_bytes: int = 0, key: str = "page_id", payload: str = "html",
               uri: str = "url") -> Typed:
    """Responses with their payload, and revisits, which need none and come from a table without payloads.

    Of rows with equal payloads of at least ``least_bytes`` the one with the largest id is the
    response; no id comes before all others, and of rows that share the id as well any one is.
    Payloads are shuffled only where a bit set cannot rule out that they are repeated.
    """
    rows = pages.select(
        F.col(key).cast("long").alias("id"), F.col(uri).cast("string").alias("uri"),
        F.coalesce(F.col(payload).cast("string"), F.lit("")).alias("payload"),
    ).withColumns({"bytes": F.octet_length("payload").cast("long"), "sha1": F.sha1("payload")}).withColumn(
        "name", F.concat(F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit(":"), F.col("sha1")))
    # Frozen by writing: a row number may differ when computed again.
    slim = written(rows.where(F.col("bytes") >= least_bytes).drop("payload").withColumn(
        "row", F.monotonically_increasing_id()), "digests")
    # Counts and maxima are combined before the shuffle, so a payload of many pages is no hot task.
    copies = written(slim.groupBy("sha1").agg(
        F.max(F.struct("id", "row", "name", "uri")).alias("kept"), F.count("*").alias("n")).where("n > 1").drop("n"), "copies")
    repeated = written(slim.join(copies, "sha1").select("*", (F.col("row") == F.col("kept.row")).alias("is_kept")), "repeated")
    names = repeated.groupBy("name").agg(F.max("is_kept").alias("is_kept"), F.max("kept").alias("kept"))
    marked = _maybe(rows, F.xxhash64("name"), collected_bits(names, F.xxhash64("name")), F.col("bytes") >= least_bytes)
    certain = marked.where("not maybe").drop("maybe").withColumn(
        # No record refers to these; rows repeated below the limit have records of their own.
        "name", F.concat("name", F.lit(":"), F.monotonically_increasing_id().cast("string")))
    # One of each name; a name that is repeated stays only where it is the kept one.
    unsure = marked.where("maybe").drop("maybe").dropDuplicates(["name"]).join(names, "name", "left").where(
        "coalesce(is_kept, true)").withColumn("uri", F.when(F.col("kept").isNull(), F.col("uri")).otherwise(F.col("kept.uri")))
    revisits = repeated.where("not is_kept").withColumn("name", F.concat("name", F.lit(":"), F.col("row").cast("string")))
    columns = ["id", "uri", "payload", "bytes", "sha1", "name"]
    return Typed(certain.select(columns).unionByName(unsure.select(columns)),
                 revisits.select("id", "uri", "bytes", "sha1", "name", "kept"))


def _maybe(rows: DataFrame, key: Column, bits: np.ndarray, asked: Column) -> DataFrame:
    """Add ``maybe``: false where the bit set proves that the key is absent; the set is broadcast, 2 MB at most."""
    words = np.flatnonzero(bits)
    table = rows.sparkSession.createDataFrame(
        list(zip(words.tolist(), bits[words].view(np.int64).tolist(), strict=True)), "bit_word int, bit_mask long")
    at = F.pmod(key, F.lit(BLOOM_BITS))
    found = rows.withColumns({"bit_word": (at / 64).cast("int"), "bit": (at % 64).cast("int")}).join(
        F.broadcast(table), "bit_word", "left")
    return found.withColumn("maybe", asked & F.coalesce(
        F.expr("(shiftrightunsigned(bit_mask, bit) & 1L) = 1"), F.lit(False))).drop("bit_word", "bit", "bit_mask")


def _record(name: str, kind: str, date: str, more: Column, block: Column) -> Column:
    """A record as text, but for the two line breaks that end it."""
    # A line break inside a URL would end its header.
    safe = F.regexp_replace(F.regexp_replace("uri", "\r", "%0D"), "\n", "%0A")
    return F.concat(
        F.lit(f"{MARK}1{BREAK}WARC-Type: {kind}{BREAK}WARC-Record-ID: <{_PAGE}"), F.col(name),
        F.lit(f">{BREAK}WARC-Date: {date}{BREAK}"),
        F.coalesce(F.concat(F.lit("WARC-Target-URI: "), safe, F.lit(BREAK)), F.lit("")),
        F.lit("WARC-Payload-Digest: sha1:"), F.expr(_base32("sha1")), F.lit(BREAK), more,
        F.lit(f"Content-Type: application/http; msgtype=response{BREAK}Content-Length: "),
        F.octet_length(block).cast("string"), F.lit(BREAK * 2), block)


def records(typed: Typed, date: str) -> DataFrame:
    """One record a row, as text: HTTP headers and the payload for responses, the headers alone for revisits."""
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{BREAK}Content-Type: text/html; charset=utf-8{BREAK}Content-Length: "),
                    F.col("bytes").cast("string"), F.lit(BREAK * 2))
    refers = F.concat(
        F.lit(f"WARC-Refers-To: <{_PAGE}"), F.col("kept.name"),
        F.lit(f">{BREAK}WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest{BREAK}"))
    return typed.responses.select(
        _record("name", "response", date, F.lit(""), F.concat(http, F.col("payload"))).alias("value"),
    ).unionByName(typed.revisits.select(_record("name", "revisit", date, refers, http).alias("value")))


def write_archives(pages: DataFrame, path: str, least_bytes: int = 0, date: str = "1970-01-01T00:00:00Z",
                   **columns: str) -> None:
    """Monolithic gzip archives, one a task, with a record for each page; repeated payloads become revisits."""
    records(with_types(pages, least_bytes, **columns), date).write.option("lineSep", BREAK * 2).option(
        "compression", "gzip").text(path)


def header(head: bytes, name: str) -> str | None:
    found = re.search(rb"\r\n%b:[ \t]*([^\r\n]*)" % re.escape(name.encode()), head, re.IGNORECASE)
    return found[1].decode("utf-8", "replace") if found else None


def _split(record: bytes) -> tuple[bytes, bytes]:
    end = record.index(b"\r\n\r\n")
    return record[:end], record[end + 4:-4]


def whole_records(chunks: Iterator[tuple[str, bytes]]) -> Iterator[tuple[str, bytes]]:
    """Path and bytes of each record, from what lies between the marks of the files, in order.

    A payload may hold the mark as well, so a record ends where its length says.
    """
    path, held, wanted = None, bytearray(), None

    def end_of_file() -> None:
        if held:
            raise ValueError(f"{path} ends inside a record")

    for here, chunk in chunks:
        if here != path:
            end_of_file()
            path = here
            if chunk.strip():
                raise ValueError(f"{path} does not begin with a record")
            continue
        held += MARK.encode() + chunk
        if wanted is None:
            end = held.find(b"\r\n\r\n")
            if end < 0:
                continue
            length = header(bytes(held[:end]), "Content-Length")
            if length is None or not length.strip().isdecimal():
                raise ValueError(f"{path} has a record without a length")
            wanted = end + 4 + int(length) + 4
        if len(held) < wanted:
            continue
        if len(held) > wanted or held[-4:] != b"\r\n\r\n":
            raise ValueError(f"{path} has a record of another length than it says")
        yield path, bytes(held)
        held, wanted = bytearray(), None
    end_of_file()


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, bytes]]:
    for batch in batches:
        for path, value in zip(batch["path"], batch["value"], strict=True):
            yield path.as_py(), value.as_py()


def _member(record: bytes) -> bytes:
    packer = zlib.compressobj(wbits=31)
    return packer.compress(record) + packer.flush()


def _line(member: bytes) -> bytes:
    """A member without its last byte, which the line separator of the writer supplies: zero.

    The last byte is the top one of the record's length, zero below 16 MB; a longer record
    is followed by a member without content.
    """
    return (member if member[-1] == 0 else member + _EMPTY_MEMBER)[:-1]


def _members(limit: int):
    """Lines of archives, and lines of the index, with their archive and place."""
    def produce(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        made: list[tuple] = []
        held = 0
        path, part, number, offset = None, 0, 0, 0
        for here, record in whole_records(_chunks(batches)):
            if here != path:
                path, part, number, offset = here, 0, 0, 0
                stem = re.sub(r"[^A-Za-z0-9_-]", "_", unquote(here).rsplit("/", 1)[-1].split(".")[0])
                stem += "-" + hashlib.blake2b(here.encode(), digest_size=6).hexdigest()
            elif offset >= limit:
                part, number, offset = part + 1, 0, 0
            head, _ = _split(record)
            member = _member(record)
            line = _line(member)
            entry = json.dumps({
                "number": number, "offset": offset, "length": len(member), "record_type": header(head, "WARC-Type"),
                "record_id": header(head, "WARC-Record-ID"), "target_uri": header(head, "WARC-Target-URI")})
            archive = f"{stem}-{part:05d}"
            made += [("archives", archive, number, line), ("index", archive, number, entry.encode())]
            number += 1
            offset += len(line) + 1
            held += len(line)
            if held >= SLICE_BYTES or len(made) >= 4096:
                yield _columns(_LINES, made)
                made, held = [], 0
        if made:
            yield _columns(_LINES, made)
    return produce


def _columns(wanted: list, made: list[tuple]) -> dict:
    return dict(zip([f.name for f in wanted], map(list, zip(*made, strict=True)), strict=True))


def normalise(spark: SparkSession, source: str, target: str, limit: int = ARCHIVE_BYTES) -> None:
    """Rewrite the monolithic gzip archives below ``source`` to ``target``, with an index beside them.

    One pass: the task that inflates a file writes its archives, below ``part=archives``, and
    their index, below ``part=index``: JSON lines with each record's number, offset, length and
    main headers. An archive ends with the record that brings it to ``limit`` compressed bytes.
    """
    chunks = spark.read.option("lineSep", MARK).text(source).select(
        F.col("_metadata.file_path").alias("path"), F.col("value").cast("binary").alias("value"))
    (rows_from(chunks, _members(limit), _LINES).sortWithinPartitions("part", "archive", "number")
     .select("part", "archive", F.col("line").cast("string").alias("value"))
     .write.partitionBy("part", "archive").option("lineSep", "\0").text(target))


def payload_of(record: bytes) -> tuple[bytes, bytes, bytes]:
    """Headers, HTTP headers and payload; a block of another kind is all payload."""
    head, block = _split(record)
    if not (header(head, "Content-Type") or "").startswith("application/http"):
        return head, b"", block
    end = block.index(b"\r\n\r\n")
    return head, block[:end], block[end + 4:]


def _members_of(data: memoryview) -> Iterator[bytes]:
    """The content of one gzip member after the other."""
    at = 0
    while at < len(data):
        unpack, made = zlib.decompressobj(wbits=31), []
        while not unpack.eof:
            if at >= len(data):
                raise ValueError("the archive ends inside a member")
            made.append(unpack.decompress(data[at:at + WINDOW]))
            at += min(WINDOW, len(data) - at)
        at -= len(unpack.unused_data)
        yield b"".join(made)


def _opened(with_payload: bool, by_places: bool):
    def parse(record: bytes) -> tuple:
        head, http, payload = payload_of(record)
        kind, said = header(head, "WARC-Type"), header(head, "WARC-Payload-Digest")
        if kind == "revisit":
            # The payload is with the record referred to; the headers tell its length.
            n_bytes, found, payload = int(header(http, "Content-Length") or 0), (said or "").removeprefix("sha1:"), None
        else:
            n_bytes, found = len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()
            if said is not None and said != f"sha1:{found}":
                raise ValueError(f"{header(head, 'WARC-Record-ID')}: the payload's digest is {found}, not {said}")
        return (kind, header(head, "WARC-Record-ID"), header(head, "WARC-Target-URI"), header(head, "WARC-Refers-To"),
                n_bytes, found, payload if with_payload else None)

    def contents(batch: pa.RecordBatch) -> Iterator[bytes]:
        for row, content in enumerate(batch["content"]):
            data = memoryview(content.as_buffer())
            if not by_places:
                yield from _members_of(data)
                continue
            for start, length in zip(*(f.to_pylist() for f in batch["places"][row].values.flatten()), strict=True):
                yield zlib.decompress(data[start:start + length], wbits=31)

    def produce(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for batch in batches:
            made, held = [], 0
            # What follows a record of 16 MB or more has no content.
            for record in filter(None, contents(batch)):
                made.append(parse(record))
                held += len(made[-1][-1] or b"")
                if held >= SLICE_BYTES or len(made) >= 4096:
                    yield _columns(_READ, made)
                    made, held = [], 0
            if made:
                yield _columns(_READ, made)
    return produce


def read_index(spark: SparkSession, target: str) -> DataFrame:
    """archive, number, offset, length, record_type, record_id and target_uri of every record."""
    lines = spark.read.option("lineSep", "\0").text(f"{target}/part=index")
    return lines.select(F.col("archive").cast("string").alias("archive"), F.from_json(
        "value", "number long, offset long, length long, record_type string, record_id string, target_uri string",
    ).alias("entry")).select("archive", "entry.*")


def read_records(spark: SparkSession, target: str, index: DataFrame | None = None, payload: bool = False) -> DataFrame:
    """All records, or those that the given index rows name: type, ids, URI, length and digest of the full payload.

    With index rows only archives with such a record are opened and only these members are
    inflated. A task holds a few archives, whose size ``normalise`` bounds.
    """
    files = spark.read.format("binaryFile").load(f"{target}/part=archives").select(
        F.col("archive").cast("string").alias("archive"), "content")
    if index is not None:
        files = files.join(index.groupBy("archive").agg(
            F.sort_array(F.collect_list(F.struct("offset", "length"))).alias("places")), "archive")
    found = rows_from(files.drop("archive"), _opened(payload, index is not None), _READ)
    return found if payload else found.drop("payload")


def archive_pages(pages: DataFrame, least_bytes: int = 0, limit: int = ARCHIVE_BYTES) -> DataFrame:
    """Per page: page_id, payload_bytes, payload_digest, record_type and refers_to, read back from normalised archives.

    A null html is an empty payload, equal to other empty ones. Rows without a page_id come
    before all others; repeated rows are written each, and one of them is the response. Texts
    of any length are one record. An empty table gives no rows. Columns other than page_id, url
    and html are ignored.
    """
    spark = pages.sparkSession
    raw, target = scratch_path(spark, "monolithic"), scratch_path(spark, "warc")
    if pages.isEmpty():
        return spark.createDataFrame(
            [], "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")
    write_archives(pages, raw, least_bytes)
    normalise(spark, raw, target, limit)

    def page(name: str) -> Column:
        return F.nullif(F.regexp_extract(name, f"^<{_PAGE}(-?[0-9]*):", 1), F.lit("")).cast("long")

    return read_records(spark, target).select(
        page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        page("refers_to").alias("refers_to"))
