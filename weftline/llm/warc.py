"""Dictionary-compressed WARC archives (``.warc.zst``).

Each archive starts with a skippable frame (magic 0x184D2A5D) that holds a
Zstandard dictionary built from archived records; every record that follows is a
frame of its own, compressed with that dictionary. The records it is built from
are those whose ids have the smallest hashes, wherever they stand. Spark's text
writer puts the bytes into the shared file system and commits them, so a lost
executor only repeats its part. The writer needs a line separator: it is an
empty skippable frame, which any Zstandard reader passes over. A partition rolls
over to the next archive after ARCHIVE_FRAMES frames or ARCHIVE_BYTES bytes,
whatever its size, so an archive stays what one row can hold.

Defined results: null html is an empty payload; a null url is written as an
empty target URI; a null page_id is kept as null and never the one that others
refer to; rows that repeat the responding page_id with the same payload revisit
it but for one; an empty table gives an archive without records; extra columns
are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import shared_path, small_batches, stored, text_or_empty

DICTIONARY_MAGIC, FRAME_MAGIC = 0x184D2A5D, 0xFD2FB528
#: An empty skippable frame: magic 0x184D2A50 and length 0, all of it ASCII.
SEPARATOR = "P*M\x18\x00\x00\x00\x00"
#: Payloads below this many bytes are never revisits.
REVISIT_BYTES = 1000
#: Records sampled for the dictionary, and its size in bytes.
SAMPLES, DICTIONARY_BYTES = 256, 1 << 15
LEVEL = 3
#: Frames and bytes after which an archive ends and the next one starts; an archive is read as one row.
ARCHIVE_FRAMES, ARCHIVE_BYTES = 4096, 1 << 26
#: A skippable frame without content.
EMPTY = struct.pack("<II", 0x184D2A51, 0)
#: Bytes handed to the decompressor at a time; what is over goes to the next record.
PIECE = 1 << 13

COLUMNS = ("page_id", "url", "payload", "bytes", "digest", "refers_to")
ROWS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def routed(pages: DataFrame, least: int = REVISIT_BYTES) -> DataFrame:
    """page_id, url, payload, digest and refers_to (null for responses).

    The largest page_id of each digest is found from narrow partial sums; only
    digests that occur more than once are joined back. Of rows that share it
    and the payload, one is the response, with the smallest url.
    """
    payload = text_or_empty("html").cast("binary")
    rows = pages.select("page_id", text_or_empty("url").alias("url"), payload.alias("payload"), F.sha1(payload).alias("digest"))
    large = rows.where(F.octet_length("payload") >= least)
    by_page = large.groupBy("digest", "page_id").agg(F.count(F.lit(1)).alias("n"))
    first = by_page.groupBy("digest").agg(F.max(F.struct("page_id", "n")).alias("top"), F.sum("n").alias("n")).where("n > 1 and top.page_id is not null")
    # a table of its own: a frequent payload's rows can then be split in the join
    first = stored(first.select(F.col("digest").alias("d"), F.col("top.page_id").alias("holder"), F.col("top.n").alias("same")), "payload-holders")
    joined = rows.join(first, (F.col("digest") == F.col("d")) & (F.octet_length("payload") >= least), "left")
    other = F.col("holder").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("holder"))
    size = F.octet_length("payload").cast("long").alias("bytes")
    tied = ~other & (F.coalesce("same", F.lit(1).cast("long")) > 1)
    out = joined.select("page_id", "url", F.when(~other, F.col("payload")).alias("payload"), size, "digest", F.when(other, F.col("holder")).alias("refers_to"), tied.alias("tied"))
    if not first.where("same > 1").limit(1).count():
        return out.drop("tied")
    # rows that repeat a responding one, counted before they move
    same = out.where("tied").groupBy("digest", "page_id", "url").agg(F.count(F.lit(1)).alias("n"), F.first("payload").alias("payload"), F.first("bytes").alias("bytes"))
    nth = F.row_number().over(Window.partitionBy("digest").orderBy("url"))
    each = same.withColumn("nth", nth).select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("k"))
    one = (F.col("nth") == 1) & (F.col("k") == 1)
    each = each.select("page_id", "url", F.when(one, F.col("payload")).alias("payload"), "bytes", "digest", F.when(~one, F.col("page_id")).alias("refers_to"))
    return out.where("not tied").drop("tied").union(each)


def record(page_id: int | None, url: str, payload: bytes | None, size: int, digest: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record; a revisit (``payload`` None) has headers only."""
    body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if payload is not None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Target-URI: {url.replace(chr(13), '%0D').replace(chr(10), '%0A')}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}",
        "Content-Type: application/http; msgtype=response",
    ]
    if payload is None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    else:
        body += payload
    head.append(f"Content-Length: {len(body)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def build_dictionary(samples: list[bytes]) -> zstandard.ZstdCompressionDict:
    """Trained where the samples allow it, else their raw bytes."""
    if len(samples) >= 8 and sum(map(len, samples)) >= 8 * 1024:
        try:
            return zstandard.train_dictionary(min(DICTIONARY_BYTES, sum(map(len, samples)) // 4), samples, level=LEVEL)
        except zstandard.ZstdError:
            pass
    return zstandard.ZstdCompressionDict((b"".join(samples) or b"WARC/1.1\r\n")[-DICTIONARY_BYTES:].rjust(8, b" "), dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def dictionary_of(routes: DataFrame) -> bytes:
    """A dictionary from the records with the smallest hashes of their ids: SAMPLES rows reach the driver."""
    some = routes.orderBy(F.xxhash64("page_id"), "page_id").limit(SAMPLES).select(*COLUMNS).collect()
    return build_dictionary([record(*r) for r in sorted(some, key=lambda r: (r["page_id"] is None, r["page_id"] or 0, r["url"]))]).as_bytes()


def frames(records: Iterator[bytes], dictionary: bytes, most: int = ARCHIVE_FRAMES, size: int = ARCHIVE_BYTES) -> Iterator[bytes]:
    """Frames of archives, ``most`` to each: the dictionary, then one for each record; none without a record.

    An archive that has come to ``size`` bytes is filled up with empty frames, so
    that a writer which starts a file every ``most`` frames starts the next one.
    """
    coder, count, held = None, 0, 0
    for r in records:
        while count and count % most and held >= size:
            yield EMPTY
            count += 1
        if count % most == 0:
            yield struct.pack("<II", DICTIONARY_MAGIC, len(dictionary)) + dictionary
            count, held = count + 1, 0
        coder = coder or zstandard.ZstdCompressor(level=LEVEL, dict_data=dictionary_from(dictionary), write_checksum=True)
        frame = coder.compress(r)
        yield frame
        count, held = count + 1, held + len(frame)


def dictionary_from(raw: bytes) -> zstandard.ZstdCompressionDict:
    return zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_FULLDICT if raw[:4] == b"\x37\xa4\x30\xec" else zstandard.DICT_TYPE_RAWCONTENT)


def _write_part(batches: Iterator[pa.RecordBatch], dictionary: bytes, most: int = ARCHIVE_FRAMES, archive: int = ARCHIVE_BYTES) -> Iterator[pa.RecordBatch]:
    rows = (record(*(b.column(n)[k].as_py() for n in COLUMNS)) for b in batches for k in range(b.num_rows))
    held: list[bytes] = []
    size = 0
    for f in frames(rows, dictionary, most, archive):
        held.append(f)
        size += len(f)
        if size >= 1 << 22:
            yield pa.record_batch([pa.array(held, pa.binary())], names=["frame"])
            held, size = [], 0
    if held:
        yield pa.record_batch([pa.array(held, pa.binary())], names=["frame"])


def write(pages: DataFrame, path: str, most: int = ARCHIVE_FRAMES, size: int = ARCHIVE_BYTES) -> None:
    """Write the pages as archives into folder ``path``: of each partition, one for every ``most`` frames or ``size`` bytes."""
    routes = routed(pages)
    dictionary = dictionary_of(routes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _write_part(batches, dictionary, most, size)

    parts = small_batches(routes).mapInArrow(run, "frame binary")
    parts.select(F.col("frame").cast("string").alias("value")).write.option("lineSep", SEPARATOR).option("maxRecordsPerFile", most).option("compression", "none").text(path)


def parse_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of one record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    return fields, rest[: int(fields["Content-Length"])]


def records_of(archive: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """All records of one archive's bytes; raises if a frame is damaged."""
    view, at, reader = memoryview(archive), 0, zstandard.ZstdDecompressor()
    while at < len(view):
        (magic,) = struct.unpack_from("<I", view, at)
        if magic & 0xFFFFFFF0 == 0x184D2A50:
            (size,) = struct.unpack_from("<I", view, at + 4)
            if magic == DICTIONARY_MAGIC:
                reader = zstandard.ZstdDecompressor(dict_data=dictionary_from(bytes(view[at + 8 : at + 8 + size])))
            at += 8 + size
        else:
            one, parts = reader.decompressobj(), []
            while not one.eof:
                if at == len(view):
                    raise ValueError("an archive ends inside a record")
                parts.append(one.decompress(view[at : at + PIECE]))
                at = min(at + PIECE, len(view))
            at -= len(one.unused_data)
            yield parse_record(b"".join(parts))


def _number(urn: str) -> int | None:
    digits = urn.removeprefix("<urn:page:").removesuffix(">")
    return int(digits) if digits else None


def digest_row(fields: dict[str, str], block: bytes) -> tuple:
    """What a record says of its payload; a response's payload is hashed anew."""
    named = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    head, _, payload = block.partition(b"\r\n\r\n")
    size = int(head.rpartition(b"Content-Length: ")[2])
    if fields["WARC-Type"] == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != named):
        raise ValueError(f"payload of {fields['WARC-Record-ID']} differs from its digest")
    return _number(fields["WARC-Record-ID"]), size, named, fields["WARC-Type"], _number(fields["WARC-Refers-To"]) if "WARC-Refers-To" in fields else None


def _read_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    for b in batches:
        for archive in b.column("content"):
            rows = [digest_row(*r) for r in records_of(archive.as_py())]
            for k in range(0, len(rows), 10_000):
                yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*rows[k : k + 10_000], strict=True), kinds, strict=True)], names=names)


def read(spark: SparkSession, path: str) -> DataFrame:
    """One row a record of the archives in ``path``, checked against its digest."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select("content").mapInArrow(_read_part, ROWS)


def archive(pages: DataFrame) -> DataFrame:
    """Write ``pages`` as archives in the shared folder and read them back."""
    path = shared_path(pages.sparkSession, "warc")
    write(pages, path)
    return read(pages.sparkSession, path)
