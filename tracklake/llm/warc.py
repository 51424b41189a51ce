"""WARC archives of individually compressed records with a dictionary in a leading skippable frame.

Every archive is a sequence of Zstandard frames. The first is a skippable frame that holds a dictionary
built from the archive's first records; each record after it is a frame of its own, compressed with that
dictionary, so a reader needs one archive and nothing else, and can start at any record.

Spark's text sink writes the archives: one line is one frame, and the line separator is itself an empty
skippable frame, which every Zstandard decoder passes over. So the files are committed by Spark, through
whatever file system holds the folder, a lost task is simply run again, and no task writes a file of its
own. A frame that happens to contain the separator is made anew with a checksum.

Records with equal payloads of at least ``least`` bytes: the one with the smallest page_id is a response,
the others are revisits that refer to it. Defined results: null html is an empty payload; a null url has no
target header; rows that repeat the smallest page_id are all responses, with one record id; a row without a
page_id revisits unless no equal payload has one; html of any length is one record; other columns play no part;
an empty table gives an empty result. An archive has ``records`` frames at most, so a reader that takes one whole
needs bounded memory.
"""

from __future__ import annotations

import base64
import hashlib
import itertools
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import rekey, shared_dir

#: Magic numbers of skippable frames: the dictionary's, and an empty one as separator.
DICTIONARY_MAGIC = b"\x5d\x2a\x4d\x18"
SEPARATOR = b"\x50\x2a\x4d\x18\x00\x00\x00\x00"
#: A dictionary is built from an archive's first records, up to this many bytes.
SAMPLE_BYTES, DICTIONARY_BYTES = 2 << 20, 32 << 10
LEVEL = 3
#: The frames of an archive, its dictionary's included.
RECORDS = 8192


def sha1_base32(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1 of a binary column: four base-32 digits from every five hex digits."""
    digits = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(digits, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def deduplicated(pages: DataFrame, least: int = 0) -> DataFrame:
    """page_id, url, payload, digest, n_bytes and the page_id (first) that an equal payload's response has."""
    rows = pages.select("page_id", "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    rows = rows.select("*", sha1_base32(F.col("payload")).alias("digest"), F.octet_length("payload").cast("long").alias("n_bytes"))
    narrow = pages.select("page_id", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    narrow = narrow.select("page_id", sha1_base32(F.col("payload")).alias("digest"))
    first = narrow.groupBy("digest").agg(F.min("page_id").alias("first"))
    first = first.select(rekey(F.col("digest"), "string").alias("d"), "first")
    rows = rows.join(first, rows["digest"] == first["d"]).drop("d")
    revisit = (F.col("n_bytes") >= least) & ~F.col("page_id").eqNullSafe(F.col("first"))
    return rows.withColumn("refers_to", F.when(revisit, F.col("first"))).withColumn("payload", F.when(~revisit, F.col("payload")))


def _line(text: str) -> str:
    """A header value without control characters."""
    return "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in text)


def record(page_id: int | None, url: str | None, payload: bytes | None, digest: str, n_bytes: int, refers_to: int | None) -> bytes:
    """One WARC record; a revisit (payload None) has the headers of the response it repeats, without its body."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n_bytes}\r\n\r\n".encode()
    block = http + (payload or b"")
    headers = [("WARC-Type", "response" if payload is not None else "revisit")]
    headers += [("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}')}>"), ("WARC-Date", "1970-01-01T00:00:00Z")]
    headers += [("WARC-Target-URI", _line(url))] if url is not None else []
    headers += [("WARC-Payload-Digest", f"sha1:{digest}"), ("X-Payload-Length", str(n_bytes))]
    headers += [("X-Page-Id", str(page_id))] if page_id is not None else []
    if payload is None:
        headers += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{refers_to}:{digest}')}>"), ("X-Refers-To-Page", str(refers_to))]
    headers += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers) + "\r\n"
    return head.encode() + block + b"\r\n\r\n"


def build_dictionary(samples: list[bytes]) -> zstandard.ZstdCompressionDict:
    """A trained dictionary; where the samples are too few for training, their bytes themselves."""
    pieces = [s[i : i + 8192] for s in samples for i in range(0, len(s), 8192)]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, pieces, k=256, d=8)
    except zstandard.ZstdError:
        return zstandard.ZstdCompressionDict(b"".join(samples)[:DICTIONARY_BYTES] or b"WARC/1.1\r\n", dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def frames(records: Iterator[bytes], most: int = RECORDS) -> Iterator[bytes]:
    """The frames of archives of ``most`` frames (the last may have fewer): each the dictionary, then a frame for each record."""
    records = iter(records)
    while first := list(itertools.islice(records, 1)):
        yield from _one_archive(itertools.chain(first, itertools.islice(records, most - 2)))


def _one_archive(records: Iterator[bytes]) -> Iterator[bytes]:
    samples, held = [], 0
    for r in records:
        samples.append(r)
        held += len(r)
        if held >= SAMPLE_BYTES:
            break
    dictionary = build_dictionary(samples)
    body = dictionary.as_bytes()
    yield DICTIONARY_MAGIC + len(body).to_bytes(4, "little") + body
    plain = zstandard.ZstdCompressor(level=LEVEL, dict_data=dictionary, write_content_size=True)
    marked = zstandard.ZstdCompressor(level=LEVEL, dict_data=dictionary, write_content_size=True, write_checksum=True)
    for r in itertools.chain(samples, records):
        frame = plain.compress(r)
        yield marked.compress(r) if SEPARATOR in frame else frame


def _archive(batches: Iterable[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    def records() -> Iterator[bytes]:
        for batch in batches:
            for row in zip(*batch.columns, strict=True):
                yield record(*(x.as_py() for x in row))

    out, held = [], 0
    for frame in frames(records(), most):
        out.append(frame)
        held += len(frame)
        if held >= 4 << 20:
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["frame"])
            out, held = [], 0
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["frame"])


def write(pages: DataFrame, path: str, least: int = 0, records: int = RECORDS) -> None:
    """Archives of all pages in the folder ``path``: of each task as many as its records need."""
    rows = deduplicated(pages, least).select(F.col("page_id").cast("long"), "url", "payload", "digest", "n_bytes", F.col("refers_to").cast("long"))
    archives = rows.mapInArrow(lambda batches: _archive(batches, records), "frame binary").select(F.col("frame").cast("string").alias("value"))
    # the sink begins a new file after as many rows as an archive has frames
    archives.write.option("lineSep", SEPARATOR.decode("latin-1")).option("maxRecordsPerFile", records).text(path)


def records_of(archive: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and content block of every record of an archive."""
    if archive[:4] != DICTIONARY_MAGIC:
        raise ValueError("an archive begins with its dictionary")
    size = int.from_bytes(archive[4:8], "little")
    body = archive[8 : 8 + size]
    trained = body[:4] == b"\x37\xa4\x30\xec"
    dictionary = zstandard.ZstdCompressionDict(body, dict_type=zstandard.DICT_TYPE_FULLDICT if trained else zstandard.DICT_TYPE_RAWCONTENT)
    decompressor = zstandard.ZstdDecompressor(dict_data=dictionary)
    rest = memoryview(archive)[8 + size :]
    while rest.nbytes:
        if rest[:4].tobytes()[1:] == b"\x2a\x4d\x18" and 0x50 <= rest[0] <= 0x5F:
            rest = rest[8 + int.from_bytes(rest[4:8], "little") :]
            continue
        part = decompressor.decompressobj()
        data = [part.decompress(rest[: 1 << 16])]
        at = min(1 << 16, rest.nbytes)
        while not part.eof:
            if at == rest.nbytes:
                raise ValueError("the archive ends inside a record")
            data.append(part.decompress(rest[at : at + (1 << 20)]))
            at = min(at + (1 << 20), rest.nbytes)
        rest = rest[at - len(part.unused_data) :]
        head, _, tail = b"".join(data).partition(b"\r\n\r\n")
        headers = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
        yield headers, tail[: int(headers["Content-Length"])]


def _read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "target_uri"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
    for batch in batches:
        for archive in batch.column(0):
            rows = []
            for headers, block in records_of(archive.as_py()):
                digest, size = headers["WARC-Payload-Digest"].removeprefix("sha1:"), int(headers["X-Payload-Length"])
                if headers["WARC-Type"] == "response":
                    payload = block.partition(b"\r\n\r\n")[2]
                    digest, size = base64.b32encode(hashlib.sha1(payload).digest()).decode(), len(payload)
                number = lambda k: int(headers[k]) if k in headers else None  # noqa: B023, E731
                rows.append((number("X-Page-Id"), size, digest, headers["WARC-Type"], number("X-Refers-To-Page"), headers.get("WARC-Target-URI")))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)


def read(spark, path: str) -> DataFrame:  # noqa: ANN001
    """One row for each record of the archives in ``path``; size and digest of responses are measured again."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).where("length > 0").select("content")
    return files.mapInArrow(_read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, target_uri string")


def round_trip(pages: DataFrame, least: int = 0) -> DataFrame:
    """Write the pages to archives in the shared folder and read them back."""
    spark = pages.sparkSession
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write(pages, path, least)
    return read(spark, path)
