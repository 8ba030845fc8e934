"""WARC archives compressed with Zstandard: one frame per record, the dictionary in a leading skippable frame.

Writing: each task writes archives of a bounded size into the shared folder, each under a name of its own, and
returns a line per finished archive; a task that is run again writes other files and only the lines of tasks that
count are kept. An archive's dictionary is made of the first records it holds, a bounded number of bytes.

Reading: each archive is read by one task as a stream, a record at a time: the dictionary from the skippable
frame, then frame by frame; headers, lengths and digests are checked, and a fault raises ArchiveError.

Defined results: a null payload is written as an empty one, a null URL as an empty one; a row without a key gets a
record without one, which is read with a null key, and is never the page that others refer to; payloads of any length
are one record; repeated rows give a record each; of copies, all rows with the largest key are responses; an empty
table gives no archive and an empty result; other columns are not looked at, whatever their names.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.llm.common import file_system, kept, shared_folder

#: Magic numbers of the format: the skippable frame that holds a dictionary, and a Zstandard frame.
SKIPPABLE, FRAME = 0x184D2A5D, 0xFD2FB528
VERSION = b"WARC/1.1"
MIN_REVISIT = 1000
ARCHIVE_BYTES = 64 << 20
#: Payload bytes from which an archive's dictionary is made, and its size.
SAMPLE_BYTES, DICTIONARY_BYTES = 2 << 20, 64 << 10
LEVEL = 3
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


class ArchiveError(ValueError):
    """An archive that breaks the format."""


# --- records ---------------------------------------------------------------------------------------------------


def record_bytes(kind: str, page: str, uri: str, payload: bytes, digest: str, refers_to: str | None, date: str) -> bytes:
    """A record: headers, an empty line, the block, two line ends. A revisit has no block; its payload's length and digest stand in the headers."""
    block = b"" if kind == "revisit" else payload
    headers = [
        ("WARC-Type", kind),
        ("WARC-Record-ID", f"<urn:page:{page}>"),
        ("WARC-Date", date),
        ("WARC-Target-URI", "".join(c for c in uri if c not in "\r\n")),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("X-Payload-Length", str(len(payload))),
        ("Content-Type", "text/html; charset=utf-8"),
        ("Content-Length", str(len(block))),
    ]
    if kind == "revisit":
        headers += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<urn:page:{refers_to}>")]
    head = VERSION + b"\r\n" + b"".join(f"{k}: {v}\r\n".encode() for k, v in headers)
    return head + b"\r\n" + block + b"\r\n\r\n"


def parse(record: bytes) -> tuple[dict[str, str], bytes]:
    """(headers, block) of a decoded record; checks its version, headers, length and end."""
    end = record.find(b"\r\n\r\n")
    if end < 0:
        raise ArchiveError("a record's headers don't end")
    lines = record[:end].split(b"\r\n")
    if lines[0] != VERSION:
        raise ArchiveError(f"not a WARC record: {lines[0][:20]!r}")
    headers: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.decode().partition(":")
        if not colon or not name or name.lower() in headers:
            raise ArchiveError(f"a header that can't be read or stands twice: {line[:60]!r}")
        headers[name.lower()] = value.strip()
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in headers:
            raise ArchiveError(f"a record without {name}")
    if not headers["content-length"].isdigit():
        raise ArchiveError("a content length that is no number")
    block = record[end + 4 : -4]
    if record[-4:] != b"\r\n\r\n" or len(record) < end + 8 or len(block) != int(headers["content-length"]):
        raise ArchiveError(f"content length {headers['content-length']}, block {len(block)}")
    return headers, block


# --- archives --------------------------------------------------------------------------------------------------


def make_dictionary(samples: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """Trained where there are samples enough, else their own bytes; empty without any."""
    joined = sum(map(len, samples))
    if len(samples) >= 16 and joined > 8 * size:
        try:
            return zstandard.train_dictionary(size, samples).as_bytes()
        except zstandard.ZstdError:
            pass
    return b"".join(samples)[:size]


class ArchiveWriter:
    """Writes records to a binary stream. ``dictionary`` goes into the leading skippable frame, itself compressed."""

    def __init__(self, out, dictionary: bytes):
        self.out, self.written, self.records = out, 0, 0
        held = zstandard.ZstdCompressor(level=LEVEL).compress(dictionary)
        self._put(struct.pack("<II", SKIPPABLE, len(held)) + held)
        given = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        self.compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=given, write_content_size=True, write_checksum=True)

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.written += len(data)

    def add(self, record: bytes) -> None:
        self._put(self.compressor.compress(record))
        self.records += 1


class ArchiveReader:
    """Iterates over (offset, length, headers, block) of an archive's records, one frame at a time."""

    CHUNK = 1 << 16

    def __init__(self, source, max_record: int = 2**31 - 1):
        self.source, self.buffer, self.offset, self.max_record = source, b"", 0, max_record
        magic, size = struct.unpack("<II", self._need(8))
        if magic != SKIPPABLE:
            raise ArchiveError("no dictionary frame in front")
        held = self._take(8 + size)[8:]
        dictionary = held
        if held[:4] == struct.pack("<I", FRAME):
            dictionary = zstandard.ZstdDecompressor().decompressobj().decompress(held)
        given = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        self.decompressor = zstandard.ZstdDecompressor(dict_data=given)

    def _fill(self) -> bool:
        more = self.source.read(self.CHUNK)
        self.buffer += more
        return bool(more)

    def _need(self, n: int) -> bytes:
        while len(self.buffer) < n:
            if not self._fill():
                raise ArchiveError("the archive ends within a frame")
        return self.buffer[:n]

    def _take(self, n: int) -> bytes:
        out, self.buffer = self._need(n), self.buffer[n:]
        self.offset += n
        return out

    def __iter__(self) -> Iterator[tuple[int, int, dict[str, str], bytes]]:
        while self.buffer or self._fill():
            start = self.offset
            if struct.unpack("<I", self._need(4))[0] != FRAME:
                raise ArchiveError(f"no frame at {start}")
            try:
                size = zstandard.frame_content_size(self._need(18) if len(self.buffer) >= 18 or self._more(18) else self.buffer)
            except zstandard.ZstdError as e:
                raise ArchiveError(f"a broken frame header at {start}") from e
            if size > self.max_record:
                raise ArchiveError(f"a record of {size} bytes at {start}")
            one, parts, length = self.decompressor.decompressobj(), [], 0
            try:
                while not one.eof:
                    if not self.buffer and not self._fill():
                        raise ArchiveError(f"the archive ends within the frame at {start}")
                    given = len(self.buffer)
                    parts.append(one.decompress(self.buffer))
                    length += len(parts[-1])
                    if length > self.max_record:
                        raise ArchiveError(f"a record of over {self.max_record} bytes at {start}")
                    self.buffer = one.unused_data
                    self.offset += given - len(self.buffer)
            except zstandard.ZstdError as e:
                raise ArchiveError(f"a broken frame at {start}: {e}") from e
            if size >= 0 and size != length:
                raise ArchiveError(f"the frame at {start} tells of {size} bytes and holds {length}")
            yield start, self.offset - start, *parse(b"".join(parts))

    def _more(self, n: int) -> bool:
        while len(self.buffer) < n and self._fill():
            pass
        return len(self.buffer) >= n


def check_block(headers: dict[str, str], block: bytes) -> None:
    """The digest and length of a record that carries its payload."""
    if headers["warc-type"] != "revisit":
        if headers.get("warc-payload-digest", "sha1:").removeprefix("sha1:") != hashlib.sha1(block).hexdigest():
            raise ArchiveError(f"{headers['warc-record-id']}: the payload has another digest")
        if headers.get("x-payload-length", str(len(block))) != str(len(block)):
            raise ArchiveError(f"{headers['warc-record-id']}: the payload has another length")


# --- tables ----------------------------------------------------------------------------------------------------


def marked(pages: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html", min_revisit: int = MIN_REVISIT) -> DataFrame:
    """Adds to (key, url, payload) the payload's SHA-1 and the page to which it refers, or null. Copies are found over digests alone; the payload of a page moves at most once, and only digests that occur twice are joined."""
    body = F.coalesce(F.col(payload), F.lit("")).cast("binary")
    rows = pages.select(F.col(key), F.col(url).alias("_url"), body.alias("_body")).withColumn("_digest", F.sha1("_body"))
    large = rows.where(F.length("_body") >= min_revisit).select("_digest", key)
    copies = large.groupBy("_digest").agg(F.max(key).alias("_first"), F.count("*").alias("_n")).where("_n > 1").select(F.col("_digest").alias("_d"), "_first")
    joined = rows.join(copies, (F.col("_digest") == F.col("_d")) & (F.length("_body") >= min_revisit), "left")
    return joined.select(key, "_url", "_body", "_digest", F.when(~F.col("_first").eqNullSafe(F.col(key)), F.col("_first")).alias("_refers"))


def write(pages: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html", folder: str | None = None, date: str = "1970-01-01T00:00:00Z", archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes all rows; returns the table of archives: archive (address), n_records, n_bytes."""
    spark = pages.sparkSession
    folder = folder or shared_folder(spark, "warc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = file_system(folder)
        system.create_dir(root, recursive=True)
        done, writer, out, name, held = [], None, None, "", []

        def begin():
            nonlocal writer, out, name
            name = f"{uuid.uuid4().hex}.warc.zst"
            out = system.open_output_stream(f"{root}/{name}.part", compression=None)
            samples, size = [], 0
            for row in held:
                if size < SAMPLE_BYTES:
                    samples.append(row[2][: 64 << 10])
                    size += len(samples[-1])
            writer = ArchiveWriter(out, make_dictionary([x for x in samples if x]))

        def put():
            for page, uri, body, digest, refers in held:
                writer.add(record_bytes("response" if refers is None else "revisit", "" if page is None else str(page), uri or "", body, digest, None if refers is None else str(refers), date))
            held.clear()

        def end():
            nonlocal writer
            out.close()
            system.move(f"{root}/{name}.part", f"{root}/{name}")
            done.append((f"{folder}/{name}", writer.records, writer.written))
            writer = None

        size = 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                held.append(row)
                size += len(row[2])
                if writer is None and size >= SAMPLE_BYTES:
                    begin()
                if writer is not None and (size >= SAMPLE_BYTES or len(held) >= 1000):
                    put()
                    size = 0
                    if writer.written >= archive_bytes:
                        end()
        if held and writer is None:
            begin()
        if writer is not None:
            put()
            end()
        yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64()))], names=["archive", "n_records", "n_bytes"])

    return kept(marked(pages, key, url, payload).mapInArrow(run, "archive string, n_records bigint, n_bytes bigint"), "archives")


def read(spark: SparkSession, archives: DataFrame, payloads: bool = True) -> DataFrame:
    """A row for each record of the table of archives: archive, offset, length, record_id, record_type, target_uri, payload_bytes, payload_digest, refers_to (page), and the payload where asked for. Raises where an archive breaks the format or has another number of records than the table tells."""
    fields = [("archive", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("page", pa.string()), ("record_type", pa.string()), ("target_uri", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.string()), ("payload", pa.binary())]
    fields = fields if payloads else fields[:-1]

    def bare(record_id: str | None) -> str | None:
        return (record_id and record_id.removeprefix("<urn:page:").removesuffix(">")) or None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch_of(rows):
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, (_, t) in enumerate(fields)], names=[n for n, _ in fields])

        for batch in batches:
            for address, told in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                system, path = file_system(address)
                rows, size, n = [], 0, 0
                with system.open_input_stream(path, compression=None) as source:
                    for offset, length, headers, block in ArchiveReader(source):
                        check_block(headers, block)
                        n += 1
                        digest = headers.get("warc-payload-digest", "").removeprefix("sha1:")
                        row = (address, offset, length, bare(headers["warc-record-id"]), headers["warc-type"], headers.get("warc-target-uri"), int(headers.get("x-payload-length", len(block))), digest, bare(headers.get("warc-refers-to")), block)
                        rows.append(row[: len(fields)])
                        size += len(block) if payloads else 0
                        if len(rows) >= 2000 or size > 8 << 20:
                            yield batch_of(rows)
                            rows, size = [], 0
                if n != told:
                    raise ArchiveError(f"{address}: {n} records, not {told}")
                if rows:
                    yield batch_of(rows)

    kinds = {pa.string(): "string", pa.int64(): "bigint", pa.binary(): "binary"}
    listed = archives.select("archive", "n_records").repartition(max(1, min(10_000, archives.count())), "archive")
    return listed.mapInArrow(run, ", ".join(f"{n} {kinds[t]}" for n, t in fields))
