"""Zstandard web archives (.warc.zst): a writer, and a reader that validates what it reads.

An archive begins with a skippable frame that holds the dictionary; each record is a frame of its
own. The writer trains a dictionary on the first records of each partition (SAMPLE of them at most;
it only serves compression). Files are written straight to the shared folder under names of their
own for each attempt of a task; the manifest, committed by Spark, names those that count. The reader
streams each archive, decodes frame by frame, and checks headers, lengths and digests.

Of records with equal payloads of ``min_bytes`` or more, the one with the smallest page_id is a
response; the others are revisits, whose block has the HTTP headers only.

Defined results: a null html is an empty payload. Null page_ids come after all others; rows of the
smallest page_id are all responses. A null url is the empty URI. An empty table gives no archive.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

#: The skippable frame's magic number for a dictionary, and those of a plain dictionary and of a compressed one.
SKIPPABLE, DICTIONARY, FRAME = 0x184D2A5D, 0xEC30A437, 0xFD2FB528
SAMPLE, DICT_BYTES, ARCHIVE_BYTES = 200, 32_768, 64_000_000
#: Rows of about 60 bytes.
BROADCAST_ROWS = 200_000
#: Beyond that, payloads that more than one page in so many has, which are fewer than that, are broadcast; the others are shuffled.
HOT_KEYS = 1_000
DATE = "2024-01-01T00:00:00Z"
REQUIRED = ("warc-type", "warc-record-id", "warc-date", "content-length")
RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary, error string"


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}>"


def page_of(record: str) -> int | None:
    found = record.removeprefix("<urn:page:").removesuffix(">")
    return None if found == "null" else int(found)


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {quote(url or '', safe=':/?#[]@!$&()*+,;=%~')}", f"WARC-Payload-Digest: sha1:{digest(payload)}", f"WARC-Block-Digest: sha1:{digest(block)}", "Content-Type: application/http; msgtype=response"]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to)}"]
    return "\r\n".join([*head, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"


def headers(lines: bytes) -> dict[str, str]:
    out = {}
    for line in lines.decode().split("\r\n"):
        name, colon, value = line.partition(":")
        if not colon or not name.strip():
            raise ValueError(f"header without a name: {line[:80]!r}")
        out[name.strip().lower()] = value.strip()
    return out


def parse(data: bytes) -> tuple:
    """The fields of RECORD but the error; ValueError says what is wrong."""
    top, blank, rest = data.partition(b"\r\n\r\n")
    version, _, lines = top.partition(b"\r\n")
    if not blank or version not in (b"WARC/1.0", b"WARC/1.1"):
        raise ValueError("no WARC version line and header block")
    head = headers(lines)
    if missing := [x for x in REQUIRED if x not in head]:
        raise ValueError(f"headers missing: {', '.join(missing)}")
    length = int(head["content-length"])
    block, tail = rest[:length], rest[length:]
    if len(block) != length or tail != b"\r\n\r\n":
        raise ValueError(f"Content-Length {length} doesn't fit the {len(rest) - 4} bytes of the block")
    if (given := head.get("warc-block-digest")) and given != f"sha1:{digest(block)}":
        raise ValueError("block digest differs")
    http, blank, payload = block.partition(b"\r\n\r\n")
    status, _, lines = http.partition(b"\r\n")
    if not blank or not status.startswith(b"HTTP/"):
        raise ValueError("no HTTP header block")
    size, given = int(headers(lines)["content-length"]), head.get("warc-payload-digest", "")
    kind = head["warc-type"]
    if kind == "response" and (size != len(payload) or given != f"sha1:{digest(payload)}"):
        raise ValueError("payload length or digest differs")
    if kind not in ("response", "revisit") or kind == "revisit" and (payload or "warc-refers-to" not in head):
        raise ValueError(f"not a whole response or revisit record: {kind}")
    refers = page_of(head["warc-refers-to"]) if kind == "revisit" else None
    return page_of(head["warc-record-id"]), size, given.removeprefix("sha1:"), kind, refers, head.get("warc-target-uri", ""), payload


def dictionary_frame(samples: list[bytes], size: int = DICT_BYTES):
    """The skippable frame and the dictionary; nothing where the samples are too few to train on."""
    import zstandard

    try:
        trained = zstandard.train_dictionary(size, samples)
    except zstandard.ZstdError:
        return b"", None
    packed = zstandard.ZstdCompressor(level=9).compress(trained.as_bytes())
    return struct.pack("<II", SKIPPABLE, len(packed)) + packed, trained


def frames(read) -> Iterator[bytes]:
    """The decoded frames of an archive; read(n) gives up to n bytes."""
    import zstandard

    buffer, dictionary = read(8), None
    if len(buffer) == 8 and struct.unpack("<I", buffer[:4])[0] == SKIPPABLE:
        size = struct.unpack("<I", buffer[4:])[0]
        raw = b""
        while len(raw) < size and (more := read(size - len(raw))):
            raw += more
        if len(raw) != size:
            raise ValueError("the dictionary's frame is cut short")
        if struct.unpack("<I", raw[:4])[0] == FRAME:
            raw = zstandard.ZstdDecompressor().decompress(raw)
        if struct.unpack("<I", raw[:4])[0] != DICTIONARY:
            raise ValueError("the first frame holds no dictionary")
        dictionary, buffer = zstandard.ZstdCompressionDict(raw), b""
    decoder = zstandard.ZstdDecompressor(dict_data=dictionary) if dictionary else zstandard.ZstdDecompressor()
    while buffer or (buffer := read(1 << 16)):
        one, out = decoder.decompressobj(), []
        while not one.eof:
            if not buffer and not (buffer := read(1 << 16)):
                raise ValueError("the last frame is cut short")
            out.append(one.decompress(buffer))
            buffer = b""
        buffer = one.unused_data
        yield b"".join(out)


def with_revisits(pages: DataFrame, min_bytes: int = 0, scratch: Scratch | None = None) -> DataFrame:
    """page_id, url, payload (the html), refers_to and revisit.

    The payloads that several pages have are counted first; a table of up to BROADCAST_ROWS of them is
    broadcast, so that pages aren't shuffled. Of a larger one, the payloads that very many pages have (the empty
    one, say) are broadcast, and pages of the others are joined by a shuffle, no key of which is hot."""
    scratch = scratch or Scratch(pages.sparkSession, "revisits")
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce("html", F.lit("")).alias("payload"))
    base = base.withColumn("key", F.when(F.octet_length("payload") >= min_bytes, F.sha1("payload")))
    several = base.where("key IS NOT NULL").groupBy("key").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select(F.col("key").alias("_key"), "first", "n")
    several = scratch.save(several, "several")
    if several.count() <= BROADCAST_ROWS:
        joined = base.join(F.broadcast(several), F.col("key") == F.col("_key"), "left")
    else:
        hot = F.col("n") * HOT_KEYS > base.count()
        tested = base.join(F.broadcast(several.where(hot)), F.col("key") == F.col("_key"), "left")
        others = tested.where("_key IS NULL AND key IS NOT NULL").select(*base.columns).join(several.where(~hot), F.col("key") == F.col("_key"), "left")
        joined = tested.where("_key IS NOT NULL OR key IS NULL").unionByName(others)
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return joined.select("page_id", "url", "payload", F.when(revisit, F.col("first")).alias("refers_to"), revisit.alias("revisit"))


def write_archives(records: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES, level: int = 3) -> DataFrame:
    """Writes records (of with_revisits) when run; path, records and bytes of each archive."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        from pyarrow import fs as pafs

        fs, base = pafs.FileSystem.from_uri(folder)
        fs.create_dir(base, recursive=True)
        task = TaskContext.get()
        name = f"part-{task.partitionId():06d}-{task.taskAttemptId()}"
        rows = (row for batch in batches for lo in range(0, batch.num_rows, SAMPLE) for row in zip(*(c.to_pylist() for c in batch.slice(lo, SAMPLE).columns)))
        held, made, out, done = [], 0, None, []
        frame, trained = b"", None
        compressor = None

        def put(data: bytes) -> None:
            nonlocal out, made
            if out is None:
                done.append([f"{folder}/{name}-{len(done):04d}.warc.zst", 0, 0])
                out, made = fs.open_output_stream(f"{base}/{name}-{len(done) - 1:04d}.warc.zst", compression=None), 0
                out.write(frame)
            packed = compressor.compress(data)
            out.write(packed)
            made += len(packed)
            done[-1][1] += 1
            done[-1][2] += len(packed)
            if made >= archive_bytes:
                out.close()
                out = None

        def begin() -> None:
            nonlocal frame, trained, compressor
            frame, trained = dictionary_frame([x[:DICT_BYTES] for x in held])
            compressor = zstandard.ZstdCompressor(level=level, dict_data=trained) if trained else zstandard.ZstdCompressor(level=level)
            for x in held:
                put(x)
            held.clear()

        for page_id, url, payload, refers_to, revisit in rows:
            data = record(page_id, url, payload.encode(), refers_to, revisit)
            if compressor:
                put(data)
                continue
            held.append(data)
            if len(held) >= SAMPLE or sum(map(len, held)) > 16_000_000:
                begin()
        if held:
            begin()
        if out is not None:
            out.close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*done)], ["path", "records", "bytes"])

    return records.select("page_id", "url", "payload", "refers_to", "revisit").mapInArrow(run, "path string, records long, bytes long")


def read_archives(paths: DataFrame, payloads: bool = True) -> DataFrame:
    """A row of RECORD for each frame of the archives at ``path``; error is null for a valid record."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs as pafs

        names = [f.split()[0] for f in RECORD.split(", ")]
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary(), pa.string()]

        def flush(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

        rows, held = [], 0
        for batch in batches:
            for path in batch.column(0).to_pylist():
                fs, at = pafs.FileSystem.from_uri(path)
                with fs.open_input_stream(at, compression=None) as f:
                    try:
                        for data in frames(f.read):
                            try:
                                row = (*parse(data), None)
                            except (ValueError, KeyError) as e:
                                row = (None,) * 7 + (f"{path}: {e}",)
                            rows.append(row if payloads else (*row[:6], None, row[7]))
                            held += len(data) if payloads else 200
                            if held > 4_000_000:
                                yield flush(rows)
                                rows, held = [], 0
                    except Exception as e:  # what zstandard raises for a damaged frame: the rest of the archive can't be read
                        rows.append((None,) * 7 + (f"{path}: {type(e).__name__}: {e}",))
        if rows:
            yield flush(rows)

    return paths.select("path").mapInArrow(run, RECORD)


def round_trip(pages: DataFrame, min_bytes: int = 0, payloads: bool = False, scratch: Scratch | None = None) -> DataFrame:
    """The records read back from archives written of pages; an invalid record ends the query with its error."""
    spark = pages.sparkSession
    scratch = scratch or Scratch(spark, "warc")
    manifest = scratch.save(write_archives(with_revisits(pages, min_bytes, scratch), scratch.path("archives")), "manifest")
    spread = manifest.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")))
    read = read_archives(spread, payloads)
    return read.withColumn("record_type", F.when(F.col("error").isNull(), F.col("record_type")).otherwise(F.raise_error("error")))
