"""WARC archives of captured pages, and an index of two levels to read single records."""

import base64
import hashlib
import json
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from articlelake.llm.common import rows_of, stored
from articlelake.llm.urls import host_of
from articlelake.session import shared_folder

#: Bytes after which a task starts another archive, lines of an index block, captures of an
#: index shard, and the stretch of an archive that one task reads.
ARCHIVE_BYTES, BLOCK_LINES, SHARD_CAPTURES, STRETCH = 256_000_000, 2_000, 1_000_000, 64_000_000
CAPTURE = "key string, page_id long, file string, offset long, length long"
#: Fixed value: the profile of revisit records in the WARC standard.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


class _Output:
    """A file in the shared folder, named for this attempt; others' leftovers are never read."""

    def __init__(self, folder: str, kind: str):
        import uuid

        from pyarrow import fs

        system, path = fs.FileSystem.from_uri(folder)
        self.name = f"{kind}-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}"
        system.create_dir(path, recursive=True)
        self.stream, self.size = system.open_output_stream(f"{path}/{self.name}"), 0

    def append(self, data: bytes) -> tuple[int, int]:
        self.stream.write(data)
        self.size += len(data)
        return self.size - len(data), len(data)


class _Inputs:
    """Files of a shared folder, the last one kept open, for reading ranges of bytes."""

    def __init__(self, folder: str):
        from pyarrow import fs

        (self.system, self.path), self.name = fs.FileSystem.from_uri(folder), None

    def read(self, name: str, offset: int, length: int) -> bytes:
        if name != self.name:
            if self.name:
                self.file.close()
            self.file, self.name = self.system.open_input_file(f"{self.path}/{name}"), name
        return self.file.read_at(length, offset)

    def whole(self, name: str) -> bytes:
        with self.system.open_input_stream(f"{self.path}/{name}") as stream:
            return stream.read()


def packed(data: bytes) -> bytes:
    """One gzip member."""
    made = zlib.compressobj(6, zlib.DEFLATED, 31)
    return made.compress(data) + made.flush()


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page: int | None, url: str | None, payload: bytes, date: str, refers_to: int | None) -> bytes:
    """A response record, or a revisit of the page that holds the same payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if refers_to is None else b"")
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page is None else page}>", f"WARC-Date: {date}"]
    if url:
        lines.append("WARC-Target-URI: " + "".join(c if c.isprintable() else "".join(f"%{b:02X}" for b in c.encode("utf-8", "replace")) for c in url))
    lines.append(f"WARC-Payload-Digest: sha1:{digest_of(payload)}")
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parsed(data: bytes) -> dict:
    """Page, sizes, digest, kind and payload of a record; a damaged one raises ValueError."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(next(x for x in http.decode().split("\r\n") if x.startswith("Content-Length: "))[16:])
    digest, kind = fields["WARC-Payload-Digest"].removeprefix("sha1:"), fields["WARC-Type"]
    if kind == "response" and (len(payload) != size or digest_of(payload) != digest):
        raise ValueError(f"record {fields['WARC-Record-ID']} is damaged")
    number = lambda name: int(fields[name][10:-1]) if len(fields.get(name, "")) > 11 else None
    return dict(page_id=number("WARC-Record-ID"), payload_bytes=size, payload_digest=digest, record_type=kind, refers_to=number("WARC-Refers-To"), payload=payload if kind == "response" else None)


def surt(pages: DataFrame) -> DataFrame:
    """Adds `key`: the host's labels in reverse order, then the rest of the address.

    Keys of one domain and of hosts below it stand together when sorted. Null is empty.
    """
    url = F.col("url")
    labels = F.array_join(F.reverse(F.split(host_of(url), r"\.")), ",")
    rest = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*(.*)$", 1)
    return pages.withColumn("key", F.when(url.contains("://"), F.concat(labels, F.lit(")"), rest)).otherwise(F.coalesce(url, F.lit(""))))


def write_archives(pages: DataFrame, folder: str, date: str, least_bytes: int = 0) -> DataFrame:
    """Write a record for every page to archives in `folder`: the captures, see `CAPTURE`.

    Of pages with equal payloads of at least `least_bytes`, the one with the smallest
    `page_id` is a response and the others revisit it; smaller ones are all responses.
    Digests meet without the payloads, which move once, by page, so a payload that a third
    of all pages share is spread like any other.
    """
    pages = rows_of(pages, "page_id", "url", "html").withColumn("page_id", F.col("page_id").cast("long"))
    payload = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    digests = stored(pages.where("page_id is not null").select("page_id", F.sha1(payload).alias("d"), F.length(payload).alias("n")), "digests").where(F.col("n") >= least_bytes)
    first = digests.groupBy("d").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("c")).where("c > 1")
    revisits = digests.join(first, "d").where("page_id > refers_to").select("page_id", "d", "refers_to").distinct()
    given = surt(pages).select("page_id", "url", "key", payload.alias("payload"), F.sha1(payload).alias("d"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        output = None
        for batch in batches:
            out = []
            for page, url, key, payload, refers_to in zip(*[batch[c].to_pylist() for c in ("page_id", "url", "key", "payload", "refers_to")]):
                if output is None or output.size > ARCHIVE_BYTES:
                    if output:
                        output.stream.close()
                    output = _Output(folder, "pages.warc.gz")
                    info = b"software: articlelake\r\nformat: WARC File Format 1.1\r\n"
                    output.append(packed(f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:archive:{output.name}>\r\nWARC-Date: {date}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(info)}\r\n\r\n".encode() + info + b"\r\n\r\n"))
                offset, length = output.append(packed(record(page, url, payload, date, refers_to)))
                out.append((key, page, output.name, offset, length))
            types = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64())
            columns = zip(*out) if out else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["key", "page_id", "file", "offset", "length"])
        if output:
            output.stream.close()

    told = given.join(revisits, ["page_id", "d"], "left").select("page_id", "url", "key", "payload", "refers_to")
    return stored(told.mapInArrow(write, CAPTURE), "captures")


def write_index(captures: DataFrame, folder: str) -> DataFrame:
    """Index captures in `folder`: one row per shard, `shard, directory, first_key, last_key`.

    Captures are sorted over all shards by key. A shard holds compressed blocks of lines;
    its directory, a small file of its own, has the first and last key of every block and
    where it lies.
    """
    shards = max(1, -(-captures.count() // SHARD_CAPTURES))
    ordered = captures.repartitionByRange(shards, "key", "page_id", "file", "offset").sortWithinPartitions("key", "page_id", "file", "offset")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, blocks, lines = None, [], []

        def close_block() -> None:
            body = "\n".join(json.dumps(line) for line in lines).encode()
            blocks.append((lines[0][0], lines[-1][0], *shard.append(packed(body))))
            lines.clear()

        for batch in batches:
            for line in zip(*[batch[c].to_pylist() for c in ("key", "page_id", "file", "offset", "length")]):
                shard = shard or _Output(folder, "index")
                lines.append(line)
                if len(lines) == BLOCK_LINES:
                    close_block()
        if lines:
            close_block()
        if shard:
            shard.stream.close()
            directory = _Output(folder, "directory")
            directory.append(json.dumps(blocks).encode())
            directory.stream.close()
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (shard.name, directory.name, blocks[0][0], blocks[-1][1])], names=["shard", "directory", "first_key", "last_key"])

    return stored(ordered.mapInArrow(write, "shard string, directory string, first_key string, last_key string"), "shards")


def look_up(keys: DataFrame, shards: DataFrame, folder: str) -> DataFrame:
    """The captures, see `CAPTURE`, of the keys in the column `key`; null keys have none.

    Keys go to the shards that may have them; there, a binary search in the directory finds
    the blocks, and only these are read. The list of shards has a row for a million
    captures.
    """
    listed = sorted((r["first_key"], r["last_key"], r["shard"], r["directory"]) for r in shards.toLocalIterator())

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        firsts, lasts = [x[0] for x in listed], [x[1] for x in listed]
        for batch in batches:
            out = [(key, *listed[k][2:]) for key in batch["key"].to_pylist() for k in range(bisect_left(lasts, key), bisect_right(firsts, key))]
            columns = zip(*out) if out else [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in columns], names=["key", "shard", "directory"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        inputs, now, at, lines = _Inputs(folder), None, None, []
        for batch in batches:
            out = []
            for key, shard, directory in zip(*[batch[c].to_pylist() for c in ("key", "shard", "directory")]):
                if shard != now:
                    now, at = shard, None
                    blocks = json.loads(inputs.whole(directory))
                    firsts, lasts = [b[0] for b in blocks], [b[1] for b in blocks]
                for k in range(bisect_left(lasts, key), bisect_right(firsts, key)):
                    if k != at:  # keys come sorted, so a block is read once
                        at = k
                        body = zlib.decompress(inputs.read(shard, *blocks[k][2:]), 31)
                        lines = [json.loads(line) for line in body.split(b"\n")]
                        known = [line[0] for line in lines]
                    out += lines[bisect_left(known, key) : bisect_right(known, key)]
            types = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64())
            columns = zip(*out) if out else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["key", "page_id", "file", "offset", "length"])

    routed = keys.select("key").where("key is not null").distinct().mapInArrow(route, "key string, shard string, directory string")
    return routed.repartition("shard").sortWithinPartitions("shard", "key").mapInArrow(read, CAPTURE)


def read_records(captures: DataFrame, folder: str) -> DataFrame:
    """Read single records by range and check them: `page_id, payload_bytes, payload_digest,
    record_type, refers_to, payload`. A revisit has a null payload; the page that it refers
    to has the bytes."""
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        inputs = _Inputs(folder)
        names = [x.split()[0] for x in schema.split(", ")]
        types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())
        for batch in (b.slice(k, 500) for b in batches for k in range(0, b.num_rows, 500)):
            out = [parsed(zlib.decompress(inputs.read(*place), 31)) for place in zip(*[batch[c].to_pylist() for c in ("file", "offset", "length")])]
            yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in out], t) for n, t in zip(names, types)], names=names)

    stretch = F.floor(F.col("offset") / STRETCH)
    near = captures.withColumn("stretch", stretch).repartition("file", "stretch").sortWithinPartitions("file", "offset")
    return near.select("file", "offset", "length").mapInArrow(read, schema)


def archive_and_read(pages: DataFrame, date: str, least_bytes: int = 0) -> DataFrame:
    """Write all pages to archives, index them, and read every page back through the index.

    Takes `page_id, url, html`; other columns are ignored. Null html is an empty payload;
    null addresses share the empty key. Rows with a null `page_id` are responses that
    nothing refers to. Repeated rows are records of their own. See `read_records` for what
    comes back.
    """
    folder = shared_folder(pages.sparkSession, "warc")
    captures = write_archives(pages, folder, date, least_bytes)
    shards = write_index(captures, folder)
    return read_records(look_up(surt(rows_of(pages, "url")), shards, folder), folder)
