"""WARC archives with a two-level capture index: compressed key blocks under a sparse directory."""

from __future__ import annotations

import bisect
import gzip
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, functions as F

from barloom.llm.common import tasks
from barloom.llm.urls import host_of, path_of
from barloom.operators.ordered import settle, shared_path

LEAST_SHARED = 100                  # bytes from which equal payloads are revisits
FILE_BYTES = 64 << 20               # of an archive file, about
READ_BYTES = 1 << 20                # of a range read, at least
BLOCK_KEYS = 256                    # captures of an index block, at least
MOST_BLOCKS = 1 << 16               # blocks of a directory; beyond it blocks grow, so the directory stays small
KEY_BYTES = 256                     # of a key in the directory
DATE = "1970-01-01T00:00:00Z"       # the tables carry no capture time
_PLANNED = ("page_id", "url", "payload", "digest", "key", "refers_to")


@dataclass(frozen=True)
class Archive:
    """Folder of the record files, table of the index blocks, and sorted ``(first key, block)`` rows, a bounded list."""

    folder: str
    blocks: DataFrame
    directory: list[tuple[bytes, str]]


def capture_key(url: Column, number: Column) -> Column:
    """Reversed host, path and rest of the URL, then the capture's number; an empty URL for NULL."""
    rest = F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*[^?#]*(.*)$", 1), F.lit(""))
    host = F.array_join(F.reverse(F.split(host_of(url), r"\.")), ",")
    odd = F.when(url.contains("://"), F.lit("")).otherwise(F.coalesce(url, F.lit("")))
    return F.concat(host, F.lit(")"), path_of(url), rest, odd, F.lit(" "), F.coalesce(number.cast("string"), F.lit("")))


def planned(pages: DataFrame) -> DataFrame:
    """``page_id``, ``url``, ``payload``, ``digest``, ``key`` and ``refers_to`` of each record to write.

    Payload groups are counted by digest from ids alone, so the bodies meet only the groups with several rows.
    """
    rows = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), F.encode(F.coalesce("html", F.lit("")), "utf-8").alias("payload"),
                        capture_key(F.col("url"), F.col("page_id")).alias("key"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    groups = (rows.filter(F.length("payload") >= LEAST_SHARED).groupBy("digest")
              .agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")).filter("n > 1").drop("n"))
    joined = rows.join(groups, "digest", "left")
    refers = F.when(F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id")), F.col("first_id"))
    return joined.select("page_id", "url", "payload", "digest", "key", refers.alias("refers_to"))


def record_bytes(url: str, page_id, payload: bytes, digest: str, refers_to) -> bytes:
    """One record; a revisit has the payload's length and digest and no body."""
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
            f"WARC-Target-URI: {json.dumps(url)[1:-1]}", f"WARC-Date: {DATE}",
            f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
            f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {len(payload)}"]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    body = payload if refers_to is None else b""
    head += ["Content-Type: text/html", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


@dataclass(frozen=True)
class Record:
    headers: dict[str, str]
    payload: bytes


def parse_record(data: bytes) -> Record:
    head, _, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    if not first.startswith("WARC/"):
        raise ValueError(f"no record: {first[:40]!r}")
    headers = dict(line.split(": ", 1) for line in lines)
    size = int(headers["Content-Length"])
    if rest[size:] != b"\r\n\r\n":
        raise ValueError("a record's length does not fit")
    return Record(headers, rest[:size])


_CAPTURES = "key binary, file string, at bigint, size bigint"
_RECORDS = "url string, page_id string, payload_bytes bigint, payload_digest string, record_type string, refers_to string"


def _writer(folder: str, file_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = pafs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        out, name, at = None, "", 0
        for batch in batches:
            rows = []
            for page_id, url, payload, digest, key, refers_to in zip(*[batch.column(n).to_pylist() for n in _PLANNED]):
                if out is None:
                    name, at = f"{uuid.uuid4().hex}.warc.gz", 0          # a repeated task writes other files; only listed ones are read
                    out = store.open_output_stream(f"{base}/{name}", compression=None)
                data = gzip.compress(record_bytes(url, page_id, payload, digest, refers_to), 4, mtime=0)
                out.write(data)
                rows.append((key.encode(), name, at, len(data)))
                at += len(data)
                if at >= file_bytes:
                    out.close()
                    out = None
            kinds = [pa.binary(), pa.string(), pa.int64(), pa.int64()]
            columns = [pa.array(c, k) for c, k in zip(zip(*rows) if rows else [()] * 4, kinds)]
            yield pa.RecordBatch.from_arrays(columns, names=["key", "file", "at", "size"])
        if out is not None:
            out.close()
    return run


def pack(rows: list[tuple]) -> bytes:
    """Sorted captures of a block, compressed."""
    return zlib.compress(json.dumps([[k.hex(), f, a, s] for k, f, a, s in rows]).encode(), 6)


def unpack(data: bytes) -> list[tuple[bytes, str, int, int]]:
    return [(bytes.fromhex(k), f, a, s) for k, f, a, s in json.loads(zlib.decompress(data))]


def _blocks(block_keys: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []

        def out(n: int) -> pa.RecordBatch:
            part = rows[:n]
            del rows[:n]
            return pa.RecordBatch.from_arrays([pa.array([uuid.uuid4().hex]), pa.array([part[0][0]], pa.binary()), pa.array([pack(part)], pa.binary())],
                                              names=["block", "first", "data"])

        for batch in batches:
            rows += zip(*[batch.column(n).to_pylist() for n in ("key", "file", "at", "size")])
            while len(rows) >= block_keys:
                yield out(block_keys)
        if rows:
            yield out(len(rows))
    return run


def write(pages: DataFrame, file_bytes: int = FILE_BYTES, block_keys: int = BLOCK_KEYS, most_blocks: int = MOST_BLOCKS) -> Archive:
    """Write every row as a record of gzip members in the shared folder, and the index of the captures.

    Of records with equal payloads of ``LEAST_SHARED`` bytes or more the one with the smallest id is a response, the others
    revisit it; repeated rows with that id are responses all.  NULL bodies are empty, NULL URLs and ids empty names.  Captures are sorted by
    key over all tasks (the capture number splits a hot URL) and packed into blocks; the directory holds the
    first ``KEY_BYTES`` of each block's first key, for at most ``most_blocks`` blocks and one for each task.
    """
    spark = pages.sparkSession
    folder = shared_path(spark, "warc")
    captures = settle(planned(pages).mapInArrow(_writer(folder, file_bytes), _CAPTURES))
    block_keys = max(block_keys, -(-captures.count() // most_blocks))
    ordered = captures.repartitionByRange(tasks(pages), "key", "file", "at").sortWithinPartitions("key", "file", "at")
    blocks = settle(ordered.mapInArrow(_blocks(block_keys), "block string, first binary, data binary"))
    listed = blocks.select(F.substring("first", 1, KEY_BYTES).alias("first"), "block").collect()      # bounded by ``most_blocks``
    return Archive(folder, blocks, sorted((bytes(r["first"]), r["block"]) for r in listed))


def _route(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        directory = shared.value
        firsts, names = [f for f, _ in directory], [b for _, b in directory]
        for batch in batches:
            keys, blocks = [], []
            for key in batch.column("key").to_pylist():
                short = key[:KEY_BYTES]
                for block in names[max(0, bisect.bisect_left(firsts, short) - 1):bisect.bisect_right(firsts, short)]:
                    keys.append(key)
                    blocks.append(block)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(blocks, pa.string())], names=["key", "block"])
    return run


def _search(wanted: pa.Table, block: pa.Table) -> pa.Table:
    """Captures of the wanted keys in one block."""
    rows = [r for data in block["data"].to_pylist() for r in unpack(data)]
    keys, found = [r[0] for r in rows], []
    for key in set(wanted["key"].to_pylist()):
        for i in range(bisect.bisect_left(keys, key), len(keys)):
            if keys[i] != key:
                break
            found.append(rows[i])
    columns = zip(*found) if found else [()] * 4
    return pa.table([pa.array(c, k) for c, k in zip(columns, [pa.binary(), pa.string(), pa.int64(), pa.int64()])],
                    names=["key", "file", "at", "size"])


def _reader(folder: str, bodies: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = pafs.FileSystem.from_uri(folder)
        name, source, buffer, begin = None, None, b"", 0
        for batch in batches:
            rows = []
            for file, at, size in zip(*[batch.column(n).to_pylist() for n in ("file", "at", "size")]):
                if file != name:
                    if source is not None:
                        source.close()
                    name, source, buffer = file, store.open_input_file(f"{base}/{file}"), b""
                if not buffer or at < begin or at + size > begin + len(buffer):      # neighbours come with one range read
                    begin = at
                    source.seek(at)
                    buffer = source.read(max(size, READ_BYTES))
                record = parse_record(gzip.decompress(buffer[at - begin:at - begin + size]))
                rows.append(record_row(record) + ((record.payload,) if bodies else ()))
            fields = ["url", "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"] + ["payload"] * bodies
            kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string()] + [pa.binary()] * bodies
            columns = [pa.array(c, k) for c, k in zip(zip(*rows) if rows else [()] * len(kinds), kinds)]
            yield pa.RecordBatch.from_arrays(columns, names=fields)
        if source is not None:
            source.close()
    return run


def record_row(record: Record) -> tuple:
    """Header fields of a record; the digest of a response is checked against its body."""
    h = record.headers
    digest = h["WARC-Payload-Digest"].removeprefix("sha256:")
    if h["WARC-Type"] == "response" and hashlib.sha256(record.payload).hexdigest() != digest:
        raise ValueError(f"damaged payload of {h['WARC-Record-ID']}")
    number = lambda name: h[name].removeprefix("<urn:page:").removesuffix(">") or None
    return (json.loads(f'"{h["WARC-Target-URI"]}"'), number("WARC-Record-ID"), int(h["X-Payload-Length"]), digest, h["WARC-Type"],
            number("WARC-Refers-To") if "WARC-Refers-To" in h else None)


def find(archive: Archive, keys: DataFrame, bodies: bool = True) -> DataFrame:
    """The records of the captures with the given ``key`` values (binary), each capture once.

    Keys find their blocks by binary search in the directory, captures by binary search in the block, and records by range reads
    in the order of the files.  Keys without a capture give no row.
    """
    spark = keys.sparkSession
    directory = spark.sparkContext.broadcast(archive.directory)        # at most ``MOST_BLOCKS`` short keys
    routed = keys.select("key").distinct().mapInArrow(_route(directory), "key binary, block string")
    found = routed.groupBy("block").cogroup(archive.blocks.groupBy("block")).applyInArrow(_search, _CAPTURES)
    ordered = (found.repartition(tasks(keys), "file", F.floor(F.col("at") / F.lit(8 * READ_BYTES)))
               .sortWithinPartitions("file", "at"))
    return ordered.mapInArrow(_reader(archive.folder, bodies), _RECORDS + (", payload binary" if bodies else ""))


def read_back(pages: DataFrame) -> DataFrame:
    """Write all rows, look every capture up through the index, and return what the archives say of each.

    Repeated rows stay, an empty table gives none, and other columns are left out.
    """
    archive = write(pages)
    keys = pages.select(capture_key(F.col("url"), F.col("page_id")).cast("binary").alias("key"))
    kind = pages.schema["page_id"].dataType
    rows = find(archive, keys, bodies=False)
    return rows.select(F.col("page_id").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type",
                       F.col("refers_to").cast(kind).alias("refers_to"))
