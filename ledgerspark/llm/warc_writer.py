"""WARC: a deterministic sharded writer, and the reader that checks what was written.

Records are ranged by page_id into shards of about equal size, sorted within each, and written
as one gzip member per record; a shard rolls over to its next file at a compressed size. Shard
bounds come from a histogram of sizes whose heavy bars are split again and again, so ids may lie
as unevenly as they like; the rows of one heavy id are dealt by a hash of url and payload. Headers
and digests come from the payloads, and file names
from shard and number, so the same table gives the same bytes on any cluster. A task writes
under a temporary name of its own and renames when a file is whole; readers open only what the
manifest lists, so lost or repeated attempts leave nothing that counts.

Of records with equal payloads the one with the largest page_id carries the payload as a
response, and the others revisit it.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerspark.llm._tables import kept

#: Payload bytes of a shard, compressed bytes of a file, bars that a round of the histogram adds (the driver holds them).
SHARD_BYTES, FILE_BYTES, BARS = 24 << 20, 8 << 20, 1 << 16
#: A record's headers and digests beside its payload, in bytes; parts that the hash of url and payload tells apart.
HEAD_BYTES, PARTS = 512, 1 << 16
#: Groups of equal payloads broadcast at most.
BROADCAST_GROUPS = 500_000
DATE, LEVEL = "2024-01-01T00:00:00Z", 5
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "file string, shard int, number int, records bigint, bytes bigint, sha256 string"
RECORD = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, url string, whole boolean"


def _base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _name(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {digest}')}>"


def _record(headers: list[tuple[str, object]], block: bytes) -> bytes:
    lines = "".join(f"{k}: {v}\r\n" for k, v in headers if v is not None)
    head = f"WARC/1.1\r\n{lines}WARC-Block-Digest: sha1:{_base32(block)}\r\nContent-Length: {len(block)}\r\n\r\n"
    press = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return press.compress(head.encode() + block + b"\r\n\r\n") + press.flush()


def _page(page_id: int | None, url: str | None, payload: bytes, response_id: int | None) -> bytes:
    """One page as a record: a revisit of ``response_id``'s record unless that is null."""
    digest = _base32(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    url = None if url is None else "".join(c if c > " " else f"%{ord(c):02X}" for c in url)
    revisit = response_id is not None
    headers = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", _name(page_id, digest)),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", url),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Profile", PROFILE if revisit else None),
        ("WARC-Refers-To", _name(response_id, digest) if revisit else None),
        ("X-Page-Id", page_id),
        ("X-Payload-Length", len(payload)),
        ("X-Refers-To-Page-Id", response_id),
        ("Content-Type", "application/http; msgtype=response"),
    ]
    return _record(headers, http if revisit else http + payload)


class _File:
    """A file of a shard, under a temporary name until it is whole."""

    def __init__(self, folder: str, shard: int, number: int):
        self.fs, base = pyarrow.fs.FileSystem.from_uri(folder)
        self.shard, self.number, self.records, self.size, self.hash = shard, number, 0, 0, hashlib.sha256()
        self.name = f"shard-{shard:06d}-{number:05d}.warc.gz"
        self.temporary, self.final = f"{base}/_temporary/{uuid.uuid4().hex}", f"{base}/data/{self.name}"
        self.fs.create_dir(f"{base}/_temporary", recursive=True)
        self.fs.create_dir(f"{base}/data", recursive=True)
        self.out = self.fs.open_output_stream(self.temporary, compression=None)
        self.add(_record([("WARC-Type", "warcinfo"), ("WARC-Record-ID", _name(None, self.name)), ("WARC-Date", DATE), ("WARC-Filename", self.name), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n"))
        self.records = 0

    def add(self, member: bytes) -> None:
        self.out.write(member)
        self.hash.update(member)
        self.size += len(member)
        self.records += 1

    def commit(self) -> tuple:
        self.out.close()
        if self.fs.get_file_info(self.final).type != pyarrow.fs.FileType.NotFound:
            self.fs.delete_file(self.final)
        self.fs.move(self.temporary, self.final)
        return f"data/{self.name}", self.shard, self.number, self.records, self.size, self.hash.hexdigest()


def _writer(folder: str, file_bytes: int):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, done = None, []
        for part in parts:
            for i in range(len(part)):
                shard, page_id, url, payload, response = (part[c][i].as_py() for c in ("shard", "page_id", "url", "payload", "response_id"))
                if file is None or file.shard != shard or file.size >= file_bytes:
                    number = file.number + 1 if file and file.shard == shard else 0
                    if file:
                        done.append(file.commit())
                    file = _File(folder, shard, number)
                file.add(_page(page_id, url, payload, response))
        if file:
            done.append(file.commit())
        if done:
            types = (pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.string())
            names = ["file", "shard", "number", "records", "bytes", "sha256"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True), types, strict=True)], names)

    return run


def _bar_of(spark: SparkSession, edges: list[int]):
    """The bar of a page_id: 0 for null, else how many of the sorted ``edges`` are not above it."""
    held = spark.sparkContext.broadcast(np.array(edges, np.int64))

    @F.arrow_udf("int")
    def bar(page_id: pa.Array) -> pa.Array:
        at = np.searchsorted(held.value, page_id.fill_null(0).to_numpy(zero_copy_only=False), "right")
        return pa.array(np.where(page_id.is_null().to_numpy(zero_copy_only=False), 0, at).astype(np.int32))

    return bar


def _bars(sizes: DataFrame, shard_bytes: int) -> tuple[list[int], list[int], int]:
    """Edges of the bars, the weight of each bar (the first is that of null ids), and the weight of a shard.

    A bar heavier than a shard is split until it is one id. A shard is at least total / BARS
    heavy, so at most BARS bars are split in a round and the edges stay few for any table.
    """
    seen = sizes.agg(F.min("page_id").alias("a"), F.max("page_id").alias("b"), F.coalesce(F.sum("weight"), F.lit(0)).alias("total")).first()
    shard = max(shard_bytes, -(-seen.total // BARS))
    if seen.a is None:
        return [], [seen.total], shard
    ends, edges, split = seen.b + 1, [], [(seen.a, seen.b + 1)]
    while split:
        ways = max(2, BARS // len(split))
        for low, high in split:
            edges.extend(range(low, high, max(1, -(-(high - low) // ways))))
        edges = sorted(set(edges))
        found = sizes.groupBy(_bar_of(sizes.sparkSession, edges)("page_id").alias("bar")).agg(F.sum("weight").alias("weight")).collect()  # a row for each bar in use
        weight = [0] * (len(edges) + 1)
        for r in found:
            weight[r.bar] = r.weight
        bound = [*edges, ends]
        split = [(bound[i], bound[i + 1]) for i in range(len(edges)) if weight[i + 1] > shard and bound[i + 1] - bound[i] > 1]
        light = [i for i in range(len(edges)) if i == 0 or weight[i + 1] or weight[i]]  # runs of empty bars need one edge
        edges, weight = [edges[i] for i in light], [weight[0], *(weight[i + 1] for i in light)]
    return edges, weight, shard


def _dealt(weights: list[int], shard: int) -> tuple[list[int], list[int], int]:
    """The first shard of each bar, how many shards share it (one unless it is one heavy id), and how many there are."""
    first, share, number, filled = [], [], 0, 0
    for weight in weights:
        if filled and filled + weight > shard:
            number, filled = number + 1, 0
        parts = max(1, min(PARTS, -(-weight // shard)))
        first.append(number)
        share.append(parts)
        number, filled = (number + parts, 0) if parts > 1 else (number, filled + weight)
    return first, share, number + 1


def write_warc(pages: DataFrame, folder: str, shard_bytes: int = SHARD_BYTES, file_bytes: int = FILE_BYTES, least_revisit: int = 0) -> DataFrame:
    """Writes a record per row of ``pages`` (page_id, url, html) under ``folder``; returns the manifest, which it writes there too.

    Null html is an empty payload; a null url gives no target URI. Payloads of less than
    ``least_revisit`` bytes are always responses. Rows that share the largest page_id of their
    payload are all responses; null ids come last in that choice, and first in the files.
    Other columns are ignored. An empty table gives an empty manifest and no file.
    """
    spark = pages.sparkSession
    rows = pages.select("page_id", "url", F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload")).withColumn("size", F.octet_length("payload").cast("bigint"))
    edges, weights, shard_weight = _bars(kept(rows.select("page_id", (F.col("size") + HEAD_BYTES).alias("weight")), "sizes"), shard_bytes)
    first, share, shards = _dealt(weights, shard_weight)
    dealt = spark.createDataFrame(list(zip(range(len(first)), first, share, strict=True)), "bar int, first int, share int")  # a row for each bar
    equal = rows.where(F.col("size") >= least_revisit).groupBy(F.sha1("payload").alias("sha1"), "size").agg(F.max("page_id").alias("most"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    equal = kept(equal, "equal")
    few = equal.limit(BROADCAST_GROUPS + 1).count() <= BROADCAST_GROUPS
    told = rows.withColumn("sha1", F.sha1("payload")).join(F.broadcast(equal) if few else equal, ["sha1", "size"], "left")
    response = F.when(~F.col("page_id").eqNullSafe(F.col("most")), F.col("most"))
    part = F.pmod(F.xxhash64("url", "sha1"), F.lit(PARTS))
    shard = (F.col("first") + F.floor(F.col("part") * F.col("share") / PARTS)).cast("int").alias("shard")
    told = told.select(_bar_of(spark, edges)("page_id").alias("bar"), "page_id", "url", "payload", response.alias("response_id"), part.alias("part"))
    told = told.join(F.broadcast(dealt), "bar").select(shard, "page_id", "url", "payload", "response_id")
    sorted_ = told.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "page_id", "url", "payload")
    manifest = f"{folder}/manifest-{uuid.uuid4().hex}"
    sorted_.mapInArrow(_writer(folder, file_bytes), MANIFEST).write.json(manifest)
    fs, base = pyarrow.fs.FileSystem.from_uri(folder)
    if fs.get_file_info(f"{base}/_temporary").type == pyarrow.fs.FileType.Directory:  # of attempts that were lost
        fs.delete_dir(f"{base}/_temporary")
    return spark.read.schema(MANIFEST).json(manifest)


def _members(stream: pa.NativeFile, size: int = 1 << 20) -> Iterator[bytes]:
    """The gzip members of a file, one after another."""
    left = b""
    while True:
        unpack, member = zlib.decompressobj(31), []
        while not unpack.eof:
            left = left or stream.read(size)
            if not left:
                if member:
                    raise ValueError("a record is cut off")
                return
            member.append(unpack.decompress(left))
            left = unpack.unused_data if unpack.eof else b""
        yield b"".join(member)


def _parsed(record: bytes) -> tuple | None:
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    if fields["WARC-Type"] == "warcinfo":
        return None
    block = rest[: int(fields["Content-Length"])]
    payload = block.partition(b"\r\n\r\n")[2]
    digest, n = fields["WARC-Payload-Digest"].removeprefix("sha1:"), int(fields["X-Payload-Length"])
    whole = fields["WARC-Block-Digest"] == f"sha1:{_base32(block)}" and (fields["WARC-Type"] == "revisit" or (_base32(payload) == digest and len(payload) == n))
    number = lambda k: int(fields[k]) if k in fields else None
    return number("X-Page-Id"), n, digest, fields["WARC-Type"], number("X-Refers-To-Page-Id"), fields.get("WARC-Target-URI"), whole


def _reader(folder: str):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pyarrow.fs.FileSystem.from_uri(folder)
        types = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.bool_())
        names = [c.split()[0] for c in RECORD.split(", ")]
        batch = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
        for part in parts:
            for file in part["file"].to_pylist():
                rows = []
                with fs.open_input_stream(f"{base}/{file}", compression=None) as stream:
                    for record in _members(stream):
                        if row := _parsed(record):
                            rows.append(row)
                        if len(rows) >= 4096:
                            yield batch(rows)
                            rows = []
                if rows:
                    yield batch(rows)

    return run


def read_warc(manifest: DataFrame, folder: str) -> DataFrame:
    """The records of the manifest's files, a task for the files of each shard: page_id, payload_bytes, payload_digest, record_type, refers_to, url, whole (digests and lengths hold)."""
    shards = manifest.agg(F.coalesce(F.max("shard") + 1, F.lit(1)).alias("n")).first().n
    return manifest.repartitionById(shards, F.col("shard")).select("file").mapInArrow(_reader(folder), RECORD)
