"""A deterministic, sharded writer of WARC archives, and their reader.

Records are sorted by key over shards. Shards are ranges of keys, cut where the payload
bytes counted by key range reach a size; a range that holds more is counted again in finer
ones, so an outlying key does no harm, and shards depend on the rows alone. The driver
sees no more than some numbers for each shard: choose ``shard_bytes`` by the size of the archive.
A task gets a stretch of shards, writes them one after another to files with temporary names and rolls to the
next file when the compressed size is reached; it reports each file in a manifest row.
The manifest is stored first, then its files, and no others, get their final names. A
task that is lost or runs twice leaves temporary files that no manifest names; they are
removed at the end. Headers and digests are made from the rows: no clock, no host, no
random identifier, and compressed members carry no time, so the same rows give the same
bytes.

Each record is a gzip member. The first record of equal payloads (by key) is a
``response`` with an HTTP head and the payload; the others are ``revisit`` records
that name it, with the head alone. Payloads below ``min_revisit_bytes`` are always
responses.

A null payload is empty. A null url gives a record without target address, a null key
one without key; such records come first, in shards of their own by digest, and nothing refers to them unless all equal
payloads lack a key, in which case the first of them is the response and the reference is
null. Of rows equal in key and payload one is the response, the rest refer to the key.
Line ends and control characters in urls are written as percent codes. An empty table
gives an archive without files. Columns other than key, url and payload are not read.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cobasket.llm.common import tasks_for
from cobasket.staging import checkpoint_dir, stage

#: Ranges of keys whose payload bytes are counted to cut shards, and into how many a range that is too full is cut further.
KEY_RANGES = 4096
FINER = 64
SHARD_BYTES = 16 << 20
ROLL_BYTES = 8 << 20
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_NAMESPACE = uuid.UUID(int=0)
MANIFEST = "shard bigint, seq int, temporary string, name string, records bigint, bytes bigint, sha256 string, first_key bigint, last_key bigint"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record_id(key: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMESPACE, f'{key}:{digest}')}>"


def record(key: int | None, url: str | None, payload: bytes, digest: str, is_response: bool, first: int | None) -> bytes:
    """The bytes of one record, uncompressed; ``digest`` is that of the whole payload."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if is_response:
        block += payload
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if is_response else 'revisit'}", f"WARC-Record-ID: {_record_id(key, digest)}", f"WARC-Date: {DATE}",
    ]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if key is not None:
        head.append(f"X-Record-Key: {key}")
    head += [f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{base32_sha1(block)}"]
    if not is_response:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_record_id(first, digest)}"]
        if first is not None:
            head.append(f"X-Refers-To-Key: {first}")
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _files(uri: str):
    """A file system that tasks can write to, and the path in it."""
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), os.path.abspath(uri))


class _Rolling:
    """Writes the records of a shard to temporary files of at most about ``roll_bytes``."""

    def __init__(self, root: str, shard: int, roll_bytes: int):
        self.files, self.path = _files(root)
        self.files.create_dir(f"{self.path}/_temporary", recursive=True)
        self.shard, self.roll_bytes, self.seq, self.out, self.rows = shard, roll_bytes, 0, None, []

    def add(self, key: int | None, data: bytes) -> None:
        if self.out is None:
            self.temporary = f"_temporary/{uuid.uuid4().hex}.warc.gz"
            self.out = self.files.open_output_stream(f"{self.path}/{self.temporary}", compression=None)
            self.records, self.bytes, self.sum, self.first = 0, 0, hashlib.sha256(), key
        pack = zlib.compressobj(6, zlib.DEFLATED, 31)
        member = pack.compress(data) + pack.flush()
        self.out.write(member)
        self.sum.update(member)
        self.records, self.bytes, self.last = self.records + 1, self.bytes + len(member), key
        if self.bytes >= self.roll_bytes:
            self.close()

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            name = f"part-{self.shard:06d}-{self.seq:04d}.warc.gz"
            self.rows.append((self.shard, self.seq, self.temporary, name, self.records, self.bytes, self.sum.hexdigest(), self.first, self.last))
            self.out, self.seq = None, self.seq + 1


def _shard_bounds(sizes: DataFrame, shard_bytes: int) -> tuple[int, list[int]]:
    """The number of shards for rows without key, and the first keys of the other shards after their first.

    ``sizes`` has ``(key, n_bytes)``.
    """
    low, high, keyless = sizes.agg(F.min("key"), F.max("key"), F.sum(F.when(F.col("key").isNull(), F.col("n_bytes") + 1))).first()
    shards = -(-keyless // shard_bytes) if keyless else 0
    if low is None:
        return shards, []
    width = 1
    while width * KEY_RANGES < high - low + 1:
        width *= FINER
    rows, filled = sizes.filter("key IS NOT NULL").select((F.col("key") - F.lit(low)).alias("at"), "n_bytes"), []
    while True:
        counted = rows.groupBy(F.expr(f"at div {width}L").alias("r")).agg(F.sum("n_bytes").alias("n")).collect()
        heavy = [r.r for r in counted if r.n > shard_bytes and width > 1]
        filled += [(low + r.r * width, r.n) for r in counted if r.n <= shard_bytes or width == 1]
        if not heavy:
            break
        too_full = sizes.sparkSession.createDataFrame([(r,) for r in heavy], "r long")
        rows = rows.withColumn("r", F.expr(f"at div {width}L")).join(too_full, "r", "left_semi").drop("r")
        width //= FINER
    bounds, held = [], 0
    for start, n in sorted(filled):
        if held and held + n > shard_bytes:
            bounds.append(start)
            held = 0
        held += n
    return shards, bounds


def _place(key: Column, bounds: list[int]) -> Column:
    """How many of the ascending ``bounds`` are not beyond ``key``, by halving."""
    if not bounds:
        return F.lit(0)
    ends = F.split(F.lit(",".join(map(str, bounds))), ",").cast("array<bigint>")
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(len(bounds).bit_length()))])
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.get(ends, at + step - 1) <= key, at + step).otherwise(at))


def _qualified(spark: SparkSession, path: str) -> str:
    """``path`` with the scheme of the cluster's file system where it names none: tasks and Spark mean one place."""
    plain = spark._jvm.org.apache.hadoop.fs.Path(path)
    return plain.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(plain).toString()


def write_archive(
    pages: DataFrame, path: str, key_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
    min_revisit_bytes: int = 0, shard_bytes: int = SHARD_BYTES, roll_bytes: int = ROLL_BYTES,
) -> DataFrame:
    """Write ``pages`` as an archive under ``path`` and return its manifest.

    ``path`` must be reachable from all executors; keys are integers.
    """
    rows = pages.select(
        F.col(key_col).cast("long").alias("key"), F.col(url_col).cast("string").alias("url"),
        F.coalesce(F.encode(F.col(payload_col), "UTF-8"), F.lit(b"")).alias("payload"),
    ).withColumn("digest", F.sha1("payload"))
    spark, path = pages.sparkSession, _qualified(pages.sparkSession, path)
    narrow = stage(rows.select("key", "digest", F.length("payload").cast("long").alias("n_bytes")), "warc-digests")
    keyless, bounds = _shard_bounds(narrow, shard_bytes)
    key = F.col("key")
    number = F.when(key.isNull(), F.pmod(F.xxhash64("digest"), F.lit(max(1, keyless)))).otherwise(keyless + _place(key, bounds)).cast("long")

    # Of equal payloads the least key is the response; only rows with an earlier one are told.
    groups = narrow.filter(F.col("n_bytes") >= F.lit(min_revisit_bytes)).groupBy("digest").agg(F.min("key").alias("first"), F.count("*").alias("n"))
    told = narrow.alias("r").join(groups.filter("n > 1").alias("g"), "digest").select("key", "digest", "first").dropDuplicates(["key", "digest"])
    shards = keyless + len(bounds) + 1
    parts = min(shards, 4 * tasks_for(pages))
    both = rows.select("key", "digest", F.lit(1).alias("kind"), F.lit(None).cast("long").alias("first"), "url", "payload").unionByName(
        told.select("key", "digest", F.lit(0).alias("kind"), "first"), allowMissingColumns=True,
    ).withColumn("shard", number)
    # Neighbouring shards to one task, and as many shards to each.
    both = both.repartitionById(parts, F.expr(f"int(shard * {parts} div {shards})")).sortWithinPartitions("shard", "key", "digest", "kind", "url")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, mark, first, repeated, manifest = None, None, None, False, []
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                key, hexed, kind, earliest, url, payload, number = row
                if out is None or out.shard != number:
                    if out is not None:
                        out.close()
                        manifest += out.rows
                    out = _Rolling(path, number, roll_bytes)
                if kind == 0:
                    mark, first, repeated = (key, hexed), earliest, False
                    continue
                grouped = mark == (key, hexed)
                is_response = not grouped or (first == key and not repeated)
                repeated = repeated or grouped
                digest = base64.b32encode(bytes.fromhex(hexed)).decode()
                out.add(key, record(key, url, payload, digest, is_response, first if grouped else None))
        if out is not None:
            out.close()
            manifest += out.rows
        if manifest:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*manifest, strict=True)], schema=_manifest_schema())

    manifest = stage(both.select("key", "digest", "kind", "first", "url", "payload", "shard").mapInArrow(write, MANIFEST), "warc-manifest")

    def commit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = _files(path)
        for batch in batches:
            for temporary, name in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                # A repeated attempt finds its file in place already.
                if files.get_file_info(f"{root}/{temporary}").is_file:
                    files.move(f"{root}/{temporary}", f"{root}/{name}")
            yield batch

    manifest.mapInArrow(commit, MANIFEST).drop("temporary").write.mode("overwrite").parquet(f"{path}/_manifest")
    files, root = _files(path)
    if files.get_file_info(f"{root}/_temporary").type != fs.FileType.NotFound:
        files.delete_dir(f"{root}/_temporary")
    return spark.read.schema(manifest.drop("temporary").schema).parquet(f"{path}/_manifest")


def _manifest_schema() -> pa.Schema:
    kinds = {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32()}
    return pa.schema([(name, kinds[kind]) for name, kind in (c.split() for c in MANIFEST.split(", "))])


def parse_records(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """The headers and the block of every record of a compressed archive file."""
    view, at = memoryview(content), 0
    while at < len(view):
        member, parts = zlib.decompressobj(31), []
        while not member.eof:
            chunk = view[at:at + (1 << 16)]
            if not chunk:
                raise ValueError("an archive file ends within a record")
            parts.append(member.decompress(chunk))
            at += len(chunk)
        at -= len(member.unused_data)
        data = b"".join(parts)
        head, _, rest = data.partition(b"\r\n\r\n")
        fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
        yield fields, rest[:int(fields["Content-Length"])]


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """One row per record: key, url, type, sizes and digests as found, and what it refers to.

    Digests of blocks and of payloads that are present are computed again; a record
    that contradicts its header fails the job. Files are read by Spark, each as one row
    of at most the size a file is rolled at plus one record.
    """
    schema = pa.schema([
        ("key", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()),
        ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary()),
    ])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows = []
                for fields, block in parse_records(content.as_py()):
                    head, _, payload = block.partition(b"\r\n\r\n")
                    size = int(dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])["Content-Length"])
                    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                    response = fields["WARC-Type"] == "response"
                    if base32_sha1(block) != fields["WARC-Block-Digest"].removeprefix("sha1:") or response and (base32_sha1(payload) != digest or len(payload) != size):
                        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
                    whole = [fields.get("X-Record-Key"), fields.get("X-Refers-To-Key")]
                    key, refers = [None if x is None else int(x) for x in whole]
                    rows.append((key, fields.get("WARC-Target-URI"), fields["WARC-Type"], size, digest, refers, payload if response else None))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(path).select("content")
    return found.mapInArrow(read, "key bigint, url string, record_type string, payload_bytes bigint, payload_digest string, refers_to bigint, payload binary")


def new_archive_path(spark: SparkSession) -> str:
    """A fresh folder for an archive in the shared folder of the cluster."""
    return f"{checkpoint_dir(spark).rstrip('/')}/cobasket/{spark.sparkContext.applicationId}/warc-{uuid.uuid4().hex}"
