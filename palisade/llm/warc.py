"""Deterministic sharded WARC archives: written by ranges, committed by manifest, read back by Spark.

Pages are ordered by (identifier, payload digest).  Splitters come from a sample chosen by a hash of the keys,
so the same table gives the same shards, whatever the partitions.  A shard is sorted in its task and written
record by record; a file is closed when its compressed size reaches `roll_bytes`.  Every header is made from
the record alone.  A task writes under a temporary name with its attempt number and returns a manifest row; files
of the attempts whose rows arrived are then renamed, the manifest is written last, and readers open only what
it lists.  A second attempt, or a job that is run again, therefore changes nothing.

Of records with equal payloads of `least_bytes` or more, the first in order is the response and the others
revisit it; which those are is decided on digests alone, and travels to the writer as rows that sort just before
their page, so that payloads move once.

Defined cases: a null payload is empty; a null url is left out; null identifiers sort first; a repeated row is a
revisit of the first; an empty table gives a manifest without files; other columns are not looked at.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import uuid
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.llm.common import delete, materialize, small_batches, whole

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "name string, temporary string, records bigint, bytes bigint, sha256 string"
#: Splitters are picked from about so many sampled keys.
SAMPLE_KEYS = 10_000


def base32(digest_hex: str) -> str:
    return base64.b32encode(bytes.fromhex(digest_hex)).decode()


def record_id(page_id: int | None, digest: str, kind: str, again: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {digest} {kind} {again}')}>"


def _record(page: dict, refers_to: int | None, revisit: bool, again: int, date: str) -> bytes:
    """One record, a gzip member of its own."""
    digest = base32(page["digest"])
    payload = page["payload"].encode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    kind = "revisit" if revisit else "response"
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id(page['page_id'], digest, kind, again)}",
        f"WARC-Date: {date}",
    ]
    if page["url"] is not None:
        head.append("WARC-Target-URI: " + " ".join(page["url"].split()))
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to, digest, 'response', 0)}"]
    head += [
        f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{base32(hashlib.sha1(block).hexdigest())}",
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    if page["page_id"] is not None:
        head.append(f"Page-ID: {page['page_id']}")
    data = "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


class _File:
    """An archive under its temporary name."""

    def __init__(self, folder: str, name: str, attempt: int):
        self.name, self.temporary = name, f"_temporary/{name}.{attempt}"
        self.store, at = arrow_fs.FileSystem.from_uri(f"{folder}/{self.temporary}")
        self.store.create_dir(at.rpartition("/")[0])
        self.out = self.store.open_output_stream(at, compression=None)
        self.records, self.bytes, self.sha = 0, 0, hashlib.sha256()

    def add(self, data: bytes) -> None:
        self.out.write(data)
        self.sha.update(data)
        self.records, self.bytes = self.records + 1, self.bytes + len(data)

    def close(self) -> dict:
        self.out.close()
        return {"name": self.name, "temporary": self.temporary, "records": self.records, "bytes": self.bytes,
                "sha256": self.sha.hexdigest()}


def _writer(folder: str, prefix: str, roll_bytes: int, date: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    fields = pa.schema([("name", pa.string()), ("temporary", pa.string()), ("records", pa.int64()),
                        ("bytes", pa.int64()), ("sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        attempt = TaskContext.get().taskAttemptId()
        file, shard, number, key, again = None, None, 0, None, 0
        decision = None
        for batch in batches:
            for start in range(0, batch.num_rows, 50):
                for row in batch.slice(start, 50).to_pylist():
                    own = (row["page_id"], row["digest"])
                    if row["kind"] == 0:
                        decision = (own, row["refers_to"])
                        continue
                    again = again + 1 if own == key else 0
                    key = own
                    decided = decision is not None and decision[0] == own
                    repeats = again > 0 and row["links"]
                    if file and (row["shard"] != shard or file.bytes >= roll_bytes):
                        yield pa.RecordBatch.from_pylist([file.close()], fields)
                        file = None
                    if row["shard"] != shard:
                        shard, number = row["shard"], 0
                    if file is None:
                        file = _File(folder, f"{prefix}-{shard:06d}-{number:05d}.warc.gz", attempt)
                        number += 1
                    refers_to = decision[1] if decided else row["page_id"]
                    file.add(_record(row, refers_to, decided or repeats, again, date))
        if file:
            yield pa.RecordBatch.from_pylist([file.close()], fields)

    return run


def _commit(folder: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rename finished files; one that already has its name was renamed by an earlier attempt."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = arrow_fs.FileSystem.from_uri(folder)
        for batch in batches:
            for row in batch.to_pylist():
                source = f"{top}/{row['temporary']}"
                if store.get_file_info(source).type == arrow_fs.FileType.File:
                    store.move(source, f"{top}/{row['name']}")
            yield batch

    return run


def _sharded(keys: DataFrame, shard_bytes: int):
    """A function that gives a (page_id, digest) its shard, from splitters that depend on the rows alone."""
    rows, size = keys.agg(F.count("*"), F.sum("size")).first()
    shards = max(1, -(-(size or 0) // shard_bytes))
    step = max(1, rows // SAMPLE_KEYS)
    sample = sorted(
        (r[0] is not None, r[0] or 0, r[1])
        for r in keys.filter(F.pmod(F.xxhash64("page_id", "digest"), F.lit(step)) == 0)
        .select("page_id", "digest").distinct().collect()
    )
    splitters = [sample[i * len(sample) // shards] for i in range(1, shards)] if sample else []

    @F.arrow_udf("int")
    def shard(page_id: pa.Array, digest: pa.Array) -> pa.Array:
        found = [
            bisect.bisect_right(splitters, (p is not None, p or 0, d))
            for p, d in zip(page_id.to_pylist(), digest.to_pylist(), strict=True)
        ]
        return pa.array(found, pa.int32())

    return shard, shards


def write_archives(
    pages: DataFrame, folder: str, prefix: str = "pages", least_bytes: int = 0, roll_bytes: int = 16_000_000,
    shard_bytes: int = 16_000_000, date: str = "2024-01-01T00:00:00Z",
    id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
) -> DataFrame:
    """Write all pages below `folder`; returns the manifest (name, records, bytes, sha256)."""
    spark = small_batches(pages.sparkSession)
    folder = qualified(spark, folder)
    payload = whole(payload_col)
    full = pages.select(
        F.col(id_col).cast("bigint").alias("page_id"), F.sha1(payload.cast("binary")).alias("digest"),
        F.col(url_col).alias("url"), payload.alias("payload"),
    )
    keys = materialize(full.select("page_id", "digest", F.octet_length("payload").cast("bigint").alias("size")), "warc-keys")
    shard, shards = _sharded(keys, shard_bytes)
    linking = keys.filter(F.col("size") >= least_bytes)
    first = linking.groupBy("digest").agg(
        F.min(F.struct(F.col("page_id").isNotNull().alias("known"), "page_id")).alias("f"), F.count("*").alias("n")
    ).filter(F.col("n") > 1).select("digest", F.col("f.page_id").alias("refers_to"))
    revisits = linking.select("page_id", "digest").join(first, "digest").filter(
        ~F.col("page_id").eqNullSafe(F.col("refers_to"))
    ).distinct().select(
        "page_id", "digest", F.lit(0).alias("kind"), "refers_to", F.lit(None).cast("string").alias("url"),
        F.lit(None).cast("string").alias("payload"), F.lit(True).alias("links"),
    )
    records = full.select(
        "page_id", "digest", F.lit(1).alias("kind"), F.lit(None).cast("bigint").alias("refers_to"), "url", "payload",
        (F.octet_length("payload") >= least_bytes).alias("links"),
    )
    # More partitions than shards, so that few of them get two.
    ordered = revisits.unionByName(records).withColumn("shard", shard("page_id", "digest")).repartition(
        4 * shards, "shard"
    ).sortWithinPartitions("shard", "page_id", "digest", "kind", "url")
    written = materialize(ordered.mapInArrow(_writer(folder, prefix, roll_bytes, date), MANIFEST), "warc-files")
    done = written.mapInArrow(_commit(folder), MANIFEST).drop("temporary")
    done.write.mode("overwrite").parquet(f"{folder}/_manifest")
    delete(spark, f"{folder}/_temporary")
    return spark.read.schema(done.schema).parquet(f"{folder}/_manifest")


def qualified(spark: SparkSession, folder: str) -> str:
    """The folder with its scheme, as executors outside the JVM need it."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    store = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    out = store.makeQualified(path).toString()
    return "file://" + out.removeprefix("file:") if out.startswith("file:") and not out.startswith("file://") else out


RECORDS = (
    "page_id bigint, record_type string, record_id string, refers_to_id string, target_uri string, "
    "payload_digest string, payload string, file string"
)


def _records(stream: Iterator[bytes]) -> Iterator[bytes]:
    """Gzip members one by one, whatever the cuts of the stream."""
    tool, out = zlib.decompressobj(31), []
    started = False
    for data in stream:
        while data:
            started = True
            out.append(tool.decompress(data))
            data = b""
            if tool.eof:
                yield b"".join(out)
                data = tool.unused_data
                tool, out, started = zlib.decompressobj(31), [], False
    if started:
        raise ValueError("an archive ends within a record")


def _parsed_record(record: bytes, name: str) -> dict:
    head, _, rest = record.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    header = {k.lower(): v for k, v in (line.split(": ", 1) for line in lines)}
    block = rest[:int(header["content-length"])]
    if version != "WARC/1.1" or rest[len(block):] != b"\r\n\r\n":
        raise ValueError(f"{name} holds a record that is cut off")
    if header["warc-block-digest"] != "sha1:" + base32(hashlib.sha1(block).hexdigest()):
        raise ValueError(f"{name} holds a record that differs from its digest")
    payload = block.partition(b"\r\n\r\n")[2] if header["warc-type"] == "response" else None
    return {
        "page_id": int(header["page-id"]) if "page-id" in header else None,
        "record_type": header["warc-type"], "record_id": header["warc-record-id"],
        "refers_to_id": header.get("warc-refers-to"), "target_uri": header.get("warc-target-uri"),
        "payload_digest": header["warc-payload-digest"].removeprefix("sha1:"),
        "payload": None if payload is None else payload.decode(), "file": name,
    }


def _reader(folder: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    fields = pa.schema([(n, pa.int64() if t == "bigint" else pa.string())
                        for n, t in (c.strip().split(" ") for c in RECORDS.split(","))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = arrow_fs.FileSystem.from_uri(folder)
        for row in (row for batch in batches for row in batch.to_pylist()):
            out, held, sha = [], 0, hashlib.sha256()
            with store.open_input_stream(f"{top}/{row['name']}", compression=None) as file:

                def stream() -> Iterator[bytes]:
                    while data := file.read(1 << 18):
                        sha.update(data)
                        yield data

                for record in _records(stream()):
                    out.append(_parsed_record(record, row["name"]))
                    held += len(record)
                    if held > 4_000_000:
                        yield pa.RecordBatch.from_pylist(out, fields)
                        out, held = [], 0
            if sha.hexdigest() != row["sha256"]:
                raise ValueError(f"{row['name']} differs from its manifest")
            if out:
                yield pa.RecordBatch.from_pylist(out, fields)

    return run


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """Records of all files in the manifest, each checked against its digests; payload is null for revisits."""
    folder = qualified(spark, folder)
    listed = spark.read.parquet(f"{folder}/_manifest").select("name", "sha256")
    return listed.repartition(max(1, listed.count())).mapInArrow(_reader(folder), RECORDS)
