"""WARC archives: a deterministic sharded writer and a reader.

Records are range-partitioned by id and sorted, each shard is one range. A task writes a shard's records as gzip members into
temporary files, rolling to the next file when the compressed size reaches ROLL_BYTES, and returns manifest rows. The manifest is a
table, so only the rows of the attempt that Spark committed count; a second job renames exactly those files to their final
names, which depend on the data alone. Files that a lost attempt has left keep their temporary names and are never read.
Payloads of MIN_REVISIT bytes or more that are equal to one with a smaller id become revisit records.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import id_bounds, materialize, partitions, range_of, shared_dir, small_batches

ROLL_BYTES = 16 << 20
MIN_REVISIT = 100
#: Groups of equal payloads that are broadcast (about 100 bytes each); more of them are joined by a shuffle.
BROADCAST_GROUPS = 100_000
DATE = "2024-01-01T00:00:00Z"
_LEVEL = 4


def _filesystem(uri: str):
    """File system and path of a URI or local path, from inside a task."""
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        uri = "file://" + uri
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri))


def record_id(page_id: int | None, copy: int) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha256(f'{page_id}/{copy}'.encode()).digest()[:16], version=4)}>"


def build_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool, copy: int) -> bytes:
    """One record: WARC headers, an HTTP head and, unless it is a revisit, the payload."""
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = head if revisit else head + payload
    target = quote(url or "about:blank", safe="%/:=&?~#+!$,;'@()*[]")
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_id(page_id, copy)}",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {target}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-Block-Digest: sha256:{hashlib.sha256(body).hexdigest()}",
        "Content-Type: application/http; msgtype=response",
        f"X-Page-Id: {'' if page_id is None else page_id}",
    ]
    if revisit:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to, 0)}", f"X-Refers-To-Page-Id: {refers_to}"]
    lines += [f"Content-Length: {len(body)}", "", ""]
    return "\r\n".join(lines).encode() + body + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """WARC headers (lower-case names), HTTP head and payload; digests and lengths are verified."""
    cut = data.index(b"\r\n\r\n")
    lines = data[:cut].decode().split("\r\n")
    if not lines[0].startswith("WARC/1."):
        raise ValueError("not a WARC record")
    headers = {k.lower(): v for k, _, v in (line.partition(": ") for line in lines[1:])}
    body = data[cut + 4 : cut + 4 + int(headers["content-length"])]
    if data[cut + 4 + len(body) :] != b"\r\n\r\n" or "sha256:" + hashlib.sha256(body).hexdigest() != headers["warc-block-digest"]:
        raise ValueError(f"record {headers.get('warc-record-id')} is damaged")
    split = body.index(b"\r\n\r\n") + 4
    head, payload = body[:split], body[split:]
    if headers["warc-type"] == "response" and "sha256:" + hashlib.sha256(payload).hexdigest() != headers["warc-payload-digest"]:
        raise ValueError(f"payload of {headers.get('warc-record-id')} is damaged")
    return headers, head, payload


def plan_records(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, digest, refers_to (null for responses) for every row of pages (page_id, url, html).

    A null html is an empty payload; rows with the smallest id of a payload are all responses; rows without an id are responses.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    first = rows.where(
        (F.length("payload") >= MIN_REVISIT) & F.col("page_id").isNotNull()
    ).groupBy("digest").agg(F.min("page_id").alias("first"), F.max("page_id").alias("last")).where("first < last").select("digest", "first")
    first = materialize(first, "warc-copies")
    joined = rows.join(F.broadcast(first) if first.count() <= BROADCAST_GROUPS else first, "digest", "left")  # payloads stay where they are
    return joined.select("page_id", "url", "payload", "digest", F.when(F.col("page_id") > F.col("first"), F.col("first")).alias("refers_to"))


def write_warc(pages: DataFrame, folder: str, roll_bytes: int = ROLL_BYTES) -> DataFrame:
    """Write one record per row of pages under folder and return the manifest: path, records, bytes, sha256 of each file."""
    spark = pages.sparkSession
    bounds = id_bounds(pages, "page_id", partitions(spark))
    rows = plan_records(pages).withColumn("shard", range_of(spark, "page_id", bounds))
    rows = rows.repartitionById(len(bounds) + 1, "shard").sortWithinPartitions("shard", F.asc_nulls_first("page_id"), "url", "digest")
    attempt_folder = f"{folder}/_temporary"
    small_batches(spark)

    def write(batches):
        system, base = _filesystem(attempt_folder)
        system.create_dir(base, recursive=True)
        done: list[tuple] = []
        stream = temporary = None
        shard = number = records = size = copy = 0
        last = None
        digest = hashlib.sha256()

        def close():
            nonlocal stream
            if stream is not None:
                stream.close()
                done.append((temporary, f"shard-{shard:06d}-{number:05d}.warc.gz", records, size, digest.hexdigest()))
                stream = None

        for batch in batches:
            for page_id, url, payload, sha, refers_to, of in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if stream is not None and (of != shard or size >= roll_bytes):
                    close()
                    number = number + 1 if of == shard else 0
                elif stream is None:
                    number = 0
                if stream is None:
                    temporary = f"{uuid.uuid4().hex}.tmp"
                    stream = system.open_output_stream(f"{base}/{temporary}", compression=None)
                    shard, records, size, digest = of, 0, 0, hashlib.sha256()
                copy = copy + 1 if page_id == last else 0
                last = page_id
                squeeze = zlib.compressobj(_LEVEL, zlib.DEFLATED, 31)
                member = squeeze.compress(build_record(page_id, url, payload, sha, refers_to, refers_to is not None, copy)) + squeeze.flush()
                stream.write(member)
                digest.update(member)
                records, size = records + 1, size + len(member)
        close()
        if done:
            yield pa.RecordBatch.from_pydict(
                {name: pa.array([x[i] for x in done]) for i, name in enumerate(("temporary", "name", "records", "bytes", "sha256"))}
            )

    manifest = materialize(
        rows.select("page_id", "url", "payload", "digest", "refers_to", "shard").mapInArrow(
            write, "temporary string, name string, records long, bytes long, sha256 string"
        ),
        "warc-manifest",
    )

    def commit(batches):
        system, base = _filesystem(folder)
        from pyarrow import fs

        for batch in batches:
            paths = []
            for temporary, name in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                source, target = f"{base}/_temporary/{temporary}", f"{base}/{name}"
                if system.get_file_info(source).type != fs.FileType.NotFound:  # else an earlier attempt has renamed it
                    system.move(source, target)
                paths.append(f"{folder}/{name}")
            yield pa.RecordBatch.from_pydict({"path": pa.array(paths), **{n: batch.column(i) for i, n in ((2, "records"), (3, "bytes"), (4, "sha256"))}})

    return materialize(manifest.mapInArrow(commit, "path string, records long, bytes long, sha256 string"), "warc-committed")


def read_warc(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, url, payload (null for revisits) of the files in the manifest.

    Every file is checked against its manifest digest and every record against its own.
    """

    def read(batches):
        for batch in batches:
            for path, records, sha in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                system, at = _filesystem(path)
                with system.open_input_stream(at, compression=None) as stream:
                    data = stream.readall()  # at most one roll size and one record
                if hashlib.sha256(data).hexdigest() != sha:
                    raise ValueError(f"{path} differs from its manifest")
                out, count = [], 0
                while data:
                    member = zlib.decompressobj(31)
                    headers, head, payload = parse_record(member.decompress(data) + member.flush())
                    data = member.unused_data
                    count += 1
                    revisit = headers["warc-type"] == "revisit"
                    length = int(re.search(rb"Content-Length: (\d+)", head)[1])
                    page = headers["x-page-id"]
                    out.append(
                        (
                            int(page) if page else None,
                            length,
                            headers["warc-payload-digest"].removeprefix("sha256:"),
                            headers["warc-type"],
                            int(headers["x-refers-to-page-id"]) if revisit else None,
                            headers["warc-target-uri"],
                            None if revisit else payload,
                        )
                    )
                    if len(out) >= 500:
                        yield _rows(out)
                        out = []
                if count != records:
                    raise ValueError(f"{path} has {count} records, its manifest {records}")
                if out:
                    yield _rows(out)

    # files are numbered and dealt one by one: hashing their paths would give some tasks several and others none
    numbered = manifest.withColumn("number", F.row_number().over(Window.orderBy("path")))  # one short row for each file
    dealt = numbered.repartitionById(max(1, partitions(spark)), "number").select("path", "records", "sha256")
    return dealt.mapInArrow(read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary")


def _rows(out: list[tuple]) -> pa.RecordBatch:
    types = {
        "page_id": pa.int64(),
        "payload_bytes": pa.int64(),
        "payload_digest": pa.string(),
        "record_type": pa.string(),
        "refers_to": pa.int64(),
        "url": pa.string(),
        "payload": pa.binary(),
    }
    return pa.RecordBatch.from_pydict({n: pa.array([x[i] for x in out], t) for i, (n, t) in enumerate(types.items())})


def op9_warc(spark, sf_dir: str) -> DataFrame:
    """All pages, written into the shared folder and read back."""
    folder = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    manifest = write_warc(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder)
    return read_warc(spark, folder, manifest).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP9_SQL = f"""
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha256(coalesce(html, '')) AS d FROM pages),
f AS (SELECT d, min(page_id) AS first FROM p WHERE n >= {MIN_REVISIT} GROUP BY d)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, p.d AS payload_digest,
       CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id > first THEN first END AS refers_to
FROM p LEFT JOIN f ON p.d = f.d
"""
