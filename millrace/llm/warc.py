"""A deterministic sharded WARC writer and its reader.

Records are sorted by ranges of page_id; a task writes its range into gzip members, one per record, rolls to the next
file when the compressed size passes `roll_bytes`, and regenerates every header and digest from the payload.  A file is
written under a temporary name and renamed when it is whole; the table of files that the write job returns is
the manifest, and the reader takes only what the manifest names, so what a lost executor leaves behind is never read.
Nothing in a record depends on the clock, so a task that runs again writes the same bytes.

Payloads of at least `min_revisit` bytes that are equal are stored once: the record with the smallest page_id is the
response, the others are revisits with a pointer and no payload.  Pointers come from page_ids and digests alone: a
digest's rows are first summed up in SALTS parts, so one that a third of all pages share never meets in one task.  The
few pointer rows join the pages in the one exchange by ranges, each sorted right before the pages it is for; the pages
themselves move once.

Null html counts as an empty payload.  Null urls give an empty target.  A null page_id is written first, as `null`,
and is never anyone's owner unless all copies lack one.  Repeated rows are records of their own, told apart in their
record ids; of several rows with the owner's page_id, each is a response.  A page_id with very many rows is cut into
ranges by digest.  An empty table writes nothing and reads back nothing.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.llm.common import shared_dir, written

#: The date of every record: the writer has no clock.
DATE = "2000-01-01T00:00:00Z"
SALTS = 32
#: Of zlib: 6 packs 3 % smaller at 1.8 times the time.
LEVEL = 3
_MANIFEST = "file string, n_records bigint, n_bytes bigint, sha256 string"


def pointers(pages: DataFrame, min_revisit: int = 100) -> DataFrame:
    """page_id, digest and refers_to of every page whose payload an earlier one has."""
    part = F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).alias("part")
    ids = pages.filter(F.octet_length("html") >= min_revisit).select("page_id", "digest", part)
    some = ids.groupBy("digest", "part").agg(F.min("page_id").alias("least"), F.count("*").alias("n"))
    # At most SALTS rows of a digest meet here.
    every = Window.partitionBy("digest")
    owners = some.select("digest", "part", F.min("least").over(every).alias("owner"), F.sum("n").over(every).alias("copies")).filter("copies > 1")
    met = ids.join(owners.drop("copies"), ["digest", "part"])
    return met.filter(F.col("owner").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("owner"))).select("page_id", "digest", F.col("owner").alias("refers_to")).distinct()


def with_owner(pages: DataFrame, min_revisit: int = 100) -> DataFrame:
    """page_id, digest, kind, url, html, refers_to: pages (kind 1), and before them the pointers (kind 0) by page_id and digest."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), html.alias("html"))
    rows = rows.withColumn("digest", F.unhex(F.sha2(F.encode("html", "utf-8"), 256)))
    to = written(pointers(rows, min_revisit), "warc-pointers").select("page_id", "digest", F.lit(0).alias("kind"), F.lit("").alias("url"), F.lit("").alias("html"), "refers_to")
    return rows.select("page_id", "digest", F.lit(1).alias("kind"), "url", "html", F.lit(None).cast("bigint").alias("refers_to")).unionByName(to)


def record_id(page_id: int | None, digest: bytes, again: int = 0) -> str:
    """A record's id: rows of one page_id differ in their digest or in their number."""
    return f"<urn:page:{'null' if page_id is None else page_id}:{digest.hex()[:16]}:{again}>"


def record(page_id: int | None, url: str, payload: bytes, refers_to: int | None, again: int = 0) -> bytes:
    """One WARC record; the payload is left out of a revisit."""
    revisit = refers_to is not None
    digest = hashlib.sha256(payload).digest()
    block = b"" if revisit else payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_id(page_id, digest, again)}",
        f"WARC-Date: {DATE}",
        "WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"),
        f"WARC-Payload-Digest: sha256:{digest.hex()}",
        f"WARC-Block-Digest: sha1:{base64.b32encode(hashlib.sha1(block).digest()).decode()}",
        f"X-Payload-Length: {len(payload)}",
        "Content-Type: text/html; charset=utf-8",
    ]
    if revisit:
        head += [f"WARC-Refers-To: {record_id(refers_to, digest)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head.append(f"Content-Length: {len(block)}")
    return b"".join(["\r\n".join(head).encode(), b"\r\n\r\n", block, b"\r\n\r\n"])


def members(data: bytes, step: int = 16_384) -> Iterator[bytes]:
    """The unpacked gzip members of an archive, which is read step bytes at a time."""
    view, at = memoryview(data), 0
    while at < len(view):
        d, parts = zlib.decompressobj(31), []
        while not d.eof:
            piece = view[at : at + step]
            if not piece:
                raise ValueError("the archive ends within a member")
            parts.append(d.decompress(piece))
            at += len(piece) - len(d.unused_data)
        yield b"".join(parts)


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of a record, with its digests checked."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError(f"not a WARC record: {lines[0][:40]}")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    if base64.b32encode(hashlib.sha1(block).digest()).decode() != fields["WARC-Block-Digest"].removeprefix("sha1:"):
        raise ValueError(f"block digest of {fields['WARC-Record-ID']} does not match")
    return fields, block


def write_archives(pages: DataFrame, out: str, roll_bytes: int = 64_000_000, min_revisit: int = 100) -> DataFrame:
    """Write the pages below out; one row per finished file."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, attempt = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId()
        store, root = fs.FileSystem.from_uri(out)
        stream, n_file, done, count, size, sha = None, 0, [], 0, 0, None
        pointer, before, again = (None, None, None), None, 0

        def close() -> None:
            nonlocal stream, n_file
            stream.close()
            name = f"pages-{part:06d}-{n_file:06d}"
            if store.get_file_info(f"{root}/{name}.warc.gz").type == fs.FileType.NotFound:
                store.move(f"{root}/{name}.{attempt}.tmp", f"{root}/{name}.warc.gz")
            else:  # an earlier attempt of this task left the same bytes
                store.delete_file(f"{root}/{name}.{attempt}.tmp")
            done.append({"file": f"{name}.warc.gz", "n_records": count, "n_bytes": size, "sha256": sha.hexdigest()})
            stream, n_file = None, n_file + 1

        for b in batches:
            for page_id, digest, kind, url, html, refers_to in zip(*(b.column(i).to_pylist() for i in range(4)), b.column(4), b.column(5).to_pylist(), strict=True):
                if not kind:
                    pointer = (page_id, digest, refers_to)
                    continue
                again = again + 1 if before == (page_id, digest) else 0
                before = (page_id, digest)
                if stream is None:
                    store.create_dir(root, recursive=True)
                    stream = store.open_output_stream(f"{root}/pages-{part:06d}-{n_file:06d}.{attempt}.tmp")
                    count, size, sha = 0, 0, hashlib.sha256()
                raw = record(page_id, url, html.as_buffer(), pointer[2] if pointer[:2] == before else None, again)
                z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)  # its gzip header has no time and no name
                member = z.compress(raw) + z.flush()
                stream.write(member)
                sha.update(member)
                count, size = count + 1, size + len(member)
                if size >= roll_bytes:
                    close()
        if stream is not None:
            close()
        yield pa.RecordBatch.from_pylist(done, schema=pa.schema([("file", pa.string()), ("n_records", pa.int64()), ("n_bytes", pa.int64()), ("sha256", pa.string())]))

    order = F.col("page_id").asc_nulls_first()
    ranged = with_owner(pages, min_revisit).repartitionByRange(order, "digest").sortWithinPartitions(order, "digest", "kind", "url")
    return ranged.mapInArrow(write, _MANIFEST)


def read_archives(spark: SparkSession, out: str, manifest: DataFrame, payloads: bool = True) -> DataFrame:
    """The records of the archives that the manifest names: page_id, url, payload (null: revisit, or not
    asked for), payload_bytes, payload_digest, record_type, refers_to."""
    schema = "file string, page_id bigint, url string, payload binary, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"

    def number(urn: str | None) -> int | None:
        text = urn.split(":")[2] if urn else "null"
        return int(text) if text != "null" else None

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split(" ")[0] for x in schema.split(", ")]
        types = [pa.string(), pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        shape = pa.schema(list(zip(names, types, strict=True)))
        for b in batches:
            for file, data in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                rows, size = [], 0
                for raw in members(data.as_buffer()):
                    f, block = parse(raw)
                    kind, digest = f["WARC-Type"], f["WARC-Payload-Digest"].removeprefix("sha256:")
                    if kind == "response" and hashlib.sha256(block).hexdigest() != digest:
                        raise ValueError(f"payload digest of {f['WARC-Record-ID']} does not match")
                    n = int(f["X-Payload-Length"]) if kind == "revisit" else len(block)
                    rows.append((file, number(f["WARC-Record-ID"]), f["WARC-Target-URI"], None if kind == "revisit" or not payloads else block, n, digest, kind, number(f.get("WARC-Refers-To"))))
                    size += len(block)
                    if size > 8_000_000:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], schema=shape)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], schema=shape)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(out)
    rows = files.select(F.element_at(F.split("path", "/"), -1).alias("file"), "content").mapInArrow(read, schema)
    return rows.join(manifest.select("file"), "file", "left_semi").drop("file")


def archive(pages: DataFrame, roll_bytes: int = 64_000_000, payloads: bool = False) -> DataFrame:
    """Write the pages to a new shared folder and read every record back from the archives."""
    spark, root = pages.sparkSession, shared_dir(pages.sparkSession, "warc")
    write_archives(pages, f"{root}/archives", roll_bytes).write.parquet(f"{root}/manifest")
    manifest = spark.read.schema(_MANIFEST).parquet(f"{root}/manifest")
    if manifest.isEmpty():
        return spark.createDataFrame([], "page_id bigint, url string, payload binary, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint")
    return read_archives(spark, f"{root}/archives", manifest, payloads)


SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b) AS payload_bytes, sha256(b) AS payload_digest FROM p),
o AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS owner FROM d),
r AS (SELECT *, payload_bytes >= 100 AND page_id <> owner AS again FROM o)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest,
  CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN owner END AS refers_to FROM r
"""
