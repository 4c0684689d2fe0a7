"""WARC archives: a deterministic sharded writer and a reader.

Record order, file borders and file contents follow from the rows alone, however Spark deals them out.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pastframe.llm.common import let, let_workers_import, salted_join, scratch, sliced, written

MANIFEST = "MANIFEST.parquet"
_END = b"\r\n\r\n"


@dataclass(frozen=True)
class Layout:
    #: A file is closed once it holds so many compressed bytes.
    roll_bytes: int = 16 << 20
    #: Payload bytes of a range of page ids, which is the unit of work and of numbering.
    range_bytes: int = 64 << 20
    #: Payloads shorter than this are never revisits.
    revisit_bytes: int = 100
    #: There are at most so many ranges: beyond that they grow. The borders, which go out as a broadcast, are a few megabytes.
    max_ranges: int = 1 << 16


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path that driver and executors share."""
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def record_id(page_id: int | None, digest: str) -> str:
    """A page's urn; pages without an id go by what they hold."""
    return f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}' if page_id is not None else f'payload:{digest}')}"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """One WARC record, headers made anew from the row: a response, or a revisit without its payload."""
    sha = base64.b32encode(bytes.fromhex(digest)).decode()
    head = [f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{record_id(page_id, digest)}>", f"WARC-Date: {date}"]
    head.append("WARC-Target-URI: " + (url or f"urn:page:{'' if page_id is None else page_id}").replace("\r", "%0D").replace("\n", "%0A").replace(" ", "%20"))
    head.append(f"WARC-Payload-Digest: sha256:{sha}")
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    head.append(f"X-Payload-Length: {len(payload)}")
    if refers_to is not None:
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        head.append(f"WARC-Refers-To: <{record_id(refers_to, digest)}>")
        head.append(f"X-Refers-To-Page-Id: {refers_to}")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if refers_to is None else b"")
    head.append("Content-Type: application/http; msgtype=response")
    head.append(f"WARC-Block-Digest: sha256:{base64.b32encode(hashlib.sha256(block).digest()).decode()}")
    head.append(f"Content-Length: {len(block)}")
    return b"WARC/1.1\r\n" + "\r\n".join(head).encode("utf-8", "replace") + _END + block + _END


#: Borders are looked up in two steps: among the first of so many each, then among those.
FAN = 256


def place(page_id: Column, digest: Column) -> Column:
    """Text in the order of page id, none first, then payload digest."""
    flipped = F.lpad(F.hex(page_id.bitwiseXOR(F.lit(-(1 << 63)))), 16, "0")
    return F.concat(F.coalesce(flipped, F.lit("!")), digest)


def borders(types: DataFrame, p: Layout) -> list[str]:
    """The first place of every range, in order: p.max_ranges + 1 of them at most.

    Pages are summed up exactly in the order of their places: they are range-partitioned, each partition has its total,
    totals are summed in order, and within a partition a window runs on. A range ends where the sum passes a multiple of
    its size, so ids may lie as unevenly as they like; only copies of one page with one payload can't be divided. The
    result follows from the rows alone, however Spark cuts its partitions.
    """
    some = types.groupBy(place(F.col("page_id"), F.col("payload_digest")).alias("at")).agg(F.sum("payload_bytes").alias("n"))
    cut = written(some.repartitionByRange(int(types.sparkSession.conf.get("spark.sql.shuffle.partitions")), "at").withColumn("part", F.spark_partition_id()), "page-order")
    total = cut.groupBy("part").agg(F.sum("n").alias("all"))
    upto = F.coalesce(F.sum("all").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row per partition
    whole = total.agg(F.greatest(F.lit(p.range_bytes), F.ceil(F.sum("all") / p.max_ranges)).alias("size"))
    base = total.select("part", upto.alias("base")).crossJoin(F.broadcast(whole))  # one row
    w = Window.partitionBy("part").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    before = cut.join(F.broadcast(base), "part").withColumn("before", F.col("base") + F.coalesce(F.sum("n").over(w), F.lit(0)))
    first = before.groupBy(F.floor(F.col("before") / F.col("size"))).agg(F.min("at").alias("first"))
    return sorted(first.toPandas()["first"])


def range_of(at: Column, firsts: list[str]) -> Column:
    """The number of the range that holds a place: how many firsts are not behind it, less one."""
    chunks = [firsts[i : i + FAN] for i in range(0, len(firsts), FAN)] or [[""]]
    listed = lambda xs, sep: F.split(F.lit(sep.join(xs)), sep)  # noqa: E731  a constant, so no row carries it
    upto = lambda xs, x: F.size(F.filter(xs, lambda y: y <= x)) - 1
    of = lambda x, k: k * FAN + upto(F.split(F.get(listed(map(",".join, chunks), ";"), k), ","), x)
    return let(at, lambda x: let(F.greatest(upto(listed([c[0] for c in chunks], ","), x), F.lit(0)), lambda k: of(x, k)))


def record_types(pages: DataFrame, p: Layout = Layout()) -> DataFrame:
    """page_id, payload_bytes, payload_digest and refers_to of each page.

    Pages of one digest refer to the smallest page id, except short ones; pages without an id refer, but are never referred to. Minima are taken with partial aggregation; the
    join on digests holds numbers only, and only digests that occur twice.
    """
    body = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    d = pages.select("page_id", F.length(body).cast("long").alias("payload_bytes"), F.sha2(body, 256).alias("payload_digest"))
    first = d.where(F.col("payload_bytes") >= p.revisit_bytes).groupBy("payload_digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("payload_digest", "first")
    return salted_join(d, first, ["payload_digest"], "left").select(
        "page_id", "payload_bytes", "payload_digest", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to")
    )


def write_archives(pages: DataFrame, out: str, p: Layout = Layout(), date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Write the pages (page_id, url, html) under out and return the manifest: file, records, bytes, sha256, first and last id.

    Ranges of about p.range_bytes of payload, cut from all pages in the order of id and payload digest, are sorted each by
    a task of its own; within a range a file is closed once it holds p.roll_bytes, and each record is a gzip member of its
    own. A task writes under a temporary name and renames: a repeated task puts the same bytes under the same name. Files
    count once the manifest, renamed last, lists them. Null html is an empty payload, a null url a urn. Rows without
    page_id come first, without that header; the smallest id among equal payloads is what they refer to, and where none
    has an id all are responses. A page id that repeats is written each time, in the order of its payload digest. Other
    columns are not carried. No pages: an empty manifest.
    """
    spark = pages.sparkSession
    with scratch(spark):
        return _write_archives(pages, out, p, date)


def _write_archives(pages: DataFrame, out: str, p: Layout, date: str) -> DataFrame:
    spark = pages.sparkSession
    let_workers_import(spark)
    body = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    full = pages.select("page_id", F.sha2(body, 256).alias("payload_digest"), F.lit(1).alias("kind"), F.lit(None).cast("bigint").alias("refers_to"), "url", body.alias("payload"))
    types = written(record_types(pages, p), "record-types")
    firsts = borders(types, p)
    kinds = types.dropDuplicates(["page_id", "payload_digest"]).select("page_id", "payload_digest", F.lit(0).alias("kind"), "refers_to", F.lit(None).cast("string").alias("url"), F.lit(None).cast("binary").alias("payload"))
    # one shuffle of the payloads serves both their join with the types and the sort: the two kinds of rows meet in page order
    met = kinds.unionByName(full).withColumn("range", range_of(place(F.col("page_id"), F.col("payload_digest")), firsts))
    ordered = met.repartitionById(max(1, len(firsts)), F.col("range")).sortWithinPartitions("range", "page_id", "payload_digest", "kind", "url")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = open_fs(out)
        fs.create_dir(root, recursive=True)
        now, rows = None, []

        def close() -> None:
            stream, temp, name, facts, sha = now
            stream.close()
            fs.move(temp, f"{root}/{name}")
            rows.append({"file": name, **facts, "sha256": sha.hexdigest()})

        at = refers_to = None
        for r in (r for whole in batches for b in sliced(whole, "payload") for r in b.to_pylist()):
            if r["kind"] == 0:
                refers_to = r["refers_to"]
                continue
            if now and (r["range"] != at[0] or now[3]["bytes"] >= p.roll_bytes):
                close()
                now = None
            if now is None:
                at = (r["range"], at[1] + 1 if at and at[0] == r["range"] else 0)
                name = f"pages-{at[0]:06d}-{at[1]:05d}.warc.gz"
                temp = f"{root}/.{name}.{uuid.uuid4().hex}"
                now = fs.open_output_stream(temp), temp, name, {"records": 0, "bytes": 0, "first_id": r["page_id"], "last_id": None}, hashlib.sha256()
            blob = gzip.compress(record(r["page_id"], r["url"], r["payload"], r["payload_digest"], refers_to, date), 6, mtime=0)
            now[0].write(blob)
            now[4].update(blob)
            now[3]["records"] += 1
            now[3]["bytes"] += len(blob)
            now[3]["last_id"] = r["page_id"]
        if now:
            close()
        if rows:
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("file", pa.string()), ("records", pa.int64()), ("bytes", pa.int64()), ("first_id", pa.int64()), ("last_id", pa.int64()), ("sha256", pa.string())]))

    manifest = ordered.mapInArrow(write, "file string, records bigint, bytes bigint, first_id bigint, last_id bigint, sha256 string")
    temp = f"{out}/.{MANIFEST}.{uuid.uuid4().hex}"
    manifest.write.parquet(temp)
    path = spark._jvm.org.apache.hadoop.fs.Path
    path(out).getFileSystem(spark._jsc.hadoopConfiguration()).rename(path(temp), path(f"{out}/{MANIFEST}"))
    return spark.read.parquet(f"{out}/{MANIFEST}")


def members(stream) -> Iterator[bytes]:
    """The gzip members of a stream, one at a time; each is held whole, nothing else is."""
    held = b""
    while True:
        d, parts = zlib.decompressobj(31), []
        held = held or stream.read(1 << 20)
        if not held:
            return
        while not d.eof:
            if not held:
                raise ValueError("an archive ends within a record")
            parts.append(d.decompress(held))
            held = d.unused_data if d.eof else stream.read(1 << 20)
        yield b"".join(parts)


def parse(blob: bytes) -> dict:
    """Headers and payload of one record; lengths and the block's digest are checked."""
    head, _, rest = blob.partition(_END)
    lines = head.decode().split("\r\n")
    h = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(h["Content-Length"])]
    if lines[0] != "WARC/1.1" or rest[len(block) :] != _END or h["WARC-Block-Digest"] != f"sha256:{base64.b32encode(hashlib.sha256(block).digest()).decode()}":
        raise ValueError(f"broken record {h.get('WARC-Record-ID')}")
    payload = block.partition(_END)[2]
    return {
        "page_id": int(h["X-Page-Id"]) if "X-Page-Id" in h else None, "url": h["WARC-Target-URI"], "record_type": h["WARC-Type"], "payload": payload if h["WARC-Type"] == "response" else None,
        "payload_bytes": int(h["X-Payload-Length"]), "payload_digest": base64.b32decode(h["WARC-Payload-Digest"].split(":")[1]).hex(),
        "refers_to": int(h["X-Refers-To-Page-Id"]) if "X-Refers-To-Page-Id" in h else None,
    }


def read_archives(spark: SparkSession, out: str, payload: bool = True) -> DataFrame:
    """The records of the files that the manifest under out lists, one task a file, in constant memory but for one record.

    Responses are checked against their payload digest. Without payload, that column is left out after the check.
    """
    let_workers_import(spark)
    files = spark.read.parquet(f"{out}/{MANIFEST}").select("file")
    n = max(1, files.count())
    kinds = [("page_id", "bigint", pa.int64()), ("url", "string", pa.string()), ("record_type", "string", pa.string()), ("payload", "binary", pa.binary()), ("payload_bytes", "bigint", pa.int64()), ("payload_digest", "string", pa.string()), ("refers_to", "bigint", pa.int64())]
    kinds = [k for k in kinds if payload or k[0] != "payload"]
    schema = pa.schema([(k, t) for k, _, t in kinds])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = open_fs(out)
        for b in batches:
            for name in b.column("file").to_pylist():
                rows, size = [], 0
                with fs.open_input_stream(f"{root}/{name}", compression=None) as stream:
                    for blob in members(stream):
                        r = parse(blob)
                        if r["payload"] is not None and (len(r["payload"]) != r["payload_bytes"] or hashlib.sha256(r["payload"]).hexdigest() != r["payload_digest"]):
                            raise ValueError(f"page {r['page_id']} in {name}: the payload isn't what its headers say")
                        rows.append({k: r[k] for k in schema.names})
                        size += len(blob) if payload else 500
                        if size > 8 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    return files.repartition(n, F.xxhash64("file")).mapInArrow(read, ", ".join(f"{k} {t}" for k, t, _ in kinds))


def manifest_json(manifest: DataFrame) -> DataFrame:
    """The manifest as one JSON line per file."""
    return manifest.select(F.to_json(F.struct(*manifest.columns)).alias("value"))


def same_files(a: DataFrame, b: DataFrame) -> bool:
    """Whether two manifests list files of the same names and contents."""
    rows = [{json.dumps(r.asDict(), sort_keys=True) for r in m.select("file", "sha256", "records").toLocalIterator()} for m in (a, b)]
    return rows[0] == rows[1]
