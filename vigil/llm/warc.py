"""WARC archives as a chunked record table.

Pages are written as WARC/1.1 files through Spark's text sink and read back
through its text source.  A payload over ``chunk`` bytes becomes several rows,
(record, chunk number), each a WARC segment record of its own; readers hash a
record chunk by chunk, so no task holds a whole oversized record twice and
none holds it at all while reading back.

Records are separated on reading by the blank lines and version line between
them, so files stay splittable.  For that, a payload is also cut inside every
"WARC/1.1" line of its own: no segment holds a whole one.

Of records with equal payloads of at least ``least`` bytes the one with the
smallest page id is a response and the others are revisits of it.  Rows that
share that smallest id are all responses.

Defined cases: null payloads are empty; rows with a null id are responses and
nothing refers to them; rows that occur more than once give a record each;
line breaks in URLs are written percent-encoded; extra columns are not
archived.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.llm.common import scratch, store

CHUNK = 64 << 10
LEAST = 100
VERSION = b"WARC/1.1\r\n"
DATE = "2000-01-01T00:00:00Z"        # the table has no time of capture
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def cuts(payload: memoryview, chunk: int):
    """Stretches of a payload: at most ``chunk`` bytes, none of them with a
    whole version line."""
    inside = [m.start() + 6 for m in re.finditer(re.escape(VERSION), payload)]
    at, i = 0, 0
    while True:
        end = min(at + chunk, len(payload))
        while i < len(inside) and inside[i] <= at:
            i += 1
        if i < len(inside):
            end = min(end, inside[i])
        yield payload[at:end]
        at = end
        if at >= len(payload):
            return


def _record(fields: list[tuple[str, object]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None)
    return VERSION + head.encode() + b"Content-Length: %d\r\n\r\n" % len(block) + block + b"\r\n"


def write_archive(pages: DataFrame, path: str, chunk: int = CHUNK, least: int = LEAST) -> None:
    """Write one record per row of ``pages`` (page_id, url, html)."""
    payload = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                        payload.alias("payload"), F.sha2(payload, 256).alias("digest"),
                        F.octet_length(payload).alias("n"))
    first = store(rows.where((F.col("n") >= least) & F.col("page_id").isNotNull()).groupBy("digest")
                  .agg(F.min("page_id").alias("first"), F.count("*").alias("times")).where("times > 1")
                  .select("digest", "first"), "equal-payloads")
    known = rows.join(first, "digest", "left").select("page_id", "url", "payload", "digest", "first")

    def records(batches):
        part, number = TaskContext.get().partitionId(), 0
        for b in batches:
            for r in range(b.num_rows):
                page, url, digest, first_id = (b.column(i)[r].as_py() for i in (0, 1, 3, 4))
                body = memoryview(b.column(2)[r].as_buffer())
                number += 1
                name = f"<urn:page:{'' if page is None else page}>"
                url = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")
                http = (b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
                        b"Content-Length: %d\r\n\r\n" % len(body))
                common = [("WARC-Record-ID", name), ("WARC-Date", DATE), ("WARC-Target-URI", url or None),
                          ("WARC-Payload-Digest", f"sha256:{digest}"), ("X-Row", f"{part}-{number}")]
                if first_id is not None and page is not None and page != first_id:
                    out = [_record([("WARC-Type", "revisit"), *common, ("WARC-Refers-To", f"<urn:page:{first_id}>"),
                                    ("WARC-Profile", PROFILE), ("Content-Type", "application/http; msgtype=response")],
                                   http)]
                else:
                    out, held = [], list(cuts(body, chunk)) if len(body) else [b""]
                    for k, piece in enumerate(held, 1):
                        several = len(held) > 1
                        fields = [("WARC-Type", "response" if k == 1 else "continuation")]
                        fields += common if k == 1 else [
                            ("WARC-Record-ID", f"<urn:page:{'' if page is None else page}:{k}>"), ("WARC-Date", DATE),
                            ("WARC-Segment-Origin-ID", name), ("X-Row", f"{part}-{number}")]
                        fields += [("WARC-Segment-Number", k if several else None),
                                   ("WARC-Segment-Total-Length", len(body) + len(http)
                                    if several and k == len(held) else None)]
                        if k == 1:
                            fields.append(("Content-Type", "application/http; msgtype=response"))
                        out.append(_record(fields, (http if k == 1 else b"") + bytes(piece)))
                        if sum(map(len, out)) > 4 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])
                            out = []
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["value"])

    def gathered(batches):
        held, size = [], 0
        for b in records(batches):
            held.append(b)
            size += b.nbytes
            if size > 4 << 20:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                held, size = [], 0
        if held:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    (known.mapInArrow(gathered, "value binary").select(F.col("value").cast("string").alias("value"))
     .write.option("lineSep", "\r\n").text(path))


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """The chunked record table: (row, page_id, type, refers_to, chunk,
    payload_digest as the header has it, payload_bytes as the HTTP header has
    it, data); chunk is 0 for a record in one piece."""
    raw = spark.read.option("lineSep", (b"\r\n\r\n" + VERSION).decode()).text(path).select(F.col("value").cast("binary"))

    def name(v):
        v = (v or "").removeprefix("<urn:page:").removesuffix(">").split(":")[0]
        return int(v) if v else None

    def parse(batches):
        for b in batches:
            rows = []
            for v in b.column(0):
                data = v.as_py().removeprefix(VERSION)
                if not data:
                    continue
                head, _, block = data.partition(b"\r\n\r\n")
                fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n"))
                block = block[:int(fields["Content-Length"])]
                kind, size = fields["WARC-Type"], None
                if kind != "continuation":
                    http, _, block = block.partition(b"\r\n\r\n")
                    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
                rows.append((fields["X-Row"], name(fields.get("WARC-Segment-Origin-ID") or fields["WARC-Record-ID"]), kind,
                             name(fields.get("WARC-Refers-To")), int(fields.get("WARC-Segment-Number", 0)),
                             fields.get("WARC-Payload-Digest", "").removeprefix("sha256:") or None, size, block))
            cols = list(zip(*rows)) if rows else [()] * 8
            kinds = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)],
                                             ["row", "page_id", "type", "refers_to", "chunk", "digest", "size", "data"])

    return raw.mapInArrow(parse, "row string, page_id long, type string, refers_to long, chunk int, digest string, "
                                 "size long, data binary")


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to,
    n_chunks, digest_ok): lengths and digests of responses are those of the
    bytes read back."""
    chunks = read_chunks(spark, path)
    one = F.col("chunk") == 0
    light = chunks.withColumns({
        "length": F.octet_length("data").cast("long"),
        "own": F.when(one, F.sha2("data", 256)),
        "data": F.when(one, F.lit(None)).otherwise(F.col("data"))})

    def assemble(batches):
        out: list[tuple] = []
        open_row, first, hasher, length, n = None, None, None, 0, 0

        def close():
            page, kind, refers, digest, size = first
            out.append((page, length, hasher.hexdigest(), kind, refers, n, hasher.hexdigest() == digest and length == size))

        def flush():
            cols = list(zip(*out))
            return pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(),
                                                       pa.int32(), pa.bool_()))],
                ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "n_chunks", "digest_ok"])

        for b in batches:
            for row, page, kind, refers, chunk, digest, size, data, mine, own in zip(*(c.to_pylist() for c in b.columns)):
                if chunk == 0:
                    if kind == "revisit":
                        out.append((page, size, digest, kind, refers, 0, True))
                    else:
                        out.append((page, mine, own, kind, refers, 1, own == digest and mine == size))
                    continue
                if row != open_row:
                    if open_row is not None:
                        close()
                    open_row, hasher, length, n = row, hashlib.sha256(), 0, 0
                if chunk == 1:
                    first = (page, kind, refers, digest, size)
                hasher.update(data)
                length, n = length + len(data), n + 1
            if len(out) > 10_000:
                yield flush()
                out.clear()
        if open_row is not None:
            close()
        if out:
            yield flush()

    return (light.repartition("row").sortWithinPartitions("row", "chunk")
            .mapInArrow(assemble, "page_id long, payload_bytes long, payload_digest string, record_type string, "
                                  "refers_to long, n_chunks int, digest_ok boolean"))


def op7_query(spark, sf_dir):
    import uuid
    path = f"{scratch(spark)}/archive-{uuid.uuid4().hex}"
    write_archive(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    return read_archive(spark, path).drop("n_chunks", "digest_ok")
