"""WARC archives: written from page rows, read back, and assembled into captures.

Writing: each page becomes a response record, or a revisit of the page with the
smallest id that has the same payload, and beside it a request and a metadata
record that name it by WARC-Concurrent-To. Records are built from SQL functions
and written by Spark's text writer with the record separator as line end, so the
files are plain WARC/1.1 and live wherever Spark writes. Records are written by
classes of the size of all three, each with as many pages to a file as keep it
within :data:`FILE_BYTES`; a page that is larger has a file of its own.

Reading: whole files, bounded so, come through Spark's binary reader, are cut by
Content-Length and become rows. Assembly joins request and metadata records to
the response or revisit that they are concurrent to; one nested row a capture.
What a revisit refers to is found by its WARC-Refers-To among the responses.

Defined results: a null payload or url is empty; columns but the id, the url and
the html are not used, whatever their names; payloads under
:data:`LEAST_BYTES` bytes are always responses, as are all rows that share both
payload and smallest id; rows with a null id take part (a null is no smallest
id unless there is no other). Record ids come from the page id and a digest of
the row, so equal rows have equal records and stay as many captures as rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm.common import broadcast_if_small, new_path, removed, stored, table

#: Payloads below are never revisits.
LEAST_BYTES = 100
#: Bytes in a file at most (the records of a larger page have a file of their own): what a reading task holds at a time follows from it.
FILE_BYTES = 32 << 20
#: Pages are written by classes of size: up to 2^16 bytes, then by steps of 2^3. What headers add to a page's three records at most.
POWERS, HEADERS = (16, 3), 3 << 10
SEPARATOR = "\r\n\r\n"
DATE = "2024-01-01T00:00:00Z"


def _urn(kind: str, key: Column) -> Column:
    """A record id in the form of a UUID, from a kind and a key."""
    h = F.sha2(F.concat(F.lit(kind + ":"), key).cast("binary"), 256)
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]), F.lit(">"))


def _bytes(text: Column) -> Column:
    return F.octet_length(text).cast("long")


def _one_line(text: Column) -> Column:
    """A header value: line breaks and other control characters become blanks."""
    return F.regexp_replace(text, r"[\x00-\x1F\x7F]", " ")


def _record(kind: Column, record_id: Column, headers: list[tuple[str, Column]], block: Column) -> Column:
    """One record without its separator; null headers are left out."""
    lines = [F.lit("WARC/1.1"), F.concat(F.lit("WARC-Type: "), kind), F.concat(F.lit("WARC-Record-ID: "), record_id), F.lit(f"WARC-Date: {DATE}")]
    lines += [F.concat(F.lit(f"{k}: "), v) for k, v in headers]
    lines.append(F.concat(F.lit("Content-Length: "), _bytes(block).cast("string")))
    return F.concat(F.concat_ws("\r\n", *lines), F.lit(SEPARATOR), block)


def with_revisits(pages: DataFrame, page_id: str, html: str) -> DataFrame:
    """``pages`` with w_payload, w_bytes, w_digest, w_first: the response's page id for revisits.

    Only payloads that occur twice or more are kept as digests with their first
    id; that table is broadcast when counted small, else joined by shuffle.
    """
    # A payload that many pages share would meet in one task; the digests alone are grouped, summed up before they are shuffled.
    body = F.coalesce(F.col(f"`{html}`"), F.lit(""))
    sized = pages.select("*", body.alias("w_payload")).withColumns({"w_bytes": _bytes(F.col("w_payload")), "w_digest": F.sha2(F.col("w_payload").cast("binary"), 256)})
    shared = sized.filter(F.col("w_bytes") >= LEAST_BYTES).groupBy("w_digest").agg(F.min(page_id).alias("w_first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    shared = stored(shared, "warc-shared")
    out = sized.join(broadcast_if_small(shared), "w_digest", "left")
    again = (F.col("w_bytes") >= LEAST_BYTES) & F.col("w_first").isNotNull() & ~F.col(page_id).eqNullSafe(F.col("w_first"))
    return out.withColumn("w_first", F.when(again, F.col("w_first")))


def write_warc(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", html: str = "html") -> None:
    """Writes a response or revisit, a request and a metadata record for each row to WARC files under ``path``."""
    rows = with_revisits(pages.select(page_id, url, html), page_id, html)
    ident = F.coalesce(F.col(page_id).cast("string"), F.lit("none"))
    # A response is found by its id and payload, so that a revisit can name it.
    target = F.coalesce(_one_line(F.col(url)), F.lit(""))
    response_id = _urn("response", F.concat_ws(":", ident, F.col("w_digest")))
    own_id = F.when(F.col("w_first").isNull(), response_id).otherwise(_urn("revisit", F.concat_ws(":", ident, F.col("w_digest"))))
    digest = F.concat(F.lit("sha256:"), F.col("w_digest"))
    size = F.col("w_bytes").cast("string")
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), size, F.lit(SEPARATOR))
    refers = F.when(F.col("w_first").isNotNull(), _urn("response", F.concat_ws(":", F.col("w_first").cast("string"), F.col("w_digest"))))
    profile = F.when(F.col("w_first").isNotNull(), F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))
    main = _record(
        F.when(F.col("w_first").isNull(), F.lit("response")).otherwise(F.lit("revisit")), own_id,
        [("WARC-Target-URI", target), ("Content-Type", F.lit("application/http; msgtype=response")), ("WARC-Payload-Digest", digest), ("WARC-Profile", profile), ("WARC-Refers-To", refers)],
        F.when(F.col("w_first").isNull(), F.concat(head, F.col("w_payload"))).otherwise(head),
    )
    asked = F.concat(F.lit("GET "), F.replace(target, F.lit(" "), F.lit("%20")), F.lit(" HTTP/1.1" + SEPARATOR))
    request = _record(F.lit("request"), _urn("request", F.concat_ws(":", ident, F.col("w_digest"))), [("WARC-Target-URI", target), ("Content-Type", F.lit("application/http; msgtype=request")), ("WARC-Concurrent-To", own_id)], asked)
    facts = F.to_json(F.struct(F.col(page_id).alias("page_id"), F.col(url).alias("url")))
    metadata = _record(F.lit("metadata"), _urn("metadata", F.concat_ws(":", ident, F.col("w_digest"))), [("WARC-Target-URI", target), ("Content-Type", F.lit("application/json")), ("WARC-Concurrent-To", own_id)], facts)
    # What a page's records come to at most: the html once; the url in three headers, in the request's line (a blank takes three bytes there) and in the metadata (up to six).
    most = F.coalesce(_bytes(F.col(f"`{html}`")), F.lit(0)) + 12 * F.coalesce(_bytes(F.col(f"`{url}`")), F.lit(0)) + HEADERS
    power = (F.lit(POWERS[0]) + POWERS[1] * F.greatest(F.ceil((F.log2(most) - POWERS[0]) / POWERS[1]), F.lit(0))).cast("int")
    records = rows.select(power.alias("w_power"), F.array(main, request, metadata).alias("w_records"))
    for (p,) in sorted(pages.select(power).distinct().collect()) or [(POWERS[0],)]:  # at most six classes
        lines = records.filter(F.col("w_power") == p).select(F.explode("w_records").alias("value"))
        lines.write.option("lineSep", SEPARATOR).option("maxRecordsPerFile", 3 * max(1, FILE_BYTES >> p)).text(f"{path.rstrip('/')}/upto-{1 << p}")


RECORD = T.StructType(
    [
        T.StructField("record_id", T.StringType()),
        T.StructField("record_type", T.StringType()),
        T.StructField("concurrent_to", T.StringType()),
        T.StructField("refers_to", T.StringType()),
        T.StructField("target_uri", T.StringType()),
        T.StructField("payload_digest", T.StringType()),
        T.StructField("payload_sha256", T.StringType()),
        T.StructField("payload_bytes", T.LongType()),
        T.StructField("headers", T.MapType(T.StringType(), T.StringType())),
        T.StructField("block", T.BinaryType()),
    ]
)


def parse_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of each record of a plain WARC file; raises on a broken frame."""
    at, size = 0, len(data)
    while at < size:
        head = data.find(b"\r\n\r\n", at)
        if head < 0 or not data.startswith(b"WARC/", at):
            raise ValueError(f"no WARC record at byte {at}")
        lines = data[at:head].decode("utf-8", "replace").split("\r\n")[1:]
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        end = head + 4 + int(headers["content-length"])
        if data[end : end + 4] != b"\r\n\r\n":
            raise ValueError(f"the record at byte {at} doesn't end where its length says")
        yield headers, data[head + 4 : end]
        at = end + 4


def read_warc(spark: SparkSession, path: str, blocks: bool = True) -> DataFrame:
    """The records below ``path`` as rows of :data:`RECORD`; ``blocks`` False leaves the blocks of other than metadata records out.

    payload_sha256 and payload_bytes are of what follows the HTTP head of a response.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").option("recursiveFileLookup", "true").load(path).select("content")
    arrow = pa.schema([("record_id", pa.string()), ("record_type", pa.string()), ("concurrent_to", pa.string()), ("refers_to", pa.string()), ("target_uri", pa.string()), ("payload_digest", pa.string()), ("payload_sha256", pa.string()), ("payload_bytes", pa.int64()), ("headers", pa.map_(pa.string(), pa.string())), ("block", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                rows = []
                for h, block in parse_records(content.as_py()):
                    kind, payload = h.get("warc-type"), None
                    if kind == "response":
                        payload = block[block.find(b"\r\n\r\n") + 4 :]
                    kept = block if blocks or kind == "metadata" else None
                    sha = hashlib.sha256(payload).hexdigest() if payload is not None else None
                    rows.append((h.get("warc-record-id"), kind, h.get("warc-concurrent-to"), h.get("warc-refers-to"), h.get("warc-target-uri"), h.get("warc-payload-digest"), sha, None if payload is None else len(payload), list(h.items()) if blocks else None, kept))
                columns = zip(*rows, strict=True) if rows else [[] for _ in arrow]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    return files.mapInArrow(run, RECORD)


def captures(records: DataFrame) -> DataFrame:
    """One nested row for each response or revisit: capture_id, record, request and metadata.

    Request and metadata records are gathered by the record they are concurrent
    to; with equal capture records (equal rows written twice) the captures stay
    as many. A capture without one of them has a null there; a request or
    metadata record that is concurrent to no capture is not part of one.
    """
    mains = records.filter(F.col("record_type").isin("response", "revisit"))
    record = F.struct(*[F.col(c) for c in records.columns])
    others = records.filter(F.col("record_type").isin("request", "metadata") & F.col("concurrent_to").isNotNull())
    slim = F.struct("record_id", "target_uri", "headers", "block")
    beside = others.groupBy("concurrent_to").agg(F.max_by(slim, F.when(F.col("record_type") == "request", F.col("record_id"))).alias("request"), F.max_by(slim, F.when(F.col("record_type") == "metadata", F.col("record_id"))).alias("metadata"))
    return mains.select(F.col("record_id").alias("capture_id"), record.alias("record")).join(beside.withColumnRenamed("concurrent_to", "capture_id"), "capture_id", "left")


def resolved(found: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to (a page id) and url of each capture.

    A revisit's payload is that of the response whose record id its
    WARC-Refers-To names; a response that isn't in the archives leaves nulls.
    """
    facts = F.from_json(F.decode("metadata.block", "utf-8"), "page_id bigint, url string")
    rows = found.select("capture_id", "record.record_type", "record.refers_to", "record.payload_sha256", "record.payload_bytes", facts.alias("facts"))
    rows = stored(rows.select("*", "facts.page_id", "facts.url").drop("facts"), "warc-captures")
    again = rows.filter("record_type = 'revisit'")
    first = rows.filter("record_type = 'response'")
    named = again.select(F.col("refers_to").alias("capture_id")).distinct()
    targets = first.drop("refers_to").join(named, "capture_id", "left_semi").groupBy(F.col("capture_id").alias("refers_to"))
    targets = stored(targets.agg(F.min("page_id").alias("first"), F.min("payload_sha256").alias("sha"), F.min("payload_bytes").alias("n")), "warc-targets")
    again = again.join(broadcast_if_small(targets), "refers_to", "left")
    out = first.select("page_id", "payload_bytes", F.col("payload_sha256").alias("payload_digest"), "record_type", F.lit(None).cast("long").alias("refers_to"), "url")
    return out.unionByName(again.select("page_id", F.col("n").alias("payload_bytes"), F.col("sha").alias("payload_digest"), "record_type", F.col("first").alias("refers_to"), "url"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "warc")
    write_warc(table(spark, sf_dir, "pages"), path)
    out = resolved(captures(read_warc(spark, path, blocks=False)))
    removed(spark, path)
    return out


OP8_SQL = f"""
WITH p AS (SELECT page_id, url, coalesce(html, '') AS t, sha256(coalesce(html, '')) AS payload_digest, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first FROM p GROUP BY 1)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= {LEAST_BYTES} AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= {LEAST_BYTES} AND page_id <> first THEN first END AS refers_to, url
FROM p JOIN f USING (payload_digest)
"""

QUERIES = {"op8_warc": op8_warc}
ORACLES = {"op8_warc": OP8_SQL}
