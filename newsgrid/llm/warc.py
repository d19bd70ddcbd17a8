"""WARC archives with revisit records for repeated payloads.

Headers (page, size, SHA-1) are grouped by payload digest; of the pages that share a payload of at least `least` bytes
the one with the largest page_id keeps it, the others become revisit records that refer to it.  Archives are written by
Spark's text sink, one gzip file per task: a record is one value and the sink's line end is the CR LF CR LF that ends
a record.  They are read back as CR LF lines, in order, since a gzip file is never split.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from newsgrid.llm.common import checkpointed, col, ensure_checkpoint_dir, fresh, text_or_empty, without

LEAST_BYTES = 1000
DATE = "2024-01-01T00:00:00Z"
#: Repeated payloads up to this many, the most frequent ones, are sent to all tasks (about 60 bytes each).
SMALL = 100_000
CRLF = "\r\n"
SCHEMA = "page_id long, record_type string, url string, refers_to long, payload_bytes long, payload_digest string, payload binary"


def _marked(rows: DataFrame, digest: str, groups: DataFrame, n: int, bucket: str, bits: str) -> DataFrame:
    """rows with a column `bits` that is true wherever the digest may be one of the n groups' (never false where it is):
    a bitmap of one hash per group, 16 bits for each, 32 MB at most, sent to all tasks in pieces of 4 KB."""
    size = 1 << max(15, min(28, (16 * n).bit_length()))
    place = F.pmod(F.xxhash64(col(digest)), F.lit(size).cast("long"))
    maps = groups.select(place.alias(bits)).groupBy(F.bitmap_bucket_number(bits).alias(bucket)).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bits)).alias(bits))
    at = F.bitmap_bit_position(place)
    byte = F.conv(F.hex(F.substring(bits, (F.call_function("div", at, F.lit(8)) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    found = rows.withColumn(bucket, F.bitmap_bucket_number(place)).join(F.broadcast(maps), bucket, "left")
    return found.withColumn(bits, F.coalesce(F.call_function("shiftright", byte, (at % 8).cast("int")) % 2 == 1, F.lit(False))).drop(bucket)


def resolve(pages: DataFrame, least: int = LEAST_BYTES) -> DataFrame:
    """pages with payload_bytes, payload_digest, record_type and refers_to.

    A null html is an empty payload.  A null page_id counts as the smallest.  Rows that share payload and largest
    page_id: one is the response, the others revisit that page_id.  Input columns named like the added ones are replaced.

    Only headers (digest, page_id, counts) are shuffled to find the shared payloads.  The SMALL most frequent of them are
    sent to all tasks, so a payload that very many pages share is never gathered; where there are more, each of those is
    on fewer than one in SMALL pages, a bitmap tells which pages may hold one, and only these pages are shuffled.
    """
    added = ("payload_bytes", "payload_digest", "record_type", "refers_to")
    pages = without(pages, *added)
    top, same, rank, bucket, bits = fresh(pages, "_top", "_same", "_rank", "_bucket", "_bits", also=added)
    body = text_or_empty("html").cast("binary")
    sized = pages.withColumn("payload_bytes", F.octet_length(body).cast("long")).withColumn("payload_digest", F.sha1(body))
    per_page = sized.filter(F.col("payload_bytes") >= least).groupBy("payload_digest", "page_id").agg(F.count(F.lit(1)).alias("n"))
    groups = per_page.groupBy("payload_digest").agg(F.sum("n").alias("n"), F.max(F.struct("page_id", "n")).alias("top"))
    groups = checkpointed(groups.filter("n > 1").select("payload_digest", "n", F.col("top.page_id").alias(top), F.col("top.n").alias(same)))
    groups_n, tied = groups.agg(F.count(F.lit(1)), F.coalesce(F.max(same), F.lit(0))).first()
    if groups_n <= SMALL:
        joined = sized.join(F.broadcast(groups.drop("n")), "payload_digest", "left")
    else:
        often = checkpointed(groups.orderBy(F.desc("n"), "payload_digest").limit(SMALL).drop("n"))
        rest = groups.drop("n").join(F.broadcast(often.select("payload_digest")), "payload_digest", "left_anti")
        known = _marked(sized.join(F.broadcast(often), "payload_digest", "left"), "payload_digest", rest, groups_n, bucket, bits)
        open_ = known.filter(col(bits) & col(same).isNull()).drop(bits, top, same).join(rest, "payload_digest", "left")
        joined = known.filter(~(col(bits) & col(same).isNull())).drop(bits).unionByName(open_)
    shared = col(same).isNotNull() & (F.col("payload_bytes") >= least)
    first = ~shared | F.col("page_id").eqNullSafe(col(top))
    if tied > 1:
        # only rows that repeat a response's page_id and payload meet here
        at_top = shared & F.col("page_id").eqNullSafe(col(top)) & (col(same) > 1)
        place = F.row_number().over(Window.partitionBy("payload_digest").orderBy("url"))
        joined = joined.filter(~at_top).withColumn(rank, F.lit(1)).unionByName(joined.filter(at_top).withColumn(rank, place))
        first = first & (col(rank) == 1)
    return joined.withColumn("record_type", F.when(first, "response").otherwise("revisit")).withColumn("refers_to", F.when(~first, col(top))).select(*[col(c) for c in pages.columns], *added)


def _id(page: Column) -> Column:
    return F.concat(F.lit("<urn:newsgrid:page:"), F.coalesce(page.cast("string"), F.lit("none")), F.lit(">"))


def records(resolved: DataFrame, date: str = DATE) -> DataFrame:
    """One column `value`: the records with fresh headers, without the closing CR LF CR LF."""
    url = F.regexp_replace(F.coalesce(F.col("url"), F.lit("urn:newsgrid:none")), r"[\x00-\x20]", "%20")
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("payload_bytes").cast("string"), F.lit(CRLF + CRLF))
    revisit = F.col("record_type") == "revisit"
    block = F.when(revisit, http).otherwise(F.concat(http, text_or_empty("html")))
    extra = F.when(revisit, F.concat(F.lit(f"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest{CRLF}WARC-Refers-To: "), _id(F.col("refers_to")), F.lit(CRLF))).otherwise("")
    return resolved.select(F.concat(F.lit(f"WARC/1.1{CRLF}WARC-Type: "), F.col("record_type"), F.lit(f"{CRLF}WARC-Record-ID: "), _id(F.col("page_id")), F.lit(f"{CRLF}WARC-Date: {date}{CRLF}WARC-Target-URI: "), url, F.lit(f"{CRLF}WARC-Payload-Digest: sha1:"), F.col("payload_digest"), F.lit(CRLF), extra, F.lit(f"Content-Type: application/http;msgtype=response{CRLF}Content-Length: "), F.octet_length(block).cast("string"), F.lit(CRLF + CRLF), block).alias("value"))


def write_archives(resolved: DataFrame, path: str, date: str = DATE) -> None:
    """Write .gz archives into the folder `path`, one or more for each task."""
    records(resolved, date).write.option("lineSep", CRLF + CRLF).option("compression", "gzip").text(path)


def _page(value: str | None) -> int | None:
    number = re.fullmatch(r"<urn:newsgrid:page:(-?\d+)>", value or "")
    return int(number[1]) if number else None


def parse_lines(lines: Iterator[str]) -> Iterator[tuple]:
    """Records from the CR LF lines of archives; a record's block is read by its length."""
    for line in lines:
        if line != "WARC/1.1":
            raise ValueError("no record starts here")
        headers = {}
        while line := next(lines):
            name, _, value = line.partition(": ")
            headers[name] = value
        want = int(headers["Content-Length"])
        parts = [next(lines).encode()]
        have = len(parts[0])
        while have < want:
            parts.append(next(lines).encode())
            have += 2 + len(parts[-1])
        block = b"\r\n".join(parts)
        if have != want or next(lines, "") != "":
            raise ValueError("a record's length is wrong")
        payload, digest = None, headers["WARC-Payload-Digest"].removeprefix("sha1:")
        if headers["WARC-Type"] == "response":
            payload = block.partition(b"\r\n\r\n")[2]
            if hashlib.sha1(payload).hexdigest() != digest:
                raise ValueError("a payload's digest is wrong")
        yield _page(headers["WARC-Record-ID"]), headers["WARC-Type"], headers["WARC-Target-URI"], _page(headers.get("WARC-Refers-To")), None if payload is None else len(payload), digest, payload


def _parse(keep_payload: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        rows, held = [], 0
        for record in parse_lines(x for b in batches for x in b.column(0).to_pylist()):
            rows.append(record if keep_payload else (*record[:-1], None))
            held += len(rows[-1][-1] or b"")
            if len(rows) >= 2000 or held > 1 << 24:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)
                rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    return run


def read_archives(spark: SparkSession, path: str, keep_payload: bool = True) -> DataFrame:
    """The records of all archives in a folder: SCHEMA; a revisit's payload and its size are null."""
    return spark.read.option("lineSep", CRLF).text(path).mapInArrow(_parse(keep_payload), SCHEMA)


def restore(found: DataFrame) -> DataFrame:
    """Records with the payload of revisits taken from the responses that they refer to."""
    kept = found.filter("record_type = 'response'")
    # found has the columns of SCHEMA, so these names are free
    original = kept.select(F.col("page_id").alias("_to"), F.col("payload_digest").alias("_digest"), F.col("payload_bytes").alias("_size"), F.col("payload").alias("_body"))
    again = found.filter("record_type = 'revisit'").join(original, F.col("refers_to").eqNullSafe(F.col("_to")) & (F.col("payload_digest") == F.col("_digest")), "left")
    again = again.select("page_id", "record_type", "url", "refers_to", F.col("_size").alias("payload_bytes"), "payload_digest", F.col("_body").alias("payload"))
    return kept.unionByName(again)


def op10_warc(pages: DataFrame) -> DataFrame:
    """Archives of all pages written to the shared folder, read back and resolved; one row per page."""
    spark = pages.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/warc-{uuid.uuid4().hex}"
    write_archives(resolve(pages.select("page_id", "url", "html")), path)
    found = checkpointed(read_archives(spark, path, keep_payload=False))
    return restore(found).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
