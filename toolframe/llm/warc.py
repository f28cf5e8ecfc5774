"""WARC archives with revisit records.

Headers (page, digest, size) are shuffled by payload digest to find the first
record of each payload; revisits join to it. Payloads move once, in the join
that tells each page its record type (not at all where the revisits are few
enough for a broadcast, which adaptive execution decides from their size), and
are written as gzipped WARC/1.1 files with fresh headers. Reading parses
records by Content-Length and takes every digest anew from what it reads.
"""

from __future__ import annotations

import datetime
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from toolframe.llm.common import ship

LEAST_BYTES = 100  # smaller payloads are always written out
FILE_RECORDS = 1000  # records of one archive file; a file is parsed in one piece
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def resolve(pages: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """Revisits only: page_id, digest, refers_to and the response's url.

    Of equal payloads of at least least_bytes, the smallest page_id is the
    response. Null payloads are empty. A null page_id is never a response that
    others refer to, and revisits one if there is one.
    """
    heads = _keyed(pages).where(F.col("size") >= least_bytes).select("page_id", "url", "digest")
    first = (heads.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.min(F.when(F.col("page_id").isNotNull(), F.struct("page_id", "url"))).alias("first"))
                  .where("n > 1 and first is not null").drop("n"))
    return (heads.join(first, "digest").where(~F.col("page_id").eqNullSafe(F.col("first.page_id")))
                 .select("page_id", "digest", F.col("first.page_id").alias("refers_to"), F.col("first.url").alias("target")).distinct())


def _keyed(pages: DataFrame) -> DataFrame:
    payload = F.coalesce("html", F.lit(""))
    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("html"),
                        F.sha2(payload, 256).alias("digest"), F.octet_length(payload).cast("long").alias("size"))


def _uri(url: Column) -> Column:
    """A header can't hold line ends or spaces; null gives the empty text."""
    return F.regexp_replace(F.coalesce(url, F.lit("")), r"[\s\x00-\x1f]", "%20")


def _record(date: str) -> Column:
    """One WARC record as text, up to the line end that the writer adds."""
    line = lambda name, *value: F.concat(F.lit(f"{name}: "), *value, F.lit("\r\n"))
    page = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("null")), F.lit(">"))
    again = F.col("refers_to").isNotNull()
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("size").cast("string"), F.lit("\r\n\r\n"))
    block = F.when(again, http).otherwise(F.concat(http, F.col("html")))
    revisit = F.when(again, F.concat(line("WARC-Profile", F.lit(_REVISIT)), line("WARC-Refers-To", page("refers_to")),
                                     line("WARC-Refers-To-Target-URI", _uri(F.col("target"))))).otherwise("")
    head = F.concat(F.lit("WARC/1.1\r\n"), line("WARC-Type", F.when(again, F.lit("revisit")).otherwise("response")), line("WARC-Record-ID", page("page_id")),
                    line("WARC-Date", F.lit(date)), line("WARC-Target-URI", _uri(F.col("url"))), line("WARC-Payload-Digest", F.lit("sha256:"), F.col("digest")),
                    revisit, F.lit("Content-Type: application/http; msgtype=response\r\n"), line("Content-Length", F.octet_length(block).cast("string")))
    return F.concat(head, F.lit("\r\n"), block, F.lit("\r\n"))


def write_archives(pages: DataFrame, path: str, least_bytes: int = LEAST_BYTES, date: datetime.datetime | None = None) -> None:
    """Write pages (page_id, url, html) as archives below path, each payload of at least least_bytes once.

    Null html is an empty payload, null url an empty URI. Rows that repeat a
    page_id and its payload are records of one kind; equal page_ids with
    different payloads are told apart by digest. Other columns are ignored; no
    rows write no records.
    """
    said = (date or datetime.datetime.now(datetime.UTC)).strftime("%Y-%m-%dT%H:%M:%SZ")
    revisits = resolve(pages, least_bytes).select(F.col("page_id").alias("p"), F.col("digest").alias("d"), "refers_to", "target")
    rows = _keyed(pages)
    rows = rows.join(revisits, rows.page_id.eqNullSafe(F.col("p")) & (rows.digest == F.col("d")), "left")
    rows.select(_record(said).alias("value")).write.option("lineSep", "\r\n").option("compression", "gzip").option("maxRecordsPerFile", FILE_RECORDS).text(path)


def inflated(data: bytes, size: int = 1 << 20) -> Iterator[bytes]:
    """The bytes of a file in runs of bounded size: all members of a gzip file one after another, or the file itself."""
    if not data.startswith(b"\x1f\x8b"):
        yield data
        return
    while data:
        member = zlib.decompressobj(31)
        while not member.eof:
            run = member.decompress(data, size)
            data = member.unconsumed_tail
            if run:
                yield run
            elif not data and not member.eof:
                raise ValueError("an archive ends within a gzip member")
        data = member.unused_data.lstrip(b"\0")


def records(chunks: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (lower-case names) and block of every record of an archive, given in runs of bytes; holds one record at a time."""
    chunks, held, at = iter(chunks), bytearray(), 0

    def more() -> bool:
        run = next(chunks, None)
        held.extend(run or b"")
        return run is not None

    def needed(what: str) -> None:
        if not more():
            raise ValueError(f"the record at byte {at} {what}")

    while True:
        while not held:
            if not more():
                return
        seen = 0
        while (end := held.find(b"\r\n\r\n", seen)) < 0:
            seen = max(0, len(held) - 3)
            needed("has no end of its headers")
        lines = held[:end].decode("utf-8").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        head = {k.lower(): v.strip() for k, v in (x.split(":", 1) for x in lines[1:])}
        stop = end + 4 + int(head["content-length"])
        while len(held) < stop + 4:
            needed("doesn't end where its length says")
        if held[stop: stop + 4] != b"\r\n\r\n":
            raise ValueError(f"the record at byte {at} doesn't end where its length says")
        yield head, bytes(held[end + 4: stop])
        del held[: stop + 4]
        at += stop + 4


READ = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def read_archives(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """One row per record: page_id, url, payload_bytes, payload_digest, record_type, refers_to, and payload if asked (null for revisits).

    A response's digest and size are taken from the payload read, and its
    header must agree; a revisit's come from its headers. Empty archives give
    no rows.
    """
    def number(uri: str | None) -> int | None:
        said = (uri or "").removeprefix("<urn:page:").removesuffix(">")
        return int(said) if said not in ("", "null") else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in READ.split(", ")] + ["payload"] * payloads
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()] + [pa.binary()] * payloads
        for b in batches:
            for i in range(b.num_rows):
                rows = []
                for head, block in records(inflated(b.column(0)[i].as_py())):
                    kind, said = head["warc-type"], head["warc-payload-digest"].removeprefix("sha256:")
                    http, _, payload = block.partition(b"\r\n\r\n")
                    if kind == "response":
                        size, digest = len(payload), hashlib.sha256(payload).hexdigest()
                        if digest != said:
                            raise ValueError(f"payload of {head['warc-record-id']} isn't what its header says")
                    else:
                        size, digest, payload = int(http.rsplit(b"Content-Length: ", 1)[1]), said, None
                    rows.append((number(head["warc-record-id"]), head["warc-target-uri"] or None, size, digest, kind, number(head.get("warc-refers-to")), payload))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=False)], names=names)

    ship(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInArrow(run, READ + ", payload binary" * payloads)
