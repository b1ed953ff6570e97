"""WARC archives: written with one gzip member per record, read back by a sequential, incremental reader.

Archives are written by executors to a folder they share, each under a name of its own attempt and then moved to its
final name, so a repeated task leaves whole archives only. The reader holds one block of compressed bytes and one
record at a time: it inflates a member step by step, frames the record by its Content-Length and verifies its digests.
"""

from __future__ import annotations

import base64
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, fresh_path, skew_join, table

BLOCK = 1 << 16
#: Payloads of fewer bytes are stored in full, however often they repeat.
MIN_REVISIT_BYTES = 0
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"


def digest32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _clean(value: str) -> str:
    """A header value on one line."""
    return "".join(x if x >= " " and x != "\x7f" else " " for x in value)


def record(payload: bytes, name: str, uri: str, refers_to: str | None) -> bytes:
    """One compressed record; a revisit holds the HTTP header, which tells the payload's size, but not the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{name}>",
        f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {_clean(uri)}",
        f"WARC-Payload-Digest: sha1:{digest32(payload)}",
        f"WARC-Block-Digest: sha1:{digest32(block)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        head[5:5] = [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
    return squeeze.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + squeeze.flush()


class WarcError(ValueError):
    pass


def read_records(stream: BinaryIO, block: int = BLOCK) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (lower-case names) and block of each record, in order; raises WarcError on anything malformed."""
    rest = b""
    while rest or (rest := stream.read(block)):
        inflate, text, head, need = zlib.decompressobj(31), bytearray(), None, None
        while not inflate.eof:
            rest = rest or stream.read(block)
            try:
                more = inflate.decompress(rest, 4 * block)
                if not (rest or more or inflate.eof):
                    raise WarcError("the archive ends inside a member")
                text += more
            except zlib.error as e:
                raise WarcError(f"damaged member: {e}") from e
            rest = inflate.unused_data if inflate.eof else inflate.unconsumed_tail
            if head is None and (end := text.find(b"\r\n\r\n")) >= 0:
                head, need = _fields(bytes(text[:end])), end + 4
            if head is not None and len(text) > need + int(head["content-length"]) + 4:
                raise WarcError("a record is longer than its Content-Length")
        if head is None:
            raise WarcError("a member without a record header")
        size = int(head["content-length"])
        if bytes(text[need + size :]) != b"\r\n\r\n":
            raise WarcError("a record's size differs from its Content-Length")
        yield head, bytes(text[need : need + size])


def _fields(head: bytes) -> dict[str, str]:
    first, *lines = head.decode("utf-8").split("\r\n")
    if not first.startswith("WARC/1."):
        raise WarcError(f"not a WARC record: {first[:20]!r}")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    if not fields.get("content-length", "").isdigit():
        raise WarcError("no Content-Length")
    return fields


def page_of(head: dict[str, str], block: bytes) -> tuple[str, int, str, str, str | None]:
    """Record name, payload size, payload digest, type, and what a revisit refers to, after both digests are verified."""
    if "sha1:" + digest32(block) != head.get("warc-block-digest"):
        raise WarcError("block digest differs")
    http, gap, payload = block.partition(b"\r\n\r\n")
    size = next((int(v) for k, _, v in (x.partition(b":") for x in http.split(b"\r\n")) if k.strip().lower() == b"content-length"), None)
    named = head["warc-payload-digest"].removeprefix("sha1:")
    kind = head["warc-type"]
    if not gap or size is None or (kind == "response" and (len(payload) != size or digest32(payload) != named)):
        raise WarcError("payload digest or size differs")
    bare = lambda x: x.removeprefix("<urn:page:").removesuffix(">")
    return bare(head["warc-record-id"]), size, named, kind, bare(head["warc-refers-to"]) if "warc-refers-to" in head else None


def _open(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def write_archives(pages: DataFrame, folder: str, per_archive: int = 20_000) -> DataFrame:
    """pages (page_id, url, payload, refers_to); writes an archive for each part of the pages and returns path and records."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out = own = store = None
        done, n = [], 0

        def close() -> None:
            nonlocal out
            if out is not None:
                out.close()
                store.move(own + ".open", own + ".warc.gz")
                done.append((f"{folder}/{own.rpartition('/')[2]}.warc.gz", n))
                out = None

        for part in batches:
            for page, url, payload, refers in zip(part["page_id"], part["url"], part["payload"], part["refers_to"], strict=True):
                if out is None or n >= per_archive:
                    close()
                    store, root = _open(folder)
                    store.create_dir(root, recursive=True)
                    own, n = f"{root}/{uuid.uuid4().hex}", 0
                    out = store.open_output_stream(own + ".open", compression=None)
                out.write(record(payload, page, url or "", None if refers is None or pd.isna(refers) else refers))
                n += 1
        close()
        yield pd.DataFrame(done, columns=["path", "records"])

    return pages.mapInPandas(run, "path string, records long")


def read_archives(archives: DataFrame) -> DataFrame:
    """A row per record of the archives named in the column path."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            for path in part["path"]:
                store, name = _open(path)
                rows = []
                with store.open_input_stream(name, compression=None) as raw:
                    for head, block in read_records(raw):
                        rows.append(page_of(head, block))
                        if len(rows) == 1000:
                            yield pd.DataFrame(rows, columns=COLUMNS)
                            rows = []
                yield pd.DataFrame(rows, columns=COLUMNS)

    return archives.select("path").mapInPandas(run, "page string, payload_bytes long, payload_digest string, record_type string, refers string")


COLUMNS = ["page", "payload_bytes", "payload_digest", "record_type", "refers"]


def with_revisits(pages: DataFrame, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """pages (page_id, url, html) as page_id, url, payload and refers_to: of equal payloads the largest page_id is stored.

    Digests alone are shuffled to find equal payloads, those of very many pages met apart by a broadcast, and pages meet
    what they repeat by their own id, so a payload that a third of all pages repeat loads no task.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    keyed = pages.select("page_id", "url", payload.alias("payload"))
    digests = cut(keyed.select("page_id", F.sha1("payload").alias("digest"), F.length("payload").alias("size")), "digests")
    best = digests.filter(F.col("size") >= min_bytes).groupBy("digest").agg(F.max("page_id").alias("best"), F.count(F.lit(1)).alias("rows")).filter("rows > 1 and best is not null")
    again = skew_join(digests, cut(best, "repeated"), ["digest"]).filter(F.col("page_id").isNull() | (F.col("page_id") != F.col("best"))).select(F.col("page_id").alias("id"), "digest", "best").distinct()
    mine = keyed.withColumn("digest", F.sha1("payload"))
    met = mine.join(again, mine["page_id"].eqNullSafe(again["id"]) & (mine["digest"] == again["digest"]), "left")
    return met.select("page_id", "url", "payload", F.col("best").alias("refers_to"))


def round_trip(pages: DataFrame, min_bytes: int = MIN_REVISIT_BYTES) -> DataFrame:
    """Writes pages to archives in the shared folder and reads them back, one row per page.

    A null html is an empty payload. Rows that repeat page_id and payload are all response if that page_id is the
    group's largest, else all revisits of it. A page without an id never is what others refer to, and its page_id
    is null again. Very long payloads are written and read in blocks. An empty table gives no rows and no archive. Other
    columns are not read, so clashing names do no harm.
    """
    spark = pages.sparkSession
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("none"))
    ready = with_revisits(pages, min_bytes).select(text("page_id").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), "payload", F.col("refers_to").cast("string").alias("refers_to"))
    archives = cut(write_archives(ready, fresh_path(spark, "archives")), "manifest")
    read = read_archives(archives.repartition(max(1, min(4096, archives.count()))))
    number = lambda c: F.expr(f"try_cast({c} AS bigint)")
    return read.select(number("page").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers").alias("refers_to"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "pages"))


def records_of(data: bytes) -> list[tuple[dict[str, str], bytes]]:
    """All records of an archive held in memory, for tests."""
    return list(read_records(io.BytesIO(data)))
