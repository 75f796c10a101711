"""WARC archives in which repeated payloads are revisit records.

Headers (page, payload length, digest) are shuffled by digest to find the smallest page id of each payload that occurs more
than once; counts and minima combine before the shuffle. The headers of such payloads then meet that id: those of hot digests, of
which there are at most 65,536, by a broadcast of these, all others by a join on the digest. Payloads stay where they are:

* **revisits** have no payload and are written from their headers;
* **responses** are written by a map over the pages. Which pages revisit is told to the tasks as two bitmaps over hashes of
  (digest, page id), of a bounded size: a page with an unset bit in one of them is a response;
* **the rest** are responses whose two bits are set by revisits. Headers tell which they are; only such pages go through a join,
  thinned out by a bitmap of themselves. They are a share of responses that is nothing for up to some million revisits.

Files are written by Spark's text writer, whose separator (CR LF CR LF) is what ends a WARC record, as gzip; Spark commits
tasks whole, on any file system it knows. A file holds about ``file_bytes`` of payload, by the mean size of a page.

Defined results: a null html is an empty payload, a null url an empty target; payloads under ``min_bytes`` are all
responses; rows that repeat page id and payload are responses alike if that id is the payload's smallest; a null page id comes
after all others, as an original too; a payload may hold anything, separators included, and is one record at any length; further
columns are not written; an empty table makes no records.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventlens.llm.common import fields, written

#: Digests of more pages than this, and than one in so many of all pages, are hot.
HOT = 1 << 16
#: Bits of a bitmap for each revisit, and at most (16 MB).
BITS_EACH, MOST_BITS = 32, 1 << 27
END = b"\r\n\r\n"
#: Fixed values of the format.
VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_HEAD = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {}\r\n\r\n"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'null' if page_id is None else page_id}>"


def page_of(uri: str | None) -> int | None:
    number = (uri or "")[len("<urn:page:") : -1]
    return None if number in ("", "null") else int(number)


def record(page_id: int | None, url: str | None, sha1: str, size: int, payload: bytes | None, refers_to: int | None, date: str) -> bytes:
    """Header and block; without a payload, a revisit. Control characters of a url are percent-encoded: a header stays on its line."""
    revisit = payload is None
    target = "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url or "")
    block = HTTP_HEAD.format(size).encode() + (payload or b"")
    lines = [VERSION, f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {date}", f"WARC-Target-URI: {target}"]
    if revisit:
        lines += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}"]
    lines += [f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(sha1)).decode()}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + END + block


KEY = ["_digest", "_bytes"]


def with_headers(pages: DataFrame) -> DataFrame:
    """(page_id, url, _payload, _digest, _bytes) of every page."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("_payload"))
    return base.withColumns({"_digest": F.sha1("_payload"), "_bytes": F.octet_length("_payload").cast("long")})


def revisits(headers: DataFrame, hot: int = HOT) -> DataFrame:
    """(page_id, url, _digest, _bytes, refers_to) of the pages that revisit, from ``headers`` alone."""
    # Null page ids order last: a null original is possible only if the payload has no other page.
    by = headers.groupBy(*KEY).agg(F.min("page_id").alias("refers_to"), F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    by = written(by.filter("refers_to IS NOT NULL"), "warc-repeated")
    limit = max(hot, headers.count() // HOT)
    often = by.filter(F.col("_n") > limit).drop("_n")
    # At most HOT rows: each stands for more than one in HOT of all pages.
    cold = headers.join(F.broadcast(often.select(*KEY)), KEY, "left_anti").join(by.filter(F.col("_n") <= limit).drop("_n"), KEY)
    both = headers.join(F.broadcast(often), KEY).select(cold.columns).unionByName(cold)
    return both.filter(~F.col("page_id").eqNullSafe(F.col("refers_to"))).select("page_id", "url", *KEY, "refers_to")


def _bit(seed: int, bits: int) -> Column:
    """A number below ``bits`` for each (digest, page id)."""
    return F.pmod(F.xxhash64(F.lit(seed), *KEY, "page_id"), F.lit(bits))


def bitmap(rows: DataFrame, seed: int, bits: int) -> np.ndarray:
    """The bits of ``rows``. At most ``bits / 64`` words come to the driver, however many rows there are."""
    words = rows.select(_bit(seed, bits).alias("_b")).groupBy(F.expr("_b div 64").alias("w")).agg(F.expr("bit_or(shiftleft(1L, int(_b % 64)))").alias("v"))
    found = words.toArrow()
    out = np.zeros(bits // 64, np.int64)
    out[found.column("w").to_numpy()] = found.column("v").to_numpy()
    return out


def marked(rows: DataFrame, bitmaps: Broadcast, seeds: tuple[int, ...], wanted: bool) -> DataFrame:
    """``rows`` (with KEY and page_id) whose bits are all set, or those of which one is not. A map."""
    names = [f"_bit{s}" for s in seeds]
    bits = 64 * len(bitmaps.value[0])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every = np.ones(batch.num_rows, bool)
            for words, name in zip(bitmaps.value, names, strict=True):
                bit = batch.column(name).to_numpy()
                every &= (words[bit >> 6] >> (bit & 63)) & 1 == 1
            yield batch.drop_columns(names).filter(pa.array(every == wanted))

    return rows.withColumns({n: _bit(s, bits) for n, s in zip(names, seeds, strict=True)}).mapInArrow(work, fields(rows))


def _records(rows: DataFrame, revisit: bool, date: str) -> DataFrame:
    """WARC records of pages (with payload) or of revisits (without)."""
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["page_id", "url", *KEY, "refers_to" if revisit else "_payload"]
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                made = [
                    record(i, url, hex_digest, size, None if revisit else last, last if revisit else None, date)
                    for i, url, hex_digest, size, last in zip(*(part.column(n).to_pylist() for n in names), strict=True)
                ]
                yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary())], ["record"])

    return rows.mapInArrow(work, "record binary").select(F.col("record").cast("string"))


def write(pages: DataFrame, path: str, min_bytes: int = 0, date: str = "2000-01-01T00:00:00Z", file_bytes: int = 256 << 20, hot: int = HOT, most_bits: int = MOST_BITS) -> None:
    """One record per page below ``path``, in folders ``responses``, ``revisits`` and, if there are any, ``rest``."""
    whole = with_headers(pages)
    headers = written(whole.drop("_payload"), "warc-headers")
    size = headers.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("_bytes"), F.lit(0)).alias("bytes")).first()
    per_file = max(1, min(1_000_000, file_bytes * max(1, size["n"]) // (size["bytes"] + 512 * max(1, size["n"]))))

    def put(rows: DataFrame, revisit: bool, folder: str) -> None:
        out = _records(rows, revisit, date).write.option("lineSep", END.decode()).option("compression", "gzip")
        out.option("maxRecordsPerFile", per_file).text(f"{path}/{folder}")

    again = written(revisits(headers.filter(F.col("_bytes") >= min_bytes), hot), "warc-revisits")
    n = again.count()
    put(again, True, "revisits")
    if not n:
        put(whole, False, "responses")
        return
    share, seeds = pages.sparkSession.sparkContext.broadcast, (1, 2)
    bits = min(most_bits, 1 << max(10, (n * BITS_EACH).bit_length()))
    told = share([bitmap(again, s, bits) for s in seeds])
    put(marked(whole, told, seeds, False), False, "responses")
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in ("page_id", *KEY)]
    doubtful = marked(headers.select("page_id", *KEY), told, seeds, True)
    rest = written(doubtful.alias("a").join(again.alias("b"), same, "left_anti").distinct(), "warc-rest")
    k = rest.count()
    if k:
        own = share([bitmap(rest, 3, min(most_bits, 1 << max(10, (k * BITS_EACH).bit_length())))])
        near = marked(marked(whole, told, seeds, True), own, (3,), True)
        put(near.alias("a").join(rest.alias("b"), same, "left_semi"), False, "rest")


def records(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields, block) of each record of an archive; anything else than records raises."""
    at = 0
    while at < len(content):
        end = content.index(END, at)
        first, *lines = content[at:end].decode().split("\r\n")
        if first != VERSION:
            raise ValueError(f"no record at byte {at}")
        fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines)
        start = end + len(END)
        at = start + int(fields["Content-Length"])
        if content[at : at + len(END)] != END:
            raise ValueError(f"record at byte {start} is cut short")
        yield fields, content[start:at]
        at += len(END)


def read(spark: SparkSession, path: str, payload: bool = True) -> DataFrame:
    """Pages of the archives: page_id, url, payload_bytes, payload_digest, record_type, refers_to (and payload, null for revisits).

    A response's length and digest are taken from its payload and its digest must be the header's; those of
    a revisit, which has no payload, are the header's.
    """
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                rows: list[tuple] = []
                for fields, block in records(zlib.decompress(content.as_py(), wbits=31) if len(content.as_py()) else b""):
                    head, _, body = block.partition(END)
                    named = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                    revisit = fields["WARC-Type"] == "revisit"
                    size = int(head.rpartition(b"Content-Length: ")[2]) if revisit else len(body)
                    if not revisit and digest(body) != named:
                        raise ValueError(f"payload of {fields['WARC-Record-ID']} does not match its digest")
                    rows.append((page_of(fields["WARC-Record-ID"]), fields["WARC-Target-URI"], size, named, fields["WARC-Type"], page_of(fields.get("WARC-Refers-To")), None if revisit or not payload else body))
                    if len(rows) == 512:
                        yield _batch(rows)
                        rows = []
                yield _batch(rows)

    found = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").option("recursiveFileLookup", "true").load(path).select("content")
    out = found.mapInArrow(work, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")
    return out if payload else out.drop("payload")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"page_id": pa.int64(), "url": pa.string(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64(), "payload": pa.binary()}
    columns = list(zip(*rows, strict=True)) or [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds.values(), strict=True)], list(kinds))
