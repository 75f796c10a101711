"""Token ids in length-delimited binary records, with a separate offset index.

A file is a row of frames, one for each sequence:

    length of payload     8 bytes, little-endian
    masked checksum       4 bytes, of the length's 8 bytes
    payload               flags (1 byte), sequence id (8 bytes, signed), ids
    masked checksum       4 bytes, of the payload
    newline               1 byte, which the text writer of Spark puts after each row

Flags: 1 the id is null, 2 ids take four bytes (else two), 4 ids are packed by zstd. A checksum is a CRC-32
rotated right by 15 bits plus a constant, so that the checksum of data which holds checksums stays sound.

Files are written by Spark, which commits tasks whole, on any file system it knows; file ``part-k`` holds the
k-th range of ids, so that names and places in them follow the order of ids. The index (Parquet) gives for
each sequence its file, offset, bytes, ids before it and number of ids: a reader that wants a shuffled order
permutes index rows (``turns``) and never scans. ``fetched`` reads the records of such turns: places that lie side by side in a
file are cut into ranges of some megabytes, each range is read on its own, and a range of places is all that a task asks for.

Defined results: a null text counts as an empty one and yields only the end id; null sequence ids come first;
rows that repeat an id are all written, ordered by text; an empty table makes no records and an empty index; a text of any
length is one record; other columns of the documents are not written.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from eventlens.llm.bpe import codec
from eventlens.llm.common import partitions

#: Fixed values of the frame.
MASK_ROTATE, MASK_ADD = 15, 0xA282EAD8
HEAD, TAIL = struct.Struct("<QI"), struct.Struct("<I")
NULL_ID, WIDE, PACKED = 1, 2, 4
PAYLOAD_HEAD = struct.Struct("<Bq")


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> MASK_ROTATE) | (crc << (32 - MASK_ROTATE))) + MASK_ADD) & 0xFFFFFFFF


def frame(seq_id: int | None, ids: bytes, wide: bool, pack: Callable[[bytes], bytes] | None = None) -> bytes:
    """One record, without the newline."""
    flags = NULL_ID * (seq_id is None) | WIDE * wide
    if pack and len(short := pack(ids)) < len(ids):
        ids, flags = short, flags | PACKED
    payload = PAYLOAD_HEAD.pack(flags, seq_id or 0) + ids
    length = struct.pack("<Q", len(payload))
    return length + TAIL.pack(masked(length)) + payload + TAIL.pack(masked(payload))


def frames(content: bytes) -> Iterator[tuple[int, int, int | None, np.ndarray]]:
    """(offset, bytes with the newline, sequence id, ids) of each record; a damaged one raises."""
    import zstandard

    unpack = zstandard.ZstdDecompressor().decompress
    at, view = 0, memoryview(content)
    while at < len(content):
        size, check = HEAD.unpack_from(content, at)
        if masked(bytes(view[at : at + 8])) != check:
            raise ValueError(f"length of the record at byte {at} is damaged")
        start = at + HEAD.size
        payload = bytes(view[start : start + size])
        end = start + size + TAIL.size
        if len(payload) < size or masked(payload) != TAIL.unpack_from(content, end - TAIL.size)[0] or content[end : end + 1] != b"\n":
            raise ValueError(f"record at byte {at} is damaged")
        flags, seq_id = PAYLOAD_HEAD.unpack_from(payload)
        raw = payload[PAYLOAD_HEAD.size :]
        raw = unpack(raw) if flags & PACKED else raw
        yield at, end + 1 - at, None if flags & NULL_ID else seq_id, np.frombuffer(raw, "<u4" if flags & WIDE else "<u2")
        at = end + 1


def write(docs: DataFrame, path: str, vocabulary: str, end_id: int = 0, pattern: str | None = None, plain: bool = False) -> None:
    """Encode every whole ``text``, append ``end_id`` and write records in ascending ``doc_id`` below ``path``.

    One shuffle, of the texts, by ranges of id: encoding follows it, so files are as large as their texts make them.
    """
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        own = codec(vocabulary, pattern, plain)
        pack = zstandard.ZstdCompressor(level=1).compress
        end = np.array([end_id], own.dtype).tobytes()
        for batch in batches:
            # In portions: neither all frames of a batch nor all its ids are held.
            for first, texts, ids, bounds in own.portions(batch.column("text")):
                numbers = batch.column("doc_id").slice(first, len(texts)).to_pylist()
                rows = [frame(i, ids[a:b].tobytes() + end, own.dtype.itemsize == 4, pack) for i, a, b in zip(numbers, bounds[:-1], bounds[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary())], ["frame"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    # Bounds are drawn from ids and hashes: a sample of texts would go to the driver.
    order = ["doc_id", F.xxhash64("text")]
    rows = rows.repartitionByRange(partitions(docs), *order).sortWithinPartitions(*order, "text")
    rows.mapInArrow(work, "frame binary").select(F.col("frame").cast("string")).write.option("lineSep", "\n").text(f"{path}/data")


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, content in zip(batch.column("part").to_pylist(), batch.column("content"), strict=True):
            place, before = [], 0
            for offset, size, seq_id, ids in frames(content.as_py()):
                place.append((part, offset, size, seq_id, before, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                before += len(ids)
            columns = list(zip(*place, strict=True)) or [()] * 7
            kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], ["part", "offset", "bytes", "doc_id", "before", "n_tokens", "ids_crc32"])


def files(spark: SparkSession, path: str, content: bool = True) -> DataFrame:
    """(part, content) of the record files below ``path``, or (part, path)."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{path}/data")
    return found.select(F.regexp_extract("path", r"part-(\d+)", 1).cast("int").alias("part"), "content" if content else "path")


def index(spark: SparkSession, path: str) -> DataFrame:
    """Read all records, check them, write the index beside them and return it: part, offset, bytes, doc_id, start, n_tokens, ids_crc32.

    ``start`` counts the ids of all records before: a running sum in each file, and one over the files' totals,
    which are as many numbers as there are files.
    """
    parsed = files(spark, path).mapInArrow(_parsed, "part int, offset long, bytes long, doc_id long, before long, n_tokens long, ids_crc32 long")
    parsed.write.parquet(f"{path}/index")
    parsed = spark.read.schema(parsed.schema).parquet(f"{path}/index")
    totals = parsed.groupBy("part").agg(F.sum("n_tokens").alias("_n"))
    totals = totals.select("part", (F.sum("_n").over(Window.orderBy("part")) - F.col("_n")).alias("_base"))
    joined = parsed.join(totals, "part")
    return joined.select("part", "offset", "bytes", "doc_id", (F.col("_base") + F.col("before")).alias("start"), "n_tokens", "ids_crc32")


#: Bytes of a file that a reader asks for at once, unless a single record is longer.
RANGE = 8 << 20


def turns(spark: SparkSession, path: str, seed: int) -> DataFrame:
    """The index with ``turn``, the place of each record in an order drawn by ``seed``: only index rows are permuted."""
    return index_of(spark, path).withColumn("turn", F.xxhash64(F.lit(seed), "part", "offset"))


def _open(uri: str):
    """The file at a URI as Spark writes it (``file:/path``), or of any store that Arrow knows."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem().open_input_file("/" + unquote(uri[len("file:") :]).lstrip("/"))
    store, inner = fs.FileSystem.from_uri(uri)
    return store.open_input_file(inner)


def fetched(spark: SparkSession, path: str, asked: DataFrame, digest: bool = False) -> DataFrame:
    """(part, offset, doc_id, n_tokens, ids) of the records at (part, offset, bytes), read by ranges.

    With ``digest``, ``fetched_crc32`` stands for the ids: crc32 of them as little-endian unsigned 32-bit integers.

    A range of a file (its ``offset`` over RANGE) is a group; Spark deals the groups. Its reader opens the file through the
    file system that Spark knows, goes to the first place and reads no further than the last place's end.
    """
    name = files(spark, path, content=False)
    placed = asked.select("part", "offset", "bytes").join(name, "part")
    grouped = placed.withColumn("_range", F.floor(F.col("offset") / RANGE)).repartition("part", "_range").sortWithinPartitions("part", "offset")

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened: tuple[str, object] = ("", None)
        for batch in batches:
            rows: list[tuple] = []
            size = 0
            path_of, part, offset, length = (batch.column(c).to_pylist() for c in ("path", "part", "offset", "bytes"))
            k = 0
            while k < len(part):
                stop = k + 1
                while stop < len(part) and part[stop] == part[k] and offset[stop] + length[stop] - offset[k] <= RANGE:
                    stop += 1
                if opened[0] != path_of[k]:
                    opened = path_of[k], _open(path_of[k])
                opened[1].seek(offset[k])
                data = opened[1].read(offset[stop - 1] + length[stop - 1] - offset[k])
                for r in range(k, stop):
                    at = offset[r] - offset[k]
                    _, _, seq_id, ids = next(frames(data[at : at + length[r]]))
                    rows.append((part[r], offset[r], seq_id, len(ids), ids))
                    size += len(ids)
                    if size > RANGE // 4:
                        yield _sequences(rows, digest)
                        rows, size = [], 0
                k = stop
            if rows:
                yield _sequences(rows, digest)

    last = "fetched_crc32 long" if digest else "ids array<int>"
    return grouped.mapInArrow(fetch, f"part int, offset long, doc_id long, n_tokens long, {last}")


def _sequences(rows: list[tuple], digest: bool) -> pa.RecordBatch:
    part, offset, seq_id, n, ids = zip(*rows, strict=True)
    if digest:
        last = pa.array([zlib.crc32(i.astype("<u4").tobytes()) for i in ids], pa.int64())
    else:
        bounds = np.concatenate(([0], np.cumsum(n))).astype(np.int32)
        last = pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.concatenate(ids).astype(np.int32)))
    columns = [pa.array(part, pa.int32()), pa.array(offset, pa.int64()), pa.array(seq_id, pa.int64()), pa.array(n, pa.int64()), last]
    return pa.RecordBatch.from_arrays(columns, ["part", "offset", "doc_id", "n_tokens", "fetched_crc32" if digest else "ids"])


def shuffled(spark: SparkSession, path: str, seed: int) -> DataFrame:
    """(doc_id, ids) in an order drawn by ``seed``: turns are drawn on the index, records are fetched by range, then dealt by turn."""
    order = turns(spark, path, seed)
    got = fetched(spark, path, order)
    return got.withColumn("_turn", F.xxhash64(F.lit(seed), "part", "offset")).orderBy("_turn").select("doc_id", "ids")


def index_of(spark: SparkSession, path: str) -> DataFrame:
    """The index that ``index`` has written."""
    return spark.read.parquet(f"{path}/index")
