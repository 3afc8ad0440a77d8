"""Token-id output: length-delimited binary records with masked checksums and a separate offset index.

File format. A folder ``data`` holds one file for each partition, in ascending document order over the files' numbers. A
record is

    length of the payload, 8 bytes | masked crc32 of these 8 bytes, 4 | payload | masked crc32 of the payload, 4 | line feed

and the payload is a presence byte and the document's id (8 bytes, signed), the width of an id in bytes (1), the ids. All
numbers are little-endian. A mask rotates a crc32 by 15 bits and adds a constant, so that a checksum over bytes that hold
checksums stays sound. A folder ``index`` holds, as parquet, a row for each record (``places``: the same without ``start``): ``shard`` (the file's number),
``offset``, ``length`` (of the whole record), ``doc_id``, ``n_tokens`` and ``start`` (ids of all records before it), so that
shuffled reads fetch records without reading what lies between.

Files are written by Spark's own text writer, whose line is a whole record, so every store that Spark can write works, a
lost executor's tasks run again, and only committed files count. A file's size follows from ``bytes_of_text`` a partition.

Cases. Null and empty texts give the end id only. Null ids come first and are kept. Repeated rows give a record each.
Columns other than ``doc_id`` and ``text`` are ignored. An empty table gives empty tables.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from duewise.llm.common import new_path
from duewise.llm.tokens import default_tokenizer, encoder, ids_crc32

MASK = 0xA282EAD8
END_ID = 2
BYTES_OF_TEXT = 16 << 20
BYTES_AT_ONCE = 1 << 20
_HEAD = struct.Struct("<QI")
_DOC = struct.Struct("<?qB")
_CRC = struct.Struct("<I")
_FEED = b"\n"

INDEX = "shard long, offset long, length long, doc_id long, n_tokens long, start_in_shard long, ids_crc32 long"


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + MASK) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    head = struct.pack("<Q", len(payload))
    return head + _CRC.pack(masked(head)) + payload + _CRC.pack(masked(payload))


def payload(doc_id: int | None, ids: bytes, width: int) -> bytes:
    return _DOC.pack(doc_id is not None, doc_id or 0, width) + ids


def parse(data: bytes, at: int = 0) -> tuple[int | None, np.ndarray, int]:
    """The record at an offset: id, ids, where the next one begins. Raises ValueError on a damaged record."""
    if at + _HEAD.size > len(data):
        raise ValueError(f"record cut off at {at}")
    size, crc = _HEAD.unpack_from(data, at)
    if masked(data[at : at + 8]) != crc:
        raise ValueError(f"damaged length at {at}")
    body = data[at + 12 : at + 12 + size]
    if len(body) != size or at + 17 + size > len(data):
        raise ValueError(f"record cut off at {at}")
    if masked(body) != _CRC.unpack_from(data, at + 12 + size)[0]:
        raise ValueError(f"damaged payload at {at}")
    known, doc_id, width = _DOC.unpack_from(body)
    return doc_id if known else None, np.frombuffer(body, f"<u{width}", offset=_DOC.size), at + 17 + size


def write_records(docs: DataFrame, path: str, tokenizer: str | None = None, end_id: int | None = END_ID,
                  bytes_of_text: int = BYTES_OF_TEXT) -> str:
    """Write every document's ids, in ascending ``doc_id``, and the offset index; gives the path."""
    file, tail = tokenizer or default_tokenizer(), end_id

    def frames(batches):
        enc = encoder(file)
        end = b"" if tail is None else np.array([tail], enc.dtype).tobytes()
        width = enc.dtype.itemsize
        for batch in batches:
            made, held = [], 0
            for doc_id, ids in zip(batch.column(0).to_pylist(), enc.stream(batch.column(1)), strict=True):
                made.append(frame(payload(doc_id, ids + end, width)))
                held += len(made[-1])
                if held > BYTES_AT_ONCE:
                    yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary())], ["record"])
                    made, held = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary())], ["record"])
        enc.forget()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ordered = rows.repartitionByRange(max(1, -(-size // bytes_of_text)), "doc_id").sortWithinPartitions("doc_id", "text")
    lines = ordered.mapInArrow(frames, "record binary").select(F.col("record").cast("string").alias("value"))
    lines.write.option("lineSep", "\n").option("compression", "none").text(f"{path}/data")
    scan_records(docs.sparkSession, path).drop("ids_crc32").write.parquet(f"{path}/places")
    places = docs.sparkSession.read.parquet(f"{path}/places")
    with_starts(places, places).write.parquet(f"{path}/index")
    return path


def _files(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(f"{path}/data")
    return files.select(F.regexp_extract("path", r"part-(\d+)", 1).cast("long").alias("shard"), "content")


def scan_records(spark: SparkSession, path: str) -> DataFrame:
    """One row for each record, read and verified file by file."""

    def read(batches):
        for batch in batches:
            for shard, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows, at, start, data = [], 0, 0, data.as_py()
                while at < len(data):
                    doc_id, ids, after = parse(data, at)
                    rows.append((shard, at, after - at, doc_id, len(ids), start, ids_crc32(ids)))
                    at, start = after, start + len(ids)
                columns = list(zip(*rows, strict=True)) or [()] * 7
                names = [x.split()[0] for x in INDEX.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)

    return _files(spark, path).mapInArrow(read, INDEX)


def with_starts(scanned: DataFrame, places: DataFrame) -> DataFrame:
    """``start`` over all files: a running total over the files of ``places``, one row each, is added to the start in the file."""
    shards = places.groupBy("shard").agg(F.sum("n_tokens").alias("_n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = shards.select("shard", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return scanned.join(shards, "shard").withColumn("start", F.col("start_in_shard") + F.col("_before")).drop("start_in_shard", "_before")


def read_by_index(spark: SparkSession, path: str, wanted: DataFrame) -> DataFrame:
    """Records that ``wanted`` (rows of the index) names, cut out of their files: ``doc_id``, ``ids``.

    Wanted places are gathered by file, so they are bounded by what one file holds.
    """

    def read(batches):
        for batch in batches:
            for data, places in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                data = data.as_py()
                got = [parse(data, at)[:2] for at in places]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([d for d, _ in got], pa.int64()), pa.array([x.tolist() for _, x in got], pa.list_(pa.int64()))], ["doc_id", "ids"]
                )

    places = wanted.groupBy("shard").agg(F.collect_list("offset").alias("places"))
    return _files(spark, path).join(places, "shard").select("content", "places").mapInArrow(read, "doc_id long, ids array<long>")


def token_records(docs: DataFrame, path: str | None = None, **options) -> DataFrame:
    """Write all documents as records, read the files back: doc_id, start, n_tokens, ids_crc32."""
    spark = docs.sparkSession
    path = write_records(docs, path or new_path(spark, "records"), **options)
    return with_starts(scan_records(spark, path), spark.read.parquet(f"{path}/places")).select("doc_id", "start", "n_tokens", "ids_crc32")
