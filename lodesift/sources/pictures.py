"""What the files of pictures say of themselves, read from their structure; no picture is decoded."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FACTS = "format string, width int, height int, whole boolean"


def png_facts(data: bytes) -> tuple[int, int, bool]:
    at, width, height, ended = 8, None, None, False
    while at + 12 <= len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        body, check = data[at + 8 : at + 8 + size], data[at + 8 + size : at + 12 + size]
        if len(check) < 4 or zlib.crc32(kind + body) != struct.unpack(">I", check)[0]:
            return width, height, False
        if kind == b"IHDR":
            width, height = struct.unpack(">II", body[:8])
        if kind == b"IEND":
            ended = True
            break
        at += 12 + size
    return width, height, ended and width is not None


def jpeg_facts(data: bytes) -> tuple[int | None, int | None, bool]:
    at, width, height = 2, None, None
    while at + 4 <= len(data) and data[at] == 0xFF:
        mark = data[at + 1]
        if mark == 0xDA:
            break
        size = struct.unpack(">H", data[at + 2 : at + 4])[0]
        if 0xC0 <= mark <= 0xCF and mark not in (0xC4, 0xC8, 0xCC) and at + 9 <= len(data):
            height, width = struct.unpack(">HH", data[at + 5 : at + 9])
        at += 2 + size
    return width, height, width is not None and data.rstrip(b"\0").endswith(b"\xff\xd9")


def picture_facts(data: bytes | None) -> tuple[str | None, int | None, int | None, bool]:
    """(format, width, height, whole): whole says that the file has all its parts; a format that is none gives nothing."""
    data = data or b""
    if data.startswith(b"\x89PNG\r\n\x1a\n"):
        return ("png", *png_facts(data))
    if data.startswith(b"\xff\xd8"):
        return ("jpeg", *jpeg_facts(data))
    if data.startswith(b"BM") and len(data) >= 26:
        size = struct.unpack("<I", data[2:6])[0]
        width, height = struct.unpack("<ii", data[18:26])
        return "bmp", width, abs(height), len(data) >= size
    if data[:4] == b"RIFF" and data[8:12] == b"WEBP" and len(data) >= 30:
        whole = len(data) >= struct.unpack("<I", data[4:8])[0] + 8
        if data[12:16] == b"VP8X":
            return "webp", int.from_bytes(data[24:27], "little") + 1, int.from_bytes(data[27:30], "little") + 1, whole
        if data[12:16] == b"VP8 ":
            return "webp", struct.unpack("<H", data[26:28])[0] & 0x3FFF, struct.unpack("<H", data[28:30])[0] & 0x3FFF, whole
        if data[12:16] == b"VP8L":
            bits = int.from_bytes(data[21:25], "little")
            return "webp", (bits & 0x3FFF) + 1, (bits >> 14 & 0x3FFF) + 1, whole
    return None, None, None, False


def facts_of(rows: DataFrame, key: str, content: str = "content") -> DataFrame:
    """(key, format, width, height, whole) of every row's picture, in Arrow batches where it is read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [picture_facts(x) for x in batch.column(1).to_pylist()]
            columns = [pa.array([f[k] for f in found], t) for k, t in enumerate((pa.string(), pa.int32(), pa.int32(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], [key, "format", "width", "height", "whole"])

    return rows.select(key, content).mapInArrow(run, f"{key} {rows.schema[key].dataType.simpleString()}, {FACTS}")


def read_facts(spark: SparkSession, path: str) -> DataFrame:
    """(path, format, width, height, whole) of every file under a folder, each once."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return facts_of(files, "path")


def picture_faults(named: DataFrame, facts: DataFrame, key: str, path: str, known: DataFrame | None = None) -> DataFrame:
    """(key, path, fault): pictures that are missing, broken or of another size than known; key tells a row that names each.

    named: (key, path); facts: one row a path; known: (path, width, height).
    """
    each = named.where(F.col(path).isNotNull()).groupBy(path).agg(F.min(key).alias(key)).join(facts, path, "left")
    size = F.lit(False)
    if known is not None:
        each = each.join(known.select(path, F.col("width").alias("_w"), F.col("height").alias("_h")), path, "left")
        size = (F.col("_w") != F.col("width")) | (F.col("_h") != F.col("height"))
    fault = F.when(F.col("whole").isNull(), F.lit("missing")).when(~F.col("whole"), F.lit("broken")).when(F.coalesce(size, F.lit(False)), F.lit("size"))
    return each.select(key, path, fault.alias("fault")).where("fault is not null")
