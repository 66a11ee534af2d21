"""CSV tables inside zip archives, inflated piece by piece: a member to a task, whatever its size."""

from __future__ import annotations

import codecs
import csv
import glob
import io
import os
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from typing import BinaryIO

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

#: Compressed bytes inflated, and records handed on, at a time.
PIECE, ROWS = 1 << 16, 5000
STORED, DEFLATED = 0, 8


def inflated(file: BinaryIO, size: int | None = None, crc: int | None = None) -> Iterator[bytes]:
    """The bytes of the member whose header ``file`` stands at. The header's sizes are not looked at: archives
    written as a stream, and those over 4 GB, do not say them there; ``size`` and ``crc`` are those of the
    archive's directory, if it was read. Other formats and methods, an early end, and other bytes than
    the directory promises are errors."""
    head = file.read(30)
    if len(head) < 30 or head[:4] != b"PK\x03\x04":
        raise ValueError("not a zip archive")
    flags, method = struct.unpack("<HH", head[6:10])
    if flags & 1:
        raise ValueError("the member is encrypted")
    if method not in (DEFLATED, STORED) or method == STORED and size is None:
        raise ValueError(f"compression method {method} is not deflate")
    file.seek(sum(struct.unpack("<HH", head[26:30])), io.SEEK_CUR)
    engine, left, seen = zlib.decompressobj(-15), size, 0
    while not engine.eof and left != 0:
        data = file.read(PIECE if left is None else min(PIECE, left))
        if not data:
            break
        left = None if left is None else left - len(data)
        piece = data if method == STORED else engine.decompress(data)
        seen = zlib.crc32(piece, seen)
        if piece:
            yield piece
    if left if method == STORED else not engine.eof:
        raise ValueError("the archive ends early")
    if crc is not None and seen != crc:
        raise ValueError("the member's bytes are not those that were stored")


def lines(pieces: Iterator[bytes]) -> Iterator[str]:
    """Lines with their ends; bytes that are not UTF-8 become U+FFFD."""
    decode, rest = codecs.getincrementaldecoder("utf-8")("replace"), ""
    for piece in pieces:
        *whole, rest = (rest + decode.decode(piece)).split("\n")
        yield from (w + "\n" for w in whole)
    rest += decode.decode(b"", True)
    if rest:
        yield rest


def records(pieces: Iterator[bytes], columns: list[str], rejected: bool = False, field: int = 10_000_000) -> Iterator[list]:
    """The records of a quoted CSV with as many values as ``columns``; with ``rejected`` the others, each as its
    number (the first after the header is 1) and its values. A header of another length is an error."""
    csv.field_size_limit(field)
    found = csv.reader(lines(pieces))
    header = next(found, [])
    if len(header) != len(columns):
        raise ValueError(f"{len(header)} columns where {len(columns)} are expected")
    for number, r in enumerate(found, 1):
        if (len(r) == len(columns)) != rejected:
            yield [number, r] if rejected else r


@dataclass
class Member(InputPartition):
    path: str
    name: str
    offset: int
    size: int
    crc: int


class ZippedCsvReader(DataSourceReader):
    def __init__(self, path: str, columns: list[str], rejected: bool):
        self.path, self.columns, self.rejected = path.removeprefix("file:"), columns, rejected

    def partitions(self) -> list[Member]:
        inside = os.path.join(self.path, "*.zip") if os.path.isdir(self.path) else self.path
        paths = sorted(glob.glob(inside))
        if not paths:
            raise ValueError(f"no archive under {self.path}")
        found = []
        for path in paths:
            if not zipfile.is_zipfile(path):
                raise ValueError(f"not a zip archive: {path}")
            with zipfile.ZipFile(path) as z:
                found += [Member(path, m.filename, m.header_offset, m.compress_size, m.CRC) for m in z.infolist() if not m.is_dir()]
        return found

    def read(self, member: Member) -> Iterator[pa.RecordBatch]:
        with open(member.path, "rb") as file:
            file.seek(member.offset)
            held: list[list] = []
            for r in records(inflated(file, member.size, member.crc), self.columns, self.rejected):
                held.append(r)
                if len(held) == ROWS:
                    yield self.batch(member, held)
                    held = []
            if held:
                yield self.batch(member, held)

    def batch(self, member: Member, rows: list[list]) -> pa.RecordBatch:
        values = [pa.array(c, pa.string()) for c in zip(*rows)] if not self.rejected else [
            pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.list_(pa.string()))]
        names = ["number", "fields"] if self.rejected else self.columns
        where = [pa.repeat(os.path.basename(member.path), len(rows)), pa.repeat(member.name, len(rows))]
        return pa.RecordBatch.from_arrays([*where, *values], ["_archive", "_member", *names])


class ZippedCsv(DataSource):
    """``spark.read.format("zipped_csv").option("columns", "a,b").load(path)``: the members of the archives of a folder or a glob.

    A member is a partition, read from the open archive in Arrow batches, so that neither its size nor the
    archive's matters. Rows have the archive's and the member's name in ``_archive`` and ``_member``. With
    the option ``rejected`` the records of another length come instead (number, fields). Paths are those
    of a file system that the driver and the executors mount.
    """

    @classmethod
    def name(cls) -> str:
        return "zipped_csv"

    def asked(self) -> tuple[list[str], bool]:
        return self.options["columns"].split(","), self.options.get("rejected", "false").lower() == "true"

    def schema(self) -> str:
        columns, rejected = self.asked()
        own = "number long, fields array<string>" if rejected else ", ".join(f"`{c}` string" for c in columns)
        return f"_archive string, _member string, {own}"

    def reader(self, schema: StructType) -> DataSourceReader:
        return ZippedCsvReader(self.options["path"], *self.asked())


def read_zipped_csv(spark: SparkSession, path: str, columns: list[str], rejected: bool = False) -> DataFrame:
    spark.dataSource.register(ZippedCsv)
    return spark.read.format("zipped_csv").option("columns", ",".join(columns)).option("rejected", str(rejected).lower()).load(path)


def write_zipped_csv(df: DataFrame, path: str, rows: int = 100_000) -> None:
    """An archive for each partition of ``df`` in the folder ``path``, with members of up to ``rows`` records
    under a header; null values are empty. A task run again writes its archive again, under its own name."""
    os.makedirs(path, exist_ok=True)
    columns = df.columns

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        name = os.path.join(path, f"part-{TaskContext.get().partitionId():05d}.zip")
        held, written, n = f"{name}.{uuid.uuid4().hex}", 0, 0
        with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as z:
            out = None
            for batch in batches:
                for r in zip(*(batch.column(c).to_pylist() for c in columns), strict=True):
                    if out is None or written == rows:
                        if out is not None:
                            out.close()
                        out = io.TextIOWrapper(z.open(f"{n:05d}.csv", "w", force_zip64=True), "utf-8", newline="")
                        sheet = csv.writer(out)
                        sheet.writerow(columns)
                        written, n = 0, n + 1
                    sheet.writerow(r)
                    written += 1
            if out is not None:
                out.close()
        if n:
            os.replace(held, name)
        else:
            os.remove(held)
        yield pa.record_batch({"n": pa.array([n], pa.int64())})

    df.mapInArrow(of, "n long").agg({"n": "sum"}).collect()


def zipped_csv(spark: SparkSession, path: str, columns: list[str], field: int = 10_000_000) -> DataFrame:
    """Columns of strings of the quoted CSV in each archive's first member, for paths that Spark alone reads.

    A header of another length is an error; rows of another length are left out. An archive is held by
    one task, and Spark's binary files end at 2 GB; ``read_zipped_csv`` has neither bound.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for data in pdf["content"]:
                rows = []
                for r in records(inflated(io.BytesIO(data)), columns, field=field):
                    rows.append(r)
                    if len(rows) == ROWS:
                        yield pd.DataFrame(rows, columns=columns)
                        rows = []
                if rows:
                    yield pd.DataFrame(rows, columns=columns)

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(read, ", ".join(f"`{c}` string" for c in columns))
