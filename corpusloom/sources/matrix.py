"""A data source for matrices in numpy's file format: each task reads the bytes of its own rows.

    spark.dataSource.register(MatrixSource)
    spark.read.format("matrix").load(path)          (chunk_id, vector), one row a row of the matrix

path is a file, local or in any store whose address pyarrow knows (hdfs, s3, gs). The driver reads the header only.
"""

from __future__ import annotations

import ast
import struct
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Bytes that a task reads, about, and that it turns into rows at once.
PART_BYTES, BATCH_BYTES = 64 << 20, 4 << 20
# How such a file begins, and the width of the header's length by version.
MAGIC = b"\x93NUMPY"
LENGTH = {1: "<H", 2: "<I", 3: "<I"}


def opened(path: str):
    """A readable file."""
    system, inner = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    return system.open_input_file(inner)


@dataclass
class Header:
    """Where the numbers begin, their type, and the shape of the matrix."""

    begin: int
    kind: str
    rows: int
    columns: int

    @classmethod
    def read(cls, path: str) -> Header:
        with opened(path) as f:
            head = f.read(8)
            if head[:6] != MAGIC or head[6] not in LENGTH:
                raise ValueError(f"{path} is no numpy file")
            size = struct.calcsize(LENGTH[head[6]])
            (n,) = struct.unpack(LENGTH[head[6]], f.read(size))
            said = ast.literal_eval(f.read(n).decode("utf-8" if head[6] == 3 else "latin-1"))
            end = f.size()
        shape, kind = said["shape"], np.dtype(said["descr"])
        if said["fortran_order"] or len(shape) != 2 or kind.kind not in "fiu":
            raise ValueError(f"{path} holds {said}; a matrix of numbers, row by row, is needed")
        found = cls(8 + size + n, kind.str, *shape)
        if end < found.begin + shape[0] * found.row_bytes:
            raise ValueError(f"{path} ends before its last row")
        return found

    @property
    def row_bytes(self) -> int:
        return self.columns * np.dtype(self.kind).itemsize


@dataclass
class Part(InputPartition):
    first: int
    last: int


class MatrixReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.part_bytes = int(options.get("partbytes", PART_BYTES))
        self.header = Header.read(self.path)

    def partitions(self) -> list[Part]:
        step = max(1, self.part_bytes // max(1, self.header.row_bytes))
        return [Part(at, min(at + step, self.header.rows)) for at in range(0, self.header.rows, step)] or [Part(0, 0)]

    def read(self, part: Part):
        h = self.header
        step = max(1, BATCH_BYTES // max(1, h.row_bytes))
        with opened(self.path) as f:
            for at in range(part.first, part.last, step):
                n = min(step, part.last - at)
                f.seek(h.begin + at * h.row_bytes)
                flat = np.frombuffer(f.read(n * h.row_bytes), dtype=h.kind).astype(np.float64)
                offsets = pa.array(np.arange(n + 1, dtype=np.int32) * h.columns)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(at, at + n)), pa.ListArray.from_arrays(offsets, pa.array(flat))], names=["chunk_id", "vector"])


class MatrixSource(DataSource):
    """Options: partBytes, what a task reads, about."""

    @classmethod
    def name(cls) -> str:
        return "matrix"

    def schema(self) -> str:
        return "chunk_id bigint, vector array<double>"

    def reader(self, schema) -> MatrixReader:
        return MatrixReader(self.options)
