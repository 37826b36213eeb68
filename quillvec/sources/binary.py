"""Binary formats as Python data sources: ``npy`` matrices of half floats and ``vecbin`` vector stores.

Both have records of one length, so a partition seeks to its own rows. Paths are those of files that every worker can open.
"""

from __future__ import annotations

import ast
import os
import struct
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

PATH_BYTES = 256


def local(path: str) -> str:
    return path.removeprefix("file://")


@dataclass
class Rows(InputPartition):
    start: int
    end: int


def npy_header(path: str) -> tuple[int, int, int, str]:
    """Offset of the data, rows, columns and dtype of a two-dimensional little-endian float matrix; ValueError for anything else."""
    with open(path, "rb") as f:
        magic = f.read(8)
        if len(magic) < 8 or magic[:6] != b"\x93NUMPY":
            raise ValueError("not an npy file")
        wide = magic[6] > 1
        size = f.read(4 if wide else 2)
        if len(size) < (4 if wide else 2):
            raise ValueError("the header is cut off")
        length = int.from_bytes(size, "little")
        head = ast.literal_eval(f.read(length).decode("latin-1").strip())
        at = f.tell()
    kind = head["descr"].replace("|", "<")
    if kind not in ("<f2", "<f4", "<f8"):
        raise ValueError(f"dtype {head['descr']} is not a little-endian float")
    if head["fortran_order"]:
        raise ValueError("column-major matrices are not supported")
    if len(head["shape"]) != 2:
        raise ValueError("a matrix has two dimensions")
    rows, columns = head["shape"]
    if os.path.getsize(path) < at + rows * columns * int(kind[2]):
        raise ValueError("the file is shorter than its header says")
    return at, rows, columns, kind


def _arrow(ids: np.ndarray, vectors: np.ndarray, name: str) -> pa.RecordBatch:
    n, d = vectors.shape
    flat = pa.array(np.ascontiguousarray(vectors, np.float32).ravel())
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * d, pa.int32()), flat)], names=[name, "vector"])


class NpySource(DataSource):
    """Read with ``spark.read.format("npy").load(path)``: (token_id int, vector array<float>); option rowsPerPartition. Write with mode append or overwrite
    from one partition in row order: a matrix of half floats, or of the option dtype (<f2, <f4, <f8)."""

    @classmethod
    def name(cls) -> str:
        return "npy"

    def schema(self) -> str:
        return "token_id int, vector array<float>"

    def reader(self, schema):
        return NpyReader(self.options)

    def writer(self, schema, overwrite):
        return NpyWriter(self.options)


class NpyReader(DataSourceReader):
    def __init__(self, options):
        self.path = local(options["path"])
        self.step = int(options.get("rowsPerPartition", 1 << 16))
        self.at, self.rows, self.columns, self.kind = npy_header(self.path)

    def partitions(self):
        return [Rows(i, min(i + self.step, self.rows)) for i in range(0, self.rows, self.step)] or [Rows(0, 0)]

    def read(self, partition):
        size = self.columns * int(self.kind[2])
        with open(self.path, "rb") as f:
            f.seek(self.at + partition.start * size)
            for i in range(partition.start, partition.end, 4096):
                n = min(4096, partition.end - i)
                yield _arrow(np.arange(i, i + n), np.frombuffer(f.read(n * size), self.kind).reshape(n, self.columns).astype(np.float32), "token_id")


@dataclass
class Part(WriterCommitMessage):
    path: str
    rows: int
    columns: int
    first: int


class _PartWriter(DataSourceWriter):
    """Tasks write their rows beside the target; the driver joins the parts in order of their first ids."""

    def __init__(self, options):
        self.options = dict(options)
        self.path = local(options["path"])

    def write(self, iterator):
        import uuid

        path = f"{self.path}.{uuid.uuid4().hex}.part"
        rows = columns = 0
        first = 1 << 62
        with open(path, "wb") as f:
            for r in iterator:
                vector = [float(x) for x in r["vector"]]
                if rows and len(vector) != columns:
                    raise ValueError("vectors differ in length")
                columns, first = len(vector), min(first, self.id_of(r))
                f.write(self.record(r, vector))
                rows += 1
        return Part(path, rows, columns, first)

    def commit(self, messages):
        parts = sorted((m for m in messages if m and m.rows), key=lambda m: m.first)
        widths = {m.columns for m in parts}
        if len(widths) > 1:
            raise ValueError("vectors differ in length")
        with open(self.path, "wb") as f:
            f.write(self.header(sum(m.rows for m in parts), widths.pop() if widths else int(self.options.get("dim", 0))))
            for m in parts:
                with open(m.path, "rb") as part:
                    while data := part.read(1 << 20):
                        f.write(data)
        self.abort(messages)

    def abort(self, messages):
        for m in messages:
            if m and os.path.exists(m.path):
                os.remove(m.path)


class NpyWriter(_PartWriter):
    def __init__(self, options):
        super().__init__(options)
        self.kind = self.options.get("dtype", "<f2")
        if self.kind not in ("<f2", "<f4", "<f8"):
            raise ValueError(f"dtype {self.kind} is not a little-endian float")

    def id_of(self, r):
        return r["token_id"]

    def record(self, r, vector):
        return np.array(vector, self.kind).tobytes()

    def header(self, rows, columns):
        head = repr({"descr": self.kind, "fortran_order": False, "shape": (rows, columns)})
        head += " " * (-(len(head) + 11) % 64) + "\n"
        return b"\x93NUMPY\x01\x00" + struct.pack("<H", len(head)) + head.encode("latin-1")


class VecBinSource(DataSource):
    """Vector stores: int32 dimension, uint64 count, then records (int32 id, float32 components, path in 256 bytes). Option dim, if given, must match."""

    @classmethod
    def name(cls) -> str:
        return "vecbin"

    def schema(self) -> str:
        return "id int, vector array<float>, file_path string"

    def reader(self, schema):
        return VecBinReader(self.options)

    def writer(self, schema, overwrite):
        return VecBinWriter(self.options)


class VecBinReader(DataSourceReader):
    def __init__(self, options):
        self.path = local(options["path"])
        self.step = int(options.get("rowsPerPartition", 1 << 16))
        with open(self.path, "rb") as f:
            head = f.read(12)
        if len(head) < 12:
            raise ValueError("the header is cut off")
        self.dim, self.count = struct.unpack("<iQ", head)
        if "dim" in options and int(options["dim"]) != self.dim:
            raise ValueError(f"the store has dimension {self.dim}, not {options['dim']}")
        if self.dim < 0 or os.path.getsize(self.path) < 12 + self.count * (4 + 4 * self.dim + PATH_BYTES):
            raise ValueError("the file is shorter than its header says")

    def partitions(self):
        return [Rows(i, min(i + self.step, self.count)) for i in range(0, self.count, self.step)] or [Rows(0, 0)]

    def read(self, partition):
        record = np.dtype([("id", "<i4"), ("vector", "<f4", (self.dim,)), ("path", f"S{PATH_BYTES}")])
        with open(self.path, "rb") as f:
            f.seek(12 + partition.start * record.itemsize)
            for i in range(partition.start, partition.end, 4096):
                rows = np.frombuffer(f.read(min(4096, partition.end - i) * record.itemsize), record)
                made = _arrow(rows["id"], rows["vector"].reshape(len(rows), self.dim), "id")
                paths = pa.array([p.split(b"\0")[0].decode("utf-8", "replace") for p in rows["path"].tolist()], pa.string())
                yield pa.RecordBatch.from_arrays([*made.columns, paths], names=["id", "vector", "file_path"])


class VecBinWriter(_PartWriter):
    def id_of(self, r):
        return r["id"]

    def record(self, r, vector):
        path = (r["file_path"] or "").encode()
        if len(path) >= PATH_BYTES:
            raise ValueError("the path does not fit into 255 bytes")
        return struct.pack("<i", r["id"]) + np.array(vector, "<f4").tobytes() + path.ljust(PATH_BYTES, b"\0")

    def header(self, rows, columns):
        return struct.pack("<iQ", columns, rows)


def register(spark) -> None:
    spark.dataSource.register(NpySource)
    spark.dataSource.register(VecBinSource)
