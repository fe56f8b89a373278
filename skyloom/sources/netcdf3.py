"""Classic NetCDF (CDF-1, CDF-2, CDF-5) files as a Spark data source.

The header is parsed once on the driver; each task reads the bytes of its own
stretch of the outermost dimension.  HDF5, HDF4 and TIFF need libraries that may
be absent; ``sources.files`` reports them by name.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from .zarr import open_store

# Fixed values of the format: type codes, tags of the header's lists.
TYPES = {1: "i1", 2: "S1", 3: ">i2", 4: ">i4", 5: ">f4", 6: ">f8", 7: "u1", 8: ">u2", 9: ">u4", 10: ">i8", 11: ">u8"}
DIMENSIONS, VARIABLES, ATTRIBUTES = 10, 11, 12

CELLS = "path string, var string, i array<int>, v double"


class FormatError(ValueError):
    """Bytes that are not a classic NetCDF file."""


@dataclass(frozen=True)
class Variable:
    """A variable of a classic file; ``record`` ones grow along the first dimension."""

    name: str
    dims: tuple[str, ...]
    shape: tuple[int, ...]
    dtype: str
    begin: int
    record: bool
    attrs: dict = field(default_factory=dict)

    @property
    def slice_bytes(self) -> int:
        """Bytes of one step of the outermost dimension."""
        return math.prod(self.shape[1:]) * np.dtype(self.dtype).itemsize


@dataclass(frozen=True)
class Header:
    """Dimensions, attributes and variables of a file."""

    dims: dict[str, int]
    attrs: dict
    variables: dict[str, Variable]
    record_bytes: int


class _Cursor:
    def __init__(self, data: bytes):
        self.data, self.at = data, 4
        if data[:3] != b"CDF" or data[3] not in (1, 2, 5):
            raise FormatError("not a classic NetCDF file")
        self.count_code = ">Q" if data[3] == 5 else ">I"
        self.offset_code = ">I" if data[3] == 1 else ">Q"

    def number(self, code: str) -> int:
        size = struct.calcsize(code)
        if self.at + size > len(self.data):
            raise FormatError("the header is cut short")
        self.at += size
        return struct.unpack_from(code, self.data, self.at - size)[0]

    def count(self) -> int:
        return self.number(self.count_code)

    def padded(self, n: int) -> bytes:
        out = self.data[self.at : self.at + n]
        self.at += -(-n // 4) * 4
        return out

    def text(self) -> str:
        return self.padded(self.count()).decode()

    def entries(self, tag: int) -> range:
        found, n = self.number(">I"), self.count()
        if found not in (0, tag) or (found == 0 and n):
            raise FormatError("the header is damaged")
        return range(n)

    def attributes(self) -> dict:
        out = {}
        for _ in self.entries(ATTRIBUTES):
            name, kind, n = self.text(), TYPES[self.number(">I")], self.count()
            raw = self.padded(n * np.dtype(kind).itemsize)
            if kind == "S1":
                out[name] = raw.decode(errors="replace").rstrip("\0")
            else:
                values = np.frombuffer(raw, kind).tolist()
                out[name] = values[0] if len(values) == 1 else values
        return out


def parse_header(data: bytes) -> Header:
    """Header of a file from its first bytes."""
    c = _Cursor(data)
    records = c.count()
    names, sizes = [], []
    for _ in c.entries(DIMENSIONS):
        names.append(c.text())
        sizes.append(c.count())
    growing = sizes.index(0) if 0 in sizes else -1
    attrs = c.attributes()
    rows = []
    for _ in c.entries(VARIABLES):
        name = c.text()
        ids = [c.count() for _ in range(c.count())]
        own, kind = c.attributes(), TYPES[c.number(">I")]
        c.count()  # the stored size may be wrong for large variables; it is derived instead
        rows.append((name, ids, own, kind, c.number(c.offset_code)))
    sizes = [records if i == growing else n for i, n in enumerate(sizes)]
    variables = {}
    for name, ids, own, kind, begin in rows:
        record = bool(ids) and ids[0] == growing
        variables[name] = Variable(name, tuple(names[i] for i in ids), tuple(sizes[i] for i in ids), kind, begin, record, own)
    in_record = [v for v in variables.values() if v.record]
    step = in_record[0].slice_bytes if len(in_record) == 1 else sum(-(-v.slice_bytes // 4) * 4 for v in in_record)
    return Header(dict(zip(names, sizes, strict=True)), attrs, variables, step)


def read_header(path: str, limit: int = 1 << 20) -> Header:
    """Header of a file; reads more only if the first megabyte does not hold it."""
    fs, name = open_store(path)
    size = fs.get_file_info(name).size
    while True:
        with fs.open_input_file(name) as source:
            data = source.read(min(limit, size))
        try:
            return parse_header(data)
        except (FormatError, struct.error, UnicodeDecodeError):
            if limit >= size:
                raise
            limit *= 8


def read_steps(path: str, header: Header, name: str, first: int, last: int) -> np.ndarray:
    """Steps ``[first, last)`` of the outermost dimension, raw values."""
    v = header.variables[name]
    fs, file = open_store(path)
    with fs.open_input_file(file) as source:
        if not v.shape:
            source.seek(v.begin)
            return np.frombuffer(source.read(np.dtype(v.dtype).itemsize), v.dtype)
        if not v.record:
            source.seek(v.begin + first * v.slice_bytes)
            return np.frombuffer(source.read((last - first) * v.slice_bytes), v.dtype).reshape(last - first, *v.shape[1:])
        parts = []
        for k in range(first, last):
            source.seek(v.begin + k * header.record_bytes)
            parts.append(np.frombuffer(source.read(v.slice_bytes), v.dtype))
    return np.concatenate(parts).reshape(last - first, *v.shape[1:]) if parts else np.empty((0, *v.shape[1:]), v.dtype)


@dataclass
class Steps(InputPartition):
    """A stretch of one file's variable."""

    path: str
    var: str
    first: int
    last: int


class _CellReader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths = options["paths"].split("\n")
        self.variables = options["variables"].split(",")
        self.steps = int(options.get("stepsPerTask", 8))
        self.headers = {p: read_header(p) for p in self.paths}

    def partitions(self) -> Sequence[InputPartition]:
        out = []
        for p, header in self.headers.items():
            for name in self.variables:
                n = (header.variables[name].shape or (1,))[0]
                out += [Steps(p, name, k, min(k + self.steps, n)) for k in range(0, n, self.steps)]
        return out

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        header = self.headers[partition.path]
        values = read_steps(partition.path, header, partition.var, partition.first, partition.last)
        index = np.indices(values.shape).reshape(values.ndim, -1).T.astype(np.int32)
        if values.ndim:
            index[:, 0] += partition.first
        n, width = index.shape
        at = pa.array(np.arange(n + 1, dtype=np.int32) * width)
        yield pa.RecordBatch.from_arrays(
            [pa.array([partition.path] * n), pa.array([partition.var] * n), pa.ListArray.from_arrays(at, pa.array(index.ravel())), pa.array(values.ravel().astype(np.float64))],
            ["path", "var", "i", "v"],
        )


class NetcdfSource(DataSource):
    """``spark.read.format("netcdf3")``: raw cells of the named variables.

    Options: ``paths`` (one a line), ``variables`` (comma list), ``stepsPerTask``.
    """

    @classmethod
    def name(cls) -> str:
        return "netcdf3"

    def schema(self) -> str:
        return CELLS

    def reader(self, schema: StructType) -> DataSourceReader:
        return _CellReader(dict(self.options))


def read_cells(spark: SparkSession, paths: Sequence[str], variables: Sequence[str], **options: str) -> DataFrame:
    """Raw cells ``path, var, i, v`` of files; ``i`` holds the indices in the variable's own order."""
    spark.dataSource.register(NetcdfSource)
    return spark.read.format("netcdf3").options(paths="\n".join(paths), variables=",".join(variables), **options).load()


def write_classic(path: str, dims: dict[str, int | None], variables: dict[str, tuple[Sequence[str], np.ndarray, dict]], attrs: dict | None = None) -> None:
    """Write a small CDF-2 file (for fixtures and exports); a dimension of None grows."""
    codes = {"i1": 1, "S1": 2, "i2": 3, "i4": 4, "f4": 5, "f8": 6}

    def text(s: str) -> bytes:
        raw = s.encode()
        return struct.pack(">I", len(raw)) + raw + b"\0" * (-len(raw) % 4)

    def attributes(items: dict) -> bytes:
        out = struct.pack(">II", ATTRIBUTES if items else 0, len(items))
        for k, v in items.items():
            raw = v.encode() if isinstance(v, str) else np.atleast_1d(v).astype(np.atleast_1d(v).dtype.newbyteorder(">")).tobytes()
            code = 2 if isinstance(v, str) else codes[np.atleast_1d(v).dtype.str[1:]]
            n = len(raw) if isinstance(v, str) else np.atleast_1d(v).size
            out += text(k) + struct.pack(">II", code, n) + raw + b"\0" * (-len(raw) % 4)
        return out

    names = list(dims)
    growing = next((n for n, size in dims.items() if size is None), None)
    records = max((a.shape[0] for d, a, _ in variables.values() if d and d[0] == growing), default=0)
    ordered = sorted(variables.items(), key=lambda kv: bool(kv[1][0]) and kv[1][0][0] == growing)
    big = {k: a.astype(a.dtype.newbyteorder(">")) for k, (_, a, _) in ordered}

    def header(begins: dict[str, int]) -> bytes:
        out = b"CDF\2" + struct.pack(">I", records) + struct.pack(">II", DIMENSIONS if names else 0, len(names))
        out += b"".join(text(n) + struct.pack(">I", dims[n] or 0) for n in names) + attributes(attrs or {})
        out += struct.pack(">II", VARIABLES, len(variables))
        for k, (d, a, own) in ordered:
            size = a[0].nbytes if d and d[0] == growing else a.nbytes
            out += text(k) + struct.pack(">I", len(d)) + b"".join(struct.pack(">I", names.index(x)) for x in d) + attributes(own)
            out += struct.pack(">II", codes[a.dtype.str[1:]], -(-size // 4) * 4) + struct.pack(">Q", begins.get(k, 0))
        return out

    at, begins = len(header({})), {}
    fixed = [k for k, (d, _, _) in ordered if not (d and d[0] == growing)]
    moving = [k for k, _ in ordered if k not in fixed]
    for k in fixed:
        begins[k] = at
        at += -(-big[k].nbytes // 4) * 4
    pad = len(moving) > 1
    for k in moving:
        begins[k] = at
        at += -(-big[k][0].nbytes // 4) * 4 if pad else big[k][0].nbytes
    with open(path, "wb") as out:
        out.write(header(begins))
        for k in fixed:
            out.write(big[k].tobytes() + b"\0" * (-big[k].nbytes % 4))
        for r in range(records):
            for k in moving:
                raw = big[k][r].tobytes()
                out.write(raw + b"\0" * (-len(raw) % 4 if pad else 0))
