"""Spark data source "mat5": numeric variables of classic MATLAB files (level 5) as rows of samples.

    register(spark)
    spark.read.format("mat5").schema("part int, sample long, EEG float, Fs double").load(folder)

The schema says what is decoded: other variables are skipped by their headers. Planning reads headers alone, so samples are
numbered through from part to part without a shuffle, and variables that are stored plainly are read in slices, one a task.
Files with a wanted variable that is compressed are streamed by one task each, a slice at a time.
"""

from __future__ import annotations

import fnmatch
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema

from .matlab import _COMPRESSED, _MATRIX, _TYPES

#: Samples of a slice, and how much of a variable is read for its header.
SLICE, HEAD = 1_000_000, 512
#: The classes of numeric arrays.
_NUMERIC = range(6, 16)
#: Columns that are not variables.
_OWN = ("path", "part", "sample")


@dataclass(frozen=True)
class Variable:
    name: str
    dtype: str
    count: int
    at: int  #: first byte of the numbers: in the file, or in the inflated element
    packed: tuple[int, int] | None  #: byte range of the compressed element in the file


@dataclass
class Slice(InputPartition):
    path: str
    part: int
    first: int  #: number of the file's first sample
    lo: int
    hi: int
    variables: dict[str, Variable]


def _tag(data: bytes, at: int, order: str) -> tuple[int, int, int, int]:
    """Type and size of the element at a byte, where its data are, and where the next one begins."""
    kind, size = struct.unpack_from(order + "II", data, at)
    if kind >> 16:
        return kind & 0xFFFF, kind >> 16, at + 4, at + 8
    return kind, size, at + 8, at + 8 + size + -size % 8


def _variable(head: bytes, order: str, base: int, packed: tuple[int, int] | None) -> Variable | None:
    """What the head of an array's data says; None for what is not numeric."""
    _, _, at, following = _tag(head, 0, order)
    kind = struct.unpack_from(order + "I", head, at)[0]
    _, _, _, following = _tag(head, following, order)
    _, size, at, following = _tag(head, following, order)
    name = head[at : at + size].decode("latin-1")
    if kind & 0xFF not in _NUMERIC or kind & 0x800:  # cells, text, sparse or complex numbers
        return None
    if following + 8 > len(head):
        return Variable(name, order + "f8", 0, base, packed)
    kind, size, at, _ = _tag(head, following, order)
    dtype = np.dtype(order + _TYPES[kind])
    return Variable(name, dtype.str, size // dtype.itemsize, base + at, packed)


def variables(file) -> dict[str, Variable]:
    """The numeric variables of an open file, from headers alone."""
    head = file.read(128)
    if len(head) < 128 or head[126:128] not in (b"IM", b"MI"):
        raise ValueError("not a level 5 MATLAB file")
    order, out, at = ("<" if head[126:128] == b"IM" else ">"), {}, 128
    while True:
        file.seek(at)
        data = file.read(8 + HEAD)
        if len(data) < 8:
            return out
        kind, size, begin, following = _tag(data, 0, order)
        found = None
        if kind == _COMPRESSED:
            following = begin + size
            inflated = zlib.decompressobj().decompress(data[8 : 8 + size], 8 + HEAD)
            if struct.unpack_from(order + "I", inflated)[0] == _MATRIX:
                found = _variable(inflated[8:], order, 8, (at + 8, at + 8 + size))
        elif kind == _MATRIX and size:
            found = _variable(data[8 : 8 + size], order, at + 8, None)
        if found is not None:
            out[found.name] = found
        at += following


def _numbers(file, v: Variable, lo: int, hi: int) -> Iterator[np.ndarray]:
    """Numbers lo to hi of a variable, SLICE at a time."""
    dtype = np.dtype(v.dtype)
    if v.packed is None:
        for a in range(lo, hi, SLICE):
            b = min(a + SLICE, hi)
            file.seek(v.at + a * dtype.itemsize)
            yield np.frombuffer(file.read((b - a) * dtype.itemsize), dtype)
        return
    begin, end = v.packed
    inflate, skip, held = zlib.decompressobj(), v.at + lo * dtype.itemsize, b""
    for a in range(lo, hi, SLICE):
        wanted = (min(a + SLICE, hi) - a) * dtype.itemsize
        held = bytearray(held)
        while len(held) < wanted:
            data = inflate.unconsumed_tail
            if not data:
                file.seek(begin)
                data = file.read(min(1 << 20, end - begin))
                begin += len(data)
            more = inflate.decompress(data, 1 << 20)
            if not data and not more:
                raise ValueError(f"{v.name} ends too early")
            held += more[skip:]
            skip = max(skip - len(more), 0)
        yield np.frombuffer(bytes(held[:wanted]), dtype)
        held = held[wanted:]


def _store(path: str) -> tuple[pafs.FileSystem, str]:
    """The store of a path or URI that this library's readers know (local, hdfs, s3, gs), and the path in it."""
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def _files(options: dict[str, str]) -> list[str]:
    """Paths in their store: those named in parts in that order, else the folder's files by name."""
    store, root = _store(options["path"])
    if store.get_file_info(root).type == pafs.FileType.File:
        return [root]
    found = {f.base_name: f.path for f in store.get_file_info(pafs.FileSelector(root)) if f.type == pafs.FileType.File}
    if "parts" in options:
        names = [n.strip() for n in options["parts"].split(",")]
        if missing := [n for n in names if n not in found]:
            raise FileNotFoundError(f"missing in {root}: {', '.join(missing)}")
        return [found[n] for n in names]
    return [found[n] for n in sorted(found) if fnmatch.fnmatchcase(n, options.get("pathglobfilter", "*.mat"))]


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str], schema: T.StructType):
        self.options, self.schema = options, schema

    def partitions(self) -> list[Slice]:
        wanted, out, first = [f.name for f in self.schema if f.name not in _OWN], [], 0
        store, _ = _store(self.options["path"])
        width = int(self.options.get("slice", SLICE))
        for part, path in enumerate(_files(self.options)):
            with store.open_input_file(path) as file:
                found = variables(file)
            if missing := [n for n in wanted if n not in found]:
                raise ValueError(f"{path} lacks {', '.join(missing)}")
            # without a wanted variable the longest one gives the samples
            own = {n: found[n] for n in wanted}
            counts = {v.count for v in (own or found).values()}
            n = max(counts, default=0)
            if own and counts - {1, n}:
                raise ValueError(f"{path}: {', '.join(f'{k} has {v.count}' for k, v in own.items())} numbers")
            step = max(n, 1) if any(v.packed and v.count > 1 for v in own.values()) else width
            out += [Slice(path, part, first, lo, min(lo + step, n), own) for lo in range(0, n, step)]
            first += n
        return out

    def read(self, p: Slice | None) -> Iterator[pa.RecordBatch]:
        if p is None:  # what is asked for where there are no slices
            return
        store, _ = _store(self.options["path"])
        kinds = to_arrow_schema(self.schema)
        files = {name: store.open_input_file(p.path) for name in p.variables}
        try:
            single = {n: next(_numbers(files[n], v, 0, 1))[0] for n, v in p.variables.items() if v.count == 1}
            streams = {n: _numbers(files[n], v, p.lo, p.hi) for n, v in p.variables.items() if v.count != 1}
            for a in range(p.lo, p.hi, SLICE):
                n = min(a + SLICE, p.hi) - a
                columns = {"path": lambda: np.full(n, p.path, object), "part": lambda: np.full(n, p.part), "sample": lambda a=a: np.arange(p.first + a, p.first + a + n)}
                values = []
                for f in kinds:
                    if f.name in streams:
                        x = next(streams[f.name])
                        x = x.astype(x.dtype.newbyteorder("="))
                    else:
                        x = np.full(n, single[f.name]) if f.name in single else columns[f.name]()
                    values.append(pa.array(x).cast(f.type, safe=not pa.types.is_floating(f.type)))
                yield pa.RecordBatch.from_arrays(values, schema=kinds)
        finally:
            for file in files.values():
                file.close()


class Mat5Source(DataSource):
    """Options: path; parts (file names by commas, in order of time) or pathGlobFilter (default *.mat, by name); slice (samples a task).

    Columns: path, part (from 0), sample (numbered through all parts), and any numeric variables; one number stands for all samples
    of its file. A variable that a file lacks, or of another length, is an error that names the file; a folder without
    files gives no rows. Without a schema it is that of the first file, all variables.
    """

    @classmethod
    def name(cls) -> str:
        return "mat5"

    def _own_options(self) -> dict[str, str]:
        return {k.lower(): v for k, v in self.options.items()}

    def schema(self) -> T.StructType:
        options = self._own_options()
        out = T.StructType([T.StructField("path", T.StringType()), T.StructField("part", T.IntegerType()), T.StructField("sample", T.LongType())])
        for path in _files(options)[:1]:
            with _store(options["path"])[0].open_input_file(path) as file:
                for v in variables(file).values():
                    if v.name not in _OWN:
                        kind = T.FloatType() if v.dtype[1:] == "f4" else T.DoubleType() if v.dtype[1] == "f" else T.LongType()
                        out.add(T.StructField(v.name, kind))
        return out

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _Reader(self._own_options(), schema)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Mat5Source)
