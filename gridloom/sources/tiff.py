"""Rasters as uncompressed TIFF bytes: a data source that reads strips, and writes a file for each band of rows.

    spark.dataSource.register(TiffSource)
    cells = spark.read.format("lattice_tiff").option("bands", "px,tax").load(folder)

Only the strips of the wanted bands that rows between pushed bounds can need
are read. Paths go through pyarrow's file systems, so a folder may be remote.
"""

from __future__ import annotations

import os
import re
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from html import escape, unescape

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.types import StructType

from .raster import NODATA, band_names

#: Fixed values of the format: bytes and letters of field types, and the tags that are read or written. FIRST_ROW is a private one: the row of the lattice that a part begins with.
_SIZE = {1: (1, "B"), 2: (1, "s"), 3: (2, "H"), 4: (4, "I"), 12: (8, "d"), 16: (8, "Q")}
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, OFFSETS, SAMPLES, ROWS_PER_STRIP, COUNTS, PLANAR, FORMAT, METADATA, NODATA_TAG, FIRST_ROW = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284, 339, 42112, 42113, 65000
_KIND = {(1, 8): "u1", (1, 16): "u2", (1, 32): "u4", (2, 8): "i1", (2, 16): "i2", (2, 32): "i4", (3, 32): "f4", (3, 64): "f8"}
#: Bytes of strips that a task reads, about.
TASK_BYTES = 8 << 20


@dataclass(frozen=True)
class Header:
    """What is needed to read a file: its size, bands and strips."""

    height: int
    width: int
    names: tuple[str, ...]
    kind: str
    strip_rows: int
    planar: bool
    offsets: tuple[int, ...]
    nodata: float | None
    first_row: int


def place_of(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if path.startswith("file:"):
        path = "/" + path[5:].lstrip("/")
    return fs.FileSystem.from_uri(path if "://" in path else os.path.abspath(path))


def read_header(system: fs.FileSystem, path: str) -> Header:
    """The header of a classic, uncompressed TIFF in strips; raises on any other."""
    with system.open_input_file(path) as f:
        mark, forty_two, at = struct.unpack("<2sHI", f.read_at(8, 0))
        end = {b"II": "<", b"MM": ">"}.get(mark)
        if end is None:
            raise ValueError(f"{path} is no TIFF")
        if end == ">":
            forty_two, at = struct.unpack(">HI", f.read_at(6, 2))
        if forty_two != 42:
            raise ValueError(f"{path} is no classic TIFF")
        (n,) = struct.unpack(f"{end}H", f.read_at(2, at))
        tags: dict[int, tuple] = {}
        for k in range(n):
            tag, kind, count, value = struct.unpack(f"{end}HHI4s", f.read_at(12, at + 2 + 12 * k))
            size, letter = _SIZE.get(kind, (0, ""))
            if not size:
                continue
            raw = value[: size * count] if size * count <= 4 else f.read_at(size * count, struct.unpack(f"{end}I", value)[0])
            tags[tag] = (raw.rstrip(b"\0").decode("utf-8", "replace"),) if letter == "s" else struct.unpack(f"{end}{count}{letter}", raw)
    one = lambda tag, default: tags.get(tag, (default,))[0]
    if one(COMPRESSION, 1) != 1 or OFFSETS not in tags:
        raise ValueError(f"{path} is compressed or in tiles")
    bands = one(SAMPLES, 1)
    kinds = {_KIND.get((s, b)) for s, b in zip(tags.get(FORMAT, (1,) * bands), tags.get(BITS, (1,) * bands), strict=False)}
    if len(kinds) != 1 or None in kinds:
        raise ValueError(f"{path} mixes or lacks sample formats")
    found = {int(m[1]): unescape(m[2]) for m in re.finditer(r'<Item name="DESCRIPTION" sample="(\d+)"[^>]*>([^<]*)</Item>', one(METADATA, ""))}
    names = band_names([found.get(k, f"band_{k + 1}") for k in range(bands)])
    nodata = one(NODATA_TAG, "")
    height = one(HEIGHT, 0)
    return Header(height, one(WIDTH, 0), tuple(names), end + kinds.pop(), min(one(ROWS_PER_STRIP, height), height), one(PLANAR, 1) == 2, tags[OFFSETS], float(nodata) if nodata else None, one(FIRST_ROW, 0))


def encode(values: np.ndarray, names: list[str], first_row: int = 0, strip_rows: int = 16, nodata: float = NODATA) -> bytes:
    """A TIFF of values (bands, rows, columns) as 32-bit floats, band after band; not-a-numbers become nodata."""
    bands, height, width = values.shape
    strips = -(-height // strip_rows)
    metadata = "<GDALMetadata>" + "".join(f'<Item name="DESCRIPTION" sample="{k}" role="description">{escape(n)}</Item>' for k, n in enumerate(names)) + "</GDALMetadata>"
    sizes = [min(strip_rows, height - s * strip_rows) * width * 4 for s in range(strips)] * bands
    fields = [
        (WIDTH, 4, [width]), (HEIGHT, 4, [height]), (BITS, 3, [32] * bands), (COMPRESSION, 3, [1]), (PHOTOMETRIC, 3, [1]), (OFFSETS, 4, [0] * len(sizes)), (SAMPLES, 3, [bands]), (ROWS_PER_STRIP, 4, [strip_rows]),
        (COUNTS, 4, sizes), (PLANAR, 3, [2]), (FORMAT, 3, [3] * bands), (METADATA, 2, metadata.encode() + b"\0"), (NODATA_TAG, 2, repr(nodata).encode() + b"\0"), (FIRST_ROW, 4, [first_row]),
    ]
    packed = lambda kind, v: bytes(v) if kind == 2 else struct.pack(f"<{len(v)}{_SIZE[kind][1]}", *v)
    start = 8 + 2 + 12 * len(fields) + 4
    spare = sum(len(p) + len(p) % 2 for _, kind, v in fields for p in [packed(kind, v)] if len(p) > 4)
    begin = start + spare
    fields = [(t, k, [begin + sum(sizes[:i]) for i in range(len(sizes))] if t == OFFSETS else v) for t, k, v in fields]
    head, extra = struct.pack("<2sHIH", b"II", 42, 8, len(fields)), b""
    for tag, kind, v in fields:
        p = packed(kind, v)
        if len(p) > 4:
            p, extra = struct.pack("<I", start + len(extra)), extra + p + b"\0" * (len(p) % 2)
        head += struct.pack("<HHI4s", tag, kind, len(v), p.ljust(4, b"\0"))
    data = np.where(np.isnan(values), np.float32(nodata), values).astype("<f4").tobytes()
    return head + struct.pack("<I", 0) + extra + data


class Strips(InputPartition):
    def __init__(self, path: str, header: Header, first: int, last: int):
        self.path, self.header, self.first, self.last = path, header, first, last


class TiffReader(DataSourceReader):
    """Partitions are runs of strips of the files of a folder (or of one file)."""

    def __init__(self, options: dict[str, str], schema: StructType):
        self.path, self.names = options["path"], [f.name for f in schema.fields[2:]]
        self.rows = [-(1 << 62), 1 << 62]

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        """Bounds of r pick the strips; all filters are left to Spark, too."""
        for f in filters:
            if getattr(f, "attribute", None) == ("r",):
                if isinstance(f, EqualTo):
                    self.rows = [max(self.rows[0], f.value), min(self.rows[1], f.value)]
                elif isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                    self.rows[0] = max(self.rows[0], f.value + isinstance(f, GreaterThan))
                elif isinstance(f, (LessThan, LessThanOrEqual)):
                    self.rows[1] = min(self.rows[1], f.value - isinstance(f, LessThan))
            yield f

    def partitions(self) -> list[InputPartition]:
        out: list[InputPartition] = []
        for system, path in files_of(self.path):
            h = read_header(system, path)
            lo, hi = max(0, self.rows[0] - h.first_row), min(h.height - 1, self.rows[1] - h.first_row)
            if lo > hi:
                continue
            step = max(1, TASK_BYTES // max(1, h.strip_rows * h.width * np.dtype(h.kind).itemsize * (len(self.names) if h.planar else len(h.names))))
            first, last = lo // h.strip_rows, hi // h.strip_rows
            out += [Strips(path, h, s, min(s + step - 1, last)) for s in range(first, last + 1, step)]
        return out or [Strips("", Header(0, 0, (), "<f4", 1, True, (), None, 0), 0, -1)]

    def read(self, partition: Strips) -> Iterator[pa.RecordBatch]:
        if partition.last < partition.first:
            return
        h, system = partition.header, place_of(self.path)[0]
        kind, strips = np.dtype(h.kind), -(-h.height // h.strip_rows)
        with system.open_input_file(partition.path) as f:
            for s in range(partition.first, partition.last + 1):
                rows = min(h.strip_rows, h.height - s * h.strip_rows)
                size = rows * h.width * kind.itemsize
                r = np.repeat(np.arange(rows) + h.first_row + s * h.strip_rows, h.width)
                columns = [pa.array(r, pa.int32()), pa.array(np.tile(np.arange(h.width), rows), pa.int32())]
                whole = None if h.planar else np.frombuffer(f.read_at(size * len(h.names), h.offsets[s]), kind).reshape(-1, len(h.names))
                for name in self.names:
                    k = h.names.index(name)
                    v = (np.frombuffer(f.read_at(size, h.offsets[k * strips + s]), kind) if h.planar else whole[:, k]).astype(np.float64)
                    blank = np.isnan(v) | (v <= NODATA / 2) | (v == (h.nodata if h.nodata is not None else np.nan))
                    columns.append(pa.array(v, pa.float64(), mask=blank))
                yield pa.RecordBatch.from_arrays(columns, names=["r", "c", *self.names])


def files_of(path: str) -> list[tuple[fs.FileSystem, str]]:
    """The .tif files of a folder in order of their names, or the file itself."""
    system, at = place_of(path)
    info = system.get_file_info(at)
    if info.type == fs.FileType.File:
        return [(system, at)]
    found = sorted(i.path for i in system.get_file_info(fs.FileSelector(at)) if i.type == fs.FileType.File and i.base_name.endswith(".tif"))
    if not found:
        raise ValueError(f"no .tif files in {path}")
    return [(system, p) for p in found]


class Written(WriterCommitMessage):
    def __init__(self, path: str, name: str):
        self.path, self.name = path, name


class TiffWriter(DataSourceArrowWriter):
    """A file for each task's rows, under a passing name until all tasks are done."""

    def __init__(self, options: dict[str, str], schema: StructType):
        self.path, self.width, self.names = options["path"], int(options["width"]), [f.name for f in schema.fields if f.name not in ("r", "c")]
        self.strip_rows = int(options.get("strip_rows", 16))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        batches = [b for b in iterator if b.num_rows]
        if not batches:
            return Written("", "")
        t = pa.Table.from_batches(batches)  # the rows of one band of rows
        r, c = (t.column(x).to_numpy() for x in ("r", "c"))
        first, height = int(r.min()), int(r.max() - r.min()) + 1
        values = np.full((len(self.names), height, self.width), np.nan, np.float32)
        for k, name in enumerate(self.names):
            values[k, r - first, c] = t.column(name).cast(pa.float64()).to_numpy(zero_copy_only=False)
        system, at = place_of(self.path)
        system.create_dir(at, recursive=True)
        passing = f"{at}/_passing-{uuid.uuid4().hex}"
        with system.open_output_stream(passing) as f:
            f.write(encode(values, self.names, first, self.strip_rows))
        return Written(passing, f"{at}/rows-{first:012d}.tif")

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        system, _ = place_of(self.path)
        for m in messages:
            if m and m.path:
                system.move(m.path, m.name)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        system, _ = place_of(self.path)
        for m in messages:
            if m and m.path and system.get_file_info(m.path).type == fs.FileType.File:
                system.delete_file(m.path)


class TiffSource(DataSource):
    """Options: path; bands, the names to read (all where it is missing); width and strip_rows to write."""

    @classmethod
    def name(cls) -> str:
        return "lattice_tiff"

    def schema(self) -> str:
        system, path = files_of(self.options["path"])[0]
        names = list(read_header(system, path).names)
        wanted = band_names(self.options["bands"].split(",")) if self.options.get("bands") else names
        if set(wanted) - set(names):
            raise ValueError(f"no bands {sorted(set(wanted) - set(names))}")
        return "r int, c int, " + ", ".join(f"`{n}` double" for n in wanted)

    def reader(self, schema: StructType) -> DataSourceReader:
        return TiffReader(self.options, schema)

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return TiffWriter(self.options, schema)


def read_tiff(spark: SparkSession, path: str, bands: list[str] | None = None) -> DataFrame:
    """(r, c, bands) of a folder of TIFFs or of one; sentinels and not-a-numbers become null."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(TiffSource)
    reader = spark.read.format("lattice_tiff")
    return (reader.option("bands", ",".join(bands)) if bands else reader).load(path)


def write_tiff(cells: DataFrame, bands: list[str], height: int, width: int, path: str, rows: int = 256, strip_rows: int = 16) -> None:
    """A TIFF for each band of rows of a lattice; cells that are missing or null get the sentinel. A task holds one band of rows."""
    cells.sparkSession.dataSource.register(TiffSource)
    parts = -(-height // rows)
    dealt = cells.select(F.col("r").cast("int").alias("r"), F.col("c").cast("int").alias("c"), *(F.col(b).cast("double").alias(b) for b in bands))
    dealt = dealt.repartitionById(parts, F.floor(F.col("r") / rows).cast("int"))
    dealt.write.format("lattice_tiff").mode("append").option("width", width).option("strip_rows", strip_rows).save(path)
