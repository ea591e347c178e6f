"""TIFF bytes: round trips, strips of a box, both layouts and byte orders, sentinels, and what is refused."""

import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridloom.sources import tiff

TINY = [(256, 3, 1, struct.pack("<H", 1)), (257, 3, 1, struct.pack("<H", 1)), (258, 3, 1, struct.pack("<H", 32)), (259, 3, 1, struct.pack("<H", 1)), (273, 4, 1, struct.pack("<I", 122)), (277, 3, 1, struct.pack("<H", 1)), (278, 4, 1, struct.pack("<I", 1)), (279, 4, 1, struct.pack("<I", 4)), (339, 3, 1, struct.pack("<H", 3))]


def test_round_trip_of_bands_sentinels_and_names(spark, tmp_path):
    g = np.random.default_rng(1)
    a, b = g.random((70, 23)).astype(np.float32), g.normal(size=(70, 23)).astype(np.float32)
    rows = [(r, c, float(a[r, c]), float(b[r, c]) if (r + c) % 7 else None) for r in range(70) for c in range(23) if (r, c) != (5, 5)]
    df = spark.createDataFrame(rows, "r int, c int, `a & b` double, low double")
    tiff.write_tiff(df, ["a & b", "low"], 70, 23, str(tmp_path / "out"), rows=32, strip_rows=8)
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["rows-000000000000.tif", "rows-000000000032.tif", "rows-000000000064.tif"]
    got = {(x.r, x.c): (x["a & b"], x.low) for x in tiff.read_tiff(spark, str(tmp_path / "out")).collect()}
    want = {(r, c): (x, y) for r, c, x, y in rows} | {(5, 5): (None, None)}
    assert got == want
    one = tiff.read_tiff(spark, f"file://{tmp_path}/out", ["low"])
    assert one.columns == ["r", "c", "low"]
    with pytest.raises(Exception, match="no bands"):
        tiff.read_tiff(spark, str(tmp_path / "out"), ["none"]).columns


def test_a_box_reads_only_its_strips(spark, tmp_path):
    df = spark.range(70 * 23).select((F.col("id") / 23).cast("int").alias("r"), (F.col("id") % 23).cast("int").alias("c"), F.col("id").cast("double").alias("v"))
    tiff.write_tiff(df, ["v"], 70, 23, str(tmp_path), rows=32, strip_rows=8)
    reader = tiff.TiffReader({"path": str(tmp_path)}, df.schema)
    assert len(list(reader.pushFilters([tiff.GreaterThanOrEqual(("r",), 30), tiff.LessThan(("r",), 41), tiff.EqualTo(("c",), 3)]))) == 3
    parts = reader.partitions()
    assert [(p.header.first_row, p.first, p.last) for p in parts] == [(0, 3, 3), (32, 0, 1)]
    read = {r for p in parts for b in reader.read(p) for r in b.column(0).to_pylist()}
    assert read == set(range(24, 48))
    box = tiff.read_tiff(spark, str(tmp_path)).filter("r BETWEEN 30 AND 40 AND c = 3")
    assert sorted((x.r, x.v) for x in box.collect()) == [(r, float(r * 23 + 3)) for r in range(30, 41)]
    assert tiff.read_tiff(spark, str(tmp_path)).filter("r > 1000").count() == 0


def test_other_layouts_and_what_is_refused(tmp_path):
    head = struct.pack("<2sHIH", b"II", 42, 8, len(TINY)) + b"".join(struct.pack("<HHI4s", t, k, n, v.ljust(4, b"\0")) for t, k, n, v in TINY) + struct.pack("<I", 0)
    assert len(head) == 122
    (tmp_path / "one.tif").write_bytes(head + struct.pack("<f", 0.731))
    system, at = tiff.place_of(str(tmp_path / "one.tif"))
    h = tiff.read_header(system, at)
    assert (h.height, h.width, h.names, h.kind, h.planar) == (1, 1, ("band_1",), "<f4", False)
    reader = tiff.TiffReader.__new__(tiff.TiffReader)
    reader.path, reader.names, reader.rows = str(tmp_path / "one.tif"), ["band_1"], [-10, 10]
    assert [b.to_pylist() for p in reader.partitions() for b in reader.read(p)] == [[{"r": 0, "c": 0, "band_1": pytest.approx(0.731)}]]
    big = [(256, 3, 1, struct.pack(">H", 2)), (257, 3, 1, struct.pack(">H", 1)), (258, 3, 2, struct.pack(">HH", 16, 16)), (273, 4, 1, struct.pack(">I", 8 + 2 + 12 * 6 + 4)), (277, 3, 1, struct.pack(">H", 2)), (278, 3, 1, struct.pack(">H", 1))]
    data = struct.pack(">2sHIH", b"MM", 42, 8, 6) + b"".join(struct.pack(">HHI4s", t, k, n, v.ljust(4, b"\0")) for t, k, n, v in big) + struct.pack(">I", 0) + struct.pack(">4H", 1, 2, 300, 4)
    (tmp_path / "big.tif").write_bytes(data)
    reader.path, reader.names = str(tmp_path / "big.tif"), ["band_2", "band_1"]
    assert [[tuple(x.values()) for x in b.to_pylist()] for p in reader.partitions() for b in reader.read(p)] == [[(0, 0, 2.0, 1.0), (0, 1, 4.0, 300.0)]]
    for name, content in (("none.tif", b"XX" + head[2:]), ("packed.tif", head.replace(struct.pack("<HHIH", 259, 3, 1, 1), struct.pack("<HHIH", 259, 3, 1, 5))), ("large.tif", head[:2] + struct.pack("<H", 43) + head[4:])):
        (tmp_path / name).write_bytes(content + b"\0" * 4)
        with pytest.raises(ValueError):
            tiff.read_header(*tiff.place_of(str(tmp_path / name)))
