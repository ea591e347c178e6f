"""Rasters as Parquet: a table of cells beside one row of grid geometry, checked when written and when read."""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: what the raster formats of the field write where there is no data.
NODATA = -3.4028234663852886e38


@dataclass(frozen=True)
class Grid:
    """Size, reference system and affine of a lattice: x = a + b * c, y = d + f * r for upright grids."""

    height: int
    width: int
    crs: str = ""
    a: float = 0.0
    b: float = 1.0
    d: float = 0.0
    f: float = -1.0

    def cell(self, x: Column, y: Column) -> tuple[Column, Column]:
        """Row and column of a point."""
        return F.floor((y - self.d) / self.f).cast("int"), F.floor((x - self.a) / self.b).cast("int")


def write_raster(cells: DataFrame, bands: list[str], grid: Grid, path: str, foot: Column, outside: str = "nan", tile: int = 512) -> None:
    """Bands of a dense lattice, sorted and partitioned by tile, so that a box of cells prunes files.

    Refuses values in the footprint that are null, not finite or outside
    [0, 1]; outside it, cells become null ("nan") or 0 ("zeros").
    """
    if outside not in ("nan", "zeros"):
        raise ValueError("outside must be nan or zeros")
    bad = [F.count(F.when(foot & (F.col(b).isNull() | F.isnan(b) | (F.col(b) < 0) | (F.col(b) > 1)), 1)).alias(b) for b in bands]
    found = cells.agg(F.count(F.lit(1)).alias("n"), *bad).first()
    if found["n"] != grid.height * grid.width:
        raise ValueError(f"{found['n']} cells for a grid of {grid.height} x {grid.width}")
    if any(found[b] for b in bands):
        raise ValueError(f"invalid values inside the footprint: { {b: found[b] for b in bands if found[b]} }")
    rest = F.lit(None) if outside == "nan" else F.lit(0.0)
    out = cells.select("r", "c", *(F.when(foot, F.col(b)).otherwise(rest).cast("float").alias(b) for b in bands))
    out.withColumns({"tr": F.floor(F.col("r") / tile).cast("int"), "tc": F.floor(F.col("c") / tile).cast("int")}).repartition("tr", "tc").sortWithinPartitions("r", "c").write.partitionBy("tr", "tc").parquet(f"{path}/cells")
    cells.sparkSession.createDataFrame([tuple(asdict(grid).values())], "height int, width int, crs string, a double, b double, d double, f double").coalesce(1).write.json(f"{path}/grid")


def read_grid(spark: SparkSession, path: str) -> Grid:
    row = spark.read.schema("height int, width int, crs string, a double, b double, d double, f double").json(f"{path}/grid").first()
    return Grid(**row.asDict())


def same_grid(a: Grid, b: Grid) -> None:
    """Raises where size, reference system or affine differ."""
    if a != b:
        raise ValueError(f"grids differ: {a} and {b}")


def band_names(found: list[str], declared: list[str] | None = None) -> list[str]:
    """Names before " - ", trimmed and in lower case; raises where one is empty or repeats, or where they aren't the declared ones in order."""
    names = [n.split(" - ", 1)[0].strip().casefold() for n in found]
    if "" in names or len(set(names)) != len(names):
        raise ValueError(f"empty or repeated band names: {names}")
    if declared is not None and names != [d.casefold() for d in declared]:
        raise ValueError(f"bands {names}, not {declared}")
    return names


def read_raster(spark: SparkSession, path: str, bands: list[str] | None = None, like: Grid | None = None, box: tuple[int, int, int, int] | None = None, tile: int = 512) -> DataFrame:
    """(r, c, bands): only the named bands are read; sentinels and not-a-numbers become null; the grid must be like another's where one is given.

    box: first and last row, first and last column; only folders of tiles that
    meet it are listed, and files are skipped by their row and column ranges.
    """
    if like is not None:
        same_grid(read_grid(spark, path), like)
    table = spark.read.parquet(f"{path}/cells")
    if box:
        r0, r1, c0, c1 = box
        table = table.filter(F.col("tr").between(r0 // tile, r1 // tile) & F.col("tc").between(c0 // tile, c1 // tile) & F.col("r").between(r0, r1) & F.col("c").between(c0, c1))
    names = bands or [c for c in table.columns if c not in ("r", "c", "tr", "tc")]
    missing = [b for b in names if b not in table.columns]
    if missing:
        raise ValueError(f"no bands {missing}")
    clean = lambda b: F.when(F.isnan(b) | (F.col(b) <= NODATA / 2), None).otherwise(F.col(b))
    return table.select("r", "c", *(clean(b).alias(b) for b in names))


def footprint(cells: DataFrame, band: str) -> DataFrame:
    """Cells whose value is finite."""
    return cells.filter(F.col(band).isNotNull() & ~F.isnan(band)).select("r", "c")


def verify_blobs(spark: SparkSession, path: str, manifest: DataFrame) -> DataFrame:
    """Per manifest row (name, sha256, bytes): whether the file below path is there with that digest and size."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    files = files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.sha2("content", 256).alias("found_sha256"), F.col("length").alias("found_bytes"))
    return manifest.join(files, "name", "left").withColumn("ok", F.coalesce((F.col("sha256") == F.col("found_sha256")) & (F.col("bytes") == F.col("found_bytes")), F.lit(False)))
