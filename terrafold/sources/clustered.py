"""Grids laid out along a space-filling curve, so that a box of cells is in few files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows and columns from minus half of this to half of it are told apart.
REACH = 1 << 31


def spread(n: Column) -> Column:
    """The bits of a number under 2^32 with a zero between each two."""
    for by, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        n = n.bitwiseOR(F.shiftleft(n, by)).bitwiseAND(F.lit(mask).cast("long"))
    return n


def curve(row: Column, col: Column) -> Column:
    """Place on the curve: the bits of row and column in turn; negative ones come before."""
    half = REACH // 2
    return F.shiftleft(spread(row.cast("long") + half), 1).bitwiseOR(spread(col.cast("long") + half))


def write_clustered(cells: DataFrame, path: str, files: int) -> None:
    """Write a grid (row_i, col_i and more) to about so many files along the curve, and the extent of each beside it."""
    place = curve(F.col("row_i"), F.col("col_i"))
    cells.repartitionByRange(files, place).sortWithinPartitions(place).write.parquet(path)
    written = cells.sparkSession.read.schema(cells.schema).parquet(path)
    ends = [f(k).alias(f"{n}_{k}") for k in ("row_i", "col_i") for n, f in (("least", F.min), ("most", F.max))]
    written.groupBy(F.input_file_name().alias("file")).agg(*ends).coalesce(1).write.parquet(f"{path}-file_index")


def read_box(spark: SparkSession, path: str, rows: tuple[int, int], cols: tuple[int, int]) -> DataFrame:
    """The cells of a box, ends included; only files whose extent meets it are opened.

    The driver gets the names of those files.
    """
    index = spark.read.parquet(f"{path}-file_index")
    meets = (F.col("most_row_i") >= rows[0]) & (F.col("least_row_i") <= rows[1]) & (F.col("most_col_i") >= cols[0]) & (F.col("least_col_i") <= cols[1])
    names = [r.file for r in index.where(meets).select("file").collect()]
    whole = spark.read.parquet(path)
    found = spark.read.schema(whole.schema).parquet(*names) if names else whole.limit(0)
    return found.where(F.col("row_i").between(*rows) & F.col("col_i").between(*cols))
