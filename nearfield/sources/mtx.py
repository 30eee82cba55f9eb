"""Matrix-Market files and compressed-column text files as DataFrames, and back.

Header lines are read by Spark on the driver side (a few lines); the entries are a distributed text scan
whose header rows are told apart by the comment sign and by the size line's place, not by its text alone.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.graph import weighted
from ..operators.matrix import sort_coo, undirect, undirect_simple

#: Error codes of the public Matrix-Market format tools.
COULD_NOT_READ, PREMATURE_EOF, NOT_MTX, NO_HEADER, UNSUPPORTED_TYPE, LINE_TOO_LONG, COULD_NOT_WRITE = 11, 12, 13, 14, 15, 16, 17


class MtxError(ValueError):
    """A malformed file; ``code`` as in the public format tools."""

    def __init__(self, code: int, text: str):
        super().__init__(f"{text} ({code})")
        self.code = code


@dataclass(frozen=True)
class Header:
    """Type code and sizes of a file; ``nnz`` is None for array files."""

    format: str
    field: str
    symmetry: str
    rows: int = 0
    cols: int = 0
    nnz: int | None = None

    @property
    def valid(self) -> bool:
        """No dense pattern, no real hermitian, no pattern hermitian or skew-symmetric."""
        return not (
            (self.format == "array" and self.field == "pattern")
            or (self.field == "real" and self.symmetry == "hermitian")
            or (self.field == "pattern" and self.symmetry in ("hermitian", "skew-symmetric"))
        )

    def banner(self) -> str:
        return f"%%MatrixMarket matrix {self.format} {self.field} {self.symmetry}"

    def size_line(self) -> str:
        return f"{self.rows} {self.cols}" + ("" if self.nnz is None else f" {self.nnz}")


def parse_banner(line: str) -> Header:
    """Type code of a banner line; case does not matter after the first word."""
    words = line.split()
    if len(words) < 5:
        raise MtxError(PREMATURE_EOF, "banner too short")
    if words[0] != "%%MatrixMarket":
        raise MtxError(NO_HEADER, "no banner")
    kind, fmt, field, sym = (w.lower() for w in words[1:5])
    if kind != "matrix" or fmt not in ("coordinate", "array") or field not in ("real", "complex", "pattern", "integer") or sym not in ("general", "symmetric", "hermitian", "skew-symmetric"):
        raise MtxError(UNSUPPORTED_TYPE, f"unsupported type: {line.strip()}")
    h = Header(fmt, field, sym)
    if not h.valid:
        raise MtxError(UNSUPPORTED_TYPE, f"no such matrix: {line.strip()}")
    return h


def parse_size(line: str, header: Header) -> Header:
    """The header with sizes from a size line."""
    try:
        n = [int(x) for x in line.split()]
    except ValueError as e:
        raise MtxError(PREMATURE_EOF, "no size line") from e
    want = 3 if header.format == "coordinate" else 2
    if len(n) < want:
        raise MtxError(PREMATURE_EOF, "size line too short")
    return Header(header.format, header.field, header.symmetry, n[0], n[1], n[2] if want == 3 else None)


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(value, at): lines with their order inside the file; files are read whole-line by Spark, split freely."""
    return spark.read.text(path).select("value", F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))


def read_header(spark: SparkSession, path: str) -> Header:
    """Banner and sizes; comment and blank lines between them are skipped."""
    head = spark.read.text(path).limit(1000).collect()
    if not head:
        raise MtxError(PREMATURE_EOF, "empty file")
    h = parse_banner(head[0].value)
    for r in head[1:]:
        if r.value.strip() and not r.value.startswith("%"):
            return parse_size(r.value, h)
    raise MtxError(PREMATURE_EOF, "no size line")


def read_mtx(spark: SparkSession, path: str, zero_indexed: bool = False, read_values: bool = True, directed: int = 0, ordered: bool = False, fast: bool = False, strict: bool = False) -> DataFrame:
    """(row, col, val) of a coordinate file, or of an array file, whose values stand column by column.

    ``zero_indexed`` tells how the file counts. Values are 1 for pattern files or with ``read_values`` off.
    ``directed``: 0 mirrors symmetric files, 1 never mirrors, 2 always. ``fast`` drops loops (and, where it
    mirrors, repeats) and values. Lines that are no entry (blank or cut off) are left out; ``strict`` counts the
    entries first and raises if there are fewer than the size line says.
    """
    h = read_header(spark, path)
    lines = _lines(spark, path).filter(~F.col("value").startswith("%") & (F.trim("value") != ""))
    # the size line is the first line left of the block at the file's start
    first = lines.filter("block = 0").agg(F.min("at")).first()[0]
    words = F.split(F.trim("value"), r"\s+")
    if h.format == "array":
        coo = _dense(lines.filter(F.col("at") != first).select("at", words.alias("words")), h, read_values and not fast)
        if strict and coo.count() < h.rows * h.cols:
            raise MtxError(PREMATURE_EOF, "fewer values than the size line says")
        return sort_coo(coo) if ordered else coo
    shift = 0 if zero_indexed else 1
    has_value = read_values and not fast and h.field != "pattern"
    val = F.try_element_at(words, F.lit(3)).try_cast("double") if has_value else F.lit(1.0)
    index = lambda i: (F.try_element_at(words, F.lit(i)).try_cast("long") - shift)
    coo = lines.filter(F.col("at") != first).select(index(1).alias("row"), index(2).alias("col"), val.alias("val")).filter("row IS NOT NULL AND col IS NOT NULL AND val IS NOT NULL")
    if strict and coo.count() < (h.nnz or 0):
        raise MtxError(PREMATURE_EOF, "fewer entries than the size line says")
    if fast:
        coo = coo.filter("row <> col")
    if directed == 2 or (directed == 0 and h.symmetry == "symmetric"):
        coo = undirect_simple(coo) if fast else undirect(coo)
    return sort_coo(coo) if ordered else coo


def _dense(lines: DataFrame, h: Header, read_values: bool) -> DataFrame:
    """(row, col, val) of an array file's values, numbered across lines; symmetric ones hold the lower triangle."""
    values = lines.select("at", F.posexplode("words").alias("in_line", "x"))
    # lines are few partitions of ordered ids: sizes by partition give each its first number
    part = F.shiftright("at", 33)
    one = values.select(part.alias("part"), "at", "in_line", F.col("x").try_cast("double").alias("val")).filter("val IS NOT NULL")
    sizes = one.groupBy("part").agg(F.count("*").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy("part").orderBy("at", "in_line")
    flat = one.join(sizes, "part").select((F.col("before") + F.row_number().over(inside) - 1).alias("i"), "val")
    val = F.col("val") if read_values else F.lit(1.0)
    if h.symmetry == "general":
        return flat.select((F.col("i") % h.rows).alias("row"), F.floor(F.col("i") / h.rows).cast("long").alias("col"), val.alias("val")).filter(F.col("col") < h.cols)
    # column c of the lower triangle begins at c n - c (c - 1) / 2, or without the diagonal at c (n - 1) - c (c - 1) / 2
    strict = int(h.symmetry == "skew-symmetric")
    size = h.rows - strict
    b = 2 * size + 1
    c = F.floor((F.lit(b) - F.sqrt(F.lit(float(b * b)) - 8 * F.col("i"))) / 2).cast("long")
    row = F.col("i") - (F.col("c") * size - F.col("c") * (F.col("c") - 1) / 2).cast("long") + F.col("c") + strict
    low = flat.withColumn("c", c).select(row.alias("row"), F.col("c").alias("col"), val.alias("val"))
    mirrored = low.filter("row <> col").select(F.col("col").alias("row"), F.col("row").alias("col"), (F.col("val") * (-1 if strict else 1)).alias("val"))
    return low.unionAll(mirrored)


def write_array(coo: DataFrame, path: str, rows: int, cols: int, digits: int = 10) -> None:
    """One array file: banner, comment line, sizes, then all values column by column, 0 where there is no entry."""
    spark = coo.sparkSession
    h = Header("array", "real", "general", rows, cols)
    every = spark.range(rows * cols).select((F.col("id") % rows).alias("row"), F.floor(F.col("id") / max(1, rows)).cast("long").alias("col"), "id")
    body = every.join(coo.select("row", "col", "val"), ["row", "col"], "left").select(F.lit(1).alias("part"), "id", F.format_string(f"%.{digits}g", F.coalesce("val", F.lit(0.0))).alias("value"))
    head = spark.createDataFrame([(0, i, x) for i, x in enumerate((h.banner(), "%", h.size_line()))], "part int, id long, value string")
    head.unionAll(body).orderBy("part", "id").coalesce(1).select("value").write.mode("overwrite").text(path)


def write_mtx(coo: DataFrame, path: str, rows: int, cols: int, digits: int = 10, zero_indexed: bool = False, field: str = "real") -> None:
    """One coordinate file: banner, comment line, sizes, entries by row and column with ``digits`` significant digits
    (17 keep a double exactly). A single text file is the format; larger results are better kept as Parquet."""
    spark, nnz = coo.sparkSession, coo.count()
    shift = 0 if zero_indexed else 1
    h = Header("coordinate", field, "general", rows, cols, nnz)
    entry = F.concat_ws(" ", F.col("row") + shift, F.col("col") + shift, *([] if field == "pattern" else [F.format_string(f"%.{digits}g", F.col("val"))]))
    body = coo.select(F.lit(1).alias("part"), "row", "col", entry.alias("value"))
    head = spark.createDataFrame([(0, i, 0, x) for i, x in enumerate((h.banner(), "%", h.size_line()))], "part int, row long, col long, value string")
    head.unionAll(body).orderBy("part", "row", "col").coalesce(1).select("value").write.mode("overwrite").text(path)


def _positions(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """(i, x): white-space separated numbers of a text file with their position."""
    words = spark.read.text(path, wholetext=True).select(F.posexplode(F.split(F.trim("value"), r"\s+")).alias("i", "x"))
    return words.filter("x <> ''").select(F.col("i").cast("long").alias("i"), F.col("x").cast(kind).alias("x"))


def read_csc_text(spark: SparkSession, path: str) -> DataFrame:
    """(row, col, val) from col_val.txt, col_ptr.txt and col_idx.txt in a folder."""
    val, idx = _positions(spark, f"{path}/col_val.txt", "double"), _positions(spark, f"{path}/col_idx.txt", "long")
    ptr = _positions(spark, f"{path}/col_ptr.txt", "long")
    ends = ptr.select((F.col("i") - 1).alias("i"), F.col("x").alias("end"))
    cols = ptr.join(ends, "i").filter("x < end").select(F.col("i").alias("col"), F.explode(F.sequence(F.col("x"), F.col("end") - 1)).alias("i"))
    return cols.join(idx.withColumnRenamed("x", "row"), "i").join(val.withColumnRenamed("x", "val"), "i").select("row", "col", "val")


def load_graph(spark: SparkSession, path: str, zero_indexed: bool = False) -> DataFrame:
    """(src, dst, weight): edges without loops, weighted 1 / out-degree of the source."""
    edges = read_mtx(spark, path, zero_indexed, fast=True, directed=1).select(F.col("row").alias("src"), F.col("col").alias("dst"))
    return weighted(edges)
