"""Reading invoice lines: CSV scan, canonical columns, union of yearly files."""
from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from patronage.fixed_values import COLUMN_ALIASES
from patronage.session import materialise


def read_csv(spark: SparkSession, paths: str | Sequence[str], multi_line: bool = False) -> DataFrame:
    """CSV or csv.gz files or folders with a header row; every column is read as text.

    Quotes inside quoted text are doubled. ``multi_line`` allows line breaks inside quotes, at the
    price of one task per file.

    The header of one file names the columns, so no pass over the data is needed to infer types. A
    gzip file is one task each: land large gzip input to Parquet first (``land``).
    """
    first = [paths] if isinstance(paths, str) else list(paths)
    header = spark.read.option("header", True).option("inferSchema", False).option("escape", '"').csv(first[0]).schema
    schema = T.StructType([T.StructField(f.name, T.StringType()) for f in header])
    return (spark.read.schema(schema).option("header", True).option("enforceSchema", False).option("escape", '"')
            .option("multiLine", multi_line).csv(first))


def standardise_columns(df: DataFrame) -> DataFrame:
    """Canonical names and types in one projection: bad numbers and dates become null (also NaN, infinity and customer numbers that aren't whole), text is trimmed."""
    chosen: dict[str, str] = {}
    for column in df.columns:
        canonical = COLUMN_ALIASES.get(re.sub(r"[^a-z0-9]", "", column.lower()))
        if canonical and canonical not in chosen:
            chosen[canonical] = column
    # trim() takes the blanks; other white space counts as well
    strip = lambda c: F.regexp_replace(c.cast("string"), r"(?U)^\s+|\s+$", "")
    def as_number(c):
        v = c.try_cast("double")
        return F.when(~F.isnan(v) & (F.abs(v) != float("inf")), v)

    def as_whole(c):
        v = as_number(c)
        return F.when(v == F.floor(v), v.try_cast("long"))

    typed = {
        "invoice": strip,
        "stock_code": lambda c: F.upper(strip(c)),
        "description": lambda c: c.cast("string"),
        "quantity": as_number,
        "invoice_date": lambda c: c.try_cast("timestamp_ntz"),
        "unit_price": as_number,
        "customer_id": as_whole,
        "country": strip,
    }
    order = list(dict.fromkeys(COLUMN_ALIASES.values()))
    return df.select(*[typed[c](F.col(f"`{chosen[c]}`")).alias(c) for c in order if c in chosen])


def combine_sources(frames: Sequence[DataFrame]) -> DataFrame:
    """Union of yearly sources after standardising each. Order is left to the write (``land``)."""
    out = None
    for frame in frames:
        part = standardise_columns(frame)
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    if out is None:
        raise ValueError("no sources given")
    return out


def land(df: DataFrame, path: str) -> None:
    """Write standardised lines as Parquet in date order (range partitions, sorted inside each).

    The date alone would send all rows of one instant to one task, so invoice and stock code join
    the range key.
    """
    keys = ["invoice_date", "invoice", "stock_code"]
    df.repartitionByRange(*keys).sortWithinPartitions(*keys).write.mode("overwrite").parquet(path)


# ---------------------------------------------------------------- rows of files
def with_file_rows(read: DataFrame, header: bool = True) -> DataFrame:
    """Rows of a text format (CSV, JSON lines) with ``file_name`` and ``file_row``, the number of their line in the file.

    Files are read in blocks by many tasks. Rows are numbered inside a task as they are written, and a block starts
    after the rows of the blocks before it in its file; with a header the first row is number 2. Records that span
    lines (``multiLine``) count as one.
    """
    at = [F.col("_metadata.file_name").alias("file_name"), F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_block_start").alias("_block")]
    placed = materialise(read.select("*", *at).withColumn("_at", F.monotonically_increasing_id()), "file-rows")
    blocks = placed.groupBy("_path", "_block").agg(F.count(F.lit(1)).alias("_rows"), F.min("_at").alias("_first"))
    before = F.sum("_rows").over(Window.partitionBy("_path").orderBy("_block")) - F.col("_rows")  # one row a block
    shift = blocks.select(F.col("_path").alias("_k_path"), F.col("_block").alias("_k_block"), (before - F.col("_first") + (2 if header else 1)).alias("_shift"))
    joined = placed.join(shift, (F.col("_path") == F.col("_k_path")) & (F.col("_block") == F.col("_k_block")))
    return joined.select(*read.columns, "file_name", (F.col("_at") + F.col("_shift")).alias("file_row"))
