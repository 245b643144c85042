"""Session and intermediate-table helpers."""
from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int = 8, name: str = "patronage") -> SparkSession:
    """Session for tests and benches on one machine. On a cluster, use the session it provides."""
    return (
        SparkSession.builder.master(f"local[{cpus}]").appName(name)
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", os.environ.get("PATRONAGE_DRIVER_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .config("spark.sql.codegen.cache.maxEntries", "2000")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """Folder for intermediate tables: the one the cluster names in spark.checkpoint.dir.

    Only a local session (tests, one machine) without that setting gets a temporary folder: on a
    cluster each executor would write to its own disk there.
    """
    conf = spark.sparkContext.getConf()
    named = spark.conf.get("spark.checkpoint.dir", None) or conf.get("spark.checkpoint.dir")
    if not named:
        if not conf.get("spark.master", "").startswith("local[") and conf.get("spark.master") != "local":
            raise ValueError("name a folder that all executors share in spark.checkpoint.dir")
        named = tempfile.mkdtemp(prefix="patronage-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named


def _delete(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


class Scratch:
    """Intermediate tables of one piece of work. ``with Scratch():`` deletes those made inside at its end."""
    current: "Scratch | None" = None

    def __init__(self) -> None:
        self.paths: list[tuple[SparkSession, str]] = []

    def __enter__(self) -> "Scratch":
        self.outer, Scratch.current = Scratch.current, self
        return self

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """``df`` written as a table that stays when this piece of work ends."""
        Scratch.current = self.outer
        try:
            return materialise(df, name)
        finally:
            Scratch.current = self

    def __exit__(self, *_: object) -> None:
        Scratch.current = self.outer
        for spark, path in self.paths:
            _delete(spark, path)


def release(*tables: DataFrame) -> None:
    """Delete intermediate tables that nothing will read again."""
    for table in tables:
        _delete(table.sparkSession, table._patronage_path)


def materialise(df: DataFrame, name: str, *cluster_by: str, partition_by: str | None = None, compact: bool = False) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and return the read-back.

    Cuts the lineage at a place that survives the loss of executors, and gives later readers
    column pruning, filter pushdown and a known size. ``cluster_by`` hash-clusters rows before the
    write; ``partition_by`` writes one folder per value of a column with few values; ``compact`` compresses harder, for tables
    of lines and pairs. The table stays until its Scratch ends, or ``release``, or the cleaning of the shared folder.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/patronage/{name}-{uuid.uuid4().hex}"
    if Scratch.current is not None:
        Scratch.current.paths.append((spark, path))
    out = df.repartition(*cluster_by) if cluster_by else df
    writer = out.write.mode("overwrite")
    if compact:
        writer = writer.option("compression", "zstd")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    back._patronage_path = path
    return back
