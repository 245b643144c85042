"""Table sinks: partitioned Parquet, CSV export, reload, upsert, publish projections, parameterised reads."""
from __future__ import annotations

import json
import uuid
from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from patronage.fixed_values import PUBLISHED_CUSTOMER_COLUMNS, PUBLISHED_LINE_COLUMNS


# ---------------------------------------------------------------- cleaned lines and snapshots
def write_clean(clean: DataFrame, path: str) -> None:
    """Parquet by month. The rebalance hint lets adaptive execution split months that are too big for
    one task and join those that are small, so a busy month neither skews nor shatters."""
    (clean.withColumn("invoice_month", F.date_trunc("month", F.col("invoice_date")).cast("date"))
     .hint("rebalance", "invoice_month").write.mode("overwrite").partitionBy("invoice_month").parquet(path))


def read_clean(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """Typed read-back; ``schema`` is the cleaned table's, the partition column is added."""
    full = T.StructType([*schema.fields, T.StructField("invoice_month", T.DateType())])
    return spark.read.schema(full).parquet(path)


def write_snapshots(train: DataFrame, scoring: DataFrame, path: str) -> None:
    """One folder per snapshot: ``snapshot=train`` (with labels) and ``snapshot=scoring``."""
    train.write.mode("overwrite").parquet(f"{path}/snapshot=train")
    scoring.write.mode("overwrite").parquet(f"{path}/snapshot=scoring")


def read_snapshot(spark: SparkSession, path: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{path}/snapshot={name}")


# ---------------------------------------------------------------- export and reload
def export_csv(df: DataFrame, path: str) -> None:
    """CSV folder with header. Arrays are joined by commas, structs and maps become JSON text."""
    def flat(f: T.StructField):
        if isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StringType):
            return F.array_join(f.name, ",").alias(f.name)
        if isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)):
            return F.to_json(f.name).alias(f.name)
        return F.col(f.name)

    df.select(*[flat(f) for f in df.schema]).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def replace_table(df: DataFrame, path: str) -> int:
    """Full reload of one Parquet table; returns the row count, which the written footers hold.

    (An Observation would count during the write, but it leaves the session unable to ship fitted
    Spark ML models that carry a training summary.)
    """
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path).count()


def _files(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path
    return path(folder).getFileSystem(spark._jsc.hadoopConfiguration()), path


def replace_all(tables: Mapping[str, DataFrame], folder: str, keep: int = 2) -> dict[str, int]:
    """Reload several tables at once: all or none of them change for readers. Returns the row counts.

    Tables go to a version folder of their own; a manifest that names it is written last, and moved into place in one
    step. Readers take the newest manifest, so a failure in between leaves the old version whole. Of the versions
    before, ``keep`` - 1 stay for readers that already hold their file lists.
    """
    spark = next(iter(tables.values())).sparkSession
    fs, path = _files(spark, folder)
    past = _manifests(spark, folder)
    number, version = (past[-1][0] + 1 if past else 1), f"versions/{uuid.uuid4().hex}"
    counts = {name: replace_table(df, f"{folder}/{version}/{name}") for name, df in tables.items()}
    text = json.dumps({"version": version, "tables": counts})
    draft, final = path(f"{folder}/manifests/.draft-{uuid.uuid4().hex}"), path(f"{folder}/manifests/{number:012d}.json")
    out = fs.create(draft)
    out.write(bytearray(text.encode()))
    out.close()
    if not fs.rename(draft, final):
        raise FileExistsError(f"another reload published version {number} first")
    for old_number, old in past[:len(past) + 1 - keep]:
        fs.delete(path(f"{folder}/{old['version']}"), True)
        fs.delete(path(f"{folder}/manifests/{old_number:012d}.json"), False)
    return counts


def _manifests(spark: SparkSession, folder: str) -> list[tuple[int, dict[str, Any]]]:
    """(number, manifest) of the published versions that are kept, oldest first."""
    fs, path = _files(spark, folder)
    where = path(f"{folder}/manifests")
    if not fs.exists(where):
        return []
    names = sorted(s.getPath().getName() for s in fs.listStatus(where) if s.getPath().getName().endswith(".json"))
    texts = {r["name"].rsplit("/", 1)[1]: r["value"] for r in spark.read.text([f"{folder}/manifests/{n}" for n in names], wholetext=True)
             .select(F.input_file_name().alias("name"), "value").collect()} if names else {}
    return [(int(n[:-5]), json.loads(texts[n])) for n in names]


def read_published(spark: SparkSession, folder: str, *names: str) -> list[DataFrame]:
    """Tables of the newest published version; all of them of the same one."""
    version = _manifests(spark, folder)[-1][1]["version"]
    return [spark.read.parquet(f"{folder}/{version}/{name}") for name in names]


def replace_jdbc_table(df: DataFrame, url: str, name: str, partitions: int = 8,
                       properties: Mapping[str, str] | None = None) -> None:
    """Full reload of a database table: empty it, keep its definition, insert in batches over few connections."""
    (df.write.mode("overwrite").option("truncate", True).option("batchsize", 10000).option("numPartitions", partitions)
     .jdbc(url, name, properties=dict(properties or {})))


# ---------------------------------------------------------------- upsert
def latest_per_key(df: DataFrame, key: str, version: str) -> DataFrame:
    """One row per key, the one with the largest version: a partial aggregate, no window over a key."""
    others = [c for c in df.columns if c != key]
    return (df.groupBy(key).agg(F.max_by(F.struct(*others), F.col(version)).alias("_row"))
            .select(*[F.col(key) if c == key else F.col(f"_row.{c}").alias(c) for c in df.columns]))


def upsert(target: DataFrame, updates: DataFrame, key: str = "customer_id", version: str = "scored_at") -> DataFrame:
    """Target rows without an update, plus the newest update per key."""
    newest = latest_per_key(updates, key, version)
    return target.join(newest.select(key), key, "left_anti").select(*target.columns).unionByName(newest.select(*target.columns))


# ---------------------------------------------------------------- publish projections
def publish_lines(clean: DataFrame, customers: DataFrame) -> DataFrame:
    """Customer-model lines of known customers, description cut to 255 characters."""
    return (clean.where("use_for_customer_model").join(customers.select("customer_id"), "customer_id", "left_semi")
            .withColumn("description", F.substring("description", 1, 255)).select(*PUBLISHED_LINE_COLUMNS))


def publish_customers(snapshot: DataFrame, feature_columns: Sequence[str]) -> DataFrame:
    """Customer table with all features as one JSON column."""
    return snapshot.select(*PUBLISHED_CUSTOMER_COLUMNS, F.to_json(F.struct(*feature_columns)).alias("features_json"))


# ---------------------------------------------------------------- reads
def read_sql(spark: SparkSession, query: str, params: Mapping[str, Any] | None = None,
             tables: Mapping[str, DataFrame] | None = None) -> DataFrame:
    """Read-only query with named parameters over temporary views."""
    for name, df in (tables or {}).items():
        df.createOrReplaceTempView(name)
    return spark.sql(query, args=dict(params or {}))


def orphans(child: DataFrame, parent: DataFrame, key: str = "customer_id") -> DataFrame:
    """Child keys that have no parent row (foreign keys are not enforced by files)."""
    return child.select(key).distinct().join(parent.select(key), key, "left_anti")

