"""Tables that are replaced as a whole or by partition, with readers never seeing half a write.

A table is a folder of version folders and a log of commits. A write goes into a version folder of its own;
only when all of it is there does a commit, one small file with the next number, name the folders that now make
up the table. A job that dies before that leaves the table as it was; two writers that finish at once cannot both
take the number, and the later one fails. Readers follow the newest commit and go on reading the files
it names. ``expire_versions`` removes what no commit kept names.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

COMMITS = "_commits"
#: Stands for the partition of nulls, as it does in folder names.
NULL = "__HIVE_DEFAULT_PARTITION__"


def _files(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _names(spark: SparkSession, path: str) -> list[str]:
    jvm, files = _files(spark, path)
    folder = jvm.org.apache.hadoop.fs.Path(path)
    return sorted(status.getPath().getName() for status in files.listStatus(folder)) if files.exists(folder) else []


def _newest(spark: SparkSession, path: str) -> tuple[int, dict]:
    """Number and content of the newest commit; 0 and an empty table where there is none."""
    numbers = [int(name.removesuffix(".json")) for name in _names(spark, f"{path}/{COMMITS}") if name.endswith(".json")]
    if not numbers:
        return 0, {"partition": None, "parts": {}}
    newest = max(numbers)
    return newest, json.loads(spark.read.text(f"{path}/{COMMITS}/{newest:010d}.json", wholetext=True).first()["value"])


def _commit(spark: SparkSession, path: str, number: int, content: dict) -> None:
    """The file is written aside and takes its name in one step, which fails if the name is taken."""
    jvm, files = _files(spark, path)
    place = jvm.org.apache.hadoop.fs.Path
    aside, name = place(f"{path}/{COMMITS}/.{uuid.uuid4().hex}"), place(f"{path}/{COMMITS}/{number:010d}.json")
    stream = files.create(aside, False)
    stream.write(bytearray(json.dumps(content).encode()))
    stream.close()
    if files.exists(name) or not files.rename(aside, name):
        files.delete(aside, False)
        raise RuntimeError(f"{path}: another writer committed version {number} first")


def _written(df: DataFrame, path: str, partition: str | None) -> tuple[str, dict[str, int] | int]:
    """Write a version folder; its name and its rows, by partition value where there is a partition."""
    folder = f"v-{uuid.uuid4().hex}"
    if partition is None:
        seen = Observation()
        df.observe(seen, F.count(F.lit(1)).alias("rows")).write.parquet(f"{path}/{folder}")
        return folder, seen.get["rows"]
    df.write.partitionBy(partition).parquet(f"{path}/{folder}")
    # Partition values come from the folder names, so counting reads file footers only.
    if not [name for name in _names(df.sparkSession, f"{path}/{folder}") if "=" in name]:
        return folder, {}
    written = df.sparkSession.read.schema(df.schema).parquet(f"{path}/{folder}")
    counts = written.groupBy(F.col(partition).cast("string").alias("value")).count()
    return folder, {NULL if r["value"] is None else r["value"]: r["count"] for r in counts.collect()}


def replace_table(df: DataFrame, path: str, partition: str | None = None) -> int:
    """Replace a table as a whole; returns the rows written. ``partition`` names a column of few values."""
    spark = df.sparkSession
    number, _ = _newest(spark, path)
    folder, rows = _written(df, path, partition)
    _commit(spark, path, number + 1, {"partition": partition, "schema": df.schema.json(), "parts": {folder: rows}})
    return rows if partition is None else sum(rows.values())


def replace_partitions(df: DataFrame, path: str) -> int:
    """Replace the partitions that occur in ``df`` and keep all others; returns the rows written."""
    spark = df.sparkSession
    number, table = _newest(spark, path)
    partition = table["partition"]
    if partition is None:
        raise ValueError(f"{path} has no partitions to replace")
    folder, rows = _written(df, path, partition)
    kept = {old: {v: n for v, n in values.items() if v not in rows} for old, values in table["parts"].items()}
    parts = {old: values for old, values in kept.items() if values} | ({folder: rows} if rows else {})
    _commit(spark, path, number + 1, table | {"parts": parts})
    return sum(rows.values())


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """The table as the newest commit names it. Filters on the partition column prune folders."""
    number, table = _newest(spark, path)
    if not number:
        raise FileNotFoundError(f"{path} holds no committed table")
    schema, partition = StructType.fromJson(json.loads(table["schema"])), table["partition"]
    parts = []
    for folder, values in table["parts"].items():
        part = spark.read.schema(schema).parquet(f"{path}/{folder}").select(*schema.names)
        if partition is not None:
            kept = F.col(partition).cast("string").isin([v for v in values if v != NULL])
            part = part.where(kept | F.col(partition).isNull() if NULL in values else kept)
        parts.append(part)
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], schema)


def table_rows(spark: SparkSession, path: str) -> int:
    """Rows of the table by its commit, without reading it."""
    parts = _newest(spark, path)[1]["parts"].values()
    return sum(sum(p.values()) if isinstance(p, dict) else p for p in parts)


def expire_versions(spark: SparkSession, path: str) -> list[str]:
    """Delete version folders that the newest commit does not name; for a time when nobody reads or writes."""
    used = set(_newest(spark, path)[1]["parts"])
    jvm, files = _files(spark, path)
    gone = [name for name in _names(spark, path) if name.startswith("v-") and name not in used]
    for name in gone:
        files.delete(jvm.org.apache.hadoop.fs.Path(f"{path}/{name}"), True)
    return gone
