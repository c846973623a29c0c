"""Sinks (K1-K9): JSON lines, one JSON object, CSV with list cells, id lists, checkpoints, manifests.

Total order is made at the sink only.  Committers write to a temporary place and rename, so readers never see half a
table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.validate import content_hash


def _in_order(df: DataFrame, order: list[str], files: int | None) -> DataFrame:
    """Rows in order over files in order: as many as the session's partitions, or ``files`` (one for a small report)."""
    n = files or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartitionByRange(n, *order).sortWithinPartitions(*order)


def write_json_lines(df: DataFrame, path: str, order: list[str], files: int | None = None) -> None:
    """K1: fields by name, rows in order; the files' names are in order too."""
    out = _in_order(df.select(*sorted(df.columns)), order, files)
    out.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_json_object(df: DataFrame, path: str) -> None:
    """K2: a one-row table as one indented object."""
    df.limit(1).select(F.to_json(F.struct("*"), {"pretty": "true", "ignoreNullFields": "false"}).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def write_csv(df: DataFrame, path: str, fields: list[str], order: list[str] | None = None, files: int | None = None) -> None:
    """The named fields in order; arrays, maps and structs become JSON cells; every file has the header."""
    kinds = dict(df.dtypes)
    cells = [F.to_json(F.col(f)).alias(f) if kinds[f].startswith(("array", "map", "struct")) else F.col(f) for f in fields]
    out = (_in_order(df, order, files) if order else df).select(*cells)
    out.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_id_list(df: DataFrame, path: str, column: str, files: int | None = None) -> None:
    """K5: one id per line, sorted over the files in order."""
    ids = df.select(F.col(column).cast("string").alias("value")).where("value is not null")
    _in_order(ids, ["value"], files).write.mode("overwrite").text(path)


def append_checkpoint(df: DataFrame, path: str) -> None:
    """K6/K7: append to a log of results; the committer makes the append atomic."""
    df.write.mode("append").parquet(path)


def append_missing(df: DataFrame, path: str, key: str) -> int:
    """K9: append the rows whose key the cache does not hold yet; how many there were."""
    spark = df.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    new = df
    if p.getFileSystem(conf).exists(p):
        known = spark.read.parquet(path).select(key)
        new = df.join(known, key, "left_anti")
    n = new.count()
    if n:
        append_checkpoint(new, path)
    return n


def manifest(tables: dict[str, DataFrame]) -> DataFrame:
    """(table, n_rows, content_hash), independent of files and row order."""
    out = None
    for name, df in sorted(tables.items()):
        row = content_hash(df).select(F.lit(name).alias("table"), "n_rows", "content_hash")
        out = row if out is None else out.unionByName(row)
    return out
