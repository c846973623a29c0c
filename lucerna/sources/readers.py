"""Sources (S1-S6, S8-S10): nested JSON, JSON lines, CSV, id lists, vectors, checksummed files, key-value checkpoints."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.jobs import last_written

QUESTION = T.StructType(
    [T.StructField(n, T.StringType()) for n in ("id", "body", "type")]
    + [
        T.StructField("documents", T.ArrayType(T.StringType())),
        T.StructField("snippets", T.ArrayType(T.StructType([T.StructField("text", T.StringType()), T.StructField("document", T.StringType())]))),
        T.StructField("exact_answer", T.VariantType()),
        T.StructField("ideal_answer", T.VariantType()),
    ]
)


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """Whole-file JSON ``{"questions": [...]}``; polymorphic answers stay VARIANT.  Non-objects are dropped."""
    doc = T.StructType([T.StructField("questions", T.ArrayType(QUESTION))])
    q = spark.read.schema(doc).json(path, multiLine=True).select(F.posexplode("questions").alias("ordinal", "q")).where("q is not null")
    return q.select("ordinal", "q.*").withColumn("type", F.lower(F.trim(F.coalesce("type", F.lit("missing")))))


def answer_shape(answer):
    """String, list, list of lists, or missing."""
    kind = F.schema_of_variant(answer)
    return F.when(answer.isNull() | (kind == "VOID"), "missing").when(kind.startswith("ARRAY<ARRAY"), "list_of_lists").when(kind.startswith("ARRAY"), "list").when(kind == "STRING", "string").otherwise("other")


def read_json_lines(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """One object per line, blank lines skipped; a line that is no such object comes back with ``_corrupt_record``."""
    s = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    full = T.StructType([*s.fields, T.StructField("_corrupt_record", T.StringType())])
    return spark.read.schema(full).option("mode", "PERMISSIVE").json(path)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """S3: header, all text, quoted cells with line breaks, a byte-order mark in front of the first name dropped."""
    df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return df.toDF(*[c.lstrip("﻿") for c in df.columns])


def read_id_list(spark: SparkSession, path: str, name: str = "id") -> DataFrame:
    """One id per line, blanks at the ends and blank lines dropped."""
    return spark.read.text(path).select(F.trim(F.regexp_replace("value", "﻿|\r", "")).alias(name)).where(F.length(name) > 0)


def read_vectors(spark: SparkSession, path: str, key: str, vector: str = "embedding") -> DataFrame:
    """Vectors by key, no positional alignment."""
    return spark.read.parquet(path).select(key, F.col(vector).cast("array<float>").alias(vector))


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """md5 and SHA-256 of files, to hold against published sums."""
    b = spark.read.format("binaryFile").load(path)
    return b.select(F.regexp_extract("path", "[^/]+$", 0).alias("file"), "length", F.md5("content").alias("md5"), F.sha2("content", 256).alias("sha256"))


def find_file(spark: SparkSession, candidates: list[str], root: str | None = None, name: str | None = None) -> str:
    """The first candidate that exists, else the only file of that name below ``root``; none or several is an error."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for c in candidates:
        p = jvm.org.apache.hadoop.fs.Path(c)
        if p.getFileSystem(conf).exists(p):
            return c
    found = []
    if root and name:
        p = jvm.org.apache.hadoop.fs.Path(root)
        it = p.getFileSystem(conf).listFiles(p, True)
        while it.hasNext():
            f = it.next().getPath()
            if f.getName() == name:
                found.append(f.toString())
    if len(found) != 1:
        raise FileNotFoundError(f"{name or candidates}: {len(found)} files found")
    return found[0]


def read_checkpoint(spark: SparkSession, path: str, key: str, order: list[str], valid=None) -> DataFrame:
    """The latest valid record per key of an append-only log; a log that is not there is an empty one."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(conf).exists(p):
        return spark.createDataFrame([], f"{key} string")
    log = spark.read.option("mergeSchema", True).parquet(path)
    latest = last_written(log, key, order)
    return latest.where(valid) if valid is not None else latest


def fetch(spark: SparkSession, source: str, target: str, md5: str | None = None) -> str:
    """Copy a file through ``target.part`` and a rename, so that readers never see half of it; the place it ended at.

    A file that is there already with the right sum stays.  One whose sum differs from ``md5`` is moved beside the
    target as ``.quarantine`` and an error is raised.  Any file system Hadoop knows will do; the content is hashed in
    a task, not on the driver.
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path
    dst, part, bad = path(target), path(f"{target}.part"), path(f"{target}.quarantine")
    fs = dst.getFileSystem(conf)

    def good(where: str) -> bool:
        return md5 is None or checksums(spark, where).first()["md5"] == md5.lower()

    if fs.exists(dst) and good(target):
        return target
    src = path(source)
    jvm.org.apache.hadoop.fs.FileUtil.copy(src.getFileSystem(conf), src, fs, part, False, True, conf)
    if not good(f"{target}.part"):
        fs.delete(bad, True)
        fs.rename(part, bad)
        raise ValueError(f"{source}: the checksum is not the published one")
    fs.delete(dst, True)
    fs.rename(part, dst)
    return target
