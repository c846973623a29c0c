"""Cutting lineage in the shared folder of the cluster.

Iterative operators write their intermediate tables as parquet under
``spark.checkpoint.dir`` (visible to every executor, so losing one loses nothing) and read
them back.  That folder is taken from the session; a cluster without one is refused.  A local session
without one gets a folder of its own, or the one its caller names in ``build_session``.

A table must live as long as a result that reads it, so nothing is removed behind the caller's back: ``sweep`` between
the steps of a long session, or ``with Workspace(...)``, removes what is done with; the rest goes when Python ends.
The folders of a session bear its application id, so ``sweep_dead`` can remove what a killed driver left.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_open: list["Workspace"] = []
PREFIX = "lucerna-"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share; raises on a cluster that names none."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = tempfile.mkdtemp(prefix=PREFIX)
    spark.sparkContext.setCheckpointDir(own)
    return spark.sparkContext.getCheckpointDir()


def _session_dir(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/{PREFIX}{spark.sparkContext.applicationId}"


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


class Workspace:
    """A folder for the intermediate tables of one operator call."""

    def __init__(self, spark: SparkSession, tag: str):
        self.spark = spark
        self.path = f"{_session_dir(spark)}/{tag}-{uuid.uuid4().hex[:12]}"
        _open.append(self)

    def __enter__(self) -> "Workspace":
        return self

    def __exit__(self, *_) -> None:
        self.drop()
        if self in _open:
            _open.remove(self)

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` and return the table read back: no lineage, exact size statistics."""
        where = f"{self.path}/{name}"
        df.write.mode("overwrite").parquet(where)
        return self.spark.read.schema(df.schema).parquet(where)

    def route(self, df: DataFrame, name: str, by: list[str]) -> DataFrame:
        """As ``keep``, in a folder for each value of the columns ``by``, which come last; a filter on them reads one folder."""
        where = f"{self.path}/{name}"
        df.write.mode("overwrite").partitionBy(*by).parquet(where)
        return self.spark.read.schema(df.select(*[c for c in df.columns if c not in by], *by).schema).parquet(where)

    def drop(self, name: str = "") -> None:
        _delete(self.spark, f"{self.path}/{name}" if name else self.path)


def sweep(spark: SparkSession) -> int:
    """Remove the tables of all workspaces made so far; results that still read them must be done.  How many there were."""
    mine = [w for w in _open if w.spark.sparkContext is spark.sparkContext]
    for w in mine:
        w.__exit__()
    return len(mine)


def sweep_dead(spark: SparkSession, applications: set[str]) -> None:
    """Remove the folders of sessions that are known to be gone, by their application ids."""
    for a in applications - {spark.sparkContext.applicationId}:
        _delete(spark, f"{shared_dir(spark)}/{PREFIX}{a}")


@atexit.register
def _at_exit() -> None:
    roots = {}
    for w in list(_open):
        try:
            if w.spark.sparkContext._jsc is not None:
                w.__exit__()
                roots[_session_dir(w.spark)] = w.spark
        except Exception:  # the session may be gone already
            return
    for path, spark in roots.items():
        _delete(spark, path)
