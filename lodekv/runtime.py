"""Session plumbing shared by every operator: shared folders, materialised tables, worker imports."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_PACKAGE_ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's Parquet tables, by Spark's reader only (the path may be any Hadoop URI)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def workers_can_import(spark: SparkSession) -> None:
    """Python workers resolve functions of this package by module path; make its root known to them.

    On a cluster the package is shipped with ``--py-files``; the entry only matters where driver and
    workers share an installation that is not on ``PYTHONPATH``.
    """
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if _PACKAGE_ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([_PACKAGE_ROOT, *paths])


def shared_root(spark: SparkSession) -> str:
    """The folder every executor sees: ``spark.checkpoint.dir``, or a fresh one where that is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="lodekv-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def shared_path(spark: SparkSession, label: str) -> str:
    """A new, unused path below the shared folder."""
    path = f"{shared_root(spark)}/lodekv-{label}-{uuid.uuid4().hex}"
    for made in _scopes:
        made.append(path)
    return path


_scopes: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[list[DataFrame]]:
    """Deletes on leaving what was written to the shared folder inside, but for the tables put into the list it gives.

    Lazy results that were made inside and still read such files must be materialised and kept. Without a scope
    the files belong to whoever owns the shared folder, for the life of the session's results.
    """
    made: list[str] = []
    kept: list[DataFrame] = []
    _scopes.append(made)
    try:
        yield kept
    finally:
        _scopes.remove(made)
        spared = {getattr(df, "_lodekv_path", None) for df in kept}
        for path in made:
            if path not in spared:
                delete(spark, path)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage is cut by files that outlive executors."""
    spark = df.sparkSession
    path = shared_path(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._lodekv_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete the files behind a DataFrame made by :func:`materialize`."""
    path = getattr(df, "_lodekv_path", None)
    if path:
        delete(df.sparkSession, path)


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


#: A key with at least this share of all rows counts as hot; so there are at most this many hot keys.
HOT_SHARE = 1000


def join_unique(left: DataFrame, right: DataFrame, key: str, count_col: str, total: int) -> DataFrame:
    """Left join of a ``right`` table with one row per ``key``, safe against hot keys of ``left``.

    ``count_col`` of ``right`` says how many of the ``total`` rows of ``left`` have the key. Keys with a
    thousandth of the rows or more number a thousand at most: that proven bound lets them be broadcast, and the
    rest is joined by shuffle, where no key has more than a thousandth. ``count_col`` is dropped.
    """
    from pyspark.sql import functions as F

    hot = F.broadcast(right.where(F.col(count_col) * HOT_SHARE >= total).drop(count_col))
    cold = right.where(F.col(count_col) * HOT_SHARE < total).drop(count_col)
    return left.join(hot, key).unionByName(left.join(hot, key, "left_anti").join(cold, key, "left"))
