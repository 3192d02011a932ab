"""Shared folders, written intermediate tables and code shipping."""

from __future__ import annotations

import atexit
import contextlib
import os
import re
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = Path(__file__).resolve().parent.parent
_own: dict[str, str] = {}
_shipped: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that
    is unset, a temporary one on a single machine (tests), and an error on a
    cluster, whose executors would each write to their own disk."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    app = spark.sparkContext.applicationId
    if app not in _own:
        _own[app] = tempfile.mkdtemp(prefix="quire-")
        atexit.register(shutil.rmtree, _own[app], True)
    return f"file://{_own[app]}"


def _folder(spark: SparkSession, path: str):
    """Hadoop's file system and path of the folder that new_path made for a path."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path).getParent()
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()), folder


#: Paths made since each `scratch` that is open began.
_scratch: list[list[str]] = []


def new_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder. What is written there goes with the application,
    or earlier by release() or scratch()."""
    path = f"{shared_dir(spark)}/quire-{uuid.uuid4().hex}/{label}"
    fs, folder = _folder(spark, path)
    fs.deleteOnExit(folder)
    if _scratch:
        _scratch[-1].append(path)
    return path


@contextlib.contextmanager
def scratch(spark: SparkSession):
    """Tables materialized inside are deleted at its end, but for those that are
    passed to the function that it gives."""
    kept: set[str] = set()
    _scratch.append([])

    def keep(df: DataFrame) -> DataFrame:
        kept.add(df.quire_path)
        return df

    try:
        yield keep
    finally:
        made = _scratch.pop()
        for path in made:
            if path in kept:
                if _scratch:
                    _scratch[-1].append(path)
            else:
                _delete(spark, path)


def _delete(spark: SparkSession, path: str) -> None:
    fs, folder = _folder(spark, path)
    fs.delete(folder, True)


def materialize(df: DataFrame, label: str, even: bool = False) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back. This cuts the
    lineage and, unlike a local checkpoint, survives the loss of executors. even:
    a narrow table made from wide rows is dealt anew first, into files of the size
    that adaptive execution aims at instead of one small file a task."""
    spark = df.sparkSession
    path = new_path(spark, label)
    (df.hint("rebalance") if even else df).write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.quire_path = path
    return out


def materialize_sorted(df: DataFrame, label: str, key: str, buckets: int) -> DataFrame:
    """Like materialize, in buckets by key, each sorted by it: tables with the same
    number of buckets are joined by key without an exchange. df is dealt by key
    unless it is so already. Only the path is kept; the catalog is left as it was."""
    spark = df.sparkSession
    path, name = new_path(spark, label), f"quire_{uuid.uuid4().hex}"
    df.write.bucketBy(buckets, key).sortBy(key).option("path", path).format("parquet").saveAsTable(name)
    out = spark.table(name)
    spark.sql(f"drop table {name}")
    out.quire_path = path
    return out


def release(df: DataFrame) -> None:
    """Delete the files behind a materialized table that nothing reads any more."""
    path = getattr(df, "quire_path", None)
    if path:
        _delete(df.sparkSession, path)


#: Bytes of a batch that Python gets, where the session has no value of its own: a batch is held
#: several times (as it came, as objects, as what is made of them) by each of a task's workers.
BATCHES = {"spark.sql.execution.arrow.maxBytesPerBatch": (None, "4194304b")}


def with_settings(df: DataFrame, settings: dict[str, tuple[str | None, str]]) -> DataFrame:
    """df in a session of its own, a clone of its session in which the settings (name:
    Spark's own value, None for unset, other value) have the other value where they have Spark's.
    The session that df came from stays as it is. df itself if nothing changes or it
    isn't run by this process (a remote session)."""
    spark = df.sparkSession
    new = {k: other for k, (own, other) in settings.items() if spark.conf.get(k, None) == own}
    if not new or not hasattr(spark, "_jsparkSession"):
        return df
    clone = type(spark)(spark.sparkContext, spark._jsparkSession.cloneSession())
    for k, v in new.items():
        clone.conf.set(k, v)
    plan = df._jdf.queryExecution().analyzed()
    return DataFrame(spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(clone._jsparkSession, plan), clone)


def ship(spark: SparkSession) -> None:
    """Make this package importable on executors that don't have it on their path."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    _shipped.add(sc.applicationId)
    on_path = {os.path.abspath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p} | {os.getcwd()}
    if str(ROOT) in on_path:
        return
    target = Path(tempfile.mkdtemp(prefix="quire-zip-")) / "quire_pkg.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted((ROOT / "quire").rglob("*.py")):
            z.write(p, p.relative_to(ROOT))
    sc.addPyFile(str(target))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
