"""The folder all executors share, and small atomic files in it.

Everything goes through the Hadoop file system API, so the folder may lie on a
local disk in tests and on a distributed store on a cluster.
"""

from __future__ import annotations

import tempfile
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; where that is unset, a fresh one, if there is one machine only (tests)."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir is not set: it must name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="tidelog-")
        spark.conf.set("spark.checkpoint.dir", root)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


_made: list[str] = []


def fresh_dir(spark: SparkSession, purpose: str) -> str:
    """A new scratch folder in the shared one; ``cleanup`` deletes it. State that must last belongs under a path of its own."""
    _made.append(f"{shared_root(spark)}/tidelog/{purpose}-{uuid.uuid4().hex}")
    return _made[-1]


def cleanup(spark: SparkSession) -> int:
    """Delete all scratch that this process put into the shared folder; DataFrames made from it are void then."""
    for path in _made:
        delete(spark, path)
    n = len(_made)
    _made.clear()
    return n


def materialize(df: DataFrame, purpose: str) -> DataFrame:
    """Cut the lineage with a table written in the shared folder; reading it back keeps column pruning."""
    spark = df.sparkSession
    path = fresh_dir(spark, purpose)
    df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._tidelog_place = path
    return table


def place_of(table: DataFrame) -> str:
    """Where ``materialize`` put a table."""
    return table._tidelog_place


def discard(*tables: DataFrame) -> None:
    """Delete materialized tables that nobody reads any more."""
    for df in tables:
        delete(df.sparkSession, place_of(df))


def _fs(spark: SparkSession, path: str):
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark._jsc.hadoopConfiguration()), jpath


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def is_file(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p) and fs.getFileStatus(p).isFile()


def delete(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def children(spark: SparkSession, path: str) -> list[str]:
    fs, p = _fs(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def read_text(spark: SparkSession, path: str) -> str | None:
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return bytes(stream.readAllBytes()).decode("utf-8")
    finally:
        stream.close()


def put_text(spark: SparkSession, path: str, text: str) -> bool:
    """Make a small file whole and only if there is none yet: of several that try, one gets True.

    On file systems by a link or rename that fails where the name exists; object stores
    without a conditional put can't give this promise, so keep state elsewhere there.
    """
    jvm = spark._jvm
    fs, p = _fs(spark, path)
    tmp = jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.tmp")
    out = fs.create(tmp, True)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()
    try:
        if fs.getUri().getScheme() == "file":
            local = lambda x: jvm.java.io.File(x.toUri().getPath()).toPath()
            jvm.java.nio.file.Files.createLink(local(p), local(tmp))
        else:
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(p.toUri(), spark._jsc.hadoopConfiguration()).rename(tmp, p, spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0))
    except Py4JJavaError as e:
        if "AlreadyExists" in e.java_exception.getClass().getName():
            return False
        raise
    finally:
        fs.delete(tmp, False)
    return True


def swap_text(spark: SparkSession, path: str, text: str) -> None:
    """Replace a small file in one atomic step: readers see the old text or the new one."""
    jvm = spark._jvm
    fs, p = _fs(spark, path)
    tmp = jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.tmp")
    out = fs.create(tmp, True)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(p.toUri(), spark._jsc.hadoopConfiguration()) if p.toUri().getScheme() else jvm.org.apache.hadoop.fs.FileContext.getFileContext(spark._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(tmp, p, options)
