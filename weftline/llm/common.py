"""Shared helpers: the folder all executors see, stored tables, base expressions."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run without ASCII white space.
WORD = "[^\\x20\\x09-\\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where a session names none, a local master (tests on one machine) gets a
    temporary folder, removed when the process ends; on any other master that
    folder would be each machine's own, so it is an error.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("weftline.shared.dir", None)
    if not named:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="weftline-")
        atexit.register(shutil.rmtree, named, ignore_errors=True)
        spark.conf.set("weftline.shared.dir", named)
    return named


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder, in a folder for each value of ``by``, and read it back.

    Cuts the lineage and survives lost executors, unlike a cache. The reread
    table has true file sizes, so the planner's own size check decides whether
    a join may broadcast it. What ``forget`` does not delete before goes when the
    driver ends: a lazy result may read it until then.
    """
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path, partitionBy=by)
    file_system(df.sparkSession, path).deleteOnExit(df.sparkSession._jvm.org.apache.hadoop.fs.Path(path))
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._weftline_path = path
    return out


def file_system(spark: SparkSession, path: str):
    """The Hadoop file system that a path lies in."""
    return spark._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def children(spark: SparkSession, path: str, holding: str) -> list[str]:
    """Names of the folders under a path, in any file system, that hold a file of that name."""
    jvm = spark._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    fs = file_system(spark, path)
    if not fs.exists(place):
        return []
    return [s.getPath().getName() for s in fs.listStatus(place) if fs.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), holding))]


def forget(*tables: DataFrame) -> None:
    """Delete tables made by ``stored`` that nothing still to be computed reads."""
    for df in tables:
        path = getattr(df, "_weftline_path", None)
        if path:
            file_system(df.sparkSession, path).delete(df.sparkSession._jvm.org.apache.hadoop.fs.Path(path), True)


def text_or_empty(text: Column | str = "text") -> Column:
    """Null texts count as empty ones."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def row_of(df: DataFrame) -> Column:
    """The whole row as one column ``_row``, so that working columns beside it clash with none of its own."""
    return F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("_row")


def rows_again(df: DataFrame, like: DataFrame, **changed: Column) -> DataFrame:
    """The rows kept in ``_row``, with the columns of ``like`` and those that changed."""
    return df.select(*(changed[c].alias(c) if c in changed else F.col(f"_row.`{c}`").alias(c) for c in like.columns))


def small_batches(df: DataFrame, rows: int = 1000) -> DataFrame:
    """``df``, after seeing to it that the session sends Python at most ``rows`` rows at a time.

    Texts are long; Spark's usual 10,000 of them would fill a worker.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    conf = df.sparkSession.conf
    if not 0 < int(conf.get(name)) <= rows:
        conf.set(name, str(rows))
    return df
