"""Tables of rows by key in Parquet folders partitioned by batch, and the run lock.

A change is a batch: it writes one partition by Spark's dynamic partition
overwrite, so running a batch again replaces what it wrote and costs what the
batch holds, not what the table does. Readers take each key's rows of its latest
batch. File operations go through the cluster's own file system.
"""

from __future__ import annotations

import json
import threading
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _put(spark: SparkSession, path: str, text: str, overwrite: bool) -> bool:
    """Write a small file; False if it is there and may not be replaced."""
    fs, p = _fs(spark, path)
    try:
        out = fs.create(p, overwrite)
    except Exception as e:
        if not overwrite and fs.exists(p):
            return False
        raise e
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    return True


def _get(spark: SparkSession, path: str) -> str | None:
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path that driver and executors share, gone when the driver ends: in ``spark.checkpoint.dir``, else the warehouse."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.sql.warehouse.dir")
    path = f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    fs, p = _fs(spark, path)
    fs.mkdirs(p)
    fs.deleteOnExit(p)  # of a path that is there
    return path


class BatchTable:
    """Rows by key: the rows of the latest batch that touched a key hold.

    A key may have one row or many; one that a batch touches without rows is
    gone from then on. Batches are numbered by their writer, upwards.
    """

    def __init__(self, spark: SparkSession, root: str, name: str, key: str = "id"):
        self.spark, self.path, self.key = spark, f"{root.rstrip('/')}/{name}", key

    def batches(self) -> list[int]:
        """The batches that are there, oldest first."""
        fs, p = _fs(self.spark, self.path)
        names = [s.getPath().getName() for s in fs.listStatus(p)] if fs.exists(p) else []
        return sorted(int(n.removeprefix("_batch=")) for n in names if n.startswith("_batch="))

    def rows(self, upto: int | None = None) -> DataFrame | None:
        """All rows of all batches, or of those up to one, with ``_batch`` and ``_gone``."""
        there = [b for b in self.batches() if upto is None or b <= upto]
        if not there:
            return None
        read = self.spark.read.option("basePath", self.path).option("mergeSchema", "true")
        df = read.parquet(*(f"{self.path}/_batch={b}" for b in there))
        return df.withColumn("_batch", F.col("_batch").cast("long"))

    def read(self, upto: int | None = None) -> DataFrame | None:
        """The rows that hold, as of a batch if given.

        Keys alone are summed by batch; the rows then meet their key's latest
        one. A table of one batch is read as it is.
        """
        df = self.rows(upto)
        if df is None:
            return None
        if len([b for b in self.batches() if upto is None or b <= upto]) > 1:
            latest = df.groupBy(self.key).agg(F.max("_batch").alias("_batch"))
            df = df.join(latest, [self.key, "_batch"])
        return df.where(~F.col("_gone")).drop("_batch", "_gone")

    def put(self, rows: DataFrame, batch: int, touched: DataFrame | None = None) -> None:
        """Write a batch, in place of what it wrote before: its rows, and the keys of ``touched`` that lose theirs."""
        out = rows.withColumn("_gone", F.lit(False))
        if touched is not None:
            gone = touched.select(self.key).distinct().join(rows.select(self.key).distinct(), self.key, "left_anti")
            out = out.unionByName(gone.withColumn("_gone", F.lit(True)), allowMissingColumns=True)
        # a large batch becomes many files, a small one few
        out = out.withColumn("_batch", F.lit(batch).cast("long")).hint("rebalance")
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_batch").parquet(self.path)

    def compact(self, upto: int) -> list[int]:
        """Rows that hold as of a batch become that batch; the older ones go. The numbers of those."""
        older = [b for b in self.batches() if b < upto]
        if older and upto in self.batches():
            self.put(self.read(upto), upto)
            for b in older:
                fs, p = _fs(self.spark, f"{self.path}/_batch={b}")
                fs.delete(p, True)
        return older


def upserted(stored: DataFrame | None, changes: DataFrame, key: str = "id") -> DataFrame:
    """Stored rows with those of ``changes`` in place of, or beside, them."""
    if stored is None:
        return changes
    return stored.join(changes.select(key), key, "left_anti").unionByName(changes, allowMissingColumns=True)


def replaced_chunks(stored: DataFrame | None, touched: DataFrame, chunks: DataFrame) -> DataFrame:
    """Chunks without those of touched documents (column id), and with the new ones."""
    new = chunks.withColumn("content_hash", F.sha2(F.encode("content", "UTF-8"), 256))
    if stored is None:
        return new
    kept = stored.join(touched.select(F.col("id").alias("document_id")), "document_id", "left_anti")
    return kept.unionByName(new, allowMissingColumns=True)


def cascaded(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """Chunks whose document is still there."""
    return chunks.join(documents.select(F.col("id").alias("document_id")), "document_id", "left_semi")


def with_embeddings(chunks: DataFrame, embeddings: DataFrame) -> DataFrame:
    """Arrays zipped by position; raises while running where their lengths differ.

    ``chunks``: document_id, chunks; ``embeddings``: document_id, vectors.
    """
    both = chunks.join(embeddings, "document_id", "left")
    same = F.size("chunks") == F.coalesce(F.size("vectors"), F.lit(0))
    zipped = F.when(same, F.arrays_zip("chunks", "vectors")).otherwise(F.raise_error(F.lit("as many embeddings as chunks are needed")))
    return both.select("document_id", F.posexplode(zipped).alias("chunk_index", "z")).select("document_id", "chunk_index", F.col("z.chunks").alias("content"), F.col("z.vectors").alias("embedding"))


class Lease:
    """A held lock: ``token`` grows from holder to holder, ``check`` raises once another has it."""

    def __init__(self, spark: SparkSession, path: str, seconds: float, token: int):
        self.spark, self.path, self.seconds, self.token = spark, path, seconds, token
        self.owner = uuid.uuid4().hex

    def text(self) -> str:
        return json.dumps({"owner": self.owner, "token": self.token, "expires": time.time() + self.seconds})

    def mine(self) -> bool:
        held = _lock(self.spark, self.path)
        return held is not None and held["owner"] == self.owner

    def check(self) -> None:
        if not self.mine():
            raise RuntimeError("another run holds the lock")

    def renew(self) -> None:
        """Put the end of the lease off; raises if another run has taken it."""
        self.check()
        aside = f"{self.path}-{self.owner}"
        _put(self.spark, aside, self.text(), overwrite=True)
        _renamed(self.spark, aside, self.path, overwrite=True)


def _lock(spark: SparkSession, path: str, seconds: float = 120.0) -> dict | None:
    """What a lock file says; one that is half written runs out so long after it was."""
    try:
        text = _get(spark, path)
        if text is None:
            return None
        held = json.loads(text)
        return {"owner": held["owner"], "token": int(held["token"]), "expires": float(held["expires"])}
    except (ValueError, KeyError, TypeError):
        fs, p = _fs(spark, path)
        return {"owner": None, "token": 0, "expires": fs.getFileStatus(p).getModificationTime() / 1000 + seconds} if fs.exists(p) else None


def _renamed(spark: SparkSession, path: str, to: str, overwrite: bool) -> bool:
    """Whether a file could be renamed."""
    jvm = spark.sparkContext._jvm
    fs, p = _fs(spark, path)
    try:
        full = fs.makeQualified(p)
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(full.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
        options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE if overwrite else jvm.org.apache.hadoop.fs.Options.Rename.NONE
        context.rename(full, fs.makeQualified(jvm.org.apache.hadoop.fs.Path(to)), options)
        return True
    except Exception:
        if fs.exists(p):
            raise
        return False


def _acquired(spark: SparkSession, path: str, seconds: float) -> Lease | None:
    for _ in range(2):
        held = _lock(spark, path, seconds)
        lease = Lease(spark, path, seconds, max(time.time_ns(), (held or {"token": 0})["token"] + 1))
        if held is None:
            if _put(spark, path, lease.text(), overwrite=False):
                return lease
        elif held["expires"] < time.time():
            # of several runs that find it so, one can rename it
            aside = f"{path}-{lease.owner}"
            if _renamed(spark, path, aside, overwrite=False):
                fs, p = _fs(spark, aside)
                fs.delete(p, False)
        else:
            return None
    return lease if lease.mine() else None


@contextmanager
def run_lock(spark: SparkSession, root: str, lease: float = 120.0) -> Iterator[Lease | None]:
    """The collection's lock, None if another run holds it.

    It is a lease of so many seconds that a thread renews while the run lives: a
    run that died leaves a lock that the next one takes over. A run that was cut
    off for longer finds out by ``check``, before it commits. Needs a file system
    that creates and renames files at once, such as HDFS or a local one; object
    stores do not.
    """
    held = _acquired(spark, f"{root.rstrip('/')}/LOCK", lease)
    ended = threading.Event()

    def beat() -> None:
        while not ended.wait(lease / 3):
            try:
                held.renew()
            except Exception:  # lost, or the session is gone: check() tells the run
                return

    if held:
        threading.Thread(target=beat, daemon=True).start()
    try:
        yield held
    finally:
        ended.set()
        if held and held.mine():
            fs, p = _fs(spark, held.path)
            fs.delete(p, False)
