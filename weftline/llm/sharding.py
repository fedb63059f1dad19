"""Sharding by fixed virtual slots.

Every record hashes into one of ``SLOTS`` virtual slots, for good. Bytes are
summed per slot, and a small versioned table maps all slots, empty ones too, to
shards. Balancing edits that map: slots move, records never rehash. Each version
is a table of its own under the map's folder, which later runs load and go on
from. All of it is DataFrame expressions; what the balancing looks at is the
slot histogram, at most ``SLOTS`` rows whatever the input.

Law kept: ``bytes``. Each shard's sum of sizes comes as near the mean as its
smallest slots allow. Rows that are equal in id and text are counted first and
hash in runs of ``RUN``, so that a row repeated without end spreads over the
slots like different rows do. Equal texts with different ids are records of
their own: they hash apart, since a text that a third of all rows share could
not stay together under this law.

Defined results: a null text has size 16 and CRC 0; a null doc_id hashes like a
value of its own together with the text's CRC; repeated rows get a position
each; an empty table gives an empty result, and a map; columns other than doc_id
and text are not looked at.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import children, forget, shared_path, stored, text_or_empty

#: Number of virtual slots, fixed over the life of a data set.
SLOTS = 4096
#: Bytes that a record costs besides its text.
OVERHEAD = 16
#: Equal rows that hash together.
RUN = 16


def slotted(docs: DataFrame, slots: int = SLOTS) -> DataFrame:
    """doc_id, size, text_crc32, run, copies and virtual_slot: a row for each run of equal records."""
    raw = text_or_empty().cast("binary")
    rows = docs.select("doc_id", (F.octet_length(raw) + F.lit(OVERHEAD)).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"))
    # summed before anything moves, so a row repeated without end is a few rows here
    counted = rows.groupBy("doc_id", "size", "text_crc32").agg(F.count(F.lit(1)).alias("n"))
    runs = counted.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n - 1) div {RUN}"))).alias("run"))
    copies = F.least(F.lit(RUN).cast("long"), F.col("n") - F.col("run") * RUN)
    return runs.select("doc_id", "size", "text_crc32", "run", copies.alias("copies"), F.pmod(F.xxhash64("doc_id", "text_crc32", "run"), F.lit(slots)).cast("int").alias("virtual_slot"))


def histogram(records: DataFrame) -> DataFrame:
    """Bytes and rows of each virtual slot that has any: at most SLOTS rows."""
    return records.groupBy("virtual_slot").agg(F.sum(F.col("size") * F.col("copies")).alias("bytes"), F.sum("copies").alias("n"))


def first_map(spark: SparkSession, shards: int, slots: int = SLOTS) -> DataFrame:
    """Version 0: all slots dealt round robin, before any bytes are known."""
    slot = F.col("id").cast("int")
    return spark.range(slots, numPartitions=1).select(slot.alias("virtual_slot"), F.pmod(slot, F.lit(shards)).cast("int").alias("shard"), F.lit(None).cast("int").alias("moved_from"))


def rebalance(slot_map: DataFrame, hist: DataFrame, shards: int) -> DataFrame:
    """The map's next version. Only overfull shards, and shards that are no more, give slots away.

    A shard keeps its slots, largest first, while they fit under the mean; what
    does not fit goes, largest first, each to the shard with the least bytes.
    Both steps see at most SLOTS rows. ``moved_from`` names the edit, null for
    slots that stay.
    """
    sized = slot_map.select("virtual_slot", "shard").join(hist, "virtual_slot", "left").withColumn("bytes", F.coalesce("bytes", F.lit(0).cast("long")))
    by_size = Window.partitionBy("shard").orderBy(F.desc("bytes"), "virtual_slot")
    mean = F.sum("bytes").over(Window.partitionBy()) / F.lit(float(shards))
    ranked = sized.withColumn("stays", (F.sum("bytes").over(by_size) <= mean) & (F.col("shard") < shards))
    spare = F.sort_array(F.filter(F.collect_list(F.when(~F.col("stays"), F.struct((-F.col("bytes")).alias("b"), "virtual_slot", "shard"))), lambda x: x.isNotNull()))
    kept = F.filter(F.collect_list(F.when(F.col("stays"), F.struct("virtual_slot", "shard", "bytes"))), lambda x: x.isNotNull())
    one = ranked.agg(kept.alias("kept"), spare.alias("spare"))

    loads = F.transform(
        F.sequence(F.lit(0), F.lit(shards - 1)),
        lambda s: F.aggregate(F.filter("kept", lambda k: k["shard"] == s), F.lit(0).cast("long"), lambda a, k: a + k["bytes"]),
    )

    def least(a):
        return F.array_min(F.transform(a["loads"], lambda x, i: F.struct(x.alias("x"), i.alias("i"))))["i"]

    def place(a, slot):
        to = least(a)
        return F.struct(
            F.transform(a["loads"], lambda x, i: F.when(i == to, x - slot["b"]).otherwise(x)).alias("loads"),
            F.concat(a["out"], F.array(F.struct(slot["virtual_slot"].alias("virtual_slot"), to.alias("shard"), slot["shard"].alias("moved_from")))).alias("out"),
        )

    start = F.struct(loads.alias("loads"), F.expr("cast(array() as array<struct<virtual_slot:int,shard:int,moved_from:int>>)").alias("out"))
    moved = F.aggregate("spare", start, place)["out"]
    stay = F.transform("kept", lambda k: F.struct(k["virtual_slot"].alias("virtual_slot"), k["shard"].alias("shard"), F.lit(None).cast("int").alias("moved_from")))
    return one.select(F.explode(F.concat(stay, moved)).alias("m")).select("m.*")


MAP = "virtual_slot int, shard int, moved_from int"


def versions(spark: SparkSession, path: str) -> list[int]:
    """The versions that a map's folder has whole."""
    return sorted(int(name[8:]) for name in children(spark, path, "_SUCCESS") if name.startswith("version="))


def load_map(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """A version of the map, the latest unless named."""
    return spark.read.schema(MAP).parquet(f"{path}/version={versions(spark, path)[-1] if version is None else version}")


def balanced_map(hist: DataFrame, shards: int, slots: int = SLOTS, path: str | None = None) -> tuple[DataFrame, int]:
    """(map, its version): the latest version under ``path``, edited for the histogram and stored as the next.

    A folder without a version gets version 0 first. Without a path the map gets
    a folder of its own in the shared one.
    """
    spark = hist.sparkSession
    path = path or shared_path(spark, "slot-map")
    if not versions(spark, path):
        first_map(spark, shards, slots).coalesce(1).write.parquet(f"{path}/version=0")
    version = versions(spark, path)[-1] + 1
    rebalance(load_map(spark, path), hist, shards).coalesce(1).write.parquet(f"{path}/version={version}")
    return load_map(spark, path, version), version


def shard(docs: DataFrame, shards: int, slots: int = SLOTS, path: str | None = None) -> DataFrame:
    """Assign every record to a shard and to its position there, from 0.

    A position is the record's rank within its virtual slot plus the rows of
    the shard's slots before it; so no window is wider than one slot. ``path``
    names a map to load, edit and store again.
    """
    records = stored(slotted(docs, slots), "slots")
    hist = stored(histogram(records).coalesce(1), "slot-histogram")
    current, version = balanced_map(hist, shards, slots, path)
    before = Window.partitionBy("shard").orderBy("virtual_slot").rowsBetween(Window.unboundedPreceding, -1)
    placed = stored(current.join(hist, "virtual_slot").select("virtual_slot", "shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset")).coalesce(1), "slot-offsets")
    forget(hist)
    upto = F.sum("copies").over(Window.partitionBy("virtual_slot").orderBy("doc_id", "text_crc32", "size", "run"))
    return (
        records.withColumn("upto", upto)
        .join(F.broadcast(placed), "virtual_slot")  # at most SLOTS rows
        .select("*", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy"))
        .select(
            "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
            (F.col("offset") + F.col("upto") - F.col("copy")).cast("long").alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", F.lit(version).alias("map_version"),
        )
    )
