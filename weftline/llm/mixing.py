"""Mixing sources to target weights by hash-threshold histograms.

Every record has a hash; a source takes the records whose hash lies under the
source's threshold, once for each whole pass of its budget and once more for
the rest. The threshold is found from sums by source and hash bucket; only the
bucket in which the budget ends is looked at more closely, so nothing is sorted
by record. DataFrame expressions throughout.

Defined results: a null text has size 0; null is a source of its own, the last;
repeated rows have equal hashes and share what is left at the threshold evenly;
an empty table gives an empty result; extra columns stay untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, row_of, rows_again, stored, text_or_empty

#: Bits of the record hash, and the bits that each histogram adds.
BITS, STEPS = 60, (12, 24)
#: No record is taken more often than this.
MOST = 3


def size_of(text: Column | str = "text") -> Column:
    return F.regexp_count(text_or_empty(text), F.lit(WORD)).cast("long")


def hash_of(doc_id: str = "doc_id", text: str = "text") -> Column:
    """60 bits of MD5 over id and text, the same in any SQL engine."""
    key = F.concat(F.coalesce(F.col(doc_id).cast("string"), F.lit("-")), F.lit(":"), text_or_empty(text))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 15), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """Target words of each source; ``sizes`` has one row a source: source, source_size.

    Targets are level * weight, cut at MOST times the source's size. The level
    is that at which all targets sum to all sizes: resharing the excess by
    weight until none is above ends there.
    """
    w = F.lit(None).cast("double")
    for k, x in enumerate(weights):
        w = F.when(F.pmod(F.col("place"), F.lit(len(weights))) == k, F.lit(float(x))).otherwise(w)
    ranked = sizes.withColumn("place", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1)
    capped = ranked.withColumn("w", w).withColumn("cap", (F.col("source_size") * MOST).cast("double"))
    order = Window.orderBy(F.col("cap") / F.col("w"), "place")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    stepped = capped.select(
        "*",
        F.row_number().over(order).alias("step"),
        ((F.sum(F.col("source_size").cast("double")).over(Window.partitionBy()) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(order.rowsBetween(0, Window.unboundedFollowing))).alias("level"),
    )
    found = F.min(F.when(F.col("level") * F.col("w") <= F.col("cap"), F.struct("step", "level"))).over(Window.partitionBy())["level"]
    return stepped.withColumn("found", found).select("source", "source_size", F.least("cap", F.col("found") * F.col("w")).alias("target"))


def boundary(records: DataFrame, need: DataFrame, unit: Column) -> DataFrame:
    """For each source the first ``unit`` at which the sums reach ``need.rest``.

    Adds to need's columns: unit, ``inside`` (what is needed of that unit) and
    ``rows`` (its records).
    """
    sums = records.groupBy("source", unit.alias("unit")).agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("rows"))
    upto = sums.withColumn("upto", F.sum("words").over(Window.partitionBy("source").orderBy("unit"))).withColumnRenamed("source", "s")
    over = upto.join(need, F.col("s").eqNullSafe(F.col("source"))).where((F.col("rest") > 0) & (F.col("upto") >= F.col("rest")) & (F.col("upto") - F.col("words") < F.col("rest")))
    return over.select(*need.columns, "unit", (F.col("rest") - F.col("upto") + F.col("words")).alias("inside"), "rows")


def plan_mix(records: DataFrame, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """One row a source: its target, whole passes, threshold and share at the threshold.

    ``records``: source, size, h. Each histogram has 2^12 rows a source at most,
    the second and third only of the bucket where the budget ends.
    """
    sizes = records.groupBy("source").agg(F.sum("size").alias("source_size"))
    goal = targets(sizes, weights)
    passes = F.when(F.col("source_size") > 0, F.least(F.floor(F.col("target") / F.col("source_size")), F.lit(MOST).cast("long"))).otherwise(F.lit(0).cast("long"))
    rest = F.least(F.greatest(F.round(F.col("target") - F.col("passes") * F.col("source_size")).cast("long"), F.lit(0).cast("long")), F.col("source_size"))
    goal = stored(goal.withColumn("passes", passes).withColumn("rest", F.when(F.col("passes") < MOST, rest).otherwise(F.lit(0).cast("long"))), "mix-targets")
    need, inside = goal.select("source", "rest"), records
    for bits in STEPS:
        unit = F.shiftright("h", BITS - bits)
        need = stored(boundary(inside, need, unit).select("source", F.col("inside").alias("rest"), F.col("unit").alias("bucket")), "mix-bucket")
        r, n = records.alias("r"), need.alias("n")
        inside = r.join(n, F.col("r.source").eqNullSafe(F.col("n.source")) & (F.shiftright("r.h", BITS - bits) == F.col("n.bucket"))).select("r.*")
        need = need.drop("bucket")
    last = boundary(inside, need, F.col("h")).select(F.col("source").alias("s"), F.col("unit").alias("threshold"), F.expr("inside div rows").alias("share"))
    out = goal.join(last, F.col("source").eqNullSafe(F.col("s")), "left").select("source", "source_size", "target", "passes", "threshold", "share")
    return stored(out, "mix-plan")


def apply_mix(docs: DataFrame, plan: DataFrame) -> DataFrame:
    """Add source_size, target and taken to rows that have source, size and h."""
    p = plan.withColumnRenamed("source", "s")
    more = F.when(F.col("h") < F.col("threshold"), F.col("size")).when(F.col("h") == F.col("threshold"), F.col("share")).otherwise(F.lit(0))
    return docs.join(p, F.col("source").eqNullSafe(F.col("s")), "left").withColumn("taken", F.col("passes") * F.col("size") + more).drop("s", "passes", "threshold", "share")


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """doc_id, size, source_size, target and taken of each record."""
    records = stored(docs.select("doc_id", "source", size_of().alias("size"), hash_of().alias("h")), "mix-records")
    mixed = apply_mix(records, plan_mix(records, weights))
    return mixed.select("doc_id", "size", "source_size", "target", F.col("taken").cast("long").alias("taken"))


def mixed_rows(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """The mix itself: whole rows of ``docs``, each as often as it is taken.

    The row at a source's threshold is taken once more if at least half of its
    words are.
    """
    marked = docs.select(row_of(docs), "source", size_of().alias("size"), hash_of().alias("h"))
    plan = plan_mix(stored(marked.drop("_row"), "mix-records"), weights).withColumnRenamed("source", "s")
    joined = marked.join(plan, F.col("source").eqNullSafe(F.col("s")), "left")
    once = (F.col("h") < F.col("threshold")) | ((F.col("h") == F.col("threshold")) & (F.col("share") * 2 >= F.col("size")))
    times = F.col("passes") + F.when(once, 1).otherwise(0)
    # a row without words weighs nothing: it stays once
    times = F.when(F.col("size") == 0, F.lit(1)).otherwise(times).cast("int")
    return rows_again(joined.select("_row", F.explode(F.array_repeat(F.lit(1), times))), docs)
