"""Joins that stay balanced when one key holds a large part of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key is hot from this share of the rows on, so there are at most 1 / HOT_SHARE hot keys, whatever the input.
HOT_SHARE = 0.002
HOT_LEAST = 20_000


def hot_keys(rows: DataFrame, keys: list[str], share: float = HOT_SHARE, least: int = HOT_LEAST, counts: DataFrame | None = None) -> list:
    """The keys that hold more than `share` of the rows (and more than `least` rows): at most 1 / share of them.

    The counts are partially aggregated before the shuffle. The first pass brings one row to the driver: the
    total and the greatest count. Only where that is above both bounds a second one collects the keys, filtered by
    the share in the plan, so at most 1 / share rows ever reach the driver. A null key is never hot. counts: the
    number of rows, _n, of each key, where the caller has it.
    """
    if counts is None:
        counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    known = F.lit(True)
    for k in keys:
        known = known & F.col(k).isNotNull()
    sums = counts.agg(F.sum("_n").alias("total"), F.max(F.when(known, F.col("_n"))).alias("most")).first()
    bound = max(least, share * (sums["total"] or 0))
    if (sums["most"] or 0) <= bound:
        return []
    return counts.filter(known & (F.col("_n") > bound)).collect()


def lookup_join(rows: DataFrame, lookup: DataFrame, keys: list[str], how: str = "left", share: float = HOT_SHARE, least: int = HOT_LEAST, counts: DataFrame | None = None) -> DataFrame:
    """rows joined to a lookup that is unique on keys. Hot keys (at most 1 / share) meet a broadcast part of the lookup, all others a shuffled one.

    Null keys: kept without a match for how='left', dropped for 'inner'. counts: see hot_keys.
    """
    hot = hot_keys(rows, keys, share, least, counts)
    if not hot:
        return rows.join(lookup, keys, how)
    spark = rows.sparkSession
    schema = rows.select(*keys).schema
    marks = spark.createDataFrame([tuple(r[k] for k in keys) for r in hot], schema).withColumn("_hot", F.lit(True))
    marked = rows.join(F.broadcast(marks), keys, "left")
    few = lookup.join(F.broadcast(marks.drop("_hot")), keys, "left_semi")
    heavy = marked.filter("_hot").drop("_hot").join(F.broadcast(few), keys, how)
    light = marked.filter("_hot is null").drop("_hot").join(lookup, keys, how)
    return light.unionByName(heavy)
