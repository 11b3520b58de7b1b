"""Evaluation: labels by neighbouring ids, precision and recall over thresholds, exact groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.functions.similarity import jaro_winkler_udf
from siftwell.operators.components import connected_components

THRESHOLDS = (0.50, 0.60, 0.70, 0.80, 0.90, 0.95, 0.98, 0.99)


def _given_fit(a: Column, b: Column) -> Column:
    x, y = F.get(a, F.lit(0)), F.get(b, F.lit(0))
    single = (F.size(a) <= 1) | (F.size(b) <= 1)
    return F.when(single, (F.size(a) <= 1) & (F.size(b) <= 1)).otherwise((x == y) | ((F.length(x) == 1) & F.startswith(y, x)) | ((F.length(y) == 1) & F.startswith(x, y)))


def label_pairs(leads: DataFrame, gap: int = 3) -> DataFrame:
    """(a, b): leads whose ids differ by 1 to gap, with one domain root, like family names and compatible given names.

    The band is an equi-join on the shifted id, not a range condition.
    """
    own = leads.filter("domain_root is not null and domain_root <> '' and size(name_tokens) > 0").select("id", "domain_root", "name_tokens")
    left = own.select(F.col("id").alias("a"), "domain_root", F.col("name_tokens").alias("ta"), F.explode(F.sequence(F.lit(1), F.lit(gap))).alias("d")).withColumn("b", F.col("a") + F.col("d"))
    right = own.select(F.col("id").alias("b"), "domain_root", F.col("name_tokens").alias("tb"))
    near = left.join(right, ["b", "domain_root"])
    la, lb = F.element_at("ta", -1), F.element_at("tb", -1)
    return near.filter(_given_fit(F.col("ta"), F.col("tb"))).withColumn("_s", F.when(la == lb, F.lit(1.0)).otherwise(jaro_winkler_udf(la, lb))).filter("_s >= 0.92").select("a", "b")


def confusion(scored: DataFrame, truth: DataFrame, thresholds: tuple[float, ...] = THRESHOLDS) -> DataFrame:
    """(threshold, tp, fp, fn, precision, recall, f1) of pairs (a, b, score) against true pairs (a, b); empty counts give 0."""
    spark = scored.sparkSession
    cuts = F.broadcast(spark.createDataFrame([(t,) for t in thresholds], "threshold double"))  # a handful of rows
    marked = scored.select("a", "b", "score").join(truth.select("a", "b").distinct().withColumn("t", F.lit(True)), ["a", "b"], "full")
    hit = F.coalesce(F.col("score") >= F.col("threshold"), F.lit(False))
    true = F.col("t").isNotNull()
    c = marked.crossJoin(cuts).groupBy("threshold").agg(F.count_if(hit & true).alias("tp"), F.count_if(hit & ~true).alias("fp"), F.count_if(~hit & true).alias("fn"))
    ratio = lambda x, y: F.coalesce(F.try_divide(x.cast("double"), y.cast("double")), F.lit(0.0))
    p, r = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return c.withColumns({"precision": p, "recall": r}).withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def pair_sets(found: DataFrame, truth: DataFrame) -> DataFrame:
    """(a, b, outcome): recovered, missed or extra."""
    f, t = found.select("a", "b").distinct(), truth.select("a", "b").distinct()
    return f.intersect(t).withColumn("outcome", F.lit("recovered")).unionByName(t.exceptAll(f).withColumn("outcome", F.lit("missed"))).unionByName(f.join(t, ["a", "b"], "left_anti").withColumn("outcome", F.lit("extra")))


def exact_groups(found: DataFrame, truth: DataFrame) -> DataFrame:
    """One row: true groups, found groups, groups with exactly the same members. Groups are compared by an order-free hash of their members."""
    mark = lambda p: connected_components(p).groupBy("root").agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("id").cast("decimal(38,0)")).alias("h"))
    f, t = mark(found), mark(truth)
    same = f.join(t, ["root", "n", "h"], "left_semi").agg(F.count(F.lit(1)).alias("exact"))
    return t.agg(F.count(F.lit(1)).alias("true_groups")).crossJoin(f.agg(F.count(F.lit(1)).alias("found_groups"))).crossJoin(same)
