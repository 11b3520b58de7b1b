"""Mixing sources to target weights by Poisson replication.

Each document has a uniform number of 53 bits from a hash of its key and a seed; inverting the Poisson
distribution with its source's rate at that number gives the document's count of copies,
capped at the source's max_repeats. A higher rate never lowers a count, so the rate of each
source is found by bisection on the draw: the tokens by cell of the uniform number (at most `cells` rows a
source of the weights reach the driver, whatever the input) give the mixed size of any rate, but for the documents of
one cell a threshold lies in, which are taken to be spread evenly. The copies, with their texts, are then shuffled globally by a second hash.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.session import materialise

CELLS = 8192
#: Most sources that weights may name; more raise ValueError.
MOST_SOURCES = 2_000
#: The source that bounds the total is drawn until it gives this part of what max_repeats would let it give, so that its counts are draws too.
FILL = 0.95


def uniform(key: Column, seed: int) -> Column:
    """A number in (0, 1) of 53 bits from a hash of key and seed."""
    return (F.shiftrightunsigned(F.xxhash64(key, F.lit(seed)), 11).cast("double") + 0.5) / F.lit(float(1 << 53))


def thresholds(rate: float, most: int) -> list[float]:
    """t[k]: a document has more than k copies where its uniform number is at least t[k]: the Poisson distribution function."""
    p = total = math.exp(-rate)
    out = []
    for k in range(most):
        out.append(total)
        p *= rate / (k + 1)
        total += p
    return out


def mean_copies(rate: float, most: int) -> float:
    """The mean of a Poisson count capped at most."""
    return sum(1 - t for t in thresholds(rate, most))


def _above(after: list[float], t: float) -> float:
    """The tokens of documents with a uniform number of at least t; after[c]: those in cells from c on, with a last 0."""
    x = min(max(t, 0.0), 1.0) * (len(after) - 1)
    c = min(int(x), len(after) - 2)
    return after[c + 1] + (after[c] - after[c + 1]) * (1 - (x - c))


def _mixed(after: list[float], rate: float, most: int) -> float:
    """The tokens of all copies at a rate."""
    return sum(_above(after, t) for t in thresholds(rate, most))


def _bisect(grows, want: float, high: float = 1.0) -> float:
    """The x at which a growing function reaches want; the greatest tried where it doesn't."""
    while grows(high) < want and high < 600:
        high *= 2
    low = 0.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if grows(mid) < want else (low, mid)
    return high


def plan_mix(sized: DataFrame, weights: DataFrame, seed: int = 17, cells: int = CELLS, fill: float = FILL) -> list[dict]:
    """Per source of weights: rate, target and expected tokens. See mix_sources for the cases.

    The total is the largest one at which no source must give more than `fill` of its tokens times max_repeats:
    min over sources of fill * tokens * max_repeats / target_share.
    """
    rows = weights.filter("source is not null").select("source", "target_share", "max_repeats").limit(MOST_SOURCES + 1).collect()
    if len(rows) > MOST_SOURCES:
        raise ValueError(f"weights name more than {MOST_SOURCES} sources")
    rules = {}
    for w in sorted(rows, key=lambda w: str(tuple(w))):
        rules.setdefault(w["source"], w)
    wanted = F.broadcast(sized.sparkSession.createDataFrame([(s,) for s in rules], "source string"))
    cell = F.floor(uniform(F.col("doc_id"), seed) * cells).cast("int")
    after = {s: [0.0] * (cells + 1) for s in rules}
    for r in sized.join(wanted, "source").groupBy("source", cell.alias("cell")).agg(F.sum("n_tokens").alias("t")).collect():
        after[r["source"]][r["cell"]] = float(r["t"] or 0)
    for own in after.values():
        for c in range(cells - 1, -1, -1):
            own[c] += own[c + 1]
    active = {s: w for s, w in rules.items() if (w["target_share"] or 0) > 0 and (w["max_repeats"] or 0) > 0 and after[s][0] > 0}
    share = sum(w["target_share"] for w in active.values())
    total = min((fill * after[s][0] * w["max_repeats"] / (w["target_share"] / share) for s, w in active.items()), default=0.0)
    plan = []
    for s, w in rules.items():
        row = {"source": s, "target_share": w["target_share"], "max_repeats": w["max_repeats"], "available_tokens": int(after[s][0]), "rate": 0.0, "target_tokens": 0.0}
        if s in active:
            want = total * w["target_share"] / share
            row |= {"rate": _bisect(lambda x, s=s, w=w: _mixed(after[s], x, w["max_repeats"]), want), "target_tokens": want}
        plan.append(row)
    return plan


def mix_sources(docs: DataFrame, sizes: DataFrame, weights: DataFrame, seed: int = 17, cells: int = CELLS, fill: float = FILL) -> tuple[DataFrame, DataFrame]:
    """The mixed corpus (source, doc_id, copy_no, n_tokens, text, place) and its report, one row a source of weights.

    docs: doc_id (unique), source and text; sizes: doc_id, n_tokens. Documents of a null source or one without a row
    in weights are left out. Documents of no tokens are drawn like any other, null texts stay null. A source without
    tokens, target or repeats gets nothing and the others share its part; repeated rows of one
    source in weights: the first in order counts. Empty tables give an empty corpus. `place` is
    the position key of the global shuffle; the rows come ordered by it.
    """
    spark = docs.sparkSession
    sized = docs.select("doc_id", "source").filter("source is not null").join(sizes.select("doc_id", "n_tokens"), "doc_id")
    plan = plan_mix(sized, weights, seed, cells, fill)
    rules = spark.createDataFrame([(p["source"], thresholds(p["rate"], p["max_repeats"]) if p["target_tokens"] else []) for p in plan], "source string, steps array<double>")
    drawn = sized.join(F.broadcast(rules), "source").withColumn("_u", uniform(F.col("doc_id"), seed)).withColumn("copies", F.size(F.filter("steps", lambda t: t <= F.col("_u"))))
    drawn = materialise(drawn.filter("copies > 0").select("source", "doc_id", "n_tokens", "copies"), "drawn")
    got = drawn.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("reached_tokens"), F.sum("copies").alias("rows_out"), F.max("copies").alias("most_copies"))
    targets = spark.createDataFrame([(p["source"], p["target_share"], p["max_repeats"], p["available_tokens"]) for p in plan], "source string, target_share double, max_repeats int, available_tokens bigint")
    whole = got.agg(F.sum("reached_tokens").alias("_all"))
    report = targets.join(got, "source", "left").crossJoin(F.broadcast(whole)).select(
        "source", "target_share", "max_repeats", "available_tokens",
        F.coalesce("reached_tokens", F.lit(0)).alias("reached_tokens"), F.coalesce("rows_out", F.lit(0)).alias("rows_out"), F.coalesce("most_copies", F.lit(0)).alias("most_copies"),
        F.coalesce(F.try_divide(F.coalesce("reached_tokens", F.lit(0)).cast("double"), F.col("_all").cast("double")), F.lit(0.0)).alias("reached_share"),
    )
    # The text of a document is joined once and copied in place, so the only shuffle of copies is the global one.
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text")) if "text" in docs.columns else docs.select("doc_id", F.lit(None).cast("string").alias("text"))
    copies = drawn.join(texts, "doc_id").select("source", "doc_id", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy_no"), "n_tokens", "text")
    mixed = copies.withColumn("place", F.xxhash64("doc_id", "copy_no", F.lit(seed + 1)))
    return mixed.orderBy("place", "doc_id", "copy_no"), report
