"""Connected components of a table of links by alternating large-star and small-star contraction."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.operators.skew import HOT_LEAST, lookup_join
from siftwell.session import materialise, observed, release

#: So many links, 16 bytes each, are finished in one task; more are contracted in rounds. Both give the same result.
LOCAL_LINKS = 500_000


def _finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(id, root) of all links (u, v) of one task: every id takes the least label around it, labels are then followed to their own."""
    parts = [(b["u"].to_numpy(np.int64), b["v"].to_numpy(np.int64)) for b in batches]
    u, v = (np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, np.int64) for k in (0, 1))
    ids, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    x, y = at[: len(u)], at[len(u) :]
    label = np.arange(len(ids))
    while True:
        before = label.copy()
        low = np.minimum(label[x], label[y])
        for end in (x, y):
            np.minimum.at(label, before[end], low)  # the root of each end is hooked to the lesser root
            np.minimum.at(label, end, low)
        while (label != label[label]).any():
            label = label[label]
        if (label == before).all():
            break
    yield pd.DataFrame({"id": ids, "root": ids[label]})


def connected_components(links: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60, local_links: int = LOCAL_LINKS) -> DataFrame:
    """(id, root) of every end of a link between two different ids; root is the smallest id of the component.

    Nulls and loops are ignored. Up to local_links distinct links are finished by one task (a bound on its memory, not on
    the result). Beyond, each round is two partially aggregated minima and two joins that spread hot ids;
    neighbourhoods are never gathered. Rounds are written to the shared folder, their counts taken on the way.
    """
    mark = {"n": F.count(F.lit(1)), "h": F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))}
    edges = links.select(F.greatest(a, b).cast("bigint").alias("u"), F.least(a, b).cast("bigint").alias("v")).filter("u is not null and v is not null and u <> v").distinct()
    edges, state = observed(edges, "edges", **mark)
    if state["n"] <= local_links:
        return edges.coalesce(1).mapInPandas(_finish, "id bigint, root bigint")
    nodes = edges.select(F.explode(F.array("u", "v")).alias("id")).distinct()
    first = edges
    for _ in range(max_rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least, found = observed(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"), F.count(F.lit(1)).alias("_n")), "least", most=F.max("_n"))
        counts = least.select("u", "_n") if (found["most"] or 0) > HOT_LEAST else None
        meet = both.join(least.drop("_n"), "u") if counts is None else lookup_join(both, least.drop("_n"), ["u"], "inner", counts=counts)
        large = meet.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = materialise(large, "large")
        low, found = observed(large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("_n")), "low", most=F.max("_n"))
        counts = low.select("u", "_n") if (found["most"] or 0) > HOT_LEAST else None
        meet = large.join(low.drop("_n"), "u") if counts is None else lookup_join(large, low.drop("_n"), ["u"], "inner", counts=counts)
        small = meet.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.u", "x.v").filter("u <> v").distinct()
        after, now = observed(small, "edges", **mark)
        for done in (least, large, low):
            release(done)
        if edges is not first:
            release(edges)
        edges = after
        if now == state:
            break
        state = now
    else:
        raise RuntimeError(f"components still change after {max_rounds} rounds")
    return nodes.join(edges.select(F.col("u").alias("id"), F.col("v").alias("root")), "id", "left").select("id", F.coalesce("root", "id").alias("root"))
