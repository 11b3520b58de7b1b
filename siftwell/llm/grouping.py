"""Groups from pairwise matches by hash-to-min.

Every vertex v holds a set C(v), at first itself and its neighbours. In each round it sends
C(v) to m(v) = min C(v), and m(v) to every other member of C(v); what arrives is the new C(v).
When nothing changes, the smallest vertex of a group holds all of it and every other vertex
holds that smallest one. Sets are kept as rows (v, u), never as arrays, so a group may be of
any size; the number of rounds is logarithmic in the length of the longest chain in practice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.operators.skew import HOT_LEAST, lookup_join
from siftwell.session import materialise, observed, release


def group_links(links: DataFrame, a: str = "a", b: str = "b", group: str = "group_id", member: str = "id", max_rounds: int = 60) -> DataFrame:
    """One row (group, member) for each vertex of a link between two different vertices; group is the smallest member.

    Links with a null end and links of a vertex with itself are ignored; repeated links, links
    in either direction and extra columns change nothing; an empty table gives no rows. Raises
    RuntimeError if the sets still change after max_rounds (chains of about 2 ** max_rounds).

    Per round two jobs: the minimum of each set by a partial aggregation, which counts and hashes the sets on the way
    and so shows whether the last round changed anything; and one join of the sets to it, in which vertices with
    very large sets meet a broadcast row (see lookup_join), with one distinct. Each round is written to the shared folder
    and the one before is deleted.
    """
    ends = links.select(F.col(a).alias("v"), F.col(b).alias("u")).filter("v is not null and u is not null and v <> u")
    sets = materialise(ends.unionByName(ends.select(F.col("u").alias("v"), F.col("v").alias("u"))).distinct(), "sets")
    state = None
    for _ in range(max_rounds):
        own = sets.groupBy("v").agg(F.least(F.col("v"), F.min("u")).alias("m"), F.count(F.lit(1)).alias("_n"), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)")).alias("_h"))
        least, now = observed(own, "least", n=F.sum("_n"), h=F.sum("_h"), most=F.max("_n"))
        if (now["n"], now["h"]) == state or not now["n"]:
            # Stable: each vertex but the smallest holds exactly the smallest one, and the smallest holds all others.
            return least.select(F.col("m").alias(group), F.col("v").alias(member))
        state = now["n"], now["h"]
        to = least.select("v", "m")
        sent = sets.join(to, "v") if now["most"] <= HOT_LEAST else lookup_join(sets, to, ["v"], "inner", counts=least.select("v", "_n"))
        message = F.array(F.struct(F.col("m").alias("v"), F.col("u").alias("u")), F.struct(F.col("u").alias("v"), F.col("m").alias("u")), F.struct(F.col("m").alias("v"), F.col("v").alias("u")), F.struct(F.col("v").alias("v"), F.col("m").alias("u")))
        after = materialise(sent.select(F.explode(message).alias("x")).select("x.v", "x.u").filter("v <> u").distinct(), "sets")
        release(sets)
        release(least)
        sets = after
    raise RuntimeError(f"the groups still change after {max_rounds} rounds")


def same_verdicts(pairs: DataFrame, verdict: Column | None = None) -> DataFrame:
    """The links of scored pairs: verdict 'same' between two different records."""
    keep = F.col("verdict") == "same" if verdict is None else verdict
    return pairs.filter(keep & (F.col("a") != F.col("b"))).select("a", "b")
